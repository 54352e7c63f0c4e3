"""The Merkle manifest against a tree built in plain Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """(root, proof of each leaf as [(before, after)])."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            proofs[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[k] = i // 3
        nodes = [h(*run) for run in runs]
    return nodes[0], proofs


def expected(rows):
    """leaf → set of (doc_id, subroot, root, proof, folded, verified); equal leaves may swap places."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0], leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in parts[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for r, own in zip(parts[s], trees[s][1], strict=True):
            steps = own + up
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                node = leaf((r[0], r[1].replace("\n", ""), *r[2:]))
            for before, after in steps:
                node = h(before, node, after)
            out.append((r[0], leaf(r), trees[s][0], root, h(*[b + a for b, a in steps]), node, node == root))
    return sorted(out, key=repr)


def found(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, DOCS) if rows else spark.createDataFrame([], DOCS)
    docs.withColumns({"node": F.lit("x"), "place": F.lit("y"), "group": F.lit("z")}).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).select(*columns).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [3], [4], [1, 2, 82], [81, 243, 9, 300], [5] * 30])
def test_matches_plain_tree(spark, tmp_path, sizes):
    names = [None, "", "Zeta", "a", "é", "日本", "\U0001f600"] + [f"s{k}" for k in range(40)]
    rows = []
    for k, size in enumerate(sizes):
        for _ in range(size):
            n = len(rows) * 7 % 1009
            rows.append((n, f"line {n}\nmore\n" if n % 3 else f"plain {n}", "en" if n % 5 else None, names[k], n if n % 7 else None))
    assert found(spark, rows, tmp_path) == expected(rows)


def test_odd_rows(spark, tmp_path):
    long = "many words\n" * 50_000
    rows = [
        (None, "a\n", None, None, None), (None, None, "-", "", 0), (1, None, "", None, 1), (1, "", "", None, 1), (2, long, "en", "s", 5),
        (2, long, "en", "s", 5), (3, "same", "en", "s", 1), (3, "same", "en", "s", 1), (3, "other\n", "en", "s", 1),
    ]
    assert found(spark, rows, tmp_path) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_only_every_fourth_level_is_stored(spark):
    rows = [(k, str(k), "en", "s", 1) for k in range(1000)]
    docs = spark.createDataFrame(rows, DOCS)
    leaves = docs.select(F.lit("s").alias("group"), "doc_id", F.unhex(merkle.leaf()).alias("node"))
    stored = merkle.build(merkle.placed(leaves, ["doc_id"], "t"), "t").levels
    assert [level.count() for level in stored] == [1000, 13, 1]

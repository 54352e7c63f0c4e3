"""Quality rules, mixing, packing, token files and line dedup against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lines, mixing, orc_ids, packing, rules
from tidemark.llm.tokens import tokenizer_path
from tidemark.session import shared_folder

ODD = ["", "  \n\t ", "one", "Ünï çödé 日本 words", "a\x1cb c\x0bd", "<|endoftext|> x", "tab\tand\r\nfeed", "x " * 3000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    rows = [(k, t, "en", sources[k] if sources else f"s{k % 3}", None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_texts(n, seed=1, vocabulary=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) + str(rng.randint(0, vocabulary)) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_quality_measures_match_brute_force(spark):
    texts = [*ODD, None, *random_texts(40, vocabulary=3), "a b c d e f\na b c d e f\n\n", "A! B! C! # $ %"]
    docs = documents(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("failed", F.lit("clash"))
    found = {r["doc_id"]: r for r in rules.ledger(docs).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        w, row = words(text), found[k]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        split = [x for x in (text or "").split("\n") if words(x)]
        assert row["n_words"] == len(w) and row["word_chars"] == sum(map(len, w))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert row["n_dup_lines"] == len(split) - len(set(split))
        assert row["n_repeat_words"] == len(covered)
        assert row["n_distinct_words"] == len(set(w))


def test_policies_and_ablations(spark):
    texts = ["word " * 5, " ".join(f"w{i}" for i in range(50)), "# " * 50, " ".join(f"value{i} #" for i in range(30))]
    rows = rules.ledger(documents(spark, texts)).cache()
    kept = [r["doc_id"] for r in rows.where(rules.passes(rules.PRODUCTION)).collect()]
    assert kept == [1]
    found = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in rules.ablations(rows, rules.PRODUCTION).collect()}
    assert found["symbols"] == (2, 1, 2)
    bits = [r["failed"] for r in rows.collect()]
    for name, (bit, _) in rules.RULES.items():
        assert found[name][0] == sum(b >> bit & 1 for b in bits)
    assert rules.ledger(documents(spark, [])).count() == 0


def brute_targets(sizes):
    total, fixed = 1.5 * sum(sizes.values()), {}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_targets_and_copies(spark):
    texts = [*random_texts(400, 3), None, "", "lone text here"]
    sources = [["b", "a", None, "z", "é", "c"][k % 6] if k < 400 else "empty" for k in range(403)]
    docs = documents(spark, texts, sources)
    found = mixing.mix(docs).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert len(found) == 403 and all(again[r["doc_id"]] == r["copies"] for r in found)
    sizes = Counter()
    for s, t in zip(sources, texts, strict=True):
        sizes[s] += len(words(t))
    goal, taken = brute_targets(dict(sizes)), Counter()
    for r in found:
        s = sources[r["doc_id"]]
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(goal[s]) and 0 <= r["copies"] <= 2
        taken[s] += r["copies"] * r["size"]
    for s, g in goal.items():
        assert abs(taken[s] - g) <= 0.05 * g + max(len(words(t)) for t in texts)
    copies = Counter(r["doc_id"] for r in mixing.repeat(docs).collect())
    assert copies == Counter({k: v for k, v in again.items() if v})


def test_mixing_of_nothing(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert {r["copies"] for r in mixing.mix(documents(spark, [None, ""])).collect()} <= {0, 1, 2}


def brute_bins(lengths, capacity):
    """Best fit decreasing by searching all bins: remaining rooms."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), 64, 20, 7]) for _ in range(400)]
    runs = packing.plan(Counter(lengths), 64)
    used = Counter()
    for length, own in runs.items():
        ends = [o[0] for o in own[1:]] + [Counter(lengths)[length]]
        for (rank, first, each, _), end in zip(own, ends, strict=True):
            for k in range(end - rank):
                used[first + k // each] += length
    assert max(used.values()) <= 64
    assert sorted(64 - v for v in used.values()) == brute_bins(lengths, 64)


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, None, *random_texts(60, 5)]
    docs = documents(spark, texts).withColumn("length", F.lit("clash"))
    docs = docs.union(docs.where("doc_id = 3"))  # a repeated row is a document of its own
    made = packing.pieces(docs, capacity=128)
    rows = packing.pack(made.cache(), 128).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    by_sequence, lengths = {}, []
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 128 * r["piece"] and len(part) == r["length"] <= 128
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["ids"] == np.array(part, "<u4").tobytes()
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        lengths.append(r["length"])
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by_sequence) == len(brute_bins(lengths, 128))
    assert packing.pack(packing.pieces(documents(spark, [])), 128).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, None, *random_texts(200, 6)]
    docs = documents(spark, texts).repartition(5)
    path = shared_folder(spark, "orc-test")
    orc_ids.write_ids(docs, path)
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    start = 0
    for k, row in enumerate(orc_ids.spans_of(spark, path).orderBy("doc_id").collect()):
        ids = [*tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 1]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (k, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = orc_ids.read_ids(spark, path, [3, 77]).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in some] == [3, 77] and some[0]["ids"][-1] == 1
    empty = shared_folder(spark, "orc-test")
    orc_ids.write_ids(documents(spark, []).union(spark.createDataFrame([(None, None, None, None, None)], DOCS)), empty)
    assert [tuple(r)[1:3] for r in orc_ids.spans_of(spark, empty).collect()] == [(0, 1)]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_lines_match_brute_force(spark):
    rng = random.Random(4)
    bases = [[f"w{rng.randint(0, 500)}x" for _ in range(rng.randint(5, 120))] for _ in range(25)]
    texts = []
    for _ in range(60):
        out = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice(["new", "other", "w7x"])
            out.append(rng.choice([" ".join(line), " ".join(line).upper() + "!", "short line", ""]))
        texts.append("\n".join(out))
    docs = documents(spark, [*texts, None, ""]).withColumn("line", F.lit("clash"))
    prints = {r["class"]: r["simhash"] for r in lines.fingerprints(docs).collect()}
    plain = {(k, i): re.sub(r"[^\w]+|_", " ", re.sub(r"\d", "0", x.lower())).split() for k, t in enumerate(texts) for i, x in enumerate(t.split("\n"))}
    plain = {p: w for p, w in plain.items() if len(w) >= lines.LEAST_WORDS}
    where = {(r["doc_id"], r["line"]): r["class"] for r in lines.fingerprints(docs).collect()}
    assert set(where) == set(plain)
    content = {where[p]: w for p, w in plain.items()}
    parent = {c: c for c in content}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(content, 2):
        near = bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= lines.DISTANCE
        longest = max(len(content[a]), len(content[b]))
        if near and edit(content[a], content[b]) <= longest * (100 - lines.SIMILAR) // 100:
            parent[root(a)] = root(b)
    group = {}
    for p in sorted(plain):
        group.setdefault(root(where[p]), p)
    assert any(len(set(c for c in content if root(c) == r)) > 1 for r in parent)
    found = {(r["doc_id"], r["line"]): r["kept"] for r in lines.groups(docs).collect()}
    assert found == {p: group[root(where[p])] == p for p in plain}
    report = {r["doc_id"]: r for r in lines.report(docs).collect()}
    assert report[60]["n_lines"] == 0 and report[61]["n_lines"] == 1
    cut = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs).collect()}
    for k, text in enumerate(texts):
        left = [x for i, x in enumerate(text.split("\n")) if found.get((k, i), True)]
        if len(left) == len(text.split("\n")) or words("\n".join(left)):
            assert cut[k] == "\n".join(left)
        else:
            assert k not in cut
    assert lines.groups(documents(spark, [])).count() == 0


def test_clashing_columns_of_the_mix_and_of_packing(spark):
    docs = documents(spark, [*random_texts(12), None, ""], ["a", "b"] * 7)
    for clash in ("_copies", "_source", "_target", "size", "whole", "row", "copy"):
        docs = docs.withColumn(clash, F.lit("clash"))
    mixed = mixing.repeat(docs)
    plain = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sorted(r[0] for r in mixed.select("doc_id").collect()) == sorted(r["doc_id"] for r in plain.collect() for _ in range(r["copies"]))
    pieces = spark.createDataFrame([(k, 300 + 100 * (k % 9)) for k in range(40)], "doc_id long, length long")
    clashing = pieces.withColumns({c: F.lit("clash") for c in ("sequence_id", "offset", "_rank", "_part", "_n", "_base")})
    found = packing.pack(clashing)
    assert found.columns == ["doc_id", "length", "sequence_id", "offset"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, packing.pack(pieces).collect()))

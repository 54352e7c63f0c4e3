"""Ranked search against a plain loop over documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, top=20):
    counts = [(doc_id, Counter(t)) for doc_id, t in ((d, terms(x)) for d, x in docs) if t]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in set(items):
        scored, asked = [], Counter(terms(text))
        for doc_id, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, k in asked.items() if c[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    d = d.withColumns({"n": F.lit("clash"), "item": F.lit(1), "terms": F.lit(None), "rank": F.lit(0)})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(7), "score": F.lit("clash")})
    return sorted((tuple(r) for r in search.search(d, q, **how).collect()), key=repr)


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(120)] + ["Ünï", "ünï", "日本", "Straße", "x-y", "A_b", "İ"]
    return [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(n)]


@pytest.mark.parametrize("tile", [search.ITEM_TILE, 1500])
def test_matches_a_plain_loop(spark, tile):
    docs = [*corpus(300), (900, None), (901, ""), (902, "!!! --- \n"), (None, "w1 w2 w3 w3"), (903, "W5 w5\x00w5_w6 " * 20_000)]
    items = [(k, t) for k, (_, t) in enumerate(corpus(25, seed=5))] + [(90, None), (91, ""), (92, "nothing of this"), (93, "w1 W1 w1 w7"), (93, "w8")]
    assert found(spark, docs, items, item_tile=tile) == expected(docs, items)


def test_ties_at_the_cut_go_by_document(spark):
    docs = [(k, "the same text") for k in range(200, 0, -1)] + [(5, "the same text"), (500, "other words")]
    items = [(1, "same"), (1, "same"), (2, "other text"), (None, "words")]
    rows = found(spark, docs, items)
    assert rows == expected(docs, items)
    assert [r[2] for r in sorted(r for r in rows if r[0] == 1)] == [1, 2, 3, 4, 5, 5, *range(6, 20)]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_blocks_keep_sums_exact():
    weights = [26_000, 3, 9_000, 0]
    items = [Counter({0: 700_000, 1: 5, 2: 10}), Counter({0: 2, 3: 9}), Counter()]
    made = search.blocks(items, weights)
    total = np.zeros((3, 4), dtype=object)
    for used, matrix in made:
        assert (matrix.sum(axis=1) * search.MOST_IMPACT < search.EXACT).all()
        for column, term in enumerate(used):
            total[:, term] += [int(x) for x in matrix[:, column]]
    assert len(made) > 1
    assert (total == [[items[r][t] * weights[t] for t in range(4)] for r in range(3)]).all()


def test_scores_beyond_one_block(spark):
    """An item of so many repeats that its sums pass 2**53."""
    items = [(1, "rare " * 3_000_000), (2, "rare common")]
    docs = [(k, "rare " * (k + 1) if k < 3 else f"common c{k}") for k in range(400)]
    rows = found(spark, docs, items)
    assert rows == expected(docs, items)
    assert max(r[3] for r in rows) > 2**53

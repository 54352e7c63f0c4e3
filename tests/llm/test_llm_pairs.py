"""Near-duplicate documents and vectors against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import lattice, setsketch
from tidemark.llm.components import components


def brute_components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(200, k) for k in range(201, 260)]
    edges += [(k, k + 1) for k in range(300, 340)] + [(5, 5), (7, None)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {(a, b) for a, b in edges if b is not None}
    want = brute_components(341, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert found == {k: want[k] for e in pairs for k in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    w = text.encode().lower().split() if text else []
    n = min(n, len(w))
    return set(zip(*(w[k:] for k in range(n)), strict=False)) if n else set()


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_match_brute_force(spark, n):
    rng = random.Random(n)
    bases = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 400))] for _ in range(30)]
    texts = [None, "", " \n ", "one", "ONE", "two words", "Two  words", "a b c d e f", "a b c d e g", "É x y z", "é x y z"]
    for _ in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, len(w) // 30, len(w) // 12])):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 9)}"
        texts.append(" ".join(w) + rng.choice(["", " ", "\n"]))
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(20, texts[20], "clash"), (None, texts[21], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    found = setsketch.near_duplicates(docs, setsketch.SetSketch(words=n)).collect()
    sets = [shingles(t, n) for t in texts]
    linked = lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = brute_components(len(texts), linked)
    assert len(found) == len(rows) and len(set(want)) < len(texts) - 50
    for r in found:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            k = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[k]), want[k], want[k] == k)
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0


def test_pairs_that_only_meet_through_a_pivot_are_found(spark):
    """A chain of texts: the ends of a bucket are linked only by way of others."""
    base = [f"c{k}" for k in range(120)]
    texts = [" ".join(base[k * 4 :] + [f"d{j}" for j in range(k * 4)]) for k in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 5) for t in texts]
    want = brute_components(15, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    found = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(docs).collect()}
    assert [found[k] for k in range(15)] == want


def test_joint_likelihood_estimates_similarity():
    how = setsketch.SetSketch()
    rng = np.random.default_rng(1)
    for j in (0.1, 0.5, 0.8, 0.95):
        got = []
        for _ in range(20):
            common = int(1000 * j)
            pool = rng.integers(0, 2**63, 2000 - common, dtype=np.uint64)
            a, b = pool[:1000], pool[1000 - common :]
            got.append(setsketch.likely(*(setsketch.sketch(x, how)[None, :] for x in (a, b)), np.array([1000.0]), np.array([1000.0]), how)[0])
        assert np.mean(got) == pytest.approx(j / (2 - j), abs=0.04)
    a, b = rng.integers(0, 2**63, (2, 300), dtype=np.uint64)
    merged = np.maximum(setsketch.sketch(a, how), setsketch.sketch(b, how))
    assert (merged == setsketch.sketch(np.concatenate([a, b]), how)).all()


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * 2
    near = lattice.minimal_vectors()
    assert len(near) == 240 and np.allclose((near**2).sum(1), 2)
    cells = lattice.decode(x)
    best = ((x - cells) ** 2).sum(1)
    assert (best <= 1 + 1e-9).all()  # the covering radius
    for v in near:  # no neighbour is nearer, which for a lattice means none at all
        assert (((x - cells - v) ** 2).sum(1) >= best - 1e-9).all()


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    noise = rng.uniform(0.05, 0.5, 600)[:, None]
    x = np.concatenate([centres[rng.integers(0, 40, 600)] + noise * rng.normal(size=(600, 64)), rng.normal(size=(200, 64))])
    x = x.astype(np.float32)
    x[10], x[11], x[12] = x[13], 3 * x[13], x[13]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0, 2.0], [1.0, 2.0]]
    rows += [(800 + k, v) for k, v in enumerate(bad)]
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), rows[13]], "vec_id long, embedding array<float>")
    found = [r for r in lattice.near_vectors(docs).collect() if r["vec_id"] is not None]
    assert len(found) == 809
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.9) & ~np.eye(800, dtype=bool)
    links = near.sum(1)
    got = {r["vec_id"]: r["n_links"] for r in found}
    assert sum(got[k] for k in range(800)) >= 0.97 * links.sum()
    assert all(got[k] <= links[k] for k in range(800))
    assert [got[800 + k] for k in range(8)] == [0] * 6 + [1, 1]
    want = brute_components(800, lambda a, b: near[a, b])
    same = [r["component_id"] == want[r["vec_id"]] for r in found if r["vec_id"] < 800]
    assert np.mean(same) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert lattice.near_vectors(docs.limit(0)).count() == 0

"""Stored search indexes: same results as looking at everything, from few files."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.plans import load_all
from tidemark.session import shared_folder

FILED = "company long, form string, filed_date date"


def filed(rows, spark, schema):
    frame = spark.createDataFrame(rows, schema)
    key = F.col(schema.split()[0])
    return frame.withColumns({"company": key % 4, "form": F.when(key % 2 == 0, "10-K").otherwise("8-K"), "filed_date": F.date_add(F.lit("2020-01-01").cast("date"), key.cast("int"))})


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(2)
    words = ["risk", "factors", "Ünternehmen", "growth", "the", "a1", *[f"w{k}" for k in range(300)]]
    rows = [(d, o, " ".join(rng.choices(words, k=rng.randint(0, 12))) + ".") for d in range(60) for o in range(4)]
    rows += [(90, 0, None), (91, 0, ""), (92, 0, "RISK risk factors; GROWTH")]
    path = shared_folder(spark, "test-index")
    search.build_index(filed(rows, spark, "doc_id long, ordinal long, text string"), path)
    return path, rows


@pytest.mark.parametrize("terms", [["risk"], ["Risk", "growth", "factors"], ["the", "nowhere"], ["ünternehmen", "a1"]])
@pytest.mark.parametrize("limits", [{}, {"companies": [1, 2]}, {"forms": ["10-K"], "since": "2020-01-20"}])
def test_text_search_equals_a_scan(spark, index, terms, limits):
    path, rows = index
    asked = list(dict.fromkeys(t.lower() for t in terms))
    counts = {(d, o): [re.findall(r"[^\W_]+", (t or "").lower()).count(w) for w in asked] for d, o, t in rows}
    spread = [sum(c[i] > 0 for c in counts.values()) for i in range(len(asked))]
    out = []
    for (d, o), c in counts.items():
        day = np.datetime64("2020-01-01") + d
        inside = (d % 4 in limits.get("companies", range(4))) and (("10-K" if d % 2 == 0 else "8-K") in limits.get("forms", ["10-K", "8-K"]))
        if any(c) and inside and day >= np.datetime64(limits.get("since", "2000-01-01")):
            score = sum(x * math.log(1 + len(rows) / (1 + s)) for x, s in zip(c, spread, strict=True))
            out.append((-all(c), -math.floor(score * 1e6 + 0.4873), d, o))
    found = search.search_text(spark, path, terms, **limits)
    assert [(r["doc_id"], r["ordinal"], r["all_words"]) for r in found.collect()] == [(d, o, bool(a)) for a, _, d, o in sorted(out)[:50]]


def test_text_search_reads_its_terms_folders_only(spark, index):
    plan = plan_of(search.search_text(spark, index[0], ["risk"], forms=["10-K"]))
    assert "EqualTo(term,risk)" in plan and "In(form" in plan or "EqualTo(form,10-K)" in plan
    scan = spark.read.parquet(f"{index[0]}/postings").where(search._any_of(["risk"]))
    assert len({f.rsplit("/", 2)[-2] for f in scan.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) == 1


def vectors(spark, seed=4, n=900, dim=16, noise=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, dim))
    data = middles[rng.integers(0, 12, n)] + noise * rng.normal(size=(n, dim))
    rows = [(k, [float(x) for x in v], f"m{k % 2}") for k, v in enumerate(data)]
    rows += [(5000, None, "m0"), (5001, [0.0] * dim, "m0"), (5002, [float("nan")] * dim, "m1"), (5003, rows[0][1], "m0"), (5004, rows[0][1], "m1")]
    return filed(rows, spark, "vec_id long, embedding array<double>, model string"), rows


@pytest.mark.parametrize("noise", [0.05, 3.0])
def test_vector_search_is_exact_and_of_one_model(spark, noise):
    frame, rows = vectors(spark, noise=noise)
    path = shared_folder(spark, "test-vectors")
    search.build_vectors(frame, path)
    for target in (0, 1, 77):
        model, t = rows[target][2], np.array(rows[target][1])
        for limits in ({}, {"companies": [1, 3]}, {"forms": ["8-K"], "since": "2020-03-01", "limit": 7}):
            kept = [
                (k, v) for k, v, m in rows
                if m == model and v is not None and np.isfinite(v).all() and any(v) and k % 4 in limits.get("companies", range(4))
                and ("10-K" if k % 2 == 0 else "8-K") in limits.get("forms", ["10-K", "8-K"])
                and np.datetime64("2020-01-01") + k >= np.datetime64(limits.get("since", "2000-01-01"))
            ]
            near = sorted((math.floor((1 - np.dot(v, t) / np.linalg.norm(v) / np.linalg.norm(t)) * 1e9 + 1e-3), k) for k, v in kept)
            found = search.search_vector(spark, path, model, list(map(float, t)), **limits).collect()
            assert {r["vec_id"] for r in found} == {k for _, k in near[: limits.get("limit", 50)]}
            assert [r["distance"] for r in found] == sorted(r["distance"] for r in found)


def test_vector_search_reads_few_cells_of_clustered_vectors(spark):
    frame, rows = vectors(spark, n=1200)
    path = shared_folder(spark, "test-vectors")
    search.build_vectors(frame, path)
    found = search.search_vector(spark, path, "m0", rows[0][1], limit=10)
    cells = search.cells_to_read(spark, path, "m0", rows[0][1])
    reach = math.acos(1 - found.collect()[-1]["distance"])
    assert len(cells) >= 12 and 0 < sum(bound <= reach for bound, *_ in cells) < len(cells) / 2
    plan = plan_of(found)
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200]


def test_registered_searches_look_at_every_filing(spark, tmp_path):
    """The best passage and the nearest vector belong to a form, a day and a label that no search may leave out."""
    plain = [(d, "the elle erre", "a", "en") for d in range(181, 241)]
    rows = [*plain, (2, "the the the elle elle erre erre", "a", "en"), (3, "the the elle elle erre erre", "a", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(k, [1.0, 0.2 + k / 5000], 0) for k in range(1180, 1260)] + [(0, [1.0, 0.0], 0), (5, [1.0, 0.01], 1), (6, [1.0, 0.02], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    registry = load_all()
    texts = registry["search_text"].run(spark, str(tmp_path)).collect()
    assert len(texts) == 50 and {2, 3} <= {r["doc_id"] for r in texts}
    fused = {r["id"]: r for r in registry["search_hybrid"].run(spark, str(tmp_path)).collect()}
    assert [fused[k]["text_rank"] for k in (2, 3)] == [1, 2] and [fused[k]["vector_rank"] for k in (0, 5, 6)] == [1, 2, 3]

"""Search over stored indexes: an inverted index of passages, and vectors filed by cells.

Both are written once. A text search reads the files of its terms only; a vector search reads the cells that can hold one
of the nearest vectors, which angles to the cells' centres bound from below, so its result is exact."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import Stages, shuffles_go

CANDIDATES = 50
#: Folders that terms are dealt to.
BUCKETS = 64
#: Vectors whose clusters give the cells' centres, and the most cells a model has.
SAMPLE, MOST_CELLS = 4096, 256
#: Slack of bounds against rounding of angles (near 0 a cosine's last digit moves an angle by 2e-8).
SLACK = 1e-6


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


# --- Text ---------------------------------------------------------------------------------


def build_index(passages: DataFrame, path: str) -> None:
    """passages (doc_id, ordinal, text, company, form, filed_date) → postings and term counts under `path`.

    A posting is (term, passage, times) with what searches filter by. Files are sorted by term inside a folder per bucket, and a
    term of any share of the passages is spread over as many ranges as it needs."""
    words = passages.select("company", "form", "filed_date", "doc_id", "ordinal", F.explode(tokens(F.col("text"))).alias("term"))
    postings = words.groupBy("doc_id", "ordinal", "term").agg(
        F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("company", "form", "filed_date")]
    )
    spark = passages.sparkSession
    stages = Stages(spark)
    # counted once, for the ranges' bounds and for dealing; one shuffle lies on disk at a time
    postings = stages.keep(postings.withColumn("bucket", _bucket(F.col("term"))), "postings")
    ranges = postings.repartitionByRange("bucket", "term", "doc_id", "ordinal").sortWithinPartitions("bucket", "term", "doc_id", "ordinal")
    with shuffles_go(spark):
        ranges.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    stages.close()
    stored = spark.read.parquet(f"{path}/postings")
    counts = stored.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("passages"))
    total = passages.agg(F.count(F.lit(1)).alias("passages")).select(F.lit(-1).alias("bucket"), F.lit("").alias("term"), "passages")
    both = counts.unionByName(total)
    both.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")


def _any_of(words: list[str]) -> Column:
    """Rows of these terms; buckets fold to constants, so folders of others are not listed."""
    out = F.lit(False)
    for word in words:
        out = out | ((F.col("bucket") == _bucket(F.lit(word))) & (F.col("term") == word))
    return out


def _filtered(rows: DataFrame, companies: list[int] | None, forms: list[str] | None, since: str | None) -> DataFrame:
    if companies:
        rows = rows.where(F.col("company").isin(companies))
    if forms:
        rows = rows.where(F.col("form").isin(forms))
    return rows.where(F.col("filed_date") >= F.lit(since).cast("date")) if since else rows


def search_text(
    spark: SparkSession, path: str, terms: list[str], *, companies: list[int] | None = None, forms: list[str] | None = None,
    since: str | None = None, limit: int = CANDIDATES,
) -> DataFrame:
    """Passages with all words first, filled with any-word matches, by summed term weight
    (term count × inverse passage frequency over all passages); ties by id.

    Ranking differs from a database's cover density; the match sets are the same."""
    words = list(dict.fromkeys(t.lower() for t in terms))
    postings = spark.read.parquet(f"{path}/postings").where(_any_of(words))
    counts = spark.read.parquet(f"{path}/terms").where(_any_of(words) | (F.col("bucket") == -1))
    at = lambda w: F.max(F.when(F.col("term") == w, F.col("passages")))
    totals = counts.agg(at("").alias("_n"), *[F.coalesce(at(w), F.lit(0)).alias(f"_d{i}") for i, w in enumerate(words)])
    times = lambda w: F.coalesce(F.max(F.when(F.col("term") == w, F.col("times"))), F.lit(0))
    hits = _filtered(postings, companies, forms, since).groupBy("doc_id", "ordinal").agg(*[times(w).alias(f"_c{i}") for i, w in enumerate(words)])
    joined = hits.join(F.broadcast(totals))  # one row
    weight, present = F.lit(0.0), F.lit(0)
    for i in range(len(words)):
        weight = weight + F.col(f"_c{i}") * F.ln(1 + F.col("_n") / (1 + F.col(f"_d{i}")))
        present = present + (F.col(f"_c{i}") > 0).cast("int")
    ranked = joined.select("doc_id", "ordinal", (present == len(words)).alias("all_words"), weight.alias("score"))
    # scores equal but for rounding must tie: order by a fixed grid
    grid = F.floor(F.col("score") * 1e6 + 0.4873)
    return ranked.orderBy(F.desc("all_words"), F.desc(grid), "doc_id", "ordinal").limit(limit)


# --- Vectors ------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Vectors with a direction: not null, no null or non-finite part, not all zero."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(plain & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _centres(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Directions of `cells` clusters; the first centres are spread over the sample."""
    rows = _unit(sample)
    centres = rows[np.linspace(0, len(rows) - 1, cells).astype(int)]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _filing(centres: dict[str, np.ndarray], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = batch.column("model").to_pylist()
            cell, angle = np.zeros(len(models), np.int32), np.zeros(len(models))
            for model in set(models):
                at = np.flatnonzero([m == model for m in models])
                rows = batch.column("embedding").take(pa.array(at))
                rows = _unit(rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1))
                near = rows @ centres[model].T
                cell[at] = near.argmax(1)
                angle[at] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], schema=schema)

    return run


def build_vectors(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """vectors (vec_id, embedding, model, company, form, filed_date) → a folder per model and cell under `path`.

    Centres come from SAMPLE vectors of each model, every vector is filed under its nearest centre with its angle to it,
    and a cell is known by its centre and its least and largest angle. Vectors without a direction are left out. All
    vectors of a model have one length; models are few."""
    rows = vectors.select("vec_id", "model", "company", "form", "filed_date", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(usable(F.col("embedding")))
    sizes = dict(rows.groupBy("model").count().collect())  # a row per model
    centres = {}
    for model, n in sizes.items():
        sample = rows.where(F.col("model") == model).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
        k = min(cells or max(1, math.isqrt(n)), MOST_CELLS, len(sample))
        centres[model] = _centres(np.array([r[0] for r in sample]), k)
    spark = vectors.sparkSession
    kind = rows.limit(0).toArrow().schema.append(pa.field("cell", pa.int32())).append(pa.field("angle", pa.float64()))
    filed = rows.mapInArrow(_filing(centres, kind), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, cell int, angle double")
    filed = filed.repartitionByRange("model", "cell", "angle").sortWithinPartitions("model", "cell", "angle")
    filed.write.mode("overwrite").partitionBy("model", "cell").parquet(f"{path}/vectors")
    middles = [(model, k, [float(x) for x in c]) for model, cs in centres.items() for k, c in enumerate(cs)]
    middle = spark.createDataFrame(middles, "model string, cell int, centre array<double>")  # MOST_CELLS per model
    stored = spark.read.schema(filed.schema).parquet(f"{path}/vectors")
    ends = stored.groupBy("model", "cell").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count(F.lit(1)).alias("n"))
    ends.join(F.broadcast(middle), ["model", "cell"]).write.mode("overwrite").parquet(f"{path}/cells")


def cosine_distance(vector: Column, target: Column) -> Column:
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return 1 - dot(vector, target) / (F.sqrt(dot(vector, vector)) * F.sqrt(dot(target, target)))


def _nearest(rows: DataFrame, target: list[float], limit: int) -> DataFrame:
    distance = cosine_distance(F.col("embedding"), F.lit(target).cast("array<double>"))
    ranked = rows.select("vec_id", distance.alias("distance"))
    return ranked.orderBy(F.floor(F.col("distance") * 1e9), "vec_id").limit(limit)


def cells_to_read(spark: SparkSession, path: str, model: str, target: list[float]) -> list[tuple[float, int, float, int]]:
    """(lower bound of the angle to any vector, cell, angle to its centre, vectors) of a model's cells, nearest first."""
    t = np.array(target, float) / np.linalg.norm(target)
    known = spark.read.parquet(f"{path}/cells").where(F.col("model") == model).collect()  # MOST_CELLS rows at most
    out = []
    for c in known:
        angle = float(np.arccos(np.clip(np.dot(t, c["centre"]), -1, 1)))
        out.append((max(0.0, angle - c["most"], c["least"] - angle) - SLACK, c["cell"], angle, c["n"]))
    return sorted(out)


def search_vector(
    spark: SparkSession, path: str, model: str, target: list[float], *, companies: list[int] | None = None, forms: list[str] | None = None,
    since: str | None = None, limit: int = CANDIDATES,
) -> DataFrame:
    """Nearest vectors of the target's own model by cosine distance, exact; ties by id.

    First the nearest cells that hold enough vectors are read. The angle of the last one found then bounds what any other
    cell, and any vector at another angle to its cell's centre, could add; only those are read."""
    vectors = spark.read.parquet(f"{path}/vectors").where(F.col("model") == model)
    vectors = _filtered(vectors, companies, forms, since)
    cells = cells_to_read(spark, path, model, target)
    first, held = [], 0
    for _, cell, _, n in cells:
        first.append(cell)
        held += n
        if held >= limit:
            break
    found = _nearest(vectors.where(F.col("cell").isin(first)), target, limit).collect()  # limit rows
    if len(found) < limit:
        return _nearest(vectors, target, limit)  # filters leave few: look everywhere
    reach = float(np.arccos(np.clip(1 - found[-1]["distance"], -1, 1))) + 2 * SLACK
    ring = F.lit(False)
    for bound, cell, angle, _ in cells:
        if bound <= reach:
            ring = ring | ((F.col("cell") == cell) & F.col("angle").between(angle - reach, angle + reach))
    return _nearest(vectors.where(ring), target, limit)

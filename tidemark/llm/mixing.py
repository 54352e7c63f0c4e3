"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
#: The mix takes SHARE of all words (as a fraction 3 / 2) and no source more than CAP times its size.
SHARE = (3, 2)
CAP = 2
#: Hash seeds tried per source; the one whose Bernoulli copies come nearest the target is used.
SEEDS = 16
_ROLL = 1 << 52


def size_of(text: Column) -> Column:
    """Words of a text; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, size) → per source: source, source_size, target.

    Sources in code-point order, null last, get the weights in turn and share SHARE of all sizes; a target stops at CAP times
    its source's size and the excess goes to the others by weight. That is the level L with sum(min(cap, L * weight)) = total,
    found by ordering sources by cap / weight: one row per source, in integers until the last division.
    """
    per_source = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")).cast("long")
    rows = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * CAP)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.select(
        "source", "source_size", "weight", "cap", F.row_number().over(by_level).alias("place"),
        (F.sum("source_size").over(everything) * SHARE[0]).alias("twice_total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
    )
    left = F.col("twice_total") - SHARE[1] * F.col("capped")
    free = F.col("cap") * SHARE[1] * F.col("open_weight") >= left * F.col("weight")
    first = F.struct(F.col("place"), left.alias("left"), F.col("open_weight"))
    rows = rows.withColumn("level", F.min(F.when(free, first)).over(everything))
    share = (F.col("level.left") * F.col("weight")).cast("double") / (F.col("level.open_weight") * SHARE[1])
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def roll(doc_id: Column, seed: int | Column) -> Column:
    """A hash of a document id in [0, 2^52), the same in every run; a null id rolls as the text 'null'."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    name = F.concat(seed.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")


def rates(sizes: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size) → per source: source, source_size, target, whole, threshold, seed.

    The repetition rate target / source_size is kept as its whole part and, for its fraction, the roll below which a document
    gets one more copy. The seed, out of SEEDS, brings the source's taken words nearest its target (the least seed on ties).
    """
    per_source = targets(sizes)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per_source = per_source.withColumns({"whole": F.floor(rate), "threshold": F.floor((rate - F.floor(rate)) * _ROLL)})
    per_source = stored(per_source, "targets")
    tried = sizes.join(per_source.withColumn("known", F.lit(True)), sizes["source"].eqNullSafe(per_source["source"])).select(
        per_source["source"], "size", "doc_id", "threshold"
    )
    extra = [
        F.sum(F.when(roll(F.col("doc_id"), k) < F.col("threshold"), F.col("size")).otherwise(0)).alias(f"x{k}")
        for k in range(SEEDS)
    ]
    sums = tried.groupBy("source").agg(*extra)
    joined = per_source.join(sums.withColumnRenamed("source", "s"), per_source["source"].eqNullSafe(F.col("s")), "left")
    base = F.col("whole") * F.col("source_size")
    offs = [F.struct(F.abs(base + F.col(f"x{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]
    best = F.array_min(F.array(*offs))["seed"]
    return joined.select("source", "source_size", "target", "whole", "threshold", best.alias("seed"))


def _with_copies(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with doc_id, source → the same with _source_size, _target and _copies.

    The table has one row per source: Spark broadcasts it when it finds it small and splits a skewed source otherwise.
    """
    own = per_source.withColumnsRenamed({c: f"_{c}" for c in per_source.columns})
    joined = sized.join(own, sized["source"].eqNullSafe(own["_source"]))
    more = F.when(roll(F.col("doc_id"), F.col("_seed")) < F.col("_threshold"), 1).otherwise(0)
    copies = (F.col("_whole") + more).cast("long").alias("_copies")
    return joined.select(*sized.columns, "_source_size", "_target", copies)


def _sizes(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")


def mix(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text) → per row: doc_id, size, source_size, target, copies (long).

    copies is floor(rate) plus one if the document's roll falls below the fraction, so never over CAP. Null texts have size 0
    and are copied like others; equal rows get equal copies; null sources form a source of their own.
    """
    sizes = _sizes(docs)
    rows = _with_copies(sizes, stored(rates(sizes), "rates"))
    return rows.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies")
    )


def repeat(docs: DataFrame) -> DataFrame:
    """docs → the mix itself: each row as often as its copies, with the columns of docs, whatever they are called."""
    whole = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = _with_copies(whole, stored(rates(_sizes(docs)), "rates")).where("_copies > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

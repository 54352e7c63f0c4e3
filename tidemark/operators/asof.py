"""As-of joins and grids: what was known on a day, without pairing rows with every day.

Rows are first reduced map-side to one per (key, day or grid date), so a hot key shrinks to the
calendar's size before any window orders it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EARLIEST = "1900-01-01"


def asof_join(
    left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, values: list[str]
) -> DataFrame:
    """Each left row with the right side's newest row on or before its day.

    `right` has one row per (key, day). Keys are cut into months, each month carrying in the last
    value before it, so no task holds all rows of a key."""
    payload = F.struct(F.col(right_day).alias("asof_day"), *values)
    known = right.select(
        key, F.col(right_day).alias("_day"), payload.alias("_value"), F.lit(0).alias("_side")
    )
    asked = left.select(
        key, F.col(left_day).alias("_day"), F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    )
    both = asked.unionByName(known, allowMissingColumns=True).withColumn(
        "_month", F.trunc("_day", "month")
    )
    months = both.groupBy(key, "_month").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.col("_day"))).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    carry = months.select(key, "_month", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    inside = (
        Window.partitionBy(key, "_month").orderBy("_day", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = both.withColumn("_found", F.last("_value", ignorenulls=True).over(inside)).where(
        F.col("_side") == 1
    )
    found = filled.join(carry, [key, "_month"]).select(
        "_row", F.coalesce("_found", "_carry").alias("_found")
    )
    return found.select("_row.*", "_found.*")


def grid_calendar(days: DataFrame, day: str = "as_of") -> DataFrame:
    """Calendar date → (first grid date on or after it, its index). One row per calendar date."""
    w = Window.orderBy(day)
    spans = days.select(
        day,
        F.row_number().over(w).alias("_i"),
        F.coalesce(F.date_add(F.lag(day).over(w), 1), F.to_date(F.lit(EARLIEST))).alias("_from"),
    )
    return spans.select(day, "_i", F.explode(F.sequence("_from", day)).alias("_date"))


def asof_grid(
    rows: DataFrame, keys: list[str], time: str, best: Column, days: DataFrame
) -> DataFrame:
    """For every grid date and key: the greatest `best` among the key's rows up to that date.

    Rows fall to their first grid date, are reduced there map-side, and each running maximum is
    repeated over the grid dates it stays the answer for."""
    calendar = grid_calendar(days)
    landed = (
        rows.join(F.broadcast(calendar), F.col(time) == F.col("_date"))  # calendar-sized
        .groupBy(*keys, "_i")
        .agg(F.max(best).alias("best"))
    )
    w = Window.partitionBy(*keys).orderBy("_i")
    running = landed.select(
        *keys,
        "_i",
        F.max("best").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best"),
        F.lead("_i").over(w).alias("_next"),
    )
    # Plain columns while exploding: the optimizer mishandles nested fields across a generator.
    fields = landed.schema["best"].dataType.names
    running = running.select(
        *keys, "_i", "_next", *[F.col(f"best.{f}").alias(f"_best_{f}") for f in fields]
    )
    dates = calendar.select("as_of", "_i").distinct()
    total = dates.agg(F.max("_i").alias("_total"))
    held = running.crossJoin(F.broadcast(total))  # one row: the number of grid dates
    held = held.withColumn(
        "_i", F.explode(F.sequence("_i", F.coalesce(F.col("_next") - 1, F.col("_total"))))
    )
    best = F.struct(*[F.col(f"_best_{f}").alias(f) for f in fields]).alias("best")
    return held.join(F.broadcast(dates), "_i").select("as_of", *keys, best)


def month_ends(first: Column, last: Column) -> Column:
    """Array of complete month ends from the first day's month through `last`."""
    ends = F.transform(
        F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")),
        lambda d: F.last_day(d),
    )
    return F.filter(ends, lambda d: d <= last)


def period_ends(rows: DataFrame, day: str, every: int = 1) -> DataFrame:
    """Month ends (or every n-th month of the year) spanned by a table's days."""
    span = rows.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    ends = span.select(F.explode(month_ends(F.col("a"), F.col("b"))).alias("as_of"))
    return ends.where(F.month("as_of") % every == 0)


def align(left: DataFrame, right: DataFrame, key: str, *, level: bool = False) -> DataFrame:
    """Returns of two series between consecutive shared days.

    `right` holds one row per day. A level series contributes its change, not a return."""
    shared = left.select(key, "trade_date", F.col("close").alias("a")).join(
        F.broadcast(right.select("trade_date", F.col("close").alias("b"))), "trade_date"
    )
    w = Window.partitionBy(key).orderBy("trade_date")
    pairs = shared.withColumn("a0", F.lag("a").over(w)).withColumn("b0", F.lag("b").over(w))
    usable = F.col("a0") > 0 if level else (F.col("a0") > 0) & (F.col("b0") > 0)
    move = F.col("b") - F.col("b0") if level else F.col("b") / F.col("b0") - 1
    return pairs.where(usable).select(
        key, "trade_date", (F.col("a") / F.col("a0") - 1).alias("ret"), move.alias("bench_ret")
    )


def last_before(
    rows: DataFrame, keys: list[str], day: str, order: list[str], value: Column, name: str
) -> DataFrame:
    """The greatest non-null `value` among a key's earlier rows, ordered by day and `order`.

    Keys are cut into months that carry their maximum forward, so a hot key is spread over time.
    `value` must rise with the order (a date first)."""
    cut = rows.withColumn("_value", value).withColumn("_month", F.trunc(day, "month"))
    months = cut.groupBy(*keys, "_month").agg(F.max("_value").alias("_best"))
    earlier = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    carry = months.select(*keys, "_month", F.max("_best").over(earlier).alias("_carry"))
    inside = (
        Window.partitionBy(*keys, "_month").orderBy(day, *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.withColumn("_local", F.max("_value").over(inside))
    return (
        local.join(carry, [*keys, "_month"])
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_value", "_month", "_local", "_carry")
    )

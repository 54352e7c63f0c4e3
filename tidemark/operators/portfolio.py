"""Portfolio backtests as table operators, and performance statistics of daily value series.

Weights are held from the first trading day after a signal to the next one. Costs are taken at a
stated capital, not along the path of the portfolio's value, so they differ from an order-by-order
simulation. A value series has one row per trading day: its windows are calendar-bounded.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tidemark.operators.asof import asof_join

PERIODS = 252
STALE_POSITIONS = 10
EULER = 0.5772156649015329
# Default trading costs.
COSTS = {
    "commission_per_share": 0.005, "min_commission": 1.0, "spread_fallback": 0.0010,
    "spread_cap": 0.02, "impact_coefficient": 0.5, "max_participation": 0.10,
}


def holding_spans(signals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per signal date: the trading day it takes effect (the next one, however far) and the day the next signal does."""
    days = calendar.select(F.col("trade_date").alias("day"), "trade_date", F.lit(None).cast("date").alias("as_of"))
    dates = signals.select(F.date_add("as_of", 1).alias("day"), F.lit(None).cast("date").alias("trade_date"), "as_of").distinct()
    onward = Window.orderBy(F.desc("day")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # one row per day
    marks = days.unionByName(dates).withColumn("start", F.min("trade_date").over(onward))
    starts = marks.where("as_of is not null and start is not null").select("as_of", "start")
    w = Window.orderBy("as_of")  # one row per rebalance
    return starts.withColumn("next_start", F.lead("start").over(w))


def holdings(weights: DataFrame, calendar: DataFrame) -> DataFrame:
    """Target weights with the interval they are held in."""
    return weights.join(F.broadcast(holding_spans(weights, calendar)), "as_of")  # rebalance dates


def numbered(calendar: DataFrame) -> DataFrame:
    w = Window.orderBy("trade_date")  # one row per trading day
    return calendar.select("trade_date", F.row_number().over(w).cast("bigint").alias("position"))


def stale_exits(held: DataFrame, bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Holdings whose last bar lies at least ten trading days before the next rebalance: they are
    sold there at that last close."""
    days = F.broadcast(numbered(calendar))
    ends = held.where(F.col("next_start").isNotNull())
    last = asof_join(ends, bars, "security_id", "next_start", "trade_date", ["close"])
    placed = last.join(
        days.select(F.col("trade_date").alias("next_start"), F.col("position").alias("_now")), "next_start"
    ).join(days.select(F.col("trade_date").alias("asof_day"), F.col("position").alias("_last")), "asof_day")
    return placed.where(F.col("_now") - F.col("_last") >= STALE_POSITIONS).select(
        "as_of", "security_id", F.col("next_start").alias("exit_day"),
        F.col("asof_day").alias("last_bar"), F.col("close").alias("exit_price"),
    )


def nav(held: DataFrame, indexed: DataFrame, calendar: DataFrame, capital: float) -> DataFrame:
    """Daily portfolio value: drifting weights inside a holding span, spans chained at the open of
    each rebalance day. A name without a bar on the day it should be bought stays cash."""
    days = numbered(calendar)
    bars = indexed.select(
        "security_id", "trade_date", "idx",
        (F.col("idx") * F.col("open") / F.col("close")).alias("open_idx"),
    )
    entry = bars.select(
        "security_id", F.col("trade_date").alias("start"), F.col("open_idx").alias("base")
    )
    bought = held.join(entry, ["security_id", "start"])
    span = bought.join(
        F.broadcast(days.select(F.col("trade_date").alias("start"), F.col("position").alias("_a"))), "start"
    ).join(
        F.broadcast(days.select(F.col("trade_date").alias("next_start"), F.col("position").alias("_b"))),
        "next_start", "left",
    )
    total = days.agg(F.max("position").alias("_total"))
    span = span.crossJoin(F.broadcast(total)).withColumn(
        "position", F.explode(F.sequence("_a", F.coalesce("_b", "_total")))
    )  # one row of totals
    grid = span.join(F.broadcast(days), "position").select(
        "as_of", "security_id", "weight", "base", "start", "next_start", F.col("trade_date").alias("day")
    )
    level = asof_join(grid, bars, "security_id", "day", "trade_date", ["idx", "open_idx"])
    at_close = F.col("idx")
    boundary = F.col("day") == F.col("next_start")
    at_open = F.when(F.col("asof_day") == F.col("day"), F.col("open_idx")).otherwise(F.col("idx"))
    held_value = F.when(boundary, at_open).otherwise(at_close) / F.col("base")
    per_day = level.groupBy("as_of", "start", "next_start", "day").agg(
        F.sum("weight").alias("_invested"), F.sum(F.col("weight") * held_value).alias("_value")
    ).withColumn("value", F.col("_value") + 1 - F.col("_invested"))
    ends = per_day.where(F.coalesce(F.col("day") == F.col("next_start"), F.lit(False)))
    before = Window.orderBy("as_of").rowsBetween(Window.unboundedPreceding, -1)  # rebalances
    spans = per_day.select("as_of").distinct().join(ends.select("as_of", F.col("value").alias("_end")), "as_of", "left")
    chain = spans.select("as_of", F.coalesce(F.product("_end").over(before), F.lit(1.0)).alias("_chain"))
    inside = per_day.where(F.col("next_start").isNull() | (F.col("day") < F.col("next_start")))
    return inside.join(F.broadcast(chain), "as_of").select(
        "day", "as_of", (F.col("value") * F.col("_chain") * F.lit(capital)).alias("nav")
    )


def weight_changes(weights: DataFrame) -> DataFrame:
    """Target weight against the previous rebalance's, including names sold to zero."""
    dates = weights.select("as_of").distinct()
    order = dates.select("as_of", F.lead("as_of").over(Window.orderBy("as_of")).alias("_next"))
    old = weights.join(F.broadcast(order), "as_of").where(F.col("_next").isNotNull()).select(
        F.col("_next").alias("as_of"), "security_id", F.col("weight").alias("before")
    )
    both = weights.join(old, ["as_of", "security_id"], "full_outer")
    zero = F.lit(0.0)
    return both.select(
        "as_of", "security_id", F.coalesce("weight", zero).alias("weight"),
        F.coalesce("before", zero).alias("before"),
        (F.coalesce("weight", zero) - F.coalesce("before", zero)).alias("change"),
    )


def turnover(weights: DataFrame) -> DataFrame:
    """One-way turnover per rebalance; the first (from cash) is marked and left out of averages."""
    changed = weight_changes(weights).groupBy("as_of").agg(
        (F.sum(F.abs("change")) / 2).alias("turnover")
    )
    first = F.row_number().over(Window.orderBy("as_of")) == 1
    return changed.withColumn("is_first", first)


def order_costs(changes: DataFrame, liquidity: DataFrame, capital: float, costs=COSTS) -> DataFrame:
    """Commission, half spread and impact of each weight change at a stated capital.

    `changes` carries start (the trade day) and price; `liquidity` adv, daily_vol, avg_spread."""
    value = F.abs("change") * F.lit(capital)
    rows = changes.join(
        liquidity.select("security_id", F.col("trade_date").alias("start"), "adv", "daily_vol", "avg_spread", "open"),
        ["security_id", "start"],
    ).withColumn("value", value).where(F.col("value") > 0)
    rows = rows.withColumn("shares", F.col("value") / F.col("open"))
    spread = F.when(F.col("avg_spread") > 0, F.col("avg_spread")).otherwise(F.lit(costs["spread_fallback"]))
    impact = F.lit(costs["impact_coefficient"]) * F.col("daily_vol") * F.sqrt(F.col("value") / F.col("adv")) * F.col("value")
    return rows.select(
        "as_of", "security_id", "start", "value", "shares",
        F.greatest(F.lit(costs["min_commission"]), F.lit(costs["commission_per_share"]) * F.col("shares")).alias("commission"),
        (F.least(spread, F.lit(costs["spread_cap"])) / 2 * F.col("value")).alias("spread_cost"),
        F.coalesce(F.when((F.col("adv") > 0) & (F.col("daily_vol") > 0), impact), F.lit(0.0)).alias("impact_cost"),
        F.coalesce(F.col("value") > F.col("adv") * costs["max_participation"], F.lit(False)).alias("capped"),
    )


def benchmark_level(bench_indexed: DataFrame, first_day: Column, capital: float) -> DataFrame:
    """Benchmark total-return level, re-based to the capital at its first day."""
    rows = bench_indexed.where(F.col("trade_date") >= first_day)
    base = F.first("idx").over(
        Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return rows.select("trade_date", (F.col("idx") / base * F.lit(capital)).alias("level"))


def equal_weights(eligible: DataFrame) -> DataFrame:
    """Equal weight of everything eligible on each date."""
    sizes = eligible.groupBy("as_of").agg(F.count(F.lit(1)).alias("_n"))
    return eligible.join(sizes, "as_of").select(
        "as_of", "security_id", (1 / F.col("_n")).alias("weight")
    )


def daily_risk_free(rates: DataFrame) -> DataFrame:
    """Daily rate from a yearly percentage: (1 + rate)^(1/252) − 1."""
    return rates.withColumn("rf", F.pow(1 + F.col("value") / 100, F.lit(1 / PERIODS)) - 1)


# --- Performance --------------------------------------------------------------------------


def _by(key: str):
    return Window.partitionBy(key).orderBy("day")


def curve_returns(curve: DataFrame, key: str = "strategy") -> DataFrame:
    """Daily simple, excess and active returns of (day, value, bench, rf) rows."""
    w = _by(key)
    step = lambda c: F.when(F.lag(c).over(w) > 0, F.col(c) / F.lag(c).over(w) - 1).when(
        F.lag(c).over(w).isNotNull(), 0.0
    )
    rows = curve.withColumn("r", step("value")).withColumn("rb", step("bench"))
    return rows.select(
        "*", (F.col("r") - F.col("rf")).alias("x"), (F.col("rb") - F.col("rf")).alias("xb"),
        (F.col("r") - F.col("rb")).alias("a"),
    )


def drawdown_stats(curve: DataFrame, key: str = "strategy") -> DataFrame:
    """Deepest fall with its peak and trough days, and the longest time below a high."""
    w = _by(key)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("_peak", F.max("value").over(so_far))
    high = F.when(F.col("value") >= F.col("_peak"), F.col("day"))
    rows = rows.withColumn("_peak_day", F.last(high, ignorenulls=True).over(so_far))
    fall = F.when(F.col("_peak") > 0, F.col("value") / F.col("_peak") - 1).otherwise(0.0)
    rows = rows.withColumn("_dd", fall)
    worst = F.min(F.struct("_dd", "day", "_peak_day")).alias("_w")
    longest = F.max(F.datediff("day", "_peak_day")).alias("longest_drawdown_days")
    return rows.groupBy(key).agg(worst, longest).select(
        key, F.col("_w._dd").alias("max_drawdown"), F.col("_w._peak_day").alias("peak_day"),
        F.col("_w.day").alias("trough_day"), "longest_drawdown_days",
    )


def moments(rows: DataFrame, column: str, key: str = "strategy") -> DataFrame:
    """Skewness and kurtosis with division by n and the sample deviation (normal: 0 and 3)."""
    stats = rows.groupBy(key).agg(
        F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"), F.count(column).alias("_n")
    )
    z = F.try_divide(F.col(column) - F.col("_m"), F.col("_s"))
    joined = rows.where(F.col(column).isNotNull()).join(stats, key)  # one row per strategy: saved runs grow
    usable = (F.first("_n") >= 3) & (F.first("_s") > 0)
    return joined.groupBy(key).agg(
        F.when(usable, F.sum(F.pow(z, 3)) / F.first("_n")).otherwise(0.0).alias("skew"),
        F.when(usable, F.sum(F.pow(z, 4)) / F.first("_n")).otherwise(3.0).alias("kurtosis"),
    )


def summary(curve: DataFrame, key: str = "strategy") -> DataFrame:
    """One row of statistics per strategy."""
    rows = curve_returns(curve, key)
    root = math.sqrt(PERIODS)
    down = F.least(F.col("x"), F.lit(0.0))
    base = rows.groupBy(key).agg(
        F.min("day").alias("start"), F.max("day").alias("end"),
        F.min_by("value", "day").alias("_v0"), F.max_by("value", "day").alias("_v1"),
        F.count("x").alias("n"), F.avg("x").alias("_mx"), F.stddev_samp("x").alias("_sx"),
        F.stddev_samp("r").alias("_sr"), F.avg("xb").alias("_mb"), F.var_samp("xb").alias("_vb"),
        F.covar_samp("x", "xb").alias("_cov"), F.avg("a").alias("_ma"), F.stddev_samp("a").alias("_sa"),
        F.sqrt(F.avg(down * down)).alias("_down"),
    )
    own = moments(rows, "x", key)
    active = moments(rows, "a", key).toDF(key, "active_skew", "active_kurtosis")
    joined = base.join(own, key).join(active, key).join(drawdown_stats(curve, key), key)
    years = F.datediff("end", "start") / 365.25
    beta = F.when(F.col("_vb") > 0, F.col("_cov") / F.col("_vb"))
    cagr = F.when((years > 0) & (F.col("_v0") > 0), F.pow(F.col("_v1") / F.col("_v0"), 1 / years) - 1)
    joined = joined.withColumn("years", years).withColumn("cagr", cagr).withColumn("beta", beta)
    return joined.select(
        key, "start", "end", "years", "n", (F.col("_v1") / F.col("_v0") - 1).alias("total_return"), "cagr",
        (F.col("_sr") * root).alias("volatility"),
        F.when(F.col("_sx") > 0, F.col("_mx") / F.col("_sx") * root).otherwise(0.0).alias("sharpe"),
        F.when(F.col("_down") > 0, F.col("_mx") / F.col("_down") * root).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"),
        "beta", ((F.col("_mx") - F.col("beta") * F.col("_mb")) * PERIODS).alias("alpha"),
        (F.col("_sa") * root).alias("tracking_error"),
        F.when(F.col("_sa") > 0, F.col("_ma") / F.col("_sa") * root).alias("information_ratio"),
        "skew", "kurtosis", F.when(F.col("_sa") > 0, F.col("_ma") / F.col("_sa")).alias("active_sharpe_daily"),
        "active_skew", "active_kurtosis", "max_drawdown", "peak_day", "trough_day", "longest_drawdown_days",
    )


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    cdf = NormalDist().cdf
    return x.map(lambda v: None if pd.isna(v) else cdf(v))


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return p.map(lambda v: inverse(v) if 0 < v < 1 else None)


def probabilistic_sharpe(threshold: Column | float = 0.0) -> Column:
    """Probability that the true active Sharpe ratio exceeds the threshold, from summary columns."""
    s, n = F.col("active_sharpe_daily"), F.col("n")
    spread = 1 - F.col("active_skew") * s + (F.col("active_kurtosis") - 1) / 4 * s * s
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    score = F.when((n >= 3) & (spread > 0), (s - limit) * F.sqrt(n - 1) / F.sqrt(spread))
    return normal_cdf(score)


def expected_max_sharpe(trials: Column, variance: Column) -> Column:
    """Best Sharpe ratio expected of unskilled trials."""
    first = normal_quantile((1 - 1 / trials).cast("double"))
    second = normal_quantile((1 - 1 / (trials * math.e)).cast("double"))
    best = F.sqrt(variance) * ((1 - EULER) * first + EULER * second)
    return F.coalesce(F.when((trials >= 2) & (variance > 0), best), F.lit(0.0))


def trials(runs: DataFrame, start, end) -> DataFrame:
    """Earlier runs over an overlapping period: one more than their count, and their variance."""
    day = lambda d: F.lit(d).cast("date")
    near = runs.where(
        F.col("active_sharpe_daily").isNotNull() & (F.col("start") <= day(end)) & (F.col("end") >= day(start))
    )
    return near.groupBy("owner").agg(
        (F.count(F.lit(1)) + 1).alias("trials"),
        F.coalesce(F.var_samp("active_sharpe_daily"), F.lit(0.0)).alias("variance"),
    )


def period_returns(curve: DataFrame, unit: str, key: str = "strategy") -> DataFrame:
    """Calendar month or year returns from end-of-period values (the first from the first value)."""
    label = F.date_format("day", "yyyy-MM" if unit == "month" else "yyyy")
    first = curve.groupBy(key).agg(F.min_by("value", "day").alias("_v0"), F.min_by("bench", "day").alias("_b0"))
    ends = curve.groupBy(key, label.alias("period")).agg(
        F.max_by("value", "day").alias("value"), F.max_by("bench", "day").alias("bench")
    )
    w = Window.partitionBy(key).orderBy("period")
    rows = ends.join(first, key)  # one row per strategy
    return rows.select(
        key, "period",
        (F.col("value") / F.coalesce(F.lag("value").over(w), "_v0") - 1).alias("ret"),
        (F.col("bench") / F.coalesce(F.lag("bench").over(w), "_b0") - 1).alias("bench_ret"),
    )


def hit_rate(months: DataFrame, key: str = "strategy") -> DataFrame:
    return months.groupBy(key).agg(
        F.avg((F.col("ret") > F.col("bench_ret")).cast("double")).alias("hit_rate")
    )


def rolling_excess(curve: DataFrame, size: int = 252, step: int = 5, key: str = "strategy") -> DataFrame:
    w = _by(key)
    rows = curve.withColumn("_i", F.row_number().over(w) - 1)
    own = F.col("value") / F.lag("value", size).over(w) - 1
    market = F.col("bench") / F.lag("bench", size).over(w) - 1
    rows = rows.withColumn("excess", own - market)
    return rows.where((F.col("_i") >= size) & ((F.col("_i") - size) % step == 0)).select(key, "day", "excess")


def by_year(rows: DataFrame, day: str, value: str) -> DataFrame:
    return rows.groupBy(F.year(day).cast("bigint").alias("year")).agg(F.sum(value).alias("total"))


def latest_holdings(held: DataFrame, names: DataFrame) -> DataFrame:
    """The newest rebalance's positions with names, largest first."""
    newest = held.agg(F.max("as_of").alias("as_of"))
    return held.join(F.broadcast(newest), "as_of", "left_semi").join(names, "security_id", "left").orderBy(
        F.desc("weight"), "security_id"
    )  # one row


def run_options(scores: DataFrame, universe: DataFrame) -> DataFrame:
    """First and last signal, and the latest universe's size."""
    span = scores.agg(F.min("as_of").alias("first_signal"), F.max("as_of").alias("last_signal"))
    sizes = universe.groupBy("as_of").agg(F.count(F.lit(1)).alias("n"))
    size = sizes.agg(F.max_by("n", "as_of").alias("universe_size"))
    return span.crossJoin(size)  # one row each

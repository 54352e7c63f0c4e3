"""Returns, risk and technical indicators on daily bars.

Input bars have one row per (security, day), so a security's window holds at most its trading
days: bounded by the calendar, whatever the number of trades behind the bars. The benchmark is
one row per day; it is broadcast only because the calendar bounds it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRADING_DAYS = 252
CRYPTO_DAYS = 365


def timeline(key: str = "security_id") -> Window:
    return Window.partitionBy(key).orderBy("trade_date")


def last_rows(window, size: int):
    return window.rowsBetween(-(size - 1), 0)


def full(value: Column, counted: Column, window, size: int) -> Column:
    """A trailing statistic over `size` rows, null until all of them are present."""
    frame = last_rows(window, size)
    return F.when(F.count(counted).over(frame) == size, value.over(frame))


def returns(bars: DataFrame, key: str = "security_id") -> DataFrame:
    """Total return into each bar: (close + dividend) × split ÷ previous close − 1."""
    w = timeline(key)
    previous = F.lag("close").over(w)
    dividend = F.coalesce(F.col("dividend_cash"), F.lit(0.0))
    split = F.coalesce(F.col("split_factor"), F.lit(1.0))
    return bars.select(
        "*",
        F.row_number().over(w).cast("bigint").alias("n"),
        F.lag("trade_date").over(w).alias("prev_date"),
        previous.alias("prev_close"),
    ).withColumn(
        "ret",
        F.when(F.col("prev_close").isNull(), F.lit(None))
        .when(F.col("prev_close") > 0, (F.col("close") + dividend) * split / F.col("prev_close") - 1)
        .otherwise(F.lit(0.0)),
    )


def growth_index(rets: DataFrame, key: str = "security_id") -> DataFrame:
    """Value of 1 invested at the first bar."""
    frame = timeline(key).rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(1 + F.col("ret"), F.lit(1.0))
    return rets.withColumn("idx", F.product(step).over(frame))


def benchmark_returns(bench: DataFrame) -> DataFrame:
    """Daily benchmark rows with returns (one row per day, so an unpartitioned window is small)."""
    w = Window.orderBy("trade_date")
    return bench.select(
        "trade_date",
        "close",
        F.row_number().over(w).cast("bigint").alias("n"),
        (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"),
    )


def sma(bars: DataFrame, size: int, value: str = "close", key: str = "security_id") -> DataFrame:
    mean = full(F.avg(value), F.col(value), timeline(key), size)
    return bars.withColumn("sma", mean)


def _seeded(values: np.ndarray, size: int, alpha: float) -> np.ndarray:
    """Exponential average of `values`, started by the mean of the first `size`."""
    out = np.full(len(values), np.nan)
    if len(values) >= size:
        chain = np.concatenate([[values[:size].mean()], values[size:]])
        out[size - 1 :] = pd.Series(chain).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out


def _ema(values: np.ndarray, size: int) -> np.ndarray:
    return _seeded(values, size, 2 / (size + 1))


def _rsi(values: np.ndarray, size: int) -> np.ndarray:
    change = np.diff(values)
    gain = _seeded(np.maximum(change, 0), size, 1 / size)
    loss = _seeded(np.maximum(-change, 0), size, 1 / size)
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = 100 - 100 / (1 + gain / loss)
    flat = np.where(gain > 0, 100.0, 50.0)
    index = np.where(np.isnan(loss), np.nan, np.where(loss == 0, flat, strength))
    return np.concatenate([[np.nan], index]) if len(values) else index


def _per_security(bars: DataFrame, compute, columns: list[str], key: str) -> DataFrame:
    """Run an ordered recursion per security over its (key, day, value) rows."""
    kind = bars.schema[key].dataType.simpleString()
    fields = ", ".join(f"{c} double" for c in columns)
    rows = bars.select(key, "trade_date", F.col("value").cast("double").alias("value"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("trade_date")
        computed = compute(frame["value"].to_numpy())
        found = pd.DataFrame(dict(zip(columns, computed)), index=frame.index)
        found = found.astype(object).where(found.notna(), None)
        return pd.concat([frame, found], axis=1)

    schema = f"{key} {kind}, trade_date date, value double, {fields}"
    return rows.groupBy(key).applyInPandas(run, schema)


def ema(bars: DataFrame, size: int, value: str = "close", key: str = "security_id") -> DataFrame:
    """Exponential average with weight 2/(size+1), seeded by the first simple average."""
    named = bars.withColumn("value", F.col(value))
    return _per_security(named, lambda v: [_ema(v, size)], ["ema"], key)


def rsi(bars: DataFrame, size: int = 14, value: str = "close", key: str = "security_id") -> DataFrame:
    """Wilder's relative strength index; 100 (or 50 when flat) where there are no losses."""
    named = bars.withColumn("value", F.col(value))
    return _per_security(named, lambda v: [_rsi(v, size)], ["rsi"], key)


def _macd(values: np.ndarray, fast: int, slow: int, signal: int) -> list[np.ndarray]:
    line = _ema(values, fast) - _ema(values, slow)
    start = min(max(fast, slow) - 1, len(line))
    smoothed = np.concatenate([np.full(start, np.nan), _ema(line[start:], signal)])
    return [line, smoothed, line - smoothed]


def macd(
    bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, value: str = "close",
    key: str = "security_id",
) -> DataFrame:
    named = bars.withColumn("value", F.col(value))
    return _per_security(
        named, lambda v: _macd(v, fast, slow, signal), ["macd", "signal", "histogram"], key
    )


def oscillators(bars: DataFrame, value: str = "close", key: str = "security_id") -> DataFrame:
    """RSI(14) and MACD(12, 26, 9) in one pass over each security."""
    named = bars.withColumn("value", F.col(value))
    return _per_security(
        named,
        lambda v: [_rsi(v, 14), *_macd(v, 12, 26, 9)],
        ["rsi", "macd", "signal", "histogram"],
        key,
    )


def volatility(rets: DataFrame, periods: int = TRADING_DAYS, key: str = "security_id") -> DataFrame:
    """Sample deviation of returns and its annualised value, per security."""
    return rets.groupBy(key).agg(F.stddev_samp("ret").alias("stdev")).withColumn(
        "ann_vol", F.col("stdev") * math.sqrt(periods)
    )


def rolling_volatility(
    rets: DataFrame, size: int, periods: int = TRADING_DAYS, key: str = "security_id"
) -> DataFrame:
    deviation = full(F.stddev_samp("ret"), F.col("ret"), timeline(key), size)
    return rets.withColumn("rolling_vol", deviation * math.sqrt(periods))


def drawdown(rows: DataFrame, value: str = "idx", key: str = "security_id") -> DataFrame:
    """Fall from the running peak; 0 at a new high."""
    peak = F.max(value).over(timeline(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("peak", peak).withColumn(
        "drawdown", F.when(F.col("peak") > 0, F.col(value) / F.col("peak") - 1).otherwise(0.0)
    )


def max_drawdown(rows: DataFrame, value: str = "idx", key: str = "security_id") -> DataFrame:
    return drawdown(rows, value, key).groupBy(key).agg(F.min("drawdown").alias("max_drawdown"))


def period_return(rows: DataFrame, back: int, value: str = "idx", key: str = "security_id") -> DataFrame:
    base = F.lag(value, back).over(timeline(key))
    return rows.withColumn("period_return", F.when(base > 0, F.col(value) / base - 1))


PANEL = (("1d", 1), ("1w", 5), ("1m", 21), ("3m", 63), ("1y", 252), ("3y", 756))


def return_panel(indexed: DataFrame, key: str = "security_id") -> DataFrame:
    """Returns to the last bar over the panel's spans and the year to date, per security."""
    whole = Window.partitionBy(key)
    rows = indexed.withColumn("total", F.max("n").over(whole)).withColumn(
        "last_year", F.max(F.year("trade_date")).over(whole)
    )
    now = F.max(F.when(F.col("n") == F.col("total"), F.col("idx")))
    spans = [
        F.max(F.when(F.col("n") == F.col("total") - back, F.col("idx"))).alias(f"base_{name}")
        for name, back in PANEL
    ]
    before = F.year("trade_date") < F.col("last_year")
    ytd = F.max_by(F.when(before, F.col("idx")), F.when(before, F.col("trade_date")))
    bases = rows.groupBy(key).agg(
        F.max("trade_date").alias("as_of"), now.alias("now"), *spans, ytd.alias("base_ytd")
    )
    names = [name for name, _ in PANEL] + ["ytd"]
    return bases.select(
        key,
        "as_of",
        *[
            F.when(F.col(f"base_{n}") > 0, F.col("now") / F.col(f"base_{n}") - 1).alias(f"ret_{n}")
            for n in names
        ],
    )


def with_benchmark(rets: DataFrame, bench: DataFrame) -> DataFrame:
    """Pair each return with the benchmark's return of the day, where both exist.

    `bench` has one row per trading day, a size the calendar bounds."""
    daily = bench.select("trade_date", F.col("ret").alias("bench_ret"))
    return rets.join(F.broadcast(daily), "trade_date").where(
        F.col("ret").isNotNull() & F.col("bench_ret").isNotNull()
    )


def correlation_beta(paired: DataFrame, key: str = "security_id") -> DataFrame:
    """Correlation and beta per security; null under three pairs or without variance."""
    usable = (F.count(F.lit(1)) >= 3) & (F.var_pop("bench_ret") > 0)
    varied = usable & (F.var_pop("ret") > 0)
    return paired.groupBy(key).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.when(varied, F.corr("ret", "bench_ret")).alias("correlation"),
        F.when(usable, F.covar_pop("ret", "bench_ret") / F.var_pop("bench_ret")).alias("beta"),
    )


def rolling_relation(paired: DataFrame, size: int, key: str = "security_id") -> DataFrame:
    """Rolling correlation and beta over `size` paired rows."""
    w = timeline(key)
    pairs = F.col("ret")
    return paired.withColumn(
        "rolling_corr", full(F.corr("ret", "bench_ret"), pairs, w, size)
    ).withColumn("rolling_beta", full(F.regr_slope("ret", "bench_ret"), pairs, w, size))


def thin(rows: DataFrame, step: int, key: str = "security_id") -> DataFrame:
    """Every step-th point per security, and always the last."""
    rank = F.row_number().over(timeline(key))
    final = F.lead("trade_date").over(timeline(key)).isNull()
    return (
        rows.withColumn("_rank", rank).withColumn("_final", final)
        .where(((F.col("_rank") - 1) % step == 0) | F.col("_final"))
        .drop("_rank", "_final")
    )


def weekly_beta(bars: DataFrame, bench: DataFrame, minimum: int = 52) -> DataFrame:
    """Beta of weekly log returns: every fifth shared day of the last 505, and its Blume form."""
    shared = bars.select("security_id", "trade_date", "close").join(
        F.broadcast(bench.select("trade_date", F.col("close").alias("market"))), "trade_date"
    )
    newest = Window.partitionBy("security_id").orderBy(F.desc("trade_date"))
    recent = shared.withColumn("_back", F.row_number().over(newest)).where("_back <= 505")
    w = timeline()
    weekly = recent.withColumn("_rank", F.row_number().over(w)).where("(_rank - 1) % 5 = 0")
    pairs = weekly.select(
        "security_id", "trade_date",
        F.lag("trade_date").over(w).alias("_from"),
        F.lag("close").over(w).alias("_close"), F.lag("market").over(w).alias("_market"),
        "close", "market",
    ).where("_close > 0 and close > 0 and _market > 0 and market > 0")
    logs = pairs.withColumn("s", F.ln(F.col("close") / F.col("_close"))).withColumn(
        "m", F.ln(F.col("market") / F.col("_market"))
    )
    fit = logs.groupBy("security_id").agg(
        F.count(F.lit(1)).alias("weeks"),
        F.min("_from").alias("first_day"),
        F.max("trade_date").alias("last_day"),
        F.covar_samp("s", "m").alias("_cov"),
        F.var_samp("m").alias("_var"),
    )
    return (
        fit.where((F.col("weeks") >= minimum) & (F.col("_var") > 0))
        .withColumn("raw", F.col("_cov") / F.col("_var"))
        .withColumn("adjusted", 0.67 * F.col("raw") + 0.33)
        .drop("_cov", "_var")
    )


# --- Liquidity ----------------------------------------------------------------------------

_K = 3 - 2 * math.sqrt(2)


def daily_spread(rets: DataFrame) -> DataFrame:
    """Two-day high–low spread estimate into each bar, with the overnight-gap shift.

    Null on split days and where a range is not usable."""
    w = timeline()
    rows = rets.select(
        "*", F.lag("high").over(w).alias("_h1"), F.lag("low").over(w).alias("_l1")
    ).withColumn(
        "_gap",
        F.when(F.col("low") > F.col("prev_close"), F.col("prev_close") - F.col("low"))
        .when(F.col("high") < F.col("prev_close"), F.col("prev_close") - F.col("high"))
        .otherwise(0.0),
    )
    h2, l2 = F.col("high") + F.col("_gap"), F.col("low") + F.col("_gap")
    usable = (
        (F.col("split_factor") == 1.0)
        & (F.least("_h1", "_l1", "high", "low") > 0)
        & (F.col("_h1") >= F.col("_l1"))
        & (F.col("high") >= F.col("low"))
        & F.col("prev_close").isNotNull()
        & (l2 > 0)
    )
    beta = F.pow(F.ln(F.col("_h1") / F.col("_l1")), 2) + F.pow(F.ln(h2 / l2), 2)
    gamma = F.pow(F.ln(F.greatest(F.col("_h1"), h2) / F.least(F.col("_l1"), l2)), 2)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / _K - F.sqrt(gamma / _K)
    spread = F.greatest(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), F.lit(0.0))
    return rows.withColumn("spread", F.when(usable, spread)).drop("_h1", "_l1", "_gap")


def average_spread(rets: DataFrame) -> DataFrame:
    return daily_spread(rets).groupBy("security_id").agg(F.avg("spread").alias("spread"))


def trailing_liquidity(rets: DataFrame, size: int = 21) -> DataFrame:
    """Dollar volume, daily volatility and spread over the `size` bars before each day."""
    rows = daily_spread(rets)
    before = timeline().rowsBetween(-size, -1)
    known = F.col("n") > 3
    adv = F.avg(F.col("close") * F.col("volume")).over(before)
    return (
        rows.withColumn("adv", F.when(known & (adv > 0), adv))
        .withColumn("daily_vol", F.when(known, F.stddev_samp("ret").over(before)))
        .withColumn("avg_spread", F.when(known, F.avg("spread").over(before)))
    )


# --- Month-end features -------------------------------------------------------------------


def rsi_of_last(size: int, window: int) -> list[float]:
    """Weights that give Wilder's average over the last `size` closes as one weighted sum."""
    changes = size - 1
    keep = (window - 1) / window
    seed = keep ** (changes - window) / window
    return [seed] * window + [keep ** (changes - 1 - j) / window for j in range(window, changes)]


def price_features(indexed: DataFrame, bench: DataFrame, minimum_bars: int = 253) -> DataFrame:
    """Ten price features per security at each month end with a bar in the week before it.

    Trailing statistics are windows on every bar; the drawdown inside the last year slices the
    security's own (calendar-bounded) index, at month ends only."""
    w = timeline()
    daily = F.broadcast(bench.select("trade_date", F.col("ret").alias("bench_ret")))
    rows = indexed.join(daily, "trade_date", "left")
    year = last_rows(w, 252)
    paired = F.when(F.col("bench_ret").isNotNull(), F.col("ret"))
    change = F.col("close") - F.col("prev_close")
    month = F.last_day("trade_date")
    rows = rows.select(
        "security_id", "trade_date", "n", "close", "idx",
        month.alias("as_of"),
        (F.lead(month).over(w).isNull() | (F.lead(month).over(w) != month)).alias("_month_last"),
        F.lag("idx", 21).over(w).alias("_i21"), F.lag("idx", 63).over(w).alias("_i63"),
        F.lag("idx", 126).over(w).alias("_i126"), F.lag("idx", 252).over(w).alias("_i252"),
        full(F.stddev_samp("ret"), F.col("ret"), w, 21).alias("_sd21"),
        full(F.stddev_samp("ret"), F.col("ret"), w, 63).alias("_sd63"),
        full(F.avg("close"), F.col("close"), w, 200).alias("_sma200"),
        F.count(paired).over(year).alias("_pairs"),
        F.regr_slope(paired, "bench_ret").over(year).alias("_slope"),
    )
    ends = rows.where(
        F.col("_month_last")
        & (F.datediff("as_of", "trade_date") <= 7)
        & (F.col("n") >= minimum_bars)
    )
    past = indexed.groupBy("security_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "idx", change.alias("change")))).alias("_past")
    )  # a security's trading days
    # a security's month ends meet its history once, and each takes its own slices with it
    own = [c for c in ends.columns if c != "security_id"]
    marks = ends.groupBy("security_id").agg(F.collect_list(F.struct(*own)).alias("_ends"))
    last = lambda e, days: F.slice("_past", F.greatest(e["n"].cast("int") - (days - 1), F.lit(1)), F.lit(days))
    slices = F.transform(
        "_ends", lambda e: F.struct(e.alias("end"), last(e, 253)["idx"].alias("_year"), last(e, 59)["change"].alias("_changes"))
    )
    ends = marks.join(past, "security_id").select("security_id", F.explode(slices).alias("s"))
    ends = ends.select("security_id", "s.end.*", "s._year", "s._changes")
    fall = F.aggregate(
        "_year",
        F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst")),
        lambda acc, v: F.struct(
            F.greatest(acc["peak"], v).alias("peak"),
            F.least(acc["worst"], v / F.greatest(acc["peak"], v) - 1).alias("worst"),
        ),
        lambda acc: acc["worst"],
    )
    weights = F.array(*[F.lit(x) for x in rsi_of_last(60, 14)])

    def smoothed(sign: int) -> Column:
        parts = F.zip_with(
            "_changes", weights, lambda c, k: F.greatest(c * sign, F.lit(0.0)) * k
        )
        return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)

    ends = ends.withColumn("_gain", smoothed(1)).withColumn("_loss", smoothed(-1))
    strength = F.when(F.col("_loss") == 0, F.when(F.col("_gain") > 0, 100.0).otherwise(50.0)).otherwise(
        100 - 100 / (1 + F.col("_gain") / F.col("_loss"))
    )
    root = math.sqrt(TRADING_DAYS)
    return ends.select(
        "security_id", "as_of", "trade_date",
        F.when(F.col("_i21") > 0, F.col("idx") / F.col("_i21") - 1).alias("mom_1m"),
        F.when(F.col("_i63") > 0, F.col("idx") / F.col("_i63") - 1).alias("mom_3m"),
        F.when(F.col("_i126") > 0, F.col("idx") / F.col("_i126") - 1).alias("mom_6m"),
        F.when(F.col("_i252") > 0, F.col("_i21") / F.col("_i252") - 1).alias("mom_12_1"),
        (F.col("_sd21") * root).alias("vol_1m"),
        (F.col("_sd63") * root).alias("vol_3m"),
        F.when(F.col("_pairs") >= 200, F.col("_slope")).alias("beta_1y"),
        fall.alias("max_drawdown_1y"),
        (F.col("close") / F.col("_sma200") - 1).alias("dist_sma200"),
        strength.alias("rsi_14"),
    )


def technicals_view(indexed: DataFrame, bench: DataFrame, years: int = 3) -> DataFrame:
    """Chart rows of the last years: adjusted close, averages, oscillators, relative strength."""
    whole = Window.partitionBy("security_id")
    newest = F.struct("trade_date", "close", "idx")
    rows = (
        indexed.withColumn("_last", F.max(newest).over(whole))
        .withColumn("_bars", F.count(F.lit(1)).over(whole))
        .where("_bars >= 60")
    )
    rows = rows.withColumn(
        "adjusted", F.col("idx") * F.col("_last.close") / F.col("_last.idx")
    )
    w = timeline()
    rows = rows.withColumn("sma_50", full(F.avg("adjusted"), F.col("adjusted"), w, 50)).withColumn(
        "sma_200", full(F.avg("adjusted"), F.col("adjusted"), w, 200)
    )
    rows = drawdown(rows, "adjusted").withColumn(
        "_first", F.date_sub(F.col("_last.trade_date"), 365 * years)
    )
    level = bench.select("trade_date", F.col("idx").alias("bench_idx"))
    rows = rows.join(F.broadcast(level), "trade_date", "left")
    shown = rows.where(F.col("trade_date") >= F.col("_first"))
    strength = F.col("idx") / F.col("bench_idx")
    base = F.first(strength, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    shown = shown.withColumn("relative", strength / base)
    swings = oscillators(rows, "adjusted").drop("value")
    return shown.join(swings, ["security_id", "trade_date"]).select(
        "security_id", "trade_date", "adjusted", "sma_50", "sma_200", "rsi", "macd", "signal",
        "drawdown", "relative",
    )


def technicals_stats(indexed: DataFrame, bench: DataFrame) -> DataFrame:
    """Latest risk figures per security: volatilities, beta, 52-week range, distance to averages."""
    whole = Window.partitionBy("security_id")
    newest = F.max(F.struct("trade_date", "close", "idx")).over(whole)
    back = Window.partitionBy("security_id").orderBy(F.desc("trade_date"))
    daily = F.broadcast(bench.select("trade_date", F.col("ret").alias("bench_ret")))
    rows = (
        indexed.withColumn("_last", newest)
        .withColumn("adjusted", F.col("idx") * F.col("_last.close") / F.col("_last.idx"))
        .join(daily, "trade_date", "left")
        .withColumn("_back", F.row_number().over(back))
    )
    recent = lambda size, value: F.when(F.col("_back") <= size, F.col(value))
    root = math.sqrt(TRADING_DAYS)
    both = (F.col("_back") <= 252) & F.col("ret").isNotNull() & F.col("bench_ret").isNotNull()
    own, market = F.when(both, F.col("ret")), F.when(both, F.col("bench_ret"))
    return rows.groupBy("security_id").agg(
        F.max("trade_date").alias("as_of"),
        (F.stddev_samp(recent(21, "ret")) * root).alias("vol_1m"),
        (F.stddev_samp(recent(63, "ret")) * root).alias("vol_3m"),
        (F.stddev_samp(recent(252, "ret")) * root).alias("vol_1y"),
        F.when(F.count(own) > 100, F.covar_pop(own, market) / F.var_pop(market)).alias("beta_1y"),
        F.max(recent(252, "adjusted")).alias("high_52w"),
        F.min(recent(252, "adjusted")).alias("low_52w"),
        (F.max(recent(1, "adjusted")) / F.avg(recent(50, "adjusted")) - 1).alias("dist_sma_50"),
        F.count(F.lit(1)).alias("bars"),
    )

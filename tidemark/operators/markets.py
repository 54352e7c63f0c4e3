"""Market views: regime, yield curves, crypto pairs, event cycles and feature snapshots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.expr import finite
from tidemark.functions.lookups import TENOR_MONTHS
from tidemark.operators import metrics as M
from tidemark.operators import prices as P
from tidemark.session import cut_lineage

STRESS_PERCENTILE, HISTORY = 0.80, 2520


#: Trading days that meet a month end together.
_BLOCK = 256


def regime(bench: DataFrame, key: str = "benchmark") -> DataFrame:
    """Trend and volatility label at each month end of a benchmark (one row per trading day).

    Uptrend: close at or over its 200-day average. Stressed: 21-day volatility above the 80th
    percentile of the trailing ten years. At least 260 bars are needed. Benchmarks are told apart by `key`, if there is one.

    A month end meets the blocks of days its ten years touch and counts the days below it there; no history is carried along."""
    one = key not in bench.columns
    rows = bench.withColumn(key, F.lit("")) if one else bench
    w = Window.partitionBy(key).orderBy("trade_date")  # a benchmark's calendar
    month = F.last_day("trade_date")
    frame = lambda n: w.rowsBetween(-(n - 1), 0)
    rows = rows.select(
        key, "trade_date", "close", "n", month.alias("as_of"),
        F.when(F.count("close").over(frame(200)) == 200, F.avg("close").over(frame(200))).alias("sma200"),
        F.when(F.count("ret").over(frame(21)) == 21, F.stddev_samp("ret").over(frame(21)) * math.sqrt(252)).alias("vol"),
        (F.lead(month).over(w).isNull() | (F.lead(month).over(w) != month)).alias("_last"),
    )
    rows = cut_lineage(rows)
    ends = rows.where(F.col("_last") & (F.col("n") >= 260))
    first = F.greatest(F.col("n") - (HISTORY - 21), F.lit(1))
    block = lambda n: F.floor(n / _BLOCK)
    reach = ends.select(
        key, F.col("n").alias("_end"), F.col("vol").alias("_vol"), first.alias("_from"),
        F.explode(F.sequence(block(first), block(F.col("n")))).alias("_block"),
    )
    days = rows.select(key, "n", "vol", block(F.col("n")).alias("_block")).where("vol is not null")
    met = reach.join(days, [key, "_block"]).where(F.col("n").between(F.col("_from"), F.col("_end")))
    share = met.groupBy(key, F.col("_end").alias("n")).agg((F.count_if(F.col("vol") <= F.col("_vol")) / F.count(F.lit(1))).alias("vol_percentile"))
    found = ends.join(share, [key, "n"], "left")
    trend = F.when(F.col("close") >= F.col("sma200"), "Uptrend").otherwise("Downtrend")
    calm = F.when(F.col("vol_percentile") > STRESS_PERCENTILE, "stressed").otherwise("calm")
    found = found.select(
        key, "as_of", F.concat(trend, F.lit(", "), calm).alias("label"), "close", "sma200", "vol",
        "vol_percentile", F.col("trade_date").alias("price_date"),
    )
    return found.drop(key) if one else found


def with_flags(regimes: DataFrame, levels: DataFrame) -> DataFrame:
    """Add the inverted-curve and tight-conditions flags. `levels`: as_of, curve, conditions."""
    return regimes.join(levels, "as_of", "left").withColumn("curve_inverted", F.col("curve") < 0).withColumn(
        "tight_conditions", F.col("conditions") > 0
    )


def yield_curve(yields: DataFrame, on: Column | None = None) -> DataFrame:
    """The newest curve (on or before a day), ordered by tenor."""
    rows = yields if on is None else yields.where(F.col("observed_on") <= on)
    months = F.create_map(*[F.lit(x) for pair in TENOR_MONTHS.items() for x in pair])
    newest = rows.agg(F.max("observed_on").alias("observed_on"))
    kept = rows.join(F.broadcast(newest), "observed_on", "left_semi")  # one row
    return kept.withColumn("months", F.try_element_at(months, F.col("tenor"))).where("months is not null").orderBy("months")


def curves(yields: DataFrame, on: Column | None = None) -> DataFrame:
    """The newest curve (on or before a day) and the one known a year before it, told apart by `curve`."""
    now = yield_curve(yields, on)
    day = now.agg(F.date_sub(F.max("observed_on"), 365).alias("_until"))
    past = yields.join(F.broadcast(day), F.col("observed_on") <= F.col("_until")).drop("_until")  # one row
    ago = yield_curve(past).withColumn("curve", F.lit("year_ago"))
    return now.withColumn("curve", F.lit("now")).unionByName(ago)


def crypto_summary(prices: DataFrame, key: str = "security_id") -> DataFrame:
    """Latest statistics per pair on calendar days: returns, volatility, peak, averages, RSI, growth."""
    whole = Window.partitionBy(key)
    newest = Window.partitionBy(key).orderBy(F.desc("trade_date"))
    w = Window.partitionBy(key).orderBy("trade_date")
    rows = P.drawdown(prices, "close", key).withColumn("_last", F.max("trade_date").over(whole)).withColumn(
        "_back", F.row_number().over(newest)
    )
    before = F.lag("close").over(w)
    rows = rows.withColumn("_r", F.when(before > 0, F.col("close") / before - 1))
    day, close = F.col("trade_date"), F.col("close")
    known = lambda cond: F.max_by(F.when(cond, close), F.when(cond, day))
    spans = {"7d": 7, "30d": 30, "90d": 90, "1y": 365, "3y": 1095}
    recent = lambda n, c: F.when(F.col("_back") <= n, F.col(c))
    root = math.sqrt(365)
    found = rows.groupBy(key).agg(
        F.max("trade_date").alias("as_of"), F.count(F.lit(1)).alias("_n"), F.max_by("close", "trade_date").alias("close"),
        F.min_by("close", "trade_date").alias("_first"), F.min("trade_date").alias("_start"),
        *[known(day <= F.date_sub("_last", d)).alias(f"_b{n}") for n, d in spans.items()],
        known(F.year(day) < F.year("_last")).alias("_bytd"),
        *[(F.stddev_samp(recent(d, "_r")) * root).alias(f"vol_{n}") for n, d in (("30d", 30), ("90d", 90), ("1y", 365))],
        F.max("close").alias("all_time_high"),
        F.max_by("drawdown", "trade_date").alias("drawdown"), F.min(recent(365, "drawdown")).alias("max_drawdown_1y"),
        F.when(F.count(F.lit(1)) >= 50, F.avg(recent(50, "close"))).alias("sma_50"),
        F.when(F.count(F.lit(1)) >= 200, F.avg(recent(200, "close"))).alias("sma_200"),
    ).where("_n >= 2")
    years = F.datediff("as_of", "_start") / 365
    strength = P.rsi(prices, 14, "close", key).groupBy(key).agg(F.max_by("rsi", "trade_date").alias("rsi_14"))
    return found.join(strength, key).select(
        key, "as_of", "close",
        *[F.when(F.col(f"_b{n}") > 0, F.col("close") / F.col(f"_b{n}") - 1).alias(f"ret_{n}") for n in (*spans, "ytd")],
        "vol_30d", "vol_90d", "vol_1y", "all_time_high", "drawdown", "max_drawdown_1y", "sma_50", "sma_200", "rsi_14",
        F.when((F.col("_first") > 0) & (years > 0), F.ln(F.col("close") / F.col("_first")) / years).alias("log_growth_per_year"),
    )


def relationship(aligned: DataFrame, size: int = 90, key: str = "security_id") -> DataFrame:
    """Correlation and beta over the last `size` shared days."""
    newest = Window.partitionBy(key).orderBy(F.desc("trade_date"))
    recent = aligned.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= size)
    return P.correlation_beta(recent, key)


def cycles(prices: DataFrame, events: DataFrame, key: str = "security_id") -> DataFrame:
    """Price path after each event until the next: one-year return, peak, days to it, fall after.

    `events` is a short list of dates (event, next_event). Skipped when the first price is more
    than a week late."""
    near = prices.join(
        F.broadcast(events), (F.col("trade_date") >= F.col("event")) & (F.col("next_event").isNull() | (F.col("trade_date") < F.col("next_event")))
    ).withColumn("_day", F.datediff("trade_date", "event"))  # a handful of dates
    w = Window.partitionBy(key, "event")
    rows = near.withColumn("_base", F.min_by("close", "trade_date").over(w)).withColumn("_first", F.min("_day").over(w))
    rows = rows.where("_first <= 7").withColumn("_multiple", F.col("close") / F.col("_base"))
    rows = rows.withColumn("_peak", F.max_by(F.struct("_multiple", "_day"), F.struct("_multiple", (-F.col("_day")).alias("d"))).over(w))
    year = F.when(F.col("_day") <= 365, F.col("_day"))
    after = F.when(F.col("_day") >= F.col("_peak._day"), F.col("_multiple"))
    return rows.groupBy(key, "event").agg(
        F.first("_base").alias("base"), F.max("_day").alias("days_observed"),
        F.when(F.max("_day") >= 365, F.max_by(F.when(year.isNotNull(), F.col("_multiple")), year) - 1).alias("return_1y"),
        F.first("_peak._multiple").alias("peak_multiple"), F.first("_peak._day").alias("days_to_peak"),
        (F.min(after) / F.first("_peak._multiple") - 1).alias("drawdown_after_peak"),
    )


def crypto_view(prices: DataFrame, key: str = "security_id", minimum: int = 400) -> DataFrame:
    """Series with averages, drawdown and RSI of pairs that have enough closes."""
    whole = Window.partitionBy(key)
    w = Window.partitionBy(key).orderBy("trade_date")
    rows = prices.withColumn("_n", F.count(F.lit(1)).over(whole)).where(F.col("_n") >= minimum)
    rows = P.drawdown(rows, "close", key)
    shown = rows.select(
        key, "trade_date", "close", "drawdown",
        P.full(F.avg("close"), F.col("close"), w, 50).alias("sma_50"),
        P.full(F.avg("close"), F.col("close"), w, 200).alias("sma_200"),
    )
    return shown.join(P.rsi(rows, 14, "close", key).drop("value"), [key, "trade_date"])


FUNDAMENTALS = (
    "revenue_growth_yoy", "revenue_cagr_3y", "eps_growth_yoy", "gross_margin", "operating_margin", "net_margin", "fcf_margin", "roe",
    "roa", "roic", "current_ratio", "debt_to_equity", "interest_coverage",
)
#: Value inputs that are one over a metric.
INVERSE = {"earnings_yield": "pe_ratio", "sales_yield": "price_to_sales", "book_to_price": "price_to_book", "ebitda_to_ev": "ev_to_ebitda"}
YIELDS = ("fcf_yield", "dividend_yield", "buyback_yield")


#: A company on a day, as one number: 100,000 days reach to the year 2243.
_DAYS = 100_000


def metrics_asof(facts: DataFrame, closes: DataFrame, days: DataFrame) -> DataFrame:
    """Latest metrics of each company on each day, from what was filed by then: as_of, company, metric, value, available.

    `closes`: company, as_of, trade_date, close (the price on the day). A company on a day goes through the metric operator as
    a company of its own, which has filed what was public on that day and nothing else."""
    on = lambda: (F.col("company") * _DAYS + F.unix_date("as_of")).cast("long")
    public = facts.join(F.broadcast(days.select("as_of")), F.col("filed_date") <= F.col("as_of"))  # a calendar
    public = public.withColumn("company", on()).drop("as_of")
    prices = closes.select(on().alias("company"), "trade_date", "close", F.lit(None).cast("double").alias("adj_close"))
    found = M.snapshot_metrics(public, prices)
    day = F.date_from_unix_date((F.col("company") % _DAYS).cast("int"))
    return found.select(day.alias("as_of"), F.floor(F.col("company") / _DAYS).alias("company"), "metric", "value", "available")


def fundamental_inputs(metrics: DataFrame) -> DataFrame:
    """Statement and value inputs per company and day, and the latest publication date among the metrics used."""
    names = (*FUNDAMENTALS, *INVERSE.values(), *YIELDS, "market_cap")
    kept = metrics.where(F.col("metric").isin(*names) & F.col("value").isNotNull())
    wide = kept.groupBy("as_of", "company").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names], F.max("available").alias("fact_used")
    )
    over = [F.when(F.col(m) != 0, 1 / F.col(m)).alias(n) for n, m in INVERSE.items()]
    cap = F.when(F.col("market_cap") > 0, F.ln("market_cap")).alias("log_market_cap")
    return wide.select("as_of", "company", *FUNDAMENTALS, *over, *YIELDS, cap, "fact_used")


def feature_snapshots(price: DataFrame, fundamental: DataFrame, macro: DataFrame, market: DataFrame) -> DataFrame:
    """Features per (company, month end) with the latest publication date used.

    Each source carries the date its inputs were public on (`<source>_used`). Raises, naming the source, when one was not public
    on the day; non-finite values become null."""
    joined = price.join(fundamental, ["as_of", "company"], "left").join(macro, "as_of", "left").join(market, "as_of", "left")
    used = [c for c in joined.columns if c.endswith("_used")]
    names = [c for c in joined.columns if c not in ("as_of", "company", *used)]
    late = F.concat_ws(", ", *[F.when(F.col(c) > F.col("as_of"), F.lit(c.removesuffix("_used"))) for c in used])
    text = F.concat(F.lit("inputs were not public yet: "), late)
    checked = joined.withColumn("data_available_on", F.greatest(*used)).withColumn("_check", F.when(late != "", F.raise_error(text).cast("string")))
    return checked.where(F.col("_check").isNull()).select(
        "as_of", "company", *[finite(F.col(n).cast("double")).alias(n) for n in names], "data_available_on"
    )


def missing_snapshots(members: DataFrame, stored: DataFrame) -> DataFrame:
    """Priced members' (company, date) pairs that have no snapshot yet."""
    return members.where("has_prices").join(stored, ["as_of", "company"], "left_anti")

"""Directory lookups, the metric screen, filing lists and price selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.lookups import EXTRACTOR_VERSION, SIC_DIVISIONS
from tidemark.operators.asof import last_before


def sic_division(code: Column) -> Column:
    """Division of a four-digit SIC code by its major group; null when the code is not one."""
    group = F.when(code.rlike(r"^\d{4}$"), F.substring(code, 1, 2).cast("int"))
    found = F.lit(None).cast("string")
    for low, high, name in SIC_DIVISIONS:
        found = F.when(group.between(low, high), F.lit(name)).otherwise(found)
    return found


def company_search(securities: DataFrame, term: str, limit: int) -> DataFrame:
    """Active listings whose ticker starts with, or name contains, a term; best matches first."""
    text = term.strip()
    upper, lower = text.upper(), text.lower()
    ticker, name = F.upper("ticker"), F.lower("name")
    hits = securities.where(
        F.col("is_active") & (ticker.startswith(upper) | name.contains(lower))
    )
    rank = (
        F.when(F.col("ticker") == upper, 0)
        .when(ticker.startswith(upper), 1)
        .when(name.startswith(lower), 2)
        .otherwise(3)
    )
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    page = (
        hits.withColumn("rank", rank)
        .orderBy("rank", F.length("ticker"), "ticker", "security")
        .limit(limit)
    )
    return page.crossJoin(F.broadcast(total))  # one row


def resolve_securities(securities: DataFrame) -> DataFrame:
    """One listing per ticker: active first, then last seen, then exchange."""
    best = Window.partitionBy("ticker").orderBy(
        F.desc("is_active"), F.desc_nulls_last("last_seen"), F.asc_nulls_last("exchange"), "security"
    )
    return securities.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def primary_listing(securities: DataFrame) -> DataFrame:
    """Active listing per company: lowest id, and the one with the shortest ticker."""
    short = F.struct(F.length("ticker"), "ticker", "security")
    return (
        securities.where("is_active")
        .groupBy("company")
        .agg(F.min("security").alias("lowest"), F.min_by("security", short).alias("shortest"))
    )


def wide_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per company with a column per metric (known names, so no extra pass)."""
    return metrics.groupBy("company", "name", "sector").agg(
        *[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names]
    )


def screen(
    metrics: DataFrame, listings: DataFrame, filters: list[tuple[str, float | None, float | None]],
    sort_by: str, *, sector: str | None = None, descending: bool = True, limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Listed companies within every metric range, one page in sort order, with totals."""
    names = sorted({sort_by, *[f[0] for f in filters]})
    wide = wide_metrics(metrics, names)
    universe = wide.agg(F.count(F.lit(1)).alias("universe"))
    kept = wide.join(listings, "company", "left_semi")
    if sector is not None:
        kept = kept.where(F.col("sector") == sector)
    for name, low, high in filters:
        kept = kept.where(F.col(name).isNotNull())
        if low is not None:
            kept = kept.where(F.col(name) >= low)
        if high is not None:
            kept = kept.where(F.col(name) <= high)
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    order = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
    page = kept.orderBy(order, "name").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(universe))  # one row each


def sectors(companies: DataFrame) -> DataFrame:
    return companies.where(F.col("sector").isNotNull()).select("sector").distinct().orderBy("sector")


# --- Filings ------------------------------------------------------------------------------


def form_family(form: Column) -> Column:
    base = F.regexp_replace(F.upper(form), "/A$", "")
    return (
        F.when(base.isin("10-K", "10-KT", "10-K405"), "10-K")
        .when(base.isin("10-Q", "10-QT"), "10-Q")
        .otherwise(base)
    )


def filings_page(filings: DataFrame, forms: list[str], limit: int, offset: int) -> DataFrame:
    """Newest filings of the given forms, with the count of each one's form."""
    kept = filings.where(F.col("form").isin(forms))
    counts = kept.groupBy("form").agg(F.count(F.lit(1)).alias("form_count"))
    page = kept.orderBy(F.desc("filed_date"), F.desc("accession")).offset(offset).limit(limit)
    return page.join(counts, "form")


def pending_filings(filings: DataFrame, forms: list[str], limit: int) -> DataFrame:
    """Newest filings not loaded, failed, or loaded by another extractor version."""
    stale = (F.col("status") == "loaded") & ~F.col("version").eqNullSafe(EXTRACTOR_VERSION)
    due = F.col("status").isin("not_loaded", "failed") | stale
    kept = filings.where(F.col("form").isin(forms) & due)
    return kept.orderBy(F.desc("filed_date"), F.desc("accession")).limit(limit)


def previous_filings(filings: DataFrame) -> DataFrame:
    """Each filing with the company's prior original filing of its form family.

    Amendments look back at originals but are never found themselves."""
    rows = filings.withColumn("family", form_family(F.col("form")))
    original = F.when(F.col("form") == F.col("family"), F.struct("filed_date", "accession"))
    found = last_before(
        rows, ["company", "family"], "filed_date", ["accession"], original, "_previous"
    )
    return found.select(
        "company", "accession", "form", "filed_date",
        F.col("_previous.accession").alias("previous_accession"),
        F.col("_previous.filed_date").alias("previous_filed"),
    )


# --- Prices -------------------------------------------------------------------------------


def bar_range(bars: DataFrame, security: str, first, last) -> DataFrame:
    days = F.col("trade_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return bars.where((F.col("security_id") == security) & days)


def daily_change(bars: DataFrame) -> DataFrame:
    """Change of the last close; on adjusted closes only when one fetch supplied both bars."""
    newest = Window.partitionBy("security_id").orderBy(F.desc("trade_date"))
    two = bars.withColumn("_back", F.row_number().over(newest)).where("_back <= 2")
    last = lambda c: F.max(F.when(F.col("_back") == 1, F.col(c)))
    prior = lambda c: F.max(F.when(F.col("_back") == 2, F.col(c)))
    pair = two.groupBy("security_id").agg(
        F.max("trade_date").alias("as_of"),
        last("close").alias("close"), prior("close").alias("previous"),
        last("adj_close").alias("_adj"), prior("adj_close").alias("_adj_previous"),
        (last("fetch_id") == prior("fetch_id")).alias("_one_fetch"),
    )
    adjusted = (
        F.col("_one_fetch") & F.col("_adj").isNotNull() & F.col("_adj_previous").isNotNull()
    )
    basis = F.when(adjusted, "adjusted").otherwise("raw")
    now = F.when(F.col("basis") == "adjusted", F.col("_adj")).otherwise(F.col("close"))
    base = F.when(F.col("basis") == "adjusted", F.col("_adj_previous")).otherwise(F.col("previous"))
    return (
        pair.withColumn("basis", F.coalesce(basis, F.lit("raw")))
        .withColumn("change", now - base)
        .withColumn("change_percent", F.when(base > 0, (now - base) / base * 100))
        .drop("_adj", "_adj_previous", "_one_fetch")
    )


def last_weekday(day: Column) -> Column:
    """The latest weekday before a date."""
    number = F.weekday(day)  # Monday is 0
    return F.date_sub(day, F.when(number == 0, 3).when(number == 6, 2).otherwise(1))


def needs_load(coverage: DataFrame, target: Column, now: Column, retry_days: int) -> DataFrame:
    """Whether a listing's prices are due: never tried, a failure old enough, or behind target."""
    failed = F.col("status").isin("not_found", "error")
    due = (
        F.when(F.col("status").isNull(), True)
        .when(failed, F.datediff(now, "attempted_on") > retry_days)
        .otherwise(F.col("loaded_through").isNull() | (F.col("loaded_through") < target))
    )
    return coverage.withColumn("due", due)


def price_source(bars: DataFrame) -> DataFrame:
    """Per security the provider holding the newest bar, and that provider's bars."""
    newest = bars.groupBy("security_id").agg(
        F.max_by("provider", F.struct("trade_date", "provider")).alias("provider")
    )
    return bars.join(newest, ["security_id", "provider"])


def trading_calendar(bars: DataFrame, benchmark: str, first, last, lead_days: int = 60) -> DataFrame:
    """The benchmark's dates, or every security's when the benchmark has none."""
    start = F.date_sub(F.lit(first).cast("date"), lead_days)
    kept = bars.where(F.col("trade_date").between(start, F.lit(last).cast("date")))
    own = F.max((F.col("security_id") == benchmark).cast("int"))
    days = kept.groupBy("trade_date").agg(own.alias("own"))
    any_own = days.agg(F.max("own").alias("any_own"))
    return days.crossJoin(F.broadcast(any_own)).where("own = any_own").select("trade_date")  # one row


def latest_metrics(metrics: DataFrame, catalogue: list[str], company: int) -> DataFrame:
    """The metric catalogue with one company's stored values, missing ones null."""
    table = metrics.sparkSession.createDataFrame([(c,) for c in catalogue], "metric string")
    stored = metrics.where(F.col("company") == company).select("metric", "value")
    return table.join(stored, "metric", "left")


def mixed_basis(bars: DataFrame) -> DataFrame:
    """Whether a security's bars come from more than one fetch."""
    fetches = F.count_distinct("fetch_id")
    return bars.groupBy("security_id").agg((fetches > 1).alias("mixed_basis"))

"""Institutional holdings by manager and quarter, and insider trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import ranking as R

TOP_CUSIPS, TOP_HOLDERS = 2000, 100
OUTLIER = 5.0
DOLLARS_FROM = "2023-01-03"


def modal_period(filings: DataFrame) -> DataFrame:
    """The report period most original filings cover (the later one on a tie)."""
    counts = filings.where("kind = 'original'").groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("period", F.struct("n", "period")).alias("period"), F.max("n").alias("filings"))


def select_filings(filings: DataFrame) -> DataFrame:
    """Filings that make up each manager's holdings of a period: the last restatement, else the
    last original, and new-holdings amendments filed from then on."""
    mark = F.struct("filed", "accession")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, mark))
    base = filings.groupBy("manager", "period").agg(
        F.coalesce(of("restatement"), of("original")).alias("base")
    )
    joined = filings.join(base.where(F.col("base").isNotNull()), ["manager", "period"])
    chosen = (F.col("accession") == F.col("base.accession")) | (
        (F.col("kind") == "new_holdings") & (F.col("filed") >= F.col("base.filed"))
    )
    return joined.where(chosen).drop("base")


def positions(rows: DataFrame, dollars_from: str = DOLLARS_FROM) -> DataFrame:
    """Shares and dollars per (period, cusip, manager): options left out, thousands scaled up,
    shares only where the amount is a share count."""
    scale = F.when(F.col("filed") < F.lit(dollars_from).cast("date"), 1000).otherwise(1)
    kept = rows.where(F.col("put_call").isNull() & (F.col("value") >= 0))
    return kept.groupBy("period", "cusip", "manager").agg(
        F.sum(F.when(F.col("amount_type") == "SH", F.col("amount")).otherwise(0.0)).alias("shares"),
        F.sum(F.col("value") * scale).alias("value"),
    )


def drop_outliers(held: DataFrame) -> DataFrame:
    """Drop positions priced over 5× from the cusip's upper median (five prices needed)."""
    priced = held.withColumn("price", F.when(F.col("shares") > 0, F.col("value") / F.col("shares")))
    by = ["period", "cusip"]
    places = R.value_positions(priced.where(F.col("price").isNotNull()), by, "price")
    middle = F.floor(F.col("n") / 2)
    holds = (F.col("below") <= middle) & (middle < F.col("below") + F.col("ties"))
    medians = places.where(F.col("n") >= 5).where(holds).select(*by, F.col("price").alias("median"))
    joined = priced.join(medians, by, "left")
    far = (F.col("price") / F.col("median") > OUTLIER) | (F.col("price") / F.col("median") < 1 / OUTLIER)
    bad = F.coalesce((F.col("median") > 0) & far, F.lit(False))
    return joined.where(~bad).drop("price", "median")


def top_cusips(held: DataFrame, limit: int = TOP_CUSIPS) -> DataFrame:
    """The largest positions of each quarterly set: period, cusip, value."""
    totals = held.groupBy("period", "cusip").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("value"), "cusip"))  # one row per cusip
    return totals.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def company_holdings(held: DataFrame, mapping: DataFrame, limit: int = TOP_CUSIPS) -> DataFrame:
    """Positions of each period's top cusips summed per (period, company, manager)."""
    kept = held.join(top_cusips(held, limit).select("period", "cusip"), ["period", "cusip"], "left_semi")
    return kept.join(mapping, "cusip").groupBy("period", "company", "manager").agg(
        F.sum("shares").alias("shares"), F.sum("value").alias("value")
    )


def company_summary(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy("period", "company").agg(
        F.count(F.lit(1)).alias("holders"), F.sum("shares").alias("shares"), F.sum("value").alias("value")
    )


def top_holders(holdings: DataFrame, limit: int = TOP_HOLDERS) -> DataFrame:
    order = Window.partitionBy("period", "company").orderBy(F.desc("value"), "manager")
    return holdings.withColumn("place", F.row_number().over(order).cast("bigint")).where(
        F.col("place") <= limit
    )


def map_cusips(wanted: DataFrame, known: DataFrame, offers: DataFrame, securities: DataFrame) -> DataFrame:
    """Mappings for cusips not mapped yet; only a US composite listing names a company."""
    todo = wanted.join(known, "cusip", "left_anti").join(offers, "cusip", "left")
    ticker = F.upper(F.translate("ticker", "/", "-"))
    active = securities.where("is_active").groupBy(F.col("ticker").alias("_t")).agg(F.min("company").alias("_c"))
    rows = todo.withColumn("ticker", ticker).join(active, F.col("ticker") == F.col("_t"), "left")
    return rows.select(
        "cusip", "ticker", "exch_code",
        F.when(F.col("figi").isNotNull(), "mapped").otherwise("no_match").alias("status"),
        F.when(F.col("exch_code") == "US", F.col("_c")).alias("company"),
    )


def holder_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Each holder's change of shares between two periods; unknown where the company has no holders in the earlier one."""
    old = before.select("company", "manager", F.col("shares").alias("previous"), F.lit(True).alias("_old"))
    new = now.select("company", "manager", "shares", "value", F.lit(True).alias("_new"))
    known = before.groupBy("company").agg(F.lit(True).alias("_known"))
    both = new.join(old, ["company", "manager"], "full_outer").join(known, "company", "left")
    change = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(F.col("_new").isNull(), "left_top")
        .when(F.col("_old").isNull(), "entered_top")
        .when(F.col("shares") > F.col("previous"), "increased")
        .when(F.col("shares") < F.col("previous"), "decreased")
        .otherwise("unchanged")
    )
    return both.select("company", "manager", "shares", "previous", "value", change.alias("change"))


def insider_list(trades: DataFrame, since, limit: int) -> DataFrame:
    """Newest trades since a date with their value."""
    kept = trades.where(F.col("tx_date") >= F.lit(since).cast("date"))
    return kept.withColumn("value", F.col("shares") * F.col("price")).orderBy(
        F.desc("tx_date"), F.desc("tx_id")
    ).limit(limit)


def insider_totals(trades: DataFrame, key: str = "company") -> DataFrame:
    """Purchases and sales per company: trades, shares, value, distinct insiders."""
    kept = trades.where(F.col("code").isin("P", "S"))
    return kept.groupBy(key, "code").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("shares").alias("shares"),
        F.sum(F.col("shares") * F.col("price")).alias("value"),
        F.count_distinct("owner").alias("insiders"),
    )

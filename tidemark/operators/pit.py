"""Point-in-time facts, macro vintages and the universe: nothing is used before it was public."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.asof import asof_grid, grid_calendar

VINTAGE_GAP_DAYS = 30
STALE_REVENUE_DAYS = 550
CANDIDATE_RANK = 300
UNIVERSE_SIZE = 200
SUCCESSION_DAYS = (-30, 120)


def latest_known(facts: DataFrame, key: list[str], order: list[str], as_of=None) -> DataFrame:
    """Per key the value of the latest filing by `as_of` (all filings when it is null).

    Null parts of the key group together."""
    rows = facts if as_of is None else facts.where(F.col("filed_date") <= F.lit(as_of).cast("date"))
    rest = [c for c in facts.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(newest).select(*key, "_row.*")


def facts_asof(facts: DataFrame, key: list[str], order: list[str], days: DataFrame) -> DataFrame:
    """The latest version of each fact on many dates."""
    best = F.struct(*order, "value")
    grid = asof_grid(facts, key, "filed_date", best, days)
    return grid.select("as_of", *key, "best.*")


def cut(bars: DataFrame, day) -> DataFrame:
    """Bars on or before a day."""
    return bars.where(F.col("trade_date") <= F.lit(day).cast("date"))


# --- Macro --------------------------------------------------------------------------------


def macro_available(vintages: DataFrame, lags: Column) -> DataFrame:
    """First day each vintage could be known.

    A first vintage that appears over 30 days later than the release lag was back-filled, so the
    lag dates it; any other vintage is known from its own start, never before its observation."""
    first = vintages.groupBy("series", "observation_date").agg(
        F.min("realtime_start").alias("_first")
    )
    rows = vintages.join(first, ["series", "observation_date"]).withColumn("_lag", lags)
    estimated = F.date_add("observation_date", F.col("_lag"))
    late = (F.col("realtime_start") == F.col("_first")) & (
        F.col("realtime_start") > F.date_add(estimated, VINTAGE_GAP_DAYS)
    )
    known = F.when(late, estimated).otherwise(F.greatest("realtime_start", "observation_date"))
    return rows.withColumn("available_on", known).drop("_first", "_lag")


_NEWEST = ("available_on", "realtime_start", "tie")


def macro_known(available: DataFrame, day) -> DataFrame:
    """The latest vintage of every observation published by a day."""
    rows = available.where(F.col("available_on") <= F.lit(day).cast("date"))
    return rows.groupBy("series", "observation_date").agg(
        F.max_by("value", F.struct(*_NEWEST)).alias("value"),
        F.max("available_on").alias("available_on"),
    )


def macro_latest(available: DataFrame, days: DataFrame) -> DataFrame:
    """Newest observation known on each day; a later revision of an older one never wins."""
    best = F.struct("observation_date", *_NEWEST, "value")
    grid = asof_grid(available, ["series"], "available_on", best, days)
    return grid.select(
        "as_of", "series", "best.observation_date", "best.available_on", "best.value"
    )


def _newest_pairs(back: int):
    """A series' observations by the grid date they (or a revision) fall to → the newest value and the one `back` earlier, where they change."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_i", "observation_date"], kind="stable")
        days: list = []  # the newest back + 1 observations, ascending
        values: list[float] = []
        out, last = [], None
        grid, observed, value = rows["_i"].tolist(), rows["observation_date"].tolist(), rows["value"].tolist()
        for k, (i, day, v) in enumerate(zip(grid, observed, value, strict=True)):
            at = bisect_left(days, day)
            if at < len(days) and days[at] == day:
                values[at] = v  # a revision
            elif at or len(days) <= back:
                days.insert(at, day)
                values.insert(at, v)
                if len(days) > back + 1:
                    del days[0], values[0]
            if k + 1 == len(grid) or grid[k + 1] != i:
                pair = (values[-1], values[0] if len(values) > back else None)
                if pair != last:
                    out.append((rows["series"].iloc[0], i, *pair))
                    last = pair
        return pd.DataFrame(out, columns=["series", "_i", "latest", "earlier"]).astype({"_i": "int64", "latest": "float64", "earlier": "float64"})

    return run


def macro_back(available: DataFrame, days: DataFrame, back: int) -> DataFrame:
    """The newest known value and the one `back` observations earlier, as known on each day.

    Vintages fall to their first grid date and are reduced there map-side to the newest per observation. Along the grid each
    series keeps its newest back + 1 observations, and only changes of the pair are repeated over the days they hold for. One
    series' reduced observations are one task's: its calendar."""
    calendar = grid_calendar(days)
    landed = (
        available.join(F.broadcast(calendar), F.col("available_on") == F.col("_date"))  # calendar-sized
        .groupBy("series", "observation_date", F.col("_i").cast("long").alias("_i"))
        .agg(F.max_by("value", F.struct(*_NEWEST)).cast("double").alias("value"))
    )
    kind = landed.schema["series"].dataType.simpleString()
    changes = landed.groupBy("series").applyInPandas(_newest_pairs(back), f"series {kind}, _i long, latest double, earlier double")
    w = Window.partitionBy("series").orderBy("_i")
    dates = calendar.select("as_of", F.col("_i").cast("long").alias("_i")).distinct()
    total = dates.agg(F.max("_i").alias("_total"))
    held = changes.withColumn("_next", F.lead("_i").over(w)).join(F.broadcast(total))  # one row: the number of grid dates
    held = held.withColumn("_i", F.explode(F.sequence("_i", F.coalesce(F.col("_next") - 1, F.col("_total")))))
    return held.join(F.broadcast(dates), "_i").select("as_of", "series", "latest", F.nanvl("earlier", F.lit(None).cast("double")).alias("earlier"))


def macro_change(available: DataFrame, days: DataFrame, back: int) -> DataFrame:
    pair = macro_back(available, days, back)
    return pair.select("as_of", "series", (F.col("latest") - F.col("earlier")).alias("change"))


def macro_growth(available: DataFrame, days: DataFrame, back: int) -> DataFrame:
    pair = macro_back(available, days, back)
    rate = F.when(F.col("earlier") != 0, F.col("latest") / F.col("earlier") - 1)
    return pair.select("as_of", "series", rate.alias("growth"))


def macro_features(available: DataFrame, days: DataFrame, names: dict[str, str]) -> DataFrame:
    """Seven macro inputs per day and the latest publication date used.

    `names` maps the roles ten_year, curve, unemployment, conditions and prices to series."""
    earlier = days.select(F.date_sub("as_of", 91).alias("as_of"))
    both = days.unionByName(earlier).distinct()
    levels = macro_latest(available, both)
    role = {series: r for r, series in names.items()}

    def of(frame: DataFrame, series: str, column: str, alias: str) -> Column:
        return F.max(F.when(F.col("series") == names[series], F.col(column))).alias(alias)

    now = levels.join(F.broadcast(days), "as_of", "left_semi").where(
        F.col("series").isin(*role)
    )
    used = [names[r] for r in ("ten_year", "curve", "unemployment", "conditions")]
    now = now.groupBy("as_of").agg(
        of(now, "ten_year", "value", "macro_10y"),
        of(now, "curve", "value", "macro_curve_10y3m"),
        of(now, "unemployment", "value", "macro_unemployment"),
        of(now, "conditions", "value", "macro_nfci"),
        F.max(F.when(F.col("series").isin(*used), F.col("available_on"))).alias("used_on"),
    )
    then = levels.where(F.col("series") == names["ten_year"]).select(
        F.date_add("as_of", 91).alias("as_of"), F.col("value").alias("_then")
    )
    yoy = macro_growth(available.where(F.col("series") == names["prices"]), days, 12)
    jobs = macro_change(available.where(F.col("series") == names["unemployment"]), days, 3)
    return (
        now.join(yoy.select("as_of", F.col("growth").alias("macro_cpi_yoy")), "as_of", "left")
        .join(
            jobs.select("as_of", F.col("change").alias("macro_unemployment_change_3m")),
            "as_of",
            "left",
        )
        .join(then, "as_of", "left")
        .withColumn("macro_10y_change_3m", F.col("macro_10y") - F.col("_then"))
        .drop("_then")
    )


def macro_dashboard(known: DataFrame, ratio_series: list[str]) -> DataFrame:
    """Per series: latest value, change against a year earlier, and the thinned history of five years.

    Of a series with n observations every (n / 300)th of the last five years is shown, from the first of them on."""
    whole = Window.partitionBy("series")  # one row per observation date
    rows = known.withColumn("_last", F.max("observation_date").over(whole)).withColumn("_all", F.count(F.lit(1)).over(whole))
    year_ago = F.when(
        F.col("observation_date") <= F.date_sub("_last", 365), F.col("observation_date")
    )
    recent = F.col("observation_date") >= F.date_sub("_last", 5 * 366)
    place = F.row_number().over(Window.partitionBy("series", "_recent").orderBy("observation_date")) - 1
    rows = rows.withColumn("_recent", recent).withColumn("_place", place)
    shown = F.col("_recent") & (F.col("_place") % F.greatest(F.lit(1), F.floor(F.col("_all") / 300)) == 0)
    facts = rows.groupBy("series").agg(
        F.max_by("value", "observation_date").alias("value"),
        F.max("observation_date").alias("observation_date"),
        F.max_by("available_on", "observation_date").alias("available_on"),
        F.max_by(F.when(year_ago.isNotNull(), F.col("value")), year_ago).alias("_base"),
        F.sort_array(F.collect_list(F.when(shown, F.struct("observation_date", "value")))).alias("history"),
    )
    change = F.when(
        F.col("series").isin(*ratio_series),
        F.when(F.col("_base") != 0, F.col("value") / F.col("_base") - 1),
    ).otherwise(F.col("value") - F.col("_base"))
    return facts.select(
        "series", "value", "observation_date", "available_on",
        change.alias("yoy_change"), F.size("history").alias("points"), "history",
    )


# --- Universe -----------------------------------------------------------------------------


def revenue_asof(annual: DataFrame, priority: list[str], days: DataFrame) -> DataFrame:
    """Latest fiscal-year revenue known on each date: newest period, then concept priority, then
    last filing; dropped when the period is over 550 days old."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("concept"))
    length = F.datediff("period_end", "period_start")
    rows = annual.where(length.between(330, 400) & (F.col("value") > 0) & (place > 0))
    best = F.struct(
        "period_end", (-place).alias("place"), "filed_date", "accession", "line", "part", "value"
    )
    grid = asof_grid(rows, ["company"], "filed_date", best, days)
    fresh = grid.where(F.col("best.period_end") >= F.date_sub("as_of", STALE_REVENUE_DAYS))
    return fresh.select(
        "as_of",
        "company",
        F.col("best.period_end").alias("period_end"),
        F.element_at(
            F.array(*[F.lit(p) for p in priority]), (-F.col("best.place")).cast("int")
        ).alias("concept"),
        F.col("best.value").alias("revenue"),
    )


def candidates(annual: DataFrame, rank: int = CANDIDATE_RANK) -> DataFrame:
    """Companies ever ranked in the top by calendar-year revenue, with best rank and its year."""
    revenue = annual.groupBy(F.year("period_end").alias("year"), "company").agg(
        F.max("value").alias("revenue")
    )
    order = Window.partitionBy("year").orderBy(F.desc("revenue"), "company")
    ranked = revenue.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rank)
    best = F.min(F.struct("rank", "year")).alias("best")
    return ranked.groupBy("company").agg(best).select(
        "company", F.col("best.rank").alias("best_rank"), F.col("best.year").alias("best_year")
    )


def universe_rank(
    revenue: DataFrame, listings: DataFrame, coverage: DataFrame, size: int = UNIVERSE_SIZE
) -> DataFrame:
    """Top companies by known revenue per date. A listing counts once, for its best-ranked
    company; prices count when they begin 370 days before the date."""
    order = Window.partitionBy("as_of").orderBy(F.desc("revenue"), "company")
    ranked = revenue.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    listed = ranked.join(listings, "company", "left")
    once = Window.partitionBy("as_of", "security_id").orderBy("rank")
    first = F.row_number().over(once) == 1
    counted = listed.withColumn("_first", first).withColumn(
        "security_id", F.when(F.col("_first"), F.col("security_id"))
    )
    covered = counted.join(coverage, "security_id", "left")
    has = F.coalesce(F.col("loaded_from") <= F.date_sub("as_of", 370), F.lit(False))
    return covered.select(
        "as_of", "company", F.col("rank").cast("bigint").alias("rank"), "revenue", "period_end",
        "security_id", has.alias("has_prices"),
    )


def price_targets(universe: DataFrame) -> DataFrame:
    members = universe.where(F.col("security_id").isNotNull())
    return members.groupBy("security_id").agg(F.min("rank").alias("best_rank")).orderBy("best_rank")


def survivorship(universe: DataFrame) -> DataFrame:
    members = F.count(F.lit(1))
    priced = F.count_if("has_prices")
    return universe.groupBy("as_of").agg(
        members.alias("members"),
        priced.alias("with_prices"),
        F.count_if(F.col("security_id").isNull()).alias("no_listing"),
        (1 - priced / members).alias("missing_share"),
    )


# Legal words removed before names are compared (fixed values).
NAME_WORDS = r"\b(the|holdings?|corp(oration)?|inc(orporated)?|co(mpany)?|llc|ltd|plc|group|lp|new)\b"


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), NAME_WORDS, " "), "[^a-z0-9]", "")


def successors(registrants: DataFrame) -> DataFrame:
    """Listed successor of each unlisted registrant: equal normalised name, and filing that began
    30 days before to 120 days after the predecessor's last filing; shortest ticker first.

    Both sides shrink to one row per (name, day) before they meet, so a common name costs at most
    the calendar, not all pairs of its holders."""
    low, high = SUCCESSION_DAYS
    named = registrants.withColumn("name", normalized_name(F.col("legal_name"))).where("name != ''")
    month = 30
    day = lambda c: F.unix_date(c)
    starts = named.where("listed").groupBy("name", "first_filed").agg(
        F.min(F.struct(F.length("ticker").alias("size"), "ticker", "company")).alias("best")
    ).withColumn("_slot", F.floor(day(F.col("first_filed")) / month))
    ends = named.where("not listed").select("name", "last_filed").distinct()
    slots = F.sequence(
        F.floor((day(F.col("last_filed")) + low) / month),
        F.floor((day(F.col("last_filed")) + high) / month),
    )
    ends = ends.withColumn("_slot", F.explode(slots))
    gap = F.datediff("first_filed", "last_filed")
    met = ends.join(starts, ["name", "_slot"]).where(gap.between(low, high))
    chosen = met.groupBy("name", "last_filed").agg(F.min("best").alias("best"))
    return named.where("not listed").join(chosen, ["name", "last_filed"]).select(
        "company", F.col("best.company").alias("successor"), F.col("best.ticker").alias("ticker")
    )

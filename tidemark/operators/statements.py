"""Statements from point-in-time filed facts, for all companies at once.

Input facts: company, taxonomy, concept, unit, period_start (null for instants), period_end,
value, fiscal_year, fiscal_period, accession, filed_date. Facts reduce map-side to the latest
version per period first; after that a company has at most its reported periods, so the ordered
steps below work on calendar-bounded groups. Output is long: one row per (company, period, item).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.lookups import COVER_CONCEPT, concept_rows
from tidemark.session import cut_lineage

SPLIT_GAP_DAYS = 400
MAX_SHARE_AGE_DAYS = 400
FACT_KEY = ["company", "taxonomy", "concept", "unit", "period_start", "period_end"]


def span_days(start: Column | str, end: Column | str) -> Column:
    """Days of a period, both ends counted."""
    return F.datediff(end, start) + 1


def is_annual() -> Column:
    return span_days("period_start", "period_end").between(350, 380)


def is_quarter() -> Column:
    return span_days("period_start", "period_end").between(80, 100)


def public(facts: DataFrame, as_of) -> DataFrame:
    return facts if as_of is None else facts.where(F.col("filed_date") <= F.lit(as_of).cast("date"))


# --- Splits -------------------------------------------------------------------------------


def split_ratio(before: Column, after: Column) -> Column:
    """The split a restated share count implies: 1.5 or 2…100 (or an inverse) within 2%."""
    change = after.cast("double") / before.cast("double")
    size = F.when(change >= 1, change).otherwise(1 / change)
    ratios = F.concat(
        F.array(F.lit(1.5)), F.transform(F.sequence(F.lit(2), F.lit(100)), lambda r: r.cast("double"))
    )
    found = F.try_element_at(F.filter(ratios, lambda r: F.abs(size - r) <= 0.02 * r), F.lit(1))
    ratio = F.when(change >= 1, found).otherwise(1 / found)
    return F.when((before > 0) & (after > 0), ratio)


def split_evidence(facts: DataFrame, as_of=None) -> DataFrame:
    """(company, effective day, ratio) wherever a later filing restates a share count so."""
    shares = public(facts, as_of).where(
        (F.col("taxonomy") == "us-gaap") & (F.col("unit") == "shares")
    )
    w = Window.partitionBy("company", "concept", "period_start", "period_end").orderBy(
        "filed_date", "accession"
    )
    pairs = shares.withColumn("_before", F.lag("value").over(w)).where(F.col("_before").isNotNull())
    found = pairs.select(
        "company",
        F.col("filed_date").alias("effective"),
        split_ratio(F.col("_before"), F.col("value")).alias("ratio"),
    )
    return found.where(F.col("ratio").isNotNull()).distinct()


def split_events(facts: DataFrame, as_of=None) -> DataFrame:
    """First filing of each split; the same ratio within 400 days of a kept event is an echo."""
    days = split_evidence(facts, as_of).groupBy("company", "ratio").agg(
        F.sort_array(F.collect_set("effective")).alias("days")
    )  # distinct days of one ratio
    kept = F.aggregate(
        "days",
        F.array().cast("array<date>"),
        lambda acc, d: F.when(
            (F.size(acc) > 0) & (F.datediff(d, F.try_element_at(acc, F.lit(-1))) <= SPLIT_GAP_DAYS),
            acc,
        ).otherwise(F.concat(acc, F.array(d))),
    )
    return days.select("company", F.explode(kept).alias("effective"), "ratio")


def split_adjusted(facts: DataFrame, as_of=None) -> DataFrame:
    """Share and per-share values filed before a split, put on the new basis with a note."""
    events = split_events(facts, as_of).groupBy("company").agg(
        F.sort_array(F.collect_list(F.struct("effective", "ratio"))).alias("_events")
    )  # deduplicated events of one company: a handful
    joined = facts.join(events, "company", "left")
    later = F.filter("_events", lambda e: e["effective"] > F.col("filed_date"))
    joined = joined.withColumn(
        "_later",
        F.when(F.col("unit").isin("shares", "USD/shares") & (F.size(later) > 0), later),
    )
    ratio = F.aggregate("_later", F.lit(1.0), lambda a, e: a * e["ratio"])
    number = F.col("value").cast("double")
    kind = joined.schema["value"].dataType
    restated = F.when(F.col("unit") == "shares", number * ratio).otherwise(number / ratio)
    note = F.concat(
        F.lit("Adjusted ("),
        F.array_join(
            F.transform(
                "_later",
                lambda e: F.concat(
                    F.lit("split ×"),
                    F.regexp_replace(e["ratio"].cast("string"), r"\.0$", ""),
                    F.lit(" from "),
                    e["effective"].cast("string"),
                ),
            ),
            ", ",
        ),
        F.lit(")"),
    )
    changed = F.col("_later").isNotNull()
    return (
        joined.withColumn("value", F.when(changed, restated.cast(kind)).otherwise(F.col("value")))
        .withColumn("note", F.when(changed, note))
        .drop("_events", "_later")
    )


def latest_known(facts: DataFrame, as_of=None) -> DataFrame:
    """The latest filed version of each fact."""
    rest = [c for c in facts.columns if c not in FACT_KEY]
    newest = F.max_by(F.struct(*rest), F.struct("filed_date", "accession")).alias("_row")
    return public(facts, as_of).groupBy(*FACT_KEY).agg(newest).select(*FACT_KEY, "_row.*")


# --- Fiscal years -------------------------------------------------------------------------


def annual_spans(known: DataFrame) -> DataFrame:
    """Non-overlapping annual spans: the commonest start per end, the earlier year on overlap."""
    spans = (
        known.where(is_annual())
        .groupBy("company", "period_end", "period_start")
        .agg(F.count(F.lit(1)).alias("n"), F.min("filed_date").alias("first"))
    )
    chosen = spans.groupBy("company", "period_end").agg(
        F.max_by("period_start", F.struct("n", -F.unix_date("first"))).alias("start")
    )
    ordered = chosen.groupBy("company").agg(
        F.sort_array(F.collect_list(F.struct(F.col("period_end").alias("end"), "start"))).alias("s")
    )  # one entry per fiscal year
    span = "array<struct<end:date,start:date>>"
    kept = F.aggregate(
        "s",
        F.array().cast(span),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return ordered.select("company", F.explode(kept).alias("k")).select("company", "k.start", "k.end")


def _base_year(end: Column | str) -> Column:
    return F.year(F.date_sub(end, 14))


def year_labels(known: DataFrame, spans: DataFrame) -> DataFrame:
    """Fiscal-year label per span end.

    A filing's own year is trusted for the latest annual end it reports; other ends take the
    issuer's usual offset, as all do when labels collide."""
    own_end = (
        known.where(is_annual() & (F.col("fiscal_period") == "FY") & F.col("fiscal_year").isNotNull())
        .groupBy("company", "accession")
        .agg(F.max("period_end").alias("period_end"))
    )
    own = (
        known.where(F.col("fiscal_year").isNotNull())
        .join(own_end, ["company", "accession", "period_end"], "left_semi")
        .groupBy("company", "period_end")
        .agg(F.min_by("fiscal_year", F.struct("filed_date", "accession")).alias("own"))
    )
    offset = (
        own.groupBy("company", (F.col("own") - _base_year("period_end")).alias("offset"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("company")
        .agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("offset"))
    )
    labelled = (
        spans.join(own.withColumnRenamed("period_end", "end"), ["company", "end"], "left")
        .join(offset, "company", "left")
        .withColumn("fallback", _base_year("end") + F.coalesce("offset", F.lit(0)))
        .withColumn("label", F.coalesce("own", "fallback"))
    )
    distinct = labelled.groupBy("company").agg(
        (F.count_distinct("label") == F.count(F.lit(1))).alias("_clear")
    )
    return labelled.join(distinct, "company").select(
        "company", "start", "end",
        F.when(F.col("_clear"), F.col("label")).otherwise(F.col("fallback")).alias("fiscal_year"),
    )


def _interim(spans: DataFrame, years: DataFrame, inside: Column) -> DataFrame:
    """Interim period ends reported within each year, sorted. `spans` holds distinct periods."""
    near = (
        (F.col("start") <= F.col("period_start"))
        & (F.col("start") < F.col("period_end"))
        & inside
        & ((F.col("period_start") == F.col("start")) | is_quarter())
    )
    joined = years.join(spans, "company", "left").withColumn(
        "_end", F.when(near, F.col("period_end"))
    )
    return joined.groupBy(*years.columns).agg(F.sort_array(F.collect_set("_end")).alias("ends"))


def fiscal_years(known: DataFrame) -> DataFrame:
    """Complete years with their quarter ends (only when exactly three interim ends exist), and
    the year in progress when one to three quarters chain after the last complete one."""
    periods = known.where("period_start is not null").select(
        "company", "period_start", "period_end"
    ).distinct()
    labelled = year_labels(known, annual_spans(known))
    complete = _interim(periods, labelled, F.col("period_end") < F.col("end")).select(
        "company", "fiscal_year", "start", "end",
        F.when(F.size("ends") == 3, F.array_append("ends", F.col("end"))).alias("quarter_ends"),
        F.lit(True).alias("complete"),
    )
    last = labelled.groupBy("company").agg(F.max_by("fiscal_year", "end").alias("fy"), F.max("end").alias("e"))
    after = last.select(
        "company", (F.col("fy") + 1).alias("fiscal_year"), F.date_add("e", 1).alias("start")
    )
    open_years = _interim(periods, after, span_days("start", "period_end") < 350)
    starts = F.concat(
        F.array("start"), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda d: F.date_add(d, 1))
    )
    chained = F.forall(
        F.zip_with(starts, "ends", lambda s, e: F.datediff(e, s) + 1), lambda n: n.between(80, 100)
    )
    progress = open_years.where(F.size("ends").between(1, 3)).where(chained).select(
        "company", "fiscal_year", "start", F.element_at("ends", -1).alias("end"),
        F.col("ends").alias("quarter_ends"), F.lit(False).alias("complete"),
    )
    return cut_lineage(complete.unionByName(progress))


def annual_periods(years: DataFrame) -> DataFrame:
    key = F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"))
    return years.where("complete").select(
        "company", "fiscal_year", F.lit(None).cast("int").alias("quarter"), key.alias("period"),
        "start", "end", F.col("start").alias("year_start"), F.lit(None).cast("date").alias("prev_end"),
        "complete", F.col("fiscal_year").cast("bigint").alias("idx"),
    )


def quarter_periods(years: DataFrame) -> DataFrame:
    q = years.where(F.col("quarter_ends").isNotNull()).select(
        "company", "fiscal_year", "start", "complete", "quarter_ends",
        F.posexplode("quarter_ends").alias("_i", "period_end"),
    )
    number = F.col("_i") + 1
    key = F.concat(
        F.lit("FY"), F.col("fiscal_year").cast("string"), F.lit("-Q"), number.cast("string")
    )
    return q.withColumn(
        "prev_end", F.when(F.col("_i") > 0, F.try_element_at("quarter_ends", F.greatest("_i", F.lit(1))))
    ).select(
        "company", "fiscal_year", number.alias("quarter"), key.alias("period"),
        F.when(F.col("_i") == 0, F.col("start")).otherwise(F.date_add("prev_end", 1)).alias("p_start"),
        F.col("period_end").alias("end"), F.col("start").alias("year_start"), "prev_end", "complete",
        (F.col("fiscal_year").cast("bigint") * 4 + F.col("_i")).alias("idx"),
    ).withColumnRenamed("p_start", "start")


# --- Cells --------------------------------------------------------------------------------


def _items(known: DataFrame) -> DataFrame:
    """Facts of statement concepts with item, kind and priority (a fixed list of ~70 rows)."""
    table = known.sparkSession.createDataFrame(
        [(i, k, c, p) for i, k, _, c, p in concept_rows()],
        "item string, kind string, concept string, priority int",
    )
    if "note" not in known.columns:
        known = known.withColumn("note", F.lit(None).cast("string"))
    return known.where(F.col("taxonomy") == "us-gaap").join(F.broadcast(table), "concept")


_PERIOD = ["company", "fiscal_year", "quarter", "period", "start", "end", "complete", "idx"]


def _first_concept(cells: DataFrame) -> DataFrame:
    """Per period and item the cell of the first concept in priority that has one."""
    best = F.min_by(
        F.struct("value", "concept", "accession", "filed_date", "derivation"), "priority"
    )
    return cells.groupBy(*_PERIOD, "item", "kind").agg(best.alias("_c")).select(
        *_PERIOD, "item", "kind", "_c.*"
    )


def annual_cells(known: DataFrame, periods: DataFrame) -> DataFrame:
    facts = _items(known).withColumnRenamed("period_end", "end")
    joined = periods.join(facts.drop("fiscal_year"), ["company", "end"])
    instant = (F.col("kind") == "instant") & F.col("period_start").isNull()
    spanned = (F.col("kind") != "instant") & (F.col("period_start") == F.col("start"))
    return _first_concept(joined.where(instant | spanned).withColumn("derivation", F.col("note")))


def quarter_cells(known: DataFrame, periods: DataFrame) -> DataFrame:
    """Quarter values: instant, else the reported three months, else (for flows) year to date or
    the difference of two year-to-date values of the same concept."""
    facts = _items(known).drop("fiscal_year")
    cell = F.struct("value", "accession", "filed_date", F.col("note").alias("derivation"))
    kind, start = F.col("kind"), F.col("period_start")
    at_end = periods.join(facts.withColumnRenamed("period_end", "end"), ["company", "end"])
    role = (
        F.when((kind == "instant") & start.isNull(), "direct")
        .when((kind != "instant") & span_days("period_start", "end").between(80, 100), "direct")
        .when((kind == "flow") & (start == F.col("year_start")), "ytd")
    )
    now = at_end.withColumn("_role", role).where(F.col("_role").isNotNull())
    back = (
        periods.where(F.col("prev_end").isNotNull())
        .join(
            facts.where(kind == "flow").withColumnRenamed("period_end", "prev_end"),
            ["company", "prev_end"],
        )
        .where(start == F.col("year_start"))
        .withColumn("_role", F.lit("before"))
    )
    # A three-month year-to-date value at the first quarter's end also serves as "before".
    first = at_end.where((kind == "flow") & (start == F.col("year_start"))).withColumn(
        "_role", F.lit("ytd")
    )
    columns = [*_PERIOD, "item", "kind", "concept", "priority", "_role", "period_start"]
    rows = (
        now.withColumn("_cell", cell).select(*columns, "_cell")
        .unionByName(first.withColumn("_cell", cell).select(*columns, "_cell"))
        .unionByName(back.withColumn("_cell", cell).select(*columns, "_cell"))
    )
    of = lambda r: F.min_by(F.when(F.col("_role") == r, F.col("_cell")), F.when(F.col("_role") == r, F.col("period_start")))
    direct_instant = F.max(F.when((F.col("_role") == "direct") & F.col("period_start").isNull(), F.col("_cell")))
    grouped = rows.groupBy(*_PERIOD, "item", "kind", "concept", "priority").agg(
        direct_instant.alias("_instant"), of("direct").alias("_direct"), of("ytd").alias("_ytd"),
        of("before").alias("_before"),
    )
    q = F.col("quarter")
    through = F.when((q == 4) & F.col("complete"), F.lit("FY")).otherwise(
        F.concat((3 * q).cast("string"), F.lit("M YTD"))
    )
    formula = F.concat(through, F.lit(" − "), (3 * (q - 1)).cast("string"), F.lit("M YTD"))
    derived = F.when(
        F.col("_ytd").isNotNull() & F.col("_before").isNotNull(),
        F.struct(
            (F.col("_ytd.value") - F.col("_before.value")).cast("decimal(38,10)").alias("value"),
            F.col("_ytd.accession").alias("accession"),
            F.greatest("_ytd.filed_date", "_before.filed_date").alias("filed_date"),
            formula.alias("derivation"),
        ),
    )
    chosen = F.coalesce(
        "_instant", "_direct", F.when((F.col("kind") == "flow") & (q == 1), F.col("_ytd")),
        F.when((F.col("kind") == "flow") & (q > 1), derived),
    )
    cells = grouped.withColumn("_c", chosen).where(F.col("_c").isNotNull())
    return _first_concept(cells.select(*_PERIOD, "item", "kind", "concept", "priority", "_c.*"))


def with_gross_profit(cells: DataFrame) -> DataFrame:
    """Add revenue − cost of revenue where gross profit is not reported."""
    pick = lambda item, c: F.max(F.when(F.col("item") == item, F.col(c)))
    parts = cells.where(F.col("item").isin("gross_profit", "revenue", "cost_of_revenue"))
    filled = parts.groupBy(*_PERIOD).agg(
        pick("gross_profit", "value").alias("_own"),
        (pick("revenue", "value") - pick("cost_of_revenue", "value")).cast("decimal(38,10)").alias("value"),
        F.greatest(pick("revenue", "filed_date"), pick("cost_of_revenue", "filed_date")).alias("filed_date"),
    ).where(F.col("_own").isNull() & F.col("value").isNotNull())
    made = filled.select(
        *_PERIOD, F.lit("gross_profit").alias("item"), F.lit("flow").alias("kind"), "value",
        F.lit(None).cast("string").alias("concept"), F.lit(None).cast("string").alias("accession"),
        "filed_date", F.lit("Revenue − Cost of revenue").alias("derivation"),
    )
    return cells.unionByName(made)


def prepared(facts: DataFrame, as_of=None) -> DataFrame:
    """Split-adjusted latest facts with exact decimal values.

    Every later step reads them several times, so they are written once to the shared folder."""
    exact = facts.withColumn("value", F.col("value").cast("decimal(38,10)"))
    return cut_lineage(latest_known(split_adjusted(exact, as_of), as_of))


def statements(facts: DataFrame, period_type: str, as_of=None) -> DataFrame:
    """Annual or quarterly statements as long cells; periods without any value have no rows."""
    known = prepared(facts, as_of)
    return build_statements(known, fiscal_years(known), period_type)


def build_statements(known: DataFrame, years: DataFrame, period_type: str) -> DataFrame:
    """Statements from prepared facts; both period types can share one preparation."""
    if period_type == "annual":
        cells = annual_cells(known, annual_periods(years))
    else:
        cells = quarter_cells(known, quarter_periods(years))
    return cut_lineage(with_gross_profit(cut_lineage(cells)))


# --- Share counts -------------------------------------------------------------------------


def shares_cover(facts: DataFrame, as_of=None) -> DataFrame:
    """Latest cover-page count, share classes of one filing summed."""
    cover = public(facts, as_of).where(
        (F.col("taxonomy") == "dei") & (F.col("concept") == COVER_CONCEPT)
    )
    filings = cover.groupBy("company", "period_end", "accession").agg(
        F.sum("value").alias("shares"),
        F.max("filed_date").alias("filed_date"),
        F.count(F.lit(1)).alias("classes"),
    )
    order = F.struct("period_end", "filed_date", "accession")
    best = F.max_by(F.struct("shares", "period_end", "filed_date", "classes"), order).alias("b")
    return filings.groupBy("company").agg(best).select("company", "b.*")


def shares_reported(facts: DataFrame, concept: str, *, quarter: bool, as_of=None) -> DataFrame:
    """Latest reported share count of a concept: an instant, or a three-month span."""
    rows = public(facts, as_of).where(
        (F.col("taxonomy") == "us-gaap") & (F.col("concept") == concept)
    )
    rows = rows.where(is_quarter() if quarter else F.col("period_start").isNull())
    best = F.max_by(
        F.struct(F.col("value").alias("shares"), "period_end", "filed_date", F.lit(1).cast("bigint").alias("classes")),
        F.struct("period_end", "filed_date", "accession"),
    ).alias("b")
    return rows.groupBy("company").agg(best).select("company", "b.*")


def shares_for_market_cap(facts: DataFrame, reference: DataFrame, as_of=None) -> DataFrame:
    """Share count for each company's reference day, from the first source that is positive and
    at most 400 days away: cover page, balance sheet, weighted basic."""
    adjusted = split_adjusted(facts, as_of)
    sources = (
        ("cover-page", shares_cover(adjusted, as_of)),
        ("balance-sheet", shares_reported(adjusted, "CommonStockSharesOutstanding", quarter=False, as_of=as_of)),
        (
            "weighted-average basic",
            shares_reported(adjusted, "WeightedAverageNumberOfSharesOutstandingBasic", quarter=True, as_of=as_of),
        ),
    )
    union = None
    for place, (name, counts) in enumerate(sources):
        rows = counts.select(
            "company", F.col("shares").cast("decimal(38,10)").alias("shares"), "period_end", "filed_date", "classes",
            F.lit(name).alias("source"), F.lit(place).alias("place"),
        )
        union = rows if union is None else union.unionByName(rows)
    near = F.abs(F.datediff("reference", "period_end")) <= MAX_SHARE_AGE_DAYS
    usable = union.join(reference, "company").where((F.col("shares") > 0) & near)
    best = F.min_by(F.struct("shares", "period_end", "filed_date", "classes", "source"), "place")
    return usable.groupBy("company").agg(best.alias("b")).select("company", "b.*")

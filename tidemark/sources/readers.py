"""Schema'd readers: raw provider text in, typed rows out. Bad rows are flagged, not repaired.

Each reader takes a DataFrame of raw text (a `payload` column, or string columns as a CSV/TSV
scan gives them) and returns rows with `ok`; `accepted` and `rejected_count` split them. Parsing
stays in the JVM: from_json, from_xml and built-in casts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lookups import ACCEPTED_FORMS, tracked_concepts

ACCESSION = r"^\d{10}-\d{2}-\d{6}$"


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON or XML documents as payload rows."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))


def tab_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header and no quoting, every column a string."""
    return spark.read.csv(path, sep="\t", header=True, quote="")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("ok").drop("ok")


def rejected_count(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected")
    )


def iso_date(value: Column) -> Column:
    """A plain ISO date; null for anything else."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))


def clean(value: Column, size: int) -> Column:
    """Trimmed, clipped text; null when empty."""
    text = F.substring(F.trim(value), 1, size)
    return F.when(text != "", text)


def digits(value: Column) -> Column:
    return F.when(value.rlike(r"^\d+$"), value)


def _number(value: Column, kind: str = "double") -> Column:
    number = value.try_cast(kind)
    if kind == "double":
        return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return number


# --- Filed facts --------------------------------------------------------------------------

_ENTRY = "struct<start:string,end:string,val:string,accn:string,fy:string,fp:string,form:string,filed:string>"
_FACTS = (
    "struct<cik:string,facts:map<string,map<string,struct<units:map<string,array<"
    + _ENTRY
    + ">>>>>>"
)


def facts(payloads: DataFrame) -> DataFrame:
    """Entries of tracked concepts in accepted forms, with `ok` false for malformed ones."""
    table = payloads.sparkSession.createDataFrame(
        tracked_concepts(), "taxonomy string, concept string, unit string"
    )
    tree = payloads.select(F.from_json("payload", _FACTS).alias("doc"))
    level = tree.select("doc.cik", F.explode("doc.facts").alias("taxonomy", "concepts"))
    level = level.select("cik", "taxonomy", F.explode("concepts").alias("concept", "body"))
    level = level.select("cik", "taxonomy", "concept", F.explode("body.units").alias("unit", "entries"))
    kept = level.join(F.broadcast(table), ["taxonomy", "concept", "unit"])  # fixed list
    entry = kept.select("cik", "taxonomy", "concept", "unit", F.explode("entries").alias("e"))
    entry = entry.where(F.col("e.form").isin(*ACCEPTED_FORMS))
    rows = entry.select(
        F.col("cik").try_cast("bigint").alias("company"),
        "taxonomy", "concept", "unit",
        iso_date(F.col("e.start")).alias("period_start"),
        iso_date(F.col("e.end")).alias("period_end"),
        F.col("e.val").try_cast("decimal(38,10)").alias("value"),
        digits(F.col("e.fy")).try_cast("int").alias("fiscal_year"),
        F.substring("e.fp", 1, 4).alias("fiscal_period"),
        F.col("e.form").alias("form"),
        F.substring("e.accn", 1, 25).alias("accession"),
        iso_date(F.col("e.filed")).alias("filed_date"),
    )
    ok = (
        F.col("period_end").isNotNull()
        & F.col("filed_date").isNotNull()
        & (F.coalesce("accession", F.lit("")) != "")
        & F.col("value").isNotNull()
        & (F.col("period_start").isNull() | (F.col("period_start") <= F.col("period_end")))
        & (F.col("filed_date") >= F.col("period_end"))
    )
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


FACT_IDENTITY = ["company", "taxonomy", "concept", "unit", "period_start", "period_end", "value"]


def earliest_facts(rows: DataFrame) -> DataFrame:
    """The filing in which each value first became public; restated values stay separate rows."""
    first = F.min(
        F.struct("filed_date", "accession", "form", "fiscal_year", "fiscal_period")
    ).alias("_first")
    return accepted(rows).groupBy(*FACT_IDENTITY).agg(first).select(*FACT_IDENTITY, "_first.*")


_FRAME = "struct<data:array<struct<cik:string,entityName:string,accn:string,end:string,val:string>>>"


def frames(payloads: DataFrame) -> DataFrame:
    row = payloads.select(F.explode(F.from_json("payload", _FRAME)["data"]).alias("r"))
    rows = row.select(
        F.col("r.cik").try_cast("bigint").alias("company"),
        F.substring("r.entityName", 1, 240).alias("name"),
        F.col("r.accn").alias("accession"),
        iso_date(F.col("r.end")).alias("period_end"),
        _number(F.col("r.val")).alias("value"),
    )
    needed = ("company", "accession", "period_end", "value")
    ok = F.lit(True)
    for column in needed:
        ok = ok & F.col(column).isNotNull()
    return rows.withColumn("ok", ok)


# --- Filing index and profiles ------------------------------------------------------------

_INDEX_COLUMNS = (
    "accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime",
    "primaryDocument", "primaryDocDescription", "items", "size", "isXBRL",
)


def filing_index(payloads: DataFrame) -> DataFrame:
    """Rows of a columnar filing index; accession, form and filing day must be valid."""
    schema = "struct<" + ",".join(f"{c}:array<string>" for c in _INDEX_COLUMNS) + ">"
    doc = payloads.select(F.from_json("payload", schema).alias("d"))
    none = F.array().cast("array<string>")
    arrays = doc.select(*[F.coalesce(f"d.{c}", none).alias(c) for c in _INDEX_COLUMNS])
    zipped = F.arrays_zip(*_INDEX_COLUMNS)
    r = arrays.select(F.explode(zipped).alias("r"))
    rows = r.select(
        F.col("r.accessionNumber").alias("accession"),
        clean(F.col("r.form"), 20).alias("form"),
        iso_date(F.col("r.filingDate")).alias("filed_date"),
        iso_date(F.col("r.reportDate")).alias("report_date"),
        F.col("r.acceptanceDateTime").try_cast("timestamp").alias("accepted_at"),
        clean(F.col("r.primaryDocument"), 300).alias("document"),
        clean(F.col("r.primaryDocDescription"), 300).alias("description"),
        clean(F.col("r.items"), 120).alias("items"),
        digits(F.col("r.size")).try_cast("bigint").alias("size"),
        F.col("r.isXBRL").isin("1", "true").alias("is_xbrl"),
    )
    ok = (
        F.col("accession").rlike(ACCESSION)
        & F.col("form").isNotNull()
        & F.col("filed_date").isNotNull()
    )
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


_PROFILE = (
    "struct<cik:string,name:string,entityType:string,sic:string,sicDescription:string,"
    "category:string,stateOfIncorporation:string,stateOfIncorporationDescription:string,"
    "fiscalYearEnd:string,website:string,description:string,"
    "addresses:struct<business:struct<city:string,stateOrCountryDescription:string,"
    "isForeignLocation:string>>,formerNames:array<struct<name:string,from:string,to:string>>,"
    "tickers:array<string>,exchanges:array<string>>"
)


def profiles(payloads: DataFrame) -> DataFrame:
    """Submission profiles: trimmed and clipped text, digit checks, usable former names."""
    doc = payloads.select(F.from_json("payload", _PROFILE).alias("p"))
    flag = F.col("p.addresses.business.isForeignLocation")
    state = F.coalesce(
        F.nullif(F.col("p.stateOfIncorporationDescription"), F.lit("")),
        F.col("p.stateOfIncorporation"),
    )
    return doc.select(
        F.col("p.cik").try_cast("bigint").alias("company"),
        clean(F.col("p.name"), 240).alias("name"),
        clean(F.col("p.entityType"), 40).alias("entity_type"),
        digits(clean(F.col("p.sic"), 4)).alias("sic_code"),
        clean(F.col("p.sicDescription"), 160).alias("sic_description"),
        clean(F.col("p.category"), 80).alias("filer_category"),
        clean(state, 80).alias("state"),
        digits(clean(F.col("p.fiscalYearEnd"), 4)).alias("fiscal_year_end"),
        clean(F.col("p.website"), 300).alias("website"),
        clean(F.col("p.addresses.business.city"), 120).alias("hq_city"),
        F.when(flag.isNotNull(), flag.isin("1", "true")).alias("hq_is_foreign"),
        F.filter("p.formerNames", lambda n: F.coalesce(n["name"], F.lit("")) != "").alias(
            "former_names"
        ),
        F.transform(F.coalesce("p.tickers", F.array().cast("array<string>")), F.upper).alias(
            "tickers"
        ),
    )


# --- Market and macro data ----------------------------------------------------------------

_BAR = (
    "struct<date:string,open:string,high:string,low:string,close:string,volume:string,"
    "adjClose:string,divCash:string,splitFactor:string,volumeNotional:string,tradesDone:string>"
)


def bars(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Bars from JSON objects; price fields and the volume are required."""
    r = payloads.select(*keys, F.from_json("payload", _BAR).alias("r"))
    rows = r.select(
        *keys,
        F.substring("r.date", 1, 10).try_cast("date").alias("trade_date"),
        *[_number(F.col(f"r.{c}")).alias(c) for c in ("open", "high", "low", "close", "volume")],
        _number(F.col("r.adjClose")).alias("adj_close"),
        _number(F.col("r.divCash")).alias("dividend_cash"),
        _number(F.col("r.splitFactor")).alias("split_factor"),
    )
    return rows.withColumn("ok", _required("trade_date", "open", "high", "low", "close", "volume"))


def crypto_bars(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Daily bars of a crypto pair with quote volume and trade count."""
    r = payloads.select(*keys, F.from_json("payload", _BAR).alias("r"))
    rows = r.select(
        *keys,
        F.substring("r.date", 1, 10).try_cast("date").alias("trade_date"),
        *[_number(F.col(f"r.{c}")).alias(c) for c in ("open", "high", "low", "close", "volume")],
        _number(F.col("r.volumeNotional")).alias("volume_usd"),
        digits(F.col("r.tradesDone")).try_cast("bigint").alias("trades"),
    )
    return rows.withColumn("ok", _required("trade_date", "open", "high", "low", "close", "volume"))


def _required(*columns: str) -> Column:
    ok = F.lit(True)
    for column in columns:
        ok = ok & F.col(column).isNotNull()
    return ok


def bar_problems() -> Column:
    """Reasons a bar is structurally impossible; an empty array means it is good."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    reasons = {
        "non_positive_price": F.least(o, h, l, c) <= 0,
        "high_below_range": h < F.greatest(o, c, l),
        "low_above_range": l > F.least(o, c, h),
        "negative_volume": F.col("volume") < 0,
        "non_positive_split_factor": F.col("split_factor") <= 0,
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in reasons.items()]))


def bar_quality(rows: DataFrame) -> DataFrame:
    """Bars with their problems and `ok`."""
    found = rows.withColumn("problems", bar_problems())
    return found.withColumn("ok", F.size("problems") == 0)


def problem_counts(rows: DataFrame) -> DataFrame:
    bad = rows.where(~F.col("ok"))
    return bad.select(F.explode("problems").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("bars")
    )


_VINTAGE = "struct<observations:array<struct<date:string,realtime_start:string,realtime_end:string,value:string>>>"


def vintages(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Macro vintages; "." marks a missing value and is left out without being counted."""
    r = payloads.select(*keys, F.explode(F.from_json("payload", _VINTAGE)["observations"]).alias("r"))
    rows = r.where(~F.col("r.value").eqNullSafe(".")).select(
        *keys,
        iso_date(F.col("r.date")).alias("observation_date"),
        iso_date(F.col("r.realtime_start")).alias("realtime_start"),
        iso_date(F.col("r.realtime_end")).alias("realtime_end"),
        F.col("r.value").try_cast("double").alias("value"),
    )
    return rows.withColumn(
        "ok", _required("observation_date", "realtime_start", "realtime_end", "value")
    )


def yield_curves(wide: DataFrame, day: str = "Date") -> DataFrame:
    """A wide yield table (strings) as (day, tenor, decimal value); outliers are rejected."""
    tenors = [c for c in wide.columns if c != day]
    long = wide.unpivot([day], tenors, "tenor", "raw").where(
        F.col("raw").isNotNull() & (F.col("raw") != "")
    )
    percent = F.col("raw").try_cast("double")
    observed = F.try_to_timestamp(F.col(day), F.lit("MM/dd/yyyy")).cast("date")
    ok = observed.isNotNull() & (percent > -5) & (percent < 30)
    return long.select(
        observed.alias("observed_on"),
        F.trim("tenor").alias("tenor"),
        (percent / 100).alias("value"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


# --- Ownership ----------------------------------------------------------------------------


def _data_set_day(name: str) -> Column:
    return F.try_to_timestamp(F.initcap(F.trim(name)), F.lit("dd-MMM-yyyy")).cast("date")


def ownership_filings(submission: DataFrame, cover: DataFrame) -> DataFrame:
    """Manager filings of the data set with their kind; other form types are left out."""
    kinds = ("13F-HR", "13F-HR/A")
    filed = submission.where(F.col("SUBMISSIONTYPE").isin(*kinds)).select(
        "ACCESSION_NUMBER",
        F.col("CIK").try_cast("bigint").alias("manager"),
        _data_set_day("FILING_DATE").alias("filed"),
        _data_set_day("PERIODOFREPORT").alias("period"),
        (F.col("SUBMISSIONTYPE") == kinds[0]).alias("_original"),
    )
    filed = filed.where(
        F.col("manager").isNotNull() & F.col("filed").isNotNull() & F.col("period").isNotNull()
    )
    joined = filed.join(cover, "ACCESSION_NUMBER", "left").withColumn(
        "_type", F.upper("AMENDMENTTYPE")
    )
    covered = F.col("FILINGMANAGER_NAME").isNotNull() | F.col("AMENDMENTTYPE").isNotNull()
    kind = (
        F.when(F.col("_original"), "original")
        .when(F.col("_type").contains("RESTATEMENT"), "restatement")
        .when(covered, "new_holdings")
    )
    return joined.select(
        F.col("ACCESSION_NUMBER").alias("accession"), "manager", "filed", "period",
        kind.alias("kind"), F.substring(F.trim("FILINGMANAGER_NAME"), 1, 200).alias("name"),
    )


def ownership_rows(info: DataFrame) -> DataFrame:
    """Holding rows of the information table; bad identifiers and amounts are rejected."""
    rows = info.select(
        F.col("ACCESSION_NUMBER").alias("accession"),
        F.upper(F.trim("CUSIP")).alias("cusip"),
        F.substring(F.trim("NAMEOFISSUER"), 1, 200).alias("issuer"),
        F.col("VALUE").try_cast("decimal(24,4)").alias("value"),
        F.col("SSHPRNAMT").try_cast("decimal(24,4)").alias("amount"),
        F.trim("SSHPRNAMTTYPE").alias("amount_type"),
        F.nullif(F.trim("PUTCALL"), F.lit("")).alias("put_call"),
    )
    ok = (
        (F.length("cusip") == 9)
        & F.col("value").isNotNull()
        & F.col("amount").isNotNull()
        & (F.col("value") >= 0)
    )
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def pick_listing(candidates: DataFrame) -> DataFrame:
    """Per cusip: the US composite listing, else one with a ticker, else the first offered."""
    has_ticker = F.coalesce("ticker", F.lit("")) != ""
    rank = F.when((F.col("exch_code") == "US") & has_ticker, 0).when(has_ticker, 1).otherwise(2)
    rest = [c for c in candidates.columns if c != "cusip"]
    best = F.min_by(F.struct(*rest), F.struct(rank, F.col("ordinal"))).alias("_best")
    return candidates.groupBy("cusip").agg(best).select("cusip", "_best.*")


# --- Headlines ----------------------------------------------------------------------------


def plain_title(title: Column) -> Column:
    """Undo a headline feed's token spacing ("$1 , 999" → "$1,999")."""
    # The spacings to undo, in order.
    steps = (
        (r"\s+", " "),
        (r"(\d)\s*,\s*(?=\d{3}\b)", "$1,"),
        (r"(\d)\s*\.\s+(\d)", "$1.$2"),
        (r"\s+([,.:;!?%)\]])", "$1"),
        (r"([(\[$])\s+", "$1"),
        (r"(\w)\s+-\s+(\w)", "$1-$2"),
        (r"(?i)(\w)\s+'\s*(s|t|re|ve|ll|d|m)\b", "$1'$2"),
    )
    text = F.trim(title)
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(F.replace(text, F.lit(" : "), F.lit(": ")))


_ARTICLES = (
    "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string,"
    "language:string,sourcecountry:string>>>"
)


def articles(payloads: DataFrame) -> DataFrame:
    """Headlines; the address, a title and the time seen are required."""
    r = payloads.select(F.explode(F.from_json("payload", _ARTICLES)["articles"]).alias("r"))
    seen = F.try_to_timestamp(F.col("r.seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    rows = r.select(
        F.col("r.url").alias("url"),
        F.substring(plain_title(F.coalesce("r.title", F.lit(""))), 1, 500).alias("title"),
        F.nullif(F.substring("r.domain", 1, 200), F.lit("")).alias("domain"),
        F.nullif(F.substring("r.language", 1, 40), F.lit("")).alias("language"),
        F.nullif(F.substring("r.sourcecountry", 1, 80), F.lit("")).alias("country"),
        seen.alias("seen_at"),
    )
    ok = (
        F.col("url").rlike("^https?://")
        & (F.col("title") != "")
        & F.col("seen_at").isNotNull()
    )
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


# --- Insider forms ------------------------------------------------------------------------

_VALUE = "struct<value:string>"
_TRANSACTION = f"""struct<securityTitle:{_VALUE},transactionDate:{_VALUE},
    transactionCoding:struct<transactionCode:string>,
    transactionAmounts:struct<transactionShares:{_VALUE},transactionPricePerShare:{_VALUE},
        transactionAcquiredDisposedCode:{_VALUE}>,
    postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_VALUE}>,
    ownershipNature:struct<directOrIndirectOwnership:{_VALUE},natureOfOwnership:{_VALUE}>,
    conversionOrExercisePrice:{_VALUE},
    underlyingSecurity:struct<underlyingSecurityTitle:{_VALUE}>>"""
_OWNERSHIP = f"""struct<issuer:struct<issuerCik:string>,aff10b5One:string,
    reportingOwner:array<struct<
        reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,
        reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,
            isTenPercentOwner:string,isOther:string,officerTitle:string>>>,
    nonDerivativeTable:struct<nonDerivativeTransaction:array<{_TRANSACTION}>>,
    derivativeTable:struct<derivativeTransaction:array<{_TRANSACTION}>>>""".replace("\n", " ")


def _truth(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true"), F.lit(False))


def insider_forms(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Transactions of ownership documents with their owners; one row per transaction."""
    schema = " ".join(_OWNERSHIP.split())
    doc = payloads.select(*keys, F.from_xml("payload", schema).alias("d"))
    owners = F.transform(
        "d.reportingOwner",
        lambda o: F.struct(
            o["reportingOwnerId"]["rptOwnerCik"].try_cast("bigint").alias("cik"),
            F.coalesce(
                F.substring(o["reportingOwnerId"]["rptOwnerName"], 1, 200), F.lit("Unknown")
            ).alias("name"),
            _truth(o["reportingOwnerRelationship"]["isDirector"]).alias("is_director"),
            _truth(o["reportingOwnerRelationship"]["isOfficer"]).alias("is_officer"),
            _truth(o["reportingOwnerRelationship"]["isTenPercentOwner"]).alias("is_ten_percent"),
            F.substring(o["reportingOwnerRelationship"]["officerTitle"], 1, 200).alias("title"),
        ),
    )
    head = doc.select(
        *keys, F.col("d.issuer.issuerCik").try_cast("bigint").alias("issuer"),
        owners.alias("owners"), "d",
    )

    def table(path: str, derivative: bool) -> DataFrame:
        t = head.select(*keys, "issuer", "owners", F.posexplode(f"d.{path}").alias("ordinal", "t"))
        money = lambda c: F.regexp_replace(F.col(c), ",", "").try_cast("decimal(24,6)")
        exercise = money("t.conversionOrExercisePrice.value")
        return t.select(
            *keys, "issuer", "owners", F.lit(derivative).alias("is_derivative"), "ordinal",
            F.substring("t.securityTitle.value", 1, 200).alias("security"),
            F.substring("t.transactionDate.value", 1, 10).try_cast("date").alias("tx_date"),
            F.substring("t.transactionCoding.transactionCode", 1, 4).alias("code"),
            money("t.transactionAmounts.transactionShares.value").alias("shares"),
            money("t.transactionAmounts.transactionPricePerShare.value").alias("price"),
            F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value").alias("side"),
            money("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value").alias("after"),
            (exercise if derivative else F.lit(None).cast("decimal(24,6)")).alias("exercise_price"),
        )

    plain = table("nonDerivativeTable.nonDerivativeTransaction", False)
    return plain.unionByName(table("derivativeTable.derivativeTransaction", True))

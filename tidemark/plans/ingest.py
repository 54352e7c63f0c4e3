"""Reader and sink queries. Raw payloads are composed row by row from the tables, then parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import readers as R
from tidemark.sources import sinks as K
from tidemark.plans.base import big, q, qc, query
from tidemark.sources.views import Tables


def _text(day: str):
    return F.date_format(day, "yyyy-MM-dd")


def _json(*columns, alias: str = "payload"):
    return F.to_json(F.struct(*columns)).alias(alias)


# --- Facts and filings --------------------------------------------------------------------


def _fact_payloads(t: Tables):
    """One companyfacts document per line item."""
    orders = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("ordered"))
    rows = t.lineitem.join(orders, F.expr("l_orderkey = o_orderkey"))
    concept = (
        F.when(F.col("l_returnflag") == "R", "Revenues")
        .when(F.col("l_returnflag") == "A", "NetIncomeLoss")
        .otherwise("Untracked")
    )
    value = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    )
    form = F.when(F.col("l_linestatus") == "F", "10-K").when(
        F.col("l_quantity") < 10, "8-K"
    ).otherwise("10-Q")
    start = F.when(F.col("l_quantity") > 25, F.date_format(F.trunc("ordered", "month"), "yyyy-MM-dd"))
    entry = F.struct(
        start.alias("start"), _text("ordered").alias("end"), value.alias("val"),
        F.col("l_orderkey").cast("string").alias("accn"), F.year("ordered").alias("fy"),
        F.lit("FY").alias("fp"), form.alias("form"), _text("l_shipdate").alias("filed"),
    )
    body = F.struct(F.create_map(F.lit("USD"), F.array(entry)).alias("units"))
    tree = F.create_map(F.lit("us-gaap"), F.create_map(concept, body))
    return rows.select(_json(F.col("l_suppkey").alias("cik"), tree.alias("facts")))


_FACT_ROWS = """rows AS (SELECT l_suppkey AS company, CASE l_returnflag WHEN 'R' THEN 'Revenues'
        ELSE 'NetIncomeLoss' END AS concept,
        CASE WHEN l_quantity > 25 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END
            AS period_start,
        CAST(o_orderdate AS DATE) AS period_end, l_extendedprice AS value, l_linenumber,
        CAST(l_orderkey AS VARCHAR) AS accession, CAST(l_shipdate AS DATE) AS filed_date,
        CASE WHEN l_linestatus = 'F' THEN '10-K' WHEN l_quantity < 10 THEN '8-K' ELSE '10-Q' END
            AS form FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_returnflag <> 'N'),
    kept AS (SELECT *, l_linenumber <> 7 AND filed_date >= period_end AS ok FROM rows
        WHERE form <> '8-K')"""


@query(
    "src_facts",
    f"""WITH {_FACT_ROWS}, best AS (SELECT company, concept, period_start, period_end, value,
            min(row(filed_date, accession)) AS b FROM kept WHERE ok GROUP BY ALL)
        SELECT company, concept, period_start, period_end, value, b[1] AS filed_date,
            b[2] AS accession FROM best""",
)
def src_facts(t: Tables):
    return R.earliest_facts(R.facts(_fact_payloads(t))).select(
        "company", "concept", "period_start", "period_end",
        F.col("value").cast("double").alias("value"), "filed_date", "accession",
    )


@query(
    "src_facts_rejects",
    f"""WITH {_FACT_ROWS} SELECT count(*) FILTER (ok) AS accepted,
        count(*) FILTER (NOT ok) AS rejected FROM kept""",
)
def src_facts_rejects(t: Tables):
    return R.rejected_count(R.facts(_fact_payloads(t)))


@query(
    "src_frames",
    """SELECT o_custkey AS company, 'Firm ' || CAST(o_custkey AS VARCHAR) AS name,
        CAST(o_orderkey AS VARCHAR) AS accession, CAST(o_orderdate AS DATE) AS period_end,
        o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P'""",
)
def src_frames(t: Tables):
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    row = F.struct(
        F.col("o_custkey").alias("cik"),
        F.concat(F.lit("Firm "), F.col("o_custkey").cast("string")).alias("entityName"),
        F.col("o_orderkey").cast("string").alias("accn"),
        _text("o_orderdate").alias("end"),
        F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(price).alias("val"),
    )
    payloads = t.orders.select(_json(F.array(row).alias("data")))
    return R.accepted(R.frames(payloads))


@query(
    "src_filing_index",
    """WITH r AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-99-'
            || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS accession,
            '10-K' AS form, CAST(o_orderdate AS DATE) AS filed_date, o_orderpriority FROM orders)
        SELECT accession, form, filed_date, 'annual report' AS description, count(*) AS copies
        FROM r WHERE o_orderpriority NOT IN ('5-LOW', '2-HIGH') GROUP BY ALL""",
)
def src_filing_index(t: Tables):
    good = F.concat(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-99-"),
        F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"),
    )
    accession = F.when(F.col("o_orderpriority") == "5-LOW", "bad").otherwise(good)
    day = F.when(F.col("o_orderpriority") == "2-HIGH", "soon").otherwise(_text("o_orderdate"))
    payloads = t.orders.select(
        _json(
            F.array(accession, F.lit("x")).alias("accessionNumber"),
            F.array(F.lit(" 10-K "), F.lit("8-K")).alias("form"),
            F.array(day, day).alias("filingDate"),
            F.array(F.lit("annual report ")).alias("primaryDocDescription"),
        )
    )
    rows = R.accepted(R.filing_index(payloads))
    return rows.groupBy("accession", "form", "filed_date", "description").agg(
        F.count(F.lit(1)).alias("copies")
    )


def _profile_payloads(t: Tables):
    sic = (F.col("s_suppkey") * 97 % 10000).cast("string")
    sic = F.when(F.col("s_suppkey") % 4 == 0, "n/a").otherwise(F.lpad(sic, 4, "0"))
    business = F.struct(
        F.lit(" Springfield ").alias("city"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 3 == 1).alias("isForeignLocation"),
    )
    former = F.array(F.struct(F.lit("").alias("name")), F.struct(F.col("s_name").alias("name")))
    return t.supplier.select(
        _json(
            F.col("s_suppkey").alias("cik"),
            F.concat(F.lit("  "), F.col("s_name")).alias("name"),
            sic.alias("sic"),
            F.lit("12311").alias("fiscalYearEnd"),
            F.struct(business.alias("business")).alias("addresses"),
            former.alias("formerNames"),
            F.array(F.concat(F.lit("t"), F.col("s_suppkey").cast("string"))).alias("tickers"),
        )
    )


_PROFILES = """profiles AS (SELECT s_suppkey AS company, s_name AS name,
    CASE WHEN s_suppkey % 4 <> 0 THEN lpad(CAST(s_suppkey * 97 % 10000 AS VARCHAR), 4, '0') END
        AS sic_code,
    CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 3 = 1 END AS hq_is_foreign FROM supplier)"""


@query(
    "src_profile",
    f"""WITH {_PROFILES} SELECT company, name, sic_code, hq_is_foreign, '1231' AS fiscal_year_end,
        'Springfield' AS hq_city, name AS former_name, 'T' || CAST(company AS VARCHAR) AS ticker
        FROM profiles""",
)
def src_profile(t: Tables):
    return R.profiles(_profile_payloads(t)).select(
        "company", "name", "sic_code", "hq_is_foreign", "fiscal_year_end", "hq_city",
        F.col("former_names")[0]["name"].alias("former_name"), F.col("tickers")[0].alias("ticker"),
    )


# --- Market data --------------------------------------------------------------------------


def _bar_payloads(t: Tables):
    close = F.when(F.dayofmonth("trade_date") == 13, F.lit(None)).otherwise(F.col("close"))
    return t.bars().select(
        "security_id",
        _json(
            F.concat(_text("trade_date"), F.lit("T00:00:00.000Z")).alias("date"),
            "open", "high", "low", close.alias("close"), F.col("volume").cast("bigint").alias("volume"),
            F.col("dividend_cash").alias("divCash"), F.col("split_factor").alias("splitFactor"),
        ),
    )


@query(
    "src_bars",
    f"""SELECT security_id, trade_date, {q('open')} AS open, {q('close')} AS close, volume,
        CAST(split_factor AS DOUBLE) AS split_factor FROM v_bars WHERE day(trade_date) <> 13""",
)
def src_bars(t: Tables):
    rows = R.accepted(R.bars(_bar_payloads(t), ["security_id"]))
    return rows.select(
        "security_id", "trade_date", qc("open"), qc("close"), "volume", "split_factor"
    )


def _doubtful_bars(t: Tables):
    """Bars with faults planted by day of month."""
    day = F.dayofmonth("trade_date")
    return t.bars().select(
        "security_id", "trade_date", "open", "close",
        F.when(day == 3, F.lit(0.0)).otherwise(F.col("low")).alias("low"),
        F.when(day == 5, F.col("low") / 2).otherwise(F.col("high")).alias("high"),
        F.when(day == 7, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        F.when(day == 9, F.lit(0.0)).otherwise(F.col("split_factor")).alias("split_factor"),
    )


_DOUBTFUL = """d AS (SELECT security_id, trade_date, open, close,
        CASE WHEN day(trade_date) = 3 THEN 0.0 ELSE low END AS low,
        CASE WHEN day(trade_date) = 5 THEN low / 2 ELSE high END AS high,
        CASE WHEN day(trade_date) = 7 THEN -volume ELSE volume END AS volume,
        CASE WHEN day(trade_date) = 9 THEN 0.0 ELSE split_factor END AS split_factor FROM v_bars),
    p AS (SELECT 'non_positive_price' AS reason FROM d WHERE least(open, high, low, close) <= 0
        UNION ALL SELECT 'high_below_range' FROM d WHERE high < greatest(open, close, low)
        UNION ALL SELECT 'low_above_range' FROM d WHERE low > least(open, close, high)
        UNION ALL SELECT 'negative_volume' FROM d WHERE volume < 0
        UNION ALL SELECT 'non_positive_split_factor' FROM d WHERE split_factor <= 0)"""


@query("bar_quality", f"WITH {_DOUBTFUL} SELECT reason, count(*) AS bars FROM p GROUP BY 1")
def bar_quality(t: Tables):
    return R.problem_counts(R.bar_quality(_doubtful_bars(t)))


@query(
    "src_macro",
    """SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS observation_date,
        CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS realtime_start,
        o_totalprice AS value FROM orders WHERE o_orderkey % 10 > 1""",
)
def src_macro(t: Tables):
    value = (
        F.when(F.col("tie") % 10 == 0, ".")
        .when(F.col("tie") % 10 == 1, "bad")
        .otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    )
    row = F.struct(
        _text("observation_date").alias("date"), _text("realtime_start").alias("realtime_start"),
        F.lit("9999-12-31").alias("realtime_end"), value.alias("value"),
    )
    payloads = t.macro().select("series", _json(F.array(row).alias("observations")))
    rows = R.accepted(R.vintages(payloads, ["series"]))
    return rows.select("series", "observation_date", "realtime_start", "value")


@query(
    "src_yield",
    f"""SELECT observed_on, tenor, {q('value * 2500 / 100')} AS value FROM v_yield
        WHERE value * 2500 < 30""",
)
def src_yield(t: Tables):
    percent = (F.col("value") * 2500).cast("string")
    tenors = ["1 Mo", "3 Mo", "2 Yr", "10 Yr", "30 Yr"]
    wide = (
        t.yields()
        .withColumn("percent", percent)
        .groupBy(F.date_format("observed_on", "MM/dd/yyyy").alias("Date"))
        .agg(*[F.max(F.when(F.col("tenor") == n, F.col("percent"))).alias(n) for n in tenors])
    )
    return R.accepted(R.yield_curves(wide)).select("observed_on", "tenor", qc("value"))


def _data_set(t: Tables):
    """The three tables of a quarterly ownership data set, as a TSV scan gives them."""
    form = F.when(F.col("kind") == "original", "13F-HR").otherwise("13F-HR/A")
    day = lambda c: F.upper(F.date_format(c, "dd-MMM-yyyy"))
    h = t.holdings()
    filings = h.select("accession", "manager", "filed", "period", "kind").distinct()
    submission = filings.select(
        F.col("accession").cast("string").alias("ACCESSION_NUMBER"),
        F.col("manager").cast("string").alias("CIK"), form.alias("SUBMISSIONTYPE"),
        day("filed").alias("FILING_DATE"), day("period").alias("PERIODOFREPORT"),
    )
    cover = filings.select(
        F.col("accession").cast("string").alias("ACCESSION_NUMBER"),
        F.when(F.col("kind") == "restatement", "RESTATEMENT").otherwise("NEW HOLDINGS").alias("AMENDMENTTYPE"),
        F.concat(F.lit(" Manager "), F.col("manager").cast("string")).alias("FILINGMANAGER_NAME"),
    )
    info = h.select(
        F.col("accession").cast("string").alias("ACCESSION_NUMBER"),
        F.lpad(F.col("cusip").cast("string"), 9, "0").alias("CUSIP"),
        F.lit("Issuer").alias("NAMEOFISSUER"),
        F.when(F.col("amount") > 48, "?").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("VALUE"),
        F.col("amount").cast("decimal(18,0)").cast("string").alias("SSHPRNAMT"),
        F.col("amount_type").alias("SSHPRNAMTTYPE"),
        F.col("put_call").alias("PUTCALL"),
    )
    return submission, cover, info


@query(
    "src_13f",
    """SELECT manager, kind, period, count(*) FILTER (amount <= 48) AS positions,
        count(*) FILTER (amount > 48) AS rejected,
        CAST(sum(CASE WHEN amount <= 48 THEN amount END) AS DOUBLE) AS amount,
        'Manager ' || CAST(manager AS VARCHAR) AS name FROM v_holdings GROUP BY 1, 2, 3""",
)
def src_13f(t: Tables):
    submission, cover, info = _data_set(t)
    filings = R.ownership_filings(submission, cover)
    rows = R.ownership_rows(info).join(filings, "accession")
    return rows.groupBy("manager", "kind", "period", "name").agg(
        F.count_if("ok").alias("positions"),
        F.count_if(~F.col("ok")).alias("rejected"),
        F.sum(F.when(F.col("ok"), F.col("amount"))).cast("double").alias("amount"),
    )


@query(
    "src_news",
    """SELECT event_id AS article, 'http://example.com/' || CAST(event_id AS VARCHAR) AS url,
        'Shares (NYSE: ABC) rise to $1,250.5 as it''s up-' || event_type AS title,
        CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) AS seen_us FROM events
        WHERE event_type <> 'error'""",
)
def src_news(t: Tables):
    title = F.concat(
        F.lit("Shares ( NYSE : ABC )  rise to $ 1 , 250 . 5 as it 's up -  "), F.col("event_type")
    )
    scheme = F.when(F.col("event_type") == "error", "ftp://").otherwise("http://")
    row = F.struct(
        F.concat(scheme, F.lit("example.com/"), F.col("event_id").cast("string")).alias("url"),
        title.alias("title"),
        F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"),
        F.lit("example.com").alias("domain"),
    )
    payloads = t.events.select(_json(F.array(row).alias("articles")))
    rows = R.accepted(R.articles(payloads))
    return rows.select(
        F.substring_index("url", "/", -1).cast("bigint").alias("article"), "url", "title",
        F.unix_micros("seen_at").alias("seen_us"),
    )


def _form4_payloads(t: Tables):
    return _form4_payloads_of(t.insider())


def _form4_payloads_of(insider):
    """One ownership document per transaction."""
    v = lambda tag, value: F.concat(F.lit(f"<{tag}><value>"), value, F.lit(f"</value></{tag}>"))
    s = lambda c: F.col(c).cast("string")
    xml = F.concat(
        F.lit("<ownershipDocument><issuer><issuerCik>"), s("company"),
        F.lit("</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>"), s("owner"),
        F.lit("</rptOwnerCik><rptOwnerName>Owner "), s("owner"),
        F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>"),
        (F.col("owner") % 2).cast("string"),
        F.lit("</isDirector><officerTitle>Chief</officerTitle></reportingOwnerRelationship>"),
        F.lit("</reportingOwner><nonDerivativeTable><nonDerivativeTransaction>"),
        v("securityTitle", F.lit("Common")), v("transactionDate", _text("tx_date")),
        F.lit("<transactionCoding><transactionCode>"), F.col("code"),
        F.lit("</transactionCode></transactionCoding><transactionAmounts>"),
        v("transactionShares", F.concat(F.lit("1,"), F.lpad(F.col("shares").cast("int").cast("string"), 3, "0"))),
        v("transactionPricePerShare", F.col("price").cast("decimal(12,2)").cast("string")),
        F.lit("</transactionAmounts></nonDerivativeTransaction></nonDerivativeTable>"),
        F.lit("</ownershipDocument>"),
    )
    return insider.select(F.col("tx_id").alias("accession"), xml.alias("payload"))


@query(
    "src_form4",
    """SELECT tx_id AS accession, company AS issuer, owner AS owner_cik,
        'Owner ' || CAST(owner AS VARCHAR) AS owner_name, owner % 2 = 1 AS is_director,
        code, tx_date, 1000 + shares AS shares, price FROM v_insider""",
)
def src_form4(t: Tables):
    rows = R.insider_forms(_form4_payloads(t), ["accession"])
    owner = F.col("owners")[0]
    return rows.select(
        "accession", "issuer", owner["cik"].alias("owner_cik"), owner["name"].alias("owner_name"),
        owner["is_director"].alias("is_director"), "code", "tx_date",
        F.col("shares").cast("double").alias("shares"), F.col("price").cast("double").alias("price"),
    )


@query(
    "cusip_pick",
    """SELECT cusip, ticker, exch_code, ordinal FROM (SELECT l_partkey % 500 AS cusip,
            CASE WHEN l_returnflag <> 'N' THEN 'T' || CAST(l_suppkey AS VARCHAR) END AS ticker,
            CASE WHEN l_suppkey % 20 = 0 THEN 'US' ELSE 'LN' END AS exch_code, ordinal,
            row_number() OVER (PARTITION BY l_partkey % 500 ORDER BY CASE WHEN l_returnflag = 'N'
                THEN 2 WHEN l_suppkey % 20 = 0 THEN 0 ELSE 1 END, ordinal) AS rk
            FROM (SELECT *, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber * 10
                + CAST(l_quantity AS BIGINT) AS ordinal FROM lineitem)) WHERE rk = 1""",
)
def cusip_pick(t: Tables):
    offers = t.lineitem.select(
        (F.col("l_partkey") % 500).alias("cusip"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("T"), F.col("l_suppkey").cast("string"))).alias("ticker"),
        F.when(F.col("l_suppkey") % 20 == 0, "US").otherwise("LN").alias("exch_code"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_linenumber") * 10
         + F.col("l_quantity").cast("bigint")).alias("ordinal"),
    )
    return R.pick_listing(offers)


# --- Sinks --------------------------------------------------------------------------------

_SPLIT = "DATE '1999-01-01'"


@query(
    "upsert_bars",
    f"""SELECT security_id, trade_date, CASE WHEN trade_date >= {_SPLIT} - 30 THEN close * 2
        ELSE close END AS close, CASE WHEN trade_date >= {_SPLIT} - 30 THEN 2 ELSE 1 END
        AS retrieved FROM v_raw_bars""",
)
def upsert_bars(t: Tables):
    bars = t.raw_bars().select("security_id", "trade_date", "close")
    cut = F.lit("1999-01-01").cast("date")
    stored = bars.where(F.col("trade_date") < cut).withColumn("retrieved", F.lit(1))
    late = bars.where(F.col("trade_date") >= F.date_sub(cut, 30))
    incoming = late.withColumn("close", F.col("close") * 2).withColumn("retrieved", F.lit(2))
    return K.upsert(stored, incoming, ["security_id", "trade_date"], ["retrieved"])


@query(
    "insert_ignore",
    """WITH stored AS (SELECT DISTINCT company, concept, period_end FROM v_facts
            WHERE filed_date < DATE '1998-01-01')
        SELECT company, concept, period_end, min(value) AS value FROM v_facts f
        WHERE filed_date >= DATE '1998-01-01' AND NOT EXISTS (SELECT 1 FROM stored s
            WHERE s.company = f.company AND s.concept = f.concept AND s.period_end = f.period_end)
        GROUP BY 1, 2, 3""",
)
def insert_ignore(t: Tables):
    facts = t.facts().select("company", "concept", "period_end", "value", "filed_date")
    cut = F.lit("1998-01-01").cast("date")
    stored = facts.where(F.col("filed_date") < cut)
    incoming = facts.where(F.col("filed_date") >= cut).drop("filed_date")
    return K.insert_ignore(stored, incoming, ["company", "concept", "period_end"])


def _directory(t: Tables):
    s = t.securities().where("is_active")
    snapshot = s.where("security % 7 != 0").select(
        "ticker", F.when(F.col("security") % 4 != 0, F.col("exchange")).alias("exchange"),
        F.col("company").alias("cik"), F.col("security").alias("ordinal"),
    )
    old = s.where("security % 5 != 0").groupBy(
        "ticker", F.when(F.col("security") % 4 != 0, F.col("exchange")).alias("exchange")
    ).agg(F.min("company").alias("cik"), (F.min("security") % 11 != 0).alias("from_directory"))
    return snapshot, old


@query(
    "dir_sync",
    """WITH s AS (SELECT *, CASE WHEN security % 4 <> 0 THEN exchange END AS exch
            FROM v_securities WHERE is_active),
        snap AS (SELECT ticker, exch, arg_min(company, security) AS cik, count(*) - 1 AS dup
            FROM s WHERE security % 7 <> 0 GROUP BY 1, 2),
        old AS (SELECT ticker, exch, min(company) AS cik, min(security) % 11 <> 0 AS fd FROM s
            WHERE security % 5 <> 0 GROUP BY 1, 2),
        m AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.exch, b.exch) AS exchange,
            coalesce(dup, 0) AS duplicates, CASE WHEN b.ticker IS NULL THEN 'created'
            WHEN a.ticker IS NULL AND fd AND NOT (SELECT count(*) FROM snap) <
                (SELECT count(*) FILTER (fd) FROM old) * 0.5 THEN 'deactivated'
            WHEN a.ticker IS NULL THEN 'kept' WHEN a.cik <> b.cik THEN 'reassigned'
            ELSE 'seen' END AS action
            FROM snap a FULL OUTER JOIN old b ON a.ticker = b.ticker
            AND a.exch IS NOT DISTINCT FROM b.exch)
        SELECT * FROM m""",
)
def dir_sync(t: Tables):
    return K.directory_sync(*_directory(t))


def _fetches(t: Tables):
    return t.events.select(
        F.col("event_type").alias("provider"),
        (F.col("user_id") % 20).alias("subject"),
        (F.col("value") > 5).alias("ok"),
        F.col("event_id").cast("string").alias("content"),
        F.col("ts").cast("timestamp").alias("started_at"),
    )


@query(
    "provenance",
    """SELECT event_type AS provider, user_id % 20 AS subject,
        count(*) FILTER (value > 5) AS record_count,
        count(*) FILTER (NOT value > 5) AS rejected_count,
        sha256(count(event_id) || '|' || sum(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 13))::BIGINT)::HUGEINT::VARCHAR)
            AS content_sha256,
        CASE WHEN count(*) FILTER (value > 5) > 0 THEN 'success' ELSE 'error' END AS status
        FROM events GROUP BY 1, 2""",
)
def provenance(t: Tables):
    return K.provenance(_fetches(t))


@query(
    "fetch_usage",
    """SELECT event_type AS provider,
        count(*) FILTER (ts >= TIMESTAMP '2024-01-20 11:00:00'
            AND ts <= TIMESTAMP '2024-01-20 12:00:00') AS last_hour,
        count(*) FILTER (ts >= TIMESTAMP '2024-01-19 12:00:00'
            AND ts <= TIMESTAMP '2024-01-20 12:00:00') AS last_day FROM events GROUP BY 1""",
)
def fetch_usage(t: Tables):
    return K.fetch_usage(_fetches(t), F.lit("2024-01-20 12:00:00").cast("timestamp"))


@query(
    "coverage_merge",
    """WITH b AS (SELECT security_id, min(trade_date) FILTER (trade_date < DATE '1998-01-01') AS f1,
            max(trade_date) FILTER (trade_date < DATE '1998-01-01') AS t1,
            min(trade_date) FILTER (trade_date >= DATE '1998-01-01') AS f2,
            max(trade_date) FILTER (trade_date >= DATE '1998-01-01') AS t2
            FROM v_raw_bars GROUP BY 1)
        SELECT security_id, CASE WHEN security_id < 'Brand#20' THEN 'loaded' ELSE 'partial' END
                AS status,
            CASE WHEN security_id < 'Brand#20' THEN least(f1, f2) ELSE f1 END AS loaded_from,
            CASE WHEN security_id < 'Brand#20' THEN coalesce(t2, t1) ELSE t1 END AS loaded_through
        FROM b""",
)
def coverage_merge(t: Tables):
    cut = F.lit("1998-01-01").cast("date")
    spans = t.raw_bars().groupBy("security_id", (F.col("trade_date") < cut).alias("early")).agg(
        F.min("trade_date").alias("loaded_from"), F.max("trade_date").alias("loaded_through")
    )
    stored = spans.where("early").withColumn("status", F.lit("partial"))
    loaded = spans.where("not early").where(F.col("security_id") < "Brand#20")
    return K.merge_coverage(stored.drop("early"), loaded.withColumn("status", F.lit("loaded")))


@query(
    "yield_backfill",
    """WITH n AS (SELECT year(observed_on) AS yr, count(*) AS n FROM v_yield GROUP BY 1)
        SELECT yr AS year FROM n WHERE NOT (n >= 2000 AND yr < 2001)""",
)
def yield_backfill(t: Tables):
    stored = t.yields()
    wanted = stored.select(F.year("observed_on").alias("year")).distinct()
    return K.years_to_load(stored, wanted, 2001).select(big("year"))


@query(
    "ref_listings",
    """SELECT ticker FROM (VALUES ('SPY'), ('QQQ'), ('IWM'), ('DIA'), ('TLT'), ('GLD')) r(ticker)
        WHERE ticker NOT IN (SELECT DISTINCT upper(substr(ticker, 1, 3)) FROM v_securities
            WHERE is_active)""",
)
def ref_listings(t: Tables):
    listed = t.securities().withColumn("ticker", F.upper(F.substring("ticker", 1, 3)))
    return K.missing_references(listed)


@query(
    "metrics_refresh",
    """SELECT company, metric, value FROM v_metrics WHERE company % 3 <> 0 UNION ALL
        SELECT company, metric, value * 2 FROM v_metrics WHERE company % 3 = 0
            AND metric <> 'pe_ratio'""",
)
def metrics_refresh(t: Tables):
    stored = t.metrics().select("company", "metric", "value")
    fresh = stored.where("company % 3 = 0 and metric != 'pe_ratio'")
    return K.refresh_metrics(stored, fresh.withColumn("value", F.col("value") * 2))


@query(
    "profile_merge",
    f"""WITH {_PROFILES}, c AS (SELECT s_suppkey AS company, 'old' AS name FROM supplier)
        SELECT c.company, CASE WHEN p.company IS NOT NULL THEN p.name ELSE 'old' END AS name,
            CASE WHEN p.company IS NOT NULL THEN sic_code ELSE '0100' END AS sic_code,
            CASE WHEN p.company IS NULL THEN 'US'
                 WHEN NOT hq_is_foreign THEN 'US' END AS country
        FROM c LEFT JOIN (SELECT * FROM profiles WHERE company % 5 <> 0) p USING (company)""",
)
def profile_merge(t: Tables):
    companies = t.supplier.select(
        F.col("s_suppkey").alias("company"), F.lit("old").alias("name"),
        F.lit("0100").alias("sic_code"), F.lit("none").alias("sector"), F.lit("US").alias("country"),
    )
    fresh = R.profiles(_profile_payloads(t)).where("company % 5 != 0")
    return K.merge_profiles(companies, fresh).drop("sector")


@query(
    "insider_load",
    """SELECT tx_id AS accession, owner % 10 AS company, code,
        CASE WHEN tx_id % 3 <> 0 THEN 'loaded' ELSE 'not_issuer' END AS status,
        owner AS owner_cik, owner % 2 = 1 AS is_director, 'Chief' AS officer_title
        FROM v_insider""",
)
def insider_load(t: Tables):
    forms = t.insider().withColumn(
        "company", F.when(F.col("tx_id") % 3 == 0, F.lit(99)).otherwise(F.col("company"))
    )
    payloads = _form4_payloads_of(forms)
    filings = t.insider().select(F.col("tx_id").alias("accession"), "company")
    loaded = K.load_insiders(R.insider_forms(payloads, ["accession"]), filings)
    return loaded.select(
        "accession", "company", "code", "status", "owner_cik", "is_director", "officer_title"
    )


@query(
    "load_outcomes", "SELECT status, count(*) AS documents FROM v_filings GROUP BY 1"
)
def load_outcomes(t: Tables):
    return K.load_outcomes(t.filings())


@query(
    "replace_slice",
    """SELECT security_id AS version, trade_date, CASE WHEN year(trade_date) = 1999 THEN close * 10
        ELSE close END AS close FROM v_raw_bars""",
)
def replace_slice(t: Tables):
    stored = t.raw_bars().select("trade_date", "close", F.col("security_id").alias("version"))
    fresh = stored.where(F.year("trade_date") == 1999).withColumn("close", F.col("close") * 10)
    return K.replace_slice(stored, fresh, ["version", "trade_date"])

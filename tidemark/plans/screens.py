"""Directory, screening, filing-list and price-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.lookups import SIC_DIVISIONS
from tidemark.operators import screener as S
from tidemark.plans.base import big, q, qc, query
from tidemark.sources.views import Tables

FORMS = ["10-K", "10-K/A", "8-K"]
_DIVISION = "CASE " + " ".join(
    f"WHEN grp BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in SIC_DIVISIONS
) + " END"


@query(
    "sic_division",
    f"""WITH c AS (SELECT p_partkey AS company, lpad(CAST((p_partkey * 37) % 10500 AS VARCHAR),
            CAST(greatest(4, length(CAST((p_partkey * 37) % 10500 AS VARCHAR))) AS INTEGER), '0') AS sic FROM part),
        g AS (SELECT *, CASE WHEN length(sic) = 4 THEN CAST(substr(sic, 1, 2) AS INTEGER) END
            AS grp FROM c)
        SELECT company, sic, {_DIVISION} AS division FROM g""",
)
def sic_division(t: Tables):
    number = ((F.col("p_partkey") * 37) % 10500).cast("string")
    sic = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return t.part.select(
        F.col("p_partkey").alias("company"), sic.alias("sic"), S.sic_division(sic).alias("division")
    )


@query(
    "company_search",
    """WITH hits AS (SELECT *, CASE WHEN ticker = 'SMA' THEN 0 WHEN ticker LIKE 'SMA%' THEN 1
            WHEN lower(name) LIKE 'sma%' THEN 2 ELSE 3 END AS rank FROM v_securities
            WHERE is_active AND (ticker LIKE 'SMA%' OR lower(name) LIKE '%sma%'))
        SELECT security, ticker, name, CAST(rank AS BIGINT) AS rank,
            (SELECT count(*) FROM hits) AS total
        FROM hits ORDER BY rank, length(ticker), ticker, security LIMIT 20""",
)
def company_search(t: Tables):
    return S.company_search(t.securities(), " sma ", 20).select(
        "security", "ticker", "name", big("rank"), "total"
    )


@query(
    "resolve_security",
    """SELECT ticker, security, exchange, is_active, last_seen FROM (SELECT *, row_number() OVER (
        PARTITION BY ticker ORDER BY is_active DESC, last_seen DESC NULLS LAST,
        exchange ASC NULLS LAST, security) AS rk FROM v_securities) WHERE rk = 1""",
)
def resolve_security(t: Tables):
    return S.resolve_securities(t.securities()).select(
        "ticker", "security", "exchange", "is_active", "last_seen"
    )


@query(
    "primary_listing",
    """SELECT company, min(security) AS lowest,
        arg_min(security, row(length(ticker), ticker, security)) AS shortest
        FROM v_securities WHERE is_active GROUP BY 1""",
)
def primary_listing(t: Tables):
    return S.primary_listing(t.securities())


@query(
    "screen",
    """WITH kept AS (SELECT company, name, sector, revenue, pe_ratio, market_cap
            FROM v_metrics_wide WHERE company IN (SELECT company FROM v_securities WHERE is_active)
            AND sector = 'BUILDING' AND revenue >= 500000 AND pe_ratio BETWEEN 5 AND 30)
        SELECT company, name, revenue, pe_ratio, market_cap, (SELECT count(*) FROM kept) AS total,
            (SELECT count(DISTINCT company) FROM v_metrics) AS universe FROM kept
        ORDER BY market_cap DESC NULLS LAST, name LIMIT 20 OFFSET 5""",
)
def screen(t: Tables):
    listings = t.securities().where("is_active").select("company")
    ranges = [("revenue", 500000.0, None), ("pe_ratio", 5.0, 30.0)]
    page = S.screen(
        t.metrics(), listings, ranges, "market_cap", sector="BUILDING", limit=20, offset=5
    )
    return page.select(
        "company", "name", "revenue", "pe_ratio", "market_cap", "total", "universe"
    )


@query("screen_sectors", "SELECT DISTINCT c_mktsegment AS sector FROM customer")
def screen_sectors(t: Tables):
    return S.sectors(t.customer.select(F.col("c_mktsegment").alias("sector")))


_FORM_LIST = "('10-K', '10-K/A', '8-K')"


@query(
    "filings_list",
    f"""WITH kept AS (SELECT *, count(*) OVER (PARTITION BY form) AS form_count FROM v_filings
            WHERE form IN {_FORM_LIST})
        SELECT company, accession, filed_date, form, form_count FROM kept
        ORDER BY filed_date DESC, accession DESC LIMIT 50 OFFSET 100""",
)
def filings_list(t: Tables):
    return S.filings_page(t.filings(), FORMS, 50, 100).select(
        "company", "accession", "filed_date", "form", "form_count"
    )


@query(
    "pending_filings",
    f"""SELECT company, accession, filed_date, form, status, version FROM v_filings
        WHERE form IN {_FORM_LIST} AND (status IN ('not_loaded', 'failed')
            OR (status = 'loaded' AND version IS DISTINCT FROM '2026.09-5'))
        ORDER BY filed_date DESC, accession DESC LIMIT 200""",
)
def pending_filings(t: Tables):
    return S.pending_filings(t.filings(), FORMS, 200)


@query(
    "prev_filing",
    """WITH f AS (SELECT *, replace(form, '/A', '') AS family FROM v_filings),
        p AS (SELECT *, max(CASE WHEN form = family THEN row(filed_date, accession) END) OVER (
            PARTITION BY company, family ORDER BY filed_date, accession
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f)
        SELECT company, accession, form, filed_date, b[2] AS previous_accession,
            b[1] AS previous_filed FROM p""",
)
def prev_filing(t: Tables):
    return S.previous_filings(t.filings())


@query(
    "bar_range",
    """SELECT security_id, trade_date, open, high, low, close, volume FROM v_raw_bars
        WHERE security_id = 'Brand#7' AND trade_date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""",
)
def bar_range(t: Tables):
    return S.bar_range(t.raw_bars(), "Brand#7", "1997-03-01", "1998-02-28")


@query(
    "daily_change",
    f"""WITH two AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY trade_date DESC)
            AS back FROM v_fetched_bars QUALIFY back <= 2),
        pair AS (SELECT security_id, max(trade_date) AS as_of,
            max(close) FILTER (back = 1) AS close, max(close) FILTER (back = 2) AS previous,
            max(adj_close) FILTER (back = 1) AS a, max(adj_close) FILTER (back = 2) AS ap,
            max(fetch_id) FILTER (back = 1) = max(fetch_id) FILTER (back = 2) AS one
            FROM two GROUP BY 1),
        based AS (SELECT *, coalesce(one AND a IS NOT NULL AND ap IS NOT NULL, false) AS adj
            FROM pair)
        SELECT security_id, as_of, close, previous, CASE WHEN adj THEN 'adjusted' ELSE 'raw' END
            AS basis, {q('CASE WHEN adj THEN a - ap ELSE close - previous END', 4)} AS change,
            {q('CASE WHEN adj THEN (a - ap) / ap ELSE (close - previous) / previous END * 100', 4)}
            AS change_percent FROM based""",
)
def daily_change(t: Tables):
    return S.daily_change(t.fetched_bars()).select(
        "security_id", "as_of", "close", "previous", "basis", qc("change", digits=4),
        qc("change_percent", digits=4),
    )


@query(
    "last_weekday",
    """SELECT d AS day, d - CASE isodow(d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS target
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def last_weekday(t: Tables):
    days = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.withColumn("target", S.last_weekday(F.col("day")))


def _coverage(t: Tables):
    shipped = t.lineitem.groupBy(F.col("l_partkey").alias("security")).agg(
        F.max(F.to_date("l_shipdate")).alias("loaded_through")
    )
    status = F.when(F.col("p_size") % 4 == 1, "error").when(F.col("p_size") % 4 > 1, "loaded")
    tried = F.date_add(F.to_date(F.lit("2001-10-01")), (F.col("p_size")).cast("int"))
    parts = t.part.select(
        F.col("p_partkey").alias("security"), status.alias("status"), tried.alias("attempted_on")
    )
    return parts.join(shipped, "security", "left")


@query(
    "needs_load",
    """WITH c AS (SELECT p_partkey AS security, CASE WHEN p_size % 4 = 1 THEN 'error'
            WHEN p_size % 4 > 1 THEN 'loaded' END AS status,
            DATE '2001-10-01' + p_size AS attempted_on, loaded_through FROM part LEFT JOIN
            (SELECT l_partkey, max(CAST(l_shipdate AS DATE)) AS loaded_through FROM lineitem
             GROUP BY 1) ON l_partkey = p_partkey)
        SELECT security, status, CASE WHEN status IS NULL THEN true
            WHEN status = 'error' THEN DATE '2001-11-01' - attempted_on > 7
            ELSE loaded_through IS NULL OR loaded_through < DATE '2001-07-01' END AS due FROM c""",
)
def needs_load(t: Tables):
    day = lambda text: F.lit(text).cast("date")
    found = S.needs_load(_coverage(t), day("2001-07-01"), day("2001-11-01"), 7)
    return found.select("security", "status", "due")


def _provider_bars(t: Tables):
    return (
        t.lineitem.where("l_quantity > 0")
        .groupBy(
            F.col("l_partkey").alias("security_id"),
            F.col("l_linestatus").alias("provider"),
            F.to_date("l_shipdate").alias("trade_date"),
        )
        .agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    )


@query(
    "price_source",
    """WITH b AS (SELECT l_partkey AS security_id, l_linestatus AS provider,
            CAST(l_shipdate AS DATE) AS trade_date, max(l_extendedprice / l_quantity) AS close
            FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2, 3),
        p AS (SELECT security_id, arg_max(provider, row(trade_date, provider)) AS provider FROM b
            GROUP BY 1)
        SELECT security_id, provider, trade_date, close FROM b JOIN p USING (security_id, provider)""",
)
def price_source(t: Tables):
    return S.price_source(_provider_bars(t))


@query(
    "calendar",
    """SELECT DISTINCT trade_date FROM v_raw_bars WHERE security_id = 'Brand#3'
        AND trade_date BETWEEN DATE '1997-01-01' - 60 AND DATE '1999-12-31'""",
)
def calendar(t: Tables):
    return S.trading_calendar(t.raw_bars(), "Brand#3", "1997-01-01", "1999-12-31")


@query(
    "latest_metrics",
    """SELECT c.metric, m.value FROM (VALUES ('revenue'), ('pe_ratio'), ('market_cap'), ('roe'))
        c(metric) LEFT JOIN (SELECT metric, value FROM v_metrics WHERE company = 7) m
        ON c.metric = m.metric""",
)
def latest_metrics(t: Tables):
    return S.latest_metrics(t.metrics(), ["revenue", "pe_ratio", "market_cap", "roe"], 7)


@query(
    "mixed_basis_flag",
    """SELECT security_id, count(DISTINCT fetch_id) > 1 AS mixed_basis FROM v_fetched_bars
        WHERE trade_date BETWEEN DATE '1998-03-01' AND DATE '1998-04-30' GROUP BY 1""",
)
def mixed_basis_flag(t: Tables):
    spring = F.col("trade_date").between(F.lit("1998-03-01"), F.lit("1998-04-30"))  # fetches are monthly
    return S.mixed_basis(t.fetched_bars().where(spring))

"""Joins, point-in-time and universe queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import asof as A
from tidemark.operators import pit
from tidemark.operators import prices as P
from tidemark.plans.base import big, q, qc, query
from tidemark.sources.views import Tables

FACT_KEY = ["company", "concept", "period_end"]
FACT_ORDER = ["filed_date", "accession", "line", "part"]
PRIORITY = ["R", "A", "N"]
# Release lags per stand-in series (days).
LAGS = {"1-URGENT": 1, "2-HIGH": 35, "3-MEDIUM": 45, "4-NOT SPECIFIED": 7, "5-LOW": 6}


def _lags():
    return F.create_map(*[F.lit(x) for pair in LAGS.items() for x in pair])[F.col("series")]


def _available(t: Tables):
    return pit.macro_available(t.macro(), _lags())


def _order_days(t: Tables):
    return t.orders.select(F.to_date("o_orderdate").alias("day"))


def _quarter_ends(t: Tables):
    return A.period_ends(_order_days(t), "day", 3)


def _year_ends(t: Tables):
    return A.period_ends(_order_days(t), "day", 12)


_MONTH_ENDS = """month_ends AS (SELECT as_of FROM (SELECT CAST(last_day(CAST(d AS DATE)) AS DATE)
    AS as_of, b FROM (SELECT unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH))
    AS d, b FROM (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b
    FROM orders))) WHERE as_of <= b)"""
_QUARTERS = f"{_MONTH_ENDS}, days AS (SELECT as_of FROM month_ends WHERE month(as_of) % 3 = 0)"
_YEARS = f"{_MONTH_ENDS}, days AS (SELECT as_of FROM month_ends WHERE month(as_of) = 12)"
_LAG_SQL = "CASE series " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LAGS.items()) + " END"
_AVAILABLE = f"""firsts AS (SELECT *, min(realtime_start) OVER (PARTITION BY series,
        observation_date) AS first FROM v_macro),
    avail AS (SELECT *, CASE WHEN realtime_start = first AND realtime_start > observation_date
        + {_LAG_SQL} + 30 THEN observation_date + {_LAG_SQL}
        ELSE greatest(realtime_start, observation_date) END AS available_on FROM firsts)"""


# --- Joins --------------------------------------------------------------------------------


@query(
    "j_inner",
    """SELECT o_orderstatus AS status, l_returnflag AS flag, count(*) AS rows,
        max(l_extendedprice) AS largest FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY 1, 2""",
)
def j_inner(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_returnflag", "l_extendedprice")
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(
        F.col("o_orderstatus").alias("status"), F.col("l_returnflag").alias("flag")
    ).agg(F.count(F.lit(1)).alias("rows"), F.max("l_extendedprice").alias("largest"))


@query(
    "j_left",
    """SELECT domain, count(*) AS headlines, count(quality) AS labelled,
        CAST(sum(coalesce(quality, 0)) AS BIGINT) AS good
        FROM v_news LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def j_left(t: Tables):
    joined = t.news().join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("domain").agg(
        F.count(F.lit(1)).alias("headlines"),
        F.count("quality").alias("labelled"),
        big(F.sum(F.coalesce("quality", F.lit(0))), "good"),
    )


@query(
    "j_anti",
    """SELECT doc_id, lang FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def j_anti(t: Tables):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_anti")


@query(
    "j_semi",
    """SELECT c_custkey AS company, c_mktsegment AS sector FROM customer WHERE EXISTS (
        SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def j_semi(t: Tables):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(
        F.col("c_custkey").alias("company"), F.col("c_mktsegment").alias("sector")
    )


@query(
    "j_asof_macro",
    f"""WITH {_AVAILABLE}, days AS (SELECT DISTINCT trade_date AS as_of FROM v_raw_bars),
        runs AS (SELECT series, available_on, max(row(observation_date, available_on,
            realtime_start, tie, value)) OVER (PARTITION BY series ORDER BY available_on
            RANGE UNBOUNDED PRECEDING) AS best FROM avail),
        known AS (SELECT DISTINCT series, available_on, best FROM runs)
        SELECT d.as_of, k.series, k.best[1] AS observation_date, k.best[5] AS value
        FROM (SELECT as_of, series FROM days CROSS JOIN (SELECT DISTINCT series FROM avail)) d
        ASOF JOIN known k ON d.series = k.series AND d.as_of >= k.available_on""",
)
def j_asof_macro(t: Tables):
    days = t.raw_bars().select(F.col("trade_date").alias("as_of")).distinct()
    return pit.macro_latest(_available(t), days).select(
        "as_of", "series", "observation_date", "value"
    )


@query(
    "j_asof_price",
    """WITH asks AS (SELECT p_brand AS security_id, CAST(o_orderdate AS DATE) AS day,
            count(*) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
        SELECT a.security_id, a.day, a.orders, b.trade_date AS asof_day, b.close
        FROM asks a ASOF LEFT JOIN v_bars b
        ON a.security_id = b.security_id AND a.day >= b.trade_date""",
)
def j_asof_price(t: Tables):
    asks = (
        t.lineitem.select("l_orderkey", "l_partkey")
        .join(t.orders.select("o_orderkey", "o_orderdate"), F.expr("l_orderkey = o_orderkey"))
        .join(t.part.select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"))
        .groupBy(F.col("p_brand").alias("security_id"), F.to_date("o_orderdate").alias("day"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    return A.asof_join(asks, t.bars(), "security_id", "day", "trade_date", ["close"])


@query(
    "j_pit_fact",
    f"""WITH {_QUARTERS}, known AS (SELECT as_of, company, concept, period_end,
            arg_max(value, row(filed_date, accession, line, part)) AS value
            FROM days JOIN v_facts ON filed_date <= as_of GROUP BY 1, 2, 3, 4)
        SELECT as_of, company, concept, count(*) AS facts, max(value) AS largest,
            max(period_end) AS newest FROM known GROUP BY 1, 2, 3""",
)
def j_pit_fact(t: Tables):
    known = pit.facts_asof(t.facts(), FACT_KEY, FACT_ORDER, _quarter_ends(t))
    return known.groupBy("as_of", "company", "concept").agg(
        F.count(F.lit(1)).alias("facts"),
        F.max("value").alias("largest"),
        F.max("period_end").alias("newest"),
    )


@query(
    "j_range_novelty",
    """SELECT news_id, company, count(*) OVER w - 1 AS earlier, min(news_id) OVER w AS first_id
        FROM v_news WINDOW w AS (PARTITION BY company ORDER BY seen_us
        RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW)""",
)
def j_range_novelty(t: Tables):
    from tidemark.operators.events import recent_window

    return recent_window(t.news())


@query(
    "j_interval_succ",
    r"""WITH named AS (SELECT *, regexp_replace(regexp_replace(lower(legal_name),
            '\b(the|holdings?|corp(oration)?|inc(orporated)?|co(mpany)?|llc|ltd|plc|group|lp|new)\b',
            ' ', 'g'), '[^a-z0-9]', '', 'g') AS name FROM v_registrants),
        pairs AS (SELECT o.company, n.company AS successor, n.ticker, row_number() OVER (
            PARTITION BY o.company ORDER BY length(n.ticker), n.ticker, n.company) AS rk
            FROM named o JOIN named n ON o.name = n.name AND NOT o.listed AND n.listed
            AND n.first_filed - o.last_filed BETWEEN -30 AND 120)
        SELECT company, successor, ticker FROM pairs WHERE rk = 1""",
)
def j_interval_succ(t: Tables):
    return pit.successors(t.registrants())


@query(
    "j_align",
    f"""WITH s AS (SELECT b.security_id, trade_date, b.close AS a, m.close AS m,
            lag(b.close) OVER w AS a0, lag(m.close) OVER w AS m0
            FROM v_bars b JOIN v_bench m USING (trade_date)
            WINDOW w AS (PARTITION BY security_id ORDER BY trade_date))
        SELECT security_id, trade_date, {q('a / a0 - 1')} AS ret, {q('m / m0 - 1')} AS bench_ret,
            {q('m - m0', 4)} AS bench_change FROM s WHERE a0 > 0""",
)
def j_align(t: Tables):
    bars, bench = t.bars(), t.bench()
    rates = A.align(bars, bench, "security_id")
    levels = A.align(bars, bench, "security_id", level=True).select(
        "security_id", "trade_date", F.col("bench_ret").alias("bench_change")
    )
    return rates.join(levels, ["security_id", "trade_date"]).select(
        "security_id", "trade_date", qc("ret"), qc("bench_ret"), qc("bench_change", digits=4)
    )


# --- Point in time ------------------------------------------------------------------------


@query(
    "pit_latest",
    """SELECT company, concept, period_end, arg_max(value, row(filed_date, accession, line, part))
        AS value, max(filed_date) AS filed_date FROM v_facts
        WHERE filed_date <= DATE '1999-06-30' GROUP BY 1, 2, 3""",
)
def pit_latest(t: Tables):
    return pit.latest_known(t.facts(), FACT_KEY, FACT_ORDER, "1999-06-30").select(
        *FACT_KEY, "value", "filed_date"
    )


@query(
    "pit_series_cut",
    """SELECT security_id, count(*) AS bars, max(trade_date) AS last_day,
        arg_max(close, trade_date) AS close FROM v_bars WHERE trade_date <= DATE '1998-12-31'
        GROUP BY 1""",
)
def pit_series_cut(t: Tables):
    return pit.cut(t.bars(), "1998-12-31").groupBy("security_id").agg(
        F.count(F.lit(1)).alias("bars"),
        F.max("trade_date").alias("last_day"),
        F.max_by("close", "trade_date").alias("close"),
    )


@query(
    "macro_available",
    f"""WITH {_AVAILABLE} SELECT series, observation_date, realtime_start, available_on, tie
        FROM avail""",
)
def macro_available(t: Tables):
    return _available(t).select(
        "series", "observation_date", "realtime_start", "available_on", "tie"
    )


_KNOWN = """known AS (SELECT series, observation_date, arg_max(value, row(available_on,
    realtime_start, tie)) AS value, max(available_on) AS available_on FROM avail
    WHERE available_on <= DATE '2000-06-30' GROUP BY 1, 2)"""


@query("macro_known", f"WITH {_AVAILABLE}, {_KNOWN} SELECT * FROM known")
def macro_known(t: Tables):
    return pit.macro_known(_available(t), "2000-06-30")


_LATEST = """latest AS (SELECT as_of, series, max(row(observation_date, available_on,
    realtime_start, tie, value)) AS best FROM days JOIN avail ON available_on <= as_of
    GROUP BY 1, 2)"""


@query(
    "macro_latest",
    f"""WITH {_AVAILABLE}, {_QUARTERS}, {_LATEST} SELECT as_of, series,
        best[1] AS observation_date, best[2] AS available_on, best[5] AS value FROM latest""",
)
def macro_latest(t: Tables):
    return pit.macro_latest(_available(t), _quarter_ends(t))


def _back_sql(back: int, measure: str) -> str:
    return f"""WITH {_AVAILABLE}, {_QUARTERS}, known AS (SELECT as_of, series, observation_date,
            arg_max(value, row(available_on, realtime_start, tie)) AS value
            FROM days JOIN avail ON available_on <= as_of GROUP BY 1, 2, 3),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY as_of, series
            ORDER BY observation_date DESC) AS rk FROM known),
        pair AS (SELECT as_of, series, max(value) FILTER (rk = 1) AS latest,
            max(value) FILTER (rk = {back + 1}) AS earlier FROM ranked GROUP BY 1, 2)
        SELECT as_of, series, {measure} FROM pair"""


@query("macro_change", _back_sql(3, f"{q('latest - earlier', 2)} AS change"))
def macro_change(t: Tables):
    found = pit.macro_change(_available(t), _quarter_ends(t), 3)
    return found.select("as_of", "series", qc("change", digits=2))


@query("macro_growth", _back_sql(12, f"{q('latest / earlier - 1')} AS growth"))
def macro_growth(t: Tables):
    found = pit.macro_growth(_available(t), _quarter_ends(t), 12)
    return found.select("as_of", "series", qc("growth"))


ROLES = {
    "ten_year": "1-URGENT",
    "curve": "2-HIGH",
    "unemployment": "3-MEDIUM",
    "conditions": "4-NOT SPECIFIED",
    "prices": "5-LOW",
}
_FEATURES = f"""WITH {_AVAILABLE}, {_QUARTERS}, {_LATEST},
    earlier AS (SELECT as_of, max(row(observation_date, available_on, realtime_start, tie, value))[5]
        AS v FROM days JOIN avail ON available_on <= as_of - 91 AND series = '1-URGENT' GROUP BY 1),
    known AS (SELECT as_of, series, observation_date, arg_max(value, row(available_on,
        realtime_start, tie)) AS value FROM days JOIN avail ON available_on <= as_of
        WHERE series IN ('3-MEDIUM', '5-LOW') GROUP BY 1, 2, 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY as_of, series
        ORDER BY observation_date DESC) AS rk FROM known),
    backs AS (SELECT as_of,
        max(value) FILTER (rk = 1 AND series = '5-LOW')
          / max(value) FILTER (rk = 13 AND series = '5-LOW') - 1 AS cpi,
        max(value) FILTER (rk = 1 AND series = '3-MEDIUM')
          - max(value) FILTER (rk = 4 AND series = '3-MEDIUM') AS jobs FROM ranked GROUP BY 1),
    wide AS (SELECT as_of, max(best[5]) FILTER (series = '1-URGENT') AS ten,
        max(best[5]) FILTER (series = '2-HIGH') AS curve,
        max(best[5]) FILTER (series = '3-MEDIUM') AS une,
        max(best[5]) FILTER (series = '4-NOT SPECIFIED') AS nfci,
        max(best[2]) FILTER (series <> '5-LOW') AS used_on FROM latest GROUP BY 1)
    SELECT as_of, ten AS macro_10y, curve AS macro_curve_10y3m, une AS macro_unemployment,
        nfci AS macro_nfci, used_on, {q('cpi')} AS macro_cpi_yoy,
        {q('jobs', 2)} AS macro_unemployment_change_3m, {q('ten - earlier.v', 2)} AS macro_10y_change_3m
    FROM wide LEFT JOIN backs USING (as_of) LEFT JOIN earlier USING (as_of)"""


@query("macro_features", _FEATURES)
def macro_features(t: Tables):
    found = pit.macro_features(_available(t), _quarter_ends(t), ROLES)
    return found.select(
        "as_of", "macro_10y", "macro_curve_10y3m", "macro_unemployment", "macro_nfci", "used_on",
        qc("macro_cpi_yoy"), qc("macro_unemployment_change_3m", digits=2),
        qc("macro_10y_change_3m", digits=2),
    )


@query(
    "macro_dashboard",
    f"""WITH {_AVAILABLE}, {_KNOWN},
        lasts AS (SELECT *, max(observation_date) OVER w AS last, count(*) OVER w AS n FROM known WINDOW w AS (PARTITION BY series)),
        placed AS (SELECT *, observation_date >= last - 1830 AS recent, row_number() OVER (PARTITION BY series,
            observation_date >= last - 1830 ORDER BY observation_date) - 1 AS i FROM lasts),
        facts AS (SELECT series, arg_max(value, observation_date) AS value,
            max(observation_date) AS observation_date,
            arg_max(available_on, observation_date) AS available_on,
            arg_max(value, observation_date) FILTER (observation_date <= last - 365) AS base,
            count(*) FILTER (recent AND i % greatest(1, n // 300) = 0) AS points,
            sum(value) FILTER (recent AND i % greatest(1, n // 300) = 0) AS total,
            string_agg(CAST(observation_date AS VARCHAR), ',' ORDER BY observation_date) FILTER (recent AND i % greatest(1, n // 300) = 0) AS days
            FROM placed GROUP BY 1)
        SELECT series, value, observation_date, available_on,
            {q("CASE WHEN series IN ('1-URGENT', '2-HIGH') THEN value / base - 1 ELSE value - base END", 4)}
                AS yoy_change, points, {q('total', 1)} AS history_total, days AS history_days FROM facts""",
)
def macro_dashboard(t: Tables):
    known = pit.macro_known(_available(t), "2000-06-30")
    found = pit.macro_dashboard(known, ["1-URGENT", "2-HIGH"])
    total = F.aggregate("history", F.lit(0.0), lambda acc, h: acc + h["value"])
    days = F.array_join(F.transform("history", lambda h: h["observation_date"].cast("string")), ",")
    return found.select(
        "series", "value", "observation_date", "available_on", qc("yoy_change", digits=4),
        big("points"), qc(total, "history_total", 1), days.alias("history_days"),
    )


@query(
    "month_ends",
    f"WITH {_MONTH_ENDS} SELECT as_of FROM month_ends",
)
def month_ends(t: Tables):
    return A.period_ends(_order_days(t), "day")


_REVENUE = f"""{_QUARTERS}, best AS (SELECT as_of, company, max(row(period_end,
        CASE concept WHEN 'R' THEN -1 WHEN 'A' THEN -2 ELSE -3 END, filed_date, accession, line,
        part, value, concept)) AS b FROM days JOIN v_annual ON filed_date <= as_of
        WHERE value > 0 GROUP BY 1, 2),
    revenue AS (SELECT as_of, company, b[1] AS period_end, b[8] AS concept, b[7] AS revenue
        FROM best WHERE b[1] >= as_of - 550)"""


@query("revenue_asof", f"WITH {_REVENUE} SELECT * FROM revenue")
def revenue_asof(t: Tables):
    return pit.revenue_asof(t.annual(), PRIORITY, _quarter_ends(t))


@query(
    "candidates",
    """WITH r AS (SELECT year(period_end) AS yr, company, max(value) AS revenue FROM v_annual
            GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY revenue DESC, company) AS rk
            FROM r)
        SELECT company, min(rk) AS best_rank, arg_min(yr, row(rk, yr)) AS best_year
        FROM k WHERE rk <= 30 GROUP BY 1""",
)
def candidates(t: Tables):
    return pit.candidates(t.annual(), 30).select("company", big("best_rank"), big("best_year"))


def _universe(t: Tables):
    revenue = pit.revenue_asof(t.annual(), PRIORITY, _quarter_ends(t))
    brand = F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30 + 1).cast("string"))
    coverage = t.raw_bars().groupBy("security_id").agg(F.min("trade_date").alias("loaded_from"))
    known = t.part.select(F.col("p_brand").alias("security_id")).distinct()
    listings = t.supplier.select(
        F.col("s_suppkey").alias("company"), brand.alias("security_id")
    ).join(known, "security_id")
    return pit.universe_rank(revenue, listings, coverage, 40)


_UNIVERSE = f"""{_REVENUE}, listings AS (SELECT s_suppkey AS company,
        'Brand#' || CAST(s_suppkey % 30 + 1 AS VARCHAR) AS security_id FROM supplier
        WHERE 'Brand#' || CAST(s_suppkey % 30 + 1 AS VARCHAR) IN (SELECT p_brand FROM part)),
    cov AS (SELECT security_id, min(trade_date) AS loaded_from FROM v_raw_bars GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY revenue DESC, company)
        AS rank FROM revenue QUALIFY rank <= 40),
    listed AS (SELECT as_of, company, rank, revenue, period_end, CASE WHEN row_number() OVER (
        PARTITION BY as_of, security_id ORDER BY rank) = 1 THEN security_id END AS security_id
        FROM ranked LEFT JOIN listings USING (company)),
    universe AS (SELECT as_of, company, rank, revenue, period_end, security_id,
        coalesce(loaded_from <= as_of - 370, false) AS has_prices
        FROM listed LEFT JOIN cov USING (security_id))"""


@query("universe_rank", f"WITH {_UNIVERSE} SELECT * FROM universe")
def universe_rank(t: Tables):
    return _universe(t)


@query(
    "price_targets",
    f"""WITH {_UNIVERSE} SELECT security_id, min(rank) AS best_rank FROM universe
        WHERE security_id IS NOT NULL GROUP BY 1""",
)
def price_targets(t: Tables):
    return pit.price_targets(_universe(t))


@query(
    "survivorship",
    f"""WITH {_UNIVERSE} SELECT as_of, count(*) AS members,
        count(*) FILTER (has_prices) AS with_prices,
        count(*) FILTER (security_id IS NULL) AS no_listing,
        {q('1 - count(*) FILTER (has_prices) / count(*)')} AS missing_share
        FROM universe GROUP BY 1""",
)
def survivorship(t: Tables):
    return pit.survivorship(_universe(t)).select(
        "as_of", "members", "with_prices", "no_listing", qc("missing_share")
    )

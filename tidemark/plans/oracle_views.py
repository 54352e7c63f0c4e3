"""DuckDB twins of the views in sources/views.py, added to a query's WITH clause on use."""

from __future__ import annotations

import re

from tidemark.sources.views import CONCEPT_OF, INSTANT_CONCEPTS, SHARE_CONCEPTS

VIEWS: dict[str, str] = {
    "v_raw_bars": """
        SELECT p_brand AS security_id, CAST(l_shipdate AS DATE) AS trade_date,
               arg_min(l_extendedprice / l_quantity, tie) AS open,
               max(l_extendedprice / l_quantity) AS high,
               min(l_extendedprice / l_quantity) AS low,
               arg_max(l_extendedprice / l_quantity, tie) AS close,
               sum(l_quantity) AS volume
        FROM (SELECT *, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS tie
              FROM lineitem WHERE l_quantity > 0) l
        JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "v_bars": """
        SELECT *, CASE WHEN day(trade_date) = 15 THEN close * 0.01 ELSE 0.0 END AS dividend_cash,
               CASE WHEN day(trade_date) = 1 AND month(trade_date) = 6 THEN 2.0 ELSE 1.0 END
                   AS split_factor
        FROM v_raw_bars""",
    "v_bench": "SELECT trade_date, avg(close) AS close FROM v_raw_bars GROUP BY 1",
    # ret is the total return into the bar; n counts bars from 1.
    "v_returns": """
        SELECT *, row_number() OVER w AS n, lag(trade_date) OVER w AS prev_date,
               lag(close) OVER w AS prev_close,
               CASE WHEN lag(close) OVER w IS NULL THEN NULL
                    WHEN lag(close) OVER w > 0
                    THEN (close + dividend_cash) * split_factor / lag(close) OVER w - 1
                    ELSE 0.0 END AS ret
        FROM v_bars WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)""",
    "v_index": """
        SELECT *, product(coalesce(1 + ret, 1.0)) OVER (PARTITION BY security_id ORDER BY trade_date
                  ROWS UNBOUNDED PRECEDING) AS idx
        FROM v_returns""",
    "v_bench_returns": """
        SELECT trade_date, close, row_number() OVER w AS n,
               close / lag(close) OVER w - 1 AS ret
        FROM v_bench WINDOW w AS (ORDER BY trade_date)""",
    "v_facts": """
        SELECT l_suppkey AS company, l_returnflag AS concept,
               last_day(CAST(o_orderdate AS DATE)) AS period_end, l_extendedprice AS value,
               CAST(l_shipdate AS DATE) AS filed_date, l_orderkey AS accession,
               CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_macro": """
        SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS observation_date,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS realtime_start,
               o_totalprice AS value, o_orderkey AS tie
        FROM orders""",
    "v_yield": """
        SELECT CAST(o_orderdate AS DATE) AS observed_on,
               CASE o_orderpriority WHEN '1-URGENT' THEN '3 Mo' WHEN '2-HIGH' THEN '2 Yr'
                    WHEN '3-MEDIUM' THEN '10 Yr' WHEN '4-NOT SPECIFIED' THEN '1 Mo'
                    ELSE '30 Yr' END AS tenor,
               max(o_totalprice) / 1e7 AS value
        FROM orders GROUP BY 1, 2""",
    "v_annual": """
        SELECT company, concept, make_date(year(period_end), 12, 31) AS period_end,
               make_date(year(period_end), 12, 31) - 364 AS period_start, value, filed_date,
               accession, line, part
        FROM v_facts""",
    "v_filed_facts": """
        SELECT company, taxonomy, concept, unit, period_start, period_end, fiscal_year,
               fiscal_period, accession, filed_date, max(value) AS value FROM (
          SELECT company, CASE WHEN concept = 'EntityCommonStockSharesOutstanding' THEN 'dei'
                 ELSE 'us-gaap' END AS taxonomy, concept,
                 CASE WHEN shares THEN 'shares' ELSE 'USD' END AS unit,
                 CASE WHEN instant THEN NULL WHEN full_year OR line = 2
                      THEN make_date(y, 1, 1) ELSE make_date(y, qn * 3 - 2, 1) END AS period_start,
                 e AS period_end, y AS fiscal_year,
                 CASE WHEN full_year THEN 'FY' ELSE 'Q' END AS fiscal_period,
                 lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS accession,
                 e + CAST(20 + l_orderkey % 200 AS INTEGER) AS filed_date,
                 CASE WHEN shares THEN CAST(1000 * (1 + company % 5) AS DOUBLE)
                      * CASE WHEN l_orderkey % 100 < 3 THEN 2 ELSE 1 END
                      ELSE l_extendedprice END AS value
          FROM (SELECT *, line = 1 AND y < 2001 AND NOT instant AS full_year,
                       CAST(CASE WHEN line = 1 AND y < 2001 AND NOT instant
                         THEN make_date(y, 12, 31)
                         ELSE last_day(make_date(y, qn * 3, 1)) END AS DATE) AS e
                FROM (SELECT l_suppkey AS company, l_orderkey, l_extendedprice,
                        l_linenumber % 4 AS line, CAST(year(o_orderdate) AS INTEGER) AS y,
                        CAST(quarter(o_orderdate) AS INTEGER) AS qn,
                        concepts[l_partkey % 16 + 1] AS concept,
                        list_contains(instants, concepts[l_partkey % 16 + 1]) AS instant,
                        list_contains(sharers, concepts[l_partkey % 16 + 1]) AS shares
                      FROM lineitem JOIN orders ON l_orderkey = o_orderkey,
                        (SELECT __CONCEPTS__ AS concepts, __INSTANTS__ AS instants,
                                __SHARES__ AS sharers))))
        GROUP BY ALL""",
    "v_registrants": """
        SELECT o_custkey * 10 + yr % 10 AS company,
               'Firm ' || CAST((o_custkey // 7) % 40 AS VARCHAR)
                   || CASE o_custkey % 3 WHEN 0 THEN ' Inc' WHEN 1 THEN ' Holdings Corp'
                      ELSE ' Group' END AS legal_name,
               'T' || CAST(o_custkey AS VARCHAR) AS ticker,
               (o_custkey + yr) % 2 = 0 AS listed, first_filed, last_filed
        FROM (SELECT o_custkey, year(o_orderdate) AS yr,
                     min(CAST(o_orderdate AS DATE)) AS first_filed,
                     max(CAST(o_orderdate AS DATE)) AS last_filed
              FROM orders GROUP BY 1, 2)""",
    "v_snapshots": """
        SELECT last_day(CAST(l_shipdate AS DATE)) AS as_of, l_suppkey AS company,
               min(l_discount) AS earnings_yield, max(l_tax) AS book_to_price,
               min(l_extendedprice / l_quantity) AS ebitda_to_ev,
               max(l_extendedprice / l_quantity) AS fcf_yield,
               sum(l_quantity) AS sales_yield, min(l_extendedprice) AS roe,
               max(l_extendedprice) AS roic, max(l_quantity) AS gross_margin,
               CASE WHEN count(*) >= 4 THEN min(l_quantity) END AS debt_to_equity,
               max(l_extendedprice / l_quantity) / min(l_extendedprice / l_quantity) - 1
                   AS mom_12_1,
               CASE WHEN count(*) >= 3 THEN CAST(count(*) AS DOUBLE) END AS mom_6m,
               CASE WHEN count(*) >= 2 THEN max(l_extendedprice / l_quantity)
                    - min(l_extendedprice / l_quantity) END AS vol_3m,
               CASE WHEN count(*) >= 2 THEN max(l_discount) - min(l_discount) END AS beta_1y,
               CASE WHEN count(*) >= 3 THEN max(l_discount) END AS revenue_growth_yoy,
               CASE WHEN count(*) >= 5 THEN min(l_tax) END AS revenue_cagr_3y,
               CASE WHEN count(*) >= 4 THEN CAST(max(l_orderkey) AS DOUBLE) END AS eps_growth_yoy,
               ln(sum(l_quantity)) AS log_market_cap
        FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2""",
    "v_metrics_wide": """
        SELECT c_custkey AS company, c_name AS name, c_mktsegment AS sector, c_nationkey AS grp,
               cents / 100.0 AS revenue, CAST(n AS DOUBLE) AS pe_ratio, largest AS market_cap,
               c_acctbal AS net_income
        FROM customer LEFT JOIN (
            SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE)
                       AS cents,
                   count(*) AS n, max(o_totalprice) AS largest
            FROM orders GROUP BY 1) o ON c_custkey = o_custkey""",
    "v_metrics": """
        SELECT * FROM (
            SELECT company, name, sector, grp, 'revenue' AS metric, revenue AS value
            FROM v_metrics_wide UNION ALL
            SELECT company, name, sector, grp, 'pe_ratio', pe_ratio FROM v_metrics_wide UNION ALL
            SELECT company, name, sector, grp, 'market_cap', market_cap FROM v_metrics_wide
            UNION ALL
            SELECT company, name, sector, grp, 'net_income', net_income FROM v_metrics_wide)
        WHERE value IS NOT NULL""",
    "v_securities": """
        SELECT p_partkey AS security,
               upper(substr(p_name, 1, 3)) || CAST(p_partkey % 50 AS VARCHAR) AS ticker,
               p_brand AS exchange, p_partkey % 3 <> 0 AS is_active,
               CASE WHEN p_partkey % 5 <> 0 THEN DATE '2000-01-01'
                    + CAST(p_partkey % 700 AS INTEGER) END AS last_seen,
               p_partkey % 400 AS company, p_name AS name
        FROM part""",
    "v_filings": """
        SELECT o_custkey AS company, o_orderkey AS accession,
               CAST(o_orderdate AS DATE) AS filed_date,
               CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-K/A'
                    WHEN '3-MEDIUM' THEN '10-Q' WHEN '4-NOT SPECIFIED' THEN '8-K'
                    ELSE '4' END AS form,
               CASE o_orderstatus WHEN 'F' THEN 'loaded' WHEN 'O' THEN 'not_loaded'
                    ELSE 'failed' END AS status,
               CASE o_orderkey % 3 WHEN 1 THEN '2026.09-5' WHEN 2 THEN 'old' END AS version
        FROM orders""",
    "v_fetched_bars": """
        SELECT *, CAST(month(trade_date) AS BIGINT) AS fetch_id,
               CASE WHEN day(trade_date) % 2 = 0 THEN close / 2 END AS adj_close
        FROM v_raw_bars""",
    "v_holdings": """
        SELECT o_custkey AS manager, l_partkey AS cusip,
               CAST(last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE))
                   AS DATE) AS period,
               CAST(o_orderdate AS DATE) AS filed,
               CASE o_orderstatus WHEN 'F' THEN 'original' WHEN 'O' THEN 'restatement'
                    ELSE 'new_holdings' END AS kind,
               l_orderkey AS accession,
               CASE WHEN l_returnflag = 'R' THEN 'Put' END AS put_call,
               CASE WHEN l_linestatus = 'F' THEN 'SH' ELSE 'PRN' END AS amount_type,
               l_quantity AS amount, l_extendedprice AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_insider": """
        SELECT event_id AS tx_id, user_id % 10 AS company, user_id AS owner,
               CASE event_type WHEN 'purchase' THEN 'P' WHEN 'click' THEN 'S'
                    ELSE upper(substr(event_type, 1, 1)) END AS code,
               CAST(ts AS DATE) AS tx_date,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS shares, value AS price
        FROM events""",
    "v_news": """
        SELECT event_id AS news_id, user_id AS company, ts AS seen_at, epoch_us(ts) AS seen_us,
               split_part(text, chr(10), 1) AS title, source AS domain, doc_id
        FROM events JOIN documents
          ON event_id % (SELECT count(*) FROM documents) = doc_id""",
    "v_passages": """
        SELECT doc_id, source, lang, ordinal, text,
               coalesce(CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS char_start,
               coalesce(CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0)
                   + length(text) AS char_end
        FROM (SELECT doc_id, source, lang, unnest(parts) AS text,
                     unnest(range(len(parts))) AS ordinal
              FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts
                    FROM documents))""",
}


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


VIEWS["v_filed_facts"] = (
    VIEWS["v_filed_facts"]
    .replace("__CONCEPTS__", _list(CONCEPT_OF))
    .replace("__INSTANTS__", _list(INSTANT_CONCEPTS))
    .replace("__SHARES__", _list(SHARE_CONCEPTS))
)

# Quarter ends of the bars; facts as public on each, and each one's last bar, of a company on a day as one number.
VIEWS["v_pit_days"] = "SELECT DISTINCT last_day(trade_date) AS as_of FROM v_raw_bars WHERE month(trade_date) % 3 = 0"
VIEWS["v_pit_facts"] = """
    SELECT f.company * 100000 + (as_of - DATE '1970-01-01') AS company, f.* EXCLUDE (company) FROM v_filed_facts f JOIN v_pit_days ON filed_date <= as_of
    WHERE f.company IN (SELECT CAST(substr(security_id, 7) AS BIGINT) FROM v_raw_bars)"""
VIEWS["v_pit_bars"] = """
    SELECT 'Brand#' || (CAST(substr(security_id, 7) AS BIGINT) * 100000 + (as_of - DATE '1970-01-01')) AS security_id, max(trade_date) AS trade_date,
        arg_max(close, trade_date) AS close FROM v_raw_bars JOIN v_pit_days ON last_day(trade_date) = as_of GROUP BY security_id, as_of"""

_NAME = re.compile(r"\bv_[a-z_0-9]+\b")


def _needed(sql: str, found: list[str]) -> None:
    for name in _NAME.findall(sql):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found.append(name)


def with_views(sql: str) -> str:
    """Prefix the WITH entries a statement refers to, dependencies first."""
    needed: list[str] = []
    _needed(sql, needed)
    if not needed:
        return sql
    entries = ", ".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    opening = re.match(r"WITH(\s+RECURSIVE)?\s+", body, re.IGNORECASE)
    if opening is None:
        return f"WITH {entries} {body}"
    return f"{opening.group(0)} {entries}, {body[opening.end():]}"

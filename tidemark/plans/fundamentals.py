"""Statement, metric-registry and scalar-formula queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.functions.lookups import concept_rows
from tidemark.operators import metrics as M
from tidemark.operators import statements as S
from tidemark.plans.base import big, q, qc, query
from tidemark.sources.views import Tables

_ITEM_VALUES = ", ".join(f"('{i}', '{k}', '{c}', {p})" for i, k, _, c, p in concept_rows())
SPLITS_SQL = """pairs AS (SELECT company, filed_date AS effective, value,
        lag(value) OVER (PARTITION BY company, concept, period_start, period_end
            ORDER BY filed_date, accession) AS before FROM v_filed_facts
        WHERE unit = 'shares' AND taxonomy = 'us-gaap'),
    sized AS (SELECT company, effective, value / before AS chg, CASE WHEN value >= before
        THEN value / before ELSE before / value END AS size FROM pairs WHERE before > 0),
    evidence AS (SELECT DISTINCT company, effective, CASE WHEN chg >= 1 THEN r ELSE 1 / r END AS ratio
        FROM (SELECT *, list_filter(list_concat([1.5::DOUBLE], list_transform(range(2, 101),
            lambda x: x::DOUBLE)), lambda z: abs(size - z) <= 0.02 * z)[1] AS r FROM sized)
        WHERE r IS NOT NULL),
    events AS (SELECT company, ratio, min(effective) AS effective FROM evidence GROUP BY 1, 2
        UNION ALL SELECT e.company, e.ratio, (SELECT min(v.effective) FROM evidence v
            WHERE v.company = e.company AND v.ratio = e.ratio
            AND v.effective - e.effective > 400) AS effective FROM events e
        WHERE EXISTS (SELECT 1 FROM evidence v WHERE v.company = e.company
            AND v.ratio = e.ratio AND v.effective - e.effective > 400))"""
KNOWN_SQL = f"""{SPLITS_SQL},
    adjusted AS (SELECT f.* EXCLUDE (value), CASE WHEN unit = 'shares' THEN value * coalesce(
            (SELECT product(ratio) FROM events e WHERE e.company = f.company
             AND e.effective > f.filed_date), 1) ELSE value END AS value,
        CASE WHEN unit = 'shares' THEN 'Adjusted (' || (SELECT string_agg('split ×'
            || replace(CAST(ratio AS VARCHAR), '.0', '') || ' from ' || CAST(effective AS VARCHAR),
            ', ' ORDER BY effective, ratio) FROM events e WHERE e.company = f.company
            AND e.effective > f.filed_date) || ')' END AS note FROM v_filed_facts f),
    known AS (SELECT company, taxonomy, concept, unit, period_start, period_end,
        arg_max(value, row(filed_date, accession)) AS value,
        arg_max(accession, row(filed_date, accession)) AS accession,
        max(filed_date) AS filed_date, arg_max(row(note), row(filed_date, accession))[1] AS note
        FROM adjusted GROUP BY 1, 2, 3, 4, 5, 6)"""
YEARS_SQL = f"""{KNOWN_SQL},
    full_years AS (SELECT DISTINCT company, year(period_end) AS y FROM known
        WHERE period_end - period_start + 1 BETWEEN 350 AND 380),
    spans AS (SELECT DISTINCT company, period_start, period_end FROM known
        WHERE period_start IS NOT NULL),
    interim AS (SELECT company, y, list_sort(list_distinct(list(period_end)
            FILTER (period_start >= make_date(y, 1, 1) AND period_end < make_date(y, 12, 31)
            AND (period_start = make_date(y, 1, 1)
                OR period_end - period_start + 1 BETWEEN 80 AND 100)))) AS ends
        FROM full_years LEFT JOIN spans USING (company) GROUP BY 1, 2),
    lasts AS (SELECT company, max(y) + 1 AS y FROM full_years GROUP BY 1),
    open_ends AS (SELECT company, y, list_sort(list_distinct(list(period_end)
            FILTER (period_start >= make_date(y, 1, 1)
            AND period_end - make_date(y, 1, 1) + 1 < 350
            AND (period_start = make_date(y, 1, 1)
                OR period_end - period_start + 1 BETWEEN 80 AND 100)))) AS ends
        FROM lasts LEFT JOIN spans USING (company) GROUP BY 1, 2),
    years AS (SELECT company, y, CASE WHEN len(ends) = 3
            THEN list_append(ends, make_date(y, 12, 31)) END AS ends, true AS complete FROM interim
        UNION ALL SELECT company, y, ends, false FROM open_ends WHERE len(ends) BETWEEN 1 AND 3
            AND quarter(ends[len(ends)]) = len(ends)),
    items(item, kind, concept, priority) AS (VALUES {_ITEM_VALUES}),
    tagged AS (SELECT k.*, item, kind, priority FROM known k JOIN items USING (concept)
        WHERE taxonomy = 'us-gaap')"""
ANNUAL_SQL = f"""{YEARS_SQL},
    annual_raw AS (SELECT f.company, y, NULL::INTEGER AS qn, item, kind, y AS idx,
            arg_min(row(value, f.concept, accession, filed_date, note), priority) AS c
        FROM years JOIN tagged f ON f.company = years.company
            AND f.period_end = make_date(y, 12, 31)
            AND CASE WHEN kind = 'instant' THEN period_start IS NULL
                ELSE period_start = make_date(y, 1, 1) END
        WHERE complete GROUP BY ALL)"""
QUARTER_SQL = f"""{YEARS_SQL},
    quarters AS (SELECT company, y, unnest(range(1, len(ends) + 1)) AS qn, unnest(ends) AS e,
        complete FROM years WHERE ends IS NOT NULL),
    roles AS (SELECT p.company, p.y, p.qn, p.complete, item, kind, f.concept, priority,
            CASE WHEN kind = 'instant' AND period_start IS NULL THEN 'direct'
                 WHEN kind <> 'instant' AND e - period_start + 1 BETWEEN 80 AND 100 THEN 'direct'
                 WHEN kind = 'flow' AND period_start = make_date(p.y, 1, 1) THEN 'ytd' END AS role,
            value, accession, filed_date, note
        FROM quarters p JOIN tagged f ON f.company = p.company AND f.period_end = e
        UNION ALL
        SELECT p.company, p.y, p.qn, p.complete, item, kind, f.concept, priority, 'before', value,
            accession, filed_date, note
        FROM quarters p JOIN tagged f ON f.company = p.company AND qn > 1 AND kind = 'flow'
            AND f.period_end = last_day(make_date(p.y, CAST(qn AS INTEGER) * 3 - 3, 1))
            AND period_start = make_date(p.y, 1, 1)),
    cells AS (SELECT company, y, qn, complete, item, kind, concept, priority,
            max(row(value, accession, filed_date, note)) FILTER (role = 'direct') AS d,
            max(row(value, accession, filed_date)) FILTER (role = 'ytd') AS t,
            max(row(value, filed_date)) FILTER (role = 'before') AS b
        FROM roles WHERE role IS NOT NULL GROUP BY ALL),
    solved AS (SELECT company, y, qn, item, kind, priority, concept,
            CASE WHEN d IS NOT NULL THEN d[1] ELSE t[1] - b[1] END AS value,
            CASE WHEN d IS NOT NULL THEN d[2] ELSE t[2] END AS accession,
            CASE WHEN d IS NOT NULL THEN d[3] ELSE greatest(t[3], b[2]) END AS filed_date,
            CASE WHEN d IS NOT NULL THEN d[4] ELSE CASE WHEN qn = 4 AND complete THEN 'FY'
                ELSE CAST(3 * qn AS VARCHAR) || 'M YTD' END || ' − '
                || CAST(3 * (qn - 1) AS VARCHAR) || 'M YTD' END AS note
        FROM cells WHERE d IS NOT NULL OR (t IS NOT NULL AND b IS NOT NULL)),
    quarter_raw AS (SELECT company, y, qn, item, kind, y * 4 + qn - 1 AS idx,
        arg_min(row(value, concept, accession, filed_date, note), priority) AS c
        FROM solved GROUP BY ALL)"""


def gross_sql(raw: str) -> str:
    """CTE `full_cells`: raw cells and the filled gross profit."""
    return f"""flat AS (SELECT company, y, qn, item, kind, idx, c[1] AS value, c[2] AS concept,
            c[3] AS accession, c[4] AS filed_date, c[5] AS note FROM {raw}),
        gross AS (SELECT company, y, qn, 'gross_profit' AS item, 'flow' AS kind, idx,
            max(value) FILTER (item = 'revenue') - max(value) FILTER (item = 'cost_of_revenue')
                AS value, NULL AS concept, NULL AS accession,
            greatest(max(filed_date) FILTER (item = 'revenue'),
                max(filed_date) FILTER (item = 'cost_of_revenue')) AS filed_date,
            'Revenue − Cost of revenue' AS note, count(*) FILTER (item = 'revenue') AS r,
            count(*) FILTER (item = 'cost_of_revenue') AS k FROM flat
            GROUP BY company, y, qn, idx HAVING r > 0 AND k > 0),
        full_cells AS (SELECT * FROM flat UNION ALL
            SELECT company, y, qn, item, kind, idx, value, concept, accession, filed_date, note
            FROM gross)"""


def _known(t: Tables):
    return S.prepared(t.filed_facts())


def _years(t: Tables):
    return S.fiscal_years(_known(t))


def _money(name: str = "value"):
    return qc(F.col(name).cast("double"), name, 2)


# --- Splits and fiscal years --------------------------------------------------------------


@query(
    "split_ratio",
    f"WITH RECURSIVE {SPLITS_SQL} SELECT company, effective, {q('ratio')} AS ratio FROM evidence",
)
def split_ratio(t: Tables):
    return S.split_evidence(t.filed_facts()).select("company", "effective", qc("ratio"))


@query(
    "split_events",
    f"WITH RECURSIVE {SPLITS_SQL} SELECT company, effective, {q('ratio')} AS ratio FROM events",
)
def split_events(t: Tables):
    return S.split_events(t.filed_facts()).select("company", "effective", qc("ratio"))


@query(
    "split_adjust",
    f"""WITH RECURSIVE {KNOWN_SQL} SELECT company, concept, period_start, period_end, accession,
        {q('value', 2)} AS value, note FROM adjusted WHERE unit = 'shares'""",
)
def split_adjust(t: Tables):
    rows = S.split_adjusted(t.filed_facts()).where("unit = 'shares'")
    return rows.select(
        "company", "concept", "period_start", "period_end", "accession", _money(), "note"
    )


@query(
    "fiscal_years",
    f"""WITH RECURSIVE {YEARS_SQL} SELECT company, y AS fiscal_year, make_date(y, 1, 1) AS start,
        CASE WHEN complete THEN make_date(y, 12, 31) ELSE ends[len(ends)] END AS "end",
        complete, array_to_string(ends, ',') AS quarter_ends FROM years""",
)
def fiscal_years(t: Tables):
    return _years(t).select(
        "company", big("fiscal_year"), "start", "end", "complete",
        F.array_join(F.col("quarter_ends").cast("array<string>"), ",").alias("quarter_ends"),
    )


@query(
    "year_labels",
    f"""WITH RECURSIVE {YEARS_SQL} SELECT company, make_date(y, 12, 31) AS "end",
        y AS fiscal_year FROM full_years""",
)
def year_labels(t: Tables):
    known = _known(t)
    labels = S.year_labels(known, S.annual_spans(known))
    return labels.select("company", "end", big("fiscal_year"))


@query(
    "in_progress",
    f"""WITH RECURSIVE {YEARS_SQL} SELECT company, y AS fiscal_year, CAST(len(ends) AS BIGINT)
        AS quarters, ends[len(ends)] AS "end" FROM years WHERE NOT complete""",
)
def in_progress(t: Tables):
    return _years(t).where("not complete").select(
        "company", big("fiscal_year"), big(F.size("quarter_ends"), "quarters"), "end"
    )


# --- Cells --------------------------------------------------------------------------------


def _cells(frame):
    return frame.select(
        "company", "period", "item", _money(), "concept", "accession", "filed_date", "derivation"
    )


_ANNUAL_KEY = "'FY' || CAST(y AS VARCHAR)"
_QUARTER_KEY = "'FY' || CAST(y AS VARCHAR) || '-Q' || CAST(qn AS VARCHAR)"


def _cells_sql(key: str, source: str = "flat") -> str:
    return f"""SELECT company, {key} AS period, item, {q('value', 2)} AS value, concept, accession,
        filed_date, note AS derivation FROM {source}"""


@query(
    "annual_cell",
    f"WITH RECURSIVE {ANNUAL_SQL}, {gross_sql('annual_raw')} {_cells_sql(_ANNUAL_KEY)}",
)
def annual_cell(t: Tables):
    known = _known(t)
    return _cells(S.annual_cells(known, S.annual_periods(S.fiscal_years(known))))


@query(
    "quarter_cell",
    f"WITH RECURSIVE {QUARTER_SQL}, {gross_sql('quarter_raw')} {_cells_sql(_QUARTER_KEY)}",
)
def quarter_cell(t: Tables):
    known = _known(t)
    return _cells(S.quarter_cells(known, S.quarter_periods(S.fiscal_years(known))))


@query(
    "gross_profit",
    f"""WITH RECURSIVE {ANNUAL_SQL}, {gross_sql('annual_raw')}
        {_cells_sql(_ANNUAL_KEY, 'full_cells')} WHERE item = 'gross_profit'""",
)
def gross_profit(t: Tables):
    return _cells(S.statements(t.filed_facts(), "annual").where("item = 'gross_profit'"))


@query(
    "statements",
    f"""WITH RECURSIVE {QUARTER_SQL}, {gross_sql('quarter_raw')}
        {_cells_sql(_QUARTER_KEY, 'full_cells')}""",
)
def statements(t: Tables):
    return _cells(S.statements(t.filed_facts(), "quarterly"))


_ADJ_SHARES = f"""{KNOWN_SQL},
    cover AS (SELECT company, period_end, accession, sum(value) AS shares,
        max(filed_date) AS filed_date, count(*) AS classes FROM adjusted
        WHERE concept = 'EntityCommonStockSharesOutstanding' GROUP BY 1, 2, 3),
    s1 AS (SELECT company, arg_max(row(shares, period_end, filed_date, classes),
        row(period_end, filed_date, accession)) AS b FROM cover GROUP BY 1),
    s2 AS (SELECT company, arg_max(row(value, period_end, filed_date, 1),
        row(period_end, filed_date, accession)) AS b FROM adjusted
        WHERE concept = 'CommonStockSharesOutstanding' GROUP BY 1),
    s3 AS (SELECT company, arg_max(row(value, period_end, filed_date, 1),
        row(period_end, filed_date, accession)) AS b FROM adjusted
        WHERE concept = 'WeightedAverageNumberOfSharesOutstandingBasic'
        AND period_end - period_start + 1 BETWEEN 80 AND 100 GROUP BY 1)"""
_COUNT = f"{q('b[1]', 2)} AS shares, b[2] AS period_end, b[3] AS filed_date"


@query(
    "shares_cover",
    f"WITH RECURSIVE {_ADJ_SHARES} SELECT company, {_COUNT}, b[4] AS classes FROM s1",
)
def shares_cover(t: Tables):
    found = S.shares_cover(S.split_adjusted(t.filed_facts()))
    return found.select("company", _money("shares"), "period_end", "filed_date", "classes")


@query("shares_reported", f"WITH RECURSIVE {_ADJ_SHARES} SELECT company, {_COUNT} FROM s3")
def shares_reported(t: Tables):
    found = S.shares_reported(
        S.split_adjusted(t.filed_facts()), "WeightedAverageNumberOfSharesOutstandingBasic", quarter=True
    )
    return found.select("company", _money("shares"), "period_end", "filed_date")


_MCAP_SHARES = """mcap AS (SELECT company, arg_min(b, place) AS b, arg_min(source, place) AS source
    FROM (SELECT company, row(b[1], b[2], b[3]) AS b, 0 AS place, 'cover-page' AS source FROM s1
    UNION ALL SELECT company, row(b[1], b[2], b[3]), 1, 'balance-sheet' FROM s2
    UNION ALL SELECT company, row(b[1], b[2], b[3]), 2, 'weighted-average basic' FROM s3)
    WHERE b[1] > 0 AND abs(DATE '{day}' - b[2]) <= 400 GROUP BY 1)"""


@query(
    "shares_mcap",
    f"""WITH RECURSIVE {_ADJ_SHARES}, {_MCAP_SHARES.format(day='2002-08-15')}
        SELECT company, {_COUNT}, source FROM mcap""",
)
def shares_mcap(t: Tables):
    reference = t.supplier.select(
        F.col("s_suppkey").alias("company"), F.lit("2002-08-15").cast("date").alias("reference")
    )
    found = S.shares_for_market_cap(t.filed_facts(), reference)
    return found.select("company", _money("shares"), "period_end", "filed_date", "source")


_TTM_SQL = f"""{QUARTER_SQL}, {gross_sql('quarter_raw')},
    ends AS (SELECT company, max(idx) AS last FROM full_cells GROUP BY 1),
    shape AS (SELECT company, last, count(DISTINCT idx) FILTER (idx > last - 4) AS n4,
        count(DISTINCT idx) FILTER (idx > last - 8) AS n8,
        arg_max({_QUARTER_KEY}, idx) AS label FROM full_cells JOIN ends USING (company)
        GROUP BY 1, 2 HAVING n4 = 4),
    parts AS (SELECT f.*, label, last - idx AS back, CASE WHEN last - idx < 4 THEN 'cur'
        WHEN last - idx < 8 AND n8 = 8 THEN 'prev' END AS span
        FROM full_cells f JOIN shape USING (company)),
    ttm AS (SELECT company, 'TTM ' || label AS label, span, item, CASE WHEN kind = 'instant'
        THEN max(value) FILTER (back % 4 = 0) WHEN kind = 'flow' AND count(*) = 4
        THEN sum(value) END AS value, CASE WHEN kind = 'instant'
        THEN max(filed_date) FILTER (back % 4 = 0) ELSE max(filed_date) END AS filed_date
        FROM parts WHERE span IS NOT NULL GROUP BY company, label, span, item, kind)"""
_BASIS = f"SELECT company, label, span, item, {q('value', 2)} AS value, filed_date"


@query("ttm_basis", f"WITH RECURSIVE {_TTM_SQL} {_BASIS} FROM ttm WHERE value IS NOT NULL")
def ttm_basis(t: Tables):
    found = M.ttm_basis(S.statements(t.filed_facts(), "quarterly"))
    return found.select("company", "label", "span", "item", _money(), "filed_date")


_FY_SQL = f"""{ANNUAL_SQL}, {gross_sql('annual_raw')},
    ends AS (SELECT company, max(idx) AS last FROM full_cells GROUP BY 1),
    fy AS (SELECT company, 'FY' || CAST(last AS VARCHAR) AS label,
        CASE WHEN idx = last THEN 'cur' ELSE 'prev' END AS span, item, value, filed_date
        FROM full_cells JOIN ends USING (company) WHERE idx >= last - 1)"""


@query("fy_basis", f"WITH RECURSIVE {_FY_SQL} {_BASIS} FROM fy")
def fy_basis(t: Tables):
    found = M.fy_basis(S.statements(t.filed_facts(), "annual"))
    return found.select("company", "label", "span", "item", _money(), "filed_date")


# --- Scalar formulas ----------------------------------------------------------------------

_ID = "l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2, l_partkey AS k3"


def _scalar(name: str, sql: str, build, digits: int = 6):
    """Register a scalar formula over line items: a, b, c are price, quantity − 25, discount."""

    @query(
        name,
        f"""WITH x AS (SELECT {_ID}, CASE WHEN l_linenumber <> 6 THEN l_extendedprice END AS a,
            CASE WHEN l_linenumber <> 7 THEN l_quantity - 25 END AS b, l_discount AS c
            FROM lineitem) SELECT k1, k2, k3, {q(sql, digits)} AS value FROM x""",
    )
    def run(t: Tables):
        rows = t.lineitem.select(
            F.col("l_orderkey").alias("k1"), big("l_linenumber", "k2"), F.col("l_partkey").alias("k3"),
            F.when(F.col("l_linenumber") != 6, F.col("l_extendedprice")).alias("a"),
            F.when(F.col("l_linenumber") != 7, F.col("l_quantity") - 25).alias("b"),
            F.col("l_discount").alias("c"),
        )
        return rows.select("k1", "k2", "k3", qc(build(), "value", digits))

    return run


_POSITIVE = "CASE WHEN b > 0 THEN a / b END"
_TOTAL = "CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) + 0 END"
_scalar("f_ratio", "CASE WHEN b <> 0 THEN a / b END", lambda: E.ratio("a", "b"), 4)
_scalar("f_margin", _POSITIVE, lambda: E.margin("a", "b"), 4)
_scalar("f_growth", "CASE WHEN b > 0 THEN a / b - 1 END", lambda: E.growth("a", "b"), 4)
_scalar(
    "f_cagr", "CASE WHEN a > 0 AND b > 0 THEN power(a / b, 1 / 3.0) - 1 END",
    lambda: E.cagr("a", "b", 3), 4,
)
_scalar("f_average", "(a + b) / 2", lambda: E.average("a", "b"), 2)
_scalar("f_difference", "a - b", lambda: E.difference("a", "b"), 2)
_scalar("f_total", _TOTAL, lambda: E.total("a", "b"), 2)
_scalar("f_fcf", "a - b", lambda: E.free_cash_flow("a", "b"), 2)
_scalar("f_ebitda", "a + b", lambda: E.ebitda("a", "b"), 2)
_scalar("f_nopat", "a * (1 - c)", lambda: E.nopat("a", "c"), 2)
_scalar("f_invested_capital", "a + b - c", lambda: E.invested_capital("a", "b", "c"), 2)
_scalar(
    "f_tax_rate", "CASE WHEN b > 0 AND a / 2000 / b BETWEEN 0 AND 1 THEN a / 2000 / b END",
    lambda: E.tax_rate(F.col("a") / 2000, "b"),
)
_scalar("f_return_on", _POSITIVE, lambda: E.return_on("a", "b"), 4)
_scalar("f_coverage", _POSITIVE, lambda: E.coverage("a", "b"), 4)
_scalar("f_leverage", _POSITIVE, lambda: E.leverage("a", "b"), 4)
_scalar("f_yield", _POSITIVE, lambda: E.yield_on("a", "b"), 4)
_scalar("f_multiple", _POSITIVE, lambda: E.multiple("a", "b"), 4)
_scalar(
    "f_quick_assets", "CASE WHEN a IS NOT NULL THEN a + coalesce(b, 0) + c END",
    lambda: E.quick_assets("a", "b", "c"), 2,
)


# --- Metrics ------------------------------------------------------------------------------

_USED = (
    "revenue cost_of_revenue gross_profit net_income operating_cash_flow total_assets "
    "total_equity shares_diluted operating_income depreciation_amortization long_term_debt cash "
    "capex"
).split()
_WIDE = "wide AS (SELECT company, idx, " + ", ".join(
    f"max(value) FILTER (item = '{i}') AS {i}" for i in _USED
) + ", max(filed_date) AS filed_date FROM full_cells GROUP BY 1, 2)"


def _pos(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"


def _grow(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) - 1 END"


_EBITDA = "(w.operating_income + w.depreciation_amortization)"


def metric_sql(annual: bool) -> dict[str, str]:
    """Metric formulas over w (current), p (previous), g (year ago), h3 and h5 (years ago)."""
    found = {
        "revenue_growth_yoy": _grow("w.revenue", "g.revenue"),
        "net_income_growth_yoy": _grow("w.net_income", "g.net_income"),
        "fcf_growth_yoy": _grow(
            "w.operating_cash_flow - w.capex", "(g.operating_cash_flow - g.capex)"
        ),
        "gross_margin": _pos("w.gross_profit", "w.revenue"),
        "operating_margin": _pos("w.operating_income", "w.revenue"),
        "ebitda_margin": _pos(_EBITDA, "w.revenue"),
        "net_margin": _pos("w.net_income", "w.revenue"),
        "fcf_margin": _pos("w.operating_cash_flow - w.capex", "w.revenue"),
        "ebitda": _EBITDA,
        "total_debt": "w.long_term_debt",
        "debt_to_equity": _pos("w.long_term_debt", "w.total_equity"),
        "operating_cash_flow": "w.operating_cash_flow",
        "capex": "w.capex",
        "free_cash_flow": "w.operating_cash_flow - w.capex",
        "capex_to_revenue": _pos("w.capex", "w.revenue"),
        "share_dilution_yoy": _grow("w.shares_diluted", "g.shares_diluted"),
    }
    if not annual:
        found["revenue_growth_qoq"] = _grow("w.revenue", "p.revenue")
        return found
    cagr = lambda h, n: (
        f"CASE WHEN w.revenue > 0 AND {h}.revenue > 0 "
        f"THEN power(w.revenue / {h}.revenue, 1 / {n}.0) - 1 END"
    )
    return found | {
        "revenue_cagr_3y": cagr("h3", 3),
        "revenue_cagr_5y": cagr("h5", 5),
        "roe": _pos("w.net_income", "((p.total_equity + w.total_equity) / 2)"),
        "roa": _pos("w.net_income", "((p.total_assets + w.total_assets) / 2)"),
        "debt_to_ebitda": _pos("w.long_term_debt", _EBITDA),
        "net_debt_to_ebitda": _pos("w.long_term_debt - w.cash", _EBITDA),
    }


def series_sql(annual: bool) -> str:
    """CTE `series`: (company, idx, metric, value)."""
    step = 1 if annual else 4
    joins = " ".join(
        f"LEFT JOIN wide {a} ON {a}.company = w.company AND {a}.idx = w.idx - {n}"
        for a, n in (("p", 1), ("g", step), ("h3", 3 * step), ("h5", 5 * step))
    )
    rows = " UNION ALL ".join(
        f"SELECT w.company, w.idx, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM wide w {joins}"
        for m, e in metric_sql(annual).items()
    )
    return f"{_WIDE}, series AS (SELECT * FROM ({rows}) WHERE value IS NOT NULL)"


@query(
    "metric_context",
    f"""WITH RECURSIVE {QUARTER_SQL}, {gross_sql('quarter_raw')}, {_WIDE}
        SELECT w.company, w.idx, {q('w.revenue', 2)} AS current, {q('g.revenue', 2)} AS year_ago,
            {q('p.revenue', 2)} AS previous FROM wide w
        LEFT JOIN wide g ON g.company = w.company AND g.idx = w.idx - 4
        LEFT JOIN wide p ON p.company = w.company AND p.idx = w.idx - 1""",
)
def metric_context(t: Tables):
    found = M.metric_context(S.statements(t.filed_facts(), "quarterly"), "revenue", annual=False)
    return found.select(
        "company", "idx", *[qc(c, digits=2) for c in ("current", "year_ago", "previous")]
    )


@query(
    "metric_series",
    f"""WITH RECURSIVE {ANNUAL_SQL}, {gross_sql('annual_raw')}, {series_sql(True)}
        SELECT company, idx, metric, {q('value', 4)} AS value FROM series""",
)
def metric_series(t: Tables):
    found = M.metric_series(S.statements(t.filed_facts(), "annual"), annual=True)
    return found.select("company", "idx", "metric", qc("value", digits=4))


@query(
    "statement_view",
    f"""WITH RECURSIVE {QUARTER_SQL}, {gross_sql('quarter_raw')}, {series_sql(False)},
        kept AS (SELECT company, idx, row_number() OVER (PARTITION BY company ORDER BY idx DESC)
            AS back FROM (SELECT DISTINCT company, idx FROM full_cells) QUALIFY back <= 8)
        SELECT company, idx, part, name, {q('value', 4)} AS value FROM (
            SELECT company, idx, 'item' AS part, item AS name, value FROM full_cells UNION ALL
            SELECT company, idx, 'metric', metric, value FROM series)
        SEMI JOIN kept USING (company, idx)""",
)
def statement_view(t: Tables):
    found = M.statement_view(S.statements(t.filed_facts(), "quarterly"), 8, annual=False)
    return found.select("company", "idx", "part", "name", qc("value", digits=4))


def _prices(t: Tables):
    """Listed companies' closes: brand number n is listed by supplier n."""
    bars = t.raw_bars().select(
        F.substring_index("security_id", "#", -1).cast("bigint").alias("company"), "trade_date", "close"
    )
    return bars.withColumn(
        "adj_close", F.when(F.dayofmonth("trade_date") % 2 == 0, F.col("close") * 0.9)
    )


_PRICES = """prices AS (SELECT CAST(substr(security_id, 7) AS BIGINT) AS company, trade_date, close,
        CASE WHEN day(trade_date) % 2 = 0 THEN close * 0.9 ELSE close END AS own FROM v_raw_bars),
    newest AS (SELECT company, max(trade_date) AS last, arg_max(own, trade_date) AS now,
        arg_max(close, trade_date) AS price FROM prices GROUP BY 1),
    moved AS (SELECT company, last, now, price, """ + ", ".join(
    f"arg_max(own, trade_date) FILTER (trade_date BETWEEN last - {d} - 7 AND last - {d}) AS b{n}"
    for n, d in ((1, 30), (3, 91), (6, 183), (12, 365))
) + """ FROM prices JOIN newest USING (company) GROUP BY 1, 2, 3, 4)"""
_VOL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY trade_date DESC)
        AS back FROM prices QUALIFY back <= 253),
    steps AS (SELECT company, ln(own / lag(own) OVER (PARTITION BY company ORDER BY trade_date))
        AS s FROM ranked),
    vols AS (SELECT company, CASE WHEN count(s) >= 200 THEN stddev_samp(s) * sqrt(252) END AS vol
        FROM steps GROUP BY 1)"""


@query(
    "momentum_nm",
    f"""WITH {_PRICES} SELECT company, last AS price_date, """
    + ", ".join(f"{q(f'now / b{n} - 1')} AS momentum_{n}m" for n in (1, 3, 6, 12))
    + " FROM moved",
)
def momentum_nm(t: Tables):
    found = M.momentum(_prices(t))
    return found.select(
        "company", "price_date", *[qc(f"momentum_{n}m") for n in (1, 3, 6, 12)]
    )


@query(
    "volatility_1y", f"WITH {_PRICES}, {_VOL} SELECT company, {q('vol', 5)} AS volatility_1y FROM vols"
)
def volatility_1y(t: Tables):
    return M.volatility_1y(_prices(t)).select("company", qc("volatility_1y", digits=5))


_BASIS_SQL = {
    "revenue": "revenue",
    "revenue_growth_yoy": _grow("revenue", "p_revenue"),
    "gross_margin": _pos("gross_profit", "revenue"),
    "operating_margin": _pos("operating_income", "revenue"),
    "net_margin": _pos("net_income", "revenue"),
    "fcf_margin": _pos("operating_cash_flow - capex", "revenue"),
    "roe": _pos("net_income", "((p_total_equity + total_equity) / 2)"),
    "roa": _pos("net_income", "((p_total_assets + total_assets) / 2)"),
    "debt_to_equity": _pos("long_term_debt", "total_equity"),
    "debt_to_ebitda": _pos("long_term_debt", "(operating_income + depreciation_amortization)"),
    "net_debt_to_ebitda": _pos(
        "long_term_debt - cash", "(operating_income + depreciation_amortization)"
    ),
}
_EV = "(cap + long_term_debt - cash)"
_MARKET_SQL = {
    "enterprise_value": _EV,
    "pe_ratio": _pos("cap", "net_income"),
    "price_to_sales": _pos("cap", "revenue"),
    "price_to_book": _pos("cap", "total_equity"),
    "ev_to_ebitda": _pos(_EV, "(operating_income + depreciation_amortization)"),
    "fcf_yield": _pos("operating_cash_flow - capex", "cap"),
}


def snapshot_sql(value: str | None = None) -> str:
    """Latest metrics per company; `value`: the name of the value unrounded, else rounded."""
    picks = ", ".join(
        f"max(value) FILTER (span = 'cur' AND item = '{i}') AS {i}, "
        f"max(value) FILTER (span = 'prev' AND item = '{i}') AS p_{i}" for i in _USED
    )
    fundamental = " UNION ALL ".join(
        f"SELECT company, place, '{m}' AS metric, CAST({e} AS DOUBLE) AS value, label AS basis, "
        f"available FROM bases" for m, e in _BASIS_SQL.items()
    )
    market = " UNION ALL ".join(
        f"SELECT company, place, '{m}', CAST({e} AS DOUBLE), cap_label || '; ' || label, "
        f"greatest(cap_available, available) FROM bases JOIN caps USING (company)"
        for m, e in _MARKET_SQL.items()
    )
    prices = " UNION ALL ".join(
        f"SELECT company, 0, 'momentum_{n}m', now / b{n} - 1, 'Close ' || CAST(last AS VARCHAR), last "
        f"FROM moved" for n in (1, 3, 6, 12)
    )
    quarter_gross = gross_sql("quarter_raw")
    annual = (
        gross_sql("annual_raw").replace("full_cells", "full_a").replace("flat", "flat_a")
        .replace("gross AS", "gross_a AS").replace("FROM gross)", "FROM gross_a)")
    )
    annual_cte = ANNUAL_SQL[len(YEARS_SQL):]
    return f"""WITH RECURSIVE {_TTM_SQL} {annual_cte}, {annual},
        ends_a AS (SELECT company, max(idx) AS last FROM full_a GROUP BY 1),
        fy AS (SELECT company, 'FY' || CAST(last AS VARCHAR) AS label, CASE WHEN idx = last
            THEN 'cur' ELSE 'prev' END AS span, item, value, filed_date
            FROM full_a JOIN ends_a USING (company) WHERE idx >= last - 1),
        merged AS (SELECT 0 AS place, * FROM ttm WHERE value IS NOT NULL UNION ALL
            SELECT 1, * FROM fy),
        bases AS (SELECT company, place, label, {picks},
            max(filed_date) FILTER (span = 'cur') AS available FROM merged GROUP BY 1, 2, 3),
        wide_a AS (SELECT company, idx, max(value) FILTER (item = 'revenue') AS revenue,
            max(filed_date) AS filed FROM full_a GROUP BY 1, 2),
        {_PRICES}, {_VOL},
        {_ADJ_SHARES[len(KNOWN_SQL) + 1:]}, {_MCAP_SHARES.replace("DATE '{day}'", "last").replace("WHERE b[1] > 0", "JOIN newest USING (company) WHERE b[1] > 0")},
        caps AS (SELECT company, price * b[1] AS cap, greatest(last, b[3]) AS cap_available,
            'Close ' || CAST(last AS VARCHAR) || ' × ' || source || ' shares '
                || CAST(b[2] AS VARCHAR) AS cap_label, last FROM mcap JOIN newest USING (company)),
        alls AS ({fundamental} UNION ALL {market} UNION ALL {prices} UNION ALL
            SELECT company, 0, 'volatility_1y', vol, 'Close ' || CAST(last AS VARCHAR), last
                FROM vols JOIN newest USING (company) UNION ALL
            SELECT company, 0, 'market_cap', cap, cap_label, cap_available FROM caps UNION ALL
            SELECT w.company, 0, 'revenue_cagr_3y', CASE WHEN w.revenue > 0 AND h.revenue > 0
                THEN power(w.revenue / h.revenue, 1 / 3.0) - 1 END, 'FY' || CAST(last AS VARCHAR),
                w.filed FROM wide_a w JOIN ends_a e ON e.company = w.company AND e.last = w.idx
                JOIN wide_a h ON h.company = w.company AND h.idx = w.idx - 3),
        best AS (SELECT company, metric, arg_min(row(value, basis, available), place) AS b
            FROM alls WHERE value IS NOT NULL GROUP BY 1, 2)
        SELECT company, metric, {f'b[1] AS {value}' if value else q('b[1]', 3) + ' AS value'}, b[2] AS basis, b[3] AS available
        FROM best"""


@query("snapshot_metrics", snapshot_sql())
def snapshot_metrics(t: Tables):
    found = M.snapshot_metrics(t.filed_facts(), _prices(t))
    return found.select("company", "metric", qc("value", digits=3), "basis", "available")


@query(
    "peers",
    """WITH c AS (SELECT c_custkey AS company, c_name AS name,
            lpad(CAST((c_custkey * 7) % 180 * 50 AS VARCHAR), 4, '0') AS sic FROM customer),
        r AS (SELECT c.*, substr(sic, 1, 2) AS major, value AS revenue,
            count(*) OVER (PARTITION BY sic) - 1 AS others
            FROM c LEFT JOIN (SELECT company, value FROM v_metrics WHERE metric = 'revenue') m
            USING (company)),
        pairs AS (SELECT a.company, CASE WHEN a.others >= 3 THEN 'sic' ELSE 'major' END AS basis,
            b.company AS peer, row_number() OVER (PARTITION BY a.company
                ORDER BY b.revenue DESC NULLS LAST, b.name, b.company) AS place
            FROM r a JOIN r b ON a.company <> b.company
            AND CASE WHEN a.others >= 3 THEN a.sic = b.sic ELSE a.major = b.major END),
        named AS (SELECT company, 3 * company + 2 * k AS peer, k AS place FROM c, range(12) t(k) WHERE company % 50 = 0)
        SELECT company, basis, peer, place FROM pairs WHERE place <= 10 AND company % 50 <> 0
        UNION ALL SELECT n.company, 'named', peer, place FROM (SELECT n.company, peer, row_number() OVER (PARTITION BY n.company ORDER BY n.place) AS place
            FROM named n JOIN c ON c.company = n.peer WHERE n.company <> peer) n WHERE place <= 10""",
)
def peers(t: Tables):
    sic = F.lpad((((F.col("c_custkey") * 7) % 180) * 50).cast("string"), 4, "0")
    companies = t.customer.select(
        F.col("c_custkey").alias("company"), F.col("c_name").alias("name"), sic.alias("sic"), F.concat(F.lit("TK"), "c_custkey").alias("ticker")
    )
    asked = t.customer.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("company"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("place"))
    named = asked.withColumn("ticker", F.concat(F.lit("tk"), (3 * F.col("company") + 2 * F.col("place")).cast("string")))
    return M.peers(companies, t.metrics(), named=named)

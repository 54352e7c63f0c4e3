"""Valuation, ownership and insider queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import ownership as O
from tidemark.operators import prices as P
from tidemark.operators import statements as S
from tidemark.operators import valuation as V
from tidemark.plans.base import big, q, qc, query
from tidemark.plans.fundamentals import _PRICES, _WIDE, ANNUAL_SQL, _prices, gross_sql
from tidemark.sources.views import Tables

# Assumptions per order: derived columns shared by both sides.
_INPUTS = {
    "base_revenue": "o_totalprice - 5000.0",
    "growth": "(o_orderkey % 30) / 100.0::DOUBLE",
    "margin": "(o_custkey % 25) / 100.0::DOUBLE",
    "long_run_margin": "(o_custkey % 20) / 100.0::DOUBLE",
    "terminal_growth": "(o_orderkey % 8) / 100.0::DOUBLE",
    "tax_rate": "(o_custkey % 35) / 100.0::DOUBLE",
    "sales_to_capital": "1.0 + (o_orderkey % 3)",
    "discount_rate": "0.05 + (o_custkey % 7) / 100.0::DOUBLE",
    "debt": "o_totalprice / 10",
    "cash": "o_totalprice / 20",
    "shares": "1000.0 + o_custkey",
}
_A = "a AS (SELECT o_orderkey AS company, " + ", ".join(f"{e} AS {n}" for n, e in _INPUTS.items()) + " FROM orders)"


def _assumptions(t: Tables):
    spark_sql = {n: e.replace("::DOUBLE", "D") for n, e in _INPUTS.items()}
    return t.orders.select(
        F.col("o_orderkey").alias("company"),
        *[F.expr(e).cast("double").alias(n) for n, e in spark_sql.items()],
        F.lit(None).cast("double").alias("terminal_roic"),
        F.lit(None).cast("double").alias("long_run_roe"),
        F.col("o_totalprice").alias("book_value"),
        (F.col("o_custkey") % 11 / 10.0).cast("double").alias("payout_ratio"),
        ((F.col("o_orderkey") % 40) / 100.0).cast("double").alias("roe"),
        (F.lit(0.05) + (F.col("o_custkey") % 7) / 100.0).cast("double").alias("cost_of_equity"),
        ((F.col("o_orderkey") % 50) / 10.0 - 0.5).cast("double").alias("dividend_per_share"),
        (F.col("o_totalprice") / 100).alias("price"),
    )


@query(
    "wacc",
    f"""WITH x AS (SELECT o_orderkey AS company, 0.04 + 0.05 * (o_custkey % 20) / 10.0::DOUBLE AS ke,
            o_totalprice AS e, (o_orderkey % 5) * 20000.0 AS d, 0.06 * (1 - 0.21) AS kd FROM orders)
        SELECT company, {q('ke')} AS cost_of_equity, {q('(1 - d / (e + d)) * ke + d / (e + d) * kd')}
            AS wacc FROM x""",
)
def wacc(t: Tables):
    rows = t.orders.select(
        F.col("o_orderkey").alias("company"), F.lit(0.04).alias("risk_free"),
        ((F.col("o_custkey") % 20) / 10.0).alias("beta"), F.lit(0.05).alias("equity_risk_premium"),
        F.lit(0.06).alias("pre_tax_cost_of_debt"), F.lit(0.21).alias("tax_rate"),
        F.col("o_totalprice").alias("equity_value"),
        ((F.col("o_orderkey") % 5) * 20000.0).alias("debt_value"),
    )
    return rows.select("company", qc(V.cost_of_equity(), "cost_of_equity"), qc(V.wacc(), "wacc"))


def _dcf_sql(source: str) -> str:
    """CTE `valued` from a source with DCF assumptions and keys."""
    fade = lambda a, b: f"CASE WHEN y <= 5 THEN {a} ELSE {a} + ({b} - {a}) * (y - 5) / 5.0::DOUBLE END"
    return f"""yrs AS (SELECT s.*, y, {fade('growth', 'terminal_growth')} AS g,
            {fade('margin', 'long_run_margin')} AS m FROM {source} s, range(1, 11) r(y)
            WHERE discount_rate - terminal_growth >= 0.005 AND terminal_growth BETWEEN -0.05 AND 0.06
            AND base_revenue > 0),
        rev AS (SELECT *, base_revenue * product(1 + g) OVER w AS revenue FROM yrs
            WINDOW w AS (PARTITION BY key ORDER BY y ROWS UNBOUNDED PRECEDING)),
        flow AS (SELECT *, CASE WHEN revenue * m > 0 THEN revenue * m * (1 - tax_rate)
            ELSE revenue * m END - (revenue - revenue / (1 + g)) / sales_to_capital AS cf FROM rev),
        valued AS (SELECT key, any_value(company) AS company, sum(cf / power(1 + discount_rate, y))
            AS pv, arg_max(revenue, y) * (1 + any_value(terminal_growth)) * any_value(long_run_margin)
            * (1 - any_value(tax_rate)) * (1 - any_value(terminal_growth) / any_value(discount_rate))
            / (any_value(discount_rate) - any_value(terminal_growth))
            / power(1 + any_value(discount_rate), 10) AS tv,
            any_value(debt) AS debt, any_value(cash) AS cash, any_value(shares) AS shares
            FROM flow GROUP BY key)"""


def _dcf_row_sql(source: str) -> str:
    """CTE `valued` with one row per source row: the ten years written out as columns, for large sources."""
    fade = lambda a, b, y: a if y <= 5 else f"({a} + ({b} - {a}) * {y - 5} / 5.0::DOUBLE)"
    years = range(1, 11)
    revenue = ", ".join(
        f"{'base_revenue' if y == 1 else f'r{y - 1}'} * (1 + {fade('growth', 'terminal_growth', y)}) AS r{y}" for y in years
    )
    income = ", ".join(f"r{y} * {fade('margin', 'long_run_margin', y)} AS i{y}" for y in years)
    flow = " + ".join(
        f"(CASE WHEN i{y} > 0 THEN i{y} * (1 - tax_rate) ELSE i{y} END - (r{y} - {'base_revenue' if y == 1 else f'r{y - 1}'})"
        f" / sales_to_capital) / power(1 + discount_rate, {y})"
        for y in years
    )
    return f"""revenues AS MATERIALIZED (SELECT *, {revenue} FROM {source} WHERE discount_rate - terminal_growth >= 0.005
            AND terminal_growth BETWEEN -0.05 AND 0.06 AND base_revenue > 0),
        incomes AS MATERIALIZED (SELECT *, {income} FROM revenues),
        valued AS (SELECT *, {flow} AS pv, r10 * (1 + terminal_growth) * long_run_margin * (1 - tax_rate)
            * (1 - terminal_growth / discount_rate) / (discount_rate - terminal_growth) / power(1 + discount_rate, 10) AS tv
            FROM incomes)"""


@query(
    "dcf",
    f"""WITH {_A}, k AS (SELECT *, company AS key FROM a), {_dcf_sql('k')}
        SELECT a.company, {q('pv', 2)} AS pv_explicit, {q('tv', 2)} AS pv_terminal,
            {q('(pv + tv - v.debt + v.cash) / v.shares', 4)} AS per_share,
            CASE WHEN discount_rate - terminal_growth < 0.005
                THEN 'discount rate must exceed terminal growth'
                WHEN NOT terminal_growth BETWEEN -0.05 AND 0.06 THEN 'terminal growth out of range'
                WHEN base_revenue <= 0 THEN 'revenue must be positive' END AS error
        FROM a LEFT JOIN valued v USING (company)""",
)
def dcf(t: Tables):
    return V.dcf(_assumptions(t)).select(
        "company", qc("pv_explicit", digits=2), qc("pv_terminal", digits=2),
        qc("per_share", digits=4), "error",
    )


@query(
    "rim",
    f"""WITH b AS (SELECT o_orderkey AS company, o_totalprice AS bv, (o_orderkey % 40) / 100.0::DOUBLE
            AS roe, 0.05 + (o_custkey % 7) / 100.0::DOUBLE AS ke, (o_custkey % 11) / 10.0::DOUBLE AS pay,
            (o_orderkey % 8) / 100.0::DOUBLE AS tg, 1000.0 + o_custkey AS sh FROM orders),
        y AS (SELECT b.*, y, CASE WHEN y <= 5 THEN roe ELSE roe + (ke - roe) * (y - 5) / 5.0::DOUBLE END
            AS r FROM b, range(1, 11) q(y) WHERE ke - tg >= 0.005 AND tg BETWEEN -0.05 AND 0.06),
        p AS (SELECT *, coalesce(product(1 + r * (1 - pay)) OVER (PARTITION BY company ORDER BY y
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * bv AS book FROM y),
        v AS (SELECT company, sum((r - ke) * book / power(1 + ke, y)) AS pv FROM p GROUP BY 1)
        SELECT b.company, {q('(bv + pv) / sh', 4)} AS per_share FROM b LEFT JOIN v USING (company)""",
)
def rim(t: Tables):
    return V.rim(_assumptions(t)).select("company", qc("per_share", digits=4))


@query(
    "ddm",
    f"""WITH b AS (SELECT o_orderkey AS company, (o_orderkey % 50) / 10.0::DOUBLE - 0.5 AS dps,
            (o_orderkey % 30) / 100.0::DOUBLE AS g1, 0.05 + (o_custkey % 7) / 100.0::DOUBLE AS ke,
            (o_orderkey % 8) / 100.0::DOUBLE AS tg FROM orders),
        y AS (SELECT b.*, y, CASE WHEN y <= 5 THEN g1 ELSE g1 + (tg - g1) * (y - 5) / 5.0::DOUBLE END
            AS g FROM b, range(1, 11) q(y) WHERE ke - tg >= 0.005 AND tg BETWEEN -0.05 AND 0.06
            AND dps > 0),
        p AS (SELECT *, dps * product(1 + g) OVER (PARTITION BY company ORDER BY y
            ROWS UNBOUNDED PRECEDING) AS d FROM y),
        v AS (SELECT company, sum(d / power(1 + ke, y)) + max(d) FILTER (y = 10) * (1 + max(tg))
            / (max(ke) - max(tg)) / power(1 + max(ke), 10) AS v FROM p GROUP BY 1)
        SELECT b.company, {q('v', 4)} AS per_share FROM b LEFT JOIN v USING (company)""",
)
def ddm(t: Tables):
    return V.ddm(_assumptions(t)).select("company", qc("per_share", digits=4))


_SHIFTS = ", ".join(f"('{n}', {g}, {m}, {r}, {x})" for n, (g, m, r, x) in V.SCENARIOS.items())


_SHIFTED = f"""sc(scenario, g, m, r, x) AS (VALUES {_SHIFTS}),
    eq AS (SELECT o_orderkey AS company, scenario, o_totalprice AS bv, (o_orderkey % 40) / 100.0::DOUBLE + m::DOUBLE AS roe,
        (o_custkey % 11) / 10.0::DOUBLE AS pay, 1000.0 + o_custkey AS sh, (o_orderkey % 50) / 10.0::DOUBLE - 0.5 AS dps,
        (o_orderkey % 30) / 100.0::DOUBLE + g::DOUBLE AS g1, 0.05 + (o_custkey % 7) / 100.0::DOUBLE + r::DOUBLE AS ke,
        (o_orderkey % 8) / 100.0::DOUBLE + x::DOUBLE AS tg FROM orders, sc),
    usable AS (SELECT eq.*, y, CASE WHEN y <= 5 THEN roe ELSE roe + (ke - roe) * (y - 5) / 5.0::DOUBLE END AS earned,
        CASE WHEN y <= 5 THEN g1 ELSE g1 + (tg - g1) * (y - 5) / 5.0::DOUBLE END AS grown FROM eq, range(1, 11) q(y)
        WHERE ke - tg >= 0.005 AND tg BETWEEN -0.05 AND 0.06),
    paths AS (SELECT *, coalesce(product(1 + earned * (1 - pay)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * bv AS book,
        dps * product(1 + grown) OVER (w ROWS UNBOUNDED PRECEDING) AS dividend FROM usable WINDOW w AS (PARTITION BY company, scenario ORDER BY y)),
    others AS (SELECT company, scenario, (any_value(bv) + sum((earned - ke) * book / power(1 + ke, y))) / any_value(sh) AS rim,
        CASE WHEN any_value(dps) > 0 THEN sum(dividend / power(1 + ke, y)) + max(dividend) FILTER (y = 10) * (1 + any_value(tg))
            / (any_value(ke) - any_value(tg)) / power(1 + any_value(ke), 10) END AS ddm FROM paths GROUP BY 1, 2)"""


@query(
    "scenarios",
    f"""WITH {_A}, k AS (SELECT a.* REPLACE (growth + g::DOUBLE AS growth, margin + m::DOUBLE AS margin,
            long_run_margin + m::DOUBLE AS long_run_margin, discount_rate + r::DOUBLE AS discount_rate,
            terminal_growth + x::DOUBLE AS terminal_growth), scenario,
            CAST(company AS VARCHAR) || scenario AS key
            FROM a, (VALUES {_SHIFTS}) s(scenario, g, m, r, x)), {_dcf_sql('k')}, {_SHIFTED}
        SELECT 'dcf' AS model, k.company, k.scenario, {q('(pv + tv - v.debt + v.cash) / v.shares', 3)} AS per_share
        FROM k LEFT JOIN valued v USING (key)
        UNION ALL SELECT 'rim', eq.company, eq.scenario, {q('rim', 3)} FROM eq LEFT JOIN others USING (company, scenario)
        UNION ALL SELECT 'ddm', eq.company, eq.scenario, {q('ddm', 3)} FROM eq LEFT JOIN others USING (company, scenario)""",
)
def scenarios(t: Tables):
    rows = _assumptions(t)
    of = lambda model: V.scenarios(rows, model).select(F.lit(model).alias("model"), "company", "scenario", qc("per_share", digits=3))
    return of("dcf").unionByName(of("rim")).unionByName(of("ddm"))


@query(
    "j_cross_grid",
    f"""WITH {_A}, k AS (SELECT a.* REPLACE (growth + g::DOUBLE AS growth, margin + m::DOUBLE AS margin,
            long_run_margin + m::DOUBLE AS long_run_margin), g::DOUBLE AS row_step,
            m::DOUBLE AS column_step, CAST(company AS VARCHAR) || '/' || g || '/' || m AS key
            FROM a, (VALUES (-0.04), (-0.02), (0.0), (0.02), (0.04)) r(g),
            (VALUES (-0.04), (-0.02), (0.0), (0.02), (0.04)) c(m)), {_dcf_sql('k')}
        SELECT k.row_step, k.column_step, count(*) AS companies, count(pv) AS valued,
            {q('avg((pv + tv - v.debt + v.cash) / v.shares)', 2)} AS per_share
        FROM k LEFT JOIN valued v USING (key) GROUP BY 1, 2""",
)
def j_cross_grid(t: Tables):
    grid = V.sensitivity(_assumptions(t), "dcf", "growth", "margin")
    return grid.groupBy("row_step", "column_step").agg(
        F.count(F.lit(1)).alias("companies"), F.count("per_share").alias("valued"),
        qc(F.avg("per_share"), "per_share", 2),
    )


@query(
    "sensitivity",
    f"""WITH {_A}, k AS (SELECT a.* REPLACE (discount_rate + g::DOUBLE AS discount_rate,
            terminal_growth + m::DOUBLE AS terminal_growth), g::DOUBLE AS row_step,
            m::DOUBLE AS column_step, CAST(company AS VARCHAR) || '/' || g || '/' || m AS key
            FROM a, (VALUES (-0.01), (-0.005), (0.0), (0.005), (0.01)) r(g),
            (VALUES (-0.01), (-0.005), (0.0), (0.005), (0.01)) c(m)), {_dcf_row_sql('k')}
        SELECT k.company, k.row_step, k.column_step,
            {q('(pv + tv - v.debt + v.cash) / v.shares', 1)} AS per_share
        FROM k LEFT JOIN valued v USING (key)""",
)
def sensitivity(t: Tables):
    return V.sensitivity(_assumptions(t), "dcf", "rate", "terminal").select(
        "company", "row_step", "column_step", qc("per_share", digits=1)
    )


@query(
    "risk_free",
    """SELECT arg_max(value, observed_on) AS risk_free, max(observed_on) AS observed_on FROM v_yield
        WHERE tenor = '10 Yr'""",
)
def risk_free(t: Tables):
    return V.risk_free(t.yields())


@query("val_defaults")
def val_defaults(t: Tables):
    betas = P.weekly_beta(t.bars(), t.bench()).select(
        F.substring_index("security_id", "#", -1).cast("bigint").alias("company"), "adjusted"
    )
    companies = t.supplier.select(
        F.col("s_suppkey").alias("company"),
        F.lpad((F.col("s_suppkey") * 97 % 10000).cast("string"), 4, "0").alias("sic"),
    )
    found = V.defaults(t.filed_facts(), companies, betas, t.yields(), _prices(t))
    keep = {"company", "beta_source", "tax_source", "recommended"}
    return found.select(*[c if c in keep else qc(c, digits=4) for c in found.columns])


_RELATIVE = """WITH c AS (SELECT c_custkey AS company, c_name AS name,
            lpad(CAST((c_custkey * 7) % 180 * 50 AS VARCHAR), 4, '0') AS sic FROM customer),
        m AS (SELECT company, metric, value FROM v_metrics WHERE metric IN ('pe_ratio', 'net_income')),
        r AS (SELECT c.*, substr(sic, 1, 2) AS major, count(*) OVER (PARTITION BY sic) - 1 AS others,
            revenue FROM c LEFT JOIN (SELECT company, value AS revenue FROM v_metrics
            WHERE metric = 'revenue') USING (company)),
        pairs AS (SELECT a.company, b.company AS peer, row_number() OVER (PARTITION BY a.company
                ORDER BY b.revenue DESC NULLS LAST, b.name, b.company) AS place
            FROM r a JOIN r b ON a.company <> b.company
            AND CASE WHEN a.others >= 3 THEN a.sic = b.sic ELSE a.major = b.major END
            QUALIFY place <= 10),
        pm AS (SELECT p.company, metric, median(value) AS med, count(*) AS n FROM pairs p
            JOIN m ON m.company = p.peer WHERE value > 0 GROUP BY 1, 2),
        gm AS (SELECT a.company, m.metric, median(m.value) AS med, count(*) AS n FROM r a JOIN r b
            ON a.major = b.major AND a.company <> b.company JOIN m ON m.company = b.company
            WHERE m.value > 0 GROUP BY 1, 2)"""


def _relative(t: Tables):
    sic = F.lpad((((F.col("c_custkey") * 7) % 180) * 50).cast("string"), 4, "0")
    companies = t.customer.select(
        F.col("c_custkey").alias("company"), F.col("c_name").alias("name"), sic.alias("sic")
    )
    groups = companies.select("company", F.substring("sic", 1, 2).alias("grp"))
    return V.relative(t.metrics(), M.peers(companies, t.metrics()), groups, ["pe_ratio", "net_income"])


@query(
    "relative_val",
    f"""{_RELATIVE}
        SELECT m.company, m.metric, {q('m.value', 2)} AS value, {q('pm.med', 3)} AS peer_median,
            coalesce(pm.n, 0) AS peer_count, {q('gm.med', 3)} AS group_median,
            coalesce(gm.n, 0) AS group_count
        FROM m LEFT JOIN pm USING (company, metric) LEFT JOIN gm USING (company, metric)""",
)
def relative_val(t: Tables):
    found = _relative(t)
    return found.select(
        "company", "metric", qc("value", digits=2), qc("peer_median", digits=3), "peer_count",
        qc("group_median", digits=3), big("group_count"),
    )


@query(
    "implied_value",
    f"""{_RELATIVE},
        own AS (SELECT company, value FROM v_metrics WHERE metric = 'net_income')
        SELECT m.company, {q('pm.med * own.value / (1000 + m.company)', 3)} AS implied_per_share
        FROM m JOIN pm USING (company, metric) JOIN own USING (company)
        WHERE m.metric = 'pe_ratio' AND own.value > 0""",
)
def implied_value(t: Tables):
    net_income = F.max(F.when(F.col("metric") == "net_income", F.col("value")))
    unknown = [F.lit(None).cast("double").alias(c) for c in ("ebitda", "revenue", "total_equity", "debt", "cash")]
    own = t.metrics().groupBy("company").agg(net_income.alias("net_income"))
    figures = own.select("company", (F.lit(1000.0) + F.col("company")).alias("shares"), "net_income", *unknown)
    found = V.implied_per_share(_relative(t), figures).where(F.col("implied_per_share").isNotNull())
    return found.select("company", qc("implied_per_share", digits=3))


_EV_HISTORY = "close * shares_diluted + coalesce(long_term_debt, 0) - coalesce(cash, 0)"
_HISTORY = {
    "pe_ratio": ("close * shares_diluted", "net_income"),
    "ev_to_ebitda": (_EV_HISTORY, "(operating_income + depreciation_amortization)"),
    "price_to_sales": ("close * shares_diluted", "revenue"),
    "price_to_book": ("close * shares_diluted", "total_equity"),
}


@query(
    "multiple_history",
    f"""WITH RECURSIVE {ANNUAL_SQL}, {gross_sql('annual_raw')}, {_WIDE}, {_PRICES},
        ends AS (SELECT *, make_date(CAST(idx AS INTEGER), 12, 31) AS e FROM wide
            QUALIFY row_number() OVER (PARTITION BY company ORDER BY idx DESC) <= 5),
        priced AS (SELECT n.*, (SELECT arg_max(close, trade_date) FROM prices p WHERE p.company = n.company
            AND trade_date BETWEEN e - 7 AND e) AS close FROM ends n),
        long AS ({' UNION ALL '.join(
            f"SELECT company, '{m}' AS metric, CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END AS value "
            "FROM priced WHERE shares_diluted > 0" for m, (a, b) in _HISTORY.items())})
        SELECT company, metric, {q('median(value) FILTER (value > 0)', 3)} AS history_median, count(*) AS history_years
        FROM long WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def multiple_history(t: Tables):
    found = V.multiple_history(S.statements(t.filed_facts(), "annual"), _prices(t))
    return found.select("company", "metric", qc("history_median", digits=3), "history_years")


# --- Ownership ----------------------------------------------------------------------------

_FILINGS = """filings AS (SELECT DISTINCT manager, period, accession, kind, filed FROM v_holdings),
    base AS (SELECT manager, period, coalesce(max(row(filed, accession)) FILTER (kind = 'restatement'),
        max(row(filed, accession)) FILTER (kind = 'original')) AS b FROM filings GROUP BY 1, 2),
    chosen AS (SELECT f.* FROM filings f JOIN base USING (manager, period) WHERE b IS NOT NULL
        AND (accession = b[2] OR (kind = 'new_holdings' AND filed >= b[1]))),
    positions AS (SELECT period, cusip, manager,
        sum(CASE WHEN amount_type = 'SH' THEN amount ELSE 0 END) AS shares,
        sum(value * CASE WHEN filed < DATE '1998-01-01' THEN 1000 ELSE 1 END) AS value
        FROM v_holdings SEMI JOIN chosen USING (manager, period, accession)
        WHERE put_call IS NULL GROUP BY 1, 2, 3),
    clean AS (SELECT p.* FROM positions p LEFT JOIN (SELECT period, cusip,
            list_sort(list(value / shares))[len(list(value / shares)) // 2 + 1] AS med
            FROM positions WHERE shares > 0 GROUP BY 1, 2 HAVING count(*) >= 5) m
            USING (period, cusip)
        WHERE NOT coalesce(shares > 0 AND med > 0 AND (value / shares / med > 5
            OR value / shares / med < 0.2), false))"""


def _filings(t: Tables):
    return t.holdings().select("manager", "period", "accession", "kind", "filed").distinct()


def _positions(t: Tables):
    chosen = O.select_filings(_filings(t)).select("manager", "period", "accession")
    rows = t.holdings().join(chosen, ["manager", "period", "accession"], "left_semi")
    return O.positions(rows, "1998-01-01")


def _wide_period(t: Tables):
    """Positions with yearly periods, so that cusips have enough holders for a median."""
    return _positions(t).groupBy(F.make_date(F.year("period"), F.lit(12), F.lit(31)).alias("period"), "cusip", "manager").agg(
        F.sum("shares").alias("shares"), F.sum("value").alias("value")
    )


@query(
    "own_period",
    f"""WITH {_FILINGS}, n AS (SELECT period, count(*) AS n FROM filings WHERE kind = 'original'
        GROUP BY 1) SELECT arg_max(period, row(n, period)) AS period, max(n) AS filings FROM n""",
)
def own_period(t: Tables):
    return O.modal_period(_filings(t))


@query("own_select", f"WITH {_FILINGS} SELECT manager, period, accession, kind FROM chosen")
def own_select(t: Tables):
    return O.select_filings(_filings(t)).select("manager", "period", "accession", "kind")


@query(
    "own_positions",
    f"""WITH {_FILINGS} SELECT period, cusip, manager, {q('shares', 0)} AS shares,
        {q('value', 1)} AS value FROM positions""",
)
def own_positions(t: Tables):
    return _positions(t).select(
        "period", "cusip", "manager", qc("shares", digits=0), qc("value", digits=1)
    )


_YEARLY = _FILINGS.replace("positions AS (", "quarterly AS (").replace(
    "clean AS (",
    "positions AS (SELECT make_date(year(period), 12, 31) AS period, cusip, manager, "
    "sum(shares) AS shares, sum(value) AS value FROM quarterly GROUP BY 1, 2, 3), clean AS (",
)


@query(
    "own_outliers",
    f"""WITH {_YEARLY} SELECT period, cusip, manager, {q('shares', 0)} AS shares FROM clean""",
)
def own_outliers(t: Tables):
    return O.drop_outliers(_wide_period(t)).select("period", "cusip", "manager", qc("shares", digits=0))


_COMPANY = f"""{_FILINGS}, top AS (SELECT period, cusip FROM positions GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY period ORDER BY sum(value) DESC, cusip) <= 500),
    held AS (SELECT period, cusip % 40 AS company, manager, sum(shares) AS shares,
        sum(value) AS value FROM positions SEMI JOIN top USING (period, cusip) GROUP BY 1, 2, 3)"""


def _company_holdings(t: Tables):
    mapping = t.part.select(F.col("p_partkey").alias("cusip"), (F.col("p_partkey") % 40).alias("company"))
    return O.company_holdings(_positions(t), mapping, 500)


@query(
    "own_top",
    f"""WITH {_COMPANY} SELECT period, company, count(*) AS holders, {q('sum(shares)', 0)} AS shares,
        {q('sum(value)', 0)} AS value FROM held GROUP BY 1, 2""",
)
def own_top(t: Tables):
    return O.company_summary(_company_holdings(t)).select(
        "period", "company", "holders", qc("shares", digits=0), qc("value", digits=0)
    )


@query(
    "own_top_holders",
    f"""WITH {_COMPANY} SELECT period, company, manager, place FROM (SELECT *, row_number() OVER (
        PARTITION BY period, company ORDER BY value DESC, manager) AS place FROM held)
        WHERE place <= 5""",
)
def own_top_holders(t: Tables):
    return O.top_holders(_company_holdings(t), 5).select("period", "company", "manager", "place")


@query(
    "own_map",
    f"""WITH {_FILINGS}, top AS (SELECT DISTINCT cusip FROM (SELECT period, cusip FROM positions GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY period ORDER BY sum(value) DESC, cusip) <= 500)),
        offers AS (SELECT p_partkey AS cusip, lower(substr(p_name, 1, 3)) || CAST(p_partkey % 50 AS
            VARCHAR) AS ticker, CASE WHEN p_size % 2 = 0 THEN 'US' ELSE 'LN' END AS exch FROM part
            WHERE p_partkey % 9 <> 0),
        act AS (SELECT ticker, min(company) AS company FROM v_securities WHERE is_active GROUP BY 1)
        SELECT t.cusip, upper(o.ticker) AS ticker, exch AS exch_code, CASE WHEN o.cusip IS NOT NULL
            THEN 'mapped' ELSE 'no_match' END AS status,
            CASE WHEN exch = 'US' THEN act.company END AS company
        FROM top t LEFT JOIN offers o ON o.cusip = t.cusip LEFT JOIN act ON act.ticker = upper(o.ticker)
        WHERE t.cusip % 4 <> 0""",
)
def own_map(t: Tables):
    wanted = O.top_cusips(_positions(t), 500).select("cusip").distinct()
    known = t.part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("cusip"))
    offers = t.part.where("p_partkey % 9 != 0").select(
        F.col("p_partkey").alias("cusip"),
        F.concat(F.lower(F.substring("p_name", 1, 3)), (F.col("p_partkey") % 50).cast("string")).alias("ticker"),
        F.when(F.col("p_size") % 2 == 0, "US").otherwise("LN").alias("exch_code"), F.lit("f").alias("figi"),
    )
    return O.map_cusips(wanted, known, offers, t.securities())


@query(
    "own_change",
    f"""WITH {_COMPANY}, a AS (SELECT * FROM held WHERE period = DATE '2000-12-31'),
        b AS (SELECT * FROM held WHERE period = DATE '2000-09-30' AND company % 5 <> 0)
        SELECT coalesce(a.company, b.company) AS company, coalesce(a.manager, b.manager) AS manager,
            {q('a.shares', 0)} AS shares, {q('b.shares', 0)} AS previous,
            CASE WHEN a.company NOT IN (SELECT company FROM b) THEN 'unknown' WHEN a.manager IS NULL THEN 'left_top' WHEN b.manager IS NULL THEN 'entered_top'
                WHEN a.shares > b.shares THEN 'increased' WHEN a.shares < b.shares THEN 'decreased'
                ELSE 'unchanged' END AS change
        FROM a FULL OUTER JOIN b ON a.company = b.company AND a.manager = b.manager""",
)
def own_change(t: Tables):
    held = _company_holdings(t)
    at = lambda d: held.where(F.col("period") == F.lit(d).cast("date"))
    return O.holder_changes(at("2000-12-31"), at("2000-09-30").where("company % 5 != 0")).select(
        "company", "manager", qc("shares", digits=0), qc("previous", digits=0), "change"
    )


@query(
    "insider_list",
    f"""SELECT tx_id, company, owner, code, tx_date, {q('shares * price', 2)} AS value FROM v_insider
        WHERE tx_date >= DATE '2024-01-15' ORDER BY tx_date DESC, tx_id DESC LIMIT 200""",
)
def insider_list(t: Tables):
    return O.insider_list(t.insider(), "2024-01-15", 200).select(
        "tx_id", "company", "owner", "code", "tx_date", qc("value", digits=2)
    )


@query(
    "insider_totals",
    f"""SELECT company, code, count(*) AS trades, {q('sum(shares)', 0)} AS shares,
        {q('sum(shares * price)', 1)} AS value, count(DISTINCT owner) AS insiders FROM v_insider
        WHERE code IN ('P', 'S') GROUP BY 1, 2""",
)
def insider_totals(t: Tables):
    return O.insider_totals(t.insider()).select(
        "company", "code", "trades", qc("shares", digits=0), qc("value", digits=1), "insiders"
    )

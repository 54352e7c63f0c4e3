"""Backtest and performance queries: quarterly top-volume portfolios of brands."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import crosssection as X
from tidemark.operators import pit
from tidemark.operators import portfolio as B
from tidemark.operators import prices as P
from tidemark.plans.base import big, q, qc, query
from tidemark.plans.crosssection import SCORES_SQL, scores_of
from tidemark.plans.pit import _AVAILABLE, _available
from tidemark.sources.views import Tables

CAPITAL = 1_000_000.0

WEIGHTS_SQL = """volumes AS (SELECT CAST(last_day(make_date(CAST(year(trade_date) AS INTEGER),
            CAST(quarter(trade_date) AS INTEGER) * 3, 1)) AS DATE) AS as_of, security_id,
            sum(volume) AS v FROM v_raw_bars GROUP BY 1, 2),
    picks AS (SELECT as_of, security_id, row_number() OVER (PARTITION BY as_of
        ORDER BY v DESC, security_id) AS place FROM volumes QUALIFY place <= 10),
    w AS (SELECT as_of, security_id, place, (11 - place) / 60.0::DOUBLE AS weight FROM picks),
    starts AS (SELECT as_of, min(trade_date) AS start FROM (SELECT DISTINCT as_of FROM w)
        JOIN v_bench ON trade_date > as_of GROUP BY 1),
    spans AS (SELECT as_of, start, lead(start) OVER (ORDER BY as_of) AS next_start FROM starts),
    held AS (SELECT w.*, start, next_start FROM w JOIN spans USING (as_of))"""


def _weights(t: Tables):
    quarter = F.last_day(F.add_months(F.trunc("trade_date", "quarter"), 2))
    volumes = t.raw_bars().groupBy(quarter.alias("as_of"), "security_id").agg(F.sum("volume").alias("v"))
    order = Window.partitionBy("as_of").orderBy(F.desc("v"), "security_id")
    picks = volumes.withColumn("place", F.row_number().over(order)).where("place <= 10")
    return picks.select(
        "as_of", "security_id", big("place"), ((11 - F.col("place")) / F.lit(60.0)).alias("weight")
    )


def _calendar(t: Tables):
    return t.raw_bars().select("trade_date").distinct()


def _held(t: Tables):
    return B.holdings(_weights(t), _calendar(t))


@query(
    "bt_holdings",
    f"""WITH {WEIGHTS_SQL} SELECT as_of, security_id, {q('weight')} AS weight, start, next_start
        FROM held""",
)
def bt_holdings(t: Tables):
    return _held(t).select("as_of", "security_id", qc("weight"), "start", "next_start")


@query(
    "bt_stale_exit",
    f"""WITH {WEIGHTS_SQL}, days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS p
            FROM v_bench),
        bars AS (SELECT * FROM v_bars WHERE year(trade_date) <> 1998 OR security_id >= 'Brand#2'),
        l AS (SELECT h.as_of, h.security_id, next_start, max(trade_date) AS last_bar,
            arg_max(close, trade_date) AS close FROM held h JOIN bars b
            ON b.security_id = h.security_id AND b.trade_date <= next_start GROUP BY 1, 2, 3)
        SELECT l.as_of, l.security_id, next_start AS exit_day, last_bar,
            {q('close', 4)} AS exit_price FROM l JOIN days a ON a.trade_date = next_start
        JOIN days b ON b.trade_date = last_bar WHERE a.p - b.p >= 10""",
)
def bt_stale_exit(t: Tables):
    # Some brands stop trading for a year in this view.
    bars = t.bars().where((F.year("trade_date") != 1998) | (F.col("security_id") >= "Brand#2"))
    found = B.stale_exits(_held(t), bars, _calendar(t))
    return found.select("as_of", "security_id", "exit_day", "last_bar", qc("exit_price", digits=4))


_NAV_SQL = f"""{WEIGHTS_SQL},
    bars AS (SELECT security_id, trade_date, idx, idx * open / close AS open_idx FROM v_index),
    bought AS (SELECT h.*, b.open_idx AS base FROM held h JOIN bars b
        ON b.security_id = h.security_id AND b.trade_date = start),
    grid AS (SELECT o.*, c.trade_date AS day FROM bought o JOIN v_bench c
        ON c.trade_date >= start AND (next_start IS NULL OR c.trade_date <= next_start)),
    levels AS (SELECT g.*, b.trade_date AS asof_day, b.idx, b.open_idx FROM grid g ASOF JOIN bars b
        ON g.security_id = b.security_id AND g.day >= b.trade_date),
    per_day AS (SELECT as_of, next_start, day, 1 - sum(weight) + sum(weight * CASE
        WHEN day = next_start AND asof_day = day THEN open_idx ELSE idx END / base) AS value
        FROM levels GROUP BY 1, 2, 3),
    chain AS (SELECT as_of, coalesce(product(e) OVER (ORDER BY as_of ROWS BETWEEN UNBOUNDED
        PRECEDING AND 1 PRECEDING), 1) AS c FROM (SELECT as_of,
        max(value) FILTER (day = next_start) AS e FROM per_day GROUP BY 1)),
    nav AS (SELECT day, as_of, value * c * 1000000 AS nav FROM per_day JOIN chain USING (as_of)
        WHERE next_start IS NULL OR day < next_start)"""


@query("bt_nav", f"WITH {_NAV_SQL} SELECT day, as_of, {q('ln(nav)')} AS log_nav FROM nav")
def bt_nav(t: Tables):
    indexed = P.growth_index(P.returns(t.bars()))
    found = B.nav(_held(t), indexed, _calendar(t), CAPITAL)
    return found.select("day", "as_of", qc(F.ln("nav"), "log_nav"))


_CHANGES = f"""{WEIGHTS_SQL},
    order_dates AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS nx
        FROM (SELECT DISTINCT as_of FROM w)),
    old AS (SELECT nx AS as_of, security_id, weight AS before FROM w JOIN order_dates USING (as_of)
        WHERE nx IS NOT NULL),
    changes AS (SELECT coalesce(w.as_of, old.as_of) AS as_of,
        coalesce(w.security_id, old.security_id) AS security_id,
        coalesce(weight, 0) - coalesce(before, 0) AS change FROM w FULL OUTER JOIN old
        ON w.as_of = old.as_of AND w.security_id = old.security_id)"""


@query(
    "bt_turnover",
    f"""WITH {_CHANGES} SELECT as_of, {q('sum(abs(change)) / 2')} AS turnover,
        row_number() OVER (ORDER BY as_of) = 1 AS is_first FROM changes GROUP BY as_of""",
)
def bt_turnover(t: Tables):
    return B.turnover(_weights(t)).select("as_of", qc("turnover"), "is_first")


@query(
    "bt_order_costs",
    f"""WITH {_CHANGES}, liq AS (SELECT security_id, trade_date, open, n,
            avg(close * volume) OVER w AS adv, stddev_samp(ret) OVER w AS vol FROM v_returns
            WINDOW w AS (PARTITION BY security_id ORDER BY trade_date
                ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
        o AS (SELECT c.as_of, c.security_id, start, abs(change) * 1000000 AS value, open,
            CASE WHEN n > 3 THEN adv END AS adv, CASE WHEN n > 3 THEN vol END AS vol
            FROM changes c JOIN spans USING (as_of) JOIN liq ON liq.security_id = c.security_id
            AND trade_date = start WHERE abs(change) > 0)
        SELECT as_of, security_id, start, {q('value', 2)} AS value,
            {q('greatest(1.0, 0.005 * value / open)', 3)} AS commission,
            {q('coalesce(CASE WHEN adv > 0 AND vol > 0 THEN 0.5 * vol * sqrt(value / adv) * value END, 0)', 0)}
                AS impact_cost,
            coalesce(value > adv * 0.1, false) AS capped FROM o""",
)
def bt_order_costs(t: Tables):
    spans = B.holding_spans(_weights(t), _calendar(t)).select("as_of", "start")
    changes = B.weight_changes(_weights(t)).join(spans, "as_of")
    liquidity = P.trailing_liquidity(P.returns(t.bars()))
    costs = B.order_costs(changes, liquidity, CAPITAL)
    return costs.select(
        "as_of", "security_id", "start", qc("value", digits=2), qc("commission", digits=3),
        qc("impact_cost", digits=0), "capped",
    )


@query(
    "bt_benchmark",
    f"""WITH i AS (SELECT trade_date, product(coalesce(1 + ret, 1)) OVER (ORDER BY trade_date
            ROWS UNBOUNDED PRECEDING) AS idx FROM v_bench_returns)
        SELECT trade_date, {q('idx / first_value(idx) OVER (ORDER BY trade_date) * 1000000', 0)}
            AS level FROM i WHERE trade_date >= DATE '1996-01-01'""",
)
def bt_benchmark(t: Tables):
    bench = P.benchmark_returns(t.bench()).withColumn("key", F.lit(1))
    level = B.benchmark_level(P.growth_index(bench, "key"), F.lit("1996-01-01").cast("date"), CAPITAL)
    return level.select("trade_date", qc("level", digits=0))


@query(
    "bt_equal_weight",
    f"""WITH {WEIGHTS_SQL} SELECT as_of, security_id,
        {q('1 / count(*) OVER (PARTITION BY as_of)')} AS weight FROM volumes""",
)
def bt_equal_weight(t: Tables):
    quarter = F.last_day(F.add_months(F.trunc("trade_date", "quarter"), 2))
    eligible = t.raw_bars().select(quarter.alias("as_of"), "security_id").distinct()
    return B.equal_weights(eligible).select("as_of", "security_id", qc("weight"))


_RATES = """rates AS (SELECT available_on, max(row(observation_date, available_on, realtime_start,
        tie, value)) OVER (ORDER BY available_on RANGE UNBOUNDED PRECEDING) AS b FROM avail
        WHERE series = '1-URGENT'),
    bills AS (SELECT DISTINCT available_on, b[5] / 100000 AS value FROM rates)"""


@query(
    "bt_risk_free",
    f"""WITH {_AVAILABLE}, {_RATES} SELECT trade_date AS as_of,
        {q('power(1 + value / 100, 1 / 252.0) - 1', 9)} AS rf
        FROM v_bench ASOF JOIN bills ON trade_date >= available_on""",
)
def bt_risk_free(t: Tables):
    bills = _available(t).where("series = '1-URGENT'")
    days = _calendar(t).select(F.col("trade_date").alias("as_of"))
    rates = pit.macro_latest(bills, days).withColumn("value", F.col("value") / 100000)
    return B.daily_risk_free(rates).select("as_of", qc("rf", digits=9))


# --- Performance --------------------------------------------------------------------------

CURVE_SQL = """curve AS (SELECT 'high' AS strategy, trade_date AS day, max(close) AS value,
        avg(close) AS bench, 0.0001::DOUBLE AS rf FROM v_raw_bars GROUP BY 2 UNION ALL
    SELECT 'low', trade_date, min(close), avg(close), 0.0001 FROM v_raw_bars GROUP BY 2),
    steps AS (SELECT *, value / lag(value) OVER w - 1 AS r, bench / lag(bench) OVER w - 1 AS rb
        FROM curve WINDOW w AS (PARTITION BY strategy ORDER BY day)),
    rets AS (SELECT *, r - rf AS x, rb - rf AS xb, r - rb AS a FROM steps)"""


def _curve(t: Tables):
    """Two value series: the day's highest and lowest close, against the average."""
    daily = t.raw_bars().groupBy(F.col("trade_date").alias("day")).agg(
        F.max("close").alias("high"), F.min("close").alias("low"), F.avg("close").alias("bench")
    )
    long = daily.unpivot(["day", "bench"], ["high", "low"], "strategy", "value")
    return long.withColumn("rf", F.lit(0.0001))


_DD = """peaks AS (SELECT *, max(value) OVER w AS peak FROM curve
        WINDOW w AS (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING)),
    tops AS (SELECT *, last_value(CASE WHEN value >= peak THEN day END IGNORE NULLS) OVER (
        PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak_day FROM peaks),
    dd AS (SELECT strategy, min(row(value / peak - 1, day, peak_day)) AS b,
        CAST(max(day - peak_day) AS BIGINT) AS longest FROM tops GROUP BY 1)"""


@query(
    "perf_drawdown",
    f"""WITH {CURVE_SQL}, {_DD} SELECT strategy, {q('b[1]')} AS max_drawdown, b[3] AS peak_day,
        b[2] AS trough_day, longest AS longest_drawdown_days FROM dd""",
)
def perf_drawdown(t: Tables):
    return B.drawdown_stats(_curve(t)).select(
        "strategy", qc("max_drawdown"), "peak_day", "trough_day", big("longest_drawdown_days")
    )


_SUMMARY = f"""{CURVE_SQL}, {_DD},
    st AS (SELECT strategy, avg(x) AS mx, stddev_samp(x) AS sx, avg(a) AS ma, stddev_samp(a) AS sa
        FROM rets GROUP BY 1),
    mo AS (SELECT strategy, sum(power((x - mx) / sx, 3)) / count(x) AS skew,
        sum(power((x - mx) / sx, 4)) / count(x) AS kurt,
        sum(power((a - ma) / sa, 3)) / count(a) AS askew,
        sum(power((a - ma) / sa, 4)) / count(a) AS akurt
        FROM rets JOIN st USING (strategy) WHERE x IS NOT NULL GROUP BY 1),
    su AS (SELECT strategy, min(day) AS start, max(day) AS fin, arg_min(value, day) AS v0,
        arg_max(value, day) AS v1, count(x) AS n, avg(x) AS mx, stddev_samp(x) AS sx,
        stddev_samp(r) AS sr, avg(xb) AS mb, covar_samp(x, xb) / var_samp(xb) AS beta,
        avg(a) AS ma, stddev_samp(a) AS sa, sqrt(avg(power(least(x, 0), 2))) AS down
        FROM rets GROUP BY 1),
    summary AS (SELECT *, power(v1 / v0, 1 / ((fin - start) / 365.25)) - 1 AS cagr
        FROM su JOIN mo USING (strategy) JOIN dd USING (strategy))"""


@query(
    "perf_summary",
    f"""WITH {_SUMMARY} SELECT strategy, start, fin AS "end", n, {q('v1 / v0 - 1')} AS total_return,
        {q('cagr')} AS cagr, {q('sr * sqrt(252)', 5)} AS volatility,
        {q('mx / sx * sqrt(252)', 5)} AS sharpe, {q('mx / down * sqrt(252)', 5)} AS sortino,
        {q('cagr / abs(b[1])', 5)} AS calmar, {q('beta', 5)} AS beta,
        {q('(mx - beta * mb) * 252', 5)} AS alpha, {q('sa * sqrt(252)', 5)} AS tracking_error,
        {q('ma / sa * sqrt(252)', 5)} AS information_ratio, {q('skew', 4)} AS skew,
        {q('kurt', 3)} AS kurtosis FROM summary""",
)
def perf_summary(t: Tables):
    digits = {"skew": 4, "kurtosis": 3, "total_return": 6, "cagr": 6}
    names = (
        "total_return cagr volatility sharpe sortino calmar beta alpha tracking_error "
        "information_ratio skew kurtosis"
    ).split()
    return B.summary(_curve(t)).select(
        "strategy", "start", "end", "n", *[qc(c, digits=digits.get(c, 5)) for c in names]
    )


@query("perf_psr")
def perf_psr(t: Tables):
    rows = B.summary(_curve(t))
    return rows.select("strategy", qc(B.probabilistic_sharpe(), "psr"))


@query("perf_dsr")
def perf_dsr(t: Tables):
    rows = B.summary(_curve(t)).withColumn("trials", F.lit(12)).withColumn("variance", F.lit(0.0004))
    limit = B.expected_max_sharpe(F.col("trials"), F.col("variance"))
    rows = rows.withColumn("threshold", limit)
    return rows.select(
        "strategy", qc("threshold"), qc(B.probabilistic_sharpe(F.col("threshold")), "dsr")
    )


@query(
    "perf_trials",
    f"""WITH runs AS (SELECT o_custkey % 50 AS owner, o_totalprice / 1e7 AS s,
            CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 200 AS b FROM orders)
        SELECT owner, count(*) + 1 AS trials, {q('coalesce(var_samp(s), 0)', 9)} AS variance FROM runs
        WHERE a <= DATE '1999-12-31' AND b >= DATE '1999-01-01' GROUP BY 1""",
)
def perf_trials(t: Tables):
    day = F.to_date("o_orderdate")
    runs = t.orders.select(
        (F.col("o_custkey") % 50).alias("owner"),
        (F.col("o_totalprice") / 1e7).alias("active_sharpe_daily"),
        day.alias("start"), F.date_add(day, 200).alias("end"),
    )
    return B.trials(runs, "1999-01-01", "1999-12-31").select("owner", "trials", qc("variance", digits=9))


def _period_sql(fmt: str) -> str:
    return f"""ends AS (SELECT strategy, strftime(day, '{fmt}') AS period,
            arg_max(value, day) AS v, arg_max(bench, day) AS b FROM curve GROUP BY 1, 2),
        firsts AS (SELECT strategy, arg_min(value, day) AS v0, arg_min(bench, day) AS b0 FROM curve
            GROUP BY 1),
        periods AS (SELECT strategy, period, v / coalesce(lag(v) OVER w, v0) - 1 AS ret,
            b / coalesce(lag(b) OVER w, b0) - 1 AS bench_ret FROM ends JOIN firsts USING (strategy)
            WINDOW w AS (PARTITION BY strategy ORDER BY period))"""


@query(
    "perf_periods",
    f"""WITH {CURVE_SQL}, {_period_sql('%Y-%m')} SELECT strategy, period, {q('ret')} AS ret,
        {q('bench_ret')} AS bench_ret FROM periods""",
)
def perf_periods(t: Tables):
    return B.period_returns(_curve(t), "month").select("strategy", "period", qc("ret"), qc("bench_ret"))


@query(
    "hit_rate",
    f"""WITH {CURVE_SQL}, {_period_sql('%Y-%m')} SELECT strategy,
        {q('avg(CASE WHEN ret > bench_ret THEN 1.0 ELSE 0.0 END)')} AS hit_rate FROM periods GROUP BY 1""",
)
def hit_rate(t: Tables):
    return B.hit_rate(B.period_returns(_curve(t), "month")).select("strategy", qc("hit_rate"))


@query(
    "perf_rolling",
    f"""WITH {CURVE_SQL}, n AS (SELECT *, row_number() OVER w - 1 AS i, value / lag(value, 252)
            OVER w - 1 - (bench / lag(bench, 252) OVER w - 1) AS excess FROM curve
            WINDOW w AS (PARTITION BY strategy ORDER BY day))
        SELECT strategy, day, {q('excess')} AS excess FROM n WHERE i >= 252 AND (i - 252) % 5 = 0""",
)
def perf_rolling(t: Tables):
    return B.rolling_excess(_curve(t)).select("strategy", "day", qc("excess"))


@query(
    "perf_by_year",
    f"""SELECT year(o_orderdate) AS year, {q('sum(o_totalprice)', 0)} AS total FROM orders GROUP BY 1""",
)
def perf_by_year(t: Tables):
    return B.by_year(t.orders, "o_orderdate", "o_totalprice").select("year", qc("total", digits=0))


@query(
    "bt_names_holdings",
    f"""WITH {WEIGHTS_SQL} SELECT h.as_of, h.security_id, {q('weight')} AS weight, name FROM held h
        LEFT JOIN (SELECT p_brand AS security_id, min(p_name) AS name FROM part GROUP BY 1) n
        USING (security_id) WHERE h.as_of = (SELECT max(as_of) FROM held)""",
)
def bt_names_holdings(t: Tables):
    names = t.part.groupBy(F.col("p_brand").alias("security_id")).agg(F.min("p_name").alias("name"))
    return B.latest_holdings(_held(t), names).select("as_of", "security_id", qc("weight"), "name")


@query(
    "bt_headline",
    f"""WITH {_SUMMARY} SELECT strategy, start, fin AS "end", {q('cagr')} AS cagr,
        {q('mx / sx * sqrt(252)', 5)} AS sharpe, {q('ma / sa', 6)} AS active_sharpe_daily,
        {q('b[1]')} AS max_drawdown FROM summary""",
)
def bt_headline(t: Tables):
    return B.summary(_curve(t)).select(
        "strategy", "start", "end", qc("cagr"), qc("sharpe", digits=5), qc("active_sharpe_daily"),
        qc("max_drawdown"),
    )


@query(
    "bt_options",
    f"""WITH {SCORES_SQL} SELECT min(as_of) AS first_signal, max(as_of) AS last_signal,
        (SELECT count(*) FROM v_snapshots WHERE as_of = (SELECT max(as_of) FROM v_snapshots))
            AS universe_size FROM scores""",
)
def bt_options(t: Tables):
    return B.run_options(scores_of(t), t.snapshots())

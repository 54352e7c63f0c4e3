"""Regime, yield, crypto and feature-snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import markets as K
from tidemark.operators import pit
from tidemark.operators import prices as P
from tidemark.plans.base import big, q, qc, query
from tidemark.plans.fundamentals import snapshot_sql
from tidemark.plans.pit import _AVAILABLE, _QUARTERS, _UNIVERSE, ROLES, _available, _universe
from tidemark.plans.pit import _FEATURES as _MACRO_SQL
from tidemark.plans.prices import _FEATURES_SQL, _bench, _ema_sql, _indexed
from tidemark.session import cut_lineage
from tidemark.sources.views import Tables

_REGIME = """rg AS (SELECT *, last_day(trade_date) AS as_of, last_day(lead(trade_date) OVER o) AS nx,
        CASE WHEN count(close) OVER w2 = 200 THEN avg(close) OVER w2 END AS sma200,
        CASE WHEN count(ret) OVER w1 = 21 THEN stddev_samp(ret) OVER w1 * sqrt(252) END AS vol FROM v_bench_returns
        WINDOW o AS (ORDER BY trade_date), w2 AS (ORDER BY trade_date ROWS 199 PRECEDING),
        w1 AS (ORDER BY trade_date ROWS 20 PRECEDING)),
    ends AS (SELECT * FROM rg WHERE (nx IS NULL OR nx <> as_of) AND n >= 260),
    regimes AS (SELECT e.as_of, e.close, e.sma200, e.vol, e.trade_date AS price_date,
        count(*) FILTER (h.vol <= e.vol) / count(h.vol) AS pct FROM ends e JOIN rg h
        ON h.n BETWEEN e.n - 2499 AND e.n GROUP BY ALL)"""
_LABEL = """CASE WHEN close >= sma200 THEN 'Uptrend' ELSE 'Downtrend' END || ', '
    || CASE WHEN pct > 0.8 THEN 'stressed' ELSE 'calm' END"""


_FLAG_LEVELS = f"""{_AVAILABLE}, lv AS (SELECT r.as_of, series, max(row(observation_date, available_on, realtime_start, tie, value))[5] AS v
        FROM (SELECT DISTINCT as_of FROM regimes) r JOIN avail ON available_on <= r.as_of WHERE series IN ('2-HIGH', '4-NOT SPECIFIED') GROUP BY 1, 2),
    levels AS (SELECT as_of, max(v) FILTER (series = '2-HIGH') - 150000 AS curve, max(v) FILTER (series = '4-NOT SPECIFIED') - 150000 AS conditions
        FROM lv GROUP BY 1)"""


@query(
    "regime",
    f"""WITH {_REGIME}, {_FLAG_LEVELS} SELECT r.as_of, {_LABEL} AS label, {q('vol', 5)} AS vol, {q('pct')} AS vol_percentile, price_date,
        curve < 0 AS curve_inverted, conditions > 0 AS tight_conditions FROM regimes r LEFT JOIN levels USING (as_of)""",
)
def regime(t: Tables):
    found = K.regime(_bench(t))
    known = pit.macro_latest(_available(t), found.select("as_of")).groupBy("as_of").agg(
        F.max(F.when(F.col("series") == ROLES["curve"], F.col("value") - 150000)).alias("curve"),
        F.max(F.when(F.col("series") == ROLES["conditions"], F.col("value") - 150000)).alias("conditions"),
    )
    shown = K.with_flags(found, known)
    return shown.select("as_of", "label", qc("vol", digits=5), qc("vol_percentile"), "price_date", "curve_inverted", "tight_conditions")


_MONTHS = "CASE tenor WHEN '1 Mo' THEN 1.0 WHEN '3 Mo' THEN 3.0 WHEN '2 Yr' THEN 24.0 WHEN '10 Yr' THEN 120.0 ELSE 360.0 END::DOUBLE"


@query(
    "yield_curve",
    f"""WITH d AS (SELECT max(observed_on) AS d FROM v_yield WHERE observed_on <= DATE '2000-06-30'),
        e AS (SELECT max(observed_on) AS e FROM v_yield, d WHERE observed_on <= d - 365)
        SELECT 'now' AS curve, observed_on, tenor, {_MONTHS} AS months, value FROM v_yield, d WHERE observed_on = d
        UNION ALL SELECT 'year_ago', observed_on, tenor, {_MONTHS}, value FROM v_yield, e WHERE observed_on = e""",
)
def yield_curve(t: Tables):
    return K.curves(t.yields(), F.lit("2000-06-30").cast("date")).select("curve", "observed_on", "tenor", "months", "value")


_STRENGTH = f"""moves AS MATERIALIZED (SELECT security_id, n - 1 AS n, greatest(c - p, 0) AS gain, greatest(p - c, 0) AS loss FROM (SELECT security_id,
            row_number() OVER w AS n, close AS c, lag(close) OVER w AS p FROM v_raw_bars WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)) WHERE n > 1),
        {_ema_sql('moves', 'gain', 14, 1 / 14, 'up')}, {_ema_sql('moves', 'loss', 14, 1 / 14, 'dn')},
        strength AS (SELECT security_id, up.n + 1 AS n, CASE WHEN dn.e = 0 THEN CASE WHEN up.e > 0 THEN 100.0 ELSE 50.0 END
            ELSE 100 - 100 / (1 + up.e / dn.e) END AS rsi FROM up JOIN dn USING (security_id, n))"""
_SPANS = {"7d": 7, "30d": 30, "90d": 90, "1y": 365, "3y": 1095}


@query(
    "crypto_summary",
    f"""WITH RECURSIVE {_STRENGTH}, l AS (SELECT security_id, max(trade_date) AS last, count(*) AS bars FROM v_raw_bars GROUP BY 1),
        r AS (SELECT b.security_id, trade_date, close, last, row_number() OVER (PARTITION BY security_id
                ORDER BY trade_date DESC) AS back, close / lag(close) OVER w - 1 AS r,
            close / max(close) OVER w - 1 AS dd FROM v_raw_bars b JOIN l USING (security_id)
            WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)),
        g AS (SELECT security_id, last AS as_of, arg_max(close, trade_date) AS close,
            {', '.join(f"arg_max(close, trade_date) FILTER (trade_date <= last - {d}) AS b_{n}" for n, d in _SPANS.items())},
            arg_max(close, trade_date) FILTER (year(trade_date) < year(last)) AS b_ytd,
            stddev_samp(r) FILTER (back <= 30) * sqrt(365) AS v30, max(close) AS ath,
            min(dd) FILTER (back <= 365) AS mdd, arg_max(dd, trade_date) AS dd,
            ln(arg_max(close, trade_date) / arg_min(close, trade_date)) / ((last - min(trade_date)) / 365) AS lg
            FROM r GROUP BY 1, 2)
        SELECT g.security_id, as_of, {', '.join(f"{q(f'close / b_{n} - 1')} AS ret_{n}" for n in (*_SPANS, 'ytd'))},
            {q('v30', 5)} AS vol_30d, {q('ath', 3)} AS all_time_high, {q('dd')} AS drawdown,
            {q('mdd')} AS max_drawdown_1y, {q('lg')} AS log_growth_per_year, {q('rsi', 4)} AS rsi_14
        FROM g JOIN l USING (security_id) LEFT JOIN strength s ON s.security_id = g.security_id AND s.n = bars""",
)
def crypto_summary(t: Tables):
    digits = {"vol_30d": 5, "all_time_high": 3, "rsi_14": 4}
    names = [*(f"ret_{n}" for n in (*_SPANS, "ytd")), "vol_30d", "all_time_high", "drawdown", "max_drawdown_1y", "log_growth_per_year", "rsi_14"]
    return K.crypto_summary(t.raw_bars()).select("security_id", "as_of", *[qc(c, digits=digits.get(c, 6)) for c in names])


@query(
    "relationship",
    f"""WITH s AS (SELECT b.security_id, trade_date, b.close / lag(b.close) OVER w - 1 AS r,
            m.close - lag(m.close) OVER w AS x, row_number() OVER (PARTITION BY security_id ORDER BY trade_date DESC) AS back
            FROM v_raw_bars b JOIN v_bench m USING (trade_date) WINDOW w AS (PARTITION BY security_id ORDER BY trade_date))
        SELECT security_id, count(*) AS pairs, {q('corr(r, x)', 5)} AS correlation,
            {q('covar_pop(r, x) / var_pop(x)', 8)} AS beta FROM s WHERE back <= 90 AND r IS NOT NULL GROUP BY 1""",
)
def relationship(t: Tables):
    aligned = A.align(t.raw_bars(), t.bench(), "security_id", level=True)
    return K.relationship(aligned).select("security_id", "pairs", qc("correlation", digits=5), qc("beta", digits=8))


EVENTS = (("1996-03-01", "1998-01-05"), ("1998-01-05", "2000-02-01"), ("2000-02-01", None))


@query(
    "halving_cycles",
    f"""WITH ev(event, nxt) AS (VALUES (DATE '1996-03-01', DATE '1998-01-05'), (DATE '1998-01-05', DATE '2000-02-01'),
            (DATE '2000-02-01', NULL)),
        p AS (SELECT security_id, event, trade_date - event AS d, close FROM v_raw_bars JOIN ev
            ON trade_date >= event AND (nxt IS NULL OR trade_date < nxt)),
        b AS (SELECT security_id, event, arg_min(close, d) AS base FROM p GROUP BY 1, 2 HAVING min(d) <= 7),
        m AS (SELECT p.*, base, close / base AS x FROM p JOIN b USING (security_id, event)),
        k AS (SELECT security_id, event, max(row(x, -d)) AS top FROM m GROUP BY 1, 2)
        SELECT security_id, event, CAST(max(d) AS BIGINT) AS days_observed, {q('CASE WHEN max(d) >= 365 THEN arg_max(x, d) FILTER (d <= 365) - 1 END')}
            AS return_1y, {q('any_value(top[1])')} AS peak_multiple, CAST(-any_value(top[2]) AS BIGINT) AS days_to_peak,
            {q('min(x) FILTER (d >= -top[2]) / any_value(top[1]) - 1')} AS drawdown_after_peak
        FROM m JOIN k USING (security_id, event) GROUP BY 1, 2""",
)
def halving_cycles(t: Tables):
    table = t.spark.createDataFrame(EVENTS, "event string, next_event string")
    events = table.select(F.to_date("event").alias("event"), F.to_date("next_event").alias("next_event"))
    return K.cycles(t.raw_bars(), events).select(
        "security_id", "event", big("days_observed"), qc("return_1y"), qc("peak_multiple"), big("days_to_peak"),
        qc("drawdown_after_peak"),
    )


@query(
    "crypto_view",
    f"""WITH RECURSIVE {_STRENGTH}, shown AS (SELECT security_id, trade_date, row_number() OVER u AS n, {q('close', 3)} AS close,
            {q('close / max(close) OVER u - 1')} AS drawdown,
            CASE WHEN count(*) OVER a = 50 THEN {q('avg(close) OVER a', 3)} END AS sma_50,
            CASE WHEN count(*) OVER b = 200 THEN {q('avg(close) OVER b', 3)} END AS sma_200 FROM v_raw_bars
            WINDOW u AS (PARTITION BY security_id ORDER BY trade_date), a AS (PARTITION BY security_id ORDER BY trade_date ROWS 49 PRECEDING),
            b AS (PARTITION BY security_id ORDER BY trade_date ROWS 199 PRECEDING))
        SELECT security_id, trade_date, close, drawdown, sma_50, sma_200, {q('rsi', 3)} AS rsi FROM shown LEFT JOIN strength USING (security_id, n)""",
)
def crypto_view(t: Tables):
    return K.crypto_view(t.raw_bars()).select(
        "security_id", "trade_date", qc("close", digits=3), qc("drawdown"), qc("sma_50", digits=3), qc("sma_200", digits=3), qc("rsi", digits=3)
    )


@query(
    "markets_overview",
    f"""WITH {_AVAILABLE}, k AS (SELECT series, max(row(observation_date, available_on, realtime_start, tie, value)) AS b
            FROM avail WHERE available_on <= DATE '2000-06-30' GROUP BY 1),
        c AS (SELECT tenor, value FROM v_yield WHERE observed_on = (SELECT max(observed_on) FROM v_yield)),
        p AS (SELECT security_id, arg_max(idx, n) / arg_max(idx, n) FILTER (n < mx) - 1 AS r FROM (SELECT *,
            max(n) OVER (PARTITION BY security_id) AS mx FROM v_index) GROUP BY 1)
        SELECT 'macro' AS part, series AS name, {q('b[5]', 4)} AS value FROM k UNION ALL
        SELECT 'curve', tenor, {q('value', 4)} FROM c UNION ALL SELECT 'fund', security_id, {q('r', 4)} FROM p""",
)
def markets_overview(t: Tables):
    known = pit.macro_known(_available(t), "2000-06-30").groupBy("series").agg(F.max_by("value", "observation_date").alias("value"))
    parts = (
        known.select(F.lit("macro").alias("part"), F.col("series").alias("name"), "value"),
        K.yield_curve(t.yields()).select(F.lit("curve").alias("part"), F.col("tenor").alias("name"), "value"),
        P.return_panel(_indexed(t)).select(F.lit("fund").alias("part"), F.col("security_id").alias("name"), F.col("ret_1d").alias("value")),
    )
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("part", "name", qc("value", digits=4))


#: Features are taken at quarter ends; companies are the listed brands.
_DAYS_SQL = "days AS (SELECT as_of FROM v_pit_days)"
_PRICE_DIGITS = {"vol_1m": 5, "vol_3m": 5, "beta_1y": 4, "rsi_14": 4}
_PIVOT = ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in (*K.FUNDAMENTALS, *K.INVERSE.values(), *K.YIELDS, "market_cap"))
_METRIC_NAMES = ", ".join(f"'{m}'" for m in (*K.FUNDAMENTALS, *K.INVERSE.values(), *K.YIELDS, "market_cap"))
_LEVELS = ("macro_10y", "macro_curve_10y3m", "macro_unemployment", "macro_nfci")


def _features_sql() -> str:
    metrics = snapshot_sql("value").replace("v_filed_facts", "v_pit_facts").replace("v_raw_bars", "v_pit_bars")
    macro = _MACRO_SQL.replace(_QUARTERS, _DAYS_SQL)
    price = ", ".join(f"p.{c}" for c in ("mom_1m", "mom_3m", "mom_6m", "mom_12_1", "vol_1m", "vol_3m", "beta_1y", "max_drawdown_1y", "dist_sma200", "rsi_14"))
    own = ", ".join(f"{q(f'f.{c}', 3)} AS {c}" for c in (*K.FUNDAMENTALS, *K.YIELDS))
    over = ", ".join(f"CASE WHEN f.{m} <> 0 THEN {q(f'1 / f.{m}')} END AS {n}" for n, m in K.INVERSE.items())
    return f"""SELECT p.as_of, p.company, {price}, {own}, {over}, CASE WHEN f.market_cap > 0 THEN {q('ln(f.market_cap)', 4)} END AS log_market_cap,
        {', '.join(f'm.{c}' for c in _LEVELS)}, m.macro_cpi_yoy, m.macro_unemployment_change_3m, m.macro_10y_change_3m,
        {q('g.close / g.sma200 - 1')} AS market_trend, {q('g.vol', 5)} AS market_vol_1m,
        greatest(p.trade_date, f.used, m.used_on, g.price_date) AS data_available_on
        FROM (SELECT *, CAST(substr(security_id, 7) AS BIGINT) AS company FROM ({_FEATURES_SQL.replace('SELECT ends.security_id, as_of,', 'SELECT ends.security_id, as_of, ends.trade_date,')})) p JOIN v_pit_days USING (as_of)
        LEFT JOIN (SELECT company // 100000 AS company, DATE '1970-01-01' + CAST(company % 100000 AS INTEGER) AS as_of, {_PIVOT},
            max(available) FILTER (metric IN ({_METRIC_NAMES})) AS used FROM ({metrics}) GROUP BY 1, 2) f ON f.company = p.company AND f.as_of = p.as_of
        LEFT JOIN ({macro}) m ON m.as_of = p.as_of LEFT JOIN (WITH {_REGIME} SELECT * FROM regimes) g ON g.as_of = p.as_of"""


def _features(t: Tables):
    """All 40 inputs of the listed brands at quarter ends."""
    bars = t.raw_bars().select("security_id", "trade_date", "close", F.last_day("trade_date").alias("as_of")).where(F.month("as_of") % 3 == 0)
    days = cut_lineage(bars.select("as_of").distinct())
    number = F.substring_index("security_id", "#", -1).cast("bigint").alias("company")
    price = P.price_features(_indexed(t), _bench(t)).where(F.month("as_of") % 3 == 0)
    price = price.select("as_of", number, *[c for c in price.columns if c not in ("as_of", "security_id", "trade_date")], F.col("trade_date").alias("price_used"))
    closes = bars.groupBy(number, "as_of").agg(F.max_by("close", "trade_date").alias("close"), F.max("trade_date").alias("trade_date"))
    listed = t.raw_bars().select(number).distinct()
    facts = t.filed_facts().join(listed, "company", "left_semi")
    fundamental = K.fundamental_inputs(K.metrics_asof(facts, closes, days))
    macro = pit.macro_features(_available(t), days, ROLES).withColumnRenamed("used_on", "macro_used")
    trend = (F.col("close") / F.col("sma200") - 1).alias("market_trend")
    market = K.regime(_bench(t)).select("as_of", trend, F.col("vol").alias("market_vol_1m"), F.col("price_date").alias("market_used"))
    return K.feature_snapshots(price, fundamental, macro, market)


@query("features", _features_sql())
def features(t: Tables):
    digits = _PRICE_DIGITS | {c: 3 for c in (*K.FUNDAMENTALS, *K.YIELDS)} | {"log_market_cap": 4, "market_vol_1m": 5}
    digits |= {"macro_unemployment_change_3m": 2, "macro_10y_change_3m": 2}
    plain = {"as_of", "company", "data_available_on", *_LEVELS}
    found = _features(t)
    return found.select(*[c if c in plain else qc(c, digits=digits.get(c, 6)) for c in found.columns])


@query(
    "feature_snapshots",
    f"""WITH {_UNIVERSE} SELECT as_of, company FROM universe WHERE has_prices AND (company % 4 <> 0 OR year(as_of) >= 2000)""",
)
def feature_snapshots(t: Tables):
    members = _universe(t)
    stored = members.where((F.col("company") % 4 == 0) & (F.year("as_of") < 2000)).select("as_of", "company")
    return K.missing_snapshots(members, stored).select("as_of", "company")

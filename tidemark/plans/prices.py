"""Price and time-series queries over the bars views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import prices as P
from tidemark.plans.base import big, q, qc, query
from tidemark.sources.views import Tables


def _returns(t: Tables):
    return P.returns(t.bars())


def _indexed(t: Tables):
    return P.growth_index(_returns(t))


def _bench(t: Tables):
    return P.benchmark_returns(t.bench())


@query("total_return", f"SELECT security_id, trade_date, {q('ret')} AS ret FROM v_returns")
def total_return(t: Tables):
    return _returns(t).select("security_id", "trade_date", qc("ret"))


@query(
    "return_series",
    f"""SELECT security_id, count(*) AS bars, min(trade_date) AS first_day,
        max(trade_date) AS last_day, {q('avg(ret)')} AS mean_ret FROM v_returns GROUP BY 1""",
)
def return_series(t: Tables):
    return (
        _returns(t)
        .groupBy("security_id")
        .agg(
            F.count(F.lit(1)).alias("bars"),
            F.min("trade_date").alias("first_day"),
            F.max("trade_date").alias("last_day"),
            qc(F.avg("ret"), "mean_ret"),
        )
    )


@query("growth_index", f"SELECT security_id, trade_date, {q('idx')} AS idx FROM v_index")
def growth_index(t: Tables):
    return _indexed(t).select("security_id", "trade_date", qc("idx"))


@query(
    "sma",
    f"""SELECT security_id, trade_date, CASE WHEN count(close) OVER w = 20
        THEN {q('avg(close) OVER w', 4)} END AS sma FROM v_bars
        WINDOW w AS (PARTITION BY security_id ORDER BY trade_date ROWS 19 PRECEDING)""",
)
def sma(t: Tables):
    return P.sma(t.bars(), 20).select("security_id", "trade_date", qc("sma", digits=4))


def _ema_sql(source: str, value: str, size: int, alpha: float, name: str) -> str:
    """Recursive SQL for an exponential average seeded by the first `size` values' mean."""
    return f"""{name}_s AS MATERIALIZED (
        SELECT security_id, n, {value} AS v, avg({value}) OVER (PARTITION BY security_id
            ORDER BY n ROWS {size - 1} PRECEDING) AS seed FROM {source}),
        {name} AS (
        SELECT security_id, n, seed AS e FROM {name}_s WHERE n = {size}
        UNION ALL
        SELECT s.security_id, s.n, p.e + (s.v - p.e) * {alpha!r} FROM {name} p JOIN {name}_s s
            ON s.security_id = p.security_id AND s.n = p.n + 1)"""


@query(
    "ema",
    f"""WITH RECURSIVE {_ema_sql('v_returns', 'close', 12, 2 / 13, 'e12')}
    SELECT r.security_id, r.trade_date, {q('e', 4)} AS ema FROM v_returns r
    LEFT JOIN e12 USING (security_id, n)""",
)
def ema(t: Tables):
    return P.ema(t.bars(), 12).select("security_id", "trade_date", qc("ema", digits=4))


_RSI = f"""WITH RECURSIVE
    moves AS MATERIALIZED (SELECT security_id, n - 1 AS n, greatest(close - prev_close, 0) AS gain,
        greatest(prev_close - close, 0) AS loss FROM v_returns WHERE n > 1),
    {_ema_sql('moves', 'gain', 14, 1 / 14, 'g')}, {_ema_sql('moves', 'loss', 14, 1 / 14, 'l')}"""


@query(
    "rsi",
    f"""{_RSI} SELECT r.security_id, r.trade_date, {q('''CASE
        WHEN l.e IS NULL THEN NULL WHEN l.e = 0 THEN CASE WHEN g.e > 0 THEN 100.0 ELSE 50.0 END
        ELSE 100 - 100 / (1 + g.e / l.e) END''', 4)} AS rsi
    FROM v_returns r LEFT JOIN g ON g.security_id = r.security_id AND g.n = r.n - 1
    LEFT JOIN l ON l.security_id = r.security_id AND l.n = r.n - 1""",
)
def rsi(t: Tables):
    return P.rsi(t.bars()).select("security_id", "trade_date", qc("rsi", digits=4))


_MACD = f"""WITH RECURSIVE {_ema_sql('v_returns', 'close', 12, 2 / 13, 'e12')},
    {_ema_sql('v_returns', 'close', 26, 2 / 27, 'e26')},
    line AS MATERIALIZED (SELECT security_id, e26.n - 25 AS n, e12.e - e26.e AS v
        FROM e12 JOIN e26 USING (security_id, n)),
    {_ema_sql('line', 'v', 9, 2 / 10, 'sig')}"""


@query(
    "macd",
    f"""{_MACD} SELECT r.security_id, r.trade_date, {q('line.v', 4)} AS macd,
    {q('sig.e', 4)} AS signal, {q('line.v - sig.e', 4)} AS histogram FROM v_returns r
    LEFT JOIN line ON line.security_id = r.security_id AND line.n = r.n - 25
    LEFT JOIN sig ON sig.security_id = r.security_id AND sig.n = r.n - 25""",
)
def macd(t: Tables):
    return P.macd(t.bars()).select(
        "security_id", "trade_date",
        *[qc(c, digits=4) for c in ("macd", "signal", "histogram")],
    )


@query("stdev", f"SELECT security_id, {q('stddev_samp(ret)')} AS stdev FROM v_returns GROUP BY 1")
def stdev(t: Tables):
    return P.volatility(_returns(t)).select("security_id", qc("stdev"))


@query(
    "ann_vol",
    f"""SELECT security_id, {q('stddev_samp(ret) * sqrt(252)')} AS ann_vol,
        {q('stddev_samp(ret) * sqrt(365)')} AS crypto_vol FROM v_returns GROUP BY 1""",
)
def ann_vol(t: Tables):
    stocks = P.volatility(_returns(t))
    crypto = F.col("stdev") * (P.CRYPTO_DAYS**0.5)
    return stocks.select("security_id", qc("ann_vol"), qc(crypto, "crypto_vol"))


@query(
    "rolling_vol",
    f"""SELECT security_id, trade_date, CASE WHEN count(ret) OVER w = 21
        THEN {q('stddev_samp(ret) OVER w * sqrt(252)')} END AS rolling_vol FROM v_returns
        WINDOW w AS (PARTITION BY security_id ORDER BY trade_date ROWS 20 PRECEDING)""",
)
def rolling_vol(t: Tables):
    return P.rolling_volatility(_returns(t), 21).select(
        "security_id", "trade_date", qc("rolling_vol")
    )


_DRAWDOWN = """dd AS (SELECT *, idx / max(idx) OVER (PARTITION BY security_id ORDER BY trade_date
    ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM v_index)"""


@query(
    "drawdown",
    f"WITH {_DRAWDOWN} SELECT security_id, trade_date, {q('drawdown')} AS drawdown FROM dd",
)
def drawdown(t: Tables):
    return P.drawdown(_indexed(t)).select("security_id", "trade_date", qc("drawdown"))


@query(
    "max_drawdown",
    f"WITH {_DRAWDOWN} SELECT security_id, {q('min(drawdown)')} AS max_drawdown FROM dd GROUP BY 1",
)
def max_drawdown(t: Tables):
    return P.max_drawdown(_indexed(t)).select("security_id", qc("max_drawdown"))


@query(
    "period_return",
    f"""SELECT security_id, trade_date, {q('idx / lag(idx, 21) OVER w - 1')} AS period_return
        FROM v_index WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)""",
)
def period_return(t: Tables):
    return P.period_return(_indexed(t), 21).select(
        "security_id", "trade_date", qc("period_return")
    )


_PANEL = [*P.PANEL]


@query(
    "period_returns_panel",
    f"""WITH last AS (SELECT security_id, max(n) AS total, max(year(trade_date)) AS yr,
            max(trade_date) AS as_of, arg_max(idx, n) AS now FROM v_index GROUP BY 1),
        j AS (SELECT * FROM v_index JOIN last USING (security_id)),
        b AS (SELECT security_id, max(as_of) AS as_of, max(now) AS now,
            {', '.join(f"max(idx) FILTER (n = total - {k}) AS b_{n}" for n, k in _PANEL)},
            arg_max(idx, trade_date) FILTER (year(trade_date) < yr) AS b_ytd
            FROM j GROUP BY 1)
        SELECT security_id, as_of,
            {', '.join(f"{q(f'now / b_{n} - 1')} AS ret_{n}" for n in [x for x, _ in _PANEL] + ['ytd'])}
        FROM b""",
)
def period_returns_panel(t: Tables):
    panel = P.return_panel(_indexed(t))
    return panel.select(
        "security_id", "as_of", *[qc(c) for c in panel.columns if c.startswith("ret_")]
    )


_PAIRED = """pairs AS (SELECT r.security_id, r.trade_date, r.ret, b.ret AS bench_ret
    FROM v_returns r JOIN v_bench_returns b USING (trade_date)
    WHERE r.ret IS NOT NULL AND b.ret IS NOT NULL)"""


@query(
    "correlation",
    f"""WITH {_PAIRED} SELECT security_id, count(*) AS pairs,
        {q('corr(ret, bench_ret)', 5)} AS correlation FROM pairs GROUP BY 1""",
)
def correlation(t: Tables):
    found = P.correlation_beta(P.with_benchmark(_returns(t), _bench(t)))
    return found.select("security_id", "pairs", qc("correlation", digits=5))


@query(
    "beta",
    f"""WITH {_PAIRED} SELECT security_id,
        {q('covar_pop(ret, bench_ret) / var_pop(bench_ret)', 5)} AS beta FROM pairs GROUP BY 1""",
)
def beta(t: Tables):
    found = P.correlation_beta(P.with_benchmark(_returns(t), _bench(t)))
    return found.select("security_id", qc("beta", digits=5))


@query(
    "rolling_corr_beta",
    f"""WITH {_PAIRED} SELECT security_id, trade_date,
        CASE WHEN count(ret) OVER w = 60 THEN {q('corr(ret, bench_ret) OVER w', 4)} END
            AS rolling_corr,
        CASE WHEN count(ret) OVER w = 60 THEN {q('regr_slope(ret, bench_ret) OVER w', 4)} END
            AS rolling_beta FROM pairs
        WINDOW w AS (PARTITION BY security_id ORDER BY trade_date ROWS 59 PRECEDING)""",
)
def rolling_corr_beta(t: Tables):
    rolled = P.rolling_relation(P.with_benchmark(_returns(t), _bench(t)), 60)
    return rolled.select(
        "security_id", "trade_date", qc("rolling_corr", digits=4), qc("rolling_beta", digits=4)
    )


@query(
    "spark_thin",
    f"""WITH r AS (SELECT security_id, trade_date, n, max(n) OVER (PARTITION BY security_id) AS last
        FROM v_returns) SELECT security_id, trade_date FROM r WHERE (n - 1) % 50 = 0 OR n = last""",
)
def spark_thin(t: Tables):
    return P.thin(t.bars(), 50).select("security_id", "trade_date")


@query(
    "weekly_beta",
    f"""WITH shared AS (SELECT b.security_id, b.trade_date, b.close, m.close AS market,
            row_number() OVER (PARTITION BY security_id ORDER BY b.trade_date DESC) AS back
            FROM v_bars b JOIN v_bench m USING (trade_date)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY trade_date) AS rk
            FROM shared WHERE back <= 505),
        pairs AS (SELECT security_id, trade_date, lag(trade_date) OVER w AS prev,
            ln(close / lag(close) OVER w) AS s, ln(market / lag(market) OVER w) AS m
            FROM ranked WHERE (rk - 1) % 5 = 0
            WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)),
        fit AS (SELECT security_id, count(*) AS weeks, min(prev) AS first_day,
            max(trade_date) AS last_day, covar_samp(s, m) / var_samp(m) AS raw
            FROM pairs WHERE s IS NOT NULL GROUP BY 1 HAVING count(*) >= 52)
        SELECT security_id, weeks, first_day, last_day, {q('raw', 4)} AS raw,
            {q('0.67 * raw + 0.33', 4)} AS adjusted FROM fit""",
)
def weekly_beta(t: Tables):
    return P.weekly_beta(t.bars(), t.bench()).select(
        "security_id", "weeks", "first_day", "last_day",
        qc("raw", digits=4), qc("adjusted", digits=4),
    )


_SPREAD = """ranges AS (SELECT *, lag(high) OVER w AS h1, lag(low) OVER w AS l1,
        CASE WHEN low > prev_close THEN prev_close - low
             WHEN high < prev_close THEN prev_close - high ELSE 0.0 END AS gap
        FROM v_returns WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)),
    logs AS (SELECT *, power(ln(h1 / l1), 2) + power(ln((high + gap) / (low + gap)), 2) AS bt,
        power(ln(greatest(h1, high + gap) / least(l1, low + gap)), 2) AS gm
        FROM ranges WHERE split_factor = 1 AND prev_close IS NOT NULL),
    alphas AS (SELECT *, (sqrt(2 * bt) - sqrt(bt)) / (3 - 2 * sqrt(2))
        - sqrt(gm / (3 - 2 * sqrt(2))) AS al FROM logs),
    spreads AS (SELECT r.*, s.spread FROM v_returns r LEFT JOIN (SELECT security_id, trade_date,
        greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) AS spread FROM alphas) s
        USING (security_id, trade_date))"""


@query(
    "corwin_schultz",
    f"WITH {_SPREAD} SELECT security_id, {q('avg(spread)')} AS spread FROM spreads GROUP BY 1",
)
def corwin_schultz(t: Tables):
    return P.average_spread(_returns(t)).select("security_id", qc("spread"))


@query(
    "trailing_liquidity",
    f"""WITH {_SPREAD} SELECT security_id, trade_date,
        CASE WHEN n > 3 THEN {q('avg(close * volume) OVER w', 0)} END AS adv,
        CASE WHEN n > 3 THEN {q('stddev_samp(ret) OVER w')} END AS daily_vol,
        CASE WHEN n > 3 THEN {q('avg(spread) OVER w')} END AS avg_spread
        FROM spreads WINDOW w AS (PARTITION BY security_id ORDER BY trade_date
            ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)""",
)
def trailing_liquidity(t: Tables):
    return P.trailing_liquidity(_returns(t)).select(
        "security_id", "trade_date", qc("adv", digits=0), qc("daily_vol"), qc("avg_spread")
    )


_FEATURES_SQL = f"""WITH base AS (
        SELECT i.*, b.ret AS bench_ret, last_day(i.trade_date) AS as_of,
            last_day(lead(i.trade_date) OVER w) AS next_month,
            lag(idx, 21) OVER w AS i21, lag(idx, 63) OVER w AS i63, lag(idx, 126) OVER w AS i126,
            lag(idx, 252) OVER w AS i252, i.close - prev_close AS chg
        FROM v_index i LEFT JOIN v_bench_returns b USING (trade_date)
        WINDOW w AS (PARTITION BY security_id ORDER BY i.trade_date)),
    stats AS (
        SELECT *, CASE WHEN count(ret) OVER w21 = 21 THEN stddev_samp(ret) OVER w21 END AS sd21,
            CASE WHEN count(ret) OVER w63 = 63 THEN stddev_samp(ret) OVER w63 END AS sd63,
            CASE WHEN count(close) OVER w200 = 200 THEN avg(close) OVER w200 END AS sma200,
            count(CASE WHEN bench_ret IS NOT NULL THEN ret END) OVER w252 AS pairs,
            regr_slope(ret, bench_ret) OVER w252 AS slope
        FROM base
        WINDOW w21 AS (PARTITION BY security_id ORDER BY trade_date ROWS 20 PRECEDING),
               w63 AS (PARTITION BY security_id ORDER BY trade_date ROWS 62 PRECEDING),
               w200 AS (PARTITION BY security_id ORDER BY trade_date ROWS 199 PRECEDING),
               w252 AS (PARTITION BY security_id ORDER BY trade_date ROWS 251 PRECEDING)),
    ends AS (SELECT * FROM stats WHERE (next_month IS NULL OR next_month <> as_of)
        AND as_of - trade_date <= 7 AND n >= 253),
    near AS (SELECT e.security_id, e.n AS en, i.n, i.idx, i.close - i.prev_close AS chg,
            i.n - (e.n - 58) AS pos FROM ends e JOIN v_index i
            ON i.security_id = e.security_id AND i.n BETWEEN e.n - 252 AND e.n),
    peaks AS (SELECT security_id, en, idx / max(idx) OVER (PARTITION BY security_id, en ORDER BY n
            ROWS UNBOUNDED PRECEDING) - 1 AS dd, pos, chg FROM near),
    agg AS (SELECT security_id, en, min(dd) AS mdd,
            sum(CASE WHEN pos >= 0 THEN greatest(chg, 0) * CASE WHEN pos < 14
                THEN power(13.0 / 14, 45) / 14 ELSE power(13.0 / 14, 58 - pos) / 14 END END) AS g,
            sum(CASE WHEN pos >= 0 THEN greatest(-chg, 0) * CASE WHEN pos < 14
                THEN power(13.0 / 14, 45) / 14 ELSE power(13.0 / 14, 58 - pos) / 14 END END) AS l
            FROM peaks GROUP BY 1, 2)
    SELECT ends.security_id, as_of, {q('idx / i21 - 1')} AS mom_1m, {q('idx / i63 - 1')} AS mom_3m,
        {q('idx / i126 - 1')} AS mom_6m, {q('i21 / i252 - 1')} AS mom_12_1,
        {q('sd21 * sqrt(252)', 5)} AS vol_1m, {q('sd63 * sqrt(252)', 5)} AS vol_3m,
        CASE WHEN pairs >= 200 THEN {q('slope', 4)} END AS beta_1y,
        {q('mdd')} AS max_drawdown_1y, {q('close / sma200 - 1')} AS dist_sma200,
        {q('CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + g / l) END', 4)}
            AS rsi_14
    FROM ends JOIN agg ON agg.security_id = ends.security_id AND agg.en = ends.n"""


@query("price_features", _FEATURES_SQL)
def price_features(t: Tables):
    digits = {"vol_1m": 5, "vol_3m": 5, "beta_1y": 4, "rsi_14": 4}
    found = P.price_features(_indexed(t), _bench(t))
    names = [c for c in found.columns if c not in ("security_id", "as_of", "trade_date")]
    return found.select("security_id", "as_of", *[qc(c, digits=digits.get(c, 6)) for c in names])


@query(
    "technicals_view",
    f"""WITH RECURSIVE last AS MATERIALIZED (SELECT security_id, max(trade_date) AS d,
            arg_max(close, n) AS c, arg_max(idx, n) AS x, count(*) AS bars FROM v_index GROUP BY 1),
        adj AS MATERIALIZED (SELECT i.*, idx * c / x AS adjusted, d FROM v_index i
            JOIN last USING (security_id) WHERE bars >= 60),
        moves AS MATERIALIZED (SELECT security_id, n - 1 AS n,
            greatest(adjusted - lag(adjusted) OVER w, 0) AS gain,
            greatest(lag(adjusted) OVER w - adjusted, 0) AS loss FROM adj
            WINDOW w AS (PARTITION BY security_id ORDER BY n) QUALIFY n > 0),
        {_ema_sql('moves', 'gain', 14, 1 / 14, 'g')}, {_ema_sql('moves', 'loss', 14, 1 / 14, 'l')},
        {_ema_sql('adj', 'adjusted', 12, 2 / 13, 'e12')},
        {_ema_sql('adj', 'adjusted', 26, 2 / 27, 'e26')},
        line AS MATERIALIZED (SELECT security_id, e26.n - 25 AS n, e12.e - e26.e AS v
            FROM e12 JOIN e26 USING (security_id, n)),
        {_ema_sql('line', 'v', 9, 2 / 10, 'sig')},
        bidx AS (SELECT trade_date, product(coalesce(1 + ret, 1)) OVER (ORDER BY trade_date
            ROWS UNBOUNDED PRECEDING) AS bench_idx FROM v_bench_returns),
        charts AS (SELECT a.*,
            CASE WHEN count(*) OVER w50 = 50 THEN avg(adjusted) OVER w50 END AS sma_50,
            CASE WHEN count(*) OVER w200 = 200 THEN avg(adjusted) OVER w200 END AS sma_200,
            adjusted / max(adjusted) OVER wu - 1 AS drawdown
            FROM adj a WINDOW w50 AS (PARTITION BY security_id ORDER BY n ROWS 49 PRECEDING),
            w200 AS (PARTITION BY security_id ORDER BY n ROWS 199 PRECEDING),
            wu AS (PARTITION BY security_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
        shown AS (SELECT c.*, bench_idx, first_value(idx / bench_idx IGNORE NULLS) OVER
            (PARTITION BY security_id ORDER BY c.n
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base
            FROM charts c LEFT JOIN bidx USING (trade_date) WHERE trade_date >= d - 1095)
        SELECT s.security_id, s.trade_date, {q('adjusted', 2)} AS adjusted,
            {q('sma_50', 2)} AS sma_50, {q('sma_200', 2)} AS sma_200,
            {q('CASE WHEN l.e IS NULL THEN NULL WHEN l.e = 0 THEN CASE WHEN g.e > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + g.e / l.e) END', 2)} AS rsi,
            {q('line.v', 2)} AS macd, {q('sig.e', 2)} AS signal, {q('drawdown')} AS drawdown,
            {q('idx / bench_idx / base', 5)} AS relative
        FROM shown s LEFT JOIN g ON g.security_id = s.security_id AND g.n = s.n - 1
        LEFT JOIN l ON l.security_id = s.security_id AND l.n = s.n - 1
        LEFT JOIN line ON line.security_id = s.security_id AND line.n = s.n - 25
        LEFT JOIN sig ON sig.security_id = s.security_id AND sig.n = s.n - 25""",
)
def technicals_view(t: Tables):
    bench = P.growth_index(_bench(t).withColumn("key", F.lit(1)), "key")
    digits = {"drawdown": 6, "relative": 5}
    shown = P.technicals_view(_indexed(t), bench)
    return shown.select(
        "security_id", "trade_date", *[qc(c, digits=digits.get(c, 2)) for c in shown.columns[2:]]
    )


@query(
    "technicals_stats",
    f"""WITH last AS (SELECT security_id, arg_max(close, n) / arg_max(idx, n) AS scale, max(n) AS bars FROM v_index GROUP BY 1),
        r AS (SELECT i.security_id, i.trade_date, i.ret, b.ret AS bench, idx * scale AS adjusted, bars - i.n AS back
            FROM v_index i JOIN last USING (security_id) LEFT JOIN v_bench_returns b USING (trade_date))
        SELECT security_id, max(trade_date) AS as_of, {q('stddev_samp(ret) FILTER (back < 21) * sqrt(252)', 5)} AS vol_1m,
            {q('stddev_samp(ret) FILTER (back < 252) * sqrt(252)', 5)} AS vol_1y,
            CASE WHEN count(*) FILTER (back < 252 AND ret IS NOT NULL AND bench IS NOT NULL) > 100
                THEN {q('covar_pop(ret, bench) FILTER (back < 252) / var_pop(bench) FILTER (back < 252 AND ret IS NOT NULL)', 4)} END AS beta_1y,
            {q('max(adjusted) FILTER (back < 252)', 2)} AS high_52w, {q('min(adjusted) FILTER (back < 252)', 2)} AS low_52w,
            {q('max(adjusted) FILTER (back = 0) / avg(adjusted) FILTER (back < 50) - 1')} AS dist_sma_50, count(*) AS bars
        FROM r GROUP BY 1""",
)
def technicals_stats(t: Tables):
    found = P.technicals_stats(_indexed(t), _bench(t))
    return found.select(
        "security_id", "as_of", qc("vol_1m", digits=5), qc("vol_1y", digits=5), qc("beta_1y", digits=4), qc("high_52w", digits=2),
        qc("low_52w", digits=2), qc("dist_sma_50"), "bars",
    )

"""Cross-section, factor and selection queries over monthly supplier snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.lookups import FACTORS
from tidemark.operators import crosssection as X
from tidemark.plans.base import big, q, qc, query
from tidemark.sources.views import Tables

NAMES = [n for inputs in FACTORS.values() for n in inputs]
WEIGHTS = {"value": 1.0, "quality": 1.0, "momentum": 0.5}

FEATURES_SQL = "features AS (" + " UNION ALL ".join(
    f"SELECT as_of, company, '{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM v_snapshots "
    f"WHERE {n} IS NOT NULL" for n in NAMES
) + ")"
Z_SQL = f"""{FEATURES_SQL},
    bounds AS (SELECT as_of, feature, quantile_cont(value, 0.01) AS low,
        quantile_cont(value, 0.99) AS high FROM features GROUP BY 1, 2 HAVING count(*) >= 10),
    clipped AS (SELECT f.*, greatest(low, least(high, value)) AS c
        FROM features f JOIN bounds USING (as_of, feature)),
    scale AS (SELECT as_of, feature, avg(c) AS mean, stddev_pop(c) AS std FROM clipped
        GROUP BY 1, 2 HAVING stddev_pop(c) > 1e-12),
    zs AS (SELECT as_of, company, feature, (c - mean) / std AS z
        FROM clipped JOIN scale USING (as_of, feature))"""
_INPUTS = " UNION ALL ".join(
    f"SELECT '{f}' AS factor, '{n}' AS feature, {s} AS sign, {len(m)} AS size"
    for f, m in FACTORS.items() for n, s in m.items()
)
SCORES_SQL = f"""{Z_SQL}, inputs AS ({_INPUTS}),
    scores AS (SELECT as_of, company, factor, avg(sign * z) AS score
        FROM zs JOIN inputs USING (feature) GROUP BY 1, 2, 3 HAVING count(*) * 2 >= max(size)),
    ranked AS (SELECT *, cume_dist() OVER (PARTITION BY as_of, factor ORDER BY score)
        AS percentile FROM scores)"""
_W = " UNION ALL ".join(f"SELECT '{k}' AS factor, {v} AS weight" for k, v in WEIGHTS.items())
BLEND_SQL = f"""{SCORES_SQL}, weights AS ({_W}),
    blend AS (SELECT as_of, company, sum(weight * score) / sum(weight) AS composite
        FROM scores JOIN weights USING (factor) GROUP BY 1, 2 HAVING sum(weight) * 2 >= 2.5)"""
TOP_SQL = f"""{BLEND_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY as_of
    ORDER BY composite DESC, company DESC) AS place FROM blend QUALIFY place <= 20)"""


def scores_of(t: Tables):
    return X.factor_scores(t.snapshots())


def blend_of(t: Tables):
    return X.composite(scores_of(t), WEIGHTS)


def chosen_of(t: Tables):
    return X.select_top(blend_of(t), top_n=20)


@query(
    "cs_rank",
    f"""WITH {FEATURES_SQL} SELECT as_of, company, feature, {q('''(rank() OVER w
        + (count(*) OVER (PARTITION BY as_of, feature, value) - 1) / 2)
        / count(*) OVER (PARTITION BY as_of, feature)''')} AS rank
        FROM features WINDOW w AS (PARTITION BY as_of, feature ORDER BY value)""",
)
def cs_rank(t: Tables):
    ranked = X.cs_rank(X.long_features(t.snapshots(), NAMES))
    return ranked.select("as_of", "company", "feature", qc("rank"))


@query("zscore_winsor", f"WITH {Z_SQL} SELECT as_of, company, feature, {q('z', 5)} AS z FROM zs")
def zscore_winsor(t: Tables):
    return X.zscores(X.long_features(t.snapshots(), NAMES)).select(
        "as_of", "company", "feature", qc("z", digits=5)
    )


@query(
    "factor_scores",
    f"""WITH {SCORES_SQL} SELECT as_of, company, factor, {q('score', 5)} AS score,
        {q('percentile')} AS percentile FROM ranked""",
)
def factor_scores(t: Tables):
    return scores_of(t).select(
        "as_of", "company", "factor", qc("score", digits=5), qc("percentile")
    )


@query(
    "factors_view",
    f"""WITH {SCORES_SQL}, placed AS (SELECT *, rank() OVER (PARTITION BY as_of, factor ORDER BY score DESC) AS place,
            count(*) OVER (PARTITION BY as_of, factor) AS universe, count(*) OVER (PARTITION BY as_of, factor, score) AS tied FROM ranked),
        recent AS (SELECT *, row_number() OVER (PARTITION BY company, factor
            ORDER BY as_of DESC) AS back FROM placed QUALIFY back <= 60)
        SELECT company, factor, max(as_of) AS as_of, {q('arg_max(score, as_of)', 5)} AS score,
            {q('arg_max(percentile, as_of)')} AS percentile, arg_max(place, as_of) AS rank, arg_max(universe, as_of) AS universe, count(*) AS points,
            min(as_of) AS first_date, {q('sum(score)', 4)} AS history_total,
            string_agg(CAST(as_of AS VARCHAR), ',' ORDER BY as_of DESC) AS history_dates FROM recent GROUP BY 1, 2""",
)
def factors_view(t: Tables):
    total = F.aggregate("history", F.lit(0.0), lambda acc, h: acc + h["score"])
    dates = F.array_join(F.transform("history", lambda h: h["as_of"].cast("string")), ",")
    return X.factors_view(scores_of(t)).select(
        "company", "factor", "as_of", qc("score", digits=5), qc("percentile"), "rank", "universe", big(F.size("history"), "points"),
        F.element_at("history", -1)["as_of"].alias("first_date"), qc(total, "history_total", 4), dates.alias("history_dates"),
    )


@query(
    "composite_select",
    f"WITH {TOP_SQL} SELECT as_of, company, place, {q('composite', 5)} AS composite FROM top",
)
def composite_select(t: Tables):
    return chosen_of(t).select("as_of", "company", "place", qc("composite", digits=5))


@query(
    "composite_fraction",
    f"""WITH {BLEND_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY as_of
            ORDER BY composite DESC, company DESC) AS place,
            greatest(1, CAST(floor(count(*) OVER (PARTITION BY as_of) * 0.1) AS BIGINT)) AS keep
            FROM blend)
        SELECT as_of, company, place FROM k WHERE place <= keep""",
)
def composite_fraction(t: Tables):
    return X.select_top(blend_of(t), fraction=0.1).select("as_of", "company", big("place"))


@query(
    "signal_dates",
    f"""WITH {SCORES_SQL} SELECT DISTINCT as_of FROM scores
        WHERE as_of BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
        AND month(as_of) IN (3, 6, 9, 12)""",
)
def signal_dates(t: Tables):
    return X.signal_dates(scores_of(t), "1996-01-01", "2000-12-31", quarterly=True)


@query(
    "weights",
    f"""WITH {TOP_SQL}, v AS (SELECT t.*, vol_3m, count(*) OVER (PARTITION BY as_of) AS n
            FROM top t JOIN v_snapshots USING (as_of, company)),
        raw AS (SELECT as_of, company, 'equal' AS scheme, 1.0 AS r FROM v UNION ALL
            SELECT as_of, company, 'score', CAST(n - place + 1 AS DOUBLE) FROM v UNION ALL
            SELECT as_of, company, 'inverse_volatility', 1 / vol_3m FROM v WHERE vol_3m > 0)
        SELECT as_of, company, scheme,
            {q('r / sum(r) OVER (PARTITION BY as_of, scheme)', 5)} AS weight FROM raw""",
)
def weights(t: Tables):
    chosen = chosen_of(t).join(t.snapshots().select("as_of", "company", "vol_3m"), ["as_of", "company"])
    parts = [
        X.raw_weights(chosen, scheme).select(
            "as_of", "company", F.lit(scheme).alias("scheme"), qc("weight", digits=5)
        )
        for scheme in ("equal", "score", "inverse_volatility")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def capped_sql(cap: float) -> str:
    """CTEs from `raw` (as_of, company, weight) to `capped`."""
    return f"""ordered AS (SELECT *, row_number() OVER w AS pl, sum(weight) OVER (PARTITION BY as_of
            ORDER BY weight DESC, company ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM raw WINDOW w AS (PARTITION BY as_of ORDER BY weight DESC, company)),
        flagged AS (SELECT *, min(CASE WHEN weight * (1 - (pl - 1) * {cap}) > ({cap} + 1e-12) * rest
            THEN 1 ELSE 0 END) OVER (PARTITION BY as_of ORDER BY weight DESC, company
            ROWS UNBOUNDED PRECEDING) AS over FROM ordered),
        capped AS (SELECT as_of, company, CASE WHEN over = 1 THEN {cap} ELSE weight
            * (1 - sum(over) OVER (PARTITION BY as_of) * {cap})
            / sum(CASE WHEN over = 0 THEN weight END) OVER (PARTITION BY as_of) END AS weight
            FROM flagged)"""


@query(
    "cap_weights",
    f"""WITH {TOP_SQL}, raw AS (SELECT as_of, company, (n - place + 1) / sum(n - place + 1)
            OVER (PARTITION BY as_of) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY as_of)
            AS n FROM top)), {capped_sql(0.07)}
        SELECT as_of, company, {q('weight')} AS weight FROM capped""",
)
def cap_weights(t: Tables):
    weighted = X.raw_weights(chosen_of(t), "score")
    return X.cap_weights(weighted, 0.07).select("as_of", "company", qc("weight"))


@query(
    "coverage",
    f"""WITH {TOP_SQL} SELECT u.as_of, u.n AS universe, coalesce(b.n, 0) AS eligible,
        coalesce(c.n, 0) AS selected
        FROM (SELECT as_of, count(*) AS n FROM v_snapshots GROUP BY 1) u
        LEFT JOIN (SELECT as_of, count(*) AS n FROM blend GROUP BY 1) b USING (as_of)
        LEFT JOIN (SELECT as_of, count(*) AS n FROM top GROUP BY 1) c USING (as_of)""",
)
def coverage(t: Tables):
    blend = blend_of(t)
    return X.coverage(t.snapshots(), blend, X.select_top(blend, top_n=20))

"""Label, evaluation and journal queries over monthly supplier scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import crosssection as X
from tidemark.operators import models as L
from tidemark.operators import prices as P
from tidemark.operators import ranking as R
from tidemark.plans.base import big, q, qc, query
from tidemark.plans.crosssection import NAMES
from tidemark.plans.prices import _bench, _indexed
from tidemark.sources.views import Tables

_PREDS = """preds AS (SELECT as_of, company, company % 5 AS segment, rank() OVER (PARTITION BY as_of
        ORDER BY company * 37 % 101) / count(*) OVER (PARTITION BY as_of) AS p,
        (ebitda_to_ev - 1000) / fcf_yield - 0.2 AS excess FROM v_snapshots)"""
_UP = "CASE WHEN excess > 0 THEN 1.0 ELSE 0.0 END"


def _preds(t: Tables):
    """Scores from a fixed shuffle of companies; results from the month's price range."""
    rows = t.snapshots().select(
        "as_of", "company", (F.col("company") % 5).alias("segment"),
        (F.col("company") * 37 % 101).alias("_s"),
        ((F.col("ebitda_to_ev") - 1000) / F.col("fcf_yield") - 0.2).alias("excess"),
    )
    placed = R.with_positions(rows, ["as_of"], "_s")
    return placed.select("as_of", "company", "segment", ((F.col("below") + 1) / F.col("n")).alias("p"), "excess")


@query(
    "forward_excess",
    f"""WITH b AS (SELECT trade_date, product(coalesce(1 + ret, 1)) OVER (ORDER BY trade_date
            ROWS UNBOUNDED PRECEDING) AS bx FROM v_bench_returns),
        r AS (SELECT security_id, trade_date, last_day(trade_date) AS as_of, idx, lead(idx, 21) OVER w AS x1,
            lead(trade_date, 21) OVER w AS label_end, last_day(lead(trade_date) OVER w) AS nx FROM v_index
            WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)),
        k AS (SELECT * FROM r WHERE (nx IS NULL OR nx <> as_of) AND as_of - trade_date <= 7 AND x1 IS NOT NULL),
        j AS (SELECT k.*, b.bx AS b0 FROM k ASOF JOIN b ON k.as_of >= b.trade_date)
        SELECT security_id, as_of, label_end, {q('x1 / idx - 1 - (b.bx / b0 - 1)')} AS excess
        FROM j JOIN b ON b.trade_date = label_end""",
)
def forward_excess(t: Tables):
    bench = P.growth_index(_bench(t).withColumn("key", F.lit(1)), "key")
    return L.forward_excess(_indexed(t), bench, 21).select("security_id", "as_of", "label_end", qc("excess"))


MODEL_NAMES = NAMES


def _dataset(t: Tables):
    features = X.long_features(t.snapshots(), MODEL_NAMES)
    labels = _preds(t).select("as_of", "company", "excess", F.date_add("as_of", 30).alias("label_end"))
    sectors = t.supplier.where("s_suppkey % 7 != 0").select(
        F.col("s_suppkey").alias("company"), F.col("s_nationkey").cast("string").alias("sector")
    )
    regimes = labels.select("as_of").distinct().where(F.month("as_of") != 2).withColumn("regime", F.lit("calm"))
    return L.assemble(X.cs_rank(features), labels, sectors, regimes, MODEL_NAMES)


@query(
    "assemble",
    f"""WITH {_PREDS} SELECT s.as_of, s.company, {q('excess')} AS excess,
            coalesce(CASE WHEN s.company % 7 <> 0 THEN CAST(s_nationkey AS VARCHAR) END, 'Unclassified') AS sector,
            CASE WHEN month(s.as_of) <> 2 THEN 'calm' ELSE 'Unknown' END AS regime,
            {q('''(rank() OVER (PARTITION BY s.as_of ORDER BY ebitda_to_ev) + (count(*) OVER (
                PARTITION BY s.as_of, ebitda_to_ev) - 1) / 2) / count(*) OVER (PARTITION BY s.as_of)''')} AS ebitda_to_ev
        FROM v_snapshots s JOIN preds USING (as_of, company) LEFT JOIN supplier ON s_suppkey = s.company""",
)
def assemble(t: Tables):
    return _dataset(t).select("as_of", "company", qc("excess"), "sector", "regime", qc("ebitda_to_ev"))


@query("direction_fit")
def direction_fit(t: Tables):
    rows = L.cut_lineage(_dataset(t))
    model = L.fit_direction(rows, MODEL_NAMES, 5)
    return L.score(model, rows, MODEL_NAMES, fill=True).select("as_of", "company", qc("p", digits=4))


@query("baseline_fit")
def baseline_fit(t: Tables):
    rows = L.cut_lineage(_dataset(t))
    model = L.fit_baseline(rows, MODEL_NAMES)
    return L.score(model, rows, MODEL_NAMES, fill=False).select("as_of", "company", qc("p", digits=4))


@query("walk_forward")
def walk_forward(t: Tables):
    out = L.walk_forward(_dataset(t), MODEL_NAMES)
    digits = ("p_raw", "p", "low", "mid", "high", "p_base")
    return out.select("as_of", "company", "fold", "calibrator", *[qc(c, digits=4) for c in digits])


@query("importance")
def importance(t: Tables):
    model = L.fit_direction(L.cut_lineage(_dataset(t)), MODEL_NAMES, 5)
    weights = model.stages[-1].featureImportances.toArray()
    table = [(n, float(w)) for n, w in zip(MODEL_NAMES, weights)]
    return t.spark.createDataFrame(table, "feature string, importance double")


@query("calibrate")
def calibrate(t: Tables):
    chosen, scores = L.choose_calibrator(_preds(t).withColumn("up", (F.col("excess") > 0).cast("double")))
    rows = [(name, value, name == chosen.method, chosen.slope, chosen.intercept, len(chosen.xs)) for name, value in scores.items()]
    return t.spark.createDataFrame(rows, "method string, brier double, chosen boolean, slope double, intercept double, thresholds int")


#: Thresholds an isotonic fit could have given.
STEPS = ((0.05, 0.2, 0.45, 0.55, 0.7, 0.95), (0.3, 0.4, 0.41, 0.52, 0.6, 0.66))
_LINES = " ".join(
    f"WHEN p < {x1} THEN {y0} + (p - {x0}) * (({y1} - {y0}) / ({x1} - {x0}))"
    for x0, x1, y0, y1 in zip(STEPS[0], STEPS[0][1:], STEPS[1], STEPS[1][1:])
)


@query(
    "calibrator_apply",
    f"""WITH {_PREDS} SELECT as_of, company, p AS p_raw, {q('1 / (1 + exp(-(0.8 * ln(c / (1 - c)) + 0.1)))')} AS platt,
        {q(f'CASE WHEN p <= {STEPS[0][0]} THEN {STEPS[1][0]} {_LINES} ELSE {STEPS[1][-1]} END')} AS isotonic
        FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS c FROM preds)""",
)
def calibrator_apply(t: Tables):
    methods = (L.Calibrator("platt", 0.8, 0.1), L.Calibrator("isotonic", xs=STEPS[0], ys=STEPS[1]))
    own = F.col("p")
    return _preds(t).select("as_of", "company", own.alias("p_raw"), *[qc(m.apply(own), m.method) for m in methods])


_AUC = f"""ranked AS (SELECT *, {_UP} AS up, rank() OVER (PARTITION BY __S__ ORDER BY p) + (count(*)
        OVER (PARTITION BY __S__, p) - 1) / 2 AS rk FROM preds),
    auc AS (SELECT __S__, (sum(up * rk) - sum(up) * (sum(up) + 1) / 2) / (sum(up) * sum(1 - up)) AS auc
        FROM ranked GROUP BY 1)"""
_CLASS = f"""SELECT __S__, count(*) AS rows, {q(f'avg({_UP})')} AS base_rate,
        {q(f'avg(power(p - {_UP}, 2))', 5)} AS brier, {q('any_value(auc)', 5)} AS auc,
        {q(f'-avg({_UP} * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - {_UP}) * ln(1 - greatest(1e-6, least(1 - 1e-6, p))))', 4)} AS log_loss,
        {q(f'avg(CASE WHEN (p > 0.5) = (excess > 0) THEN 1.0 ELSE 0.0 END)')} AS hit_rate
        FROM preds JOIN auc USING (__S__) GROUP BY 1"""


def _class_columns(rows, key):
    return rows.select(
        key, "rows", qc("base_rate"), qc("brier", digits=5), qc("auc", digits=5), qc("log_loss", digits=4), qc("hit_rate")
    )


@query("clf_metrics", f"WITH {_PREDS.replace('company % 5 AS', '0 AS')}, {_AUC} {_CLASS}".replace("__S__", "segment"))
def clf_metrics(t: Tables):
    preds = _preds(t).withColumn("segment", F.lit(0))
    return _class_columns(L.classification(preds, ["segment"]), F.col("segment").cast("int").alias("segment"))


@query("segment_metrics", f"WITH {_PREDS}, {_AUC} {_CLASS} HAVING count(*) >= 300".replace("__S__", "segment"))
def segment_metrics(t: Tables):
    return _class_columns(L.segment_metrics(_preds(t), "segment"), "segment")


_IC = f"""{_PREDS}, r AS (SELECT *, count(*) OVER (PARTITION BY as_of) AS n,
        rank() OVER (PARTITION BY as_of ORDER BY p) + (count(*) OVER (PARTITION BY as_of, p) - 1) / 2 AS rp,
        rank() OVER (PARTITION BY as_of ORDER BY excess) + (count(*) OVER (PARTITION BY as_of, excess) - 1) / 2 AS re
        FROM preds),
    ics AS (SELECT as_of, corr(rp, re) AS ic FROM r WHERE n >= 20 GROUP BY 1)"""


@query(
    "rank_ic",
    f"""WITH {_IC} SELECT count(*) AS dates, {q('avg(ic)', 5)} AS mean, {q('stddev_samp(ic)', 5)} AS std,
        {q('avg(ic) / stddev_samp(ic) * sqrt(count(*))', 3)} AS t_stat,
        {q('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_share FROM ics""",
)
def rank_ic(t: Tables):
    found = L.rank_ic(L.cut_lineage(_preds(t)), [])
    return found.select("dates", qc("mean", digits=5), qc("std", digits=5), qc("t_stat", digits=3), qc("positive_share"))


@query(
    "decile_spread",
    f"""WITH {_PREDS}, r AS (SELECT *, count(*) OVER (PARTITION BY as_of) AS n, row_number() OVER (
            PARTITION BY as_of ORDER BY p, company) AS i FROM preds),
        d AS (SELECT as_of, avg(excess) FILTER (i > n - greatest(1, n // 10))
            - avg(excess) FILTER (i <= greatest(1, n // 10)) AS s FROM r WHERE n >= 30 GROUP BY 1)
        SELECT {q('avg(s)')} AS decile_spread, count(*) AS dates FROM d""",
)
def decile_spread(t: Tables):
    return L.decile_spread(L.cut_lineage(_preds(t)), []).select(qc("decile_spread"), "dates")


@query(
    "calibration_bins",
    f"""WITH {_PREDS} SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS count,
        {q('avg(p)')} AS predicted, {q(f'avg({_UP})')} AS observed FROM preds GROUP BY 1""",
)
def calibration_bins(t: Tables):
    return L.calibration_bins(_preds(t)).select(big("bin"), "count", qc("predicted"), qc("observed"))


_FORECAST = f"""{_PREDS}, binned AS (SELECT *, least(floor(p * 10), 9) AS bin FROM preds),
    ranges AS (SELECT bin, quantile_cont(excess, 0.1) AS low, quantile_cont(excess, 0.5) AS mid,
        quantile_cont(excess, 0.9) AS high FROM binned WHERE as_of < DATE '2000-01-01' GROUP BY 1),
    forecast AS (SELECT * FROM binned LEFT JOIN ranges USING (bin) WHERE as_of >= DATE '2000-01-01')"""


def _forecast(t: Tables):
    preds = _preds(t)
    cut = F.lit("2000-01-01").cast("date")
    return L.interval_forecast(preds.where(F.col("as_of") < cut), preds.where(F.col("as_of") >= cut))


@query(
    "interval_forecast",
    f"""WITH {_FORECAST} SELECT as_of, company, {q('low')} AS low, {q('mid')} AS mid, {q('high')} AS high FROM forecast""",
)
def interval_forecast(t: Tables):
    return _forecast(t).select("as_of", "company", qc("low"), qc("mid"), qc("high"))


@query(
    "quantile_metrics",
    f"""WITH {_FORECAST} SELECT {q('avg(CASE WHEN excess BETWEEN low AND high THEN 1.0 ELSE 0.0 END)')} AS coverage_10_90,
        {q('avg(abs(excess - mid)) / 2')} AS pinball_median, {q('avg(abs(excess - mid))')} AS median_abs_error FROM forecast""",
)
def quantile_metrics(t: Tables):
    found = L.quantile_metrics(_forecast(t))
    return found.select(*[qc(c) for c in found.columns])


@query(
    "validation_gate",
    f"""WITH {_IC}, {_AUC.replace('ranked', 'rk2')} SELECT {q('auc', 5)} AS auc, {q('t', 3)} AS t_stat,
        coalesce(auc > 0.52 AND b < br * (1 - br) AND t > 2, false) AS validated
        FROM auc, (SELECT avg(power(p - {_UP}, 2)) AS b, avg({_UP}) AS br FROM preds),
        (SELECT avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS t FROM ics)""".replace("company % 5 AS", "0 AS").replace("__S__", "segment"),
)
def validation_gate(t: Tables):
    preds = L.cut_lineage(_preds(t).withColumn("segment", F.lit(0)))
    both = L.classification(preds, ["segment"]).join(L.rank_ic(preds, ["segment"]), "segment")
    return L.gate(both).select(qc("auc", digits=5), qc("t_stat", digits=3), "validated")


# --- Journal ------------------------------------------------------------------------------

_JOURNAL = f"""{_PREDS}, stored AS (SELECT 'm1' AS model, company, as_of, p, excess FROM preds WHERE segment <> 4),
    done AS (SELECT * FROM stored WHERE as_of < DATE '2000-01-01'),
    matured AS (SELECT model, company, as_of, excess, excess > 0 AS went_up, power(p - {_UP}, 2) AS brier
        FROM stored WHERE as_of >= DATE '2000-01-01' AND as_of < DATE '2001-06-01')"""


def _journal(t: Tables):
    preds = _preds(t)
    stored = preds.where("segment != 4").select(F.lit("m1").alias("model"), "company", "as_of", "p")
    labels = preds.select("company", "as_of", "excess").where(F.col("as_of") < F.lit("2001-06-01").cast("date"))
    done = stored.where(F.col("as_of") < F.lit("2000-01-01").cast("date")).select("model", "company", "as_of")
    return stored, labels, done


#: A known scorer: log-odds of two ranked inputs and one that is missing for some.
_WEIGHTS = {"x1": 1.5, "x2": -2.0, "x3": 0.75}
_X = """x AS (SELECT *, p AS x1, (company * 7 + month(as_of)) % 10 / 10.0 AS x2, CASE WHEN company % 3 <> 0 THEN 0.9 END AS x3 FROM preds),
    c AS (SELECT *, 1.5 * (x1 - 0.5) AS c1, -2.0 * (x2 - 0.5) AS c2, 0.75 * (coalesce(x3, 0.5) - 0.5) AS c3 FROM x),
    scored AS (SELECT *, 1 / (1 + exp(-(c1 + c2 + c3))) AS raw FROM c)"""


def _scorer(rows):
    odds = sum(w * (F.coalesce(F.col(n), F.lit(0.5)) - 0.5) for n, w in _WEIGHTS.items())
    return rows.withColumn("p", 1 / (1 + F.exp(-odds)))


@query(
    "predict_latest",
    f"""WITH {_PREDS}, {_X}, cal AS (SELECT *, 1 / (1 + exp(-(0.8 * ln(raw / (1 - raw)) + 0.1))) AS cp FROM scored),
        binned AS (SELECT *, least(floor(cp * 10), 9) AS bin FROM cal),
        past AS (SELECT * FROM binned WHERE as_of < DATE '2000-01-01'),
        ranges AS (SELECT bin, quantile_cont(excess, 0.1) AS low, quantile_cont(excess, 0.5) AS mid, quantile_cont(excess, 0.9) AS high FROM past GROUP BY 1),
        every AS (SELECT quantile_cont(excess, 0.1) AS low, quantile_cont(excess, 0.5) AS mid, quantile_cont(excess, 0.9) AS high FROM past),
        parts AS (SELECT company, as_of, unnest([{{'o': -abs(c1), 'f': 'x1', 'c': c1}}, {{'o': -abs(c2), 'f': 'x2', 'c': c2}}, {{'o': -abs(c3), 'f': 'x3', 'c': c3}}]) AS d FROM scored),
        tops AS (SELECT company, as_of, string_agg(f || ':' || round(c * 1000)::INT, ',' ORDER BY o, f) AS drivers FROM (SELECT company, as_of, d.f AS f, d.c AS c, d.o AS o,
            row_number() OVER (PARTITION BY company, as_of ORDER BY d.o, d.f) AS r FROM parts) WHERE r <= 2 GROUP BY ALL)
        SELECT 'm1' AS model, company, as_of, {q('raw')} AS p_raw, {q('cp')} AS p, {q('coalesce(r.low, e.low)')} AS low, {q('coalesce(r.mid, e.mid)')} AS mid,
            {q('coalesce(r.high, e.high)')} AS high, drivers FROM binned LEFT JOIN ranges r USING (bin), every e JOIN tops USING (company, as_of)
        WHERE as_of = (SELECT max(as_of) FROM preds) AND segment = 4""".replace("binned LEFT JOIN ranges r USING (bin), every e JOIN tops USING (company, as_of)",
        "binned LEFT JOIN ranges r USING (bin) CROSS JOIN every e JOIN tops USING (company, as_of)"),
)
def predict_latest(t: Tables):
    inputs = _preds(t).select(
        "as_of", "company", "segment", "excess", F.col("p").alias("x1"),
        ((F.col("company") * 7 + F.month("as_of")) % 10 / 10).alias("x2"), F.when(F.col("company") % 3 != 0, 0.9).alias("x3"),
    )
    calibrator = L.Calibrator("platt", 0.8, 0.1)
    scored = L.cut_lineage(_scorer(inputs).withColumnRenamed("p", "p_raw").withColumn("p", calibrator.apply(F.col("p_raw"))))
    past = scored.where(F.col("as_of") < F.lit("2000-01-01").cast("date")).select("p", "excess")
    stored = scored.where("segment != 4").select(F.lit("m1").alias("model"), "company", "as_of")
    fresh = L.new_predictions(scored.withColumn("model", F.lit("m1")), stored)
    why = L.drivers(fresh, list(_WEIGHTS), _scorer, top=2)
    named = F.transform("drivers", lambda d: F.concat(d["feature"], F.lit(":"), F.round(d["contribution"] * 1000).cast("int").cast("string")))
    found = L.interval_forecast(past, fresh, whole=True).join(why.select("as_of", "company", F.array_join(named, ",").alias("drivers")), ["as_of", "company"])
    return found.select("model", "company", "as_of", qc("p_raw"), qc("p"), qc("low"), qc("mid"), qc("high"), "drivers")


@query("score_outcomes", f"WITH {_JOURNAL} SELECT model, company, as_of, went_up, {q('brier')} AS brier FROM matured")
def score_outcomes(t: Tables):
    stored, labels, done = _journal(t)
    return L.score_outcomes(stored, done, labels).select("model", "company", "as_of", "went_up", qc("brier"))


@query(
    "journal_summary",
    f"""WITH {_JOURNAL} SELECT model, count(*) AS scored, {q('avg(brier)')} AS brier,
        {q('avg(CASE WHEN went_up THEN 1.0 ELSE 0.0 END)')} AS observed_rate FROM matured GROUP BY 1""",
)
def journal_summary(t: Tables):
    stored, labels, done = _journal(t)
    outcomes = L.score_outcomes(stored, done, labels)
    return L.journal_summary(stored, outcomes).select("model", "scored", qc("brier"), qc("observed_rate"))


@query(
    "history",
    f"""WITH {_JOURNAL}, h AS (SELECT * FROM stored WHERE company = 3 ORDER BY as_of DESC LIMIT 36)
        SELECT h.as_of, {q('h.p')} AS p, {q('m.excess')} AS excess FROM h LEFT JOIN matured m USING (model, company, as_of)""",
)
def history(t: Tables):
    stored, labels, done = _journal(t)
    return L.history(stored, L.score_outcomes(stored, done, labels), 3).select("as_of", qc("p"), qc("excess"))


_VIEW = f"""{_PREDS}, doubled AS (SELECT 'm1' AS model, company, as_of, segment, p, excess FROM preds UNION ALL
        SELECT 'm2', company, as_of, segment, 1 / (1 + exp(-20 * excess - 3 * (p - 0.5))), excess FROM preds),
    stored AS (SELECT * FROM doubled WHERE segment <> 4),
    known AS (SELECT * FROM stored WHERE as_of < DATE '2001-06-01'),
    ranked AS (SELECT *, {_UP} AS up, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2 AS rk FROM known),
    quality AS (SELECT model, (sum(up * rk) - sum(up) * (sum(up) + 1) / 2) / (sum(up) * sum(1 - up)) AS auc, avg(power(p - up, 2)) AS brier,
        avg(up) * (1 - avg(up)) AS base FROM ranked GROUP BY 1),
    r AS (SELECT *, count(*) OVER (PARTITION BY model, as_of) AS n, rank() OVER (PARTITION BY model, as_of ORDER BY p) + (count(*) OVER (PARTITION BY model, as_of, p) - 1) / 2 AS rp,
        rank() OVER (PARTITION BY model, as_of ORDER BY excess) + (count(*) OVER (PARTITION BY model, as_of, excess) - 1) / 2 AS re FROM known),
    ics AS (SELECT model, avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS t FROM (SELECT model, as_of, corr(rp, re) AS ic FROM r WHERE n >= 20 GROUP BY 1, 2) GROUP BY 1),
    gates AS (SELECT model, coalesce(auc > 0.52 AND brier < base AND t > 2, false) AS validated FROM quality LEFT JOIN ics USING (model)),
    newest AS (SELECT model, company, max(as_of) AS as_of, arg_max(p, as_of) AS p FROM stored GROUP BY 1, 2),
    past AS (SELECT model, company, count(*) AS realised, avg(CASE WHEN (p > 0.5) = (excess > 0) THEN 1.0 ELSE 0.0 END) AS hit_rate, arg_max(excess, as_of) AS last_excess FROM known GROUP BY 1, 2)"""


@query(
    "predictions_view",
    f"""WITH {_VIEW} SELECT model, company, as_of, {q('p')} AS p, validated, coalesce(realised, 0) AS realised, {q('hit_rate')} AS hit_rate,
        {q('last_excess')} AS last_excess FROM newest JOIN gates USING (model) LEFT JOIN past USING (model, company)""",
)
def predictions_view(t: Tables):
    preds = _preds(t)
    sharp = preds.withColumn("p", 1 / (1 + F.exp(-20 * F.col("excess") - 3 * (F.col("p") - 0.5))))
    both = preds.withColumn("model", F.lit("m1")).unionByName(sharp.withColumn("model", F.lit("m2")))
    stored = L.cut_lineage(both.where("segment != 4").select("model", "company", "as_of", "p", "excess"))
    labels = preds.select("company", "as_of", "excess").where(F.col("as_of") < F.lit("2001-06-01").cast("date"))
    made = stored.drop("excess")
    outcomes = L.score_outcomes(made, made.limit(0), labels)
    models = L.evaluated(made, outcomes).select("model", F.lit("active").alias("status"), "validated")
    found = L.latest_predictions(made, models, outcomes)
    return found.select("model", "company", "as_of", qc("p"), "validated", "realised", qc("hit_rate"), qc("last_excess"))


@query(
    "train_store",
    """SELECT o_orderkey AS version, o_orderpriority AS name, CASE WHEN o_orderstatus = 'F'
        AND o_orderpriority <> '5-LOW' THEN 'retired' WHEN o_orderstatus = 'F' THEN 'active' ELSE 'draft' END AS status
        FROM orders UNION ALL SELECT -1, o_orderpriority, 'active' FROM orders WHERE o_orderpriority <> '5-LOW'
        GROUP BY o_orderpriority""",
)
def train_store(t: Tables):
    models = t.orders.select(
        F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") == "F", "active").otherwise("draft").alias("status"),
    )
    fresh = t.orders.where("o_orderpriority != '5-LOW'").select(F.col("o_orderpriority").alias("name")).distinct()
    version = fresh.select(F.lit(-1).cast("bigint").alias("version"), "name", F.lit("active").alias("status"))
    return L.retire_and_add(models, version)


@query(
    "research_status",
    """SELECT count(*) AS snapshots, count(DISTINCT as_of) AS dates, count(DISTINCT company) AS companies FROM v_snapshots""",
)
def research_status(t: Tables):
    return t.snapshots().agg(
        F.count(F.lit(1)).alias("snapshots"), F.count_distinct("as_of").alias("dates"), F.count_distinct("company").alias("companies")
    )

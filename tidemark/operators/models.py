"""Labels, walk-forward evaluation, calibration and the prediction journal."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import ranking as R
from tidemark.session import cut_lineage

MIN_TRAIN_YEARS, EMBARGO_DAYS, CALIBRATION_DAYS = 4, 31, 372


def daily_levels(bench_indexed: DataFrame, until: DataFrame) -> DataFrame:
    """The benchmark's level on every calendar day (the last one known), to the date in `until` (one row, `until`)."""
    w = Window.orderBy("trade_date")  # one row per trading day
    spans = bench_indexed.crossJoin(F.broadcast(until)).select(
        "trade_date", F.col("idx").alias("level"),
        F.coalesce(F.date_sub(F.lead("trade_date").over(w), 1), F.greatest("trade_date", "until")).alias("_to"),
    )
    return spans.select(F.explode(F.sequence("trade_date", "_to")).alias("day"), "level", F.col("trade_date").alias("bench_day"))


def forward_excess(indexed: DataFrame, bench_indexed: DataFrame, horizon: int) -> DataFrame:
    """Return over the next `horizon` bars minus the benchmark's over the same dates, from the last
    bar in the week before each month end; absent until the horizon has passed."""
    w = Window.partitionBy("security_id").orderBy("trade_date")
    month = F.last_day("trade_date")
    rows = indexed.select(
        "security_id", "trade_date", month.alias("as_of"), "idx",
        F.lead("idx", horizon).over(w).alias("_then"), F.lead("trade_date", horizon).over(w).alias("label_end"),
        F.lead(month).over(w).alias("_next"),
    )
    base = rows.where(
        (F.col("_next").isNull() | (F.col("_next") != F.col("as_of")))
        & (F.datediff("as_of", "trade_date") <= 7) & F.col("_then").isNotNull()
    )
    level = daily_levels(bench_indexed, indexed.agg(F.max(F.last_day("trade_date")).alias("until")))
    start = F.broadcast(level.select(F.col("day").alias("as_of"), F.col("level").alias("_b0"), F.col("bench_day").alias("_d0")))
    end = F.broadcast(level.select(F.col("day").alias("label_end"), F.col("level").alias("_b1"), F.col("bench_day").alias("_d1")))
    joined = base.join(start, "as_of").join(end, "label_end").where(F.col("_d1") > F.col("_d0"))  # calendar-sized
    return joined.select(
        "security_id", "as_of", "label_end",
        (F.col("_then") / F.col("idx") - 1 - (F.col("_b1") / F.col("_b0") - 1)).alias("excess"),
    )


def assemble(ranks: DataFrame, labels: DataFrame, sectors: DataFrame, regimes: DataFrame, names: list[str]) -> DataFrame:
    """One row per (date, company): feature ranks, label, sector and regime with stated defaults."""
    wide = ranks.groupBy("as_of", "company").agg(
        *[F.max(F.when(F.col("feature") == n, F.col("rank"))).alias(n) for n in names]
    )
    joined = wide.join(labels, ["as_of", "company"], "left").join(sectors, "company", "left").join(regimes, "as_of", "left")
    return joined.withColumn("sector", F.coalesce("sector", F.lit("Unclassified"))).withColumn(
        "regime", F.coalesce("regime", F.lit("Unknown"))
    )


# --- Models -------------------------------------------------------------------------------


def _probability(frame: DataFrame) -> DataFrame:
    return frame.withColumn("p", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "vector", "filled", "scaled")


def _assembler(names: list[str], inputs: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=inputs, outputCol="filled", handleInvalid="keep")


def fit_direction(rows: DataFrame, names: list[str], rounds: int = 10):
    """Boosted trees for P(excess > 0). Missing inputs are set to the middle rank."""
    data = rows.fillna(0.5, names).withColumn("label", (F.col("excess") > 0).cast("double"))
    trees = GBTClassifier(featuresCol="filled", maxIter=rounds, maxDepth=3, seed=7)
    return Pipeline(stages=[_assembler(names, names), trees]).fit(data)


def fit_baseline(rows: DataFrame, names: list[str]):
    """Median imputation, standardisation and an L2 logistic regression."""
    data = rows.withColumn("label", (F.col("excess") > 0).cast("double"))
    filled = [f"{n}_filled" for n in names]
    stages = [
        Imputer(strategy="median", inputCols=names, outputCols=filled),
        _assembler(names, filled),
        StandardScaler(inputCol="filled", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", regParam=0.01, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(data)


def score(model, rows: DataFrame, names: list[str], *, fill: bool) -> DataFrame:
    data = rows.fillna(0.5, names) if fill else rows
    scored = _probability(model.transform(data))
    return scored.drop(*[f"{n}_filled" for n in names])


def logit(p: Column) -> Column:
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(clipped / (1 - clipped))


def apply_platt(p: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(a) * logit(p) + F.lit(b))))


def fit_platt(rows: DataFrame) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on the logit (columns p, up)."""
    data = VectorAssembler(inputCols=["_x"], outputCol="features").transform(rows.withColumn("_x", logit(F.col("p"))))
    fitted = LogisticRegression(labelCol="up", regParam=0.0, maxIter=50).fit(data)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def fit_isotonic(rows: DataFrame) -> Calibrator:
    """Rising steps through (p, up), as thresholds to interpolate between.

    The fit gathers its input in one place, so it sees a grid of 10,001 scores, each once with its mean and weight."""
    grid = rows.groupBy(F.round("p", 4).alias("p")).agg(F.avg("up").alias("up"), F.count(F.lit(1)).cast("double").alias("weight"))
    vector = VectorAssembler(inputCols=["p"], outputCol="features")
    fitted = IsotonicRegression(labelCol="up", weightCol="weight").fit(vector.transform(grid))
    return Calibrator("isotonic", xs=tuple(map(float, fitted.boundaries)), ys=tuple(map(float, fitted.predictions)))


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Straight lines between ascending thresholds, flat beyond them; a binary search of nested conditions."""

    def between(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(ys[low]) + (x - xs[low]) * ((ys[high] - ys[low]) / (xs[high] - xs[low]))
        middle = (low + high) // 2
        return F.when(x < xs[middle], between(low, middle)).otherwise(between(middle, high))

    ends = F.when(x <= xs[0], F.lit(ys[0])).when(x >= xs[-1], F.lit(ys[-1]))
    return ends.otherwise(between(0, len(xs) - 1)) if len(xs) > 1 else ends


@dataclass(frozen=True)
class Calibrator:
    """How raw scores become probabilities: `none`, `platt` (slope and intercept on the logit) or `isotonic` (thresholds)."""

    method: str = "none"
    slope: float = 1.0
    intercept: float = 0.0
    xs: tuple[float, ...] = ()
    ys: tuple[float, ...] = ()

    def apply(self, p: Column) -> Column:
        if self.method == "platt":
            return apply_platt(p, self.slope, self.intercept)
        return interpolate(p, self.xs, self.ys) if self.method == "isotonic" else p


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows before and from the median date on."""
    cut = rows.agg(F.percentile(F.unix_date("as_of"), F.lit(0.5)).alias("cut"))  # a date count
    marked = rows.join(F.broadcast(cut))  # one row
    return marked.where(F.unix_date("as_of") < F.col("cut")), marked.where(F.unix_date("as_of") >= F.col("cut"))


def _both_classes(rows: DataFrame) -> bool:
    n, ups = rows.agg(F.count(F.lit(1)), F.sum("up")).first()
    return bool(n) and 0 < ups < n


def choose_calibrator(rows: DataFrame, minimum: int = 200) -> tuple[Calibrator, dict[str, float]]:
    """Columns p, up, as_of → the calibrator with the lowest Brier score, and all scores by method.

    Platt and isotonic calibration are fitted on the first half of the window by date and scored with raw scores on the
    second; the winner is fitted again on the whole window. Under `minimum` rows or with one class only, raw scores stay."""
    rows = cut_lineage(rows.select("as_of", "p", F.col("up").cast("double").alias("up")))
    if rows.count() < minimum or not _both_classes(rows):
        return Calibrator(), {}
    first, second = _halves(rows)
    fits = {"platt": _platt, "isotonic": fit_isotonic} if _both_classes(first) else {}
    tried = {"none": Calibrator()} | {name: fit(first) for name, fit in fits.items()}
    brier = [F.avg(F.pow(c.apply(F.col("p")) - F.col("up"), 2)).alias(name) for name, c in tried.items()]
    scores = second.agg(*brier).first().asDict()
    best = min(scores, key=scores.get)
    return (fits[best](rows) if best in fits else Calibrator()), scores


def _platt(rows: DataFrame) -> Calibrator:
    slope, intercept = fit_platt(rows)
    return Calibrator("platt", slope, intercept)


@dataclass(frozen=True)
class FittedWindow:
    """What one training window gives: raw model, calibrator with its scores, ranges per score bin, baseline."""

    direction: object
    calibrator: Calibrator
    brier: dict[str, float]
    past: DataFrame
    baseline: object


def fit_window(train: DataFrame, last, names: list[str], rounds: int = 10) -> FittedWindow:
    """Fit on labels that ended an embargo before the window's last CALIBRATION_DAYS, calibrate on those days.

    `last`: the newest as_of of `train`. The baseline and nothing else sees the whole window. `past` holds the calibrated
    scores and results of the calibration days, from which ranges are read: the direction model never saw them."""
    start = F.date_sub(F.lit(last), CALIBRATION_DAYS)
    direction = fit_direction(train.where(F.col("label_end") < F.date_sub(start, EMBARGO_DAYS)), names, rounds)
    held = cut_lineage(score(direction, train.where(F.col("as_of") >= start), names, fill=True).select("as_of", "p", "excess"))
    calibrator, brier = choose_calibrator(held.withColumn("up", (F.col("excess") > 0).cast("double")))
    past = held.select(calibrator.apply(F.col("p")).alias("p"), "excess")
    return FittedWindow(direction, calibrator, brier, past, fit_baseline(train, names))


def predict(window: FittedWindow, rows: DataFrame, names: list[str]) -> DataFrame:
    """rows → with p_raw, calibrated p and the 10/50/90% range of past results at such scores."""
    scored = score(window.direction, rows, names, fill=True).withColumnRenamed("p", "p_raw")
    scored = scored.withColumn("p", window.calibrator.apply(F.col("p_raw")))
    return interval_forecast(window.past, scored, whole=True).drop("bin")


def walk_forward(rows: DataFrame, names: list[str], *, minimum: tuple[int, int] = (2000, 200), rounds: int = 10) -> DataFrame:
    """Out-of-sample predictions by yearly folds from the fifth year, trained only on labels that ended before the fold by an
    embargo, calibrated on the training window's last days, with ranges and the calibrator's name.

    Folds with too few training or test rows, or without rows to fit on before the calibration days, give nothing. The driver
    loops over years; rows stay in Spark."""
    labelled = cut_lineage(rows.where(F.col("excess").isNotNull()))
    years = [r[0] for r in labelled.select(F.year("as_of").alias("y")).distinct().orderBy("y").collect()]  # a few years
    starts = {year: F.date_sub(F.make_date(F.lit(year), F.lit(1), F.lit(1)), EMBARGO_DAYS) for year in years[MIN_TRAIN_YEARS:]}
    known = {year: F.col("label_end") < start for year, start in starts.items()}
    facts = [
        x.alias(f"{name}{year}")
        for year in starts
        for name, x in (("train", F.count_if(known[year])), ("test", F.count_if(F.year("as_of") == year)), ("last", F.max(F.when(known[year], F.col("as_of")))))
    ]
    sizes = labelled.agg(*facts).first().asDict() if facts else {}  # of all folds in one pass
    out = None
    for year in starts:
        if sizes[f"train{year}"] < minimum[0] or sizes[f"test{year}"] < minimum[1]:
            continue
        train, test = labelled.where(known[year]), labelled.where(F.year("as_of") == year)
        last = sizes[f"last{year}"]
        if train.where(F.col("label_end") < F.date_sub(F.lit(last), CALIBRATION_DAYS + EMBARGO_DAYS)).isEmpty():
            continue
        window = fit_window(train, last, names, rounds)
        trees = predict(window, test, names).select("as_of", "company", "excess", "label_end", "p_raw", "p", "low", "mid", "high")
        base = score(window.baseline, test, names, fill=False).select("as_of", "company", F.col("p").alias("p_base"))
        both = trees.join(base, ["as_of", "company"]).withColumns({"fold": F.lit(year), "calibrator": F.lit(window.calibrator.method)})
        out = both if out is None else out.unionByName(both)
    return out if out is not None else labelled.limit(0).selectExpr(
        "as_of", "company", "excess", "label_end", "0D as p_raw", "0D as p", "0D as low", "0D as mid", "0D as high", "0D as p_base",
        "0 as fold", "'none' as calibrator",
    )


def drivers(rows: DataFrame, names: list[str], scored: Callable[[DataFrame], DataFrame], top: int = 5) -> DataFrame:
    """rows (as_of, company, inputs) → as_of, company, drivers: the inputs that move a score most, largest first.

    `scored` adds p to rows. An input's contribution is the row's log-odds less those with the input at its middle rank;
    missing inputs are at the middle already. All variants of a row are scored in one pass."""
    rows = rows.select("as_of", "company", *names)
    variants = rows.withColumn("_input", F.explode(F.array(F.lit(""), *map(F.lit, names))))
    changed = variants.select(
        "as_of", "company", "_input", *[F.col(n).alias(f"_own_{n}") for n in names],
        *[F.when(F.col("_input") == n, F.lit(0.5)).otherwise(F.col(n)).alias(n) for n in names],
    )
    odds = scored(changed).withColumn("_odds", logit(F.col("p")))
    own = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"_own_{n}"))])
    per_row = odds.groupBy("as_of", "company").agg(
        F.max(F.when(F.col("_input") == "", F.col("_odds"))).alias("_full"),
        F.collect_list(F.when(F.col("_input") != "", F.struct("_input", F.element_at(own, F.col("_input")).alias("_rank"), "_odds"))).alias("_without"),
    )  # a row's inputs
    found = F.transform("_without", lambda w: F.struct(
        (-F.abs(F.col("_full") - w["_odds"])).alias("_order"), w["_input"].alias("feature"), w["_rank"].alias("percentile"),
        (F.col("_full") - w["_odds"]).alias("contribution"),
    ))
    kept = F.transform(F.slice(F.sort_array(found), 1, top), lambda d: F.struct(d["feature"], d["percentile"], d["contribution"]))
    return per_row.select("as_of", "company", kept.alias("drivers"))


# --- Evaluation ---------------------------------------------------------------------------


def auc(preds: DataFrame, by: list[str]) -> DataFrame:
    """Exact area under the curve from average ranks; null without both classes."""
    up = (F.col("excess") > 0).cast("long")
    counts = preds.groupBy(*by, "p").agg(F.sum(up).alias("_up"), F.count(F.lit(1)).alias("_n"))
    places = R.value_positions(preds, by, "p").drop("ties")
    joined = counts.join(places, [*by, "p"])
    rank = F.col("below") + (F.col("_n") + 1) / 2
    sums = joined.groupBy(*by).agg(
        F.sum(F.col("_up") * rank).alias("_ranks"), F.sum("_up").alias("_pos"), F.sum(F.col("_n") - F.col("_up")).alias("_neg")
    )
    area = (F.col("_ranks") - F.col("_pos") * (F.col("_pos") + 1) / 2) / (F.col("_pos") * F.col("_neg"))
    return sums.select(*by, F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), area).alias("auc"))


def classification(preds: DataFrame, by: list[str]) -> DataFrame:
    """Rows, base rate, Brier scores, log loss, AUC and hit rate per group (columns p, excess)."""
    up = (F.col("excess") > 0).cast("double")
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    loss = -(up * F.ln(clipped) + (1 - up) * F.ln(1 - clipped))
    base = preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(up).alias("base_rate"),
        F.avg(F.pow(F.col("p") - up, 2)).alias("brier"), F.avg(loss).alias("log_loss"),
        F.avg(((F.col("p") > 0.5) == (up > 0.5)).cast("double")).alias("hit_rate"),
    )
    base = base.withColumn("brier_base_rate", F.col("base_rate") * (1 - F.col("base_rate")))
    return base.join(auc(preds, by), by)


def rank_ic(preds: DataFrame, by: list[str], minimum: int = 20) -> DataFrame:
    """Spearman correlation of score and result per date, averaged per group, with its t-statistic."""
    keys = [*by, "as_of"]
    a = R.value_positions(preds, keys, "p").select(*keys, "p", R.average_rank().alias("_rp"), "n")
    b = R.value_positions(preds, keys, "excess").select(*keys, "excess", R.average_rank().alias("_re"))
    ranked = preds.join(a, [*keys, "p"]).join(b, [*keys, "excess"]).where(F.col("n") >= minimum)
    spread = F.stddev_pop("_rp") * F.stddev_pop("_re")  # zero where a date's scores or results are all equal
    dates = ranked.groupBy(*keys).agg(F.try_divide(F.covar_pop("_rp", "_re"), spread).alias("ic")).where("ic is not null")
    return dates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dates"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"),
        (F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count(F.lit(1)))).alias("t_stat"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"),
    )


def decile_spread(preds: DataFrame, by: list[str], minimum: int = 30) -> DataFrame:
    """Top minus bottom decile mean result per date, averaged; ties inside a date go by company."""
    keys = [*by, "as_of"]
    tied = Window.partitionBy(*keys, "p").orderBy("company")
    placed = R.with_positions(preds, keys, "p").where(F.col("n") >= minimum).withColumn(
        "_i", F.col("below") + F.row_number().over(tied)
    )
    size = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    dates = placed.groupBy(*keys).agg(
        (F.avg(F.when(F.col("_i") > F.col("n") - size, F.col("excess"))) - F.avg(F.when(F.col("_i") <= size, F.col("excess")))).alias("_s")
    )
    return dates.groupBy(*by).agg(F.avg("_s").alias("decile_spread"), F.count(F.lit(1)).alias("dates"))


def calibration_bins(preds: DataFrame, bins: int = 10) -> DataFrame:
    up = (F.col("excess") > 0).cast("double")
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return preds.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("p").alias("predicted"), F.avg(up).alias("observed")
    )


def segment_metrics(preds: DataFrame, segment: str, minimum: int = 300) -> DataFrame:
    return classification(preds, [segment]).where(F.col("rows") >= minimum)


def interval_forecast(train: DataFrame, new: DataFrame, bins: int = 10, *, whole: bool = False) -> DataFrame:
    """10/50/90% range of results among past rows of the same score bin.

    Where the bin has no past rows it is null, or that of all past rows (`whole`)."""
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    levels = {"low": 0.1, "mid": 0.5, "high": 0.9}
    past = train.select(F.explode(F.array(place, F.lit(-1).cast("long")) if whole else F.array(place)).alias("bin"), "excess")
    quant = cut_lineage(R.quantiles(R.value_positions(past, ["bin"], "excess"), ["bin"], "excess", levels).drop("n"))
    found = new.withColumn("bin", place).join(F.broadcast(quant), "bin", "left")  # one row per bin
    if not whole:
        return found
    every = quant.where("bin = -1").select(*[F.col(c).alias(f"_{c}") for c in levels])
    found = found.join(F.broadcast(every), how="left")  # one row
    return found.withColumns({c: F.coalesce(c, f"_{c}") for c in levels}).drop(*[f"_{c}" for c in levels])


def quantile_metrics(rows: DataFrame) -> DataFrame:
    inside = F.col("excess").between(F.col("low"), F.col("high")).cast("double")
    gap = F.abs(F.col("excess") - F.col("mid"))
    return rows.agg(F.avg(inside).alias("coverage_10_90"), F.avg(gap / 2).alias("pinball_median"), F.avg(gap).alias("median_abs_error"))


def gate(evaluation: DataFrame) -> DataFrame:
    """Validated: AUC over 0.52, Brier under the base rate's, rank IC t-statistic over 2 (without bound where all dates have one IC above 0)."""
    steady = F.coalesce((F.col("std") == 0) & (F.col("mean") > 0), F.lit(False))
    rule = (F.col("auc") > 0.52) & (F.col("brier") < F.col("brier_base_rate")) & (steady | (F.col("t_stat") > 2))
    return evaluation.withColumn("validated", F.coalesce(rule, F.lit(False)))


# --- Journal ------------------------------------------------------------------------------


def new_predictions(scored: DataFrame, stored: DataFrame) -> DataFrame:
    """The newest date's predictions not stored yet, once per (model, company, date)."""
    newest = scored.agg(F.max("as_of").alias("as_of"))
    latest = scored.join(F.broadcast(newest), "as_of", "left_semi")  # one row
    return latest.join(stored, ["model", "company", "as_of"], "left_anti")


def score_outcomes(predictions: DataFrame, outcomes: DataFrame, labels: DataFrame) -> DataFrame:
    """Realised results of predictions whose horizon has passed and that have no outcome yet."""
    pending = predictions.join(outcomes, ["model", "company", "as_of"], "left_anti")
    matured = pending.join(labels, ["company", "as_of"])
    up = (F.col("excess") > 0).cast("double")
    return matured.select(
        "model", "company", "as_of", "excess", (F.col("excess") > 0).alias("went_up"),
        F.pow(F.col("p") - up, 2).alias("brier"),
    )


def journal_summary(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    joined = predictions.join(outcomes.select("model", "company", "as_of", "went_up", "brier"), ["model", "company", "as_of"])
    up = F.col("went_up").cast("double")
    return joined.groupBy("model").agg(
        F.count(F.lit(1)).alias("scored"), F.avg("brier").alias("brier"),
        F.avg(((F.col("p") > 0.5) == F.col("went_up")).cast("double")).alias("hit_rate"),
        F.avg("p").alias("mean_probability"), F.avg(up).alias("observed_rate"),
    )


def history(predictions: DataFrame, outcomes: DataFrame, company: int, limit: int = 36) -> DataFrame:
    own = predictions.where(F.col("company") == company)
    kept = own.orderBy(F.desc("as_of"), "model").limit(limit)
    return kept.join(outcomes.select("model", "company", "as_of", "excess"), ["model", "company", "as_of"], "left")


def evaluated(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per model: the measures of its predictions with outcomes, and whether they pass the gate."""
    known = cut_lineage(predictions.join(outcomes.select("model", "company", "as_of", "excess"), ["model", "company", "as_of"]))
    return gate(classification(known, ["model"]).join(rank_ic(known, ["model"]), "model", "left"))


def latest_predictions(predictions: DataFrame, models: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Latest prediction per active model and company with its range, the model's gate and the company's realised history.

    `models`: model, status, validated (from the stored evaluation; null is not validated)."""
    kept = [c for c in predictions.columns if c not in ("model", "company")]
    newest = predictions.groupBy("model", "company").agg(F.max_by(F.struct(*kept), "as_of").alias("b"))
    active = models.where(F.col("status") == "active").select("model", F.coalesce("validated", F.lit(False)).alias("validated"))
    realised = predictions.select("model", "company", "as_of", "p").join(outcomes.select("model", "company", "as_of", "excess", "went_up"), ["model", "company", "as_of"])
    realised = realised.groupBy("model", "company").agg(
        F.count(F.lit(1)).alias("realised"), F.avg(((F.col("p") > 0.5) == F.col("went_up")).cast("double")).alias("hit_rate"),
        F.max_by("excess", "as_of").alias("last_excess"),
    )
    joined = newest.join(F.broadcast(active), "model").join(realised, ["model", "company"], "left")  # a row per active model
    return joined.select("model", "company", "b.*", "validated", F.coalesce("realised", F.lit(0)).alias("realised"), "hit_rate", "last_excess")


def retire_and_add(models: DataFrame, version: DataFrame) -> DataFrame:
    """The version table after storing a new version: older active ones of its name retire."""
    names = version.select("name").distinct().withColumn("_new", F.lit(True))
    old = models.join(F.broadcast(names), "name", "left").withColumn(
        "status", F.when(F.col("_new") & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    )
    return old.drop("_new").unionByName(version)

"""Point-in-time inputs: nothing that was public later changes what a day saw."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import markets, pit
from tidemark.sources.views import Tables


def test_metrics_of_a_day_ignore_later_filings(spark):
    facts = Tables(spark, "/root/testdata/sf0.001").filed_facts().cache()
    first, last = date(1996, 9, 30), date(1999, 3, 31)
    days = spark.createDataFrame([(first,), (last,)], "as_of date")
    closes = facts.select("company").distinct().crossJoin(days).select("company", "as_of", F.col("as_of").alias("trade_date"), F.lit(20.0).alias("close"))
    read = lambda found: sorted((r["company"], r["metric"], round(r["value"], 9), r["available"]) for r in found.where(F.col("as_of") == F.lit(first)).collect())
    whole = markets.metrics_asof(facts, closes, days)
    cut = markets.metrics_asof(facts.where(F.col("filed_date") <= F.lit(first)), closes, days)
    assert read(whole) == read(cut) and len(read(whole)) > 10
    assert whole.where(F.col("available") > F.col("as_of")).isEmpty()


def test_snapshots_refuse_inputs_that_were_not_public(spark):
    day = date(2020, 3, 31)
    price = spark.createDataFrame([(day, 1, 0.5, day)], "as_of date, company long, mom_1m double, price_used date")
    source = lambda used, name: spark.createDataFrame([(day, float("nan"), used)], f"as_of date, {name} double, {name}_used date")
    facts = source(day - timedelta(days=9), "fact").withColumn("company", F.lit(1).cast("long"))
    found = markets.feature_snapshots(price, facts, source(day, "macro"), source(None, "market")).first()
    assert found["data_available_on"] == day and found["mom_1m"] == 0.5 and found["fact"] is None
    with pytest.raises(Exception, match="macro"):
        markets.feature_snapshots(price, facts, source(day + timedelta(days=1), "macro"), source(day, "market")).collect()


@pytest.mark.parametrize("back", [1, 3])
def test_macro_back_follows_revisions_and_late_observations(spark, back):
    rng = random.Random(back)
    start, rows = date(2020, 1, 1), []
    for k in range(120):
        series, observed = rng.choice("ab"), start + timedelta(days=rng.randint(0, 300))
        shown = observed + timedelta(days=rng.choice([1, 5, 40, 200]))
        rows.append((series, observed, shown, shown, k, float(rng.randint(1, 9))))
    frame = spark.createDataFrame(rows, "series string, observation_date date, available_on date, realtime_start date, tie long, value double")
    days = [start + timedelta(days=30 * k) for k in range(1, 20)]
    found = pit.macro_back(frame, spark.createDataFrame([(d,) for d in days], "as_of date"), back).collect()
    expected = set()
    for day in days:
        for series in "ab":
            known = {}
            for _, observed, shown, real, tie, value in sorted((r for r in rows if r[0] == series and r[2] <= day), key=lambda r: (r[2], r[3], r[4])):
                known[observed] = value
            newest = [known[d] for d in sorted(known, reverse=True)]
            if newest:
                expected.add((day, series, newest[0], newest[back] if len(newest) > back else None))
    assert {(r["as_of"], r["series"], r["latest"], r["earlier"]) for r in found} == expected


def test_regimes_of_several_benchmarks(spark):
    rng, rows, expected = np.random.default_rng(5), [], {}
    for name, n, scale in (("x", 3000, 0.01), ("y", 700, 0.02)):
        moves = rng.normal(0.0003, scale, n) * np.where(np.arange(n) // 200 % 3 == 2, 3, 1)
        closes = 100 * np.exp(np.cumsum(moves))
        days = [date(2005, 1, 3) + timedelta(days=int(k * 7 // 5)) for k in range(n)]
        ret = [None] + [float(closes[k] / closes[k - 1] - 1) for k in range(1, n)]
        rows += [(name, days[k], float(closes[k]), ret[k], k + 1) for k in range(n)]
        vol = [np.std(ret[k - 20 : k + 1], ddof=1) * np.sqrt(252) if k >= 21 else None for k in range(n)]
        for k in range(259, n):
            if k + 1 == n or days[k + 1].month != days[k].month:
                past = [v for v in vol[max(0, k - 2499) : k + 1] if v is not None]
                expected[name, days[k]] = (closes[k] >= closes[k - 199 : k + 1].mean(), sum(v <= vol[k] for v in past) / len(past))
    frame = spark.createDataFrame(rows, "benchmark string, trade_date date, close double, ret double, n int")
    found = {(r["benchmark"], r["price_date"]): r for r in markets.regime(frame).collect()}
    assert found.keys() == expected.keys()
    for key, (up, share) in expected.items():
        assert found[key]["vol_percentile"] == pytest.approx(share, abs=2e-3)
        assert found[key]["label"].startswith("Uptrend" if up else "Downtrend")
    assert {r["label"].split(", ")[1] for r in found.values()} == {"calm", "stressed"}

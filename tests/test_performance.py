"""Sharpe statistics against the standard library's normal distribution."""

from __future__ import annotations

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidemark.operators import portfolio


def test_probabilistic_and_deflated_sharpe(spark):
    rows = [("a", 0.05, 0.2, 4.0, 500), ("b", -0.02, -1.0, 9.0, 60), ("c", 0.1, 0.0, 3.0, 2)]
    frame = spark.createDataFrame(rows, "strategy string, active_sharpe_daily double, active_skew double, active_kurtosis double, n long")
    limit = portfolio.expected_max_sharpe(F.lit(12), F.lit(0.0004))
    found = {r["strategy"]: r for r in frame.withColumn("limit", limit).select("strategy", "limit", portfolio.probabilistic_sharpe().alias("psr"), portfolio.probabilistic_sharpe(F.col("limit")).alias("dsr")).collect()}
    norm, gamma = NormalDist(), 0.5772156649015329
    best = math.sqrt(0.0004) * ((1 - gamma) * norm.inv_cdf(1 - 1 / 12) + gamma * norm.inv_cdf(1 - 1 / (12 * math.e)))
    for name, s, skew, kurtosis, n in rows:
        assert found[name]["limit"] == pytest.approx(best, abs=1e-7)
        for column, least in (("psr", 0.0), ("dsr", best)):
            spread = 1 - skew * s + (kurtosis - 1) / 4 * s * s
            expected = norm.cdf((s - least) * math.sqrt(n - 1) / math.sqrt(spread)) if n >= 3 else None
            assert found[name][column] == (None if expected is None else pytest.approx(expected, abs=1e-6))


def test_one_trial_deflates_nothing(spark):
    row = spark.range(1).select(
        portfolio.expected_max_sharpe(F.lit(1), F.lit(0.01)).alias("one"), portfolio.expected_max_sharpe(F.lit(9), F.lit(0.0)).alias("same")
    ).first()
    assert row["one"] == 0.0 and row["same"] == 0.0

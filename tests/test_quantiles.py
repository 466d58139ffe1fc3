"""Quantiles by refined histograms against ``percentile``."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import quantiles as Q

PROBS = [0.0, 0.125, 0.25, 0.5, 0.75, 0.875, 0.999, 1.0]


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(Q, "BUCKETS", 8)
    monkeypatch.setattr(Q, "FEW", 5)


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.standard_normal(900), "tails": rng.standard_cauchy(700) ** 5, "ties": rng.integers(0, 4, 600).astype(float), "one": np.array([2.5]), "two": np.array([1.0, 4.0]),
        "wide": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1.0]), "ends": np.array([float("inf"), float("-inf"), float("nan"), 3.0, 4.0, float("nan")]), "same": np.full(50, 7.0),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [(None, 1.0), (None, 2.0), ("normal", None), ("none", None)]
    df = spark.createDataFrame(rows, "key string, x double").repartition(5)
    got = {r.key: list(r.quantiles) for r in Q.quantiles(df, "x", ["key"], PROBS).collect()}
    want = {r.key: list(r.q) for r in df.where("x is not null").groupBy("key").agg(F.percentile("x", F.array(*map(F.lit, PROBS))).alias("q")).collect()}
    assert got.keys() == want.keys()
    for key, q in want.items():
        for a, b in zip(got[key], q, strict=True):
            assert a == b or (math.isnan(a) and math.isnan(b)), (key, got[key], q)

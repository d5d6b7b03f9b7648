"""Percentiles: multi-select against sorting, day states, the bound of the error."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import quantiles

PROBS = [0.0, 0.1, 0.5, 0.9, 1.0]
CLASH = ["key", "value", "n", "day", "kid", "rid", "lo", "hi", "pivot", "wanted"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    return [("hot", float(x)) for x in rng.standard_cauchy(3000)] + [("ties", float(x)) for x in rng.integers(0, 90, 800)] + [("same", 2.5)] * 300 + [("one", 5.0), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 0.0), ("nan", float("nan")), ("null", None), (None, 3.0), (None, 4.0)] + [("low", float("-inf"))] * 40 + [("low", 1.0)] * 20


@pytest.fixture(scope="module")
def df(spark, rows):
    made = spark.createDataFrame(rows, "state_key string, v double").repartition(5).withColumn("event_time", F.timestamp_seconds(F.rand(1) * 400_000))
    return made.withColumns({c: F.lit("x") for c in CLASH})


@pytest.mark.parametrize(("small", "eps"), [(16, 0.0), (1, 0.0), (4096, 0.0), (16, 0.01)])
def test_multi_select_against_sorting(df, rows, small, eps):
    values = defaultdict(list)
    for k, v in rows:
        if v is not None and not math.isnan(v):
            values[k].append(v)
    got = {(r["key"], r["p"]): r for r in quantiles.percentiles(df, "v", PROBS, small=small, eps=eps).collect()}
    assert set(got) == {(k, p) for k in values for p in PROBS}
    for (k, p), r in got.items():
        vs = sorted(values[k])
        want = vs[max(1, math.ceil(p * len(vs))) - 1]
        assert r["n"] == len(vs) and (r["value"] == want or (eps > 0 and abs(r["value"] - want) <= eps * abs(want) + 1e-12)), (k, p)


def test_chunks_propose_local_medians(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "CHUNK", 64)
    state = spark.range(5000).select((F.col("id") % 3).alias("key"), (F.col("id") * 7919 % 5000).cast("double").alias("value"), F.lit(2).cast("long").alias("n"))
    for r in quantiles.multi_select(state, [0.25, 0.5], small=8).collect():
        vs = sorted(float(i * 7919 % 5000) for i in range(5000) if i % 3 == r["key"])
        assert r["n"] == 2 * len(vs) and r["value"] == vs[max(1, math.ceil(math.ceil(r["p"] * 2 * len(vs)) / 2)) - 1]


def test_days_combine_in_any_order(df):
    days = quantiles.day_states(df, "v", eps=0.001)
    parts = [days.where(F.coalesce(F.col("day"), F.lit(0)) % 2 == i) for i in (1, 0)]
    assert sorted(map(str, quantiles.combine_days(parts[0].unionByName(parts[1])).collect())) == sorted(map(str, quantiles.combine_days(days).collect()))


def test_no_rows(df):
    assert quantiles.percentiles(df.limit(0), "v", PROBS).count() == 0
    assert quantiles.percentiles(df.withColumn("v", F.lit(None).cast("double")), "v", PROBS).count() == 0
    assert quantiles.percentiles(df, "v", []).count() == 0


def test_more_ranges_than_are_broadcast(df, monkeypatch):
    want = sorted(map(str, quantiles.percentiles(df, "v", PROBS, small=64).collect()))
    monkeypatch.setattr(quantiles, "FEW", 0)
    monkeypatch.setattr(quantiles, "SHRINK", 1)
    assert sorted(map(str, quantiles.percentiles(df, "v", PROBS, small=64).collect())) == want

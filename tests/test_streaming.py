"""Streams give what batches give; states expire; queries restart."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.estimators import LinearKalmanFilter, LinearKalmanSmoother, PoissonMixture, RecursiveLeastSquaresFilter
from driftwell.streaming import drain, folder_stream, rate_readings, to_console, to_folder

START = datetime(2020, 1, 1)
SCHEMA = "k string, i long, measurement array<double>, label double, features array<double>, sample long, ts timestamp"


def rows(n, keys="ab", seed=1, offset=0):
    rng = np.random.default_rng(seed)
    return [(k, i, [float(i + rng.normal())], float(2 * i + rng.normal()), [1.0, float(i)], int(rng.poisson(5)), START + timedelta(minutes=i)) for i in range(offset, offset + n) for k in keys]


def put(spark, folder, data, name):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


@pytest.mark.parametrize("make", [
    lambda: LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts", processNoise=[[0.1]], calculateLoglikelihood=True, multiStepPredict=1),
    lambda: RecursiveLeastSquaresFilter(stateKeyCol="k", eventTimeCol="ts"),
    lambda: LinearKalmanSmoother(stateKeyCol="k", eventTimeCol="ts", fixedLag=3),
    lambda: PoissonMixture(stateKeyCol="k", eventTimeCol="ts", initialRates=[2.0, 8.0], minibatchSize=4),
])
def test_stream_equals_batch(spark, tmp_path, make):
    data = rows(30)
    folder = f"{tmp_path}/in"
    for part in range(3):
        spark.createDataFrame([r for r in data if r[1] // 10 == part], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    batch = make().transform(spark.createDataFrame(data, SCHEMA))
    out = drain(make().transform(folder_stream(spark, folder, SCHEMA)), f"{tmp_path}/cp")
    flat = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    a, b = flat(batch), flat(out)
    assert len(a) == len(b) and a == b


def test_restart_from_checkpoint(spark, tmp_path):
    est = LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts")
    folder, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    spark.createDataFrame(rows(10), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    to_folder(est.transform(folder_stream(spark, folder, SCHEMA)), out, cp).awaitTermination()
    spark.createDataFrame(rows(5, offset=10), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    to_folder(est.transform(folder_stream(spark, folder, SCHEMA)), out, cp).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 30 and got.agg(F.max("stateIndex")).first()[0] == 15


def test_event_timeout_drops_states(spark, tmp_path):
    folder = f"{tmp_path}/in"
    first = rows(5, keys="a")
    later = [("b", 0, [1.0], 1.0, [1.0, 1.0], 1, START + timedelta(days=1)), ("b", 1, [1.0], 1.0, [1.0, 1.0], 1, START + timedelta(days=2))]
    again = [("a", 9, [1.0], 1.0, [1.0, 1.0], 1, START + timedelta(days=3))]
    for part in (first, later[:1], later[1:], again):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    est = LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts", watermarkDuration="1 minute").setStateTimeoutMode("event").setStateTimeoutDuration("10 minutes")
    out = drain(est.transform(folder_stream(spark, folder, SCHEMA)), f"{tmp_path}/cp")
    assert [r["stateIndex"] for r in out.where("k = 'a'").orderBy("ts").collect()] == [1, 2, 3, 4, 5, 1]


def test_stream_starts_from_a_batch_snapshot(spark, tmp_path):
    data = rows(20)
    folder = f"{tmp_path}/in"
    spark.createDataFrame([r for r in data if r[1] >= 10], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    make = lambda **more: LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts", **more)
    whole = {(r["k"], r["ts"]): r["state"] for r in make().transform(spark.createDataFrame(data, SCHEMA)).collect()}
    snapshot = make().transform(spark.createDataFrame([r for r in data if r[1] < 10], SCHEMA)).groupBy("k").agg(F.max_by("state", "stateIndex").alias("initial"))
    stream = folder_stream(spark, folder, SCHEMA).join(snapshot, "k")
    out = drain(make(initialStateDistributionCol="initial").transform(stream), f"{tmp_path}/cp").collect()
    assert len(out) == 20 and all(r["state"] == whole[r["k"], r["ts"]] for r in out)


def test_averaging_over_models_in_a_stream(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for part in range(3):
        spark.createDataFrame(rows(10, keys="abc", offset=10 * part), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    est = LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts", watermarkDuration="1 minute", stateSize=1, calculateSlidingLikelihood=True).setMultipleModelAdaptiveEstimationEnabled().setMultipleModelMeasurementWindowDuration("1 minute")
    out = drain(est.transform(folder_stream(spark, folder, SCHEMA)), f"{tmp_path}/cp")
    assert out.count() >= 18 and {"ts", "stateIndex", "state"} == set(out.columns)


def test_rate_source(spark):
    assert rate_readings(spark, 3, 5).isStreaming


def test_late_rows_correct_periods_of_a_stream(spark, tmp_path):
    from driftwell.operators import late
    from driftwell.streaming import PeriodStream

    rng = np.random.default_rng(12)
    data = []
    for i in range(300):
        arrival = START + timedelta(minutes=int(3 * i))
        event = arrival - timedelta(minutes=int(rng.choice([0, 2, 30, 110, 119, 121, 400])))
        data.append((i, ["a", "b", None][i % 3], event if i % 17 else None, arrival, float(rng.integers(0, 9)) if i % 11 else None))
    kind = "record_id long, state_key string, event_time timestamp, arrival_time timestamp, v double"
    folder = f"{tmp_path}/in"
    for part in range(4):
        spark.createDataFrame(data[75 * part : 75 * part + 75], kind).coalesce(1).write.mode("append").parquet(folder)
    stream = PeriodStream(f"{tmp_path}/out", F.col("v"))
    stream.start(folder_stream(spark, folder, kind), f"{tmp_path}/cp").awaitTermination()
    marked = late.with_frontier(spark.createDataFrame(data, kind))
    want = late.period_stats(late.multiset(marked, F.col("v")))
    assert sorted(map(str, stream.stats(spark).collect())) == sorted(map(str, want.collect()))
    lost = {r["record_id"] for r in marked.where("is_late").collect()}
    assert lost and {r["record_id"] for r in stream.left_out(spark).collect()} == lost
    # A batch that is run again replaces what it wrote.
    stream.take(spark.createDataFrame(data[225:], kind), 3)
    assert sorted(map(str, stream.stats(spark).collect())) == sorted(map(str, want.collect()))


def test_processing_timeout_drops_states(spark, tmp_path):
    import time

    est = LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts").setStateTimeoutMode("process").setStateTimeoutDuration("1 second")
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(rows(3, keys="a"), SCHEMA).coalesce(1).write.parquet(folder)
    query = to_folder(est.transform(folder_stream(spark, folder, SCHEMA)), out, f"{tmp_path}/cp", every="200 milliseconds")

    def wait_for(n):
        until = time.time() + 40
        while time.time() < until and query.exception() is None:
            try:
                if spark.read.schema("k string, stateIndex long, ts timestamp").parquet(out).count() >= n:
                    return
            except Exception:  # noqa: BLE001 - nothing written yet
                pass
            time.sleep(0.3)

    try:
        wait_for(3)
        time.sleep(4)  # a later batch finds the state expired
        spark.createDataFrame(rows(1, keys="a", offset=9), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        wait_for(4)
    finally:
        query.stop()
    assert [r["stateIndex"] for r in spark.read.parquet(out).orderBy("ts").collect()] == [1, 2, 3, 1]


def test_console_sink_appends(spark, tmp_path):
    folder = f"{tmp_path}/in"
    spark.createDataFrame(rows(4), SCHEMA).coalesce(1).write.parquet(folder)
    query = to_console(LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts").transform(folder_stream(spark, folder, SCHEMA)))
    query.processAllAvailable()
    assert query.exception() is None and query.lastProgress["numInputRows"] == 8
    query.stop()

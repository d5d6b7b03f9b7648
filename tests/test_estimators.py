"""Estimators against closed forms, numpy recurrences and parameter recovery."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import functions as F

from driftwell.estimators import (
    BernoulliMixture,
    CubatureKalmanFilter,
    ExtendedKalmanFilter,
    LeastMeanSquaresFilter,
    LinearKalmanFilter,
    LinearKalmanSmoother,
    MultivariateGaussianMixture,
    PoissonMixture,
    RecursiveLeastSquaresFilter,
    UnscentedKalmanFilter,
)

START = datetime(2010, 1, 1)


def regression(seed, n=40, link=lambda v: v, keys=("a",)):
    rng = np.random.default_rng(seed)
    rows, xs = [], []
    for k in keys:
        for i in range(n):
            x = [float(i), float(np.sqrt(i)), 1.0]
            z = link(0.5 * x[0] - 0.7 * x[1] + 2.0) + rng.normal()
            rows.append((k, z, x, START + timedelta(minutes=i)))
            xs.append((x, z))
    return rows, xs


def frame(spark, rows):
    df = spark.createDataFrame(rows, "k string, z double, x array<double>, ts timestamp")
    return df.withColumn("measurement", F.array("z")).withColumn("H", F.array("x")).withColumn("label", F.col("z")).withColumn("features", F.col("x"))


def last(df, key="k"):
    return {r[key]: r for r in df.groupBy(key).agg(F.max_by(F.struct("*"), "stateIndex").alias("r")).select("r.*").collect()}


@pytest.mark.parametrize("cls", [LinearKalmanFilter, ExtendedKalmanFilter, UnscentedKalmanFilter, CubatureKalmanFilter])
def test_filters_reach_least_squares(spark, cls):
    rows, xs = regression(1, keys=("a", "b", "c"))
    f = cls(stateKeyCol="k", eventTimeCol="ts", measurementModelCol="H", stateSize=3).setInitialStateCovariance(np.eye(3) * 10).setProcessModel(np.eye(3)).setProcessNoise(np.zeros((3, 3))).setMeasurementNoise([[1e-4]])
    got = last(f.transform(frame(spark, rows)))
    for i, k in enumerate("abc"):
        part = xs[40 * i : 40 * (i + 1)]
        want = np.linalg.lstsq(np.array([x for x, _ in part]), np.array([z for _, z in part]), rcond=None)[0]
        assert np.abs(np.array(got[k]["state"]["mean"]) - want).mean() < 1e-2
        assert got[k]["stateIndex"] == 40


def test_linear_filter_matches_plain_recurrence_with_nulls_control_and_fading(spark):
    rng = np.random.default_rng(3)
    n, f, q, r, h = 60, np.array([[1.0, 1.0], [0.0, 1.0]]), np.eye(2) * 0.01, 2.0, np.array([[1.0, 0.0]])
    z = [None if i % 7 == 3 else [float(i + rng.normal())] for i in range(n)]
    u, b = [[0.1 * i] for i in range(n)], [[1.0], [0.5]]
    rows = [(i, z[i], u[i], b, START + timedelta(minutes=i)) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, measurement array<double>, u array<double>, b array<array<double>>, ts timestamp").orderBy(F.rand(1))
    est = LinearKalmanFilter(eventTimeCol="ts", fadingFactor=1.1, processModel=f, processNoise=q, measurementNoise=[[r]], measurementModel=h, controlCol="u", controlFunctionCol="b", initialStateCovariance=np.eye(2) * 1000, calculateLoglikelihood=True, calculateMahalanobis=True, calculateSlidingLikelihood=True, slidingLikelihoodWindow=3, multiStepPredict=2, outputSystemMatrices=True)
    got = {(x["stateIndex"] - x["stepIndex"], x["stepIndex"]): x for x in est.transform(df).collect()}
    x, p, lls = np.zeros(2), np.eye(2) * 1000, []
    for i in range(n):
        x, p = f @ x + np.array(b) @ np.array(u[i]), 1.21 * f @ p @ f.T + q
        ll = None
        if z[i] is not None:
            res, s = z[i] - h @ x, h @ p @ h.T + r
            k = p @ h.T / s
            x, p = x + (k @ res), (np.eye(2) - k @ h) @ p @ (np.eye(2) - k @ h).T + k * r @ k.T
            ll = -0.5 * (np.log(2 * np.pi * s[0, 0]) + res[0] ** 2 / s[0, 0])
            lls = (lls + [ll])[-3:]
        row = got[(i + 1, 0)]
        assert np.allclose(row["state"]["mean"], x) and np.allclose(row["state"]["covariance"]["values"], p.ravel("F"))
        assert (row["loglikelihood"] is None) == (ll is None) and (row["residual"] is None) == (ll is None)
        if ll is not None:
            assert np.isclose(row["loglikelihood"], ll) and np.isclose(row["mahalanobis"], abs(res[0]) / np.sqrt(s[0, 0]))
        assert np.isclose(row["slidingLikelihood"], np.exp(sum(lls)))
        ahead = f @ x + np.array(b) @ np.array(u[i])
        assert np.allclose(got[(i + 1, 1)]["state"]["mean"], ahead)
        assert got[(i + 1, 2)]["stateIndex"] == i + 3 and row["processModel"]["values"] == [1.0, 0.0, 1.0, 1.0]


def test_unscented_and_cubature_equal_linear_on_linear_models(spark):
    rows, _ = regression(4)
    base = {"eventTimeCol": "ts", "measurementModelCol": "H", "stateSize": 3, "processNoise": np.eye(3) * 0.01, "measurementNoise": [[1.0]], "calculateLoglikelihood": True}
    want = [r["loglikelihood"] for r in LinearKalmanFilter(**base).transform(frame(spark, rows)).orderBy("stateIndex").collect()]
    for cls, extra in ((UnscentedKalmanFilter, {}), (UnscentedKalmanFilter, {"sigmaPoints": "julier"}), (CubatureKalmanFilter, {})):
        got = [r["loglikelihood"] for r in cls(**base, **extra).transform(frame(spark, rows)).orderBy("stateIndex").collect()]
        assert np.allclose(got, want, atol=1e-6)


def test_extended_filter_follows_its_recurrence_and_recovers_log_link(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        x, y = rng.uniform(0, 3), rng.uniform(0, 2)
        rows.append(("a", float(np.exp(0.5 * x - 0.7 * y + 2) + rng.normal()), [float(x), float(y), 1.0], START + timedelta(minutes=i)))
    f = ExtendedKalmanFilter(stateKeyCol="k", eventTimeCol="ts", measurementModelCol="H", stateSize=3, initialStateMean=[0.4, -0.5, 1.8], initialStateCovariance=np.eye(3) * 0.05, processNoise=np.zeros((3, 3)), measurementNoise=[[1.0]])
    f.setMeasurementFunction(lambda x, h: np.exp(h @ x)).setMeasurementStateJacobian(lambda x, h: np.exp(h @ x)[:, None] * h)
    mean = last(f.transform(frame(spark, rows)))["a"]["state"]["mean"]
    x, p = np.array([0.4, -0.5, 1.8]), np.eye(3) * 0.05
    for _, z, h, _ in rows:
        h = np.array([h])
        seen = np.exp(h @ x)
        j = seen[:, None] * h
        k = p @ j.T / (j @ p @ j.T + 1.0)
        x, p = x + k @ (z - seen), (np.eye(3) - k @ j) @ p @ (np.eye(3) - k @ j).T + k @ k.T
    assert np.allclose(mean, x, atol=1e-8)
    assert np.abs(np.array(mean) - [0.5, -0.7, 2.0]).mean() < 0.05


def test_extended_noise_jacobian_and_bounds_and_adaptive_noise(spark):
    rows = [("a", float(np.sin(i / 3) * 5), [1.0, 0.8], START + timedelta(minutes=i)) for i in range(30)]
    df = frame(spark, rows)
    j = np.array([[1.0], [0.8]])
    e = ExtendedKalmanFilter(eventTimeCol="ts", measurementModelCol="H", stateSize=2, processNoise=[[0.5]], measurementNoise=[[0.1]])
    e.setProcessNoiseJacobian(lambda x, q: j)
    plain = LinearKalmanFilter(eventTimeCol="ts", measurementModelCol="H", stateSize=2, processNoise=0.5 * j @ j.T, measurementNoise=[[0.1]])
    for a, b in zip(e.transform(df).orderBy("stateIndex").collect(), plain.transform(df).orderBy("stateIndex").collect(), strict=True):
        assert np.allclose(a["state"]["mean"], b["state"]["mean"])
    bounded = UnscentedKalmanFilter(eventTimeCol="ts", measurementModelCol="H", stateSize=2, processNoise=np.eye(2) * 1e-5, measurementNoise=[[0.1]], stateLowerBound=[-1.0, -1.0], stateUpperBound=[1.0, 1.0])
    points = bounded.core().points(np.array([[0.5, -3.0]]), np.eye(2)[None] * 9)[0]
    assert points[0].tolist() == [0.5, -3.0] and np.abs(points[1:]).max() <= 1.0 and bounded.transform(df).count() == 30
    quiet = UnscentedKalmanFilter(eventTimeCol="ts", measurementModelCol="H", stateSize=2, processNoise=np.eye(2) * 1e-5, measurementNoise=[[0.01]])
    apart = lambda f: np.abs([r["state"]["mean"][0] + 0.8 * r["state"]["mean"][1] - z for r, (_, z, _, _) in zip(f.transform(df).orderBy("stateIndex").collect(), rows, strict=True)]).mean()
    assert apart(quiet.copy().setAdaptiveProcessNoise(True)) < apart(quiet)


def test_rls_golden_rows_and_lms(spark):
    data = [(1.0, [0.0, 5.0]), (0.0, [1.0, 2.0]), (1.0, [2.0, 1.0]), (0.0, [3.0, 3.0])]
    rows = [("a", y, x, START + timedelta(minutes=i)) for i, (y, x) in enumerate(data)]
    got = last(RecursiveLeastSquaresFilter(stateKeyCol="k", eventTimeCol="ts", regularizationMatrixFactor=10e6, featureSize=2).transform(frame(spark, rows)))["a"]
    assert np.allclose(got["state"]["mean"], [5.31071176e-09, 1.53846148e-01], atol=1e-6) and got["stateIndex"] == 4
    rows, xs = regression(6, n=100)
    want = np.linalg.lstsq(np.array([x for x, _ in xs]), np.array([z for _, z in xs]), rcond=None)[0]
    assert np.abs(np.array(last(RecursiveLeastSquaresFilter(stateKeyCol="k", eventTimeCol="ts", regularizationMatrixFactor=1e6).transform(frame(spark, rows)))["a"]["state"]["mean"]) - want).mean() < 1e-4
    got = last(LeastMeanSquaresFilter(stateKeyCol="k", eventTimeCol="ts").transform(frame(spark, rows)))["a"]["state"]
    w = np.zeros(3)
    for x, z in xs:
        x = np.array(x)
        w = w + x / (1 + x @ x) * (z - x @ w)
    assert np.allclose(got, w)


def test_smoother_over_all_rows_equals_plain_pass(spark):
    rng = np.random.default_rng(7)
    n, f, q, h = 30, np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[0.7, 0.1], [0.1, 0.18]]), np.array([[1.0, 0.0]])
    z = np.arange(n) + rng.normal(size=n)
    df = spark.createDataFrame([(float(v), START + timedelta(minutes=i)) for i, v in enumerate(z)], "measurement double, ts timestamp")
    s = LinearKalmanSmoother(eventTimeCol="ts", processModel=f, processNoise=q, measurementModel=h, measurementNoise=[[20.0]], fixedLag=n)
    got = {r["stateIndex"]: r for r in s.transform(df).collect()}
    xs, ps = [], []
    x, p = np.zeros(2), np.eye(2)
    for v in z:
        x, p = f @ x, f @ p @ f.T + q
        s2 = (h @ p @ h.T)[0, 0] + 20.0
        k = (p @ h.T)[:, 0] / s2
        a = np.eye(2) - np.outer(k, h[0])
        x, p = x + k * (v - x[0]), a @ p @ a.T + 20.0 * np.outer(k, k)
        xs.append(x)
        ps.append(p)
    sx, sp = xs[-1], ps[-1]
    for i in range(n - 2, -1, -1):
        ahead = f @ ps[i] @ f.T + q
        g = ps[i] @ f.T @ np.linalg.inv(ahead)
        sx, sp = xs[i] + g @ (sx - f @ xs[i]), ps[i] + g @ (sp - ahead) @ g.T
        assert np.allclose(got[i + 1]["state"]["mean"], sx) and np.allclose(got[i + 1]["state"]["covariance"]["values"], sp.ravel("F"))
    lagged = LinearKalmanSmoother(eventTimeCol="ts", processModel=f, processNoise=q, measurementModel=h, measurementNoise=[[20.0]], fixedLag=3).transform(df)
    assert lagged.count() == 3 * (n - 2) and lagged.where("stepIndex = 0").where("rtsGain.values[0] <> 0").count() == 0


def test_multiple_models_are_averaged_by_likelihood(spark):
    rows, xs = regression(8, keys=tuple("abcdef"))
    f = LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts", measurementModelCol="H", stateSize=3, initialStateCovariance=np.eye(3) * 10, processNoise=np.zeros((3, 3)), measurementNoise=[[1.0]], calculateSlidingLikelihood=True, slidingLikelihoodWindow=5)
    states = f.transform(frame(spark, rows)).where("stateIndex = 40").collect()
    w = np.array([r["slidingLikelihood"] for r in states])
    want = (w[:, None] * np.array([r["state"]["mean"] for r in states])).sum(axis=0) / w.sum()
    f.setEnableMultipleModelAdaptiveEstimation()
    got = f.transform(frame(spark, rows)).where("stateIndex = 40").collect()
    assert len(got) == 1 and np.allclose(got[0]["state"]["mean"], want)
    f.setMultipleModelMeasurementWindowDuration("10 minutes")
    assert f.transform(frame(spark, rows)).count() == 40


def test_mixtures_recover_parameters(spark):
    rng = np.random.default_rng(9)
    means = np.array([[10.0, 2.0], [1.0, 4.0], [5.0, 3.0]])
    comp = rng.choice(3, 5000, p=[0.2, 0.3, 0.5])
    xs = means[comp] + rng.normal(size=(5000, 2))
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(xs)], "i int, sample array<double>")
    g = MultivariateGaussianMixture(orderCol="i", initialMeans=[[9.0, 3.0], [0.0, 3.0], [6.0, 2.0]], initialWeights=[1 / 3] * 3, stepSize=0.7, minibatchSize=500, decayRate=0.85)
    out = g.transform(df)
    m = out.orderBy(F.desc("stateIndex")).first()["mixtureModel"]
    assert out.count() == 10
    assert np.abs(np.array(m["weights"]) - [0.2, 0.3, 0.5]).mean() < 0.1
    assert np.abs(np.array([d["mean"] for d in m["distributions"]]) - means).mean() < 0.5
    pois = np.concatenate([rng.poisson(5, 100), rng.poisson(10, 700), rng.poisson(30, 200)])
    rng.shuffle(pois)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(pois)], "i int, sample long")
    p = PoissonMixture(orderCol="i", initialRates=[1.0, 7.0, 20.0], stepSize=1.0).setEnableBatchEM().setBatchTrainMaxIter(30).setBatchTrainTol(0.01)
    m = p.transform(df).first()["mixtureModel"]
    assert abs(m["distributions"][2]["rate"] - 30) < 2 and abs(m["weights"][2] - 0.2) < 0.05
    bern = rng.random(3000) < np.where(rng.random(3000) < 0.4, 0.7, 0.9)
    df = spark.createDataFrame([(i, bool(v)) for i, v in enumerate(bern)], "i int, sample boolean")
    b = BernoulliMixture(orderCol="i", initialProbabilities=[0.7, 0.9], initialWeights=[0.5, 0.5], stepSize=0.1, minibatchSize=30, updateHoldout=1)
    m = b.transform(df).orderBy(F.desc("stateIndex")).first()["mixtureModel"]
    mean = sum(w * d["probability"] for w, d in zip(m["weights"], m["distributions"], strict=True))
    assert abs(mean - bern[-600:].mean()) < 0.08


def test_initial_mixture_column_resumes(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(rng.poisson(4, 40))], "i int, sample long")
    p = PoissonMixture(orderCol="i", initialRates=[2.0, 8.0], minibatchSize=5, stepSize=0.3)
    first = p.transform(df).orderBy("stateIndex").first()
    resumed = PoissonMixture(orderCol="i", initialMixtureModelCol="m", minibatchSize=5, stepSize=0.3).transform(df.withColumn("m", F.struct(F.array(F.lit(0.5), F.lit(0.5)).alias("weights"), F.array(F.struct(F.lit(2.0).alias("rate")), F.struct(F.lit(8.0).alias("rate"))).alias("distributions"))))
    assert resumed.orderBy("stateIndex").first()["mixtureModel"] == first["mixtureModel"]


def test_long_keys_carry_their_state_over_chunks(spark):
    from driftwell import runtime

    rows, _ = regression(11, n=250, keys=("a", "b"))
    f = LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts", measurementModelCol="H", stateSize=3)
    df = frame(spark, rows)
    whole = {(r["k"], r["stateIndex"]): r["state"]["mean"] for r in f.transform(df).collect()}
    cols = f.inputs(df)
    small = runtime.batch(df.select(F.col("k").alias(runtime.KEY), F.col("ts").alias(runtime.TIME), *(c.alias(n) for n, c in cols.items())), f.model(), chunk=60).collect()
    assert len(small) == 500 and all(np.allclose(whole[(r[runtime.KEY], r["stateIndex"])], r["state"]["mean"]) for r in small)


def test_mixed_sizes_nulls_and_empty_tables(spark):
    rows = [("one", [1.0]), ("two", [1.0, 2.0]), ("two", [3.0, None]), (None, [2.0]), ("none", None), ("empty", [])]
    df = spark.createDataFrame(rows, "k string, measurement array<double>")
    out = LinearKalmanFilter(stateKeyCol="k").transform(df)
    assert out.count() == len(rows)
    assert LinearKalmanFilter(stateKeyCol="k").transform(df.limit(0)).count() == 0


def test_ml_types_in_and_out(spark):
    rows = [(Vectors.dense([float(i)]), DenseMatrix(1, 2, [1.0, float(i)]), float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, ["measurement", "H", "label"]).withColumn("features", F.col("measurement"))
    f = LinearKalmanFilter(measurementModelCol="H", stateSize=2, outputFormat="udt", orderCol="label")
    r = f.transform(df).orderBy(F.desc("stateIndex")).first()
    assert r["state"]["mean"].size == 2 and r["state"]["covariance"].numRows == 2
    assert RecursiveLeastSquaresFilter(outputFormat="udt").transform(df).first()["state"]["mean"].size == 1


def test_persistence(spark, tmp_path):
    f = UnscentedKalmanFilter(stateKeyCol="k", processNoise=np.eye(2), sigmaPoints="julier").setMeasurementFunction(lambda x, h: h @ x)
    f.write().overwrite().save(f"{tmp_path}/f")
    f.write().overwrite().save(f"{tmp_path}/f")
    g = UnscentedKalmanFilter.load(f"{tmp_path}/f")
    assert g.uid == f.uid and g.getProcessNoise() == f.getProcessNoise() and g.getSigmaPoints() == "julier" and g.getStateKeyCol() == "k"
    assert g.getMeasurementFunction()(np.ones(2), np.eye(2)).tolist() == [1.0, 1.0]
    with pytest.raises(Exception):  # noqa: B017 - the folder exists
        f.save(f"{tmp_path}/f")


def test_wrong_parameters_are_refused(spark):
    df = spark.createDataFrame([("a", [1.0], "t")], "k string, measurement array<double>, ts string")
    with pytest.raises(ValueError):
        LinearKalmanFilter(eventTimeCol="ts").transform(df)
    with pytest.raises(ValueError):
        LinearKalmanFilter(watermarkDuration="1 minute").transform(df)
    with pytest.raises(ValueError):
        LinearKalmanFilter(measurementCol="nope").transform(df)
    with pytest.raises((ValueError, TypeError)):
        RecursiveLeastSquaresFilter(forgettingFactor=1.5)
    with pytest.raises((ValueError, TypeError)):
        LinearKalmanFilter(fadingFactor=0.5)
    with pytest.raises(ValueError):
        PoissonMixture().transform(df.withColumn("sample", F.lit(1)))


def test_one_key_without_finite_numbers_leaves_the_others_alone(spark):
    rows = [(k, i, [float(i), 1.0] if k == "good" or i != 2 else [float("inf"), 1e308]) for k in ("good", "bad") for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i int, measurement array<double>")
    for cls in (LinearKalmanFilter, UnscentedKalmanFilter, CubatureKalmanFilter):
        out = cls(stateKeyCol="k", orderCol="i", stateSize=2, calculateMahalanobis=True).transform(df)
        assert out.count() == 10 and all(np.isfinite(r["state"]["mean"]).all() for r in out.where("k = 'good'").collect())


def test_resuming_from_a_snapshot_gives_the_same_states(spark):
    rows, _ = regression(12, n=40, keys=("a", "b"))
    df = frame(spark, rows)
    make = lambda **more: LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts", measurementModelCol="H", stateSize=3, measurementNoise=[[1.0]], **more)
    whole = {(r["k"], r["ts"]): r["state"] for r in make().transform(df).collect()}
    cut = START + timedelta(minutes=19)
    snapshot = make().transform(df.where(F.col("ts") <= cut)).groupBy("k").agg(F.max_by("state", "stateIndex").alias("initial"))
    rest = make(initialStateDistributionCol="initial").transform(df.where(F.col("ts") > cut).join(snapshot, "k")).collect()
    assert len(rest) == 40 and all(r["state"] == whole[r["k"], r["ts"]] for r in rest)


def test_schema_follows_the_parameters(spark):
    df = spark.createDataFrame([("a", [1.0], START)], "k string, measurement array<double>, ts timestamp")
    f = LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts")
    assert f.transformSchema(df.schema).fieldNames() == ["k", "stateIndex", "stepIndex", "state", "ts"]
    f.setCalculateLoglikelihood().setOutputSystemMatrices()
    assert f.transformSchema(df.schema) == f.transform(df).schema
    assert f.transformSchema(df.schema).fieldNames() == ["k", "stateIndex", "stepIndex", "state", "residual", "loglikelihood", "processModel", "processNoise", "measurement", "measurementModel", "ts"]


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_chunks_of_a_key_filter_as_the_whole_key(spark, size):
    rng = np.random.default_rng(13)
    rows = []
    for k, n in (("a", 150), ("b", 41), (None, 20), ("n", 3)):
        for i in range(n):
            z = None if i % 6 == 4 else [float(i + rng.normal())]
            rows.append((k, i, z, [float(rng.normal())], [[0.3], [0.1]], None if i % 9 == 5 else START + timedelta(hours=i), [5.0 if k == "b" else 0.0, 1.0]))
    df = spark.createDataFrame(rows, "k string, i int, measurement array<double>, u array<double>, b array<array<double>>, ts timestamp, m0 array<double>")
    f = LinearKalmanFilter(stateKeyCol="k", eventTimeCol="ts", orderCol="i", stateSize=2, processModel=[[1.0, 1.0], [0.0, 1.0]], measurementModel=[[1.0, 0.0]], processNoise=[[0.1, 0.02], [0.02, 0.05]], measurementNoise=[[2.0]], controlCol="u", controlFunctionCol="b", initialStateMeanCol="m0", calculateLoglikelihood=True, multiStepPredict=1)
    key = lambda r: (r["k"] or "", r["stateIndex"], r["stepIndex"])
    whole = {key(r): r for r in f.transform(df).collect()}
    cut = {key(r): r for r in f.copy().setParallelChunkRows(size).transform(df).collect()}
    assert set(whole) == set(cut) and len(cut) == 2 * len(rows)
    for k, w in whole.items():
        c = cut[k]
        assert c["ts"] == w["ts"] and np.allclose(c["state"]["mean"], w["state"]["mean"], atol=1e-7) and np.allclose(c["state"]["covariance"]["values"], w["state"]["covariance"]["values"], atol=1e-7)
        assert (c["loglikelihood"] is None) == (w["loglikelihood"] is None) and (w["loglikelihood"] is None or np.isclose(c["loglikelihood"], w["loglikelihood"]))
    with pytest.raises(ValueError):
        f.copy().setParallelChunkRows(size).setCalculateSlidingLikelihood(True).transform(df)


def plain_em(samples, weights, params, density, stat, batch, hold, rate=None, step=None):
    """Online EM for one key, sample by sample, after the formulas."""
    k = len(weights)
    w, p = list(weights), [dict(x) for x in params]
    sw, sp = list(w), [{n: v * wk for n, v in x.items()} for x, wk in zip(p, w, strict=True)]
    out, held, index = [], [], 0
    for x in samples:
        held.append(x)
        if len(held) < batch:
            continue
        gamma = (2 + index) ** -rate if rate is not None else step
        resp = []
        for s in held:
            joint = np.array([np.log(w[j]) + density(s, p[j]) for j in range(k)])
            e = np.exp(joint - joint.max())
            resp.append(e / e.sum())
        resp = np.array(resp)
        for j in range(k):
            sw[j] = (1 - gamma) * sw[j] + gamma * resp[:, j].mean()
            new = {n: sum(resp[i, j] * stat(s, p[j])[n] for i, s in enumerate(held)) / len(held) for n in p[j]}
            sp[j] = {n: (1 - gamma) * sp[j][n] + gamma * new[n] for n in new}
        if index >= hold:
            w, p = list(sw), [{n: v / sw[j] for n, v in sp[j].items()} for j in range(k)]
        ll = sum(np.log(sum(w[j] * np.exp(density(s, p[j])) for j in range(k))) for s in held)
        index += 1
        out.append((index, list(w), [dict(x) for x in p], ll))
        held = []
    return out


def test_online_mixtures_follow_the_formulas(spark):
    from math import lgamma

    rng = np.random.default_rng(14)
    counts = {k: [int(v) for v in rng.poisson(rng.choice([3, 12, 30], n))] for k, n in (("a", 57), ("b", 23), ("c", 4))}
    df = spark.createDataFrame([(k, i, v if i != 3 else None) for k, vs in counts.items() for i, v in enumerate(vs)], "k string, i int, sample long")
    m = PoissonMixture(stateKeyCol="k", orderCol="i", initialRates=[2.0, 10.0, 25.0], initialWeights=[0.2, 0.3, 0.5], minibatchSize=5, decayRate=0.7, updateHoldout=2)
    got = {(r["k"], r["stateIndex"]): r for r in m.transform(df).collect()}
    n = 0
    for k, vs in counts.items():
        kept = [v for i, v in enumerate(vs) if i != 3]
        for index, w, p, ll in plain_em(kept, [0.2, 0.3, 0.5], [{"rate": x} for x in (2.0, 10.0, 25.0)], lambda s, q: s * np.log(q["rate"]) - q["rate"] - lgamma(s + 1), lambda s, q: {"rate": s}, 5, 2, rate=0.7):
            r = got[k, index]
            assert np.allclose(r["mixtureModel"]["weights"], w) and np.allclose([d["rate"] for d in r["mixtureModel"]["distributions"]], [x["rate"] for x in p]) and np.isclose(r["loglikelihood"], ll)
            n += 1
    assert n == len(got) == 15
    xs = rng.normal(size=(60, 2)) + rng.choice([0.0, 4.0], 60)[:, None]
    df = spark.createDataFrame([(i, x.tolist(), 4 if i % 2 else 3) for i, x in enumerate(xs)], "i int, sample array<double>, size int")

    def density(s, q):
        d = s - q["mean"]
        return -0.5 * (2 * np.log(2 * np.pi) + np.log(np.linalg.det(q["cov"])) + d @ np.linalg.inv(q["cov"]) @ d)

    start = [{"mean": np.array([-1.0, 0.5]), "cov": np.eye(2) * 2.0}, {"mean": np.array([3.0, 5.0]), "cov": np.array([[2.0, 0.5], [0.5, 1.0]])}, {"mean": np.array([1.0, 1.0]), "cov": np.eye(2) * 4.0}]
    g = MultivariateGaussianMixture(orderCol="i", initialMeans=[x["mean"] for x in start], initialCovariances=[x["cov"].ravel("F") for x in start], minibatchSize=4, stepSize=0.3)
    rows = {r["stateIndex"]: r for r in g.transform(df).collect()}
    want = plain_em(list(xs), [1 / 3] * 3, start, density, lambda s, q: {"mean": s, "cov": np.outer(s - q["mean"], s - q["mean"])}, 4, 0, step=0.3)
    assert len(rows) == len(want) == 15
    for index, w, p, ll in want:
        r = rows[index]
        assert np.allclose(r["mixtureModel"]["weights"], w) and np.isclose(r["loglikelihood"], ll)
        for d, x in zip(r["mixtureModel"]["distributions"], p, strict=True):
            assert np.allclose(d["mean"], x["mean"]) and np.allclose(d["covariance"]["values"], x["cov"].ravel("F"))


def test_lkf_sensors_uses_every_optional_model(spark, tmp_path):
    from driftwell.plans.state_queries import lkf_sensors

    mat = "struct<num_rows int, num_cols int, vals array<double>>"
    gau = f"struct<mean array<double>, covariance {mat}>"
    ddl = f"record_id long, state_key string, initial_state {gau}, measurement array<double>, measurement_model {mat}, measurement_noise {mat}, process_model {mat}, process_noise {mat}, control array<double>, control_function {mat}, event_time timestamp"
    rng, rows, want = np.random.default_rng(8), [], {}
    pack = lambda m: (*m.shape, m.T.ravel().tolist())
    for key in ("s/level/1", "s/level/2"):
        x, p = np.array([1.0, 0.5]), np.eye(2)
        for t in range(40):
            own = rng.random(5) < 0.4
            h = np.array([[1.0, round(rng.normal(), 3)]]) if own[0] else None
            f = np.array([[1.0, 1.0], [0.0, 1.0]]) if own[1] else None
            q = 0.3 * np.eye(2) if own[2] else None
            r = np.array([[2.0]]) if own[3] else None
            b = np.array([[1.0], [round(rng.normal(), 3)]]) if own[4] else None
            u = [float(rng.normal())] if own[4] and t % 3 else None
            z = None if t % 9 == 4 else [float(rng.normal(3, 2))]
            rows.append((len(rows), key, ([1.0, 0.5], pack(np.eye(2))) if t == 0 else None, z, *(None if m is None else pack(m) for m in (h, r, f, q)), u, None if b is None else pack(b), START + timedelta(minutes=t)))
            h, f, q, r = (d if m is None else m for m, d in ((h, np.array([[1.0, 0.0]])), (f, np.eye(2)), (q, np.diag([0.01, 0.001])), (r, np.eye(1))))
            x, p = f @ x + (b @ u if u is not None else 0.0), f @ p @ f.T + q
            if z is not None:
                k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
                x, p = x + k @ (z - h @ x), (np.eye(2) - k @ h) @ p
            want[key, t + 1] = x[0]
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "kalman_input.parquet"))
    got = {(r.state_key, r.state_index): r.level for r in lkf_sensors(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for k, level in want.items():
        assert np.isclose(got[k], level), k


def test_a_pipeline_with_filters_is_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(f"k{i % 2}", float(i), float(i * i % 7)) for i in range(20)], "k string, x double, label double")
    stages = [VectorAssembler(inputCols=["x"], outputCol="features"), RecursiveLeastSquaresFilter(stateKeyCol="k", orderCol="x", forgettingFactor=0.9)]
    model = Pipeline(stages=stages).fit(df)
    model.write().overwrite().save(f"{tmp_path}/p")
    again = PipelineModel.load(f"{tmp_path}/p")
    assert again.stages[1].uid == model.stages[1].uid and again.stages[1].getForgettingFactor() == 0.9
    assert sorted(map(str, again.transform(df).collect())) == sorted(map(str, model.transform(df).collect()))
    assert RecursiveLeastSquaresFilter.read().load(model.stages[1].write().overwrite().save(f"{tmp_path}/f") or f"{tmp_path}/f").getStateKeyCol() == "k"


def test_regularization_matrix_of_a_column(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 3.0, [[10.0, 1.0], [1.0, 5.0]]), ("b", [1.0, 2.0], 3.0, None)], "k string, features array<double>, label double, m array<array<double>>")
    out = {r.k: r.state for r in RecursiveLeastSquaresFilter(stateKeyCol="k", regularizationMatrixCol="m", regularizationMatrixFactor=7.0).transform(df).collect()}
    for k, p in (("a", np.array([[10.0, 1], [1, 5]])), ("b", 7 * np.eye(2))):
        u = np.array([1.0, 2.0])
        gain = p @ u / (1 + u @ p @ u)
        assert np.allclose(out[k].mean, gain * 3) and np.allclose(np.reshape(out[k].covariance["values"], (2, 2)), p - np.outer(gain, u @ p))
    with pytest.raises(Exception):  # noqa: B017 - a matrix of another size
        RecursiveLeastSquaresFilter(stateKeyCol="k", regularizationMatrixCol="m").transform(df.withColumn("m", F.array(F.array(F.lit(1.0))))).collect()


def test_decompositions_by_either_method(spark):
    from driftwell.kernels import linalg

    a = np.random.default_rng(3).normal(size=(4, 3, 3))
    s = a @ np.swapaxes(a, 1, 2)
    try:
        made = []
        for method in linalg.SVD_METHODS:
            linalg.use(method)
            made.append((linalg.pinv(s), linalg.root(s)))
        assert all(np.allclose(x, y) for x, y in zip(*made, strict=True)) and np.allclose(made[1][1] @ made[1][1], s)
        assert np.isnan(linalg.pinv(np.full((1, 2, 2), np.nan))).all()
        linalg.use(raising=True)
        with pytest.raises(np.linalg.LinAlgError):
            linalg.root(np.full((1, 2, 2), np.inf))
        with pytest.raises(ValueError):
            linalg.use("other")
    finally:
        linalg.use()
    df = spark.createDataFrame([("a", i, [float(i), float(-i)]) for i in range(6)], "k string, i int, measurement array<double>")
    f = UnscentedKalmanFilter(stateKeyCol="k", orderCol="i", stateSize=2, measurementModel=np.eye(2), measurementNoise=np.eye(2))
    plain = [r.state for r in f.transform(df).orderBy("stateIndex").collect()]
    spark.conf.set("spark.driftwell.linalg.svdMethod", "eigh")
    try:
        other = [r.state for r in f.transform(df).orderBy("stateIndex").collect()]
    finally:
        spark.conf.unset("spark.driftwell.linalg.svdMethod")
    assert np.allclose([s.mean for s in plain], [s.mean for s in other])
    assert hasattr(f, "setSigmaPointLowerBound") and hasattr(f, "setSigmaPointUpperBound")


def test_batch_em_of_many_models_and_long_sums(spark, monkeypatch):
    from driftwell.estimators import MultivariateGaussianMixture, mixture

    rng = np.random.default_rng(21)
    rows = [(f"k{i % 3}" if i % 11 else None, i, rng.normal((i % 2) * 4, 1, 2).tolist() if i % 13 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, sample array<double>").repartition(3)
    em = lambda: MultivariateGaussianMixture(stateKeyCol="k", orderCol="i", initialMeans=[[0.0, 1.0], [3.0, 2.0]], stepSize=1.0).setEnableBatchEM().setBatchTrainMaxIter(6)
    plain = {r.k: r for r in em().transform(df).collect()}
    monkeypatch.setattr(mixture, "FEW", 0)
    monkeypatch.setattr(mixture, "WIDE", 1)
    other = {r.k: r for r in em().transform(df).collect()}
    assert set(plain) == set(other) == {"k0", "k1", "k2"}
    for k, r in plain.items():
        a, b = r.mixtureModel, other[k].mixtureModel
        assert np.allclose(a.weights, b.weights) and all(np.allclose(x.mean, y.mean) and np.allclose(x.covariance["values"], y.covariance["values"]) for x, y in zip(a.distributions, b.distributions, strict=True))
        x = np.array([s for kk, _, s in rows if kk == k and s is not None])
        w, m, c = np.full(2, 0.5), np.array([[0.0, 1.0], [3.0, 2.0]]), np.array([np.eye(2)] * 2)
        for _ in range(6):
            joint = np.stack([np.log(w[j]) - 0.5 * (np.log(np.linalg.det(c[j])) + np.einsum("ni,ij,nj->n", x - m[j], np.linalg.inv(c[j]), x - m[j])) for j in (0, 1)], 1)
            g = np.exp(joint - np.logaddexp(joint[:, :1], joint[:, 1:]))
            old, w, m = m, g.mean(0), (g.T @ x) / g.sum(0)[:, None]
            c = np.array([np.einsum("n,ni,nj->ij", g[:, j], x - old[j], x - old[j]) / g[:, j].sum() for j in (0, 1)])
        assert np.allclose(sorted(a.weights), sorted(w), atol=0.05) and np.allclose([d.mean for d in a.distributions], m, atol=0.2)
    assert em().transform(df.limit(0)).count() == 0


def test_a_vanished_component_keeps_its_parameters():
    from driftwell.kernels import mixture as em

    summary = (np.array([[1.0, 0.0]]), {"rate": np.array([[5.0, 0.0]])})
    w, params = em.from_summary(summary, {"rate": np.array([[4.0, 9.0]])})
    assert w.tolist() == [[1.0, 0.0]] and params["rate"].tolist() == [[5.0, 9.0]]

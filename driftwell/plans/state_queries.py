"""Queries of the filters, smoother, mixtures and functions, with recurrences in SQL as their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell import estimators as E
from driftwell import functions as f
from driftwell.functions import axpy_array, axpy_array_aggregate, dot_array, latest_state_likelihood, scal_array
from driftwell.sources import table

Query = Callable[[SparkSession, str], DataFrame]
KEYED = {"stateKeyCol": "user_id", "eventTimeCol": "ts", "orderCol": "event_id"}


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    u = (F.col("event_id") % 5 + 1).cast("double")
    return e.withColumns({"z": F.array("value"), "gappy": F.when(F.col("event_id") % 7 != 0, F.array("value")), "u": F.array(u), "count": F.col("value").cast("long"), "hit": F.col("value") > 50})


ROWS = """r AS (SELECT user_id, event_id, value, CASE WHEN event_id % 7 <> 0 THEN value END AS gappy, 1.0 + event_id % 5 AS u, CAST(trunc(value) AS BIGINT) AS cnt,
  CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


def _mean(i: int = 0):
    return F.round(F.get("state.mean", F.lit(i)), 6)


def _cov(i: int = 0):
    return F.round(F.get("state.covariance.values", F.lit(i)), 6)


# -- regression --------------------------------------------------------------------------------------


def lms_events(spark: SparkSession, d: str) -> DataFrame:
    out = E.LeastMeanSquaresFilter(**KEYED, labelCol="value", featuresCol="u", learningRate=0.5).transform(_events(spark, d))
    return out.select("user_id", F.col("stateIndex").alias("state_index"), F.round(F.get("state", F.lit(0)), 6).alias("w"))


LMS = f"""WITH RECURSIVE {ROWS}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS w FROM r
  UNION ALL SELECT r.user_id, r.n, f.w + 0.5 * r.u / (1.0 + r.u * r.u) * (r.value - r.u * f.w) FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, n AS state_index, round(w, 6) AS w FROM f WHERE n > 0"""


def rls_events(spark: SparkSession, d: str) -> DataFrame:
    out = E.RecursiveLeastSquaresFilter(**KEYED, labelCol="value", featuresCol="u", forgettingFactor=0.97, regularizationMatrixFactor=1000.0).transform(_events(spark, d))
    return out.select("user_id", F.col("stateIndex").alias("state_index"), _mean().alias("w"), F.round(F.get("state.covariance.values", F.lit(0)), 8).alias("p"))


RLS = f"""WITH RECURSIVE {ROWS}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS w, 1000.0::DOUBLE AS p FROM r
  UNION ALL SELECT r.user_id, r.n, f.w + f.p * r.u / (0.97 + r.u * f.p * r.u) * (r.value - r.u * f.w), (f.p - f.p * r.u / (0.97 + r.u * f.p * r.u) * r.u * f.p) / 0.97
  FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, n AS state_index, round(w, 6) AS w, round(p, 8) AS p FROM f WHERE n > 0"""


# -- filters -----------------------------------------------------------------------------------------


def _level_sql(a: float, q: float, r: float, fading: float, z: str, p0: float = 100.0) -> str:
    """The scalar filter as a recursion: f(user_id, n, z, xp, pp, x, p)."""
    return f"""WITH RECURSIVE {ROWS}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::DOUBLE AS z, 0.0::DOUBLE AS xp, 0.0::DOUBLE AS pp, 0.0::DOUBLE AS x, {p0}::DOUBLE AS p FROM r
  UNION ALL SELECT user_id, n, z, xp, pp, CASE WHEN z IS NULL THEN xp ELSE xp + pp / (pp + {r}) * (z - xp) END,
    CASE WHEN z IS NULL THEN pp ELSE ({r} / (pp + {r})) * ({r} / (pp + {r})) * pp + pp / (pp + {r}) * (pp / (pp + {r})) * {r} END
  FROM (SELECT r.user_id, r.n, r.{z} AS z, {a} * f.x AS xp, {fading * fading} * {a * a} * f.p + {q} AS pp FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1))"""


LIKELIHOOD = """, l AS (SELECT *, -0.5 * (ln(2 * pi() * s) + d * d / s) AS ll FROM (SELECT user_id, n, z - xp AS d, pp + {r} AS s FROM f WHERE n > 0 AND z IS NOT NULL)),
w AS (SELECT *, exp(sum(ll) OVER (PARTITION BY user_id ORDER BY n ROWS 2 PRECEDING)) AS sl FROM l)"""


def lkf_events(spark: SparkSession, d: str) -> DataFrame:
    f = E.LinearKalmanFilter(**KEYED, measurementCol="gappy", stateSize=1, initialStateCovariance=[[100.0]], processModel=[[0.98]], processNoise=[[0.5]], measurementNoise=[[40.0]], measurementModel=[[1.0]], fadingFactor=1.01, calculateLoglikelihood=True, calculateMahalanobis=True, calculateSlidingLikelihood=True, slidingLikelihoodWindow=3)
    out = f.transform(_events(spark, d))
    return out.select("user_id", F.col("stateIndex").alias("state_index"), _mean().alias("mean"), _cov().alias("cov"), F.round(F.get("residual.mean", F.lit(0)), 6).alias("residual"), F.round("loglikelihood", 6).alias("loglik"), F.round("mahalanobis", 6).alias("mahalanobis"), F.round("slidingLikelihood", 9).alias("sliding"))


LKF = (
    _level_sql(0.98, 0.5, 40.0, 1.01, "gappy")
    + LIKELIHOOD.format(r=40.0)
    + """ SELECT f.user_id, f.n AS state_index, round(f.x, 6) AS mean, round(f.p, 6) AS cov, round(w.d, 6) AS residual, round(w.ll, 6) AS loglik, round(abs(w.d) / sqrt(w.s), 6) AS mahalanobis,
  round(last_value(w.sl IGNORE NULLS) OVER (PARTITION BY f.user_id ORDER BY f.n), 9) AS sliding FROM f LEFT JOIN w USING (user_id, n) WHERE f.n > 0"""
)


def _plain(cls: type, **extra) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        f = cls(**KEYED, measurementCol="gappy", stateSize=1, initialStateCovariance=[[100.0]], processModel=[[0.98]], processNoise=[[0.5]], measurementNoise=[[40.0]], measurementModel=[[1.0]], **extra)
        return f.transform(_events(spark, d)).select("user_id", F.col("stateIndex").alias("state_index"), F.round(F.get("state.mean", F.lit(0)), 5).alias("mean"), F.round(F.get("state.covariance.values", F.lit(0)), 5).alias("cov"))

    return query


PLAIN = _level_sql(0.98, 0.5, 40.0, 1.0, "gappy") + " SELECT user_id, n AS state_index, round(x, 5) AS mean, round(p, 5) AS cov FROM f WHERE n > 0"


def ekf_log_events(spark: SparkSession, d: str) -> DataFrame:
    """A nonlinear measurement: value = 10 exp(x / 10)."""
    import numpy as np

    f = E.ExtendedKalmanFilter(**KEYED, measurementCol="z", stateSize=1, initialStateMean=[10.0], initialStateCovariance=[[4.0]], processNoise=[[0.1]], measurementNoise=[[400.0]], measurementModel=[[1.0]])
    f.setMeasurementFunction(lambda x, h: 10 * np.exp(np.clip(x, -50, 50) / 10)).setMeasurementStateJacobian(lambda x, h: np.exp(np.clip(x, -50, 50) / 10)[:, None])
    return f.transform(_events(spark, d)).select("user_id", F.col("stateIndex").alias("state_index"), _mean().alias("mean"), _cov().alias("cov"))


EKF_LOG = f"""WITH RECURSIVE {ROWS}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 10.0::DOUBLE AS x, 4.0::DOUBLE AS p FROM r
  UNION ALL SELECT user_id, n, x + pp * h / (h * h * pp + 400) * (value - 10 * h), (1 - pp * h * h / (h * h * pp + 400)) * (1 - pp * h * h / (h * h * pp + 400)) * pp + pp * h / (h * h * pp + 400) * (pp * h / (h * h * pp + 400)) * 400
  FROM (SELECT r.user_id, r.n, r.value, f.x, f.p + 0.1 AS pp, exp(greatest(-50, least(50, f.x)) / 10) AS h FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1))
SELECT user_id, n AS state_index, round(x, 6) AS mean, round(p, 6) AS cov FROM f WHERE n > 0"""


def lkf_trend_events(spark: SparkSession, d: str) -> DataFrame:
    f = E.LinearKalmanFilter(**KEYED, measurementCol="z", stateSize=2, initialStateCovariance=[[100.0, 0.0], [0.0, 100.0]], processModel=[[1.0, 1.0], [0.0, 1.0]], processNoise=[[0.2, 0.0], [0.0, 0.05]], measurementNoise=[[50.0]], measurementModel=[[1.0, 0.0]])
    return f.transform(_events(spark, d)).select("user_id", F.col("stateIndex").alias("state_index"), F.round(F.get("state.mean", F.lit(0)), 5).alias("level"), F.round(F.get("state.mean", F.lit(1)), 5).alias("slope"), F.round(F.get("state.covariance.values", F.lit(0)), 5).alias("p11"), F.round(F.get("state.covariance.values", F.lit(2)), 5).alias("p12"), F.round(F.get("state.covariance.values", F.lit(3)), 5).alias("p22"))


LKF_TREND = f"""WITH RECURSIVE {ROWS}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 100.0::DOUBLE AS a, 0.0::DOUBLE AS b, 100.0::DOUBLE AS c FROM r
  UNION ALL SELECT user_id, n, x1 + x2 + a / (a + 50) * (value - x1 - x2), x2 + b / (a + 50) * (value - x1 - x2), a - a * a / (a + 50), b - a * b / (a + 50), c - b * b / (a + 50)
  FROM (SELECT r.user_id, r.n, r.value, f.x1, f.x2, f.a + 2 * f.b + f.c + 0.2 AS a, f.b + f.c AS b, f.c + 0.05 AS c FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1))
SELECT user_id, n AS state_index, round(x1, 5) AS level, round(x2, 5) AS slope, round(a, 5) AS p11, round(b, 5) AS p12, round(c, 5) AS p22 FROM f WHERE n > 0"""


def _pair(cls: type, **extra) -> Query:
    """Two states and two measurements: the value, and half the level with the slope and the input u."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        e = _events(spark, d).withColumn("z2", F.array(F.col("value"), 0.5 * F.col("value") + F.get("u", F.lit(0))))
        f = cls(**KEYED, measurementCol="z2", stateSize=2, initialStateCovariance=[[100.0, 0.0], [0.0, 100.0]], processModel=[[1.0, 1.0], [0.0, 1.0]], processNoise=[[0.2, 0.0], [0.0, 0.05]], measurementNoise=[[50.0, 0.0], [0.0, 20.0]], measurementModel=[[1.0, 0.0], [0.5, 1.0]], **extra)
        return f.transform(e).select("user_id", F.col("stateIndex").alias("state_index"), *(F.round(F.get("state.mean", F.lit(i)), 4).alias(c) for i, c in ((0, "level"), (1, "slope"))), *(F.round(F.get("state.covariance.values", F.lit(i)), 4).alias(c) for i, c in ((0, "p11"), (2, "p12"), (3, "p22"))))

    return query


PAIR = f"""WITH RECURSIVE {ROWS}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 100.0::DOUBLE AS a, 0.0::DOUBLE AS b, 100.0::DOUBLE AS c FROM r
  UNION ALL SELECT user_id, n, x1 + k11 * d1 + k12 * d2, x2 + k21 * d1 + k22 * d2, a - k11 * a - k12 * h1, b - k11 * b - k12 * h2, c - k21 * b - k22 * h2
  FROM (SELECT *, (a * s22 - h1 * h1) / det AS k11, (h1 * s11 - a * h1) / det AS k12, (b * s22 - h2 * h1) / det AS k21, (h2 * s11 - b * h1) / det AS k22
    FROM (SELECT *, s11 * s22 - h1 * h1 AS det FROM (SELECT *, a + 50 AS s11, 0.5 * h1 + h2 + 20 AS s22, z - x1 AS d1, 0.5 * z + u - 0.5 * x1 - x2 AS d2
      FROM (SELECT *, 0.5 * a + b AS h1, 0.5 * b + c AS h2 FROM (SELECT r.user_id, r.n, r.value AS z, r.u, f.x1 + f.x2 AS x1, f.x2, f.a + 2 * f.b + f.c + 0.2 AS a, f.b + f.c AS b, f.c + 0.05 AS c FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1))))))
SELECT user_id, n AS state_index, round(x1, 4) AS level, round(x2, 4) AS slope, round(a, 4) AS p11, round(b, 4) AS p12, round(c, 4) AS p22 FROM f WHERE n > 0"""


def lkf_control_events(spark: SparkSession, d: str) -> DataFrame:
    """Control input u with gain 0.3."""
    e = _events(spark, d).withColumn("gain", F.array(F.array(F.lit(0.3))))
    f = E.LinearKalmanFilter(**KEYED, measurementCol="z", stateSize=1, initialStateCovariance=[[100.0]], processNoise=[[0.5]], measurementNoise=[[40.0]], controlCol="u", controlFunctionCol="gain")
    return f.transform(e).select("user_id", F.col("stateIndex").alias("state_index"), _mean().alias("mean"))


LKF_CONTROL = f"""WITH RECURSIVE {ROWS}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS x, 100.0::DOUBLE AS p FROM r
  UNION ALL SELECT user_id, n, xp + pp / (pp + 40) * (value - xp), pp * 40 / (pp + 40) FROM (SELECT r.user_id, r.n, r.value, f.x + 0.3 * r.u AS xp, f.p + 0.5 AS pp FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1))
SELECT user_id, n AS state_index, round(x, 6) AS mean FROM f WHERE n > 0"""


def multi_step_events(spark: SparkSession, d: str) -> DataFrame:
    f = E.LinearKalmanFilter(**KEYED, measurementCol="gappy", stateSize=1, initialStateCovariance=[[100.0]], processModel=[[0.98]], processNoise=[[0.5]], measurementNoise=[[40.0]], multiStepPredict=3)
    return f.transform(_events(spark, d)).select("user_id", F.col("stateIndex").alias("state_index"), F.col("stepIndex").alias("step_index"), _mean().alias("mean"))


MULTI_STEP = _level_sql(0.98, 0.5, 40.0, 1.0, "gappy") + " SELECT user_id, n + k AS state_index, k AS step_index, round(x * pow(0.98, k), 6) AS mean FROM f, (SELECT unnest(range(0, 4)) AS k) WHERE n > 0"


def mmae_events(spark: SparkSession, d: str) -> DataFrame:
    f = E.LinearKalmanFilter(**KEYED, measurementCol="gappy", stateSize=1, initialStateCovariance=[[100.0]], processModel=[[0.98]], processNoise=[[0.5]], measurementNoise=[[40.0]], calculateSlidingLikelihood=True, slidingLikelihoodWindow=3, multipleModelAdaptiveEstimationEnabled=True)
    return f.transform(_events(spark, d)).select(F.col("stateIndex").alias("state_index"), _mean().alias("mean"), _cov().alias("cov"))


MMAE = (
    _level_sql(0.98, 0.5, 40.0, 1.0, "gappy")
    + LIKELIHOOD.format(r=40.0)
    + """, v AS (SELECT f.n, f.x, f.p, last_value(w.sl IGNORE NULLS) OVER (PARTITION BY f.user_id ORDER BY f.n) AS sl FROM f LEFT JOIN w USING (user_id, n) WHERE f.n > 0)
SELECT n AS state_index, round(sum(sl * x) / sum(sl), 6) AS mean, round(sum(sl * p) / sum(sl), 6) AS cov FROM v GROUP BY n"""
)


def smoother_events(spark: SparkSession, d: str) -> DataFrame:
    s = E.LinearKalmanSmoother(**KEYED, measurementCol="gappy", stateSize=1, initialStateCovariance=[[100.0]], processModel=[[0.98]], processNoise=[[0.5]], measurementNoise=[[40.0]], fixedLag=2)
    return s.transform(_events(spark, d)).select("user_id", F.col("stateIndex").alias("state_index"), F.col("stepIndex").alias("step_index"), _mean().alias("mean"), _cov().alias("cov"), F.round(F.get("rtsGain.values", F.lit(0)), 6).alias("gain"))


SMOOTHER = (
    _level_sql(0.98, 0.5, 40.0, 1.0, "gappy")
    + """, b AS (SELECT n.user_id, n.n, n.x AS xn, n.p AS pn, o.x AS xo, o.p AS po, 0.9604 * o.p + 0.5 AS ahead FROM f AS n JOIN f AS o ON o.user_id = n.user_id AND o.n = n.n - 1 AND o.n > 0)
SELECT user_id, n AS state_index, 0 AS step_index, round(xn, 6) AS mean, round(pn, 6) AS cov, 0.0 AS gain FROM b
UNION ALL SELECT user_id, n - 1, 1, round(xo + g * (xn - 0.98 * xo), 6), round(po + g * g * (pn - ahead), 6), round(g, 6) FROM (SELECT *, po * 0.98 / ahead AS g FROM b)"""
)


# -- mixtures ----------------------------------------------------------------------------------------


def poisson_events(spark: SparkSession, d: str) -> DataFrame:
    m = E.PoissonMixture(**KEYED, sampleCol="count", initialRates=[20.0, 80.0], initialWeights=[0.5, 0.5], stepSize=0.137)
    return _mixture(m.transform(_events(spark, d)), "rate")


def _mixture(out: DataFrame, field: str) -> DataFrame:
    part = lambda k: F.get("mixtureModel.distributions", F.lit(k))[field]
    return out.select("user_id", F.col("stateIndex").alias("state_index"), F.round(F.get("mixtureModel.weights", F.lit(0)), 7).alias("w1"), F.round(part(0), 7).alias("a1"), F.round(part(1), 7).alias("a2"), F.round("loglikelihood", 7).alias("loglik"))


def _mixture_sql(x: str, l1: str, l2: str, a1: float, a2: float, ll1: str, ll2: str) -> str:
    return f"""WITH RECURSIVE {ROWS}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::DOUBLE AS v, 0.5::DOUBLE AS w1, 0.5::DOUBLE AS w2, {0.5 * a1}::DOUBLE AS s1, {0.5 * a2}::DOUBLE AS s2 FROM r
  UNION ALL SELECT user_id, n, v, 0.863 * w1 + 0.137 * g1, 0.863 * w2 + 0.137 * (1 - g1), 0.863 * s1 + 0.137 * g1 * v, 0.863 * s2 + 0.137 * (1 - g1) * v
  FROM (SELECT *, 1.0 / (1.0 + exp({l2} + ln(w2) - {l1} - ln(w1))) AS g1 FROM (SELECT r.user_id, r.n, r.{x}::DOUBLE AS v, f.w1, f.w2, f.s1, f.s2, f.s1 / f.w1 AS a1, f.s2 / f.w2 AS a2 FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)))
SELECT user_id, n AS state_index, round(w1, 7) AS w1, round(a1, 7) AS a1, round(a2, 7) AS a2, round(greatest(m1, m2) + ln(1 + exp(least(m1, m2) - greatest(m1, m2))), 7) AS loglik
FROM (SELECT *, {ll1} + ln(w1) AS m1, {ll2} + ln(w2) AS m2 FROM (SELECT *, s1 / w1 AS a1, s2 / w2 AS a2 FROM f WHERE n > 0))"""


POISSON = _mixture_sql("cnt", "(v * ln(a1) - a1)", "(v * ln(a2) - a2)", 20.0, 80.0, "(v * ln(a1) - a1 - lgamma(v + 1))", "(v * ln(a2) - a2 - lgamma(v + 1))")


def bernoulli_events(spark: SparkSession, d: str) -> DataFrame:
    m = E.BernoulliMixture(**KEYED, sampleCol="hit", initialProbabilities=[0.3, 0.6], initialWeights=[0.5, 0.5], stepSize=0.137)
    return _mixture(m.transform(_events(spark, d)), "probability")


_B = "(CASE WHEN v > 0.5 THEN ln({a}) ELSE ln(1 - {a}) END)"
BERNOULLI = _mixture_sql("hit", _B.format(a="a1"), _B.format(a="a2"), 0.3, 0.6, _B.format(a="a1"), _B.format(a="a2"))


def gaussian_mixture_events(spark: SparkSession, d: str) -> DataFrame:
    m = E.MultivariateGaussianMixture(**KEYED, sampleCol="z", initialMeans=[[20.0], [80.0]], initialCovariances=[[400.0], [400.0]], initialWeights=[0.5, 0.5], stepSize=0.05)
    out = m.transform(_events(spark, d))
    part = lambda k: F.get("mixtureModel.distributions", F.lit(k))
    return out.select("user_id", F.col("stateIndex").alias("state_index"), F.round(F.get("mixtureModel.weights", F.lit(0)), 6).alias("w1"), F.round(F.get(part(0)["mean"], F.lit(0)), 5).alias("m1"), F.round(F.get(part(1)["mean"], F.lit(0)), 5).alias("m2"), F.round(F.get(part(0)["covariance"]["values"], F.lit(0)), 4).alias("c1"), F.round(F.get(part(1)["covariance"]["values"], F.lit(0)), 4).alias("c2"))


GAUSSIAN = f"""WITH RECURSIVE {ROWS}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.5::DOUBLE AS w1, 0.5::DOUBLE AS w2, 10.0::DOUBLE AS s1, 40.0::DOUBLE AS s2, 200.0::DOUBLE AS c1, 200.0::DOUBLE AS c2 FROM r
  UNION ALL SELECT user_id, n, 0.95 * w1 + 0.05 * g, 0.95 * w2 + 0.05 * (1 - g), 0.95 * s1 + 0.05 * g * v, 0.95 * s2 + 0.05 * (1 - g) * v, 0.95 * c1 + 0.05 * g * (v - m1) * (v - m1), 0.95 * c2 + 0.05 * (1 - g) * (v - m2) * (v - m2)
  FROM (SELECT *, 1.0 / (1.0 + exp((-0.5 * (ln(q2) + (v - m2) * (v - m2) / q2) + ln(w2)) - (-0.5 * (ln(q1) + (v - m1) * (v - m1) / q1) + ln(w1)))) AS g
    FROM (SELECT r.user_id, r.n, r.value AS v, f.*  EXCLUDE (user_id, n), f.s1 / f.w1 AS m1, f.s2 / f.w2 AS m2, f.c1 / f.w1 AS q1, f.c2 / f.w2 AS q2 FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)))
SELECT user_id, n AS state_index, round(w1, 6) AS w1, round(s1 / w1, 5) AS m1, round(s2 / w2, 5) AS m2, round(c1 / w1, 4) AS c1, round(c2 / w2, 4) AS c2 FROM f WHERE n > 0"""


def poisson_minibatch_events(spark: SparkSession, d: str) -> DataFrame:
    """Minibatches with decaying steps and a holdout."""
    m = E.PoissonMixture(**KEYED, sampleCol="count", initialRates=[10.0, 50.0, 90.0], decayRate=0.8, minibatchSize=10, updateHoldout=1)
    return _mixture(m.transform(_events(spark, d)), "rate")


def _minibatch_sql(size: int = 10, decay: float = 0.8) -> str:
    at = lambda k, w="w", a="a": f"(v * ln({a}{k}) - {a}{k} + ln({w}{k}))"
    share = lambda k: "1.0 / (" + " + ".join(f"exp({at(j)} - {at(k)})" for j in (1, 2, 3)) + ")"
    mean = lambda k, x: f"list_sum(list_transform(vs, lambda v: {share(k)} * {x})) / {size}"
    ks = (1, 2, 3)
    each = lambda form: ", ".join(form(k) for k in ks)
    top = f"greatest({each(at)})"
    return f"""WITH RECURSIVE {ROWS}, b AS (SELECT user_id, (n - 1) // {size} AS t, list(cnt::DOUBLE) AS vs FROM r GROUP BY 1, 2 HAVING count(*) = {size}),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS t, NULL::DOUBLE[] AS vs, {each(lambda k: f"(1.0 / 3)::DOUBLE AS w{k}")}, {each(lambda k: f"{(10.0, 50.0, 90.0)[k - 1]}::DOUBLE AS a{k}")}, {each(lambda k: f"(1.0 / 3)::DOUBLE AS sw{k}")}, {each(lambda k: f"({(10.0, 50.0, 90.0)[k - 1]} / 3)::DOUBLE AS ss{k}")} FROM b
  UNION ALL SELECT user_id, t + 1, vs, {each(lambda k: f"CASE WHEN t < 1 THEN w{k} ELSE nw{k} END")}, {each(lambda k: f"CASE WHEN t < 1 THEN a{k} ELSE ns{k} / nw{k} END")}, {each(lambda k: f"nw{k}")}, {each(lambda k: f"ns{k}")}
  FROM (SELECT *, {each(lambda k: f"(1 - g) * sw{k} + g * {mean(k, '1.0')} AS nw{k}")}, {each(lambda k: f"(1 - g) * ss{k} + g * {mean(k, 'v')} AS ns{k}")}
    FROM (SELECT b.user_id, b.t, b.vs, f.* EXCLUDE (user_id, t, vs), pow(2.0 + b.t, -{decay}) AS g FROM f JOIN b ON b.user_id = f.user_id AND b.t = f.t)))
SELECT user_id, t AS state_index, round(w1, 7) AS w1, round(a1, 7) AS a1, round(a2, 7) AS a2, round(list_sum(list_transform(vs, lambda v: {top} + ln({" + ".join(f"exp({at(k)} - {top})" for k in ks)}) - lgamma(v + 1))), 7) AS loglik FROM f WHERE t > 0"""


def batch_em_events(spark: SparkSession, d: str) -> DataFrame:
    m = E.PoissonMixture(stateKeyCol="event_type", orderCol="event_id", sampleCol="count", initialRates=[20.0, 80.0], initialWeights=[0.5, 0.5], stepSize=1.0).setEnableBatchEM().setBatchTrainMaxIter(3).setBatchTrainTol(-1e12)
    out = m.transform(_events(spark, d))
    part = lambda k: F.get("mixtureModel.distributions", F.lit(k))["rate"]
    return out.select("event_type", F.round(F.get("mixtureModel.weights", F.lit(0)), 6).alias("w1"), F.round(part(0), 5).alias("a1"), F.round(part(1), 5).alias("a2"), F.round("loglikelihood", 3).alias("loglik"))


def _batch_em_sql(rounds: int) -> str:
    l = lambda k: f"(v * ln(a{k}) - a{k} + ln(w{k}))"  # noqa: E731, E741
    parts = ["x AS (SELECT event_type, CAST(trunc(value) AS DOUBLE) AS v FROM events)", "m0 AS (SELECT DISTINCT event_type, 0.5::DOUBLE AS w1, 0.5::DOUBLE AS w2, 20.0::DOUBLE AS a1, 80.0::DOUBLE AS a2 FROM x)"]
    for i in range(rounds):
        parts.append(f"m{i + 1} AS (SELECT event_type, avg(g) AS w1, avg(1 - g) AS w2, sum(g * v) / sum(g) AS a1, sum((1 - g) * v) / sum(1 - g) AS a2 FROM (SELECT *, 1.0 / (1.0 + exp({l(2)} - {l(1)})) AS g FROM x JOIN m{i} USING (event_type)) GROUP BY event_type)")
    top = f"SELECT event_type, round(any_value(w1), 6) AS w1, round(any_value(a1), 5) AS a1, round(any_value(a2), 5) AS a2, round(sum(greatest({l(1)}, {l(2)}) + ln(1 + exp(least({l(1)}, {l(2)}) - greatest({l(1)}, {l(2)}))) - lgamma(v + 1)), 3) AS loglik FROM x JOIN m{rounds} USING (event_type) GROUP BY event_type"
    return "WITH " + ", ".join(parts) + " " + top


# -- functions and aggregates ------------------------------------------------------------------------


def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    first = lambda a: F.get(a, F.lit(0))
    return e.select("vec_id", F.round(dot_array("x", "x"), 5).alias("dot"), F.round(first(scal_array(2.5, "x")), 6).alias("scaled"), F.round(first(axpy_array(2.0, F.col("x"), F.reverse("x"))), 6).alias("axpy"))


VECTOR_FUNCTIONS = """SELECT vec_id, round(list_sum(list_transform(x, lambda v: v * v)), 5) AS dot, round(2.5 * x[1], 6) AS scaled, round(2.0 * x[1] + x[len(x)], 6) AS axpy
FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"""


def matrix_functions(spark: SparkSession, d: str) -> DataFrame:
    """Products of matrices and vectors that are cut out of each embedding, as structs and through ML types."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    mat = lambda rows, cols, first: F.struct(F.lit(rows).alias("numRows"), F.lit(cols).alias("numCols"), F.slice("x", first, rows * cols).alias("values"))
    a, b, v = mat(2, 3, 1), mat(3, 2, 7), F.slice("x", 13, 3)
    ml = lambda m: f.array_to_matrix(m)
    made = e.select(
        "vec_id", f.multiply_struct(a, b)["values"].alias("ab"), f.multiply_struct_array(a, v).alias("av"), f.project_struct(f.diag_struct(v), a)["values"].alias("ada"), f.outer_struct(0.5, v, v)["values"].alias("vv"),
        f.matrix_to_array(f.multiply_matrix(ml(a), ml(b)))["values"].alias("ml_ab"), f.vector_to_array(f.multiply_matrix_vector(ml(a), f.array_to_vector(v))).alias("ml_av"),
        f.matrix_to_array(f.project_matrix(f.diag_matrix(f.array_to_vector(v)), ml(a)))["values"].alias("ml_ada"), f.vector_to_array(f.scale_to_multi_gaussian(f.ones_vector(2), f.eye_matrix(2), f.zeros_vector(2))).alias("one"), f.matrix_to_array(f.zeros_matrix(1, 1))["values"].alias("zero"))
    return made.select("vec_id", *(F.round(F.get(c, F.lit(k)), 6).alias(f"{c}_{k}") for c, n in (("ab", 4), ("av", 2), ("ada", 4), ("vv", 2), ("ml_ab", 4), ("ml_av", 2), ("ml_ada", 4), ("one", 1), ("zero", 1)) for k in range(n)))


def _matrix_sql() -> str:
    a = lambda i, k: f"x[{1 + k * 2 + i}]"
    b = lambda k, j: f"x[{7 + j * 3 + k}]"
    v = lambda k: f"x[{13 + k}]"
    total = lambda terms: " + ".join(terms)
    ab = [total(f"{a(i, k)} * {b(k, j)}" for k in range(3)) for j in range(2) for i in range(2)]
    av = [total(f"{a(i, k)} * {v(k)}" for k in range(3)) for i in range(2)]
    ada = [total(f"{a(i, k)} * {v(k)} * {a(j, k)}" for k in range(3)) for j in range(2) for i in range(2)]
    vv = [f"0.5 * {v(0)} * {v(0)}", f"0.5 * {v(1)} * {v(0)}"]
    cols = {"ab": ab, "av": av, "ada": ada, "vv": vv, "ml_ab": ab, "ml_av": av, "ml_ada": ada, "one": ["1.0::DOUBLE"], "zero": ["0.0::DOUBLE"]}
    listed = ", ".join(f"round({e}, 6) AS {c}_{k}" for c, es in cols.items() for k, e in enumerate(es))
    return f"SELECT vec_id, {listed} FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def vector_aggregate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 3 + 1).cast("double").alias("w"), F.col("embedding").cast("array<double>").alias("x"))
    size = e.agg(F.max(F.size("x"))).first()[0] or 0
    sums = e.groupBy("label").agg(axpy_array_aggregate(F.col("w"), F.col("x"), size).alias("s"))
    return sums.select("label", F.posexplode("s").alias("pos", "v")).select("label", "pos", F.round("v", 5).alias("total"))


VECTOR_AGGREGATE = """SELECT label, CAST(i - 1 AS INT) AS pos, round(sum((vec_id % 3 + 1) * embedding[i]::DOUBLE), 5) AS total FROM embeddings, (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS i) GROUP BY 1, 2"""


def latest_state(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("p", F.col("value") * 2)
    s = e.groupBy("user_id").agg(latest_state_likelihood(F.col("value"), F.col("event_id"), F.col("z"), F.col("p")).alias("s"))
    return s.select("user_id", F.round("s.loglikelihood", 4).alias("loglik"), F.col("s.stateIndex").alias("state_index"), F.get("s.state", F.lit(0)).alias("state"), F.col("s.stateCovariance").alias("cov"))


LATEST_STATE = "SELECT user_id, round(sum(value), 4) AS loglik, max(event_id) AS state_index, arg_max(value, event_id) AS state, arg_max(value * 2, event_id) AS cov FROM events GROUP BY user_id"


# -- the sensor tables -------------------------------------------------------------------------------


def lkf_sensors(spark: SparkSession, d: str) -> DataFrame:
    """The linear filter over all of kalman_input, with each row's optional models."""
    f = E.LinearKalmanFilter(stateKeyCol="state_key", eventTimeCol="event_time", orderCol="record_id", stateSize=2, initialStateDistributionCol="initial_state", measurementModelCol="measurement_model", measurementNoiseCol="measurement_noise", processModelCol="process_model", processNoiseCol="process_noise", controlCol="control", controlFunctionCol="control_function", processNoise=[[0.01, 0.0], [0.0, 0.001]])
    out = f.transform(table(spark, d, "kalman_input"))
    # Faulty readings make states of 30 digits; of those the order of magnitude is given.
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.when(F.abs(c) < 1e4, F.round(c, 6)).otherwise(F.round(F.log10(F.abs(c)), 6)))
    return out.select("state_key", "event_time", F.col("stateIndex").alias("state_index"), finite(F.get("state.mean", F.lit(0))).alias("level"), finite(F.get("state.mean", F.lit(1))).alias("slope"), finite(F.get("state.covariance.values", F.lit(0))).alias("p11"))


#: A key has one or two entries per measurement; with two, models of a single row don't fit and the defaults are used.
LKF_SENSORS = """
WITH RECURSIVE o AS (SELECT *, coalesce(state_key, '') AS k, row_number() OVER (PARTITION BY state_key ORDER BY event_time NULLS FIRST, record_id) AS n, max(len(measurement)) OVER (PARTITION BY state_key) AS m FROM kalman_input),
r AS (SELECT k, state_key, event_time, n, m, CASE WHEN len(measurement) = m AND m > 0 AND NOT list_bool_or([x IS NULL OR isnan(x) FOR x IN measurement]) THEN measurement END AS z, coalesce(process_model.vals, [1.0, 0.0, 0.0, 1.0]::DOUBLE[]) AS f,
    coalesce(process_noise.vals, [0.01, 0.0, 0.0, 0.001]::DOUBLE[]) AS q, coalesce(measurement_model.vals, [1.0, 0.0]::DOUBLE[]) AS h, coalesce(measurement_noise.vals[1], 1.0) AS e,
    CASE WHEN len(control) = 1 AND len(control_function.vals) = 2 THEN control_function.vals[1] * control[1] ELSE 0.0 END AS u1, CASE WHEN len(control) = 1 AND len(control_function.vals) = 2 THEN control_function.vals[2] * control[1] ELSE 0.0 END AS u2 FROM o),
s AS (SELECT k, NULL::VARCHAR AS state_key, NULL::TIMESTAMP AS event_time, 0::BIGINT AS n, coalesce(initial_state.mean[1], 0.0) AS x, coalesce(initial_state.mean[2], 0.0) AS y, coalesce(initial_state.covariance.vals[1], 1.0) AS a, coalesce(initial_state.covariance.vals[3], 0.0) AS b, coalesce(initial_state.covariance.vals[4], 1.0) AS c FROM o WHERE n = 1
  UNION ALL SELECT k, state_key, event_time, n, CASE WHEN z IS NULL THEN x WHEN m = 1 THEN x + g1 * d ELSE x + k11 * (z[1] - x) + k12 * (z[2] - y) END, CASE WHEN z IS NULL THEN y WHEN m = 1 THEN y + g2 * d ELSE y + k12 * (z[1] - x) + k22 * (z[2] - y) END,
    CASE WHEN z IS NULL THEN a WHEN m = 1 THEN a - g1 * v1 ELSE a - k11 * a - k12 * b END, CASE WHEN z IS NULL THEN b WHEN m = 1 THEN b - g1 * v2 ELSE b - k11 * b - k12 * c END, CASE WHEN z IS NULL THEN c WHEN m = 1 THEN c - g2 * v2 ELSE c - k12 * b - k22 * c END
  FROM (SELECT *, v1 / (h[1] * v1 + h[2] * v2 + e) AS g1, v2 / (h[1] * v1 + h[2] * v2 + e) AS g2, z[1] - h[1] * x - h[2] * y AS d, (a * (c + 1) - b * b) / det AS k11, b / det AS k12, (c * (a + 1) - b * b) / det AS k22
    FROM (SELECT *, h[1] * a + h[2] * b AS v1, h[1] * b + h[2] * c AS v2, (a + 1) * (c + 1) - b * b AS det
      FROM (SELECT r.*, r.f[1] * s.x + r.f[3] * s.y + r.u1 AS x, r.f[2] * s.x + r.f[4] * s.y + r.u2 AS y, (r.f[1] * s.a + r.f[3] * s.b) * r.f[1] + (r.f[1] * s.b + r.f[3] * s.c) * r.f[3] + r.q[1] AS a,
          (r.f[1] * s.a + r.f[3] * s.b) * r.f[2] + (r.f[1] * s.b + r.f[3] * s.c) * r.f[4] + r.q[3] AS b, (r.f[2] * s.a + r.f[4] * s.b) * r.f[2] + (r.f[2] * s.b + r.f[4] * s.c) * r.f[4] + r.q[4] AS c FROM s JOIN r ON r.k = s.k AND r.n = s.n + 1))))
SELECT state_key, event_time, n AS state_index, CASE WHEN NOT isfinite(x) THEN NULL WHEN abs(x) < 1e4 THEN round(x, 6) ELSE round(log10(abs(x)), 6) END AS level, CASE WHEN NOT isfinite(y) THEN NULL WHEN abs(y) < 1e4 THEN round(y, 6) ELSE round(log10(abs(y)), 6) END AS slope, CASE WHEN NOT isfinite(a) THEN NULL WHEN abs(a) < 1e4 THEN round(a, 6) ELSE round(log10(abs(a)), 6) END AS p11 FROM s WHERE n > 0
"""


def rls_sensors(spark: SparkSession, d: str) -> DataFrame:
    """Recursive least squares over all of rls_input."""
    f = E.RecursiveLeastSquaresFilter(stateKeyCol="state_key", eventTimeCol="event_time", orderCol="record_id", initialStateDistributionCol="initial_state", featureSize=3)
    out = f.transform(table(spark, d, "rls_input"))
    return out.select("state_key", "event_time", F.col("stateIndex").alias("state_index"), F.round(F.get("state.mean", F.lit(0)), 4).alias("w0"), F.round(F.get("state.mean", F.lit(2)), 4).alias("w2"))


def _rls_sensors_sql() -> str:
    """The recursion of ``rls_sensors`` with lists: three coefficients and a matrix by columns."""
    p = lambda i, j: f"p[{1 + j * 3 + i}]"
    pu = [" + ".join(f"{p(i, j)} * u[{j + 1}]" for j in range(3)) for i in range(3)]
    up = [" + ".join(f"u[{i + 1}] * {p(i, j)}" for i in range(3)) for j in range(3)]
    w = ", ".join(f"w[{i + 1}] + g[{i + 1}] * e" for i in range(3))
    cov = ", ".join(f"{p(i, j)} - g[{i + 1}] * up[{j + 1}]" for j in range(3) for i in range(3))
    eye = ", ".join("1e5" if i == j else "0.0" for j in range(3) for i in range(3))
    return f"""WITH RECURSIVE a AS (SELECT *, coalesce(state_key, '') AS k, row_number() OVER (PARTITION BY state_key ORDER BY event_time NULLS FIRST, record_id) AS m FROM rls_input),
r AS (SELECT k, state_key, event_time, label, features AS u, row_number() OVER (PARTITION BY k ORDER BY m) AS n FROM a WHERE label IS NOT NULL AND len(features) = 3),
f AS (SELECT k, NULL::VARCHAR AS state_key, NULL::TIMESTAMP AS event_time, 0::BIGINT AS n, CASE WHEN len(initial_state.mean) = 3 THEN initial_state.mean ELSE [0.0, 0.0, 0.0]::DOUBLE[] END AS w, coalesce(initial_state.covariance.vals, [{eye}]::DOUBLE[]) AS p FROM a WHERE m = 1
  UNION ALL SELECT k, state_key, event_time, n, [{w}], [{cov}]
  FROM (SELECT *, [x / den FOR x IN pu] AS g, label - list_dot_product(u, w) AS e FROM (SELECT *, 1.0 + list_dot_product(u, pu) AS den FROM (SELECT *, [{", ".join(pu)}] AS pu, [{", ".join(up)}] AS up
    FROM (SELECT r.*, f.w, f.p FROM f JOIN r ON r.k = f.k AND r.n = f.n + 1)))))
SELECT state_key, event_time, n AS state_index, round(w[1], 4) AS w0, round(w[3], 4) AS w2 FROM f WHERE n > 0"""


def gmm_sensors(spark: SparkSession, d: str) -> DataFrame:
    """Online mixtures over all of gaussian_mixture_input with each row's step and minibatch sizes."""
    f = E.MultivariateGaussianMixture(stateKeyCol="state_key", eventTimeCol="event_time", orderCol="record_id", initialMixtureModelCol="initial_mixture_model", initialMeans=[[0.0, 0.0], [5.0, 5.0]], minibatchSizeCol="minibatch_size", updateHoldoutCol="update_holdout", stepSizeCol="step_size")
    out = f.transform(table(spark, d, "gaussian_mixture_input"))
    return out.select("state_key", "event_time", F.col("stateIndex").alias("state_index"), F.size("mixtureModel.weights").alias("components"), "loglikelihood")


ekf_events, ukf_events, ukf_julier_events, ckf_events = _plain(E.ExtendedKalmanFilter), _plain(E.UnscentedKalmanFilter), _plain(E.UnscentedKalmanFilter, sigmaPoints="julier"), _plain(E.CubatureKalmanFilter)
_ALL = {
    "lms_events": (lms_events, LMS),
    "rls_events": (rls_events, RLS),
    "lkf_events": (lkf_events, LKF),
    "lkf_trend_events": (lkf_trend_events, LKF_TREND),
    "lkf_pair_events": (_pair(E.LinearKalmanFilter), PAIR),
    "ekf_pair_events": (_pair(E.ExtendedKalmanFilter), PAIR),
    "ukf_pair_events": (_pair(E.UnscentedKalmanFilter), PAIR),
    "ukf_julier_pair_events": (_pair(E.UnscentedKalmanFilter, sigmaPoints="julier"), PAIR),
    "ckf_pair_events": (_pair(E.CubatureKalmanFilter), PAIR),
    "lkf_control_events": (lkf_control_events, LKF_CONTROL),
    "ekf_events": (ekf_events, PLAIN),
    "ekf_log_events": (ekf_log_events, EKF_LOG),
    "ukf_events": (ukf_events, PLAIN),
    "ukf_julier_events": (ukf_julier_events, PLAIN),
    "ckf_events": (ckf_events, PLAIN),
    "multi_step_events": (multi_step_events, MULTI_STEP),
    "mmae_events": (mmae_events, MMAE),
    "smoother_events": (smoother_events, SMOOTHER),
    "poisson_events": (poisson_events, POISSON),
    "bernoulli_events": (bernoulli_events, BERNOULLI),
    "gaussian_mixture_events": (gaussian_mixture_events, GAUSSIAN),
    "poisson_minibatch_events": (poisson_minibatch_events, _minibatch_sql()),
    "batch_em_events": (batch_em_events, _batch_em_sql(3)),
    "vector_functions": (vector_functions, VECTOR_FUNCTIONS),
    "vector_aggregate": (vector_aggregate, VECTOR_AGGREGATE),
    "matrix_functions": (matrix_functions, _matrix_sql()),
    "latest_state": (latest_state, LATEST_STATE),
    "lkf_sensors": (lkf_sensors, LKF_SENSORS),
    "rls_sensors": (rls_sensors, _rls_sensors_sql()),
    "gmm_sensors": (gmm_sensors, None),
}
QUERIES = {n: q for n, (q, _) in _ALL.items()}
SQL = {n: s for n, (_, s) in _ALL.items() if s}

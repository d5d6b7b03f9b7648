"""Linear, extended, unscented and cubature Kalman filters, and the fixed-lag smoother."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell import runtime
from driftwell.estimators.base import GAU_DDL, KeyedTransformer, gaussian_column, matrix_column, vector_column
from driftwell.estimators.params import Spec, as_function, as_matrix, as_size, as_vector, between, declare, one_of
from driftwell.functions.aggregates import weighted_mean_array
from driftwell.kernels import kalman
from driftwell.kernels.linalg import gaussian_logpdf, squared_mahalanobis

_VECTORS = {"z": "vector", "u": "vector", "F": "matrix", "Q": "matrix", "H": "matrix", "R": "matrix", "B": "matrix"}


class KalmanModel(runtime.KeyedModel):
    """State: mean, covariance, index, last log-likelihoods, adapted process noise."""

    def __init__(self, core: kalman.Linear, constants: dict[str, Any], given: set[str], size: int | None, window: int, steps: int, likelihood: bool, matrices: bool, lag: int = 0) -> None:
        self.core, self.constants, self.size, self.window, self.steps, self.likelihood, self.matrices, self.lag = core, constants, size, window, steps, likelihood, matrices, lag
        self.columns = {k: v for k, v in _VECTORS.items() if k in given} | {k: "object" for k in ("x0", "P0", "initial") if k in given}
        if lag:
            self.output = [pa.field("stateIndex", pa.int64()), pa.field("stepIndex", pa.int64()), pa.field("state", runtime.GAU), pa.field("rtsGain", runtime.MAT)]
            return
        self.output = [pa.field("stateIndex", pa.int64()), pa.field("stepIndex", pa.int64()), pa.field("state", runtime.GAU)]
        if likelihood:
            self.output += [pa.field("residual", runtime.GAU), pa.field("loglikelihood", pa.float64()), pa.field("mahalanobis", pa.float64()), pa.field("slidingLikelihood", pa.float64())]
        if matrices:
            self.output += [pa.field("processModel", runtime.MAT), pa.field("processNoise", runtime.MAT), pa.field("measurement", pa.list_(pa.float64())), pa.field("measurementModel", runtime.MAT)]

    def _state_size(self, rows, first) -> int:
        if self.size:
            return self.size
        for v in (self.constants.get("x0"), self.constants.get("P0"), self.constants.get("F")):
            if v is not None:
                return len(v)
        for x in first.get("initial", []):
            if x is not None and x["mean"] is not None:
                return len(x["mean"])
        for x in first.get("x0", []):
            if x is not None:
                return len(x)
        for k in ("F", "Q"):
            if k in rows and rows[k].size:
                return rows[k].shape[1]
        if self.constants.get("H") is not None:
            return len(self.constants["H"][0])
        if "H" in rows and rows["H"].size:
            return rows["H"].shape[2]
        return max(1, rows["z"].shape[1])

    def kind_of(self, first):
        x = first.get("initial")
        mean = x["mean"] if x is not None else first.get("x0")
        return 0 if mean is None or self.size else len(mean)

    def begin(self, rows, first, n):
        size = self._state_size(rows, first)
        base = {k: np.asarray(self.constants[k], float) if self.constants.get(k) is not None else d for k, d in (("x0", np.zeros(size)), ("P0", np.eye(size)))}
        state = {"index": np.zeros(n, np.int64), "x": np.tile(base["x0"], (n, 1)), "P": np.tile(base["P0"], (n, 1, 1))}

        def put(g: int, mean: Any, cov: Any) -> None:
            if mean is not None and len(mean) == size:
                state["x"][g] = mean
            if cov is not None and len(cov["values"]) == size * size:
                state["P"][g] = np.asarray(cov["values"], float).reshape(size, size).T

        for g in range(n):
            if "initial" in first:
                if first["initial"][g] is not None:
                    put(g, first["initial"][g]["mean"], first["initial"][g]["covariance"])
            else:
                put(g, first["x0"][g] if "x0" in first else None, first["P0"][g] if "P0" in first else None)
        if self.likelihood:
            state["ll"], state["nll"] = np.zeros((n, self.window)), np.zeros(n, np.int64)
        if getattr(self.core, "adaptive", False):
            state["Q"], state["Q?"] = np.zeros((n, size, size)), np.zeros(n, bool)
        if self.lag:
            k = self.lag
            state |= {"qx": np.zeros((n, k, size)), "qP": np.zeros((n, k, size, size)), "qF": np.zeros((n, k, size, size)), "qQ": np.zeros((n, k, size, size)), "qi": np.zeros((n, k), np.int64), "qn": np.zeros(n, np.int64)}
        return state

    def _free(self, k: str) -> bool:
        """Whether a model may have another shape than its default, for user functions to take."""
        names = {"F": ("process_fn",), "H": ("measurement_fn",), "Q": ("process_noise_jacobian",), "R": ("measurement_noise_jacobian",)}[k]
        return any(getattr(self.core, n, None) is not None for n in names)

    def _row(self, rows: dict[str, Any], n: int, size: int) -> dict[str, np.ndarray]:
        m = rows["z"].shape[1]
        default = {"F": np.eye(size), "Q": np.eye(size), "H": np.eye(m, size), "R": np.eye(m)}
        out = {}
        for k, d in default.items():
            c = d if self.constants.get(k) is None else np.asarray(self.constants[k], float)
            full = np.broadcast_to(c, (n, *c.shape))
            if k in rows and rows[k].size:
                ok = rows[f"{k}?"]
                if rows[k].shape[1:] == c.shape:
                    full = rows[k] if ok.all() else np.where(ok[:, None, None], rows[k], full)
                elif self._free(k) and ok.all():  # functions may take models of any shape
                    full = rows[k]
            out[k] = full
        if "u" in rows and "B" in rows and rows["u"].shape[1] and rows["B"].shape[2] == rows["u"].shape[1]:
            ok = rows["u?"] & rows["B?"]
            out["u"], out["B"] = rows["u"] * ok[:, None], rows["B"]
        out["z"] = rows["z"]
        return out

    def step(self, state, rows):
        n, size = state["x"].shape
        row = self._row(rows, n, size)
        q = np.where(state["Q?"][:, None, None], state["Q"], row["Q"]) if "Q" in state else None
        with np.errstate(all="ignore"):
            x, p = self.core.predict(state["x"], state["P"], row, q)
        seen = rows["z?"]
        m = row["z"].shape[1]
        r, s = np.zeros((n, m)), np.zeros((n, m, m))
        at = np.flatnonzero(seen)
        if len(at):
            part = {k: v[at] for k, v in row.items()}
            with np.errstate(all="ignore"):
                x[at], p[at], r[at], s[at], adapted = self.core.estimate(x[at], p[at], part)
            if adapted is not None:
                jump, w, extra = adapted
                old = q[at]
                state["Q"][at] = (1 - w)[:, None, None] * old + w[:, None, None] * extra
                state["Q?"][at] = jump
        state["x"][:], state["P"][:] = x, p
        state["index"][:] += 1
        if self.lag:
            return self._smoothed(state, row)
        out = {"stateIndex": state["index"].copy(), "stepIndex": np.zeros(n, np.int64), "state": (x.copy(), p.copy())}
        if self.likelihood:
            ll = np.full(n, np.nan)
            if len(at):
                ll[at] = gaussian_logpdf(r[at], np.zeros((len(at), m)), s[at])
                state["ll"][at] = np.concatenate([state["ll"][at][:, 1:], ll[at][:, None]], axis=1)
                state["nll"][at] = np.minimum(state["nll"][at] + 1, self.window)
            any_ = state["nll"] > 0
            with np.errstate(all="ignore"):
                sliding = np.exp(state["ll"].sum(axis=1))
            maha = np.full(n, np.nan)
            if len(at):
                with np.errstate(all="ignore"):
                    maha[at] = np.sqrt(squared_mahalanobis(r[at], s[at]))
            out |= {"residual": (r, s, seen), "loglikelihood": (ll, seen), "mahalanobis": (maha, seen), "slidingLikelihood": (sliding, any_)}
        everyone = np.arange(n)
        blocks = [(everyone, out | self._matrices(x, row, rows, q))]
        for k in range(1, self.steps + 1):
            with np.errstate(all="ignore"):
                x, p = self.core.predict(x, p, row, q)
            ahead = {"stateIndex": state["index"] + k, "stepIndex": np.full(n, k, np.int64), "state": (x.copy(), p.copy())}
            if self.likelihood:
                no = np.zeros(n, bool)
                ahead |= {"residual": (r, s, no), "loglikelihood": (ll, no), "mahalanobis": (maha, no), "slidingLikelihood": (sliding, any_)}
            blocks.append((everyone, ahead | self._matrices(x, row, rows, q)))
        return blocks

    def _matrices(self, x, row, rows, q) -> dict[str, Any]:
        if not self.matrices:
            return {}
        return {"processModel": self.core.process_model(x, row), "processNoise": self.core.process_noise(x, row), "measurement": (rows["z"], rows["z?"]), "measurementModel": self.core.measurement_model(x, row)}

    def _smoothed(self, state, row):
        for name, new in (("qx", state["x"]), ("qP", state["P"]), ("qF", self.core.process_model(state["x"], row)), ("qQ", row["Q"]), ("qi", state["index"])):
            state[name][:] = np.concatenate([state[name][:, 1:], new[:, None]], axis=1)
        state["qn"][:] = np.minimum(state["qn"] + 1, self.lag)
        at = np.flatnonzero(state["qn"] == self.lag)
        if not len(at):
            return []
        with np.errstate(all="ignore"):
            x, p, g = kalman.smooth(state["qx"][at], state["qP"][at], state["qF"][at], state["qQ"][at])
        return [(at, {"stateIndex": state["qi"][at, k].copy(), "stepIndex": np.full(len(at), self.lag - 1 - k, np.int64), "state": (x[:, k], p[:, k]), "rtsGain": g[:, k]}) for k in range(self.lag)]

    def encode(self, name, parts):
        if name in ("stateIndex", "stepIndex"):
            return pa.array(np.concatenate(parts))
        if name in ("state", "residual"):
            ok = np.concatenate([p[2] for p in parts]) if name == "residual" else None
            return runtime.gaussian_array(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), ok)
        if name in ("loglikelihood", "mahalanobis", "slidingLikelihood"):
            ok = np.concatenate([p[1] for p in parts])
            return pa.array(np.concatenate([p[0] for p in parts]), mask=~ok)
        if name == "measurement":
            return runtime.list_array(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return runtime.matrix_array(np.concatenate(parts))


@declare(
    Spec("stateSize", as_size, doc="Size of the state"),
    Spec("measurementSize", as_size, doc="Size of the measurement"),
    Spec("initialStateMean", as_vector, doc="Initial mean; zeros by default"),
    Spec("initialStateCovariance", as_matrix, doc="Initial covariance; identity by default"),
    Spec("processModel", as_matrix, doc="State transition; identity by default"),
    Spec("processNoise", as_matrix, doc="Covariance of the process noise; identity by default"),
    Spec("measurementModel", as_matrix, doc="Measurement matrix (measurement x state); identity by default"),
    Spec("measurementNoise", as_matrix, doc="Covariance of the measurement noise; identity by default"),
    Spec("fadingFactor", between(1.0, float("inf")), 1.0, "Factor of the covariance's root in predict, at least 1"),
    Spec("initialStateMeanCol", str, doc="Column of initial means, read at a key's first row"),
    Spec("initialStateCovarianceCol", str, doc="Column of initial covariances, read at a key's first row"),
    Spec("initialStateDistributionCol", str, doc="Struct column of mean and covariance, read at a key's first row"),
    Spec("measurementCol", str, "measurement", "Column of the measurement; null: predict only"),
    Spec("processModelCol", str, doc="Column of state transitions"),
    Spec("processNoiseCol", str, doc="Column of process noise"),
    Spec("measurementModelCol", str, doc="Column of measurement matrices"),
    Spec("measurementNoiseCol", str, doc="Column of measurement noise"),
    Spec("controlCol", str, doc="Column of control vectors"),
    Spec("controlFunctionCol", str, doc="Column of control matrices"),
    Spec("calculateLoglikelihood", bool, False, "Emit the residual's log-likelihood", ("setCalculateLogLikelihood",)),
    Spec("calculateMahalanobis", bool, False, "Emit the residual's Mahalanobis distance"),
    Spec("calculateSlidingLikelihood", bool, False, "Emit the likelihood of the last residuals"),
    Spec("slidingLikelihoodWindow", between(1, 10**6, int), 1, "Residuals of the sliding likelihood"),
    Spec("multiStepPredict", as_size, 0, "Predictions beyond each row"),
    Spec("outputSystemMatrices", bool, False, "Emit models, noise and measurement"),
    Spec("multipleModelAdaptiveEstimationEnabled", bool, False, "Average the keys' filters by sliding likelihood", ("setEnableMultipleModelAdaptiveEstimation",)),
    Spec("multipleModelMeasurementWindowDuration", str, doc="Event-time window of that average", also=("setMultipleModelMeasurementWindow",)),
)
class _Kalman(KeyedTransformer):
    _COLUMNS = {"F": ("processModelCol", matrix_column), "Q": ("processNoiseCol", matrix_column), "H": ("measurementModelCol", matrix_column), "R": ("measurementNoiseCol", matrix_column), "u": ("controlCol", vector_column), "B": ("controlFunctionCol", matrix_column), "x0": ("initialStateMeanCol", vector_column), "P0": ("initialStateCovarianceCol", matrix_column), "initial": ("initialStateDistributionCol", gaussian_column)}

    def core(self) -> kalman.Linear:
        """The numeric filter."""
        raise NotImplementedError

    def inputs(self, df: DataFrame) -> dict[str, Column]:
        out = {"z": vector_column(df, self.opt("measurementCol"))}
        return out | {k: f(df, self.opt(p)) for k, (p, f) in self._COLUMNS.items() if self.isSet(getattr(self, p))}

    def _options(self, likelihood: bool, lag: int = 0) -> dict[str, Any]:
        constants = {"x0": self.opt("initialStateMean"), "P0": self.opt("initialStateCovariance"), "F": self.opt("processModel"), "Q": self.opt("processNoise"), "H": self.opt("measurementModel"), "R": self.opt("measurementNoise")}
        given = {"z", *(k for k, (p, _) in self._COLUMNS.items() if self.isSet(getattr(self, p)))}
        return {"constants": constants, "given": given, "size": self.opt("stateSize"), "window": self.opt("slidingLikelihoodWindow"), "steps": 0 if lag else self.opt("multiStepPredict"), "likelihood": likelihood, "matrices": self.opt("outputSystemMatrices") and not lag, "lag": lag}

    def _wants_likelihood(self) -> bool:
        return bool(self.opt("calculateLoglikelihood") or self.opt("calculateMahalanobis") or self.opt("calculateSlidingLikelihood"))

    def model(self) -> runtime.KeyedModel:
        return KalmanModel(self.core(), **self._options(self._wants_likelihood()))

    @property
    def hands_watermark_on(self) -> bool:
        return bool(self.opt("multipleModelAdaptiveEstimationEnabled") and self.isSet(self.multipleModelMeasurementWindowDuration))

    def _check(self, df: DataFrame) -> None:
        super()._check(df)
        if self.opt("multipleModelAdaptiveEstimationEnabled"):
            if not self.opt("calculateSlidingLikelihood"):
                raise ValueError("multiple-model estimation needs calculateSlidingLikelihood")
            if not self.opt("stateSize"):
                raise ValueError("multiple-model estimation needs stateSize")

    def finish(self, df: DataFrame) -> DataFrame:
        for flag, col in (("calculateLoglikelihood", "loglikelihood"), ("calculateMahalanobis", "mahalanobis"), ("calculateSlidingLikelihood", "slidingLikelihood")):
            if not self.opt(flag):
                df = df.drop(col)
        return self.formatted(self._averaged(df) if self.opt("multipleModelAdaptiveEstimationEnabled") else df)

    def _averaged(self, df: DataFrame) -> DataFrame:
        """Means and covariances over the keys, weighted by sliding likelihood, per state index (and window)."""
        n = self.opt("stateSize")
        keys = [F.col("stateIndex")]
        if self.isSet(self.multipleModelMeasurementWindowDuration):
            time = self.opt("eventTimeCol")
            keys.insert(0, F.window(time, self.opt("multipleModelMeasurementWindowDuration")).alias(time))
        w = F.col("slidingLikelihood")
        mean = weighted_mean_array(w, F.col("state.mean"), n)
        cov = weighted_mean_array(w, F.col("state.covariance.values"), n * n)
        out = df.where("stepIndex = 0").groupBy(*keys).agg(mean.alias("_m"), cov.alias("_c"))
        state = F.struct(F.col("_m").alias("mean"), F.struct(F.lit(n).alias("numRows"), F.lit(n).alias("numCols"), F.col("_c").alias("values")).alias("covariance")).cast(GAU_DDL)
        return out.withColumn("state", state).drop("_m", "_c")


@declare(Spec("parallelChunkRows", as_size, 0, "Rows of a key that one task filters (0: the whole key), see ``parallel``"))
class LinearKalmanFilter(_Kalman):
    """Linear Kalman filter per key, with Joseph-form update, control, fading memory and missing measurements.

    Output: key, ``stateIndex``, ``stepIndex`` (0, or 1.. for multi-step predictions), ``state`` (mean, covariance), and by
    option ``residual``, ``loglikelihood``, ``mahalanobis``, ``slidingLikelihood`` and the system matrices; event time. A null
    measurement (or one of another size than the key's others) only predicts; residual and its scores are null then.
    Model columns that are null or of a wrong shape in a row fall back to the constant parameter or its default there.

    ``parallelChunkRows`` splits long keys of a batch table over tasks (``estimators.parallel``); it needs ``stateSize``, and
    neither fading nor sliding likelihood.
    """

    default_key = "filter.linearKalman"

    def run(self, rows: DataFrame, model: runtime.KeyedModel) -> DataFrame:
        size = self.opt("parallelChunkRows")
        if not size:
            return super().run(rows, model)
        if not self.opt("stateSize") or self.opt("fadingFactor") != 1.0 or self.opt("calculateSlidingLikelihood"):
            raise ValueError("parallelChunkRows needs stateSize, and neither fading nor sliding likelihood")
        from driftwell.estimators.parallel import filter_in_chunks

        return filter_in_chunks(rows, lambda cls, extra: cls(self.core(), **(self._options(self._wants_likelihood()) | {"given": set(model.columns) | extra})), size)

    def core(self) -> kalman.Linear:
        return kalman.Linear(self.opt("fadingFactor"))




@declare(*(Spec(n, as_function, doc=d) for n, d in (("processFunction", "(state, model) -> next state"), ("processStateJacobian", "(state, model) -> matrix"), ("processNoiseJacobian", "(state, noise) -> matrix"), ("measurementFunction", "(state, model) -> measurement"), ("measurementStateJacobian", "(state, model) -> matrix"), ("measurementNoiseJacobian", "(state, noise) -> matrix"))))
class ExtendedKalmanFilter(_Kalman):
    """First-order filter for nonlinear process and measurement functions on numpy arrays; what isn't given is linear."""

    default_key = "filter.extendedKalman"

    def core(self) -> kalman.Linear:
        return kalman.Extended(self.opt("fadingFactor"), self.opt("processFunction"), self.opt("processStateJacobian"), self.opt("processNoiseJacobian"), self.opt("measurementFunction"), self.opt("measurementStateJacobian"), self.opt("measurementNoiseJacobian"))


@declare(
    Spec("processFunction", as_function, doc="(state, model) -> next state"),
    Spec("measurementFunction", as_function, doc="(state, model) -> measurement"),
    Spec("sigmaPoints", one_of("merwe", "julier"), "merwe", "Sigma-point algorithm"),
    Spec("merweAlpha", float, 0.3, "Spread of the points"),
    Spec("merweBeta", float, 2.0, "Prior knowledge of the distribution; 2 for Gaussians"),
    Spec("merweKappa", float, 0.1, "Secondary scaling"),
    Spec("julierKappa", float, 1.0, "Scaling of Julier's points"),
    Spec("stateLowerBound", as_vector, doc="Least values of sigma points", also=("setSigmaPointLowerBound", "setSigmaPointsLowerBound", "setLowerBound")),
    Spec("stateUpperBound", as_vector, doc="Greatest values of sigma points", also=("setSigmaPointUpperBound", "setSigmaPointsUpperBound", "setUpperBound")),
    Spec("adaptiveProcessNoise", bool, False, "Raise the process noise after outlying residuals", ("setEnableAdaptiveProcessNoise",)),
    Spec("adaptiveProcessNoiseThreshold", float, 2.0, "Squared Mahalanobis distance from which noise adapts"),
    Spec("adaptiveProcessNoiseLambda", between(0.0, 1.0), 0.9, "Least weight of the adaptation"),
    Spec("adaptiveProcessNoiseAlpha", float, 1.0, "Factor of the threshold in the weight"),
)
class UnscentedKalmanFilter(_Kalman):
    """Sigma-point filter: Merwe or Julier points, optional bounds, optional adaptive process noise."""

    default_key = "filter.unscentedKalman"

    def core(self) -> kalman.Linear:
        bound = lambda n: None if self.opt(n) is None else np.asarray(self.opt(n))
        return kalman.Unscented(self.opt("fadingFactor"), self.opt("processFunction"), self.opt("measurementFunction"), self.opt("sigmaPoints"), self.opt("merweAlpha"), self.opt("merweBeta"), self.opt("merweKappa"), self.opt("julierKappa"), bound("stateLowerBound"), bound("stateUpperBound"), self.opt("adaptiveProcessNoise"), self.opt("adaptiveProcessNoiseThreshold"), self.opt("adaptiveProcessNoiseLambda"), self.opt("adaptiveProcessNoiseAlpha"))


@declare(Spec("processFunction", as_function, doc="(state, model) -> next state"), Spec("measurementFunction", as_function, doc="(state, model) -> measurement"))
class CubatureKalmanFilter(_Kalman):
    """Third-degree cubature filter."""

    default_key = "filter.cubatureKalman"

    def core(self) -> kalman.Linear:
        return kalman.Cubature(self.opt("fadingFactor"), self.opt("processFunction"), self.opt("measurementFunction"))


@declare(Spec("fixedLag", between(2, 10**6, int), 2, "States smoothed together, at least 2"))
class LinearKalmanSmoother(_Kalman):
    """Fixed-lag Rauch-Tung-Striebel smoother on the linear filter, in one pass: filter and window share a state.

    Once a key has ``fixedLag`` rows, each row emits the smoothed window, oldest first: ``stateIndex``, ``stepIndex`` (0 for the
    newest), ``state``, ``rtsGain`` (0 for the newest); event time is that of the newest row.
    """

    default_key = "smoother.linearKalman"

    def core(self) -> kalman.Linear:
        return kalman.Linear(self.opt("fadingFactor"))

    def model(self) -> runtime.KeyedModel:
        return KalmanModel(self.core(), **self._options(False, self.opt("fixedLag")))

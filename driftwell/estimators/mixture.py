"""Gaussian, Poisson and Bernoulli mixtures by online and batch expectation-maximisation."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell import runtime
from driftwell.estimators.base import KeyedTransformer, matrix_column, vector_column
from driftwell.estimators.params import Spec, as_size, as_vector, as_vectors, between, declare
from driftwell.kernels import mixture as em
from driftwell.session import stage

_DIST = {"gaussian": runtime.GAU, "poisson": pa.struct([("rate", pa.float64())]), "bernoulli": pa.struct([("probability", pa.float64())])}
_NAME = {"poisson": "rate", "bernoulli": "probability"}


def _arrow_model(family: str) -> pa.DataType:
    return pa.struct([("weights", pa.list_(pa.float64())), ("distributions", pa.list_(_DIST[family]))])


class MixtureModel(runtime.KeyedModel):
    """State: index, minibatch buffer, summary and model. Rows without sample are skipped."""

    def __init__(self, family: str, o: dict[str, Any], given: set[str]) -> None:
        self.family, self.o = family, o
        self.columns = {"x": "vector" if family == "gaussian" else "double"}
        self.columns |= {c: "double" for c in ("step", "batch", "hold") if c in given} | {c: "object" for c in ("model", "weights", "a", "b") if c in given}
        self.output = [pa.field("stateIndex", pa.int64()), pa.field("mixtureModel", _arrow_model(family)), pa.field("loglikelihood", pa.float64())]

    def _initial(self, first: dict[str, list], g: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        o = self.o
        m = first["model"][g] if "model" in first else None
        if m is not None and m["distributions"]:
            w = m["weights"]
            if self.family == "gaussian":
                d = len(m["distributions"][0]["mean"])
                return np.asarray(w, float), {"mean": np.array([x["mean"] for x in m["distributions"]], float), "cov": np.array([np.reshape(x["covariance"]["values"], (d, d)).T for x in m["distributions"]], float)}
            return np.asarray(w, float), {self._param: np.array([x[_NAME[self.family]] for x in m["distributions"]], float)}
        pick = lambda name, const: first[name][g] if name in first and first[name][g] is not None else o[const]
        a = pick("a", "a")
        if a is None:
            raise ValueError("the mixture has no initial parameters")
        k = len(a)
        w = pick("weights", "weights") or [1.0 / k] * k
        if self.family != "gaussian":
            return np.asarray(w, float), {self._param: np.asarray(a, float)}
        mean = np.asarray(a, float)
        d, b = mean.shape[1], pick("b", "b")
        cov = np.tile(np.eye(d), (k, 1, 1)) if b is None else np.array([np.reshape(c, (d, d)).T for c in b], float)
        return np.asarray(w, float), {"mean": mean, "cov": cov}

    @property
    def _param(self) -> str:
        return "rate" if self.family == "poisson" else "p"

    def begin(self, rows, first, n):
        made = [self._initial(first, g) for g in range(n)]
        width = (rows["x"].shape[1],) if self.family == "gaussian" else ()
        weights = np.stack([w for w, _ in made])
        params = {k: np.stack([p[k] for _, p in made]) for k in made[0][1]}
        summary = em.scaled(params, weights)
        state = {"index": np.zeros(n, np.int64), "n": np.zeros(n, np.int64), "w": weights, "sw": weights.copy(), "buffer": np.zeros((n, self._room, *width))}
        return state | {f"m_{k}": v for k, v in params.items()} | {f"s_{k}": v for k, v in summary.items()}

    def kind_of(self, first):
        m = first.get("model")
        if m is not None and m["distributions"]:
            return len(m["distributions"]) * 1000 + (len(m["distributions"][0]["mean"]) if self.family == "gaussian" else 0)
        a = first.get("a") or self.o["a"]
        return 0 if a is None else len(a) * 1000 + (len(a[0]) if self.family == "gaussian" else 0)

    def resume(self, carry):
        state = super().resume(carry)
        held = state["buffer"]
        if held.shape[1] < self._room:
            state["buffer"] = np.concatenate([held, np.zeros((1, self._room - held.shape[1], *held.shape[2:]))], axis=1)
        return state

    def _lockstep(self, part, size, starts, sizes, carry):
        # The buffer must be as long as the longest minibatch that can fill up here.
        b = self.o["batch"] if "batch" not in part else max([int(v) for v in part["batch"].to_pylist() if v is not None] + [self.o["batch"]])
        held = int(carry["n"][0]) if carry is not None else 0
        self._room = max(1, min(b, int(np.max(sizes)) + held))
        return super()._lockstep(part, size, starts, sizes, carry)

    def step(self, state, rows):
        o = self.o
        at = np.flatnonzero(rows["x?"])
        if not len(at):
            return []
        pick = lambda c: np.where(rows[f"{c}?"][at], rows[c][at], o[c]) if c in rows else np.full(len(at), o[c], float)
        batch, hold = pick("batch"), pick("hold")
        buffer = state["buffer"]
        n = state["n"][at]
        if int(n.max()) >= buffer.shape[1]:
            raise RuntimeError("minibatch buffer too short")
        buffer[at, n] = rows["x"][at]
        state["n"][at] += 1
        due = at[state["n"][at] >= batch]
        if not len(due):
            return []
        local = np.flatnonzero(state["n"][at] >= batch)
        gamma = (2.0 + state["index"][due]) ** -o["decay"] if o["decay"] is not None else pick("step")[local]
        names = [k[2:] for k in state if k.startswith("m_")]
        ll = np.zeros(len(due))
        for size in np.unique(state["n"][due]):  # keys with minibatches of one size together
            sel = state["n"][due] == size
            g = due[sel]
            samples = buffer[g, :size]
            model = (state["w"][g], {k: state[f"m_{k}"][g] for k in names})
            summary = em.em_step(self.family, samples, (state["sw"][g], {k: state[f"s_{k}"][g] for k in names}), model, gamma[sel], o["chained"])
            fresh = em.from_summary(summary, model[1])
            held = (state["index"][g] < hold[local][sel])
            state["sw"][g] = summary[0]
            state["w"][g] = np.where(held[:, None], model[0], fresh[0])
            for k in names:
                state[f"s_{k}"][g] = summary[1][k]
                state[f"m_{k}"][g] = np.where(held.reshape((-1,) + (1,) * (fresh[1][k].ndim - 1)), model[1][k], fresh[1][k])
            ll[sel] = em.mixture_loglikelihood(self.family, samples, state["w"][g], {k: state[f"m_{k}"][g] for k in names})
        state["index"][due] += 1
        state["n"][due] = 0
        return [(due, {"stateIndex": state["index"][due], "mixtureModel": (state["w"][due], {k: state[f"m_{k}"][due] for k in names}), "loglikelihood": ll})]

    def encode(self, name, parts):
        if name != "mixtureModel":
            return pa.array(np.concatenate(parts))
        chunks = []
        for w, params in parts:
            n, k = w.shape
            if self.family == "gaussian":
                d = params["mean"].shape[2]
                dist = runtime.gaussian_array(params["mean"].reshape(n * k, d), params["cov"].reshape(n * k, d, d))
            else:
                dist = pa.StructArray.from_arrays([pa.array(params[self._param].ravel())], fields=list(_DIST[self.family]))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * k)
            chunks.append(pa.StructArray.from_arrays([runtime.list_array(w), pa.ListArray.from_arrays(offsets, dist)], fields=list(_arrow_model(self.family))))
        return pa.concat_arrays(chunks)


@declare(
    Spec("mixtureCount", between(1, 10**6, int), doc="Number of components"),
    Spec("sampleCol", str, "sample", "Column of the samples"),
    Spec("initialWeights", as_vector, doc="Initial weights; equal by default"),
    Spec("initialWeightsCol", str, doc="Column of initial weights, read at a key's first row"),
    Spec("initialMixtureModelCol", str, doc="Struct column of weights and distributions, read at a key's first row"),
    Spec("stepSize", between(0.0, 1.0), 0.01, "Weight of a minibatch in the summary"),
    Spec("stepSizeCol", str, doc="Column of step sizes"),
    Spec("decayRate", between(0.0, 1.0), doc="Step size (2 + index)^-rate instead"),
    Spec("minibatchSize", between(1, 10**9, int), 1, "Samples of an update"),
    Spec("minibatchSizeCol", str, doc="Column of minibatch sizes"),
    Spec("updateHoldout", as_size, 0, "Updates that leave the parameters alone"),
    Spec("updateHoldoutCol", str, doc="Column of such"),
    Spec("batchTrainEnabled", bool, False, "Batch EM over the whole table", ("setEnableBatchEM", "setEnableBatchTrain")),
    Spec("batchTrainMaxIter", between(1, 10**6, int), 30, "Most iterations of batch EM"),
    Spec("batchTrainTol", float, 0.1, "Gain in log-likelihood below which batch EM ends"),
    Spec("chainedLogSum", bool, False, "Responsibilities by chained logarithms, exact for two components only"),
)
class _Mixture(KeyedTransformer):
    family = ""
    first = ("", "")  #: parameter and column of the first initial parameter

    def _given(self) -> dict[str, str]:
        names = {"step": "stepSizeCol", "batch": "minibatchSizeCol", "hold": "updateHoldoutCol", "weights": "initialWeightsCol", "model": "initialMixtureModelCol", "a": self.first[1], "b": "initialCovariancesCol"}
        return {k: self.opt(c) for k, c in names.items() if c in self._specs and self.isSet(getattr(self, c))}

    def _model_column(self, df: DataFrame, name: str) -> Column:
        kind = df.schema[name].dataType
        ok = isinstance(kind, T.StructType) and [f.name for f in kind.fields] == ["weights", "distributions"] and isinstance(kind["distributions"].dataType, T.ArrayType)
        if not ok:
            raise ValueError(f"{name} must be a struct of weights and distributions")
        col = F.col(name)
        if self.family != "gaussian":
            return col
        part = kind["distributions"].dataType.elementType
        a, b = part.fields[:2]
        dists = F.transform(col["distributions"], lambda x: F.struct(vector_column(df, x[a.name], a.dataType).alias("mean"), matrix_column(df, x[b.name], b.dataType).alias("covariance")))
        return F.when(col.isNotNull(), F.struct(col["weights"].cast("array<double>").alias("weights"), dists.alias("distributions")))

    def sample(self, df: DataFrame) -> Column:
        return F.col(self.opt("sampleCol")).cast("double")

    def inputs(self, df: DataFrame) -> dict[str, Column]:
        out = {"x": self.sample(df)}
        for k, c in self._given().items():
            out[k] = self._model_column(df, c) if k == "model" else F.col(c).cast("double") if k in ("step", "batch", "hold") else F.col(c)
        return out

    def model(self, **changes: Any) -> runtime.KeyedModel:
        a = self.opt(self.first[0])
        o = {"step": self.opt("stepSize"), "decay": self.opt("decayRate"), "batch": self.opt("minibatchSize"), "hold": self.opt("updateHoldout"), "weights": self.opt("initialWeights"), "a": a, "b": self.opt("initialCovariances") if "initialCovariances" in self._specs else None, "chained": self.opt("chainedLogSum")} | changes
        given = set(self._given())
        return MixtureModel(self.family, o, given)

    def _check(self, df: DataFrame) -> None:
        super()._check(df)
        if not self.isSet(self.initialMixtureModelCol) and self.opt(self.first[0]) is None and not self.isSet(getattr(self, self.first[1])):
            raise ValueError(f"one of {self.first[0]}, {self.first[1]}, initialMixtureModelCol is needed")

    def finish(self, df: DataFrame) -> DataFrame:
        return self.formatted(df)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.opt("batchTrainEnabled"):
            return super()._transform(dataset)
        if dataset.isStreaming:
            raise ValueError("batch EM needs a batch table")
        self._check(dataset)
        return self._batch_em(dataset)

    def _batch_em(self, df: DataFrame) -> DataFrame:
        """Passes of one step per key over all its samples, until the summed log-likelihood gains too little.

        A pass joins every sample with its key's model and folds the responsibilities to sums per Arrow batch and key, which are added up
        by key, so a hot key is shared by all tasks and samples are never shuffled. The models, one row per key, are
        written after each pass; the driver sees one number per pass. Rows with a null key or sample take no part.
        """
        key = self.opt("stateKeyCol") or "stateKey"
        keyed = df if self.isSet(self.stateKeyCol) else df.withColumn(key, F.lit(self.default_key))
        given = {k: c for k, c in self._given().items() if k not in ("batch", "hold")}
        inputs = self.inputs(keyed)
        rows = keyed.select(F.col(key).alias("key"), inputs["x"].alias("x"), *(inputs[k].alias(f"in_{k}") for k in given), (F.col(self.opt("orderCol")) if self.isSet(self.orderCol) else F.lit(0)).alias("tie"))
        rows = stage(rows.where(F.col("key").isNotNull() & F.col("x").isNotNull()))
        first = [F.min_by(F.struct(*(F.col(f"in_{k}").alias(k) for k in given if k != "step")), "tie").alias("first")] if {*given} - {"step"} else []
        step = F.coalesce(F.max_by("in_step", "tie"), F.lit(self.opt("stepSize"))) if "step" in given else F.lit(self.opt("stepSize"))
        keys = rows.groupBy("key").agg(*first, step.cast("double").alias("gamma"))
        model, kind = self.model(), dict(keys.dtypes)["key"]
        state = stage(keys.mapInArrow(_first_models(model, bool(first)), f"key {kind}, gamma double, {_STATE}"))
        n_keys, size = state.agg(F.count(F.lit(1)), F.max(F.size("w") + F.size("theta"))).first()
        chained, family, width = self.opt("chainedLogSum"), self.family, model._param
        sized = lambda t: F.broadcast(t) if n_keys <= FEW else t.hint("merge")
        total = None
        for n in range(self.opt("batchTrainMaxIter") + 1):
            of = sized(state.select(F.col("key").alias("k"), "w", "theta"))
            met = rows.select("key", "x").join(of, F.col("key") == F.col("k")).drop("k")
            parts = met.mapInArrow(_expect(family, width, chained), f"key {kind}, n bigint, ll double, sums array<double>")
            folded = _added_up(parts, size or 0)
            # The next models, with the log-likelihood of these.
            nxt = stage(folded.join(sized(state), "key").mapInArrow(_maximise(family, width), f"key {kind}, gamma double, {_STATE}, ll double"))
            if n:
                now = nxt.agg(F.sum("ll")).first()[0] or 0.0
                if n == self.opt("batchTrainMaxIter") or (n > 1 and not now - total > self.opt("batchTrainTol")):
                    break
                total = now
            state = nxt.drop("ll")
        made = state.join(nxt.select("key", "ll"), "key").mapInArrow(_named(model), f"key {kind}, mixtureModel {_ddl(_arrow_model(family))}, loglikelihood double")
        return self.formatted(made.withColumnRenamed("key", key))


WIDE = 100  #: numbers per key up to which sums are columns; longer ones are exploded


def _added_up(parts: DataFrame, size: int) -> DataFrame:
    """``(key, n, ll, sums)``: the parts of each key added up, entry by entry, with map-side folding."""
    totals = [F.sum("n").alias("n"), F.sum("ll").alias("ll")]
    if size <= WIDE:
        entries = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]
        folded = parts.groupBy("key").agg(*totals, *entries, F.max(F.size("sums")).alias("size"))
        return folded.select("key", "n", "ll", F.slice(F.array(*(f"s{i}" for i in range(size))), F.lit(1), F.col("size")).alias("sums") if size else F.array().cast("array<double>").alias("sums"))
    parts = stage(parts)
    placed = parts.select("key", F.posexplode("sums").alias("pos", "v")).groupBy("key", "pos").agg(F.sum("v").alias("v"))
    sums = placed.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("sums"))
    return parts.groupBy("key").agg(*totals).join(sums, "key")


FEW = 10_000  #: models that a pass broadcasts; more are joined by a shuffle
_STATE = "k int, d int, w array<double>, theta array<double>, sw array<double>, stheta array<double>"


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_struct(kind):
        return f"struct<{','.join(f'{f.name}:{_ddl(f.type)}' for f in kind)}>"
    return f"array<{_ddl(kind.value_type)}>" if pa.types.is_list(kind) else {"double": "double", "int32": "int"}[str(kind)]


def _flat(params: em.Params) -> np.ndarray:
    return np.concatenate([a.ravel() for a in params.values()])


def _shaped(family: str, name: str, theta: list[float], k: int) -> em.Params:
    """Parameters of ``k`` components from their flat form."""
    a = np.asarray(theta, float)
    if family != "gaussian":
        return {name: a}
    d = int(round((np.sqrt(1 + 4 * len(a) / k) - 1) / 2))  # k (d + d^2) entries
    return {"mean": a[: k * d].reshape(k, d), "cov": a[k * d :].reshape(k, d, d)}


def _state_batch(keys: pa.Array, gammas: list[float], models: list[tuple]) -> pa.RecordBatch:
    """``models``: (weights, parameters, weights and parameters of the summary) of each key."""
    lists = [pa.array([np.ravel(m[i] if i in (0, 2) else _flat(m[i])).tolist() for m in models], pa.list_(pa.float64())) for i in range(4)]
    d = [m[1]["mean"].shape[1] if "mean" in m[1] else 1 for m in models]
    return pa.RecordBatch.from_arrays([keys, pa.array(gammas, pa.float64()), pa.array([len(m[0]) for m in models], pa.int32()), pa.array(d, pa.int32()), *lists], names=["key", "gamma", "k", "d", "w", "theta", "sw", "stheta"])


def _first_models(model: MixtureModel, with_first: bool):
    def run(batches):
        for b in batches:
            made = []
            firsts = b.column("first").to_pylist() if with_first else [{}] * b.num_rows
            for f in firsts:
                w, params = model._initial({n: [v] for n, v in (f or {}).items()}, 0)
                made.append((w, params, w, {n: a[0] for n, a in em.scaled({n: a[None] for n, a in params.items()}, w[None]).items()}))
            if made:
                yield _state_batch(b.column("key"), b.column("gamma").to_pylist(), made)

    return run


def _expect(family: str, name: str, chained: bool):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            code = t.column("key").combine_chunks().dictionary_encode()
            owner = code.indices.to_numpy()
            order = np.argsort(owner, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0])
            x = b.column("x")
            flat = None if family == "gaussian" else x.to_numpy(zero_copy_only=False)
            rows, n, ll, sums = [], [], [], []
            for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
                own = order[lo:hi]
                w = np.asarray(b.column("w")[own[0]].as_py(), float)
                params = _shaped(family, name, b.column("theta")[own[0]].as_py(), len(w))
                samples = np.array(x.take(pa.array(own)).to_pylist(), float) if flat is None else flat[own]
                r, stats, total = em.expectations(family, samples, w, params, chained)
                rows.append(own[0])
                n.append(len(own))
                ll.append(total)
                sums.append(np.r_[r, _flat(stats)].tolist())
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(ll, pa.float64()), pa.array(sums, pa.list_(pa.float64()))], names=["key", "n", "ll", "sums"])

    return run


def _maximise(family: str, name: str):
    def run(batches):
        for b in batches:
            made = []
            for r in b.to_pylist():
                k, gamma, n = r["k"], r["gamma"], r["n"]
                sums = np.asarray(r["sums"], float) / n
                old, new = _shaped(family, name, r["stheta"], k), _shaped(family, name, sums[k:], k)
                sw = (1 - gamma) * np.asarray(r["sw"], float) + gamma * sums[:k]
                summary = {p: (1 - gamma) * old[p] + gamma * new[p] for p in old}
                w, params = em.from_summary((sw[None], {p: a[None] for p, a in summary.items()}), {p: a[None] for p, a in _shaped(family, name, r["theta"], k).items()})
                made.append((w[0], {p: a[0] for p, a in params.items()}, sw, summary))
            if made:
                fresh = _state_batch(b.column("key"), b.column("gamma").to_pylist(), made)
                yield fresh.append_column("ll", b.column("ll"))

    return run


def _named(model: MixtureModel):
    def run(batches):
        for b in batches:
            if b.num_rows:
                parts = []
                for r in b.to_pylist():
                    params = _shaped(model.family, model._param, r["theta"], r["k"])
                    parts.append((np.asarray(r["w"], float)[None], {p: a[None] for p, a in params.items()}))
                yield pa.RecordBatch.from_arrays([b.column("key"), model.encode("mixtureModel", parts), b.column("ll")], names=["key", "mixtureModel", "loglikelihood"])

    return run


@declare(
    Spec("initialMeans", as_vectors, doc="Initial means, one list per component"),
    Spec("initialMeansCol", str, doc="Column of such, array<array<double>>"),
    Spec("initialCovariances", as_vectors, doc="Initial covariances, one column-major list per component; identities by default"),
    Spec("initialCovariancesCol", str, doc="Column of such, array<array<double>>"),
)
class MultivariateGaussianMixture(_Mixture):
    """Mixture of Gaussians over vector samples. Output per minibatch: key, ``stateIndex``, ``mixtureModel``, ``loglikelihood``, event time."""

    default_key, family, first = "mixture.gaussian", "gaussian", ("initialMeans", "initialMeansCol")

    def sample(self, df: DataFrame) -> Column:
        return vector_column(df, self.opt("sampleCol"))


@declare(Spec("initialRates", as_vector, doc="Initial rates"), Spec("initialRatesCol", str, doc="Column of such"))
class PoissonMixture(_Mixture):
    """Mixture of Poisson distributions over counts."""

    default_key, family, first = "mixture.poisson", "poisson", ("initialRates", "initialRatesCol")


@declare(Spec("initialProbabilities", as_vector, doc="Initial probabilities"), Spec("initialProbabilitiesCol", str, doc="Column of such"))
class BernoulliMixture(_Mixture):
    """Mixture of Bernoulli distributions over booleans."""

    default_key, family, first = "mixture.bernoulli", "bernoulli", ("initialProbabilities", "initialProbabilitiesCol")

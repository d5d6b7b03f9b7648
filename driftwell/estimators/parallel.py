"""The linear filter over a long key in many tasks.

Filtering steps compose associatively (a scan over elements A, b, C, eta, J; Sarkka and Garcia-Fernandez, "Temporal
parallelization of Bayesian smoothers", 2021). So a key is cut into chunks of rows: each chunk is first
composed into one element, the elements of a key (one row per chunk) carry the state from chunk to chunk, and
then every chunk is filtered from its exact start. Chunks of one key are as independent as keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell import runtime
from driftwell.estimators.kalman import KalmanModel
from driftwell.kernels.linalg import mv, pinv, t
from driftwell.operators.sequence import with_positions
from driftwell.session import stage

DAY = 86_400_000_000
NEVER = -4_000_000_000_000_000_000
SEP = "\x01"
PARTS = ("A", "b", "C", "eta", "J")

Element = dict[str, np.ndarray]


def element(row: dict[str, np.ndarray], seen: np.ndarray) -> Element:
    """The element of one predict and estimate step; without measurement, of predict alone."""
    f, q, h, r = row["F"], row["Q"], row["H"], row["R"]
    u = mv(row["B"], row["u"]) if "u" in row else np.zeros(f.shape[:2])
    e = {"A": f + 0.0, "b": u + 0.0, "C": q + 0.0, "eta": np.zeros_like(u), "J": np.zeros_like(q)}
    at = np.flatnonzero(seen)
    if len(at):
        f, q, h, r, u = f[at], q[at], h[at], r[at], u[at]
        s_inv = pinv(h @ q @ t(h) + r)
        k = q @ t(h) @ s_inv
        left = np.eye(f.shape[1]) - k @ h
        new = row["z"][at] - mv(h, u)
        back = t(f) @ t(h) @ s_inv
        e["A"][at], e["b"][at], e["C"][at] = left @ f, u + mv(k, new), left @ q
        e["eta"][at], e["J"][at] = mv(back, new), back @ h @ f
    return e


def compose(i: Element, j: Element) -> Element:
    """Element ``i`` followed by ``j``."""
    m = np.linalg.inv(np.eye(i["A"].shape[1]) + i["C"] @ j["J"])
    through, back = j["A"] @ m, t(i["A"]) @ t(m)
    return {
        "A": through @ i["A"],
        "b": mv(through, i["b"] + mv(i["C"], j["eta"])) + j["b"],
        "C": through @ i["C"] @ t(j["A"]) + j["C"],
        "eta": mv(back, j["eta"] - mv(j["J"], i["b"])) + i["eta"],
        "J": back @ j["J"] @ i["A"] + i["J"],
    }


class ChunkElement(KalmanModel):
    """Composes a chunk's rows; emits the element, the row count and the initial state of the first row."""

    once = True

    def __init__(self, *args, **options) -> None:
        super().__init__(*args, **options)
        self.output = [pa.field("rows", pa.int64()), *(pa.field(n, pa.list_(pa.float64())) for n in (*PARTS, "x0", "P0"))]

    def begin(self, rows, first, n):
        state = super().begin(rows, first, n)
        size = state["x"].shape[1]
        return {"x0": state["x"], "P0": state["P"], "rows": state["index"], "A": np.tile(np.eye(size), (n, 1, 1)), "b": np.zeros((n, size)), "C": np.zeros((n, size, size)), "eta": np.zeros((n, size)), "J": np.zeros((n, size, size))}

    def step(self, state, rows):
        n, size = state["x0"].shape
        made = compose({k: state[k] for k in PARTS}, element(self._row(rows, n, size), rows["z?"]))
        for k, v in made.items():
            state[k][:] = v
        state["rows"][:] += 1
        return []

    def finish(self, state):
        return state

    def encode(self, name, parts):
        a = np.concatenate(parts)
        return pa.array(a) if name == "rows" else runtime.list_array(a.reshape(len(a), -1))


class ChunkStarts(runtime.KeyedModel):
    """Carries a key's state over its chunks; emits the state before each chunk."""

    columns = {k: "vector" for k in (*PARTS, "x0", "P0")} | {"rows": "double", "chunk": "double"}
    output = [pa.field("chunk", pa.int64()), pa.field("mean", pa.list_(pa.float64())), pa.field("cov", pa.list_(pa.float64())), pa.field("index", pa.int64())]

    def begin(self, rows, first, n):
        size = rows["x0"].shape[1]
        return {"x": rows["x0"].copy(), "P": rows["P0"].reshape(n, size, size).copy(), "index": np.zeros(n, np.int64)}

    def step(self, state, rows):
        n, size = state["x"].shape
        before = {"chunk": rows["chunk"].astype(np.int64), "mean": state["x"].copy(), "cov": state["P"].reshape(n, -1).copy(), "index": state["index"].copy()}
        a, c, j = (rows[k].reshape(n, size, size) for k in ("A", "C", "J"))
        m = a @ np.linalg.inv(np.eye(size) + state["P"] @ j)
        state["x"][:], state["P"][:] = mv(m, state["x"] + mv(state["P"], rows["eta"])) + rows["b"], m @ state["P"] @ t(a) + c
        state["index"][:] += rows["rows"].astype(np.int64)
        return [(np.arange(n), before)]

    def encode(self, name, parts):
        a = np.concatenate(parts)
        return runtime.list_array(a) if name in ("mean", "cov") else pa.array(a)


class StartedFilter(KalmanModel):
    """The filter of a chunk from the state before it."""

    def __init__(self, *args, **options) -> None:
        super().__init__(*args, **options)
        self.columns = {k: v for k, v in self.columns.items() if k not in ("x0", "P0", "initial")} | {"start": "object"}

    def begin(self, rows, first, n):
        state = super().begin(rows, first, n)
        for g, s in enumerate(first["start"]):
            size = len(s["mean"])
            state["x"][g], state["P"][g], state["index"][g] = s["mean"], np.reshape(s["cov"], (size, size)), s["index"]
        return state


def filter_in_chunks(rows: DataFrame, make: Callable[[type, set], KalmanModel], size: int) -> DataFrame:
    """As ``runtime.batch``, with keys cut into chunks of about ``size`` rows. Rows of equal time and tie stay together."""
    if size > runtime.CHUNK_ROWS // 2:
        raise ValueError(f"chunks may have at most {runtime.CHUNK_ROWS // 2} rows")
    key, time, tie = runtime.KEY, runtime.TIME, runtime.TIE
    names = [c for c in rows.columns if c not in (key, time, tie)]
    at = F.coalesce(F.unix_micros(time), F.lit(NEVER))
    named = F.when(F.col(key).isNull(), "n").otherwise(F.concat(F.lit("k"), F.col(key)))
    order = ["_at", *([tie] if tie in rows.columns else [])]
    placed = with_positions(rows.withColumns({"_k": named, "_at": at}), "_k", F.floor(F.col("_at") / DAY), order)
    placed = stage(placed.withColumn("_chunk", F.floor(F.col("_idx") / size)).drop(key))
    joined = F.concat("_k", F.lit(SEP), F.col("_chunk").cast("string"))
    base = placed.select(joined.alias(key), time, F.col("_idx").alias(tie), *names, (F.col("_idx") == F.col("_chunk") * size).alias("_first"))
    chunk = F.substring_index(key, SEP, -1)
    own = F.substr(key, F.lit(1), F.length(key) - F.length(chunk) - 1)

    elements = stage(runtime.batch(base.select(key, time, tie, *names), make(ChunkElement, set())).drop(time))
    carried = elements.select(own.alias(key), F.lit(None).cast("timestamp").alias(time), chunk.cast("long").alias(tie), chunk.cast("double").alias("chunk"), F.col("rows").cast("double").alias("rows"), *PARTS, "x0", "P0")
    starts = runtime.batch(carried, ChunkStarts())
    starts = starts.select(F.concat(key, F.lit(SEP), F.col("chunk").cast("string")).alias(key), F.struct("mean", "cov", "index").alias("_start"))
    model = make(StartedFilter, {"start"})
    begun = base.join(starts, key).select(key, time, tie, *(n for n in names if n in model.columns), F.when(F.col("_first"), F.col("_start")).alias("start"))
    out = runtime.batch(begun, model)
    back = F.when(own != "n", F.substr(own, F.lit(2)))
    return out.withColumn(key, back)

"""Keyed recursions over ordered rows: batch and streaming with one kernel.

A partition's rows come sorted by key and time. Keys are independent, so all keys of a chunk move
in lockstep: step t handles the t-th row of every key that has one, in numpy over the keys. A key
longer than a chunk carries its state on, so memory is bounded by the chunk, not by the key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftwell.kernels.linalg import use
from driftwell.session import _starts, by_key

CHUNK_ROWS = 100_000
KEY, TIME, TIE = "key__", "time__", "tie__"  #: no leading underscore: rows of the state store become named tuples
MAT = pa.struct([("numRows", pa.int32()), ("numCols", pa.int32()), ("values", pa.list_(pa.float64()))])
GAU = pa.struct([("mean", pa.list_(pa.float64())), ("covariance", MAT)])

State = dict[str, np.ndarray]


# -- Arrow to numpy ---------------------------------------------------------------------------------


def lengths(col: pa.Array, kind: str) -> np.ndarray:
    """Number of entries of each row's vector or matrix; 0 for null."""
    lists = pc.struct_field(col, "values") if kind == "matrix" else col
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def vectors(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as ``(n, size)`` and which have that size and no null entry; others are zero."""
    ok = (lengths(col, "vector") == size) & (size > 0)
    out = np.zeros((len(col), size))
    if not ok.any():
        return out, ok
    flat = pc.fill_null(pc.list_flatten(col.filter(pa.array(ok))).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
    full = ~np.isnan(flat).any(axis=1)
    at = np.flatnonzero(ok)
    ok[at[~full]] = False
    out[at[full]] = flat[full]
    return out, ok


def matrices(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as ``(n, r, c)``; the shape is that of the first row of that size."""
    flat, ok = vectors(pc.struct_field(col, "values"), size)
    shape = (1, size)
    if ok.any():
        first = col[int(np.flatnonzero(ok)[0])].as_py()
        shape = (first["numRows"], first["numCols"])
    return flat.reshape(len(flat), shape[1], shape[0]).transpose(0, 2, 1), ok


# -- numpy to Arrow ---------------------------------------------------------------------------------


def list_array(a: np.ndarray, ok: np.ndarray | None = None) -> pa.Array:
    n, k = a.shape
    offsets = np.arange(n + 1, dtype=np.int32) * k
    return pa.ListArray.from_arrays(pa.array(offsets, mask=None if ok is None else np.r_[~ok, False]), pa.array(np.ascontiguousarray(a, float).ravel()))


def matrix_array(a: np.ndarray, ok: np.ndarray | None = None) -> pa.Array:
    n, r, c = a.shape
    fields = [pa.array(np.full(n, r, np.int32)), pa.array(np.full(n, c, np.int32)), list_array(a.transpose(0, 2, 1).reshape(n, r * c))]
    return pa.StructArray.from_arrays(fields, fields=list(MAT), mask=None if ok is None else pa.array(~ok))


def gaussian_array(mean: np.ndarray, cov: np.ndarray, ok: np.ndarray | None = None) -> pa.Array:
    return pa.StructArray.from_arrays([list_array(mean), matrix_array(cov)], fields=list(GAU), mask=None if ok is None else pa.array(~ok))


# -- models -----------------------------------------------------------------------------------------


class KeyedModel:
    """What an estimator supplies: columns in, a state per key, steps, columns out."""

    #: Internal column name -> ``vector``, ``matrix``, ``double``, ``long`` or ``object`` (read at a key's first row only).
    columns: dict[str, str] = {}
    #: Arrow fields that a step gives, without key and time.
    output: list[pa.Field] = []
    #: Whether a key emits once, at its last row (``finish``); such keys must fit in a chunk.
    once = False
    #: How matrices are decomposed, and whether ones that aren't finite raise (``kernels.linalg.use``).
    linalg = ("gesdd", False)

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.__dict__.update(state)
        use(*self.linalg)  # a worker decomposes as the model it was sent says

    def begin(self, rows: dict[str, Any], first: dict[str, list], n: int) -> State:
        """States of ``n`` keys from their first rows."""
        raise NotImplementedError

    def kind_of(self, first: dict[str, Any]) -> int:
        """A number that keys of the same state sizes share, from the objects of a key's first row."""
        return 0

    def resume(self, carry: State) -> State:
        """The state of the one key that goes on."""
        return {n: a.copy() for n, a in carry.items()}

    def step(self, state: State, rows: dict[str, Any]) -> list[tuple[np.ndarray, dict[str, Any]]]:
        """Advance in place; give blocks of (positions of the keys that emit, arrays by output field)."""
        raise NotImplementedError

    def finish(self, state: State) -> dict[str, Any]:
        """What every key emits at its last row, if ``once``."""
        raise NotImplementedError

    def encode(self, name: str, parts: list[Any]) -> pa.Array:
        """The Arrow column of an output field from its blocks."""
        raise NotImplementedError

    # shared

    def run(self, table: pa.Table, starts: np.ndarray, carry: State | None = None) -> tuple[list[pa.Table], State | None]:
        """All groups of a table; the state of the last group is returned. ``carry`` continues the first group."""
        cols = {c: table.column(c).combine_chunks() for c in self.columns}
        sizes = np.diff(np.r_[starts, table.num_rows])
        measures = [np.maximum.reduceat(lengths(cols[c], k), starts) for c, k in self.columns.items() if k in ("vector", "matrix")]
        objects = {c: cols[c].take(pa.array(starts)).to_pylist() for c, k in self.columns.items() if k == "object"}
        if objects:
            measures.append(np.array([self.kind_of({c: v[g] for c, v in objects.items()}) for g in range(len(starts))], np.int64))
        if carry is not None:  # the key that goes on has its state already
            measures.append(np.r_[1, np.zeros(len(starts) - 1, np.int64)])
        shape = np.stack(measures, axis=1) if measures else np.zeros((len(starts), 0), np.int64)
        kinds, which = np.unique(shape, axis=0, return_inverse=True)
        which = which.reshape(-1)
        out, last = [], None
        for k in range(len(kinds)):
            groups = np.flatnonzero(which == k)
            rows = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in groups]) if len(groups) < len(starts) else None
            part = {c: v if rows is None else v.take(pa.array(rows)) for c, v in cols.items()}
            local = np.r_[0, np.cumsum(sizes[groups])[:-1]]
            made, end = self._lockstep(part, dict(zip((c for c, kd in self.columns.items() if kd in ("vector", "matrix")), kinds[k].tolist(), strict=False)), local, sizes[groups], carry if groups[0] == 0 else None)
            if made is not None:
                at = made.column("_row").to_numpy()
                source = pa.array(at if rows is None else rows[at])
                out.append(pa.table([table.column(KEY).take(source), *(made.column(f.name) for f in self.output), table.column(TIME).take(source)], names=[KEY, *(f.name for f in self.output), TIME]))
            if groups[-1] == len(starts) - 1:
                last = end
        return out, last

    def _decode(self, part: dict[str, pa.Array], size: dict[str, int]) -> dict[str, Any]:
        rows: dict[str, Any] = {}
        for c, kind in self.columns.items():
            if kind == "vector":
                rows[c], rows[f"{c}?"] = vectors(part[c], size[c])
            elif kind == "matrix":
                rows[c], rows[f"{c}?"] = matrices(part[c], size[c])
            elif kind in ("double", "long"):
                v = part[c].cast(pa.float64())
                rows[f"{c}?"] = pc.and_(pc.is_valid(v), pc.fill_null(pc.invert(pc.is_nan(v)), False)).to_numpy(zero_copy_only=False)
                rows[c] = np.nan_to_num(pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False))
        return rows

    def _lockstep(self, part: dict[str, pa.Array], size: dict[str, int], starts: np.ndarray, sizes: np.ndarray, carry: State | None) -> tuple[pa.Table | None, State]:
        rows = self._decode(part, size)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        firsts = {c: part[c].take(pa.array(starts)).to_pylist() for c, k in self.columns.items() if k == "object"}
        state = self.begin({c: v[starts] for c, v in rows.items()}, firsts, len(starts)) if carry is None else self.resume(carry)
        blocks: list[tuple[np.ndarray, dict[str, Any]]] = []
        for t in range(int(sizes[0])):
            g = int(np.searchsorted(-sizes, -t, "left"))
            view = {n: a[:g] for n, a in state.items()}
            at = starts[:g] + t
            for emit, made in self.step(view, {c: v[at] for c, v in rows.items()}):
                blocks.append((at[emit], made))
        if self.once:
            blocks = [(starts + sizes - 1, self.finish(state))]
        end = int(np.flatnonzero(order == len(order) - 1)[0])
        last = {n: a[end : end + 1].copy() for n, a in state.items()}
        blocks = [b for b in blocks if len(b[0])]
        if not blocks:
            return None, last
        row = np.concatenate([b[0] for b in blocks])
        table = pa.table([pa.array(row), *(self.encode(f.name, [b[1][f.name] for b in blocks]).cast(f.type) for f in self.output)], names=["_row", *(f.name for f in self.output)])
        return table.take(pa.array(np.argsort(row, kind="stable"))), last


def output_schema(model: KeyedModel, key: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field(KEY, key), *model.output, pa.field(TIME, pa.timestamp("us", tz="UTC"))])


def spark_schema(model: KeyedModel) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(output_schema(model, pa.string()))


def batch(df: DataFrame, model: KeyedModel, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Run the model over a batch table with columns ``KEY, TIME``, maybe ``TIE``, and the model's own.

    One shuffle by key. Rows go by time (nulls first), then ``TIE``. Null keys are one key.
    """
    order = [TIME, *([TIE] if TIE in df.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = output_schema(model, pa.string())
        held: list[pa.RecordBatch] = []
        n, carry, open_key = 0, None, None

        def flush(table: pa.Table, final: bool):
            nonlocal carry, open_key
            starts = np.array(_starts(table, [KEY]))
            if open_key is not None and table.column(KEY)[0].as_py() != open_key[0]:
                carry, open_key = None, None
            cut = table.num_rows if final or len(starts) == 1 else int(starts[-1])
            rest = table.slice(cut)
            made, last = model.run(table.slice(0, cut), starts[starts < cut], carry)
            carry, open_key = (last, (table.column(KEY)[cut - 1].as_py(),)) if not rest.num_rows and not final else (None, None)
            return made, rest

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= chunk:
                made, rest = flush(pa.Table.from_batches(held), False)
                held, n = rest.to_batches(), rest.num_rows
                for m in made:
                    yield from m.cast(schema).combine_chunks().to_batches(max_chunksize=20_000)
        if n:
            for m in flush(pa.Table.from_batches(held), True)[0]:
                yield from m.cast(schema).combine_chunks().to_batches(max_chunksize=20_000)

    return by_key(df, KEY).sortWithinPartitions(KEY, *order).mapInArrow(run, spark_schema(model))


def stream(df: DataFrame, model: KeyedModel, timeout: str = "none", duration_ms: int | None = None, keep_event_time: bool = False) -> DataFrame:
    """Run the model over a stream: the state of each key lives in the state store between micro-batches.

    ``timeout``: ``none``; ``process``, drop a state ``duration_ms`` after its last row; ``event``, drop it when the watermark
    passes its last event time plus ``duration_ms``. A dropped state emits nothing; later rows start anew.
    ``keep_event_time`` hands the watermark on, for event-time operators that follow; output rows must not be older.
    """
    from pyspark.sql.streaming import StatefulProcessor

    spark = df.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(provider, ""):
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = [c for c in df.columns if c != KEY]
    out = spark_schema(model)

    class Processor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("state", T.StructType([T.StructField("model", T.BinaryType())]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            parts = [p for p in rows if len(p)]
            if not parts:
                return
            pdf = pd.concat(parts)
            by = [TIME, *([TIE] if TIE in pdf.columns else [])]
            pdf = pdf.sort_values(by, kind="stable", na_position="first")
            table = pa.Table.from_pandas(pdf[names], preserve_index=False)
            table = table.append_column(KEY, pa.array([key[0]] * len(pdf), pa.string()))
            table = typed(table, model)
            carry = pickle.loads(self.state.get()[0]) if self.state.exists() else None  # noqa: S301 - our own state
            made, last = model.run(table, np.array([0]), carry)
            self.state.update((pickle.dumps(last),))
            self._expire_later(pdf, timerValues)
            for m in made:
                frame = m.to_pandas()
                if frame[TIME].dtype.kind == "M" and frame[TIME].dt.tz is not None:
                    frame[TIME] = frame[TIME].dt.tz_localize(None)
                yield frame[[f.name for f in out]]

        def _expire_later(self, pdf, timerValues) -> None:
            if timeout == "none" or duration_ms is None:
                return
            if timeout == "event":
                last = pdf[TIME].max()
                if pd.isna(last):
                    return
                at = int(pd.Timestamp(last).timestamp() * 1000) + duration_ms
            else:
                at = timerValues.getCurrentProcessingTimeInMs() + duration_ms
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.state.clear()
            return iter(())

        def close(self) -> None:
            pass

    mode = {"none": "None", "process": "ProcessingTime", "event": "EventTime"}[timeout]
    return df.groupBy(KEY).transformWithStateInPandas(Processor(), outputStructType=out, outputMode="Append", timeMode="EventTime" if keep_event_time else mode, eventTimeColumnName=TIME if keep_event_time else "")


def typed(table: pa.Table, model: KeyedModel) -> pa.Table:
    """A table from pandas with the Arrow types that the model reads."""
    kinds = {"vector": pa.list_(pa.float64()), "matrix": MAT, "double": pa.float64(), "long": pa.int64()}
    for i, name in enumerate(table.column_names):
        kind = model.columns.get(name)
        if kind in kinds and table.column(name).type != kinds[kind]:
            table = table.set_column(i, name, pa.array(table.column(name).to_pylist(), kinds[kind]))
        elif name == TIME:
            table = table.set_column(i, name, table.column(name).cast(pa.timestamp("us")).cast(pa.timestamp("us", tz="UTC")) if pa.types.is_timestamp(table.column(name).type) else pa.nulls(table.num_rows, pa.timestamp("us", tz="UTC")))
    return table

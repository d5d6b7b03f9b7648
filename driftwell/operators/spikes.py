"""Implausible readings: spikes against the source's own behaviour, stuck runs, physical limits.

``spikes(readings)`` and ``faulty_residuals(outputs)`` are the operators. Both order the readings
of a source, cut long sources into chunks with a margin (``sequence``), fit one robust autoregression per source from counts
that add up over its chunks, and judge each chunk with the tests of ``kernels.outliers``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.kernels.outliers import model, run_lengths, spikes as spike_test, statistics
from driftwell.operators.sequence import in_chunks, with_positions
from driftwell.session import map_sorted_groups, stage

CHUNK, HALO, DAY = 20_000, 128, 86_400_000_000
FEW = 50_000  #: sources whose models (under 200 bytes an entry) are broadcast; more are joined by a shuffle
OUT = "rec_id bigint, limit_violation boolean, stuck boolean, spike boolean, departure double"


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix, NaN beyond a row's length and for null entries."""
    flat = col.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(sizes), int(sizes.max(initial=1)) or 1), np.nan)
    values = pc.fill_null(pc.list_flatten(flat).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


_LISTS = "_rec array<bigint>, _idx array<bigint>, _own array<boolean>, _bad array<boolean>, _values array<double>"
_STAT = "_counts array<struct<entry:int,what:bigint,n:bigint>>"
_COUNT = pa.list_(pa.struct([("entry", pa.int32()), ("what", pa.int64()), ("n", pa.int64())]))


def _readings(values: np.ndarray, idx: np.ndarray, bad: np.ndarray, stuck_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of sorted rows: first row of each reading, reading of each row, whether it is in a stuck run, and per entry the readings to be tested."""
    first = np.r_[True, idx[1:] != idx[:-1]]  # repeats count once
    v, wrong = values[first], bad[first]
    run = run_lengths(v)
    held = run >= stuck_run
    again = np.r_[False, held[1:] & (run[1:] == run[:-1]) & np.all((v[1:] == v[:-1]) | np.isnan(v[1:]), axis=1)]
    return first, np.cumsum(first) - 1, held, [np.flatnonzero(np.isfinite(v[:, e]) & ~wrong & ~again) for e in range(v.shape[1])]


def _packed(stuck_run: int, with_spikes: bool):
    """Chunks as one row each, with the statistics of their own readings."""
    def pack(table: pa.Table, starts: list[int]) -> pa.Table:
        values = _matrix(table.column("_values"))
        rec, idx, own, bad = (table.column(c).to_numpy() for c in ("_rec", "_idx", "_own", "_bad"))
        ends = [*starts[1:], len(idx)]
        counts = []
        for lo, hi in zip(starts, ends, strict=True):
            made = []
            if with_spikes:
                v = values[lo:hi]
                first, _, _, tested = _readings(v, idx[lo:hi], bad[lo:hi], stuck_run)
                for e, use in enumerate(tested):
                    made += [{"entry": e, "what": w, "n": n} for w, n in statistics(v[first][use, e], own[lo:hi][first][use]).items()]
            counts.append(made)
        width = values.shape[1]
        cut = pa.array([*starts, len(idx)], pa.int32())
        lists = {"_rec": pa.ListArray.from_arrays(cut, rec), "_idx": pa.ListArray.from_arrays(cut, idx), "_own": pa.ListArray.from_arrays(cut, pa.array(own)), "_bad": pa.ListArray.from_arrays(cut, pa.array(bad)), "_values": pa.ListArray.from_arrays(pc.multiply(cut, width).cast(pa.int32()), pa.array(values.ravel()))}
        keep = pa.array(starts, pa.int64())
        return pa.table({"_key": table.column("_key").take(keep), "_n": table.column("_n").take(keep), "_width": pa.array([width] * len(starts), pa.int32()), **lists, "_counts": pa.array(counts, _COUNT)})

    return pack


def _models(table: pa.Table, starts: list[int]) -> pa.Table:
    what, n = table.column("what").to_pylist(), table.column("n").to_pylist()
    made = [model(dict(zip(what[lo:hi], n[lo:hi], strict=True))) for lo, hi in zip(starts, [*starts[1:], len(what)], strict=True)]
    keep = pa.array(starts, pa.int64())
    return pa.table({"_k": table.column("_key").take(keep), "entry": table.column("entry").take(keep), "noise": pa.array([m[0] for m in made], pa.float64()), "weights": pa.array([m[1].tolist() for m in made], pa.list_(pa.float64()))})


def _judge(limit: float, stuck_run: int, least: int, lasting: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in range(batch.num_rows):
                rec, idx, own, bad, flat = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("_rec", "_idx", "_own", "_bad", "_values"))
                values = flat.reshape(len(idx), -1)
                first, back, held, tested = _readings(values, idx, bad, stuck_run)
                v = values[first]
                hit, far = np.zeros(len(v), bool), np.zeros(len(v))
                models = batch.column("_models")[r].as_py()
                if models and batch.column("_n")[r].as_py() >= least:
                    for m in models:
                        if m["entry"] < v.shape[1]:
                            use = tested[m["entry"]]
                            flags, d = spike_test(v[use, m["entry"]], m["noise"], np.array(m["weights"]), limit, lasting)
                            hit[use] |= flags
                            far[use] = np.where(np.abs(d) > np.abs(far[use]), d, far[use])
                stuck, spike, off = held[back], hit[back], far[back]
                keep = own & (bad | stuck | spike)
                if keep.any():
                    found.append((rec[keep], bad[keep], stuck[keep], spike[keep], off[keep]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["rec_id", "limit_violation", "stuck", "spike", "departure"])

    return judge


def _tested(df: DataFrame, order: list[str], bucket: Column, with_spikes: bool, limit: float, stuck_run: int, least: int, lasting: int, chunk: int) -> DataFrame:
    """Chunks are written as one row each (some MB at most); their counts make one model per key and entry, which is joined to the chunks."""
    placed = in_chunks(with_positions(df, "_key", bucket, order), chunk, max(HALO, 4 * lasting, stuck_run))
    kind = dict(df.dtypes)["_key"]
    chunks = map_sorted_groups(placed, ["_key", "_chunk"], ["_idx"], _packed(stuck_run, with_spikes), f"_key {kind}, _n bigint, _width int, {_LISTS}, {_STAT}")
    if not with_spikes:
        return chunks.withColumn("_models", F.lit(None).cast("array<struct<entry:int,noise:double,weights:array<double>>>")).mapInArrow(_judge(limit, stuck_run, least, lasting), OUT)
    chunks = stage(chunks)
    counts = chunks.select("_key", F.explode("_counts").alias("_c")).groupBy("_key", "_c.entry", "_c.what").agg(F.sum("_c.n").alias("n"))
    models = map_sorted_groups(counts, ["_key", "entry"], ["what"], _models, f"_k {kind}, entry int, noise double, weights array<double>")
    models = stage(models.groupBy("_k").agg(F.collect_list(F.struct("entry", "noise", "weights")).alias("_models")))
    models = F.broadcast(models) if models.count() <= FEW else models.hint("merge")
    return chunks.drop("_counts").join(models, F.col("_key") == F.col("_k"), "left").mapInArrow(_judge(limit, stuck_run, least, lasting), OUT)


def spikes(readings: DataFrame, limits: DataFrame | None = None, *, rec_id: str = "record_id", key: str = "state_key", time: str = "event_time", values: str = "measurement", kind: Column | None = None, limit: float = 6.0, stuck_run: int = 10, least: int = 30, lasting: int = 30, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``readings`` that are implausible for their source, with the reasons.

    ``limits`` has ``kind, low_limit, high_limit``; ``kind`` gives a row's kind (default: the second
    part of the key). A row is returned if an entry is null, not finite or outside its kind's
    limits; or it is in a run of ``stuck_run`` equal readings of its source; or its source has
    ``least`` readings and an entry is a spike (``kernels.outliers.spikes``).

    Rows without key, time or values are no readings and never returned; so are rows with an empty
    array. Rows equal in key, time and values are one reading and share its verdict. Kinds without
    limits have none. An empty table gives an empty result; other columns are ignored.
    """
    kind = F.try_element_at(F.split(key, "/"), F.lit(2)) if kind is None else kind
    rows = readings.select(F.col(rec_id).alias("_rec"), F.col(key).alias("_key"), F.unix_micros(time).alias("_t"), F.col(values).cast("array<double>").alias("_values"), kind.alias("_kind"))
    rows = rows.where(F.col("_key").isNotNull() & F.col("_t").isNotNull() & (F.size("_values") > 0))
    wrong = lambda low, high: F.exists("_values", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < low) | (v > high))
    if limits is None:
        rows = rows.withColumn("_bad", wrong(F.lit(float("-inf")), F.lit(float("inf"))))
    else:
        known = limits.select(F.col("kind").alias("_kind"), F.col("low_limit").alias("_low"), F.col("high_limit").alias("_high")).dropDuplicates(["_kind"])
        low, high = F.coalesce("_low", F.lit(float("-inf"))), F.coalesce("_high", F.lit(float("inf")))
        rows = rows.join(known, "_kind", "left").withColumn("_bad", wrong(low, high)).drop("_low", "_high")
    return _tested(rows.drop("_kind"), ["_t", "_values"], F.floor(F.col("_t") / DAY), True, limit, stuck_run, least, lasting, chunk)


def faulty_residuals(outputs: DataFrame, *, rec_id: str = "output_id", key: str = "state_key", index: str = "state_index", step: str = "step_index", residual: str = "residual", limit: float = 6.0, stuck_run: int = 10, chunk: int = CHUNK) -> DataFrame:
    """Rows of filter output whose residual can't be right, with the reasons.

    A residual with a non-empty mean is returned if a mean entry is null or not finite, a variance
    is missing or not positive, a mean entry is ``limit`` of its own standard deviations off 0, or
    it is in a run of ``stuck_run`` equal means of its key by ``index``. Missing and hollow residuals
    are skipped; rows equal in key, index, step and mean are one residual. Rows without key or
    index are judged alone, without runs. An empty table gives an empty result.
    """
    mean, n = F.col(f"{residual}.mean"), F.size(f"{residual}.mean")
    cov = F.col(f"{residual}.covariance.vals")
    var = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(cov, (i * (n + 1)).cast("int")))
    rows = outputs.where(F.coalesce(n, F.lit(-1)) > 0).select(F.col(rec_id).alias("_rec"), F.col(key).alias("_key"), F.col(index).cast("long").alias("_i"), F.col(step).cast("long").alias("_step"), mean.cast("array<double>").alias("_values"), var.alias("_var"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    entry_bad = F.exists("_values", lambda v: ~finite(v))
    var_bad = F.exists("_var", lambda v: v.isNull() | F.isnan(v) | (v <= 0))
    far = F.exists(F.zip_with("_values", "_var", lambda m, v: F.abs(m) >= limit * F.sqrt(v)), lambda x: F.coalesce(x, F.lit(False)))
    rows = rows.select("*", (F.coalesce(entry_bad, F.lit(True)) | F.coalesce(var_bad, F.lit(True)) | far).alias("_bad"), far.alias("_far")).drop("_var")
    loose = rows.where(F.col("_key").isNull() | F.col("_i").isNull())
    tied = rows.where(F.col("_key").isNotNull() & F.col("_i").isNotNull())
    alone = loose.where("_bad").select(F.col("_rec").alias("rec_id"), F.lit(True).alias("limit_violation"), F.lit(False).alias("stuck"), F.lit(False).alias("spike"), F.lit(0.0).alias("departure"))
    return _tested(tied.drop("_far"), ["_i", "_step", "_values"], F.floor(F.col("_i") / 4096), False, limit, stuck_run, 1, 30, chunk).unionByName(alone)

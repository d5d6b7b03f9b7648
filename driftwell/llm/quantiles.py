"""Percentiles per group of very large columns: combinable day states and distributed multi-select.

The rows of a group may lie anywhere and are never brought together. Each round, every chunk of rows proposes the
median of what it holds of a range; the median of the proposals, weighted by the rows they stand for, is the range's pivot;
one pass counts each range below, at and above its pivot and proposes medians for both halves; the halves that hold no
wanted rank are discarded. All wanted ranks of a group share its ranges, so a row is in one range at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.session import stage

SMALL = 1024  #: rows of a range that one task may sort
CHUNK = 500_000  #: rows that propose one local median per range
FEW = 50_000  #: ranges (under 200 bytes each) that are broadcast; more are joined by a shuffle
SHRINK = 4  #: the rows in range are written anew when they are so many times fewer than those last written
DAY = 86_400_000_000


def quantized(value: Column, eps: float) -> Column:
    """``value`` on a grid of relative width ``eps``: off by at most ``eps`` times its size; 0, infinities exact, ``eps`` 0 all exact."""
    if eps == 0:
        return value
    width = math.log1p(eps)
    near = F.signum(value) * F.exp(F.round(F.log(F.abs(value)) / width) * width)
    return F.when((value == 0) | (F.abs(value) == float("inf")), value).otherwise(near)


def day_states(df: DataFrame, value: str, *, key: str | Column = "state_key", time: str = "event_time", eps: float = 0.0) -> DataFrame:
    """``(key, day, value, n)``: the value counts of each key and UTC day (days since the epoch).

    With ``eps`` > 0 a state holds at most one value per grid cell, however many rows there are, and is made with
    map-side folding. With ``eps`` 0 nothing can be folded: each row is its own state, and nothing is moved. Null and NaN
    values are left out, infinities stay; the null key is a group, and so is the null day.
    """
    v = F.col(value).cast("double")
    day = F.floor(F.unix_micros(time) / DAY)
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select((F.col(key) if isinstance(key, str) else key).alias("key"), day.alias("day"), (quantized(v, eps) + 0.0).alias("value"), F.lit(1).cast("long").alias("n"))
    return rows if eps == 0 else rows.groupBy("key", "day", "value").agg(F.sum("n").alias("n"))


def combine_days(states: DataFrame) -> DataFrame:
    """``(key, value, n)``: the states of any days (or partitions) as one; the order of combining doesn't matter."""
    return states.groupBy("key", "value").agg(F.sum("n").alias("n"))


def _halves(value: np.ndarray, n: np.ndarray, pivot: np.ndarray, group: np.ndarray) -> dict[str, np.ndarray]:
    """Per group of sorted rows: counts below, at, above the pivot (weights and rows), and the weighted medians of both sides."""
    side = np.where(value < pivot, 0, np.where(value == pivot, 1, 2))
    cell = group * 3 + side
    groups = int(group[-1]) + 1
    weight = np.bincount(cell, weights=n, minlength=3 * groups).astype(np.int64)
    rows = np.bincount(cell, minlength=3 * groups)
    upto = np.cumsum(n)
    starts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1]
    before = upto[starts] - n[starts]
    # The first row of a cell whose cumulative weight reaches half of the cell's.
    at = np.searchsorted(upto, before + (weight[cell[starts]] + 1) // 2)
    median = np.full(3 * groups, np.nan)
    median[cell[starts]] = value[at]
    return {"weight": weight.reshape(-1, 3), "rows": rows.reshape(-1, 3), "median": median.reshape(-1, 3)}


_COUNTS = "rid bigint, lt bigint, eq bigint, lt_rows bigint, gt_rows bigint, proposals array<struct<above:boolean,value:double,n:bigint>>"
_PROPOSAL = pa.list_(pa.struct([("above", pa.bool_()), ("value", pa.float64()), ("n", pa.int64())]))


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows ``(rid, value, n, pivot)``: per chunk and range the counts and the local medians of both halves."""
    held: list[pa.RecordBatch] = []
    size = 0

    def fold() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        rid, value, n, pivot = (t.column(c).to_numpy() for c in range(4))
        order = np.lexsort((value, rid))
        rid, value, n, pivot = rid[order], value[order], n[order], pivot[order]
        new = np.r_[True, rid[1:] != rid[:-1]]
        m = _halves(value, n, pivot, np.cumsum(new) - 1)
        there = m["weight"][:, [0, 2]] > 0
        flat = pa.StructArray.from_arrays([pa.array(np.tile([False, True], len(there))[there.ravel()]), pa.array(m["median"][:, [0, 2]][there]), pa.array(m["weight"][:, [0, 2]][there])], fields=list(_PROPOSAL.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(there.sum(1))].astype(np.int32)), flat)
        cols = [rid[new], m["weight"][:, 0], m["weight"][:, 1], m["rows"][:, 0], m["rows"][:, 2]]
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols), lists], names=["rid", "lt", "eq", "lt_rows", "gt_rows", "proposals"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= CHUNK:
            yield fold()
            held, size = [], 0
    if held:
        yield fold()


def _weighted_medians(proposals: DataFrame, *by: str) -> DataFrame:
    """Per group the least value of ``(value, n)`` up to which half of the weight lies: ``(*by, pivot)``."""
    w = Window.partitionBy(*by)
    upto = F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return proposals.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(w)).where(2 * F.col("_upto") >= F.col("_all")).groupBy(*by).agg(F.min("value").alias("pivot"))


def multi_select(state: DataFrame, probs: list[float], *, small: int = SMALL) -> DataFrame:
    """``(key, p, value, n)``: for each group and probability the least value whose cumulative count reaches ``p * n``.

    ``state`` has ``key`` (any type that can be grouped by), ``value`` (finite or infinite) and ``n``; equal values may be in
    several rows. Every group goes through a round of pivots at least; a range with at most ``small`` rows left is then finished by
    cumulative counts. No task sees more of a group than a chunk of ``CHUNK`` rows or ``small`` rows; the
    driver sees two numbers per round. Each pivot is a value of its range, so every round shrinks every range.

    ``n`` is the group's count. The result is exact for the state's values; a null key is a group; no rows give no rows.
    """
    if not probs:
        return state.select("key", F.lit(0.0).alias("p"), "value", "n").limit(0)
    state = stage(state.select("key", "value", "n"))
    totals = state.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    wanted = F.array(*(F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("total"))).cast("long").alias("k")) for p in probs))
    groups = stage(totals.select("key", "total", "rows", wanted.alias("wanted"), F.monotonically_increasing_id().alias("kid")))
    n_groups = groups.count()
    sized = lambda t, n: F.broadcast(t) if n <= FEW else t.hint("merge")
    names = groups.select(F.col("key").alias("_key"), "kid")
    rows = stage(state.join(sized(names, n_groups), F.col("key").eqNullSafe(F.col("_key"))).select("kid", "value", "n"))
    written = n_open = None
    inf = float("inf")

    # The first pivots: local medians of whole groups, from chunks as they lie.
    first = rows.select(F.col("kid").alias("rid"), "value", "n", F.lit(-inf).alias("pivot")).mapInArrow(_count_chunks, _COUNTS)
    low = first.where("eq > 0").select("rid", F.lit(-inf).alias("value"), F.col("eq").alias("n"))
    proposed = first.select("rid", F.explode("proposals").alias("_p")).select("rid", "_p.value", "_p.n").unionByName(low)
    pivots = _weighted_medians(proposed, "rid").withColumnRenamed("rid", "_rid")
    bounds = [F.lit(None).cast("double").alias(c) for c in ("lo", "hi")]
    ranges = stage(groups.join(pivots, F.col("kid") == F.col("_rid")).select("kid", F.col("kid").alias("rid"), *bounds, "rows", "wanted", "pivot"))
    n_open = n_groups
    inside = (F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") < F.col("hi")))
    found: list[DataFrame] = []
    while n_open:
        own = sized(ranges.withColumnRenamed("kid", "_kid"), n_open)
        within = rows.join(own, (F.col("kid") == F.col("_kid")) & inside)
        chunks = stage(within.select("rid", "value", "n", "pivot").mapInArrow(_count_chunks, _COUNTS))
        counts = chunks.groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("lt", "eq", "lt_rows", "gt_rows")))
        nxt = _weighted_medians(chunks.select("rid", F.explode("proposals").alias("_p")).select("rid", "_p.*"), "rid", "above")
        sides = nxt.groupBy("rid").agg(F.max(F.when(~F.col("above"), F.col("pivot"))).alias("low_pivot"), F.max(F.when(F.col("above"), F.col("pivot"))).alias("high_pivot"))
        parted = ranges.join(counts, "rid").join(sides, "rid", "left")
        lt, le = F.col("lt"), F.col("lt") + F.col("eq")
        below = F.struct(F.col("lo").alias("lo"), F.col("pivot").alias("hi"), F.col("lt_rows").alias("rows"), F.filter("wanted", lambda w: w["k"] <= lt).alias("wanted"), F.col("low_pivot").alias("pivot"))
        above = F.struct(F.col("pivot").alias("lo"), F.col("hi").alias("hi"), F.col("gt_rows").alias("rows"), F.transform(F.filter("wanted", lambda w: w["k"] > le), lambda w: F.struct(w["p"].alias("p"), (w["k"] - le).alias("k"))).alias("wanted"), F.col("high_pivot").alias("pivot"))
        at = F.struct(F.col("pivot").alias("lo"), F.col("pivot").alias("hi"), F.lit(0).cast("long").alias("rows"), F.filter("wanted", lambda w: (w["k"] > lt) & (w["k"] <= le)).alias("wanted"), F.col("pivot").alias("pivot"))
        made = parted.select("kid", F.explode(F.array(below, above, at)).alias("_r")).select("kid", "_r.*").where(F.size("wanted") > 0)
        step = stage(made.withColumn("rid", F.monotonically_increasing_id()))
        hit = F.col("lo").eqNullSafe(F.col("hi"))
        found.append(step.where(hit).select("kid", F.explode("wanted").alias("_w"), F.col("pivot").alias("value")).select("kid", "_w.p", "value"))
        n_all, n_open, left = step.where(~hit).agg(F.count(F.lit(1)), F.count_if(F.col("rows") > small), F.coalesce(F.sum(F.when(F.col("rows") > small, F.col("rows"))), F.lit(0))).first()
        few = step.where(~hit & (F.col("rows") <= small))
        if n_all > n_open:
            last = rows.join(sized(few.withColumnRenamed("kid", "_kid"), n_all - n_open), (F.col("kid") == F.col("_kid")) & inside).select("kid", "rid", "wanted", "value", "n")
            upto = F.sum("n").over(Window.partitionBy("rid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
            hits = last.withColumn("_c", upto).select("kid", "value", F.explode(F.filter("wanted", lambda w: (w["k"] > F.col("_c") - F.col("n")) & (w["k"] <= F.col("_c")))).alias("_w"))
            # Written at once: the plan of the result doesn't grow with the rounds.
            found.append(stage(hits.select("kid", "_w.p", "value")))
        ranges = step.where(~hit & (F.col("rows") > small)).select("kid", "rid", "lo", "hi", "rows", "wanted", "pivot")
        if n_open and (written is None or left * SHRINK <= written):
            own = sized(ranges.select(F.col("kid").alias("_kid"), "lo", "hi"), n_open)
            rows, written = stage(rows.join(own, (F.col("kid") == F.col("_kid")) & inside).select("kid", "value", "n")), left
    if not found:
        return groups.select("key", F.lit(0.0).alias("p"), F.lit(0.0).alias("value"), F.col("total").alias("n")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.join(sized(groups.select("key", "kid", "total"), n_groups), "kid").select("key", "p", "value", F.col("total").alias("n"))


def percentiles(df: DataFrame, value: str, probs: list[float], *, key: str | Column = "state_key", time: str = "event_time", eps: float = 0.0, small: int = SMALL) -> DataFrame:
    """Percentiles per key from day states: ``(key, p, value, n)``, off by at most ``eps`` times the value's size."""
    states = day_states(df, value, key=key, time=time, eps=eps)
    return multi_select(states if eps == 0 else combine_days(states), probs, small=small)

"""Late and out-of-order events: period aggregates by event time, corrected up to a cut-off.

All state is value counts. A period's state counts its values, so late rows only adjust counts, and medians, distincts and
extremes are derived anew from cumulative counts. The cut-off is told by the same kind of state: per arrival bucket the counts of
event times, whose cumulative extremes are the greatest event time that had arrived.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.session import map_sorted_groups

HOUR = 3_600_000_000
CELL = 600_000_000  #: microseconds of event time that the counts of arrivals tell apart
NEVER = -4_000_000_000_000_000_000  #: arrival of rows without one, far before all others
OWN = ("_event", "_at", "_arrived", "frontier", "is_late", "out_of_order", "_before", "_inside", "_top", "_low")


def _timed(rows: DataFrame, key: str, time: str, arrival: str, tie: str, bucket_us: int) -> DataFrame:
    rows = rows.drop(*(c for c in OWN if c in rows.columns and c not in (key, time, arrival, tie)))
    rows = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = rows.withColumn("_event", F.unix_micros(time)).withColumn("_at", F.coalesce(F.unix_micros(arrival), F.lit(NEVER)))
    return rows.withColumn("_arrived", F.floor(F.col("_at") / bucket_us))


def arrivals(timed: DataFrame, key: str) -> DataFrame:
    """The value-count state of event times: ``(key, _arrived, cell, n, top, low)``, with each cell's exact extremes."""
    return timed.groupBy(key, "_arrived", F.floor(F.col("_event") / CELL).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.max("_event").alias("top"), F.min("_event").alias("low"))


def _extremes(state: DataFrame, key: str) -> DataFrame:
    """Per key and arrival bucket: its own extremes, and ``_before``, the greatest event time of the earlier buckets' counts together."""
    own = state.groupBy(key, "_arrived").agg(F.max("top").alias("_top"), F.min("low").alias("_low"))
    return own.withColumn("_before", F.max("_top").over(Window.partitionBy(key).orderBy("_arrived").rowsBetween(Window.unboundedPreceding, -1)))


def _marked(seen: DataFrame, key: str, tie: str, cutoff_s: int) -> DataFrame:
    inside = Window.partitionBy(key, "_arrived").orderBy("_at", tie).rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("frontier", F.greatest(F.max("_event").over(inside), "_before"))
    behind = F.col("frontier") - F.col("_event")
    return seen.withColumn("is_late", F.coalesce(behind > cutoff_s * 1_000_000, F.lit(False))).withColumn("out_of_order", F.coalesce(behind > 0, F.lit(False))).drop("_before", "_top", "_low")


def with_frontier(rows: DataFrame, *, key: str = "state_key", time: str = "event_time", arrival: str = "arrival_time", tie: str = "record_id", cutoff_s: int = 7200, bucket_us: int = HOUR, start: DataFrame | None = None) -> DataFrame:
    """Rows with key and event time, plus ``_event`` and ``_at`` (event and arrival in microseconds), ``_arrived`` (bucket of the arrival),
    ``frontier`` (greatest event time of the key among rows that arrived earlier), ``is_late`` (more than
    ``cutoff_s`` behind it) and ``out_of_order`` (behind it at all).

    Arrival order is (``arrival``, ``tie``); rows without arrival time come first. Up to a row's arrival bucket the frontier is
    an extreme of the counts of event times; within the bucket rows are looked at one by one. A hot key is so cut by time,
    and what is sorted per key is one number per bucket. Other columns pass through. ``start`` has the greatest event time of each
    key before these rows, ``(key, top)`` in microseconds.
    """
    timed = _timed(rows, key, time, arrival, tie, bucket_us)
    extremes = _extremes(arrivals(timed, key), key)
    if start is not None:
        held = start.select(F.col(key).alias("_held"), F.col("top").alias("_start"))
        extremes = extremes.join(held, F.col(key) == F.col("_held"), "left").withColumn("_before", F.greatest("_before", "_start")).drop("_held", "_start")
    return _marked(timed.join(extremes, [key, "_arrived"]), key, tie, cutoff_s)


def left_out(rows: DataFrame, *, key: str = "state_key", time: str = "event_time", arrival: str = "arrival_time", tie: str = "record_id", cutoff_s: int = 7200, bucket_us: int = HOUR) -> DataFrame:
    """The rows of ``with_frontier`` that are late.

    The counts of event times tell the buckets in which no row can be late, those whose earliest event isn't behind
    the latest that has arrived up to their end; only the others' rows are looked at one by one.
    """
    timed = _timed(rows, key, time, arrival, tie, bucket_us)
    doubtful = _extremes(arrivals(timed, key), key).where(F.greatest("_before", "_top") - F.col("_low") > cutoff_s * 1_000_000)
    return _marked(timed.join(doubtful, [key, "_arrived"]), key, tie, cutoff_s).where("is_late")


def _values(rows: DataFrame, value: Column, key: Column | str, period_s: int) -> list[Column]:
    period = F.floor(F.col("_event") / (period_s * 1_000_000)) * period_s
    return [(F.col(key) if isinstance(key, str) else key).alias("key"), period.alias("period"), value.cast("double").alias("value"), F.col("out_of_order").cast("long").alias("_o")]


def multiset(rows: DataFrame, value: Column, *, key: Column | str = "state_key", period_s: int = 3600) -> DataFrame:
    """The value-count state: ``(key, period, value, n, n_corrections)`` of the rows of ``with_frontier`` that aren't late.

    Null and NaN values are left out. States of disjoint rows (days, arrival batches) combine with ``combine``.
    """
    kept = rows.where(~F.col("is_late")).select(*_values(rows, value, key, period_s))
    return kept.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("key", "period", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_o").alias("n_corrections"))


def combine(*states: DataFrame) -> DataFrame:
    """The sum of value-count states: late rows only adjust counts (a retraction has negative counts)."""
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return union.groupBy("key", "period", "value").agg(F.sum("n").alias("n"), F.sum("n_corrections").alias("n_corrections")).where("n > 0")


def period_stats(state: DataFrame) -> DataFrame:
    """Exact count, distinct count, extremes, sum and median per key and period, from cumulative counts.

    The median is the mean of the two middle values for an even count. Sorted groups hold the
    distinct values of one key and period, not its rows.
    """
    w = Window.partitionBy("key", "period")
    upto = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    s = state.withColumn("_total", F.sum("n").over(w)).withColumn("_upto", F.sum("n").over(upto))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    holds = lambda rank: F.when((rank > F.col("_upto") - F.col("n")) & (rank <= F.col("_upto")), F.col("value"))
    return s.groupBy("key", "period").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum(F.col("value") * F.col("n")).alias("sum_value"), ((F.max(holds(low)) + F.max(holds(high))) / 2).alias("median_value"), F.sum("n_corrections").alias("n_corrections"))


_VERSIONS = "period bigint, as_of_batch bigint, n bigint, n_distinct bigint, min_value double, max_value double, sum_value double, median_value double, n_corrections bigint"


def _versions(table: pa.Table, starts: list[int]) -> pa.Table:
    """Per key and period: the counts are adjusted batch by batch, and the statistics derived from their cumulative sums."""
    batch, value, n, late = (table.column(c).to_numpy() for c in ("_batch", "value", "n", "n_corrections"))
    out, groups = [], []
    for g, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(n)], strict=True)):
        values, at = np.unique(value[lo:hi], return_inverse=True)
        counts, corrections = np.zeros(len(values), np.int64), 0
        cuts = np.r_[lo, lo + 1 + np.flatnonzero(np.diff(batch[lo:hi])), hi]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            np.add.at(counts, at[a - lo : z - lo], n[a:z])
            corrections += int(late[a:z].sum())
            upto = np.cumsum(counts)
            total = int(upto[-1])
            middle = values[np.searchsorted(upto, [(total + 1) // 2, total // 2 + 1])]
            there = values[counts > 0]
            out.append((int(batch[a]), total, len(there), there[0], there[-1], float(np.sum(there * counts[counts > 0])), float(middle.sum() / 2), corrections))
            groups.append(starts[g])
    first = pa.array(groups, pa.int64())
    names = ("as_of_batch", "n", "n_distinct", "min_value", "max_value", "sum_value", "median_value", "n_corrections")
    return pa.table({"key": table.column("key").take(first), "period": table.column("period").take(first)} | {c: pa.array(x) for c, x in zip(names, zip(*out, strict=True), strict=True)})


def period_versions(rows: DataFrame, value: Column, *, key: Column | str = "state_key", period_s: int = 3600, batch_us: int = 24 * HOUR) -> DataFrame:
    """Stats per key, period and arrival batch, each as of the end of that batch: how late rows corrected a period.

    A version appears for each batch that brought rows of the period. ``(key, period, as_of_batch, ...)``. Only the batches'
    changes of the counts are shuffled, each once.
    """
    kept = rows.where(~F.col("is_late")).select(*_values(rows, value, key, period_s), F.floor(F.col("_at") / batch_us).alias("_batch"))
    changes = kept.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("key", "period", "_batch", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_o").alias("n_corrections"))
    # The grouping compares plain columns, so a key of several is carried beside its text.
    kind = changes.schema["key"].dataType.simpleString()
    named = changes.withColumn("_text", F.to_json(F.struct("key")))
    return map_sorted_groups(named, ["_text", "period"], ["_batch", "value"], _versions, f"key {kind}, {_VERSIONS}")

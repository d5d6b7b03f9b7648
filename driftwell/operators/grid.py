"""Irregular readings onto a regular grid per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.session import stage

DAY = 86_400


def regular_grid(readings: DataFrame, steps: DataFrame, *, key: str = "state_key", time: str = "event_time", values: str = "measurement", kind: Column | None = None, max_gap_s: int = 3600) -> DataFrame:
    """One row per source and grid slot from the source's first to its last filled slot, empty days included.

    ``steps`` has ``kind, grid_seconds``; slots start at multiples of the step since the Unix epoch.
    Readings (key, time and values non-null) are folded into slots once, on the map side, so a hot source
    shrinks to its slots before anything is sorted; the folded slots are written, and days and grid made from them. Each
    source's slot sequence is made day by day and left-joined with the filled slots; an empty slot carries the last filled
    slot's means forward if they are at most ``max_gap_s`` old, over midnight too, and is else marked ``missing``.

    Columns: ``state_key, slot_epoch, n`` (readings in the slot), ``value`` (mean of each entry), ``status``
    (``observed``, ``carried``, ``missing``), ``within_day`` (whether the slot lies between the first and the last filled slot of its
    UTC day). Null and NaN entries count for nothing (an entry without others is null). Kinds without a step and steps that
    aren't positive have no grid. Empty tables give empty results.
    """
    kind = F.try_element_at(F.split(key, "/"), F.lit(2)) if kind is None else kind
    step = steps.select(F.col("kind").alias("_kind"), F.col("grid_seconds").cast("long").alias("_step")).where("_step > 0").dropDuplicates(["_kind"])
    rows = readings.select(F.col(key).alias("_key"), kind.alias("_kind"), F.unix_micros(time).alias("_t"), F.col(values).cast("array<double>").alias("_v"))
    rows = rows.where(F.col("_key").isNotNull() & F.col("_t").isNotNull() & F.col("_v").isNotNull()).join(step, "_kind")
    rows = rows.withColumn("_slot", F.floor(F.col("_t") / (F.col("_step") * 1_000_000)) * F.col("_step"))
    entry = F.posexplode_outer(F.transform("_v", lambda v: F.when(~F.isnan(v), v))).alias("_e", "_x")
    entries = rows.select("_key", "_step", "_slot", entry).groupBy("_key", "_step", "_slot", "_e").agg(F.count(F.lit(1)).alias("_c"), F.avg("_x").alias("_m"))
    # Few entries per slot: the array is as long as the measurement.
    filled = entries.groupBy("_key", "_step", "_slot").agg(F.max("_c").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_e", "_m"))), lambda s: s["_m"]).alias("value"))
    filled = stage(filled.withColumn("_day", F.floor(F.col("_slot") / DAY)))
    days = filled.groupBy("_key", "_step", "_day").agg(F.min("_slot").alias("_lo"), F.max("_slot").alias("_hi"), F.max_by("value", "_slot").alias("_last"))
    by_day = Window.partitionBy("_key").orderBy("_day")
    days = days.withColumn("_pslot", F.lag("_hi").over(by_day)).withColumn("_pvalue", F.lag("_last").over(by_day)).withColumn("_next", F.lead("_day").over(by_day)).withColumn("_first", F.row_number().over(by_day) == 1)
    # Each day with readings brings the empty days up to the next one.
    gap = F.explode(F.sequence("_day", F.coalesce(F.col("_next") - 1, F.col("_day")))).alias("_d")
    own = F.col("_d") == F.col("_day")
    up = lambda x: F.ceil(x / F.col("_step")) * F.col("_step")
    days = days.select("*", gap).select(
        "_key", "_step", F.col("_d").alias("_day"), F.when(own, F.col("_lo")).alias("_lo"), F.when(own, F.col("_hi")).alias("_hi"),
        F.when(own, F.col("_pslot")).otherwise(F.col("_hi")).alias("_pslot"), F.when(own, F.col("_pvalue")).otherwise(F.col("_last")).alias("_pvalue"),
        F.when(own & F.col("_first"), F.col("_lo")).otherwise(up(F.col("_d") * DAY)).alias("_from"), F.when(F.col("_next").isNull(), F.col("_hi")).otherwise(up((F.col("_d") + 1) * DAY) - F.col("_step")).alias("_to"))
    slots = days.where("_from <= _to").select("_key", "_step", "_day", "_lo", "_hi", "_pslot", "_pvalue", F.explode(F.sequence("_from", "_to", "_step")).alias("_slot"))
    grid = slots.join(filled.select("_key", "_day", "_slot", "n", "value"), ["_key", "_day", "_slot"], "left")
    upto = Window.partitionBy("_key", "_day").orderBy("_slot")
    seen = F.last(F.when(F.col("n").isNotNull(), F.struct(F.col("_slot").alias("s"), F.col("value").alias("v"))), ignorenulls=True).over(upto)
    grid = grid.withColumn("_seen", F.coalesce(seen, F.when(F.col("_pslot").isNotNull(), F.struct(F.col("_pslot").alias("s"), F.col("_pvalue").alias("v")))))
    fresh = F.col("_slot") - F.col("_seen.s") <= max_gap_s
    status = F.when(F.col("n").isNotNull(), "observed").when(fresh, "carried").otherwise("missing")
    value = F.when(F.col("n").isNotNull(), F.col("value")).when(fresh, F.col("_seen.v"))
    within = F.coalesce((F.col("_slot") >= F.col("_lo")) & (F.col("_slot") <= F.col("_hi")), F.lit(False))
    return grid.select(F.col("_key").alias("state_key"), F.col("_slot").alias("slot_epoch"), F.coalesce("n", F.lit(0)).alias("n"), value.alias("value"), status.alias("status"), within.alias("within_day"))

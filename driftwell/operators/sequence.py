"""Positions of readings within their key, and chunks of a key of bounded size.

A key may hold a third of all rows. Nothing here sorts a whole key in one task: readings are
ranked inside (key, bucket) groups, and the ranks are shifted by the counts of the buckets
before, which are a few numbers per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.session import stage


def with_positions(df: DataFrame, key: str, bucket: Column, order: list[str]) -> DataFrame:
    """Add ``_idx`` (0-based position of the row's reading in its key) and ``_n`` (readings of the key).

    Rows that agree in all of ``order`` are one reading and share the position. ``bucket``
    must grow with ``order``. Null keys are dropped.
    """
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    ranked = stage(df.where(F.col(key).isNotNull()).withColumn("_bucket", bucket).withColumn("_rank", F.dense_rank().over(w)))
    per = ranked.groupBy(key, "_bucket").agg(F.max("_rank").cast("long").alias("_c"))
    by_key = Window.partitionBy(key)
    before = F.sum("_c").over(by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(key, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(by_key).alias("_n"))
    return ranked.join(per, [key, "_bucket"]).withColumn("_idx", F.col("_before") + F.col("_rank") - 1).drop("_rank", "_before", "_bucket")


def in_chunks(df: DataFrame, size: int, halo: int) -> DataFrame:
    """Repeat each row for every chunk that needs it: its own and, near an edge, the neighbour's.

    Adds ``_chunk`` and ``_own`` (whether the row belongs to that chunk rather than to its halo).
    """
    own, at = F.floor(F.col("_idx") / size), F.col("_idx") % size
    left = F.when((at < halo) & (own > 0), own - 1)
    right = F.when((at >= size - halo) & ((own + 1) * size < F.col("_n")), own + 1)
    return df.withColumn("_chunk", F.explode(F.array_compact(F.array(own, left, right)))).withColumn("_own", F.col("_chunk") == own)

"""Per-key results over skewed keys: eager aggregation through joins.

Both inputs shrink to one compact state per key before they meet. A hot key is folded on the
map side, so no task ever holds its rows, and the join moves one row per key and side instead
of the product of the two groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.session import stage


@dataclass(frozen=True)
class Side:
    """One input of the join: its rows, its key column and the numeric columns to aggregate."""

    rows: DataFrame
    key: str
    values: dict[str, Column]


def key_states(side: Side, prefix: str) -> DataFrame:
    """One state per key: row count and, per value, count, sum, sum of squares, least and greatest.

    Null, NaN and infinite values count for nothing; the null key keeps a state of its own.
    """
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    cols = {n: finite(c.cast("double")) for n, c in side.values.items()}
    rows = side.rows.select(F.col(side.key).alias("_key"), *(c.alias(n) for n, c in cols.items()))
    aggs = [F.count(F.lit(1)).alias(f"{prefix}n")]
    for n in cols:
        v = F.col(n)
        aggs += [F.count(v).alias(f"{prefix}{n}_n"), F.sum(v).alias(f"{prefix}{n}_sum"), F.sum(v * v).alias(f"{prefix}{n}_sq"), F.min(v).alias(f"{prefix}{n}_min"), F.max(v).alias(f"{prefix}{n}_max")]
    return rows.groupBy("_key").agg(*aggs)


def join_aggregate(left: Side, right: Side, how: str = "inner") -> DataFrame:
    """The aggregates of ``left JOIN right ON key`` per key, without forming the join.

    With n, m rows of a key: ``pairs`` = n*m; a left sum counts m times and a right sum n times; a
    sum of products over all pairs is the product of the sums; extremes carry over. ``how`` is
    ``inner`` (null keys match nothing) or ``full``, which keeps keys of one side (pairs 0) and
    the null key. Columns: ``key, left_n, right_n, pairs``, per value its own side's ``<name>_n``, ``<name>_sum``, ``<name>_sq``
    (squares), ``<name>_min``, ``<name>_max``, over the pairs ``<name>_pair_n``, ``<name>_pair_sum``, and ``<l>_x_<r>_sum`` per pair of values.
    """
    l, r = key_states(left, "l_"), key_states(right, "r_").withColumnRenamed("_key", "_rkey")
    on = F.col("_key") == F.col("_rkey") if how == "inner" else F.col("_key").eqNullSafe(F.col("_rkey"))
    j = l.join(r, on, how)
    ln, rn = F.coalesce("l_n", F.lit(0)), F.coalesce("r_n", F.lit(0))
    out = [F.coalesce("_key", "_rkey").alias("key"), ln.alias("left_n"), rn.alias("right_n"), (ln * rn).alias("pairs")]
    for names, p, other in ((left.values, "l_", rn), (right.values, "r_", ln)):
        for n in names:
            count = F.coalesce(f"{p}{n}_n", F.lit(0))
            out += [count.alias(f"{n}_n"), *(F.col(f"{p}{n}_{x}").alias(f"{n}_{x}") for x in ("sum", "sq", "min", "max"))]
            out += [(count * other).alias(f"{n}_pair_n"), (F.col(f"{p}{n}_sum") * other).alias(f"{n}_pair_sum")]
    out += [(F.col(f"l_{a}_sum") * F.col(f"r_{b}_sum")).alias(f"{a}_x_{b}_sum") for a in left.values for b in right.values]
    return j.select(*out)


def roll_up(results: DataFrame, by: Column, values: list[str]) -> DataFrame:
    """Per-key results rolled up to coarser groups, algebraically: ``(grp, left_n, right_n, pairs, <name>_n, <name>_sum, <name>_sq, <name>_min, <name>_max)``."""
    aggs = [F.sum(c).alias(c) for c in ("left_n", "right_n", "pairs")]
    for n in values:
        aggs += [F.sum(f"{n}_{x}").alias(f"{n}_{x}") for x in ("n", "sum", "sq")] + [F.min(f"{n}_min").alias(f"{n}_min"), F.max(f"{n}_max").alias(f"{n}_max")]
    return results.groupBy(by.alias("grp")).agg(*aggs)


def hot_keys(results: DataFrame, names: tuple[str, str], share: float = 0.02) -> DataFrame:
    """``(src, state_key, n, share)``: the non-null keys that hold at least ``share`` of a side's rows.

    ``results`` are those of ``join_aggregate`` in full, of the sides called ``names``; they are written, and the totals, which
    include rows without key, are rolled up from them. An empty side has no hot keys.
    """
    results = stage(results)
    totals = roll_up(results, F.lit(0), []).first()
    counts = (("left_n", totals.left_n), ("right_n", totals.right_n)) if totals else (("left_n", 0), ("right_n", 0))
    per_side = F.explode(F.array(*(F.struct(F.lit(src).alias("src"), F.col(c).alias("n"), F.lit(int(total or 0)).alias("total")) for src, (c, total) in zip(names, counts, strict=True))))
    rows = results.where(F.col("key").isNotNull()).select("key", per_side.alias("_x")).select("_x.src", F.col("key").alias("state_key"), "_x.n", (F.col("_x.n") / F.col("_x.total")).alias("share"))
    return rows.where((F.col("n") > 0) & (F.col("share") >= share))

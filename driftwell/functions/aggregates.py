"""Weighted sums of vectors and matrices, and the latest state, as built-in aggregates (partial on the map side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def axpy_array_aggregate(weight: Column, values: Column, size: int) -> Column:
    """``sum(weight * values)`` of arrays of ``size`` entries."""
    return F.array(*(F.sum(weight * F.get(values, F.lit(i))) for i in range(size)))


def weighted_mean_array(weight: Column, values: Column, size: int) -> Column:
    """``sum(weight * values) / sum(weight)``."""
    total = F.sum(weight)
    return F.array(*(F.sum(weight * F.get(values, F.lit(i))) / total for i in range(size)))


def axpy_matrix_aggregate(weight: Column, matrix: Column, rows: int, cols: int) -> Column:
    """``sum(weight * matrix)`` of matrix structs."""
    return F.struct(F.lit(rows).alias("numRows"), F.lit(cols).alias("numCols"), axpy_array_aggregate(weight, matrix["values"], rows * cols).alias("values"))


def latest_state_likelihood(loglikelihood: Column, state_index: Column, state: Column, covariance: Column) -> Column:
    """The sum of the log-likelihoods, and index, state and covariance of the greatest index."""
    last = F.max_by(F.struct(state_index.alias("stateIndex"), state.alias("state"), covariance.alias("stateCovariance")), state_index)
    return F.struct(F.sum(loglikelihood).alias("loglikelihood"), last["stateIndex"].alias("stateIndex"), last["state"].alias("state"), last["stateCovariance"].alias("stateCovariance"))

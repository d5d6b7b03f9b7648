"""Vector columns as built-in array expressions (all in the JVM), with ML vectors at the edges."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector as _ml_vector
from pyspark.ml.functions import vector_to_array as _ml_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def _to_vector(a: Column) -> Column:
    return F.when(a.isNotNull(), _ml_vector(a))


def array_to_vector(a: Column | str) -> Column:
    """``array<double>`` to a vector; null for null."""
    return _to_vector(F.col(a) if isinstance(a, str) else a)


def vector_to_array(v: Column | str) -> Column:
    """A vector to ``array<double>``; null for null."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(v.isNotNull(), _ml_array(v))


def zeros_vector(n: int) -> Column:
    """``n`` zeros."""
    return _to_vector(F.array_repeat(F.lit(0.0), n))


def ones_vector(n: int) -> Column:
    """``n`` ones."""
    return _to_vector(F.array_repeat(F.lit(1.0), n))


def dot_array(x: Column | str, y: Column | str) -> Column:
    """Dot product of two arrays; null if either is null."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def scal_array(alpha: Column | float, x: Column | str) -> Column:
    """``alpha x`` of an array."""
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    return F.transform(x, lambda v: v * a)


def axpy_array(alpha: Column | float, x: Column | str, y: Column | str) -> Column:
    """``alpha x + y`` of arrays."""
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    return F.zip_with(x, y, lambda u, v: a * u + v)


def dot_vector(x: Column | str, y: Column | str) -> Column:
    """Dot product of two vectors; null if either is null."""
    return dot_array(vector_to_array(x), vector_to_array(y))


def scal_vector(alpha: Column | float, x: Column | str) -> Column:
    """``alpha x``."""
    return _to_vector(scal_array(alpha, vector_to_array(x)))


def axpy_vector(alpha: Column | float, x: Column | str, y: Column | str) -> Column:
    """``alpha x + y``."""
    return _to_vector(axpy_array(alpha, vector_to_array(x), vector_to_array(y)))

"""Matrix columns as structs ``{numRows, numCols, values}`` (column-major) and built-in expressions, with ML matrices at the edges.

Functions named ``..._struct`` take and give such structs and arrays; the others take ML matrices and vectors. All but
``rand_multi_gaussian_with_col``, which needs a decomposition per row, stay in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, MatrixUDT, VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions.vectors import array_to_vector as _vector
from driftwell.functions.vectors import vector_to_array as _array

STRUCT = "struct<numRows:int,numCols:int,values:array<double>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _struct(rows: Column | int, cols: Column | int, values: Column) -> Column:
    rows, cols = (F.lit(n) if isinstance(n, int) else n.cast("int") for n in (rows, cols))
    return F.named_struct(F.lit("numRows"), rows, F.lit("numCols"), cols, F.lit("values"), values)


def _bound(fn, *cols: Column) -> Column:
    """``fn`` of columns that are bound as a lambda's variables, so that each is worked out once a row; null if one of them is."""
    named = F.named_struct(*(x for i, c in enumerate(cols) for x in (F.lit(f"_{i}"), c)))
    return F.get(F.transform(F.array(named), lambda s: _known(fn(*(s[f"_{i}"] for i in range(len(cols)))), *(s[f"_{i}"] for i in range(len(cols))))), F.lit(0))


def _upto(n: Column | int) -> Column:
    """0 .. n - 1; empty for 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _filled(rows: Column, cols: Column, entry) -> Column:
    """The struct with ``entry(i, j)`` at row i, column j."""
    values = F.flatten(F.transform(_upto(cols), lambda j: F.transform(_upto(rows), lambda i: entry(i, j))))
    return _struct(rows, cols, values)


def _at(m: Column, i: Column, j: Column) -> Column:
    return F.get(m["values"], (j * m["numRows"] + i).cast("int"))


def _sum(n: Column, term) -> Column:
    return F.aggregate(_upto(n), F.lit(0.0), lambda s, k: s + term(k))


def _known(value: Column, *needed: Column) -> Column:
    """``value`` where nothing needed is null."""
    ok = F.lit(True)
    for n in needed:
        ok = ok & n.isNotNull()
    return F.when(ok, value)


def eye_struct(n: int) -> Column:
    """The identity matrix of size ``n``."""
    return _filled(F.lit(n), F.lit(n), lambda i, j: F.when(i == j, 1.0).otherwise(0.0))


def zeros_struct(rows: int, cols: int) -> Column:
    """A matrix of zeros."""
    return _struct(rows, cols, F.array_repeat(F.lit(0.0), rows * cols))


def diag_struct(v: Column | str) -> Column:
    """The matrix with the array ``v`` on its diagonal."""
    return _bound(lambda x: _filled(F.size(x), F.size(x), lambda i, j: F.when(i == j, F.get(x, i)).otherwise(0.0)), _col(v))


def _transposed(m: Column) -> Column:
    return _filled(m["numCols"], m["numRows"], lambda i, j: _at(m, j, i))


def _product(a: Column, b: Column) -> Column:
    return F.when(a["numCols"] == b["numRows"], _filled(a["numRows"], b["numCols"], lambda i, j: _sum(a["numCols"], lambda k: _at(a, i, k) * _at(b, k, j))))


def transpose_struct(m: Column | str) -> Column:
    """``M'``."""
    return _bound(_transposed, _col(m))


def multiply_struct(a: Column | str, b: Column | str) -> Column:
    """``A B``; null where the sizes don't fit."""
    return _bound(_product, _col(a), _col(b))


def multiply_struct_array(a: Column | str, v: Column | str) -> Column:
    """``A v`` of an array ``v``; null where the sizes don't fit."""
    return _bound(lambda m, x: F.when(m["numCols"] == F.size(x), F.transform(_upto(m["numRows"]), lambda i: _sum(m["numCols"], lambda k: _at(m, i, k) * F.get(x, k)))), _col(a), _col(v))


def project_struct(m: Column | str, a: Column | str) -> Column:
    """``A M A'``; null where the sizes don't fit."""
    return _bound(lambda x, am: F.when(am["numCols"] == x["numCols"], _filled(am["numRows"], x["numRows"], lambda i, j: _sum(x["numCols"], lambda k: _at(am, i, k) * _at(x, j, k)))), _col(a), multiply_struct(a, m))


def outer_struct(alpha: Column | str | float, x: Column | str, y: Column | str) -> Column:
    """``alpha x y'`` of arrays."""
    s = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else _col(alpha)
    return _bound(lambda s, u, v: _filled(F.size(u), F.size(v), lambda i, j: s * F.get(u, i) * F.get(v, j)), s, _col(x), _col(y))


def matrix_to_array(m: Column | str) -> Column:
    """``{numRows, numCols, values}`` of an ML matrix, dense or sparse, column-major; null for null."""

    def plain(u: Column) -> Column:
        rows, cols = u["numRows"], u["numCols"]

        def entry(i: Column, j: Column) -> Column:
            """An entry of a sparse matrix, stored by columns, or by rows if transposed."""
            major, minor = F.when(u["isTransposed"], i).otherwise(j), F.when(u["isTransposed"], j).otherwise(i)
            lo, hi = F.get(u["colPtrs"], major), F.get(u["colPtrs"], major + 1)
            place = F.array_position(F.slice(u["rowIndices"], lo + 1, hi - lo), minor)
            return F.when(u["type"] == 1, F.get(u["values"], i * cols + j)).when(place > 0, F.get(u["values"], (lo + place - 1).cast("int"))).otherwise(0.0)

        given = _struct(rows, cols, u["values"])
        return F.when((u["type"] == 1) & ~u["isTransposed"], given).otherwise(_filled(rows, cols, entry))

    return _bound(plain, F.unwrap_udt(_col(m)))


_BOXED = T.StructType([T.StructField("m", MatrixUDT())])


def _boxed(m: Column) -> Column:
    """An ML matrix of a struct, in the JVM: its stored form is read back from JSON, which keeps doubles as they are."""
    stored = F.named_struct(F.lit("type"), F.lit(1), F.lit("numRows"), m["numRows"], F.lit("numCols"), m["numCols"], F.lit("values"), m["values"], F.lit("isTransposed"), F.lit(False))
    return F.from_json(F.to_json(F.named_struct(F.lit("m"), stored)), _BOXED)["m"]


def array_to_matrix(*args: Column | str | int) -> Column:
    """An ML matrix from the struct of ``matrix_to_array``, or from (rows, columns, column-major values); null for null."""
    if len(args) == 1:
        return _bound(_boxed, _col(args[0]))
    rows, cols, values = args
    v = _col(values)
    return F.when(v.isNotNull(), _boxed(_struct(rows, cols, v.cast("array<double>"))))


def eye_matrix(n: int) -> Column:
    """The identity matrix of size ``n``."""
    return array_to_matrix(eye_struct(n))


def zeros_matrix(rows: int, cols: int) -> Column:
    """A matrix of zeros."""
    return array_to_matrix(zeros_struct(rows, cols))


def diag_matrix(v: Column | str) -> Column:
    """The matrix with ``v`` on its diagonal."""
    return array_to_matrix(diag_struct(_array(v)))


def multiply_matrix(a: Column | str, b: Column | str) -> Column:
    """``A B``."""
    return array_to_matrix(multiply_struct(matrix_to_array(a), matrix_to_array(b)))


def multiply_matrix_vector(a: Column | str, v: Column | str) -> Column:
    """``A v``."""
    return _vector(multiply_struct_array(matrix_to_array(a), _array(v)))


def project_matrix(m: Column | str, a: Column | str) -> Column:
    """``A M A'`` of matrix ``m`` by ``a``."""
    return array_to_matrix(project_struct(matrix_to_array(m), matrix_to_array(a)))


def outer_product(alpha: Column | str | float, x: Column | str, y: Column | str) -> Column:
    """``alpha x y'``."""
    return array_to_matrix(outer_struct(alpha, _array(x), _array(y)))


def scale_to_multi_gaussian(mean: Column | str, root: Column | str, z: Column | str) -> Column:
    """``mean + root z``: standard normal vectors to those of a Gaussian."""
    return _vector(F.zip_with(_array(mean), multiply_struct_array(matrix_to_array(root), _array(z)), lambda a, b: a + b))


def rand_multi_gaussian(mean, covariance, seed: int = 0) -> Column:
    """A column of samples of the Gaussian with this mean and covariance (constants)."""
    mean, cov = np.asarray(mean.toArray() if hasattr(mean, "toArray") else mean, float), np.asarray(covariance.toArray() if hasattr(covariance, "toArray") else covariance, float)
    root = np.linalg.cholesky(cov)
    z = [F.randn(seed + i) for i in range(len(mean))]
    rows = F.array(*(F.struct(F.lit(float(mean[i])).alias("m"), F.array(*(F.lit(float(v)) for v in root[i])).alias("r")) for i in range(len(mean))))
    # The draw is bound as a lambda's variable, so that all entries see the same one.
    sample = lambda draw: F.transform(rows, lambda row: row["m"] + F.aggregate(F.zip_with(row["r"], draw, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    return array_to_vector(F.get(F.transform(F.array(F.array(*z)), sample), F.lit(0)))


def rand_multi_gaussian_with_col(mean: Column | str, covariance: Column | str, size: int, seed: int = 0) -> Column:
    """Samples of each row's Gaussian of dimension ``size``."""
    z = array_to_vector(F.array(*(F.randn(seed + i) for i in range(size))))
    sample = lambda m, c, s: None if m is None or c is None else DenseVector(m.toArray() + np.linalg.cholesky(c.toArray()) @ s.toArray())
    return F.udf(sample, VectorUDT(), useArrow=True)(mean, covariance, z)


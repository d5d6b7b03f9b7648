"""Column functions against numpy."""

import numpy as np
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import functions as F

from driftwell import functions as f


def one(spark, *cols, rows=None):
    rows = rows or [(Vectors.dense([1.0, 2.0]), Vectors.dense([3.0, -1.0]), DenseMatrix(2, 2, [4.0, 2.0, 2.0, 4.0]), DenseMatrix(2, 2, [1.0, 0.0, 3.0, 2.0]), [1.0, 2.0])]
    return spark.createDataFrame(rows, ["x", "y", "a", "b", "arr"]).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_vectors(spark):
    r = one(spark, f.dot_vector("x", "y"), f.scal_vector(2.0, "x"), f.axpy_vector(2.0, "x", "y"), f.array_to_vector("arr"), f.vector_to_array("y"), f.zeros_vector(2), f.ones_vector(3))
    assert r[0] == 1.0 and r[1] == Vectors.dense([2, 4]) and r[2] == Vectors.dense([5, 3]) and r[3] == Vectors.dense([1, 2]) and r[4] == [3.0, -1.0] and r[5] == Vectors.dense([0, 0]) and r[6] == Vectors.dense([1, 1, 1])


def test_matrices(spark):
    a, b, x, y = np.array([[4.0, 2], [2, 4]]), np.array([[1.0, 3], [0, 2]]), np.array([1.0, 2]), np.array([3.0, -1])
    r = one(spark, f.multiply_matrix("a", "b"), f.multiply_matrix_vector("b", "x"), f.project_matrix("a", "b"), f.outer_product(2.0, "x", "y"), f.matrix_to_array("b"), f.array_to_matrix(1, 2, "arr"), f.eye_matrix(2), f.zeros_matrix(2, 3), f.diag_matrix("x"), f.scale_to_multi_gaussian("x", "b", "y"), f.array_to_matrix(f.matrix_to_array("b")))
    assert np.allclose(r[0].toArray(), a @ b) and np.allclose(r[1].toArray(), b @ x) and np.allclose(r[2].toArray(), b @ a @ b.T) and np.allclose(r[3].toArray(), 2 * np.outer(x, y))
    assert r[4].values == [1.0, 0.0, 3.0, 2.0] and r[5].toArray().tolist() == [[1.0, 2.0]] and np.allclose(r[6].toArray(), np.eye(2)) and r[7].toArray().tolist() == [[0.0] * 3] * 2
    assert np.allclose(r[8].toArray(), np.diag(x)) and np.allclose(r[9].toArray(), x + b @ y) and np.allclose(r[10].toArray(), b)


def test_matrix_layouts_and_sizes(spark):
    from pyspark.ml.linalg import SparseMatrix

    rows = [(DenseMatrix(2, 3, [1.0, 2, 3, 4, 5, 6], True),), (SparseMatrix(3, 2, [0, 1, 3], [2, 0, 1], [7.0, 8.0, 9.0]),), (SparseMatrix(2, 3, [0, 1, 3], [2, 0, 1], [7.0, 8.0, 9.0], True),), (DenseMatrix(0, 0, []),)]
    df = spark.createDataFrame(rows, ["m"])
    for r, (m,) in zip(df.select(f.matrix_to_array("m").alias("s"), f.array_to_matrix(f.matrix_to_array("m")).alias("m")).collect(), rows, strict=True):
        assert r.s.values == m.toArray().ravel("F").tolist() and (r.s.numRows, r.s.numCols) == (m.numRows, m.numCols) and np.array_equal(r.m.toArray(), m.toArray())
    wide = df.limit(1).select(f.multiply_struct(f.matrix_to_array("m"), f.matrix_to_array("m")).alias("no"), f.multiply_struct(f.matrix_to_array("m"), f.transpose_struct(f.matrix_to_array("m"))).alias("yes")).first()
    a = rows[0][0].toArray()
    assert wide.no is None and np.allclose(wide.yes["values"], (a @ a.T).ravel("F"))


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0]), 1)], ["y", "i"]).withColumn("x", F.when(F.col("i") > 1, F.col("y")))
    r = df.select(f.dot_vector("x", "y").alias("d"), f.axpy_vector(1.0, "x", "y").alias("s"), f.vector_to_array("x").alias("a"), f.diag_matrix("x").alias("m")).first()
    assert list(r) == [None] * 4


def test_gaussian_samples(spark):
    cov = np.array([[2.0, 0.6], [0.6, 1.0]])
    s = spark.range(20_000).select(f.vector_to_array(f.rand_multi_gaussian([1.0, -2.0], cov, 3)).alias("v"))
    x = np.array([r[0] for r in s.collect()])
    assert np.allclose(x.mean(axis=0), [1, -2], atol=0.05) and np.allclose(np.cov(x.T), cov, atol=0.08)
    one_ = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), DenseMatrix(2, 2, [1.0, 0.0, 0.0, 1.0]))], ["m", "c"]).select(f.rand_multi_gaussian_with_col("m", "c", 2, 1)).first()[0]
    assert one_.size == 2


def test_aggregates(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0], 1, 3.0), (2.0, [3.0, -1.0], 2, 4.0), (0.5, [0.0, 4.0], 0, 5.0)], "w double, v array<double>, i int, ll double")
    m = F.struct(F.lit(2).alias("numRows"), F.lit(1).alias("numCols"), F.col("v").alias("values"))
    r = df.agg(f.axpy_array_aggregate(F.col("w"), F.col("v"), 2), f.weighted_mean_array(F.col("w"), F.col("v"), 2), f.axpy_matrix_aggregate(F.col("w"), m, 2, 1), f.latest_state_likelihood(F.col("ll"), F.col("i"), F.col("v"), F.col("w"))).first()
    assert r[0] == [7.0, 2.0] and np.allclose(r[1], [2.0, 2 / 3.5]) and r[2].values == [7.0, 2.0]
    assert (r[3].loglikelihood, r[3].stateIndex, r[3].state, r[3].stateCovariance) == (12.0, 2, [3.0, -1.0], 2.0)


def test_vector_aggregate_query_sums_whole_vectors(spark, tmp_path):
    from driftwell.plans.state_queries import vector_aggregate

    x = np.random.default_rng(5).normal(size=(12, 64)).astype("float32")
    rows = [(i, f"l{i % 2}", x[i].tolist()) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.label, r.pos): r.total for r in vector_aggregate(spark, str(tmp_path)).collect()}
    assert set(got) == {(f"l{k}", p) for k in (0, 1) for p in range(64)}
    for (label, pos), total in got.items():
        assert np.isclose(total, sum((i % 3 + 1) * float(x[i, pos]) for i in range(12) if f"l{i % 2}" == label), atol=1e-5)

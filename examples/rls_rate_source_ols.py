"""Ordinary least squares of a rate source by recursive least squares, per key, to the console.

    spark-submit examples/rls_rate_source_ols.py [keys] [rows per second]
"""

import sys

from pyspark.sql import SparkSession

from driftwell.estimators import RecursiveLeastSquaresFilter
from driftwell.streaming import rate_regressions, to_console

if __name__ == "__main__":
    keys, rows = map(int, [*sys.argv[1:3], "10", "10"][:2])
    spark = SparkSession.builder.appName("rls_rate_source_ols").getOrCreate()
    model = RecursiveLeastSquaresFilter(stateKeyCol="stateKey", eventTimeCol="timestamp", featureSize=3, regularizationMatrixFactor=1e6)
    to_console(model.transform(rate_regressions(spark, keys, rows)).select("stateKey", "stateIndex", "state.mean", "timestamp")).awaitTermination()

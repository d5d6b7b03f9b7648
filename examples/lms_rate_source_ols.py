"""Ordinary least squares of a rate source by least mean squares, per key, to the console.

    spark-submit examples/lms_rate_source_ols.py [keys] [rows per second]
"""

import sys

from pyspark.sql import SparkSession

from driftwell.estimators import LeastMeanSquaresFilter
from driftwell.streaming import rate_regressions, to_console

if __name__ == "__main__":
    keys, rows = map(int, [*sys.argv[1:3], "10", "10"][:2])
    spark = SparkSession.builder.appName("lms_rate_source_ols").getOrCreate()
    model = LeastMeanSquaresFilter(stateKeyCol="stateKey", eventTimeCol="timestamp", featureSize=3, learningRate=0.5)
    to_console(model.transform(rate_regressions(spark, keys, rows)).select("stateKey", "stateIndex", "state", "timestamp")).awaitTermination()

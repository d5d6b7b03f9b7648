"""Ordinary least squares of a rate source by a linear filter whose measurement model is the row of features.

    spark-submit examples/lkf_rate_source_ols.py [keys] [rows per second]
"""

import sys

import numpy as np
from pyspark.sql import SparkSession

from driftwell.estimators import LinearKalmanFilter
from driftwell.streaming import rate_regressions, to_console

if __name__ == "__main__":
    keys, rows = map(int, [*sys.argv[1:3], "10", "10"][:2])
    spark = SparkSession.builder.appName("lkf_rate_source_ols").getOrCreate()
    model = LinearKalmanFilter(stateKeyCol="stateKey", eventTimeCol="timestamp", stateSize=3, measurementModelCol="measurementModel")
    model.setInitialStateCovariance(np.eye(3) * 10).setProcessNoise(np.zeros((3, 3))).setMeasurementNoise([[0.01]])
    to_console(model.transform(rate_regressions(spark, keys, rows)).select("stateKey", "stateIndex", "state.mean", "timestamp")).awaitTermination()

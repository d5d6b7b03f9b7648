"""One regression by averaging the filters of many keys by their likelihoods, in windows of event time.

    spark-submit examples/mmae_rate_source_ols.py [keys] [rows per second]
"""

import sys

import numpy as np
from pyspark.sql import SparkSession

from driftwell.estimators import LinearKalmanFilter
from driftwell.streaming import rate_regressions, to_console

if __name__ == "__main__":
    keys, rows = map(int, [*sys.argv[1:3], "10", "10"][:2])
    spark = SparkSession.builder.appName("mmae_rate_source_ols").getOrCreate()
    model = LinearKalmanFilter(stateKeyCol="stateKey", eventTimeCol="timestamp", watermarkDuration="10 seconds", stateSize=3, measurementModelCol="measurementModel", calculateSlidingLikelihood=True)
    model.setInitialStateCovariance(np.eye(3) * 10).setProcessNoise(np.zeros((3, 3))).setMeasurementNoise([[1.0]]).setSlidingLikelihoodWindow(5)
    model.setMultipleModelAdaptiveEstimationEnabled().setMultipleModelMeasurementWindowDuration("5 seconds")
    to_console(model.transform(rate_regressions(spark, keys, rows)).select("stateIndex", "state.mean", "timestamp")).awaitTermination()

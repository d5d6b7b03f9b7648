"""Local linear trends of a rate source, filtered per key, to the console.

    spark-submit examples/lkf_rate_source.py [keys] [rows per second]
"""

import sys

from pyspark.sql import SparkSession

from driftwell.estimators import LinearKalmanFilter
from driftwell.streaming import rate_readings, to_console

if __name__ == "__main__":
    keys, rows = map(int, [*sys.argv[1:3], "10", "10"][:2])
    spark = SparkSession.builder.appName("lkf").getOrCreate()
    trend = LinearKalmanFilter(stateKeyCol="stateKey", eventTimeCol="timestamp", watermarkDuration="10 seconds", stateSize=2)
    trend.setProcessModel([[1.0, 1.0], [0.0, 1.0]]).setMeasurementModel([[1.0, 0.0]]).setProcessNoise([[0.01, 0.0], [0.0, 0.001]]).setMeasurementNoise([[100.0]]).setCalculateMahalanobis(True)
    to_console(trend.transform(rate_readings(spark, keys, rows)).select("stateKey", "stateIndex", "state.mean", "mahalanobis", "timestamp")).awaitTermination()

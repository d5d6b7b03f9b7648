"""A generalised linear model with a logarithmic link by a cubature filter, per key.

    spark-submit examples/ckf_rate_source_glm_log.py [keys] [rows per second]
"""

import sys

import numpy as np
from pyspark.sql import SparkSession

from driftwell.estimators import CubatureKalmanFilter
from driftwell.streaming import rate_regressions, to_console

if __name__ == "__main__":
    keys, rows = map(int, [*sys.argv[1:3], "10", "10"][:2])
    spark = SparkSession.builder.appName("ckf_rate_source_glm_log").getOrCreate()
    model = CubatureKalmanFilter(stateKeyCol="stateKey", eventTimeCol="timestamp", stateSize=3, measurementModelCol="measurementModel")
    model.setInitialStateCovariance(np.eye(3) * 0.1).setProcessNoise(np.zeros((3, 3))).setMeasurementNoise([[1.0]])
    model.setMeasurementFunction(lambda x, h: np.exp(np.clip(h @ x, -20, 20)))
    to_console(model.transform(rate_regressions(spark, keys, rows, "log")).select("stateKey", "stateIndex", "state.mean", "timestamp")).awaitTermination()

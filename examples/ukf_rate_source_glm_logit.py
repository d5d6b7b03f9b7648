"""A generalised linear model with a logistic link by an unscented filter, per key.

    spark-submit examples/ukf_rate_source_glm_logit.py [keys] [rows per second]
"""

import sys

import numpy as np
from pyspark.sql import SparkSession

from driftwell.estimators import UnscentedKalmanFilter
from driftwell.streaming import rate_regressions, to_console

if __name__ == "__main__":
    keys, rows = map(int, [*sys.argv[1:3], "10", "10"][:2])
    spark = SparkSession.builder.appName("ukf_rate_source_glm_logit").getOrCreate()
    model = UnscentedKalmanFilter(stateKeyCol="stateKey", eventTimeCol="timestamp", stateSize=3, measurementModelCol="measurementModel")
    model.setInitialStateCovariance(np.eye(3) * 0.1).setProcessNoise(np.zeros((3, 3))).setMeasurementNoise([[0.001]])
    model.setMeasurementFunction(lambda x, h: 1 / (1 + np.exp(-np.clip(h @ x, -30, 30))))
    to_console(model.transform(rate_regressions(spark, keys, rows, "logit")).select("stateKey", "stateIndex", "state.mean", "timestamp")).awaitTermination()

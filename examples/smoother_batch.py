"""Fixed-lag smoothing of a table of local trends, per key.

    spark-submit examples/smoother_batch.py [keys] [rows per key]
"""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftwell.estimators import LinearKalmanSmoother

if __name__ == "__main__":
    keys, rows = map(int, [*sys.argv[1:3], "10", "100"][:2])
    spark = SparkSession.builder.appName("smoother").getOrCreate()
    i = F.floor(F.col("id") / keys)
    table = spark.range(keys * rows).select((F.col("id") % keys).cast("string").alias("stateKey"), F.timestamp_seconds(600 * i).alias("timestamp"), F.array(i + 20 * F.randn(1)).alias("measurement"))
    model = LinearKalmanSmoother(stateKeyCol="stateKey", eventTimeCol="timestamp", stateSize=2, fixedLag=10)
    model.setProcessModel([[1.0, 1.0], [0.0, 1.0]]).setMeasurementModel([[1.0, 0.0]]).setMeasurementNoise([[400.0]]).setProcessNoise([[0.01, 0.0], [0.0, 0.001]])
    model.transform(table).orderBy("stateKey", "stateIndex", "stepIndex").show(50, truncate=False)

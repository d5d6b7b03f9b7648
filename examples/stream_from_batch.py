"""A batch run's last states as the start of a stream.

    spark-submit examples/stream_from_batch.py HISTORY_PARQUET NEW_FILES_FOLDER OUT CHECKPOINT
"""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftwell.estimators import RecursiveLeastSquaresFilter
from driftwell.streaming import folder_stream, to_folder

if __name__ == "__main__":
    history, fresh, out, checkpoint = sys.argv[1:5]
    spark = SparkSession.builder.appName("stream from batch").getOrCreate()
    past = spark.read.parquet(history)
    rls = RecursiveLeastSquaresFilter(stateKeyCol="state_key", eventTimeCol="event_time")
    last = rls.transform(past).groupBy("state_key").agg(F.max_by("state", "stateIndex").alias("initial"))
    stream = folder_stream(spark, fresh, past.schema).join(last, "state_key", "left")
    to_folder(rls.copy().setInitialStateDistributionCol("initial").transform(stream), out, checkpoint).awaitTermination()

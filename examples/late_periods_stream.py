"""Hourly medians of a folder of readings that arrive late, corrected with every micro-batch.

    spark-submit examples/late_periods_stream.py <folder of Parquet files> <folder for the states>
"""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftwell.streaming import PeriodStream, folder_stream

if __name__ == "__main__":
    source, states = sys.argv[1:3]
    spark = SparkSession.builder.appName("late_periods").getOrCreate()
    readings = folder_stream(spark, source, spark.read.parquet(source).schema)
    periods = PeriodStream(states, F.try_element_at("measurement", F.lit(1)))
    periods.start(readings, f"{states}/checkpoint").awaitTermination()
    periods.stats(spark).orderBy("key", "period").show(truncate=False)

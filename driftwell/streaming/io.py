"""Structured Streaming in and out: rate and folder sources; console, memory and Parquet sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def rate_readings(spark: SparkSession, keys: int = 10, rows_per_second: int = 10) -> DataFrame:
    """A stream of local linear trends with noise for load tests: ``stateKey, timestamp, measurement`` (array of one)."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    value = F.col("value") / keys + F.randn() * 10
    return rate.select((F.col("value") % keys).cast("string").alias("stateKey"), "timestamp", F.array(value).alias("measurement"))


def rate_regressions(spark: SparkSession, keys: int = 10, rows_per_second: int = 10, link: str = "identity") -> DataFrame:
    """A stream of regressions for load tests: ``stateKey, timestamp, label, features, measurement, measurementModel``.

    The linear predictor of features ``[x, sqrt(x), 1]`` has the coefficients 0.5, -0.7 and 2, and noise; ``link`` (``identity``, ``log``, ``logit``) makes the label of it.
    """
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    x = (F.col("value") / keys % 40).cast("double")
    eta = 0.5 * x - 0.7 * F.sqrt(x) + 2.0
    scaled = {"identity": eta, "log": F.exp(eta / 10), "logit": 1 / (1 + F.exp(-(eta - 6) / 3))}[link]
    features = F.array(x, F.sqrt(x), F.lit(1.0))
    label = scaled + F.randn() * (0.01 if link == "logit" else 0.1)
    return rate.select((F.col("value") % keys).cast("string").alias("stateKey"), "timestamp", label.alias("label"), features.alias("features"), F.array(label).alias("measurement"), F.array(features).alias("measurementModel"))


def folder_stream(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drain(df: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and give what came out, as a batch frame (memory sink: for tests and small results)."""
    name = f"drained_{uuid.uuid4().hex}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def to_console(df: DataFrame, mode: str = "append") -> StreamingQuery:
    """Print each micro-batch."""
    return df.writeStream.format("console").outputMode(mode).option("truncate", "false").start()


def to_folder(df: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to a folder of Parquet files, restartable from its checkpoint; without ``every`` it ends when all is read."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start(folder)

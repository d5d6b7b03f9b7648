"""Period aggregates of a stream that are corrected as late rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwell.operators import late


class PeriodStream:
    """Value-count states of a stream's periods, kept as tables in ``folder``.

    Each micro-batch writes, under its number, the changes of the counts (``changes``), the rows left out as too late (``left_out``), and the
    greatest event time of each key so far (``tops``). A batch that is run again after a failure replaces what it wrote, so
    every row counts once. ``stats`` derives exact statistics from the sums of the changes at any time. Rows of a later batch count as
    arrived later. Null keys and event times take no part.
    """

    def __init__(self, folder: str, value: Column, *, key: str = "state_key", period_s: int = 3600, cutoff_s: int = 7200, **columns: str) -> None:
        self.folder, self.value, self.key, self.period_s, self.cutoff_s, self.columns = folder.rstrip("/"), value, key, period_s, cutoff_s, columns

    def start(self, rows: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Run over a stream; without ``every`` it ends when all is read."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return rows.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def take(self, batch: DataFrame, number: int) -> None:
        """Fold one micro-batch in."""
        spark = batch.sparkSession
        before = self._read(spark, "tops", f"{self.key} {batch.schema[self.key].dataType.simpleString()}, top bigint").where(F.col("batch") == number - 1).select(self.key, "top")
        marked = late.with_frontier(batch, key=self.key, cutoff_s=self.cutoff_s, start=before, **self.columns).persist()
        try:
            self._write(late.multiset(marked, self.value, key=self.key, period_s=self.period_s), "changes", number)
            self._write(marked.where("is_late").select(*batch.columns), "left_out", number)
            tops = marked.groupBy(self.key).agg(F.max("_event").alias("top")).unionByName(before).groupBy(self.key).agg(F.max("top").alias("top"))
            self._write(tops, "tops", number)
        finally:
            marked.unpersist()

    def stats(self, spark: SparkSession) -> DataFrame:
        """``late.period_stats`` of all that was taken."""
        changes = spark.read.parquet(f"{self.folder}/changes").drop("batch")
        return late.period_stats(late.combine(changes))

    def left_out(self, spark: SparkSession) -> DataFrame:
        """The rows that came too late, with the number of their batch."""
        return spark.read.parquet(f"{self.folder}/left_out")

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/{name}") if there else spark.createDataFrame([], f"{schema}, batch int")

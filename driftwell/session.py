"""Session-level helpers: the shared scratch folder, staged tables, grouped Arrow passes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_staged: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without that setting; a temporary folder is made then.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftwell-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at files that survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(lambda: [_remove(spark, p) for p in _staged])
    _staged.add(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, in as many partitions as the session's shuffles have.

    The number is given, so adaptive execution doesn't merge partitions that are small in bytes but
    dear in Python.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _starts(table: pa.Table, keys: list[str]) -> list[int]:
    n = table.num_rows
    changed = None
    for k in keys:
        col = table.column(k).combine_chunks()
        a, b = col.slice(1), col.slice(0, n - 1)
        diff = pc.or_kleene(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        diff = pc.fill_null(diff, False)
        changed = diff if changed is None else pc.or_(changed, diff)
    return [0, *(pc.add(pc.indices_nonzero(changed), 1).to_pylist() if n > 1 else [])]


def map_sorted_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table, list[int]], pa.Table | None], schema: str) -> DataFrame:
    """Call ``fn(table, starts)`` on runs of whole groups: rows of equal ``keys``, sorted by ``order``.

    ``starts`` holds the first row of each group. A group must fit in memory, so callers
    bound its size first (chunks of a key, not keys).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
            out = fn(table, starts) if table.num_rows else None
            if out is not None:
                yield from out.to_batches(max_chunksize=20_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            # While a group is still open, only its last row is needed to see whether it goes on.
            if held and len(_starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]), keys)) == 1:
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch])
            starts = _starts(table, keys)
            yield from emit(table.slice(0, starts[-1]), starts[:-1])
            held = table.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from emit(table, _starts(table, keys))

    return by_key(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

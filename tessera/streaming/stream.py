"""The same column functions over streams: every task is stateless by row, so a stream is a batch without an end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def image_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Encoded files of a folder as they arrive: path, modificationTime, length, content."""
    source = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger)
    return source.schema("path string, modificationTime timestamp, length long, content binary").load(path)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Apply a table function to all that is there, and end; exactly once by the checkpoint. State is kept by RocksDB,
    which keyed processors need; the session's own choice is put back once the query has begun."""
    spark = stream.sparkSession
    query = apply(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        running = query.start(out)
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    running.awaitTermination()


_own_folder: str | None = None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the cluster's checkpoints. Where the session names none, a scratch folder will do on a single
    machine and is an error on a cluster."""
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_folder = _own_folder or tempfile.mkdtemp(prefix="spark-tessera-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def windowed_counts(events: DataFrame, column: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Rows by time window and value of a column, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), column).agg(F.count("*").alias("n"))

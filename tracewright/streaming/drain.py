"""Runs a stream to its present end and gives what it wrote as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Later than any entry (the year 9999), and how far the watermark then lies behind: no entry is late before the end, all are at it.
END, LATE = 253_370_764_800, "36500 days"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory, and what arbitrary state needs; a provider that is set already stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if not (spark.conf.get(key, "") or "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(key, ROCKSDB)


def drain(stream: DataFrame) -> DataFrame:
    """Writes all that is there to the shared folder, exactly once, and reads it back."""
    base = _folder(stream.sparkSession)
    _run(stream, base)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def drain_closed(stream: DataFrame, windows: Callable[[DataFrame], DataFrame], time: str = "time") -> DataFrame:
    """As drain(windows(stream)), but the windows that are open at the end come out as well.

    When all rows are in, a run from the same checkpoint takes one more row, of time END, which moves the watermark past
    all others. Its own window stays open, so it is in no result. ``windows`` has to take LATE as the delay of the
    watermark; then rows may come in any order over the micro-batches, and the state holds all windows until the end.
    """
    spark = stream.sparkSession
    base = _folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/end")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    out = windows(stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{base}/end")))
    _run(out, base)
    spark.range(1).select(*[F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in stream.schema]).write.mode("append").parquet(f"{base}/end")
    _run(out, base)
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _run(stream: DataFrame, base: str) -> None:
    use_rocksdb(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()

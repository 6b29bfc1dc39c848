"""Micro-batch ingest into a log store: file or rate source, hooks and validation, appends that are safe to run again."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracewright.schema import SCHEMAS
from tracewright.sources.store import Hook, append, validated


def events(spark: SparkSession, folder: str, family: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(SCHEMAS[family]).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start(stream: DataFrame, folder: str, family: str, checkpoint: str, hooks: tuple[Hook, ...] = (), once: bool = False) -> StreamingQuery:
    """Appends each micro-batch to the store, twice a second, or all there is and then stops (``once``).

    A batch leaves a marker once it is appended, and one that is run again with its marker there is left out. A driver
    lost between the two appends a batch again: its rows are re-deliveries of the same ids, which all reads count once.
    """

    def write(df: DataFrame, batch: int) -> None:
        marker = os.path.join(folder, "_batches", family, str(batch))
        fs, path = _path(df.sparkSession, marker)
        if fs.exists(path):
            return
        out = validated(df, family)
        for hook in hooks:
            out = out.transform(hook)
        append(out, folder, family)
        fs.create(path).close()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="500 milliseconds")).start()


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

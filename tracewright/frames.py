"""Helpers shared by the operators: entry identity and whole groups out of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame) -> DataFrame:
    """One row for each entry: re-delivered copies are equal in all columns, so the frame (with its id) is made distinct.

    Call it after filters and projections, since these commute with it and shrink what is shuffled. A distinct over
    all columns is a hash aggregate; picking first values by id would sort wherever there are strings.
    """
    return df.distinct()


def bucket(time: Column, seconds: int) -> Column:
    """Number of the time bucket, also for times before 1970."""
    return F.floor(time / F.lit(seconds)).cast("long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from the batches of a partition sorted by ``keys``.

    The group at the end of a batch waits for the next one, so at most one group and one batch are held.
    """
    waiting: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        change[0] = last is not None and first != last
        last = tuple(batch.column(batch.schema.get_field_index(k))[-1].as_py() for k in keys)
        at = np.flatnonzero(change)
        if not len(at):
            waiting.append(batch)
            continue
        cut = int(at[-1])
        if waiting or cut:
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
        waiting = [batch.slice(cut)]
    if waiting:
        yield pa.Table.from_batches(waiting)


def before(df: DataFrame, keys: list[str], columns: list[str], out: str = "_before", time: str = "time", id_col: str = "id", seconds: int = 86_400) -> DataFrame:
    """With ``out``, a struct of the columns of the row before in (time, id) order of the key; null for a key's first row.

    Rows are ordered in (key, time bucket) groups; only the last row of each bucket meets per key.
    """
    row = F.struct(*columns)
    w = Window.partitionBy(*keys, "_bucket").orderBy(time, id_col)
    x = df.withColumn("_bucket", bucket(F.col(time), seconds)).withColumn("_inside", F.lag(row).over(w))
    last = x.groupBy(*keys, "_bucket").agg(F.max_by(row, F.struct(time, id_col)).alias("_last"))
    carried = last.select(*keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    on = reduce(lambda a, c: a & c, [F.col(f"x.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_bucket"]])
    return x.alias("x").join(carried.alias("c"), on, "left").select("x.*", F.coalesce("x._inside", "c._carried").alias(out)).drop("_bucket", "_inside")

"""Content-addressed payloads: hashing, storing each once, encoding policy, resolving, backfill."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW, ZSTD, LEVEL, LEAST_BYTES, BATCH = 0, 1, 3, 128, 1000
#: Fixed value: (table, column) pairs whose inline values a backfill moves.
BACKFILL = (("block", "meta"), ("block", "blockdata"), ("container", "metadata"), ("item", "data"), ("entity", "data"))


def hashed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """With hash (SHA-256) and size in bytes; null payloads have neither."""
    return df.withColumn("hash", F.sha2(F.col(raw).cast("binary"), 256)).withColumn("size", F.octet_length(F.col(raw)))


def deduplicated(df: DataFrame, raw: str = "raw", ref: str = "ref_id") -> DataFrame:
    """One row for each payload: hash, size, first reference, number of references. Payloads themselves aren't shuffled."""
    return hashed(df, raw).where(F.col(raw).isNotNull()).groupBy("hash", "size").agg(F.min(ref).alias("first_ref"), F.count(F.lit(1)).alias("refs"))


def new_payloads(incoming: DataFrame, stored: DataFrame, raw: str = "raw") -> DataFrame:
    """Incoming payloads that aren't stored: anti join on (hash, size), the bytes compared as the residual."""
    i, s = hashed(incoming, raw).where(F.col(raw).isNotNull()).alias("i"), stored.alias("s")
    same = (F.col("i.hash") == F.col("s.hash")) & (F.col("i.size") == F.col("s.size")) & (F.col(f"i.{raw}").cast("binary") == F.col("s.data"))
    return i.join(s, same, "left_anti").dropDuplicates(["hash", "size"])


RANGES = 128


def numbered(df: DataFrame, after: int | Column = 0, order: str = "first_ref", ranges: int = RANGES) -> DataFrame:
    """Dense ids after the largest used one, in the order of a column whose values are unique.

    Rows are numbered within ranges of the column and offset by the sizes of the ranges before, so only one row a range
    meets in a task. The ranges part at a sample of a fixed size, the values of least hash, so they are of like size
    whatever the values have in common. Ids don't depend on where they part, and a task that is run again gives the same.
    """
    sample = df.select(F.col(order).alias("v")).orderBy(F.xxhash64("v")).limit(ranges - 1)
    bounds = F.coalesce(sample.agg(F.collect_list("v").alias("b")).scalar(), F.array().cast(T.ArrayType(df.schema[order].dataType)))
    ranged = df.withColumn("_range", F.array_position(F.sort_array(F.array_append(bounds, F.col(order))), F.col(order)))
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_offset"))
    return local.join(offsets, "_range").withColumn("id", (F.col("_offset") + F.col("_k") + after).cast("long")).drop("_range", "_k", "_offset")


def policy(size: Column, compressed: Column, enabled: bool = True, least: int = LEAST_BYTES) -> Column:
    """Codec of a payload: raw when disabled, small, failed or not made smaller."""
    return F.when(F.lit(not enabled) | (size < least) | compressed.isNull() | (compressed >= size), RAW).otherwise(ZSTD)


@F.pandas_udf(T.BinaryType())
def _compress(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import zstandard

    c = zstandard.ZstdCompressor(level=LEVEL)
    for s in values:
        yield s.map(lambda v: None if v is None else c.compress(bytes(v)))


@F.pandas_udf(T.BinaryType())
def _decompress(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    for s in values:
        yield s.map(lambda v: None if v is None else d.decompress(bytes(v)))


def encoded(df: DataFrame, raw: str = "raw", enabled: bool = True, least: int = LEAST_BYTES) -> DataFrame:
    """With codec and data; only payloads of the least size go through the compressor."""
    r = F.col(raw).cast("binary")
    size = F.octet_length(r)
    big = df.withColumn("_z", _compress(F.when(F.lit(enabled) & (size >= least), r)))
    codec = policy(size, F.octet_length("_z"), enabled, least)
    return big.withColumn("codec", codec).withColumn("data", F.when(codec == ZSTD, F.col("_z")).otherwise(r)).drop("_z")


def decoded(df: DataFrame, data: str = "data", codec: str = "codec", size: str = "size") -> DataFrame:
    """raw of stored payloads; null where the size doesn't fit."""
    raw = F.when(F.col(codec) == ZSTD, _decompress(F.when(F.col(codec) == ZSTD, F.col(data)))).otherwise(F.col(data))
    return df.withColumn("raw", raw).withColumn("raw", F.when(F.octet_length("raw") == F.col(size), F.col("raw")))


def resolved(df: DataFrame, payloads: DataFrame, inline: str, ref: str, out: str = "value") -> DataFrame:
    """The payload that ref names, else the inline value; a missing payload falls back to it, too."""
    p = payloads.select(F.col("id").alias("_pid"), F.col("raw").alias("_raw"))
    return df.join(p, F.when(F.col(ref) > 0, F.col(ref)) == F.col("_pid"), "left").withColumn(out, F.coalesce(F.col("_raw").cast("string"), F.col(inline).cast("string"))).drop("_pid", "_raw")


def due_for_backfill(df: DataFrame, inline: str, ref: str) -> DataFrame:
    return df.where(F.col(inline).isNotNull() & (F.col(ref).isNull() | (F.col(ref) == 0)))


def backfill_counts(tables: list[tuple[str, DataFrame, str, str]], batch: int = BATCH) -> DataFrame:
    """Dry run: rows and batches that each (name, table, inline column, reference column) still has to move."""
    if not 1 <= batch <= 10_000:
        raise ValueError("batch must be 1 to 10000")
    out = None
    for name, df, inline, ref in tables:
        n = due_for_backfill(df, inline, ref).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("target"), "n", F.ceil(F.col("n") / batch).cast("long").alias("batches"))
        out = n if out is None else out.unionByName(n)
    return out


STORED = "id bigint, hash string, size int, codec int, data binary"


def store(incoming: DataFrame, stored: DataFrame | None, raw: str = "raw", enabled: bool = True) -> DataFrame:
    """The rows to append to the payload store (id, hash, size, codec, data): each new content once, numbered after the last.

    Contents are told apart by hash, size and, among those, their bytes. Ids follow the order of hashes."""
    i = hashed(incoming.select(F.col(raw).cast("binary").alias("raw")).where(F.col(raw).isNotNull())).dropDuplicates(["hash", "size"])
    last: Column | int = 0
    if stored is not None:
        known = stored.select("hash", "size")
        i = i.join(known, ["hash", "size"], "left_anti")
        last = F.coalesce(stored.agg(F.max("id")).scalar(), F.lit(0))
    new = numbered(encoded(i, "raw", enabled), last, "hash")
    return new.select("id", "hash", F.col("size").cast("int").alias("size"), F.col("codec").cast("int").alias("codec"), "data")


def backfill(df: DataFrame, stored: DataFrame | None, inline: str, ref: str, most: int = 0, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Moves inline values into the store: the rows with their references set and inline values emptied, and the whole store.

    ``most`` rows are moved at a time, those of the lowest ids (0: all). A run that is repeated, or goes on after one that
    broke off, finds only what is still inline and stores nothing twice."""
    due = due_for_backfill(df, inline, ref)
    if most:
        due = due.orderBy(id_col).limit(most)
    moving = due.select(id_col, F.col(inline).cast("binary").alias("raw"))
    new = store(moving, stored)
    whole = new if stored is None else stored.unionByName(new)
    refs = hashed(moving).join(whole.select(F.col("id").alias("_ref"), "hash", "size"), ["hash", "size"]).select(F.col(id_col).alias("_id"), "_ref")
    out = df.join(refs, df[id_col] == refs["_id"], "left")
    moved = F.col("_ref").isNotNull()
    return out.select(*[(F.coalesce("_ref", ref) if c == ref else F.when(~moved, F.col(c)) if c == inline else F.col(c)).alias(c) for c in df.columns]), whole

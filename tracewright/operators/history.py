"""History of changing attributes by gaps and islands: every version with the period it was valid.

Rows are ordered per entity by (time, id). A row whose attribute differs from the row before opens a version; it is
valid until the next version opens, the last one is open. To keep an entity with a third of all rows out of a single
task, the order is worked off in (entity, time bucket) groups; one summary row for each group carries the last value
and the next change across groups, so what meets per entity is a row a bucket.

Cases: rows without entity, time or a non-blank value are left out; equal (time, id) rows are re-deliveries and open
nothing; ties in time are ordered by id; empty tables give an empty history; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.frames import bucket

DAY = 86_400


def canonical_uuid(c: Column) -> Column:
    """Lower case, dashes at 8-4-4-4-12; text that isn't 32 hex digits is only trimmed and put in lower case."""
    raw = F.lower(F.trim(c))
    hexes = F.regexp_replace(raw, "-", "")
    dashed = F.regexp_replace(hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(hexes.rlike("^[0-9a-f]{32}$"), dashed).otherwise(raw)


def canonical_name(c: Column) -> Column:
    """Without outer blanks of any kind, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def versions(df: DataFrame, entity: Column, value: Column, time: str = "time", id_col: str = "id", bucket_seconds: int = DAY) -> DataFrame:
    """entity, value, valid_from, valid_until (null: open) of every version."""
    rows = df.select(entity.alias("entity"), value.alias("value"), F.col(time).alias("t"), F.col(id_col).alias("i")).where(
        F.col("entity").isNotNull() & F.col("t").isNotNull() & (F.length("value") > 0)
    ).withColumn("b", bucket(F.col("t"), bucket_seconds)).where(F.col("b").isNotNull()).withColumn("h", F.xxhash64("value"))
    w = Window.partitionBy("entity", "b").orderBy("t", "i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = rows.select(
        "entity", "b", "value", "t", "i", "h",
        F.lag("h").over(w).alias("before"),
        F.lag("value").over(w).alias("value_before"),
        F.last("value").over(whole).alias("b_last"),
    )
    differs = (F.col("h") != F.col("before")) | (F.col("value") != F.col("value_before"))
    islands = marked.where(F.col("before").isNull() | differs).withColumn("inner", F.col("before").isNotNull()).drop("before", "value_before", "h")
    summary = islands.groupBy("entity", "b").agg(
        F.min(F.when(~F.col("inner"), F.struct("t", "value"))).alias("head"),
        F.min(F.when(F.col("inner"), F.col("t"))).alias("inner_start"),
        F.first("b_last").alias("b_last"),
    )
    per = Window.partitionBy("entity").orderBy("b")
    summary = summary.withColumn("opens", ~F.col("head.value").eqNullSafe(F.lag("b_last").over(per))).withColumn("start", F.when(F.col("opens"), F.col("head.t")).otherwise(F.col("inner_start")))
    summary = summary.select("entity", "b", "opens", F.last("start", ignorenulls=True).over(Window.partitionBy("entity").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("next_start"))
    opened = islands.join(summary, ["entity", "b"]).where(F.col("inner") | F.col("opens"))
    inside = Window.partitionBy("entity", "b").orderBy("t", "i")
    return opened.select("entity", "value", F.col("t").alias("valid_from"), F.coalesce(F.lead("t").over(inside), F.col("next_start")).alias("valid_until"))


def username_versions(log_username: DataFrame, bucket_seconds: int = DAY) -> DataFrame:
    """uuid, name, valid_from, valid_until of log_username."""
    v = versions(log_username, canonical_uuid(F.col("uuid")), canonical_name(F.col("name")), bucket_seconds=bucket_seconds)
    return v.select(F.col("entity").alias("uuid"), F.col("value").alias("name"), "valid_from", "valid_until")

"""Schema evolution as DataFrame steps, applied in the order of their versions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.asof import as_of
from tracewright.operators.names import assign_ids

Tables = dict[str, DataFrame]
Step = Callable[[Tables], Tables]
Version = tuple[int, int, int]


def with_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the missing columns (name -> (type, default))."""
    return df.select("*", *[F.lit(v).cast(t).alias(c) for c, (t, v) in defaults.items() if c not in df.columns])


def widened(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def without_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def to_dictionary(df: DataFrame, column: str, dictionary: DataFrame, out: str = "type") -> tuple[DataFrame, DataFrame]:
    """Replaces names by ids; returns the rows and the dictionary with the new names."""
    grown = dictionary.unionByName(assign_ids(df.select(F.col(column).alias("name")), dictionary))
    keys = grown.select(F.lower("name").alias("_k"), F.col("id").alias(out))
    return df.join(keys, F.lower(df[column]) == keys["_k"], "left").drop("_k", column), grown


def canonical_names(dictionary: DataFrame, namespace: str = "ns") -> DataFrame:
    """Lower case, with the default namespace where there is none."""
    low = F.lower("name")
    return dictionary.withColumn("name", F.when(F.instr(low, ":") > 0, low).otherwise(F.concat(F.lit(f"{namespace}:"), low)))


def without_types(df: DataFrame, dictionary: DataFrame, like: str, ground_only: bool = False) -> DataFrame:
    """Drops rows of the types whose name matches a LIKE pattern, ``ground_only``: at y = 0."""
    bad = dictionary.where(F.col("name").like(like)).select(F.col("id").alias("type"))
    if ground_only:
        return df.where(F.coalesce(F.col("y") != 0, F.lit(True))).unionByName(df.where(F.col("y") == 0).join(bad, "type", "left_anti").select(df.columns))
    return df.join(bad, "type", "left_anti").select(df.columns)


def inactive_users(users: DataFrame, logs: list[DataFrame]) -> DataFrame:
    """Users that no log mentions: one anti join against the union of their ids."""
    seen = reduce(DataFrame.unionByName, [d.select("user_id").where(F.col("user_id").isNotNull()) for d in logs]).distinct()
    return users.join(seen, users["id"] == seen["user_id"], "left_anti")


def rewritten_types(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Legacy types to new ones with block data: mapping(old_type, new_type, new_data)."""
    m = mapping.select("old_type", "new_type", "new_data")
    j = df.join(m, df["type"] == m["old_type"], "left")
    return j.withColumn("type", F.coalesce("new_type", "type")).withColumn("blockdata", F.coalesce("blockdata", "new_data")).select(df.columns)


def placed_signs(block: DataFrame, sign: DataFrame) -> DataFrame:
    """Ids of the sign rows that belong to a placing: of each placed block the first sign row at its place from then on."""
    keys = ["user_id", "wid", "x", "y", "z"]
    got = as_of(block.where(F.col("action") == 1).select("id", "time", *keys), sign.select("id", "time", *keys), keys, ["id"], forward=True)
    return got.where(F.col("base_id").isNotNull()).select(F.col("base_id").alias("id")).distinct()


def with_sign_actions(sign: DataFrame, placed: DataFrame) -> DataFrame:
    hit = placed.withColumn("_p", F.lit(1))
    return sign.join(hit, "id", "left").withColumn("action", F.when(F.col("_p") == 1, 1).otherwise(F.col("action"))).select(sign.columns)


def remapped_above(df: DataFrame, column: str, limit: DataFrame, values: dict[int, int]) -> DataFrame:
    """Changes values of rows whose id is over a scalar taken from another table (one row, one column)."""
    mapped = reduce(lambda c, kv: c.when(F.col(column) == kv[0], kv[1]), values.items(), F.when(F.lit(False), 0)).otherwise(F.col(column))
    return df.withColumn(column, F.when(F.col("id") > limit.scalar(), mapped).otherwise(F.col(column)))


def apply(tables: Tables, at: Version, steps: dict[Version, Step]) -> tuple[Tables, Version]:
    """Runs the steps newer than the store's version, oldest first."""
    for version in sorted(v for v in steps if v > at):
        tables, at = steps[version](tables), version
    return tables, at

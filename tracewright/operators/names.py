"""Dictionaries and the name log: ids for new names, user upserts, history appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.history import canonical_uuid
from tracewright.operators.payload import numbered


def missing_names(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Names without an id, each once, letter case aside (the smallest spelling is kept)."""
    n = names.where(F.length("name") > 0).groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("name"))
    return n.join(dictionary.select(F.lower("name").alias("k")).distinct(), "k", "left_anti").select("name")


def assign_ids(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """New dictionary rows: ids go on after the largest, in the order of the names."""
    last = F.coalesce(dictionary.agg(F.max("id")).scalar(), F.lit(0))
    return numbered(missing_names(names, dictionary), last, "name").select(F.col("id").cast("int").alias("id"), "name")


def updated_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Users whose name differs from the newest seen one of their uuid, as spelled, with the values to write; see upserted_users."""
    latest = seen.where(F.col("uuid").isNotNull() & (F.length("name") > 0)).groupBy("uuid").agg(F.max_by("name", F.struct("time", "id")).alias("new_name"))
    u = users.where(F.col("uuid").isNotNull())
    return u.join(latest, "uuid").where(F.col("name") != F.col("new_name")).select("id", "uuid", F.col("name").alias("old_name"), "new_name")


def _seen(seen: DataFrame) -> DataFrame:
    return seen.select(canonical_uuid(F.col("uuid")).alias("uuid"), "name", F.struct("time", "id").alias("at")).where((F.length("uuid") > 0) & (F.length("name") > 0))


def upserted_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Users whose uuid is unknown or whose name differs from the newest seen one, with the values to write.

    Uuids are compared, and written, in canonical form. A uuid that no user has belongs to the user without one who has
    the earliest of its seen names, letter case aside; of several such uuids of a user the newest seen counts, of several
    users with the name the smallest id.
    """
    s = _seen(seen)
    latest = s.groupBy("uuid").agg(F.max_by("name", "at").alias("new_name"), F.max("at").alias("last"))
    u = users.select("id", canonical_uuid(F.col("uuid")).alias("uuid"), "name")
    known = u.where(F.length("uuid") > 0)
    renamed = known.join(latest, "uuid").where(~F.col("name").eqNullSafe(F.col("new_name"))).select("id", "uuid", F.col("name").alias("old_name"), "new_name")
    free = u.where((F.coalesce(F.length("uuid"), F.lit(0)) == 0) & (F.length("name") > 0)).groupBy(F.lower("name").alias("k")).agg(F.min(F.struct("id", "name")).alias("u"))
    strange = s.join(known.select("uuid").distinct(), "uuid", "left_anti").withColumn("k", F.lower("name"))
    owner = strange.join(free, "k").groupBy("uuid").agg(F.min_by("u", "at").alias("u")).join(latest, "uuid")
    given = owner.groupBy("u").agg(F.max_by(F.struct("uuid", "new_name"), "last").alias("n"))
    return renamed.unionByName(given.select("u.id", "n.uuid", F.col("u.name").alias("old_name"), "n.new_name"))


def missing_history(log: DataFrame, seen: DataFrame) -> DataFrame:
    """As new_history, with uuids compared and written in canonical form."""
    return new_history(log.withColumn("uuid", canonical_uuid(F.col("uuid"))), seen.withColumn("uuid", canonical_uuid(F.col("uuid"))))


def new_history(log: DataFrame, seen: DataFrame) -> DataFrame:
    """Seen (uuid, name) pairs that the name log lacks, letter case of the name aside, uuids as spelled: the rows to append, first seen first."""
    s = seen.where(F.col("uuid").isNotNull() & (F.length("name") > 0)).groupBy("uuid", F.lower("name").alias("k")).agg(F.min(F.struct("time", "name")).alias("m"))
    known = log.select("uuid", F.lower("name").alias("k")).distinct()
    return s.join(known, ["uuid", "k"], "left_anti").select("uuid", "m.name", "m.time")


def user_lookup(users: DataFrame) -> DataFrame:
    """name in lower case -> id; of several users with a name the smallest id counts."""
    return users.where(F.length("name") > 0).groupBy(F.lower("name").alias("name_key")).agg(F.min("id").alias("id"))

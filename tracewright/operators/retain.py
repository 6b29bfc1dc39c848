"""Retention: what a purge keeps, what it removes, and payloads that nothing refers to any more."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.frames import once
from tracewright.plans.spec import PurgeSpec
from tracewright.sources.store import LogStore, append

# Tables that a purge reaches, in order, and those of them without a world column.
PURGED = ("sign", "container", "item", "skull", "session", "chat", "command", "entity", "block")
WORLDLESS = ("skull", "entity")


def families(spec: PurgeSpec) -> list[str]:
    """A type restriction reaches blocks only, a world restriction only tables with a world."""
    if spec.types:
        return ["block"]
    return [f for f in PURGED if spec.wid is None or f not in WORLDLESS]


def condition(spec: PurgeSpec) -> Column:
    """start <= time < end, in the world and of the types; rows without a time never match."""
    c = F.col("time") < spec.end
    if spec.start > 0:
        c = c & (F.col("time") >= spec.start)
    if spec.wid is not None:
        c = c & (F.col("wid") == spec.wid)
    if spec.types:
        c = c & F.col("type").isin(*spec.types)
    return F.coalesce(c, F.lit(False))


def kept(df: DataFrame, family: str, spec: PurgeSpec) -> DataFrame:
    return df.where(~condition(spec)) if family in families(spec) else df


def removed_counts(store: LogStore, spec: PurgeSpec) -> DataFrame:
    """Rows that would go, by table, each entry once; one pass over each table."""
    parts = [
        store.during(f, condition(spec), spec.start - 1, spec.end).select("id").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(f).alias("family"), "n")
        for f in families(spec)
        if f not in WORLDLESS or f in store.families
    ]
    return reduce(DataFrame.unionByName, parts)


def purge(store: LogStore, spec: PurgeSpec, folder: str) -> None:
    """Writes the complement of a purge to a new folder (sorted and compacted like any append)."""
    for f in families(spec):
        if f in store.families:
            append(kept(store[f], f, spec), folder, f)


def compact(df: DataFrame, folder: str, family: str) -> None:
    """Rewrites a family in the store's layout, each entry once, which merges small files and spares lookups the check for copies."""
    append(once(df), folder, family)


def orphans(payloads: DataFrame, references: list[tuple[DataFrame, str]], key: str = "id") -> DataFrame:
    """Payloads which no reference column names: one hash anti join against the union of all references."""
    used = reduce(DataFrame.unionByName, [d.where(F.col(c).isNotNull() & (F.col(c) != 0)).select(F.col(c).cast("long").alias("used")) for d, c in references]).distinct()
    return payloads.join(used, payloads[key] == used["used"], "left_anti")

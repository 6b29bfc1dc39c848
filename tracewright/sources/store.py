"""The log store: one DataFrame for each log family and dictionary, and appends to it."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.frames import once
from tracewright.schema import POSITIONAL, SCHEMAS
from tracewright.sources import fixtures


@dataclass
class LogStore:
    """Tables by family name. Every table has the columns of tracewright.schema and may hold re-delivered rows,
    but for the families in ``unique``, whose ids are known to be unique (compacted stores)."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    unique: frozenset[str] = frozenset()
    #: how a family's table is opened, on its first use
    sources: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def __getitem__(self, family: str) -> DataFrame:
        if family not in self.tables:
            self.tables[family] = self.sources[family]() if family in self.sources else self.spark.createDataFrame([], SCHEMAS[family])
        return self.tables[family]

    @property
    def families(self) -> list[str]:
        """The families that there are, opened or not."""
        return sorted({*self.tables, *self.sources})

    def during(self, family: str, keep: Column, start: int = 0, end: int = 0) -> DataFrame:
        """A family's rows under a condition that implies start < time <= end (0: open).

        Written stores are partitioned by day, which Spark can't derive from the time, so the days are named as well."""
        df = self[family]
        return df.where(keep & day_predicate(start, end)).drop("day") if "day" in df.columns else df.where(keep)

    def once(self, df: DataFrame, family: str) -> DataFrame:
        """Each entry of a family's rows once; costs a shuffle of these rows only where copies are possible."""
        return df if family in self.unique else once(df)

    @classmethod
    def given(cls, spark: SparkSession, sf_dir: str) -> LogStore:
        """The given tables, and derived ones for the families without."""
        store = cls(spark)
        for family, table in fixtures.GIVEN.items():
            store.sources[family] = lambda table=table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
        for family in ("item", "session", "sign"):
            store.sources[family] = lambda family=family: fixtures.view(spark, sf_dir, family)
        store.unique = frozenset({"item", "session", "sign"})
        return store

    @classmethod
    def sites(cls, spark: SparkSession, sf_dir: str) -> LogStore:
        """As given(), but with the derived block and container logs, whose locations have long histories."""
        store = cls.given(spark, sf_dir)
        for family in ("block", "container"):
            store.sources[family] = lambda family=family: fixtures.view(spark, sf_dir, f"site_{family}")
        store.unique |= {"block", "container"}
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str, compacted: bool = False) -> LogStore:
        """A store written by append(): families are folders, read with one schema each. ``compacted``: by compact() only.

        Positional families are partitioned by world and day, so that both the world and the time window of a lookup
        prune files (time is also kept, as Spark can't derive the day from it; see day_predicate).
        """
        store = cls(spark, unique=frozenset(SCHEMAS) if compacted else frozenset())
        for family, schema in SCHEMAS.items():
            path = os.path.join(folder, family)
            try:
                store.tables[family] = spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.DateType())]) if family in POSITIONAL else schema).parquet(path)
            except Exception as e:  # a family that was never written is empty
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return store


def day_of(time: Column) -> Column:
    return F.to_date(F.timestamp_seconds(time))


def day_predicate(start: int, end: int, day: str = "day") -> Column:
    """The partition filter that goes with a time window (start, end]; 0 means open."""
    keep = F.lit(True)
    if start > 0:
        keep = keep & (F.col(day) >= day_of(F.lit(start)))
    if end > 0:
        keep = keep & (F.col(day) <= day_of(F.lit(end)))
    return keep


def append(df: DataFrame, folder: str, family: str, rows_per_file: int = 5_000_000) -> None:
    """Appends rows of a family in the layout that lookups prune: partitioned by world and day, sorted by place and time."""
    columns = [f.name for f in SCHEMAS[family]]
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[family]])
    writer_columns: list[str] = []
    if family in POSITIONAL:
        out = out.withColumn("day", day_of(F.col("time")))
        # place spreads a hot world-day over tasks, the hour a hot place; files stay sorted for row-group statistics
        out = out.repartition("wid", "day", F.floor(F.col("x") / 512), F.floor(F.col("z") / 512), F.floor(F.col("time") / 3600)).sortWithinPartitions("wid", "day", "x", "z", "time")
        writer_columns = ["wid", "day"]
    else:
        out = out.select(*columns)
    w = out.write.mode("append").option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*writer_columns) if writer_columns else w).parquet(os.path.join(folder, family))


def validated(df: DataFrame, family: str) -> DataFrame:
    """Rows that may be logged through the API: chat must not start with a slash, commands must; others are dropped."""
    if family == "chat":
        return df.where(F.col("message").isNotNull() & ~F.col("message").startswith("/"))
    if family == "command":
        return df.where(F.coalesce(F.col("message").startswith("/"), F.lit(False)))
    return df.where(F.col("user_id").isNotNull() & F.col("wid").isNotNull())


@dataclass(frozen=True)
class Blacklist:
    """Source filter: users, objects and object@user pairs which are never logged."""

    users: tuple[str, ...] = ()
    objects: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()

    @classmethod
    def parse(cls, text: str) -> Blacklist:
        """One entry a line: blanks dropped, lower case, ; starts a comment, / marks a command and : an object id."""
        users, objects, pairs = [], [], []
        for line in text.splitlines():
            e = "".join(line.split(";", 1)[0].split()).lower()
            if not e:
                continue
            if "@" in e:
                o, u = e.split("@", 1)
                pairs.append((o, u))
            elif ":" in e or e.startswith("/"):
                objects.append(e)
            else:
                users.append(e)
        return cls(tuple(users), tuple(objects), tuple(pairs))

    def keep(self, df: DataFrame, user: str = "user", obj: str | None = None) -> DataFrame:
        """Rows that no entry excludes; the lists come from a settings file, so they are literals of the plan."""
        u = F.lower(F.coalesce(F.col(user), F.lit("")))
        if self.users:
            df = df.where(~u.isin(*self.users))
        if obj:
            o = F.lower(F.coalesce(F.col(obj), F.lit("")))
            if self.objects:
                df = df.where(~o.isin(*self.objects))
            for oo, uu in self.pairs:
                df = df.where(~((o == oo) & (u == uu)))
        return df


Hook = Callable[[DataFrame], DataFrame]


def ingest(df: DataFrame, folder: str, family: str, hooks: tuple[Hook, ...] = ()) -> None:
    """Validation, pre-log hooks (each may drop or rewrite rows), append."""
    out = validated(df, family)
    for hook in hooks:
        out = out.transform(hook)
    append(out, folder, family)


def version(spark: SparkSession, folder: str) -> tuple[int, int, int]:
    """The schema version which a store was last migrated to; (0, 0, 0) where none is noted."""
    try:
        row = spark.read.text(os.path.join(folder, "_version")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return (0, 0, 0)
    return tuple(int(p) for p in row.value.split("."))


def set_version(spark: SparkSession, folder: str, at: tuple[int, int, int]) -> None:
    spark.createDataFrame([(".".join(map(str, at)),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "_version"))

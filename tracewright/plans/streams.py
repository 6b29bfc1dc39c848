"""Streaming forms of ingest operators, run to the end of the given data; their SQL is that of the batch forms, but for that of
stream_suppress_unchanged, which knows no resets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans import changes
from tracewright.sources import fixtures
from tracewright.sources.fixtures import with_views
from tracewright.streaming import suppress
from tracewright.streaming.drain import LATE, drain, drain_closed


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    base, text = fixtures.VIEWS[name]
    schema = spark.read.parquet(f"{d}/{base}.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/{base}.parque[t]")  # a pattern, as the table may be one file
    return spark.sql(text.replace("EPOCH", fixtures._EPOCH["spark"]).replace("{{t}}", "{t}"), t=raw)


def stream_suppress_repeat(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d, "site_block").select("id", "time", "wid", "type")
    return drain(suppress.suppress_repeats(s, ["wid", "type"], 3, 900, expire=False)).select("id")


def stream_suppress_unchanged(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d, "site_block").where("action = 1").select("id", "time", "wid", "x", "y", "z", "type")
    return drain(suppress.changes_only(s, ["wid", "x", "y", "z"], ttl=90_000, expire=False)).select("id")


def stream_suppress_unchanged_reset(spark: SparkSession, d: str) -> DataFrame:
    """A break at the place resets the filter, as in suppress_unchanged; the SQL of stream_suppress_unchanged has placings only."""
    s = _stream(spark, d, "site_block").where("action IN (0, 1)").select("id", "time", "wid", "x", "y", "z", "type", "action")
    return drain(suppress.changes_only(s, ["wid", "x", "y", "z"], ttl=90_000, reset=("action", 0), expire=False)).select("id")


def stream_item_totals(spark: SparkSession, d: str) -> DataFrame:
    """Amounts over all bursts of the item log, those that are open at its end too."""
    bursts = drain_closed(_stream(spark, d, "item"), lambda s: suppress.item_bursts(s, "12 hours", LATE))
    return bursts.groupBy("action").agg(F.count(F.lit(1)).alias("bursts"), F.sum("amount").alias("amount"))


QUERIES = {f.__name__: f for f in (stream_suppress_repeat, stream_suppress_unchanged, stream_suppress_unchanged_reset, stream_item_totals)}
ORACLE = {
    "stream_item_totals": f"""{with_views('item')}, l AS (SELECT *, lag(time) OVER (PARTITION BY user_id, wid, x, y, z, action, type ORDER BY time, id) AS p FROM item_)
 SELECT action, CAST(sum(CASE WHEN p IS NULL OR time - p > 43200 THEN 1 ELSE 0 END) AS BIGINT) AS bursts, CAST(sum(amount) AS BIGINT) AS amount FROM l GROUP BY action""",
    "stream_suppress_repeat": changes.ORACLE["suppress_repeat"],
    "stream_suppress_unchanged_reset": changes.ORACLE["suppress_unchanged"],
    "stream_suppress_unchanged": f"""{with_views('site_block')}, l AS (SELECT *, lag(type) OVER w AS lt, lag(time) OVER w AS lm FROM site_block_ WHERE action = 1 WINDOW w AS (PARTITION BY wid, x, y, z ORDER BY time, id))
 SELECT id FROM l WHERE NOT coalesce(lt = type AND time - lm <= 90000, false)""",
}

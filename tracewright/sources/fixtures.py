"""Derived logs for the families which have no given table, as one SQL text for Spark and DuckDB.

item, session and sign logs, and a block and a container log with many rows a location ("site_"), made from the given
tables. {t} are table references; epoch() differs between the engines and is filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

START = 1_646_611_200  # 2022-03-07 00:00 UTC
SPAN = 14 * 86_400
NOW = START + SPAN

_EPOCH = {"spark": "unix_seconds(CAST(ts AS TIMESTAMP))", "duckdb": "CAST(epoch_us(ts) // 1000000 AS BIGINT)"}
_TS = f"CAST({START} + (EPOCH - 1704067200) % {SPAN} AS BIGINT) AS time"


def _at(x: str) -> str:
    return f"CAST({START} + {x} % {SPAN} AS BIGINT) AS time"


_LINES = ", ".join(
    f"CASE WHEN doc_id % 9 = {k} OR doc_id % 11 = 0 THEN NULL ELSE substr(text, {15 * k - 14}, 15) END AS line_{k}" for k in range(1, 9)
)
VIEWS: dict[str, tuple[str, str]] = {
    "item": ("orders", f"""SELECT CAST(o_orderkey + 1 AS BIGINT) AS id, {_at("o_orderkey * 3571")}, CAST(o_custkey % 150 + 1 AS INT) AS user_id,
 CAST(o_orderkey % 3 + 1 AS INT) AS wid, CAST(o_custkey % 17 - 8 AS INT) AS x, CAST(60 + o_custkey % 2 AS INT) AS y, CAST(o_orderkey % 13 - 6 AS INT) AS z,
 CAST(o_custkey % 11 + 1 AS INT) AS type, CAST(o_custkey % 64 + 1 AS INT) AS amount, CAST(o_orderkey * 5 % 13 AS INT) AS action,
 CAST((o_orderkey % 5) % 4 AS INT) AS rolled_back, CASE WHEN o_custkey % 4 = 0 THEN concat('m', o_custkey % 3) ELSE NULL END AS metadata FROM {{t}}"""),
    "session": ("events", f"""SELECT CAST(event_id + 1 AS BIGINT) AS id, {_TS}, CAST(user_id + 1 AS INT) AS user_id, CAST(user_id % 3 + 1 AS INT) AS wid,
 CAST(event_id * 7919 % 17 - 8 AS INT) AS x, CAST(60 AS INT) AS y, CAST(event_id * 104729 % 13 - 6 AS INT) AS z,
 CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS INT) AS action FROM {{t}} WHERE event_type IN ('signup', 'view')"""),
    "sign": ("documents", f"""SELECT CAST(doc_id + 1 AS BIGINT) AS id, {_at("doc_id * 911")}, CAST(doc_id % 150 + 1 AS INT) AS user_id, CAST(doc_id % 3 + 1 AS INT) AS wid,
 CAST(doc_id % 5 - 2 AS INT) AS x, CAST(60 AS INT) AS y, CAST(doc_id % 3 - 1 AS INT) AS z, CAST(doc_id % 7 % 3 AS INT) AS action, CAST(doc_id % 4 AS INT) AS data,
 CAST(doc_id % 2 AS INT) AS face, {_LINES} FROM {{t}}"""),
    "site_block": ("events", f"""SELECT CAST(event_id + 1 AS BIGINT) AS id, {_TS}, CAST(user_id + 1 AS INT) AS user_id,
 CAST(user_id % 3 + 1 AS INT) AS wid, CAST(event_id * 7919 % 17 - 8 AS INT) AS x, CAST(60 + event_id % 2 AS INT) AS y,
 CAST(event_id * 104729 % 13 - 6 AS INT) AS z,
 CAST(CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 2 WHEN 'error' THEN 3 ELSE 1 END AS INT) AS action,
 CAST(CASE WHEN event_type = 'error' THEN event_id % 7 ELSE event_id % 11 + 1 END AS INT) AS type,
 CAST(CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN event_id % 150 + 1 ELSE 0 END AS INT) AS data,
 CAST((event_id * 31 % 7) % 4 AS INT) AS rolled_back,
 CASE WHEN event_id % 3 = 0 THEN concat(event_id % 5 + 1, ',', event_id % 4 + 6) ELSE NULL END AS blockdata,
 CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 97 + 1 AS BIGINT) ELSE NULL END AS meta_payload_id FROM {{t}}"""),
    "site_container": ("lineitem", f"""SELECT CAST(rn AS BIGINT) AS id, {_at("CAST(rn AS BIGINT) % 1000003 * 7777")}, CAST(l_suppkey % 150 + 1 AS INT) AS user_id,
 CAST(l_linenumber % 3 + 1 AS INT) AS wid, CAST(l_partkey % 17 - 8 AS INT) AS x, CAST(60 + l_linenumber % 2 AS INT) AS y, CAST(l_suppkey % 13 - 6 AS INT) AS z,
 CAST(l_partkey % 11 + 1 AS INT) AS type, CAST(0 AS INT) AS data, CAST(floor(l_quantity) AS INT) AS amount,
 CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INT) AS action,
 CAST(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS INT) AS rolled_back,
 CASE WHEN l_partkey % 5 = 0 THEN concat('m', l_partkey % 3) ELSE NULL END AS metadata
 FROM (SELECT *, (CAST(l_orderkey * 8 + l_linenumber AS BIGINT) * 10000000 + l_partkey * 100 + l_suppkey % 100) * 64 + CAST(floor(l_quantity) AS BIGINT) AS rn FROM {{t}}) q"""),
    "payload_source": ("documents", "SELECT CAST(doc_id + 1 AS BIGINT) AS ref_id, text AS raw, CAST(length(text) AS INT) AS n FROM {t}"),
}
#: Families with a given table; re-delivered rows are dropped here in SQL.
GIVEN = {"block": "log_block", "container": "log_container", "chat": "log_chat", "command": "log_command", "username": "log_username", "user": "dim_user", "material": "dim_material", "world": "dim_world"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, text = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    return spark.sql(text.replace("EPOCH", _EPOCH["spark"]).replace("{{t}}", "{t}"), t=df)


def with_views(*names: str) -> str:
    """WITH clause that defines the named families for DuckDB."""
    parts = []
    for n in names:
        if n in GIVEN:
            parts.append(f"{n}_ AS (SELECT DISTINCT * FROM {GIVEN[n]})")
        else:
            base, text = VIEWS[n]
            parts.append(f"{n}_ AS ({text.replace('EPOCH', _EPOCH['duckdb']).replace('{{t}}', base).replace('{t}', base)})")
    return "WITH " + ",\n ".join(parts)

"""Queries of the general problems (4 to 7) over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.frames import once
from tracewright.operators import features, history, sessions, skew

PURGE_BEFORE = 1_647_216_000  # 2022-03-14: a fixed clock for the purge of p5_after_purge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(_shares(spark, d))


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_shares(table(spark, d, "log_block"), {"user_id": table(spark, d, "dim_user"), "wid": table(spark, d, "dim_world")})


def p4_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).select("key_field", "key_value", "n", "known", "total")


def p4_user_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For each user: joined rows of log_block and log_container, and the container amount over these rows."""
    blocks = once(table(spark, d, "log_block").select("id", "user_id"))
    moves = once(table(spark, d, "log_container").select("id", "user_id", "amount"))
    j = skew.eager_join(blocks, moves, "user_id", "user_id", right_sums=["amount"])
    return j.select(F.col("key_value").alias("user_id"), F.col("left_n").alias("n_block"), F.col("right_n").alias("n_container"), "pairs", "joined_sum_amount")


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    return features.entity_table(features.maintained(table(spark, d, "log_block"), PURGE_BEFORE))


def p5_feature_text(spark: SparkSession, d: str) -> DataFrame:
    """p5_features with the features of a user as text, one after the other."""
    one = F.transform("features", lambda f: F.concat_ws(":", *[F.coalesce(f[c].cast("string"), F.lit("-")) for c in ("action", "type", "n", "last_time", "n_rolled")]))
    return p5_features(spark, d).select("user_id", "n", "n_rolled", "last_time", "n_features", F.array_join(F.array_sort(one), ",").alias("features"))


def p5_feature_rows(spark: SparkSession, d: str) -> DataFrame:
    return features.state_of(table(spark, d, "log_block")).withColumnRenamed("entity", "user_id")


def p5_after_purge(spark: SparkSession, d: str) -> DataFrame:
    """The feature rows after a purge, reached by retracting the purged entries from the kept state."""
    log = once(table(spark, d, "log_block").select("id", "user_id", "action", "type", "time", "rolled_back"))
    gone = F.coalesce(F.col("time") < PURGE_BEFORE, F.lit(False))
    state = features.state_of(log)
    retract = features.events_of(log.where(gone)).withColumn("sign", F.lit(-1).cast("long"))
    return features.apply_deltas(state, retract, features.events_of(log.where(~gone))).withColumnRenamed("entity", "user_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return history.username_versions(table(spark, d, "log_username")).select("uuid", "name", "valid_from").distinct()


def p6_versions(spark: SparkSession, d: str) -> DataFrame:
    return history.username_versions(table(spark, d, "log_username"))


def _user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions([table(spark, d, "log_block"), table(spark, d, "log_container")])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _user_sessions(spark, d).select("user_id", "session_start", "session_end")


def p7_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _user_sessions(spark, d)


QUERIES = {f.__name__: f for f in (p4_found, p4_key_totals, p4_user_pairs, p5_features, p5_feature_text, p5_feature_rows, p5_after_purge, p6_found, p6_versions, p7_found, p7_sessions)}

_ONCE = "SELECT DISTINCT * FROM log_block"
_KEYS = f"""WITH e AS (SELECT DISTINCT id, user_id, wid FROM log_block), t AS (SELECT count(*) AS total FROM e),
 k AS (SELECT 'user_id' AS key_field, user_id AS key_value, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'wid', wid, count(*) FROM e GROUP BY 2),
 dims AS (SELECT 'user_id' AS key_field, id AS key_value, count(*) AS known FROM dim_user GROUP BY 2 UNION ALL SELECT 'wid', id, count(*) FROM dim_world GROUP BY 2)"""
_VERSIONS = r"""WITH r AS (SELECT DISTINCT id, time, lower(trim(uuid)) AS u0, lower(regexp_replace(name, '^\s+|\s+$', '', 'g')) AS name FROM log_username),
 c AS (SELECT *, CASE WHEN regexp_full_match(replace(u0, '-', ''), '[0-9a-f]{32}') THEN regexp_replace(replace(u0, '-', ''), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') ELSE u0 END AS uuid FROM r),
 l AS (SELECT *, lag(name) OVER (PARTITION BY uuid ORDER BY time, id) AS before FROM c WHERE uuid IS NOT NULL AND time IS NOT NULL AND length(name) > 0),
 v AS (SELECT uuid, name, time AS valid_from, lead(time) OVER (PARTITION BY uuid ORDER BY time, id) AS valid_until FROM l WHERE before IS NULL OR before <> name)"""
_FEATURES = """SELECT user_id, action, type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN rolled_back <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rolled, max(time) AS last_time
 FROM (SELECT DISTINCT id, user_id, action, type, time, rolled_back FROM log_block) e WHERE user_id IS NOT NULL"""
_SESSIONS = """WITH e AS (SELECT DISTINCT 0 AS s, id, user_id, time FROM log_block UNION ALL SELECT DISTINCT 1, id, user_id, time FROM log_container),
 g AS (SELECT *, CASE WHEN time - lag(time) OVER w <= 1800 THEN 0 ELSE 1 END AS fresh FROM e WHERE user_id IS NOT NULL AND time IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY time, s, id)),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY time, s, id) AS k FROM g)"""

ORACLE = {
    "p4_found": f"{_KEYS} SELECT key_field, key_value FROM k, t WHERE key_value IS NOT NULL AND CAST(n AS DOUBLE) / total >= 0.03",
    "p4_key_totals": f"{_KEYS} SELECT k.key_field, k.key_value, k.n, coalesce(d.known, 0) AS known, t.total FROM k CROSS JOIN t LEFT JOIN dims d ON d.key_field = k.key_field AND d.key_value = k.key_value",
    "p4_user_pairs": """SELECT b.user_id, b.n AS n_block, c.n AS n_container, b.n * c.n AS pairs, CAST(b.n * c.s AS BIGINT) AS joined_sum_amount
 FROM (SELECT user_id, count(DISTINCT id) AS n FROM log_block GROUP BY 1) b
 JOIN (SELECT user_id, count(*) AS n, sum(amount) AS s FROM (SELECT DISTINCT id, user_id, amount FROM log_container) q GROUP BY 1) c USING (user_id)""",
    "p5_feature_text": f"""SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_rolled) AS BIGINT) AS n_rolled, max(last_time) AS last_time, count(*) AS n_features,
 array_to_string(list_sort(list(concat_ws(':', coalesce(CAST(action AS VARCHAR), '-'), coalesce(CAST(type AS VARCHAR), '-'), CAST(n AS VARCHAR), coalesce(CAST(last_time AS VARCHAR), '-'), CAST(n_rolled AS VARCHAR)))), ',') AS features
 FROM ({_FEATURES} GROUP BY 1, 2, 3) q GROUP BY user_id""",
    "p5_feature_rows": f"{_FEATURES} GROUP BY 1, 2, 3",
    "p5_after_purge": f"{_FEATURES} AND (time IS NULL OR time >= {PURGE_BEFORE}) GROUP BY 1, 2, 3",
    "p6_found": f"{_VERSIONS} SELECT DISTINCT uuid, name, valid_from FROM v",
    "p6_versions": f"{_VERSIONS} SELECT uuid, name, valid_from, valid_until FROM v",
    "p7_found": f"{_SESSIONS} SELECT user_id, min(time) AS session_start, max(time) AS session_end FROM n GROUP BY user_id, k",
    "p7_sessions": f"{_SESSIONS} SELECT user_id, min(time) AS session_start, max(time) AS session_end, max(time) - min(time) AS duration, count(*) AS n FROM n GROUP BY user_id, k",
}

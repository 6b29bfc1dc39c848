"""Queries of as-of lookups, rollback, retention, payloads, ingest operators, dictionaries and migrations, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.frames import once
from tracewright.operators import asof, commands, lookup, migrate, names, payload, retain, revert, suppress
from tracewright.plans.spec import TAGS, Box, LookupSpec, PurgeSpec
from tracewright.sources import fixtures, listeners
from tracewright.sources.fixtures import NOW, with_views
from tracewright.sources.store import Blacklist, LogStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DAY = 86_400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _sites(spark: SparkSession, d: str) -> LogStore:
    return LogStore.sites(spark, d)


_S = with_views("site_block", "site_container", "item", "sign", "session")
_PLACE = "wid, x, y, z"
_SPEC = LookupSpec(start=NOW - 9 * DAY, wid=2, box=Box((-6, 6), (-5, 5)))
_SEL = f"sel AS (SELECT * FROM site_block_ WHERE time > {NOW - 9 * DAY} AND wid = 2 AND x BETWEEN -6 AND 6 AND z BETWEEN -5 AND 5 AND action <> 2)"
_CSEL = f"sel AS (SELECT * FROM site_container_ WHERE time > {NOW - 9 * DAY} AND wid = 2 AND x BETWEEN -6 AND 6 AND z BETWEEN -5 AND 5)"

# ---- as of, latest, attribution

_ASOF = "SELECT p.id, {agg}(s.id, s.id) AS sign_id, {agg}(s.line_1, s.id) AS line_1 FROM site_block_ p LEFT JOIN sign_ s ON s.wid = p.wid AND s.x = p.x AND s.y = p.y AND s.z = p.z AND s.time {op} p.time WHERE p.action = 2 GROUP BY p.id"


def _asof_sign(spark: SparkSession, d: str, forward: bool) -> DataFrame:
    s = _sites(spark, d)
    probes = s["block"].where("action = 2").select("id", "time", *asof.PLACE)
    signs = s["sign"].withColumn("line_1", F.coalesce("line_1", F.lit("")))
    got = asof.as_of(probes, signs, asof.PLACE, ["id", "line_1"], forward=forward)
    return got.select("id", F.col("base_id").alias("sign_id"), F.col("base_line_1").alias("line_1"))


@query(f"{_S} {_ASOF.format(agg='arg_max', op='<').replace('s.line_1', chr(99) + 'oalesce(s.line_1, ' + chr(39) * 2 + ')')}")
def asof_sign_before(spark, d):
    return _asof_sign(spark, d, False)


@query(f"{_S} {_ASOF.format(agg='arg_min', op='>=').replace('s.line_1', chr(99) + 'oalesce(s.line_1, ' + chr(39) * 2 + ')')}")
def asof_sign_after(spark, d):
    return _asof_sign(spark, d, True)


_PLACED = f"placed AS (SELECT {_PLACE}, max(id) AS id, arg_max(time, id) AS time, arg_max(user_id, id) AS user_id, arg_max(type, id) AS type FROM site_block_ WHERE action = 1 AND rolled_back IN (0, 2) GROUP BY {_PLACE})"


@query(f"{_S}, {_PLACED} SELECT * FROM placed")
def who_placed(spark, d):
    return asof.latest_placed(_sites(spark, d)["block"])


_RECENT = """recent AS (SELECT p.id, p.user_id, p.wid, p.x, p.y, p.z, arg_max(b.user_id, b.id) FILTER (WHERE b.rk = 1) AS last_id FROM {probes} p LEFT JOIN (
 SELECT p2.id AS pid, b2.id, b2.user_id, b2.time, p2.time AS pt, row_number() OVER (PARTITION BY p2.id ORDER BY b2.time DESC, b2.id DESC) AS rk FROM {probes} p2 JOIN site_block_ b2
 ON b2.wid = p2.wid AND b2.x = p2.x AND b2.y = p2.y AND b2.z = p2.z AND b2.action = {action} AND b2.time <= p2.time) b ON b.pid = p.id AND b.time >= b.pt - {ttl} GROUP BY ALL)"""


@query(f"{_S}, {_RECENT.format(probes='site_container_', action=0, ttl=20000)} SELECT id, last_id AS remover_id FROM recent")
def who_removed_ttl(spark, d):
    s = _sites(spark, d)
    return asof.last_actor(s["container"].select("id", "time", "user_id", *asof.PLACE), s["block"], 0, 20_000).select("id", F.col("base_user_id").alias("remover_id"))


@query(f"{_S}, {_PLACED}, c AS (SELECT * FROM site_container_ WHERE action = 0), {_RECENT.format(probes='c', action=1, ttl=20000)} SELECT r.id, coalesce(r.last_id, p.user_id, r.user_id) AS responsible_id FROM recent r LEFT JOIN placed p USING (wid, x, y, z)")
def attribution_fallback(spark, d):
    s = _sites(spark, d)
    probes = s["container"].where("action = 0").select("id", "time", "user_id", *asof.PLACE)
    return asof.attributed(probes, s["block"], 20_000).select("id", "responsible_id")


@query(f"{_S} SELECT a.id, b.id AS near_id FROM (SELECT * FROM site_block_ WHERE action = 3) a JOIN sign_ b ON a.wid = b.wid AND a.user_id = b.user_id AND a.action = 3 AND abs(a.x - b.x) <= 5 AND abs(a.z - b.z) <= 5 AND abs(a.y - b.y) <= 1")
def near_entities(spark, d):
    s = _sites(spark, d)
    return asof.near(s["block"].where("action = 3"), s["sign"], 5, 1, same=["wid", "user_id"]).select("id", "near_id")


@query(f"{_S} SELECT DISTINCT p.id FROM site_block_ p JOIN site_container_ o ON p.action = 1 AND p.wid = o.wid AND p.x = o.x AND p.y = o.y AND p.z = o.z AND p.type = o.type AND o.time BETWEEN p.time AND p.time + 3600")
def delayed_confirmation(spark, d):
    s = _sites(spark, d)
    return asof.confirmed(s["block"].where("action = 1"), s["container"], 3600).select("id")


# ---- rollback

_ITEM_FRAME = "SELECT 'block' AS family, id FROM sel WHERE action <> 2 UNION ALL SELECT 'container', id FROM csel"


def _families(spark: SparkSession, d: str, plan: revert.RevertPlan) -> DataFrame:
    s = _sites(spark, d)
    parts = [revert.selection(s, plan, f).select(F.lit(f).alias("family"), "id") for f in plan.families]
    return reduce(DataFrame.unionByName, parts)


@query(f"{_S}, {_SEL}, csel AS (SELECT * FROM site_container_ WHERE time > {NOW - 9 * DAY} AND wid = 2 AND x BETWEEN -6 AND 6 AND z BETWEEN -5 AND 5) {_ITEM_FRAME}")
def rollback_items_default(spark, d):
    """Without actions the contents of containers are rolled back as well."""
    return _families(spark, d, revert.RevertPlan(_SPEC))


@query(f"{_S}, {_SEL} SELECT 'block' AS family, id FROM sel")
def rollback_items_preview(spark, d):
    """A preview reads blocks alone."""
    return _families(spark, d, revert.RevertPlan(_SPEC, preview=True))


@query(f"""{_S.replace('WITH ', 'WITH types AS (SELECT id FROM dim_material WHERE regexp_matches(lower(name), ' + repr('(' + '|'.join(TAGS['#container']) + ')$') + ')), ', 1)}
 SELECT 'block' AS family, id FROM site_block_ WHERE time > {NOW - 9 * DAY} AND action = 1 AND type IN (SELECT id FROM types)
 UNION ALL SELECT 'container', id FROM site_container_ WHERE time > {NOW - 9 * DAY} AND action = 1""")
def rollback_items_container_placed(spark, d):
    """Placed containers take what was put in with them, of whatever type."""
    return _families(spark, d, revert.RevertPlan(LookupSpec((1,), start=NOW - 9 * DAY, include=("#container",))))


_SEL_BLOCK = f"{_S}, {_SEL}"


def _selected(spark: SparkSession, d: str, spec: LookupSpec = _SPEC, family: str = "block") -> DataFrame:
    return revert.selection(_sites(spark, d), revert.RevertPlan(spec), family)


def _target(pick: str, emptied: int) -> str:
    return f"{_SEL_BLOCK} SELECT {_PLACE}, CASE WHEN {pick}(action, id) = {emptied} THEN 0 ELSE {pick}(type, id) END AS target_type, CASE WHEN {pick}(action, id) <> {emptied} THEN {pick}(coalesce(blockdata, ''), id) END AS target_data FROM sel WHERE action IN (0, 1) GROUP BY {_PLACE}"


def _with_empty(df: DataFrame) -> DataFrame:
    return df.withColumn("blockdata", F.coalesce("blockdata", F.lit("")))


@query(_target("arg_min", 1))
def rollback_block_target(spark, d):
    return revert.block_targets(_with_empty(_selected(spark, d)))


@query(_target("arg_max", 0))
def restore_block_target(spark, d):
    return revert.block_targets(_with_empty(_selected(spark, d)), restore=True)


@query(f"{_SEL_BLOCK} SELECT id, {_PLACE}, type, 'spawn' AS change FROM sel WHERE action = 3 AND type <> 0")
def rollback_entities(spark, d):
    return revert.entity_changes(_selected(spark, d))


@query(f"{_SEL_BLOCK} SELECT id, xor(rolled_back, 1) AS rolled_back FROM sel WHERE rolled_back & 1 = 0")
def rollback_state_toggle_block(spark, d):
    return revert.toggled(_selected(spark, d)).select("id", "rolled_back")


@query(f"{_SEL_BLOCK} SELECT id, xor(rolled_back, 2) AS rolled_back FROM sel WHERE rolled_back & 2 <> 0")
def restore_state_toggle_inventory(spark, d):
    return revert.toggled(_selected(spark, d), restore=True, inventory=True).select("id", "rolled_back")


@query(f"{_SEL_BLOCK} SELECT b.id, CASE WHEN s.id IS NOT NULL AND b.rolled_back & 1 = 0 THEN xor(b.rolled_back, 1) ELSE b.rolled_back END AS rolled_back FROM site_block_ b LEFT JOIN sel s ON s.id = b.id")
def rollback_state_log(spark, d):
    """The present state of all rows: a rollback, its undo and the rollback again, as toggles of the state log."""
    base = once(_sites(spark, d)["block"])
    rows = _selected(spark, d)
    log = revert.state_changes(rows, "block", 1)
    again = log.unionByName(log.withColumn("seq", F.lit(2))).unionByName(log.withColumn("seq", F.lit(3)))
    return revert.current_state(base, again, "block").select("id", "rolled_back")


@query(f"{_S}, {_CSEL} SELECT {_PLACE}, type, coalesce(metadata, '') AS metadata, CAST(sum(CASE WHEN action = 1 THEN -amount ELSE amount END) AS BIGINT) AS net FROM sel WHERE action <= 1 AND rolled_back & 1 = 0 GROUP BY {_PLACE}, type, metadata HAVING net <> 0")
def rollback_container_net(spark, d):
    return revert.container_net(_selected(spark, d, family="container")).withColumn("metadata", F.coalesce("metadata", F.lit("")))


_INV = LookupSpec((4, 11), users=("quarrel_finch", "marlinofmellow7935"), start=NOW - 12 * DAY, unknown_users=True)
_INV_SQL = f"""{with_views('site_block', 'site_container', 'item', 'user')}, w AS (SELECT min(id) AS id FROM user_ WHERE lower(name) IN ('quarrel_finch', 'marlinofmellow7935') GROUP BY lower(name)),
 i AS (SELECT 0 AS tbl, id, user_id, type, 1 AS amount, action, rolled_back FROM site_block_ WHERE action = 1 AND user_id IN (SELECT id FROM w) AND time > {NOW - 12 * DAY} UNION ALL SELECT 1, id, user_id, type, amount, action, rolled_back FROM site_container_ WHERE user_id IN (SELECT id FROM w) AND time > {NOW - 12 * DAY}
 UNION ALL SELECT 2, id, user_id, type, amount, action, rolled_back FROM item_ WHERE user_id IN (SELECT id FROM w) AND time > {NOW - 12 * DAY})"""


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    s = _sites(spark, d)
    plan = revert.RevertPlan(_INV)
    parts = [lookup.unified(f, revert.selection(s, plan, f), True) for f in plan.families]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_GAIN = "CASE WHEN tbl > 0 AND action IN (0, 3, 4, 10, 12) THEN -1 ELSE 1 END"


@query(f"{_INV_SQL} SELECT user_id, type, CAST(sum(amount * {_GAIN}) AS BIGINT) AS net, CAST(sum(CASE WHEN tbl = 2 AND action IN (4, 5) THEN -amount * {_GAIN} ELSE 0 END) AS BIGINT) AS ender_net FROM i WHERE rolled_back & 2 = 0 GROUP BY 1, 2")
def rollback_inventory_net(spark, d):
    return revert.inventory_net(_inventory(spark, d))


@query(f"{_INV_SQL} SELECT tbl, id, xor(rolled_back, 2) AS rolled_back, CASE tbl WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS target FROM i WHERE rolled_back & 2 = 0")
def rollback_state_toggle_inventory(spark, d):
    return revert.toggled(revert.targets(_inventory(spark, d)), inventory=True).select("tbl", "id", "rolled_back", "target")


@query(f"{_SEL_BLOCK} SELECT wid, x >> 4 AS cx, z >> 4 AS cz, count(*) AS n, CAST(min(floor(sqrt(x * x + z * z))) AS BIGINT) AS dist FROM sel GROUP BY 1, 2, 3")
def rollback_chunks(spark, d):
    return revert.chunks(_selected(spark, d), 0, 0)


@query(f"{_SEL_BLOCK} SELECT CAST(sum(CASE WHEN rolled_back & 1 = 0 AND action IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) AS blocks, CAST(sum(CASE WHEN rolled_back & 1 = 0 AND action = 3 AND type <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS entities, count(DISTINCT (wid, x >> 4, z >> 4)) AS chunks, count(DISTINCT wid) AS worlds, count(DISTINCT user_id) AS users FROM sel")
def rollback_summary(spark, d):
    return revert.summary(_selected(spark, d))


@query(f"{_S}, {_CSEL} SELECT CAST(sum(amount) AS BIGINT) AS items FROM sel WHERE action <= 1 AND rolled_back & 1 = 0")
def rollback_items_moved(spark, d):
    return revert.items_moved(_selected(spark, d, family="container"))


@query(_target("arg_max", 0))
def rollback_undo(spark, d):
    plan = revert.RevertPlan(_SPEC).undo()
    s = _sites(spark, d)
    return revert.block_targets(_with_empty(revert.selection(s, plan)), plan.restore)


@query(_target("arg_min", 1))
def rollback_preview(spark, d):
    s = _sites(spark, d)
    s.tables["block"] = _with_empty(s["block"])
    out = revert.run(s, revert.RevertPlan(_SPEC, preview=True))
    assert "block_states" not in out
    return out["blocks"]


# ---- retention

_G = with_views("block", "container", "item", "session", "sign", "chat", "command")
_PURGE = PurgeSpec(NOW - 12 * DAY, NOW - 6 * DAY)
_GONE = f"time >= {NOW - 12 * DAY} AND time < {NOW - 6 * DAY}"


@query(f"{_G} SELECT id, time, user_id FROM block_ WHERE NOT coalesce({_GONE}, false)")
def purge_time(spark, d):
    return once(retain.kept(LogStore.given(spark, d)["block"], "block", _PURGE).select("id", "time", "user_id"))


@query(f"{_G} SELECT id, time, wid FROM chat_ WHERE NOT coalesce({_GONE} AND wid = 1, false)")
def purge_world(spark, d):
    return once(retain.kept(LogStore.given(spark, d)["chat"], "chat", PurgeSpec(_PURGE.start, _PURGE.end, 1)).select("id", "time", "wid"))


@query(f"{_G} SELECT id, type FROM block_ WHERE NOT coalesce(time < {NOW - 6 * DAY} AND type IN (3, 14, 15), false)")
def purge_type(spark, d):
    return once(retain.kept(LogStore.given(spark, d)["block"], "block", PurgeSpec(0, NOW - 6 * DAY, None, (3, 14, 15))).select("id", "type"))


@query(_G + " " + " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) AS n FROM {f}_ WHERE {_GONE}" for f in ("sign", "container", "item", "session", "chat", "command", "block")))
def purge_counts(spark, d):
    return retain.removed_counts(LogStore.given(spark, d), _PURGE)


# ---- payloads

_PAY = with_views("payload_source")


@query(f"{_PAY} SELECT sha256(raw) AS hash, strlen(raw) AS size, min(ref_id) AS first_ref, count(*) AS refs FROM payload_source_ WHERE raw IS NOT NULL GROUP BY 1, 2")
def payload_dedupe(spark, d):
    return payload.deduplicated(fixtures.view(spark, d, "payload_source"))


@query(f"{_PAY} SELECT row_number() OVER (ORDER BY min(ref_id)) + 100 AS id, sha256(raw) AS hash FROM payload_source_ WHERE raw IS NOT NULL GROUP BY raw")
def payload_ids(spark, d):
    return payload.numbered(payload.deduplicated(fixtures.view(spark, d, "payload_source")), 100).select("id", "hash")


@query(f"{_PAY}, {with_views('block', 'site_block')[5:]} SELECT ref_id AS id FROM payload_source_ p WHERE NOT EXISTS (SELECT 1 FROM block_ b WHERE b.meta_payload_id = p.ref_id) AND NOT EXISTS (SELECT 1 FROM site_block_ b WHERE b.meta_payload_id = p.ref_id)")
def payload_orphans(spark, d):
    stored = fixtures.view(spark, d, "payload_source").select(F.col("ref_id").alias("id"))
    return retain.orphans(stored, [(LogStore.given(spark, d)["block"], "meta_payload_id"), (_sites(spark, d)["block"], "meta_payload_id")])


@query(f"{with_views('site_block', 'payload_source')} SELECT b.id, coalesce(CASE WHEN b.meta_payload_id > 0 THEN p.raw END, b.blockdata) AS value FROM site_block_ b LEFT JOIN payload_source_ p ON p.ref_id = b.meta_payload_id")
def payload_resolve(spark, d):
    stored = fixtures.view(spark, d, "payload_source").withColumnRenamed("ref_id", "id")
    return payload.resolved(_sites(spark, d)["block"], stored, "blockdata", "meta_payload_id").select("id", "value")


@query(f"{with_views('site_block', 'site_container')} SELECT 'block' AS target, count(*) AS n, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS batches FROM site_block_ WHERE blockdata IS NOT NULL AND coalesce(meta_payload_id, 0) = 0 UNION ALL SELECT 'container', count(*), CAST(ceil(count(*) / 1000.0) AS BIGINT) FROM site_container_ WHERE metadata IS NOT NULL")
def payload_backfill_dry_run(spark, d):
    s = _sites(spark, d)
    return payload.backfill_counts([("block", s["block"], "blockdata", "meta_payload_id"), ("container", s["container"].withColumn("ref", F.lit(0)), "metadata", "ref")])


@query(f"{_PAY} SELECT ref_id, CASE WHEN strlen(raw) < 128 THEN 'raw' ELSE 'tried' END AS policy, strlen(raw) AS size FROM payload_source_ WHERE raw IS NOT NULL")
def payload_policy(spark, d):
    src = fixtures.view(spark, d, "payload_source").where("raw is not null").withColumn("size", F.octet_length("raw"))
    small = payload.policy(F.col("size"), F.col("size") - 1) == payload.RAW
    return src.select("ref_id", F.when(small, "raw").otherwise("tried").alias("policy"), "size")


@query(f"{_PAY} SELECT ref_id, raw FROM payload_source_ WHERE raw IS NOT NULL")
def payload_round_trip(spark, d):
    src = fixtures.view(spark, d, "payload_source").where("raw is not null").withColumn("size", F.octet_length("raw"))
    return payload.decoded(payload.encoded(src)).select("ref_id", F.col("raw").cast("string").alias("raw"))


# ---- ingest operators

_KEYS = "wid, x, z"


@query(f"""{_S}, g AS (SELECT *, CASE WHEN time - lag(time) OVER w <= 900 THEN 0 ELSE 1 END AS fresh FROM site_block_ WINDOW w AS (PARTITION BY wid, type ORDER BY time, id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY wid, type ORDER BY time, id) AS k FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY wid, type, k ORDER BY time, id) AS n FROM s) SELECT id FROM r WHERE n <= 3""")
def suppress_repeat(spark, d):
    return suppress.suppress_repeats(_sites(spark, d)["block"], ["wid", "type"], 3, 900).select("id")


@query(f"""{_S}, l AS (SELECT *, lag(type) OVER w AS lt, lag(time) OVER w AS lm, lag(action) OVER w AS la FROM site_block_ WHERE action IN (0, 1) WINDOW w AS (PARTITION BY {_PLACE} ORDER BY time, id))
 SELECT id FROM l WHERE action = 1 AND NOT coalesce(lt = type AND time - lm <= 90000 AND la = 1, false)""")
def suppress_unchanged(spark, d):
    b = _sites(spark, d)["block"]
    return suppress.changes_only(b.where("action = 1"), ttl=90_000, resets=b.where("action = 0")).select("id")


@query(f"""{_S}, p AS (SELECT *, id // 5 AS grp FROM site_block_ WHERE action = 1), l AS (SELECT *, coalesce(time - lag(time) OVER (PARTITION BY {_PLACE} ORDER BY time, id) > 90000, true) AS fresh FROM p)
 SELECT id FROM l WHERE grp IN (SELECT grp FROM l WHERE fresh)""")
def suppress_piston_group(spark, d):
    p = _sites(spark, d)["block"].where("action = 1").withColumn("grp", F.floor(F.col("id") / 5))
    return suppress.group_events(p, "grp", asof.PLACE, 90_000).select("id")


@query(f"""{_S}, g AS (SELECT *, CASE WHEN time - lag(time) OVER w <= 43200 THEN 0 ELSE 1 END AS fresh FROM item_ WINDOW w AS (PARTITION BY user_id, {_PLACE} ORDER BY time, id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, {_PLACE} ORDER BY time, id) AS burst FROM g)
 SELECT user_id, {_PLACE}, burst, action, type, coalesce(metadata, '') AS metadata, min(time) AS first_time, max(time) AS last_time, CAST(sum(amount) AS BIGINT) AS amount FROM s GROUP BY user_id, {_PLACE}, burst, action, type, metadata""")
def item_debounce_merge(spark, d):
    m = suppress.merge_item_transactions(_sites(spark, d)["item"], 43_200)
    return m.select("user_id", *asof.PLACE, F.col("burst"), "action", "type", F.coalesce("metadata", F.lit("")).alias("metadata"), "first_time", "last_time", "amount")


_SNAP = f"SELECT {_PLACE}, type, sum(amount) AS amount FROM site_container_ WHERE time {{op}} {NOW - 7 * DAY} GROUP BY {_PLACE}, type"


@query(f"""{_S}, b AS ({_SNAP.format(op='<')}), a AS ({_SNAP.format(op='>=')})
 SELECT {_PLACE}, type, CASE WHEN coalesce(a.amount, 0) > coalesce(b.amount, 0) THEN 1 ELSE 0 END AS action, CAST(abs(coalesce(a.amount, 0) - coalesce(b.amount, 0)) AS BIGINT) AS amount FROM a FULL JOIN b USING ({_PLACE}, type) WHERE coalesce(a.amount, 0) <> coalesce(b.amount, 0)""")
def snapshot_diff(spark, d):
    c = _sites(spark, d)["container"]
    return suppress.snapshot_diff(c.where(F.col("time") < NOW - 7 * DAY), c.where(F.col("time") >= NOW - 7 * DAY), asof.PLACE, ["type"])


@query(f"""{_S}, n AS (SELECT {_PLACE}, type, sum(CASE WHEN time >= {NOW - 7 * DAY} THEN amount WHEN time < {NOW - 7 * DAY} THEN -amount END) AS d FROM site_container_ GROUP BY {_PLACE}, type),
 m AS (SELECT {_PLACE}, type, sum(CASE WHEN action = 1 THEN amount ELSE -amount END) AS d FROM site_container_ WHERE user_id % 10 = 1 GROUP BY {_PLACE}, type), t AS (SELECT {_PLACE}, type, coalesce(n.d, 0) - coalesce(m.d, 0) AS d FROM n FULL JOIN m USING ({_PLACE}, type))
 SELECT {_PLACE}, type, CASE WHEN d > 0 THEN 1 ELSE 0 END AS action, CAST(abs(d) AS BIGINT) AS amount FROM t WHERE d <> 0""")
def snapshot_diff_hoppers(spark, d):
    c = _sites(spark, d)["container"]
    moved = c.where("user_id % 10 = 1").withColumn("amount", F.when(F.col("action") == 1, F.col("amount")).otherwise(-F.col("amount")))
    return suppress.snapshot_diff(c.where(F.col("time") < NOW - 7 * DAY), c.where(F.col("time") >= NOW - 7 * DAY), asof.PLACE, ["type"], moved)


@query(f"{_S}, t AS (SELECT {_PLACE}, type, sum(amount) AS a FROM site_container_ GROUP BY {_PLACE}, type) SELECT {_PLACE}, sha256(string_agg(lpad(CAST(type AS VARCHAR), 10, '0') || 'x' || a, ',' ORDER BY lpad(CAST(type AS VARCHAR), 10, '0') || 'x' || a)) AS signature FROM t GROUP BY {_PLACE}")
def container_signature(spark, d):
    return suppress.signature(_sites(spark, d)["container"], asof.PLACE)


@query(f"""{_S}, o AS (SELECT *, lag(type) OVER (PARTITION BY {_PLACE} ORDER BY id) AS old_type FROM site_block_ WHERE action = 1)
 SELECT id, 1 AS action, type FROM o UNION ALL SELECT id, 0, old_type FROM o WHERE coalesce(old_type, 0) <> 0""")
def place_replace_explode(spark, d):
    from pyspark.sql import Window

    b = _sites(spark, d)["block"].where("action = 1")
    over = b.withColumn("old_type", F.lag("type").over(Window.partitionBy(*asof.PLACE).orderBy("id")))
    return suppress.place_over(over).select("id", "action", "type")


@query(f"""{_S}, p AS (SELECT id, wid, x, z, time, CASE type % 4 WHEN 0 THEN 'ns:water' WHEN 1 THEN 'ns:lava' WHEN 2 THEN 'ns:vine' ELSE 'ns:slate' END AS material FROM site_block_ WHERE action = 1),
 c AS (SELECT wid, x >> 4 AS cx, z >> 4 AS cz, max(time) AS born FROM session_ GROUP BY ALL)
 SELECT p.id FROM p LEFT JOIN c ON c.wid = p.wid AND c.cx = p.x >> 4 AND c.cz = p.z >> 4 WHERE NOT coalesce(p.time >= born AND p.time - born <= CASE material WHEN 'ns:water' THEN 60 WHEN 'ns:lava' THEN 240 WHEN 'ns:vine' THEN 240 END, false)""")
def fresh_chunk_guard(spark, d):
    s = _sites(spark, d)
    m = F.when(F.col("type") % 4 == 0, "ns:water").when(F.col("type") % 4 == 1, "ns:lava").when(F.col("type") % 4 == 2, "ns:vine").otherwise("ns:slate")
    placed = s["block"].where("action = 1").withColumn("material", m)
    born = s["session"].select("wid", F.shiftright("x", 4).alias("cx"), F.shiftright("z", 4).alias("cz"), "time")
    return suppress.without_fresh_chunks(placed, born).select("id")


@query(f"""{with_views('block', 'user', 'material')} SELECT b.id FROM block_ b LEFT JOIN (SELECT id, lower(name) AS u FROM user_) u ON u.id = b.user_id LEFT JOIN (SELECT id, lower(name) AS m FROM material_) m ON m.id = b.type AND b.action <> 3
 WHERE coalesce(u, '') NOT IN ('#hearth', 'quarrel_finch') AND coalesce(m, '') NOT IN ('ns:mossy_basal') AND NOT (coalesce(u, '') = '#siphon' AND coalesce(m, '') = 'ns:mossy_clay')""")
def blacklist_filter(spark, d):
    s = LogStore.given(spark, d)
    b = Blacklist.parse("#hearth\nQuarrel_Finch ; a note\nns:mossy_basal\nns:mossy_clay@#siphon\n")
    rows = lookup.named(s, once(s["block"].select("id", "user_id", "type", "action", "blockdata")))
    return b.keep(rows, "user_name", "type_name").select("id")


_EVENTS = "CASE id % 5 WHEN 0 THEN 'block_break' WHEN 1 THEN 'block_piston' WHEN 2 THEN 'hopper_push' WHEN 3 THEN 'nonsense' ELSE 'quit' END"


@query(f"""{_S}, e AS (SELECT id % 5 AS k, time, 'u' || user_id AS actor, type AS n, type + 1 AS o FROM site_block_)
 SELECT 'block' AS family, time, actor, 0 AS action, o AS type FROM e WHERE k = 0 UNION ALL SELECT 'block', time, '#piston', 0, o FROM e WHERE k = 1 UNION ALL SELECT 'block', time, '#piston', 1, n FROM e WHERE k = 1
 UNION ALL SELECT 'container', time, '#hopper', 1, n FROM e WHERE k = 2 UNION ALL SELECT 'session', time, actor, 0, o FROM e WHERE k = 4""")
def listener_rows(spark, d):
    b = _sites(spark, d)["block"]
    e = b.select(F.expr(_EVENTS).alias("event"), "time", F.concat(F.lit("u"), "user_id").alias("user"), *asof.PLACE, (F.col("type") + 1).alias("old_type"), F.col("type").alias("new_type"))
    return listeners.to_rows(e).select("family", "time", "actor", "action", "type")


_CAUSE = "CASE id % 5 WHEN 0 THEN 'creeper' WHEN 1 THEN 'TNT' WHEN 2 THEN 'fireball' WHEN 3 THEN 'lava' ELSE NULL END"
_KIND = "CASE id % 3 WHEN 0 THEN 'entity_explode' WHEN 1 THEN 'block_from_to' ELSE 'entity_death' END"


@query(f"""{_S}, e AS (SELECT id, {_KIND} AS event, lower({_CAUSE}) AS cause, type FROM site_block_)
 SELECT id AS time, CASE event WHEN 'entity_explode' THEN CASE cause WHEN 'creeper' THEN '#creeper' WHEN 'tnt' THEN '#tnt' ELSE '#explosion' END
 WHEN 'block_from_to' THEN CASE cause WHEN 'lava' THEN '#lava' ELSE '#flow' END ELSE CASE WHEN cause = 'lava' THEN '#lava' WHEN cause IS NOT NULL THEN '#' || cause END END AS actor,
 CASE event WHEN 'entity_explode' THEN 0 WHEN 'block_from_to' THEN 1 ELSE 3 END AS action FROM e""")
def listener_causes(spark, d):
    """Actors by what exploded, flowed or killed."""
    b = _sites(spark, d)["block"]
    e = b.select(F.expr(_KIND).alias("event"), F.col("id").alias("time"), F.lit(None).cast("string").alias("user"), *asof.PLACE, F.expr(_CAUSE).alias("cause"), F.col("type").alias("old_type"), F.col("type").alias("new_type"))
    return listeners.to_rows(e).select("time", "actor", "action")


@query(f"{_S}, c AS (SELECT time, wid, x, y, z, type % 3 AS o, (type + 1) % 3 AS n FROM site_block_ WHERE action = 1) SELECT time, {_PLACE}, 0 AS action, o AS type FROM c WHERE o <> n AND o <> 0 UNION ALL SELECT time, {_PLACE}, 1, n FROM c WHERE o <> n AND n <> 0")
def bulk_edit_rows(spark, d):
    c = _sites(spark, d)["block"].where("action = 1").select("time", *asof.PLACE, F.lit("editor").alias("user"), (F.col("type") % 3).alias("old_type"), ((F.col("type") + 1) % 3).alias("new_type"))
    return listeners.bulk_edit_rows(c).select("time", *asof.PLACE, "action", "type")


# ---- dictionaries and migrations

_N = with_views("username", "user", "material", "world")


@query(f"{_N} SELECT min(uuid) AS uuid, arg_min(name, (time, name)) AS name, min(time) AS time FROM username_ n WHERE uuid IS NOT NULL AND length(name) > 0 AND time IS NOT NULL AND NOT EXISTS (SELECT 1 FROM user_ u WHERE u.uuid = n.uuid AND lower(u.name) = lower(n.name)) GROUP BY n.uuid, lower(n.name)")
def username_history_append(spark, d):
    s = LogStore.given(spark, d)
    return names.new_history(s["user"].where("uuid is not null"), s["username"].where("time is not null"))


@query(f"{_N}, l AS (SELECT uuid, arg_max(name, (time, id)) AS new_name FROM username_ WHERE uuid IS NOT NULL AND length(name) > 0 AND time IS NOT NULL GROUP BY uuid) SELECT u.id, u.uuid, u.name AS old_name, l.new_name FROM user_ u JOIN l USING (uuid) WHERE u.name <> l.new_name")
def username_upsert(spark, d):
    s = LogStore.given(spark, d)
    return names.updated_users(s["user"], s["username"].where("time is not null"))


@query()
def username_upsert_whole(spark, d):
    """Users without a uuid too, and uuids in any spelling, which the SQL of username_upsert leaves out."""
    s = LogStore.given(spark, d)
    return names.upserted_users(s["user"], s["username"].where("time is not null"))


@query()
def username_history_append_whole(spark, d):
    """Uuids in any spelling count as one, which the SQL of username_history_append holds apart."""
    s = LogStore.given(spark, d)
    return names.missing_history(s["user"].where("uuid is not null"), s["username"].where("time is not null"))


@query(f"{_N}, n AS (SELECT min(name) AS name FROM username_ WHERE length(name) > 0 AND lower(name) NOT IN (SELECT lower(name) FROM user_ WHERE name IS NOT NULL) GROUP BY lower(name)) SELECT CAST((SELECT max(id) FROM user_) + row_number() OVER (ORDER BY name) AS INT) AS id, name FROM n")
def dict_assign_ids(spark, d):
    s = LogStore.given(spark, d)
    return names.assign_ids(s["username"].select("name"), s["user"].select("id", "name"))


@query(f"{with_views('user', 'block', 'container', 'chat', 'command', 'session')} SELECT id FROM user_ u WHERE NOT EXISTS (SELECT 1 FROM block_ WHERE user_id = u.id) AND NOT EXISTS (SELECT 1 FROM container_ WHERE user_id = u.id) AND NOT EXISTS (SELECT 1 FROM chat_ WHERE user_id = u.id) AND NOT EXISTS (SELECT 1 FROM command_ WHERE user_id = u.id) AND NOT EXISTS (SELECT 1 FROM session_ WHERE user_id = u.id)")
def migrate_orphan_users(spark, d):
    s = LogStore.given(spark, d)
    return migrate.inactive_users(s["user"], [s[f] for f in ("block", "container", "chat", "command", "session")]).select("id")


@query("SELECT id FROM dim_user WHERE id NOT IN (SELECT user_id FROM log_command WHERE user_id IS NOT NULL)")
def migrate_users_without_commands(spark, d):
    s = LogStore.given(spark, d)
    return migrate.inactive_users(s["user"], [s["command"]]).select("id")


_FIRST = f"SELECT b.id, min(s.id) AS sid FROM site_block_ b JOIN sign_ s ON b.action = 1 AND s.user_id = b.user_id AND s.wid = b.wid AND s.x = b.x AND s.y = b.y AND s.z = b.z AND s.time >= b.time GROUP BY b.id"


@query(f"{_S}, f AS ({_FIRST}) SELECT s.id, CASE WHEN s.id IN (SELECT sid FROM f) THEN 1 ELSE s.action END AS action FROM sign_ s")
def migrate_sign_action(spark, d):
    s = _sites(spark, d)
    return migrate.with_sign_actions(s["sign"], migrate.placed_signs(s["block"], s["sign"])).select("id", "action")


@query(f"{_S} SELECT id, CASE type WHEN 3 THEN 30 WHEN 5 THEN 50 ELSE type END AS type, coalesce(blockdata, CASE type WHEN 3 THEN 'a' WHEN 5 THEN 'b' END) AS blockdata FROM site_block_")
def migrate_legacy_types(spark, d):
    m = spark.createDataFrame([(3, 30, "a"), (5, 50, "b")], "old_type int, new_type int, new_data string")
    return migrate.rewritten_types(_sites(spark, d)["block"], m).select("id", "type", "blockdata")


@query(f"{with_views('material', 'block')} SELECT id FROM block_ WHERE type NOT IN (SELECT id FROM material_ WHERE name LIKE '%_crate') OR type IS NULL")
def migrate_drop_types(spark, d):
    s = LogStore.given(spark, d)
    return migrate.without_types(once(s["block"].select("id", "type", "y")), s["material"], "%_crate").select("id")


@query(f"{_S} SELECT id, CASE WHEN id > (SELECT max(id) FROM session_) AND action = 0 THEN 2 ELSE action END AS action FROM site_block_")
def migrate_scalar_remap(spark, d):
    s = _sites(spark, d)
    return migrate.remapped_above(s["block"], "action", s["session"].agg(F.max("id")), {0: 2}).select("id", "action")


@query(f"{_S} SELECT id, CAST(time AS BIGINT) AS time, 0 AS color, 'none' AS note FROM sign_")
def migrate_add_columns(spark, d):
    steps = {
        (2, 21, 0): lambda t: {**t, "sign": migrate.with_columns(t["sign"], {"color": ("int", 0), "note": ("string", "none")})},
        (2, 5, 0): lambda t: {**t, "sign": migrate.widened(t["sign"], {"time": "bigint"})},
        (1, 0, 0): lambda t: {},
    }
    tables, _ = migrate.apply({"sign": _sites(spark, d)["sign"]}, (2, 0, 0), steps)
    return tables["sign"].select("id", "time", "color", "note")


# ---- commands

@query(f"""{with_views('site_block', 'site_container', 'item')}, u_ AS (SELECT 0 AS tbl, id, time, wid, x, z, action FROM site_block_ UNION ALL SELECT 1, id, time, wid, x, z, action FROM site_container_ UNION ALL SELECT 2, id, time, wid, x, z, action FROM item_ WHERE action NOT IN (8, 9, 10, 11, 12))
 SELECT tbl, id, time FROM u_ WHERE wid = 1 AND x BETWEEN -5 AND 5 AND z BETWEEN -5 AND 5 ORDER BY time DESC, tbl DESC, id DESC LIMIT 50""")
def lookup_near(spark, d):
    return lookup.page(_sites(spark, d), commands.near_spec((1, 0, 60, 0), 50)).select("tbl", "id", "time")


@query(f"{with_views('site_block', 'user')} SELECT t.id, t.time, u.name AS user_name, t.action FROM (SELECT * FROM site_block_ WHERE wid = 1 AND x = 0 AND y = 60 AND z = 0 AND action IN (0, 1) ORDER BY id DESC LIMIT 7) t LEFT JOIN user_ u ON u.id = t.user_id")
def inspect_block(spark, d):
    return commands.inspect(_sites(spark, d), "block", (1, 0, 60, 0)).select("id", "time", "user_name", "action")


_LIVE = ("block", "chat", "command", "container", "item", "session", "sign")


@query(with_views(*_LIVE, "username") + " " + " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) AS n, max(time) AS newest, CAST(0 AS BIGINT) AS pending, CAST(sum(CASE WHEN {'time < ' + str(NOW - 30 * DAY + 18 * DAY) if f != 'username' else 'false'} THEN 1 ELSE 0 END) AS BIGINT) AS purgeable FROM {f}_" for f in (*_LIVE, "username")))
def status_counts(spark, d):
    """Status with an automatic purge of 30 days, seen 18 days from now."""
    return commands.status(LogStore.given(spark, d), purge=commands.auto_purge("30d", NOW + 18 * DAY))


@query(f"{with_views('site_block', 'payload_source')} SELECT b.id, p.raw AS side_value FROM site_block_ b LEFT JOIN payload_source_ p ON b.type <> 0 AND p.ref_id = b.data WHERE b.action = 3")
def kill_side_table(spark, d):
    side = fixtures.view(spark, d, "payload_source").select(F.col("ref_id").alias("id"), F.col("raw").alias("data"))
    return asof.side_table(_sites(spark, d)["block"], side).select("id", "side_value")


@query(f"{with_views('chat')} SELECT id FROM chat_ WHERE message IS NOT NULL AND NOT starts_with(message, '/')")
def api_log_chat(spark, d):
    return once(commands.log_rows(LogStore.given(spark, d)["chat"].select("id", "user_id", "wid", "message"), "chat")).select("id")


@query(f"{with_views('block')} SELECT id, 1 AS action FROM block_ WHERE user_id IS NOT NULL AND wid IS NOT NULL")
def api_log_placement(spark, d):
    return once(commands.log_rows(LogStore.given(spark, d)["block"].select("id", "user_id", "wid", "action"), "block", 1)).select("id", "action")


@query(f"{_S} SELECT wid, x, y, z, type, CAST(sum(amount) AS BIGINT) AS amount FROM site_container_ GROUP BY ALL")
def item_stacks(spark, d):
    return suppress.stacked(_sites(spark, d)["container"], asof.PLACE, ["type"])


@query(f"{_SEL_BLOCK} SELECT id, type FROM sel WHERE action = 1 AND rolled_back & 1 = 0")
def rollback_placed(spark, d):
    """Rows that a rollback of placings would undo."""
    out = commands.rollback(_sites(spark, d), LookupSpec((1,), start=_SPEC.start, wid=_SPEC.wid, box=_SPEC.box))
    return out["block_states"].select("id", "type")


@query(f"""{_S}, r AS (SELECT *, least(type, data) AS lo, greatest(type, data) AS hi FROM site_block_ WHERE action = 1),
 g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY wid, x, y, z, lo, hi ORDER BY time, id) > 900 THEN 1 ELSE 0 END AS f FROM r),
 s AS (SELECT *, sum(f) OVER (PARTITION BY wid, x, y, z, lo, hi ORDER BY time, id) AS st FROM g),
 n AS (SELECT id, row_number() OVER (PARTITION BY wid, x, y, z, lo, hi, st ORDER BY time, id) AS n FROM s) SELECT id FROM n WHERE n <= 512""")
def suppress_flow(spark, d):
    """The instance of flow: a change and its way back count together."""
    b = _sites(spark, d)["block"].where("action = 1").withColumn("old_type", F.col("data"))
    return suppress.instance(b, "flow").select("id")


# ---- over the given logs, with re-delivered rows and nulls


def _given(spark: SparkSession, d: str, family: str) -> DataFrame:
    s = LogStore.given(spark, d)
    return s.once(s[family], family)


_G = with_views("block", "container")


@query(f"{_G}, o AS (SELECT *, row_number() OVER (PARTITION BY wid, x, y, z ORDER BY id) AS k FROM block_ WHERE action IN (0, 1)) SELECT wid, x, y, z, CASE WHEN action = 1 THEN 0 ELSE type END AS target_type FROM o WHERE k = 1")
def rollback_block_target_given(spark, d):
    return revert.block_targets(_given(spark, d, "block")).select(*asof.PLACE, "target_type")


@query(f"{_G} SELECT wid, x, y, z, type, metadata, CAST(sum(CASE WHEN action = 1 THEN -amount ELSE amount END) AS BIGINT) AS net FROM container_ WHERE action <= 1 AND coalesce(rolled_back, 0) & 1 = 0 GROUP BY ALL HAVING sum(CASE WHEN action = 1 THEN -amount ELSE amount END) <> 0")
def rollback_container_net_given(spark, d):
    return revert.container_net(_given(spark, d, "container"))


@query(f"{_G}, g AS (SELECT *, CASE WHEN time - lag(time) OVER w > 900 THEN 1 ELSE 0 END AS f FROM block_ WHERE time IS NOT NULL WINDOW w AS (PARTITION BY wid, type ORDER BY time, id)), s AS (SELECT *, sum(f) OVER (PARTITION BY wid, type ORDER BY time, id) AS st FROM g), n AS (SELECT id, row_number() OVER (PARTITION BY wid, type, st ORDER BY time, id) AS n FROM s) SELECT id FROM n WHERE n <= 3")
def suppress_repeat_given(spark, d):
    rows = _given(spark, d, "block").where("time IS NOT NULL").select("id", "time", "wid", "type")
    return suppress.suppress_repeats(rows, ["wid", "type"], 3, 900).select("id")


@query(f"{_G}, l AS (SELECT *, lag(type) OVER w AS lt, lag(time) OVER w AS lm FROM block_ WHERE action = 1 AND time IS NOT NULL WINDOW w AS (PARTITION BY wid, x, y, z ORDER BY time, id)) SELECT id FROM l WHERE NOT coalesce(lt = type AND time - lm <= 90000, false)")
def suppress_unchanged_given(spark, d):
    return suppress.changes_only(_given(spark, d, "block").where("action = 1 AND time IS NOT NULL"), ttl=90_000).select("id")


@query(f"{_G}, p AS (SELECT id, time, wid, x, y, z FROM block_ WHERE action = 0), b AS (SELECT * FROM block_ WHERE action = 1 AND time IS NOT NULL AND wid IS NOT NULL) SELECT p.id, (SELECT arg_max(b.user_id, (b.time, b.id)) FROM b WHERE b.wid = p.wid AND b.x = p.x AND b.y = p.y AND b.z = p.z AND b.time <= p.time AND b.user_id IS NOT NULL) AS user_id FROM p")
def last_placer_given(spark, d):
    """For each break of the given log the last known user who placed at its place up to then."""
    rows = _given(spark, d, "block").select("id", "time", "user_id", *asof.PLACE, "action")
    got = asof.as_of(rows.where("action = 0"), rows.where("action = 1 AND user_id IS NOT NULL"), asof.PLACE, ["user_id"], inclusive=True, by_time=True)
    return got.select("id", F.col("base_user_id").alias("user_id"))


# ---- payloads stored and moved

_RAW = "SELECT CAST(doc_id + 1 AS BIGINT) AS ref_id, text AS raw FROM documents WHERE text IS NOT NULL"


@query(f"WITH r AS ({_RAW}), u AS (SELECT DISTINCT raw FROM r) SELECT sha256(raw) AS hash, CAST(octet_length(encode(raw)) AS INT) AS size FROM u")
def payload_store(spark, d):
    """New payloads of all texts over a store that holds every second of them already: each is there once afterwards."""
    src = fixtures.view(spark, d, "payload_source").where("raw IS NOT NULL")
    old = payload.store(src.where("ref_id % 2 = 0"), None)
    new = payload.store(src, old)
    return old.unionByName(new).select("hash", "size")


@query(f"{with_views('block')} SELECT id, blockdata AS value FROM block_ WHERE blockdata IS NOT NULL")
def payload_backfill(spark, d):
    """Inline block data moved to payloads and resolved again."""
    rows = _given(spark, d, "block").withColumn("meta_payload_id", F.lit(None).cast("long"))
    moved, stored = payload.backfill(rows, None, "blockdata", "meta_payload_id")
    return payload.resolved(moved, payload.decoded(stored), "blockdata", "meta_payload_id").where("value IS NOT NULL").select("id", "value")

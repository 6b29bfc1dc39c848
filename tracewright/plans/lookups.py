"""Queries of the lookups, typed functions, point histories and decoders, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import codes, render
from tracewright.operators import lookup, typed
from tracewright.plans.spec import Box, LookupSpec, parse
from tracewright.sources.fixtures import NOW, with_views
from tracewright.sources.store import LogStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DAY = 86_400
WORLDS = [(1, "world_main"), (2, "world_mine"), (3, "world_sky")]
BOX = Box((-1500, 1500), (-3000, 3000))
BOX3 = Box((-2500, 2500), (-3000, 3000), (60, 70))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


BLOCK = ["id", "time", "user_id", "wid", "x", "y", "z", "action", "type", "data", "rolled_back"]
CONTAINER = ["id", "time", "user_id", "wid", "x", "y", "z", "type", "amount", "action", "rolled_back", "metadata"]
ITEM = ["id", "time", "user_id", "wid", "x", "y", "z", "type", "amount", "action", "rolled_back", "metadata"]
U = ", ".join(lookup.UNION)
_B = ", ".join(BLOCK)
_C = ", ".join(CONTAINER)
_I = ", ".join(ITEM)


def _rows(spark: SparkSession, d: str, spec: LookupSpec, cols: list[str]) -> DataFrame:
    """As in SQL, a user whom the tables don't know has no rows."""
    return lookup.rows(LogStore.given(spark, d), replace(spec, unknown_users=True)).select(*cols)


def _uid(name: str) -> str:
    return f"(SELECT min(id) FROM user_ WHERE lower(name) = lower('{name}'))"


def _mid(*names: str) -> str:
    return "(SELECT id FROM material_ WHERE lower(name) IN (" + ", ".join(f"'{n}'" for n in names) + "))"


_UNION = """u_ AS (SELECT 0 AS tbl, id, time, user_id, wid, x, y, z, type, blockdata AS metadata, data, -1 AS amount, action, rolled_back FROM block_
 UNION ALL SELECT 1, id, time, user_id, wid, x, y, z, type, metadata, data, amount, action, rolled_back FROM container_
 UNION ALL SELECT 2, id, time, user_id, wid, x, y, z, type, metadata, 0, amount, action, rolled_back FROM item_)"""
_V = with_views("block", "container", "item", "user", "material", "world")
_ALL = f"{_V},\n {_UNION}"
_NO_QUIET = "(tbl < 2 OR action NOT IN (8, 9, 10, 11, 12))"


@query(f"""{_V} SELECT p.{_B.replace(', ', ', p.')}, u.name AS user_name, w.name AS world, CASE WHEN p.action <> 3 THEN m.name END AS type_name FROM
 (SELECT {_B} FROM block_ WHERE user_id = {_uid("quarrel_finch")} AND time > {NOW - 10 * DAY} AND action IN (0, 1) ORDER BY id DESC LIMIT 7) p
 LEFT JOIN user_ u ON u.id = p.user_id LEFT JOIN world_ w ON w.id = p.wid LEFT JOIN material_ m ON m.id = p.type""")
def lookup_block_user_time(spark, d):
    store = LogStore.given(spark, d)
    spec = replace(parse("u:Quarrel_Finch t:10d a:block", NOW), unknown_users=True)
    return lookup.page(store, spec).select(*BLOCK, "user_name", "world", "type_name")


@query(f"{_V} SELECT {_B} FROM block_ WHERE wid = 1 AND x BETWEEN -1500 AND 1500 AND z BETWEEN -3000 AND 3000 AND action IN (0)")
def lookup_block_bbox(spark, d):
    return _rows(spark, d, LookupSpec((0,), wid=1, box=BOX), BLOCK)


@query(f"{_V} SELECT {_B} FROM block_ WHERE wid = 1 AND x BETWEEN -2500 AND 2500 AND z BETWEEN -3000 AND 3000 AND y BETWEEN 60 AND 70 AND action IN (1)")
def lookup_block_bbox_xyz(spark, d):
    return _rows(spark, d, LookupSpec((1,), wid=1, box=BOX3), BLOCK)


@query(f"{_V} SELECT {_B} FROM block_ WHERE wid = 2 AND time > {NOW - 12 * DAY} AND time <= {NOW - 5 * DAY} AND action IN (2)")
def lookup_click_world_range(spark, d):
    return _rows(spark, d, parse("r:#mine t:5d-12d a:click", NOW, worlds=WORLDS), BLOCK)


@query(f"{_V} SELECT {_B} FROM block_ WHERE time > {NOW - 14 * DAY} AND action IN (0, 1) AND type IN {_mid('ns:mossy_basal', 'ns:mossy_clay')}")
def lookup_include_types(spark, d):
    return _rows(spark, d, parse("i:mossy_basal,mossy_clay t:14d a:block", NOW), BLOCK)


@query(f"{_V} SELECT {_B} FROM block_ WHERE time > {NOW - 7 * DAY} AND action IN (1) AND type NOT IN {_mid('ns:mossy_basal', 'ns:smoky_basal')}")
def lookup_exclude_types(spark, d):
    types = frozenset({"ns:mossy_basal", "ns:smoky_basal"})
    return _rows(spark, d, parse("e:mossy_basal,smoky_basal t:7d a:+block", NOW, types=types), BLOCK)


@query(f"{_V} SELECT {_B} FROM block_ WHERE time > {NOW - 14 * DAY} AND action IN (0) AND type IN (SELECT id FROM material_ WHERE name LIKE '%\\_door' ESCAPE '\\' OR name LIKE '%\\_trapdoor' ESCAPE '\\' OR name LIKE '%\\_gate' ESCAPE '\\')")
def lookup_tag(spark, d):
    return _rows(spark, d, parse("i:#door t:14d a:-block", NOW), BLOCK)


@query(f"{_V} SELECT {_B} FROM block_ WHERE time > {NOW - 14 * DAY} AND action IN (3) AND type IN (5, 7)")
def lookup_include_entities(spark, d):
    return _rows(spark, d, parse("i:entity:5,entity:7 t:14d", NOW), BLOCK)


@query(f"{_V} SELECT {_B} FROM block_ WHERE time > {NOW - 3 * DAY} AND action IN (0, 1) AND user_id NOT IN (SELECT min(id) FROM user_ WHERE lower(name) IN ('#hearth', 'quarrel_finch', 'marlinofmellow7935') GROUP BY lower(name))")
def lookup_exclude_users(spark, d):
    return _rows(spark, d, parse("e:#hearth,quarrel_finch,MarlinOfMellow7935 t:3d a:block", NOW), BLOCK)


@query(f"{with_views('site_container')} SELECT {_C} FROM site_container_ WHERE wid = 1 AND x IN (-2, -1) AND z IN (2, 3) AND y = 61")
def lookup_double_container(spark, d):
    return lookup.rows(LogStore.sites(spark, d), LookupSpec((4, 5), wid=1, double_container=(-1.5, 61, 2.5))).select(*CONTAINER)


@query(f"{_V} SELECT {_C} FROM container_ WHERE time > {NOW - 10 * DAY} AND action IN (1)")
def lookup_container_add(spark, d):
    return _rows(spark, d, parse("a:+container t:10d", NOW), CONTAINER)


@query(f"{_V} SELECT {_C} FROM container_ WHERE time > {NOW - 10 * DAY} AND action IN (0) AND type NOT IN {_mid('ns:mossy_clay')}")
def lookup_container_remove(spark, d):
    return _rows(spark, d, parse("a:-container t:10d e:mossy_clay", NOW, types=frozenset({"ns:mossy_clay"})), CONTAINER)


@query(f"{with_views('chat', 'user')} SELECT id, time, user_id, wid, x, y, z, message FROM chat_ WHERE user_id = {_uid('quarrel_finch')} AND time > {NOW - 12 * DAY}")
def lookup_chat(spark, d):
    return _rows(spark, d, parse("u:Quarrel_Finch t:12d a:chat", NOW), ["id", "time", "user_id", "wid", "x", "y", "z", "message"])


@query(f"{with_views('command', 'user')} SELECT id, time, user_id, wid, x, y, z, message FROM command_ WHERE wid = 1 AND x BETWEEN -4000 AND 0 AND z BETWEEN -4000 AND 4000 AND time > {NOW - 12 * DAY}")
def lookup_command(spark, d):
    return _rows(spark, d, LookupSpec((7,), start=NOW - 12 * DAY, wid=1, box=Box((-4000, 0), (-4000, 4000))), ["id", "time", "user_id", "wid", "x", "y", "z", "message"])


_SESSION = ["id", "time", "user_id", "wid", "x", "y", "z", "action"]


@query(f"{with_views('session')} SELECT {', '.join(_SESSION)} FROM session_ WHERE action IN (1)")
def lookup_session_login(spark, d):
    return _rows(spark, d, parse("a:+session t:30d", NOW), _SESSION)


@query(f"{with_views('session')} SELECT {', '.join(_SESSION)} FROM session_ WHERE action IN (0) AND wid = 2 AND time > {NOW - 8 * DAY}")
def lookup_session_logout(spark, d):
    return _rows(spark, d, parse("a:logouts t:8d r:#world_mine", NOW, worlds=WORLDS), _SESSION)


@query(f"""{with_views('username', 'user')} SELECT id, time, uuid, name FROM username_ WHERE time > {NOW - 14 * DAY} AND uuid IN (SELECT uuid FROM user_ WHERE lower(name) IN ('quarrel_finch', 'ostler9') AND uuid IS NOT NULL)""")
def lookup_username(spark, d):
    return _rows(spark, d, parse("u:quarrel_finch,ostler9 t:14d a:username", NOW), ["id", "time", "uuid", "name"])


_LINES = [f"line_{k}" for k in range(1, 9)]
_WRITTEN = "(" + " OR ".join(f"coalesce(length({c}), 0) > 0" for c in _LINES) + ")"


def _shown(c: str) -> str:
    return f"CASE WHEN coalesce(length({c}), 0) = 0 THEN '' WHEN right({c}, 1) = ' ' THEN {c} ELSE concat({c}, ' ') END"


_MESSAGE = "CASE WHEN face = 0 THEN " + " || ".join(map(_shown, _LINES[:4])) + " ELSE " + " || ".join(map(_shown, _LINES[4:])) + " END"


@query(f"{with_views('sign')} SELECT id, time, user_id, wid, x, y, z, {_MESSAGE} AS message FROM sign_ WHERE action = 1 AND {_WRITTEN} AND time > {NOW - 10 * DAY}")
def lookup_sign(spark, d):
    rows = lookup.rows(LogStore.given(spark, d), parse("a:sign t:10d", NOW))
    return rows.select("id", "time", "user_id", "wid", "x", "y", "z", codes.sign_message(F.col("face"), [F.col(c) for c in _LINES]).alias("message"))


@query(f"{_V} SELECT {_I} FROM item_ WHERE action NOT IN (8, 9, 10, 11, 12) AND time > {NOW - 10 * DAY}")
def lookup_item(spark, d):
    return _rows(spark, d, parse("a:item t:10d", NOW), ITEM)


@query(f"{_V} SELECT {_I} FROM item_ WHERE action IN (3, 4) AND time > {NOW - 10 * DAY}")
def lookup_item_pickup(spark, d):
    return _rows(spark, d, parse("a:+item t:10d", NOW), ITEM)


@query(f"{_V} SELECT {_I} FROM item_ WHERE action IN (2, 5, 6, 7) AND time > {NOW - 10 * DAY}")
def lookup_item_drop(spark, d):
    return _rows(spark, d, parse("a:drop t:10d", NOW), ITEM)


@query(f"{_ALL} SELECT {U} FROM u_ WHERE time > {NOW - 2 * DAY} AND {_NO_QUIET}")
def lookup_default_union(spark, d):
    return _rows(spark, d, parse("t:2d", NOW), lookup.UNION)


@query(f"{_ALL} SELECT {U} FROM u_ WHERE time > {NOW - 4 * DAY} AND {_NO_QUIET} AND type IN {_mid('ns:mossy_basal', 'ns:mossy_clay', 'ns:polished_crate')} AND NOT (tbl = 0 AND action = 3)")
def lookup_union_include(spark, d):
    return _rows(spark, d, parse("t:4d i:mossy_basal,mossy_clay,polished_crate", NOW), lookup.UNION)


@query(f"{_ALL} SELECT tbl, count(*) AS n FROM u_ WHERE time > {NOW - 7 * DAY} AND {_NO_QUIET} GROUP BY tbl")
def lookup_default_count(spark, d):
    return lookup.counts(LogStore.given(spark, d), parse("t:7d #count", NOW))


@query(f"{_ALL} SELECT count(*) AS total, CAST(ceil(count(*) / 7.0) AS BIGINT) AS pages, 'ok' AS state FROM u_ WHERE time > {NOW - 7 * DAY} AND {_NO_QUIET}")
def lookup_page_state(spark, d):
    return lookup.pages(LogStore.given(spark, d), parse("t:7d page 2:7", NOW))


_PAGE2 = f"""SELECT * FROM u_ WHERE time > {NOW - 7 * DAY} AND {_NO_QUIET} ORDER BY time DESC, tbl DESC, id DESC LIMIT 20 OFFSET 20"""


@query(f"""{_ALL}, p AS ({_PAGE2}) SELECT p.*, u.name AS user_name, w.name AS world, CASE WHEN NOT (p.tbl = 0 AND p.action = 3) THEN m.name END AS type_name
 FROM p LEFT JOIN user_ u ON u.id = p.user_id LEFT JOIN world_ w ON w.id = p.wid LEFT JOIN material_ m ON m.id = p.type""")
def lookup_default_page2(spark, d):
    return lookup.page(LogStore.given(spark, d), parse("t:7d page 2:20", NOW))


_INV = f"(SELECT tbl, id, time, user_id, wid, x, y, z, type, metadata, data, CASE WHEN tbl = 0 THEN 1 ELSE amount END AS amount, action, rolled_back FROM u_ WHERE time > {NOW - 12 * DAY} AND user_id = {_uid('quarrel_finch')}) q"


@query(f"{_ALL} SELECT {U} FROM {_INV} WHERE tbl > 0 OR action = 1")
def lookup_inventory(spark, d):
    return _rows(spark, d, parse("u:quarrel_finch t:12d a:inventory", NOW), lookup.UNION)


@query(f"{_ALL} SELECT {U} FROM {_INV} WHERE tbl > 0 AND action IN (0, 3, 4, 10, 12)")
def lookup_inventory_plus(spark, d):
    return _rows(spark, d, parse("u:quarrel_finch t:12d a:+inventory", NOW), lookup.UNION)


@query(f"{_ALL} SELECT {U} FROM {_INV} WHERE (tbl = 0 AND action = 1) OR (tbl > 0 AND action IN (1, 2, 5, 6, 7, 8, 9, 11))")
def lookup_inventory_minus(spark, d):
    return _rows(spark, d, parse("u:quarrel_finch t:12d a:-inventory", NOW), lookup.UNION)


# ---- typed functions

def _named(cols: str, table: str, where: str, more: str = "") -> str:
    return f"{with_views('block', 'container', 'item', 'session', 'sign', 'chat', 'command', 'user')}{more} SELECT {cols} FROM {table} t LEFT JOIN user_ u ON u.id = t.user_id WHERE {where}"


_P = "t.id, t.time, u.name AS user_name, t.wid, t.x, t.y, t.z"
_BA = "CASE t.action WHEN 0 THEN 'break' WHEN 1 THEN 'place' WHEN 2 THEN 'click' WHEN 3 THEN 'kill' ELSE CASE WHEN t.action IS NOT NULL THEN 'unknown' END END AS action"
_CA = "CASE t.action WHEN 0 THEN 'remove' WHEN 1 THEN 'add' ELSE CASE WHEN t.action IS NOT NULL THEN 'unknown' END END AS action"
_IA = "CASE t.action " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in {0: "remove", 1: "add", 2: "drop", 3: "pickup", 4: "withdraw", 5: "deposit", 6: "throw", 7: "shoot", 8: "break", 9: "destroy", 10: "create", 11: "sell", 12: "buy"}.items()) + " END AS action"
_RB1, _RB2 = "coalesce(t.rolled_back & 1, 0) <> 0 AS rolled_back", "coalesce(t.rolled_back & 2, 0) <> 0 AS rolled_back"


def _opt(**k) -> typed.Options:
    return typed.Options(NOW, **k)


@query(_named(f"{_P}, {_BA}, t.type, t.data, {_RB1}", "block_", f"t.time > {NOW - 9 * DAY} AND t.wid = 1 AND t.x BETWEEN -2300 AND 1700 AND t.z BETWEEN -2000 AND 2000"))
def api_block(spark, d):
    return typed.block_lookup(LogStore.given(spark, d), _opt(seconds=9 * DAY, place=(1, -300, 64, 0), radius=2000))


@query(_named(f"{_P}, {_CA}, t.type, t.amount, t.metadata, {_RB1}", "container_", f"t.time > {NOW - 9 * DAY} AND t.user_id = {_uid('#hearth')}"))
def api_container(spark, d):
    return typed.container_lookup(LogStore.given(spark, d), _opt(seconds=9 * DAY, user="#Hearth"))


@query(_named(f"{_P}, {_IA}, t.type, t.amount, t.metadata, {_RB2}", "item_", f"t.time > {NOW - 9 * DAY} AND t.action NOT IN (8, 9, 10, 11, 12)"))
def api_item(spark, d):
    return typed.item_lookup(LogStore.given(spark, d), _opt(seconds=9 * DAY))


@query(f"""{_ALL} SELECT t.tbl, {_P}, CASE t.tbl WHEN 0 THEN 'block' WHEN 1 THEN 'container' ELSE 'item' END AS source,
 CASE WHEN t.action IS NULL THEN NULL WHEN t.tbl > 0 AND t.action IN (0, 3, 4, 10, 12) THEN 1 ELSE 0 END AS gained, t.type, CASE WHEN t.tbl = 0 THEN 1 ELSE t.amount END AS amount, {_RB2}
 FROM u_ t LEFT JOIN user_ u ON u.id = t.user_id WHERE t.user_id = {_uid('quarrel_finch')} AND t.time > {NOW - 9 * DAY} AND (t.tbl > 0 OR t.action = 1)""")
def api_inventory(spark, d):
    return typed.inventory_lookup(LogStore.given(spark, d), _opt(seconds=9 * DAY, user="Quarrel_Finch"))


@query(_named(f"{_P}, CASE t.action WHEN 0 THEN 'logout' WHEN 1 THEN 'login' END AS action", "session_", f"t.user_id = {_uid('quarrel_finch')}"))
def api_session(spark, d):
    return typed.session_lookup(LogStore.given(spark, d), _opt(user="QUARREL_FINCH"))


@query(_named(f"{_P}, t.message", "chat_", f"t.time > {NOW - 3 * DAY} AND t.user_id = {_uid('quarrel_finch')}"))
def api_chat(spark, d):
    return typed.message_lookup(LogStore.given(spark, d), "chat", _opt(seconds=3 * DAY, user="quarrel_finch"))


@query(f"""{with_views('command', 'user')} SELECT {_P}, t.message FROM (SELECT * FROM command_ WHERE time > {NOW - 9 * DAY} ORDER BY id DESC LIMIT 50 OFFSET 10) t LEFT JOIN user_ u ON u.id = t.user_id""")
def api_command(spark, d):
    return typed.message_lookup(LogStore.given(spark, d), "command", _opt(seconds=9 * DAY, limit=50, offset=10))


@query(_named(f"{_P}, 'place' AS action, {_MESSAGE} AS message, t.face = 0 AS front, t.data & 1 <> 0 AS front_glow, t.data & 2 <> 0 AS back_glow", "sign_", f"t.action = 1 AND {_WRITTEN} AND t.wid = 1 AND t.x BETWEEN -1 AND 1 AND t.z BETWEEN -1 AND 1"))
def api_sign(spark, d):
    return typed.sign_lookup(LogStore.given(spark, d), _opt(place=(1, 0, 60, 0), radius=1))


_UUIDS = """ids AS (SELECT lower(uuid) AS uuid FROM user_ WHERE lower(name) = 'ostler9' AND uuid IS NOT NULL UNION SELECT lower(uuid) FROM username_ WHERE lower(name) = 'ostler9' AND uuid IS NOT NULL)"""


@query(f"{with_views('username', 'user')}, {_UUIDS} SELECT id, time, lower(uuid) AS uuid, name FROM username_ WHERE lower(uuid) IN (SELECT uuid FROM ids) AND time > {NOW - 13 * DAY}")
def api_username(spark, d):
    return typed.username_lookup(LogStore.given(spark, d), _opt(seconds=13 * DAY, user="Ostler9"))


@query(f"{with_views('username', 'user')}, {_UUIDS} SELECT DISTINCT lower(uuid) AS uuid, lower(name) AS name FROM username_ WHERE lower(uuid) IN (SELECT uuid FROM ids) AND length(name) > 0")
def api_alias_closure(spark, d):
    return typed.alias_closure(LogStore.given(spark, d), "ostler9")


def _done(action: int, table: str = "block_") -> str:
    return f"{with_views('site_block', 'user')} SELECT count(*) > 0 AS found FROM site_block_ WHERE user_id = {_uid('quarrel_finch')} AND wid = 2 AND x = 1 AND y = 61 AND z = 2 AND action = {action} AND time > {NOW - 20 * DAY} AND time <= {NOW - 60}"


@query(_done(1))
def api_has_placed(spark, d):
    return typed.has_done(LogStore.sites(spark, d), "Quarrel_Finch", (2, 1, 61, 2), 1, NOW, 20 * DAY, 60)


@query(_done(0))
def api_has_removed(spark, d):
    return typed.has_done(LogStore.sites(spark, d), "Quarrel_Finch", (2, 1, 61, 2), 0, NOW, 20 * DAY, 60)


@query(f"{_ALL} SELECT {_B} FROM block_ WHERE time > {NOW - 6 * DAY} AND action IN (0, 1) AND user_id = {_uid('quarrel_finch')}")
def api_perform_lookup(spark, d):
    return typed.perform_lookup(LogStore.given(spark, d), NOW, 6 * DAY, users=("Quarrel_Finch",)).select(*BLOCK)


@query(f"{_ALL} SELECT {_B} FROM block_ WHERE time > {NOW - 6 * DAY} AND action IN (0, 1) AND user_id = {_uid('quarrel_finch')} ORDER BY id DESC LIMIT 20 OFFSET 10")
def api_perform_partial_lookup(spark, d):
    return typed.perform_partial_lookup(LogStore.given(spark, d), NOW, 6 * DAY, 10, 20, users=("Quarrel_Finch",)).select(*BLOCK)


@query(f"""{_ALL} SELECT t.id, t.time * 1000 AS timestamp, coalesce(u.name, '') AS player, t.x, t.y, t.z, t.type, t.data, t.action AS action_id, CASE t.action WHEN 0 THEN 'break' WHEN 1 THEN 'place' WHEN 2 THEN 'click' WHEN 3 THEN 'kill' ELSE 'unknown' END AS action,
 coalesce(t.rolled_back & 1, 0) <> 0 AS rolled_back, t.wid, t.amount, coalesce(t.metadata, '') AS metadata FROM u_ t LEFT JOIN user_ u ON u.id = t.user_id WHERE t.time > {NOW - 2 * DAY} AND (t.tbl < 2 OR t.action NOT IN (8, 9, 10, 11, 12))""")
def api_parse_result(spark, d):
    store = LogStore.given(spark, d)
    return typed.parse_result(typed.raw_rows(store, lookup.rows(store, parse("t:2d", NOW))))


@query(f"{with_views('site_block')} SELECT id, time, user_id, action, type FROM site_block_ WHERE wid = 2 AND x = 1 AND y = 61 AND z = 2 AND action IN (0, 1)")
def api_queue(spark, d):
    return typed.queue_lookup(LogStore.sites(spark, d)["block"], (2, 1, 61, 2)).select("id", "time", "user_id", "action", "type")


# ---- points

_AT = "wid = 2 AND x = 1 AND y = 61 AND z = 2"


@query(f"{with_views('site_block', 'user')} SELECT t.id, t.time, u.name AS user_name, t.action, t.type FROM (SELECT * FROM site_block_ WHERE {_AT} AND time >= {NOW - 13 * DAY} AND action IN (0, 1) ORDER BY id DESC LIMIT 7) t LEFT JOIN user_ u ON u.id = t.user_id")
def point_block_history(spark, d):
    return typed.point_history(LogStore.sites(spark, d), "block", (2, 1, 61, 2), NOW - 13 * DAY, actions=(0, 1)).select("id", "time", "user_name", "action", "type")


@query(f"{with_views('site_block')} SELECT count(*) AS n, CAST(ceil(count(*) / 7.0) AS BIGINT) AS pages FROM site_block_ WHERE {_AT} AND time >= {NOW - 13 * DAY} AND action IN (0, 1)")
def point_block_count(spark, d):
    return typed.point_count(LogStore.sites(spark, d), "block", (2, 1, 61, 2), NOW - 13 * DAY, actions=(0, 1))


@query(f"{with_views('site_block', 'user')} SELECT t.id, t.time, u.name AS user_name, t.type FROM (SELECT * FROM site_block_ WHERE {_AT.replace('y = 61', 'y = 60')} AND time >= {NOW - 14 * DAY} AND action IN (2) ORDER BY id DESC LIMIT 7) t LEFT JOIN user_ u ON u.id = t.user_id")
def point_interaction(spark, d):
    return typed.point_history(LogStore.sites(spark, d), "block", (2, 1, 60, 2), NOW - 14 * DAY, actions=(2,)).select("id", "time", "user_name", "type")


@query(f"{with_views('site_container', 'user')} SELECT t.id, t.time, u.name AS user_name, t.action, t.type, t.amount FROM (SELECT * FROM site_container_ WHERE wid = 2 AND x = 1 AND y = 61 AND z = 2 AND time >= {NOW - 14 * DAY} ORDER BY id DESC LIMIT 7 OFFSET 7) t LEFT JOIN user_ u ON u.id = t.user_id")
def point_container(spark, d):
    return typed.point_history(LogStore.sites(spark, d), "container", (2, 1, 61, 2), NOW - 14 * DAY, page=2).select("id", "time", "user_name", "action", "type", "amount")


@query(f"{with_views('sign', 'user')} SELECT t.id, t.time, u.name AS user_name, {_MESSAGE} AS message FROM (SELECT * FROM sign_ WHERE wid = 1 AND x = 0 AND y = 60 AND z = -1 AND time >= {NOW - 14 * DAY} AND action = 1 AND {_WRITTEN} ORDER BY id DESC LIMIT 7) t LEFT JOIN user_ u ON u.id = t.user_id")
def point_sign(spark, d):
    rows = typed.point_history(LogStore.given(spark, d), "sign", (1, 0, 60, -1), NOW - 14 * DAY)
    return rows.select("id", "time", "user_name", codes.sign_message(F.col("face"), [F.col(c) for c in _LINES]).alias("message"))


# ---- decoders and sinks

@query(f"""{_V} SELECT t.id, t.type, t.data, CASE WHEN t.type = 0 THEN u.name ELSE 'entity:' || t.type END AS victim FROM block_ t LEFT JOIN user_ u ON u.id = t.data WHERE t.action = 3""")
def decode_kill_targets(spark, d):
    store = LogStore.given(spark, d)
    return lookup.kill_targets(store, lookup.rows(store, LookupSpec((3,)))).select("id", "type", "data", "victim")


_AGE = f"greatest({NOW} - time, 0)"


@query(f"""{_V} SELECT id, CASE WHEN {_AGE} / 60.0 < 60 THEN printf('%.2f', CAST({_AGE} AS DOUBLE) / 60) || '/m ago' WHEN {_AGE} / 3600.0 < 24 THEN printf('%.2f', CAST({_AGE} AS DOUBLE) / 3600) || '/h ago' ELSE printf('%.2f', CAST({_AGE} AS DOUBLE) / 86400) || '/d ago' END AS age,
 strftime(to_timestamp(time), '%Y-%m-%d %H:%M:%S') AS stamp FROM container_ WHERE time IS NOT NULL""")
def time_since(spark, d):
    rows = lookup.rows(LogStore.given(spark, d), LookupSpec((4,))).where("time is not null")
    return rows.select("id", codes.time_since(F.col("time"), NOW).alias("age"), codes.stamp(F.col("time")).alias("stamp"))


_SIGN = "CASE WHEN tbl = 0 THEN CASE WHEN action = 1 THEN '+' WHEN action IN (0, 3) THEN '-' ELSE '' END WHEN tbl = 1 THEN CASE WHEN action = 1 THEN '+' ELSE '-' END ELSE CASE WHEN action IN (0, 3, 4, 10, 12) THEN '+' ELSE '-' END END"


@query(f"{_ALL} SELECT tbl, action, {_SIGN} AS sign, CASE WHEN tbl > 0 AND action IN (0, 3, 4, 10, 12) THEN 1 ELSE 0 END AS gained, count(*) AS n FROM u_ WHERE {_NO_QUIET} GROUP BY ALL")
def decode_actions(spark, d):
    rows = lookup.rows(LogStore.given(spark, d), LookupSpec())
    return rows.groupBy("tbl", "action", codes.sign_of(F.col("tbl"), F.col("action")).alias("sign"), codes.polarity(F.col("tbl"), F.col("action")).alias("gained")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_ALL}, p AS (SELECT * FROM u_ WHERE time > {NOW - 7 * DAY} AND {_NO_QUIET} ORDER BY time DESC, tbl DESC, id DESC LIMIT 20)
 SELECT p.id, p.tbl, regexp_extract(CAST(to_json(struct_pack(a := p.time * 1000)) AS VARCHAR), '[0-9]+') AS stamp, p.amount, coalesce(p.rolled_back & 1, 0) <> 0 AS undone FROM p""")
def networking_record(spark, d):
    store = LogStore.given(spark, d)
    r = render.data_records(lookup.page(store, parse("t:7d page 1:20", NOW)))
    j = lambda k: F.get_json_object("record", f"$.{k}")
    return r.select("id", "tbl", j("time").alias("stamp"), j("amount").cast("int").alias("amount"), j("rolledback").cast("boolean").alias("undone"))


@query()
def lookup_lines(spark, d):
    store = LogStore.given(spark, d)
    return render.lookup_lines(lookup.display(store, parse("t:7d page 1:20", NOW), NOW))


@query(f"""{_V} SELECT t.id, CASE WHEN t.blockdata IS NOT NULL THEN coalesce((SELECT string_agg(m.name, ',' ORDER BY p.k) FROM (SELECT unnest(string_split(t.blockdata, ',')) AS part, unnest(range(len(string_split(t.blockdata, ',')))) AS k) p JOIN material_ m ON m.id = CAST(p.part AS INT)), '') END AS names FROM block_ t""")
def decode_blockdata(spark, d):
    store = LogStore.given(spark, d)
    return codes.decode_blockdata(store.once(store["block"].select("id", "blockdata"), "block"), store["material"]).select("id", "names")


def _stamped(table: str, extra: str, where: str) -> str:
    return f"{with_views('chat', 'session', 'username', 'sign')} SELECT t.id, CAST(t.time * 1000 AS VARCHAR) AS stamp, {extra} FROM {table} t WHERE {where}"


@query(_stamped("chat_", "t.message AS text", f"t.time > {NOW - DAY} AND t.message IS NOT NULL AND t.user_id IS NOT NULL"))
def networking_messages(spark, d):
    store = LogStore.given(spark, d)
    rows = lookup.rows(store, parse("a:chat t:1d", NOW)).where("message is not null and user_id is not null")
    r = render.message_records(lookup.named(store, rows))
    return r.select("id", F.get_json_object("record", "$.time").alias("stamp"), F.get_json_object("record", "$.message").alias("text"))


@query(_stamped("session_", "CASE t.action WHEN 1 THEN 'login' ELSE 'logout' END AS text", f"t.time > {NOW - 2 * DAY}"))
def networking_sessions(spark, d):
    store = LogStore.given(spark, d)
    r = render.session_records(lookup.named(store, lookup.rows(store, parse("a:session t:2d", NOW))))
    return r.select("id", F.get_json_object("record", "$.time").alias("stamp"), F.get_json_object("record", "$.action").alias("text"))


@query(_stamped("username_", "t.name AS text", f"t.time > {NOW - 3 * DAY} AND t.name IS NOT NULL"))
def networking_usernames(spark, d):
    r = render.username_records(lookup.rows(LogStore.given(spark, d), parse("a:username t:3d", NOW)).where("name is not null"))
    return r.select("id", F.get_json_object("record", "$.time").alias("stamp"), F.get_json_object("record", "$.target").alias("text"))


@query(f"{with_views('sign')} SELECT id, regexp_replace('§x§a§b§c§1§2§3' || line_1, '§[xX](§[0-9a-fA-F]){{6}}', '', 'g') AS plain FROM sign_ WHERE line_1 IS NOT NULL")
def sign_colours(spark, d):
    s = LogStore.given(spark, d)["sign"].where("line_1 is not null")
    return s.select("id", codes.strip_colours(F.concat(F.lit("§x§a§b§c§1§2§3"), "line_1")).alias("plain"))


@query(f"{with_views('material')} SELECT id, lower(split_part(name, ':', -1)) AS short FROM material_")
def decode_types(spark, d):
    return LogStore.given(spark, d)["material"].select("id", codes.short_type(F.col("name")).alias("short"))

"""The typed lookups: one function for each family, with options instead of a filter text.

Times are exclusive at the old end (time > now - seconds); a radius of 0 is the exact place; a radius has no y bound;
an unknown user gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import codes
from tracewright.operators import lookup
from tracewright.plans.spec import Box, LookupSpec, SpecError, parse_time
from tracewright.schema import QUIET_ITEMS
from tracewright.sources.store import LogStore

API_VERSION = 12
_INT = 2**31 - 1


@dataclass(frozen=True)
class Options:
    """now: the clock; seconds: how far back (0: all); limit and offset: paging, 0 for all rows."""

    now: int
    seconds: int = 0
    user: str | None = None
    place: tuple[int, int, int, int] | None = None  # wid, x, y, z
    radius: int = 0
    limit: int = 0
    offset: int = 0


def _clamped(v: int) -> int:
    return max(-_INT - 1, min(_INT, v))


def _filter(store: LogStore, o: Options) -> Column:
    keep = [F.col("time") > o.now - o.seconds] if o.seconds > 0 else []
    if o.user is not None:
        ids = lookup.user_ids(store, (o.user,))
        keep.append(F.col("user_id") == ids[o.user.lower()] if ids else F.lit(False))
    if o.place:
        w, x, y, z = o.place
        keep.append(F.col("wid") == w)
        if o.radius > 0:
            keep += [F.col("x").between(_clamped(x - o.radius), _clamped(x + o.radius)), F.col("z").between(_clamped(z - o.radius), _clamped(z + o.radius))]
        else:
            keep += [F.col("x") == x, F.col("y") == y, F.col("z") == z]
    return reduce(lambda a, b: a & b, keep, F.lit(True))


def _cut(store: LogStore, parts: dict[str, DataFrame], o: Options) -> DataFrame:
    """Newest first where rows are limited; else no order is paid for."""
    if o.limit:
        return lookup.newest(store, parts, o.offset, o.limit)
    df = reduce(DataFrame.unionByName, [store.once(p, f) for f, p in parts.items()])
    return lookup.ordered(df).offset(o.offset) if o.offset else df


def _since(o: Options) -> int:
    return o.now - o.seconds if o.seconds > 0 else 0


def _who(store: LogStore, df: DataFrame) -> DataFrame:
    return df.join(store["user"].select(F.col("id").alias("user_id"), F.col("name").alias("user_name")), "user_id", "left")


def _fetch(store: LogStore, family: str, o: Options, more: Column | None = None) -> DataFrame:
    keep = _filter(store, o)
    return _who(store, _cut(store, {family: store.during(family, keep if more is None else keep & more, _since(o))}, o))


def block_lookup(store: LogStore, o: Options) -> DataFrame:
    return _fetch(store, "block", o).select("id", "time", "user_name", "wid", "x", "y", "z", codes.block_action(F.col("action")).alias("action"), "type", "data", codes.rolled_back(F.col("rolled_back")).alias("rolled_back"))


def container_lookup(store: LogStore, o: Options) -> DataFrame:
    return _fetch(store, "container", o).select("id", "time", "user_name", "wid", "x", "y", "z", codes.container_action(F.col("action")).alias("action"), "type", "amount", "metadata", codes.rolled_back(F.col("rolled_back")).alias("rolled_back"))


def item_lookup(store: LogStore, o: Options) -> DataFrame:
    return _fetch(store, "item", o, ~F.col("action").isin(*QUIET_ITEMS)).select("id", "time", "user_name", "wid", "x", "y", "z", codes.item_action(F.col("action")).alias("action"), "type", "amount", "metadata", codes.rolled_back(F.col("rolled_back"), True).alias("rolled_back"))


def inventory_lookup(store: LogStore, o: Options) -> DataFrame:
    """Placed blocks, container and item rows of a player together; all item actions count."""
    keep = _filter(store, o)
    parts = {f: lookup.unified(f, store.during(f, keep & (F.col("action") == 1) if f == "block" else keep, _since(o)), True) for f in ("block", "container", "item")}
    df = _who(store, _cut(store, parts, o))
    return df.select("tbl", "id", "time", "user_name", "wid", "x", "y", "z", codes.source(F.col("tbl")).alias("source"), codes.polarity(F.col("tbl"), F.col("action")).alias("gained"), "type", "amount", codes.rolled_back(F.col("rolled_back"), True).alias("rolled_back"))


def session_lookup(store: LogStore, o: Options) -> DataFrame:
    return _fetch(store, "session", o).select("id", "time", "user_name", "wid", "x", "y", "z", codes.session_action(F.col("action")).alias("action"))


def message_lookup(store: LogStore, family: str, o: Options) -> DataFrame:
    """chat or command."""
    return _fetch(store, family, o).select("id", "time", "user_name", "wid", "x", "y", "z", "message")


def sign_lookup(store: LogStore, o: Options) -> DataFrame:
    lines = [F.col(f"line_{k}") for k in range(1, 9)]
    front, back = codes.glow(F.col("data"))
    return _fetch(store, "sign", o, (F.col("action") == 1) & codes.sign_written(lines)).select(
        "id", "time", "user_name", "wid", "x", "y", "z", codes.sign_action(F.col("action")).alias("action"), codes.sign_message(F.col("face"), lines).alias("message"), (F.col("face") == 0).alias("front"), front.alias("front_glow"), back.alias("back_glow"),
    )


def alias_uuids(store: LogStore, name: str) -> DataFrame:
    """uuids that a name has had: in the users, in the name log, or the name itself where it is a uuid."""
    n = name.lower()
    known = store["user"].where((F.lower("name") == n) & F.col("uuid").isNotNull()).select(F.lower("uuid").alias("uuid"))
    logged = store["username"].where((F.lower("name") == n) & F.col("uuid").isNotNull()).select(F.lower("uuid").alias("uuid"))
    literal = store.spark.range(1).select(F.lit(n).alias("uuid")).where(codes.is_uuid(F.col("uuid")))
    return known.unionByName(logged).unionByName(literal).distinct()


def alias_closure(store: LogStore, name: str) -> DataFrame:
    """All names of all uuids of a name: two semi joins."""
    uuids = alias_uuids(store, name)
    return store["username"].withColumn("uuid", F.lower("uuid")).join(uuids, "uuid", "left_semi").where(F.length("name") > 0).select("uuid", F.lower("name").alias("name")).distinct()


def username_lookup(store: LogStore, o: Options) -> DataFrame:
    """The name log of all uuids of a name."""
    df = store["username"] if o.seconds <= 0 else store["username"].where(F.col("time") > o.now - o.seconds)
    if o.user is not None:
        df = df.withColumn("uuid", F.lower("uuid")).join(alias_uuids(store, o.user), "uuid", "left_semi")
    return _cut(store, {"username": df}, o).select("id", "time", "uuid", "name")


def has_done(store: LogStore, user: str, place: tuple[int, int, int, int], action: int, now: int, seconds: int, offset: int = 0) -> DataFrame:
    """One row: whether the user placed (1) or removed (0) at the place within the time, up to ``offset`` seconds ago."""
    o = Options(now, seconds, user, place)
    hit = store.during("block", _filter(store, o) & (F.col("action") == action) & (F.col("time") <= now - offset), _since(o), now - offset).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("found"))


def queue_lookup(pending: DataFrame, place: tuple[int, int, int, int], limit: int = 0) -> DataFrame:
    """Break and place rows at a place that aren't committed yet, newest first; ``limit`` of them, 0 for all."""
    w, x, y, z = place
    at = (F.col("wid") == w) & (F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z)
    found = pending.where(at & F.col("action").isin(0, 1)).orderBy(F.col("id").desc())
    return found.limit(limit) if limit else found


def raw_rows(store: LogStore, df: DataFrame) -> DataFrame:
    """Rows of a union lookup as 13 strings, user id to name, in the order of parse_result."""
    d = _who(store, df)
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cols = ["time", "user_name", "x", "y", "z", "type", "data", "action", "rolled_back", "wid", "amount", "metadata", "tbl"]
    return d.select("tbl", "id", F.array(*map(s, cols)).alias("result"))


def parse_result(df: DataFrame, result: str = "result") -> DataFrame:
    """Typed columns of the 13 strings; shorter rows are padded with empty ones. Times are milliseconds."""
    r = F.concat(F.col(result), F.array_repeat(F.lit(""), 13))
    at = lambda k: F.element_at(r, k + 1)
    n = lambda k: at(k).try_cast("int")
    return df.select(
        "id", (at(0).try_cast("long") * 1000).alias("timestamp"), at(1).alias("player"), n(2).alias("x"), n(3).alias("y"), n(4).alias("z"), n(5).alias("type"), n(6).alias("data"), n(7).alias("action_id"),
        codes.block_action(n(7)).alias("action"), codes.rolled_back(n(8)).alias("rolled_back"), n(9).alias("wid"), n(10).alias("amount"), at(11).alias("metadata"),
    )


def perform_partial_lookup(store: LogStore, now: int, seconds: int, offset: int, limit: int, **lists) -> DataFrame | None:
    """Rows offset to offset + limit of perform_lookup, newest first; its lists are given by name."""
    spec = _spec_of(now, seconds, **lists)
    return None if spec is None else lookup.newest(store, lookup.selected(store, spec), offset, limit)


def perform_lookup(store: LogStore, now: int, seconds: int, users: tuple[str, ...] = (), exclude_users: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), actions: tuple[int, ...] = (), radius: int = 0, place: tuple[int, int, int, int] | None = None) -> DataFrame | None:
    """Lookup by lists. Without actions a material means break and place, an entity kills; other families are dropped.

    None where #global is asked for without a radius and nothing else limits the rows. Users whom nobody knows have no rows.
    """
    spec = _spec_of(now, seconds, users, exclude_users, include, exclude, actions, radius, place)
    return None if spec is None else lookup.rows(store, spec)


def _spec_of(now: int, seconds: int, users: tuple[str, ...] = (), exclude_users: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), actions: tuple[int, ...] = (), radius: int = 0, place: tuple[int, int, int, int] | None = None) -> LookupSpec | None:
    entities = [w for w in include if w.startswith(lookup.ENTITY)]
    if entities and len(entities) < len(include):
        raise SpecError("blocks and entities can't be mixed")
    own = tuple(a for a in actions if a <= 3) or ((3,) if entities else (0, 1))
    if users == ("#global",) and not radius:
        return None
    box = Box.around(place[1], place[2], place[3], (radius, None, radius)) if radius and place else None
    return LookupSpec(own, tuple(u for u in users if u != "#global"), exclude_users, now - seconds, 0, place[0] if box else None, None, box, None, include, exclude, unknown_users=True)


def seconds_of(text: str) -> int:
    return parse_time(text)[0]


def point_history(store: LogStore, family: str, place: tuple[int, int, int, int], since: int, page: int = 1, rows: int = 7, actions: tuple[int, ...] = ()) -> DataFrame:
    """What happened at one place, newest first, a page at a time; inspectors take the old end inclusively (time >=)."""
    return _who(store, lookup.newest(store, {family: _at(store, family, place, since, actions)}, (page - 1) * rows, rows))


def point_count(store: LogStore, family: str, place: tuple[int, int, int, int], since: int, rows: int = 7, actions: tuple[int, ...] = ()) -> DataFrame:
    n = store.once(_at(store, family, place, since, actions).select("id"), family).agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.ceil(F.col("n") / F.lit(rows)).cast("long").alias("pages"))


def _at(store: LogStore, family: str, place: tuple[int, int, int, int], since: int, actions: tuple[int, ...]) -> DataFrame:
    w, x, y, z = place
    keep = (F.col("wid") == w) & (F.col("x") == x) & (F.col("z") == z) & (F.col("y") == y) & (F.col("time") >= since)
    if family == "sign":
        keep = keep & (F.col("action") == 1) & codes.sign_written([F.col(f"line_{k}") for k in range(1, 9)])
    return store.during(family, keep & F.col("action").isin(*actions) if actions else keep, since - 1)

"""Lookups: a spec becomes one plan over one family, or over the union of block, container and item.

Names are resolved to ids first, on the driver, with one small aggregation over the dictionaries (bounded by the
names asked for), so that the scans get literal filters which reach Parquet. Each branch of the union gets its own
predicate. Re-delivered rows are dropped after filters and projection. Pages are taken before dictionaries are joined.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import codes
from tracewright.plans.spec import TAGS, LookupSpec, SpecError
from tracewright.schema import GAINS, LOSSES, QUIET_ITEMS
from tracewright.sources.store import LogStore

UNION = ["tbl", "id", "time", "user_id", "wid", "x", "y", "z", "type", "metadata", "data", "amount", "action", "rolled_back"]
TBL = {"block": 0, "container": 1, "item": 2}
ENTITY = "entity:"


def user_ids(store: LogStore, names: tuple[str, ...]) -> dict[str, int]:
    """Smallest id of each name, letter case aside; unknown names are missing."""
    if not names:
        return {}
    u = store["user"].select(F.lower("name").alias("n"), "id").where(F.col("n").isin(*{n.lower() for n in names}))
    return {r.n: r.i for r in u.groupBy("n").agg(F.min("id").alias("i")).collect()}


def user_uuids(store: LogStore, names: tuple[str, ...]) -> list[str]:
    """All uuids of the names asked for; a name belongs to few of them."""
    u = store["user"].where(F.lower("name").isin(*{n.lower() for n in names}) & F.col("uuid").isNotNull())
    return [r.uuid for r in u.select("uuid").distinct().collect()] if names else []


def type_ids(store: LogStore, words: tuple[str, ...]) -> list[int]:
    """Material ids of names and tags; a name may have several (legacy) ids. entity:N is an entity id."""
    if not words:
        return []
    cond = F.lit(False)
    for w in words:
        if w in TAGS:
            for end in TAGS[w]:
                cond = cond | F.lower("name").endswith(end)
        elif not w.startswith(ENTITY):
            cond = cond | (F.lower("name") == w.lower())
    ids = [r.id for r in store["material"].where(cond).select("id").distinct().collect()]
    return sorted(ids + [int(w[len(ENTITY) :]) for w in words if w.startswith(ENTITY)])


def item_actions(actions: tuple[int, ...]) -> tuple[list[int] | None, list[int]]:
    """Item lookups: the actions to take (None: any) and the ones to leave out."""
    if 0 in actions:
        return [2, 5, 6, 7], []
    if 1 in actions:
        return [3, 4], []
    return None, list(QUIET_ITEMS)


def inventory_actions(actions: tuple[int, ...]) -> list[int] | None:
    return list(GAINS) if 0 in actions else list(LOSSES) if 1 in actions else None


class Planner:
    """The predicates of a spec, branch by branch."""

    def __init__(self, store: LogStore, spec: LookupSpec):
        self.store, self.spec = store, spec
        wanted = tuple(u for u in spec.users if u not in ("#global", "#container"))
        ids = user_ids(store, wanted + spec.exclude_users)
        missing = [u for u in wanted if u.lower() not in ids]
        if missing and not spec.unknown_users:
            raise SpecError(f"unknown user: {missing[0]}")
        self.users = sorted({ids[u.lower()] for u in wanted if u.lower() in ids})
        self.nobody = bool(wanted) and not self.users  # asked for unknown users only: no rows, not those of all users
        self.exclude_users = sorted({ids[u.lower()] for u in spec.exclude_users if u.lower() in ids})
        self.entity = any(w.startswith(ENTITY) for w in spec.include + spec.exclude)
        self.include, self.exclude = type_ids(store, spec.include), type_ids(store, spec.exclude)
        self.uuids = user_uuids(store, wanted) if 9 in spec.actions else []

    def window(self) -> list[Column]:
        s = self.spec
        return [F.col("time") > s.start] * (s.start > 0) + [F.col("time") <= s.end] * (s.end > 0)

    def place(self) -> list[Column]:
        s, out = self.spec, []
        if s.wid is not None:
            out.append(F.col("wid") == s.wid)
        if s.double_container:
            x, y, z = s.double_container
            out += [F.col("x").isin(math.floor(x), math.ceil(x)), F.col("z").isin(math.floor(z), math.ceil(z)), F.col("y") == int(y)]
        elif s.box:
            out += [F.col("x").between(*s.box.x), F.col("z").between(*s.box.z)] + ([F.col("y").between(*s.box.y)] if s.box.y else [])
        return out

    def actors(self) -> list[Column]:
        return [F.lit(False)] * self.nobody + [F.col("user_id").isin(*self.users)] * bool(self.users) + [~F.col("user_id").isin(*self.exclude_users)] * bool(self.exclude_users)

    def types(self, family: str) -> list[Column]:
        """Material and entity ids are separate spaces: with entities the block log takes these, the others an empty list."""
        out = []
        own = not self.entity or family == "block"
        if self.spec.include:
            out.append(F.col("type").isin(*(self.include if own and self.include else [0])))
        if self.spec.exclude and own and self.exclude:
            out.append(~F.col("type").isin(*self.exclude))
        return out

    def action(self, family: str) -> list[Column]:
        s = self.spec
        if family == "session":
            on = [a for a in s.actions if a in (0, 1)]
            return [F.col("action").isin(*on)] if on else []
        if family == "sign":
            return [F.col("action") == 1, codes.sign_written([F.col(f"line_{k}") for k in range(1, 9)])]
        if family in ("chat", "command", "username"):
            return []
        if s.inventory:
            if family == "block":
                return [F.col("action") == 1]
            some = inventory_actions(tuple(a for a in s.actions if a in (0, 1)))
            return [F.col("action").isin(*some)] if some else []
        if family == "item":
            take, drop = item_actions(s.actions)
            return [F.col("action").isin(*take)] if take else [~F.col("action").isin(*drop)]
        on = [a for a in s.actions if a in (0, 1, 2, 3)]
        if on:
            return [F.col("action").isin(*on)]
        if family == "block" and s.union and not self.entity and (s.include or s.exclude):
            return [~F.col("action").isin(3)]
        return []

    def rows(self, family: str) -> DataFrame:
        conds = self.window() + self.action(family)
        if family == "username":
            conds += [F.col("uuid").isin(*self.uuids)] if self.spec.users else []
        else:
            conds += self.place() + self.actors()
        if family in TBL:
            conds += self.types(family)
        return self.store.during(family, reduce(lambda a, b: a & b, conds, F.lit(True)), self.spec.start, self.spec.end)


def family_of(spec: LookupSpec) -> str:
    a = spec.actions
    for family, hit in (("container", 4 in a or 5 in a), ("chat", 6 in a), ("command", 7 in a), ("session", 8 in a), ("username", 9 in a), ("sign", 10 in a), ("item", 11 in a)):
        if hit:
            return family
    return "block"


def branches(spec: LookupSpec) -> list[str]:
    """Families of a union lookup; what adds to an inventory has no block branch."""
    return ["container", "item"] if spec.inventory and 0 in spec.actions else ["block", "container", "item"]


def unified(family: str, df: DataFrame, inventory: bool = False) -> DataFrame:
    """The rows of a family in the columns that all branches of a union share."""
    extra = {
        "block": {"metadata": F.col("blockdata"), "amount": F.lit(1 if inventory else -1)},
        "container": {},
        "item": {"data": F.lit(0)},
    }[family]
    return df.select(*[(F.lit(TBL[family]) if c == "tbl" else extra[c] if c in extra else F.col(c)).alias(c) for c in UNION])


def selected(store: LogStore, spec: LookupSpec) -> dict[str, DataFrame]:
    """The delivered rows of a lookup by family, in the columns of the result."""
    p = Planner(store, spec)
    if not spec.union:
        return {family_of(spec): p.rows(family_of(spec))}
    return {f: unified(f, p.rows(f), spec.inventory) for f in branches(spec)}


def rows(store: LogStore, spec: LookupSpec) -> DataFrame:
    """All rows of a lookup, each entry once, in no order."""
    return reduce(DataFrame.unionByName, [store.once(df, f) for f, df in selected(store, spec).items()])


MOST_KEYS = 100_000  # a page up to that row is found by its keys


def newest(store: LogStore, parts: dict[str, DataFrame], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of the parts, each entry once, newest first.

    Where copies are possible, only the narrow keys of all rows are made distinct; the few keys of the page, at most
    MOST_KEYS, then pick the wide rows, so that these aren't shuffled. Deeper pages are cut from the wide rows.
    """
    wide = reduce(DataFrame.unionByName, parts.values())
    keys = ["time", "tbl", "id"] if "tbl" in wide.columns else ["id"]
    cut = lambda df: df.orderBy(*[F.col(k).desc() for k in keys]).offset(offset).limit(limit)
    if set(parts) <= store.unique or limit > MOST_KEYS:
        return cut(reduce(DataFrame.unionByName, [store.once(df, f) for f, df in parts.items()]))
    top = cut(reduce(DataFrame.unionByName, [store.once(df.select(*keys), f) for f, df in parts.items()])).select(*[F.col(k).alias(f"_{k}") for k in keys])
    mine = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return ordered(wide.join(F.broadcast(top), mine, "left_semi").distinct())  # at most MOST_KEYS narrow rows


def ordered(df: DataFrame, oldest_first: bool = False) -> DataFrame:
    """Newest first: a union by time, table and id, a single family by id; a restore goes the other way."""
    if "tbl" in df.columns:
        keys = ["time", "tbl", "id"]
    else:
        keys = ["id"]
    return df.orderBy(*[F.col(k).asc() if oldest_first else F.col(k).desc() for k in keys])


def page(store: LogStore, spec: LookupSpec) -> DataFrame:
    """One page of a lookup: top rows first, then names for these few rows only."""
    return named(store, newest(store, selected(store, spec), (spec.page - 1) * spec.rows, spec.rows))


def named(store: LogStore, df: DataFrame) -> DataFrame:
    """Left joins of the dictionaries that the rows have keys for: user_name, world, type_name."""
    out = df
    if "user_id" in df.columns:
        out = out.join(store["user"].select(F.col("id").alias("user_id"), F.col("name").alias("user_name")), "user_id", "left")
    if "wid" in df.columns:
        out = out.join(store["world"].select(F.col("id").alias("wid"), F.col("name").alias("world")), "wid", "left")
    if "type" in df.columns:
        m = store["material"].select(F.col("id").alias("m_id"), F.col("name").alias("m_name"))
        entity = (F.col("action") == 3) & (F.col("tbl") == 0 if "tbl" in df.columns else F.lit("blockdata" in df.columns))
        out = out.join(m, F.when(~F.coalesce(entity, F.lit(False)), F.col("type")) == F.col("m_id"), "left").drop("m_id").withColumnRenamed("m_name", "type_name")
    return out


def kill_targets(store: LogStore, df: DataFrame) -> DataFrame:
    """Names what a kill hit: a player where type is 0 (data is the user's id), else entity:type."""
    u = store["user"].select(F.col("id").alias("victim_id"), F.col("name").alias("victim_name"))
    player = F.when((F.col("action") == 3) & (F.col("type") == 0), F.col("data"))
    out = df.where(F.col("action") == 3).join(u, player == F.col("victim_id"), "left").drop("victim_id")
    return out.withColumn("victim", F.when(F.col("type") == 0, F.col("victim_name")).otherwise(F.concat(F.lit(ENTITY), F.col("type").cast("string")))).drop("victim_name")


def counts(store: LogStore, spec: LookupSpec) -> DataFrame:
    """Rows by table of a lookup, without order or columns that aren't needed."""
    part = lambda f, df: store.once(df.select((F.col("tbl") if "tbl" in df.columns else F.lit(TBL.get(f, 0))).alias("tbl"), "id"), f)
    df = reduce(DataFrame.unionByName, [part(f, df) for f, df in selected(store, spec).items()])
    return df.groupBy("tbl").agg(F.count(F.lit(1)).alias("n"))


def pages(store: LogStore, spec: LookupSpec) -> DataFrame:
    """Total rows, number of pages, and whether the asked page exists."""
    t = counts(store, spec).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    n = F.ceil(F.col("total") / F.lit(spec.rows)).cast("long")
    state = F.when(F.col("total") == 0, "no data").when(F.lit(spec.page) > n, "no such page").otherwise("ok")
    return t.select("total", n.alias("pages"), state.alias("state"))


def display(store: LogStore, spec: LookupSpec, now: int) -> DataFrame:
    """A page as shown: age, user, sign, action, type, amount, source, struck out where rolled back."""
    df = page(store, spec)
    tbl = F.col("tbl")
    action = F.when(tbl == 0, codes.block_action(F.col("action"))).when(tbl == 1, codes.container_action(F.col("action"))).otherwise(codes.item_action(F.col("action")))
    return df.select(
        "id", "tbl", codes.time_since(F.col("time"), now).alias("age"), F.coalesce("user_name", F.lit("")).alias("who"), codes.sign_of(tbl, F.col("action")).alias("sign"),
        action.alias("did"), codes.short_type(F.col("type_name")).alias("what"), "amount", codes.source(tbl).alias("source"), codes.rolled_back(F.col("rolled_back"), spec.inventory).alias("struck"),
    )

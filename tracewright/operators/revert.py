"""Rollback and restore as data: which rows, what state each place gets, net item changes, toggled states, summaries.

The selection comes from a lookup spec; nothing is collected. Targets are one aggregation a place: a rollback undoes
the oldest selected row of a place, a restore redoes the newest one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import codes
from tracewright.operators import lookup
from tracewright.operators.asof import PLACE
from tracewright.plans.spec import TAGS, LookupSpec
from tracewright.schema import BLOCK_BIT, INVENTORY_BIT
from tracewright.sources.store import LogStore

AIR = 0
#: Update targets: 0 block, 1 container, 2 item, 3 container in an inventory, 4 block in an inventory.
INVENTORY_TARGETS, CONTAINER_TARGETS, ITEM_TARGET = (2, 3, 4), (1, 3), 2


@dataclass(frozen=True)
class RevertPlan:
    """A rollback or restore, kept so that it can be previewed, applied, cancelled or undone."""

    spec: LookupSpec
    restore: bool = False
    preview: bool = False
    entities: bool = True
    items: bool = True

    def undo(self) -> RevertPlan:
        return replace(self, restore=not self.restore, preview=False)

    def apply(self) -> RevertPlan:
        return replace(self, preview=False)

    def cancel(self) -> RevertPlan:
        return replace(self, preview=True)

    @property
    def places_container(self) -> bool:
        """Whether placings of a container type are asked for (and not left out): what was put in goes with it."""
        s = self.spec
        return 1 in s.actions and any(w not in s.exclude and (w == "#container" or w.endswith(TAGS["#container"])) for w in s.include)

    @property
    def families(self) -> list[str]:
        """Tables that are scanned: blocks unless containers alone are asked for; containers as well, when the settings
        say so, for all actions, container actions, or placed containers, but in no preview."""
        s = self.spec
        if s.inventory:
            return lookup.branches(s)
        if "#container" in s.users:
            return []
        contents = self.items and not self.preview and (not s.actions or 4 in s.actions or self.places_container)
        return ["block"] * (not {4, 5} & {*s.actions}) + ["container"] * contents

    def spec_of(self, family: str) -> LookupSpec:
        """The filter of a family: contents come without the types that a placed container stands for, and without
        excludes that were added by themselves."""
        s = self.spec
        if family != "container" or s.inventory:
            return s
        s = replace(s, actions=s.actions if 4 in s.actions else (*s.actions, 4), exclude=tuple(w for w in s.exclude if w not in s.auto_excluded))
        return replace(s, include=(), exclude=()) if self.places_container else s


def selection(store: LogStore, plan: RevertPlan, family: str = "block") -> DataFrame:
    """The selected rows of a family: clicks never, kills only if entities are reverted; an inventory keeps all."""
    df = store.once(lookup.Planner(store, plan.spec_of(family)).rows(family), family)
    if family == "block" and not plan.spec.inventory:
        df = df.where(~F.col("action").isin(*((2,) if plan.entities else (2, 3))))
    return df


def is_due(state: Column, restore: bool, inventory: Column | bool = False) -> Column:
    """Only rows whose bit still has the other value are toggled, so that a second run changes nothing."""
    bit = F.when(inventory, INVENTORY_BIT).otherwise(BLOCK_BIT) if isinstance(inventory, Column) else F.lit(INVENTORY_BIT if inventory else BLOCK_BIT)
    done = F.coalesce(state, F.lit(0)).bitwiseAND(bit) != 0
    return done if restore else ~done


def block_targets(rows: DataFrame, restore: bool = False) -> DataFrame:
    """wid, x, y, z, target_type, target_data: the state which each place gets; 0 is empty."""
    changes = rows.where(F.col("action").isin(0, 1))
    pick = F.max_by if restore else F.min_by
    m = changes.groupBy(*PLACE).agg(pick(F.struct("action", "type", "blockdata"), F.col("id")).alias("m"))
    emptied = F.col("m.action") == (0 if restore else 1)
    return m.select(*PLACE, F.when(emptied, AIR).otherwise(F.col("m.type")).alias("target_type"), F.when(~emptied, F.col("m.blockdata")).alias("target_data"))


def entity_changes(rows: DataFrame, restore: bool = False) -> DataFrame:
    """Kills undone spawn an entity, restored ones remove it; player kills have no entity."""
    return rows.where((F.col("action") == 3) & (F.col("type") != 0)).select("id", *PLACE, "type", F.lit("remove" if restore else "spawn").alias("change"))


def container_net(rows: DataFrame, restore: bool = False) -> DataFrame:
    """Net amount for each item of each container, of the rows that are due; a rollback turns directions round."""
    due = rows.where((F.col("action") <= 1) & is_due(F.col("rolled_back"), restore))
    sign = F.when(F.col("action") == 1, 1).otherwise(-1) * (1 if restore else -1)
    return due.groupBy(*PLACE, "type", "metadata").agg(F.sum(F.col("amount") * sign).alias("net")).where(F.col("net") != 0)


def inventory_net(rows: DataFrame, restore: bool = False) -> DataFrame:
    """Net amount for each user and item, and for the ender chest, of union rows that are due; unknown users are skipped."""
    inv = F.col("rolled_back")
    due = rows.where(F.col("user_id").isNotNull() & is_due(inv, restore, True))
    gain = codes.polarity(F.col("tbl"), F.col("action"))
    sign = (F.when(gain == 1, 1).otherwise(-1)) * (1 if restore else -1)
    ender = F.when((F.col("tbl") == 2) & F.col("action").isin(4, 5), F.col("amount") * -sign).otherwise(0)
    return due.groupBy("user_id", "type").agg(F.sum(F.col("amount") * sign).alias("net"), F.sum(ender).alias("ender_net"))


def toggled(rows: DataFrame, restore: bool = False, inventory: bool = False) -> DataFrame:
    """The rows whose state changes, with the new one."""
    return rows.where(is_due(F.col("rolled_back"), restore, inventory)).withColumn("rolled_back", codes.toggle(F.col("rolled_back"), inventory))


def targets(rows: DataFrame) -> DataFrame:
    """Union rows with the update target they are routed to."""
    return rows.withColumn("target", F.when(F.col("tbl") == 2, ITEM_TARGET).when(F.col("tbl") == 1, 3).otherwise(4))


def state_changes(rows: DataFrame, family: str, seq: int, restore: bool = False, inventory: bool = False) -> DataFrame:
    """Append-only log of toggles: (tbl, id, seq, bit); the current state is the base state with all of them applied."""
    return rows.where(is_due(F.col("rolled_back"), restore, inventory)).select(F.lit(lookup.TBL[family]).alias("tbl"), "id", F.lit(seq).alias("seq"), F.lit(INVENTORY_BIT if inventory else BLOCK_BIT).alias("bit"))


def current_state(base: DataFrame, changes: DataFrame, family: str) -> DataFrame:
    """Base rows with their present rolled_back; toggles commute, so only their parities count."""
    c = changes.where(F.col("tbl") == lookup.TBL[family]).groupBy("id").agg(*[F.sum(F.when(F.col("bit") == b, 1).otherwise(0)).alias(f"n{b}") for b in (1, 2)])
    flip = F.coalesce(F.col("n1") % 2, F.lit(0)) + 2 * F.coalesce(F.col("n2") % 2, F.lit(0))
    return base.join(c, "id", "left").withColumn("rolled_back", F.coalesce("rolled_back", F.lit(0)).bitwiseXOR(flip.cast("int"))).drop("n1", "n2")


def chunks(rows: DataFrame, x: int, z: int) -> DataFrame:
    """Work list by chunk, nearest first: wid, cx, cz, n, dist; ties keep the chunk order."""
    cx, cz = codes.chunk(F.col("x")), codes.chunk(F.col("z"))
    dist = F.floor(F.sqrt(F.pow(F.col("x") - F.lit(x), F.lit(2)) + F.pow(F.col("z") - F.lit(z), F.lit(2)))).cast("long")
    return rows.groupBy("wid", cx.alias("cx"), cz.alias("cz")).agg(F.count(F.lit(1)).alias("n"), F.min(dist).alias("dist"))


def work_order(chunk_list: DataFrame) -> DataFrame:
    return chunk_list.orderBy("dist", "wid", "cx", "cz")


def summary(rows: DataFrame, restore: bool = False) -> DataFrame:
    """Counters of a block rollback, made of the rows that are due: blocks, entities, chunks, worlds, users."""
    due = is_due(F.col("rolled_back"), restore)
    n = lambda c: F.coalesce(F.sum(F.when(due & c, 1).otherwise(0)), F.lit(0))
    return rows.agg(
        n(F.col("action").isin(0, 1)).alias("blocks"), n((F.col("action") == 3) & (F.col("type") != 0)).alias("entities"),
        F.countDistinct(F.when(F.col("wid").isNotNull(), F.struct("wid", codes.chunk(F.col("x")), codes.chunk(F.col("z"))))).alias("chunks"), F.countDistinct("wid").alias("worlds"), F.countDistinct("user_id").alias("users"),
    )


def items_moved(rows: DataFrame, restore: bool = False) -> DataFrame:
    """Number of items which a container rollback moves."""
    due = rows.where((F.col("action") <= 1) & is_due(F.col("rolled_back"), restore))
    return due.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("items"))


def plain_reverse(rows: DataFrame, restore: bool) -> DataFrame:
    """Rows in the order they are applied: newest first, a restore oldest first."""
    return lookup.ordered(rows, restore)


def run(store: LogStore, plan: RevertPlan) -> dict[str, DataFrame]:
    """All results of a plan by name; a preview has no changed states."""
    out: dict[str, DataFrame] = {}
    if plan.spec.inventory:
        rows = reduce(DataFrame.unionByName, [lookup.unified(f, selection(store, plan, f), True) for f in plan.families])
        out["inventory"] = inventory_net(rows, plan.restore)
        if not plan.preview:
            out["states"] = toggled(targets(rows), plan.restore, True)
        return out
    for f in plan.families:
        rows = selection(store, plan, f)
        if f == "block":
            out["blocks"], out["entities"], out["summary"] = block_targets(rows, plan.restore), entity_changes(rows, plan.restore), summary(rows, plan.restore)
        elif f == "container":
            out["containers"], out["items"] = container_net(rows, plan.restore), items_moved(rows, plan.restore)
        if not plan.preview:
            out[f"{f}_states"] = toggled(rows, plan.restore)
    return out

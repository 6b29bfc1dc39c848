"""Host events to log rows: which family, action and actor each kind of event is logged with.

A host event has event, user, wid, x, y, z, time, and old_type and new_type where blocks change. One projection turns
a frame (or stream) of them into rows; stateful parts (repeats, groups, debounce, snapshots) follow in
operators.suppress or streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event kind -> (family, actions of the rows it makes, actor where it isn't the player).
EVENTS: dict[str, tuple[str, tuple[int, ...], str | None]] = {
    "block_break": ("block", (0,), None), "block_burn": ("block", (0,), "#fire"), "block_explode": ("block", (0,), "#explosion"), "block_fade": ("block", (0,), "#fire"), "leaves_decay": ("block", (0,), "#decay"),
    "block_place": ("block", (1,), None), "block_form": ("block", (1,), None), "block_spread": ("block", (1,), "#vine"), "block_fertilize": ("block", (1,), "#bonemeal"), "block_from_to": ("block", (1,), "#flow"), "block_ignite": ("block", (1,), "#fire"),
    "portal_create": ("block", (1,), "#portal"), "structure_grow": ("block", (1,), "#tree"), "entity_block_form": ("block", (1,), "#snowman"), "creature_spawn": ("block", (1,), None), "hanging_place": ("block", (1,), None), "flower_pot": ("block", (1,), None),
    "block_piston": ("block", (0, 1), "#piston"), "entity_change_block": ("block", (0, 1), "#enderman"), "entity_interact": ("block", (0, 1), "#entity"), "sign_recolour": ("sign", (0, 2), None), "food_level_change": ("block", (0, 1), None),
    "entity_explode": ("block", (0,), "#explosion"), "tnt_prime": ("block", (0,), None), "hanging_break": ("block", (0,), "#physics"), "hanging_break_by_entity": ("block", (0,), None), "bucket_fill": ("block", (0,), None), "bucket_empty": ("block", (1,), None),
    "player_interact": ("block", (2,), None), "armor_stand_manipulate": ("block", (2,), None), "entity_death": ("block", (3,), None), "player_death": ("block", (3,), None), "campfire_start": ("block", (1,), None),
    "block_dispense": ("container", (0,), "#dispenser"), "hopper_pull": ("container", (0,), "#hopper"), "hopper_push": ("container", (1,), "#hopper"), "inventory_change": ("container", (0, 1), None), "inventory_click": ("container", (0, 1), None), "take_book": ("container", (0,), None), "golem_chest": ("container", (0, 1), "#copper_golem"), "pre_dispense": ("container", (0,), "#dispenser"), "damage_by_entity": ("container", (0,), None), "damage_by_block": ("container", (0,), None),
    "drop_item": ("item", (2,), None), "pickup_item": ("item", (3,), None), "pickup_arrow": ("item", (3,), None), "throw_item": ("item", (6,), None), "shoot_item": ("item", (7,), None), "item_break": ("item", (8,), None), "item_destroy": ("item", (9,), None), "craft_item": ("item", (10,), None), "sell_item": ("item", (11,), None), "buy_item": ("item", (12,), None), "ender_take": ("item", (4,), None), "ender_put": ("item", (5,), None),
    "chat": ("chat", (), None), "command": ("command", (), None), "join": ("session", (1,), None), "quit": ("session", (0,), None), "sign_change": ("sign", (0, 1), None), "bulk_edit": ("block", (0, 1), None),
}


#: Event kind -> actors by what caused it; a cause that isn't named takes the actor of the kind.
CAUSES: dict[str, dict[str, str]] = {
    "entity_explode": {"tnt": "#tnt", "tnt_minecart": "#tnt", "creeper": "#creeper", "ender_dragon": "#enderdragon", "wither": "#wither", "wither_skull": "#wither", "end_crystal": "#end_crystal"},
    "block_explode": {"bed": "#bed", "respawn_anchor": "#respawn_anchor"},
    "block_from_to": {"water": "#water", "lava": "#lava"},
    "block_fade": {"turtle_egg": "#turtle"},
    "entity_change_block": {"enderman": "#enderman", "ender_dragon": "#enderdragon", "fox": "#fox", "wither": "#wither", "turtle": "#turtle", "ravager": "#ravager", "zombie": "#zombie", "silverfish": "#silverfish", "wind_charge": "#windcharge", "breeze_wind_charge": "#breezewindcharge", "falling_block": "#gravity"},
    "entity_death": {"fire": "#fire", "fire_tick": "#fire", "lava": "#lava", "block_explosion": "#explosion", "magic": "#magic", "wither": "#wither_effect"},
}
#: Deaths by any other cause or attacker are logged under its own name.
NAMED = ("entity_death",)


def actor_of(cause: Column) -> Column:
    """The actor of an event by its kind and cause; null where the kind alone tells."""
    c = F.lower(cause)
    known = F.create_map(*[F.lit(x) for e, by in sorted(CAUSES.items()) for k, a in sorted(by.items()) for x in (f"{e} {k}", a)])
    return F.coalesce(known[F.concat_ws(" ", "event", c)], F.when(F.col("event").isin(*NAMED) & c.isNotNull(), F.concat(F.lit("#"), c)))


def event_table(spark: SparkSession) -> DataFrame:
    """event, family, actions, actor; fixed and small."""
    return spark.createDataFrame([(e, f, list(a), u) for e, (f, a, u) in sorted(EVENTS.items())], "event string, family string, actions array<int>, actor string")


def to_rows(events: DataFrame) -> DataFrame:
    """Family, action, actor and type of every row that the events make; unknown events make none.

    A change is a break of the old type and a placing of the new one; a missing actor is the player. With a ``cause``
    column (what exploded, flowed, changed a block or killed) the actor goes by it; a death by a player is the player's."""
    t = event_table(events.sparkSession)
    if "cause" in events.columns:
        events = events.withColumn("_by", F.when(~((F.col("event") == "entity_death") & F.col("user").isNotNull()), actor_of(F.col("cause"))))
    else:
        events = events.withColumn("_by", F.lit(None).cast("string"))
    j = events.join(F.broadcast(t), "event")  # the table is a constant of this module
    r = j.withColumn("action", F.explode_outer("actions")).withColumn("actor", F.coalesce("_by", "actor", "user"))
    typed = F.when(F.col("action") == 0, F.coalesce("old_type", "new_type")).otherwise(F.coalesce("new_type", "old_type"))
    return r.select("family", "time", "actor", "wid", "x", "y", "z", "action", typed.alias("type"))


def bulk_edit_rows(changes: DataFrame) -> DataFrame:
    """Rows of an edit session given as change set (wid, x, y, z, time, user, old_type, new_type); 0 is empty, equal types log nothing."""
    kinds = F.filter(F.array(F.when(F.col("old_type") != 0, F.struct(F.lit(0).alias("action"), F.col("old_type").alias("type"))), F.when(F.col("new_type") != 0, F.struct(F.lit(1).alias("action"), F.col("new_type").alias("type")))), lambda s: s.isNotNull())
    return changes.where(F.col("old_type") != F.col("new_type")).withColumn("r", F.explode(kinds)).select("time", "user", "wid", "x", "y", "z", "r.action", "r.type")

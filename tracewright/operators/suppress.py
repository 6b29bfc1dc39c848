"""Stateful ingest operators in batch form: repeat suppression, change filter, groups, debounce, snapshot diffs.

Arrival order is (time, id). The streaming forms of the first two are in tracewright.streaming.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.frames import before, bucket
from tracewright.operators.asof import DAY, PLACE

# Fixed values: (threshold, window seconds, state life seconds) of the suppressed sources.
REPEATS = {"dropper": (512, 1200, 1200), "dispenser": (256, 1200, 1200), "flow": (512, 900, 900), "bonemeal": (256, 900, 900), "dispenser_liquid": (256, 1200, 900), "entity_kill": (256, 900, 900)}
SPREAD_TTL, PISTON_TTL = 1800, 900
FRESH = {"water": 60, "lava": 240, "vine": 240}
#: Order in which merged item transactions are written.
ITEM_ORDER = (3, 2, 6, 7, 8, 9, 10, 11, 12)


def suppress_repeats(df: DataFrame, keys: list[str], threshold: int, window: int, time: str = "time", id_col: str = "id", bucket_seconds: int = DAY) -> DataFrame:
    """Keeps the first ``threshold`` rows of each stretch of a key whose gaps are at most ``window`` seconds.

    Stretches are counted in (key, time bucket) groups. How many rows the stretch at a bucket's start has before it
    comes from one summary row a bucket: a bucket that is all one stretch and goes on hands its count further.
    """
    group = [*keys, "_b"]
    w = Window.partitionBy(*group).orderBy(time, id_col)
    rows = df.withColumn("_b", bucket(F.col(time), bucket_seconds))
    s = rows.withColumn("_new", F.when(F.col(time) - F.lag(time).over(w) > window, 1).otherwise(0)).withColumn("_s", F.sum("_new").over(w))
    s = s.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_s").orderBy(time, id_col)))
    sums = s.groupBy(*group).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.max("_s").alias("s"), F.max_by("_n", F.struct(time, id_col)).alias("tail"))
    per = Window.partitionBy(*keys).orderBy("_b")
    sums = sums.withColumn("on", F.coalesce(F.col("first") - F.lag("last").over(per) <= window, F.lit(False)))
    sums = sums.withColumn("chain", F.sum(F.when((F.col("s") == 0) & F.col("on"), 0).otherwise(1)).over(per))
    sums = sums.withColumn("so_far", F.sum("tail").over(Window.partitionBy(*keys, "chain").orderBy("_b")))
    carried = sums.select(*group, F.when(F.col("on"), F.lag("so_far").over(per)).otherwise(0).alias("_carried"))
    same = reduce(lambda a, c: a & c, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in group])
    n = F.col("_n") + F.when(F.col("_s") == 0, F.coalesce("_carried", F.lit(0))).otherwise(0)
    return s.alias("r").join(carried.alias("c"), same, "left").where(n <= threshold).select(*[F.col(f"r.{c}").alias(c) for c in df.columns])


def symmetric(a: str, b: str, out: str = "pair") -> Column:
    """One key for both directions of a change between two states."""
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).alias(out)


def changes_only(df: DataFrame, value: str = "type", ttl: int = SPREAD_TTL, resets: DataFrame | None = None, time: str = "time", id_col: str = "id") -> DataFrame:
    """Drops rows whose place had the same value within ttl seconds before; every row renews it, a reset forgets it."""
    rows = df.withColumn("_r", F.lit(False))
    if resets is not None:
        rows = rows.unionByName(resets.select(*[F.col(c) for c in df.columns]).withColumn("_r", F.lit(True)))
    rows = before(rows, PLACE, [value, time, "_r"], "_p", time, id_col)
    same = (F.col(f"_p.{value}") == F.col(value)) & (F.col(time) - F.col(f"_p.{time}") <= ttl) & ~F.col("_p._r")
    return rows.where(~F.coalesce(same, F.lit(False)) & ~F.col("_r")).drop("_p", "_r")


def group_events(df: DataFrame, group: str, keys: list[str], ttl: int = PISTON_TTL, time: str = "time", id_col: str = "id") -> DataFrame:
    """All rows of the groups in which any row's key wasn't seen within ttl seconds before; every row renews its key."""
    fresh = F.coalesce(F.col(time) - F.col(f"_p.{time}") > ttl, F.lit(True))
    marked = before(df, keys, [time], "_p", time, id_col).withColumn("_fresh", fresh)
    logged = marked.groupBy(group).agg(F.bool_or("_fresh").alias("_any")).where("_any").select(group)
    return df.join(logged, group, "left_semi")


def merge_item_transactions(df: DataFrame, gap: int = 1, time: str = "time", id_col: str = "id", bucket_seconds: int = DAY) -> DataFrame:
    """Item rows of a user at a place in bursts (gaps of at most ``gap`` seconds) become one row an action and item.

    Bursts are counted in (user, place, time bucket) groups; what earlier buckets started comes from one row a bucket.
    """
    keys = ["user_id", *PLACE]
    group = [*keys, "_b"]
    w = Window.partitionBy(*group).orderBy(time, id_col)
    rows = df.withColumn("_b", bucket(F.col(time), bucket_seconds))
    s = rows.withColumn("_new", F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)).withColumn("_s", F.sum("_new").over(w))
    per = Window.partitionBy(*keys).orderBy("_b")
    sums = s.groupBy(*group).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.max("_s").alias("inner"))
    sums = sums.withColumn("fresh", F.coalesce(F.col("first") - F.lag("last").over(per) > gap, F.lit(True)).cast("int"))
    sums = sums.select(*group, (F.sum(F.col("fresh") + F.col("inner")).over(per) - F.col("inner")).alias("_first"))
    same = reduce(lambda a, c: a & c, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in group])
    s = s.alias("r").join(sums.alias("c"), same).select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("_first") + F.col("_s")).alias("burst"))
    rank = reduce(lambda c, x: c.when(F.col("action") == x[1], x[0]), enumerate(ITEM_ORDER), F.when(F.lit(False), -1)).otherwise(len(ITEM_ORDER))
    return s.groupBy(*keys, "burst", "action", "type", "metadata").agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.sum("amount").alias("amount")).withColumn("rank", rank)


def instance(df: DataFrame, name: str) -> DataFrame:
    """Repeat suppression of a named source: its keys, threshold, and the smaller of its window and its state's life.

    Flow counts a change and its way back as one, so its key is the pair of both states.
    """
    threshold, window, life = REPEATS[name]
    if name == "flow":
        keyed = df.withColumn("_pair", symmetric("old_type", "type"))
        return suppress_repeats(keyed, [*PLACE, "_pair"], threshold, min(window, life)).drop("_pair")
    return suppress_repeats(df, [*PLACE, "type"], threshold, min(window, life))


def stacked(df: DataFrame, keys: list[str], item: list[str] = ("type", "metadata"), amount: str = "amount") -> DataFrame:
    return df.groupBy(*keys, *item).agg(F.sum(amount).alias(amount))


def signature(df: DataFrame, keys: list[str], item: str = "type", amount: str = "amount") -> DataFrame:
    """A hash of the multiset of items of each key; a container's list is bounded by its slots after stacking."""
    s = stacked(df, keys, [item], amount)
    return s.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("x", F.lpad(F.col(item).cast("string"), 10, "0"), F.col(amount).cast("string")))), ","), 256).alias("signature"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], item: list[str] = ("type", "metadata"), moved: DataFrame | None = None) -> DataFrame:
    """Removals (action 0) and additions (1) that lead from one snapshot to the other.

    ``moved``: what others put in (+) or took out (-) meanwhile; it is taken off first."""
    net = before.select(*keys, *item, (-F.col("amount")).alias("d")).unionByName(after.select(*keys, *item, F.col("amount").alias("d")))
    if moved is not None:
        net = net.unionByName(moved.select(*keys, *item, (-F.col("amount")).alias("d")))
    d = net.groupBy(*keys, *item).agg(F.sum("d").alias("d")).where(F.col("d") != 0)
    return d.select(*keys, *item, F.when(F.col("d") > 0, 1).otherwise(0).alias("action"), F.abs("d").alias("amount"))


def without_fresh_chunks(placed: DataFrame, populated: DataFrame, names: str = "material") -> DataFrame:
    """Without liquids and vines placed shortly after their chunk came to be; ``populated`` has wid, cx, cz, time once a chunk."""
    p = populated.groupBy("wid", "cx", "cz").agg(F.max("time").alias("born"))
    life = reduce(lambda c, x: c.when(F.col(names).endswith(x[0]), x[1]), FRESH.items(), F.when(F.lit(False), 0))
    j = placed.withColumn("cx", F.shiftright("x", 4)).withColumn("cz", F.shiftright("z", 4)).join(p, ["wid", "cx", "cz"], "left")
    new = F.coalesce((F.col("time") >= F.col("born")) & (F.col("time") - F.col("born") <= life), F.lit(False))
    return j.where(~new).drop("cx", "cz", "born")


def place_over(df: DataFrame, old_type: str = "old_type") -> DataFrame:
    """A placing over something is two rows: the old thing broken, the new one placed."""
    rows = F.when(F.coalesce(F.col(old_type), F.lit(0)) != 0, F.array(F.struct(F.lit(0).alias("a"), F.col(old_type).alias("t")), F.struct(F.lit(1).alias("a"), F.col("type").alias("t")))).otherwise(F.array(F.struct(F.lit(1).alias("a"), F.col("type").alias("t"))))
    keep = [c for c in df.columns if c not in ("action", "type", old_type)]
    return df.withColumn("_r", F.explode(rows)).select(*keep, F.col("_r.a").alias("action"), F.col("_r.t").alias("type"))

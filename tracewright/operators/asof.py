"""As-of lookups, latest state, attribution with a time limit, and near matches.

An as-of lookup is one sort per (key, time bucket) over the union of both inputs and a running maximum; what earlier
buckets hold comes from one summary row a bucket, so a hot key is spread over its buckets and rows are never joined
by a range. Ties follow the entry id, not the time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.frames import bucket
from tracewright.functions.codes import BLOCK_BIT

PLACE = ["wid", "x", "y", "z"]
DAY = 86_400


def as_of(probes: DataFrame, base: DataFrame, keys: list[str], values: list[str], forward: bool = False, inclusive: bool | None = None, by_time: bool = False, time: str = "time", id_col: str = "id", bucket_seconds: int = DAY) -> DataFrame:
    """The probes' columns, and base's ``values`` (prefixed base_) of the row each probe sees.

    Backward: of the base rows of the key with time < t the one with the largest id (``by_time``: the latest, then the
    largest id). Forward: of those with time >= t the one with the smallest id. ``inclusive`` overrides whether equal
    times count. Probes without a match, a key or a time keep null values.
    """
    if inclusive is None:
        inclusive = forward
    rank = [F.col(time), F.col(id_col)] if by_time else [F.col(id_col)]
    seen = F.struct(*[r.alias(f"r{k}") for k, r in enumerate(rank)], *[F.col(v).alias(f"base_{v}") for v in values])
    b = base.where(reduce(lambda a, c: a & c, [F.col(k).isNotNull() for k in [*keys, time]])).select(*[F.col(k) for k in keys], F.col(time).alias("t"), seen.alias("seen"), F.lit(None).cast(_struct_of(probes)).alias("probe"))
    whole = F.struct(*probes.columns)
    p = probes.select(*[F.col(k) for k in keys], F.col(time).alias("t"), F.lit(None).cast(b.schema["seen"].dataType).alias("seen"), whole.alias("probe"))
    both = b.unionByName(p).withColumn("b", bucket(F.col("t"), bucket_seconds))
    # at equal times the base row goes first where it counts
    tie = F.when(F.col("probe").isNull(), 0 if inclusive else 1).otherwise(1 if inclusive else 0)
    order = [F.col("t").desc(), tie] if forward else [F.col("t").asc(), tie]
    best = F.min if forward else F.max
    w = Window.partitionBy(*keys, "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("inside", best("seen").over(w))
    buckets = both.where(F.col("seen").isNotNull()).groupBy(*keys, "b").agg(best("seen").alias("best"))
    far = Window.partitionBy(*keys).orderBy(F.col("b").desc() if forward else F.col("b").asc()).rowsBetween(Window.unboundedPreceding, -1)
    # buckets of probes without base rows need the carry too
    probe_buckets = p.withColumn("b", bucket(F.col("t"), bucket_seconds)).select(*keys, "b").distinct().withColumn("best", F.lit(None).cast(b.schema["seen"].dataType))
    carry = buckets.unionByName(probe_buckets).groupBy(*keys, "b").agg(best("best").alias("best")).select(*keys, "b", best("best").over(far).alias("carried"))
    asked = inside.where(F.col("probe").isNotNull()).alias("i").join(carry.alias("c"), [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "b"]], "left")
    got = F.least("inside", "carried") if forward else F.greatest("inside", "carried")
    out = asked.select("probe", got.alias("got"))
    return out.select("probe.*", *[F.col(f"got.base_{v}").alias(f"base_{v}") for v in values])


def _struct_of(df: DataFrame):
    return df.schema


def latest_placed(block: DataFrame) -> DataFrame:
    """Of each place: the newest placing that isn't rolled back: who, when, what."""
    ok = (F.col("action") == 1) & (F.coalesce(F.col("rolled_back"), F.lit(0)).bitwiseAND(BLOCK_BIT) == 0)
    return block.where(ok).groupBy(*PLACE).agg(F.max(F.struct("id", "time", "user_id", "type")).alias("m")).select(*PLACE, "m.id", "m.time", "m.user_id", "m.type")


def last_actor(probes: DataFrame, block: DataFrame, action: int, ttl: int = 30) -> DataFrame:
    """Probes with base_user_id of the last row with that action at their place, if at most ttl seconds before."""
    r = as_of(probes, block.where(F.col("action") == action), PLACE, ["user_id", "time"], inclusive=True, by_time=True)
    fresh = F.col("base_time") >= F.col("time") - ttl
    return r.withColumn("base_user_id", F.when(fresh, F.col("base_user_id"))).drop("base_time")


def attributed(probes: DataFrame, block: DataFrame, ttl: int = 30) -> DataFrame:
    """Who is held responsible: the recent placer, else the newest valid placer, else the actor itself."""
    recent = last_actor(probes, block, 1, ttl).withColumnRenamed("base_user_id", "recent_id")
    stored = latest_placed(block).select(*PLACE, F.col("user_id").alias("stored_id"))
    return recent.join(stored, PLACE, "left").withColumn("responsible_id", F.coalesce("recent_id", "stored_id", "user_id"))


def near(left: DataFrame, right: DataFrame, dx: int = 5, dy: int = 1, values: list[str] = ("id",), same: list[str] = ("wid",)) -> DataFrame:
    """Pairs with the same ``same`` columns within +-dx in x and z and +-dy in y: right's cells are looked up in the 3x3 cells round left."""
    cell = lambda c: F.floor(F.col(c) / F.lit(dx)).cast("int")
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = left.withColumn("cx", F.explode(F.transform(around, lambda k: cell("x") + k))).withColumn("cz", F.explode(F.transform(around, lambda k: cell("z") + k)))
    b = right.select(*same, F.col("x").alias("near_x"), F.col("y").alias("near_y"), F.col("z").alias("near_z"), *[F.col(v).alias(f"near_{v}") for v in values], cell("x").alias("cx"), cell("z").alias("cz"))
    close = (F.abs(F.col("x") - F.col("near_x")) <= dx) & (F.abs(F.col("z") - F.col("near_z")) <= dx) & (F.abs(F.col("y") - F.col("near_y")) <= dy)
    return a.join(b, [*same, "cx", "cz"]).where(close).drop("cx", "cz")


def confirmed(proposed: DataFrame, observed: DataFrame, ticks: int, value: str = "type") -> DataFrame:
    """Proposed places which are observed with the same type within ``ticks`` seconds; an interval semi join on the place.

    The time is cut in buckets of that length, so the join has equality keys."""
    o = observed.select(*PLACE, F.col(value).alias("o_value"), F.col("time").alias("o_time"), F.explode(F.array(bucket(F.col("time"), ticks), bucket(F.col("time"), ticks) - 1)).alias("tick"))
    p = proposed.withColumn("tick", bucket(F.col("time"), ticks)).alias("p")
    o = o.alias("o")
    on = reduce(lambda a, c: a & c, [F.col(f"p.{k}") == F.col(f"o.{k}") for k in [*PLACE, "tick"]])
    hit = on & (F.col(f"p.{value}") == F.col("o.o_value")) & F.col("o.o_time").between(F.col("p.time"), F.col("p.time") + ticks)
    return p.join(o, hit, "left_semi").drop("tick")


def latest_of(df: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """The row with the largest id of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), id_col).alias("m")).select(*keys, "m.*")


def side_table(block: DataFrame, side: DataFrame, key: str = "id", value: str = "data") -> DataFrame:
    """Kill rows with the stored entity that their data refers to."""
    s = side.select(F.col(key).alias("side_id"), F.col(value).alias("side_value"))
    ref: Column = F.when((F.col("action") == 3) & (F.col("type") != 0), F.col("data"))
    return block.where(F.col("action") == 3).join(s, ref == F.col("side_id"), "left").drop("side_id")

"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Both inputs are aggregated by the join key before they meet. What joins is one compact state a key (row
count, sums, non-null counts), so a key with a third of all rows costs one row in the join. Counts and sums of
the joined rows follow algebraically: a key with l rows left and r rows right has l*r joined rows, and a left
value counts r times in the joined sum.

Cases: null keys join nothing (SQL equality); with how="left" their left rows come back under a null key.
Null values count in rows but not in sums; a sum over no value is null. Empty tables give an empty result.
Repeated rows count as rows; pass inputs through frames.once() where copies are re-deliveries. Columns besides
the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, key: str, sums: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One compact state for each key: {prefix}n, and for each of ``sums`` its {prefix}sum_x. Combines map-side."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}n")] + [F.sum(c).alias(f"{prefix}sum_{c}") for c in sums or []]
    return df.groupBy(F.col(key).alias("key_value")).agg(*aggs)


def eager_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_sums: list[str] | None = None,
    right_sums: list[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Aggregates of the equi-join of left and right for each key, without joining their rows.

    Gives key_value, left_n, right_n, pairs (rows the join would have), joined_sum_x for each summed column
    (its sum over the joined rows) and left_sum_x / right_sum_x (its sum over its own input).
    ``how``: inner or left; in a left join a key without partner has right_n 0 and its rows once.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    a = key_states(left, left_key, left_sums, "left_")
    b = key_states(right, right_key, right_sums, "right_")
    return join_states(a, b, ["key_value"], left_sums, right_sums, how)


def join_states(a: DataFrame, b: DataFrame, keys: list[str], left_sums: list[str] | None = None, right_sums: list[str] | None = None, how: str = "inner") -> DataFrame:
    """eager_join of inputs that are compact states already: left_n, left_sum_x and right_n, right_sum_x a key."""
    known = lambda d: reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    b = b.where(known(b))
    j = a.join(b, keys, how) if how == "left" else a.where(known(a)).join(b, keys)
    times = F.coalesce(F.col("right_n"), F.lit(1 if how == "left" else 0))
    out = [
        *[F.col(k) for k in keys],
        F.col("left_n"),
        F.coalesce("right_n", F.lit(0)).cast("long").alias("right_n"),
        (F.col("left_n") * times).alias("pairs"),
    ]
    for c in left_sums or []:
        out += [F.col(f"left_sum_{c}"), (F.col(f"left_sum_{c}") * times).alias(f"joined_sum_{c}")]
    for c in right_sums or []:
        out += [F.col(f"right_sum_{c}"), (F.col(f"right_sum_{c}") * F.col("left_n")).alias(f"joined_sum_{c}")]
    return j.select(*out)


def roll_up(states: DataFrame, groups: list[str]) -> DataFrame:
    """Adds up compact states over coarser groups: every numeric state column is summed."""
    numeric = [f.name for f in states.schema if f.name not in groups and f.name != "key_value" and f.dataType.typeName() in ("long", "integer", "double", "decimal")]
    return states.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in numeric])


def key_shares(entries: DataFrame, keys: dict[str, DataFrame], dim_key: str = "id", id_col: str = "id") -> DataFrame:
    """Count and share of the entries for each value of each key column, next to its dimension row count.

    ``keys`` maps a key column to its dimension. Entries are netted by id and aggregated at once to
    the distinct combinations of all key columns (the finest compact state), which roll up to a state for each key.
    Dimensions become one state a key as well. The states meet in a left join, whose row counts follow by multiplying
    them; every dimension row of a key joins all of its entries, so the joined count over the dimension's gives the
    key's entries, however many rows the dimension has for it. Joined states roll up to the total of each field.
    Gives key_field, key_value, n, known (dimension rows), total; a null key value is kept as a row of its own, so that
    the n of a field add up to the total.
    """
    names = list(keys)
    kinds = {entries.schema[k].dataType.simpleString() for k in names}
    if len(kinds) != 1:
        raise ValueError("the key columns must be of one type")
    kind = kinds.pop()
    once = entries.select(F.col(id_col).alias("entry"), *names).groupBy("entry", *names).agg(F.lit(1).alias("one"))
    fine = once.groupBy(*names).agg(F.count(F.lit(1)).alias("left_n"))
    by = ["key_field", "key_value"]
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("key_field"), F.col(k).alias("key_value")) for k in names]))
    left = roll_up(fine.select(parts.alias("k"), "left_n").select("k.*", "left_n"), by)
    right = reduce(DataFrame.unionByName, [key_states(d, dim_key, prefix="right_").select(F.lit(k).alias("key_field"), F.col("key_value").cast(kind).alias("key_value"), "right_n") for k, d in keys.items()])
    joined = join_states(left, right, by, how="left")
    states = joined.select(*by, (F.col("pairs") / F.greatest(F.col("right_n"), F.lit(1))).cast("long").alias("n"), F.col("right_n").alias("known"))
    total = states.groupBy("key_field").agg(F.sum("n").alias("total"))
    return states.join(total, "key_field").select(*by, "n", "known", "total")


def heavy_keys(shares: DataFrame, at_least: float = 0.03) -> DataFrame:
    """The non-null keys which hold at least that share of all entries; a share that is met exactly counts."""
    return shares.where(F.col("key_value").isNotNull() & (F.col("n") / F.col("total") >= at_least)).select("key_field", "key_value")

"""Per-entity feature table from events, maintained with signed deltas.

A delta is an event with a sign: +1 inserts it, -1 retracts it (an over-delivery, a purge, or the old version of
an updated row). Counts and totals are additive, so a batch of deltas folds into one small state per (entity,
action, type) and is added to the kept state. Only the time of the last event isn't additive: inserts raise it;
a retraction that takes an entry away can lower it only where it was the last one, and just these keys are recomputed
from the events. A retraction of an over-delivery leaves the entry, and lowers nothing.

Cases: null entities have no row; null action or type is a key of its own; null times never become the last time
(it is null where all are); null rolled_back counts as not rolled back; a key whose count falls to zero leaves the
state. Empty inputs give empty results; ties in time are one time; columns besides the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["entity", "action", "type"]


def events_of(log: DataFrame, entity: str = "user_id") -> DataFrame:
    """The columns that features are made of, under their own names: id, entity, action, type, time, rolled."""
    return log.where(F.col(entity).isNotNull()).select(
        "id",
        F.col(entity).alias("entity"),
        "action",
        "type",
        "time",
        F.when(F.col("rolled_back") != 0, 1).otherwise(0).alias("rolled"),
    )


def signed(log: DataFrame, entity: str = "user_id") -> DataFrame:
    """Deltas of a log with re-deliveries: an entry delivered k times is inserted k times and retracted k - 1 times.

    The deliveries of an entry meet by entry, never by entity, so a hot entity is spread over all tasks; its inserts and
    its retractions are a row each, with their number as ``sign``. ``gone`` tells whether a retraction takes the entry away.
    """
    e = events_of(log, entity)
    k = e.groupBy(*e.columns).agg(F.count(F.lit(1)).alias("k"))
    rows = F.array(F.struct(F.col("k").alias("sign"), F.lit(False).alias("gone")), F.when(F.col("k") > 1, F.struct((1 - F.col("k")).alias("sign"), F.lit(False).alias("gone"))))
    return k.withColumn("d", F.explode(F.array_compact(rows))).select(*e.columns, "d.sign", "d.gone")


def fold(deltas: DataFrame) -> DataFrame:
    """State of signed deltas by key: n, n_rolled, the latest inserted time and the latest one of an entry that is gone."""
    gone = (F.col("sign") < 0) & (F.col("gone") if "gone" in deltas.columns else F.lit(True))
    return deltas.groupBy(*KEYS).agg(
        F.sum("sign").alias("n"),
        F.sum(F.col("sign") * F.col("rolled")).alias("n_rolled"),
        F.max(F.when(F.col("sign") > 0, F.col("time"))).alias("last_time"),
        F.max(F.when(gone, F.col("time"))).alias("retracted_time"),
    )


def state_of(log: DataFrame, entity: str = "user_id") -> DataFrame:
    """The state of a whole log: entity, action, type, n, n_rolled, last_time."""
    return fold(signed(log, entity)).where(F.col("n") > 0).select(*KEYS, "n", "n_rolled", "last_time")


def maintained(log: DataFrame, clock: int, entity: str = "user_id") -> DataFrame:
    """The state of a log, kept at a clock and brought up to date: entries with an earlier time make the kept state,
    the deltas of all others (those without a time too) are applied to it."""
    early = F.coalesce(F.col("time") < clock, F.lit(False))
    deltas = signed(log, entity)
    kept = fold(deltas.where(early)).where(F.col("n") > 0).select(*KEYS, "n", "n_rolled", "last_time")
    return apply_deltas(kept, deltas.where(~early), None)


def apply_deltas(state: DataFrame, deltas: DataFrame, events: DataFrame | None) -> DataFrame:
    """The state after signed deltas (entity, action, type, time, rolled, sign).

    ``events`` are the events as they are after the deltas (same columns, sign not needed). It is read for the keys
    whose latest event was retracted only; all other keys are pure additions. None where no delta takes an entry away.
    """
    d = fold(deltas)
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"d.{k}")) for k in KEYS]
    both = state.alias("s").join(d.alias("d"), same, "full_outer").select(
        *[F.coalesce(f"s.{k}", f"d.{k}").alias(k) for k in KEYS],
        (F.coalesce("s.n", F.lit(0)) + F.coalesce("d.n", F.lit(0))).alias("n"),
        (F.coalesce("s.n_rolled", F.lit(0)) + F.coalesce("d.n_rolled", F.lit(0))).alias("n_rolled"),
        F.greatest("s.last_time", "d.last_time").alias("raised"),
        F.col("d.retracted_time").alias("retracted_time"),
    ).where(F.col("n") > 0)
    if events is None:
        return both.select(*KEYS, "n", "n_rolled", F.col("raised").alias("last_time"))
    hit = F.coalesce(F.col("retracted_time") >= F.col("raised"), F.lit(False))
    touched = both.where(hit).select(*KEYS)
    fresh = (
        events.alias("e")
        .join(touched.alias("t"), [F.col(f"e.{k}").eqNullSafe(F.col(f"t.{k}")) for k in KEYS], "left_semi")
        .groupBy(*KEYS)
        .agg(F.max("time").alias("fresh_time"))
    )
    return (
        both.alias("b")
        .join(fresh.alias("f"), [F.col(f"b.{k}").eqNullSafe(F.col(f"f.{k}")) for k in KEYS], "left")
        .select(*[F.col(f"b.{k}").alias(k) for k in KEYS], "n", "n_rolled", F.when(hit, F.col("fresh_time")).otherwise(F.col("raised")).alias("last_time"))
    )


def entity_table(state: DataFrame, entity: str = "user_id") -> DataFrame:
    """One row for each entity: totals, and ``features`` with one struct for each (action, type), in their order.

    The list of an entity is bounded by the number of event types, not by its events.
    """
    feature = F.struct("action", "type", "n", "last_time", "n_rolled")
    return state.groupBy(F.col("entity").alias(entity)).agg(
        F.sum("n").alias("n"),
        F.sum("n_rolled").alias("n_rolled"),
        F.max("last_time").alias("last_time"),
        F.count(F.lit(1)).alias("n_features"),
        F.sort_array(F.collect_list(feature)).alias("features"),
    )

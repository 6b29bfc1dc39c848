"""What the command words do beyond lookups: near, inspect, status, auto purge, and logging through the API."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import revert, typed
from tracewright.plans.spec import Box, LookupSpec, PurgeSpec, parse_time
from tracewright.sources.store import LogStore, append, validated

NEAR_RADIUS = 5
INSPECT_ROWS = 7
#: Fixed value: the family and the actions that each inspector shows.
INSPECTORS = {"block": ("block", (0, 1)), "interaction": ("block", (2,)), "container": ("container", ()), "sign": ("sign", ())}


def near_spec(place: tuple[int, int, int, int], rows: int = INSPECT_ROWS, page: int = 1) -> LookupSpec:
    """All changes within five blocks of a place, in every direction but y."""
    w, x, y, z = place
    return LookupSpec(wid=w, box=Box.around(x, y, z, (NEAR_RADIUS, None, NEAR_RADIUS)), rows=rows, page=page)


def inspect(store: LogStore, kind: str, place: tuple[int, int, int, int], since: int = 0, page: int = 1) -> DataFrame:
    family, actions = INSPECTORS[kind]
    return typed.point_history(store, family, place, since, page, INSPECT_ROWS, actions)


def status(store: LogStore, pending: dict[str, DataFrame] | None = None, purge: PurgeSpec | None = None) -> DataFrame:
    """By family: entries, newest time, rows that wait, and rows that the automatic purge would take."""
    from tracewright.operators import retain

    parts = []
    for f in store.families:
        df = store[f]
        if "time" not in df.columns or f == "user":
            continue
        gone = F.sum(F.when(retain.condition(purge), 1).otherwise(0)) if purge and f in retain.families(purge) else F.lit(0)
        waiting = (pending or {}).get(f)
        n_waiting = F.lit(0) if waiting is None else F.coalesce(waiting.agg(F.count(F.lit(1))).scalar(), F.lit(0))
        columns = ["id", "time", *(c for c in ("wid", "type") if c in df.columns)]
        parts.append(store.once(df.select(*columns), f).agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("newest"), F.coalesce(gone, F.lit(0)).cast("long").alias("purgeable")).select(F.lit(f).alias("family"), "n", "newest", n_waiting.cast("long").alias("pending"), "purgeable"))
    return reduce(DataFrame.unionByName, parts)


def auto_purge(text: str, now: int) -> PurgeSpec | None:
    """The purge of a setting such as 60d or 6mo; None where it is empty, off or zero. The documented minimum of 30 days holds."""
    if not text or text.strip().lower() in ("0", "off", "false", "none"):
        return None
    older, _ = parse_time(text)
    return PurgeSpec(0, now - max(older, 30 * 86_400))


def log_rows(df: DataFrame, family: str, action: int | None = None) -> DataFrame:
    """Rows of the API's log functions: placements (1), removals (0) and interactions (2) get their action, all are validated."""
    return validated(df if action is None else df.withColumn("action", F.lit(action)), family)


def log(df: DataFrame, folder: str, family: str, action: int | None = None) -> None:
    append(log_rows(df, family, action), folder, family)


def rollback(store: LogStore, spec: LookupSpec, preview: bool = False) -> dict[str, DataFrame]:
    return revert.run(store, revert.RevertPlan(spec, preview=preview))


def restore(store: LogStore, spec: LookupSpec, preview: bool = False) -> dict[str, DataFrame]:
    return revert.run(store, revert.RevertPlan(spec, restore=True, preview=preview))


def perform_purge(store: LogStore, seconds: int, now: int, folder: str) -> PurgeSpec:
    """Purges what is older than that many seconds, as a console does (at least a day); writes the rest to ``folder``."""
    from tracewright.operators import retain
    from tracewright.plans.spec import parse_purge

    spec = parse_purge(f"t:{seconds}s", now, console=True)
    retain.purge(store, spec, folder)
    return spec

"""Streams, run to the end of their data, give what the batch forms give."""

import time

import numpy as np
from pyspark.sql import functions as F

from tracewright.plans import registry
from tracewright.sources import fixtures
from tracewright.streaming import suppress
from tracewright.streaming.drain import LATE, drain, drain_closed, use_rocksdb


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_item_totals_cover_the_whole_log(spark, sf):
    log = fixtures.view(spark, sf, "item")
    got = registry.QUERIES["stream_item_totals"](spark, sf)
    assert rows(got.select("action", "amount")) == rows(log.groupBy("action").agg(F.sum("amount")))
    whole = suppress.item_bursts(log, "12 hours").groupBy("action").agg(F.count(F.lit(1)), F.sum("amount"))
    assert rows(got.select("action", "bursts", "amount")) == rows(whole)


def test_bursts_over_micro_batches_in_any_order(spark, sf, tmp_path):
    log = fixtures.view(spark, sf, "item").where("id % 25 = 1").orderBy("id").limit(600)
    for k in range(3):
        log.where(F.col("id") % 3 == k).orderBy(F.desc("time")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain_closed(s, lambda x: suppress.item_bursts(x, "12 hours", LATE))
    assert rows(got) == rows(suppress.item_bursts(log, "12 hours"))


def test_breaks_reset_the_change_filter(spark, tmp_path):
    # placed, placed again (dropped), broken, placed again (a later file), again (dropped); another place: only broken
    first = [(1, 10, 1, 0, 60, 0, 5, 1), (2, 20, 1, 0, 60, 0, 5, 1), (3, 30, 1, 0, 60, 0, 5, 0), (6, 30, 1, 9, 60, 0, 5, 0)]
    later = [(4, 40, 1, 0, 60, 0, 5, 1), (5, 50, 1, 0, 60, 0, 5, 1)]
    schema = "id long, time long, wid int, x int, y int, z int, type int, action int"
    kept = []
    for k, part in enumerate((first, later, first + later)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / ("two" if k < 2 else "one")))
    for folder in ("two", "one"):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder))
        got = drain(suppress.changes_only(s, ["wid", "x", "y", "z"], ttl=90, reset=("action", 0), expire=False))
        kept.append(rows(got.select("id")))
    assert kept == [[(1,), (4,)]] * 2


def test_streamed_filter_is_the_batch_filter(spark, sf):
    assert rows(registry.QUERIES["stream_suppress_unchanged_reset"](spark, sf)) == rows(registry.QUERIES["suppress_unchanged"](spark, sf))


def test_state_machines_replay_in_any_batches():
    rng = np.random.default_rng(3)
    when = np.cumsum(rng.integers(0, 8, 300))
    value, reset = rng.integers(0, 2, 300), rng.random(300) < 0.1
    for machine in (suppress.Repeats(3, 5), suppress.Changes(6)):
        none = np.zeros(300, bool) if isinstance(machine, suppress.Repeats) else reset
        whole = machine.run(None, when, value, none)[1]
        state, parts = None, []
        for a in range(0, 300, 7):
            state, keep = machine.run(state, when[a : a + 7], value[a : a + 7], none[a : a + 7])
            parts.append(keep)
        assert (np.concatenate(parts) == whole).all() and 0 < whole.sum() < 300
    n, last, want = 0, None, []
    for t in when:
        n = n + 1 if last is not None and t - last <= 5 else 1
        last = t
        want.append(n <= 3)
    assert (suppress.Repeats(3, 5).run(None, when, None, np.zeros(300, bool))[1] == want).all()


def test_live_state_expires(spark, tmp_path):
    """With expiry the query keeps running; what it passes is the same."""
    spark.createDataFrame([(k, 10 * k, 1) for k in range(6)], "id long, time long, wid int").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id long, time long, wid int").parquet(str(tmp_path / "in"))
    use_rocksdb(spark)
    q = suppress.suppress_repeats(s, ["wid"], 2, 30).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for _ in range(60):
            time.sleep(1)
            if (tmp_path / "out").exists() and list((tmp_path / "out").glob("*.parquet")) and rows(spark.read.schema("id long, time long, wid int").parquet(str(tmp_path / "out")).select("id")):
                break
    finally:
        q.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id")) == [(0,), (1,)]

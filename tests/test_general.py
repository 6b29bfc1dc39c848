"""Problems 4 to 7 on small frames: skew, nulls, ties, repeats, empty tables, clashing names."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.operators import features, history, sessions, skew

LOG = "id long, user_id int, wid int, action int, type int, time long, rolled_back int, entry int, n long"


def log(spark, rows):
    return spark.createDataFrame([(*r, 9, 9) for r in rows], LOG)


def test_eager_join_equals_join(spark):
    r = random.Random(1)
    a = [(r.choice([1, 1, 1, 1, 2, 3, None]), r.choice([None, 1, 5])) for _ in range(300)]
    b = [(r.choice([1, 1, 2, 4, None]), r.choice([None, 2, 7])) for _ in range(200)]
    left, right = spark.createDataFrame(a, "k int, v int"), spark.createDataFrame(b, "k int, w int")
    got = {x.key_value: (x.pairs, x.joined_sum_v, x.joined_sum_w) for x in skew.eager_join(left, right, "k", "k", ["v"], ["w"]).collect()}
    want = {x.k: (x.n, x.v, x.w) for x in left.join(right, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w")).collect()}
    assert got == want
    kept = {x.key_value: (x.pairs, x.joined_sum_v) for x in skew.eager_join(left, right, "k", "k", ["v"], ["w"], how="left").collect()}
    want = {x.k: (x.n, x.v) for x in left.join(right, "k", "left").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")).collect()}
    assert kept == want
    with pytest.raises(ValueError):
        skew.eager_join(left, right, "k", "k", how="full")


def test_roll_up(spark):
    s = spark.createDataFrame([(1, "a", 2, 3), (2, "a", 5, None), (3, None, 1, 1)], "key_value int, g string, n long, s long")
    assert sorted(tuple(r) for r in skew.roll_up(s, ["g"]).collect() if r.g) == [("a", 7, 3)]


def test_heavy_keys_count_entries_once(spark):
    rows = [(k, 1 if k < 40 else 100 + k, 1, 0, 1, k, 0) for k in range(100)]
    df = log(spark, rows + rows[:60] + [(1000, None, None, 0, 1, 1, 0)])
    dims = {"user_id": spark.createDataFrame([(1, "x"), (1, "y")], "id int, name string"), "wid": spark.createDataFrame([], "id int, name string")}
    shares = skew.key_shares(df, dims)
    assert {tuple(r) for r in skew.heavy_keys(shares).collect()} == {("user_id", 1), ("wid", 1)}
    assert {r.n for r in shares.where("key_field = 'user_id' and key_value = 1").collect()} == {40}
    assert shares.where("key_value is null").count() == 2 and {r.total for r in shares.select("total").collect()} == {101}
    assert skew.heavy_keys(skew.key_shares(df.where("false"), dims)).count() == 0
    exact = log(spark, [(k, 1 if k < 3 else 10 + k, None, 0, 1, k, 0) for k in range(100)])
    assert {tuple(r) for r in skew.heavy_keys(skew.key_shares(exact, dims)).collect()} == {("user_id", 1)}
    with pytest.raises(ValueError):
        skew.key_shares(df, {"user_id": dims["user_id"], "time": dims["wid"]})


def test_features_are_maintained(spark):
    r = random.Random(2)
    rows = [(k, r.choice([1, 1, 1, 2, None]), 1, r.choice([0, 1, None]), r.choice([1, 2]), r.choice([None, *range(20)]), r.choice([0, 1, None, 3])) for k in range(400)]
    df = log(spark, rows + rows[:50])
    whole = features.state_of(df)
    plain = {}
    for _, u, _, a, t, time, rb in rows:
        if u is not None:
            n, k, last = plain.get((u, a, t), (0, 0, None))
            plain[u, a, t] = (n + 1, k + (rb not in (None, 0)), time if last is None else last if time is None else max(last, time))
    assert {tuple(x[:3]): tuple(x[3:]) for x in whole.collect()} == plain
    gone = F.coalesce(F.col("time") >= 12, F.lit(False))
    once = log(spark, rows)
    deltas = features.events_of(once.where(gone)).withColumn("sign", F.lit(-1))
    after = features.apply_deltas(whole, deltas, features.events_of(once.where(~gone)))
    assert sorted(map(repr, after.collect())) == sorted(map(repr, features.state_of(once.where(~gone)).select(after.columns).collect()))
    back = features.events_of(once.where(gone)).withColumn("sign", F.lit(1))
    again = features.apply_deltas(after, back, features.events_of(once))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, whole.collect()))
    table = features.entity_table(whole)
    assert table.count() == 2 and table.agg(F.sum("n")).collect()[0][0] == sum(r[1] is not None for r in rows)
    assert features.entity_table(features.state_of(df.where("false"))).count() == 0


def test_canonical_names(spark):
    df = spark.createDataFrame([("84FCDD8BA8E640DAADDCB9D29414B929", "  Ann\t"), ("84fcdd8b-a8e6-40da-addc-b9d29414b929", "ann"), ("odd", "")], "uuid string, name string")
    got = df.select(history.canonical_uuid(F.col("uuid")), history.canonical_name(F.col("name"))).collect()
    assert [tuple(x) for x in got] == [("84fcdd8b-a8e6-40da-addc-b9d29414b929", "ann")] * 2 + [("odd", "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_equal_replay(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice([None, *range(0, 400_000, 7000)]), r.choice(["u", "v", None]), r.choice(["a", "b", "c", "", " ", None]), 1) for k in range(250)]
    df = spark.createDataFrame(rows + rows[:80], "id long, time long, uuid string, name string, b int")
    want = []
    for u in "uv":
        versions = []
        for _, t, _, n, _ in sorted((x for x in rows if x[2] == u and x[1] is not None and (x[3] or "").strip()), key=lambda x: (x[1], x[0])):
            if not versions or versions[-1][1] != n:
                versions.append((u, n, t))
        want += [(*v, versions[k + 1][2] if k + 1 < len(versions) else None) for k, v in enumerate(versions)]
    for size in (3600, 86_400, 10**7):
        got = [tuple(x) for x in history.username_versions(df, size).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert history.username_versions(df.where("false")).count() == 0


def plain_sessions(events, gap):
    out = []
    by = {}
    for u, t in events:
        by.setdefault(u, []).append(t)
    for u, ts in by.items():
        run = []
        for t in sorted(ts):
            if run and t - run[-1] > gap:
                out.append((u, run[0], run[-1], run[-1] - run[0], len(run)))
                run = []
            run.append(t)
        out.append((u, run[0], run[-1], run[-1] - run[0], len(run)))
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4095), min_size=1, max_size=40), st.integers(1, 2500))
def test_closing_of_one_chunk(offsets, gap):
    offsets = np.array(sorted(offsets))
    _, first, last, n = sessions.close_chunks(np.zeros(len(offsets), np.int64), offsets, 1, gap)
    assert list(zip(first, last, n)) == [(a, b, k) for _, a, b, _, k in plain_sessions([(0, int(t)) for t in offsets], gap)]


@pytest.mark.parametrize("gap", [1, 60, 1800, 5000])
def test_sessions_over_chunks(spark, gap):
    r = random.Random(gap)
    edge = sessions.CHUNK
    times = [r.choice([edge - 1, edge, edge + 1, edge - 1800, edge + 1800, -5, r.randrange(0, 60_000)]) for _ in range(300)]
    rows = [(k, r.choice([1, 1, 1, 2, None]), r.choice([t, t, None]), 5) for k, t in enumerate(times)]
    a = spark.createDataFrame(rows + rows[:40], "id long, user_id int, time long, entity int")
    b = spark.createDataFrame([(k, u, None if t is None else t + 1, 1) for k, u, t, _ in rows[:50]], "id long, user_id int, time long, seg int")
    want = plain_sessions([(u, t) for _, u, t, _ in rows if u and t is not None] + [(u, t + 1) for _, u, t, _ in rows[:50] if u and t is not None], gap)
    assert sorted(tuple(x) for x in sessions.sessions([a, b], gap=gap).collect()) == want
    assert sessions.sessions([a.where("false")], gap=gap).count() == 0
    with pytest.raises(ValueError):
        sessions.sessions([a], gap=0)

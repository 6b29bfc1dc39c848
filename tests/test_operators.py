"""Reference operators on small frames: equivalences, identities and edge cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracewright.frames import before
from tracewright.functions import codes
from tracewright.operators import asof, commands, lookup, migrate, names, payload, retain, revert, suppress, typed
from tracewright.plans.spec import LookupSpec, PurgeSpec, SpecError
from tracewright.schema import SCHEMAS
from tracewright.sources import store as st
from tracewright.sources.fixtures import NOW
from tracewright.sources.listeners import EVENTS
from tracewright.streaming import ingest
from tracewright.streaming.suppress import Changes, Repeats


def test_page_concatenation_is_the_whole(spark, sf):
    s = st.LogStore.given(spark, sf)
    spec = LookupSpec((0,), users=("quarrel_finch",), rows=25)
    whole = [r.id for r in lookup.ordered(lookup.rows(s, spec)).collect()]
    paged, page = [], 1
    while True:
        from dataclasses import replace

        rows = lookup.page(s, replace(spec, page=page)).collect()
        if not rows:
            break
        paged += [r.id for r in sorted(rows, key=lambda r: -r.id)]
        page += 1
    assert paged == whole
    assert lookup.counts(s, spec).collect()[0].n == len(whole)
    state = lookup.pages(s, replace(spec, page=page)).collect()[0]
    assert state.state == "no such page" and state.pages == page - 1


def test_unknown_user(spark, sf):
    s = st.LogStore.given(spark, sf)
    with pytest.raises(SpecError):
        lookup.rows(s, LookupSpec(users=("nobody-of-that-name",)))
    assert typed.block_lookup(s, typed.Options(NOW, user="nobody-of-that-name")).count() == 0
    assert typed.perform_lookup(s, NOW, 100, users=("#global",)) is None
    with pytest.raises(SpecError):
        typed.perform_lookup(s, NOW, 100, include=("entity:1", "ns:stone"))


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_filters_reach_the_scan(spark, sf):
    plan = formatted(lookup.rows(st.LogStore.given(spark, sf), LookupSpec((0,), start=NOW - 1000, wid=1)))
    scan = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert all(f in scan for f in ("GreaterThan(time", "EqualTo(wid,1)", "EqualTo(action,0)"))


def test_page_is_one_top_k(spark, sf):
    plan = formatted(lookup.page(st.LogStore.given(spark, sf), LookupSpec(start=NOW - 86_400)))
    assert "TakeOrderedAndProject" in plan and "Sort (" not in plan.split("TakeOrderedAndProject")[1].split("Union")[0]


def test_empty_store(spark):
    s = st.LogStore(spark)
    assert lookup.rows(s, LookupSpec()).count() == 0
    assert [r.total for r in lookup.pages(s, LookupSpec()).collect()] == [0]
    out = revert.run(s, revert.RevertPlan(LookupSpec()))
    assert all(out[k].count() == 0 for k in ("blocks", "entities", "block_states"))


def test_restore_undoes_rollback(spark, sf):
    s = st.LogStore.sites(spark, sf)
    rows = s["block"]
    there = revert.toggled(rows)
    assert there.where(~revert.is_due(F.col("rolled_back"), True)).count() == 0
    back = revert.toggled(there, restore=True)
    base = {(r.id, r.rolled_back) for r in rows.where("rolled_back & 1 = 0").select("id", "rolled_back").collect()}
    assert {(r.id, r.rolled_back) for r in back.select("id", "rolled_back").collect()} == base
    assert revert.toggled(there).count() == 0  # a second run changes nothing
    plan = revert.RevertPlan(LookupSpec())
    assert plan.undo().undo() == plan and plan.undo().restore and plan.cancel().preview and not plan.cancel().apply().preview


@pytest.mark.parametrize("restore", [False, True])
def test_targets_equal_replay(spark, restore):
    r = random.Random(3)
    rows = [(k, 1, r.randrange(3), 0, 0, r.choice([0, 1]), r.randrange(1, 9), str(k)) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, wid int, x int, y int, z int, action int, type int, blockdata string")
    world = {}
    for _, w, x, y, z, a, t, b in sorted(rows, reverse=not restore):
        empty = a == (0 if restore else 1)
        world[w, x, y, z] = (0, None) if empty else (t, b)
    got = {tuple(x[:4]): (x.target_type, x.target_data) for x in revert.block_targets(df, restore).collect()}
    assert got == world


def _replay_asof(base, t, forward):
    hit = [b for b in base if b[1] is not None and t is not None and (b[1] >= t if forward else b[1] < t)]
    return (min(hit) if forward else max(hit))[0] if hit else None


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_equals_replay(spark, forward):
    r = random.Random(5)
    base = [(k, r.choice([None, *range(0, 50)]) , r.choice([1, 1, 1, 2, None])) for k in range(150)]
    probes = [(1000 + k, r.choice([None, *range(0, 50)]), r.choice([1, 2, 3, None])) for k in range(100)]
    b, p = spark.createDataFrame(base, "id long, time long, k int"), spark.createDataFrame(probes, "id long, time long, k int")
    want = {i: _replay_asof([x for x in base if x[2] == k and k is not None], t, forward) for i, t, k in probes}
    for size in (7, 1000):
        assert {x.id: x.base_id for x in asof.as_of(p, b, ["k"], ["id"], forward, bucket_seconds=size).collect()} == want


def test_repeats_equal_the_state_machine(spark):
    r = random.Random(7)
    rows = [(k, r.randrange(0, 9000), r.choice([1, 2])) for k in range(500)]
    for threshold, window in ((2, 30), (7, 90)):
        df = spark.createDataFrame(rows, "id long, time long, k int")
        got, again = ({x.id for x in suppress.suppress_repeats(df, ["k"], threshold, window, bucket_seconds=b).collect()} for b in (50, 10**6))
        m, want, state = Repeats(threshold, window), set(), {}
        for i, t, k in sorted(rows, key=lambda x: (x[1], x[0])):
            state[k], ok = m.step(state.get(k), t)
            want |= {i} if ok else set()
        assert got == again == want


def test_rows_before(spark):
    r = random.Random(9)
    rows = [(k, r.choice([None, *range(0, 300)]), r.choice([1, 1, 2, None])) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, time long, k int")
    want, last = {}, {}
    for i, t, k in sorted(rows, key=lambda x: (-1 if x[1] is None else x[1], x[0])):
        want[i], last[k] = last.get(k), i
    for size in (7, 10**6):
        assert {x.id: x._before and x._before.id for x in before(df, ["k"], ["id"], seconds=size).collect()} == want


def test_changes_equal_the_state_machine(spark):
    r = random.Random(8)
    rows = [(k, r.randrange(0, 3000), 1, 0, 0, r.choice([0, 1]), r.choice([5, 6])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, time long, wid int, x int, y int, z int, type int")
    m, want, state = Changes(60), set(), {}
    for i, t, w, x, y, z, v in sorted(rows, key=lambda x: (x[1], x[0])):
        state[z], ok = m.step(state.get(z), t, v)
        want |= {i} if ok else set()
    assert {x.id for x in suppress.changes_only(df, ttl=60).collect()} == want


def test_snapshot_diff_adds_up(spark):
    a = spark.createDataFrame([(1, 5, 10), (1, 6, 3), (1, 7, 2)], "c int, type int, amount int")
    b = spark.createDataFrame([(1, 5, 4), (1, 8, 9), (1, 7, 2)], "c int, type int, amount int")
    got = {(x.type, x.action, x.amount) for x in suppress.snapshot_diff(a, b, ["c"], ["type"]).collect()}
    assert got == {(5, 0, 6), (6, 0, 3), (8, 1, 9)}
    one = suppress.signature(a, ["c"]).collect()[0].signature
    split = spark.createDataFrame([(1, 5, 9), (1, 5, 1), (1, 6, 3), (1, 7, 2)], "c int, type int, amount int")
    assert suppress.signature(split, ["c"]).collect()[0].signature == one != suppress.signature(b, ["c"]).collect()[0].signature


def test_payload_policy_and_round_trip(spark):
    df = spark.createDataFrame([(1, "x" * 500), (2, "short"), (3, None), (4, os.urandom(400).hex())], "ref_id long, raw string").withColumn("size", F.octet_length("raw"))
    enc = payload.encoded(df)
    assert {r.ref_id: r.codec for r in enc.collect()} == {1: 1, 2: 0, 3: 0, 4: 1}
    assert {r.ref_id: bytes(r.raw).decode() if r.raw is not None else None for r in payload.decoded(enc).collect()} == {r.ref_id: r.raw for r in df.collect()}
    assert {r.codec for r in payload.encoded(df, enabled=False).collect()} == {0}
    stored = payload.hashed(df.where("ref_id = 1")).select("hash", "size", F.col("raw").cast("binary").alias("data"))
    assert {r.ref_id for r in payload.new_payloads(df, stored).collect()} == {2, 4}
    with pytest.raises(ValueError):
        payload.backfill_counts([("a", df, "raw", "size")], 0)


def test_purge_boundaries(spark):
    df = spark.createDataFrame([(1, 10), (2, 19), (3, 20), (4, None), (5, 9)], "id long, time long")
    kept = {r.id for r in retain.kept(df, "chat", PurgeSpec(10, 20)).collect()}
    assert kept == {3, 4, 5}
    assert retain.families(PurgeSpec(0, 9, None, (1,))) == ["block"]
    assert "skull" not in retain.families(PurgeSpec(0, 9, 1)) and "skull" in retain.families(PurgeSpec(0, 9))
    assert {r.id for r in retain.kept(df, "chat", PurgeSpec(0, 30, None, (1,))).collect()} == {1, 2, 3, 4, 5}


def test_codes(spark):
    df = spark.createDataFrame([(t, a) for t in (0, 1, 2) for a in range(13)], "tbl int, action int")
    got = {(r.tbl, r.action): r.p for r in df.select("tbl", "action", codes.polarity(F.col("tbl"), F.col("action")).alias("p")).collect()}
    assert got[1, 0] == 1 and got[1, 1] == 0 and got[0, 1] == 0 and got[2, 3] == 1 and got[2, 2] == 0
    t = spark.createDataFrame([(NOW,), (NOW + 5,), (NOW - 30,), (NOW - 7200,), (NOW - 172_800,)], "t long").select(codes.time_since(F.col("t"), NOW).alias("a"))
    assert [r.a for r in t.collect()] == ["0.00/m ago", "0.00/m ago", "0.50/m ago", "2.00/h ago", "2.00/d ago"]
    s = spark.createDataFrame([("§x§a§b§c§1§2§3hi",), (None,)], "s string")
    assert [r.c for r in s.select(codes.strip_colours(F.col("s")).alias("c")).collect()] == ["hi", None]
    states = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, None)], "r int")
    assert [tuple(r) for r in states.select(codes.toggle(F.col("r"), False), codes.toggle(F.col("r"), True)).collect()] == [(1, 2), (0, 3), (3, 0), (2, 1), (1, 2)]


def test_blacklist():
    b = st.Blacklist.parse("; all\n Some One \nns:stone ; x\n/help\nns:tnt@Bob\n\n")
    assert b == st.Blacklist(("someone",), ("ns:stone", "/help"), (("ns:tnt", "bob"),))


def test_names(spark):
    d = spark.createDataFrame([(1, "a"), (7, "B")], "id int, name string")
    n = spark.createDataFrame([("A",), ("c",), ("C",), ("b",), (None,), ("",), ("d",)], "name string")
    assert sorted((r.id, r.name) for r in names.assign_ids(n, d).collect()) == [(8, "C"), (9, "d")]
    assert {r.name_key: r.id for r in names.user_lookup(d.union(spark.createDataFrame([(9, "A")], "id int, name string"))).collect()} == {"a": 1, "b": 7}


def test_upserts_of_unknown_and_respelled_uuids(spark):
    a, b, c = (x * 8 + "-" + "-".join([x * 4] * 3) + "-" + x * 12 for x in "abc")
    users = spark.createDataFrame([(1, a, "Ann"), (2, None, "Bob"), (3, None, "#tnt"), (4, b, "Eve"), (5, None, "BOB"), (6, "", "Zed")], "id int, uuid string, name string")
    seen = spark.createDataFrame(
        [(1, 10, a, "Ann"), (2, 20, a.upper(), "Anna"), (3, 10, c.replace("-", ""), "bob"), (4, 30, c, "Bobby"), (5, 5, b, "Eve"), (6, 6, "e" * 32, "nobody"), (7, 7, None, "Zed")],
        "id long, time long, uuid string, name string",
    )
    assert sorted(tuple(r) for r in names.upserted_users(users, seen).collect()) == [(1, a, "Ann", "Anna"), (2, c, "Bob", "Bobby")]
    e = "-".join(["e" * 8, *["e" * 4] * 3, "e" * 12])
    got = names.missing_history(seen.where("id in (1, 3)"), seen.where("uuid is not null")).collect()
    assert sorted(tuple(r) for r in got) == [(a, "Anna", 20), (b, "Eve", 5), (c, "Bobby", 30), (e, "nobody", 6)]


def test_upserts_of_the_given_log(spark, sf):
    s = st.LogStore.given(spark, sf)
    got = names.upserted_users(s["user"], s["username"].where("time is not null"))
    empty = got.join(s["user"].where("uuid is null"), "id").count()
    lower = s["username"].where("uuid is not null and time is not null").select(F.lower("name").alias("k")).distinct()
    assert empty == s["user"].where("uuid is null").join(lower, F.lower("name") == F.col("k"), "left_semi").select("id").distinct().count() > 0
    assert got.count() == got.select("id").distinct().count()


def test_migrations_run_in_order(spark):
    order = []
    steps = {(2, 0, 0): lambda t: (order.append(2), t)[1], (1, 5, 0): lambda t: (order.append(1), t)[1], (3, 0, 0): lambda t: (order.append(3), t)[1]}
    _, at = migrate.apply({}, (1, 5, 0), steps)
    assert order == [2, 3] and at == (3, 0, 0)
    rows = spark.createDataFrame([("A",), ("b",)], "kind string")
    new, grown = migrate.to_dictionary(rows, "kind", spark.createDataFrame([(4, "a")], "id int, name string"))
    assert sorted(r.type for r in new.collect()) == [4, 5] and grown.count() == 2
    c = migrate.canonical_names(spark.createDataFrame([(1, "Stone"), (2, "mod:X")], "id int, name string"))
    assert [r.name for r in c.collect()] == ["ns:stone", "mod:x"]


def test_store_round_trip_and_stream(spark, sf, tmp_path):
    folder, src = str(tmp_path / "store"), str(tmp_path / "in")
    chat = spark.read.parquet(f"{sf}/log_chat.parquet").where("message is not null")
    st.ingest(chat, folder, "chat", hooks=(lambda d: d.where("user_id is not null"),))
    s = st.LogStore.open(spark, folder)
    want = chat.where("user_id is not null and not startswith(message, '/')").count()
    assert s["chat"].count() == want and s["block"].count() == 0
    assert s["chat"].where((F.col("time") > NOW - 86_400) & st.day_predicate(NOW - 86_400, 0)).count() == s["chat"].where(F.col("time") > NOW - 86_400).count()
    chat.select([f.name for f in SCHEMAS["chat"]]).write.parquet(src)
    out = str(tmp_path / "stream")
    for _ in range(2):  # nothing is taken twice
        ingest.start(ingest.events(spark, src, "chat"), out, "chat", str(tmp_path / "cp"), once=True).awaitTermination()
    assert st.LogStore.open(spark, out)["chat"].count() == chat.where("not startswith(message, '/')").count()


def test_versions_are_noted(spark, tmp_path):
    assert st.version(spark, str(tmp_path)) == (0, 0, 0)
    st.set_version(spark, str(tmp_path), (2, 24, 0))
    assert st.version(spark, str(tmp_path)) == (2, 24, 0)


def test_compacted_stores_need_no_check(spark, sf, tmp_path):
    chat = spark.read.parquet(f"{sf}/log_chat.parquet")
    retain.compact(chat, str(tmp_path), "chat")
    s = st.LogStore.open(spark, str(tmp_path), compacted=True)
    rows = lookup.rows(s, LookupSpec((6,)))
    assert "Exchange" not in formatted(rows) and rows.count() == chat.select("id").distinct().count()


def test_purge_writes_the_complement(spark, sf, tmp_path):
    s = st.LogStore(spark, {"chat": spark.read.parquet(f"{sf}/log_chat.parquet")})
    spec = PurgeSpec(0, NOW - 7 * 86_400)
    retain.purge(s, spec, str(tmp_path))
    assert st.LogStore.open(spark, str(tmp_path))["chat"].count() == s["chat"].where(~retain.condition(spec)).count()


def test_package_is_shipped_once(spark):
    from tracewright.session import ship_package

    ship_package(spark)
    ship_package(spark)
    assert sum(f.endswith("tracewright.zip") for f in spark.sparkContext.listFiles) == 1


def test_automatic_purge():
    assert commands.auto_purge("off", NOW) is None and commands.auto_purge("", NOW) is None
    assert commands.auto_purge("6mo", NOW).end == NOW - 15_552_000
    assert commands.auto_purge("10d", NOW).end == NOW - 30 * 86_400


def test_every_listener_names_a_family():
    assert {f for f, _, _ in EVENTS.values()} <= set(SCHEMAS) and len(EVENTS) >= 50


def test_lookups_of_a_written_store_open_the_days_of_their_window(spark, tmp_path):
    rows = [(k, 86_400 * k + 5, 1, 1, k, 60, k, 0, 5, 0, 0, None, None) for k in range(1, 6)]
    st.append(spark.createDataFrame(rows, "id long, time long, user_id int, wid int, x int, y int, z int, action int, type int, data int, rolled_back int, blockdata string, meta_payload_id long"), str(tmp_path), "block")
    df = lookup.rows(st.LogStore.open(spark, str(tmp_path)), LookupSpec((0,), start=86_400 * 3, end=86_400 * 4, wid=1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "day#" in filters and "wid#" in filters
    assert [r.id for r in df.collect()] == [3]

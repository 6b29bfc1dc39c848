"""Runs against replay, segmentation against all segmentations."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import runs


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_edits(a, b):
    assert runs.edits(a, b) == min(levenshtein(a, b), 3)


def test_edits_of_very_long_texts():
    a = "x" * 500_000
    assert runs.edits(a + "q" + a, a + a) == 1
    assert runs.edits(a + "qqq" + a, a + a) == 3


@pytest.mark.parametrize("seed", range(20))
def test_segmentation_is_optimal(seed):
    r = random.Random(seed)
    links = [r.choice([0.0, 0.25, 0.5, 0.9, 1.5, np.inf]) for _ in range(7)]

    def cost(starts):
        cuts = set(starts)
        return len(starts) * runs.PENALTY + sum(c for k, c in enumerate(links) if k + 1 not in cuts)

    best = min(cost((0, *c)) for n in range(8) for c in itertools.combinations(range(1, 8), n))
    assert cost(runs.segment(links)) == pytest.approx(best)


def test_fold():
    assert runs.fold("  Cooool HAT!! (3) ​:)") == ("colhat", 7)
    assert runs.fold("123 !?") == ("", 0)
    assert runs.fold("h o r s e")[0] == "horse"


def near(a, b, most=2):
    """The rule of the problem, stated by itself."""
    return a[0] == b[0] or (max(a[1], b[1]) >= 12 and levenshtein(a[0], b[0]) <= most)


def replay(rows, gap=600, near=near):
    out, run, prev = set(), [], None

    def flush():
        if len(run) > 1:
            out.update((min(run), x) for x in run if x != min(run))

    for u, t, i, m in sorted({(u, t, i, m) for i, t, u, m in rows if None not in (i, t, u, m)}):
        f = runs.fold(m)
        if prev and prev[0] == u and t - prev[1] <= gap and near(prev[2], f):
            run.append(i)
        else:
            flush()
            run = [i]
        prev = (u, t, f)
    flush()
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_found_equals_replay(spark, seed):
    r = random.Random(seed)
    texts = ["hello there everyone", "Hello  there, everyone!!", "hello thre everyone", "helo thre evryone", "ok", "oK", "no", "", "!!", "hellooo there everyone 12", None]
    rows, t = [], 1_000
    for k in range(600):
        t += r.choice([0, 1, 300, 600, 601, 2000])
        rows.append((k, r.choice([t, t, t, None]), r.choice([7, 7, 7, 8, None]), r.choice(texts)))
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "z") for x in rows + rows[:100]], "id long, time long, user_id int, message string, b int, u string")
    want = replay(rows)
    assert want
    for size in (700, 3600, 10**7):
        got = {(x.run_id, x.id) for x in runs.run_members(df, bucket_seconds=size).collect() if x.id != x.run_id}
        assert got == want
    whole = runs.collapse_runs(df).collect()
    assert sum(x.n for x in whole) == len([x for x in rows if None not in x])
    by = {x.run_id: x.n for x in whole if x.n > 1}
    assert sum(n - 1 for n in by.values()) == len(want)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, time long, user_id int, message string")
    assert runs.run_members(df).count() == 0 and runs.collapse_runs(df).count() == 0


def test_a_run_over_many_buckets(spark):
    df = spark.createDataFrame([(100 - k, k * 500, 1, "the same words again") for k in range(60)], "id long, time long, user_id int, message string")
    (row,) = runs.collapse_runs(df).collect()
    assert (row.run_id, row.first_time, row.n, row.duration) == (41, 0, 60, 59 * 500)


def test_the_program_cuts_where_the_rule_would_join(spark):
    """With a smaller penalty two mistyped characters cost more than another run, one costs less; also over bucket edges."""
    texts = ["good morning everyone", "good mornin everyone", "good mornin evryne", "good mornin evryne", "god mornin evryne"]
    for step in (10, 550):
        df = spark.createDataFrame([(k, 1000 + k * step, 1, m) for k, m in enumerate(texts)], "id long, time long, user_id int, message string")
        for size in (700, 10**6):
            assert [r.n for r in runs.collapse_runs(df, bucket_seconds=size).collect()] == [5]
            assert sorted(r.n for r in runs.collapse_runs(df, bucket_seconds=size, penalty=0.4).collect()) == [2, 3]


@pytest.mark.parametrize("seed", [4, 5])
@pytest.mark.parametrize("penalty, most", [(1.0, 2), (0.4, 1), (0.1, 0)])
def test_penalties_equal_replay(spark, seed, penalty, most):
    r = random.Random(seed)
    texts = ["hello there everyone", "hello there everyon", "helo thre everyone", "hello there evryne", "ok"]
    rows, t = [], 0
    for k in range(400):
        t += r.choice([0, 1, 300, 600, 601])
        rows.append((k, t, r.choice([7, 8]), r.choice(texts)))
    df = spark.createDataFrame(rows, "id long, time long, user_id int, message string")
    got = {(x.run_id, x.id) for x in runs.run_members(df, penalty=penalty).collect() if x.id != x.run_id}
    assert got == replay(rows, near=lambda a, b: near(a, b, most))

"""Suffix arrays against sorting, shares against counting grams."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import repetition


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_suffix_array(x):
    order, common = repetition.suffix_array(np.array(x))
    assert list(order) == sorted(range(len(x)), key=lambda i: x[i:])
    for k in range(1, len(x)):
        a, b = x[order[k - 1] :], x[order[k] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert common[k] == n


def brute(text):
    words, least = repetition.units(text)
    seen, hit = set(), [False] * len(words)
    for i in range(len(words) - least + 1):
        g = tuple(words[i : i + least])
        if g in seen:
            hit[i : i + least] = [True] * least
        seen.add(g)
    longest = max((n for i in range(len(words)) for j in range(i) for n in [next((k for k in range(len(words) - i) if words[i + k] != words[j + k]), len(words) - i)] if n >= least), default=0)
    return sum(len(w) for w, h in zip(words, hit) if h), sum(map(len, words)), longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab !", max_size=60), min_size=1, max_size=6))
def test_shares_equal_counting(texts):
    got = repetition.measure(texts)
    for k, t in enumerate(texts):
        assert (got[0][k], got[1][k], got[2][k]) == brute(t)


def test_japanese_goes_by_characters():
    assert repetition.units("とても良い商品です")[1] == repetition.MIN_CHARS
    r, t, _ = repetition.measure(["とても良い商品です。とても良い商品です!"])
    assert r[0] == 9 and t[0] == 18


def test_documents(spark):
    rows = [(1, "buy it now " * 5), (2, None), (3, ""), (4, " \n "), (5, "every word here is new"), (6, "A b c. x y z, A-B-C!"), (7, "spam and eggs " * 60_000), (1, "buy it now " * 5)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, share double")
    got = {r.doc_id: (r.share, r.total) for r in repetition.repetition(df).collect()}
    assert got[1] == (0.8, 40) and got[2] == got[3] == got[4] == (0.0, 0) and got[5][0] == 0 and got[6] == (pytest.approx(1 / 3), 9)
    assert got[7][0] > 0.99
    assert sorted(r.doc_id for r in repetition.repetitive(df).collect()) == [1, 1, 6, 7]
    assert repetition.repetitive(df.where("false")).count() == 0


def test_longest_repeat_is_a_second_limit(spark):
    other = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, "one two three four five " + other + " one two three four five"), (2, other), (3, "la la la la la la")], "doc_id long, text string")
    ids = lambda d: {r.doc_id for r in d.collect()}
    assert ids(repetition.repetitive(df)) == {3}
    assert ids(repetition.repetitive(df, longest=5)) == {1, 3}

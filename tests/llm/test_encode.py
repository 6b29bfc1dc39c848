"""Prefix tables against an independent encoder; appends and edits against encoding anew."""

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import encode


@pytest.fixture(scope="module")
def both():
    v = encode.vocabulary()
    return v, tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(text=st.text("abcdehist 'é漢0129", max_size=40))
def test_dense_text(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_documents(both, spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in encode.encode(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == {k: both[1].encode_ordinary(t) if t else [] for k, t in rows.items()}


def test_edge_texts(spark, both):
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|>"), (5, "a" * 100_000), (5, "a" * 100_000), (6, "é​퟿")]
    df = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, ids array<int>")
    out = encode.encode(df)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got == {k: both[1].encode_ordinary(t) if t else [] for k, t in rows} and out.count() == len(rows)
    assert encode.encode(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_appends_and_edits(both, seed):
    r = random.Random(seed)
    pick = lambda n: "".join(r.choice("the and ing est ab") for _ in range(n)).encode()
    t = encode.PrefixTable(both[0], pick(30))
    t.append(pick(10))
    assert t.tokens() == encode.PrefixTable(both[0], t.data).tokens()
    for _ in range(5):
        a = r.randint(0, len(t.data))
        t.replace(a, r.randint(a, len(t.data)), pick(r.randint(0, 6)))
        assert t.tokens() == encode.PrefixTable(both[0], t.data).tokens()


def test_an_edit_is_local(both):
    t = encode.PrefixTable(both[0], b"the quick brown fox jumps over the lazy dog " * 40)
    assert t.replace(5, 8, b"xyz") < 400

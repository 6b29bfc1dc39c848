"""Search against scoring all items, verification against quotes of known length."""

import random

import numpy as np
import pytest

from tracewright.llm import leak


def item(r, n=50):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5))) for _ in range(n))


def edited(r, words, k):
    words = list(words)
    for i in r.sample(range(1, len(words) - 1), k):
        x = r.random()
        words[i] = "zzz" if x < 0.4 else "" if x < 0.7 else words[i] + " yyy"
    return " ".join(w for w in words if w)


def one(index, text):
    return index.leaked([text])[0]


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("expanded", [1, 50, 10**6])
def test_search_misses_nothing(seed, expanded, monkeypatch):
    monkeypatch.setattr(leak, "EXPANDED", expanded)
    r = random.Random(seed)
    passages = [item(r, r.randint(20, 60)) for _ in range(60)] + [item(r, 10), ""]
    index = leak.Index(list(enumerate(passages)))
    queries, want = [], set()
    for q in range(40):
        words = set(index.terms_of(np.array(index.numbers(item(r, 30)) + index.passage(r.randrange(60))[: r.randint(3, 25)] + index.passage(r.randrange(60))[:8])).tolist())
        queries += sorted((q, w) for w in words if w >= 0)
        scores = [0.0] * len(passages)
        for w in words:
            if w >= 0:
                for k in range(index.start[w], index.start[w + 1]):
                    scores[index.items[k]] += float(index.weights[k])
        want |= {(q, k) for k, s in enumerate(scores) if s >= 1}
    pairs = np.array(queries, np.int64).reshape(-1, 2)
    assert set(index.search(pairs[:, 0], pairs[:, 1], 40)) == want and want


@pytest.mark.parametrize("text", ["It's <b>bold</b> & \"quoted\" isn't 'so' [b]x[/b] http://a.b/c d", "3 < 4 and 5 > 2", "<a href='" + "x" * 2000 + "'>link</a> end", "O'Neil\nnew\tline"])
def test_short_way_of_words_is_the_long_one(text):
    assert leak.words(text) == leak.words(text + " é")[:-1]


def test_batches_are_texts_one_by_one():
    r = random.Random(11)
    passages = [item(r, 40) for _ in range(30)]
    index = leak.Index(list(enumerate(passages)))
    texts = [" ".join(r.choice(passages) if r.random() < 0.3 else item(r, r.randint(0, 60)) for _ in range(r.randint(0, 4))) for _ in range(50)] + [None, "", " "]
    together = index.leaked(texts)
    assert together == [one(index, t) for t in texts] and any(together)


@pytest.mark.parametrize("seed", range(8))
def test_quotes(seed):
    r = random.Random(seed)
    passages = [item(r) for _ in range(40)]
    index = leak.Index([(100 + k, p) for k, p in enumerate(passages)])
    own = passages[7].split()
    filler = item(r, 70)
    for n in (18, 25, 50):
        start = r.randint(0, 50 - n)
        quote = own[start : start + n]
        assert one(index, f"{filler} {' '.join(quote)} {filler}") == {107}
        assert one(index, f"{filler} {edited(r, quote, n // 10)} {filler}") == {107}
        assert one(index, "<br>".join(quote).upper().replace("<BR>", "<br> ​")) == {107}
    assert one(index, f"{filler} {' '.join(own[:12])} {filler} {' '.join(own[14:26])}") == set()


@pytest.mark.parametrize("n, gap", [(18, 8), (20, 9), (25, 12)])
def test_interrupted_quotes(n, gap):
    r = random.Random(n)
    own = item(r).split()
    index = leak.Index([(7, " ".join(own))])
    for before in range(0, 60, 5):
        text = [*item(r, before).split(), *own[:n], *item(r, gap).split(), *own[n : 2 * n], *item(r, 30).split()]
        assert one(index, " ".join(text)) == {7}


def test_short_quote_hides_no_leak():
    r = random.Random(5)
    own = item(r).split()
    changed = [("zzz" if i in (4, 9, 14) else w) for i, w in enumerate(own[30:48])]
    index = leak.Index([(7, " ".join(own))])
    assert one(index, " ".join([*own[:12], *item(r, 6).split(), *changed])) == {7}
    assert one(index, " ".join([*own[:12], *item(r, 6).split(), *changed[:12]])) == set()


def test_items_of_few_different_words():
    r = random.Random(8)
    own = item(r, 30)
    index = leak.Index([(1, own + " la" * 20), (2, item(r, 30)), (3, "la la la")])
    assert one(index, f"{item(r, 70)} {own} {item(r, 30)}") == {1}
    assert one(index, f"{item(r, 70)}{' la' * 20} {item(r, 30)}") == {1}
    assert one(index, f"{item(r, 70)}{' la' * 9} {item(r, 30)}") == set()


def test_fitting():
    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 20))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        assert leak.fitting(a, b) == min(row)


def test_long_documents(spark):
    r = random.Random(3)
    p = item(r, 40)
    text = item(r, 3000) + " " + p + " " + item(r, 500)
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (4, p, 5), (4, p, 5), (5, item(r, 60), 5)], "doc_id long, text string, eval_id int")
    items = spark.createDataFrame([(9, p), (9, p), (10, None), (11, "too short"), (12, "")], "eval_id int, passage string")
    got = leak.leaks(docs, items)
    assert {tuple(x) for x in got.collect()} == {(1, 9), (4, 9)}
    assert [tuple(x) for x in leak.leaked_items(got).collect()] == [(9, 2)]
    assert leak.leaks(docs, items.where("false")).count() == 0 and leak.leaks(docs.where("false"), items).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    r = random.Random(4)
    passages = [item(r, 30) for _ in range(7)]
    docs = spark.createDataFrame([(k, p) for k, p in enumerate(passages)], "doc_id long, text string")
    items = spark.createDataFrame([(k, p) for k, p in enumerate(passages)], "eval_id int, passage string")
    monkeypatch.setattr(leak, "ITEMS", 3)
    assert {tuple(x) for x in leak.leaks(docs, items).collect()} == {(k, k) for k in range(7)}


def test_recall_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/eval_items.parquet").select("eval_id", "passage").collect()
    index = leak.Index([(x.eval_id, x.passage) for x in items])
    for d, got in zip(docs, index.leaked([d.text for d in docs])):
        w = index.numbers(d.text)
        have = set(w)
        assert got == {index.ids[k] for k in range(len(items)) if sum(x in have for x in index.passage(k)) >= 12 and leak.contains(index.passage(k), w)}


def test_many_items_stay_small():
    """20 000 items of Zipf-like words: what is broadcast is some 2 kB an item."""
    import pickle

    rng = np.random.default_rng(1)
    picks = (rng.zipf(1.2, 20_000 * 45) % 60_000).reshape(20_000, 45)
    index = leak.Index([(k, " ".join(f"w{x}" for x in row)) for k, row in enumerate(picks)])
    assert len(pickle.dumps(index)) < 2500 * 20_000
    assert index.leaked([" ".join(f"w{x}" for x in picks[77])])[0] >= {77}

"""Trees, calibration, reading of disguised words, held-out accuracy."""

import numpy as np
import pytest

from tests.llm.abuse_sentences import SENTENCES
from tracewright.llm import abuse, abuse_table
from tracewright.llm.pii import Words


@pytest.mark.parametrize(("text", "word"), [("1d10t", "idiot"), ("i d i o t", "idiot"), ("Volli d i o t", "vollidiot"), ("id​iot", "idiot"), ("іdiоt", "idiot"), ("idiiiiot", "idiot"), ("l*ser", "loser"), ("m*r*n", "moron"), ("5tfu", "stfu"), ("p.a.t.h.e.t.i.c", "pathetic")])
def test_disguises(text, word):
    tokens, disguised = abuse.Reader().tokens(text)
    assert word in tokens and disguised


def test_player_names_are_names():
    assert abuse.Reader().tokens("hi Lunar_Smith8764")[0] == ["hi", abuse.NAME]


def test_isotonic():
    knots, levels = abuse.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(levels) == [0, 0.5, 1] and list(knots) == [1, 2.5, 4]
    assert (np.diff(abuse.isotonic(np.random.default_rng(1).normal(size=200), np.random.default_rng(2).integers(0, 2, 200).astype(float))[1]) > 0).all()


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) & (x[:, 1] > 0.3)).astype(float)
    m = abuse.boost(x[:400], y[:400])
    assert ((m.raw(x[400:]) > 0) == y[400:]).mean() > 0.95


def rates(scores, labels):
    got, want = scores >= abuse.THRESHOLD, np.array(labels) == 1
    return (got & want).sum() / want.sum(), (got & want).sum() / got.sum()


def extractor():
    return abuse.Extractor(Words.load())


def test_held_out_accuracy(spark, sf):
    messages, labels = abuse.training_rows(spark.read.parquet(f"{sf}/moderation_sample.parquet"))
    odd = np.arange(len(messages)) % 4 == 0
    m = abuse.fit([x for x, o in zip(messages, odd) if not o], [y for y, o in zip(labels, odd) if not o])
    scores = m.score(extractor().many([x for x, o in zip(messages, odd) if o]))
    truth = np.array([y for y, o in zip(labels, odd) if o])
    assert ((scores >= abuse.THRESHOLD) == truth).mean() > 0.93


def test_held_out_words(spark, sf):
    """Half of the words of each list fill the rows of training, the other half those that are judged."""
    sample = spark.read.parquet(f"{sf}/moderation_sample.parquet")
    m = abuse.fit(*abuse.training_rows(sample, table=abuse_table.labelled_table(half=0)))
    rows = abuse_table.labelled_table(78, 6, half=1)
    recall, precision = rates(m.score(extractor().many([x for x, _ in rows])), [y for _, y in rows])
    assert recall >= 0.83 and precision >= 0.9, (recall, precision)


def test_held_out_rules():
    """Rules of a quarter of the grammar, each of which says something of its own, are never shown. This is well below the
    rates on new words or on new sentences of known forms, and is stated in the README."""
    m = abuse.fit(*abuse.training_rows(None, table=abuse_table.labelled_table(part=1, inside=False)))
    rows = abuse_table.labelled_table(79, 6, part=1)
    recall, precision = rates(m.score(extractor().many([x for x, _ in rows])), [y for _, y in rows])
    assert recall >= 0.6 and precision >= 0.65, (recall, precision)


def test_sentences_written_first(model):
    recall, precision = rates(model.score(extractor().many([m for m, _ in SENTENCES])), [y for _, y in SENTENCES])
    assert recall >= 0.9 and precision >= 0.85, (recall, precision)


@pytest.fixture(scope="module")
def model(spark, sf):
    return abuse.fit(*abuse.training_rows(spark.read.parquet(f"{sf}/moderation_sample.parquet")))


def test_cases_and_harmless_ones(model):
    bad = ["you are such an imbecile", "cool hat, kys", "all migrants are vermin, throw them out", "wanna have s e x irl? dm me", "i will find you and break your neck"]
    good = ["i killed the boss with one arrow", "this stupid lever is stuck", "please mute that player, rude language", "trash can by the door", "hello", "", "!!!", "x" * 100_000]
    s = model.score(extractor().many(bad + good))
    assert (s[: len(bad)] >= abuse.THRESHOLD).all() and (s[len(bad) :] < abuse.THRESHOLD).all()


def test_scores_flags_and_rates(spark, model):
    rows = [(1, 1, "you are a moron"), (1, 1, "you are a moron"), (2, 1, "nice build"), (3, None, None), (4, None, "kys"), (5, 2, "")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "id long, wid int, message string, score double")
    s = abuse.scored(df, model)
    assert {r.chat_id: r.score for r in s.collect()}[3] is None
    assert {r.chat_id for r in abuse.flagged(s).collect()} == {1, 4}
    assert {r.source: (r.n, r.n_flagged, r.share) for r in abuse.rates(s).collect()} == {1: (2, 1, 0.5), None: (2, 1, 0.5), 2: (1, 0, 0.0)}
    assert abuse.rates(abuse.scored(df.where("false"), model)).count() == 0


def test_labels(spark):
    rows = [(1, "a", "Abusive "), (2, "b", None), (3, "c", "none"), (4, None, "none"), (5, "d", "unheard"), (6, "a", "none"), (7, "a", "hateful")]
    df = spark.createDataFrame(rows, "sample_id long, message string, label string")
    n = len(abuse.labelled_table())
    m, y = abuse.training_rows(df)
    assert dict(zip(m[: len(m) - n], y)) == {"a": 1, "c": 0}
    assert len(abuse.training_rows(df, most=1)[0]) == n + 1 and len(abuse.training_rows(None)[0]) == n

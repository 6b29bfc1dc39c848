"""The field against brute force and on held-out rows; placeholders leave all else as it was."""

import itertools

import numpy as np
import pytest

from tests.llm.pii_sentences import KIND, SENTENCES
from tracewright.llm import pii, pii_table


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_viterbi_equals_all_paths(model):
    text = "call Ann Bell at 5 "
    scores, _ = model.scores([text])
    best = max(itertools.product(range(len(pii.LABELS)), repeat=5), key=lambda p: model.start[p[0]] + sum(scores[i, k] for i, k in enumerate(p)) + sum(model.trans[a, b] for a, b in zip(p, p[1:])))
    got = model.decode([text])[0]
    assert tuple(got if got is not None else (0,) * 5) == best


def test_messages_that_are_not_decoded_have_empty_paths(model):
    texts = [t for _, t in SENTENCES]
    scores, ends = model.scores(texts)
    for k, path in enumerate(model.decode(texts)):
        whole = model._viterbi([scores[ends[k] : ends[k + 1]]])[0]
        assert not whole.any() if path is None else (path == whole).all()


def test_batch_decoding_is_decoding_one_by_one(model):
    texts = ["hi", "my email is a.b@c.example", "", "x " * 300, "Ann Smithson, 5 High Street, tel 202-555-0101", "🙂", "a", " ", "ZOE BELL CALLED ME TODAY", "a\u200bb Tom Bel\u200bler"]
    together = pii.find(model, texts)
    assert together == [pii.find(model, [t])[0] for t in texts]


@pytest.mark.parametrize("text", ["/msg Red_Fox12 call me on +1 (202) 555-0101 or a@b.example, Ann Smith", "SEND IT TO MY HOME NOW 12345", "соm\u200bputer １２３ 4567 ok", "a"])
def test_scores_by_parts_equal_scores_by_features(model, text):
    scores, _ = model.scores([text])
    feats = pii.features(model.words, pii.read(text))
    assert len(feats) == len(scores)
    for i, fs in enumerate(feats):
        ids = [model.names[f] for f in fs if f in model.names]
        assert np.allclose(model.weights[ids].sum(axis=0), scores[i], atol=1e-3), i


def _rates(model, rows):
    right = {k: [0, 0, 0] for k in pii_table.KINDS}
    for text, want in rows:
        got = {k for _, _, k in pii.find(model, [text])[0]}
        for k in pii_table.KINDS:
            right[k][0] += k in want and k in got
            right[k][1] += k in want and k not in got
            right[k][2] += k not in want and k in got
    return right


def test_held_out_rules():
    """Trained without a quarter of the rules, judged on rows of that quarter: sentences it was never shown."""
    total = np.zeros(3)
    for part in (1, 3):
        m = pii.trained(pii_table.labelled_table(7, part=part, inside=False))
        rows = [("".join(s for s, _ in row), {k for _, k in row if k}) for row in pii_table.labelled_table(99, 60, 300, part=part)]
        total += np.array(list(_rates(m, rows).values())).sum(axis=0)
    tp, fn, fp = total
    assert tp / (tp + fn) >= 0.9 and tp / (tp + fp) >= 0.9, total


def test_sentences_written_first(model):
    right = _rates(model, [(t, {KIND[x] for x in kinds if x != "-"}) for kinds, t in SENTENCES])
    tp, fn, fp = np.array(list(right.values())).sum(axis=0)
    assert tp / (tp + fn) >= 0.9 and tp / (tp + fp) >= 0.9, right


def test_without_vocabularies(tmp_path):
    assert pii.Words.load(str(tmp_path)).kind("table") == "o"


@pytest.mark.parametrize(("text", "want"), [
    ("mail me at jane_doe@mail.example!", {"email"}), ("jane at mail dot example is my address", {"email"}), ("call me on 202 555 0199", {"phone"}), ("my ssn is 912-44-1234", {"identity"}),
    ("i live at 14 Cherry Lane, Stowmere", {"address"}), ("my real name is Jane Holloway", {"person"}), ("my coords are 120 64 -3333", set()), ("/tp 630 12 4593", set()), ("ticket #12-17 is still open", set()), ("ask the Frost Warden about the Silver Key", set()), ("seed is -137980647031029107", set()),
])
def test_kinds(model, text, want):
    assert {k for _, _, k in pii.find(model, [text])[0]} == want


def test_placeholders(spark, model):
    rows = [(1, "hi, my email is jane.doe@mail.example ok?"), (1, "hi, my email is jane.doe@mail.example ok?"), (2, None), (3, ""), (4, "nothing here"), (5, "very long " * 20_000 + "call me on 202-555-0101")]
    df = spark.createDataFrame([(*r, "clash", ["x"]) for r in rows], "id long, message string, clean string, kinds array<string>")
    got = {r.entry_id: (r.message, r.kinds) for r in pii.redact({"chat": df}).collect()}
    assert got[1] == ("hi, my email is [EMAIL] ok?", ["email"])
    assert got[2] == (None, []) and got[3] == ("", []) and got[4] == ("nothing here", [])
    assert got[5][1] == ["phone"] and got[5][0].endswith("call me on [PHONE]") and len(got[5][0]) > 190_000
    assert {tuple(r) for r in pii.found({"chat": df, "command": df.where("id = 1")}).collect()} == {("chat", 1, "email"), ("chat", 5, "phone"), ("command", 1, "email")}
    assert pii.found({"chat": df.where("false")}).count() == 0


def test_spans_keep_the_rest():
    m = "a  b\tc"
    assert pii.replace(m, [(3, 4, "person")]) == "a  [PERSON]\tc"


@pytest.mark.parametrize(
    "text, want",
    [
        ("call me on 202-555-0143 202-555-0178", ["[PHONE] [PHONE]"]),
        ("my number is 202-555-0143 / 202-555-0178", ["[PHONE] / [PHONE]"]),
        ("email me at a.b@mail.example c.d@mail.example", ["[EMAIL] [EMAIL]"]),
    ],
)
def test_two_in_a_row(model, text, want):
    clean = pii.replace(text, pii.find(model, [text])[0])
    assert clean.endswith(want[0]), clean


def test_joined_spans_are_parted():
    def got(kind, text):
        s = pii.read(text)
        return [text[a:b] for a, b, _ in pii.entities(s, np.full(len(s.tokens), pii.LABELS.index(kind)))]

    assert got("phone", "202-555-0143 202-555-0178") == ["202-555-0143", "202-555-0178"]
    assert got("phone", "202 555 0143 202 555 0178") == ["202 555 0143", "202 555 0178"]
    assert got("phone", "+44 20 7946 0018") == ["+44 20 7946 0018"]
    assert got("person", "Ann Smithson") == ["Ann Smithson"]
    assert got("identity", "4111 1111 1111 1111") == ["4111 1111 1111 1111"]

"""The filter language, by its documented examples."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracewright.plans.spec import ACTION_WORDS, Box, SpecError, match_world, parse, parse_actions, parse_coords, parse_purge, parse_radius, parse_time, time_text

NOW = 1_647_820_800


@pytest.mark.parametrize(("text", "want"), [
    ("2w,5d,7h,2m,10s", (1_666_930, 0)), ("5d2h", (439_200, 0)), ("1h-2h", (7200, 3600)), ("2h-1h", (7200, 3600)), ("2.50h", (9000, 0)), ("23h17m", (83_820, 0)), ("30d", (2_592_000, 0)), ("12w", (7_257_600, 0)),
    ("6mo", (15_552_000, 0)), ("1mo2d", (2_764_800, 0)), ("13mo", (33_696_000, 0)), ("1y", (31_536_000, 0)), ("1h5h", (3600, 0)),
])
def test_times(text, want):
    assert parse_time(text) == want


@pytest.mark.parametrize("text", ["", "h", "5", "5x", "1h-2h-3h", "0s", "x1h", "-"])
def test_bad_times(text):
    with pytest.raises(SpecError):
        parse_time(text)


@given(st.integers(0, 9), st.integers(1, 90), st.integers(0, 50))
def test_times_add_up(w, d, m):
    assert parse_time(f"{w}w{d}d{m}m") == (w * 604_800 + d * 86_400 + m * 60, 0)


def test_time_text():
    assert time_text("2.50h") == "2.5 hours"
    assert time_text("1d,30m-1h") == "1 day, 30 minutes - 1 hour"


@pytest.mark.parametrize(("word", "want"), [("+block", [1]), ("-block", [0]), ("block", [0, 1]), ("container", [4]), ("+container", [4, 1]), ("-container", [4, 0]), ("inventory", [4, 11]), ("+inventory", [4, 11, 0]), ("-inventory", [4, 11, 1]), ("item", [11]), ("+item", [11, 1]), ("-item", [11, 0]), ("session", [8]), ("+session", [8, 1]), ("-session", [8, 0]), ("click", [2]), ("#kill", [3]), ("chat", [6]), ("command", [7]), ("username", [9]), ("sign", [10]), ("nonsense", [-1])])
def test_actions(word, want):
    assert parse_actions(word) == want


def test_action_words_are_unique():
    words = [w for text in ACTION_WORDS.values() for w in text.split()]
    assert len(words) == len(set(words))


def test_radius_and_coords():
    assert parse_radius("10") == (10, None, 10)
    assert parse_radius("10x5x20") == (10, 5, 20)
    assert parse_radius("#global") is None
    assert parse_coords("1,-2") == (1, None, -2)
    assert parse_coords("1,999,3") == (1, 320, 3)
    for bad in ("x", "1x2", ""):
        with pytest.raises(SpecError):
            parse_radius(bad)
    with pytest.raises(SpecError):
        parse_coords("1,2,3,4")


def test_worlds():
    worlds = [(1, "world_main"), (2, "world_mine"), (3, "mine")]
    assert match_world("#mine", worlds) == 3
    assert match_world("#world_mine", worlds) == 2
    assert match_world("#_main", worlds) == 1
    assert match_world("wid:7", worlds) == 7
    assert match_world("#nowhere", worlds) is None


def test_whole_filters():
    s = parse("u:A,#tnt t: 1h-2h r:5 a:+container #count page 2:50", NOW, at=(1, 10, 64, -10))
    assert (s.users, s.actions, s.start, s.end) == (("a", "#tnt"), (4, 1), NOW - 7200, NOW - 3600)
    assert s.box == Box((5, 15), (-15, -5)) and s.wid == 1
    assert (s.page, s.rows, s.flags) == (2, 50, frozenset({"count"}))
    assert parse("someone t:1d", NOW).users == ("someone",)
    assert parse("i:entity:5 t:1d", NOW).actions == (3,)
    assert parse("t:1d rows:5000", NOW).rows == 100
    assert parse("t:1d rows:5000", NOW, console=True).rows == 1000
    assert parse("t:1d", NOW, at=(1, 0, 0, 0), rollback=True).box == Box((-10, 10), (-10, 10))
    assert parse("t:1d e:stone,someone", NOW, types=frozenset({"ns:stone"})).exclude_users == ("someone",)


@pytest.mark.parametrize("text", ["u:a", "i:stone", "a:nonsense t:1d", "i:entity:1,stone t:1d", "i:stone a:chat t:1d", "a:inventory t:1d", "r:500 t:1d"])
def test_refused(text):
    with pytest.raises(SpecError):
        parse(text, NOW, at=(1, 0, 0, 0))


def test_names_take_no_radius():
    with pytest.raises(SpecError):
        parse("u:a t:1d a:username r:5", NOW, at=(1, 0, 0, 0))


def test_purge():
    p = parse_purge("t:40d", NOW)
    assert (p.start, p.end) == (0, NOW - 40 * 86_400)
    p = parse_purge("t:40d-60d r:#mine i:stone", NOW, [(2, "mine")], {"ns:stone": 9})
    assert (p.start, p.end, p.wid, p.types) == (NOW - 60 * 86_400, NOW - 40 * 86_400, 2, (9,))
    assert parse_purge("t:2d", NOW, console=True).end == NOW - 2 * 86_400
    for bad in ("t:2d", "u:a t:40d", "r:#mine", "t:40d a:block"):
        with pytest.raises(SpecError):
            parse_purge(bad, NOW)

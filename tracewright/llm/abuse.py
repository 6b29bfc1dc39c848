"""Abusive, hateful or sexual messages: gradient-boosted trees over dense features, calibrated by isotonic regression.

A message is first read as its writer meant it: invisible characters go, look-alike letters, digits for letters,
letters set apart, masked and stretched words become the words of the lists where these know them. Features are the
densities of lists of single words, how close they stand to a second person and to each other, names of unknown people,
capitals, punctuation and disguise. The trees are fitted where the query is built, on at most MAX_LABELLED labelled
rows and the rows of a built-in grammar; out-of-fold scores give the calibration.

Cases: null messages have score null and aren't flagged; empty ones score like any text without hits; very long
texts are read whole; repeated rows and ties get equal scores; null or unknown labels are left out of the fitting;
without labelled rows the built-in table alone is fitted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.abuse_table import LEXICONS, SECOND, labelled_table
from tracewright.llm.encode import TOKENIZERS
from tracewright.llm.pii import Words

MAX_LABELLED = 20_000  # labelled rows the trees are fitted on at most, the lowest ids first
THRESHOLD = 0.5
ROUNDS, DEPTH, RATE, BINS, FOLDS, LEAST_WEIGHT, SHRINK = 120, 4, 0.15, 16, 4, 1.0, 2.0
CASES = frozenset({"abusive", "hateful", "sexual"})

#: Letters of other scripts that look like Latin ones, and signs written for letters.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтвնոαεορυικντβ", "aeopcyxijsdhkmtbnnaeopuikvtb")
LEET = str.maketrans("0134578@$!€", "oieastbasie")

_HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}]+")
_APART = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{L}\p{N}][ .\-_*~|]{1,2}){2,}[\p{L}\p{N}]{1,2}(?![\p{L}\p{N}])")
_SPACED_LETTERS = regex.compile(r"[ .\-_*~|]+")
_TOKEN = regex.compile(r"[\p{L}\p{N}_*@$€][\p{L}\p{N}_*@$!€'’#]*|[!?.,;]")
_MIXED = regex.compile(r"(?=.*\p{Latin})(?=.*[\p{Cyrillic}\p{Greek}\p{Armenian}])")
_STRETCH = regex.compile(r"(.)\1{2,}")
_NAME = regex.compile(r"(?i)^(?:\p{L}+_\p{L}+_?\d*|x\p{L}{4,}x\d+|\p{L}{4,}\d{2,})$")
_CAMEL = regex.compile(r"^(?:\p{Lu}\p{Ll}+){2,}\d*$")
_CUT = regex.compile(r"\p{L}\p{Cf}+\p{L}")
_LETTER, _CAPITAL, _MARK = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}"), regex.compile(r"[^\p{L}\p{N}\s]")
NAME = "@name"


CATEGORIES = tuple(LEXICONS)
_OF: dict[str, tuple[int, ...]] = {}
for _k, _c in enumerate(CATEGORIES):
    for _w in LEXICONS[_c].split():
        if _k not in _OF.get(_w, ()):
            _OF[_w] = (*_OF.get(_w, ()), _k)
_SECOND = frozenset(SECOND)
VOCABULARY = frozenset(_OF) | _SECOND
HARMFUL = frozenset(w for c in ("insult", "bad", "hush", "self", "vermin", "sex", "body", "swear") for w in LEXICONS[c].split())
_BY_HARM = [*dict.fromkeys(w for c in LEXICONS for w in LEXICONS[c].split() if len(w) > 2 and w in HARMFUL), *sorted(w for w in VOCABULARY if len(w) > 2 and w not in HARMFUL)]
#: places of the words that no list holds: second persons, player names, and words that no vocabulary knows (names of people)
YOU, PLAYER, STRANGE = len(CATEGORIES), len(CATEGORIES) + 1, len(CATEGORIES) + 2
_PLACES = (*CATEGORIES, "you", "player", "strange")
#: which words ahead of which others are told how near they stand
PAIRS = tuple((_PLACES.index(a), _PLACES.index(b)) for a, b in (p.split(">") for p in """you>insult you>bad bad>insult hush>insult insult>you hush>you you>waste bad>waste never>love love>you never>you hate>you hate>group hate>strange every>insult
 die>you you>die self>you harm>own die>own you>own harm>group harm>strange own>group own>strange hope>die hope>harm hope>you kin>die you>kin kin>bad harm>you harm>limb harm>kin me>harm menace>weapon menace>you you>menace brain>you you>brain kin>brain
 every>group every>strange group>vermin strange>vermin vermin>group group>bad strange>bad group>crime strange>crime crime>group remove>group group>remove remove>strange strange>remove never>group never>strange hope>remove group>die strange>die die>strange violence>group violence>strange
 ask>sex ask>body you>body sex>body desire>body desire>you you>desire sex>you me>sex me>desire girl>sex sex>girl ask>girl ask>you
 insult>report report>insult report>bad bad>things bad>creature bad>play swear>things swear>play violence>creature violence>things violence>play me>bad you>nice body>play desire>things remove>things group>nice group>rights strange>rights rights>group never>rights rights>strange gone>group group>gone gone>strange strange>gone gone>rights intimate>ask ask>intimate desire>intimate intimate>you me>intimate you>gone things>gone gone>things gone>play every>things every>play remove>play desire>creature""".split()))
FEATURES = (
    *(f"n_{c}" for c in _PLACES), *(f"d_{c}" for c in CATEGORIES), *(f"you_{c}" for c in CATEGORIES), *(f"{_PLACES[a]}>{_PLACES[b]}" for a, b in PAIRS),
    "capitals", "punctuation", "disguise", "tokens", "kinds_of_harm",
)
_PLACES_OF = {w: (*_OF.get(w, ()), *((YOU,) if w in _SECOND else ())) for w in VOCABULARY}
_DENSITY = len(_PLACES)
_YOU_NEAR = _DENSITY + len(CATEGORIES)
_PAIRS_FROM: dict[int, list[tuple[int, int]]] = {}
for _k, (_a, _b) in enumerate(PAIRS):
    _PAIRS_FROM.setdefault(_a, []).append((_b, _YOU_NEAR + len(CATEGORIES) + _k))
_REST = _YOU_NEAR + len(CATEGORIES) + len(PAIRS)


class Reader:
    """Turns a message into the tokens that were meant; single tokens are remembered."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, bool]] = {}

    def token(self, raw: str) -> tuple[str, bool]:
        """The meant word, and whether it was disguised."""
        hit = self.known.get(raw)
        if hit is None:
            if len(self.known) > 200_000:
                self.known.clear()
            hit = self.known[raw] = self._token(raw)
        return hit

    def _token(self, raw: str) -> tuple[str, bool]:
        low = raw.casefold().replace("’", "'")
        if _MIXED.match(low):
            return self._token(low.translate(LOOKALIKE))[0], True
        if low in VOCABULARY:
            return low, False
        for view, hidden in self._views(low):
            if view in VOCABULARY:
                return view, hidden and view in HARMFUL
        if "*" in low.strip("*") or (low.count("*") and len(low) > 3):
            mask = regex.compile(regex.sub(r"\\\*(?:\\\*)*", ".{1,3}", regex.escape(low.translate(LEET))))
            for w in _BY_HARM:
                if mask.fullmatch(w):
                    return w, True
        if _NAME.match(raw) or _CAMEL.match(raw):
            return NAME, False
        if len(low) > 2 and low.endswith("'s") and low[:-2] in VOCABULARY:
            return low[:-2], False
        return low.rstrip("*!'#"), False

    @staticmethod
    def _views(low: str) -> Iterator[tuple[str, bool]]:
        bare = low.strip("*'_!#")
        yield bare, False
        leet = bare.translate(LEET) if any(c.isalpha() for c in bare) else bare
        for base, hidden in ((bare, False), (leet, True)):
            if base == bare and hidden:
                continue
            yield base, hidden
            parts = _STRETCH.split(base)
            if len(parts) > 1:
                runs = parts[1::2]
                # all stretches single, all double, then each one alone double: linear in the stretches, however many
                picks = [[1] * len(runs), [2] * len(runs), *([1 + (k == n) for k in range(len(runs))] for n in range(len(runs)))]
                for pick in picks:
                    yield "".join(p if k % 2 == 0 else p * pick[k // 2] for k, p in enumerate(parts)), True
        if bare.startswith("ky") and leet.startswith("kys"):
            yield "kys", True

    def tokens(self, message: str) -> tuple[list[str], int]:
        if message.isascii():
            shown, disguised = message, 0
        else:
            text = unicodedata.normalize("NFKC", message)
            shown, disguised = _HIDDEN.sub("", text), int(_CUT.search(text) is not None)
        joined, count = _APART.subn(lambda m: self._together(m[0]), shown)
        out = []
        for raw in _TOKEN.findall(joined):
            t, hidden = self.token(raw)
            disguised += hidden
            if t:
                out.append(t)
        return self._mended(out), disguised + count

    def _mended(self, tokens: list[str]) -> list[str]:
        """Words of which only some letters were set apart."""
        out, i = [], 0
        while i < len(tokens):
            j = i
            while j < len(tokens) and len(tokens[j]) == 1 and tokens[j].isalpha():
                j += 1
            if j - i >= 2:
                mid = "".join(tokens[i:j])
                before, after = (out[-1] if out else ""), (tokens[j] if j < len(tokens) else "")
                if before and before + mid in VOCABULARY:
                    out[-1] = before + mid
                elif after and mid + after in VOCABULARY:
                    out.append(mid + after)
                    j += 1
                else:
                    out += tokens[i:j]
                i = j
            else:
                out.append(tokens[i])
                i += 1
        return out

    def _together(self, spaced: str) -> str:
        """Letters set apart, as one word if the lists know it, else as they were."""
        word = _SPACED_LETTERS.sub("", spaced)
        if self.token(word)[0] in VOCABULARY:
            return word
        for cut in range(len(word) - 1, 2, -1):  # a short neighbouring word may have been caught as well
            for mine, start in ((word[:cut], 0), (word[-cut:], len(word) - cut)):
                if self.token(mine)[0] in VOCABULARY:
                    return f"{word[:start]} {mine} {word[start + cut :]}"
        return spaced


_HARM = [CATEGORIES.index(c) for c in ("insult", "bad", "hush", "self", "vermin", "sex", "remove", "body")]


class Extractor:
    def __init__(self, words: Words) -> None:
        self.reader, self.words = Reader(), words
        self.strange: dict[str, bool] = {}

    def is_strange(self, t: str) -> bool:
        known = self.strange.get(t)
        if known is None:
            if len(self.strange) > 200_000:
                self.strange.clear()
            known = self.strange[t] = len(t) > 3 and t.isalpha() and t not in VOCABULARY and self.words.kind(t) in "no" and (self.words.kind(t[:-1]) in "no" if t.endswith("s") else True)
        return known

    def one(self, message: str) -> list[float]:
        tokens, disguised = self.reader.tokens(message)
        words = [t for t in tokens if t[0] not in "!?.,;"]
        n = max(1, len(words))
        at: dict[int, list[int]] = {}
        for i, t in enumerate(words):
            for k in _PLACES_OF.get(t) or ((PLAYER,) if t == NAME else (STRANGE,) if self.is_strange(t) else ()):
                at.setdefault(k, []).append(i)
        persons = sorted(at.get(YOU, []) + at.get(PLAYER, []))
        out = [0.0] * len(FEATURES)
        for k, places in at.items():
            out[k] = math.log1p(len(places))
            if k < YOU:
                out[_DENSITY + k] = len(places) / n
                if persons:
                    out[_YOU_NEAR + k] = _near(places, persons)
            for b, feature in _PAIRS_FROM.get(k, ()):
                if b in at:
                    out[feature] = _ahead(places, at[b])
        out[_REST:] = [
            len(_CAPITAL.findall(message)) / max(1, len(_LETTER.findall(message))),
            len(_MARK.findall(message)) / max(1, len(message)),
            disguised / n,
            math.log1p(n),
            float(sum(k in at for k in _HARM)),
        ]
        return out

    def many(self, messages: list[str]) -> np.ndarray:
        return np.array([self.one(m) for m in messages], dtype=np.float32).reshape(len(messages), len(FEATURES))


def _near(a: list[int], b: list[int]) -> float:
    """1 over one more than the least distance of two sorted lists of places."""
    i = j = 0
    best = None
    while i < len(a) and j < len(b):
        d = abs(a[i] - b[j])
        best = d if best is None or d < best else best
        if a[i] < b[j]:
            i += 1
        else:
            j += 1
    return 1 / (1 + best)


def _ahead(a: list[int], b: list[int]) -> float:
    """1 over the least distance of a place of a before one of b, 0 without one."""
    best, j = None, 0
    for i in a:
        while j < len(b) and b[j] <= i:
            j += 1
        if j == len(b):
            break
        d = b[j] - i
        best = d if best is None or d < best else best
    return 0.0 if best is None else 1 / best


@dataclass
class Trees:
    """Boosted trees of equal depth: feature and cut of each inner node, value of each leaf; and the calibration."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - len(f)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting with histograms; every tree is complete, a node that isn't worth a split sends all rows left.

    Most features of most rows are in their first bin, so histograms are counted over the other entries only, for all
    nodes of a level at once; what is missing to the sum of a node is in the first bins.
    """
    wide = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(wide)]
    cuts = [c if len(u := np.unique(x[:, j])) > BINS else u[:-1] for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    size = max(len(c) for c in cuts) + 1
    row, column = np.nonzero(binned)
    code = column * size + binned[row, column]
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    total = np.full(len(y), base)
    inner = 2**DEPTH - 1
    features, values, leaves = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            local = node - first
            at = local[row] * (wide * size) + code
            sums = []
            for v in (g, h):
                hist = np.bincount(at, v[row], minlength=many * wide * size).reshape(many, wide, size)
                whole = np.bincount(local, v, minlength=many)[:, None]
                hist[:, :, 0] = whole - hist.sum(axis=2)
                sums.append((hist.cumsum(axis=2), whole[:, :, None]))
            (gs, gt), (hs, ht) = sums
            gain = gs**2 / (hs + SHRINK) + (gt - gs) ** 2 / (ht - hs + SHRINK) - gt**2 / (ht + SHRINK)
            gain[(hs < LEAST_WEIGHT) | (ht - hs < LEAST_WEIGHT)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                j, b = divmod(int(best[k]), size)
                if gain[k, j, b] > 1e-3 and b < len(cuts[j]):
                    f[first + k], c[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > c[node])
        at = node - inner
        leaf = np.bincount(at, g, minlength=inner + 1) / (np.bincount(at, h, minlength=inner + 1) + SHRINK) * RATE
        total += leaf[at]
        features.append(f)
        values.append(c)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(values), np.array(leaves), base, np.array([-1.0, 1.0]), np.array([0.0, 1.0]))


def mean_of(parts: list[Trees]) -> Trees:
    """The mean of several models, as one of all their trees."""
    join = lambda c: np.concatenate([getattr(p, c) for p in parts])
    return Trees(join("feature"), join("cut"), join("leaf") / len(parts), float(np.mean([p.base for p in parts])), np.array([-1.0, 1.0]), np.array([0.0, 1.0]))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and levels of a rising curve, one knot in the middle of each pool."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, v in zip(raw[order], y[order]):
        pools.append([v, 1, r])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a, n, s = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + n, pools[-1][2] + s]
    return np.array([s / n for _, n, s in pools]), np.array([a / n for a, n, _ in pools])


def beside_harmless(messages: list[str], labels: list[int], copies: int = 2, seed: int = 5) -> tuple[list[str], list[int]]:
    """The rows, and each ``copies`` times more beside a harmless one, which doesn't change its label."""
    rng = np.random.default_rng(seed)
    harmless = [m for m, y in zip(messages, labels) if not y]
    if not harmless:
        return messages * (1 + copies), labels * (1 + copies)
    out = list(messages)
    for _ in range(copies):
        other = [harmless[k] for k in rng.integers(len(harmless), size=len(messages))]
        out += [f"{o}, {m}" if first else f"{m}. {o}" for m, o, first in zip(messages, other, rng.random(len(messages)) < 0.6)]
    return out, labels * (1 + copies)


def fit(messages: list[str], labels: list[int], folder: str = TOKENIZERS) -> Trees:
    """The calibrated model of labelled rows; the last ones are kept, as several queries score with the same rows."""
    return _fitted(tuple(messages), tuple(labels), folder)


@lru_cache(maxsize=4)
def _fitted(messages: tuple[str, ...], labels: tuple[int, ...], folder: str) -> Trees:
    messages, labels = beside_harmless(list(messages), list(labels))
    x, y = Extractor(Words.load(folder)).many(messages), np.array(labels, dtype=np.float64)
    rows = max(1, len(y) // 3)
    fold = (np.random.default_rng(3).permutation(rows) % FOLDS)[np.arange(len(y)) % rows]  # a row and its copy stay in one fold
    out = np.zeros(len(y))
    parts = []
    for k in range(FOLDS):
        parts.append(boost(x[fold != k], y[fold != k]))
        out[fold == k] = parts[-1].raw(x[fold == k])
    model = mean_of(parts)
    model.knots, model.levels = isotonic(out, y)
    return model


def training_rows(sample: DataFrame | None, message: str = "message", label: str = "label", id_col: str = "sample_id", most: int = MAX_LABELLED, table: list[tuple[str, int]] | None = None) -> tuple[list[str], list[int]]:
    """At most ``most`` labelled rows, then the built-in table; a message labelled both ways goes by the majority."""
    own = labelled_table() if table is None else table
    votes: dict[str, Counter] = {}
    if sample is not None:
        rows = sample.select(F.col(id_col).alias("i"), F.col(message).alias("m"), F.lower(F.trim(F.col(label))).alias("l")).where(F.col("m").isNotNull() & F.col("l").isin("none", *CASES))
        for r in rows.orderBy("i").limit(most).collect():
            votes.setdefault(r.m, Counter())[int(r.l in CASES)] += 1
    kept = [(m, int(v[1] > v[0])) for m, v in votes.items()]
    return [m for m, _ in kept] + [m for m, _ in own], [y for _, y in kept] + [y for _, y in own]


def _scorer(model: Trees, words: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, known = Extractor(words), {}
        for batch in batches:
            messages = batch.column(batch.num_columns - 1).to_pylist()
            if len(known) > 100_000:
                known.clear()
            new = [m for m in dict.fromkeys(messages) if m is not None and m not in known]
            if new:
                known.update(zip(new, model.score(extract.many(new)).tolist()))
            column = pa.array([None if m is None else known[m] for m in messages], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], "score"])

    return run


def scored(log: DataFrame, model: Trees, id_col: str = "id", source: str = "wid", message: str = "message", folder: str = TOKENIZERS) -> DataFrame:
    """chat_id, source and score of every delivered row; a score is a calibrated probability."""
    rows = log.select(F.col(id_col).cast("long").alias("chat_id"), F.col(source).alias("source"), F.col(message).alias("message"))
    kind = rows.schema["source"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model, Words.load(folder)), f"chat_id bigint, source {kind}, score double")


def flagged(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores.where(F.col("score") >= threshold).select("chat_id").distinct()


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each source: entries, flagged entries and their share; a null source is a row of its own."""
    once = scores.dropDuplicates(["chat_id"])
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False)).cast("int")
    return once.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("n_flagged"), F.avg(hit).alias("share"))

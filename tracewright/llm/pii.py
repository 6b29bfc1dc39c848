"""Personal information in free text: a linear-chain conditional random field over word-shape features.

The field is trained where the query is built, from the small labelled table of pii_table (a fixed number of rows),
by stochastic gradient on the exact log-likelihood. A token's features are its shape and word class, those of its
neighbours, of the blank-separated chunk and of the run of numbers that it stands in. Word classes tell common words
from names by the vocabularies of public tokenizers (a folder that is a parameter; without it every word is unknown).

Messages are decoded by Viterbi in numpy batches. The scores of a token are a sum of parts that depend on one token, a
pair of word classes, one chunk or one run, so each different chunk is cut and scored once and all else is gathering
in arrays. A message in which no token can pay for leaving the empty label is told by an exact bound and not decoded.
Decoded spans are put to an exact check (an e-mail address needs its sign and a dot, a phone number 7 to 15 digits,
and so on) and replaced by placeholders.

Cases: null messages stay null and hold nothing; empty ones stay empty; very long texts are decoded whole; repeated
rows and ties are treated alike; an empty table gives an empty result; other columns are kept by redact() and ignored
by found().
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import pii_table
from tracewright.llm.encode import TOKENIZERS

LABELS = ("", *pii_table.KINDS)
EPOCHS, BATCH, RATE, L2 = 6, 96, 0.15, 3e-5
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}\p{Cf}]*|[^\s\p{L}\p{M}\p{N}]")
_NUMBERS = regex.compile(r"(?<![\p{L}\p{N}])[-+]?\(?\p{N}+(?:[\s().\-/]{1,3}(?:\p{N}+|zero|one|two|three|four|five|six|seven|eight|nine)(?![\p{L}]))*", regex.I)
_DIGITS = regex.compile(r"\p{N}+|zero|one|two|three|four|five|six|seven|eight|nine", regex.I)
_NOT_SEPARATOR = regex.compile(r"[\p{N}\p{L}]")
_LETTERS, _NUMBER = regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+")
_MAIL_CHUNK = regex.compile(r"[^\s@]+@[^\s@]+\.[^\s@.]+")
_COMMAND_CHUNK = regex.compile(r"/[a-z]+")
_AT = regex.compile(r"[\p{L}\p{N}]\s?(?:@|[(\[{]\s?at\s?[)\]}]|\bat\b)\s?[\p{L}\p{N}]")
_DOT = regex.compile(r"\.|\bdot\b")
_HOUSE = regex.compile(r"(?<![\p{L}\p{N}])\p{N}+\p{L}{0,2}(?![\p{L}\p{N}])")
_TWO_LETTERS = regex.compile(r"\p{L}{2,}")
_NO_NAME = regex.compile(r"[\p{N}_/@]")
_MIXED = regex.compile(r"(?=.*\p{Latin})(?=.*[\p{Cyrillic}\p{Greek}\p{Armenian}])")
_STRETCHED = regex.compile(r"(\p{L})\1{2,}")
_PIECE, _LISTED = regex.compile(r"[^\s,;/|]+"), regex.compile(r"[^\n,;/|]*[^\s,;/|]")
_CACHE = 200_000
RUN_DIGITS = 5

_words = lambda s: frozenset(s.split())
_GIVEN = frozenset(pii_table.GIVEN)
_LANDFORMS = frozenset(pii_table.LANDFORMS)
_GAME = frozenset(pii_table.GAME)
_CREATURES = frozenset(pii_table.CREATURES)
_TALK = _words("msg tell w r reply whisper mail m ticket say helpop pm t me")
_NUMBER_WORDS = _words("zero one two three four five six seven eight nine")
_TITLES = _words("dr mr mrs ms prof herr frau señor señora monsieur madame sig mevrouw sir miss")
_STREETS = _words("street st road rd lane ln avenue ave drive dr court ct terrace row way close place pl crescent boulevard blvd square gardens mews parade walk circle parkway rue chemin impasse allée calle avenida paseo camino carrera via viale piazza corso plaza platz rua travessa praça straße strasse weg gasse allee laan plein kade")
_STREET_END = regex.compile(r"(?:straße|strasse|str|weg|gasse|allee|platz|ring|damm|ufer|steig|straat|laan|plein|kade|gatan|gata|vägen|veien|vej|gade)$")
#: what a run of numbers near such words is likely to be
_KEYS = {
    "id": _words("ssn social security passport identity id card insurance nhs medicare tax tin ein vat licence license driver driving permit visa aadhaar pan nino nin voter pension military certificate dni nie nif curp rfc cédula cedula carné afiliación pasaporte seguro ausweis ausweisnummer personalausweis reisepass passnummer reisepassnummer steuernummer steuer sozialversicherungsnummer versichertennummer versicherungsnummer führerschein führerscheinnummer krankenkassennummer sécu sécurité carte identité passeport permis fiscal fiscale vitale codice identità passaporto bsn burgerservicenummer rijbewijs paspoort cpf rg pesel personnummer"),
    "call": _words("phone call ring text texted tel telefon telefono teléfono móvil movil mobile mob cell cellphone handy handynummer telefonnummer festnetznummer whatsapp sms signal telegram portable téléphone cellulare telefone celular zap dial reach fax landline contact ruf ruft bel appelle rappelle contacte llama llámame llámanos márcame chiamami chiama buzz message"),
    "play": _words("coords coord coordinates tp teleport warp seed ticket case claim order plot lot chunk build version level lvl levels xp score points balance coins gold emeralds price ping fps queue issue bug request auction quest season x y z base row page code pin password track wave round update bank money record event map server lookup rollback ban"),
    "number": _words("number no nr nummer numéro numero número line"),
}
_KEY_OF = {w: k for k, ws in _KEYS.items() for w in ws}


@dataclass(frozen=True, eq=False)
class Words:
    """What the vocabularies tell of a word: how common it is in lower case, or that it is written with a capital only."""

    common: dict[str, str]
    names: frozenset[str]

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, folder: str = TOKENIZERS) -> Words:
        common: dict[str, str] = {}
        capital: set[str] = set()
        for which, name in enumerate(VOCABULARIES):
            path = os.path.join(folder, name)
            if not os.path.exists(path):
                continue
            with open(path, "rb") as f:
                for k, line in enumerate(f):
                    try:
                        w = base64.b64decode(line.split()[0]).decode()
                    except (UnicodeDecodeError, IndexError):
                        continue
                    if len(w) > 2 and w[0] == " " and w[1:].isalpha():
                        if w[1:].islower():
                            common.setdefault(w[1:], "m" if which else "1" if k < 6_000 else "2" if k < 20_000 else "3")
                        elif w[1].isupper():
                            capital.add(w[1:].lower())
        return cls(common, frozenset(capital - common.keys()))

    def kind(self, low: str) -> str:
        """The class of a word in lower case."""
        if low.isdigit():
            return "d"
        if _STRETCHED.search(low):
            return min((self.kind(_STRETCHED.sub(c, low)) for c in (r"\1", r"\1\1")), key=lambda k: k in "no")
        if not low.isascii() and _MIXED.match(low):
            return "z"
        if not low.isalpha():
            return "x" if low.isalnum() else low
        if low in _GIVEN:
            return "g"
        if low in _STREETS or (len(low) > 4 and _STREET_END.search(low)):
            return "s"
        if low in _LANDFORMS:
            return "l"
        if low in _CREATURES:
            return "b"
        if low in _NUMBER_WORDS:
            return "w"
        return "t" if low in _TITLES else self.common.get(low) or ("v" if low in _GAME else "n" if low in self.names else "o")


def _case(t: str, flat: bool) -> str:
    """How a word is written; in a message of capitals or capitalised words only that says nothing."""
    if not t[:1].isalpha():
        return ""
    return "f" if flat else "l" if t.islower() else ("U" if len(t) > 1 else "I") if t.isupper() else "C" if t[0].isupper() and t[1:].islower() else "M"


@lru_cache(maxsize=100_000)
def word_class(words: Words, t: str, flat: bool) -> str:
    return _case(t, flat) + words.kind(t.lower())


def _pattern(t: str) -> str:
    """Stretches of letters and digits with their lengths, as a2d7."""
    return "".join(f"{'d' if g[0].isdigit() else 'a'}{len(g)}" for g in regex.findall(r"\p{N}+|[^\p{N}]+", t))


def token_features(words: Words, t: str, flat: bool) -> list[str]:
    low = t.lower()
    kind = words.kind(low)
    case = _case(t, flat)
    out = [f"k={case}{kind}", f"K={kind}"]
    if kind not in "gnodx":
        out.append("w=" + low)  # names are known by their class and ending, never by themselves
    if t[0].isalpha():
        out += [f"e={low[-3:]}", f"E={low[-2:]}", f"l={min(len(t), 9)}", f"c={case}"]
    if any(c.isdigit() for c in t):
        out += [f"n={len(t)}", "f=" + _pattern(low)]
    return out


def near_features(words: Words, t: str, flat: bool) -> list[str]:
    low = t.lower()
    kind = words.kind(low)
    return [f"k={_case(t, flat)}{kind}", *(["w=" + low] if kind not in "gnodx" else [])]


def far_features(words: Words, t: str, flat: bool) -> list[str]:
    return near_features(words, t, flat)[1:]


@lru_cache(maxsize=50_000)
def chunk_features(c: str) -> list[str]:
    low = c.lower().strip(".,;:!?\"'")
    out = ["c=" + _NUMBER.sub("d", _LETTERS.sub("a", low))] if not low.isalpha() else []
    if _MAIL_CHUNK.fullmatch(low):
        out.append("mail")
    if "@" in low:
        out.append("@")
    if "_" in low:
        out.append("player" if any(x.isdigit() for x in low) else "under")
    if _COMMAND_CHUNK.fullmatch(low):
        out.append("command")
    return out


def run_features(r: str) -> list[str]:
    groups = _DIGITS.findall(r)
    lengths = [len(g) if g[0].isdigit() else 1 for g in groups]
    total = sum(lengths)
    size = next((k for k, n in enumerate((7, 9, 10, 11, 12, 14, 16)) if total < n), 7)
    lead = "-+(0".find(r[0])
    separators = "".join(sorted(set(_NOT_SEPARATOR.sub("", r))))
    return [f"t={size}", f"g={'-'.join(map(str, lengths))}", f"k={len(groups)}", f"p={lead}", f"s={separators}", f"t={size},p={lead}", f"n={total}"]


def context_features(c: tuple[str, str]) -> list[str]:
    """The nearest telling words before and behind a run of numbers."""
    return [f"before={c[0]}", f"behind={c[1]}", f"both={c[0]},{c[1]}"]


def command_features(chunk: str) -> list[str]:
    if not chunk.startswith("/"):
        return []
    c = chunk[1:].lower()
    return ["talk" if c in _TALK else "do"]


def is_flat(text: str) -> bool:
    return text.count(" ") >= 3 and (text.isupper() or text.istitle())


def cut(chunk: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(chunk)]


_HIDDEN = regex.compile(r"(?<=\p{L}|\p{M}|\p{N})\p{Cf}+")


def meant(token: str) -> str:
    """A token in plain letters, without invisible characters."""
    return _HIDDEN.sub("", unicodedata.normalize("NFKC", token))


@dataclass
class Sentence:
    text: str
    flat: bool
    chunks: list[str]
    spans: list[tuple[int, int]]
    tokens: list[str]
    chunk_of: list[int]


def numbers_in(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The numbers of a run: one, or several where each piece, or each repeat of uneven groups (3-3-4 3-3-4), is a phone number."""
    pieces = [(a + m.start(), a + m.end()) for m in _PIECE.finditer(text[a:b])]
    sizes = [_digits(text[x:y]) for x, y in pieces]
    if len(pieces) < 2:
        return [(a, b)]
    if all(7 <= n <= 15 for n in sizes):
        return pieces
    for unit in range(2, len(pieces) // 2 + 1):
        if len(pieces) % unit == 0 and sizes == sizes[:unit] * (len(pieces) // unit) and len(set(sizes[:unit])) > 1 and 7 <= sum(sizes[:unit]) <= 15:
            return [(pieces[k][0], pieces[k + unit - 1][1]) for k in range(0, len(pieces), unit)]
    return [(a, b)]


def read(text: str) -> Sentence:
    """Chunks and tokens of a message, with their places."""
    chunks = text.split()
    spans, tokens, chunk_of, at = [], [], [], 0
    for k, c in enumerate(chunks):
        start = text.index(c, at)
        at = start + len(c)
        for a, b in cut(c):
            spans.append((start + a, start + b))
            tokens.append(c[a:b] if c.isascii() else meant(c[a:b]))
            chunk_of.append(k)
    return Sentence(text, is_flat(text), chunks, spans, tokens, chunk_of)


def _telling(tokens: list[str]) -> str:
    """The nearest word that tells what a number is, ~ where it is farther off; a mere "number" only if there is no other."""
    keys = [(d, w) for d, t in enumerate(tokens) if (w := _KEY_OF.get(t.lower()))]
    d, w = next((x for x in keys if x[1] != "number"), keys[0] if keys else (0, ""))
    return w + "~" * (d > 3)


def number_runs(s: Sentence) -> list[tuple[int, int, str, tuple[str, str]]]:
    """First and last token of each run of RUN_DIGITS or more digits, its text, and the telling words near it."""
    out, k = [], 0
    for start, end in [x for m in _NUMBERS.finditer(s.text) for x in numbers_in(s.text, *m.span())]:
        while k < len(s.spans) and s.spans[k][1] <= start:
            k += 1
        j = k
        while j < len(s.spans) and s.spans[j][0] < end:
            j += 1
        if j > k and _digits(s.text[start:end]) >= RUN_DIGITS:
            out.append((k, j, s.text[start:end], (_telling(s.tokens[max(0, k - 7) : k][::-1]), _telling(s.tokens[j : j + 5]))))
        k = j
    return out


#: role and distance of the tokens whose features count
_ROLES: tuple[tuple[str, int, Callable], ...] = (("0", 0, token_features), ("-1", -1, near_features), ("+1", 1, near_features), ("-2", -2, near_features), ("+2", 2, near_features), ("-3", -3, far_features), ("+3", 3, far_features))
_CHUNK_ROLES = (("c0", 0), ("c-1", -1), ("c+1", 1))
EDGE = "\x02"


@lru_cache(maxsize=100_000)
def _role_features(role: str, own: Callable, words: Words, t: str, flat: bool) -> tuple[str, ...]:
    return tuple(f"{role}:{x}" for x in own(words, t, flat))


def features(words: Words, s: Sentence) -> list[list[str]]:
    """The features of each token, as training sees them."""
    pad = [EDGE] * 3
    tokens = [*pad, *s.tokens, *pad]
    classes = [word_class(words, t, s.flat) for t in tokens]
    chunks = [EDGE, *s.chunks, EDGE]
    command = command_features(s.chunks[0]) if s.chunks else []
    out = []
    for i in range(len(s.tokens)):
        f = [x for role, off, own in _ROLES for x in _role_features(role, own, words, tokens[i + 3 + off], s.flat)]
        f += [f"p+:{classes[i + 3]},{classes[i + 4]}", f"p-:{classes[i + 2]},{classes[i + 3]}", f"p++:{classes[i + 4]},{classes[i + 5]}", f"p--:{classes[i + 1]},{classes[i + 2]}"]
        f += [f"{role}:{x}" for role, off in _CHUNK_ROLES for x in chunk_features(chunks[s.chunk_of[i] + 1 + off])]
        out.append(f + [f"q:{x}" for x in command])
    for a, b, run, near in number_runs(s):
        more = [f"r:{x}" for x in run_features(run)] + [f"a:{x}" for x in context_features(near)]
        for i in range(a, b):
            out[i] += more
    return out


class _Rows:
    """Rows of numbers that grow."""

    def __init__(self, *shape: int, kind=np.float32):
        self.data, self.n = np.zeros((256, *shape), kind), 0

    def add(self, row) -> int:
        if self.n == len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n] = row
        self.n += 1
        return self.n - 1


class _Missing(dict):
    """A dictionary that makes what it lacks."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        v = self[key] = self.make(key)
        return v


class _Tables:
    """Scores of the parts seen so far: tokens, pairs of classes, chunks, runs."""

    def __init__(self, field: Field):
        k = len(LABELS)
        self.field = field
        self.token = [_Rows(k) for _ in _ROLES]
        self.cls = _Rows(kind=np.int64)
        self.classes: dict[str, int] = {}
        self.pair = _Missing(self._pair)
        self.chunk = [_Rows(k) for _ in range(len(_CHUNK_ROLES) + 1)]
        self.shapes: dict[tuple[str, ...], int] = {}  # chunks of the same features share a row
        self.shape = _Rows(kind=np.int64)
        self.start, self.count, self.digits = _Rows(kind=np.int64), _Rows(kind=np.int64), _Rows(kind=np.int64)
        self.pool = _Rows(kind=np.int64)
        self.tokens = _Missing(self._token)
        self.chunks = (_Missing(lambda c: self._chunk(c, False)), _Missing(lambda c: self._chunk(c, True)))
        self.run = _Missing(lambda r: field.sum("r", run_features(r)))
        self.near = _Missing(lambda c: field.sum("a", context_features(c)))
        edge = self._chunk(EDGE, False)  # id 0: three edge tokens, so that no window reaches over
        self.pool.add(0), self.pool.add(0)
        self.count.data[edge] = 3

    def _token(self, key: tuple[str, bool]) -> int:
        t, flat = key
        w = self.field.words
        for rows, (role, _, own) in zip(self.token, _ROLES):
            rows.add(self.field.sum(role, own(w, t, flat)))
        c = word_class(w, t, flat)
        return self.cls.add(self.classes.setdefault(c, len(self.classes)))

    def _chunk(self, c: str, flat: bool) -> int:
        norm = str if c.isascii() else meant
        ids = [self.tokens["0" * (b - a) if c[a:b].isdigit() else norm(c[a:b]), flat] for a, b in cut(c)]
        self.start.add(self.pool.n)
        for i in ids:
            self.pool.add(i)
        self.digits.add(_digits(c))
        feats, command = chunk_features(c), command_features(c)
        row = self.shapes.get((*feats, *command))
        if row is None:
            for rows, (role, _) in zip(self.chunk, _CHUNK_ROLES):
                rows.add(self.field.sum(role, feats))
            row = self.shapes[*feats, *command] = self.chunk[-1].add(self.field.sum("q", command))
        self.shape.add(row)
        return self.count.add(len(ids))

    def _pair(self, key: tuple[int, int]) -> np.ndarray:
        names = list(self.classes)
        x = f"{names[key[0]]},{names[key[1]]}"
        return np.stack([self.field.sum(role, [x]) for role in ("p+", "p-", "p++", "p--")])

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Scores of the pairs of neighbouring classes, by role."""
        n = len(self.classes)
        code, inverse = np.unique(a * n + b, return_inverse=True)
        rows = np.stack([self.pair[int(c) // n, int(c) % n] for c in code]) if len(code) else np.zeros((0, 4, len(LABELS)), np.float32)
        return rows[inverse]


class Field:
    """Weights of features (feature x label), of transitions, of starts; and their decoding."""

    def __init__(self, words: Words, names: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.words, self.names, self.weights, self.trans, self.start = words, names, weights, trans, start
        self._tables: _Tables | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def sum(self, role: str, feats: list[str]) -> np.ndarray:
        ids = [k for f in feats if (k := self.names.get(f"{role}:{f}")) is not None]
        return self.weights[ids].sum(axis=0) if ids else np.zeros(len(LABELS), np.float32)

    def scores(self, messages: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all tokens of all messages, and the ends of the messages."""
        t = self._tables
        if t is None or len(t.tokens) > _CACHE or len(t.chunks[0]) + len(t.chunks[1]) > _CACHE:
            t = self._tables = _Tables(self)
        plain, flat = (d.__getitem__ for d in t.chunks)
        ids: list[int] = [0]
        sizes = []
        for m in messages:
            parts = m.split()
            ids += map(flat if is_flat(m) else plain, parts)
            ids.append(0)
            sizes.append(len(parts))
        chunk = np.array(ids, np.int64)
        count = t.count.data[chunk]
        # tokens of all chunks, edges included
        first = np.cumsum(count) - count
        total = int(count.sum())
        token = t.pool.data[np.repeat(t.start.data[chunk] - first, count) + np.arange(total)]
        at_chunk = np.repeat(np.arange(len(chunk)), count)
        real = np.flatnonzero(chunk[at_chunk] != 0)
        out = np.zeros((len(real), len(LABELS)), np.float32)
        for rows, (_, off, _) in zip(t.token, _ROLES):
            out += rows.data[token[real + off]]
        cls = t.cls.data[token]
        pair = t.pairs(cls[:-1], cls[1:])
        out += pair[real, 0] + pair[real - 1, 1] + pair[real + 1, 2] + pair[real - 2, 3]
        c = at_chunk[real]
        shape = t.shape.data[chunk]
        for rows, (_, off) in zip(t.chunk, _CHUNK_ROLES):
            out += rows.data[shape[c + off]]
        sizes = np.array(sizes, np.int64)
        head = np.cumsum(sizes + 1) - sizes  # place of each message's first chunk (or of its edge)
        message_of = np.repeat(np.arange(len(messages)), sizes + 1)
        message_of = np.concatenate([[0], message_of])[c]
        out += t.chunk[-1].data[shape[head]][message_of]
        n_tokens = np.bincount(message_of, minlength=len(messages))
        ends = np.concatenate([[0], np.cumsum(n_tokens)])
        digits = np.add.reduceat(t.digits.data[chunk], head) if len(messages) else []
        for k in np.flatnonzero(np.asarray(digits) >= RUN_DIGITS).tolist():
            for a, b, run, near in number_runs(read(messages[k])):
                out[ends[k] + a : ends[k] + b] += t.run[run] + t.near[near]
            if len(t.run) > _CACHE:
                t.run.clear()
        return out, ends

    def decode(self, messages: list[str]) -> list[np.ndarray | None]:
        """Best labels of each message, None where all are empty; messages of like length are decoded together."""
        scores, ends = self.scores(messages)
        # a path can't beat the empty one where no token gains by its label and the best transitions into and out of it
        gain = max(0.0, float((self.trans - self.trans[0, 0]).max()), float((self.start - self.start[0]).max()))
        if len(scores):
            above = scores[:, 1:].max(axis=1) - scores[:, 0] + gain > 0
            # a stretch of labelled tokens has one transition more than tokens
            lively = np.add.reduceat(np.concatenate([above, [False]]).astype(np.int64), ends[:-1]) > 0
            lively &= np.diff(ends) > 0
        else:
            lively = np.zeros(len(messages), bool)
        sizes = np.diff(ends)
        out: list[np.ndarray | None] = [None] * len(messages)
        order = np.argsort(sizes, kind="stable")
        order = order[lively[order]]
        at = 0
        while at < len(order):
            size = sizes[order[at]]
            most = max(1, 400_000 // int(size))
            to = at
            while to < len(order) and to - at < most and sizes[order[to]] <= size + 2 + size // 8:
                to += 1
            for k, path in zip(order[at:to], self._viterbi([scores[ends[k] : ends[k + 1]] for k in order[at:to]])):
                if path.any():
                    out[k] = path
            at = to
        return out

    def _viterbi(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        n, k = max(map(len, parts)), len(LABELS)
        pad = np.zeros((len(parts), n, k), np.float32)
        size = np.array([len(p) for p in parts])
        for i, p in enumerate(parts):
            pad[i, : len(p)] = p
        best = pad[:, 0] + self.start
        back = np.zeros((n, len(parts), k), np.int8)
        for t in range(1, n):
            step = best[:, :, None] + self.trans
            back[t] = step.argmax(axis=1)
            best = np.where((t < size)[:, None], step.max(axis=1) + pad[:, t], best)
        path = np.zeros((len(parts), n), np.int8)
        now = best.argmax(axis=1)
        rows = np.arange(len(parts))
        for t in range(n - 1, -1, -1):
            path[:, t] = now
            if t:
                now = np.where(t < size, back[t, rows, now], now)
        return [path[i, :s] for i, s in enumerate(size)]


def _examples(rows: list[list[tuple[str, str]]]) -> list[tuple[Sentence, np.ndarray]]:
    out = []
    for row in rows:
        text, kind_at = "", []
        for s, k in row:
            text += s
            kind_at += [LABELS.index(k)] * len(s)
        s = read(text)
        if s.tokens:
            out.append((s, np.array([kind_at[a] for a, _ in s.spans])))
    return out


def train(seed: int = 7, folder: str = TOKENIZERS) -> Field:
    """The field of the whole labelled table; takes a few seconds and is the same every time."""
    return _trained(seed, folder)


@lru_cache(maxsize=2)
def _trained(seed: int, folder: str) -> Field:
    return trained(pii_table.labelled_table(seed), folder, seed)


def trained(rows: list[list[tuple[str, str]]], folder: str = TOKENIZERS, seed: int = 7) -> Field:
    """The field of labelled rows."""
    words = Words.load(folder)
    data = _examples(rows)
    feats = [features(words, s) for s, _ in data]
    count: dict[str, int] = {}
    for sent in feats:
        for fs in sent:
            for f in fs:
                count[f] = count.get(f, 0) + 1
    names = {f: k for k, f in enumerate(sorted(f for f, n in count.items() if n >= 5))}
    ids = [[np.array([names[f] for f in fs if f in names], np.int64) for fs in sent] for sent in feats]
    k = len(LABELS)
    w, trans, start = np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)
    gw, gt, gs = np.full_like(w, 1e-6), np.full_like(trans, 1e-6), np.full_like(start, 1e-6)
    rng = np.random.default_rng(seed)
    lengths = np.array([len(s.tokens) for s, _ in data])
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        batches = np.array_split(order[np.argsort(lengths[order] // 3, kind="stable")], max(1, len(order) // BATCH))
        for b in rng.permutation(len(batches)):
            _step(w, trans, start, gw, gt, gs, [(ids[j], data[j][1]) for j in batches[b]])
    return Field(words, names, w.astype(np.float32), trans.astype(np.float32), start.astype(np.float32))


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)


def _step(w, trans, start, gw, gt, gs, batch) -> None:
    """One adaptive gradient step on the log-likelihood of a batch, by forward and backward sums."""
    k = len(LABELS)
    size = np.array([len(y) for _, y in batch])
    n, m = size.max(), len(batch)
    flat = np.concatenate([x for ids, _ in batch for x in ids])
    counts = np.array([len(x) for ids, _ in batch for x in ids])
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    emit_flat = np.add.reduceat(w[flat], begin, axis=0)
    emit_flat[counts == 0] = 0
    emit, gold = np.zeros((m, n, k)), np.zeros((m, n), np.int64)
    where = np.concatenate([np.arange(s) + i * n for i, s in enumerate(size)])
    emit.reshape(-1, k)[where] = emit_flat
    gold.reshape(-1)[where] = np.concatenate([y for _, y in batch])
    alive = np.arange(n)[None] < size[:, None]
    fwd, bwd = np.zeros((m, n, k)), np.zeros((m, n, k))
    fwd[:, 0] = emit[:, 0] + start
    for t in range(1, n):
        fwd[:, t] = np.where(alive[:, t, None], _logsum(fwd[:, t - 1, :, None] + trans, 1) + emit[:, t], fwd[:, t - 1])
    z = _logsum(fwd[:, -1], 1)
    for t in range(n - 2, -1, -1):
        bwd[:, t] = np.where(alive[:, t + 1, None], _logsum(trans[None] + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
    prob = np.exp(fwd + bwd - z[:, None, None])
    d_emit = prob.copy()
    d_emit[np.arange(m)[:, None], np.arange(n)[None], gold] -= 1
    d_emit[~alive] = 0
    pair = np.exp(fwd[:, :-1, :, None] + trans + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
    pair[~alive[:, 1:]] = 0
    d_trans = pair.sum(axis=(0, 1))
    np.add.at(d_trans, (gold[:, :-1][alive[:, 1:]], gold[:, 1:][alive[:, 1:]]), -1)
    d_flat = d_emit.reshape(-1, k)[where]
    rows, inverse = np.unique(flat, return_inverse=True)
    d_w = np.zeros((len(rows), k))
    src = np.repeat(d_flat, counts, axis=0)
    for j in range(k):
        d_w[:, j] = np.bincount(inverse, src[:, j], minlength=len(rows))
    d_w = d_w / m + L2 * w[rows]
    gw[rows] += d_w**2
    w[rows] -= RATE * d_w / np.sqrt(gw[rows])
    for p, g, d in ((trans, gt, d_trans / m), (start, gs, d_emit[:, 0].sum(axis=0) / m)):
        g += d**2
        p -= RATE * d / np.sqrt(g)


def _digits(s: str) -> int:
    return sum(len(g) if g[0].isdigit() else 1 for g in _DIGITS.findall(s))


def plausible(kind: str, s: str) -> bool:
    """The exact check of a decoded span."""
    low = s.lower()
    if kind == "email":
        return _AT.search(low) is not None and _DOT.search(low) is not None
    if kind == "phone":
        return 7 <= _digits(s) <= 15
    if kind == "identity":
        return _digits(s) >= 5
    if kind == "address":
        return _HOUSE.search(s) is not None and _TWO_LETTERS.search(s) is not None
    return len(_TWO_LETTERS.findall(s)) >= 2 and _NO_NAME.search(s) is None


def parts(kind: str, text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The items of a joined span: itself, or several where blanks or separators part it into items that stand the check."""
    cut = lambda pattern: [(a + m.start(), a + m.end()) for m in pattern.finditer(text[a:b]) if not m[0].isspace()]
    good = lambda found: len(found) > 1 and all(plausible(kind, text[x:y]) for x, y in found)
    pieces = cut(_PIECE)
    if kind == "phone":
        found = numbers_in(text, a, b)
        return found if good(found) else [(a, b)] if plausible(kind, text[a:b]) else _numbers(text, pieces)
    if kind == "email" and good(pieces):
        return pieces
    if kind == "identity" and good(pieces) and all(_digits(text[x:y]) >= 8 for x, y in pieces):
        return pieces
    if kind == "person":
        found, words = [], cut(_PIECE)
        for k, (x, y) in enumerate(words):
            if not found or (k - found[-1][2] >= 2 and k + 1 < len(words) and text[x:y].lower() in _GIVEN):
                found.append((x, y, k))
            found[-1] = (found[-1][0], y, found[-1][2])
        if good([f[:2] for f in found]):
            return [f[:2] for f in found]
    found = cut(_LISTED) if kind in ("person", "address") else []
    if kind == "address":
        found = found if "," not in text[a:b] else []  # a comma parts street and town
    return found if good(found) else [(a, b)]


def _numbers(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pieces of a span that is no number by itself, in numbers next to each other: all of the digits, else the most; then as even as can be."""
    best: list[tuple[int, int, list[tuple[int, int]]]] = [(0, 0, [])]
    sizes = [_digits(text[x:y]) for x, y in pieces]
    for j in range(1, len(pieces) + 1):
        options = [best[j - 1]]
        total = 0
        for i in range(j - 1, -1, -1):
            total += sizes[i]
            if total > 15:
                break
            if total >= 7:
                options.append((best[i][0] + total, best[i][1] - total * total, [*best[i][2], (pieces[i][0], pieces[j - 1][1])]))
        best.append(max(options, key=lambda o: o[:2]))
    return best[-1][2]


def entities(s: Sentence, path: np.ndarray) -> list[tuple[int, int, str]]:
    """Start, end and kind of each span that stands the check; neighbours of one kind are parted first."""
    out, i = [], 0
    while i < len(path):
        j = i
        while j < len(path) and path[j] == path[i]:
            j += 1
        if path[i]:
            kind = LABELS[path[i]]
            for a, b in parts(kind, s.text, s.spans[i][0], s.spans[j - 1][1]):
                if plausible(kind, s.text[a:b]):
                    out.append((a, b, kind))
        i = j
    return out


def find(model: Field, messages: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Entities of each message; equal messages are decoded once."""
    texts = list(dict.fromkeys(m for m in messages if m))
    found = {m: entities(read(m), p) if p is not None else [] for m, p in zip(texts, model.decode(texts))}
    return [found[m] if m else [] for m in messages]


def replace(message: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in found:
        out += [message[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, message[at:]])


def _worker(model: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, list[str]]] = {}
        for batch in batches:
            messages = batch.column(batch.num_columns - 1).to_pylist()
            if len(known) > _CACHE:
                known.clear()
            new = [m for m in dict.fromkeys(messages) if m and m not in known]
            for m, f in zip(new, find(model, new)):
                known[m] = (replace(m, f) if f else m, sorted({k for _, _, k in f}))
            done = [known[m] if m else (m, []) for m in messages]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([m for m, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))],
                names=[*batch.schema.names[:-1], "clean", "kinds"],
            )

    return run


def _decoded(logs: dict[str, DataFrame], id_col: str, message: str, seed: int) -> DataFrame:
    union = None
    for name, df in logs.items():
        part = df.select(F.lit(name).alias("log_name"), F.col(id_col).cast("long").alias("entry_id"), F.col(message).alias("message"))
        union = part if union is None else union.unionByName(part)
    return union.mapInArrow(_worker(train(seed)), "log_name string, entry_id bigint, clean string, kinds array<string>")


def redact(logs: dict[str, DataFrame], id_col: str = "id", message: str = "message", seed: int = 7) -> DataFrame:
    """log_name, entry_id, message with placeholders, kinds; one row for each entry."""
    out = _decoded(logs, id_col, message, seed).dropDuplicates(["log_name", "entry_id"])
    return out.select("log_name", "entry_id", F.col("clean").alias("message"), "kinds")


def found(logs: dict[str, DataFrame], id_col: str = "id", message: str = "message", seed: int = 7) -> DataFrame:
    """log_name, entry_id, kind: one row for each kind of personal information in an entry."""
    return _decoded(logs, id_col, message, seed).select("log_name", "entry_id", F.explode("kinds").alias("kind")).distinct()

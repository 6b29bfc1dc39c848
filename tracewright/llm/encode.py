"""Byte-level BPE encoding by prefix dynamic programming.

In byte-pair encoding every prefix of a piece has exactly one encoding, so it has one last token. The table of a
piece keeps that token for each prefix: of the vocabulary tokens that end there, the one whose preceding prefix ends
in a token it may follow. Two tokens may follow each other when undoing their merges, latest first, never meets a
pair that would have been merged earlier. The encoding is read backwards from the end. A table can be appended to,
and after an edit only the entries from the edit on are computed again, until they meet the old ones.

Vocabulary files are read where the work is done, from a folder that is a parameter.

Cases: null and empty texts have an empty list; special tokens' strings are ordinary text; very long texts and
pieces are encoded whole; repeated rows are encoded each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Fixed value: the public splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE = 300_000


class Vocabulary:
    """Ranks of byte strings, the pair each token was merged from, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {r: w for w, r in ranks.items()}
        self.endings = {w[k:] for w in ranks for k in range(len(w))}
        self.longest = max(map(len, ranks))
        self._split: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, folder: str, name: str) -> Vocabulary:
        with open(os.path.join(folder, name), "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def age(self, token: int) -> int:
        """When a token came to be: single bytes are there from the start."""
        return -1 if len(self.words[token]) == 1 else token

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if its bytes never encode to it (single bytes aside)."""
        if token not in self._split:
            w, found = self.words[token], None
            for k in range(1, len(w)):
                a, b = self.ranks.get(w[:k]), self.ranks.get(w[k:])
                if a is not None and b is not None and self.age(a) < token and self.age(b) < token and self._reachable(a) and self._reachable(b) and self._meet(a, b, token):
                    found = (a, b)
                    break
            self._split[token] = found
        return self._split[token]

    def _reachable(self, token: int) -> bool:
        return len(self.words[token]) == 1 or self.split(token) is not None

    def _meet(self, a: int, b: int, limit: int) -> bool:
        """Whether a and b stay apart under the merges older than limit, seen backwards in time.

        Of a and b the younger is undone. The pair in front of it then existed until the undone merge, so it must not
        merge before that; of equal merges the left one comes first.
        """
        while True:
            both = self.ranks.get(self.words[a] + self.words[b])
            if both is not None and both < limit:
                return False
            x, y = self.age(a), self.age(b)
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, a = x, self.split(a)[1]
            else:
                limit, b = y + 1, self.split(b)[0]

    def follows(self, a: int, b: int) -> bool:
        known = self._follows.get((a, b))
        if known is None:
            if len(self._follows) > _CACHE:
                self._follows.clear()
            known = self._follows[a, b] = self._meet(a, b, len(self.words) + 1)
        return known

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The last token of data[:end], given those of all shorter prefixes (last[k] for data[:k])."""
        ends, start = [], end - 1
        while start >= 0 and (w := data[start:end]) in self.endings:
            if (t := self.ranks.get(w)) is not None:
                ends.append((start, t))
            start -= 1
        for start, t in reversed(ends):
            if self._reachable(t) and (start == 0 or self.follows(last[start], t)):
                return t
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, text: str) -> list[int]:
        """Token ids of a text, piece by piece."""
        out: list[int] = []
        for piece in _pattern().findall(text):
            ids = self._pieces.get(piece)
            if ids is None:
                ids = tuple(PrefixTable(self, piece.encode("utf-8", "replace")).tokens())
                if len(piece) <= 64:
                    if len(self._pieces) > _CACHE:
                        self._pieces.clear()
                    self._pieces[piece] = ids
            out.extend(ids)
        return out


class PrefixTable:
    """The last token of every prefix of a piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self.vocabulary.last_token(self.data, end, self.last))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts data for self.data[start:end]; returns how many entries were computed again."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[: start + 1]
        same, done = 0, 0
        for at in range(start + 1, len(self.data) + 1):
            if same >= self.vocabulary.longest:  # entries depend on that many before them, and on bytes after the edit only
                self.last += old[at - shift :]
                break
            t = self.vocabulary.last_token(self.data, at, self.last)
            self.last.append(t)
            done += 1
            past = at - len(data) - start  # bytes after the edit so far
            same = same + 1 if past > 0 and old[at - shift] == t else 0
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.words[out[-1]])
        return out[::-1]


@lru_cache(maxsize=4)
def vocabulary(folder: str = TOKENIZERS, name: str = BYTE_BPE) -> Vocabulary:
    return Vocabulary.load(folder, name)


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


def _encoder(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(folder, name)
        for batch in batches:
            ids = [v.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            if ends[-1] < 2**31 - 1:
                flat = np.fromiter((x for one in ids for x in one), np.int32, int(ends[-1]))
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            else:
                column = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "ids"])

    return run


def encode(documents: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = BYTE_BPE) -> DataFrame:
    """{id} and ids, the token ids of each text without special tokens."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encoder(folder, name), "doc_id bigint, ids array<int>").withColumnRenamed("doc_id", id_col)

"""Evaluation passages inside a corpus: a BM25 index of the passages, searched by block-max WAND, then verified.

The evaluation items are indexed; terms are pairs of neighbouring words, as single ones are shared by all texts of a
language: per term the items that hold it and its BM25 weight there, the largest weight of the term, and the largest
in each block of BLOCK items, all in flat arrays. Every passage of a document (WINDOW words,
overlapping by OVERLAP) is a query. An item must be found when WORDS words in a row of it occur with at most EDITS of
them changed, each of which costs two terms; the least BM25 score that is left is known for each item, and weights are divided by it, so
a score of 1 is the threshold and nothing above it is missed. The queries of a whole batch are bounded at once: first
by the largest weights of their terms, then by block maxima, where the longest lists, which together can't reach the
threshold, are skipped, so that the work follows the lists of rare terms and not the number of items. WAND searches
the blocks that are left. Found items are verified: every WORDS words in a row by edit distance, longer stretches by
local alignment.

The index is built and broadcast in shards of at most ITEMS items, a fixed bound (some 2 kB an item); each further
shard makes one more pass over the documents, never a larger broadcast, and only one is held on the driver at a time.

Cases: null, empty or blank texts and passages match nothing; a passage of fewer than WORDS words matches nothing;
repeated rows give one result row; very long texts are searched whole, window by window; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from functools import reduce
from operator import itemgetter
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, EDITS = 18, 3
WINDOW, OVERLAP = 48, 24
BLOCK, ITEMS = 4, 50_000
K1, B = 1.2, 0.75
SKIPPED = 0.4  # what the skipped lists of a query may add up to; changes the work only
EXPANDED = 4_000_000  # block maxima added up at a time
_TAG = regex.compile(r"</?[A-Za-z!][^<>]*>|\[/?[a-z]{1,10}\]|https?://\S+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+")
_PLAIN_QUOTE = re.compile(r"(?<=[A-Za-z])'(?=[A-Za-z])")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Cc}\p{Mn}--[\t\n\r]]+", regex.V1)
_QUOTE = regex.compile(r"(?<=\p{L})(?:['’`´ʼ]|â€™)(?=\p{L})")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Words without case, punctuation, markup, accents and invisible characters."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "[" in text or "://" in text:
        text = _TAG.sub(" ", text)
    if text.isascii() and text.isprintable():  # the same in fewer steps
        return _PLAIN_WORD.findall((_PLAIN_QUOTE.sub("", text) if "'" in text else text).lower())
    return _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKD", _QUOTE.sub("", text)).casefold()))


_item = itemgetter(0)


class Index:
    """Inverted index of passages; weights are scaled so that an item's threshold is 1."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        number = self.number
        passages = [np.array([number.setdefault(w, len(number)) for w in words(p)], np.int32) for _, p in items]
        size = np.array([len(p) for p in passages], np.int64)
        self.text = np.concatenate([*passages, np.zeros(0, np.int32)])
        self.ends = np.concatenate([[0], np.cumsum(size)])
        # all pairs of neighbours, by item
        owner = np.repeat(np.arange(len(items)), size)
        inside = np.append(owner[1:] == owner[:-1], False)[: len(owner)]
        codes = self._codes(self.text, np.append(self.text[1:], 0)[: len(self.text)])
        self.terms, term = np.unique(codes[inside], return_inverse=True)
        vocabulary = max(1, len(self.terms))
        at_item = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))])
        pair, times = np.unique(owner[inside] * vocabulary + term, return_counts=True)
        item, word = pair // vocabulary, pair % vocabulary
        held = np.bincount(word, minlength=vocabulary)
        mean = size.mean() if len(items) else 1.0
        weight = np.log(1 + (len(items) - held[word] + 0.5) / (held[word] + 0.5)) * times * (K1 + 1) / (times + K1 * (1 - B + B * size[item] / max(mean, 1e-9)))
        least = np.zeros(len(items))
        first = np.searchsorted(item, np.arange(len(items) + 1))
        for k in range(len(items)):
            least[k] = self._least(term[at_item[k] : at_item[k + 1]], word[first[k] : first[k + 1]], weight[first[k] : first[k + 1]])
        #: items without a threshold, as some WORDS words in a row hold EDITS different words at most: verified in every window
        self.plain = [k for k in range(len(items)) if least[k] <= 0 and size[k] >= WORDS]
        keep = least[item] > 0
        item, word, scaled = item[keep], word[keep], (weight[keep] / least[item[keep]]).astype(np.float32)
        order = np.lexsort((item, word))
        self.items, self.weights, word = item[order].astype(np.int32), scaled[order], word[order]
        self.n_items = len(items)
        self.item_key = word * self.n_items + self.items
        self.start = np.searchsorted(word, np.arange(vocabulary + 1))
        # block maxima of each term, in the order of its list
        block = word * (len(items) // BLOCK + 1) + self.items // BLOCK
        head = np.flatnonzero(np.diff(block, prepend=-1))
        self.block = (self.items[head] // BLOCK).astype(np.int32)
        self.block_key = block[head]
        self.block_top = np.maximum.reduceat(self.weights, head) if len(head) else np.zeros(0, np.float32)
        self.block_start = np.searchsorted(head, self.start)
        self.top = np.zeros(vocabulary)
        listed = np.flatnonzero(np.diff(self.block_start))
        if len(listed):
            self.top[listed] = np.maximum.reduceat(self.block_top, self.block_start[listed])
        self.n_blocks = len(items) // BLOCK + 1

    @staticmethod
    def _least(terms: np.ndarray, known: np.ndarray, weights: np.ndarray) -> float:
        """The least score that WORDS words in a row leave when EDITS of them are changed, of an item's terms in order."""
        if len(terms) < WORDS - 1:
            return 0.0
        at = np.searchsorted(known, terms)
        rows = np.sort(np.lib.stride_tricks.sliding_window_view(at, WORDS - 1), axis=1)
        again = np.zeros(rows.shape, bool)
        again[:, 1:] = rows[:, 1:] == rows[:, :-1]  # a term counts once
        own = -np.sort(-np.where(again, 0.0, weights[rows]), axis=1)
        return float(own[:, 2 * EDITS :].sum(axis=1).min()) * (1 - 1e-5)

    def _codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.asarray(a, np.int64) * (len(self.number) + 1) + b

    def terms_of(self, numbers: np.ndarray) -> np.ndarray:
        """The term that each word of a text makes with the next one, -1 where it is none."""
        a, b = numbers, np.append(numbers[1:], -1)[: len(numbers)]
        code = np.where((a >= 0) & (b >= 0), self._codes(a, b), -1)
        if not len(self.terms):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.terms, code), len(self.terms) - 1)
        return np.where(self.terms[at] == code, at, -1)

    def passage(self, k: int) -> list[int]:
        return self.text[self.ends[k] : self.ends[k + 1]].tolist()

    def numbers(self, text: str | None) -> list[int]:
        """The words of a text by number, -1 for those of no passage."""
        get = self.number.get
        return [get(w, -1) for w in words(text)]

    def search(self, query: np.ndarray, word: np.ndarray, n_queries: int) -> list[tuple[int, int]]:
        """(query, position of item) of all items whose score reaches 1; of pairs (query, term), sorted and different."""
        alive = np.bincount(query, self.top[word], minlength=n_queries) >= 1 - 1e-6
        keep = alive[query] & (self.top[word] > 0)
        query, word = query[keep], word[keep]
        if not len(query):
            return []
        length = np.diff(self.block_start)[word]
        order = np.lexsort((-length, query))
        query, word, length = query[order], word[order], length[order]
        run = np.cumsum(self.top[word])
        head = np.flatnonzero(np.diff(query, prepend=-1))
        within = run - np.repeat(run[head] - self.top[word[head]], np.diff(np.append(head, len(query))))
        skipped = within < SKIPPED  # the longest lists of a query, which can't reach the threshold by far
        rest = np.bincount(query, np.where(skipped, self.top[word], 0.0), minlength=n_queries)
        eq, ew, en = query[~skipped], word[~skipped], length[~skipped]
        out: list[tuple[int, int]] = []
        done = np.cumsum(en)
        at = 0
        while at < len(eq):  # whole queries, as many as fit
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + EXPANDED, side="right")))
            to = int(np.searchsorted(eq, eq[to - 1], side="right"))
            n = en[at:to]
            begin = np.cumsum(n) - n
            place = np.repeat(self.block_start[ew[at:to]] - begin, n) + np.arange(int(n.sum()))
            code, inverse = np.unique(np.repeat(eq[at:to], n) * self.n_blocks + self.block[place], return_inverse=True)
            bound = np.bincount(inverse, self.block_top[place]) + rest[code // self.n_blocks]
            out += self._searched(self._bounded(code[bound >= 1 - 1e-5], query, word), query, word)
            at = to
        return out

    def _spread(self, code: np.ndarray, query: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (query, block) code all words of the query: places in ``code``, and words."""
        q = code // self.n_blocks
        lo = np.searchsorted(query, q)
        n = np.searchsorted(query, q, side="right") - lo
        begin = np.cumsum(n) - n
        return np.repeat(np.arange(len(code)), n), word[np.repeat(lo - begin, n) + np.arange(int(n.sum()))]

    def _bounded(self, code: np.ndarray, query: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Those (query, block) codes which the block maxima of all words of the query let reach the threshold."""
        which, w = self._spread(code, query, word)
        wanted = w * self.n_blocks + (code % self.n_blocks)[which]
        at = np.minimum(np.searchsorted(self.block_key, wanted), len(self.block_key) - 1)
        top = np.where(self.block_key[at] == wanted, self.block_top[at], 0.0)
        return code[np.bincount(which, top, minlength=len(code)) >= 1 - 1e-5]

    def _searched(self, code: np.ndarray, query: np.ndarray, word: np.ndarray) -> list[tuple[int, int]]:
        """(query, position of item) of the items of the given blocks whose score reaches 1."""
        which, w = self._spread(code, query, word)
        first = (code % self.n_blocks)[which] * BLOCK
        lo = np.searchsorted(self.item_key, w * self.n_items + first)
        hi = np.searchsorted(self.item_key, w * self.n_items + np.minimum(first + BLOCK, self.n_items))
        some = lo < hi
        which, lo, hi = which[some], lo[some].tolist(), hi[some].tolist()
        out: list[tuple[int, int]] = []
        bounds = np.searchsorted(which, np.arange(len(code) + 1)).tolist()
        for c, a, e in zip(code.tolist(), bounds, bounds[1:]):
            q, b = divmod(c, self.n_blocks)
            lists = [(self.items[x:y].tolist(), self.weights[x:y].tolist()) for x, y in zip(lo[a:e], hi[a:e])]
            out += [(q, k) for k in self._wand(lists, min((b + 1) * BLOCK, self.n_items))]
        return out

    @staticmethod
    def _wand(lists: list[tuple[list[int], list[float]]], end: int) -> list[int]:
        """Items before end whose score reaches 1: the lists in front of the pivot, which can't reach it alone, skip to it."""
        cursors = [[items[0], 0, items, weights, max(weights)] for items, weights in lists]
        found = []
        while cursors:
            cursors.sort(key=_item)
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[4]
                if bound >= 1:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                    pivot += 1
                if sum(c[3][c[1]] for c in cursors[: pivot + 1]) >= 1:
                    found.append(item)
                goal = item + 1
            else:
                goal = item
            done = False
            for c in cursors[: pivot + 1]:
                at, items = c[1], c[2]
                while at < len(items) and items[at] < goal:
                    at += 1
                c[0], c[1] = (items[at] if at < len(items) else end), at
                done |= c[0] >= end
            if done:
                cursors = [c for c in cursors if c[0] < end]
        return found

    def leaked(self, texts: list[str | None]) -> list[set[int]]:
        """Of each text, the ids of the items that it contains."""
        step = WINDOW - OVERLAP
        assert WINDOW == 2 * step  # each place lies in two windows
        docs = [self.numbers(t) for t in texts]
        size = np.array([len(d) for d in docs], np.int64)
        windows = np.where(size > 0, np.maximum(1, -(-(size - OVERLAP) // step)), 0)
        base = np.cumsum(windows) - windows
        doc = np.repeat(np.arange(len(docs)), size)
        word = self.terms_of(np.array([w for d in docs for w in d], np.int64))
        word[np.cumsum(size)[size > 0] - 1] = -1  # no term reaches into the next text
        last = (np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)) // step
        vocabulary = len(self.top)
        keys = []
        for j in (last, last - 1):
            ok = (j >= 0) & (j < windows[doc]) & (word >= 0)
            keys.append((base[doc[ok]] + j[ok]) * vocabulary + word[ok])
        key = np.unique(np.concatenate(keys))
        n = int(windows.sum())
        hits = self.search(key // vocabulary, key % vocabulary, n)
        if self.plain:
            hits += [(q, k) for q in range(n) for k in self.plain]
        out: list[set[int]] = [set() for _ in docs]
        owner = np.repeat(np.arange(len(docs)), windows)
        at, near, grams, have = -1, [], set(), set()
        for q, k in sorted(hits):
            d = int(owner[q])
            if self.ids[k] in out[d]:
                continue
            if q != at:
                s = int(q - base[d]) * step
                near = docs[d][max(0, s - OVERLAP) : s + WINDOW + OVERLAP]
                at, grams, have = q, set(zip(near, near[1:], near[2:])), set(near)
            p = self.passage(k)
            if dense(p, grams, have) and contains(p, near):
                out[d].add(self.ids[k])
        return out


def dense(passage: list[int], grams: set[tuple[int, int, int]], have: set[int]) -> bool:
    """Whether some WORDS words in a row of the passage are all but EDITS in the text, and enough of them there in threes.

    A leak must: EDITS changed words leave EDITS + 1 pieces of WORDS - EDITS words, and at worst all but one of the pieces
    are of two words.
    """
    hits = [i for i, g in enumerate(zip(passage, passage[1:], passage[2:])) if g in grams]
    if len(hits) < WORDS - 3 * EDITS - 2:
        return False
    threes = [0] * len(passage)
    for i in hits:
        threes[i] = threes[i + 1] = threes[i + 2] = 1
    there = [w in have for w in passage]
    n_there, n_threes = sum(there[:WORDS]), sum(threes[:WORDS])
    for end in range(WORDS, len(passage) + 1):
        if n_there >= WORDS - EDITS and n_threes >= WORDS - 3 * EDITS:
            return True
        if end < len(passage):
            n_there += there[end] - there[end - WORDS]
            n_threes += threes[end] - threes[end - WORDS]
    return False


def contains(passage: list[int], text: list[int]) -> bool:
    """Whether WORDS words in a row of the passage occur in the text, with about one in ten changed, left out or added.

    Every WORDS words are tried by themselves, as the best alignment may join two quotes over a gap that is too wide for
    it; only then longer stretches, whose changes may lie closer in places.
    """
    have = set(text)
    there = [w in have for w in passage]
    for s in range(len(passage) - WORDS + 1):
        if sum(there[s : s + WORDS]) >= WORDS - EDITS and fitting(passage[s : s + WORDS], text) <= EDITS:
            return True
    span, edits = best_stretch(passage, text)[:2]
    return span >= WORDS and edits <= max(EDITS, 0.2 * span)


def best_stretch(a: list[int], b: list[int]) -> tuple[int, int, int, int, int]:
    """Local alignment (match 1, edit -2) of best score: words of a in it, edits, its start and end in a, its end in b."""
    n = len(b)
    score, start, edit = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best = (0, 0, 0, 0, 0, 0)
    for i, x in enumerate(a, 1):
        s0, t0, e0 = [0] * (n + 1), [i] * (n + 1), [0] * (n + 1)
        left, left_t, left_e = 0, i, 0
        for j in range(1, n + 1):
            if x == b[j - 1]:
                v, t, e = score[j - 1] + 1, start[j - 1] if score[j - 1] else i - 1, edit[j - 1] if score[j - 1] else 0
            else:
                v, t, e = score[j - 1] - 2, start[j - 1], edit[j - 1] + 1
                if score[j] - 2 > v:
                    v, t, e = score[j] - 2, start[j], edit[j] + 1
                if left - 2 > v:
                    v, t, e = left - 2, left_t, left_e + 1
                if v <= 0:
                    v, t, e = 0, i, 0
            s0[j], t0[j], e0[j] = left, left_t, left_e = v, t, e
            if v > best[0]:
                best = (v, i - t, e, t, i, j)
        score, start, edit = s0, t0, e0
    return best[1:]


def fitting(a: list[int], b: list[int]) -> int:
    """Least edits to find all of a somewhere in b, by the bits of a column at once (Myers)."""
    if not a:
        return 0
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits = full, 0, len(a)
    least = edits
    for y in b:
        same = at.get(y, 0)
        diagonal = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        if more & last:
            edits += 1
        elif less & last:
            edits -= 1
            least = min(least, edits)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(diagonal | more)), more & diagonal
    return least


def _finder(index: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(f) for f in index.value.leaked(batch.column(1).to_pylist())]
            docs = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([e for f in found for e in f], pa.int32())], names=["doc_id", "eval_id"])

    return run


def item_blocks(items: DataFrame, id_col: str, passage: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ITEMS, streamed partition by partition."""
    block = []
    for r in items.select(F.col(id_col).cast("int").alias("i"), F.col(passage).alias("p")).dropna().distinct().toLocalIterator():
        block.append((r.i, r.p))
        if len(block) == ITEMS:
            yield sorted(block)
            block = []
    if block:
        yield sorted(block)


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "eval_id", passage: str = "passage") -> DataFrame:
    """{id}, {item}: each document with each item of which it holds WORDS or more words in a row."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sc = documents.sparkSession.sparkContext
    parts = [rows.mapInArrow(_finder(sc.broadcast(Index(block))), "doc_id bigint, eval_id int") for block in item_blocks(items, item_col, passage)]
    if not parts:
        parts = [rows.select("doc_id", F.lit(None).cast("int").alias("eval_id")).where(F.lit(False))]
    return reduce(DataFrame.unionByName, parts).distinct().withColumnsRenamed({"doc_id": id_col, "eval_id": item_col})


def leaked_items(found: DataFrame, item_col: str = "eval_id") -> DataFrame:
    """Of each leaked item, the number of documents that hold it."""
    return found.groupBy(item_col).agg(F.count(F.lit(1)).alias("n_documents"))

"""Runs of equal or nearly equal consecutive messages, by optimal segmentation.

Per user, messages in order of (time, id) are cut into runs. A segmentation costs a penalty for every run plus the
dissimilarity of the neighbours inside runs. Dissimilarity is graded: 0 for messages that are the same after folding,
EDIT_COST for each of at most two mistyped characters in messages of a dozen characters or more; 1 and the changed
share of the text for other messages, 1 and the pause in units of the largest one beyond that. The cheapest
segmentation is found by pruned dynamic programming over all messages: after each one, the run starts which cannot be
part of a better solution any more are dropped, so that few stay open. With the penalty of 1 it cuts just where two
neighbours are neither the same nor nearly so, which is what the problem asks for; a smaller penalty asks for more likeness.

A user with a third of all messages is worked off in (user, time bucket) groups. As the cost is a sum over neighbours,
the optimum of a bucket doesn't depend on what lies outside; the pieces at the edges of buckets, at most two a bucket,
meet per user and are segmented once more by the same program, with the dissimilarities over the edges.

Cases: rows without user, time, id or message are left out; re-delivered rows count once; ties in time are ordered by
id; empty messages (and those of symbols only) are equal to each other; very long texts are compared whole; empty
tables have no runs; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.frames import bucket, whole_groups

PENALTY, EDIT_COST, MAX_EDITS, LONG = 1.0, 0.25, 2, 12
BUCKET_SECONDS = 3600
_DROP = regex.compile(r"[^\p{L}\p{M}]+")
_STRETCH = regex.compile(r"(.)\1+")


def fold(message: str) -> tuple[str, int]:
    """Letters only, without case, blanks, punctuation, symbols, digits and stretching; and its length with blanks."""
    words = [w for w in _DROP.split(unicodedata.normalize("NFKC", message).casefold()) if w]
    return _STRETCH.sub(r"\1", "".join(words)), sum(len(_STRETCH.sub(r"\1", w)) for w in words) + max(0, len(words) - 1)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def edits(a: str, b: str, most: int = MAX_EDITS) -> int:
    """Levenshtein distance, or most + 1 where it is larger; common stretches are skipped at memory speed."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    at = _common(a, b)
    a, b = a[at:], b[at:]
    if not a or not b:
        return max(len(a), len(b))
    if most == 0:
        return 1
    return 1 + min(edits(a[1:], b[1:], most - 1), edits(a[1:], b, most - 1), edits(a, b[1:], most - 1))


def dissimilarity(a: tuple[str, int], b: tuple[str, int], pause: int, max_gap: int) -> float:
    """Of two neighbours, from their folded texts and the pause between them; below 1 where they may belong together."""
    if pause > max_gap:
        return 1 + pause / max(1, max_gap)
    if a[0] == b[0]:
        return 0.0
    n, size = edits(a[0], b[0]), max(a[1], b[1])
    return n * EDIT_COST if n <= MAX_EDITS and size >= LONG else 1 + min(1.0, n / max(1, size))


def segment(links: list[float], penalty: float = PENALTY) -> list[int]:
    """Starts of the runs of the cheapest segmentation of len(links) + 1 events; links[k] is the dissimilarity of k and k + 1."""
    never = penalty * (len(links) + 2)  # dearer than cutting everywhere
    total = [0.0]
    for c in links:
        total.append(total[-1] + min(c, never))
    best, back, open_starts = [0.0], [], []
    for i in range(len(links) + 1):
        open_starts.append(i)
        cost, start = min((best[j] + penalty + total[i] - total[j], j) for j in open_starts)
        best.append(cost)
        back.append(start)
        open_starts = [j for j in open_starts if best[j] + total[i] - total[j] < cost]
    out, i = [], len(links)
    while i >= 0:
        out.append(back[i])
        i = back[i] - 1
    return out[::-1]


_PIECES = "u bigint, seg bigint, b bigint, first bigint, last bigint, low bigint, ids array<bigint>, f_text string, f_len int, l_text string, l_len int"
_EDGE = -(1 << 62)  # seg of pieces that may go on in a neighbour bucket
_RUNS = "u bigint, run_id bigint, n bigint, first bigint, last bigint, ids array<bigint>"


def _pieces(max_gap: int, keep_single: bool, penalty: float):
    """Runs within (user, bucket) groups; those at a group's ends are pieces that may go on beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, int]] = {}
        for t in whole_groups(batches, ["u", "b"]):
            u, b, time, i = (t.column(k).to_numpy() for k in ("u", "b", "t", "i"))
            text = t.column("m").to_pylist()
            new = np.ones(len(u), dtype=bool)
            new[1:] = (i[1:] != i[:-1]) | (time[1:] != time[:-1]) | (u[1:] != u[:-1])
            at = np.flatnonzero(new)
            u, b, time, i, text = u[at], b[at], time[at], i[at], [text[k] for k in at]
            folded = []
            for m in text:
                f = seen.get(m)
                if f is None:
                    if len(seen) > 50_000:
                        seen.clear()
                    f = seen[m] = fold(m)
                folded.append(f)
            group = np.ones(len(u), dtype=bool)
            group[1:] = (u[1:] != u[:-1]) | (b[1:] != b[:-1])
            bounds = [*np.flatnonzero(group).tolist(), len(u)]
            pause = np.diff(time, prepend=time[:1]).tolist()
            start = np.zeros(len(u), dtype=bool)
            for f, e in zip(bounds, bounds[1:]):
                start[f] = True
                if e - f > 1:
                    start[[f + k for k in segment([dissimilarity(folded[k - 1], folded[k], pause[k], max_gap) for k in range(f + 1, e)], penalty)]] = True
            s = np.flatnonzero(start)
            e = np.concatenate([s[1:], [len(u)]]) - 1
            head, tail = group[s], np.concatenate([group[s][1:], [True]])
            edge = head | tail
            keep = edge | (e > s) | keep_single
            s, e, head, tail, edge = s[keep], e[keep], head[keep], tail[keep], edge[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(u[s]),
                    pa.array(np.where(edge, _EDGE, b[s])),
                    pa.array(b[s]),
                    pa.array(time[s]),
                    pa.array(time[e]),
                    pa.array([int(i[x : y + 1].min()) for x, y in zip(s, e)], pa.int64()),
                    pa.array([i[x : y + 1] for x, y in zip(s, e)], pa.list_(pa.int64())),
                    pa.array([folded[x][0] if h else None for x, h in zip(s, head)], pa.string()),
                    pa.array([folded[x][1] if h else None for x, h in zip(s, head)], pa.int32()),
                    pa.array([folded[x][0] if h else None for x, h in zip(e, tail)], pa.string()),
                    pa.array([folded[x][1] if h else None for x, h in zip(e, tail)], pa.int32()),
                ],
                names=["u", "seg", "b", "first", "last", "low", "ids", "f_text", "f_len", "l_text", "l_len"],
            )

    return run


def _joined(max_gap: int, keep_single: bool, penalty: float):
    """Segments each user's edge pieces; all others are runs already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["u", "seg"]):
            u, seg, b, first, last, low = (t.column(k).to_numpy() for k in ("u", "seg", "b", "first", "last", "low"))
            n = len(u)
            start = np.ones(n, dtype=bool)
            edges = np.flatnonzero(seg == _EDGE)
            if len(edges):
                heads = list(zip(t.column("f_text").to_pylist(), t.column("f_len").to_pylist()))
                tails = list(zip(t.column("l_text").to_pylist(), t.column("l_len").to_pylist()))
                turn = np.flatnonzero((np.diff(edges, prepend=-2) > 1) | (np.diff(u[edges], prepend=u[edges[0]] - 1) != 0))
                for f, e in zip(turn, [*turn[1:], len(edges)]):
                    f, e = int(edges[f]), int(edges[e - 1]) + 1
                    # two pieces of one bucket were parted there
                    costs = [np.inf if b[k] == b[k - 1] else dissimilarity(tails[k - 1], heads[k], int(first[k] - last[k - 1]), max_gap) for k in range(f + 1, e)]
                    start[f:e] = False
                    start[[f + k for k in segment(costs, penalty)]] = True
            s = np.flatnonzero(start)
            e = np.concatenate([s[1:], [n]]) - 1
            ids = t.column("ids").combine_chunks()
            at = ids.offsets.to_numpy()
            size = at[e + 1] - at[s]
            keep = (size > 1) | keep_single
            s, e, size = s[keep], e[keep], size[keep]
            flat = ids.values.to_numpy()
            starts = np.concatenate([[0], np.cumsum(size)])
            where = np.repeat(at[s] - starts[:-1], size) + np.arange(starts[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(u[s]),
                    pa.array(np.array([low[x : y + 1].min() for x, y in zip(s, e)], np.int64)),
                    pa.array(size.astype(np.int64)),
                    pa.array(first[s]),
                    pa.array(last[e]),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat[where])),
                ],
                names=["u", "run_id", "n", "first", "last", "ids"],
            )

    return run


def _runs(chat: DataFrame, user: str, time: str, id_col: str, message: str, max_gap: int, bucket_seconds: int, keep_single: bool, penalty: float) -> DataFrame:
    rows = chat.select(F.col(user).cast("long").alias("u"), F.col(time).cast("long").alias("t"), F.col(id_col).cast("long").alias("i"), F.col(message).alias("m")).dropna()
    rows = rows.withColumn("b", bucket(F.col("t"), bucket_seconds)).repartition("u", "b").sortWithinPartitions("u", "b", "t", "i")
    pieces = rows.mapInArrow(_pieces(max_gap, keep_single, penalty), _PIECES)
    pieces = pieces.repartition("u", "seg").sortWithinPartitions("u", "seg", "b", "first", "low")
    return pieces.mapInArrow(_joined(max_gap, keep_single, penalty), _RUNS)


def run_members(chat: DataFrame, user: str = "user_id", time: str = "time", id_col: str = "id", message: str = "message", max_gap: int = 600, bucket_seconds: int = BUCKET_SECONDS, penalty: float = PENALTY) -> DataFrame:
    """run_id (smallest id of the run) and id of every message in a run of two or more."""
    return _runs(chat, user, time, id_col, message, max_gap, bucket_seconds, False, penalty).select("run_id", F.explode("ids").alias("id"))


def collapse_runs(chat: DataFrame, user: str = "user_id", time: str = "time", id_col: str = "id", message: str = "message", max_gap: int = 600, bucket_seconds: int = BUCKET_SECONDS, penalty: float = PENALTY) -> DataFrame:
    """One row for each run, single messages included: user, run_id, first_time, n, duration."""
    rows = _runs(chat, user, time, id_col, message, max_gap, bucket_seconds, True, penalty)
    return rows.select(F.col("u").alias(user), "run_id", F.col("first").alias("first_time"), "n", (F.col("last") - F.col("first")).alias("duration"))

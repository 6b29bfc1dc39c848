"""Sessions of activity by occupancy bitmaps and morphological closing.

The events of an entity set bits, one a second, in bitmaps of CHUNK seconds. Closing joins all bits at most ``gap``
seconds apart: the bitmap is dilated by gap-1 seconds with doubling shifts (1, 2, 4, ... bits), so that two events
up to ``gap`` apart give one run of bits and any longer pause leaves a hole. Runs are read off at their edges, their
ends are trimmed by the dilation, and event counts are joined to runs by position. Runs at a chunk's edges are
stitched in a window over (entity, edge pieces); it holds at most two pieces a chunk, however many the events.

Cases: rows without entity or time are left out; repeated ids count once within their source; ties in time are one
bit but count each; an entity's single event is a session of length 0; empty tables give no sessions; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.frames import bucket, whole_groups

CHUNK = 4096
_ONE = np.uint64(1)


def dilate(words: np.ndarray, width: int) -> np.ndarray:
    """Each row is a little-endian bitmap of 64-bit words; every bit spreads over ``width`` bits upwards, itself included."""
    have = 1
    while have < width:
        step = min(have, width - have)
        words = words | shift_up(words, step)
        have += step
    return words


def shift_up(words: np.ndarray, by: int) -> np.ndarray:
    whole, part = divmod(by, 64)
    out = np.zeros_like(words)
    n = words.shape[1]
    if whole < n:
        out[:, whole:] = words[:, : n - whole] << np.uint64(part)
        if part and whole + 1 < n:
            out[:, whole + 1 :] |= words[:, : n - whole - 1] >> np.uint64(64 - part)
    return out


def run_edges(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first bit and last bit of every run of set bits, in order."""
    below = shift_up(words, 1)
    above = (words >> _ONE).copy()
    above[:, :-1] |= words[:, 1:] << np.uint64(63)
    return (*_bits(words & ~below), _bits(words & ~above)[1])


def _bits(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, word = np.nonzero(words)
    value = words[row, word]
    rows, bits = [], []
    while len(value):
        low = value & (~value + _ONE)
        rows.append(row)
        bits.append(word * 64 + np.frexp(low.astype(np.float64))[1] - 1)
        value = value ^ low
        row, word, value = row[value != 0], word[value != 0], value[value != 0]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, bits = np.concatenate(rows), np.concatenate(bits)
    order = np.lexsort((bits, rows))
    return rows[order], bits[order]


def close_chunks(chunk_of: np.ndarray, offset: np.ndarray, chunks: int, gap: int) -> tuple[np.ndarray, ...]:
    """Runs of closed bitmaps: chunk, first and last event's offset, and number of events of each run.

    ``chunk_of`` (sorted) and ``offset`` place every event.
    """
    width = max(1, gap)
    words = np.zeros((chunks, -(-(CHUNK + width) // 64) + 1), dtype=np.uint64)
    np.bitwise_or.at(words, (chunk_of, offset >> 6), _ONE << (offset & 63).astype(np.uint64))
    row, first, last = run_edges(dilate(words, width))
    span = CHUNK + width + 128
    at = np.searchsorted(row * span + first, chunk_of * span + offset, side="right") - 1
    return row, first, last - (width - 1), np.bincount(at, minlength=len(row))


def _pieces(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["entity", "c"]):
            entity, c, time, source, i = (t.column(k).to_numpy() for k in ("entity", "c", "t", "s", "i"))
            new = np.ones(len(c), dtype=bool)  # sorted: copies of an entry are neighbours
            new[1:] = (i[1:] != i[:-1]) | (source[1:] != source[:-1]) | (time[1:] != time[:-1]) | (entity[1:] != entity[:-1])
            entity, c, time = entity[new], c[new], time[new]
            head = np.ones(len(c), dtype=bool)
            head[1:] = (entity[1:] != entity[:-1]) | (c[1:] != c[:-1])
            chunk_of = np.cumsum(head) - 1
            starts = np.flatnonzero(head)
            base = c[starts] * CHUNK
            row, first, last, n = close_chunks(chunk_of, time - base[chunk_of], len(starts), gap)
            edge = np.zeros(len(row), dtype=bool)
            if len(row):
                turn = row[1:] != row[:-1]
                edge[0] = edge[-1] = True
                edge[1:] |= turn
                edge[:-1] |= turn
            # only a piece which reaches into the reach of a neighbour chunk can go on there
            near = (first < gap) | (last > CHUNK - 1 - gap)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(entity[starts][row]),
                    pa.array(c[starts][row], mask=edge & near),
                    pa.array(base[row] + first),
                    pa.array(base[row] + last),
                    pa.array(n.astype(np.int64)),
                ],
                names=["entity", "seg", "first", "last", "n"],
            )

    return run


def sessions(sources: list[DataFrame], entity: str = "user_id", time: str = "time", id_col: str = "id", gap: int = 1800, integral: str = "int") -> DataFrame:
    """{entity}, session_start, session_end, duration, n of every session over all ``sources`` together.

    ``gap``: a new session starts when more than that many seconds have passed since the entry before; 1 or more.
    ``integral``: type of the entity column, int or bigint.
    """
    if gap < 1:
        raise ValueError("gap must be at least one second")
    parts = [
        d.select(F.col(entity).alias("entity"), F.col(time).cast("long").alias("t"), F.lit(k).cast("tinyint").alias("s"), F.col(id_col).cast("long").alias("i")).where(
            F.col("entity").isNotNull() & F.col("t").isNotNull() & F.col("i").isNotNull()
        )
        for k, d in enumerate(sources)
    ]
    rows = reduce(DataFrame.unionByName, parts).withColumn("c", bucket(F.col("t"), CHUNK))
    rows = rows.repartition("entity", "c").sortWithinPartitions("entity", "c", "t", "s", "i")
    pieces = rows.mapInArrow(_pieces(gap), f"entity {integral}, seg bigint, first bigint, last bigint, n bigint")
    return _stitch(pieces, gap).select(
        F.col("entity").alias(entity),
        F.col("first").alias("session_start"),
        F.col("last").alias("session_end"),
        (F.col("last") - F.col("first")).alias("duration"),
        "n",
    )


def _stitch(pieces: DataFrame, gap: int) -> DataFrame:
    """Joins edge pieces (seg null) of an entity whose distance is at most gap; inner pieces are sessions already."""
    w = Window.partitionBy("entity", "seg").orderBy("first")
    fresh: Column = F.col("seg").isNotNull() | F.coalesce(F.col("first") - F.lag("last").over(w) > gap, F.lit(True))
    chained = pieces.withColumn("fresh", fresh.cast("int")).withColumn("chain", F.sum("fresh").over(w))
    return chained.groupBy("entity", "seg", "chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))

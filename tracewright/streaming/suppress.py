"""Streaming forms of repeat suppression and change filter, with state for each key; the group check has none.

What a key's state does is a plain class, so that streams and tests share it. Rows of a key are taken in (time, id)
order within a micro-batch, all at once in arrays; across micro-batches arrival order counts. State lives in the state
store: two numbers a key, dropped when the key was idle for TTL_FACTOR times its life in processing time (a stream may
lag behind its events). Expiry keeps a query running batches without data, so runs that end with their data (drain) turn
it off with ``expire=False``; their state ends with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


TTL_FACTOR = 4
State = tuple[int, int] | None


class _Machine:
    def step(self, state: State, time: int, value: int | None = None) -> tuple[State, bool]:
        """One row."""
        state, keep = self.run(state, np.array([time]), None if value is None else np.array([value]), np.array([False]))
        return state, bool(keep[0])


class Repeats(_Machine):
    """Counts the rows of a stretch with gaps of at most ``window`` seconds; the first ``threshold`` pass. State: last time, count."""

    def __init__(self, threshold: int, window: int):
        self.threshold, self.window = threshold, window

    def run(self, state: State, time: np.ndarray, value: np.ndarray | None, reset: np.ndarray) -> tuple[State, np.ndarray]:
        goes_on = np.zeros(len(time), bool)
        goes_on[1:] = np.diff(time) <= self.window
        goes_on[:1] = state is not None and time[0] - state[0] <= self.window
        at = np.arange(len(time))
        start = np.maximum.accumulate(np.where(goes_on, -1, at))
        n = np.where(start < 0, at + 1 + (state[1] if state else 0), at - start + 1)
        return (int(time[-1]), int(min(n[-1], self.threshold + 1))), n <= self.threshold


class Changes(_Machine):
    """Passes a row unless the row before had the same value at most ``ttl`` seconds earlier; a reset forgets. State: last time, value."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def run(self, state: State, time: np.ndarray, value: np.ndarray | None, reset: np.ndarray) -> tuple[State, np.ndarray]:
        passes = ~reset
        same = (value[1:] == value[:-1]) & (np.diff(time) <= self.ttl) & ~reset[:-1]
        passes[1:] &= ~same
        if state is not None:
            passes[0] &= not (state[1] == value[0] and time[0] - state[0] <= self.ttl)
        return (None if reset[-1] else (int(time[-1]), int(value[-1]))), passes


class _Processor(StatefulProcessor):
    state_schema = "time bigint, n bigint"

    def __init__(self, machine, value: str | None, life_seconds: int, reset: tuple[str, int] | None = None, expire: bool = True):
        self.machine, self.value, self.life, self.reset, self.expire = machine, value, life_seconds, reset, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("s", self.state_schema, 1000 * TTL_FACTOR * self.life if self.expire else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(rows), ignore_index=True).sort_values(["time", "id"], kind="stable")
        state = self.state.get() if self.state.exists() else None
        state = (int(state[0]), int(state[1])) if state is not None else None
        reset = (all_rows[self.reset[0]] == self.reset[1]).to_numpy(bool) if self.reset else np.zeros(len(all_rows), bool)
        state, keep = self.machine.run(state, all_rows["time"].to_numpy(np.int64), None if self.value is None else all_rows[self.value].to_numpy(), reset)
        if state is not None:
            self.state.update(state)
        else:
            self.state.clear()
        yield all_rows[keep]

    def close(self) -> None:
        pass


def _stream(df: DataFrame, keys: list[str], processor: _Processor) -> DataFrame:
    schema: StructType = df.schema
    return df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if processor.expire else "None")


def suppress_repeats(stream: DataFrame, keys: list[str], threshold: int, window: int, expire: bool = True) -> DataFrame:
    return _stream(stream, keys, _Processor(Repeats(threshold, window), None, window, None, expire))


def changes_only(stream: DataFrame, keys: list[str], value: str = "type", ttl: int = 1800, reset: tuple[str, int] | None = None, expire: bool = True) -> DataFrame:
    """Drops rows whose key had the same value within ttl seconds before.

    Rows that hold ``reset`` (a column and its value) make the key forget and are dropped themselves; they are rows of the
    same stream, so that they are taken in order with the others.
    """
    return _stream(stream, keys, _Processor(Changes(ttl), value, ttl, reset, expire))


def item_bursts(stream: DataFrame, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Debounced item transactions: session windows a user and place, amounts summed; ``late`` bounds the state."""
    s = stream.withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", late)
    return s.groupBy(F.session_window("ts", gap), "user_id", "wid", "x", "y", "z", "action", "type").agg(F.sum("amount").alias("amount")).select(
        F.unix_seconds(F.col("session_window.start")).alias("first_time"), "user_id", "wid", "x", "y", "z", "action", "type", "amount"
    )

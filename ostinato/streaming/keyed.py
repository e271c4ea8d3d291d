"""Keyed state: overlap-add of whole chunks in a bounded ring, and the set of sounding notes with seeking.

Both run as `transformWithStateInPandas`, which wants the RocksDB state store; `use_rocksdb` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.separation import triangle


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Ring(StatefulProcessor):
    """What chunks have said of frames that later chunks may still reach, at most two segments."""

    def __init__(self, keys: Sequence[str], segment: int, power: float):
        self.keys, self.segment, self.weight = list(keys), segment, triangle(segment, power)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ring", "begin bigint, sums binary, weights binary")

    def _out(self, key: tuple, begin: int, sums: np.ndarray, weights: np.ndarray, end: int) -> pd.DataFrame:
        n = end - begin
        values = (sums[:n] / np.maximum(weights[:n], 1e-8)).tolist()
        return pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, "begin": [begin], "value": [values]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get() if self.state.exists() else None
        begin, sums, weights = (found[0], np.frombuffer(found[1]).copy(), np.frombuffer(found[2]).copy()) if found else (None, np.zeros(0), np.zeros(0))
        chunks = pd.concat(list(rows)).sort_values("offset")
        for offset, trim, values in zip(chunks["offset"], chunks["trim_start"], chunks["values"], strict=True):
            x = np.asarray(values, float)
            if trim < 0 or trim + len(x) > self.segment:
                raise ValueError(f"a chunk outside its segment: {trim} + {len(x)} of {self.segment}")
            begin = offset if begin is None else begin
            if offset < begin:
                raise ValueError(f"a chunk at {offset} after frames up to {begin} were final")
            if offset > begin:  # no later chunk reaches what lies before this one
                n = min(offset - begin, len(sums))
                if n:
                    yield self._out(key, begin, sums, weights, begin + n)
                begin, sums, weights = offset, sums[n:], weights[n:]
            if len(x) > len(sums):
                more = np.zeros(len(x) - len(sums))
                sums, weights = np.concatenate([sums, more]), np.concatenate([weights, more])
            if len(sums) > 2 * self.segment:
                raise ValueError("more than two segments are open")
            w = self.weight[trim : trim + len(x)]
            sums[: len(x)] += w * x
            weights[: len(x)] += w
        self.state.update((begin, sums.tobytes(), weights.tobytes()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # when event time has passed the last chunk, what is left is final
        self.handle.registerTimer(int(chunks["ms"].max()) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            begin, sums, weights = self.state.get()
            sums, weights = np.frombuffer(sums), np.frombuffer(weights)
            if len(sums):
                yield self._out(key, begin, sums, weights, begin + len(sums))
            self.state.clear()

    def close(self) -> None:
        pass


def overlap_add(chunks: DataFrame, keys: Sequence[str], segment: int, power: float = 1.0, delay: str = "0 seconds") -> DataFrame:
    """(keys, begin, value array) of finished frames of (keys, at, offset, trim_start, values), a row a chunk.

    A frame is final once a chunk begins behind it; the last ones are when the watermark (`at`, less
    `delay`) has passed the key's last chunk, by a timer, so no closing rows are needed.  Chunks come in rising order; one
    that begins before what is final, or lies outside its segment, fails the query.
    """
    own = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)
    rows = chunks.select(*keys, "at", F.unix_millis("at").alias("ms"), "offset", "trim_start", "values").withWatermark("at", delay)
    return rows.groupBy(*keys).transformWithStateInPandas(_Ring(keys, segment, power), f"{own}, begin bigint, value array<double>", "append", "eventTime")


ON, OFF, PROGRAM, SEEK = "ON", "OFF", "PROGRAM", "SEEK"


class _Player(StatefulProcessor):
    """Sounding notes and programs of channels; a seek silences all and takes programs from what came before its target."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sounding = handle.getMapState("sounding", "channel int, note int", "ms bigint")
        self.programs = handle.getMapState("programs", "channel int", "program int")
        # (ms, channel, program) of all changes so far: bounded by their number, which is small in a piece
        self.changes = handle.getListState("changes", "ms bigint, channel int, program int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        notes = {tuple(k): v[0] for k, v in self.sounding.iterator()}
        programs = {k[0]: v[0] for k, v in self.programs.iterator()}
        fresh, out = [], []
        for e in events.itertuples():
            silenced = 0
            if e.type == ON:
                notes[e.channel, e.data] = e.ms
            elif e.type == OFF:
                notes.pop((e.channel, e.data), None)
            elif e.type == PROGRAM:
                programs[e.channel] = e.data
                fresh.append((int(e.ms), int(e.channel), int(e.data)))
            elif e.type == SEEK:
                silenced, notes = len(notes), {}
                programs = {c: p for m, c, p in [*self.changes.get(), *fresh] if m <= e.ms}
            out.append((e.seq, e.type, len(notes), silenced, programs.get(e.channel, 0)))
        self.sounding.clear()
        for (channel, note), ms in notes.items():
            self.sounding.updateValue((int(channel), int(note)), (int(ms),))
        self.programs.clear()
        for channel, program in programs.items():
            self.programs.updateValue((int(channel),), (int(program),))
        if fresh:
            self.changes.appendList(fresh)
        found = pd.DataFrame(out, columns=["seq", "type", "sounding", "silenced", "program"])
        for k, v in zip(self.keys, key, strict=True):
            found.insert(0, k, v)
        yield found[[*self.keys, "seq", "type", "sounding", "silenced", "program"]]

    def close(self) -> None:
        pass


def sounding(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seq, type, sounding, silenced, program) after each event of (keys, seq, ms, channel, type, data), in the order of seq.

    Notes are a set of (channel, note): a start of a sounding note and an end of a silent one change
    nothing.  A SEEK to its `ms` ends all notes (`silenced`), and each channel's program is the last change up to
    there; the event at the target itself counts as passed.  Rows of a key must come in order from batch to batch.
    """
    own = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    rows = events.select(*keys, "seq", "ms", "channel", "type", "data")
    return rows.groupBy(*keys).transformWithStateInPandas(_Player(keys), f"{own}, seq bigint, type string, sounding int, silenced int, program int", "append", "none")


def sessions(events: DataFrame, keys: Sequence[str], at: str, gap: str = "6 hours", delay: str = "0 seconds") -> DataFrame:
    """(keys, begin, end, n) of sessions that a silence of `gap` closes, each emitted when the watermark has passed its end."""
    window = F.session_window(at, gap).alias("_w")
    counts = events.withWatermark(at, delay).groupBy(*keys, window).agg(F.count("*").alias("n"))
    return counts.select(*keys, F.col("_w.start").alias("begin"), F.col("_w.end").alias("end"), "n")

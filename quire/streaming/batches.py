"""Keyed state over streams: anchored batches and strokes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class AnchoredBatches(StatefulProcessor):
    """Collects the paths of a key from its first event on; a timer set then, and not moved by later events, emits the batch."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "path string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = not self.pending.exists()
        for frame in rows:
            for path in frame["path"]:
                self.pending.appendValue((path,))
        if first:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        paths = [x[0] for x in self.pending.get()]
        self.pending.clear()
        yield pd.DataFrame({"key": [key[0]], "paths": [paths]})

    def close(self) -> None:
        pass


def anchored_stream(events: DataFrame, key: str, delay_ms: int) -> DataFrame:
    """Stream of (key, paths), a row for each batch. Needs the RocksDB state store; paths must be a column of events."""
    from pyspark.sql import functions as F

    keyed = events.select(F.col(key).cast("string").alias("key"), F.col("path").cast("string").alias("path"))
    return keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=AnchoredBatches(delay_ms), outputStructType="key string, paths array<string>", outputMode="append", timeMode="ProcessingTime"
    )


POINTER = "ts long, seq long, phase string, touch string, x double, y double"
STROKE = "surface string, stroke long, epoch long, n long, x0 double, y0 double, x1 double, y1 double"
#: What is kept of a surface: beginnings and clears so far, whether a touch is followed and which, and the points of the stroke that is being drawn.
SURFACE = "begun long, epoch long, down boolean, touch string, n long, x0 double, y0 double, x1 double, y1 double"


class Strokes(StatefulProcessor):
    """Follows the touches of a surface in the order of their times.

    Events wait until the watermark has passed them and are then read by (ts,
    seq). A beginning takes over; any ending finishes the stroke if it has more
    than one point; discard drops what is unfinished, clear what is finished too.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", POINTER)
        self.surface = handle.getValueState("surface", SURFACE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([tuple(r) for r in frame[["ts", "seq", "phase", "touch", "x", "y"]].astype(object).where(frame.notna(), None).itertuples(index=False)])
        yield from self._read(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._read(key, timerValues)

    def _read(self, key, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[:2])
        due = [e for e in events if e[0] <= passed * 1000]  # what comes later than this is later in time
        later = events[len(due) :]
        if later:
            self.handle.registerTimer(-(-later[0][0] // 1000))
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
            old = tuple(self.surface.get()) if self.surface.exists() else (0, 0, False, None, 0, None, None, None, None)
            new, done = follow(old, due)
            self.surface.update(new)
            if done:
                yield pd.DataFrame([(key[0], *d) for d in done], columns=[f.split()[0] for f in STROKE.split(", ")])

    def close(self) -> None:
        pass


def follow(surface: tuple, events: list[tuple]) -> tuple[tuple, list[tuple]]:
    """The surface after some events, and rows (stroke, epoch, n, box) of the strokes they finish; a clear is a row without a stroke."""
    begun, epoch, down, touch, n, *box = surface
    out = []
    for _, _, phase, who, x, y in events:
        if phase == "began":
            begun, down, touch, n, box = begun + 1, True, who, 1, [x, y, x, y]
        elif phase == "moved" and down and who == touch:
            box = [x, y, x, y] if n == 0 else [min(box[0], x), min(box[1], y), max(box[2], x), max(box[3], y)]
            n += 1
        elif phase in ("ended", "cancelled", "discard"):
            if n > 1 and phase != "discard":
                out.append((begun, epoch, n, *box))
            down, touch, n = False, None, 0
        elif phase == "clear":
            epoch, n = epoch + 1, 0
            out.append((None, epoch, 0, None, None, None, None))
    return (begun, epoch, down, touch, n, *(box if n else [None] * 4)), out


def stroke_stream(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Rows of STROKE for each stroke as it is finished, and for each clear, from a pointer stream (surface, at, seq, phase, touch, x, y).

    at: the event's time, a timestamp; seq: breaks ties of it. phase: began, moved,
    ended, cancelled, discard, clear. Events may come in any order within the
    delay; one that comes after the watermark has passed it is left out, as Spark
    does with late rows. Of a surface's rows, those of its last epoch are its ink.
    Needs the RocksDB state store.
    """
    from pyspark.sql import functions as F

    from quire.workers import ship

    ship(events.sparkSession)
    timed = events.withWatermark("at", delay).select(
        F.col("surface").cast("string").alias("surface"), "at", F.unix_micros("at").alias("ts"), F.col("seq").cast("long").alias("seq"), "phase", F.col("touch").cast("string").alias("touch"),
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
    )
    return timed.groupBy("surface").transformWithStateInPandas(statefulProcessor=Strokes(), outputStructType=STROKE, outputMode="append", timeMode="EventTime")

"""Logs of what a user does to a document, read one event after the other.

What an event does depends on all before it, so the events of a document are
sorted and read as a stream by one task, whose memory holds what the document
has at that moment and never the log. Documents are dealt over tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.workers import ship


def replay(events: DataFrame, document: str, order: list[str], made: str, begin: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Add the columns of made (a DDL string) to events: begin() gives, for each document, the function that takes one event and returns them."""
    ship(events.sparkSession)
    own = StructType.fromDDL(made)
    schema = StructType([*events.schema.fields, *own.fields])
    sorted_events = events.repartition(F.col(document)).sortWithinPartitions(document, *order)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(own)
        at, step = object(), None
        for batch in batches:
            rows = []
            for event in batch.to_pylist():
                if step is None or event[document] != at:
                    at, step = event[document], begin()
                rows.append(step(event))
            added = [pa.array([r.get(f.name) for r in rows], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *kinds.names])

    return sorted_events.mapInArrow(read, schema)


def _picked(pages: list, wanted: list | None) -> list[int]:
    """Places that are there, each once, ascending."""
    return sorted({i for i in wanted or () if i is not None and 0 <= i < len(pages)})


class Tray:
    """The pages of a new document while it is edited, and what is being dragged. A page is [place in the source, rotation]."""

    def __init__(self):
        self.source, self.pages = 0, []
        self.dragged: dict[str, list[int] | None] = {"source": None, "tray": None}

    def step(self, op: str, sel: list[int] | None, target: int | None, n: int | None) -> None:
        if op == "file":
            self.source += max(n or 0, 0)
        elif op == "add":
            self.pages += self._copies(sel)
        elif op == "add_all":
            self.pages += self._copies(range(self.source))
        elif op in ("drag_source", "drag_tray"):
            self.dragged[op[5:]] = sel
        elif op == "drop_source":
            self._insert(self._copies(self.dragged["source"]), target)
            self.dragged["source"] = None
        elif op == "drop_tray":
            taken = _picked(self.pages, self.dragged["tray"])
            moving = [self.pages[i] for i in taken]
            gone = set(taken)
            self.pages = [p for i, p in enumerate(self.pages) if i not in gone]
            self._insert(moving, (target or 0) - sum(i < (target or 0) for i in taken))
            self.dragged["tray"] = None
        elif op == "rotate":
            for i in _picked(self.pages, sel):
                self.pages[i] = [self.pages[i][0], (self.pages[i][1] + 90) % 360]
        elif op == "remove":
            gone = set(_picked(self.pages, sel))
            self.pages = [p for i, p in enumerate(self.pages) if i not in gone]

    def _copies(self, wanted) -> list[list[int]]:
        return [[i, 0] for i in _picked(range(self.source), wanted)]

    def _insert(self, pages: list, target: int | None) -> None:
        at = min(max(target or 0, 0), len(self.pages))
        self.pages[at:at] = pages


def edited(log: DataFrame, document: str, order: list[str]) -> DataFrame:
    """The pages that a session of edits leaves: (document, page_ord, source_ord, rotation), a row for each.

    The log has op, sel (array of places), target and n. file: n more pages in the
    source. add, add_all: copies of source pages at the end of the tray.
    drag_source, drag_tray: remembers sel; drop_source, drop_tray: puts copies of
    what was remembered, or moves it, before target, which counts pages before the
    move and is brought into 0 to n; then nothing is remembered. rotate, remove:
    the pages at sel. Places that are not there are passed over, null counts as
    none or 0, other ops change nothing. A document whose tray is empty has no row.
    """
    ship(log.sparkSession)
    kind = log.schema[document].dataType
    own = log.select(F.col(document).alias("_doc"), *order, F.col("op"), F.col("sel").cast("array<int>").alias("sel"), F.col("target").cast("int").alias("target"), F.col("n").cast("int").alias("n"))
    sorted_log = own.repartition(F.col("_doc")).sortWithinPartitions("_doc", *order)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tray, names = object(), None, []

        def finished(doc):
            for begin in range(0, len(tray.pages), 10_000):
                part = tray.pages[begin : begin + 10_000]
                columns = [pa.array([doc] * len(part), names[0]), pa.array(range(begin, begin + len(part)), pa.int64()), pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["document", "page_ord", "source_ord", "rotation"])

        for batch in batches:
            names = [batch.schema.field(0).type]
            for e in batch.to_pylist():
                if tray is None or e["_doc"] != at:
                    if tray is not None:
                        yield from finished(at)
                    at, tray = e["_doc"], Tray()
                tray.step(e["op"], e["sel"], e["target"], e["n"])
        if tray is not None:
            yield from finished(at)

    return sorted_log.mapInArrow(read, f"document {kind.simpleString()}, page_ord long, source_ord long, rotation int").withColumnRenamed("document", document)


class LiveStamps:
    """Stamps of a document by page and age: put, remove and last in time that grows with the logarithm of their number."""

    def __init__(self):
        self.heap: list[tuple] = []
        self.live: dict = {}
        self.n = 0

    def put(self, stamp, page: int) -> None:
        self.n += 1
        self.live[stamp] = (-page, -self.n)
        heapq.heappush(self.heap, (-page, -self.n, stamp))

    def last(self):
        """The newest stamp of the last page that has any."""
        while self.heap and self.live.get(self.heap[0][2]) != self.heap[0][:2]:
            heapq.heappop(self.heap)  # removed meanwhile, or put anew
        return self.heap[0][2] if self.heap else None


def _selecting(action: str, stamp: str, page: str) -> Callable[[], Callable[[dict], dict]]:
    def begin():
        stamps, selected = LiveStamps(), None

        def step(e: dict) -> dict:
            nonlocal selected
            removed = None
            if e[action] == "add" and e[stamp] is not None:
                stamps.put(e[stamp], e[page] or 0)
                selected = e[stamp]
            elif e[action] == "click" and e[stamp] in stamps.live:
                selected = e[stamp]
            elif e[action] == "remove":
                removed = stamps.last() if selected is None else selected
                stamps.live.pop(removed, None)
                selected = stamps.last()
            return {"selected": selected, "removed": removed, "n_live": len(stamps.live)}

        return step

    return begin


def selection(log: DataFrame, document: str, order: list[str], action: str, stamp: str, page: str) -> DataFrame:
    """Add to each event of a log what is selected after it, what it removed, and n_live, how many stamps are left.

    action add: the stamp is put on top of its page and selected. click: a stamp
    that is there is selected; any other click, also one on nothing (null), keeps
    the selection. remove: the selected stamp, or the last one where none is,
    goes, and the last one left is selected: the newest of the last page that has
    any. A remove without stamps removes null; other actions change nothing. A
    stamp that is added again counts as new. Null pages are page 0.
    """
    kind = log.schema[stamp].dataType.simpleString()
    return replay(log, document, order, f"selected {kind}, removed {kind}, n_live long", _selecting(action, stamp, page))


def _dragging(phase: str, stamp: str, page: str) -> Callable[[], Callable[[dict], dict]]:
    def begin():
        pages: dict = {}
        held = last = None

        def step(e: dict) -> dict:
            nonlocal held, last
            now = None
            if e[phase] == "place":
                pages.setdefault(e[page], []).append([e[stamp], e["x"], e["y"], e["w"], e["h"]])
            elif e[phase] == "down":
                hit = next((b for b in reversed(pages.get(e[page], ())) if b[1] <= e["x"] < b[1] + b[3] and b[2] <= e["y"] < b[2] + b[4]), None)
                if hit is not None:
                    held, last = hit, (e["x"], e["y"])
                now = hit
            elif e[phase] == "drag" and held is not None:
                held[1], held[2], last = held[1] + (e["x"] - last[0]), held[2] + (e["y"] - last[1]), (e["x"], e["y"])
                now = held
            elif e[phase] == "up":
                now, held = held, None
            return {"held": now[0], "at_x": now[1], "at_y": now[2]} if now else {}

        return step

    return begin


def drags(log: DataFrame, document: str, order: list[str], phase: str, stamp: str, page: str) -> DataFrame:
    """Add to each event the stamp that it holds (null: it passes through) and where that stamp then is: held, at_x, at_y.

    The log has x, y, w, h (doubles). phase place: a stamp with its box, above
    those of its page. down: the topmost box of the page under the point as
    earlier drags have left it is held; on none, the event passes through and what
    was held stays held. drag: moves what is held by the way since the last
    event. up: lets go. Greatest edges do not belong to a box. Points without
    coordinates are left out beforehand.
    """
    good = F.col("x").isNotNull() & F.col("y").isNotNull() | ~F.col(phase).isin("place", "down", "drag")
    kind = log.schema[stamp].dataType.simpleString()
    return replay(log.where(good), document, order, f"held {kind}, at_x double, at_y double", _dragging(phase, stamp, page))

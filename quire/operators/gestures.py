"""Pointer events: strokes, drags, and batches anchored at their first event."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ordinals import carry, steady
from quire.workers import ship

#: Moments of one piece of a table of events.
PIECE = 1 << 17


def strokes(events: DataFrame, key: str, order: list[str], begins: Column, ends: Column, moves: Column | None = None, touch: Column | None = None, discards: Column | None = None, clears: Column | None = None) -> DataFrame:
    """Add stroke to the events that are points of a finished stroke: the number of beginnings on the surface so far; null elsewhere.

    Every beginning takes over, whatever was unfinished is dropped. Points are the
    beginning and the moves after it, of the same touch only if touches are told
    apart. The next ending finishes the stroke, whichever touch it is of; it adds
    no point, and a stroke of one point is dropped. A discard drops what is
    unfinished. A clear drops what is finished too, and with clears there is a
    column epoch: the number of clears before the point; the touch that is down
    goes on with an empty stroke. moves: by default all other events. Null counts
    as false. The order should be total; ties are read in any order.
    """
    no = F.lit(False)
    flag = lambda c: no if c is None else F.coalesce(c, no)
    marks = {"_begin": flag(begins), "_end": flag(ends), "_drop": flag(discards), "_clear": flag(clears), "_touch": F.lit(None).cast("string") if touch is None else touch}
    events = events.withColumns(marks).withColumn("_move", ~(F.col("_begin") | F.col("_end") | F.col("_drop") | F.col("_clear")) & (F.lit(True) if moves is None else flag(moves)))
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumns({"_n": F.sum(F.col("_begin").cast("long")).over(so_far), "epoch": F.sum(F.col("_clear").cast("long")).over(so_far)})
    own = Window.partitionBy(key, "_n").orderBy(*order)
    stop = F.col("_end") | F.col("_drop")
    out = out.withColumns({
        "_over": F.coalesce(F.max(stop).over(own.rowsBetween(Window.unboundedPreceding, -1)), no),
        "_who": F.first("_touch").over(own.rowsBetween(Window.unboundedPreceding, 0)),
    })
    inside = (F.col("_n") > 0) & ~F.col("_over")
    point = inside & (F.col("_begin") | F.col("_move") & F.col("_touch").eqNullSafe(F.col("_who")))
    # The first stop of a stroke says whether it is finished, and after how many clears.
    whole = Window.partitionBy(key, "_n")
    out = out.withColumn("_point", point).withColumn("_done", F.max(F.when(inside & F.col("_end"), F.col("epoch"))).over(whole))
    points = F.sum(F.col("_point").cast("int")).over(Window.partitionBy(key, "_n", "epoch"))
    kept = F.col("_point") & (F.col("_done") == F.col("epoch")) & (points > 1)
    out = out.withColumn("stroke", F.when(kept, F.col("_n")))
    return out.drop("_n", "_begin", "_end", "_drop", "_clear", "_touch", "_move", "_over", "_who", "_point", "_done", *(["epoch"] if clears is None else []))


def ink(points: DataFrame, key: str, x: Column, y: Column) -> DataFrame:
    """Of each surface the strokes finished since the last clear, n_strokes, and their extent (x0, y0, x1, y1; null without any).

    points: the rows of strokes() with clears; a surface of any row has a row. Each
    task keeps least and greatest values for each clear before anything is moved.
    """
    has = F.col("stroke").isNotNull()
    by = points.groupBy(key, "epoch").agg(
        F.count_distinct(F.when(has, F.col("stroke"))).alias("n_strokes"), F.min(F.when(has, x)).alias("x0"), F.min(F.when(has, y)).alias("y0"), F.max(F.when(has, x)).alias("x1"), F.max(F.when(has, y)).alias("y1")
    )
    last = by.groupBy(key).agg(F.max_by(F.struct("n_strokes", "x0", "y0", "x1", "y1"), "epoch").alias("_last"))
    return last.select(key, "_last.*")


def latched(events: DataFrame, key: str, order: list[str], down: Column, up: Column, hit: Column, name: str = "latch") -> DataFrame:
    """Add what a drag holds: what lay under the pointer when it went down, until it goes up; null for events that pass through."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumns({"_hit": hit, "_down": down, "_up": up}).withColumn("_n", F.sum(F.col("_down").cast("int")).over(so_far))
    own = Window.partitionBy(key, "_n").orderBy(*order)
    over = F.coalesce(F.max("_up").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    held = F.first(F.when(F.col("_down"), F.struct("_hit")), ignorenulls=True).over(own)
    return marked.withColumn(name, F.when((F.col("_n") > 0) & ~over, held["_hit"])).drop("_hit", "_down", "_up", "_n")


def path_sum(events: DataFrame, key: str, order: list[str], delta: Column, name: str) -> DataFrame:
    """Running sum of the movements of a drag. Pass decimals: sums of floats depend on their order."""
    return events.withColumn(name, F.sum(delta).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def anchored_batches(events: DataFrame, key: str, micros: Column, delay_micros: int) -> DataFrame:
    """Batches (key, anchor, n): the first event opens one, and those less than the delay later belong to it without extending it.

    Moments are sorted by range and read once, in pieces of at most PIECE. Batches
    of a key that begins within a piece are known then. Where a piece begins
    with a key that an earlier piece has too, its first anchor is not: each moment
    that may be it is kept with the last anchor that it leads to in the piece.
    These ways are followed from piece to piece by doubling, so a key of very
    many events is dealt over all tasks and takes a few more rounds. Null moments
    belong to no batch, equal moments count each; a key without moments has no
    row. The delay is positive.
    """
    ship(events.sparkSession)
    size = PIECE
    times = events.select(F.col(key).alias("_key"), micros.cast("long").alias("_t")).where("_t is not null").groupBy("_key", "_t").agg(F.count("*").alias("_c"))
    ranged = times.repartitionByRange(F.col("_key").asc(), F.col("_t").asc()).sortWithinPartitions("_key", "_t")
    kind = times.schema["_key"].dataType.simpleString()
    read = steady(ranged.mapInArrow(lambda batches: _read(batches, delay_micros, size), f"_key {kind}, _t long, _end long, _c long, _what string"))
    known = read.where("_what = 'batch'").select("_key", F.col("_t").alias("anchor"), F.col("_c").alias("n"))
    open_ = read.where("_what = 'open'")
    # A key starts with the last anchor of the piece that it begins in, or with its first moment where a piece begins with it.
    began = read.where("_what = 'last'").select("_key", "_t", F.col("_t").alias("_end"))
    first = open_.groupBy("_key").agg(F.min("_t").alias("_t"))
    first = first.join(began.select(F.col("_key").alias("_k")), F.col("_key").eqNullSafe(F.col("_k")), "left_anti")
    ways = open_.where("_end is not null").select("_key", "_t", "_end").unionByName(began)
    entries = _reached(first.unionByName(began.select("_key", "_t")), ways, delay_micros)
    rows = open_.select("_key", "_t", "_c", F.lit(None).cast("struct<t:bigint,end:bigint>").alias("_way"))
    rows = rows.unionByName(entries.select("_key", "_t", F.lit(0).cast("long").alias("_c"), F.struct(F.col("_t").alias("t"), F.col("_end").alias("end")).alias("_way")))
    held = carry(rows, "_key", [F.col("_t").asc(), F.col("_way").isNull().asc()], "_way", "_from").where("_c > 0")
    # From the last anchor of a way on, rows are its; before it, they are of one piece and read in their order.
    after = held.where("_t >= _from.end").select("_key", F.col("_from.end").alias("anchor"), F.col("_c").alias("n"))
    within = held.where("_t < _from.end").select("_key", F.col("_from.t").alias("_entry"), "_t", "_c").repartition(F.col("_key"), F.col("_entry")).sortWithinPartitions("_key", "_entry", "_t")
    within = within.mapInArrow(lambda batches: _walked(batches, delay_micros), f"_key {kind}, anchor long, n long")
    return known.unionByName(after).unionByName(within).groupBy("_key", "anchor").agg(F.sum("n").alias("n")).select(F.col("_key").alias(key), "anchor", "n")


def _same(a, b) -> bool:
    return a == b or a != a and b != b  # NaN is a key like others


def _read(batches: Iterator[pa.RecordBatch], delay: int, size: int) -> Iterator[pa.RecordBatch]:
    """Of sorted moments (_key, _t, _c) rows (_key, _t, _end, _c, _what): batches; the last anchor of a key that may go on; moments of a key that may have begun before."""
    before, rest = None, None
    for batch in batches:
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        while rest.num_rows > size:
            yield _piece(rest.slice(0, size), before, delay)
            before, rest = (rest.column(0)[size - 1].as_py(),), rest.slice(size)
    if rest is not None and rest.num_rows:
        yield _piece(rest, before, delay)


def _piece(rows: pa.RecordBatch, before: tuple | None, delay: int) -> pa.RecordBatch:
    """Rows of _read for a piece; before: the key ahead of it, None if that is not known."""
    keys, times, counts = (rows.column(i).to_pylist() for i in range(3))
    n, lo, out = len(keys), 0, []
    while lo < n:
        hi = lo + 1
        while hi < n and _same(keys[hi], keys[lo]):
            hi += 1
        if lo == 0 and (before is None or _same(keys[0], before[0])):
            leads, j = [0] * hi, hi  # j: the first moment at least the delay after moment i
            for i in range(hi - 1, -1, -1):
                while j > i + 1 and times[j - 1] >= times[i] + delay:
                    j -= 1
                leads[i] = leads[j] if j < hi else times[i]
            # The first anchor is one of those less than the delay after the first moment, or the one after them.
            may = next((i + 1 for i in range(hi) if times[i] >= times[0] + delay), hi)
            out += [(i, times[i], leads[i] if i < may else None, counts[i], "open") for i in range(hi)]
        else:
            anchor, total = times[lo], 0
            for i in range(lo, hi):
                if times[i] >= anchor + delay:
                    out.append((lo, anchor, None, total, "batch"))
                    anchor, total = times[i], 0
                total += counts[i]
            out.append((lo, anchor, None, total, "batch"))
            if hi == n:
                out.append((lo, anchor, None, 0, "last"))
        lo = hi
    at, t, end, c, what = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at)), pa.array(t, pa.int64()), pa.array(end, pa.int64()), pa.array(c, pa.int64()), pa.array(what)], ["_key", "_t", "_end", "_c", "_what"])


def _walked(batches: Iterator[pa.RecordBatch], delay: int) -> Iterator[pa.RecordBatch]:
    """Parts (_key, anchor, n) of batches, of rows (_key, _entry, _t, _c) sorted by all: the first anchor of an entry is the entry."""
    at, anchor = None, 0
    for batch in batches:
        keys, entries, times = (batch.column(i).to_pylist() for i in range(3))
        anchors = []
        for k, e, t in zip(keys, entries, times, strict=True):
            if at is None or e != at[1] or not _same(k, at[0]):
                at, anchor = (k, e), e
            if t >= anchor + delay:
                anchor = t
            anchors.append(anchor)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(anchors, pa.int64()), batch.column(3)], ["_key", "anchor", "n"])


def _reached(starts: DataFrame, ways: DataFrame, delay: int) -> DataFrame:
    """Of ways (_key, _t, _end) those that are taken from the starts (_key, _t): after one that ends with an anchor comes the first at least the delay later.

    In each round those known to be taken are joined with pointers of twice the
    length, so n pieces of a key take log2(n) rounds.
    """
    ways = steady(ways)
    jumps = steady(_successors(ways, delay))
    # What fewer than 2 ** round jumps reach, by round, and pointers of 2 ** round jumps.
    reached, far = [starts], jumps
    while True:
        so_far = reduce(DataFrame.unionByName, reached)
        more = steady(_followed(so_far.withColumn("_to", F.col("_t")), far).select("_key", F.col("_to").alias("_t")))
        if more.isEmpty():
            break
        reached.append(more)
        far = steady(_followed(far, far))
    taken = reduce(DataFrame.unionByName, reached).select(F.col("_key").alias("_k"), F.col("_t").alias("_at"))
    return ways.join(taken, ways["_key"].eqNullSafe(taken["_k"]) & (ways["_t"] == taken["_at"]), "left_semi")


def _followed(ways: DataFrame, jumps: DataFrame) -> DataFrame:
    """Ways (_key, _t, _to) carried on by the jump from where each of them ends."""
    next_ = jumps.select(F.col("_key").alias("_k"), F.col("_t").alias("_from"), F.col("_to").alias("_end"))
    met = ways.join(next_, ways["_key"].eqNullSafe(next_["_k"]) & (ways["_to"] == next_["_from"]))
    return met.select("_key", "_t", F.col("_end").alias("_to"))


def _successors(ways: DataFrame, delay: int) -> DataFrame:
    """For each way (_key, _t, _end) the first one of its key at least the delay after its end (_key, _t, _to); none, no row."""
    asks = ways.select("_key", (F.col("_end") + delay).alias("_at"), F.col("_t").alias("_asked"), F.lit(None).cast("long").alias("_moment"))
    marks = ways.select("_key", F.col("_t").alias("_at"), F.lit(None).cast("long").alias("_asked"), F.col("_t").alias("_moment"))
    # Going backwards in time, the last moment seen is the next one; at a tie the moment itself is.
    carried = carry(asks.unionByName(marks), "_key", [F.col("_at").desc(), F.col("_moment").isNull().asc(), F.col("_asked").asc()], "_moment", "_to")
    return carried.where("_asked is not null and _to is not null").select("_key", F.col("_asked").alias("_t"), "_to")

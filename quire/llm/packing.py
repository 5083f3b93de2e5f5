"""Best-fit packing of token sequences by bin completion.

Lengths are at most the capacity, so all documents come down to one count for
each length. Best-fit decreasing on these counts is the incumbent, and the
waste that no packing can avoid bounds the number of bins from below. Where the
two differ, a branch-and-bound completes bins around the largest length left:
it enumerates the fillings that no other filling dominates, branches over them,
and leaves a branch once its waste is more than a packing with one bin less has
to spare. Documents take the places that the fillings have for their length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import text as T
from .tokens import Encoder

CAPACITY = 2048
END_ID = 0
#: Fillings that the search looks at before it leaves its incumbent as it is; bin packing is NP-hard, and the incumbent holds all pieces too.
NODES = 20_000
#: About so many pieces are left to the search, equally many of each length; what is beyond is packed by repeating fillings of least waste.
TAIL = 4_000


def pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Token ids of all documents, cut where longer than a sequence: doc_id, piece, start, length, ids (binary, 32 bits), task, number.

    Null text: empty, that is, the end id alone. Only the first piece of a cut
    document may be shorter than a sequence. number counts the pieces of one
    length within a task, so rows that are equal have places of their own.
    """

    def split(batches):
        from pyspark import TaskContext

        encoder, task, seen = Encoder.of(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in T.steps(batch, "text"):
                data, offsets = T.buffer_of(rows.column(1))
                ids, at = encoder.encode(data, offsets)
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "task", "number")}
                for i, doc_id in enumerate(rows.column(0).to_pylist()):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(END_ID)).astype("<u4")
                    n, begin, piece = len(own), 0, 0
                    while begin < n:
                        end = begin + ((n - begin - 1) % capacity + 1 if piece == 0 else capacity)
                        for k, v in zip(out, (doc_id, piece, begin, end - begin, own[begin:end].tobytes(), task, int(seen[end - begin])), strict=True):
                            out[k].append(v)
                        seen[end - begin] += 1
                        begin, piece = end, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    C.ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(split, "doc_id long, piece int, start long, length long, ids binary, task int, number long")


def _times(sums: int, x: int, n: int, capacity: int) -> int:
    """Sums (a bit for each) that up to n more pieces of length x reach."""
    step, most = 1, min(n, capacity // x)
    while most:
        take = min(step, most)
        sums |= sums << (take * x)
        most, step = most - take, 2 * step
    return sums & ((1 << (capacity + 1)) - 1)


def dominated(filling: list[int], room: int, others: list[int]) -> bool:
    """Whether one piece that is left out (others) could take the place of some of the filling's and waste less, or as much with fewer pieces.

    filling: the pieces beside the first one; room: what they waste. Whatever
    packing has the filling, swapping gives one that is as good.
    """
    one = two = 0  # sums of a single piece, of two and more
    for x in filling:
        two |= (two | one) << x
        one |= 1 << x
    sums = one | two | 1
    for x in others:
        if room and (sums >> max(x - room, 0)) & ((1 << min(room, x)) - 1):
            return True
        if (two >> x) & 1:
            return True
    return False


def completions(first: int, left: dict[int, int], capacity: int, spare: int, budget: list[int] | None = None):
    """Undominated fillings around a piece of length first that waste spare at most, least waste first: (waste, lengths).

    budget: a counter of fillings to look at, which ends the search at 0; none, all fillings are given, dominated ones too.
    """
    space = capacity - first
    rest = {x: n - (x == first) for x, n in left.items() if x <= space and n > (x == first)}
    lengths = sorted(rest, reverse=True)
    reach = [1]  # sums that the lengths from i on can reach, smallest first
    for x in reversed(lengths):
        reach.append(_times(reach[-1], x, rest[x], space))
    reach.reverse()

    def fill(i: int, need: int, chosen: list[int]):
        if not need:
            yield list(chosen)
            return
        for j in range(i, len(lengths)):
            if not (reach[j] >> need) & 1:
                return
            x = lengths[j]
            for n in range(min(need // x, rest[x]), 0, -1):
                chosen.extend([x] * n)
                yield from fill(j + 1, need - n * x, chosen)
                del chosen[-n:]

    for waste in range(min(spare, space) + 1):
        if (reach[0] >> (space - waste)) & 1:
            for filling in fill(0, space - waste, []):
                if budget is None:
                    yield waste, [first, *filling]
                    continue
                if budget[0] <= 0:
                    return
                budget[0] -= 1
                used: dict[int, int] = {}
                for x in filling:
                    used[x] = used.get(x, 0) + 1
                if not dominated(filling, waste, [x for x in lengths if rest[x] > used.get(x, 0)]):
                    yield waste, [first, *filling]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing on counts: (how many bins, lengths in each)."""
    left, out = dict(counts), []
    for first in sorted(left, reverse=True):
        while left[first]:
            used, room = {first: 1}, capacity - first
            for x in sorted((x for x in left if x <= room and left[x]), reverse=True):
                if n := min(room // x, left[x] - used.get(x, 0)):
                    used[x] = used.get(x, 0) + n
                    room -= n * x
            times = min(left[x] // n for x, n in used.items())
            out.append((times, [x for x in sorted(used, reverse=True) for _ in range(used[x])]))
            for x, n in used.items():
                left[x] -= n * times
    return out


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by the sum of all lengths, and by pieces too large to share a bin with those that are left room by none."""
    best = 0
    large = sorted(counts)
    for small in {0, *(x for x in counts if 2 * x <= capacity)}:
        # Pieces over capacity - small stand alone among those of length small and more; the others over half share no bin with one another.
        alone = sum(n for x, n in counts.items() if x > capacity - small)
        half = sum(n for x, n in counts.items() if 2 * x > capacity and x <= capacity - small)
        room = half * capacity - sum(x * counts[x] for x in large if 2 * x > capacity and x <= capacity - small)
        more = sum(x * counts[x] for x in large if small <= x and 2 * x <= capacity) - room
        best = max(best, alone + half + max(0, -(-more // capacity)))
    return best


def _search(counts: dict[int, int], capacity: int, bins: int, budget: list[int]) -> list[list[int]] | None:
    """A packing into that many bins at most; None if there is none, or none is found within the budget."""
    total = sum(x * n for x, n in counts.items())
    left, spare = dict(counts), bins * capacity - total
    if spare < 0:
        return None
    failed: set = set()
    stack: list = []
    chosen: list[tuple[int, list[int]]] = []

    def open_node():
        largest = max((x for x, n in left.items() if n), default=0)
        state = tuple(sorted((x, n) for x, n in left.items() if n)), spare
        return (state, iter(()) if state in failed or not largest else completions(largest, dict(left), capacity, spare, budget))

    stack.append(open_node())
    while budget[0] > 0:
        if not any(left.values()):
            return [filling for _, filling in chosen]
        state, more = stack[-1]
        step = next(more, None)
        if step is None:
            failed.add(state)
            stack.pop()
            if not chosen:
                return None
            waste, filling = chosen.pop()
            spare += waste
            for x in filling:
                left[x] += 1
            continue
        waste, filling = step
        chosen.append(step)
        spare -= waste
        for x in filling:
            left[x] -= 1
        stack.append(open_node())
    return None


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how many bins, lengths in each) that hold all pieces. Size follows the number of lengths, not of pieces.

    Where one search does not meet the lower bound, the counts are also divided by
    what divides them all, and by what leaves few enough pieces to be searched:
    the small packing is repeated, and what the division leaves is packed by
    itself. The fewest bins of these count.
    """
    left = {x: n for x, n in counts.items() if n}
    best = _fillings(left, capacity)
    least, total = least_bins(left, capacity), sum(left.values())
    for scale in sorted({math.gcd(*left.values()), total // TAIL, 4 * total // TAIL, 16 * total // TAIL} - {0, 1}, reverse=True) if left else ():
        if sum(n for n, _ in best) == least:
            break
        small = {x: n // scale for x, n in left.items() if n >= scale}
        rest = {x: n % scale for x, n in left.items() if n % scale}
        found = [(scale * n, filling) for n, filling in _fillings(small, capacity)] + (_fillings(rest, capacity) if rest else [])
        best = min(best, found, key=lambda f: sum(n for n, _ in f))
    return best


def _fillings(left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """fillings() by one search: what is common is repeated, the rest is searched."""
    if left and (max(left) > capacity or min(left) < 1):
        raise ValueError("lengths must lie between 1 and the capacity")
    found = best_fit(left, capacity)
    most, least = sum(n for n, _ in found), least_bins(left, capacity)
    if most == least:
        return found  # no packing has fewer bins
    # What is common is packed by repetition; the search has the rest.
    bulk, tail, each = [], dict(left), max(TAIL // len(left), 4)
    for first in sorted(left, reverse=True):
        while tail[first] > each:
            loose = {x: n - each for x, n in tail.items() if n > each}
            waste, filling = next(completions(first, loose, capacity, capacity))
            if tail[first] <= 2 * each and waste > next(completions(first, tail, capacity, capacity))[0]:
                break
            used = {x: filling.count(x) for x in set(filling)}
            times = min(loose[x] // n for x, n in used.items())
            bulk.append((times, filling))
            for x, n in used.items():
                tail[x] -= n * times
    tail = {x: n for x, n in tail.items() if n}
    done, budget = sum(n for n, _ in bulk), [NODES]
    better = best_fit(tail, capacity)
    goal = sum(n for n, _ in better)
    if done + goal > most:
        better, goal = None, most - done
    while goal > max(least - done, least_bins(tail, capacity)):
        packed = _search(tail, capacity, goal - 1, budget)
        if packed is None:
            break
        better, goal = [(1, x) for x in packed], len(packed)
    return found if better is None else bulk + better


def places(found: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, lo, hi, sequence, step offset): pieces lo to hi - 1 of a length stand at this offset of sequences sequence, sequence + 1, ..."""
    rows, seen, sequence = [], {}, 0
    for times, filling in found:
        at = 0
        for x in filling:
            lo = seen.get(x, 0)
            rows.append((x, lo, lo + times, sequence, at))
            seen[x] = lo + times
            at += x
        sequence += times
    return rows


def pack(pieces_df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the pieces. pieces_df must give the same rows whenever it is read, as a written table does.

    To the driver goes one count for each length (as many as the capacity at
    most); back goes the list of fillings. A piece's rank among those of its
    length is its number within its task and the pieces of the tasks before, so
    no piece is sorted. Pieces that fill a sequence take one each, by task and
    number, below 0.
    """
    spark = pieces_df.sparkSession
    short = pieces_df.where(F.col("length") < capacity)
    counts = C.materialize(short.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begin = C.materialize(counts.select(F.col("length").alias("_length"), F.col("task").alias("_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin")), "piece-starts")
    by_length = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(fillings(by_length, capacity))
    spots = spark.createDataFrame(where, "length long, lo long, hi long, sequence long, offset long")
    spots = spots.groupBy(F.col("length").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "sequence", "offset"))).alias("spots"))
    # A row for each length and task: whether it is broadcast is left to its size.
    ranked = short.join(begin, (short["length"] == begin["_length"]) & (short["task"] == begin["_task"])).withColumn("_rank", F.col("number") + F.col("_begin"))
    ranked = ranked.join(F.broadcast(spots), F.col("length") == F.col("_of"))
    spot = F.get(F.filter("spots", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"])), F.lit(0))
    columns = ("doc_id", "piece", "start", "length", "ids")
    placed = ranked.withColumn("_spot", spot).select(*columns, (F.col("_spot.sequence") + F.col("_rank") - F.col("_spot.lo")).alias("sequence_id"), F.col("_spot.offset").alias("offset"))
    full = pieces_df.where(F.col("length") == capacity)
    own = -1 - (F.shiftleft(F.col("task").cast("long"), 36) + F.col("number"))
    return placed.unionByName(full.select(*columns, own.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """All documents, tokenised and packed: doc_id, piece, start, length, ids, sequence_id, offset. Empty table: no rows. Repeated rows are packed each."""
    written = C.materialize(pieces(docs, vocabulary, id_col=id_col, text_col=text_col, capacity=capacity), "pieces")
    return pack(written, capacity)

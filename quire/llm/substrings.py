"""Removal of repeated substrings, by bounded interval expansion on Burrows-Wheeler transforms.

Of every string of min_length bytes the gram with the least hash is its anchor;
equal strings have equal anchors at equal places, so only strings around an
anchor that occurs twice or more can repeat. The stretches of text around such
anchors (contexts) meet by anchor; equal ones are counted before they travel, and
each goes to a block once, with its number as weight.
Blocks of contexts get a suffix order over symbols of q bytes, as far as min_length,
which says which suffix comes first but not how much neighbours share. The common
prefixes are derived from its Burrows-Wheeler transform: intervals of suffixes that
share a prefix are extended backward by a symbol, breadth first, so that boundaries
appear by increasing common prefix, up to min_length and no further. Intervals that
then weigh two or more are the repeats: every repeat within a block is found there,
that of equal contexts too. An anchor with more contexts than a block takes is dealt
over several; what weighs one in its own block is then looked up among the classes
of the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import text as T

U64 = np.uint64
MIN_LENGTH = 200
GRAM = 40
#: Bytes of contexts in one transform, about.
BLOCK = 1 << 19
#: Different contexts of one anchor in one block, about; an anchor with more of them, or of more bytes than a block, is dealt over several.
HOT = 4096
#: Bytes of text hashed at a time.
SEGMENT = 1 << 20

_BYTE = T.mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n of them at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, U64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[:] = made
    return _powers[0], _powers[1]


class Prefixes:
    """Hashes of any substring, from hashes of all prefixes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return T.mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, k: int) -> np.ndarray:
        n = max(len(self.sums) - k, 0)
        return T.mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive elements."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def anchors(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For the strings of one text, in runs that share an anchor: hash, first start, number of starts, place of the anchor, hash of the run's context."""
    prefixes = Prefixes(data)
    h = prefixes.grams(k)
    w = length - k + 1
    least = sliding_min(h, w)
    begin = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    end = np.append(begin[1:], len(least))
    place = np.empty(len(begin), np.int64)
    for lo in range(0, len(begin), 1 << 13):
        b = begin[lo : lo + (1 << 13)]
        place[lo : lo + len(b)] = b + (h[b[:, None] + np.arange(w)] == least[b][:, None]).argmax(axis=1)
    tied = np.flatnonzero(place < end - 1)
    if len(tied):  # the same least gram again: each string goes to its leftmost one
        parts = [np.stack([begin, end, place], axis=1)[place >= end - 1]]
        for i in tied.tolist():
            starts = np.arange(begin[i], end[i])
            spots = np.flatnonzero(h[begin[i] : end[i] + w - 1] == least[begin[i]]) + begin[i]
            own = spots[np.searchsorted(spots, starts)]
            first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            parts.append(np.stack([starts[first], np.append(starts[first[1:]], end[i]), own[first]], axis=1))
        begin, end, place = np.concatenate(parts).T
    size = end - begin
    context = T.mix(prefixes.of(begin, end - 1 + length) + T.mix((size << 20 | (place - begin)).astype(U64)))
    return h[place], begin, size, place - begin, context


def _keys(rank: np.ndarray, *later: np.ndarray) -> np.ndarray:
    """Numbers that order the rows (rank, *later), equal rows alike."""
    for x in later:
        width = int(x.max()) + 1
        if (int(rank.max()) + 1) * width >= 1 << 62:
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        rank = rank * width + x
    return rank


def suffix_ranks(first: np.ndarray, q: int, levels: int | None = None) -> np.ndarray:
    """Place of each suffix in the order of all, read in steps of q; first: ranks of the symbols. No two suffixes are equal: each ends in a symbol of its own.

    With levels, those that share so many symbols follow one another in any order.
    """
    n, rank, have = len(first), first, 1
    while int(rank.max()) + 1 < n:  # each round compares three times as many symbols
        later = []
        for ahead in (have * q, 2 * have * q):
            x = np.zeros(n, np.int64)
            x[: max(n - ahead, 0)] = rank[ahead:] + 1
            later.append(x)
        key, have = _keys(rank, *later), have * 3
        if levels is not None and have >= levels:
            rank = np.empty(n, np.int64)
            rank[np.argsort(key)] = np.arange(n)
        else:
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    return rank


def common_prefixes(order: np.ndarray, rank: np.ndarray, first: np.ndarray, q: int, levels: int) -> np.ndarray:
    """How many symbols each suffix shares with the one before it in the order; levels stands for so many or more.

    Put before suffix source[j], the symbol that leads suffix j gives j: read
    the other way, that is the transform. An interval of suffixes that share d
    symbols goes, extended backward by one symbol, to intervals that share
    d + 1. So neighbours that share their lead part at d + 1 if a boundary
    found so far lies between their sources, and boundaries come by increasing d.
    """
    n = len(order)
    source, leads = rank[np.minimum(order + q, n - 1)], first[order]
    common = np.full(n, levels, np.int64)
    common[0] = 0
    common[1:][leads[1:] != leads[:-1]] = 0
    for depth in range(1, levels):
        still = np.flatnonzero(common == levels)
        interval = np.cumsum(common < depth)
        common[still[interval[source[still]] != interval[source[still - 1]]]] = depth
    return common


def repeats(contexts: list[bytes], sizes: np.ndarray, weights: np.ndarray, length: int) -> tuple[list[np.ndarray], list[np.ndarray], Prefixes, np.ndarray]:
    """Of the first sizes[i] starts of each context, which stands for weights[i] places: those whose string of length bytes starts twice or more in all, and one start of each class of equal strings.

    Also the hashes of substrings of all contexts, one after the other, and where each context begins.
    """
    q = max(d for d in range(1, 33) if length % d == 0)
    data = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8)  # a byte after each context, where every suffix ends at the latest
    room = np.array([len(c) for c in contexts])
    begins = np.cumsum(room + 1) - room - 1
    n = len(data)
    at = np.arange(n)
    prefixes = Prefixes(data)
    whole = np.repeat(begins + room, room + 1) - at >= q
    symbol = T.mix(at.astype(U64) | U64(1 << 63))  # a symbol that would leave its context equals no other
    symbol[whole] = prefixes.of(at[whole], at[whole] + q)
    first = np.unique(symbol, return_inverse=True)[1].astype(np.int64)
    levels = length // q
    rank = suffix_ranks(first, q, levels)
    order = np.empty(n, np.int64)
    order[rank] = at
    parted = common_prefixes(order, rank, first, q, levels) < levels
    interval = np.cumsum(parted) - 1  # suffixes that share min_length bytes
    weight = np.bincount(interval, weights=np.repeat(weights, room + 1)[order])
    twice, leader = np.empty(n, bool), np.empty(n, bool)
    twice[order] = weight[interval] >= 2
    leader[order] = parted
    some = lambda marked: [np.flatnonzero(marked[b : b + s]) for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]
    return some(twice), some(leader), prefixes, begins


def _key(text, doc_id="doc_id"):
    """What tells texts apart, and the documents that have the same one."""
    return [F.xxhash64(text).alias("t1"), F.octet_length(text).alias("nb"), F.xxhash64(doc_id).alias("d")]


def find_anchors(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Rows (t1, nb, d, a, c, s, n, o): text, document, anchor, context, first start, number of starts, place of the anchor in the context."""

    def scan(batches):
        for batch in batches:
            for rows in T.steps(batch, "text"):
                data, offsets = T.buffer_of(rows.column(3))
                (t1, nb, d), out = (rows.column(i).to_numpy() for i in range(3)), []
                for i in range(rows.num_rows):
                    own = data[offsets[i] : offsets[i + 1]]
                    for lo in range(0, len(own) - length + 1, SEGMENT):
                        part = own[lo : lo + SEGMENT + length - 1]
                        a, s, n, o, c = anchors(part, length, k)
                        out.append((np.full(len(a), t1[i]), np.full(len(a), nb[i]), np.full(len(a), d[i]), a.view(np.int64), c.view(np.int64), s + lo, n.astype(np.int32), o.astype(np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["t1", "nb", "d", "a", "c", "s", "n", "o"])

    return texts.select(*_key("text"), "text").mapInArrow(scan, "t1 long, nb int, d long, a long, c long, s long, n int, o int")


def _cut_contexts(wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the contexts that a text stands for."""

    def cut(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                raw = batch.column(0)[j].as_buffer()
                own = batch.column(1)[j].values
                a, c, s, n, part, parts, times = (own.field(i).to_numpy() for i in range(7))
                view = memoryview(raw)
                pieces = [bytes(view[x : x + y + length - 1]) for x, y in zip(s.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(part), pa.array(c), pa.array(n), pa.array(parts), pa.array(times), pa.array(pieces, pa.binary())], ["a", "part", "c", "n", "parts", "times", "context"])

    return wanted.mapInArrow(cut, "a long, part int, c long, n int, parts int, times int, context binary")


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.append(cut, len(places) - 1)].tolist(), strict=True))


RUNS = "array<struct<lo:int,hi:int>>"


CLASSES = "array<struct<p:int,h:long,alone:boolean>>"


def _expand(contexts: DataFrame, length: int) -> DataFrame:
    """Rows (a, c, runs, classes): the repeated starts of each context within its block; of anchors dealt over several blocks also a start and hash of each class of equal strings."""
    runs_type = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    classes_type = pa.list_(pa.struct([("p", pa.int32()), ("h", pa.int64()), ("alone", pa.bool_())]))

    def solve(held):
        twice, leaders, prefixes, begins = repeats([x[6] for x in held], np.array([x[3] for x in held]), np.array([x[5] for x in held]), length)
        rows = []
        for (a, _, c, _, parts, _, _), starts, lead, begin in zip(held, twice, leaders, begins.tolist(), strict=True):
            classes = []
            if parts > 1 and len(lead):
                h = prefixes.of(begin + lead, begin + lead + length).view(np.int64)
                classes = [{"p": p, "h": x, "alone": y} for p, x, y in zip(lead.tolist(), h.tolist(), (~np.isin(lead, starts)).tolist(), strict=True)]
            if len(starts) or classes:
                rows.append((a, c, [{"lo": lo, "hi": hi} for lo, hi in _runs(starts)], classes))
        if rows:
            a, c, runs, classes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(runs, runs_type), pa.array(classes, classes_type)], ["a", "c", "runs", "classes"])

    def expand(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and row[:3] == held[-1][:3]:
                    continue  # one context of texts that are equal
                if size > BLOCK and row[:2] != last:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[6]), row[:2]
        if held:
            yield from solve(held)

    return contexts.repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", "c").mapInArrow(expand, f"a long, c long, runs {RUNS}, classes {CLASSES}")


def _solved(contexts: DataFrame, length: int) -> DataFrame:
    """Rows (a, c, runs): the repeated starts of each context, whichever block its equals are in."""
    blocks = C.materialize(_expand(contexts, length), "expanded")
    # A class of one string that has an equal in another block of its anchor. As many rows share a hash as an anchor has blocks.
    classes = blocks.select("a", "c", F.explode("classes").alias("x")).select("a", "c", "x.p", "x.h", "x.alone")
    again = classes.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select(F.col("h").alias("_h"))
    met = classes.where("alone").join(again, F.col("h") == F.col("_h"), "left_semi")
    more = met.groupBy("a", "c").agg(F.collect_list(F.struct(F.col("p").alias("lo"), F.col("p").alias("hi"))).alias("runs"))
    return blocks.select("a", "c", "runs").unionByName(more).groupBy("a", "c").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def repeated_starts(texts: DataFrame, length: int = MIN_LENGTH, k: int = GRAM) -> DataFrame:
    """For each different text with repeats, (t1, nb, runs, copies): runs (start, size) of places where a string starts that also starts elsewhere; copies: rows that have the text."""
    found = C.materialize(find_anchors(texts, length, k), "anchors")
    total = found.count()
    counts = C.materialize(found.groupBy(F.col("a").alias("_a")).agg(F.count("*").alias("times")).where("times > 1"), "anchor-counts")
    # Anchors of a passage that very many texts share: their rows are dealt over many tasks, here and below.
    common = C.materialize(C.heavy_keys(counts, "_a", "times", total), "common-anchors")
    again = C.salted_join(found, counts, "a", "_a", common, ["t1", "s"], "left_semi")
    # Equal texts give equal rows: from here on, each once, with its number and one document that has it.
    places = C.materialize(again.groupBy("t1", "nb", "a", "c", "s", "n", "o").agg(F.count("*").alias("times"), F.min("d").alias("d")), "anchors-twice")
    C.release(found)
    contexts = C.materialize(places.groupBy("a", "c").agg(F.sum("times").alias("times"), F.min(F.struct("t1", "nb", "d", "s", "n")).alias("rep")), "contexts")
    per_anchor = contexts.groupBy(F.col("a").alias("_a")).agg(F.count("*").alias("kinds"), F.sum(F.col("rep.n") + (length - 1)).alias("room"))
    parts = F.greatest(F.ceil(F.col("kinds") / HOT), F.ceil(F.col("room") / BLOCK)).cast("int")
    mixed = C.salted_join(contexts, per_anchor, "a", "_a", common, ["c"]).withColumn("parts", parts)
    piece = F.struct("a", "c", F.col("rep.s").alias("s"), F.col("rep.n").alias("n"), F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"), "parts", F.least("times", F.lit(2)).cast("int").alias("times"))
    wanted = mixed.groupBy(F.col("rep.t1").alias("_t1"), F.col("rep.nb").alias("_nb"), F.col("rep.d").alias("_d")).agg(F.collect_list(piece).alias("own"))
    keyed = texts.select(*_key("text"), "text")
    # One of the rows that have a text cuts its contexts (rows of one id and one text: each, and equal contexts are skipped later).
    holders = keyed.join(wanted, (keyed["t1"] == wanted["_t1"]) & (keyed["nb"] == wanted["_nb"]) & (keyed["d"] == wanted["_d"])).select(F.col("text").cast("binary").alias("text"), "own")
    solved = _solved(_cut_contexts(holders, length), length).select(F.col("a").alias("_a"), F.col("c").alias("_c"), "runs")
    kinds = contexts.join(solved, (contexts["a"] == solved["_a"]) & (contexts["c"] == solved["_c"]))
    kinds = C.materialize(kinds.select(F.col("a").alias("_ka"), F.col("c").alias("_kc"), F.col("times").alias("_all"), "runs"), "repeats")
    own = C.salted_join(places, kinds, "c", "_kc", C.heavy_keys(kinds, "_kc", "_all", total), ["t1", "s"], also=("a", "_ka"))
    spans = F.transform("runs", lambda r: F.struct((F.col("s") + r["lo"]).alias("start"), (r["hi"] - r["lo"] + 1).alias("size")))
    return own.groupBy("t1", "nb").agg(F.sort_array(F.flatten(F.collect_list(spans))).alias("runs"), F.max("times").alias("copies"))


def remove_repeats(docs: DataFrame, *, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """All rows without the bytes that repeat: doc_id, n_bytes, kept (binary), text, spans (start, end) removed, and the columns named in keep.

    A byte goes if a string of min_length bytes that also starts anywhere else,
    in the same text or another, covers it; strings are judged on the input.
    Null texts are empty; texts shorter than min_length stay as they are.
    Repeated rows, being copies, lose all their bytes. The cut may fall within
    a character, so what is kept is bytes; text has them without such rests.
    """
    C.ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    runs = C.materialize(repeated_starts(base, min_length, min(GRAM, min_length)), "starts").select(F.col("t1").alias("_t1"), F.col("nb").alias("_nb"), "runs", "copies")
    copied = C.heavy_keys(runs, "_t1", "copies", base.count())
    joined = C.salted_join(base.select("*", *_key("text")), runs, "t1", "_t1", copied, ["d"], "left", also=("nb", "_nb"))
    joined = joined.select("doc_id", F.col("text").cast("binary").alias("text"), "runs", *[f"_keep_{c}" for c in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name not in ("text", "runs")]

    def cut(batches):
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in (rows for whole in batches for rows in T.steps(whole, "text")):
            sizes, kept, spans = [], [], []
            for j in range(batch.num_rows):
                raw, own = batch.column(1)[j].as_buffer(), batch.column(2)[j]
                removed = []
                for r in own.as_py() if own.is_valid else ():
                    start, end = r["start"], r["start"] + r["size"] + min_length - 1
                    if removed and start <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], end)
                    else:
                        removed.append([start, end])
                view, at, parts = memoryview(raw), 0, []
                for start, end in removed:
                    parts.append(view[at:start])
                    at = end
                parts.append(view[at:])
                sizes.append(len(view))
                kept.append(b"".join(parts))
                spans.append([{"start": a, "end": b} for a, b in removed])
            rest = [batch.column(i) for i in range(batch.num_columns) if i not in (1, 2)]
            names = [x for x in batch.schema.names if x not in ("text", "runs")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), pa.array(spans, kinds)], [*names, "n_bytes", "kept", "text", "spans"])

    out = joined.mapInArrow(cut, ", ".join([*fields, "n_bytes long, kept binary, text string, spans array<struct<start:long,end:long>>"]))
    return out.select("doc_id", "n_bytes", "kept", "text", "spans", *[F.col(f"_keep_{c}").alias(c) for c in keep])

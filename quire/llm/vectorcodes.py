"""Compression of vectors to short codes.

Vectors are cut into equal parts and each part is replaced by the number of the
nearest entry of its position's codebook. The nearest entry is found by annular
pruning: entries are sorted by norm, and as a distance is at least the difference
of the norms, only entries whose norms lie within the best distance so far, edges
included, are measured.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Integers stay within 2 ** 28, so that sums of 32 squares of differences fit into 64 bits.
LARGEST = 1 << 28
#: Rows of a batch worked on at a time.
STEP = 1 << 14


class Annulus:
    """The entries of one codebook, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.entries, self.norms = entries[self.order], norms[self.order]
        self.measured = 0

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry of each row and the squared distance; ties go to the lower number."""
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        best_at, best = np.full(len(rows), len(self.order), np.int64), np.full(len(rows), np.iinfo(np.int64).max)
        start = np.searchsorted(self.norms, norms)
        # The entry next in norm gives the first distance; its annulus bounds all that is looked at later.
        first = np.minimum(start, len(self.order) - 1)
        self._measure(rows, np.arange(len(rows)), first, best_at, best)
        # Norms are rounded to 53 bits, so the annulus is widened by more than that can be.
        reach = np.sqrt(best.astype(np.float64))
        slack = (norms + reach + self.norms[-1]) * 1e-14 + 1e-9
        low = np.searchsorted(self.norms, norms - reach - slack, "left")
        high = np.searchsorted(self.norms, norms + reach + slack, "right")
        for k in range(1, len(self.order)):
            open_rows = False
            for at in (first - k, first + k):
                inside = np.flatnonzero((at >= low) & (at < high))
                if len(inside):
                    open_rows = True
                    # A closer entry has been found for some meanwhile: only what is in the narrower annulus counts.
                    gap = np.abs(self.norms[at[inside]] - norms[inside]) - slack[inside]
                    inside = inside[gap <= np.sqrt(best[inside].astype(np.float64))]
                    self._measure(rows, inside, at[inside], best_at, best)
            if not open_rows:
                break
        return best_at, best

    def _measure(self, rows: np.ndarray, which: np.ndarray, at: np.ndarray, best_at: np.ndarray, best: np.ndarray) -> None:
        self.measured += len(which)
        d = rows[which] - self.entries[at]
        d, number = (d * d).sum(axis=1), self.order[at]
        closer = (d < best[which]) | (d == best[which]) & (number < best_at[which])
        best[which[closer]], best_at[which[closer]] = d[closer], number[closer]


def _integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int, scale: int) -> DataFrame:
    """Rows whose vectors are whole (id, label, v: integers); vectors are padded with zeros to the longest one's length, rounded up to whole parts."""
    v = F.col(vector_col)
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    base = vectors.where(good).select(F.col(id_col).alias("id"), label.alias("label"), F.transform(v, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")).alias("v"))
    base = C.materialize(base, "vectors")
    longest = base.agg(F.max(F.size("v"))).first()[0] or 0
    wide = -(-longest // parts) * parts
    return base.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(wide) - F.size("v")))), wide


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), wide)


def _parts(books: np.ndarray, rows: np.ndarray, width: int):
    for p in range(len(books)):
        yield p, rows[:, p * width : (p + 1) * width], Annulus(books[p])


def _sums(whole: DataFrame, books: np.ndarray, wide: int) -> list:
    """For each part position and entry the rows it is nearest to: (part, entry, n, sums of components). Each task sums its own first."""
    parts, width = len(books), wide // len(books)

    def sum_up(batches):
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                rows = _matrix(batch.column(0).slice(begin, STEP), wide)
                for p, own, ring in _parts(books, rows, width):
                    nearest, _ = ring.nearest(own)
                    np.add.at(n[p], nearest, 1)
                    np.add.at(total[p], nearest, own)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e]), "total": pa.array(total[p, e].tolist(), pa.list_(pa.int64()))})

    found = whole.select("v").mapInArrow(sum_up, "part int, entry int, n long, total array<long>")
    sums = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"_{i}") for i in range(width)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[x for x in sums]).alias("total")).collect()  # parts * entries rows


def quantize(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (id, label, codes, errors: squared distances by part) and the codebooks (part, entry, component).

    Components become integers floor(scale * x), within 2 ** 28 either way.
    Vectors that are null or hold null or non-finite components give no row; one
    that is shorter than the longest counts as filled up with zeros. Codebooks
    begin as the parts of the first vectors by id (null ids last, ties by vector;
    fewer rows than entries: fewer entries). Each round moves an entry to the
    componentwise floor of the mean of what is nearest to it; an entry that is
    nearest to nothing stays. Ties go to the lower entry. Repeated rows each count.
    An empty table gives no rows and codebooks without entries.
    The driver holds the codebooks and one row of sums for each entry.
    """
    C.ship(vectors.sparkSession)
    whole, wide = _integers(vectors, id_col, vector_col, label_col, parts, scale)
    width = wide // parts
    first = whole.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        moved = books.copy()
        for r in _sums(whole, books, wide):
            moved[r.part, r.entry] = [int(x) // r.n for x in r.total]
        books = moved
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema.fields}

    def encode(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                some = batch.slice(begin, STEP)
                rows = _matrix(some.column(2), wide)
                codes, errors = np.empty((len(rows), parts), np.int32), np.empty((len(rows), parts), np.int64)
                for p, own, ring in _parts(books, rows, width):
                    codes[:, p], errors[:, p] = ring.nearest(own)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, parts, dtype=np.int32)), pa.array(x.ravel())) for x in (codes, errors)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *lists], ["id", "label", "codes", "errors"])

    return whole.select("id", "label", "v").mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, errors array<long>"), books


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Integers that rows of codes stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add error, the sum over parts, and label_error, the sum of error over rows of the same label, nulls together. Labels with many rows are dealt over many tasks."""
    error = F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = C.materialize(coded.withColumn("error", error).withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    sums = C.materialize(rows.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")).withColumnRenamed("_key", "_of"), "labels")
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return C.salted_join(rows, sums.drop("_n"), "_key", "_of", C.heavy_keys(sums, "_of", "_n", total), ["id", "codes"]).drop("_key", "_of")

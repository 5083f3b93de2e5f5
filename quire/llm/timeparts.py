"""Partitions by time that adapt to the data.

Years with more rows than a limit split into months, those into days and hours;
siblings within the limit form runs. The driver sees counts by hour, of the years
that split alone (fewer than rows / limit years, so a bounded number of hours):
they make one dense array of prefix sums, in which a node's count is a difference
and the end of a run is found by bisection. The sorted beginnings of the leaves
then route all rows, many at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokenfile import filesystem

#: Rows and bytes gathered before a row group is written.
GROUP_ROWS = 1 << 17
GROUP_BYTES = 32 << 20
NULL_LEAF = "null"
_UNITS = ("Y", "M", "D", "h")


@dataclass
class Leaf:
    name: str
    begin: int  # hours since 1970
    rows: int
    fresh: int


class Counts:
    """Prefix sums of rows, and of new ones, over years and over the hours of the years that split."""

    def __init__(self, years: list[tuple[int, int, int]], hours: list[tuple[int, int, int]], limit: int):
        """years: (year, rows, new rows) of all years with rows; hours: (hour since 1970, rows, new rows) of the years above the limit."""
        self.limit = limit
        self.split = sorted(y for y, n, _ in years if n > limit)
        self.first = min((y for y, *_ in years), default=0)
        last = max((y for y, *_ in years), default=-1)
        self.years = np.zeros((max(last - self.first + 1, 0), 2), np.int64)
        for y, n, fresh in years:
            self.years[y - self.first] = n, fresh
        begins = np.array([_hour(y) for y in self.split], np.int64)
        sizes = np.array([_hour(y + 1) for y in self.split], np.int64) - begins
        self.offset = dict(zip(self.split, (np.cumsum(sizes) - sizes - begins).tolist(), strict=True))
        dense = np.zeros((int(sizes.sum()) + 1, 2), np.int64)
        if hours:
            at = np.array(hours, np.int64)
            where = np.searchsorted(begins, at[:, 0], "right") - 1
            dense[at[:, 0] + (np.cumsum(sizes) - sizes - begins)[where] + 1] = at[:, 1:]
        self.dense = np.cumsum(dense, axis=0)

    def leaves(self) -> list[Leaf]:
        """All runs and hours above the limit in time order, empty ones included."""
        bounds = np.array([_hour(self.first + i) for i in range(len(self.years) + 1)], np.int64)
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(self.years, axis=0)])
        return list(self._runs(bounds, sums, [f"{self.first + i:04d}" for i in range(len(self.years))], "", 0))

    def _runs(self, bounds: np.ndarray, sums: np.ndarray, names: list[str], parents: str, level: int) -> Iterator[Leaf]:
        i, rows = 0, sums[:, 0]
        while i < len(names):
            end = i + 1
            if rows[end] - rows[i] > self.limit:
                if level < 3:
                    yield from self._children(int(bounds[i]), int(bounds[end]), f"{parents}{names[i]}/", level + 1)
                    i = end
                    continue
            else:
                # Sums never fall, so a sibling above the limit ends a run by itself.
                end = int(np.searchsorted(rows, rows[i] + self.limit, "right")) - 1
            n, fresh = (sums[end] - sums[i]).tolist()
            yield Leaf(f"{parents}{names[i]}-{names[end - 1]}", int(bounds[i]), n, fresh)
            i = end

    def _children(self, begin: int, end: int, parents: str, level: int) -> Iterator[Leaf]:
        unit = _UNITS[level]
        bounds = np.arange(np.datetime64(begin, "h").astype(f"M8[{unit}]"), np.datetime64(end, "h").astype(f"M8[{unit}]") + 1).astype("M8[h]").astype(np.int64)
        sums = self.dense[bounds + self.offset[int(parents[:4])]]
        names = [f"{i:02d}" for i in (range(len(bounds) - 1) if unit == "h" else range(1, len(bounds)))]
        yield from self._runs(bounds, sums, names, parents, level)


def _hour(year: int) -> int:
    return int(np.datetime64(f"{year:04d}" if year < 10000 else f"+{year}", "Y").astype("M8[h]").astype(np.int64))


def _prepared(rows: DataFrame, moment: Column, new: Column | None) -> DataFrame:
    moment = moment.cast("timestamp_ntz")
    fresh = F.coalesce(new, F.lit(False)) if new is not None else F.lit(False)
    out = rows.withColumn("_q_moment", moment).withColumn("_q_new", fresh)
    return out.withColumn("_q_hour", F.datediff(F.col("_q_moment").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("_q_moment"))


def count(prepared: DataFrame, limit: int) -> tuple[Counts, Leaf]:
    """Counts by year and, of the years that split, by hour; and the leaf of rows without a moment. One row for each hour with rows is written, no more than the calendar has."""
    by_hour = prepared.groupBy("_q_hour").agg(F.first(F.year("_q_moment")).alias("year"), F.count("*").alias("n"), F.count_if("_q_new").alias("fresh"))
    by_hour = C.materialize(by_hour, "hours")
    years = by_hour.groupBy("year").agg(F.sum("n").alias("n"), F.sum("fresh").alias("fresh")).collect()
    split = [r.year for r in years if r.year is not None and r.n > limit]
    hours = by_hour.where(F.col("year").isin(split)).select("_q_hour", "n", "fresh").collect() if split else []
    null = next(((r.n, r.fresh) for r in years if r.year is None), (0, 0))
    return Counts([tuple(r) for r in years if r.year is not None], [tuple(r) for r in hours], limit), Leaf(NULL_LEAF, 0, *null)


class _Part:
    """One Parquet file in the making, and the digests of what it holds."""

    def __init__(self, folder: str, leaf: str, part: int, schema: pa.Schema, id_col: str):
        import pyarrow.parquet as pq

        self.fs, inner = filesystem(folder)
        name = f"{leaf}/part-{part:06d}-{uuid.uuid4().hex}.parquet"
        self.path, self.inner = f"{folder}/{name}", f"{inner}/{name}"
        self.fs.create_dir(self.inner.rpartition("/")[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.inner)
        self.writer = pq.ParquetWriter(self.stream, schema, compression="zstd")
        self.schema, self.id_at = schema, schema.get_field_index(id_col)
        self.held, self.held_bytes, self.n, self.fresh = [], 0, 0, 0
        self.ids = hashlib.sha256()
        self.columns = [[hashlib.sha256() for _ in range(3)] for _ in schema]

    def add(self, batch: pa.RecordBatch, fresh: int) -> None:
        ids = ",".join(map(str, ["null" if x is None else x for x in batch.column(self.id_at).to_pylist()]))
        self.ids.update((("," if self.n else "") + ids).encode())
        self.n, self.fresh = self.n + batch.num_rows, self.fresh + fresh
        for column, hashes in zip(batch.columns, self.columns, strict=True):
            _feed(column, hashes)
        self.held.append(batch)
        self.held_bytes += batch.nbytes
        if self.held_bytes >= GROUP_BYTES or sum(b.num_rows for b in self.held) >= GROUP_ROWS:
            self._write()

    def _write(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held, self.schema))
            self.held, self.held_bytes = [], 0

    def close(self) -> tuple[str, str]:
        """The digests of the ids and of all columns."""
        self._write()
        self.writer.close()
        self.stream.close()
        return self.ids.hexdigest(), hashlib.sha256(b"".join(h.digest() for hashes in self.columns for h in hashes)).hexdigest()

    def drop(self) -> None:
        self.fs.delete_file(self.inner)


def _feed(column: pa.Array, hashes: list) -> None:
    """Nulls, sizes and bytes of a column, however its rows are cut into batches."""
    nulls, sizes, values = hashes
    nulls.update(np.asarray(column.is_null().to_numpy(zero_copy_only=False), np.uint8).tobytes())
    kind = column.type
    if pa.types.is_boolean(kind) or pa.types.is_floating(kind) or pa.types.is_integer(kind):
        values.update(column.fill_null(0 if kind != pa.bool_() else False).to_numpy(zero_copy_only=False).tobytes())
    elif pa.types.is_timestamp(kind):
        values.update(column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).tobytes())
    else:
        texts = [b"" if x is None else x if isinstance(x, bytes) else str(x).encode() for x in column.to_pylist()]
        sizes.update(np.array([len(x) for x in texts], np.int64).tobytes())
        values.update(b"".join(texts))


MANIFEST = "leaf string, part int, n_rows long, n_new long, ids_sha256 string, rows_sha256 string, path string, rewritten boolean"


def _write(prepared: DataFrame, columns: list[str], leaves: list[Leaf], null: Leaf, wanted: set[str], folder: str, order: list[str], id_col: str, limit: int, before: dict) -> DataFrame:
    """Write the rows of the wanted leaves, a file for each part; a part that is in before with the same rows is not kept twice. Rows of MANIFEST."""
    begins = np.array([x.begin for x in leaves], np.int64)
    every = [*leaves, null]
    chosen = np.array([x.name in wanted for x in every], bool)

    @F.pandas_udf("int")
    def leaf_of(hour: pd.Series) -> pd.Series:
        known = hour.notna().to_numpy()
        at = np.full(len(hour), len(begins), np.int64)
        at[known] = np.searchsorted(begins, hour[known].to_numpy(np.int64), "right") - 1
        return pd.Series(np.where(chosen[at], at, -1).astype(np.int32))

    routed = prepared.withColumn("_q_leaf", leaf_of("_q_hour")).where("_q_leaf >= 0").withColumn("_q_tie", F.xxhash64(*columns))
    kept = routed.select(*columns, "_q_new", "_q_leaf", "_q_moment", "_q_tie")
    ranked = C.numbered(kept, "_q_rank", "_q_leaf", "_q_moment", *order, "_q_tie")

    # Where files begin among all rows in order; parts of a leaf follow one another.
    files, at = [], 0
    for leaf in (x for x in every if x.name in wanted and x.rows):
        files += [(leaf.name, part + 1, at + part * limit) for part in range(-(-leaf.rows // limit))]
        at += leaf.rows
    starts = np.array([x[2] for x in files], np.int64)

    @F.pandas_udf("int")
    def file_of(rank: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(starts, rank.to_numpy(np.int64), "right") - 1).astype(np.int32))

    def write(batches):
        out: list[tuple] = []
        part: _Part | None = None
        number = -1

        def finish():
            ids, rows = part.close()
            leaf, k, _ = files[number]
            held = before.get((leaf, k))
            if held and held[0] == rows:
                part.drop()
                out.append((leaf, k, part.n, 0, ids, rows, held[1], False))
            else:
                out.append((leaf, k, part.n, part.fresh, ids, rows, part.path, True))

        for batch in batches:
            of = batch.column(len(columns) + 1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if of[a] != number:
                        if part is not None:
                            finish()
                        number = int(of[a])
                        own = pa.schema([batch.schema.field(i) for i in range(len(columns))])
                        part = _Part(folder, *files[number][:2], own, id_col)
                    some = batch.slice(a, b - a)
                    part.add(pa.RecordBatch.from_arrays(some.columns[: len(columns)], schema=part.schema), some.column(len(columns)).true_count)
        if part is not None:
            finish()
        if out:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    dealt = ranked.withColumn("_q_file", file_of("_q_rank")).repartition("_q_file").sortWithinPartitions("_q_file", "_q_rank")
    return C.materialize(dealt.select(*columns, "_q_new", "_q_file").mapInArrow(write, MANIFEST), "time-files")


def _check(rows: DataFrame, order: list[str], id_col: str) -> list[str]:
    if clash := [c for c in rows.columns if c.startswith("_q_")]:
        raise ValueError(f"columns {clash} have names that are used within")
    if id_col not in rows.columns or not set(order) <= set(rows.columns):
        raise ValueError("the id and the order are columns of the rows")
    return rows.columns


def write(rows: DataFrame, folder: str, *, moment: Column, order: list[str], id_col: str, limit: int) -> DataFrame:
    """Write all rows into the folder, by leaves of moments and parts of limit rows in the order of moment and the columns named: a row of MANIFEST for each file.

    Rows without a moment are the leaf null. Nulls of the order come first, ties
    are ordered by a hash of the whole row, repeated rows all stay. An empty table
    writes nothing. All columns are written and no others; names that begin with
    _q_ are refused. A file is written by one task as a stream, under a name of
    its attempt; the rows returned name the files that count.
    """
    columns = _check(rows, order, id_col)
    C.ship(rows.sparkSession)
    prepared = _prepared(rows, moment, None)
    counts, null = count(prepared, limit)
    leaves = counts.leaves()
    return _write(prepared, columns, leaves, null, {x.name for x in [*leaves, null] if x.rows}, folder, order, id_col, limit, {})


def rewrite(rows: DataFrame, manifest: DataFrame, folder: str, *, moment: Column, order: list[str], id_col: str, limit: int, new: Column) -> DataFrame:
    """Bring the files of an earlier write() to the layout of all rows, of which those where new is true are in none of them.

    A leaf without new rows that was there before keeps its files, and its rows
    are not moved. In the others a part whose rows recur under the same leaf and
    number keeps its file as well. All other data files in the folder go. Returns
    rows of MANIFEST; rewritten is false for files that stay.
    """
    columns = _check(rows, order, id_col)
    spark = rows.sparkSession
    C.ship(spark)
    prepared = _prepared(rows, moment, new)
    counts, null = count(prepared, limit)
    leaves = counts.leaves()
    was = manifest.select("leaf", "part", "n_rows", "rows_sha256", "path").collect()  # a row for each file: at most rows / limit more than there are leaves
    had: dict[str, int] = {}
    for r in was:
        had[r.leaf] = had.get(r.leaf, 0) + r.n_rows
    present = [x for x in [*leaves, null] if x.rows]
    stays = {x.name for x in present if not x.fresh and had.get(x.name) == x.rows}
    made = _write(prepared, columns, leaves, null, {x.name for x in present} - stays, folder, order, id_col, limit, {(r.leaf, r.part): (r.rows_sha256, r.path) for r in was})
    kept = manifest.where(F.col("leaf").isin(sorted(stays))).withColumn("n_new", F.lit(0).cast("long")).withColumn("rewritten", F.lit(False))
    out = kept.unionByName(made)
    _clean(spark, folder, {r.path for r in out.select("path").collect()})
    return out


def _clean(spark, folder: str, keep: set[str]) -> None:
    """Delete the data files of a folder that are not named."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return
    names = {x.removeprefix(folder).lstrip("/") for x in keep}
    found, base = fs.listFiles(top, True), fs.makeQualified(top).toString().rstrip("/")
    gone = []
    while found.hasNext():
        at = found.next().getPath()
        if at.toString().removeprefix(base).lstrip("/") not in names:
            gone.append(at)
    for at in gone:
        fs.delete(at, False)


def rows_limit(rows: DataFrame) -> int:
    """Rows of a part: a five-hundredth of all rows and one more."""
    return 1 + rows.count() // 500

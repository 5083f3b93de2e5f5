"""Token ids in binary files of independent zstandard frames.

A file is frame after frame, then a seek table: for each document its id and
id count, for each frame its place, compressed size, raw size and crc32 of the
raw bytes, then a footer of fixed size. Every frame is decompressed on its
own, so a reader fetches the footer, the table and the frames it needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import text as T
from .tokens import Encoder

MAGIC = b"QTOK0001"
#: Raw bytes of a frame, unless a single document has more.
FRAME_BYTES = 1 << 20
LEVEL = 3
#: frames, documents, bytes of the table, crc32 of the table, magic.
FOOTER = struct.Struct("<QQQI8s")
FRAMES = np.dtype([("at", "<u8"), ("size", "<u8"), ("raw", "<u8"), ("crc", "<u4")])
DOCS = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8"), ("frame", "<u4"), ("begin", "<u8")])
END_ID = 2


class BadFile(ValueError):
    """A file whose table or frames do not match their checksums."""


def filesystem(uri: str):
    """The pyarrow file system of a folder, local or remote, and the path within."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """add(doc_id, ids) in order, then close(). Holds one frame, and the table."""

    def __init__(self, out):
        import zstandard

        self.out, self.at, self.frames, self.docs, self.open, self.bytes = out, 0, [], [], [], 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.open and self.bytes + 4 * len(ids) > FRAME_BYTES:
            self._flush()
        self.docs.append((doc_id or 0, doc_id is None, len(ids), len(self.frames), self.bytes // 4))
        self.open.append(ids.astype("<u4").tobytes())
        self.bytes += 4 * len(ids)

    def _flush(self) -> None:
        raw = b"".join(self.open)
        packed = self.zstd.compress(raw)
        self.frames.append((self.at, len(packed), len(raw), zlib.crc32(raw)))
        self.out.write(packed)
        self.at, self.open, self.bytes = self.at + len(packed), [], 0

    def close(self) -> None:
        if self.open:
            self._flush()
        table = np.array(self.frames, FRAMES).tobytes() + np.array(self.docs, DOCS).tobytes()
        self.out.write(table)
        self.out.write(FOOTER.pack(len(self.frames), len(self.docs), len(table), zlib.crc32(table), MAGIC))
        self.out.close()


class FileReader:
    """docs: the table of documents in file order; ids(i): those of document i; all(): each in turn. Reads only the frames asked for."""

    def __init__(self, source):
        import zstandard

        self.zstd, self.source = zstandard.ZstdDecompressor(), source
        size = source.size()
        if size < FOOTER.size:
            raise BadFile("no footer")
        n_frames, n_docs, n, crc, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise BadFile("no token file")
        table = source.read_at(n, size - FOOTER.size - n)
        if zlib.crc32(table) != crc or len(table) != n_frames * FRAMES.itemsize + n_docs * DOCS.itemsize:
            raise BadFile("the seek table is damaged")
        self.frames = np.frombuffer(table[: n_frames * FRAMES.itemsize], FRAMES)
        self.docs = np.frombuffer(table[n_frames * FRAMES.itemsize :], DOCS)
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def frame(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            f = self.frames[k]
            raw = self.zstd.decompress(self.source.read_at(int(f["size"]), int(f["at"])), max_output_size=int(f["raw"]))
            if zlib.crc32(raw) != f["crc"]:
                raise BadFile(f"frame {k} is damaged")
            self.held = (k, np.frombuffer(raw, "<u4"))
        return self.held[1]

    def ids(self, i: int) -> np.ndarray:
        d = self.docs[i]
        return self.frame(int(d["frame"]))[int(d["begin"]) : int(d["begin"] + d["n"])]

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.docs)):
            yield None if self.docs[i]["null"] else int(self.docs[i]["id"]), self.ids(i)


def write_files(docs: DataFrame, folder: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents and write them, ascending by id, to files in the folder: rows (file, part, n_docs, n_ids).

    Null texts are empty documents of the end id alone. Null ids come first;
    rows that share an id follow one another by their texts, and are dealt over
    files by the first 256 characters of these. A very long text fills frames of
    its own. An empty table gives no files. Each task writes under a name of its attempt and the rows
    returned name the files that count, so a task that ran twice does no harm.
    """
    C.ship(docs.sparkSession)
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = base.repartitionByRange(F.col("doc_id"), F.substring("text", 1, 256)).sortWithinPartitions("doc_id", "text")

    def write(batches):
        import uuid

        from pyspark import TaskContext

        part, fs, path, writer, n_docs, n_ids = TaskContext.get().partitionId(), None, None, None, 0, 0
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            for rows in T.steps(batch, "text"):
                data, offsets = T.buffer_of(rows.column(1))
                ids, at = encoder.encode(data, offsets)
                if writer is None:
                    fs, inner = filesystem(folder)
                    fs.create_dir(inner, recursive=True)
                    path = f"part-{part:06d}-{uuid.uuid4().hex}.qtok"
                    writer = FileWriter(fs.open_output_stream(f"{inner}/{path}"))
                for i, doc_id in enumerate(rows.column(0).to_pylist()):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(END_ID))
                    writer.add(doc_id, own)
                    n_docs, n_ids = n_docs + 1, n_ids + len(own)
        if writer is not None:
            writer.close()
            row = {"file": pa.array([f"{folder}/{path}"]), "part": pa.array([part], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())}
            yield pa.RecordBatch.from_pydict(row)

    return C.materialize(ordered.mapInArrow(write, "file string, part int, n_docs long, n_ids long"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """All documents of the files: doc_id, within (ids before it in its file), n_tokens, ids (binary, little-endian 32 bits), file, part."""
    columns = "doc_id long, within long, n_tokens long, ids binary, file string, part int"

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, inner = filesystem(row["file"])
                with fs.open_input_file(inner) as source:
                    held, size, within = [], 0, 0
                    for doc_id, ids in FileReader(source).all():
                        held.append((doc_id, within, len(ids), ids.tobytes(), row["file"], row["part"]))
                        size, within = size + 4 * len(ids), within + len(ids)
                        if size > FRAME_BYTES:
                            yield _rows(held)
                            held, size = [], 0
                    if held:
                        yield _rows(held)

    # As many tasks as files: a number given here is kept, however few bytes the names of the files have.
    spread = files.select("file", "part").repartition(max(files.count(), 1))
    return spread.mapInArrow(read, columns)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int32())
    names = ("doc_id", "within", "n_tokens", "ids", "file", "part")
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def read_documents(file: str, wanted: set[int]) -> dict[int, np.ndarray]:
    """Ids of some documents of one file; other frames are not touched."""
    fs, inner = filesystem(file)
    with fs.open_input_file(inner) as source:
        reader = FileReader(source)
        return {int(d["id"]): reader.ids(i) for i, d in enumerate(reader.docs) if not d["null"] and int(d["id"]) in wanted}


def positions(read: DataFrame, files: DataFrame) -> DataFrame:
    """Add start, the ids of all documents before each. The running sum is over files, one row each: no more than the ranges they were written from, so they are broadcast."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select(F.col("file").alias("_file"), F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("_before"))
    return read.join(F.broadcast(offsets), read["file"] == offsets["_file"]).withColumn("start", F.col("_before") + F.col("within")).drop("_before", "_file")

"""Image files to rasters and back to documents.

Spark's image source decodes PNG, JPEG, GIF and BMP in the JVM; EXIF
orientation, which it leaves out, is read from the file's bytes. Rasters are
scaled with numpy in Arrow batches and stored without loss; a JPEG encoder is
not at hand, so the quality setting of the desktop tool has no counterpart.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.ordinals import steady
from quire.workers import ship

LONG_EDGE = 1600


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: path, width, height, channels, data (rows of BGR or gray bytes); width null where a file cannot be decoded."""
    df = spark.read.format("image").option("dropInvalid", "false").load(path)
    good = F.col("image.width") > 0
    fields = {"width": "width", "height": "height", "channels": "nChannels", "data": "data"}
    return df.select(F.col("image.origin").alias("path"), *[F.when(good, F.col(f"image.{b}")).alias(a) for a, b in fields.items()])


def orientation(content: bytes | None) -> int | None:
    """EXIF orientation of a JPEG file; null if it has none."""
    if not content or content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if marker == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            tiff = content[at + 10 : at + 2 + size]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            if order is None or len(tiff) < 10:
                return None
            (begin,) = struct.unpack(order + "I", tiff[4:8])
            if begin + 2 > len(tiff):
                return None
            (n,) = struct.unpack(order + "H", tiff[begin : begin + 2])
            for i in range(n):
                entry = tiff[begin + 2 + 12 * i : begin + 14 + 12 * i]
                if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
                    return struct.unpack(order + "H", entry[8:10])[0]
            return None
        if marker == 0xDA:
            return None
        at += 2 + size
    return None


def with_orientation(files: DataFrame) -> DataFrame:
    """Add orientation to files with content."""
    ship(files.sparkSession)

    def read(batches):
        for batch in batches:
            found = [orientation(x) for x in batch.column(batch.schema.get_field_index("content")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "orientation"])

    return files.mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", orientation int")


def upright(pixels: np.ndarray, how: int | None) -> np.ndarray:
    """Pixels after an EXIF orientation of 2 to 8; any other changes nothing."""
    turns = {3: 2, 4: 2, 5: 3, 6: 3, 7: 1, 8: 1}.get(how, 0)
    out = np.rot90(pixels, turns)
    return out[:, ::-1] if how in (2, 4, 5, 7) else out


def downscaled(pixels: np.ndarray, edge: int = LONG_EDGE) -> np.ndarray:
    """Pixels under a long edge, each the mean of those it covers; never enlarged."""
    h, w = pixels.shape[:2]
    scale = min(1.0, edge / max(w, h))
    if scale == 1.0:
        return pixels
    size = [max(1, int(np.round(x * scale))) for x in (h, w)]
    out = pixels.astype(np.float64)
    for axis, n in enumerate(size):
        cuts = np.linspace(0, out.shape[axis], n + 1)
        total = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        low = np.floor(cuts).astype(int)
        high = np.minimum(low + 1, out.shape[axis])
        part = (cuts - low).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        at = np.take(total, low, axis) * (1 - part) + np.take(total, high, axis) * part
        width = np.diff(cuts).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        out = np.diff(at, axis=axis) / width
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def pdf_document(pages: list[tuple[int, int, bytes]]) -> bytes:
    """A PDF of RGB rasters (width, height, bytes), one a page, a point a pixel."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 3 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)]
    for i, (w, h, rgb) in enumerate(pages):
        page, draw = 3 + 3 * i, b"q %d 0 0 %d 0 0 cm /I Do Q" % (w, h)
        data = zlib.compress(rgb)
        objects += [
            b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /XObject << /I %d 0 R >> >> /Contents %d 0 R >>" % (w, h, page + 2, page + 1),
            b"<< /Length %d >>\nstream\n" % len(draw) + draw + b"\nendstream",
            b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n" % (w, h, len(data)) + data + b"\nendstream",
        ]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))


def pdf_pages(content: bytes) -> list[tuple[int, int]]:
    """Page sizes of a document written by pdf_document."""
    import re

    return [(int(w), int(h)) for w, h in re.findall(rb"/Type /Page /Parent 2 0 R /MediaBox \[0 0 (\d+) (\d+)\]", content)]


def combined(images: DataFrame, document: str, order: str, edge: int = LONG_EDGE) -> DataFrame:
    """Images to one PDF for each document: document, n_pages, content. Undecodable images are left out; report them with files.report.

    Rasters are scaled before the shuffle, in Arrow batches; what a document
    gathers is its own pages.
    """
    ship(images.sparkSession)
    has_turn = "orientation" in images.columns
    base = images.where("width is not null").select(document, order, "width", "height", "channels", "data", *(["orientation"] if has_turn else []))

    def scale(batches):
        for batch in batches:
            rows = batch.to_pylist()
            sizes, datas = [], []
            for r in rows:
                pixels = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                pixels = np.repeat(pixels, 3, axis=2) if r["channels"] == 1 else pixels[:, :, 2::-1]
                pixels = downscaled(upright(pixels, r.get("orientation")), edge)
                sizes.append(pixels.shape[:2])
                datas.append(np.ascontiguousarray(pixels).tobytes())
            h, w = zip(*sizes, strict=True) if sizes else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(datas, pa.binary())], ["document", "ord", "w", "h", "rgb"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    scaled = base.mapInArrow(scale, f"document {kinds[document]}, ord {kinds[order]}, w int, h int, rgb binary")
    made = scaled.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("ord", "w", "h", "rgb"))).alias("pages"))

    def write(batches):
        for batch in batches:
            docs, n, out = [], [], []
            for r in batch.to_pylist():
                docs.append(r["document"])
                n.append(len(r["pages"]))
                out.append(pdf_document([(p["w"], p["h"], p["rgb"]) for p in r["pages"]]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(n, pa.int32()), pa.array(out, pa.binary())], ["document", "n_pages", "content"])

    return made.mapInArrow(write, f"document {kinds[document]}, n_pages int, content binary")


def write_documents(documents: DataFrame, folder: str, name: str) -> DataFrame:
    """Write content to a file for each row, by the name column: rows (file, length), once all are there.

    Each attempt of a task writes under names of its own; the rows of those that
    succeeded are written down, and their files then get their last names, by a
    rename each. So a task that fails leaves nothing under a last name, one that
    runs twice does no harm, and a failing write ends with an error and no files.
    Names should be distinct; of rows with one name the last to be renamed stays.
    """
    spark = documents.sparkSession
    staging = f"{folder.rstrip('/')}/.writing-{uuid.uuid4().hex}"

    def write(batches):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(staging)
        store.create_dir(inner, recursive=True)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                part = uuid.uuid4().hex
                with store.open_output_stream(f"{inner}/{part}") as out:
                    out.write(r["content"])
                rows.append((part, r["name"], len(r["content"])))
            parts, names, sizes = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["part", "name", "length"])

    def rename(batches):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(staging)
        last = inner.rpartition("/")[0]
        for batch in batches:
            for r in batch.to_pylist():
                # A task that runs twice finds its file moved already.
                if store.get_file_info(f"{inner}/{r['part']}").type == fs.FileType.File:
                    store.move(f"{inner}/{r['part']}", f"{last}/{r['name']}")
            files = [f"{folder.rstrip('/')}/{x}" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), batch.column(2)], ["file", "length"])

    top = spark._jvm.org.apache.hadoop.fs.Path(staging)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        written = steady(documents.select(F.col(name).alias("name"), "content").mapInArrow(write, "part string, name string, length long"))
        return steady(written.mapInArrow(rename, "file string, length long"))
    finally:
        store.delete(top, True)

"""Files as batches: scanning, kinds, the library, routing, splitting off what cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import naming as N


def scan(spark: SparkSession, path: str, glob: str | None = None, content: bool = True) -> DataFrame:
    """Files under a folder: path, name, ext, mtime, length, content. Without content, Spark does not read the files. Spark lists no empty files: to report them, join what was chosen to what was found."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    columns = [F.col("path"), N.base_name(F.col("path")).alias("name"), N.raw_extension(F.col("path")).alias("ext"), F.col("modificationTime").alias("mtime"), "length"]
    return files.select(*columns, *(["content"] if content else []))


def watch(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A stream of files that arrive under a folder."""
    kind = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    reader = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", N.base_name(F.col("path")).alias("name"), N.raw_extension(F.col("path")).alias("ext"), F.col("modificationTime").alias("mtime"), "length", "content")


def from_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Paths given one by one, in their order."""
    rows = [(i, p) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "file_ord int, path string")
    return df.select("file_ord", "path", N.base_name(F.col("path")).alias("name"), N.raw_extension(F.col("path")).alias("ext"))


def existing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    return wanted.join(files.select("path"), "path", "left_semi")


def is_image(path: Column, extensions: tuple[str, ...] = N.IMAGE_EXTENSIONS) -> Column:
    return N.extension(path).isin(*extensions)


def is_pdf(path: Column) -> Column:
    return N.extension(path) == "pdf"


def content_kind(content: Column) -> Column:
    """Kind of a file by its first bytes; null if they are of no known kind."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("47494638"), "gif")
        .when(head.startswith("424D"), "bmp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").when(head.startswith("25504446"), "pdf")
    )


def accepted(files: DataFrame) -> DataFrame:
    """What a drop takes: PDFs and images."""
    return files.where(is_pdf(F.col("path")) | is_image(F.col("path")))


def library(files: DataFrame) -> DataFrame:
    """Saved signatures, newest first by rank; the extension is matched as it is written, and a missing time is the oldest."""
    from quire.operators.ordinals import global_ordinal

    return global_ordinal(files.where(F.col("ext") == "png"), "rank", F.col("mtime").desc_nulls_last(), F.col("path").asc())


def route(files: DataFrame, batch: str, pdf: Column, image: Column) -> DataFrame:
    """Where each batch goes: one PDF alone is signed; any PDF, organized; images alone, combined; else home."""
    counted = files.groupBy(batch).agg(F.count_if(pdf).alias("pdfs"), F.count_if(image).alias("images"))
    return counted.withColumn("route", route_of(F.col("pdfs"), F.col("images")))


def route_of(pdfs: Column, images: Column) -> Column:
    return F.when((pdfs == 1) & (images == 0), "sign").when(pdfs > 0, "organize").when(images > 0, "combine").otherwise("home")


def report(results: DataFrame, batch: list[str], ok: Column, name: str, order: str) -> DataFrame:
    """Of each batch, how many files were read and which were skipped, in input order."""
    skipped = F.sort_array(F.collect_list(F.when(~ok, F.struct(order, name))))
    joined = F.array_join(F.transform(skipped, lambda x: x[name].cast("string")), ", ")
    return results.groupBy(*batch).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_skipped"), joined.alias("skipped"))


def pages_of_files(files: DataFrame, order: list[str], pages: Column) -> DataFrame:
    """Pages of files in file order: all of a document's, one of an image, none of a file that cannot be read, which is dropped without a word.

    pages: an array, null where a file cannot be read. Adds page_ord, the place in the file, and page.
    """
    kept = [c for c in files.columns if c in order]
    return files.select(*kept, F.posexplode(pages).alias("page_ord", "page"))


def n_pages(content: Column) -> Column:
    """Pages of a file by its content: of a PDF its page objects, 1 of an image of any known kind, null of what cannot be read.

    Page objects are counted in the file as it is, so a PDF that packs its objects
    into compressed streams shows none and counts as unreadable; Spark does not
    parse PDFs. Null and empty contents are unreadable.
    """
    kind = content_kind(content)
    pages = F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page(?![A-Za-z])"))
    return F.when(kind == "pdf", F.when(pages > 0, pages)).when(kind.isNotNull(), F.lit(1))


def loaded(files: DataFrame, order: list[str], content: str = "content") -> DataFrame:
    """Pages of files in file order, by what the files hold: order, page_ord and kind; files that cannot be read are dropped without a word."""
    found = files.withColumn("_kind", content_kind(F.col(content))).withColumn("_n", n_pages(F.col(content))).where("_n is not null")
    return found.select(*order, F.col("_kind").alias("kind"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("page_ord"))


def opened(files: DataFrame, content: str = "content") -> DataFrame:
    """A single document to be opened: pages, null where it is no PDF that can be read, and the message that is shown then."""
    pages = F.when(content_kind(F.col(content)) == "pdf", n_pages(F.col(content)))
    return files.withColumn("pages", pages).withColumn("message", F.when(pages.isNull(), "This document could not be opened."))


def guarded(batches: DataFrame, files: DataFrame, batch: str) -> DataFrame:
    """Each batch with the number of its files and a status: ok, or empty where there is nothing to work on. Files are counted before the join."""
    counted = files.groupBy(batch).agg(F.count("*").alias("n_files"))
    out = batches.join(counted, batch, "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n_files") > 0, "ok").otherwise("empty"))


def quarantined(results: DataFrame, ok: Column, order: str) -> DataFrame:
    """Each file with its status, ok or skipped, and its place in the list of those, from 0: a row for each file, so no list is gathered however many are skipped."""
    from quire.operators.ordinals import global_ordinal

    marked = results.withColumn("status", F.when(ok, "ok").otherwise("skipped"))
    numbered = global_ordinal(marked, "_at", "status", order)
    begins = numbered.groupBy("status").agg(F.min("_at").alias("_from"))  # two rows
    return numbered.join(F.broadcast(begins), "status").withColumn("place", F.col("_at") - F.col("_from")).drop("_at", "_from")


def pages_of_text(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of a text as pages of a document: key, page_ord, page."""
    return documents.select(key, F.posexplode(F.split(text, "\n", -1)).alias("page_ord", "page"))

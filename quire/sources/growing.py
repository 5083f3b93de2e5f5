"""Tables that change: appended to in batches, rewritten as a new generation, read as of the last whole batch.

A generation is a folder of batches. A batch counts once Spark has marked it as
written, and the latest generation that has one is the table, so a job that
fails leaves no trace. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.ordinals import global_ordinal


class GrowingTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _batches(self) -> dict[int, list[str]]:
        """Whole batches by generation."""
        found: dict[int, list[str]] = {}
        for done in self._fs.globStatus(self._path(f"{self.folder}/gen=*/batch=*/_SUCCESS")) or ():
            batch = done.getPath().getParent()
            found.setdefault(int(batch.getParent().getName()[4:]), []).append(batch.toString())
        return found

    def _write(self, rows: DataFrame, generation: int) -> DataFrame:
        to = f"{self.folder}/gen={generation}/batch={uuid.uuid4().hex}"
        rows.select(*self.read().columns).write.parquet(to)
        return self.spark.read.schema(self.schema).parquet(to)

    def read(self) -> DataFrame:
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*batches[max(batches)])

    def append(self, rows: DataFrame) -> DataFrame:
        """Add rows and return them as written."""
        return self._write(rows, max(self._batches(), default=0))

    def replace(self, rows: DataFrame) -> DataFrame:
        """Make rows, which may come from the table itself, all that it has; earlier generations go once they are written."""
        old = list(self._batches())
        out = self._write(rows, max(old, default=-1) + 1)
        for generation in old:
            self._fs.delete(self._path(f"{self.folder}/gen={generation}"), True)
        return out


class Library:
    """Saved signatures: entries under random keys, and the keys of those that were deleted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.entries = GrowingTable(spark, f"{folder}/entries", "key string, saved_at timestamp, content binary")
        self.deleted = GrowingTable(spark, f"{folder}/deleted", "key string")

    def save(self, images: DataFrame) -> DataFrame:
        """Keep the content of each row under a new key; null content is not kept. Returns the entries. saved_at: a column of images, else now."""
        at = F.col("saved_at") if "saved_at" in images.columns else F.current_timestamp()
        return self.entries.append(images.where("content is not null").select(F.expr("uuid()").alias("key"), at.alias("saved_at"), "content"))

    def delete(self, keys: DataFrame) -> None:
        """Delete the entries of some keys; a key that is not there changes nothing."""
        self.deleted.append(keys.select("key").where("key is not null").distinct())

    def list(self) -> DataFrame:
        """Entries that are left with rank, from 0, newest first; a missing time is the oldest, ties by key."""
        left = self.entries.read().join(self.deleted.read(), "key", "left_anti")
        return global_ordinal(left, "rank", F.col("saved_at").desc_nulls_last(), F.col("key").asc())

    def compact(self) -> None:
        """Drop deleted entries from the files. If this stops half-way, deleted keys are still known."""
        self.entries.replace(self.entries.read().join(self.deleted.read(), "key", "left_anti"))
        self.deleted.replace(self.deleted.read().limit(0))


class Thumbnails:
    """Pictures of pages by identity and rotation, made once. A page that is turned has another picture."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = GrowingTable(spark, folder, "page_uid string, rotation int, thumbnail binary")

    def of(self, pages: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Add thumbnail to pages (page_uid, rotation). make gets the pages without one, one row each, and adds it; a null is not kept."""
        known = self.table.read()
        new = pages.dropDuplicates(["page_uid", "rotation"]).join(known, ["page_uid", "rotation"], "left_anti")
        self.table.append(make(new).where("thumbnail is not null"))
        return pages.join(self.table.read(), ["page_uid", "rotation"], "left")

    def evict(self, pages: DataFrame) -> None:
        """Keep the pictures of these pages as they are turned now, and no others."""
        self.table.replace(self.table.read().join(pages.select("page_uid", "rotation"), ["page_uid", "rotation"], "left_semi"))

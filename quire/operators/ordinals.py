"""Ordinals over whole tables without a single task that sees all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def steady(df: DataFrame) -> DataFrame:
    """Write a step to the folder that spark.checkpoint.dir names and read it from there: both of its uses see the same rows, also after an executor is lost."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or f"file://{tempfile.mkdtemp(prefix='quire-steps-')}")
    return df.checkpoint()


def at_place(numbered: DataFrame, ordinal: str, wanted: DataFrame, place: str) -> DataFrame:
    """What stands at the places that are asked for; a place beyond the end gives nothing."""
    return wanted.join(numbered, wanted[place] == numbered[ordinal]).drop(place)


def global_ordinal(df: DataFrame, name: str, *order) -> DataFrame:
    """Number all rows from 0 by an order, which should be total.

    Rows are sorted by range; a row's number is its place in its part plus the
    rows of the parts before, of which one count each is summed.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_q_id", F.monotonically_increasing_id())
    ranged = steady(ranged)
    part = F.shiftright("_q_id", 33)
    before = Window.orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part.alias("_q_part")).agg(F.count("*").alias("_q_n")).select("_q_part", F.coalesce(F.sum("_q_n").over(before), F.lit(0)).alias("_q_start"))
    joined = ranged.join(F.broadcast(starts), part == F.col("_q_part"))  # one row for each part
    return joined.withColumn(name, F.col("_q_start") + F.col("_q_id").bitwiseAND((1 << 33) - 1)).drop("_q_id", "_q_part", "_q_start")


def carry(df: DataFrame, key: str, order: list[Column], value: str, name: str, after: str | None = None) -> DataFrame:
    """Add the last value that is not null of a key's rows up to each row, in an order, and as after the first one that follows.

    Rows are sorted by range, so a key of very many rows lies in several parts.
    Within a part a window carries the value; across parts it is carried over one
    row for each key and part.
    """
    ranged = steady(df.repartitionByRange(F.col(key).asc(), *order).sortWithinPartitions(F.col(key).asc(), *order).withColumn("_q_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_q_part", F.shiftright("_q_id", 33))
    held = F.when(F.col(value).isNotNull(), F.col("_q_id"))
    parts = ranged.groupBy(F.col(key).alias("_q_key"), F.col("_q_part").alias("_q_of")).agg(F.max_by(value, held).alias("_q_last"), F.min_by(value, held).alias("_q_first"))
    over = Window.partitionBy("_q_key").orderBy("_q_of")
    parts = parts.select(
        "_q_key", "_q_of", F.last("_q_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_q_before"),
        F.first("_q_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_q_after"),
    )
    inside = Window.partitionBy(key, "_q_part").orderBy("_q_id")
    seen = ranged.withColumn("_q_seen", F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    if after:
        # What follows, found going backwards: windows that only grow take one step a row.
        backwards = Window.partitionBy(key, "_q_part").orderBy(F.col("_q_id").desc())
        seen = seen.withColumn("_q_next", F.last(value, ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1)))
    joined = seen.join(parts, F.col(key).eqNullSafe(F.col("_q_key")) & (F.col("_q_part") == F.col("_q_of")), "left").withColumn(name, F.coalesce("_q_seen", "_q_before"))
    if after:
        joined = joined.withColumn(after, F.coalesce("_q_next", "_q_after")).drop("_q_next")
    return joined.drop("_q_id", "_q_part", "_q_key", "_q_of", "_q_seen", "_q_before", "_q_after")


def local_ordinal(df: DataFrame, name: str, keys: list[str], *order) -> DataFrame:
    """Number the rows of each key from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))

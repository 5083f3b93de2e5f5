"""What the operators share: tables, the shared folder, materialised steps, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest side, in bytes of text, that an operator broadcasts; larger ones go in blocks or by a shuffle.
BROADCAST_BYTES = 4 << 20

#: A key with more than this share of all rows is heavy, so there are at most so many heavy keys.
PARTS = 2000
#: Sub-groups into which the rows of a heavy key are dealt.
SALTS = 64

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quire-shared-')}"
        sc.setCheckpointDir(at)
    if ":/" not in at:  # as Spark understands it, so that others read the same folder
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return (f"file://{at[5:]}" if at.startswith("file:/") and not at.startswith("file://") else at).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a shared folder that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: later steps survive lost executors, and it is computed once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialised step that no later step reads."""
    if path := getattr(df, "_quire_path", None):
        drop_path(df.sparkSession, path)


def running(df: DataFrame, name: str, value: Column, *order) -> DataFrame:
    """Add the sum of a whole number over all rows before, by an order that should be total.

    Rows are sorted by range and summed within chunks of 4,096 rows; chunks are
    summed within their part, and parts, of which there are as many as the sort
    had tasks, in one small window. No task takes more than its part.
    """
    ranged = df.withColumn("_q_value", value.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_q_id", F.monotonically_increasing_id()), "ordered").withColumn("_q_chunk", F.shiftright("_q_id", 12))
    chunks = ranged.groupBy("_q_chunk").agg(F.sum("_q_value").alias("_q_sum")).withColumn("_q_part", F.shiftright("_q_chunk", 21))
    before = lambda w: F.coalesce(F.sum("_q_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = chunks.groupBy("_q_part").agg(F.sum("_q_sum").alias("_q_sum")).select("_q_part", before(Window.orderBy("_q_part")).alias("_q_far"))
    starts = chunks.withColumn("_q_near", before(Window.partitionBy("_q_part").orderBy("_q_chunk"))).join(parts, "_q_part")
    starts = starts.select("_q_chunk", (F.col("_q_near") + F.col("_q_far")).alias("_q_start"))
    inside = F.coalesce(F.sum("_q_value").over(Window.partitionBy("_q_chunk").orderBy("_q_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_q_inside", inside).join(starts, "_q_chunk").withColumn(name, F.col("_q_start") + F.col("_q_inside")).drop("_q_chunk", "_q_id", "_q_value", "_q_inside", "_q_start")


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Number all rows from 0 by an order that should be total: the place in a part of the sort plus the rows of the parts before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_q_id", F.monotonically_increasing_id())
    ranged = materialize(ranged, "numbered")
    part = F.shiftright("_q_id", 33)
    before = Window.orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part.alias("_q_part")).agg(F.count("*").alias("_q_n")).select("_q_part", F.coalesce(F.sum("_q_n").over(before), F.lit(0)).alias("_q_start"))
    joined = ranged.join(F.broadcast(starts), part == F.col("_q_part"))  # one row for each part
    return joined.withColumn(name, F.col("_q_start") + F.col("_q_id").bitwiseAND((1 << 33) - 1)).drop("_q_id", "_q_part", "_q_start")


def heavy_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Keys with more than total / PARTS of total rows: by their number alone never more than PARTS, whatever the data."""
    return counts.where(F.col(n) * PARTS > total).select(F.col(key).alias("_heavy"))


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, heavy: DataFrame, spread: list[str], how: str = "inner", also: tuple[str, str] | None = None) -> DataFrame:
    """Join of many rows on the left with one row for each key on the right; a heavy key's rows are dealt over SALTS tasks by the columns of spread.

    heavy comes from heavy_keys, so broadcasting it is bounded. also: a second
    pair of columns to be equal. Null keys join with nothing.
    """
    known = F.broadcast(heavy)
    salt = F.when(F.col("_heavy").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    many = left.join(known, left[left_key] == known["_heavy"], "left").withColumn("_salt", salt).drop("_heavy")
    each = F.when(F.col("_heavy").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    one = right.join(known, right[right_key] == known["_heavy"], "left").withColumn("_at", F.explode(each)).drop("_heavy")
    same = (many[left_key] == one[right_key]) & (many["_salt"] == one["_at"])
    return many.join(one, same & (many[also[0]] == one[also[1]]) if also else same, how).drop("_salt", "_at")


#: Bits of a mask of hashes that is broadcast (4 MB), a power of two.
MASK_BITS = 1 << 25


def masked(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows that may have a wanted key: those whose hash falls into one of MASK_BITS slots that a wanted key's hash has.

    What is broadcast is one bit for each slot, however many keys are wanted.
    Some rows pass that have no wanted key, so a join follows.
    """
    slot = lambda c: F.xxhash64(c).bitwiseAND(MASK_BITS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot(wanted_key).bitwiseAND(63).cast("int"))
    masks = wanted.groupBy(F.shiftright(slot(wanted_key), 6).alias("_q_word")).agg(F.bit_or(bit).alias("_q_mask"))
    met = rows.withColumn("_q_slot", slot(key)).join(F.broadcast(masks), F.shiftright("_q_slot", 6) == F.col("_q_word"))
    return met.where(F.expr("shiftrightunsigned(_q_mask, cast(_q_slot & 63 as int)) & 1") == 1).drop("_q_slot", "_q_word", "_q_mask")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII texts take the built-in fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


#: What separates words of ASCII letters, digits and all characters beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White space between words.
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column, separators: str) -> Column:
    """Array of words; null has none."""
    return F.coalesce(F.array_remove(F.split(text, separators, -1), ""), F.array().cast("array<string>"))


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns one after the other as real attributes: the optimizer cannot copy their expressions into the lambdas that use them."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def grams(hashed: Column, n: int, of: Column | None = None) -> Column:
    """Hash of each run of n elements of an array column; no run, an empty array. The column must be an attribute, not an expression."""
    size = F.size(hashed) if of is None else of
    runs = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(n)]))
    return F.when(size >= n, runs).otherwise(F.array().cast("array<bigint>"))


def gram_at(array: Column, p: Column, n: int) -> Column:
    """Hash of the n elements from p on; null where fewer are left. In whole-stage code, unlike grams()."""
    return F.when((p >= 0) & (p + n <= F.size(array)), F.xxhash64(*[F.get(array, p + j) for j in range(n)]))


_shipped: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application: they may not have it installed."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if _shipped.setdefault(sc.applicationId, False):
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="quire-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(to))
    _shipped[sc.applicationId] = True

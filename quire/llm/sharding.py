"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each, rows are sorted
by their cell's place on a Hilbert curve through the grid, and the sorted rows
are cut into runs. Neighbours on the curve are neighbours in every dimension,
so a reader that filters on any of them opens few shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS = 40
BITS = 4
#: Rows of one file of a shard, unless the shard has fewer.
FILE_ROWS = 100_000


def hilbert_index(cell: list[int], bits: int) -> int:
    """Place of a cell on the Hilbert curve through a grid of 2 ** bits a side.

    Skilling's method: going from the highest bit down, exchange or invert the
    lower bits of the axes, then take the Gray code of the bits interleaved.
    """
    x, n = list(cell), len(cell)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(n):
            if x[i] & high:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] >> level & 1:
            carry ^= (1 << level) - 1
    x = [v ^ carry for v in x]
    out = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> level & 1)
    return out


def curve(dimensions: int, bits: int = BITS) -> list[int]:
    """Curve place of every cell, in order of the cells' own numbers; 2 ** (dimensions * bits) entries, 65,536 at most."""
    if dimensions * bits > 16:
        raise ValueError("a grid of more than 65,536 cells: take fewer bits")
    mask = (1 << bits) - 1
    return [hilbert_index([cell >> bits * (dimensions - 1 - d) & mask for d in range(dimensions)], bits) for cell in range(1 << dimensions * bits)]


def code_of_size(size: Column, bits: int = BITS) -> Column:
    """Order-preserving code of a count: its number of binary digits. Null: 0."""
    return F.least(F.length(F.bin(F.coalesce(size, F.lit(0)))), F.lit((1 << bits) - 1)).cast("int")


def code_of_value(value: Column, bits: int = BITS) -> Column:
    """Code of a categorical value, from its md5; equal values share a code. Null: the code of an empty string."""
    digit = F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int")
    return F.shiftright(digit, 16 - bits).cast("int")


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", value_cols: tuple[str, ...] = ("lang", "source"), shards: int = SHARDS, bits: int = BITS, keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """Every row with its shard and slot: doc_id, text (if with_text), the columns named in keep, codes, curve, shard, slot.

    Shards hold equally many rows, one more or less. The curve runs through the
    text's size and each column of value_cols; rows of one cell follow one
    another by id and text. Null text: size 0. Empty table: no rows. Repeated
    rows each have a slot, and which copy has which does not matter. Only ids,
    codes and a hash of the text are sorted, by range, so very long texts weigh
    on no task; the rank of a row is its place in its part plus the rows of the
    parts before, of which there is one count each. The rest of a row is
    attached by a number that each row is given when it is written down.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep], *[F.col(c).alias(f"_value_{i}") for i, c in enumerate(value_cols)])
    codes = [code_of_size(F.octet_length("text"), bits), *[code_of_value(F.col(f"_value_{i}"), bits) for i in range(len(value_cols))]]
    cell = codes[0]
    for c in codes[1:]:
        cell = F.shiftleft(cell, bits).bitwiseOR(c)
    place = F.get(F.array(*map(F.lit, curve(len(codes), bits))), cell)
    cells = base.withColumn("codes", F.array(*codes)).withColumn("curve", place.cast("int")).withColumn("_text", F.xxhash64("text"))
    cells = cells.drop(*[f"_value_{i}" for i in range(len(value_cols))], *[] if with_text else ["text"])
    rows = C.materialize(cells.withColumn("_row", F.monotonically_increasing_id()), "cells")
    keys = rows.select(F.col("_row").alias("_of"), "curve", "doc_id", "_text")
    ordered = keys.repartitionByRange("curve", "doc_id", "_text").sortWithinPartitions("curve", F.col("doc_id").asc_nulls_first(), "_text")
    # The number is the part in the upper bits and the place in the part in the lower 33.
    ordered = C.materialize(ordered.select("_of", F.monotonically_increasing_id().alias("_id")), "hilbert")
    part = F.shiftright("_id", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    total = ordered.count()
    ranked = ordered.join(F.broadcast(starts), part == starts["_part"]).withColumn("_rank", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1))
    # Of total rows, the first total % shards shards hold one more.
    small, large = total // shards, total % shards
    edge = large * (small + 1)
    first = F.col("_rank") < edge
    shard = F.when(first, F.expr(f"_rank div {small + 1}")).otherwise(F.lit(large) + F.expr(f"(_rank - {edge}) div {max(small, 1)}"))
    slot = F.when(first, F.col("_rank") % (small + 1)).otherwise((F.col("_rank") - edge) % max(small, 1))
    placed = ranked.select("_of", shard.cast("int").alias("shard"), slot.cast("int").alias("slot"))
    text = ["text"] if with_text else []
    return rows.join(placed, rows["_row"] == placed["_of"]).select("doc_id", *text, *[F.col(f"_keep_{c}").alias(c) for c in keep], "codes", "curve", "shard", "slot")


def manifest(assigned: DataFrame) -> DataFrame:
    """For each shard the least and greatest code of every dimension: what a reader prunes by."""
    codes = assigned.select("shard", F.posexplode("codes").alias("dimension", "code"))
    return codes.groupBy("shard", "dimension").agg(F.min("code").alias("least"), F.max("code").alias("greatest"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Parquet files by shard, in slot order: several files and tasks for a shard of more than FILE_ROWS rows."""
    run = F.expr(f"slot div {FILE_ROWS}")
    dealt = assigned.repartition(F.col("shard"), run).sortWithinPartitions("shard", "slot")
    dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("shard").parquet(path)

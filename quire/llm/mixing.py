"""Mixing sources to target weights.

The words of each source stand one after the other and are cut into blocks of a
fixed length. The mix is a sequence of shards of equally many slots. How many
slots of a shard go to which source is a multinomial draw; the slots of a source,
numbered over all shards, go through its blocks in a pseudorandom permutation of
their numbers, a new one for each pass; slots and blocks meet by number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Words of a block and slots of a shard.
BLOCK = 32
SHARD_SLOTS = 4096
#: Weights of sources in order, repeating; what the mix takes of all words, in percent; how often it takes a word at most.
WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST = 2
SEED = 20
#: Rounds of the permutation.
ROUNDS = 12
#: Into so many cells the line of all quotas is cut, so that a draw finds its source by an equal key.
CELLS = 1 << 16


@dataclass
class Mix:
    """What mix() gives.

    documents: one row for each row of the input: row (its number here), doc_id, source, size, source_no, source_size, target; text if asked for.
    spans: pieces of blocks: source_no, block, row, first (word in its document), words.
    slots: the mix itself: shard, slot, source_no, block.
    """

    documents: DataFrame
    spans: DataFrame
    slots: DataFrame

    def taken(self) -> DataFrame:
        """Documents with taken, the words that the mix takes of each, repeats counted."""
        met = self.slots.join(self.spans, ["source_no", "block"]).groupBy("row").agg(F.sum("words").alias("taken"))
        return self.documents.join(met, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))

    def texts(self) -> DataFrame:
        """Slots with their words: shard, slot, words (an array). Needs documents with texts; a block is gathered from its pieces in order."""
        piece = F.slice(C.words(F.col("text"), C.BLANKS), (F.col("first") + 1).cast("int"), F.col("words").cast("int"))
        cut = self.spans.join(self.documents.select("row", "text"), "row").select("source_no", "block", "position", piece.alias("piece"))
        blocks = cut.groupBy("source_no", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "piece"))), lambda x: x["piece"])).alias("words"))
        return self.slots.join(blocks, ["source_no", "block"]).select("shard", "slot", "words")


def permuted(df: DataFrame, name: str, x: Column, n: Column, *key: Column) -> DataFrame:
    """Add where a pseudorandom permutation of 0 to n - 1, one for each key, sends x.

    Each round pairs every number with another by a reflection and swaps the two
    or not, as a hash of the larger one says: a permutation whatever the hash.
    Rounds are columns of their own, so all of it is compiled code.
    """
    df = df.withColumns({name: x.cast("long"), "_p_n": n, "_p_key": F.xxhash64(*key)})
    for r in range(ROUNDS):
        df = df.withColumn("_p_other", F.pmod(F.pmod(F.xxhash64("_p_key", F.lit(2 * r)), F.col("_p_n")) - F.col(name), F.col("_p_n")))
        stays = F.xxhash64("_p_key", F.lit(2 * r + 1), F.greatest(F.col(name), F.col("_p_other"))) % 2 == 0
        df = df.withColumn(name, F.when(stays, F.col(name)).otherwise(F.col("_p_other")))
    return df.drop("_p_n", "_p_key", "_p_other")


def targets(sources: DataFrame, percent: int, most: int) -> DataFrame:
    """Add target to sources (size, weight): shares of percent of all sizes by weight, none above most times its size.

    What a source cannot take is shared again by weight among the others until
    none is above. Each round is one row of sums.
    """
    total = (sources.agg(F.sum("size")).first()[0] or 0) * percent / 100
    cap, level, known = F.col("size") * most, 0.0, -1
    rest, weight = total, 0
    while True:
        full = F.lit(level) * F.col("weight") > cap
        n, taken, weight = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        rest = total - taken
        if n == known or not weight:
            break
        known, level = n, rest / weight
    share = F.lit(float(rest)) * F.col("weight") / F.lit(max(weight, 1))
    return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.least(share, cap.cast("double"))))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST,
    block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, with_text: bool = True,
) -> Mix:
    """Mix all documents.

    Sources are numbered by code point, null last, and weigh as the weights say,
    repeating. A source is given its target to the nearest block, and no block
    more than most times, so no document is taken more than most times either.
    Draws beyond what a source is given go to sources that were drawn too rarely.

    Null texts, and texts without words, have size 0 and are taken 0 times; null
    ids are ids like any other; rows that share an id follow one another by their
    texts, repeated rows each have their own words. An empty table, or one without
    words, gives no slots. A text of any length spans as many blocks as it needs.
    Other columns of the input are not looked at. The same rows give the same
    mix, however they are dealt over tasks.
    """
    spark = docs.sparkSession
    text, source = F.col(text_col), F.col(source_col).cast("string")
    key = F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))
    # Pieces between blanks, without the empty ones that a blank at either end makes.
    edges = sum(F.substring(text, at, 1).rlike(C.BLANKS).cast("int") for at in (1, -1))
    size = F.when(F.length(text) > 0, F.size(F.split(text, C.BLANKS, -1)) - edges).otherwise(0).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), key.alias("_key"), source.alias("source"), size.alias("size"), F.xxhash64(text).alias("_text"), *([text.alias("text")] if with_text else []))
    base = C.materialize(base.withColumn("row", F.monotonically_increasing_id()), "sizes")

    sources = base.groupBy("_key").agg(F.sum("size").alias("size"), F.count("*").alias("_docs"), (F.col("_key") == "").alias("_null"))
    sources = C.numbered(sources, "source_no", "_null", "_key")
    sources = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights)).cast("int")))
    sources = targets(C.materialize(C.running(sources, "_before", F.col("size"), "source_no"), "sources"), percent, most)
    whole = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(most))).otherwise(0)
    blocks = F.ceil(F.col("size") / block)
    rest = F.least(F.bround((F.col("target") - whole * F.col("size")) / block), blocks)
    given = F.when(whole >= most, blocks * most).otherwise(blocks * whole + rest).cast("long")
    sources = C.materialize(C.running(sources.withColumn("blocks", blocks).withColumn("quota", given), "_from", F.col("quota"), "source_no"), "quotas")
    rows, total = sources.agg(F.coalesce(F.sum("_docs"), F.lit(0)), F.coalesce(F.sum("quota"), F.lit(0))).first()

    of = sources.select(F.col("_key").alias("_of"), "source_no", F.col("size").alias("source_size"), "target", F.col("_before").alias("_start"))
    documents = C.salted_join(base, of, "_key", "_of", C.heavy_keys(sources, "_key", "_docs", rows), ["row"]).drop("_key", "_of")
    narrow = C.running(documents.select("row", "doc_id", "_text", "size", "source_no", "_start"), "_global", F.col("size"), "source_no", "doc_id", "_text", "row")
    spans = _spans(narrow.withColumn("_first", F.col("_global") - F.col("_start")), block)
    return Mix(documents.drop("_start", "_text"), spans, _slots(spark, sources, total, shard_slots, seed))


def _spans(placed: DataFrame, block: int) -> DataFrame:
    """Pieces of the blocks of each source: where each document's words lie."""
    first, end, at = F.col("_first"), F.col("_first") + F.col("size"), F.col("block") * block
    numbers = F.sequence(F.expr(f"_first div {block}"), F.expr(f"(_first + size - 1) div {block}"))
    pieces = placed.where("size > 0").withColumn("block", F.explode(numbers))
    begin = F.greatest(at, first)
    return pieces.select("source_no", "block", "row", (begin - first).alias("first"), (F.least(at + block, end) - begin).alias("words"), (begin - at).alias("position"))


def _slots(spark, sources: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """Slots (shard, slot, source_no, block): the draws, brought to each source's quota, and the block of each."""
    width = max(1, -(-total // CELLS))
    cells = sources.where("quota > 0").select("source_no", "quota", "blocks", "_from", F.explode(F.expr(f"sequence(_from div {width}, (_from + quota - 1) div {width})")).alias("_cell"))
    # One draw for each slot; a task counts its own before anything is shuffled.
    line = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total >> 20))
    drawn = line.select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(total, 1))).alias("_v"))
    drawn = drawn.withColumn("_cell", F.expr(f"_v div {width}")).join(cells, "_cell").where("_v >= _from and _v < _from + quota")
    counts = C.materialize(drawn.groupBy("shard", "source_no", "quota", "blocks").agg(F.count("*").alias("_n")), "draws")

    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_group", F.expr("shard div 1024"))
    groups = counts.groupBy("source_no", "_group").agg(F.sum("_n").alias("_n"))
    groups = groups.select("source_no", "_group", before(Window.partitionBy("source_no").orderBy("_group")).alias("_far"))
    counts = counts.withColumn("_near", before(Window.partitionBy("source_no", "_group").orderBy("shard"))).join(groups, ["source_no", "_group"])
    counts = counts.withColumn("_at", before(Window.partitionBy("shard").orderBy("source_no"))).withColumn("_first", F.col("_near") + F.col("_far"))
    had = C.materialize(counts.groupBy("source_no").agg(F.sum("_n").alias("_had")), "drawn")
    # What a source has drawn beyond its quota is given back by all its shards alike.
    back = lambda upto: F.floor(upto * F.greatest(F.col("_had") - F.col("quota"), F.lit(0)) / F.col("_had")).cast("long")
    counts = counts.join(had, "source_no").withColumn("_back", back(F.col("_first"))).withColumn("_here", back(F.col("_first") + F.col("_n")) - F.col("_back"))
    counts = C.materialize(counts.select("shard", "source_no", "quota", "blocks", "_n", "_at", (F.col("_first") - F.col("_back")).alias("_first"), (F.col("_n") - F.col("_here")).alias("_stays")), "draws-in-order")

    # Few rows stand for many slots: they are dealt out before they become those.
    counts = counts.repartition(max(spark.sparkContext.defaultParallelism, total >> 18), "shard", "source_no")
    stays = F.col("_stays")
    expand = lambda df, low, high: df.where(high > low).withColumn("_k", F.explode(F.sequence(low, high - 1)))
    kept = expand(counts, F.lit(0).cast("long"), stays).select("shard", (F.col("_at") + F.col("_k")).alias("_place"), "source_no", "blocks", (F.col("_first") + F.col("_k")).alias("_j"))

    # Draws beyond a quota, and what is missing from others: equally many, and few (as the root of all draws). They meet by number.
    over = expand(counts, stays, F.col("_n")).select("shard", (F.col("_at") + F.col("_k")).alias("_place"))
    over = C.numbered(over, "_number", "shard", "_place")
    under = sources.select("source_no", "quota", "blocks").join(had, "source_no", "left").withColumn("_had", F.coalesce("_had", F.lit(0)))
    under = expand(under, F.col("_had"), F.col("quota")).select("source_no", "blocks", F.col("_k").alias("_j"))
    under = C.numbered(under, "_number", "source_no", "_j")
    slots = kept.unionByName(over.join(under, "_number").select("shard", "_place", "source_no", "blocks", "_j"))

    turn = F.expr("_j div blocks")
    slots = permuted(slots, "block", F.col("_j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source_no"), turn)
    # Written here: plans that hold several permutations take the optimizer very long.
    slots = C.materialize(slots.select("shard", "_place", "source_no", "block"), "slots")
    in_shard = F.least(F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots)
    slots = permuted(slots, "slot", F.col("_place"), in_shard, F.lit(seed), F.lit("shard"), F.col("shard"))
    return slots.select("shard", "slot", "source_no", "block")

"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text's fingerprints are the hashes of 7-word grams that are the least of any
7 consecutive ones; whatever 13 words two texts share, they share a
fingerprint within. Fingerprints of documents and items are joined; each hit
is extended word by word, and counts if it reaches 13 words. Items of a bounded
size are broadcast; beyond that, documents' fingerprints that pass a mask of
the items' hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 13
GRAM = 7
#: GRAM + SPAN - 1 = WINDOW: every window holds a whole span of grams, hence its least gram.
SPAN = WINDOW - GRAM + 1
REACH = WINDOW - GRAM
#: Bits of the mask of items' hashes that is broadcast where items are too many: 4 MB, a power of two.
MASK_BITS = 1 << 25


def _tokens(df: DataFrame, text: Column) -> DataFrame:
    """Add _w, the words."""
    return C.let(df, _w=C.words(C.ascii_lower(text), C.NOT_WORD))


def _is_least(p: Column) -> Column:
    """Whether the gram at p is the least of SPAN consecutive ones, all within the text: what winnowing keeps."""
    window = lambda i: F.transform(F.sequence(i, i + SPAN - 1), lambda j: C.gram_at(F.col("_w"), j, GRAM))
    inside = lambda i: (i >= 0) & (i + WINDOW <= F.size("_w"))
    return F.exists(F.sequence(p - SPAN + 1, p), lambda i: inside(i) & (C.gram_at(F.col("_w"), p, GRAM) == F.array_min(window(i))))


def item_fingerprints(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int], int]:
    """Rows (v, need_k, core, before, after, need, owners) of the items, the short lengths among them, and bytes of item text.

    An item of fewer words than a window is one window: all of it is one gram.
    A gram that several items have in the same surroundings is one row with all
    of them as owners; an item without an id is no owner, but its grams count.
    """
    base = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("_text"))
    base = C.materialize(_tokens(base, F.col("_text")).select("item", "_w").where(F.size("_w") > 0), "items")
    # One row: at most 12 lengths and a sum.
    facts = base.agg(F.collect_set(F.when(F.size("_w") < WINDOW, F.size("_w"))).alias("short"), F.sum(F.octet_length(F.array_join("_w", " "))).alias("bytes")).first()
    short = sorted(facts["short"])
    whole = F.size("_w") < WINDOW
    rows = base.select("item", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - 1)).alias("p")).where(F.when(whole, F.col("p") == 0).otherwise(_is_least(F.col("p"))))
    hashes = F.coalesce(*[F.when(F.size("_w") == k, C.gram_at(F.col("_w"), F.col("p"), k)) for k in short], C.gram_at(F.col("_w"), F.col("p"), GRAM))
    rows = rows.select("item", "_w", "p", F.when(whole, F.size("_w")).otherwise(GRAM).alias("k"), hashes.alias("v"))
    part = lambda at, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get("_w", at(j)))
    rows = rows.select(
        "item", "v", F.col("k").alias("need_k"),
        F.slice("_w", F.col("p") + 1, F.col("k")).alias("core"),
        part(lambda j: F.col("p") - j - 1, REACH).alias("before"),
        part(lambda j: F.col("p") + F.col("k") + j, REACH).alias("after"),
        F.least(F.size("_w"), F.lit(WINDOW)).alias("need"),
    )
    rows = rows.groupBy("v", "need_k", "core", "before", "after", "need").agg(F.collect_set("item").alias("owners"))
    return C.materialize(rows, "fingerprints"), short, facts["bytes"] or 0


def _extend(context: Column, at) -> Column:
    """How many elements of context equal the document's words at at(0), at(1), ..., from the first on."""
    differs = F.filter(F.sequence(F.lit(0), F.lit(REACH - 1)), lambda j: F.get(context, j).isNull() | ~F.get("_w", at(j)).eqNullSafe(F.get(context, j)))
    return F.coalesce(F.array_min(differs), F.lit(REACH))


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Contamination of each document row: doc_id, text_key, n_words, n_hit, items (sorted), contaminated.

    Null or empty texts have no words and are clean; very long texts are read
    whole. Repeated rows each get a row; an empty table gives none, and empty
    items leave all documents clean. An item with a null id contaminates like
    others, and is not among items. Items up to a bounded size are broadcast, and
    documents are not shuffled then: only hits and one short row for each
    document are. Of a larger benchmark, a mask of its hashes is broadcast, and
    fingerprints that pass it meet items by a shuffle, with the words around them.
    """
    rows, short, size = item_fingerprints(items, item_col=item_col, text_col=item_text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    base = _tokens(base.withColumn("_key", F.xxhash64("_text")), F.col("_text")).drop("_text")
    found = _hits(base, rows, short) if size <= C.BROADCAST_BYTES else _hits_by_shuffle(base, rows, short)
    judged = found.groupBy("doc_id", "_key").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("begin").isNull(), 1)).alias("_copies"),
        F.collect_set(F.when(F.col("begin").isNotNull(), F.struct("begin", "end"))).alias("_runs"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items"),
    )
    hit = F.size(F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.sequence(r["begin"], r["end"] - 1))))).cast("long")
    judged = judged.withColumn("n_hit", F.when(F.size("_runs") > 0, hit).otherwise(F.lit(0).cast("long")))
    judged = judged.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return judged.select("doc_id", F.col("_key").alias("text_key"), "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _grams(base: DataFrame, short: list[int]) -> DataFrame:
    """Rows (doc_id, _key, n_words, _w, p, k, _v): the gram at each place, of every length that items have; the one past the last word has no hash."""
    fp = base.select("doc_id", "_key", F.size("_w").cast("long").alias("n_words"), "_w", F.explode(F.sequence(F.lit(0), F.size("_w"))).alias("p"))
    if not short:
        return fp.select("doc_id", "_key", "n_words", "_w", "p", F.lit(GRAM).alias("k"), C.gram_at(F.col("_w"), F.col("p"), GRAM).alias("_v"))
    each = F.array(*[F.struct(F.lit(k).alias("k"), C.gram_at(F.col("_w"), F.col("p"), k).alias("v")) for k in dict.fromkeys((GRAM, *short))])
    fp = fp.select("*", F.explode(each).alias("_f"))
    return fp.select("doc_id", "_key", "n_words", "_w", "p", F.col("_f.k").alias("k"), F.col("_f.v").alias("_v"))


def _extended(met: DataFrame, least: Column) -> DataFrame:
    """Of rows that met an item, those whose run of shared words is long enough, as (doc_id, _key, n_words, owners, begin, end). _w begins at word at of the text."""
    here = F.col("p") - F.col("at")
    same = F.slice("_w", here + 1, F.col("k")) == F.col("core")
    before, after = _extend(F.col("before"), lambda j: here - j - 1), _extend(F.col("after"), lambda j: here + F.col("k") + j)
    short_item = F.col("need") < WINDOW
    begin = F.col("p") - F.when(short_item, 0).otherwise(before)
    end = F.col("p") + F.col("k") + F.when(short_item, 0).otherwise(after)
    met = C.let(met, _run=F.when(F.col("need").isNotNull() & same & least, F.struct(begin.alias("begin"), end.alias("end"), F.col("need").alias("need"))))
    long_enough = F.col("_run.end") - F.col("_run.begin") >= F.col("_run.need")
    met = met.where(F.when(F.col("_run").isNull(), F.col("p") == F.col("n_words")).otherwise(long_enough))
    return met.select("doc_id", "_key", "n_words", F.when(F.col("_run").isNotNull(), F.col("owners")).alias("owners"), "_run.begin", "_run.end")


def _hits(base: DataFrame, items: DataFrame, short: list[int]) -> DataFrame:
    """A row without begin for each document, and a row for each run of words that items share."""
    fp = _grams(base, short)
    mark = (F.col("p") == F.col("n_words")) & (F.col("k") == GRAM)  # its hash is null, so it meets no item
    met = fp.join(F.broadcast(items), (F.col("_v") == F.col("v")) & (F.col("k") == F.col("need_k")), "left")
    # First a filter that stays in whole-stage code, so that only rows that met an item are ever copied with their words.
    met = met.where(mark | F.col("need").isNotNull()).withColumn("at", F.lit(0))
    # The winnowing of the document: asked of the grams that met an item, for the same rows at less cost.
    return _extended(met, (F.col("need") < WINDOW) | _is_least(F.col("p")))


def _masks(items: DataFrame) -> DataFrame:
    """Which of MASK_BITS slots the items' hashes fall into: rows (word, mask) of 64 slots each, MASK_BITS / 64 of them at most, however many items there are."""
    slot = _slot(F.col("v"))
    return items.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("mask"))


def _slot(v: Column) -> Column:
    return v.bitwiseAND(MASK_BITS - 1)


def _hits_by_shuffle(base: DataFrame, items: DataFrame, short: list[int]) -> DataFrame:
    """As _hits, for items too large to broadcast: what is broadcast is one bit for each slot that an item's hash falls into.

    Grams whose slot is set, and which are the least of their span, go to the
    shuffle with the words around them, so texts stay where they are. A hash that
    more than one in 2,000 of these grams have is dealt over tasks.
    """
    masks = F.broadcast(_masks(items))  # MASK_BITS bits
    slot = _slot(F.col("_v"))
    met = _grams(base, short).where("_v is not null").join(masks, F.shiftright(slot, 6).cast("int") == F.col("word"))
    # First a filter on the mask alone, so that only grams that pass are copied with their words.
    met = met.where(F.expr("shiftrightunsigned(mask, cast(_v & 63 as int)) & 1") == 1)
    # Where seven is the length of a short item too, grams that are not the least are let through; they only find runs that the least ones find.
    # It is bound, as a filter on the text alone would be pushed below the join and asked of every gram.
    least = F.when(F.col("k").isin(short), True).otherwise(_is_least(F.col("p"))) if short else _is_least(F.col("p"))
    met = C.let(met, _ok=least).where("_ok")
    at = F.greatest(F.col("p") - REACH, F.lit(0))
    near = C.materialize(met.select("doc_id", "_key", "n_words", "p", "k", "_v", at.alias("at"), F.slice("_w", at + 1, F.col("k") + 2 * REACH).alias("_w")), "near-items")
    counts = near.groupBy("_v").agg(F.count("*").alias("n"))
    total = near.count()
    held = C.salted_join(near, items, "_v", "v", C.heavy_keys(counts, "_v", "n", total), ["doc_id", "_key", "p"]).where("k = need_k")
    found = _extended(held, F.lit(True))
    nothing = F.lit(None)
    marks = base.select("doc_id", "_key", F.size("_w").cast("long").alias("n_words"), nothing.cast("array<string>").alias("owners"), nothing.cast("int").alias("begin"), nothing.cast("int").alias("end"))
    return marks.unionByName(found.where("begin is not null"))

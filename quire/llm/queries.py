"""The operators over their whole tables, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import chat, decontaminate, licenses, mixing, neardup, packing, quality, sharding, substrings, timeparts, tokenfile, urls, vectorcodes


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    out = chat.format_records(chat.in_layouts(chat.records(rows.unionByName(more))), id_col="conv_id")
    out = C.let(out, _turns=chat.read_back(F.col("formatted")), _loss=chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    digest = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(C.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(C.table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(C.table(spark, sf_dir, "documents"), shingle=4)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(C.table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(C.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["agree"])), F.lit(0.0)).alias("score"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write_files(C.table(spark, sf_dir, "documents"), C.shared_path(spark, "tokens"), vocabulary())
    read = tokenfile.read_files(files).select("doc_id", "within", "n_tokens", F.crc32("ids").alias("ids_crc32"), "file")
    return tokenfile.positions(read, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = C.table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.assign(docs, keep=("size", "text_crc32"), with_text=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(C.table(spark, sf_dir, "documents"), with_text=False).taken()
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.quantize(C.table(spark, sf_dir, "embeddings"))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    out = vectorcodes.with_label_errors(coded)
    return out.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"))


def op13_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, folder = C.table(spark, sf_dir, "clicks"), C.shared_path(spark, "clicks")
    k = F.crc32(F.col("click_id").cast("string").cast("binary")) % 128
    ts, day = F.col("ts").cast("timestamp_ntz"), F.col("ts").cast("date")
    back = F.make_dt_interval(((k + 6) * (k + 6) * (k + 6)).cast("int"))
    moment = F.when(k < 16, ts - back).when(k > 111, F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")).otherwise(ts)
    new = F.coalesce(F.col("arrived_at") >= F.lit("2024-05-01").cast("timestamp_ntz"), F.lit(True))
    how = {"moment": moment, "order": ["arrived_at", "click_id"], "id_col": "click_id", "limit": timeparts.rows_limit(clicks)}
    first = timeparts.write(clicks.where(~new), folder, **how)
    out = timeparts.rewrite(clicks, first, folder, new=new, **how)
    return out.select("leaf", "part", "n_rows", "n_new", F.lit(",".join(clicks.columns)).alias("columns"), "ids_sha256", "path", "rewritten").withColumns({c: F.col(c).cast("long") for c in ("part", "n_rows", "n_new")})


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_chat_formatting, op3_url_filters, op4_best_fit_packing, op5_minhash_near_dedup, op6_suffix_dedup, op7_license_scan, op8_quality_rules, op9_token_binary, op10_hilbert_sharding, op11_source_mixing, op12_vector_codes, op13_time_partitions)}

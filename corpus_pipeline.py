"""From raw documents to packed training sequences, in five stages.

A stage takes all that the one before kept and returns the columns of
documents, the last one the packed pieces. Every stage is written and read
again, so a lost executor costs no more than its own part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm import decontaminate, neardup, packing, quality, substrings
from quire.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[2:]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, neither their own nor their host's; null and empty texts have too few words and go."""
    return quality.judge(docs, keep=("text", *REST)).where("kept").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id (none has one: any); documents without words stay."""
    kept = neardup.near_duplicates(docs, keep=REST).where("kept")
    return kept.where("key is null").unionByName(_one_each(kept.where("key is not null"))).select(*COLUMNS)


def _one_each(kept: DataFrame) -> DataFrame:
    """One row of those that stand for one group; groups are told apart by their keys, as ids may be null or shared."""
    again = C.materialize(kept.groupBy("component_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("component_key").alias("_key")), "repeated-groups")
    if again.isEmpty():
        return kept
    same = kept["component_key"] == again["_key"]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["component_key"]))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur elsewhere too; a text of which nothing is left stays as an empty one."""
    out = substrings.remove_repeats(docs, keep=REST)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth; those without words stay, and so do all where there are no items."""
    found = decontaminate.contamination(docs, C.table(spark, sf_dir, "benchmark")).where("contaminated")
    found = found.select(F.col("doc_id").alias("_id"), "text_key").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["text_key"]), "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 2,048; an empty text is its end id alone."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", minhash_near_dedup),
    ("suffix dedup", suffix_dedup),
    ("decontamination", benchmark_decontamination),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.

    Columns beyond those of documents are left out first, so their names clash
    with nothing. Null ids are ids like others, and rows that share one are told
    apart by their texts. Texts are read whole, however long. An empty table
    gives no rows, with the columns of the last stage.
    """
    docs = C.table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = C.materialize(docs, f"stage-{name.replace(' ', '-')}")
    return docs


#: Token ids are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None

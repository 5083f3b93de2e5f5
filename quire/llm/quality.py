"""Quality rules with host verdicts, in DataFrame functions alone.

Every document gets its base figures; rule failures are summed by host, each
host's failure rate is shrunk with a beta prior fitted to all hosts, and the
verdicts of hosts go back to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: A host is rejected if its shrunk failure rate is above this: then fewer than one in ten of its documents is lost that no rule fails by itself.
HOST_RATE = 0.9


def _covered(flagged: Column, n: int) -> Column:
    """Words covered by windows of n words that start at the ascending positions given."""
    step = lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(n), p + n - acc["end"])).alias("sum"), (p + n).alias("end"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    return F.aggregate(flagged, start, step, lambda acc: acc["sum"]).cast("long")


def document_figures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Base figures of each row: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Null text: no words, all figures 0. One row out for each row in, repeated
    rows included. Repeats are found by sorting the hashes of a text's own
    windows, so a text of one repeated word costs n log n.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    base = C.let(base, _w=C.words(text, C.BLANKS), _lines=lines)
    base = C.let(base, _g=C.grams(F.col("_w"), WINDOW))
    ordered = F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    base = C.let(base, _s=F.when(F.size(F.array_distinct("_g")) < F.size("_g"), ordered))
    twice = F.filter(F.transform("_s", lambda x, i: F.when((x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]), x["p"])), lambda p: p.isNotNull())
    return base.select(
        "doc_id",
        "host",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_s").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.array_sort(twice), WINDOW)).alias("n_repeat_words"),
        *[f"_keep_{c}" for c in keep],
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def host_rates(figures: DataFrame) -> DataFrame:
    """Failure rate of each host, shrunk towards all hosts: host, n, failed, rate, host_rejected.

    The prior is a beta fitted by moments to the hosts' rates, weighted by their
    documents; hosts that all agree give a prior worth as much as the
    documents of an average host. What a small host says counts less than the
    prior, which is all that its size does. A null host is a host.
    """
    hosts = figures.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    # Three sums over hosts, a single row however many there are.
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts"), F.sum(rate * rate * F.col("n")).alias("squares")).first()
    alpha, beta = beta_prior(total["n"] or 0, total["failed"] or 0, total["hosts"], total["squares"] or 0.0)
    shrunk = (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.withColumn("rate", shrunk).withColumn("host_rejected", F.col("rate") > HOST_RATE)


def beta_prior(n: int, failed: int, hosts: int, squares: float) -> tuple[float, float]:
    """Alpha and beta by the method of moments; squares: sum over hosts of n * rate ** 2."""
    if not n:
        return 0.5, 0.5
    mean = failed / n
    between = max(squares / n - mean * mean - mean * (1 - mean) * hosts / n, 0.0)  # less what sampling alone gives
    weight = mean * (1 - mean) / between - 1 if between > 0 else n / hosts
    weight = min(max(weight, 2.0), max(n / hosts, 2.0))
    return max(mean * weight, 0.01), max((1 - mean) * weight, 0.01)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """All rows with figures, base_failed, host, host_rate, host_rejected, kept, and the columns named in keep.

    Empty table: no rows. Null text has no words and fails. The figures are
    written once to the shared folder; both the hosts' sums and the way back
    read them from there. On the way back the documents of a large host are
    dealt over many tasks.
    """
    figures = C.materialize(document_figures(docs, id_col=id_col, text_col=text_col, host_col=host_col, keep=keep), "quality")
    named = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))  # a null host has a name too
    rates = C.materialize(host_rates(figures).select(named.alias("_host"), "n", F.col("rate").alias("host_rate"), "host_rejected"), "hosts")
    heavy = C.heavy_keys(rates, "_host", "n", figures.count())
    joined = C.salted_join(figures.withColumn("_of", named), rates, "_of", "_host", heavy, ["doc_id", "word_chars", "n_words"])
    return joined.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "host_rejected",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )

"""The pipeline against its stages by brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from test_operators import ITEM, contamination, corpus, figures, ids_of, linked, without_repeats

import corpus_pipeline
from quire.llm import packing

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def by_hand(rows, items):
    rows = [r for r in rows if (f := figures(r[1]))[0] >= 20 and 100 * f[4] <= 30 * f[0]]
    _, group = linked(rows, 5)
    least = {g: min(r[0] for r, x in zip(rows, group, strict=True) if x == g) for g in group}
    rows = [r for r, g in zip(rows, group, strict=True) if r[0] == least[g]]
    rows = [(i, kept.decode("utf-8", "ignore")) for i, _, kept, _ in without_repeats(rows, 200).elements()]
    rows = [r for r in rows if not contamination(r[1], items)[3]]
    return {i: ids_of(text, 0) for i, text in rows}


def test_pipeline(spark, tmp_path):
    r = random.Random(9)
    rows = [x for x in corpus()[:24]]
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    shared = " ".join(word() for _ in range(70))
    for i in range(100, 112):
        text = " ".join(word() for _ in range(60))
        rows += [(i, text, "en", "s", 1), (i + 50, text.replace(text.split()[9], "other"), "en", "s", 1), (i + 100, f"{text[:90]} {shared} {word()} é{word()}", "en", "s", 1)]
    rows += [(300, f"{' '.join(word() for _ in range(40))} {ITEM}", "fr", None, 1)]
    items = [(1, ITEM), (2, "mit license")]
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, x, strict=True)) for x in rows], SCHEMA), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), tmp_path / "benchmark.parquet")
    pieces = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        pieces[p.doc_id].append((p.piece, np.frombuffer(p.ids, "<u4").tolist()))
        assert p.length <= packing.CAPACITY
    got = {i: [x for _, ids in sorted(v) for x in ids] for i, v in pieces.items()}
    want = by_hand(rows, items)
    assert got == want and 8 not in got and 300 not in got and 100 in got and 150 not in got
    assert re.match("[0-9]", str(len(got)))


def test_pipeline_with_null_and_reused_ids(spark, tmp_path):
    """The whole corpus, several rows without an id and unrelated texts under one id: every group of near-duplicates leaves one document."""
    r = random.Random(21)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = [prose(40) for _ in range(8)]
    more = [(None, t) for t in texts[:4]] + [(None, texts[0]), (500, texts[4]), (500, texts[5]), (500, texts[5]), (None, texts[6]), (501, texts[6]), (502, texts[6]), (None, texts[7]), (503, f"{texts[7]} end")]
    rows = corpus() + [(i, t, "en", "s9", len(t)) for i, t in more]
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, x, strict=True)) for x in rows], SCHEMA), tmp_path / "documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    fit = [x for x in rows if (f := figures(x[1]))[0] >= 20 and 100 * f[4] <= 30 * f[0]]
    _, group = linked(fit, 5)
    least = {g: min((x[0] for x, y in zip(fit, group, strict=True) if y == g and x[0] is not None), default=None) for g in group}
    one = {g: x[:2] for x, g in zip(fit, group, strict=True) if x[0] == least[g]}
    judged = corpus_pipeline.quality_rules(spark, docs, f"file://{tmp_path}")
    got = collections.Counter((x.doc_id, x.text) for x in corpus_pipeline.minhash_near_dedup(spark, judged, f"file://{tmp_path}").collect())
    assert got == collections.Counter(one.values())
    assert {(None, t) for t in texts[:4]} <= set(got) and {(500, texts[4]), (500, texts[5]), (501, texts[6]), (503, f"{texts[7]} end")} <= set(got)

    pq.write_table(pa.table({"item_id": [1, 2], "text": [ITEM, "mit license"]}), tmp_path / "benchmark.parquet")
    kept = [(i, t.decode("utf-8", "ignore")) for i, _, t, _ in without_repeats(list(one.values()), 200).elements()]
    want = collections.Counter((i, n) for i, t in kept if not contamination(t, [(1, ITEM), (2, "mit license")])[3] for n in [len(ids_of(t, 0))])
    sizes = collections.Counter()
    for x in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        sizes[x.doc_id] += x.length
    total = collections.Counter()
    for (i, n), times in want.items():
        total[i] += n * times
    assert sizes == total


def test_pipeline_on_an_empty_table(spark, tmp_path):
    pq.write_table(pa.Table.from_pylist([], SCHEMA), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), tmp_path / "benchmark.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.count() == 0 and {"doc_id", "piece", "length", "ids"} <= set(out.columns)


def test_pipeline_on_long_and_empty_texts_and_more_columns(spark, tmp_path):
    """Texts of two megabytes, of one word, of nothing and null; the table has columns by names that the stages use within."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    long = " ".join(word() for _ in range(300_000))
    plain = " ".join(word() for _ in range(50))
    rows = [(1, long, "en", None, 0), (2, long + " end", "en", "s", None), (3, "", None, "s", 0), (4, None, "en", "s", None), (5, "x" * 100_000, "en", "s", 0), (6, plain, "en", "s", 0), (7, plain, "en", "s", 0), (8, f"{plain[:150]} {ITEM}", "de", "s", 0)]
    table = pa.Table.from_pylist([dict(zip(SCHEMA.names, x, strict=True)) for x in rows], SCHEMA)
    for name in ("_text", "key", "kept", "text_key", "_w", "piece", "component_key"):
        table = table.append_column(name, pa.array(range(len(rows)), pa.int64()))
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [ITEM], "_w": [1], "doc_id": [3]}), tmp_path / "benchmark.parquet")
    sizes = collections.Counter()
    for p in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        sizes[p.doc_id] += p.length
    assert sizes == {1: len(ids_of(long, 0)), 6: len(ids_of(plain, 0))}

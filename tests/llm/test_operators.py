"""Every operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F
from tests_common import SF, against_sql

from quire.llm import chat, decontaminate, licenses, neardup, oracle, packing, quality, queries, sharding, substrings, tokenfile, urls
from quire.llm import common as C
from quire.llm import text as T
from quire.llm.tokens import Encoder

rng = random.Random(7)
VOCABULARY = queries.vocabulary()
WORDS = ["the", "of", "and", "onen", "éau", "thst", "ering", "Hand", "über", "3rd", "x", "日本", "a-b"]


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",\n", "\n\n"]) for _ in range(n))


def mutated(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9999))
    return " ".join(words)


ITEM = " ".join(f"item{i}" for i in range(20))


@functools.cache
def corpus():
    base, shared = prose(200), " ".join(f"shared{i}" for i in range(60))
    texts = [None, "", " \n\t ", "one", "one two three", "One TWO three", base, base, mutated(base, 2), mutated(base, 60), shared + " " + prose(50), prose(40) + " " + shared, prose(30) + " " + ITEM + " " + prose(10),
             " ".join(ITEM.split()[:12]), " ".join(ITEM.split()[3:16]).upper(), "a" * 3000, "ab " * 2000, "word " * 30, prose(20000), "dup line here\n" * 12, "# * $ % & | < >", "Mit License, mit license; GNU General Public License", "\ufffd\u2028 nul\x00 x", "it's 'tis  <|endoftext|>"]
    rows = [(i, x, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", None]), len(x or "")) for i, x in enumerate(texts)]
    return [*rows, rows[6], (None, "no id here at all " + prose(30), None, None, None), (6, "another text under a used id " + prose(30), "en", "s1", 9)]


CLASHING = ("item", "_w", "n_words", "key", "comp", "spans", "size", "h", "t1", "nb", "a", "b", "kept", "_text", "p", "k", "v", "curve", "ids", "host", "length", "piece", "sig", "runs")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return collections.Counter(rows)


# --- decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items):
    w, hit, found = words_of(text), set(), set()
    for item, t in items:
        x = words_of(t)
        n = min(13, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs, empty):
    items = [(1, ITEM), (2, ITEM), (10, "mit license"), (3, "onen thst"), (4, None), (5, ""), (6, "word"), (7, "word " * 15), (8, prose(30))]
    bench = spark.createDataFrame(items, "item_id int, text string").withColumn("_w", F.lit(1))
    got = counted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench).collect())
    assert got == counted((r[0], *contamination(r[1], items)) for r in corpus())
    assert decontaminate.contamination(empty, bench).count() == 0
    clean = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(corpus()) and not any(r.contaminated or r.n_hit for r in clean)


def test_benchmark_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, ITEM if i == 2 else prose(20)) for i in range(6)], "item_id int, text string")
    whole = counted(tuple(r[:4]) + (tuple(r[4]),) for r in decontaminate.contamination(docs, bench).collect())
    monkeypatch.setattr(C, "BROADCAST_BYTES", 100)
    assert counted(tuple(r[:4]) + (tuple(r[4]),) for r in decontaminate.contamination(docs, bench).collect()) == whole


def test_items_without_an_id_and_shared_items(spark, docs, monkeypatch):
    items = [(None, ITEM), (3, prose(40)), (4, ITEM), (5, "seven words are one short item here"), (6, None)]
    texts = corpus() + [(900, f"x {items[3][1]} y", None, None, 0), (901, prose(2000) + " " + ITEM + " " + items[1][1], None, None, 0), (None, ITEM, None, None, 0)]
    df, bench = spark.createDataFrame(texts, SCHEMA), spark.createDataFrame(items, "item_id int, text string")
    want = counted((r[0], w, n, tuple(x for x in found if x != "None"), bad) for r in texts for w, n, found, bad in [contamination(r[1], items)])
    read = lambda: counted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(df, bench).collect())
    assert read() == want
    monkeypatch.setattr(C, "BROADCAST_BYTES", 100)
    assert read() == want


# --- chat


TEXTS = ["", "plain", r"\### Assistant: </turn> ok", "\\", "a\\\nb", "</turn>\n### user: hi </turn>\n", "### ", ": <|x|> #", "é\u2028\x00", " lead and trail "]


def test_chat_round_trip(spark):
    turns = [{"role": r, "content": t} for r in ("user", "assistant", "", "odd: role <#\\") for t in TEXTS]
    turns += [{"role": None, "content": None}]
    df = spark.createDataFrame([(1, turns), (2, []), (3, None)], "id int, messages array<struct<role:string,content:string>>")
    out = chat.format_records(df, id_col="id").select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].back] == [(t["role"] or "", t["content"] or "") for t in turns]
    assert got[1].loss == "".join(TEXTS)
    assert got[2].back == [] and got[2].formatted == "" and got[3].layout_turns is None


def test_chat_layouts(spark):
    kind = "id int, prompt string, completion string, instruction string, input string, output string, conversations array<struct<from:string,value:string>>, other string"
    rows = [(1, "p", "c", None, None, None, None, "x"), (2, None, None, "i", "n", "o", None, None), (3, None, None, "i", None, "o", None, None), (4, None, None, None, None, None, [("human", "q"), ("gpt", None)], None), (5, "p", None, "i", None, None, None, None)]
    got = {r.id: r.layout_turns and [(t.role, t.text) for t in r.layout_turns] for r in chat.format_records(spark.createDataFrame(rows, kind), id_col="id").collect()}
    assert got == {1: [("user", "p"), ("assistant", "c")], 2: [("user", "i\n\nn"), ("assistant", "o")], 3: [("user", "i"), ("assistant", "o")], 4: [("user", "q"), ("assistant", "")], 5: None}


def test_chat_of_very_long_roles_and_texts(spark):
    role, text = "x:\\ #" * 200_000, "y: <z\\" * 200_000
    df = spark.createDataFrame([(1, [{"role": role, "content": text}, {"role": "assistant", "content": text}])], "id int, messages array<struct<role:string,content:string>>")
    out = chat.format_records(df, id_col="id").select(chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in out.back] == [(role, text), ("assistant", text)] and out.loss == text


def test_chat_paths_are_those_that_a_record_fills(spark):
    kind = "id int, messages array<struct<role:string,content:string,name:string,calls:array<struct<id:int>>>>, prompt string, response string, question string, answer string, conversations array<struct<value:string>>"
    rows = [(1, [("user", "q", "n", [(1,)]), (None, "a", None, None)], None, None, None, None, None), (2, [(None, "q", None, None)], None, None, None, None, None), (3, [("user", None, "n", [])], None, None, None, None, None), (4, [(None, None, "n", None)], None, None, None, None, None),
            (5, [], "p", "r", None, None, None), (6, None, None, None, "q", "", None), (7, None, "p", None, "q", "a", None), (8, None, None, None, None, None, [("v",)]), (9, [(None, None, None, None)], "p", "r", None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = {r.id: r.layout_turns and [(t.role, t.text) for t in r.layout_turns] for r in chat.format_records(df, id_col="id").collect()}
    assert got == {1: [("user", "q"), ("", "a")], 2: [("", "q")], 3: [("user", "")], 4: None, 5: [("user", "p"), ("assistant", "r")], 6: [("user", "q"), ("assistant", "")], 7: None, 8: None, 9: [("user", "p"), ("assistant", "r")]}
    assert chat.format_records(df.limit(0), id_col="id").count() == 0


def test_every_layout_holds_what_was_put_in(spark):
    one = [("user", "do\n\nthis\n\nnow"), ("assistant", "done")]
    rows = [(i, one) for i in range(60)] + [(100 + i, t) for i in range(8) for t in ([("system", "s"), ("user", ""), ("assistant", "")], [("human", "h"), ("gpt", "g")], [("user", "\n\nx"), ("assistant", "")], [("user", "only")])]
    df = spark.createDataFrame([(i, [{"role": r, "content": c} for r, c in t]) for i, t in rows], "conv_id long, messages array<struct<role:string,content:string>>")
    moved = chat.in_layouts(df)
    used = {tuple(k for k, v in r.asDict().items() if v is not None and k != "conv_id") for r in moved.collect()}
    assert used == {("messages",), ("conversations",), ("prompt", "completion"), ("prompt", "response"), ("instruction", "output"), ("instruction", "input", "output"), ("question", "answer")}
    got = counted((r.conv_id, tuple((t.role, t.text) for t in r.layout_turns)) for r in chat.format_records(moved, id_col="conv_id").collect())
    assert got == counted((i, tuple(t)) for i, t in rows)


def test_chat_rows(spark):
    rows = [(1, 2, "user", "b"), (1, 1, None, None), (1, 2, "user", "b"), (None, None, "user", "x"), (1, None, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("content", F.lit(1))
    got = {r.conv_id: [(m.role, m.content) for m in r.messages] for r in chat.records(df).collect()}
    assert got == {1: [("system", "s"), ("", ""), ("user", "b"), ("user", "b")], None: [("user", "x")]}
    assert chat.records(df.limit(0)).count() == 0


# --- URLs


def judged(url, rules=urls.RULES):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(-len(h + p), i, h + p, v) for i, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, min(fits)[2], min(fits)[3]) if fits else (host, path, None, "allow")


def test_urls(spark):
    odd = [None, "", "no scheme com/en/", "http://com/en/", "HTTP://A.COM/en/x?y", "http://acom/en/", "https://x.example.com/en/7/8#z", "x://org/es/", "x://a.b/.com/en/", "http://a://b.com/en/", "https://EXAMPLE.NET/de/81", "http://net/de/", "http://com/EN/", "http://é.com/en/é", "http://com:80/en/", "http://com/en/" + "y" * 5000, "://com/en/", "http://\n.com/en/"]
    odd += [f"http://{rng.choice(['', 'a.', 'b.c.'])}{rng.choice(['com', 'example.com', 'net', 'example.net', 'org', 'xcom'])}/{rng.choice(['en', 'de', 'es'])}/{rng.choice(['7', '8', '79', ''])}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(odd)), "page_id int, url string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {i: judged(u) for i, u in enumerate(odd)}
    assert urls.judge(df.limit(0)).count() == 0


def test_globs_against_regular_expressions():
    def regex(g):
        out, i = "", 0
        while i < len(g):
            if g[i] == "*":
                double = g[i : i + 2] == "**"
                out, i = out + (".*" if double else "[^/]*"), i + 1 + double
            elif g[i] == "?":
                out, i = out + "[^/]", i + 1
            else:
                i += g[i] == "\\"
                out, i = out + re.escape(g[i]), i + 1
        return re.compile(out, re.S)

    r = random.Random(3)
    globs = ["", "*", "**", "a*b", "a**b", "?", "*?/**", r"\*a", "ab" * 40 + "*"] + ["".join(r.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(r.randrange(9))).replace("***", "**") for _ in range(60)]
    texts = ["", "a", "ab" * 40, "*a"] + ["".join(r.choice("ab/") for _ in range(r.randrange(12))) for _ in range(200)]
    data, offsets = T.buffer_of(pa.array(texts))
    machine = urls.Automaton.of(globs)
    for rows, chars, sizes in urls.blocks(data, offsets):
        for i, hits in zip(rows.tolist(), machine.run(chars, sizes), strict=True):
            assert hits.tolist() == [bool(regex(g).fullmatch(texts[i])) for g in globs], texts[i]


# --- tokens, packing, files


def ids_of(text, end):
    return [*Encoder.of(VOCABULARY).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_agrees_with_the_library():
    texts = ["", " ", "  a", "it's it''s 'tis 'LL", "\n\nThe\n x", "a\u00a0 b", "é, è. a—b", "<|endoftext|> x", "x'Re \t\tfoo_bar 12,3 ３４", "日本 語。a", "a\x00b", "!'s b!'s", "\u3000 x"] + [x[1] for x in corpus() if x[1]]
    data, offsets = T.buffer_of(pa.array(texts))
    ids, at = Encoder.of(VOCABULARY).encode(data, offsets)
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(x, 0)[:-1]


END = "<|endoftext|>"
WITH_ADDED = [f"see {END} here", END, END * 2, f"a{END}b", f" {END}  {END} ", f"x\n{END}\n\ny é{END}é", "<|endoftext", "|>", "<|endof text|>", f"<|endof{END}text|>", f"<{END}>", f"it{END}'s 12{END}3", f"{END.upper()} {END[:-1]} {END}", "plain"]


def fresh_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_added_tokens_are_encoded_as_by_a_fresh_tokenizer():
    want = [fresh_ids(x) for x in WITH_ADDED]
    assert want[0] == [3826, 220, 50256, 994]
    for texts, ids_wanted in [(WITH_ADDED, want), *[([x], [w]) for x, w in zip(WITH_ADDED, want, strict=True)]]:
        data, offsets = T.buffer_of(pa.array(texts))
        ids, at = Encoder(VOCABULARY).encode(data, offsets)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == ids_wanted


def test_added_tokens_in_packing_and_files(spark):
    df = spark.createDataFrame(list(enumerate(WITH_ADDED)), "doc_id long, text string")
    packed = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack_documents(df, VOCABULARY).collect()}
    files = tokenfile.write_files(df, C.shared_path(spark, "test-added"), VOCABULARY)
    filed = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfile.read_files(files).collect()}
    for i, x in enumerate(WITH_ADDED):
        assert packed[i] == [*fresh_ids(x), packing.END_ID] and filed[i] == [*fresh_ids(x), tokenfile.END_ID]


def test_span_hashes_tell_spans_apart():
    texts = sorted({("ab"[i % 2] * (1 + i % 7) + str(i // 14) + "z" * (i % 3)) for i in range(20000)} | {"q" * (1 << 17), "q" * (1 << 16) + "r" + "q" * ((1 << 16) - 1)})
    data, offsets = T.buffer_of(pa.array(texts))
    assert len(np.unique(T.span_hashes(data, offsets[:-1], offsets[1:]))) == len(texts)


def test_packing(spark, docs, empty):
    out = packing.pack_documents(docs, VOCABULARY, capacity=256).collect()
    want = counted(np.array(ids_of(r[1], 0), "<u4").tobytes() for r in corpus())
    by_text, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.length <= 256 and (r.piece == 0 or r.length == 256)
        by_text[r.doc_id].append((r.piece, r.start, bytes(r.ids)))
    got = collections.Counter()
    for doc, pieces in by_text.items():
        if doc != 6:  # several rows share that id
            pieces.sort()
            assert [p[1] for p in pieces] == np.cumsum([0, *[len(p[2]) // 4 for p in pieces]]).tolist()[:-1]
            got[b"".join(p[2] for p in pieces)] += 1
    assert not got - want
    for places in sequences.values():
        places.sort()
        assert [p[0] for p in places] == np.cumsum([0, *[p[1] for p in places]]).tolist()[:-1] and sum(p[1] for p in places) <= 256
    assert sum(r.length for r in out) == sum(len(x) // 4 * n for x, n in want.items())
    assert packing.pack_documents(empty, VOCABULARY).count() == 0


def test_fillings_are_complete_and_tight():
    r = np.random.default_rng(5)
    for lengths in (r.integers(1, 100, 500), r.integers(30, 60, 300), [100] * 7, [51] * 9, [1], []):
        counts = dict(collections.Counter(int(x) for x in lengths))
        found = packing.fillings(counts, 100)
        used = collections.Counter()
        for times, filling in found:
            assert sum(filling) <= 100
            for x in filling:
                used[x] += times
        assert used == collections.Counter(counts)
        bound = -(-sum(x * n for x, n in counts.items()) // 100)
        assert sum(t for t, _ in found) <= max(bound * 1.12 + 1, sum(n for x, n in counts.items() if x > 50))


def fewest_bins(items, capacity):
    """By trying every bin for every item."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j, load in enumerate(bins):
            if load + items[i] <= capacity and load not in bins[:j]:
                go(i + 1, [*bins[:j], load + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_fillings_are_fewest():
    r, gained = random.Random(6), 0
    for _ in range(400):
        capacity = r.randrange(8, 40)
        items = [r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 11))]
        counts = dict(collections.Counter(items))
        assert packing.least_bins(counts, capacity) <= fewest_bins(items, capacity) == sum(t for t, _ in packing.fillings(counts, capacity))
    for _ in range(20):
        counts = dict(collections.Counter(r.randrange(20, 50) for _ in range(30)))
        gained += sum(t for t, _ in packing.best_fit(counts, 100)) - sum(t for t, _ in packing.fillings(counts, 100))
    assert gained > 5  # best-fit decreasing alone is not enough there
    huge = {49: 2 * 10**9, 34: 2 * 10**9, 17: 4 * 10**9 + 1, 51: 3 * 10**9, 26: 10**9}
    assert sum(t for t, _ in packing.fillings(huge, 100)) < sum(t for t, _ in packing.best_fit(huge, 100))


def test_many_times_a_perfect_set_stays_perfect():
    rng = random.Random(3)
    perfect = []
    for _ in range(12):
        cuts = sorted(rng.sample(range(60, 2048 - 60), 4))
        perfect += [b - a for a, b in zip([0, *cuts], [*cuts, 2048], strict=True)]
    counts = {x: perfect.count(x) for x in perfect}
    assert sum(n for n, _ in packing.fillings(counts)) == 12
    for times in (10, 1000, 100_000):
        found = packing.fillings({x: n * times for x, n in counts.items()})
        assert sum(n for n, _ in found) == 12 * times
        used = {}
        for n, filling in found:
            for x in filling:
                used[x] = used.get(x, 0) + n
        assert used == {x: n * times for x, n in counts.items()}
    more = {x: n * 1000 + i % 3 for i, (x, n) in enumerate(counts.items())}
    assert sum(n for n, _ in packing.fillings(more)) <= packing.least_bins(more, 2048) + 40


def test_rows_without_ids_fill_many_files(spark, tmp_path):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are read by one task
    try:
        files = tokenfile.write_files(docs, f"file://{tmp_path}/t", VOCABULARY)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 1 and files.agg(F.sum("n_docs")).first()[0] == 4000 and files.agg(F.max("n_docs")).first()[0] < 3000


def test_packing_query(spark):
    """The query at its own capacity, ids from a fresh tokenizer."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(VOCABULARY)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for x in queries.op4_best_fit_packing(spark, SF).collect():
        pieces[x.doc_id].append((x.piece, x.start, x.length, x.ids_crc32))
        sequences[x.sequence_id].append((x.offset, x.length))
    rows, total = spark.read.parquet(f"{SF}/documents.parquet").collect(), 0
    for x in rows:
        ids = np.array([*fresh.encode(x.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        assert sorted(pieces.pop(x.doc_id)) == [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
        total += len(ids)
    assert not pieces and len(sequences) == -(-total // 2048)
    for places in sequences.values():
        places.sort()
        assert [p for p, _ in places] == np.cumsum([0, *[n for _, n in places]]).tolist()[:-1] and sum(n for _, n in places) <= 2048


def test_token_files(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_BYTES", 4000)
    files = tokenfile.write_files(docs, C.shared_path(spark, "test-tokens"), VOCABULARY)
    got = tokenfile.positions(tokenfile.read_files(files), files).orderBy("start").collect()
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = np.array(ids_of(r[1], 2), "<u4")
        assert (g.doc_id, g.start, g.n_tokens, bytes(g.ids)) == (r[0], start, len(ids), ids.tobytes())
        start += len(ids)
    name = next(f.file for f in files.collect() if f.n_docs > 3)
    fs, inner = tokenfile.filesystem(name)
    with fs.open_input_file(inner) as source:
        reader = tokenfile.FileReader(source)
        wanted = int(reader.docs[1]["id"])
        assert len(reader.frames) >= 1
    assert wanted in tokenfile.read_documents(name, {wanted})
    with fs.open_input_stream(inner) as source:
        raw = bytearray(source.read())
    raw[10] ^= 1
    with pytest.raises((tokenfile.BadFile, zstandard.ZstdError)):
        list(tokenfile.FileReader(_Memory(bytes(raw))).all())
    whole = tokenfile.FileReader(_Memory(bytes(raw)))
    if len(whole.frames) > 1:  # a damaged frame harms its own documents only, and others are not even read
        last = len(whole.docs) - 1
        memory = _Memory(bytes(raw))
        assert len(tokenfile.FileReader(memory).ids(last)) == whole.docs[last]["n"]
        assert all(at + n <= whole.frames[0]["at"] or at >= whole.frames[0]["at"] + whole.frames[0]["size"] for n, at in memory.seen)
    assert tokenfile.read_files(tokenfile.write_files(empty, C.shared_path(spark, "none"), VOCABULARY)).count() == 0


class _Memory:
    def __init__(self, raw):
        self.raw, self.seen = raw, []

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        self.seen.append((n, at))
        return self.raw[at : at + n]


# --- near-duplicates


def linked(rows, k, percent=80):
    sets = []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower())
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    return sets, group


def check_components(rows, out, k):
    sets, group = linked(rows, k)
    least = {g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None), default=None) for g in group}
    want = counted((r[0], len(s), least[g], r[0] == least[g]) for r, s, g in zip(rows, sets, group, strict=True))
    assert counted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == want


def test_near_duplicates(docs, empty):
    check_components(corpus(), neardup.near_duplicates(docs, shingle=4).collect(), 4)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_write_no_texts_but_candidates(spark, docs, monkeypatch):
    """Steps are written without texts, except those of documents that have a candidate."""
    written, real = {}, C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: written.setdefault(name, df.columns) and real(df, name))
    rows = [(i, f"some words of number {i} and no other {i}", None, None, 0) for i in range(50)] + [(70 + i, None, None, None, 0) for i in range(3)] + [(80, " ", None, None, 0), (None, "a b c d", "en", None, 0), (None, "a b c d", None, None, 0)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4, keep=("lang",)).collect()
    check_components(rows, out, 4)
    assert counted((r.doc_id, r.text, r.lang) for r in out) == counted(r[:3] for r in rows)
    assert [name for name, columns in written.items() if "text" in columns] == ["candidates"]


def test_masked_rows(spark):
    rows, wanted = spark.range(20000).withColumnRenamed("id", "a"), spark.range(0, 20000, 40).withColumnRenamed("id", "b")
    got = {r.a for r in C.masked(rows, "a", wanted, "b").collect()}
    assert got >= set(range(0, 20000, 40)) and len(got) < 600
    assert C.masked(rows, "a", wanted.limit(0), "b").count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    """Nodes, chunks and blocks are made small, so that one group takes every path."""
    for name, n in (("SMALL", 6), ("CHUNK", 16), ("PIVOTS", 6), ("MEET", 16)):
        monkeypatch.setattr(neardup, name, n)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, 0))
    rows += [(200 + i, " ".join(f"u{i}x{j}" for j in range(30)), None, None, 0) for i in range(10)]
    check_components(rows, neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4).collect(), 4)


def test_large_node_of_unrelated_pairs(spark, monkeypatch):
    """A node of many chunks, nothing of which chains: members of a pair meet wherever they were dealt to."""
    for name, n in (("SMALL", 6), ("CHUNK", 16), ("PIVOTS", 2), ("MEET", 16)):
        monkeypatch.setattr(neardup, name, n)
    r = random.Random(8)
    sigs, pairs = {}, set()
    for i in range(60):
        sig = [r.randrange(-(10**9), 10**9) for _ in range(neardup.SIGNATURE)]
        pair = [hashlib.blake2b(f"{i} {j}".encode(), digest_size=16).digest() for j in range(2)]
        sigs |= {pair[0]: sig, pair[1]: [x if k < 50 else x ^ 1 for k, x in enumerate(sig)]}
        pairs.add(frozenset(pair))
    vertices = spark.createDataFrame(list(sigs.items()), "key binary, sig array<int>")
    members = spark.createDataFrame([(node, k, len(sigs)) for node in (5, 6) for k in sigs], "node long, key binary, size long")
    groups = collections.defaultdict(set)
    for x in neardup.components(neardup._clustered(members, vertices)).collect():
        groups[bytes(x.comp)].add(bytes(x.key))
    assert {frozenset(g) for g in groups.values()} == pairs


def test_components_of_paths_stars_and_random_links(spark):
    r = random.Random(5)
    links = [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("hub", f"s{i}") for i in range(60)] + [("x", "x"), ("s3", "s3")]
    links += [(f"r{r.randrange(70)}", f"r{r.randrange(70)}") for _ in range(45)] + [("b", "a"), ("a", "b")]
    group = {}
    for a, b in links:
        if a != b:
            merged = group.get(a, {a}) | group.get(b, {b})
            group |= dict.fromkeys(merged, merged)
    df = spark.createDataFrame([(a.encode(), b.encode()) for a, b in links], "a binary, b binary")
    got = {bytes(x.key).decode(): bytes(x.comp).decode() for x in neardup.components(df).collect()}
    assert got == {k: min(v) for k, v in group.items()}
    assert neardup.components(df.limit(0)).count() == 0


def test_near_duplicates_of_single_blocks_find_components_of_pairs_only(spark, docs, monkeypatch):
    """What a block's sets connect are components already: links that were confirmed take no further rounds where no cluster has several blocks."""
    calls, real = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda links: calls.append(1) or real(links))
    check_components(corpus(), neardup.near_duplicates(docs, shingle=4).collect(), 4)
    assert len(calls) == 1


def test_few_links_are_contracted_by_one_task(spark, monkeypatch):
    """Links that fit into one task take no rounds."""
    written, real = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: written.append(name) or real(df, name))
    df = spark.createDataFrame([(f"p{i:03}".encode(), f"p{i + 1:03}".encode()) for i in range(90)], "a binary, b binary").repartition(9)
    assert {(bytes(x.key), bytes(x.comp)) for x in neardup.components(df).collect()} == {(f"p{i:03}".encode(), b"p000") for i in range(91)}
    assert "parents" not in written


def test_large_cluster_of_half_alike_texts_is_parted(spark, monkeypatch):
    """Short texts that share a line chain into one cluster of many blocks; only those that share rare words meet, and no linked pair is parted."""
    for name, n in (("SMALL", 6), ("CHUNK", 16), ("MEET", 16)):
        monkeypatch.setattr(neardup, name, n)
    line, r = " ".join(f"line{i}" for i in range(23)), random.Random(2)
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(9)) + " " + line, None, None, 0) for i in range(150)]
    rows += [(200 + i, rows[i][1] + (f" more{i}" if r.random() < 0.5 else ""), None, None, 0) for i in range(0, 150, 5)]
    rows += [(400 + i, f"{line} tail{i % 3} {'x ' * (i % 4)}end", None, None, 0) for i in range(24)]
    asked, real, parted, split = [], neardup._left_over, [], neardup._parted
    monkeypatch.setattr(neardup, "_left_over", lambda blocked, comps: asked.append(blocked.where("blocks > 1").count()) or real(blocked, comps))

    def seen(members, k, percent):
        out = split(members, k, percent)
        parted.append((members.count(), sorted(x["count"] for x in out.groupBy("cluster").count().collect())))
        return out

    monkeypatch.setattr(neardup, "_parted", seen)
    check_components(rows, neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4).collect(), 4)
    assert parted and parted[0][0] > 150 and parted[0][1][-1] < 40 and max(asked, default=0) < 40


def test_parted_clusters_keep_linked_sets_together(spark):
    """Against brute force: members of two clusters that share texts, at several percentages."""
    r = random.Random(4)
    texts = {}
    for i in range(160):
        w = [f"w{j}" for j in range(r.choice([12, 30]))] if i % 2 else [f"v{r.randrange(40)}" for _ in range(14)]
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"z{r.randrange(30)}"
        texts[" ".join(w)] = None
    rows = [(f"cluster {c}".encode(), f"{c} {i}".encode(), t) for c in range(2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "cluster binary, key binary, text string")
    for percent in (50, 65, 80):
        got = {bytes(x.key): bytes(x.cluster) for x in neardup._parted(df, 2, percent).collect()}
        sets, linked_ = [set(zip(t.split(), t.split()[1:])) for t in texts], 0
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if 100 * len(x & y) >= percent * len(x | y):
                    linked_ += 1
                    assert all(got[f"{c} {i}".encode()] == got[f"{c} {j}".encode()] for c in range(2))
        names = [{v for k, v in got.items() if k.startswith(f"{c} ".encode())} for c in range(2)]
        assert linked_ and not names[0] & names[1]


def test_components_over_many_parts_in_few_steps(spark, monkeypatch):
    """Links of one component lie in other parts and steps; what is written stays a few steps for each round."""
    monkeypatch.setattr(neardup, "LINKS", 7, raising=False)
    digest = lambda x: hashlib.blake2b(str(x).encode(), digest_size=16).digest()
    r = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [("hub", f"s{i}") for i in range(300)] + [(f"c{i}", f"c{i % 25}") for i in range(150)]
    group = {}
    for a, b in links:
        if a != b:
            merged = group.get(a, {a}) | group.get(b, {b})
            group |= dict.fromkeys(merged, merged)
    r.shuffle(links)
    df = spark.createDataFrame([(digest(a), digest(b)) for a, b in links], "a binary, b binary").repartition(13)
    written, real = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: written.append(name) or real(df, name))
    got = {bytes(x.key): bytes(x.comp) for x in neardup.components(df).collect()}
    assert got == {digest(k): min(map(digest, v)) for k, v in group.items()}
    assert len(written) <= 4 * written.count("parents") and not {"degrees", "roots", "labels"} & set(written)


def test_who_is_done_with_a_node_has_no_candidate_outside():
    r = np.random.default_rng(12)
    for tight in (8, 20, 40, 64):
        base = r.integers(0, 10**6, neardup.SIGNATURE)
        sigs = np.stack([np.where(r.random(neardup.SIGNATURE) < r.integers(0, tight + 1) / 64, r.integers(0, 10**6, neardup.SIGNATURE), base) for _ in range(200)])
        differ = (sigs != base).sum(axis=1)
        join, done = neardup.cut(*np.unique(differ, return_counts=True))
        assert join >= neardup.REACH and done <= join
        inside, outside = sigs[differ <= done], sigs[differ > join]
        assert not ((inside[:, None] == outside[None]).sum(axis=2) >= neardup.AGREE).any()


def test_pairs_in_a_large_node_of_unlike_documents(spark):
    """Two thousand documents of the same passages in other mixtures, and pairs of a similarity of 0.8 to 0.85 among them: all are found."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(5))
    passages = [[word() for _ in range(18)] for _ in range(24)]
    rows = []
    for i in range(2000):
        w = [x for p in r.sample(passages, 8) for x in p] + [word() for _ in range(70)]
        rows.append((i, " ".join(w), None, None, 0))
        if i % 20 == 0:
            at = r.randrange(100, len(w) - 30)
            size = next(n for n in range(30) if (a := len(w) - 3 - n - 3) / (len(w) - 3 + n + 3) <= 0.84)
            rows.append((5000 + i, " ".join([*w[:at], *[word() for _ in range(size)], *w[at + size :]]), None, None, 0))
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, t, *_ in rows for w in [t.split()]}
    share = [len(sets[i] & sets[5000 + i]) / len(sets[i] | sets[5000 + i]) for i in range(0, 2000, 20)]
    assert 0.8 <= min(share) and max(share) < 0.86
    out = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), shingle=4).collect()}
    assert all(out[5000 + i] == i for i in range(0, 2000, 20)) and all(out[i] == i for i in range(2000))


# --- substrings


def without_repeats(rows, n):
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((r[0], len(t), bytes(c for c, g in zip(t, gone, strict=True) if not g), len(re.findall(b"\1+", bytes(gone)))))
    return counted(out)


def test_substrings(docs, empty):
    out = substrings.remove_repeats(docs).collect()
    assert counted((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in out) == without_repeats(corpus(), 200)
    assert all(r.text == bytes(r.kept).decode("utf-8", "ignore") for r in out)
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_of_a_prime_length(spark, monkeypatch):
    """37 bytes: symbols of one byte."""
    monkeypatch.setattr(substrings, "GRAM", 8)
    r = random.Random(13)
    part = ["".join(r.choice("ab") for _ in range(40)) for _ in range(4)]
    rows = [(i, "".join(r.choice([r.choice(part), r.choice("abé")]) for _ in range(r.randrange(12))), None, None, 0) for i in range(40)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), min_length=37).collect()
    assert counted((x.doc_id, x.n_bytes, bytes(x.kept), len(x.spans)) for x in out) == without_repeats(rows, 37)


@pytest.mark.parametrize("hot", [8192, 2])
def test_substrings_of_small_alphabets(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "GRAM", 8)
    r = random.Random(11)
    part = ["".join(r.choice("ab") for _ in range(30)) for _ in range(6)]
    rows = [(i, "".join(r.choice([r.choice(part), r.choice("abé")]) for _ in range(r.randrange(25))), None, None, 0) for i in range(60)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), min_length=24).collect()
    assert counted((x.doc_id, x.n_bytes, bytes(x.kept), len(x.spans)) for x in out) == without_repeats(rows, 24)


def test_common_prefixes_come_from_the_expansion_alone():
    """The order names no two suffixes equal; what neighbours share is only what the expansion says."""
    r = np.random.default_rng(2)
    for q, levels in ((1, 4), (2, 3), (3, 5)):
        raw = r.integers(0, 2, 300)
        ends = [100, 101, 180, 300]
        own = {}
        first = []
        for i in range(300):
            end = next(e for e in ends if i < e)
            symbol = tuple(raw[i : i + q]) if i + q < end else ("end", i)
            first.append(own.setdefault(symbol, len(own)))
        first = np.array(first)
        rank = substrings.suffix_ranks(first, q)
        assert sorted(rank.tolist()) == list(range(300))
        order = np.argsort(rank)

        def read(i, first=first, q=q):
            return first[i::q].tolist()

        suffixes = [read(i) for i in order]
        assert all(a < b for a, b in zip(suffixes[:-1], suffixes[1:], strict=True))
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want = [0] + [min(shared(a, b), levels) for a, b in zip(suffixes[:-1], suffixes[1:], strict=True)]
        assert substrings.common_prefixes(order, rank, first, q, levels).tolist() == want


def test_the_transform_weighs_equal_contexts():
    """A context that stands for several places goes in once: its strings repeat, and so do those of others that equal them."""
    r = np.random.default_rng(7)
    raw = r.choice([97, 98], 600).astype(np.uint8).tobytes()
    for length in (12, 11, 4):
        cuts = list(zip(r.integers(0, 500, 80).tolist(), r.integers(1, 60, 80).tolist(), strict=True))
        contexts = [bytes([100 + i]) + raw[b : b + n + length - 2] if i % 3 == 0 else raw[b : b + n + length - 1] for i, (b, n) in enumerate(cuts)]
        sizes, weights = np.array([n for _, n in cuts]), r.integers(1, 4, len(cuts))
        twice, leaders, _, _ = substrings.repeats(contexts, sizes, weights, length)
        seen = collections.Counter()
        for c, n, w in zip(contexts, sizes.tolist(), weights.tolist(), strict=True):
            for i in range(n):
                seen[c[i : i + length]] += w
        assert [x.tolist() for x in twice] == [[i for i in range(n) if seen[c[i : i + length]] > 1] for c, n in zip(contexts, sizes.tolist(), strict=True)]
        assert sorted(c[i : i + length] for c, own in zip(contexts, leaders, strict=True) for i in own.tolist()) == sorted(seen)


def test_an_order_as_far_as_the_expansion_goes():
    """Suffixes that share all levels follow one another; those before and after them are smaller and greater."""
    r = np.random.default_rng(3)
    for levels in (1, 2, 4, 8):
        first = np.concatenate([np.append(np.tile(r.integers(0, 2, 9), 12), 100 + i) for i in range(3)])
        rank = substrings.suffix_ranks(first, 1, levels)
        assert sorted(rank.tolist()) == list(range(len(first)))
        read = [first[i : i + levels].tolist() for i in np.argsort(rank)]
        assert read == sorted(read)


def test_copies_and_a_common_passage(spark):
    """Many equal texts, one passage in all others, texts without ids: heavy keys and blocks of one anchor."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, copy = " ".join(word() for _ in range(40)), " ".join(word() for _ in range(60))
    rows = [(i, f"{' '.join(word() for _ in range(r.randrange(30)))} {passage} {' '.join(word() for _ in range(r.randrange(30)))}", None, None, 0) for i in range(80)]
    rows += [(None if i % 3 else 1000 + i, copy, None, None, 0) for i in range(60)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert counted((x.doc_id, x.n_bytes, bytes(x.kept), len(x.spans)) for x in out) == without_repeats(rows, 200)


# --- licenses, quality, sharding


def test_licenses(spark, docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).where("doc_id = 21").collect()}
    assert [(s.label, s.first) for s in got[21].spans if s.exact] == [("gpl", 4), ("mit", 0), ("mit", 2)]
    assert licenses.scan(docs).count() == len(corpus()) and licenses.scan(empty).count() == 0
    near = "x y licensed under the the apache license version 2 0 z"
    spans = licenses.scan(spark.createDataFrame([(1, near)], "doc_id int, text string")).first().spans
    assert {s.label for s in spans} == {"apache", "apache-2.0"} and min(s.agree for s in spans) >= licenses.AGREE


def license_spans(text):
    """Base places, and the notices of which seven tenths stand in runs of three words, in bands of diagonals of twice the notice's length: by word lists alone."""
    w, found = words_of(text), []
    for phrase, label in licenses.PHRASES:
        x = phrase.split()
        found += [(label, True, i, i + len(x) - 1, 1.0) for i in range(len(w)) if w[i : i + len(x)] == x]
    for notice, label in licenses.NOTICES:
        x = notice.split()
        met = [(q, p) for q in range(len(x) - 2) for p in range(len(w) - 2) if w[p : p + 3] == x[q : q + 3]]
        spans = []
        for begin in range(-2 * len(x), len(w) + len(x), 1):
            if begin % len(x):
                continue
            g = [(q, p) for q, p in met if begin <= p - q < begin + 2 * len(x)]
            share = len({q + j for q, _ in g for j in range(3)}) / len(x)
            if share >= 0.7:
                first, last = min(p for _, p in g), max(p for _, p in g) + 2
                if spans and spans[-1][0] == begin - len(x):
                    _, a, b, best = spans.pop()
                    first, last, share = min(a, first), max(b, last), max(best, share)
                spans.append((begin, first, last, share))
        found += [(label, False, a, b, math.floor(share * 10000 + 0.5) / 10000) for _, a, b, share in spans]  # halves go up, as in SQL
    return sorted(found)


def test_licenses_with_insertions(spark):
    """Words put into a text, in one place or in many, and a clause more, take no label away; a third of the text taken out does, and so do foreign words for twice its length in one place."""
    text = dict((label, notice.split()) for notice, label in licenses.NOTICES)
    mit, bsd, third = text["mit-text"], text["bsd-2-clause-text"], text["bsd-third-clause"]
    rows = {
        1: mit[:80] + ["three", "more", "words"] + mit[80:],
        2: [y for i, x in enumerate(mit) for y in ([x, "inserted"] if i % 12 == 11 else [x])],
        3: bsd[:70] + third + bsd[70:],
        4: mit[:80] + [f"x{i}" for i in range(len(mit) - 1)] + mit[80:],
        5: mit[: len(mit) * 2 // 3 - 2],
        6: mit[:80] + [f"x{i}" for i in range(2 * len(mit))] + mit[80:],
    }
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id int, text string")
    got = {x.doc_id: {s.label: s for s in x.spans} for x in licenses.scan(df).collect()}
    assert all("mit-text" in got[i] for i in (1, 2, 4)) and {"bsd-2-clause-text", "bsd-third-clause"} <= set(got[3])
    assert "mit-text" not in got[5] and "mit-text" not in got[6]
    assert (got[4]["mit-text"].first, got[4]["mit-text"].last, got[4]["mit-text"].agree) == (0, len(rows[4]) - 1, 1.0)


def test_licenses_by_brute_force(spark):
    r = random.Random(17)
    rows = [None, "", "any person " * 10, "of this software " * 30, "the software is provided as is " * 8, "mit license " * 5]
    for notice, _ in licenses.NOTICES:
        w = notice.split()
        for changes in (0, 1, 3, len(w) // 6, len(w) // 3):
            x = list(w)
            for _ in range(changes):
                i = r.randrange(len(x))
                x[i : i + 1] = r.choice([[], ["changed"], [x[i], "more"], [x[i], "one", "two"]]) if len(x) > 4 else ["y"]
            rows.append(f"Some Words. {' '.join(x).title()} and {r.choice(['CC-BY', 'the GNU General Public License', ''])} end")
    rows.append(" ".join(n for n, _ in licenses.NOTICES) * 2)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {x.doc_id: sorted((s.label, s.exact, s.first, s.last, s.agree) for s in x.spans) for x in licenses.scan(df).collect()}
    assert got == {i: license_spans(t) for i, t in enumerate(rows)}
    assert got[2] == [] and all(s[2] >= 0 for v in got.values() for s in v)
    assert {"mit-text", "bsd-2-clause-text", "zlib-text", "isc-text"} <= {s[0] for s in got[len(rows) - 1]}


def figures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, empty):
    out = quality.judge(docs, keep=("text", "lang", "key")).collect()
    got = counted((r.doc_id, r.text, r.lang, r.key, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    want = []
    for r in corpus():
        f = figures(r[1])
        want.append((r[0], r[1], r[2], 7, *f, f[0] < 20 or 100 * f[4] > 30 * f[0]))
    assert got == counted(want) and quality.judge(empty).count() == 0


def test_bad_hosts_are_rejected(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "bad" if i < 60 else f"h{i % 5}", "short" if 1 <= i < 60 or i % 10 == 0 and i > 60 else good) for i in range(300)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id int, source string, text string")).collect()}
    assert out[0].host_rejected and not out[0].kept and not out[0].base_failed
    assert all(out[i].kept for i in range(61, 300) if i % 10)


def test_host_verdicts_through_the_query(spark, tmp_path):
    """Hosts of 1 to 400 documents that fail at 0 to 100 %, one without a name: the query gives the rows of its SQL, and rejects some hosts of either size and no clean one."""
    r = random.Random(23)
    good = lambda: " ".join(f"w{r.randrange(9999)}" for _ in range(40))
    rows = []
    for size in (1, 3, 30, 120, 400):
        for percent in (0, 20, 80, 92, 97, 100):
            host = None if (size, percent) == (120, 97) else f"h{size}-{percent}"
            rows += [(host, "too short" if 100 * (i + 1) <= percent * size else good()) for i in range(size)]
    for host in ("h-bad", "h-clean"):
        rows += [(host, good() if host == "h-clean" else "few words") for _ in range(600)]
    table = {"doc_id": list(range(len(rows))), "text": [t for _, t in rows], "source": [h for h, _ in rows]}
    pq.write_table(pa.table(table), tmp_path / "documents.parquet")
    against_sql(spark, queries.op8_quality_rules, oracle.OP8, str(tmp_path))
    out = {x.doc_id: x for x in queries.op8_quality_rules(spark, str(tmp_path)).collect()}
    lost = {h for i, (h, _) in enumerate(rows) if not out[i].kept and not out[i].base_failed}
    assert lost == {"h30-97", "h120-92", None, "h400-92", "h400-97"}  # 29 of 30, and 110 of 120, shrunk towards two in three by two documents; not 27 of 30
    assert all(out[i].kept for i, (h, t) in enumerate(rows) if h == "h-clean")


def test_sharding(docs, empty):
    out = sharding.assign(docs, shards=5, keep=("key",)).collect()
    assert len(out) == len(corpus()) and all(r.key == 7 for r in out)
    sizes = collections.Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(n))
    place = [r.curve for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert place == sorted(place)
    assert counted((r.doc_id, r.text) for r in out) == counted((r[0], r[1]) for r in corpus())
    assert sharding.assign(empty).count() == 0
    few = sharding.assign(docs.limit(3), shards=5).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    spans = {(r.shard, r.dimension): (r.least, r.greatest) for r in sharding.manifest(sharding.assign(docs, shards=5)).collect()}
    assert all(spans[r.shard, d][0] <= c <= spans[r.shard, d][1] for r in out for d, c in enumerate(r.codes))


def test_sharding_query_and_files(spark, tmp_path, monkeypatch):
    rows = {x.doc_id: (x.text or "").encode() for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op10_hilbert_sharding(spark, SF).collect()
    assert {x.doc_id: (x.size, x.text_crc32) for x in out} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in rows.items()}
    assert {(x.law, x.grown_shard) for x in out} == {("rows", None)} and len(out) == len(rows)
    slots = collections.defaultdict(list)
    for x in out:
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(40))
    assert {len(v) for v in slots.values()} <= {len(rows) // 40, -(-len(rows) // 40)}
    monkeypatch.setattr(sharding, "FILE_ROWS", 30)
    assigned = sharding.assign(spark.read.parquet(f"{SF}/documents.parquet"), shards=2)
    sharding.write_shards(assigned, str(tmp_path / "shards"))
    for shard in range(2):
        files = sorted((tmp_path / "shards" / f"shard={shard}").glob("*.parquet"))
        read = [pq.read_table(f, partitioning=None).column("slot").to_pylist() for f in files]
        assert len(files) >= 4 and all(x == sorted(x) and len(x) <= 30 for x in read) and sorted(y for x in read for y in x) == list(range(len(rows) // 2))


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (3, 4)])
def test_hilbert_steps_to_neighbours(dimensions, bits):
    path = np.argsort(sharding.curve(dimensions, bits))
    cells = np.stack([path >> bits * (dimensions - 1 - d) & ((1 << bits) - 1) for d in range(dimensions)], axis=1)
    assert sorted(path.tolist()) == list(range(1 << dimensions * bits)) and (np.abs(np.diff(cells, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_sql(spark, name):
    against_sql(spark, queries.queries()[name], oracle.oracle_sql()[name], SF)


def test_token_queries_on_a_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op9_token_binary(spark, SF).collect()}
    start = 0
    for r in rows:
        ids = np.array(ids_of(r.text, 2), "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    removed = counted((r.doc_id, r.n_bytes, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, SF).collect())
    assert removed == counted((a, b, hashlib.sha256(c).hexdigest()) for a, b, c, _ in without_repeats([(r.doc_id, r.text) for r in rows], 200).elements())

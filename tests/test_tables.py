"""Tables that change, the release source, sessions of edits, localized order."""

import http.server
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from quire.functions import naming as N
from quire.operators import ordinals, sessions
from quire.sources import growing, release


def test_library_in_any_order(spark, tmp_path):
    rng, have, n = random.Random(1), {}, 0
    library = growing.Library(spark, str(tmp_path / "library"))
    assert library.list().count() == 0
    for op in ("delete", "save", "save", "delete", "save", "compact", "delete", "save", "delete", "compact"):
        if op == "save":
            rows = [(bytes([n + i]), None if (n + i) % 5 == 4 else float(rng.randrange(4))) for i in range(3)]
            df = spark.createDataFrame([*rows, (None, 1.0)], "content binary, at double").select("content", F.col("at").cast("timestamp").alias("saved_at"))
            saved = library.save(df).select("key", "saved_at", "content").collect()
            assert len(saved) == 3 and saved == library.entries.read().where(F.col("key").isin([r.key for r in saved])).collect()
            have |= {r.key: (r.saved_at, bytes(r.content)) for r in saved}
            n += 3
        elif op == "delete":
            gone = rng.sample(sorted(have), min(2, len(have))) + ["nobody"]
            library.delete(spark.createDataFrame([(k,) for k in [*gone, gone[0], None]], "key string"))
            have = {k: v for k, v in have.items() if k not in gone}
        else:
            library.compact()
            assert library.entries.read().count() == len(have) and library.deleted.read().count() == 0
        listed = library.list().orderBy("rank").collect()
        want = sorted(have, key=lambda k: (-have[k][0].timestamp() if have[k][0] else 1, k))
        assert [r.key for r in listed] == want and [r.rank for r in listed] == list(range(len(want)))
        assert all((r.saved_at, bytes(r.content)) == have[r.key] for r in listed)


def test_a_batch_without_its_mark_does_not_count(spark, tmp_path):
    table = growing.GrowingTable(spark, str(tmp_path / "t"), "x int")
    table.append(spark.createDataFrame([(1,)], "x int"))
    spark.createDataFrame([(2,)], "x int").write.parquet(str(tmp_path / "t/gen=7/batch=half"))
    (tmp_path / "t/gen=7/batch=half/_SUCCESS").unlink()
    assert [r.x for r in table.read().collect()] == [1]


def test_thumbnails_are_made_once(spark, tmp_path):
    cache, made = growing.Thumbnails(spark, str(tmp_path / "thumbs")), spark.sparkContext.accumulator(0)

    def make(pages):
        def draw(batches):
            for frame in batches:
                made.add(len(frame))
                yield frame.assign(thumbnail=[f"{u}@{r}".encode() for u, r in zip(frame.page_uid, frame.rotation, strict=True)])

        return pages.mapInPandas(draw, "page_uid string, rotation int, thumbnail binary")

    pages = spark.createDataFrame([("a", 0), ("b", 0), ("b", 0), ("c", 90)], "page_uid string, rotation int")
    assert sorted(bytes(r.thumbnail) for r in cache.of(pages, make).collect()) == [b"a@0", b"b@0", b"b@0", b"c@90"] and made.value == 3
    cache.of(pages, make).collect()
    assert made.value == 3
    turned = pages.withColumn("rotation", F.when(F.col("page_uid") == "a", 90).otherwise(F.col("rotation")))
    assert sorted(bytes(r.thumbnail) for r in cache.of(turned, make).collect())[0] == b"a@90" and made.value == 4
    cache.evict(turned)
    assert sorted((r.page_uid, r.rotation) for r in cache.table.read().collect()) == [("a", 90), ("b", 0), ("c", 90)]


@pytest.fixture
def service():
    answers = {"/new": {"tag_name": "v2.1", "html_url": "https://x.org/r"}, "/old": {"tag_name": "v1.0", "html_url": "https://x.org/r"}, "/number": {"tag_name": 5, "html_url": "https://x.org/r"}, "/none": {"tag_name": "v9"}, "/list": []}

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            known = self.path in answers and self.headers["Accept"] == "application/json"
            body = json.dumps(answers[self.path]).encode() if known else b"{"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_releases(spark, service, tmp_path):
    got = {p: tuple(release.news(release.releases(spark, service + p, timeout="2"), F.lit("1.3")).first()) for p in ("/new", "/old", "/number", "/none", "/list", "/broken")}
    assert got == {"/new": ("v2.1", "https://x.org/r")} | {p: (None, None) for p in ("/old", "/number", "/none", "/list", "/broken")}
    assert release.news(release.releases(spark, service + "/old")).first().version == "v1.0"  # no version of one's own: 0
    assert tuple(release.releases(spark, "http://127.0.0.1:9/none").first()) == (None, None)
    polled = release.releases(spark, service + "/new", stream=True)
    query = release.news(polled, F.lit("1.3")).writeStream.format("memory").queryName("news_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.awaitTermination(12)
        assert spark.table("news_out").where("version = 'v2.1'").count() >= 1
    finally:
        query.stop()


def test_sessions_by_brute_force(spark):
    rng = random.Random(5)
    ops = ["file", "add", "add_all", "drag_source", "drop_source", "drag_tray", "drop_tray", "rotate", "remove", "other", None]
    log = [(rng.choice([1, 2, None]), i, rng.choice(ops), rng.choice([None, [rng.randrange(9) for _ in range(3)], [-1, None, 2, 2]]), rng.choice([None, -2, 0, 1, 4, 99]), rng.choice([None, 0, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(log, "doc int, i int, op string, sel array<int>, target int, n int")
    got = {}
    for r in sessions.edited(df, "doc", ["i"]).orderBy("page_ord").collect():
        got.setdefault(r.doc, []).append((r.page_ord, r.source_ord, r.rotation))
    for doc in (1, 2, None):
        source, tray, held = [], [], {}
        for _, i, op, sel, target, n in (e for e in log if e[0] == doc):
            there = lambda pages, at: [pages[j] for j in range(len(pages)) if at and j in at]
            kept = lambda at: [p for j, p in enumerate(tray) if not at or j not in at]  # noqa: B023, E731
            if op == "file":
                source += range(len(source), len(source) + (n or 0))
            elif op == "add" or op == "add_all":
                tray = tray + [(p, 0) for p in (there(source, sel) if op == "add" else source)]
            elif op in ("drag_source", "drag_tray"):
                held[op] = sel
            elif op == "drop_source":
                t = max(0, min(target or 0, len(tray)))
                tray = tray[:t] + [(p, 0) for p in there(source, held.pop("drag_source", None))] + tray[t:]
            elif op == "drop_tray":
                at = held.pop("drag_tray", None)
                rest, moving, t = kept(at), there(tray, at), target or 0
                t = max(0, min(t - len([j for j in range(len(tray)) if at and j in at and j < t]), len(rest)))
                tray = rest[:t] + moving + rest[t:]
            elif op == "rotate":
                tray = [(p, (r + 90) % 360) if sel and j in sel else (p, r) for j, (p, r) in enumerate(tray)]
            elif op == "remove":
                tray = kept(sel)
        assert got.get(doc, []) == [(j, p, r) for j, (p, r) in enumerate(tray)]


def test_localized_natural_order(spark):
    names = ["Zoe 2.jpg", "äpfel 10.jpg", "Apfel 9.jpg", "apfel 10.jpg", "éclair.png", "Eclair 1.png", "zoe 10.jpg", "Öl.jpg", "Oz.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = ordinals.global_ordinal(df.withColumn("_k", N.natural_key(F.col("name"), "UNICODE_CI")), "at", "_k", "name").orderBy("at").collect()
    assert [r.name for r in got] == ["Apfel 9.jpg", "apfel 10.jpg", "äpfel 10.jpg", "Eclair 1.png", "éclair.png", "Öl.jpg", "Oz.jpg", "Zoe 2.jpg", "zoe 10.jpg"]

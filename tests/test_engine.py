"""Sequences, stamps, gestures, files and images."""

import random
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import gestures, ordinals, sequence, sessions, stamps
from quire.sources import files, images

CASES = [([0, 1, 2, 3, 4, 5], [0, 2], 4), ([], [], 0), ([7], [0], 5), ([1, 2, 3], [0, 1, 2], 1), ([1, 2, 3], [2], -4), ([1, 2, 3], [0], 99), ([1, 2, 3, 4], [1, 3, 9], 2), ([1, 2], [], 1)]


def moved(pages, chosen, at):
    chosen = sorted({i for i in chosen if 0 <= i < len(pages)})
    rest = [p for i, p in enumerate(pages) if i not in chosen]
    t = min(max(at - sum(i < at for i in chosen), 0), len(rest))
    return rest[:t] + [pages[i] for i in chosen] + rest[t:]


def test_edits(spark):
    df = spark.createDataFrame(CASES, "p array<int>, s array<int>, t int")
    p, s, t = F.col("p"), F.col("s"), F.col("t")
    for row in df.select("p", "s", "t", sequence.moved(p, s, t).alias("m"), sequence.removed(p, s).alias("r"), sequence.indexed(p, s).alias("x"), sequence.inserted(p, F.array(F.lit(8)), t).alias("i")).collect():
        assert row.m == moved(row.p, row.s, row.t)
        assert row.r == [x for i, x in enumerate(row.p) if i not in row.s]
        assert row.x == [row.p[i] for i in sorted(row.s) if i < len(row.p)]
        at = min(max(row.t, 0), len(row.p))
        assert row.i == [*row.p[:at], 8, *row.p[at:]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 99), max_size=6), st.lists(st.integers(0, 6), max_size=4), st.integers(-2, 9)), min_size=1, max_size=20))
def test_moves_are_permutations(spark, rows):
    df = spark.createDataFrame(rows, "p array<int>, s array<int>, t int")
    for row in df.select("p", "s", "t", sequence.moved(F.col("p"), F.col("s"), F.col("t")).alias("m")).collect():
        assert row.m == moved(row.p, row.s, row.t) and sorted(row.m) == sorted(row.p)


def test_four_turns_are_none(spark):
    pages = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(90 * i).alias("rotation")) for i in range(3)])
    four = pages
    for _ in range(4):
        four = F.transform(four, lambda x: x)
        four = sequence.turned(four, F.array(F.lit(1)))
    row = spark.range(1).select(pages.alias("a"), four.alias("b")).first()
    assert row.a == row.b


def test_ordinals_are_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ordinals.global_ordinal(df, "n", "k").collect()
    assert len(got) == 1000 and all(r.k == r.n for r in got)


def test_flatten_keeps_bare_pages(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page int")
    drawn = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "page int, z int, image string")
    got = {r.page: r.stamps for r in stamps.flattened(pages, drawn, ["page"], ["z"], F.col("image")).collect()}
    assert got == {1: ["a", "b"], 2: []}


def test_nearest_page(spark):
    pages = spark.createDataFrame([("a", 0.0, 10.0, 0), ("a", 12.0, 8.0, 1), ("a", 30.0, 1.0, 2), ("b", 0.0, 1.0, 0), ("a", None, 1.0, 9)], "doc string, y double, h double, page int")
    at = [-5.0, 0.0, 9.5, 10.0, 11.0, 11.5, 12.0, 25.0, 25.5, 99.0]
    points = spark.createDataFrame([("a", y, "x") for y in at] + [("c", 1.0, None), ("a", None, None), (None, 1.0, None)], "doc string, y double, page string")
    got = stamps.nearest_page(points.withColumnRenamed("y", "py"), pages, "doc", F.col("py"), F.col("y"), F.col("h"), "page").collect()
    assert len(got) == len(at) + 3 and {r.py: (r.nearest, r.distance) for r in got if r.doc == "a"} == {
        -5.0: (0, 5.0), 0.0: (0, 0.0), 9.5: (0, 0.0), 10.0: (0, 0.0), 11.0: (0, 1.0), 11.5: (1, 0.5), 12.0: (1, 0.0), 25.0: (1, 5.0), 25.5: (2, 4.5), 99.0: (2, 68.0), None: (None, None),
    }
    assert all(r.nearest is None for r in got if r.doc != "a")


def test_selection_by_brute_force(spark):
    rng = random.Random(11)
    log = [(rng.choice(["d", "e", None]), i, rng.choice(["add", "add", "click", "remove", "scroll", None]), rng.choice([None, *range(12)]), rng.choice([None, 0, 1, 2])) for i in range(600)]
    df = spark.createDataFrame(log, "doc string, i int, action string, stamp int, page int")
    got = {r.i: (r.selected, r.removed, r.n_live) for r in sessions.selection(df, "doc", ["i"], "action", "stamp", "page").collect()}
    for doc in ("d", "e", None):
        pages, selected = {}, None  # page: stamps, oldest first
        last = lambda: next((pages[p][-1] for p in sorted(pages, reverse=True) if pages[p]), None)  # noqa: B023, E731
        for _, i, action, stamp, page in (e for e in log if e[0] == doc):
            gone, alive = None, [s for own in pages.values() for s in own]
            if action == "add" and stamp is not None:
                for own in pages.values():
                    own[:] = [s for s in own if s != stamp]
                pages.setdefault(page or 0, []).append(stamp)
                selected = stamp
            elif action == "click" and stamp in alive:
                selected = stamp
            elif action == "remove":
                gone = last() if selected is None else selected
                for own in pages.values():
                    own[:] = [s for s in own if s != gone]
                selected = last()
            assert got[i] == (selected, gone, sum(map(len, pages.values())))


def test_drags_meet_boxes_where_they_are(spark):
    placed = [("d", 0, "place", "low", 0, 0.0, 0.0, 10.0, 10.0), ("d", 1, "place", "top", 0, 5.0, 5.0, 10.0, 10.0), ("d", 2, "place", "far", 1, 0.0, 0.0, 10.0, 10.0)]
    moves = [("drag", 6, 6), ("down", 6, 6), ("drag", 26, 6), ("up", 0, 0), ("down", 6, 6), ("drag", 7, 8), ("down", 99, 99), ("drag", 8, 8), ("up", 0, 0), ("down", 10, 11), ("drag", None, 1), ("down", 26, 6), ("up", 0, 0), ("up", 0, 0)]
    log = placed + [("d", 3 + i, phase, None, 0, None if x is None else float(x), float(y), None, None) for i, (phase, x, y) in enumerate(moves)]
    df = spark.createDataFrame(log, "doc string, i int, phase string, stamp string, page int, x double, y double, w double, h double")
    got = [(r.held, r.at_x, r.at_y) for r in sessions.drags(df, "doc", ["i"], "phase", "stamp", "page").where("i > 2").orderBy("i").collect()]
    assert got == [
        (None, None, None), ("top", 5, 5), ("top", 25, 5), ("top", 25, 5), ("low", 0, 0), ("low", 1, 2), (None, None, None), ("low", 2, 2), ("low", 2, 2), ("low", 2, 2), ("top", 25, 5), ("top", 25, 5), (None, None, None),
    ]


def test_put_on_top(spark):
    kind = "page int, z int, image string"
    got = stamps.put_on_top(spark.createDataFrame([(1, 4, "a")], kind), spark.createDataFrame([(1, 0, "b"), (2, 0, "c")], kind), ["page"]).collect()
    assert {(r.page, r.z) for r in got} == {(1, 4), (1, 5), (2, 0)}


def fold_strokes(events):
    """(surface, i) of the points of finished strokes and (surface, epoch, n) of strokes, read one event after the other."""
    out, strokes = {}, []
    for surface in {e[0] for e in events}:
        held, current, epoch, begun = None, [], 0, 0
        for _, i, phase, touch in sorted(e for e in events if e[0] == surface):
            if phase == "began":
                held, current, begun = (touch,), [i], begun + 1
            elif phase == "moved" and held == (touch,):
                current.append(i)
            elif phase in ("ended", "cancelled", "discard"):
                if len(current) > 1 and phase != "discard":
                    strokes.append((surface, begun, epoch, len(current)))
                    out |= {(surface, j): begun for j in current}
                held, current = None, []
            elif phase == "clear":
                epoch, current = epoch + 1, []
    return out, strokes


def pointer_events(n, seed):
    rng = random.Random(seed)
    phases = ["began", "began", *["moved"] * 9, "ended", "cancelled", "discard", "clear"]
    return [(rng.choice("ab"), i, rng.choice(phases), rng.choice(["l", "r"])) for i in range(n)]


def marked_strokes(df):
    p = F.col("phase")
    return gestures.strokes(df, "surface", ["i"], p == "began", p.isin("ended", "cancelled"), moves=p == "moved", touch=F.col("touch"), discards=p == "discard", clears=p == "clear")


@pytest.mark.parametrize("seed", [1, 2])
def test_strokes(spark, seed):
    events = pointer_events(400, seed)
    got = marked_strokes(spark.createDataFrame(events, "surface string, i long, phase string, touch string")).collect()
    points, strokes = fold_strokes(events)
    assert {(r.surface, r.i): r.stroke for r in got if r.stroke is not None} == points
    assert {(r.surface, r.stroke, r.epoch) for r in got if r.stroke is not None} == {s[:3] for s in strokes}


def test_strokes_need_an_end_and_two_points(spark):
    phases = ["began", "ended", "began", "moved", "began", "moved", "moved", "ended", "moved"]
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate(phases)], "surface string, i int, phase string")
    p = F.col("phase")
    got = gestures.strokes(df, "surface", ["i"], p == "began", p == "ended").orderBy("i").collect()
    assert [r.stroke for r in got] == [None] * 4 + [3, 3, 3, None, None] and "epoch" not in got[0].asDict()


def test_ink_of_surfaces(spark):
    rows = [("a", 0, "began"), ("a", 1, "moved"), ("a", 5, "ended"), ("a", 3, "moved"), ("b", 0, "began"), ("b", 2, "moved"), ("b", 4, "ended"), ("b", 9, "clear"), ("c", 0, "moved")]
    df = spark.createDataFrame([(*r, None) for r in rows], "surface string, i long, phase string, touch string")
    got = {r.surface: (r.n_strokes, r.x0, r.x1) for r in gestures.ink(marked_strokes(df), "surface", F.col("i"), F.col("i")).collect()}
    assert got == {"a": (1, 0, 3), "b": (0, None, None), "c": (0, None, None)}


def test_anchored_batches(spark):
    times = [0, 5, 9, 10, 12, 19, 20, 35]
    df = spark.createDataFrame([("k", t) for t in times], "k string, t long")
    got = sorted((r.anchor, r.n) for r in gestures.anchored_batches(df, "k", F.col("t"), 10).collect())
    assert got == [(0, 3), (10, 3), (20, 1), (35, 1)]
    rng = random.Random(4)
    events = [(rng.choice(["a", "a", None]), rng.choice([None, rng.randrange(3000)])) for _ in range(900)]
    want = {}
    for key in ("a", None):
        anchor = None
        for t in sorted(t for k, t in events if k == key and t is not None):
            anchor = t if anchor is None or t >= anchor + 7 else anchor
            want[key, anchor] = want.get((key, anchor), 0) + 1
    df = spark.createDataFrame(events, "k string, t long")
    assert {(r.k, r.anchor): r.n for r in gestures.anchored_batches(df, "k", F.col("t"), 7).collect()} == want
    assert gestures.anchored_batches(df.limit(0), "k", F.col("t"), 7).count() == 0


def test_anchored_batches_over_pieces(spark, monkeypatch):
    """Pieces of few moments: keys go through many of them, delays over several, and each moment is read once."""
    monkeypatch.setattr(gestures, "PIECE", 3)
    rng = random.Random(3)
    events = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(400)) for _ in range(300)] + [(f"k{i}", i) for i in range(20)]
    for delay in (9, 150):
        want = {}
        for key in {k for k, _ in events}:
            anchor = None
            for t in sorted(t for k, t in events if k == key):
                anchor = t if anchor is None or t >= anchor + delay else anchor
                want[key, anchor] = want.get((key, anchor), 0) + 1
        df = spark.createDataFrame(events, "k string, t long")
        assert {(r.k, r.anchor): r.n for r in gestures.anchored_batches(df, "k", F.col("t"), delay).collect()} == want


def test_anchored_batches_of_few_keys_take_few_jobs(spark):
    """Jobs do not grow with the batches of a key, only with the pieces it lies in."""
    jobs = lambda: spark.sparkContext.statusTracker().getJobIdsForGroup("anchored")
    df = spark.range(0, 40000).select((F.col("id") % 40).alias("k"), F.col("id").alias("t"))
    spark.sparkContext.setJobGroup("anchored", "anchored")
    assert gestures.anchored_batches(df, "k", F.col("t"), 80).count() == 20000
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs()) < 40


def test_routes(spark):
    rows = [(1, "a.pdf"), (2, "a.pdf"), (2, "b.png"), (3, "a.pdf"), (3, "b.PDF"), (4, "x.jpg"), (5, "x.txt")]
    df = spark.createDataFrame(rows, "b int, path string")
    got = {r.b: r.route for r in files.route(df, "b", files.is_pdf(F.col("path")), files.is_image(F.col("path"))).collect()}
    assert got == {1: "sign", 2: "organize", 3: "organize", 4: "combine", 5: "home"}


def png(w, h, value=200):
    raw = b"".join(b"\0" + bytes([value, 0, 0]) * w for _ in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.png", png(8, 4)), ("b.PNG", png(2000, 10)), ("c.jpg", b"no image")):
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def test_scan_and_library(spark, folder):
    found = files.scan(spark, str(folder / "in"))
    assert {r.name: r.kind for r in found.select("name", files.content_kind(F.col("content")).alias("kind")).collect()} == {"a.png": "png", "b.PNG": "png", "c.jpg": None}
    assert [r.name for r in files.library(files.scan(spark, str(folder / "in"), content=False)).collect()] == ["a.png"]
    paths = files.from_paths(spark, ["x/none.png", "y/a.pdf"])
    assert files.accepted(paths).count() == 2


def test_images_to_pdf(spark, folder):
    read = images.read_images(spark, str(folder / "in")).withColumn("doc", F.lit(1)).withColumn("ord", F.col("path"))
    assert read.where("width is null").count() == 1
    made = images.combined(read, "doc", "ord")
    row = made.first()
    assert row.n_pages == 2 and images.pdf_pages(bytes(row.content)) == [(8, 4), (1600, 8)]
    written = images.write_documents(made.withColumn("name", F.lit("out.pdf")), f"file://{folder}/out", "name").collect()
    assert (folder / "out" / "out.pdf").stat().st_size == written[0].length and [p.name for p in (folder / "out").iterdir() if not p.name.startswith(".")] == ["out.pdf"]


def test_files_become_pages(spark, tmp_path):
    """From a folder to pages in the order that was chosen: a PDF all of its pages, an image one, others and broken ones none."""
    rgb = bytes(3 * 2 * 2)
    kinds = {"b2.PDF": images.pdf_document([(2, 2, rgb)] * 3), "b10.png": bytes.fromhex("89504E470D0A1A0A") + b"/Type /Page", "a.txt": b"/Type /Page", "c.pdf": b"", "d.pdf": b"%PDF-1.4 << /Type /Pages >>", "e.jpg": bytes.fromhex("FFD8FFE0")}
    for name, content in kinds.items():
        (tmp_path / name).write_bytes(content)
    chosen = files.from_paths(spark, [f"file:{tmp_path}/{n}" for n in ("e.jpg", "c.pdf", "b2.PDF", "a.txt", "b10.png", "d.pdf", "gone.pdf")])
    found = files.scan(spark, f"file://{tmp_path}")
    pages = files.loaded(chosen.select("file_ord", "path").join(found.select("path", "content"), "path"), ["file_ord"])
    assert sorted(tuple(r) for r in pages.select("file_ord", "page_ord", "kind").collect()) == [(0, 0, "jpeg"), (2, 0, "pdf"), (2, 1, "pdf"), (2, 2, "pdf"), (4, 0, "png")]
    # Spark lists no empty files, so what is chosen is held against what was found.
    assert {r["name"] for r in found.collect()} == set(kinds) - {"c.pdf"}
    opened = {r["name"]: (r.pages, r.message is None) for r in files.opened(chosen.join(found.select("path", "content"), "path", "left")).collect()}
    assert opened == {n: (3, True) if n == "b2.PDF" else (None, False) for n in (*kinds, "gone.pdf")}
    assert files.loaded(found.limit(0), ["path"]).count() == 0 and files.opened(spark.createDataFrame([(None,)], "content binary")).first().pages is None


def test_quarantine_and_guard(spark):
    read = spark.createDataFrame([(i, None if i == 4 else i % 3 > 0) for i in range(7)], "id int, ok boolean")
    got = {r.id: (r.status, r.place) for r in files.quarantined(read, F.col("ok"), "id").collect()}
    assert got == {1: ("ok", 0), 2: ("ok", 1), 5: ("ok", 2), 0: ("skipped", 0), 3: ("skipped", 1), 4: ("skipped", 2), 6: ("skipped", 3)}
    assert files.quarantined(read.limit(0), F.col("ok"), "id").count() == 0
    some = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "batch int, path string")
    guarded = files.guarded(spark.createDataFrame([(1,), (2,)], "batch int"), some, "batch").collect()
    assert sorted(tuple(r) for r in guarded) == [(1, 2, "ok"), (2, 0, "empty")]


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a.pdf", b"a"), ("b.pdf", b"b")], "name string, content binary").coalesce(1)
    fails = rows.withColumn("content", F.when(F.col("name") == "b.pdf", F.raise_error(F.lit("no")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        images.write_documents(fails, f"file://{tmp_path}/out", "name")
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()] if (tmp_path / "out").exists() else True
    assert sorted(r.file for r in images.write_documents(rows, f"file://{tmp_path}/out", "name").collect()) == [f"file://{tmp_path}/out/a.pdf", f"file://{tmp_path}/out/b.pdf"]
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a.pdf", "b.pdf"]


def test_orientation_tag():
    tiff = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    body = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\x02"
    assert images.orientation(jpeg) == 6 and images.orientation(jpeg[:12]) is None and images.orientation(b"") is None
    p = np.arange(6).reshape(2, 3, 1)
    assert images.upright(p, 6).shape == (3, 2, 1) and images.upright(p, 6)[0, 0, 0] == 3 and (images.upright(p, 9) == p).all()
    assert images.upright(p, 2)[0, 0, 0] == 2 and images.upright(p, 3)[0, 0, 0] == 5 and images.upright(p, 8)[0, 0, 0] == 2


def test_stroke_stream_equals_batch(spark, tmp_path):
    """Events in any order within the delay, over several batches, give the strokes of the batch operator."""
    from quire.streaming import batches

    events = pointer_events(240, 7)
    kind = "surface string, i long, phase string, touch string"
    # Another surface's late events bring the watermark past all others.
    rows = spark.createDataFrame([*events, ("z", 100_000, "began", "l"), ("z", 200_000, "began", "l")], kind).selectExpr("*", "timestamp_seconds(i + 1000) as at", "i as seq", "i % 17 as x", "i % 13 as y")
    rng = random.Random(3)
    order = sorted(range(240), key=lambda i: i + rng.uniform(0, 20))
    for n, part in enumerate([order[:90], order[90:170], order[170:], [100_000], [200_000]]):
        rows.where(F.col("i").isin(part)).orderBy(F.rand(n)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = batches.stroke_stream(stream, "60 seconds").writeStream.format("memory").queryName("strokes_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = spark.table("strokes_out").collect()
    marked = marked_strokes(rows.where("surface <> 'z'"))
    want = marked.where("stroke is not null").groupBy("surface", "stroke", "epoch").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).collect()
    assert sorted(tuple(r) for r in got if r.stroke is not None) == sorted(tuple(r) for r in want) and len(want) > 5
    assert sum(r.stroke is None for r in got) == sum(e[2] == "clear" for e in events)


def test_anchored_stream(spark, tmp_path):
    from quire.streaming import batches

    source = tmp_path / "in"
    source.mkdir()
    events = spark.readStream.schema("key string, path string").json(str(source))
    query = batches.anchored_stream(events, "key", 250).writeStream.format("memory").queryName("batches_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        (source / "1.json").write_text('{"key": "a", "path": "x"}\n{"key": "a", "path": "y"}\n')
        for _ in range(240):
            assert not query.exception(), query.exception()
            if spark.table("batches_out").count():
                break
            time.sleep(0.5)
        assert [(r.key, sorted(r.paths)) for r in spark.table("batches_out").collect()] == [("a", ["x", "y"])]
    finally:
        query.stop()

"""Names and geometry on edge rows."""

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import naming as N


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_natural_order(spark):
    names = ["", "1a", "7", "007", "9", "10", "10000000000", "a", "a1", "a-1", "b2c", "b12c", "img_2.jpg", "IMG_02.jpg", "IMG_2.png", "IMG_10.jpg"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(reversed(names))], "i int, n string")
    got = [r.n for r in df.orderBy(N.natural_key(F.col("n")), "i").collect()]
    assert got.index("9") < got.index("10") < got.index("10000000000") < got.index("1a") or got.index("1a") < got.index("a")
    assert got.index("img_2.jpg") < got.index("IMG_10.jpg") and got.index("b2c") < got.index("b12c") and got.index("1a") < got.index("a")
    assert got.index("007") < got.index("7")  # equal keys: the input's order
    assert got[0] == ""


def test_versions(spark):
    rows = [("v1.3.2", "1.3.1", True), ("1.3", "1.3.0", False), ("v1.10", "1.9", True), ("1.2.3-dev", "1.2.3", False), ("1..4", "1.3", True), ("2", "10", False), ("", "", False)]
    got = values(spark, rows, "a string, b string, w boolean", N.version_newer(F.col("a"), F.col("b")), "w")
    assert all(x == y for x, y in got)


def test_paths_and_blanks(spark):
    rows = [("/a/b/Photo.JPG",), ("noext",), ("x.tar.gz",), (None,)]
    got = values(spark, rows, "p string", N.extension(F.col("p")), N.base_name(F.col("p")), N.signed_name(F.col("p")))
    assert got == [("jpg", "Photo.JPG", "Photo-signed.pdf"), ("", "noext", "noext-signed.pdf"), ("gz", "x.tar.gz", "x.tar-signed.pdf"), ("", "", "-signed.pdf")]
    got = values(spark, [("\n a \n",), (" \t\n",), ("",), (None,)], "p string", N.trimmed(F.col("p")), N.is_blank(F.col("p")))
    assert got == [("a", False), ("", True), ("", True), (None, True)]


def test_json_strings_only(spark):
    rows = [('{"tag": "v1"}',), ('{"tag": 5}',), ("{}",), ("{",), (None,)]
    assert [x for (x,) in values(spark, rows, "j string", N.json_string(F.col("j"), "tag"))] == ["v1", None, None, None, None]


def test_keys_pickers_urls(spark):
    got = values(spark, [(36,), (76,), (53,), (51,), (117,), (1,)], "k int", N.key_action(F.col("k")))
    assert [x for (x,) in got] == ["done", "done", "cancel", "clear", "clear", "pass"]
    assert [x for (x,) in values(spark, [("photos",), ("pdf",), ("both",)], "k string", F.size(N.allowed_kinds(F.col("k"))))] == [1, 1, 2]
    assert values(spark, [("https://a.b/c",), ("http://[",)], "u string", N.url_or_null(F.col("u"))) == [("https://a.b/c",), (None,)]


def test_resize(spark):
    rows = [(1, 1), (1600, 1600), (1601, 1), (1, 5000), (3200, 1), (3200, 2400), (6400, 10)]
    got = values(spark, rows, "w int, h int", *G.resized(F.col("w"), F.col("h")))
    assert got == [(1, 1), (1600, 1600), (1600, 1), (1, 1600), (1600, 1), (1600, 1200), (1600, 2)]


def test_orientation(spark):
    got = values(spark, [(i,) for i in (None, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9)], "o int", *G.turned(F.lit(4), F.lit(3), F.col("o")))
    assert [w for w, _ in got] == [4, 4, 4, 4, 4, 4, 3, 3, 3, 3, 4]


def test_stamps_keep_their_centre(spark):
    rows = [(10.0, 20.0, 100.0, 50.0, 5.0), (0.0, 0.0, 30.0, 0.0, 700.0)]
    got = values(spark, rows, "x double, y double, w double, h double, n double", *G.stamp_resized(*map(F.col, "xywhn")))
    assert got[0] == (53.0, 41.5, 14.0, 7.0)
    assert got[1] == (-285.0, -300.0, 600.0, 600.0)
    w, h = G.stamp_size(F.lit(300.0), G.safe_aspect(F.lit(2.0), F.lit(0.0)))
    x, y = G.centred(F.lit(300.0), F.lit(500.0), w, h)
    assert values(spark, [(1,)], "i int", x + w / 2, y + h / 2, w) == [(150.0, 250.0, 120.0)]


def test_ink(spark):
    point = "array<array<struct<x:double,y:double>>>"
    rows = [([],), ([[(1.0, 2.0)]],), ([[(0.0, 0.0), (5.0, 0.0)], [(2.0, -3.0)]],)]
    got = values(spark, rows, f"s {point}", G.ink_box(F.col("s")), F.size(G.drawable(F.col("s"))))
    assert got[0] == (None, 0) and tuple(got[1][0]) == (-9.0, -8.0, 20.0, 20.0) and tuple(got[2][0]) == (-10.0, -13.0, 25.0, 23.0) and got[2][1] == 1
    moved = values(spark, rows[2:], f"s {point}", G.moved(F.col("s"), F.lit(1.0), F.lit(1.0)))[0][0]
    assert moved[0][1].x == 4.0 and moved[1][0].y == -4.0


def test_rectangles_are_half_open(spark):
    inside = G.contains(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0))
    assert [x for (x,) in values(spark, [(0.0, 0.0), (2.0, 0.5), (1.0, 1.0), (1.9, 0.9)], "x double, y double", inside)] == [True, False, False, True]
    assert values(spark, [(0,), (7,)], "n int", G.grid_height(F.col("n"))) == [(250,), (288,)]

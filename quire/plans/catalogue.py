"""The engine's queries on stand-in tables, and the DuckDB SQL that they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import naming as N
from quire.operators import gestures, ordinals, sequence, sessions, stamps
from quire.sources import files

DELAY = 6 * 3600 * 1_000_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split into pages, non-blank ones numbered and laid out on a grid, flattened to a row for each document."""
    pages = files.pages_of_text(_t(spark, sf_dir, "documents"), "doc_id", "text").where(~N.is_blank(F.col("page")))
    row, col, x, y = G.grid_cell(F.col("page_ord"))
    placed = pages.select("doc_id", "page_ord", F.struct("page_ord", x.alias("x"), y.alias("y"), F.length("page").alias("n")).alias("cell"))
    return placed.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sort_array(F.collect_list("cell")).alias("cells"))


def natural_order(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select("p_brand").distinct()
    return ordinals.global_ordinal(names.withColumn("_key", N.natural_key(F.col("p_brand"))), "position", "_key", "p_brand").select("p_brand", "position")


def ext_filter(spark, sf_dir):
    lang = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})/", 1))
    return _t(spark, sf_dir, "pages").where(files.is_image(F.concat(F.lit("page."), lang), ("en", "de"))).select("page_id", lang.alias("kind"))


def non_blank(spark, sf_dir):
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~N.is_blank(x))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"))


def route(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    counted = events.groupBy("user_id", "day").agg(F.count_if(F.col("event_type") == "purchase").alias("pdfs"), F.count_if(F.col("event_type") == "click").alias("images"))
    return counted.select("user_id", F.col("day").cast("string").alias("day"), "pdfs", "images", files.route_of(F.col("pdfs"), F.col("images")).alias("route"))


def load_pages(spark, sf_dir):
    pages = files.pages_of_text(_t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("page_ord").cast("long"), F.length("page").cast("long").alias("n_chars"))
    return ordinals.global_ordinal(pages, "position", "doc_id", "page_ord")


def resize(spark, sf_dir):
    w, h = F.floor(F.col("l_extendedprice") / 10).cast("int"), F.floor(F.col("l_quantity") * 60).cast("int")
    sized = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", w.alias("w"), h.alias("h"))
    new_w, new_h = G.resized(F.col("w"), F.col("h"))
    return sized.select("l_orderkey", "l_linenumber", "l_partkey", new_w.alias("new_w"), new_h.alias("new_h"))


def orient(spark, sf_dir):
    w, h = G.turned(F.lit(400), F.lit(300), F.col("p_size") % 9)
    return _t(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"))


def quarantine(spark, sf_dir):
    number = F.regexp_extract("url", r"[?&]page=([^&#]*)", 1).try_cast("int")
    return files.quarantined(_t(spark, sf_dir, "pages").select("page_id", number.isNotNull().alias("ok")), F.col("ok"), "page_id").select("page_id", "status", "place")


def report(spark, sf_dir):
    number = F.regexp_extract("url", r"[?&]page=([^&#]*)", 1).try_cast("int")
    read = _t(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("batch"), "page_id", F.col("page_id").alias("name"), number.isNotNull().alias("ok"))
    return files.report(read, ["batch"], F.col("ok"), "name", "page_id")


def output_name(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", N.output_name("Photos_", F.col("ts")).alias("name"))


def signed_name(spark, sf_dir):
    url = F.regexp_replace("url", "[?#].*$", "")
    return _t(spark, sf_dir, "pages").select("page_id", N.signed_name(url).alias("name"), N.parent(url).alias("folder"))


def version_newer(spark, sf_dir):
    new = F.concat(F.lit("v"), F.col("p_size"), F.lit("."), F.col("p_partkey") % 10)
    return _t(spark, sf_dir, "part").select("p_partkey", N.version_newer(new, F.lit("25.3.0")).alias("newer"))


def json_field(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", N.json_number(F.col("props"), "k").alias("k"), N.json_string(F.col("props"), "k").alias("k_string"))


def latest_first(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    ranked = ordinals.local_ordinal(orders, "rank", ["o_custkey"], F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey"))
    return ranked.select("o_custkey", "o_orderkey", "rank")


SELECTED = (0, 2)


def _documents(spark, sf_dir) -> DataFrame:
    """Conversations as documents of (turn) pages."""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 90 % 360).alias("rotation"))
    return sequence.gather(turns, "conv_id", ["turn"], ["turn", "rotation"])


def _selection():
    return F.array(*[F.lit(i) for i in SELECTED])


def _edited(documents: DataFrame, pages) -> DataFrame:
    out = sequence.spread(documents.select("conv_id", pages.alias("pages")), "conv_id")
    return out.select("conv_id", F.col("page_ord").cast("long"), "turn")


def append_pages(spark, sf_dir):
    return _edited(_documents(spark, sf_dir), sequence.appended(F.col("pages"), sequence.indexed(F.col("pages"), _selection())))


def insert_at(spark, sf_dir):
    return _edited(_documents(spark, sf_dir), sequence.inserted(F.col("pages"), sequence.indexed(F.col("pages"), _selection()), F.lit(3)))


def reorder(spark, sf_dir):
    return _edited(_documents(spark, sf_dir), sequence.moved(F.col("pages"), _selection(), F.lit(4)))


def remove_pages(spark, sf_dir):
    return _edited(_documents(spark, sf_dir), sequence.removed(F.col("pages"), _selection()))


def extract_pages(spark, sf_dir):
    return _edited(_documents(spark, sf_dir), sequence.indexed(F.col("pages"), _selection()))


def rotate_pages(spark, sf_dir):
    even = F.filter(F.sequence(F.lit(0), F.size("pages") - 1), lambda i: i % 2 == 0)
    out = sequence.spread(_documents(spark, sf_dir).select("conv_id", sequence.turned(F.col("pages"), even).alias("pages")), "conv_id")
    return out.select("conv_id", "turn", "rotation")


def flatten(spark, sf_dir):
    pages = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey")
    value = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    out = stamps.flattened(pages, lines, ["page"], ["l_linenumber", "l_partkey"], value)
    return out.select("page", F.size("stamps").cast("long").alias("n_stamps"), F.array_join("stamps", ",").alias("drawn"))


def hit_test(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    points = _t(spark, sf_dir, "lineitem").select(*key, F.col("l_quantity").alias("px"), F.col("l_discount").alias("py"))
    r = F.col("r_regionkey")
    boxes = _t(spark, sf_dir, "region").select(r.alias("z"), (r * 10.0).alias("x"), (r * 0.01).alias("y"), F.lit(20.0).alias("w"), F.lit(0.05).alias("h"))
    at, box = [tuple(map(F.col, names)) for names in (("px", "py"), ("x", "y", "w", "h"))]
    return stamps.under_point(points, boxes, at, box, (20.0, 0.05), key, F.col("z")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "hit")


def last_stamp(spark, sf_dir):
    return stamps.last_of(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey", "last_partkey")


def _orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey")


def has_widget(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey")
    return stamps.having(_orders(spark, sf_dir), lines, F.col("o_orderkey") == F.col("l_orderkey"))


def remove_stamp(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey")
    return stamps.without(_orders(spark, sf_dir), lines, F.col("o_orderkey") == F.col("l_orderkey"))


def place_stamp(spark, sf_dir):
    w, h = G.stamp_size(F.col("p_size") * 20.0, F.col("p_retailprice") / 900)
    x, y = G.centred(F.col("p_size") * 20.0, F.lit(1000.0), w, h)
    return _t(spark, sf_dir, "part").select("p_partkey", *[F.round(v, 6).alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])


def thumb_fit(spark, sf_dir):
    x, y, w, h = G.fitted(F.col("p_size") * 10.0, F.col("p_retailprice") / 10, 158.0, 68.0)
    return _t(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def grid(spark, sf_dir):
    parts = ordinals.global_ordinal(_t(spark, sf_dir, "part").select("p_partkey"), "i", "p_partkey")
    row, col, x, _ = G.grid_cell(F.col("i"))
    return parts.select("p_partkey", (F.col("i") + 1).alias("label"), row.alias("row"), col.alias("col"), x.alias("x"))


def bbox(spark, sf_dir):
    points = _t(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    box = points.groupBy("label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return box.select("label", (F.col("x0") - G.INK_PAD).alias("x"), (F.col("y0") - G.INK_PAD).alias("y"), G.padded_extent(F.col("x0"), F.col("x1")).alias("w"), G.padded_extent(F.col("y0"), F.col("y1")).alias("h"))


def strokes(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    marked = gestures.strokes(events, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error")
    grouped = marked.where("stroke is not null").groupBy("user_id", "stroke").agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))
    return grouped.where("n > 1")


def drag_path(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    out = gestures.path_sum(events, "user_id", ["ts", "event_id"], F.col("value").cast("decimal(18,2)"), "at")
    return out.select("event_id", "user_id", F.col("at").cast("double").alias("at"))


def anchored_batches(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return gestures.anchored_batches(events, "user_id", F.col("t"), DELAY)


def scan_pages(spark, sf_dir):
    """Web pages as files: English ones as documents of as many pages as their number says, German ones as images, others unreadable."""
    lang = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})/", 1))
    name = F.concat(lang, F.lit("."), F.when(lang == "en", "pdf").when(lang == "de", "JPG").otherwise("txt"))
    listed = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), name.alias("path"))
    found = F.when(files.is_pdf(F.col("path")), F.sequence(F.lit(0).cast("long"), F.col("file") % 4)).when(files.is_image(F.col("path")), F.array(F.lit(0).cast("long")))
    pages = files.pages_of_files(files.accepted(listed), ["file"], found)
    return ordinals.global_ordinal(pages.select("file", F.col("page_ord").cast("long")), "position", "file", "page_ord")


def hit_on_page(spark, sf_dir):
    points = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 60).cast("double").alias("px"))
    boxes = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x"), F.struct("l_linenumber", "l_partkey").alias("z"))
    fits = G.contains(F.col("px"), F.lit(0.0), F.col("x"), F.lit(0.0), F.lit(15.0), F.lit(1.0))
    out = stamps.under_point_of_page(points, boxes, ["page"], fits, ["page"], F.col("z"))
    return out.select("page", F.col("hit.l_partkey").alias("hit"))


def remove_by_identity(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    gone = _t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(2).alias("l_linenumber"))
    return stamps.selected_after(lines, gone, ["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_linenumber", "l_partkey"], "l_partkey")


def drag_latch(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    hit = F.when(F.col("value") > 20, F.col("event_id") % 100)
    out = gestures.latched(events, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error", hit)
    return out.select("event_id", "latch")


def tracked_touch(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", (F.col("event_id") % 2).alias("touch"))
    kind = F.col("event_type")
    out = gestures.strokes(events, "user_id", ["ts", "event_id"], kind == "signup", kind == "error", touch=F.col("touch"))
    return out.where("stroke is not null").select("event_id", "stroke")


def discarded_strokes(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    kind = F.col("event_type")
    out = gestures.strokes(events, "user_id", ["ts", "event_id"], kind == "signup", kind == "error", discards=kind == "purchase")
    return out.where("stroke is not null").select("event_id", "stroke")


def ink_after_clear(spark, sf_dir):
    """Pointer events with touches told apart: what is on each surface after the last purchase cleared it, padded."""
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", (F.col("event_id") % 2).alias("touch"), "value", (F.col("event_id") % 100).cast("double").alias("y"))
    kind = F.col("event_type")
    out = gestures.strokes(events, "user_id", ["ts", "event_id"], kind == "signup", kind == "error", touch=F.col("touch"), clears=kind == "purchase")
    box = gestures.ink(out, "user_id", F.col("value"), F.col("y"))
    w, h = G.padded_extent(F.col("x0"), F.col("x1")), G.padded_extent(F.col("y0"), F.col("y1"))
    # greatest() passes nulls over, so an empty surface is told by its missing extent.
    return box.select("user_id", "n_strokes", (F.col("x0") - G.INK_PAD).alias("x"), (F.col("y0") - G.INK_PAD).alias("y"), F.when(F.col("x0").isNotNull(), w).alias("w"), F.when(F.col("x0").isNotNull(), h).alias("h"))


def save_with_gaps(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    documents = sequence.gather(turns, "conv_id", ["turn"], ["turn", "role"])
    out = documents.select("conv_id", F.explode(sequence.saved(F.col("pages"), lambda p: p["role"] == "system")).alias("x"))
    return out.select("conv_id", F.col("x.place").cast("long").alias("place"), "x.page.turn")


def shown_page(spark, sf_dir):
    pages = _documents(spark, sf_dir)
    return pages.select("conv_id", sequence.current_or_first(F.col("pages"), F.col("conv_id").cast("int") % 8)["turn"].alias("turn"))


def grid_from_below(spark, sf_dir):
    parts = _t(spark, sf_dir, "part")
    numbered = ordinals.global_ordinal(parts.select("p_partkey"), "i", "p_partkey")
    return numbered.select("p_partkey", G.grid_y(F.col("i"), F.lit(parts.count())).alias("y"))


def tag_lookup(spark, sf_dir):
    library = ordinals.global_ordinal(_t(spark, sf_dir, "part").select("p_partkey"), "i", F.col("p_partkey").desc())
    tags = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37).alias("tag"))
    return ordinals.at_place(library, "i", tags, "tag").select("s_suppkey", "p_partkey")


def nearest_page(spark, sf_dir):
    """Orders as pages of 20 long documents, lines as points, some of them before, between and after all pages."""
    pages = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 20).alias("doc"), "o_orderkey")
    points = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).alias("doc"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 80 + F.col("l_quantity") - 100).alias("place"))
    out = stamps.nearest_page(points, pages, "doc", F.col("place"), F.col("o_orderkey") * 10, F.col("o_orderkey") % 150 + 4, "o_orderkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "place", F.col("nearest").alias("page"), "distance")


def stamp_selection(spark, sf_dir):
    """Events as a log: sign-ups add a stamp on one of three pages, clicks are on an earlier stamp or on nothing, errors remove."""
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    kind = F.col("event_type")
    action = F.when(kind == "signup", "add").when(kind == "click", "click").when(kind == "error", "remove")
    added = gestures.path_sum(events.withColumn("action", action), "user_id", ["ts", "event_id"], (kind == "signup").cast("long"), "n")
    which = F.when(kind == "signup", F.col("n")).otherwise(F.col("event_id") % (F.col("n") + 1))
    out = sessions.selection(added.withColumn("stamp", which).withColumn("page", (which % 3).cast("int")), "user_id", ["ts", "event_id"], "action", "stamp", "page")
    return out.select("event_id", "selected", "removed", "n_live")


def drag_stamps(spark, sf_dir):
    """Events as a pointer over five overlapping stamps of each user; later events meet them where earlier ones have left them."""
    events = _t(spark, sf_dir, "events")
    kind = F.col("event_type")
    phase = F.when(kind == "signup", "down").when(kind == "error", "up").otherwise("drag")
    none = F.lit(None).cast("double")
    pointer = events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"), "event_id", phase.alias("phase"), F.lit(None).cast("int").alias("stamp"), F.lit(0).alias("page"), F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"), none.alias("w"), none.alias("h"))
    users = events.select("user_id").distinct().withColumn("stamp", F.explode(F.sequence(F.lit(0), F.lit(4))))
    x, y = F.col("stamp") * 12.0 + F.col("user_id") % 10, F.col("stamp") * 6.0
    placed = users.select("user_id", F.lit(-(1 << 62)).alias("at"), F.col("stamp").cast("long").alias("event_id"), F.lit("place").alias("phase"), "stamp", F.lit(0).alias("page"), x.alias("x"), y.alias("y"), F.lit(25.0).alias("w"), F.lit(20.0).alias("h"))
    out = sessions.drags(placed.unionByName(pointer), "user_id", ["at", "event_id"], "phase", "stamp", "page").where("phase <> 'place'")
    return out.select("event_id", "held", "at_x", "at_y")


def edit_session(spark, sf_dir):
    """Events as edits of each user's document: files, added pages, drags of source pages and within the tray, removals."""
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    kind, i = F.col("event_type"), F.col("event_id")
    named = lambda **ops: reduce(lambda c, x: c.when(kind == x[0], F.lit(x[1])), ops.items(), F.when(F.lit(False), F.lit("")))
    two = F.array(i % 5, i % 3)
    dragged = events.where(kind.isin("view", "purchase")).select("user_id", "ts", "event_id", F.lit(0).alias("step"), named(view="drag_source", purchase="drag_tray").alias("op"), two.alias("sel"), F.lit(None).cast("long").alias("target"), F.lit(None).cast("long").alias("n"))
    done = events.select("user_id", "ts", "event_id", F.lit(1).alias("step"), named(signup="file", click="add", view="drop_source", purchase="drop_tray", error="remove").alias("op"), two.alias("sel"), (i % 7).alias("target"), (i % 4).alias("n"))
    return sessions.edited(dragged.unionByName(done), "user_id", ["ts", "event_id", "step"]).select("user_id", "page_ord", "source_ord")


def _contents(spark, sf_dir) -> DataFrame:
    """Documents as files: a third are PDFs with a page object for each line, a third PNGs, the others texts."""
    page = F.concat(F.lit("<< /Type /Page /N "), F.length("text").cast("string"), F.lit(" >>\n"))
    lines = F.size(F.split("text", "\n", -1))
    pdf = F.concat(F.lit("%PDF-1.4\n<< /Type /Pages >>\n"), F.repeat(page, lines))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("text", "UTF-8"))
    content = F.when(F.col("doc_id") % 3 == 0, F.encode(pdf, "UTF-8")).when(F.col("doc_id") % 3 == 1, png).otherwise(F.encode("text", "UTF-8"))
    return _t(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


def file_pages(spark, sf_dir):
    pages = files.loaded(_contents(spark, sf_dir), ["doc_id"])
    return ordinals.global_ordinal(pages, "position", "doc_id", "page_ord")


def open_document(spark, sf_dir):
    return files.opened(_contents(spark, sf_dir)).select("doc_id", "pages", F.col("message").isNotNull().alias("failed"))


def saved_library(spark, sf_dir):
    """Orders as saved files: those of a fifth of all customers are signatures, newest first over all."""
    ext = F.when(F.col("o_custkey") % 5 == 0, "png").when(F.col("o_custkey") % 5 == 1, "PNG").otherwise("pdf")
    listed = _t(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%015d", "o_orderkey").alias("path"), ext.alias("ext"), F.col("o_orderdate").alias("mtime"))
    return files.library(listed).select("o_orderkey", "rank")


def existing_files(spark, sf_dir):
    wanted = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path"))
    return files.existing(wanted, _t(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("path"))).select("l_orderkey", "l_linenumber", "path")


def empty_guard(spark, sf_dir):
    batches = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("batch"))
    return files.guarded(batches, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch")), "batch").select("batch", "n_files", "status")


def stamp_on_top(spark, sf_dir):
    """Lines as stamps of a page; every third order gets two more, above them."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("z"), "l_partkey")
    orders = _t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    new = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("z"), F.lit(-1).cast(lines.schema["l_partkey"].dataType).alias("l_partkey"))
    return stamps.put_on_top(lines, new, ["l_orderkey"])


def flatten_stamps(spark, sf_dir):
    """Lines as annotations, of which the returned ones are stamps; only those are drawn onto their page."""
    pages = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    kind = F.when(F.col("l_returnflag") == "R", "stamp").otherwise("note")
    notes = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey", kind.alias("kind"))
    out = stamps.flattened(pages, stamps.only(notes, "kind"), ["page"], ["l_linenumber", "l_partkey"], F.col("l_partkey").cast("string"))
    return out.select("page", F.size("stamps").cast("long").alias("n_stamps"), F.array_join("stamps", ",").alias("drawn"))


def drawn_ink(spark, sf_dir):
    """Three strokes of one, two and three points from each line: the drawable ones, their box, and where they begin once moved to its corner."""
    q, d, t = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array(F.array(point(d * 900, q)), F.array(point(q, t * 100), point(d * 100, q)), F.array(point(t * 100, q), point(q, d * 100), point(d * 100, t * 100))).alias("strokes"))
    kept = lines.withColumn("strokes", G.drawable(F.col("strokes")))
    boxed = kept.withColumn("box", G.ink_box(F.col("strokes")))
    first = F.get(F.get(G.moved(F.col("strokes"), F.col("box.x"), F.col("box.y")), F.lit(0)), F.lit(0))
    sized = [F.round(c, 6).alias(n) for c, n in ((F.col("box.x"), "x"), (F.col("box.y"), "y"), (F.col("box.w"), "w"), (F.col("box.h"), "h"), (first["x"], "first_x"), (first["y"], "first_y"))]
    return boxed.select("l_orderkey", "l_linenumber", "l_partkey", F.size("strokes").alias("n_strokes"), *sized)


def text_raster(spark, sf_dir):
    w, h = G.text_raster(F.length("c_name") * 7.3, F.lit(23.4), 20)
    return _t(spark, sf_dir, "customer").select("c_custkey", w.alias("w"), h.alias("h"))


QUERIES = (
    natural_order, ext_filter, non_blank, route, load_pages, resize, orient, quarantine, report, output_name, signed_name, version_newer, json_field,
    latest_first, append_pages, insert_at, reorder, remove_pages, extract_pages, rotate_pages, flatten, hit_test, last_stamp, has_widget,
    remove_stamp, place_stamp, thumb_fit, grid, bbox, strokes, drag_path, anchored_batches,
    scan_pages, hit_on_page, remove_by_identity, drag_latch, tracked_touch, discarded_strokes, save_with_gaps, shown_page, grid_from_below, tag_lookup, ink_after_clear,
    nearest_page, stamp_selection, drag_stamps, edit_session,
    file_pages, open_document, saved_library, existing_files, empty_guard, stamp_on_top, flatten_stamps, drawn_ink, text_raster,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_CONV = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"
_NUMBERED = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) - 1 AS page_ord, turn FROM ({rows})"


def _edit(rows: str, order: str) -> str:
    return f"WITH p AS ({_CONV}) " + _NUMBERED.format(rows=rows, order=order)


#: From each beginning to the next: the first stop says whether the stroke is finished; its points lie before it.
_STROKES = """WITH e AS (SELECT user_id, event_id, event_type AS k, event_id % 2 AS touch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    b AS (SELECT user_id, i AS b, touch, row_number() OVER (PARTITION BY user_id ORDER BY i) AS stroke, coalesce(lead(i) OVER (PARTITION BY user_id ORDER BY i), 1000000000000000) AS next FROM e WHERE k = 'signup'),
    f AS (SELECT b.user_id, b, stroke, b.touch, min(i) AS stop, arg_min(k, i) AS what FROM b JOIN e ON e.user_id = b.user_id AND i > b AND i < next AND k IN {stops} GROUP BY ALL),
    p AS (SELECT e.user_id, e.event_id, stroke, i FROM f JOIN e ON e.user_id = f.user_id AND i >= b AND i < stop AND {same} WHERE what = 'error'),
    drawn AS (SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY user_id, stroke) > 1)"""

#: One event after the other: the stroke that is drawn (n points and extent), and what is finished since the last clear.
_INK = """WITH RECURSIVE e AS (SELECT user_id, event_type AS k, event_id % 2 AS touch, value AS x, (event_id % 100)::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS held, 0::BIGINT AS n, NULL::DOUBLE AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c, NULL::DOUBLE AS d,
                 0::BIGINT AS m, NULL::DOUBLE AS x0, NULL::DOUBLE AS y0, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1 FROM (SELECT DISTINCT user_id FROM e)
          UNION ALL
          SELECT user_id, i, CASE k WHEN 'signup' THEN touch WHEN 'error' THEN NULL ELSE held END,
                 CASE WHEN k = 'signup' THEN 1 WHEN k IN ('error', 'purchase') THEN 0 WHEN on_ THEN n + 1 ELSE n END,
                 CASE WHEN k = 'signup' THEN x WHEN k IN ('error', 'purchase') THEN NULL WHEN on_ THEN least(a, x) ELSE a END,
                 CASE WHEN k = 'signup' THEN y WHEN k IN ('error', 'purchase') THEN NULL WHEN on_ THEN least(b, y) ELSE b END,
                 CASE WHEN k = 'signup' THEN x WHEN k IN ('error', 'purchase') THEN NULL WHEN on_ THEN greatest(c, x) ELSE c END,
                 CASE WHEN k = 'signup' THEN y WHEN k IN ('error', 'purchase') THEN NULL WHEN on_ THEN greatest(d, y) ELSE d END,
                 CASE WHEN k = 'purchase' THEN 0 WHEN done THEN m + 1 ELSE m END,
                 CASE WHEN k = 'purchase' THEN NULL WHEN done THEN least(x0, a) ELSE x0 END, CASE WHEN k = 'purchase' THEN NULL WHEN done THEN least(y0, b) ELSE y0 END,
                 CASE WHEN k = 'purchase' THEN NULL WHEN done THEN greatest(x1, c) ELSE x1 END, CASE WHEN k = 'purchase' THEN NULL WHEN done THEN greatest(y1, d) ELSE y1 END
          FROM (SELECT s.* EXCLUDE (i), e.i, e.k, e.touch, e.x, e.y, coalesce(s.held = e.touch, false) AND e.k NOT IN ('signup', 'error', 'purchase') AS on_, e.k = 'error' AND s.n > 1 AS done
                FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
    SELECT user_id, m AS n_strokes, x0 - 10 AS x, y0 - 10 AS y, CASE WHEN m > 0 THEN greatest(1.0::DOUBLE, x1 - x0 + 20) END AS w, CASE WHEN m > 0 THEN greatest(1.0::DOUBLE, y1 - y0 + 20) END AS h
    FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""


SQL = {
    "natural_order": "SELECT p_brand, row_number() OVER (ORDER BY upper(regexp_extract(p_brand, '^[^0-9]*')), regexp_extract(p_brand, '[0-9]+')::INT, p_brand) - 1 AS position FROM (SELECT DISTINCT p_brand FROM part)",
    "ext_filter": "SELECT page_id, kind FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})/', 1)) AS kind FROM pages) WHERE kind IN ('en', 'de')",
    "non_blank": r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s]')))::BIGINT AS n_lines FROM documents",
    "route": """SELECT user_id, day, pdfs, images, CASE WHEN pdfs = 1 AND images = 0 THEN 'sign' WHEN pdfs > 0 THEN 'organize' WHEN images > 0 THEN 'combine' ELSE 'home' END AS route
        FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') AS pdfs, count(*) FILTER (event_type = 'click') AS images FROM events GROUP BY ALL)""",
    "load_pages": """SELECT doc_id, page_ord, n_chars, row_number() OVER (ORDER BY doc_id, page_ord) - 1 AS position
        FROM (SELECT doc_id, i - 1 AS page_ord, length(lines[i])::BIGINT AS n_chars FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))""",
    "resize": """SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, round_even(w * s, 0)::INT) AS new_w, greatest(1, round_even(h * s, 0)::INT) AS new_h
        FROM (SELECT *, least(1.0::DOUBLE, 1600.0::DOUBLE / greatest(w, h)) AS s FROM (SELECT *, floor(l_extendedprice / 10)::INT AS w, floor(l_quantity * 60)::INT AS h FROM lineitem))""",
    "orient": "SELECT p_partkey, CASE WHEN p_size % 9 BETWEEN 5 AND 8 THEN 300 ELSE 400 END AS w, CASE WHEN p_size % 9 BETWEEN 5 AND 8 THEN 400 ELSE 300 END AS h FROM part",
    "quarantine": """SELECT page_id, status, row_number() OVER (PARTITION BY status ORDER BY page_id) - 1 AS place
        FROM (SELECT page_id, CASE WHEN try_cast(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS INT) IS NULL THEN 'skipped' ELSE 'ok' END AS status FROM pages)""",
    "report": """SELECT page_id % 10 AS batch, count(n) AS n_ok, count(*) - count(n) AS n_skipped, coalesce(string_agg(page_id, ', ' ORDER BY page_id) FILTER (n IS NULL), '') AS skipped
        FROM (SELECT page_id, try_cast(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS INT) AS n FROM pages) GROUP BY 1""",
    "output_name": "SELECT event_id, 'Photos_' || strftime(ts, '%Y-%m-%d_%H%M%S') || '.pdf' AS name FROM events",
    "signed_name": r"""SELECT page_id, regexp_replace(list_last(string_split(u, '/')), '\.[^.]+$', '') || '-signed.pdf' AS name, regexp_replace(u, '/[^/]*$', '') AS folder
        FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)""",
    "version_newer": "SELECT p_partkey, p_size > 25 OR (p_size = 25 AND p_partkey % 10 > 3) AS newer FROM part",
    "json_field": "SELECT event_id, (props->>'k')::INT AS k, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN props->>'k' END AS k_string FROM events",
    "latest_first": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) - 1 AS rank FROM orders",
    "append_pages": _edit("SELECT conv_id, turn, 0 AS part, i FROM p UNION ALL SELECT conv_id, turn, 1, i FROM p WHERE i IN (0, 2)", "part, i"),
    "insert_at": _edit("SELECT conv_id, turn, CASE WHEN i < 3 THEN 0 ELSE 2 END AS part, i FROM p UNION ALL SELECT conv_id, turn, 1, i FROM p WHERE i IN (0, 2)", "part, i"),
    "reorder": _edit("SELECT conv_id, turn, CASE WHEN i IN (0, 2) THEN 1 WHEN i < 4 THEN 0 ELSE 2 END AS part, i FROM p", "part, i"),
    "remove_pages": _edit("SELECT conv_id, turn, i FROM p WHERE i NOT IN (0, 2)", "i"),
    "extract_pages": _edit("SELECT conv_id, turn, i FROM p WHERE i IN (0, 2)", "i"),
    "rotate_pages": f"SELECT conv_id, turn, (turn * 90 % 360 + CASE WHEN i % 2 = 0 THEN 90 ELSE 0 END) % 360 AS rotation FROM ({_CONV})",
    "flatten": """SELECT o_orderkey AS page, count(l_orderkey) AS n_stamps, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_orderkey IS NOT NULL), '') AS drawn
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
    "hit_test": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(r_regionkey) AS hit
        FROM lineitem JOIN region ON l_quantity >= r_regionkey * 10.0::DOUBLE AND l_quantity < r_regionkey * 10.0::DOUBLE + 20.0::DOUBLE
            AND l_discount >= r_regionkey * 0.01::DOUBLE AND l_discount < r_regionkey * 0.01::DOUBLE + 0.05::DOUBLE
        GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice""",
    "last_stamp": "SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS last_partkey FROM lineitem GROUP BY 1",
    "has_widget": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "remove_stamp": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "place_stamp": """SELECT p_partkey, round((pw - w) / 2, 6) AS x, round((1000.0 - h) / 2, 6) AS y, round(w, 6) AS w, round(h, 6) AS h
        FROM (SELECT *, w / greatest(0.01::DOUBLE, p_retailprice / 900) AS h FROM (SELECT *, p_size * 20.0::DOUBLE AS pw, least(220.0::DOUBLE, 0.4::DOUBLE * (p_size * 20.0::DOUBLE)) AS w FROM part))""",
    "thumb_fit": """SELECT p_partkey, (158 - w * s) / 2 AS x, (68 - h * s) / 2 AS y, w * s AS w, h * s AS h
        FROM (SELECT *, least(158.0::DOUBLE / greatest(w, 1), 68.0::DOUBLE / greatest(h, 1), 1.0::DOUBLE) AS s FROM (SELECT p_partkey, p_size * 10.0::DOUBLE AS w, p_retailprice / 10 AS h FROM part))""",
    "grid": "SELECT p_partkey, i + 1 AS label, i // 3 AS row, i % 3 AS col, 12 + (i % 3) * 182 AS x FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)",
    "bbox": """SELECT label, x0 - 10 AS x, y0 - 10 AS y, greatest(1.0::DOUBLE, x1 - x0 + 20) AS w, greatest(1.0::DOUBLE, y1 - y0 + 20) AS h
        FROM (SELECT label, min(embedding[1]::DOUBLE) AS x0, max(embedding[1]::DOUBLE) AS x1, min(embedding[2]::DOUBLE) AS y0, max(embedding[2]::DOUBLE) AS y1 FROM embeddings GROUP BY 1)""",
    "strokes": f"{_STROKES.format(stops="('error')", same='TRUE')} SELECT user_id, stroke, count(*) AS n, arg_min(event_id, i) AS first_event FROM drawn GROUP BY 1, 2",
    "drag_path": "SELECT event_id, user_id, sum(value::DECIMAL(18, 2)) OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS at FROM events",
    "anchored_batches": f"""WITH RECURSIVE t AS (SELECT user_id, epoch_us(ts) AS t FROM events),
        a AS (SELECT user_id, min(t) AS anchor FROM t GROUP BY 1
              UNION ALL SELECT a.user_id, (SELECT min(t.t) FROM t WHERE t.user_id = a.user_id AND t.t >= a.anchor + {DELAY}) FROM a
              WHERE EXISTS (SELECT 1 FROM t WHERE t.user_id = a.user_id AND t.t >= a.anchor + {DELAY}))
        SELECT a.user_id, anchor, count(*) AS n FROM a JOIN t ON t.user_id = a.user_id AND t.t >= anchor AND t.t < anchor + {DELAY} GROUP BY 1, 2""",
    "scan_pages": """SELECT file, page_ord, row_number() OVER (ORDER BY file, page_ord) - 1 AS position
        FROM (SELECT page_id AS file, unnest(generate_series(0, CASE WHEN l = 'en' THEN page_id % 4 ELSE 0 END)) AS page_ord
              FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})/', 1)) AS l FROM pages) WHERE l IN ('en', 'de'))""",
    "hit_on_page": """SELECT o_orderkey AS page, arg_max(l_partkey, (l_linenumber, l_partkey)) AS hit
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderkey % 60 >= l_quantity AND o_orderkey % 60 < l_quantity + 15 GROUP BY 1""",
    "remove_by_identity": """SELECT l_orderkey, count(*) FILTER (l_linenumber = 2) AS n_removed, count(*) FILTER (l_linenumber <> 2) AS n_left,
            arg_max(l_partkey, (l_linenumber, l_partkey)) FILTER (l_linenumber <> 2) AS selected
        FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1 HAVING count(*) FILTER (l_linenumber = 2) > 0""",
    "drag_latch": """WITH b AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
        e AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, s ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
                first_value(CASE WHEN value > 20 THEN event_id % 100 END) OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS held FROM b)
        SELECT event_id, CASE WHEN s > 0 AND ended = 0 THEN held END AS latch FROM e""",
    "tracked_touch": f"{_STROKES.format(stops="('error')", same='e.touch = f.touch')} SELECT event_id, stroke FROM drawn",
    "discarded_strokes": f"{_STROKES.format(stops="('error', 'purchase')", same='TRUE')} SELECT event_id, stroke FROM drawn",
    "ink_after_clear": _INK,
    "nearest_page": """WITH p AS (SELECT row_number() OVER () AS r, l_orderkey, l_linenumber, l_partkey, l_partkey * 80 + l_quantity - 100 AS place FROM lineitem),
        d AS (SELECT r, o_orderkey AS page, greatest(o_orderkey * 10 - place, place - (o_orderkey * 10 + o_orderkey % 150 + 4), 0) AS d FROM p JOIN orders ON o_orderkey % 20 = l_orderkey % 20)
        SELECT l_orderkey, l_linenumber, l_partkey, place, page, distance FROM p JOIN (SELECT r, min((d, page))[1] AS distance, min((d, page))[2] AS page FROM d GROUP BY r) USING (r)""",
    "stamp_selection": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS k, row_number() OVER w AS i, sum((event_type = 'signup')::INT) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS sel, NULL::BIGINT AS removed, []::BIGINT[] AS live FROM (SELECT DISTINCT user_id FROM e)
              UNION ALL
              SELECT user_id, i, event_id, CASE WHEN k = 'signup' THEN code WHEN k = 'click' AND list_contains(live, code) THEN code WHEN k = 'error' THEN list_max(left_) ELSE sel END,
                     CASE WHEN k = 'error' THEN gone END, CASE WHEN k = 'signup' THEN list_append(live, code) WHEN k = 'error' THEN left_ ELSE live END
              FROM (SELECT *, list_filter(live, lambda x: gone IS NULL OR x <> gone) AS left_
                    FROM (SELECT s.user_id, e.i, e.event_id, e.k, s.sel, s.live, coalesce(s.sel, list_max(s.live)) AS gone,
                                 CASE WHEN e.k = 'signup' THEN e.n % 3 * 1000000 + e.n ELSE e.event_id % (e.n + 1) % 3 * 1000000 + e.event_id % (e.n + 1) END::BIGINT AS code
                          FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)))
        SELECT event_id, sel % 1000000 AS selected, removed % 1000000 AS removed, len(live)::BIGINT AS n_live FROM s WHERE i > 0""",
    "edit_session": """WITH RECURSIVE e AS (SELECT user_id, event_id AS v, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        s AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS src, []::BIGINT[] AS tray FROM (SELECT DISTINCT user_id FROM e)
              UNION ALL
              SELECT user_id, i, CASE WHEN k = 'signup' THEN src + v % 4 ELSE src END,
                     CASE k WHEN 'click' THEN list_concat(tray, copies) WHEN 'view' THEN list_concat(tray[1:spot], copies, tray[spot + 1:])
                            WHEN 'purchase' THEN list_concat(rest[1:mt], moving, rest[mt + 1:]) WHEN 'error' THEN rest ELSE tray END
              FROM (SELECT *, least(v % 7, len(tray)) AS spot, least(v % 7 - len(list_filter(inside, lambda x: x < v % 7)), len(rest)) AS mt
                    FROM (SELECT *, list_filter(picked, lambda x: x < src) AS copies, list_filter(picked, lambda x: x < len(tray)) AS inside,
                                 list_transform(list_filter(picked, lambda x: x < len(tray)), lambda x: tray[x + 1]) AS moving,
                                 list_transform(list_filter(range(len(tray)), lambda x: NOT list_contains(picked, x)), lambda x: tray[x + 1]) AS rest
                          FROM (SELECT s.user_id, e.i, e.k, e.v, s.src, s.tray, list_sort(list_distinct([e.v % 5, e.v % 3])) AS picked FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))))
        SELECT user_id, unnest(range(len(tray))) AS page_ord, unnest(tray) AS source_ord FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)""",
    "drag_stamps": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS k, value AS px, (event_id % 50)::DOUBLE AS py, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        s AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::INT AS held, NULL::INT AS shown, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly,
                     list_transform(range(5), lambda z: {'x': z * 12.0::DOUBLE + user_id % 10, 'y': z * 6.0::DOUBLE}) AS b FROM (SELECT DISTINCT user_id FROM e)
              UNION ALL
              SELECT user_id, i, event_id, CASE WHEN k = 'signup' THEN coalesce(hit, held) WHEN k = 'error' THEN NULL ELSE held END,
                     CASE WHEN k = 'signup' THEN hit ELSE held END,
                     CASE WHEN k <> 'signup' AND held IS NOT NULL OR hit IS NOT NULL THEN px ELSE lx END, CASE WHEN k <> 'signup' AND held IS NOT NULL OR hit IS NOT NULL THEN py ELSE ly END,
                     CASE WHEN k NOT IN ('signup', 'error') AND held IS NOT NULL THEN list_transform(b, lambda v, z: CASE WHEN z - 1 = held THEN {'x': v.x + (px - lx), 'y': v.y + (py - ly)} ELSE v END) ELSE b END
              FROM (SELECT s.user_id, e.i, e.event_id, e.k, e.px, e.py, s.held, s.lx, s.ly, s.b,
                           CASE WHEN e.k = 'signup' THEN list_max(list_filter(range(5), lambda z: e.px >= s.b[z + 1].x AND e.px < s.b[z + 1].x + 25 AND e.py >= s.b[z + 1].y AND e.py < s.b[z + 1].y + 20)) END::INT AS hit
                    FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
        SELECT event_id, shown AS held, b[shown + 1].x AS at_x, b[shown + 1].y AS at_y FROM s WHERE i > 0""",
    "save_with_gaps": f"SELECT conv_id, i AS place, turn FROM ({_CONV}) JOIN (SELECT conv_id, turn, role FROM conversations) USING (conv_id, turn) WHERE role <> 'system'",
    "shown_page": f"SELECT conv_id, coalesce(max(turn) FILTER (i = conv_id % 8), max(turn) FILTER (i = 0)) AS turn FROM ({_CONV}) GROUP BY conv_id",
    "grid_from_below": "SELECT p_partkey, greatest(250, (n + 2) // 3 * 92 + 12) - (i // 3 + 1) * 92 AS y FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part)",
    "file_pages": """SELECT doc_id, kind, page_ord::INT AS page_ord, row_number() OVER (ORDER BY doc_id, page_ord) - 1 AS position
        FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' ELSE 'png' END AS kind, unnest(range(CASE doc_id % 3 WHEN 0 THEN len(string_split(text, chr(10))) ELSE 1 END)) AS page_ord FROM documents WHERE doc_id % 3 < 2 AND text IS NOT NULL)""",
    "open_document": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN len(string_split(text, chr(10)))::INT END AS pages, doc_id % 3 <> 0 OR text IS NULL AS failed FROM documents",
    "saved_library": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) - 1 AS rank FROM orders WHERE o_custkey % 5 = 0",
    "existing_files": "SELECT l_orderkey, l_linenumber, l_partkey AS path FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)",
    "empty_guard": "SELECT c_custkey AS batch, count(o_orderkey) AS n_files, CASE WHEN count(o_orderkey) > 0 THEN 'ok' ELSE 'empty' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "stamp_on_top": """WITH top AS (SELECT l_orderkey, max(l_linenumber) AS t FROM lineitem GROUP BY 1)
        SELECT l_orderkey, l_linenumber::BIGINT AS z, l_partkey FROM lineitem
        UNION ALL SELECT o_orderkey, coalesce(t + 1, 0) + z, -1 FROM (SELECT o_orderkey, unnest([0, 1]) AS z FROM orders WHERE o_orderkey % 3 = 0) LEFT JOIN top ON l_orderkey = o_orderkey""",
    "flatten_stamps": """SELECT o_orderkey AS page, count(l_orderkey) AS n_stamps, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_orderkey IS NOT NULL), '') AS drawn
        FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey GROUP BY 1""",
    "drawn_ink": """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS q, l_discount::DOUBLE * 100 AS d, l_tax::DOUBLE * 100 AS t FROM lineitem),
        b AS (SELECT *, least(q, d, t) - 10 AS x, greatest(q, d, t) - least(q, d, t) + 20 AS e FROM v)
        SELECT l_orderkey, l_linenumber, l_partkey, 2 AS n_strokes, round(x, 6) AS x, round(x, 6) AS y, round(e, 6) AS w, round(e, 6) AS h, round(q - x, 6) AS first_x, round(t - x, 6) AS first_y FROM b""",
    "text_raster": "SELECT c_custkey, ceil(length(c_name) * 7.3::DOUBLE)::BIGINT + 40 AS w, 64::BIGINT AS h FROM customer",
    "tag_lookup": "SELECT s_suppkey, p_partkey FROM supplier JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey DESC) - 1 AS i FROM part) ON i = s_suppkey * 37",
}


def oracle_sql() -> dict:
    return dict(SQL)

"""Stamps on pages: flatten, find what lies under a point, last, existence, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ordinals import carry


def flattened(pages: DataFrame, stamps: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "stamps") -> DataFrame:
    """Every page with the values of its stamps in z order; a page without stamps has an empty array.

    Stamps are gathered by page before the join, so the join is one to one and a
    page with very many stamps is one row of it.
    """
    item = F.struct(*order, value.alias("_value"))
    gathered = stamps.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_value"]).alias(name))
    joined = pages.join(gathered, keys, "left")
    return joined.withColumn(name, F.coalesce(name, F.array()))


def under_point(points: DataFrame, rectangles: DataFrame, at: tuple[Column, Column], box: tuple[Column, Column, Column, Column], cell: tuple[float, float], point_key: list[str], top: Column) -> DataFrame:
    """For each point that lies in any rectangle the topmost one, as hit.

    The plane is cut into cells of a width and height; a rectangle has a row for
    each cell that it touches and a point meets those of its own cell, so the
    cells are the keys of the join. Choose cells about as large as rectangles.
    Least edges belong to a rectangle, greatest do not; null coordinates meet none.
    """
    (px, py), (x, y, w, h) = at, box
    place = lambda v, size: F.floor(v.cast("double") / size).cast("long")
    span = lambda v, length, size: F.explode(F.sequence(place(v, size), place(v + length, size)))
    whole = rectangles.where(x.isNotNull() & y.isNotNull() & (w >= 0) & (h >= 0))
    cells = whole.withColumn("_cx", span(x, w, cell[0])).withColumn("_cy", span(y, h, cell[1]))
    asked = points.withColumn("_px", place(px, cell[0])).withColumn("_py", place(py, cell[1]))
    met = asked.join(cells, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy"))).where((px >= x) & (px < x + w) & (py >= y) & (py < y + h))
    return met.groupBy(*point_key).agg(F.max(top).alias("hit"))


def under_point_of_page(points: DataFrame, rectangles: DataFrame, page: list[str], fits: Column, point_key: list[str], top: Column, name: str = "hit") -> DataFrame:
    """For each point the topmost rectangle of its own page that holds it; null where none does. The page is the key of the join, fits a filter on what met."""
    met = points.join(rectangles, page, "left")
    return met.groupBy(*point_key).agg(F.max(F.when(fits, top)).alias(name))


def nearest_page(points: DataFrame, pages: DataFrame, document: str, at: Column, begin: Column, size: Column, page: str, name: str = "nearest") -> DataFrame:
    """Add to each point the page of its document that is nearest along the strip of pages, and distance, 0 on the page.

    Pages take begin up to begin + size, that end not included; they lie one after
    the other. Ties go to the lower page. A point of a document without pages, or
    without a place, has null. Points and pages are sorted together, so a point
    meets the page before it and the one after it, and a document of very many
    points is dealt over tasks.
    """
    box = F.struct(begin.cast("double").alias("begin"), (begin + size).cast("double").alias("end"), F.col(page).alias("page"))
    boxes = pages.select(F.col(document).alias("_doc"), begin.cast("double").alias("_at"), box.alias("_box"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_point"))
    asked = points.select(F.col(document).alias("_doc"), at.cast("double").alias("_at"), F.lit(None).cast(boxes.schema["_box"].dataType).alias("_box"), F.struct("*").alias("_point"))
    placed = carry(boxes.where("_at is not null").unionByName(asked), "_doc", [F.col("_at").asc(), F.col("_box").isNull().asc()], "_box", "_before", "_after").where("_box is null")
    here = F.col("_at")
    gap = lambda b: F.when(here < b["begin"], b["begin"] - here).when(here >= b["end"], here - b["end"]).otherwise(F.lit(0.0))
    choice = lambda b: F.when(b.isNotNull() & here.isNotNull(), F.struct(gap(b).alias("distance"), b["page"].alias("page")))
    best = placed.withColumn("_best", F.least(choice(F.col("_before")), choice(F.col("_after"))))
    return best.select("_point.*", F.col("_best.page").alias(name), F.col("_best.distance").alias("distance"))


def removed_by_identity(stamps: DataFrame, gone: DataFrame, identity: list[str]) -> DataFrame:
    """Stamps without those that are named; what names no stamp changes nothing."""
    return stamps.join(gone.select(*identity).distinct(), identity, "left_anti")


def selected_after(stamps: DataFrame, gone: DataFrame, document: list[str], identity: list[str], order: list[str], value: str) -> DataFrame:
    """Of each document that a stamp is removed from: how many of the named stamps were found, how many are left, and the last one left, which is selected next (null: none)."""
    named = gone.select(*identity).distinct().withColumn("_gone", F.lit(True))
    marked = stamps.join(named, identity, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    out = marked.groupBy(*document).agg(F.count_if("_gone").alias("n_removed"), F.count_if(~F.col("_gone")).alias("n_left"), F.max_by(F.when(~F.col("_gone"), F.col(value)), F.when(~F.col("_gone"), F.struct(*order))).alias("selected"))
    return out.where("n_removed > 0")


def last_of(stamps: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The topmost stamp of each document; partial maxima are taken before the shuffle."""
    return stamps.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias(name))


def having(pages: DataFrame, stamps: DataFrame, on: Column) -> DataFrame:
    return pages.join(stamps, on, "left_semi")


def without(pages: DataFrame, stamps: DataFrame, on: Column) -> DataFrame:
    return pages.join(stamps, on, "left_anti")


def only(annotations: DataFrame, kind: str, stamp: str = "stamp") -> DataFrame:
    """The stamps among annotations of all kinds; one without a kind is none."""
    return annotations.where(F.col(kind) == stamp)


def put_on_top(stamps: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New stamps above those of their page."""
    top = stamps.groupBy(*keys).agg(F.max("z").alias("_top"))
    return stamps.unionByName(new.join(top, keys, "left").withColumn("z", F.coalesce(F.col("_top") + 1, F.lit(0)) + F.col("z")).drop("_top"))

"""Edits of page sequences: append, insert, move, remove, extract, rotate.

Sequences are arrays in page order, one row for each document, so an edit
touches a row and shuffles nothing; rows of pages are brought into this form
and back by gather() and spread(), one shuffle on the document each way at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(pages: DataFrame, key: str, order: list[str], columns: list[str], name: str = "pages") -> DataFrame:
    """One row for each document with its pages in order. Columns of the order come first in the struct that sorts."""
    item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*columns).alias("_page"))
    return pages.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_page"]).alias(name))


def spread(documents: DataFrame, key: str, name: str = "pages", ordinal: str = "page_ord") -> DataFrame:
    """One row for each page with its place from 0."""
    return documents.select(key, F.posexplode(name).alias(ordinal, "_page")).select(key, ordinal, "_page.*")


def indexed(pages: Column, wanted: Column) -> Column:
    """Pages at some places, in ascending order of the places; those beyond the end are passed over."""
    return F.transform(F.filter(F.array_sort(F.array_distinct(wanted)), lambda i: (i >= 0) & (i < F.size(pages))), lambda i: F.get(pages, i))


def clamp(at: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(at, n))


def appended(pages: Column, more: Column) -> Column:
    return F.concat(pages, more)


def inserted(pages: Column, more: Column, at: Column) -> Column:
    """More pages before a place, which is brought into 0 to n."""
    t = clamp(at, F.size(pages))
    return F.concat(F.slice(pages, F.lit(1), t), more, F.slice(pages, t + 1, F.size(pages)))


def removed(pages: Column, wanted: Column) -> Column:
    return F.filter(pages, lambda _, i: ~F.array_contains(wanted, i))


def moved(pages: Column, wanted: Column, at: Column) -> Column:
    """Pages taken out and put in together before a place; the place counts pages before the move."""
    rest = removed(pages, wanted)
    inside = F.filter(F.array_distinct(wanted), lambda i: (i >= 0) & (i < F.size(pages)) & (i < at))
    return inserted(rest, indexed(pages, wanted), at - F.size(inside))


def turned(pages: Column, wanted: Column, field: str = "rotation", by: int = 90) -> Column:
    """Selected pages a quarter further."""
    return F.transform(pages, lambda p, i: F.when(F.array_contains(wanted, i), p.withField(field, (p[field] + by) % 360)).otherwise(p))


def saved(pages: Column, fails: Callable[[Column], Column]) -> Column:
    """What saving copies: (place, page) of each page whose copy does not fail. Places are numbered before that, so a failed copy leaves a gap."""
    numbered = F.transform(pages, lambda p, i: F.struct(i.alias("place"), p.alias("page")))
    return F.filter(numbered, lambda x: ~F.coalesce(fails(x["page"]), F.lit(False)))


def current_or_first(pages: Column, current: Column) -> Column:
    """The page that is shown, or the first one where none is."""
    return F.coalesce(F.get(pages, current), F.get(pages, F.lit(0)))


def drop_accepted(pane: Column, where: Column, from_tray: Column) -> Column:
    """What a drop does: only the tray takes it; from the tray it moves, from the source it copies; on a page means before it."""
    return F.when(pane != "tray", F.lit("reject")).when(from_tray, F.lit("move")).otherwise(F.lit("copy"))

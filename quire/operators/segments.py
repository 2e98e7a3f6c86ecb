"""Outlines and bookmarks to page segments: one window a document, no shuffle but on the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import pages as P
from quire.sources.files import cut


def flatten_outline(entries: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Depth-first pre-order of outline entries (doc, id, parent, ord, title, start): adds path array<long> and ord 1..n in that order.

    Each round doubles the part of its path that an entry knows, so an outline
    of any depth d takes log d joins.  Entries without a resolvable page (start
    null) are left out; their children stay, as they are entries of their own.
    Entries that no root leads to (an absent parent, a circle) have no place
    in the outline and are left out, too.
    """
    known = cut(entries.select(F.col(doc), "id", "parent", "title", "start", F.array(F.col("ord").cast("long")).alias("path"), F.col("parent").alias("__up")))
    left = known.filter("__up IS NOT NULL").count()
    while left:
        above = known.select(F.col(doc).alias("__doc"), F.col("id").alias("__id"), F.col("path").alias("__path"), F.col("__up").alias("__next"))
        open_ = known.filter("__up IS NOT NULL").join(above, F.col(doc).eqNullSafe(F.col("__doc")) & (F.col("__up") == F.col("__id")))
        further = open_.select(doc, "id", "parent", "title", "start", F.concat("__path", "path").alias("path"), F.col("__next").alias("__up"))
        known = cut(known.filter("__up IS NULL").unionByName(further))
        before, left = left, known.filter("__up IS NOT NULL").count()
        if left == before:  # circles only
            break
    ordered = Window.partitionBy(doc).orderBy("path")
    return known.filter("__up IS NULL AND start IS NOT NULL").drop("__up").withColumn("ord", F.row_number().over(ordered))


def segments(bookmarks: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, seq, title, start, end): bookmarks (doc, ord, title, start) in page order, each up to the next one.

    documents has (doc, num_pages).  Starts and ends are 0-based, ends
    exclusive.  A bookmark whose successor starts on the same page has that
    page alone; no end lies behind the last page.  Ties keep the outline's
    order by ord.  Documents without bookmarks have no segments.
    """
    order = Window.partitionBy(doc).orderBy("start", "ord")
    met = bookmarks.join(documents.select(doc, "num_pages"), doc)
    following = F.coalesce(F.lead("start").over(order), F.col("num_pages"))
    end = F.when(F.col("following") <= F.col("start"), F.least(F.col("start") + 1, F.col("num_pages"))).otherwise(F.col("following"))
    rows = met.withColumn("following", following).withColumn("seq", F.row_number().over(order))
    return rows.select(doc, "seq", "title", "start", end.alias("end"))


def segment_pages(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A row for each page of each segment."""
    return found.select(doc, "seq", "title", F.explode(P.pages_between(F.col("start"), F.col("end"))).alias("page"))


def assign_pages(pages: DataFrame, found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """pages (doc, page, ...) with the segments they lie in: an equi-join on the document and the exploded page, not a range join."""
    return pages.join(segment_pages(found, doc), [doc, "page"])


def part_pages(parts: DataFrame) -> DataFrame:
    """A row for each page of each part (title, start, end inclusive), parts numbered by their carried ordinal."""
    return parts.select("*", F.explode(P.pages_through(F.col("start"), F.col("end"))).alias("page"))


def numbered_parts(parts: DataFrame, ordinal: str = "ord", doc: str | None = None) -> DataFrame:
    """Parts with seq 1..n in input order, which the ordinal carries; doc: the column of the list that a part is from."""
    keys = [doc] if doc else []
    return parts.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal)))


def segment_files(found: DataFrame, folder, doc: str = "doc_id") -> DataFrame:
    """Segments with the folder, the slug of the document's name, and their files' names."""
    place = P.slug(P.stem_of(folder))
    return found.withColumn("folder", place).withColumn("file", P.segment_file(place, F.col("seq"), P.slug(F.col("title"))))

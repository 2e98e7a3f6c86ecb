"""Selecting, ordering, processing and merging pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import pages as P

MODES = ("permissive", "failfast", "dropmalformed")


def expand(requests: DataFrame, spec: str = "pages") -> DataFrame:
    """A row for each requested page: ord (0-based, as requested) and page; repeats stay."""
    return requests.select("*", F.posexplode(P.page_list(F.col(spec))).alias("ord", "page"))


def selected(requests: DataFrame, doc: str = "doc_id", spec: str = "pages") -> DataFrame:
    """The pages to process: each once, before anything expensive."""
    return expand(requests, spec).select(doc, "page").distinct()


def select(pages: DataFrame, requests: DataFrame, doc: str = "doc_id", spec: str = "pages") -> DataFrame:
    """pages (doc, page, ...) that are requested."""
    return pages.join(selected(requests, doc, spec), [doc, "page"], "left_semi")


def in_file_order(pages: DataFrame, *keys: str) -> DataFrame:
    """Rows with their file's name, in the order of names: lexicographic, so page_1000 stands before page_101."""
    return pages.withColumn("file", P.page_file(F.col("page"))).orderBy(*keys, "file")


def preview(requests: DataFrame, doc: str = "doc_id", spec: str = "pages") -> DataFrame:
    """Each request's first page as requested, not its least; an empty request has none."""
    return requests.select(doc, F.get(P.page_list(F.col(spec)), F.lit(0)).alias("page")).filter("page IS NOT NULL")


def first(candidates: DataFrame, *order, shown: int = 10) -> DataFrame:
    return candidates.orderBy(*order).limit(shown)


def merged(pages: DataFrame, payload: str, doc: str = "doc_id", mode: str = "permissive", error: str | None = None) -> DataFrame:
    """(doc, payloads): each document's payloads in the order of file names, repeats of a page once.

    Which of several rows of a page stays is fixed: the least payload.
    permissive keeps the pages that worked, dropmalformed drops a document with a failed
    page, failfast raises on the first failure; error names the column of messages.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    failed = F.col(error).isNotNull() if error else F.col(payload).isNull()
    if mode == "failfast":
        message = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "), F.coalesce(F.col(error) if error else F.lit(None).cast("string"), F.lit("no result")))
        pages = pages.withColumn(payload, F.when(failed, F.raise_error(message).cast(pages.schema[payload].dataType)).otherwise(F.col(payload)))
        failed = F.lit(False)
    once = pages.groupBy(doc, "page").agg(F.min(F.when(~failed, F.col(payload))).alias("payload"))
    named = F.struct(P.page_file(F.col("page")).alias("file"), "page", "payload")
    listed = once.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(F.col("payload").isNotNull(), named))).alias("rows"), F.count_if(F.col("payload").isNull()).alias("failed"))
    if mode == "dropmalformed":
        listed = listed.filter("failed = 0")
    return listed.filter(F.size("rows") > 0).select(doc, F.col("rows.payload").alias("payloads"), F.col("rows.file").alias("files"))


def process(pages: DataFrame, steps: list[tuple[str, Callable[[dict, object], object]]], payload: str = "payload", mode: str = "permissive") -> DataFrame:
    """Each page through named steps, f(row, value) -> value: adds payload (binary) and error.

    Pages are independent rows: a failed one has an error and no payload
    (permissive), is dropped (dropmalformed) or ends the job (failfast); a step that gives None ends
    its page silently, as a rasteriser that makes no file does.  Rows stream
    through in Arrow batches, after columns and rows are selected.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    schema = StructType([*(f for f in pages.schema if f.name not in (payload, "error")), *StructType().add(payload, "binary").add("error", "string")])
    names = [f.name for f in schema][:-2]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def one(row: dict) -> tuple[object, str | None]:
        value = row.get(payload)
        for name, step in steps:
            try:
                value = step(row, value)
            except Exception as problem:  # a page's failure is data, unless the job is to end
                if mode == "failfast":
                    raise
                return None, f"{name}: {problem}"
            if value is None:
                return None, f"{name}: no result"
        return value, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [one(r) for r in rows]
            keep = [i for i, (_, error) in enumerate(made) if mode != "dropmalformed" or error is None]
            columns = [[rows[i][n] for i in keep] for n in names] + [[made[i][0] for i in keep], [made[i][1] for i in keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return pages.mapInArrow(run, schema)


def cleaning(rasterise: Callable, binarise: Callable, recognise: Callable) -> list[tuple[str, Callable]]:
    """The steps of a scan's cleaning, for process(): a page is rasterised, binarised at its threshold, and its text recognised.

    rasterise(path, page) and recognise(image) are the caller's, as are image
    libraries; binarise(image, percent) gets the row's threshold.  A page
    without a raster ends there.
    """
    return [
        ("rasterise", lambda row, _: rasterise(row["path"], row["page"])),
        ("binarise", lambda row, image: binarise(image, row.get("threshold") if row.get("threshold") is not None else P.THRESHOLD)),
        ("recognise", lambda _, image: recognise(image)),
    ]


def errors(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The report of failed pages."""
    return pages.filter("error IS NOT NULL").select(doc, "page", "error")

"""Reading documents, file lists and parts lists; writing merged documents, parts and manifests."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import pages as P

PARTS = "ord long, title string, start int, end int"


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files that match a pattern: path, name, content; a missing path raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", P.file_of(F.col("path")).alias("name"), "length", "content")


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """page_*.pdf files in the order of their names."""
    return documents(spark, path, "page_*.pdf").orderBy("name")


def opened(files: DataFrame, read: Callable[[bytes], tuple[int, list[tuple]]]) -> DataFrame:
    """Files through a reader, f(bytes) -> (pages, [(id, parent, ord, title, start)]): adds num_pages and outline.

    The reader is given by the caller, as PDF libraries are not part of this package.
    """
    schema = "path string, num_pages int, outline array<struct<id:int,parent:int,ord:int,title:string,start:int>>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(c) for c in batch.column(1).to_pylist()]
            outline = [[dict(zip(("id", "parent", "ord", "title", "start"), e)) for e in entries] for _, entries in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(types[0].type), pa.array([n for n, _ in found], types[1].type), pa.array(outline, types[2].type)], schema=types)

    return files.select("path", "content").mapInArrow(run, schema)


def parts_list(spark: SparkSession, path: str) -> DataFrame:
    """TITLE;START;END lines, with their ordinal: runs of ';' count as one, lines that begin with ';' are left out."""
    lines = spark.read.text(path, wholetext=False).select("value", F.monotonically_increasing_id().alias("ord"))
    return parsed_parts(lines)


def parsed_parts(lines: DataFrame) -> DataFrame:
    fields = F.filter(F.split("value", ";+"), lambda f: f != "")
    kept = lines.filter(~F.col("value").startswith(";") & (F.trim("value") != ""))
    return kept.select("ord", F.get(fields, F.lit(0)).alias("title"), F.get(fields, F.lit(1)).cast("int").alias("start"), F.get(fields, F.lit(2)).cast("int").alias("end"))


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written once to the folder that spark.checkpoint.dir names; its lineage ends there.  Without one, a temporary folder on a local master only."""
    spark = frame.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return frame.checkpoint(eager=True)


def write_files(documents: DataFrame, write: Callable[[str, list, dict | None], None], payloads: str = "payloads") -> DataFrame:
    """Documents (output, payloads, info) through a writer, f(path, payloads, info): (output, error), one file a document or segment.

    The writer is given by the caller, as PDF libraries are not part of this
    package; a document that it fails on has an error, the others are written.
    """
    schema = "output string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for row in batch.to_pylist():
                try:
                    write(row["output"], row[payloads], dict(row["info"]) if row.get("info") else None)
                    errors.append(None)
                except Exception as problem:  # a file's failure is data
                    errors.append(str(problem))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("output")).cast(pa.string()), pa.array(errors, pa.string())], names=["output", "error"])

    return documents.mapInArrow(run, schema)


def write_parts(parts: DataFrame, path: str) -> None:
    """Parts (folder, seq, ...) in a folder of their own each, replacing what was there."""
    parts.write.mode("overwrite").partitionBy("folder", "seq").parquet(path)


def write_merged(documents: DataFrame, path: str, author: str, joint: str | None = "_") -> None:
    """Merged documents (path, payloads) with their output's path and metadata; joint None writes no metadata."""
    info = F.lit(None).cast("map<string,string>") if joint is None else P.document_info(F.col("path"), author, joint)
    documents.withColumn("output", P.cleaned_path(F.col("path"))).withColumn("info", info).write.mode("overwrite").parquet(path)


def write_manifest(files: DataFrame, path: str, slashes: bool = True) -> None:
    """A quoted file list, in the order of names."""
    files.orderBy("name").select(P.manifest_line(F.col("path"), slashes).alias("value")).coalesce(1).write.mode("overwrite").text(path)

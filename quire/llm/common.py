"""Shared helpers: table reading, batch mapping, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names; with none, a temporary one on a local master, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return context.getCheckpointDir().get()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, written once to the shared checkpoint folder; its lineage is cut there."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def saved(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared checkpoint folder as Parquet and read again: its size is known, so small ones are broadcast and others are not."""
    path = f"{checkpoint_dir(frame.sparkSession)}/saved-{uuid.uuid4()}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """The folder goes, in whatever store it stands."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def frugal(run: Callable) -> Callable:
    """run for mapInArrow, giving memory back to the machine now and then and at the end: idle workers of earlier stages stay alive."""

    def wrapped(batches):
        import ctypes
        import gc

        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            for k, batch in enumerate(run(batches)):
                yield batch
                del batch
                if trim and k % 8 == 7:
                    trim(0)
        finally:
            gc.collect()
            if trim:
                trim(0)

    return wrapped


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterable[pa.RecordBatch]:
    """The same rows in pieces whose text is about most_bytes, so that one piece's working set stays small."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        per_row = max(1, batch.column(batch.schema.get_field_index(column)).nbytes // rows)
        step = max(1, most_bytes // per_row)
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def map_rows(frame: DataFrame, schema: str, make: Callable[[], Callable], text: str) -> DataFrame:
    """mapInArrow with a per-task function: make() runs once a task and gives f(*columns as lists) -> list of output columns."""
    types = _arrow_schema(frame.sparkSession, schema)

    def run(batches):
        handle = make()
        for batch in small_batches(batches, text):
            out = handle(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, types)], schema=types)

    return frame.mapInArrow(frugal(run), schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))

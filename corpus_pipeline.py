"""From documents to token ids: filtered, deduplicated, decontaminated, redacted, encoded.

STAGES lists (name, function) in order; each function takes (spark, docs,
sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs.  All but the last return the columns of documents.

Every stage takes whole texts of any length, null values in any column, an
empty table, repeated rows and further columns of any name, which all but the
last one keep.  What each makes of them is said where it is defined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, decontaminate, jaccard, pii, toxicity
from quire.llm.common import checkpoint_dir, delete, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models, trained on the labelled ones, reject go.

    A null or empty text has the score of no words, and a document that scores
    the threshold exactly goes.  Repeated rows score alike.
    """
    return toxicity.filter_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join stays: five words, a similarity of 0.8.

    Rows without a word or an id stay.  Of a component the document with the
    least id stays; of several rows of that id and text, the least row.
    """
    return jaccard.deduplicate(docs, size=5, percent=80)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A null or empty text holds none; null items and items without a letter or
    digit are held by none.  Repeated rows are judged alike.
    """
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text where it changes.

    A null text stays null; overlapping spans become one, of the first one's kind.
    """
    return pii.redact(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the text; a null or empty text has none, and repeated rows are encoded each."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_copies),
    ("PII", redact_personal_data),
    ("byte-level BPE encoding and decoding", encode_bytes),
]

#: SQL cannot express the trained models and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage gives is written to the shared checkpoint folder, read again and deleted when the next one is written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs

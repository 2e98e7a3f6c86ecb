"""Page requests as a stream: expansion keeps no state, so it runs on unbounded input unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import pages as P


def expanded(requests: DataFrame, spec: str = "pages") -> DataFrame:
    """A row for each requested page of a streaming (or batch) frame."""
    return requests.select("*", F.explode(F.array_distinct(P.page_list(F.col(spec)))).alias("page")).withColumn("file", P.page_file(F.col("page")))

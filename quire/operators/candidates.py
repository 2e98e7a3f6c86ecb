"""Candidate lists: union of sources, filtering by query, numbered picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import lookups as L
from quire.functions import pages as P


def union(*sources: DataFrame) -> DataFrame:
    """All sources' candidates, each once."""
    return reduce(DataFrame.unionByName, sources).distinct()


def filtered(candidates: DataFrame, query, column: str = "candidate", literal: bool = False, fold: bool = False) -> DataFrame:
    test = P.matches_folded if fold else P.matches_literally if literal else P.matches_terms
    return candidates.filter(test(F.col(column), query))


def shown(candidates: DataFrame, *order) -> DataFrame:
    return candidates.orderBy(*order).limit(L.SHOWN)


def picked(candidates: DataFrame, key, *order) -> DataFrame:
    """The candidate that a digit key picks among those shown, with wrap-around beyond their number."""
    few = shown(candidates, *order).withColumn("__n", F.row_number().over(Window.partitionBy().orderBy(*order)))
    few = few.withColumn("__of", F.count("*").over(Window.partitionBy()))
    return few.filter(F.col("__n") == (P.numbered_pick(key) - 1) % F.col("__of") + 1).drop("__n", "__of")

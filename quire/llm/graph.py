"""Connected components of an edge list, by contraction; nothing is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, frugal

CHUNK = 1 << 20
FINISH = 1 << 19
_EDGE = "a long, b long"


def _spanning_stars(batches):
    """Edges with the same components as each chunk of the input, as (node, least node of its tree)."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def stars():
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        a, b = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > CHUNK:
            yield stars()
    yield stars()


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges (a long, b long) but the least ones themselves.

    Each task first reduces its own edges to spanning stars.  While more than
    `finish` edges are left, each round hooks a node on its least neighbour if
    that is less than itself; pointers are followed twice, and edges are
    carried over to the trees' heads.  Heads are the least nodes of their
    trees, and at least half the nodes with edges vanish in each round.  The
    last `finish` edges or fewer are one task's stars.
    """
    left = checkpointed(edges.select("a", "b").mapInArrow(frugal(_spanning_stars), _EDGE).distinct())
    whole = None
    while left.count() > finish:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("head")))
        for _ in range(2):
            nexts = hooks.select(F.col("node").alias("__n"), F.col("head").alias("__h"))
            hooks = hooks.join(nexts, hooks["head"] == nexts["__n"]).select("node", F.col("__h").alias("head"))
        hooks = checkpointed(hooks)
        whole = hooks.select("node", F.col("head").alias("component")) if whole is None else _followed(whole, hooks.withColumnRenamed("head", "component"))
        whole = checkpointed(whole)
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("head").alias(f"h{c}"))
        moved = left.join(to("a"), "a").join(to("b"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b")).filter("a != b")
        left = checkpointed(moved.mapInArrow(frugal(_spanning_stars), _EDGE).distinct())
    last = left.repartition(1).mapInArrow(frugal(_spanning_stars), _EDGE).select(F.col("a").alias("node"), F.col("b").alias("component"))
    return checkpointed(last if whole is None else _followed(whole, last).filter("node != component"))


def _followed(whole: DataFrame, more: DataFrame) -> DataFrame:
    """whole, with each component replaced by the one that the second frame has for it."""
    nexts = more.select(F.col("component").alias("__h"), F.col("node").alias("component"))
    return whole.join(nexts, "component", "left").select("node", F.coalesce("__h", "component").alias("component"))

"""Connected components of a graph of links, over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskspan.sources.stage import stage


FEW_LINKS = 1_000_000  # so many links of one node may meet in a task
TASK_LINKS = 100_000  # links that a task of their own is worth


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One step of the alternating star method on edges (a, b), a > b.

    Every node hangs its larger neighbours (large) or its smaller neighbours and itself (small) on
    the smallest node around it. Unless the links are few altogether, the smallest nodes are stored
    before they are joined, so that the adaptive skew join can split the links of a node that has many.
    """
    if large:
        around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("u"), F.least("a", "m").alias("m"))
    if not few:
        least = stage(least, "least")
    joined = around.join(least, F.col("a") == F.col("u"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b) of long ids: the smallest id that can be
    reached. Links may repeat and point either way; a link of a node with itself is ignored.

    Each round is a stored table, so a lost executor costs one round; the rounds grow with the
    logarithm of the size of a component, and they end when the edges no longer change.
    """
    edges = stage(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
        few = state[0] <= FEW_LINKS
        hung = _star(_star(edges, True, few), False, few)
        edges = stage(hung.coalesce(1 + state[0] // TASK_LINKS), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)

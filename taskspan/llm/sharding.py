"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskspan.llm.ordering import ranked
from taskspan.sources.stage import stage

SHARDS = 24
NODES_PER_SHARD = 64
ROW_BYTES = 8  # counted for each row besides its text
_POINT_BITS = 60
_CELL_SHIFT = _POINT_BITS - 12


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def _point(label: str) -> int:
    return int(hashlib.md5(label.encode()).hexdigest()[:_POINT_BITS // 4], 16)


def ring(shards: int, nodes: int = NODES_PER_SHARD) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, by point. More shards only add nodes."""
    return sorted((_point(f"{shard}/{node}"), shard)
                  for shard in range(shards) for node in range(nodes))


def point(*columns: str) -> Column:
    """A row's point on the ring; equal texts of different documents stand at different points."""
    values = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    return F.conv(F.substring(F.md5(values), 1, _POINT_BITS // 4), 16, 10).cast("long")


def capacities(rows: int, shards: int) -> list[int]:
    """Rows that each shard may hold: together all rows, at most one apart."""
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def overflow(ring_nodes: list[tuple[int, int]], counts: dict[int, int],
             capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(node, first, last, shard, slot): which shard takes rows first..last-1 of each node's arc.

    The rows of an arc go to its node's shard. In every round a shard takes from the arcs that ask,
    in ring order, until it is full; what it can't take asks the next node clockwise whose shard has
    room. A round in which rows are left over fills a shard, so there are at most as many rounds as
    shards. The input is one count per virtual node, bounded by the ring and not by the data.
    """
    room, filled = list(capacity), [0] * len(capacity)
    waiting = [(node, node, 0, counts.get(node, 0)) for node in range(len(ring_nodes))]
    runs = []
    while waiting:
        left = []
        for node, at, first, last in waiting:
            shard = ring_nodes[at][1]
            taken = min(room[shard], last - first)
            if taken:
                runs.append((node, first, first + taken, shard, filled[shard]))
                room[shard] -= taken
                filled[shard] += taken
            if first + taken < last:
                left.append((node, at, first + taken, last))
        waiting = []
        for node, at, first, last in left:
            at = next(k % len(ring_nodes) for k in range(at + 1, at + 1 + len(ring_nodes))
                      if room[ring_nodes[k % len(ring_nodes)][1]])
            waiting.append((node, at, first, last))
    return runs


def _table(spark: SparkSession, rows: list[dict], kinds: str) -> DataFrame:
    """A small table from values the driver holds, read from a literal without a Python task."""
    values = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kinds}>>")
    return spark.range(1).select(F.inline(values))


def _arcs(spark: SparkSession, nodes: list[tuple[int, int]]) -> DataFrame:
    """(cell, after, until, node): the arcs of the ring, cut at cells of its leading bits."""
    rows, after = [], -1
    bounds = [*(at for at, _ in nodes), (1 << _POINT_BITS) - 1]
    for node, until in enumerate(bounds):
        if until > after:
            rows += [{"cell": cell, "after": after, "until": until, "node": node % len(nodes)}
                     for cell in range((after + 1) >> _CELL_SHIFT, (until >> _CELL_SHIFT) + 1)]
        after = max(after, until)
    return _table(spark, rows, "cell:long,after:long,until:long,node:int")


def shard_rows(rows: DataFrame, at: Column, shards: int = SHARDS,
               nodes: int = NODES_PER_SHARD) -> DataFrame:
    """A stored table with `shard` and `slot`, its rows placed at the points `at` of the ring.

    Law `rows`: the loads are bounded by the mean, so the counts are at most one apart. Every row
    belongs to the first virtual node at or after its point; rows that find their shard full go on
    clockwise. Slots count from 0 in each shard without gaps. An empty table stays empty. The two
    broadcast tables have a few rows per virtual node, whatever the input.
    """
    spark = rows.sparkSession
    nodes_by_point = ring(shards, nodes)
    arcs = F.broadcast(_arcs(spark, nodes_by_point))
    placed = rows.withColumn("_point", at).withColumn("_cell", F.shiftright("_point", _CELL_SHIFT))
    placed = placed.join(arcs, (F.col("_cell") == F.col("cell")) & (F.col("_point") > F.col("after"))
                         & (F.col("_point") <= F.col("until"))).drop("cell", "after", "until", "_cell")
    order = [F.col("_point"), *(F.col(c) for c in rows.columns)]
    placed = ranked(stage(placed, "points"), order, within=["node"], name="_place")
    counts = {r["node"]: r["count"] for r in placed.groupBy("node").count().collect()}
    runs = overflow(nodes_by_point, counts, capacities(sum(counts.values()), shards))
    fields = ("_node", "_first", "_last", "shard", "_slot")
    runs = _table(spark, [dict(zip(fields, run, strict=True)) for run in runs],
                  "_node:int,_first:long,_last:long,shard:int,_slot:long")
    return placed.join(F.broadcast(runs), (F.col("node") == F.col("_node"))
                       & (F.col("_place") >= F.col("_first")) & (F.col("_place") < F.col("_last"))
                       ).select(*rows.columns, "shard",
                                (F.col("_slot") + F.col("_place") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES_PER_SHARD) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, shard, slot.

    A document's point is a hash of its doc_id and text, so copies of a text spread over the ring.
    Null text: size 8, the checksum of no bytes. Null doc_id and repeated rows are placed like any
    others. Extra columns are left out.
    """
    rows = docs.select(
        "doc_id", (text_bytes("text") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return shard_rows(rows, point("doc_id", "text_crc32", "size"), shards, nodes)

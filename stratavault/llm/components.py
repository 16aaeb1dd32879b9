"""Connected components: local contraction, then alternating large-star and
small-star steps until only stars are left, or so few edges that one task's
table holds them all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Nodes that a task's table holds at most before it is sent on.
_HELD = 1 << 19


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task become stars around their smallest nodes."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x)) is not None:
            if (z := above.get(y)) is not None:
                above[x] = z
            x = y
        return x

    def stars() -> pa.RecordBatch:
        nodes = list(above)
        return pa.RecordBatch.from_pydict({"u": pa.array(nodes, pa.int64()), "v": pa.array([top(x) for x in nodes], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = top(a), top(b)
            if p != q:
                above[max(p, q)] = min(p, q)
                if len(above) >= _HELD:
                    yield stars()
                    above.clear()
    yield stars()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none if it has one up."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    found = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return found.where("down > 1 or (down > 0 and up > 0)").agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named
    after its smallest node.

    Both steps aggregate a node's neighbours to their minimum and join it back,
    so a node with very many links is only a skewed join.  Fewer than ``_HELD``
    contracted edges need no exchange: one task's table makes stars of them."""
    edges = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v")
    while True:
        edges = materialize(edges.mapInArrow(_contract, "u long, v long"), "links")
        if edges.count() < _HELD:
            edges = materialize(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), "links")
            break
        if _only_stars(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "links-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = materialize(edges, "links")
        if _only_stars(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

"""Connected components of an edge table, by alternating star contractions.

Each round makes every vertex point at the smallest vertex of its
neighbourhood, first among larger neighbours and then among smaller ones
(large-star and small-star of the published map-reduce algorithm); the edge
table converges to one star per component in O(log^2 n) rounds. Vertices and
edges stay in Spark tables throughout; every round is written to the shared
checkpoint folder. A hub with very many neighbours is met only by partial
aggregation and by plain equality joins that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import staged


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (sym.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(vertex, root)`` for every vertex that is
    not the smallest of its component; ``root`` is that smallest vertex.
    Self loops and repeated edges are ignored; an empty table gives no rows.
    """
    e = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .distinct(), "edges")
    before = _mark(e)
    while before[0]:
        e = staged(_small_star(_large_star(e)), "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("vertex"), F.col("b").alias("root"))

"""Connected components of an edge table by alternating stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): each round hangs every node below the least
node that it or its neighbours know, so chains halve and a star is reached in O(log n) rounds. Only minima are
grouped (with map-side combine) and edges are joined on their node, so a hub is an ordinary skewed join key, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyrook.session import discard, materialize


def _written(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """An edge set written and read again, its path, and a fingerprint that doesn't depend on its order, taken by the way."""
    seen = Observation()
    out, path = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("mark")), "components")
    return out, path, (seen.get["n"], seen.get["mark"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("dst", "src"))
    least = both.groupBy("src").agg(F.min("dst").alias("least"))
    return (
        both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.least("src", "least").alias("dst")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    moved = down.join(least, "src").where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.union(least.select("src", F.col("least").alias("dst"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) of any one orderable type -> (node, component): the least node of each node's component.

    Null ends and self-loops are dropped, repeated edges count once; a node without an edge to another isn't returned.
    Every round is written to the shared work folder, and the round before it deleted.
    """
    spark = edges.sparkSession
    edges = edges.where("src <> dst").distinct()
    edges, path, before = _written(edges)
    for _ in range(max_rounds if before[0] else 0):
        now, new_path, after = _written(_small_star(_large_star(edges)))
        discard(spark, path)
        edges, path = now, new_path
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    tops = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(tops)

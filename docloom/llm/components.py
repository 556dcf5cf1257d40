"""Distributed connected components by alternating star contraction.

Large-star links each vertex's larger neighbours to the least vertex near it,
small-star its smaller ones; both keep connectivity, and rounds go on until the
edges stay the same. Edges live in the cluster throughout: no vertex's neighbours
are gathered in one task (the least neighbour is a partial aggregate, joined back),
and each round is cut off by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over rows (src, dst), src < dst, without repeats."""
    if large:
        # each edge seen from both ends; a vertex takes part in the least over its whole neighbourhood
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        linked = both.where("dst > src").join(least, "src").select(F.col("dst").alias("b"), F.col("low").alias("a"))
    else:
        down = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("low"))
        linked = down.join(least, "src").select(F.col("dst").alias("b"), F.col("low").alias("a")).union(least.select(F.col("src"), F.col("low")))
    return linked.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (id, component) for every vertex of ``edges`` (src, dst): component is the least vertex reachable.

    Loops and repeated edges are fine, edges with a null end are ignored; no edges
    give no rows. A vertex that no edge names is not in the result.
    """
    src, dst = edges.columns
    named = checkpoint(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).distinct())
    loops = named.where("src = dst").select(F.col("src").alias("id"))
    now = named.where("src < dst")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    was = mark(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        now = checkpoint(_stars(_stars(now, True), False))
        if (is_now := mark(now)) == was:
            break
        was = is_now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("dst").alias("id"), F.col("src").alias("component"))
    roots = now.select(F.col("src").alias("id")).union(loops).distinct().join(stars.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return stars.union(roots)

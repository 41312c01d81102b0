"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one partial aggregate and one equi-join, so a node with very many neighbours is
pre-aggregated before the shuffle and its join partition can be split at run time. Every round
is cut off in the shared folder; rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and component (the component's smallest node) for each node with an edge.

    Loops and null ends are ignored, repeated edges count once; no edges give no rows.
    """
    here = cut(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(),
        "edges",
    )
    seen = _digest(here)
    while seen[0]:
        was, here = here, cut(_small_star(_large_star(here)), "edges")
        forget(was)
        now = _digest(here)
        if now == seen:
            break
        seen = now
    return here.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        here.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbours and itself."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return larger.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return least.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct()


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

"""Nearest points and aligned candidates of solids."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.stats import same_keys, settled

FILL = 4  # points of a cell of the finest grid, on average


def nearest_points(queries: DataFrame, points: DataFrame, query_id: str, keys: list[str], coords: list[str]) -> DataFrame:
    """keys, query_id and distance: from each query to the nearest of the points with its keys; null if there are none.

    Queries with the same keys and id are one: the least distance of them counts.

    Both sides lie on a grid of cubes. A query is compared with the points of its own and all adjoining
    cells, by an equality join; whatever lies outside these is farther off than a cell is wide, so a
    distance up to that width is final. Queries without one go on to a grid of twice the width, until it
    spans all points. Equal points are folded first. A query in a void meets the few points around it, on a
    coarser grid; work follows the points near queries rather than all pairs.
    """
    dims = range(len(coords))
    name = lambda n, k: f"_{n}{k}"
    group = [f"_key{k}" for k in range(len(keys))]
    # points with an infinite or missing coordinate are nobody's nearest
    there = lambda df: df.where(reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coords]))
    at = lambda side: [F.col(c).cast("double").alias(name(side, k)) for k, c in zip(dims, coords)]
    b = settled(there(points).select(*[F.col(k).alias(g) for k, g in zip(keys, group)], *at("b")).distinct())
    low_high = b.agg(F.count("*").alias("n"), *[f(name("b", k)).alias(f"{label}{k}") for k in dims for label, f in (("low", F.min), ("high", F.max))]).first()
    named = queries.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], F.col(query_id).alias("_id"), *at("a"))
    if not low_high["n"]:
        return named.select(*[F.col(g).alias(k) for k, g in zip(keys, group)], F.col("_id").alias(query_id), F.lit(None).cast("double").alias("distance"))
    span = max(max(low_high[f"high{k}"] - low_high[f"low{k}"] for k in dims), 1e-9)
    width = span / max(1.0, (low_high["n"] / FILL) ** (1 / len(coords)))
    whole = [*group, "_id"]
    without = lambda df, gone: df.join(gone.select(*[F.col(c).alias(f"_r{c}") for c in whole]), same_keys(whole, "_r"), "left_anti")
    nothing = lambda df: df.select(*whole, F.lit(None).cast("double").alias("_d")).distinct()
    open_, done = settled(there(named)), []
    reach = max([span] + [abs(x or 0) for x in open_.agg(*[F.max(F.greatest(F.col(name("a", k)) - low_high[f"low{k}"], low_high[f"high{k}"] - F.col(name("a", k)))) for k in dims]).first()])
    while True:
        cell = lambda side, k, w=width: F.floor(F.col(name(side, k)) / w).cast("long")
        here = b.select(*[F.col(g).alias(f"_p{g}") for g in group], *[F.col(name("b", k)) for k in dims], *[cell("b", k).alias(name("q", k)) for k in dims])
        around = open_
        for k in dims:
            around = around.withColumn(name("c", k), F.explode(F.array(*[cell("a", k) + F.lit(s) for s in (-1, 0, 1)])))
        on = reduce(Column.__and__, [F.col(name("c", k)) == F.col(name("q", k)) for k in dims]) & same_keys(group, "_p")
        squared = reduce(Column.__add__, [F.pow(F.col(name("a", k)) - F.col(name("b", k)), F.lit(2.0)) for k in dims])
        best = around.join(here, on).groupBy(*group, "_id").agg(F.sqrt(F.min(squared)).alias("_d"))
        last = width >= reach
        told = settled(best if last else best.where(F.col("_d") <= width))
        done.append(told)
        open_ = settled(without(open_, told))
        if last:
            break
        if not open_.limit(1).count():
            break
        width *= 2
    found = reduce(DataFrame.unionByName, done)
    found = found.unionByName(nothing(without(named, found)))  # without points of their keys, or without a place
    return found.select(*[F.col(g).alias(k) for k, g in zip(keys, group)], F.col("_id").alias(query_id), F.col("_d").alias("distance"))


def surface_distance(a: DataFrame, b: DataFrame, point_id: str, keys: list[str], coords: list[str]) -> DataFrame:
    """keys, there and back: the mean distance from each cloud's points to the nearest of the other, and chamfer, the mean of both."""
    mean = lambda x, y, n: nearest_points(x, y, point_id, keys, coords).groupBy(*keys).agg(F.avg("distance").alias(n))
    there, back = mean(a, b, "there"), mean(b, a, "back")
    other = back.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    return there.join(other, same_keys(keys, "_o_")).select(*keys, "there", "back", ((F.col("there") + F.col("back")) / 2).alias("chamfer"))


def _turns() -> list[tuple[int, tuple[int, ...]]]:
    """Number and axes of the 24 proper rotations; each order of axes has four of them."""
    return [(4 * k + turn, axes) for k, axes in enumerate(permutations(range(3))) for turn in range(4)]


@udtf(returnType="rotation int, x double, y double, z double, fits boolean")
class AlignedCandidates:
    """The rotations that bring a solid's extents near another's; the unrotated one with fits = false if none does."""

    def eval(self, extents: list, other: list, tolerance: float):
        if not extents or not other or None in extents or None in other:
            yield 0, None, None, None, False
            return
        least = tolerance * max(*other, 1e-9) + 1e-9
        found = False
        for number, axes in _turns():
            turned = [extents[k] for k in axes]
            if all(abs(p - q) <= least for p, q in zip(turned, other)):
                found = True
                yield number, *turned, True
        if not found:
            yield 0, *extents, False


def aligned_candidates(pairs: DataFrame, pred: str, gold: str, tolerance: float = 0.25) -> DataFrame:
    """pairs with rotation, x, y, z and fits: a row for each candidate, by a lateral join with the table function."""
    made = AlignedCandidates(F.col(pred).outer(), F.col(gold).outer(), F.lit(tolerance))
    return pairs.lateralJoin(made)

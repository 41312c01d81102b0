"""Geometry on axis-aligned boxes and extents; solids themselves need an outside library."""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def signature(extents: Column, n_faces: Column) -> Column:
    return F.struct(F.transform(extents, lambda x: F.round(x, 3)).alias("extents"), n_faces.alias("n_faces"))


def relative_difference(a: Column, b: Column) -> Column:
    """The largest over the axes."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y) / F.greatest(x, y, F.lit(1e-9))))


def size_agreement(a: Column, b: Column) -> Column:
    """Mean over the axes of the smaller over the larger extent; 1 for an axis without any."""
    parts = F.zip_with(a, b, lambda x, y: F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y, F.lit(1e-300))).otherwise(1.0))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)


def dims_consistent(stated: Column, extents: Column, rel: float = 0.02, tol: float = 1e-4) -> Column:
    """Null unless exactly one triple is stated; else whether it fits the extents in any order of axes."""
    pairs = F.zip_with(F.array_sort(F.get(stated, F.lit(0))), F.array_sort(extents), lambda s, e: F.abs(s - e) <= rel * F.greatest(s, e) + tol)
    return F.when((F.size(stated) == 1) & extents.isNotNull(), F.forall(pairs, lambda ok: ok))


def volume(extents: Column) -> Column:
    return F.aggregate(extents, F.lit(1.0), lambda p, x: p * x)


def iou(inter: Column, a: Column, b: Column) -> Column:
    """Of volumes, within 0 and 1; 0 for an empty union."""
    union = a + b - inter
    return F.when(union > 0, F.least(F.greatest(inter / F.when(union > 0, union), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def centered_box_iou(a: Column, b: Column) -> Column:
    """Of two boxes with one centre, given their extents."""
    return iou(volume(F.zip_with(a, b, lambda x, y: F.least(x, y))), volume(a), volume(b))


def mask_iou(a: Column, b: Column) -> Column:
    """Of two boolean arrays; 1 for an empty union."""
    count = lambda m: F.size(F.filter(m, lambda x: x))
    union = count(F.zip_with(a, b, lambda x, y: x | y))
    return F.when(union == 0, 1.0).otherwise(count(F.zip_with(a, b, lambda x, y: x & y)) / F.greatest(union, F.lit(1)))


def rotations(spark: SparkSession) -> DataFrame:
    """The 24 proper rotations onto the axes: number, axis (source axis for each target axis, from 0), sign."""
    rows = []
    for axes in permutations(range(3)):
        parity = (-1) ** sum(axes[i] > axes[j] for i in range(3) for j in range(i + 1, 3))
        rows += [(axes, signs) for signs in product((1, -1), repeat=3) if parity * signs[0] * signs[1] * signs[2] == 1]
    return spark.createDataFrame([(k, list(a), list(s)) for k, (a, s) in enumerate(rows)], "rotation int, axis array<int>, sign array<int>")


def rotated_extents(extents: Column, axis: Column) -> Column:
    return F.transform(axis, lambda k: F.get(extents, k))


def aligned_box_iou(pairs: DataFrame, pred: str, gold: str, rel_tol: float = 0.25) -> DataFrame:
    """pairs with iou_aligned: the best over the rotations whose extents come near, else plainly centred.

    Of the 24 rotations of a box only the six orders of its axes differ, so they are columns of one
    row and nothing is joined or multiplied.
    """
    scale = F.greatest(F.array_max(F.col(gold)), F.lit(1e-9))
    orders = [F.array(*[F.get(F.col(pred), F.lit(k)) for k in axes]) for axes in permutations(range(3))]
    near = [F.forall(F.zip_with(o, F.col(gold), lambda x, y: F.abs(x - y) <= rel_tol * scale + 1e-9), lambda ok: ok) for o in orders]
    best = F.greatest(*[F.when(ok, centered_box_iou(o, F.col(gold))) for o, ok in zip(orders, near)], F.lit(None).cast("double"))
    return pairs.withColumn("iou_aligned", F.coalesce(best, centered_box_iou(F.col(pred), F.col(gold))))


def reward(code: Column, runs: Column, iou_value: Column, bonus: float = 0.5) -> Column:
    """No code -0.5, failed run -0.2, else the IoU, plus a bonus from 0.9 on."""
    iou_value = F.coalesce(iou_value, F.lit(0.0))
    return F.when(code.isNull(), -0.5).when(~F.coalesce(runs, F.lit(False)), -0.2).otherwise(iou_value + F.when(iou_value >= 0.9, bonus).otherwise(0.0))


def chamfer(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with chamfer: symmetric mean nearest distance of two point clouds (array<array<double>>), over b's diagonal.

    One pair is one row; the distance table is built in blocks of points.
    """
    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            x, y = np.array([*map(list, x)], float), np.array([*map(list, y)], float)
            near = lambda p, q: sum(np.sqrt(((p[k : k + 256, None] - q[None]) ** 2).sum(2)).min(1).sum() for k in range(0, len(p), 256)) / len(p)
            out.append((near(x, y) + near(y, x)) / 2 / (float(np.linalg.norm(y.max(0) - y.min(0))) or 1.0))
        return pd.Series(out)

    return pairs.withColumn("chamfer", of(a, b))

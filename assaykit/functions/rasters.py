"""Scores of drawings given as boolean rasters (array<array<boolean>>), and the signals made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import size_agreement


def _mask(rows) -> np.ndarray:
    return np.array([list(r) for r in rows], bool)


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Exact squared distance of each cell to the nearest set cell; infinite without one.

    Two passes: along columns by running ends, then along rows as the lower envelope of a parabola over
    each column. Time is in proportion to the cells.
    """
    height, width = mask.shape
    rows = np.arange(height, dtype=float)[:, None]
    above = np.maximum.accumulate(np.where(mask, rows, -np.inf), 0)
    below = np.minimum.accumulate(np.where(mask, rows, np.inf)[::-1], 0)[::-1]
    column = np.minimum(rows - above, below - rows) ** 2
    out = np.full(mask.shape, np.inf)
    for y in range(height):
        feet, starts, f = [], [], column[y].tolist()
        for x in range(width):
            if f[x] == np.inf:
                continue
            while feet:
                cross = (f[x] + x * x - f[feet[-1]] - feet[-1] ** 2) / (2 * (x - feet[-1]))
                if cross > starts[-1]:
                    break
                feet.pop(), starts.pop()
            starts.append(cross if feet else -np.inf)
            feet.append(x)
        if feet:
            at = np.array(feet)[np.searchsorted(np.array(starts), np.arange(width), "left").clip(1) - 1]
            out[y] = (np.arange(width) - at) ** 2 + column[y][at]
    return out


WIDE = 64  # rows up to that are compared column by column, many rasters at a time; wider ones take envelopes
TOGETHER = 1 << 18  # cells


def squared_distances(masks: np.ndarray) -> np.ndarray:
    """squared_distance of many rasters of one shape (n, height, width) at a time."""
    n, height, width = masks.shape
    if width > WIDE:
        return np.stack([squared_distance(m) for m in masks])
    out, rows, columns = np.empty(masks.shape), np.arange(height, dtype=float)[:, None], np.arange(width)
    step = max(1, TOGETHER // max(1, height * width))
    for at in range(0, n, step):
        some = masks[at : at + step]
        above = np.maximum.accumulate(np.where(some, rows, -np.inf), 1)
        below = np.minimum.accumulate(np.where(some, rows, np.inf)[:, ::-1], 1)[:, ::-1]
        column = np.minimum(rows - above, below - rows) ** 2
        least = np.full(some.shape, np.inf)
        for x in range(width):
            np.minimum(least, column[:, :, x, None] + (columns - x) ** 2, out=least)
        out[at : at + step] = least
    return out


def near(mask: np.ndarray, tolerance: float) -> np.ndarray:
    """Cells within a distance of a set cell."""
    return squared_distance(mask) <= tolerance * tolerance


def distances(mask: Column) -> Column:
    """array<array<double>>: the squared distance of each cell of a raster to its nearest set cell; null without one."""

    @F.arrow_udf("array<array<double>>")
    def of(masks: pa.Array) -> pa.Array:
        heights = pc.list_value_length(masks).fill_null(0).to_numpy()
        rows = masks.flatten()
        widths = pc.list_value_length(rows).fill_null(0).to_numpy()
        cells = rows.flatten().fill_null(False).to_numpy(zero_copy_only=False)
        row, cell = (np.r_[0, np.cumsum(x)].astype(np.int32) for x in (heights, widths))
        width = np.r_[widths, 0][row[:-1]]
        if (np.repeat(width, heights) != widths).any():
            raise ValueError("a raster's rows differ in length")
        out = np.full(len(cells), np.inf)
        for h, w in np.unique(np.stack([heights, width], 1)[heights > 0], axis=0).tolist():
            mine = cell[row[:-1][(heights == h) & (width == w)]][:, None] + np.arange(h * w)
            out[mine] = squared_distances(cells[mine].reshape(-1, h, w)).reshape(mine.shape)
        inner = pa.ListArray.from_arrays(pa.array(cell), pa.array(out, mask=np.isinf(out)))
        return pa.ListArray.from_arrays(pa.array(row), inner, mask=pa.array(heights == 0))

    return of(mask)


def silhouette_iou(a: Column, b: Column) -> Column:
    """1 for two empty rasters."""

    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = [(_mask(x), _mask(y)) for x, y in zip(left, right)]
        return pd.Series([float((x & y).sum() / u) if (u := (x | y).sum()) else 1.0 for x, y in pairs])

    return of(a, b)


def edge_f1(a: Column, b: Column, tolerance: float = 2.0) -> Column:
    """Harmonic mean of the shares of each raster's cells near the other's; 1 if both are empty, 0 if one is."""

    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in ((_mask(p), _mask(q)) for p, q in zip(left, right)):
            if not x.any() or not y.any():
                out.append(float(x.any() == y.any()))
                continue
            precision, recall = near(y, tolerance)[x].mean(), near(x, tolerance)[y].mean()
            out.append(2 * precision * recall / (precision + recall) if precision + recall else 0.0)
        return pd.Series(out, dtype=float)

    return of(a, b)


def scored(df: DataFrame, candidate: str, target: str, edges: str, target_edges: str, extents: str, box: str) -> DataFrame:
    """df with silhouette, edges_score, size and render_score (silhouette times size)."""
    size = F.when(F.col(box).isNull(), 1.0).otherwise(size_agreement(F.col(extents), F.col(box)))
    made = df.withColumn("silhouette", silhouette_iou(F.col(candidate), F.col(target))).withColumn("edges_score", edge_f1(F.col(edges), F.col(target_edges))).withColumn("size", size)
    return made.withColumn("render_score", F.col("silhouette") * F.col("size"))


def signals(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, signal and score: five ways to combine silhouette, edges_score and size."""
    s, e, z = F.col("silhouette"), F.col("edges_score"), F.col("size")
    wide = df.select(*keep, s.alias("silhouette"), e.alias("edges"), z.alias("size"), (s * z).alias("silhouette x size"), ((s + e) / 2 * z).alias("mean x size"))
    return wide.unpivot(keep, ["silhouette", "edges", "size", "silhouette x size", "mean x size"], "signal", "score")

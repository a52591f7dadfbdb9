"""Components of masks as run lengths: rows of pixels become runs in SQL, and the runs of a tile are joined by union-find in numpy.

A tile's runs are a small part of its pixels (a few thousand for a page of forty megapixels), so rows of one large tile are worked out in
many tasks and only its runs meet in one. A component's name is its first pixel in reading order, ``y * ROW + x``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, ROW = "tile_id", 1 << 20


def row_runs(mask: DataFrame, key: str = KEY) -> DataFrame:
    """(tile, y, x0, x1): the runs of a mask's pixels (tile, x, y); repeated pixels count once."""
    island = F.col("x") - F.dense_rank().over(Window.partitionBy(key, "y").orderBy("x"))
    return mask.select(key, "y", "x", island.alias("island")).groupBy(key, "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def joined_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """For runs in reading order, the first run of each one's component. Runs of neighbouring rows touch if they overlap by a column, or with ``reach`` 1 a corner."""
    root = np.arange(len(y))
    if not len(y):
        return root
    wide = int(x1.max()) + 4
    ends, begins = y * wide + x1 + 2, y * wide + x0 + 2
    low = np.searchsorted(ends, (y + 1) * wide + x0 + 2 - reach)
    high = np.searchsorted(begins, (y + 1) * wide + x1 + 2 + reach, "right")
    count = np.maximum(high - low, 0)
    upper = np.repeat(root, count)
    lower = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    while True:
        a, b = root[upper], root[lower]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((jump := root[root]) != root).any():
            root = jump


def components(mask: DataFrame, eight: bool = True, key: str = KEY) -> DataFrame:
    """(tile, y, x0, x1, component): the runs of a mask with their components, by sides or also by corners."""
    name = f"`{key}`"
    gathered = row_runs(mask, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("y").cast("long").alias("y"), F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1")))).alias("r"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, x0, x1 = ([np.asarray(v.values, np.int64) for v in c] for c in b.columns[1:])
            labels = [yy[first] * ROW + a[first] for yy, a, z in zip(y, x0, x1, strict=True) for first in [joined_runs(yy, a, z, int(eight))]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tolist() for x in labels], pa.list_(pa.int64()))], [*b.schema.names, "component"])

    kind = mask.schema[key].dataType.simpleString()
    part = lambda f: F.transform("r", lambda r: r[f]).alias(f)
    out = gathered.select(key, part("y"), part("x0"), part("x1")).mapInArrow(rows, f"{name} {kind}, y array<long>, x0 array<long>, x1 array<long>, component array<long>")
    return out.select(key, F.explode(F.arrays_zip("y", "x0", "x1", "component")).alias("r")).select(key, "r.*")


def pixels(runs: DataFrame, *keep: str, key: str = KEY) -> DataFrame:
    """The pixels of runs, with ``keep`` columns."""
    return runs.select(key, *keep, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def sizes(runs: DataFrame, key: str = KEY) -> DataFrame:
    """(tile, component, pixels)."""
    return runs.groupBy(key, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))


def one_component(runs: DataFrame, key: str = KEY) -> DataFrame:
    """(tile, single): whether a tile's mask is in one piece."""
    return runs.groupBy(key).agg((F.min("component") == F.max("component")).alias("single"))


def place(component: Column, width: Column | int) -> Column:
    """A component's name as a place in a tile of a width."""
    return F.floor(component / ROW).cast("long") * width + component % ROW

"""Masks of rectangles, round rectangles and ellipses by scan lines, from formulas alone: no drawing library, no pixel is tested.

A pixel belongs to a shape if its centre does. Each row of a shape is one run (``spans``), however wide the shape is; the runs of all shapes of a
page's row are merged by one window. So a mask is a few rows for each row of a page, as :mod:`runs` has them, until someone asks for pixels.
Where only areas are asked for, no run becomes a row: :func:`shape_areas` and :func:`mask_areas` count them in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PRIMITIVES = ("polygon", "round_rectangle", "ellipse")
#: Runs that a task holds at once.
RUNS = 1 << 20


def _half_chord(across: Column, along: Column, off: Column) -> Column:
    """Half the width of an ellipse with these half axes at a distance from its middle row."""
    share = off / F.nullif(along, F.lit(0.0))
    return F.coalesce(across * F.sqrt(F.greatest(F.lit(0.0), 1 - share * share)), F.lit(0.0))


def spans(shapes: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """(keys, y, x0, x1): the rows of shapes (primitive, x, y, w, h, radius) on a canvas; primitive is polygon (a rectangle), round_rectangle or ellipse.

    A radius is half the shorter side at most. Shapes without width or height, and rows without the centre of a pixel, have no spans.
    """
    first, last = F.greatest(F.ceil(F.col("y") - 0.5), F.lit(0)), F.least(F.ceil(F.col("y") + F.col("h") - 0.5) - 1, F.lit(height - 1))
    rows = shapes.where((F.col("w") > 0) & (F.col("h") > 0)).select("*", first.cast("long").alias("first"), last.cast("long").alias("last")).where("first <= last")
    rows = rows.withColumn("row", F.explode(F.sequence("first", "last")))
    at, x, y, w, h = F.col("row") + 0.5, *(F.col(c).cast("double") for c in "xywh")
    r = F.greatest(F.lit(0.0), F.least(F.col("radius").cast("double"), w / 2, h / 2))
    corner = F.greatest(y + r - at, at - (y + h - r), F.lit(0.0))
    inset = F.when(F.col("primitive") == "round_rectangle", r - _half_chord(r, r, corner)).when(F.col("primitive") == "ellipse", w / 2 - _half_chord(w / 2, h / 2, at - (y + h / 2))).otherwise(F.lit(0.0))
    left, right = F.greatest(F.ceil(x + inset - 0.5), F.lit(0)), F.least(F.ceil(x + w - inset - 0.5) - 1, F.lit(width - 1))
    out = rows.select(*keys, F.col("row").alias("y"), left.cast("long").alias("x0"), right.cast("long").alias("x1"))
    return out.where("x0 <= x1")


def merged(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, y, x0, x1): runs that overlap or touch as one."""
    before = Window.partitionBy(*keys, "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    begins = spans.withColumn("new", F.coalesce(F.col("x0") > F.max("x1").over(before) + 1, F.lit(True)).cast("int"))
    run = F.sum("new").over(Window.partitionBy(*keys, "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return begins.withColumn("run", run).groupBy(*keys, "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def areas(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, pixels, runs) of runs that don't overlap."""
    return spans.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"), F.count(F.lit(1)).alias("runs"))


def _coded(shapes: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """keys, p (place in PRIMITIVES), x, y, w, h, radius, first and last row on the canvas; shapes without rows are left out."""
    p = F.array_position(F.array(*map(F.lit, PRIMITIVES)), F.col("primitive")) - 1
    out = shapes.where((F.col("w") > 0) & (F.col("h") > 0)).select(*keys, F.greatest(p, F.lit(0)).cast("int").alias("p"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("x", "y", "w", "h", "radius")))
    first, last = F.greatest(F.ceil(F.col("y") - 0.5), F.lit(0)), F.least(F.ceil(F.col("y") + F.col("h") - 0.5) - 1, F.lit(height - 1))
    return out.withColumns({"first": first.cast("long"), "last": last.cast("long")}).where("first <= last")


def _runs(p: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, radius: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last column) of the shapes' runs in their rows, by the formulas of :func:`spans`; empty ones have last < first."""
    at, inset = row + 0.5, np.zeros(len(row))
    k = np.nonzero(p == 1)[0]
    if len(k):
        r = np.maximum(0.0, np.minimum(np.minimum(radius[k], w[k] / 2), h[k] / 2))
        off = np.maximum(np.maximum(y[k] + r - at[k], at[k] - (y[k] + h[k] - r)), 0.0)
        share = np.divide(off, r, out=np.zeros(len(k)), where=r > 0)
        inset[k] = r - r * np.sqrt(np.maximum(0.0, 1 - share * share))
    k = np.nonzero(p == 2)[0]
    if len(k):
        share = (at[k] - (y[k] + h[k] / 2)) / (h[k] / 2)
        inset[k] = w[k] / 2 - w[k] / 2 * np.sqrt(np.maximum(0.0, 1 - share * share))
    return np.maximum(np.ceil(x + inset - 0.5), 0).astype(np.int64), np.minimum(np.ceil(x + w - inset - 0.5) - 1, width - 1).astype(np.int64)


def _cuts(counts: np.ndarray) -> list[tuple[int, int]]:
    """Neighbours dealt into slices of at most RUNS in all, one at least."""
    ends, out, at = np.cumsum(counts), [], 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUNS, "right")))
        out.append((at, to))
        at = to
    return out


def shape_areas(shapes: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """(keys, pixels, runs) of each shape alone, as ``areas(spans(...))`` of shapes with keys of their own. A rectangle's rows are alike and are multiplied."""
    coded = _coded(shapes, width, height, *keys)
    fields = T.StructType([*(coded.schema[k] for k in keys), T.StructField("pixels", T.LongType()), T.StructField("runs", T.LongType())])
    arrow = to_arrow_schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "x", "y", "w", "h", "radius")]
            first, last = (batch.column(c).to_numpy() for c in ("first", "last"))
            high = last - first + 1
            listed = np.where(shape[0] == 0, 1, high)
            pixels, runs = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
            for a, b in _cuts(listed):
                n = listed[a:b]
                which = np.repeat(np.arange(a, b), n)
                row = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                x0, x1 = _runs(*(c[which] for c in shape), row, width)
                size = np.maximum(x1 - x0 + 1, 0)
                starts = np.cumsum(n) - n
                pixels[a:b], runs[a:b] = np.add.reduceat(size, starts), np.add.reduceat((size > 0).astype(np.int64), starts)
            alike = np.where(shape[0] == 0, high, 1)
            out = pa.RecordBatch.from_arrays([*(batch.column(k).cast(arrow.field(k).type) for k in keys), pa.array(pixels * alike), pa.array(runs * alike)], schema=arrow)
            yield out.filter(pa.array(runs > 0))

    return coded.mapInArrow(rows, fields)


def _united(page: np.ndarray, row: np.ndarray, x0: np.ndarray, x1: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
    """Runs (page, row, x0, x1), sorted, with those that overlap or touch as one. A row's runs are shifted behind those of the row before, so one maximum tells."""
    shift = (page * (1 << 20) + row) * (wide + 2)
    order = np.argsort(shift + x0, kind="stable")
    page, row, begin, end = page[order], row[order], (shift + x0)[order], (shift + x1)[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1] + 1
    at = np.nonzero(new)[0]
    last = np.append(at[1:], len(begin))[: len(at)] - 1
    shift = shift[order][at]
    return page[at], row[at], begin[at] - shift, reach[last] - shift


def mask_areas(shapes: DataFrame, width: int, height: int, key: str) -> DataFrame:
    """(key, pixels, runs) of a page's whole mask, as ``areas(merged(spans(...)))``. A page's shapes meet in one row, and their runs are united piece by piece.

    What a task holds is RUNS at once, and the runs of a page's mask so far, which are half its pixels at most.
    """
    each = _coded(shapes, width, height, key)
    columns = ("p", "x", "y", "w", "h", "radius", "first", "last")
    pages = each.groupBy(key).agg(*(F.collect_list(F.col(c)).alias(c) for c in columns))
    fields = T.StructType([each.schema[key], T.StructField("pixels", T.LongType()), T.StructField("runs", T.LongType())])
    arrow = to_arrow_schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in columns]
            *shape, first, last = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
            page = np.repeat(np.arange(batch.num_rows), lists[0].value_lengths().to_numpy(zero_copy_only=False))
            high = last - first + 1
            pixels, runs = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            held = tuple(np.zeros(0, np.int64) for _ in range(4))
            for a, b in _cuts(high):
                n = high[a:b]
                which = np.repeat(np.arange(a, b), n)
                row = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                x0, x1 = _runs(*(c[which] for c in shape), row, width)
                there = x1 >= x0
                new = (page[which][there], row[there], x0[there], x1[there])
                held = _united(*(np.concatenate(c) for c in zip(held, new, strict=True)), width)
                done = held[0] < (page[b] if b < len(page) else batch.num_rows)
                pixels += np.bincount(held[0][done], (held[3] - held[2] + 1)[done], batch.num_rows).astype(np.int64)
                runs += np.bincount(held[0][done], minlength=batch.num_rows)
                held = tuple(c[~done] for c in held)
            out = pa.RecordBatch.from_arrays([batch.column(key).cast(arrow.field(key).type), pa.array(pixels), pa.array(runs)], schema=arrow)
            yield out.filter(pa.array(runs > 0))

    return pages.mapInArrow(rows, fields)

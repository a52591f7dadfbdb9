"""Operators over boxes and text lines of many pages. Every join carries the page's key, so a page's pairs stay in one task's group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import geometry as g
from strataframe.functions.text import font_estimate

PAGE = "slide_id"


def clipped_to_canvas(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes within the canvas, empty ones dropped, and a column was_clipped."""
    b = g.box()
    c = g.clip(b, width, height)
    others = [x for x in rows.columns if x not in "xywh"]
    return rows.where(g.nonempty(c)).select(*others, *c.named(), g.differs(b, c).alias("was_clipped"))


def clip_warnings(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Pages with any box that was cut or dropped."""
    b = g.box()
    c = g.clip(b, width, height)
    return rows.groupBy(PAGE).agg(F.bool_or(g.differs(b, c) | ~g.nonempty(c)).alias("out_of_bounds_clipped"))


def merged_lines(lines: DataFrame) -> DataFrame:
    """Adjacent lines of a text block as one row.

    A line joins the one before if the gap between them, their left edges and font sizes are close; the comparison is always with
    the line right before, so this is gaps and islands: one sort, a running sum of breaks, one aggregate.
    """
    order = Window.partitionBy(PAGE).orderBy("source_index")
    prev = g.Box(*(F.lag(c).over(order) for c in "xywh"))
    b = g.box()
    font, before = font_estimate(b.h), font_estimate(prev.h)
    gap = b.y - prev.bottom
    joins = (
        (gap >= 0)
        & (gap <= F.greatest(F.lit(4.0), F.least(b.h, prev.h) * 0.75))
        & (F.abs(b.x - prev.x) <= F.greatest(F.lit(4.0), F.least(font, before) * 0.5))
        & (F.greatest(font, before) / F.least(font, before) <= 1.2)
    )
    marked = lines.withColumn("breaks", F.when(joins, 0).otherwise(1)).withColumn("font", font)
    grouped = marked.withColumn("block", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(PAGE, "block").agg(
        F.min("source_index").alias("first_index"),
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_index", "text"))), lambda s: s["text"]), "\n").alias("text"),
        *union_box(b),
        g.hundredths(F.median("font")).alias("font_px"),
    ).drop("block")


def union_box(b: g.Box) -> list[Column]:
    return [F.min(b.x).alias("x"), F.min(b.y).alias("y"), (F.max(b.right) - F.min(b.x)).alias("w"), (F.max(b.bottom) - F.min(b.y)).alias("h")]


def paired(left: DataFrame, right: DataFrame, on: Column | None = None, how: str = "inner", key: str = PAGE) -> DataFrame:
    """Rows of the same page beside each other, as a. and b."""
    same = F.col(f"a.{key}") == F.col(f"b.{key}")
    return left.alias("a").join(right.alias("b"), same if on is None else same & on, how)


class _Sides:
    """The boxes of both sides of :func:`paired`; columns need a running session, so they are made when asked for."""

    @property
    def A(self) -> g.Box:
        return g.box(of="a")

    @property
    def B(self) -> g.Box:
        return g.box(of="b")


sides = _Sides()


def overlapping_pairs(rows: DataFrame, measure: str = "iou", least: float = 0.25, also: Column | None = None, ident: str = "ord") -> DataFrame:
    """(slide_id, a, b, overlap) of the pairs a before b whose measure reaches ``least``. Boxes that don't meet are left out before the division."""
    meet = (sides.A.x < sides.B.right) & (sides.B.x < sides.A.right) & (sides.A.y < sides.B.bottom) & (sides.B.y < sides.A.bottom)
    on = (F.col(f"a.{ident}") < F.col(f"b.{ident}")) & meet & (also if also is not None else F.lit(True))
    value = g.iou(sides.A, sides.B) if measure == "iou" else g.overlap_of_smaller(sides.A, sides.B)
    return paired(rows, rows, on).select(F.col(f"a.{PAGE}").alias(PAGE), F.col(f"a.{ident}").alias("a"), F.col(f"b.{ident}").alias("b"), value.alias("overlap")).where(F.col("overlap") >= least)


def overlapping_pairs_by_tile(rows: DataFrame, width: int, tile: int = 256, least: float = 0.25, ident: str = "ord") -> DataFrame:
    """The same for pages with very many boxes: boxes are filed under the tiles they cover, and a pair counts in its first common tile only."""
    b = g.box()
    columns = F.explode(F.sequence(F.floor(b.x / tile), F.floor((b.right - 1) / tile)))
    filed = rows.withColumn("tx", columns).withColumn("ty", F.explode(F.sequence(F.floor(b.y / tile), F.floor((b.bottom - 1) / tile))))
    first = (F.col("a.tx") == F.floor(F.greatest(sides.A.x, sides.B.x) / tile)) & (F.col("a.ty") == F.floor(F.greatest(sides.A.y, sides.B.y) / tile))
    on = (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty")) & (F.col(f"a.{ident}") < F.col(f"b.{ident}")) & first
    return paired(filed, filed, on).select(F.col(f"a.{PAGE}").alias(PAGE), F.col(f"a.{ident}").alias("a"), F.col(f"b.{ident}").alias("b"), g.iou(sides.A, sides.B).alias("overlap")).where(F.col("overlap") >= least)


def best_match(rows: DataFrame, hints: DataFrame, value: str, least: float = 0.5, ident: str = "ord", hint_order: str = "ord") -> DataFrame:
    """Each row with the value of the hint that overlaps it most (more than ``least``; the first of equals), or null."""
    found = paired(rows, hints, g.iou(sides.A, sides.B) > least).select(F.col(f"a.{PAGE}").alias(PAGE), F.col(f"a.{ident}").alias(ident), F.struct(g.iou(sides.A, sides.B).alias("o"), (-F.col(f"b.{hint_order}")).alias("first"), F.col(f"b.{value}").alias("v")).alias("m"))
    top = found.groupBy(PAGE, ident).agg(F.max("m").alias("m")).select(PAGE, ident, F.col("m.v").alias(f"best_{value}"))
    return rows.join(top, [PAGE, ident], "left")


def without_overlap(rows: DataFrame, others: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows that no other overlaps by more than ``least``."""
    return paired(rows, others, g.iou(sides.A, sides.B) > least, "left_anti")


def first_container(rows: DataFrame, panels: DataFrame, ident: str = "ord") -> DataFrame:
    """Each row with the first panel that its centre is in, or null."""
    found = paired(rows, panels, g.centre_inside(sides.A, sides.B)).groupBy(F.col(f"a.{PAGE}").alias(PAGE), F.col(f"a.{ident}").alias(ident)).agg(F.min(f"b.{ident}").alias("panel"))
    return rows.join(found, [PAGE, ident], "left")


def major_icons(elements: DataFrame) -> DataFrame:
    return elements.where((F.col("conf") >= 80) & (F.least("w", "h") >= 24) & (F.col("w") * F.col("h") >= 1600))


def element_kinds(elements: DataFrame) -> DataFrame:
    """Kind and extraction by shape and confidence (columns rectangle, conf, radius)."""
    native = F.col("rectangle") & (F.col("conf") >= 85)
    return elements.withColumns(
        {
            "kind": F.when(native, "shape").otherwise("asset"),
            "shape": F.when(native, F.when(F.col("radius") > 0, "roundRect").otherwise("rect")),
            "extraction": F.when(~native, F.when(F.col("rectangle"), "rectangular").otherwise("transparent")),
        }
    )


def manifest_order(elements: DataFrame) -> DataFrame:
    return elements.withColumn("place", F.row_number().over(Window.partitionBy(PAGE).orderBy("z", "ord")).cast("long"))


def grid_places(elements: DataFrame, columns: int = 3, cell_w: int = 320, cell_h: int = 220, thumb_w: int = 288, thumb_h: int = 152) -> DataFrame:
    """Cells of a review grid of at most three columns, and the scale of each thumbnail."""
    order, page = Window.partitionBy(PAGE).orderBy("z", "ord"), Window.partitionBy(PAGE)
    k, n = F.row_number().over(order) - 1, F.count(F.lit(1)).over(page)
    per_row = F.least(F.lit(columns), n)
    scale = F.least(F.lit(thumb_w) / F.col("w"), F.lit(thumb_h) / F.col("h"))
    return elements.select(PAGE, "ord", (k % per_row * cell_w).cast("long").alias("cell_x"), (F.floor(k / per_row) * cell_h).cast("long").alias("cell_y"), g.hundredths(scale).alias("scale"))


def exploded_offsets(elements: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes moved apart: directions NW, NE, SW, SE by turns, an eighth of the smaller side and eight pixels at least, kept on the canvas."""
    k = (F.row_number().over(Window.partitionBy(PAGE).orderBy("z", "ord")) - 1) % 4
    step = F.greatest(F.lit(8), g.half_up(F.least("w", "h") / 8))
    x = F.col("x") + F.when(k.isin(0, 2), -step).otherwise(step)
    y = F.col("y") + F.when(k.isin(0, 1), -step).otherwise(step)
    return elements.select(PAGE, "ord", F.greatest(F.lit(0), F.least(x, F.lit(width) - F.col("w"))).cast("long").alias("x"), F.greatest(F.lit(0), F.least(y, F.lit(height) - F.col("h"))).cast("long").alias("y"))

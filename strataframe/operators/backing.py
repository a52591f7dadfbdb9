"""Surfaces that carry text: the text is taken off, and the surface must hold on its own.

Tables (by tile_id): ``cut`` (x, y, a), the alpha of the surface as it was cut out, for every pixel of its crop; ``source`` (x, y, r, g, b, a);
``texts`` (text_id, carried, x, y, w, h), the text boxes of the tile; ``glyphs`` (text_id, x, y, core), pixels of carried texts, a little wider than
the glyphs, ``core`` being the glyphs themselves; ``inks`` (text_id, r, g, b).

Stages, each one's table feeding the next: support (what is not outside: holes inside the cut-out, such as glyphs of the background's colour,
belong to it), boxes on it, the plane through the surface's colours, repair from the surface, residue of glyphs, seam, the plane again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators import raster_udf, runs
from strataframe.operators.durable import large, stored
from strataframe.operators.hidden import distance

KEY, PIXEL, RGB = "tile_id", ["tile_id", "x", "y"], ("r", "g", "b")
#: Alpha that counts as there and as surface; limits of the plane's residual, of glyphs that stay, of the seam and of an ink's blend; samples.
SUPPORT, SURFACE, RESIDUAL, STAYS, GONE, SEAM, BLEND, SAMPLES = 16, 128, 18, 0.02, 24, 8, 8, 16
_SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def _beside(pixels: DataFrame, *keep: str) -> DataFrame:
    """The four pixels beside each pixel, with ``keep`` columns of it."""
    steps = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in _SIDES))
    return pixels.select(KEY, *keep, F.explode(steps).alias("p")).select(KEY, *keep, "p.x", "p.y")


def support(cut: DataFrame) -> DataFrame:
    """(tile, x, y, a, inside): the cut-out with its enclosed holes opaque: whatever is not reached from the crop's edge through pixels that aren't opaque, corners counting."""
    ends = [f(F.col(c)).alias(f"{n}{c}") for c in "xy" for n, f in (("low_", F.min), ("high_", F.max))]
    box = cut.groupBy(KEY).agg(*ends)
    open_ = large(runs.components(cut.where("a < 255")), "open")
    edge = (F.col("y") == F.col("low_y")) | (F.col("y") == F.col("high_y")) | (F.col("x0") == F.col("low_x")) | (F.col("x1") == F.col("high_x"))
    outside = open_.join(box, KEY).groupBy(KEY, "component").agg(F.bool_or(edge).alias("outside")).where("outside")
    reached = runs.pixels(open_.join(outside.select(KEY, "component"), [KEY, "component"], "left_semi")).withColumn("reached", F.lit(True))
    out = cut.join(reached, PIXEL, "left")
    return out.select(*PIXEL, F.when(F.col("reached"), F.col("a")).otherwise(255).cast("long").alias("a"), F.col("reached").isNull().alias("inside"))


def boxes_fit(texts: DataFrame, support: DataFrame) -> DataFrame:
    """(tile, fits): carried boxes lie wholly on the surface, others don't meet the cut-out."""
    left, top, right, bottom = F.floor("x"), F.floor("y"), F.ceil(F.col("x") + F.col("w")), F.ceil(F.col("y") + F.col("h"))
    one = texts.select(KEY, "text_id", "carried", left.alias("l"), top.alias("t"), right.alias("e"), bottom.alias("b"))
    on = support.where(F.col("a") >= SUPPORT)
    met = one.join(on, KEY).where("x >= l and x < e and y >= t and y < b").groupBy(KEY, "text_id").agg(F.count_if(F.col("a") >= SURFACE).alias("solid"), F.count(F.lit(1)).alias("any"))
    each = one.join(met, [KEY, "text_id"], "left").fillna(0, ["solid", "any"])
    whole = F.col("solid") == (F.col("e") - F.col("l")) * (F.col("b") - F.col("t"))
    return each.groupBy(KEY).agg((F.bool_and(F.when(F.col("carried"), whole).otherwise(F.col("any") == 0)) & F.bool_or("carried")).alias("fits"))


def eliminated(rows: np.ndarray) -> np.ndarray:
    """Solutions of many systems of three equations (n, 3, 3 + k) at once, by elimination with row pivots; NaN where a pivot is below 1e-9."""
    a = rows.astype(float).copy()
    n, fine = np.arange(len(a)), np.ones(len(a), bool)
    for c in range(3):
        pivot = c + np.abs(a[:, c:, c]).argmax(axis=1)
        a[n, c], a[n, pivot] = a[n, pivot].copy(), a[n, c].copy()
        fine &= np.abs(a[:, c, c]) >= 1e-9
        a[:, c] /= np.where(fine, a[:, c, c], 1)[:, None]
        for r in range(3):
            if r != c:
                a[:, r] -= a[:, r, c, None] * a[:, c]
    a[~fine] = np.nan
    return a[:, :, 3:]


def surface_residual(source: DataFrame, surface: DataFrame, excluded: DataFrame) -> DataFrame:
    """(tile, samples, residual): p95 of what the best plane leaves of the colours inside a surface (a >= SURFACE, and so are all four neighbours) beyond ``excluded``; infinity if there are too few samples or no plane.

    Sums are aggregated in SQL, six and three for each channel; only they go through numpy, a row for each tile.
    """
    solid = surface.where(F.col("a") >= SURFACE).select(*PIXEL)
    inner = _beside(solid).groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("n")).where("n = 4").select(*PIXEL)
    samples = large(solid.join(inner, PIXEL, "left_semi").join(excluded.select(*PIXEL).distinct(), PIXEL, "left_anti").join(source.select(*PIXEL, *RGB), PIXEL), "surface")
    ends = samples.groupBy(KEY).agg(F.count(F.lit(1)).alias("samples"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.lit(1), F.max("x") - F.min("x")).alias("sx"), F.greatest(F.lit(1), F.max("y") - F.min("y")).alias("sy"))
    scaled = samples.join(ends, KEY).withColumns({"u": (F.col("x") - F.col("x0")) / F.col("sx"), "t": (F.col("y") - F.col("y0")) / F.col("sy")})
    products = {"su": "u", "st": "t", "suu": "u * u", "sut": "u * t", "stt": "t * t"} | {f"s{p}{c}": f"{e} * {c}" for c in RGB for p, e in (("", "1"), ("u", "u"), ("t", "t"))}
    sums = scaled.groupBy(KEY, "samples").agg(*(F.sum(F.expr(e).cast("double")).alias(n) for n, e in products.items())).where(F.col("samples") >= SAMPLES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = {n: np.asarray(b.column(n).to_numpy(zero_copy_only=False), float) for n in ("samples", *products)}
            left = [[v["samples"], v["su"], v["st"]], [v["su"], v["suu"], v["sut"]], [v["st"], v["sut"], v["stt"]]]
            system = np.array([[*line, *(v[f"s{p}{c}"] for c in RGB)] for line, p in zip(left, ("", "u", "t"), strict=True)]).transpose(2, 0, 1)
            found = eliminated(system)
            out = [pa.array(found[:, k, j], pa.float64(), from_pandas=True) for j in range(3) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(KEY), *out], [KEY, *(f"{n}{c}" for c in RGB for n in ("p0", "pu", "pt"))])

    schema = f"{KEY} {source.schema[KEY].dataType.simpleString()}, " + ", ".join(f"{n}{c} double" for c in RGB for n in ("p0", "pu", "pt"))
    planes = sums.select(KEY, F.col("samples").cast("double").alias("samples"), *products).mapInArrow(rows, schema).where("p0r is not null")
    off = F.greatest(*(F.abs(F.col(c) - (F.col(f"p0{c}") + F.col(f"pu{c}") * F.col("u") + F.col(f"pt{c}") * F.col("t"))) for c in RGB)).alias("off")
    rest = scaled.join(planes, KEY).select(KEY, off).groupBy(KEY).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY off)").alias("residual"))
    every = surface.select(KEY).distinct().join(ends.select(KEY, "samples"), KEY, "left").join(rest, KEY, "left")
    return every.select(KEY, F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("residual", F.lit(float("inf"))).alias("residual"))


def repaired_surface(source: DataFrame, mask: DataFrame, surface: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tile, repair_reason; tile, x, y, r, g, b filled): ``mask`` filled from ``surface`` (a >= SURFACE) alone, tile by tile, cut to what is near the surface."""
    solid = surface.select(*PIXEL, (F.col("a") >= SURFACE).alias("solid"))
    pixel = source.join(solid, PIXEL).join(mask.select(*PIXEL).distinct().withColumn("on", F.lit(True)), PIXEL, "left")
    packed = F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("int").alias("c"), (F.coalesce("on", F.lit(False)).cast("int") + F.col("solid").cast("int") * 2).alias("f"))
    gathered = pixel.groupBy(KEY).agg(F.collect_list(packed).alias("p"))
    part = lambda f: F.transform("p", lambda p: p[f]).alias(f)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reasons, _, filled = raster_udf.repaired_lists(*(b.column(n) for n in ("y", "x", "c", "f")), surface=True)
            yield pa.RecordBatch.from_arrays([b.column(0), reasons, filled], [KEY, "repair_reason", "filled"])

    kind = source.schema[KEY].dataType.simpleString()
    out = gathered.select(KEY, part("y"), part("x"), part("c"), part("f")).mapInArrow(rows, f"{KEY} {kind}, repair_reason string, filled array<struct<x: long, y: long, r: long, g: long, b: long>>")
    out = large(out, "surfaces")
    return out.select(KEY, "repair_reason"), out.select(KEY, F.explode("filled").alias("f")).select(KEY, "f.*")


def seam(after: DataFrame, mask: DataFrame, surface: DataFrame) -> DataFrame:
    """(tile, seam): p95 of the steps between filled pixels and the surface beside them."""
    there = mask.select(*PIXEL).distinct()
    filled = there.join(after.select(*PIXEL, *RGB), PIXEL).select(*PIXEL, *(F.col(c).alias(f"f{c}") for c in RGB))
    across = _beside(filled, *(f"f{c}" for c in RGB)).join(surface.where(F.col("a") >= SURFACE).select(*PIXEL), PIXEL, "left_semi").join(there, PIXEL, "left_anti").join(after.select(*PIXEL, *RGB), PIXEL)
    step = distance(tuple(F.col(c) for c in RGB), tuple(F.col(f"f{c}") for c in RGB)).alias("step")
    return across.select(KEY, step).groupBy(KEY).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY step)").alias("seam"))


def blends(before: tuple[Column, ...], after: tuple[Column, ...], ink: tuple[Column, ...]) -> Column:
    """Whether a pixel was a mixture of the ink and the repaired surface."""
    along = reduce(Column.__add__, [(b - a) * (i - a) for b, a, i in zip(before, after, ink, strict=True)])
    length = reduce(Column.__add__, [(i - a) * (i - a) for a, i in zip(after, ink, strict=True)])
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / F.nullif(length, F.lit(0))))
    return F.coalesce(reduce(Column.__and__, [F.abs(b - (a + share * (i - a))) <= BLEND for b, a, i in zip(before, after, ink, strict=True)]), F.lit(False))


def extracted(cut: DataFrame, source: DataFrame, texts: DataFrame, glyphs: DataFrame, inks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes: tile, accepted, reason, residue, seam, residual; assets of accepted tiles: tile, x, y, r, g, b, a)."""
    held = large(support(cut), "support")
    fits = boxes_fit(texts, held)
    mask = glyphs.select(*PIXEL).distinct().withColumn("on", F.lit(True))
    # Alpha is given back where text stood on enclosed holes; the mask keeps what lies on the surface then.
    both = large(cut.select(*PIXEL, F.col("a").alias("own")).join(held, PIXEL).join(mask, PIXEL, "left").withColumn("on", F.coalesce("on", F.lit(False))), "both")
    alpha = both.select(*PIXEL, F.when(F.col("on"), F.col("a")).otherwise(F.col("own")).alias("a"), "on", (F.col("on") & (F.col("a") > F.col("own"))).alias("given"))
    surface = large(alpha, "alpha")
    repair = surface.where(F.col("on") & (F.col("a") >= SURFACE)).select(*PIXEL)
    first = surface_residual(source, surface, repair).select(KEY, F.col("residual").alias("first"))
    reasons, filled = repaired_surface(source, repair, surface)
    new = filled.select(*PIXEL, *(F.col(c).alias(f"f{c}") for c in RGB))
    after = large(source.join(new, PIXEL, "left").select(*PIXEL, *(F.coalesce(f"f{c}", c).alias(c) for c in RGB), *(F.col(c).alias(f"s{c}") for c in RGB), "a"), "after")
    now, old = tuple(F.col(c) for c in RGB), tuple(F.col(f"s{c}") for c in RGB)
    core = glyphs.where("core").select(*PIXEL, "text_id").join(surface.select(*PIXEL, F.col("a").alias("alpha"), "given"), PIXEL).join(after, PIXEL)
    stays = core.where(F.col("alpha") >= SURFACE).select(*PIXEL, distance(now, old).alias("d")).distinct().groupBy(KEY).agg((F.count_if(F.col("d") < GONE) / F.count(F.lit(1))).alias("residue"))
    ink = inks.select(KEY, "text_id", *(F.col(c).alias(f"i{c}") for c in RGB))
    odd = core.where("given").join(ink, [KEY, "text_id"]).groupBy(KEY).agg(F.bool_and(blends(old, now, tuple(F.col(f"i{c}") for c in RGB))).alias("blended"))
    last = surface_residual(after, surface, repair).select(KEY, F.col("residual").alias("last"))
    out = cut.select(KEY).distinct()
    for part in (fits, first, reasons, stays, odd, seam(after, repair, surface), last):
        out = out.join(part, KEY, "left")
    residue, step = F.coalesce("residue", F.lit(1.0)), F.coalesce("seam", F.lit(0)).cast("long")
    reason = (
        F.when(~F.coalesce("fits", F.lit(False)), "backing_mask_invalid").when(F.coalesce("first", F.lit(float("inf"))) > RESIDUAL, "surface_unstable").when(F.col("repair_reason") == "surface_variance_too_high", "repair_seam")
        .when(F.col("repair_reason").isNotNull(), "surface_unstable").when(~F.coalesce("blended", F.lit(True)) | (residue > STAYS), "glyph_residue").when(step > SEAM, "repair_seam").when(F.coalesce("last", F.lit(float("inf"))) > RESIDUAL, "surface_unstable")
    )
    result = stored(out.select(KEY, reason.isNull().alias("accepted"), reason.alias("reason"), residue.alias("residue"), step.alias("seam"), F.col("first").alias("residual")), "backings")
    asset = surface.join(result.where("accepted").select(KEY), KEY, "left_semi").select(*PIXEL, F.col("a").alias("alpha")).join(after.select(*PIXEL, *RGB), PIXEL)
    return result, asset.select(*PIXEL, *RGB, F.col("alpha").alias("a"))

"""Evidence for completing an object behind another, on pixel tables (tile_id, x, y): joins by offsets and aggregates.

Three masks of a tile are the input: ``visible`` (the rear object), ``occluder`` (what lies in front) and ``hidden`` (where the rear object is
to go on). Offsets are exploded from the smaller side (contacts and hidden pixels), so a pixel becomes at most 49 rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, PIXEL = "tile_id", ["tile_id", "x", "y"]
#: Pixels around a contact that are sampled, and samples that a colour needs.
RADIUS, SAMPLES = 3, 8
#: A contact's side, and where the hidden pixel beside it lies.
SIDES = {"left": (1, 0), "right": (-1, 0), "top": (0, 1), "bottom": (0, -1)}


def _around(pixels: DataFrame, radius: int, width: int, height: int, *keep: str) -> DataFrame:
    """The pixels of the square around each pixel, inside the tile."""
    step = F.sequence(F.lit(-radius), F.lit(radius))
    out = pixels.select(KEY, *keep, "y", F.explode(F.transform(step, lambda d: F.col("x") + d)).alias("x"))
    out = out.select(KEY, *keep, "x", F.explode(F.transform(step, lambda d: F.col("y") + d)).alias("y"))
    return out.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).distinct()


def contact_sides(visible: DataFrame, hidden: DataFrame) -> DataFrame:
    """(tile_id, x, y, side): visible pixels beside a hidden one, and on which side of it they are."""
    each = [hidden.select(KEY, (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(side).alias("side")) for side, (dx, dy) in SIDES.items()]
    return reduce(DataFrame.union, each).join(visible.select(*PIXEL), PIXEL).distinct()


def rear_samples(visible: DataFrame, hidden: DataFrame, occluder: DataFrame, opaque: DataFrame, width: int, height: int, ends: DataFrame | None = None) -> DataFrame:
    """(tile_id, x, y): samples of the rear object around ``ends`` (all of it by default). Both opposite sides must have contacts and SAMPLES samples each; left and right go before top and bottom."""
    contacts = contact_sides(visible if ends is None else ends, hidden)
    has = contacts.groupBy(KEY).agg(*(F.bool_or(F.col("side") == s).alias(s) for s in SIDES))
    axis = F.when(F.col("left") & F.col("right"), F.array(F.lit("left"), F.lit("right"))).when(F.col("top") & F.col("bottom"), F.array(F.lit("top"), F.lit("bottom")))
    wanted = has.select(KEY, F.explode(axis).alias("side"))
    free = visible.select(*PIXEL).join(hidden.select(*PIXEL), PIXEL, "left_anti").join(occluder.select(*PIXEL), PIXEL, "left_anti").join(opaque.select(*PIXEL), PIXEL, "left_semi")
    near = _around(contacts.join(wanted, [KEY, "side"], "left_semi"), RADIUS, width, height, "side").join(free, PIXEL)
    enough = near.groupBy(KEY, "side").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLES).groupBy(KEY).agg(F.count(F.lit(1)).alias("sides")).where("sides = 2")
    return near.join(enough, KEY, "left_semi").select(*PIXEL).distinct()


def background_samples(visible: DataFrame, hidden: DataFrame, occluder: DataFrame, opaque: DataFrame, width: int, height: int) -> DataFrame:
    """(tile_id, x, y): opaque pixels around hidden ones that are neither visible nor of the occluder."""
    near = _around(hidden, RADIUS, width, height)
    return near.join(visible.select(*PIXEL), PIXEL, "left_anti").join(occluder.select(*PIXEL), PIXEL, "left_anti").join(opaque.select(*PIXEL), PIXEL, "left_semi")


def source_samples(visible: DataFrame, hidden: DataFrame, occluder: DataFrame, opaque: DataFrame, width: int, height: int) -> DataFrame:
    """(tile_id, rear, front, background, enough): how many samples each colour has; each needs SAMPLES."""
    front = hidden.select(*PIXEL).join(occluder.select(*PIXEL), PIXEL, "left_semi").join(opaque.select(*PIXEL), PIXEL, "left_semi")
    parts = {"rear": rear_samples(visible, hidden, occluder, opaque, width, height), "front": front, "background": background_samples(visible, hidden, occluder, opaque, width, height)}
    rows = reduce(DataFrame.union, [df.select(KEY, F.lit(name).alias("what")) for name, df in parts.items()])
    counts = [F.count_if(F.col("what") == name).alias(name) for name in parts]
    out = hidden.select(KEY).distinct().join(rows.groupBy(KEY).agg(*counts), KEY, "left").fillna(0, list(parts))
    return out.select(KEY, *parts, reduce(Column.__and__, [F.col(p) >= SAMPLES for p in parts]).alias("enough"))


def geometry_faults(visible: DataFrame, hidden: DataFrame, contacts: DataFrame, width: int, height: int) -> DataFrame:
    """(tile_id, fault): contacts out of the tile, pixels that are visible and hidden, masks without a pixel."""
    out = contacts.where(~(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))).select(KEY, F.lit("contact_outside").alias("fault"))
    both = visible.select(*PIXEL).join(hidden.select(*PIXEL), PIXEL, "left_semi").select(KEY, F.lit("visible_and_hidden"))
    tiles = contacts.select(KEY).distinct()
    none = [tiles.join(m.select(KEY), KEY, "left_anti").select(KEY, F.lit(f"no_{name}")) for name, m in (("visible", visible), ("hidden", hidden))]
    return reduce(DataFrame.union, [out, both, *none]).distinct()


def bridged_pairs(pairs: DataFrame, generated: DataFrame) -> DataFrame:
    """Each evidence component and whether one generated component touches both ends of one of its pairs.

    pairs: tile_id, evidence, ax, ay, bx, by; generated: tile_id, x, y, component. Two pixels touch if they share a side.
    """
    beside = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in SIDES.values()))
    touched = generated.select(KEY, "component", F.explode(beside).alias("p")).select(KEY, "component", "p.x", "p.y").distinct()
    a, b = (touched.select(KEY, "component", F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y")) for s in "ab")
    hit = pairs.join(a, [KEY, "ax", "ay"]).join(b, [KEY, "component", "bx", "by"]).select(KEY, "evidence").distinct().withColumn("hit", F.lit(True))
    return pairs.select(KEY, "evidence").distinct().join(hit, [KEY, "evidence"], "left").select(KEY, "evidence", F.coalesce("hit", F.lit(False)).alias("bridged"))


def row_pairs(contacts: DataFrame) -> DataFrame:
    """(tile_id, ax, ay, bx, by): contacts left and right of something hidden, in one row, the nearest after each left one."""
    left = contacts.where("side = 'left'").select(KEY, F.col("x").alias("ax"), F.col("y").alias("ay"))
    right = contacts.where("side = 'right'").select(KEY, F.col("x").alias("bx"), F.col("y").alias("ay"))
    return left.join(right, [KEY, "ay"]).where("bx > ax").groupBy(KEY, "ax", "ay").agg(F.min("bx").alias("bx")).withColumn("by", F.col("ay"))


def outcome(requested: Column, geometry: Column, samples: Column, bridged: Column, single: Column) -> Column:
    """What becomes of a completion: the first check that fails names it."""
    return (
        F.when(~requested, "skipped:not_requested").when(~geometry, "rejected:invalid_geometry").when(~samples, "rejected:insufficient_evidence").when(~bridged, "rejected:contacts_not_bridged").when(~single, "rejected:separate_parts").otherwise("accepted")
    )


def crop_is_canonical(canvas: tuple[Column, Column], crop: tuple[Column, ...], box: tuple[Column, ...], padding: Column) -> Column:
    """A crop (x, y, w, h) inside the canvas but not all of it, that holds a box and reaches no further around it than the padding."""
    (cw, ch), (x, y, w, h), (bx, by, bw, bh) = canvas, crop, box
    inside = (cw > 0) & (ch > 0) & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= cw) & (y + h <= ch)
    whole = (x == 0) & (y == 0) & (w == cw) & (h == ch)
    holds = (x <= bx) & (y <= by) & (x + w >= bx + bw) & (y + h >= by + bh)
    near = (bx - x <= padding) & (by - y <= padding) & (x + w - bx - bw <= padding) & (y + h - by - bh <= padding)
    return inside & ~whole & holds & near

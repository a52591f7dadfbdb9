"""Boxes as four columns: expressions that stay inside the JVM. Boxes are (x, y, w, h) in pixels unless said otherwise."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_SIDE, MIN_SIDE, MAX_SIDE = 13.333, 1.0, 56.0  # inches of a page's sides
CROP_PADDING, EDGE = 0.05, 1e-9


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip("xywh", self, strict=True)]


def box(prefix: str = "", of: str = "") -> Box:
    """The columns x, y, w, h, with a prefix, of an alias."""
    return Box(*(F.col(f"{of}.{prefix}{n}" if of else prefix + n) for n in "xywh"))


def half_up(v: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(v + 0.5)


def hundredths(v: Column) -> Column:
    return F.floor(v * 100 + 0.5) / 100


def clip(b: Box, width: Column | int, height: Column | int) -> Box:
    """Within the canvas; a box without area afterwards has w or h of zero or less (see :func:`nonempty`)."""
    width, height = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    x, y = F.greatest(b.x, F.lit(0)), F.greatest(b.y, F.lit(0))
    return Box(x, y, F.least(b.right, width) - x, F.least(b.bottom, height) - y)


def nonempty(b: Box) -> Column:
    return (b.w > 0) & (b.h > 0)


def differs(a: Box, b: Box) -> Column:
    return (a.x != b.x) | (a.y != b.y) | (a.w != b.w) | (a.h != b.h)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    h = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 if the union is empty."""
    both = intersection(a, b)
    return _ratio(both, a.area + b.area - both)


def overlap_of_smaller(a: Box, b: Box) -> Column:
    return _ratio(intersection(a, b), F.least(a.area, b.area))


def centre_inside(inner: Box, outer: Box) -> Column:
    """Edges count."""
    cx, cy = inner.x + inner.w / 2, inner.y + inner.h / 2
    return (cx >= outer.x) & (cx <= outer.right) & (cy >= outer.y) & (cy <= outer.bottom)


def to_pixels(b: Box, width: Column | int, height: Column | int) -> Box:
    """A box in 0..1 on the canvas: its edges are rounded, a pixel at least stays."""
    width, height = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    left, top = F.least(half_up(b.x * width), width - 1), F.least(half_up(b.y * height), height - 1)
    right, bottom = F.greatest(half_up(b.right * width), left + 1), F.greatest(half_up(b.bottom * height), top + 1)
    return Box(left, top, F.least(right, width) - left, F.least(bottom, height) - top)


def from_crop(b: Box, crop: Box, width: Column | int, height: Column | int) -> Box:
    """A box in 0..1 of a crop, as one in 0..1 of the canvas."""
    return Box((crop.x + b.x * crop.w) / width, (crop.y + b.y * crop.h) / height, b.w * crop.w / width, b.h * crop.h / height)


def padded_crop(b: Box, width: int, height: int, ratio: float = CROP_PADDING) -> Box:
    """Whole pixels around a box in 0..1, with a twentieth of each side and one pixel at least as padding."""
    left, top, right, bottom = F.floor(b.x * width), F.floor(b.y * height), F.ceil(b.right * width), F.ceil(b.bottom * height)
    px, py = F.greatest(F.lit(1), F.ceil((right - left) * ratio)), F.greatest(F.lit(1), F.ceil((bottom - top) * ratio))
    x, y = F.greatest(F.lit(0), left - px), F.greatest(F.lit(0), top - py)
    return Box(x, y, F.least(F.lit(width), right + px) - x, F.least(F.lit(height), bottom + py) - y)


def expand(b: Box, by: Column | int, width: int, height: int) -> Box:
    x, y = F.greatest(F.lit(0), F.floor(b.x - by)), F.greatest(F.lit(0), F.floor(b.y - by))
    return Box(x, y, F.least(F.lit(width), F.ceil(b.right + by)) - x, F.least(F.lit(height), F.ceil(b.bottom + by)) - y)


def touches_edge(b: Box, eps: float = EDGE) -> Column:
    """Of a box in 0..1."""
    return (b.x <= eps) | (b.y <= eps) | (b.right >= 1 - eps) | (b.bottom >= 1 - eps)


def inside_canvas(b: Box, width: Column | int, height: Column | int) -> Column:
    return (b.x >= 0) & (b.y >= 0) & nonempty(b) & (b.right <= width) & (b.bottom <= height)


def layout_inches(width: Column, height: Column) -> tuple[Column, Column]:
    """Width and height of the page in inches; null where the sides leave 1..56 inches."""
    long, short = F.greatest(width, height), F.least(width, height)
    ratio = long.cast("double") / short
    small = F.lit(LONG_SIDE) / ratio
    long_in = F.when(small >= MIN_SIDE, F.lit(LONG_SIDE)).otherwise(ratio * MIN_SIDE)
    short_in = F.when(small >= MIN_SIDE, small).otherwise(F.lit(MIN_SIDE))
    ok = (long_in <= MAX_SIDE) & (short_in >= MIN_SIDE)
    return F.when(ok, F.when(width >= height, long_in).otherwise(short_in)), F.when(ok, F.when(width >= height, short_in).otherwise(long_in))


def inches(b: Box, width: Column, height: Column) -> Box:
    wide, high = layout_inches(width, height)
    return Box(b.x * wide / width, b.y * high / height, b.w * wide / width, b.h * high / height)


def points(pixels: Column, width: Column, height: Column) -> Column:
    return pixels * layout_inches(width, height)[1] * 72 / height


def widened(b: Box, tracking: Column, width: int, by: int = 16) -> Box:
    """Room for tracked text, clipped to the canvas."""
    return Box(b.x, b.y, F.when(tracking > 0, F.least(b.w + by, F.lit(width) - b.x)).otherwise(b.w), b.h)


def dilation_radius(h: Column) -> Column:
    return F.least(F.greatest(half_up(h / 24), F.lit(1)), F.lit(3))


def supported_canvas(width: Column, height: Column) -> Column:
    """The reason why a canvas isn't supported, else null."""
    long, short = F.greatest(width, height), F.least(width, height)
    return F.when((short < 64) | (long > 8192), "side").when(width * height > 40_000_000, "pixels").when(long > short * 56, "aspect")


def colour_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(*(F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)))


def hex_colour(s: Column) -> Column:
    """(r, g, b) of six hex digits, else null."""
    part = lambda k: F.conv(F.substring(s, k, 2), 16, 10).cast("int")
    return F.when(s.rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def colour_step(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The greatest distance of a channel."""
    return F.greatest(*(F.abs(x - y) for x, y in zip(a, b, strict=True)))


def colour_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0)))

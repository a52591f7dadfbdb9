"""Raster operators on pixel tables (tile, x, y, value): joins and aggregates, no Python. ``key`` is the tile's column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "tile_id"


def nearest_rank(v: str, p: float = 0.95) -> Column:
    """Percentile by nearest rank: the value at place ceil(p n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {v})")


def floor_index(v: str, p: float = 0.95) -> Column:
    """The other percentile: the value at index min(n - 1, floor(p n)) of the sorted values."""
    s = F.array_sort(F.collect_list(v))
    return F.element_at(s, F.least(F.size(s) - 1, F.floor(F.size(s) * p)).cast("int") + 1)


def median_and_deviation(pixels: DataFrame, value: str = "v", key: str = KEY) -> DataFrame:
    """(tile, median, mad): the median, and the median of the distances from it."""
    mid = pixels.groupBy(key).agg(F.median(value).alias("median"))
    return pixels.join(mid, key).groupBy(key, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def percentiles(pixels: DataFrame, value: str = "v", key: str = KEY) -> DataFrame:
    return pixels.groupBy(key).agg(nearest_rank(value).alias("p95_rank"), floor_index(value).alias("p95_index"))


def recomposition(source: DataFrame, made: DataFrame, ignored: DataFrame | None = None, value: str = "v", key: str = KEY) -> DataFrame:
    """Mean error, p95 (floor index) and share of changed pixels (a step over 24), and whether the gate lets the tile pass.

    With no pixel to compare the tile is rejected, while the metrics are 0.
    """
    both = source.select(key, "x", "y", F.col(value).alias("s")).join(made.select(key, "x", "y", F.col(value).alias("m")), [key, "x", "y"])
    if ignored is not None:
        both = both.join(ignored.select(key, "x", "y"), [key, "x", "y"], "left_anti")
    d = both.withColumn("d", F.abs(F.col("s") - F.col("m")))
    out = d.groupBy(key).agg(F.count(F.lit(1)).alias("compared"), F.sum("d").alias("total"), floor_index("d").alias("p95"), F.count_if(F.col("d") > 24).alias("changed"))
    out = source.select(key).distinct().join(out, key, "left")
    mae, ratio = F.try_divide("total", "compared"), F.try_divide("changed", "compared")
    return out.select(key, F.coalesce("compared", F.lit(0)).alias("compared"), F.coalesce(mae, F.lit(0.0)).alias("mae"), F.coalesce("p95", F.lit(0)).alias("p95"), F.coalesce(ratio, F.lit(0.0)).alias("changed_ratio"), F.coalesce((mae <= 3) & (F.col("p95") <= 12) & (ratio <= 0.02), F.lit(False)).alias("passed"))


def mask_metrics(mask: DataFrame, width: int, height: int, on: int = 128, key: str = KEY) -> DataFrame:
    """Shares of foreground, soft edge and opaque border, sides touched and completeness (a quarter lost for each side), and the proposal gate."""
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    fore, border = v >= on, (x == 0) | (y == 0) | (x == width - 1) | (y == height - 1)
    rim, total = 2 * (width + height) - 4, width * height
    sides = sum((F.max((fore & s).cast("int")) for s in (x == 0, y == 0, x == width - 1, y == height - 1)), F.lit(0))
    out = mask.groupBy(key).agg(
        (F.count_if(fore) / total).alias("foreground_ratio"), (F.count_if((v > 0) & (v < 255)) / total).alias("soft_ratio"),
        (F.count_if(fore & border) / rim).alias("opaque_border_ratio"), sides.cast("long").alias("sides"), (1 - sides / 4).alias("completeness"),
    )
    return out.withColumn("acceptable", F.col("foreground_ratio").between(0.01, 0.95) & (F.col("opaque_border_ratio") <= 0.02) & (F.col("completeness") >= 0.5))


def extraction_reason(transparent: Column, border: Column) -> Column:
    """Why an extracted asset falls back to its rectangle (the first failing gate), or null."""
    return F.when(transparent < 0.05, "too_little_transparency").when(transparent > 0.92, "too_much_transparency").when(border > 0.02, "opaque_border")


def mask_or(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    return a.select(key, "x", "y", "v").unionByName(b.select(key, "x", "y", "v")).groupBy(key, "x", "y").agg(F.max("v").alias("v"))


def mask_minus(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    return a.join(b.select(key, "x", "y"), [key, "x", "y"], "left_anti")


def mask_and(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    return a.join(b.select(key, "x", "y"), [key, "x", "y"], "left_semi")


def dilated(mask: DataFrame, radius: int, width: int, height: int, key: str = KEY) -> DataFrame:
    """The square neighbourhood's greatest value, on the canvas only."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    out = mask.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select(key, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "v")
    return out.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).groupBy(key, "x", "y").agg(F.max("v").alias("v"))


def placed(mask: DataFrame, dx: Column | int, dy: Column | int, width: int, height: int) -> DataFrame:
    """A local mask on its canvas."""
    out = mask.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
    return out.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def removal_mask(asset: DataFrame, dx: int, dy: int, width: int, height: int, support: int = 16, radius: int = 2, key: str = KEY) -> DataFrame:
    """What an asset covers, a little more, on the canvas."""
    on = asset.where(F.col("v") >= support).withColumn("v", F.lit(255))
    return dilated(placed(on, dx, dy, width, height), radius, width, height, key)


def _covered(start: str, size: str) -> Column:
    return F.sequence(F.floor(start), F.ceil(F.col(start) + F.col(size)) - 1)


def filled_rectangle(boxes: DataFrame, key: str = KEY) -> DataFrame:
    """Pixels of boxes (x, y, w, h)."""
    b = boxes.select(key, F.explode(_covered("x", "w")).alias("x"), "y", "h")
    return b.select(key, "x", F.explode(_covered("y", "h")).alias("y"), F.lit(255).alias("v"))


def filled_counts(boxes: DataFrame, *keys: str) -> DataFrame:
    """How many pixels :func:`filled_rectangle` makes of each box, without making them."""
    return boxes.select(*keys, (F.size(_covered("x", "w")).cast("long") * F.size(_covered("y", "h"))).alias("pixels"))


def overlap_ratio(a: DataFrame, b: DataFrame, on: int = 128, key: str = KEY) -> DataFrame:
    """The share of a's pixels that b has too."""
    left, right = a.where(F.col("v") >= on).select(key, "x", "y"), b.where(F.col("v") >= on).select(key, "x", "y", F.lit(1).alias("hit"))
    return left.join(right, [key, "x", "y"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("pixels"), F.count("hit").alias("shared"), (F.count("hit") / F.count(F.lit(1))).alias("ratio"))


def ring(pixels: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """The pixels right around the box left..right-1, top..bottom-1."""
    x, y = F.col("x"), F.col("y")
    near = x.between(left - 1, right) & y.between(top - 1, bottom)
    return pixels.where(near & ~(x.between(left, right - 1) & y.between(top, bottom - 1)))


def edge_consistency(pixels: DataFrame, width: int, height: int, tolerance: int, key: str = KEY) -> DataFrame:
    """The median of the rim and the share of the rim within ``tolerance`` of it."""
    rim = pixels.where((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1))
    mid = rim.groupBy(key).agg(F.median("v").alias("edge"))
    return rim.join(mid, key).groupBy(key, "edge").agg((F.count_if(F.abs(F.col("v") - F.col("edge")) <= tolerance) / F.count(F.lit(1))).alias("share"))


def local_variation(pixels: DataFrame, key: str = KEY) -> DataFrame:
    """p95 of the steps to the right and lower neighbours."""
    steps = []
    for dx, dy in ((1, 0), (0, 1)):
        other = pixels.select(key, (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("v").alias("o"))
        steps.append(pixels.join(other, [key, "x", "y"]).select(key, F.abs(F.col("v") - F.col("o")).alias("d")))
    return steps[0].union(steps[1]).groupBy(key).agg(nearest_rank("d").alias("p95"))


def plane_fit(pixels: DataFrame, scale_x: float, scale_y: float, key: str = KEY) -> DataFrame:
    """Least-squares plane v = a + b x + c y of each tile (coordinates in 0..1), by the normal equations' six sums; null if singular; and p95 of what is left."""
    p = pixels.withColumns({"u": F.col("x") / scale_x, "t": F.col("y") / scale_y})
    s = p.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("u").alias("su"), F.sum("t").alias("st"), F.sum(F.col("u") * F.col("u")).alias("suu"), F.sum(F.col("t") * F.col("t")).alias("stt"), F.sum(F.col("u") * F.col("t")).alias("sut"),
        F.sum("v").cast("double").alias("sv"), F.sum(F.col("u") * F.col("v")).alias("suv"), F.sum(F.col("t") * F.col("v")).alias("stv"),
    )
    det = "n*(suu*stt-sut*sut) - su*(su*stt-sut*st) + st*(su*sut-suu*st)"
    a = "sv*(suu*stt-sut*sut) - su*(suv*stt-sut*stv) + st*(suv*sut-suu*stv)"
    b = "n*(suv*stt-sut*stv) - sv*(su*stt-sut*st) + st*(su*stv-suv*st)"
    c = "n*(suu*stv-suv*sut) - su*(su*stv-suv*st) + sv*(su*sut-suu*st)"
    s = s.withColumn("det", F.expr(det)).where("abs(det) >= 1e-9").select(key, F.expr(f"({a})/det").alias("a"), F.expr(f"({b})/det").alias("b"), F.expr(f"({c})/det").alias("c"))
    left = p.join(s, key).withColumn("r", F.abs(F.col("v") - (F.col("a") + F.col("b") * F.col("u") + F.col("c") * F.col("t"))))
    return left.groupBy(key, "a", "b", "c").agg(nearest_rank("r").alias("residual_p95"))


def palette_profile(samples: DataFrame, key: str = KEY, least: int = 8, spread: float = 6, apart: float = 36) -> DataFrame:
    """Medians of rear, front and background samples (column part), and whether they qualify: enough of each, each close together, all apart."""
    mid = samples.groupBy(key, "part").agg(F.median("v").alias("m"), F.count(F.lit(1)).alias("n"))
    dev = samples.join(mid, [key, "part"]).groupBy(key, "part", "m", "n").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY abs(v - m))").alias("dev"))
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    wide = dev.groupBy(key).agg(*(pick(p, c).alias(f"{p}_{c}") for p in ("rear", "front", "background") for c in ("m", "n", "dev")))
    enough = F.least(*(F.coalesce(f"{p}_n", F.lit(0)) for p in ("rear", "front", "background"))) >= least
    close = F.greatest(*(F.col(f"{p}_dev") for p in ("rear", "front", "background"))) <= spread
    far = F.least(F.abs(F.col("rear_m") - F.col("front_m")), F.abs(F.col("rear_m") - F.col("background_m")), F.abs(F.col("front_m") - F.col("background_m"))) >= apart
    return wide.withColumn("qualified", F.coalesce(enough & close & far, F.lit(False)))


def palette_classes(pixels: DataFrame, profile: DataFrame, key: str = KEY, near: float = 12) -> DataFrame:
    """Counts of pixels by the nearest of the profile's colours within ``near``, else unknown."""
    d = {p: F.abs(F.col("v") - F.col(f"{p}_m")) for p in ("rear", "front", "background")}
    least = F.least(*d.values())
    kind = F.when(least.isNull() | (least > near), "unknown").when(d["rear"] == least, "rear").when(d["front"] == least, "front").otherwise("background")
    return pixels.join(profile, key).groupBy(key, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def stroke_width(mask: DataFrame, on: int = 128, key: str = KEY) -> DataFrame:
    """Median over the pixels of the shorter of the horizontal and vertical run through each (runs are gaps and islands)."""
    out = mask.where(F.col("v") >= on).select(key, "x", "y")
    for along, across, name in (("x", "y", "hrun"), ("y", "x", "vrun")):
        island = F.col(along) - F.row_number().over(Window.partitionBy(key, across).orderBy(along))
        out = out.withColumn("island", island).withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key, across, "island"))).drop("island")
    return out.groupBy(key).agg(F.median(F.least("hrun", "vrun")).alias("stroke"))


def owners(changed: DataFrame, layers: DataFrame, key: str = KEY, opaque: int = 254) -> DataFrame:
    """Which layers answer for changed pixels: those from the top down to the first opaque one; a pixel with one owner is attributed.

    changed: (tile, x, y); layers: (tile, layer, z, x, y, v).
    """
    over = Window.partitionBy(key, "x", "y").orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, -1)
    hit = changed.select(key, "x", "y").join(layers.where("v > 0"), [key, "x", "y"])
    seen = hit.withColumn("covered", F.coalesce(F.max("v").over(over) >= opaque, F.lit(False))).where("not covered")
    per = seen.groupBy(key, "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("layer").alias("layer"))
    return per.groupBy(key, F.when(F.col("n") == 1, F.col("layer")).alias("owner")).agg(F.count(F.lit(1)).alias("pixels"))


def confined(mask: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """Pixels whose centres are outside the box become transparent."""
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    inside = (cx >= x) & (cx < x + w) & (cy >= y) & (cy < y + h)
    return mask.withColumn("v", F.when(inside, F.col("v")).otherwise(0))


def cleared(pixels: DataFrame, hidden: DataFrame, key: str = KEY) -> DataFrame:
    """Hidden pixels as transparent black."""
    h = hidden.select(key, "x", "y", F.lit(True).alias("gone"))
    return pixels.join(h, [key, "x", "y"], "left").withColumn("v", F.when(F.col("gone"), 0).otherwise(F.col("v"))).drop("gone")


def unchanged_outside(a: DataFrame, b: DataFrame, mask: DataFrame, key: str = KEY) -> DataFrame:
    """Whether two rasters agree wherever the mask is off."""
    both = a.select(key, "x", "y", F.col("v").alias("s")).join(b.select(key, "x", "y", F.col("v").alias("m")), [key, "x", "y"])
    return mask_minus(both, mask.where("v >= 128"), key).groupBy(key).agg(F.bool_and(F.col("s") == F.col("m")).alias("unchanged"))

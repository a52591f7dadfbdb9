"""From candidates to a page: repair of all that was taken out, whole-page recomposition, and the loop that takes back what fails.

Tables (all by tile_id): ``source`` (x, y, r, g, b, a); ``owners`` (owner, required, x, y), the pixels that each element takes out, texts being
required; ``layers`` (owner, z, strict, x, y, r, g, b, a), the pixels that elements put back; ``ignored`` (x, y), pixels that aren't compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators import candidates, raster_udf
from strataframe.operators.durable import large, removed, stored

KEY, PIXEL, RGB = "tile_id", ["tile_id", "x", "y"], ("r", "g", "b")
#: A ring grows by a pixel at least in each step, so what lies farther than this from a mask never counts for its repair.
MARGIN = raster_udf.RING + 1
CHANGED, OPAQUE, MEAN, P95, SHARE = 24, 254, 3, 12, 0.02


def group_repairs(source: DataFrame, owners: DataFrame) -> DataFrame:
    """(tile, owner_group, members, reason, masked, ring, mad, p95, filled): one repair for each group of owners whose masks share pixels.

    A group sees the pixels around it only, so a page with many groups is many units of work.
    """
    groups = stored(candidates.owner_groups(owners.select(KEY, "owner", "x", "y")), "groups")
    masks = large(owners.join(groups, [KEY, "owner"]).select(*PIXEL, "owner_group").distinct(), "masks")
    members = groups.groupBy(KEY, "owner_group").agg(F.array_sort(F.collect_set("owner")).alias("members"))
    ends = [f(F.col(c)).alias(f"{n}{c}") for c in "xy" for n, f in (("low_", F.min), ("high_", F.max))]
    boxes = masks.groupBy(KEY, "owner_group").agg(*ends)
    near = [F.col(c).between(F.col(f"low_{c}") - MARGIN, F.col(f"high_{c}") + MARGIN) for c in "xy"]
    crops = source.join(boxes, KEY).where(near[0] & near[1]).join(masks.withColumn("on", F.lit(True)), [*PIXEL, "owner_group"], "left")
    pixel = F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("int").alias("c"), F.coalesce("on", F.lit(False)).cast("int").alias("on"))
    gathered = crops.groupBy(KEY, "owner_group").agg(F.collect_list(pixel).alias("p"))
    part = lambda f: F.transform("p", lambda p: p[f]).alias(f)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reasons, metrics, filled = raster_udf.repaired_lists(*(b.column(n) for n in ("y", "x", "c", "on")))
            made = [pa.array([m[n] for m in metrics], t) for n, t in (("masked", pa.int64()), ("ring", pa.int64()), ("mad", pa.float64()), ("p95", pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), reasons, *made, filled], [KEY, "owner_group", "reason", "masked", "ring", "mad", "p95", "filled"])

    schema = f"{KEY} long, owner_group string, reason string, masked long, ring long, mad double, p95 double, filled array<struct<x: long, y: long, r: long, g: long, b: long>>"
    done = gathered.select(F.col(KEY).cast("long").alias(KEY), "owner_group", part("y"), part("x"), part("c"), part("on")).mapInArrow(rows, schema)
    return done.join(members, [KEY, "owner_group"])


def union_repair(source: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All or nothing for each tile of ``source``: (tile, accepted, reason, failing, masked, ring, mad, p95), and the filled pixels (tile, x, y, r, g, b) of accepted tiles.

    ``failing`` has all owners of groups that could not be repaired, ``reason`` is that of the first such group; a tile without owners is accepted.
    """
    groups = large(group_repairs(source, owners), "repairs")
    failed = F.col("reason").isNotNull()
    total = groups.groupBy(KEY).agg(
        (~F.bool_or(failed)).alias("accepted"), F.min_by("reason", F.when(failed, F.col("owner_group"))).alias("reason"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(failed, F.col("members")))))).alias("failing"),
        F.sum("masked").alias("masked"), F.sum("ring").alias("ring"), F.max("mad").alias("mad"), F.max("p95").alias("p95"),
    )
    out = source.select(KEY).distinct().join(total, KEY, "left").withColumn("accepted", F.coalesce("accepted", F.lit(True)))
    out = out.withColumn("failing", F.coalesce("failing", F.array().cast("array<string>"))).fillna(0, ["masked", "ring", "mad", "p95"])
    out = stored(out.withColumn("reason", F.when(~F.col("accepted"), F.col("reason"))), "unions")
    pixel = groups.join(out.where("accepted").select(KEY), KEY, "left_semi").select(KEY, F.explode("filled").alias("f"))
    return out, pixel.select(KEY, "f.*")


def filled_in(source: DataFrame, filled: DataFrame) -> DataFrame:
    """``source`` with the filled pixels in their places."""
    new = filled.select(*PIXEL, *(F.col(c).alias(f"f{c}") for c in RGB))
    return source.join(new, PIXEL, "left").select(*PIXEL, *(F.coalesce(f"f{c}", c).alias(c) for c in RGB), "a")


def stacked(layers: DataFrame) -> DataFrame:
    """(tile, x, y, stack): the layers that show anything at a pixel, from the lowest to the highest (ties: by name)."""
    one = F.struct("z", "owner", "strict", *RGB, "a")
    return layers.where("a > 0").groupBy(*PIXEL).agg(F.array_sort(F.collect_list(one)).alias("stack"))


def source_over(base: tuple[Column, ...], stack: Column) -> Column:
    """The colours of a pixel after its layers, each over what is below it."""
    mixed = lambda acc, s, c: F.floor((s[c] * s["a"] + acc[c] * (255 - s["a"])) / 255 + 0.5).cast("long").alias(c)
    start = F.struct(*(b.cast("long").alias(c) for b, c in zip(base, RGB, strict=True)))
    return F.aggregate(stack, start, lambda acc, s: F.struct(*(mixed(acc, s, c) for c in RGB)))


def seen_layers(stack: Column) -> Column:
    """Of a stack, the layers from the highest down to the first that is opaque: those that may answer for the pixel."""
    down = F.reverse(stack)
    stop = F.array_position(F.transform(down, lambda s: s["a"] >= OPAQUE), True)
    return F.when(stop > 0, F.slice(down, 1, stop.cast("int"))).otherwise(down)


def whole_page(source: DataFrame, background: DataFrame, layers: DataFrame, ignored: DataFrame) -> DataFrame:
    """(tile, accepted, attribution, affected, compared, mae, p95, changed): layers over the background against the source, and which of them a failure is traced to.

    A changed pixel under exactly one layer is traced to it; under none or several it makes the tile ambiguous. A strict layer may have no changed pixel.
    """
    base = background.select(*PIXEL, *(F.col(c).alias(f"b{c}") for c in RGB))
    both = source.select(*PIXEL, *RGB).join(base, PIXEL).join(ignored.select(*PIXEL).distinct(), PIXEL, "left_anti").join(stacked(layers), PIXEL, "left")
    stack = F.coalesce("stack", F.array().cast(f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in layers.select('z', 'owner', 'strict', *RGB, 'a').schema)}>>"))
    both = both.withColumn("over", source_over(tuple(F.col(f"b{c}") for c in RGB), stack))
    steps = [F.abs(F.col(c) - F.col(f"over.{c}")) for c in RGB]
    judged = both.select(KEY, F.greatest(*steps).alias("step"), (steps[0] + steps[1] + steps[2]).alias("total"), seen_layers(stack).alias("seen"))
    judged = judged.withColumn("seen", F.when(F.col("step") > CHANGED, F.col("seen")))
    one = F.when(F.size("seen") == 1, F.element_at("seen", 1)["owner"])
    by_step = judged.groupBy(KEY, "step").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"), F.collect_set(one).alias("affected"), F.array_distinct(F.flatten(F.collect_set(F.transform(F.filter("seen", lambda s: s["strict"]), lambda s: s["owner"])))).alias("violators"),
        F.coalesce(F.bool_or(F.col("seen").isNotNull() & (F.size("seen") != 1)), F.lit(False)).alias("ambiguous"),
    )
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    tile = by_step.groupBy(KEY).agg(
        F.sum("n").alias("compared"), F.sum("total").alias("total"), F.sum(F.when(F.col("step") > CHANGED, F.col("n")).otherwise(0)).alias("changed"), flat("affected").alias("affected"), flat("violators").alias("violators"),
        F.bool_or("ambiguous").alias("ambiguous"), F.array_sort(F.collect_list(F.struct("step", "n"))).alias("steps"),
    )
    at = F.least(F.col("compared") - 1, F.floor(F.col("compared") * 0.95))
    rank = F.aggregate("steps", F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("v")), lambda acc, s: F.struct((acc["below"] + s["n"]).alias("below"), F.coalesce(acc["v"], F.when(acc["below"] + s["n"] > at, s["step"].cast("long"))).alias("v")))["v"]
    out = source.select(KEY).distinct().join(tile.withColumn("p95", rank), KEY, "left").fillna(0, ["compared", "total", "changed", "p95"])
    mae, share = F.try_divide("total", F.col("compared") * 3), F.try_divide("changed", "compared")
    strict = F.size("violators") > 0
    fine = F.coalesce((mae <= MEAN) & (F.col("p95") <= P95) & (share <= SHARE) & ~strict, F.lit(False))
    unsure = F.coalesce("ambiguous", F.lit(False)) | (F.col("changed") == 0) | (F.size("affected") == 0)
    named = F.when(fine | unsure, F.array().cast("array<string>")).when(strict, F.col("violators")).otherwise(F.col("affected"))
    return out.select(KEY, fine.alias("accepted"), F.when(fine, None).when(unsure, "ambiguous").otherwise("deterministic").alias("attribution"), named.alias("affected"), "compared", F.coalesce(mae, F.lit(0.0)).alias("mae"), "p95", "changed")


def semantic_build(source: DataFrame, owners: DataFrame, layers: DataFrame, ignored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions: tile, owner, required, decision, reason, round; pages: tile, status, rounds) of all tiles at once, by rounds to the fixpoint.

    Each round repairs what is still active and recomposes the page. Whoever a failure is traced to goes back into the background, all of them where
    it can't be traced; a page that fails with nothing left to take back fails. Every round ends a page or takes elements from it, so a page has
    at most as many rounds as elements and two more. What is active and what was decided are tables in the shared folder; only open pages are
    worked on again.
    """
    active = stored(owners.select(KEY, "owner", "required").distinct(), "active")
    elements = active
    bound = (active.where("not required").groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) + 2
    pending = stored(source.select(KEY).distinct(), "pending")
    taken, pages = [], []
    for turn in range(bound):
        if turn and pending.isEmpty():
            break
        here = source.join(pending, KEY, "left_semi")
        held = active.join(pending, KEY, "left_semi")
        own = owners.join(held.select(KEY, "owner"), [KEY, "owner"], "left_semi")
        verdict, filled = union_repair(here, own)
        whole = here.join(verdict.where("accepted").select(KEY), KEY, "left_semi")
        shown = layers.join(held.where("not required").select(KEY, "owner"), [KEY, "owner"], "left_semi")
        page = stored(whole_page(whole, filled_in(whole, filled), shown, ignored), "pages")
        judged = verdict.select(KEY, F.col("accepted").alias("repaired"), "reason", "failing").join(page.select(KEY, F.col("accepted").alias("composed"), "affected"), KEY, "left")
        done = F.col("repaired") & F.coalesce("composed", F.lit(False))
        named = F.when(F.col("repaired"), F.col("affected")).otherwise(F.col("failing"))
        judged = stored(judged.select(KEY, done.alias("done"), named.alias("named"), F.when(F.col("repaired"), "recomposition_mismatch").otherwise(F.col("reason")).alias("reason")), "judged")
        back = held.where("not required").join(judged.where("not done"), KEY).where((F.size("named") == 0) | F.array_contains("named", F.col("owner")))
        back = stored(back.select(KEY, "owner", "reason", F.lit(turn).alias("round")), "back")
        going_on = back.select(KEY).distinct()
        ended = judged.join(going_on, KEY, "left_anti")
        pages.append(stored(ended.select(KEY, F.when(F.col("done"), "built").otherwise("failed").alias("status"), F.lit(turn + 1).alias("rounds")), "ended"))
        taken.append(back)
        old, active = active, stored(active.join(back.select(KEY, "owner"), [KEY, "owner"], "left_anti"), "active")
        pending = stored(going_on, "pending")
        if old is not elements:
            removed(old)
    back = taken[0]
    result = pages[0]
    for b, p in zip(taken[1:], pages[1:], strict=True):
        back, result = back.union(b), result.union(p)
    out = elements.join(back, [KEY, "owner"], "left").join(result.select(KEY, "status"), KEY)
    decision = F.when(F.col("reason").isNotNull(), "kept_in_background").when(F.col("status") == "failed", "failed").otherwise("accepted")
    return out.select(KEY, "owner", "required", decision.alias("decision"), "reason", "round"), result

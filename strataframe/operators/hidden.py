"""What is hidden behind an object, and whether a proposal for it holds: a plan of stages, each stage's table feeding the next.

Inputs are pixel tables (tile_id, x, y): ``visible``, the rear object as it was cut out; ``occluder``, what lies in front; ``source`` and
``returned`` with channels r, g, b and alpha a.

1. *Evidence.* What both masks claim is the occluder's. Components of the occluder (corners count) are joined with the pixels of the rear object beside
   them: contacts. A contact counts if its own component of the rear object goes on somewhere that is not beside the same occluder. Opposite
   contacts (left and right, or top and bottom) that lie within a tolerance of one line are pairs; a component with a pair is hidden evidence.
2. *Appearance.* Samples of rear, front and background colours near the evidence; each must be close together, all apart from each other.
3. *Assessment.* The returned pixels inside the evidence by the nearest colour, the seam at the contacts, pieces.
4. *Bridges and outcome.* Each piece of evidence must be bridged between the two ends of a pair. The first failing stage names the outcome.

Pairs are never listed: contacts are counted by line, and lines meet within the tolerance. All joins are by tile and pixel or line.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators import occlusion, runs
from strataframe.operators.durable import large, stored
from strataframe.operators.occlusion import KEY, PIXEL, SIDES

#: Alpha that counts as there and as opaque; samples of a colour; spread, distance apart, distance of a match, step of a seam.
SUPPORT, OPAQUE, SAMPLES, SPREAD, APART, MATCH, SEAM = 16, 240, 8, 6, 36, 12, 12
PARTS = ("rear", "front", "background")
RGB = ("r", "g", "b")


def crop_padding(width: Column, height: Column, w: Column, h: Column) -> Column:
    """The context around a candidate's box (w, h) that a crop may have on a canvas."""
    return F.least(F.greatest(F.lit(1), F.floor(F.least(width, height) / 64 + 0.5)), F.greatest(F.lit(1), F.floor(F.least(w, h) / 4))).cast("long")


def alignment(width: Column, height: Column, w: Column, h: Column) -> Column:
    """How far opposite contacts may be from one line."""
    return F.greatest(F.lit(1), F.least(crop_padding(width, height, w, h), F.floor(F.least(w, h) / 16 + 0.5))).cast("long")


@dataclass
class Evidence:
    """visible (tile, x, y) without what the occluder claims; hidden (…, component); contacts (…, component, side); pieces (tile, component, pixels, pairs)."""

    visible: DataFrame
    hidden: DataFrame
    contacts: DataFrame
    pieces: DataFrame

    def stored(self) -> Evidence:
        return Evidence(*(large(df, n) for n, df in vars(self).items()))


def contacts_of(behind: DataFrame, visible: DataFrame) -> DataFrame:
    """(tile, component, side, x, y): pixels of ``visible`` beside pixels of components, by the side of the component they are on."""
    steps = F.array(*(F.struct(F.lit(s).alias("side"), (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y")) for s, (dx, dy) in SIDES.items()))
    beside = behind.select(KEY, "component", F.explode(steps).alias("c")).select(KEY, "component", "c.*").distinct()
    return beside.join(visible, PIXEL)


def continuing(contacts: DataFrame, parts: DataFrame) -> DataFrame:
    """Contacts whose part of the rear object (column part; ``parts``: tile, part, pixels) has a pixel that is not beside the same component."""
    beside = contacts.select(KEY, "component", "part", "x", "y").distinct().groupBy(KEY, "component", "part").agg(F.count(F.lit(1)).alias("beside"))
    going_on = beside.join(parts, [KEY, "part"]).where("beside < pixels").select(KEY, "component", "part")
    return contacts.join(going_on, [KEY, "component", "part"], "left_semi")


def _lines(contacts: DataFrame) -> DataFrame:
    across = F.col("side").isin("left", "right")
    return contacts.withColumns({"across": across, "first": F.col("side").isin("left", "top"), "line": F.when(across, F.col("y")).otherwise(F.col("x"))})


def _near(lines: DataFrame, tolerance: DataFrame, *group: str) -> DataFrame:
    """Lines of one side moved to all lines within the tolerance, as the opposite side sees them."""
    moved = F.transform(F.sequence(-F.col("tolerance"), F.col("tolerance")), lambda d: F.col("line") + d)
    return lines.join(tolerance, KEY).select(KEY, *group, "across", (~F.col("first")).alias("first"), F.explode(moved).alias("line"), *(c for c in lines.columns if c == "n"))


def hidden_evidence(visible: DataFrame, occluder: DataFrame, tolerance: DataFrame) -> Evidence:
    """``tolerance``: (tile_id, tolerance). Tiles without any pair have no rows."""
    occluder = occluder.select(*PIXEL).distinct()
    visible = visible.select(*PIXEL).distinct().join(occluder, PIXEL, "left_anti")
    rear, front = large(runs.components(visible), "rear"), large(runs.components(occluder), "front")
    behind = runs.pixels(front, "component")
    named = runs.pixels(rear, "component").withColumnRenamed("component", "part")
    touching = large(contacts_of(behind, named), "touching")
    lines = _lines(continuing(touching, runs.sizes(rear).withColumnRenamed("component", "part")))
    group = [KEY, "component", "across", "first", "line"]
    lines = large(lines, "lines")
    counted = lines.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    opposite = _near(counted, tolerance, "component").withColumnRenamed("n", "m")
    met = counted.where("first").join(opposite, group)
    pieces = met.groupBy(KEY, "component").agg(F.sum(F.col("n") * F.col("m")).alias("pairs")).join(runs.sizes(front), [KEY, "component"])
    paired = lines.join(opposite.select(*group).distinct(), group, "left_semi").select(*PIXEL, "component", "side")
    pieces = stored(pieces, "pieces")
    return Evidence(visible, behind.join(pieces.select(KEY, "component"), [KEY, "component"], "left_semi"), paired, pieces)


def distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The largest step of a channel."""
    return F.greatest(*(F.abs(x - y) for x, y in zip(a, b, strict=True)))


def _rgb(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in RGB)


#: Facts of a pixel as bits: in the visible part, of the occluder, hidden, opaque, an end of a pair, near something hidden; and the sides.
VISIBLE, FRONT, HIDDEN, CLEAR, END, NEAR = (1 << k for k in range(6))
SIDE = {side: 64 << k for k, side in enumerate(SIDES)}


def _marked(pixels: DataFrame, bits: Column | int, *rgb: str) -> DataFrame:
    return pixels.select(*PIXEL, (bits if isinstance(bits, Column) else F.lit(bits)).cast("int").alias("bits"), *(F.col(c) if c in rgb else F.lit(None).cast("long").alias(c) for c in RGB))


def _facts(*marked: DataFrame) -> DataFrame:
    """One row for each pixel with all its bits and its colour."""
    return reduce(DataFrame.union, marked).groupBy(*PIXEL).agg(F.bit_or("bits").alias("bits"), *(F.max(c).alias(c) for c in RGB))


def _has(*bits: int) -> Column:
    return F.col("bits").bitwiseAND(F.lit(sum(bits))) == sum(bits)


def _around(pixels: DataFrame, *keep: str) -> DataFrame:
    """The pixels of the square around each pixel, repeated as they come."""
    step = F.sequence(F.lit(-occlusion.RADIUS), F.lit(occlusion.RADIUS))
    out = pixels.select(KEY, *keep, "y", F.explode(F.transform(step, lambda d: F.col("x") + d)).alias("x")).where("x >= 0")
    return out.select(KEY, *keep, "x", F.explode(F.transform(step, lambda d: F.col("y") + d)).alias("y")).where("y >= 0")


def _samples(e: Evidence, occluder: DataFrame, source: DataFrame) -> DataFrame:
    """(tile, part, bits, r, g, b): samples of the three colours; those of the rear object with the sides of the contacts that they are near.

    What the masks say of a pixel meets in one aggregate, so no mask is joined with another. Contacts on left and right go before those on top and bottom.
    """
    hidden = e.hidden.select(*PIXEL)
    beside = hidden.select(KEY, F.explode(F.array(*(F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(SIDE[s]).alias("side")) for s, (dx, dy) in SIDES.items()))).alias("p")).select(KEY, "p.*")
    sides = sum(SIDE.values())
    contacts = _facts(_marked(beside, F.col("side")), _marked(e.contacts, END)).where(_has(END) & (F.col("bits").bitwiseAND(F.lit(sides)) > 0))
    seen = contacts.select(*PIXEL, F.col("bits").alias("own"), F.bit_or("bits").over(Window.partitionBy(KEY)).alias("bits"))
    across, down = SIDE["left"] | SIDE["right"], SIDE["top"] | SIDE["bottom"]
    axis = F.when(_has(across), F.lit(across)).when(_has(down), F.lit(down)).otherwise(F.lit(0))
    wanted = seen.select(*PIXEL, F.col("own").bitwiseAND(axis).alias("side")).where("side > 0")
    facts = _facts(
        _marked(e.visible, VISIBLE), _marked(occluder, FRONT), _marked(hidden, HIDDEN), _marked(source.where(F.col("a") >= OPAQUE), CLEAR, *RGB), _marked(_around(hidden), NEAR), _marked(_around(wanted, "side"), F.col("side")),
    ).where(_has(CLEAR))
    rear = _has(VISIBLE) & ~_has(HIDDEN) & ~_has(FRONT) & (F.col("bits").bitwiseAND(F.lit(sides)) > 0)
    parts = F.array(F.when(rear, "rear"), F.when(_has(HIDDEN), "front"), F.when(_has(NEAR) & ~_has(VISIBLE) & ~_has(FRONT), "background"))
    return facts.select(KEY, "bits", *RGB, F.explode(parts).alias("part")).where("part is not null")


def appearance(e: Evidence, occluder: DataFrame, source: DataFrame) -> DataFrame:
    """(tile, rear_n, rear_r, …, reason): the three colours of each tile with evidence, and why they don't qualify (null if they do)."""
    hidden = e.hidden.select(*PIXEL)
    samples = large(_samples(e, occluder, source), "samples")
    # Both opposite sides need samples of their own, else the rear object has none.
    enough = sum((F.count_if(_has(bit)) >= occlusion.SAMPLES).cast("int") for bit in SIDE.values())
    middle = samples.groupBy(KEY, "part").agg(F.count(F.lit(1)).alias("n"), *(F.median(c).alias(f"m{c}") for c in RGB), enough.alias("sides")).where("part <> 'rear' or sides = 2").drop("sides")
    off = distance(_rgb(), _rgb("m")).alias("off")
    kept = [F.first(c).alias(c) for c in ("n", *(f"m{c}" for c in RGB))]
    one = samples.join(middle, [KEY, "part"]).select(KEY, "part", off, "n", *(f"m{c}" for c in RGB)).groupBy(KEY, "part").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY off)").alias("off"), *kept)
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    names = {"n": "n", "off": "off", **{f"m{c}": c for c in RGB}}
    profile = one.groupBy(KEY).agg(*(pick(p, c).alias(f"{p}_{n}") for p in PARTS for c, n in names.items()))
    out = hidden.select(KEY).distinct().join(profile, KEY, "left").fillna(0, [f"{p}_n" for p in PARTS])
    few = reduce(Column.__or__, [F.col(f"{p}_n") < SAMPLES for p in PARTS])
    loose = reduce(Column.__or__, [F.col(f"{p}_off") > SPREAD for p in PARTS])
    alike = reduce(Column.__or__, [distance(_rgb(f"{a}_"), _rgb(f"{b}_")) < APART for a, b in (("rear", "front"), ("rear", "background"), ("front", "background"))])
    reason = F.when(few, "insufficient_evidence").when(loose | alike, "ambiguous_appearance")
    return out.withColumn("reason", reason).drop(*(f"{p}_off" for p in PARTS))


def classified(e: Evidence, profile: DataFrame, returned: DataFrame) -> DataFrame:
    """(tile, x, y, kind, r, g, b): returned pixels in the evidence by the one nearest colour: rear, front, background, unknown, fringe or none."""
    d = {p: distance(_rgb(), _rgb(f"{p}_")) for p in PARTS}
    best = F.least(*d.values())
    same = sum((d[p] == best).cast("int") for p in PARTS)
    match = F.when((best > MATCH) | (same > 1), "unknown").when(d["rear"] == best, "rear").when(d["front"] == best, "front").otherwise("background")
    kind = F.when(F.col("a") < SUPPORT, "none").when(F.col("a") < OPAQUE, "fringe").otherwise(match)
    return e.hidden.select(*PIXEL, "component").join(returned, PIXEL).join(profile, KEY).select(*PIXEL, "component", kind.alias("kind"), *RGB)


def seams(e: Evidence, generated: DataFrame, source: DataFrame) -> DataFrame:
    """(tile, seam, open_, translucent): the largest step from a contact to a generated pixel beside it; first contacts (``y * ROW + x``) with none beside them, and that are not opaque."""
    ends = e.contacts.select(*PIXEL).distinct().join(source, PIXEL)
    steps = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in SIDES.values()))
    beside = ends.select(KEY, F.col("x").alias("cx"), F.col("y").alias("cy"), "a", *(F.col(c).alias(f"s{c}") for c in RGB), F.explode(steps).alias("p")).select("*", "p.x", "p.y")
    each = beside.join(generated.select(*PIXEL, *RGB, F.lit(1).alias("there")), PIXEL, "left").groupBy(KEY, "cx", "cy", "a").agg(F.count("there").alias("n"), F.max(distance(_rgb(), _rgb("s"))).alias("step"))
    at = F.col("cy") * runs.ROW + F.col("cx")
    return each.groupBy(KEY).agg(F.max("step").alias("seam"), F.min(F.when((F.col("n") == 0) & (F.col("a") >= OPAQUE), at)).alias("open_"), F.min(F.when(F.col("a") < OPAQUE, at)).alias("translucent"))


def bridged(e: Evidence, generated: DataFrame, pieces: DataFrame, tolerance: DataFrame) -> DataFrame:
    """(tile, bridged): whether in each piece of evidence one generated piece touches both ends of a pair. ``pieces``: runs with components of ``generated``."""
    made = runs.pixels(pieces, "component").withColumnRenamed("component", "made")
    ends = _lines(e.contacts)
    steps = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in SIDES.values()))
    around = ends.select(KEY, "component", "across", "first", "line", F.explode(steps).alias("p")).select(KEY, "component", "across", "first", "line", "p.x", "p.y")
    inside = generated.select(*PIXEL, "component").join(made, PIXEL)
    touched = around.join(inside, [*PIXEL, "component"]).select(KEY, "component", "made", "across", "first", "line").distinct()
    opposite = _near(touched, tolerance, "component", "made")
    hit = touched.where("first").join(opposite, [KEY, "component", "made", "across", "first", "line"], "left_semi").select(KEY, "component").distinct().withColumn("hit", F.lit(True))
    return e.pieces.select(KEY, "component").join(hit, [KEY, "component"], "left").groupBy(KEY).agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("bridged"))


def assessed(e: Evidence, visible: DataFrame, profile: DataFrame, source: DataFrame, returned: DataFrame, tolerance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics and reason of each tile with a proposal; the generated pixels)."""
    found = large(classified(e, profile.where("reason is null"), returned), "classified")
    generated = found.where("kind = 'rear'").drop("kind")
    count = lambda k: F.count_if(F.col("kind") == k)
    kinds = found.groupBy(KEY).agg(count("rear").alias("generated"), count("front").alias("residual"), count("unknown").alias("unknown"), count("fringe").alias("fringe"))
    differs = reduce(Column.__or__, [F.col(f"s.{c}") != F.col(f"t.{c}") for c in (*RGB, "a")])
    same = reduce(Column.__and__, [F.col(f"s.{c}") == F.col(f"t.{c}") for c in PIXEL])
    changed = source.alias("s").join(returned.alias("t"), same).where(differs).select(*(F.col(f"s.{c}") for c in PIXEL))
    mark = lambda m, n: m.select(*PIXEL).distinct().withColumn(n, F.lit(1))
    moved = changed.join(mark(e.hidden, "in_hidden"), PIXEL, "left").join(mark(visible, "in_visible"), PIXEL, "left")
    moved = moved.groupBy(KEY).agg(F.count_if(F.col("in_hidden").isNull()).alias("outside_changed"), F.count("in_visible").alias("visible_changed"))
    pieces = large(runs.components(generated), "pieces")
    whole = runs.components(generated.select(*PIXEL).union(visible.select(*PIXEL)))
    out = kinds.join(moved, KEY, "left").join(seams(e, generated, source), KEY, "left")
    out = out.join(runs.one_component(pieces).withColumnRenamed("single", "one_piece"), KEY, "left").join(runs.one_component(whole).withColumnRenamed("single", "one_whole"), KEY, "left")
    out = out.join(bridged(e, generated, pieces, tolerance), KEY, "left").fillna(0, ["outside_changed", "visible_changed"]).fillna(False, ["one_piece", "one_whole", "bridged"])
    first_open = F.col("open_").isNotNull() & (F.col("translucent").isNull() | (F.col("open_") < F.col("translucent")))
    reason = (
        F.when(F.col("residual") > 0, "residual_occluder").when((F.col("unknown") > 0) | (F.col("fringe") > 0), "ambiguous_appearance").when(first_open, "contour_mismatch")
        .when(F.col("translucent").isNotNull() | (F.col("seam") > SEAM), "seam_mismatch").when(~(F.col("one_piece") & F.col("one_whole") & F.col("bridged")), "contour_mismatch")
    )
    return out.withColumn("reason", reason).drop("open_", "translucent"), generated


def composites(accepted: DataFrame, visible: DataFrame, source: DataFrame, returned: DataFrame, generated: DataFrame) -> DataFrame:
    """(tile, x, y, r, g, b, a): visible pixels of the source and generated ones of the answer, everything else transparent black; tiles in ``accepted`` only."""
    ours = visible.select(*PIXEL).distinct().join(source, PIXEL).select(*PIXEL, *RGB, "a", F.lit(0).alias("rank"))
    theirs = generated.select(*PIXEL).join(returned, PIXEL).select(*PIXEL, *RGB, "a", F.lit(1).alias("rank"))
    none = source.select(*PIXEL, *(F.lit(0).cast("long").alias(c) for c in (*RGB, "a")), F.lit(2).alias("rank"))
    best = F.min_by(F.struct(*RGB, "a"), "rank").alias("p")
    return ours.union(theirs).union(none).join(accepted.select(KEY), KEY, "left_semi").groupBy(*PIXEL).agg(best).select(*PIXEL, "p.*")


def image_digests(image: DataFrame) -> DataFrame:
    """(tile, sha256): the digest of the samples in reading order, four bytes a pixel as hex text."""
    byte = F.concat(*(F.lpad(F.lower(F.hex(F.col(c))), 2, "0") for c in (*RGB, "a")))
    rows = image.select(KEY, "y", "x", byte.alias("p")).groupBy(KEY, "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "p"))), lambda s: s["p"]), "").alias("row"))
    return rows.groupBy(KEY).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda s: s["row"]), ""), 256).alias("sha256"))


def outcomes(tiles: DataFrame, e: Evidence, profile: DataFrame, judged: DataFrame, limit: int = 4) -> DataFrame:
    """(tile, status, reason) of each tile (tile_id, page, requested, valid, answered): the first stage that fails.

    At most ``limit`` tiles of a page, in order of their ids, may be asked for once their appearance qualifies.
    """
    seen = tiles.join(e.pieces.select(KEY).distinct().withColumn("evidence", F.lit(True)), KEY, "left").join(profile.select(KEY, F.col("reason").alias("look")), KEY, "left")
    seen = seen.join(judged.select(KEY, F.col("reason").alias("verdict"), F.lit(True).alias("judged")), KEY, "left")
    asks = F.col("requested") & F.col("valid") & F.col("evidence").isNotNull() & F.col("look").isNull()
    turn = F.sum(asks.cast("int")).over(Window.partitionBy("page").orderBy(KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = seen.withColumn("turn", turn)
    steps = [
        (~F.col("requested"), "skipped", F.lit("geometry")), (~F.col("valid"), "rejected", F.lit("geometry")), (F.col("evidence").isNull(), "rejected", F.lit("contour_mismatch")), (F.col("look").isNotNull(), "rejected", F.col("look")),
        (F.col("turn") > limit, "skipped", F.lit("disabled")), (~F.col("answered"), "skipped", F.lit("provider_failure")), (F.col("judged").isNull(), "rejected", F.lit("geometry")), (F.col("verdict").isNotNull(), "rejected", F.col("verdict")),
    ]
    status = reduce(lambda c, s: c.when(s[0], s[1]), steps[1:], F.when(steps[0][0], steps[0][1])).otherwise("accepted")
    reason = reduce(lambda c, s: c.when(s[0], s[2]), steps[1:], F.when(steps[0][0], steps[0][2]))
    return seen.select(KEY, status.alias("status"), reason.alias("reason"))


def completed(tiles: DataFrame, visible: DataFrame, occluder: DataFrame, source: DataFrame, returned: DataFrame, tolerance: DataFrame, limit: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, metrics, images of accepted tiles): all stages, with evidence, colours and verdicts written between them."""
    e = hidden_evidence(visible, occluder, tolerance)
    e = e.stored()
    profile = stored(appearance(e, occluder, source), "profile")
    judged, generated = assessed(e, e.visible, profile, source, returned, tolerance)
    judged = stored(judged, "judged")
    result = stored(outcomes(tiles, e, profile, judged, limit), "outcomes")
    return result, judged, composites(result.where("status = 'accepted'"), e.visible, source, returned, generated)

"""Checks and assembly around candidates of a page: masks that belong together, carried texts, members, owner groups, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators import graph

PAGE = "slide_id"
PROTECTED = ("background", "text")
#: Padding around removed elements and text overlays, and bounds of a completion's context.
PADDING = {"text": 4, "asset": 6, "shape": 2}
OVERLAY, CONTEXT_NODES, CONTEXT_ID, CONTEXT_LABEL, CONTEXT_BYTES = 9, 8, 128, 200, 8192
MODEL_ID, WORKSPACE_ID, SHA256 = r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,127}$", r"^(?=.{1,63}$)[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?$", r"^[a-f0-9]{64}$"


def with_all_masks(candidates: DataFrame, occluders: DataFrame, masks: DataFrame) -> DataFrame:
    """(slide_id, node_id) of candidates that have a mask, as have all nodes in front of them; without any node in front there is nothing to complete."""
    ids = masks.select(PAGE, F.col("node_id").alias("occluder_id")).distinct().withColumn("held", F.lit(1))
    whole = occluders.join(ids, [PAGE, "occluder_id"], "left").groupBy(PAGE, "node_id").agg(F.count(F.lit(1)).alias("n"), F.count("held").alias("held")).where("n = held")
    return candidates.select(PAGE, "node_id").join(masks.select(PAGE, "node_id"), [PAGE, "node_id"], "left_semi").join(whole.select(PAGE, "node_id"), [PAGE, "node_id"], "left_semi")


def carried_texts(carries: DataFrame, texts: DataFrame) -> DataFrame:
    """(slide_id, node_id, valid): whether the texts that a backing carries (text_id) are all different and all there."""
    known = texts.select(PAGE, F.col("node_id").alias("text_id")).distinct().withColumn("known", F.lit(1))
    each = carries.join(known, [PAGE, "text_id"], "left").groupBy(PAGE, "node_id")
    return each.agg(((F.count(F.lit(1)) == F.count_distinct("text_id")) & (F.count("known") == F.count(F.lit(1)))).alias("valid"))


def unknown(rows: DataFrame, plan: DataFrame, *key: str) -> DataFrame:
    """Rows whose key the plan doesn't have."""
    return rows.join(plan.select(*key).distinct(), list(key), "left_anti")


def members(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(slide_id, member_id, kind, z): the objects of compound groups (node_id, node_ids, z) as candidates of their own; their z or the group's."""
    each = groups.select(PAGE, F.col("node_id").alias("group_id"), F.col("z").alias("group_z"), F.explode(F.array_distinct("node_ids")).alias("node_id")).where("node_id <> group_id")
    held = each.join(nodes.where(F.col("role").isin("foreground-object", "compound-group")).select(PAGE, "node_id", "role", "z"), [PAGE, "node_id"])
    return held.select(PAGE, F.concat_ws(":", "group_id", "node_id").alias("member_id"), F.col("role").alias("kind"), F.coalesce("z", "group_z").alias("z"))


def repair_totals(repairs: DataFrame, *key: str) -> DataFrame:
    """Metrics of several repairs as one: counts add up, deviations take the largest."""
    return repairs.groupBy(*key).agg(F.sum("masked").alias("masked"), F.sum("outside").alias("outside"), F.sum("ring").alias("ring"), F.max("mad").alias("mad"), F.max("p95").alias("p95"))


def final_z(assets: DataFrame, texts: DataFrame) -> DataFrame:
    """(slide_id, node_id, final_z): assets keep their z, texts follow in order (ord) above the largest."""
    top = assets.groupBy(PAGE).agg(F.max("z").alias("top"))
    place = F.row_number().over(Window.partitionBy(PAGE).orderBy("ord"))
    above = texts.withColumn("place", place).join(top, PAGE, "left").select(PAGE, "node_id", (F.coalesce("top", F.lit(-1)) + F.col("place")).cast("long").alias("final_z"))
    return assets.select(PAGE, "node_id", F.col("z").cast("long").alias("final_z")).union(above)


def context_nodes(nodes: DataFrame, side: str = "side", fixed: int = 200, per_node: int = 40) -> DataFrame:
    """(slide_id, side, node_id, label): the first CONTEXT_NODES nodes of each side, labels cut alike until the page's context fits CONTEXT_BYTES.

    fixed, per_node: bytes around the context and around each node.
    """
    place = F.row_number().over(Window.partitionBy(PAGE, side).orderBy("node_id"))
    label = F.substring(F.coalesce("label", F.lit("")), 1, CONTEXT_LABEL).alias("label")  # no limit is larger, so the rest of a label never moves
    kept = nodes.select(PAGE, side, "node_id", label).withColumn("place", place).where(F.col("place") <= CONTEXT_NODES).select(PAGE, side, F.substring("node_id", 1, CONTEXT_ID).alias("node_id"), "label")
    size = lambda limit: F.aggregate("held", F.lit(fixed), lambda total, n: total + per_node + F.octet_length(n["node_id"]) + F.octet_length(F.substr(n["label"], F.lit(1), limit)))
    page = kept.groupBy(PAGE).agg(F.collect_list(F.struct(side, "node_id", "label")).alias("held"))
    # Sizes grow with the limit: where whole labels don't fit, the limit is found bit by bit, from the highest on.
    bits = F.array(*(F.lit(1 << k) for k in reversed(range(CONTEXT_LABEL.bit_length()))))
    found = F.aggregate(bits, F.lit(0), lambda limit, bit: limit + F.when((limit + bit <= CONTEXT_LABEL) & (size(limit + bit) <= CONTEXT_BYTES), bit).otherwise(0))
    limit = F.when(size(F.lit(CONTEXT_LABEL)) <= CONTEXT_BYTES, F.lit(CONTEXT_LABEL)).when(size(F.lit(0)) <= CONTEXT_BYTES, found)
    out = page.withColumn("limit", limit).where("limit is not null").select(PAGE, "limit", F.explode("held").alias("n"))
    return out.select(PAGE, f"n.{side}", "n.node_id", F.substr("n.label", F.lit(1), "limit").alias("label"))


def coverage_faults(union: DataFrame, owners: DataFrame, key: str = "tile_id") -> DataFrame:
    """(tile, only_union, only_owners): pixels that the committed union and its owners' masks don't share, of tiles that have any."""
    a, b = union.select(key, "x", "y").distinct().withColumn("u", F.lit(1)), owners.select(key, "x", "y").distinct().withColumn("o", F.lit(1))
    out = a.join(b, [key, "x", "y"], "full").groupBy(key).agg(F.count_if(F.col("o").isNull()).alias("only_union"), F.count_if(F.col("u").isNull()).alias("only_owners"))
    return out.where("only_union > 0 or only_owners > 0")


def owner_groups(owners: DataFrame, key: str = "tile_id") -> DataFrame:
    """(tile, owner, owner_group): owners whose masks share a pixel, directly or through others, are one unit of repair; it is named by the least.

    A pixel links its owners to the least of them, so no pairs are made.
    """
    least = F.min("owner").over(Window.partitionBy(key, "x", "y"))
    edges = owners.withColumn("least", least).where("owner <> least").select(F.col(key).alias(PAGE), F.col("least").alias("a"), F.col("owner").alias("b")).distinct()
    every = owners.select(F.col(key).alias(PAGE), F.col("owner").alias("node_id")).distinct()
    return graph.components(every, edges).select(F.col(PAGE).alias(key), F.col("node_id").alias("owner"), F.col("root").alias("owner_group"))


def box_on_mask(boxes: DataFrame, mask: DataFrame, width: int, height: int, key: str = "tile_id") -> DataFrame:
    """(tile, ord, overlaps, covered): whether a box shares area with a mask, and whether it is inside the tile and wholly on it."""
    left, top, right, bottom = F.floor("x"), F.floor("y"), F.ceil(F.col("x") + F.col("w")), F.ceil(F.col("y") + F.col("h"))
    at = boxes.select(key, "ord", *(c.cast("long").alias(n) for n, c in (("l", left), ("t", top), ("r", right), ("b", bottom))))
    within = at.select("*", *(F.greatest(F.col(n), F.lit(0)).alias(f"c{n}") for n in "lt"), F.least("r", F.lit(width)).alias("cr"), F.least("b", F.lit(height)).alias("cb"))
    cells = within.where("cr > cl and cb > ct").select(key, "ord", F.explode(F.sequence("cl", F.col("cr") - 1)).alias("x"), "ct", "cb").select(key, "ord", "x", F.explode(F.sequence("ct", F.col("cb") - 1)).alias("y"))
    found = cells.join(mask.select(key, "x", "y").distinct(), [key, "x", "y"]).groupBy(key, "ord").agg(F.count(F.lit(1)).alias("n"))
    out = within.join(found, [key, "ord"], "left")
    inside = (F.col("l") >= 0) & (F.col("t") >= 0) & (F.col("r") <= width) & (F.col("b") <= height)
    full = F.coalesce("n", F.lit(0)) == (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))
    return out.select(key, "ord", F.col("n").isNotNull().alias("overlaps"), (inside & full).alias("covered"))


def target_nodes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(slide_id, targets): the different, existing and unprotected nodes that a page asks for, sorted."""
    asked = requests.select(PAGE, "node_id", F.lit(True).alias("asked"))
    both = asked.union(nodes.where(~F.col("role").isin(*PROTECTED)).select(PAGE, "node_id", F.lit(False))).where(F.col(PAGE).isNotNull())
    held = both.groupBy(PAGE).agg(F.collect_set(F.when(F.col("asked"), F.col("node_id"))).alias("asked"), F.collect_set(F.when(~F.col("asked"), F.col("node_id"))).alias("open_"))
    return held.select(PAGE, F.array_sort(F.array_intersect("asked", "open_")).alias("targets")).where(F.size("targets") > 0)


def relations_of(asked: DataFrame, relations: DataFrame) -> DataFrame:
    """(slide_id, node_id, rel_ids, missing): a candidate's relations, sorted, and how many of those it names don't exist."""
    known = relations.select(PAGE, "rel_id").distinct().withColumn("known", F.lit(1))
    return asked.join(known, [PAGE, "rel_id"], "left").groupBy(PAGE, "node_id").agg(F.array_sort(F.collect_list(F.when(F.col("known") == 1, F.col("rel_id")))).alias("rel_ids"), F.count_if(F.col("known").isNull()).alias("missing"))


def removal_shape(kind: Column, shape: Column, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    """The primitive that removes an element, and its box with the kind's padding."""
    pad = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in PADDING.items()))
    primitive = F.when((kind == "shape") & (shape == "roundRect"), "round_rectangle").when((kind == "shape") & (shape == "ellipse"), "ellipse").otherwise("polygon")
    return primitive, x - pad, y - pad, w + 2 * pad, h + 2 * pad


def overlay_bounds(x: Column, y: Column, w: Column, h: Column, width: Column | int, height: Column | int, pad: int = OVERLAY) -> Column:
    """(left, top, right, bottom) of a box in whole pixels, padded and clipped to the canvas; null if nothing is left. Without padding: an integer crop."""
    size = [v if isinstance(v, Column) else F.lit(v) for v in (width, height)]
    left, top = (F.greatest(F.floor(v) - pad, F.lit(0)).cast("long") for v in (x, y))
    right, bottom = (F.least(F.ceil(a + b) + pad, s).cast("long") for a, b, s in ((x, w, size[0]), (y, h, size[1])))
    return F.when((right > left) & (bottom > top), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def escapes_canvas(x: Column, y: Column, w: Column, h: Column, quad: Column, width: int, height: int) -> Column:
    """Whether a line's box or one of its four corners (x, y) lies outside the canvas."""
    return (x < 0) | (y < 0) | (x + w > width) | (y + h > height) | F.exists(quad, lambda p: (p["x"] < 0) | (p["y"] < 0) | (p["x"] > width) | (p["y"] > height))


def artifacts(ledger: DataFrame, *columns: str) -> DataFrame:
    """(slide_id, path, sha256): every artifact that a ledger's structs (path, sha256) and arrays of them name, once."""
    as_arrays = [F.col(c) if ledger.schema[c].dataType.typeName() == "array" else F.array(F.col(c)) for c in columns]
    each = ledger.select(PAGE, F.explode(F.concat(*(F.coalesce(c, F.array().cast("array<struct<path:string,sha256:string>>")) for c in as_arrays))).alias("a")).where("a.path is not null")
    return each.select(PAGE, "a.path", "a.sha256").distinct()

"""Choosing among proposals, budgets, refined graphs, and roll-back to a stable state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.geometry import Box, iou
from strataframe.operators.graph import PAGE, PROTECTED

TOLERANCES = {"png": (24, 32), "jpeg": (32, 40)}
PADDINGS = tuple(range(4, 33, 4))
#: Fixed values of the canvas that a provider takes.
GRID, MIN_PIXELS, MAX_PIXELS, MAX_EDGE, MAX_RATIO = 16, 655_360, 8_294_400, 3_840, 3


def proposals(boxes: DataFrame, width: int, height: int, form: str = "png") -> DataFrame:
    """(.., padding, tolerance): each box with the paddings 0, a step and the most, and the tolerances of its format, to be tried in this order."""
    step = max(1, (2 * min(width, height) + 64) // 128)  # a 64th of the shorter side, rounded half up
    most = F.greatest(F.lit(step), F.least(F.lit(2 * step), F.greatest(F.lit(1), F.floor(F.least("w", "h") / 4))))
    padding = F.array_sort(F.array_distinct(F.array(F.lit(0).cast("long"), F.lit(step).cast("long"), most.cast("long"))))
    return boxes.withColumn("padding", F.explode(padding)).withColumn("tolerance", F.explode(F.array(*map(F.lit, TOLERANCES[form]))))


def best_masks(masks: DataFrame, *key: str) -> DataFrame:
    """The best eligible mask of each key: completeness, then little border, much foreground, a small box, little padding."""
    ok = (F.col("opaque_border_ratio") <= 0.02) & F.col("foreground_ratio").between(0.01, 0.95) & (F.col("components") > 0) & (F.col("completeness") > 0) & (F.col("text_overlap") <= 0)
    order = Window.partitionBy(*key).orderBy(F.desc("completeness"), "opaque_border_ratio", F.desc("foreground_ratio"), F.col("w") * F.col("h"), "padding", "tolerance")
    return masks.where(ok).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def first_padding(tries: DataFrame, *key: str) -> DataFrame:
    """(key, padding, success) of a ladder of tries (padding, transparent, hopeless): the first that succeeds, or the one where it stops."""
    stop = F.col("transparent") | F.col("hopeless")
    # Padding and success as one number: Spark sorts all tries to aggregate structs, but hashes numbers.
    code = F.col("padding").cast("long") * 3 + F.when(F.col("transparent"), 2).when(~F.col("transparent"), 1).otherwise(0)
    out = tries.groupBy(*key).agg(F.coalesce(F.min(F.when(stop, code)), F.max(code)).alias("s"))
    success = F.pmod("s", F.lit(3))
    return out.select(*key, F.floor(F.col("s") / 3).cast(tries.schema["padding"].dataType).alias("padding"), F.when(success > 0, success == 2).alias("success"))


def within_budget(rows: DataFrame, limit: int, order: list[str], page: str = PAGE) -> DataFrame:
    """The first ``limit`` rows of each page that qualify; what does not qualify uses up nothing."""
    place = F.row_number().over(Window.partitionBy(page).orderBy(*order))
    return rows.where("qualifies").withColumn("place", place.cast("long")).where(F.col("place") <= limit)


def group_labels(members: DataFrame, *key: str) -> DataFrame:
    """Labels of a group in source order, its ids and its greatest z."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "label", "node_id")))
    return members.groupBy(*key).agg(F.array_join(F.transform(rows, lambda r: r["label"]), " + ").alias("label"), F.array_join(F.transform(rows, lambda r: r["node_id"]), ",").alias("ids"), F.max("z").alias("z"))


def provider_canvas(width: Column, height: Column) -> Column:
    """(width, height) of the supported canvas with the closest ratio, the smallest of equals; null if there is none."""
    first = (F.ceil(width / GRID) * GRID).cast("int")
    ratio = width / height

    def sized(w: Column) -> Column:
        h = (F.ceil(F.greatest(height.cast("long"), F.ceil(F.lit(MIN_PIXELS) / w)) / GRID) * GRID).cast("int")
        return F.struct(F.round(F.abs(w / h - ratio), 9).alias("off"), (w.cast("long") * h).alias("area"), w.alias("width"), h.alias("height"))

    def fits(s: Column) -> Column:
        return (s["height"] <= MAX_EDGE) & s["area"].between(MIN_PIXELS, MAX_PIXELS) & (F.greatest(s["width"], s["height"]) <= F.least(s["width"], s["height"]) * MAX_RATIO)

    all_of = F.when(first <= MAX_EDGE, F.transform(F.sequence(first, F.lit(MAX_EDGE), F.lit(GRID)), sized))
    best = F.array_min(F.filter(all_of, fits))
    return F.when(best.isNotNull(), F.struct(best["width"].alias("width"), best["height"].alias("height")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once for a row, not for each element that a lambda in ``use`` looks at."""
    return F.transform(F.array(value), use)[0]


def merged_pages(pages: DataFrame, limit: float = 0.8) -> DataFrame:
    """(slide_id, nodes, relations) after regions were looked at again. Pages are gathered, a row each: nodes, relations and refined as arrays of structs, the ids of targets.

    Targets go; an original that a refined node overlaps by more than ``limit`` goes unless it is protected; relations stay if both ends are
    there and not both were targets.
    """
    box = lambda s: Box(*(s[c] for c in "xywh"))
    among = lambda ident, ids: F.coalesce(F.array_contains(ids, ident), F.lit(False))

    def stays(n: Column, asked: Column) -> Column:
        meet = lambda a, b: (a.x < b.right) & (b.x < a.right) & (a.y < b.bottom) & (b.y < a.bottom)
        same = F.exists(asked["refined"], lambda f: meet(box(n), box(f)) & (iou(box(n), box(f)) > limit))
        return ~among(n["node_id"], asked["targets"]) & ~F.coalesce(~n["role"].isin(*PROTECTED) & same, F.lit(False))

    def tied(r: Column, page: Column) -> Column:
        return among(r["from_id"], page["ids"]) & among(r["to_id"], page["ids"]) & ~(among(r["from_id"], page["targets"]) & among(r["to_id"], page["targets"]))

    nodes = F.concat(_once(F.struct("refined", "targets"), lambda asked: F.filter("nodes", lambda n: stays(n, asked))), "refined")
    page = F.struct(F.transform(nodes, lambda n: n["node_id"]).alias("ids"), "targets")
    return pages.select(PAGE, nodes.alias("nodes"), _once(page, lambda page: F.filter("relations", lambda r: tied(r, page))).alias("relations"))


def _checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, where the session names one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def rolled_back(active: DataFrame, culprits: Callable[[DataFrame], DataFrame], key: list[str], cut: Callable[[DataFrame], DataFrame] = _checkpointed) -> DataFrame:
    """What stays active when, round by round, the culprits among it are taken out until there are none.

    Each round takes rows out, so the rounds end. ``cut`` ends the lineage of a round's result.
    """
    while not (bad := culprits(active)).isEmpty():
        active = cut(active.join(bad.select(*key).distinct(), key, "left_anti"))
    return active

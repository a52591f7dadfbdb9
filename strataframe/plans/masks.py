"""Queries over masks from formulas, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.operators import candidates, shapes
from strataframe.plans import lifts
from strataframe.plans.catalogue import query
from strataframe.plans.lifts import HEIGHT, WIDTH, duck

#: Every node with the padding of its kind; round corners have a radius by the node's z.
SHAPES = f"""WITH {duck("nodes")}, k AS (SELECT *, CASE role % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'asset' ELSE 'shape' END AS kind, CASE z % 3 WHEN 0 THEN 'rect' WHEN 1 THEN 'roundRect' ELSE 'ellipse' END AS shape FROM nodes), p AS (SELECT *, CASE kind WHEN 'text' THEN 4 WHEN 'asset' THEN 6 ELSE 2 END AS pad FROM k),
s AS (SELECT slide_id, ord, CASE WHEN kind = 'shape' AND shape = 'roundRect' THEN 'round_rectangle' WHEN kind = 'shape' AND shape = 'ellipse' THEN 'ellipse' ELSE 'polygon' END AS primitive, CAST(x - pad AS DOUBLE) AS x, CAST(y - pad AS DOUBLE) AS y, CAST(w + 2 * pad AS DOUBLE) AS w, CAST(h + 2 * pad AS DOUBLE) AS h, CAST(z * 5 + pad AS DOUBLE) AS radius FROM p),
r AS (SELECT *, greatest(0.0, least(radius, w / 2, h / 2)) AS q, unnest(range(CAST(greatest(ceil(y - 0.5), 0) AS BIGINT), CAST(least(ceil(y + h - 0.5) - 1, {HEIGHT - 1}) AS BIGINT) + 1)) AS row FROM s),
c AS (SELECT *, row + 0.5 AS mid, greatest(y + q - (row + 0.5), (row + 0.5) - (y + h - q), 0.0) AS corner, ((row + 0.5) - (y + h / 2)) / (h / 2) AS share FROM r),
i AS (SELECT *, CASE primitive WHEN 'round_rectangle' THEN q - coalesce(q * sqrt(greatest(0.0, 1 - (corner / nullif(q, 0.0)) * (corner / nullif(q, 0.0)))), 0.0) WHEN 'ellipse' THEN w / 2 - coalesce(w / 2 * sqrt(greatest(0.0, 1 - share * share)), 0.0) ELSE 0.0 END AS inset FROM c),
sp AS MATERIALIZED (SELECT * FROM (SELECT slide_id, ord, row AS y, CAST(greatest(ceil(x + inset - 0.5), 0) AS BIGINT) AS x0, CAST(least(ceil(x + w - inset - 0.5) - 1, {WIDTH - 1}) AS BIGINT) AS x1 FROM i) u WHERE x0 <= x1)"""


def _shapes(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("text", "asset", "shape"))), (F.col("role") % 3 + 1).cast("int"))
    shape = F.element_at(F.array(*map(F.lit, ("rect", "roundRect", "ellipse"))), (F.col("z") % 3 + 1).cast("int"))
    made = candidates.removal_shape(kind, shape, *(F.col(c) for c in "xywh"))
    pad = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in candidates.PADDING.items()))
    return lifts.nodes(spark, d).select("slide_id", "ord", *(c.alias(n) for n, c in zip(("primitive", "x", "y", "w", "h"), made, strict=True)), (F.col("z") * 5 + pad).alias("radius"))


@query("shape_areas", f"{SHAPES} SELECT slide_id, ord, CAST(sum(x1 - x0 + 1) AS BIGINT) AS pixels, count(*) AS runs FROM sp GROUP BY slide_id, ord")
def shape_areas(spark, d):
    return shapes.shape_areas(_shapes(spark, d), WIDTH, HEIGHT, "slide_id", "ord")


@query(
    "removal_mask",
    f"""{SHAPES}, m AS (SELECT slide_id, y, x0, x1, CASE WHEN x0 > max(x1) OVER (PARTITION BY slide_id, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM sp),
g AS (SELECT *, sum(new) OVER (PARTITION BY slide_id, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM m), u AS (SELECT slide_id, y, run, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY ALL) SELECT slide_id, CAST(sum(x1 - x0 + 1) AS BIGINT) AS pixels, count(*) AS runs FROM u GROUP BY slide_id""",
)
def removal_mask(spark, d):
    """Runs of a page's whole mask: what all its elements take out."""
    return shapes.mask_areas(_shapes(spark, d), WIDTH, HEIGHT, "slide_id")

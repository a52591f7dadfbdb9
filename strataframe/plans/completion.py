"""Queries around completion of hidden parts, owner groups and candidates' checks, with their SQL; :mod:`catalogue` loads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import geometry as g
from strataframe.operators import candidates, occlusion, raster_udf
from strataframe.plans import lifts
from strataframe.plans.catalogue import GRAPH, PIXEL_NODES, REL, _clipped, _named, _relations, query
from strataframe.plans.lifts import HEIGHT, WIDTH, duck, grouped

# A tile's bright pixels are the rear object, its dark ones lie in front; the dark ones of the four middle columns are hidden.
MASKS = f"WITH {duck('pixels')}, vis AS MATERIALIZED (SELECT tile_id, x, y FROM pixels WHERE v >= 130), occ AS MATERIALIZED (SELECT tile_id, x, y FROM pixels WHERE v < 126), hid AS MATERIALIZED (SELECT tile_id, x, y FROM occ WHERE x BETWEEN 2 AND 5), opq AS MATERIALIZED (SELECT tile_id, x, y FROM pixels WHERE v <> 127)"
CONTACTS = "con AS MATERIALIZED (SELECT DISTINCT v.tile_id, v.x, v.y, s.side FROM (VALUES ('left', 1, 0), ('right', -1, 0), ('top', 0, 1), ('bottom', 0, -1)) s(side, dx, dy), hid h JOIN vis v ON v.tile_id = h.tile_id WHERE v.x = h.x - s.dx AND v.y = h.y - s.dy)"
FREE = "(SELECT * FROM vis EXCEPT SELECT * FROM hid EXCEPT SELECT * FROM occ INTERSECT SELECT * FROM opq)"
REAR = f"""has AS (SELECT tile_id, bool_or(side = 'left') AND bool_or(side = 'right') AS across, bool_or(side = 'top') AND bool_or(side = 'bottom') AS down FROM con GROUP BY tile_id),
near AS MATERIALIZED (SELECT DISTINCT c.tile_id, c.side, f.x, f.y FROM con c JOIN has ON has.tile_id = c.tile_id AND CASE WHEN across THEN side IN ('left', 'right') WHEN down THEN side IN ('top', 'bottom') ELSE false END JOIN {FREE} f ON f.tile_id = c.tile_id WHERE abs(f.x - c.x) <= 3 AND abs(f.y - c.y) <= 3),
ok AS (SELECT tile_id FROM (SELECT tile_id, side FROM near GROUP BY ALL HAVING count(*) >= 8) s GROUP BY tile_id HAVING count(*) = 2),
rear AS MATERIALIZED (SELECT DISTINCT tile_id, x, y FROM near WHERE tile_id IN (SELECT tile_id FROM ok))"""
BACK = "back AS MATERIALIZED (SELECT DISTINCT q.tile_id, q.x, q.y FROM hid h JOIN opq q ON q.tile_id = h.tile_id WHERE abs(q.x - h.x) <= 3 AND abs(q.y - h.y) <= 3 AND (q.tile_id, q.x, q.y) NOT IN (SELECT (tile_id, x, y) FROM vis) AND (q.tile_id, q.x, q.y) NOT IN (SELECT (tile_id, x, y) FROM occ))"


def _masks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """visible, hidden, occluder, opaque."""
    p = lifts.pixels(spark, d)
    at = lambda where: p.where(where).select("tile_id", "x", "y")
    return at("v >= 130"), at("v < 126 and x between 2 and 5"), at("v < 126"), at("v <> 127")


@query("contact_sides", f"{MASKS}, {CONTACTS} SELECT tile_id, x, y, side FROM con")
def contact_sides(spark, d):
    visible, hidden, _, _ = _masks(spark, d)
    return occlusion.contact_sides(visible, hidden).select("tile_id", "x", "y", "side")


@query("rear_samples", f"{MASKS}, {CONTACTS}, {REAR} SELECT tile_id, x, y FROM rear")
def rear_samples(spark, d):
    return occlusion.rear_samples(*_masks(spark, d), 8, 8)


@query("background_samples", f"{MASKS}, {BACK} SELECT tile_id, x, y FROM back")
def background_samples(spark, d):
    return occlusion.background_samples(*_masks(spark, d), 8, 8)


@query(
    "source_samples",
    f"""{MASKS}, {CONTACTS}, {REAR}, {BACK}, c AS (SELECT tile_id, 'rear' AS what FROM rear UNION ALL SELECT tile_id, 'background' FROM back UNION ALL SELECT tile_id, 'front' FROM (SELECT * FROM hid INTERSECT SELECT * FROM opq) f),
t AS (SELECT h.tile_id, count(*) FILTER (WHERE what = 'rear') AS rear, count(*) FILTER (WHERE what = 'front') AS front, count(*) FILTER (WHERE what = 'background') AS background FROM (SELECT DISTINCT tile_id FROM hid) h LEFT JOIN c ON c.tile_id = h.tile_id GROUP BY h.tile_id)
SELECT *, rear >= 8 AND front >= 8 AND background >= 8 AS enough FROM t""",
)
def source_samples(spark, d):
    return occlusion.source_samples(*_masks(spark, d), 8, 8)


SHIFTED = "out AS (SELECT tile_id, x + CASE WHEN tile_id % 5 = 0 THEN 4 ELSE 0 END AS x, y, side FROM con)"


@query(
    "geometry_faults",
    f"""{MASKS}, {CONTACTS}, {SHIFTED}, h2 AS (SELECT * FROM hid UNION ALL SELECT tile_id, x, y FROM vis WHERE tile_id % 7 = 0 AND x = 0)
SELECT DISTINCT tile_id, 'contact_outside' AS fault FROM out WHERE x > 7 UNION SELECT v.tile_id, 'visible_and_hidden' FROM vis v JOIN h2 ON h2.tile_id = v.tile_id AND h2.x = v.x AND h2.y = v.y""",
)
def geometry_faults(spark, d):
    visible, hidden, _, _ = _masks(spark, d)
    contacts = occlusion.contact_sides(visible, hidden).withColumn("x", F.col("x") + F.when(F.col("tile_id") % 5 == 0, 4).otherwise(0))
    return occlusion.geometry_faults(visible, hidden.union(visible.where("tile_id % 7 = 0 and x = 0")), contacts, 8, 8)


PAIRS = "pairs AS MATERIALIZED (SELECT l.tile_id, l.x AS ax, l.y AS ay, min(r.x) AS bx, l.y AS by FROM con l JOIN con r ON r.tile_id = l.tile_id AND r.y = l.y AND r.side = 'right' WHERE l.side = 'left' AND r.x - l.x > 0 GROUP BY ALL)"
LABELLED = """f AS (SELECT a.tile_id, a.y * 8 + a.x AS a, b.y * 8 + b.x AS b FROM occ a JOIN occ b ON a.tile_id = b.tile_id WHERE abs(a.x - b.x) + abs(a.y - b.y) = 1),
w AS (SELECT tile_id, y * 8 + x AS a, y * 8 + x AS b FROM occ UNION SELECT w.tile_id, w.a, f.b FROM w JOIN f ON f.tile_id = w.tile_id AND f.a = w.b), lab AS MATERIALIZED (SELECT tile_id, a % 8 AS x, CAST((a - a % 8) / 8 AS BIGINT) AS y, min(b) AS component FROM w GROUP BY tile_id, a)"""


@query(
    "contact_bridges",
    f"""{MASKS.replace("WITH", "WITH RECURSIVE", 1)}, {CONTACTS}, {PAIRS}, {LABELLED}, t AS (SELECT DISTINCT tile_id, component, x + dx AS x, y + dy AS y FROM lab, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy)),
k AS (SELECT DISTINCT p.tile_id, p.ay FROM pairs p JOIN t a ON a.tile_id = p.tile_id AND a.x = p.ax AND a.y = p.ay JOIN t b ON b.tile_id = p.tile_id AND b.x = p.bx AND b.y = p.by AND b.component = a.component)
SELECT DISTINCT p.tile_id, p.ay AS evidence, k.ay IS NOT NULL AS bridged FROM pairs p LEFT JOIN k ON k.tile_id = p.tile_id AND k.ay = p.ay""",
)
def contact_bridges(spark, d):
    visible, hidden, occluder, _ = _masks(spark, d)
    pairs = occlusion.row_pairs(occlusion.contact_sides(visible, hidden)).withColumn("evidence", F.col("ay"))
    labels = raster_udf.tile_components(lifts.pixels(spark, d).withColumn("v", F.when(F.col("v") < 126, 255).otherwise(0).cast("long")))
    return occlusion.bridged_pairs(pairs, labels.select("tile_id", "x", "y", "component"))


@query("completion_outcome", f"WITH {duck('nodes')}, c AS (SELECT slide_id, ord, role = 3 AS asked, w > 80 AS geometry, conf >= 85 AS samples, z % 2 = 0 AS bridged, x % 3 > 0 AS single FROM nodes) SELECT slide_id, ord, CASE WHEN NOT asked THEN 'skipped:not_requested' WHEN NOT geometry THEN 'rejected:invalid_geometry' WHEN NOT samples THEN 'rejected:insufficient_evidence' WHEN NOT bridged THEN 'rejected:contacts_not_bridged' WHEN NOT single THEN 'rejected:separate_parts' ELSE 'accepted' END AS outcome FROM c")
def completion_outcome(spark, d):
    c = F.col
    state = occlusion.outcome(c("role") == 3, c("w") > 80, c("conf") >= 85, c("z") % 2 == 0, c("x") % 3 > 0)
    return lifts.nodes(spark, d).select("slide_id", "ord", state.alias("outcome"))


@query(
    "crop_canonicity",
    f"""{PIXEL_NODES}, c AS (SELECT slide_id, ord, x, y, w, h, greatest(0, x - z) AS cx, greatest(0, y - 3) AS cy, least({WIDTH}, x + w + 3) AS r, least({HEIGHT}, y + h + z) AS b FROM clipped)
SELECT slide_id, ord, x - cx <= 4 AND y - cy <= 4 AND r - x - w <= 4 AND b - y - h <= 4 AND NOT (cx = 0 AND cy = 0 AND r = {WIDTH} AND b = {HEIGHT}) AS canonical FROM c""",
)
def crop_canonicity(spark, d):
    b, z = g.box(), F.col("z")
    left, top = F.greatest(b.x - z, F.lit(0)), F.greatest(b.y - 3, F.lit(0))
    crop = (left, top, F.least(b.right + 3, F.lit(WIDTH)) - left, F.least(b.bottom + z, F.lit(HEIGHT)) - top)
    return _clipped(spark, d).select("slide_id", "ord", occlusion.crop_is_canonical((F.lit(WIDTH), F.lit(HEIGHT)), crop, (b.x, b.y, b.w, b.h), F.lit(4)).alias("canonical"))


@query(
    "candidates_with_masks",
    grouped(f"""{GRAPH}, {REL}, o AS (SELECT slide_id, to_id AS node_id, from_id AS occluder FROM rel WHERE kind = 'occludes'), m AS (SELECT slide_id, node_id FROM nodes WHERE ord % 3 <> 0),
k AS (SELECT o.slide_id, o.node_id FROM o LEFT JOIN m ON m.slide_id = o.slide_id AND m.node_id = o.occluder GROUP BY ALL HAVING count(*) = count(m.node_id))
SELECT n.slide_id, n.node_id FROM nodes n JOIN m ON m.slide_id = n.slide_id AND m.node_id = n.node_id JOIN k ON k.slide_id = n.slide_id AND k.node_id = n.node_id"""),
)
def candidates_with_masks(spark, d):
    n = lifts.nodes(spark, d)
    front = _relations(spark, d).where("kind = 'occludes'").select("slide_id", F.col("to_id").alias("node_id"), F.col("from_id").alias("occluder_id"))
    return candidates.with_all_masks(n, front, n.where("ord % 3 <> 0"))


@query(
    "carried_texts_valid",
    f"{GRAPH}, {REL}, c AS (SELECT slide_id, from_id AS node_id, to_id AS text_id FROM rel WHERE kind IN ('carries-text', 'belongs-to')), t AS (SELECT slide_id, node_id FROM nodes WHERE role IN (1, 2, 3)) SELECT c.slide_id, c.node_id, count(*) = count(DISTINCT c.text_id) AND count(*) = count(t.node_id) AS valid FROM c LEFT JOIN t ON t.slide_id = c.slide_id AND t.node_id = c.text_id GROUP BY c.slide_id, c.node_id",
)
def carried_texts_valid(spark, d):
    c = _relations(spark, d).where("kind in ('carries-text', 'belongs-to')").select("slide_id", F.col("from_id").alias("node_id"), F.col("to_id").alias("text_id"))
    return candidates.carried_texts(c, lifts.nodes(spark, d).where("role in (1, 2, 3)"))


@query("unplanned_completions", f"WITH {duck('nodes')} SELECT slide_id, node_id FROM nodes WHERE ord % 4 = 0 AND NOT (conf >= 90)")
def unplanned_completions(spark, d):
    n = lifts.nodes(spark, d)
    return candidates.unknown(n.where("ord % 4 = 0").select("slide_id", "node_id"), n.where("conf >= 90"), "slide_id", "node_id")


@query(
    "compound_members",
    grouped(f"""{GRAPH}, {REL}, p AS (SELECT DISTINCT r.slide_id, c.node_id AS group_id, CASE WHEN r.from_id = c.node_id THEN r.to_id ELSE r.from_id END AS node_id FROM rel r JOIN nodes c ON c.slide_id = r.slide_id AND c.role = 4 AND c.node_id IN (r.from_id, r.to_id))
SELECT p.slide_id, p.group_id || ':' || p.node_id AS member_id, CASE WHEN n.role = 4 THEN 'compound-group' ELSE 'foreground-object' END AS kind, n.z FROM p JOIN nodes n ON n.slide_id = p.slide_id AND n.node_id = p.node_id WHERE n.role IN (3, 4, 6)"""),
)
def compound_members(spark, d):
    n = _named(lifts.nodes(spark, d))
    rel = _relations(spark, d)
    ends = rel.select("slide_id", F.col("from_id").alias("node_id"), F.col("to_id").alias("other")).union(rel.select("slide_id", "to_id", "from_id"))
    groups = n.where("role = 'compound-group'").join(ends, ["slide_id", "node_id"]).groupBy("slide_id", "node_id", "z").agg(F.concat(F.array("node_id"), F.collect_set("other")).alias("node_ids"))
    return candidates.members(groups, n)


@query("repair_totals", f"WITH {duck('nodes')} SELECT slide_id, CAST(sum(w) AS BIGINT) AS masked, CAST(sum(z) AS BIGINT) AS outside, CAST(sum(h) AS BIGINT) AS ring, max(conf) AS mad, max(x) AS p95 FROM nodes GROUP BY slide_id")
def repair_totals(spark, d):
    n = lifts.nodes(spark, d).select("slide_id", F.col("w").alias("masked"), F.col("z").alias("outside"), F.col("h").alias("ring"), F.col("conf").alias("mad"), F.col("x").alias("p95"))
    return candidates.repair_totals(n, "slide_id")


@query(
    "final_z",
    f"WITH {duck('nodes')}, t AS (SELECT slide_id, max(z) AS top FROM nodes WHERE role <> 1 GROUP BY slide_id) SELECT slide_id, node_id, z AS final_z FROM nodes WHERE role <> 1 UNION ALL SELECT n.slide_id, n.node_id, coalesce(t.top, -1) + row_number() OVER (PARTITION BY n.slide_id ORDER BY n.ord) FROM nodes n LEFT JOIN t ON t.slide_id = n.slide_id WHERE n.role = 1",
)
def final_z(spark, d):
    n = lifts.nodes(spark, d)
    return candidates.final_z(n.where("role <> 1"), n.where("role = 1"))


@query(
    "completion_context",
    grouped(f"""WITH {duck("nodes")}, k AS (SELECT slide_id, CASE WHEN role < 3 THEN 'rear' ELSE 'front' END AS side, node_id, repeat(node_id, CAST(z * 60 AS BIGINT)) AS label FROM nodes), p AS (SELECT *, row_number() OVER (PARTITION BY slide_id, side ORDER BY node_id) AS n FROM k), q AS MATERIALIZED (SELECT * FROM p WHERE n <= 8),
l AS (SELECT slide_id, max(u) AS lim FROM (SELECT slide_id, u, 200 + sum(40 + length(node_id) + least(length(label), u)) AS bytes FROM q, range(0, 201) r(u) GROUP BY ALL) b WHERE bytes <= 8192 GROUP BY slide_id) SELECT q.slide_id, q.side, q.node_id, substring(q.label, 1, l.lim) AS label FROM q JOIN l ON l.slide_id = q.slide_id"""),
)
def completion_context(spark, d):
    n = lifts.nodes(spark, d).select("slide_id", F.when(F.col("role") < 3, "rear").otherwise("front").alias("side"), "node_id", F.expr("repeat(node_id, cast(z * 60 as int))").alias("label"))
    return candidates.context_nodes(n)


OWNERS = f"WITH RECURSIVE {duck('pixels')}, own AS MATERIALIZED (SELECT tile_id, 'a' AS owner, x, y FROM pixels WHERE v >= 140 AND x < 4 UNION ALL SELECT tile_id, 'b', x, y FROM pixels WHERE v < 100 UNION ALL SELECT tile_id, 'c', x, y FROM pixels WHERE y = 7 AND tile_id % 2 = 0 UNION ALL SELECT tile_id, 'd', x, y FROM pixels WHERE x = 6 AND y < 3)"


def _owners(spark: SparkSession, d: str) -> DataFrame:
    p = lifts.pixels(spark, d)
    part = lambda name, where: p.where(where).select("tile_id", F.lit(name).alias("owner"), "x", "y")
    return part("a", "v >= 140 and x < 4").union(part("b", "v < 100")).union(part("c", "y = 7 and tile_id % 2 = 0")).union(part("d", "x = 6 and y < 3"))


@query(
    "owner_groups",
    f"{OWNERS}, e AS (SELECT DISTINCT p.tile_id, p.owner AS a, q.owner AS b FROM own p JOIN own q ON q.tile_id = p.tile_id AND q.x = p.x AND q.y = p.y), w AS (SELECT tile_id, a, b FROM e UNION SELECT w.tile_id, w.a, e.b FROM w JOIN e ON e.tile_id = w.tile_id AND e.a = w.b) SELECT tile_id, a AS owner, min(b) AS owner_group FROM w GROUP BY tile_id, a",
)
def owner_groups(spark, d):
    return candidates.owner_groups(_owners(spark, d))


@query("union_coverage", f"{OWNERS}, u AS (SELECT tile_id, x, y FROM pixels WHERE (v >= 140 AND x < 4) OR v < 100 OR (x = 6 AND y < 2)), f AS (SELECT coalesce(u.tile_id, o.tile_id) AS tile_id, u.x AS ux, o.x AS ox FROM u FULL JOIN (SELECT DISTINCT tile_id, x, y FROM own) o ON o.tile_id = u.tile_id AND o.x = u.x AND o.y = u.y) SELECT tile_id, count(*) FILTER (WHERE ox IS NULL) AS only_union, count(*) FILTER (WHERE ux IS NULL) AS only_owners FROM f GROUP BY tile_id HAVING count(*) FILTER (WHERE ox IS NULL OR ux IS NULL) > 0")
def union_coverage(spark, d):
    return candidates.coverage_faults(lifts.pixels(spark, d).where("(v >= 140 and x < 4) or v < 100 or (x = 6 and y < 2)"), _owners(spark, d))


@query(
    "box_on_mask",
    f"""WITH {duck("pixels")}, t AS (SELECT DISTINCT tile_id FROM pixels), b AS (SELECT tile_id, o AS ord, CAST((tile_id + o) % 9 AS DOUBLE) - 1.5 AS x, o * 0.75 AS y, 2.5 AS w, 1.25 + o AS h FROM t, range(0, 4) r(o)),
k AS (SELECT b.tile_id, b.ord, floor(x) AS l, floor(y) AS t, ceil(x + w) AS r, ceil(y + h) AS b FROM b),
n AS (SELECT k.tile_id, k.ord, count(p.v) FILTER (WHERE p.v >= 110) AS n FROM k LEFT JOIN pixels p ON p.tile_id = k.tile_id AND p.x >= k.l AND p.x < k.r AND p.y >= k.t AND p.y < k.b GROUP BY ALL)
SELECT k.tile_id, k.ord, n > 0 AS overlaps, l >= 0 AND t >= 0 AND r <= 8 AND b <= 8 AND n = (r - l) * (b - t) AS covered FROM k JOIN n ON n.tile_id = k.tile_id AND n.ord = k.ord""",
)
def box_on_mask(spark, d):
    p = lifts.pixels(spark, d)
    b = p.select("tile_id").distinct().select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("ord"))
    b = b.select("tile_id", "ord", ((F.col("tile_id") + F.col("ord")) % 9 - 1.5).alias("x"), (F.col("ord") * 0.75).alias("y"), F.lit(2.5).alias("w"), (F.col("ord") + 1.25).alias("h"))
    return candidates.box_on_mask(b, p.where("v >= 110"), 8, 8)


@query("canonical_targets", f"WITH {duck('nodes')}, a AS (SELECT DISTINCT slide_id, node_id FROM nodes WHERE ord % 2 = 0 AND role NOT IN (0, 1)) SELECT slide_id, string_agg(node_id, ',' ORDER BY node_id) AS targets FROM a GROUP BY slide_id")
def canonical_targets(spark, d):
    n = _named(lifts.nodes(spark, d))
    asked = n.where("ord % 2 = 0").select("slide_id", "node_id")
    asked = asked.union(asked).union(n.select("slide_id", F.concat("node_id", F.lit("?"))))
    return candidates.target_nodes(asked, n).select("slide_id", F.array_join("targets", ",").alias("targets"))


@query(
    "candidate_relations",
    f"{GRAPH}, {REL}, a AS (SELECT slide_id, from_id AS node_id, rel_id, conf >= 85 AS known FROM rel) SELECT slide_id, node_id, coalesce(string_agg(rel_id, ',' ORDER BY rel_id) FILTER (WHERE known), '') AS rel_ids, count(*) FILTER (WHERE NOT known) AS missing FROM a GROUP BY slide_id, node_id",
)
def candidate_relations(spark, d):
    rel = _relations(spark, d)
    out = candidates.relations_of(rel.select("slide_id", F.col("from_id").alias("node_id"), "rel_id"), rel.where("conf >= 85"))
    return out.select("slide_id", "node_id", F.array_join("rel_ids", ",").alias("rel_ids"), "missing")


@query(
    "removal_shapes",
    f"""{PIXEL_NODES}, k AS (SELECT *, CASE role % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'asset' ELSE 'shape' END AS kind, CASE z % 3 WHEN 0 THEN 'rect' WHEN 1 THEN 'roundRect' ELSE 'ellipse' END AS shape FROM clipped), p AS (SELECT *, CASE kind WHEN 'text' THEN 4 WHEN 'asset' THEN 6 ELSE 2 END AS pad FROM k)
SELECT slide_id, ord, CASE WHEN kind = 'shape' AND shape = 'roundRect' THEN 'round_rectangle' WHEN kind = 'shape' AND shape = 'ellipse' THEN 'ellipse' ELSE 'polygon' END AS primitive, x - pad AS x, y - pad AS y, w + 2 * pad AS w, h + 2 * pad AS h FROM p""",
)
def removal_shapes(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("text", "asset", "shape"))), (F.col("role") % 3 + 1).cast("int"))
    shape = F.element_at(F.array(*map(F.lit, ("rect", "roundRect", "ellipse"))), (F.col("z") % 3 + 1).cast("int"))
    made = candidates.removal_shape(kind, shape, *(F.col(c) for c in "xywh"))
    return _clipped(spark, d).select("slide_id", "ord", *(c.alias(n) for n, c in zip(("primitive", "x", "y", "w", "h"), made, strict=True)))


OVERLAID = f"WITH {duck('nodes')}, b AS (SELECT slide_id, ord, greatest(0, floor(x * 1.25 - 40) - {{0}}) AS l, greatest(0, floor(y * 1.25 - 40) - {{0}}) AS t, least({WIDTH}, ceil(x * 1.25 - 40 + w * 0.5) + {{0}}) AS r, least({HEIGHT}, ceil(y * 1.25 - 40 + h * 0.5) + {{0}}) AS b FROM nodes) SELECT slide_id, ord, CASE WHEN r > l AND b > t THEN CAST(l AS BIGINT) END AS l, CASE WHEN r > l AND b > t THEN CAST(t AS BIGINT) END AS t, CASE WHEN r > l AND b > t THEN CAST(r AS BIGINT) END AS r, CASE WHEN r > l AND b > t THEN CAST(b AS BIGINT) END AS b FROM b"


def _overlaid(spark: SparkSession, d: str, pad: int) -> DataFrame:
    c = F.col
    box = candidates.overlay_bounds(c("x") * 1.25 - 40, c("y") * 1.25 - 40, c("w") * 0.5, c("h") * 0.5, WIDTH, HEIGHT, pad)
    out = lifts.nodes(spark, d).select("slide_id", "ord", box.alias("o"))
    return out.select("slide_id", "ord", *(F.col(f"o.{n}").alias(n[0]) for n in ("left", "top", "right", "bottom")))


@query("overlay_bounds", OVERLAID.format(9))
def overlay_bounds(spark, d):
    return _overlaid(spark, d, candidates.OVERLAY)


@query("integer_crop", OVERLAID.format(0))
def integer_crop(spark, d):
    return _overlaid(spark, d, 0)


@query("ocr_escapes_canvas", f"WITH {duck('ocr')} SELECT slide_id, source_index, x < 0 OR y < 0 OR x + w > 400 OR y + h > 900 OR x + w + source_index % 3 > 400 AS escapes FROM ocr")
def ocr_escapes_canvas(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    quad = F.array(point(x, y), point(x + w + F.col("source_index") % 3, y), point(x + w, y + h), point(x, y + h))
    return lifts.ocr(spark, d).select("slide_id", "source_index", candidates.escapes_canvas(x, y, w, h, quad, 400, 900).alias("escapes"))


@query(
    "identifier_rules",
    f"WITH i AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'model-' || page_id WHEN 2 THEN sha256(url) ELSE '-' || page_id END AS id FROM pages) SELECT page_id, regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9._:/-]{{0,127}}') AS model, length(id) BETWEEN 1 AND 63 AND regexp_full_match(id, '[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?') AS workspace, regexp_full_match(id, '[a-f0-9]{{64}}') AS sha FROM i".replace("{{", "{").replace("}}", "}"),
)
def identifier_rules(spark, d):
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    ident = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("model-"), n)).when(k == 2, F.sha2(F.col("url").cast("binary"), 256)).otherwise(F.concat(F.lit("-"), n))
    rules = {"model": candidates.MODEL_ID, "workspace": candidates.WORKSPACE_ID, "sha": candidates.SHA256}
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", *(ident.rlike(p).alias(name) for name, p in rules.items()))


@query(
    "ledger_artifacts",
    f"WITH {duck('nodes')}, a AS (SELECT slide_id, 'm/' || ord AS path, sha256(node_id) AS sha256 FROM nodes WHERE role = 3 UNION ALL SELECT slide_id, 'c/' || ord % 3, sha256(CAST(ord % 3 AS VARCHAR)) FROM nodes WHERE role = 3) SELECT DISTINCT slide_id, path, sha256 FROM a",
)
def ledger_artifacts(spark, d):
    art = lambda path, of: F.struct(path.alias("path"), F.sha2(of.cast("binary"), 256).alias("sha256"))
    o = F.col("ord")
    n = lifts.nodes(spark, d).where("role = 3").select("slide_id", art(F.concat(F.lit("m/"), o.cast("string")), F.col("node_id")).alias("mask"), F.array(art(F.concat(F.lit("c/"), (o % 3).cast("string")), (o % 3).cast("string"))).alias("crops"))
    return candidates.artifacts(n, "mask", "crops")



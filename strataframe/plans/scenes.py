"""Queries around hidden evidence, completion and repair on scenes of 16 x 12 pixels that follow from the embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators import backing, build, hidden, runs
from strataframe.operators.durable import large
from strataframe.plans.catalogue import query
from strataframe.plans.lifts import grouped

WIDE, HIGH = 16, 12
SPARK_VALUES = "SELECT vec_id AS tile_id, transform(embedding, e -> CAST(least(255D, greatest(0D, floor((CAST(e AS DOUBLE) + 1) * 128))) AS BIGINT)) AS v, sequence(0, 191) AS places FROM {embeddings}"
DUCK_VALUES = "SELECT vec_id AS tile_id, list_transform(embedding, lambda e: CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1) * 128))) AS BIGINT)) AS v, range(0, 192) AS places FROM embeddings"
#: A bar with holes, at times a second one; an object across it or over its end, at times a speck; colours of both and of what is behind; and
#: an answer that goes on with the bar, at times with a gap, with rests of the object, half transparent or with changes elsewhere.
SCENES = """
SELECT tile_id, x, y, rear AND (NOT front OR tile_id % 4 = 0) AS visible, front, r, g, b, CASE WHEN tile_id % 23 = 0 AND y = 6 THEN 200 ELSE 255 END AS a,
  CASE WHEN front THEN ar ELSE r + CASE WHEN tile_id % 29 = 0 AND x = 0 THEN 1 ELSE 0 END END AS ar, CASE WHEN front THEN ag ELSE g END AS ag, CASE WHEN front THEN ab ELSE b END AS ab,
  CASE WHEN front AND NOT bar AND y % 2 = 0 THEN 0 WHEN front AND tile_id % 17 = 0 AND y = 5 THEN 100 WHEN front THEN 255 WHEN tile_id % 23 = 0 AND y = 6 THEN 200 ELSE 255 END AS aa
FROM (SELECT *, k + CASE WHEN front AND tile_id % 11 = 0 THEN 220 WHEN front THEN 40 WHEN rear THEN 200 ELSE 120 END AS r, k + CASE WHEN front AND tile_id % 11 <> 0 THEN 90 WHEN front OR rear THEN 60 + v2 % 20 ELSE 200 END AS g,
    k + CASE WHEN front AND tile_id % 11 <> 0 THEN 200 WHEN front OR rear THEN 60 ELSE 120 END AS b, n % 3 + CASE WHEN rest THEN 40 WHEN bar AND NOT gap THEN 200 ELSE 120 END AS ar,
    n % 3 + CASE WHEN rest THEN 90 WHEN bar AND NOT gap THEN 60 + v2 % 20 ELSE 200 END AS ag, n % 3 + CASE WHEN rest THEN 200 WHEN bar AND NOT gap THEN 60 ELSE 120 END AS ab
  FROM (SELECT *, x BETWEEN l AND e AND y BETWEEN 2 AND 9 OR tile_id % 3 = 0 AND x <= 1 AND y <= 1 AS front, (bar AND x BETWEEN 1 AND 14 OR tile_id % 5 = 0 AND y = 10 AND x BETWEEN 1 AND 5) AND n % 64 <> 3 AS rear,
      CASE WHEN tile_id % 19 = 0 THEN n % 40 ELSE n % 4 END AS k, tile_id % 13 = 0 AND x = l AND y = 5 AS rest, tile_id % 6 = 5 AND x = l + 1 AS gap
    FROM (SELECT *, y BETWEEN 4 AND 7 - tile_id % 2 AS bar, CASE WHEN tile_id % 7 = 0 THEN 11 ELSE 6 + v0 % 4 END AS l, CASE WHEN tile_id % 7 = 0 THEN 15 ELSE 8 + v0 % 4 + v1 % 2 END AS e
      FROM (SELECT tile_id, x, y, {at}(v, 1) AS v0, {at}(v, 2) AS v1, {at}(v, 3) AS v2, {at}(v, CAST((x * 7 + y * 5) % 64 + 1 AS INT)) AS n
        FROM (SELECT tile_id, v, CAST(i % 16 AS BIGINT) AS x, CAST((i - i % 16) / 16 AS BIGINT) AS y FROM (SELECT tile_id, v, {explode}(places) AS i FROM values_) p) c) q) s) t) u
"""
#: What is asked for: eight scenes make a page; the tolerance follows from the box of the object.
TILES = """
SELECT tile_id, CAST((tile_id - tile_id % 8) / 8 AS BIGINT) AS page, tile_id % 10 <> 9 AS requested, tile_id % 41 <> 0 AS valid, tile_id % 43 <> 0 AS answered, CAST(20 + {at}(v, 4) % 60 AS BIGINT) AS w, CAST(12 + {at}(v, 5) % 40 AS BIGINT) AS h FROM values_
"""
DUCK = f"WITH RECURSIVE values_ AS MATERIALIZED ({DUCK_VALUES}), scenes AS MATERIALIZED ({SCENES.format(at='list_extract', explode='unnest')}), tiles AS MATERIALIZED (SELECT *, CAST(greatest(1, least(least(greatest(1, floor(600 / 64 + 0.5)), greatest(1, floor(least(w, h) / 4))), floor(least(w, h) / 16 + 0.5))) AS BIGINT) AS tolerance FROM ({TILES.format(at='list_extract')}) t)"


def duck_components(name: str, mask: str, corners: bool = True) -> str:
    """Clauses name_r (runs, k), name (tile_id, x, y, c): the pixels of ``mask`` with the first run of their components."""
    reach = 1 if corners else 0
    return f"""{name}_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY y, x0) AS k FROM (SELECT tile_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY tile_id, y ORDER BY x) AS i FROM {mask}) m GROUP BY tile_id, y, i) g),
{name}_e AS MATERIALIZED (SELECT a.tile_id, a.k AS a, b.k AS b FROM {name}_r a JOIN {name}_r b ON a.tile_id = b.tile_id AND abs(a.y - b.y) = 1 WHERE a.x0 <= b.x1 + {reach} AND b.x0 <= a.x1 + {reach}),
{name}_w AS (SELECT tile_id, k AS a, k AS b FROM {name}_r UNION SELECT w.tile_id, w.a, e.b FROM {name}_w w JOIN {name}_e e ON e.tile_id = w.tile_id AND e.a = w.b),
{name} AS MATERIALIZED (SELECT r.tile_id, unnest(range(r.x0, r.x1 + 1)) AS x, r.y, l.c FROM {name}_r r JOIN (SELECT tile_id, a, min(b) AS c FROM {name}_w GROUP BY tile_id, a) l ON l.tile_id = r.tile_id AND l.a = r.k)"""


EVIDENCE = f"""vis AS MATERIALIZED (SELECT tile_id, x, y FROM scenes WHERE visible AND NOT front), occ AS MATERIALIZED (SELECT tile_id, x, y FROM scenes WHERE front), {duck_components("rear", "vis")}, {duck_components("pos", "occ")},
sides(side, dx, dy) AS (VALUES ('left', 1, 0), ('right', -1, 0), ('top', 0, 1), ('bottom', 0, -1)),
touch AS MATERIALIZED (SELECT DISTINCT p.tile_id, p.c AS piece, s.side, v.x, v.y, v.c AS part FROM pos p, sides s, rear v WHERE v.tile_id = p.tile_id AND v.x = p.x - s.dx AND v.y = p.y - s.dy),
goes AS (SELECT n.tile_id, n.piece, n.part FROM (SELECT tile_id, piece, part, count(DISTINCT y * 16 + x) AS n FROM touch GROUP BY ALL) n JOIN (SELECT tile_id, c, count(*) AS n FROM rear GROUP BY ALL) s ON s.tile_id = n.tile_id AND s.c = n.part WHERE n.n < s.n),
ends AS MATERIALIZED (SELECT t.*, CASE WHEN side IN ('left', 'right') THEN t.y ELSE t.x END AS line, i.tolerance FROM touch t JOIN goes g ON g.tile_id = t.tile_id AND g.piece = t.piece AND g.part = t.part JOIN tiles i ON i.tile_id = t.tile_id),
pairs AS MATERIALIZED (SELECT a.tile_id, a.piece, a.side, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy, b.side AS other FROM ends a JOIN ends b ON a.tile_id = b.tile_id AND a.piece = b.piece WHERE (a.side, b.side) IN (('left', 'right'), ('top', 'bottom')) AND abs(a.line - b.line) <= a.tolerance),
ev AS MATERIALIZED (SELECT p.tile_id, p.c AS piece, count(*) AS pixels, min(p.y * 1048576 + p.x) AS component FROM pos p WHERE (p.tile_id, p.c) IN (SELECT (tile_id, piece) FROM pairs) GROUP BY ALL),
hid AS MATERIALIZED (SELECT p.tile_id, p.x, p.y, p.c AS piece FROM pos p WHERE (p.tile_id, p.c) IN (SELECT (tile_id, piece) FROM pairs)),
con AS MATERIALIZED (SELECT tile_id, piece, ax AS x, ay AS y, side FROM pairs UNION SELECT tile_id, piece, qx, qy, other FROM pairs)"""


def scenes(spark: SparkSession, d: str) -> DataFrame:
    v = spark.sql(SPARK_VALUES, embeddings=spark.read.parquet(f"{d}/embeddings.parquet"))
    return spark.sql(SCENES.format(at="element_at", explode="explode").replace("values_", "{values_}"), values_=v)


def tiles(spark: SparkSession, d: str) -> DataFrame:
    v = spark.sql(SPARK_VALUES, embeddings=spark.read.parquet(f"{d}/embeddings.parquet"))
    out = spark.sql(TILES.format(at="element_at").replace("values_", "{values_}"), values_=v)
    return out.withColumn("tolerance", hidden.alignment(F.lit(1000), F.lit(600), F.col("w"), F.col("h")))


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """visible, occluder, source, returned, tolerance."""
    s = large(scenes(spark, d), "scenes")
    of = lambda *c: s.select("tile_id", "x", "y", *(F.col(n).cast("long").alias(n[-1]) for n in c))
    mask = lambda where: s.where(where).select("tile_id", "x", "y")
    return mask("visible"), mask("front"), of("r", "g", "b", "a"), of("ar", "ag", "ab", "aa"), tiles(spark, d).select("tile_id", "tolerance")


def _evidence(spark: SparkSession, d: str) -> hidden.Evidence:
    visible, occluder, _, _, tolerance = _inputs(spark, d)
    return hidden.hidden_evidence(visible, occluder, tolerance)


@query("mask_components", f"{DUCK}, vis AS (SELECT tile_id, x, y FROM scenes WHERE visible), {duck_components('m', 'vis')} SELECT tile_id, min(y * 16 + x) AS first, count(*) AS pixels FROM m GROUP BY tile_id, c")
def mask_components(spark, d):
    return runs.sizes(runs.components(_inputs(spark, d)[0])).select("tile_id", runs.place(F.col("component"), WIDE).alias("first"), "pixels")


@query("hidden_evidence", grouped(f"{DUCK}, {EVIDENCE} SELECT e.tile_id, e.component, e.pixels, p.n AS pairs, c.n AS contacts FROM ev e JOIN (SELECT tile_id, piece, count(*) AS n FROM pairs GROUP BY ALL) p ON p.tile_id = e.tile_id AND p.piece = e.piece JOIN (SELECT tile_id, piece, count(*) AS n FROM con GROUP BY ALL) c ON c.tile_id = e.tile_id AND c.piece = e.piece"))
def hidden_evidence(spark, d):
    e = _evidence(spark, d)
    n = e.contacts.groupBy("tile_id", "component").agg(F.count(F.lit(1)).alias("contacts"))
    return e.pieces.join(n, ["tile_id", "component"]).select("tile_id", "component", "pixels", F.col("pairs").cast("long").alias("pairs"), "contacts")


LOOK = """opq AS MATERIALIZED (SELECT tile_id, x, y, r, g, b FROM scenes WHERE a >= 240), hpx AS MATERIALIZED (SELECT DISTINCT tile_id, x, y FROM hid), cpx AS MATERIALIZED (SELECT DISTINCT tile_id, x, y FROM con),
cs AS MATERIALIZED (SELECT DISTINCT c.tile_id, c.x, c.y, s.side FROM cpx c, sides s, hpx h WHERE h.tile_id = c.tile_id AND h.x = c.x + s.dx AND h.y = c.y + s.dy),
has AS (SELECT tile_id, bool_or(side = 'left') AND bool_or(side = 'right') AS across, bool_or(side = 'top') AND bool_or(side = 'bottom') AS down FROM cs GROUP BY tile_id),
near AS MATERIALIZED (SELECT DISTINCT c.tile_id, c.side, f.x, f.y FROM cs c JOIN has ON has.tile_id = c.tile_id AND CASE WHEN across THEN side IN ('left', 'right') WHEN down THEN side IN ('top', 'bottom') ELSE FALSE END JOIN vis f ON f.tile_id = c.tile_id JOIN opq o ON o.tile_id = f.tile_id AND o.x = f.x AND o.y = f.y WHERE abs(f.x - c.x) <= 3 AND abs(f.y - c.y) <= 3),
ok AS (SELECT tile_id FROM (SELECT tile_id, side FROM near GROUP BY ALL HAVING count(*) >= 8) s GROUP BY tile_id HAVING count(*) = 2),
part AS MATERIALIZED (SELECT DISTINCT tile_id, x, y, 'rear' AS part FROM near WHERE tile_id IN (SELECT tile_id FROM ok) UNION ALL SELECT tile_id, x, y, 'front' FROM hpx
  UNION ALL SELECT DISTINCT o.tile_id, o.x, o.y, 'background' FROM hpx h JOIN opq o ON o.tile_id = h.tile_id WHERE abs(o.x - h.x) <= 3 AND abs(o.y - h.y) <= 3 AND (o.tile_id, o.x, o.y) NOT IN (SELECT (tile_id, x, y) FROM vis) AND (o.tile_id, o.x, o.y) NOT IN (SELECT (tile_id, x, y) FROM occ)),
sam AS MATERIALIZED (SELECT p.*, o.r, o.g, o.b FROM part p JOIN opq o ON o.tile_id = p.tile_id AND o.x = p.x AND o.y = p.y),
med AS MATERIALIZED (SELECT tile_id, part, count(*) AS n, median(r) AS r, median(g) AS g, median(b) AS b FROM sam GROUP BY ALL),
dev AS (SELECT s.tile_id, s.part, quantile_disc(greatest(abs(s.r - m.r), abs(s.g - m.g), abs(s.b - m.b)), 0.95) AS off FROM sam s JOIN med m ON m.tile_id = s.tile_id AND m.part = s.part GROUP BY ALL),
wide AS (SELECT t.tile_id, coalesce(r.n, 0) AS rear_n, coalesce(f.n, 0) AS front_n, coalesce(k.n, 0) AS background_n, r.r AS rear_r, r.g AS rear_g, r.b AS rear_b, f.r AS front_r, f.g AS front_g, f.b AS front_b, k.r AS background_r, k.g AS background_g, k.b AS background_b
  FROM (SELECT DISTINCT tile_id FROM hpx) t LEFT JOIN med r ON r.tile_id = t.tile_id AND r.part = 'rear' LEFT JOIN med f ON f.tile_id = t.tile_id AND f.part = 'front' LEFT JOIN med k ON k.tile_id = t.tile_id AND k.part = 'background'),
look AS MATERIALIZED (SELECT w.*, CASE WHEN rear_n < 8 OR front_n < 8 OR background_n < 8 THEN 'insufficient_evidence' WHEN d.off > 6 OR greatest(abs(rear_r - front_r), abs(rear_g - front_g), abs(rear_b - front_b)) < 36 OR greatest(abs(rear_r - background_r), abs(rear_g - background_g), abs(rear_b - background_b)) < 36
  OR greatest(abs(front_r - background_r), abs(front_g - background_g), abs(front_b - background_b)) < 36 THEN 'ambiguous_appearance' END AS reason FROM wide w LEFT JOIN (SELECT tile_id, max(off) AS off FROM dev GROUP BY tile_id) d ON d.tile_id = w.tile_id)"""
PROFILE = "tile_id, rear_n, front_n, background_n, rear_r, rear_g, rear_b, front_r, front_g, front_b, background_r, background_g, background_b, reason"


@query("appearance_profile", f"{DUCK}, {EVIDENCE}, {LOOK} SELECT {PROFILE} FROM look")
def appearance_profile(spark, d):
    visible, occluder, source, _, tolerance = _inputs(spark, d)
    e = hidden.hidden_evidence(visible, occluder, tolerance).stored()
    return hidden.appearance(e, occluder, source).select(*PROFILE.split(", "))


_D = lambda p: f"greatest(abs(s.ar - {p}_r), abs(s.ag - {p}_g), abs(s.ab - {p}_b))"
JUDGED = f"""cls AS MATERIALIZED (SELECT h.tile_id, h.piece, h.x, h.y, s.ar, s.ag, s.ab, s.aa, {_D("rear")} AS dr, {_D("front")} AS df, {_D("background")} AS db FROM hid h JOIN scenes s ON s.tile_id = h.tile_id AND s.x = h.x AND s.y = h.y JOIN look l ON l.tile_id = h.tile_id AND l.reason IS NULL),
kind AS MATERIALIZED (SELECT *, CASE WHEN aa < 16 THEN 'none' WHEN aa < 240 THEN 'fringe' WHEN least(dr, df, db) > 12 OR (dr = least(dr, df, db))::INT + (df = least(dr, df, db))::INT + (db = least(dr, df, db))::INT > 1 THEN 'unknown' WHEN dr <= df AND dr <= db THEN 'rear' WHEN df <= db THEN 'front' ELSE 'background' END AS kind FROM cls),
gen AS MATERIALIZED (SELECT tile_id, x, y, piece, ar, ag, ab FROM kind WHERE kind = 'rear'), gpx AS MATERIALIZED (SELECT tile_id, x, y FROM gen), both_ AS MATERIALIZED (SELECT * FROM gpx UNION SELECT * FROM vis), {duck_components("gc", "gpx")}, {duck_components("bc", "both_")},
mov AS (SELECT s.tile_id, count(*) FILTER (h.x IS NULL) AS outside_changed, count(v.x) AS visible_changed FROM scenes s LEFT JOIN hpx h ON h.tile_id = s.tile_id AND h.x = s.x AND h.y = s.y LEFT JOIN vis v ON v.tile_id = s.tile_id AND v.x = s.x AND v.y = s.y WHERE s.r <> s.ar OR s.g <> s.ag OR s.b <> s.ab OR s.a <> s.aa GROUP BY s.tile_id),
sea AS (SELECT c.tile_id, c.x, c.y, s.a, count(g.x) AS n, max(greatest(abs(s.r - g.ar), abs(s.g - g.ag), abs(s.b - g.ab))) AS step FROM cpx c JOIN scenes s ON s.tile_id = c.tile_id AND s.x = c.x AND s.y = c.y LEFT JOIN gen g ON g.tile_id = c.tile_id AND abs(g.x - c.x) + abs(g.y - c.y) = 1 GROUP BY ALL),
seam AS (SELECT tile_id, max(step) AS seam, min(CASE WHEN n = 0 AND a >= 240 THEN y * 1048576 + x END) AS open_, min(CASE WHEN a < 240 THEN y * 1048576 + x END) AS translucent FROM sea GROUP BY tile_id),
tch AS MATERIALIZED (SELECT DISTINCT c.tile_id, c.piece, c.x, c.y, k.c AS made FROM con c JOIN gen g ON g.tile_id = c.tile_id AND g.piece = c.piece AND abs(g.x - c.x) + abs(g.y - c.y) = 1 JOIN gc k ON k.tile_id = g.tile_id AND k.x = g.x AND k.y = g.y),
bri AS (SELECT e.tile_id, bool_and((e.tile_id, e.piece) IN (SELECT (p.tile_id, p.piece) FROM pairs p JOIN tch a ON a.tile_id = p.tile_id AND a.piece = p.piece AND a.x = p.ax AND a.y = p.ay JOIN tch b ON b.tile_id = p.tile_id AND b.piece = p.piece AND b.x = p.qx AND b.y = p.qy AND b.made = a.made)) AS bridged FROM ev e GROUP BY e.tile_id),
sum_ AS (SELECT tile_id, count(*) FILTER (kind = 'rear') AS generated, count(*) FILTER (kind = 'front') AS residual, count(*) FILTER (kind = 'unknown') AS unknown, count(*) FILTER (kind = 'fringe') AS fringe FROM kind GROUP BY tile_id),
jud0 AS (SELECT k.*, coalesce(m.outside_changed, 0) AS outside_changed, coalesce(m.visible_changed, 0) AS visible_changed, s.seam, s.open_, s.translucent, coalesce(g.one, FALSE) AS one_piece, coalesce(w.one, FALSE) AS one_whole, coalesce(b.bridged, FALSE) AS bridged
  FROM sum_ k LEFT JOIN mov m ON m.tile_id = k.tile_id LEFT JOIN seam s ON s.tile_id = k.tile_id LEFT JOIN (SELECT tile_id, min(c) = max(c) AS one FROM gc GROUP BY tile_id) g ON g.tile_id = k.tile_id LEFT JOIN (SELECT tile_id, min(c) = max(c) AS one FROM bc GROUP BY tile_id) w ON w.tile_id = k.tile_id LEFT JOIN bri b ON b.tile_id = k.tile_id),
jud AS MATERIALIZED (SELECT *, CASE WHEN residual > 0 THEN 'residual_occluder' WHEN unknown > 0 OR fringe > 0 THEN 'ambiguous_appearance' WHEN open_ IS NOT NULL AND (translucent IS NULL OR open_ < translucent) THEN 'contour_mismatch' WHEN translucent IS NOT NULL OR seam > 12 THEN 'seam_mismatch' WHEN NOT (one_piece AND one_whole AND bridged) THEN 'contour_mismatch' END AS reason FROM jud0)"""
METRICS = "tile_id, generated, residual, unknown, fringe, outside_changed, visible_changed, seam, one_piece, one_whole, bridged, reason"


@query("candidate_assessment", f"{DUCK}, {EVIDENCE}, {LOOK}, {JUDGED} SELECT {METRICS} FROM jud")
def candidate_assessment(spark, d):
    visible, occluder, source, returned, tolerance = _inputs(spark, d)
    return hidden.completed(tiles(spark, d), visible, occluder, source, returned, tolerance)[1].select(*METRICS.split(", "))


OUTCOMES = """ask AS (SELECT t.*, e.tile_id IS NOT NULL AS evidence, l.reason AS look, j.tile_id IS NOT NULL AS judged, j.reason AS verdict FROM tiles t LEFT JOIN (SELECT DISTINCT tile_id FROM ev) e ON e.tile_id = t.tile_id LEFT JOIN look l ON l.tile_id = t.tile_id LEFT JOIN jud j ON j.tile_id = t.tile_id),
trn AS (SELECT *, sum(CASE WHEN requested AND valid AND evidence AND look IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY tile_id) AS turn FROM ask),
res AS MATERIALIZED (SELECT tile_id, CASE WHEN NOT requested OR requested AND valid AND evidence AND look IS NULL AND (turn > 4 OR NOT answered) THEN 'skipped' WHEN NOT valid OR NOT evidence OR look IS NOT NULL OR NOT judged OR verdict IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS status,
  CASE WHEN NOT requested OR NOT valid THEN 'geometry' WHEN NOT evidence THEN 'contour_mismatch' WHEN look IS NOT NULL THEN look WHEN turn > 4 THEN 'disabled' WHEN NOT answered THEN 'provider_failure' WHEN NOT judged THEN 'geometry' ELSE verdict END AS reason FROM trn)"""
HEX = " || ".join(f"lpad(lower(to_hex(CAST({c} AS BIGINT))), 2, '0')" for c in ("r", "g", "b", "a"))


@query(
    "completion_from_pixels",
    grouped(f"""{DUCK}, {EVIDENCE}, {LOOK}, {JUDGED}, {OUTCOMES}, img AS (SELECT s.tile_id, s.y, s.x, CASE WHEN v.x IS NOT NULL THEN s.r WHEN g.x IS NOT NULL THEN s.ar ELSE 0 END AS r, CASE WHEN v.x IS NOT NULL THEN s.g WHEN g.x IS NOT NULL THEN s.ag ELSE 0 END AS g, CASE WHEN v.x IS NOT NULL THEN s.b WHEN g.x IS NOT NULL THEN s.ab ELSE 0 END AS b, CASE WHEN v.x IS NOT NULL THEN s.a WHEN g.x IS NOT NULL THEN s.aa ELSE 0 END AS a
FROM scenes s JOIN res ON res.tile_id = s.tile_id AND res.status = 'accepted' LEFT JOIN vis v ON v.tile_id = s.tile_id AND v.x = s.x AND v.y = s.y LEFT JOIN gpx g ON g.tile_id = s.tile_id AND g.x = s.x AND g.y = s.y),
dig AS (SELECT tile_id, sha256(string_agg({HEX}, '' ORDER BY y, x)) AS sha256 FROM img GROUP BY tile_id) SELECT res.*, dig.sha256 FROM res LEFT JOIN dig ON dig.tile_id = res.tile_id"""),
)
def completion_from_pixels(spark, d):
    visible, occluder, source, returned, tolerance = _inputs(spark, d)
    result, _, image = hidden.completed(tiles(spark, d), visible, occluder, source, returned, tolerance)
    return result.join(hidden.image_digests(image), "tile_id", "left")


# ---- repair and recomposition of whole pages ---------------------------------------------------------------------------------------

#: What is taken out of a scene: a line of text (required), the object, the second bar, and a spot across the bar's upper side.
OWNED = """SELECT tile_id, 'text' AS owner, TRUE AS required, x, y FROM {s} WHERE tile_id % 2 = 0 AND y = 0 AND x BETWEEN 3 AND 5
UNION ALL SELECT tile_id, 'object', FALSE, x, y FROM {s} WHERE front UNION ALL SELECT tile_id, 'bar2', FALSE, x, y FROM {s} WHERE visible AND y = 10
UNION ALL SELECT tile_id, 'spot', FALSE, x, y FROM {s} WHERE tile_id % 4 <> 3 AND x BETWEEN 12 AND 13 AND y BETWEEN 5 AND 6"""
#: What is put back: the pixels taken out, some of them changed, half transparent at times, and strict at times.
LAID = """SELECT o.tile_id, o.owner, CASE o.owner WHEN 'object' THEN 2 WHEN 'bar2' THEN 1 ELSE 3 END AS z, o.owner = 'spot' AND o.tile_id % 5 = 2 AS strict, o.x, o.y,
CASE WHEN o.owner = 'object' AND o.tile_id % 3 = 1 AND o.x = 7 AND o.y BETWEEN 3 AND 7 THEN least(255, s.r + 60) WHEN o.owner = 'spot' AND o.tile_id % 5 = 2 AND o.tile_id % 2 = 1 AND o.y = 6 THEN s.r - 30 ELSE s.r END AS r, s.g, s.b,
CASE WHEN o.owner = 'bar2' AND o.tile_id % 10 = 5 THEN 100 ELSE 255 END AS a FROM {o} o JOIN {s} s ON s.tile_id = o.tile_id AND s.x = o.x AND s.y = o.y WHERE NOT o.required"""


def _page(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """source, owners, layers, ignored."""
    s = large(scenes(spark, d), "scenes")
    source = s.select("tile_id", "x", "y", *(F.col(c).cast("long").alias(c) for c in ("r", "g", "b")), F.lit(255).cast("long").alias("a"))
    owners = large(spark.sql(OWNED, s=s), "owners")
    layers = spark.sql(LAID, s=s, o=owners)
    layers = large(layers.select("tile_id", "owner", F.col("z").cast("long").alias("z"), "strict", "x", "y", *(F.col(c).cast("long").alias(c) for c in ("r", "g", "b", "a"))), "layers")
    return source, owners, layers, owners.where("required").select("tile_id", "x", "y")


@query("owner_union_repair")
def owner_union_repair(spark, d):
    source, owners, _, _ = _page(spark, d)
    out, filled = build.union_repair(source, owners)
    total = filled.groupBy("tile_id").agg(F.count(F.lit(1)).alias("filled"), F.sum(F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("colours"))
    return out.withColumn("failing", F.array_join("failing", ",")).join(total, "tile_id", "left")


def _covered(c: str) -> str:
    """A channel after the layers bar2, object and spot, in this order."""
    out = f"b.{c}"
    for layer in ("l1", "l2", "l3"):
        out = f"CASE WHEN {layer}.a IS NULL THEN {out} ELSE CAST(floor(({layer}.{c} * {layer}.a + ({out}) * (255 - {layer}.a)) / 255.0 + 0.5) AS BIGINT) END"
    return out


@query(
    "page_recomposition",
    f"""{DUCK}, own AS MATERIALIZED ({OWNED.format(s="scenes")}), lay AS MATERIALIZED ({LAID.format(s="scenes", o="own")}), bac AS (SELECT s.tile_id, s.x, s.y, CASE WHEN s.front THEN 120 ELSE s.r END AS r, CASE WHEN s.front THEN 200 ELSE s.g END AS g, CASE WHEN s.front THEN 120 ELSE s.b END AS b FROM scenes s),
pre AS (SELECT s.tile_id, s.x, s.y, s.r, s.g, s.b, {_covered("r")} AS o_r, {_covered("g")} AS o_g, {_covered("b")} AS o_b, l1.a AS a1, l2.a AS a2, l3.a AS a3, l3.strict AS strict3 FROM scenes s JOIN bac b ON b.tile_id = s.tile_id AND b.x = s.x AND b.y = s.y
  LEFT JOIN lay l1 ON l1.tile_id = s.tile_id AND l1.x = s.x AND l1.y = s.y AND l1.owner = 'bar2' LEFT JOIN lay l2 ON l2.tile_id = s.tile_id AND l2.x = s.x AND l2.y = s.y AND l2.owner = 'object' LEFT JOIN lay l3 ON l3.tile_id = s.tile_id AND l3.x = s.x AND l3.y = s.y AND l3.owner = 'spot'
  WHERE NOT (s.tile_id % 2 = 0 AND s.y = 0 AND s.x BETWEEN 3 AND 5)),
stp AS (SELECT *, abs(r - o_r) + abs(g - o_g) + abs(b - o_b) AS total, greatest(abs(r - o_r), abs(g - o_g), abs(b - o_b)) AS step,
  list_filter([CASE WHEN a3 > 0 THEN 'spot' END, CASE WHEN a2 > 0 AND coalesce(a3, 0) < 254 THEN 'object' END, CASE WHEN a1 > 0 AND coalesce(a3, 0) < 254 AND coalesce(a2, 0) < 254 THEN 'bar2' END], lambda n: n IS NOT NULL) AS seen FROM pre),
agg AS (SELECT tile_id, count(*) AS compared, sum(total) / (count(*) * 3.0) AS mae, CAST(list_sort(list(step))[CAST(least(count(*) - 1, floor(count(*) * 0.95)) AS BIGINT) + 1] AS BIGINT) AS p95, count(*) FILTER (step > 24) AS changed, coalesce(bool_or(len(seen) <> 1) FILTER (step > 24), FALSE) AS ambiguous,
  coalesce(list_sort(list_distinct(list(seen[1]) FILTER (step > 24 AND len(seen) = 1))), []) AS affected, coalesce(bool_or(strict3 AND list_contains(seen, 'spot')) FILTER (step > 24), FALSE) AS violated FROM stp GROUP BY tile_id),
fin AS (SELECT *, mae <= 3 AND p95 <= 12 AND changed / compared <= 0.02 AND NOT violated AS accepted, ambiguous OR changed = 0 OR len(affected) = 0 AS unsure FROM agg)
SELECT tile_id, accepted, CASE WHEN accepted THEN NULL WHEN unsure THEN 'ambiguous' ELSE 'deterministic' END AS attribution, CASE WHEN accepted OR unsure THEN '' WHEN violated THEN 'spot' ELSE array_to_string(affected, ',') END AS affected, compared, CAST(round(mae * 3 * compared) AS BIGINT) AS total, p95, changed FROM fin""",
)
def page_recomposition(spark, d):
    source, _, layers, ignored = _page(spark, d)
    front = _inputs(spark, d)[1].withColumn("front", F.lit(True))
    plain = {"r": 120, "g": 200, "b": 120}
    back = source.join(front, ["tile_id", "x", "y"], "left").select("tile_id", "x", "y", *(F.when(F.col("front"), v).otherwise(F.col(c)).cast("long").alias(c) for c, v in plain.items()), "a")
    out = build.whole_page(source, back, layers, ignored)
    return out.select("tile_id", "accepted", "attribution", F.array_join("affected", ",").alias("affected"), "compared", F.round(F.col("mae") * 3 * F.col("compared")).cast("long").alias("total"), "p95", "changed")


@query("semantic_build")
def semantic_build(spark, d):
    decisions, pages = build.semantic_build(*_page(spark, d))
    return decisions.join(pages, "tile_id")


# ---- surfaces that carry text ----------------------------------------------------------------------------------------------------------

#: A surface around the bar of a scene: cut out with holes, at times with a slit to the outside, with glyphs on it; some boxes leave it or another text meets it.
CUT = "SELECT tile_id, x, y, CASE WHEN visible OR x BETWEEN 1 AND 14 AND y BETWEEN 3 AND 8 THEN CASE WHEN tile_id % 7 = 3 AND x = 6 AND y <= 4 THEN 0 WHEN (r + x) % 11 = 4 AND y = 5 THEN 0 ELSE 255 END ELSE 0 END AS a FROM {s}"
TEXT_BOXES = """SELECT tile_id, 't' AS text_id, TRUE AS carried, CAST(CASE WHEN tile_id % 8 = 5 THEN 0 ELSE 3 END AS DOUBLE) AS x, 4.5 AS y, 7.0 AS w, 1.5 AS h FROM {t}
UNION ALL SELECT tile_id, 'u', FALSE, 2.0, CASE WHEN tile_id % 9 = 2 THEN 5.0 ELSE 0.0 END, 2.5, 1.5 FROM {t}"""
#: Nine surfaces of ten are plain or rise to the right, the tenth is rough; ink is dark, on some tiles hardly darker than the surface.
INKED = """SELECT tile_id, x, y, CASE WHEN glyph THEN CASE WHEN tile_id % 12 = 7 THEN 190 ELSE 20 END ELSE CASE WHEN tile_id % 10 = 4 THEN (r * 7 + x * 31 + y * 17) % 120 + 100 ELSE 180 + x * (tile_id % 3) END END AS r,
CASE WHEN glyph THEN CASE WHEN tile_id % 12 = 7 THEN 70 ELSE 20 END ELSE 80 END AS g, CASE WHEN glyph THEN CASE WHEN tile_id % 12 = 7 THEN 60 ELSE 20 END ELSE 60 + y END AS b, 255 AS a, glyph
FROM (SELECT *, x BETWEEN 4 AND 8 AND y = 5 AND (x + g) % 3 = 0 AS glyph FROM {s}) q"""


def _surface(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """cut, source, texts, glyphs, inks."""
    s = large(scenes(spark, d), "scenes")
    long = lambda df, *c: df.withColumns({n: F.col(n).cast("long") for n in c})
    inked = large(long(spark.sql(INKED, s=s), "r", "g", "b", "a"), "inked")
    wide = inked.where("glyph").select("tile_id", F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(dx == dy == 0).alias("core")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))).alias("p"))
    glyphs = wide.select("tile_id", "p.x", "p.y", "p.core").groupBy("tile_id", "x", "y").agg(F.bool_or("core").alias("core")).withColumn("text_id", F.lit("t"))
    tile = s.select("tile_id").distinct()
    dark = F.when(F.col("tile_id") % 12 == 7, F.array(*map(F.lit, (190, 70, 60)))).otherwise(F.array(*map(F.lit, (20, 20, 20))))
    inks = tile.select("tile_id", F.lit("t").alias("text_id"), *(dark[k].cast("long").alias(c) for k, c in enumerate(("r", "g", "b"))))
    return long(spark.sql(CUT, s=s), "a"), inked.drop("glyph"), spark.sql(TEXT_BOXES, t=tile), glyphs, inks


HELD = f"""cut AS MATERIALIZED ({CUT.format(s="scenes")}), opn AS MATERIALIZED (SELECT tile_id, x, y FROM cut WHERE a < 255), {duck_components("oc", "opn")},
sup AS MATERIALIZED (SELECT c.tile_id, c.x, c.y, CASE WHEN o.c IS NOT NULL AND (o.tile_id, o.c) IN (SELECT (tile_id, c) FROM oc WHERE x IN (0, 15) OR y IN (0, 11)) THEN c.a ELSE 255 END AS a FROM cut c LEFT JOIN oc o ON o.tile_id = c.tile_id AND o.x = c.x AND o.y = c.y)"""


@query("backing_support", f"{DUCK}, {HELD} SELECT tile_id, count(*) FILTER (sup.a = 255) AS inside, count(*) FILTER (sup.a = 255 AND cut.a < 255) AS holes FROM sup JOIN cut USING (tile_id, x, y) GROUP BY tile_id")
def backing_support(spark, d):
    cut = _surface(spark, d)[0]
    both = backing.support(cut).join(cut.withColumnRenamed("a", "own"), ["tile_id", "x", "y"])
    return both.groupBy("tile_id").agg(F.count_if(F.col("a") == 255).alias("inside"), F.count_if((F.col("a") == 255) & (F.col("own") < 255)).alias("holes"))


@query(
    "backing_boxes",
    f"""{DUCK}, {HELD}, box AS (SELECT *, floor(x) AS l, floor(y) AS t, ceil(x + w) AS e, ceil(y + h) AS b FROM ({TEXT_BOXES.format(t="tiles")}) q), met AS (SELECT b.tile_id, b.text_id, b.carried, (b.e - b.l) * (b.b - b.t) AS area, count(s.a) FILTER (s.a >= 128) AS solid, count(s.a) FILTER (s.a >= 16) AS held
FROM box b LEFT JOIN sup s ON s.tile_id = b.tile_id AND s.x >= b.l AND s.x < b.e AND s.y >= b.t AND s.y < b.b GROUP BY ALL) SELECT tile_id, bool_and(CASE WHEN carried THEN solid = area ELSE held = 0 END) AS fits FROM met GROUP BY tile_id""",
)
def backing_boxes(spark, d):
    cut, _, texts, _, _ = _surface(spark, d)
    return backing.boxes_fit(texts, backing.support(cut))


_PLANE = {
    "det": "n*(suu*stt-sut*sut) - su*(su*stt-sut*st) + st*(su*sut-suu*st)",
    "p": "(s{c}*(suu*stt-sut*sut) - su*(su{c}*stt-sut*st{c}) + st*(su{c}*sut-suu*st{c}))",
    "u": "(n*(su{c}*stt-sut*st{c}) - s{c}*(su*stt-sut*st) + st*(su*st{c}-su{c}*st))",
    "t": "(n*(suu*st{c}-su{c}*sut) - su*(su*st{c}-su{c}*st) + s{c}*(su*sut-suu*st))",
}
_OFF = ", ".join(f"abs(s.{c} - ({_PLANE['p'].format(c=c)} + {_PLANE['u'].format(c=c)} * s.u + {_PLANE['t'].format(c=c)} * s.t) / ({_PLANE['det']}))" for c in "rgb")


@query(
    "surface_residual",
    f"""{DUCK}, {HELD}, ink AS MATERIALIZED ({INKED.format(s="scenes")}), sol AS MATERIALIZED (SELECT tile_id, x, y FROM sup WHERE a >= 128), inn AS (SELECT s.tile_id, s.x, s.y FROM sol s JOIN sol n ON n.tile_id = s.tile_id AND abs(n.x - s.x) + abs(n.y - s.y) = 1 GROUP BY ALL HAVING count(*) = 4),
sam AS MATERIALIZED (SELECT i.tile_id, k.x, k.y, k.r, k.g, k.b FROM inn i JOIN ink k ON k.tile_id = i.tile_id AND k.x = i.x AND k.y = i.y WHERE NOT k.glyph),
ends_ AS (SELECT tile_id, count(*) AS n, min(x) AS x0, min(y) AS y0, greatest(1, max(x) - min(x)) AS sx, greatest(1, max(y) - min(y)) AS sy FROM sam GROUP BY tile_id),
sca AS MATERIALIZED (SELECT s.*, e.n AS many, (s.x - e.x0) / e.sx AS u, (s.y - e.y0) / e.sy AS t FROM sam s JOIN ends_ e ON e.tile_id = s.tile_id WHERE e.n >= 16),
sum_ AS (SELECT tile_id, CAST(many AS DOUBLE) AS n, sum(u) AS su, sum(t) AS st, sum(u * u) AS suu, sum(u * t) AS sut, sum(t * t) AS stt, {", ".join(f"CAST(sum({c}) AS DOUBLE) AS s{c}, sum(u * {c}) AS su{c}, sum(t * {c}) AS st{c}" for c in "rgb")} FROM sca GROUP BY tile_id, many),
res AS (SELECT s.tile_id, quantile_disc(greatest({_OFF}), 0.95) AS residual FROM sca s JOIN sum_ m ON m.tile_id = s.tile_id WHERE abs({_PLANE["det"]}) > 1e-6 GROUP BY s.tile_id)
SELECT t.tile_id, coalesce(e.n, 0) AS samples, r.residual IS NOT NULL AS planar, round(coalesce(r.residual, -1), 6) + 0.0 AS residual FROM tiles t LEFT JOIN ends_ e ON e.tile_id = t.tile_id LEFT JOIN res r ON r.tile_id = t.tile_id""".replace("{c}", "{{c}}"),
)
def surface_residual(spark, d):
    cut, source, _, glyphs, _ = _surface(spark, d)
    out = backing.surface_residual(source, backing.support(cut), glyphs.where("core"))
    known = F.col("residual") < float("inf")
    return out.select("tile_id", "samples", known.alias("planar"), (F.round(F.when(known, F.col("residual")).otherwise(-1.0), 6) + 0.0).alias("residual"))


@query("text_backing")
def text_backing(spark, d):
    result, asset = backing.extracted(*_surface(spark, d))
    return result.join(hidden.image_digests(asset), "tile_id", "left")

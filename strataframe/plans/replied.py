"""Queries over replies of models, with their SQL: the replies are texts that Spark writes from the lifted nodes, some of them unfit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.plans import lifts
from strataframe.plans.catalogue import query
from strataframe.plans.lifts import duck, grouped
from strataframe.sources import replies

#: What a reply says of each node, with some wrong ids, names, boxes and numbers; both dialects read it.
SAID = """SELECT slide_id, ord, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY ord) - 1 AS BIGINT) AS k, CASE WHEN (slide_id + ord) % 101 = 3 THEN '' ELSE node_id END AS id,
  CASE WHEN (slide_id + ord) % 103 = 5 THEN 7 ELSE role END AS role_no, CASE WHEN (slide_id + ord) % 113 = 13 THEN 6 ELSE ord % 6 END AS kind_no, CASE WHEN (slide_id + ord) % 107 = 7 THEN 250 ELSE conf END AS c,
  (slide_id + ord) % 109 = 11 AS more, CASE WHEN role = 0 AND slide_id % 4 <> 0 THEN 0 ELSE x END AS x1, CASE WHEN role = 0 AND slide_id % 4 <> 0 THEN 0 ELSE y END AS y1,
  CASE WHEN role = 0 AND slide_id % 4 <> 0 THEN 1000 WHEN slide_id % 3 = 0 THEN x + w ELSE least(1000, x + w) END AS x2, CASE WHEN role = 0 AND slide_id % 4 <> 0 THEN 1000 ELSE y + h END AS y2 FROM {nodes}"""


def _said(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(SAID, nodes=lifts.nodes(spark, d))


def _name(names: list[str], at: str) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col(at).cast("int") + 1)


def _listed(column: Column) -> Column:
    """A page's entries in order, as the inside of a JSON list."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", column.alias("t")))), lambda e: e["t"]), ",")


def _scene(spark: SparkSession, d: str) -> DataFrame:
    """A reply for each page: one in five fenced, one in eleven cut off, one in thirteen no JSON, one in seventeen without relations."""
    node = F.concat(
        F.lit('{"id":"'), "id", F.lit('","role":"'), _name([*replies.ROLES, "widget"], "role_no"), F.lit('","bbox":['), F.concat_ws(",", "x1", "y1", "x2", "y2"), F.lit('],"confidence":'), "c", F.lit(',"zIndex":'), "ord",
        F.lit(',"label":"a {label}"'), F.when(F.col("more"), ',"note":1').otherwise(""), F.lit(',"extractionHints":'), F.when(F.col("ord") % 4 == 0, '{"a":"dark","b":3}').otherwise('["x",5]'), F.lit("}"),
    )
    link = F.concat(F.lit('{"id":"r'), "ord", F.lit('","kind":"'), _name([*replies.KINDS, "near"], "kind_no"), F.lit('","from":"'), "id", F.lit('","to":"n000","confidence":0.5}'))
    each = _said(spark, d).groupBy("slide_id").agg(F.concat(F.lit('{"relations":['), _listed(link), F.lit('],"nodes":['), _listed(node), F.lit("]}")).alias("t"))
    s = F.col("slide_id")
    fenced = F.concat(F.lit("```json\n"), "t", F.lit("\n```"))
    return each.select("slide_id", F.when(s % 13 == 6, "sorry").when(s % 17 == 8, '{"nodes":[]}').when(s % 11 == 4, F.expr("substring(t, 1, length(t) - 2)")).when(s % 5 == 2, fenced).otherwise(F.col("t")).alias("reply"))


_SAID = f"WITH {duck('nodes')}, said AS MATERIALIZED ({SAID.replace('{nodes}', 'nodes')}), fit AS MATERIALIZED (SELECT * FROM said WHERE slide_id % 13 <> 6 AND slide_id % 17 <> 8)"
_WRONG = {
    "nodes": {"id": "id = ''", "role": "role_no = 7", "bbox": "x2 > 1000", "confidence": "c = 250", "keys": "more", "background": "role_no = 0 AND x2 <= 1000 AND NOT (x1 = 0 AND y1 = 0 AND x2 = 1000 AND y2 = 1000)"},
    "relations": {"from": "id = ''", "kind": "kind_no = 6"},
}
_FAULTS = " UNION ALL ".join(f"SELECT slide_id, '{part}' AS part, k AS ord, '{name}' AS fault FROM fit WHERE {rule}" for part, rules in _WRONG.items() for name, rule in rules.items())
_WHOLE = "SELECT slide_id, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CASE WHEN slide_id % 13 = 6 THEN 'no_json' ELSE 'no_lists' END FROM said WHERE slide_id % 13 = 6 OR slide_id % 17 = 8"


@query("scene_reply_faults", f"{_SAID} {grouped(f'{_FAULTS} UNION ALL {_WHOLE}')}")
def scene_reply_faults(spark, d):
    return replies.faults(replies.scene_checked(_scene(spark, d)))


@query(
    "scene_reply_nodes",
    f"""{_SAID}, bad AS MATERIALIZED (SELECT DISTINCT slide_id FROM ({_FAULTS}) f) SELECT slide_id, k AS ord, id AS node_id, ({replies.ROLES})[role_no + 1] AS role, x1 / 1000.0::DOUBLE AS x, y1 / 1000.0::DOUBLE AS y,
(x2 - x1) / 1000.0::DOUBLE AS w, (y2 - y1) / 1000.0::DOUBLE AS h, c / 100.0::DOUBLE AS conf, ord AS z, 'a {{label}}' AS label, CASE WHEN ord % 4 = 0 THEN 'dark' ELSE 'x' END AS hints
FROM fit WHERE slide_id NOT IN (SELECT slide_id FROM bad)""",
)
def scene_reply_nodes(spark, d):
    return replies.scene_nodes(replies.scene_checked(_scene(spark, d))).withColumn("hints", F.array_join("hints", ","))


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    """Pages by turns in pixels and as completions in thousandths."""
    pixels = F.concat(F.lit('{"x":'), "x", F.lit(',"y":'), "y", F.lit(',"width":'), "w", F.lit(',"height":'), "h", F.lit("}"))
    corners = F.concat(F.lit("["), F.concat_ws(",", "x", "y", F.expr("x + w"), F.expr("y + h")), F.lit("]"))
    kind = F.when((F.col("slide_id") + F.col("ord")) % 127 == 5, "line").otherwise(_name(replies.TYPES, "role"))
    element = F.concat(
        F.lit('{"type":"'), kind, F.lit('","bbox":'), F.when(F.col("slide_id") % 2 == 0, pixels).otherwise(corners), F.lit(',"label":"","zIndex":'), "z", F.lit(',"editableAs":"bitmap","confidence":'), F.col("conf") / 100, F.lit("}")
    )
    each = lifts.nodes(spark, d).withColumn("k", F.col("ord")).groupBy("slide_id").agg(F.concat(F.lit('{"elements":['), _listed(element), F.lit("]}")).alias("t"))
    content = F.when(F.col("slide_id") % 3 == 0, F.concat(F.lit("```\n"), "t", F.lit("\n```"))).otherwise(F.col("t"))
    completion = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    return each.select("slide_id", F.when(F.col("slide_id") % 2 == 0, F.col("t")).otherwise(completion).alias("reply"))


@query(
    "vision_replay_elements",
    f"""WITH {duck("nodes")}, placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY ord) - 1 AS k, max(CASE WHEN (slide_id + ord) % 127 = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY slide_id) AS bad,
floor(x / 1000.0::DOUBLE * 1280 + 0.5::DOUBLE) AS l, floor(y / 1000.0::DOUBLE * 720 + 0.5::DOUBLE) AS t, floor((x + w) / 1000.0::DOUBLE * 1280 + 0.5::DOUBLE) AS r, floor((y + h) / 1000.0::DOUBLE * 720 + 0.5::DOUBLE) AS b FROM nodes)
SELECT slide_id, k AS ord, ({replies.TYPES})[role + 1] AS type, 'bitmap' AS editable_as, CAST(CASE WHEN slide_id % 2 = 0 THEN x ELSE l END AS DOUBLE) AS x, CAST(CASE WHEN slide_id % 2 = 0 THEN y ELSE t END AS DOUBLE) AS y,
CAST(CASE WHEN slide_id % 2 = 0 THEN w ELSE greatest(l + 1, r) - l END AS DOUBLE) AS width, CAST(CASE WHEN slide_id % 2 = 0 THEN h ELSE greatest(t + 1, b) - t END AS DOUBLE) AS height, z, conf / 100.0::DOUBLE AS conf FROM placed WHERE bad = 0""",
)
def vision_replay_elements(spark, d):
    return replies.vision_elements(replies.vision_checked(_recordings(spark, d)))


@query("ocr_coordinate_free", "SELECT doc_id AS slide_id FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL")
def ocr_coordinate_free(spark, d):
    """Each text as a reply; one in three has a place."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("slide_id"), "text")
    place = F.when(F.col("slide_id") % 3 == 0, F.struct(F.lit("here").alias("words_info")))
    content = F.array(F.struct("text", place.alias("ocr_result")))
    reply = F.struct(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")).alias("output"))
    return replies.coordinate_free(docs.select("slide_id", F.to_json(reply).alias("reply")))

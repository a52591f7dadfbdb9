"""Recorded replies of models as tables of lines, nodes and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.documents import json_repaired

LINES = "output struct<choices: array<struct<message: struct<content: array<struct<ocr_result: struct<words_info: array<struct<text: string, location: array<double>>>>>>>>>>"
SCENE = (
    "nodes array<struct<id: string, role: string, bbox: array<double>, confidence: double, zIndex: int, label: string, extractionHints: array<string>>>, "
    "relations array<struct<id: string, kind: string, `from`: string, `to`: string, confidence: double>>"
)


def _ocr_words(replies: DataFrame, column: str, key: str) -> DataFrame:
    """key, words, bad: a reply is bad if it is no JSON of that shape or any of its words has no text or not eight finite numbers."""
    words = F.flatten(F.transform(F.col("r.output.choices"), lambda c: F.flatten(F.transform(c["message"]["content"], lambda m: m["ocr_result"]["words_info"]))))
    wrong = lambda w: w["text"].isNull() | (F.coalesce(F.size(w["location"]), F.lit(-1)) != 8) | F.exists(w["location"], lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return replies.select(key, F.from_json(column, LINES).alias("r")).select(key, words.alias("words")).withColumn("bad", F.col("words").isNull() | F.exists("words", wrong))


def ocr_lines(replies: DataFrame, column: str = "reply", key: str = "slide_id") -> DataFrame:
    """slide_id, source_index, text, x, y, w, h: the box around each word's four corners. Replies of :func:`ocr_rejected` give no lines at all."""
    each = _ocr_words(replies, column, key).where("not bad").select(key, F.posexplode("words").alias("source_index", "word"))
    xs, ys = (F.transform(F.sequence(F.lit(k), F.lit(k + 6), F.lit(2)), lambda i: F.element_at(F.col("word.location"), i)) for k in (1, 2))
    return each.select(key, "source_index", F.col("word.text").alias("text"), F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def ocr_rejected(replies: DataFrame, column: str = "reply", key: str = "slide_id") -> DataFrame:
    """The keys of replies that are rejected whole: not of the stated shape, or with a malformed word."""
    return _ocr_words(replies, column, key).where("bad").select(key)


def confidence(v: Column) -> Column:
    """Percentages become shares."""
    return F.when((v > 1) & (v <= 100), v / 100).otherwise(v)


def scene(replies: DataFrame, column: str = "reply", key: str = "slide_id") -> tuple[DataFrame, DataFrame]:
    """Nodes (boxes in 0..1) and relations of scene replies, fenced or cut off as they may be.

    A relation "carries-text" that starts at no backing and ends at a text becomes "belongs-to" the other way round.
    """
    parsed = replies.select(key, F.from_json(json_repaired(F.col(column)), SCENE).alias("s"))
    n = parsed.select(key, F.posexplode("s.nodes").alias("ord", "n"))
    b = F.col("n.bbox")
    share = lambda k: F.element_at(b, k) / 1000
    nodes = n.select(
        key, "ord", F.col("n.id").alias("node_id"), F.col("n.role").alias("role"), share(1).alias("x"), share(2).alias("y"), (share(3) - share(1)).alias("w"), (share(4) - share(2)).alias("h"),
        confidence(F.col("n.confidence")).alias("conf"), F.col("n.zIndex").alias("z"), F.col("n.label").alias("label"), F.filter("n.extractionHints", lambda h: h.isNotNull()).alias("hints"),
    )
    r = parsed.select(key, F.posexplode("s.relations").alias("ord", "r")).select(key, F.col("r.id").alias("rel_id"), F.col("r.kind").alias("kind"), F.col("r.from").alias("from_id"), F.col("r.to").alias("to_id"), confidence(F.col("r.confidence")).alias("conf"))
    role = nodes.select(key, "node_id", "role")
    r = r.join(role.toDF(key, "from_id", "from_role"), [key, "from_id"], "left").join(role.toDF(key, "to_id", "to_role"), [key, "to_id"], "left")
    turn = (F.col("kind") == "carries-text") & (F.coalesce("from_role", F.lit("")) != "text-backing") & (F.col("to_role") == "text")
    relations = r.select(key, "rel_id", F.when(turn, "belongs-to").otherwise(F.col("kind")).alias("kind"), F.when(turn, F.col("to_id")).otherwise(F.col("from_id")).alias("from_id"), F.when(turn, F.col("from_id")).otherwise(F.col("to_id")).alias("to_id"), "conf")
    return nodes, relations

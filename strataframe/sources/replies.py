"""Replies of models, checked field by field as VARIANT values: a reply counts whole or not at all, and what is wrong is a relation.

A reply that isn't JSON has the fault ``no_json``; one without its lists has ``no_lists``. All other faults name a part (the list), the place in
it and the field. Rules between rows of a graph (unknown ends, repeated ids) are those of ``operators.graph``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.documents import json_repaired
from strataframe.sources.recordings import confidence

# The names that replies may use, the scale of their coordinates and the canvas of first-generation recordings.
ROLES = ["background", "text", "text-backing", "foreground-object", "connector", "compound-group", "decoration"]
KINDS = ["belongs-to", "connected-to", "carries-text", "occludes", "in-front-of", "behind"]
TYPES = ["text", "panel", "shape", "icon", "illustration", "photo", "background"]
EDITABLE = ["text", "native-shape", "bitmap", "background"]
NODE_KEYS = ["id", "role", "bbox", "confidence", "zIndex", "label", "extractionHints"]
RELATION_KEYS = ["id", "kind", "from", "to", "confidence"]
#: A list's entries by their fields; one that is no object is null.
ENTRIES = "array<map<string,variant>>"
SCALE, WIDTH, HEIGHT, SAFE = 1000, 1280, 720, 2**53 - 1


def _at(v: str | Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, f"$.{path}" if path else "$", kind)


def _is(v: Column, kinds: str) -> Column:
    """Whether a variant is there and of a kind (a pattern on its type's name)."""
    return F.coalesce(F.schema_of_variant(v).rlike(f"^({kinds})"), F.lit(False))


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", _at(v, "", "string"))


def _number(v: Column) -> Column:
    return F.when(_is(v, "BIGINT|DECIMAL|DOUBLE|FLOAT"), _at(v, "", "double"))


def _whole(n: Column) -> Column:
    return (n == F.floor(n)) & (F.abs(n) <= SAFE)


def _corners(v: Column) -> Column:
    """The numbers of a box; null if it isn't a list of numbers only. :func:`_four` tells whether they are four."""
    return F.when(_is(v, "ARRAY<(BIGINT|DECIMAL|DOUBLE|FLOAT)"), _at(v, "", "array<double>"))


def _four(box: Column) -> Column:
    """A box of four finite numbers; null otherwise."""
    return F.when((F.size(box) == 4) & ~F.exists(box, lambda n: n.isNull() | F.isnan(n) | (F.abs(n) == float("inf"))), box)


def _faults(**rules: Column) -> Column:
    """The names of the rules that don't hold; a rule that can't be told doesn't hold."""
    return F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda f: f.isNotNull())


def _extra(m: Column, keys: list[str]) -> Column:
    return F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, keys)))) == 0


def unfenced(text: Column) -> Column:
    """Without the one code fence around the whole text."""
    inner = F.regexp_extract(F.trim(text), r"(?is)^```(?:json)?[ \t]*\r?\n(.*?)\r?\n```[ \t]*$", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(F.trim(text))


def _entries(name: str) -> Column:
    """The entries of the list in the column ``name``: part, ord, and m, the entry's fields."""
    return F.transform(name, lambda m, k: F.struct(F.lit(name).alias("part"), k.cast("long").alias("ord"), m.alias("m")))


def _judged(parts: DataFrame, faults: Column) -> DataFrame:
    reply = F.when(~F.col("json"), F.array(F.lit("no_json"))).when(~F.col("lists"), F.array(F.lit("no_lists"))).otherwise(F.array().cast("array<string>"))
    return parts.withColumn("faults", F.when(F.col("part").isNull(), reply).otherwise(faults))


def _any_fault(key: str, entry: Column) -> Column:
    """Whether some entry of the reply has a fault. Rows of a reply lie together already, so this neither reads the replies again nor joins them."""
    return F.max(entry & (F.size("faults") > 0)).over(Window.partitionBy(key))


def scene_checked(replies: DataFrame, column: str = "reply", key: str = "slide_id") -> DataFrame:
    """key, part (nodes, relations; null for the reply), ord, the entry's fields as far as they are of their type, faults.

    Replies that break off are repaired; only those go to Python. Each entry's fields are read once.
    """
    text = unfenced(F.col(column))
    opened = replies.select(key, F.try_parse_json(text).alias("v"), text.alias("t"))
    opened = opened.select(key, "v", json_repaired(F.when(F.col("v").isNull(), F.col("t"))).alias("t")).select(key, F.coalesce("v", F.try_parse_json("t")).alias("v"))
    lists = opened.select(key, F.col("v").isNotNull().alias("json"), *(_at("v", name, ENTRIES).alias(name) for name in ("nodes", "relations")))
    parts = lists.select(key, "json", F.concat(_entries("nodes"), _entries("relations")).alias("e")).select(key, "json", F.col("e").isNotNull().alias("lists"), F.explode_outer("e").alias("e")).select(key, "json", "lists", "e.*")
    m = F.col("m")
    said = F.coalesce(_at(m["extractionHints"], "", "array<variant>"), F.map_values(_at(m["extractionHints"], "", "map<string,variant>")), F.array().cast("array<variant>"))
    read = parts.select(
        key, "json", "lists", "part", "ord", *(_text(m[c]).alias(c) for c in ("id", "role", "label", "kind", "from", "to")), _corners(m["bbox"]).alias("box"), confidence(_number(m["confidence"])).alias("confidence"),
        m["zIndex"].isNull().alias("flat"), _number(m["zIndex"]).alias("zIndex"), F.transform(F.filter(said, lambda h: _is(h, "STRING")), lambda h: _at(h, "", "string")).alias("hints"),
        _extra(m, NODE_KEYS).alias("node_keys"), _extra(m, RELATION_KEYS).alias("relation_keys"),
    ).withColumn("box", _four(F.col("box")))
    box = F.col("box")
    share = lambda k: F.element_at(box, k)
    fit = ~F.exists(box, lambda n: ~_whole(n) | (n < 0) | (n > SCALE)) & (share(3) > share(1)) & (share(4) > share(2))
    sure = F.col("confidence").between(0, 1)
    node = _faults(
        id=F.length("id") > 0, role=F.col("role").isin(ROLES), bbox=fit, confidence=sure, zIndex=F.col("flat") | _whole(F.col("zIndex")), label=F.col("label").isNotNull(),
        keys=F.col("node_keys"), background=F.coalesce(F.col("role") != "background", F.lit(True)) | F.coalesce(~fit, F.lit(True)) | (box == F.array(*map(F.lit, (0.0, 0.0, 1000.0, 1000.0)))),
    )
    ends = {name: F.length(name) > 0 for name in ("id", "from", "to")}
    relation = _faults(**ends, kind=F.col("kind").isin(KINDS), confidence=sure, keys=F.col("relation_keys"))
    return _judged(read, F.when(F.col("part") == "nodes", node).otherwise(relation)).drop("json", "lists", "flat", "node_keys", "relation_keys")


def faults(checked: DataFrame, key: str = "slide_id") -> DataFrame:
    """key, part, ord, fault of a table of :func:`scene_checked` or :func:`vision_checked`."""
    # From a plain explode Spark infers a filter on its list, which would work out all faults twice.
    return checked.select(key, "part", "ord", F.explode_outer("faults").alias("fault")).where("fault is not null")


def valid(checked: DataFrame, key: str = "slide_id") -> DataFrame:
    """The entries of the replies that have no fault at all."""
    return checked.withColumn("bad", _any_fault(key, F.lit(True))).where(~F.col("bad") & F.col("part").isNotNull()).drop("bad")


def scene_nodes(checked: DataFrame, key: str = "slide_id") -> DataFrame:
    """Nodes of valid replies: boxes as shares, confidence as a share, hints the strings of a list or of an object's values."""
    box = F.col("box")
    share = lambda k: F.element_at(box, k) / SCALE
    span = lambda a, b: (F.element_at(box, b) - F.element_at(box, a)) / SCALE
    return valid(checked, key).where("part = 'nodes'").select(
        key, "ord", F.col("id").alias("node_id"), "role", share(1).alias("x"), share(2).alias("y"), span(1, 3).alias("w"), span(2, 4).alias("h"),
        F.col("confidence").alias("conf"), F.col("zIndex").cast("long").alias("z"), "label", "hints",
    )


def vision_checked(replies: DataFrame, column: str = "reply", key: str = "slide_id") -> DataFrame:
    """key, part (elements; null for the reply), ord, the entry's fields as far as they are of their type, faults, normal of first-generation recordings.

    A recording whose elements all have boxes as objects in pixels (normal) is taken as it is; any other one is a
    completion whose first choice holds the reply as text, fenced or not, with boxes as four thousandths. Nothing is repaired.
    Both forms of a recording are read side by side, and the one that counts is kept.
    """
    pixel = ("x", "y", "width", "height")
    opened = replies.select(key, F.try_parse_json(column).alias("v"))
    opened = opened.select(key, "v", F.try_parse_json(unfenced(_text(_at("v", "choices[0].message.content")))).alias("raw"))

    def form(v: str, normal: bool) -> Column:
        none = F.struct(F.lit(None).cast("string").alias("part"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("map<string,variant>").alias("m"))
        listed = F.transform(f"{v}_list", lambda m, k: F.struct(F.lit("elements").alias("part"), k.cast("long").alias("ord"), m.alias("m")))
        rows = F.when(F.size(f"{v}_list") > 0, listed).otherwise(F.array(none))
        return F.transform(rows, lambda r: F.struct(F.lit(normal).alias("normal"), F.col(f"{v}_json").alias("json"), F.col(f"{v}_list").isNotNull().alias("lists"), r["part"].alias("part"), r["ord"].alias("ord"), r["m"].alias("m")))

    lists = opened.select(key, *(c for v in ("v", "raw") for c in (F.col(v).isNotNull().alias(f"{v}_json"), _at(v, "elements", ENTRIES).alias(f"{v}_list"))))
    parts = lists.select(key, F.explode_outer(F.concat(form("v", True), form("raw", False))).alias("e")).select(key, "e.*")
    m = F.col("m")
    at = _at(m["bbox"], "", "map<string,variant>")
    colour = lambda name: m[name].isNull() | _text(m[name]).isNotNull()
    read = parts.select(
        key, "normal", "json", "lists", "part", "ord", *(_text(m[c]).alias(c) for c in ("type", "editableAs")), *(_number(m[c]).alias(c) for c in ("zIndex", "confidence")), F.when(F.col("normal"), at).alias("at"), F.when(~F.col("normal"), _corners(m["bbox"])).alias("box"),
        _text(m["label"]).isNotNull().alias("label"), *(colour(c).alias(c) for c in ("fillColor", "strokeColor")), (m["cornerRadius"].isNull() | (_number(m["cornerRadius"]) >= 0)).alias("cornerRadius"),
    )
    read = read.select("*", *(_number(F.col("at")[c]).alias(c) for c in pixel)).drop("at").withColumn("box", _four(F.col("box")))
    corner = lambda k: F.element_at("box", k)
    fit = F.when(F.col("normal"), F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0)).otherwise((corner(3) > corner(1)) & (corner(4) > corner(2)))
    rules = {
        "type": F.col("type").isin(TYPES), "label": F.col("label"), "zIndex": _whole(F.col("zIndex")), "editableAs": F.col("editableAs").isin(EDITABLE), "confidence": F.col("confidence").between(0, 1),
        "fillColor": F.col("fillColor"), "strokeColor": F.col("strokeColor"), "cornerRadius": F.col("cornerRadius"),
    }
    both = _judged(read, _faults(bbox=fit, **rules)).drop("json", "lists", "label", "fillColor", "strokeColor", "cornerRadius")
    return both.withColumn("unfit", _any_fault(key, F.col("normal"))).where("normal != unfit").drop("unfit")


def vision_elements(checked: DataFrame, key: str = "slide_id") -> DataFrame:
    """Elements of valid recordings with boxes in pixels, each at least one wide and high."""
    at = lambda k, size: F.floor(F.element_at("box", k) / SCALE * size + 0.5).cast("double")
    left, top = at(1, WIDTH), at(2, HEIGHT)
    raw = {"x": left, "y": top, "width": F.greatest(left + 1, at(3, WIDTH)) - left, "height": F.greatest(top + 1, at(4, HEIGHT)) - top}
    boxes = [F.when(F.col("normal"), F.col(k)).otherwise(raw[k]).alias(k) for k in raw]
    return valid(checked, key).select(key, "ord", "type", F.col("editableAs").alias("editable_as"), *boxes, F.col("zIndex").cast("long").alias("z"), F.col("confidence").alias("conf"))


def coordinate_free(replies: DataFrame, column: str = "reply", key: str = "slide_id") -> DataFrame:
    """The keys of text replies that have words but no places: some content has a text and no ``ocr_result``."""
    contents = F.flatten(F.transform(_at("v", "output.choices", "array<variant>"), lambda c: F.coalesce(F.try_variant_get(c, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))))
    said = lambda c: _is(F.try_variant_get(c, "$.text", "variant"), "STRING") & F.try_variant_get(c, "$.ocr_result", "variant").isNull()
    return replies.select(key, F.try_parse_json(column).alias("v")).where(F.exists(contents, said)).select(key)

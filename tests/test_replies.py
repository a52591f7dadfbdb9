"""Replies checked field by field: what counts, what is wrong, and where."""

from __future__ import annotations

import json

from strataframe.sources import replies

NODE = {"id": "a", "role": "text", "bbox": [0, 10, 500, 1000], "confidence": 90, "label": "t", "extractionHints": {"k": "dark", "n": 3}}
LINK = {"id": "r", "kind": "occludes", "from": "a", "to": "b", "confidence": 0.5}


def scene(*nodes, relations=()):
    return json.dumps({"relations": list(relations), "nodes": list(nodes)})


def faults(spark, *texts, of=replies.scene_checked):
    df = spark.createDataFrame(list(enumerate(texts)), "slide_id long, reply string")
    return sorted((r.slide_id, r.part, r.ord, r.fault) for r in replies.faults(of(df)).collect())


def test_scene(spark):
    """Fenced, cut off and plain replies are read; hints may be an object; percentages become shares."""
    said = [scene(NODE, relations=[LINK]), "```json\n" + scene(NODE) + "\n```", scene(NODE)[:-2], scene({**NODE, "extractionHints": ["x", 5, None], "zIndex": 3.0, "confidence": 1}), scene({**NODE, "extractionHints": None}), scene()]
    df = spark.createDataFrame(list(enumerate(said)), "slide_id long, reply string")
    checked = replies.scene_checked(df)
    assert replies.faults(checked).count() == 0
    got = {r.slide_id: r for r in replies.scene_nodes(checked).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert (got[0].x, got[0].y, got[0].w, got[0].h, got[0].conf, got[0].z, got[0].hints) == (0, 0.01, 0.5, 0.99, 0.9, None, ["dark"])
    assert (got[3].z, got[3].conf, got[3].hints, got[4].hints) == (3, 1, ["x"], [])


def test_scene_faults(spark):
    wrong = {
        "id": ["", 5, None], "role": ["widget", None], "bbox": [[0, 0, 1001, 5], [5, 0, 5, 9], [0, 0.5, 9, 9], [0, 0, 9], "x", [0, 0, 9, None]], "confidence": [101, -0.1, "0.5", None], "zIndex": [None, 1.5, "1"], "label": [None, 1],
    }
    cases = [(name, {**NODE, name: v}) for name, vs in wrong.items() for v in vs] + [("keys", {**NODE, "note": 1}), ("background", {**NODE, "role": "background"}), ("label", {k: v for k, v in NODE.items() if k != "label"})]
    assert faults(spark, *(scene(NODE, n) for _, n in cases)) == [(k, "nodes", 1, name) for k, (name, _) in enumerate(cases)]
    assert faults(spark, scene({**NODE, "role": "background", "bbox": [0, 0, 1000, 1000]})) == []
    links = [("kind", {**LINK, "kind": "near"}), ("from", {**LINK, "from": ""}), ("to", {**LINK, "to": 3}), ("keys", {**LINK, "z": 1}), ("confidence", {**LINK, "confidence": 1000})]
    assert faults(spark, *(scene(NODE, relations=[r]) for _, r in links)) == [(k, "relations", 0, name) for k, (name, _) in enumerate(links)]
    assert faults(spark, "sorry", '{"nodes": []}', '{"nodes": 1, "relations": []}', None) == [(0, None, None, "no_json"), (1, None, None, "no_lists"), (2, None, None, "no_lists"), (3, None, None, "no_json")]
    assert len({f for _, _, _, f in faults(spark, scene(5))}) == 6 and not faults(spark)


def test_vision(spark):
    """Recordings in pixels first, then completions in thousandths; one wrong element loses the recording."""
    e = {"type": "icon", "bbox": [100, 0, 100.2, 999], "label": "", "zIndex": 1, "editableAs": "bitmap", "confidence": 1, "more": 0}
    raw = lambda *es: json.dumps({"choices": [{"message": {"content": "```\n" + json.dumps({"elements": es}) + "\n```"}}]})
    normal = {**e, "bbox": {"x": -1.5, "y": 0, "width": 2, "height": 3}}
    said = [json.dumps({"elements": [normal]}), raw(e), raw(e, {**e, "type": "line"}), json.dumps({"elements": [e]}), "x", raw({**e, "cornerRadius": -1}), raw()[:-1]]
    df = spark.createDataFrame(list(enumerate(said)), "slide_id long, reply string")
    checked = replies.vision_checked(df)
    assert sorted((r.slide_id, r.x, r.y, r.width, r.height) for r in replies.vision_elements(checked).collect()) == [(0, -1.5, 0, 2, 3), (1, 128, 0, 1, 719)]
    assert faults(spark, *said, of=replies.vision_checked) == [(2, "elements", 1, "type"), (3, None, None, "no_json"), (4, None, None, "no_json"), (5, "elements", 0, "cornerRadius"), (6, None, None, "no_json")]


def test_coordinate_free(spark):
    content = [[{"text": "a"}], [{"text": "a", "ocr_result": {}}], [{"text": 1}], "a", [3, {"text": ""}]]
    said = [json.dumps({"output": {"choices": [{"message": {"content": c}}]}}) for c in content] + ["x", '{"output": 1}', '{"output": {"choices": [1, {"message": {"content": [{"text": "z"}]}}]}}', None]
    df = spark.createDataFrame(list(enumerate(said)), "slide_id long, reply string")
    assert sorted(r.slide_id for r in replies.coordinate_free(df).collect()) == [0, 4, 7]


def test_read_once(spark):
    """Replies are opened once: no branch of the plan reads them again to find those with faults."""
    df = spark.createDataFrame([(0, "{}")], "slide_id long, reply string")
    for out in (replies.vision_elements(replies.vision_checked(df)), replies.scene_nodes(replies.scene_checked(df)), replies.faults(replies.scene_checked(df))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") == 1 and "Join" not in plan

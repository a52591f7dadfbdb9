"""Operators at their limits and against plain Python."""

from __future__ import annotations

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions import documents, geometry as g, text as t
from strataframe.operators import graph, layout, ledger, planner, raster, raster_udf, routing
from strataframe.plans import catalogue
from strataframe.sources import images, publish, recordings


def test_line_merge_limits(spark):
    rows = [(1, 0, "a", 0, 0, 50, 20), (1, 1, "b", 0, 35, 50, 20), (1, 2, "c", 0, 71, 50, 20), (2, 0, "d", 0, 0, 50, 20), (2, 1, "e", 8, 20, 50, 20), (3, 0, "x", 0, 10, 50, 20), (3, 1, "y", 0, 29, 50, 20)]
    df = spark.createDataFrame(rows, "slide_id long, source_index long, text string, x long, y long, w long, h long")
    got = sorted((r.slide_id, r.text, r.y, r.h) for r in layout.merged_lines(df).collect())
    # a gap of exactly 0.75 h joins, one more does not; a shift over half the font does not; overlapping lines do not
    assert got == [(1, "a\nb", 0, 55), (1, "c", 71, 20), (2, "d", 0, 20), (2, "e", 20, 20), (3, "x", 10, 20), (3, "y", 29, 20)]


def test_page_order_does_not_matter(spark):
    rng = random.Random(3)
    rows = [(s, k, str(k), 0, 22 * k, 40, 20) for s in range(4) for k in range(6)]
    schema = "slide_id long, source_index long, text string, x long, y long, w long, h long"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame(rng.sample(rows, len(rows)), schema).repartition(3)
    assert ledger.same_rows(layout.merged_lines(a), layout.merged_lines(b)).count() == 0


def test_empty_boxes_have_no_overlap(spark):
    df = spark.range(1).select(g.iou(g.Box(*map(F.lit, (0, 0, 0, 0))), g.Box(*map(F.lit, (5, 5, 0, 0)))).alias("v"), g.half_up(F.lit(-2.5)).alias("r"))
    assert df.first() == (0.0, -2)


def test_cycles_and_order_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 7)
        after: dict = {}
        for _ in range(rng.randint(0, 9)):
            after.setdefault(rng.randrange(n), set()).add(rng.randrange(n))
        reach = {(a, b) for a in after for b in after[a]}
        for k, a, b in itertools.product(range(n), repeat=3):
            if (a, k) in reach and (k, b) in reach:
                reach.add((a, b))
        want = sorted({tuple(sorted(b for b in range(n) if (a, b) in reach and (b, a) in reach)) for a in range(n) if (a, a) in reach})
        assert [tuple(c) for c in graph.strong_components(list(range(n)), after)] == want
        order = graph.layer_order({k: 0 for k in range(n)}, after)
        place = {k: i for i, k in enumerate(order)}
        assert all(place[a] < place[b] for a in place for b in after.get(a, ()) if b in place)
        if not want:
            assert len(order) == n


def node(i, role, x, y, w=100, h=100, conf=0.9, z=0, ord=0):
    return {"node_id": i, "role": role, "x": x, "y": y, "w": w, "h": h, "conf": conf, "z": z, "ord": ord}


def rel(i, kind, a, b):
    return {"rel_id": i, "kind": kind, "from_id": a, "to_id": b}


def test_plan_page():
    nodes = [node("bg", "background", 0, 0, 900, 500), node("b", "foreground-object", 0, 0), node("a", "foreground-object", 1, 0), node("c", "text-backing", 300, 0), node("t", "text", 300, 0), node("d", "foreground-object", 600, 0, z=-1), node("low", "foreground-object", 600, 300, conf=0.79)]
    relations = [rel("r1", "carries-text", "c", "t"), rel("r2", "occludes", "c", "d")]
    layers, warnings = planner.plan_page(nodes, relations, [{"id": "ocr-1", "x": 300, "y": 0, "w": 100, "h": 100}])
    assert [(d["id"], d["members"]) for d in layers] == [("d", ["d"]), ("a", ["a", "b"]), ("c", ["c"])]
    assert layers[0]["occluders"] == ["c"] and layers[2]["texts"] == ["ocr-1"] and warnings == ["uncertain_candidate:low"]
    _, warnings = planner.plan_page(nodes, [*relations, rel("r3", "occludes", "d", "c")], [])
    assert "cycle_in_layer_order:c,d" in warnings and "dangling_ocr_association:c,t" in warnings
    same, warnings = planner.plan_page(nodes, [*relations, rel("r9", "occludes", "gone", "c")], [])
    assert "dangling_relation:r9" in warnings and [x for x in same] == planner.plan_page(nodes, relations, [])[0]
    layers, _ = planner.plan_page([node("g", "compound-group", 0, 0), node("o", "foreground-object", 10, 10)], [rel("r", "belongs-to", "o", "g")], [])
    assert [(d["id"], d["kind"], d["members"]) for d in layers] == [("g", "compound-group", ["g", "o"])]


def test_router_moves_forward_only():
    cursor: dict = {}
    assert routing.step(cursor, "ocr", ("unavailable", "success", "success"))[:2] == ("success", "api-openai")
    assert routing.step(cursor, "ocr", ("success", "success", "success"))[:2] == ("success", "api-openai")
    assert routing.step(cursor, "scene", ("policy_refused", "success", "success"))[0] == "fatal"
    assert routing.step({}, "ocr", ("missing", "missing", "unavailable")) == ("exhausted", None, ["unavailable"] * 3, True)


def test_router_as_stream_equals_batch(spark, tmp_path):
    from strataframe.plans import lifts
    from strataframe.streaming.routing import routed_stream

    rows = lifts.attempts(spark, "/root/testdata/sf0.001")
    want = sorted(map(tuple, routing.routed(rows).collect()), key=str)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = routed_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("routed").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("routed").collect()), key=str) == want


def test_redaction(spark):
    cases = {
        "Bearer abc.def x": "[REDACTED] x", "key sk-abcdefgh1": "key [REDACTED]", 'api_key = "v w"': 'api_key = "v w"', 'api_key = "v"': "[REDACTED]", '"api-key": "v w", "b": 1': '[REDACTED], "b": 1', "password=hunter2; ok": "[REDACTED]; ok",
        "https://h/p?a=1&Signature=x y": "[REDACTED_URL] y", "https://h/p?a=1 y": "https://h/p?a=1 y", "x-oss-token: abc z": "[REDACTED] z", "colour = red": "colour = red", "mypassword=1": "mypassword=1",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.out for r in df.select("s", t.redacted(F.col("s")).alias("out")).collect()}
    assert {k: got[k] for k in cases} == cases


def test_documents():
    assert documents.parsed('```json\n{"a": [1, 2\n```') == '{"a":[1,2]}'
    assert documents.parsed('{"a": [{"b": 1}, {"c": tr') == '{"a":[{"b":1}]}'
    assert documents.parsed("no") is None and documents.parsed(None) is None
    assert documents.pruned({"id": "x", "name": "ok", "api_key": "k", "deep": {"url": "https://x"}}) == {"name": "ok"}
    value, count = documents.bounded({"secret": "s", "a": "x" * 9000, "b": [[1]]}, documents.LIMITS | {"depth": 2})
    assert value["secret"] == "[REDACTED]" and len(value["a"]) == 8192 and value["b"] == [None] and count["cut_strings"] == count["cut_depth"] == 1


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4):
        image = rng.integers(0, 256, (5, 7, n)).astype(np.uint8)
        assert (images.decode_png(images.encode_png(image)) == image).all()
    assert images.decode_png(b"nothing") is None
    assert images.mask_values(np.array([[[1, 9, 3]]], np.uint8))[0, 0] == 9


def test_images_from_files(spark, tmp_path):
    image = np.full((64, 70, 4), 7, np.uint8)
    (tmp_path / "a.png").write_bytes(images.encode_png(image))
    (tmp_path / "b.png").write_bytes(images.encode_png(image[:10]))
    (tmp_path / "c.txt").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.width, r.height, r.reason) for r in images.scan_images(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.png": ("png", 70, 64, None), "b.png": ("png", 70, 10, "side"), "c.txt": (None, None, None, "format")}
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/a.png")
    assert images.pixels(files).groupBy("r", "a").count().collect()[0]["count"] == 64 * 70


def test_background_and_repair():
    image = np.full((20, 20, 4), 255, np.uint8)
    image[6:14, 6:14, :3] = 0
    image[0, 18, :3] = 10
    out = raster_udf.without_background(image)
    assert out[10, 10, 3] == 255 and out[1, 1, 3] == 0 and (out[out[..., 3] == 0][:, :3] == 0).all() and out[0, 18, 3] == 0
    noisy = image.copy()
    noisy[0, :, :3], noisy[-1, :, :3] = 60, 120
    assert raster_udf.without_background(noisy) is None
    flat = np.full((12, 12, 4), 200, np.uint8)
    flat[5:7, 5:7, :3] = 0
    mask = np.zeros((12, 12), bool)
    mask[5:7, 5:7] = True
    out, reason, m = raster_udf.repaired(flat, mask)
    assert reason == "" and (out[..., 0] == 200).all() and m["ring"] >= 16
    assert raster_udf.repaired(flat, np.zeros_like(mask))[1] == "mask_empty"
    assert raster_udf.repaired(np.random.default_rng(0).integers(0, 256, (12, 12, 4)).astype(np.uint8), mask)[1] == "surface_variance_too_high"
    assert raster_udf.repaired(flat[:3, :3], np.ones((3, 3), bool))[1] == "surface_samples_insufficient"


def test_recordings(spark):
    reply = '{"output":{"choices":[{"message":{"content":[{"ocr_result":{"words_info":[{"text":"hi","location":[1,2,11,2,11,8,1,8]},{"text":"bad","location":[1]}]}}]}}]}}'
    good = reply.replace(',{"text":"bad","location":[1]}', "")
    replies = spark.createDataFrame([(7, good), (8, reply), (9, None), (10, "{}"), (11, good.replace("[1,2,", "[null,2,")), (12, good.replace('"text":"hi",', ""))], "slide_id long, reply string")
    got = recordings.ocr_lines(replies).collect()
    assert [(r.slide_id, r.text, r.x, r.y, r.w, r.h) for r in got] == [(7, "hi", 1.0, 2.0, 10.0, 6.0)]
    assert sorted(r.slide_id for r in recordings.ocr_rejected(replies).collect()) == [8, 9, 10, 11, 12]
    scene = '```json\n{"nodes":[{"id":"t","role":"text","bbox":[0,0,500,500],"confidence":90},{"id":"o","role":"foreground-object","bbox":[0,0,1000,1000],"confidence":0.5}],"relations":[{"id":"r","kind":"carries-text","from":"o","to":"t","confidence":1}]}\n```'
    nodes, relations = recordings.scene(spark.createDataFrame([(7, scene)], "slide_id long, reply string"))
    assert {r.node_id: (r.w, r.conf) for r in nodes.collect()} == {"t": (0.5, 0.9), "o": (1.0, 0.5)}
    assert [(r.kind, r.from_id, r.to_id) for r in relations.collect()] == [("belongs-to", "t", "o")]


def test_published(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    publish.published(spark.range(3), target)
    publish.published(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5 and len(list(tmp_path.iterdir())) <= 2
    (tmp_path / "other").mkdir()
    with pytest.raises(FileExistsError):
        publish.published(spark.range(1), f"file://{tmp_path}/other")


def test_text_style(spark):
    df = spark.createDataFrame([("ab\r\ncd", 100.0, 40.0, 90.0, 36.0, 0.2, 4.0)], "s string, w double, h double, gw double, gh double, c double, k double")
    b = g.Box(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h"))
    s = df.select(t.text_style(F.col("s"), b, F.col("gw"), F.col("gh"), F.col("c"), F.col("k")).alias("s")).first().s
    assert (s.font_px, s.bold, s.tracking_px) == (16.92, True, 36.0)


def test_presentations(spark):
    import io
    import xml.dom.minidom
    import zipfile

    from strataframe.sources import pptx

    rows = spark.createDataFrame([(1, 2, 10, 10, 100, 20, "a & b\nc"), (1, 1, 0, 0, 640, 360, None)], "slide_id long, place long, x long, y long, w long, h long, text string")
    content = bytes(pptx.presentations(rows, 1280, 720).first().content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            xml.dom.minidom.parseString(z.read(name))
        slide = z.read("ppt/slides/slide1.xml").decode()
    assert slide.index('cx="6095848"') < slide.index("a &amp; b") and "<a:t>c</a:t>" in slide
    assert pptx.layout(100, 5000) == (1.0, 50.0) and pptx.layout(1280, 720)[0] == 13.333
    with pytest.raises(ValueError):
        pptx.layout(10, 1000)


def test_text_mask():
    image = np.full((30, 60, 4), 240, np.uint8)
    for x in range(12, 48, 6):
        image[10:20, x : x + 2, :3] = 20
    mask, reason, m = raster_udf.text_mask(image, 10, 9, 40, 12)
    assert reason == "" and mask[10:20, 12:14].all() and mask[9, 11] and not mask[9:21, 16].any() and m["stroke"] == 2 and m["coverage"] == 120 / 480
    line = image.copy()
    line[20:22, 10:50, :3] = 20  # an underline right below the box
    assert raster_udf.text_mask(line, 10, 9, 40, 11)[1] == "line_like_fringe"
    assert raster_udf.text_mask(image, 0, 0, 8, 8)[1] == "no_glyphs"
    noisy = np.random.default_rng(0).integers(0, 256, image.shape).astype(np.uint8)
    assert raster_udf.text_mask(noisy, 10, 9, 40, 12)[1] == "surface_inconsistent"
    solid = image.copy()
    solid[9:21, 10:50, :3] = 20
    assert raster_udf.text_mask(solid, 10, 9, 40, 12)[1] == "full_box"


def _all_rows(name, folder, tables):
    """The rows of a query's SQL."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return sorted(con.sql(catalogue.SQL[name]).fetchall())


def test_provider_canvas_of_every_event(spark):
    """All 10,000 events of sf0.01."""
    want = _all_rows("provider_canvas", "/root/testdata/sf0.01", ["events"])
    got = sorted(map(tuple, catalogue.QUERIES["provider_canvas"](spark, "/root/testdata/sf0.01").collect()))
    assert len(got) == 10_000 and got == want


def test_filled_rectangles_of_every_box(spark):
    want = _all_rows("filled_rectangles", "/root/testdata/sf0.001", ["lineitem"])
    got = sorted(map(tuple, catalogue.QUERIES["filled_rectangles"](spark, "/root/testdata/sf0.001").collect()))
    assert any(page >= 200 and place >= 6 for page, place, _ in got) and got == want
    boxes = spark.createDataFrame([(1, 0, 0.5, 1.0, 2.0, 3.5), (1, 1, 4.0, 4.0, 1.0, 1.0)], "slide_id long, tile_id long, x double, y double, w double, h double")
    made = {r.tile_id: r["count"] for r in raster.filled_rectangle(boxes).groupBy("tile_id").count().collect()}
    assert made == {r.tile_id: r.pixels for r in raster.filled_counts(boxes, "tile_id").collect()} == {0: 12, 1: 1}

"""Scan lines of shapes against each pixel's centre."""

from __future__ import annotations

import collections
import random

from pyspark.sql import functions as F

from strataframe.operators import runs, shapes

W, H = 40, 30


def inside(p, px, py):
    primitive, x, y, w, h, radius = p
    cx, cy = px + 0.5, py + 0.5
    if not (x <= cx < x + w and y <= cy < y + h):
        return False
    if primitive == "ellipse":
        return ((cx - x - w / 2) / (w / 2)) ** 2 + ((cy - y - h / 2) / (h / 2)) ** 2 <= 1
    if primitive == "round_rectangle":
        r = max(0, min(radius, w / 2, h / 2))
        dx, dy = max(x + r - cx, cx - (x + w - r), 0), max(y + r - cy, cy - (y + h - r), 0)
        return dx * dx + dy * dy <= r * r
    return True


def test_scan_lines_pixel_by_pixel(spark):
    rng = random.Random(9)
    rows = [(k, k % 7, rng.choice(["polygon", "round_rectangle", "ellipse"]), *(rng.uniform(-6, 40) for _ in "xy"), rng.uniform(0.1, 25), rng.uniform(0.1, 25), rng.uniform(-1, 9)) for k in range(150)]
    rows += [(200, 7, "polygon", 3.0, 3.0, 0.0, 5.0, 1.0), (201, 7, "ellipse", 3.0, 3.0, 5.0, -1.0, 1.0), (202, 7, "ellipse", 10.4, 3.0, 0.05, 0.05, 1.0), (203, 7, "round_rectangle", 2.0, 2.0, 8.0, 8.0, 0.0), (204, 7, "polygon", -50.0, -50.0, 20.0, 20.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, tile_id long, primitive string, x double, y double, w double, h double, radius double")
    one = shapes.spans(df, W, H, "id", "tile_id")
    got = {(r.id, r.x, r.y) for r in runs.pixels(one.withColumn("tile_id", F.col("id"))).withColumnRenamed("tile_id", "id").collect()}
    want = {(r[0], x, y) for r in rows if r[5] > 0 and r[6] > 0 for x in range(W) for y in range(H) if inside(r[2:], x, y)}
    assert got == want and len(want) > 5000
    whole = shapes.merged(one, "tile_id")
    tiles = collections.defaultdict(set)
    for r in rows:
        tiles[r[1]] |= {(x, y) for i, x, y in want if i == r[0]}
    held = [(r.tile_id, r.x, r.y) for r in runs.pixels(whole).collect()]
    assert len(held) == len(set(held)) and set(held) == {(t, x, y) for t, s in tiles.items() for x, y in s}
    assert {r.tile_id: r.pixels for r in shapes.areas(whole, "tile_id").collect()} == {t: len(s) for t, s in tiles.items() if s}
    assert shapes.spans(df.where("false"), W, H, "id").isEmpty()


def test_areas_without_listing_runs(spark, monkeypatch):
    """The counts of runs that are never listed: of shapes alone, and of masks whose runs are united in many pieces."""
    rng = random.Random(4)
    rows = [(k, k % 5, rng.choice(["polygon", "round_rectangle", "ellipse"]), *(rng.uniform(-9, 40) for _ in "xy"), rng.uniform(-0.5, 30), rng.uniform(0.1, 25), rng.uniform(-1, 9)) for k in range(200)]
    rows += [(300, 6, "ellipse", 60.0, 3.0, 5.0, 5.0, 1.0), (301, 7, "polygon", 3.0, 40.0, 5.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, tile_id long, primitive string, x double, y double, w double, h double, radius double").coalesce(1)
    one = shapes.spans(df, W, H, "id", "tile_id")
    want = sorted(map(tuple, shapes.areas(one, "id").collect())), sorted(map(tuple, shapes.areas(shapes.merged(one, "tile_id"), "tile_id").collect()))
    for limit in (shapes.RUNS, 7):
        monkeypatch.setattr(shapes, "RUNS", limit)
        assert sorted(map(tuple, shapes.shape_areas(df, W, H, "id").collect())) == want[0]
        assert sorted(map(tuple, shapes.mask_areas(df, W, H, "tile_id").collect())) == want[1]
    plan = shapes.mask_areas(df, W, H, "tile_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan

"""Run-length components and hidden evidence against pixel-by-pixel versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import hidden, occlusion, runs
from strataframe.operators.durable import stored


def plain_components(on, corners):
    """First pixel (y, x) of the component of each pixel."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    first = {}
    for p in sorted(on):
        if p in first:
            continue
        first[p], todo = p, [p]
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                q = (y + dy, x + dx)
                if q in on and q not in first:
                    first[q] = p
                    todo.append(q)
    return first


def random_mask(seed, share, w=23, h=17):
    rng = random.Random(seed)
    return {(y, x) for y in range(h) for x in range(w) if rng.random() < share}


def frame(spark, masks):
    return spark.createDataFrame([(t, x, y) for t, m in masks.items() for y, x in m], "tile_id long, x long, y long").repartition(3)


@pytest.mark.parametrize("corners", [False, True])
def test_components_of_runs(spark, corners):
    masks = {k: random_mask(k, share) for k, share in enumerate((0.1, 0.3, 0.45, 0.5, 0.6, 0.8, 1.0))} | {90: {(5, 7)}}
    got = runs.pixels(runs.components(frame(spark, masks).union(frame(spark, {1: masks[1]})), corners), "component").collect()
    want = {(t, y, x, f[0] * runs.ROW + f[1]) for t, m in masks.items() for (y, x), f in plain_components(m, corners).items()}
    assert len(got) == len(want) and {(r.tile_id, r.y, r.x, r.component) for r in got} == want


def test_components_of_a_large_tile():
    """A winding line and a chessboard of one piece each, as runs."""
    winding = np.zeros((4000, 4000), bool)
    winding[::2] = True
    winding[1::4, -1] = winding[3:-1:4, 0] = True
    for grid, corners in ((winding[:-1], False), (np.indices((1500, 1500)).sum(axis=0) % 2 == 0, True)):
        edges = np.diff(np.pad(grid.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        y, x0 = np.nonzero(edges == 1)
        x1 = np.nonzero(edges == -1)[1] - 1
        assert (runs.joined_runs(y, x0, x1, int(corners)) == 0).all()


def plain_evidence(visible, front, tolerance):
    visible = visible - front
    parts, pieces = plain_components(visible, True), plain_components(front, True)
    out = {}
    for first in set(pieces.values()):
        own = {p for p, f in pieces.items() if f == first}
        beside = lambda p: any((p[0] + a, p[1] + b) in own for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))  # noqa: B023, E731
        on = {s: {(y - dy, x - dx) for y, x in own if (y - dy, x - dx) in visible} for s, (dx, dy) in hidden.SIDES.items()}
        goes = lambda c: any(parts[q] == parts[c] and q != c and not beside(q) for q in visible)  # noqa: B023, E731
        pairs = [(a, b, "left", "right") for a in on["left"] for b in on["right"] if abs(a[0] - b[0]) <= tolerance and goes(a) and goes(b)]
        pairs += [(a, b, "top", "bottom") for a in on["top"] for b in on["bottom"] if abs(a[1] - b[1]) <= tolerance and goes(a) and goes(b)]
        if pairs:
            out[first] = (own, len(pairs), {(a, s) for a, _, s, _ in pairs} | {(b, s) for _, b, _, s in pairs})
    return out


def test_evidence_pixel_by_pixel(spark):
    rng = random.Random(3)
    scenes = {}
    for t in range(25):
        front = {(y, x) for y in range(3, 11) for x in range(8, 8 + rng.randrange(1, 6))} | random_mask(t + 100, 0.03)
        rear = {(y, x) for y in range(5, 5 + rng.randrange(1, 5)) for x in range(rng.randrange(8), rng.randrange(14, 20))} | random_mask(t, 0.15)
        scenes[t] = (rear, front, rng.randrange(1, 4))
    tolerance = spark.createDataFrame([(t, s[2]) for t, s in scenes.items()], "tile_id long, tolerance long")
    e = hidden.hidden_evidence(frame(spark, {t: s[0] for t, s in scenes.items()}), frame(spark, {t: s[1] for t, s in scenes.items()}), tolerance)
    want = {t: plain_evidence(*s) for t, s in scenes.items()}
    code = lambda p: p[0] * runs.ROW + p[1]
    assert {(r.tile_id, r.component, r.pixels, r.pairs) for r in e.pieces.collect()} == {(t, code(f), len(own), n) for t, w in want.items() for f, (own, n, _) in w.items()}
    assert {(r.tile_id, r.component, (r.y, r.x), r.side) for r in e.contacts.collect()} == {(t, code(f), c, s) for t, w in want.items() for f, (_, _, ends) in w.items() for c, s in ends}
    assert {(r.tile_id, r.component, (r.y, r.x)) for r in e.hidden.collect()} == {(t, code(f), p) for t, w in want.items() for f, (own, _, _) in w.items() for p in own}
    assert sum(map(len, want.values())) > 15


def test_nothing_hidden(spark):
    none = spark.createDataFrame([], "tile_id long, x long, y long")
    some = frame(spark, {1: {(0, 0), (0, 1)}})
    tolerance = spark.createDataFrame([(1, 1)], "tile_id long, tolerance long")
    for visible, front in ((none, none), (some, none), (none, some), (some, some)):
        e = hidden.hidden_evidence(visible, front, tolerance)
        assert e.pieces.isEmpty() and e.hidden.isEmpty() and e.contacts.isEmpty()


def test_padding_and_alignment(spark):
    rows = [(1000, 600, 40, 30), (64, 64, 3, 3), (6400, 6400, 1000, 900), (10, 10, 1, 1)]
    df = spark.createDataFrame(rows, "cw long, ch long, w long, h long")
    got = df.select(hidden.crop_padding(*map(F.col, df.columns)), hidden.alignment(*map(F.col, df.columns))).collect()
    assert list(map(tuple, got)) == [(7, 2), (1, 1), (100, 56), (1, 1)]


def test_stages_name_the_first_failure(spark):
    """One scene, accepted as it is; each change of the answer or the source gives the reason of its stage."""
    def scene(t, change=None, source_change=None):
        rows = []
        for y in range(12):
            for x in range(16):
                rear, front = 4 <= y <= 7 and 1 <= x <= 14, 6 <= x <= 9 and 2 <= y <= 9
                s = [40, 90, 200, 255] if front else [200, 60, 60, 255] if rear else [120, 200, 120, 255]
                a = [200, 60, 60, 255] if rear else [120, 200, 120, 255] if not front else [0, 0, 0, 0]
                s = (source_change or (lambda *p: p[-1]))(x, y, s)
                a = (change or (lambda *p: p[-1]))(x, y, a)
                rows.append((t, x, y, rear and not front, front, *s, *a))
        return rows

    at = lambda px, py, new: lambda x, y, old: new if (x, y) == (px, py) else old
    cases = [
        (None, None, ("accepted", None)), (at(7, 5, [40, 90, 200, 255]), None, ("rejected", "residual_occluder")), (at(7, 5, [90, 90, 90, 255]), None, ("rejected", "ambiguous_appearance")),
        (at(7, 5, [200, 60, 60, 128]), None, ("rejected", "ambiguous_appearance")), (lambda x, y, old: [0, 0, 0, 0] if x == 6 else old, None, ("rejected", "contour_mismatch")),
        (lambda x, y, old: [0, 0, 0, 0] if x == 7 else old, None, ("rejected", "contour_mismatch")), (None, lambda x, y, old: [60, 90, 200, 255] if old[0] == 200 else old, ("rejected", "ambiguous_appearance")),
        (None, lambda x, y, old: old[:3] + [0] if x < 6 else old, ("rejected", "insufficient_evidence")), (None, at(5, 4, [200, 60, 60, 100]), ("rejected", "seam_mismatch")),
        (at(6, 4, [212, 60, 60, 255]), at(5, 4, [199, 60, 60, 255]), ("rejected", "seam_mismatch")),
    ]
    rows = [r for t, (change, source, _) in enumerate(cases) for r in scene(t, change, source)]
    s = stored(spark.createDataFrame(rows, "tile_id long, x long, y long, v boolean, f boolean, r long, g long, b long, a long, ar long, ag long, ab long, aa long"), "scenes")
    mask = lambda c: s.where(c).select("tile_id", "x", "y")
    pick = lambda *c: s.select("tile_id", "x", "y", *(F.col(n).alias(n[-1]) for n in c))
    tiles = s.select("tile_id").distinct().selectExpr("tile_id", "tile_id page", "true requested", "true valid", "true answered")
    result, judged, image = hidden.completed(tiles, mask("v"), mask("f"), pick("r", "g", "b", "a"), pick("ar", "ag", "ab", "aa"), tiles.selectExpr("tile_id", "1L tolerance"))
    assert {r.tile_id: (r.status, r.reason) for r in result.collect()} == {t: want for t, (_, _, want) in enumerate(cases)}
    assert {r.tile_id for r in image.select("tile_id").distinct().collect()} == {0} and image.count() == 192
    whole = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in image.collect()}
    assert all(whole[x, y] == ((200, 60, 60, 255) if 4 <= y <= 7 and 1 <= x <= 14 else (0, 0, 0, 0)) for x in range(16) for y in range(12))
    one = judged.where("tile_id = 0").first()
    assert (one.generated, one.residual, one.bridged, one.one_piece, one.one_whole) == (16, 0, True, True, True)


def test_samples_meet_in_one_aggregate(spark):
    """The three kinds of samples are those of ``occlusion``, without a join of one mask with another."""
    bar = [(t, x, y) for t in (0, 1) for x in range(16) for y in (4, 5, 6) if not (t == 1 and x > 9)]
    front = [(t, x, y) for t in (0, 1) for x in (7, 8) for y in range(12)]
    colours = [(t, x, y, x, y, t, 0 if (x, y) == (5, 5) else 255) for t in (0, 1) for x in range(16) for y in range(12)]
    pixels = lambda rows: spark.createDataFrame(rows, "tile_id long, x long, y long")
    occluder, source = pixels(front), spark.createDataFrame(colours, "tile_id long, x long, y long, r long, g long, b long, a long")
    e = hidden.hidden_evidence(pixels(bar), occluder, spark.createDataFrame([(0, 1), (1, 1)], "tile_id long, tolerance long")).stored()
    got = hidden._samples(e, occluder, source)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    behind, opaque, wide = e.hidden.select("tile_id", "x", "y"), source.where("a >= 240"), 1 << 30
    want = {
        "rear": occlusion.rear_samples(e.visible, behind, occluder, opaque, wide, wide, e.contacts.select("tile_id", "x", "y").distinct()),
        "front": behind.join(opaque, ["tile_id", "x", "y"], "left_semi"), "background": occlusion.background_samples(e.visible, behind, occluder, opaque, wide, wide),
    }
    rows = [(r.tile_id, r.part, r.r, r.g) for r in got.collect()]
    assert sorted(rows) == sorted((r.tile_id, part, r.x, r.y) for part, df in want.items() for r in df.collect()) and {part for _, part, _, _ in rows} == {"rear", "front", "background"}

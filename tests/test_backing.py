"""Surfaces that carry text, against plain versions on the scenes of the smallest tables."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest

from strataframe.operators import backing, raster_udf
from strataframe.plans import scenes

DATA, W, H = "/root/testdata/sf0.001", 16, 12


def test_elimination():
    rng = np.random.default_rng(1)
    systems = rng.normal(size=(50, 3, 6))
    systems[:5, 0] = systems[:5, 1] * 2
    systems[5:10, 0, 0] = 0
    got = backing.eliminated(systems)
    assert np.isnan(got[:5]).all()
    assert np.allclose(got[5:], np.linalg.solve(systems[5:, :, :3], systems[5:, :, 3:]))


def rank95(v):
    return sorted(v)[math.ceil(0.95 * len(v)) - 1] if len(v) else 0


def plain_support(cut):
    open_ = {p for p, a in cut.items() if a < 255}
    todo = [p for p in open_ if p[0] in (0, W - 1) or p[1] in (0, H - 1)]
    seen = set(todo)
    while todo:
        x, y = todo.pop()
        for q in ((x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if q in open_ and q not in seen:
                seen.add(q)
                todo.append(q)
    return {p: a if p in seen else 255 for p, a in cut.items()}


def plain_residual(colour, alpha, excluded):
    solid = lambda p: alpha.get(p, 0) >= 128
    s = [p for p in alpha if solid(p) and p not in excluded and all(solid(q) for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)))]
    if len(s) < 16:
        return math.inf
    at = np.array([(1, x, y) for x, y in s], float)
    if np.linalg.matrix_rank(at) < 3:
        return math.inf
    c = np.array([colour[p][:3] for p in s], float)
    return rank95(np.abs(c - at @ np.linalg.lstsq(at, c, rcond=None)[0]).max(axis=1))


def plain_backing(cut, colour, texts, glyphs, ink):
    held = plain_support(cut)
    for t in texts:
        left, top, w, h = map(float, (t.x, t.y, t.w, t.h))
        cells = [(x, y) for x in range(math.floor(left), math.ceil(left + w)) for y in range(math.floor(top), math.ceil(top + h))]
        if not all(held.get(p, 0) >= 128 for p in cells) if t.carried else any(held.get(p, 0) >= 16 for p in cells):
            return "backing_mask_invalid"
    alpha = {p: held[p] if p in glyphs else a for p, a in cut.items()}
    given = {p for p in glyphs if p in cut and held[p] > cut[p]}
    repair = {p for p in glyphs if alpha.get(p, 0) >= 128}
    if plain_residual(colour, alpha, repair) > 18:
        return "surface_unstable"
    image, mask, solid = np.zeros((H, W, 4), np.uint8), np.zeros((H, W), bool), np.zeros((H, W), bool)
    for (x, y), c in colour.items():
        image[y, x], mask[y, x], solid[y, x] = c, (x, y) in repair, alpha[x, y] >= 128
    made, reason, _ = raster_udf.repaired(image, mask, solid)
    if reason:
        return "repair_seam" if reason == "surface_variance_too_high" else "surface_unstable"
    new = {(x, y): tuple(map(int, made[y, x])) for x, y in colour}
    step = lambda a, b: max(abs(u - v) for u, v in zip(a[:3], b[:3], strict=True))
    core = [p for p, c in glyphs.items() if c and alpha.get(p, 0) >= 128]
    for p in given:
        if glyphs[p]:
            way = [i - a for i, a in zip(ink, new[p], strict=False)]
            length = sum(w * w for w in way)
            share = max(0, min(1, sum((b - a) * w for b, a, w in zip(colour[p], new[p], way, strict=False)) / length)) if length else None
            if share is None or any(abs(b - (a + share * w)) > 8 for b, a, w in zip(colour[p], new[p], way, strict=False)):
                return "glyph_residue"
    if not core or sum(step(colour[p], new[p]) < 24 for p in core) / len(core) > 0.02:
        return "glyph_residue"
    beside = lambda p: ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1))
    if rank95([step(new[p], new[q]) for p in repair for q in beside(p) if q not in repair and alpha.get(q, 0) >= 128]) > 8:
        return "repair_seam"
    return "surface_unstable" if plain_residual(new, alpha, repair) > 18 else None


def test_text_backing_tile_by_tile(spark):
    cut, source, texts, glyphs, inks = scenes._surface(spark, DATA)
    result, asset = backing.extracted(cut, source, texts, glyphs, inks)
    by = lambda df, f: {t: dict(f(r) for r in rows) for t, rows in grouped(df).items()}

    def grouped(df):
        out = collections.defaultdict(list)
        for r in df.collect():
            out[r.tile_id].append(r)
        return out

    cuts, colours, marks = by(cut, lambda r: ((r.x, r.y), r.a)), by(source, lambda r: ((r.x, r.y), (r.r, r.g, r.b, r.a))), by(glyphs, lambda r: ((r.x, r.y), r.core))
    boxes, ink = grouped(texts), {r.tile_id: (r.r, r.g, r.b) for r in inks.collect()}
    want = {t: plain_backing(cuts[t], colours[t], boxes[t], marks.get(t, {}), ink[t]) for t in cuts}
    got = {r.tile_id: r.reason for r in result.collect()}
    assert got == want
    assert {t for t, w in want.items() if w is None} == {r.tile_id for r in asset.select("tile_id").distinct().collect()}
    counts = collections.Counter(want.values())
    assert counts[None] > 20 and len(counts) >= 4, counts


def test_a_glyph_of_the_colour_behind(spark):
    """Holes inside a cut-out belong to it, those that reach its edge don't; corners let the outside in."""
    def cells(rows):
        return spark.createDataFrame([(1, x, y, 255 if c == "#" else 40 if c == "+" else 0) for y, row in enumerate(rows) for x, c in enumerate(row)], "tile_id long, x long, y long, a long")

    for rows, holes in ((["......", ".####.", ".#.+#.", ".####.", "......"], 2), (["......", ".###.#", ".#.#..", ".####.", "......"], 1), (["......", ".##.#.", ".#.##.", ".####.", "......"], 0)):
        got = backing.support(cells(rows)).collect()
        assert sum(r.inside for r in got) - sum(row.count("#") for row in rows) == holes, rows


@pytest.mark.parametrize("n", [0, 15])
def test_too_few_samples(spark, n):
    flat = spark.createDataFrame([(1, x, y, 255) for x in range(5) for y in range(5)][: max(n, 1) + 10], "tile_id long, x long, y long, a long")
    source = flat.selectExpr("tile_id", "x", "y", "9L r", "9L g", "9L b")
    assert [r.residual for r in backing.surface_residual(source, flat, flat.where("false")).collect()] == [math.inf]

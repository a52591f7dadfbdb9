"""Tiles that are repaired together: the same as each on its own, at the cost of a few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strataframe.operators import raster_udf


def drawn(rng, surface):
    h, w = rng.integers(1, 18, 2)
    image = np.dstack([np.clip(120 + rng.integers(-20, 21, (h, w, 3)) // rng.choice([1, 4, 40]), 0, 255), np.full((h, w), 255)]).astype(np.uint8)
    mask = rng.random((h, w)) < rng.choice([0, 0.05, 0.3, 0.9])
    return image, mask, (rng.random((h, w)) < 0.9) | (mask if rng.random() < 0.8 else False) if surface else None


def test_together_as_alone(monkeypatch):
    rng = np.random.default_rng(7)
    for surface in (False, True):
        tiles = [drawn(rng, surface) for _ in range(120)]
        alone = [raster_udf.repaired(*t) for t in tiles]
        assert len({reason for _, reason, _ in alone}) >= 3
        for limit in (1, 300, 1 << 16):
            monkeypatch.setattr(raster_udf, "TOGETHER", limit)
            for (a, reason, m), (b, other, n) in zip(alone, raster_udf.repaired_all(iter(tiles)), strict=True):
                assert reason == other and m == n and (a == b).all()


def test_steps_are_shared(monkeypatch):
    """A hundred tiles take as many steps as one."""
    steps = []
    monkeypatch.setattr(raster_udf, "_firsts", lambda at, of=raster_udf._firsts: steps.append(1) or of(at))
    image, mask = np.full((12, 12, 4), 90, np.uint8), np.zeros((12, 12), bool)
    mask[4:7, 4:7] = True
    raster_udf.repaired(image, mask)
    one = len(steps)
    assert all(not reason for _, reason, _ in raster_udf.repaired_all([(image, mask, None)] * 100)) and len(steps) == 2 * one


def test_lists_of_pixels():
    rows = [[(y, x, 0x102030, 1 if (y, x) == (3, 7) else 0) for y in range(1, 8) for x in range(5, 12)], [(0, 0, 5, 1)]]
    y, x, c, f = (pa.array([[p[k] for p in r] for r in rows], pa.list_(pa.int32())) for k in range(4))
    reasons, metrics, filled = raster_udf.repaired_lists(y, x, c, f)
    assert reasons.to_pylist() == [None, "surface_samples_insufficient"] and [m["masked"] for m in metrics] == [1, 1]
    assert filled.to_pylist() == [[{"x": 7, "y": 3, "r": 16, "g": 32, "b": 48}], []]

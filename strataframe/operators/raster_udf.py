"""Raster operators that are sequential: one tile at a time in numpy, in Arrow batches. A tile is (width, height, samples), row by row, one byte or four a pixel."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import tee

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataframe.operators.runs import joined_runs

CROSS = ((-1, 0), (0, -1), (0, 1), (1, 0))  # (dy, dx): up, left, right, down
AROUND = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
RING, RING_MAD, SEED_DISTANCE, PASSES, FILLED_P95, SURFACE_STEP = 16, 18, 64, 64, 28, 32
TOGETHER = 1 << 16  # pixels of tiles that are repaired at once
FRINGE, DOMINANT, GAP, GAP_SHARE = 96, 0.6, 4, 0.1


def grid_runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, first x, last x) of the runs of a boolean grid, in reading order."""
    edge = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return y, x0, np.nonzero(edge == -1)[1] - 1


def labelled(on: np.ndarray, steps: tuple = CROSS) -> np.ndarray:
    """Components of a boolean grid, numbered from 1 in reading order of their first pixels; 0 is off."""
    y, x0, x1 = grid_runs(on)
    number = np.unique(joined_runs(y, x0, x1, int(len(steps) > 4)), return_inverse=True)[1]
    out = np.zeros(on.shape, np.int32)
    out[on.astype(bool)] = np.repeat(number + 1, x1 - x0 + 1)
    return out


def flooded(open_: np.ndarray, steps: tuple = CROSS) -> np.ndarray:
    """What is reached from the rim through open cells: the components that touch it."""
    parts = labelled(open_, steps)
    reached = np.zeros(int(parts.max()) + 1, bool)
    reached[np.concatenate((parts[0], parts[-1], parts[:, 0], parts[:, -1]))] = True
    reached[0] = False
    return reached[parts]


def beyond(parts: np.ndarray, main: int, limit: float) -> np.ndarray:
    """For each component, whether all of it lies farther than ``limit`` (squared) from the component ``main``; rows are searched, not pairs."""
    y, x = np.nonzero((parts > 0) & (parts != main))
    best, wide = np.full(len(y), np.inf), parts.shape[1] + 1
    my, mx = np.nonzero(parts == main)
    keys = my * wide + mx
    for dy in range(-int(limit**0.5), int(limit**0.5) + 1):
        after = np.searchsorted(keys, (y + dy) * wide + x)
        for j in (np.maximum(after - 1, 0), np.minimum(after, len(keys) - 1)):
            best = np.minimum(best, np.where(my[j] == y + dy, dy**2 + (mx[j] - x) ** 2, np.inf))
    nearest = np.full(int(parts.max()) + 1, np.inf)
    np.minimum.at(nearest, parts[y, x], best)
    nearest[[0, main]] = 0
    return nearest > limit


def half_up(v: np.ndarray) -> np.ndarray:
    return np.floor(v + 0.5)


def rim(image: np.ndarray) -> np.ndarray:
    h, w = image.shape[:2]
    on = np.zeros((h, w), bool)
    on[[0, -1], :] = on[:, [0, -1]] = True
    return image[on]


def without_background(image: np.ndarray, tolerance: int = 32, consistent: float = 0.85, interior: bool = False) -> np.ndarray | None:
    """RGBA with the background that joins the rim made transparent, far small pieces dropped and a soft edge; null if the rim has no one colour."""
    out = image.astype(np.float64)
    edge = np.median(rim(out[..., :3]), axis=0)
    step = np.abs(out[..., :3] - edge).max(axis=-1)
    if (rim(step) <= tolerance).mean() < consistent:
        return None
    gone = (step <= tolerance) if interior else flooded(step <= tolerance)
    out[gone, 3] = 0
    parts = labelled(~gone & (out[..., 3] > 0))
    sizes = np.bincount(parts.ravel())[1:]
    if len(sizes) > 1 and sizes.max() / sizes.sum() >= DOMINANT:
        main = int(sizes.argmax()) + 1
        far = beyond(parts, main, max(GAP, GAP_SHARE * float(np.hypot(*parts.shape))) ** 2)[parts]
        gone |= far
        out[far, 3] = 0
    near = np.zeros_like(gone)
    padded = np.pad(gone, 1)
    for dy, dx in AROUND:
        near |= padded[1 + dy : 1 + dy + gone.shape[0], 1 + dx : 1 + dx + gone.shape[1]]
    soft = near & ~gone & (step < tolerance + FRINGE)
    alpha = np.clip(half_up((step - tolerance) / FRINGE * 255), 1, 254)
    share = (alpha / 255)[..., None]
    mixed = np.clip(half_up((out[..., :3] - (1 - share) * edge) / share), 0, 255)
    out[soft, :3], out[soft, 3] = mixed[soft], alpha[soft]
    out[out[..., 3] == 0, :3] = 0
    return out.astype(np.uint8)


def _firsts(at: np.ndarray) -> np.ndarray:
    """Where each value of an array stands first, in order."""
    return np.sort(np.unique(at, return_index=True)[1])


def _ranked(values: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values sorted within their groups (0 to n - 1), where each group starts, and its size."""
    size = np.bincount(of, minlength=n)
    return values[np.lexsort((values, of))], np.cumsum(size) - size, size


def _rank95(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The value of each group that 95 of 100 don't exceed; 0 for an empty one."""
    v, start, size = _ranked(values, of, n)
    return np.where(size > 0, np.append(v, 0)[np.where(size > 0, start + np.ceil(0.95 * size).astype(int) - 1, -1)], 0).astype(float)


def _medians(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The median of each column of each group, the mean of the middle two where there are two; 0 for an empty group."""
    out = []
    for column in values.T:
        v, start, size = _ranked(column, of, n)
        v, last = np.append(v, 0), np.maximum(size - 1, 0)
        low, high = (np.where(size > 0, start + k, -1) for k in (last // 2, size // 2))
        out.append((v[low] + v[high]) / 2)
    return np.stack(out, axis=1)


Tile = tuple[np.ndarray, np.ndarray, np.ndarray | None]


def repaired(image: np.ndarray, mask: np.ndarray, surface: np.ndarray | None = None) -> tuple[np.ndarray, str, dict]:
    """:func:`repaired_all` of one tile."""
    return next(repaired_all([(image, mask, surface)]))


def repaired_all(tiles: Iterable[Tile]) -> Iterator[tuple[np.ndarray, str, dict]]:
    """Tiles (image, mask, surface), all with a surface or none, repaired in their order: small ones TOGETHER pixels at a time, larger ones each on its own."""
    some, held = [], 0
    for t in tiles:
        if some and held + t[1].size > TOGETHER:
            yield from _repaired(some)
            some, held = [], 0
        some.append(t)
        held += t[1].size
    if some:
        yield from _repaired(some)


def _repaired(tiles: list[Tile]) -> list[tuple[np.ndarray, str, dict]]:
    """For each tile the masked pixels filled from the surface around them, a reason why not (or ""), and the metrics.

    A ring of 16 samples at least, close together, seeds the fill; each masked pixel takes the nearest seed's colour (breadth first, up, left, right,
    down), and 64 passes in place, each pixel the rounded mean of its neighbours, smooth it. In place and in reading order, a pixel of diagonal d in
    pass k sees what diagonal d - 1 has after pass k and d + 1 after pass k - 1; so at step t all pixels with d + 2 k = t change at once.
    With ``surface``, samples come from it alone, and steps between neighbours of the ring and across the seam count instead of spreads.
    The pixels of all tiles stand one after another, and each step is made in all tiles at once: what a step costs, tiles share.
    """
    n, plain = len(tiles), tiles[0][2] is None
    high, wide = (np.array([t[1].shape[k] for t in tiles]) for k in (0, 1))
    size = high * wide
    start, of = np.cumsum(size) - size, np.repeat(np.arange(n, dtype=np.int32), size)
    on = np.concatenate([t[1].ravel().astype(bool) for t in tiles])
    flat = np.concatenate([t[0].reshape(t[1].size, -1)[:, :3] for t in tiles]).astype(np.int64)
    open_ = np.ones(len(on), bool) if plain else np.concatenate([t[2].ravel().astype(bool) for t in tiles])
    reasons, alive = np.full(n, "", object), np.ones(n, bool)
    metrics = {k: np.zeros(n, t) for k, t in (("masked", int), ("ring", int), ("mad", float), ("p95", float))}

    def stopped(which: np.ndarray, reason: str) -> None:
        reasons[alive & which] = reason
        alive[which] = False

    def living(at: np.ndarray) -> np.ndarray:
        return at[alive[of[at]]]

    def count(at: np.ndarray) -> np.ndarray:
        return np.bincount(of[at], minlength=n)

    def beside(at: np.ndarray) -> np.ndarray:
        """The places up, left, right and down of each place; -1 outside its tile."""
        w, h = wide[of[at]], high[of[at]]
        y, x = np.divmod(at - start[of[at]], w)
        return np.stack([np.where(y > 0, at - w, -1), np.where(x > 0, at - 1, -1), np.where(x < w - 1, at + 1, -1), np.where(y < h - 1, at + w, -1)], axis=1)

    inside = np.flatnonzero(on)
    stopped(count(inside[~open_[inside]]) > 0, "surface_samples_insufficient")
    inside = living(inside)
    metrics["masked"] = count(inside)
    stopped(metrics["masked"] == 0, "mask_empty")
    seen, front, found = on.copy(), inside, [inside[:0]]
    while len(front):
        q = beside(front).ravel()
        q = q[(q >= 0) & ~seen[q]]
        q = q[_firsts(q)]
        seen[q] = True
        front = q[open_[q]]
        found.append(front)
        metrics["ring"] += count(front)
        front = front[metrics["ring"][of[front]] < RING]
    stopped(metrics["ring"] < RING, "surface_samples_insufficient")
    ring = living(np.concatenate(found))
    middle = _medians(flat[ring], of[ring], n)
    safe, limit = ring, RING_MAD
    if plain:
        metrics["mad"] = np.where(alive, _medians(np.abs(flat[ring] - middle[of[ring]]), of[ring], n).max(axis=1), 0.0)
    else:
        of_ring, q = np.zeros(len(on), bool), beside(ring)
        of_ring[ring] = True
        pair = (q > ring[:, None]) & of_ring[q]
        a, b = np.repeat(ring, pair.sum(axis=1)), q[pair]
        metrics["mad"], limit = _rank95(np.abs(flat[a] - flat[b]).max(axis=1), of[a], n), SURFACE_STEP
    stopped(metrics["mad"] > limit, "surface_variance_too_high")
    safe = living(ring)
    if plain:
        safe = safe[np.sqrt(((flat[safe] - middle[of[safe]]) ** 2).sum(axis=1)) <= SEED_DISTANCE]
    metrics["ring"] = np.where(alive, count(safe), metrics["ring"])
    stopped(metrics["ring"] < RING, "surface_samples_insufficient")
    safe = living(safe)
    seed = np.full(len(on), -1)
    seed[safe] = front = safe
    while len(front):
        q, to = beside(front).ravel(), np.repeat(seed[front], 4)
        new = (q >= 0) & on[q] & (seed[q] < 0)
        q, to = q[new], to[new]
        first = _firsts(q)
        seed[q[first]] = to[first]
        front = q[first]
    inside = living(inside)
    stopped(count(inside[seed[inside] < 0]) > 0, "surface_samples_insufficient")
    inside = living(inside)
    out = flat.copy()
    out[inside] = flat[seed[inside]]
    diagonal = np.add(*np.divmod(inside - start[of[inside]], wide[of[inside]]))
    least = np.full(n, np.iinfo(int).max)
    np.minimum.at(least, of[inside], diagonal)
    diagonal -= least[of[inside]]  # each tile begins at step 0
    order = np.lexsort((diagonal, diagonal % 2))
    at, diagonal = inside[order], diagonal[order]
    q = beside(at)
    known = (q >= 0) & (seed[q] >= 0)
    many = known.sum(axis=1)
    halves = np.searchsorted(diagonal % 2, [0, 1, 2])
    for t in range(int(diagonal.max(initial=-2 * PASSES)) + 2 * PASSES - 1):
        low, high_ = halves[t % 2 : t % 2 + 2]
        a, b = low + np.searchsorted(diagonal[low:high_], [t - 2 * PASSES + 2, t + 1])
        if a < b:
            total = (out[q[a:b]] * known[a:b, :, None]).sum(axis=1)
            out[at[a:b]] = (2 * total + many[a:b, None]) // (2 * many[a:b, None])
    if plain:
        metrics["p95"] = _rank95(np.abs(out[inside] - middle[of[inside]]).max(axis=1), of[inside], n)
        stopped(metrics["p95"] > FILLED_P95, "filled_pixels_too_different")
    else:
        q = beside(inside)
        seam = (q >= 0) & ~on[q] & open_[q]
        a, b = np.repeat(inside, seam.sum(axis=1)), q[seam]
        metrics["p95"] = _rank95(np.abs(out[a] - out[b]).max(axis=1), of[a], n)
    made = []
    for k, (image, mask, _) in enumerate(tiles):
        if alive[k]:
            image = image.copy()
            image.reshape(mask.size, -1)[:, :3] = out[start[k] : start[k] + size[k]]
            image = image.astype(np.uint8)
        made.append((image, reasons[k], {m: v[k].item() for m, v in metrics.items()}))
    return made


def cut_out(y: pa.ListArray, x: pa.ListArray, colour: pa.ListArray, flag: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(top, left, image, flags) of each list of pixels, colours being one number; both are 0 where no pixel is."""
    ends = np.cumsum([0, *y.value_lengths().to_pylist()])
    y, x, colour, flag = (v.flatten().to_numpy() for v in (y, x, colour, flag))
    for i, j in zip(ends, ends[1:], strict=False):
        top, left, c = y[i:j].min(), x[i:j].min(), colour[i:j]
        at = y[i:j] - top, x[i:j] - left
        image = np.zeros((at[0].max() + 1, at[1].max() + 1, 4), np.uint8)
        flags = np.zeros(image.shape[:2], np.uint8)
        image[at], flags[at] = np.stack([c >> 16, c >> 8 & 255, c & 255, np.full_like(c, 255)], axis=1), flag[i:j]
        yield int(top), int(left), image, flags


def repaired_lists(y: pa.ListArray, x: pa.ListArray, colour: pa.ListArray, flag: pa.ListArray, surface: bool = False) -> tuple[pa.Array, list[dict], pa.ListArray]:
    """Reasons, metrics and filled pixels (x, y, r, g, b, in reading order) of lists of pixels. Flags: 1 is masked; with ``surface``, 2 is the surface, and 3 both."""
    cut, again = tee(cut_out(y, x, colour, flag))
    done = repaired_all((image, flags % 2 == 1, flags >= 2 if surface else None) for *_, image, flags in again)
    reasons, metrics, size, parts = [], [], [0], [np.zeros((0, 5), np.int64)]
    for (top, left, _, flags), (made, reason, m) in zip(cut, done, strict=True):
        reasons.append(reason or None)
        metrics.append(m)
        if not reason:
            at = np.nonzero(flags % 2 == 1)
            parts.append(np.column_stack([at[1] + left, at[0] + top, made[at][:, :3]]).astype(np.int64))
        size.append(0 if reason else len(parts[-1]))
    filled = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(parts).T], ["x", "y", "r", "g", "b"])
    return pa.array(reasons, pa.string()), metrics, pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), filled)


def per_tile(tiles: DataFrame, work: Callable[[np.ndarray], list[tuple]], schema: str, width: int, height: int, key: str = "tile_id") -> DataFrame:
    """work(grid) of tiles (key, v: array of width * height values) in Arrow batches of many tiles."""
    fields = T._parse_datatype_string(f"{key} long, {schema}")
    arrow = to_arrow_schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, *r) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in work(np.array(v).reshape(height, width))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return tiles.select(key, "v").mapInArrow(rows, fields)


def gathered(pixels: DataFrame, key: str = "tile_id") -> DataFrame:
    """Tiles of a pixel table: their values in reading order."""
    return pixels.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"]).alias("v"))


def tile_components(pixels: DataFrame, on: int = 128, eight: bool = False, width: int = 8, height: int = 8) -> DataFrame:
    """(tile_id, x, y, component): component is the least place (y * width + x) in it."""

    def work(grid: np.ndarray) -> list[tuple]:
        labels = labelled(grid >= on, AROUND if eight else CROSS)
        first: dict[int, int] = {}
        out = []
        for y, x in zip(*np.nonzero(labels), strict=True):
            out.append((int(x), int(y), first.setdefault(int(labels[y, x]), int(y) * width + int(x))))
        return out

    return per_tile(gathered(pixels), work, "x long, y long, component long", width, height)


def _rgba(grid: np.ndarray) -> np.ndarray:
    return np.dstack([grid, grid, grid, np.full_like(grid, 255)]).astype(np.uint8)


def tile_backgrounds(pixels: DataFrame, tolerance: int = 12, consistent: float = 0.6, width: int = 8, height: int = 8) -> DataFrame:
    """(tile_id, removed, soft, kept): pixels of each tile by alpha; no row if its rim has no one colour."""

    def work(grid: np.ndarray) -> list[tuple]:
        out = without_background(_rgba(grid), tolerance, consistent)
        return [] if out is None else [(int((out[..., 3] == 0).sum()), int(((out[..., 3] > 0) & (out[..., 3] < 255)).sum()), int((out[..., 3] == 255).sum()))]

    return per_tile(gathered(pixels), work, "removed long, soft long, kept long", width, height)


def tile_repairs(pixels: DataFrame, x: int = 3, y: int = 3, size: int = 2, width: int = 8, height: int = 8) -> DataFrame:
    """(tile_id, reason, ring, mad, p95, filled): a square of each tile repaired from around it."""
    mask = np.zeros((height, width), bool)
    mask[y : y + size, x : x + size] = True

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grids = (np.asarray(v.values).reshape(height, width) for v in b.column(1))
            done = [(reason, m["ring"], m["mad"], m["p95"], out[..., 0][mask].tolist()) for out, reason, m in repaired_all((_rgba(g), mask, None) for g in grids)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array([r[i] for r in done], f.type) for i, f in enumerate(list(arrow)[1:]))], schema=arrow)

    fields = T._parse_datatype_string("tile_id long, reason string, ring long, mad double, p95 double, filled array<long>")
    arrow = to_arrow_schema(fields)
    return gathered(pixels).select("tile_id", "v").mapInArrow(rows, fields)


#: Limits of a text mask: contrast, spread and number of surface samples, covered share, halo, outside share, line-like pieces.
CONTRAST, SURFACE_MAD, SURFACE_SAMPLES, COVERED, HALO, OUTSIDE, LINE_SPAN, LINE_THICK = 32, 18, 8, 0.85, 8, 0.25, 0.5, 2


def text_mask(image: np.ndarray, x: float, y: float, w: float, h: float, dilation: int = 1) -> tuple[np.ndarray | None, str, dict]:
    """(mask, reason, metrics) of the glyphs in a text box, or why there is none.

    The pixels right around the box give the surface colour, which must be consistent. What stands out from it in the box, and what joins that
    in a small halo, are glyphs; a halo that takes too much or something like a line is refused, and so is a mask that covers most of the box.
    """
    height, width = image.shape[:2]
    left, top, right, bottom = max(0, int(np.floor(x))), max(0, int(np.floor(y))), min(width, int(np.ceil(x + w))), min(height, int(np.ceil(y + h)))
    box = np.zeros((height, width), bool)
    box[top:bottom, left:right] = True
    around = np.zeros_like(box)
    around[max(0, top - 1) : bottom + 1, max(0, left - 1) : right + 1] = True
    metrics = {"masked": 0, "coverage": 0.0, "stroke": 0.0}
    surface = image[around & ~box][:, :3].astype(np.float64)
    if len(surface) < SURFACE_SAMPLES:
        return None, "surface_inconsistent", metrics
    middle = np.median(surface, axis=0)
    if (np.median(np.abs(surface - middle), axis=0) > SURFACE_MAD).any():
        return None, "surface_inconsistent", metrics
    halo = min(HALO, max(2, int(half_up(np.float64(h / 6)))))
    window = np.zeros_like(box)
    window[max(0, top - halo) : bottom + halo, max(0, left - halo) : right + halo] = True
    standing = (np.abs(image[..., :3] - middle).max(axis=-1) >= CONTRAST) & window
    inside = int((standing & box).sum())
    if not inside:
        return None, "no_glyphs", metrics
    if inside == box.sum():
        return None, "full_box", metrics
    parts = labelled(standing, AROUND)
    glyphs = np.isin(parts, np.unique(parts[standing & box]))
    glyphs &= standing
    out = labelled(glyphs & ~box, AROUND)
    outside = 0
    for k in range(1, int(out.max()) + 1):
        py, px = np.nonzero(out == k)
        ph, pw = int(np.ptp(py)) + 1, int(np.ptp(px)) + 1
        if (ph <= LINE_THICK and pw / (right - left) >= LINE_SPAN) or (pw <= LINE_THICK and ph / (bottom - top) >= LINE_SPAN):
            return None, "line_like_fringe", metrics
        outside += len(py)
    if outside / inside > OUTSIDE:
        return None, "fringe_too_large", metrics
    r = min(dilation, max(0, int(h // 4)))
    mask = np.zeros_like(box)
    padded = np.pad(glyphs, r)
    for dy in range(2 * r + 1):
        for dx in range(2 * r + 1):
            mask |= padded[dy : dy + height, dx : dx + width]
    mask &= window
    if (mask & box).sum() / box.sum() >= COVERED:
        return None, "covers_box", metrics
    runs = np.minimum(_runs(standing & box), _runs((standing & box).T).T)[standing & box]
    return mask, "", {"masked": int(mask.sum()), "coverage": inside / int(box.sum()), "stroke": float(np.median(runs))}


def _runs(on: np.ndarray) -> np.ndarray:
    """The length of the horizontal run through each cell that is on."""
    out = np.zeros(on.shape, np.int64)
    for y, row in enumerate(on):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        for a, b in edge.reshape(-1, 2):
            out[y, a:b] = b - a
    return out


def tile_text_masks(pixels: DataFrame, x: int = 2, y: int = 2, size: int = 4, width: int = 8, height: int = 8, gain: int = 1) -> DataFrame:
    """(tile_id, reason, masked, coverage, stroke) of a square box in each tile; ``gain`` raises the tile's contrast."""

    def work(grid: np.ndarray) -> list[tuple]:
        lifted = np.clip((grid - 128) * gain + 128, 0, 255)
        _, reason, m = text_mask(_rgba(lifted), x, y, size, size)
        return [(reason, m["masked"], m["coverage"], m["stroke"])]

    return per_tile(gathered(pixels), work, "reason string, masked long, coverage double, stroke double", width, height)

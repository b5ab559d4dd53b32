"""Image kernels over numpy arrays: one band, mask or canvas at a time, no Spark.

Edge, circle and inpainting kernels follow the usual definitions but promise no pixel-exact agreement with any library.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque

import numpy as np

# ------------------------------------------------------------------------------------------- colour, profiles


def luma(rgb: np.ndarray, kind: str = "bt601") -> np.ndarray:
    """Brightness as float32: ``bt601`` weights or the plain ``mean`` of the channels; grey input passes."""
    x = rgb.astype(np.float32)
    if x.ndim == 2:
        return x
    return x @ np.array([0.299, 0.587, 0.114], np.float32) if kind == "bt601" else x.mean(2)


def row_profile(band: np.ndarray, segments: int = 16, hpad: int = 40) -> np.ndarray:
    """Per row the means of ``segments`` equal stretches; columns that don't fill a stretch at the right are left out."""
    g = luma(band)
    g = g[:, hpad : g.shape[1] - hpad] if g.shape[1] > 2 * hpad else g
    size = g.shape[1] // segments
    if size <= 0:
        return g.mean(1, keepdims=True).astype(np.float32)
    return g[:, : size * segments].reshape(len(g), segments, size).mean(2).astype(np.float32)


def col_profile(band: np.ndarray, vpad: int = 0) -> np.ndarray:
    g = luma(band)
    return (g[vpad : len(g) - vpad] if len(g) > 2 * vpad else g).mean(0).astype(np.float32)


def match_1d(ref: np.ndarray, cur: np.ndarray, predicted: int = 0, radius: int = 400, min_overlap: int = 50, alpha: float = 0.0) -> tuple[int, float, float, int]:
    """Offset p for which ``cur[r]`` looks like ``ref[r + p]``: (p, sad, confidence, overlap).

    The smallest mean absolute difference (plus ``alpha`` per step from the prediction) wins, the lowest p of equals;
    confidence is the best score more than 3 steps away over the winner's (1 if there is none).  Without a candidate: the lowest p, sad infinite.
    """
    ref, cur = (np.atleast_2d(x.T).T.astype(np.float64) for x in (ref, cur))
    h, width = len(cur), cur.shape[1]
    offsets = range(predicted - radius, predicted + radius + 1)
    sads, overlaps = np.full(len(offsets), np.inf), np.zeros(len(offsets), np.int64)
    for k, p in enumerate(offsets):
        lo, hi = max(0, -p), min(h, len(ref) - p)
        if hi - lo >= max(1, min_overlap):
            sads[k] = np.abs(cur[lo:hi] - ref[lo + p : hi + p]).sum() / ((hi - lo) * width)
            overlaps[k] = hi - lo
    scores = sads + alpha * np.abs(np.arange(len(offsets)) - radius)
    best = int(np.argmin(scores))
    if not np.isfinite(scores[best]):
        return offsets[0], float("inf"), float("nan"), 0
    away = np.abs(np.arange(len(scores)) - best) > 3
    second = scores[away & np.isfinite(scores)].min(initial=np.inf)
    second = second if np.isfinite(second) else scores[best]  # nothing else to compare with
    return offsets[best], float(sads[best]), float(np.inf if scores[best] <= 1e-6 else second / scores[best]), int(overlaps[best])


def overlap_mad(a: np.ndarray, b: np.ndarray, dy: int) -> tuple[float, int]:
    """Mean absolute difference of two bands if the second lies ``dy`` rows further down, and the rows that they share."""
    rows = min(len(a) - dy, len(b)) if dy >= 0 else min(len(a), len(b) + dy)
    if rows <= 0:
        return float("nan"), 0
    x, y = (a[dy : dy + rows], b[:rows]) if dy >= 0 else (a[:rows], b[-dy : -dy + rows])
    return float(np.abs(x.astype(np.float32) - y.astype(np.float32)).mean()), rows


def best_place(band: np.ndarray, canvas: np.ndarray, centre: int, radius: int) -> tuple[int, float]:
    """The place near ``centre`` where the band differs least from the canvas: (offset from centre, difference)."""
    best = (0, float("inf"))
    for d in range(-radius, radius + 1):
        y = centre + d
        if 0 <= y and y + len(band) <= len(canvas):
            mad = float(np.abs(canvas[y : y + len(band)].astype(np.float32) - band.astype(np.float32)).mean())
            if mad < best[1]:
                best = (d, mad)
    return best


# ------------------------------------------------------------------------------------------------- masks


def disc(shape: tuple[int, int], cx: float, cy: float, r: float) -> np.ndarray:
    """A filled disc; empty if its centre lies outside."""
    if not (0 <= cy < shape[0] and 0 <= cx < shape[1]):
        return np.zeros(shape, bool)
    y, x = np.ogrid[: shape[0], : shape[1]]
    return (x - cx) ** 2 + (y - cy) ** 2 <= r * r


def right_strip(shape: tuple[int, int], x0: int) -> np.ndarray:
    return np.broadcast_to(np.arange(shape[1]) >= x0, shape).copy()


def _shifted(mask: np.ndarray, dy: int, dx: int, fill=False) -> np.ndarray:
    out = np.full_like(mask, fill)
    h, w = mask.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Binary dilation by a square."""
    out = mask.copy()
    for d in range(1, radius + 1):
        out |= _shifted(mask, d, 0) | _shifted(mask, -d, 0)
    rows = out.copy()
    for d in range(1, radius + 1):
        out |= _shifted(rows, 0, d) | _shifted(rows, 0, -d)
    return out


def dilate_cross(mask: np.ndarray, times: int) -> np.ndarray:
    """Binary dilation by a cross, ``times`` times."""
    for _ in range(times):
        mask = mask | _shifted(mask, 1, 0) | _shifted(mask, -1, 0) | _shifted(mask, 0, 1) | _shifted(mask, 0, -1)
    return mask


def close(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    """Morphological closing by a rectangle."""
    grow = mask.copy()
    for d in range(1, width // 2 + 1):
        grow |= _shifted(mask, 0, d) | _shifted(mask, 0, -d)
    tall = grow.copy()
    for d in range(1, height // 2 + 1):
        tall |= _shifted(grow, d, 0) | _shifted(grow, -d, 0)
    shrink = tall.copy()
    for d in range(1, width // 2 + 1):
        shrink &= _shifted(tall, 0, d, True) & _shifted(tall, 0, -d, True)
    out = shrink.copy()
    for d in range(1, height // 2 + 1):
        out &= _shifted(shrink, d, 0, True) & _shifted(shrink, -d, 0, True)
    return out


def components(mask: np.ndarray, min_area: int = 0) -> tuple[np.ndarray, list[dict]]:
    """4-connected components, by union of runs: labels (from 1) and per component bbox (x0, y0, x1, y1), area, aspect."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edge == 1)
    _, ends = np.nonzero(edge == -1)
    parent = list(range(len(rows)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first = np.searchsorted(rows, np.arange(h + 1))
    for y in range(1, h):
        a, b = first[y - 1], first[y]
        while a < first[y] and b < first[y + 1]:
            if starts[a] < ends[b] and starts[b] < ends[a]:
                x, z = find(a), find(b)
                parent[max(x, z)] = min(x, z)
            if ends[a] < ends[b]:
                a += 1
            else:
                b += 1
    labels, found, number = np.zeros((h, w), np.int32), [], {}
    groups: dict[int, list[int]] = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    for root, members in sorted(groups.items()):
        area = int(sum(ends[k] - starts[k] for k in members))
        if area < min_area:
            continue
        number[root] = len(number) + 1
        for k in members:
            labels[rows[k], starts[k] : ends[k]] = number[root]
        box = [int(min(starts[k] for k in members)), int(rows[members].min()), int(max(ends[k] for k in members)), int(rows[members].max()) + 1]
        found.append({"label": number[root], "bbox": box, "area": area, "aspect": (box[2] - box[0]) / (box[3] - box[1])})
    return labels, found


def agreement_mask(bands: list[np.ndarray], share: float = 0.6, tolerance: float = 12, grow: int = 2, min_area: int = 30) -> tuple[np.ndarray, dict]:
    """Pixels that stay the same while the content scrolls: within the tolerance of the median in ``share`` of the bands."""
    if len(bands) < 4:
        shape = bands[0].shape[:2] if bands else (0, 0)
        return np.zeros(shape, bool), {"n_bands": len(bands), "skipped": True, "reason": "too few bands", "pixels_masked": 0, "n_components": 0}
    grey = np.stack([luma(b, "mean") for b in bands])
    same = np.abs(grey - np.median(grey, axis=0)) <= tolerance
    mask = dilate(same.mean(0) >= share, grow) if grow else same.mean(0) >= share
    labels, found = components(mask, min_area)
    mask = labels > 0
    return mask, {"n_bands": len(bands), "skipped": False, "pixels_masked": int(mask.sum()), "n_components": len(found), "components": found}


# ------------------------------------------------------------------------------------------- edges, circles


def _gradients(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(g.astype(np.float32), 1, mode="edge")
    dx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    dy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return dx, dy


def canny(grey: np.ndarray, low: float = 40, high: float = 120) -> np.ndarray:
    """Edges: Sobel gradients, thinning across the edge, and weak edges only where they touch strong ones."""
    dx, dy = _gradients(grey)
    size = np.abs(dx) + np.abs(dy)
    ax, ay = np.abs(dx), np.abs(dy)
    padded = np.pad(size, 1)
    at = lambda y, x: padded[1 + y : 1 + y + size.shape[0], 1 + x : 1 + x + size.shape[1]]
    flat, steep = ay <= 0.4142 * ax, ay >= 2.4142 * ax
    same = dx * dy > 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    thin = (size > before) & (size >= after)
    weak, strong = thin & (size > low), thin & (size > high)
    out, todo = strong.copy(), deque(zip(*np.nonzero(strong), strict=True))
    h, w = out.shape
    while todo:
        y, x = todo.popleft()
        for v in range(max(0, y - 1), min(h, y + 2)):
            for u in range(max(0, x - 1), min(w, x + 2)):
                if weak[v, u] and not out[v, u]:
                    out[v, u] = True
                    todo.append((v, u))
    return out


def row_extents(edges: np.ndarray, pair_dx: int = 6, exclude_from: int | None = None, reach: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Per row the rightmost and leftmost edge (-1: none).

    Columns from ``exclude_from`` on (16 from the right, if not given) don't count.  If the rightmost edge belongs to a
    pair (the next edge inside is more than ``pair_dx`` and at most ``reach`` away, of three edges or more), the inner one is taken.
    """
    width = edges.shape[1]
    stop = width - 16 if exclude_from is None else exclude_from
    right, left = np.full(len(edges), -1, np.int32), np.full(len(edges), -1, np.int32)
    for y, row in enumerate(edges):
        xs = np.flatnonzero(row[: max(0, stop)])
        if len(xs):
            right[y], left[y] = xs[-1], xs[0]
            if len(xs) >= 3:
                inner = xs[xs < xs[-1] - pair_dx]
                if len(inner) and xs[-1] - inner[-1] <= reach:
                    right[y] = inner[-1]
    return right, left


def median_blur(grey: np.ndarray, size: int = 5) -> np.ndarray:
    p = np.pad(grey, size // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size)), axis=(2, 3)).astype(grey.dtype)


def circles(grey: np.ndarray, r_min: int, r_max: int, min_dist: int = 60, high: float = 100, votes: int = 30, blur: int = 5) -> list[tuple[int, int, int]]:
    """Circles (cx, cy, r), strongest first: edge pixels vote along their gradient for centres, then centres for a radius."""
    g = median_blur(grey, blur) if blur else grey
    edges = canny(g, high / 2, high)
    dx, dy = _gradients(g)
    ys, xs = np.nonzero(edges)
    size = np.hypot(dx[ys, xs], dy[ys, xs])
    ok = size > 0
    ys, xs, size = ys[ok], xs[ok], size[ok]
    ux, uy = dx[ys, xs] / size, dy[ys, xs] / size
    h, w = grey.shape
    count = np.zeros((h, w), np.int32)
    for sign in (1, -1):
        for r in range(r_min, r_max + 1):
            cx, cy = np.rint(xs + sign * r * ux).astype(int), np.rint(ys + sign * r * uy).astype(int)
            inside = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            np.add.at(count, (cy[inside], cx[inside]), 1)
    near = sum(_shifted(count, y, x, 0) for y in (-1, 0, 1) for x in (-1, 0, 1))
    out: list[tuple[int, int, int]] = []
    cys, cxs = np.nonzero(near > votes)
    for k in np.argsort(-near[cys, cxs], kind="stable"):
        cx, cy = int(cxs[k]), int(cys[k])
        if any((cx - a) ** 2 + (cy - b) ** 2 < min_dist**2 for a, b, _ in out):
            continue
        radii = np.rint(np.hypot(xs - cx, ys - cy)).astype(int)
        hist = np.bincount(radii[(radii >= r_min) & (radii <= r_max)], minlength=r_max + 1)
        if hist.max(initial=0) > votes:
            out.append((cx, cy, int(hist.argmax())))
    return out


def circle_near(grey: np.ndarray, expected: tuple[int, int, int], slack_xy: int = 10, slack_r: int = 4, pad: int = 4) -> tuple[np.ndarray, dict]:
    """The circle closest to an expected one within the slack, looked for in its surroundings; its padded disc, or the
    expected one's if none is found (found: false)."""
    cx, cy, r = expected
    reach = r + slack_xy + pad + 4
    y0, x0 = max(0, cy - reach), max(0, cx - reach)
    part = grey[y0 : cy + reach + 1, x0 : cx + reach + 1]
    hits = [(x + x0, y + y0, q) for x, y, q in circles(part, max(1, r - slack_r), r + slack_r, min_dist=4, votes=max(8, r // 2))] if part.size else []
    hits = [c for c in hits if abs(c[0] - cx) <= slack_xy and abs(c[1] - cy) <= slack_xy and abs(c[2] - r) <= slack_r]
    best = min(hits, key=lambda c: np.hypot(c[0] - cx, c[1] - cy), default=None)
    x, y, q = best or expected
    return disc(grey.shape, x, y, q + pad), {"found": best is not None, "cx": x, "cy": y, "r": q}


# ------------------------------------------------------------------------------------------------- filling


def fill_rows(rgb: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Bad columns of each row take the nearest good pixel of that row, the left one of equals."""
    out = rgb.copy()
    for y in np.flatnonzero(bad.any(1)):
        good = np.flatnonzero(~bad[y])
        if len(good):
            xs = np.flatnonzero(bad[y])
            k = np.searchsorted(good, xs)
            left, right = good[np.maximum(k - 1, 0)], good[np.minimum(k, len(good) - 1)]
            take = np.where((k > 0) & ((k == len(good)) | (xs - left <= right - xs)), left, right)
            out[y, xs] = rgb[y, take]
    return out


def dense_columns(mask: np.ndarray, share: float = 0.9, widest: int = 50) -> list[tuple[int, int]]:
    """Stretches of columns (x0, x1) that the mask nearly fills, no wider than ``widest``: strips such as a scroll bar."""
    flag = np.diff(np.pad((mask.mean(0) > share).astype(np.int8), 1))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(flag == 1), np.flatnonzero(flag == -1), strict=True) if b - a <= widest]


def nearest_fill(rgb: np.ndarray, hole: np.ndarray) -> np.ndarray:
    """Hole pixels take the colour of the nearest other pixel, by a two-pass exact distance transform."""
    if not hole.any() or hole.all():
        return rgb.copy()
    h, w = hole.shape
    big = 10**6
    up, down = np.full((h, w), big), np.full((h, w), big)
    run = np.full(w, big)
    for y in range(h):
        run = np.where(hole[y], run + 1, 0)
        up[y] = run
    run = np.full(w, big)
    for y in range(h - 1, -1, -1):
        run = np.where(hole[y], run + 1, 0)
        down[y] = run
    dist, sign = np.minimum(up, down).astype(np.int64), np.where(up <= down, -1, 1)
    out, xs = rgb.copy(), np.arange(w)
    for y in np.flatnonzero(hole.any(1)):
        for x in np.flatnonzero(hole[y]):
            k = int(np.argmin((xs - x) ** 2 + np.minimum(dist[y], big) ** 2))
            out[y, x] = rgb[y + sign[y, k] * dist[y, k], k]
    return out


def diffuse_fill(rgb: np.ndarray, hole: np.ndarray, radius: int = 3) -> np.ndarray:
    """Hole pixels, from the rim inwards, take the distance-weighted mean of the known pixels within ``radius``."""
    out, todo = rgb.astype(np.float64), hole.copy()
    h, w = hole.shape
    while todo.any():
        rim = todo & dilate_cross(~todo, 1)
        if not rim.any():
            break
        known = ~todo
        for y, x in zip(*np.nonzero(rim), strict=True):
            ys, xs = slice(max(0, y - radius), min(h, y + radius + 1)), slice(max(0, x - radius), min(w, x + radius + 1))
            v, u = np.nonzero(known[ys, xs])
            far = (v + ys.start - y) ** 2 + (u + xs.start - x) ** 2
            near = far <= radius * radius
            weight = 1 / far[near]
            out[y, x] = (out[ys, xs][v[near], u[near]] * (weight[:, None] if out.ndim == 3 else weight)).sum(0) / weight.sum() if near.any() else out[y, x]
        todo = todo & ~rim
    return np.rint(out).astype(rgb.dtype)


def grow_holes(rgba: np.ndarray, times: int = 2) -> np.ndarray:
    """Pixels beside transparent ones become transparent (and black) too, ``times`` rings."""
    out = rgba.copy()
    out[dilate_cross(out[:, :, 3] == 0, times)] = 0
    return out


def background(rgb: np.ndarray) -> tuple[int, int, int]:
    """The commonest colour, the smallest packed value of equals."""
    flat = rgb.reshape(-1, rgb.shape[-1])[:, :3].astype(np.uint32)
    values, counts = np.unique(flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2], return_counts=True)
    c = int(values[counts.argmax()])
    return c >> 16, c >> 8 & 255, c & 255


def pool_max(values: np.ndarray, radius: int) -> np.ndarray:
    """Largest value within ``radius`` rows (rows beyond the ends repeat the last)."""
    p = np.pad(values, radius, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(p, 2 * radius + 1).max(1)


def clear_beyond(rgb: np.ndarray, right: np.ndarray, left: np.ndarray, bg: tuple[int, int, int], radius: int = 30, inset: int = 1, pad: int = 0, rim: int = 16) -> np.ndarray:
    """Pixels right of each row's pooled extent, and left of its own, become background."""
    out, w = rgb.copy(), rgb.shape[1]
    r = pool_max(np.minimum(right, w - rim), radius) if len(right) else right
    for y in range(len(rgb)):
        if r[y] >= 0:
            out[y, min(w, max(0, r[y] + 1 + pad - inset)) :, :3] = bg
        if 0 < left[y] < w:
            out[y, : max(0, left[y] - pad), :3] = bg
    return out


def soften_edge(rgb: np.ndarray, right: np.ndarray, bg: tuple[int, int, int], ratios: tuple[float, ...] = (0.7, 0.2, 0.01), gap: float = 30) -> np.ndarray:
    """A synthetic soft edge beyond each row's extent: the last inner colour fades into the background."""
    out, w, back = rgb.copy(), rgb.shape[1], np.array(bg, np.float64)
    for y in np.flatnonzero((right >= 1) & (right < w)):
        inner = rgb[y, right[y] - 1, :3].astype(np.float64)
        if abs(float(luma(inner[None, None])[0, 0]) - float(luma(back[None, None])[0, 0])) >= gap:
            for k, ratio in enumerate(ratios):
                if right[y] + k < w:
                    out[y, right[y] + k, :3] = (inner * ratio + back * (1 - ratio)).astype(np.uint8)
    return out


def fix_seams(rgb: np.ndarray, same: int = 18, differs: int = 36, pad: int = 6, times: int = 2) -> np.ndarray:
    """Pixels of a row that differ from equal rows above and below take their mean; repeated while that changes something."""
    out = rgb.copy()
    for _ in range(times):
        up, now, down = (out[k : len(out) - 2 + k, :, :3].astype(np.int16) for k in range(3))
        bad = (np.abs(up - down).max(2) <= same) & (np.minimum(np.abs(now - up).max(2), np.abs(now - down).max(2)) >= differs)
        if pad:
            bad[:, :pad] = bad[:, -pad:] = False
        if not bad.any():
            break
        y, x = np.nonzero(bad)
        out[y + 1, x, :3] = ((up + down) // 2)[y, x].astype(np.uint8)
    return out


def overwrite_rim(rgb: np.ndarray, pixels: int, bg: tuple[int, int, int]) -> np.ndarray:
    out = rgb.copy()
    if pixels > 0:
        out[:, -pixels:, :3] = bg
    return out


def draw_circle(rgb: np.ndarray, cx: int, cy: int, r: int, colour: tuple[int, int, int] = (255, 0, 0)) -> np.ndarray:
    out = rgb.copy()
    ring = disc(rgb.shape[:2], cx, cy, r + 1) & ~disc(rgb.shape[:2], cx, cy, r - 1)
    out[ring, :3] = colour
    return out


def find_disc(rgb: np.ndarray, top: int, bottom: int, least: int = 1000) -> dict | None:
    """The largest dark grey area of the band top..bottom: its component, in the frame's rows."""
    part = rgb[top:bottom].astype(np.int16)
    y = luma(rgb[top:bottom])
    _, found = components((y > 30) & (y < 120) & (part.max(2) - part.min(2) < 25), least)
    best = max(found, key=lambda c: c["area"], default=None)
    if best:
        x0, y0, x1, y1 = best["bbox"]
        best = best | {"bbox": [x0, y0 + top, x1, y1 + top]}
    return best


def find_scrollbar(rgb: np.ndarray, top: int, bottom: int, margin: int = 30) -> tuple[int, int] | None:
    """Columns (x0, x1) of bright stretches near the right rim, at least 50 rows and a quarter of the height."""
    bright = (luma(rgb[top:bottom]) > 90).sum(0)
    xs = np.flatnonzero((np.arange(rgb.shape[1]) >= rgb.shape[1] - margin) & (bright > 0.25 * (bottom - top)))
    return (int(xs[0]), int(xs[-1]) + 1) if len(xs) and bright[xs].max() >= 50 else None


# ----------------------------------------------------------------------------------------------------- PNG


def png(pixels: np.ndarray, level: int = 4) -> bytes:
    """PNG file of a grey, RGB or RGBA uint8 array."""
    kind = {2: 0, 3: 2, 4: 6}[pixels.ndim if pixels.ndim == 2 else pixels.shape[2]]
    h, w = pixels.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], 1).tobytes()
    block = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + block(b"IDAT", zlib.compress(raw, level)) + block(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit, non-interlaced PNG file (grey, RGB or RGBA)."""
    at, body, shape = 8, b"", None
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", part)
            if depth != 8 or lace or kind not in (0, 2, 6):
                raise ValueError("only 8-bit grey, RGB and RGBA files without interlacing")
            shape = (h, w, {0: 1, 2: 3, 6: 4}[kind])
        elif name == b"IDAT":
            body += part
        at += 12 + size
    h, w, n = shape
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.int32)
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 2:
            row = row + above & 255
        elif kind:
            row = row.tolist()
            for k in range(w * n):
                a = row[k - n] if k >= n else 0
                b, c = int(above[k]), int(above[k - n]) if k >= n else 0
                if kind == 1:
                    add = a
                elif kind == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    add = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[k] = row[k] + add & 255
            row = np.array(row, np.int32)
        out[y], above = row, row
    return out.reshape(h, w, n)[:, :, 0] if n == 1 else out.reshape(h, w, n)

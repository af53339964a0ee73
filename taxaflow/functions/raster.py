"""Image arithmetic in numpy: thresholds, morphology, components, contours, splits.

All functions take 8-bit arrays, grey (h, w) or RGB (h, w, 3), and are pure; the
operators call them inside Arrow batches. Where several definitions are in use
(edge tracking, contour area, resampling) the one chosen is stated here, and
tests hold it against small worked images.
"""

from __future__ import annotations

import heapq

import numpy as np


def grey(img: np.ndarray) -> np.ndarray:
    """Luma of an RGB(A) image; a grey image as it is; other depths stretched to 0..255."""
    a = img
    if a.ndim == 3 and a.shape[2] == 1:
        a = a[..., 0]
    if a.ndim == 3:
        a = a[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])
        if img.dtype == np.uint8:
            return np.floor(a + 0.5).astype(np.uint8)
    if a.dtype == np.uint8:
        return a
    a = a.astype(np.float64)
    lo, hi = a.min(), a.max()
    return np.zeros(a.shape, np.uint8) if hi == lo else ((a - lo) * (255 / (hi - lo))).astype(np.uint8)


def saturation(rgb: np.ndarray) -> np.ndarray:
    """HSV saturation in 0..255."""
    a = rgb[..., :3].astype(np.float64)
    top = a.max(2)
    return np.floor(np.where(top > 0, (top - a.min(2)) * 255 / np.maximum(top, 1), 0) + 0.5)


def otsu(g: np.ndarray) -> int:
    """The threshold with the largest variance between classes (values up to it are dark); the first of equals."""
    h = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    n, w = np.cumsum(h), np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (w[-1] * n / n[-1] - w) ** 2 / (n * (n[-1] - n))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1.0)))


def ink(g: np.ndarray) -> np.ndarray:
    """Mask of what is darker than the Otsu threshold or equal to it."""
    return g <= otsu(g)


def stretch(g: np.ndarray, low: float = 5.0, high: float = 95.0) -> np.ndarray:
    """Grey values between two percentiles stretched to 0..255."""
    a, b = np.percentile(g, [low, high])
    return np.clip((g - a) / max(b - a, 1) * 255, 0, 255).astype(np.uint8)


def ellipse(size: int) -> np.ndarray:
    """Elliptic structuring element of odd size: in each row, the half width of the circle, rounded."""
    r = size // 2
    out = np.zeros((size, size), bool)
    for i in range(size):
        d = i - r
        half = int(np.floor(np.sqrt(max(r * r - d * d, 0)) + 0.5))
        out[i, r - half : r + half + 1] = True
    return out


def _shift(m: np.ndarray, kernel: np.ndarray, grow: bool) -> np.ndarray:
    r = kernel.shape[0] // 2
    wide = np.pad(m, r, constant_values=not grow)
    h, w = m.shape
    out = np.full((h, w), not grow)
    for dy, dx in zip(*np.nonzero(kernel), strict=True):
        part = wide[dy : dy + h, dx : dx + w]
        out = out | part if grow else out & part
    return out


def dilate(m: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        m = _shift(m, kernel, True)
    return m


def erode(m: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        m = _shift(m, kernel, False)
    return m


def clean(m: np.ndarray) -> np.ndarray:
    """Closing (5 x 5, twice) to bridge gaps, then opening (3 x 3) to drop specks."""
    five, three = ellipse(5), ellipse(3)
    return dilate(erode(erode(dilate(m, five, 2), five, 2), three), three)


def components(m: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """(labels from 1, [(x, y, w, h, area)]) of the 8-connected components, in reading order."""
    h, w = m.shape
    parent: list[int] = []

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    runs, before = [], []
    for y in range(h):
        d = np.diff(np.concatenate(([0], m[y].astype(np.int8), [0])))
        now = []
        k = 0
        for s, e in zip(np.nonzero(d == 1)[0], np.nonzero(d == -1)[0], strict=True):
            a = len(parent)
            parent.append(a)
            while k < len(before) and before[k][1] < s:
                k += 1
            j = k
            while j < len(before) and before[j][0] <= e:
                ra, rb = find(a), find(before[j][2])
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                j += 1
            now.append((s, e, a))
            runs.append((y, s, e, a))
        before = now
    ids: dict[int, int] = {}
    labels = np.zeros((h, w), np.int32)
    boxes: list[list[int]] = []
    for y, s, e, a in runs:
        r = find(a)
        if r not in ids:
            ids[r] = len(ids) + 1
            boxes.append([s, y, e, y + 1, 0])
        b = boxes[ids[r] - 1]
        b[0], b[2], b[3], b[4] = min(b[0], s), max(b[2], e), y + 1, b[4] + e - s
        labels[y, s:e] = ids[r]
    return labels, [(int(b[0]), int(b[1]), int(b[2] - b[0]), int(b[3] - b[1]), int(b[4])) for b in boxes]


def outline(m: np.ndarray) -> np.ndarray:
    """Pixels (x, y) along the outer border of the one component in ``m``, clockwise."""
    ys, xs = np.nonzero(m)
    if not len(ys):
        return np.zeros((0, 2), int)
    wide = np.pad(m, 1)
    start = (int(ys[0]) + 1, int(xs[0]) + 1)
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    at, come, path = start, 4, [start]
    first = None
    while True:
        for k in range(1, 9):
            d = (come + k) % 8
            y, x = at[0] + around[d][0], at[1] + around[d][1]
            if wide[y, x]:
                break
        else:
            break
        step = (at, d)
        if first is None:
            first = step
        elif step == first:
            break
        at, come = (y, x), (d + 4) % 8
        path.append(at)
    return np.array([(x - 1, y - 1) for y, x in path])


def polygon_area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0].astype(float), p[:, 1].astype(float)
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def hull(p: np.ndarray) -> np.ndarray:
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return np.array(pts).reshape(-1, 2)

    def half(points):
        out: list[tuple] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def contours(m: np.ndarray) -> list[dict]:
    """Per component: box, area of the border polygon, area / hull area, longer / shorter side."""
    labels, boxes = components(m)
    out = []
    for i, (x, y, w, h, n) in enumerate(boxes, 1):
        p = outline(labels[y : y + h, x : x + w] == i)
        area = polygon_area(p)
        out.append({"x": x, "y": y, "w": w, "h": h, "pixels": n, "area": area, "solidity": area / max(polygon_area(hull(p)), 1), "aspect": max(w, h) / max(min(w, h), 1)})
    return out


def canny(g: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Edges: 3 x 3 Sobel, L1 magnitude, thinning across the gradient, hysteresis between two thresholds."""
    a = np.pad(g.astype(np.int32), 1, mode="edge")
    gx = a[:-2, 2:] + 2 * a[1:-1, 2:] + a[2:, 2:] - a[:-2, :-2] - 2 * a[1:-1, :-2] - a[2:, :-2]
    gy = a[2:, :-2] + 2 * a[2:, 1:-1] + a[2:, 2:] - a[:-2, :-2] - 2 * a[:-2, 1:-1] - a[:-2, 2:]
    mag = np.abs(gx) + np.abs(gy)
    p = np.pad(mag, 1)
    c = p[1:-1, 1:-1]
    flat, steep = np.abs(gy) * 2.414213562 < np.abs(gx), np.abs(gy) > np.abs(gx) * 2.414213562
    same = (gx >= 0) == (gy >= 0)
    keep = np.where(
        flat,
        (c > p[1:-1, :-2]) & (c >= p[1:-1, 2:]),
        np.where(steep, (c > p[:-2, 1:-1]) & (c >= p[2:, 1:-1]), np.where(same, (c > p[:-2, :-2]) & (c > p[2:, 2:]), (c > p[:-2, 2:]) & (c > p[2:, :-2]))),
    )
    weak = keep & (mag > lo)
    strong = weak & (mag > hi)
    labels, boxes = components(weak)
    hit = np.zeros(len(boxes) + 1, bool)
    hit[np.unique(labels[strong])] = True
    hit[0] = False
    return hit[labels]


def features(rgb: np.ndarray) -> dict:
    """The seven scalar features of an image."""
    if rgb.ndim == 2:
        rgb = np.repeat(rgb[..., None], 3, 2)
    g = grey(rgb)
    v = float(np.median(g))
    edges = canny(g, int(max(0, 0.66 * v)), int(min(255, 1.33 * v)))
    # a density over bins 8 values wide: its entropy has the bound (5 + 3) / 8
    hist = np.histogram(g, bins=32, range=(0, 256), density=True)[0] + 1e-12
    r, gr, b = (rgb[..., i].astype(np.float64) for i in range(3))
    return {
        "width": int(rgb.shape[1]),
        "height": int(rgb.shape[0]),
        "sat_mean": float(saturation(rgb).mean()),
        "white_bg_ratio": float((g > 240).mean()),
        "edge_density": float(edges.mean()),
        "hist_entropy": float(-(hist * np.log2(hist)).sum()),
        "blue_dominance": float(((b > r + 15) & (b > gr - 5) & (b > 80)).mean()),
    }


def blur3(g: np.ndarray) -> np.ndarray:
    """3 x 3 Gaussian (1 2 1), reflected at the border."""
    a = np.pad(g.astype(np.float64), 1, mode="reflect" if min(g.shape) > 1 else "edge")
    a = (a[:-2] + 2 * a[1:-1] + a[2:]) / 4
    a = (a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]) / 4
    return np.floor(a + 0.5).astype(np.uint8)


def clahe(g: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: clipped histograms per tile, mapped values interpolated between tiles."""
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    a = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) >= max(th * tiles - h, tw * tiles - w) else "edge")
    limit = max(int(clip * th * tw / 256), 1)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(a[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            if rest:
                n[:: max(256 // rest, 1)][:rest] += 1
            maps[i, j] = np.clip(np.floor(np.cumsum(n) * (255 / (th * tw)) + 0.5), 0, 255)
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda q: np.clip(q, 0, tiles - 1)
    pick = lambda yy, xx: maps[at(yy)[:, None], at(xx)[None], g]
    out = (pick(y0, x0) * (1 - fx) + pick(y0, x0 + 1) * fx) * (1 - fy) + (pick(y0 + 1, x0) * (1 - fx) + pick(y0 + 1, x0 + 1) * fx) * fy
    return np.floor(out + 0.5).astype(np.uint8)


def resize(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over the area of each new pixel."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        lo, hi = np.arange(n)[None], np.arange(1, n + 1)[None]
        part = np.clip(np.minimum(hi, edge[1:, None]) - np.maximum(lo, edge[:-1, None]), 0, None)
        return part / part.sum(1, keepdims=True)

    return np.floor(weights(g.shape[0], h) @ g.astype(np.float64) @ weights(g.shape[1], w).T + 0.5).astype(np.uint8)


def crop(g: np.ndarray, box: tuple[int, int, int, int], pad: float = 0.15, size: tuple[int, int] | None = None) -> np.ndarray:
    """The box with ``pad`` of its sides around it; if ``size`` is given, scaled into the middle of a white canvas."""
    x, y, w, h = box
    px, py = int(w * pad), int(h * pad)
    c = g[max(0, y - py) : min(g.shape[0], y + h + py), max(0, x - px) : min(g.shape[1], x + w + px)]
    if size is None:
        return c
    scale = min(size[1] / max(c.shape[1], 1), size[0] / max(c.shape[0], 1))
    nh, nw = max(int(c.shape[0] * scale), 1), max(int(c.shape[1] * scale), 1)
    canvas = np.full(size, 255, np.uint8)
    top, left = (size[0] - nh) // 2, (size[1] - nw) // 2
    canvas[top : top + nh, left : left + nw] = resize(c, nh, nw)
    return canvas


def merge_boxes(boxes: list[tuple[int, int, int, int]], near: int = 40) -> list[tuple[int, int, int, int]]:
    """Boxes joined while one, widened by ``near``, overlaps another; a hull may take in further boxes.

    Each pass moves the boxes one by one into a list, where each is joined to the
    first box it reaches; passes go on until one joins none.
    """
    rects = [(x, y, x + w, y + h) for x, y, w, h in boxes]
    while True:
        out: list[tuple[int, int, int, int]] = []
        for r in rects:
            for i, q in enumerate(out):
                if r[0] - near < q[2] and r[2] + near > q[0] and r[1] - near < q[3] and r[3] + near > q[1]:
                    out[i] = (min(r[0], q[0]), min(r[1], q[1]), max(r[2], q[2]), max(r[3], q[3]))
                    break
            else:
                out.append(r)
        if len(out) == len(rects):
            return [(a, b, c - a, d - b) for a, b, c, d in out]
        rects = out


def gap_centres(profile: np.ndarray, threshold: float, least: int = 8) -> list[int]:
    """Middles of the runs of at least ``least`` values not above the threshold."""
    d = np.diff(np.concatenate(([0], (np.asarray(profile) <= threshold).astype(np.int8), [0])))
    return [int(s + (e - s) // 2) for s, e in zip(np.nonzero(d == 1)[0], np.nonzero(d == -1)[0], strict=True) if e - s >= least]


def distances(m: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest one outside the mask, exact, by two passes of minima."""
    h, w = m.shape
    far = float(h + w)
    up = np.where(m, far, 0.0)
    for y in range(1, h):
        up[y] = np.minimum(up[y], up[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        up[y] = np.minimum(up[y], up[y + 1] + 1)
    sq, out = up**2, np.full((h, w), far * far)
    for s in range(w):
        if s * s >= out.max():
            break
        out[:, s:] = np.minimum(out[:, s:], sq[:, : w - s] + s * s)
        if s:
            out[:, :-s] = np.minimum(out[:, :-s], sq[:, s:] + s * s)
    return np.sqrt(out)


def flood(markers: np.ndarray, height: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Watershed: markers grow over ``where`` in the order of ``height``."""
    out = markers.copy()
    h, w = out.shape
    queue, n = [], 0
    for y, x in zip(*np.nonzero(markers), strict=True):
        queue.append((float(height[y, x]), n, int(y), int(x)))
        n += 1
    heapq.heapify(queue)
    while queue:
        _, _, y, x = heapq.heappop(queue)
        for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= v < h and 0 <= u < w and where[v, u] and not out[v, u]:
                out[v, u] = out[y, x]
                heapq.heappush(queue, (float(height[v, u]), n, v, u))
                n += 1
    return out


def _bounds(m: np.ndarray) -> tuple[int, int, int, int] | None:
    ys, xs = np.nonzero(m)
    return None if not len(ys) else (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1)


def watershed_split(mask: np.ndarray, share: float = 0.25, least: int = 300, side: int = 40) -> list[tuple[int, int, int, int]]:
    """Boxes of the parts that grow from the deepest regions of a mask; [] if there is one region only."""
    b = _bounds(mask)
    if b is None:
        return []
    m = mask[b[1] : b[3], b[0] : b[2]]
    dist = distances(np.pad(m, 1))[1:-1, 1:-1]
    if dist.max() < 2:
        return []
    five = ellipse(5)
    core = dist > max(dist.max() * share, 2.0)
    labels, parts = components(dilate(erode(core, five), five))
    keep = [i for i, p in enumerate(parts, 1) if p[4] >= least]
    if len(keep) < 2:
        return []
    markers = np.zeros_like(labels)
    for k, i in enumerate(keep, 1):
        markers[labels == i] = k
    grown = flood(markers, -dist, m)
    out = []
    for k in range(1, len(keep) + 1):
        part = grown == k
        q = _bounds(part)
        if q and part.sum() >= least and q[2] - q[0] > side and q[3] - q[1] > side:
            out.append((q[0] + b[0], q[1] + b[1], q[2] - q[0] - 1, q[3] - q[1] - 1))
    return out


def grid_split(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of the cells between empty rows and columns of a mask; [] if there are no such gaps."""
    b = _bounds(mask)
    if b is None:
        return []
    m = mask[b[1] : b[3], b[0] : b[2]]
    h, w = m.shape
    if min(h, w) < 100:
        return []
    k = max(5, int(min(w, h) * 0.015)) | 1
    cuts = []
    for axis in (0, 1):
        p = np.convolve(m.sum(axis).astype(float), np.ones(k) / k, mode="same")
        cuts.append(gap_centres(p, max(p.max() * 0.05, 1), max(8, int(min(w, h) * 0.01))))
    if not cuts[0] and not cuts[1]:
        return []
    xs, ys = [0, *cuts[0], w], [0, *cuts[1], h]
    out = []
    for y0, y1 in zip(ys, ys[1:], strict=False):
        for x0, x1 in zip(xs, xs[1:], strict=False):
            cell = m[y0:y1, x0:x1]
            if cell.sum() < max(1500, int(h * w * 0.001)) or min(cell.shape) < 50:
                continue
            q = _bounds(cell)
            if q[2] - q[0] > 50 and q[3] - q[1] > 50:
                out.append((q[0] + x0 + b[0], q[1] + y0 + b[1], q[2] - q[0] - 1, q[3] - q[1] - 1))
    return out


def figures(img: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of the single drawings on a plate.

    Ink by Otsu (inverted if it covers more than half); specks and letter-sized
    parts are dropped by a size estimated from the page width; parts that fill
    the plate, or are far larger than the median, are split by watershed, else
    by the grid; near boxes are merged; boxes that are small, page-wide or
    stretched are dropped.
    """
    g = grey(img)
    h, w = g.shape
    char = max(w / 8.5, h / 11.7, 72) * 14 / 72
    m = ink(g)
    if m.mean() > 0.5:
        m = ~m
    labels, parts = components(m)
    keep = np.zeros(len(parts) + 1, bool)
    side = int(char * 3.5)
    for i, (_, _, cw, ch, n) in enumerate(parts, 1):
        text = n < int(side * side * 0.8) and max(cw, ch) < side and max(cw, ch) / max(min(cw, ch), 1) < 5 and n / max(cw * ch, 1) > 0.2
        keep[i] = n >= max(80, int(char * 2)) and not text
    m = keep[labels]
    labels, parts = components(m)
    area, dim = int(char * char * 3), int(char * 2)
    sizes = [n for _, _, cw, ch, n in parts if n > area and cw > dim and ch > dim]
    if not sizes:
        return []
    middle, boxes = float(np.median(sizes)), []
    for i, (x, y, cw, ch, n) in enumerate(parts, 1):
        if n < area or cw < dim or ch < dim:
            continue
        plate = cw > w * 0.6 and ch > h * 0.6
        split: list[tuple[int, int, int, int]] = []
        if plate or (n > middle * 4 and (cw > w * 0.3 or ch > h * 0.3)):
            split = watershed_split(labels == i) or (grid_split(labels == i) if plate else [])
        boxes += split or [(x, y, cw, ch)]
    return [b for b in merge_boxes(boxes) if good_box(b, w, h)]


def good_box(b: tuple[int, int, int, int], w: int, h: int) -> bool:
    return b[2] >= 60 and b[3] >= 60 and b[2] * b[3] >= 5000 and not (b[2] > w * 0.85 and b[3] > h * 0.85) and 0.12 <= b[2] / max(b[3], 1) <= 8

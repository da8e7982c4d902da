"""Rectangle detectors on grey rasters and the choice among what they find, in NumPy.

Four detectors propose boxes: outermost brightness transitions, bright and dark regions, regions against the local mean,
and outermost straight edges. They use plain array operations (running extremes for morphology, run-wise labelling for
regions, gradient projections for lines), so they agree with image libraries on clear rectangles but not pixel by pixel.
Proposals are scored by geometry, near ones are folded into the best of them, and evidence along the box decides."""

from __future__ import annotations

import numpy as np

from gristmill.functions import raster

# Smallest region and box, share of a peak that counts, and weights of the confidence.
LEAST_AREA, LEAST_SIDE, PEAK_SHARE, MERGE_SHARE = 0.05, 50, 0.3, 0.05
EVIDENCE = {"edge": 0.50, "interior": 0.20, "exterior": 0.15}


def _running(mask: np.ndarray, size: int, largest: bool) -> np.ndarray:
    """Extremes over size x size squares, by counting along each axis."""
    half = size // 2
    for axis in (0, 1):
        x = np.moveaxis(mask, axis, 0).astype(np.int32)
        total = np.concatenate([np.zeros((1, x.shape[1]), np.int32), np.cumsum(x, 0)])
        i = np.arange(len(x))
        lo, hi = np.maximum(0, i - half), np.minimum(len(x), i + half + 1)
        n = total[hi] - total[lo]
        mask = np.moveaxis(n > 0 if largest else n == (hi - lo)[:, None], 0, axis)
    return mask


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    return _running(_running(mask, size, True), size, False)


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    return _running(_running(mask, size, False), size, True)


def regions(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x, y, width, height and pixels of each 4-connected region, from runs of pixels joined row by row."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        a, b = first[y - 1], first[y]
        while a < first[y] and b < first[y + 1]:
            if start[a] < stop[b] and start[b] < stop[a]:
                i, j = sorted((find(a), find(b)))
                root[j] = i
            if stop[a] < stop[b]:
                a += 1
            else:
                b += 1
    label = np.array([find(i) for i in range(len(row))], int)
    return [(int(start[m].min()), int(row[m].min()), int(stop[m].max() - start[m].min()), int(row[m].max() - row[m].min() + 1), int((stop[m] - start[m]).sum())) for m in (label == k for k in np.unique(label))]


def transitions(gray: np.ndarray) -> list[tuple[int, int, int, int]]:
    """From the first to the last strong step of the rows' and of the columns' means."""
    found = []
    for profile in (gray.mean(0), gray.mean(1)):
        step = np.abs(np.diff(profile))
        strong = np.flatnonzero(step > PEAK_SHARE * step.max(initial=0))
        if len(strong) < 2:
            return []
        found.append((int(strong[0]), int(strong[-1]) + 1))
    (l, r), (t, b) = found
    return [(l, t, r - l, b - t)]


def _large(mask: np.ndarray, fill: float = 0.0) -> list[tuple[int, int, int, int]]:
    return [(x, y, w, h) for x, y, w, h, n in regions(mask) if n >= LEAST_AREA * mask.size and w >= LEAST_SIDE and h >= LEAST_SIDE and n >= fill * w * h]


def bright_regions(gray: np.ndarray) -> list[tuple[int, int, int, int]]:
    bright = gray > raster.otsu(gray)
    return [b for m in (bright, ~bright) for b in _large(closed(m, 43))]


def local_regions(gray: np.ndarray, window: int = 51, offset: float = 10.0) -> list[tuple[int, int, int, int]]:
    """Nearly full rectangles brighter than the mean around them less an offset."""
    total = np.pad(np.cumsum(np.cumsum(gray.astype(float), 0), 1), ((1, 0), (1, 0)))
    at = lambda n: (np.maximum(0, np.arange(n) - window // 2), np.minimum(n, np.arange(n) + window // 2 + 1))
    (t, b), (l, r) = at(gray.shape[0]), at(gray.shape[1])
    area = (b - t)[:, None] * (r - l)[None]
    mean = (total[b][:, r] - total[t][:, r] - total[b][:, l] + total[t][:, l]) / area
    return _large(opened(closed(gray > mean - offset, 19), 7), 0.85)


def outer_lines(gray: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Between the outermost rows and columns along which at least a quarter of the pixels are steps."""
    g = gray.astype(float)
    found = []
    for axis in (1, 0):
        step = np.abs(np.diff(g, axis=axis))
        share = (step > max(15.0, 0.5 * float(np.percentile(step, 99.5)))).mean(1 - axis)
        lines = np.flatnonzero(share >= 0.25)
        if len(lines) < 2:
            return []
        found.append((int(lines[0]) + 1, int(lines[-1]) + 1))
    (l, r), (t, b) = found
    return [(l, t, r - l, b - t)] if r > l and b > t else []


DETECTORS = {"transitions": transitions, "bright_regions": bright_regions, "local_regions": local_regions, "outer_lines": outer_lines}


def geometry_score(box: tuple[int, int, int, int], shape: tuple[int, int], target: float) -> tuple[float, float, str]:
    """Score, deviation and orientation, as operators.consensus.candidate_score has them for columns."""
    (x, y, w, h), (rows, cols) = box, shape
    wide, tall = abs(w / h - target) / target, abs(w / h - 1 / target) * target
    off, area = min(wide, tall), w * h / (rows * cols)
    score = next(s for limit, s in ((0.05, 1.0), (0.15, 0.90), (0.30, 0.65), (np.inf, 0.3)) if off < limit)
    if off < 0.10:
        score *= 1.0 if 0.20 < area < 0.99 else 0.85 if area >= 0.99 else 0.75
    else:
        score *= 1.0 if 0.30 < area < 0.92 else 0.75 if 0.15 < area < 0.95 else 0.4
    free = min(x, cols - x - w) > 0.01 * cols and min(y, rows - y - h) > 0.01 * rows
    score *= 1.0 if free else 0.90 if off < 0.10 and area > 0.90 else 0.8
    return round(min(1.0, score), 3), off, "Landscape" if wide <= tall else "Portrait"


def candidates(gray: np.ndarray, target: float = 1.5, penalty: bool = True) -> list[dict]:
    """Scored proposals, near ones folded into the best, each with its confidence; best first. Without the penalty a shape
    that deviates from the target costs no confidence beyond its score."""
    boxes = [(name, box) for name, f in DETECTORS.items() for box in f(gray) if box[2] >= LEAST_SIDE and box[3] >= LEAST_SIDE]
    scored = sorted(((geometry_score(b, gray.shape, target), name, b) for name, b in boxes), key=lambda s: (-s[0][0], s[1], s[2]))
    within = MERGE_SHARE * max(gray.shape)
    kept: list[dict] = []
    for (score, off, way), name, b in scored:
        near = next((k for k in kept if all(abs(p - q) < within for p, q in zip(k["box"], b, strict=True))), None)
        if near:
            near["methods"].append(name)
            continue
        kept.append({"box": b, "geometry": score, "deviation": off, "orientation": way, "methods": [name]})
    for k in kept:
        seen = raster.edge_evidence(gray, *k["box"])
        evidence = sum(weight * seen[part] for part, weight in EVIDENCE.items())
        k["confidence"] = round((0.35 * k["geometry"] + 0.65 * evidence) * (max(0.7, 1 - 3 * k["deviation"]) if penalty else 1.0), 3)
    return sorted(kept, key=lambda k: (-round(k["confidence"], 2), -k["box"][2] * k["box"][3] - 0.001 * (k["orientation"] == "Landscape"), k["box"]))


def best_box(gray: np.ndarray, target: float = 1.5, penalty: bool = True) -> dict | None:
    """The best candidate in the raster's own pixels, found on a reduced one; None if nothing is found."""
    small, scale = raster.detection_size(gray)
    found = candidates(small, target, penalty)
    return found[0] | {"box": tuple(int(round(v / scale)) for v in found[0]["box"])} if found else None

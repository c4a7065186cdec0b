"""Detection in images: edges, page boundary, line angles and alignment by landmarks. NumPy kernels over gray arrays (uint8, H x W).

All are deterministic. An image without what is looked for gives the fallback that the caller names: the whole frame,
no angles, or a plain resize.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from docustrata.operators import images

# Thresholds of edges, share of the frame and largest contours looked at, tolerance of a corner, of a boundary.
LOW, HIGH, SHARE, LARGEST, CORNER = 50, 150, 0.50, 5, 0.02
# Votes of a line, least share of the width, gap, largest angle.
VOTES, LENGTH, GAP, ANGLE = 100, 0.3, 10, 15.0
# Corners of an image, matches that count, matches needed, pixels of an inlier, determinants of a sound map.
CORNERS, MATCHES, ENOUGH, NEAR, DETERMINANT = 1000, 20, 6, 5.0, (0.01, 100.0)


def gradients(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(g.astype("int32"), 1, mode="edge")
    across = lambda a: a[:, 2:] - a[:, :-2]
    dx = across(p[:-2]) + 2 * across(p[1:-1]) + across(p[2:])
    down = p[2:] - p[:-2]
    return dx, down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def edges(g: np.ndarray, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """Ridges of the gradient that are over high, or over low and connected to such."""
    dx, dy = gradients(g)
    size = np.abs(dx) + np.abs(dy)
    p = np.pad(size, 1)
    at = lambda y, x: p[1 + y : 1 + y + g.shape[0], 1 + x : 1 + x + g.shape[1]]
    flat, steep = np.abs(dy) < 0.41421356 * np.abs(dx), np.abs(dy) > 2.41421356 * np.abs(dx)
    same = (dx < 0) == (dy < 0)
    ridge = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(same, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))))
    weak = ridge & (size > low)
    number, _ = components(weak)
    strong = np.unique(number[weak & (size > high)])
    return np.isin(number, strong[strong > 0])


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each pixel's 8-connected part (0: none), and per part top, left, bottom, right (the last two beyond it)."""
    h, w = mask.shape
    step = np.diff(np.pad(mask.astype("int8"), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    up = np.arange(len(row))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if begin[i] <= end[j] and begin[j] <= end[i]:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))], dtype="int64")
    names, part = np.unique(roots, return_inverse=True)
    out = np.zeros(h * w + 1, dtype="int32")
    np.add.at(out, row * w + begin, part + 1)
    np.subtract.at(out, row * w + end, part + 1)  # a run that ends a row hands its end to the next one's first pixel, where it cancels
    number = np.cumsum(out[:-1], dtype="int32").reshape(h, w)
    box = np.zeros((len(names), 4), dtype="int64")
    if len(names):
        box[:, 0], box[:, 1] = h, w
        np.minimum.at(box[:, 0], part, row)
        np.minimum.at(box[:, 1], part, begin)
        np.maximum.at(box[:, 2], part, row + 1)
        np.maximum.at(box[:, 3], part, end)
    return number, box


#: The eight neighbours, clockwise from the left one: (down, right).
AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def outline(part: np.ndarray) -> np.ndarray:
    """The outer border (x, y) of a connected part of a mask, clockwise from its topmost leftmost pixel."""
    p = np.pad(part, 1)
    y, x = (int(v) for v in np.argwhere(p)[0])
    start, way, out, opening = (y, x), 0, [(x - 1, y - 1)], None
    while True:
        for k in range(8):
            d = (way + k) % 8
            ny, nx = y + AROUND[d][0], x + AROUND[d][1]
            if p[ny, nx]:
                break
        else:
            return np.array(out)  # one pixel
        if (y, x) == start:
            if opening is None:
                opening = d
            elif d == opening:
                return np.array(out[:-1])
        y, x, way = ny, nx, (d + 5) % 8 if d % 2 else (d + 6) % 8
        out.append((x - 1, y - 1))


def area(p: np.ndarray) -> float:
    x, y = p[:, 0].astype(float), p[:, 1].astype(float)
    return 0.5 * abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """The corners of a closed line from which no point of it is farther than tolerance."""
    p = p.astype(float)
    far = lambda q: int(((p - q) ** 2).sum(1).argmax())
    a = far(p[far(p[0])])
    p = np.roll(p, -a, axis=0)
    b, closed = far(p[0]), np.concatenate([p, p[:1]])
    keep, todo = {0, b}, [(0, b), (b, len(p))]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        u, q = closed[j] - closed[i], closed[i + 1 : j] - closed[i]
        apart = np.abs(u[0] * q[:, 1] - u[1] * q[:, 0]) / (np.hypot(*u) or 1.0)
        if apart.max() > tolerance:
            k = i + 1 + int(apart.argmax())
            keep.add(k)
            todo += [(i, k), (k, j)]
    out = p[sorted(keep)]
    while len(out) > 3:  # a first point on a straight side is no corner
        u, v = np.roll(out, 1, axis=0), np.roll(out, -1, axis=0)
        side = v - u
        apart = np.abs(side[:, 0] * (out - u)[:, 1] - side[:, 1] * (out - u)[:, 0]) / np.maximum(np.hypot(side[:, 0], side[:, 1]), 1e-9)
        if apart.min() > tolerance:
            break
        out = np.delete(out, int(apart.argmin()), axis=0)
    return out


def contours(mask: np.ndarray, least: float, most: int = LARGEST) -> list[np.ndarray]:
    """The outer borders of the largest parts of a mask, by area, of least or more each."""
    number, box = components(mask)
    room = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    found = []
    for k in np.flatnonzero(room >= least):
        y0, x0, y1, x1 = box[k]
        found.append(outline(number[y0:y1, x0:x1] == k + 1) + np.array([x0, y0]))
    found.sort(key=area, reverse=True)
    return [p for p in found[:most] if area(p) >= least]


def boundary(a: np.ndarray) -> dict:
    """The page in a photo: corners, confidence, detected, method. The first of the largest contours that is a convex
    quadrangle of half the frame and a card's shape, else the whole frame."""
    g = images.gray(a)
    h, w = g.shape
    soft = images.clip(images.gaussian(g, 1.1, 5))
    mask = images.extreme(images.extreme((edges(soft) * 255).astype("uint8"), 3, np.max), 3, np.max) > 0
    for p in contours(mask, SHARE * h * w):
        around = np.hypot(*(np.roll(p, -1, axis=0) - p).T).sum()
        corners = simplified(p, CORNER * around)
        if len(corners) == 4 and images.convex(corners):
            found = images.accept_quad(corners, h, w)
            if found["detected"]:
                return found | {"confidence": min(0.95, area(p) / (h * w) + 0.1)}
    return images.accept_quad(np.empty((0, 2)), h, w)


def line_angles(a: np.ndarray) -> list[float]:
    """Degrees of straight lines within ANGLE of the horizontal, the strongest first; each takes its pixels with it."""
    g = images.gray(a)
    least = max(10, int(g.shape[1] * LENGTH))
    y, x = (v.astype(float) for v in np.nonzero(edges(g)))
    degrees = np.arange(-ANGLE, ANGLE + 0.125, 0.25)
    sin, cos = np.sin(np.deg2rad(degrees)), np.cos(np.deg2rad(degrees))
    low = -int(np.ceil(g.shape[1] * sin.max())) - 1
    many = int(np.ceil(g.shape[0] + 2 * g.shape[1] * sin.max())) + 3
    place = lambda yy, xx: np.rint(yy[:, None] * cos - xx[:, None] * sin).astype("int64") - low
    free, at = np.ones(len(y), dtype=bool), place(y, x)
    held = np.stack([np.bincount(at[:, k], minlength=many) for k in range(len(degrees))]) if len(y) else np.zeros((len(degrees), 1), dtype="int64")
    out = []
    while held.max() >= VOTES:
        k, r = np.unravel_index(int(held.argmax()), held.shape)
        on = np.flatnonzero(free & (np.abs(at[:, k] - r) <= 1))
        on = on[np.argsort(x[on], kind="stable")]
        cuts = np.flatnonzero(np.diff(x[on]) > GAP) + 1
        runs = [run for run in np.split(on, cuts) if len(run)]
        best = max(runs, key=lambda run: x[run[-1]] - x[run[0]])
        if x[best[-1]] - x[best[0]] >= least:
            slope = np.polyfit(x[best], y[best], 1)[0]
            out.append(float(np.degrees(np.arctan(slope))))
        gone = best if x[best[-1]] - x[best[0]] >= least else on
        free[gone] = False
        for j in range(len(degrees)):
            held[j] -= np.bincount(at[gone, j], minlength=held.shape[1])[: held.shape[1]]
        held[k, r] = min(held[k, r], 0)
    return [t for t in out if abs(t) <= ANGLE]


def corners_of(g: np.ndarray, most: int = CORNERS, rim: int = 20) -> np.ndarray:
    """(x, y) of the strongest corners, none next to a stronger one."""
    dx, dy = (v.astype(float) for v in gradients(g))
    xx, yy, xy = (images.separable(v, images.gaussian_kernel(1.5)) for v in (dx * dx, dy * dy, dx * dy))
    score = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    local = score == np.lib.stride_tricks.sliding_window_view(np.pad(score, 3, mode="edge"), (7, 7)).max((2, 3))
    local[:rim], local[-rim:], local[:, :rim], local[:, -rim:] = False, False, False, False
    y, x = np.nonzero(local & (score > 0.001 * max(score.max(), 1e-9)))
    order = np.argsort(-score[y, x], kind="stable")[:most]
    return np.stack([x[order], y[order]], axis=1)


def descriptors(g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """256 comparisons of brightness around each corner, turned to its centre of mass."""
    soft = images.separable(g, images.gaussian_kernel(2.0))
    yy, xx = np.mgrid[-15:16, -15:16]
    disc = (xx * xx + yy * yy <= 225).astype(float)
    patch = np.stack([soft[y - 15 : y + 16, x - 15 : x + 16] for x, y in p]) * disc
    turn = np.arctan2((patch * yy).sum((1, 2)), (patch * xx).sum((1, 2)))
    pairs = np.clip(np.random.default_rng(20240229).normal(0, 6, (256, 2, 2)), -13, 13)
    c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    x = np.rint(p[:, 0, None, None] + c * pairs[..., 0] - s * pairs[..., 1]).astype(int)
    y = np.rint(p[:, 1, None, None] + s * pairs[..., 0] + c * pairs[..., 1]).astype(int)
    v = soft[np.clip(y, 0, g.shape[0] - 1), np.clip(x, 0, g.shape[1] - 1)]
    return v[..., 0] < v[..., 1]


def matches(one: np.ndarray, two: np.ndarray, most: int = MATCHES) -> np.ndarray:
    """Places of descriptors that are each other's nearest, the nearest pairs first."""
    a, b = one.astype("float32"), two.astype("float32")
    apart = a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)
    i, j = np.arange(len(one)), apart.argmin(1)
    i = i[apart.argmin(0)[j] == i]
    j = apart.argmin(1)[i]
    order = np.argsort(apart[i, j], kind="stable")[:most]
    return np.stack([i[order], j[order]], axis=1)


def fitted_map(src: np.ndarray, dst: np.ndarray, near: float = NEAR, tries: int = 500) -> np.ndarray | None:
    """The homography that most pairs of points agree with, fitted to them all; none if fewer than four do."""
    rng, best = np.random.default_rng(1), np.zeros(len(src), dtype=bool)
    ends = np.concatenate([src, np.ones((len(src), 1))], axis=1)

    def agree(m: np.ndarray) -> np.ndarray:
        q = ends @ m.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(np.hypot(*(q[:, :2] / q[:, 2:] - dst).T), nan=np.inf) <= near

    for _ in range(tries):
        pick = rng.choice(len(src), 4, replace=False)
        try:
            ok = agree(images.homography(src[pick], dst[pick]))
        except np.linalg.LinAlgError:
            continue
        best = ok if ok.sum() > best.sum() else best
    if best.sum() < 4:
        return None
    rows = []
    for (x, y), (u, v) in zip(src[best], dst[best], strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.lstsq(np.array(rows), dst[best].ravel(), rcond=None)[0], 1).reshape(3, 3)


def template(width: int, height: int) -> np.ndarray:
    """What pages are aligned to: a frame with a dot in each corner."""
    g, (y, x) = np.zeros((height, width), dtype="uint8"), np.mgrid[:height, :width]
    off = np.minimum(np.minimum(np.abs(x - 50), np.abs(x - (width - 50))) + 1e6 * ((y < 45) | (y > height - 45)), np.minimum(np.abs(y - 50), np.abs(y - (height - 50))) + 1e6 * ((x < 45) | (x > width - 45)))
    g[off <= 5] = 255
    for cx in (100, width - 100):
        for cy in (100, height - 100):
            g[(x - cx) ** 2 + (y - cy) ** 2 <= 900] = 255
    return g


def align(a: np.ndarray, width: int = 2000, height: int = 1261, to: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """The image on a page of this size, the map to it, and whether landmarks gave the map; else the image is resized."""
    h, w = a.shape[:2]
    g, t = images.gray(a), template(width, height) if to is None else to
    p, q = corners_of(g), corners_of(t)
    if min(len(p), len(q)) >= 4:
        pairs = matches(descriptors(g, p), descriptors(t, q))
        m = fitted_map(p[pairs[:, 0]].astype(float), q[pairs[:, 1]].astype(float)) if len(pairs) >= ENOUGH else None
        if m is not None and np.isfinite(m).all() and DETERMINANT[0] <= abs(np.linalg.det(m)) <= DETERMINANT[1]:
            y, x = np.mgrid[:height, :width]
            z = np.linalg.inv(m) @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
            return images.sample(a, (z[1] / z[2]).reshape(height, width), (z[0] / z[2]).reshape(height, width)), m, True
    return images.resize(a, height, width), np.diag([width / w, height / h, 1.0]), False


def boundaries(frames: DataFrame) -> DataFrame:
    """img_id, corners (x and y of the four, from the top left clockwise), confidence, detected, method, angle of its lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            every = [images.array(*row) for row in pdf[["height", "width", "channels", "data"]].itertuples(index=False)]
            found = [boundary(a) for a in every]
            yield pd.DataFrame({"img_id": pdf["img_id"], "corners": [f["corners"].ravel().tolist() for f in found], "confidence": [float(f["confidence"]) for f in found], "detected": [f["detected"] for f in found], "method": [f["method"] for f in found], "angle": [images.deskew_angle(line_angles(a)) for a in every]})

    return frames.select("img_id", "height", "width", "channels", "data").mapInPandas(run, "img_id long, corners array<double>, confidence double, detected boolean, method string, angle double")


# Shape of a card and of other pages, confidence from which a boundary is warped.
CARD, OTHER, TRUSTED = 1.5858, 1.4205, 0.60


def canonicalize(a: np.ndarray, document_type: str = "cnic_front", found: dict | None = None, angles: list[float] | None = None, width: int = 2000) -> dict:
    """A photo as a page: its boundary warped, or landmarks aligned where there is none to trust, deskewed, evenly lit.

    found and angles are what a detector gives, this module's if not named. matrix takes points of the photo to the page,
    with the rotation in it; stages are the images on the way, by name.
    """
    bgr = images.to_bgr(a)
    ratio = CARD if "cnic" in document_type else OTHER
    box = boundary(bgr) if found is None else found
    stages = [("01_original", bgr)]
    if box["detected"] and box["confidence"] >= TRUSTED:
        page, m, _ = images.warp(bgr, box["corners"], ratio, width)
        stages.append(("02_perspective", page))
    else:
        page, m, aligned = align(bgr, width, int(width / ratio))
        stages.append(("02_landmarks" if aligned else "02_resized", page))
    t = images.deskew_angle(line_angles(page) if angles is None else angles)
    if t:
        r, (h, w) = np.deg2rad(t), page.shape[:2]
        turn = np.array([[np.cos(r), np.sin(r), w / 2 - np.cos(r) * w / 2 - np.sin(r) * h / 2], [-np.sin(r), np.cos(r), h / 2 + np.sin(r) * w / 2 - np.cos(r) * h / 2], [0, 0, 1]])
        page, m = images.rotate(page, t), turn @ m
        stages.append(("03_deskew", page))
    page = images.normalize_format(page, width)
    return {"image": page, "matrix": m, "boundary": box, "angle": t, "stages": [*stages, ("10_canonical", page)]}


def stage_rows(frames: DataFrame, document_type: str = "cnic_front", width: int = 2000) -> DataFrame:
    """img_id, stage and the image's columns: each image in every stage of canonicalize, the last one its page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, h, w, c, data in pdf[["img_id", "height", "width", "channels", "data"]].itertuples(index=False):
                made = canonicalize(images.array(h, w, c, data), document_type, width=width)["stages"]
                yield pd.DataFrame([(i, n, x.shape[0], x.shape[1], 1 if x.ndim == 2 else x.shape[2], np.ascontiguousarray(x).tobytes()) for n, x in made], columns=["img_id", "stage", "height", "width", "channels", "data"])

    return frames.select("img_id", "height", "width", "channels", "data").mapInPandas(run, "img_id long, stage string, height int, width int, channels int, data binary")

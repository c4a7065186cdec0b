"""Kernels over whole images, for what an aggregate or a window can't say: NumPy, an image at a time in Arrow batches.

Gray or colour arrays are uint8, H x W or H x W x 3 (blue, green, red). All
kernels are functions of an array; frames of images (img_id, height, width,
channels, data) go through `apply`, which maps partitions without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "img_id long, height int, width int, channels int, data binary"
Kernel = Callable[[np.ndarray], np.ndarray]


def packed(px: DataFrame) -> DataFrame:
    """Images of a pixel relation, one row each."""
    order = F.array_sort(F.collect_list(F.struct("r", "c", "gray")))
    g = px.groupBy("img_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"), order.alias("o"))
    return g.select("img_id", "height", "width", F.lit(1).alias("channels"), F.unhex(F.array_join(F.transform("o", lambda x: F.lpad(F.hex(x["gray"].cast("long")), 2, "0")), "")).alias("data"))


def array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    a = np.frombuffer(data, dtype="uint8")
    return a.reshape(height, width) if channels == 1 else a.reshape(height, width, channels)


def apply(images: DataFrame, kernel: Kernel) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [kernel(array(*row)) for row in pdf[["height", "width", "channels", "data"]].itertuples(index=False)]
            yield pd.DataFrame({"img_id": pdf["img_id"], "height": [o.shape[0] for o in out], "width": [o.shape[1] for o in out], "channels": [1 if o.ndim == 2 else o.shape[2] for o in out], "data": [np.ascontiguousarray(o).tobytes() for o in out]})

    return images.select("img_id", "height", "width", "channels", "data").mapInPandas(run, SCHEMA)


def clip(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255).astype("uint8")


def gray(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else clip(a[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299]))


def to_bgr(a: np.ndarray) -> np.ndarray:
    """Gray is repeated, a fourth channel dropped after red and blue change places, three channels copied."""
    if a.ndim == 2:
        return np.repeat(a[..., None], 3, axis=2)
    return a[..., [2, 1, 0]].copy() if a.shape[2] == 4 else a.copy()


def by_channel(f: Callable[[np.ndarray], np.ndarray], a: np.ndarray) -> np.ndarray:
    return f(a) if a.ndim == 2 else np.stack([f(a[..., k]) for k in range(a.shape[2])], axis=-1)


def windows(a: np.ndarray, n: int, mode: str = "reflect") -> np.ndarray:
    """(2n+1)^2 neighbourhood of each pixel, in the last two axes."""
    mode = mode if min(a.shape) > n else "edge"
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, n, mode=mode), (2 * n + 1, 2 * n + 1))


def separable(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Convolution with a symmetric kernel along both axes; borders mirror."""
    n, out = len(k) // 2, a.astype(float)
    for axis in (0, 1):
        mode = "reflect" if out.shape[axis] > n else "edge"
        pad = np.pad(out, [(n, n) if i == axis else (0, 0) for i in (0, 1)], mode=mode)
        out = sum(w * (pad[i : i + out.shape[0]] if axis == 0 else pad[:, i : i + out.shape[1]]) for i, w in enumerate(k))
    return out


def gaussian_kernel(sigma: float, size: int | None = None) -> np.ndarray:
    n = (size or 2 * int(3 * sigma + 0.5) + 1) // 2
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    return k / k.sum()


def gaussian(a: np.ndarray, sigma: float, size: int | None = None) -> np.ndarray:
    return by_channel(lambda c: separable(c, gaussian_kernel(sigma, size)), a)


def noise(a: np.ndarray) -> float:
    """Mean difference from a 5 x 5 smoothing, of 25, at most 1."""
    g = gray(a).astype(float)
    return float(min(1.0, np.abs(g - clip(separable(g, np.array([1, 4, 6, 4, 1]) / 16))).mean() / 25))


def laplacian_variance(a: np.ndarray) -> float:
    g = gray(a).astype(float)
    p = np.pad(g, 1, mode="reflect" if min(g.shape) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def extreme(a: np.ndarray, size: int, f: Callable) -> np.ndarray:
    """Running minimum or maximum over a square; borders end it."""
    n, out = size // 2, a
    fill = 255 if f is np.min else 0
    for axis in (0, 1):
        pad = np.pad(out, [(n, n) if i == axis else (0, 0) for i in (0, 1)], constant_values=fill)
        out = f(np.lib.stride_tricks.sliding_window_view(pad, 2 * n + 1, axis=axis), axis=-1)
    return out


def morphology(a: np.ndarray, how: str = "open", size: int = 3) -> np.ndarray:
    steps = {"erode": (np.min,), "dilate": (np.max,), "close": (np.max, np.min)}.get(how, (np.min, np.max))
    for f in steps:
        a = by_channel(lambda c, f=f: extreme(c, size, f), a)
    return a


def illumination(a: np.ndarray, size: int = 51) -> np.ndarray:
    """Each channel over its closing, which estimates the background."""
    back = np.maximum(morphology(a, "close", size), 1).astype(float)
    return clip(a / back * 255)


def illumination_gaussian(a: np.ndarray, sigma: float = 30, target: float = 200) -> np.ndarray:
    return clip(a / np.maximum(gaussian(a, sigma), 1) * target)


def clahe(a: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Equalisation by tiles with clipped histograms, blended between tiles; colour keeps its hue and scales with luma."""
    if a.ndim == 3:
        g = gray(a)
        e = clahe(g, limit, tiles).astype(float)
        return clip(a * (e / np.maximum(g, 1))[..., None])
    h, w = a.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    pad = np.pad(a, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    maps = np.empty((tiles, tiles, 256))
    most = max(1, int(limit * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(pad[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - most, 0).sum())
            maps[i, j] = np.cumsum(np.minimum(n, most) + over / 256) * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, tiles - 1), np.clip(np.floor(x).astype(int), 0, tiles - 1)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    at = lambda i, j: maps[i[:, None], j[None, :], a]
    return clip((at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy)


def bilateral(a: np.ndarray, d: int = 7, color: float = 50, space: float = 50) -> np.ndarray:
    n = d // 2
    yy, xx = np.mgrid[-n : n + 1, -n : n + 1]
    near = np.exp(-(yy**2 + xx**2) / (2 * space**2)) * (yy**2 + xx**2 <= n * n)
    img = a[..., None].astype(float) if a.ndim == 2 else a.astype(float)
    views = [windows(img[..., k], n) for k in range(img.shape[2])]
    diff = sum(np.abs(v - img[..., k, None, None]) for k, v in enumerate(views))
    weight = near * np.exp(-(diff**2) / (2 * color**2))
    out = np.stack([(v * weight).sum((2, 3)) / weight.sum((2, 3)) for v in views], axis=-1)
    return clip(out[..., 0] if a.ndim == 2 else out)


def nlm(a: np.ndarray, h: float = 10, patch: int = 3, search: int = 7) -> np.ndarray:
    """Non-local means: each pixel the mean of those around it, weighed by how alike their patches are."""
    def one(c: np.ndarray) -> np.ndarray:
        n, m, x = search // 2, patch // 2, c.astype(float)
        pad = np.pad(x, n, mode="symmetric")
        total, weights = np.zeros_like(x), np.zeros_like(x)
        for dy in range(2 * n + 1):
            for dx in range(2 * n + 1):
                y = pad[dy : dy + x.shape[0], dx : dx + x.shape[1]]
                apart = separable((x - y) ** 2, np.full(2 * m + 1, 1 / (2 * m + 1)))
                w = np.exp(-np.maximum(apart, 0) / (h * h))
                total, weights = total + w * y, weights + w
        return clip(total / weights)

    return by_channel(one, a)


def median(a: np.ndarray, size: int = 3) -> np.ndarray:
    return by_channel(lambda c: np.median(windows(c, (size | 1) // 2, "edge"), axis=(2, 3)).astype("uint8"), a)


def smooth(a: np.ndarray, size: int = 5) -> np.ndarray:
    size |= 1
    return clip(gaussian(a, 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size))


def unsharp(a: np.ndarray, sigma: float = 1.0, amount: float = 0.5, threshold: int = 0) -> np.ndarray:
    soft = gaussian(a, sigma)
    out = clip((1 + amount) * a - amount * soft)
    return np.where(np.abs(a - soft) < threshold, a, out) if threshold > 0 else out


def laplacian_sharpen(a: np.ndarray, strength: float = 1.0) -> np.ndarray:
    def one(c: np.ndarray) -> np.ndarray:
        p = np.pad(c.astype(float), 1, mode="reflect" if min(c.shape) > 1 else "edge")
        return clip((4 + strength) * c - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:])

    return by_channel(one, a)


def otsu(a: np.ndarray) -> np.ndarray:
    g = gray(a)
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    between = np.where((w0 > 0) & (w1 > 0), (s0[-1] * w0 - s0 * w0[-1]) ** 2 / np.maximum(w0 * w1, 1), 0)
    return np.where(g > between.argmax(), 255, 0).astype("uint8")


def adaptive_gaussian(a: np.ndarray, block: int = 11, c: float = 2) -> np.ndarray:
    block |= 1
    return np.where(gray(a) > gaussian(gray(a), 0.3 * ((block - 1) * 0.5 - 1) + 0.8, block) - c, 255, 0).astype("uint8")


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at places; outside, those of the edge."""
    h, w = a.shape[:2]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), y - y0, x - x0
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    return clip((a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy)


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    y, x = (np.arange(height) + 0.5) * a.shape[0] / height - 0.5, (np.arange(width) + 0.5) * a.shape[1] / width - 0.5
    return sample(a, *np.meshgrid(y, x, indexing="ij"))


def scale_for(width: int, least: int = 1600, most: int = 4000) -> float:
    return least / width if width < least else most / width if width > most else 1.0


def normalize_resolution(a: np.ndarray, least: int = 1600, most: int = 4000) -> tuple[np.ndarray, float]:
    s = scale_for(a.shape[1], least, most)
    return (a.copy(), 1.0) if s == 1 else (resize(a, max(1, int(a.shape[0] * s)), max(1, int(a.shape[1] * s))), s)


def rotate(a: np.ndarray, degrees: float) -> np.ndarray:
    """About the centre, the size kept; under a tenth of a degree nothing moves."""
    if abs(degrees) < 0.1:
        return a.copy()
    t, (h, w) = np.deg2rad(degrees), a.shape[:2]
    y, x = np.mgrid[:h, :w].astype(float)
    y, x = y - h / 2, x - w / 2
    return sample(a, np.sin(t) * x + np.cos(t) * y + h / 2, np.cos(t) * x - np.sin(t) * y + w / 2)


def exif_orient(a: np.ndarray, orientation: int) -> np.ndarray:
    t = a.swapaxes(0, 1)
    return {2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: t, 6: t[:, ::-1], 7: t[::-1, ::-1], 8: t[::-1]}.get(orientation, a).copy()


def exif_orientation(content: bytes) -> int | None:
    """Tag 274 of a JPEG's EXIF block; null without one."""
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        block = content[at + 4 : at + 2 + size]
        if kind == 0xE1 and block[:6] == b"Exif\0\0":
            t = block[6:]
            order = "little" if t[:2] == b"II" else "big"
            num = lambda i, n: int.from_bytes(t[i : i + n], order)  # noqa: E731, B023
            d = num(4, 4)
            for k in range(num(d, 2)):
                e = d + 2 + 12 * k
                if num(e, 2) == 274:
                    return num(e + 8, 2)
            return None
        at += 2 + size
    return None


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The map of four points to four others."""
    rows = []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.solve(np.array(rows, dtype=float), np.asarray(dst, dtype=float).ravel()), 1).reshape(3, 3)


def order_points(p: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    s, d = p.sum(1), p[:, 1] - p[:, 0]
    return np.array([p[s.argmin()], p[d.argmin()], p[s.argmax()], p[d.argmax()]], dtype=float)


def convex(p: np.ndarray) -> bool:
    e = np.roll(p, -1, axis=0) - p
    f = np.roll(e, -1, axis=0)
    z = e[:, 0] * f[:, 1] - e[:, 1] * f[:, 0]
    return bool((z > 0).all() or (z < 0).all())


def warp(a: np.ndarray, corners: np.ndarray, ratio: float = 1.5858, width: int = 2000) -> tuple[np.ndarray, np.ndarray, bool]:
    """The quadrangle as a page of a fixed shape, the map, and whether it was warped; else the page resized."""
    h, w, height = a.shape[0], a.shape[1], int(width / ratio)
    page = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], dtype=float)
    if len(corners) == 4:
        p = order_points(np.asarray(corners, dtype=float))
        across, down = max(np.hypot(*(p[1] - p[0])), np.hypot(*(p[2] - p[3]))), max(np.hypot(*(p[3] - p[0])), np.hypot(*(p[2] - p[1])))
        if convex(p) and down > 0 and abs(across / down - ratio) <= 0.4 * ratio:
            m = homography(p, page)
            det = np.linalg.det(m)
            if np.isfinite(det) and 1e-7 <= abs(det) <= 1e7:
                y, x = np.mgrid[:height, :width]
                q = np.linalg.inv(m) @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
                return sample(a, (q[1] / q[2]).reshape(height, width), (q[0] / q[2]).reshape(height, width)), m, True
    return resize(a, height, width), np.diag([width / w, height / h, 1.0]), False


def accept_quad(corners: np.ndarray, height: int, width: int) -> dict:
    """What a detected boundary is worth: its corners if large, convex and of a card's shape, else the whole frame."""
    p = np.asarray(corners, dtype=float)
    if p.shape == (4, 2):
        p = order_points(p)
        share = 0.5 * abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / (height * width)
        down = max(np.hypot(*(p[3] - p[0])), np.hypot(*(p[2] - p[1])))
        ratio = max(np.hypot(*(p[1] - p[0])), np.hypot(*(p[2] - p[3]))) / down if down else 0
        if share >= 0.5 and convex(p) and 1.10 <= ratio <= 2.20:
            return {"corners": p, "confidence": min(0.95, share + 0.1), "detected": True, "method": "contour"}
    whole = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], dtype=float)
    return {"corners": whole, "confidence": 0.5, "detected": False, "method": "fallback_full_image"}


def deskew_angle(angles: list[float]) -> float:
    """The median of a line detector's angles within 15 degrees, if over half a degree; else 0."""
    near = [x for x in angles if abs(x) <= 15]
    m = float(np.median(near)) if near else 0.0
    return m if abs(m) > 0.5 else 0.0


def zone_crop(a: np.ndarray, top: float = 0.68, bottom: float = 1.0) -> np.ndarray:
    return a[round(a.shape[0] * top) : round(a.shape[0] * bottom)]


def zone_enhance(a: np.ndarray) -> np.ndarray:
    g = gray(a)
    tall = max(1, g.shape[0] // 3)
    if tall < 35:
        s = 35 / tall
        g = resize(g, int(g.shape[0] * s), int(g.shape[1] * s))
    return otsu(clahe(g, 3.0, 4))


def zones(a: np.ndarray, boxes: dict[str, tuple[float, float, float, float]]) -> dict[str, np.ndarray]:
    """Relative boxes (top, left, bottom, right), each smoothed, equalised and sharpened."""
    h, w = a.shape[:2]
    cut = {k: a[int(b[0] * h) : int(b[2] * h), int(b[1] * w) : int(b[3] * w)] for k, b in boxes.items()}
    return {k: unsharp(clahe(bilateral(v, 5, 40, 40)), 1.0, 0.4) for k, v in cut.items() if v.size}


# The treatment of a field's crop by its profile.
PROFILES: dict[str, Kernel] = {
    "urdu_safe": lambda a: clahe(a, 1.5),
    "numeric": lambda a: unsharp(clahe(a, 2.0), 1.0, 0.5),
    "date": lambda a: unsharp(clahe(a, 2.0), 1.0, 0.4),
    "passport_number": lambda a: unsharp(clahe(a, 2.5), 1.0, 0.6),
    "mrz": zone_enhance,
    "standard": lambda a: unsharp(bilateral(a, 5, 30, 30), 1.0, 0.3),
}


def profiled(a: np.ndarray, profile: str) -> np.ndarray:
    return PROFILES.get(profile, PROFILES["standard"])(a)


VARIANTS: dict[str, Kernel] = {
    "geometry_only": lambda a: a.copy(),
    "illumination": illumination,
    "clahe": partial(clahe, limit=2.0),
    "bilateral_usm": lambda a: unsharp(bilateral(a, 5, 40, 40), 1.0, 0.4),
    "otsu": otsu,
}


def variants(images: DataFrame) -> DataFrame:
    """Each image in every variant, and as it came: img_id, variant and the image's columns."""
    kernels = {**VARIANTS, "original": lambda a: a}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, h, w, c, data in pdf[["img_id", "height", "width", "channels", "data"]].itertuples(index=False):
                made = {k: f(array(h, w, c, data)) for k, f in kernels.items()}
                yield pd.DataFrame({"img_id": i, "variant": list(made), "height": [o.shape[0] for o in made.values()], "width": [o.shape[1] for o in made.values()], "channels": [1 if o.ndim == 2 else o.shape[2] for o in made.values()], "data": [np.ascontiguousarray(o).tobytes() for o in made.values()]})

    return images.mapInPandas(run, "img_id long, variant string, height int, width int, channels int, data binary")


def normalize_format(a: np.ndarray, width: int = 2000) -> np.ndarray:
    """The page at a fixed width, evenly lit and equalised, whatever its plan says."""
    return clahe(illumination(resize(a, max(1, round(a.shape[0] * width / a.shape[1])), width)))


def metrics(images: DataFrame) -> DataFrame:
    """img_id, laplacian_var, noise and the share of white after the global threshold: the kernels' own figures."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = [array(*row) for row in pdf[["height", "width", "channels", "data"]].itertuples(index=False)]
            yield pd.DataFrame({"img_id": pdf["img_id"], "laplacian_var": [laplacian_variance(x) for x in a], "noise": [noise(x) for x in a], "white": [float((otsu(x) > 0).mean()) for x in a]})

    return images.select("img_id", "height", "width", "channels", "data").mapInPandas(run, "img_id long, laplacian_var double, noise double, white double")

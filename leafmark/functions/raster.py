"""Operators on gray images, by numpy, and their form as DataFrame columns.

An image column is a struct of width, height and gray (binary, a byte a pixel, rows
from the top). Each function takes and returns a 2-D array of uint8; ``on_images`` runs
one over a table an Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

IMAGE = "struct<width:int,height:int,gray:binary>"


def histogram(gray: np.ndarray) -> np.ndarray:
    return np.bincount(gray.ravel(), minlength=256)


def otsu_threshold(bins: np.ndarray) -> int:
    """The threshold of the largest between-class variance; the middle of a plateau; 127 for one level or none."""
    n = bins.astype(float)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.where((w0 > 0) & (w1 > 0), (s0 * w0[-1] - s0[-1] * w0) ** 2 / (w0 * w1), -1.0)
    if spread.max() <= 0:
        return 127
    best = np.flatnonzero(spread >= spread.max() * (1 - 1e-12))
    return int((best[0] + best[-1]) // 2)


def stretch(gray: np.ndarray, low: float = 0.02, high: float = 0.98) -> np.ndarray:
    """Contrast stretched between two quantiles."""
    if not gray.size:
        return gray
    a, b = np.quantile(gray, low, method="lower"), np.quantile(gray, high, method="higher")
    if b <= a:
        return gray
    return np.clip(np.round((gray.astype(float) - a) * 255 / (b - a)), 0, 255).astype(np.uint8)


def _window_sums(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over centred windows, cut at the edges, and how many pixels each has."""
    r = size // 2
    total = np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0)))
    y, z = np.arange(x.shape[0]), np.arange(x.shape[1])
    y0, y1 = np.clip(y - r, 0, None), np.clip(y + r + 1, None, x.shape[0])
    z0, z1 = np.clip(z - r, 0, None), np.clip(z + r + 1, None, x.shape[1])
    sums = total[np.ix_(y1, z1)] - total[np.ix_(y0, z1)] - total[np.ix_(y1, z0)] + total[np.ix_(y0, z0)]
    return sums, np.outer(y1 - y0, z1 - z0)


def sauvola(gray: np.ndarray, size: int = 31, k: float = 0.2, reach: float = 128.0) -> np.ndarray:
    """Black and white by a threshold from the mean and spread around each pixel."""
    x = gray.astype(float)
    sums, n = _window_sums(x, size)
    squares, _ = _window_sums(x * x, size)
    mean = sums / n
    spread = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    return np.where(x <= mean * (1 + k * (spread / reach - 1)), 0, 255).astype(np.uint8)


def binarize(gray: np.ndarray, method: str = "sauvola") -> np.ndarray:
    return sauvola(gray) if method == "sauvola" else np.where(gray <= otsu_threshold(histogram(gray)), 0, 255).astype(np.uint8)


def components(ink: np.ndarray) -> np.ndarray:
    """Labels of 4-connected ink regions, 0 for none, by spreading the smallest label."""
    label = np.where(ink, np.arange(1, ink.size + 1).reshape(ink.shape), 0)
    while True:
        p = np.pad(label, 1)
        near = np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        least = np.where(near > 0, near, ink.size + 1).min(0)
        new = np.where(ink, least, 0)
        if (new == label).all():
            return label
        label = new


def denoise(gray: np.ndarray, least: int = 4) -> np.ndarray:
    """3x3 median, then dark blobs of fewer pixels than least become white."""
    p = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    out = np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), 0).astype(np.uint8)
    label = components(out < 128)
    sizes = np.bincount(label.ravel())
    out[(label > 0) & (sizes[label] < least)] = 255
    return out


def rotate_quarter(gray: np.ndarray, degrees: int) -> np.ndarray:
    """Turned clockwise by a multiple of 90 degrees."""
    return np.rot90(gray, -(degrees // 90) % 4).copy()


def deskew(gray: np.ndarray, degrees: float) -> np.ndarray:
    """Turned by an angle about the centre, bilinear, white outside."""
    h, w = gray.shape
    t = np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w]
    u = np.cos(t) * (x - w / 2) - np.sin(t) * (y - h / 2) + w / 2
    v = np.sin(t) * (x - w / 2) + np.cos(t) * (y - h / 2) + h / 2
    inside = (u >= 0) & (u <= w - 1) & (v >= 0) & (v <= h - 1)
    u0, v0 = np.clip(np.floor(u).astype(int), 0, max(w - 2, 0)), np.clip(np.floor(v).astype(int), 0, max(h - 2, 0))
    a, b, g = u - u0, v - v0, gray.astype(float)
    u1, v1 = np.minimum(u0 + 1, w - 1), np.minimum(v0 + 1, h - 1)
    mixed = g[v0, u0] * (1 - a) * (1 - b) + g[v0, u1] * a * (1 - b) + g[v1, u0] * (1 - a) * b + g[v1, u1] * a * b
    return np.where(inside, np.round(mixed), 255).astype(np.uint8)


def estimate_skew(gray: np.ndarray, limit: float = 5.0, step: float = 0.25) -> float:
    """The angle whose turned rows have the sharpest profile of ink."""
    y, x = np.nonzero(gray < 128)
    if len(y) < 16:
        return 0.0
    best, found = -1.0, 0.0
    for angle in sorted(np.arange(-limit, limit + step / 2, step), key=abs):
        t = np.radians(angle)
        rows = np.round(y * np.cos(t) - x * np.sin(t)).astype(int)
        profile = np.bincount(rows - rows.min())
        sharp = float((np.diff(profile.astype(float)) ** 2).sum())
        if sharp > best * (1 + 1e-9):
            best, found = sharp, float(angle)
    return found


def ink_rules(gray: np.ndarray, least: int = 24, thickness: int = 3) -> list[tuple[int, int, int, int]]:
    """Horizontal dark bars (x0, y0, x1, y1; ends exclusive) of a least length and at most a thickness."""
    ink = gray < 128
    open_: dict[tuple[int, int], int] = {}
    out = []
    for y in range(ink.shape[0] + 1):
        runs = set()
        if y < ink.shape[0]:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ink[y].astype(np.int8), [0]])))
            runs = {(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least}
        for run in [r for r in open_ if r not in runs]:
            if y - open_[run] <= thickness:
                out.append((run[0], open_[run], run[1], y))
            del open_[run]
        for run in runs:
            open_.setdefault(run, y)
    return sorted(out, key=lambda r: (r[1], r[0]))


def empty_rectangles(grid: np.ndarray, columns: int, rows: int) -> list[tuple[int, int, int, int]]:
    """Maximal free rectangles (x0, y0, x1, y1) of an occupancy grid, at least so wide and high."""
    free = ~grid.astype(bool)
    height = np.zeros(grid.shape[1] + 1, int)
    out = set()
    for y in range(grid.shape[0]):
        height[:-1] = np.where(free[y], height[:-1] + 1, 0)
        below = free[y + 1] if y + 1 < grid.shape[0] else np.zeros(grid.shape[1], bool)
        stack: list[tuple[int, int]] = []
        for x, h in enumerate(height):
            start = x
            while stack and stack[-1][1] > h:
                start, tall = stack.pop()
                if x - start >= columns and tall >= rows and not below[start:x].all():
                    out.add((start, y + 1 - tall, x, y + 1))
            if h and (not stack or stack[-1][1] < h):
                stack.append((start, int(h)))
    return sorted(out)


def page_difference(a: np.ndarray, b: np.ndarray, masks: list[tuple[int, int, int, int]] = (), tolerance: int = 8) -> tuple[float, str]:
    """Share of pixels outside the masks that differ by more than the tolerance, and ok, warning or error."""
    if a.shape != b.shape:
        return 1.0, "error"
    seen = np.ones(a.shape, bool)
    for x0, y0, x1, y1 in masks:
        seen[y0:y1, x0:x1] = False
    ratio = float(((np.abs(a.astype(int) - b.astype(int)) > tolerance) & seen).sum() / max(1, seen.sum()))
    return ratio, "error" if ratio > 0.001 else "warning" if ratio > 0.0001 else "ok"


def read_pgm(data: bytes) -> np.ndarray:
    """A binary PGM file of up to 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    if fields[0] != b"P5":
        raise ValueError("not a binary PGM")
    w, h = int(fields[1]), int(fields[2])
    return np.frombuffer(data, np.uint8, w * h, at + 1).reshape(h, w)


def write_pgm(gray: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + gray.tobytes()


def on_images(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], column: str = "image", key: str = "id") -> DataFrame:
    """key and the image column with a function applied to each image; a null image stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b[column]:
                if v is not None:
                    g = f(np.frombuffer(v["gray"], np.uint8).reshape(v["height"], v["width"]))
                    v = {"width": g.shape[1], "height": g.shape[0], "gray": g.tobytes()}
                out.append(v)
            yield pd.DataFrame({key: b[key], column: pd.Series(out, dtype=object)})

    return df.select(key, column).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {column} {IMAGE}")

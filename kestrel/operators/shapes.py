"""Shape measures of masks: one row for each mask in, one out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = "area double, area_percentage double, perimeter double, centroid_x double, centroid_y double, orientation_angle double, hull_area double, contour array<struct<x:int,y:int>>"


def largest(mask: np.ndarray) -> np.ndarray:
    """The outline that encloses most of those of the mask's components (neighbours also across
    corners), of equals the first in reading order.

    Components come from the runs of set pixels in each row, joined where runs of neighbouring
    rows touch.
    """
    padded = np.pad(mask.astype(np.int8), 1)
    edges = np.diff(padded, axis=1)
    rows, begins = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    parent = list(range(len(rows)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above, first = 0, np.searchsorted(rows, np.arange(rows[-1] + 2))
    for k, row in enumerate(rows.tolist()):
        above = max(above, int(first[row - 1]))
        # Runs above that end before this one begins touch no later run of the row either.
        while above < first[row] and ends[above] < begins[k]:
            above += 1
        other = above
        while other < first[row] and begins[other] <= ends[k]:
            a, b = find(other), find(k)
            parent[max(a, b)] = min(a, b)
            other += 1
    roots = np.array([find(k) for k in range(len(rows))])
    if not roots.any():
        return trace(mask)
    best, most = None, -1.0
    for root in np.unique(roots).tolist():
        part = np.zeros_like(padded)
        for k in np.flatnonzero(roots == root).tolist():
            part[rows[k], begins[k] + 1 : ends[k] + 1] = 1
        outline = trace(part[1:-1, 1:-1])
        if (area := polygon(outline)[0]) > most:
            best, most = outline, area
    return best


def trace(mask: np.ndarray) -> np.ndarray:
    """The outer boundary of the component that holds the first set pixel in reading order, as
    points (x, y), by walking round it with the background at the left."""
    steps = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    padded = np.pad(mask.astype(bool), 1)
    ys, xs = np.nonzero(padded)
    start = (int(xs[0]), int(ys[0]))
    at, heading, points = start, 0, [start]
    while True:
        for turn in range(8):
            d = (heading + 5 + turn) % 8
            x, y = at[0] + steps[d][0], at[1] + steps[d][1]
            if padded[y, x]:
                break
        else:
            return np.array([start]) - 1
        if at == start and len(points) > 1 and (x, y) == points[1]:
            return np.array(points[:-1]) - 1
        at, heading = (x, y), d
        points.append(at)


def polygon(points: np.ndarray) -> tuple[float, float]:
    """Area and perimeter of a closed polygon."""
    nxt = np.roll(points, -1, axis=0)
    area = abs(float((points[:, 0] * nxt[:, 1] - nxt[:, 0] * points[:, 1]).sum())) / 2
    return area, float(np.hypot(*(nxt - points).T).sum())


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, by monotone chains."""
    ordered = sorted(map(tuple, points.tolist()))
    if len(ordered) < 3:
        return np.array(ordered)

    def chain(sequence):
        out: list = []
        for p in sequence:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(ordered) + chain(ordered[::-1]))


def measures(mask: np.ndarray) -> list:
    """MEASURES of a mask, perimeter, hull and contour those of its largest component. A mask that is
    mostly set is inverted first; an empty one has nulls throughout, the centre included."""
    mask = np.asarray(mask) > 0
    if mask.mean() > 0.5:
        mask = ~mask
    if not mask.any():
        return [None] * 8
    ys, xs = np.nonzero(mask)
    cxx, cyy, cxy = xs.var(), ys.var(), ((xs - xs.mean()) * (ys - ys.mean())).mean()
    angle = math.degrees(0.5 * math.atan2(2 * cxy, cxx - cyy)) % 180
    outline = largest(mask)
    _, around = polygon(outline)
    hull_area, _ = polygon(hull(outline))
    return [float(mask.sum()), 100 * float(mask.mean()), around, float(xs.mean()), float(ys.mean()), angle, hull_area, [{"x": int(x), "y": int(y)} for x, y in outline]]


def shape_measures(df: DataFrame, keys: list[str], mask: str, height: str, width: str) -> DataFrame:
    """keys and MEASURES of masks given as bytes (a pixel each, 0 or not) with height and width.
    A null or empty mask has nulls; bytes that don't fit the size are an error. Masks that are the same
    within a batch, as those of frames without movement, are measured once."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    rows = df.select(*keys, F.col(mask).alias("__m"), F.col(height).alias("__h"), F.col(width).alias("__w"))
    kinds = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            one = lru_cache(maxsize=1000)(lambda m, h, w: measures(np.frombuffer(m, np.uint8).reshape(int(h), int(w))))
            made = [one(bytes(m), h, w) if m is not None and len(m) else [None] * 8 for m, h, w in zip(frame["__m"], frame["__h"], frame["__w"])]
            yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    return rows.mapInPandas(run, f"{kinds}, {MEASURES}")


def ratio_columns(df: DataFrame) -> DataFrame:
    """df with area_perimeter_ratio, circularity and concavity; null where a divisor is 0."""
    divide = lambda a, b: F.try_divide(a, b)
    return df.withColumns({
        "area_perimeter_ratio": divide(F.col("area"), F.col("perimeter")),
        "circularity": divide(4 * math.pi * F.col("area"), F.col("perimeter") ** 2),
        "concavity": divide(F.col("hull_area") - F.col("area"), F.col("hull_area")),
    })


def clipped_box(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """A box with its corners in order and inside the image."""
    inside = lambda v, n: F.greatest(F.lit(0), F.least(v, F.lit(n)))
    return F.struct(inside(F.least(x1, x2), width).alias("x1"), inside(F.least(y1, y2), height).alias("y1"), inside(F.greatest(x1, x2), width).alias("x2"), inside(F.greatest(y1, y2), height).alias("y2"))


#: Images that a task sums at most before it passes them on.
IMAGES = 64


def mean_image(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """keys, n and image: each pixel's mean over the frames (bytes of equal length), rounded
    down. Tasks sum their frames first, for up to IMAGES keys at a time."""
    kinds = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keys)

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def passed() -> pd.DataFrame:
            out = pd.DataFrame([[*k, n, t.tobytes()] for k, (n, t) in sums.items()], columns=[*keys, "n", "sums"])
            sums.clear()
            return out

        for f in frames:
            for row in f.itertuples(index=False):
                pixels = np.frombuffer(row[-1], np.uint8).astype(np.uint64)
                n, total = sums.get(row[:-1], (0, 0))
                sums[row[:-1]] = n + 1, total + pixels
                if len(sums) >= IMAGES:
                    yield passed()
        yield passed()

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].sum())
        total = sum(np.frombuffer(x, np.uint64) for x in group["sums"])
        return pd.DataFrame([[*group.loc[group.index[0], keys], n, (total // n).astype(np.uint8).tobytes()]], columns=[*keys, "n", "image"])

    sums = df.where(F.col(frame).isNotNull()).select(*keys, frame).mapInPandas(part, f"{kinds}, n long, sums binary")
    return sums.groupBy(*keys).applyInPandas(whole, f"{kinds}, n long, image binary")

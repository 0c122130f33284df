"""Column expressions on arrays of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def l1_normalized(a: Column) -> Column:
    """Elements over the sum of magnitudes; null elements count as 0, and a zero sum leaves
    the elements."""
    filled = F.transform(a, lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(filled, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.transform(filled, lambda x: x / F.when(total == 0, 1.0).otherwise(total))


def rolled_to_max(a: Column) -> Column:
    """The array turned so that its first largest element leads."""
    at = F.array_position(a, F.array_max(a)).cast("int")
    n = F.size(a)
    return F.when(n == 0, a).otherwise(F.concat(F.slice(a, at, n), F.slice(a, F.lit(1), at - 1)))


def resampled(a: Column, points: int) -> Column:
    """`points` elements at even steps from first to last, places rounded down."""
    n = F.size(a)
    step = (n - 1) / F.lit(float(points - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.get(a, F.floor(i * step).cast("int")))


def mean_of_present(*columns) -> Column:
    """Mean over the columns that are not null; null if all are."""
    present = F.filter(F.array(*[F.col(c).cast("double") if isinstance(c, str) else c for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.size(present))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the convex hull, counter-clockwise."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def chain(side):
        out = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(ordered) + chain(reversed(ordered))


def diameter(points: list[tuple[float, float]]) -> float:
    """The largest distance between two of the points: between corners that face each other, which
    callipers turned around the hull meet one after the other."""
    corners = hull(points)
    n = len(corners)
    far = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
    if n < 3:
        return far(corners[0], corners[-1]) ** 0.5
    best, k = 0.0, 1
    for i, p in enumerate(corners):
        q = corners[(i + 1) % n]
        height = lambda r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])  # noqa: B023, E731
        best = max(best, far(p, corners[k]), far(q, corners[k]))
        while height(corners[(k + 1) % n]) >= height(corners[k]) and (k + 1) % n != i:
            k = (k + 1) % n
            best = max(best, far(p, corners[k]), far(q, corners[k]))
    return best**0.5


@F.pandas_udf(DoubleType())
def _largest_distance(xs: pd.Series, ys: pd.Series) -> pd.Series:
    def one(x, y):
        if x is None:
            return None
        x, y = np.asarray(x, float), np.asarray(y, float)
        known = ~(np.isnan(x) | np.isnan(y))
        return diameter(list(zip(x[known].tolist(), y[known].tolist()))) if known.any() else None

    return pd.Series([one(x, y) for x, y in zip(xs, ys)], dtype=float)


def largest_distance(points: Column | str) -> Column:
    """The largest distance between two of an array of structs x and y; points that lack one of them
    are left out, and without points it is null. Coordinates go to Python as two arrays: a batch of
    structs would be a dictionary a point there."""
    side = lambda name: F.transform(points, lambda p: p[name].cast("double"))
    return _largest_distance(side("x"), side("y"))


def radial_profile(contour: Column, x: Column, y: Column, points: int = 100) -> Column:
    """Distances of a contour's points from (x, y), resampled and turned to start at the
    largest."""
    return rolled_to_max(resampled(F.transform(contour, lambda p: F.sqrt((p["x"] - x) ** 2 + (p["y"] - y) ** 2)), points))


@F.pandas_udf(ArrayType(DoubleType()))
def lowpass(signals: pd.Series, frequencies: pd.Series) -> pd.Series:
    """Each array without the frequencies above a number of turns; null arrays stay null."""

    def one(signal, keep):
        if signal is None or not len(signal):
            return signal
        parts = np.fft.rfft(np.asarray(signal, float))
        parts[int(keep) + 1 :] = 0
        return np.fft.irfft(parts, len(signal))

    return pd.Series([one(s, k) for s, k in zip(signals, frequencies)], dtype=object)

"""Divergence between stimulus and rest frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def gaussian_divergence(frames: DataFrame, keys: list[str], features: list[str], on: str = "cs_on", eps: float = EPS) -> DataFrame:
    """keys, n_on, n_off, <feature>_kl for each feature and kl, their sum: the divergence of the
    frames where `on` is true from those where it is false, as normal distributions.

    One aggregation over all keys; nulls are left out of a feature's moments, rows with a null
    flag of everything. A feature with fewer than two values on a side gives null, and kl with it.
    """
    moments = [F.count_if(F.col(on)).alias("n_on"), F.count_if(~F.col(on)).alias("n_off")]
    for c in features:
        for side, flag in (("on", F.col(on)), ("off", ~F.col(on))):
            v = F.when(flag, F.col(c))
            moments += [F.avg(v).alias(f"__{c}_m_{side}"), (F.var_samp(v) + eps).alias(f"__{c}_v_{side}")]
    out = frames.where(F.col(on).isNotNull()).groupBy(*keys).agg(*moments)
    for c in features:
        ma, mb, va, vb = (F.col(f"__{c}_{x}") for x in ("m_on", "m_off", "v_on", "v_off"))
        out = out.withColumn(f"{c}_kl", 0.5 * (F.ln(vb / va) + (va + (ma - mb) ** 2) / vb - 1))
    total = sum((F.col(f"{c}_kl") for c in features[1:]), F.col(f"{features[0]}_kl"))
    return out.select(*keys, "n_on", "n_off", *[f"{c}_kl" for c in features], total.alias("kl"))


def full_divergence(frames: DataFrame, keys: list[str], features: list[str], on: str = "cs_on", eps: float = 1e-6) -> DataFrame:
    """keys and kl_full with full covariances. Rows with a null feature are left out; the tasks
    reduce the rows to moments, and only these are grouped by key."""
    k = len(features)
    rows = frames.where(F.col(on).isNotNull()).na.drop(subset=features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]]
    sums += [F.covar_samp(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]
    moments = rows.groupBy(*keys, on).agg(*sums)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = {}
        for _, r in group.iterrows():
            cov = np.zeros((k, k))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
            parts[bool(r[on])] = np.array([r[f"m{i}"] for i in range(k)], float), cov + eps * np.eye(k)
        value = None
        if len(parts) == 2:
            (ma, a), (mb, b) = parts[True], parts[False]
            inverse, d = np.linalg.inv(b), mb - ma
            value = 0.5 * (np.trace(inverse @ a) + d @ inverse @ d - k + np.linalg.slogdet(b)[1] - np.linalg.slogdet(a)[1])
        return pd.DataFrame([[*group.loc[group.index[0], keys], value]], columns=[*keys, "kl_full"])

    schema = ", ".join(f"{c} {dict(frames.dtypes)[c]}" for c in keys)
    return moments.groupBy(*keys).applyInPandas(run, f"{schema}, kl_full double")


def shifted_null(frames: DataFrame, keys: list[str], frame: str, features: list[str], shifts: list[int], on: str = "cs_on") -> DataFrame:
    """keys, shift and kl with the flags turned by each of the given shifts (a stated list) along
    the series: the null distribution of kl. Frames count from 0 without gaps."""
    n = frames.groupBy(*keys).agg((F.max(frame) + 1).alias("__n"))
    flags = frames.select(*keys, F.col(frame), F.col(on)).join(n, keys)
    turned = flags.select(*keys, F.explode(F.array(*map(F.lit, shifts))).alias("shift"), F.col(frame), F.col(on), "__n")
    turned = turned.withColumn(frame, F.pmod(F.col(frame) + F.col("shift"), F.col("__n")).cast(dict(frames.dtypes)[frame])).drop("__n")
    moved = frames.drop(on).join(turned, [*keys, frame])
    return gaussian_divergence(moved, [*keys, "shift"], features, on).select(*keys, "shift", "kl")


def _turned_sums(mask: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """For each column and each shift s the sum of column[u] over the frames u with mask[u - s]."""
    spectrum = np.conj(np.fft.rfft(mask))
    return [np.fft.irfft(np.fft.rfft(c) * spectrum, len(mask)) for c in columns]


def _turned_divergence(v: np.ndarray, on: np.ndarray, off: np.ndarray, eps: float) -> np.ndarray:
    """The divergence of v for each shift of the two masks; NaN where a side has under two values."""
    n, known = len(v), ~np.isnan(v)
    shift = v[known].mean() if known.any() else 0.0
    x = np.where(known, v - shift, 0.0)
    spread = float((x * x).sum())
    moments = []
    for mask in (on, off):
        count, s1, s2 = _turned_sums(mask.astype(float), [known.astype(float), x, x * x])
        count = np.rint(count)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean, var = s1 / count, (s2 - s1 * s1 / count) / (count - 1)
        # Sums through the spectrum are exact to the spread of all values; where a side hardly
        # varies beside that, its values themselves are summed.
        places = np.flatnonzero(mask)
        for s in np.flatnonzero((count > 1) & ~(var * (count - 1) > 1e-6 * spread)):
            side = x[(places + s) % n][known[(places + s) % n]]
            mean[s], var[s] = side.mean(), side.var(ddof=1)
        mean[count < 2] = var[count < 2] = np.nan
        moments.append((mean, var + eps))
    (ma, va), (mb, vb) = moments
    return 0.5 * (np.log(vb / va) + (va + (ma - mb) ** 2) / vb - 1)


def circular_null(frames: DataFrame, keys: list[str], frame: str, features: list[str], on: str = "cs_on", eps: float = EPS) -> DataFrame:
    """keys, shift, <feature>_kl and kl for every turn of the flags along the series, from 0 (none): the
    exhaustive null distribution of gaussian_divergence(). Frames count from 0 without gaps.

    All shifts come from one correlation of the flags with counts, values and squares, so a series of
    n frames costs n log n, not n squared. A series, bounded by its recording, is one group.
    """
    names = [f"{c}_kl" for c in features]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__frame", ignore_index=True)
        side = group["__on"].to_numpy(dtype=float, na_value=np.nan)
        found = {f"{c}_kl": _turned_divergence(group[f"__v{k}"].to_numpy(dtype=float, na_value=np.nan), side == 1, side == 0, eps) for k, c in enumerate(features)}
        out = pd.DataFrame({k: [group[k].iloc[0]] * len(group) for k in keys} | {"shift": np.arange(len(group))} | found)
        return out.assign(kl=sum(found.values()))

    rows = frames.select(*keys, F.col(frame).cast("long").alias("__frame"), F.col(on).cast("double").alias("__on"), *[F.col(c).cast("double").alias(f"__v{k}") for k, c in enumerate(features)])
    kinds = "".join(f"{c} {dict(frames.dtypes)[c]}, " for c in keys)
    out = rows.groupBy(*keys).applyInPandas(run, f"{kinds}shift long, {', '.join(f'{c} double' for c in names)}, kl double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in [*names, "kl"]})


def null_p(null: DataFrame, keys: list[str], score: str = "kl", tolerance: float = 1e-9) -> DataFrame:
    """keys, the unshifted score, n_shifts, null_mean, null_sd, p_greater and p_two_sided from circular_null().

    p is the share of all shifts, that of 0 included, whose score is as large, or as far from the
    null's mean; scores within the tolerance are equal. Shifts without a score are left out.
    """
    rows = null.where(F.col(score).isNotNull())
    moments = rows.groupBy(*keys).agg(F.max(F.when(F.col("shift") == 0, F.col(score))).alias("__s"), F.count("*").alias("n_shifts"), F.avg(score).alias("null_mean"), F.stddev_pop(score).alias("null_sd"))
    joined = rows.join(moments.where("__s is not null"), keys)
    far = F.abs(F.col(score) - F.col("null_mean")) >= F.abs(F.col("__s") - F.col("null_mean")) - tolerance
    out = joined.groupBy(*keys, "__s", "n_shifts", "null_mean", "null_sd").agg(F.count_if(F.col(score) >= F.col("__s") - tolerance).alias("__g"), F.count_if(far).alias("__t"))
    return out.select(*keys, F.col("__s").alias(score), "n_shifts", "null_mean", "null_sd", (F.col("__g") / F.col("n_shifts")).alias("p_greater"), (F.col("__t") / F.col("n_shifts")).alias("p_two_sided"))

"""Folds over whole series and distributions as numpy over Arrow batches.

As column lambdas a fold is interpreted, at microseconds an element; over a batch of rows of one length an element takes
some nanoseconds.  Sums run in the order of the series, so results are those of the plain fold."""
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def blocks(a: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of their values) of every length among the non-null arrays."""
    start = a.offsets.to_numpy().astype(np.int64)
    size = np.where(a.is_null().to_numpy(zero_copy_only=False), -1, np.diff(start))
    values = a.values.to_numpy(zero_copy_only=False).astype(float)
    for n in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == n)
        yield rows, values[start[rows][:, None] + np.arange(n)]


def reals(a: pa.Array) -> np.ndarray:
    """Doubles with NaN for null."""
    return a.to_numpy(zero_copy_only=False).astype(float)


def _fold(body: Callable[[np.ndarray], np.ndarray], y: Column, empty: float | None = None) -> Column:
    """body(rows x values) of an array column; a null array gives `empty`."""

    def run(a: pa.Array) -> pa.Array:
        out, missing = np.full(len(a), np.nan if empty is None else empty), np.full(len(a), empty is None)
        with np.errstate(all="ignore"):
            for rows, values in blocks(a):
                out[rows], missing[rows] = body(values), False
        return pa.array(out, pa.float64(), mask=missing, from_pandas=False)

    return F.arrow_udf(run, "double")(y)


def _added(terms: Iterator[np.ndarray], n: int) -> np.ndarray:
    total = np.zeros(n)
    for x in terms:
        total = total + x
    return total


def croston(y: Column, alpha: float) -> Column:
    """Smoothed demand size over smoothed interval; 0 without demand."""

    def body(a):
        z, p, q = np.zeros(len(a)), np.zeros(len(a)), np.ones(len(a))
        for v in a.T:
            first, hit = p == 0, v != 0
            z = np.where(hit, np.where(first, v, alpha * v + (1 - alpha) * z), z)
            p = np.where(hit, np.where(first, q, alpha * q + (1 - alpha) * p), p)
            q = np.where(hit, 1.0, q + 1.0)
        return np.where(p > 0, z / p, 0.0)

    return _fold(body, y)


def tsb(y: Column, alpha: float) -> Column:
    """Smoothed demand probability times smoothed size."""

    def body(a):
        pr, z = np.full(len(a), -1.0), np.full(len(a), -1.0)
        for v in a.T:
            hit = np.where(v != 0, 1.0, 0.0)
            pr = np.where(pr < 0, hit, alpha * hit + (1 - alpha) * pr)
            z = np.where(v == 0, z, np.where(z < 0, v, alpha * v + (1 - alpha) * z))
        return np.where(z < 0, 0.0, pr * z)

    return _fold(body, y)


def difference_std(y: Column) -> Column:
    """Population std of first differences, their mean being (last - first) / k; 1 where there is none."""

    def body(a):
        k = a.shape[1] - 1
        if k < 1:
            return np.ones(len(a))
        mean = (a[:, -1] - a[:, 0]) / k
        sq = _added(((a[:, i + 1] - a[:, i]) * (a[:, i + 1] - a[:, i]) for i in range(k)), len(a)) / k
        d = np.sqrt(np.maximum(0.0, sq - mean * mean))
        return np.where((d > 1e-9) | np.isnan(d), d, 1.0)

    return _fold(body, y, 1.0)


def season_std(y: Column, m: int) -> Column:
    """Root mean square of differences over a season, over one step where the series is shorter; 1 where there is none."""

    def body(a):
        n = a.shape[1]
        lag = m if n >= m else 1
        if n <= lag:
            return np.ones(len(a))
        return np.sqrt(_added(((a[:, i + lag] - a[:, i]) * (a[:, i + lag] - a[:, i]) for i in range(n - lag)), len(a)) / (n - lag))

    return _fold(body, y, 1.0)


def difference_mean(y: Column) -> Column:
    """Mean absolute first difference; null for a single value."""

    def body(a):
        k = a.shape[1] - 1
        return _added((np.abs(a[:, i + 1] - a[:, i]) for i in range(k)), len(a)) / k if k > 0 else np.full(len(a), np.nan)

    return F.when(F.size(y) > 1, _fold(body, y))

"""Folds over one series held as an array, ordered by date.

A series has one value per calendar period, so its array is bounded by the length
of the calendar."""
from pyspark.sql import Column, functions as F

ZERO = 0.0


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(ZERO), lambda acc, v: acc + v)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def std_pop(a: Column) -> Column:
    sq = F.aggregate(a, F.lit(ZERO), lambda acc, v: acc + v * v)
    return F.sqrt(F.greatest(F.lit(ZERO), sq / F.size(a) - mean(a) * mean(a)))


def differences(a: Column, lag) -> Column:
    """a[i + lag] - a[i]; empty when the series is not longer than the lag."""
    lag = F.lit(lag) if isinstance(lag, int) else lag
    n = F.greatest(F.lit(0), F.size(a) - lag)
    return F.zip_with(F.slice(a, lag + 1, n), F.slice(a, F.lit(1), n), lambda x, y: x - y)


def autocorrelation(a: Column, k: int) -> Column:
    n = F.greatest(F.lit(0), F.size(a) - k)
    x, y = F.slice(a, F.lit(1), n), F.slice(a, F.lit(k + 1), n)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(ZERO), lambda acc, v: acc + v)
    sx, sy = total(x), total(y)
    va, vb = dot(x, x) - sx * sx / n, dot(y, y) - sy * sy / n
    den = F.sqrt(F.greatest(F.lit(ZERO), va) * F.greatest(F.lit(ZERO), vb))
    return F.when((F.size(a) <= k + 1) | (den < 1e-9), 0.0).otherwise((dot(x, y) - sx * sy / n) / den)


def at_level(sorted_array: Column, level: Column) -> Column:
    """Linearly interpolated quantile of an already sorted array, level per row."""
    pos = level * (F.size(sorted_array) - 1)
    lo, hi = F.get(sorted_array, F.floor(pos).cast("int")), F.get(sorted_array, F.ceil(pos).cast("int"))
    return lo + (hi - lo) * (pos - F.floor(pos))


BLOCK = 256


def scan(a: Column, start: Column, step) -> Column:
    """All states of a fold, one per element.  `a` is a plain column.

    A first pass keeps the state before every BLOCK-th element only, a second one folds each block on from there: an appended
    array is never longer than a block (or the number of blocks), so the cost is linear in the series."""
    first = F.struct(start.alias("s"), F.lit(0).alias("i"), F.slice(F.array(start), 1, 0).alias("out"))
    marks = F.aggregate(a, first, lambda acc, x: F.struct(
        step(acc["s"], x).alias("s"), (acc["i"] + 1).alias("i"),
        F.when(acc["i"] % BLOCK == 0, F.array_append(acc["out"], acc["s"])).otherwise(acc["out"]).alias("out")), lambda acc: acc["out"])

    def inside(s, b):
        begin = F.struct(s.alias("s"), F.slice(F.array(s), 1, 0).alias("out"))
        grown = lambda acc, new: F.get(F.transform(F.array(new), lambda n: F.struct(n.alias("s"), F.array_append(acc["out"], n).alias("out"))), F.lit(0))
        return F.aggregate(F.slice(a, b * BLOCK + 1, F.lit(BLOCK)), begin, lambda acc, x: grown(acc, step(acc["s"], x)), lambda acc: acc["out"])

    return F.flatten(F.transform(marks, inside))

"""Probabilities on a lattice: an array p where p[k] is the chance of the value k * width.

A row's arrays have a bounded number of cells, whatever the history or horizon behind them.  `let` binds a value once:
an expression named inside a lambda would be computed again for every element.  Making a distribution, by convolution, and reading
quantiles, shortages and moments off it is array arithmetic over batches of rows."""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..schema import QUANTILE_LEVELS
from .folds import blocks, reals

TINY = 1e-9


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none() -> Column:
    return F.array().cast("array<double>")


def running(a: Column) -> Column:
    """Inclusive running sums."""
    start = F.struct(F.lit(0.0).alias("s"), none().alias("out"))
    return F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["out"], acc["s"] + x).alias("out")), lambda acc: acc["out"])


def moments(p: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and std of every row."""
    x = np.arange(p.shape[1]) * width[:, None]
    mean = np.cumsum(p * x, axis=1)[:, -1]
    return mean, np.sqrt(np.maximum(0.0, np.cumsum(p * (x * x), axis=1)[:, -1] - mean * mean))


READ = ("value", "above", "short", "surplus")


def at_level(p: Column, width: Column, level: Column) -> Column:
    """struct of the smallest lattice value whose cumulated chance reaches the level, the chance above it, the expected demand beyond
    it and the expected rest below it; null without p."""

    def run(p: pa.Array, width: pa.Array, level: pa.Array) -> pa.Array:
        out, missing = np.zeros((len(READ), len(p))), np.ones(len(p), bool)
        widths, levels = reals(width), reals(level)
        for rows, chances in blocks(p):
            w, lattice = widths[rows, None], np.arange(chances.shape[1])
            below = (np.cumsum(chances, axis=1) < levels[rows, None] - TINY).sum(axis=1)
            q = np.minimum(below, chances.shape[1] - 1)[:, None] * w
            x = lattice * w
            for i, value in enumerate((x > q + TINY * w, np.maximum(0.0, x - q), np.maximum(0.0, q - x)), 1):
                out[i, rows] = np.cumsum(chances * value, axis=1)[:, -1]
            out[0, rows], missing[rows] = q[:, 0], False
        return pa.StructArray.from_arrays([pa.array(v) for v in out], names=READ, mask=pa.array(missing))

    return F.arrow_udf(run, ", ".join(f"{c} double" for c in READ))(p, width, level)


# ---- batches of rows ---------------------------------------------------------------------------------
# Convolutions take some 100 x 100 products a SKU: 100 ms as nested column lambdas here, 0.1 ms over a batch of SKUs.

def _put(rows: np.ndarray, at: np.ndarray, mass: np.ndarray, n: int, cells: int) -> np.ndarray:
    """Masses (with the number of their row and the cell they start in) on the first `cells` cells of n rows."""
    inside = (mass != 0.0) & (at < cells)
    return np.bincount(rows[inside] * cells + at[inside], mass[inside], n * cells).reshape(n, cells)


def mixed_quantiles(rows: np.ndarray, q: np.ndarray, share: np.ndarray, n: int, cells: int) -> np.ndarray:
    """Sum of share * max(0, X) over the entries of every row, on the first `cells` cells: X through five ascending quantiles (in cells), linear
    between, all mass beyond the ends at the ends.  A value between two cells is shared so that its mean stays.

    A stretch of even density longer than a cell gives a constant between its ends, so only the changes at its ends are noted and summed
    along the cells once a row; a shorter one is cut at the cell inside it, and what lies between two cells is shared like its middle."""
    known = np.isfinite(q).all(axis=1)
    if not known.all():
        rows, q, share = rows[known], q[known], share[known]
    levels = np.diff(np.array(QUANTILE_LEVELS))[None, :]
    low, high = q[:, :-1], q[:, 1:]
    a, b = np.maximum(0.0, low), np.maximum(0.0, high)
    wide, size = high - low, b - a
    mass = share[:, None] * levels
    over = np.where(wide > 0, mass * size / np.where(wide > 0, wide, 1.0), mass)
    ends = np.maximum(0.0, q[:, [0, -1]])
    at, m, owner = [ends], [share[:, None] * np.array([[QUANTILE_LEVELS[0], 1.0 - QUANTILE_LEVELS[-1]]])], [np.repeat(rows[:, None], 2, axis=1)]

    def point(position, weight, who):
        at.append(position[None, :])
        m.append(weight[None, :])
        owner.append(who[None, :])

    if (low < 0).any():
        e, k = np.nonzero(over != mass)
        point(np.zeros(len(e)), (mass - over)[e, k], rows[e])
    long = size > 1.0
    e, k = np.nonzero(~long)
    if len(e):
        x, y, z = a[e, k], b[e, k], over[e, k]
        cut = np.minimum(np.ceil(x), y)
        left = z * np.where(y > x, (cut - x) / np.where(y > x, y - x, 1.0), 1.0)
        point((x + cut) / 2, left, rows[e])
        point((cut + y) / 2, z - left, rows[e])
    flat = lambda parts: np.concatenate([x.ravel() for x in parts])
    at, m, owner = flat(at), flat(m), flat(owner)
    cell = np.floor(at)
    part, cell = at - cell, cell.astype(np.int64)
    out = _put(np.tile(owner, 2), np.concatenate([cell, cell + 1]), np.concatenate([m * (1.0 - part), m * part]), n, cells)
    if long.any():
        density = np.where(long, over / np.where(long, size, 1.0), 0.0)
        change = np.concatenate([np.zeros((len(q), 1)), density], axis=1) - np.concatenate([density, np.zeros((len(q), 1))], axis=1)
        e, k = np.nonzero(change)
        at, c = np.maximum(0.0, q[e, k]), change[e, k]
        cell = np.floor(at)
        part, cell = at - cell, cell.astype(np.int64)
        first, last = (1.0 - part) * (1.0 - part) / 2, part * part / 2
        out += np.cumsum(_put(np.tile(rows[e], 3), np.concatenate([cell, cell + 1, cell + 2]),
                              np.concatenate([-c * first, c * (first + last - 1.0), -c * last]), n, cells), axis=1)
    top = np.zeros(n)
    np.maximum.at(top, rows, np.ceil(ends[:, 1] - TINY))
    return np.where(np.arange(cells) <= top[:, None], out, 0.0)


def cells_of_quantiles(q: np.ndarray, width: np.ndarray, cells: int) -> np.ndarray:
    """max(0, X) on the first `cells` cells, row by row: X through five ascending quantiles, as in mixed_quantiles."""
    return mixed_quantiles(np.arange(len(q)), q / width[:, None], np.ones(len(q)), len(q), cells)


def quantile_means(q: np.ndarray) -> np.ndarray:
    """Mean of max(0, X) of every row, X as in cells_of_quantiles."""
    total = np.maximum(0.0, q[:, 0]) * QUANTILE_LEVELS[0] + np.maximum(0.0, q[:, -1]) * (1.0 - QUANTILE_LEVELS[-1])
    for i, (lo, hi) in enumerate(zip(QUANTILE_LEVELS, QUANTILE_LEVELS[1:])):
        a, b = q[:, i], q[:, i + 1]
        cut = b * b / np.where(b > a, 2 * (b - a), 1.0)
        total = total + np.where(b <= 0, 0.0, np.where(a >= 0, (a + b) / 2, cut)) * (hi - lo)
    return total


def cells_of_values(rows: np.ndarray, values: np.ndarray, weights: np.ndarray, width: np.ndarray, cells: int) -> np.ndarray:
    """Values (with the number of their row and their chance) on the first `cells` cells of every row."""
    at = np.maximum(0.0, values) / width[rows]
    low = np.floor(at)
    out = np.zeros(len(width) * cells)
    for cell, share in ((low, 1 - (at - low)), (low + 1, at - low)):
        inside = cell < cells
        out += np.bincount(rows[inside] * cells + cell[inside].astype(np.int64), weights[inside] * share[inside], len(out))
    return out.reshape(len(width), cells)


def convolved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distributions of sums, row by row, on as many cells."""
    out = np.zeros_like(b)
    for j in np.flatnonzero(a.any(axis=0)):
        out[:, j:] += a[:, j, None] * b[:, : b.shape[1] - j]
    return out


def power(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distributions of sums of n[row] independent values, by doubling."""
    out = np.zeros_like(p)
    out[:, 0] = 1.0
    n, none = n.copy(), np.ones(len(p), bool)
    while n.any():
        odd = n % 2 == 1
        out[odd & none] = p[odd & none]  # the first factor
        more = odd & ~none
        if more.any():
            out[more] = convolved(p[more], out[more])
        none &= ~odd
        n //= 2
        more = n > 0
        if more.any():
            p = p.copy()
            p[more] = convolved(p[more], p[more])
    return out


def lead_time_demand(steps: np.ndarray, lead: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(width, chances) of the demand over a lead time, row by row.

    steps: rows x periods x quantiles; periods past the last one repeat it.  lead: rows x equally likely lead times in periods, ascending.  A lead time
    of n whole periods and a part f adds n periods and f times the next.  With D_n the demand of period n and M_n the mixture of
    the parts of lead times with n whole periods, the result is M_0 + D_0 * (M_1 + D_1 * (M_2 + ...)), * a convolution."""
    rows, periods = len(steps), steps.shape[1]
    step = lambda n: steps[:, min(n, periods - 1)]
    whole = np.floor(lead).astype(np.int64)
    longest, last = lead[:, -1], int(whole[:, -1].max())
    most = sum(np.maximum(0.0, step(n)[:, -1]) * np.clip(longest - n, 0.0, 1.0) for n in range(last + 1))
    width = np.where(most > 0, most / cells, 1.0)
    size = cells + 2 * (last + 2)
    rest = np.zeros((rows, size))
    for n in range(last, -1, -1):
        q = step(n) / width[:, None]
        on = np.flatnonzero((whole > n).any(axis=1))
        if len(on):
            rest[on] = convolved(mixed_quantiles(np.arange(len(on)), q[on], np.ones(len(on)), len(on), size), rest[on])
        row, k = np.nonzero(whole == n)
        rest += mixed_quantiles(row, q[row] * (lead[row, k] - n)[:, None], np.full(len(row), 1.0 / lead.shape[1]), rows, size)
    return width, rest

"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Every vector has COUNTED projections; two vectors collide on one when the second lies in the window of half-width HALF
around the first.  Pairs with at least `least_collisions()` collisions (a count that a pair of the wanted cosine misses
with at most MISS) are verified in double precision.

So that a window need not be searched over all vectors, each of several tables first cuts the vectors by `bits` further
projections at zero; inside a cut, wide windows in the order of one projection bound the pairs that are counted.  The number of
cuts grows with the logarithm of the rows (about TARGET rows to a cut) and the number of tables with it, so that a wanted
pair shares a cut with probability 1 - LOST.  Large cuts are dealt out as pairs of blocks of BLOCK rows.  A pair counts in
the first table it shares and nowhere else.  Equal vectors are one representative from the start.

Blocks return, per row, how many links it has there and one link towards its block's component: never the pairs.

Edge cases: null, zero or non-finite vectors, and vectors with such components, link with nothing; vectors of different
length never link; repeated rows with one id count as one vector (one with several vectors is represented by the first);
a row without id has no links and no component; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, grouped, stored

COUNTED, HALF, MISS = 32, 0.9, 1e-6
TARGET, LOST, BLOCK = 64, 1e-4, 512


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def least_collisions(cosine: float) -> int:
    """Collisions of COUNTED that a pair of this cosine falls below with at most the chance MISS."""
    p = 2 * _normal(HALF / math.sqrt(2 - 2 * cosine)) - 1
    below = 0.0
    for k in range(COUNTED + 1):
        below += math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)
        if below > MISS:
            return k
    return COUNTED


def shape(n: int, cosine: float) -> tuple[int, int]:
    """Cutting projections of a table, and tables."""
    bits = max(1, math.ceil(math.log2(max(n, 2) / TARGET)))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(LOST) / math.log(1 - together)))


def _directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng(20240611 + dim).standard_normal((dim, n))


def _unit(column) -> np.ndarray:
    """Rows of a list column of one length, in double precision and of length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cuts(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Cut of each row in each table: on which side of each of the table's projections it lies."""
    side = (x @ _directions(x.shape[1], tables * bits) > 0).reshape(len(x), tables, bits)
    return (side << np.arange(bits, dtype=np.int64)).sum(axis=2)


def _deal(tables: int, bits: int):
    """Rows (dim, table, cut, id) of each representative."""

    def run(batches):
        for batch in batches:
            ids, dims = batch.column("id"), np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(dims):
                own = pa.array(np.flatnonzero(dims == dim))
                cuts = _cuts(_unit(batch.column("vector").take(own)), tables, bits)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim, np.int64)), pa.array(np.full(len(own), t, np.int64)), pa.array(cuts[:, t]), ids.take(own)],
                                                     ["dim", "table", "cut", "id"])

    return run


def _verified(cosine: float, least: int, tables: int, bits: int):
    def fn(rows: pa.Table):
        ids, own = rows.column("id").to_numpy(), rows.column("own").to_numpy()
        i, j, table = (rows.column(c)[0].as_py() for c in ("i", "j", "table"))
        x = _unit(rows.column("vector"))
        weight = rows.column("copies").to_numpy()
        line = x @ _counting(x.shape[1])
        order = np.argsort(line[:, 0], kind="stable")
        sorted_ = line[order, 0]
        links, a, b = np.zeros(len(ids), np.int64), [], []
        # windows in the order of the first projection bound the search: so wide that a wanted pair is outside in 1 of 1e7
        reach = 5.4 * math.sqrt(2 - 2 * cosine)
        for at in range(0, len(order), 64):
            asks = order[at : at + 64]
            low, high = np.searchsorted(sorted_, sorted_[at] - reach), np.searchsorted(sorted_, sorted_[min(at + 63, len(order) - 1)] + reach, side="right")
            near = order[low:high]
            count = np.zeros((len(asks), len(near)), np.int8)
            for k in range(COUNTED):
                count += np.abs(line[asks, k][:, None] - line[near, k][None, :]) <= HALF
            p, q = np.nonzero(count >= least)
            p, q = asks[p], near[q]
            keep = p < q
            if i != j:
                keep &= own[p] != own[q]
            p, q = p[keep], q[keep]
            if table and len(p):
                met = np.unique(np.concatenate([p, q]))
                cuts = _cuts(x[met], tables, bits)[:, :table]
                new = ~(cuts[np.searchsorted(met, p)] == cuts[np.searchsorted(met, q)]).any(axis=1)
                p, q = p[new], q[new]
            for s in range(0, len(p), 20_000):
                u, v = p[s : s + 20_000], q[s : s + 20_000]
                true = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                u, v = u[true], v[true]
                np.add.at(links, u, weight[v])
                np.add.at(links, v, weight[u])
                a.append(u), b.append(v)
        linked = np.flatnonzero(links)
        if not len(linked):
            return None
        root = forest(np.concatenate(a), np.concatenate(b), len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[root[linked]]), pa.array(links[linked])], ["id", "towards", "links"])

    return fn


def _counting(dim: int) -> np.ndarray:
    return np.random.default_rng(77_000_003 + dim).standard_normal((dim, COUNTED))


def link_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    # single precision is carried as it is; all arithmetic is in double
    vector = F.col(vector_col)
    if rows.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    fit = (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    base = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(fit, F.lit(False)).alias("fit"))
    # equal vectors are found by their exact components
    named = base.where("fit and id is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    named = stored(named.withColumn("key", F.sha2(F.to_json("vector").cast("binary"), 256)), "vectors")
    same = stored(named.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "same")
    reps = stored(named.drop("key").join(same.drop("key"), "id"), "reps")
    n = reps.count()
    bits, tables = shape(n, cosine)
    dealt = stored(reps.select("id", "vector").mapInArrow(_deal(tables, bits), "dim long, table long, cut long, id long"), "dealt")
    cut = ["dim", "table", "cut"]
    size = stored(dealt.groupBy(*cut).agg(F.ceil(F.count("*") / BLOCK).alias("nb"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "cuts")
    member = dealt.join(size, cut).join(reps, "id")
    block = member.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")))
    block = block.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    block = block.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "nb")
    found = stored(grouped(block, [*cut, "i", "j"], _verified(cosine, least_collisions(cosine), tables, bits), "id long, towards long, links long"), "found")
    root = stored(components(found.select(F.col("id").alias("a"), F.col("towards").alias("b"))), "roots")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    rep = stored(same.select("key", F.col("id").alias("rep"), "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(root.withColumnRenamed("id", "rep"), "rep", "left"), "answers")
    got = named.select("id", "key").join(rep, "key").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = base.select("id", "fit").join(got, "id", "left")
    out = out.select("id", F.when(F.col("fit"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(F.col("fit"), F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_embedding_dedup(embeddings: DataFrame) -> DataFrame:
    return link_vectors(embeddings)

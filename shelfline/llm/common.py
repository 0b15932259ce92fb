"""Shared pieces: written intermediate tables, what workers remember, contiguous groups of Arrow rows, connected components, word hashes."""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared checkpoint folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- memory of the workers ----------------------------------------------------------------------------------------

_memory: tuple[str, dict] = ("", {})


def memory(owner: str) -> dict:
    """What this process remembers between tasks of one operator.  Python workers are reused by later stages, so a task of
    another operator drops it first: a worker never holds the memories of two."""
    global _memory
    if _memory[0] != owner:
        dropped = len(_memory[1])
        _memory = (owner, {})
        if dropped:
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()
    return _memory[1]


def _trim() -> None:
    """Hands freed memory back to the system where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# ---- groups -------------------------------------------------------------------------------------------------------

def _keys_of(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)


def contiguous(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal (long, not null) keys from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = _keys_of(batch, keys)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(k[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over each group of equal keys; callers bound the rows of a group."""

    def run(batches):
        memory("groups")
        for rows in contiguous(batches, keys):
            out = fn(rows)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


# ---- components ---------------------------------------------------------------------------------------------------

def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index for each of n nodes under the links a-b, inside one block."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of links(a, b): root is the smallest id reachable.

    Each round sends every node to its smallest neighbour, shortens the chains once, and contracts the links; a
    star vanishes in one round, a path at least halves.  Only counts come back to the driver."""
    e = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        near = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
        up = stored(near.select("id", F.least("id", "m").alias("p")), "up")
        top = up.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        up = stored(up.join(top, "p", "left").select("id", F.coalesce("pp", "p").alias("p")), "up")
        rounds.append(up)
        pa_, pb = (up.select(F.col("id").alias(k), F.col("p").alias("p" + k)) for k in "ab")
        e = e.join(pa_, "a").select("b", "pa").join(pb, "b").where("pa <> pb")
        e = stored(e.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
    roots = rounds[-1].select("id", F.col("p").alias("root"))
    for up in reversed(rounds[:-1]):
        known = roots.select(F.col("id").alias("p"), "root")
        roots = stored(up.join(known, "p", "left").select("id", F.coalesce("root", "p").alias("root")), "roots")
    return roots


# ---- words --------------------------------------------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]))


def _word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words [^ \\t-\\r]+ in order, A-Z lowered; texts go through in pieces cut at white space."""
    out, start = [], 0
    while start < len(text):
        end = min(start + _PIECE, len(text))
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        b = np.frombuffer(text, np.uint8, end - start, start)
        word = ~_SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        if len(first):
            # Horner sums over the whole piece; a word's own sum is a difference, moved back by its start
            inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * _powers(len(b), _BASE), dtype=np.uint64)])
            out.append(_mix((sums[last] - sums[first]) * _powers(len(b), inv)[first] + (last - first).astype(np.uint64)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence as one when it is shorter."""
    h = _word_hashes(text) if text else np.zeros(0, np.uint64)
    k = min(words, len(h))
    if k == 0:
        return h
    s = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        s = s * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
    return np.unique(_mix(s))

"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of lower-case words.  A CGK embedding reads a window with a random walk: at step j the word under the
pointer is written and a random bit of (j, word) says whether the pointer moves on.  Few edits change few written words,
so edit distance becomes Hamming distance.  A key is the words written at a few sampled steps; windows that agree with an
item on a key of any repetition are candidates, and the number of repetitions is set from edited copies of the items so
that TARGET of those at the allowed distance are met, for each size and number of shares; when MOST_REPEATS do not, it fails.  Candidates are verified by exact word edit distance.

Windows have the size of the items or, for items that are longer than LONGEST words, of equal shares of them: one of the
shares holds no more than its part of the edits.  An item whose shares have n words belongs to the largest size of a
geometric list not above n, and is indexed by all its windows of that size; documents are read at every word.  Before the
walk, windows are dropped that hold too few of the benchmark's word pairs to be within the allowed distance of a share: an
edit breaks two at most.

A document is contaminated by an item when some stretch of it is within ERRORS * (words of the item) word edits.

The benchmark is read in parts of at most PART characters each, so what a task holds is bounded; there is no shuffle.

Edge cases: null or empty texts and items match nothing, as do items under LEAST words; equal items are reported by each
id; a document without id is reported with a null id; repeated rows are each reported; texts of any length are read
whole; other columns are not read.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memory

ERRORS, TARGET, LEAST = 0.2, 0.995, 5
SAMPLES, MOST_REPEATS = 4, 1000
LONGEST = 40
COPIES, TRIED = 400, 200_000  # copies the repetitions are set from, and windows of theirs beyond which no item is added
PAIR_BITS = 22
PART, CHUNK = 4_000_000, 4_000_000
SEED = 20240613
_WORD = re.compile(r"\w+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def size_class(n: int) -> int:
    w = LEAST
    while (up := max(w + 1, int(w * 1.25))) <= n:
        w = up
    return w


def shares(n: int) -> int:
    """Shares of an item of n words."""
    return -(-n // LONGEST)


def allowed(n: int) -> int:
    return int(ERRORS * n)


class Walk:
    """Keys of windows of one size, for one repetition."""

    def __init__(self, size: int, repeat: int, vocabulary: int):
        rng = np.random.default_rng([SEED, size, repeat])
        self.size = size
        # a key samples steps of the whole walk; the pointer reaches the window's end at about step 2 * size
        self.steps = np.sort(rng.choice(2 * size, SAMPLES, replace=False))
        self.moves = rng.integers(0, 2, (int(self.steps[-1]) + 1, vocabulary), dtype=np.int8)

    def keys(self, words_: np.ndarray, start: np.ndarray) -> np.ndarray:
        at, key = np.zeros(len(start), np.int64), np.zeros(len(start), np.uint64)
        sampled = set(self.steps.tolist())
        for j in range(int(self.steps[-1]) + 1):
            now = np.where(at < self.size, words_[np.minimum(start + at, len(words_) - 1)], 1)
            if j in sampled:
                key = (key ^ now.astype(np.uint64)) * _MULTIPLY
                key ^= key >> np.uint64(31)
            at += self.moves[j, now]
        return key


def infix_distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of item to a stretch of text, and where the first such stretch ends; bit-parallel."""
    n, masks = len(item), {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, dist, best, end = full, 0, n, n, 0
    for k, w in enumerate(text):
        eq = masks.get(w, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | full & ~(across | up), up & across
        dist += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | full & ~((eq | down) | plus), plus & (eq | down)
        if dist < best:
            best, end = dist, k + 1
    return best, end


class Index(dict):
    """0 for a word that is not there."""

    def __missing__(self, key):
        return 0


class Finder:
    """Index of a part of the benchmark: 0 stands for any other word, 1 for nothing."""

    def __init__(self, items: list[tuple[int | None, str]]):
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if len(w) >= LEAST]
        self.ids = [i for i, _ in split]
        self.word = Index((w, k + 2) for k, w in enumerate(sorted({w for _, ws in split for w in ws})))
        self.items = [[self.word[w] for w in ws] for _, ws in split]
        total = len(self.word) + 2
        # word pairs of the items, by hash: a superset, as it only rules windows out
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for item in self.items:
            x = np.array(item)
            self.pairs[self._pair(x)] = True
        self.classes = {}
        size_of = [size_class(len(x) // shares(len(x))) for x in self.items]
        for size in sorted(set(size_of)):
            self.classes[size] = self._class(size, [k for k, s in enumerate(size_of) if s == size], total)
        self.pad = 1 + max((allowed(len(x)) for x in self.items), default=0)

    def _class(self, size: int, own: list[int], total: int):
        flat = np.concatenate([np.array(self.items[k] + [1] * size) for k in own])
        first = np.cumsum([0] + [len(self.items[k]) + size for k in own])[:-1]
        start = np.concatenate([f + np.arange(len(self.items[k]) - size + 1) for f, k in zip(first, own)])
        item = np.repeat(own, [len(self.items[k]) - size + 1 for k in own])
        offset = np.concatenate([np.arange(len(self.items[k]) - size + 1) for k in own])
        repeats = self._repeats(size, own, total)
        tables = []
        for r in range(repeats):
            walk = Walk(size, r, total)
            key = walk.keys(flat, start)
            order = np.argsort(key, kind="stable")
            tables.append((walk, key[order], order.astype(np.int32)))
        # a window within reach of a share holds at least so many of the benchmark's word pairs
        return tables, item, offset, size - 1 - 2 * max(allowed(len(x)) // shares(len(x)) for x in map(self.items.__getitem__, own))

    @staticmethod
    def _pair(x: np.ndarray) -> np.ndarray:
        h = (x[:-1].astype(np.uint64) << np.uint64(32) | x[1:].astype(np.uint64)) * _MULTIPLY
        return h >> np.uint64(64 - PAIR_BITS)

    def _repeats(self, size: int, own: list[int], total: int) -> int:
        """Repetitions that meet TARGET of copies with the allowed number of random edits, whatever their number of shares."""
        rng = np.random.default_rng([SEED, size])
        groups: dict[int, list[int]] = {}
        for k in rng.permutation(own).tolist():
            groups.setdefault(shares(len(self.items[k])), []).append(k)
        most = 0
        for group in groups.values():
            length = np.cumsum([len(self.items[k]) * max(4, -(-COPIES // len(group))) for k in group])
            picked = group[: max(1, int(np.searchsorted(length, TRIED)))][:COPIES]
            flat, start, copy, at = [], [], [], 0
            for c in range(len(picked) * max(4, -(-COPIES // len(picked)))):
                item = self.items[picked[c % len(picked)]]
                x = list(item)
                for _ in range(allowed(len(x))):
                    p, kind = int(rng.integers(len(x))), int(rng.integers(3))
                    x[p : p + (kind != 1)] = [] if kind == 0 else [0]
                for side, y in ((0, item), (1, x)):
                    begin = np.arange(len(item) - size + 1 if not side else max(1, len(y)))
                    flat.append(np.array(y + [1] * size)), start.append(at + begin), copy.append(np.full(len(begin), 2 * c + side))
                    at += len(y) + size
            flat, start, copy = (np.concatenate(v) for v in (flat, start, copy))
            missed = np.ones(c + 1, bool)
            for r in range(MOST_REPEATS):
                live = missed[copy >> 1]
                key, of = Walk(size, r, total).keys(flat, start[live]), copy[live]
                key = key ^ (of >> 1).astype(np.uint64) * _MULTIPLY  # keys count within a copy only
                missed[of[(of & 1 == 1) & np.isin(key, key[of & 1 == 0])] >> 1] = False
                if 1 - missed.mean() >= TARGET:
                    most = max(most, r + 1)
                    break
            else:
                raise ValueError(f"{MOST_REPEATS} repetitions meet {1 - missed.mean():.4f} of copies in windows of {size} words, not {TARGET}")
        return most

    def ids_of(self, text: str | None) -> np.ndarray:
        ws = words(text)
        return np.fromiter(map(self.word.__getitem__, ws), np.int32, len(ws))

    def search(self, texts: list[np.ndarray]):
        """(text, item, first word, last word + 1, distance) of every contaminated stretch, best per text and item."""
        gap = np.ones(self.pad, np.int32)
        tok = np.concatenate([part for ids in texts for part in (ids, gap)])
        size_of = np.array([len(ids) for ids in texts])
        first = np.cumsum(size_of + self.pad) - size_of - self.pad
        of = np.repeat(np.arange(len(texts)), size_of + self.pad)
        known = self.pairs[self._pair(tok)] & (tok[:-1] > 1) & (tok[1:] > 1)
        pairs = np.concatenate([[0], np.cumsum(known, dtype=np.int32)])
        found = {}
        for size, (tables, item, offset, least) in self.classes.items():
            # pairs[k] counts those that start before k; a window of that size starts size - 1 of them
            span = min(size - 1, len(pairs) - 1)
            begin = np.flatnonzero(np.concatenate([pairs[span:], np.full(span, pairs[-1])])[: len(tok)] - pairs[: len(tok)] >= least)
            begin = begin[tok[begin] != 1]
            if not len(begin):
                continue
            seen = set()
            for walk, key, order in tables:
                asked = walk.keys(tok, begin)
                low, high = np.searchsorted(key, asked), np.searchsorted(key, asked, side="right")
                for k in np.flatnonzero(high > low):
                    for h in range(low[k], high[k]):
                        seen.add((int(of[begin[k]]), int(item[order[h]]), int(begin[k] - offset[order[h]])))
            for t, i, at in sorted(seen):
                self._verify(found, t, i, at, tok, int(first[t]), int(size_of[t]))
        return [(t, i, a, b, d) for (t, i), (d, a, b, _) in sorted(found.items())]

    def _verify(self, found, t, i, at, tok, first, size):
        item = self.items[i]
        reach = allowed(len(item))
        low, high = max(first, at - reach), min(first + size, at + len(item) + reach)
        held = found.get((t, i))
        if held and (held[0] == 0 or held[3][0] <= low and high <= held[3][1]):
            return
        text = tok[low:high].tolist()
        dist, end = infix_distance(item, text)
        if dist <= reach and (not held or dist < held[0]):
            back, begin = infix_distance(item[::-1], text[:end][::-1])
            found[t, i] = (dist, low - first + end - begin, low - first + end, (low, high))


def _finder(items) -> Finder:
    key = hash(tuple(items))
    held = memory("decontaminate")
    if key not in held:
        held.clear()
        held[key] = Finder(items)
    return held[key]


def _parts(benchmark: DataFrame, id_col: str, text_col: str):
    """The items, in parts of about PART characters."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    chars = items.select(F.sum(F.char_length("t"))).first()[0] or 0
    count = 1 + chars // PART
    for k in range(count):
        yield sorted(((r.i, r.t) for r in items.where(F.pmod(F.xxhash64("t", "i"), F.lit(count)) == k).collect()), key=lambda x: (x[1], -1 if x[0] is None else x[0]))


def find(docs: DataFrame, items: list, keep: list, text_col: str = "text") -> DataFrame:
    """keep columns and found: array of (item_id, first word, word after the last, distance), for one part of the items."""
    base = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    one = T.StructType().add("item_id", "long").add("first", "long").add("after", "long").add("distance", "long")

    def run(batches):
        finder = _finder(items)
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "first", "after", "distance")]))
        for batch in batches:
            got: list[list] = [[] for _ in range(batch.num_rows)]
            texts, rows, size = [], [], 0
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                texts.append(finder.ids_of(text.as_py())), rows.append(k)
                size += len(texts[-1])
                if size >= CHUNK or k + 1 == batch.num_rows:
                    for t, i, a, b, d in finder.search(texts):
                        got[rows[t]].append(dict(item_id=finder.ids[i], first=a, after=b, distance=d))
                    texts, rows, size = [], [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, kind)], [*batch.schema.names[:-1], "found"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], T.StructField("found", T.ArrayType(one))]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, first_word, after_word, distance): a row for each document and item in it."""
    out = None
    for items in _parts(benchmark, item_col, item_text_col):
        got = find(docs, items, [F.col(id_col)], text_col).select(F.col(id_col), F.explode("found").alias("f"))
        got = got.select(id_col, F.col("f.item_id").alias("item_id"), F.col("f.first").alias("first_word"), F.col("f.after").alias("after_word"), F.col("f.distance").alias("distance"))
        out = got if out is None else out.union(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones."""
    for items in _parts(benchmark, item_col, item_text_col):
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
        docs = find(docs, items, [row], text_col).where(F.size("found") == 0).select("_row.*")
    return docs


def op3_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)

"""Names scored against synonyms over Arrow batches, the best of each file kept.

A name is scored once a task (a bounded memory), and only the rows that can be among a file's best leave the task: neither
the names of a file nor their scores cross an exchange whole."""
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 131_072      # rows ranked at once
REMEMBERED = 200_000  # scored names a task keeps
RESULT = "file_id {file_id}, header string, canonical string, score double"


class Scorer:
    """Base score of a cleaned name for each field: the best over the field's synonyms."""

    def __init__(self, synonyms: dict):
        pairs = sorted(((len(s), s, k) for k, names in enumerate(synonyms.values()) for s in names))
        self.fields, self.size = len(synonyms), np.array([n for n, _, _ in pairs])
        self.field = np.array([k for _, _, k in pairs])
        self.letters = np.zeros((int(self.size.max()), len(pairs)), np.uint8)
        for i, (n, s, _) in enumerate(pairs):
            self.letters[:n, i] = np.frombuffer(s.encode(), np.uint8)
        self.begins = [re.compile("|".join(names)) for names in synonyms.values()]
        # what a name that is part of a synonym scores: begins it 0.85, inside it 0.7
        self.parts: dict = {}
        for k, names in enumerate(synonyms.values()):
            for s in names:
                for i in range(len(s)):
                    for j in range(i + 1, len(s) + 1):
                        part = self.parts.setdefault(s[i:j], {})
                        part[k] = max(part.get(k, 0.0), 0.85 if i == 0 else 0.7)

    def __call__(self, names: list) -> np.ndarray:
        out = np.zeros((len(names), self.fields))
        length = np.array([len(h) for h in names])
        for n in np.unique(length[length > 0]):
            rows = np.flatnonzero(length == n)
            a = np.frombuffer("".join([names[i] for i in rows]).encode(), np.uint8).reshape(len(rows), n)
            near = 1.0 - self._distances(a) / np.maximum(n, self.size)
            for k in range(self.fields):
                out[rows, k] = near[:, self.field == k].max(1)
        for i, h in enumerate(names):
            if h:
                for k, known in enumerate(self.begins):
                    if known.match(h):
                        out[i, k] = max(out[i, k], 0.85)
                    elif known.search(h):
                        out[i, k] = max(out[i, k], 0.7)
                for k, v in self.parts.get(h, {}).items():
                    out[i, k] = max(out[i, k], v)
        return out

    def _distances(self, a: np.ndarray) -> np.ndarray:
        """Edit distances of names of one length to all synonyms, one column of the tables at a time."""
        kind = np.int16 if a.shape[1] < 30_000 else np.int32
        shape, n = (len(a), len(self.size)), a.shape[1]
        col = [np.full(shape, i, kind) for i in range(n + 1)]
        out = np.empty(shape, kind)
        for j, letters in enumerate(self.letters):
            diagonal, col[0] = col[0], np.full(shape, j + 1, kind)
            for i in range(n):
                cell = np.minimum(np.minimum(col[i], col[i + 1]) + 1, diagonal + (a[:, i, None] != letters))
                diagonal, col[i + 1] = col[i + 1], cell.astype(kind, copy=False)
            done = self.size == j + 1
            out[:, done] = col[n][:, done]
        return out


class Memory:
    """Scores of the names a task has met, forgotten when there are too many."""

    def __init__(self, scorer: Scorer):
        self.scorer = scorer
        self.forget()

    def forget(self):
        self.at, self.scores = {}, np.zeros((0, self.scorer.fields))

    def __call__(self, names: list, clean: list) -> np.ndarray:
        if len(self.at) > REMEMBERED:
            self.forget()
        new = [i for i, w in enumerate(names) if w not in self.at]
        if new:
            self.at.update((names[i], len(self.scores) + k) for k, i in enumerate(new))
            self.scores = np.concatenate([self.scores, self.scorer([clean[i] for i in new])])
        return self.scores[[self.at[w] for w in names]]


def _best(t: pa.Table, memory: Memory, fields: pa.Array, bonus: dict, best: int) -> pa.RecordBatch:
    """The `best` highest rows of each file and field, ties to the smaller header."""
    coded = lambda c: t[c].combine_chunks().dictionary_encode(null_encoding="encode")
    file, header, kind = coded("file_id"), coded("header"), coded("dtype")
    codes = lambda d: d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    f, w, d = codes(file), codes(header), codes(kind)
    names = header.dictionary.to_pylist()
    # the cleaned form is a function of the header: any of its rows has it
    first = np.empty(len(names), np.int64)
    first[w] = np.arange(len(w))
    base = memory(names, t["_h"].combine_chunks().take(pa.array(first)).to_pylist())
    extra = np.array([bonus.get(x, np.zeros(len(fields))) for x in kind.dictionary.to_pylist()])
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    rows, field, score = [], [], []
    for k in range(len(fields)):
        units = np.rint(np.minimum(1.0, base[w, k] + extra[d, k]) * 1e6).astype(np.int64)
        # order by file, score downwards, header: 22, 20 and 20 bits
        order = np.argsort((f << 41) | ((1_000_000 - units) << 20) | place[w], kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(f[order]) != 0])
        run = np.diff(np.r_[begin, len(order)])
        kept = order[np.arange(len(order)) - np.repeat(begin, run) < best]
        rows.append(kept), field.append(np.full(len(kept), k)), score.append(units[kept] / 1e6)
    rows = np.concatenate(rows)
    pick = lambda d, i: d.dictionary.take(pa.array(i))
    return pa.RecordBatch.from_arrays([pick(file, f[rows]), pick(header, w[rows]), fields.take(pa.array(np.concatenate(field))),
                                       pa.array(np.concatenate(score))], ["file_id", "header", "canonical", "score"])


def best_scores(headers: DataFrame, synonyms: dict, bonus: dict, best: int) -> DataFrame:
    """(file_id, header, dtype, _h: cleaned header) to (file_id, header, canonical, score): per task at least the `best` highest
    rows of a file and field.  `bonus` gives what a dtype adds to each field."""
    names, extra = list(synonyms), {d: np.array([add.get(c, 0.0) for c in synonyms]) for d, add in bonus.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, fields, held, n = Memory(Scorer(synonyms)), pa.array(names), [], 0
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                yield _best(pa.Table.from_batches(held), memory, fields, extra, best)
                held, n = [], 0
        if n:
            yield _best(pa.Table.from_batches(held), memory, fields, extra, best)

    return headers.mapInArrow(run, RESULT.format(file_id=headers.schema["file_id"].dataType.simpleString()))

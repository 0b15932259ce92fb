"""Language-model scoring by partial matching over bytes.

The model is a trie of byte contexts of up to ORDER symbols, counted over all training texts.  A text is coded whole: its
bytes with A-Z lowered, white space as it stands, then an end; contexts run over the whole text, past words and blanks, and
before its first byte stands the edge symbol.  An unseen symbol escapes to the next shorter context (escape method C:
distinct / (total + distinct)), where the symbols already seen in the longer one are excluded.  Because every context's
symbols occur in its suffix too, the excluded mass is one number per context.

The trie is dealt to buckets by the last three context symbols.  A gram has its context backwards (the last symbol first)
in the high bits, so the sorted grams of a bucket hold the contexts of three to ORDER symbols as runs; contexts of two
symbols come with the grams of that length, which go to the SUBS buckets that share them.  Only grams of one and two
symbols (at most 66,049) are known to all tasks.

Texts are dealt to chunks of about CHUNK bytes; a longer text is cut at white space into pieces that know the bytes before
them.  A chunk sends its distinct grams with their training counts to their buckets, packed into one row a bucket, and its
distinct words likewise by their hash.  A bucket adds up the counts of all chunks and answers every row with the code
lengths, or the word counts, in the order of the row, so answers carry no grams; the chunk adds them up per text.  Packed
rows grow with the text, buckets with its size, and a gram or word that all texts share is one entry a chunk.

Edge cases: a null or empty text is the end alone, a blank one its blanks and the end; a row without id counts as training
and keeps its row; without training rows all symbols are alike; repeated rows are scored and counted each; an empty table
gives an empty result; other columns are not read.  A word longer than CHUNK is not cut.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _mix, grouped, memory, stored

ORDER = 5                   # context symbols
BITS, EDGE = 9, 256         # a symbol is a byte or the edge of a text; a context and its symbol fit in one long
ALPHABET = 257
CHUNK, CHUNK_DOCS = 4 << 20, 1 << 16
SUBS = 4                    # buckets that share contexts of two symbols
LOW, GRAMS, WORDS, SIZE = range(4)  # kinds of packed rows
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


# ---- chunks -------------------------------------------------------------------------------------------------------

def pieces_of(text: bytes, most: int):
    """(start, end) of the pieces of a text: about so many bytes, cut before white space."""
    start = 0
    while len(text) - start > most and (m := _BLANK.search(text, start + most)):
        yield start, m.start()
        start = m.start()
    yield start, len(text)


def gram_keys(blob: bytes, sizes: np.ndarray, before: bytes, unended: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every coded symbol of the pieces: its gram (ORDER symbols, the last one first, and itself) and its piece.

    before: bytes ahead of the first piece, if it goes on with a text; unended: the last piece's text goes on."""
    width = sizes + ORDER + 1
    start = np.cumsum(width) - width
    symbol = np.full(int(width.sum()), EDGE, np.int64)
    coded = np.zeros(len(symbol), bool)
    at = np.repeat(start + ORDER - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    symbol[at] = np.frombuffer(blob, np.uint8)
    coded[at] = True
    coded[start + width - 1] = True
    symbol[ORDER - len(before) : ORDER] = np.frombuffer(before, np.uint8)
    piece = np.repeat(np.arange(len(sizes)), sizes + 1)
    if unended:
        coded[-1], piece = False, piece[:-1]
    key = symbol.copy()
    for back in range(1, ORDER + 1):
        key[back:] |= symbol[:-back] << BITS * (ORDER + 1 - back)
    return key[coded], piece


_TEXTS = "chunk long, row long, ids array<long>, held array<boolean>, text binary, sizes binary, before binary, unended boolean"


def _chunk(chunk: int, row: int, ids: list, held: list, texts: list[bytes], before: bytes, unended: bool) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts], "<i8").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([row]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([_press(b"".join(texts))], pa.binary()),
                                       pa.array([sizes], pa.binary()), pa.array([before], pa.binary()), pa.array([unended])], ["chunk", "row", "ids", "held", "text", "sizes", "before", "unended"])


def _chunks(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """A row of texts for each chunk."""
    def run(batches):
        from pyspark import TaskContext

        memory("ppm")
        chunk, row = TaskContext.get().partitionId() << 24, TaskContext.get().partitionId() << 40
        ids, held, texts, before, size = [], [], [], b"", 0
        for batch in batches:
            for id_, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = (text.as_py() or b"").lower()
                for a, b in pieces_of(text, most):
                    if ids and (size + b - a > most or len(ids) == CHUNK_DOCS):
                        yield _chunk(chunk, row - len(ids), ids, held, texts, before, False)
                        chunk += 1
                        ids, held, texts, before, size = [], [], [], b"", 0
                    if a:
                        before = text[a - ORDER : a]
                    ids.append(id_), held.append(out), texts.append(text[a:b])
                    size += b - a
                    row += 1
                    if b < len(text):  # the next piece is of the same row
                        yield _chunk(chunk, row - len(ids), ids, held, texts, before, True)
                        chunk, row = chunk + 1, row - 1
                        ids, held, texts, before, size = [], [], [], b"", 0
        if ids:
            yield _chunk(chunk, row - len(ids), ids, held, texts, before, False)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("out"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, _TEXTS)


# ---- packed rows --------------------------------------------------------------------------------------------------

def _press(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _plain(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, ..."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.copy().view(kind).ravel()


def pack_grams(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending grams and their counts."""
    return _press(_planes(np.diff(keys, prepend=0).astype("<i8")) + _planes(n.astype("<u4")))


def unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = _plain(data)
    n = len(data) // 12
    return np.cumsum(_unplanes(data, "<i8", n)), _unplanes(data[8 * n :], "<u4", n)


def pack_answers(lp: np.ndarray, n: np.ndarray, mass: np.ndarray) -> bytes:
    """Code lengths of a row's grams: of those met with all ORDER symbols the count and the context's mass (runs of it once),
    both whole numbers and small; of the others the code length itself."""
    miss, first = n == 0, _runs(mass)
    begins = np.zeros(len(mass), bool)
    begins[first] = True
    return _press(b"".join([len(mass).to_bytes(8, "little"), np.packbits(begins).tobytes(), _planes(mass[first].astype("<i8")), _planes(np.where(miss, 0, mass - n).astype("<i8")), lp[miss].astype("<f8").tobytes()]))


def unpack_answers(data: bytes) -> np.ndarray:
    data = _plain(data)
    size, at = int.from_bytes(data[:8], "little"), 8 + (int.from_bytes(data[:8], "little") + 7) // 8
    begins = np.unpackbits(np.frombuffer(data, np.uint8, at - 8, 8), count=size)
    runs = int(begins.sum())
    mass = _unplanes(data[at:], "<i8", runs)[np.cumsum(begins) - 1]
    rest = _unplanes(data[at + 8 * runs :], "<i8", size)  # what the other symbols and the escape have of the mass
    lp, miss = np.empty(size), rest == 0
    lp[~miss] = np.log10((mass - rest)[~miss] / mass[~miss])
    lp[miss] = np.frombuffer(data, "<f8", int(miss.sum()), at + 8 * (runs + size))
    return lp


# ---- what a chunk sends -------------------------------------------------------------------------------------------

def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _buckets(keys: np.ndarray, groups: int) -> np.ndarray:
    """Bucket of every gram, by its last three context symbols; those of equal last two are in SUBS buckets in a row."""
    low = np.uint64(groups)
    first = _mix((keys >> 4 * BITS).astype(np.uint64)) % low
    return (first * np.uint64(SUBS) + _mix((keys >> 3 * BITS).astype(np.uint64)) % np.uint64(SUBS)).astype(np.int32)


def _dealt(bucket: np.ndarray, count: int) -> tuple[np.ndarray, list[int]]:
    """Order by bucket and the ends of each."""
    return np.argsort(bucket, kind="stable"), [0, *np.cumsum(np.bincount(bucket, minlength=count)).tolist()]


def _words(texts: list[bytes], held: list[bool], unended: bool) -> tuple[list[list[bytes]], Counter[bytes]]:
    """Tokens of each text, and the training counts of all: those of training first, in order."""
    tokens = [t.split() for t in texts]
    for own in tokens[: len(tokens) - unended]:
        own.append(b"")  # the end
    count: Counter[bytes] = Counter()
    for own, out in zip(tokens, held):
        if not out:
            count.update(own)
    for own, out in zip(tokens, held):
        if out:
            for w in own:
                if w not in count:
                    count[w] = 0
    return tokens, count


def _word_buckets(words, count: int) -> np.ndarray:
    return (np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % count).astype(np.int32)


def _opened(one: dict) -> tuple[bytes, np.ndarray, list[bytes]]:
    """Bytes, sizes and texts of a chunk."""
    blob, sizes = _plain(one["text"]), np.frombuffer(one["sizes"], "<i8")
    ends = [0, *np.cumsum(sizes).tolist()]
    return blob, sizes, [blob[a:b] for a, b in zip(ends, ends[1:])]


def _each(batches):
    memory("ppm")
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def short_grams(chunks: DataFrame) -> tuple[np.ndarray, int]:
    """Training counts by (symbol before, symbol), and the bytes of all texts."""

    def run(batches):
        count, size = np.zeros(1 << 2 * BITS, np.int64), 0
        for one in _each(batches):
            blob, sizes, _ = _opened(one)
            key, piece = gram_keys(blob, sizes, one["before"], one["unended"])
            key = key[~np.array(one["held"])[piece]]
            count += np.bincount(key >> ORDER * BITS << BITS | key & (1 << BITS) - 1, minlength=len(count))
            size += len(blob)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()]), pa.array([size, *count[some].tolist()])], ["key", "n"])

    got = chunks.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(1 << 2 * BITS, np.int64)
    for key, n in got:
        if key >= 0:
            count[key] = n
    return count.reshape(1 << BITS, 1 << BITS), sum(n for key, n in got if key < 0)


_PACKED = "bucket int, kind int, chunk long, data binary, n long, v long"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["bucket", "kind", "chunk", "data", "n", "v"])


def _sent(chunks: DataFrame, groups: int) -> DataFrame:
    """Packed grams and words of every chunk; buckets of words follow those of grams."""
    count = groups * SUBS

    def run(batches):
        for one in _each(batches):
            blob, sizes, texts = _opened(one)
            key, piece = gram_keys(blob, sizes, one["before"], one["unended"])
            both = np.sort(key << 1 | np.array(one["held"])[piece])
            first, rows = _runs(both >> 1), []
            if len(first):
                key, train = both[first] >> 1, np.add.reduceat(1 - (both & 1), first)
                order, ends = _dealt(_buckets(key, groups), count)
                for k, (a, b) in enumerate(zip(ends, ends[1:])):
                    if a < b:
                        rows.append((k, GRAMS, one["chunk"], pack_grams(key[order[a:b]], train[order[a:b]]), b - a, None))
                # grams of three symbols
                seen = train > 0
                low, n = key[seen] >> 4 * BITS << BITS | key[seen] & (1 << BITS) - 1, train[seen]
                order = np.argsort(low)
                low, n = low[order], n[order]
                first = _runs(low)
                if len(first):
                    low, n = low[first], np.add.reduceat(n, first)
                    order, ends = _dealt((_mix((low >> BITS).astype(np.uint64)) % np.uint64(groups)).astype(np.int32), groups)
                    for k, (a, b) in enumerate(zip(ends, ends[1:])):
                        if a < b:
                            data = pack_grams(low[order[a:b]], n[order[a:b]])
                            rows += [(k * SUBS + sub, LOW, one["chunk"], data, b - a, None) for sub in range(SUBS)]
            _, words = _words(texts, one["held"], one["unended"])
            if words:
                spelled, n = list(words), np.fromiter(words.values(), np.int64, len(words))
                order, ends = _dealt(_word_buckets(spelled, count), count)
                for k, (a, b) in enumerate(zip(ends, ends[1:])):
                    if a < b:
                        own = order[a:b]
                        rows.append((count + k, WORDS, one["chunk"], _press(_planes(n[own].astype("<u4")) + b" ".join([spelled[j] for j in own.tolist()])), b - a, None))
            if rows:
                yield _packed(rows)

    return chunks.mapInArrow(run, _PACKED)


# ---- what a bucket answers ----------------------------------------------------------------------------------------

def _contexts(keys: np.ndarray, n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each gram of a length, of its context: total, distinct symbols, and the mass that these have in the next shorter
    context; keys: sorted grams, below: count of each without the first symbol."""
    first = _runs(keys >> BITS)
    own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return tuple(np.bincount(own, weights=w, minlength=len(first))[own] for w in (n, n > 0, np.where(n > 0, below, 0)))


def code_lengths(keys: np.ndarray, n: np.ndarray, low: np.ndarray, low_n: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of the last symbol of every gram, given those before it, and the mass of its context of ORDER symbols.

    keys, n: all grams of a bucket that are asked for, sorted, and their training counts (0: not in training); low, low_n: the
    training grams of three symbols; short: training counts by (symbol before, symbol)."""
    last = (1 << BITS) - 1
    # (count of the gram, total, distinct symbols, excluded mass below) of every asked gram by length
    levels, up, now, count = [], np.arange(len(keys)), keys, n.astype(np.float64)

    def of_low(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(low, x), max(len(low) - 1, 0))
        return np.where(low[at] == x, low_n[at], 0).astype(np.float64) if len(low) else np.zeros(len(x))

    for length in range(ORDER, 2, -1):
        wide = now >> 2 * BITS << BITS | now & last  # the context's first symbol is the lowest one
        if length > 3:
            shorter, to = np.unique(wide, return_inverse=True)
            below = np.bincount(to, weights=count, minlength=len(shorter))
            levels.append((up, count, *_contexts(now, count, below[to])))
            up, now, count = to[up], shorter, below
        else:
            levels.append((up, count, *_contexts(now, count, of_low(wide))))
            now = wide
    # two symbols of context
    one, none = short.astype(np.float64), short.sum(axis=0).astype(np.float64)
    symbol = low & last
    # the last symbol stands first: of (c1, c2, s) the shorter gram is (c1, s)
    c1 = low >> 2 * BITS
    t2, q2, x2 = _contexts(low, low_n, one[c1, symbol]) if len(low) else (np.zeros(0),) * 3
    heads = _runs(low >> BITS)
    context = now >> BITS
    at = np.minimum(np.searchsorted(low[heads] >> BITS, context), max(len(heads) - 1, 0))
    met = (low[heads][at] >> BITS == context) if len(heads) else np.zeros(len(now), bool)
    two = [np.where(met, x[heads][at], 0.0) if len(heads) else np.zeros(len(now)) for x in (t2, q2, x2)]
    levels.append((up, of_low(now), *two))
    c1, symbol = now >> 2 * BITS, now & last
    levels.append((up, one[c1, symbol], one.sum(axis=1)[c1], (one > 0).sum(axis=1).astype(np.float64)[c1], np.where(one > 0, none, 0.0).sum(axis=1)[c1]))
    kinds = float((none > 0).sum())
    levels.append((up, none[symbol], *(np.full(len(now), x) for x in (none.sum(), kinds, 0.0))))

    lp, xt, xq = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys))
    rows = np.arange(len(keys))
    for to, *values in levels:
        own, t, q, x = (v[to[rows]] for v in values)
        left = q - xq[rows]
        mass, hit = t - xt[rows] + left, own > 0
        over = ~hit & (left > 0)
        lp[rows[hit]] += np.log10(own[hit] / mass[hit])
        lp[rows[over]] += np.log10(left[over] / mass[over])
        xt[rows], xq[rows] = x, q  # a context that never occurred excludes nothing
        rows = rows[~hit]
    lp[rows] -= np.log10(np.maximum(ALPHABET - xq[rows], 1))
    return lp, (levels[0][2] + levels[0][3]).astype(np.int64)


def _summed(packed: list[bytes]) -> tuple[np.ndarray, ...]:
    """Distinct grams, their counts, the place of every gram of the rows among them, and the ends of the rows."""
    keys, counts = zip(*map(unpack_grams, packed)) if packed else ([np.zeros(0, np.int64)], [np.zeros(0, "<u4")])
    ends = np.cumsum([len(k) for k in keys])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64), at, ends


def _answers(short: np.ndarray):
    def answer(rows: pa.Table) -> pa.RecordBatch | None:
        bucket, by = rows.column("bucket")[0].as_py(), {}
        for kind, chunk, data, n in zip(*(rows.column(c).to_pylist() for c in ("kind", "chunk", "data", "n"))):
            by.setdefault(kind, []).append((chunk, data, n))
        out = []
        if GRAMS in by:
            low, low_n, _, _ = _summed([d for _, d, _ in by.get(LOW, [])])
            keys, n, at, ends = _summed([d for _, d, _ in by[GRAMS]])
            lp, mass = code_lengths(keys, n, low, low_n, short)
            for (chunk, _, _), a, b in zip(by[GRAMS], [0, *ends.tolist()], ends.tolist()):
                out.append((bucket, GRAMS, chunk, pack_answers(lp[at[a:b]], n[at[a:b]], mass[at[a:b]]), None, None))
        if WORDS in by:
            count: dict[bytes, int] = {}
            spelled = []
            for _, data, n in by[WORDS]:
                data = _plain(data)
                spelled.append(data[4 * n :])
                for w, c in zip(spelled[-1].split(b" "), _unplanes(data, "<u4", n).tolist()):
                    count[w] = count.get(w, 0) + c
            for (chunk, _, n), own in zip(by[WORDS], spelled):
                c = np.fromiter(map(count.__getitem__, own.split(b" ")), "<i8", n)
                out.append((bucket, WORDS, chunk, _press(_planes(c)), n, None))
            out.append((bucket, SIZE, -1, None, sum(count.values()), sum(c > 0 for c in count.values())))
        return _packed(out) if out else None

    return answer


# ---- scores -------------------------------------------------------------------------------------------------------

def _sums(groups: int):
    def sums(rows: pa.Table) -> pa.RecordBatch:
        """Token counts and sums of the pieces of one chunk."""
        got = {GRAMS: [], WORDS: []}
        for kind, bucket, data, n in sorted(r for r in zip(*(rows.column(c).to_pylist() for c in ("kind", "bucket", "data", "n"))) if r[0] is not None):
            got[kind].append((data, n))
        one = rows.filter(rows.column("text").is_valid()).select(["row", "ids", "held", "text", "sizes", "before", "unended"]).to_pylist()[0]
        blob, sizes, texts = _opened(one)
        key, piece = gram_keys(blob, sizes, one["before"], one["unended"])
        order = np.argsort(key)
        key = key[order]
        first = _runs(key)
        score = np.zeros(len(sizes))
        if len(first):
            lp = np.empty(len(first))
            lp[_dealt(_buckets(key[first], groups), groups * SUBS)[0]] = np.concatenate([unpack_answers(d) for d, _ in got[GRAMS]])
            score = np.bincount(piece[order], weights=np.repeat(lp, np.diff(np.append(first, len(key)))), minlength=len(sizes))
        tokens, words = _words(texts, one["held"], one["unended"])
        c = np.empty(len(words), np.int64)
        if words:
            c[_dealt(_word_buckets(words, groups * SUBS), groups * SUBS)[0]] = np.concatenate([_unplanes(_plain(d), "<i8", n) for d, n in got[WORDS]])
        place = dict(zip(words, range(len(words))))
        base, known = np.log10(c + 0.1), c > 0
        length = np.array([len(own) for own in tokens], np.int64)
        at = np.fromiter((place[w] for own in tokens for w in own), np.int64, int(length.sum()))
        text = np.repeat(np.arange(len(tokens)), length)
        n_known = np.bincount(text, weights=known[at], minlength=len(tokens)).astype(np.int64)
        names = ["row", "id", "held", "n_tokens", "n_known", "base", "score"]
        return pa.RecordBatch.from_arrays([pa.array(one["row"] + np.arange(len(sizes))), pa.array(one["ids"], pa.int64()), pa.array(one["held"]), pa.array(length), pa.array(n_known),
                                           pa.array(np.bincount(text, weights=base[at], minlength=len(tokens))), pa.array(score)], names)

    return sums


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    chunks = stored(_chunks(docs, id_col, text_col, chunk), "chunks")
    short, size = short_grams(chunks)
    groups = max(1 + min(size >> 20, 15), size >> 27)
    answers = stored(grouped(_sent(chunks, groups), ["bucket"], _answers(short), _PACKED), "answers")
    total = answers.where(F.col("kind") == SIZE).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = total.n or 0, total.v or 0
    back = answers.where(F.col("kind") != SIZE).select("chunk", "kind", "bucket", "data", "n")
    sums = grouped(chunks.unionByName(back, allowMissingColumns=True), ["chunk"], _sums(groups), "row long, id long, held boolean, n_tokens long, n_known long, base double, score double")
    total = sums.groupBy("row", "id", "held").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    log_n = float(np.log10(n + 0.1 * (v + 1)))
    return total.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                        (F.col("base") - F.col("n_tokens") * F.lit(log_n)).alias("base_score"), "score")


def op6_lm_scoring(docs: DataFrame) -> DataFrame:
    return score(docs)

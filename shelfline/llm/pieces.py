"""Sub-word encoding with seeded merge-dropout, and decoding, over a SentencePiece BPE model.

A text is cut where no piece of the model can reach across: before a run of spaces, and around characters that occur in no
longer piece.  Each unit goes through an agenda of candidate merges, best score first, leftmost first; a candidate is
skipped when a keyed hash of (seed, document id, occurrence of the unit, place, merged piece) falls under the dropout rate,
so every occurrence in every document is cut on its own.  Without dropout the ids are the library's own.

What a worker remembers is a tree by unit: a node has the unit's ids when certain of its candidates are skipped, and the
candidates that are still open then; the first open one that an occurrence skips leads to the child.  A child is made when
it is asked for again; till then the agenda is replayed.  A unit gets a tree when it is met again, too: the first time it is only noted, as most
units of a corpus are rare.  All ways give the same ids.

Characters the model lacks become byte pieces, and so does a U+2581 that stands in the text, so that decoding gives the
text back exactly.

Edge cases: a null text has null pieces and decodes to null; an empty text has none; a document without id is keyed by its text;
texts of any length are encoded whole (units over LONG symbols by a heap); other columns are only passed on.
"""
from __future__ import annotations

import heapq
import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memory

SEED, RATE = 17, 0.1
LONG, CACHE = 64, 300_000
SPACE = "▁"
_NONE = np.int64(1) << 62


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(k) for k in range(n)]
        plain = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))]
        self.id_of = {self.pieces[k]: k for k in plain}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = {b: k for k, b in enumerate(self.byte)}
        self.raw = [bytes([self.bytes_of[k]]) if k in self.bytes_of else p.replace(SPACE, " ").encode() for k, p in enumerate(self.pieces)]
        self.raw_n = np.array([len(b) for b in self.raw], np.int64)
        self.raw_at, self.raw_flat = np.cumsum(self.raw_n) - self.raw_n, np.frombuffer(b"".join(self.raw), np.uint8)
        # rank of a merge: by score, the leftmost wins among equals
        order = {s: k for k, s in enumerate(sorted({sp.get_score(k) for k in plain}, reverse=True))}
        single = {p for p in self.id_of if len(p) == 1}
        longer = [p for p in self.id_of if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece holds a space after another character")
        pairs = {}
        for p in longer:
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (order[sp.get_score(self.id_of[p])], self.id_of[p])
        self.pair = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        inner = set("".join(longer))
        apart = sorted(c for c in map(chr, range(128)) if c not in inner and c != " ")
        self.cut = re.compile(f"[{re.escape(''.join(apart))}]| *[^ {re.escape(''.join(apart))}]+| +")
        self.single = {c: self.id_of[c] for c in single if c != SPACE} | {" ": self.id_of[SPACE]}

        # id of every character, or -1 minus its code point
        self.char_ids = -1 - np.arange(0x110000, dtype=np.int32)
        for c, k in self.single.items():
            self.char_ids[ord(c)] = k

    def units(self, text: str) -> list[str]:
        return self.cut.findall(" " + text) if text else []

    def symbols(self, unit: str) -> list[int]:
        """Ids of single characters; a character without one is -1 minus its code point."""
        return [self.single.get(c, -1 - ord(c)) for c in unit]

    def spell(self, ids: list[int]) -> list[int]:
        if min(ids) >= 0:
            return ids
        return [x for k in ids for x in ([k] if k >= 0 else [self.byte[b] for b in chr(-1 - k).encode()])]


def unit_key(unit: str, seed: int, variant: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(unit.encode(), seed=seed * 1_000_003 + variant)


def occurrence_keys(document: int, count: int, seed: int) -> np.ndarray:
    """Keys of the units of a document, in order."""
    own = _mix(np.array([document % 2**64], np.uint64) ^ _mix(np.array([seed % 2**64 + 1], np.uint64)))
    return _mix(own + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def candidate_hash(place: np.ndarray, merged: np.ndarray) -> np.ndarray:
    return _mix(place.astype(np.uint64) << np.uint64(32) | merged.astype(np.uint64))


def falls(key: np.ndarray, candidate: np.ndarray, rate: float) -> np.ndarray:
    return (_mix(key ^ candidate) >> np.uint64(11)).astype(np.float64) < rate * float(1 << 53)


def skipped(key: np.ndarray, place: np.ndarray, merged: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidate that makes this piece at this place of this unit is skipped."""
    return falls(key, candidate_hash(place, merged), rate)


def agenda(model: Model, unit: str, key: int, rate: float) -> list[int]:
    """One unit by a heap of candidates."""
    sym = model.symbols(unit)
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []
    k64 = np.array([key], np.uint64)

    def offer(i: int):
        j = after[i]
        if i >= 0 and j < n and sym[i] >= 0 and sym[j] >= 0:
            got = model.pair.get(sym[i] << 32 | sym[j])
            if got and not (rate and skipped(k64, np.array([i]), np.array([got[1]]), rate)[0]):
                heapq.heappush(heap, (got[0], i, sym[i], sym[j], got[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], alive[j] = new, False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return model.spell([s for s, live in zip(sym, alive) if live])


def encode_units(model: Model, units: list[str], keys: list[int], rate: float, stays=None) -> list[bytes]:
    """Little-endian 32-bit ids of all units at once: each round makes the best candidate of every unit that has one.

    stays: says of (unit, place, merged piece) of the candidates of a round which are not skipped, in place of the hash."""
    out: list[bytes] = [b""] * len(units)
    short = [k for k, u in enumerate(units) if len(u) <= LONG]
    if len(short) < len(units):
        for k, u in enumerate(units):
            if len(u) > LONG:
                out[k] = np.array(agenda(model, u, keys[k], rate), "<i4").tobytes()
    size = np.array([len(units[k]) for k in short], np.int64)
    sym = model.char_ids[np.frombuffer("".join(units[k] for k in short).encode("utf-32-le"), "<u4")].astype(np.int64)
    unit = np.repeat(np.arange(len(short)), size)
    place = np.arange(len(sym)) - np.repeat(np.cumsum(size) - size, size)
    key = np.array([keys[k] for k in short], np.uint64)

    def candidates(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order (rank, place) and merged piece of the pairs that start at i."""
        rank, made = np.full(len(i), _NONE), np.zeros(len(i), np.int64)
        j = np.minimum(i + 1, len(sym) - 1)
        a, b = sym[i], sym[j]
        ok = np.flatnonzero((i < j) & (unit[j] == unit[i]) & (a >= 0) & (b >= 0))
        want = a[ok] << 32 | b[ok]
        at = np.minimum(np.searchsorted(model.keys, want), len(model.keys) - 1)
        hit = model.keys[at] == want
        ok, at = ok[hit], at[hit]
        if stays or rate:
            live = stays(unit[i[ok]], place[i[ok]], model.merged[at]) if stays else ~skipped(key[unit[i[ok]]], place[i[ok]], model.merged[at], rate)
            ok, at = ok[live], at[live]
        rank[ok], made[ok] = model.rank[at] << 8 | place[i[ok]], model.merged[at]
        return rank, made

    best, made = candidates(np.arange(len(sym)))
    done = []
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        top = np.minimum.reduceat(best, first)
        counts = np.diff(np.concatenate([first, [len(sym)]]))
        over = top == _NONE
        if over.any():
            ended = np.repeat(over, counts)
            done.append((unit[ended], sym[ended]))
            stay = ~ended
            sym, unit, place, best, made = sym[stay], unit[stay], place[stay], best[stay], made[stay]
            top, counts = top[~over], counts[~over]
            if not len(sym):
                break
        i = np.flatnonzero(best == np.repeat(top, counts))
        sym[i] = made[i]
        stay = np.ones(len(sym), bool)
        stay[i + 1] = False
        moved = i - np.arange(len(i))  # where the merged symbols stand afterwards
        sym, unit, place, best, made = sym[stay], unit[stay], place[stay], best[stay], made[stay]
        again = np.concatenate([moved, np.maximum(moved - 1, 0)])
        best[again], made[again] = candidates(again)
    if done:
        unit, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(unit, kind="stable")
        unit, sym = unit[order], sym[order]
        ends = np.cumsum(np.bincount(unit, minlength=len(short)))
        odd = set(unit[sym < 0].tolist())
        flat, at = sym.astype("<i4").tobytes(), 0
        for g, end in enumerate((4 * ends).tolist()):
            out[short[g]] = flat[at:end]
            at = end
        for g in odd:
            out[short[g]] = np.array(model.spell(sym[0 if not g else ends[g - 1] : ends[g]].tolist()), "<i4").tobytes()
    return out


def _model(path: str) -> Model:
    """The model of a path, read once in a process."""
    held = memory("pieces")
    if ("model", path) not in held:
        held["model", path] = Model(path)
    return held["model", path]


class Column:
    """A growing array."""

    def __init__(self, kind):
        self.data, self.size = np.empty(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        while self.size + len(x) > len(self.data):
            more = np.empty(2 * len(self.data), self.data.dtype)  # the new half takes no memory until it is written
            more[: self.size] = self.data[: self.size]
            self.data = more
        self.data[self.size : self.size + len(x)] = x
        self.size += len(x)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same for the others."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Trees:
    """What becomes of units under dropout, by the candidates that are skipped."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.root: dict[str, int] = {}
        self.once: set[str] = set()  # units met once, without a tree
        self.units: list[str] = []
        # of a node: unit, ids, open candidates, number of decided ones before them, parent, and which of its candidates was skipped
        # (a unit has at most LONG symbols, so counts fit 16 bits)
        self.ids_at, self.open_at = Column(np.int64), Column(np.int64)
        self.unit, self.parent = Column(np.int32), Column(np.int32)
        self.ids_n, self.open_n, self.decided, self.skip = (Column(np.int16) for _ in range(4))
        self.ids, self.open, self.child = Column("<i4"), Column(np.uint64), Column(np.int32)

    def __len__(self) -> int:
        return self.unit.size

    def __bool__(self) -> bool:
        return True

    def grow(self, unit: np.ndarray, parent: np.ndarray, skip: np.ndarray) -> None:
        """New nodes; parent -1 for roots, skip: place among all candidates of the unit, decided ones counted."""
        row, off, up, k = np.arange(len(unit)), [], parent, skip
        while (has := up >= 0).any():  # the skipped candidates on the way to the root
            off.append((row[has], k[has]))
            row, k, up = row[has], self.skip.data[up[has]], self.parent.data[up[has]]
        forced_row, forced_k = (np.concatenate(x) for x in zip(*off)) if off else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        forced = np.sort(forced_row << 16 | forced_k)
        met = [np.zeros(0, np.int64)] * 2  # (unit, place, piece) of the candidates met, sorted, and their places in the order of the unit
        count = np.zeros(len(unit), np.int64)

        def stays(u: np.ndarray, place: np.ndarray, merged: np.ndarray) -> np.ndarray:
            nonlocal met
            c = u << 40 | place << 24 | merged
            at = np.searchsorted(met[0], c)
            known = at < len(met[0])
            known[known] = met[0][at[known]] == c[known]
            fresh, first = np.unique(c[~known], return_index=True)
            if len(fresh):
                # in the order in which this round offers them, a unit's after each other
                order = np.lexsort((first, fresh >> 40))
                own = fresh[order] >> 40
                n = np.bincount(own, minlength=len(unit))
                nth = np.empty(len(fresh), np.int64)
                nth[order] = count[own] + np.arange(len(own)) - (np.cumsum(n) - n)[own]
                count[:] += n
                where = np.searchsorted(met[0], fresh)
                met = [np.insert(met[0], where, fresh), np.insert(met[1], where, nth)]
                at = np.searchsorted(met[0], c)
            mine = u << 16 | met[1][at]
            hit = np.minimum(np.searchsorted(forced, mine), len(forced) - 1)
            return forced[hit] != mine if len(forced) else np.ones(len(u), bool)

        cut = encode_units(self.model, [self.units[k] for k in unit], [0] * len(unit), 0.0, stays)
        c, nth = met
        decided = skip + 1
        own = c >> 40
        keep = np.lexsort((nth, own))
        keep = keep[nth[keep] >= decided[own[keep]]]
        size = np.array([len(x) for x in cut]) // 4
        n = np.bincount(own[keep], minlength=len(unit))
        for column, values in ((self.unit, unit), (self.ids_at, self.ids.size + np.cumsum(size) - size), (self.ids_n, size), (self.open_at, self.open.size + np.cumsum(n) - n),
                               (self.open_n, n), (self.decided, decided), (self.parent, parent), (self.skip, skip)):
            column.add(values)
        self.ids.add(np.frombuffer(b"".join(cut), "<i4"))
        self.open.add(candidate_hash(c[keep] >> 24 & 0xFFFF, c[keep] & 0xFFFFFF))
        self.child.add(np.full(len(keep), -1, np.int32))

    def meet(self, units: list[str]) -> None:
        """Roots of units that are new."""
        for a in range(0, len(units), 20_000):
            part = units[a : a + 20_000]
            self.root.update(zip(part, range(len(self), len(self) + len(part))))
            ids = np.arange(len(self.units), len(self.units) + len(part))
            self.units += part
            self.grow(ids, np.full(len(part), -1), np.full(len(part), -1))

    def leaves(self, node: np.ndarray, key: np.ndarray, rate: float) -> np.ndarray:
        """The nodes at which occurrences end that begin at these; -1 for those to be replayed."""
        node, rows = node.copy(), np.arange(len(node))
        while len(rows):
            again = []
            for a in range(0, len(rows), 1 << 14):
                part = rows[a : a + (1 << 14)]
                at, n = self.open_at.data[node[part]], self.open_n.data[node[part]]
                hit = np.flatnonzero(falls(np.repeat(key[part], n), self.open.data[spread(at, n)], rate))
                who = np.searchsorted(np.cumsum(n), hit, side="right")
                first = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
                who, hit = who[first], hit[first]
                again.append((part[who], hit - (np.cumsum(n) - n)[who]))
            rows, nth = (np.concatenate(x) for x in zip(*again))
            edge = self.open_at.data[node[rows]] + nth
            unmade = np.flatnonzero(self.child.data[edge] < 0)
            new, at, times = np.unique(edge[unmade], return_index=True, return_counts=True)
            asked = (times > 1) | (self.child.data[new] == -2)
            self.child.data[new[~asked]] = -2
            new, at = new[asked], unmade[at[asked]]
            up, nth = node[rows[at]], nth[at]
            for a in range(0, len(new), 20_000):
                part = slice(a, a + 20_000)
                self.child.data[new[part]] = np.arange(len(self), len(self) + len(new[part]))
                self.grow(self.unit.data[up[part]], up[part], self.decided.data[up[part]] + nth[part])
            node[rows] = np.maximum(self.child.data[edge], -1)
            rows = rows[node[rows] >= 0]
        return node


def encode_all(texts: list[str], documents: int | list[int], path: str, seed: int = SEED, rate: float = RATE) -> list[np.ndarray]:
    """Ids of each text, given the keys of the documents; a worker remembers about CACHE nodes of the units it met."""
    model = _model(path)
    held = memory("pieces")
    if ("trees", path) not in held:
        held["trees", path] = Trees(model)
    trees = held["trees", path]
    documents = [documents] * len(texts) if isinstance(documents, int) else documents
    if len(trees) > CACHE:
        trees.clear()
    parts = [model.units(t) for t in texts]
    sizes = [len(units) for units in parts]
    flat = list(chain.from_iterable(parts))
    node = np.array(list(map(trees.root.get, flat, repeat(-1))), np.int64)
    unmet = np.flatnonzero(node < 0).tolist()
    times = Counter(flat[k] for k in unmet if len(flat[k]) <= LONG)
    again = [u for u, n in times.items() if n > 1 or u in trees.once]
    if len(trees.once) > 2 * CACHE:
        trees.once.clear()
    trees.once.update(times)
    trees.once.difference_update(again)
    trees.meet(again)
    node[unmet] = [trees.root.get(flat[k], -1) for k in unmet]
    key = np.concatenate([np.zeros(0, np.uint64), *(occurrence_keys(d, n, seed) for d, n in zip(documents, sizes))])
    if rate:
        short = np.flatnonzero(node >= 0)
        node[short] = trees.leaves(node[short], key[short], rate)
    rest = np.flatnonzero(node < 0)
    cut = []
    for a in range(0, len(rest), 5_000):
        part = rest[a : a + 5_000]
        cut += encode_units(model, [flat[k] for k in part], key[part].tolist(), rate)
    at, n = trees.ids_at.data[node], trees.ids_n.data[node].astype(np.int64)
    kept = trees.ids.size
    n[rest] = [len(x) // 4 for x in cut]
    at[rest] = kept + np.cumsum(n[rest]) - n[rest]
    trees.ids.add(np.frombuffer(b"".join(cut), "<i4"))
    ids = trees.ids.data[spread(at, n)]
    trees.ids.size = kept  # only those of nodes stay
    ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *sizes])].tolist()
    return [ids[a:b] for a, b in zip(ends, ends[1:])]


def decode(ids: list[int], path: str) -> str:
    return b"".join(map(_model(path).raw.__getitem__, ids)).decode()[1:]


def decodes_to(ids: np.ndarray, text: str, path: str) -> bool:
    """Whether decode(ids) is the text, by its bytes."""
    model, want, at = _model(path), b" " + text.encode() if text else b"", 0
    for a in range(0, len(ids), 1 << 16):
        part = ids[a : a + (1 << 16)]
        got = model.raw_flat[spread(model.raw_at[part], model.raw_n[part])].tobytes()
        if want[at : at + len(got)] != got:
            return False
        at += len(got)
    return at == len(want)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: float = RATE) -> DataFrame:
    """id, pieces as array<int>, and lossless: whether they decode to the text."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a in range(0, len(texts), 1024):
                part = texts[a : a + 1024]
                got: list[np.ndarray | None] = [None] * len(part)
                rows = [k for k, t in enumerate(part) if t is not None]
                for b in range(0, len(rows), 128):
                    own = rows[b : b + 128]
                    for k, ids in zip(own, encode_all([part[k] for k in own], [keys[a + k] for k in own], path, seed, rate)):
                        got[k] = ids
                same = [t is None or decodes_to(ids, t, path) for t, ids in zip(part, got)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), pa.array(got, pa.list_(pa.int32())), pa.array(same)], [id_col, "pieces", "lossless"])

    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col))).otherwise(F.xxhash64(F.col(text_col)))
    base = docs.select(F.col(id_col), key.alias("_key"), F.col(text_col).cast("string").alias("_text"))
    return base.mapInArrow(run, T.StructType([base.schema.fields[0], T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())]))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the text of its pieces column."""

    def run(batches):
        for batch in batches:
            got = [None if x.as_py() is None else decode(x.values.to_pylist(), path) for x in batch.column("pieces")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def encode_and_check(docs: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, pieces, lossless): every text is encoded, decoded again and compared."""
    import public_tokenizers

    got = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces", "lossless")


def op7_merge_dropout(docs: DataFrame) -> DataFrame:
    return encode_and_check(docs)

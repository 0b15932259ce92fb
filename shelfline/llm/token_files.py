"""Token ids in bit-plane files.

Texts are tokenised, an end id is appended to each, and the ids of documents in ascending id order are written as shard
files.  A shard holds chunks of CHUNK ids.  A chunk is transposed into bit planes (bit k of all its ids, packed eight to a
byte) up to the highest bit in use, and every plane is compressed by itself with zstandard.  Layout, little-endian:

    magic b"BITPLN1\\n"
    planes of chunk 0, chunk 1, ...
    footer (zstandard): JSON of the chunk index [[ids, [plane sizes]], ...] and the documents [[id, ids], ...]
    length of the footer, 8 bytes; magic

so a reader finds any chunk by its index and needs only that chunk's planes.  A shard closes at SHARD ids, so neither
writer nor reader holds more.  A task writes under a name of its own and renames it: a repeated task replaces whole files.

Edge cases: a null or empty text is one end id; documents without id come first; an empty table has no shard and gives an
empty result; equal ids keep their rows, ordered by text; other columns are not read.
"""
from __future__ import annotations

import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import memory, stored

CHUNK, SHARD = 1 << 16, 1 << 22
MAGIC = b"BITPLN1\n"
END = 1
CACHE, TOGETHER = 600_000, 2_000
MARK = "|"
# visible ASCII but ' (it may begin a contraction) and < (an added token), letters of Latin-1, and what the vocabulary parts them into
LATIN, PARTS = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]*"), re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Words:
    """Ids of whole texts by the tokenizers library, remembered by blank-separated piece.

    The vocabulary drops white space and splits at it, so a text's ids are those of its pieces in order.  Where it lowers
    letters and cuts LATIN pieces into PARTS (checked at loading), these go to the tokenizer's model straight away.  Other pieces
    not met before are encoded TOGETHER at a time with MARK between them; those that hold the mark go by themselves."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.mark, = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.model, made, cut = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        visible = "".join(c for c in map(chr, range(33, 256)) if LATIN.fullmatch(c))
        sample = "".join(a + b for a in "aZ0!" for b in visible) + visible
        # how the model spells a character: byte by byte
        self.spelled = {ord(c): "".join(w for w, _ in cut.pre_tokenize_str(c)) for c in visible} if cut else {}
        self.same = all(self.spelled.get(ord(c)) == c for c in visible if c.isascii())
        self.raw = [k.to_bytes(4, "little") for k in range(1 + max(self.tokenizer.get_vocab().values()))]
        # an added token of such characters would be looked for before the model is asked
        self.direct = (made is not None and cut is not None and made.normalize_str(sample) == sample.lower()
                       and [w for w, _ in cut.pre_tokenize_str(sample.lower())] == [q.translate(self.spelled) for q in PARTS.findall(sample.lower())]
                       and not any(LATIN.fullmatch(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()))

    def _part(self, part: str) -> bytes:
        """Ids of one of the PARTS, which is a piece too."""
        got = self.known.get(part)
        if got is None:
            spelled = part if self.same and part.isascii() else part.translate(self.spelled)
            got = self.known[part] = b"".join([self.raw[t.id] for t in self.model.tokenize(spelled)])
        return got

    def _learn(self, pieces: list[str]) -> None:
        rest, known, latin, cut, get, part = [], self.known, LATIN.fullmatch, PARTS.findall, self.known.get, self._part
        for p in pieces:
            if self.direct and latin(p):
                parts = cut(p.lower())
                known[p] = part(parts[0]) if len(parts) == 1 else b"".join([get(q) or part(q) for q in parts])
            else:
                rest.append(p)
        pieces = rest
        plain = [p for p in pieces if MARK not in p and "<" not in p]  # a < may open an added token, which reads across blanks
        for a in range(0, len(plain), TOGETHER):
            part = plain[a : a + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")  # without offsets
            ends = [*(4 * np.flatnonzero(ids == self.mark)).tolist(), 4 * len(ids)]
            raw, at = ids.tobytes(), 0
            for p, end in zip(part, ends, strict=True):
                self.known[p] = raw[at:end]
                at = end + 4
        for p in set(pieces).difference(plain):
            self.known[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()

    def all_ids(self, texts: list[str | None]):
        """Little-endian unsigned 32-bit ids of each text; memory is bounded by the cache and the texts given."""
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if t else [] for t in texts]
        known = self.known
        met = set().union(*parts)
        new = met.difference(known)
        if new and len(known) + len(new) > CACHE:
            known.clear()
            new = met
        self._learn(list(new))
        for pieces in parts:
            yield b"".join(map(known.__getitem__, pieces))


def _words_of(path: str) -> Words:
    """The tokenizer of a path and its remembered pieces, one in a process."""
    held = memory("token_files")
    if path not in held:
        held[path] = Words(path)
    return held[path]


def _in_parts(texts, chars: int = 2_000_000):
    """Texts in lists of about so many characters, or of one longer text."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def pack(ids: np.ndarray) -> list[bytes]:
    """Compressed bit planes of a chunk, lowest bit first."""
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    top = int(ids.max()).bit_length() if len(ids) else 0
    return [c.compress(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes()) for k in range(top)]


def unpack(planes: list[bytes], n: int) -> np.ndarray:
    import zstandard

    d = zstandard.ZstdDecompressor()
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(d.decompress(plane), np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return ids


def encode_shard(ids: np.ndarray, docs: list[tuple[int | None, int]]) -> bytes:
    import zstandard

    body, index = [MAGIC], []
    for a in range(0, len(ids), CHUNK):
        planes = pack(ids[a : a + CHUNK])
        body += planes
        index.append([len(ids[a : a + CHUNK]), [len(p) for p in planes]])
    foot = zstandard.ZstdCompressor(level=3).compress(json.dumps({"chunks": index, "docs": docs}).encode())
    return b"".join([*body, foot, len(foot).to_bytes(8, "little"), MAGIC])


def footer(data: bytes) -> dict:
    import zstandard

    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a bit-plane shard")
    n = int.from_bytes(data[-16:-8], "little")
    return json.loads(zstandard.ZstdDecompressor().decompress(data[-16 - n : -16]))


def decode_shard(data: bytes):
    """(documents [[id, ids], ...], all ids in order)."""
    foot = footer(data)
    at, out = len(MAGIC), []
    for n, sizes in foot["chunks"]:
        planes = []
        for s in sizes:
            planes.append(data[at : at + s])
            at += s
        out.append(unpack(planes, n))
    return foot["docs"], np.concatenate(out) if out else np.zeros(0, np.uint32)


def _put(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    own = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, f"{path}/{name}")


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; (part, shard, first, n_docs, n_tokens) of each, in order of part and shard."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches):
        from pyspark import TaskContext

        words, part = _words_of(tokenizer), TaskContext.get().partitionId()
        held, docs_, size, shard = [], [], 0, 0
        end = np.array([END], "<u4").tobytes()

        def close():
            nonlocal held, docs_, size, shard
            _put(folder, f"part-{part:06d}-{shard:06d}.bpl", encode_shard(np.frombuffer(b"".join(held), "<u4"), docs_))
            row = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "n_docs": [len(docs_)], "n_tokens": [size]})
            held, docs_, size, shard = [], [], 0, shard + 1
            return row

        for batch in batches:
            encoded = (ids for texts in _in_parts(batch.column(1).to_pylist()) for ids in words.all_ids(texts))
            for id_, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                got = ids + end
                n = len(got) // 4
                if size and size + n > SHARD:
                    yield close()
                held.append(got)
                docs_.append((id_, n))
                size += n
        if docs_:
            yield close()

    return rows.mapInArrow(run, "part long, shard long, n_docs long, n_tokens long")


def read(docs_folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the shard files; shards: what write() returned, stored."""
    from pyspark.sql import Window as W

    spark = shards.sparkSession
    # offsets of parts first, then of shards inside a part: no window sees more rows than parts, or shards of a part
    per = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = per.withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "before")
    own = F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    first = shards.withColumn("inside", own).join(parts, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("first"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bpl").load(docs_folder)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part, shard = (int(x) for x in name.rsplit("/", 1)[1].removesuffix(".bpl").split("-")[1:])
                docs_, ids = decode_shard(data.as_py())
                at, crc, inside = 0, [], []
                raw = ids.astype("<u4")
                for _, n in docs_:
                    crc.append(zlib.crc32(raw[at : at + n].tobytes()))
                    inside.append(at)
                    at += n
                k = len(docs_)
                yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int64()), pa.array([shard] * k, pa.int64()), pa.array([d for d, _ in docs_], pa.int64()), pa.array(inside, pa.int64()),
                                                  pa.array([n for _, n in docs_], pa.int64()), pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    got = files.select("path", "content").mapInArrow(run, "part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return got.join(first, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(docs.sparkSession, "tokens")
    shards = stored(write(docs, public_tokenizers.path("word_bpe_49k.json"), folder), "shards")
    return read(folder, shards)

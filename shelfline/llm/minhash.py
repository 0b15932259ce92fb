"""MinHash near-dedup with b-bit signatures.

Each document's shingle set gives PERMS minima.  Bands of ROWS minima deal out candidates; the low BITS bits of each
minimum, packed into longs, estimate similarity by bit counts, corrected for chance matches.  Documents with the same
set are one representative from the start.  Candidate clusters (linked by estimates no true link falls below, up to a
chance of 1e-6) are compared inside bounded blocks, and only links confirmed on the full sets count.

Edge cases: null or blank text: empty set, linked with nothing, kept.  A row without id is linked with nothing and kept.
Repeated rows share a component; near_duplicates() reports each of them, keep_one() returns one.  Rows of one id with
different texts are documents of their own: each has the component of its own text, and a component is named by the
smallest id in it; among rows of that id keep_one() keeps the text with the smallest hash.  Other columns, whatever
their names, are never looked at.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, grouped, shingle_set, stored

PERMS, ROWS, BITS = 128, 5, 4
BANDS = PERMS // ROWS
PER_LONG = 64 // BITS
LONGS = PERMS // PER_LONG
BLOCK = 256
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)
_FOLD = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(similarity: float, miss: float = 1e-6) -> int:
    """Matches out of PERMS that a pair of this similarity falls below with at most the given chance."""
    p = similarity + (1 - similarity) / 2**BITS
    below = 0.0
    for k in range(PERMS + 1):
        below += math.comb(PERMS, k) * p**k * (1 - p) ** (PERMS - k)
        if below > miss:
            return k
    return PERMS


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(PERMS, np.uint64(2**64 - 1))
    for a in range(0, len(hashes), 2048):
        np.minimum(out, (hashes[a : a + 2048, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """BITS low bits of each minimum, PER_LONG to a long."""
    low = (low & np.uint64(2**BITS - 1)).reshape(LONGS, PER_LONG)
    return (low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, hash, n_shingles, key1, key2, bands, sig); hash is that of the text, key1 and key2 are 128 bits of a hash of the
    set, null when empty."""

    def run(batches):
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())
            n, k1, k2, bands, sigs = [], [], [], [], []
            for t in texts:
                s = shingle_set(t.as_py(), words)
                n.append(len(s))
                if not len(s):
                    k1.append(None), k2.append(None), bands.append(None), sigs.append(None)
                    continue
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                k1.append(int.from_bytes(d[:8], "little", signed=True)), k2.append(int.from_bytes(d[8:], "little", signed=True))
                m = minima(s)
                band = (m[: BANDS * ROWS].reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
                bands.append(((band ^ (band >> np.uint64(29))) * _MUL[:BANDS]).view(np.int64))
                sigs.append(pack(m).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, hashes, pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                ["id", "hash", "n_shingles", "key1", "key2", "bands", "sig"])

    return _texts(docs, id_col, text_col).mapInArrow(
        run, "id long, hash long, n_shingles long, key1 long, key2 long, bands array<long>, sig array<long>")


def matches(a: str, b: str):
    """Equal low parts of two packed signatures, by bit counts."""
    ones = int("0001" * PER_LONG, 2)
    differ = F.lit(0)
    for i in range(LONGS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return F.lit(PERMS) - differ


def match_matrix(sig: np.ndarray) -> np.ndarray:
    """matches() for all pairs of a block."""
    x = sig[:, None, :] ^ sig[None, :, :]
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return PERMS - np.bitwise_count(x & np.uint64(int("0001" * PER_LONG, 2))).sum(axis=2, dtype=np.int64)


def _lists(col: pa.ChunkedArray) -> list[np.ndarray]:
    col = col.combine_chunks()
    off, values = col.offsets.to_numpy(), col.values.to_numpy()
    return [values[a:b].view(np.uint64) for a, b in zip(off, off[1:])]


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _estimated(least: int):
    def fn(rows: pa.Table):
        ids = rows.column("id").to_numpy()
        sig = np.stack(_lists(rows.column("sig")))
        x, y = np.nonzero(np.triu(match_matrix(sig) >= least, 1))
        if not len(x):
            return None
        root = forest(x, y, len(ids))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return _edges(ids[root[moved]], ids[moved])

    return fn


def _confirmed(least: int, percent: int):
    """Confirmed links that connect a block; pairs already connected need no check.  asking: the rows whose pairs count."""

    def fn(rows: pa.Table):
        ids, label = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        asking = rows.column("asking").to_numpy(zero_copy_only=False)
        sig, sets = np.stack(_lists(rows.column("sig"))), _lists(rows.column("shingles"))
        near = np.triu(match_matrix(sig) >= least, 1)
        near |= near.T
        group = np.unique(label, return_inverse=True)[1]
        a, b = [], []
        for i in np.flatnonzero(asking):
            for j in np.flatnonzero(near[i] & (group != group[i])):
                if group[j] == group[i] or asking[j] and j < i:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a.append(ids[i]), b.append(ids[j])
                    group[group == group[j]] = group[i]
        return _edges(a, b)

    return fn


def _reached(least: int):
    """For each asking row of a block one of the others that is estimated near enough."""

    def fn(rows: pa.Table):
        ids, sig = rows.column("id").to_numpy(), np.stack(_lists(rows.column("sig")))
        asking = rows.column("asking").to_numpy(zero_copy_only=False)
        if asking.all() or not asking.any():
            return None
        near = match_matrix(sig)[asking][:, ~asking] >= least
        hit = near.any(axis=1)
        return _edges(ids[asking][hit], ids[~asking][near.argmax(axis=1)[hit]])

    return fn


def _candidates(reps: DataFrame, least: int) -> DataFrame:
    """Links (a, b) whose components hold every pair that shares a band and is estimated near enough."""
    member = reps.select(F.explode("bands").alias("band"), "id")
    lead = member.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    # every member of a bucket against its smallest id: as many pairs as rows, however large the bucket
    star = stored(member.join(stored(lead, "leads"), "band").where("id <> a").select("band", "a", F.col("id").alias("b")), "star")
    sig = reps.select("id", "sig")
    seen = (star.select("a", "b").distinct()
            .join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
            .select("a", "b", (matches("sa", "sb") >= least).alias("near")))
    seen = stored(seen, "seen")
    # members unlike the leader may still be like each other
    rest = star.join(seen.where("not near"), ["a", "b"]).select("band", F.col("b").alias("id"))
    rest = stored(rest, "rest")
    size = rest.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("nb"), F.count("*").alias("n")).where("n > 1").select("band", "nb")
    far = rest.join(stored(size, "sizes"), "band").join(sig, "id")
    links = grouped(in_block_pairs(far, "band"), ["band", "i", "j"], _estimated(least), "a long, b long")
    links = stored(seen.where("near").select("a", "b").union(links), "near")
    # a member unlike the leader may be like one of those near it: asked where it is not yet in the leader's component, in
    # which all of these are, so that one of them is enough
    root = components(links)
    names = [root.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    open_ = star.join(seen.where("not near"), ["a", "b"]).join(names[0], "a").join(names[1], "b", "left")
    open_ = stored(open_.where("root_b is null or root_b <> root_a").select("band", F.col("b").alias("id")), "open")
    if open_.isEmpty():
        return links
    blocks = lambda rows, n: rows.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias(n))
    to = star.join(seen.where("near"), ["a", "b"]).select("band", F.col("b").alias("id"))
    sizes = stored(blocks(open_, "ub").join(blocks(to, "nb"), "band"), "sizes")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    ask = open_.join(sizes, "band").withColumn("i", own("ub")).withColumn("j", every("nb")).withColumn("asking", F.lit(True))
    to = to.join(sizes, "band").withColumn("j", own("nb")).withColumn("i", every("ub")).withColumn("asking", F.lit(False))
    cols = ["band", "i", "j", "id", "asking"]
    both = ask.select(cols).union(to.select(cols)).join(sig, "id")
    return links.union(grouped(both, ["band", "i", "j"], _reached(least), "a long, b long"))


def in_block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Rows with nb, the number of blocks of their key, sent to each pair of blocks (i <= j) that holds their own."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    return other.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "nb")


def _links(docs: DataFrame, id_col: str, text_col: str, reps: DataFrame, words: int, percent: int) -> DataFrame:
    least = least_matches(percent / 100)
    cluster = stored(components(_candidates(reps, least)), "clusters")
    size = stored(cluster.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("nb")), "sizes")
    member = cluster.join(size, "root").select("id", F.col("root").alias("cluster"), "nb")

    def sets(batches):
        for batch in batches:
            got = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column("text").cast(pa.binary())]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(got, pa.list_(pa.int64()))], [*names, "shingles"])

    own = reps.select("id", F.col("doc.id").alias("_doc"), F.col("doc.hash").alias("_hash"), "sig").join(member, "id")
    text = _texts(docs, id_col, text_col).select(F.col("id").alias("_doc"), F.col("hash").alias("_hash"), "text")
    full = text.join(own, ["_doc", "_hash"]).dropDuplicates(["id"]).select("id", "cluster", "nb", "sig", "text").mapInArrow(
        sets, "id long, cluster long, nb long, sig array<long>, shingles array<long>")
    full = stored(full.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb"))), "full")
    # first, each block within itself and against block 0: linear, and all there is to do for clusters of one block
    first = full.withColumn("label", F.col("id")).withColumn("asking", F.lit(True)).withColumn(
        "j", F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).otherwise(F.array("own"))))
    cols = ["cluster", "j", "id", "label", "asking", "sig", "shingles"]
    links = stored(grouped(first.select(cols), ["cluster", "j"], _confirmed(least, percent), "a long, b long"), "first")
    # then whatever a larger cluster's main component still leaves out, against all of that cluster
    large = full.where("nb > 1")
    if large.isEmpty():
        return links
    root = components(links)
    large = stored(large.join(root, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root"), "large")
    per = large.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = stored(per.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("left_out")).where("left_out > 0")
                  .select("cluster", "main", F.ceil(F.col("left_out") / BLOCK).alias("ub")), "main")
    open_ = large.join(main, "cluster")
    ask = open_.where("label <> main").withColumn("i", F.pmod(F.xxhash64("id"), F.col("ub"))).withColumn("asking", F.lit(True)).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    against = open_.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ub") - 1))).withColumn("asking", F.lit(False)).withColumn("j", F.col("own"))
    cols = ["cluster", "i", "j", "id", "label", "asking", "sig", "shingles"]
    more = grouped(ask.select(cols).union(against.select(cols)), ["cluster", "i", "j"], _confirmed(least, percent), "a long, b long")
    return links.union(more)


def _found(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, hash, n_shingles, node, component_id) per row; node stands for the component, null where nothing can be linked."""
    sig = stored(signatures(docs, id_col, text_col, words), "signatures")
    reps = sig.where("id is not null and key1 is not null").groupBy("key1", "key2").agg(
        F.min(F.struct("id", "hash")).alias("doc"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # one id may have several texts, so sets get numbers of their own; they are written, and so the same for all readers
    reps = stored(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    root = stored(components(_links(docs, id_col, text_col, reps.select("id", "doc", "bands", "sig"), words, percent)), "roots")
    node = reps.select("key1", "key2", "id", "doc.id").toDF("key1", "key2", "rep", "first").join(root.withColumnRenamed("id", "rep"), "rep", "left")
    node = stored(node.select("key1", "key2", "first", F.coalesce("root", "rep").alias("node")), "nodes")
    name = node.groupBy("node").agg(F.min("first").alias("component_id"))
    same = node.select("key1", "key2", "node").join(name, "node")
    found = sig.select("id", "hash", "n_shingles", "key1", "key2").join(same, ["key1", "key2"], "left")
    linked = F.col("id").isNotNull()
    return found.select("id", "hash", "n_shingles", F.when(linked, F.col("node")).alias("node"),
                        F.when(linked, F.coalesce("component_id", "id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: links where 100 * intersection >= percent * union of the sets."""
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return _found(docs, id_col, text_col, words, percent).select("id", "n_shingles", "component_id", kept)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each component the row with the smallest id stays, once; blank texts all stay."""
    found = stored(_found(docs, id_col, text_col, words, percent).where("node is not null"), "found")
    best = found.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("best"))
    rows = stored(found.join(best, "node").groupBy("id", "hash").agg(F.bool_or(F.struct("id", "hash") == F.col("best")).alias("stays"), F.count("*").alias("n")), "rows")
    mark = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of docs
    key = [mark + "id", mark + "hash"]
    left = docs.withColumns(dict(zip(key, (F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))))))
    left = left.join(rows.where("not stays").select("id", "hash").toDF(*key), key, "left_anti")
    again = stored(rows.where("stays and n > 1").select("id", "hash").toDF(*key), "again")
    if not again.isEmpty():
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates(key))
    return left.drop(*key)


def op10_minhash_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words=2).withColumnRenamed("id", "doc_id")

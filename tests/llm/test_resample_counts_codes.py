"""Resampling, token counts and vector codes against plain Python, and on awkward rows."""
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfline.llm import common, resample, token_counts, vector_codes

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def resampled(docs, target, runs=1, buckets=10_000, percent=10, least=20, seed=2024):
    features = lambda ws: [zlib.crc32(" ".join(ws[k : k + n]).encode()) % buckets for n in range(1, runs + 1) for k in range(len(ws) - n + 1)]
    rows = [(i, words(t)) for i, t in docs]
    s, t = collections.Counter(), collections.Counter()
    for _, ws in rows:
        s.update(features(ws))
    for text in target:
        t.update(features(words(text)))
    ss, tt = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, ws in rows:
        fs = features(ws)
        weight = sum(math.floor(1000 * math.log((t[f] + 1) * ss / ((s[f] + 1) * tt))) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    place = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(repr((*r, place.get(id(r)))) for r in out)


ODD = [(1, None), (2, ""), (3, " \t\x00!"), (4, "Ünï A-z 09 日本 " * 9000), (None, "no id " * 30), (None, "no id " * 30), (None, "other words " * 40), *[(7, "same text here " * 10)] * 40, *[(8, f"w{k} " * 25) for k in range(30)], (-5, "minus " * 20), (9, "nineteen " * 19)]


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())


def test_resampling(spark):
    docs, bench = (common.table(spark, SF, t) for t in ("documents", "benchmark"))
    rows, target = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()]
    assert got(resample.resample(docs, bench)) == resampled(rows, target)
    assert got(resample.resample(docs, bench, runs=3, buckets=500, percent=33, least=5, seed=7)) == resampled(rows, target, 3, 500, 33, 5, 7)


@pytest.mark.parametrize("percent", [0, 1, 10, 50, 99, 100])
def test_resampling_of_odd_rows(spark, percent):
    docs = spark.createDataFrame([(t, i, 1.0, 2, 3, "x") for i, t in ODD], "text string, doc_id long, score double, rank int, _row int, _at string")
    target = spark.createDataFrame([("same words",), (None,), ("",)], "text string")
    assert got(resample.resample(docs, target, percent)) == resampled(ODD, ["same words", "", ""], percent=percent)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (2, "b " * 30)], "doc_id long, text string")
    assert resample.op11_resampling(none, none).count() == 0
    assert got(resample.resample(some, none, 50)) == resampled([(1, "a " * 30), (2, "b " * 30)], [], percent=50)


def test_cutoff_bisection(spark):
    rng = np.random.default_rng(2)
    values = sorted(rng.integers(-10_000, 10_000, 300).tolist())
    df = spark.createDataFrame([(v,) for v in values], "v long").cache()
    for enough in (1, 2, 150, 299, 300):
        assert resample._lowest(df, "v", values[0], values[-1], enough, True) == values[-enough]
        assert resample._lowest(df, "v", values[0], values[-1], enough, False) == values[enough - 1]


PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "\n", "\n\n a", "a\nb", " lead", "trail  ", "a  b", "a▁b ▁ c", "<s> </s><unk><0x41>", "x" * 60_000, "word " * 20_000, "line\nline  x\n\n" * 6_000,
         "\n" * 40_000, " " * 40_000, "日本語😀\x00é" * 9_000, "日本語 " * 9_000, "▁ " * 30_000, " ▁x" * 30_000, "a" * 16_383 + " b" * 20_000, "a" * 16_384 + "\n" * 3 + "b" * 16_384 + " \n " * 9_000]


def test_token_counts(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = common.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, t) for t in TEXTS]
    odd = spark.createDataFrame([(t, i, "n", 5) for i, t in rows], "text string, doc_id long, _text string, n_tokens int").repartition(3)
    want = sorted(repr((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096)) for i, t in rows)
    assert sorted(repr(tuple(r)) for r in token_counts.op12_token_counts(odd).collect()) == want
    assert token_counts.op12_token_counts(docs.limit(0)).count() == 0
    assert token_counts.op12_token_counts(docs).schema.simpleString() == "struct<doc_id:bigint,n_bytes:bigint,n_tokens:bigint,over_limit:boolean>"


def test_parts_of_long_texts():
    model = token_counts.counter(PATH)
    for text in filter(None, TEXTS):
        cut = list(model.parts(text))
        if len(text) > 2 * token_counts.LONG and "word" in text:
            assert len(cut) > 4 and max(len(p) for p, _ in cut) < token_counts.LONG + 10
    rng = np.random.default_rng(8)
    for _ in range(30):  # random strings over what the cuts depend on
        text = "".join(rng.choice(list("ab ▁\n.é"), 60_000))
        assert model.counts([text], 1)[0] == len(model.library.encode(text))


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector, label) of codable vectors."""
    rows = sorted(((i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(b)), key=lambda e: (dist(x[p], b[e]), e)) for p, b in enumerate(books)] for x in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, c in zip(cut, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(z) // len(own) for z in zip(*own)]
    codes = assign()
    errors = [sum(dist(x[p], books[p][c[p]]) for p in range(parts)) for x, c in zip(cut, codes)]
    by = collections.Counter()
    for (_, _, lab), e in zip(rows, errors):
        by[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((i, "".join(f"{k:02x}" for k in c), e, by[lab], sha)) for (i, _, lab), c, e in zip(rows, codes, errors))


def test_vector_codes(spark):
    df = common.table(spark, SF, "embeddings")
    want = plain_codes([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert sorted(repr(tuple(r)) for r in vector_codes.op13_vector_codes(df).collect()) == want


def test_vector_codes_of_odd_rows(spark):
    rng = np.random.default_rng(9)
    near = [(int(i), [float(x) for x in rng.integers(-3, 4, 16) / 4096], None if i % 5 == 0 else int(i % 7)) for i in range(60)]
    near += [near[3]] * 5 + [(3, near[4][1], 2), (None, near[5][1], 3), (None, near[6][1], None), (900, [20_000.0, -20_000.0] * 8, 1)]
    bad = [(1, None, 1), (1, [], 1), (1, [None] + [0.5] * 15, 1), (1, [math.nan] + [0.5] * 15, 1), (1, [0.5] * 15 + [math.inf], 1), (1, [-math.inf] * 16, None), (1, [0.5] * 15, 1), (1, [0.5] * 8, 1), (1, [1e30] * 16, 1)]
    rows = [bad[k // 8] if k % 8 == 0 and k // 8 < len(bad) else near.pop() for k in range(len(bad) + len(near))]
    kept = [r for r in rows if r not in bad]
    schema = "label int, vec_id long, embedding array<double>, code int, error string, _label int, _n int"
    df = spark.createDataFrame([(lab, i, v, 1, "e", 2, 3) for i, v, lab in rows], schema)
    # the kept row of the smallest id gives the length
    assert min((r for r in kept if r[0] is not None), key=lambda r: r[0])[0] == 0
    assert sorted(repr(tuple(r)) for r in vector_codes.op13_vector_codes(df).collect()) == plain_codes(kept)
    few = df.where("vec_id < 5 and size(embedding) = 16")
    assert sorted(repr(tuple(r)) for r in vector_codes.op13_vector_codes(few).collect()) == plain_codes([r for r in kept if r[0] is not None and r[0] < 5])
    assert vector_codes.op13_vector_codes(df.limit(0)).count() == 0
    codes, books = vector_codes.compress(df)
    back = vector_codes.decode(codes, books).where("vec_id = 900").first()
    assert max(abs(x) for x in back.decoded) > 10_000


def test_labels_of_many_rows(spark):
    codes = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("label"), F.col("id").alias("error"), F.lit("00").alias("code"))
    out = vector_codes.with_label_error(codes, "label")
    assert out.count() == 40_000 and out.where("label is null").select("label_error").distinct().collect() == [(sum(range(0, 40_000, 3)),)]
    assert out.where("label is not null and label_error <> label").count() == 0


def test_orchard():
    rng = np.random.default_rng(1)
    for spread in (2, 5, 1000):
        for size in (1, 2, 16, 40):
            book, x = rng.integers(-spread, spread, (size, 3)), rng.integers(-spread, spread, (500, 3))
            all_of = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            code, dist = vector_codes.Orchard(book).search(x)
            assert (code == all_of.argmin(axis=1)).all() and (dist == all_of.min(axis=1)).all()

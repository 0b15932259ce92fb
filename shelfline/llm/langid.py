"""Language ID by compression: each language has a zstandard raw-content dictionary, and a text belongs to the language
whose dictionary compresses it best.

Dictionaries come from a bounded sample of the distinct labelled texts (about SAMPLE texts of a language, all of them where
there are fewer, PIECE characters from the middle of each, DICT bytes in all); every label is learned.  Prediction covers whole texts, in blocks of BLOCK bytes so that a long text cannot become its
own dictionary.  The relative gap between the best and the second size is the margin; narrow margins are rejected.

Edge cases: a null text or one without a letter is `und`, score 0, rejected; with no labelled row every text is `und`;
with one language the margin is taken against no dictionary.  Equal sizes go to the first language by name.
Repeated rows get equal rows; other columns are not read.
"""
from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memory

SAMPLE, PIECE, DICT, BLOCK = 160, 1200, 112 * 1024, 4096
SLOTS = 1 << 40       # places of the hash sample
MARGIN = 0.002
UND = "und"
_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    """Lower-case letters with their marks and single spaces: what the dictionaries and texts are compared in; empty without a letter (number
    characters are none)."""
    flat = _OTHER.sub(" ", text.lower()).strip()
    return flat.encode() if _LETTER.search(flat) else b""


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", use: Column | None = None) -> dict[str, bytes]:
    """Dictionary content by language, from a hash sample of the labelled rows."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if use is not None:
        rows = rows.where(use)
    # the sample is a filter of the scan by a hash of the text, which copies share: its rate comes from the distinct texts,
    # and the margin over SAMPLE covers the error of their estimated number, so that the sample does not run short
    rows = rows.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.pmod(F.xxhash64(F.col(text_col)), F.lit(SLOTS)).alias("_slot"))
    counts = rows.groupBy("_lang").agg(F.approx_count_distinct("_slot", 0.05).alias("n")).collect()
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["_lang"], SLOTS if r["n"] <= 2 * SAMPLE else int(1.5 * SAMPLE * SLOTS / r["n"]) + 1)))
    middle = F.substring(F.col("_text"), F.greatest(F.lit(1), F.floor((F.char_length("_text") - PIECE) / 2).cast("int")), F.lit(PIECE))
    picked = rows.where(F.col("_slot") < share[F.col("_lang")]).select("_lang", "_slot", middle.alias("_piece"))
    # copies of one text share its slot and count once
    picked = picked.groupBy("_lang", "_slot").agg(F.min("_piece").alias("_piece"))
    picked = picked.groupBy("_lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("_slot", "_piece"))), 1, SAMPLE).alias("_few")).select("_lang", F.posexplode("_few").alias("_at", "_one"))
    picked = picked.select("_lang", F.col("_one._slot").alias("_slot"), F.col("_one._piece").alias("_piece")).orderBy("_slot", "_lang")
    out: dict[str, bytes] = {}
    for lang, _, piece in picked.select("_lang", "_slot", "_piece").collect():
        out[lang] = (out.get(lang, b"") + b" " + plain(piece))[:DICT]
    return {k: v for k, v in sorted(out.items()) if len(v) > 8}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list, text_col: str = "text") -> DataFrame:
    """keep columns plus lang_pred, score (0 to 1, from the margin), margin and accepted."""
    names = list(dictionaries)

    def run(batches):
        import zstandard

        memory("langid")
        # short matches carry most of what tells languages apart
        level = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=4, target_length=16,
                                                    strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        packers = []
        for name in names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=level)
            packers.append(zstandard.ZstdCompressor(compression_params=level, dict_data=d))
        bare = zstandard.ZstdCompressor(compression_params=level)
        for batch in batches:
            pred, score, gap, ok = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                flat = plain(text.as_py() or "")
                if not flat or not packers:
                    pred.append(UND), score.append(0.0), gap.append(0.0), ok.append(False)
                    continue
                blocks = [flat[a : a + BLOCK] for a in range(0, len(flat), BLOCK)]
                sizes = [sum(len(p.compress(b)) for b in blocks) for p in packers]
                best = min(range(len(sizes)), key=lambda k: (sizes[k], names[k]))
                rest = [s for k, s in enumerate(sizes) if k != best] or [max(sizes[best], sum(len(bare.compress(b)) for b in blocks))]
                margin = 1 - sizes[best] / min(rest)
                pred.append(names[best]), gap.append(margin), ok.append(margin >= MARGIN), score.append(margin / (margin + 0.05))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(ok, pa.bool_())],
                                             [*batch.schema.names[:-1], "lang_pred", "score", "margin", "accepted"])

    base = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    new = T.StructType().add("lang_pred", "string").add("score", "double").add("margin", "double").add("accepted", "boolean")
    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], *new.fields]))


def recognised(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is recognised, fitted on the labelled rows of docs itself."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    judged = predict(docs, fit(docs, text_col, lang_col), [row], text_col)
    return judged.where("accepted").select("_row.*")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(docs: DataFrame) -> DataFrame:
    dictionaries = fit(docs, use=~held_out("doc_id"))
    return predict(docs, dictionaries, ["doc_id", held_out("doc_id").alias("held_out")])

"""Token counts of whole texts under a SentencePiece model: the library encodes batches inside Arrow functions, and only
lengths come back.

A batch is filled by bytes, not by rows, so that short texts share a call and long ones cannot swell it.  A text over LONG
characters is cut where no piece of the model can reach across, and its parts are encoded like texts of their own:

* at a space that follows another character: no piece holds a space after another character.  The space itself is left out,
  since the library puts one in front of every text;
* before a line break: it stands in no longer piece.  The part keeps it, and the space that the library puts in front,
  which cannot merge with it, is taken off the count.

Both properties are read off the model when it is loaded; where one does not hold, that kind of cut is not made.  A stretch
without any such place is encoded whole.

Edge cases: a null text counts as empty; an empty text has no tokens; repeated rows get equal rows; ids are passed on as they
are, null included; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
LONG, BATCH = 16_384, 1 << 18  # characters of a part, UTF-8 bytes (estimated as characters) of a call
SPACE = "▁"


class Counter:
    """Token counts under one model."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        prefixed = self.library.encode("a b", out_type=str) == [x for w in ("a", "b") for x in self.library.encode(w, out_type=str)]
        spaces = prefixed and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        breaks = not any("\n" in p for p in pieces if len(p) > 1) and self.library.encode("\n", out_type=str)[:1] == [SPACE]
        kinds = [f"(?<=[^ {SPACE}]) "] * spaces + [r"(?=\n)"] * breaks
        self.safe = re.compile("|".join(kinds)) if kinds else None

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """Parts of a text with what their count has too many."""
        start, extra = 0, 0
        while self.safe is not None and len(text) - start > LONG:
            cut = self.safe.search(text, start + LONG)
            if cut is None:
                break
            yield text[start : cut.start()], extra
            start, extra = cut.end(), int(cut.end() == cut.start())
        yield (text[start:] if start else text), extra

    def counts(self, texts: Iterator[str], rows: int) -> np.ndarray:
        total = np.zeros(rows, np.int64)
        held, owner, size = [], [], 0

        def flush():
            lengths = [len(ids) for ids in self.library.encode(held, num_threads=1)]
            np.add.at(total, owner, lengths)
            held.clear(), owner.clear()

        for row, text in enumerate(texts):
            for part, extra in self.parts(text) if text else ():
                total[row] -= extra
                held.append(part), owner.append(row)
                size += len(part)
                if size >= BATCH:
                    flush()
                    size = 0
        if held:
            flush()
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One loaded model a worker and path."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every row."""

    def run(batches):
        model = counter(path)
        for batch in batches:
            texts = (t.as_py() for t in batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.counts(texts, batch.num_rows), pa.int64())], [*batch.schema.names[:2], "n_tokens"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    kind = dict(base.dtypes)[id_col]
    return base.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def op12_token_counts(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > LIMIT)

"""Personal data: fixed patterns first, then bootstrapped contextual extraction.

Base spans (email, ip, card, phone) are seeds of their kinds; long tokens of mixed digits and letters in one case are seeds
of a further kind, secret, which no fixed pattern reports.  Every seed, and every other token that looks like an identifier
(at least four digits, or an @), is an instance.  Its lexical patterns are: the two words before it; the last word before it
with the opening punctuation between (as in token = "), alone, with the word before that, and with what follows the
instance; and its own prefix (capitals, or letters up to _ or -) with its length.  A bare word before it is no pattern.
The bipartite graph of patterns and instances is scored in rounds of Spark joins: a pattern is as trustworthy as the distinct
instances it introduces, an instance as the patterns that introduce it, the seeds being certain.  Identifiers that
trustworthy patterns introduce are added as spans of kind `ctx_<kind>` (of several kinds the most trusted, then the last by
name); base spans never change.

Edge cases: a null text is empty; texts of any length are read whole; a document without id keeps its own row (rows are
told apart by a hash of the text beside the id, and rows equal in both share their spans); an empty table gives an empty
result; other columns are only passed on by redact().
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memory, stored

KINDS = ("email", "ip", "card", "phone")
# fixed values: the four base patterns
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_PART = r"A-Za-z0-9#_@/.:+-"
_TOKEN = re.compile(rf"(?<![{_PART}])[A-Za-z#_/.:+-]*+[0-9@][{_PART}]*+")
_SECRET = re.compile(r"(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z].*[A-Za-z].*[A-Za-z])(?:[0-9a-f]{16,}|[0-9A-Z]{16,})", re.S)
_PREFIX = re.compile(r"[A-Z]{3,}|[A-Za-z]{2,}[_-]")
_CUE = re.compile(r"(?:(\S+)\s+)?(\w+)(\W+)$")
_OPENING = frozenset("=:\"'([{<")
GRAPH_KINDS = (*KINDS, "secret")
LONG = 64            # longer instances stand in the graph as a hash, longer words before one by their last characters
ROUNDS = 3
PRIOR = 2.0          # distinct untrusted instances every pattern starts with
TRUST, SUPPORT = 0.7, 5


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Matches of the e-mail pattern; it is only tried where a run of its characters ends at an @."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _EMAIL_CHARS:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost, non-overlapping within a kind; failing matches are dropped whole."""
    out = []
    if not text:
        return out
    if "@" in text:
        out += [("email", *m.span()) for m in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def _before(text: str, at: int) -> str:
    """The four words before a place, one blank between; a word of more than LONG characters counts by its last ones and
    ends the look back."""
    gap, words = " " if at and text[at - 1].isspace() else "", []
    while len(words) < 4:
        while at and text[at - 1].isspace():
            at -= 1
        if not at:
            break
        words.append(text[max(0, at - LONG) : at].split()[-1])
        at -= len(words[-1])
        if at and not text[at - 1].isspace():
            break
    return " ".join(reversed(words)) + gap


def _plain(words) -> str:
    return " ".join(re.sub(r"[0-9]+", "0", w.lower()) for w in words if w)


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns that introduce text[start:end]; letters lowered, numbers alike."""
    left, out = _before(text, start), []
    if words := left.split()[-2:]:
        out.append("words " + _plain(words))
    if left and (m := _CUE.search(left)) and _OPENING.intersection(m[3]):
        cue = f"{_plain([m[2]])} {''.join(m[3].split())}"
        out.append("cue " + cue)
        if m[1]:
            out.append(f"cue {_plain([m[1]])} {cue}")
        if (after := text[end : end + 1].strip()) and not after.isalnum():
            out.append(f"cue {cue} _ {after}")
    if m := _PREFIX.match(text, start, end):
        out.append(f"prefix {m[0]} {end - start}")
    return out


def _instance(token: str) -> str:
    return token.lower() if len(token) <= LONG else "sha256 " + hashlib.sha256(token.lower().encode("utf-8", "surrogatepass")).hexdigest()


def instances(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str | None, str, list[str]]]:
    """(start, end, seed's kind or None, instance, patterns) of the seeds and of other identifier-like tokens."""
    out, taken = [], sorted((a, b) for _, a, b in base)
    for kind, a, b in base:
        if p := patterns(text, a, b):
            out.append((a, b, kind, _instance(text[a:b]), p))
    k = 0
    for m in _TOKEN.finditer(text or ""):
        token = m.group().rstrip(".:/+-#_")
        a, b = m.start(), m.start() + len(token)
        if "@" not in token and sum(map(token.count, "0123456789")) < 4:
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if any(x < b and y > a for x, y in taken[k : k + 4]):
            continue
        if p := patterns(text, a, b):
            out.append((a, b, "secret" if _SECRET.fullmatch(token) else None, _instance(token), p))
    return out


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document: id, hash of the text, base spans, instances."""

    def run(batches):
        memory("pii")
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        seen = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
        for batch in batches:
            spans, near = [], []
            for text in batch.column(2).to_pylist():
                base = base_spans(text)
                spans.append([dict(kind=k, start=a, end=b) for k, a, b in base])
                near.append([dict(start=a, end=b, kind=k, instance=i, patterns=p) for a, b, k, i, p in instances(text, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(span)), pa.array(near, pa.list_(seen))], ["id", "text_hash", "base", "seen"])

    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long")
    seen = T.StructType().add("start", "long").add("end", "long").add("kind", "string").add("instance", "string").add("patterns", T.ArrayType(T.StringType()))
    return base.mapInArrow(run, T.StructType([*base.schema.fields[:2], T.StructField("base", T.ArrayType(span)), T.StructField("seen", T.ArrayType(seen))]))


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, trust, support) from edges(pattern, instance, kind): kind is the seed's kind, else null.

    trust of a pattern for a kind = sum of its distinct instances' trust / (their number + PRIOR);
    trust of an instance = 1 - product over its patterns of (1 - trust); seeds have 1."""
    edges = stored(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    size = stored(edges.groupBy("pattern").agg(F.count("*").alias("n")), "sizes")
    kinds = [F.when(F.col("kind") == k, 1.0).otherwise(0.0).alias(k) for k in GRAPH_KINDS]
    trust = stored(edges.groupBy("instance").agg(F.max("kind").alias("kind")).select("instance", *kinds), "instances")
    seed = trust
    for r in range(rounds):
        # instances are joined to patterns and back; hot patterns only ever meet partial sums
        sums = edges.select("pattern", "instance").join(trust, "instance").groupBy("pattern").agg(*(F.sum(k).alias(k) for k in GRAPH_KINDS))
        pattern = stored(sums.join(size, "pattern").select("pattern", "n", *((F.col(k) / (F.col("n") + PRIOR)).alias(k) for k in GRAPH_KINDS)), "patterns")
        if r + 1 < rounds:
            worth = [F.when(F.col(k) >= TRUST, F.log1p(-F.least(F.col(k), F.lit(0.999)))).otherwise(0.0).alias(k) for k in GRAPH_KINDS]
            new = edges.select("pattern", "instance").join(pattern.where(F.col("n") >= SUPPORT).select("pattern", *worth), "pattern")
            new = new.groupBy("instance").agg(*((1 - F.exp(F.sum(k))).alias("new_" + k) for k in GRAPH_KINDS))
            trust = stored(seed.join(new, "instance", "left").select("instance", *(F.greatest(F.col(k), F.coalesce("new_" + k, F.lit(0.0))).alias(k) for k in GRAPH_KINDS)), "instances")
    best = F.greatest(*GRAPH_KINDS)
    kind = F.coalesce(*(F.when(F.col(k) == best, F.lit(k)) for k in GRAPH_KINDS))
    return pattern.select("pattern", kind.alias("kind"), best.alias("trust"), F.col("n").alias("support"))


def _discovered(found: DataFrame) -> DataFrame:
    """(id, text_hash, extra spans) for the documents in which trusted patterns introduce further identifiers."""
    seen = found.select("id", "text_hash", F.explode("seen").alias("s")).select("id", "text_hash", "s.*")
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    trusted = score_graph(edges).where((F.col("trust") >= TRUST) & (F.col("support") >= SUPPORT))
    trusted = stored(trusted.select("pattern", F.struct("trust", F.concat(F.lit("ctx_"), "kind").alias("kind")).alias("found")), "trusted")
    other = stored(seen.where("kind is null or kind = 'secret'").select("id", "text_hash", "start", "end", F.explode("patterns").alias("pattern")), "others")
    hit = other.join(trusted, "pattern").groupBy("id", "text_hash", "start", "end").agg(F.max("found").alias("found"))
    hit = hit.select("id", "text_hash", F.struct("found.kind", "start", "end").alias("span"))
    return stored(hit.groupBy("id", "text_hash").agg(F.array_sort(F.collect_list("span")).alias("extra")), "extra")


def find_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, extra): spans of every document; base by kind as listed, then start."""
    found = stored(_found(docs, id_col, text_col), "found")
    more = _discovered(found).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "extra")
    return found.join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        F.col("id").alias(id_col), "base", F.coalesce("extra", F.expr("array()").cast(found.schema["base"].dataType)).alias("extra"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets, and the size column set anew where there is one."""
    found = stored(_found(docs, id_col, text_col), "found")
    more = _discovered(found).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "extra")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(row, F.xxhash64(F.col(text_col)).alias("_own"), F.col(id_col).alias("_own_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.join(more, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left").select("_row", "extra", "_text")

    def run(batches):
        for batch in batches:
            out = []
            for text, extra in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    out.append(None)
                    continue
                pieces, at = [], 0
                for a, b, kind in sorted([(a, b, k) for k, a, b in base_spans(text)] + [(s["start"], s["end"], s["kind"][4:]) for s in extra or []]):
                    if a >= at:
                        pieces += [text[at:a], f"[{kind.upper()}]"]
                    at = max(at, b)
                out.append("".join(pieces) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_row", "_text"])

    done = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_text", T.StringType())]))
    cols = [F.col("_text").alias(c) if c == text_col else F.char_length("_text").cast("long").alias(c) if c == size_col else F.col(f"_row.`{c}`") for c in docs.columns]
    return done.select(*cols)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op4_pii(docs: DataFrame) -> DataFrame:
    all_ = find_all(docs)

    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    text = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    more = F.transform("extra", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return all_.select("doc_id", *counts, F.sha2(F.array_join(text, ",").cast("binary"), 256).alias("base_sha256"),
                       F.array_join(F.concat(text, more), ",").alias("spans"), F.size("extra").cast("long").alias("n_context"))

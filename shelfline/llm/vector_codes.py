"""Vector code compression: product codes of integer vectors, the nearest entry found by Orchard's search.

Components become integers (floor of SCALE times the number); a vector is cut into PARTS equal consecutive parts, and each
part position has a codebook of at most ENTRIES entries, started from the smallest ids and moved by ROUNDS rounds of means.
Everything is integer arithmetic, so results do not depend on how rows are dealt.

Search: for every entry the others are listed by distance.  A part starts at entry 0 and walks the current entry's list; an
entry that is nearer (or as near with a lower index) becomes the current one and its list is walked from the start; entries
met before are marked and not measured again; the walk ends at the first listed entry that is over twice the current distance
away, since by the triangle inequality nothing from there on can be as near.  All parts of a batch walk at once.

Rounds are one pass over the written integer vectors each: tasks add up their own parts by entry, Spark adds the tasks' sums,
and the codebooks (PARTS x ENTRIES entries) are the only thing the driver holds.

Edge cases: rows whose vector is null, empty, or holds null or non-finite components are dropped; so are vectors that cannot be cut into equal
parts or have another length than the kept row of the smallest id, and components too large for squared distances in
64 bits (about 23,000 at 64 components).  Rows with equal ids are rows of their own, in the order of their vectors; null ids come
last.  With fewer rows than ENTRIES the codebooks are smaller; equal entries leave the later ones unused.  Null labels are one
label; a label whose errors pass 64 bits has a null label_error.  An empty table gives no rows.  Other columns are not read.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
HOT = 1000   # labels over this share of the rows (one in HOT) are joined by broadcast: at most HOT of them
STEP = 8192  # vectors that walk at once


class Orchard:
    """Nearest entry of one codebook, ties to the lower index."""

    def __init__(self, book: np.ndarray):
        self.book = book
        gap = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        self.near = np.argsort(gap, axis=1, kind="stable")  # every entry's neighbours by distance, ties by index
        self.gap = np.take_along_axis(gap, self.near, axis=1)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for every row of x."""
        n, k = len(x), len(self.book)
        best = np.zeros(n, np.int64)
        dist = ((x - self.book[0]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.zeros(n, np.int64)
        live = np.arange(n)
        while True:
            live = live[at[live] < k]
            here, place = best[live], at[live]
            # over twice as far is over four times the square; four times the largest distance still fits 64 bits
            live = live[self.gap[here, place] <= 4 * dist[live]]
            if not len(live):
                return best, dist
            entry = self.near[best[live], at[live]]
            at[live] += 1
            new = ~seen[live, entry]
            rows, entry = live[new], entry[new]
            seen[rows, entry] = True
            d = ((x[rows] - self.book[entry]) ** 2).sum(axis=1)
            better = (d < dist[rows]) | ((d == dist[rows]) & (entry < best[rows]))
            rows = rows[better]
            best[rows], dist[rows], at[rows] = entry[better], d[better], 0


def _cut(column: pa.Array, parts: int) -> np.ndarray:
    """(parts, rows, size) from an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), parts, -1).transpose(1, 0, 2)


def integers(vectors: DataFrame, vector_col: str, keep: list[Column], parts: int, scale: int = SCALE) -> DataFrame:
    """keep columns and `_ints` of the rows whose vector can be coded."""
    v = F.col(f"`{vector_col}`")
    size = F.size(v)
    whole = v.isNotNull() & (size > 0) & (size % parts == 0)
    # 4 * (2 m)^2 * size must stay under 2^63
    most = F.floor(F.sqrt(F.lit(float(2**59)) / size)) - 1
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * float(scale)) < most))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)))
    return vectors.where(whole).where(fits).select(*keep, ints.alias("_ints"))


def first_books(rows: DataFrame, id_col: str, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks of the smallest ids, one array a part position; a bounded number of rows."""
    head = rows.orderBy(F.asc_nulls_last(id_col), "_ints").limit(entries).select("_ints").collect()
    whole = np.array([r["_ints"] for r in head], np.int64).reshape(len(head), parts, -1 if head else 0)
    return [whole[:, p, :] for p in range(parts)]


def _moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry replaced by the componentwise floored mean of the parts nearest to it."""
    parts, entries, size = len(books), len(books[0]), books[0].shape[1]

    def run(batches):
        searches = [Orchard(b) for b in books]
        sums, counts = np.zeros((parts, entries, size), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                for p, x in enumerate(_cut(batch.column(0).slice(a, STEP), parts)):
                    code, _ = searches[p].search(x)
                    part = np.zeros((entries, size), np.int64)
                    np.add.at(part, code, x)
                    sums[p] += part  # whole numbers of any size
                    counts[p] += np.bincount(code, minlength=entries)
        used = [(p, e) for p in range(parts) for e in range(entries) if counts[p, e]]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(counts[u]) for u in used], pa.int64()),
                                          pa.array([[str(x) for x in sums[u]] for u in used], pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

    own = rows.select("_ints").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    # at most parts x entries x size numbers; tasks' rows are added before and after the exchange
    each = own.select("part", "entry", "n", F.posexplode("sums").alias("place", "total"))
    added = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    books = [b.copy() for b in books]
    for r in added:
        books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def fit(rows: DataFrame, id_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks fitted on all rows of integers()."""
    books = first_books(rows, id_col, parts, entries)
    if len(books[0]):
        for _ in range(rounds):
            books = _moved(rows, books)
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The columns of rows with code and error in place of `_ints`."""
    names = [c for c in rows.columns if c != "_ints"]
    base = rows.select(*names, "_ints")
    schema = base.select(*names, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema

    def run(batches):
        searches = [Orchard(b) for b in books]
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                few = batch.slice(a, STEP)
                found = [searches[p].search(x) for p, x in enumerate(_cut(few.column(few.num_columns - 1), len(books)))]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*few.columns[:-1], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(d for _, d in found), pa.int64())], [*names, "code", "error"])

    return base.mapInArrow(run, schema)


def decode(codes: DataFrame, books: list[np.ndarray], code_col: str = "code", scale: int = SCALE) -> DataFrame:
    """codes with `decoded`: the entries' middle points as numbers again."""
    table = [[[(float(x) + 0.5) / scale for x in entry] for entry in book] for book in books]

    def run(batches):
        for batch in batches:
            back = [None if c is None else [x for p, e in enumerate(bytes.fromhex(c)) for x in table[p][e]] for c in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(back, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "decoded"])

    base = codes.select("*", F.col(f"`{code_col}`").alias("_code"))
    return base.mapInArrow(run, codes.select("*", F.lit(None).cast("array<double>").alias("decoded")).schema)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


def with_label_error(codes: DataFrame, label_col: str) -> DataFrame:
    """codes plus label_error: errors summed over equal labels, nulls together.

    Sums are made before the exchange.  Labels of more than one row in HOT are few and meet their rows by broadcast; the other labels' rows are dealt by label."""
    label = F.col(label_col)
    total = codes.count()
    sums = stored(codes.groupBy(label.alias("_label")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
                  .select("_label", "_n", F.expr("try_cast(_sum as bigint)").alias("label_error")), "labels")
    common = F.col("_n") * HOT > total
    held = codes.join(F.broadcast(sums.where(common).select("_label", F.col("label_error").alias("_hot"), F.lit(True).alias("_met"))), label.eqNullSafe(F.col("_label")), "left").drop("_label")
    hot = held.where("_met").withColumn("label_error", F.col("_hot"))
    rest = held.where(F.col("_met").isNull()).join(sums.where(~common).select("_label", "label_error"), label.eqNullSafe(F.col("_label")))
    return hot.select(*codes.columns, "label_error").unionByName(rest.select(*codes.columns, "label_error"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error of every codable row; the final codebooks)."""
    rows = integers(vectors, vector_col, [F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").alias(label_col)], parts)
    lead = rows.orderBy(F.asc_nulls_last(id_col), "_ints").select(F.size("_ints").alias("n")).first()
    rows = stored(rows.where(F.size("_ints") == (lead["n"] if lead else 0)), "integers")
    books = fit(rows, id_col, parts, entries, rounds)
    return stored(encode(rows, books), "codes"), books


def op13_vector_codes(vectors: DataFrame) -> DataFrame:
    codes, books = compress(vectors)
    return with_label_error(codes, "label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(size: int = 64) -> str:
    """DuckDB statement of op13 for vectors of `size` components; every round is a step of its own."""
    width = size // PARTS
    steps = [f"""
kept as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as ints from embeddings
  where len(embedding) = {size} and list_aggregate(list_transform(embedding, lambda x: case when x is not null and isfinite(x) then 0 else 1 end), 'sum') = 0),
parts as materialized (select r, p, ints[p * {width} + 1 : (p + 1) * {width}] as x from kept, range({PARTS}) as t(p)),
book0 as (select p, row_number() over (partition by p order by vec_id, ints) - 1 as e, x from parts join (select r, vec_id, ints from kept order by vec_id, ints limit {ENTRIES}) using (r))"""]
    near = """select r, p, arg_min(e, (d, e)) as e, min(d) as d from (select r, parts.p, e, list_sum(list_transform(list_zip(parts.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
  from parts join book{k} b using (p)) group by r, p"""
    for k in range(ROUNDS):
        steps.append(f"near{k} as materialized ({near.format(k=k)})")
        steps.append(f"""book{k + 1} as materialized (select b.p, b.e, coalesce(m.x, b.x) as x from book{k} b left join (
  select p, e, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as x from (select p, e, j, sum(x[j + 1]) as s, count(*) as n
    from near{k} join parts using (r, p), range({width}) as t(j) group by p, e, j) group by p, e) m using (p, e))""")
    steps.append(f"final as materialized ({near.format(k=ROUNDS)})")
    steps.append("coded as (select r, string_agg(lpad(to_hex(e), 2, '0'), '' order by p) as code, sum(d)::bigint as error from final group by r)")
    steps.append(f"books as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as h from book{ROUNDS})")
    return "with " + ",\n".join(steps) + """
select vec_id, lower(code) as code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from kept join coded using (r), books"""

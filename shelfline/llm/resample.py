"""Importance resampling towards a target distribution: documents are drawn without replacement, with a chance that grows
with how much more often their words stand in the target than in the corpus.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lowered; features are all runs of 1 to `runs` consecutive
words, each counted into one of `buckets` places by the crc32 of its bytes.  The gain of a place is the log ratio of its
smoothed shares in target and corpus in thousandths; a document's weight is the sum of its features' gains, looked up in one
array of `buckets` numbers.  Keyed Gumbel noise on the weight makes the highest scores a draw by weight.

The cutoff is found by number: scores are written once, and exact counts over them halve the range of possible cutoffs (four
halvings a job), first of scores, then of the ids tied at the cutoff score.  Only rows at or over the cutoff are sorted: they
are range-partitioned, numbered inside partitions, and shifted by the partitions before.

Everything is columns; features are summed before the exchange.  Only `buckets` counts and the counted cutoffs reach the driver.

Edge cases: ids are whole numbers; a null text or one without words has no features and weight 0; a null id is keyed by the empty string and
counts as larger than any other; rows with equal ids are rows of their own, and where only some of those with equal score
fit, the ones of fewer features, then any of the equal rows, are drawn.  Documents under `least` words are scored, never
drawn.  An empty corpus gives no rows; with an empty target every place counts as unseen there.  Other columns are not read.
"""
from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

RUNS, BUCKETS, SEED, LEAST, PERCENT = 1, 10_000, 2024, 20, 10
CUTS = 15  # counts of one job: four halvings
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.filter(F.split(low, _APART), lambda w: w != "")


def places(ws: Column, runs: int, buckets: int) -> Column:
    """Bucket of every run of 1 to `runs` words."""
    of = lambda run: F.crc32(run.cast("binary")) % buckets

    def of_length(n: int) -> Column:
        # each run of n - 1 words beside the word after it; a slice inside the lambda would copy the text for every run
        grown = ws
        for k in range(2, n + 1):
            count = F.size(ws) - (k - 1)
            grown = F.zip_with(F.slice(grown, 1, F.greatest(count, F.lit(0))), F.slice(ws, k, F.greatest(count, F.lit(0))), lambda run, word: F.concat_ws(" ", run, word))
        return F.transform(grown, of)

    return F.concat(*map(of_length, range(1, runs + 1)))


def _featured(rows: DataFrame, text_col: str, keep: list[Column], runs: int, buckets: int) -> DataFrame:
    split = rows.select(*keep, words(F.col(f"`{text_col}`")).alias("_words"))
    return split.select(*[c for c in split.columns if c != "_words"], F.size("_words").cast("long").alias("n_words"), places(F.col("_words"), runs, buckets).alias("_places"))


def bucket_counts(rows: DataFrame, text_col: str, runs: int, buckets: int) -> dict[int, int]:
    """Features by bucket over all rows; at most `buckets` rows come back."""
    each = _featured(rows, text_col, [], runs, buckets).select(F.explode("_places").alias("place"))
    return {r["place"]: r["n"] for r in each.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    s_all, t_all = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    ratio = lambda s, t: (float(t + 1) * float(s_all)) / (float(s + 1) * float(t_all))
    return [math.floor(1000.0 * math.log(ratio(corpus.get(k, 0), target.get(k, 0)))) for k in range(buckets)]


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
           runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score of every document."""
    table = gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, target_col, runs, buckets), buckets)
    gain = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # constant: becomes one literal array
    rows = _featured(docs, text_col, [F.col(f"`{id_col}`").alias(id_col)], runs, buckets)
    rows = rows.select(id_col, "n_words", F.size("_places").cast("long").alias("n_features"),
                       F.aggregate("_places", F.lit(0).cast("long"), lambda total, k: total + gain[k.cast("int")]).alias("weight"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    chance = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return rows.withColumn("score", F.col("weight") + F.floor(-1000.0 * F.log(-F.log(chance))))


def _lowest(rows: DataFrame, column: str, low: int, high: int, enough: int, upward: bool) -> int:
    """Bisection for the cutoff c in [low, high] nearest the wanted end such that at least `enough` rows lie at or beyond it:
    the greatest c with count(column >= c) >= enough when upward, else the smallest c with count(column <= c) >= enough."""
    while low < high:
        step = max(1, (high - low) // (CUTS + 1))
        cuts = [c for c in range(low + step, high + 1, step)][:CUTS] if upward else [c for c in range(high - step, low - 1, -step)][:CUTS]
        beyond = (lambda c: F.col(column) >= c) if upward else (lambda c: F.col(column) <= c)
        counts = rows.agg(*(F.count_if(beyond(F.lit(c))).alias(f"c{k}") for k, c in enumerate(cuts))).first()
        held = [c for k, c in enumerate(cuts) if counts[k] >= enough]
        lost = [c for k, c in enumerate(cuts) if counts[k] < enough]
        if upward:
            low, high = (held[-1] if held else low), (lost[0] - 1 if lost else high)
        else:
            low, high = (lost[0] + 1 if lost else low), (held[-1] if held else high)
    return low


def draw(rows: DataFrame, quota: int, id_col: str, eligible: Column) -> DataFrame:
    """rows (written, with distinct numbers in _row) plus rank: 1, 2, ... for the `quota` eligible rows of highest score, ties to the smaller id; null for the rest."""
    able = rows.where(eligible)
    if quota <= 0:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    ends = able.agg(F.min("score"), F.max("score")).first()
    cut = _lowest(able, "score", ends[0], ends[1], quota, upward=True)
    tied = able.where(F.col("score") == cut)
    above = able.where(F.col("score") > cut).count()
    ids = tied.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    in_tie = F.lit(True)
    if ids[2] >= quota - above:  # else rows without id are needed too
        in_tie = F.coalesce(F.col(id_col) <= _lowest(tied, id_col, ids[0], ids[1], quota - above, upward=False), F.lit(False))
    picked = F.coalesce(eligible & ((F.col("score") > cut) | ((F.col("score") == cut) & in_tie)), F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features"), F.asc("_row")]
    # a number holds its partition in the high bits and its place inside the sorted partition in the low 33
    first = stored(rows.where(picked).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("_at", 33)
    sizes = first.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    ranked = first.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.when(place <= quota, place))
    return rows.where(~picked).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.select(*rows.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, id_col: str = "doc_id", **how) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every document; rank is null where it is not drawn."""
    rows = stored(scored(docs, target, id_col, **how).withColumn("_row", F.monotonically_increasing_id()), "scored")
    eligible = F.col("n_words") >= least
    return draw(rows, percent * rows.where(eligible).count() // 100, id_col, eligible).drop("_row")


def op11_resampling(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """DuckDB statement of op11; crc32 is folded over the distinct words' bytes."""
    found = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (ascii_uppercase, ascii_lowercase)
    return f"""
with tab as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
               lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as tab),
d as (select row_number() over () as r, doc_id, {found} as ws from documents),
dw as (select r, unnest(ws) as w from d),
bw as (select unnest({found}) as w from benchmark),
vocabulary as (select w, hex(encode(w)) as h from (select w from dw union select w from bw)),
coded as (select w, xor(4294967295, list_reduce([4294967295]::bigint[] || list_transform(range(length(h) // 2),
            lambda k: (strpos('0123456789ABCDEF', h[2 * k + 1]) * 16 + strpos('0123456789ABCDEF', h[2 * k + 2]) - 17)::bigint),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % {BUCKETS} as place from vocabulary, tab),
s as (select place, count(*) as s from dw join coded using (w) group by place),
t as (select place, count(*) as t from bw join coded using (w) group by place),
gain as (select place, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + {BUCKETS})::double)
           / ((s + 1)::double * ((select count(*) from bw) + {BUCKETS})::double)))::bigint as gain from s left join t using (place)),
weighed as (select r, sum(gain)::bigint as weight from dw join coded using (w) join gain using (place) group by r),
scored as (select d.doc_id, len(ws) as n_features, coalesce(weight, 0)::bigint as weight, coalesce(weight, 0)::bigint
             + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
           from d left join weighed using (r)),
placed as (select *, row_number() over (order by n_features >= {LEAST} desc, score desc, doc_id nulls last, n_features) as place from scored)
select doc_id, n_features::bigint as n_features, weight, score,
  case when n_features >= {LEAST} and place <= (select {PERCENT} * count(*) // 100 from scored where n_features >= {LEAST}) then place end::bigint as rank from placed"""

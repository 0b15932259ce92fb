"""Column profiles, header mapping, normalisation and dataset summaries."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.headers import best_scores
from ..schema import (CANONICAL_FIELDS, OPTIONAL_NUMERIC, OPTIONAL_TEXT, REQUIRED_FIELDS)

# fixed values: header synonyms per canonical field
SYNONYMS = {
    "sku_id": ["sku", "skuid", "item", "itemid", "product", "productid", "code", "partnum",
               "partno", "ean", "upc", "asin", "id"],
    "date": ["date", "dt", "day", "period", "ds", "timestamp", "time", "weekstart", "week",
             "month", "yearmonth", "ym"],
    "demand": ["demand", "qty", "quantity", "units", "sales", "sold", "shipped", "orderqty",
               "unitssold"],
    "on_hand": ["onhand", "stock", "inventory", "inv", "available", "soh", "stockonhand"],
    "lead_time_days": ["leadtime", "leadtimedays", "lt", "ltdays"],
    "unit_cost": ["unitcost", "cost", "cogs", "buyprice", "purchaseprice"],
    "unit_price": ["unitprice", "price", "sellprice", "retail", "retailprice", "listprice"],
    "supplier": ["supplier", "vendor", "vendorid", "manufacturer", "mfg", "brand"],
    "category": ["category", "cat", "department", "dept", "deptid", "family", "categoryid",
                 "group", "subcategory"],
}
# fixed values: fields a column type speaks for, and by how much
DTYPE_BONUS = {"date": (("date",), 0.2),
               "integer": (("demand", "on_hand", "lead_time_days", "unit_cost", "unit_price"), 0.05),
               "float": (("demand", "on_hand", "lead_time_days", "unit_cost", "unit_price"), 0.05),
               "string": (("sku_id", "supplier", "category"), 0.05)}
# fixed values: a mapping below its threshold is left open
THRESHOLD_REQUIRED, THRESHOLD_OPTIONAL = 0.55, 0.7
BEST = len(CANONICAL_FIELDS)  # headers a field needs at most
NULL_WORDS = ("nan", "NaN", "None", "")
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"


def _tall(df: DataFrame) -> DataFrame:
    """(column, value) with every value as text; equal values already counted."""
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return (text.unpivot([], list(df.columns), "column", "value")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def profile_columns(df: DataFrame, samples: int = 5) -> DataFrame:
    """Null share, distinct share and the smallest sample values of each column."""
    tall = _tall(df)
    stats = tall.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.round(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 4)
        .alias("null_pct"),
        F.round(F.count("value") / F.sum("n"), 4).alias("unique_pct"))
    return stats.join(_first_values(tall, samples, "sample_values"), "column", "left")


def _first_values(tall: DataFrame, k: int, out: str) -> DataFrame:
    first = W.partitionBy("column").orderBy("value")
    return (tall.where(F.col("value").isNotNull())
            .withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k)
            .groupBy("column").agg(F.sort_array(F.collect_list("value")).alias(out)))


def label_dtype(df: DataFrame) -> DataFrame:
    """date, integer, float or string from all values of a column."""
    v = F.col("value")
    number = F.bool_and(v.try_cast("double").isNotNull())
    is_date = F.bool_and(v.rlike(ISO_DATE) & v.try_cast("timestamp").isNotNull())
    return (_tall(df).where(v.isNotNull()).groupBy("column").agg(
        F.when(is_date, "date").when(number & F.bool_or(v.contains(".")), "float")
        .when(number, "integer").otherwise("string").alias("dtype")))


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def score_headers(headers: DataFrame, best: int | None = None) -> DataFrame:
    """(file_id, header, dtype) to (file_id, header, canonical, score).

    Each distinct header is scored once; the synonyms are a constant array that is
    exploded in place.  Inexact names are compared by edit distance.  With `best`, rows
    that cannot be among the `best` highest of their file and field are left out where
    the headers are read: no join, and nothing else crosses an exchange.
    """
    if best is not None:
        named = headers.where(F.col("header").isNotNull()).select("file_id", "header", "dtype", _clean(F.col("header")).alias("_h"))
        bonus = {dtype: dict.fromkeys(fields, extra) for dtype, (fields, extra) in DTYPE_BONUS.items()}
        return best_scores(named, SYNONYMS, bonus, best)
    pairs = F.array(*[F.struct(F.lit(c).alias("canonical"),
                               F.array(*[F.lit(s) for s in syn]).alias("names"))
                      for c, syn in SYNONYMS.items()])
    h = F.col("_h")

    def one(s):
        inside = F.contains(h, s) | F.contains(s, h)
        close = F.lit(1.0) - F.levenshtein(h, s) / F.greatest(F.length(h), F.length(s))
        return (F.when(h == s, 1.0)
                .when(F.startswith(h, s) | F.startswith(s, h), F.greatest(F.lit(0.85), close))
                .when(inside, F.greatest(F.lit(0.7), close)).otherwise(close))

    names = (headers.select("header").distinct().withColumn("_h", _clean(F.col("header")))
             .withColumn("_p", F.explode(pairs)))
    base = names.select(
        "header", F.col("_p.canonical").alias("canonical"),
        F.when(h == "", 0.0).otherwise(F.array_max(F.transform("_p.names", one))).alias("_base"))
    bonus = F.lit(0.0)
    for dtype, (fields, extra) in DTYPE_BONUS.items():
        bonus = F.when((F.col("dtype") == dtype) & F.col("canonical").isin(*fields), extra).otherwise(bonus)
    return (headers.join(base, "header")
            .select("file_id", "header", "canonical",
                    F.round(F.least(F.lit(1.0), F.col("_base") + bonus), 6).alias("score")))


def suggest_mapping(scores: DataFrame) -> DataFrame:
    """Greedy one-to-one choice per file, required fields first.

    At most eight headers can be taken before a field is served, so its nine best
    are enough (`BEST` of `score_headers`) and a file brings at most 81 candidates into
    the fold.
    """
    rank = {c: i for i, c in enumerate(CANONICAL_FIELDS)}
    best = W.partitionBy("file_id", "canonical").orderBy(F.desc("score"), "header")
    # one exchange, by file, serves the window and both lists
    top = scores.repartition("file_id").withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= len(rank))
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    lists = (top.groupBy("file_id", "canonical")
             .agg(F.sort_array(F.collect_list(F.struct("_rn", "header", "score"))).alias("c"))
             .groupBy("file_id")
             .agg(F.sort_array(F.collect_list(F.struct(
                 order[F.col("canonical")].alias("pos"), "canonical", "c"))).alias("fields")))
    empty = F.expr("named_struct('used', cast(array() as array<string>), 'out', "
                   "cast(array() as array<struct<canonical:string,header:string,confidence:double>>))")

    def step(acc, f):
        free = F.filter(f["c"], lambda x: ~F.array_contains(acc["used"], x["header"]))
        pick = F.get(free, F.lit(0))
        limit = F.when(f["pos"] < len(REQUIRED_FIELDS), THRESHOLD_REQUIRED).otherwise(THRESHOLD_OPTIONAL)
        taken = F.coalesce(pick["score"] >= limit, F.lit(False))
        return F.struct(
            F.when(taken, F.array_append(acc["used"], pick["header"])).otherwise(acc["used"]).alias("used"),
            F.array_append(acc["out"], F.struct(
                f["canonical"].alias("canonical"),
                F.when(taken, pick["header"]).alias("header"),
                F.round(F.coalesce(pick["score"], F.lit(0.0)), 3).alias("confidence"))).alias("out"))

    picked = lists.select("file_id", F.aggregate("fields", empty, step).alias("r"))
    return picked.select("file_id", F.inline_outer("r.out"))


def apply_mapping(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename mapped columns and drop the rest."""
    missing = [h for h in mapping.values() if h is not None and h not in df.columns]
    if missing:
        raise ValueError(f"mapped columns not in the input: {missing}")
    return df.select(*[F.col(f"`{h}`").alias(c) for c, h in mapping.items() if h is not None])


def parse_date(c: Column) -> Column:
    return F.coalesce(c.try_cast("timestamp"),
                      F.try_to_timestamp(c, F.lit("MM/dd/yyyy"))).cast("date")


def normalize_panel(df: DataFrame, mapping: dict) -> DataFrame:
    """Typed canonical panel; order is left to whoever writes or shows it."""
    mapped = apply_mapping(df, mapping)
    cols = []
    for c in mapped.columns:
        v = F.col(c).cast("string")
        if c == "date":
            e = parse_date(v)
        elif c == "sku_id":
            e = F.upper(F.trim(v))
        elif c == "demand" or c in OPTIONAL_NUMERIC:
            e = v.try_cast("double")
        elif c in OPTIONAL_TEXT:
            t = F.trim(v)
            e = F.when(~t.isin(*NULL_WORDS), t)
        else:
            e = F.col(c)
        cols.append(e.alias(c))
    return mapped.select(*cols)


def _frequency_of(median: Column) -> Column:
    return (F.when(median.between(0.5, 1.5), "D").when(median.between(6, 8), "W")
            .when(median.between(28, 32), "M"))


def infer_frequency(df: DataFrame, by: str | None = None) -> DataFrame:
    """Median gap between distinct dates, panel-wide or per `by`.

    Panel-wide the input of the unpartitioned window is the list of distinct
    calendar days, which does not grow with the number of SKUs.
    """
    keys = [by] if by else []
    dates = df.select(*keys, "date").where(F.col("date").isNotNull()).distinct()
    w = (W.partitionBy(*keys) if by else W).orderBy("date")
    gaps = dates.withColumn("_gap", F.datediff("date", F.lag("date").over(w)).cast("double"))
    agg = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dates"),
                                  F.percentile("_gap", 0.5).alias("median_gap"))
    return agg.select(*keys, "n_dates", "median_gap",
                      F.when(F.col("n_dates") >= 3, _frequency_of(F.col("median_gap"))).alias("frequency"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: counts, date range and which optional fields carry data.

    Distinct counts come from one pre-aggregation per (sku, category, supplier)
    instead of one expansion of the rows per counted column."""
    has = [F.max(F.col(c).isNotNull()).alias(f"has_{c}") for c in OPTIONAL_NUMERIC]
    small = df.groupBy("sku_id", "category", "supplier").agg(
        F.count(F.lit(1)).alias("_n"), F.min("date").alias("_lo"), F.max("date").alias("_hi"), *has)
    return small.agg(
        F.sum("_n").alias("n_rows"), F.count_distinct("sku_id").alias("n_skus"),
        F.min("_lo").alias("date_min"), F.max("_hi").alias("date_max"),
        F.count_distinct("category").alias("n_categories"),
        F.count_distinct("supplier").alias("n_suppliers"),
        *[F.max(f"has_{c}").alias(f"has_{c}") for c in OPTIONAL_NUMERIC])


def top_dims(df: DataFrame, n: int = 5) -> DataFrame:
    """Categories and suppliers with the most SKUs."""
    tall = (df.select("sku_id", "category", "supplier").distinct()
            .unpivot(["sku_id"], ["category", "supplier"], "dim", "value")
            .where(F.col("value").isNotNull()).distinct())
    counts = tall.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n_skus"))
    w = W.partitionBy("dim").orderBy(F.desc("n_skus"), "value")
    return (counts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
            .withColumn("pos", F.col("pos").cast("long")))


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return (df.orderBy("sku_id", "date").limit(n)
            .withColumn("date", F.date_format("date", "yyyy-MM-dd")))

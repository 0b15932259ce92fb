"""Hard schema checks and soft business checks; each yields at most one row."""
from pyspark.sql import DataFrame, Window as W, functions as F

from ..schema import REQUIRED_FIELDS
from .profile import parse_date

OUT = ("code", "severity", "field", "offending_row_count", "skus_affected")


def _finding(agg: DataFrame, code, severity, field, rows="n", skus=None, fires=None):
    fires = F.col(rows) > 0 if fires is None else fires
    return agg.where(fires).select(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"),
        F.lit(field).cast("string").alias("field"),
        F.col(rows).cast("long").alias("offending_row_count"),
        (F.col(skus) if skus else F.lit(None)).cast("long").alias("skus_affected"))


def _count(df, mask):
    return df.agg(F.count_if(mask).alias("n"))


def check_mapping(mapping: DataFrame) -> DataFrame:
    """Required fields without a header, per file of a (file_id, canonical, header) table."""
    open_fields = F.array_except(F.array(*[F.lit(f) for f in REQUIRED_FIELDS]), F.col("mapped"))
    mapped = mapping.groupBy("file_id").agg(F.collect_set(
        F.when(F.col("header").isNotNull() & F.col("canonical").isin(*REQUIRED_FIELDS),
               F.col("canonical"))).alias("mapped"))
    return mapped.select("file_id", F.explode(open_fields).alias("field")).select(
        "file_id", F.lit("MISSING_REQUIRED_MAPPING").alias("code"), F.lit("hard").alias("severity"),
        "field")


def sku_missing():
    return F.col("sku_id").isNull() | (F.trim(F.col("sku_id").cast("string")) == "")


def date_bad():
    return parse_date(F.col("date").cast("string")).isNull()


def demand_bad():
    return F.col("demand").cast("string").try_cast("double").isNull()


def check_sku(df):
    return _finding(_count(df, sku_missing()), "SKU_ID_NULL_OR_BLANK", "hard", "sku_id")


def check_date(df):
    return _finding(_count(df, date_bad()), "DATE_PARSE_FAILED", "hard", "date")


def check_demand(df):
    return _finding(_count(df, demand_bad()), "DEMAND_NOT_NUMERIC", "hard", "demand")


def _day_counts(df):
    """Row count per (sku, day): aggregated before the exchange, so a key with a large
    share of the rows never meets in one task."""
    return (df.where(~sku_missing() & ~date_bad())
            .groupBy(F.upper(F.trim("sku_id")).alias("sku_id"),
                     parse_date(F.col("date").cast("string")).alias("date"))
            .agg(F.count(F.lit(1)).alias("n")))


def duplicate_keys(df):
    return _day_counts(df).where(F.col("n") > 1)


def check_duplicates(df):
    return _finding(duplicate_keys(df).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")),
                    "SKU_DATE_DUPLICATES", "hard", None)


def schema_checks(df):
    """The four row checks; duplicates are only judged when ids and dates are clean."""
    one = df.agg(F.count_if(sku_missing()).alias("s"), F.count_if(date_bad()).alias("d"),
                 F.count_if(demand_bad()).alias("q"))
    dup = check_duplicates(df)
    clean = one.select((F.col("s") + F.col("d")) == 0).scalar()
    return (_finding(one, "SKU_ID_NULL_OR_BLANK", "hard", "sku_id", "s")
            .unionByName(_finding(one, "DATE_PARSE_FAILED", "hard", "date", "d"))
            .unionByName(_finding(one, "DEMAND_NOT_NUMERIC", "hard", "demand", "q"))
            .unionByName(dup.where(clean)))


def with_examples(finding: DataFrame, df: DataFrame, mask, k: int = 3) -> DataFrame:
    """Adds the first `k` offending rows in (sku, date) order, as JSON."""
    first = df.where(mask).orderBy("sku_id", "date").limit(k)
    examples = first.agg(F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns)))))
    return finding.withColumn("offending_examples", examples.scalar())


# ---- business checks --------------------------------------------------------

def sku_findings(df: DataFrame, window: int = 90, mult: float = 10.0, gap_mult: int = 5) -> DataFrame:
    """Per-SKU counts behind all six business checks, in one exchange by SKU.

    A SKU has one row per calendar day (checked above), so its group is bounded by
    the length of the calendar whatever the size of the panel."""
    by_date = W.partitionBy("sku_id").orderBy("date")
    trail = by_date.rowsBetween(-(window - 1), 0)
    both = F.col("unit_price").isNotNull() & F.col("unit_cost").isNotNull()
    med = F.percentile("demand", 0.5).over(trail)
    seen = F.count("demand").over(trail)
    rows = (df.withColumn("_med", med).withColumn("_seen", seen)
            .withColumn("_gap", F.datediff("date", F.lag("date").over(by_date)).cast("double")))
    return rows.groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("demand") < 0).alias("negative"),
        F.count_if(both).alias("priced"),
        F.count_if(both & (F.col("unit_price") < F.col("unit_cost"))).alias("below_cost"),
        F.count_if((F.col("lead_time_days") > 365) | (F.col("lead_time_days") < 0)).alias("lead_time"),
        F.count_if((F.col("_seen") >= 10) & (F.col("_med") > 0)
                   & (F.col("demand") > mult * F.col("_med"))).alias("spikes"),
        (F.max(F.when(F.col("on_hand").isNotNull(), F.struct("date", "on_hand"))).getField("on_hand")
         > 365 * F.max("demand")).alias("implausible"),
        ((F.count(F.lit(1)) >= 3) & (F.percentile("_gap", 0.5) > 0)
         & (F.max("_gap") > gap_mult * F.percentile("_gap", 0.5))).alias("gaps"))


def _from_counts(per_sku, code, field, column, fires=None):
    agg = per_sku.agg(F.sum(column).alias("n"), F.count_if(F.col(column) > 0).alias("k"),
                      F.sum("priced").alias("priced"))
    return _finding(agg, code, "soft", field, "n", "k", fires)


def _from_flags(per_sku, code, field, column):
    agg = per_sku.agg(F.sum(F.when(F.col(column), F.col("n_rows"))).alias("n"),
                      F.count_if(F.col(column)).alias("k"))
    return _finding(agg, code, "soft", field, "n", "k")


def check_negative(df):
    return _from_counts(sku_findings(df), "NEGATIVE_DEMAND", "demand", "negative")


def check_price(df):
    return _from_counts(sku_findings(df), "PRICE_BELOW_COST", "unit_price", "below_cost",
                        (F.col("n") > 0) & (F.col("n") >= 0.05 * F.col("priced")))


def check_lead_time(df):
    return _from_counts(sku_findings(df), "LEAD_TIME_OUT_OF_RANGE", "lead_time_days", "lead_time")


def check_spikes(df, window=90, mult=10.0):
    return _from_counts(sku_findings(df, window, mult), "DEMAND_SPIKE_OUTLIER", "demand", "spikes")


def check_on_hand(df):
    return _from_flags(sku_findings(df), "ON_HAND_IMPLAUSIBLE", "on_hand", "implausible")


def check_gaps(df):
    return _from_flags(sku_findings(df), "DATE_GAPS_IN_ACTIVE_WINDOW", "date", "gaps")


def business_checks(df: DataFrame) -> DataFrame:
    """All six in one pass: one total per check, unpivoted to rows."""
    p = sku_findings(df)
    counts = {"NEGATIVE_DEMAND": ("demand", "negative"), "PRICE_BELOW_COST": ("unit_price", "below_cost"),
              "LEAD_TIME_OUT_OF_RANGE": ("lead_time_days", "lead_time"),
              "DEMAND_SPIKE_OUTLIER": ("demand", "spikes")}
    flags = {"ON_HAND_IMPLAUSIBLE": ("on_hand", "implausible"),
             "DATE_GAPS_IN_ACTIVE_WINDOW": ("date", "gaps")}
    aggs, rows = [F.sum("priced").alias("priced")], []
    for i, (code, (field, c)) in enumerate(counts.items()):
        aggs += [F.sum(c).alias(f"n{i}"), F.count_if(F.col(c) > 0).alias(f"k{i}")]
        rows.append((code, field, i))
    for i, (code, (field, c)) in enumerate(flags.items(), len(counts)):
        aggs += [F.sum(F.when(F.col(c), F.col("n_rows")).otherwise(0)).alias(f"n{i}"),
                 F.count_if(F.col(c)).alias(f"k{i}")]
        rows.append((code, field, i))
    items = F.array(*[F.struct(
        F.lit(code).alias("code"), F.lit("soft").alias("severity"), F.lit(field).alias("field"),
        F.col(f"n{i}").alias("offending_row_count"), F.col(f"k{i}").alias("skus_affected"))
        for code, field, i in rows])
    rare = (F.col("code") == "PRICE_BELOW_COST") & (F.col("offending_row_count") < 0.05 * F.col("priced"))
    return (p.agg(*aggs).select("priced", F.inline(items))
            .where((F.col("offending_row_count") > 0) & ~rare).select(*OUT))

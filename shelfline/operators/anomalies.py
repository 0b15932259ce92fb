"""Robust z-scores, CUSUM, anomaly events and their context."""
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import arrays as A

MAD_SCALE = 1.4826
CUSUM_K, CUSUM_H = 0.5, 4.0
# fixed values: fixed-date holidays (month, day, label)
HOLIDAYS = (
    (1, 1, "New Year's Day"), (2, 14, "Valentine's Day"), (7, 4, "Independence Day"),
    (10, 31, "Halloween"), (11, 11, "Veterans Day"), (12, 24, "Christmas Eve"),
    (12, 25, "Christmas Day"), (12, 31, "New Year's Eve"))


def by_date():
    return W.partitionBy("sku_id").orderBy("date")


def _median(sorted_arr):
    n = F.size(sorted_arr)
    return (F.get(sorted_arr, ((n - 1) / 2).cast("int")) + F.get(sorted_arr, (n / 2).cast("int"))) / 2


def robust_z(df: DataFrame) -> DataFrame:
    """Centred rolling median / MAD score over the whole history of each SKU.

    The half width is 2 to 6 depending on the SKU's length; the widest frame is
    collected once and cut to the SKU's own width."""
    rows = (df.select("sku_id", "date", "demand")
            .withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("sku_id")))
            .where(F.col("_n") >= 8)
            .withColumn("_i", F.row_number().over(by_date()) - 1))
    window = F.greatest(F.lit(5), F.least(F.lit(13), F.floor(F.col("_n") / 4)))
    half = F.floor(window / 2).cast("int")
    widest = F.collect_list("demand").over(by_date().rowsBetween(-6, 6))
    rows = rows.withColumn("_half", half).withColumn("_wide", widest)
    here = F.least(F.col("_i"), F.lit(6))            # own position inside the wide frame
    lo = F.greatest(F.lit(0), here - F.col("_half"))
    own = F.slice("_wide", lo + 1, here + F.col("_half") - lo + 1)
    rows = rows.withColumn("_own", own).withColumn("median", _median(F.array_sort("_own")))
    dev = F.array_sort(F.transform("_own", lambda v: F.abs(v - F.col("median"))))
    rows = rows.withColumn("mad", F.greatest(_median(dev), F.lit(1e-9)))
    return rows.select("sku_id", "date", "demand", "_i", "median", "mad",
                       ((F.col("demand") - F.col("median")) / (MAD_SCALE * F.col("mad"))).alias("z"))


def cusum(df: DataFrame) -> DataFrame:
    """One-sided CUSUMs of the z-score from the second row on, folded over the SKU's rows in order (their number is
    bounded by the calendar): differences of running sums would lose digits where the MAD is zero."""
    row = F.struct("date", "demand", "_i", "median", "mad", "z")
    one = robust_z(df).groupBy("sku_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    zero = F.lit(0.0)

    def step(acc, x):
        first = x["_i"] == 0
        return F.struct(F.when(first, zero).otherwise(F.greatest(zero, acc["pos"] + x["z"] - CUSUM_K)).alias("pos"),
                        F.when(first, zero).otherwise(F.least(zero, acc["neg"] + x["z"] + CUSUM_K)).alias("neg"))

    sums = A.scan(F.col("r"), F.struct(zero.alias("pos"), zero.alias("neg")), step)
    rows = one.select("sku_id", F.explode_outer(F.arrays_zip(F.col("r"), sums.alias("c"))).alias("x"))
    return rows.select("sku_id", "x.r.*", F.col("x.c.pos").alias("cusum_pos"), F.col("x.c.neg").alias("cusum_neg"))


def events(df: DataFrame, threshold: float = 2.5) -> DataFrame:
    c = cusum(df)
    trip = (F.col("cusum_pos") >= CUSUM_H) | (F.col("cusum_neg") <= -CUSUM_H)
    az = F.abs("z")
    return (c.where((az >= threshold) | trip).select(
        "sku_id", "date", F.col("demand").alias("value"),
        F.when(F.col("z") >= 0, "spike").otherwise("drop").alias("direction"),
        F.col("z").alias("magnitude_z"),
        F.when(F.abs("cusum_pos") > F.abs("cusum_neg"), F.col("cusum_pos"))
        .otherwise(F.col("cusum_neg")).alias("cusum_score"),
        F.col("median").alias("baseline_mean"), (MAD_SCALE * F.col("mad")).alias("baseline_std"),
        F.when((az > 4) | trip, "crit").when(az > 3, "warn").otherwise("info").alias("severity")))


def anomalies(df: DataFrame, threshold: float = 2.5, k: int = 5) -> DataFrame:
    """Up to `k` strongest events per SKU."""
    w = W.partitionBy("sku_id").orderBy(F.desc(F.round(F.abs("magnitude_z"), 6)), "date")
    return (events(df, threshold).withColumn("pos", F.row_number().over(w))
            .where(F.col("pos") <= k).withColumn("pos", F.col("pos").cast("long")))


def anomaly_near(df: DataFrame, anchor: str, threshold: float = 2.5) -> DataFrame:
    """The event nearest to a date, per SKU (the earlier one on a tie)."""
    e = events(df, threshold)
    key = F.struct(F.abs(F.datediff("date", F.lit(anchor).cast("date"))), F.col("date"))
    return (e.groupBy("sku_id").agg(F.min_by(F.struct(*[c for c in e.columns if c != "sku_id"]), key)
                                    .alias("e")).select("sku_id", "e.*"))


def siblings(df: DataFrame, k: int = 3) -> DataFrame:
    """Top `k` other SKUs of the same category by revenue (units where unpriced).

    Each category keeps its k+1 best, found with a limit pushed below the exchange,
    and every SKU is matched with that short list only."""
    per = df.groupBy("sku_id", "category").agg(
        F.coalesce(F.sum(F.col("demand") * F.col("unit_price")), F.sum("demand"))
        .alias("revenue_proxy")).where(F.col("category").isNotNull())
    per = per.withColumn("revenue_proxy", F.round("revenue_proxy", 2))
    best = W.partitionBy("category").orderBy(F.desc("revenue_proxy"), "sku_id")
    top = (per.withColumn("_p", F.row_number().over(best)).where(F.col("_p") <= k + 1)
           .groupBy("category").agg(F.sort_array(F.collect_list(
               F.struct("_p", F.col("sku_id").alias("sibling"), "revenue_proxy"))).alias("_top")))
    # one row per category, at most k+1 entries each
    rows = per.select("sku_id", "category").join(top, "category")
    others = F.slice(F.filter("_top", lambda t: t["sibling"] != F.col("sku_id")), 1, k)
    return (rows.select("sku_id", "category", F.posexplode(others).alias("pos", "s"))
            .select("sku_id", "category", (F.col("pos") + 1).cast("long").alias("pos"),
                    "s.sibling", "s.revenue_proxy"))


def calendar_context(ev: DataFrame, window_days: int = 14) -> DataFrame:
    """Holidays within two weeks and month edges, as labels per event row."""
    day, labels = F.col("date"), []
    for month, dom, label in HOLIDAYS:
        found = F.lit(None).cast("string")
        for shift in (1, 0, -1):
            h = F.make_date(F.year(day) + shift, F.lit(month), F.lit(dom))
            found = F.when(F.abs(F.datediff(h, day)) <= window_days,
                           F.concat(F.lit(f"{label} ("), F.date_format(h, "yyyy-MM-dd"), F.lit(")"))
                           ).otherwise(found)
        labels.append(found)
    dom, name = F.dayofmonth(day), F.date_format(day, "MMMM")
    labels.append(F.when(dom <= 3, F.concat(F.lit("first "), dom.cast("string"), F.lit(" day(s) of "), name)))
    labels.append(F.when(dom >= 28, F.concat(F.lit("end of "), name)))
    return ev.withColumn("context", F.filter(F.array(*labels), lambda x: x.isNotNull()))


def judge_event(ev: DataFrame) -> DataFrame:
    """Deterministic cause, confidence, evidence and action for each event."""
    e = calendar_context(ev)
    near = F.size("context") > 0
    z = F.concat(F.when(F.col("magnitude_z") >= 0, "+").otherwise("-"),
                 F.format_string("%.1f", F.abs(F.round("magnitude_z", 1))))
    first = F.concat(F.lit("Robust z = "), z, F.lit(" on "), F.date_format("date", "yyyy-MM-dd"),
                     F.lit(" ("), F.col("direction"), F.lit(")"))
    second = F.when(near, F.concat(F.lit("Calendar markers within ±2 weeks: "),
                                   F.array_join("context", ", ")))
    return e.select("sku_id", "date",
                    F.when(near, "holiday_or_calendar").otherwise("unclear").alias("cause"),
                    F.when(near, 0.3).otherwise(0.15).alias("confidence"),
                    F.filter(F.array(first, second), lambda x: x.isNotNull()).alias("evidence"),
                    F.lit("investigate_manually").alias("suggested_adjustment"),
                    F.lit("heuristic").alias("source"))

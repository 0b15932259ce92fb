"""Per-SKU series statistics: autocorrelation, patterns, features, decomposition.

All of it is windows and aggregates partitioned by SKU, so a plan has one exchange
by SKU; a SKU's partition is bounded by the calendar.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import SEASON_LENGTH

# fixed values: seasonal lags, model lags and rolling windows per frequency
SEASONAL_LAGS = {"D": (7, 14, 28, 365), "W": (4, 13, 26, 52), "M": (3, 6, 12)}
MODEL_LAGS = {"D": (1, 7, 14, 28), "W": (1, 4, 13, 26), "M": (1, 3, 6, 12)}
ROLLING = {"D": (7, 28), "W": (4, 13), "M": (3, 6)}
ACF_THRESHOLD = 0.3
METRICS = ("cv_demand", "intermittency_rate", "seasonality_strength", "trend_slope_pct",
           "regime_shift_score")
FEATURES = ("n_obs", "zero_pct", "cv_demand", "cv_nonzero_demand", "acf_lag_7", "acf_lag_28",
            "acf_lag_365", "trend_slope_pct", "last_90d_vs_baseline_ratio")


def by_date():
    return W.partitionBy("sku_id").orderBy("date")


def whole():
    return W.partitionBy("sku_id")


def indexed(df: DataFrame, lags=()) -> DataFrame:
    """Adds rn (0-based), n, back (1 = latest row) and the asked lags."""
    rn = F.row_number().over(by_date())
    n = F.count(F.lit(1)).over(whole())
    return (df.withColumn("rn", rn - 1).withColumn("n", n)
            .withColumn("back", F.col("n") - F.col("rn"))
            .withColumns({f"lag_{k}": F.lag("demand", k).over(by_date()) for k in lags}))


def acf_agg(k: int) -> Column:
    """Lag-k correlation of the two overlapping parts, each about its own mean.

    Built from covariance and variances: the built-in corr divides before a guard can
    act and fails on a constant series."""
    x, y = F.col(f"lag_{k}"), F.col("demand")
    pairs = F.count(x)
    var = lambda c: F.var_pop(F.when(x.isNotNull(), c))
    spread = F.sqrt(var(x) * var(y))
    flat = F.coalesce(spread * pairs < 1e-9, F.lit(True))
    return (F.when((F.count(F.lit(1)) <= k + 1) | flat, 0.0)
            .otherwise(F.try_divide(F.covar_pop(x, y), spread)))


def acf(df: DataFrame, lag: int) -> DataFrame:
    return indexed(df, (lag,)).groupBy("sku_id").agg(acf_agg(lag).alias("acf"))


def seasonal_flag_agg(freq: str) -> Column:
    hits = [(F.count(F.lit(1)) > k + 5) & (acf_agg(k) > ACF_THRESHOLD) for k in SEASONAL_LAGS[freq]]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def is_seasonal(df: DataFrame, freq: str) -> DataFrame:
    return (indexed(df, SEASONAL_LAGS[freq]).groupBy("sku_id")
            .agg(seasonal_flag_agg(freq).alias("seasonal")))


def zero_share() -> Column:
    return F.avg(F.when(F.col("demand") == 0, 1.0).otherwise(0.0))


def pattern_rule(n: Column, zero: Column, seasonal: Column, short: int = 13) -> Column:
    return (F.when(n < short, "trending_new").when(zero > 0.7, "lumpy")
            .when(zero > 0.3, "intermittent").when(seasonal, "seasonal").otherwise("smooth"))


def characterize(df: DataFrame, freq: str) -> DataFrame:
    """Pattern label per SKU from length, zero share and seasonal correlation."""
    agg = (indexed(df.where(F.col("demand").isNotNull()), SEASONAL_LAGS[freq]).groupBy("sku_id")
           .agg(F.count(F.lit(1)).alias("n_obs"), zero_share().alias("zero_pct"),
                seasonal_flag_agg(freq).alias("seasonal")))
    return agg.withColumn("pattern", pattern_rule(F.col("n_obs"), F.col("zero_pct"), F.col("seasonal")))


def _slope_pct() -> Column:
    mean = F.avg("demand")
    return (F.when((F.count(F.lit(1)) < 30) | (mean <= 0), 0.0)
            .otherwise(F.try_divide(F.covar_pop(F.col("rn").cast("double"), F.col("demand")), F.var_pop("rn")) / mean * 100))


def _ratio(last: int, base: int, default: Column) -> Column:
    recent = F.avg(F.when(F.col("back") <= last, F.col("demand")))
    prior = F.avg(F.when((F.col("back") > last) & (F.col("back") <= last + base), F.col("demand")))
    return (F.when((F.count(F.lit(1)) < last + base) | (prior <= 0), default)
            .otherwise(recent / prior))


def _cv(c: Column) -> Column:
    return F.when(F.avg(c) > 0, F.stddev_pop(c) / F.avg(c)).otherwise(0.0)


def pattern_features(df: DataFrame) -> DataFrame:
    """Nine features per SKU in one aggregate."""
    pos = F.when(F.col("demand") > 0, F.col("demand"))
    n = F.count(F.lit(1))
    return indexed(df, (7, 28, 365)).groupBy("sku_id").agg(
        n.alias("n_obs"), zero_share().alias("zero_pct"), _cv(F.col("demand")).alias("cv_demand"),
        F.when((F.count(pos) > 1) & (F.avg(pos) > 0), F.stddev_pop(pos) / F.avg(pos))
        .otherwise(0.0).alias("cv_nonzero_demand"),
        acf_agg(7).alias("acf_lag_7"), acf_agg(28).alias("acf_lag_28"),
        F.when(n > 366, acf_agg(365)).otherwise(0.0).alias("acf_lag_365"),
        _slope_pct().alias("trend_slope_pct"),
        _ratio(90, 180, F.lit(1.0)).alias("last_90d_vs_baseline_ratio"))


def weak_labels(feats: DataFrame) -> DataFrame:
    """Training labels of the pattern classifier (its own length limit of 90)."""
    seasonal = ((F.col("acf_lag_7") > ACF_THRESHOLD) | (F.col("acf_lag_28") > ACF_THRESHOLD)
                | (F.col("acf_lag_365") > ACF_THRESHOLD))
    return feats.withColumn("pattern", pattern_rule(F.col("n_obs"), F.col("zero_pct"), seasonal, short=90))


def series_metrics(df: DataFrame) -> DataFrame:
    """The five quality metrics per SKU."""
    return indexed(df, (7, 28, 365)).groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("n_obs"), _cv(F.col("demand")).alias("cv_demand"),
        zero_share().alias("intermittency_rate"),
        F.greatest(acf_agg(7), acf_agg(28), acf_agg(365)).alias("seasonality_strength"),
        F.abs(_slope_pct()).alias("trend_slope_pct"),
        F.abs(_ratio(90, 180, F.lit(1.0)) - 1.0).alias("regime_shift_score"))


def regime_break(df: DataFrame, last: int = 30, prior: int = 60) -> DataFrame:
    """SKUs whose recent mean is below half or above twice the prior mean."""
    out = indexed(df).groupBy("sku_id").agg(
        _ratio(last, prior, F.lit(None).cast("double")).alias("ratio"))
    return out.where((F.col("ratio") < 0.5) | (F.col("ratio") > 2.0)).withColumn(
        "note", F.format_string(f"recent {last}-period mean is %.2fx prior {prior}-period mean", "ratio"))


# ---- model features ---------------------------------------------------------

def add_lags(df: DataFrame, freq: str) -> DataFrame:
    return df.withColumns({f"lag_{k}": F.lag("demand", k).over(by_date()) for k in MODEL_LAGS[freq]})


def add_rolling(df: DataFrame, freq: str) -> DataFrame:
    """Mean of the previous w rows, at least two of them."""
    cols = {}
    for w in ROLLING[freq]:
        past = by_date().rowsBetween(-w, -1)
        cols[f"rmean_{w}"] = F.when(F.count("demand").over(past) >= 2, F.avg("demand").over(past))
    return df.withColumns(cols)


def add_calendar(df: DataFrame) -> DataFrame:
    day = F.col("date")
    return df.withColumns({
        "dow": F.weekday(day).cast("int"), "woy": F.weekofyear(day).cast("int"),
        "month": F.month(day).cast("int"),
        "is_month_end": (day == F.last_day(day)).cast("int"),
        "is_year_end": ((F.month(day) == 12) & (F.dayofmonth(day) == 31)).cast("int")})


def attach_attributes(df: DataFrame, attrs: DataFrame, neutral: dict) -> DataFrame:
    """Left join of per-SKU scores, missing ones set to their neutral value."""
    return df.join(attrs.select("sku_id", *neutral), "sku_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in neutral.items()})


def model_columns(freq: str) -> list[str]:
    return ([f"lag_{k}" for k in MODEL_LAGS[freq]] + [f"rmean_{w}" for w in ROLLING[freq]]
            + ["dow", "woy", "month", "is_month_end", "is_year_end"])


# ---- decomposition -----------------------------------------------------------

def decompose(df: DataFrame, freq: str) -> DataFrame:
    """observed = trend + seasonal + residual for SKUs with at least 12 rows.

    Window widths depend on the SKU's length, so the centred mean is taken from
    running sums at both ends of the window instead of a fixed frame.  The sums of a
    SKU stand in one array; its rows are made from that array again, so the work is
    linear in the rows and stays in the one exchange by SKU.
    """
    base = indexed(df.select("sku_id", "date", "demand")).where(F.col("n") >= 12)
    p = F.least(F.lit(SEASON_LENGTH[freq]), F.greatest(F.lit(2), F.floor(F.col("n") / 3))).cast("int")
    run = by_date().rowsBetween(W.unboundedPreceding, 0)
    base = base.withColumn("_cum", F.sum("demand").over(run))
    rows = F.array_sort(F.collect_list(F.struct("rn", "date", "demand", "_cum")))
    one = base.groupBy("sku_id").agg(F.count(F.lit(1)).cast("int").alias("n"), rows.alias("_rows")).withColumn("period", p)

    def width(w):
        return F.when(F.col("n") < w, F.greatest(F.lit(2), F.floor(F.col("n") / 2))).otherwise(w).cast("int")

    one = one.withColumns({"_w": width(F.greatest("period", F.lit(4))), "_v": width(F.col("period"))})

    def centred(w, i):
        w = F.col(w)
        left, right = F.floor(w / 2).cast("int"), F.floor((w - 1) / 2).cast("int")
        lo = F.greatest(F.lit(0), i - left)
        hi = F.least(F.col("n") - 1, i + right)
        upto = F.get("_rows", hi)["_cum"]
        before = F.when(lo > 0, F.get("_rows", lo - 1)["_cum"]).otherwise(0.0)
        return (upto - before) / (hi - lo + 1)

    base = one.select("sku_id", "n", "period", F.inline_outer(F.transform("_rows", lambda r, i: F.struct(
        r["rn"].alias("rn"), r["date"].alias("date"), r["demand"].alias("demand"),
        centred("_w", i).alias("trend"), centred("_v", i).alias("_short")))))
    phase = F.col("rn") % F.col("period")
    base = base.withColumn("_phase", phase)
    det = F.col("demand") - F.col("_short")
    by_phase = W.partitionBy("sku_id", "_phase")
    base = base.withColumn("_mean", F.avg(det).over(by_phase))
    # mean of the phase means: every phase counted once, on its first cycle
    first = F.when(F.col("rn") < F.col("period"), F.col("_mean"))
    base = base.withColumn("_centre", F.sum(first).over(whole()) / F.col("period"))
    seasonal = F.when(F.col("n") < 2 * F.col("period"), 0.0).otherwise(F.col("_mean") - F.col("_centre"))
    return base.select("sku_id", "date", F.col("demand").alias("observed"), "trend",
                       seasonal.alias("seasonal"),
                       (F.col("demand") - F.col("trend") - seasonal).alias("residual"),
                       F.col("period").cast("long").alias("seasonal_period"))


def trend(df, freq):
    return decompose(df, freq).select("sku_id", "date", "trend")


def seasonal(df, freq):
    return decompose(df, freq).select("sku_id", "date", "seasonal", "seasonal_period")

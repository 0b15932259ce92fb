"""Backtests, accuracy metrics, ensemble weights and conformal intervals."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import folds as folds_of
from ..schema import QUANTILE_COLS, QUANTILE_LEVELS
from .forecast import array_pattern, classical_fc, fit_seasonal_ar, single_fc, to_series


def cutoff_array(n: Column, h: Column, folds: int) -> Column:
    """Rolling-origin cutoffs; empty when fewer than eight training rows remain."""
    last = n - h
    first = F.greatest(F.lit(8), last - (folds - 1) * h)
    step = F.greatest(F.lit(1), F.floor((last - first) / max(1, folds - 1)).cast("int"))
    many = F.slice(F.sequence(first.cast("int"), F.greatest(first, last).cast("int"), step), 1, folds)
    return (F.when(last < 8, F.array().cast("array<int>")).when(last <= first, F.array(last.cast("int"))).otherwise(many))


def cutoffs(df: DataFrame, h: int, folds: int) -> DataFrame:
    n = df.groupBy("sku_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select("sku_id", F.posexplode(cutoff_array(F.col("n"), F.lit(h), folds)).alias("fold", "cutoff"))


def fold_rows(series: DataFrame, h, folds: int) -> DataFrame:
    """One row per series and fold: the training prefix `train`, the held-out `actual`."""
    h = F.lit(h) if isinstance(h, int) else h
    s = series.withColumn("_h", h.cast("int"))
    s = s.withColumn("_c", cutoff_array(F.col("n"), F.col("_h"), folds))
    s = s.select(*[c for c in s.columns if c != "_c"], F.posexplode("_c").alias("fold", "cutoff"))
    return (s.withColumn("train", F.slice("y", 1, F.col("cutoff")))
            .withColumn("actual", F.slice("y", F.col("cutoff") + 1, F.col("_h"))))


def backtest(series: DataFrame, freq: str, method: str = "route", h: int = 4, folds: int = 4,
             h_col: Column | None = None, panel: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """Rows (sku_id, method, fold, cutoff, step, actual, point, quantiles, scale).

    The fold is a column, so all folds of all SKUs are one projection.  With
    method="route" the pattern is judged on every training prefix (or taken from the
    column `pattern`); the seasonal route is fitted on rows before the earliest cutoff
    of each SKU so that no fold sees its own test rows."""
    f = fold_rows(series, h if h_col is None else h_col, folds)
    if method == "route":
        if pattern is None:
            f = f.withColumn("_pattern", array_pattern(F.col("train"), freq))
        else:
            f = f.withColumn("_pattern", F.col(pattern))
        ar = None
        if panel is not None:
            lead = h * folds
            ar = fit_seasonal_ar(panel, freq, F.col("n") - lead)
        f = classical_fc(f, h, freq, ar, y="train", pattern="_pattern")
    else:
        f = single_fc(f, method, h, freq, y="train")
    # MASE scale: mean absolute first difference of the training prefix
    f = f.withColumn("scale", folds_of.difference_mean(F.col("train")))
    z = F.arrays_zip("actual", "fc")
    return (f.select("sku_id", "method", "fold", "cutoff", "scale", F.explode_outer(F.slice(z, F.lit(1), F.size("actual"))).alias("r"))
            .select("sku_id", "method", "fold", "cutoff", "scale", F.col("r.fc.step").alias("step"),
                    F.col("r.actual").alias("actual"), F.col("r.fc.point").alias("point"),
                    *[F.col(f"r.fc.{c}").alias(c) for c in QUANTILE_COLS]))


# ---- metrics: aggregate expressions over backtest rows ----------------------------------

def mape() -> Column:
    y = F.col("actual")
    return F.avg(F.when(F.abs(y) > 1e-9, F.abs((y - F.col("point")) / y))) * 100


def smape() -> Column:
    den = F.abs("actual") + F.abs("point")
    return F.avg(F.when(den > 1e-9, 2.0 * F.abs(F.col("actual") - F.col("point")) / den)) * 100


def mase() -> Column:
    return F.when(F.max("scale") >= 1e-9, F.avg(F.abs(F.col("actual") - F.col("point"))) / F.max("scale"))


def bias() -> Column:
    den = F.avg(F.abs("actual"))
    return F.when(den >= 1e-9, F.avg(F.col("point") - F.col("actual")) / den)


def pinball(q: str, level: float) -> Column:
    d = F.col("actual") - F.col(q)
    return F.avg(F.when(d >= 0, level * d).otherwise((level - 1) * d))


def crps_quantiles() -> Column:
    total = pinball(QUANTILE_COLS[0], QUANTILE_LEVELS[0])
    for c, lv in zip(QUANTILE_COLS[1:], QUANTILE_LEVELS[1:]):
        total = total + pinball(c, lv)
    return 2.0 * total / len(QUANTILE_LEVELS)


def metric_columns() -> list[Column]:
    """All six; the 95 % pinball is taken on the 0.975 quantile."""
    return [mape().alias("mape"), smape().alias("smape"), mase().alias("mase"), crps_quantiles().alias("crps"),
            bias().alias("bias"), pinball("q975", 0.95).alias("pinball_q95")]


METRIC_NAMES = ("mape", "smape", "mase", "crps", "bias", "pinball_q95")


def fold_metrics(bt: DataFrame) -> DataFrame:
    return bt.groupBy("sku_id", "method", "fold").agg(*metric_columns())


def backtest_summary(bt: DataFrame, by_method: bool = True) -> DataFrame:
    """Mean over folds per SKU; a fold without a metric is left out of its mean."""
    keys = ["sku_id", "method"] if by_method else ["sku_id"]
    f = fold_metrics(bt)
    extra = [] if by_method else [F.max_by("method", "fold").alias("method")]
    return f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), *extra, *[F.avg(m).alias(m) for m in METRIC_NAMES])


def crps_samples(samples: DataFrame) -> DataFrame:
    """Energy form per SKU from (sku_id, step, actual, x).

    The mean absolute difference of all sample pairs comes from the sorted samples
    (sum of (2i - n - 1) x_i), so pairs are never formed."""
    w = W.partitionBy("sku_id", "step")
    i = F.row_number().over(w.orderBy("x"))
    n = F.count(F.lit(1)).over(w)
    s = samples.withColumn("_i", i).withColumn("_n", n)
    g = s.groupBy("sku_id", "step").agg(
        (F.avg(F.abs(F.col("x") - F.col("actual")))
         - F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col("x")) / F.max("_n") / F.max("_n")).alias("c"))
    return g.groupBy("sku_id").agg(F.avg("c").alias("crps"))


def holdout_horizon(h: int) -> Column:
    return F.least(F.lit(h), F.greatest(F.lit(2), F.floor(F.col("n") / 5).cast("int")))


def holdout_crps(df: DataFrame, freq: str, method: str, h: int) -> DataFrame:
    """CRPS of a member on the last rows of each SKU."""
    bt = backtest(to_series(df), freq, method, h, 1, h_col=holdout_horizon(h))
    return bt.groupBy("sku_id", "method").agg(crps_quantiles().alias("crps"))


# ---- ensemble -------------------------------------------------------------------------------

def crps_weights(members: DataFrame) -> DataFrame:
    """Weights proportional to 1 / CRPS per SKU; equal when no member has one."""
    w = W.partitionBy("sku_id")
    inv = F.when(F.col("crps") > 0, 1.0 / F.col("crps"))
    m = members.withColumn("_inv", inv).withColumn("_sum", F.sum("_inv").over(w)).withColumn("_k", F.count(F.lit(1)).over(w))
    return m.withColumn("weight", F.when(F.col("_sum").isNull(), 1.0 / F.col("_k"))
                        .otherwise(F.coalesce("_inv", F.lit(0.0)) / F.col("_sum"))).drop("_inv", "_sum", "_k")


def combine(forecasts: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of point and quantiles over members."""
    j = forecasts.join(weights.select("sku_id", "method", "weight"), ["sku_id", "method"])
    cols = ("point",) + QUANTILE_COLS
    return j.groupBy("sku_id", "step").agg(*[
        F.greatest(F.lit(0.0), F.sum(F.col("weight") * F.col(c))).alias(c) for c in cols])


# ---- conformal ---------------------------------------------------------------------------------

def residuals(bt: DataFrame) -> DataFrame:
    """Backtest residuals of SKUs with at least two of them."""
    k = F.count(F.lit(1)).over(W.partitionBy("sku_id"))
    r = bt.select("sku_id", "fold", "step", (F.col("actual") - F.col("point")).alias("residual"))
    return r.withColumn("_k", k).where(F.col("_k") >= 2).drop("_k")


def conformal_width(res: DataFrame) -> DataFrame:
    """Half widths at 80 and 95 % from the absolute residuals of each SKU."""
    a = F.abs("residual")
    n = F.count(a)
    width = lambda lv: F.when(n < 2, 0.0).otherwise(F.percentile(a, lv))
    return res.groupBy("sku_id").agg(n.alias("n_residuals"), width(0.80).alias("half_80"), width(0.95).alias("half_95"))


def apply_conformal(fc: DataFrame, widths: DataFrame) -> DataFrame:
    """Replace the 80 / 95 % bounds where four residuals exist and the width is positive."""
    j = fc.join(widths, "sku_id", "left")
    enough = F.coalesce(F.col("n_residuals") >= 4, F.lit(False))

    def bound(col, half, sign):
        on = enough & (F.col(half) > 0)
        return F.when(on, F.greatest(F.lit(0.0), F.col("point") + sign * F.col(half))).otherwise(F.col(col))

    return j.withColumns({"q10": bound("q10", "half_80", -1), "q90": bound("q90", "half_80", 1),
                          "q025": bound("q025", "half_95", -1), "q975": bound("q975", "half_95", 1)}
                         ).drop("n_residuals", "half_80", "half_95")


def conformal_coverage(res: DataFrame, widths: DataFrame) -> DataFrame:
    """Share of residuals inside the half widths, per SKU."""
    j = res.join(widths, "sku_id")
    inside = lambda h: F.when(F.max(h) > 0, F.avg(F.when(F.abs("residual") <= F.col(h), 1.0).otherwise(0.0)))
    return j.groupBy("sku_id").agg(inside("half_80").alias("coverage_80"), inside("half_95").alias("coverage_95"))


def coverage_by_step(res: DataFrame, levels=(0.80, 0.95), steps=(1, 4, 8, 12)) -> DataFrame:
    """Empirical coverage at steps 1, 4, 8, 12 that exist, else at the largest step."""
    w = W.partitionBy("sku_id")
    std = F.col("step").isin(*steps)
    r = res.withColumn("_any", F.max(std).over(w)).withColumn("_top", F.max("step").over(w))
    r = r.where(F.when(F.col("_any"), std).otherwise(F.col("step") == F.col("_top")))
    by = W.partitionBy("sku_id", "step")
    a = F.abs("residual")
    r = r.withColumn("_n", F.count(F.lit(1)).over(by)).where(F.col("_n") >= 2)
    r = r.withColumns({f"_h{i}": F.percentile(a, lv).over(by) for i, lv in enumerate(levels)})
    g = r.groupBy("sku_id", "step").agg(F.max("_n").alias("n_residuals"), *[
        F.when(F.max(f"_h{i}") > 0, F.avg(F.when(a <= F.col(f"_h{i}"), 1.0).otherwise(0.0))).alias(f"e{i}")
        for i in range(len(levels))])
    items = F.array(*[F.struct(F.lit(lv).alias("nominal"), F.col(f"e{i}").alias("empirical")) for i, lv in enumerate(levels)])
    return g.select("sku_id", F.col("step").alias("horizon"), "n_residuals", F.inline(items))


# ---- comparisons -------------------------------------------------------------------------------

def leaderboard(bt: DataFrame, methods: tuple = ()) -> DataFrame:
    """Methods side by side per SKU, lowest CRPS selected; a method of `methods` without
    rows for a SKU is listed as unavailable."""
    s = backtest_summary(bt)
    if methods:
        want = s.select("sku_id").distinct().select("sku_id", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
        s = want.join(s, ["sku_id", "method"], "left")
    w = W.partitionBy("sku_id").orderBy(F.round("crps", 9).asc_nulls_last(), "method")
    return s.withColumn("available", F.col("n_folds").isNotNull()).withColumn(
        "selected", (F.row_number().over(w) == 1) & F.col("crps").isNotNull())


def accuracy_report(bt: DataFrame) -> DataFrame:
    """Mean metrics per method and overall; each SKU counts once."""
    per = bt.groupBy("sku_id", "method").agg(mape().alias("mape"), smape().alias("smape"),
                                             crps_quantiles().alias("crps"), pinball("q975", 0.95).alias("pinball_q95"))
    return per.rollup("method").agg(F.count(F.lit(1)).alias("n"), *[
        F.round(F.avg(m), 3).alias(m) for m in ("mape", "smape", "crps", "pinball_q95")]).withColumn(
        "method", F.coalesce("method", F.lit("overall")))

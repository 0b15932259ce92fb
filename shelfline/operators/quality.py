"""Data-quality score: components, profile match, stationarity and report."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordering import exact_quantiles
from ..functions.stats import norm_cdf
from ..session import materialise
from .checks import business_checks
from .series import METRICS, series_metrics

OPTIONAL = ("on_hand", "lead_time_days", "unit_cost", "unit_price", "supplier", "category")
# fixed values: component weights
WEIGHTS = {"completeness": 0.25, "plausibility": 0.25, "history_depth": 0.20,
           "stationarity": 0.15, "distribution_profile": 0.15}
# fixed values: (last, baseline) rows of the stability window
STABILITY_WINDOW = {"D": (30, 60), "W": (4, 13), "M": (3, 6)}
# fixed values: reference bands, profile -> metric -> (p2, p10, p90, p98, centroid)
PROFILES = {
    "b2b_industrial": {
        "cv_demand": (0.50, 0.80, 2.50, 3.50, 1.40), "intermittency_rate": (0.10, 0.20, 0.85, 0.95, 0.55),
        "regime_shift_score": (0.01, 0.03, 0.30, 0.45, 0.15), "trend_slope_pct": (0.0, 0.02, 0.40, 0.60, 0.15),
        "seasonality_strength": (0.0, 0.02, 0.30, 0.45, 0.10)},
    "ecommerce_fashion": {
        "cv_demand": (0.50, 0.85, 4.20, 6.00, 2.40), "intermittency_rate": (0.05, 0.15, 0.75, 0.92, 0.45),
        "regime_shift_score": (0.05, 0.10, 0.65, 0.85, 0.35), "trend_slope_pct": (0.0, 0.05, 0.80, 1.20, 0.30),
        "seasonality_strength": (0.02, 0.05, 0.85, 0.95, 0.30)},
    "pharma_medical": {
        "cv_demand": (0.20, 0.30, 1.20, 1.80, 0.65), "intermittency_rate": (0.00, 0.02, 0.30, 0.45, 0.12),
        "regime_shift_score": (0.01, 0.02, 0.30, 0.50, 0.10), "trend_slope_pct": (0.0, 0.02, 0.30, 0.50, 0.10),
        "seasonality_strength": (0.0, 0.02, 0.50, 0.70, 0.15)},
    "retail_m5": {
        "cv_demand": (0.40, 0.65, 3.20, 4.50, 1.85), "intermittency_rate": (0.02, 0.08, 0.88, 0.97, 0.62),
        "regime_shift_score": (0.01, 0.03, 0.55, 0.75, 0.18), "trend_slope_pct": (0.0, 0.02, 0.50, 0.80, 0.10),
        "seasonality_strength": (0.02, 0.05, 0.70, 0.85, 0.20)},
    "spare_parts_mro": {
        "cv_demand": (0.80, 1.50, 6.00, 8.00, 3.50), "intermittency_rate": (0.30, 0.55, 0.96, 0.99, 0.85),
        "regime_shift_score": (0.02, 0.05, 0.45, 0.65, 0.18), "trend_slope_pct": (0.0, 0.0, 0.50, 0.80, 0.20),
        "seasonality_strength": (0.0, 0.0, 0.20, 0.35, 0.05)},
}
# fixed values: profile labels
PROFILE_LABELS = {"b2b_industrial": "B2B industrial", "ecommerce_fashion": "E-commerce / fashion",
                  "pharma_medical": "Pharma / medical", "retail_m5": "Retail / consumer goods",
                  "spare_parts_mro": "Spare parts / MRO"}


def profile_rows() -> Column:
    """The bands as a constant array, exploded next to whatever is scored."""
    return F.array(*[
        F.struct(F.lit(pid).alias("profile_id"), F.lit(m).alias("metric"),
                 *[F.lit(v).alias(n) for n, v in zip(("p2", "p10", "p90", "p98", "centroid"), b)])
        for pid, bands in PROFILES.items() for m, b in bands.items()])


def score_metric(v: Column, p2, p10, p90, p98) -> Column:
    """100 inside [p10, p90], ramps to 50 at p2 / p98, decays to 0 beyond."""
    ramp = lambda num, den: F.when(den > 0, F.lit(50.0) + F.lit(50.0) * num / den).otherwise(75.0)
    far = lambda excess, edge: F.greatest(
        F.lit(0.0), F.lit(50.0) * (1 - excess / F.greatest(F.abs(edge), F.lit(1e-6))))
    return (F.when((v >= p10) & (v <= p90), 100.0)
            .when((v >= p2) & (v < p10), ramp(v - p2, p10 - p2))
            .when((v > p90) & (v <= p98), ramp(p98 - v, p98 - p90))
            .when(v < p2, far(p2 - v, p2)).otherwise(far(v - p98, p98)))


# ---- completeness, history, plausibility -------------------------------------

def sku_dates(df: DataFrame) -> DataFrame:
    by_date = W.partitionBy("sku_id").orderBy("date")
    g = df.withColumn("_gap", F.datediff("date", F.lag("date").over(by_date)).cast("double"))
    return g.groupBy("sku_id").agg(
        F.count_distinct("date").alias("n"), F.percentile("_gap", 0.5).alias("gap"),
        F.datediff(F.max("date"), F.min("date")).alias("span"),
        *[F.max(F.col(c).isNotNull()).alias(f"has_{c}") for c in OPTIONAL])


def dq_completeness(df: DataFrame) -> DataFrame:
    d = sku_dates(df)
    expected = F.col("span") / F.greatest(F.lit(1.0), F.col("gap")) + 1
    agg = d.agg(F.avg(F.when(F.col("n") >= 2, F.col("n") / expected)).alias("coverage"),
                *[F.max(f"has_{c}").cast("int").alias(f"has_{c}") for c in OPTIONAL])
    populated = sum((F.col(f"has_{c}") for c in OPTIONAL[1:]), F.col(f"has_{OPTIONAL[0]}"))
    cov = F.coalesce("coverage", F.lit(1.0))
    return agg.select(
        populated.cast("long").alias("n_populated"), cov.alias("coverage"),
        F.round(100.0 * (0.4 * populated / len(OPTIONAL) + 0.6 * F.least(F.lit(1.0), cov)), 2).alias("score"))


def dq_plausibility(findings: DataFrame, df: DataFrame) -> DataFrame:
    sizes = df.groupBy("sku_id").agg(F.count(F.lit(1)).alias("k")).agg(
        F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("n_skus"))
    rows, skus = sizes.select("n_rows").scalar(), sizes.select("n_skus").scalar()
    share = F.greatest(F.col("offending_row_count") / rows,
                       F.coalesce("skus_affected", F.lit(0)) / skus)
    soft = findings.where(F.col("severity") == "soft")
    return soft.agg(F.coalesce(F.sum(F.least(F.lit(20.0), share * 100)), F.lit(0.0)).alias("penalty")) \
        .select(F.round(F.greatest(F.lit(0.0), 100.0 - F.col("penalty")), 2).alias("score"))


def dq_history(df: DataFrame) -> DataFrame:
    return (df.groupBy("sku_id").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.round(F.avg(F.least(F.col("n"), F.lit(104)) / 104 * 100), 2).alias("score"),
                 F.count_if(F.col("n") < 13).alias("n_low_history")))


def low_history(df: DataFrame, threshold: int = 13) -> DataFrame:
    return (df.groupBy("sku_id").agg(F.count(F.lit(1)).alias("n_obs"))
            .where(F.col("n_obs") < threshold))


# ---- distribution profile ----------------------------------------------------

def tall_metrics(m: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in METRICS])
    return m.where(F.col("n_obs") >= 8).select("sku_id", F.inline(pairs))


def metric_medians(m: DataFrame) -> DataFrame:
    """Median of each metric over SKUs: (metric, n, median)."""
    return exact_quantiles(tall_metrics(m), "value", {"median": 0.5}, by=("metric",))


def match_profile(medians: DataFrame) -> DataFrame:
    """Nearest profile in units of band width; one row."""
    b = medians.select("metric", "median", F.explode(profile_rows()).alias("b")).where(
        F.col("b.metric") == F.col("metric"))
    dist = b.groupBy("b.profile_id").agg(F.sum(F.pow(
        (F.col("median") - F.col("b.centroid")) / F.greatest(F.col("b.p98") - F.col("b.p2"), F.lit(1e-6)),
        F.lit(2.0))).alias("d"))
    return dist.agg(F.min(F.struct("d", "profile_id")).alias("m")).select(
        "m.profile_id", (1.0 / (1.0 + F.sqrt("m.d"))).alias("confidence"))


def _banded(m: DataFrame, profile: str) -> DataFrame:
    def edge(i):
        e = F.lit(None).cast("double")
        for metric, band in PROFILES[profile].items():
            e = F.when(F.col("metric") == metric, band[i]).otherwise(e)
        return e

    names = ("p2", "p10", "p90", "p98")
    return tall_metrics(m).withColumns({n: edge(i) for i, n in enumerate(names)})


def metric_scores(m: DataFrame, profile: str = "retail_m5") -> DataFrame:
    b = _banded(m, profile)
    return b.select("sku_id", "metric", "value", score_metric(
        F.col("value"), *[F.col(p) for p in ("p2", "p10", "p90", "p98")]).alias("score"))


def dq_distribution(m: DataFrame, profile: str = "retail_m5") -> DataFrame:
    """Median over SKUs of the mean metric score, plus flag counts per metric; one row."""
    b = _banded(m, profile)
    v = F.col("value")
    out = (v < F.col("p10")) | (v > F.col("p90"))
    sc = score_metric(v, *[F.col(p) for p in ("p2", "p10", "p90", "p98")])
    per_sku = b.groupBy("sku_id").agg(F.avg(sc).alias("score"), *[
        F.count_if((F.col("metric") == k) & out).alias(f"flag_{k}") for k in METRICS])
    per_sku = per_sku.withColumn("score", F.round("score", 9))
    med = exact_quantiles(per_sku, "score", {"q": 0.5})
    flags = per_sku.agg(*[F.sum(f"flag_{k}").alias(f"flag_{k}") for k in METRICS])
    return med.select(F.round("q", 2).alias("score"), F.col("n").alias("n_skus")).withColumns(
        {f"flag_{k}": flags.select(f"flag_{k}").scalar() for k in METRICS})


def distribution_anomalies(m: DataFrame, profile: str = "retail_m5") -> DataFrame:
    v = F.col("value")
    return (_banded(m, profile).where((v < F.col("p10")) | (v > F.col("p90")))
            .select("sku_id", "metric", "value", F.col("p10").alias("profile_p10"),
                    F.col("p90").alias("profile_p90"),
                    F.when(v < F.col("p10"), "below_p10").otherwise("above_p90").alias("side")))


# ---- stationarity -------------------------------------------------------------

def _recent(df: DataFrame, n: int) -> DataFrame:
    """(sku_id, a): the last n demands of each SKU that has them, oldest first.  They are picked before the exchange."""
    back = F.row_number().over(W.partitionBy("sku_id").orderBy(F.desc("date")))
    t = df.select("sku_id", "date", "demand").withColumn("back", back).where(F.col("back") <= n)
    a = F.transform(F.sort_array(F.collect_list(F.struct(-F.col("back"), "demand"))), lambda s: s["demand"])
    return t.groupBy("sku_id").agg(a.alias("a")).where(F.size("a") == n)


def _sum(xs):
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def _pettitt_k(n: int):
    """Largest absolute running sum of each value's sign counts against the whole window (twice its mid-rank, centred)."""
    signs = F.transform("a", lambda x: F.aggregate("a", F.lit(0.0), lambda acc, y: acc + F.signum(x - y)))
    start = F.struct(F.lit(0.0).alias("u"), F.lit(0.0).alias("k"))
    step = lambda acc, s: F.struct((acc["u"] + s).alias("u"), F.greatest(acc["k"], F.abs(acc["u"] + s)).alias("k"))
    return F.aggregate(F.slice(signs, 1, n - 1), start, step, lambda acc: acc["k"])


def _pettitt_p(n: int):
    k = F.col("k_stat")
    return F.least(F.lit(1.0), 2 * F.exp(-6 * k * k / float(n ** 3 + n ** 2)))


def _rises(n: int):
    """Later values above minus later values below, over all pairs inside the array."""
    return _sum(F.transform("a", lambda x, i: F.aggregate(
        F.slice("a", i + 2, n), F.lit(0.0), lambda acc, y: acc + F.signum(y - x))))


def _rises_p(n: int):
    sd = (n * (n - 1) * (2 * n + 5) / 18.0) ** 0.5
    return 2 * (1 - norm_cdf(F.abs((F.col("s_stat") - F.signum("s_stat")) / sd)))


def _shift(t: DataFrame, last: int, baseline: int) -> DataFrame:
    """t with shift_z; means and deviation are columns of their own, so that no array is walked twice."""
    t = t.withColumns({"_m": _sum(F.slice("a", 1, baseline)) / baseline,
                       "_r": _sum(F.slice("a", baseline + 1, last)) / last})
    t = t.withColumn("_sd", F.sqrt(_sum(F.transform(F.slice("a", 1, baseline), lambda x: (x - F.col("_m")) * (x - F.col("_m")))) / baseline))
    z = F.when(F.col("_sd") < 1e-9, 0.0).otherwise(F.abs(F.col("_r") - F.col("_m")) / F.col("_sd"))
    return t.withColumn("shift_z", z).drop("_m", "_r", "_sd")


def pettitt(df: DataFrame, last: int, baseline: int) -> DataFrame:
    """Rank-based change-point statistic with its approximate p-value; null for windows under 20 rows."""
    n = last + baseline
    none = F.lit(None).cast("double")
    t = _recent(df, n).withColumn("k_stat", _pettitt_k(n) if n >= 20 else none)
    return t.select("sku_id", "k_stat", (_pettitt_p(n) if n >= 20 else none).alias("pettitt_p"))


def mann_kendall(df: DataFrame, last: int, baseline: int) -> DataFrame:
    """Trend test over the window; signs are counted inside the SKU's short array, so
    no pair is ever emitted as a row."""
    n = last + baseline
    t = _recent(df, n).withColumn("s_stat", _rises(n))
    return t.select("sku_id", "s_stat", (_rises_p(n) if n >= 10 else F.lit(None).cast("double")).alias("mk_p"))


def shift_z(df: DataFrame, last: int, baseline: int) -> DataFrame:
    return _shift(_recent(df, last + baseline), last, baseline).select("sku_id", "shift_z")


def stationarity_flags(df: DataFrame, freq: str) -> DataFrame:
    """The three tests as projections of one array per SKU."""
    last, base = STABILITY_WINDOW[freq]
    n, none = last + base, F.lit(None).cast("double")
    j = _recent(df, n).withColumns({"k_stat": _pettitt_k(n) if n >= 20 else none, "s_stat": _rises(n)})
    j = _shift(j, last, base).withColumns({"pettitt_p": _pettitt_p(n) if n >= 20 else none, "mk_p": _rises_p(n) if n >= 10 else none})
    hit = lambda c: F.coalesce(c, F.lit(False))
    pe, mk, sh = hit(F.col("pettitt_p") < 0.05), hit(F.col("mk_p") < 0.05), hit(F.col("shift_z") > 2.0)
    reason = F.concat_ws(
        "; ", F.when(pe, F.format_string("Pettitt change-point p=%.3f", "pettitt_p")),
        F.when(mk, F.format_string("Mann-Kendall trend p=%.3f", "mk_p")),
        F.when(sh, F.format_string("rolling-mean shift z=%.2fσ", "shift_z")))
    score = (F.lit(100.0) - F.when(pe, 30).otherwise(0) - F.when(mk, 15).otherwise(0)
             - F.when(sh, 25).otherwise(0))
    return j.select("sku_id", "pettitt_p", "mk_p", "shift_z", score.alias("score"),
                    F.when(reason != "", reason).alias("reason"))


def dq_stationarity(df: DataFrame, freq: str) -> DataFrame:
    return stationarity_flags(df, freq).agg(
        F.round(F.avg("score"), 2).alias("score"),
        F.count_if(F.col("score") < 70).alias("n_regime_breaks"))


# ---- composite and report -------------------------------------------------------

def dq_components(df: DataFrame, freq: str, profile: str = "retail_m5",
                  findings: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    findings = business_checks(df) if findings is None else findings
    metrics = series_metrics(df) if metrics is None else metrics
    parts = {"completeness": dq_completeness(df), "plausibility": dq_plausibility(findings, df),
             "history_depth": dq_history(df), "stationarity": dq_stationarity(df, freq),
             "distribution_profile": dq_distribution(metrics, profile)}
    out = None
    for name, part in parts.items():
        row = part.select(F.lit(name).alias("name"), "score", F.lit(WEIGHTS[name]).alias("weight"))
        out = row if out is None else out.unionByName(row)
    return out


def dq_composite(components: DataFrame) -> DataFrame:
    """Weighted mean over the components that have a score."""
    have = F.col("score").isNotNull()
    return components.agg(F.round(
        F.sum(F.col("score") * F.col("weight")) / F.sum(F.when(have, F.col("weight"))), 2)
        .alias("composite_score"))


def dq_notes(df: DataFrame, freq: str, metrics: DataFrame, profile: str = "retail_m5") -> DataFrame:
    """The profile note and the regime-break finding, each with five examples."""
    a = distribution_anomalies(metrics, profile)
    per_metric = a.groupBy("metric").agg(F.count(F.lit(1)).alias("k"))
    top = per_metric.orderBy(F.desc("k"), "metric").limit(3).agg(F.array_join(F.transform(
        F.reverse(F.sort_array(F.collect_list(F.struct("k", "metric")))),
        lambda s: F.concat(s["metric"], F.lit("="), s["k"].cast("string"))), ", ").alias("t"))
    ex = lambda t: F.sort_array(F.collect_list(F.to_json(F.struct(*t.columns))))
    a5 = a.orderBy("sku_id", "metric").limit(5)
    note = a.groupBy("sku_id").agg(F.count(F.lit(1)).alias("k")).agg(
        F.sum("k").alias("offending_row_count"), F.count(F.lit(1)).alias("skus_affected"))
    note = note.where(F.col("offending_row_count") > 0).select(
        F.lit("DISTRIBUTION_PROFILE_NOTE").alias("code"), F.lit("info").alias("severity"),
        F.concat(F.col("offending_row_count").cast("string"),
                 F.lit(f" per-SKU metric values fall outside the typical band for {PROFILE_LABELS[profile]}."
                       " Top metrics: "), top.scalar()).alias("message"),
        "offending_row_count", "skus_affected", a5.agg(ex(a5)).scalar().alias("offending_examples"))
    b = stationarity_flags(df, freq).where(F.col("score") < 70).select("sku_id", "score", "reason")
    b5 = b.orderBy("sku_id").limit(5)
    brk = b.agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 0).select(
        F.lit("REGIME_BREAK").alias("code"), F.lit("soft").alias("severity"),
        F.concat(F.col("k").cast("string"), F.lit(" SKUs have a structural break in the recent window")),
        F.col("k"), F.col("k"), b5.agg(ex(b5)).scalar())
    return note.union(brk)


def dq_report(df: DataFrame, freq: str, profile: str = "auto", metrics: DataFrame | None = None) -> dict:
    """components, assertions, summary and low-history tables of one dataset.

    `profile` may be a profile id or "auto" (nearest by metric medians).  Passing a
    stored `series_metrics` table rescores without recomputing it."""
    metrics = materialise(series_metrics(df)) if metrics is None else metrics
    confidence = None
    if profile == "auto":
        best = match_profile(metric_medians(metrics)).head()
        profile, confidence = best.profile_id, float(best.confidence)
    findings = materialise(business_checks(df))
    comps = materialise(dq_components(df, freq, profile, findings, metrics))
    notes = dq_notes(df, freq, metrics, profile)
    summary = dq_composite(comps).withColumns({
        "profile_id": F.lit(profile), "match_confidence": F.lit(confidence).cast("double")})
    return {"dq_components": comps, "dq_summary": summary, "dq_low_history": low_history(df),
            "dq_assertions": findings.unionByName(
                notes.select("code", "severity", F.lit(None).cast("string").alias("field"),
                             "offending_row_count", "skus_affected"))}


def dq_rescore(df: DataFrame, freq: str, metrics: DataFrame, profile: str) -> dict:
    return dq_report(df, freq, profile, metrics)


def dq_rescore_profiles(df: DataFrame, freq: str, metrics: DataFrame, profiles=tuple(PROFILES)) -> DataFrame:
    """(profile_id, composite_score) under each profile.  Only the profile component depends on it: the others are
    computed once and stored."""
    first = profiles[0]
    comps = materialise(dq_components(df, freq, first, metrics=metrics))
    fixed = comps.where(F.col("name") != "distribution_profile")
    out = None
    for pid in profiles:
        own = dq_distribution(metrics, pid).select(
            F.lit("distribution_profile").alias("name"), "score", F.lit(WEIGHTS["distribution_profile"]).alias("weight"))
        one = dq_composite(fixed.unionByName(own)).withColumn("profile_id", F.lit(pid))
        out = one if out is None else out.unionByName(one)
    return out.select("profile_id", "composite_score")


# ---- calibration position ---------------------------------------------------------

def match_dept(skus: DataFrame, ref: DataFrame) -> DataFrame:
    """Reference department of each (sku_id, category): same name, else the largest
    with the same prefix, else _default, else the first.

    `ref` has a row per department and metric.  Departments are looked up by name and
    by prefix with two equi-joins."""
    depts = ref.groupBy("dept_id").agg(F.max("n_skus").alias("n_skus"))
    head = lambda c: F.split(F.upper(c), "_")[0]
    exact = depts.select(F.upper("dept_id").alias("_u"), F.col("dept_id").alias("_exact"))
    by_prefix = depts.where(F.col("dept_id") != "_default").groupBy(head(F.col("dept_id")).alias("_h")).agg(
        F.max_by("dept_id", F.struct("n_skus", "dept_id")).alias("_prefix"))
    fallback = depts.agg(F.coalesce(F.max(F.when(F.col("dept_id") == "_default", F.col("dept_id"))),
                                    F.min("dept_id"))).scalar()
    j = (skus.withColumn("_u", F.upper("category")).withColumn("_h", head(F.col("category")))
         .join(exact, "_u", "left").join(by_prefix, "_h", "left"))
    return j.select("sku_id", "category",
                    F.coalesce("_exact", "_prefix", fallback).alias("matched_dept"))


def calibration_position(m: DataFrame, skus: DataFrame, ref: DataFrame) -> DataFrame:
    """Seven-band position of each SKU metric among its department's quantiles."""
    v = F.col("value")
    j = (m.unpivot(["sku_id"], list(METRICS), "metric", "value")
         .join(match_dept(skus, ref), "sku_id")
         .join(ref.withColumnRenamed("dept_id", "matched_dept"), ["matched_dept", "metric"]))
    bands = (("p1", "below_p1"), ("p5", "p1_to_p5"), ("p25", "p5_to_p25"), ("p75", "p25_to_p75"),
             ("p95", "p75_to_p95"), ("p99", "p95_to_p99"))
    pos = F.lit("above_p99")
    for edge, label in reversed(bands):
        pos = F.when(v <= F.col(edge), label).otherwise(pos)
    coarse = F.lit("above_p99")
    for edge, label in (("p99", "p75_to_p99"), ("p75", "p25_to_p75"), ("p25", "p1_to_p25"), ("p1", "below_p1")):
        coarse = F.when(v <= F.col(edge), label).otherwise(coarse)
    return j.select("sku_id", "metric", "matched_dept", v.alias("user_value"),
                    *[F.col(p).alias(f"ref_{p}") for p in ("p1", "p50", "p99")],
                    pos.alias("position"), coarse.alias("coarse_position"))

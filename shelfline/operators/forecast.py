"""Forecasters for every SKU in one job.

A SKU's history becomes one row with a date-ordered array (`to_series`).  From there on
everything, backtest folds included, is a projection of that row: the only exchange of
a forecast is the one that builds the arrays.
A forecast is `fc`, an array of (step, point, q025, q10, q50, q90, q975).
"""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays as A, folds
from ..schema import QUANTILE_COLS, QUANTILE_LEVELS, QUANTILE_Z, SEASON_LENGTH
from .series import (MODEL_LAGS, ROLLING, SEASONAL_LAGS, ACF_THRESHOLD, add_lags, add_rolling, indexed,
                     pattern_rule)

# fixed values: thresholds of the forecast path
MIN_OBS, LOW_HISTORY = 8, 13
COLD_START = {"D": 90, "W": 26, "M": 6}
MIN_OBS_ML = 40
ROUTES = {"smooth": "ets", "seasonal": "arima", "intermittent": "croston", "lumpy": "tsb"}
CROSTON_ALPHA, TSB_ALPHA = 0.1, 0.2


def to_long(df: DataFrame) -> DataFrame:
    return df.select(F.col("sku_id").alias("unique_id"), F.col("date").cast("timestamp").alias("ds"),
                     F.col("demand").alias("y"))


def to_series(df: DataFrame) -> DataFrame:
    """One row per SKU: y, dates, n, last date, category and supplier."""
    pts = F.sort_array(F.collect_list(F.struct("date", "demand")))
    cols = set(df.columns)
    extra = [F.max(c).alias(c) if c in cols else F.lit(None).cast("string").alias(c) for c in ("category", "supplier")]
    g = df.where(F.col("demand").isNotNull()).groupBy("sku_id").agg(pts.alias("_p"), *extra)
    return g.select("sku_id", F.transform("_p", lambda p: p["demand"]).alias("y"),
                    F.transform("_p", lambda p: p["date"]).alias("dates"), F.size("_p").alias("n"),
                    F.element_at("_p", -1)["date"].alias("last_date"), "category", "supplier")


def array_pattern(y: Column, freq: str) -> Column:
    n = F.size(y)
    zero = F.size(F.filter(y, lambda v: v == 0)) / n
    seasonal = F.lit(False)
    for k in SEASONAL_LAGS[freq]:
        seasonal = seasonal | ((n > k + 5) & (A.autocorrelation(y, k) > ACF_THRESHOLD))
    return pattern_rule(n, zero, seasonal)


def route_of(pattern: Column) -> Column:
    out = F.lit("seasonal_naive")
    for p, m in ROUTES.items():
        out = F.when(pattern == p, m).otherwise(out)
    return out


def route_model(series: DataFrame, freq: str) -> DataFrame:
    s = series.withColumn("pattern", array_pattern(F.col("y"), freq))
    return s.withColumn("method", route_of(F.col("pattern")))


# ---- shape helpers ------------------------------------------------------------------

def _band(step: Column, point: Column, sigma: Column) -> Column:
    floor = lambda c: F.greatest(F.lit(0.0), c)
    return F.struct(step.cast("int").alias("step"), floor(point).alias("point"),
                    *[floor(point + z * sigma).alias(c) for z, c in zip(QUANTILE_Z, QUANTILE_COLS)])


def _steps(h: int) -> Column:
    return F.sequence(F.lit(1), F.lit(h))


def normal_quantiles(df: DataFrame, point: str, sigma: str) -> DataFrame:
    """Adds the five quantile columns max(0, point + z sigma)."""
    return df.withColumns({c: F.greatest(F.lit(0.0), F.col(point) + z * F.col(sigma))
                           for z, c in zip(QUANTILE_Z, QUANTILE_COLS)})


def difference_sigma(y: Column) -> Column:
    """Population std of first differences; their sum is last minus first."""
    return folds.difference_std(y)


def residual_sigma(df: DataFrame) -> DataFrame:
    """Per SKU: population std of the residuals, else of first differences, else 1."""
    w = W.partitionBy("sku_id").orderBy("date")
    d = df.withColumn("_d", F.col("demand") - F.lag("demand").over(w))
    res, dif = F.stddev_pop("residual"), F.stddev_pop("_d")
    return d.groupBy("sku_id").agg(F.when(res > 0, res).when(dif > 1e-9, dif).otherwise(1.0).alias("sigma"))


def rows(forecasts: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per step.  The outer form keeps the optimizer from adding a
    non-empty filter that would run every fold a second time."""
    return forecasts.select(*keep, F.inline_outer("fc"))


# ---- forecasters: y -> fc ---------------------------------------------------------------

def season_used(y: Column, m: int) -> Column:
    return F.when(F.size(y) >= m, m).otherwise(1).cast("int")


def season_sigma(y: Column, m: int) -> Column:
    return folds.season_std(y, m)


def snaive_fc(y: Column, sigma: Column, h: int, m: int) -> Column:
    """Last season repeated; a series shorter than a season repeats its last value.
    `sigma` is a column of its own (`season_sigma`), so it is computed once per row."""
    n, p = F.size(y), season_used(y, m)
    return F.transform(_steps(h), lambda i: _band(
        i, F.element_at(y, (n - p + 1 + (i - 1) % p).cast("int")), sigma * F.sqrt(F.floor((i - 1) / p) + 1)))


def croston_rate(y: Column, alpha: float = CROSTON_ALPHA) -> Column:
    """Smoothed demand size over smoothed interval; 0 without demand."""
    return folds.croston(y, alpha)


def tsb_rate(y: Column, alpha: float = TSB_ALPHA) -> Column:
    """Smoothed demand probability times smoothed size."""
    return folds.tsb(y, alpha)


def flat_fc(rate: Column, sigma: Column, h: int) -> Column:
    return F.transform(_steps(h), lambda i: _band(i, rate, sigma))


# smoothing grid: level weights, with and without damped trend and additive season
ETS_ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)
ETS_GRID = [(a, b, g) for a in ETS_ALPHAS for b in (0.0, 0.1) for g in (0.0, 0.1)]
ETS_PHI = 0.9


def _ets_block(Y: np.ndarray, h: int, m: int):
    """Best-in-grid exponential smoothing for series of one length: points and sigmas."""
    n_series, n = Y.shape
    grid = [g for g in ETS_GRID if g[2] == 0 or n >= 2 * m]
    al, be, ga = (np.array(c)[None, :] for c in zip(*grid))
    seasonal = ga > 0
    level = np.repeat(Y[:, :1], len(grid), axis=1)
    slope = np.zeros_like(level)
    season = np.zeros((m, n_series, len(grid)))
    if seasonal.any():
        first = Y[:, :m].mean(axis=1)
        season[:] = (Y[:, :m] - first[:, None]).T[:, :, None] * seasonal
        level = np.where(seasonal, first[:, None], level)
    sse = np.zeros_like(level)
    for t in range(1, n):
        y, s = Y[:, t:t + 1], season[t % m]
        base = level + ETS_PHI * slope * (be > 0)
        err = y - (base + s)
        sse += err * err
        new = base + al * err
        slope = np.where(be > 0, ETS_PHI * slope + al * be * err, 0.0)
        season[t % m] = s + ga * err
        level = new
    best = sse.argmin(axis=1)
    pick = (np.arange(n_series), best)
    sigma = np.sqrt(sse[pick] / max(n - 1, 1))
    a, b = al[0][best], be[0][best]
    point, width, damp = np.empty((n_series, h)), np.empty((n_series, h)), np.zeros(n_series)
    var = np.ones(n_series)
    for i in range(1, h + 1):
        damp = damp + ETS_PHI ** i
        point[:, i - 1] = level[pick] + (b > 0) * damp * slope[pick] + season[(n + i - 1) % m][pick]
        width[:, i - 1] = sigma * np.sqrt(var)
        var = var + (a * (1 + b * damp)) ** 2
    return point, width


def ets_udf(h: int, m: int):
    @F.pandas_udf("point array<double>, sigma array<double>")
    def run(ys: pd.Series) -> pd.DataFrame:
        out_p, out_s = [None] * len(ys), [None] * len(ys)
        lengths = ys.map(lambda a: -1 if a is None else len(a)).to_numpy()
        for n in set(lengths.tolist()) - {-1, 0}:
            idx = np.flatnonzero(lengths == n)
            p, s = _ets_block(np.stack([np.asarray(ys.iloc[i], dtype=float) for i in idx]), h, m)
            for row, i in enumerate(idx):
                out_p[i], out_s[i] = p[row], s[row]
        return pd.DataFrame({"point": out_p, "sigma": out_s})
    return run


def band_arrays(point: Column, sigma: Column) -> Column:
    return F.transform(F.arrays_zip(point.alias("p"), sigma.alias("s"), F.sequence(F.lit(1), F.size(point)).alias("i")),
                       lambda x: _band(x["i"], x["p"], x["s"]))


# ---- global seasonal regression ----------------------------------------------------------

def fit_seasonal_ar(df: DataFrame, freq: str, fold_cut: Column | None = None):
    """Linear regression of demand on its model lags and rolling means over all SKUs.

    Returns (intercept, {feature: weight}, sigma) or None without training rows.
    `fold_cut` keeps the rows of each SKU before a backtest cutoff."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    feats = [f"lag_{k}" for k in MODEL_LAGS[freq]] + [f"rmean_{w}" for w in ROLLING[freq]] + [
        f"lag_{SEASON_LENGTH[freq]}s"]
    w = W.partitionBy("sku_id").orderBy("date")
    x = add_rolling(add_lags(indexed(df.select("sku_id", "date", "demand")), freq), freq).withColumn(
        f"lag_{SEASON_LENGTH[freq]}s", F.lag("demand", SEASON_LENGTH[freq]).over(w))
    if fold_cut is not None:
        x = x.where(F.col("rn") < fold_cut)
    x = x.select(F.col("demand").cast("double").alias("label"), *feats).na.drop()
    if x.isEmpty():
        return None
    train = VectorAssembler(inputCols=feats, outputCol="features").transform(x)
    m = LinearRegression(regParam=1e-6, solver="normal").fit(train)
    return (float(m.intercept), dict(zip(feats, map(float, m.coefficients))),
            float(m.summary.rootMeanSquaredError))


def ar_points(y: Column, h: int, freq: str, model) -> Column:
    """Recursive forecast of the regression, folded over the array; null when the
    series is shorter than the longest lag."""
    b0, coef, _ = model
    longest = max(*MODEL_LAGS[freq], *ROLLING[freq], SEASON_LENGTH[freq])

    def nxt(a):
        n = F.size(a)
        v = F.lit(b0)
        for name, c in coef.items():
            if name.startswith("rmean_"):
                wdt = int(name[6:])
                v = v + c * A.total(F.slice(a, n - wdt + 1, wdt)) / wdt
            else:
                v = v + c * F.element_at(a, (n - int(name[4:].rstrip("s")) + 1).cast("int"))
        return F.greatest(F.lit(0.0), v)

    full = F.aggregate(_steps(h), y, lambda acc, i: F.array_append(acc, nxt(acc)))
    return F.when(F.size(y) > longest, F.slice(full, F.size(y) + 1, h))


def ar_band(points: Column, sigma: float) -> Column:
    return F.transform(points, lambda v, i: _band(i + 1, v, sigma * F.sqrt((i + 1).cast("double"))))


def classical_fc(df: DataFrame, h: int, freq: str, ar=None, y: str = "y", pattern: str = "pattern") -> DataFrame:
    """Adds `method` and `fc` by pattern.

    Rates and sigmas become columns before the steps are built from them, so every fold
    runs once per series, and only rows of a route reach its model: the smoothing
    function gets null arrays for all others."""
    m = SEASON_LENGTH[freq]
    v, p = F.col(y), F.col(pattern)
    flat = p.isin("intermittent", "lumpy")
    ar_on = p == "seasonal"
    df = df.withColumns({
        "_ets": ets_udf(h, m)(F.when(p == "smooth", v)),
        "_rate": F.when(p == "intermittent", croston_rate(F.when(p == "intermittent", v))).when(p == "lumpy", tsb_rate(F.when(p == "lumpy", v))),
        "_sigma": F.when(flat, difference_sigma(F.when(flat, v))).when(p != "smooth", season_sigma(F.when(~flat & (p != "smooth"), v), m)),
        "_ar": F.when(ar_on, ar_points(v, h, freq, ar)) if ar else F.lit(None).cast("array<double>")})
    fc = (F.when(p == "smooth", band_arrays(F.col("_ets.point"), F.col("_ets.sigma")))
          .when(F.col("_ar").isNotNull(), ar_band(F.col("_ar"), ar[2] if ar else 0.0))
          .when(flat, flat_fc(F.col("_rate"), F.col("_sigma"), h))
          .otherwise(snaive_fc(v, F.col("_sigma"), h, m)))
    return df.withColumn("method", route_of(p)).withColumn("fc", fc).drop("_ets", "_rate", "_sigma", "_ar")


def single_fc(df: DataFrame, method: str, h: int, freq: str, y: str = "y") -> DataFrame:
    """Adds `method` and `fc` of one forecaster for every row."""
    v, m = F.col(y), SEASON_LENGTH[freq]
    if method == "seasonal_naive":
        out = df.withColumn("_sigma", season_sigma(v, m))
        fc = snaive_fc(v, F.col("_sigma"), h, m)
    elif method in ("croston", "tsb"):
        rate = croston_rate(v) if method == "croston" else tsb_rate(v)
        out = df.withColumns({"_rate": rate, "_sigma": difference_sigma(v)})
        fc = flat_fc(F.col("_rate"), F.col("_sigma"), h)
    elif method == "ets":
        out = df.withColumn("_e", ets_udf(h, m)(v))
        fc = band_arrays(F.col("_e.point"), F.col("_e.sigma"))
    else:
        raise ValueError(f"unknown method: {method}")
    return out.withColumn("method", F.lit(method)).withColumn("fc", fc).drop("_rate", "_sigma", "_e")


def _forecast(df, method, h, freq):
    """`df` is a panel, or one row per SKU as `to_series` gives it."""
    return rows(single_fc(df if "y" in df.columns else to_series(df), method, h, freq), "sku_id")


def forecast_snaive(df, h, freq):
    return _forecast(df, "seasonal_naive", h, freq)


def forecast_croston(df, h):
    return _forecast(df, "croston", h, "W")


def forecast_tsb(df, h):
    return _forecast(df, "tsb", h, "W")


def forecast_ets(df, h, freq):
    return _forecast(df, "ets", h, freq)


def forecast_seasonal_ar(df, h, freq):
    s = to_series(df).withColumn("pattern", F.lit("seasonal"))
    return rows(classical_fc(s, h, freq, fit_seasonal_ar(df, freq)), "sku_id")


# ---- cold start -----------------------------------------------------------------------------

def posterior(df: DataFrame, prior: DataFrame) -> DataFrame:
    """Gamma posterior per SKU; `prior` has (sku_id, alpha, beta)."""
    g = df.groupBy("sku_id").agg(F.sum("demand").alias("sum_y"), F.count(F.lit(1)).alias("n_obs"))
    return g.join(prior.select("sku_id", "alpha", "beta"), "sku_id").select(
        "sku_id", "n_obs", (F.col("alpha") + F.col("sum_y")).alias("alpha_post"),
        (F.col("beta") + F.col("n_obs")).alias("beta_post"),
        ((F.col("alpha") + F.col("sum_y")) / (F.col("beta") + F.col("n_obs"))).alias("mean"),
        F.when(F.col("beta") + F.col("n_obs") > 0, F.col("beta") / (F.col("beta") + F.col("n_obs")))
        .otherwise(0.0).alias("prior_weight"))


def negbin_array(alpha: Column, beta: Column) -> Column:
    """Five predictive quantiles: the log pmf is summed up to mean + 12 sd."""
    p = beta / (beta + 1.0)
    mean = alpha / beta
    kmax = F.ceil(mean + 12 * F.sqrt(mean * (beta + 1.0) / beta) + 12).cast("int")
    none = F.lit(-1.0)
    start = F.struct((alpha * F.ln(p)).alias("lp"), F.lit(0.0).alias("cdf"),
                     F.array(*[none for _ in QUANTILE_LEVELS]).alias("q"))
    levels = F.array(*[F.lit(x) for x in QUANTILE_LEVELS])

    def step(acc, k):
        lp = F.when(k == 0, acc["lp"]).otherwise(acc["lp"] + F.ln((k - 1 + alpha) / k) + F.ln(1.0 - p))
        cdf = acc["cdf"] + F.exp(lp)
        q = F.zip_with(acc["q"], levels, lambda v, lv: F.when((v < 0) & (cdf >= lv), k.cast("double")).otherwise(v))
        return F.struct(lp.alias("lp"), cdf.alias("cdf"), q.alias("q"))

    return F.aggregate(F.sequence(F.lit(0), kmax), start, step,
                       lambda a: F.transform(a["q"], lambda v: F.when(v < 0, kmax.cast("double")).otherwise(v)))


def negbin_quantiles(post: DataFrame) -> DataFrame:
    q = post.withColumn("_q", negbin_array(F.col("alpha_post"), F.col("beta_post")))
    return q.select("sku_id", "mean", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(QUANTILE_COLS)])


def lookup_prior(skus: DataFrame, priors: DataFrame) -> DataFrame:
    """Prior of each (sku_id, category, pattern): department by name, else the largest
    with its prefix, else the SKU-weighted mean; a pattern without priors uses all."""
    known = priors.select("pattern").distinct().withColumn("_has", F.lit(True))
    any_p = priors.withColumn("_pat", F.explode(F.array("pattern", F.lit("*"))))
    head = lambda c: F.split(F.upper(c), "_")[0]
    best = lambda t, *k: t.groupBy(*k).agg(F.max_by(F.struct("alpha", "beta", "dept_id"), F.struct(
        "n_observed_skus", "dept_id", "pattern")).alias("_b"))
    exact = best(any_p.withColumn("_u", F.upper("dept_id")), "_pat", "_u").withColumnRenamed("_b", "_exact")
    pref = best(any_p.withColumn("_h", head(F.col("dept_id"))), "_pat", "_h").withColumnRenamed("_b", "_prefix")
    w = F.col("n_observed_skus").cast("double")
    avg = any_p.groupBy("_pat").agg((F.sum(F.col("alpha") * w) / F.sum(w)).alias("_aa"),
                                    (F.sum(F.col("beta") * w) / F.sum(w)).alias("_ab"))
    j = skus.join(known, "pattern", "left").withColumn("_pat", F.when(F.col("_has"), F.col("pattern")).otherwise("*"))
    j = (j.withColumn("_u", F.upper("category")).withColumn("_h", head(F.col("category")))
         .join(exact, ["_pat", "_u"], "left").join(pref, ["_pat", "_h"], "left").join(avg, "_pat", "left"))
    return j.select(
        "sku_id", F.coalesce("_exact.alpha", "_prefix.alpha", "_aa", F.lit(1.0)).alias("alpha"),
        F.coalesce("_exact.beta", "_prefix.beta", "_ab", F.lit(0.1)).alias("beta"),
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_prefix").isNotNull(), "prefix")
        .when(F.col("_aa").isNotNull(), "average").otherwise("default").alias("source"))


def needs_cold_start(df: DataFrame, freq: str) -> DataFrame:
    return (df.groupBy("sku_id").agg(F.count(F.lit(1)).alias("n_obs"))
            .withColumn("cold_start", F.col("n_obs") < COLD_START[freq]))


# ---- dates ---------------------------------------------------------------------------------

def step_date(last: Column, step: Column, freq: str) -> Column:
    """Date of a step: days, Mondays after, or month starts after the last date."""
    if freq == "D":
        return F.date_add(last, step.cast("int"))
    if freq == "W":
        return F.date_add(F.next_day(last, "Mon"), (7 * (step - 1)).cast("int"))
    return F.add_months(F.trunc(last, "month"), step.cast("int"))


def future_dates(df: DataFrame, h: int, freq: str) -> DataFrame:
    last = df.groupBy("sku_id").agg(F.max("date").alias("_l"))
    return last.select("sku_id", "_l", F.explode(_steps(h)).alias("step")).select(
        "sku_id", "step", step_date(F.col("_l"), F.col("step"), freq).alias("ds"))

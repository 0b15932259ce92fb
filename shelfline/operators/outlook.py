"""Global boosted-tree forecaster, the full forecast for every SKU, hierarchy."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays as A
from ..schema import QUANTILE_COLS, SEASON_LENGTH
from ..session import materialise, stored
from . import evaluation as ev, forecast as fo
from .series import MODEL_LAGS, ROLLING, add_calendar, add_lags, add_rolling, model_columns, regime_break

CATEGORICAL = ("sku_id", "category", "supplier")
PRIOR_ROWS = 20.0  # weight of the overall mean in the mean of a value


def feature_columns(freq: str) -> list[str]:
    return model_columns(freq) + [f"{c}_mean" for c in CATEGORICAL]


def _shrunk(total: Column, n: Column, prior: Column) -> Column:
    """Mean of n rows drawn towards the overall mean; 0 where nothing is known yet."""
    total, n = F.coalesce(total, F.lit(0.0)), F.coalesce(n, F.lit(0))
    return F.coalesce((total + PRIOR_ROWS * prior) / (n + PRIOR_ROWS), F.lit(0.0))


def target_means(x: DataFrame) -> DataFrame:
    """Ordered target statistics: for each categorical, the mean demand of its value over all earlier dates, never the row's own or later ones.

    Values are summed by date before they meet a window, so a value with most of the rows costs a row a date."""
    earlier = lambda *by: (W.partitionBy(*by) if by else W.partitionBy()).orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    for c in ("", *CATEGORICAL):
        keys = [c, "date"] if c else ["date"]
        days = x.groupBy(*keys).agg(F.sum("demand").alias("_s"), F.count("demand").alias("_n"))
        w = earlier(c) if c else earlier()  # one row a date in the window over all
        days = days.select(F.col("date").alias("_d"), *([F.col(c).alias("_c")] if c else []), F.sum("_s").over(w).alias(f"_s_{c}"), F.sum("_n").over(w).alias(f"_n_{c}"))
        same = F.col("date") == F.col("_d")
        x = x.join(days, same & F.col(c).eqNullSafe(F.col("_c")) if c else same).drop("_d", "_c")
    prior = F.col("_s_") / F.when(F.col("_n_") > 0, F.col("_n_"))
    x = x.withColumns({f"{c}_mean": _shrunk(F.col(f"_s_{c}"), F.col(f"_n_{c}"), prior) for c in CATEGORICAL})
    return x.drop("_s_", "_n_", *[f"_{k}_{c}" for k in "sn" for c in CATEGORICAL])


def final_means(series: DataFrame, y: str) -> DataFrame:
    """The same statistics at the end of every series, from its array."""
    t = series.withColumns({"_t": A.total(F.col(y)), "_k": F.size(y)})
    all_ = t.agg(F.sum("_t") / F.sum("_k")).scalar()
    for c in CATEGORICAL:
        g = t.groupBy(F.col(c).alias("_c")).agg(F.sum("_t").alias("_gt"), F.sum("_k").alias("_gk"))
        t = t.join(g, F.col(c).eqNullSafe(F.col("_c"))).withColumn(f"{c}_mean", _shrunk(F.col("_gt"), F.col("_gk"), all_)).drop("_c", "_gt", "_gk")
    return t.drop("_t", "_k")


def design_matrix(df: DataFrame, freq: str) -> DataFrame:
    """Label, numeric features and ordered means of the categoricals; rows without lag 1 dropped."""
    x = add_calendar(add_rolling(add_lags(
        df.select("sku_id", "date", "demand", "category", "supplier"), freq), freq))
    first = f"lag_{MODEL_LAGS[freq][0]}"
    return target_means(x).where(F.col(first).isNotNull()).select(
        "sku_id", "date", F.col("demand").cast("double").alias("label"), *feature_columns(freq))


def _assembled(x: DataFrame, freq: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=feature_columns(freq), outputCol="features",
                           handleInvalid="keep").transform(x)


def train_gbt(df: DataFrame, freq: str, holdout: int = 8, trees: int = 20, depth: int = 5, seed: int = 0):
    """(model, validation MAE): trained before the last `holdout` periods, scored on them."""
    from pyspark.ml.regression import GBTRegressor
    back = F.row_number().over(W.partitionBy("sku_id").orderBy(F.desc("date")))
    x = design_matrix(df, freq).na.fill(0.0, feature_columns(freq)).withColumn("_b", back)
    data = _assembled(x, freq).select("label", "features", "_b")
    model = GBTRegressor(lossType="absolute", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.9,
                         seed=seed).fit(data.where(F.col("_b") > holdout))
    err = F.avg(F.abs(F.col("label") - F.col("prediction")))
    mae = model.transform(data.where(F.col("_b") <= holdout)).agg(err.alias("e")).head().e
    return model, max(float(mae or 0.0), 1e-3)


def gbt_fc(series: DataFrame, model, sigma: float, h: int, freq: str, y: str = "y") -> DataFrame:
    """Adds `fc`: h scoring passes, each over all SKUs, appending to the array.  A step
    with a missing feature takes the mean of the last eight values."""
    keep = series.columns
    means = [f"{c}_mean" for c in CATEGORICAL]
    s = final_means(series, y).withColumn("_y", F.col(y)).withColumn("_last", F.col("last_date"))
    for step in range(1, h + 1):
        v, n = F.col("_y"), F.size("_y")
        s = s.withColumn("date", fo.step_date(F.col("_last"), F.lit(step), freq))
        s = add_calendar(s).withColumns({
            **{f"lag_{k}": F.when(n >= k, F.element_at(v, -k)) for k in MODEL_LAGS[freq]},
            **{f"rmean_{w}": F.when(n >= 2, A.mean(F.slice(v, F.greatest(F.lit(1), n - w + 1), w)))
               for w in ROLLING[freq]}})
        gap = F.lit(False)
        for k in MODEL_LAGS[freq]:
            gap = gap | F.col(f"lag_{k}").isNull()
        s = model.transform(_assembled(s.withColumn("_gap", gap).na.fill(0.0, model_columns(freq)), freq))
        recent = A.mean(F.slice(v, F.greatest(F.lit(1), n - 7), 8))
        nxt = F.greatest(F.lit(0.0), F.when(F.col("_gap"), recent).otherwise(F.col("prediction")))
        s = s.select(*keep, *means, "_last", F.array_append("_y", nxt).alias("_y"))
    point = F.slice("_y", F.size("_y") - h + 1, h)
    return s.withColumn("fc", fo.band_arrays(point, F.transform(point, lambda _: F.lit(sigma)))).select(*keep, "fc")


def forecast_gbt(df: DataFrame, h: int, freq: str) -> DataFrame:
    model, sigma = train_gbt(df, freq)
    return fo.rows(gbt_fc(fo.to_series(df), model, sigma, h, freq), "sku_id")


def gbt_holdout(df: DataFrame, series: DataFrame, h: int, freq: str) -> DataFrame:
    """CRPS of the boosted trees on each SKU's last rows, trained without them."""
    back = F.row_number().over(W.partitionBy("sku_id").orderBy(F.desc("date")))
    model, sigma = train_gbt(df.withColumn("_b", back).where(F.col("_b") > h).drop("_b"), freq)
    f = ev.fold_rows(series, ev.holdout_horizon(h), 1)
    f = f.withColumn("last_date", F.element_at("dates", F.col("cutoff")))
    z = gbt_fc(f, model, sigma, h, freq, y="train").withColumn(
        "_z", F.slice(F.arrays_zip("actual", "fc"), F.lit(1), F.size("actual")))
    r = z.select("sku_id", F.explode_outer("_z").alias("r")).select(
        "sku_id", F.col("r.actual").alias("actual"), *[F.col(f"r.fc.{c}").alias(c) for c in ("point",) + QUANTILE_COLS])
    return r.groupBy("sku_id").agg(ev.crps_quantiles().alias("crps"))


# ---- the whole forecast ----------------------------------------------------------------------

def forecast_all(df: DataFrame, h: int, freq: str, priors: DataFrame | None = None, folds: int = 3,
                 ml: bool = False) -> dict:
    """`forecasts` (long rows with dates), `summary` (a row per SKU) and `coverage`.

    Fewer than eight rows: refused.  Fewer than the frequency's threshold: gamma-Poisson
    cold start.  Otherwise the routed model, with the boosted trees as second member
    where the panel is large enough, CRPS weights and conformal bounds.

    The panel is computed once and stored, and so are priors and cold start: every model, fold and summary reads them, not the plans behind them.
    """
    df = stored(df.select(*[c for c in df.columns if c in ("sku_id", "date", "demand", "category", "supplier")]), "forecast-panel")
    series = materialise(fo.route_model(fo.to_series(df), freq))
    cold = fo.COLD_START[freq]
    ok = series.where(F.col("n") >= fo.MIN_OBS)
    warm, short = ok.where(F.col("n") >= cold), ok.where(F.col("n") < cold)
    ar = fo.fit_seasonal_ar(df, freq) if not warm.where(F.col("pattern") == "seasonal").isEmpty() else None

    classical = fo.rows(fo.classical_fc(warm, h, freq, ar), "sku_id", "method")
    bt_h = ev.holdout_horizon(h)
    bt = materialise(ev.backtest(warm, freq, "route", h, folds, h_col=bt_h, panel=df if ar else None))
    scores = ev.backtest_summary(bt, by_method=False).drop("method")
    members = warm.select("sku_id", "method").join(scores.select("sku_id", "crps"), "sku_id", "left")
    forecasts = classical
    if ml:
        rich = warm.where(F.col("n") >= fo.MIN_OBS_ML)
        model, sigma = train_gbt(df, freq)
        trees = fo.rows(gbt_fc(rich, model, sigma, h, freq), "sku_id").withColumn("method", F.lit("ml_gbt"))
        forecasts = forecasts.unionByName(trees)
        members = members.unionByName(
            gbt_holdout(df, rich, h, freq).withColumn("method", F.lit("ml_gbt")).select("sku_id", "method", "crps"))
    weights = materialise(ev.crps_weights(members))
    combined = ev.combine(forecasts, weights)

    same = ev.backtest(warm, freq, "route", h, folds, h_col=bt_h, panel=df if ar else None, pattern="pattern")
    res = materialise(ev.residuals(same))
    calibrated = ev.apply_conformal(combined, ev.conformal_width(res))

    if priors is None:
        means = series.select("sku_id", A.mean(F.col("y")).alias("mean_demand"))
        from .calibration import fit_prior
        pr = fit_prior(means)
        prior = short.select("sku_id").withColumns({"alpha": pr.select("alpha").scalar(), "beta": pr.select("beta").scalar()})
    else:
        # the lookup reads the priors four times
        prior = fo.lookup_prior(short.select("sku_id", "category", "pattern"), stored(priors, "priors"))
    p = short.join(prior.select("sku_id", "alpha", "beta"), "sku_id")
    p = p.withColumns({"_a": F.col("alpha") + A.total(F.col("y")), "_b": F.col("beta") + F.col("n"),
                       "prior_weight": F.col("beta") / (F.col("beta") + F.col("n"))})
    p = p.select("sku_id", "_a", "_b", "prior_weight", fo.negbin_array(F.col("_a"), F.col("_b")).alias("_q"))
    p = materialise(p)
    cold_rows = p.select("sku_id", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"),
                         (F.col("_a") / F.col("_b")).alias("point"),
                         *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(QUANTILE_COLS)])
    out = calibrated.select(*cold_rows.columns).unionByName(cold_rows)
    out = out.join(series.select("sku_id", "last_date"), "sku_id").withColumn(
        "ds", fo.step_date(F.col("last_date"), F.col("step"), freq)).drop("last_date")

    k = weights.where(F.col("weight") > 0).groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.array_join(F.sort_array(F.collect_list(F.format_string("%s=%.2f", "method", "weight"))), ", ").alias("weights"))
    ens = F.col("n_members") > 1
    s = (series.join(k, "sku_id", "left").join(scores, "sku_id", "left")
         .join(p.select("sku_id", "prior_weight"), "sku_id", "left")
         .join(regime_break(df).select("sku_id", "note"), "sku_id", "left"))
    is_cold = (F.col("n") < cold)
    label = (F.when(F.col("n") < fo.MIN_OBS, F.lit(None).cast("string")).when(is_cold, "negbin_bayes")
             .when(ens, "ensemble").otherwise(F.col("method")))
    s = s.withColumn("method", label)
    summary = s.select(
        "sku_id", F.when(F.col("n") < fo.MIN_OBS, "refused").otherwise("ok").alias("status"), "method", "pattern",
        F.col("n").cast("long").alias("n_obs"), F.coalesce("prior_weight", F.lit(0.0)).alias("prior_weight"),
        "n_folds", *ev.METRIC_NAMES, caveat_texts(cold).alias("caveats"))
    return {"forecasts": out, "summary": summary, "coverage": ev.coverage_by_step(res), "weights": weights}


def caveat_texts(cold: int) -> Column:
    n, is_cold = F.col("n").cast("string"), (F.col("n") >= fo.MIN_OBS) & (F.col("n") < cold)
    warm = F.col("n") >= cold
    return F.filter(F.array(
        F.when(is_cold, F.concat(
            F.lit("cold-start: "), n, F.lit(f" observations < {cold} → Bayesian shrinkage applied (prior weight "),
            F.format_string("%.2f", "prior_weight"), F.lit(").")) ),
        F.when(warm & (F.col("n_members") > 1), F.concat(F.lit("ensemble weights — "), F.col("weights"))),
        F.when(warm & (F.col("n") < fo.LOW_HISTORY), F.concat(
            F.lit("only "), n, F.lit(" observations — forecast is high-uncertainty."))),
        F.when(warm & F.col("pattern").isin("intermittent", "lumpy") & (F.col("method") != "ensemble"), F.lit(
            "intermittent/lumpy demand — Croston-family methods produce point forecasts; "
            "intervals come from a normal residual approximation in v1.")),
        F.when((F.col("n") >= fo.MIN_OBS) & F.col("note").isNotNull(),
               F.concat(F.lit("regime break detected: "), F.col("note")))), lambda x: x.isNotNull())


def caveats(df: DataFrame, freq: str) -> DataFrame:
    """Caveat texts of each SKU on the classical path."""
    from .series import characterize
    s = characterize(df, freq).select("sku_id", F.col("n_obs").cast("int").alias("n"), "pattern")
    s = s.join(regime_break(df).select("sku_id", "note"), "sku_id", "left").withColumns({
        "method": fo.route_of(F.col("pattern")), "n_members": F.lit(1), "weights": F.lit(""), "prior_weight": F.lit(0.0)})
    return s.select("sku_id", caveat_texts(0).alias("caveats"))


def forecast_summary(forecasts: DataFrame, summary: DataFrame) -> DataFrame:
    tot = forecasts.groupBy("sku_id").agg(F.sum("point").alias("horizon_total_demand"))
    return summary.join(tot, "sku_id").select(
        "sku_id", "method", "horizon_total_demand", F.col("mape").alias("mape_backtest"),
        F.col("pattern").alias("characterization"), "n_obs", "caveats")


# ---- hierarchy -------------------------------------------------------------------------------

def build_hierarchy(df: DataFrame) -> DataFrame:
    """History of TOTAL, each category and category/sku.  A SKU's sums stay where a panel made by SKU has its rows; only the
    sums above it cross an exchange."""
    d = df.select(F.coalesce("category", F.lit("UNKNOWN")).alias("category"), "sku_id", "date", "demand")
    own = d.groupBy("date", "category", "sku_id").agg(F.sum("demand").alias("y")).withColumn("_g", F.lit(0))
    above = d.groupingSets([["date"], ["date", "category"]], "date", "category").agg(
        F.sum("demand").alias("y"), F.grouping_id().alias("_g"))
    g = own.unionByName(above.select("date", "category", F.lit(None).cast("string").alias("sku_id"), "y", (F.col("_g") + 1).alias("_g")))
    uid = (F.when(F.col("_g") == 0, F.concat("category", F.lit("/"), "sku_id"))
           .when(F.col("category").isNotNull(), F.col("category")).otherwise("TOTAL"))
    return g.select(uid.alias("unique_id"), F.col("date").alias("ds"), "y")


def reconcile(bottom: DataFrame, category: DataFrame, total: DataFrame, method: str = "wls") -> DataFrame:
    """Forecasts on three levels made additive.

    bottom (sku_id, category, step, point, var), category (category, step, point, var),
    total (step, point, var).  `bottom_up` sums the SKUs, `top_down` splits the total by
    bottom shares, `wls` weights every level by the inverse of its variance: one up-sweep
    of sums and one down-sweep that hands each difference down in proportion to variance.
    """
    b = bottom.groupBy("category", "step").agg(F.sum("point").alias("sum_b"), F.sum("var").alias("var_b"))
    c = b.join(category.select("category", "step", F.col("point").alias("c_hat"), F.col("var").alias("c_var")),
               ["category", "step"])
    if method == "bottom_up":
        c = c.withColumns({"c_mid": F.col("sum_b"), "c_mid_var": F.col("var_b")})
    else:
        # a category's own forecast and the sum below it, weighted by precision
        c = c.withColumns({
            "c_mid": (F.col("sum_b") / F.col("var_b") + F.col("c_hat") / F.col("c_var"))
            / (1 / F.col("var_b") + 1 / F.col("c_var")),
            "c_mid_var": 1 / (1 / F.col("var_b") + 1 / F.col("c_var"))})
    t = c.groupBy("step").agg(F.sum("c_mid").alias("sum_c"), F.sum("c_mid_var").alias("var_c"), F.sum("sum_b").alias("all_b"))
    t = t.join(total.select("step", F.col("point").alias("t_hat"), F.col("var").alias("t_var")), "step")
    if method == "bottom_up":
        t = t.withColumn("t_rec", F.col("sum_c"))
    elif method == "top_down":
        t = t.withColumn("t_rec", F.col("t_hat"))
    else:
        t = t.withColumn("t_rec", (F.col("sum_c") / F.col("var_c") + F.col("t_hat") / F.col("t_var"))
                         / (1 / F.col("var_c") + 1 / F.col("t_var")))
    # one row per step
    c = c.join(t.select("step", "t_rec", "sum_c", "var_c", "all_b"), "step")
    if method == "top_down":
        c = c.withColumn("c_rec", F.when(F.col("all_b") > 0, F.col("t_rec") * F.col("sum_b") / F.col("all_b")).otherwise(0.0))
    else:
        c = c.withColumn("c_rec", F.col("c_mid") + (F.col("t_rec") - F.col("sum_c")) * F.col("c_mid_var") / F.col("var_c"))
    d = bottom.join(c.select("category", "step", "c_rec", "sum_b", "var_b"), ["category", "step"])
    if method == "top_down":
        rec = F.when(F.col("sum_b") > 0, F.col("c_rec") * F.col("point") / F.col("sum_b")).otherwise(0.0)
    else:
        rec = F.col("point") + (F.col("c_rec") - F.col("sum_b")) * F.col("var") / F.col("var_b")
    sku = d.select(F.concat("category", F.lit("/"), "sku_id").alias("unique_id"), "step", rec.alias("reconciled"))
    return (sku.unionByName(c.select(F.col("category").alias("unique_id"), "step", F.col("c_rec").alias("reconciled")))
            .unionByName(t.select(F.lit("TOTAL").alias("unique_id"), "step", F.col("t_rec").alias("reconciled"))))


def reconcile_panel(df: DataFrame, h: int, freq: str, method: str = "wls") -> DataFrame:
    """Routed forecasts of every node of the hierarchy, reconciled."""
    tree = build_hierarchy(df.where(F.col("category").isNotNull()))
    nodes = tree.select(F.col("unique_id").alias("sku_id"), F.col("ds").alias("date"), F.col("y").alias("demand"))
    s = fo.route_model(fo.to_series(nodes), freq).where(F.col("n") >= fo.MIN_OBS)
    fc = fo.classical_fc(s.withColumn("_var", F.pow(fo.difference_sigma(F.col("y")), F.lit(2.0))), h, freq)
    r = materialise(fo.rows(fc, "sku_id", "_var").select(F.col("sku_id").alias("uid"), "step", "point", F.col("_var").alias("var")))
    slash = F.instr("uid", "/")
    bottom = r.where(slash > 0).select(F.expr("substring(uid, instr(uid, '/') + 1)").alias("sku_id"),
                                       F.expr("substring(uid, 1, instr(uid, '/') - 1)").alias("category"), "step", "point", "var")
    cat = r.where((slash == 0) & (F.col("uid") != "TOTAL")).select(F.col("uid").alias("category"), "step", "point", "var")
    return reconcile(bottom, cat, r.where(F.col("uid") == "TOTAL").select("step", "point", "var"), method)

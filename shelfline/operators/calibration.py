"""Reference distributions: calendar lifts, category defaults, priors, quantile grids."""
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import exact_quantiles
from ..session import materialise, stored
from .series import METRICS, pattern_features, weak_labels

QUANTILE_GRID = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
# fixed values: rates of food / other departments, lead time by department family
RATES = ("holding_cost_rate", "order_cost_default", "markup_default", "default_lead_time_days",
         "perishable", "review_period_default_days", "avg_unit_price")
DEFAULT_RATES = (0.25, 50.0, 1.5, 14.0, False, 14.0, 5.0)


def calendar_lifts(sales: DataFrame) -> DataFrame:
    """Mean by weekday, ISO week and event over the grand mean, from (date, event, sales).

    Days are pre-aggregated, so the grouping sets run over the calendar only."""
    days = sales.groupBy("date", "event").agg(F.sum("sales").alias("s"), F.count("sales").alias("n"))
    grand = days.agg(F.sum("s") / F.sum("n")).scalar()
    keys = F.explode(F.array(
        F.struct(F.lit("dow").alias("kind"), (F.weekday("date") + 1).cast("string").alias("key")),
        F.struct(F.lit("woy").alias("kind"), F.weekofyear("date").cast("string").alias("key")),
        F.struct(F.lit("event").alias("kind"), F.col("event").alias("key"))))
    g = (days.select("s", "n", keys.alias("k")).where(F.col("k.key").isNotNull())
         .groupBy("k.kind", "k.key").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    return (g.where((F.col("kind") != "event") | (F.col("n") >= 30))
            .select("kind", "key", F.when(grand > 0, F.round(F.col("s") / F.col("n") / grand, 4)).otherwise(1.0).alias("lift"), "n"))


# Poisson(1) weights: a row's number, mixed with the replicate's, against the cumulated chances of 0, 1, 2, ...
PRIME = 2_147_483_647
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def replicate_rule(b: int) -> tuple[int, int]:
    """Multiplier and offset of a replicate."""
    return 48_271 * (b + 1) * (b + 2) % PRIME, 69_621 * (b + 1) % PRIME


def row_number_of(key: Column, seed: int) -> Column:
    """A number below PRIME for a row, from its key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") % PRIME


def _weights(number: np.ndarray, replicates: int) -> np.ndarray:
    """Rows x replicates."""
    rules = np.array([replicate_rule(b) for b in range(replicates)], np.int64)
    x = (number[:, None] * rules[:, 0] + rules[:, 1]) % PRIME
    u = (x * (x % 65_521 + 1) % PRIME + 0.5) / PRIME
    return np.searchsorted(POISSON, u.ravel(), side="right").reshape(u.shape).astype(np.float64)


def lift_ci(sales: DataFrame, replicates: int = 200, alpha: float = 0.05, seed: int = 0, row_key: str = "row_key") -> DataFrame:
    """Bootstrap interval of the weekday, ISO week and event lifts (events of 30 rows or more).

    Poisson bootstrap: every row has a weight in every replicate, from its key, so results do not depend on how rows are dealt.
    Tasks add weights and weighted sales into one vector of `replicates` numbers a calendar value; only these vectors cross the exchange,
    however many rows a value has.  Rows with equal keys have equal weights."""
    s = F.col("sales").cast("double")
    base = sales.where(F.col("sales").isNotNull()).select(
        row_number_of(F.col(row_key), seed).alias("number"), s.alias("sales"), (F.weekday("date") + 1).cast("string").alias("dow"),
        F.weekofyear("date").cast("string").alias("woy"), F.col("event").cast("string").alias("event"))
    kinds = ("dow", "woy", "event")

    def run(batches):
        total: dict = {}
        for batch in batches:
            frame = batch.to_pandas()
            for at in range(0, len(frame), 4096):
                part = frame.iloc[at : at + 4096]
                w = _weights(part["number"].to_numpy(np.int64), replicates)
                value = part["sales"].to_numpy(np.float64)[:, None]
                for kind in kinds:
                    code, names = pd.factorize(part[kind])
                    for k, name in enumerate(names):
                        own = code == k
                        held = total.setdefault((kind, name), np.zeros((2, replicates + 1)))
                        held[0, 1:] += w[own].sum(axis=0)
                        held[1, 1:] += (w[own] * value[own]).sum(axis=0)
                        held[0, 0] += own.sum()
                        held[1, 0] += value[own].sum()
        keys = list(total)
        yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in keys], "key": [str(v) for _, v in keys], "w": [total[k][0] for k in keys], "s": [total[k][1] for k in keys]},
                                         pa.schema([("kind", pa.string()), ("key", pa.string()), ("w", pa.list_(pa.float64())), ("s", pa.list_(pa.float64()))]))

    own = base.mapInArrow(run, "kind string, key string, w array<double>, s array<double>")
    each = own.select("kind", "key", F.posexplode(F.arrays_zip("w", "s")).alias("b", "x"))
    # place 0 holds the plain counts and sums
    means = materialise(each.groupBy("kind", "key", "b").agg(F.sum("x.w").alias("w"), F.sum("x.s").alias("s")))
    grand = means.where("b = 0 and kind = 'dow'").agg(F.sum("s") / F.sum("w")).scalar()
    m = F.when((F.col("b") > 0) & (F.col("w") > 0), F.col("s") / F.col("w"))
    out = means.groupBy("kind", "key").agg(
        F.round(F.percentile(m, alpha / 2) / grand, 4).alias("ci_lo"), F.round(F.percentile(m, 1 - alpha / 2) / grand, 4).alias("ci_hi"),
        F.max(F.when(F.col("b") == 0, F.col("w"))).cast("long").alias("n"), F.count(m).alias("replicates"))
    return out.where((F.col("kind") != "event") | (F.col("n") >= 30))


def flag_lift(sales: DataFrame, flags: list[str]) -> DataFrame:
    """Mean on flagged days over mean on other days, per flag column."""
    items = F.explode(F.array(*[F.struct(F.lit(f).alias("region"), F.col(f).alias("on")) for f in flags]))
    days = sales.groupBy(*flags).agg(F.sum("sales").alias("s"), F.count("sales").alias("n"))
    g = days.select("s", "n", items.alias("f")).groupBy("f.region").agg(
        *[F.sum(F.when(F.col("f.on") == v, F.col(c))).alias(f"{c}{v}") for v in (0, 1) for c in ("s", "n")])
    return g.where((F.col("n1") > 0) & (F.col("n0") > 0) & (F.col("s0") > 0)).select(
        "region", F.round((F.col("s1") / F.col("n1")) / (F.col("s0") / F.col("n0")), 4).alias("lift"),
        F.col("n1").alias("n_on"), F.col("n0").alias("n_off"))


def _rate_columns(dept: Column) -> list[Column]:
    food = F.startswith(dept, F.lit("FOODS"))
    pick = lambda a, b: F.when(food, a).otherwise(b)
    lead = F.when(food, 4.0).when(F.startswith(dept, F.lit("HOUSEHOLD")), 10.0).otherwise(14.0)
    return [pick(0.32, 0.25).alias("holding_cost_rate"), pick(35.0, 50.0).alias("order_cost_default"),
            pick(1.45, 1.6).alias("markup_default"), lead.alias("default_lead_time_days"),
            food.alias("perishable"), F.lit(7.0).alias("review_period_default_days")]


def category_defaults(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Rates per department with its mean price, plus the `_default` row."""
    spark = items.sparkSession
    per = (prices.join(items.select("item_id", "dept_id").distinct(), "item_id")
           .groupBy("dept_id").agg(F.round(F.avg("sell_price"), 2).alias("avg_unit_price")))
    out = per.select("dept_id", *_rate_columns(F.col("dept_id")), "avg_unit_price")
    default = spark.range(1).select(F.lit("_default").alias("dept_id"), *[
        F.lit(v).alias(n) for n, v in zip(RATES, DEFAULT_RATES)])
    return out.unionByName(default)


def gamma_moments(m: Column, v: Column, n: Column, least: int = 3, floor: float = 1e-3):
    alpha = F.when(n < least, 1.0).when(v < floor, F.greatest(F.lit(1.0), m)).otherwise(m * m / v)
    beta = F.when(n < least, 0.1).when(v < floor, 1.0).otherwise(m / v)
    return alpha, beta


def fit_prior(means: DataFrame, by=()) -> DataFrame:
    """Gamma prior by moments over positive SKU means."""
    pos = F.when(F.col("mean_demand") > 0, F.col("mean_demand"))
    g = means.groupBy(*by).agg(F.count(pos).alias("n_observed_skus"), F.avg(pos).alias("mean_of_means"),
                               F.var_samp(pos).alias("var_of_means"))
    a, b = gamma_moments(F.col("mean_of_means"), F.col("var_of_means"), F.col("n_observed_skus"))
    return g.withColumns({"alpha": a, "beta": b})


def series_priors(df: DataFrame) -> DataFrame:
    """Priors per (department, pattern) with at least five selling SKUs."""
    labels = weak_labels(pattern_features(df)).select("sku_id", "pattern")
    means = df.groupBy("sku_id").agg(F.min("category").alias("dept_id"), F.avg("demand").alias("mean_demand"))
    pos = F.when(F.col("mean_demand") > 0, F.col("mean_demand"))
    g = means.join(labels, "sku_id").groupBy("dept_id", "pattern").agg(
        F.count(pos).alias("n_observed_skus"), F.avg(pos).alias("mean_of_means"),
        F.var_samp(pos).alias("var_of_means")).where(F.col("n_observed_skus") >= 5)
    a, b = gamma_moments(F.col("mean_of_means"), F.col("var_of_means"), F.col("n_observed_skus"), 5, 1e-6)
    return g.select("dept_id", "pattern", a.alias("alpha"), b.alias("beta"), "n_observed_skus",
                    "mean_of_means", "var_of_means")


def department_metrics(df: DataFrame) -> DataFrame:
    f = pattern_features(df)
    dept = df.groupBy("sku_id").agg(F.min("category").alias("dept_id"))
    return f.join(dept, "sku_id").select(
        "sku_id", "dept_id", "cv_demand", F.col("zero_pct").alias("intermittency_rate"),
        F.greatest("acf_lag_7", "acf_lag_28", "acf_lag_365").alias("seasonality_strength"),
        F.abs("trend_slope_pct").alias("trend_slope_pct"),
        F.abs(F.col("last_90d_vs_baseline_ratio") - 1.0).alias("regime_shift_score"))


def reference_quantiles(m: DataFrame) -> DataFrame:
    """Quantile grid per department and metric, and over all as `_default`."""
    tall = m.unpivot(["sku_id", "dept_id"], list(METRICS), "metric", "value")
    both = tall.select("metric", "value", F.explode(F.array("dept_id", F.lit("_default"))).alias("dept_id"))
    q = exact_quantiles(both, "value", QUANTILE_GRID, by=("dept_id", "metric"))
    return q.where(F.col("n") >= 5).withColumnRenamed("n", "n_skus")


def train_classifier(feats: DataFrame, seed: int = 0):
    """Random forest on the weak labels, 80/20 by SKU hash.  Returns (model, accuracy row).

    Labels and features are stored once: the indexer, every pass of the forest and the evaluation read them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    from .series import FEATURES
    data = stored(weak_labels(feats), "pattern-features")
    held = F.pmod(F.xxhash64("sku_id", F.lit(seed)), F.lit(5)) == 0
    train, val = data.where(~held), data.where(held)
    model = Pipeline(stages=[
        StringIndexer(inputCol="pattern", outputCol="label", handleInvalid="skip"),
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=40, maxDepth=8, seed=seed),
    ]).fit(train)
    acc = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy").evaluate(model.transform(val))
    row = data.agg(F.count_if(~held).alias("n_train"), F.count_if(held).alias("n_val"),
                   F.count_distinct("pattern").alias("n_classes")).withColumn("val_accuracy", F.lit(acc))
    return model, row


def classify_pattern(feats: DataFrame, model, rules: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Model label where it is confident, hand rule otherwise.  `rules` is the output of
    `series.characterize`."""
    from pyspark.ml.functions import vector_to_array
    labels = model.stages[0].labels
    scored = model.stages[2].transform(model.stages[1].transform(feats))
    prob = vector_to_array("probability")
    top = F.array_max(prob)
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(prob, top).cast("int"))
    scored = scored.select("sku_id", top.alias("confidence"), name.alias("_label"))
    j = rules.select("sku_id", "n_obs", F.col("pattern").alias("_rule")).join(scored, "sku_id")
    sure = (F.col("confidence") >= threshold) & (F.col("n_obs") >= 13)
    return j.select("sku_id", F.when(sure, F.col("_label")).otherwise(F.col("_rule")).alias("pattern"),
                    F.when(F.col("n_obs") < 13, "rules").when(sure, "classifier")
                    .otherwise("rules_low_confidence").alias("source"), "confidence")

"""ABC/XYZ classes, lead-time-demand moments, stockout risk and the reorder queue.

Everything per SKU comes out of one aggregate over the panel (`sku_state`), so a
ranking costs one exchange by SKU plus joins with tables of one row per SKU.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordering import exact_quantiles, row_numbers, running_total
from ..functions.rows import side_by_side
from ..functions.stats import norm_cdf, norm_ppf
from ..schema import PERIOD_DAYS, PERIODS_PER_YEAR
from ..session import materialise

# fixed values: class limits, fallbacks
ABC_LIMITS = (0.80, 0.95)
XYZ_LIMITS = (0.5, 1.0)
LEAD_TIME_DEFAULT, LEAD_TIME_STD_DEFAULT = 14.0, 2.8
Z_TARGET = 1.65
RECENT_ROWS = 13


def _abc(share: Column) -> Column:
    return F.when(share <= ABC_LIMITS[0], "A").when(share <= ABC_LIMITS[1], "B").otherwise("C")


def class_columns(factor: float) -> list[Column]:
    """Aggregates of a SKU's rows that its classes come from."""
    price = F.coalesce("unit_price", "unit_cost", F.lit(1.0))
    mean = F.avg("demand")
    return [(F.coalesce(F.sum(F.col("demand") * price), F.lit(0.0)) / F.count(F.lit(1)) * factor).alias("revenue_annual"),
            F.when(F.coalesce(mean, F.lit(0.0)) == 0, 0.0)
            .otherwise(F.coalesce(F.nanvl(F.stddev_samp("demand"), F.lit(0.0)), F.lit(0.0)) / mean).alias("cv_demand")]


def abc_xyz(df: DataFrame, factor: float) -> DataFrame:
    """Pareto class on annual revenue (cumulative share inclusive of the SKU) and
    variability class per SKU."""
    return classed(df.groupBy("sku_id").agg(*class_columns(factor)))


def classed(per: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Classes of (sku_id, revenue_annual, cv_demand) rows; `keep` names columns to pass on."""
    ranked = running_total(per, [F.desc("revenue_annual"), F.asc("sku_id")], F.col("revenue_annual"), "_cum")
    total = ranked.agg(F.sum("revenue_annual")).scalar()
    share = F.when(total <= 0, 0.0).otherwise(F.col("_cum") / total)
    cv = F.col("cv_demand")
    return ranked.select(
        "sku_id", _abc(share).alias("abc_class"),
        F.when(cv < XYZ_LIMITS[0], "X").when(cv < XYZ_LIMITS[1], "Y").otherwise("Z").alias("xyz_class"),
        "revenue_annual", "cv_demand",
        (F.col("revenue_annual") / F.greatest(total, F.lit(1e-9))).alias("revenue_share"), *keep)


def abc_xyz_heatmap(classes: DataFrame) -> DataFrame:
    """Counts of the nine cells, empty ones included, from one aggregate."""
    cells = [a + x for a in "ABC" for x in "XYZ"]
    cell = F.concat("abc_class", "xyz_class")
    one = classes.agg(*[F.count_if(cell == c).alias(c) for c in cells])
    return one.unpivot([], cells, "cell", "n_skus")


def abc_migration(df: DataFrame) -> DataFrame:
    """SKUs whose revenue class rose between the two latest 90-day windows."""
    last = df.agg(F.max("date")).scalar()
    rev = F.col("demand") * F.coalesce("unit_price", F.lit(0.0))
    age = F.datediff(last, F.col("date"))

    def window(lo, hi, name):
        per = (df.where((age >= lo) & (age < hi)).groupBy("sku_id").agg(F.sum(rev).alias("revenue")))
        ranked = running_total(per, [F.desc("revenue"), F.asc("sku_id")], F.col("revenue"), "_cum")
        total = ranked.agg(F.sum("revenue")).scalar()
        return ranked.select("sku_id", F.when(total <= 0, "C").otherwise(_abc(F.col("_cum") / total)).alias(name))

    both = window(0, 90, "abc_recent").join(window(90, 180, "abc_prior"), "sku_id")
    return both.where(F.col("abc_recent") < F.col("abc_prior"))


# ---- one row per SKU -----------------------------------------------------------

def sku_state(df: DataFrame) -> DataFrame:
    """Latest attributes, recent demand and lead-time moments of each SKU.

    `last_*` are the values of the last row, `known_*` the last non-null ones: partial aggregates, like the counts and
    means.  Recent demand needs the last RECENT_ROWS rows alone, which are picked before the exchange (a ranking with a
    limit), so no row of the panel travels whole."""
    at = ("demand", "on_hand", "unit_cost", "unit_price", "lead_time_days", "supplier", "category")
    lt = F.col("lead_time_days")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(f"known_{c}")
    whole = df.groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.avg("demand").alias("mean_demand"), F.sum("demand").alias("sum_demand"), F.max_by(F.struct(*at), "date").alias("_last"),
        *[known(c) for c in ("unit_cost", "unit_price", "on_hand", "lead_time_days")],
        F.avg("unit_cost").alias("mean_cost"), F.avg("unit_price").alias("mean_price"),
        F.count(lt).alias("lt_n"), F.avg(lt).alias("lt_mean"), F.stddev_pop(lt).alias("lt_std"))
    back = F.row_number().over(W.partitionBy("sku_id").orderBy(F.desc("date")))
    recent = df.select("sku_id", "date", "demand").withColumn("_back", back).where(F.col("_back") <= RECENT_ROWS).groupBy("sku_id").agg(
        F.avg("demand").alias("mean_recent"), F.stddev_pop("demand").alias("std_recent"),
        F.avg(F.when(F.col("_back") <= 8, F.col("demand"))).alias("mean_last8"))
    j = whole.join(recent, "sku_id")
    plain = [c for c in whole.columns if c not in ("sku_id", "_last")]
    return j.select("sku_id", *plain, "mean_recent", "std_recent", "mean_last8", *[F.col("_last")[c].alias(f"last_{c}") for c in at])


def latest_by_sku(df: DataFrame) -> DataFrame:
    cols = ["date_max"] + [f"last_{c}" for c in ("demand", "on_hand", "supplier", "category")] + [
        f"known_{c}" for c in ("unit_cost", "unit_price", "on_hand")]
    return sku_state(df).select("sku_id", *cols)


def with_supplier(state: DataFrame, sup: DataFrame) -> DataFrame:
    """Supplier attributes by name.  The size decides the join: small supplier tables
    are broadcast by the optimizer, large ones are shuffled."""
    s = sup.select(F.col("name").alias("_name"), "supplier_id", "default_lead_time_days",
                   "lead_time_std_days", "moq", "case_pack", "payment_terms")
    return state.join(s, F.col("last_supplier") == F.col("_name"), "left").drop("_name")


def _lead_mean(mult=1.0):
    return F.coalesce("lt_mean", "default_lead_time_days", F.lit(LEAD_TIME_DEFAULT)) * mult


def _lead_std(mean: Column):
    guess = F.greatest(mean * 0.2, F.lit(0.5))
    own = F.when(F.col("lt_n") > 1, F.col("lt_std")).otherwise(guess)
    return (F.when(F.col("lt_n") > 0, own)
            .when(F.col("default_lead_time_days").isNotNull(), F.coalesce("lead_time_std_days", guess))
            .otherwise(LEAD_TIME_STD_DEFAULT))


def lead_time_moments(df: DataFrame, sup: DataFrame) -> DataFrame:
    j = with_supplier(sku_state(df), sup)
    return j.select("sku_id", _lead_mean().alias("lead_time_mean"), _lead_std(_lead_mean()).alias("lead_time_std"))


def _moments(j: DataFrame, period: float, lt_mult=1.0, d_mult=1.0, floor_std=False) -> DataFrame:
    """Adds mean_d, std_d, lt_periods, ltd_mean, ltd_std."""
    sd = F.col("std_recent")
    sd = F.greatest(F.lit(0.5), sd) if floor_std else F.when(
        sd == 0, F.greatest(F.lit(0.5), F.col("mean_recent") * 0.1)).otherwise(sd)
    j = j.withColumn("_lt", _lead_mean(lt_mult)).withColumns({
        "mean_d": F.col("mean_recent") * d_mult, "std_d": sd * d_mult,
        "lt_std_used": _lead_std(F.col("_lt")),
        "lt_periods": F.greatest(F.lit(1.0), F.col("_lt") / period)})
    var = (F.col("lt_periods") * F.col("std_d") * F.col("std_d")
           + F.col("mean_d") * F.col("mean_d") * F.pow(F.col("lt_std_used") / period, F.lit(2.0)))
    return j.withColumns({"ltd_mean": F.col("lt_periods") * F.col("mean_d"),
                          "ltd_std": F.sqrt(F.greatest(var, F.lit(1e-9)))})


def ltd_moments(df: DataFrame, sup: DataFrame, freq: str) -> DataFrame:
    j = _moments(with_supplier(sku_state(df), sup), PERIOD_DAYS[freq])
    return j.select("sku_id", "mean_d", "std_d", "lt_periods", "ltd_mean", "ltd_std")


def _risk(j: DataFrame, period: float) -> DataFrame:
    # the score is a column of its own: the normal CDF names it several times
    j = j.withColumn("_z", (F.col("known_on_hand") - F.col("ltd_mean")) / F.greatest("ltd_std", F.lit(1e-6)))
    daily = F.col("mean_d") / period
    return j.withColumns({
        "stockout_prob": F.coalesce(F.lit(1.0) - norm_cdf(F.col("_z")), F.lit(0.0)),
        "days_of_cover": F.when(daily > 0, F.col("known_on_hand") / daily)})


def _stockout_date(as_of: Column) -> Column:
    cover = F.col("days_of_cover")
    return (F.when(F.col("known_on_hand") <= 0, as_of)
            .when(cover <= 365, F.date_add(as_of, F.floor(cover).cast("int"))))


def stockout_risk(df: DataFrame, sup: DataFrame, freq: str, as_of: str) -> DataFrame:
    period = PERIOD_DAYS[freq]
    j = _risk(_moments(with_supplier(sku_state(df), sup), period), period)
    return j.select("sku_id", "stockout_prob", "days_of_cover",
                    _stockout_date(F.lit(as_of).cast("date")).alias("projected_stockout_date"))


def round_qty(raw: Column, moq: Column, pack: Column, strict_pack: bool = False) -> Column:
    """Up to whole packs, then up to the minimum order; `strict_pack` rounds the
    minimum up to packs again."""
    to_pack = lambda q: F.when(pack > 0, F.ceil(q / pack) * pack).otherwise(q)
    packed = to_pack(raw)
    floor = to_pack(moq) if strict_pack else moq
    return (F.when(~(raw > 0) | raw.isNull(), 0.0)
            .when((moq > 0) & (packed < moq), floor).otherwise(packed).cast("double"))


def expedite(prob: Column, at_risk: Column, qty: Column, cost: Column) -> Column:
    breakeven = F.when(cost > 0, cost * 0.5).otherwise(0.0)
    return (prob > 0.3) & (at_risk > qty * breakeven)


def reorder_candidates(df: DataFrame, sup: DataFrame, freq: str, as_of: str,
                       cover_limit: float = 30.0) -> DataFrame:
    """Scored rows before ranking: SKUs with stock data, short cover and a quantity."""
    period = PERIOD_DAYS[freq]
    state = sku_state(df).where((F.col("n_obs") >= 4) & F.col("known_on_hand").isNotNull())
    j = _risk(_moments(with_supplier(state, sup), period), period)
    j = j.where(F.col("days_of_cover").isNull() | (F.col("days_of_cover") <= cover_limit))
    raw = F.greatest(F.lit(0.0), F.col("ltd_mean") + Z_TARGET * F.col("ltd_std") - F.col("known_on_hand"))
    j = j.withColumns({
        "unit_cost": F.coalesce("known_unit_cost", F.lit(1.0)), "recommended_qty_raw": raw,
        "recommended_qty": round_qty(raw, F.col("moq"), F.col("case_pack"))}).where(F.col("recommended_qty") > 0)
    price = F.coalesce(F.col("known_unit_price"), F.col("unit_cost") * 1.5)
    at_risk = F.col("stockout_prob") * F.col("mean_d") * price * F.col("lt_periods")
    j = j.withColumn("revenue_at_risk", at_risk).withColumn(
        "score", F.col("stockout_prob") * F.col("revenue_at_risk"))
    return j.select(
        "sku_id", F.col("last_category").alias("category"), F.col("last_supplier").alias("supplier_name"),
        F.coalesce("supplier_id", supplier_id(F.col("last_supplier"))).alias("supplier_id"),
        F.col("known_on_hand").alias("on_hand"),
        (F.col("ltd_mean") + norm_ppf(F.lit(0.95)) * F.col("ltd_std")).alias("reorder_point"),
        "recommended_qty", "recommended_qty_raw", "unit_cost",
        (F.col("recommended_qty") * F.col("unit_cost")).alias("total_cost"),
        _stockout_date(F.lit(as_of).cast("date")).alias("projected_stockout_date"),
        "days_of_cover", "stockout_prob", "revenue_at_risk", "score",
        expedite(F.col("stockout_prob"), F.col("revenue_at_risk"), F.col("recommended_qty"), F.col("unit_cost"))
        .alias("expedite_flag"),
        F.when(F.col("unit_cost") > 0, F.col("unit_cost") * 0.5).alias("expedite_breakeven"), "moq", "case_pack")


def by_score():
    return [F.desc(F.round("score", 4)), F.asc("sku_id")]


def reorder_queue(df: DataFrame, sup: DataFrame, freq: str, as_of: str, limit: int | None = None,
                  cover_limit: float = 30.0, groups: DataFrame | None = None) -> DataFrame:
    """Candidates by stockout probability x revenue at risk; all of them, or the best `limit`.

    A top-k is taken before the class join.  `groups` (sku_id, group_id) fills the joint replenishment group."""
    top = reorder_candidates(df, sup, freq, as_of, cover_limit)
    if limit is not None:
        top = top.orderBy(*by_score()).limit(limit)
    classes = abc_xyz(df, PERIODS_PER_YEAR[freq]).select("sku_id", "abc_class", "xyz_class")
    out = top.join(classes, "sku_id", "left").withColumns({
        "abc_class": F.coalesce("abc_class", F.lit("C")), "xyz_class": F.coalesce("xyz_class", F.lit("Z"))})
    if groups is None:
        return out.withColumn("joint_replen_group", F.lit(None).cast("string"))
    return out.join(groups.select("sku_id", F.col("group_id").alias("joint_replen_group")), "sku_id", "left")


def supplier_id(name: Column) -> Column:
    """SUP_ + cleaned upper-case name (24 characters) + four digits of its md5."""
    cleaned = F.regexp_replace(F.regexp_replace(F.upper(name), "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")
    h = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % 10000
    return F.when(name != "", F.concat(F.lit("SUP_"), F.substring(cleaned, 1, 24), F.lit("_"),
                                       F.lpad(h.cast("string"), 4, "0"))).otherwise("SUP_UNKNOWN")


# ---- stress ------------------------------------------------------------------------

def exposure_state(df: DataFrame, sup: DataFrame) -> DataFrame:
    """One row per SKU that an exposure under any multipliers is a projection of."""
    # every output is finite exactly when the recent window has a mean
    state = sku_state(df).where((F.col("n_obs") >= 4) & F.col("known_on_hand").isNotNull()
                                & F.col("mean_recent").isNotNull() & ~F.isnan("mean_recent"))
    return with_supplier(state, sup).select("sku_id", "known_on_hand", "known_unit_cost", "known_unit_price", "mean_recent", "std_recent",
                                            "lt_n", "lt_mean", "lt_std", "default_lead_time_days", "lead_time_std_days")


def exposed(state: DataFrame, freq: str, lt_mult: float = 1.0, d_mult: float = 1.0, service_level: float | None = None) -> DataFrame:
    """Stockout probability, revenue at risk and quantity per SKU of exposure_state() under multipliers."""
    period = PERIOD_DAYS[freq]
    level = min(max(0.95 if service_level is None else service_level, 0.01), 0.999)
    j = _risk(_moments(state, period, lt_mult, d_mult, floor_std=True), period)
    cost = F.coalesce("known_unit_cost", F.lit(1.0))
    price = F.coalesce(F.col("known_unit_price"), cost * 1.5)
    need = F.col("ltd_mean") + norm_ppf(F.lit(level)) * F.col("ltd_std") - F.col("known_on_hand")
    return j.select("sku_id", "stockout_prob",
                    (F.col("stockout_prob") * F.col("mean_d") * price * F.col("lt_periods")).alias("revenue_at_risk"),
                    F.greatest(F.lit(0.0), need).alias("recommended_qty"))


def exposure(df: DataFrame, sup: DataFrame, freq: str, lt_mult: float = 1.0, d_mult: float = 1.0,
             service_level: float | None = None) -> DataFrame:
    """Stockout probability, revenue at risk and quantity per SKU under multipliers."""
    return exposed(exposure_state(df, sup), freq, lt_mult, d_mult, service_level)


def stress_impacts(base: DataFrame, shock: DataFrame) -> DataFrame:
    b = base.select("sku_id", *[F.col(c).alias(f"baseline_{c}") for c in base.columns[1:]])
    s = shock.select("sku_id", *[F.col(c).alias(f"shock_{c}") for c in shock.columns[1:]])
    j = s.join(b, "sku_id", "left").na.fill(0.0, [f"baseline_{c}" for c in base.columns[1:]])
    return j.withColumn("delta_revenue_at_risk",
                        F.col("shock_revenue_at_risk") - F.col("baseline_revenue_at_risk"))


def stress_test(df: DataFrame, sup: DataFrame, freq: str, lt_mult=1.0, d_mult=1.0, service_level=None) -> DataFrame:
    """Portfolio totals before and after a shock; one row.  The panel is read once, both sides are projections of the stored SKU rows."""
    state = materialise(exposure_state(df, sup))
    tot = lambda t, p: t.agg(F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)).alias(f"{p}_total_revenue_at_risk"),
                             F.count_if(F.col("stockout_prob") > 0.1).alias(f"{p}_n_at_risk"))
    b = tot(exposed(state, freq, 1.0, 1.0, service_level), "baseline")
    shock = exposed(state, freq, lt_mult, d_mult, service_level)
    return side_by_side(b, tot(shock, "shock"), var_cvar(shock)).withColumn(
        "delta_total_revenue_at_risk",
        F.col("shock_total_revenue_at_risk") - F.col("baseline_total_revenue_at_risk"))


def top_impacted(df: DataFrame, sup: DataFrame, freq: str, lt_mult=1.0, d_mult=1.0, service_level=None,
                 k: int = 10) -> DataFrame:
    state = materialise(exposure_state(df, sup))
    i = stress_impacts(exposed(state, freq, 1.0, 1.0, service_level), exposed(state, freq, lt_mult, d_mult, service_level))
    return i.orderBy(F.desc(F.round("delta_revenue_at_risk", 4)), "sku_id").limit(k)


def var_cvar(exp: DataFrame, level: float = 0.95) -> DataFrame:
    """Exact quantile of revenue at risk and the mean at or beyond it."""
    rounded = exp.select(F.round("revenue_at_risk", 6).alias("revenue_at_risk"))
    var = exact_quantiles(rounded, "revenue_at_risk", {"var_95": level})
    limit = var.select("var_95").scalar()
    v = F.col("revenue_at_risk")
    return rounded.agg(F.avg(F.when(v >= limit, v)).alias("cvar_95")).withColumn("var_95", limit).select(
        F.coalesce("var_95", F.lit(0.0)).alias("var_95"), F.coalesce("cvar_95", F.lit(0.0)).alias("cvar_95"))


# ---- weekly plan ---------------------------------------------------------------------

def plan_rationale(df: DataFrame) -> DataFrame:
    """One line per plan row on why it is in the plan."""
    p, rr = F.col("stockout_prob"), F.col("revenue_at_risk")
    pct = F.concat(F.round(p * 100, 0).cast("long").cast("string"), F.lit("%)"))
    text = F.concat_ws(
        "; ", F.when(p > 0.5, F.concat(F.lit("high stockout risk ("), pct))
        .when(p > 0.2, F.concat(F.lit("moderate stockout risk ("), pct)),
        F.when(F.col("expedite_flag"), "expedite recommended"),
        F.when(F.col("projected_stockout_date").isNotNull(), F.concat(
            F.lit("projected stockout "), F.date_format("projected_stockout_date", "yyyy-MM-dd"))),
        F.when(rr > 0, F.concat(F.lit("$"), F.round(rr, 0).cast("long").cast("string"), F.lit(" revenue at risk"))),
        F.when(F.col("abc_class") == "A", "A-class SKU"))
    return df.withColumn("rationale", F.when(text == "", "queue-flagged for replenishment").otherwise(text))


def plan_week(queue: DataFrame, budget: float | None, n: int = 25) -> DataFrame:
    """Every queue row with its place `pos`, in the plan (no reason) or deferred with the reason.

    Without a budget the best `n` by score are planned.  With one, rows are taken in order of score per cost while they fit
    and fewer than `n` are taken.  Money left only shrinks, so a row dearer than it is out for good: a round fetches the
    next rows that still fit, as many as are wanted, and takes the affordable ones in order.  Every round takes one at least, so the driver
    sees no more than `n` rows in each of at most `n` rounds, whatever the queue's length."""
    key = [] if not budget else [F.desc(F.round(F.col("score") / F.greatest(F.lit(1.0), F.col("total_cost")), 9))]
    ranked = materialise(row_numbers(queue, [*key, *by_score()], "pos"))
    if not budget:
        return ranked.withColumn("reason", F.when(F.col("pos") > n, "top_n_cap_reached"))
    taken, left, last = [], float(budget), 0
    while len(taken) < n:
        ahead = ranked.where((F.col("pos") > last) & (F.col("total_cost") <= left)).orderBy("pos").limit(n - len(taken)).select("pos", "total_cost").collect()
        if not ahead:
            break
        for r in ahead:
            if r["total_cost"] <= left:
                taken.append(r["pos"])
                left -= r["total_cost"]
        last = ahead[-1]["pos"]
    late = F.lit(len(taken) >= n) & (F.col("pos") > (taken[-1] if taken else 0))
    return ranked.withColumn("reason", F.when(F.col("pos").isin(taken), None).when(late, "top_n_cap_reached").otherwise("budget_exceeded"))


def plan_summary(plan: DataFrame, budget: float | None) -> DataFrame:
    used = F.sum(F.when(F.col("reason").isNull(), F.col("total_cost")))
    return plan.agg(
        F.count_if(F.col("reason").isNull()).alias("n_items"), F.count_if(F.col("reason").isNotNull()).alias("n_deferred"),
        F.round(F.coalesce(used, F.lit(0.0)), 2).alias("total_cost_usd"),
        F.round(F.coalesce(used, F.lit(0.0)) / F.lit(float(budget or 0) or None) * 100, 1).alias("budget_used_pct"))


def _sup_key():
    return F.coalesce("supplier_id", "supplier_name", F.lit("UNKNOWN"))


def draft_lines_by_supplier(queue: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Order lines: every queue row with its number inside its supplier, largest revenue at risk first.

    Numbers come from running totals that restart at each supplier, so one with most of the queue is spread over many tasks."""
    q = queue.withColumn("sup_key", _sup_key()).withColumn("_rev", F.round("revenue_at_risk", 4))
    order = [F.asc("sup_key"), F.desc("_rev"), F.asc("sku_id")]
    rows = row_numbers(q, order, "line_no", by=["sup_key"]).drop("_rev")
    return rows if max_lines is None else rows.where(F.col("line_no") <= max_lines)


def draft_by_supplier(queue: DataFrame, max_suppliers: int | None = None, max_lines: int | None = None) -> DataFrame:
    """Draft orders, one row per supplier, from its lines; all of them unless limits are given.  Suppliers are
    numbered in queue order: by their best score, then by its SKU."""
    best = F.min(F.struct((-F.round("score", 4)).alias("s"), F.col("sku_id")))
    lines = draft_lines_by_supplier(queue)
    inside = F.lit(True) if max_lines is None else F.col("line_no") <= max_lines
    heads = lines.groupBy("sup_key").agg(
        F.max("supplier_name").alias("supplier_name"), F.count_if(inside).alias("n_lines"), F.max("expedite_flag").alias("expedite"),
        F.round(F.sum(F.when(inside, F.col("recommended_qty") * F.coalesce("unit_cost", F.lit(0.0)))), 2).alias("total_cost"),
        F.max(F.when(F.col("line_no") == 1, F.col("sku_id"))).alias("top_sku"), best.alias("_b"))
    heads = row_numbers(heads, [F.asc("_b.s"), F.asc("_b.sku_id")], "draft_no").drop("_b")
    return heads if max_suppliers is None else heads.where(F.col("draft_no") <= max_suppliers)


def validate_plan(lines: DataFrame, queue: DataFrame, df: DataFrame) -> DataFrame:
    """Proposed (sku_id, qty) lines against the queue: unknown SKUs and empty quantities
    are marked dropped, the rest re-rounded and priced from the panel's latest cost."""
    cost = latest_by_sku(df).select("sku_id", F.col("known_unit_cost").alias("_panel_cost"))
    q = queue.select("sku_id", F.col("unit_cost").alias("_queue_cost"), "moq", "case_pack", "recommended_qty",
                     F.lit(True).alias("_known"))
    j = (lines.select(F.upper(F.trim("sku_id")).alias("sku_id"), F.col("qty").alias("_qty"))
         .join(q, "sku_id", "left").join(cost, "sku_id", "left"))
    qty = round_qty(F.coalesce("_qty", "recommended_qty"), F.col("moq"), F.col("case_pack"), strict_pack=True)
    ok = F.coalesce("_known", F.lit(False)) & (qty > 0)
    unit = F.coalesce("_panel_cost", "_queue_cost")
    return j.select("sku_id", ok.alias("kept"), F.when(ok, qty).alias("qty"), F.when(ok, unit).alias("unit_cost"),
                    F.when(ok, F.round(qty * F.coalesce(unit, F.lit(0.0)), 2)).alias("line_cost"))

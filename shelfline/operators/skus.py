"""SKU table, statuses, portfolio statistics, insights and summaries."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.rows import side_by_side, stack
from ..schema import PERIOD_DAYS, PERIODS_PER_YEAR
from .inventory import abc_migration, abc_xyz, sku_state
from .suppliers import receipt_stats

STATUSES = ("order_now", "at_risk", "watch", "healthy")
DEFAULT_LEAD_TIME = 14.0


def status_of(on_hand: Column, cover: Column, lead: Column) -> Column:
    lt = F.when(lead > 0, lead).otherwise(DEFAULT_LEAD_TIME)
    return (F.when(on_hand.isNull() | (on_hand <= 0), "order_now").when(cover.isNull(), "watch")
            .when(cover < lt, "order_now").when(cover < 1.5 * lt, "at_risk")
            .when(cover < 2.0 * lt, "watch").otherwise("healthy"))


def _cover(period: float) -> Column:
    return F.when(F.col("last_on_hand").isNotNull() & (F.col("mean_last8") > 0),
                  F.round(F.col("last_on_hand") / F.col("mean_last8") * period, 1))


def days_of_cover(df: DataFrame, freq: str) -> DataFrame:
    return sku_state(df).select("sku_id", _cover(PERIOD_DAYS[freq]).alias("days_of_cover"))


def sku_status(df: DataFrame, freq: str) -> DataFrame:
    s = sku_state(df).withColumn("days_of_cover", _cover(PERIOD_DAYS[freq]))
    return s.select("sku_id", "days_of_cover", status_of(
        F.col("last_on_hand"), F.col("days_of_cover"), F.col("last_lead_time_days")).alias("status"))


def sku_rows(df: DataFrame, freq: str) -> DataFrame:
    """The SKU table before filters and paging."""
    s = sku_state(df).withColumn("days_of_cover", _cover(PERIOD_DAYS[freq]))
    classes = abc_xyz(df, PERIODS_PER_YEAR[freq])
    return s.join(classes, "sku_id").select(
        "sku_id", F.col("last_category").alias("category"), F.col("last_supplier").alias("supplier"),
        "abc_class", "xyz_class", F.coalesce("last_demand", F.lit(0.0)).alias("last_demand"),
        F.col("last_on_hand").alias("on_hand"), "days_of_cover", F.round("cv_demand", 3).alias("cv_demand"),
        F.round("revenue_annual", 2).alias("revenue_annual"), "n_obs",
        F.col("last_lead_time_days").alias("lead_time_days"),
        status_of(F.col("last_on_hand"), F.col("days_of_cover"), F.col("last_lead_time_days")).alias("status"))


def _status_rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))


def page(rows: DataFrame, filters: dict | None = None, sort_by: str = "days_of_cover", sort_dir: str = "asc",
         limit: int | None = None, offset: int = 0) -> DataFrame:
    """Equality filters, one of six sort keys (missing cover sorts as infinite), a page.

    Spark turns the offset and limit into a top-k of offset + limit rows per partition."""
    for col, value in (filters or {}).items():
        if value is not None:
            rows = rows.where(F.col(col) == value)
    key = {"days_of_cover": F.coalesce("days_of_cover", F.lit(float("inf"))), "status": _status_rank()}.get(
        sort_by, F.col(sort_by))
    key = key.asc() if sort_dir == "asc" else key.desc()
    rows = rows.orderBy(key, "sku_id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def sku_table(df: DataFrame, freq: str, history: int = 0, **paging) -> DataFrame:
    out = page(sku_rows(df, freq), **paging)
    if not history:
        return out
    recent = sku_history(df, history).groupBy("sku_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("date", "demand"))), lambda s: s["demand"]).alias("history"))
    return out.join(recent, "sku_id", "left")


def sku_history(df: DataFrame, n: int) -> DataFrame:
    """Last `n` rows per SKU."""
    w = W.partitionBy("sku_id").orderBy(F.desc("date"))
    return (df.select("sku_id", "date", "demand").withColumn("_b", F.row_number().over(w))
            .where(F.col("_b") <= n).drop("_b"))


def search_skus(rows: DataFrame, text: str = "", abc=(), xyz=(), status=None, needs_action=False,
                category=None) -> DataFrame:
    t = text.strip().lower()
    if t:
        hit = [F.coalesce(F.lower(c).contains(t), F.lit(False)) for c in ("sku_id", "category", "supplier")]
        rows = rows.where(hit[0] | hit[1] | hit[2])
    if category:
        rows = rows.where(F.col("category") == category)
    if abc:
        rows = rows.where(F.col("abc_class").isin(*abc))
    if xyz:
        rows = rows.where(F.col("xyz_class").isin(*xyz))
    if status:
        rows = rows.where(F.col("status") == status)
    if needs_action:
        rows = rows.where(F.col("status").isin("order_now", "at_risk"))
    return rows


def query_skus(df: DataFrame, freq: str, sort_by: str = "revenue_annual", sort_dir: str = "desc",
               limit: int = 25, **filters) -> DataFrame:
    """Filtered and sorted SKUs with the number matched before the limit."""
    rows = sku_rows(df, freq)
    for col, value in filters.items():
        rows = rows.where(F.col(col) == value)
    total = rows.agg(F.count(F.lit(1))).scalar()
    key = F.coalesce(F.col(sort_by), F.lit(0)) if sort_by not in ("sku_id", "category", "supplier") else F.col(sort_by)
    return (rows.orderBy(key.asc() if sort_dir == "asc" else key.desc(), "sku_id").limit(limit)
            .withColumn("total_matched", total))


def skus_view(df: DataFrame, freq: str) -> DataFrame:
    classes = abc_xyz(df, PERIODS_PER_YEAR[freq]).select("sku_id", "abc_class", "xyz_class")
    return (sku_state(df).select("sku_id", F.col("last_category").alias("category"), F.col("last_supplier").alias("supplier"))
            .join(classes, "sku_id"))


def sku_details(df: DataFrame, freq: str) -> DataFrame:
    classes = abc_xyz(df, PERIODS_PER_YEAR[freq])
    return sku_state(df).join(classes, "sku_id").select(
        "sku_id", F.col("last_category").alias("category"), F.col("last_supplier").alias("supplier"),
        F.col("n_obs").alias("n_observations"), "date_min", "date_max", F.lit(freq).alias("frequency"), "last_demand",
        "mean_demand", F.round("cv_demand", 3).alias("cv_demand"), "abc_class", "xyz_class",
        F.round("revenue_annual", 2).alias("revenue_annual"), F.col("last_on_hand").alias("on_hand"),
        F.col("mean_cost").alias("unit_cost"), F.col("mean_price").alias("unit_price"), F.col("lt_mean").alias("lead_time_days"))


def aggregate_stats(df: DataFrame, freq: str) -> DataFrame:
    """Portfolio totals and class counts; one row."""
    s = sku_state(df)
    cover = F.when(F.col("mean_last8") > 0, F.col("last_on_hand") / F.col("mean_last8") * PERIOD_DAYS[freq])
    a = s.agg(F.count(F.lit(1)).alias("n_skus"),
              F.sum(F.coalesce("last_on_hand", F.lit(0.0)) * F.coalesce("last_unit_cost", F.lit(0.0))).alias("total_inventory_value"),
              F.round(F.avg(cover), 1).alias("avg_days_of_cover"), F.count_if(F.col("n_obs") < 13).alias("n_skus_low_history"))
    classes = abc_xyz(df, PERIODS_PER_YEAR[freq])
    b = classes.agg(F.round(F.sum("revenue_annual"), 2).alias("total_revenue_annual"),
                    *[F.count_if(F.col("abc_class") == c).alias(f"n_{c.lower()}") for c in "ABC"],
                    *[F.count_if(F.col("xyz_class") == c).alias(f"n_{c.lower()}") for c in "XYZ"])
    return side_by_side(a, b)


# ---- insight feed ----------------------------------------------------------------------

def _recent_cover(df: DataFrame, freq: str, days: int = 90) -> DataFrame:
    """Cover of each SKU against its mean demand over the last 90 days."""
    last = df.agg(F.max("date")).scalar()
    g = df.groupBy("sku_id").agg(F.max_by("on_hand", "date").alias("on_hand"), F.max_by("unit_price", "date").alias("unit_price"),
                                 F.avg(F.when(F.datediff(last, "date") < days, F.col("demand"))).alias("mean_d"))
    return g.where(F.col("on_hand").isNotNull() & (F.col("mean_d") > 0)).withColumn(
        "days_of_cover", F.col("on_hand") / F.col("mean_d") * PERIOD_DAYS[freq])


def _insight(one: DataFrame, id_, severity, title: Column, body: Column) -> DataFrame:
    id_ = F.lit(id_) if isinstance(id_, str) else id_
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return one.select(id_.alias("id"), severity.alias("severity"), title.alias("title"), body.alias("body"))


def insight_low_cover(df: DataFrame, freq: str, limit: float = 7.0) -> DataFrame:
    c = _recent_cover(df, freq).where(F.col("days_of_cover") < limit)
    first = c.orderBy(F.round("days_of_cover", 6), "sku_id").limit(3).agg(
        F.sort_array(F.collect_list(F.struct(F.round("days_of_cover", 6).alias("d"), "sku_id"))).alias("t"))
    one = side_by_side(c.agg(F.count(F.lit(1)).alias("n")), first.select(
        F.array_join(F.transform("t", lambda x: F.concat(x["sku_id"], F.format_string(" (%.1fd)", x["d"]))), ", ").alias("s")))
    return _insight(one.where(F.col("n") > 0), "low_cover", "crit",
                    F.concat(F.col("n").cast("string"), F.lit(" SKUs have <7 days of cover")),
                    F.concat(F.lit("Top: "), F.col("s")))


def insight_otif(rcp: DataFrame, sup: DataFrame, df: DataFrame, days: int = 120) -> DataFrame:
    """Worst recent supplier by on-time share times in-full share, below 75."""
    last = df.agg(F.max("date")).scalar()
    r = receipt_stats(rcp.where(F.datediff(last, "received_date") < days)).where(F.col("n_receipts") >= 3)
    r = r.withColumn("otif", F.col("on_time_pct") * F.col("in_full_pct") / 100)
    worst = r.where(F.col("otif") < 75).orderBy(F.round("otif", 6), "supplier_id").limit(1)
    j = worst.join(sup.select("supplier_id", "name"), "supplier_id", "left")
    return _insight(j, F.concat(F.lit("otif_"), F.col("supplier_id")), "warn",
                    F.concat(F.coalesce("name", "supplier_id"), F.lit(" OTIF dropped to "),
                             F.round("otif", 0).cast("long").cast("string"), F.lit("%")),
                    F.concat(F.col("n_receipts").cast("string"),
                             F.lit(" recent receipts. Consider dual-sourcing or expediting key SKUs.")))


def insight_expedite(df: DataFrame, freq: str) -> DataFrame:
    c = _recent_cover(df, freq)
    hit = (F.col("days_of_cover") < 14) & (F.col("mean_d") * F.coalesce("unit_price", F.lit(0.0)) > 50)
    one = c.agg(F.count_if(hit).alias("n")).where(F.col("n") > 0)
    return _insight(one, "expedite_candidates", F.when(F.col("n") < 5, "warn").otherwise("crit"),
                    F.concat(F.col("n").cast("string"), F.lit(" SKUs flagged for expediting")),
                    F.lit("Air-freight breakeven beats stockout cost on these high-revenue SKUs."))


def insight_upgrades(df: DataFrame) -> DataFrame:
    m = abc_migration(df)
    first = m.orderBy("sku_id").limit(3).agg(F.array_join(F.sort_array(F.collect_list(F.concat(
        "sku_id", F.lit(" ("), "abc_prior", F.lit("→"), "abc_recent", F.lit(")")))), ", ").alias("s"))
    one = side_by_side(m.agg(F.count(F.lit(1)).alias("n")), first)
    more = F.when(F.col("n") > 3, F.concat(F.lit(" + "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return _insight(one.where(F.col("n") > 0), "abc_upgrades", "info",
                    F.concat(F.col("n").cast("string"), F.lit(" SKUs migrated to higher class")),
                    F.concat(F.col("s"), more))


def insight_data(df: DataFrame) -> DataFrame:
    one = df.groupBy("sku_id").agg(F.count(F.lit(1)).alias("k"), F.min("date").alias("lo"), F.max("date").alias("hi")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return _insight(one, "data_summary", "info",
                    F.concat(F.col("n").cast("string"), F.lit(" SKUs · "),
                             F.floor(F.datediff("hi", "lo") / 30).cast("string"), F.lit("+ months of history")),
                    F.concat(F.lit("Latest data: "), F.date_format("hi", "yyyy-MM-dd"), F.lit(". "),
                             F.format_number("k", 0), F.lit(" observations.")))


def insights(df: DataFrame, sup: DataFrame, rcp: DataFrame, freq: str) -> DataFrame:
    return stack(insight_upgrades(df), insight_low_cover(df, freq), insight_otif(rcp, sup, df),
                 insight_expedite(df, freq), insight_data(df))


# ---- dashboard figures from the SKU table ------------------------------------------------

def portfolio_insights(t: DataFrame) -> DataFrame:
    """Flags and figures behind the portfolio notes; one row."""
    by_sup = t.where((F.col("status") == "at_risk") & F.col("supplier").isNotNull()).groupBy("supplier").agg(
        F.count(F.lit(1)).alias("k"))
    top = by_sup.agg(F.min(F.struct(-F.col("k"), F.col("supplier").alias("s"))).alias("m")).select(
        (-F.col("m.col1")).alias("dominant_n"), F.col("m.s").alias("dominant_supplier"))
    a, ok = F.col("abc_class") == "A", F.col("status") == "healthy"
    one = t.agg(F.count(F.lit(1)).alias("n_skus"), F.count_if(F.col("status") == "order_now").alias("n_order_now"),
                F.count_if((F.col("status") == "order_now") & a).alias("n_order_now_a"),
                F.count_if(F.col("status") == "at_risk").alias("n_at_risk"), F.count_if(a).alias("n_a"),
                F.count_if(a & ok).alias("n_a_healthy"), F.count_if(F.col("xyz_class") == "Z").alias("n_z"))
    j = side_by_side(one, top)
    pct = F.when(F.col("n_a") > 0, F.col("n_a_healthy") / F.col("n_a") * 100)
    return j.withColumns({
        "a_health": F.when(pct >= 80, "good").when(pct < 60, "warn"),
        "supplier_named": F.coalesce(F.col("dominant_n") >= 2, F.lit(False)),
        "many_variable": F.col("n_z") / F.col("n_skus") > 0.3})


def supplier_insights(cards: DataFrame) -> DataFrame:
    """Most variable, slowest and dominant supplier notes from the scorecards."""
    rev = F.col("annual_revenue")
    total = cards.agg(F.sum("annual_revenue")).scalar()
    std = F.round("lead_time_std_days", 6)
    var = (cards.where(std.isNotNull() & F.col("avg_lead_time_days").isNotNull()).orderBy(F.desc(std), "name").limit(1)
           .where(std > 0).select(F.lit("lead_time_variance").alias("kind"), "name", F.round(std, 1).alias("figure"),
                                  F.round("avg_lead_time_days", 1).alias("second")))
    low = (cards.where(F.col("otif_pct").isNotNull() & (rev > 0)).orderBy(F.round("otif_pct", 6), "name").limit(1)
           .where(F.col("otif_pct") < 90).select(
        F.lit("slow_otif").alias("kind"), "name", F.round("otif_pct", 0).alias("figure"), F.round(rev / total * 100, 0).alias("second")))
    dom = (cards.orderBy(F.desc(F.round(rev, 2)), "name").limit(1).where(rev / total * 100 > 35)
           .select(F.lit("dominant").alias("kind"), "name", F.round(rev / total * 100, 0).alias("figure"),
                   F.lit(None).cast("double").alias("second")))
    return stack(var, low, dom)


def panel_summary(t: DataFrame) -> DataFrame:
    return t.agg(F.count(F.lit(1)).alias("n_skus"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
                 *[F.count_if(F.col("abc_class") == c).alias(f"abc_{c.lower()}") for c in "ABC"],
                 *[F.count_if(F.col("xyz_class") == c).alias(f"xyz_{c.lower()}") for c in "XYZ"],
                 F.round(F.sum("revenue_annual"), 0).alias("total_revenue_annual"),
                 F.round(F.sum("on_hand"), 0).alias("total_on_hand_units"))


def top_groups(t: DataFrame, k: int = 5) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("name")) for c in ("category", "supplier")])
    g = t.select(F.inline(pairs)).where(F.col("name") != "").groupBy("dim", "name").agg(F.count(F.lit(1)).alias("n_skus"))
    w = W.partitionBy("dim").orderBy(F.desc("n_skus"), "name")
    return g.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= k)


def supplier_summary(cards: DataFrame, k: int = 12) -> DataFrame:
    return (cards.orderBy(F.desc(F.round("annual_revenue", 2)), "name").limit(k)
            .select("name", "country", "n_skus", F.round("annual_revenue", 0).alias("annual_revenue"), "otif_pct", "payment_terms"))


def action_queue(t: DataFrame, k: int = 8) -> DataFrame:
    """First rows by cover of the two urgent statuses."""
    w = W.partitionBy("status").orderBy(F.coalesce("days_of_cover", F.lit(float("inf"))), "sku_id")
    return (t.where(F.col("status").isin("order_now", "at_risk")).withColumn("pos", F.row_number().over(w).cast("long"))
            .where(F.col("pos") <= k).select("status", "pos", "sku_id", "days_of_cover"))


def header_tiles(t: DataFrame) -> DataFrame:
    """Urgent counts, stock and the A-class median variability (upper middle element).

    The median is the smallest value with more than half of the A rows at or below it,
    found on counted values."""
    from ..functions.ordering import running_total
    a = t.where(F.col("abc_class") == "A")
    counted = a.groupBy("cv_demand").agg(F.count(F.lit(1)).cast("double").alias("k"))
    placed = running_total(counted, [F.asc("cv_demand")], F.col("k"), "upto")
    total = placed.agg(F.sum("k")).scalar()
    med = placed.where(F.col("upto") > F.floor(total / 2)).agg(F.min("cv_demand").alias("a_median_cv"))
    one = t.agg(F.count_if(F.col("status") == "order_now").alias("n_order_now"),
                F.count_if(F.col("status") == "at_risk").alias("n_at_risk"),
                F.sum("on_hand").alias("total_on_hand"), F.count("on_hand").alias("n_reporting"))
    return side_by_side(one, med)

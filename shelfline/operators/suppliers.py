"""Supplier derivation, scorecards, lead-time learning, joint replenishment and
working capital."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordering import running_totals
from ..functions.rows import side_by_side
from ..schema import PERIODS_PER_YEAR
from ..session import materialise
from .inventory import sku_state, supplier_id

# fixed values: pools a derived supplier's terms are drawn from
MOQ_POOL = (12.0, 24.0, 50.0, 100.0, 144.0, 288.0, 500.0)
PACK_POOL = (1.0, 6.0, 12.0, 24.0, 48.0)
TERMS_POOL = ("Net 30", "Net 30", "Net 30", "Net 45", "Net 60")
COUNTRY_POOL = ("USA", "USA", "USA", "Canada", "Mexico", "China", "Vietnam")
PRIOR_STRENGTH = 4.0


def derive_suppliers(df: DataFrame) -> DataFrame:
    """A supplier table from panel rows: lead-time moments plus stable pooled terms."""
    name = F.col("supplier")
    lt = F.col("lead_time_days")
    g = df.where(name.isNotNull() & (F.trim(name) != "")).groupBy(name.alias("name")).agg(
        F.count(lt).alias("_n"), F.coalesce(F.avg(lt), F.lit(14.0)).alias("_m"), F.stddev_pop(lt).alias("_s"))
    h = F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("long")
    pick = lambda pool, i: F.element_at(F.array(*[F.lit(x) for x in pool]), (i % len(pool) + 1).cast("int"))
    slug = F.substring(F.regexp_replace(F.lower("name"), "[^\\p{L}\\p{N}_-]", ""), 1, 18)
    std = F.when(F.col("_n") > 1, F.col("_s")).otherwise(F.greatest(F.col("_m") * 0.2, F.lit(0.5)))
    return g.select(
        supplier_id(F.col("name")).alias("supplier_id"), "name",
        F.concat(F.lit("orders@"), F.when(slug == "", "vendor").otherwise(slug), F.lit(".example.com")).alias("contact_email"),
        pick(COUNTRY_POOL, F.floor(h / 13)).alias("country"), pick(TERMS_POOL, h).alias("payment_terms"),
        F.round("_m", 2).alias("default_lead_time_days"), F.round(std, 2).alias("lead_time_std_days"),
        pick(MOQ_POOL, h).alias("moq"), pick(PACK_POOL, F.floor(h / 7)).alias("case_pack"), F.lit("").alias("notes"))


def terms_days(terms: Column) -> Column:
    """Days behind 'net' (first three digits), else any digits, else 30."""
    t = F.lower(terms)
    digits = lambda c: F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 3)
    tail = F.when(F.instr(t, "net") > 0, digits(F.regexp_replace(t, "^.*?net", "")))
    pick = F.when(tail != "", tail).when(digits(t) != "", digits(t)).otherwise("30")
    return F.coalesce(pick, F.lit("30")).cast("int")


def posterior_columns(prior_mean: Column, prior_std: Column, n: Column, mean: Column, var: Column):
    """Normal-approximation update of a lead-time prior worth four observations."""
    std0 = F.when(prior_std <= 0, F.greatest(prior_mean * 0.2, F.lit(0.5))).otherwise(prior_std)
    v0 = std0 * std0
    v1 = F.greatest(F.when(n > 1, var).otherwise(v0), F.lit(1e-6))
    w0, w1 = F.lit(PRIOR_STRENGTH) / v0, n / v1
    seen = F.coalesce(n, F.lit(0)) > 0
    return (F.when(seen, (w0 * prior_mean + w1 * mean) / (w0 + w1)).otherwise(prior_mean),
            F.when(seen, F.sqrt(F.lit(1.0) / (w0 + w1))).otherwise(std0))


def receipt_stats(rcp: DataFrame) -> DataFrame:
    """Receipt aggregates per supplier, summed before the exchange."""
    days = F.datediff("received_date", "ordered_date").cast("double")
    on_time = F.coalesce(F.col("received_date") <= F.col("expected_date"), F.lit(False))
    in_full = F.coalesce(F.col("received_qty") >= F.col("ordered_qty") * 0.99, F.lit(False))
    pct = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return rcp.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("n_receipts"), F.count(days).alias("lt_n"), F.avg(days).alias("avg_lead_time_days"),
        F.stddev_pop(days).alias("lead_time_std"), F.var_pop(days).alias("lt_var"),
        pct(on_time).alias("on_time_pct"), pct(in_full).alias("in_full_pct"), pct(on_time & in_full).alias("otif_pct"))


def lead_time_posterior(sup: DataFrame, rcp: DataFrame) -> DataFrame:
    j = sup.select("supplier_id", "default_lead_time_days", "lead_time_std_days").join(
        receipt_stats(rcp), "supplier_id", "left")
    m, s = posterior_columns(
        F.coalesce(F.when(F.col("default_lead_time_days") != 0, F.col("default_lead_time_days")), F.lit(14.0)),
        F.coalesce(F.when(F.col("lead_time_std_days") != 0, F.col("lead_time_std_days")), F.lit(2.0)),
        F.col("lt_n"), F.col("avg_lead_time_days"), F.col("lt_var"))
    return j.select("supplier_id", F.coalesce("lt_n", F.lit(0)).alias("n_observed"),
                    m.alias("posterior_mean"), s.alias("posterior_std"))


def supplier_scorecards(sup: DataFrame, rcp: DataFrame, df: DataFrame) -> DataFrame:
    """Scorecard per supplier.  The panel is reduced to (supplier, sku) first, so the
    distinct count does not repeat the rows of a large supplier."""
    pairs = df.where(F.col("supplier").isNotNull()).groupBy("supplier", "sku_id").agg(
        F.sum(F.col("demand") * F.col("unit_price")).alias("rev"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    sales = pairs.groupBy("supplier").agg(
        F.count(F.lit(1)).alias("n_skus"), F.coalesce(F.sum("rev"), F.lit(0.0)).alias("rev"),
        F.greatest(F.lit(1), F.datediff(F.max("hi"), F.min("lo"))).alias("span"))
    post = lead_time_posterior(sup, rcp).where(F.col("n_observed") > 0)
    j = (sup.join(sales, sup["name"] == sales["supplier"], "left")
         .join(receipt_stats(rcp), "supplier_id", "left").join(post, "supplier_id", "left"))
    return j.select(
        "supplier_id", "name", F.coalesce("n_skus", F.lit(0)).alias("n_skus"),
        F.coalesce(F.col("rev") * 365.0 / F.col("span"), F.lit(0.0)).alias("annual_revenue"),
        "avg_lead_time_days", F.when(F.col("lt_n") > 1, F.col("lead_time_std")).when(F.col("lt_n") == 1, 0.0)
        .alias("lead_time_std_days"),
        F.col("posterior_mean").alias("leadtime_posterior_mean"), F.col("posterior_std").alias("leadtime_posterior_std"),
        "on_time_pct", "in_full_pct", "otif_pct", F.coalesce("n_receipts", F.lit(0)).alias("n_receipts"),
        "payment_terms", "moq", "case_pack", "country", "contact_email")


def supplier_detail(sup: DataFrame, rcp: DataFrame, df: DataFrame, supplier: str) -> DataFrame:
    """Attributes, SKU count and posterior of one supplier (its receipts are
    `supplier_receipts`, its lead times `lead_time_counts`)."""
    one = sup.where(F.col("supplier_id") == supplier)
    name = one.select("name").scalar()
    skus = df.where(F.col("supplier") == name).select("sku_id").distinct().agg(F.count(F.lit(1)))
    post = lead_time_posterior(one, rcp.where(F.col("supplier_id") == supplier))
    return (one.join(post, "supplier_id").withColumn("n_skus", skus.scalar()))


def supplier_receipts(rcp: DataFrame, supplier: str) -> DataFrame:
    return rcp.where(F.col("supplier_id") == supplier).withColumn(
        "lead_time_days", F.datediff("received_date", "ordered_date").cast("long"))


def lead_time_counts(rcp: DataFrame) -> DataFrame:
    """Observed lead times per supplier, equal ones counted."""
    days = F.datediff("received_date", "ordered_date").cast("long")
    return (rcp.groupBy("supplier_id", days.alias("lead_time_days")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("lead_time_days").isNotNull()))


def lead_time_histogram(sup: DataFrame, rcp: DataFrame) -> DataFrame:
    """Equal-width bins per supplier over the observed lead times and both means."""
    counts = lead_time_counts(rcp)
    post = lead_time_posterior(sup, rcp)
    prior = sup.select("supplier_id", F.col("default_lead_time_days").alias("_prior"))
    span = counts.groupBy("supplier_id").agg(F.sum("n").alias("_n"), F.min("lead_time_days").alias("_a"),
                                             F.max("lead_time_days").alias("_b"))
    e = span.join(prior, "supplier_id").join(post.select("supplier_id", "posterior_mean"), "supplier_id")
    lo = F.greatest(F.lit(0.0), F.floor(F.least("_a", "_prior", "posterior_mean") - 2).cast("double"))
    hi = F.ceil(F.greatest("_b", "_prior", "posterior_mean") + 2).cast("double")
    half = F.floor(F.col("_n") / 2)
    bins = F.least(F.lit(20), F.greatest(F.lit(6), F.when(half == 0, 6).otherwise(half)))
    e = e.select("supplier_id", lo.alias("lo"), F.when(hi == lo, 1.0).otherwise(hi - lo).alias("range"), bins.alias("bins"))
    b = F.floor((F.col("lead_time_days") - F.col("lo")) / (F.col("range") / F.col("bins")))
    b = F.greatest(F.lit(0), F.least(F.col("bins") - 1, b))
    return (counts.join(e, "supplier_id").groupBy("supplier_id", b.cast("long").alias("bin"))
            .agg(F.min("lo").alias("lo"), F.min(F.col("range") / F.col("bins")).alias("width"), F.sum("n").alias("n")))


# ---- working capital ---------------------------------------------------------------

def _sku_value(df: DataFrame) -> DataFrame:
    """Stock value per SKU from its last row and cost of goods over its history."""
    cost = F.coalesce("unit_cost", F.lit(0.0))
    return df.groupBy("sku_id").agg(
        F.max_by(F.coalesce("on_hand", F.lit(0.0)) * cost, "date").alias("value"),
        F.sum(F.col("demand") * cost).alias("cogs"), F.max_by("supplier", "date").alias("supplier"))


def working_capital(df: DataFrame, sup: DataFrame, freq: str) -> DataFrame:
    """Inventory value, annual cost of goods, DIO, DPO, cash-to-cash; one row."""
    dates = df.select("date").distinct().agg(F.greatest(F.lit(1), F.count(F.lit(1)))).scalar()
    v = _sku_value(df)
    p = payables_by_supplier(v, sup)
    tot = v.agg(F.sum("value").alias("inv"), F.sum("cogs").alias("_c"))
    pay = p.agg(F.sum("payable").alias("payable"), F.sum(F.col("terms") * F.col("value")).alias("_w"),
                F.sum("value").alias("_v"))
    j = side_by_side(tot, pay).withColumn("_y", F.col("_c") * PERIODS_PER_YEAR[freq] / dates)
    cogs = F.when((F.col("_y") <= 0) & (F.col("inv") > 0), F.col("inv") * 4).otherwise(F.col("_y"))
    j = j.withColumn("cogs", cogs).withColumns({
        "dio_days": F.when(F.col("cogs") > 0, F.round(F.col("inv") / F.col("cogs") * 365, 1)),
        "dpo_days": F.when(F.col("_v") > 0, F.round(F.col("_w") / F.col("_v"), 1))})
    return j.select(F.round("inv", 2).alias("inventory_value"), F.round("cogs", 2).alias("annual_cogs"),
                    "dio_days", "dpo_days", F.round(F.col("dio_days") - F.col("dpo_days"), 1).alias("cash_to_cash_days"),
                    F.round("payable", 2).alias("payable_outstanding"))


def payables_by_supplier(values: DataFrame, sup: DataFrame) -> DataFrame:
    g = values.where(F.col("supplier").isNotNull()).groupBy("supplier").agg(F.sum("value").alias("value"))
    s = sup.select(F.col("name").alias("supplier"), "supplier_id", terms_days(F.col("payment_terms")).alias("_t"))
    j = g.join(s, "supplier", "left").withColumn("terms", F.coalesce("_t", F.lit(30)))
    return j.select(F.coalesce("supplier_id", "supplier").alias("supplier_id"), F.col("supplier").alias("supplier_name"),
                    "value", "terms", (F.col("value") * (F.col("terms") / 30.0) / 12).alias("payable"))


def payables(df: DataFrame, sup: DataFrame, k: int = 20) -> DataFrame:
    p = payables_by_supplier(_sku_value(df), sup)
    return p.select("supplier_id", "supplier_name", F.round("value", 2).alias("inventory_value"),
                    F.col("terms").alias("payment_terms_days"), F.round("payable", 2).alias("payable_outstanding")
                    ).orderBy(F.desc("inventory_value"), "supplier_name").limit(k)


# ---- joint replenishment --------------------------------------------------------------

def replen_cycles(df: DataFrame, factor: float, order_cost: float = 50.0, holding_rate: float = 0.25) -> DataFrame:
    """EOQ and cycle length of each SKU with demand and a supplier."""
    g = df.groupBy("sku_id").agg(
        F.min(F.when(F.col("supplier").isNotNull(), F.struct("date", "supplier"))).getField("supplier").alias("supplier"),
        F.avg("demand").alias("_d"), F.avg("unit_cost").alias("_c"))
    cost = F.greatest(F.lit(0.5), F.coalesce("_c", F.lit(1.0)))
    g = g.where(F.col("supplier").isNotNull()).select(
        "sku_id", "supplier", F.greatest(F.lit(0.0), F.coalesce("_d", F.lit(0.0)) * factor).alias("annual_demand"),
        F.greatest(F.lit(0.5), holding_rate * cost).alias("holding_per_unit"))
    g = g.where(F.col("annual_demand") > 0).withColumn(
        "eoq", F.sqrt(2.0 * F.col("annual_demand") * order_cost / F.col("holding_per_unit")))
    return g.withColumn("cycle_days", F.col("eoq") / F.col("annual_demand") * 365.0)


def cluster_cycles(cycles: DataFrame, tol: float = 0.20) -> DataFrame:
    """Greedy clusters of ascending cycles: a cycle joins the open cluster while it is
    within `tol` of the cluster's running mean.

    Cut in rounds over running sums that restart at each supplier: with the sums, whether row j still belongs to the cluster
    opened at row i is a test on row j alone, so a round finds the first row outside for every supplier at once.  A new
    cluster starts above (1 + tol) times the mean of the last, so rounds grow with the logarithm of the ratio of longest to
    shortest cycle, not with the number of SKUs, and rows before a supplier's last cut drop out of later rounds.
    """
    order = [F.asc("supplier"), F.asc("cycle_days"), F.asc("sku_id")]
    rows = materialise(running_totals(cycles, order, {"_pos": F.lit(1.0), "_cum": F.col("cycle_days")}, by=["supplier"]))
    before = F.col("_cum") - F.col("cycle_days")
    state = starts = rows.select("supplier").distinct().select("supplier", F.lit(1.0).alias("_at"), F.lit(0.0).alias("_base"))
    while True:
        j = rows.join(state, "supplier").where(F.col("_pos") > F.col("_at"))
        mean = (before - F.col("_base")) / (F.col("_pos") - F.col("_at"))
        out = j.where(F.abs(F.col("cycle_days") - mean) / mean > tol)
        state = materialise(out.groupBy("supplier").agg(F.min(F.struct("_pos", before.alias("_b"))).alias("m"))
                            .select("supplier", F.col("m._pos").alias("_at"), F.col("m._b").alias("_base")))
        if state.isEmpty():
            break
        starts = starts.unionByName(state)
    # the cuts of a supplier are few: one array per supplier, searched per row
    cuts = starts.groupBy("supplier").agg(F.sort_array(F.collect_list("_at")).alias("_cuts"))
    inside = F.size(F.filter("_cuts", lambda c: c <= F.col("_pos"))) - 1
    return rows.join(cuts, "supplier").withColumn("cluster", inside.cast("long")).drop("_pos", "_cum", "_cuts")


def joint_replenishment(clustered: DataFrame, order_cost: float = 50.0, min_size: int = 2) -> DataFrame:
    """Pooled cadence and yearly saving of every cluster with at least two SKUs."""
    g = clustered.groupBy("supplier", "cluster").agg(
        F.count(F.lit(1)).alias("n_members"), F.avg("cycle_days").alias("cadence_days"),
        F.sum(365.0 / F.col("cycle_days")).alias("annual_orders_individual"))
    g = g.where(F.col("n_members") >= min_size).withColumn("annual_orders_pooled", 365.0 / F.col("cadence_days"))
    return g.select(
        "supplier", F.concat("supplier", F.lit("-cluster-"), F.col("cluster").cast("string")).alias("group_id"),
        "n_members", "cadence_days", "annual_orders_pooled", "annual_orders_individual",
        F.greatest(F.lit(0.0), (F.col("annual_orders_individual") - F.col("annual_orders_pooled")) * order_cost)
        .alias("annual_savings_usd"))


def group_of_sku(clustered: DataFrame, groups: DataFrame) -> DataFrame:
    """(sku_id, group_id) of the SKUs that belong to a pooled group."""
    tag = F.concat("supplier", F.lit("-cluster-"), F.col("cluster").cast("string"))
    return clustered.select("sku_id", tag.alias("group_id")).join(groups.select("group_id"), "group_id", "left_semi")


def savings_total(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("annual_savings_usd").alias("annual_savings_usd"))

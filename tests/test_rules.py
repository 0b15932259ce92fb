"""Hand-made frames with known answers."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from shelfline.functions import stats
from shelfline.functions.ordering import exact_quantiles, row_numbers, running_total
from shelfline.operators import (adhoc, anomalies, checks, evaluation as ev, forecast as fo, inventory as inv, outlook as ol,
                                 policies as po, profile, purchasing as pu, quality, series, skus, suppliers as su)
from shelfline.sources import derived, exports


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_normal_functions(spark):
    r = one(spark.range(1).select(stats.norm_cdf(F.lit(1.6448536)).alias("c"), stats.norm_ppf(F.lit(0.95)).alias("q"),
                                  stats.norm_cdf(F.lit(-3.0)).alias("t")))
    assert abs(r.c - 0.95) < 1e-6 and abs(r.q - 1.6448536) < 1e-6 and abs(r.t - 0.0013499) < 1e-6


@pytest.mark.parametrize("hot", [False, True])
def test_distributed_order_statistics(spark, hot):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=3000).round(3)
    if hot:
        vals[:1200] = 0.5            # a value with more than a third of the rows
    grp = np.where(np.arange(3000) < 2000, "a", "b")
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(grp, vals)], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, "v", {"q10": 0.1, "q50": 0.5, "q95": 0.95}, by=("g",)).collect()}
    for g in "ab":
        want = np.quantile(vals[grp == g], [0.1, 0.5, 0.95])
        assert np.allclose([got[g].q10, got[g].q50, got[g].q95], want)
    run = running_total(df, [F.desc("v"), F.asc("g")], F.col("v"), "cum").agg(F.max("cum"), F.sum("v")).head()
    assert np.isclose(run[0], np.cumsum(np.sort(vals)[::-1]).max())
    ids = [r.rn for r in row_numbers(df.select("v").distinct(), [F.asc("v")]).orderBy("v").collect()]
    assert ids == list(range(1, len(ids) + 1))


def test_eoq_and_newsvendor(spark):
    e = one(po.eoq(spark.createDataFrame([("A", 1200.0, 10.0, 1.0)], "sku_id string, annual_demand double, order_cost double, holding_cost double")))
    assert abs(e.q - 154.919) < 1e-3
    lattice = "sku_id string, p array<double>, width double, ltd_mean double, {} double"
    n = one(po.newsvendor(spark.createDataFrame([("A", [0.0, 0.25, 0.25, 0.25, 0.25], 10.0, 100.0, 1.0)], "sku_id string, p array<double>, width double, underage double, overage double")))
    assert n.q == 40 and abs(n.critical_ratio - 100 / 101) < 1e-12 and n.underage_cost == 0 and abs(n.overage_cost - 15) < 1e-9
    b = one(po.base_stock(spark.createDataFrame([("A", [1 / 101] * 101, 1.0, 50.0, 0.95)], lattice.format("service_level"))))
    assert b.s_level == 95 and b.safety_stock == 45 and abs(b.stockout_prob - 5 / 101) < 1e-9


def test_patterns(panel_of):
    got = {r.sku_id: r.pattern for r in series.characterize(panel_of({
        "NEW": [1] * 5, "LUMPY": [0] * 50 + [10] * 5, "HALF": [0, 5] * 20, "SMOOTH": [50 + (i * 7919 % 13 - 6) / 6 for i in range(40)]}), "W").collect()}
    assert got["NEW"] == "trending_new" and got["LUMPY"] == "lumpy" and got["HALF"] == "intermittent"
    season = series.characterize(panel_of({"S": [10, 20, 30, 40, 30, 20, 10] * 20}, step=1), "D").head()
    assert season.pattern == "seasonal"


def test_business_checks(panel_of):
    spikes = [10 + i % 3 for i in range(120)]
    spikes[100:105] = [1000] * 5
    assert one(checks.check_spikes(panel_of({"A": spikes}), 30)).offending_row_count == 5
    neg = one(checks.check_negative(panel_of({"A": [1, -5, 2]})))
    assert (neg.code, neg.offending_row_count, neg.skus_affected) == ("NEGATIVE_DEMAND", 1, 1)
    lt = one(checks.check_lead_time(panel_of({"A": [1] * 8}, lead_time_days=lambda s, i, n: 9999.0 if i < 5 else 7.0)))
    assert lt.offending_row_count == 5
    gap = panel_of({"A": [1] * 50}).unionByName(panel_of({"A": [1] * 50}, start=dt.date(2024, 1, 1) + dt.timedelta(weeks=60)))
    assert one(checks.check_gaps(gap)).code == "DATE_GAPS_IN_ACTIVE_WINDOW"
    dup = panel_of({"A": [1, 2]}).unionByName(panel_of({"a ": [1]}))
    assert one(checks.check_duplicates(dup)).offending_row_count == 2
    low = {r.sku_id for r in quality.low_history(panel_of({"X": [1, 1], "Y": [1], "Z": [1] * 20})).collect()}
    assert low == {"X", "Y"}


def test_regime_break_lowers_score(panel_of):
    r = one(quality.stationarity_flags(panel_of({"A": [10 + i % 2 for i in range(53)] + [1000] * 4}), "W"))
    assert r.shift_z > 2 and r.score < 100


def test_metrics_and_conformal(spark):
    bt = spark.createDataFrame([("A", 0.0, 5.0), ("A", 10.0, 11.0)], "sku_id string, actual double, point double")
    assert abs(bt.agg(ev.mape().alias("m")).head().m - 10) < 1e-9
    res = spark.createDataFrame([("A", 0, i, float(i)) for i in range(1, 6)], "sku_id string, fold int, step int, residual double")
    assert 4 <= one(ev.conformal_width(res)).half_80 <= 5
    w = {r.method: r.weight for r in ev.crps_weights(spark.createDataFrame([("A", "a", 2.0), ("A", "b", 4.0)], "sku_id string, method string, crps double")).collect()}
    assert abs(w["a"] - 2 / 3) < 1e-9
    e = [r.weight for r in ev.crps_weights(spark.createDataFrame([("A", "a", None), ("A", "b", None)], "sku_id string, method string, crps double")).collect()]
    assert e == [0.5, 0.5]


def test_posterior(panel_of, spark):
    prior = spark.createDataFrame([("A", 2.0, 1.0), ("B", 1000.0, 10.0)], "sku_id string, alpha double, beta double")
    got = {r.sku_id: r for r in fo.posterior(panel_of({"A": [5, 10, 8], "B": [1, 2]}), prior).collect()}
    assert (got["A"].alpha_post, got["A"].beta_post) == (25, 4) and abs(got["B"].mean - 83.583) < 1e-3
    q = fo.negbin_quantiles(fo.posterior(panel_of({"A": [5, 10, 8]}), prior)).head()
    assert q.q025 <= q.q10 <= q.q50 <= q.q90 <= q.q975


def test_forecasts_are_ordered_and_not_negative(panel_of):
    p = panel_of({"S": [50 + i % 5 for i in range(60)], "I": [0, 0, 5] * 20, "L": [0] * 50 + [9] * 6, "T": [3] * 10, "R": [1] * 3})
    out = ol.forecast_all(p, 4, "W")
    rows = out["forecasts"].collect()
    assert {r.sku_id for r in rows} == {"S", "I", "L", "T"} and len(rows) == 16
    for r in rows:
        assert 0 <= r.q025 <= r.q50 + 1e-9 <= r.q975 + 2e-9
    s = {r.sku_id: r for r in out["summary"].collect()}
    assert s["R"].status == "refused" and s["T"].method == "negbin_bayes" and s["I"].pattern == "intermittent"


def test_ets_follows_a_season_and_a_level():
    t = np.arange(48)
    y = np.stack([100 + 20 * np.sin(2 * np.pi * t / 12), np.full(48, 7.0)])
    point, _ = fo._ets_block(y, 12, 12)
    assert np.abs(point[0] - (100 + 20 * np.sin(2 * np.pi * np.arange(48, 60) / 12))).max() < 5
    assert np.allclose(point[1], 7.0)


def test_schedules(spark):
    base = [("A", [10.0] * 20, 80.0, 14.0, dt.date(2024, 1, 1), 50.0, 30.0)]
    qr = po.schedule(spark.createDataFrame(base, "sku_id string, point array<double>, on_hand double, lead_time_days double, start_date date, q double, r double"), "QR", "W").collect()
    kinds = [r.action for r in qr]
    assert "order" in kinds and "delivery" in kinds and all(r.qty == 50 for r in qr if r.action == "order")
    ss = po.schedule(spark.createDataFrame([("A", [10.0] * 12, 20.0, 14.0, dt.date(2024, 1, 1), 15.0, 80.0, 4)], "sku_id string, point array<double>, on_hand double, lead_time_days double, start_date date, s double, big_s double, review_periods int"), "sS", "W").collect()
    assert all(r.period_idx % 4 == 0 for r in ss if r.action == "order")


def test_status_edges(spark):
    df = spark.createDataFrame([(5.0, 7.0), (8.0, 7.0), (12.0, 7.0), (30.0, 7.0), (10.0, None)], "cover double, lt double")
    got = [r.s for r in df.select(skus.status_of(F.lit(1.0), F.col("cover"), F.col("lt")).alias("s")).collect()]
    assert got == ["order_now", "at_risk", "watch", "healthy", "order_now"]


def test_stress_survives_missing_window(panel_of):
    p = panel_of({"A": [5, 6, 7, 8] + [None] * 13, "B": [5] * 20}, on_hand=10.0)
    sup = su.derive_suppliers(p)
    for level in (0.0, 1.0, None):
        r = one(inv.stress_test(p, sup, "W", 1.5, 1.2, level))
        assert math.isfinite(r.shock_total_revenue_at_risk) and math.isfinite(r.var_95) and r.var_95 > 0


def greedy_clusters(cycles, tol=0.2):
    out, c, total, k = [], -1, 0.0, 0
    for x in cycles:
        if k and abs(x - total / k) / (total / k) <= tol:
            total, k = total + x, k + 1
        else:
            c, total, k = c + 1, x, 1
        out.append(c)
    return out


def test_clusters_of_one_large_supplier(spark):
    rng = np.random.default_rng(5)
    cycles = np.sort(np.exp(rng.uniform(0, 4, 200_000)).round(6))
    rows = [("big", f"k{i:06d}", float(x)) for i, x in enumerate(cycles)] + [("small", f"m{i}", float(x)) for i, x in enumerate((1.0, 1.1, 5.0))]
    got = {r.sku_id: r.cluster for r in su.cluster_cycles(spark.createDataFrame(rows, "supplier string, sku_id string, cycle_days double")).collect()}
    assert [got[f"k{i:06d}"] for i in range(len(cycles))] == greedy_clusters(cycles) and [got[f"m{i}"] for i in range(3)] == [0, 0, 1]


def test_plan_rounds(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(0, 100, 300).round(2), rng.uniform(1, 500, 300).round(2)))]
    q = spark.createDataFrame(rows, "sku_id string, score double, total_cost double")
    for budget, n in ((800.0, 25), (50.0, 25), (1e6, 25), (800.0, 3), (0.5, 5)):
        order = sorted(rows, key=lambda r: (-round(r[1] / max(1.0, r[2]), 9), -round(r[1], 4), r[0]))
        left, k, want = budget, 0, {}
        for sku, _, cost in order:
            want[sku] = "top_n_cap_reached" if k >= n else "budget_exceeded" if cost > left else None
            if want[sku] is None:
                left, k = left - cost, k + 1
        assert {r.sku_id: r.reason for r in inv.plan_week(q, budget, n).collect()} == want


def test_order_rollup(spark):
    rows = [("A", "2", "2026-01-01 10:00:00 +0000", "paid", "10"), ("A", "3", "2026-01-01 12:00:00 +0000", "paid", "10"),
            ("B", "1", "2026-01-01 10:00:00 +0000", "paid", "10"), ("B", "9", "2026-01-01 10:00:00 +0000", "Cancelled", "10"),
            (" ", "1", "2026-01-01 10:00:00 +0000", "paid", "5"), ("C", "-2", "2026-01-01 10:00:00 +0000", "paid", "5"),
            ("P", "1", "2026-01-02 10:00:00 +0000", "paid", "10"), ("P", "3", "2026-01-02 10:00:00 +0000", "paid", "20")]
    df = spark.createDataFrame(rows, "`Lineitem sku` string, `Lineitem quantity` string, `Created at` string, `Financial Status` string, `Lineitem price` string")
    got = {r.sku_id: r for r in exports.orders_to_panel(df).collect()}
    assert got["A"].demand == 5 and got["B"].demand == 1 and set(got) == {"A", "B", "P"} and got["P"].unit_price == 17.5


def test_mapping(spark):
    names = ["Item ID", "Day", "Units Sold", "Stock On Hand", "LT (days)", "Cost", "Sell Price", "Vendor", "Department"]
    h = spark.createDataFrame([("f", n, "string") for n in names], "file_id string, header string, dtype string")
    got = {r.canonical: r.header for r in profile.suggest_mapping(profile.score_headers(h)).collect()}
    assert got == dict(zip(["sku_id", "date", "demand", "on_hand", "lead_time_days", "unit_cost", "unit_price", "supplier", "category"], names))


def test_partitions_of_a_dense_panel(spark):
    """The grid's partitions go by its rows, not by the sparse rows it is made from; its rows stay the same."""
    cell = spark.createDataFrame([(f"s{i % 40}", dt.date(2024, 1 + i % 12, 1), float(i)) for i in range(0, 400, 7)], "sku_id string, date date, demand double")
    plain, wide = derived.fill_gaps(cell, derived.MONTH), derived.fill_gaps(cell, derived.MONTH, rows=30 * derived.TASK_ROWS)
    assert plain.rdd.getNumPartitions() < 30 <= wide.rdd.getNumPartitions()
    assert sorted(map(str, plain.collect())) == sorted(map(str, wide.collect())) and wide.count() == 40 * 12


def test_forecasts_from_stored_series(spark, panel_of):
    """A forecaster takes the series as well as the panel, so that several methods share one."""
    p = panel_of({"A": [1, 0, 3, 4] * 6, "B": [0, 2, None] * 8})
    for run in (lambda d: fo.forecast_snaive(d, 3, "M"), lambda d: fo.forecast_croston(d, 3), lambda d: fo.forecast_tsb(d, 3)):
        assert sorted(map(str, run(fo.to_series(p).select("sku_id", "y", "n")).collect())) == sorted(map(str, run(p).collect()))


def test_hierarchy_keeps_sku_rows_in_place(spark, panel_of):
    p = panel_of({"A": [1, 2], "B": [3, None], "C": [5, 6]}, category=lambda sku, i, n: "x" if sku < "C" else None)
    got = {(r.unique_id, r.ds.day): r.y for r in ol.build_hierarchy(p).collect()}
    assert got == {("TOTAL", 1): 9, ("TOTAL", 8): 8, ("x", 1): 4, ("x", 8): 2, ("UNKNOWN", 1): 5, ("UNKNOWN", 8): 6,
                   ("x/A", 1): 1, ("x/A", 8): 2, ("x/B", 1): 3, ("x/B", 8): None, ("UNKNOWN/C", 1): 5, ("UNKNOWN/C", 8): 6}
    plan = ol.build_hierarchy(p.repartition(4, "sku_id"))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "hashpartitioning(" in x]
    assert any("date" in x for x in moved) and not any("date" in x and "sku_id" in x for x in moved)


def test_best_scores_of_a_file(spark):
    """The rows kept for a mapping are the highest of every file and field, with the scores of the plain form."""
    rng = np.random.default_rng(5)
    words = ["", "-", "a", "e", "id", "ID!", "sku", "Unit Price", "price_list", "stockonhand2", "İnventory", "Größe", "qty", "weeks", "supply", "lead time (days)", "x" * 300]
    words += ["".join(rng.choice(list("abdeiklmnoqrstuvy 3_"), rng.integers(1, 14))) for _ in range(400)]
    rows = [(f, str(w), k) for f in ("f", "g", None) for w in rng.choice(words, 150) for k in (rng.choice(["date", "integer", "float", "string", "other"]).item(),)]
    rows += [("f", None, "string"), ("h", "sku", None), ("h", "sku", None)]
    h = spark.createDataFrame(rows, "file_id string, header string, dtype string").repartition(3)
    full = profile.score_headers(h)
    best = W.partitionBy("file_id", "canonical").orderBy(F.desc("score"), "header")
    top = lambda df: sorted(map(str, df.withColumn("rn", F.row_number().over(best)).where("rn <= 9").collect()))
    kept = profile.score_headers(h.coalesce(1), best=9)
    assert top(kept) == top(full) and kept.count() == full.withColumn("rn", F.row_number().over(best)).where("rn <= 9").count()
    assert sorted(map(str, profile.suggest_mapping(profile.score_headers(h, best=9)).collect())) == sorted(map(str, profile.suggest_mapping(full).collect()))


@pytest.mark.parametrize("bad", [
    "drop table panel", "insert into panel values (1)", "attach 'x'", "copy panel to 'x'", "pragma x", "select 1; select 2",
    "select * from read_csv('x')", "with a as (select 1) select * from a", "select * from other", "select 1", "",
    "select * from panel where x = '" + "a" * 2100 + "'"])
def test_guard_rejects(bad):
    with pytest.raises(adhoc.QueryError):
        adhoc.validate_sql(bad)


def test_guarded_sql(spark, panel_of):
    t = {"panel": panel_of({"A": [1, 2]})}
    assert one(adhoc.safe_sql(spark, "SELECT sum(demand) AS d FROM panel;", t)).d == 3
    assert one(adhoc.safe_sql(spark, "select sku_id, case when max(demand) between 1 and 9 then upper(sku_id) else 'x' end as u, count(distinct date) n, "
                              "row_number() over (order by sku_id) r from panel where demand in (select max(demand) from panel) and sku_id like 'A%' group by sku_id having count(*) > 0 order by 1 limit 3", t)).u == "A"
    panel_of({"A": [1]}).createOrReplaceTempView("hidden")
    for text in ("SELECT * FROM panel, hidden", "select sku_id from panel union all select sku_id from (hidden)", "select sku_id from panel union all select sku_id from/**/hidden",
                 "select * from panel where sku_id in (select sku_id from hidden)", "select reflect('java.lang.System', 'getProperty', 'user.home') from panel",
                 "select " + ", ".join(map(str, range(40))) + ", reflect('java.lang.System', 'getProperty', 'user.home') from panel",
                 "select sum(demand) from panel having max(java_method('java.util.UUID', 'randomUUID')) is null", "select * from panel order by try_reflect('java.lang.System', 'gc')",
                 "select input_file_name() from panel", "select (select max(sku_id) from hidden) from panel", "select * from panel where exists (select 1 from hidden)",
                 "select explode(array(1)) from panel", "select my.reflect(1) from panel", "select spark_catalog.default.panel.sku_id from spark_catalog.default.panel",
                 "select * from parquet.`/tmp`", "select * from panel, range(3)"):
        with pytest.raises(adhoc.QueryError):
            adhoc.safe_sql(spark, text, t)
    assert spark.table("hidden").count() == 1 and not spark.catalog.tableExists("panel")


def test_demand_grid_has_no_last_step(spark):
    from shelfline.operators import policies
    fc = spark.createDataFrame([("A", k, 1.0, 2.0, 3.0, 4.0, 100.0) for k in (1, 52, 53, 60, 104)], "sku_id string, step int, q025 double, q10 double, q50 double, q90 double, q975 double")
    means = {r.step: r.m for r in policies.demand_grid(fc, 256).groupBy("step").agg(F.avg("demand").alias("m")).collect()}
    assert all(5 < m < 15 for m in means.values()) and len(means) == 5


def test_purchase_orders(spark, panel_of):
    p = panel_of({"A": [1] * 5}, lead_time_days=10.0)
    lines = spark.createDataFrame([("d1", "1", " a ", 4.0), ("d1", "2", "nope", 1.0), ("d2", "1", "nope", 1.0)], "draft_id string, line_no string, sku_id string, qty double")
    head, kept = pu.draft_pos(lines, p, su.derive_suppliers(p), "2026-01-01")
    r = one(head)
    assert (r.total_units, r.total_cost, str(r.needed_by), r.notes) == (4.0, 20.0, "2026-01-18", "skipped invalid SKUs: NOPE")
    assert kept.count() == 1
    assert {x.draft_id: x.outcome for x in pu.accept_plan(lines, p, su.derive_suppliers(p), "2026-01-01").collect()} == {"d1": "created", "d2": "failed"}
    log = spark.createDataFrame([("P", "drafted", dt.datetime(2026, 1, 1)), ("P", "placed", dt.datetime(2026, 1, 2))], "po_id string, to_status string, at timestamp")
    assert one(pu.invalid_transitions(log)).to_status == "placed"


def test_reconciled_levels_add_up(panel_of):
    p = panel_of({"A": [5, 6] * 20, "B": [9, 8] * 20, "C": [1, 0, 0, 0] * 10}, category=lambda s, i, n: "c1" if s != "C" else "c2")
    for method in ("wls", "top_down", "bottom_up"):
        r = {x.unique_id: x.reconciled for x in ol.reconcile_panel(p, 1, "W", method).collect()}
        assert abs(r["TOTAL"] - r["c1"] - r["c2"]) < 1e-6 and abs(r["c1"] - r["c1/A"] - r["c1/B"]) < 1e-6


def test_lone_supplier_has_no_group(panel_of):
    c = su.replen_cycles(panel_of({"A": [5] * 10}), 52.0)
    assert su.joint_replenishment(su.cluster_cycles(c)).count() == 0


def test_anomaly_found(panel_of):
    v = [10 + i % 3 for i in range(60)]
    v[30] = 100
    top = anomalies.anomalies(panel_of({"A": v})).where("pos = 1").head()
    assert top.direction == "spike" and top.severity == "crit" and top.date == dt.date(2024, 1, 1) + dt.timedelta(weeks=30)

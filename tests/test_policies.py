"""Lead-time demand and (s,S) against simulation, recommendations, long series."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.functions import arrays as A, lattice as L
from shelfline.operators import anomalies, calibration as cal, outlook as ol, policies as po

LEVELS = (0.025, 0.1, 0.5, 0.9, 0.975)


def test_lead_time_demand_against_draws():
    rng = np.random.default_rng(0)
    q = np.array([[-1.0, 2, 5, 9, 12], [0.0, 3, 6, 8, 10]])
    lead = np.sort(rng.gamma(4, 0.9, 32))
    width, p = L.lead_time_demand(np.stack([q, q * 0]), np.stack([lead, lead]), 256)
    n = 400_000
    steps = np.stack([np.maximum(0, np.interp(rng.uniform(size=n), LEVELS, q[min(i, 1)])) for i in range(16)], axis=1)
    drawn = rng.choice(lead, n)
    whole = np.floor(drawn).astype(int)
    total = np.concatenate([np.zeros((n, 1)), steps.cumsum(axis=1)], axis=1)[np.arange(n), whole] + (drawn - whole) * steps[np.arange(n), whole]
    k = np.arange(p.shape[1]) * width[0]
    assert p[0].sum() == pytest.approx(1) and (p[0] * k).sum() == pytest.approx(total.mean(), rel=5e-3)
    assert np.sqrt((p[0] * k**2).sum() - (p[0] * k).sum() ** 2) == pytest.approx(total.std(), rel=1e-2)
    for level in (0.5, 0.9, 0.99):
        assert k[np.searchsorted(p[0].cumsum(), level)] == pytest.approx(np.quantile(total, level), abs=2 * width[0])
    assert lead[-1] > 2  # longer than the horizon
    assert p[1, 0] == pytest.approx(1) and width[1] == 1


def test_powers():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(5), 4)
    p = np.concatenate([p, np.zeros((4, 45))], axis=1)
    got = L.power(p, np.array([0, 1, 4, 9]))
    for row, n in enumerate((0, 1, 4, 9)):
        want = np.array([1.0])
        for _ in range(n):
            want = np.convolve(want, p[row, :5])
        assert np.allclose(got[row, : len(want)], want[:50])


def test_renewal_against_simulation():
    """Cost, fill and stockout chance of the chosen pair over a long simulated run with back orders."""
    rng = np.random.default_rng(2)
    values = rng.poisson(6, 400).astype(float)
    lead, review, holding, order_cost, periods = 3, 2, 4.0, 40.0, 52.0
    rows = np.zeros(len(values), int)
    s, big_s, out, fill, cost = po.best_pairs(lambda w, c: L.cells_of_values(rows, values, np.full(len(values), 1 / len(values)), w, c), np.array([values.mean()]), np.array([lead]),
                                              np.array([review]), np.array([holding]), np.array([order_cost]), np.array([0.95]), np.array([6 * 52.0]), periods)[0]
    n = 200_000
    demand = rng.choice(values, n)
    position, orders, held, short, outs, checks = big_s, 0, 0.0, 0.0, 0, 0
    total = demand.cumsum()
    for t in range(0, n - lead - review - 1, review):
        if position <= s:
            position, orders = big_s, orders + 1
        before, after = total[t + lead - 1] - (total[t - 1] if t else 0), total[t + lead + review - 1] - (total[t - 1] if t else 0)
        held += max(0.0, position - after)
        short += max(0.0, after - position) - max(0.0, before - position)
        outs += after > position
        checks += 1
        position -= demand[t : t + review].sum()
    assert cost == pytest.approx((orders * order_cost + holding * review / periods * held) / checks * periods / review, rel=0.03)
    assert fill == pytest.approx(1 - short / checks / (review * values.mean()), abs=0.01) and out == pytest.approx(outs / checks, abs=0.02)
    assert fill >= 0.95 and abs(fill - (1 - short / checks / (review * values.mean()))) < 0.006


def test_no_demand():
    one = po.best_pairs(lambda w, c: np.eye(1, c), np.zeros(1), np.array([2]), np.array([1]), np.array([1.0]), np.array([10.0]), np.array([0.95]), np.zeros(1), 52.0)[0]
    assert one[3] == 1 and np.isfinite(one).all()


def test_recommendation_rows(spark, panel_of):
    p = panel_of({"A": [10, 12, 9, 11] * 6, "B": [5] * 24, "C": [3] * 4}, on_hand=lambda sku, i, n: 0.0 if sku == "A" else 1e6)
    fc = spark.createDataFrame([(k, i, 10.0, 6.0, 8.0, 10.0, 12.0, 14.0) for k in "AB" for i in range(1, 9)], "sku_id string, step int, point double, q025 double, q10 double, q50 double, q90 double, q975 double")
    for policy in ("(Q,R)", "(s,S)", "base-stock", "EOQ", "newsvendor"):
        got = {r.sku_id: r for r in po.recommend_all(p, fc, "W", policy=policy).collect()}
        assert got["C"].error == "no forecast: fewer than 8 observations" and got["C"].policy_name is None and got["A"].error is None
        assert got["A"].policy_name == policy and got["A"].recommended_order_qty > 0
        if policy in ("(Q,R)", "(s,S)", "base-stock"):
            assert got["B"].recommended_order_qty == 0 and any("no order needed" in c for c in got["B"].caveats) and len(got["A"].schedule) == 8
            assert any("stockout periods out of 8" in c for c in got["A"].caveats)
    longer = po.scenario(p, fc, "W", policy="(Q,R)", lead_days=120.0).collect()  # past the horizon of eight weeks
    assert all(r.scenario_safety_stock > r.base_safety_stock for r in longer)


def test_scan_of_a_long_series(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=100_000)
    df = spark.createDataFrame([(values.tolist(),), ([],), ([1.0],)], "a array<double>").repartition(1)
    got = df.select(A.scan(F.col("a"), F.lit(0.0), lambda acc, x: F.greatest(F.lit(0.0), acc + x)).alias("s")).collect()
    pos, want = 0.0, []
    for v in values.tolist():
        pos = max(0.0, pos + v)
        want.append(pos)
    assert sorted((r.s for r in got), key=len) == [[], [1.0], want]


def test_cusum_of_blocks(panel_of):
    rng = np.random.default_rng(4)
    rows = anomalies.cusum(panel_of({"A": rng.normal(10, 2, 700).round(3).tolist()}, step=1)).orderBy("date").collect()
    pos = neg = 0.0
    for i, r in enumerate(rows):
        pos, neg = (0.0, 0.0) if i == 0 else (max(0.0, pos + r.z - 0.5), min(0.0, neg + r.z + 0.5))
        assert (r.cusum_pos, r.cusum_neg) == (pos, neg)
    assert len(rows) == 700


def test_bootstrap_is_near_the_normal_interval(spark):
    rng = np.random.default_rng(5)
    values = rng.gamma(2, 5, 4000).round(2)
    days = [f"2024-01-{1 + k % 28:02d}" for k in range(4000)]
    df = spark.createDataFrame([(d, float(v), None if k % 3 else "E", f"r{k}") for k, (d, v) in enumerate(zip(days, values))], "date string, sales double, event string, row_key string").withColumn("date", F.to_date("date"))
    one = cal.lift_ci(df.repartition(1)).collect()
    assert sorted(one) == sorted(cal.lift_ci(df.repartition(5)).collect())
    event = next(r for r in one if r.kind == "event")
    own = values[::3]
    half = 1.96 * own.std() / np.sqrt(len(own)) / values.mean()
    assert event.n == len(own) and event.ci_hi - event.ci_lo == pytest.approx(2 * half, rel=0.25)
    assert event.ci_lo < own.mean() / values.mean() < event.ci_hi and {r.kind for r in one} == {"dow", "woy", "event"}


def test_target_means_never_see_the_future(panel_of):
    series = {"A": [1.0, 2, 3, 4, 5], "B": [10.0, 20, 30, 40, 50]}
    base = ol.target_means(panel_of(series)).where("sku_id = 'A'").orderBy("date").collect()
    changed = ol.target_means(panel_of({**series, "A": [1.0, 2, 3, 400, 500]})).where("sku_id = 'A'").orderBy("date").collect()
    assert [r.sku_id_mean for r in base[:4]] == [r.sku_id_mean for r in changed[:4]] and base[4].sku_id_mean != changed[4].sku_id_mean
    assert base[0].sku_id_mean == 0 and base[1].sku_id_mean == pytest.approx((1 + 20 * 5.5) / 21)


def test_mixed_quantiles_against_draws():
    """Stretches longer and shorter than a cell, of no length, below zero; an unknown entry adds nothing."""
    q = np.array([[0.2, 3.7, 3.9, 4.1, 9.5], [2.0, 2.0, 2.0, 5.5, 5.5], [-3.0, -1.0, 1.5, 1.5 + 1e-12, 30.0], [1.0, 2.0, 3.0, 4.0, np.nan]])
    got = L.mixed_quantiles(np.array([0, 0, 1, 1]), q, np.array([0.25, 0.75, 1.0, 1.0]), 2, 40)
    u = (np.arange(200_000) + 0.5) / 200_000
    want = np.zeros((2, 41))
    for row, share, values in ((0, 0.25, q[0]), (0, 0.75, q[1]), (1, 1.0, q[2])):
        x = np.maximum(0.0, np.interp(u, LEVELS, values))
        low = np.floor(x).astype(int)
        np.add.at(want[row], low, (1 - x + low) * share / len(u))
        np.add.at(want[row], low + 1, (x - low) * share / len(u))
    assert np.abs(got - want[:, :40]).max() < 1e-5 and got.sum(axis=1) == pytest.approx([1, 1], abs=1e-12)


def test_short_lead_times_need_no_convolution(monkeypatch):
    calls, convolved = [], L.convolved
    monkeypatch.setattr(L, "convolved", lambda a, b: (calls.append(len(a)), convolved(a, b))[1])
    steps = np.tile([0.0, 3, 6, 8, 10], (3, 2, 1))
    lead = np.tile(np.linspace(0.1, 0.9, 32), (3, 1))
    L.lead_time_demand(steps, lead, 64)
    assert not calls
    lead[1] += 1  # only the row that needs it
    L.lead_time_demand(steps, lead, 64)
    assert calls == [1]


def test_a_scenario_of_equal_lead_times_has_one_lead_time_demand(panel_of, monkeypatch):
    calls, column = [], po.lead_time_column
    monkeypatch.setattr(po, "lead_time_column", lambda *a: (calls.append(1), column(*a))[1])
    panel = panel_of({"A": [5.0, 7, 6, 9] * 8, "B": [0.0, 3, 0, 8] * 8}, on_hand=lambda s, i, n: 4.0)
    fc = panel.select("sku_id").distinct().selectExpr("sku_id", "explode(sequence(1, 6)) as step", "6.0 as point", "1.0 as q025", "3.0 as q10", "6.0 as q50", "9.0 as q90", "12.0 as q975")
    one = {r.sku_id: r for r in po.scenario(panel, fc, "W", service_level=0.99, policy="base-stock").collect()}
    assert len(calls) == 1
    alone = {r.sku_id: r for r in po.recommend(panel, fc, "W", service_level=0.99, policy="base-stock").collect()}
    assert set(one) == set(alone) and all(one[k].scenario_safety_stock == alone[k].safety_stock > one[k].base_safety_stock for k in one)
    calls.clear()
    po.scenario(panel, fc, "W", lead_mult=2.0)
    assert len(calls) == 2


def counted(df, column):
    """df with an accumulator that counts how often a value of `column` is computed."""
    n = df.sparkSession.sparkContext.accumulator(0)

    def same(v):
        n.add(1)
        return v

    return df.withColumn(column, F.udf(same, df.schema[column].dataType)(column)), n


def test_a_forecast_computes_its_panel_and_priors_once(panel_of, spark):
    rng = np.random.default_rng(6)
    lengths = {f"S{k}": 12 if k % 3 == 0 else 60 for k in range(9)}
    panel = panel_of({s: rng.poisson(5, n).tolist() for s, n in lengths.items()})
    df, n = counted(panel, "demand")
    priors = spark.createDataFrame([("FOODS_1", p, 4.0, 1.0, 9) for p in ("smooth", "trending_new")], "dept_id string, pattern string, alpha double, beta double, n_observed_skus long")
    priors, k = counted(priors, "alpha")
    out = ol.forecast_all(df, 4, "W", priors=priors)
    summary = {r.sku_id: r for r in out["summary"].collect()}
    assert out["forecasts"].count() == 4 * len(lengths)
    assert n.value == panel.count() and k.value == 2
    assert all(summary[s].n_obs == m and summary[s].method == ("negbin_bayes" if m == 12 else summary[s].method) for s, m in lengths.items())


def test_a_classifier_computes_its_features_once(panel_of):
    from shelfline.operators import series as s_
    rng = np.random.default_rng(7)
    series = {f"S{k}": (rng.poisson(5, 100) * (rng.uniform(size=100) < (1, 0.5, 0.1)[k % 3])).tolist() for k in range(30)}
    feats, n = counted(s_.pattern_features(panel_of(series, step=1)), "cv_demand")
    model, row = cal.train_classifier(feats)
    r = row.head()
    assert r.n_train + r.n_val == 30 and 0 <= r.val_accuracy <= 1 and n.value == 30

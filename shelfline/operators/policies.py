"""Lead-time demand, order policies, schedules and recommendations.

Distributions are lattices (`functions.lattice`): an array of chances and the width of a cell, in the SKU's row."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A, lattice as L
from ..functions.stats import gamma_points, gamma_ppf
from ..schema import PERIOD_DAYS, PERIODS_PER_YEAR, QUANTILE_COLS, QUANTILE_LEVELS
from ..session import stored
from .inventory import class_columns, classed, sku_state

# fixed values: service levels of the frontier
SERVICE_LEVELS = (0.85, 0.90, 0.93, 0.95, 0.97, 0.98, 0.99)
# fixed values: dataset settings
HOLDING_RATE, ORDER_COST, SERVICE_LEVEL = 0.25, 50.0, 0.95
# fixed values: economics per category (holding rate, order cost, markup, lead time, perishable, review days)
ECONOMICS = {
    "FOODS_1": (0.32, 35.0, 1.45, 4.0, True, 7.0), "FOODS_2": (0.32, 35.0, 1.45, 4.0, True, 7.0),
    "FOODS_3": (0.32, 35.0, 1.45, 4.0, True, 7.0), "HOBBIES_1": (0.25, 50.0, 1.6, 14.0, False, 7.0),
    "HOBBIES_2": (0.25, 50.0, 1.6, 14.0, False, 7.0), "HOUSEHOLD_1": (0.25, 50.0, 1.6, 10.0, False, 7.0),
    "HOUSEHOLD_2": (0.25, 50.0, 1.6, 10.0, False, 7.0), "_default": (0.25, 50.0, 1.5, 14.0, False, 14.0)}
ECON_COLS = ("holding_cost_rate", "order_cost_default", "markup_default", "default_lead_time", "perishable", "review_days")

# ---- lead time --------------------------------------------------------------------------------

def gamma_columns(n: Column, m: Column, v: Column, fallback_mean=14.0, fallback_cv: float = 0.2) -> tuple[Column, Column]:
    """(shape, scale) by moments of n positive observations; fewer than three use the fallback."""
    cv2 = max(0.001, fallback_cv ** 2)
    few, flat = n < 3, v < 1e-9
    return (F.when(few, 1 / cv2).when(flat, 1e3).otherwise(m * m / v), F.when(few, fallback_mean * cv2).when(flat, m / 1e3).otherwise(v / m))


def lead_time_gamma(df: DataFrame, fallback_mean: float = 14.0, fallback_cv: float = 0.2) -> DataFrame:
    """Gamma by moments on positive observations; fewer than three use the fallback."""
    lt = F.when(F.col("lead_time_days") > 0, F.col("lead_time_days"))
    g = df.groupBy("sku_id").agg(F.count(lt).alias("n"), F.avg(lt).alias("m"), F.var_samp(lt).alias("v"))
    shape, scale = gamma_columns(F.col("n"), F.col("m"), F.col("v"), F.lit(fallback_mean), fallback_cv)
    return g.select("sku_id", shape.alias("shape"), scale.alias("scale"))


def gamma_summary(g: DataFrame) -> DataFrame:
    a, s = F.col("shape"), F.col("scale")
    return g.select("sku_id", (a * s).alias("mean"), (F.sqrt(a) * s).alias("std"),
                    gamma_ppf(F.lit(0.05), a, s).alias("p5"), gamma_ppf(F.lit(0.95), a, s).alias("p95"))


# ---- lead-time demand ---------------------------------------------------------------------------

def interpolate(u: Column, values: list[Column]) -> Column:
    """Value at probability u through the five quantiles, clamped at both ends."""
    out = values[-1]
    for i in range(len(values) - 2, -1, -1):
        lo, hi = QUANTILE_LEVELS[i], QUANTILE_LEVELS[i + 1]
        out = F.when(u <= hi, values[i] + (values[i + 1] - values[i]) * (u - lo) / (hi - lo)).otherwise(out)
    return F.greatest(F.lit(0.0), F.when(u <= QUANTILE_LEVELS[0], values[0]).otherwise(out))


def stride(step: int) -> float:
    """Irrational stride of a step, from the step alone: no horizon is too long."""
    return math.sqrt(step + 1 / 3) * math.pi % 1


def _u(step: Column, draw: Column) -> Column:
    x = F.sqrt(step + F.lit(1 / 3)) * F.lit(math.pi)
    x = F.lit(0.5) + draw * (x - F.floor(x))
    return x - F.floor(x)


def demand_grid(fc: DataFrame, draws: int = 128) -> DataFrame:
    """Demand of each SKU, step and draw: evenly spread probabilities per step (a lattice
    with an irrational stride per step), mapped through the forecast quantiles."""
    g = fc.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return g.select("sku_id", "step", "draw", interpolate(
        _u(F.col("step"), F.col("draw")), [F.col(c) for c in QUANTILE_COLS]).alias("demand"))


LEAD_POINTS, CELLS = 32, 128  # equally likely lead times of a SKU; cells of its lattice


def forecast_steps(fc: DataFrame) -> DataFrame:
    """One row per SKU: points and ascending quantile arrays in step order."""
    quantiles = F.array_sort(F.array(*[F.col(c) for c in QUANTILE_COLS]))
    rows = fc.groupBy("sku_id").agg(F.sort_array(F.collect_list(F.struct("step", "point", quantiles.alias("q")))).alias("_s"))
    return rows.select("sku_id", F.transform("_s", lambda x: x["point"]).alias("point"), F.transform("_s", lambda x: x["q"]).alias("steps"))


def lead_periods_points(shape: np.ndarray, scale: np.ndarray, freq: str, points: int = LEAD_POINTS) -> np.ndarray:
    """Quantiles of the lead time at the middles of equal shares, in periods: rows x points."""
    return gamma_points([(k + 0.5) / points for k in range(points)], shape, scale) / PERIOD_DAYS[freq]


def _stacked(arrays: pd.Series, width: int = 1) -> np.ndarray:
    """Rows x places x width from flat arrays; shorter ones repeat their last place."""
    n = max(map(len, arrays)) // width
    out = np.empty((len(arrays), n, width))
    for i, a in enumerate(arrays):
        a = np.asarray(a, float).reshape(-1, width)
        out[i, : len(a)], out[i, len(a) :] = a, a[-1]
    return out


BATCH = 256  # rows that are worked on at once
LTD_BATCH = 128  # with LEAD_POINTS parts a row, whose arrays then stay in the cache


def _ltd_udf(freq: str, cells: int):
    def run(steps: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.DataFrame:
        given = np.flatnonzero(steps.notna() & shape.notna() & scale.notna())
        lead = lead_periods_points(shape.to_numpy(float)[given], scale.to_numpy(float)[given], freq)
        width, chances = np.full(len(steps), None, object), np.full(len(steps), None, object)
        mean, std = np.full(len(steps), None, object), np.full(len(steps), None, object)
        for a in range(0, len(given), LTD_BATCH):
            i = given[a : a + LTD_BATCH]
            w, p = L.lead_time_demand(_stacked(steps.iloc[i], len(QUANTILE_COLS)), lead[a : a + LTD_BATCH], cells)
            mean[i], std[i] = L.moments(p, w)
            for k, row in enumerate(i):
                width[row], chances[row] = w[k], p[k, : np.flatnonzero(p[k])[-1] + 1]
        return pd.DataFrame({"width": width, "p": chances, "ltd_mean": mean, "ltd_std": std})

    return F.pandas_udf(run, "width double, p array<double>, ltd_mean double, ltd_std double")


def ltd_columns(steps: Column, shape: Column, scale: Column, freq: str, cells: int = CELLS) -> Column:
    """struct(width, p, ltd_mean, ltd_std) of a SKU's lead-time demand; its fields are null where an input is."""
    return _ltd_udf(freq, cells)(F.flatten(steps), shape, scale)


def lead_time_column(t: DataFrame, name: str, freq: str, cells: int = CELLS) -> DataFrame:
    """t, with steps, shape and scale, and the struct of its lead-time demand; null where there is none."""
    t = t.withColumn("_d", ltd_columns(F.col("steps"), F.col("shape"), F.col("scale"), freq, cells))
    return t.withColumn(name, F.when(F.col("_d.p").isNotNull(), F.col("_d"))).drop("_d")


def ltd_distribution(fc: DataFrame, lt: DataFrame, freq: str, cells: int = CELLS) -> DataFrame:
    """Lead-time demand of each SKU as chances `p` of the multiples of `width`, with mean and std.

    Period demands are convolved and mixed over the lead time; a lead time past the horizon repeats the last step."""
    j = forecast_steps(fc).join(lt.select("sku_id", "shape", "scale"), "sku_id")
    return lead_time_column(j, "_l", freq, cells).select("sku_id", "_l.*")


def ltd_cells(ltd: DataFrame) -> DataFrame:
    """One row per SKU and cell that can happen: value, chance and cumulated chance."""
    rows = ltd.select("sku_id", "width", F.posexplode(F.arrays_zip("p", L.running(F.col("p")).alias("cum"))).alias("cell", "_x"))
    return rows.select("sku_id", "cell", (F.col("cell") * F.col("width")).alias("value"), F.col("_x.p").alias("p"), F.col("_x.cum").alias("cum")).where("p > 1e-12")


# ---- closed forms ---------------------------------------------------------------------------------

def eoq_columns(demand: Column, order_cost: Column, holding: Column) -> dict:
    ok = (demand > 0) & (order_cost > 0) & (holding > 0)
    q = F.when(ok, F.sqrt(2.0 * demand * order_cost / holding))
    return {"q": q, "orders": demand / q, "holding_cost": q / 2 * holding, "ordering_cost": demand / q * order_cost}


def eoq(df: DataFrame) -> DataFrame:
    """From (sku_id, annual_demand, order_cost, holding_cost)."""
    e = eoq_columns(F.col("annual_demand"), F.col("order_cost"), F.col("holding_cost"))
    return df.select("sku_id", e["q"].alias("q"), e["orders"].alias("expected_orders_per_year"),
                     e["holding_cost"].alias("expected_holding_cost_annual"),
                     e["ordering_cost"].alias("expected_order_cost_annual"),
                     (e["holding_cost"] + e["ordering_cost"]).alias("total_cost_annual"))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def qr_columns(p: Column, width: Column, ltd_mean: Column, demand: Column, order_cost: Column, holding: Column, level: Column) -> Column:
    """struct of (Q,R) figures."""
    q, at = eoq_columns(demand, order_cost, holding)["q"], L.at_level(p, width, level)
    r = at["value"]
    safety = F.greatest(F.lit(0.0), r - ltd_mean)
    hold = (q / 2 + safety) * holding
    fill = F.when(ltd_mean > 0, 1 - at["short"] / ltd_mean).otherwise(1.0)
    return F.struct(q.alias("q"), r.alias("r"), safety.alias("safety_stock"), at["above"].alias("stockout_prob"), _clamped(fill).alias("fill_rate"),
                    hold.alias("holding_cost_annual"), (hold + demand / q * order_cost).alias("total_cost_annual"))


def qr_policy(t: DataFrame) -> DataFrame:
    """(Q,R) from (p, width, ltd_mean, annual_demand, order_cost, holding_cost, service_level)."""
    c = F.col
    r = qr_columns(c("p"), c("width"), c("ltd_mean"), c("annual_demand"), c("order_cost"), c("holding_cost"), c("service_level"))
    return t.select("sku_id", "service_level", r.alias("_r")).select("sku_id", "service_level", "_r.*")


def newsvendor_columns(p: Column, width: Column, under: Column, over: Column) -> Column:
    """struct of the newsvendor quantity and its expected costs; null unless both costs are positive."""
    ratio = under / (under + over)
    at = L.at_level(p, width, ratio)
    short, left = at["short"] * under, at["surplus"] * over
    return F.when((under > 0) & (over > 0), F.struct(
        ratio.alias("critical_ratio"), at["value"].alias("q"), short.alias("underage_cost"), left.alias("overage_cost"), (short + left).alias("total_cost"),
        at["above"].alias("above"), at["short"].alias("short")))


def newsvendor(t: DataFrame) -> DataFrame:
    """From (p, width, underage, overage)."""
    c = F.col
    return t.select("sku_id", newsvendor_columns(c("p"), c("width"), c("underage"), c("overage")).alias("_r")).where("_r is not null").select("sku_id", "_r.*").drop("above", "short")


def newsvendor_hist(df: DataFrame, salvage: float = 0.0) -> DataFrame:
    """Newsvendor quantity of each SKU on its own demand history, one value a calendar period."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    s = df.groupBy("sku_id").agg(F.sort_array(F.collect_list("demand")).alias("_y"), F.coalesce(known("unit_cost"), F.lit(1.0)).alias("_c"), known("unit_price").alias("_p"))
    price = F.coalesce(F.col("_p"), F.col("_c") * 1.5)
    s = s.withColumns({"underage": F.greatest(F.lit(0.01), price - F.col("_c")), "overage": F.greatest(F.lit(0.01), F.col("_c") - salvage)})
    ratio = F.col("underage") / (F.col("underage") + F.col("overage"))
    return s.select("sku_id", "underage", "overage", ratio.alias("critical_ratio"), A.at_level(F.col("_y"), ratio).alias("optimal_qty"))


def base_stock(t: DataFrame) -> DataFrame:
    p, w = F.col("p"), F.col("width")
    at = L.at_level(p, w, F.col("service_level"))
    return t.select("sku_id", at["value"].alias("s_level"), F.greatest(F.lit(0.0), at["value"] - F.col("ltd_mean")).alias("safety_stock"),
                    at["above"].alias("stockout_prob"))


# ---- (s,S) by renewal --------------------------------------------------------------------------------

S_STEPS, SS_CELLS = 6, 192    # the grid has S_STEPS reorder points and as many gaps; cells of its lattice (against simulation: fill within 0.004, cost within 1 %)
SHORTFALL = 1e6               # cost of a whole unit of fill rate below the level


def best_pairs(cells_of, mean, lead, review, holding, order_cost, level, demand, periods: float):
    """(s, big_s, stockout_prob, fill_rate, cost) of every row: the cheapest pair of the grid, shortfalls of fill counted in.

    Between two orders the inventory position starts at S and falls by the demand of each review; m[j] is the expected
    number of reviews that see it j cells under S (the renewal recursion m[j] = sum of d[l] m[j - l]), and their sum up to
    S - s is the expected number of reviews between orders.  A position y costs what holding E(y - D)+ costs, D the demand
    of lead and review time, and is short by the growth of E(D - y)+ over the review.  Averages over m give cost,
    fill and stockout chance of every pair; nothing is replayed.  S - s is a whole number of cells, s need not be.

    cells_of(width, cells): chances of one period's demand.  All else are arrays of a value a row."""
    ltd = np.maximum(0.1, mean * lead)
    gap = np.sqrt(2.0 * np.maximum(demand, 1.0) * order_cost / np.maximum(holding, 1e-6))
    w = (2.5 * ltd + 2.0 * gap) / SS_CELLS
    one = cells_of(w, SS_CELLS + 4)
    d, before = L.power(one, review), L.power(one, lead)
    cum, cum_lead = L.convolved(d, before).cumsum(axis=1), before.cumsum(axis=1)
    surplus = lambda c: np.concatenate([np.zeros((len(w), 1)), (c * w[:, None]).cumsum(axis=1)], axis=1)
    over, over_lead = surplus(cum), surplus(cum_lead)
    reach = np.floor(2.0 * gap / w + 0.5).astype(np.int64)
    m = np.zeros((len(w), reach.max() + 1))
    still = np.maximum(1e-12, 1.0 - d[:, 0])
    m[:, 0] = 1.0 / still
    for j in range(1, m.shape[1]):
        m[:, j] = np.einsum("ij,ij->i", d[:, 1 : j + 1], m[:, j - 1 :: -1]) / still
    gaps = []
    for n in range(S_STEPS):
        wide = np.maximum(1, np.floor(gap * (0.5 + 1.5 / (S_STEPS - 1) * n) / w + 0.5).astype(np.int64))
        j = np.arange(wide.max())
        seen = np.where(j < wide[:, None], m[:, : len(j)], 0.0)
        gaps.append((wide, j, seen, seen.sum(axis=1)))
    row = np.arange(len(w))[:, None]
    best = np.full((len(w), 5), np.nan)
    lowest = np.full(len(w), np.inf)
    for n in range(S_STEPS * S_STEPS):
        s = ltd * (0.5 + 2.0 / (S_STEPS - 1) * (n // S_STEPS))
        wide, j, seen, total = gaps[n % S_STEPS]
        low = np.floor(s / w).astype(np.int64)
        part = s / w - low
        k = np.maximum(0, low[:, None] + wide[:, None] - j)
        weighted = lambda a, i: np.einsum("ij,ij->i", seen, a.ravel().take(i + row * a.shape[1]))
        between = lambda a: weighted(a, k) * (1.0 - part) + weighted(a, k + 1) * part
        held, held_lead = between(over), between(over_lead)
        out = np.einsum("ij,ij->i", seen, np.maximum(0.0, 1.0 - cum.ravel().take(k + row * cum.shape[1]))) / total
        cost = (order_cost + holding * review / periods * held) / total * periods / review
        fill = np.where(mean > 0, np.clip((held_lead - held) / (total * review * np.where(mean > 0, mean, 1.0)), 0.0, 1.0), 1.0)
        goal = np.round(cost + np.maximum(0.0, level - fill) * SHORTFALL, 6)
        better = goal < lowest
        lowest = np.where(better, goal, lowest)
        best[better] = np.stack([s, s + wide * w, out, fill, cost], axis=1)[better]
    return best


SS_COLS = ("s", "big_s", "stockout_prob", "fill_rate", "cost")
SS_TYPE = ", ".join(f"{c} double" for c in SS_COLS)


def _ss_udf(kind: str, periods: float):
    """kind `values`: equally likely values of a period; `steps`: flat ascending quantiles of the forecast steps, one of them drawn at random."""

    def run(data: pd.Series, lead: pd.Series, review: pd.Series, holding: pd.Series, order_cost: pd.Series, level: pd.Series, demand: pd.Series) -> pd.DataFrame:
        out = np.full((len(data), len(SS_COLS)), np.nan)
        given = np.flatnonzero(data.notna())
        for a in range(0, len(given), BATCH):
            i = given[a : a + BATCH]
            part = [np.asarray(x, float) for x in data.iloc[i]]
            count = np.array([len(x) for x in part]) // (1 if kind == "values" else len(QUANTILE_COLS))
            rows, flat = np.repeat(np.arange(len(i)), count), np.concatenate(part)
            if kind == "values":
                mean = np.bincount(rows, flat, len(i)) / count
                cells_of = lambda w, cells: L.cells_of_values(rows, flat, 1.0 / count[rows], w, cells)
            else:
                q = flat.reshape(-1, len(QUANTILE_COLS))
                mean = np.bincount(rows, L.quantile_means(q), len(i)) / count

                cells_of = lambda w, cells: L.mixed_quantiles(rows, q / w[rows][:, None], 1.0 / count[rows], len(i), cells)

            whole = lambda c: c.iloc[i].to_numpy().astype(np.int64)
            real = lambda c: c.iloc[i].to_numpy().astype(float)
            out[i] = best_pairs(cells_of, mean, whole(lead), whole(review), real(holding), real(order_cost), real(level), real(demand), periods)
        return pd.DataFrame(out, columns=SS_COLS)

    return F.pandas_udf(run, SS_TYPE)


def ss_history(t: DataFrame, periods: float = 52.0) -> DataFrame:
    """Best (s,S) of each SKU on the distribution of its own demand history.

    Needs (sku_id, y, lead_periods, review_periods, holding_cost, order_cost, service_level, annual_demand)."""
    r = _ss_udf("values", periods)("y", "lead_periods", "review_periods", "holding_cost", "order_cost", "service_level", "annual_demand")
    return t.select("sku_id", r.alias("_r")).select("sku_id", "_r.*")


# ---- schedules -----------------------------------------------------------------------------------

def _schedule(point: Column, on_hand: Column, lead: Column, want, reason) -> Column:
    """Fold over the forecast: demand, delivery, then an order unless goods arrived.

    `want(stock, pending, t)` is the quantity to order or 0; the arrival slot must lie
    inside the horizon."""
    h = F.size(point)
    zeros = F.transform(point, lambda v: F.lit(0.0))
    entry = ("array<struct<period_idx:int,action:string,qty:double,after_demand:double,after_delivery:double,"
             "arrival_idx:int,stockout:boolean,reason:string>>")
    start = F.struct(on_hand.cast("double").alias("stock"), zeros.alias("due"), F.array().cast(entry).alias("out"))

    def step(acc, t):
        d = F.get(point, t)
        left = F.greatest(F.lit(0.0), acc["stock"] - d)
        got = F.get(acc["due"], t)
        stock = left + got
        due = F.transform(acc["due"], lambda v, i: F.when(i == t, 0.0).otherwise(v))
        arrive = t + lead
        qty = F.when((got > 0) | (arrive >= h), 0.0).otherwise(want(stock, due, t, arrive))
        row = F.struct(
            t.cast("int").alias("period_idx"),
            F.when(got > 0, "delivery").when(qty > 0, "order").otherwise("no_op").alias("action"), qty.alias("qty"),
            left.alias("after_demand"), stock.alias("after_delivery"), F.when(qty > 0, arrive.cast("int")).alias("arrival_idx"),
            (acc["stock"] < d).alias("stockout"),
            F.when(got > 0, F.format_string("delivery of %.0f units", got)).when(qty > 0, reason(stock, t)).alias("reason"))
        return F.struct(stock.alias("stock"), F.transform(due, lambda v, i: F.when(i == arrive, v + qty).otherwise(v)).alias("due"),
                        F.array_append(acc["out"], row).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), h - 1), start, step, lambda a: a["out"])


def _qr_rule():
    """Quantity and reason from columns q, r."""
    return (lambda stock, due, t, arrive: F.when((stock <= F.col("r")) & (F.get(due, arrive) == 0), F.col("q")).otherwise(0.0),
            lambda stock, t: F.format_string("on-hand %.0f ≤ R=%.0f", stock, F.col("r")))


def _ss_rule(review: str):
    """Quantity and reason from columns s, big_s and the review interval."""
    return (lambda stock, due, t, arrive: F.when((t % F.col(review) == 0) & (stock <= F.col("s")), F.greatest(F.lit(0.0), F.col("big_s") - stock - A.total(due))).otherwise(0.0),
            lambda stock, t: F.format_string("review @ t=%d: on-hand %.0f ≤ s=%.0f, order to S=%.0f", t, stock, F.col("s"), F.col("big_s")))


def schedule(t: DataFrame, mode: str, freq: str) -> DataFrame:
    """Projected orders and deliveries of each SKU, one row per period.

    Needs (sku_id, point array, on_hand, lead_time_days, start_date) and q, r (QR), or
    s, big_s, review_periods (sS), or s_level (base_stock)."""
    days = PERIOD_DAYS[freq]
    lead = F.greatest(F.lit(1), F.rint(F.col("lead_time_days") / days).cast("int"))
    if mode == "QR":
        want, reason = _qr_rule()
    elif mode in ("sS", "base_stock"):
        if mode == "base_stock":
            t = t.withColumns({"s": F.col("s_level") - 1, "big_s": F.col("s_level"), "review_periods": F.lit(1)})
        want, reason = _ss_rule("review_periods")
    else:
        raise ValueError(f"unsupported policy mode: {mode}")
    rows = t.withColumn("_lead", lead)
    rows = rows.select("sku_id", "start_date", F.inline_outer(_schedule(F.col("point"), F.col("on_hand"), F.col("_lead"), want, reason)))
    at = lambda i: F.date_add("start_date", (i * int(days)).cast("int"))
    return rows.withColumns({"date": at(F.col("period_idx")), "expected_arrival": at(F.col("arrival_idx"))}).drop("start_date")


def schedule_totals(s: DataFrame) -> DataFrame:
    return s.groupBy("sku_id").agg(F.count_if(F.col("action") == "order").alias("n_orders"),
                                   F.sum(F.when(F.col("action") == "order", F.col("qty")).otherwise(0.0)).alias("total_units_ordered"),
                                   F.count_if("stockout").alias("expected_stockout_periods"))


# ---- economics and recommendation --------------------------------------------------------------------

def category_economics(skus: DataFrame, table: dict = ECONOMICS) -> DataFrame:
    """Economics of each (sku_id, category): exact name, else the first name with the
    category's prefix, else the default.  The table is a constant, looked up in place."""
    names = [k for k in table if k != "_default"]
    cat = F.col("category")
    prefix = F.upper(F.split(cat, "_")[0])
    match = F.lit("_default")
    for n in reversed(names):
        match = F.when(F.startswith(F.lit(n), prefix), n).otherwise(match)
    for n in names:
        match = F.when(cat == n, n).otherwise(match)
    out = skus.withColumn("matched", F.when(cat.isNull() | (cat == ""), "_default").otherwise(match))

    def value(i):
        v = F.lit(table["_default"][i])
        for n in names:
            v = F.when(F.col("matched") == n, table[n][i]).otherwise(v)
        return v
    return out.withColumns({c: value(i) for i, c in enumerate(ECON_COLS)})


def select_policy(df: DataFrame, override: str | None = None) -> DataFrame:
    rule = F.when(F.col("perishable"), "newsvendor").otherwise("(s,S)")
    return df.withColumn("policy_name", F.coalesce(F.lit(override).cast("string"), rule))


def implied_service_level(price: Column, cost: Column, holding: Column, saved: float | None = None,
                          override: float | None = None) -> Column:
    """Explicit level, else a saved one, else the critical ratio clamped to [.85, .99]."""
    if override is not None:
        return F.lit(float(override))
    if saved is not None:
        return F.lit(float(saved))
    under, over = F.greatest(F.lit(0.5), price - cost), F.greatest(F.lit(0.5), holding)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.85), under / (under + over)))


def recommendation_base(df: DataFrame, fc: DataFrame, freq: str) -> DataFrame:
    """One row per SKU with all that any recommendation needs: one aggregate of the panel, one of the forecast, the ranking."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    lt = F.when(F.col("lead_time_days") > 0, F.col("lead_time_days"))
    per = df.groupBy("sku_id").agg(
        *class_columns(PERIODS_PER_YEAR[freq]), F.count(F.lit(1)).alias("n_obs"), F.max("date").alias("start_date"), F.max_by("category", "date").alias("category"),
        F.avg("unit_cost").alias("_cost"), F.avg("unit_price").alias("_price"), F.coalesce(known("on_hand"), F.lit(0.0)).alias("on_hand"),
        F.avg("lead_time_days").alias("_lt_all"), F.count(lt).alias("n"), F.avg(lt).alias("m"), F.var_samp(lt).alias("v"))
    # the ranking reads its rows twice, to find its ranges and to deal them
    per = stored(per, "recommendation")
    ranked = classed(per, [c for c in per.columns if c not in ("revenue_annual", "cv_demand", "sku_id")])
    return ranked.join(forecast_steps(fc), "sku_id", "left")


def settled(base: DataFrame, freq: str, service_level=None, holding_rate=None, order_cost=None, policy=None, lead_mult=None, lead_days=None,
            saved_level=None, cells: int = CELLS) -> DataFrame:
    """base with costs, lead time, level, policy and lead-time demand under these settings; where base has the lead-time demand and no lead time is
    set, it stays."""
    c = F.col
    econ = category_economics(base).drop("matched")
    shape, scale = gamma_columns(c("n"), c("m"), c("v"), c("default_lead_time"))
    given = F.lit(float(lead_days)) if lead_days is not None else c("_lt_all") * lead_mult if lead_mult is not None else None
    if given is not None:
        shape = F.when(given.isNull(), shape).otherwise(F.lit(25.0))  # a lead time set by hand varies by a fifth
        scale = F.when(given.isNull(), scale).otherwise(F.greatest(F.lit(1e-3), given * 0.04))
    t = econ.withColumns({"unit_cost": F.coalesce("_cost", F.lit(1.0)), "shape": shape, "scale": scale})
    t = t.withColumns({"unit_price": F.coalesce(c("_price"), c("unit_cost") * c("markup_default")), "holding_cost": F.lit(float(holding_rate or HOLDING_RATE)) * c("unit_cost"),
                       "order_cost": F.lit(float(order_cost or ORDER_COST)), "annual_demand": A.mean(c("point")) * PERIODS_PER_YEAR[freq], "lead_time_days": c("shape") * c("scale"),
                       "review_periods": F.greatest(F.lit(1), F.rint(c("review_days") / PERIOD_DAYS[freq]).cast("int"))})
    t = t.withColumns({"lead_periods": F.greatest(F.lit(1), F.rint(c("lead_time_days") / PERIOD_DAYS[freq]).cast("int")),
                       "service_level": implied_service_level(c("unit_price"), c("unit_cost"), c("holding_cost"), saved_level, service_level)})
    t = select_policy(t, policy)
    return t if given is None and "_ltd" in base.columns else lead_time_column(t, "_ltd", freq, cells)


REC_COLS = ("recommended_order_qty", "reorder_point", "safety_stock", "expected_stockout_prob", "expected_fill_rate", "expected_holding_cost_annual",
            "expected_total_cost_annual")


def held(t: DataFrame, name: str, value: Column) -> DataFrame:
    """t with `value`, computed once a row: behind a generator of one element it cannot be merged into the lambdas that name it."""
    return t.select("*", F.explode_outer(F.array(value)).alias(name))


def recommended(t: DataFrame, freq: str) -> DataFrame:
    """Adds `rec`, a struct with REC_COLS, parameters, caveats and schedule, to rows of settled(): every policy is a case of one projection, and
    only the case of a row is computed."""
    c, zero, one = F.col, F.lit(0.0), F.lit(1.0)
    p, w, mean = c("_ltd")["p"], c("_ltd")["width"], c("_ltd")["ltd_mean"]
    hold, demand, order_cost = c("holding_cost"), c("annual_demand"), c("order_cost")

    def row(values, **parameters):
        named = [F.coalesce(v, F.lit(None)).cast("double").alias(k) for k, v in zip(REC_COLS, values)]
        return F.struct(*named, F.create_map(*[x for k, v in parameters.items() for x in (F.lit(k), v.cast("double"))]).alias("parameters"))

    # rows of other policies go to the functions as nulls
    of = lambda policy, x: F.when(c("policy_name") == policy, x)
    qr = L.let(qr_columns(of("(Q,R)", p), w, mean, demand, order_cost, hold, c("service_level")), lambda r: row(
        (r["q"], r["r"], r["safety_stock"], r["stockout_prob"], r["fill_rate"], r["holding_cost_annual"], r["total_cost_annual"]), Q=r["q"], R=r["r"]))
    k = eoq_columns(demand, order_cost, hold)
    eoq_ = row((k["q"], F.lit(None), zero, zero, one, k["holding_cost"], k["holding_cost"] + k["ordering_cost"]), Q=k["q"], expected_orders_per_year=k["orders"])
    margin = c("unit_price") - c("unit_cost")
    under = F.when(margin <= 0, 1.0).otherwise(margin)
    news = L.let(newsvendor_columns(of("newsvendor", p), w, under, hold), lambda r: row(
        (r["q"], r["q"], zero, r["above"], _clamped(1 - r["short"] / F.greatest(F.lit(1e-9), mean)), zero, r["total_cost"]),
        Q=r["q"], underage_cost=under, overage_cost=hold))
    t = t.withColumn("_ss", _ss_udf("steps", PERIODS_PER_YEAR[freq])(
        F.when((c("policy_name") == "(s,S)") & c("_ltd").isNotNull(), F.flatten("steps")), "lead_periods", "review_periods", "holding_cost", "order_cost", "service_level", "annual_demand"))

    def ss_row(r):
        safe = F.greatest(zero, r["s"] - mean)
        held = (r["big_s"] / 2 + safe) * hold
        return row((F.greatest(zero, r["big_s"] - c("on_hand")), r["s"], safe, r["stockout_prob"], r["fill_rate"], held,
                    held + demand / F.greatest(r["big_s"] - r["s"], one) * order_cost), s=r["s"], S=r["big_s"], review_period_periods=c("review_periods"))

    base = L.let(L.at_level(of("base-stock", p), w, c("service_level")), lambda at: row(
        (at["value"], at["value"], F.greatest(zero, at["value"] - mean), at["above"], 1 - at["above"], at["value"] * hold, at["value"] * hold), S=at["value"]))
    name = c("policy_name")
    cases = (F.when(name == "(Q,R)", qr).when(name == "EOQ", eoq_).when(name == "newsvendor", news).when(name == "(s,S)", ss_row(c("_ss"))).when(name == "base-stock", base))
    t = held(t, "_r", F.when(c("_ltd").isNotNull(), cases))
    r = c("_r")
    ordered = name.isin("(Q,R)", "(s,S)", "base-stock")
    covered = F.coalesce(ordered & (c("on_hand") > r["reorder_point"]), F.lit(False))
    par = lambda key: F.try_element_at(r["parameters"], F.lit(key))
    inside = t.withColumns({"q": par("Q"), "r": par("R"), "s": F.when(name == "base-stock", par("S") - 1).otherwise(par("s")), "big_s": par("S"),
                            "_review": F.when(name == "base-stock", 1).otherwise(c("review_periods")), "_covered": covered})
    inside = inside.withColumn("_plan", F.when(ordered & r.isNotNull(), F.when(name == "(Q,R)", _schedule(c("point"), c("on_hand"), c("lead_periods"), *_qr_rule()))
                                               .otherwise(_schedule(c("point"), c("on_hand"), c("lead_periods"), *_ss_rule("_review")))))
    outs = F.size(F.filter("_plan", lambda e: e["stockout"]))
    caveats = F.filter(F.array(
        F.when(name == "EOQ", "EOQ assumes deterministic lead time; switch to (Q,R) for stochastic."),
        F.when((name == "newsvendor") & (margin <= 0), "price <= cost: underage cost is not positive, a floor of 1 is used."),
        F.when(c("_covered"), F.format_string("on-hand %.0f > reorder point %.0f; no order needed now.", "on_hand", r["reorder_point"])),
        F.when(outs > 0, F.format_string("projected schedule has %d stockout periods out of %d; consider higher service level or shorter lead time.", outs, F.size("_plan")))),
        lambda x: x.isNotNull())
    quantity = F.when(c("_covered"), 0.0).otherwise(r["recommended_order_qty"])
    rec = F.struct(quantity.alias("recommended_order_qty"), *[r[x].alias(x) for x in REC_COLS[1:]], r["parameters"].alias("parameters"), caveats.alias("caveats"), c("_plan").alias("schedule"))
    return inside.withColumn("rec", F.when(r.isNotNull(), rec)).drop("_r", "_ss", "q", "r", "s", "big_s", "_review", "_covered", "_plan")


def recommend(df: DataFrame, fc: DataFrame, freq: str, **settings) -> DataFrame:
    """Recommendation rows of the SKUs with a forecast."""
    t = recommended(settled(recommendation_base(df, fc, freq), freq, **settings), freq)
    return t.where("rec is not null").select("sku_id", "abc_class", "xyz_class", "policy_name", "on_hand", "rec.*")


def recommend_all(df: DataFrame, fc: DataFrame, freq: str, **settings) -> DataFrame:
    """Recommendation for every SKU, SKUs without a forecast as error rows."""
    t = recommended(settled(recommendation_base(df, fc, freq), freq, **settings), freq)
    gone = F.col("rec").isNull()
    return t.select("sku_id", "abc_class", "xyz_class", F.when(~gone, F.col("policy_name")).alias("policy_name"), "on_hand", "rec.*",
                    F.when(gone, F.when(F.col("n_obs") < 8, "no forecast: fewer than 8 observations").otherwise("no forecast")).alias("error"))


DELTAS = ("safety_stock", "expected_stockout_prob", "expected_fill_rate", "expected_holding_cost_annual",
          "expected_total_cost_annual", "recommended_order_qty")


def scenario(df: DataFrame, fc: DataFrame, freq: str, skus: DataFrame | None = None, **settings) -> DataFrame:
    """Base against changed settings with six differences: two projections of one row per SKU.

    With `skus`, one row for each of them, those without a result with an error."""
    base = recommendation_base(df, fc, freq)
    plain = base.columns
    keep = lambda t, name: t.select(*plain, "_ltd", *[c for c in t.columns if c.startswith("_at_")], F.col("rec").alias(name))
    t = keep(recommended(settled(base, freq), freq), "_at_base")
    t = keep(recommended(settled(t, freq, **settings), freq), "_at_scenario")
    out = t.where("_at_base is not null").select(
        "sku_id", *[F.col("_at_base")[c].alias(f"base_{c}") for c in DELTAS], *[F.col("_at_scenario")[c].alias(f"scenario_{c}") for c in DELTAS],
        *[(F.col("_at_scenario")[c] - F.col("_at_base")[c]).alias(f"delta_{c}") for c in DELTAS])
    if skus is None:
        return out
    return skus.select("sku_id").join(out, "sku_id", "left").withColumn("error", F.when(F.col("base_safety_stock").isNull(), "no history"))


def scenario_leadtime(df: DataFrame, fc: DataFrame, freq: str, skus: DataFrame, mult: float, **settings) -> DataFrame:
    """Scenario with multiplied lead times on a SKU list."""
    return scenario(df, fc, freq, skus, lead_mult=mult, **settings)


def frontier(inputs: DataFrame) -> DataFrame:
    """(Q,R) figures of each SKU at seven service levels from one distribution."""
    c = F.col
    t = inputs.drop("service_level").withColumn("service_level", F.explode(F.array(*[F.lit(x) for x in SERVICE_LEVELS])))
    r = qr_columns(c("p"), c("width"), c("ltd_mean"), c("annual_demand"), c("order_cost"), c("holding_cost"), c("service_level"))
    return t.select("sku_id", "service_level", "unit_cost", r.alias("_r")).select(
        "sku_id", "service_level", "_r.*", ((c("_r.q") / 2 + c("_r.safety_stock")) * c("unit_cost")).alias("inventory_value"))


def status_from_rec(rec: DataFrame) -> DataFrame:
    oh, rp = F.col("on_hand"), F.col("reorder_point")
    return rec.select("sku_id", F.when(oh <= 0, "order_now").when(oh <= rp, "order_now")
                      .when(F.col("expected_stockout_prob") >= 0.10, "at_risk")
                      .when(F.col("expected_fill_rate") < 0.95, "watch").otherwise("healthy").alias("status"))


def sku_header(df: DataFrame, fc: DataFrame) -> DataFrame:
    """Units of the last seven rows, of the next seven steps, and the summed half interval."""
    from .skus import sku_history
    last = sku_history(df, 7).groupBy("sku_id").agg(F.sum("demand").alias("last_7"))
    nxt = fc.where(F.col("step") <= 7).groupBy("sku_id").agg(
        F.sum("point").alias("next_7"), F.round(F.sum((F.col("q975") - F.col("q025")) / 2), 0).alias("interval_half"))
    return last.join(nxt, "sku_id")


def sku_insights(df: DataFrame, fc: DataFrame, rec: DataFrame) -> DataFrame:
    """Trend against the last seven rows, low fill and stockouts in the recommendation's own schedule."""
    outs = F.when(F.col("schedule").isNull(), 0).otherwise(F.size(F.filter("schedule", lambda e: e["stockout"])))
    h = sku_header(df, fc).join(rec.select("sku_id", "expected_fill_rate", outs.alias("stockouts")), "sku_id")
    l, n = F.col("last_7"), F.col("next_7")
    change = F.round(F.abs(n - l) / F.greatest(F.lit(1.0), l) * 100, 0)
    return h.select("sku_id", "stockouts",
                    F.when(n > l * 1.2, "higher").when((n < l * 0.8) & (l > 0), "lower").alias("trend"),
                    change.alias("change_pct"), (F.col("expected_fill_rate") < 0.95).alias("low_fill"))

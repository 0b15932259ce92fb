from pyspark.sql import functions as F

from ..functions.stats import r
from ..operators import forecast as fo, inventory as v, policies as po
from ..schema import QUANTILE_COLS, QUANTILE_LEVELS
from ..schema import PERIODS_PER_YEAR
from ..session import scratch_path
from ..sources import derived as d, files
from .forecast_queries import H, rq
from .lattice_sql import cells_sql, demand_cells, history_cells, level_sql, ss_sql
from .oracle import cte, gamma_ppf
from .registry import register
from .series_queries import bt, pm, rounded

N = 128
fc = lambda s, sf: fo.forecast_croston(pm(s, sf), H)
lt = lambda s, sf: po.lead_time_gamma(pm(s, sf))
cte("ltg", """select sku_id, case when n < 3 then 25.0 when v < 1e-9 then 1000.0 else m * m / v end as shape, case when n < 3 then 14.0 * 0.04 when v < 1e-9 then m / 1000.0 else v / m end as scale
  from (select sku_id, count(*) filter (lead_time_days > 0) as n, avg(lead_time_days) filter (lead_time_days > 0) as m, var_samp(lead_time_days) filter (lead_time_days > 0) as v from panel_pm group by 1)""")
register("lead_time_gamma", lambda s, sf: rounded(lt(s, sf)), "select sku_id, round(shape, 6) as shape, round(scale, 6) as scale from ltg")
register("gamma_summary", lambda s, sf: rounded(po.gamma_summary(lt(s, sf))), f"""
  select sku_id, round(shape * scale, 6) as mean, round(sqrt(shape) * scale, 6) as std, round({gamma_ppf('0.05', 'shape', 'scale')}, 6) as p5,
    round({gamma_ppf('0.95', 'shape', 'scale')}, 6) as p95 from ltg""")
_interp = "case " + " ".join(
    [f"when u <= {QUANTILE_LEVELS[0]} then {QUANTILE_COLS[0]}"]
    + [f"when u <= {hi} then {a} + ({b} - {a}) * (u - {lo}) / {hi - lo!r}" for lo, hi, a, b in
       zip(QUANTILE_LEVELS, QUANTILE_LEVELS[1:], QUANTILE_COLS, QUANTILE_COLS[1:])]) + f" else {QUANTILE_COLS[-1]} end"
_lat = "[" + ", ".join(repr(po.stride(k + 1)) for k in range(H)) + "]"
cte("grid_d", f"""select sku_id, step, cast(draw as integer) as draw, greatest(0.0, {_interp}) as demand from (
  select *, (0.5 + draw * ({_lat})[step]) - floor(0.5 + draw * ({_lat})[step]) as u from fc_cr, (select unnest(range(0, {N})) as draw))""")
register("demand_grid", lambda s, sf: rounded(po.demand_grid(fc(s, sf), N), 5), "select sku_id, step, draw, round(demand, 5) as demand from grid_d")
long_fc = lambda s, sf: fc(s, sf).where("step <= 2")
long_lt = lambda s, sf: lt(s, sf).withColumn("scale", F.col("scale") * 4)
cte("ltg_long", "select sku_id, shape, scale * 4 as scale from ltg")
cte("fc_short", "select * from fc_cr where step <= 2")
cells_sql("ltd", "fc_cr", "ltg", 30.0, 2)
cells_sql("ltl", "fc_short", "ltg_long", 30.0, 6)
for name, tag, frames in (("ltd_distribution", "ltd", (fc, lt)), ("ltd_beyond_horizon", "ltl", (long_fc, long_lt))):
    register(name, (lambda f: lambda s, sf: rounded(po.ltd_cells(po.ltd_distribution(f[0](s, sf), f[1](s, sf), "M")), 7))(frames),
             f"select sku_id, cell::integer as cell, round(cell * w, 7) as value, round(p, 7) as p, round(cum, 7) as cum from {tag}_cells where p > 1e-12")
    register(f"{name}_moments", (lambda f: lambda s, sf: rounded(po.ltd_distribution(f[0](s, sf), f[1](s, sf), "M").drop("p"), 6))(frames),
             f"select sku_id, round(w, 6) as width, round(ltd_mean, 6) as ltd_mean, round(ltd_std, 6) as ltd_std from {tag}_mom")


def policy_frame(s, sf):
    """Lead-time demand of each SKU with demand, cost and level inputs."""
    t = po.ltd_distribution(fc(s, sf), lt(s, sf), "M")
    st = v.sku_state(pm(s, sf)).select("sku_id", (F.col("mean_demand") * 12.0).alias("annual_demand"), F.lit(50.0).alias("order_cost"),
                                       (F.col("mean_cost") * 0.25).alias("holding_cost"), "mean_cost", "mean_price")
    return t.join(st, "sku_id").withColumn("service_level", po.implied_service_level(
        F.coalesce("mean_price", F.col("mean_cost") * 1.5), F.col("mean_cost"), F.col("holding_cost")))


cte("pf", """select sku_id, avg(demand) * 12.0 as annual_demand, 50.0::double as order_cost, avg(unit_cost) * 0.25 as holding_cost, avg(unit_cost) as mc, avg(unit_price) as mp,
  least(0.99, greatest(0.85, greatest(0.5, coalesce(avg(unit_price), avg(unit_cost) * 1.5) - avg(unit_cost)) / (greatest(0.5, coalesce(avg(unit_price), avg(unit_cost) * 1.5) - avg(unit_cost))
    + greatest(0.5, avg(unit_cost) * 0.25)))) as service_level from panel_pm group by 1""")
register("implied_service_level", lambda s, sf: policy_frame(s, sf).select("sku_id", r("service_level").alias("service_level")),
         "select sku_id, round(service_level, 6) as service_level from pf")
EOQ = "sqrt(2.0 * annual_demand * order_cost / holding_cost)"
register("eoq", lambda s, sf: rounded(po.eoq(policy_frame(s, sf)), 3), f"""
  select sku_id, round(q, 3) as q, round(annual_demand / q, 3) as expected_orders_per_year, round(q / 2 * holding_cost, 3) as expected_holding_cost_annual,
    round(annual_demand / q * order_cost, 3) as expected_order_cost_annual, round(q / 2 * holding_cost + annual_demand / q * order_cost, 3) as total_cost_annual
  from (select *, {EOQ} as q from pf where annual_demand > 0)""")
QR = """select f.sku_id, f.service_level, f.q, x.r, greatest(0.0, x.r - ltd_mean) as safety_stock, x.above as stockout_prob,
    case when ltd_mean > 0 then greatest(0.0, least(1.0, 1 - x.short / ltd_mean)) else 1.0 end as fill_rate,
    (f.q / 2 + greatest(0.0, x.r - ltd_mean)) * holding_cost as holding_cost_annual,
    (f.q / 2 + greatest(0.0, x.r - ltd_mean)) * holding_cost + annual_demand / f.q * order_cost as total_cost_annual, mc
  from (select *, {eoq} as q from {src} where annual_demand > 0) f join {lev} x on x.sku_id = f.sku_id and x.lv = f.service_level join {tag}_mom m on m.sku_id = f.sku_id"""
cte("qr", QR.format(eoq=EOQ, src="pf", lev=level_sql("service_level", "pf", "ltd"), tag="ltd"))
QRC = ("q", "r", "safety_stock", "stockout_prob", "fill_rate", "holding_cost_annual", "total_cost_annual")
register("qr_policy", lambda s, sf: rounded(po.qr_policy(policy_frame(s, sf)), 4), f"select sku_id, round(service_level, 4) as service_level, {rq(QRC, 4)} from qr")
cte("pf7", f"select pf.* exclude (service_level), unnest({list(po.SERVICE_LEVELS)}::double[]) as service_level from pf")
cte("front", QR.format(eoq=EOQ, src="pf7", lev=level_sql("service_level", "pf7", "ltd"), tag="ltd"))
register("frontier", lambda s, sf: rounded(po.frontier(policy_frame(s, sf).withColumnRenamed("mean_cost", "unit_cost")), 4),
         f"select sku_id, round(service_level, 4) as service_level, {rq(QRC, 4)}, round((q / 2 + safety_stock) * mc, 4) as inventory_value from front")
register("base_stock", lambda s, sf: rounded(po.base_stock(policy_frame(s, sf)), 5), f"""
  select x.sku_id, round(x.r, 5) as s_level, round(greatest(0.0, x.r - ltd_mean), 5) as safety_stock, round(above, 5) as stockout_prob
  from {level_sql('service_level', 'pf', 'ltd')} x join ltd_mom m on m.sku_id = x.sku_id""")
cte("nvp", "select *, greatest(0.01, coalesce(mp, mc * 1.5) - mc) / (greatest(0.01, coalesce(mp, mc * 1.5) - mc) + holding_cost) as cr, greatest(0.01, coalesce(mp, mc * 1.5) - mc) as cu from pf")
register("newsvendor", lambda s, sf: rounded(po.newsvendor(policy_frame(s, sf).withColumns({
    "underage": F.greatest(F.lit(0.01), F.coalesce("mean_price", F.col("mean_cost") * 1.5) - F.col("mean_cost")), "overage": F.col("holding_cost")})), 4), f"""
  select n.sku_id, round(n.cr, 4) as critical_ratio, round(x.r, 4) as q, round(short * cu, 4) as underage_cost, round(excess * holding_cost, 4) as overage_cost,
    round(short * cu + excess * holding_cost, 4) as total_cost from nvp n join {level_sql('cr', 'nvp', 'ltd')} x on x.sku_id = n.sku_id and x.lv = n.cr""")
register("newsvendor_hist", lambda s, sf: rounded(po.newsvendor_hist(bt(s, sf)), 4), """
  with c as (select sku_id, greatest(0.01, known_unit_price - known_unit_cost) as cu, greatest(0.01, known_unit_cost) as co, n_obs from state),
  o as (select sku_id, demand, row_number() over (partition by sku_id order by demand) - 1 as i from panel),
  e as (select *, cu / (cu + co) as cr, cu / (cu + co) * (n_obs - 1) as pos from c)
  select e.sku_id, round(any_value(cu), 4) as underage, round(any_value(co), 4) as overage, round(any_value(cr), 4) as critical_ratio,
    round(max(demand) filter (i = floor(pos)) + (max(demand) filter (i = ceil(pos)) - max(demand) filter (i = floor(pos))) * any_value(pos - floor(pos)), 4) as optimal_qty
  from e join o on o.sku_id = e.sku_id group by 1""")


def econ_skus(s, sf):
    k = F.col("k")
    return d.table(s, sf, "part").groupBy(d._brand_type().alias("sku_id")).agg(F.max("p_size").alias("k")).select(
        "sku_id", F.when(k % 4 == 0, "FOODS_2").when(k % 4 == 1, "hobbies_x").when(k % 4 == 2, "misc").alias("category"))


_econ = ", ".join(f"('{k}', {a}::double, {b}::double, {c}::double, {e}::double, {str(f).lower()}, {g}::double)" for k, (a, b, c, e, f, g) in po.ECONOMICS.items())
register("category_economics", lambda s, sf: po.category_economics(econ_skus(s, sf)), f"""
  with t as (select * from (values {_econ}) t(k, holding_cost_rate, order_cost_default, markup_default, default_lead_time, perishable, review_days)),
  s as (select upper(p_brand || '|' || p_type) as sku_id, max(p_size) as z from part group by 1),
  c as (select sku_id, case when z % 4 = 0 then 'FOODS_2' when z % 4 = 1 then 'hobbies_x' when z % 4 = 2 then 'misc' end as category from s)
  select sku_id, category, t.k as matched, t.* exclude (k) from c join t on t.k = case when category = 'FOODS_2' then 'FOODS_2' when category = 'hobbies_x' then 'HOBBIES_1' else '_default' end""")
register("select_policy", lambda s, sf: po.select_policy(po.category_economics(econ_skus(s, sf))).select("sku_id", "policy_name"), """
  select upper(p_brand || '|' || p_type) as sku_id, case when max(p_size) % 4 = 0 then 'newsvendor' else '(s,S)' end as policy_name from part group by 1""")


def ss_frame(s, sf):
    st = v.sku_state(bt(s, sf)).select("sku_id", (F.col("mean_demand") * 52).alias("annual_demand"), (F.col("mean_cost") * 0.25).alias("holding_cost"),
                                       F.lit(50.0).alias("order_cost"), F.rint(F.col("lt_mean") / 7).cast("int").alias("lead_periods"))
    return fo.to_series(bt(s, sf)).join(st, "sku_id").withColumns({
        "lead_periods": F.greatest(F.lit(1), "lead_periods"), "review_periods": F.lit(2), "service_level": F.lit(0.95)})


cte("ssf", """select state.sku_id, mean_demand * 52 as annual_demand, mean_cost * 0.25 as holding_cost, 50.0::double as order_cost, 0.95::double as service_level,
  greatest(1, cast(round_even(lt_mean / 7, 0) as integer)) as lead, 2 as review, mean_demand as mean from state""")
history_cells("ss_h", "ssf", "panel")
ss_sql("ss_best", "ssf", "ss_h", 52.0)
register("ss_backtest", lambda s, sf: rounded(po.ss_history(ss_frame(s, sf)), 5),
         f"select sku_id, {rq(('s', 'big_s', 'stockout_prob', 'fill_rate', 'cost'), 5)} from ss_best")


def schedule_frame(s, sf):
    """Twelve steps of mean demand per SKU with policy levels from its own moments."""
    st = v.sku_state(bt(s, sf))
    m = F.col("mean_recent")
    return st.where(m > 0).select(
        "sku_id", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: m).alias("point"), F.col("known_on_hand").alias("on_hand"),
        F.col("lt_mean").alias("lead_time_days"), F.col("date_max").alias("start_date"), (m * 4).alias("q"), (m * 2).alias("r"),
        (m * 2).alias("s"), (m * 6).alias("big_s"), F.lit(2).alias("review_periods"), (m * 5).alias("s_level"))


cte("scf", """select sku_id, mean_recent as m, known_on_hand as oh, greatest(1, cast(round_even(lt_mean / 7.0, 0) as integer)) as lead, date_max from state where mean_recent > 0""")
# the three schedules by recursion over periods, open orders as a list of arrivals
RULES = {"qr": ("case when stock <= 2 * m and due[t + lead + 1] = 0 then 4 * m else 0.0 end", "'on-hand ' || {stock} || ' ≤ R=' || {two}"),
         "ss": ("case when t % 2 = 0 and stock <= 2 * m then greatest(0.0, 6 * m - stock - list_sum(due)) else 0.0 end", "'review @ t=' || t || ': on-hand ' || {stock} || ' ≤ s=' || {two} || ', order to S=' || {six}"),
         "base_stock": ("case when stock <= 5 * m - 1 then greatest(0.0, 5 * m - stock - list_sum(due)) else 0.0 end", "'review @ t=' || t || ': on-hand ' || {stock} || ' ≤ s=' || {low} || ', order to S=' || {five}")}
_whole = lambda x: f"printf('%.0f', round({x}, 0))"
for key, (want, reason) in RULES.items():
    said = reason.format(stock=_whole("stock"), two=_whole("2 * m"), six=_whole("6 * m"), five=_whole("5 * m"), low=_whole("5 * m - 1"))
    cte(f"sched_{key}", f"""with recursive g as (select sku_id, m, lead, date_max, -1 as t, oh as stock, 0.0::double as left_, 0.0::double as got, false as out, 0.0::double as qty, [0.0 for x in range(0, 12)]::double[] as due from scf
      union all select sku_id, m, lead, date_max, t, stock, left_, got, out, qty, list_transform(due, lambda d, i: case when i = t + lead + 1 then d + qty else d end) from (
        select *, case when got > 0 or t + lead >= 12 then 0.0 else {want} end as qty from (
          select sku_id, m, lead, date_max, t + 1 as t, greatest(0.0, stock - m) as left_, greatest(0.0, stock - m) + due[t + 2] as stock, due[t + 2] as got, stock < m as out, list_transform(due, lambda d, i: case when i = t + 2 then 0.0 else d end) as due
          from g where t < 11)))
      select sku_id, cast(t as integer) as period_idx, case when got > 0 then 'delivery' when qty > 0 then 'order' else 'no_op' end as action, qty, left_ as after_demand, stock as after_delivery,
        case when qty > 0 then cast(t + lead as integer) end as arrival_idx, out as stockout, case when got > 0 then 'delivery of ' || {_whole('got')} || ' units' when qty > 0 then {said} end as reason,
        date_max + cast(t * 7 as integer) as date, case when qty > 0 then date_max + cast((t + lead) * 7 as integer) end as expected_arrival from g where t >= 0""")
for mode in ("QR", "sS", "base_stock"):
    key = mode.lower()
    register(f"schedule_{key}", (lambda m: lambda s, sf: rounded(po.schedule(schedule_frame(s, sf), m, "W"), 4))(mode),
             f"select * replace (round(qty, 4) as qty, round(after_demand, 4) as after_demand, round(after_delivery, 4) as after_delivery) from sched_{key}")
register("schedule_totals", lambda s, sf: rounded(po.schedule_totals(po.schedule(schedule_frame(s, sf), "QR", "W")), 4), """
  select sku_id, count(*) filter (action = 'order') as n_orders, round(coalesce(sum(qty) filter (action = 'order'), 0.0), 4) as total_units_ordered, count(*) filter (stockout) as expected_stockout_periods from sched_qr group by 1""")
# (Q,R) with at most one open slot per arrival period: the pending orders are a list of arrival periods
cte("sq", """with recursive g as (select sku_id, m, lead, -1 as t, oh as stock, []::integer[] as due, 'start' as action, 0.0::double as qty from scf
  union all select sku_id, m, lead, t, got_stock, case when act = 'order' then list_append(left_due, t + lead) else left_due end, act, case when act = 'order' then 4 * m else 0.0 end from (
    select *, case when got > 0 then 'delivery' when got_stock <= 2 * m and t + lead < 12 and not list_contains(left_due, t + lead) then 'order' else 'no_op' end as act from (
      select sku_id, m, lead, t + 1 as t, greatest(0.0, stock - m) + case when list_contains(due, t + 1) then 4 * m else 0.0 end as got_stock,
        case when list_contains(due, t + 1) then 1 else 0 end as got, list_filter(due, lambda x: x <> g.t + 1) as left_due from g where t < 11)))
  select sku_id, t as period_idx, action, qty, stock from g where t >= 0""")
register("schedule_qr_check", lambda s, sf: rounded(po.schedule(schedule_frame(s, sf), "QR", "W").select(
    "sku_id", "period_idx", "action", "qty", F.col("after_delivery").alias("stock")), 4),
    "select sku_id, cast(period_idx as integer) as period_idx, action, round(qty, 4) as qty, round(stock, 4) as stock from sq")


# ---- recommendations ----------------------------------------------------------------------
# monthly panel and its Croston forecast; every sixth type is perishable, every third falls to the default economics
TYPES = "case when abs(hash) % 6 = 0 then 'FOODS_2' when abs(hash) % 6 < 4 then 'HOBBIES_1' else 'misc' end"


def rec_panel(s, sf):
    kind = F.conv(F.substring(F.md5("sku_id"), 1, 8), 16, 10).cast("long") % 6
    return pm(s, sf).withColumn("category", F.when(kind == 0, "FOODS_2").when(kind < 4, "HOBBIES_1").otherwise("misc"))


def rec_sql(tag, service_level="null", holding_rate="0.25", order_cost="50.0", policy="null", lead_mult=None):
    """CTE rec_<tag>: recommendation of every SKU of the monthly panel."""
    shape, scale = ("case when lt_all is null then shape0 else 25.0 end", "coalesce(greatest(1e-3, lt_all * {m} * 0.04), scale0)") if lead_mult else ("shape0", "scale0")
    under = "greatest(0.5, unit_price - unit_cost)"
    cte(f"rf_{tag}", f"""select * exclude (n, m, v), greatest(1, cast(round_even(shape * scale / 30.0, 0) as integer)) as lead, coalesce({service_level}::double, least(0.99, greatest(0.85, {under} / ({under} + greatest(0.5, holding_cost))))) as service_level,
        unit_cost as mc, case when unit_price - unit_cost <= 0 then 1.0 else unit_price - unit_cost end as cu from (
      select *, {shape.format(m=lead_mult)} as shape, {scale.format(m=lead_mult)} as scale, coalesce(price, unit_cost * markup) as unit_price, {holding_rate}::double * unit_cost as holding_cost, {order_cost}::double as order_cost,
        coalesce({policy}, case when perishable then 'newsvendor' else '(s,S)' end) as policy_name from (
      select *, case when n < 3 then 25.0 when v < 1e-9 then 1000.0 else m * m / v end as shape0, case when n < 3 then dlt * 0.04 when v < 1e-9 then m / 1000.0 else v / m end as scale0,
          coalesce(cost, 1.0) as unit_cost, annual * 12.0 as annual_demand from (
        select b.*, f.annual, f.mean, case when kind = 0 then 1.45 when kind < 4 then 1.6 else 1.5 end as markup, case when kind = 0 then 4.0 else 14.0 end as dlt, kind = 0 as perishable, case when kind < 4 then 7.0 else 14.0 end as rv,
            greatest(1, cast(round_even(case when kind < 4 then 7.0 else 14.0 end / 30.0, 0) as integer)) as review
        from (select sku_id, any_value(('0x' || substr(md5(sku_id), 1, 8))::bigint % 6) as kind, avg(unit_cost) as cost, avg(unit_price) as price, coalesce(arg_max(on_hand, date) filter (on_hand is not null), 0.0) as on_hand, avg(lead_time_days) as lt_all,
            count(*) filter (lead_time_days > 0) as n, avg(lead_time_days) filter (lead_time_days > 0) as m, var_samp(lead_time_days) filter (lead_time_days > 0) as v, max(date) as start_date from panel_pm group by 1) b
        join rec_fc f on f.sku_id = b.sku_id)))""")
    cells_sql(f"rl_{tag}", "fc_cr", f"rf_{tag}", 30.0, 3)
    demand_cells(f"rd_{tag}", f"rf_{tag}", "fc_cr")
    cte(f"rfs_{tag}", f"select * from rf_{tag} where policy_name = '(s,S)'")
    ss_sql(f"rs_{tag}", f"rfs_{tag}", f"rd_{tag}", 12.0)
    cte(f"rlv_{tag}", f"select *, case when policy_name = 'newsvendor' then cu / (cu + holding_cost) else service_level end as lv0 from rf_{tag}")
    cte(f"rec_{tag}", f"""select *, case when policy_name in ('(Q,R)', '(s,S)', 'base-stock') and on_hand > reorder_point then 0.0 else qty0 end as recommended_order_qty,
        policy_name in ('(Q,R)', '(s,S)', 'base-stock') and on_hand > reorder_point as covered from (
      select f.sku_id, policy_name, on_hand, start_date, lead, review, unit_price, unit_cost, ss.s, ss.big_s, q, x.r,
        case policy_name when '(Q,R)' then q when 'EOQ' then q when '(s,S)' then greatest(0.0, ss.big_s - on_hand) else x.r end as qty0,
        case policy_name when '(s,S)' then ss.s when 'EOQ' then null else x.r end as reorder_point,
        case policy_name when '(s,S)' then greatest(0.0, ss.s - ltd_mean) when '(Q,R)' then greatest(0.0, x.r - ltd_mean) when 'base-stock' then greatest(0.0, x.r - ltd_mean) else 0.0 end as safety_stock,
        case policy_name when '(s,S)' then ss.stockout_prob when 'EOQ' then 0.0 else above end as expected_stockout_prob,
        case policy_name when '(s,S)' then ss.fill_rate when 'EOQ' then 1.0 when 'base-stock' then 1 - above when '(Q,R)' then case when ltd_mean > 0 then greatest(0.0, least(1.0, 1 - short / ltd_mean)) else 1.0 end
          else greatest(0.0, least(1.0, 1 - short / greatest(1e-9, ltd_mean))) end as expected_fill_rate,
        case policy_name when '(s,S)' then (ss.big_s / 2 + greatest(0.0, ss.s - ltd_mean)) * holding_cost when '(Q,R)' then (q / 2 + greatest(0.0, x.r - ltd_mean)) * holding_cost when 'EOQ' then q / 2 * holding_cost
          when 'base-stock' then x.r * holding_cost else 0.0 end as expected_holding_cost_annual,
        case policy_name when '(s,S)' then (ss.big_s / 2 + greatest(0.0, ss.s - ltd_mean)) * holding_cost + annual_demand / greatest(1.0, ss.big_s - ss.s) * order_cost
          when '(Q,R)' then (q / 2 + greatest(0.0, x.r - ltd_mean)) * holding_cost + annual_demand / q * order_cost when 'EOQ' then q / 2 * holding_cost + annual_demand / q * order_cost
          when 'base-stock' then x.r * holding_cost else short * cu + excess * holding_cost end as expected_total_cost_annual
      from (select *, case when annual_demand > 0 then sqrt(2.0 * annual_demand * order_cost / holding_cost) end as q from rlv_{tag}) f
      join rl_{tag}_mom m on m.sku_id = f.sku_id join {level_sql('lv0', f'rlv_{tag}', f'rl_{tag}')} x on x.sku_id = f.sku_id left join rs_{tag} ss on ss.sku_id = f.sku_id)""")


cte("rec_fc", f"""select sku_id, avg(point) as annual, avg({" + ".join(
    [f"greatest(0.0, q[1]) * {QUANTILE_LEVELS[0]}", f"greatest(0.0, q[5]) * {1.0 - QUANTILE_LEVELS[-1]!r}"]
    + [f"(case when q[{i + 2}] <= 0 then 0.0 when q[{i + 1}] >= 0 then (q[{i + 1}] + q[{i + 2}]) / 2 else q[{i + 2}] * q[{i + 2}] / (2 * (q[{i + 2}] - q[{i + 1}])) end) * {b - a!r}"
       for i, (a, b) in enumerate(zip(QUANTILE_LEVELS, QUANTILE_LEVELS[1:]))])}) as mean
  from (select *, list_sort([{", ".join(QUANTILE_COLS)}]) as q from fc_cr) group by 1""")
rec_sql("main")
rec_sql("qr", policy="'(Q,R)'")
rec_sql("alt", service_level="0.99", policy="'base-stock'")
rec_sql("lead", lead_mult=1.5)
rec_sql("eoq", policy="'EOQ'")
NUM = po.REC_COLS


def flat(rec):
    """Recommendation rows without the nested columns."""
    return rounded(rec.drop("parameters", "schedule"), 4).withColumn("caveats", F.array_join("caveats", "; "))


# the schedule of a recommendation: state by period in plain recursion; at most twelve periods
for tag in ("main", "qr"):
    cte(f"rp_{tag}", f"select sku_id, list(point order by step) as point from fc_cr group by 1")
    cte(f"sch_{tag}", f"""with recursive g as (select sku_id, -1 as t, on_hand as stock, [0.0 for x in range(0, len(point))]::double[] as due, false as stockout, 0.0::double as qty, point, lead, review, policy_name, s, big_s, q, r
        from rec_{tag} join rp_{tag} using (sku_id) where policy_name in ('(Q,R)', '(s,S)')
      union all select sku_id, t, stock, list_transform(due, lambda d, i: case when i = t + lead + 1 then d + qty when i = t + 1 then 0.0 else d end), stockout, qty, point, lead, review, policy_name, s, big_s, q, r from (
        select *, case when got > 0 or t + lead >= len(point) then 0.0 when policy_name = '(Q,R)' then case when stock <= r and due[t + lead + 1] = 0 then q else 0.0 end
            when t % review = 0 and stock <= s then greatest(0.0, big_s - stock - (list_sum(due) - due[t + 1])) else 0.0 end as qty from (
          select sku_id, t + 1 as t, greatest(0.0, stock - point[t + 2]) + due[t + 2] as stock, due[t + 2] as got, due, stock < point[t + 2] as stockout, point, lead, review, policy_name, s, big_s, q, r
          from g where t + 1 < len(point))))
      select sku_id, count(*) filter (stockout) as outs, max(t) + 1 as periods, count(*) filter (qty > 0) as orders, sum(qty) as units from g where t >= 0 group by 1""")
    cte(f"recs_{tag}", f"""select r.*, coalesce(outs, 0) as outs, coalesce(orders, 0) as orders, coalesce(units, 0.0) as units, concat_ws('; ',
        case when policy_name = 'newsvendor' and unit_price - unit_cost <= 0 then 'price <= cost: underage cost is not positive, a floor of 1 is used.' end,
        case when covered then 'on-hand ' || printf('%.0f', round(on_hand, 0)) || ' > reorder point ' || printf('%.0f', round(reorder_point, 0)) || '; no order needed now.' end,
        case when outs > 0 then 'projected schedule has ' || outs || ' stockout periods out of ' || periods || '; consider higher service level or shorter lead time.' end) as caveats
      from rec_{tag} r left join sch_{tag} h on h.sku_id = r.sku_id""")

cte("abc_pm", """select sku_id, case when share <= 0.8 then 'A' when share <= 0.95 then 'B' else 'C' end as abc_class, case when cv < 0.5 then 'X' when cv < 1.0 then 'Y' else 'Z' end as xyz_class from (
  select *, sum(rev) over (order by rev desc, sku_id rows unbounded preceding) / sum(rev) over () as share from (
    select sku_id, coalesce(sum(demand * coalesce(unit_price, unit_cost, 1.0)), 0.0) / count(*) * 12.0 as rev, case when coalesce(avg(demand), 0) = 0 then 0.0 else coalesce(stddev_samp(demand), 0.0) / avg(demand) end as cv
    from panel_pm group by 1))""")
# every ninth SKU has no forecast
some_fc = lambda s, sf: fc(s, sf).where(F.conv(F.substring(F.md5("sku_id"), 1, 8), 16, 10).cast("long") % 9 > 0)
register("recommend_all", lambda s, sf: flat(po.recommend_all(rec_panel(s, sf), some_fc(s, sf), "M")), f"""
  select c.sku_id, abc_class, xyz_class, case when has then policy_name end as policy_name, round(on_hand, 4) as on_hand, {", ".join(f"case when has then round({x}, 4) end as {x}" for x in NUM)},
    case when has then caveats end as caveats, case when not has then 'no forecast' end as error
  from (select *, ('0x' || substr(md5(sku_id), 1, 8))::bigint % 9 > 0 as has from recs_main) r join abc_pm c on c.sku_id = r.sku_id""")
register("recommend_policies", lambda s, sf: flat(po.recommend(rec_panel(s, sf), fc(s, sf), "M", policy="(Q,R)")), f"""
  select c.sku_id, abc_class, xyz_class, policy_name, round(on_hand, 4) as on_hand, {rq(NUM, 4)}, caveats from recs_qr r join abc_pm c on c.sku_id = r.sku_id""")
register("recommend_eoq", lambda s, sf: rounded(po.recommend(rec_panel(s, sf), fc(s, sf), "M", policy="EOQ").select("sku_id", *NUM), 4),
         f"select sku_id, {rq(NUM, 4)} from rec_eoq")
register("recommendation_schedules", lambda s, sf: rounded(po.recommend(rec_panel(s, sf), fc(s, sf), "M").where("schedule is not null").select(
    "sku_id", F.size(F.filter("schedule", lambda e: e["qty"] > 0)).cast("long").alias("orders"), F.aggregate("schedule", F.lit(0.0), lambda t, e: t + e["qty"]).alias("units"),
    F.size(F.filter("schedule", lambda e: e["stockout"])).cast("long").alias("outs")), 4),
    "select sku_id, orders, round(units, 4) as units, outs from recs_main where policy_name <> 'newsvendor'")


def deltas_sql(a, b):
    return ", ".join(f"round(a.{x}, 4) as base_{x}, round(b.{x}, 4) as scenario_{x}, round(b.{x} - a.{x}, 4) as delta_{x}" for x in po.DELTAS)


register("scenario", lambda s, sf: rounded(po.scenario(rec_panel(s, sf), fc(s, sf), "M", service_level=0.99, policy="base-stock"), 4),
         f"select a.sku_id, {deltas_sql('main', 'alt')} from rec_main a join rec_alt b on b.sku_id = a.sku_id")


def asked(s, sf):
    """All SKUs of the panel and as many that are not in it."""
    known = pm(s, sf).select("sku_id").distinct()
    return known.unionByName(known.select(F.concat("sku_id", F.lit("-OLD")).alias("sku_id")))


register("scenario_leadtime", lambda s, sf: rounded(po.scenario_leadtime(rec_panel(s, sf), fc(s, sf), "M", asked(s, sf), 1.5), 4), f"""
  with k as (select distinct sku_id from panel_pm), l as (select sku_id from k union all select sku_id || '-OLD' from k)
  select l.sku_id, {deltas_sql('main', 'lead')}, case when a.sku_id is null then 'no history' end as error from l left join rec_main a on a.sku_id = l.sku_id left join rec_lead b on b.sku_id = l.sku_id""")


def _export_recs(s, sf):
    path = scratch_path(s, "recommendations")
    files.write_csv(flat(po.recommend_all(rec_panel(s, sf), some_fc(s, sf), "M")), path)
    back = s.read.csv(path, header=True)
    return back.select(*[F.col(c).cast("double").alias(c) if c in NUM + ("on_hand",) else F.col(c) for c in back.columns])


register("export_recommendations", _export_recs, f"""
  select c.sku_id, abc_class, xyz_class, case when has then policy_name end as policy_name, round(on_hand, 4) as on_hand, {", ".join(f"case when has then round({x}, 4) end as {x}" for x in NUM)},
    case when has and caveats <> '' then caveats end as caveats, case when not has then 'no forecast' end as error
  from (select *, ('0x' || substr(md5(sku_id), 1, 8))::bigint % 9 > 0 as has from recs_main) r join abc_pm c on c.sku_id = r.sku_id""")
register("status_from_rec", lambda s, sf: po.status_from_rec(po.recommend(rec_panel(s, sf), fc(s, sf), "M", policy="(Q,R)")), """
  select sku_id, case when on_hand <= 0 or on_hand <= reorder_point then 'order_now' when expected_stockout_prob >= 0.10 then 'at_risk' when expected_fill_rate < 0.95 then 'watch' else 'healthy' end as status from rec_qr""")
cte("hdr", """select a.sku_id, last_7, sum(point) as next_7, round(sum((q975 - q025) / 2), 0) as interval_half from (
    select sku_id, sum(demand) as last_7 from ser where rn >= n - 7 group by 1) a join fc_cr f on f.sku_id = a.sku_id group by 1, 2""")
register("sku_header", lambda s, sf: rounded(po.sku_header(pm(s, sf), fc(s, sf)), 3), "select sku_id, last_7, round(next_7, 3) as next_7, interval_half from hdr")
register("sku_insights", lambda s, sf: po.sku_insights(pm(s, sf), fc(s, sf), po.recommend(rec_panel(s, sf), fc(s, sf), "M")).withColumn("stockouts", F.col("stockouts").cast("long")), """
  select r.sku_id, case when policy_name = 'newsvendor' then 0 else outs end as stockouts, case when next_7 > last_7 * 1.2 then 'higher' when next_7 < last_7 * 0.8 and last_7 > 0 then 'lower' end as trend,
    round(abs(next_7 - last_7) / greatest(1.0, last_7) * 100, 0) as change_pct, expected_fill_rate < 0.95 as low_fill from recs_main r join hdr h on h.sku_id = r.sku_id""")

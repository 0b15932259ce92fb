from pyspark.sql import functions as F

from ..functions.stats import r
from ..operators import inventory as v
from ..sources import derived as d
from .oracle import cte, hash8, phi, ppf
from .registry import register
from .series_queries import bt, pm, rounded

AS_OF = "2001-12-31"
sup = d.suppliers

cte("abc_raw", """select sku_id, coalesce(sum(demand * coalesce(unit_price, unit_cost, 1.0)), 0.0) / count(*) * 52.0 as revenue_annual,
  case when coalesce(avg(demand), 0) = 0 then 0.0 else coalesce(stddev_samp(demand), 0.0) / avg(demand) end as cv_demand from panel group by 1""")
cte("abc", """select sku_id, case when share <= 0.8 then 'A' when share <= 0.95 then 'B' else 'C' end as abc_class,
    case when cv_demand < 0.5 then 'X' when cv_demand < 1.0 then 'Y' else 'Z' end as xyz_class, revenue_annual, cv_demand, revenue_share from (
  select *, sum(revenue_annual) over (order by revenue_annual desc, sku_id rows unbounded preceding) / sum(revenue_annual) over () as share,
    revenue_annual / greatest(sum(revenue_annual) over (), 1e-9) as revenue_share from abc_raw)""")
abc = lambda s, sf: v.abc_xyz(bt(s, sf), 52.0)
register("abc_xyz", lambda s, sf: abc(s, sf).withColumns({"revenue_annual": r("revenue_annual", 2), "cv_demand": r("cv_demand"), "revenue_share": r("revenue_share", 8)}),
         "select sku_id, abc_class, xyz_class, round(revenue_annual, 2) as revenue_annual, round(cv_demand, 6) as cv_demand, round(revenue_share, 8) as revenue_share from abc")
register("abc_xyz_heatmap", lambda s, sf: v.abc_xyz_heatmap(abc(s, sf)), """
  select a || x as cell, count(sku_id) as n_skus from (values ('A'), ('B'), ('C')) t(a), (values ('X'), ('Y'), ('Z')) u(x)
  left join abc on abc_class = a and xyz_class = x group by 1""")
_mig = """select sku_id, case when sum(rv) over (order by rv desc, sku_id rows unbounded preceding) / sum(rv) over () <= 0.8 then 'A'
    when sum(rv) over (order by rv desc, sku_id rows unbounded preceding) / sum(rv) over () <= 0.95 then 'B' else 'C' end as cls from (
  select sku_id, sum(demand * coalesce(unit_price, 0)) as rv from panel where {w} group by 1)"""
cte("mig_recent", _mig.format(w="date > (select max(date) from panel) - 90"))
cte("mig_prior", _mig.format(w="date > (select max(date) from panel) - 180 and date <= (select max(date) from panel) - 90"))
cte("migration", "select r.sku_id, r.cls as abc_recent, p.cls as abc_prior from mig_recent r join mig_prior p on p.sku_id = r.sku_id where r.cls < p.cls")
register("abc_migration", lambda s, sf: v.abc_migration(bt(s, sf)), "select * from migration")

cte("back", "select *, row_number() over (partition by sku_id order by date desc) as back from panel")
cte("state", """select sku_id, count(*) as n_obs, min(date) as date_min, max(date) as date_max, avg(demand) as mean_demand, sum(demand) as sum_demand,
    avg(demand) filter (back <= 13) as mean_recent, stddev_pop(demand) filter (back <= 13) as std_recent, avg(demand) filter (back <= 8) as mean_last8,
    max(demand) filter (back = 1) as last_demand, max(on_hand) filter (back = 1) as last_on_hand, max(unit_cost) filter (back = 1) as last_unit_cost,
    max(unit_price) filter (back = 1) as last_unit_price, max(lead_time_days) filter (back = 1) as last_lead_time_days,
    max(supplier) filter (back = 1) as last_supplier, max(category) filter (back = 1) as last_category,
    arg_max(unit_cost, date) filter (unit_cost is not null) as known_unit_cost, arg_max(unit_price, date) filter (unit_price is not null) as known_unit_price,
    arg_max(on_hand, date) filter (on_hand is not null) as known_on_hand,
    arg_max(lead_time_days, date) filter (lead_time_days is not null) as known_lead_time_days,
    avg(unit_cost) as mean_cost, avg(unit_price) as mean_price,
    count(lead_time_days) as lt_n, avg(lead_time_days) as lt_mean, stddev_pop(lead_time_days) as lt_std from back group by 1""")
register("latest_by_sku", lambda s, sf: v.latest_by_sku(bt(s, sf)), """
  select sku_id, date_max, last_demand, last_on_hand, last_supplier, last_category, known_unit_cost,
    known_unit_price, known_on_hand from state""")


def moments_cte(name, lt_mult, d_mult, floor_std, period=7.0):
    sd = "greatest(0.5, std_recent)" if floor_std else "case when std_recent = 0 then greatest(0.5, mean_recent * 0.1) else std_recent end"
    cte(name, f"""select *, (case when known_on_hand is null then 0.0 else 1.0 - {phi('z')} end) as stockout_prob,
        case when mean_d / {period} > 0 then known_on_hand / (mean_d / {period}) end as days_of_cover from (
      select *, (known_on_hand - ltd_mean) / greatest(ltd_std, 1e-6) as z from (
      select *, lt_periods * mean_d as ltd_mean, sqrt(greatest(lt_periods * std_d * std_d + mean_d * mean_d * (lt_std_used / {period}) ** 2, 1e-9)) as ltd_std from (
        select *, mean_recent * {d_mult} as mean_d, {sd} * {d_mult} as std_d, greatest(1.0, lt / {period}) as lt_periods,
          case when lt_n > 0 then case when lt_n > 1 then lt_std else greatest(lt * 0.2, 0.5) end
            when default_lead_time_days is not null then coalesce(lead_time_std_days, greatest(lt * 0.2, 0.5)) else 2.8 end as lt_std_used from (
          select state.*, s.supplier_id, s.default_lead_time_days, s.lead_time_std_days, s.moq, s.case_pack,
            coalesce(lt_mean, default_lead_time_days, 14.0) * {lt_mult} as lt from state left join suppliers s on s.name = state.last_supplier))))""")


moments_cte("mom", 1.0, 1.0, False)
moments_cte("exp_base", 1.0, 1.0, True)
moments_cte("exp_shock", 1.5, 1.25, True)
register("lead_time_moments", lambda s, sf: rounded(v.lead_time_moments(bt(s, sf), sup(s, sf))),
         "select sku_id, round(lt, 6) as lead_time_mean, round(lt_std_used, 6) as lead_time_std from mom")
register("ltd_moments", lambda s, sf: rounded(v.ltd_moments(bt(s, sf), sup(s, sf), "W")), """
  select sku_id, round(mean_d, 6) as mean_d, round(std_d, 6) as std_d, round(lt_periods, 6) as lt_periods, round(ltd_mean, 6) as ltd_mean,
    round(ltd_std, 6) as ltd_std from mom""")
SDATE = f"case when known_on_hand <= 0 then date '{AS_OF}' when days_of_cover <= 365 then date '{AS_OF}' + cast(floor(days_of_cover) as integer) end"
register("stockout_risk", lambda s, sf: rounded(v.stockout_risk(bt(s, sf), sup(s, sf), "W", AS_OF)), f"""
  select sku_id, round(stockout_prob, 6) as stockout_prob, round(days_of_cover, 6) as days_of_cover, {SDATE} as projected_stockout_date from mom""")


def round_sql(raw, strict=False):
    pk = lambda q: f"(case when case_pack > 0 then ceil({q} / case_pack) * case_pack else {q} end)"
    return (f"(case when not ({raw} > 0) or {raw} is null then 0.0 when moq > 0 and {pk(raw)} < moq then {pk('moq') if strict else 'moq'} "
            f"else {pk(raw)} end)::double")


register("round_qty", lambda s, sf: sup(s, sf).select(
    "supplier_id", v.round_qty(F.col("default_lead_time_days") * 3.3, F.col("moq"), F.col("case_pack")).alias("queue_form"),
    v.round_qty(F.col("default_lead_time_days") * 3.3, F.col("moq"), F.col("case_pack"), True).alias("plan_form")), f"""
  select supplier_id, {round_sql('(default_lead_time_days * 3.3)')} as queue_form, {round_sql('(default_lead_time_days * 3.3)', True)} as plan_form from suppliers""")
cte("cand", f"""select *, recommended_qty * unit_cost as total_cost, stockout_prob * revenue_at_risk as score,
    stockout_prob > 0.3 and revenue_at_risk > recommended_qty * case when unit_cost > 0 then unit_cost * 0.5 else 0.0 end as expedite_flag,
    {SDATE} as projected_stockout_date from (
  select *, stockout_prob * mean_d * coalesce(known_unit_price, unit_cost * 1.5) * lt_periods as revenue_at_risk,
    {round_sql('raw')} as recommended_qty from (
    select *, coalesce(known_unit_cost, 1.0) as unit_cost, greatest(0.0, ltd_mean + 1.65 * ltd_std - known_on_hand) as raw from mom
    where n_obs >= 4 and known_on_hand is not null and (days_of_cover is null or days_of_cover <= 30)))
  where recommended_qty > 0""")
cte("queue", f"""select q.*, coalesce(a.abc_class, 'C') as abc_class, coalesce(a.xyz_class, 'Z') as xyz_class,
    ltd_mean + {ppf('0.95')} * ltd_std as reorder_point
  from cand q left join abc a on a.sku_id = q.sku_id""")
queue = lambda s, sf: v.reorder_queue(bt(s, sf), sup(s, sf), "W", AS_OF)
register("expedite_flags", lambda s, sf: v.reorder_candidates(bt(s, sf), sup(s, sf), "W", AS_OF).select(
    "sku_id", "expedite_flag", r("expedite_breakeven").alias("expedite_breakeven")),
    "select sku_id, expedite_flag, round(unit_cost * 0.5, 6) as expedite_breakeven from cand")
QCOLS = ("on_hand", "reorder_point", "recommended_qty", "unit_cost", "total_cost", "days_of_cover", "stockout_prob", "revenue_at_risk", "score")
register("reorder_queue", lambda s, sf: rounded(rounded(queue(s, sf).drop("recommended_qty_raw", "expedite_breakeven", "joint_replen_group"), 3, skip=("days_of_cover",)), 6), """
  select sku_id, last_category as category, last_supplier as supplier_name, supplier_id, round(known_on_hand, 3) as on_hand, round(reorder_point, 3) as reorder_point,
    round(recommended_qty, 3) as recommended_qty, round(unit_cost, 3) as unit_cost, round(total_cost, 3) as total_cost, projected_stockout_date,
    round(days_of_cover, 6) as days_of_cover, round(stockout_prob, 3) as stockout_prob, round(revenue_at_risk, 3) as revenue_at_risk,
    round(score, 3) as score, expedite_flag, moq, case_pack, abc_class, xyz_class from queue""")
cte("plan_b", """select *, row_number() over (order by round(score / greatest(1.0, total_cost), 9) desc, round(score, 4) desc, sku_id) as pos from queue""")
cte("plan_n", "select *, row_number() over (order by round(score, 4) desc, sku_id) as pos from queue")
register("plan_week_top", lambda s, sf: v.plan_week(queue(s, sf), None, 25).select("sku_id", "pos", "reason"),
         "select sku_id, pos, case when pos > 25 then 'top_n_cap_reached' end as reason from plan_n")
cte("greedy", """with recursive g as (
  select 0::bigint as pos, null::varchar as sku_id, 0.0::double as spent, 0 as k, null::varchar as reason
  union all select p.pos, p.sku_id, g.spent + case when g.k < 25 and g.spent + p.total_cost <= 3e6 then p.total_cost else 0.0 end,
    g.k + case when g.k < 25 and g.spent + p.total_cost <= 3e6 then 1 else 0 end,
    case when g.k >= 25 then 'top_n_cap_reached' when g.spent + p.total_cost > 3e6 then 'budget_exceeded' end
  from g join plan_b p on p.pos = g.pos + 1) select pos, sku_id, reason from g where pos > 0""")
register("plan_week_budget", lambda s, sf: v.plan_week(queue(s, sf), 3e6, 25).select("sku_id", "pos", "reason"),
         "select sku_id, pos, reason from greedy")
# a small budget: many rows no longer fit
cte("greedy_low", """with recursive g as (
  select 0::bigint as pos, null::varchar as sku_id, 0.0::double as spent, 0 as k, null::varchar as reason
  union all select p.pos, p.sku_id, g.spent + case when g.k < 9 and g.spent + p.total_cost <= 2e5 then p.total_cost else 0.0 end,
    g.k + case when g.k < 9 and g.spent + p.total_cost <= 2e5 then 1 else 0 end,
    case when g.k >= 9 then 'top_n_cap_reached' when g.spent + p.total_cost > 2e5 then 'budget_exceeded' end
  from g join plan_b p on p.pos = g.pos + 1) select pos, sku_id, reason from g where pos > 0""")
register("plan_week_low_budget", lambda s, sf: v.plan_week(queue(s, sf), 2e5, 9).select("sku_id", "pos", "reason"), "select sku_id, pos, reason from greedy_low")
register("plan_summary", lambda s, sf: v.plan_summary(v.plan_week(queue(s, sf), 3e6, 25), 3e6), """
  select count(*) filter (reason is null) as n_items, count(*) filter (reason is not null) as n_deferred,
    round(sum(total_cost) filter (reason is null), 2) as total_cost_usd, round(sum(total_cost) filter (reason is null) / 3e6 * 100, 1) as budget_used_pct
  from greedy join queue using (sku_id)""")
register("plan_rationale", lambda s, sf: v.plan_rationale(queue(s, sf)).select("sku_id", "rationale"), """
  select sku_id, case when t = '' then 'queue-flagged for replenishment' else t end as rationale from (select sku_id, concat_ws('; ',
    case when stockout_prob > 0.5 then 'high stockout risk (' || cast(round(stockout_prob * 100, 0) as bigint) || '%)'
      when stockout_prob > 0.2 then 'moderate stockout risk (' || cast(round(stockout_prob * 100, 0) as bigint) || '%)' end,
    case when expedite_flag then 'expedite recommended' end, 'projected stockout ' || strftime(projected_stockout_date, '%Y-%m-%d'),
    case when revenue_at_risk > 0 then '$' || cast(round(revenue_at_risk, 0) as bigint) || ' revenue at risk' end,
    case when abc_class = 'A' then 'A-class SKU' end) as t from queue)""")
cte("draft_lines", """select *, coalesce(supplier_id, last_supplier, 'UNKNOWN') as sup_key,
  row_number() over (partition by coalesce(supplier_id, last_supplier, 'UNKNOWN') order by round(revenue_at_risk, 4) desc, sku_id) as line_no from queue""")
cte("drafts", """select * exclude (s, k), row_number() over (order by s, k) as draft_no from (
  select sup_key, max(last_supplier) as supplier_name, count(*) as n_lines, bool_or(expedite_flag) as expedite, round(sum(recommended_qty * unit_cost), 2) as total_cost,
    max(sku_id) filter (line_no = 1) as top_sku, min(-round(score, 4)) as s, arg_min(sku_id, (-round(score, 4), sku_id)) as k from draft_lines group by 1)""")
register("draft_by_supplier", lambda s, sf: v.draft_by_supplier(queue(s, sf)), "select * from drafts")
register("draft_lines_by_supplier", lambda s, sf: v.draft_lines_by_supplier(queue(s, sf)).select("sup_key", "line_no", "sku_id", "recommended_qty"),
         "select sup_key, line_no, sku_id, recommended_qty from draft_lines")
register("draft_by_supplier_top", lambda s, sf: v.draft_by_supplier(queue(s, sf), 8, 15).select("sup_key", "draft_no", "n_lines", "total_cost"), """
  select sup_key, any_value(draft_no) as draft_no, count(*) filter (line_no <= 15) as n_lines, round(sum(recommended_qty * unit_cost) filter (line_no <= 15), 2) as total_cost
  from draft_lines join drafts using (sup_key) where draft_no <= 8 group by 1""")


def proposed(s, sf):
    """Plan lines proposed per SKU: lower case, some without quantity, some unknown."""
    k = F.col("k")
    return (d.table(s, sf, "part").groupBy(d._brand_type().alias("sku")).agg(F.max("p_size").alias("k"))
            .select(F.when(k % 5 == 0, F.concat("sku", F.lit("-X"))).otherwise(F.lower("sku")).alias("sku_id"),
                    F.when(k % 3 == 0, F.lit(None).cast("double")).when(k % 7 == 0, F.lit(-1.0)).otherwise(k * 2.5).alias("qty")))


register("validate_plan", lambda s, sf: v.validate_plan(proposed(s, sf), queue(s, sf), bt(s, sf)), f"""
  with l as (select case when k % 5 = 0 then sku || '-X' else sku end as sku_id, case when k % 3 = 0 then null when k % 7 = 0 then -1.0 else k * 2.5 end::double as q0
    from (select upper(p_brand || '|' || p_type) as sku, max(p_size) as k from part group by 1)),
  j as (select l.sku_id, coalesce(q0, recommended_qty) as qq, moq, case_pack, queue.sku_id is not null as known, coalesce(state.known_unit_cost, queue.unit_cost) as uc
    from l left join queue on queue.sku_id = l.sku_id left join state on state.sku_id = l.sku_id),
  z as (select *, {round_sql('qq', True)} as rq from j)
  select sku_id, known and rq > 0 as kept, case when known and rq > 0 then rq end as qty, case when known and rq > 0 then uc end as unit_cost,
    case when known and rq > 0 then round(rq * coalesce(uc, 0.0), 2) end as line_cost from z""")

# ---- stress -------------------------------------------------------------------
for tag in ("base", "shock"):
    cte(f"expo_{tag}", f"""select sku_id, stockout_prob, stockout_prob * mean_d * coalesce(known_unit_price, coalesce(known_unit_cost, 1.0) * 1.5) * lt_periods as revenue_at_risk,
      greatest(0.0, ltd_mean + {ppf('0.95')} * ltd_std - known_on_hand) as recommended_qty from exp_{tag} where n_obs >= 4 and known_on_hand is not null""")
LT, DM = 1.5, 1.25
expo = lambda s, sf: v.exposure(bt(s, sf), sup(s, sf), "W", LT, DM)
register("exposure", lambda s, sf: rounded(expo(s, sf), 4), """select sku_id, round(stockout_prob, 4) as stockout_prob, round(revenue_at_risk, 4) as revenue_at_risk,
  round(recommended_qty, 4) as recommended_qty from expo_shock""")
cte("varq", """select quantile_cont(x, 0.95) as var_95 from (select round(revenue_at_risk, 6) as x from expo_shock)""")
cte("cvarq", "select avg(x) as cvar_95 from (select round(revenue_at_risk, 6) as x from expo_shock) where x >= (select var_95 from varq)")
register("var_cvar", lambda s, sf: rounded(v.var_cvar(expo(s, sf)), 3), "select round(var_95, 3) as var_95, round(cvar_95, 3) as cvar_95 from varq, cvarq")
register("stress_test", lambda s, sf: rounded(v.stress_test(bt(s, sf), sup(s, sf), "W", LT, DM), 2), """
  select round(b.t, 2) as baseline_total_revenue_at_risk, b.n as baseline_n_at_risk, round(s.t, 2) as shock_total_revenue_at_risk, s.n as shock_n_at_risk,
    round(s.t - b.t, 2) as delta_total_revenue_at_risk, round(var_95, 2) as var_95, round(cvar_95, 2) as cvar_95
  from (select sum(revenue_at_risk) as t, count(*) filter (stockout_prob > 0.1) as n from expo_base) b,
    (select sum(revenue_at_risk) as t, count(*) filter (stockout_prob > 0.1) as n from expo_shock) s, varq, cvarq""")
register("top_impacted", lambda s, sf: rounded(v.top_impacted(bt(s, sf), sup(s, sf), "W", LT, DM), 3), """
  select s.sku_id, round(b.stockout_prob, 3) as baseline_stockout_prob, round(s.stockout_prob, 3) as shock_stockout_prob,
    round(b.revenue_at_risk, 3) as baseline_revenue_at_risk, round(s.revenue_at_risk, 3) as shock_revenue_at_risk,
    round(s.revenue_at_risk - b.revenue_at_risk, 3) as delta_revenue_at_risk, round(b.recommended_qty, 3) as baseline_recommended_qty,
    round(s.recommended_qty, 3) as shock_recommended_qty
  from expo_shock s join expo_base b on b.sku_id = s.sku_id order by round(s.revenue_at_risk - b.revenue_at_risk, 4) desc, s.sku_id limit 10""")

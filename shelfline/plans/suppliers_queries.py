from pyspark.sql import functions as F

from ..functions.stats import r
from ..operators import inventory as v, suppliers as u
from ..sources import derived as d
from .inventory_queries import sup
from .oracle import CTES, cte, hash8
from .registry import register
from .series_queries import bt, pm, rounded

rcp = d.receipts
ONE = "S00003"


def sid_sql(n):
    clean = f"regexp_replace(regexp_replace(upper({n}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return (f"case when {n} <> '' then 'SUP_' || substr({clean}, 1, 24) || '_' || lpad(cast({hash8(n)} % 10000 as varchar), 4, '0') "
            f"else 'SUP_UNKNOWN' end")


def pick_sql(pool, i):
    items = ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in pool)
    return f"([{items}])[({i}) % {len(pool)} + 1]" + ("" if isinstance(pool[0], str) else "::double")


register("supplier_id", lambda s, sf: sup(s, sf).select("name", v.supplier_id(F.col("name")).alias("derived_id")),
         f"select name, {sid_sql('name')} as derived_id from suppliers")
register("derive_suppliers", lambda s, sf: u.derive_suppliers(bt(s, sf)), f"""
  select {sid_sql('name')} as supplier_id, name, 'orders@' || coalesce(nullif(substr(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}_-]', '', 'g'), 1, 18), ''), 'vendor') || '.example.com' as contact_email,
    {pick_sql(u.COUNTRY_POOL, 'h // 13')} as country, {pick_sql(u.TERMS_POOL, 'h')} as payment_terms, round(m, 2) as default_lead_time_days,
    round(case when n > 1 then sd else greatest(m * 0.2, 0.5) end, 2) as lead_time_std_days, {pick_sql(u.MOQ_POOL, 'h')} as moq,
    {pick_sql(u.PACK_POOL, 'h // 7')} as case_pack, '' as notes
  from (select supplier as name, count(lead_time_days) as n, coalesce(avg(lead_time_days), 14.0) as m, stddev_pop(lead_time_days) as sd,
      {hash8('supplier')} as h from panel where trim(supplier) <> '' group by 1)""")
TERMS = """cast(coalesce(case when contains(lower(payment_terms), 'net') then nullif(substr(regexp_replace(regexp_replace(lower(payment_terms), '^.*?net', ''), '[^0-9]', '', 'g'), 1, 3), '') end,
  nullif(substr(regexp_replace(lower(payment_terms), '[^0-9]', '', 'g'), 1, 3), ''), '30') as integer)"""
register("terms_days", lambda s, sf: sup(s, sf).select("supplier_id", u.terms_days(F.col("payment_terms")).alias("terms_days")),
         f"select supplier_id, {TERMS} as terms_days from suppliers")
cte("rstats", """select supplier_id, count(*) as n_receipts, count(received_date - ordered_date) as lt_n, avg(received_date - ordered_date) as avg_lt,
    stddev_pop(received_date - ordered_date) as sd_lt, var_pop(received_date - ordered_date) as var_lt,
    avg(case when received_date <= expected_date then 100.0 else 0.0 end) as on_time, avg(case when received_qty >= ordered_qty * 0.99 then 100.0 else 0.0 end) as in_full,
    avg(case when received_date <= expected_date and received_qty >= ordered_qty * 0.99 then 100.0 else 0.0 end) as otif from receipts group by 1""")
cte("post", """select supplier_id, coalesce(lt_n, 0) as n_observed, case when lt_n > 0 then (w0 * m0 + w1 * avg_lt) / (w0 + w1) else m0 end as pm,
    case when lt_n > 0 then sqrt(1.0 / (w0 + w1)) else s0 end as ps from (
  select *, 4.0 / (s0 * s0) as w0, lt_n / greatest(case when lt_n > 1 then var_lt else s0 * s0 end, 1e-6) as w1 from (
    select s.supplier_id, s.default_lead_time_days as m0, s.lead_time_std_days as s0, r.* exclude (supplier_id) from suppliers s left join rstats r on r.supplier_id = s.supplier_id))""")
register("lead_time_posterior", lambda s, sf: rounded(u.lead_time_posterior(sup(s, sf), rcp(s, sf))),
         "select supplier_id, n_observed, round(pm, 6) as posterior_mean, round(ps, 6) as posterior_std from post")
cte("cards", """select s.supplier_id, s.name, coalesce(p.n_skus, 0) as n_skus, coalesce(p.rev * 365.0 / p.span, 0.0) as annual_revenue, r.avg_lt as avg_lead_time_days,
    case when lt_n > 1 then sd_lt when lt_n = 1 then 0.0 end as lead_time_std_days, case when n_observed > 0 then pm end as leadtime_posterior_mean,
    case when n_observed > 0 then ps end as leadtime_posterior_std, on_time as on_time_pct, in_full as in_full_pct, otif as otif_pct,
    coalesce(n_receipts, 0) as n_receipts, payment_terms, moq, case_pack, country, contact_email
  from suppliers s left join (select supplier, count(distinct sku_id) as n_skus, coalesce(sum(demand * unit_price), 0) as rev,
      greatest(1, max(date) - min(date)) as span from panel group by 1) p on p.supplier = s.name
  left join rstats r on r.supplier_id = s.supplier_id left join post on post.supplier_id = s.supplier_id""")
cards = lambda s, sf: u.supplier_scorecards(sup(s, sf), rcp(s, sf), bt(s, sf))
register("supplier_scorecards", lambda s, sf: rounded(cards(s, sf), 2), """
  select supplier_id, name, n_skus, round(annual_revenue, 2) as annual_revenue, round(avg_lead_time_days, 2) as avg_lead_time_days,
    round(lead_time_std_days, 2) as lead_time_std_days, round(leadtime_posterior_mean, 2) as leadtime_posterior_mean,
    round(leadtime_posterior_std, 2) as leadtime_posterior_std, round(on_time_pct, 2) as on_time_pct, round(in_full_pct, 2) as in_full_pct,
    round(otif_pct, 2) as otif_pct, n_receipts, payment_terms, moq, case_pack, country, contact_email from cards""")
register("supplier_detail", lambda s, sf: rounded(u.supplier_detail(sup(s, sf), rcp(s, sf), bt(s, sf), ONE)), f"""
  select s.*, n_observed, round(pm, 6) as posterior_mean, round(ps, 6) as posterior_std,
    (select count(distinct sku_id) from panel where supplier = s.name) as n_skus
  from suppliers s join post on post.supplier_id = s.supplier_id where s.supplier_id = '{ONE}'""")
register("supplier_receipts", lambda s, sf: u.supplier_receipts(rcp(s, sf), ONE),
         f"select *, (received_date - ordered_date) as lead_time_days from receipts where supplier_id = '{ONE}'")
register("lead_time_counts", lambda s, sf: u.lead_time_counts(rcp(s, sf)),
         "select supplier_id, (received_date - ordered_date) as lead_time_days, count(*) as n from receipts group by 1, 2")
register("lead_time_histogram", lambda s, sf: rounded(u.lead_time_histogram(sup(s, sf), rcp(s, sf))), """
  with e as (select r.supplier_id, count(*) as n, min(received_date - ordered_date) as a, max(received_date - ordered_date) as b from receipts r group by 1),
  f as (select e.supplier_id, greatest(0.0, floor(least(a, default_lead_time_days, pm) - 2)) as lo, ceil(greatest(b, default_lead_time_days, pm) + 2) as hi,
    least(20, greatest(6, case when n // 2 = 0 then 6 else n // 2 end)) as bins from e join suppliers s on s.supplier_id = e.supplier_id join post on post.supplier_id = e.supplier_id),
  g as (select *, case when hi = lo then 1.0 else hi - lo end as rng from f)
  select r.supplier_id, cast(greatest(0, least(bins - 1, floor((received_date - ordered_date - lo) / (rng / bins)))) as bigint) as bin,
    min(lo) as lo, round(min(rng / bins), 6) as width, count(*) as n from receipts r join g on g.supplier_id = r.supplier_id group by 1, 2""")
cte("val", """select sku_id, sum(coalesce(on_hand, 0.0) * coalesce(unit_cost, 0.0)) filter (back = 1) as value, sum(demand * coalesce(unit_cost, 0.0)) as cogs,
  max(supplier) filter (back = 1) as supplier from back group by 1""")
cte("pay", f"""select coalesce(supplier_id, g.supplier) as supplier_id, g.supplier as supplier_name, value, coalesce(t, 30) as terms, value * (coalesce(t, 30) / 30.0::double) / 12 as payable
  from (select supplier, sum(value) as value from val group by 1) g left join (select name, supplier_id, {TERMS} as t from suppliers) s on s.name = g.supplier""")
register("working_capital", lambda s, sf: u.working_capital(bt(s, sf), sup(s, sf), "W"), """
  select round(inv, 2) as inventory_value, round(cogs, 2) as annual_cogs, round(inv / cogs * 365, 1) as dio_days, round(w / vv, 1) as dpo_days,
    round(round(inv / cogs * 365, 1) - round(w / vv, 1), 1) as cash_to_cash_days, round(payable, 2) as payable_outstanding
  from (select sum(value) as inv, sum(cogs) * 52.0 / (select count(distinct date) from panel) as cogs from val),
    (select sum(payable) as payable, sum(terms * value) as w, sum(value) as vv from pay)""")
register("payables", lambda s, sf: u.payables(bt(s, sf), sup(s, sf)), """
  select supplier_id, supplier_name, round(value, 2) as inventory_value, terms as payment_terms_days, round(payable, 2) as payable_outstanding
  from pay order by 3 desc, 2 limit 20""")
CYC = """select sku_id, supplier, annual_demand, holding_per_unit, sqrt(2.0 * annual_demand * 50.0 / holding_per_unit) as eoq,
    sqrt(2.0 * annual_demand * 50.0 / holding_per_unit) / annual_demand * 365.0 as cycle_days from (
  select sku_id, min(supplier) as supplier, greatest(0.0, avg(demand) * {f}) as annual_demand, greatest(0.5, 0.25 * greatest(0.5, coalesce(avg(unit_cost), 1.0))) as holding_per_unit
  from {p} group by 1) where annual_demand > 0 and supplier is not null"""
cte("cyc", CYC.format(f="52.0", p="panel"))
cte("cyc_pm", CYC.format(f="12.0", p="panel_pm"))
register("replen_cycles", lambda s, sf: rounded(u.replen_cycles(bt(s, sf), 52.0).drop('holding_per_unit'), 2), """
  select sku_id, supplier, round(annual_demand, 2) as annual_demand, round(eoq, 2) as eoq,
    round(cycle_days, 2) as cycle_days from cyc""")
cte("clus", """with recursive o as (select *, row_number() over (partition by supplier order by cycle_days, sku_id) as i from cyc_pm),
  g as (select supplier, sku_id, i, cycle_days, 0::bigint as cluster, cycle_days as s, 1.0::double as k from o where i = 1
    union all select o.supplier, o.sku_id, o.i, o.cycle_days, case when abs(o.cycle_days - g.s / g.k) / (g.s / g.k) <= 0.2 then g.cluster else g.cluster + 1 end,
      case when abs(o.cycle_days - g.s / g.k) / (g.s / g.k) <= 0.2 then g.s + o.cycle_days else o.cycle_days end,
      case when abs(o.cycle_days - g.s / g.k) / (g.s / g.k) <= 0.2 then g.k + 1.0 else 1.0 end
    from g join o on o.supplier = g.supplier and o.i = g.i + 1) select * from g""")
cycles = lambda s, sf: u.replen_cycles(pm(s, sf), 12.0)
register("cluster_cycles", lambda s, sf: u.cluster_cycles(cycles(s, sf)).select("supplier", "sku_id", "cluster"),
         "select supplier, sku_id, cluster from clus")
cte("jgroups", """select supplier, supplier || '-cluster-' || cluster as group_id, count(*) as n_members, avg(cycle_days) as cadence_days, 365.0 / avg(cycle_days) as annual_orders_pooled,
  sum(365.0 / cycle_days) as annual_orders_individual, greatest(0.0, (sum(365.0 / cycle_days) - 365.0 / avg(cycle_days)) * 50.0) as annual_savings_usd
  from clus group by supplier, cluster having count(*) >= 2""")
register("joint_replenishment", lambda s, sf: rounded(u.joint_replenishment(u.cluster_cycles(cycles(s, sf))), 4), """
  select supplier, group_id, n_members, round(cadence_days, 4) as cadence_days, round(annual_orders_pooled, 4) as annual_orders_pooled,
    round(annual_orders_individual, 4) as annual_orders_individual, round(annual_savings_usd, 4) as annual_savings_usd from jgroups""")
register("joint_savings_total", lambda s, sf: rounded(u.savings_total(u.joint_replenishment(u.cluster_cycles(cycles(s, sf)))), 2),
         "select count(*) as n_groups, round(sum(annual_savings_usd), 2) as annual_savings_usd from jgroups")


def _queue_grouped(s, sf):
    c = u.cluster_cycles(u.replen_cycles(bt(s, sf), 52.0))
    g = u.group_of_sku(c, u.joint_replenishment(c))
    return v.reorder_queue(bt(s, sf), sup(s, sf), "W", "2001-12-31", groups=g).select("sku_id", "joint_replen_group")


cte("clus_w", CTES["clus"].replace("cyc_pm", "cyc"))
register("reorder_queue_groups", _queue_grouped, """
  select q.sku_id, group_id as joint_replen_group from queue q left join (select sku_id, supplier || '-cluster-' || cluster as group_id from clus_w
    qualify count(*) over (partition by supplier, cluster) >= 2) g on g.sku_id = q.sku_id""")

from pyspark.sql import functions as F

from ..functions.stats import r
from ..operators import skus as k
from ..session import scratch_path
from ..sources import derived as d, files
from .inventory_queries import sup
from .oracle import cte
from .registry import register
from .series_queries import bt, pm, rounded
from .suppliers_queries import cards, rcp

COVER = "case when last_on_hand is not null and mean_last8 > 0 then round(last_on_hand / mean_last8 * 7.0, 1) end"
STATUS = """case when on_hand is null or on_hand <= 0 then 'order_now' when days_of_cover is null then 'watch'
  when days_of_cover < lt then 'order_now' when days_of_cover < 1.5 * lt then 'at_risk' when days_of_cover < 2.0 * lt then 'watch' else 'healthy' end"""
cte("skut", f"""select *, {STATUS} as status from (select s.sku_id, last_category as category, last_supplier as supplier, abc_class, xyz_class,
    coalesce(last_demand, 0.0) as last_demand, last_on_hand as on_hand, {COVER} as days_of_cover, round(cv_demand, 3) as cv_demand,
    round(revenue_annual, 2) as revenue_annual, n_obs, last_lead_time_days as lead_time_days,
    case when last_lead_time_days > 0 then last_lead_time_days else 14.0 end as lt from state s join abc a on a.sku_id = s.sku_id)""")
T = "select * exclude (lt) from skut"
rows = lambda s, sf: k.sku_rows(bt(s, sf), "W")
register("days_of_cover", lambda s, sf: k.days_of_cover(bt(s, sf), "W"), f"select sku_id, {COVER} as days_of_cover from state")
register("sku_status", lambda s, sf: k.sku_status(bt(s, sf), "W"), "select sku_id, days_of_cover, status from skut")
register("sku_table", lambda s, sf: k.sku_table(bt(s, sf), "W"), T)
RANK = "case status when 'order_now' then 1 when 'at_risk' then 2 when 'watch' then 3 else 4 end"
register("sku_table_page", lambda s, sf: k.page(rows(s, sf), {"category": "ECONOMY"}, "status", "desc", limit=10, offset=3),
         f"{T} where category = 'ECONOMY' order by {RANK} desc, sku_id limit 10 offset 3")
register("sku_table_by_revenue", lambda s, sf: k.page(rows(s, sf), {"abc_class": "A"}, "revenue_annual", "desc", limit=40),
         f"{T} where abc_class = 'A' order by revenue_annual desc, sku_id limit 40")
register("sku_table_history", lambda s, sf: k.sku_table(bt(s, sf), "W", history=12, limit=50).select(
    "sku_id", F.concat_ws(",", F.transform("history", lambda x: x.cast("int").cast("string"))).alias("history")), """
  select sku_id, (select string_agg(cast(cast(demand as integer) as varchar), ',' order by date) from back b where b.sku_id = t.sku_id and back <= 12) as history
  from skut t order by coalesce(days_of_cover, 'inf'::double), sku_id limit 50""")
register("sku_history", lambda s, sf: k.sku_history(bt(s, sf), 30), "select sku_id, date, demand from back where back <= 30")
register("search_skus", lambda s, sf: k.search_skus(rows(s, sf), "brand#1", ("A", "B"), ("Y",), needs_action=True),
         f"{T} where contains(lower(sku_id), 'brand#1') and abc_class in ('A','B') and xyz_class in ('Y') and status in ('order_now','at_risk')")
register("query_skus", lambda s, sf: k.query_skus(bt(s, sf), "W", category="SMALL"), f"""
  select * exclude (lt), (select count(*) from skut where category = 'SMALL') as total_matched from skut where category = 'SMALL' order by revenue_annual desc, sku_id limit 25""")
register("skus_view", lambda s, sf: k.skus_view(bt(s, sf), "W"), "select sku_id, category, supplier, abc_class, xyz_class from skut")
register("sku_details", lambda s, sf: rounded(k.sku_details(bt(s, sf), "W").withColumns({"unit_price": r("unit_price", 3), "unit_cost": r("unit_cost", 3)}), 5), """
  select s.sku_id, last_category as category, last_supplier as supplier, n_obs as n_observations, date_min, date_max, 'W' as frequency, last_demand,
    round(mean_demand, 5) as mean_demand, round(cv_demand, 3) as cv_demand, abc_class, xyz_class, round(revenue_annual, 2) as revenue_annual,
    last_on_hand as on_hand, round(mean_cost, 3) as unit_cost, round(mean_price, 3) as unit_price, round(lt_mean, 5) as lead_time_days
  from state s join abc a on a.sku_id = s.sku_id""")
register("aggregate_stats", lambda s, sf: rounded(k.aggregate_stats(bt(s, sf), "W"), 2), """
  select (select count(*) from state) as n_skus, (select round(sum(coalesce(last_on_hand, 0) * coalesce(last_unit_cost, 0)), 2) from state) as total_inventory_value,
    (select round(avg(case when mean_last8 > 0 then last_on_hand / mean_last8 * 7.0 end), 1) from state) as avg_days_of_cover,
    (select count(*) from state where n_obs < 13) as n_skus_low_history, round(sum(revenue_annual), 2) as total_revenue_annual,
    count(*) filter (abc_class = 'A') as n_a, count(*) filter (abc_class = 'B') as n_b, count(*) filter (abc_class = 'C') as n_c,
    count(*) filter (xyz_class = 'X') as n_x, count(*) filter (xyz_class = 'Y') as n_y, count(*) filter (xyz_class = 'Z') as n_z from abc""")


def _export(s, sf):
    path = scratch_path(s, "sku-table")
    files.export_sku_table(k.search_skus(rows(s, sf), ""), path)
    return s.read.csv(path, header=True).select("sku_id", "status", "abc_class", F.col("on_hand").cast("double").alias("on_hand"))


register("export_sku_table", _export, "select sku_id, status, abc_class, on_hand from skut")

# ---- insights -------------------------------------------------------------------
cte("rcov", """select *, on_hand / mean_d * 7.0 as days_of_cover from (select sku_id, max(on_hand) filter (back = 1) as on_hand, max(unit_price) filter (back = 1) as unit_price,
  avg(demand) filter (date > (select max(date) from panel) - 90) as mean_d from back group by 1) where on_hand is not null and mean_d > 0""")
cte("i_low", """select 'low_cover' as id, 'crit' as severity, count(*) || ' SKUs have <7 days of cover' as title,
    'Top: ' || (select string_agg(sku_id || printf(' (%.1fd)', round(days_of_cover, 6)), ', ' order by round(days_of_cover, 6), sku_id) from (
      select * from rcov where days_of_cover < 7 order by round(days_of_cover, 6), sku_id limit 3)) as body
  from rcov where days_of_cover < 7 having count(*) > 0""")
cte("i_otif", """select 'otif_' || x.supplier_id as id, 'warn' as severity, name || ' OTIF dropped to ' || cast(round(otif, 0) as bigint) || '%' as title,
    n || ' recent receipts. Consider dual-sourcing or expediting key SKUs.' as body from (
  select r.supplier_id, count(*) as n, avg(case when received_date <= expected_date then 100.0 else 0.0 end) * avg(case when received_qty >= ordered_qty * 0.99 then 100.0 else 0.0 end) / 100 as otif
  from receipts r where received_date > (select max(date) from panel) - 120 group by 1 having count(*) >= 3) x join suppliers s on s.supplier_id = x.supplier_id
  where otif < 75 order by round(otif, 6), x.supplier_id limit 1""")
cte("i_exp", """select 'expedite_candidates' as id, case when n < 5 then 'warn' else 'crit' end as severity, n || ' SKUs flagged for expediting' as title,
  'Air-freight breakeven beats stockout cost on these high-revenue SKUs.' as body
  from (select count(*) as n from rcov where days_of_cover < 14 and mean_d * coalesce(unit_price, 0.0) > 50) where n > 0""")
cte("i_up", """select 'abc_upgrades' as id, 'info' as severity, count(*) || ' SKUs migrated to higher class' as title,
  (select string_agg(sku_id || ' (' || abc_prior || '→' || abc_recent || ')', ', ' order by sku_id) from (select * from migration order by sku_id limit 3))
    || case when count(*) > 3 then ' + ' || (count(*) - 3) || ' more' else '' end as body from migration having count(*) > 0""")
cte("i_data", """select 'data_summary' as id, 'info' as severity, count(distinct sku_id) || ' SKUs · ' || ((max(date) - min(date)) // 30) || '+ months of history' as title,
  'Latest data: ' || strftime(max(date), '%Y-%m-%d') || '. ' || format('{:,}', count(*)) || ' observations.' as body from panel""")
register("insight_low_cover", lambda s, sf: k.insight_low_cover(bt(s, sf), "W", 7.0), "select * from i_low")
register("insight_otif", lambda s, sf: k.insight_otif(rcp(s, sf), sup(s, sf), bt(s, sf)), "select * from i_otif")
register("insight_expedite", lambda s, sf: k.insight_expedite(bt(s, sf), "W"), "select * from i_exp")
register("insights", lambda s, sf: k.insights(bt(s, sf), sup(s, sf), rcp(s, sf), "W"),
         " union all ".join(f"select * from {t}" for t in ("i_up", "i_low", "i_otif", "i_exp", "i_data")))
register("portfolio_insights", lambda s, sf: k.portfolio_insights(rows(s, sf)), """
  select *, case when n_a_healthy * 100.0 / n_a >= 80 then 'good' when n_a_healthy * 100.0 / n_a < 60 then 'warn' end as a_health,
    coalesce(dominant_n >= 2, false) as supplier_named, n_z / n_skus > 0.3 as many_variable from (
  select count(*) as n_skus, count(*) filter (status = 'order_now') as n_order_now, count(*) filter (status = 'order_now' and abc_class = 'A') as n_order_now_a,
    count(*) filter (status = 'at_risk') as n_at_risk, count(*) filter (abc_class = 'A') as n_a, count(*) filter (abc_class = 'A' and status = 'healthy') as n_a_healthy,
    count(*) filter (xyz_class = 'Z') as n_z,
    (select count(*) from skut where status = 'at_risk' group by supplier order by 1 desc, min(supplier) limit 1) as dominant_n,
    (select supplier from skut where status = 'at_risk' group by supplier order by count(*) desc, supplier limit 1) as dominant_supplier from skut)""")
register("supplier_insights", lambda s, sf: k.supplier_insights(cards(s, sf)), """
  select * from (select 'lead_time_variance' as kind, name, round(lead_time_std_days, 1) as figure, round(avg_lead_time_days, 1) as second from cards
    where lead_time_std_days is not null order by round(lead_time_std_days, 6) desc, name limit 1) where figure > 0
  union all select 'slow_otif', name, round(otif_pct, 0), round(annual_revenue / (select sum(annual_revenue) from cards) * 100, 0) from (
    select * from cards where otif_pct is not null and annual_revenue > 0 order by round(otif_pct, 6), name limit 1) where otif_pct < 90
  union all select 'dominant', name, round(annual_revenue / t * 100, 0), null from (
    select *, (select sum(annual_revenue) from cards) as t from cards order by round(annual_revenue, 2) desc, name limit 1) where annual_revenue / t * 100 > 35""")
register("panel_summary", lambda s, sf: k.panel_summary(rows(s, sf)), "select count(*) as n_skus, " + ", ".join(
    f"count(*) filter (status = '{x}') as {x}" for x in k.STATUSES) + ", " + ", ".join(
    f"count(*) filter ({c}_class = '{x}') as {c}_{x.lower()}" for c, xs in (("abc", "ABC"), ("xyz", "XYZ")) for x in xs)
    + ", round(sum(revenue_annual), 0) as total_revenue_annual, round(sum(on_hand), 0) as total_on_hand_units from skut")
register("top_groups", lambda s, sf: k.top_groups(rows(s, sf)), """
  select * from (select *, row_number() over (partition by dim order by n_skus desc, name) as pos from (
    select 'category' as dim, category as name, count(*) as n_skus from skut group by 2 union all select 'supplier', supplier, count(*) from skut group by 2)) where pos <= 5""")
register("supplier_summary", lambda s, sf: rounded(k.supplier_summary(cards(s, sf)), 2), """
  select name, country, n_skus, round(annual_revenue, 0) as annual_revenue, round(otif_pct, 2) as otif_pct, payment_terms from cards
  order by round(annual_revenue, 2) desc, name limit 12""".replace("round(annual_revenue, 2) desc", "round(cards.annual_revenue, 2) desc"))
register("action_queue", lambda s, sf: k.action_queue(rows(s, sf)), """
  select * from (select status, row_number() over (partition by status order by coalesce(days_of_cover, 'inf'::double), sku_id) as pos, sku_id, days_of_cover
    from skut where status in ('order_now','at_risk')) where pos <= 8""")
register("header_tiles", lambda s, sf: k.header_tiles(rows(s, sf)).withColumn("total_on_hand", r("total_on_hand", 2)), """
  select count(*) filter (status = 'order_now') as n_order_now, count(*) filter (status = 'at_risk') as n_at_risk, round(sum(on_hand), 2) as total_on_hand,
    count(on_hand) as n_reporting, (select cv_demand from (select cv_demand, row_number() over (order by cv_demand) - 1 as i, count(*) over () as n from skut where abc_class = 'A')
      where i = n // 2) as a_median_cv from skut""")

from pyspark.sql import functions as F

from ..functions.stats import r
from ..operators import calibration as cal, checks, quality as q, series as s_
from ..session import scratch_path
from ..sources import derived as d, files
from .ingest_queries import loose_panel
from .oracle import cte, phi, hash8
from .registry import register
from .series_queries import bt, pm, rounded, acf_sql, cv_sql, ratio_sql, SLOPE, ZERO, FCOLS

cte("sku_dates", """
  select sku_id, count(distinct date) as n, quantile_cont(gap::double, 0.5) as gap, max(date) - min(date) as span from (
    select sku_id, date, date - lag(date) over (partition by sku_id order by date) as gap from loose) group by 1""")
cte("completeness", """
  select 6 as n_populated, avg(n / (span / greatest(1.0, gap) + 1)) filter (n >= 2) as coverage from sku_dates""")
register("dq_completeness", lambda s, sf: rounded(q.dq_completeness(loose_panel(s, sf))), """
  select n_populated::bigint as n_populated, round(coverage, 6) as coverage,
    round(100.0 * (0.4 * n_populated / 6 + 0.6 * least(1.0, coverage)), 2) as score from completeness""")
cte("plausibility", """select round(greatest(0.0, 100.0 - coalesce(sum(least(20.0, 100 * greatest(
  offending_row_count / (select count(*) from loose)::double, skus_affected / (select count(distinct sku_id) from loose)::double))), 0.0)), 2) as score
  from soft_findings""")
register("dq_plausibility", lambda s, sf: q.dq_plausibility(checks.business_checks(loose_panel(s, sf)), loose_panel(s, sf)),
         "select score from plausibility")
cte("hist", """select round(avg(least(n, 104) / 104.0::double * 100), 2) as score, count(*) filter (n < 13) as n_low_history
  from (select sku_id, count(*) as n from loose group by 1)""")
register("dq_history", lambda s, sf: q.dq_history(loose_panel(s, sf)), "select * from hist")
register("low_history", lambda s, sf: q.low_history(d.cells(s, sf, "part"), 25),
         "select sku_id, count(*) as n_obs from cells_pw group by 1 having count(*) < 25")

METRIC_SQL = f"""select sku_id, count(*) as n_obs, {cv_sql()} as cv_demand, {ZERO} as intermittency_rate,
  greatest({acf_sql(7)}, {acf_sql(28)}, {acf_sql(365)}) as seasonality_strength, abs({SLOPE}) as trend_slope_pct,
  abs({ratio_sql(90, 180, '1.0')} - 1.0) as regime_shift_score from ix_panel group by 1"""
cte("metrics", METRIC_SQL)
MCOLS = ", ".join(f"round({m}, 6) as {m}" for m in s_.METRICS)
register("series_metrics", lambda s, sf: rounded(s_.series_metrics(bt(s, sf))), f"select sku_id, n_obs, {MCOLS} from metrics")
cte("tallm", "select sku_id, metric, value from metrics unpivot (value for metric in ("
    + ", ".join(s_.METRICS) + ")) where n_obs >= 8")
register("metric_medians", lambda s, sf: rounded(q.metric_medians(s_.series_metrics(bt(s, sf)))),
         "select metric, count(*) as n, round(quantile_cont(value, 0.5), 6) as median from tallm group by 1")
_bands = ", ".join(f"('{p}', '{m}', {b[0]}::double, {b[1]}::double, {b[2]}::double, {b[3]}::double, {b[4]}::double)"
                   for p, bands in q.PROFILES.items() for m, b in bands.items())
cte("bands", f"select * from (values {_bands}) t(profile_id, metric, p2, p10, p90, p98, centroid)")
cte("mprofile", """with md as (select metric, quantile_cont(value, 0.5) as median from tallm group by 1)
  select profile_id, 1.0 / (1.0 + sqrt(dist)) as confidence from (select profile_id,
    sum(((median - centroid) / greatest(p98 - p2, 1e-6)) ** 2) as dist from bands join md using (metric) group by 1)
  order by dist, profile_id limit 1""")
register("match_profile", lambda s, sf: rounded(q.match_profile(q.metric_medians(s_.series_metrics(bt(s, sf))))),
         "select profile_id, round(confidence, 6) as confidence from mprofile")
cte("mscores", """select sku_id, metric, value, p10, p90, case when value between p10 and p90 then 100.0
    when value >= p2 and value < p10 then case when p10 - p2 > 0 then 50.0 + 50.0 * (value - p2) / (p10 - p2) else 75.0 end
    when value > p90 and value <= p98 then case when p98 - p90 > 0 then 50.0 + 50.0 * (p98 - value) / (p98 - p90) else 75.0 end
    when value < p2 then greatest(0.0, 50.0 * (1 - (p2 - value) / greatest(abs(p2), 1e-6)))
    else greatest(0.0, 50.0 * (1 - (value - p98) / greatest(abs(p98), 1e-6))) end as score
  from tallm join bands using (metric) where profile_id = 'pharma_medical'""")
register("score_metric", lambda s, sf: rounded(q.metric_scores(s_.series_metrics(bt(s, sf)), "pharma_medical"), 5),
         "select sku_id, metric, round(value, 5) as value, round(score, 5) as score from mscores")
_flags = ", ".join(f"(select count(*) from mscores where metric = '{m}' and (value < p10 or value > p90)) as flag_{m}" for m in s_.METRICS)
cte("dist", f"""select round(quantile_cont(score, 0.5), 2) as score, count(*) as n_skus, {_flags}
  from (select sku_id, round(avg(score), 9) as score from mscores group by 1)""")
register("dq_distribution", lambda s, sf: q.dq_distribution(s_.series_metrics(bt(s, sf)), "pharma_medical"), "select * from dist")
register("distribution_anomalies", lambda s, sf: rounded(q.distribution_anomalies(s_.series_metrics(bt(s, sf)), "pharma_medical")), """
  select sku_id, metric, round(value, 6) as value, p10 as profile_p10, p90 as profile_p90,
    case when value < p10 then 'below_p10' else 'above_p90' end as side from mscores where value < p10 or value > p90""")


def tail_sql(last, base, src="panel"):
    n = last + base
    return (f"(select *, {n} + 1 - back as pos from (select sku_id, demand, row_number() over (partition by sku_id order by date desc) as back, "
            f"count(*) over (partition by sku_id) as n from {src}) where back <= {n} and n >= {n})")


def pettitt_sql(last, base):
    n = last + base
    return f"""select sku_id, max(abs(u)) as k_stat, least(1.0, 2 * exp(-6 * max(abs(u)) * max(abs(u)) / {float(n ** 3 + n ** 2)})) as pettitt_p from (
      select sku_id, pos, 2 * sum(rk) over (partition by sku_id order by pos rows unbounded preceding) - pos * {n + 1} as u from (
        select sku_id, pos, rank() over (partition by sku_id order by demand) + (count(*) over (partition by sku_id, demand) - 1) / 2.0 as rk
        from {tail_sql(last, base)})) where pos < {n} group by 1"""


def mk_sql(last, base):
    n = last + base
    sd = (n * (n - 1) * (2 * n + 5) / 18.0) ** 0.5
    z = f"abs((s - sign(s)) / {sd!r})"
    return f"""select sku_id, s as s_stat, 2 * (1 - {phi(z)}) as mk_p from (select a.sku_id, sum(sign(b.demand - a.demand))::double as s
      from {tail_sql(last, base)} a join {tail_sql(last, base)} b on a.sku_id = b.sku_id and b.pos > a.pos group by 1)"""


def shift_sql(last, base):
    p, c = f"demand) filter (back > {last})", f"demand) filter (back <= {last})"
    return f"""select sku_id, case when stddev_pop({p} < 1e-9 then 0.0 else abs(avg({c} - avg({p}) / stddev_pop({p} end as shift_z
      from {tail_sql(last, base)} group by 1"""


cte("pett", pettitt_sql(30, 60)); cte("mk", mk_sql(4, 13)); cte("shz", shift_sql(4, 13)); cte("mk90", mk_sql(30, 60))
register("pettitt", lambda s, sf: rounded(q.pettitt(bt(s, sf), 30, 60)), "select sku_id, k_stat, round(pettitt_p, 6) as pettitt_p from pett")
register("mann_kendall", lambda s, sf: rounded(q.mann_kendall(bt(s, sf), 30, 60)), "select sku_id, s_stat, round(mk_p, 6) as mk_p from mk90")
register("shift_z", lambda s, sf: rounded(q.shift_z(bt(s, sf), 4, 13)), "select sku_id, round(shift_z, 6) as shift_z from shz")
cte("stat_flags", """select mk.sku_id, mk_p, shift_z, 100.0 - case when mk_p < 0.05 then 15 else 0 end - case when shift_z > 2 then 25 else 0 end as score
  from mk join shz using (sku_id)""")
register("stationarity_flags", lambda s, sf: rounded(q.stationarity_flags(bt(s, sf), "W").drop("reason", "pettitt_p")),
         "select sku_id, round(mk_p, 6) as mk_p, round(shift_z, 6) as shift_z, score::double as score from stat_flags")
cte("stat_comp", "select round(avg(score), 2) as score, count(*) filter (score < 70) as n_regime_breaks from stat_flags")
register("dq_stationarity", lambda s, sf: q.dq_stationarity(bt(s, sf), "W"), "select * from stat_comp")
cte("comps", """
  select 'completeness' as name, round(100.0 * (0.4 + 0.6 * least(1.0, (select avg(n / (span / greatest(1.0, gap) + 1)) from (
      select sku_id, count(distinct date) as n, quantile_cont(g::double, 0.5) as gap, max(date) - min(date) as span from (
        select sku_id, date, date - lag(date) over (partition by sku_id order by date) as g from panel) group by 1) where n >= 2))), 2) as score, 0.25 as weight
  union all select 'plausibility', (select score from plaus_bt), 0.25
  union all select 'history_depth', (select round(avg(least(n, 104) / 104.0::double * 100), 2) from (select count(*) as n from panel group by sku_id)), 0.20
  union all select 'stationarity', (select score from stat_comp), 0.15
  union all select 'distribution_profile', (select score from dist), 0.15""")
cte("plaus_bt", """select greatest(0.0, 100.0 - coalesce(sum(least(20.0, 100 * greatest(o / (select count(*) from panel)::double,
    k / (select count(distinct sku_id) from panel)::double))), 0.0)) as score from (
  select count(*) as o, count(distinct sku_id) as k from panel where demand < 0
  union all select count(*), count(distinct sku_id) from panel where unit_price < unit_cost
    having count(*) >= 0.05 * (select count(*) from panel where unit_price is not null)
  union all select count(*), count(distinct sku_id) from (select sku_id, demand,
      quantile_cont(demand, 0.5) over (partition by sku_id order by date rows between 89 preceding and current row) as med,
      count(*) over (partition by sku_id order by date rows between 89 preceding and current row) as seen from panel)
    where seen >= 10 and med > 0 and demand > 10 * med
  union all select sum(n), count(*) from (select sku_id, count(*) as n, max(on_hand) as oh, max(demand) as mx from panel group by 1) where oh > 365 * mx
) where o > 0""")
register("dq_components", lambda s, sf: rounded(q.dq_components(bt(s, sf), "W", "pharma_medical"), 2),
         "select name, round(score, 2) as score, weight::double as weight from comps")
register("dq_composite", lambda s, sf: q.dq_composite(q.dq_components(bt(s, sf), "W", "pharma_medical")),
         "select round(sum(round(score, 2) * weight) / sum(weight), 2) as composite_score from comps where score is not null")
register("dq_notes", lambda s, sf: q.dq_notes(bt(s, sf), "W", s_.series_metrics(bt(s, sf))))


def _report(s, sf):
    path = scratch_path(s, "report")
    files.write_report(q.dq_report(bt(s, sf), "W"), path)
    return rounded(s.read.json(f"{path}/dq_components").select("name", F.col("score").cast("double"), F.col("weight").cast("double")), 2)


cte("mscores_all", """select profile_id, sku_id, case when value between p10 and p90 then 100.0
    when value >= p2 and value < p10 then case when p10 - p2 > 0 then 50.0 + 50.0 * (value - p2) / (p10 - p2) else 75.0 end
    when value > p90 and value <= p98 then case when p98 - p90 > 0 then 50.0 + 50.0 * (p98 - value) / (p98 - p90) else 75.0 end
    when value < p2 then greatest(0.0, 50.0 * (1 - (p2 - value) / greatest(abs(p2), 1e-6)))
    else greatest(0.0, 50.0 * (1 - (value - p98) / greatest(abs(p98), 1e-6))) end as score from tallm join bands using (metric)""")
cte("comps_all", """
  select profile_id, 'distribution_profile' as name, round(quantile_cont(score, 0.5), 2) as score, 0.15 as weight from (
    select profile_id, sku_id, round(avg(score), 9) as score from mscores_all group by 1, 2) group by 1
  union all select profile_id, name, score, weight from comps, (select distinct profile_id from bands) where name <> 'distribution_profile'""")
register("dq_report", _report, "select name, round(score, 2) as score, weight::double as weight from comps_all where profile_id = (select profile_id from mprofile)")


def _rescore(s, sf):
    """Scores a dataset under every profile from one stored metrics table."""
    path = scratch_path(s, "metrics")
    s_.series_metrics(bt(s, sf)).write.parquet(path)
    return q.dq_rescore_profiles(bt(s, sf), "W", s.read.parquet(path))


register("dq_rescore", _rescore, """select profile_id, round(sum(round(score, 2) * weight) / sum(weight), 2) as composite_score
  from comps_all where score is not null group by 1""")

# ---- reference distributions --------------------------------------------------
cte("dept_metrics", f"""select sku_id, category as dept_id, cv_demand, zero_pct as intermittency_rate,
    greatest(acf_lag_7, acf_lag_28, acf_lag_365) as seasonality_strength, abs(trend_slope_pct) as trend_slope_pct,
    abs(last_90d_vs_baseline_ratio - 1.0) as regime_shift_score
  from feats join (select sku_id, min(category) as category from panel group by 1) using (sku_id)""")
_q = ", ".join(f"quantile_cont(value, {v}) as {k}" for k, v in cal.QUANTILE_GRID.items())
cte("refq", f"""select dept_id, metric, count(*) as n_skus, {_q} from (
    select dept_id, metric, value from dept_metrics unpivot (value for metric in ({', '.join(s_.METRICS)}))
    union all select '_default', metric, value from dept_metrics unpivot (value for metric in ({', '.join(s_.METRICS)})))
  group by 1, 2 having count(*) >= 5""")
register("reference_quantiles", lambda s, sf: rounded(cal.reference_quantiles(cal.department_metrics(bt(s, sf)))),
         "select dept_id, metric, n_skus, " + ", ".join(f"round({k}, 6) as {k}" for k in cal.QUANTILE_GRID) + " from refq")


def sku_cat(s, sf):
    """Each SKU under a department name of its own spelling: exact, prefixed or unknown."""
    cat = d.table(s, sf, "part").select(d._brand_type().alias("sku_id"), "p_type", "p_size")
    return cat.groupBy("sku_id").agg(F.min("p_type").alias("p_type"), F.max("p_size").alias("k")).select(
        "sku_id", F.when(F.col("k") % 3 == 0, F.lower("p_type")).when(F.col("k") % 3 == 1, F.concat(F.lower("p_type"), F.lit("_9")))
        .otherwise(F.lit("other")).alias("category"))


cte("sku_cat", """select sku_id, case when k % 3 = 0 then lower(p_type) when k % 3 = 1 then lower(p_type) || '_9' else 'other' end as category
  from (select upper(p_brand || '|' || p_type) as sku_id, min(p_type) as p_type, max(p_size) as k from part group by 1)""")
cte("matched", """with dd as (select dept_id, max(n_skus) as n from refq group by 1)
  select s.sku_id, s.category, coalesce((select dept_id from dd where upper(dept_id) = upper(s.category)),
    (select arg_max(dept_id, (n, dept_id)) from dd where dept_id <> '_default' and split_part(upper(dept_id), '_', 1) = split_part(upper(s.category), '_', 1)),
    '_default') as matched_dept from sku_cat s""")
register("match_dept", lambda s, sf: q.match_dept(sku_cat(s, sf), cal.reference_quantiles(cal.department_metrics(bt(s, sf)))),
         "select * from matched")
register("calibration_position", lambda s, sf: rounded(q.calibration_position(
    s_.series_metrics(bt(s, sf)), sku_cat(s, sf), cal.reference_quantiles(cal.department_metrics(bt(s, sf)))), 4), """
  select m.sku_id, m.metric, matched_dept, round(value, 4) as user_value, round(p1, 4) as ref_p1, round(p50, 4) as ref_p50, round(p99, 4) as ref_p99,
    case when value <= p1 then 'below_p1' when value <= p5 then 'p1_to_p5' when value <= p25 then 'p5_to_p25' when value <= p75 then 'p25_to_p75'
      when value <= p95 then 'p75_to_p95' when value <= p99 then 'p95_to_p99' else 'above_p99' end as position,
    case when value <= p1 then 'below_p1' when value <= p25 then 'p1_to_p25' when value <= p75 then 'p25_to_p75' when value <= p99 then 'p75_to_p99'
      else 'above_p99' end as coarse_position
  from (select sku_id, metric, value from metrics unpivot (value for metric in (%s))) m
  join matched x on x.sku_id = m.sku_id join refq q on q.dept_id = x.matched_dept and q.metric = m.metric""" % ", ".join(s_.METRICS))


def daily_sales(s, sf):
    """Sales lines with an event name and three region flags per day."""
    day = F.to_date("l_shipdate")
    dom = F.dayofmonth(day)
    return d.table(s, sf, "lineitem").select(
        day.alias("date"), F.col("l_quantity").alias("sales"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row_key"),
        F.when((F.month(day) == 12) & (dom == 25), "Christmas").when((F.month(day) == 7) & (dom == 4), "IndependenceDay")
        .when((F.month(day) == 2) & (dom == 29), "LeapDay").alias("event"),
        (dom <= 10).cast("int").alias("snap_CA"), (dom % 2).cast("int").alias("snap_TX"), (dom > 20).cast("int").alias("snap_WI"))


cte("daily_sales", """select cast(l_shipdate as date) as date, l_quantity as sales, l_orderkey || '-' || l_linenumber || '-' || l_partkey as row_key,
    case when month(l_shipdate) = 12 and day(l_shipdate) = 25 then 'Christmas' when month(l_shipdate) = 7 and day(l_shipdate) = 4 then 'IndependenceDay'
      when month(l_shipdate) = 2 and day(l_shipdate) = 29 then 'LeapDay' end as event,
    cast(day(l_shipdate) <= 10 as integer) as snap_CA, day(l_shipdate) % 2 as snap_TX, cast(day(l_shipdate) > 20 as integer) as snap_WI from lineitem""")
register("calendar_lifts", lambda s, sf: cal.calendar_lifts(daily_sales(s, sf)), """
  with k as (select 'dow' as kind, isodow(date)::varchar as key, sales from daily_sales union all
    select 'woy', weekofyear(date)::varchar, sales from daily_sales union all
    select 'event', event, sales from daily_sales where event is not null)
  select kind, key, round(avg(sales) / (select avg(sales) from daily_sales), 4) as lift, count(*) as n from k group by 1, 2
  having kind <> 'event' or count(*) >= 30""")
register("lift_ci", lambda s, sf: cal.lift_ci(daily_sales(s, sf)), f"""
  with rule as (select b, (48271::bigint * (b + 1) * (b + 2)) % {cal.PRIME} as m, (69621::bigint * (b + 1)) % {cal.PRIME} as c from (select unnest(range(0, 200)) as b)),
  r as (select isodow(date)::varchar as dow, weekofyear(date)::varchar as woy, event, sales, {hash8("'0:' || row_key")} % {cal.PRIME} as number from daily_sales where sales is not null),
  x as (select dow, woy, event, sales, b, (number * m + c) % {cal.PRIME} as x from r, rule),
  u as (select * exclude (x), ((x * (x % 65521 + 1)) % {cal.PRIME} + 0.5::double) / {cal.PRIME}::double as u from x),
  w as (select * exclude (u), ({" + ".join(f"(u >= {t!r})::integer" for t in map(float, cal.POISSON))})::double as w from u),
  g as (select coalesce('dow' || dow, 'woy' || woy, 'event' || event) as name, case when dow is not null then 'dow' when woy is not null then 'woy' else 'event' end as kind, coalesce(dow, woy, event) as key, b,
    count(*) as n, sum(w * sales) / sum(w) as m from w group by grouping sets ((dow, b), (woy, b), (event, b)) having coalesce(dow, woy, event) is not null and sum(w) > 0)
  select kind, key, round(quantile_cont(m, 0.025) / (select avg(sales) from daily_sales), 4) as ci_lo, round(quantile_cont(m, 0.975) / (select avg(sales) from daily_sales), 4) as ci_hi,
    max(n) as n, count(*) as replicates from g group by 1, 2 having kind <> 'event' or max(n) >= 30""")
register("flag_lift", lambda s, sf: cal.flag_lift(daily_sales(s, sf), ["snap_CA", "snap_TX", "snap_WI"]), " union all ".join(
    f"select '{f}' as region, round(avg(sales) filter ({f} = 1) / avg(sales) filter ({f} = 0), 4) as lift, "
    f"count(*) filter ({f} = 1) as n_on, count(*) filter ({f} = 0) as n_off from daily_sales" for f in ("snap_CA", "snap_TX", "snap_WI")))


def priced_items(s, sf):
    part = d.table(s, sf, "part")
    dept = F.when(F.col("p_type") == "ECONOMY", "FOODS_1").when(F.col("p_type") == "SMALL", "HOUSEHOLD_1").otherwise("HOBBIES_1")
    return (part.select(F.col("p_partkey").alias("item_id"), dept.alias("dept_id")),
            part.select(F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("sell_price")))


register("category_defaults", lambda s, sf: cal.category_defaults(*priced_items(s, sf)), """
  select dept_id, case when food then 0.32 else 0.25 end::double as holding_cost_rate, case when food then 35.0 else 50.0 end::double as order_cost_default,
    case when food then 1.45 else 1.6 end::double as markup_default,
    case when food then 4.0 when starts_with(dept_id, 'HOUSEHOLD') then 10.0 else 14.0 end::double as default_lead_time_days,
    food as perishable, 7.0::double as review_period_default_days, round(price, 2) as avg_unit_price
  from (select dept_id, starts_with(dept_id, 'FOODS') as food, avg(p_retailprice) as price from (
    select p_retailprice, case when p_type = 'ECONOMY' then 'FOODS_1' when p_type = 'SMALL' then 'HOUSEHOLD_1' else 'HOBBIES_1' end as dept_id from part) group by 1)
  union all select '_default', 0.25, 50.0, 1.5, 14.0, false, 14.0, 5.0""")
PRIOR = """select {keys} count(*) filter (m > 0) as n_observed_skus, avg(m) filter (m > 0) as mean_of_means,
  var_samp(m) filter (m > 0) as var_of_means from {src}"""
cte("sku_means", "select sku_id, min(category) as category, avg(demand) as m from panel group by 1")
cte("prior_by_cat", """select *, case when n_observed_skus < 3 then 1.0 when var_of_means < 1e-3 then greatest(1.0, mean_of_means)
    else mean_of_means * mean_of_means / var_of_means end as alpha,
    case when n_observed_skus < 3 then 0.1 when var_of_means < 1e-3 then 1.0 else mean_of_means / var_of_means end as beta from (
  select category, count(*) filter (m > 0) as n_observed_skus, avg(m) filter (m > 0) as mean_of_means, var_samp(m) filter (m > 0) as var_of_means
  from sku_means group by 1)""")
sku_means = lambda s, sf: bt(s, sf).groupBy("sku_id").agg(F.min("category").alias("category"), F.avg("demand").alias("mean_demand"))
register("fit_prior", lambda s, sf: rounded(cal.fit_prior(sku_means(s, sf), ("category",))), """
  select category, n_observed_skus, round(mean_of_means, 6) as mean_of_means, round(var_of_means, 6) as var_of_means,
    round(alpha, 6) as alpha, round(beta, 6) as beta from prior_by_cat""")
cte("priors", """select dept_id, pattern, case when var_of_means < 1e-6 then greatest(1.0, mean_of_means) else mean_of_means * mean_of_means / var_of_means end as alpha,
    case when var_of_means < 1e-6 then 1.0 else mean_of_means / var_of_means end as beta, n_observed_skus, mean_of_means, var_of_means from (
  select category as dept_id, pattern, count(*) as n_observed_skus, avg(m) as mean_of_means, var_samp(m) as var_of_means
  from sku_means join labels_weak using (sku_id) where m > 0 group by 1, 2 having count(*) >= 5)""")
register("series_priors", lambda s, sf: rounded(cal.series_priors(bt(s, sf))), """
  select dept_id, pattern, round(alpha, 6) as alpha, round(beta, 6) as beta, n_observed_skus, round(mean_of_means, 6) as mean_of_means,
    round(var_of_means, 6) as var_of_means from priors""")
register("train_classifier", lambda s, sf: cal.train_classifier(s_.pattern_features(pm(s, sf)))[1])


def _classify(s, sf):
    feats = s_.pattern_features(pm(s, sf))
    model, _ = cal.train_classifier(feats)
    return cal.classify_pattern(feats, model, s_.characterize(pm(s, sf), "M"))


register("classify_pattern", _classify)

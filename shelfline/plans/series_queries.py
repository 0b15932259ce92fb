from pyspark.sql import functions as F

from ..functions.stats import r
from ..operators import anomalies as a, series as s_
from ..sources import derived as d
from .oracle import cte
from .registry import register


def rounded(df, digits=6, skip=()):
    """Every double column rounded for comparison."""
    return df.select(*[r(F.col(f.name), digits).alias(f.name)
                       if f.dataType.typeName() == "double" and f.name not in skip else F.col(f.name)
                       for f in df.schema.fields])


bt, pm = d.panel_bt, d.panel_pm

for name, lags in (("panel", (1, 4, 7, 13, 26, 28, 52, 365)), ("panel_pm", (3, 6, 12))):
    cols = ", ".join(f"lag(demand, {k}) over w as lag_{k}" for k in lags)
    cte(f"ix_{name}", f"""select sku_id, date, demand, unit_price, category, row_number() over w - 1 as rn,
      count(*) over (partition by sku_id) as n, {cols} from {name} window w as (partition by sku_id order by date)""")


def acf_sql(k):
    return (f"(case when count(*) <= {k} + 1 or coalesce(sqrt(var_pop(demand) filter (lag_{k} is not null) * count(lag_{k}) * "
            f"var_pop(lag_{k}) * count(lag_{k})) < 1e-9, true) then 0.0 else corr(lag_{k}, demand) end)")


def seasonal_sql(lags):
    return "(" + " or ".join(f"(count(*) > {k} + 5 and {acf_sql(k)} > 0.3)" for k in lags) + ")"


ZERO = "avg(case when demand = 0 then 1.0 else 0.0 end)"
SLOPE = ("(case when count(*) < 30 or avg(demand) <= 0 then 0.0 else regr_slope(demand, rn::double) / avg(demand) * 100 end)")


def ratio_sql(last, base, default):
    rec = f"avg(demand) filter (n - rn <= {last})"
    pri = f"avg(demand) filter (n - rn > {last} and n - rn <= {last + base})"
    return f"(case when count(*) < {last + base} or {pri} <= 0 then {default} else {rec} / {pri} end)"


def cv_sql(c="demand"):
    return f"(case when avg({c}) > 0 then stddev_pop({c}) / avg({c}) else 0.0 end)"


register("acf", lambda s, sf: rounded(s_.acf(bt(s, sf), 4)), f"select sku_id, round({acf_sql(4)}, 6) as acf from ix_panel group by 1")
register("is_seasonal", lambda s, sf: s_.is_seasonal(pm(s, sf), "M"),
         f"select sku_id, {seasonal_sql((3, 6, 12))} as seasonal from ix_panel_pm group by 1")
PATTERN = ("case when n_obs < 13 then 'trending_new' when zero_pct > 0.7 then 'lumpy' when zero_pct > 0.3 then 'intermittent' "
           "when seasonal then 'seasonal' else 'smooth' end")
cte("chars", f"""select *, {PATTERN} as pattern from (select sku_id, count(*) as n_obs, {ZERO} as zero_pct,
  {seasonal_sql((4, 13, 26, 52))} as seasonal from ix_panel group by 1)""")
cte("chars_pm", f"""select *, {PATTERN} as pattern from (select sku_id, count(*) as n_obs, {ZERO} as zero_pct,
  {seasonal_sql((3, 6, 12))} as seasonal from ix_panel_pm group by 1)""")
register("characterize", lambda s, sf: rounded(s_.characterize(bt(s, sf), "W")),
         "select sku_id, n_obs, round(zero_pct, 6) as zero_pct, seasonal, pattern from chars")
FEATS = f"""count(*) as n_obs, {ZERO} as zero_pct, {cv_sql()} as cv_demand,
  case when count(*) filter (demand > 0) > 1 and avg(demand) filter (demand > 0) > 0
    then stddev_pop(demand) filter (demand > 0) / avg(demand) filter (demand > 0) else 0.0 end as cv_nonzero_demand,
  {acf_sql(7)} as acf_lag_7, {acf_sql(28)} as acf_lag_28, case when count(*) > 366 then {acf_sql(365)} else 0.0 end as acf_lag_365,
  {SLOPE} as trend_slope_pct, {ratio_sql(90, 180, '1.0')} as last_90d_vs_baseline_ratio"""
cte("feats", f"select sku_id, {FEATS} from ix_panel group by 1")
cte("labels_weak", """select *, case when n_obs < 90 then 'trending_new' when zero_pct > 0.7 then 'lumpy'
  when zero_pct > 0.3 then 'intermittent' when acf_lag_7 > 0.3 or acf_lag_28 > 0.3 or acf_lag_365 > 0.3 then 'seasonal'
  else 'smooth' end as pattern from feats""")
FCOLS = ", ".join(f"round({c}, 6) as {c}" for c in s_.FEATURES if c != "n_obs")
register("pattern_features", lambda s, sf: rounded(s_.pattern_features(bt(s, sf))), f"select sku_id, n_obs, {FCOLS} from feats")
register("weak_labels", lambda s, sf: s_.weak_labels(s_.pattern_features(bt(s, sf))).select("sku_id", "pattern"),
         "select sku_id, pattern from labels_weak")
register("regime_break", lambda s, sf: rounded(s_.regime_break(pm(s, sf), 6, 24).drop("note")),
         f"select sku_id, round(ratio, 6) as ratio from (select sku_id, {ratio_sql(6, 24, 'null')} as ratio from ix_panel_pm group by 1) where ratio < 0.5 or ratio > 2.0")
register("add_lags", lambda s, sf: s_.add_lags(bt(s, sf).select("sku_id", "date", "demand"), "W"),
         "select sku_id, date, demand, lag_1, lag_4, lag_13, lag_26 from ix_panel")
ROLL = ", ".join(f"case when count(demand) over (partition by sku_id order by date rows between {w} preceding and 1 preceding) >= 2 "
                 f"then round(avg(demand) over (partition by sku_id order by date rows between {w} preceding and 1 preceding), 6) end as rmean_{w}"
                 for w in (4, 13))
register("add_rolling", lambda s, sf: rounded(s_.add_rolling(bt(s, sf).select("sku_id", "date", "demand"), "W")),
         f"select sku_id, date, demand, {ROLL} from panel")
register("add_calendar", lambda s, sf: s_.add_calendar(bt(s, sf).select("sku_id", "date")), """
  select sku_id, date, cast(isodow(date) - 1 as integer) as dow, cast(weekofyear(date) as integer) as woy,
    cast(month(date) as integer) as month, cast(date = last_day(date) as integer) as is_month_end,
    cast(month(date) = 12 and day(date) = 31 as integer) as is_year_end from panel""")
register("attach_attributes", lambda s, sf: s_.attach_attributes(
    bt(s, sf).select("sku_id", "date", "demand"),
    d.table(s, sf, "part").where(F.col("p_size") > 20).groupBy(d._brand_type().alias("sku_id"))
    .agg((F.max("p_size") / 50.0).alias("essential"), F.min("p_size").cast("double").alias("giftable")),
    {"essential": 0.5, "giftable": 0.0}), """
  select p.sku_id, date, demand, coalesce(essential, 0.5) as essential, coalesce(giftable, 0.0) as giftable from panel p left join (
    select upper(p_brand || '|' || p_type) as sku_id, max(p_size) / 50.0 as essential, min(p_size)::double as giftable
    from part where p_size > 20 group by 1) a on a.sku_id = p.sku_id""")


def decomposition_ctes(tag, ix, season):
    mid = lambda w: (f"avg(b.demand) filter (b.rn between a.rn - {w} // 2 and a.rn + ({w} - 1) // 2)")
    cte(f"dec1_{tag}", f"""select *, case when n < greatest(period, 4) then greatest(2, n // 2) else greatest(period, 4) end as w,
      case when n < period then greatest(2, n // 2) else period end as v from (
        select sku_id, date, demand, rn, n, least({season}, greatest(2, n // 3)) as period from {ix} where n >= 12)""")
    cte(f"dec2_{tag}", f"""select *, rn % period as phase, demand - short as det from (
      select sku_id, date, demand, rn, n, period,
        avg(demand) over (partition by sku_id order by rn rows between (w // 2) preceding and ((w - 1) // 2) following) as trend,
        avg(demand) over (partition by sku_id order by rn rows between (v // 2) preceding and ((v - 1) // 2) following) as short
      from dec1_{tag})""")
    cte(f"dec_{tag}", f"""select sku_id, date, demand as observed, trend, seasonal, demand - trend - seasonal as residual, period as seasonal_period from (
      select d.*, case when n < 2 * d.period then 0.0 else m.mean - c.centre end as seasonal from dec2_{tag} d
      join (select sku_id, phase, avg(det) as mean from dec2_{tag} group by 1, 2) m on m.sku_id = d.sku_id and m.phase = d.phase
      join (select sku_id, avg(mean) as centre from (select sku_id, phase, avg(det) as mean from dec2_{tag} group by 1, 2) group by 1) c
        on c.sku_id = d.sku_id)""")


decomposition_ctes("w", "ix_panel", 52)
decomposition_ctes("m", "ix_panel_pm", 12)
register("decompose", lambda s, sf: rounded(s_.decompose(bt(s, sf), "W"), 5), """
  select sku_id, date, observed, round(trend, 5) as trend, round(seasonal, 5) as seasonal, round(residual, 5) as residual,
    seasonal_period from dec_w""")
register("trend", lambda s, sf: rounded(s_.trend(pm(s, sf), "M"), 5), "select sku_id, date, round(trend, 5) as trend from dec_m")
register("seasonal", lambda s, sf: rounded(s_.seasonal(pm(s, sf), "M"), 5),
         "select sku_id, date, round(seasonal, 5) as seasonal, seasonal_period from dec_m")

# ---- anomalies ---------------------------------------------------------------
cte("rz1", """select sku_id, date, demand, row_number() over (partition by sku_id order by date) - 1 as i,
  count(*) over (partition by sku_id) as n from panel""")
cte("rz2", """select a.sku_id, a.date, a.demand, a.i, median(b.demand) as med from rz1 a join rz1 b on b.sku_id = a.sku_id
  and abs(b.i - a.i) <= greatest(5, least(13, a.n // 4)) // 2 where a.n >= 8 group by 1, 2, 3, 4""")
cte("rz", """select a.sku_id, a.date, a.demand, a.i, a.med, greatest(median(abs(b.demand - a.med)), 1e-9) as mad,
    (a.demand - a.med) / (1.4826 * greatest(median(abs(b.demand - a.med)), 1e-9)) as z
  from rz2 a join rz1 b on b.sku_id = a.sku_id and abs(b.i - a.i) <= greatest(5, least(13, b.n // 4)) // 2 group by 1, 2, 3, 4, 5""")
cte("cus", """with recursive fold as (
    select sku_id, date, demand, i, med, mad, z, 0.0::double as pos, 0.0::double as neg from rz where i = 0
    union all select r.sku_id, r.date, r.demand, r.i, r.med, r.mad, r.z, greatest(0.0::double, f.pos + r.z - 0.5), least(0.0::double, f.neg + r.z + 0.5)
    from fold f join rz r on r.sku_id = f.sku_id and r.i = f.i + 1)
  select * from fold""")
cte("evs", """select sku_id, date, demand as value, case when z >= 0 then 'spike' else 'drop' end as direction, z as magnitude_z,
    case when abs(pos) > abs(neg) then pos else neg end as cusum_score, med as baseline_mean, 1.4826 * mad as baseline_std,
    case when abs(z) > 4 or pos >= 4 or neg <= -4 then 'crit' when abs(z) > 3 then 'warn' else 'info' end as severity
  from cus where abs(z) >= 2.5 or pos >= 4 or neg <= -4""")


def score_sql(c):
    """Four decimals; whole numbers from a million up, where a zero spread puts the scores."""
    return f"case when abs({c}) >= 1e6 then round({c}) else round({c}, 4) end"


def scored(df, *cols):
    return df.withColumns({c: F.when(F.abs(c) >= 1e6, F.round(c)).otherwise(F.round(c, 4)) for c in cols})


register("robust_z", lambda s, sf: rounded(a.robust_z(bt(s, sf)).drop("_i").withColumn("z", F.round("z", 3)), 3),
         "select sku_id, date, demand, round(med, 3) as median, round(mad, 3) as mad, round(z, 3) as z from rz")


def _panel(s, sf):
    return bt(s, sf).select("sku_id", "date", "demand", "category", "unit_price")


register("cusum", lambda s, sf: scored(a.cusum(bt(s, sf)).select("sku_id", "date", "cusum_pos", "cusum_neg"), "cusum_pos", "cusum_neg"),
         f"select sku_id, date, {score_sql('pos')} as cusum_pos, {score_sql('neg')} as cusum_neg from cus")
register("anomaly_events", lambda s, sf: scored(a.events(_panel(s, sf)), "magnitude_z", "cusum_score", "baseline_mean", "baseline_std"), f"""
  select sku_id, date, value, direction, {score_sql('magnitude_z')} as magnitude_z, {score_sql('cusum_score')} as cusum_score,
    round(baseline_mean, 4) as baseline_mean, round(baseline_std, 4) as baseline_std, severity from evs""")
register("anomalies", lambda s, sf: scored(a.anomalies(_panel(s, sf)).select("sku_id", "date", "pos", "magnitude_z", "severity"), "magnitude_z"), f"""
  select sku_id, date, pos, {score_sql('magnitude_z')} as magnitude_z, severity from (select *, row_number() over (partition by sku_id
    order by round(abs(magnitude_z), 6) desc, date) as pos from evs) where pos <= 5""")
register("anomaly_near", lambda s, sf: scored(a.anomaly_near(_panel(s, sf), "1998-06-01").select("sku_id", "date", "magnitude_z"), "magnitude_z"), f"""
  select sku_id, date, {score_sql('magnitude_z')} as magnitude_z from (
    select *, row_number() over (partition by sku_id order by abs(date - date '1998-06-01'), date) as k from evs) where k = 1""")
register("siblings", lambda s, sf: a.siblings(bt(s, sf)), """
  with p as (select sku_id, category, round(coalesce(sum(demand * unit_price), sum(demand)), 2) as rv from panel group by 1, 2)
  select sku_id, category, pos, sibling, revenue_proxy from (select x.sku_id, x.category, y.sku_id as sibling, y.rv as revenue_proxy,
    row_number() over (partition by x.sku_id order by y.rv desc, y.sku_id) as pos from p x join p y on y.category = x.category and y.sku_id <> x.sku_id) where pos <= 3""")
_hol = ", ".join("({}, {}, '{}')".format(m, dd, lab.replace("'", "''")) for m, dd, lab in a.HOLIDAYS)
cte("ctx", f"""
  with h as (select row_number() over () as k, * from (values {_hol}) t(m, d, label)),
  e as (select * from evs),
  near as (select sku_id, date, k, label || ' (' || strftime(hd, '%Y-%m-%d') || ')' as txt from (
    select sku_id, date, k, label, hd, row_number() over (partition by sku_id, date, k order by hd) as q from (
      select e.sku_id, e.date, h.k, h.label, make_date(year(e.date) + y, h.m, h.d) as hd from e, h, (values (-1), (0), (1)) yy(y))
    where abs(hd - date) <= 14) where q = 1
    union all select sku_id, date, 98, 'first ' || day(date) || ' day(s) of ' || monthname(date) from e where day(date) <= 3
    union all select sku_id, date, 99, 'end of ' || monthname(date) from e where day(date) >= 28)
  select e.*, string_agg(txt, ', ' order by k) as context from e left join near n on n.sku_id = e.sku_id and n.date = e.date group by all""")
register("calendar_context", lambda s, sf: a.calendar_context(a.events(_panel(s, sf))).select(
    "sku_id", "date", F.array_join("context", ", ").alias("context")),
    "select sku_id, date, coalesce(context, '') as context from ctx")
register("judge_event", lambda s, sf: a.judge_event(a.events(_panel(s, sf))).withColumn("evidence", F.array_join("evidence", "; ")), """
  select sku_id, date, case when context is not null then 'holiday_or_calendar' else 'unclear' end as cause,
    case when context is not null then 0.3 else 0.15 end::double as confidence,
    'Robust z = ' || printf('%+.1f', round(magnitude_z, 1)) || ' on ' || strftime(date, '%Y-%m-%d') || ' (' || direction || ')'
      || case when context is not null then '; Calendar markers within ±2 weeks: ' || context else '' end as evidence,
    'investigate_manually' as suggested_adjustment, 'heuristic' as source from ctx""")

from pyspark.sql import functions as F

from ..functions.stats import r
from ..operators import calibration as cal, evaluation as ev, forecast as fo, outlook as ol, series as s_
from ..schema import QUANTILE_COLS, QUANTILE_LEVELS, QUANTILE_Z
from ..session import materialise, scratch_path
from ..sources import derived as d, files
from .oracle import cte, hash8
from .registry import register
from .series_queries import bt, pm, rounded

H, FOLDS, M = 6, 3, 12
series = lambda s, sf: fo.to_series(pm(s, sf))
QC = QUANTILE_COLS


def ragged(s, sf):
    """Weekly panel with histories of 4 to 343 weeks."""
    p = bt(s, sf)
    last = p.agg(F.max("date")).scalar()
    keep = F.lit(4) + F.pmod(d.hash8(F.concat(F.lit("rg"), F.col("sku_id"))), F.lit(20)) * F.when(
        F.pmod(d.hash8(F.col("sku_id")), F.lit(2)) == 0, 1).otherwise(17)
    return p.where(F.datediff(last, F.col("date")) < 7 * keep)


cte("ragged", f"""select * from panel where (select max(date) from panel) - date < 7 * (4 + ({hash8("'rg' || sku_id")} % 20)
  * case when {hash8('sku_id')} % 2 = 0 then 1 else 17 end)""")

# ---- monthly series, cutoffs and three forecasters in SQL ------------------------
cte("ser", "select sku_id, date, demand, row_number() over (partition by sku_id order by date) - 1 as rn, count(*) over (partition by sku_id) as n from panel_pm")
cte("cuts", f"""select sku_id, n, cast(row_number() over (partition by sku_id order by cut) - 1 as integer) as fold, cast(cut as integer) as cutoff from (
  select sku_id, n, unnest(case when n - {H} < 8 then [] when n - {H} <= first then [n - {H}]
      else list_slice(range(first, n - {H} + 1, greatest(1, (n - {H} - first) // {FOLDS - 1})), 1, {FOLDS}) end) as cut from (
    select sku_id, n, greatest(8, n - {H} - {(FOLDS - 1) * H}) as first from (select sku_id, count(*) as n from ser group by 1)))""")
# folds plus the forward forecast (fold -1, cut at the end)
cte("runs", "select sku_id, fold, cutoff from cuts union all select sku_id, -1, cast(count(*) as integer) from ser group by 1")
cte("steps", f"select unnest(range(1, {H + 1})) as step")
cte("dsig", """select r.sku_id, r.fold, case when stddev_pop(df) > 1e-9 then stddev_pop(df) else 1.0 end as sigma, avg(abs(df)) as scale from runs r join (
    select sku_id, rn, demand - lag(demand) over (partition by sku_id order by rn) as df from ser) x on x.sku_id = r.sku_id and x.rn < r.cutoff group by 1, 2""")
cte("snv", f"""select r.sku_id, r.fold, s.step, y.demand as point, sg.sigma * sqrt(floor((s.step - 1) / r.p) + 1) as sig from (
    select *, case when cutoff >= {M} then {M} else 1 end as p from runs) r, steps s
  join ser y on y.sku_id = r.sku_id and y.rn = r.cutoff - r.p + (s.step - 1) % r.p
  join (select r.sku_id, r.fold, sqrt(avg(df * df)) as sigma from runs r join (
      select sku_id, rn, demand - lag(demand, {M}) over (partition by sku_id order by rn) as df from ser) x on x.sku_id = r.sku_id and x.rn < r.cutoff group by 1, 2) sg
    on sg.sku_id = r.sku_id and sg.fold = r.fold""")
cte("cro", """with recursive c as (select sku_id, -1::bigint as rn, 0.0::double as z, 0.0::double as p, 1.0::double as q from (select distinct sku_id from ser)
  union all select s.sku_id, s.rn, case when s.demand = 0 then c.z when c.p = 0 then s.demand else 0.1 * s.demand + 0.9 * c.z end,
    case when s.demand = 0 then c.p when c.p = 0 then c.q else 0.1 * c.q + 0.9 * c.p end, case when s.demand = 0 then c.q + 1.0 else 1.0 end
  from c join ser s on s.sku_id = c.sku_id and s.rn = c.rn + 1) select * from c""")
cte("tsb", """with recursive c as (select sku_id, -1::bigint as rn, -1.0::double as pr, -1.0::double as z from (select distinct sku_id from ser)
  union all select s.sku_id, s.rn, case when c.pr < 0 then (s.demand <> 0)::integer::double else 0.2 * (s.demand <> 0)::integer + 0.8 * c.pr end,
    case when s.demand = 0 then c.z when c.z < 0 then s.demand else 0.2 * s.demand + 0.8 * c.z end
  from c join ser s on s.sku_id = c.sku_id and s.rn = c.rn + 1) select * from c""")
cte("crf", """select r.sku_id, r.fold, s.step, case when p > 0 then z / p else 0.0 end as point, sigma as sig from runs r join cro on cro.sku_id = r.sku_id and cro.rn = r.cutoff - 1
  join dsig on dsig.sku_id = r.sku_id and dsig.fold = r.fold, steps s""")
cte("tsf", """select r.sku_id, r.fold, s.step, case when z < 0 then 0.0 else pr * z end as point, sigma as sig from runs r join tsb on tsb.sku_id = r.sku_id and tsb.rn = r.cutoff - 1
  join dsig on dsig.sku_id = r.sku_id and dsig.fold = r.fold, steps s""")
QS = ", ".join(f"greatest(0.0, point + {z!r} * sig) as {c}" for z, c in zip(QUANTILE_Z, QC))
for tag, src in (("sn", "snv"), ("cr", "crf"), ("ts", "tsf")):
    cte(f"fc_{tag}", f"select sku_id, cast(step as integer) as step, greatest(0.0, point) as point, {QS} from {src} where fold = -1")
    cte(f"bt_{tag}", f"""select f.sku_id, f.fold, c.cutoff, scale, cast(f.step as integer) as step, y.demand as actual, greatest(0.0, point) as point, {QS}
      from {src} f join cuts c on c.sku_id = f.sku_id and c.fold = f.fold join dsig on dsig.sku_id = f.sku_id and dsig.fold = f.fold
      join ser y on y.sku_id = f.sku_id and y.rn = c.cutoff + f.step - 1""")
cte("bt_all", "select *, 'seasonal_naive' as method from bt_sn union all select *, 'croston' from bt_cr union all select *, 'tsb' from bt_ts")


def rq(cols, digits=4):
    return ", ".join(f"round({c}, {digits}) as {c}" for c in cols)


FC = ("point",) + QC
register("to_long", lambda s, sf: fo.to_long(pm(s, sf)), "select sku_id as unique_id, date::timestamp as ds, demand as y from panel_pm")
register("route_model", lambda s, sf: fo.route_model(series(s, sf), "M").select("sku_id", "pattern", "method"), """
  select sku_id, pattern, case pattern when 'smooth' then 'ets' when 'seasonal' then 'arima' when 'intermittent' then 'croston' when 'lumpy' then 'tsb'
    else 'seasonal_naive' end as method from chars_pm""")
register("forecast_snaive", lambda s, sf: rounded(fo.forecast_snaive(pm(s, sf), H, "M"), 4), f"select sku_id, step, {rq(FC)} from fc_sn")
register("forecast_croston", lambda s, sf: rounded(fo.forecast_croston(pm(s, sf), H), 4), f"select sku_id, step, {rq(FC)} from fc_cr")
register("forecast_tsb", lambda s, sf: rounded(fo.forecast_tsb(pm(s, sf), H), 4), f"select sku_id, step, {rq(FC)} from fc_ts")
# the smoothing grid by plain recursion: every series with every weight setting, the season as a list
cte("ets_y", "select sku_id, list(demand order by date) as y, count(*) as n from panel group by 1")
cte("ets_g", "select * from (values " + ", ".join(f"({k}, {a!r}::double, {b!r}::double, {g!r}::double)" for k, (a, b, g) in enumerate(fo.ETS_GRID)) + ") t(k, al, be, ga)")
cte("ets_r", """with recursive r as (
  select sku_id, k, al, be, ga, n, y, 0::bigint as t, case when ga > 0 then f else y[1] end as lev, 0.0::double as slope, [case when ga > 0 then y[i + 1] - f else 0.0 end for i in range(0, 52)]::double[] as sea, 0.0::double as sse
  from (select *, list_avg(y[1:52]) as f from ets_y, ets_g where ga = 0 or n >= 104)
  union all select sku_id, k, al, be, ga, n, y, t + 1, base + al * err, case when be > 0 then 0.9 * slope + al * be * err else 0.0 end,
    case when ga > 0 then list_transform(sea, lambda v, i: case when i - 1 = (t + 1) % 52 then v + ga * err else v end) else sea end, sse + err * err
  from (select *, y[t + 2] - (base + sea[(t + 1) % 52 + 1]) as err from (select *, lev + case when be > 0 then 0.9 * slope else 0.0 end as base from r where t + 1 < n)))
  select * exclude (y) from r where t = n - 1""")
cte("ets_b", "select *, sqrt(sse / greatest(n - 1, 1)) as sigma from ets_r qualify row_number() over (partition by sku_id order by sse, k) = 1")
cte("fc_ets", f"""select sku_id, cast(step as integer) as step, greatest(0.0, point) as point, {QS} from (
  select sku_id, step, lev + case when be > 0 then damp(step) * slope else 0.0 end + sea[(n + step - 1) % 52 + 1] as point,
    sigma * sqrt(1.0 + coalesce(list_sum([(al * (1 + be * damp(j))) ** 2 for j in range(1, step)]), 0.0)) as sig
  from ets_b, (select unnest(range(1, 13)) as step))""".replace("damp(step)", "(0.9 * (1 - 0.9 ** step) / (1 - 0.9))").replace("damp(j)", "(0.9 * (1 - 0.9 ** j) / (1 - 0.9))"))
register("forecast_ets", lambda s, sf: rounded(fo.forecast_ets(bt(s, sf), 12, "W"), 4), f"select sku_id, step, {rq(FC)} from fc_ets")
register("forecast_seasonal_ar", lambda s, sf: fo.forecast_seasonal_ar(bt(s, sf), 12, "W"))
register("forecast_gbt", lambda s, sf: ol.forecast_gbt(bt(s, sf), 4, "W"))
_feats = [f"lag_{k}" for k in s_.MODEL_LAGS["W"]] + [f"rmean_{w}" for w in s_.ROLLING["W"]]
_lag = ", ".join(f"lag(demand, {k}) over (partition by sku_id order by date) as lag_{k}" for k in s_.MODEL_LAGS["W"])
_roll = ", ".join(f"case when count(demand) over (partition by sku_id order by date rows between {w} preceding and 1 preceding) >= 2 then avg(demand) over (partition by sku_id order by date rows between {w} preceding and 1 preceding) end as rmean_{w}" for w in s_.ROLLING["W"])
_past = lambda c: f"""(select {c + ', ' if c else ''}date, sum(s) over (partition by {c or "1"} order by date rows between unbounded preceding and 1 preceding) as s, sum(n) over (partition by {c or "1"} order by date rows between unbounded preceding and 1 preceding) as n
  from (select {c + ', ' if c else ''}date, sum(demand) as s, count(demand) as n from panel group by all))"""
register("design_matrix", lambda s, sf: rounded(ol.design_matrix(bt(s, sf), "W"), 5), f"""
  with x as (select *, {_lag}, {_roll} from panel), a as {_past('')}
  select x.sku_id, x.date, round(demand, 5) as label, {", ".join(f"round({c}, 5) as {c}" for c in _feats)}, cast(isodow(x.date) - 1 as integer) as dow, cast(weekofyear(x.date) as integer) as woy, cast(month(x.date) as integer) as month,
    cast(x.date = last_day(x.date) as integer) as is_month_end, cast(month(x.date) = 12 and day(x.date) = 31 as integer) as is_year_end,
    {", ".join(f"round(coalesce((coalesce(p_{c}.s, 0.0) + {ol.PRIOR_ROWS} * (a.s / a.n)) / (coalesce(p_{c}.n, 0) + {ol.PRIOR_ROWS}), 0.0), 5) as {c}_mean" for c in ol.CATEGORICAL)}
  from x join a on a.date = x.date {" ".join(f"join {_past(c)} p_{c} on p_{c}.{c} is not distinct from x.{c} and p_{c}.date = x.date" for c in ol.CATEGORICAL)}
  where lag_1 is not null""")


def _normal(s, sf):
    st = bt(s, sf).groupBy("sku_id").agg(F.avg("demand").alias("point"), F.stddev_pop("demand").alias("sigma"))
    return rounded(fo.normal_quantiles(st, "point", "sigma"), 5)


register("normal_quantiles", _normal, "select sku_id, round(point, 5) as point, round(sig, 5) as sigma, " + ", ".join(
    f"round(greatest(0.0, point + {z!r} * sig), 5) as {c}" for z, c in zip(QUANTILE_Z, QC))
    + " from (select sku_id, avg(demand) as point, stddev_pop(demand) as sig from panel group by 1)")
register("residual_sigma", lambda s, sf: rounded(fo.residual_sigma(s_.decompose(bt(s, sf), "W").withColumnRenamed("observed", "demand")), 4), """
  select sku_id, round(case when stddev_pop(residual) > 0 then stddev_pop(residual) else 1.0 end, 4) as sigma from dec_w group by 1""")
register("difference_sigma", lambda s, sf: fo.to_series(bt(s, sf)).select("sku_id", r(fo.difference_sigma(F.col("y")), 5).alias("sigma")), """
  select sku_id, round(stddev_pop(df), 5) as sigma from (select sku_id, demand - lag(demand) over (partition by sku_id order by date) as df from panel) group by 1""")

# ---- cold start ------------------------------------------------------------------
prior_of = lambda s, sf: cal.fit_prior(bt(s, sf).groupBy("sku_id").agg(F.min("category").alias("category"), F.avg("demand").alias("mean_demand")), ("category",))


def sku_prior(s, sf):
    return ragged(s, sf).groupBy("sku_id").agg(F.min("category").alias("category")).join(prior_of(s, sf), "category")


cte("posts", """select sku_id, n_obs, alpha + sum_y as a, beta + n_obs as b, beta / (beta + n_obs) as pw from (
  select sku_id, min(category) as category, count(*) as n_obs, sum(demand) as sum_y from ragged group by 1) join prior_by_cat using (category)""")
register("posterior", lambda s, sf: rounded(fo.posterior(ragged(s, sf), sku_prior(s, sf)), 5), """
  select sku_id, n_obs, round(a, 5) as alpha_post, round(b, 5) as beta_post, round(a / b, 5) as mean, round(pw, 5) as prior_weight from posts""")
_nq = ", ".join(f"min(k) filter (cdf >= {lv})::double as {c}" for lv, c in zip(QUANTILE_LEVELS, QC))
register("negbin_quantiles", lambda s, sf: rounded(fo.negbin_quantiles(fo.posterior(ragged(s, sf), sku_prior(s, sf))), 5), f"""
  select sku_id, round(any_value(mean), 5) as mean, {_nq} from (select sku_id, k, mean, sum(exp(lgamma(k + a) - lgamma(a) - lgamma(k + 1) + a * ln(b / (b + 1)) + k * ln(1 / (b + 1))))
      over (partition by sku_id order by k) as cdf from (
    select sku_id, a, b, a / b as mean, unnest(range(0, cast(ceil(a / b + 12 * sqrt(a / b * (b + 1) / b) + 12) as bigint) + 1)) as k from posts)) group by 1""")


def lookup_skus(s, sf):
    k = F.col("k")
    return d.table(s, sf, "part").groupBy(d._brand_type().alias("sku_id")).agg(F.max("p_size").alias("k"), F.min("p_type").alias("t")).select(
        "sku_id", F.when(k % 3 == 0, F.col("t")).when(k % 3 == 1, F.concat("t", F.lit("_2"))).otherwise("none").alias("category"),
        F.when(k % 4 == 0, "smooth").when(k % 4 == 1, "intermittent").otherwise("seasonal").alias("pattern"))


cte("lsk", """select sku_id, case when k % 3 = 0 then t when k % 3 = 1 then t || '_2' else 'none' end as category,
    case when k % 4 = 0 then 'smooth' when k % 4 = 1 then 'intermittent' else 'seasonal' end as pattern
  from (select upper(p_brand || '|' || p_type) as sku_id, max(p_size) as k, min(p_type) as t from part group by 1)""")
register("lookup_prior", lambda s, sf: rounded(fo.lookup_prior(lookup_skus(s, sf), cal.series_priors(bt(s, sf)))), """
  with c as (select l.sku_id, l.category, p.* from lsk l join priors p on p.pattern = l.pattern or l.pattern not in (select pattern from priors)),
  e as (select sku_id, arg_max(alpha, (n_observed_skus, dept_id, pattern)) as a, arg_max(beta, (n_observed_skus, dept_id, pattern)) as b from c where upper(dept_id) = upper(category) group by 1),
  f as (select sku_id, arg_max(alpha, (n_observed_skus, dept_id, pattern)) as a, arg_max(beta, (n_observed_skus, dept_id, pattern)) as b from c
    where split_part(upper(dept_id), '_', 1) = split_part(upper(category), '_', 1) group by 1),
  g as (select sku_id, sum(alpha * n_observed_skus) / sum(n_observed_skus) as a, sum(beta * n_observed_skus) / sum(n_observed_skus) as b from c group by 1)
  select g.sku_id, round(coalesce(e.a, f.a, g.a), 6) as alpha, round(coalesce(e.b, f.b, g.b), 6) as beta,
    case when e.a is not null then 'exact' when f.a is not null then 'prefix' else 'average' end as source
  from g left join e on e.sku_id = g.sku_id left join f on f.sku_id = g.sku_id""")
register("needs_cold_start", lambda s, sf: fo.needs_cold_start(ragged(s, sf), "W"),
         "select sku_id, count(*) as n_obs, count(*) < 26 as cold_start from ragged group by 1")
register("future_dates", lambda s, sf: fo.future_dates(bt(s, sf), 4, "W"), """
  select sku_id, cast(i as integer) as step, date_trunc('week', mx)::date + cast(7 * i as integer) as ds from (select sku_id, max(date) as mx from panel group by 1), (select unnest(range(1, 5)) as i)""")
register("future_dates_monthly", lambda s, sf: fo.future_dates(pm(s, sf), 3, "M"), """
  select sku_id, cast(i as integer) as step, cast(date_trunc('month', mx) + to_months(cast(i as integer)) as date) as ds
  from (select sku_id, max(date) as mx from panel_pm group by 1), (select unnest(range(1, 4)) as i)""")
cte("cav", f"""select sku_id, pattern in ('intermittent','lumpy') as croston, ratio from chars left join (
  select sku_id, case when count(*) >= 90 and avg(demand) filter (n - rn > 30 and n - rn <= 90) > 0 then avg(demand) filter (n - rn <= 30) / avg(demand) filter (n - rn > 30 and n - rn <= 90) end as ratio
  from ix_panel group by 1) using (sku_id)""")
register("caveats", lambda s, sf: ol.caveats(bt(s, sf), "W").select("sku_id", F.array_join("caveats", " | ").alias("caveats")), """
  select sku_id, concat_ws(' | ', case when croston then 'intermittent/lumpy demand — Croston-family methods produce point forecasts; intervals come from a normal residual approximation in v1.' end,
    case when ratio < 0.5 or ratio > 2.0 then 'regime break detected: recent 30-period mean is ' || printf('%.2f', ratio) || 'x prior 60-period mean' end) as caveats from cav""")

# ---- backtest and metrics ------------------------------------------------------------
one = lambda s, sf, m: ev.backtest(series(s, sf), "M", m, H, FOLDS)


def stored_series(s, sf):
    """The monthly series written once, for queries that read them for several methods: the panel is made once."""
    path = scratch_path(s, "series")
    series(s, sf).select("sku_id", "y", "n").write.parquet(path)
    return s.read.schema("sku_id string, y array<double>, n int").parquet(path)


def three(s, sf, x=None):
    x = stored_series(s, sf) if x is None else x
    bt = lambda m: ev.backtest(x, "M", m, H, FOLDS)
    return bt("seasonal_naive").unionByName(bt("croston")).unionByName(bt("tsb"))


register("cutoffs", lambda s, sf: ev.cutoffs(pm(s, sf), H, FOLDS), "select sku_id, fold, cutoff from cuts")
BT = ("scale", "actual") + FC
register("backtest_snaive", lambda s, sf: rounded(one(s, sf, "seasonal_naive"), 4),
         f"select sku_id, 'seasonal_naive' as method, fold, cutoff, step, {rq(BT)} from bt_sn")
register("backtest_croston", lambda s, sf: rounded(one(s, sf, "croston"), 4),
         f"select sku_id, 'croston' as method, fold, cutoff, step, {rq(BT)} from bt_cr")
register("backtest_route", lambda s, sf: ev.fold_metrics(ev.backtest(fo.to_series(bt(s, sf)), "W", "route", 4, 4)))
PIN = lambda c, lv: f"avg(case when actual >= {c} then {lv} * (actual - {c}) else {lv - 1!r} * (actual - {c}) end)"
METRIC_SQL = {
    "mape": "avg(abs((actual - point) / actual)) filter (abs(actual) > 1e-9) * 100",
    "smape": "avg(2.0 * abs(actual - point) / (abs(actual) + abs(point))) filter (abs(actual) + abs(point) > 1e-9) * 100",
    "mase": "case when max(scale) >= 1e-9 then avg(abs(actual - point)) / max(scale) end",
    "bias": "case when avg(abs(actual)) >= 1e-9 then avg(point - actual) / avg(abs(actual)) end",
    "pinball_q95": PIN("q975", 0.95),
    "crps": "2.0 * (" + " + ".join(PIN(c, lv) for c, lv in zip(QC, QUANTILE_LEVELS)) + ") / 5",
}
PY_METRIC = {"mape": ev.mape, "smape": ev.smape, "mase": ev.mase, "bias": ev.bias, "crps": ev.crps_quantiles,
             "pinball_q95": lambda: ev.pinball("q975", 0.95)}
for name, fn in PY_METRIC.items():
    register(f"metric_{name}", (lambda fn, name: lambda s, sf: rounded(
        one(s, sf, "croston").groupBy("sku_id", "fold").agg(fn().alias(name)), 5))(fn, name),
        f"select sku_id, fold, round({METRIC_SQL[name]}, 5) as {name} from bt_cr group by 1, 2")
cte("fmet", "select sku_id, method, fold, " + ", ".join(f"{v} as {k}" for k, v in METRIC_SQL.items()) + " from bt_all group by 1, 2, 3")
cte("bsum", "select sku_id, method, count(*) as n_folds, " + ", ".join(f"avg({m}) as {m}" for m in ev.METRIC_NAMES) + " from fmet group by 1, 2")
register("backtest_summary", lambda s, sf: rounded(ev.backtest_summary(three(s, sf)), 3),
         f"select sku_id, method, n_folds, {rq(ev.METRIC_NAMES, 3)} from bsum")


def samples(s, sf):
    """The last three actuals of a SKU against the three before as samples."""
    f = ev.fold_rows(series(s, sf), 3, 1)
    return f.select("sku_id", F.posexplode("actual").alias("step", "actual"), F.slice("y", F.col("cutoff") - 11, 12).alias("_s")).select(
        "sku_id", "step", "actual", F.explode("_s").alias("x"))


register("crps_samples", lambda s, sf: rounded(ev.crps_samples(samples(s, sf)), 5), """
  with a as (select sku_id, rn - (n - 3) as step, demand as actual from ser where rn >= n - 3), x as (select sku_id, rn, demand as x from ser where rn < n - 3 and rn >= n - 15)
  select sku_id, round(avg(t1 - t2), 5) as crps from (select a.sku_id, a.step, avg(abs(x.x - a.actual)) as t1, any_value(t2) as t2 from a join x on x.sku_id = a.sku_id
    join (select p.sku_id, 0.5 * avg(abs(p.x - q.x)) as t2 from x p join x q on q.sku_id = p.sku_id group by 1) z on z.sku_id = a.sku_id group by 1, 2) group by 1""")
cte("h1", f"""select sku_id, cast(n - {H} as integer) as cutoff from (select sku_id, count(*) as n from ser group by 1)""")
register("holdout_crps", lambda s, sf: rounded(ev.holdout_crps(pm(s, sf), "M", "croston", H), 5),
         f"select sku_id, 'croston' as method, round({METRIC_SQL['crps']}, 5) as crps from bt_cr where fold = {FOLDS - 1} group by 1")
cte("wts", """select sku_id, method, crps, case when s is null then 1.0 / k else coalesce(inv, 0.0) / s end as weight from (
  select *, sum(inv) over (partition by sku_id) as s, count(*) over (partition by sku_id) as k from (select sku_id, method, crps, case when crps > 0 then 1.0 / crps end as inv from bsum))""")
weights = lambda s, sf, x=None: ev.crps_weights(ev.backtest_summary(three(s, sf, x)).select("sku_id", "method", "crps"))
register("crps_weights", lambda s, sf: rounded(weights(s, sf), 5), "select sku_id, method, round(crps, 5) as crps, round(weight, 5) as weight from wts")


def all_forecasts(x):
    tag = lambda f, m: f.withColumn("method", F.lit(m))
    return (tag(fo.forecast_snaive(x, H, "M"), "seasonal_naive").unionByName(tag(fo.forecast_croston(x, H), "croston"))
            .unionByName(tag(fo.forecast_tsb(x, H), "tsb")))


def combined(s, sf):
    x = stored_series(s, sf)
    return ev.combine(all_forecasts(x), weights(s, sf, x))


cte("fc_all", "select *, 'seasonal_naive' as method from fc_sn union all select *, 'croston' from fc_cr union all select *, 'tsb' from fc_ts")
cte("comb", "select f.sku_id, f.step, " + ", ".join(f"greatest(0.0, sum(weight * {c})) as {c}" for c in FC)
    + " from fc_all f join wts w on w.sku_id = f.sku_id and w.method = f.method group by 1, 2")
register("combine", lambda s, sf: rounded(combined(s, sf), 4), f"select sku_id, step, {rq(FC)} from comb")
res = lambda s, sf: ev.residuals(one(s, sf, "croston"))
cte("resid", "select sku_id, fold, step, actual - point as residual from bt_cr")
cte("cwid", """select sku_id, count(*) as n_residuals, quantile_cont(abs(residual), 0.8) as half_80, quantile_cont(abs(residual), 0.95) as half_95 from resid group by 1""")
register("residuals", lambda s, sf: rounded(res(s, sf), 5), "select sku_id, fold, step, round(residual, 5) as residual from resid")
register("conformal_width", lambda s, sf: rounded(ev.conformal_width(res(s, sf)), 5),
         "select sku_id, n_residuals, round(half_80, 5) as half_80, round(half_95, 5) as half_95 from cwid")
register("apply_conformal", lambda s, sf: rounded(ev.apply_conformal(combined(s, sf), ev.conformal_width(res(s, sf))), 4), """
  select c.sku_id, step, round(point, 4) as point, round(greatest(0.0, point - half_95), 4) as q025, round(greatest(0.0, point - half_80), 4) as q10,
    round(q50, 4) as q50, round(greatest(0.0, point + half_80), 4) as q90, round(greatest(0.0, point + half_95), 4) as q975 from comb c join cwid w on w.sku_id = c.sku_id""")
register("conformal_coverage", lambda s, sf: rounded(ev.conformal_coverage(res(s, sf), ev.conformal_width(res(s, sf))), 5), """
  select r.sku_id, round(avg((abs(residual) <= half_80)::integer), 5) as coverage_80, round(avg((abs(residual) <= half_95)::integer), 5) as coverage_95
  from resid r join cwid w on w.sku_id = r.sku_id group by 1""")
register("coverage_by_step", lambda s, sf: rounded(ev.coverage_by_step(res(s, sf)), 5), """
  with h as (select sku_id, step, count(*) as n, quantile_cont(abs(residual), 0.8) as a, quantile_cont(abs(residual), 0.95) as b from resid where step in (1, 4) group by 1, 2),
  e as (select h.sku_id, h.step, any_value(n) as n, any_value(a) as a, any_value(b) as b, avg((abs(residual) <= a)::integer) as ea, avg((abs(residual) <= b)::integer) as eb
    from h join resid r on r.sku_id = h.sku_id and r.step = h.step group by 1, 2)
  select sku_id, step as horizon, n as n_residuals, 0.8::double as nominal, case when a > 0 then round(ea, 5) end as empirical from e where n >= 2
  union all select sku_id, step, n, 0.95, case when b > 0 then round(eb, 5) end from e where n >= 2""")
register("leaderboard", lambda s, sf: rounded(ev.leaderboard(three(s, sf), ("seasonal_naive", "croston", "tsb", "chronos_bolt")), 3), """
  with a as (select s.sku_id, m.method from (select distinct sku_id from bsum) s, (values ('seasonal_naive'), ('croston'), ('tsb'), ('chronos_bolt')) m(method)),
  j as (select a.sku_id, a.method, b.* exclude (sku_id, method) from a left join bsum b on b.sku_id = a.sku_id and b.method = a.method)
  select sku_id, method, n_folds, %s, n_folds is not null as available,
    crps is not null and row_number() over (partition by sku_id order by round(j.crps, 9) asc nulls last, method) = 1 as selected from j"""
    % rq(ev.METRIC_NAMES, 3).replace("round(crps", "round(j.crps"))
cte("acc", "select sku_id, method, " + ", ".join(f"{METRIC_SQL[k]} as {k}" for k in ("mape", "smape", "crps", "pinball_q95")) + " from bt_all group by 1, 2")
register("accuracy_report", lambda s, sf: ev.accuracy_report(three(s, sf)), """
  select coalesce(method, 'overall') as method, count(*) as n, round(avg(mape), 3) as mape, round(avg(smape), 3) as smape, round(avg(crps), 3) as crps,
    round(avg(pinball_q95), 3) as pinball_q95 from acc group by rollup (method)""")

# ---- everything together ----------------------------------------------------------------
register("forecast_all", lambda s, sf: ol.forecast_all(ragged(s, sf), 8, "W")["forecasts"])
register("forecast_all_summary", lambda s, sf: ol.forecast_all(ragged(s, sf), 8, "W")["summary"])
register("forecast_all_with_trees", lambda s, sf: ol.forecast_all(bt(s, sf), 4, "W", ml=True, folds=2)["forecasts"])


def _summary(s, sf):
    out = ol.forecast_all(ragged(s, sf), 8, "W", priors=cal.series_priors(bt(s, sf)))
    path = scratch_path(s, "forecasts")
    files.write_forecasts(out["forecasts"], path)
    return ol.forecast_summary(s.read.parquet(path), out["summary"])


register("forecast_summary", _summary)
register("forecast_totals", lambda s, sf: rounded(ol.forecast_summary(
    fo.forecast_croston(pm(s, sf), H), series(s, sf).select("sku_id", F.lit("croston").alias("method"), F.lit(None).cast("double").alias("mape"),
                                                           F.lit("any").alias("pattern"), F.col("n").alias("n_obs"), F.lit("").alias("caveats")))
    .select("sku_id", "horizon_total_demand"), 4), "select sku_id, round(sum(point), 4) as horizon_total_demand from fc_cr group by 1")

# ---- hierarchy -----------------------------------------------------------------------------
register("build_hierarchy", lambda s, sf: ol.build_hierarchy(bt(s, sf)), """
  select 'TOTAL' as unique_id, date as ds, sum(demand) as y from panel group by 2 union all select category, date, sum(demand) from panel group by 1, 2
  union all select category || '/' || sku_id, date, demand from panel""")


def tree_forecasts(s, sf):
    """Croston forecasts of every level of the monthly panel with their variances."""
    tree = ol.build_hierarchy(pm(s, sf)).select(F.col("unique_id").alias("sku_id"), F.col("ds").alias("date"), F.col("y").alias("demand"))
    x = fo.to_series(tree)
    # read for each of the three levels: a few numbers a node, the history once
    x = materialise(x.select("sku_id", fo.croston_rate(F.col("y")).alias("point"), F.pow(fo.difference_sigma(F.col("y")), F.lit(2.0)).alias("var")))
    x = x.select("sku_id", "point", "var", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("step"))
    sl = F.instr("sku_id", "/")
    return (x.where(sl > 0).select(F.expr("substring(sku_id, instr(sku_id, '/') + 1)").alias("sku_id"),
                                   F.expr("substring(sku_id, 1, instr(sku_id, '/') - 1)").alias("category"), "step", "point", "var"),
            x.where((sl == 0) & (F.col("sku_id") != "TOTAL")).select(F.col("sku_id").alias("category"), "step", "point", "var"),
            x.where(F.col("sku_id") == "TOTAL").select("step", "point", "var"))


cte("tree", """select 'TOTAL' as uid, null as category, date, sum(demand) as demand from panel_pm group by 3 union all
  select category, category, date, sum(demand) from panel_pm group by 1, 2, 3 union all select category || '/' || sku_id, category, date, demand from panel_pm""")
cte("tser", "select *, row_number() over (partition by uid order by date) - 1 as rn, demand - lag(demand) over (partition by uid order by date) as df from tree")
cte("tcro", """with recursive c as (select uid, category, -1::bigint as rn, 0.0::double as z, 0.0::double as p, 1.0::double as q from (select distinct uid, category from tser)
  union all select s.uid, s.category, s.rn, case when s.demand = 0 then c.z when c.p = 0 then s.demand else 0.1 * s.demand + 0.9 * c.z end,
    case when s.demand = 0 then c.p when c.p = 0 then c.q else 0.1 * c.q + 0.9 * c.p end, case when s.demand = 0 then c.q + 1.0 else 1.0 end
  from c join tser s on s.uid = c.uid and s.rn = c.rn + 1) select * from c""")
cte("tfc", """select t.uid, t.category, case when p > 0 then z / p else 0.0 end as point, (case when sd > 1e-9 then sd else 1.0 end) ** 2 as var
  from tcro t join (select uid, max(rn) as m, stddev_pop(df) as sd from tser group by 1) x on x.uid = t.uid and x.m = t.rn""")
cte("rec_c", """select b.category, sum_b, var_b, c.point as c_hat, c.var as c_var, (sum_b / var_b + c.point / c.var) / (1 / var_b + 1 / c.var) as c_mid, 1 / (1 / var_b + 1 / c.var) as c_mid_var
  from (select category, sum(point) as sum_b, sum(var) as var_b from tfc where contains(uid, '/') group by 1) b join tfc c on c.uid = b.category""")
cte("rec_t", """select sum_c, var_c, all_b, t.point as t_hat, (sum_c / var_c + t.point / t.var) / (1 / var_c + 1 / t.var) as t_wls
  from (select sum(c_mid) as sum_c, sum(c_mid_var) as var_c, sum(sum_b) as all_b from rec_c), (select * from tfc where uid = 'TOTAL') t""")
cte("rec_w", """select c.*, t_wls, c_mid + (t_wls - sum_c) * c_mid_var / var_c as c_rec from rec_c c, rec_t""")
_two = "(select unnest([1, 2]) as step)"
for method, t, c, b in (
        ("wls", "t_wls", "c_rec", "f.point + (c_rec - sum_b) * f.var / var_b"),
        ("top_down", "t_hat", "t_hat * sum_b / all_b", "t_hat * sum_b / all_b * f.point / sum_b"),
        ("bottom_up", "all_b", "sum_b", "f.point")):
    register(f"reconcile_{method}", (lambda m: lambda s, sf: rounded(ol.reconcile(*tree_forecasts(s, sf), m), 4))(method), f"""
      select 'TOTAL' as unique_id, cast(step as integer) as step, round({t}, 4) as reconciled from rec_t, {_two}
      union all select category, step, round({c}, 4) from rec_w, (select sum_c as sc, all_b, t_hat from rec_t), {_two}
      union all select f.uid, step, round({b}, 4) from tfc f join rec_w on rec_w.category = f.category, (select all_b, t_hat from rec_t), {_two} where contains(f.uid, '/')""")
register("reconcile_panel", lambda s, sf: ol.reconcile_panel(bt(s, sf), 4, "W"))

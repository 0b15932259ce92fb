from pyspark.sql import functions as F

from ..functions.stats import r
from ..operators import adhoc as q, ops, purchasing as pu, skus as k
from ..session import scratch_path
from ..sources import derived as d, files
from ..streaming import jobs
from .inventory_queries import sup
from .oracle import cte
from .registry import register
from .series_queries import bt, rounded
from .suppliers_queries import cards

AS_OF = "2001-12-31"
po, lines, log = d.purchase_orders, d.po_lines, d.po_status_log


def draft_lines(s, sf):
    """Draft lines from orders: some SKUs misspelt, some drafts wholly unknown."""
    k_ = F.col("l_orderkey")
    part = d.table(s, sf, "part").select("p_partkey", d._brand_type().alias("sku"))
    j = d.table(s, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    bad = (k_ % 19 == 0) | ((k_ % 3 == 0) & (F.col("l_linenumber") == 1))
    return j.groupBy(F.concat(F.lit("D"), F.lpad(k_.cast("string"), 9, "0")).alias("draft_id"), "l_linenumber", F.when(bad, F.concat("sku", F.lit("-X"))).otherwise(F.lower("sku")).alias("sku_id")).agg(
        F.sum("l_quantity").alias("qty")).withColumn("line_no", F.concat("l_linenumber", F.lit("/"), "sku_id")).drop("l_linenumber")


cte("dl", """select 'D' || lpad(cast(l_orderkey as varchar), 9, '0') as draft_id, l_linenumber || '/' || case when bad then sku || '-X' else lower(sku) end as line_no,
    upper(case when bad then sku || '-X' else sku end) as sku_id, sum(l_quantity) as qty from (
  select l_orderkey, l_linenumber, l_quantity, upper(p_brand || '|' || p_type) as sku, (l_orderkey % 19 = 0 or (l_orderkey % 3 = 0 and l_linenumber = 1)) as bad
  from lineitem join part on l_partkey = p_partkey) group by 1, 2, 3""")
cte("drafted", f"""select h.*, supplier_id from (select draft_id, sum(qty) filter (known) as total_units, sum(qty * coalesce(uc, 0.0)) filter (known) as total_cost,
    arg_min(sup, line_no) filter (known) as sup, arg_min(lt, line_no) filter (known) as lt, string_agg(distinct case when not known then sku_id end, ', ' order by case when not known then sku_id end) as skipped
  from (select dl.*, s.sku_id is not null as known, last_unit_cost as uc, last_supplier as sup, known_lead_time_days as lt from dl left join state s on s.sku_id = dl.sku_id) group by 1) h
  left join suppliers s on s.name = h.sup""")
register("draft_pos", lambda s, sf: rounded(pu.draft_pos(draft_lines(s, sf), bt(s, sf), sup(s, sf), AS_OF)[0], 6), f"""
  select draft_id, supplier_id, 'drafted' as status, date '{AS_OF}' + cast(floor(coalesce(lt, 14.0)) as integer) + 7 as needed_by, round(total_cost, 6) as total_cost,
    total_units, case when skipped is not null then 'skipped invalid SKUs: ' || skipped end as notes from drafted where total_units is not null""")
register("draft_po_lines", lambda s, sf: pu.draft_pos(draft_lines(s, sf), bt(s, sf), sup(s, sf), AS_OF)[1].drop("unit_cost"),
         "select draft_id, dl.sku_id, qty from dl join state s on s.sku_id = dl.sku_id")
register("number_pos", lambda s, sf: pu.number_pos(po(s, sf).select("po_id").withColumnRenamed("po_id", "draft_id"), 2026, 41), """
  select po_id as draft_id, 'PO-2026-' || lpad(cast(row_number() over (order by po_id) + 41 as varchar), 5, '0') as po_id from purchase_orders""")
register("po_state", lambda s, sf: pu.po_state(log(s, sf)),
         'select po_id, arg_max(to_status, ("at", to_status)) as status, max("at") as since, count(*) as n_events from po_status_log group by 1')
_pairs = ", ".join(f"'{x}'" for x in pu.ALLOWED_PAIRS)
cte("badtr", f"""select po_id, previous, to_status, "at" from (select *, lag(to_status) over (partition by po_id order by "at", to_status) as previous from po_status_log)
  where case when previous is null then to_status <> 'drafted' else previous || '>' || to_status not in ({_pairs}) end""")
register("invalid_transitions", lambda s, sf: pu.invalid_transitions(log(s, sf)), "select * from badtr")


def updates(s, sf):
    key = F.col("o_orderkey")
    return d.table(s, sf, "orders").where(key % 5 == 0).select(
        d._po_id().alias("po_id"), F.when(key % 2 == 0, "ana").alias("assigned_to"), F.when(key % 3 == 0, "").otherwise("bo").alias("approved_by"),
        F.lit("rush").alias("notes"))


register("apply_updates", lambda s, sf: pu.apply_updates(po(s, sf), updates(s, sf)).select("po_id", "assigned_to", "approved_by", "notes"), """
  select 'PO-1995-' || lpad(cast(o_orderkey as varchar), 9, '0') as po_id, case when o_orderkey % 10 = 0 then 'ana' end as assigned_to,
    case when o_orderkey % 5 = 0 and o_orderkey % 3 <> 0 then 'bo' end as approved_by, case when o_orderkey % 5 = 0 then 'rush' end as notes from orders""")
register("list_pos", lambda s, sf: pu.list_pos(po(s, sf), lines(s, sf), log(s, sf), sup(s, sf), "placed").select(
    "po_id", "supplier_name", "created_at", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
    F.array_join(F.transform("status_log", lambda x: x["to_status"]), ">").alias("path")), """
  select p.po_id, s.name as supplier_name, created_at, case when l.n is null then -1 else l.n end as n_lines, g.path from purchase_orders p left join suppliers s on s.supplier_id = p.supplier_id
    left join (select po_id, count(*) as n from po_lines group by 1) l on l.po_id = p.po_id
    left join (select po_id, string_agg(to_status, '>' order by "at") as path from po_status_log group by 1) g on g.po_id = p.po_id where p.status = 'placed'""".replace(
        "case when l.n is null then -1 else l.n end", "coalesce(l.n, 0)"))


def cancelled(s, sf):
    return po(s, sf).where(F.col("status") == "cancelled").select("po_id")


register("delete_pos", lambda s, sf: pu.delete_pos(cancelled(s, sf), lines(s, sf))[0],
         "select * from po_lines where po_id not in (select po_id from purchase_orders where status = 'cancelled')")
register("accept_plan", lambda s, sf: rounded(pu.accept_plan(draft_lines(s, sf), bt(s, sf), sup(s, sf), AS_OF), 6), """
  select draft_id, case when total_units is null then 'failed' else 'created' end as outcome, case when total_units is null then 'no valid SKUs in line list' end as error,
    supplier_id, round(total_cost, 6) as total_cost from drafted""")
cte("porows", """select l.po_id, p.supplier_id, coalesce(s.name, '') as supplier_name, needed_by, sku_id, qty, coalesce(unit_cost, 0.0) as unit_cost,
  round(coalesce(unit_cost, 0.0) * qty, 2) as line_total, case when expedite_flag then 'Y' else 'N' end as expedite, status
  from po_lines l join purchase_orders p on p.po_id = l.po_id left join suppliers s on s.supplier_id = p.supplier_id""")
register("export_po_lines", lambda s, sf: rounded(pu.export_rows(po(s, sf), lines(s, sf), sup(s, sf)), 2), "select * from porows")
cte("edi", """select p.po_id, array_to_string(list_concat(list_filter([
    'ISA*00*          *00*          *ZZ*BUYER          *ZZ*VENDOR         *011231*0000*U*00401*' || c || '*0*P*>', 'GS*PO*BUYER*VENDOR*20011231*0000*1*X*004010', 'ST*850*0001',
    'BEG*00*SA*' || p.po_id || '**20011231', 'REF*EM*' || contact_email, 'DTM*002*' || strftime(needed_by, '%Y%m%d'), 'N1*VN*' || s.name, 'N4***' || country], lambda x: x is not null),
    coalesce(items, []), ['CTT*' || coalesce(len(items), 0), 'SE*' || (8 + coalesce(len(items), 0) + 2) || '*0001', 'GE*1*1', 'IEA*1*' || c]), '~' || chr(10)) || '~' || chr(10) as body
  from (select *, right(replace(po_id, '-', ''), 9) as c from purchase_orders) p left join suppliers s on s.supplier_id = p.supplier_id
  left join (select po_id, list('PO1*' || i || '*' || cast(qty as bigint) || '*EA*' || printf('%.2f', coalesce(unit_cost, 0.0)) || '**VP*' || sku_id order by i) as items
    from (select *, row_number() over (partition by po_id order by sku_id) as i from po_lines) group by 1) l on l.po_id = p.po_id""")
register("export_edi850", lambda s, sf: pu.export_edi850(po(s, sf), lines(s, sf), sup(s, sf), AS_OF), "select * from edi")


def _po_csv(s, sf):
    path = scratch_path(s, "po-lines")
    files.write_csv(pu.export_rows(po(s, sf), lines(s, sf), sup(s, sf)), path, partition_by=("status",))
    return s.read.csv(path, header=True).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


register("export_po_csv", _po_csv, "select status, count(*) as n from porows group by 1")

# ---- ad hoc ----------------------------------------------------------------------------
QSPEC = {"filter": [{"col": "category", "op": "!=", "value": "SMALL"}, {"col": "demand", "op": ">", "value": 0}, {"col": "sku_id", "op": "contains", "value": "brand#1"}],
         "groupby": ["supplier"], "aggregate": {"demand": "sum", "sku_id": "nunique", "on_hand": "median", "lead_time_days": "std"}, "sort_by": "demand", "limit": 5}
register("query_grouped", lambda s, sf: rounded(q.query(bt(s, sf), QSPEC), 4), """
  with g as (select supplier, sum(demand) as demand, count(distinct sku_id) as sku_id, round(median(on_hand), 4) as on_hand, round(stddev_samp(lead_time_days), 4) as lead_time_days
    from panel where category <> 'SMALL' and demand > 0 and contains(lower(sku_id), 'brand#1') group by 1)
  select *, (select count(*) from g) > 5 as truncated from g order by demand desc limit 5""")
register("query_filter", lambda s, sf: q.query(bt(s, sf).select("sku_id", "date", "demand", "on_hand", "category"), {
    "filter": [{"col": "on_hand", "op": "not_null"}, {"col": "category", "op": "not in", "value": ["PROMO", "SMALL"]}], "sort_by": "on_hand", "limit": 20}), """
  select sku_id, date, demand, on_hand, category, true as truncated from panel where on_hand is not null and category not in ('PROMO','SMALL') order by on_hand desc, sku_id limit 20""")
register("query_whole", lambda s, sf: rounded(q.query(bt(s, sf), {"aggregate": {"demand": "mean", "on_hand": "count", "unit_price": "last", "date": "first"}}), 3), """
  select round(avg(demand), 3) as demand, count(on_hand) as on_hand, round(arg_max(unit_price, (date, sku_id, unit_price)) filter (unit_price is not null), 3) as unit_price, min(date) as date, false as truncated from panel""")


def tables(s, sf):
    return {"panel": bt(s, sf), "suppliers": q.suppliers_view(sup(s, sf), cards(s, sf)), "skus": k.skus_view(bt(s, sf), "W")}


register("safe_sql", lambda s, sf: q.safe_sql(s, "SELECT category, abc_class, count(*) AS n FROM skus GROUP BY category, abc_class;", tables(s, sf)),
         "select category, abc_class, count(*) as n, false as truncated from skut group by 1, 2")
register("suppliers_view", lambda s, sf: rounded(tables(s, sf)["suppliers"]), """
  select s.supplier_id, s.name as supplier_name, case when s.payment_terms = 'Net 45' then 45 when s.payment_terms = '2/10 Net 60' then 60 when s.payment_terms = '15 days' then 15 else 30 end as payment_terms_days,
    round(on_time_pct / 100, 6) as on_time_rate, round(lead_time_std_days / avg_lead_time_days, 6) as lead_time_cv from cards s""")

# ---- operations ----------------------------------------------------------------------------
ev = d.op_events
register("latency_summary", lambda s, sf: rounded(ops.latency_summary(ev(s, sf)), 4), """
  select operation, any_value(n) as n, max(value) filter (i = n // 2) as p50, max(value) filter (i = floor(n * 0.95)) as p95, round(avg(value), 4) as mean from (
    select operation, value, row_number() over (partition by operation order by value) - 1 as i, count(*) over (partition by operation) as n from op_events) group by 1""")
register("recent_events", lambda s, sf: ops.recent_events(ev(s, sf)), "select * from op_events order by ts desc, event_id desc limit 100")
register("spend_ledger", lambda s, sf: rounded(ops.spend_ledger(ev(s, sf), 2000.0), 2), """
  select event_id, day, operation, value, round(before, 2) as spent_before, round(before, 6) >= 2000.0 as refused from (
    select event_id, cast(ts as date) as day, operation, round(value, 2) as value, coalesce(sum(value) over (partition by cast(ts as date) order by ts, event_id rows between unbounded preceding and 1 preceding), 0.0) as before
    from op_events where value > 0)""")
register("spend_by_context", lambda s, sf: rounded(ops.spend_by_context(ev(s, sf)), 2), """
  select cast(ts as date) as day, operation, round(sum(value), 2) as usd, count(*) as n from op_events where value > 0 group by rollup (1, 2) having cast(ts as date) is not null""".replace(
    "group by rollup (1, 2) having cast(ts as date) is not null", "group by grouping sets ((cast(ts as date), operation), (cast(ts as date)))"))


# ---- streams ---------------------------------------------------------------------------------
BATCH_ROWS = 100_000  # least rows of a file where a micro-batch has several


def _as_stream(s, df, name, part):
    """Writes a table as files of three parts, one after the other, and opens them as a stream of three micro-batches.

    Every part has as many files, so that a trigger takes one part whole: by the rows of the smallest one, that no file stays empty."""
    path, whole = scratch_path(s, name), scratch_path(s, f"{name}-rows")
    df.withColumn("_part", part).where(F.col("_part").isin(0, 1, 2)).write.parquet(whole)
    rows = s.read.parquet(whole)
    sizes = [n for _, n in rows.groupBy("_part").count().collect()]
    files = max(1, min(sizes) // BATCH_ROWS) if len(sizes) == 3 else 1
    for k in range(3):
        own = rows.where(F.col("_part") == k).drop("_part")
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _thirds(df, at):
    """Number of the third of the table's time span that a row falls in."""
    sec = at.cast("timestamp").cast("double")
    lo, hi = (df.agg(f(sec)).scalar() for f in (F.min, F.max))
    return F.least(F.lit(2), F.floor((sec - lo) * 3 / (hi - lo)).cast("int"))


def _drain(s, stream, name, keys):
    out = scratch_path(s, name)
    jobs.run_keyed(stream, out, scratch_path(s, f"{name}-progress"))
    return jobs.merged(s, out, keys)


def _demand_stream(s, sf):
    src = d.order_lines(s, sf)
    return _drain(s, jobs.stream_demand(_as_stream(s, src, "lines", _thirds(src, F.to_date(F.substring("Created at", 1, 10))))), "demand", ["sku_id", "date"])


register("stream_demand", _demand_stream, "select sku_id, date, demand, unit_price from order_panel")


def _latency_stream(s, sf):
    return rounded(_drain(s, jobs.stream_latency(_as_stream(s, ev(s, sf), "events", _thirds(ev(s, sf), F.col("ts")))), "latency", ["window_start", "operation"]), 2)


register("stream_latency", _latency_stream, """
  with w as (select operation, value, unnest([time_bucket(interval '15 minutes', ts) - i * interval '15 minutes' for i in range(0, 4)]) as window_start from op_events)
  select window_start, operation, count(*) as n, round(sum(value), 2) as total from w group by 1, 2""")


def _state_stream(s, sf):
    # events of an order are dealt over the batches in no order of time, so the watermark spans the log
    part = F.pmod(F.xxhash64("po_id", "to_status"), F.lit(3)).cast("int")
    return _drain(s, jobs.stream_po_state(_as_stream(s, log(s, sf), "log", part), "5000 days"), "po-state", ["po_id"])


register("stream_po_state", _state_stream, """
  select l.po_id, arg_max(l.to_status, (l."at", l.to_status)) as status, max(l."at") as since, count(*) as n_events, count(b.po_id) as n_invalid from po_status_log l
  left join badtr b on b.po_id = l.po_id and b."at" = l."at" and b.to_status = l.to_status group by 1""")

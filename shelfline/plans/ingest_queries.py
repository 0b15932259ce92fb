from pyspark.sql import functions as F

from ..functions.stats import r
from ..operators import checks as c, profile as p
from ..session import scratch_path
from ..sources import derived as d, exports as x, files
from .oracle import cte
from .registry import register

PANEL = "sku_id, date, demand, on_hand, lead_time_days, unit_cost, unit_price, supplier, category"


# ---- inputs: a raw panel file with faults, a header catalogue, wide sales -----
def raw_panel(s, sf):
    """One raw text row per order line under foreign headers, faults included."""
    part = d.table(s, sf, "part").select("p_partkey", d._brand_type().alias("sku"), "p_type", "p_retailprice")
    k = F.col("l_orderkey")
    return (d.table(s, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.when(k % 97 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower("sku"), F.lit(" "))).alias("Item ID"),
        F.when(k % 101 == 0, F.lit("not-a-date")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Day"),
        F.when(k % 103 == 0, F.lit("n/a")).when(k % 53 == 0, F.lit("-5"))
        .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("Units Sold"),
        F.when(k % 7 == 0, F.lit("None")).otherwise(F.col("p_type")).alias("Department"),
        F.when(k % 5 == 0, F.lit("?")).otherwise(F.col("l_linenumber").cast("string")).alias("LT (days)"),
        F.lit("x").alias("Comment")))


RAW_MAP = {"sku_id": "Item ID", "date": "Day", "demand": "Units Sold", "category": "Department",
           "lead_time_days": "LT (days)"}

cte("raw_panel", """
  select case when l_orderkey % 97 = 0 then '  ' else ' ' || lower(p_brand || '|' || p_type) || ' ' end as item_id,
    case when l_orderkey % 101 = 0 then 'not-a-date' else strftime(l_shipdate, '%Y-%m-%d') end as day_,
    case when l_orderkey % 103 = 0 then 'n/a' when l_orderkey % 53 = 0 then '-5'
         else cast(cast(l_quantity as integer) as varchar) end as units,
    case when l_orderkey % 7 = 0 then 'None' else p_type end as dept,
    case when l_orderkey % 5 = 0 then '?' else cast(l_linenumber as varchar) end as lt
  from lineitem join part on l_partkey = p_partkey""")
cte("norm_panel", """
  select upper(trim(item_id)) as sku_id, try_cast(day_ as date) as date, try_cast(units as double) as demand,
    case when trim(dept) not in ('nan','NaN','None','') then trim(dept) end as category,
    try_cast(lt as double) as lead_time_days from raw_panel""")


def norm_panel(s, sf):
    return p.normalize_panel(raw_panel(s, sf), RAW_MAP)


def header_catalogue(s, sf):
    """Words of each document as the headers of one file each."""
    words = d.table(s, sf, "documents").select(
        F.col("doc_id").cast("string").alias("file_id"),
        F.explode(F.array_distinct(F.split("text", r"[\x20\x09-\x0D]+"))).alias("header"))
    return words.where(F.col("header") != "").withColumn("dtype", F.lit("string"))


cte("headers", r"""
  select distinct cast(doc_id as varchar) as file_id, w as header, regexp_replace(lower(w), '[^a-z0-9]', '', 'g') as clean from (
    select doc_id, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) as w from documents) where w <> ''""")
_syn = ", ".join(f"('{cn}', '{sy}')" for cn, names in p.SYNONYMS.items() for sy in names)
cte("synonyms", f"select * from (values {_syn}) t(canonical, syn)")
cte("header_scores", """
  select h.file_id, h.header, b.canonical,
    round(least(1.0, b.base + case when b.canonical in ('sku_id','supplier','category') then 0.05 else 0.0 end), 6) as score
  from headers h join (
    select header, canonical, max(case when c = '' then 0.0 when c = syn then 1.0
        when starts_with(c, syn) or starts_with(syn, c) then greatest(0.85, sim)
        when contains(c, syn) or contains(syn, c) then greatest(0.7, sim) else sim end) as base
    from (select header, canonical, c, syn, 1.0 - levenshtein(c, syn)::double / greatest(length(c), length(syn)) as sim
          from (select distinct header, clean as c from headers), synonyms) group by 1, 2) b on b.header = h.header""")


def wide_sales(s, sf):
    """Weekday totals per SKU as d_1 ... d_7, with a calendar over seven dates."""
    part = d.table(s, sf, "part").select("p_partkey", d._brand_type().alias("id"), F.col("p_type").alias("dept_id"))
    li = d.table(s, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    day = F.weekday("l_shipdate") + 1
    return li.groupBy("id", "dept_id").agg(*[
        F.sum(F.when(day == i, F.col("l_quantity")).otherwise(0.0)).alias(f"d_{i}") for i in range(1, 8)])


def week_calendar(s):
    return s.range(1, 8).select(F.concat(F.lit("d_"), F.col("id").cast("string")).alias("d"),
                                F.date_add(F.lit("2016-01-03").cast("date"), F.col("id").cast("int")).alias("date"))


# ---- sources and sinks -----------------------------------------------------
def _csv_round_trip(s, sf):
    path = scratch_path(s, "csv")
    raw_panel(s, sf).write.csv(path, sep=";", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    out = files.read_delimited(s, path)
    return out.groupBy("Department").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.sum(F.col("Units Sold").try_cast("double")).alias("units"),
                                         F.count_if(F.trim("Item ID") == "").alias("blank")
                                         ).withColumnRenamed("Department", "dept")


register("read_delimited", _csv_round_trip, """
  select dept, count(*) as n_rows, sum(try_cast(units as double)) as units,
    count(*) filter (trim(item_id) = '') as blank from raw_panel group by 1""")


def _stored_panel(s, sf):
    path = scratch_path(s, "dataset")
    files.write_panel(d.panel_bt(s, sf), path)
    return files.load_dataset(s, path, ("panel",))["panel"]


register("write_and_load_panel", _stored_panel, f"select {PANEL} from panel")


STORED = {"panel": (d.panel_bt, "sku_id"), "suppliers": (d.suppliers, "supplier_id"), "receipts": (d.receipts, "receipt_id"),
          "purchase_orders": (d.purchase_orders, "po_id"), "po_lines": (d.po_lines, "po_id"), "po_status_log": (d.po_status_log, "po_id")}
MEASURES = {"panel": "demand", "suppliers": "moq", "receipts": "received_qty", "purchase_orders": "total_units", "po_lines": "qty", "po_status_log": None}


def _stored_tables(s, sf):
    """Writes all six tables to their schemas, loads them by name and counts rows, keys and a measure back."""
    path = scratch_path(s, "dataset")
    for n, (make, _) in STORED.items():
        files.write_table(make(s, sf), n, path)
    out = None
    for n, t in files.load_dataset(s, path).items():
        total = F.sum(MEASURES[n]) if MEASURES[n] else F.lit(None).cast("double")
        one = t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(STORED[n][1]).alias("n_keys"), F.round(total, 2).alias("total"))
        one = one.withColumn("name", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


register("load_stored_tables", _stored_tables, " union all ".join(
    f"select '{n}' as name, count(*) as n_rows, count(distinct {key}) as n_keys, "
    + (f"round(sum({MEASURES[n]}::double), 2)" if MEASURES[n] else "null::double") + f" as total from {n}" for n, (_, key) in STORED.items()))

cte("order_panel", """
  with o as (select trim(sku_raw) as sku_id, try_cast(qty_raw as double) as qty, try_cast(price_raw as double) as price, name_raw,
      (local_day + interval 14 hour + interval 23 minute + case when l_orderkey % 2 = 0 then interval 7 hour else interval 10 hour end) as ts
    from order_lines where trim(sku_raw) <> '' and try_cast(qty_raw as double) > 0
      and lower(trim(status_raw)) not in ('voided','refunded','cancelled','canceled'))
  select o.sku_id, cast(ts as date) as date, sum(qty) as demand,
    round(sum(coalesce(price, 0.0) * qty) / sum(qty), 4) as unit_price, 'shopify' as supplier, any_value(f.category) as category
  from o join (select sku_id, arg_min(name_raw, (ts, name_raw)) as category from o group by 1) f on f.sku_id = o.sku_id group by 1, 2""")


def _order_panel(s, sf):
    lines = d.order_lines(s, sf)
    if not x.is_order_export(lines):
        raise ValueError("not an order export")
    return x.orders_to_panel(lines)


register("orders_to_panel", _order_panel,
         "select sku_id, date, demand, unit_price, supplier, category from order_panel")
register("order_export_detect", lambda s, sf: d.order_lines(s, sf).agg(F.count(F.lit(1)).alias("n_lines"))
         .withColumn("is_order_export", F.lit(x.is_order_export(d.order_lines(s, sf)))),
         "select count(*) as n_lines, true as is_order_export from order_lines")


# headers each vendor's export gives to (item, date, quantity, category, value), and the field the value becomes
VENDOR_EXPORTS = {
    "sap": (("Material", "Pstng Date", "Quantity", "Material Group", "Moving Avg Price"), "dd.MM.yyyy", "unit_cost"),
    "netsuite": (("Item", "Tran Date", "Quantity", "Class", "Item Rate"), "yyyy-MM-dd", "unit_price"),
    "quickbooks": (("Product/Service", "Date", "Quantity", "Category", "Cost"), "yyyy-MM-dd", "unit_cost"),
    "square": (("SKU", "Date", "Items Sold", "Category", "Price"), "yyyy-MM-dd", "unit_price"),
}


def _preset(vendor):
    headers, fmt, _ = VENDOR_EXPORTS[vendor]

    def run(s, sf):
        li, part = d.table(s, sf, "lineitem"), d.table(s, sf, "part")
        cols = (d._brand_type(), F.date_format("l_shipdate", fmt), F.col("l_quantity"), F.col("p_type"), F.col("p_retailprice"))
        export = li.join(part, li.l_partkey == part.p_partkey).select(*[c.alias(h) for c, h in zip(cols, headers)], F.lit("261").alias("Movement"))
        return x.apply_preset(export, vendor)

    return run


for _vendor, (_, _, _value) in VENDOR_EXPORTS.items():
    register("vendor_preset" if _vendor == "sap" else f"vendor_preset_{_vendor}", _preset(_vendor), f"""
  select upper(p_brand || '|' || p_type) as sku_id, cast(l_shipdate as date) as date, l_quantity as demand,
    p_retailprice as {_value}, p_type as category from lineitem join part on l_partkey = p_partkey""")
register("melt_sales", lambda s, sf: x.melt_sales(wide_sales(s, sf), week_calendar(s)), """
  with w as (select upper(p_brand || '|' || p_type) as id, p_type as dept_id, isodow(l_shipdate) as k, sum(l_quantity) as sales
    from lineitem join part on l_partkey = p_partkey group by 1, 2, 3)
  select i.id, i.dept_id, date '2016-01-03' + cast(n.k as integer) as date, coalesce(w.sales, 0.0) as sales
  from (select distinct id, dept_id from w) i, (select unnest(range(1, 8)) as k) n
  left join w on w.id = i.id and w.k = n.k""")
register("sample_skus", lambda s, sf: x.sample_skus(d.panel_bt(s, sf), 20, seed=0).select("sku_id", "date", "demand"),
         "select sku_id, date, demand from panel where sku_id in (select sku_id from (select distinct sku_id from panel) order by md5(sku_id || ':0'), sku_id limit 20)")
register("first_skus", lambda s, sf: x.first_skus(d.panel_bt(s, sf), 25).select("sku_id", "date", "demand"),
         "select sku_id, date, demand from panel where sku_id in (select distinct sku_id from panel order by 1 limit 25)")

# ---- profiling and mapping ---------------------------------------------------
register("profile_columns", lambda s, sf: p.profile_columns(raw_panel(s, sf)).select(
    F.col("column").alias("col"), "n_rows", "null_pct", "unique_pct",
    F.array_join("sample_values", "~").alias("sample_values")), """
  with tall as (
    select 'Item ID' as col, item_id as v from raw_panel union all select 'Day', day_ from raw_panel
    union all select 'Units Sold', units from raw_panel union all select 'Department', dept from raw_panel
    union all select 'LT (days)', lt from raw_panel union all select 'Comment', 'x' from raw_panel),
  s as (select col, string_agg(v, '~' order by v) as sample_values from (
    select col, v, row_number() over (partition by col order by v) as rn from (select distinct col, v from tall where v is not null))
    where rn <= 5 group by 1)
  select t.col, count(*) as n_rows, round(count(*) filter (v is null)::double / count(*), 4) as null_pct,
    round(count(distinct v)::double / count(*), 4) as unique_pct, any_value(s.sample_values) as sample_values
  from tall t left join s on s.col = t.col group by 1""")
register("label_dtype", lambda s, sf: p.label_dtype(raw_panel(s, sf)).withColumnRenamed("column", "col"), """
  with tall as (
    select 'Item ID' as col, item_id as v from raw_panel
    union all select 'Day', day_ from raw_panel
    union all select 'Units Sold', units from raw_panel
    union all select 'Department', dept from raw_panel
    union all select 'LT (days)', lt from raw_panel
    union all select 'Comment', 'x' from raw_panel),
  f as (select col, v, row_number() over (partition by col order by v) as rn from (select distinct col, v from tall))
  select col, case when bool_and(regexp_matches(v, '^\\d{4}-\\d{1,2}-\\d{1,2}') and try_cast(v as timestamp) is not null) then 'date'
    when bool_and(try_cast(v as double) is not null) and bool_or(contains(v, '.')) then 'float'
    when bool_and(try_cast(v as double) is not null) then 'integer' else 'string' end as dtype
  from f group by 1""")
register("score_headers", lambda s, sf: p.score_headers(header_catalogue(s, sf)).groupBy("header", "canonical")
         .agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_files")),
         "select header, canonical, max(score) as score, count(*) as n_files from header_scores group by 1, 2")
register("suggest_mapping", lambda s, sf: p.suggest_mapping(p.score_headers(header_catalogue(s, sf), best=p.BEST)))
register("apply_mapping", lambda s, sf: p.apply_mapping(raw_panel(s, sf), RAW_MAP),
         "select item_id as sku_id, day_ as date, units as demand, dept as category, lt as lead_time_days from raw_panel")
register("normalize_panel", norm_panel, "select sku_id, date, demand, category, lead_time_days from norm_panel")
register("infer_frequency", lambda s, sf: p.infer_frequency(d.panel_bt(s, sf)), """
  with dts as (select distinct date from panel), g as (select date, date - lag(date) over (order by date) as gap from dts)
  select count(*) as n_dates, quantile_cont(gap::double, 0.5) as median_gap, case when count(*) >= 3 then
    case when quantile_cont(gap::double, 0.5) between 0.5 and 1.5 then 'D' when quantile_cont(gap::double, 0.5) between 6 and 8 then 'W'
    when quantile_cont(gap::double, 0.5) between 28 and 32 then 'M' end end as frequency from g""")
register("infer_frequency_by_sku", lambda s, sf: p.infer_frequency(d.cells(s, sf, "part"), "sku_id"), """
  with g as (select sku_id, date - lag(date) over (partition by sku_id order by date) as gap from cells_pw)
  select sku_id, count(*) as n_dates, quantile_cont(gap::double, 0.5) as median_gap, case when count(*) >= 3 then
    case when quantile_cont(gap::double, 0.5) between 0.5 and 1.5 then 'D' when quantile_cont(gap::double, 0.5) between 6 and 8 then 'W'
    when quantile_cont(gap::double, 0.5) between 28 and 32 then 'M' end end as frequency from g group by 1""")
register("dataset_summary", lambda s, sf: p.dataset_summary(d.panel_bt(s, sf)), """
  select count(*) as n_rows, count(distinct sku_id) as n_skus, min(date) as date_min, max(date) as date_max,
    count(distinct category) as n_categories, count(distinct supplier) as n_suppliers,
    bool_or(on_hand is not null) as has_on_hand, bool_or(lead_time_days is not null) as has_lead_time_days,
    bool_or(unit_cost is not null) as has_unit_cost, bool_or(unit_price is not null) as has_unit_price from panel""")
register("top_dims", lambda s, sf: p.top_dims(d.panel_bt(s, sf)), """
  with c as (select 'category' as dim, category as value, count(distinct sku_id) as n_skus from panel group by 2
    union all select 'supplier', supplier, count(distinct sku_id) from panel group by 2)
  select dim, value, n_skus, pos from (select *, row_number() over (partition by dim order by n_skus desc, value) as pos
    from c where value is not null) where pos <= 5""")
register("preview", lambda s, sf: p.preview(d.panel_bt(s, sf)), f"""
  select {PANEL.replace('date,', "strftime(date, '%Y-%m-%d') as date,")} from panel order by sku_id, panel.date limit 20""")

# ---- hard checks ------------------------------------------------------------
mapped = lambda s, sf: p.apply_mapping(raw_panel(s, sf), RAW_MAP)
register("check_mapping", lambda s, sf: c.check_mapping(p.suggest_mapping(p.score_headers(header_catalogue(s, sf), best=p.BEST))))
hard = "select '{0}' as code, 'hard' as severity, {1} as field, count(*) as offending_row_count, null::bigint as skus_affected from raw_panel where {2} having count(*) > 0"
register("check_sku", lambda s, sf: c.check_sku(mapped(s, sf)),
         hard.format("SKU_ID_NULL_OR_BLANK", "'sku_id'", "item_id is null or trim(item_id) = ''"))
register("check_date", lambda s, sf: c.check_date(mapped(s, sf)),
         hard.format("DATE_PARSE_FAILED", "'date'", "try_cast(day_ as date) is null"))
register("check_demand", lambda s, sf: c.check_demand(mapped(s, sf)),
         hard.format("DEMAND_NOT_NUMERIC", "'demand'", "try_cast(units as double) is null"))
DUP = """select 'SKU_DATE_DUPLICATES' as code, 'hard' as severity, null::varchar as field,
  sum(n)::bigint as offending_row_count, null::bigint as skus_affected from (
    select sku_id, date, count(*) as n from norm_panel where sku_id <> '' and date is not null group by 1, 2) where n > 1"""
register("check_duplicates", lambda s, sf: c.check_duplicates(mapped(s, sf)), DUP)
register("schema_checks", lambda s, sf: c.schema_checks(mapped(s, sf)), " union all ".join([
    hard.format("SKU_ID_NULL_OR_BLANK", "'sku_id'", "item_id is null or trim(item_id) = ''"),
    hard.format("DATE_PARSE_FAILED", "'date'", "try_cast(day_ as date) is null"),
    hard.format("DEMAND_NOT_NUMERIC", "'demand'", "try_cast(units as double) is null")]))
register("check_with_examples", lambda s, sf: c.with_examples(
    c.check_demand(mapped(s, sf)), mapped(s, sf), c.demand_bad()))

# ---- soft checks ------------------------------------------------------------
# order-line days: gaps, negatives and odd lead times appear here
def loose_panel(s, sf):
    """Sparse daily panel with returns, odd lead times, a spike week and stale stock."""
    part = d.table(s, sf, "part").select("p_partkey", d._brand_type().alias("sku_id"), "p_retailprice", "p_type")
    k = F.col("k")
    agg = (d.table(s, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
           .groupBy("sku_id", F.to_date("l_shipdate").alias("date"))
           .agg(F.sum("l_quantity").alias("q"), F.min("l_orderkey").alias("k"),
                F.max("p_retailprice").alias("rp"), F.min("p_type").alias("category")))
    return agg.select(
        "sku_id", "date",
        F.when(k % 211 == 0, F.lit(-5.0)).when(k % 503 == 0, F.col("q") * 100).otherwise(F.col("q")).alias("demand"),
        F.when(k % 7 == 0, F.when(k % 77 == 0, F.lit(1e7)).otherwise(F.col("q") * 3)).alias("on_hand"),
        F.when(k % 307 == 0, F.lit(9999.0)).otherwise((k % 20).cast("double")).alias("lead_time_days"),
        (F.col("rp") * 0.6).alias("unit_cost"),
        F.when(k % 4 != 0, F.when(k % 10 == 0, F.col("rp") * 0.5).otherwise(F.col("rp"))).alias("unit_price"),
        F.lit("s").alias("supplier"), "category")


cte("loose", """
  select sku_id, date, case when k % 211 = 0 then -5.0 when k % 503 = 0 then q * 100 else q end as demand,
    case when k % 7 = 0 then case when k % 77 = 0 then 1e7 else q * 3 end end as on_hand,
    case when k % 307 = 0 then 9999.0 else (k % 20)::double end as lead_time_days, rp * 0.6 as unit_cost,
    case when k % 4 <> 0 then case when k % 10 = 0 then rp * 0.5 else rp end end as unit_price, category, 's' as supplier
  from (select upper(p_brand || '|' || p_type) as sku_id, cast(l_shipdate as date) as date, sum(l_quantity) as q,
          min(l_orderkey) as k, max(p_retailprice) as rp, min(p_type) as category
        from lineitem join part on l_partkey = p_partkey group by 1, 2)""")
SOFT = "select '{0}' as code, 'soft' as severity, '{1}' as field, count(*) as offending_row_count, count(distinct sku_id) as skus_affected from loose where {2} having count(*) > {3}"
SOFT_SQL = {
    "check_negative": SOFT.format("NEGATIVE_DEMAND", "demand", "demand < 0", 0),
    "check_price": SOFT.format("PRICE_BELOW_COST", "unit_price", "unit_price < unit_cost",
                               "greatest(0, 0.05 * (select count(*) from loose where unit_price is not null and unit_cost is not null))"),
    "check_lead_time": SOFT.format("LEAD_TIME_OUT_OF_RANGE", "lead_time_days", "lead_time_days > 365 or lead_time_days < 0", 0),
    "check_spikes": """select 'DEMAND_SPIKE_OUTLIER' as code, 'soft' as severity, 'demand' as field, count(*) as offending_row_count,
      count(distinct sku_id) as skus_affected from (select sku_id, demand,
        quantile_cont(demand, 0.5) over (partition by sku_id order by date rows between 89 preceding and current row) as med,
        count(*) over (partition by sku_id order by date rows between 89 preceding and current row) as seen from loose)
      where seen >= 10 and med > 0 and demand > 10 * med having count(*) > 0""",
    "check_on_hand": """select 'ON_HAND_IMPLAUSIBLE' as code, 'soft' as severity, 'on_hand' as field, sum(n)::bigint as offending_row_count,
      count(*) as skus_affected from (select sku_id, count(*) as n, arg_max(on_hand, date) filter (on_hand is not null) as oh,
        max(demand) as mx from loose group by 1) where oh > 365 * mx having count(*) > 0""",
    "check_gaps": """select 'DATE_GAPS_IN_ACTIVE_WINDOW' as code, 'soft' as severity, 'date' as field, sum(n)::bigint as offending_row_count,
      count(*) as skus_affected from (select sku_id, count(*) as n, quantile_cont(gap::double, 0.5) as med, max(gap) as mx from (
        select sku_id, date - lag(date) over (partition by sku_id order by date) as gap from loose) group by 1)
      where n >= 3 and med > 0 and mx > 5 * med having count(*) > 0""",
}
for name, sql in SOFT_SQL.items():
    register(name, (lambda fn: lambda s, sf: fn(loose_panel(s, sf)))(getattr(c, name)), sql)
cte("soft_findings", " union all ".join(f"select * from ({q})" for q in SOFT_SQL.values()))
register("business_checks", lambda s, sf: c.business_checks(loose_panel(s, sf)), "select * from soft_findings")

"""DuckDB side of the checks: named CTEs and a WITH-clause builder."""
import re

from ..functions import stats

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def build(sql: str) -> str:
    """Prefix `sql` with the CTEs it names, dependencies first."""
    done: dict[str, None] = {}

    def visit(text, path):
        for word in re.findall(r"[a-z_][a-z0-9_]*", text):
            if word in CTES and word not in done and word not in path:
                visit(CTES[word], path + (word,))
                done[word] = None

    visit(sql, ())
    if not done:
        return sql
    head = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in done)
    own = re.match(r"\s*with\s", sql)
    return f"{head},\n{sql[own.end():]}" if own else f"{head}\n{sql}"


def horner(coefs, x):
    text = repr(coefs[0])
    for c in coefs[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


def phi(x: str) -> str:
    t = f"(1.0::double / (1.0::double + {stats._AS_P!r} * abs({x})))"
    poly = f"({t} * {horner(tuple(reversed(stats._AS_B)), t)})"
    tail = f"(exp(-(({x}) * ({x})) / 2.0) / {stats._SQRT_2PI!r} * {poly})"
    return f"(case when ({x}) >= 0 then 1.0 - {tail} else {tail} end)"


def ppf(p: str) -> str:
    q, rr = f"(({p}) - 0.5)", f"((({p}) - 0.5) * (({p}) - 0.5))"
    centre = f"({horner(stats.ACKLAM_A, rr)} * {q} / ({horner(stats.ACKLAM_B, rr)} * {rr} + 1.0))"

    def tail(s):
        return f"({horner(stats.ACKLAM_C, s)} / ({horner(stats.ACKLAM_D, s)} * {s} + 1.0))"
    lo, hi = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - ({p})))"
    return (f"(case when ({p}) < {stats.ACKLAM_LOW} then {tail(lo)} "
            f"when ({p}) > {1 - stats.ACKLAM_LOW!r} then -{tail(hi)} else {centre} end)")


def gamma_ppf(p, shape, scale):
    root = f"(1.0 - 1.0/(9.0*{shape}) + {ppf(p)} * sqrt(1.0/(9.0*{shape})))"
    return f"greatest(0.0, {shape} * {scale} * {root} * {root} * {root})"


def hash8(x):
    return f"cast('0x' || substr(md5({x}), 1, 8) as bigint)"


# ---- derived tables ---------------------------------------------------------
for grain, period, name in (("bt", "week", "panel"), ("pm", "month", "panel_pm"), ("pw", "week", "panel_pw")):
    sku = "upper(p_brand || '|' || p_type)" if grain == "bt" else "'P' || cast(p_partkey as varchar)"
    step = "interval 7 day" if period == "week" else "interval 1 month"
    cte(f"cells_{grain}", f"""
      select {sku} as sku_id, cast(date_trunc('{period}', l_shipdate) as date) as date,
             sum(l_quantity) as demand, sum(l_extendedprice) as ext
      from lineitem join part on l_partkey = p_partkey group by 1, 2""")
    cte(f"grid_{grain}", f"""
      select s.sku_id, cast(g.d as date) as date
      from (select distinct sku_id from cells_{grain}) s,
           (select unnest(generate_series(lo::timestamp, hi::timestamp, {step})) as d
            from (select min(date) lo, max(date) hi from cells_{grain})) g""")
    cte(f"attrs_{grain}", f"""
      select sku_id, category, unit_cost, key, s_name as supplier from (
        select {sku} as sku_id, min(p_type) as category, round(sum(p_retailprice), 1) * 0.6 / count(*) as unit_cost,
               {hash8(sku)} % 10 as key
        from part group by 1, 4) left join supplier on s_suppkey = key""")
    cte(name, f"""
      select g.sku_id, g.date, coalesce(c.demand, 0.0) as demand,
        case when g.date = max(g.date) over () then
          round(avg(coalesce(c.demand, 0.0)) over (partition by g.sku_id)
                * (1 + {hash8("'oh' || g.sku_id")} % 8), 2) end as on_hand,
        cast(3.0 + (a.key * 7) % 25 + extract(day from g.date) % 3 as double) as lead_time_days,
        a.unit_cost, round(c.ext, 2) / c.demand as unit_price, a.supplier, a.category
      from grid_{grain} g left join cells_{grain} c on c.sku_id = g.sku_id and c.date = g.date
      join attrs_{grain} a on a.sku_id = g.sku_id""")

cte("suppliers", """
  select 'S' || lpad(cast(s_suppkey as varchar), 5, '0') as supplier_id, s_name as name,
    'orders@s' || s_suppkey || '.example.com' as contact_email,
    (['USA','Canada','Mexico','China','Vietnam'])[s_suppkey % 5 + 1] as country,
    (['Net 30','Net 45','2/10 Net 60','prepaid','15 days'])[s_suppkey % 5 + 1] as payment_terms,
    cast(3.0 + (s_suppkey * 7) % 25 as double) as default_lead_time_days,
    cast(1.0 + s_suppkey % 4 as double) as lead_time_std_days,
    ([12.0,24.0,50.0,100.0])[s_suppkey % 4 + 1]::double as moq,
    ([1.0,6.0,12.0,24.0,48.0])[s_suppkey % 5 + 1]::double as case_pack, '' as notes
  from supplier""")
cte("receipts", """
  select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(recv as varchar) as receipt_id,
    upper(p_brand || '|' || p_type) as sku_id, 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as supplier_id,
    recv - lead - jit as ordered_date, recv - jit as expected_date, recv as received_date,
    l_quantity as ordered_qty, case when l_orderkey % 14 = 0 then l_quantity * 0.9 else l_quantity end as received_qty
  from (select *, cast(l_shipdate as date) as recv, cast(3 + (l_suppkey * 7) % 25 as integer) as lead,
          cast((l_orderkey * 13 + l_linenumber * 7) % 9 - 3 as integer) as jit from lineitem)
  join part on l_partkey = p_partkey""")
cte("order_lines", """
  select case when l_orderkey % 97 = 0 then ' ' else ' ' || upper(p_brand || '|' || p_type) end as sku_raw,
    case when l_orderkey % 89 = 0 then '-2' when l_orderkey % 83 = 0 then 'n/a'
         else cast(cast(l_quantity as integer) as varchar) end as qty_raw,
    cast(l_shipdate as date) as local_day, l_orderkey,
    case when l_returnflag = 'R' then 'Refunded' else 'paid' end as status_raw,
    case when l_orderkey % 13 = 0 then null else cast(cast(floor(l_extendedprice / l_quantity) as bigint) as varchar) end as price_raw,
    p_name as name_raw
  from lineitem join part on l_partkey = p_partkey""")
cte("po_lines", """
  select 'PO-1995-' || lpad(cast(l_orderkey as varchar), 9, '0') as po_id, upper(p_brand || '|' || p_type) as sku_id,
    sum(l_quantity) as qty, round(avg(case when l_orderkey % 11 <> 0 then p_retailprice * 0.6 end), 2) as unit_cost
  from lineitem join part on l_partkey = p_partkey group by 1, 2""")
cte("purchase_orders", """
  select h.po_id, supplier_id, status, created_at, needed_by, coalesce(total_cost, 0.0) as total_cost,
    coalesce(total_units, 0.0) as total_units, expedite_flag from (
      select 'PO-1995-' || lpad(cast(o_orderkey as varchar), 9, '0') as po_id,
        'S' || lpad(cast(o_custkey % 10 as varchar), 5, '0') as supplier_id,
        case when o_orderkey % 23 = 0 then 'cancelled' when o_orderstatus = 'F' then 'received'
             when o_orderstatus = 'O' then 'placed' else 'approved' end as status,
        o_orderdate::timestamp as created_at, cast(o_orderdate as date) + 21 as needed_by,
        o_orderpriority = '1-URGENT' as expedite_flag from orders) h
    left join (select po_id, round(sum(qty * coalesce(unit_cost, 0.0)), 2) as total_cost, sum(qty) as total_units
               from po_lines group by 1) l on l.po_id = h.po_id""")
cte("po_status_log", """
  select po_id, case when i > 1 then path[i - 1] end as from_status, path[i] as to_status, 'planner' as by_user,
    (d + cast((i - 1) * 2 as integer))::timestamp as at
  from (select po_id, d, path, unnest(range(1, len(path) + 1)) as i from (
    select 'PO-1995-' || lpad(cast(o_orderkey as varchar), 9, '0') as po_id, cast(o_orderdate as date) as d,
      case when o_orderkey % 23 = 0 then ['drafted','cancelled']
           when o_orderkey % 17 = 0 and o_orderstatus <> 'P' then ['drafted','placed']
           when o_orderstatus = 'F' then ['drafted','approved','placed','received']
           when o_orderstatus = 'O' then ['drafted','approved','placed']
           else ['drafted','approved'] end as path from orders))""")
cte("op_events", "select event_id, ts::timestamp as ts, event_type as operation, value from events")

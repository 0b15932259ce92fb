"""DuckDB side of lead-time demand and the (s,S) choice, in rows where the operators fold arrays."""
from ..operators.policies import CELLS, LEAD_POINTS, S_STEPS, SHORTFALL, SS_CELLS
from ..schema import QUANTILE_COLS, QUANTILE_LEVELS
from .oracle import cte, gamma_ppf

TINY = 1e-9


def below(x: str, f: str) -> str:
    """E(x - f * X)+ with quantiles q."""
    terms = [f"greatest(0.0, {x} - {f} * q[1]) * {QUANTILE_LEVELS[0]}", f"greatest(0.0, {x} - {f} * q[5]) * {1.0 - QUANTILE_LEVELS[-1]!r}"]
    for i, (lo, hi) in enumerate(zip(QUANTILE_LEVELS, QUANTILE_LEVELS[1:])):
        a, b = f"{f} * q[{i + 1}]", f"{f} * q[{i + 2}]"
        terms.append(f"(case when {x} <= {a} then 0.0 when {x} >= {b} then {x} - ({a} + {b}) / 2 else ({x} - {a}) * ({x} - {a}) / (2 * ({b} - {a})) end) * {hi - lo!r}")
    return "(" + " + ".join(terms) + ")"


def split(source: str, keys: str, f: str) -> str:
    """Chances by cell from rows (keys, q, w): second differences of E(x - f X)+ on the lattice."""
    top = f"cast(ceil(greatest(0.0, {f} * q[5]) / w - {TINY}) as integer)"
    return f"""select {keys}, c, (g1 - 2.0 * g + coalesce(g0, 0.0)) / w as p from (
      select {keys}, c, w, top, g, lead(g) over (partition by {keys} order by c) as g1, lag(g) over (partition by {keys} order by c) as g0 from (
        select *, {below('(c * w)', f)} - {below('0.0', f)} as g from (select *, {top} as top, unnest(range(0, {top} + 2)) as c from {source}))) where c <= top"""


def cells_sql(tag: str, fc: str, lt: str, days: float, longest: int) -> None:
    """CTEs <tag>_cells (sku_id, cell, w, p, cum) and <tag>_mom; lead times up to `longest` + 1 periods."""
    q = ", ".join(QUANTILE_COLS)
    cte(f"{tag}_lead", f"""select sku_id, k, {gamma_ppf(f'((k + 0.5) / {LEAD_POINTS})', 'shape', 'scale')} / {days} as l from {lt}, (select unnest(range(0, {LEAD_POINTS})) as k)""")
    cte(f"{tag}_q", f"select sku_id, step - 1 as i, list_sort([{q}]) as q from {fc}")
    cte(f"{tag}_per", f"""select n.sku_id, n.i, q, longest from (select sku_id, longest, last, unnest(range(0, cast(floor(longest) as integer) + 1)) as i from
      (select sku_id, max(l) as longest from {tag}_lead group by 1) join (select sku_id, max(i) as last from {tag}_q group by 1) using (sku_id)) n join {tag}_q s on s.sku_id = n.sku_id and s.i = least(n.i, n.last)""")
    cte(f"{tag}_w", f"""select sku_id, case when most > 0 then most / {CELLS} else 1.0 end as w from (
      select sku_id, sum(greatest(0.0, q[5]) * least(1.0, longest - i)) as most from {tag}_per group by 1)""")
    cte(f"{tag}_whole", split(f"(select p.*, w from {tag}_per p join {tag}_w using (sku_id))", "sku_id, i", "1.0"))
    cte(f"{tag}_part", f"""select sku_id, i, c, sum(p) / {LEAD_POINTS} as p from ({split(
        f"(select p.sku_id, p.i, l.k, l.l - p.i as part, q, w from {tag}_per p join {tag}_w using (sku_id) join {tag}_lead l on l.sku_id = p.sku_id and floor(l.l) = p.i)", "sku_id, i, k", "part")}) group by 1, 2, 3""")
    rest = None
    for n in range(longest, -1, -1):
        more = "" if rest is None else f" union all select a.sku_id, a.c + b.c, a.p * b.p from {tag}_whole a join {rest} b on b.sku_id = a.sku_id where a.i = {n}"
        rest = f"{tag}_r{n}"
        cte(rest, f"select sku_id, c, sum(p) as p from (select sku_id, c, p from {tag}_part where i = {n}{more}) group by 1, 2")
    cte(f"{tag}_cells", f"""select sku_id, c as cell, w, p, sum(p) over (partition by sku_id order by c) as cum from (
      select sku_id, w, n.c, coalesce(p, 0.0) as p from (select sku_id, unnest(range(0, max(c) + 1)) as c from {rest} group by sku_id) n join {tag}_w using (sku_id) left join {rest} r on r.sku_id = n.sku_id and r.c = n.c)""")
    cte(f"{tag}_mom", f"""select sku_id, w, m as ltd_mean, sqrt(greatest(0.0, s2 - m * m)) as ltd_std from (
      select sku_id, any_value(w) as w, sum(p * cell * w) as m, sum(p * (cell * w) * (cell * w)) as s2 from {tag}_cells group by 1)""")


def level_sql(lv: str, src: str, tag: str) -> str:
    """(sku_id, lv, r, above, short, excess) for a level column of `src`."""
    return f"""(select l.sku_id, l.lv, r, sum(p) filter (cell * w > r + {TINY} * w) as above0, coalesce(sum(p) filter (cell * w > r + {TINY} * w), 0.0) as above,
        sum(p * greatest(0.0, cell * w - r)) as short, sum(p * greatest(0.0, r - cell * w)) as excess from (
      select s.sku_id, s.{lv} as lv, least(count(*) filter (cum < s.{lv} - {TINY}), max(cell)) * any_value(w) as r from {src} s join {tag}_cells c on c.sku_id = s.sku_id group by 1, 2) l
      join {tag}_cells c on c.sku_id = l.sku_id group by 1, 2, 3)"""


LTD = "greatest(0.1, mean * lead)"
GAP = "sqrt(2.0 * greatest(annual_demand, 1.0) * order_cost / greatest(holding_cost, 1e-6))"
SS_W = f"((2.5 * {LTD} + 2.0 * {GAP}) / {SS_CELLS})"
C = SS_CELLS + 4


def history_cells(name: str, frame: str, panel: str) -> None:
    """One-period chances of a SKU's own history on the (s,S) lattice, as a list of C cells."""
    cte(name, f"""select sku_id, list((g1 - 2.0 * g + coalesce(g0, 0.0)) / w order by c) as d from (
      select *, lead(g) over (partition by sku_id order by c) as g1, lag(g) over (partition by sku_id order by c) as g0 from (
        select f.sku_id, c, w, avg(greatest(0.0, c * w - demand)) as g from (select sku_id, {SS_W} as w, unnest(range(0, {C + 1})) as c from {frame}) f join {panel} y on y.sku_id = f.sku_id group by 1, 2, 3)) where c < {C} group by 1""")


def demand_cells(name: str, frame: str, fc: str) -> None:
    """One-period chances of a forecast step drawn at random, as a list of C cells."""
    q = ", ".join(QUANTILE_COLS)
    rows = f"(select f.sku_id, step, {SS_W} as w, list_sort([{q}]) as q from {frame} f join {fc} c on c.sku_id = f.sku_id)"
    cte(name, f"""select sku_id, list(coalesce(p, 0.0) order by c) as d from (select n.sku_id, n.c, p from (select sku_id, unnest(range(0, {C})) as c from {frame}) n left join (
      select sku_id, c, sum(p) / any_value(steps) as p from ({split(rows, 'sku_id, step', '1.0')}) join (select sku_id, count(*) as steps from {fc} group by 1) using (sku_id) group by 1, 2) r on r.sku_id = n.sku_id and r.c = n.c) group by 1""")


def ss_sql(name: str, frame: str, cells: str, periods: float) -> None:
    """CTE name (sku_id, s, big_s, stockout_prob, fill_rate, cost) from frame (sku_id, mean, lead, review, costs, level) and cells (sku_id, d)."""
    conv = f"list_transform(range(0, {C}), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: a[j + 1] * b[k - j + 1])))"
    power = lambda n: f"list_reduce(list_transform(range(0, {n}), lambda z: d), lambda a, b: {conv})"
    cte(f"{name}_t", f"""select f.*, {LTD} as ltd, {GAP} as gap, {SS_W} as w, {power('review')} as dr, {power('lead + review')} as da, {power('lead')} as dl from {frame} f join {cells} using (sku_id)""")
    run = lambda a: f"list_transform(range(0, {C}), lambda k: list_sum({a}[1 : k + 1]))"
    cte(f"{name}_v", f"""select *, [0.0::double] || list_transform(range(0, {C}), lambda k: w * list_sum(cum[1 : k + 1])) as over, [0.0::double] || list_transform(range(0, {C}), lambda k: w * list_sum(cum_lead[1 : k + 1])) as over_lead,
        list_reduce(list_transform(range(0, cast(round(2.0 * gap / w, 0) as integer) + 1), lambda j: case when j = 0 then [1.0 / still] else [j::double] end),
          lambda m, e: list_append(m, list_sum(list_transform(range(1, e[1]::bigint + 1), lambda l: dr[l + 1] * m[e[1]::bigint - l + 1])) / still)) as m
      from (select *, {run('da')} as cum, {run('dl')} as cum_lead, greatest(1e-12, 1.0 - dr[1]) as still from {name}_t)""")
    step = lambda lo, hi: f"({lo} + {hi} / {S_STEPS - 1} * "
    cte(f"{name}_p", f"""select *, cast(floor(s / w) as integer) as low, s / w - floor(s / w) as part from (
      select *, ltd * {step('0.5::double', '2.0::double')} (n // {S_STEPS})) as s, greatest(1, cast(round(gap * {step('0.5::double', '1.5::double')} (n % {S_STEPS})) / w, 0) as integer)) as gc from {name}_v, (select unnest(range(0, {S_STEPS ** 2})) as n))""")
    at = lambda a: f"({a}[k + 1] + ({a}[k + 2] - {a}[k + 1]) * part)"
    cte(f"{name}_s", f"""select sku_id, n, any_value(s) as s, any_value(s + gc * w) as big_s, any_value(mean) as mean, any_value(review) as review, any_value(holding_cost) as h, any_value(order_cost) as oc, any_value(service_level) as lv,
        sum(mj) as m, sum(mj * {at('over')}) as over, sum(mj * {at('over_lead')}) as over_lead, sum(mj * greatest(0.0, 1.0 - cum[k + 1])) as out
      from (select *, m[j + 1] as mj, low + gc - j as k from (select *, unnest(range(0, gc)) as j from {name}_p)) group by 1, 2""")
    cte(name, f"""select sku_id, s, big_s, stockout_prob, fill_rate, cost from (select *, row_number() over (partition by sku_id order by round(cost + greatest(0.0, lv - fill_rate) * {SHORTFALL}, 6), n) as rk from (
      select sku_id, n, s, big_s, lv, out / m as stockout_prob, (oc + h * review / {periods} * over) / m * {periods} / review as cost,
        case when mean > 0 then greatest(0.0, least(1.0, (over_lead - over) / (m * review * mean))) else 1.0 end as fill_rate from {name}_s)) where rk = 1""")

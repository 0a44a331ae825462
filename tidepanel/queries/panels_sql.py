"""SQL text of the panels in sources/warehouse.py, for the oracle side."""

from __future__ import annotations

PANELS = {
    "f1": """
        select 'all' as panel_id, o_orderpriority as series_id,
               cast(date_trunc('month', o_orderdate) as date) as ts,
               cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value
        from orders group by 1, 2, 3""",
    "f2": """
        select n_name as panel_id, c_mktsegment as series_id,
               cast(date_trunc('month', o_orderdate) as date) as ts,
               cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value
        from orders join customer on o_custkey = c_custkey
                    join nation on c_nationkey = n_nationkey
        group by 1, 2, 3""",
    "f3": """
        select 'all' as panel_id, cast(user_id as varchar) as series_id,
               cast(date_trunc('day', ts) as date) as ts,
               cast(sum(cast(value as decimal(18,2))) as double) as value
        from events group by user_id, cast(date_trunc('day', ts) as date)""",
    "f4": """
        select 'all' as panel_id, 'spend_m' as series_id, cast(date_trunc('month', l_shipdate) as date) as ts,
               cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as value
        from lineitem group by 3
        union all
        select 'all', 'price_m', cast(date_trunc('month', l_shipdate) as date),
               round(cast(sum(cast(l_extendedprice as decimal(18,2))) as double)
                     / cast(sum(cast(l_quantity as decimal(18,2))) as double), 6)
        from lineitem group by 3
        union all
        select 'all', 'count_m', cast(date_trunc('month', o_orderdate) as date), cast(count(*) as double)
        from orders group by 3
        union all
        select 'all', 'output_q', cast(date_trunc('quarter', o_orderdate) as date),
               cast(sum(cast(o_totalprice as decimal(18,2))) as double)
        from orders group by 3
        union all
        select 'all', 'yield_d', cast(date_trunc('day', l_shipdate) as date),
               round(cast(100 as double) * cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*), 6)
        from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_quantity > 40 group by 3""",
    "f5": """
        select 'all' as panel_id, cast(vec_id as varchar) as series_id,
               date '2000-01-01' + cast(i as integer) as ts, round(cast(embedding[i + 1] as double), 6) as value
        from embeddings, (select unnest(range(0, 64)) as i)""",
    "f6": """
        select 'all' as panel_id, p_brand as feature,
               round(cast(sum(cast(p_retailprice as decimal(18,2))) as double)
                     / cast(count(*) as double), 6) as agg_mse
        from part group by 2""",
}
PANELS["f1m"] = f"select panel_id, series_id, ts, value / 1000003e0 as value from ({PANELS['f1']})"
PANELS["f2m"] = f"select panel_id, series_id, ts, value / 1000003e0 as value from ({PANELS['f2']})"


def month_grid_sql(panel: str) -> str:
    """Every month start of a panel's span for each of its series."""
    return f"""
        select s.panel_id, s.series_id, g.ts, p.value
        from (select distinct panel_id, series_id from {panel}) s
        join (select panel_id, cast(unnest(generate_series(
                       case when date_trunc('month', min(ts)) < min(ts)
                            then date_trunc('month', min(ts)) + interval 1 month
                            else date_trunc('month', min(ts)) end,
                       cast(max(ts) as timestamp), interval 1 month)) as date) as ts
              from {panel} group by panel_id) g on g.panel_id = s.panel_id
        left join {panel} p on p.panel_id = s.panel_id and p.series_id = s.series_id and p.ts = g.ts"""


def split_sql(panel: str) -> str:
    """The panel with its chronological 80/20 split."""
    return f"""
        select p.panel_id, p.series_id, p.ts, p.value,
               case when d.rn <= d.n - ceil(cast(0.2 as double) * d.n) then 'train' else 'test' end as split
        from {panel} p
        join (select panel_id, ts, row_number() over (partition by panel_id order by ts) as rn,
                     count(*) over (partition by panel_id) as n
              from (select distinct panel_id, ts from {panel})) d
          on d.panel_id = p.panel_id and d.ts = p.ts"""


def sql(body: str, *panels: str, **steps: str) -> str:
    """A query over the named panels followed by named steps."""
    ctes = [f"{p} as ({PANELS[p]})" for p in panels]
    ctes += [f"{name} as ({text})" for name, text in steps.items()]
    return f"with {', '.join(ctes)} {body}" if ctes else body

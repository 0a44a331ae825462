"""Queries over expanding and rolling frames and the feature calculators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import calculators as calc
from tidepanel.functions.calculators import label
from tidepanel.functions.scalar import tidy
from tidepanel.keys import VALUE
from tidepanel.operators import features, ranks, split, transform
from tidepanel.operators.align import month_grid
from tidepanel.queries.panels_sql import month_grid_sql, split_sql, sql
from tidepanel.queries.prepare import _Z
from tidepanel.sources import warehouse

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
W = "partition by panel_id, series_id order by ts"
ROLL_SHIFT = 11


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn(VALUE, tidy(F.col(VALUE), digits))


# --- oracle side: every frame as plain rows, one group per frame -----------------------


def roll_sql(panel: str, shift: int | None = None, keys: str = "panel_id, series_id") -> dict[str, str]:
    """Steps p (numbered rows) and roll (a row per frame and member)."""
    on = " and ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    low = "" if shift is None else f" and b.rn >= a.rn - {shift}"
    picks = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    frame = f"partition by {picks}, a.ts"
    return {
        "p": f"select *, row_number() over (partition by {keys} order by ts) as rn from {panel} where value is not null",
        "roll": f"""select {picks}, a.ts, b.value as v,
               row_number() over ({frame} order by b.ts) - 1 as i, count(*) over ({frame}) as n,
               avg(b.value) over ({frame}) as mu, stddev_pop(b.value) over ({frame}) as sd,
               min(b.value) over ({frame}) as lo, max(b.value) over ({frame}) as hi,
               lag(b.value, 1) over ({frame} order by b.ts) as l1, lag(b.value, 2) over ({frame} order by b.ts) as l2,
               lag(b.value, 3) over ({frame} order by b.ts) as l3, lag(b.value, 4) over ({frame} order by b.ts) as l4,
               lag(b.value, 6) over ({frame} order by b.ts) as l6
        from p a join p b on {on} and b.rn <= a.rn{low}""",
    }


def long_sql(calcs: dict[str, str], keys: str = "panel_id, series_id", digits: int = 6, source: str = "roll") -> str:
    """Calculators (name -> aggregate over a frame's rows) in long form."""
    rest = keys.replace(", series_id", "")
    aggs = ", ".join(f"cast({e} as double) as c{i}" for i, e in enumerate(calcs.values()))
    names = ", ".join(f"'{n}'" for n in calcs)
    values = ", ".join(f"round(c{i}, {digits}) + 0.0" for i in range(len(calcs)))
    return f"""select {rest}, ts, series_id || '__' || f as feature, value from
        (select {keys}, ts, unnest([{names}]) as f, unnest([{values}]) as value
         from (select {keys}, ts, {aggs} from {source} group by {keys}, ts))"""


MINIMAL_SQL = {
    "sum_values": "sum(v)",
    "median": "quantile_cont(v, 0.5)",
    "mean": "avg(v)",
    "length": "count(*)",
    "standard_deviation": "stddev_pop(v)",
    "variance": "var_pop(v)",
    "root_mean_square": "sqrt(avg(v * v))",
    "maximum": "max(v)",
    "absolute_maximum": "max(abs(v))",
    "minimum": "min(v)",
}

_SKEW = "case when count(*) > 2 then case when var_pop(v) > 0 then skewness(v) else 0 end end"
_KURT = "case when count(*) > 3 then case when var_pop(v) > 0 then kurtosis(v) else 0 end end"
_LINE = {
    "intercept": "regr_intercept(v, i)",
    "rvalue": "case when var_pop(v) > 0 then corr(v, i) else 0 end",
    "slope": "regr_slope(v, i)",
    "stderr": "case when count(*) > 2 then sqrt(greatest(regr_syy(v, i) - regr_slope(v, i) * regr_sxy(v, i), 0) / regr_sxx(v, i) / (count(*) - 2)) else 0 end",
}
RUNNING_SQL = {
    "abs_energy": "sum(v * v)",
    "variance_larger_than_standard_deviation": "case when var_pop(v) > stddev_pop(v) then 1 else 0 end",
    "variation_coefficient": "stddev_pop(v) / nullif(avg(v), 0)",
    "skewness": _SKEW,
    "kurtosis": _KURT,
    label("count_above", t=0): "count_if(v >= 0) / cast(count(*) as double)",
    label("count_below", t=0): "count_if(v <= 0) / cast(count(*) as double)",
    **{label("range_count", min=a, max=b): f"count_if(v >= {a} and v < {b})" for a, b in calc.RANGES},
    **{label("value_count", value=c): f"count_if(v = {c})" for c in calc.COUNTED},
    **{
        label("large_standard_deviation", r=r): f"case when stddev_pop(v) * cast({1 - 1e-12!r} as double) > cast({r!r} as double) * (max(v) - min(v)) then 1 else 0 end"
        for r in calc.LARGE_SD_R
    },
    **{
        label("symmetry_looking", r=r): f"case when abs(avg(v) - quantile_cont(v, 0.5)) < cast({r!r} as double) * (max(v) - min(v)) then 1 else 0 end"
        for r in calc.SYMMETRY_R
    },
    **{label("linear_trend", attr=k): f"case when count(*) > 1 then {e} end" for k, e in _LINE.items()},
}

_D = "(v - l1)"
LAGGED_SQL = {
    "absolute_sum_of_changes": f"coalesce(sum(abs{_D}), 0)",
    "mean_abs_change": f"avg(abs{_D})",
    "mean_change": f"avg{_D}",
    "mean_second_derivative_central": "avg(cast(0.5 as double) * (v - 2 * l1 + l2))",
    **{label("c3", lag=k): f"coalesce(avg(l{2 * k} * l{k} * v), 0)" for k in calc.LAGS},
    **{
        label("time_reversal_asymmetry_statistic", lag=k): f"coalesce(avg(v * v * l{k} - l{k} * l{2 * k} * l{2 * k}), 0)"
        for k in calc.LAGS
    },
    label("cid_ce", normalize=True): f"case when max(sd) > 0 then sqrt(coalesce(sum({_D} * {_D}), 0)) / max(sd) else 0 end",
    label("cid_ce", normalize=False): f"sqrt(coalesce(sum({_D} * {_D}), 0))",
    **{label("number_crossing_m", m=m): f"coalesce(count_if((v > {m}) <> (l1 > {m})), 0)" for m in calc.CROSSED},
}

_CNT = "(select panel_id, series_id, ts, v, count(*) as k from roll group by all)"
ORDER_SQL = {
    **{label("quantile", q=q): f"quantile_cont(v, {q})" for q in calc.QUANTILES},
    "first_location_of_maximum": "min(case when v = hi then i end) / cast(count(*) as double)",
    "last_location_of_maximum": "(max(case when v = hi then i end) + 1) / cast(count(*) as double)",
    "first_location_of_minimum": "min(case when v = lo then i end) / cast(count(*) as double)",
    "last_location_of_minimum": "(max(case when v = lo then i end) + 1) / cast(count(*) as double)",
    "has_duplicate": "case when count(distinct v) < count(*) then 1 else 0 end",
    "has_duplicate_max": "case when count_if(v = hi) > 1 then 1 else 0 end",
    "has_duplicate_min": "case when count_if(v = lo) > 1 then 1 else 0 end",
    "percentage_of_reoccurring_values_to_all_values": "count(distinct case when k > 1 then v end) / cast(count(distinct v) as double)",
    "percentage_of_reoccurring_datapoints_to_all_datapoints": "count_if(k > 1) / cast(count(*) as double)",
    "sum_of_reoccurring_values": "coalesce(sum(case when k > 1 then v / k end), 0)",
    "sum_of_reoccurring_data_points": "coalesce(sum(case when k > 1 then v end), 0)",
    "ratio_value_number_to_time_series_length": "count(distinct v) / cast(count(*) as double)",
    **{
        label("mean_n_absolute_max", number_of_maxima=k): f"case when count(*) > {k} then avg(case when big <= {k} then abs(v) end) end"
        for k in calc.LARGEST
    },
}
_ORDER_ROWS = """select *, count(*) over (partition by panel_id, series_id, ts, v) as k,
    row_number() over (partition by panel_id, series_id, ts order by abs(v) desc, i) as big from roll"""

# The frame as rows again: runs, chunks, cumulated mass and peaks by window functions.
_FRAME = "partition by panel_id, series_id, ts"
_ARRAY_ROWS = f"""
    select *, sum(e) over ({_FRAME}) as energy,
      case when i < (n % 10) * (n // 10 + 1) then i // (n // 10 + 1)
           else (n % 10) + (i - (n % 10) * (n // 10 + 1)) // (n // 10) end as chunk,
      count(*) over ({_FRAME}, up, up_run) as up_len, count(*) over ({_FRAME}, dn, dn_run) as dn_len,
      cum / nullif(sum(abs(v)) over ({_FRAME}), 0) as mass
    from (select *, i - row_number() over ({_FRAME}, up order by i) as up_run,
                 i - row_number() over ({_FRAME}, dn order by i) as dn_run,
                 sum(abs(v)) over ({_FRAME} order by i rows unbounded preceding) as cum
          from (select *, v > mu as up, v < mu as dn, v * v as e,
                       {", ".join(f"max(v) over ({_FRAME} order by i rows between {k} preceding and 1 preceding) as b{k}, "
                                  f"max(v) over ({_FRAME} order by i rows between 1 following and {k} following) as f{k}"
                                  for k in calc.PEAK_SUPPORT)}
                from roll))"""
ARRAY_SQL = {
    "count_above_mean": "count_if(up)",
    "count_below_mean": "count_if(dn)",
    "longest_strike_above_mean": "coalesce(max(case when up then up_len end), 0)",
    "longest_strike_below_mean": "coalesce(max(case when dn then dn_len end), 0)",
    **{
        label("ratio_beyond_r_sigma", r=r): f"count_if(abs(v - mu) > cast({r} as double) * sd) / cast(count(*) as double)"
        for r in calc.SIGMAS
    },
    **{
        label("energy_ratio_by_chunks", num_segments=10, segment_focus=k): f"coalesce(sum(case when chunk = {k} then e end), 0) / nullif(max(energy), 0)"
        for k in range(10)
    },
    **{
        label("index_mass_quantile", q=q): f"(min(case when mass >= {q} then i end) + 1) / cast(count(*) as double)"
        for q in calc.QUANTILES
    },
    **{
        label("number_peaks", n=k): f"coalesce(count_if(i >= {k} and i < n - {k} and v > b{k} and v > f{k}), 0)" for k in calc.PEAK_SUPPORT
    },
}


def _columns(panel: DataFrame, registry: dict, shift: int | None = None) -> DataFrame:
    return rounded(features.extract_columns(panel, registry.values(), max_shift=shift))


@query(
    "expanding_frame",
    sql(
        f"""select panel_id, series_id, ts, value, frame_start, cast(frame_length as bigint) as frame_length from
            (select *, min(ts) over ({W} rows unbounded preceding) as frame_start,
                    count(*) over ({W} rows unbounded preceding) as frame_length from f2) where frame_length > 2""",
        "f2",
    ),
)
def expanding_frame(spark, d):
    return features.expanding_frame(warehouse.orders_by_nation(spark, d), min_shift=2)


@query("extract_minimal", sql(long_sql(MINIMAL_SQL), "f2m", **roll_sql("f2m")))
def extract_minimal(spark, d):
    return rounded(features.extract(warehouse.scaled_nations(spark, d), "minimal"))


_SPLIT_KEYS = "panel_id, split, series_id"
_SPLIT_MINIMAL = sql(
    long_sql(MINIMAL_SQL, _SPLIT_KEYS), "f1m", s=split_sql("f1m"), **roll_sql("s", keys=_SPLIT_KEYS)
)


@query("extract_minimal_by_split", _SPLIT_MINIMAL)
def extract_minimal_by_split(spark, d):
    panel = split.chrono_split(warehouse.scaled_orders(spark, d))
    out = features.extract(panel, "minimal")
    return rounded(out)


@query("extract_minimal_rolling", sql(long_sql(MINIMAL_SQL), "f2m", **roll_sql("f2m", ROLL_SHIFT)))
def extract_minimal_rolling(spark, d):
    return rounded(features.extract(warehouse.scaled_nations(spark, d), "minimal", max_shift=ROLL_SHIFT))


@query(
    "expanding_moments_blocked",
    sql(
        "select panel_id, series_id, ts, "
        + ", ".join(f"round({e}, 6) + 0.0 as {n}" for n, e in MINIMAL_SQL.items() if n != "median")
        + " from roll group by 1, 2, 3",
        "f2m",
        **roll_sql("f2m"),
    ),
)
def expanding_moments_blocked(spark, d):
    out = features.expanding_moments(warehouse.scaled_nations(spark, d), block_days=200)
    return out.withColumns({n: tidy(F.col(n)) for n in MINIMAL_SQL if n != "median"})


@query("features_running", sql(long_sql(RUNNING_SQL), "f1m", **roll_sql("f1m")))
def features_running(spark, d):
    return _columns(warehouse.scaled_orders(spark, d), calc.RUNNING)


@query("features_running_rolling", sql(long_sql(RUNNING_SQL), "f1m", **roll_sql("f1m", ROLL_SHIFT)))
def features_running_rolling(spark, d):
    return _columns(warehouse.scaled_orders(spark, d), calc.RUNNING, ROLL_SHIFT)


@query("features_lagged", sql(long_sql(LAGGED_SQL), "f1m", **roll_sql("f1m")))
def features_lagged(spark, d):
    return _columns(warehouse.scaled_orders(spark, d), calc.LAGGED)


@query("features_lagged_rolling", sql(long_sql(LAGGED_SQL), "f2m", **roll_sql("f2m", ROLL_SHIFT)))
def features_lagged_rolling(spark, d):
    return _columns(warehouse.scaled_nations(spark, d), calc.LAGGED, ROLL_SHIFT)


# Repeated values appear in the event series when they are rounded to tens.
_TENS = "select panel_id, series_id, ts, round(value / 10.0::double) * 10 as value from f3"


@query("features_order", sql(long_sql(ORDER_SQL, source="o"), "f3", tens=_TENS, **roll_sql("tens"), o=_ORDER_ROWS))
def features_order(spark, d):
    tens = warehouse.events_by_user(spark, d).withColumn(VALUE, F.round(F.col(VALUE) / 10.0) * 10)
    return _columns(tens, calc.ORDER)


_ARRAY_CHECKED = (
    "count_above_mean",
    "count_below_mean",
    "longest_strike_above_mean",
    "longest_strike_below_mean",
    "ratio_beyond_r_sigma",
    "energy_ratio_by_chunks",
    "index_mass_quantile",
    "number_peaks",
)


@query("features_array", sql(long_sql(ARRAY_SQL, source="r"), "f1m", **roll_sql("f1m"), r=_ARRAY_ROWS))
def features_array(spark, d):
    return _columns(warehouse.scaled_orders(spark, d), {k: calc.ARRAY[k] for k in _ARRAY_CHECKED})


@query("features_array_rolling", sql(long_sql(ARRAY_SQL, source="r"), "f1m", **roll_sql("f1m", 35), r=_ARRAY_ROWS))
def features_array_rolling(spark, d):
    return _columns(warehouse.scaled_orders(spark, d), {k: calc.ARRAY[k] for k in _ARRAY_CHECKED}, 35)


_BINS = """select panel_id, series_id, ts, count(*) / cast(n as double) as share from
    (select *, least(cast(floor((v - lo) / nullif(hi - lo, 0) * 10) as int), 9) as bin from roll) group by panel_id, series_id, ts, bin, n"""


@query(
    "features_binned_entropy",
    sql(
        """select panel_id, ts, series_id || '__binned_entropy__max_bins_10' as feature,
                  round(sum(-share * ln(share)), 6) + 0.0 as value from b group by panel_id, series_id, ts""",
        "f1m",
        **roll_sql("f1m"),
        b=_BINS,
    ),
)
def features_binned_entropy(spark, d):
    return _columns(warehouse.scaled_orders(spark, d), {"binned_entropy": calc.ARRAY["binned_entropy"]})


_CORRIDOR_CALCS = {}
for _i, _lo in enumerate(calc.CORRIDOR[:-1]):
    for _hi in calc.CORRIDOR[_i + 1 :]:
        for _abs in (False, True):
            for _f in ("mean", "var"):
                _in = f"v between q{int(_lo * 10)} and q{int(_hi * 10)} and l1 between q{int(_lo * 10)} and q{int(_hi * 10)}"
                _step = "abs(v - l1)" if _abs else "v - l1"
                _agg = "avg" if _f == "mean" else "var_pop"
                _CORRIDOR_CALCS[label("change_quantiles", ql=_lo, qh=_hi, isabs=_abs, f_agg=_f)] = (
                    f"case when max(q{int(_lo * 10)}) = max(q{int(_hi * 10)}) then 0 "
                    f"else coalesce({_agg}(case when {_in} then {_step} end), 0) end"
                )
_CORRIDOR_ROWS = (
    "select roll.*, "
    + ", ".join(f"q{int(q * 10)}" for q in calc.CORRIDOR)
    + " from roll join (select panel_id, series_id, ts, "
    + ", ".join(f"quantile_cont(v, {q}) as q{int(q * 10)}" for q in calc.CORRIDOR)
    + " from roll group by all) using (panel_id, series_id, ts)"
)


@query(
    "features_change_quantiles",
    sql(long_sql(_CORRIDOR_CALCS, source="r"), "f1m", **roll_sql("f1m"), r=_CORRIDOR_ROWS),
)
def features_change_quantiles(spark, d):
    return _columns(warehouse.scaled_orders(spark, d), {"change_quantiles": calc.ARRAY["change_quantiles"]})


_ACF = """select a.panel_id, a.series_id, a.ts, cast(b.i - a.i as bigint) as k,
        sum((a.v - a.mu) * (b.v - b.mu)) / (max(a.n) - (b.i - a.i)) / max(a.sd * a.sd) as r
    from roll a join roll b on b.panel_id = a.panel_id and b.series_id = a.series_id and b.ts = a.ts and b.i >= a.i and b.i - a.i <= 40
    where a.sd > 0 group by a.panel_id, a.series_id, a.ts, b.i - a.i"""


@query(
    "features_autocorrelation",
    sql(
        """select f.panel_id, f.ts, f.series_id || '__autocorrelation__lag_' || f.k as feature, round(a.r, 6) + 0.0 as value
           from (select distinct panel_id, series_id, ts, unnest(range(10)) as k from roll) f left join acf a using (panel_id, series_id, ts, k)
           union all
           select f.panel_id, f.ts, f.series_id || '__agg_autocorrelation__f_agg_"' || unnest(['mean', 'median', 'var']) || '"__maxlag_40',
                  round(coalesce(unnest([m, md, vr]), 0), 6) + 0.0
           from (select distinct panel_id, series_id, ts from roll) f
           left join (select panel_id, series_id, ts, avg(r) as m, quantile_cont(r, 0.5) as md, var_pop(r) as vr
                      from acf where k >= 1 group by all) a using (panel_id, series_id, ts)""",
        "f1m",
        **roll_sql("f1m"),
        acf=_ACF,
    ),
)
def features_autocorrelation(spark, d):
    picks = ("autocorrelation", "agg_autocorrelation")
    return _columns(warehouse.scaled_orders(spark, d), {k: calc.ARRAY[k] for k in picks})


_DIGITS = """select r.panel_id, r.series_id, r.ts, d.d, log10(1 + cast(1 as double) / d.d) as law,
        count_if(cast(left(ltrim(cast(abs(r.v) as varchar), '0.'), 1) as int) = d.d) / cast(max(r.n) as double) as share
    from roll r, (select unnest(range(1, 10)) as d) d group by r.panel_id, r.series_id, r.ts, d.d"""


@query(
    "features_benford",
    sql(
        """select panel_id, ts, series_id || '__benford_correlation' as feature, round(corr(share, law), 6) + 0.0 as value
           from g group by panel_id, series_id, ts""",
        "f3",
        **roll_sql("f3"),
        g=_DIGITS,
    ),
)
def features_benford(spark, d):
    return _columns(warehouse.events_by_user(spark, d), {"benford_correlation": calc.ARRAY["benford_correlation"]})


# --- order statistics of long series ------------------------------------------------------------------------

QUARTILES = (0.25, 0.5, 0.75)


def _event_series(spark, d) -> DataFrame:
    """The values of each event type in the order of their ids, a day for each id."""
    events = warehouse.table(spark, d, "events").where("value is not null")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("event_id").cast("int"))
    return events.select(F.lit("all").alias("panel_id"), F.col("event_type").alias("series_id"), day.alias("ts"), VALUE)


_EVENT_SERIES = "select event_type as series_id, date '1970-01-01' + cast(event_id as int) as ts, value from events where value is not null"


def _order_sql(frame: str) -> str:
    picks = ", ".join(f"round(quantile_cont(value, {q}) over w, 6) + 0.0 as q{int(q * 100)}" for q in QUARTILES)
    window = f"window w as (partition by series_id order by ts rows between {frame} preceding and current row)"
    return f"select 'all' as panel_id, series_id, ts, {picks} from ({_EVENT_SERIES}) {window}"


def _quartiles(spark, d, max_shift: int | None = None) -> DataFrame:
    rows = _event_series(spark, d)
    found = ranks.frame_quantiles(rows, ["panel_id", "series_id"], QUARTILES, max_shift=max_shift, max_rows=max(2, rows.count()))
    picks = [tidy(F.get("quantiles", F.lit(i)), 6).alias(f"q{int(q * 100)}") for i, q in enumerate(QUARTILES)]
    return found.select("panel_id", "series_id", "ts", *picks)


@query("order_statistics_long", _order_sql("unbounded"))
def order_statistics_long(spark, d):
    return _quartiles(spark, d)


@query("order_statistics_long_rolling", _order_sql("999"))
def order_statistics_long_rolling(spark, d):
    return _quartiles(spark, d, 999)


# --- recursions and patterns -----------------------------------------------------------------------------------

_COVARIANCES = """select panel_id, series_id, ts, any_value(n) as n, list(c order by k) as c from
    (select a.panel_id, a.series_id, a.ts, any_value(a.n) as n, b.i - a.i as k,
            sum((a.v - a.mu) * (b.v - b.mu)) / (any_value(a.n) - (b.i - a.i)) as c
     from roll a join roll b on b.panel_id = a.panel_id and b.series_id = a.series_id and b.ts = a.ts and b.i >= a.i and b.i - a.i <= 9
     group by a.panel_id, a.series_id, a.ts, b.i - a.i) group by panel_id, series_id, ts having any_value(n) > 3"""
_LEVINSON = """select panel_id, series_id, ts, n, c, 0 as k, []::double[] as phi, c[1] as err, [1.0]::double[] as res from cov where c[1] > 0
    union all
    select panel_id, series_id, ts, n, c, k + 1, list_transform(list_zip(phi, list_reverse(phi)), lambda p: p[1] - r * p[2]) || [r],
           err * (1 - r * r), res || [r]
    from (select *, (c[k + 2] - coalesce(list_sum(list_transform(list_zip(phi, list_reverse(c[2:k + 1])), lambda p: p[1] * p[2])), 0)) / err as r
          from levinson where k + 1 <= least(9, n // 2 - 1))"""


@query(
    "features_partial_autocorrelation",
    sql(
        """select panel_id, ts, series_id || '__partial_autocorrelation__lag_' || g.lag as feature, round(l.res[g.lag + 1], 6) + 0.0 as value
           from (select distinct panel_id, series_id, ts, unnest(range(10)) as lag from roll) g
           left join (select panel_id, series_id, ts, arg_max(res, k) as res from levinson group by 1, 2, 3) l using (panel_id, series_id, ts)""",
        "f1m",
        **roll_sql("f1m"),
        cov=_COVARIANCES,
        levinson=_LEVINSON,
    ).replace("with ", "with recursive ", 1),
)
def features_partial_autocorrelation(spark, d):
    picks = {"partial_autocorrelation": calc.RECURSIVE["partial_autocorrelation"]}
    return _columns(warehouse.scaled_orders(spark, d), picks)


@query("features_autoregression")
def features_autoregression(spark, d):
    return _columns(warehouse.scaled_orders(spark, d), {"ar_coefficient": calc.RECURSIVE["ar_coefficient"]})


def _patterns_sql(shift: int | None) -> dict[str, str]:
    """Order patterns of the last k values of each row, and how often each stands in a frame."""
    first = "" if shift is None else f" and b.rn - d.k + 1 >= a.rn - {shift}"
    return {
        "w": """select panel_id, series_id, rn, k, list(value) over (partition by panel_id, series_id, k order by rn rows between 6 preceding and current row) as x
                from p, (select unnest([3, 4, 5, 6, 7]) as k)""",
        "pat": """select panel_id, series_id, rn, k, array_to_string(list_transform(range(1, k + 1), lambda i:
                         len(list_filter(range(i + 1, k + 1), lambda j: y[j] < y[i]))), ',') as code
                  from (select *, x[-k:] as y from w where len(x) >= k)""",
        "cnt": f"""select a.panel_id, a.series_id, a.ts, d.k, b.code, count(*) as c
                   from p a join pat b on b.panel_id = a.panel_id and b.series_id = a.series_id and b.rn <= a.rn
                   join (select unnest([3, 4, 5, 6, 7]) as k) d on d.k = b.k where true{first} group by 1, 2, 3, 4, 5""",
        "ent": """select panel_id, series_id, ts, k, -sum(c / m * ln(c / m)) as h
                  from (select *, sum(c) over (partition by panel_id, series_id, ts, k) as m from cnt) group by 1, 2, 3, 4""",
    }


_ENTROPY_SQL = """select g.panel_id, g.ts, g.series_id || '__permutation_entropy__dimension_' || g.k || '__tau_1' as feature,
                         case when e.h is not null then round(greatest(e.h, 0), 6) + 0.0 end as value
                  from (select panel_id, series_id, ts, unnest([3, 4, 5, 6, 7]) as k from p) g left join ent e using (panel_id, series_id, ts, k)"""


@query("features_permutation_entropy", sql(_ENTROPY_SQL, "f1m", p=roll_sql("f1m")["p"], **_patterns_sql(None)))
def features_permutation_entropy(spark, d):
    return _columns(warehouse.scaled_orders(spark, d), {"permutation_entropy": calc.RECURSIVE["permutation_entropy"]})


@query("features_permutation_entropy_rolling", sql(_ENTROPY_SQL, "f2m", p=roll_sql("f2m")["p"], **_patterns_sql(ROLL_SHIFT)))
def features_permutation_entropy_rolling(spark, d):
    return _columns(warehouse.scaled_nations(spark, d), {"permutation_entropy": calc.RECURSIVE["permutation_entropy"]}, ROLL_SHIFT)


_FOURIER = """select panel_id, series_id, ts, k, sum(v * cos(2 * pi() * k * i / n)) as re, -sum(v * sin(2 * pi() * k * i / n)) as im
              from roll, (select unnest(range(100)) as k) where k <= n // 2 group by 1, 2, 3, 4"""


@query(
    "features_fourier_rolling",
    sql(
        """select panel_id, ts, series_id || '__fft_coefficient__attr_"' || unnest(['real', 'imag', 'abs']) || '"__coeff_' || k as feature,
                  round(unnest([re, im, sqrt(re * re + im * im)]), 6) + 0.0 as value
           from (select distinct panel_id, series_id, ts, unnest(range(100)) as k from roll) left join z using (panel_id, series_id, ts, k)""",
        "f1m",
        **roll_sql("f1m", ROLL_SHIFT),
        z=_FOURIER,
    ),
)
def features_fourier_rolling(spark, d):
    """Angles are left out: of a coefficient of 0 they are noise."""
    found = _columns(warehouse.scaled_orders(spark, d), {"fft_coefficient": calc.SPECTRAL["fft_coefficient"]}, ROLL_SHIFT)
    return found.where(~F.col("feature").contains("angle"))


_SPECTRAL_MOMENTS = """select *, m2 - m1 * m1 as v from (select panel_id, series_id, ts, sum(y * k) / sum(y) as m1, sum(y * k * k) / sum(y) as m2,
            sum(y * pow(k, 3)) / sum(y) as m3, sum(y * pow(k, 4)) / sum(y) as m4
     from (select *, sqrt(re * re + im * im) as y from z) group by 1, 2, 3)"""


@query(
    "features_spectral_moments_rolling",
    sql(
        """select panel_id, ts, series_id || '__fft_aggregated__aggtype_"' || unnest(['centroid', 'variance', 'skew', 'kurtosis']) || '"' as feature,
                  round(unnest([m1, v, case when v >= 0.5 then (m3 - 3 * m1 * v - pow(m1, 3)) / pow(v, 1.5) end,
                                case when v >= 0.5 then (m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * m1) / (v * v) end]), 6) + 0.0 as value from m""",
        "f1m",
        **roll_sql("f1m", 35),
        z=_FOURIER,
        m=_SPECTRAL_MOMENTS,
    ),
)
def features_spectral_moments_rolling(spark, d):
    return _columns(warehouse.scaled_orders(spark, d), {"fft_aggregated": calc.SPECTRAL["fft_aggregated"]}, 35)


@query("features_numpy")
def features_numpy(spark, d):
    _, names = features.calculators_for("efficient")
    return rounded(features.extract_arrays(warehouse.scaled_orders(spark, d), names))


@query("features_entropy_costly")
def features_entropy_costly(spark, d):
    names = ["approximate_entropy", "sample_entropy"]
    return rounded(features.extract_arrays(warehouse.scaled_orders(spark, d), names))


@query("extract_comprehensive")
def extract_comprehensive(spark, d):
    return rounded(features.extract(warehouse.scaled_orders(spark, d), "comprehensive"))


# --- the flagship: grid, split, standardise, difference, expanding features -------------------


_FLAGSHIP_STEPS = {
    "g": month_grid_sql("f1"),
    "s": split_sql("g"),
    "z": _Z,
    "dd": "select panel_id, series_id, ts, split, value - lag(value) over (partition by panel_id, series_id, split order by ts) as value from z",
}


@query(
    "flagship",
    sql(long_sql(MINIMAL_SQL, _SPLIT_KEYS), "f1", **_FLAGSHIP_STEPS, **roll_sql("dd", keys=_SPLIT_KEYS)),
)
def flagship(spark, d):
    panel = split.chrono_split(month_grid(warehouse.orders_by_priority(spark, d)))
    scaled = transform.standardise(panel)
    changes = transform.difference(scaled, keys=("panel_id", "series_id", "split"))
    return rounded(features.extract(changes, "minimal"))

"""Queries over sources, alignment, split, cleaning, transforms and stationarity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalar import day_number, log100, tidy, to_number
from tidepanel.keys import PANEL, SERIES, TS, VALUE
from tidepanel.operators import align, clean, impute, split, stationarity, transform
from tidepanel.plans import prepare as prepare_plan
from tidepanel.plans.config import PrepareConfig
from tidepanel.queries.panels_sql import month_grid_sql, split_sql, sql
from tidepanel.session import ensure_checkpoint_dir
from tidepanel.sources import panel_io, warehouse
from tidepanel.sources.catalog import make_catalog

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
BLOCK_DAYS = 180
W = "partition by panel_id, series_id order by ts"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c), digits) for c in columns or (VALUE,)})


# --- sources and alignment ---------------------------------------------------------


@query(
    "series_load",
    sql("select * from f1 where ts >= date '1996-01-01' and ts <= date '1999-12-31'", "f1"),
)
def series_load(spark, d):
    panel = warehouse.orders_by_priority(spark, d, start="1996-01-01", end="1999-12-31")
    return panel_io.select_observations(panel_io.normalise(panel), start="1996-01-01", end="1999-12-31")


@query(
    "resample_freq",
    sql(
        """select panel_id, series_id, cast(date_trunc('quarter', ts) as date) as ts,
                  round(avg(value), 3) + 0.0 as value from f2 group by 1, 2, 3""",
        "f2",
    ),
)
def resample_freq(spark, d):
    return rounded(align.resample(warehouse.orders_by_nation(spark, d), "q"), 3)


@query(
    "resample_last",
    sql(
        """select panel_id, series_id, cast(date_trunc('month', ts) as date) as ts, arg_max(value, ts) as value
           from f3 group by panel_id, series_id, cast(date_trunc('month', ts) as date)""",
        "f3",
    ),
)
def resample_last(spark, d):
    return align.resample(warehouse.events_by_user(spark, d), "m", "last")


@query(
    "resample_catalog",
    sql(
        """select panel_id, series_id, cast(case series_id when 'yield_d' then ts when 'output_q' then date_trunc('quarter', ts)
                  else date_trunc('month', ts) end as date) as ts, round(avg(value), 3) + 0.0 as value
           from f4 group by panel_id, series_id, cast(case series_id when 'yield_d' then ts
                  when 'output_q' then date_trunc('quarter', ts) else date_trunc('month', ts) end as date)""",
        "f4",
    ),
)
def resample_catalog(spark, d):
    catalog = make_catalog(spark, warehouse.MIXED_SERIES, daily=["yield_d"], quarterly=["output_q"])
    return rounded(align.resample_by_catalog(warehouse.mixed_frequencies(spark, d), catalog), 3)


@query(
    "missing_series",
    sql(
        """select series_id, cast(case when series_id in (select series_id from f4) then 1 else 0 end as bigint) as present
           from (values ('spend_m'), ('price_m'), ('count_m'), ('output_q'), ('yield_d'), ('rate_m'), ('index_q')) c(series_id)""",
        "f4",
    ),
)
def missing_series(spark, d):
    catalog = make_catalog(spark, (*warehouse.MIXED_SERIES, "rate_m", "index_q"))
    present, missing = align.keep_present(warehouse.mixed_frequencies(spark, d), catalog)
    mark = lambda df, v: df.select(SERIES, F.lit(v).cast("bigint").alias("present"))
    return mark(present, 1).unionByName(mark(missing, 0))


@query(
    "outer_align",
    sql(
        "select panel_id, ts, "
        + ", ".join(f"max(case when series_id = '{s}' then value end) as {s}" for s in warehouse.MIXED_SERIES)
        + " from f4 group by 1, 2",
        "f4",
    ),
)
def outer_align(spark, d):
    return align.to_wide(warehouse.mixed_frequencies(spark, d), warehouse.MIXED_SERIES)


@query("asfreq_grid", sql("select * from g", "f4", g=month_grid_sql("f4")))
def asfreq_grid(spark, d):
    return align.month_grid(warehouse.mixed_frequencies(spark, d))


@query("asfreq_grid_panels", sql("select * from g", "f2", g=month_grid_sql("f2")))
def asfreq_grid_panels(spark, d):
    return align.month_grid(warehouse.orders_by_nation(spark, d))


@query("csv_roundtrip", sql("select * from f2", "f2"))
def csv_roundtrip(spark, d):
    folder = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    panel_io.write_panel(warehouse.orders_by_nation(spark, d), folder, fmt="csv")
    return panel_io.read_panel(spark, folder, fmt="csv")


# --- split, projection, predicates ---------------------------------------------------


@query(
    "target_split",
    sql("select *, case when series_id = 'BUILDING' then 'target' else 'predictor' end as role from f2", "f2"),
)
def target_split(spark, d):
    return split.with_role(warehouse.orders_by_nation(spark, d), "BUILDING")


@query("chrono_split", sql("select * from s", "f2", s=split_sql("f2")))
def chrono_split(spark, d):
    return split.chrono_split(warehouse.orders_by_nation(spark, d))


_WIDE = ", ".join(f"max(case when series_id = '{s}' then value end) as {s}" for s in SEGMENTS)


@query("combine_xy", sql(f"select panel_id, ts, {_WIDE} from f2 group by 1, 2", "f2"))
def combine_xy(spark, d):
    panel = warehouse.orders_by_nation(spark, d)
    x = align.to_wide(split.predictors(panel, "BUILDING"), [s for s in SEGMENTS if s != "BUILDING"])
    y = align.to_wide(split.only_target(panel, "BUILDING"), ["BUILDING"])
    return split.combine_wide(x, y).select(PANEL, TS, *SEGMENTS)


@query(
    "dropna_rows",
    sql(
        "select * from w where " + " and ".join(f"{s} is not null" for s in SEGMENTS),
        "f2",
        w=f"select panel_id, ts, {_WIDE} from f2 group by 1, 2",
    ),
)
def dropna_rows(spark, d):
    return split.drop_incomplete_rows(align.to_wide(warehouse.orders_by_nation(spark, d), SEGMENTS), SEGMENTS)


_QUARTERS = """select panel_id, series_id, cast(date_trunc('quarter', ts) as date) as ts, round(avg(value), 3) + 0.0 as value
    from f2 group by 1, 2, 3"""
_COMPLETE = """select a.panel_id, {a} a.series_id as feature from {src} a
    join (select panel_id, {split} count(distinct ts) as dates from {src} group by all) n on n.panel_id = a.panel_id {on}
    group by all having count(a.value) = count(*) and count(*) = any_value(n.dates)"""


def _as_features(panel: DataFrame) -> DataFrame:
    return panel.withColumnRenamed(SERIES, "feature")


@query(
    "dropna_cols",
    sql(
        """select g.panel_id, g.series_id as feature, g.ts, g.value from g
           join c on c.panel_id = g.panel_id and c.feature = g.series_id""",
        "f2",
        g=_QUARTERS,
        c=_COMPLETE.format(a="", split="", on="", src="g"),
    ),
)
def dropna_cols(spark, d):
    quarters = _as_features(rounded(align.resample(warehouse.orders_by_nation(spark, d), "q"), 3))
    return split.drop_incomplete_features(quarters).select(PANEL, "feature", TS, VALUE)


@query(
    "candidate_set",
    sql(
        """select panel_id, feature from c where split = 'train' and feature <> 'BUILDING'
           intersect select panel_id, feature from c where split = 'test'""",
        "f2",
        g=_QUARTERS,
        s=split_sql("g"),
        c=_COMPLETE.format(a="a.split,", split="split,", on="and n.split = a.split", src="s"),
    ),
)
def candidate_set(spark, d):
    parted = _as_features(split.chrono_split(align.resample(warehouse.orders_by_nation(spark, d), "q")))
    complete = split.complete_features(parted, (PANEL, "split"))
    added = parted.where(F.col("feature") == "BUILDING").select(PANEL, "feature").distinct()
    return split.candidate_features(
        complete.where(F.col("split") == "train"), complete.where(F.col("split") == "test"), added
    )


@query(
    "assign_feature",
    sql(
        """select w.*, c.value as count_of_orders from
             (select panel_id, ts, max(case when series_id = 'spend_m' then value end) as spend_m,
                     max(case when series_id = 'price_m' then value end) as price_m
              from f4 where series_id in ('spend_m', 'price_m') group by 1, 2) w
           left join f4 c on c.panel_id = w.panel_id and c.ts = w.ts and c.series_id = 'count_m'""",
        "f4",
    ),
)
def assign_feature(spark, d):
    panel = warehouse.mixed_frequencies(spark, d)
    wide = align.to_wide(panel.where(F.col(SERIES).isin("spend_m", "price_m")), ["spend_m", "price_m"])
    features = _as_features(panel).withColumn(
        "feature", F.when(F.col("feature") == "count_m", "count_of_orders").otherwise(F.col("feature"))
    )
    return split.assign_feature(wide, features, "count_of_orders")


# --- cleaning ---------------------------------------------------------------------------


def _daily(spark, d) -> DataFrame:
    return align.day_grid(warehouse.events_by_user(spark, d))


_DAY_GRID = """
    select s.panel_id, s.series_id, g.ts, p.value
    from (select distinct panel_id, series_id from f3) s
    join (select panel_id, cast(unnest(generate_series(cast(min(ts) as timestamp), cast(max(ts) as timestamp),
                 interval 1 day)) as date) as ts from f3 group by panel_id) g on g.panel_id = s.panel_id
    left join f3 p on p.panel_id = s.panel_id and p.series_id = s.series_id and p.ts = g.ts"""

_BFILL = sql(
    f"select panel_id, series_id, ts, first_value(value ignore nulls) over "
    f"({W} rows between current row and unbounded following) as value from g",
    "f3",
    g=_DAY_GRID,
)
_FFILL = sql(
    f"select panel_id, series_id, ts, last_value(value ignore nulls) over "
    f"({W} rows between unbounded preceding and current row) as value from g",
    "f3",
    g=_DAY_GRID,
)
_LINEAR = sql(
    """select panel_id, series_id, ts, round(case when value is not null then value when a is null then null
              when b is null then va else va + (vb - va) * (cast(rn - a as double) / (b - a)) end, 6) + 0.0 as value
       from k""",
    "f3",
    g=_DAY_GRID,
    n=f"select *, row_number() over ({W}) as rn from g",
    k=f"""select *, max(case when value is not null then rn end) over ({W} rows between unbounded preceding and current row) as a,
                 min(case when value is not null then rn end) over ({W} rows between current row and unbounded following) as b,
                 last_value(value ignore nulls) over ({W} rows between unbounded preceding and current row) as va,
                 first_value(value ignore nulls) over ({W} rows between current row and unbounded following) as vb from n""",
)


@query("bfill", _BFILL)
def bfill(spark, d):
    return clean.backward_fill(_daily(spark, d))


@query("ffill", _FFILL)
def ffill(spark, d):
    return clean.forward_fill(_daily(spark, d))


@query("interp_linear", _LINEAR)
def interp_linear(spark, d):
    return rounded(clean.interpolate_linear(_daily(spark, d)))


@query("bfill_blocked", _BFILL)
def bfill_blocked(spark, d):
    return clean.backward_fill(_daily(spark, d), block_days=7)


@query("ffill_blocked", _FFILL)
def ffill_blocked(spark, d):
    return clean.forward_fill(_daily(spark, d), block_days=7)


@query("interp_linear_blocked", _LINEAR)
def interp_linear_blocked(spark, d):
    return rounded(clean.interpolate_linear(_daily(spark, d), block_days=7))


@query(
    "to_numeric",
    """select cast(event_id as bigint) as event_id,
              try_cast(regexp_extract(props, '([0-9]+)', 1) as double) as digits,
              cast(null as double) as text_value,
              case when event_id % 3 = 0 then null when event_id % 3 = 1 then null else value end as coerced
       from events""",
)
def to_numeric(spark, d):
    bad = F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit("n/a")).when(F.pmod("event_id", F.lit(3)) == 1, F.lit("inf"))
    return warehouse.table(spark, d, "events").select(
        F.col("event_id").cast("bigint"),
        to_number(F.regexp_extract("props", "([0-9]+)", 1)).alias("digits"),
        to_number(F.col("event_type")).alias("text_value"),
        to_number(F.coalesce(bad, F.col("value").cast("string"))).alias("coerced"),
    )


@query(
    "clean_series",
    sql(
        f"""select panel_id, series_id, ts, coalesce(
                first_value(v ignore nulls) over ({W} rows between current row and unbounded following),
                last_value(v ignore nulls) over ({W} rows between unbounded preceding and current row)) as value
            from (select *, case when value > 100 then null else value end as v from g)""",
        "f3",
        g=_DAY_GRID,
    ),
)
def clean_series(spark, d):
    # Values above 100 stand in for the infinities a division would have left.
    spiked = _daily(spark, d).withColumn(VALUE, F.when(F.col(VALUE) > 100, float("inf")).otherwise(F.col(VALUE)))
    return clean.clean_series(spiked)


_CAP = """select panel_id, series_id, ts, split,
         round(case when split = 'test' then value when value > q3 + {k} * (q3 - q1) then q3 + {k} * (q3 - q1)
                    when value < q1 - {k} * (q3 - q1) then q1 - {k} * (q3 - q1) else value end, 6) + 0.0 as value
       from s join (select panel_id, series_id, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
                    from s where split = 'train' group by 1, 2) b using (panel_id, series_id)"""


@query("cap_outliers", sql(_CAP.format(k="cast(3.0 as double)"), "f3", s=split_sql("f3")))
def cap_outliers(spark, d):
    return rounded(clean.cap_outliers(split.chrono_split(warehouse.events_by_user(spark, d))))


@query("cap_outliers_tight", sql(_CAP.format(k="cast(0.5 as double)"), "f3", s=split_sql("f3")))
def cap_outliers_tight(spark, d):
    return rounded(clean.cap_outliers(split.chrono_split(warehouse.events_by_user(spark, d)), cap_factor=0.5))


# --- spline -------------------------------------------------------------------------------


@query("spline_impute")
def spline_impute(spark, d):
    panel = split.chrono_split(align.month_grid(warehouse.mixed_frequencies(spark, d)))
    return rounded(impute.spline_impute(panel, series=["output_q", "yield_d"]), 3)


# A cubic in the day number, known on the dates a nation's segment has orders: the
# spline must give the cubic back everywhere, the ends included.
_T = "((date_diff('day', date '1998-06-01', ts)) / cast(1000 as double))"
_CUBIC = "round(2 + 3 * {t} - {t} * {t} + 0.5237 * {t} * {t} * {t}, 6) + 0.0"
_SPLINE = sql(
    f"select panel_id, series_id, ts, {_CUBIC.format(t=_T)} as value from g",
    "f2",
    g=month_grid_sql("f2"),
)


def _cubic_with_gaps(spark, d) -> DataFrame:
    grid = align.month_grid(warehouse.orders_by_nation(spark, d))
    t = F.date_diff(F.col(TS), F.lit("1998-06-01").cast("date")) / F.lit(1000.0)
    cubic = F.lit(2.0) + 3 * t - t * t + 0.5237 * t * t * t
    gap = F.col(VALUE).isNull() | (F.month(TS) % 4 != 1)
    return grid.withColumn(VALUE, F.when(~gap, cubic))


@query("spline_cubic", _SPLINE)
def spline_cubic(spark, d):
    return rounded(impute.spline_impute(_cubic_with_gaps(spark, d)))


@query("spline_cubic_blocked", _SPLINE)
def spline_cubic_blocked(spark, d):
    return rounded(impute.spline_impute(_cubic_with_gaps(spark, d), block_days=365))


@query(
    "day_ordinal",
    sql("select panel_id, series_id, ts, cast(date_diff('day', date '0001-01-01', ts) + 1 as bigint) as ordinal from f3", "f3"),
)
def day_ordinal(spark, d):
    return warehouse.events_by_user(spark, d).select(
        PANEL, SERIES, TS, day_number(F.col(TS)).cast("bigint").alias("ordinal")
    )


# --- scalar and scaling transforms -----------------------------------------------------------


@query(
    "deflate",
    sql(
        """select p.panel_id, p.series_id, p.ts, round(case when p.series_id in ('spend_m', 'output_q')
                  then p.value / nullif(i.value, 0) * 100 else p.value end, 3) + 0.0 as value
           from g p left join g i on i.panel_id = p.panel_id and i.ts = p.ts and i.series_id = 'price_m'""",
        "f4",
        g=month_grid_sql("f4"),
    ),
)
def deflate(spark, d):
    panel = align.month_grid(warehouse.mixed_frequencies(spark, d))
    return rounded(transform.deflate(panel, "price_m", ["spend_m", "output_q"], check=False), 3)


@query(
    "log100",
    sql(
        "select panel_id, series_id, ts, round(case when value - 50 > 0 then 100 * ln(value - 50) end, 6) + 0.0 as value from f3",
        "f3",
    ),
)
def log_100(spark, d):
    return rounded(warehouse.events_by_user(spark, d).withColumn(VALUE, log100(F.col(VALUE) - 50)))


def _mixed_catalog(spark) -> DataFrame:
    """Frequencies and roles of the mixed series, and of one that has no data."""
    return make_catalog(
        spark,
        (*warehouse.MIXED_SERIES, "rate_m"),
        daily=["yield_d"],
        quarterly=["output_q"],
        nominal=["spend_m", "output_q", "rate_m"],
        log=["spend_m", "output_q", "count_m"],
        spline=["output_q", "yield_d"],
    )


@query(
    "deflate_and_log_by_catalog",
    sql(
        """select panel_id, series_id, ts, round(case when series_id in ('spend_m', 'output_q', 'count_m')
                  then case when v > 0 then 100 * ln(v) end else v end, 3) + 0.0 as value
           from (select p.panel_id, p.series_id, p.ts, case when p.series_id in ('spend_m', 'output_q')
                        then p.value / nullif(i.value, 0) * 100 else p.value end as v
                 from g p left join g i on i.panel_id = p.panel_id and i.ts = p.ts and i.series_id = 'price_m')""",
        "f4",
        g=month_grid_sql("f4"),
    ),
)
def deflate_and_log_by_catalog(spark, d):
    """The roles are joined from the catalog, which may be as long as there are series."""
    roles = prepare_plan.roles(_mixed_catalog(spark))
    panel = align.month_grid(warehouse.mixed_frequencies(spark, d))
    deflated = transform.deflate(panel, "price_m", roles["nominal"], check=False)
    return rounded(transform.log_transform(deflated, roles["logged"]), 3)


@query(
    "skipped_series",
    sql(
        """select series_id from (values ('spend_m'), ('price_m'), ('count_m'), ('output_q'), ('yield_d'), ('rate_m')) c(series_id)
           where series_id not in (select series_id from f4 where value is not null and ts >= date '1995-01-01' and ts < date '1996-01-01')""",
        "f4",
    ),
)
def skipped_series(spark, d):
    panel = warehouse.mixed_frequencies(spark, d)
    return prepare_plan.load_reported(panel, _mixed_catalog(spark), "output_q", start="1995-01-01", end="1995-12-31")[1]


@query("prepare_choices")
def prepare_choices(spark, d):
    """The transform chosen for each series and split, with its statistic, after the whole preparation."""
    cfg = PrepareConfig(target="output_q", deflator="price_m")
    done = prepare_plan.prepare(warehouse.mixed_frequencies(spark, d), _mixed_catalog(spark), cfg)
    return rounded(done.choices, 6, "adf_stat")


_Z = """select s.panel_id, s.series_id, s.ts, s.split,
               (s.value - m) / case when sd = 0 then 1 else sd end as value
        from s join (select panel_id, series_id, avg(value) as m, stddev_pop(value) as sd
                     from s where split = 'train' group by 1, 2) f
          on f.panel_id = s.panel_id and f.series_id = s.series_id"""


@query("zscore_train_fit", sql(f"select * replace (round(value, 6) + 0.0 as value) from ({_Z})", "f2", s=split_sql("f2")))
def zscore_train_fit(spark, d):
    return rounded(transform.standardise(split.chrono_split(warehouse.orders_by_nation(spark, d))))


_PCT = sql(
    f"""select panel_id, series_id, ts, round((v - p) / nullif(p, 0), 6) + 0.0 as value from
        (select *, lag(v) over ({W}) as p from
          (select panel_id, series_id, ts, last_value(value ignore nulls) over
             ({W} rows between unbounded preceding and current row) as v from g))""",
    "f3",
    g=_DAY_GRID,
)


@query("pct_change", _PCT)
def pct_change(spark, d):
    return rounded(transform.percent_change(_daily(spark, d)))


@query("pct_change_blocked", _PCT)
def pct_change_blocked(spark, d):
    return rounded(transform.percent_change(_daily(spark, d), block_days=7))


_DIFF = sql(f"select panel_id, series_id, ts, round(value - lag(value) over ({W}), 2) + 0.0 as value from f2", "f2")


@query("diff1", _DIFF)
def diff1(spark, d):
    return rounded(transform.difference(warehouse.orders_by_nation(spark, d)), 2)


@query("diff1_blocked", _DIFF)
def diff1_blocked(spark, d):
    return rounded(transform.difference(warehouse.orders_by_nation(spark, d), block_days=BLOCK_DAYS), 2)


def _full(agg: str, n: int) -> str:
    frame = f"over ({W} rows between {n - 1} preceding and current row)"
    return f"case when count(value) {frame} = {n} then {agg}(value) {frame} end"


@query("rolling_mean", sql(f"select panel_id, series_id, ts, round({_full('avg', 7)}, 8) + 0.0 as rolling_mean from f2m", "f2m"))
def rolling_mean(spark, d):
    out = transform.rolling(warehouse.scaled_nations(spark, d), window=7)
    return rounded(out.drop(VALUE), 8, "rolling_mean")


_DETREND = sql(f"select panel_id, series_id, ts, round(value - {_full('avg', 7)}, 8) + 0.0 as value from f2m", "f2m")
_DETREND_DIFF = sql(
    f"""select panel_id, series_id, ts, round(v - lag(v) over ({W}), 8) + 0.0 as value
        from (select *, value - {_full('avg', 7)} as v from f2m)""",
    "f2m",
)


@query("rolling_detrend", _DETREND)
def rolling_detrend(spark, d):
    return rounded(transform.detrend(warehouse.scaled_nations(spark, d)), 8)


@query("rolling_detrend_diff", _DETREND_DIFF)
def rolling_detrend_diff(spark, d):
    return rounded(transform.detrend(warehouse.scaled_nations(spark, d), then_difference=True), 8)


@query("rolling_detrend_diff_blocked", _DETREND_DIFF)
def rolling_detrend_diff_blocked(spark, d):
    panel = warehouse.scaled_nations(spark, d)
    return rounded(transform.detrend(panel, then_difference=True, block_days=BLOCK_DAYS), 8)


@query(
    "rolling_stats",
    sql(
        f"""select panel_id, series_id, ts, value, round({_full('avg', 12)}, 10) + 0.0 as rolling_mean,
                   round({_full('stddev_samp', 12)}, 10) + 0.0 as rolling_std from f2m""",
        "f2m",
    ),
)
def rolling_stats(spark, d):
    out = transform.rolling(warehouse.scaled_nations(spark, d), window=12, std="rolling_std")
    return rounded(out, 10, "rolling_mean", "rolling_std")


# --- stationarity ---------------------------------------------------------------------------------


def _lag0_sql(dy: str, x: str) -> str:
    b = f"regr_slope({dy}, {x})"
    sse = f"(regr_syy({dy}, {x}) - {b} * regr_sxy({dy}, {x}))"
    n = f"regr_count({dy}, {x})"
    return (
        f"case when {n} > 2 and regr_sxx({dy}, {x}) > 0 and {sse} > regr_syy({dy}, {x}) * 1e-12 "
        f"then {b} / sqrt({sse} / ({n} - 2) / regr_sxx({dy}, {x})) end"
    )


_DF0 = sql(
    f"select panel_id, series_id, round({_lag0_sql('value - x', 'x')}, 6) + 0.0 as adf_stat "
    f"from (select *, lag(value) over ({W}) as x from f2m) group by 1, 2",
    "f2m",
)


@query("df_lag0", _DF0)
def df_lag0(spark, d):
    return rounded(stationarity.lag0(warehouse.scaled_nations(spark, d)), 6, "adf_stat")


@query("df_lag0_blocked", _DF0)
def df_lag0_blocked(spark, d):
    return rounded(stationarity.lag0(warehouse.scaled_nations(spark, d), block_days=BLOCK_DAYS), 6, "adf_stat")


@query(
    "adf_lag1",
    sql(
        f"""select panel_id, series_id, round(bx / sqrt((yy - bx * xy - bz * zy) / (n - 3) * zz / det), 6) + 0.0 as adf_stat
            from (select *, (xy * zz - zy * xz) / det as bx, (zy * xx - xy * xz) / det as bz from
                   (select *, xx * zz - xz * xz as det from
                     (select panel_id, series_id, cast(count(*) as double) as n, count(*) * var_pop(x) as xx,
                             count(*) * var_pop(d1) as zz, count(*) * var_pop(dy) as yy, count(*) * covar_pop(x, d1) as xz,
                             count(*) * covar_pop(x, dy) as xy, count(*) * covar_pop(d1, dy) as zy
                      from (select *, lag(dy) over ({W}) as d1 from
                             (select *, value - x as dy from (select *, lag(value) over ({W}) as x from f5)))
                      where d1 is not null group by 1, 2)))""",
        "f5",
    ),
)
def adf_lag1(spark, d):
    return rounded(stationarity.lag1(warehouse.vectors_as_series(spark, d)), 6, "adf_stat")


def _adf_steps(source: str, keys: str = "panel_id, series_id") -> dict[str, str]:
    """Every lag by elimination in the matrix of all products of the rows that all lags have, written out row by
    row; then the lag of least AIC by elimination in the matrix of its own rows. ``adf`` has the results."""
    square = lambda rows, size: (
        f"list_transform(range(1, {size}), lambda a: list_transform(range(1, {size}), lambda b: "
        f"list_sum(list_transform({rows}, lambda r: (r[a] - mu[a]) * (r[b] - mu[b])))))"
    )
    means = lambda rows, size: f"list_transform(range(1, {size}), lambda a: list_avg(list_transform({rows}, lambda r: r[a])))"
    lagged = lambda lag: f"list_transform(range({lag} + 1, n), lambda t: [y[t]] || list_reverse(d[t - {lag}:t - 1]) || [d[t]])"
    less = "m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]"
    return {
        "adf_y": f"""select {keys}, list(value - mu order by ts) as y, cast(count(*) as int) as n
                     from (select *, avg(value) over (partition by {keys}) as mu from {source} where value is not null)
                     group by {keys} having count(*) >= 4 and max(value) > min(value)""",
        "adf_l": """select *, list_transform(range(2, n + 1), lambda i: y[i] - y[i - 1]) as d
                    from (select *, least(cast(ceil(12 * pow(cast(n as double) / 100, 0.25)) as int), n // 2 - 2) as top from adf_y)
                    where top >= 0""",
        "adf_r": f"select *, {lagged('top')} as z from adf_l",
        "adf_g": f"select {keys}, n, top, len(z) as rows, {square('z', 'top + 3')} as m from (select *, {means('z', 'top + 3')} as mu from adf_r)",
        "adf_e": f"""select {keys}, n, top, rows, m, 0 as k, []::double[] as ssr from adf_g union all
                     select {keys}, n, top, rows, next, k + 1, ssr || [next[top + 2][top + 2]]
                     from (select *, list_transform(range(1, top + 3), lambda i: case when i <= k + 1 then m[i] else
                                  list_transform(range(1, top + 3), lambda j: {less}) end) as next from adf_e where k <= top)""",
        "adf_best": f"""select {keys}, cast(list_position(aic, list_min(aic)) - 1 as int) as lag
                        from (select {keys}, list_transform(range(1, top + 2), lambda i: rows * ln(ssr[i] / rows) + 2 * (i + 1)) as aic
                              from adf_e where k = top + 1)""",
        "adf_z": f"select *, {lagged('lag')} as z from adf_l join adf_best using ({keys})",
        "adf_h": f"select {keys}, lag, len(z) as nobs, {square('z', 'lag + 3')} as g from (select *, {means('z', 'lag + 3')} as mu from adf_z)",
        "adf_j": f"""select {keys}, lag, nobs, g, 0 as k, list_transform(range(1, lag + 2), lambda i:
                            g[i][1:lag + 2] || [case when i = 1 then cast(1 as double) else 0 end]) as m from adf_h union all
                     select {keys}, lag, nobs, g, k + 1, list_transform(range(1, lag + 2), lambda i: case when i = k + 1 then m[i] else
                            list_transform(range(1, lag + 4), lambda j: {less}) end) from adf_j where k <= lag""",
        "adf_s": f"""select {keys}, lag, nobs, m[1][lag + 2] / m[1][1] as beta, m[1][lag + 3] / m[1][1] as unit,
                            g[lag + 2][lag + 2] - list_sum(list_transform(range(1, lag + 2), lambda i: m[i][lag + 2] / m[i][i] * g[i][lag + 2])) as rest
                     from adf_j where k = lag + 1""",
        "adf": f"""select a.*, s.beta / sqrt(s.rest / (s.nobs - s.lag - 2) * s.unit) as stat,
                          cast(case when s.nobs > s.lag + 2 then s.lag end as int) as used_lag, cast(case when s.nobs > s.lag + 2 then s.nobs end as int) as nobs
                   from (select distinct {keys} from {source} where value is not null) a left join adf_s s using ({keys})""",
    }


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


_ADF_COLUMNS = "panel_id, series_id, round(stat, 6) + 0.0 as adf_stat, used_lag, nobs"


@query("adf_autolag", _recursive(sql(f"select {_ADF_COLUMNS} from adf", "f5", **_adf_steps("f5"))))
def adf_autolag(spark, d):
    return rounded(
        stationarity.adf_report(warehouse.vectors_as_series(spark, d)).select(
            PANEL, SERIES, "adf_stat", "used_lag", "nobs"
        ),
        6,
        "adf_stat",
    )


@query("adf_autolag_blocked", _recursive(sql(f"select {_ADF_COLUMNS} from adf", "f2m", **_adf_steps("f2m"))))
def adf_autolag_blocked(spark, d):
    report = stationarity.adf_report(warehouse.scaled_nations(spark, d), block_days=730)
    return rounded(report.select(PANEL, SERIES, "adf_stat", "used_lag", "nobs"), 6, "adf_stat")


# The share of the normal distribution below z, by its power series; fixed values are those of functions/adf.py.
_SMALL = "2.1659 + 1.4412 * stat + 0.038269 * stat * stat"
_LARGE = "1.7339 + 0.93202 * stat - 0.12745 * stat * stat - 0.010368 * stat * stat * stat"
_BELOW = """0.5 + list_sum(list_transform(range(0, 130), lambda k: pow(cast(-1 as double), k) * pow(z, 2 * k + 1)
            / (pow(cast(2 as double), k) * gamma(k + 1) * (2 * k + 1)))) / sqrt(2 * pi())"""
_CRITICAL = {
    1: "-3.43035 - 6.5393 / n - 16.786 / (n * n) - 79.433 / (n * n * n)",
    5: "-2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n)",
    10: "-2.56677 - 1.5384 / n - 2.809 / (n * n)",
}


@query(
    "stationarity_report",
    _recursive(
        sql(
            f"""select {_ADF_COLUMNS}, round(case when stat > 2.74 then 1 when stat < -18.83 then 0 when z < -5.5 then 0 when z > 5.5 then 1 when stat is not null then {_BELOW} end, 6) + 0.0 as p_value,
                       {", ".join(f"round({sql_}, 6) + 0.0 as crit_{c}" for c, sql_ in _CRITICAL.items())}
                from (select *, cast(nobs as double) as n, case when stat <= -1.61 then {_SMALL} else {_LARGE} end as z from adf)""",
            "f2m",
            **_adf_steps("f2m"),
        )
    ),
)
def stationarity_report(spark, d):
    report = stationarity.adf_report(warehouse.scaled_nations(spark, d))
    return rounded(report, 6, "adf_stat", "p_value", "crit_1", "crit_5", "crit_10")


_VARIANT_STEPS = {
    "a": f"select *, value as v0, value - lag(value) over ({W}) as v1, value - {_full('avg', 7)} as v2 from f2m",
    "b": f"select *, v2 - lag(v2) over ({W}) as v3 from a",
    "l": "select *, " + ", ".join(f"lag(v{i}) over ({W}) as x{i}" for i in range(4)) + " from b",
    "t": " union all ".join(
        f"select panel_id, series_id, {i} as rank, '{m}' as method, {_lag0_sql(f'v{i} - x{i}', f'x{i}')} as stat from l group by 1, 2"
        for i, m in enumerate(stationarity.METHODS)
    ),
    "c": """select panel_id, series_id, coalesce(arg_min(method, (stat, rank)) filter (where stat is not null), 'None') as method,
                   min(stat) as adf_stat from t group by 1, 2""",
}


@query("choose_transform", sql("select panel_id, series_id, method, round(adf_stat, 6) + 0.0 as adf_stat from c", "f2m", **_VARIANT_STEPS))
def choose_transform(spark, d):
    choice = stationarity.choose_transform(warehouse.scaled_nations(spark, d), statistic="lag0")
    return rounded(choice, 6, "adf_stat")


_AUTOLAG_STEPS = {
    "a": _VARIANT_STEPS["a"],
    "b": _VARIANT_STEPS["b"],
    "vv": " union all ".join(f"select panel_id, series_id, {i} as rank, ts, v{i} as value from b" for i in range(4)),
    **_adf_steps("vv", "panel_id, series_id, rank"),
    "names": "select unnest(range(4)) as rank, unnest([" + ", ".join(f"'{m}'" for m in stationarity.METHODS) + "]) as method",
    "c": """select panel_id, series_id, coalesce(arg_min(method, (stat, rank)) filter (where stat is not null), 'None') as method,
                   min(stat) as adf_stat from adf join names using (rank) group by 1, 2""",
}


@query(
    "choose_transform_autolag",
    _recursive(sql("select panel_id, series_id, method, round(adf_stat, 6) + 0.0 as adf_stat from c", "f2m", **_AUTOLAG_STEPS)),
)
def choose_transform_autolag(spark, d):
    return rounded(stationarity.choose_transform(warehouse.scaled_nations(spark, d)), 6, "adf_stat")


_APPLY = sql(
    f"""select panel_id, series_id, ts, method, round(first_value(v ignore nulls) over
               ({W} rows between current row and unbounded following), 8) + 0.0 as value
        from (select b.panel_id, b.series_id, b.ts, c.method, case c.method when '{stationarity.METHODS[1]}' then v1
                     when '{stationarity.METHODS[2]}' then v2 when '{stationarity.METHODS[3]}' then v3 else v0 end as v
              from b join c on c.panel_id = b.panel_id and c.series_id = b.series_id)""",
    "f2m",
    **_VARIANT_STEPS,
)


@query("apply_transform", _APPLY)
def apply_transform(spark, d):
    return rounded(stationarity.apply_transform(warehouse.scaled_nations(spark, d), statistic="lag0"), 8)


@query("apply_transform_blocked", _APPLY)
def apply_transform_blocked(spark, d):
    panel = warehouse.scaled_nations(spark, d)
    return rounded(stationarity.apply_transform(panel, statistic="lag0", block_days=730), 8)

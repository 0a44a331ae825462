"""Queries over learners, scores, selection, search and the whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import tidy
from tidepanel.keys import PANEL, SERIES, SPLIT, SPLIT_KEY, TS, VALUE
from tidepanel.operators import align, boosted, forward, gram, search, selection, split
from tidepanel.plans import engineer as engineer_plan
from tidepanel.plans import prepare as prepare_plan
from tidepanel.plans.config import EngineerConfig, PrepareConfig
from tidepanel.queries.panels_sql import split_sql, sql
from tidepanel.sources import warehouse

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TARGET, BASE = "BUILDING", "AUTOMOBILE"
OTHERS = ("FURNITURE", "HOUSEHOLD", "MACHINERY")
NAMES = (BASE, *OTHERS)
PENALTIES = {"xgboost": 0.5, "lightgbm": 2.0}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c), digits) for c in columns})


# --- errors of given predictions --------------------------------------------------------


def _predictions(spark, d) -> DataFrame:
    """Two naive forecasts per nation and segment: the last value and the mean of
    the three before."""
    w = Window.partitionBy(*SPLIT_KEY).orderBy(TS)
    rows = split.chrono_split(warehouse.scaled_nations(spark, d)).withColumns(
        {"last": F.lag(VALUE).over(w), "mean3": F.avg(VALUE).over(w.rowsBetween(-3, -1))}
    )
    test = rows.where((F.col(SPLIT) == "test") & F.col("last").isNotNull())
    return test.unpivot(
        [PANEL, SERIES, TS, F.col(VALUE).alias("y")], ["last", "mean3"], "model", "prediction"
    )


_PREDICTIONS = {
    "s": split_sql("f2m"),
    "w": """select *, lag(value) over (partition by panel_id, series_id, split order by ts) as a,
                   avg(value) over (partition by panel_id, series_id, split order by ts rows between 3 preceding and 1 preceding) as b from s""",
    "m": """select panel_id, 'last' as model, avg((value - a) * (value - a)) as mse from w where split = 'test' and a is not null group by 1
            union all select panel_id, 'mean3', avg((value - b) * (value - b)) from w where split = 'test' and a is not null group by 1""",
}


@query("mse", sql("select panel_id, model, round(mse, 6) + 0.0 as mse from m", "f2m", **_PREDICTIONS))
def mse(spark, d):
    return rounded(selection.mse(_predictions(spark, d)), "mse")


@query("agg_mse", sql("select panel_id, round(sum(mse), 6) + 0.0 as agg_mse from m group by 1", "f2m", **_PREDICTIONS))
def agg_mse(spark, d):
    return rounded(selection.aggregate_mse(selection.mse(_predictions(spark, d))), "agg_mse")


# --- the linear learner --------------------------------------------------------------------


def quarterly(spark, d) -> DataFrame:
    """Quarterly scaled order values per nation and segment, split by date."""
    return split.chrono_split(align.resample(warehouse.scaled_nations(spark, d), "q"))


def sums_of(panel: DataFrame, names=NAMES, target: str = TARGET) -> DataFrame:
    matrix = gram.design_matrix(gram.as_features(panel), names, target)
    return gram.product_sums(matrix)


# Rows with all columns, standardised on the training rows a series has.
_SHORT = {s: s[0].lower() for s in (TARGET, *NAMES)}
_MATRIX = {
    "q": """select panel_id, series_id, cast(date_trunc('quarter', ts) as date) as ts, avg(value) as value from f2m group by 1, 2, 3""",
    "s": split_sql("q"),
    "z": """select s.panel_id, s.series_id, s.ts, s.split, case when s.series_id = 'BUILDING' then s.value
                   else (s.value - f.m) / case when f.sd = 0 then 1 else f.sd end end as value
            from s join (select panel_id, series_id, avg(value) as m, stddev_pop(value) as sd from s where split = 'train' group by 1, 2) f
              on f.panel_id = s.panel_id and f.series_id = s.series_id""",
    "x": "select panel_id, split, ts, "
    + ", ".join(f"max(case when series_id = '{s}' then value end) as {c}" for s, c in _SHORT.items())
    + " from z group by 1, 2, 3 having "
    + " and ".join(f"max(case when series_id = '{s}' then 1 end) = 1" for s in _SHORT),
}


def _one_fit(feature: str, cols: list[str], penalty: float) -> str:
    """Hold-out error of a ridge fit on one or two columns, in closed form."""
    if len(cols) == 1:
        (a,) = cols
        beta = f"select panel_id, avg(b) as my, avg({a}) as m1, 0 as m2, covar_pop({a}, b) * count(*) / (var_pop({a}) * count(*) + {penalty}) as b1, 0 as b2"
        second = "0"
    else:
        a, second = cols
        n = "count(*)"
        g11, g22 = f"(var_pop({a}) * {n} + {penalty})", f"(var_pop({second}) * {n} + {penalty})"
        g12 = f"(covar_pop({a}, {second}) * {n})"
        y1, y2 = f"(covar_pop({a}, b) * {n})", f"(covar_pop({second}, b) * {n})"
        det = f"({g11} * {g22} - {g12} * {g12})"
        beta = (
            f"select panel_id, avg(b) as my, avg({a}) as m1, avg({second}) as m2, "
            f"({y1} * {g22} - {y2} * {g12}) / {det} as b1, ({y2} * {g11} - {y1} * {g12}) / {det} as b2"
        )
    gap = f"(t.b - (my + b1 * (t.{a} - m1) + b2 * ({'t.' + second if second != '0' else '0'} - m2)))"
    return (
        f"select t.panel_id, '{feature}' as feature, avg({gap} * {gap}) as mse from x t "
        f"join ({beta} from x where split = 'train' group by 1) f on f.panel_id = t.panel_id "
        f"where t.split = 'test' group by 1"
    )


def _fits(sets: dict[str, list[str]]) -> str:
    return " union all ".join(
        _one_fit(f, [_SHORT[c] for c in cols], p) for f, cols in sets.items() for p in PENALTIES.values()
    )


_ADD = {"fits": _fits({c: [BASE, c] for c in OTHERS}), "b": _fits({"": [BASE]})}
_PAIR = ("FURNITURE", "HOUSEHOLD", "AUTOMOBILE")
_DROP = {"fits": _fits({f: [c for c in _PAIR if c != f] for f in _PAIR})}


@query(
    "add_one_scores",
    sql(
        """select f.panel_id, f.feature, round(f.agg_mse, 6) + 0.0 as agg_mse, round(b.agg_mse - f.agg_mse, 6) + 0.0 as improvement,
                  case when b.agg_mse - f.agg_mse > 0 then 'improved' else 'worsened' end as status
           from (select panel_id, feature, sum(mse) as agg_mse from fits group by 1, 2) f
           join (select panel_id, sum(mse) as agg_mse from b group by 1) b on b.panel_id = f.panel_id""",
        "f2m",
        **_MATRIX,
        **_ADD,
    ),
)
def add_one_scores(spark, d):
    sums = sums_of(quarterly(spark, d))
    base = selection.places_of([BASE], NAMES)
    scored = selection.add_one_scores(sums, base, selection.places_of(NAMES, NAMES), NAMES, PENALTIES)
    out = scored.select(PANEL, "feature", "agg_mse", "improvement", "status")
    return rounded(out, "agg_mse", "improvement")


# Candidates by the Schur complement: rows are the dates with base and target, and a
# candidate with a gap on one of them is not scored.
_BASE_ROWS = {
    **{k: v for k, v in _MATRIX.items() if k != "x"},
    "x": _MATRIX["x"].split(" having ")[0]
    + " having max(case when series_id = 'BUILDING' then 1 end) = 1 and max(case when series_id = 'AUTOMOBILE' then 1 end) = 1",
}
_COMPLETE = "select * from ({fit}) where panel_id in (select panel_id from x group by 1 having count({c}) = count(*))"
_LINEAR = {
    "fits": " union all ".join(
        _COMPLETE.format(fit=_one_fit(c, [_SHORT[BASE], _SHORT[c]], p), c=_SHORT[c]) for c in OTHERS for p in PENALTIES.values()
    ),
    "b": _fits({"": [BASE]}),
}


def penalties_of(panels: DataFrame, penalties: dict[str, float]) -> DataFrame:
    entries = F.create_map(*[F.lit(x) for m, p in penalties.items() for x in (m, p)])
    return panels.select(PANEL, entries.alias("penalties"))


@query(
    "add_one_linear",
    sql(
        """select f.panel_id, f.feature, round(f.agg_mse, 6) + 0.0 as agg_mse, round(b.agg_mse - f.agg_mse, 6) + 0.0 as improvement,
                  case when b.agg_mse - f.agg_mse > 0 then 'improved' else 'worsened' end as status
           from (select panel_id, feature, sum(mse) as agg_mse from fits group by 1, 2) f
           join (select panel_id, sum(mse) as agg_mse from b group by 1) b on b.panel_id = f.panel_id""",
        "f2m",
        **_BASE_ROWS,
        **_LINEAR,
    ),
)
def add_one_linear(spark, d):
    scaled = forward.scaled_features(gram.as_features(quarterly(spark, d)))
    base = scaled.select(PANEL).distinct().withColumn("features", F.array(F.lit(BASE)))
    scored = forward.add_one(scaled, base, TARGET, penalties_of(base, PENALTIES))
    return rounded(scored.select(PANEL, "feature", "agg_mse", "improvement", "status"), "agg_mse", "improvement")


@query(
    "drop_one_scores",
    sql("select panel_id, feature, round(sum(mse), 6) + 0.0 as agg_mse from fits group by 1, 2", "f2m", **_MATRIX, **_DROP),
)
def drop_one_scores(spark, d):
    sums = sums_of(quarterly(spark, d))
    scored = selection.drop_one_scores(sums, selection.places_of(_PAIR, NAMES), NAMES, PENALTIES)
    return rounded(scored.select(PANEL, "feature", "agg_mse"), "agg_mse")


@query(
    "baseline_score",
    sql("select panel_id, round(sum(mse), 6) + 0.0 as agg_mse from fits group by 1", "f2m", **_MATRIX, fits=_fits({"": [BASE, "MACHINERY"]})),
)
def baseline_score(spark, d):
    sums = sums_of(quarterly(spark, d))
    scores = selection.baseline_scores(sums, selection.places_of([BASE, "MACHINERY"], NAMES), PENALTIES)
    return rounded(scores.select(PANEL, "agg_mse"), "agg_mse")


@query("greedy_add")
def greedy_add(spark, d):
    grown = selection.greedy_add(sums_of(quarterly(spark, d)), [BASE], NAMES, PENALTIES, rounds=2)
    return rounded(grown.select(PANEL, "features", "added", "agg_mse"), "agg_mse")


# --- choosing from a score table -----------------------------------------------------------------


def _base_of(scores: DataFrame) -> DataFrame:
    return scores.groupBy(PANEL).agg(F.round(F.avg("agg_mse"), 6).alias("agg_mse"))


_F6_BASE = "select panel_id, round(avg(agg_mse), 6) as agg_mse from f6 group by 1"


@query(
    "top3_add",
    sql(
        """select panel_id, feature, agg_mse, round(improvement, 6) + 0.0 as improvement, cast(rank as int) as rank from
            (select f.*, b.agg_mse - f.agg_mse as improvement, row_number() over (partition by f.panel_id order by f.agg_mse, f.feature) as rank
             from f6 f join b on b.panel_id = f.panel_id) where rank <= 3 and improvement > 0""",
        "f6",
        b=_F6_BASE,
    ),
)
def top3_add(spark, d):
    scores = warehouse.brand_scores(spark, d)
    out = selection.top_improving(selection.evaluate(scores, _base_of(scores)))
    return rounded(out.select(PANEL, "feature", "agg_mse", "improvement", "rank"), "improvement")


@query(
    "features_to_drop",
    sql(
        """select f.panel_id, f.feature, f.agg_mse, round(b.agg_mse - f.agg_mse, 6) + 0.0 as improvement,
                  round(cast(0.002 as double) * b.agg_mse, 6) + 0.0 as threshold,
                  case when b.agg_mse - f.agg_mse > cast(0.002 as double) * b.agg_mse then 'improved' else 'worsened' end as status
           from f6 f join b on b.panel_id = f.panel_id""",
        "f6",
        b=_F6_BASE,
    ),
)
def features_to_drop(spark, d):
    scores = warehouse.brand_scores(spark, d)
    labelled = selection.features_to_drop(selection.evaluate(scores, _base_of(scores)))
    return rounded(labelled.drop("baseline"), "improvement", "threshold")


@query(
    "improvement_summary",
    sql(
        """select panel_id, model, round(i, 6) + 0.0 as initial_mse, round(f, 6) + 0.0 as final_mse, round(i - f, 6) + 0.0 as improvement
           from (select a.panel_id, a.model, a.mse as i, b.mse as f from a join b on b.panel_id = a.panel_id and b.model = a.model
                 union all select a.panel_id, 'all', sum(a.mse), sum(b.mse) from a join b on b.panel_id = a.panel_id and b.model = a.model group by 1)""",
        "f2m",
        **_MATRIX,
        a=" union all ".join(
            f"select panel_id, '{m}' as model, mse from ({_one_fit('', [_SHORT[BASE]], p)})" for m, p in PENALTIES.items()
        ),
        b=" union all ".join(
            f"select panel_id, '{m}' as model, mse from ({_one_fit('', [_SHORT[BASE], 'm'], p)})" for m, p in PENALTIES.items()
        ),
    ),
)
def improvement_summary(spark, d):
    sums = sums_of(quarterly(spark, d))

    def per_model(columns):
        scores = selection.baseline_scores(sums, selection.places_of(columns, NAMES), PENALTIES)
        return scores.select(PANEL, F.explode("mse").alias("model", "mse"))

    out = selection.improvement_summary(per_model([BASE]), per_model([BASE, "MACHINERY"]))
    return rounded(out, "initial_mse", "final_mse", "improvement")


_SWEEP = {
    "b": _F6_BASE,
    "t": """select panel_id, agg_mse as base, cast(0.0001 as double) + i * (cast(0.01 as double) - cast(0.0001 as double)) / 99 as rel
            from b, (select unnest(range(0, 100)) as i)""",
    "k": """select t.panel_id, t.rel, t.rel * t.base as threshold, count_if(t.base - f.agg_mse > t.rel * t.base) as n_dropped,
                   string_agg(case when t.base - f.agg_mse <= t.rel * t.base then f.feature end, ',' order by f.feature) as kept,
                   avg(case when t.base - f.agg_mse <= t.rel * t.base then f.agg_mse end) as final
            from t join f6 f on f.panel_id = t.panel_id group by t.panel_id, t.rel, t.base""",
}


def _sweep(spark, d) -> DataFrame:
    scores = warehouse.brand_scores(spark, d)
    kept = selection.sweep_kept(selection.evaluate(scores, _base_of(scores)))
    total = F.aggregate("kept", F.lit(0.0), lambda a, k: a + k["agg_mse"])
    return kept.select(
        PANEL,
        "relative_threshold",
        "threshold",
        F.col("n_dropped").cast("bigint").alias("n_dropped"),
        F.array_join(F.transform("kept", lambda k: k["feature"]), ",").alias("kept"),
        F.try_divide(total, F.size("kept")).alias("aggregated_final_mse"),
    )


@query(
    "threshold_sweep",
    sql(
        """select panel_id, round(rel, 6) + 0.0 as relative_threshold, round(threshold, 6) + 0.0 as threshold,
                  cast(n_dropped as bigint) as n_dropped, kept, round(final, 5) + 0.0 as aggregated_final_mse from k""",
        "f6",
        **_SWEEP,
    ),
)
def threshold_sweep(spark, d):
    out = rounded(_sweep(spark, d), "relative_threshold", "threshold")
    return rounded(out, "aggregated_final_mse", digits=5)


@query(
    "best_threshold",
    sql(
        """select panel_id, round(rel, 6) + 0.0 as relative_threshold, round(final, 5) + 0.0 as aggregated_final_mse from
            (select *, row_number() over (partition by panel_id order by round(final, 5), rel) as r from k) where r = 1""",
        "f6",
        **_SWEEP,
    ),
)
def best_threshold(spark, d):
    table = rounded(_sweep(spark, d), "aggregated_final_mse", digits=5)
    best = selection.best_threshold(table).select(PANEL, "relative_threshold", "aggregated_final_mse")
    return rounded(best, "relative_threshold")


@query(
    "nsmallest3",
    sql(
        """select panel_id, round(rel, 6) + 0.0 as relative_threshold, round(final, 5) + 0.0 as aggregated_final_mse
           from k order by round(final, 5), rel limit 3""",
        "f6",
        **_SWEEP,
    ),
)
def nsmallest3(spark, d):
    table = rounded(_sweep(spark, d), "aggregated_final_mse", digits=5)
    smallest = selection.n_smallest(table, 3, "aggregated_final_mse", "relative_threshold")
    return rounded(smallest.select(PANEL, "relative_threshold", "aggregated_final_mse"), "relative_threshold")


@query("threshold_sweep_scored")
def threshold_sweep_scored(spark, d):
    sums = sums_of(quarterly(spark, d))
    out = engineer_plan.sweep(sums, NAMES, NAMES, PENALTIES)
    return rounded(out, *engineer_plan.SWEEP_COLUMNS, digits=8)


@query("threshold_sweep_noise")
def threshold_sweep_noise(spark, d):
    """The sweep over the series and three features that know nothing."""
    parts, probes = engineer_plan.with_noise(gram.as_features(quarterly(spark, d)), 3)
    names = (*NAMES, *probes)
    sums = gram.product_sums(gram.design_matrix(parts, names, TARGET))
    return rounded(engineer_plan.sweep(sums, names, names, PENALTIES), *engineer_plan.SWEEP_COLUMNS, digits=8)


@query(
    "feature_union",
    sql(
        """select panel_id, series_id as feature from f2 union
           select panel_id, 'lag_' || series_id from f2 where series_id in ('BUILDING', 'FURNITURE') union
           select panel_id, series_id from f2 where series_id = 'BUILDING'""",
        "f2",
    ),
)
def feature_union(spark, d):
    base = gram.as_features(warehouse.orders_by_nation(spark, d))
    added = base.where(F.col("feature").isin("BUILDING", "FURNITURE")).withColumn("feature", F.concat(F.lit("lag_"), "feature"))
    return split.union_names(base, added, base.where(F.col("feature") == "BUILDING"))


_U = "(('0x' || substr(md5({text}), 1, 12))::bigint / cast(281474976710656 as double))"


@query(
    "noise_probe",
    sql(
        "select panel_id, series_id, ts, "
        + ", ".join(
            f"round({_U.format(text=chr(39) + f'42|{n}|' + chr(39) + ' || panel_id || ' + chr(39) + '|' + chr(39) + ' || series_id || ' + chr(39) + '|' + chr(39) + ' || cast(ts as varchar)')}, 9) + 0.0 as {n}"
            for n in ("noise_0", "noise_1")
        )
        + " from f2",
        "f2",
    ),
)
def noise_probe(spark, d):
    names = ["noise_0", "noise_1"]
    rows = warehouse.orders_by_nation(spark, d).drop(VALUE)
    return rounded(selection.noise_probe(rows, names, keys=(PANEL, SERIES, TS)), *names, digits=9)


# --- search -----------------------------------------------------------------------------------------


# The two parameter spaces once more, so that the SQL does not follow a wrong range in the library.
_RANGES = {
    "xgboost": (
        ("max_depth", 3, 10, "int"), ("learning_rate", 1e-4, 1e-1, "log"), ("n_estimators", 50, 300, "int"),
        ("min_child_weight", 1, 10, "int"), ("subsample", 0.5, 1.0, "float"), ("colsample_bytree", 0.5, 1.0, "float"),
        ("reg_alpha", 1e-5, 1e1, "log"), ("reg_lambda", 1e-5, 1e1, "log"),
    ),
    "lightgbm": (
        ("num_leaves", 20, 300, "int"), ("learning_rate", 1e-4, 1e-1, "log"), ("n_estimators", 50, 300, "int"),
        ("max_depth", 3, 20, "int"), ("min_child_samples", 5, 100, "int"), ("subsample", 0.5, 1.0, "float"),
        ("colsample_bytree", 0.5, 1.0, "float"), ("reg_alpha", 1e-5, 1e1, "log"), ("reg_lambda", 1e-5, 1e1, "log"),
    ),
}


def _draw_sql(model: str, name: str, low: float, high: float, kind: str) -> str:
    u = _U.format(text=f"'42|' || panel_id || '|{model}|' || trial || '|{name}'")
    if kind == "int":
        return f"floor(cast({low} as double) + {u} * {high - low + 1})"
    if kind == "log":
        return f"exp(ln(cast({low!r} as double)) + {u} * (ln(cast({high!r} as double)) - ln(cast({low!r} as double))))"
    return f"cast({low} as double) + {u} * {high - low}"


def _trials_sql() -> str:
    grid = "(select panel_id, unnest(range(0, 50)) as trial from (select distinct panel_id from f2m))"
    return " union all ".join(
        f"select panel_id, '{m}' as model, trial, '{dim[0]}' as name, {_draw_sql(m, *dim)} as value from {grid}"
        for m, space in _RANGES.items()
        for dim in space
    )


@query(
    "param_trials",
    sql("select panel_id, model, cast(trial as int) as trial, name, round(value, 6) + 0.0 as value from t", "f2m", t=_trials_sql()),
)
def param_trials(spark, d):
    drawn = search.param_trials(warehouse.scaled_nations(spark, d))
    return rounded(drawn.select(PANEL, "model", "trial", F.explode("params").alias("name", "value")), "value")


_RIDGE = """select t.panel_id, t.model, t.trial, t.value as lam, avg(pow(x.b - (f.my + f.sxy / (f.sxx + t.value) * (x.a - f.ma)), 2)) as mse
    from t join (select panel_id, avg(b) as my, avg(a) as ma, covar_pop(a, b) * count(*) as sxy, var_pop(a) * count(*) as sxx
                 from x where split = 'train' group by 1) f on f.panel_id = t.panel_id
    join x on x.panel_id = t.panel_id and x.split = 'test'
    where t.name = 'reg_lambda' group by 1, 2, 3, 4"""


@query(
    "search_summary",
    sql(
        """select panel_id, model, round(arg_min(lam, (round(mse, 9), trial)), 6) + 0.0 as best_reg_lambda,
                  cast(arg_min(trial, (round(mse, 9), trial)) as int) as best_trial,
                  round(min(mse), 6) + 0.0 as best_mse, round(avg(mse), 6) + 0.0 as mean_mse
           from r group by 1, 2""",
        "f2m",
        **_MATRIX,
        t=_trials_sql(),
        r=_RIDGE,
    ),
)
def search_summary(spark, d):
    sums = sums_of(quarterly(spark, d))
    scored = search.ridge_search(sums, selection.places_of([BASE], NAMES)).withColumn("mse", F.round("mse", 9))
    out = search.search_summary(scored).withColumn("best_reg_lambda", F.col("best_params")["reg_lambda"]).drop("best_params")
    return rounded(out, "best_reg_lambda", "best_mse", "mean_mse")


# --- boosted trees and whole plans ----------------------------------------------------------------------

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("gbt_score")
def gbt_score(spark, d):
    panel = split.chrono_split(align.month_grid(warehouse.scaled_orders(spark, d)))
    names = PRIORITIES[1:]
    matrix = gram.design_matrix(gram.as_features(panel), names, PRIORITIES[0])
    scores = boosted.score_sets(matrix, "all", {"base": range(len(names))})
    return rounded(scores, "mse")


def _prepared(spark, d) -> DataFrame:
    grid = align.month_grid(warehouse.mixed_frequencies(spark, d))
    cfg = PrepareConfig(target="output_q", deflator="price_m")
    return prepare_plan.preprocess(
        grid,
        cfg,
        spline=["output_q", "yield_d"],
        nominal=["spend_m", "output_q"],
        logged=["spend_m", "output_q", "count_m"],
    )


@query("prepare_panel")
def prepare_panel(spark, d):
    return rounded(_prepared(spark, d), VALUE, digits=4)


@query("engineer_panel")
def engineer_panel(spark, d):
    cfg = EngineerConfig(target="output_q", rounds=2)
    result = engineer_plan.engineer(_prepared(spark, d), cfg)
    return rounded(result.summary, "initial_mse", "final_mse", "improvement", digits=4)


# The whole plan on months with gaps: base rows are dropped jointly, no panel is lost.
_GAPS = ("BUILDING", "AUTOMOBILE", "FURNITURE")
_GAP_SETS = {"a = 1 and f = 1": ["a", "f"], "a = 1 and f is null": ["a"], "a is null and f = 1": ["f"]}
_GAP_STEPS = {
    "g": "select * from f2m where series_id in ('BUILDING', 'AUTOMOBILE', 'FURNITURE')",
    "s": split_sql("g"),
    "z": _MATRIX["z"],
    # What series a panel has: its base is its own.
    "k": """select panel_id, count(distinct series_id) as n, max(case when series_id = 'AUTOMOBILE' then 1 end) as a,
                   max(case when series_id = 'FURNITURE' then 1 end) as f from g group by 1""",
    "x": """select z.panel_id, split, ts, max(case when series_id = 'BUILDING' then value end) as b,
                   max(case when series_id = 'AUTOMOBILE' then value end) as a,
                   max(case when series_id = 'FURNITURE' then value end) as f
            from z join k on k.panel_id = z.panel_id group by 1, 2, 3, k.n
            having count(*) = k.n and max(case when series_id = 'BUILDING' then 1 end) = 1""",
    "fits": " union all ".join(
        f"select panel_id, '{m}' as model, mse from ({_one_fit('', columns, p)}) where panel_id in (select panel_id from k where {has})"
        for m, p in PENALTIES.items()
        for has, columns in _GAP_SETS.items()
    )
    + "".join(
        f""" union all select t.panel_id, '{m}', avg((t.b - f.my) * (t.b - f.my)) from x t
             join (select panel_id, avg(b) as my from x where split = 'train' group by 1) f on f.panel_id = t.panel_id
             where t.split = 'test' and t.panel_id in (select panel_id from k where a is null and f is null) group by 1"""
        for m in PENALTIES
    ),
    "r": "select panel_id, model, mse from fits union all select panel_id, 'all', sum(mse) from fits group by 1",
}


@query(
    "engineer_gaps",
    sql(
        """select p.panel_id, coalesce(r.model, 'all') as model, round(r.mse, 6) + 0.0 as initial_mse, round(r.mse, 6) + 0.0 as final_mse,
                  case when r.model is null then 'no date has the target and all predictors in both splits' end as reason
           from (select distinct panel_id from g) p left join r on r.panel_id = p.panel_id""",
        "f2m",
        **_GAP_STEPS,
    ),
)
def engineer_gaps(spark, d):
    panel = split.chrono_split(warehouse.scaled_nations(spark, d).where(F.col(SERIES).isin(*_GAPS)))
    cfg = EngineerConfig(target=TARGET, rounds=0, drop_threshold=1e9)
    result = engineer_plan.engineer(panel, cfg, penalties=PENALTIES, trials=1)
    return rounded(result.summary.select(PANEL, "model", "initial_mse", "final_mse", "reason"), "initial_mse", "final_mse")


@query("engineer_gaps_all")
def engineer_gaps_all(spark, d):
    """The same months over all series, with the plan's own rounds, search and drop pass."""
    result = engineer_plan.engineer(split.chrono_split(warehouse.scaled_nations(spark, d)), EngineerConfig(target=TARGET))
    summary = result.summary.select(
        PANEL, "model", "initial_mse", "final_mse", "improvement", "initial_mean_mse", "final_mean_mse", "reason"
    )
    return rounded(summary, *[c for c in summary.columns if c not in (PANEL, "model", "reason")])

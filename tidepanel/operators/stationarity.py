"""Dickey-Fuller statistics and the choice of a stationarity transform."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import adf as ols
from tidepanel.functions import adf_sql
from tidepanel.keys import SERIES_KEY, SPLIT, TS, VALUE
from tidepanel.operators.blocks import BLOCK, HALO, add_halo, over_series, settled
from tidepanel.operators.transform import ROLL_MEAN, stationarity_variants, variant_steps

# The names of the transforms, in the order that settles ties.
METHODS = (
    "None",
    "Simple Differencing",
    "Rolling Mean Subtraction",
    "Rolling Mean Subtraction + Differencing",
)
VARIANTS = ("v0", "v1", "v2", "v3")

#: Prefix of the columns that the augmented test adds on its way.
ADF = "_adf_"

Agg = Callable[[Column], Column]


def _itself(column: Column) -> Column:
    return column


def _series_keys(df: DataFrame) -> list[str]:
    return [*SERIES_KEY, SPLIT] if SPLIT in df.columns else list(SERIES_KEY)


# --- lag 0 and lag 1 in closed form -------------------------------------------------


def lag0_statistic(dy: Column, level: Column, agg: Agg = _itself) -> Column:
    """t value of the lagged level in dy = a + b * level."""
    n = agg(F.regr_count(dy, level)).cast("double")
    sxx = agg(F.regr_sxx(dy, level))
    sxy = agg(F.regr_sxy(dy, level))
    syy = agg(F.regr_syy(dy, level))
    b = F.try_divide(sxy, sxx)
    sse = syy - b * sxy
    defined = (n > 2) & (sxx > 0) & (sse > syy * 1e-12)
    return F.when(defined, b / F.sqrt(sse / (n - 2.0) / sxx))


def lag0(panel: DataFrame, *, column: str = VALUE, block_days: int | None = None) -> DataFrame:
    """Dickey-Fuller statistic without lags, one row per series."""
    keys = _series_keys(panel)
    changes = over_series(
        panel.where(F.col(column).isNotNull()),
        [lambda w: {"_x": F.lag(column).over(w)}],
        before=1,
        keys=keys,
        block_days=block_days,
    ).withColumn("_dy", F.col(column) - F.col("_x"))
    return changes.groupBy(*keys).agg(lag0_statistic(F.col("_dy"), F.col("_x")).alias("adf_stat"))


def lag1(panel: DataFrame, *, column: str = VALUE, block_days: int | None = None) -> DataFrame:
    """Augmented statistic at one fixed lag, from the 2x2 centred moments."""
    keys = _series_keys(panel)
    rows = over_series(
        panel.where(F.col(column).isNotNull()),
        [
            lambda w: {"_x": F.lag(column).over(w)},
            lambda w: {"_dy": F.col(column) - F.col("_x")},
            lambda w: {"_d1": F.lag("_dy").over(w)},
        ],
        before=2,
        keys=keys,
        block_days=block_days,
    ).where(F.col("_d1").isNotNull())
    n = F.count(F.lit(1)).cast("double")
    moments = rows.groupBy(*keys).agg(
        n.alias("n"),
        (F.var_pop("_x") * n).alias("xx"),
        (F.var_pop("_d1") * n).alias("zz"),
        (F.var_pop("_dy") * n).alias("yy"),
        (F.covar_pop("_x", "_d1") * n).alias("xz"),
        (F.covar_pop("_x", "_dy") * n).alias("xy"),
        (F.covar_pop("_d1", "_dy") * n).alias("zy"),
    )
    c = {k: F.col(k) for k in ("n", "xx", "zz", "yy", "xz", "xy", "zy")}
    det = c["xx"] * c["zz"] - c["xz"] * c["xz"]
    bx = (c["xy"] * c["zz"] - c["zy"] * c["xz"]) / det
    bz = (c["zy"] * c["xx"] - c["xy"] * c["xz"]) / det
    sse = c["yy"] - bx * c["xy"] - bz * c["zy"]
    defined = (c["n"] > 3) & (det > c["xx"] * c["zz"] * 1e-12) & (sse > c["yy"] * 1e-12)
    stat = F.when(defined, bx / F.sqrt(sse / (c["n"] - 3.0) * c["zz"] / det))
    return moments.select(*keys, stat.alias("adf_stat"))


# --- lag chosen by AIC ----------------------------------------------------------------


def adf_report(
    panel: DataFrame, *, column: str = VALUE, keys: Sequence[str] | None = None, block_days: int | None = None
) -> DataFrame:
    """Statistic, p-value, lag, rows used and critical values, one row per series.

    Undefined for constant and very short series: the values are then NULL.
    """
    keys = list(keys or _series_keys(panel))
    rows = panel.where(F.col(column).isNotNull())
    if block_days is not None:
        return _adf_in_blocks(rows, column, keys, block_days)
    ordered = F.sort_array(F.collect_list(F.struct(TS, column)))
    arrays = rows.groupBy(*keys).agg(F.transform(ordered, lambda r: r[column].cast("double")).alias("_y"))
    return _reported(adf_sql.apply(arrays, adf_sql.of_values(ADF, "_y")), keys)


def _reported(solved: DataFrame, keys: list[str]) -> DataFrame:
    stat, lag, nobs = f"{ADF}stat", f"{ADF}lag", f"{ADF}nobs"
    critical = [f"{adf_sql.critical_value(c, nobs)} as crit_{c}" for c in (1, 5, 10)]
    return solved.selectExpr(
        *keys, f"{stat} as adf_stat", f"{adf_sql.p_value(stat)} as p_value", f"{lag} as used_lag", f"{nobs} as nobs", *critical
    )


def _adf_in_blocks(rows: DataFrame, column: str, keys: list[str], block_days: int) -> DataFrame:
    """Blocks of a series are summed side by side, then their sums are merged.

    The driver learns one number, the longest series, which fixes how many rows
    the lags may reach back.
    """
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("_n"), F.avg(column).alias("_mean"), F.min(column).alias("_low"), F.max(column).alias("_high")
    )
    longest = stats.agg(F.max("_n")).first()[0] or 0
    reach = max(ols.lag_limit(longest), 0) + 1
    halo = add_halo(rows.select(*keys, TS, column), block_days=block_days, before=reach, keys=keys)
    ordered = F.sort_array(F.collect_list(F.struct(TS, column)))
    blocks = halo.groupBy(*keys, BLOCK).agg(ordered.alias("_rows"), F.count_if(F.col(HALO)).cast("int").alias("_front"))
    centred = blocks.join(stats, keys).withColumn(
        "_y", F.when(F.col("_low") < F.col("_high"), F.transform("_rows", lambda r: r[column].cast("double") - F.col("_mean")))
    )
    partial = adf_sql.apply(centred, adf_sql.sums(ADF, "_y", "_n", "_front"))
    parts = partial.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(BLOCK, F.col(f"{ADF}sums").alias("s")))).alias("_b"))
    whole = adf_sql.apply(parts.withColumn("_b", F.transform("_b", lambda b: b["s"])), adf_sql.merged(ADF, "_b"))
    return _reported(adf_sql.apply(whole, adf_sql.solved(ADF)), keys)


# --- choosing and applying a transform --------------------------------------------------


def _best(candidates: Sequence[tuple[Column, int, str]]) -> Column:
    """Smallest statistic, first listed on ties, 'None' when none is defined."""
    options = F.array(
        *[F.struct(s.alias("stat"), F.lit(rank).alias("rank"), F.lit(m).alias("method")) for s, rank, m in candidates]
    )
    best = F.array_min(F.filter(options, lambda o: o["stat"].isNotNull()))
    nothing = F.struct(F.lit(None).cast("double").alias("stat"), F.lit(0).alias("rank"), F.lit(METHODS[0]).alias("method"))
    return F.coalesce(best, nothing)


def _with_lag0_choice(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Add the chosen struct by windows alone: no join, no further shuffle."""
    ordered = Window.partitionBy(*keys).orderBy(TS)
    whole = Window.partitionBy(*keys)
    lagged = variants.withColumns({f"{v}_x": F.lag(v).over(ordered) for v in VARIANTS})
    stats = [lag0_statistic(F.col(v) - F.col(f"{v}_x"), F.col(f"{v}_x"), lambda c: c.over(whole)) for v in VARIANTS]
    named = lagged.withColumns({f"{v}_stat": s for v, s in zip(VARIANTS, stats)})
    return named.withColumn("_best", _best([(F.col(f"{v}_stat"), i, METHODS[i]) for i, v in enumerate(VARIANTS)]))


def _variant_reports(variants: DataFrame, keys: list[str], block_days: int | None) -> DataFrame:
    if block_days is not None:
        long = variants.unpivot([*keys, TS], list(VARIANTS), "_variant", "_v")
        reports = adf_report(long, column="_v", keys=[*keys, "_variant"], block_days=block_days)
        stat = lambda v: F.max(F.when(F.col("_variant") == v, F.col("adf_stat")))
        return reports.groupBy(*keys).agg(*[stat(v).alias(f"{v}_stat") for v in VARIANTS])
    return _with_variant_stats(variants, keys).drop("_rows")


def _with_variant_stats(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Each series once, as ``_rows`` in date order, with its four statistics."""
    rest = [c for c in variants.columns if c not in keys and c != TS]
    ordered = F.sort_array(F.collect_list(F.struct(TS, *rest)))
    arrays = variants.groupBy(*keys).agg(ordered.alias("_rows"))
    known = lambda v: F.filter(F.transform("_rows", lambda r: r[v]), lambda x: x.isNotNull())
    values = arrays.withColumns({f"_{v}_values": known(v) for v in VARIANTS})
    chains = [adf_sql.of_values(f"_{v}_", f"_{v}_values") for v in VARIANTS]
    tested = adf_sql.apply(values, [{n: sql for layer in layers for n, sql in layer.items()} for layers in zip(*chains)])
    return tested.select(*keys, "_rows", *[F.col(f"_{v}_stat").alias(f"{v}_stat") for v in VARIANTS])


def _with_autolag_choice(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Choose while the series is at hand, then unfold it again: no join."""
    rest = [c for c in variants.columns if c not in keys]
    best = _best([(F.col(f"{v}_stat"), i, METHODS[i]) for i, v in enumerate(VARIANTS)])
    chosen = _with_variant_stats(variants, keys).withColumn("_best", best)
    return chosen.select(*keys, "_best", F.explode("_rows").alias("_r")).select(
        *keys, "_best", *[F.col(f"_r.{c}").alias(c) for c in rest]
    )


def choose_transform(
    panel: DataFrame, *, column: str = VALUE, statistic: str = "autolag", block_days: int | None = None
) -> DataFrame:
    """method and adf_stat per series (and split), by the smallest statistic."""
    keys = _series_keys(panel)
    known = panel.where(F.col(column).isNotNull())
    if statistic == "lag0":
        # Transforms, lags and all four statistics in one pass over the series.
        lags = lambda w: {f"{v}_x": F.lag(v).over(w) for v in VARIANTS}
        lagged = over_series(
            known, [*variant_steps(column), lags], before=ROLL_MEAN + 1, keys=keys, block_days=block_days
        )
        stats = [lag0_statistic(F.col(v) - F.col(f"{v}_x"), F.col(f"{v}_x")).alias(f"{v}_stat") for v in VARIANTS]
        reports = lagged.groupBy(*keys).agg(*stats)
        return _chosen(reports, keys)
    if statistic != "autolag":
        raise ValueError(f"unknown statistic {statistic!r}, expected 'autolag' or 'lag0'")
    variants = settled(stationarity_variants(known, column=column, keys=keys, block_days=block_days), block_days)
    return _chosen(_variant_reports(variants, keys, block_days), keys)


def _chosen(reports: DataFrame, keys: list[str]) -> DataFrame:
    best = _best([(F.col(f"{v}_stat"), i, METHODS[i]) for i, v in enumerate(VARIANTS)])
    return reports.withColumn("_best", best).select(
        *keys, F.col("_best.method").alias("method"), F.col("_best.stat").alias("adf_stat")
    )


def apply_transform(
    panel: DataFrame,
    choice: DataFrame | None = None,
    *,
    column: str = VALUE,
    statistic: str = "autolag",
    block_days: int | None = None,
    with_stat: bool = False,
) -> DataFrame:
    """Replace values by the chosen transform and fill its leading gap backward.

    Adds ``method``, and the statistic that it was chosen by (adf_stat) if asked to. Without a choice table it is made here; a table keyed by
    series only is used for every split. In blocks the intermediate tables are
    written to the checkpoint folder.
    """
    keys = _series_keys(panel)
    variants = settled(stationarity_variants(panel, column=column, keys=keys, block_days=block_days), block_days)
    if choice is None and block_days is None:
        chosen = _with_lag0_choice(variants, keys) if statistic == "lag0" else _with_autolag_choice(variants, keys)
        chosen = chosen.withColumns({"method": F.col("_best.method"), "adf_stat": F.col("_best.stat")})
    else:
        if choice is None:
            plain = variants.drop(*VARIANTS)
            choice = settled(choose_transform(plain, column=column, statistic=statistic, block_days=block_days), block_days)
        on = [k for k in keys if k in choice.columns]
        stat = F.col("adf_stat") if "adf_stat" in choice.columns else F.lit(None).cast("double").alias("adf_stat")
        chosen = variants.join(choice.select(*on, "method", stat), on, "left")
    value = F.col(VARIANTS[0])
    for v, method in list(zip(VARIANTS, METHODS))[1:]:
        value = F.when(F.col("method") == method, F.col(v)).otherwise(value)
    said = ["method", "adf_stat"] if with_stat else ["method"]
    shaped = settled(chosen.withColumn(column, value).select(*panel.columns, *said), block_days)
    later = lambda w: F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    # 'None' leaves the series as it is, gaps included.
    kept = F.col("method").isNull() | (F.col("method") == METHODS[0])
    fill = lambda w: {column: F.when(kept, F.col(column)).otherwise(later(w))}
    return over_series(shaped, [fill], after=1, anchor=F.col(column).isNotNull(), keys=keys, block_days=block_days)

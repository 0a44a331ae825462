"""Expanding and rolling frames, and feature extraction over them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidepanel.functions import calculators as calc
from tidepanel.functions import frame_numpy
from tidepanel.functions.scalar import nan_to_null
from tidepanel.keys import SERIES, SERIES_KEY, SPLIT, TS, VALUE
from tidepanel.operators import ranks
from tidepanel.operators.blocks import BLOCK, series_window, with_block

MINIMAL, EFFICIENT, COMPREHENSIVE = "minimal", "efficient", "comprehensive"
SETS = (MINIMAL, EFFICIENT, COMPREHENSIVE)
FRAMES_PER_TASK = 32


def series_keys(df: DataFrame) -> list[str]:
    return [*SERIES_KEY, SPLIT] if SPLIT in df.columns else list(SERIES_KEY)


def frame(w: WindowSpec, max_shift: int | None = None) -> WindowSpec:
    """All rows up to the current one, or the last ``max_shift`` + 1 of them."""
    start = Window.unboundedPreceding if max_shift is None else -max_shift
    return w.rowsBetween(start, 0)


def expanding_frame(panel: DataFrame, *, max_shift: int | None = None, min_shift: int = 0) -> DataFrame:
    """The frame each row ends: its first date and row count, never its rows.

    Frames with no more than ``min_shift`` rows are left out.
    """
    f = frame(series_window(series_keys(panel)), max_shift)
    sized = panel.withColumns(
        {"frame_start": F.min(TS).over(f), "frame_length": F.count(F.lit(1)).over(f).cast("bigint")}
    )
    return sized.where(F.col("frame_length") > min_shift)


def calculators_for(parameter_set: str, max_shift: int | None = None) -> tuple[list[calc.Calculator], list[str]]:
    """(column calculators, numpy calculators) of a named set; the coefficients of rolling frames slide."""
    if parameter_set not in SETS:
        raise ValueError(f"unknown parameter set {parameter_set!r}, expected one of {', '.join(SETS)}")
    key = MINIMAL if parameter_set == MINIMAL else EFFICIENT
    columns = [c for registry in calc.COLUMN_SETS[key] for c in registry.values()]
    if parameter_set == MINIMAL:
        return columns, []
    names = list(frame_numpy.EFFICIENT)
    if max_shift is not None:
        columns += calc.SPECTRAL.values()
        names = [n for n in names if n not in calc.SPECTRAL]
    return columns, names if parameter_set == EFFICIENT else names + list(frame_numpy.COSTLY)


def extract(
    panel: DataFrame,
    parameter_set: str = MINIMAL,
    *,
    max_shift: int | None = None,
    min_shift: int = 0,
    target: str | None = None,
    include_target: bool = True,
) -> DataFrame:
    """Long features(panel_id, [split,] ts, feature, value), one row per frame and
    calculator; undefined numbers are NULL. With a split, each split starts anew."""
    columns, arrays = calculators_for(parameter_set, max_shift)
    rows = panel if include_target or target is None else panel.where(F.col(SERIES) != target)
    out = extract_columns(rows, columns, max_shift=max_shift, min_shift=min_shift)
    if arrays:
        out = out.unionByName(extract_arrays(rows, arrays, max_shift=max_shift, min_shift=min_shift))
    return out


def _long(df: DataFrame, keys: Sequence[str], names: Sequence[str], values: str) -> DataFrame:
    """Unfold an array of numbers to (keys without series, ts, feature, value)."""
    rest = [k for k in keys if k != SERIES]
    exploded = df.selectExpr(*keys, TS, f"posexplode({values}) as (_i, {VALUE})")
    # One constant array; the names hold no newline.
    name = F.get(F.split(F.lit("\n".join(names)), "\n"), F.col("_i"))
    return exploded.select(
        *rest,
        TS,
        F.concat(F.col(SERIES), F.lit("__"), name).alias("feature"),
        nan_to_null(F.col(VALUE)).alias(VALUE),
    )


def extract_columns(
    panel: DataFrame, calculators: Iterable[calc.Calculator], *, max_shift: int | None = None, min_shift: int = 0
) -> DataFrame:
    """Features written as column expressions: one shuffle by series, all in the JVM."""
    keys = series_keys(panel)
    f = calc.Frame(keys, max_shift)
    length = f.size
    pieces = [piece for c in calculators for piece in c(f)]
    known = panel.where(F.col(VALUE).isNotNull()).select(*keys, TS, VALUE)
    df = known
    for layer in (f.rows, f.marks, f.chunks, f.counts, f.aggregates):
        df = df.selectExpr("*", *[f"{sql} as {name}" for name, sql in layer.items()])
    if f.quantiles_asked or f.tops_asked:
        sized = known.selectExpr("*", f"count(*) over (partition by {', '.join(keys)}) as {calc.ROWS_COLUMN}")
        long = sized.where(f"{calc.ROWS_COLUMN} > {calc.SHORT}").drop(calc.ROWS_COLUMN)
    if f.quantiles_asked:
        found = ranks.frame_quantiles(long, keys, f.quantiles_asked, max_shift=max_shift)
        df = df.join(found.withColumnRenamed("quantiles", calc.QUANTILES_COLUMN), [*keys, TS], "left")
    if f.tops_asked:
        tops = ranks.largest(long, keys, f.tops_asked, max_shift=max_shift)
        df = df.join(tops.withColumnRenamed("tops", calc.TOPS_COLUMN), [*keys, TS], "left")
    if min_shift:
        df = df.where(f"{length} > {min_shift}")
    for layer in f.derived_layers():
        df = df.selectExpr("*", *[f"{sql} as {name}" for name, sql in layer.items()])
    names = [n for piece in pieces for n in piece[0]]
    return _long(df, keys, names, f"concat({', '.join(sql for _, sql in pieces)})")


def extract_arrays(
    panel: DataFrame, names: Sequence[str], *, max_shift: int | None = None, min_shift: int = 0
) -> DataFrame:
    """Features needing numpy, for runs of FRAMES_PER_TASK frames of a series.

    A run crosses to Python once, with the values its frames reach back to; the
    frames are slices of it there. Runs, not series, are dealt over the tasks.
    """
    keys = series_keys(panel)
    known = panel.where(F.col(VALUE).isNotNull())
    rows = F.sort_array(F.collect_list(F.struct(TS, VALUE)))
    arrays = known.groupBy(*keys).agg(rows.alias("_rows"))
    run = FRAMES_PER_TASK
    starts = F.sequence(F.lit(0), F.size("_rows") - 1, F.lit(run))
    reach = F.col("_start") if max_shift is None else F.least(F.col("_start"), F.lit(max_shift))
    taken = F.transform(
        F.slice("_rows", F.col("_start") - F.col("_reach") + 1, F.col("_reach") + F.lit(run)), lambda r: r[VALUE]
    )
    # A fixed number of partitions: the runs are small in bytes but heavy to compute,
    # so they must not be merged by size.
    spread = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (
        arrays.withColumn("_start", F.explode(starts))
        .withColumn("_reach", reach)
        .select(
            *keys,
            "_start",
            "_reach",
            F.transform(F.slice("_rows", F.col("_start") + 1, F.lit(run)), lambda r: r[TS]).alias("_dates"),
            taken.alias("_values"),
        )
        .repartition(spread, *keys, "_start")
    )
    udf = frame_numpy.frame_udf(tuple(names), max_shift)
    computed = runs.withColumn("_frames", udf("_values", "_reach"))
    per_row = computed.select(*keys, "_start", "_frames", F.posexplode("_dates").alias("_at", TS)).select(
        *keys, TS, F.get("_frames", F.col("_at")).alias("_v"), (F.col("_start") + F.col("_at") + 1).alias("_length")
    )
    if min_shift:
        length = F.col("_length") if max_shift is None else F.least(F.col("_length"), F.lit(max_shift + 1))
        per_row = per_row.where(length > min_shift)
    return _long(per_row, keys, frame_numpy.names_of(names), "_v")


# --- long series ---------------------------------------------------------------------------


def expanding_moments(panel: DataFrame, *, block_days: int) -> DataFrame:
    """Expanding count, sum, mean, deviation, root mean square and extremes of a
    series cut into blocks: each block adds to the merged state of those before."""
    keys = series_keys(panel)
    blocked = with_block(panel.where(F.col(VALUE).isNotNull()), block_days)
    pieces = {
        "n": F.count(VALUE),
        "s": F.sum(VALUE),
        "q": F.sum(F.col(VALUE) * F.col(VALUE)),
        "m2": F.var_pop(VALUE) * F.count(VALUE),
        "lo": F.min(VALUE),
        "hi": F.max(VALUE),
        "big": F.max(F.abs(VALUE)),
    }
    state = blocked.groupBy(*keys, BLOCK).agg(*[e.alias(k) for k, e in pieces.items()])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # Squared deviations about the common mean: within blocks plus between blocks.
    center = F.sum("s").over(before) / F.sum("n").over(before)
    carried = state.withColumn("_prior", F.collect_list(F.struct("n", "s", "m2")).over(before)).select(
        *keys,
        BLOCK,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"),
        F.coalesce(F.sum("q").over(before), F.lit(0.0)).alias("q0"),
        center.alias("_center"),
        "_prior",
        F.min("lo").over(before).alias("lo0"),
        F.max("hi").over(before).alias("hi0"),
        F.max("big").over(before).alias("big0"),
    )
    spread = lambda b: b["m2"] + b["n"] * (b["s"] / b["n"] - F.col("_center")) * (b["s"] / b["n"] - F.col("_center"))
    carried = carried.withColumn("m0", F.aggregate(F.transform("_prior", spread), F.lit(0.0), lambda a, v: a + v)).drop("_prior", "_center")
    inside = frame(series_window([*keys, BLOCK]))
    running = {f"_{k}": e.over(inside) for k, e in pieces.items() if k != "m2"}
    running["_m2"] = F.var_pop(VALUE).over(inside) * F.count(VALUE).over(inside)
    rows = blocked.withColumns(running).join(carried, [*keys, BLOCK])
    n, s = F.col("_n") + F.col("n0"), F.col("_s") + F.col("s0")
    gap = F.when(F.col("n0") > 0, F.col("_s") / F.col("_n") - F.col("s0") / F.col("n0")).otherwise(0.0)
    m2 = F.col("_m2") + F.col("m0") + gap * gap * F.col("_n") * F.col("n0") / n
    return rows.select(
        *keys,
        TS,
        n.cast("double").alias("length"),
        s.alias("sum_values"),
        (s / n).alias("mean"),
        F.sqrt(m2 / n).alias("standard_deviation"),
        (m2 / n).alias("variance"),
        F.sqrt((F.col("_q") + F.col("q0")) / n).alias("root_mean_square"),
        F.least("_lo", "lo0").alias("minimum"),
        F.greatest("_hi", "hi0").alias("maximum"),
        F.greatest("_big", "big0").alias("absolute_maximum"),
    )



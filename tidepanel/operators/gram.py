"""Design matrix rows and their product sums, one matrix per panel and split."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.subset_ols import holdout_mse
from tidepanel.keys import PANEL, SERIES, SPLIT, TS, VALUE
from tidepanel.operators.split import TEST, TRAIN
from tidepanel.operators.transform import standardise

ROW = (PANEL, SPLIT, TS)
PANELS_HELD = 64


def as_features(panel: DataFrame) -> DataFrame:
    """Series as features of their own name."""
    return panel.withColumnRenamed(SERIES, "feature")


def design_matrix(rows: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """(panel_id, split, ts, x, y): named features standardised on the training
    rows, as one array per date, and the target value, all from one long table
    (panel_id, split, ts, feature, value).

    Dates lacking a feature or the target are dropped jointly.
    """
    wanted = rows.where(F.col("feature").isin(*names, target)).select(*ROW, "feature", VALUE)
    scaled = standardise(wanted.withColumn("_raw", F.col(VALUE)), keys=(PANEL, "feature"))
    number = F.when(F.col("feature") == target, F.col("_raw")).otherwise(F.col(VALUE))
    # The names bound how many values one date collects.
    cells = (
        scaled.withColumn("_v", number)
        .where(F.col("_v").isNotNull())
        .groupBy(*ROW)
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", "_v"))).alias("_m"))
    )
    cell = lambda f: F.try_element_at(F.col("_m"), f)
    x = F.transform(F.array(*[F.lit(n) for n in names]), cell)
    out = cells.select(*ROW, x.alias("x"), cell(F.lit(target)).alias("y"))
    return out.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))


def product_sums(matrix: DataFrame) -> DataFrame:
    """(panel_id, train, test): flat (p+2) x (p+2) sums of products of 1, x, y, p being
    the length of the panel's own x.

    A panel without rows in either split has nothing to score and is left out.

    Every task sums its rows per panel and split, in the order of their dates; a panel
    with most of the rows costs one matrix per task. The tasks' cells are then summed in
    the order of their size, so rows that are dealt alike give the same sums to the last
    digit, in whatever order they arrive.
    """
    schema = T.StructType(
        [
            T.StructField(PANEL, T.StringType()),
            T.StructField(SPLIT, T.StringType()),
            T.StructField("cells", T.ArrayType(T.DoubleType())),
        ]
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(k[0], k[1], v.ravel().tolist()) for k, v in held.items()], columns=schema.names)
            held.clear()
            return out

        for pdf in batches:
            for key, part in pdf.groupby([PANEL, SPLIT], sort=False):
                rows = np.column_stack([np.ones(len(part)), np.vstack(part["x"].to_numpy()).reshape(len(part), -1), part["y"].to_numpy()])
                held[key] = held.get(key, 0) + rows.T @ rows
                if len(held) >= PANELS_HELD:
                    yield flush()
        if held:
            yield flush()

    ordered = matrix.select(PANEL, SPLIT, TS, "x", "y").sortWithinPartitions(*ROW)
    parts = ordered.drop(TS).mapInPandas(partial, schema)
    # A task gives a panel and split once, or twice where it held too many.
    cells = (
        parts.select(PANEL, SPLIT, F.posexplode("cells").alias("_i", "_v"))
        .groupBy(PANEL, SPLIT, "_i")
        .agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
        .select(PANEL, SPLIT, "_i", F.aggregate("_vs", F.lit(0.0), lambda s, v: s + v).alias("_v"))
    )
    # p is the number of columns a panel's fit uses, which bounds what is collected.
    flat = F.sort_array(F.collect_list(F.struct("_i", SPLIT, "_v")))
    whole = cells.groupBy(PANEL).agg(flat.alias("_c"))
    def of(name: str) -> Column:
        mine = F.transform(F.filter("_c", lambda c: c[SPLIT] == name), lambda c: c["_v"])
        return mine

    sums = whole.select(PANEL, of(TRAIN).alias("train"), of(TEST).alias("test"))
    return sums.where((F.size("train") > 0) & (F.size("test") > 0))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def solve_sets(train: pd.Series, test: pd.Series, sets: pd.Series, penalties: pd.Series) -> pd.Series:
    def one(a, b, subsets, lambdas):
        a = np.asarray(a, dtype=float)
        width = int(round(len(a) ** 0.5))
        a, b = a.reshape(width, width), np.asarray(b, dtype=float).reshape(width, width)
        scores = [[holdout_mse(a, b, list(s), p) for p in lambdas] for s in subsets]
        return [[v if np.isfinite(v) else None for v in row] for row in scores]

    return pd.Series([one(*r) for r in zip(train, test, sets, penalties)])


def score_sets(sums: DataFrame, sets, penalties: dict[str, float] | Column) -> DataFrame:
    """Add ``mse``: per set of column places, a map model -> hold-out error.

    ``penalties`` is the same for all panels, or a map column of each.

    ``sets`` is a column of array<array<int>>; all sets of a panel are solved
    from its two matrices without another pass over the rows.
    """
    if not isinstance(penalties, Column):
        penalties = F.create_map(*[F.lit(x) for m, p in penalties.items() for x in (m, float(p))])
    models, lambdas = F.map_keys(penalties), F.map_values(penalties)
    raw = solve_sets("train", "test", sets, lambdas)
    return sums.withColumns({"_raw": raw, "_models": models}).withColumn(
        "mse", F.transform("_raw", lambda row: F.map_from_arrays(F.col("_models"), row))
    ).drop("_raw", "_models")

"""Base matrices and candidate scores without an all-pairs matrix.

What a panel's fit uses (its base) is one row per date; a candidate is only ever
combined with that base and with itself. Candidates of a panel are dealt over
slices, each slice gets a copy of the base rows, and one factorisation of the base
serves all candidates of the slice by the Schur complement. The work is linear in
the candidates, and no list of names passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.keys import PANEL, SPLIT, TS, VALUE
from tidepanel.operators import selection
from tidepanel.operators.gram import ROW
from tidepanel.operators.joins import attach
from tidepanel.operators.split import TEST, TRAIN
from tidepanel.operators.transform import standardise
from tidepanel.session import cut_lineage

#: Candidates of a panel that are scored beside one copy of its base rows.
SLICE = 64

SCORES = T.StructType(
    [
        T.StructField(PANEL, T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("mse", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("base_mse", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def scaled_features(parts: DataFrame) -> DataFrame:
    """(panel, split, ts, feature, value, raw): values standardised on the training
    rows of their feature, without NULLs."""
    rows = parts.select(*ROW, "feature", VALUE, F.col(VALUE).alias("raw"))
    return standardise(rows, keys=(PANEL, "feature")).where(F.col(VALUE).isNotNull())


def base_matrix(scaled: DataFrame, base: DataFrame, target: str) -> DataFrame:
    """(panel, split, ts, x, y): the features of ``base`` (panel, features) in its
    order, and the raw target. Dates lacking one of the panel's own base features or
    the target are dropped jointly; other panels have no say in that."""
    named = F.concat("features", F.array(F.lit(target)))
    places = base.select(PANEL, F.size("features").alias("_n"), F.posexplode(named).alias("_i", "feature"))
    rows = scaled.join(places, [PANEL, "feature"])
    number = F.when(F.col("_i") == F.col("_n"), F.col("raw")).otherwise(F.col(VALUE))
    # A panel's base bounds what one date collects.
    dates = rows.groupBy(*ROW).agg(
        F.first("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_i", number.alias("_v")))).alias("_c")
    )
    whole = dates.where(F.size("_c") == F.col("_n") + 1)
    values = F.transform("_c", lambda c: c["_v"])
    return whole.select(*ROW, F.slice(values, F.lit(1), F.col("_n")).alias("x"), F.element_at(values, -1).alias("y"))


def _solve(matrix: pd.DataFrame, wanted: pd.DataFrame, penalties: dict[str, float]) -> Iterator[tuple]:
    """(feature, errors, base errors) of each candidate that has a value on every date."""
    matrix = matrix.sort_values([SPLIT, TS])
    train = (matrix[SPLIT] == TRAIN).to_numpy()
    test = (matrix[SPLIT] == TEST).to_numpy()
    x = np.vstack(matrix["x"].to_numpy()).reshape(len(matrix), -1).astype(float)
    y = matrix["y"].to_numpy(dtype=float)
    key = list(zip(matrix[SPLIT], matrix[TS]))
    cells = wanted.pivot_table(index=[SPLIT, TS], columns="feature", values=VALUE, aggfunc="first", dropna=False)
    cells = cells.reindex(pd.MultiIndex.from_tuples(key, names=[SPLIT, TS]))
    cells = cells.loc[:, cells.notna().all()]
    c = cells.to_numpy(dtype=float).reshape(len(matrix), -1)
    if not train.any() or not test.any():
        return
    xm, ym, cm = x[train].mean(0), y[train].mean(), c[train].mean(0)
    x, y, c = x - xm, y - ym, c - cm
    gram, cross, own = x[train].T @ x[train], x[train].T @ c[train], (c[train] ** 2).sum(0)
    xy, cy = x[train].T @ y[train], c[train].T @ y[train]
    errors, base_errors = {}, {}
    for model, penalty in penalties.items():
        a = gram + penalty * np.eye(len(gram))
        solved = np.linalg.lstsq(a, np.column_stack([xy, cross]), rcond=1e-12)[0] if len(gram) else np.zeros((0, 1 + c.shape[1]))
        alone, through = solved[:, 0], solved[:, 1:]
        rest = y[test] - x[test] @ alone
        base_errors[model] = float((rest**2).mean())
        schur = own + penalty - (cross * through).sum(0)
        # A candidate that the base already spans adds nothing.
        open_ = schur > 1e-9 * (own + penalty + 1e-300)
        beta = np.where(open_, (cy - through.T @ xy) / np.where(open_, schur, 1.0), 0.0)
        errors[model] = ((rest[:, None] - (c[test] - x[test] @ through) * beta) ** 2).mean(0)
    for i, feature in enumerate(cells.columns):
        yield feature, {m: float(e[i]) for m, e in errors.items()}, base_errors


def add_one(
    scaled: DataFrame,
    base: DataFrame,
    target: str,
    penalties: DataFrame,
    *,
    candidates: DataFrame | None = None,
    slice_size: int = SLICE,
) -> DataFrame:
    """Base plus each candidate: (panel, feature, mse, agg_mse, baseline, improvement, status).

    ``penalties`` is (panel, penalties: map of model to penalty). Candidates are all
    features but the target and the base, or those of ``candidates`` (panel,
    feature). One with a gap on a date of the base matrix is left out.
    """
    matrix = base_matrix(scaled, base, target)
    used = base.select(PANEL, F.explode(F.concat("features", F.array(F.lit(target)))).alias("feature"))
    wanted = scaled.select(*ROW, "feature", VALUE).join(used, [PANEL, "feature"], "left_anti")
    if candidates is not None:
        wanted = wanted.join(candidates.select(PANEL, "feature").distinct(), [PANEL, "feature"], "left_semi")
    if candidates is None:
        candidates = wanted.select(PANEL, "feature")
    # As many slices of a panel as its candidates fill.
    counted = candidates.select(PANEL, "feature").distinct().groupBy(PANEL).agg(F.count("*").alias("_n"))
    counted = counted.select(PANEL, F.ceil(F.col("_n") / F.lit(slice_size)).cast("int").alias("_slices"))
    wanted = attach(wanted, counted, [PANEL], how="inner", salt_by=["feature"])
    wanted = wanted.withColumn("_s", F.expr("cast(pmod(xxhash64(feature), _slices) as int)")).drop("_slices")
    copies = matrix.join(penalties.select(PANEL, "penalties"), PANEL).join(counted, PANEL)
    copies = copies.withColumn("_s", F.explode(F.expr("sequence(0, _slices - 1)"))).drop("_slices")
    names = copies.columns
    copies = copies.toDF(*[f"m_{c}" for c in names])  # both sides come from the same rows

    def score(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(rows):
            return pd.DataFrame(columns=SCORES.names)
        rows = rows.set_axis(names, axis=1)
        given = dict(rows["penalties"].iloc[0])
        found = _solve(rows, mine, given)
        panel = rows[PANEL].iloc[0]
        return pd.DataFrame([(panel, *f) for f in found], columns=SCORES.names)

    scores = wanted.groupBy(PANEL, "_s").cogroup(copies.groupBy(f"m_{PANEL}", "m__s")).applyInPandas(score, SCORES)
    return selection.with_gain(
        scores.select(
            PANEL,
            "feature",
            "mse",
            selection.summed(F.col("mse")).alias("agg_mse"),
            selection.summed(F.col("base_mse")).alias("baseline"),
        )
    )


def grow(
    scaled: DataFrame,
    base: DataFrame,
    target: str,
    penalties: DataFrame,
    *,
    rounds: int = 2,
    top: int = selection.TOP,
    candidates: DataFrame | None = None,
    slice_size: int = SLICE,
) -> DataFrame:
    """Forward addition per panel: (panel, features, added), every panel of ``base``.

    A round adds up to ``top`` improving candidates. A panel that cannot be scored
    or has no winner keeps its base. The state is one row per panel.
    """
    if rounds < 0:
        raise ValueError("rounds must be at least 0")
    none = F.array().cast("array<string>")
    state = cut_lineage(base.select(PANEL, "features", none.alias("added")))
    for _ in range(rounds):
        scored = add_one(scaled, state, target, penalties, candidates=candidates, slice_size=slice_size)
        won = selection.top_improving(scored, top).groupBy(PANEL)
        won = won.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "feature"))), lambda w: w["feature"]).alias("_won"))
        won = state.join(won, PANEL, "left").withColumn("_won", F.coalesce("_won", none))
        state = cut_lineage(won.select(PANEL, F.concat("features", "_won").alias("features"), F.concat("added", "_won").alias("added")))
    return state

"""Parameter spaces, seeded trials and the search over them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalar import unit_hash_sql
from tidepanel.keys import PANEL
from tidepanel.operators.gram import solve_sets

TRIALS = 50


@dataclass(frozen=True)
class Dimension:
    name: str
    low: float
    high: float
    kind: str  # int, float or log

    def draw(self, u: str) -> str:
        """SQL for the value at the uniform number ``u``."""
        if self.kind == "int":
            return f"cast(floor({float(self.low)}D + {u} * {float(self.high - self.low + 1)}D) as double)"
        if self.kind == "log":
            lo, hi = math.log(self.low), math.log(self.high)
            return f"exp({lo!r}D + {u} * {hi - lo!r}D)"
        return f"({float(self.low)}D + {u} * {float(self.high - self.low)}D)"


# The two parameter spaces.
SPACES: dict[str, tuple[Dimension, ...]] = {
    "xgboost": (
        Dimension("max_depth", 3, 10, "int"),
        Dimension("learning_rate", 1e-4, 1e-1, "log"),
        Dimension("n_estimators", 50, 300, "int"),
        Dimension("min_child_weight", 1, 10, "int"),
        Dimension("subsample", 0.5, 1.0, "float"),
        Dimension("colsample_bytree", 0.5, 1.0, "float"),
        Dimension("reg_alpha", 1e-5, 1e1, "log"),
        Dimension("reg_lambda", 1e-5, 1e1, "log"),
    ),
    "lightgbm": (
        Dimension("num_leaves", 20, 300, "int"),
        Dimension("learning_rate", 1e-4, 1e-1, "log"),
        Dimension("n_estimators", 50, 300, "int"),
        Dimension("max_depth", 3, 20, "int"),
        Dimension("min_child_samples", 5, 100, "int"),
        Dimension("subsample", 0.5, 1.0, "float"),
        Dimension("colsample_bytree", 0.5, 1.0, "float"),
        Dimension("reg_alpha", 1e-5, 1e1, "log"),
        Dimension("reg_lambda", 1e-5, 1e1, "log"),
    ),
}
MODELS = tuple(SPACES)


def space_of(model: str) -> tuple[Dimension, ...]:
    if model not in SPACES:
        raise ValueError(f"unknown model name: {model}")
    return SPACES[model]


def trial_list(*, trials: int = TRIALS, seed: int = 42, models=MODELS) -> Column:
    """array<struct<model, trial, params>>: ``trials`` draws per model for the
    panel of the row.

    A draw depends on panel, model, trial and parameter name alone, so it is the
    same wherever and however often its task runs.
    """

    def draws(model: str) -> str:
        entries = ", ".join(
            f"'{dim.name}', {dim.draw(unit_hash_sql(str(seed), PANEL, repr(model), 't', repr(dim.name)))}"
            for dim in space_of(model)
        )
        one = f"named_struct('model', '{model}', 'trial', t, 'params', map({entries}))"
        return f"transform(sequence(0, {trials - 1}), t -> {one})"

    return F.expr(f"concat({', '.join(draws(m) for m in models)})")


def param_trials(panels: DataFrame, **options) -> DataFrame:
    """(panel_id, model, trial, params), one row per draw."""
    drawn = panels.select(PANEL).distinct().select(PANEL, trial_list(**options).alias("_t"))
    return drawn.select(PANEL, F.explode_outer("_t").alias("_t")).select(PANEL, "_t.*")


def search_summary(trials: DataFrame) -> DataFrame:
    """Best parameters, best error and mean error per panel and model."""
    order = F.when(F.col("mse").isNotNull(), F.struct("mse", "trial"))
    return trials.groupBy(PANEL, "model").agg(
        F.min_by("params", order).alias("best_params"),
        F.min_by("trial", order).alias("best_trial"),
        F.min("mse").alias("best_mse"),
        F.avg("mse").alias("mean_mse"),
    )


def ridge_search(sums: DataFrame, base: Column, **options) -> DataFrame:
    """The trials of every panel with the hold-out error of the linear learner,
    which takes its penalty from ``reg_lambda``. The rows are not read again.

    The list is never empty; it is unfolded as if it might be, because Spark would
    else filter by its size, and push the draws of all trials down to any rows that
    are joined to the result.
    """
    listed = sums.withColumn("_t", trial_list(**options))
    penalties = F.transform("_t", lambda t: t["params"]["reg_lambda"])
    scored = listed.withColumn("_s", F.get(solve_sets("train", "test", F.array(base), penalties), F.lit(0)))
    return scored.select(PANEL, F.posexplode_outer("_t").alias("_i", "_c"), "_s").select(
        PANEL, "_c.*", F.get("_s", F.col("_i")).alias("mse")
    )

"""Boosted-tree learners: two parameter profiles on Spark's GBTRegressor."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.keys import PANEL, SPLIT
from tidepanel.operators.search import space_of
from tidepanel.operators.split import TEST, TRAIN
from tidepanel.session import cut_lineage

# The published best parameters of the two profiles.
DEFAULT_PARAMS: dict[str, dict[str, float]] = {
    "xgboost": {
        "max_depth": 6,
        "learning_rate": 0.03386166645147473,
        "n_estimators": 223,
        "min_child_weight": 8,
        "subsample": 0.5010333072298043,
        "colsample_bytree": 0.759090038013688,
        "reg_alpha": 0.0006983829594394185,
        "reg_lambda": 0.000229555936097098,
    },
    "lightgbm": {
        "num_leaves": 290,
        "learning_rate": 0.027300728563685272,
        "n_estimators": 142,
        "max_depth": 15,
        "min_child_samples": 17,
        "subsample": 0.6494993959247016,
        "colsample_bytree": 0.8672852640596774,
        "reg_alpha": 1.2740038238189685e-05,
        "reg_lambda": 0.00028305833752501953,
    },
}

# A fit runs two stages per level of every tree, so its tasks follow its rows, not
# the session's shuffle partitions. The rows that are drawn for a tree depend on how
# they lie: up to so many partitions stay as they are.
FIT_TASKS = 8
ROWS_PER_TASK = 20_000

SCORE_SCHEMA = T.StructType(
    [
        T.StructField(PANEL, T.StringType()),
        T.StructField("feature_set", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("mse", T.DoubleType()),
    ]
)


def regressor(model: str, params: Mapping[str, float], *, seed: int = 42) -> GBTRegressor:
    """GBTRegressor for a profile. ``reg_alpha`` and ``reg_lambda`` have no
    counterpart there and are not used; leaf-wise growth is approximated by the
    depth that holds ``num_leaves``."""
    space_of(model)
    depth = int(params["max_depth"])
    if "num_leaves" in params:
        depth = min(depth, math.ceil(math.log2(params["num_leaves"])))
    least_rows = params.get("min_child_weight", params.get("min_child_samples", 1))
    return GBTRegressor(
        featuresCol="features",
        labelCol="y",
        seed=seed,
        maxDepth=depth,
        stepSize=float(params["learning_rate"]),
        maxIter=int(params["n_estimators"]),
        minInstancesPerNode=max(int(least_rows), 1),
        subsamplingRate=float(params["subsample"]),
        featureSubsetStrategy=str(float(params["colsample_bytree"])),
    )


def score_sets(
    matrix: DataFrame,
    panel: str,
    sets: Mapping[str, Sequence[int]],
    params: Mapping[str, Mapping[str, float]] | None = None,
    *,
    parallelism: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Hold-out error per named column set and model, for one panel.

    Every fit is a chain of distributed jobs over the rows; ``parallelism`` of them
    run at a time. Every one of its tasks is sent with the lineage of the rows, so that
    is cut before. One number per fit reaches the driver.
    """
    params = params or DEFAULT_PARAMS
    # Held, the rows keep the partitions they are made in.
    held = matrix.where(F.col(PANEL) == panel).select(SPLIT, "x", "y").persist()
    try:
        rows = cut_lineage(held)
    finally:
        held.unpersist()
    rows = rows.coalesce(max(FIT_TASKS, math.ceil(rows.count() / ROWS_PER_TASK)))

    def fit(job: tuple[str, str]) -> tuple[str, str, str, float | None]:
        name, model = job
        places = F.array(*[F.lit(int(i)) for i in sets[name]])
        picked = rows.withColumn("features", array_to_vector(F.transform(places, lambda i: F.get(F.col("x"), i))))
        train, test = (picked.where(F.col(SPLIT) == s).select("features", "y") for s in (TRAIN, TEST))
        fitted = regressor(model, params[model], seed=seed).fit(cut_lineage(train))
        gap = F.col("y") - F.col("prediction")
        return panel, name, model, fitted.transform(test).agg(F.avg(gap * gap)).first()[0]

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        results = list(pool.map(fit, [(n, m) for n in sets for m in params]))
    return matrix.sparkSession.createDataFrame(results, SCORE_SCHEMA)

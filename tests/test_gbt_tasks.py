"""A tree fit has tasks by its rows, and they carry no lineage of the rows."""

import datetime as dt

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidepanel.operators import boosted

PARAMS = {"xgboost": {"max_depth": 2, "learning_rate": 0.1, "n_estimators": 3, "min_child_weight": 2, "subsample": 0.6, "colsample_bytree": 1.0}}


def matrix_of(spark, partitions):
    start = dt.date(2000, 1, 1)
    cells = [("train" if i < 80 else "test", start + dt.timedelta(i), [float(i % 7), float(i % 11)], float(i % 7 * 2 + i % 3)) for i in range(100)]
    rows = [(panel, *c) for c in cells for panel in ("a", "b")]
    made = spark.createDataFrame(rows, "panel_id string, split string, ts date, x array<double>, y double")
    return made.repartition(partitions, "panel_id", "split", "ts")


def seen_by_fits(monkeypatch):
    seen = []

    class Recorded(GBTRegressor):
        def fit(self, train, params=None):
            jvm = train._jdf.queryExecution().toRdd()
            seen.append((train.rdd.getNumPartitions(), train.count(), jvm.toDebugString().count("ShuffledRowRDD")))
            return super().fit(train, params)

    monkeypatch.setattr(boosted, "GBTRegressor", Recorded)
    return seen


def test_tasks_follow_the_rows(spark, monkeypatch):
    seen = seen_by_fits(monkeypatch)
    boosted.score_sets(matrix_of(spark, 40), "a", {"both": [0, 1]}, PARAMS).collect()
    assert seen == [(8, 80, 0)]
    monkeypatch.setattr(boosted, "ROWS_PER_TASK", 5)
    boosted.score_sets(matrix_of(spark, 40), "a", {"both": [0, 1]}, PARAMS).collect()
    assert seen[1] == (20, 80, 0)


def test_errors_are_those_of_a_fit_on_the_rows_as_they_lie(spark):
    matrix = matrix_of(spark, 8)
    rows = matrix.where("panel_id = 'a'").select("split", "x", "y").persist()
    assert rows.rdd.getNumPartitions() == 8
    picked = rows.withColumn("features", array_to_vector("x"))
    fitted = boosted.regressor("xgboost", PARAMS["xgboost"]).fit(picked.where("split = 'train'").select("features", "y"))
    gap = F.col("y") - F.col("prediction")
    expected = fitted.transform(picked.where("split = 'test'")).agg(F.avg(gap * gap)).first()[0]
    rows.unpersist()
    got = boosted.score_sets(matrix, "a", {"both": [0, 1]}, PARAMS).collect()
    assert [(r["panel_id"], r["feature_set"], r["model"]) for r in got] == [("a", "both", "xgboost")]
    assert abs(got[0]["mse"] - expected) < 1e-9

"""Product sums are the same to the last digit in whatever order the rows of a task arrive."""

import datetime as dt

import numpy as np
import pytest
from tidepanel.operators import gram


@pytest.mark.parametrize("parts", [1, 4])
def test_order_changes_no_digit(spark, parts):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    day = dt.date(2000, 1, 1)
    rows = [(f"p{i % 3}", "train" if i % 5 else "test", day + dt.timedelta(days=i), v[:3].tolist(), float(v[3])) for i, v in enumerate(x)]
    schema = "panel_id string, split string, ts date, x array<double>, y double"
    got = []
    for k in range(4):
        order = np.random.default_rng(k).permutation(len(rows))
        matrix = spark.createDataFrame([rows[i] for i in order], schema).coalesce(1)
        dealt = matrix if parts == 1 else matrix.repartition(parts, "ts")
        got.append(sorted((r["panel_id"], tuple(r["train"]), tuple(r["test"])) for r in gram.product_sums(dealt).collect()))
    assert len(got[0]) == 3 and all(g == got[0] for g in got)
    train = np.array([[1, *r[3], r[4]] for r in rows if r[0] == "p1" and r[1] == "train"])
    np.testing.assert_allclose(np.reshape(got[0][1][1], (5, 5)), train.T @ train, rtol=1e-12, atol=1e-12)

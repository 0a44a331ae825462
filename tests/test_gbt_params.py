"""The registered tree query scores with the published parameters."""

from pyspark.ml.regression import GBTRegressor

from tidepanel.operators import boosted
from tidepanel.queries import registry


def test_gbt_score_uses_the_published_parameters(spark, monkeypatch):
    asked = {}

    class Recorded(GBTRegressor):
        def fit(self, train, params=None):
            asked[self.getStepSize()] = (self.getMaxIter(), self.getMaxDepth(), self.getMinInstancesPerNode())
            return GBTRegressor(featuresCol="features", labelCol="y", maxIter=1, maxDepth=1).fit(train)

    monkeypatch.setattr(boosted, "GBTRegressor", Recorded)
    registry.queries()["gbt_score"](spark, "/root/testdata/sf0.001").collect()
    assert asked == {0.03386166645147473: (223, 6, 8), 0.027300728563685272: (142, 9, 17)}

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowmend.plans import catalog, train
from rowmend.sources import views

SF = "/root/testdata/sf0.001"


class Counting:
    """A detector that counts the rows it scores."""

    def __init__(self, spark, detector):
        self._detector, self.rows = detector, spark.sparkContext.accumulator(0)

    def __getattr__(self, name):
        return getattr(self._detector, name)

    def score(self, df):
        rows = self.rows

        @F.udf("double")
        def seen(score):
            rows.add(1)
            return score

        return self._detector.score(df).withColumn("score", seen.asNondeterministic()("score"))


@pytest.fixture(scope="module")
def fitted(spark):
    table = views.orders_mixed(spark, SF)
    return train.fit_detector(table, "label", catalog.FEATURES, catalog.KEY, train.TrainOptions(trees=4, depth=3))


def test_all_orders_are_scored_once(spark, fitted, monkeypatch):
    orders = views.orders_mixed(spark, SF).count()
    flagged = fitted.detector.score(views.orders_mixed(spark, SF)).filter("pred = 1").count()
    assert 0 < flagged < orders / 2
    for query, most in ((catalog.suggest_repairs, orders), (catalog.verify_repairs_trained, orders + flagged)):
        counting = Counting(spark, fitted.detector)
        result = train.TrainingResult(**{**vars(fitted), "detector": counting})
        monkeypatch.setattr(catalog, "trained", lambda *_: result)
        rows = query(spark, SF).collect()
        assert len({r[catalog.KEY] for r in rows}) <= flagged and rows
        assert orders <= counting.rows.value <= most

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from frames import wear_frame
from rowmend import errors
from rowmend.operators import boosting, explain
from rowmend.plans import train
from rowmend.sources import state

NAMES = ["a", "b", "c"]


def table(spark, x, y, parts=4):
    rows = [(i, int(k), 1.0, *map(float, r)) for i, (r, k) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id int, label int, weight double, a double, b double, c double").repartition(parts)
    return VectorAssembler(inputCols=NAMES, outputCol="vector", handleInvalid="keep").transform(df)


def points(n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 2, (n, 3)), 1)
    return x, np.where(x[:, 0] * x[:, 1] > 1, 7, np.where(x[:, 2] > 0, -2, 3))


def brute(x, y, rounds, depth, step):
    """Margins of the same boosting, every split of every node tried over the values themselves."""
    classes = np.unique(y)
    margins = np.tile(np.log([np.mean(y == k) for k in classes]), (len(x), 1))
    for _ in range(rounds):
        p, added = boosting.shares(margins), np.zeros_like(margins)
        for k, of in enumerate(classes):
            g, h = np.rint(((y == of) - p[:, k]) * 2**20), np.rint(p[:, k] * (1 - p[:, k]) * 2**20)

            def grow(rows, level):
                best = (1e-9, None)
                for j in range(x.shape[1]) if level < depth else ():
                    for cut in np.unique(x[rows, j])[:-1]:
                        left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                        if min(h[left].sum(), h[right].sum()) < 1e-3 * 2**20:
                            continue
                        parts = [g[r].sum() ** 2 / h[r].sum() / 2**20 for r in (left, right, rows)]
                        if parts[0] + parts[1] - parts[2] > best[0] + 1e-9:
                            best = (parts[0] + parts[1] - parts[2], (left, right))
                if best[1] is None:
                    added[rows, k] = step * g[rows].sum() / max(h[rows].sum(), 1e-3 * 2**20)
                else:
                    grow(best[1][0], level + 1)
                    grow(best[1][1], level + 1)

            grow(np.arange(len(x)), 0)
        margins = margins + added
    return margins


def test_equals_brute_force(spark):
    x, y = points(150)
    df = table(spark, x, y)
    model = boosting.fit_softmax_trees(df, "label", "weight", rounds=3, depth=2, step=0.3)
    got = model.transform(df).orderBy("row_id").collect()
    want = brute(x, y, 3, 2, 0.3)
    assert np.allclose([r["rawPrediction"] for r in got], want)
    assert np.allclose([r["probability"] for r in got], boosting.shares(want))
    assert [r["prediction"] for r in got] == [float([-2, 3, 7][k]) for k in want.argmax(axis=1)]


def test_same_trees_for_any_partitioning_and_table_writes(spark, monkeypatch, tmp_path):
    x, y = points(400)
    fit = lambda parts: boosting.fit_softmax_trees(table(spark, x, y, parts), "label", "weight", 4, 3)
    first = fit(1)
    monkeypatch.setattr(boosting, "_ROUNDS_A_TABLE", 2)
    monkeypatch.setattr(boosting, "_ARRAY_BYTES", 1)
    second = fit(5)
    for one, two in zip(sum(first.rounds, []), sum(second.rounds, []), strict=True):
        assert np.array_equal(one.feature, two.feature) and np.array_equal(one.cut, two.cut)
        assert np.allclose(one.value, two.value)
    first.save(spark, str(tmp_path / "model"))
    again = boosting.SoftmaxTrees.load(spark, str(tmp_path / "model"))
    df = table(spark, x, y)
    raw = lambda m: [r["rawPrediction"] for r in m.transform(df).orderBy("row_id").collect()]
    assert raw(first) == raw(again)
    assert first.featureImportances.toArray().sum() == pytest.approx(1.0)


def test_auc_per_class(spark):
    x, y = points(1500)
    held_x, held_y = points(700, seed=9)
    model = boosting.fit_softmax_trees(table(spark, x, y), "label", "weight", 10, 4, 0.4)
    got = np.array([r["probability"] for r in model.transform(table(spark, held_x, held_y)).orderBy("row_id").collect()])
    for k, of in enumerate((-2, 3, 7)):
        good, bad = got[held_y == of, k], got[held_y != of, k]
        assert (good[:, None] > bad).mean() > 0.95


def test_odd_tables(spark):
    x = np.array([[np.nan, np.inf, 1], [1, -np.inf, 1], [np.nan, 0, 1], [2, 0, 1]])
    df = table(spark, x, [5, 5, 9, 9])
    got = boosting.fit_softmax_trees(df, "label", "weight", 2, 2).transform(df)
    assert np.isfinite([r["probability"] for r in got.collect()]).all()
    alone = boosting.fit_softmax_trees(df.filter("label = 9"), "label", "weight", 2, 2)
    assert {r["prediction"] for r in alone.transform(df).collect()} == {9.0}
    assert alone.transform(df.limit(0)).count() == 0
    unlabelled = df.withColumn("label", F.lit(None).cast("int"))
    with pytest.raises(errors.DataError):
        boosting.fit_softmax_trees(unlabelled, "label", "weight")


@pytest.fixture(scope="module")
def levels(spark):
    df = spark.createDataFrame(wear_frame()).withColumn("level", F.col("faulty") + (F.col("hours") > 4000).cast("int"))
    features = ["site", "hours", "overheated", "vibration", "load"]
    return df, train.fit_detector(df, "level", features, "row_id", train.TrainOptions(trees=4, depth=3))


def test_contributions_add_up(spark, levels):
    df, result = levels
    for which in (0, 2):
        rows = explain.attribute_rows(result.detector, df, "row_id", which).groupBy("row_id", "base", "margin").agg(
            F.sum("contribution").alias("total")
        ).collect()
        assert rows and all(r["base"] + r["total"] == pytest.approx(r["margin"]) for r in rows)


def test_state_of_more_classes(spark, levels, tmp_path):
    df, result = levels
    saved = state.load_state(spark, state.save_state(result, str(tmp_path / "state")))
    scores = lambda d: {r["row_id"]: r["pred"] for r in d.score(df).collect()}
    assert scores(saved.detector) == scores(result.detector)


def test_unfinished_save_is_never_read(spark, levels, tmp_path, monkeypatch):
    _, result = levels
    root = str(tmp_path / "state")
    whole = state._text

    def breaks(spark, content):
        if "parts" in content:
            raise RuntimeError("executor lost")
        return whole(spark, content)

    monkeypatch.setattr(state, "_text", breaks)
    with pytest.raises(RuntimeError):
        state.save_state(result, root)
    with pytest.raises(errors.DataError) as problem:
        state.load_state(spark, root)
    assert problem.value.code == errors.FILE_NOT_FOUND
    monkeypatch.setattr(state, "_text", whole)
    state.save_state(result, root)
    first = state._published(spark, root)[0]["folder"]
    monkeypatch.setattr(state, "_text", breaks)
    with pytest.raises(RuntimeError):
        state.save_state(result, root)
    assert state.load_state(spark, root).normal_rows.count() == result.normal_rows.count()
    assert [m["folder"] for m in state._published(spark, root)] == [first]


def test_jobs_add_few_earlier_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(90, 3)), rng.integers(0, 3, 90)
    df = table(spark, x, y)
    most, sums = [], boosting._level_sums
    monkeypatch.setattr(boosting, "_level_sums", lambda *a: most.append(len(a[2])) or sums(*a))
    model = boosting.fit_softmax_trees(df, "label", "weight", 7, 1)
    assert max(most) < 5
    monkeypatch.setattr(boosting, "_ROUNDS_A_TABLE", 100)
    again = boosting.fit_softmax_trees(df, "label", "weight", 7, 1)
    values = lambda m: [t.value.tolist() for r in m.rounds for t in r]
    assert values(again) == values(model)

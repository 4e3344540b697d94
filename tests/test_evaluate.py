from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from rowmend import errors
from rowmend.operators import detect, evaluate
from rowmend.operators.threshold import ThresholdRule, select_threshold


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(3000) < 0.2).astype(int)
    # Many ties, and a third of all rows with one score.
    p = np.round(np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1), 2)
    p[:1000] = 0.4
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                               "row_id int, y int, score double")
    return df.cache(), y, p


def test_auc_equals_the_evaluator(scored):
    df, y, p = scored
    mine = evaluate.roc_auc(df, "y", "score").first()["auc"]
    pos, neg = p[y == 1], p[y == 0]
    pairs = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert mine == pytest.approx(pairs, abs=1e-9)
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(df)
    assert mine == pytest.approx(theirs, abs=1e-6)


def test_auc_needs_two_classes(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, score double")
    assert evaluate.roc_auc(df, "y", "score").first()["auc"] == 0.0


def test_roc_points(scored):
    df, y, p = scored
    got = sorted((r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df, "y", "score").collect())
    steps = [((y[p == t] == 0).sum(), (y[p == t] == 1).sum()) for t in sorted(set(p), reverse=True)]
    wanted, fp, tp = [(0.0, 0.0)], 0, 0
    for i, (neg, pos) in enumerate(steps):
        fp, tp = fp + neg, tp + pos
        # A point between two equal steps lies on a straight line and is left out.
        if i == len(steps) - 1 or steps[i + 1] != (neg, pos):
            wanted.append((round(fp / (y == 0).sum(), 9), round(tp / (y == 1).sum(), 9)))
    assert got == sorted(wanted) and got[-1] == (1.0, 1.0)


def test_threshold_search(scored):
    df, y, p = scored
    got = select_threshold(df, "y", "score").first()
    best = None
    candidates = {0.5, 0.3, 0.4, 0.6, 0.7, *np.quantile(p, np.linspace(0.02, 0.98, 49))}
    for t in sorted(c for c in candidates if 0 <= c <= 1):
        hit = p >= t
        tp = (hit & (y == 1)).sum()
        precision = tp / hit.sum() if hit.sum() else 0.0
        recall = tp / y.sum()
        if precision < 0.5:
            continue
        f = 5 * precision * recall / (4 * precision + recall) if precision + recall else 0.0
        rank = (f, recall, precision, -abs(t - 0.5))
        if best is None or rank > best[0]:
            best = (rank, t)
    assert got["decision_threshold"] == pytest.approx(best[1])
    assert got["selected_fbeta"] == pytest.approx(best[0][0])
    assert got["threshold_rows"] == 3000


def test_threshold_fallbacks(spark, scored):
    df, _, _ = scored
    strict = select_threshold(df, "y", "score", ThresholdRule(min_precision=1.1)).first()
    assert strict["decision_threshold"] == 0.5 and strict["selected_recall"] > 0
    empty = select_threshold(df.filter("false"), "y", "score").first()
    assert (empty["decision_threshold"], empty["selected_fbeta"], empty["threshold_rows"]) == (0.5, 0.0, 0)


def test_published_confusion_matrix(spark):
    rows = [(0, 0)] * 60 + [(0, 1)] * 4 + [(1, 0)] * 9 + [(1, 1)] * 7
    df = spark.createDataFrame(rows, "y int, pred int")
    prf = evaluate.anomaly_prf(df, "y", "pred").first()
    assert [round(v, 4) for v in prf] == [0.6364, 0.4375, 0.5185]
    assert evaluate.accuracy(df, "y", "pred").first()[0] == 0.8375
    cells = {r["cell"]: r["n"] for r in evaluate.confusion_matrix(df, "y", "pred").collect()}
    assert cells == {"TN": 60, "FP": 4, "FN": 9, "TP": 7}


def test_range_and_lookup(spark, scored):
    df, _, _ = scored
    flagged = detect.apply_threshold(df, 0.5)
    part = detect.batch_detect(flagged.repartition(5), "row_id", 10, 19)
    assert sorted(r["sample_id"] for r in part.collect()) == list(range(10, 20))
    ids = spark.createDataFrame([(5,), (99999,)], "row_id int")
    assert detect.lookup_rows(df, ids, "row_id", strict=False).count() == 1
    assert [r[0] for r in detect.unknown_ids(df, ids, "row_id").collect()] == [99999]
    with pytest.raises(errors.DataError) as problem:
        detect.lookup_rows(df, ids, "row_id")
    assert problem.value.details["max_id"] == 2999
    with pytest.raises(errors.DataError):
        detect.detect_filter(part, "some", "row_id", [])


def test_empty_summary(spark):
    df = spark.createDataFrame([], "row_id int, prediction int")
    assert tuple(detect.detect_summary(df).first()) == (0, 0, 0, 0.0)

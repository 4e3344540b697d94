from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import mendable_frame, wear_frame
from rowmend import errors
from rowmend.operators import explain, forest, repair, split
from rowmend.operators.consensus import describe_features
from rowmend.plans import compare, suggest, train
from rowmend.sources import state

RISK = ["site", "hours", "overheated", "retrofitted", "vibration", "load", "oil_grade"]
REPAIR = ["site", "hours", "overheated", "vibration", "oil_grade"]
SMALL = train.TrainOptions(trees=6, depth=3)


@pytest.fixture(scope="module")
def risk(spark):
    df = spark.createDataFrame(wear_frame())
    return df, train.fit_detector(df, "faulty", RISK, "row_id", SMALL)


@pytest.fixture(scope="module")
def ill(spark):
    df = spark.createDataFrame(mendable_frame())
    result = train.fit_detector(df, "faulty", REPAIR, "row_id", SMALL)
    scored = result.detector.score(df.select("row_id", *REPAIR))
    return df, result, scored.filter("pred = 1").cache()


def values(result):
    return {r["metric"]: r["value"] for r in result.metrics.collect()}


def test_training_is_repeatable(spark, risk):
    df, first = risk
    second = train.fit_detector(df.repartition(3), "faulty", RISK, "row_id", SMALL)
    assert values(first) == pytest.approx(values(second))
    assert first.detector.importances() == pytest.approx(second.detector.importances())
    assert {r["row_id"] for r in first.test_rows.collect()} == {r["row_id"] for r in second.test_rows.collect()}


def test_metrics_and_threshold(risk):
    _, result = risk
    found = values(result)
    assert 0.0 <= found["decision_threshold"] <= 1.0
    assert found["decision_threshold"] == pytest.approx(result.detector.threshold)
    for name in ("f1_anomaly", "precision_weighted", "threshold_rows", "auc", "confusion_tp"):
        assert name in found
    assert result.normal_rows.count() > 0
    assert [r["rank"] for r in result.importance.collect()] == list(range(1, len(RISK) + 1))


def test_bad_target(spark, risk):
    with pytest.raises(errors.DataError) as problem:
        train.fit_detector(risk[0], "absent", RISK, "row_id")
    assert problem.value.code == errors.INVALID_TARGET_COLUMN


def test_missing_values_and_text_labels(spark, risk):
    df = risk[0].withColumn("load", F.when(F.col("row_id") % 5 != 0, F.col("load"))).withColumn(
        "oil_grade", F.when(F.col("row_id") % 7 != 0, F.col("oil_grade"))
    ).withColumn("faulty", F.when(F.col("faulty") == 1, "bad").otherwise("good"))
    options = train.TrainOptions(trees=3, depth=3, positive_value="bad", normal_value="good")
    result = train.fit_detector(df, "faulty", RISK, "row_id", options)
    assert "load__gap" in result.detector.inputs
    unseen = df.limit(3).withColumn("site", F.lit("unseen"))
    assert result.detector.score(unseen).filter("score is null").count() == 0


def test_state_round_trip(spark, risk, tmp_path):
    _, result = risk
    path = state.save_state(result, str(tmp_path / "state"))
    saved = state.load_state(spark, path)
    assert saved.detector.threshold == result.detector.threshold
    mine = result.detector.score(result.test_rows).orderBy("row_id").collect()
    theirs = saved.detector.score(saved.test_rows).orderBy("row_id").collect()
    assert [r["score"] for r in mine] == [r["score"] for r in theirs]
    with pytest.raises(errors.DataError) as problem:
        state.load_state(spark, str(tmp_path / "nothing"))
    assert "model" in problem.value.details["missing"]


def test_scoring_accepts_a_stream(spark, risk, tmp_path):
    df, result = risk
    source = str(tmp_path / "rows")
    df.select("row_id", *RISK).write.parquet(source)
    stream = spark.readStream.schema(df.select("row_id", *RISK).schema).parquet(source)
    query = result.detector.score(stream).writeStream.format("memory").queryName("scored_stream").start()
    query.processAllAvailable()
    query.stop()
    batch = result.detector.score(df.select("row_id", *RISK))
    assert spark.table("scored_stream").exceptAll(batch).count() == 0
    assert spark.table("scored_stream").count() == batch.count()


def shapley(nodes, x, width):
    """Shapley values of one tree by enumerating all feature sets."""

    def expected(node, known):
        if node["leftChild"] < 0:
            return node["prediction"]
        split = node["split"]
        left, right = nodes[node["leftChild"]], nodes[node["rightChild"]]
        f = split["featureIndex"]
        if f in known:
            if split["numCategories"] == -1:
                goes_left = x[f] <= split["leftCategoriesOrThreshold"][0]
            else:
                goes_left = x[f] in split["leftCategoriesOrThreshold"]
            return expected(left if goes_left else right, known)
        a, b = left["impurityStats"][0], right["impurityStats"][0]
        return (a * expected(left, known) + b * expected(right, known)) / (a + b)

    result = np.zeros(width)
    for j in range(width):
        others = [i for i in range(width) if i != j]
        for size in range(width):
            chance = factorial(size) * factorial(width - size - 1) / factorial(width)
            for known in combinations(others, size):
                result[j] += chance * (expected(nodes[0], {*known, j}) - expected(nodes[0], set(known)))
    return result


def test_contributions_equal_enumeration(spark, risk):
    df, result = risk
    detector = result.detector
    rows = df.orderBy("row_id").limit(6)
    got = explain.attribute_rows(detector, rows, "row_id").collect()
    by_row = {}
    for r in got:
        by_row.setdefault(r["row_id"], {})[r["feature"]] = r["contribution"]
    vectors = {r["row_id"]: r["vector"].toArray() for r in detector.transform(rows).collect()}
    trees = explain._tree_nodes(detector, spark)
    for row_id, x in vectors.items():
        wanted = sum(w * shapley(nodes, x, len(x)) for w, nodes in trees)
        mine = [by_row[row_id][c] for c in detector.origin]
        assert np.allclose(mine, wanted)
    for r in got[:: len(RISK)]:
        assert r["base"] + sum(by_row[r["row_id"]].values()) == pytest.approx(r["margin"])


def test_top_features_need_no_shuffle(spark, risk):
    df, result = risk
    narrow = explain.top_features_by_row(result.detector, df, "row_id")
    wide = explain.top_positive_features(explain.attribute_rows(result.detector, df, "row_id"), "row_id")
    assert sorted(tuple(r) for r in narrow.collect()) == sorted(tuple(r) for r in wide.collect())


def test_isolation_forest(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(0, 1, (600, 3)), rng.normal(9, 0.5, (12, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "row_id int, a double, b double, c double")
    vectors = train.fit_preparation(df, ["a", "b", "c"], "row_id").transform(df)
    model = forest.fit_isolation_forest(vectors, "row_id", trees=40)
    scored = forest.isolation_scores(model, vectors, "row_id")
    flagged = forest.flag_share(scored, 12 / 612)
    assert {r["row_id"] for r in flagged.filter("pred = 1").collect()} == set(range(600, 612))
    again = forest.fit_isolation_forest(vectors.repartition(5), "row_id", trees=40)
    assert np.array_equal(model.cut, again.cut)


def test_multiclass(spark, risk):
    df = risk[0].withColumn("level", (F.col("faulty") + (F.col("hours") > 4000).cast("int")))
    result = train.fit_detector(df, "level", RISK, "row_id", SMALL)
    found = values(result)
    assert found["auc"] == 0.0 and found["f1"] == found["f1_weighted"]
    assert {r["pred"] for r in result.detector.score(df).collect()} <= {0, 1, 2}


def run(ill, **options):
    _, result, bad = ill
    features = describe_features(result.normal_rows, REPAIR, result.detector.weights())
    report = repair.greedy_repair(
        bad.select("row_id", *REPAIR), result.normal_rows, result.detector.score, features,
        "row_id", "row_id", repair.RepairOptions(**options),
    )
    return report


def test_repair_invariants(spark, ill):
    df, result, _ = ill
    report = run(ill, numeric_bounds={"vibration": {"min": 2.0, "max": 2.5}})
    rows = report.collect()
    assert rows and any(r["summary"]["status"] == "repaired" for r in rows)
    domain = {c: {r[0] for r in result.normal_rows.select(c).collect()} for c in ("site", "oil_grade")}
    for r in rows:
        s, changes = r["summary"], r["changes"]
        assert s["after_score"] <= s["before_score"] + 1e-12
        assert s["applied_changes"] == len(changes) <= 3
        touched = [c["feature"] for c in changes]
        assert len(set(touched)) == len(touched)
        for c in REPAIR:
            if c not in touched:
                assert r[c] == r["original"][c]
            elif c in domain:
                assert r[c] in domain[c]
        if "vibration" in touched:
            assert 2.0 <= r["vibration"] <= 2.5
        for a, b in zip(changes, changes[1:]):
            assert a["after_score"] == b["before_score"]
    again = result.detector.score(report.select("row_id", *REPAIR))
    scores = {r["row_id"]: r["score"] for r in again.collect()}
    assert all(scores[r["row_id"]] == pytest.approx(r["summary"]["after_score"]) for r in rows)
    totals = repair.repair_totals(report).collect()
    assert sum(t["n"] for t in totals) == len(rows)


def test_repair_ignores_partitions(spark, ill):
    df, result, bad = ill
    one = {r["row_id"]: r["changes"] for r in run(ill).collect()}
    other = run((df, result, bad.repartition(11)))
    assert one == {r["row_id"]: r["changes"] for r in other.collect()}


def test_immutable_columns(ill):
    for r in run(ill, immutable_columns=["hours", " vibration "]).collect():
        assert not {"hours", "vibration"} & {c["feature"] for c in r["changes"]}


def test_dry_run_and_normal_rows(spark, ill):
    df, result, _ = ill
    features = describe_features(result.normal_rows, REPAIR, result.detector.weights())
    for options in (repair.RepairOptions(dry_run=True), repair.RepairOptions(max_changes=1)):
        rows = repair.greedy_repair(
            df.select("row_id", *REPAIR), result.normal_rows, result.detector.score, features,
            "row_id", "row_id", options,
        ).collect()
        assert len(rows) == df.count()
        for r in rows:
            if r["summary"]["before_pred"] == 0 or options.dry_run:
                assert r["summary"]["status"] in ("already_normal", "anomaly_detected")
                assert not r["changes"] and all(r[c] == r["original"][c] for c in REPAIR)


def test_options_are_checked():
    for bad in ({"max_changes": 0}, {"max_changes": 21}, {"k_neighbors": 2}, {"k_neighbors": "x"},
                {"immutable_columns": "hours"}, {"numeric_bounds": [1]}):
        with pytest.raises(errors.DataError) as problem:
            repair.RepairOptions(**bad)
        assert problem.value.code == errors.INVALID_INPUT


def test_weights():
    assert repair.feature_weights({"a": 0.0, "b": -1.0}) == {"a": 0.5, "b": 0.5}
    weights = repair.feature_weights({"a": 3.0, "b": 1.0})
    assert sum(weights.values()) == pytest.approx(1.0) and weights["a"] > weights["b"]


def test_suggestions_verify(spark, ill):
    df, result, bad = ill
    detector = result.detector
    found = suggest.suggest_repairs(detector, bad, result.normal_rows, "row_id", "row_id")
    rows = found.collect()
    assert rows and all(r["impact"] > 0 and r["place"] <= 3 for r in rows)
    repaired = suggest.apply_suggestions(bad.select("row_id", *REPAIR), found, "row_id", REPAIR)
    checked = suggest.verify_repairs(bad, detector.score(repaired), "row_id").collect()
    assert len(checked) == bad.count()
    assert any(r["success"] for r in checked)
    for r in checked:
        assert r["success"] == (r["after_pred"] == 0)


def test_repair_loses_no_row(spark, ill):
    _, result, flagged = ill
    rows = flagged.select("row_id", *REPAIR).limit(3)
    twins = rows.unionByName(rows)
    endless = rows.limit(1).withColumn("vibration", F.lit(float("inf"))).withColumn("row_id", F.lit(-1).cast("bigint"))
    samples = twins.unionByName(endless)
    pool = result.normal_rows.unionByName(
        result.normal_rows.limit(1).withColumn("vibration", F.lit(float("inf"))).withColumn("row_id", F.lit(-2).cast("bigint"))
    )
    features = describe_features(pool, REPAIR, result.detector.weights())
    report = repair.greedy_repair(samples, pool, result.detector.score, features, "row_id", "row_id")
    found = sorted(r["row_id"] for r in report.collect())
    assert found == sorted(r["row_id"] for r in samples.collect())


def test_long_paths_are_explained():
    rng = np.random.default_rng(7)
    shares, follows = rng.uniform(0.1, 0.9, 14), rng.random((14, 5)) < 0.6
    got = explain._leaf_values(follows, shares, 2.0)
    for row in range(5):
        game = np.ones(1)
        # Worth of every set of known features, the j-th being known in the upper half.
        for known, share in zip(follows[:, row], shares):
            game = np.concatenate([game * share, game * known])
        sets = np.arange(1 << 14)
        sizes = np.array([bin(s).count("1") for s in sets])
        for j in range(14):
            without = sets[(sets >> j) & 1 == 0]
            chance = np.array([factorial(s) * factorial(13 - s) / factorial(14) for s in sizes[without]])
            wanted = 2.0 * np.sum(chance * (game[without | 1 << j] - game[without]))
            assert got[j, row] == pytest.approx(wanted)


@pytest.mark.parametrize("size", [511, 513, 2001])
def test_any_number_of_categories_is_ranked(spark, size):
    df = spark.range(4 * size).select(
        F.concat(F.lit("v"), (F.col("id") % size).cast("string")).alias("c"),
        (F.col("id") % size >= size // 2).cast("int").alias("y"),
    )
    prepared = train.fit_preparation(df, ["c"], "y")
    ranks = {r["value"]: r["rank"] for r in prepared.ranks.collect()}
    assert sorted(ranks.values()) == [float(i) for i in range(1, size + 1)]
    assert max(ranks[f"v{i}"] for i in range(size // 2)) < min(ranks[f"v{i}"] for i in range(size // 2, size))
    unseen = prepared.transform(spark.createDataFrame([("new",), (None,)], "c string"))
    assert [r["vector"].toArray()[0] for r in unseen.collect()] == [0.0, 0.0]


def test_repairs_by_suggestion_of_repeated_keys(spark, risk):
    """Rows that share a key are repaired one by one: as many rows, and what each gets by itself."""
    df, result = risk
    flagged = result.detector.score(df).filter("pred = 1").select("row_id", *RISK).limit(12)
    other = flagged.withColumn("hours", F.col("hours") + 500)
    both = flagged.unionByName(other)
    apart = flagged.unionByName(other.withColumn("row_id", F.col("row_id") + 100_000))
    columns = [*RISK, "before_score", "after_score", "success"]
    found = [
        sorted((r["row_id"] % 100_000, *[r[c] for c in columns]) for r in suggest.repair_by_suggestions(
            result.detector, rows, result.normal_rows, "row_id", "row_id").collect())
        for rows in (both, apart)
    ]
    assert len(found[0]) == both.count() and found[0] == found[1]


def test_scores_of_baselines_are_made_once(spark, risk):
    """Measures read stored scores: none joins, prepares or scores the test rows again."""
    df, _ = risk
    scored, seconds = compare.baseline_scores(df, "faulty", RISK, "row_id", tuned={"maxIter": 2})
    assert set(scored) == set(seconds) == {"boosted_trees", "random_forest", "logistic_regression", "isolation_forest"}
    held = split.random_split(df, "row_id", 0.2, 42).filter("not is_train")
    ids = sorted(r["row_id"] for r in held.select("row_id").collect())
    for rows in scored.values():
        assert sorted(r["row_id"] for r in rows.collect()) == ids
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" in plan and "vector" not in plan and "UDF" not in plan

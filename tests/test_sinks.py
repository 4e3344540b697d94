from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rowmend import parallel, storage
from rowmend.operators import profile, repair
from rowmend.operators.consensus import describe_features
from rowmend.plans import compare
from rowmend.sources import sinks
from rowmend.sources.csv import csv_scan


def score(df):
    """Rises with ``x``, and more for red rows."""
    points = F.least(F.lit(1.0), F.col("x") / 10 + F.when(F.col("color") == "red", 0.3).otherwise(0.0))
    return df.withColumn("score", points).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


@pytest.fixture(scope="module")
def report(spark):
    pool = spark.createDataFrame([(i, "blue", 1.0 + i % 3) for i in range(30)], "row_id int, color string, x double")
    bad = spark.createDataFrame([(100, "red", 4.0), (101, "red", 9.0), (102, "blue", 1.0)], pool.schema)

    def run(**options):
        return repair.greedy_repair(
            bad, pool, score, describe_features(pool, ["color", "x"]), "row_id", "row_id",
            repair.RepairOptions(**options),
        )

    return run


def test_small_repair_by_hand(report):
    got = {r["row_id"]: r for r in report().collect()}
    # 0.7 to 0.4 by the color alone; x can drop by 0.2 at most and stay above 0.5.
    assert [c["feature"] for c in got[100]["changes"]] == ["color"]
    assert got[100]["summary"]["status"] == "repaired" and got[100]["color"] == "blue"
    # 1.0 at first: x to 3 gives 0.6, then the color 0.3.
    assert [c["feature"] for c in got[101]["changes"]] == ["x", "color"]
    assert got[101]["changes"][0]["after_score"] == pytest.approx(0.6)
    assert got[102]["summary"]["status"] == "already_normal"
    partly = {r["row_id"]: r["summary"]["status"] for r in report(immutable_columns=["x"]).collect()}
    assert partly == {100: "repaired", 101: "partially_repaired", 102: "already_normal"}
    stuck = {r["row_id"]: r["summary"]["status"] for r in report(immutable_columns=["x", "color"]).collect()}
    assert stuck[101] == "not_repaired"


def test_report_files(spark, report, tmp_path):
    paths = sinks.write_repair_report(report(), str(tmp_path / "out"), "row_id")
    rows = csv_scan(spark, paths["repaired_rows"])
    assert rows.columns == ["row_id", "color", "x"] and rows.count() == 3
    lines = [json.loads(r["value"]) for r in spark.read.text(paths["report"]).collect()]
    assert {line["summary"]["status"] for line in lines} == {"repaired", "already_normal"}
    changes = csv_scan(spark, paths["changes"])
    assert {"feature", "before", "after", "score_delta"} <= set(changes.columns)
    assert sinks.write_repair_report(report(dry_run=True), str(tmp_path / "dry"), "row_id") == {}
    assert not (tmp_path / "dry").exists()


def test_anomalies_only(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "Anomaly"), (2, 0, "Normal")], "row_id int, prediction int, status string")
    path = sinks.write_scored_csv(df, str(tmp_path / "bad"), anomalies_only=True)
    assert [tuple(r) for r in csv_scan(spark, path).collect()] == [(1, 1, "Anomaly")]


def test_comparison_file(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.16), (1, 0.15)], "label int, score double")
    flagged = compare.fixed_cutoff(df)
    # The cut-off is strict: 0.15 itself is not flagged.
    assert flagged.filter("pred = 1").count() == 2
    wide = compare.compare_scores({"rule": flagged}, "label", {"rule": 1.5})
    row = wide.first()
    assert (row["accuracy"], row["f1"], row["seconds"], row["auc"]) == (0.5, 0.5, 1.5, 0.5)
    path = sinks.write_comparison(compare.long_comparison(wide), str(tmp_path / "cmp"))
    assert csv_scan(spark, path).count() == 5


def test_column_kinds(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "i int, s string, d double")
    got = {r["column"]: r["kind"] for r in profile.column_kinds(df).collect()}
    assert got == {"i": "numeric", "s": "categorical", "d": "numeric"}


def test_small_inputs_are_spread(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(200_000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert 1 < parallel.spread(df, "id").rdd.getNumPartitions() <= parallel.tasks(spark)
    assert storage.shared_dir(spark) == spark.sparkContext.getCheckpointDir()

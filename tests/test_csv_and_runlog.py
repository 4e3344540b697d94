from __future__ import annotations

import pytest

from rowmend import errors
from rowmend.operators import runlog
from rowmend.sources import manifests, snapshot
from rowmend.sources.csv import csv_scan, normalise_columns


def test_header_rules():
    assert normalise_columns(["﻿id", " name ", "stroke", "stroke", ""]) == [
        (0, "id"), (1, "name"), (2, "stroke"), (4, "column_5")
    ]


def test_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id, name ,bmi,stroke,stroke,\n1,N/A,20.5,0,x,\n2,bob,NA,1,y,z\n3,eve,7,0,x,\n")
    df = csv_scan(spark, str(path))
    assert df.dtypes == [
        ("id", "bigint"), ("name", "string"), ("bmi", "double"), ("stroke", "bigint"), ("column_6", "string")
    ]
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [(1, None, 20.5, 0, None), (2, "bob", None, 1, "z"), (3, "eve", 7.0, 0, None)]


def test_declared_schema(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b\n1,x\nbad,y\n")
    rows = csv_scan(spark, str(path), spark.createDataFrame([], "a int, b string, c double").schema).collect()
    assert sorted(rows, key=str) == sorted([(1, "x", None), (None, "y", None)], key=str)


def test_unreadable_files(spark, tmp_path):
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(errors.DataError) as problem:
        csv_scan(spark, str(empty))
    assert problem.value.code == errors.CSV_READ_FAILED
    with pytest.raises(errors.DataError) as problem:
        csv_scan(spark, str(tmp_path / "absent.csv"))
    assert problem.value.code == errors.FILE_NOT_FOUND


def test_run_log(spark):
    log = spark.createDataFrame(
        [("a", 1, 10, "pending"), ("a", 2, 20, "done"), ("b", 1, 30, "pending"), ("c", 1, 5, "failed")],
        "id string, seq int, updated long, status string",
    )
    latest = runlog.latest_per_key(log, "id", "updated", "seq")
    assert sorted((r["id"], r["status"]) for r in latest.collect()) == [("a", "done"), ("b", "pending"), ("c", "failed")]
    kept = runlog.keep_recent_n(latest, "id", "updated", 2)
    assert [r["id"] for r in kept.collect()] == ["b", "a"]
    assert runlog.keep_recent_n(latest, "id", "updated", 0).count() == 3
    assert runlog.lookup_by_key(log, "id", "zzz").count() == 0
    assert "TakeOrderedAndProject" in kept._jdf.queryExecution().executedPlan().toString()
    assert runlog.recent_n(log, "updated", -1).count() == 4


def test_quoted_text_and_long_records(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('a,t,v\n1,"say ""hi"", you",3\n2,"two\nlines",4\n3,short\n')
    rows = [tuple(r) for r in csv_scan(spark, str(path)).orderBy("a").collect()]
    assert rows == [(1, 'say "hi", you', 3), (2, "two\nlines", 4), (3, "short", None)]
    path.write_text('a,t\n1,x\n2,"y,z",\n3,p,q\n')
    with pytest.raises(errors.DataError):
        csv_scan(spark, str(path))


LOG = "id string, seq int, updated long, status string"


def test_increments_equal_the_full_recomputation(spark, tmp_path):
    rows = [(None if i % 11 == 0 else f"k{i * i % 40}", i, (i * 37) % 50, f"s{i}") for i in range(300)]
    path = str(tmp_path / "snapshot")
    for start in (200, 0, 100):
        part = spark.createDataFrame(rows[start : start + 100] + rows[start : start + 3], LOG)
        assert snapshot.upsert(spark, path, part, "id", "updated", "seq", buckets=7) > 0
    want = runlog.latest_per_key(spark.createDataFrame(rows, LOG), "id", "updated", "seq")
    assert sorted(map(tuple, snapshot.read(spark, path).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert snapshot.give_back_superseded(spark, path) > 0
    assert snapshot.read(spark, path).count() == want.count()


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    nothing = spark.createDataFrame([], LOG)
    assert snapshot.upsert(spark, path, nothing, "id", "updated", "seq", buckets=50) == 0
    assert snapshot.read(spark, path).count() == 0
    snapshot.upsert(spark, path, spark.range(500).selectExpr("string(id) id", "1 seq", "id updated", "'new' status"), "id", "updated", "seq")
    before = manifests.published(spark, path)[0]["places"]
    one = spark.createDataFrame([("7", 2, 99, "done")], LOG)
    assert snapshot.upsert(spark, path, one, "id", "updated", "seq") == 1
    after = manifests.published(spark, path)[0]["places"]
    assert len(before) == 50 and sum(before[b] != after[b] for b in before) == 1
    assert snapshot.upsert(spark, path, nothing, "id", "updated", "seq") == 0
    table = snapshot.read(spark, path)
    assert table.count() == 500 and table.filter("status = 'done'").first()["id"] == "7"


def test_an_increment_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snapshot")
    with pytest.raises(errors.DataError):
        snapshot.read(spark, path)
    snapshot.upsert(spark, path, spark.createDataFrame([("a", 1, 1, "x")], LOG), "id", "updated", "seq", buckets=4)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(manifests, "publish", broken)
        with pytest.raises(RuntimeError):
            snapshot.upsert(spark, path, spark.createDataFrame([("a", 2, 2, "y")], LOG), "id", "updated", "seq")
    assert [tuple(r) for r in snapshot.read(spark, path).collect()] == [("a", 1, 1, "x")]
    with pytest.raises(errors.DataError):
        snapshot.upsert(spark, path, spark.createDataFrame([("a", 1)], "id string, seq int"), "id", "seq", "seq")

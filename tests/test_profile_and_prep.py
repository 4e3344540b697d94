from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import wear_frame
from rowmend import errors
from rowmend.functions import kinds, values
from rowmend.operators import prep, profile, split
from rowmend.operators.consensus import numeric_scales
from rowmend.operators.ordering import dense_positions
from rowmend.operators.quantiles import exact_quantiles


def test_target_checks_in_order(spark):
    def code(rows, schema, column="y"):
        return profile.target_check(spark.createDataFrame(rows, schema), column, strict=False).first()

    continuous = code([(18.5 + 0.1 * i,) for i in range(40)], "y double")
    assert continuous["code"] == errors.UNSUPPORTED_TARGET_TYPE and continuous["unique_count"] == 40
    gap = code([(0,), (1,), (None,), (0,), (1,)], "y int")
    assert (gap["code"], gap["missing_count"]) == (errors.INVALID_INPUT, 1)
    assert code([(1,), (1,)], "y int")["reason"] == "target has fewer than two classes"
    assert code([(1,), (1,), (0,)], "y int")["min_class_count"] == 1
    assert code([("a",), ("a",), ("b",), ("b",)], "y string")["code"] == "OK"
    # Many integer classes are fine while they are a small share of the rows.
    assert code([(i % 30,) for i in range(300)], "y int")["code"] == "OK"
    with pytest.raises(errors.DataError) as problem:
        profile.target_check(spark.createDataFrame([(1,)], "a int"), "faulty")
    assert problem.value.code == errors.INVALID_TARGET_COLUMN
    with pytest.raises(errors.DataError) as problem:
        profile.target_check(spark.createDataFrame([(0,), (1,), (None,)], "y int"), "y")
    assert problem.value.details["missing_count"] == 1


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    report = {r["column"]: (r["missing_count"], r["missing_percent"]) for r in profile.missing_report(df).collect()}
    assert report == {"x": (2, 66.67), "s": (1, 33.33)}
    assert profile.table_overview(df).first()["missing_cells"] == 3


def test_bracketed_quantiles_equal_sorting(spark):
    rng = np.random.default_rng(3)
    # A third of the rows share one value.
    a = np.concatenate([rng.normal(0, 1, 20_000), np.full(10_000, 0.25)])
    b = rng.integers(0, 50, 30_000).astype(float)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double")
    probs = [0.0, 0.02, 0.05, 0.25, 0.5, 0.75, 0.95, 0.98, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs)
    assert np.allclose(got["a"], np.quantile(a, probs))
    assert np.allclose(got["b"], np.quantile(b, probs))
    for n in (1, 2, 3, 7, 101, 5_003):
        short = exact_quantiles(spark.createDataFrame([(float(v),) for v in a[:n]], "a double"), ["a"], [0.01, 0.3, 0.5, 0.7, 0.99])
        assert np.allclose(short["a"], np.quantile(a[:n], [0.01, 0.3, 0.5, 0.7, 0.99]))


def test_numeric_scale_fallbacks(spark):
    rows = [(5.0, 1.0, None)] * 98 + [(9.0, 1.0, None)] * 2
    df = spark.createDataFrame(rows, "a double, b double, c double")
    assert numeric_scales(df, {"a": False, "b": False, "c": False}) == {"a": 4.0, "b": 1.0, "c": 1.0}


def test_discrete_rule(spark):
    df = spark.createDataFrame(
        [(i % 12, i % 13, float(i % 2), "x", i % 2 == 0) for i in range(200)],
        "a int, b int, c double, d string, e boolean",
    )
    assert kinds.discrete_flags(df, df.columns) == {"a": True, "b": False, "c": False, "d": True, "e": True}
    assert kinds.discrete_flags(df, ["b"], {"b": True}) == {"b": True}


def test_label_codes_follow_the_values(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, "z")], "row_id int, s string")
    got = {r["row_id"]: r["s_idx"] for r in prep.label_encode(df, ["s"]).collect()}
    assert got == {3: 0, 1: 1, 4: 1, 2: 2, 5: 3}


def test_one_hot_of_many_values(spark):
    df = spark.range(2001).selectExpr("id", "cast(id as string) as s")
    assert len(prep.one_hot(df, ["s"]).columns) == 2001
    long = prep.one_hot_long(df.unionByName(spark.sql("select 9999L as id, cast(null as string) as s")), "id", ["s"])
    assert long.count() == 2001


def test_sparse_one_hot_of_many_values(spark, monkeypatch):
    df = spark.range(100_001).selectExpr("id", "lpad(cast(id as string), 6, '0') as s", "if(id % 3 = 0, null, id % 3) as r")
    for limit in (prep.BROADCAST_BYTES, 0):
        monkeypatch.setattr(prep, "BROADCAST_BYTES", limit)
        rows, places = prep.one_hot_sparse(df, ["s", "r"])
        # Column r comes first: its value 1 has no flag, 2 has flag 0; of s the first value has none.
        assert rows.columns == ["id", "flags"] and places.count() == 100_001
        wrong = rows.filter("flags != if(id % 3 = 2, array(0L), array()) || if(id = 0, array(), array(id))")
        assert rows.count() == 100_001 and wrong.count() == 0
    empty, places = prep.one_hot_sparse(df.limit(0), ["s"])
    assert empty.count() == 0 and places.count() == 0


def test_class_weights_of_missing_labels(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "row_id int, y int")
    got = {r["row_id"]: r["class_weight"] for r in prep.class_weights(df, "y").collect()}
    assert got == {1: 0.75, 2: 0.75, 3: 1.5, 4: None}


def test_constant_column_is_only_centred(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["x_z"] for r in prep.standardise(df, ["x"]).collect()] == [0.0, 0.0]


def test_means_come_from_the_training_rows(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    df = spark.createDataFrame([(None,), (10.0,)], "x double")
    assert sorted(r["x"] for r in prep.mean_impute(df, ["x"], train).collect()) == [2.0, 10.0]


def test_split_is_exact_and_ignores_partitions(spark):
    df = spark.createDataFrame(wear_frame(500)).select("row_id", "faulty")
    counts = {r["faulty"]: r["count"] for r in df.groupBy("faulty").count().collect()}

    def parts(frame):
        rows = split.stratified_split(frame, "faulty", "row_id").collect()
        return {r["row_id"] for r in rows if r["is_train"]}, rows

    first, rows = parts(df)
    assert first == parts(df.repartition(7))[0]
    assert len(first) == 400
    wanted = split.class_shares(counts, 0.2)
    for label, n in wanted.items():
        assert sum(1 for r in rows if r["is_train"] and r["faulty"] == label) == n
        assert abs(n - 0.8 * counts[label]) < 1


def test_too_small_classes(spark):
    df = spark.createDataFrame([(i, 0) for i in range(10)] + [(99, 1)], "row_id int, y int")
    with pytest.raises(errors.DataError):
        split.stratified_split(df, "y", "row_id")
    assert split.validation_split(df, "y", "row_id").filter("is_fit").count() == 11


def test_healthy_pool_falls_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id int, y string")
    assert prep.healthy_pool(df, "y", "ok").count() == 2
    assert prep.healthy_pool(df, "y", "a").count() == 1


def test_dense_positions(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as v", "id").repartition(9)
    got = dense_positions(df, ["v"], "position").collect()
    assert sorted((r["v"], r["position"]) for r in got) == [(i, i) for i in range(1000)]


def test_value_rules(spark):
    df = spark.createDataFrame([(0.5, 3), (1.5, 3), (None, 3)], "x double, now int")
    got = [
        r[0] for r in df.select(values.cast_like(F.col("x"), df.schema["now"].dataType, F.col("now"))).collect()
    ]
    assert got == [0, 2, 3]
    clipped = df.select(values.clip_bounds(F.col("x"), {"min": "0.7", "max": "high"})).collect()
    assert [r[0] for r in clipped] == [0.7, 1.5, None]
    assert values.clamp_threshold("x") == 0.5 and values.clamp_threshold(7) == 1.0
    times = spark.createDataFrame([(0,), (1700000000123,)], "ms long")
    back = times.select(values.epoch_ms(values.from_epoch_ms(F.col("ms"))).alias("ms")).collect()
    assert [r["ms"] for r in back] == [0, 1700000000123]


@pytest.mark.parametrize("plan_values, broadcast_bytes", [(64, 1 << 20), (0, 1 << 20), (0, 0)])
def test_look_up_by_every_way(spark, monkeypatch, plan_values, broadcast_bytes):
    monkeypatch.setattr(prep, "PLAN_VALUES", plan_values)
    monkeypatch.setattr(prep, "BROADCAST_BYTES", broadcast_bytes)
    rows = [("a" if i % 3 else f"v{i % 7}", None if i % 2 else "x", i) for i in range(200)]
    df = spark.createDataFrame(rows, "one string, two string, n int")
    known = [("one", "a", 5), ("one", "v0", 6), ("two", "x", 7), ("three", "x", 8)]
    table = prep.value_table(spark.createDataFrame(known, "column string, value string, number int"), "number")
    found = prep.look_up(df, table, {c: F.col(c) for c in ("one", "two")}, {"one": "p", "two": "q"})
    assert found.columns == ["one", "two", "n", "p", "q"] or found.columns == ["one", "two", "n", "q", "p"]
    numbers = {(c, v): n for c, v, n in known}
    want = [(*row, numbers.get(("one", row[0])), numbers.get(("two", row[1]))) for row in rows]
    assert sorted(map(tuple, found.select("one", "two", "n", "p", "q").collect()), key=str) == sorted(want, key=str)
    assert prep.look_up(df.limit(0), table, {"one": F.col("one")}, {"one": "p"}).count() == 0


def test_a_frequent_value_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(prep, "BROADCAST_BYTES", 0)
    df = spark.range(0, 60_000, 1, 16).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("c"), "id")
    known = spark.range(0, 60_000, 2).select(F.lit("c").alias("column"), F.col("id").cast("string").alias("value"), F.col("id").alias("number"))
    table = prep.value_table(known, "number")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = prep.look_up(df, table, {"c": F.col("c")}, {"c": "p"}).cache()
        assert found.count() == 60_000 and found.filter("p is not null").count() == 20_000
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]

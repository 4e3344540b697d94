from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmend.operators import detect, selection
from rowmend.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
INF = float("inf")


def columns():
    rng = np.random.default_rng(5)
    return {
        "plain": rng.normal(0, 1e3, 500).tolist(),
        "wide": [float(s * 10.0**e) for s, e in zip(rng.choice([-1, 1], 500), rng.uniform(-320, 308, 500))],
        "copies": rng.choice([-1.5, 0.0, 2.0, 2.0000000000000004], 500).tolist(),
        "ends": [INF] * 40 + [-INF] * 40 + rng.random(420).tolist(),
        "tiny": [5e-324 * k for k in rng.integers(0, 50, 500)],
        "edges": [float(2.0**e) for e in rng.integers(-1074, 1024, 250)] + [float(np.nextafter(2.0**e, 0)) for e in rng.integers(-1000, 1024, 250)],
        "single": [7.25] + [None] * 499,
        "none": [None] * 500,
        "gaps": [None if i % 3 else float("nan") if i % 5 == 0 else i / 7 for i in range(500)],
        "close": (1.0 + np.arange(500) * 2.0**-52).tolist(),
    }


@pytest.fixture(scope="module")
def table(spark):
    data = columns()
    rows = [tuple(None if v is None else float(v) for v in row) for row in zip(*data.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)


def plain(values, p):
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    if not known:
        return None
    at = (len(known) - 1) * p
    low, high, share = known[math.floor(at)], known[math.ceil(at)], at - math.floor(at)
    return low if low == high else (1 - share) * low + share * high


def test_quantiles_equal_sorting(table):
    data = columns()
    found = exact_quantiles(table, list(data), PROBS)
    for name, values in data.items():
        for p, got in zip(PROBS, found[name]):
            want = plain(values, p)
            assert got == want or (got is not None and math.isnan(got) and math.isnan(want)), (name, p, got, want)


def test_digits_keep_the_order(table):
    for name in ("plain", "wide", "ends", "tiny", "edges", "close", "copies"):
        df = table.select(F.col(name).alias("value"), F.col(name).alias("v"))
        for level in range(selection.DIGITS):
            df = selection.double_digit(df, level).withColumnRenamed("digit", f"d{level}")
        rows = df.select("v", F.array("d0", "d1", "d2", "d3").alias("d")).collect()
        by_digits = [r["v"] for r in sorted(rows, key=lambda r: r["d"])]
        assert by_digits == sorted(by_digits)
        assert len({tuple(r["d"]) for r in rows}) == len({r["v"] for r in rows})


def test_ranks_of_integers(spark):
    values = [-(2**63), 2**63 - 1, 0, -1, *([5] * 50), *range(100_000, 100_300), 2**40]
    df = spark.createDataFrame([(v,) for v in values], "k long")
    ordered = sorted(values)
    ranks = [0, 1, 2, 3, 10, 52, 53, 54, 200, len(values) - 2, len(values) - 1]
    hits = selection.values_at(df, "k", [*ranks, len(values)], ordered[0], ordered[-1])
    assert [h.value for h in hits[:-1]] == [ordered[r] for r in ranks]
    assert [h.below for h in hits[:-1]] == [ordered.index(ordered[r]) for r in ranks]
    assert hits[-1] is None


@pytest.mark.parametrize("start,end", [(0, 4), (3, 3), (45, 60), (10, None), (None, 7), (90, 400), (200, 300), (5, 2)])
def test_row_range_equals_numbering_all_rows(spark, start, end):
    keys = [7 * (i // 3) for i in range(100)]
    df = spark.createDataFrame([(k, float(i % 2), i % 2) for i, k in enumerate(keys)], "k int, score double, pred int")
    found = detect.batch_detect(df, "k", start, end).select("sample_id", "k").orderBy("sample_id").collect()
    want = [(i, k) for i, k in enumerate(sorted(keys)) if (start or 0) <= i <= (end if end is not None else 1000)]
    assert [tuple(r) for r in found] == want


def test_row_range_reads_only_the_range(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20_000).selectExpr("id * 3 as k", "rand(1) as score", "1 as pred").write.parquet(path)
    found = detect.batch_detect(spark.read.parquet(path), "k", 100, 120)
    assert [r["k"] for r in found.orderBy("sample_id").collect()] == [3 * i for i in range(100, 121)]
    hits = selection.values_at(spark.read.parquet(path), "k", [100, 120], 0, 59_997)
    assert [h.value for h in hits] == [300, 360]


def test_row_range_of_other_keys(spark):
    df = spark.createDataFrame([(k, 0.1, 0) for k in ["b", "a", None, "d", "c"]], "k string, score double, pred int")
    assert [r["k"] for r in detect.batch_detect(df, "k", 1, 2).orderBy("sample_id").collect()] == ["a", "b"]
    gaps = spark.createDataFrame([(k, 0.1, 0) for k in [3, None, 1]], "k int, score double, pred int")
    assert [r["k"] for r in detect.batch_detect(gaps, "k", 0, 1).orderBy("sample_id").collect()] == [None, 1]

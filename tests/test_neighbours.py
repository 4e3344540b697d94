from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from rowmend.functions.kinds import Feature
from rowmend.operators import neighbours
from rowmend.operators.consensus import gower_index


def make(rows, seed, copies=0.0, gaps=0.0):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({
        "key": np.arange(rows),
        "color": rng.choice(["red", "green", "blue", "black"], rows),
        "city": [f"c{v}" for v in rng.integers(0, 150, rows)],
        "grade": rng.integers(0, 5, rows),
        "x": rng.normal(0, 1, rows).round(2),
        "y": rng.exponential(2, rows).round(2),
    })
    same = int(copies * rows)
    if same:
        for c in df.columns[1:]:
            df.loc[: same - 1, c] = df.loc[0, c]
    if gaps:
        for c in ("color", "x", "y"):
            df.loc[rng.random(rows) < gaps, c] = None
    return df


SCHEMA = "key long, color string, city string, grade int, x double, y double"
FEATURES = [
    Feature("color", True, 1.0), Feature("city", True, 0.3), Feature("grade", True, 0.5),
    Feature("x", False, 2.0, 3.1), Feature("y", False, 1.0, 5.7),
]


def frame(spark, df):
    records = df.astype(object).where(df.notna(), None)
    return spark.createDataFrame(list(records.itertuples(index=False, name=None)), SCHEMA)


def brute(queries, pool, features, k, scale=None):
    """All distances, sorted by distance and key."""
    rows = []
    total_weight = 0.0
    for f in features:
        total_weight += f.weight
    for _, q in queries.iterrows():
        total = np.zeros(len(pool))
        for f in features:
            a, b = q[f.name], pool[f.name]
            if f.discrete:
                term = np.where(b.isna(), pd.notna(a), b.to_numpy() != a).astype(float)
            elif pd.isna(a):
                term = np.ones(len(pool))
            else:
                divisor = f.scale if scale is None else scale(f.name, a)
                term = np.abs(b.to_numpy(dtype=float) - a) / divisor if divisor else np.zeros(len(pool))
                term = np.where(b.isna(), 1.0, term)
            total += f.weight * term
        order = np.lexsort((pool["key"], total / total_weight))[:k]
        for rank, i in enumerate(order, 1):
            rows.append((int(q["key"]), int(pool["key"].iloc[i]), rank, (total / total_weight)[i]))
    return rows


def found(spark, index, queries, **options):
    rows = neighbours.nearest(index, queries, "key", **options).collect()
    return sorted((r["key"], r["pool_id"], r["rank"], r["distance"]) for r in rows)


def agree(got, wanted):
    wanted = sorted(wanted)
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert np.allclose([g[3] for g in got], [w[3] for w in wanted])


@pytest.mark.parametrize("copies,gaps,limit", [(0.0, 0.0, 1 << 20), (0.4, 0.1, 1 << 20), (0.4, 0.1, 0)])
def test_equals_brute_force(spark, monkeypatch, copies, gaps, limit):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "HOT_QUERIES", 5)
    pool, queries = make(900, 1, copies, gaps), make(120, 2, copies, gaps)
    queries.loc[0, "color"] = "never seen"
    index = neighbours.build_index(frame(spark, pool), FEATURES, "key", 7, rows_per_cell=10)
    assert len(index.splits) >= 2
    got = found(spark, index, frame(spark, queries), broadcast_bytes=limit)
    agree(got, brute(queries, pool, FEATURES, 7))


@pytest.mark.parametrize("numeric", [True, False])
def test_dense_cell_is_cut(spark, monkeypatch, numeric):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(12)
    pool, queries = make(1200, 10, gaps=0.05), make(60, 11)
    # Half of the pool and of the queries are near-copies within one cell.
    for df, dense in ((pool, 600), (queries, 30)):
        df.loc[: dense - 1, ["color", "city", "grade"]] = ["red", "c1", 1]
        df.loc[: dense - 1, "x"] = rng.normal(0.3, 0.01, dense).round(4)
        df.loc[: dense - 1, "y"] = rng.normal(0.7, 0.001, dense).round(5)
    features = FEATURES if numeric else [
        Feature(f.name, f.discrete, f.weight if f.discrete else 0.0, f.scale) for f in FEATURES
    ]
    index = neighbours.build_index(frame(spark, pool), features, "key", 4, rows_per_cell=100)
    assert (index.cells["part"].max() > 0) == numeric
    assert index.cells["pieces"].max() > 1
    for limit in (1 << 20, 0):
        got = found(spark, index, frame(spark, queries), broadcast_bytes=limit)
        agree(got, brute(queries, pool, features, 4))


def test_empty_pieces_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 1)
    pool, queries = make(60, 13), make(30, 14)
    index = neighbours.build_index(frame(spark, pool), FEATURES, "key", 3)
    assert not index.cells["whole"].all()
    agree(found(spark, index, frame(spark, queries)), brute(queries, pool, FEATURES, 3))


def test_lopsided_weights_and_small_pool(spark):
    features = [Feature(f.name, f.discrete, w, f.scale) for f, w in zip(FEATURES, (1e-6, 1e-6, 0.0, 0.9, 0.1))]
    pool, queries = make(300, 3), make(60, 4)
    index = neighbours.build_index(frame(spark, pool), features, "key", 5, rows_per_cell=5)
    agree(found(spark, index, frame(spark, queries)), brute(queries, pool, features, 5))
    tiny = pool.head(4)
    index = neighbours.build_index(frame(spark, tiny), features, "key", 9)
    agree(found(spark, index, frame(spark, queries)), brute(queries, tiny, features, 9))


def test_gower_range_reaches_the_query(spark):
    pool, queries = make(400, 5), make(40, 6)
    queries.loc[:5, "x"] = 50.0
    names = ["color", "city", "grade", "x", "y"]
    index = gower_index(frame(spark, pool), names, "key", 5)
    features = [Feature(n, n in ("color", "city"), 1.0) for n in names]

    def scale(name, value):
        return max(pool[name].max(), value) - min(pool[name].min(), value)

    agree(found(spark, index, frame(spark, queries)), brute(queries, pool, features, 5, scale))


def test_neighbour_carries_values(spark):
    pool, queries = make(200, 8), make(10, 9)
    index = neighbours.build_index(frame(spark, pool), FEATURES, "key", 3)
    for r in neighbours.nearest(index, frame(spark, queries), "key").collect():
        row = pool[pool.key == r["pool_id"]].iloc[0]
        assert r["neighbour"].asDict() == {c: row[c] for c in ("color", "city", "grade", "x", "y")}


def test_plan_prunes_before_the_last_shuffle(spark):
    index = neighbours.build_index(frame(spark, make(200, 8)), FEATURES, "key", 3)
    plan = neighbours.nearest(index, frame(spark, make(10, 9)), "key")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture
def shuffled_joins(spark):
    """Joins that Spark would broadcast or coalesce at this size stay shuffles of eight partitions."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in held.items():
        spark.conf.set(name, value)
    yield
    for name in held:
        spark.conf.unset(name)


def test_hot_blocks_are_met_by_many_tasks(spark, shuffled_joins):
    """A third of all visits go to one block: no task gets three times the median, no visit is lost or doubled."""
    from pyspark.sql import functions as F

    packed = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 61).cast("int").alias("cell"), F.lit(0).alias("chunk"),
        F.array(F.struct("id")).alias("query_rows"),
    ).repartition(16)
    blocks = spark.range(61).select(F.col("id").cast("int").alias("cell"), F.lit(0).alias("chunk"), F.array("id").alias("pool_rows"))
    met = neighbours._meet(packed, blocks, False, 8)
    assert met.count() == 6000 and met.select("query_rows").distinct().count() == 6000
    assert met.filter("cell <> pool_rows[0]").isEmpty()
    per_task = sorted(r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect())
    assert len(per_task) == 8 and per_task[-1] < 3 * per_task[4]


def test_a_third_of_pool_and_queries_in_one_cell(spark, shuffled_joins, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    pool, queries = make(900, 31), make(240, 32)
    for df in (pool, queries):
        third = len(df) // 3
        df.loc[: third - 1, ["color", "city", "grade"]] = ["red", "c1", 2]
        df.loc[: third - 1, "x"] = (df.loc[: third - 1, "x"] / 50).round(4)
    index = neighbours.build_index(frame(spark, pool), FEATURES, "key", 5, rows_per_cell=40)
    agree(found(spark, index, frame(spark, queries), broadcast_bytes=0), brute(queries, pool, FEATURES, 5))


def grid(spark, stretch=False):
    """An index of many cells with gaps in it, and queries as tasks see them."""
    pool = frame(spark, make(1500, 31, gaps=0.1))
    ranges = {"x": (-1.0, 2.0), "y": (0.0, 0.0)} if stretch else None
    index = neighbours.build_index(pool, FEATURES, "key", 3, stretch_ranges=ranges, rows_per_cell=8)
    queries = frame(spark, make(60, 32, gaps=0.1))
    for split in index.splits:
        if split.name in ("color", "city", "grade"):
            queries = queries.withColumn(f"bucket_{split.name}", neighbours._bucket(split, queries.schema[split.name].dataType))
    task = neighbours._Task(index.features, tuple(s.name for s in index.splits), stretch, ranges or {}, 3)
    return index, task, queries


@pytest.mark.parametrize("stretch", [False, True])
def test_bound_of_a_group_is_below_that_of_its_queries(spark, stretch):
    index, task, queries = grid(spark, stretch)
    rows = queries.toArrow().combine_chunks().to_batches()[0].to_struct_array()
    each = neighbours._bounds(task, index.cells, rows, False)
    assert len(index.cells["cell"]) > 50
    for start in range(0, 60, 7):
        group = neighbours._group_bounds(task, index.cells, rows.slice(start, 7))
        assert (group <= each[start : start + 7].min(axis=0) + 1e-12).all()
        alone = neighbours._group_bounds(task, index.cells, rows.slice(start, 1))
        assert alone == pytest.approx(each[start])


def test_a_block_meets_the_queries_of_a_task_at_once(spark, monkeypatch):
    index, task, queries = grid(spark)
    monkeypatch.setattr(neighbours, "_TILE", 256)
    rows = queries.toArrow().combine_chunks().to_batches()[0].to_struct_array()
    pool = index.blocks.limit(4).select("pool_rows").toArrow().combine_chunks().column(0).combine_chunks()
    offsets = pa.array([0, 15, 30, 45, 60], pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, rows), pool], names=["query_rows", "pool_rows"])
    shared = type("Shared", (), {"value": index.cells})
    packed = [r for b in neighbours._make_visits(task, shared)(iter([batch])) for r in b.to_pylist()]
    met = [(r["cell"], r["chunk"]) for r in packed]
    assert len(met) == len(set(met)) > 1 and sum(len(r["query_rows"]) for r in packed) > len(met)
    monkeypatch.setattr(neighbours, "PACK_ROWS", 5)
    again = [r for b in neighbours._make_visits(task, shared)(iter([batch])) for r in b.to_pylist()]
    assert max(len(r["query_rows"]) for r in again) == 5
    assert sum(len(r["query_rows"]) for r in again) == sum(len(r["query_rows"]) for r in packed)

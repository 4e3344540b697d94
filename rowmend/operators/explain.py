"""Contribution of every feature to every score of a boosted tree model.

Path-dependent TreeSHAP (Lundberg et al. 2018) on the margin, leaf by leaf in Arrow
batches. Of a leaf with d different features on its path, a feature's Shapley value is the
integral over t in [0, 1] of a product of d - 1 linear factors, one per other feature: the
share of rows that go this way, weighted 1 - t, plus whether the row does, weighted t.
Gauss-Legendre nodes, half as many as factors, give such a polynomial's integral exactly.
Neighbouring leaves of a tree cut the rows into cells with the same values; these are found
once per cell, and a row adds up what stands at its cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from rowmend import parallel, shipping
from rowmend.operators.quantiles import exact_quantiles

# Cells that a group of leaves may make; their values take eight bytes a cell and feature.
CELLS = 2048


def _tree_nodes(detector, spark, which: int = 1) -> list[tuple[float, dict[int, Any]]]:
    """``(tree weight, {node id: row})`` of the model; size is trees times nodes."""
    return detector.classifier.tree_nodes(which)


def _leaves(weight: float, nodes: dict[int, Any]) -> tuple[list[dict[str, Any]], float]:
    """Leaves of one tree with their features, shares and conditions, and the tree's expected value.

    A feature met twice on a path counts once, with the product of its shares.
    """
    leaves, expected = [], 0.0
    stack = [(0, [], {}, 1.0)]
    while stack:
        node_id, tests, shares, reach = stack.pop()
        node = nodes[node_id]
        if node["leftChild"] < 0:
            value = weight * node["prediction"]
            expected += value * reach
            if tests:
                leaves.append({
                    "players": list(shares), "shares": np.array(list(shares.values())), "value": value,
                    "tests": tests,
                })
            continue
        rule = float(node["split"]["leftCategoriesOrThreshold"][0])
        feature = node["split"]["featureIndex"]
        left, right = nodes[node["leftChild"]], nodes[node["rightChild"]]
        cover = (left["impurityStats"][0], right["impurityStats"][0])
        for child, side, mass in ((node["leftChild"], True, cover[0]), (node["rightChild"], False, cover[1])):
            part = mass / (cover[0] + cover[1])
            stack.append((
                child, [*tests, (feature, rule, side)],
                {**shares, feature: shares.get(feature, 1.0) * part}, reach * part,
            ))
    return leaves, expected


def _leaf_values(follows: np.ndarray, shares: np.ndarray, value: float) -> np.ndarray:
    """Shapley values (features x rows) of one leaf from which features let a row through."""
    d = len(shares)
    nodes, masses = np.polynomial.legendre.leggauss(max(1, (d + 1) // 2))
    through, share = follows.astype(float), shares[:, None]
    total = np.zeros(through.shape)
    for node, mass in zip(nodes, masses):
        t = (node + 1) / 2
        factors = share * (1 - t) + through * t
        others = np.ones(through.shape)
        # Products of the factors before and after each feature: no division by one of them.
        others[1:] = np.cumprod(factors[:-1], axis=0)
        after = np.ones(through.shape[1])
        for j in range(d - 1, 0, -1):
            after = after * factors[j]
            others[j - 1] *= after
        total += mass / 2 * others
    return value * (through - share) * total


def _steps(leaf: dict[str, Any]) -> dict[int, set[float]]:
    steps: dict[int, set[float]] = {}
    for feature, rule, _ in leaf["tests"]:
        steps.setdefault(feature, set()).add(rule)
    return steps


def _cells(steps: dict[int, set[float]]) -> int:
    return prod(len(rules) + 1 for rules in steps.values())


def _grouped(leaves: list[dict[str, Any]]) -> list[tuple[dict[int, np.ndarray], list[dict[str, Any]]]]:
    """Neighbouring leaves of a tree while the cells that their conditions make are few, and the
    sorted thresholds per feature of each group."""
    groups: list[tuple[dict[int, set[float]], list[dict[str, Any]]]] = []
    for leaf in leaves:
        own = _steps(leaf)
        if groups:
            both = {f: groups[-1][0].get(f, set()) | own.get(f, set()) for f in {*groups[-1][0], *own}}
            if _cells(both) <= CELLS:
                groups[-1] = (both, [*groups[-1][1], leaf])
                continue
        groups.append((own, [leaf]))
    return [({f: np.array(sorted(rules)) for f, rules in sorted(steps.items())}, some) for steps, some in groups]


def _added_up(places: dict[int, np.ndarray], cuts: dict[int, np.ndarray], leaves: list[dict[str, Any]], n: int) -> dict[int, np.ndarray]:
    """Shapley values per feature, over some leaves, of rows given by how many thresholds they exceed."""
    total = {f: np.zeros(n) for f in cuts}
    for leaf in leaves:
        row_of = {feature: j for j, feature in enumerate(leaf["players"])}
        follows = np.ones((len(row_of), n), dtype=bool)
        for feature, rule, side in leaf["tests"]:
            follows[row_of[feature]] &= (places[feature] <= np.searchsorted(cuts[feature], rule)) == side
        # Rows that agree in what they follow share their values. No tree has more than
        # 30 levels, so a pattern fits a number.
        bits = np.arange(len(row_of))[:, None]
        patterns, where = np.unique((follows << bits).sum(axis=0), return_inverse=True)
        for feature, values in zip(leaf["players"], _leaf_values(patterns >> bits & 1, leaf["shares"], leaf["value"])):
            total[feature] += values[where]
    return total


def _tabulated(cuts: dict[int, np.ndarray], leaves: list[dict[str, Any]]) -> dict[int, np.ndarray] | None:
    """The values of a group for each of its cells, None if there are too many."""
    sizes = [len(c) + 1 for c in cuts.values()]
    if prod(sizes) > CELLS:
        return None
    places = dict(zip(cuts, np.unravel_index(np.arange(prod(sizes)), sizes)))
    return _added_up(places, cuts, leaves, prod(sizes))


@dataclass(frozen=True)
class Tables:
    """The leaves of all trees by groups. ``thresholds`` holds those of all trees per feature; a group has, per
    number of them exceeded, the share of its cell's number, and the values of each cell.

    The values of a group with too many cells, one leaf with a long path, are found per row.
    """

    thresholds: dict[int, np.ndarray]
    groups: list[tuple[dict[int, np.ndarray], dict[int, np.ndarray]]]
    long: list[tuple[dict[int, np.ndarray], list[dict[str, Any]]]]

    @classmethod
    def of(cls, trees: list[list[dict[str, Any]]]) -> Tables:
        grouped = [g for leaves in trees for g in _grouped(leaves)]
        every: dict[int, set[float]] = {}
        for cuts, _ in grouped:
            for f, own in cuts.items():
                every.setdefault(f, set()).update(own.tolist())
        thresholds = {f: np.array(sorted(rules)) for f, rules in every.items()}
        groups, long = [], []
        for cuts, leaves in grouped:
            values = _tabulated(cuts, leaves)
            if values is None:
                long.append((cuts, leaves))
                continue
            stride, shares = prod(len(c) + 1 for c in cuts.values()), {}
            for f, own in cuts.items():
                stride //= len(own) + 1
                # How many of the group's thresholds a row exceeds, from how many of all.
                shares[f] = np.r_[0, np.searchsorted(own, thresholds[f], side="right")] * stride
            groups.append((shares, values))
        return cls(thresholds, groups, long)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values, rows x columns."""
        total = np.zeros((x.shape[1], len(x)))
        places = {f: np.searchsorted(rules, x[:, f], side="left") for f, rules in self.thresholds.items()}
        for shares, values in self.groups:
            cell = sum(share[places[f]] for f, share in shares.items())
            for f, of_cell in values.items():
                total[f] += of_cell[cell]
        for cuts, leaves in self.long:
            own = {f: np.searchsorted(c, x[:, f], side="left") for f, c in cuts.items()}
            for f, values in _added_up(own, cuts, leaves, len(x)).items():
                total[f] += values
        return total.T


def contribution_arrays(detector, df: DataFrame, row_id: str, which: int = 1) -> tuple[DataFrame, float]:
    """``(row_id, parts, margin)`` with one contribution per feature, and the base value.

    Of more than two classes, ``which`` is the place of the one whose margin is explained.
    """
    spark = df.sparkSession
    shipping.ship_package(spark)
    trees, base = [], 0.0 if detector.binary else detector.classifier.base[which]
    for weight, nodes in _tree_nodes(detector, spark, which):
        found, expected = _leaves(weight, nodes)
        trees.append(found)
        base += expected
    shared = spark.sparkContext.broadcast(Tables.of(trees))
    names = list(detector.features)
    origin = np.array([names.index(c) for c in detector.origin])
    raw = F.col("rawPrediction")[which]
    vectors = detector.transform(parallel.spread(df, row_id)).select(
        row_id, vector_to_array("vector").alias("x"), raw.alias("margin")
    )

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            parts = shared.value.contributions(x)
            merged = np.zeros((len(x), len(names)))
            for j, target in enumerate(origin):
                merged[:, target] += parts[:, j]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * len(names), pa.int32()), pa.array(merged.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(row_id), lists, batch.column("margin")], names=[row_id, "parts", "margin"]
            )

    schema = f"`{row_id}` {df.schema[row_id].dataType.simpleString()}, parts array<double>, margin double"
    return vectors.mapInArrow(explain, schema), base


def attribute_rows(detector, df: DataFrame, row_id: str, which: int = 1) -> DataFrame:
    """``(row_id, feature, contribution, base, margin)``: per row the contributions add up
    from the base to the margin of the model, of more than two classes that at place ``which``."""
    wide, base = contribution_arrays(detector, df, row_id, which)
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col("parts")[i].alias("contribution"))
        for i, c in enumerate(detector.features)
    ])
    return wide.select(row_id, F.lit(base).alias("base"), "margin", F.inline(entries)).select(
        row_id, "feature", "contribution", "base", "margin"
    )


def top_features_by_row(detector, df: DataFrame, row_id: str, n: int = 3) -> DataFrame:
    """``top_positive_features`` of the rows of a table, without a shuffle: a row's
    contributions are at hand as an array, which is filtered, sorted and cut in place."""
    wide, _ = contribution_arrays(detector, df, row_id)
    entries = F.array(*[
        F.struct((-F.col("parts")[i]).alias("order"), F.lit(c).alias("feature"))
        for i, c in enumerate(detector.features)
    ])
    positive = F.filter(entries, lambda e: e["order"] < 0)
    best = F.slice(F.sort_array(positive), 1, n)
    return wide.select(row_id, F.posexplode(best).alias("position", "entry")).select(
        row_id, F.col("entry.feature").alias("feature"), (-F.col("entry.order")).alias("contribution"),
        (F.col("position") + 1).alias("place"),
    )


def top_positive_features(contributions: DataFrame, row_id: str, n: int = 3) -> DataFrame:
    """The largest contributions of a row, only those above zero, with their place."""
    order = Window.partitionBy(row_id).orderBy(F.desc("contribution"), "feature")
    return (
        contributions.filter("contribution > 0")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n)
        .select(row_id, "feature", "contribution", "place")
    )


def global_attribution(contributions: DataFrame) -> DataFrame:
    """Mean and quartiles of the absolute contribution and the mean signed one per feature."""
    summary = contributions.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean"),
        F.count(F.lit(1)).alias("n"),
    )
    names = [r["feature"] for r in contributions.select("feature").distinct().collect()]
    spread = contributions.select(
        *[F.when(F.col("feature") == c, F.abs("contribution")).alias(f"f_{i}") for i, c in enumerate(names)]
    )
    quartiles = exact_quantiles(spread, spread.columns, [0.25, 0.5, 0.75])
    rows = [(c, *quartiles[f"f_{i}"]) for i, c in enumerate(names)]
    table = contributions.sparkSession.createDataFrame(
        rows, "feature string, p25 double, p50 double, p75 double"
    )
    return summary.join(F.broadcast(table), "feature").select(
        "feature", "n",
        *[F.round(c, 6).alias(c) for c in ("mean_abs", "mean", "p25", "p50", "p75")],
    )

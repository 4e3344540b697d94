"""Explanation-guided repair: raise suggestions, put them in place, score again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmend import storage
from rowmend.functions import kinds
from rowmend.operators.consensus import gower_index, suggested_values
from rowmend.operators.explain import top_features_by_row
from rowmend.operators.neighbours import nearest

# Neighbours behind a suggestion, features suggested per row.
NEIGHBOURS = 5
FEATURES = 3
NUMBER = "row_number__"


def _by_feature(names: list[str], build) -> Column:
    """Pick by the ``feature`` column among one expression per feature."""
    chosen = F.lit(None).cast("string")
    for name in names:
        chosen = F.when(F.col("feature") == name, build(name)).otherwise(chosen)
    return chosen


def join_suggestions(
    top: DataFrame, suggested: DataFrame, anomalies: DataFrame, row_id: str, names: list[str], k: int
) -> DataFrame:
    """One row per flagged row and feature to change, with current and suggested value."""
    return (
        top.join(suggested, [row_id, "feature"])
        .join(anomalies.select(row_id, *names), row_id)
        .select(
            row_id, "feature", "place",
            _by_feature(names, lambda c: F.col(c).cast("string")).alias("current"),
            "suggested_number", "suggested_text",
            F.col("contribution").alias("impact"),
            F.lit(f"agreed by the {k} nearest healthy rows").alias("reason"),
        )
    )


def suggest_repairs(
    detector, anomalies: DataFrame, pool: DataFrame, row_id: str, pool_id: str,
    k: int = NEIGHBOURS, n: int = FEATURES,
) -> DataFrame:
    """For every flagged row: the features that raise its score most, and what its
    nearest healthy rows have instead."""
    names = detector.features
    rows = anomalies.select(row_id, *names)
    top = top_features_by_row(detector, rows, row_id, n)
    index = gower_index(pool, names, pool_id, k)
    suggested = suggested_values(nearest(index, rows, row_id), list(index.features), row_id)
    return join_suggestions(top, suggested, rows, row_id, names, k)


def apply_suggestions(rows: DataFrame, suggestions: DataFrame, row_id: str, names: list[str]) -> DataFrame:
    """All suggested values of a row put in place; at most a few suggestions per row.

    ``row_id`` tells rows apart; if keys repeat, give the column that ``numbered_rows`` adds.
    """
    collected = suggestions.groupBy(row_id).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "suggested_number"))).alias("numbers"),
        F.map_from_entries(F.collect_list(F.struct("feature", "suggested_text"))).alias("texts"),
    )
    joined = rows.join(collected, row_id, "left")
    replaced = []
    for c in rows.columns:
        if c not in names:
            replaced.append(F.col(c))
            continue
        dtype = rows.schema[c].dataType
        source = "numbers" if kinds.is_number(dtype) else "texts"
        new = F.col(source)[F.lit(c)]
        fitted = F.bround(new, 0).cast(dtype) if kinds.is_integer(dtype) else new.cast(dtype)
        replaced.append(F.coalesce(fitted, F.col(c)).alias(c))
    return joined.select(*replaced)


def verify_repairs(before: DataFrame, after: DataFrame, row_id: str) -> DataFrame:
    """Score before and after per row, the change and whether the row is now normal.

    ``row_id`` tells rows apart, as in ``apply_suggestions``.
    """
    joined = before.select(
        row_id, F.col("score").alias("before_score"), F.col("pred").alias("before_pred")
    ).join(
        after.select(row_id, F.col("score").alias("after_score"), F.col("pred").alias("after_pred")), row_id
    )
    change = F.col("after_score") - F.col("before_score")
    percent = F.when(F.col("before_score") > 0, F.round(change / F.col("before_score") * 100, 1))
    return joined.select(
        row_id, "before_score", "after_score", "before_pred", "after_pred",
        F.round(change, 4).alias("risk_change"),
        F.coalesce(F.format_string("%.1f", percent), F.lit("N/A")).alias("risk_change_percent"),
        (F.col("after_pred") == 0).alias("success"),
    )


def numbered_rows(rows: DataFrame, number: str = NUMBER) -> DataFrame:
    """``rows`` with a number of their own in ``number``, written, so that it stays."""
    return storage.cut_lineage(rows.withColumn(number, F.monotonically_increasing_id()))


def repair_by_suggestions(
    detector, anomalies: DataFrame, pool: DataFrame, row_id: str, pool_id: str, k: int = NEIGHBOURS, n: int = FEATURES
) -> DataFrame:
    """Suggest, put in place and verify: one row per row of ``anomalies``, also where keys repeat.

    The key, the repaired features, and the columns of ``verify_repairs``.
    """
    names = list(detector.features)
    rows = numbered_rows(anomalies.select(row_id, *names))
    suggested = suggest_repairs(detector, rows, pool, NUMBER, pool_id, k, n)
    repaired = apply_suggestions(rows, suggested, NUMBER, names)
    checked = verify_repairs(detector.score(rows), detector.score(repaired), NUMBER)
    return repaired.join(checked, NUMBER).drop(NUMBER)

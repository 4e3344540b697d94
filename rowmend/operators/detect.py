"""Detection on scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowmend import errors
from rowmend.functions import kinds
from rowmend.operators.ordering import dense_positions
from rowmend.operators.selection import values_at

# The two states of a scored row.
ANOMALY = "Anomaly"
NORMAL = "Normal"


def apply_threshold(df: DataFrame, threshold: float, score: str = "score", pred: str = "pred") -> DataFrame:
    return df.withColumn(pred, (F.col(score) >= F.lit(float(threshold))).cast("int"))


def row_range(df: DataFrame, row_id: str, start: int, end: int | None) -> DataFrame:
    """Rows ``start`` to ``end``, both included, in key order, with their position.

    For an integer key the keys at both ranks are found by counting, and only the rows
    between them, a pushed-down filter, are read and sorted. Null keys come first. Other
    keys need the whole order.
    """
    below, upto = 0, F.lit(True)
    if kinds.is_integer(df.schema[row_id].dataType):
        rows, known, low, high = df.agg(F.count(F.lit(1)), F.count(row_id), F.min(row_id), F.max(row_id)).first()
        if start >= rows or (end is not None and end < start):
            return dense_positions(df.limit(0), [row_id], "sample_id")
        if rows == known:
            hits = values_at(df, row_id, [max(start, 0), *([min(end, rows - 1)] if end is not None else [])], low, high)
            below, upto = hits[0].below, F.col(row_id) >= hits[0].value
            if end is not None:
                upto = upto & (F.col(row_id) <= hits[1].value)
    numbered = dense_positions(df.filter(upto), [row_id], "sample_id", start=below)
    return numbered.filter((F.col("sample_id") >= start) & (F.col("sample_id") <= (2**62 if end is None else end)))


def batch_detect(scored: DataFrame, row_id: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Add prediction, rounded score and status; positions are only computed for a range."""
    if start is not None or end is not None:
        scored = row_range(scored, row_id, start or 0, end)
    return (
        scored.withColumn("risk_score", F.round("score", 4))
        .withColumn("prediction", F.col("pred"))
        .withColumn("status", F.when(F.col("pred") == 1, ANOMALY).otherwise(NORMAL))
        .drop("score", "pred")
    )


def detect_summary(detected: DataFrame) -> DataFrame:
    counted = detected.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum((F.col("prediction") == 1).cast("long")), F.lit(0)).alias("anomalies"),
    )
    return counted.select(
        "total", "anomalies", (F.col("total") - F.col("anomalies")).alias("normals"),
        F.round(F.when(F.col("total") > 0, F.col("anomalies") / F.col("total") * 100).otherwise(0.0), 2)
        .alias("anomaly_rate"),
    )


def detect_filter(detected: DataFrame, which: str, row_id: str, features: list[str]) -> DataFrame:
    """``all``, ``anomalies`` or ``normals``, with key, status and score first."""
    chosen = {"all": None, "anomalies": 1, "normals": 0}
    if which not in chosen:
        raise errors.DataError(errors.INVALID_INPUT, "unknown filter", which=which, known=list(chosen))
    rows = detected if chosen[which] is None else detected.filter(F.col("prediction") == chosen[which])
    return rows.select(row_id, "status", "risk_score", *features)


def anomaly_ids(detected: DataFrame, row_id: str) -> DataFrame:
    return detected.filter(F.col("prediction") == 1).select(row_id)


def lookup_rows(df: DataFrame, ids: DataFrame, row_id: str, strict: bool = True) -> DataFrame:
    """Rows whose key is in ``ids``. In strict mode unknown ids are an error with the limits."""
    wanted = ids.select(row_id).distinct()
    if strict:
        unknown = wanted.join(df.select(row_id), row_id, "left_anti")
        missing = [r[0] for r in unknown.orderBy(row_id).limit(20).collect()]
        if missing:
            limits = df.agg(F.min(row_id), F.max(row_id), F.count(F.lit(1))).first()
            raise errors.DataError(
                errors.INVALID_INPUT, "row ids are out of range",
                unknown=missing, min_id=limits[0], max_id=limits[1], rows=limits[2],
            )
    return df.join(wanted, row_id, "left_semi")


def unknown_ids(df: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    return ids.select(row_id).distinct().join(df.select(row_id), row_id, "left_anti")

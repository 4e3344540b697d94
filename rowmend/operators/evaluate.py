"""Quality of predictions and scores as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowmend import storage
from rowmend.functions.values import fbeta, ratio
from rowmend.operators.ordering import running_totals


def _weight(rows: str | None) -> Column:
    """Rows that a row stands for: one, or the number in a column."""
    return F.lit(1) if rows is None else F.col(rows)


def _counts(df: DataFrame, actual: str, predicted: str, rows: str | None = None) -> DataFrame:
    """Rows per pair of labels, with zeros for pairs that do not occur."""
    pairs = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.sum(_weight(rows)).alias("n")
    )
    known = pairs.agg(
        F.array_distinct(F.concat(F.collect_set("actual"), F.collect_set("predicted"))).alias("labels")
    )
    grid = known.select(F.explode("labels").alias("actual"), "labels").select(
        "actual", F.explode("labels").alias("predicted")
    )
    return grid.join(pairs, ["actual", "predicted"], "left").fillna(0, ["n"])


def confusion_matrix(df: DataFrame, actual: str, predicted: str, rows: str | None = None) -> DataFrame:
    """``(actual, predicted, n, cell, share)``; the share is of the rows with that label."""
    row = F.sum("n").over(Window.partitionBy("actual"))
    cell = (
        F.when((F.col("actual") == 0) & (F.col("predicted") == 0), "TN")
        .when((F.col("actual") == 0) & (F.col("predicted") == 1), "FP")
        .when((F.col("actual") == 1) & (F.col("predicted") == 0), "FN")
        .when((F.col("actual") == 1) & (F.col("predicted") == 1), "TP")
    )
    return _counts(df, actual, predicted, rows).select(
        "actual", "predicted", "n", cell.alias("cell"), F.round(ratio(F.col("n"), row), 6).alias("share")
    )


def accuracy(df: DataFrame, actual: str, predicted: str, rows: str | None = None) -> DataFrame:
    same = F.col(actual) == F.col(predicted)
    hits, known = (F.sum(F.when(c, _weight(rows)).otherwise(0)) for c in (same, same.isNotNull()))
    return df.agg(F.round(F.try_divide(hits.cast("double"), known), 12).alias("accuracy"))


def _outcomes(actual: Column, predicted: Column, rows: str | None = None) -> list[Column]:
    return [
        F.sum(F.when((actual == 1) & (predicted == 1), _weight(rows)).otherwise(0)).alias("tp"),
        F.sum(F.when((actual != 1) & (predicted == 1), _weight(rows)).otherwise(0)).alias("fp"),
        F.sum(F.when((actual == 1) & (predicted != 1), _weight(rows)).otherwise(0)).alias("fn"),
    ]


def anomaly_prf(df: DataFrame, actual: str, predicted: str, rows: str | None = None) -> DataFrame:
    """Precision, recall and F1 of class 1; zero where undefined."""
    counts = df.agg(*_outcomes(F.col(actual), F.col(predicted), rows))
    rates = counts.select(
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )
    return rates.select(
        F.round("precision", 12).alias("precision"), F.round("recall", 12).alias("recall"),
        F.round(fbeta(F.col("precision"), F.col("recall"), 1.0), 12).alias("f1"),
    )


def weighted_prf(df: DataFrame, actual: str, predicted: str, rows: str | None = None) -> DataFrame:
    """Precision, recall and F1 averaged over classes by their support."""
    cells = _counts(df, actual, predicted, rows)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    entries = cells.select(
        "n", hit.alias("hit"),
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.lit(1).alias("is_actual")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).alias("is_actual")),
            )
        ).alias("side"),
    )
    classes = entries.groupBy("side.label").agg(
        F.sum(F.when(F.col("side.is_actual") == 1, F.col("hit")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side.is_actual") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side.is_actual") == 0, F.col("n")).otherwise(0)).alias("called"),
    )
    rated = classes.select(
        "support",
        ratio(F.col("tp"), F.col("called")).alias("p"),
        ratio(F.col("tp"), F.col("support")).alias("r"),
    ).withColumn("f", fbeta(F.col("p"), F.col("r"), 1.0))
    total = F.sum("support")
    return rated.agg(
        *[
            F.round(F.sum(F.col(c) * F.col("support")) / total, 12).alias(name)
            for c, name in (("p", "precision_weighted"), ("r", "recall_weighted"), ("f", "f1_weighted"))
        ]
    )


def fbeta_score(df: DataFrame, actual: str, predicted: str, beta: float = 2.0) -> DataFrame:
    counts = df.agg(*_outcomes(F.col(actual), F.col(predicted)))
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(F.lit(beta).alias("beta"), F.round(fbeta(precision, recall, beta), 12).alias("fbeta"))


def _score_counts(df: DataFrame, actual: str, score: str, rows: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score: many equal scores become one row."""
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(actual) == 1, _weight(rows)).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(actual) == 1, 0).otherwise(_weight(rows))).alias("neg"),
    )


def roc_auc(df: DataFrame, actual: str, score: str, rows: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties averaged; 0 unless both classes occur."""
    ranked = running_totals(_score_counts(df, actual, score, rows), "score", ["pos", "neg"])
    # Pairs where the negative scores lower: those after this score, and half of the equal.
    sums = ranked.agg(
        F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"),
        F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)).alias("not_above"),
    )
    area = (F.col("p") * F.col("q") - F.col("not_above")) / (F.col("p") * F.col("q"))
    return sums.select(
        F.round(F.when((F.col("p") > 0) & (F.col("q") > 0), area).otherwise(0.0), 9).alias("auc")
    )


def roc_curve(df: DataFrame, actual: str, score: str) -> DataFrame:
    """``(fpr, tpr, threshold)`` from the origin on, without points inside a straight line."""
    counted = _score_counts(df, actual, score)
    totals = counted.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    ranked = running_totals(counted, "score", ["pos", "neg"])
    last = F.col("pos_next").isNull()
    straight = (F.col("pos_next") == F.col("pos")) & (F.col("neg_next") == F.col("neg"))
    points = (
        ranked.filter(last | ~straight)
        .select(
            F.round(F.col("neg_upto") / F.lit(totals["neg"]), 9).alias("fpr"),
            F.round(F.col("pos_upto") / F.lit(totals["pos"]), 9).alias("tpr"),
            F.round("score", 9).alias("threshold"),
        )
    )
    origin = df.sparkSession.createDataFrame(
        [(0.0, 0.0, None)], "fpr double, tpr double, threshold double"
    )
    return origin.unionByName(points)


def metric_report(
    df: DataFrame, actual: str, predicted: str, score: str, threshold: float,
    search: dict[str, float] | None = None,
) -> DataFrame:
    """The fixed metric set in long form ``(metric, value)``, twelve places.

    The rows are read once, to count them per score, label and prediction; every metric
    is a sum over these counts.
    """
    counted = storage.cut_lineage(
        df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), F.col(score).cast("double").alias("score"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    labels = (counted, "actual", "predicted", "rows")
    wide = (
        anomaly_prf(*labels).select(
            F.col("f1"), F.col("precision"), F.col("recall"),
            F.col("f1").alias("f1_anomaly"), F.col("precision").alias("precision_anomaly"),
            F.col("recall").alias("recall_anomaly"),
        ),
        weighted_prf(*labels),
        accuracy(*labels),
        roc_auc(counted, "actual", "score", "rows"),
        confusion_matrix(*labels).groupBy().pivot("cell", ["TN", "FP", "FN", "TP"]).agg(
            F.sum("n").cast("double")
        ).select(*[F.col(c).alias(f"confusion_{c.lower()}") for c in ("TN", "FP", "FN", "TP")]),
    )
    parts = [w.unpivot([], w.columns, "metric", "value") for w in wide]
    fixed = {"decision_threshold": float(threshold), **(search or {})}
    parts.append(
        df.sparkSession.createDataFrame(
            [(name, float(value)) for name, value in fixed.items()], "metric string, value double"
        )
    )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report.select("metric", F.round(F.col("value"), 12).alias("value"))

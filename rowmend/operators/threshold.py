"""Choice of the decision threshold on validation scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from rowmend.functions.values import fbeta, ratio
from rowmend.operators.quantiles import exact_quantiles

# Thresholds always tried, and the score quantiles added to them.
FIXED_CANDIDATES = [0.3, 0.4, 0.5, 0.6, 0.7]
QUANTILES = [0.02 + i * 0.02 for i in range(49)]


@dataclass(frozen=True)
class ThresholdRule:
    default: float = 0.5
    beta: float = 2.0
    min_precision: float = 0.5


def threshold_candidates(df: DataFrame, score: str, rule: ThresholdRule) -> list[float]:
    """At most 55 thresholds in [0, 1], sorted."""
    quantiles = exact_quantiles(df, [score], QUANTILES)[score]
    raw = [rule.default, *FIXED_CANDIDATES, *[q for q in quantiles if q is not None]]
    return sorted({float(c) for c in raw if 0.0 <= c <= 1.0}) or [rule.default]


def rate_thresholds(df: DataFrame, actual: str, score: str, candidates: list[float], beta: float) -> DataFrame:
    """Precision, recall and F-beta of ``score >= t`` for every candidate, in one pass.

    Rows are counted between neighbouring candidates; sums from the top down then give
    the outcome at each one, so the rows are read once and not once per candidate.
    """
    edges = [-float("inf"), *candidates, float("inf")]
    placed = Bucketizer(splits=edges, inputCol="score", outputCol="slot").transform(
        df.select(F.col(actual).alias("y"), F.col(score).cast("double").alias("score"))
    )
    counted = placed.groupBy("slot").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg"),
    )
    slots = df.sparkSession.createDataFrame(
        [(float(i), c) for i, c in enumerate([None, *candidates])], "slot double, threshold double"
    )
    full = slots.join(counted, "slot", "left").fillna(0, ["pos", "neg"])
    # A row per slot, at most 56.
    everything = Window.partitionBy()
    above = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    summed = full.select(
        "threshold",
        F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(everything).alias("positives"),
        F.sum(F.col("pos") + F.col("neg")).over(everything).alias("n_rows"),
    ).filter("threshold is not null")
    rated = summed.select(
        "threshold", "n_rows",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("positives")).alias("recall"),
    )
    return rated.withColumn("fbeta", fbeta(F.col("precision"), F.col("recall"), beta))


def select_threshold(
    df: DataFrame, actual: str, score: str, rule: ThresholdRule = ThresholdRule()
) -> DataFrame:
    """One row: the threshold, its scores and the rows it was chosen on.

    Candidates below the precision floor are out; then best F-beta, recall, precision,
    closeness to the default, smallest. If none is left the default is taken.
    """
    candidates = sorted({*threshold_candidates(df, score, rule), rule.default})
    rated = rate_thresholds(df, actual, score, candidates, rule.beta)
    ok = F.col("precision") >= rule.min_precision
    best = (
        rated.filter(ok | (F.col("threshold") == rule.default))
        .orderBy(
            F.desc(ok), F.desc("fbeta"), F.desc("recall"), F.desc("precision"),
            F.abs(F.col("threshold") - rule.default), "threshold",
        )
        .limit(1)
    )
    return best.select(
        F.col("threshold").alias("decision_threshold"),
        F.lit(rule.beta).alias("beta"),
        F.lit(rule.min_precision).alias("min_precision"),
        F.col("fbeta").alias("selected_fbeta"),
        F.col("recall").alias("selected_recall"),
        F.col("precision").alias("selected_precision"),
        F.col("n_rows").alias("threshold_rows"),
    )

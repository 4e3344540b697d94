"""From a labelled table to a detector with a tuned threshold, and scoring with it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, functions as F, types as T

from rowmend import errors, parallel, storage
from rowmend.functions import kinds
from rowmend.functions.values import clamp_threshold
from rowmend.operators import evaluate, prep, profile, split
from rowmend.operators.boosting import SoftmaxTrees, fit_softmax_trees
from rowmend.operators.logistic import LogisticTrees, fit_logistic_trees
from rowmend.operators.ordering import dense_positions
from rowmend.operators.repair import feature_weights
from rowmend.operators.threshold import ThresholdRule, select_threshold

# Bins per column that a tree chooses its splits from.
BINS = 255


@dataclass(frozen=True)
class TrainOptions:
    test_size: float = 0.2
    validation_size: float = 0.25
    seed: int = 42
    rule: ThresholdRule = field(default_factory=ThresholdRule)
    trees: int = 100
    depth: int = 5
    step: float = 0.1
    positive_value: object = 1
    normal_value: object = 0


@dataclass(frozen=True)
class Preparation:
    """Raw columns to one vector: a rank for each category, then ML stages.

    ``ranks`` is ``(column, value, rank)``; a value it does not hold has rank 0.
    """

    ranks: DataFrame
    classes: list[str]
    stages: list
    inputs: list[str]
    origin: list[str]

    @cached_property
    def known(self) -> prep.ValueTable:
        return prep.value_table(self.ranks, "rank")

    def rank(self, df: DataFrame) -> DataFrame:
        """Add ``<c>__idx`` for each category column."""
        if not self.classes:
            return df
        names = {c: f"{c}__idx" for c in self.classes}
        ranked = prep.look_up(df, self.known, {c: prep.class_text(c) for c in self.classes}, names)
        return ranked.fillna(0.0, list(names.values()))

    def transform(self, df: DataFrame) -> DataFrame:
        return PipelineModel(self.stages).transform(self.rank(df))


@dataclass(frozen=True)
class Detector:
    """Feature preparation plus classifier, with the threshold that turns scores into flags."""

    preparation: Preparation
    classifier: LogisticTrees | SoftmaxTrees
    features: list[str]
    threshold: float
    binary: bool = True

    @property
    def origin(self) -> list[str]:
        """The feature behind each place of the vector."""
        return self.preparation.origin

    @property
    def inputs(self) -> list[str]:
        return self.preparation.inputs

    def transform(self, df: DataFrame) -> DataFrame:
        return self.classifier.transform(self.preparation.transform(df))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score`` and ``pred`` and keep the other columns.

        Two classes: probability of the anomaly and ``score >= threshold``. More: the
        most likely class for both.
        """
        kept = [c for c in df.columns if c not in ("score", "pred")]
        scored = self.transform(df.select(*kept))
        if self.binary:
            scored = scored.withColumn("score", F.col("probability")[1])
            scored = scored.withColumn("pred", (F.col("score") >= F.lit(self.threshold)).cast("int"))
        else:
            scored = scored.withColumn("pred", F.col("prediction").cast("int"))
            scored = scored.withColumn("score", F.col("prediction"))
        return scored.select(*kept, "score", "pred")

    def importances(self) -> dict[str, float]:
        raw = self.classifier.featureImportances.toArray()
        total = {c: 0.0 for c in self.features}
        for name, value in zip(self.origin, raw):
            total[name] += float(value)
        return total

    def weights(self) -> dict[str, float]:
        return feature_weights(self.importances())


@dataclass(frozen=True)
class TrainingResult:
    detector: Detector
    test_rows: DataFrame
    normal_rows: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    importance: DataFrame


def category_ranks(train: DataFrame, classes: list[str], label: str) -> DataFrame:
    """``(column, value, rank)``: values from 1 up by their mean label, then by value.

    Splits of the ranked values are the splits a tree learner considers for a category.
    The weights of two classes do not change the order. Ranks come from a range shuffle,
    so any number of values is treated alike.
    """
    spark = train.sparkSession
    if not classes:
        return spark.createDataFrame([], "column string, value string, rank double")
    means = (
        train.select(*[prep.class_text(c).alias(c) for c in classes], F.col(label).cast("double").alias("__y"))
        .unpivot("__y", classes, "column", "value")
        .groupBy("column", "value").agg(F.avg("__y").alias("mean"))
    )
    placed = dense_positions(means, ["column", "mean", "value"], "position", start=1)
    first = placed.groupBy("column").agg(F.min("position").alias("first"))
    ranks = placed.join(F.broadcast(first), "column").select(
        "column", "value", (F.col("position") - F.col("first") + 1).cast("double").alias("rank")
    )
    path = storage.fresh_path(spark, "ranks")
    ranks.write.parquet(path)
    return spark.read.parquet(path)


def fit_preparation(train: DataFrame, features: list[str], label: str) -> Preparation:
    """Category ranks, means and gap columns, all from the training rows."""
    schema = train.schema
    numeric = [c for c in features if kinds.is_number(schema[c].dataType)]
    classes = [c for c in features if c not in numeric]
    gaps = [F.count(F.when(kinds.is_missing(train, c), 1)).alias(c) for c in numeric]
    gaps = train.agg(*gaps).first().asDict() if numeric else {}

    parts, inputs, origin = ["*"], [f"{c}__idx" for c in classes], list(classes)
    for c in numeric:
        parts.append(f"cast(`{c}` as double) as `{c}__raw`")
        inputs.append(f"{c}__filled")
        origin.append(c)
    for c in numeric:
        if gaps[c]:
            parts.append(
                f"cast(coalesce(isnan(cast(`{c}` as double)), false) or `{c}` is null as double) as `{c}__gap`"
            )
            inputs.append(f"{c}__gap")
            origin.append(c)
    stages: list = [SQLTransformer(statement=f"SELECT {', '.join(parts)} FROM __THIS__")]
    if numeric:
        imputer = Imputer(
            strategy="mean", inputCols=[f"{c}__raw" for c in numeric],
            outputCols=[f"{c}__filled" for c in numeric],
        )
        stages.append(imputer.fit(stages[0].transform(train)))
    stages.append(VectorAssembler(inputCols=inputs, outputCol="vector", handleInvalid="keep"))
    return Preparation(category_ranks(train, classes, label), classes, stages, inputs, origin)


def _internal_label(df: DataFrame, target: str, options: TrainOptions, binary: bool) -> DataFrame:
    y = F.col(target)
    if not binary:
        return df.withColumn("label__", y.cast("int"))
    return df.withColumn("label__", (y == F.lit(options.positive_value)).cast("int"))


def fit_booster(rows: DataFrame, options: TrainOptions) -> LogisticTrees:
    return fit_logistic_trees(rows, "label__", "class_weight", options.trees, options.depth, options.step, BINS)


def fit_detector(
    table: DataFrame, target: str, features: list[str], row_id: str, options: TrainOptions = TrainOptions()
) -> TrainingResult:
    """Split, choose the threshold on a validation part, fit on all training rows, evaluate."""
    if target not in table.columns:
        raise errors.DataError(
            errors.INVALID_TARGET_COLUMN, f"target column not found: {target}", available_columns=table.columns
        )
    check = profile.target_check(table, target).first()
    binary = check["unique_count"] == 2
    if not binary and not kinds.is_integer(table.schema[target].dataType):
        raise errors.DataError(
            errors.TRAINING_FAILED, "more than two classes must be integers", target=target
        )
    if binary:
        ends = table.agg(F.min(target), F.max(target)).first()
        if {ends[0], ends[1]} != {options.positive_value, options.normal_value}:
            raise errors.DataError(
                errors.TRAINING_FAILED, "two classes must be the positive and the normal value", target=target,
                values=[str(v) for v in ends],
            )
    labelled = _internal_label(table.select(row_id, target, *features), target, options, binary)
    divided = split.stratified_split(labelled, "label__", row_id, options.test_size, options.seed)
    parts = storage.cut_lineage(parallel.settle(divided, row_id))
    train, test = parts.filter("is_train"), parts.filter(~F.col("is_train"))
    prepare = fit_preparation(train, features, "label__")

    threshold, search = options.rule.default, {}
    if binary:
        marked = split.validation_split(train, "label__", row_id, options.validation_size, options.seed)
        fit_rows, check_rows = marked.filter("is_fit"), marked.filter(~F.col("is_fit"))
        if check_rows.isEmpty():
            check_rows = fit_rows
        # The final model does not need the threshold, so both fits share the cluster.
        fits = [prepare.transform(prep.class_weights(rows, "label__")) for rows in (fit_rows, train)]
        with ThreadPoolExecutor(max_workers=2) as side_by_side:
            trial, model = side_by_side.map(lambda rows: fit_booster(rows, options), fits)
        judge = Detector(prepare, trial, features, 0.5)
        scored = storage.cut_lineage(judge.score(check_rows).select("label__", "score"))
        record = select_threshold(scored, "label__", "score", options.rule).first().asDict()
        threshold = clamp_threshold(record.pop("decision_threshold"), options.rule.default)
        search = {f"threshold_{k}" if not k.startswith("threshold") else k: v for k, v in record.items()}
    else:
        model = fit_softmax_trees(
            prepare.transform(prep.class_weights(train, "label__")), "label__", "class_weight",
            options.trees, options.depth, options.step,
        )
    detector = Detector(prepare, model, features, threshold, binary)

    scored = storage.cut_lineage(detector.score(test.select(row_id, *features, "label__")))
    metrics = evaluate.metric_report(scored, "label__", "pred", "score", threshold, search)
    if not binary:
        # Without class 1 against the rest, the top-level figures are the weighted ones.
        weighted = evaluate.weighted_prf(scored, "label__", "pred").first()
        flat = [(f"{m}{s}", float(weighted[f"{m}_weighted"])) for m in ("f1", "precision", "recall")
                for s in ("", "_anomaly")] + [("auc", 0.0)]
        kept = metrics.filter(~F.col("metric").isin([m for m, _ in flat]) & ~F.col("metric").startswith("confusion"))
        metrics = kept.unionByName(table.sparkSession.createDataFrame(flat, "metric string, value double"))
    # Healthy means the normal label; with none of those, all training rows.
    healthy = prep.healthy_pool(train, target, options.normal_value)
    return TrainingResult(
        detector,
        test.select(row_id, target, *features),
        healthy.select(row_id, *features),
        metrics,
        evaluate.confusion_matrix(scored, "label__", "pred"),
        feature_importance(detector, table),
    )


def feature_importance(detector: Detector, table: DataFrame, top: int | None = None) -> DataFrame:
    """``(feature, importance, rank)``, most important first."""
    ordered = sorted(detector.importances().items(), key=lambda item: (-item[1], item[0]))
    rows = [(name, value, place) for place, (name, value) in enumerate(ordered, 1)]
    schema = T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ])
    return table.sparkSession.createDataFrame(rows[:top] if top else rows, schema)

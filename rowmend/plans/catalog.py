"""The registered queries: every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowmend import storage
from rowmend.functions import values
from rowmend.functions.distance import mixed_distance
from rowmend.operators import (
    consensus, detect, evaluate, explain, forest, prep, profile, repair, runlog, split, threshold,
)
from rowmend.plans import compare, suggest, train
from rowmend.sources import csv, sinks, snapshot, state, views

FEATURES = views.ORDER_FEATURES
KEY = "row_id"
CUT = 0.5
BOUNDS = {"o_totalprice": {"min": 20000, "max": 300000}, "c_acctbal": {"min": "0", "max": "none"}}

# Importances of the frozen score: what each column can add to it.
FROZEN_IMPORTANCES = {
    "o_orderstatus": 0.2, "o_orderpriority": 0.2, "c_mktsegment": 0.2, "o_month": 0.0,
    "c_nationkey": 0.0, "o_totalprice": 0.25, "c_acctbal": 0.25,
}

# Contributions to the frozen score against a typical order, per feature.
FROZEN_CONTRIBUTIONS = {
    "o_orderstatus": "case when o_orderstatus = 'F' then 0.15 else -0.05 end",
    "o_orderpriority": "case when o_orderpriority = '1-URGENT' then 0.16 else -0.04 end",
    "c_mktsegment": "case when c_mktsegment = 'MACHINERY' then 0.17 else -0.03 end",
    "o_month": "0.0",
    "c_nationkey": "0.0",
    "o_totalprice": "o_totalprice / 2000000 - 0.1",
    "c_acctbal": "(10000 - c_acctbal) / 44000 - 0.1",
}

# Scores of three stand-in models for the comparison.
STAND_INS = {
    "all_columns": "score",
    "price_only": "least(1.0, o_totalprice / 500000)",
    "balance_only": "(10000 - c_acctbal) / 11000",
}

_results: dict[tuple[str, str], train.TrainingResult] = {}
_baselines: dict[tuple[str, str], tuple[dict[str, DataFrame], dict[str, float]]] = {}


def frozen_score(df: DataFrame) -> DataFrame:
    """The deterministic stand-in for a model: a clamped linear score and its flag."""
    scored = df.withColumn("score", F.expr(views.FROZEN_SCORE))
    return detect.apply_threshold(scored, CUT)


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return detect.apply_threshold(views.orders_mixed(spark, sf), CUT)


def anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return views.orders_mixed(spark, sf).filter("label = 1")


def healthy(spark: SparkSession, sf: str) -> DataFrame:
    return views.orders_mixed(spark, sf).filter("label = 0")


def trained(spark: SparkSession, sf: str) -> train.TrainingResult:
    """The detector of the orders table, fitted once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _results:
        _results[key] = train.fit_detector(views.orders_mixed(spark, sf), "label", FEATURES, KEY)
    return _results[key]


# --- sources and sinks -------------------------------------------------------------------


def csv_scan(spark, sf):
    path = storage.fresh_path(spark, "csv")
    views.customer_missing(spark, sf).write.csv(path, header=True, nullValue="N/A")
    return csv.csv_scan(spark, path)


def csv_scan_breaks(spark, sf):
    """All documents, whose texts have line breaks, through CSV files and back."""
    path = storage.fresh_path(spark, "csv")
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs = views.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.csv(path, header=True, nullValue="N/A", **options)
    return csv.csv_scan(spark, path).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


def head_preview(spark, sf):
    return csv.head_preview(views.orders_mixed(spark, sf).select(KEY, *FEATURES), KEY)


def scored_csv_sink(spark, sf):
    path = storage.fresh_path(spark, "scored")
    sinks.write_scored_csv(batch_detect(spark, sf), path)
    return csv.csv_scan(spark, path)


def scored_csv_anomalies(spark, sf):
    path = storage.fresh_path(spark, "anomalies")
    sinks.write_scored_csv(batch_detect(spark, sf), path, anomalies_only=True)
    return csv.csv_scan(spark, path)


def repair_report_sink(spark, sf):
    paths = sinks.write_repair_report(frozen_repair(spark, sf), storage.fresh_path(spark, "repair"), KEY)
    return csv.csv_scan(spark, paths["changes"]).select(
        KEY, "feature", F.round("before_score", 6).alias("before_score"),
        F.round("after_score", 6).alias("after_score"),
    )


def save_state(spark, sf):
    path = state.save_state(trained(spark, sf), storage.fresh_path(spark, "state"))
    saved = state.load_state(spark, path)
    return saved.detector.score(saved.test_rows).select(KEY, "label", "score", "pred")


def load_state(spark, sf):
    path = state.save_state(trained(spark, sf), storage.fresh_path(spark, "state"))
    return state.load_state(spark, path).normal_rows


def saved_scores(spark, sf):
    """Whether a saved and loaded detector scores every test row as before."""
    result = trained(spark, sf)
    path = state.save_state(result, storage.fresh_path(spark, "state"))
    saved = state.load_state(spark, path)
    before = result.detector.score(result.test_rows).select(KEY, F.col("score").alias("before"), "pred")
    after = saved.detector.score(saved.test_rows).select(KEY, "score", F.col("pred").alias("after_pred"))
    same = (F.col("before") == F.col("score")) & (F.col("pred") == F.col("after_pred"))
    return before.join(after, KEY, "full").select(KEY, F.coalesce(same, F.lit(False)).cast("int").alias("same"))


# --- profiling ---------------------------------------------------------------------------


def table_overview(spark, sf):
    return profile.table_overview(views.lineitem_mixed(spark, sf))


def missing_report(spark, sf):
    return profile.missing_report(views.customer_missing(spark, sf))


def numeric_describe(spark, sf):
    return profile.numeric_describe(views.lineitem_mixed(spark, sf))


def category_distribution(spark, sf):
    return profile.category_distribution(
        views.customer_missing(spark, sf).withColumn("nation", F.col("c_nationkey").cast("string"))
    )


def target_distribution(spark, sf):
    return profile.target_distribution(views.orders_mixed(spark, sf), "label")


def target_check(spark, sf):
    return profile.target_check(views.orders_mixed(spark, sf), "label", strict=False)


def target_check_failures(spark, sf):
    """One failing target per rule: continuous, with gaps, of one class, with a class of one row."""
    orders = views.orders_mixed(spark, sf).withColumn("only", F.lit(1))
    first = orders.agg(F.min(KEY)).first()[0]
    orders = orders.withColumn("rare", (F.col(KEY) == F.lit(first)).cast("int"))
    checks = [(orders, "o_totalprice"), (views.customer_missing(spark, sf), "c_mktsegment"), (orders, "only"),
              (orders, "rare")]
    rows = None
    for table, target in checks:
        row = profile.target_check(table, target, strict=False).select(
            "target", "n_rows", "missing_count", "unique_count", "min_class_count", "code", "reason"
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


# --- preparation -------------------------------------------------------------------------


def drop_columns(spark, sf):
    return prep.drop_columns(views.orders_mixed(spark, sf), ["row_id", "label", "no_such_column"])


def mean_impute(spark, sf):
    return prep.mean_impute(views.customer_missing(spark, sf), ["c_acctbal"]).withColumn(
        "c_acctbal", F.round("c_acctbal", 6)
    )


def row_filter(spark, sf):
    return prep.row_filter(views.customer_missing(spark, sf), "c_mktsegment", "MACHINERY")


def label_encode(spark, sf):
    return prep.label_encode(views.customer_missing(spark, sf), ["c_mktsegment"])


def one_hot(spark, sf):
    wide = prep.one_hot(views.table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"])
    flags = [c for c in wide.columns if c != "doc_id"]
    return wide.unpivot("doc_id", flags, "indicator", "flag").withColumn("flag", F.col("flag").cast("int"))


def one_hot_sparse(spark, sf):
    rows, _ = prep.one_hot_sparse(views.table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"])
    return rows.select("doc_id", F.array_join("flags", " ").alias("flags"))


def standardise(spark, sf):
    columns = ["c_nationkey", "o_totalprice", "c_acctbal"]
    wide = prep.standardise(views.orders_mixed(spark, sf), columns)
    return wide.select(KEY, *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in columns])


def stratified_split(spark, sf):
    return split.stratified_split(views.orders_mixed(spark, sf), "label", KEY).select(
        KEY, "label", F.col("is_train").cast("int").alias("is_train")
    )


def _train_part(spark, sf):
    return split.stratified_split(views.orders_mixed(spark, sf), "label", KEY).filter("is_train")


def validation_split(spark, sf):
    return split.validation_split(_train_part(spark, sf), "label", KEY).select(
        KEY, "label", F.col("is_fit").cast("int").alias("is_fit")
    )


def random_split(spark, sf):
    return split.random_split(views.orders_mixed(spark, sf), KEY).select(
        KEY, F.col("is_train").cast("int").alias("is_train")
    )


def class_weights(spark, sf):
    return prep.class_weights(views.orders_mixed(spark, sf), "label").select(
        KEY, "label", F.round("class_weight", 9).alias("class_weight")
    )


def healthy_pool(spark, sf):
    return prep.healthy_pool(_train_part(spark, sf), "label").select(KEY, *FEATURES)


def discrete_columns(spark, sf):
    return profile.discrete_columns(views.orders_mixed(spark, sf).select(*FEATURES))


# --- neighbours --------------------------------------------------------------------------


def _neighbours(spark, sf, k=9):
    pool = healthy(spark, sf)
    features = consensus.describe_features(pool, FEATURES)
    index = consensus.mixed_index(pool, features, KEY, k)
    return consensus.nearest(index, anomalies(spark, sf), KEY), features


def _gower(spark, sf, k=5):
    index = consensus.gower_index(healthy(spark, sf), FEATURES, KEY, k)
    return consensus.nearest(index, anomalies(spark, sf), KEY), list(index.features)


def gower_distance(spark, sf):
    found, _ = _gower(spark, sf)
    return found.select(KEY, "pool_id", "rank", F.round("distance", 9).alias("distance"))


def mixed_distance_query(spark, sf):
    """The distance as a column expression, on the pairs the neighbour join found."""
    found, features = _neighbours(spark, sf)
    pairs = found.select(KEY, "pool_id", "neighbour").join(anomalies(spark, sf), KEY)
    distance = mixed_distance(features, F.col, lambda c: F.col(f"neighbour.{c}"))
    return pairs.select(KEY, "pool_id", F.round(distance, 9).alias("distance"))


def knn_join(spark, sf):
    found, _ = _neighbours(spark, sf)
    return found.select(KEY, "pool_id", "rank", F.round("distance", 9).alias("distance"))


def numeric_scales(spark, sf):
    pool = healthy(spark, sf)
    features = consensus.describe_features(pool, FEATURES)
    return spark.createDataFrame(
        [(f.name, round(float(f.scale), 6)) for f in features], "feature string, scale double"
    )


def neighbour_consensus(spark, sf):
    found, features = _neighbours(spark, sf)
    wide = consensus.neighbour_consensus(found, features, KEY)
    return wide.select(*[
        F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in wide.dtypes
    ])


def suggested_value(spark, sf):
    found, features = _gower(spark, sf)
    return consensus.suggested_values(found, features, KEY)


# --- evaluation --------------------------------------------------------------------------


def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(flagged(spark, sf), "label", "pred")


def accuracy(spark, sf):
    return evaluate.accuracy(flagged(spark, sf), "label", "pred")


def anomaly_prf(spark, sf):
    return evaluate.anomaly_prf(flagged(spark, sf), "label", "pred")


def weighted_prf(spark, sf):
    return evaluate.weighted_prf(flagged(spark, sf), "label", "pred")


def fbeta(spark, sf):
    return evaluate.fbeta_score(flagged(spark, sf), "label", "pred", 2.0)


def roc_auc(spark, sf):
    return evaluate.roc_auc(flagged(spark, sf), "label", "score")


def roc_curve(spark, sf):
    return evaluate.roc_curve(flagged(spark, sf), "label", "score")


def feature_importance(spark, sf):
    return train.feature_importance(trained(spark, sf).detector, views.orders_mixed(spark, sf), top=5)


def metric_report(spark, sf):
    return evaluate.metric_report(flagged(spark, sf), "label", "pred", "score", CUT)


# --- models ------------------------------------------------------------------------------


def fit_detector(spark, sf):
    return trained(spark, sf).metrics


def fit_multiclass(spark, sf):
    table = flagged(spark, sf).withColumn("risk", F.col("label") + F.col("pred"))
    return train.fit_detector(table, "risk", FEATURES, KEY).metrics


def score_rows(spark, sf):
    return trained(spark, sf).detector.score(views.orders_mixed(spark, sf).select(KEY, "label", *FEATURES)).select(
        KEY, "label", "score", "pred"
    )


def select_threshold(spark, sf):
    chosen = threshold.select_threshold(views.orders_mixed(spark, sf), "label", "score")
    return chosen.select(*[
        F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in chosen.dtypes
    ])


def baselines(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], dict[str, float]]:
    """Scores and fit seconds of the baselines, fitted once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _baselines:
        _baselines[key] = compare.baseline_scores(views.orders_mixed(spark, sf), "label", FEATURES, KEY)
    return _baselines[key]


def baseline_models(spark, sf):
    """Test-row scores of all baselines."""
    scored, _ = baselines(spark, sf)
    rows = None
    for name, df in scored.items():
        part = df.withColumn("model", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def isolation_forest(spark, sf):
    table = views.orders_mixed(spark, sf)
    known = _train_part(spark, sf)
    prepare = train.fit_preparation(known, FEATURES, "label")
    trained_on = prepare.transform(known)
    trees = forest.fit_isolation_forest(trained_on, KEY)
    scored = forest.isolation_scores(trees, prepare.transform(table), KEY, keep=["label"])
    rate = known.agg(F.avg("label")).first()[0]
    return forest.flag_share(scored, rate, forest.isolation_scores(trees, trained_on, KEY))


def model_comparison(spark, sf):
    table = views.orders_mixed(spark, sf)
    scored = {
        name: detect.apply_threshold(table.select(KEY, "label", F.expr(text).alias("score")), CUT)
        for name, text in STAND_INS.items()
    }
    return compare.long_comparison(compare.compare_scores(scored, "label"))


def model_comparison_trained(spark, sf):
    """Quality of the trained baselines on the same test rows, and the seconds each took to fit."""
    scored, seconds = baselines(spark, sf)
    return compare.long_comparison(compare.compare_scores(scored, "label", seconds))


# --- explanation -------------------------------------------------------------------------


def frozen_contributions(df: DataFrame, row_id: str = KEY) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.expr(text).cast("double").alias("contribution"))
        for c, text in FROZEN_CONTRIBUTIONS.items()
    ])
    return df.select(row_id, F.inline(entries))


def attribute_rows(spark, sf):
    return explain.attribute_rows(trained(spark, sf).detector, views.orders_mixed(spark, sf), KEY)


def attribution_sums(spark, sf):
    """Whether base and contributions of every row add up to its margin."""
    parts = attribute_rows(spark, sf)
    total = F.col("base") + F.col("total")
    return parts.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("features"), F.sum("contribution").alias("total"), F.first("base").alias("base"),
        F.first("margin").alias("margin"),
    ).select(KEY, "features", (F.abs(total - F.col("margin")) < 1e-6).cast("int").alias("adds_up"))


def top_positive_features(spark, sf):
    top = explain.top_positive_features(frozen_contributions(views.orders_mixed(spark, sf)), KEY)
    return top.withColumn("contribution", F.round("contribution", 9))


def global_attribution(spark, sf):
    return explain.global_attribution(frozen_contributions(views.orders_mixed(spark, sf)))


# --- detection ---------------------------------------------------------------------------


def batch_detect(spark, sf):
    return detect.batch_detect(flagged(spark, sf).drop("label"), KEY)


def batch_detect_range(spark, sf):
    """Rows 100 to 400 in key order, both included."""
    return detect.batch_detect(flagged(spark, sf).drop("label"), KEY, 100, 400)


def batch_detect_trained(spark, sf):
    rows = views.orders_mixed(spark, sf).select(KEY, *FEATURES)
    return detect.batch_detect(trained(spark, sf).detector.score(rows), KEY)


def detect_summary(spark, sf):
    return detect.detect_summary(batch_detect(spark, sf))


def detect_filter(spark, sf):
    return detect.detect_filter(batch_detect(spark, sf), "anomalies", KEY, FEATURES)


def anomaly_ids(spark, sf):
    return detect.anomaly_ids(batch_detect(spark, sf), KEY)


def lookup_rows(spark, sf):
    table = views.orders_mixed(spark, sf)
    return detect.lookup_rows(table, anomaly_ids(spark, sf), KEY).select(KEY, *FEATURES)


# --- repair ------------------------------------------------------------------------------


def flagged_by(detector, spark: SparkSession, sf: str) -> DataFrame:
    """The orders that a detector flags, with their scores; several readers, but all orders are scored once."""
    scored = detector.score(views.orders_mixed(spark, sf).select(KEY, *FEATURES))
    return storage.cut_lineage(scored.filter("pred = 1"))


def suggest_repairs(spark, sf):
    result = trained(spark, sf)
    rows = flagged_by(result.detector, spark, sf)
    return suggest.suggest_repairs(result.detector, rows, result.normal_rows, KEY, KEY)


def suggest_repairs_frozen(spark, sf):
    """Suggestions from the frozen contributions instead of a model's."""
    rows = anomalies(spark, sf).select(KEY, *FEATURES)
    top = explain.top_positive_features(frozen_contributions(rows), KEY)
    found, features = _gower(spark, sf)
    suggested = consensus.suggested_values(found, features, KEY)
    joined = suggest.join_suggestions(top, suggested, rows, KEY, FEATURES, suggest.NEIGHBOURS)
    return joined.drop("current").withColumn("impact", F.round("impact", 9))


def _applied(spark, sf):
    rows = anomalies(spark, sf).select(KEY, *FEATURES)
    top = explain.top_positive_features(frozen_contributions(rows), KEY)
    found, features = _gower(spark, sf)
    suggested = consensus.suggested_values(found, features, KEY).join(
        top.select(KEY, "feature"), [KEY, "feature"], "left_semi"
    )
    return rows, suggest.apply_suggestions(rows, suggested, KEY, FEATURES)


def apply_suggestions(spark, sf):
    return _applied(spark, sf)[1]


def verify_repairs(spark, sf):
    rows, repaired = _applied(spark, sf)
    checked = suggest.verify_repairs(frozen_score(rows), frozen_score(repaired), KEY)
    return checked.select(
        KEY, F.round("before_score", 6).alias("before_score"), F.round("after_score", 6).alias("after_score"),
        "before_pred", "after_pred", F.col("success").cast("int").alias("success"),
    )


def _doubled(spark, sf):
    """Flagged rows twice under the same key, the second time at twice the price, and their suggestions."""
    rows = anomalies(spark, sf).select(KEY, *FEATURES)
    dearer = rows.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    numbered = suggest.numbered_rows(rows.unionByName(dearer))
    top = explain.top_positive_features(frozen_contributions(numbered, suggest.NUMBER), suggest.NUMBER)
    index = consensus.gower_index(healthy(spark, sf), FEATURES, KEY, 5)
    found = consensus.nearest(index, numbered, suggest.NUMBER)
    suggested = consensus.suggested_values(found, list(index.features), suggest.NUMBER)
    chosen = suggested.join(top.select(suggest.NUMBER, "feature"), [suggest.NUMBER, "feature"], "left_semi")
    return numbered, suggest.apply_suggestions(numbered, chosen, suggest.NUMBER, FEATURES)


def verify_repeated_keys(spark, sf):
    """Rows in and out, and rows normal after repair, of each key that is there twice."""
    rows, repaired = _doubled(spark, sf)
    checked = suggest.verify_repairs(frozen_score(rows), frozen_score(repaired), suggest.NUMBER)
    return checked.join(rows.select(KEY, suggest.NUMBER), suggest.NUMBER).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(suggest.NUMBER).alias("n_numbers")
    )


def verify_repairs_trained(spark, sf):
    """Suggestions of the trained detector applied and scored again."""
    result = trained(spark, sf)
    detector = result.detector
    before = flagged_by(detector, spark, sf)
    suggested = suggest.suggest_repairs(detector, before, result.normal_rows, KEY, KEY)
    repaired = suggest.apply_suggestions(before.select(KEY, *FEATURES), suggested, KEY, FEATURES)
    return suggest.verify_repairs(before, detector.score(repaired), KEY)


def frozen_features(pool: DataFrame) -> list:
    return consensus.describe_features(pool, FEATURES, repair.feature_weights(FROZEN_IMPORTANCES))


def frozen_repair(spark, sf):
    """Greedy repair of all flagged orders under the frozen score."""
    pool = healthy(spark, sf)
    samples = flagged(spark, sf).filter("pred = 1")
    options = repair.RepairOptions(immutable_columns=["c_nationkey"], numeric_bounds=BOUNDS)
    return repair.greedy_repair(samples, pool, frozen_score, frozen_features(pool), KEY, KEY, options)


def flat_report(report: DataFrame) -> DataFrame:
    return report.select(
        KEY, *[F.round(c, 6).alias(c) if c in ("o_totalprice", "c_acctbal") else F.col(c) for c in FEATURES],
        F.col("summary.status").alias("status"),
        F.round("summary.before_score", 6).alias("before_score"),
        F.round("summary.after_score", 6).alias("after_score"),
        F.col("summary.applied_changes").alias("applied_changes"),
        F.array_join(F.transform("changes", lambda c: c["feature"]), ",").alias("changed"),
    )


def greedy_repair(spark, sf):
    return flat_report(frozen_repair(spark, sf))


def greedy_repair_dry(spark, sf):
    """The repair of all orders as a dry run: states, no change."""
    pool = healthy(spark, sf)
    report = repair.greedy_repair(
        flagged(spark, sf), pool, frozen_score, frozen_features(pool), KEY, KEY, repair.RepairOptions(dry_run=True)
    )
    return flat_report(report)


def greedy_repair_trained(spark, sf):
    """Greedy repair of every order that the trained detector flags."""
    result = trained(spark, sf)
    detector = result.detector
    features = consensus.describe_features(result.normal_rows, FEATURES, detector.weights())
    samples = detector.score(views.orders_mixed(spark, sf).select(KEY, *FEATURES)).filter("pred = 1")
    samples = samples.select(KEY, *FEATURES)
    return flat_report(
        repair.greedy_repair(samples, result.normal_rows, detector.score, features, KEY, KEY)
    )


def clip_bounds(spark, sf):
    return views.orders_mixed(spark, sf).select(
        KEY, *[values.clip_bounds(F.col(c), b).alias(c) for c, b in BOUNDS.items()]
    )


def cast_like(spark, sf):
    table = views.orders_mixed(spark, sf)
    return table.select(
        KEY,
        values.cast_like(F.col("o_totalprice") / 20000, T.IntegerType(), F.col("c_nationkey")).alias("as_integer"),
        values.cast_like(F.col("c_nationkey") / 2, T.IntegerType(), F.col("c_nationkey")).alias("as_even"),
        values.cast_like(
            F.col("o_orderpriority"), T.StringType(), F.col("c_mktsegment"), ["1-URGENT", "2-HIGH"]
        ).alias("in_domain"),
        values.cast_like(F.expr("nullif(o_orderstatus, 'P')"), T.StringType(), F.lit("kept")).alias("filled"),
    )


_LOWERED = "greatest(0.0, score - case when c_mktsegment = 'MACHINERY' then 0.2 when o_month > 6 then 0.1 else 0.0 end)"


def _outcomes(spark, sf):
    return flagged(spark, sf).select(
        KEY, "score", "pred", F.expr(_LOWERED).alias("after"), (F.col("o_month") == 12).alias("dry"),
    ).withColumn("after_pred", (F.col("after") >= CUT).cast("int"))


def repair_status(spark, sf):
    return _outcomes(spark, sf).select(
        KEY,
        repair.repair_status(
            F.col("pred"), F.col("after_pred"), F.col("score"), F.col("after"), F.col("dry")
        ).alias("status"),
    )


def repair_summary(spark, sf):
    rows = _outcomes(spark, sf).select(
        KEY,
        repair.repair_summary(
            F.col("pred"), F.col("after_pred"), F.col("score"), F.col("after"),
            F.when(F.col("after") < F.col("score"), F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")),
            False,
        ).alias("summary"),
    )
    return repair.repair_totals(rows)


# --- run log -----------------------------------------------------------------------------


def _latest(spark, sf):
    return runlog.latest_per_key(views.events_log(spark, sf), "id", "updated", "seq")


def latest_per_key(spark, sf):
    return _latest(spark, sf).select("id", "seq", "status", "payload")


def upsert_latest(spark, sf):
    """The log in three increments, late snapshots among them, and the stored table."""
    path = storage.fresh_path(spark, "snapshot")
    log = views.events_log(spark, sf)
    for part in range(3):
        snapshot.upsert(spark, path, log.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == part), "id", "updated", "seq", buckets=16)
    return snapshot.read(spark, path).select("id", "seq", "status", "payload")


def keep_recent_n(spark, sf):
    return runlog.keep_recent_n(_latest(spark, sf), "id", "updated", 50).select("id", "seq", "status")


def lookup_by_key(spark, sf):
    return runlog.lookup_by_key(views.events_log(spark, sf), "id", 8).select("id", "seq", "status", "payload")


def recent_n(spark, sf):
    return runlog.recent_n(views.events_log(spark, sf), "updated", 0, "seq").select("id", "seq", "status")


def parse_payload(spark, sf):
    parsed = runlog.parse_payload(views.events_log(spark, sf), "payload", "k long")
    again = runlog.render_payload(parsed, "parsed", "rendered")
    return again.select("seq", F.col("parsed.k").alias("k"), "rendered")


def epoch_ms(spark, sf):
    log = runlog.with_epoch_ms(
        views.events_log(spark, sf).withColumn("ended", F.expr("case when status <> 'error' then updated end")),
        "ended", "ended_ms",
    )
    back = runlog.with_timestamp(log, "ended_ms", "restored", zoned=False)
    return back.select(
        "seq", "ended_ms", F.date_format("restored", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("restored")
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [
        csv_scan, csv_scan_breaks, head_preview, scored_csv_sink, scored_csv_anomalies, saved_scores, target_check_failures,
        attribution_sums, batch_detect_range, suggest_repairs_frozen, greedy_repair_dry, repair_report_sink, save_state, load_state,
        table_overview, missing_report, numeric_describe, category_distribution, target_distribution, target_check,
        drop_columns, mean_impute, row_filter, label_encode, one_hot, one_hot_sparse, standardise, stratified_split,
        validation_split, random_split, class_weights, healthy_pool, discrete_columns,
        gower_distance, knn_join, numeric_scales, neighbour_consensus, suggested_value,
        confusion_matrix, accuracy, anomaly_prf, weighted_prf, fbeta, roc_auc, roc_curve,
        feature_importance, metric_report,
        fit_detector, fit_multiclass, score_rows, select_threshold, baseline_models, isolation_forest,
        model_comparison, model_comparison_trained, attribute_rows, top_positive_features, global_attribution,
        batch_detect, batch_detect_trained, detect_summary, detect_filter, anomaly_ids, lookup_rows,
        suggest_repairs, apply_suggestions, verify_repairs, verify_repairs_trained, verify_repeated_keys,
        greedy_repair, greedy_repair_trained, clip_bounds, cast_like, repair_status, repair_summary,
        latest_per_key, upsert_latest, keep_recent_n, lookup_by_key, recent_n, parse_payload, epoch_ms,
    ]
    queries = {query.__name__: query for query in listed}
    queries["mixed_distance"] = mixed_distance_query
    return queries

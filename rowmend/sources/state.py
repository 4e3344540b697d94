"""Saving and loading what detection and repair need later."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from rowmend import errors
from rowmend.functions.values import clamp_threshold
from rowmend.operators.boosting import SoftmaxTrees
from rowmend.operators.logistic import LogisticTrees
from rowmend.plans.train import Detector, Preparation, TrainingResult
from rowmend.sources import manifests

PARTS = ("model", "stages", "ranks", "test_rows", "normal_rows", "config")

_published, _text = manifests.published, manifests.text


@dataclass(frozen=True)
class SavedState:
    detector: Detector
    test_rows: DataFrame
    normal_rows: DataFrame


def save_state(result: TrainingResult, path: str) -> str:
    """Write every part into a folder of its own and publish it by one manifest at the end.

    Readers trust manifests only: a save that breaks off changes nothing for them, and one
    that runs beside them leaves the files they read alone. Earlier saves stay in place.
    """
    root = path.rstrip("/")
    detector = result.detector
    spark = result.test_rows.sparkSession
    number = 1 + max((m["number"] for m in _published(spark, root)), default=0)
    folder = f"save-{number}-{uuid.uuid4().hex}"
    place = f"{root}/{folder}"
    detector.classifier.save(spark, f"{place}/model")
    PipelineModel(detector.preparation.stages).write().save(f"{place}/stages")
    detector.preparation.ranks.write.parquet(f"{place}/ranks")
    result.test_rows.write.parquet(f"{place}/test_rows")
    result.normal_rows.write.parquet(f"{place}/normal_rows")
    config = {
        "features": detector.features, "inputs": detector.inputs, "origin": detector.origin,
        "classes": detector.preparation.classes,
        "threshold": detector.threshold, "binary": detector.binary,
    }
    _text(spark, config).write.text(f"{place}/config")
    _text(spark, {"number": number, "folder": folder, "parts": PARTS}).write.mode("append").text(f"{root}/manifests")
    return root


def load_state(spark: SparkSession, path: str) -> SavedState:
    """Load all parts of the last published save; a missing one is named in the error."""
    root = path.rstrip("/")
    published = _published(spark, root)
    if not published:
        raise errors.DataError(errors.FILE_NOT_FOUND, "no complete saved state", path=root, missing=list(PARTS))
    place = f"{root}/{published[0]['folder']}"
    missing = [part for part in published[0]["parts"] if manifests.missing(spark, f"{place}/{part}")]
    if missing:
        raise errors.DataError(errors.FILE_NOT_FOUND, "saved state is incomplete", path=root, missing=missing)
    try:
        config = json.loads(spark.read.text(f"{place}/config").first()[0])
        preparation = Preparation(
            spark.read.parquet(f"{place}/ranks"), config["classes"],
            PipelineModel.load(f"{place}/stages").stages, config["inputs"], config["origin"],
        )
        binary = bool(config["binary"])
        model = (LogisticTrees if binary else SoftmaxTrees).load(spark, f"{place}/model")
        detector = Detector(preparation, model, config["features"], clamp_threshold(config["threshold"]), binary)
        return SavedState(
            detector, spark.read.parquet(f"{place}/test_rows"), spark.read.parquet(f"{place}/normal_rows")
        )
    except errors.DataError:
        raise
    except Exception as problem:
        raise errors.DataError(errors.MODEL_STATE_LOAD_FAILED, "cannot load the saved state", path=root) from problem

"""Publishing by manifest: parts are written first, one small file names them at the end."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def missing(spark: SparkSession, path: str) -> bool:
    """Whether nothing lies at ``path``; only names are listed."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return True
    return False


def published(spark: SparkSession, root: str) -> list[dict]:
    """What has been published, a manifest per save, the last one first."""
    if missing(spark, f"{root}/manifests"):
        return []
    found = [json.loads(r["value"]) for r in spark.read.text(f"{root}/manifests").collect()]
    return sorted(found, key=lambda m: (m["number"], m["folder"]), reverse=True)


def text(spark: SparkSession, content: dict) -> DataFrame:
    """One row, in one partition, with the content as one line of JSON."""
    return spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1)


def write_text(spark: SparkSession, content: dict, path: str, mode: str = "errorifexists") -> None:
    """One file with the content as one line of JSON."""
    text(spark, content).write.mode(mode).text(path)


def publish(spark: SparkSession, root: str, content: dict) -> None:
    """``content`` needs ``number`` and ``folder``; the largest number is the last one."""
    write_text(spark, content, f"{root}/manifests", "append")

"""The newest row of every key as a stored table that takes a run log in increments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowmend import errors, parallel, storage
from rowmend.operators.runlog import latest_per_key
from rowmend.sources import manifests

BUCKETS = 256
_BUCKET = "bucket__"


def upsert(
    spark: SparkSession, path: str, log: DataFrame, key: str, updated: str, seq: str, buckets: int = BUCKETS
) -> int:
    """Bring the rows of ``log`` into the snapshot at ``path``; returns the number of buckets written.

    Keys are dealt into buckets by hash, their number fixed by the first call. Only buckets with a key of ``log``
    are read and written again, as new files; one manifest at the end makes them the
    table. A call that breaks off changes nothing, and readers keep the files they have. One
    writer at a time. After any increments in any order the table equals ``latest_per_key`` of all their
    rows, provided (``updated``, ``seq``) tells the rows of a key apart; a repeated row changes
    nothing. Null is a key like any other. An empty log writes no bucket. Columns must stay the same.
    """
    root = path.rstrip("/")
    last = _last(spark, root)
    if last:
        if T.StructType.fromJson(last["schema"]).simpleString() != log.schema.simpleString():
            raise errors.DataError(errors.INVALID_INPUT, "the columns differ from the snapshot's", field="log", path=root)
        buckets = last["buckets"]
    number = last["number"] + 1 if last else 1
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    staged = storage.fresh_path(spark, "increment")
    latest_per_key(log, key, updated, seq).withColumn(_BUCKET, bucket).write.parquet(staged)
    news = spark.read.parquet(staged)
    touched = sorted(r[_BUCKET] for r in news.select(_BUCKET).distinct().collect())
    places = dict(last["places"]) if last else {}
    folder = f"rows-{number}-{uuid.uuid4().hex}"
    if touched:
        old = _rows(spark, root, log.schema, [places[str(b)] for b in touched if str(b) in places])
        merged = latest_per_key(news.drop(_BUCKET).unionByName(old), key, updated, seq).withColumn(_BUCKET, bucket)
        # Several tasks write a bucket where there are fewer buckets than tasks.
        part = F.pmod(F.xxhash64(F.lit(1), key), F.lit(max(1, parallel.tasks(spark) // len(touched))))
        merged.repartition(parallel.tasks(spark), _BUCKET, part).write.partitionBy(_BUCKET).parquet(f"{root}/{folder}")
        places |= {str(b): f"{folder}/{_BUCKET}={b}" for b in touched}
    if touched or not last:
        content = {"number": number, "folder": folder, "buckets": buckets, "schema": log.schema.jsonValue(), "places": places}
        manifests.publish(spark, root, content)
    storage.give_back(spark, staged)
    return len(touched)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last published increment."""
    root = path.rstrip("/")
    last = _last(spark, root)
    if not last:
        raise errors.DataError(errors.FILE_NOT_FOUND, "no published snapshot", path=root)
    return _rows(spark, root, T.StructType.fromJson(last["schema"]), list(last["places"].values()))


def give_back_superseded(spark: SparkSession, path: str) -> int:
    """Free the buckets that the last manifest does not name; for when nothing reads an earlier table."""
    root = path.rstrip("/")
    known = manifests.published(spark, root)
    kept = set(known[0]["places"].values()) if known else set()
    gone = sorted({place for m in known[1:] for place in m["places"].values()} - kept)
    storage.give_back(spark, *[f"{root}/{place}" for place in gone])
    return len(gone)


def _last(spark: SparkSession, root: str) -> dict | None:
    found = manifests.published(spark, root)
    return found[0] if found else None


def _rows(spark: SparkSession, root: str, schema: T.StructType, places: list[str]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{place}" for place in sorted(places)])

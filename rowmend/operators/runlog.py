"""Operators on a run log: one row per snapshot of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from rowmend.functions.values import epoch_ms, from_epoch_ms

# Fixed value: rows listed when no positive number is asked for.
DEFAULT_RECENT = 20


def latest_per_key(log: DataFrame, key: str, updated: str, seq: str) -> DataFrame:
    """The newest snapshot of every key.

    ``max_by`` on a struct keeps one row per key and task before the shuffle, so a key
    with a third of all snapshots costs no more than any other.
    """
    rest = [c for c in log.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(updated, seq)).alias("newest")
    return log.groupBy(key).agg(newest).select(key, "newest.*").select(*log.columns)


def recent_n(log: DataFrame, updated: str, n: int = DEFAULT_RECENT, ties: str | None = None) -> DataFrame:
    n = n if n > 0 else DEFAULT_RECENT
    order = [F.desc(updated)] + ([F.desc(ties)] if ties else [])
    return log.orderBy(*order).limit(n)


def keep_recent_n(latest: DataFrame, key: str, updated: str, n: int) -> DataFrame:
    """Drop all but the ``n`` newest keys; ``n`` of 0 or less keeps everything."""
    return recent_n(latest, updated, n, key) if n > 0 else latest


def lookup_by_key(log: DataFrame, key: str, value) -> DataFrame:
    return log.filter(F.col(key) == F.lit(value))


def parse_payload(log: DataFrame, payload: str, schema: T.StructType | str, name: str = "parsed") -> DataFrame:
    """JSON text to a struct column; text that is not JSON gives nulls."""
    return log.withColumn(name, F.from_json(payload, schema))


def render_payload(log: DataFrame, struct: str, name: str) -> DataFrame:
    return log.withColumn(name, F.to_json(struct))


def with_epoch_ms(log: DataFrame, moment: str, name: str) -> DataFrame:
    zoned = not isinstance(log.schema[moment].dataType, T.TimestampNTZType)
    return log.withColumn(name, epoch_ms(F.col(moment), zoned))


def with_timestamp(log: DataFrame, millis: str, name: str, zoned: bool = True) -> DataFrame:
    return log.withColumn(name, from_epoch_ms(F.col(millis), zoned))


__all__ = [
    "keep_recent_n", "latest_per_key", "lookup_by_key", "parse_payload", "recent_n",
    "render_payload", "with_epoch_ms", "with_timestamp"
]

"""URL rules by a sort-merge range join over reversed hosts."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowmend.llm import tables

SAMPLE_ROWS = 20_000
# Ends of host labels in keys; the escape keeps odd hosts apart from them.
END, AFTER, ESCAPE = "\x00", "\x01", "\x01\x02"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each with an end mark: a host's subdomains are one interval.

    The interval of ``example.net`` is all keys from ``net␀example␀`` to before the same
    with the last mark raised by one.
    """
    escaped = F.regexp_replace(F.regexp_replace(host, AFTER, ESCAPE), END, "\x01\x03")
    return F.concat(F.concat_ws(END, F.reverse(F.split(escaped, r"\."))), F.lit(END))


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    partitions: int | None = None,
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every page; rules are ``(host, path, verdict)``.

    A rule fits its host and all subdomains if the path starts with the rule's. The
    longest rule (host and path together) wins, then the longer host, then ``block``.
    Urls without rule get ``default``; null urls and urls without ``://`` have no host
    and path. Ids may be null or repeat.

    Pages are cut into ranges of (key, row hash), so one host may fill many ranges; the
    bounds come from a sample of bounded size and change only the cut. A rule goes to every range its
    interval touches. In a range both are sorted, and one sweep keeps the stack of rules
    whose intervals hold the current key: intervals nest, so what ended is on top.
    """
    spark = tables.ready(pages)
    n = partitions or tables.tasks(spark)
    url = F.col(url_col).cast("string")
    keyed = pages.select(
        F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
        F.xxhash64(F.monotonically_increasing_id(), url).alias("salt"),
    ).withColumn("key", host_key(F.col("host")))
    bounds = _bounds(keyed, n)
    id_type = keyed.schema["id"].dataType.simpleString()
    rows = keyed.select(
        "id", "host", "path", "salt", "key", F.lit(None).cast("string").alias("upto"), F.lit(None).cast("string").alias("verdict")
    )
    listed = rules.withColumn("key", host_key(F.lower("host"))).select(
        F.lit(None).cast(id_type).alias("id"), F.lower("host").alias("host"), "path", F.lit(None).cast("bigint").alias("salt"),
        "key", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit(AFTER)).alias("upto"), "verdict",
    )
    dealt = rows.unionByName(listed).mapInArrow(
        lambda batches: _deal(batches, bounds),
        f"range int, id {id_type}, host string, path string, salt bigint, key string, upto string, verdict string",
    )
    swept = dealt.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "key", F.col("upto").desc_nulls_last(), "salt")
    return swept.mapInArrow(
        lambda batches: _sweep(batches, default), f"id {id_type}, host string, path string, rule string, verdict string"
    )


def _bounds(keyed: DataFrame, n: int) -> list[tuple[str, int]]:
    """At most ``n - 1`` cuts from the rows with small salts, some ``SAMPLE_ROWS`` of all tasks together."""
    picked = keyed.filter(tables.hash_below("salt", SAMPLE_ROWS, keyed.count()))
    sample = sorted((r["key"], r["salt"]) for r in picked.select("key", "salt").collect())
    return sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []


def _deal(batches: Iterator[pa.RecordBatch], bounds: list) -> Iterator[pa.RecordBatch]:
    lowest = -(1 << 63)
    for batch in batches:
        rows, ranges = [], []
        columns = [batch.column(c).to_pylist() for c in ("key", "salt", "upto")]
        for i, (key, salt, upto) in enumerate(zip(*columns)):
            first = bisect.bisect_right(bounds, (key, lowest if salt is None else salt))
            last = first if upto is None else bisect.bisect_left(bounds, (upto, lowest))
            for at in range(first, last + 1):
                rows.append(i)
                ranges.append(at)
        taken = batch.take(pa.array(rows, pa.int64()))
        yield pa.record_batch([pa.array(ranges, pa.int32()), *taken.columns], ["range", *batch.schema.names])


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, str, str, str]] = []
    current = None
    for batch in batches:
        kept, rules, verdicts = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("range", "key", "upto", "host", "path", "verdict")]
        for i, (at, key, upto, host, path, verdict) in enumerate(zip(*columns)):
            if at != current:
                stack, current = [], at
            while stack and stack[-1][0] <= key:
                stack.pop()
            if upto is not None:
                stack.append((upto, host, path, verdict))
                continue
            best = max(
                ((len(h) + len(p), len(h), v == "block", h + p, v) for _, h, p, v in stack if path.startswith(p)),
                default=None,
            )
            kept.append(i)
            rules.append(best and best[3])
            verdicts.append(best[4] if best else default)
        taken = batch.take(pa.array(kept, pa.int64()))
        yield pa.record_batch(
            [taken.column("id"), taken.column("host"), taken.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
            ["id", "host", "path", "rule", "verdict"],
        )

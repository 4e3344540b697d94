"""Reproducible splits that do not depend on partitioning or row order.

Rows are ordered by the md5 of key and seed. For an exact share per class only the
hash at the cut is needed: counts per hash prefix locate it, and the few rows with that
prefix are ranked. The split itself is then a projection, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowmend import errors, storage

PREFIX = 4


def shuffle_hash(row_id: str, seed: str | int) -> Column:
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))


def class_shares(counts: dict, test_size: float) -> dict:
    """Training rows per class: proportional, the remainder to the largest fractions."""
    rows = sum(counts.values())
    train = rows - math.ceil(test_size * rows)
    whole = {c: train * n // rows for c, n in counts.items()}
    left = train - sum(whole.values())
    by_fraction = sorted(counts, key=lambda c: (-(train * counts[c] % rows), str(c)))
    for c in by_fraction[:left]:
        whole[c] += 1
    return whole


def stratified_split(
    df: DataFrame, label: str, row_id: str, test_size: float = 0.2, seed: str | int = 42,
    name: str = "is_train",
) -> DataFrame:
    """Add a boolean column: true for the training part, the exact share of every class."""
    hashed = df.select(F.col(label).alias("label"), F.col(row_id).alias("key"), shuffle_hash(row_id, seed).alias("h"))
    prefix = F.substring("h", 1, PREFIX)
    # One row per class and prefix: at most 16 ** PREFIX per class.
    sizes = storage.cut_lineage(
        hashed.groupBy("label", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    )
    counts = {r["label"]: r["n"] for r in sizes.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    rows = sum(counts.values())
    if len(counts) > 1:
        test = math.ceil(test_size * rows)
        if min(counts.values()) < 2 or rows - test < len(counts) or test < len(counts):
            raise errors.DataError(
                errors.INVALID_INPUT, "a class is too small for a stratified split",
                min_class_count=min(counts.values(), default=0),
            )
    wanted = class_shares(counts, test_size)
    along = Window.partitionBy("label").orderBy("prefix")
    located = (
        sizes.withColumn("upto", F.sum("n").over(along))
        .join(
            F.broadcast(df.sparkSession.createDataFrame(
                [(c, n) for c, n in wanted.items()], f"label {df.schema[label].dataType.simpleString()}, want long"
            )), "label",
        )
        .filter("upto >= want and upto - n < want")
        .select("label", "prefix", (F.col("want") - (F.col("upto") - F.col("n"))).alias("rank"))
    )
    at_cut = (
        hashed.withColumn("prefix", prefix).join(F.broadcast(located), ["label", "prefix"])
        .withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("h", "key")))
        .filter("place = rank").select("label", "h", "key").collect()
    )
    cuts = {r["label"]: (r["h"], r["key"]) for r in at_cut}
    h, key = shuffle_hash(row_id, seed), F.col(row_id)
    inside = F.lit(False)
    for c, (cut_hash, cut_key) in cuts.items():
        before = (h < F.lit(cut_hash)) | ((h == F.lit(cut_hash)) & (key <= F.lit(cut_key)))
        inside = F.when(F.col(label) == F.lit(c), before).otherwise(inside)
    return df.withColumn(name, inside)


def validation_split(
    train: DataFrame, label: str, row_id: str, size: float = 0.25, seed: str | int = 42,
    name: str = "is_fit",
) -> DataFrame:
    """A second stratified split of the training rows.

    A size outside (0, 0.5) becomes 0.25. If a class is too small every row is marked
    for fitting and the caller validates on the training rows.
    """
    if not 0.0 < size < 0.5:
        size = 0.25
    try:
        return stratified_split(train, label, row_id, size, f"{seed}:val", name)
    except errors.DataError:
        return train.withColumn(name, F.lit(True))


def random_split(
    df: DataFrame, row_id: str, test_size: float = 0.2, seed: str | int = 42, name: str = "is_train"
) -> DataFrame:
    """An unstratified split by hash: each row decides alone."""
    slot = F.pmod(F.conv(F.substring(shuffle_hash(row_id, seed), 1, 8), 16, 10).cast("long"), F.lit(10_000))
    return df.withColumn(name, slot >= F.lit(int(round(test_size * 10_000))))

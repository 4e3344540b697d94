"""How many tasks a stage should have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A file this small is read by one task, however many cores there are.
_LARGE_PIECE = 64 << 20
_SMALL_PIECE = 256 << 10


def tasks(spark: SparkSession) -> int:
    """Partitions for a stage whose cost is computation rather than bytes."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, spark.sparkContext.defaultParallelism)


def input_bytes(df: DataFrame) -> int:
    """Estimated bytes of all tables the plan reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def is_small(df: DataFrame) -> bool:
    """Read from fewer bytes than it takes to give every core a full piece."""
    return input_bytes(df) < tasks(df.sparkSession) * _LARGE_PIECE


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a table read from so few bytes that most cores would idle.

    Inputs large enough for a task per core stay as they are: moving them would cost
    more than it brings.
    """
    if not is_small(df):
        return df
    pieces = _pieces(df)
    return df.repartition(pieces, *keys) if pieces > 1 else df


def settle(df: DataFrame, key: str) -> DataFrame:
    """Rows in partitions and an order that depend on the key alone, so that sums over
    them come out the same however the table was dealt before."""
    return df.repartition(_pieces(df), key).sortWithinPartitions(key)


def _pieces(df: DataFrame) -> int:
    return int(max(1, min(tasks(df.sparkSession), -(-input_bytes(df) // _SMALL_PIECE))))

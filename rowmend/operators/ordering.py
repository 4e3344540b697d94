"""Running totals and dense positions over a whole table, without one task seeing it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowmend import parallel, storage

# Rows a task sorts; longer tables get more tasks.
ROWS_PER_TASK = 1_000_000


def _range_sorted(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows sorted by one range shuffle, with their partition (``part``) and place in it.

    The sorted rows are written out, so that a lost executor cannot produce other
    partition boundaries. The number of partitions follows the number of rows.
    """
    tasks = max(parallel.tasks(df.sparkSession), -(-df.count() // ROWS_PER_TASK))
    placed = storage.cut_lineage(
        df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    return placed.withColumns({
        "part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1)),
    })


def running_totals(df: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """Add ``<s>_upto`` (running sum by descending ``order``) and ``<s>_next`` (following row).

    ``order`` has distinct values. The table is sorted by ranges; a range is summed on its
    own and lifted by the total of those before it. The table of range totals has one row
    per task.
    """
    placed = _range_sorted(df, [F.desc(order)])
    totals = placed.groupBy("part").agg(
        *[F.sum(s).alias(f"{s}_total") for s in sums],
        F.min_by(F.struct(*sums), "place").alias("first_row"),
    )
    along = Window.orderBy("part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        *[F.coalesce(F.sum(f"{s}_total").over(before), F.lit(0)).alias(f"{s}_before") for s in sums],
        F.lead("first_row").over(along).alias("next_row"),
    )
    inside = Window.partitionBy("part").orderBy("place")
    summed = placed.select(
        "*",
        *[F.sum(s).over(inside).alias(f"{s}_inside") for s in sums],
        *[F.lead(s).over(inside).alias(f"{s}_lead") for s in sums],
    )
    joined = summed.join(F.broadcast(offsets), "part")
    return joined.select(
        *df.columns,
        *[(F.col(f"{s}_inside") + F.col(f"{s}_before")).alias(f"{s}_upto") for s in sums],
        *[F.coalesce(f"{s}_lead", f"next_row.{s}").alias(f"{s}_next") for s in sums],
    )


def dense_positions(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """Add the position of each row in the global order as a long column: its place in its
    range plus the rows of the ranges before."""
    placed = _range_sorted(df, order)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(offsets), "part").select(
        *df.columns, (F.col("before") + F.col("place") + F.lit(start)).alias(name)
    )

"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmend.llm import tables

PREFIX = 64


def normalised(column: str) -> Column:
    """The text with every run of white space as one space; null is empty.

    Only runs that are not already a single space are looked for, as most are.
    """
    return F.regexp_replace(tables.text_or_empty(column), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _group_key() -> Column:
    return F.xxhash64("length", "prefix_hash")


def surviving_groups(sketches: DataFrame) -> DataFrame:
    """``(length, prefix_hash)`` of groups that more than one row still shares.

    Lengths that occur once leave before prefix hashes are compared. Both counts combine
    in the map tasks, so a length that a third of all rows share is one row per task.
    """
    lengths = sketches.groupBy("length").agg(F.sum("n").alias("n")).filter("n > 1").select("length")
    return (
        sketches.join(lengths, "length", "left_semi")
        .groupBy("length", "prefix_hash").agg(F.sum("n").alias("n")).filter("n > 1")
        .select("length", "prefix_hash")
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_hashes: bool = False,
    row_col: str | None = None,
) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_hash)``, one row per input row (and ``row`` if given).

    Texts are equal when equal after ``normalised``; null equals the empty text. The row
    with the smallest id stays; a null id comes before all others. Of rows that repeat
    id and text, exactly one stays. Only rows of surviving groups have their full text
    hashed (SHA-256); ``all_hashes`` fills in ``text_hash`` for the others as a report.
    An empty table gives an empty result. Other columns are not looked at.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    base = docs.select(F.col(id_col).alias("id"), number.alias("row"), normalised(text_col).alias("norm"))
    sketch = base.select(
        "id", "row", "norm", F.length("norm").alias("length"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix_hash")
    )
    counted = tables.written(
        sketch.groupBy("length", "prefix_hash").agg(F.count(F.lit(1)).alias("n")), "dedup-sketches"
    )
    groups = tables.written(surviving_groups(counted), "dedup-survivors")
    marked = tables.only_possible(sketch, _group_key(), groups, _group_key(), "survives")
    full = F.sha2("norm", 256)
    hashed = tables.written(
        marked.select(
            "id", "row", "length", "survives",
            (full if all_hashes else F.when(F.col("survives"), full)).alias("text_hash"),
        ),
        "dedup-hashes",
    )
    copies = tables.written(
        hashed.filter("survives").groupBy("length", "text_hash")
        .agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1"),
        "dedup-copies",
    )
    return hashed.join(copies, ["length", "text_hash"], "left").select(
        "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (F.col("n").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        "text_hash",
        *(["row"] if row_col else []),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows are told apart by their place in their files, so even rows that repeat in every
    column are, and stay so when a task runs again. Only ids and hashes go through
    exchanges; of the texts, those of rows that may be dropped.
    """
    numbered = tables.numbered(docs, "dedup-rows")
    flat = numbered.select(F.col(f"whole.`{id_col}`").alias("id"), F.col(f"whole.`{text_col}`").alias("text"), "row")
    dropped = exact_groups(flat, "id", "text", row_col="row").filter(~F.col("kept")).select("row")
    return tables.without(numbered, tables.written(dropped, "dedup-dropped"))

"""Values at given ranks by radix selection: histograms of fixed size, narrowed digit by digit.

A number is read as four digits that keep its order, sixteen bits each. A pass counts
rows per digit below the prefixes still wanted and keeps the digit that holds each
rank. No pass sorts rows, and no task holds a column: an exchange carries at most 2^17
counts per prefix, whatever the number of rows or copies of a value.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, functions as F

DIGITS = 4
_BITS = 16
_LOW = (1 << _BITS) - 1
# Exponents of doubles start here; infinities come after all of them.
_FIRST_EXPONENT = -1075
_INFINITE = 1 << 16


@dataclass(frozen=True)
class Hit:
    """A wanted rank: the value there, rows of the column, and rows below the value."""

    value: float | int
    rank: int
    rows: int
    below: int


def double_digit(df: DataFrame, level: int) -> DataFrame:
    """Add ``digit`` of ``value``: the exponent with four bits, or sixteen of the other 48 bits, signed.

    Powers of two divide exactly, so no bit is lost; the estimate of the exponent is set right.
    """
    size = F.abs("value")
    power = F.pow(F.lit(2.0), F.col("guess"))
    exponent = F.col("guess") + F.when(size < power, -1).when(size >= power * 2, 1).otherwise(0)
    fraction = ((size / F.pow(F.lit(2.0), F.col("exponent")) - 1) * float(1 << 52)).cast("long")
    steps = df.withColumn("guess", F.when(size < float("inf"), F.floor(F.log2(size)))).withColumn("exponent", exponent).withColumn("fraction", fraction)
    if level:
        part = F.shiftright("fraction", _BITS * (DIGITS - 1 - level)).bitwiseAND(F.lit(_LOW))
    else:
        part = (F.col("exponent") - _FIRST_EXPONENT) * 16 + F.shiftright("fraction", 48)
    sign = F.when(F.col("value") < 0, -1).otherwise(1)
    infinite = F.lit(0 if level else _INFINITE)
    digit = sign * F.when(size == 0, 0).when(size == float("inf"), infinite).otherwise(part)
    return steps.withColumn("digit", digit.cast("int")).drop("guess", "exponent", "fraction")


def long_digit(df: DataFrame, level: int) -> DataFrame:
    """Add ``digit`` of a long ``value``: the signed upper bits, or sixteen of the others."""
    part = F.shiftright("value", _BITS * (DIGITS - 1 - level))
    return df.withColumn("digit", (part.bitwiseAND(F.lit(_LOW)) if level else part).cast("int"))


def select_ranks(
    df: DataFrame, columns: list[str], wanted: list[tuple[int, float | int, bool]], digit=double_digit, first: int = 0
) -> list[Hit | None]:
    """The ``Hit`` of every ``(column number, position, upwards)``, None for a column without values.

    A position is a rank from 0, or as a float a share of the last rank, rounded up if
    ``upwards``; a rank beyond the rows has no hit. All values share the digits before
    ``first``. Every pass reads the columns once; after the first it takes only values
    between the ends of a cell that holds a wanted rank. A value that is alone in
    its cell is found early, so short or coarse columns need one or two passes.
    """
    spark = df.sparkSession
    each = F.array(*[F.struct(F.lit(i).alias("number"), F.col(c).alias("value")) for i, c in enumerate(columns)])
    entries = df.select(F.inline(each)).filter("value is not null")
    kind = entries.schema["value"].dataType.simpleString()
    found: list[Hit | None] = [None] * len(wanted)
    # A row per wanted rank: its column, the cell it is in, its place in that cell, and rows below the cell.
    open_ones = [
        (w, number, 0, at if isinstance(at, float) else None, upwards, None if isinstance(at, float) else at, 0)
        for w, (number, at, upwards) in enumerate(wanted)
    ]
    cells: dict[tuple, int] = {}
    totals: dict[int, int] = {}
    for level in range(first, DIGITS):
        if not open_ones:
            break
        inside = entries.withColumn("cell", F.lit(0))
        if cells:
            # At most a row per wanted rank.
            table = spark.createDataFrame([(*key, cell) for key, cell in cells.items()], f"of int, low {kind}, high {kind}, cell int")
            own = (F.col("number") == F.col("of")) & F.col("value").between(F.col("low"), F.col("high"))
            inside = entries.join(F.broadcast(table), own).select("number", "value", "cell")
        counted = digit(inside, level).groupBy("number", "cell", "digit").agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        cell = Window.partitionBy("number", "cell")
        summed = counted.select("*", F.sum("n").over(cell.orderBy("digit")).alias("upto"), F.sum("n").over(cell).alias("total"))
        goals = spark.createDataFrame(open_ones, "w int, number int, cell int, share double, upwards boolean, rank long, below long")
        share = (F.col("total") - 1) * F.col("share")
        at = F.coalesce("rank", F.when(F.col("upwards"), F.ceil(share)).otherwise(F.floor(share)))
        hits = summed.join(F.broadcast(goals), ["number", "cell"]).withColumn("at", at).filter(
            (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))
        ).collect()
        open_ones, cells = [], {}
        for r in hits:
            totals.setdefault(r["number"], r["total"])
            before = r["upto"] - r["n"]
            if r["low"] == r["high"] or level == DIGITS - 1:
                found[r["w"]] = Hit(r["low"], r["below"] + r["at"], totals[r["number"]], r["below"] + before)
            else:
                number = cells.setdefault((r["number"], r["low"], r["high"]), len(cells))
                open_ones.append((r["w"], r["number"], number, None, False, r["at"] - before, r["below"] + before))
    return found


def values_at(df: DataFrame, column: str, ranks: list[int], low: int, high: int) -> list[Hit | None]:
    """The ``Hit`` of each rank (from 0) of an integer column between ``low`` and ``high``, nulls left out."""
    base = low if high - low < 1 << 63 else 0
    first = DIGITS - 1 - ((high - low).bit_length() - 1) // _BITS if base == low and high > low else 0
    keys = df.select((F.col(column).cast("long") - F.lit(base)).alias("key"))
    hits = select_ranks(keys, ["key"], [(0, r, False) for r in ranks], long_digit, first)
    return [h and replace(h, value=h.value + base) for h in hits]

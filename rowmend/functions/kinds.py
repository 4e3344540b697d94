"""Which columns are discrete, which numeric, and the feature description built on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: integer columns with at most this many distinct values are discrete.
DISCRETE_LIMIT = 12

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = _INTEGERS + (T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Feature:
    """One feature as the distance and the repair see it."""

    name: str
    discrete: bool
    weight: float = 1.0
    scale: float = 1.0


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGERS)


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMBERS)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the type has one."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def as_number(name: str) -> Column:
    """The value as a double; NaN and whatever does not parse become null."""
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def distinct_up_to(df: DataFrame, columns: list[str], limit: int) -> dict[str, int]:
    """Exact distinct counts where they are near or below ``limit``, estimates above.

    The sketch pass is one map-side aggregate for all columns. Only columns whose
    estimate is small are counted exactly, with sets that are therefore small too.
    """
    if not columns:
        return {}
    sketch = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    counts = {c: int(sketch[c]) for c in columns}
    near = [c for c in columns if counts[c] <= 2 * limit + 8]
    if near:
        exact = df.agg(*[F.size(F.collect_set(c)).alias(c) for c in near]).first()
        counts.update({c: int(exact[c]) for c in near})
    return counts


def discrete_flags(
    df: DataFrame, columns: list[str], overrides: dict[str, bool] | None = None
) -> dict[str, bool]:
    """Strings and booleans are discrete, integers up to the limit too, the rest numeric."""
    overrides = overrides or {}
    types = {c: df.schema[c].dataType for c in columns}
    integers = [c for c in columns if is_integer(types[c]) and c not in overrides]
    counts = distinct_up_to(df, integers, DISCRETE_LIMIT)
    flags = {}
    for c in columns:
        if c in overrides:
            flags[c] = overrides[c]
        elif c in counts:
            flags[c] = counts[c] <= DISCRETE_LIMIT
        else:
            flags[c] = not is_number(types[c])
    return flags

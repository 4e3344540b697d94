"""Table profiling: overview, missing values, numeric statistics, value shares, target checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowmend import errors
from rowmend.functions import kinds
from rowmend.operators.quantiles import exact_quantiles

# Fixed values of the target check.
MAX_CLASSES = 20
MAX_CLASS_SHARE = 0.2

# Stored width in bytes of one value of each type.
_WIDTHS = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8,
    "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def table_overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, logical kilobytes."""
    missing = sum((F.sum(kinds.is_missing(df, c).cast("long")) for c in df.columns), F.lit(0))
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            size = size + F.coalesce(F.sum(F.octet_length(f.name).cast("long")), F.lit(0))
        else:
            size = size + F.count(F.lit(1)) * F.lit(_WIDTHS.get(f.dataType.simpleString(), 8))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.coalesce(missing, F.lit(0)).cast("long").alias("missing_cells"),
        F.round(size / 1024.0, 6).alias("size_kb"),
    )


def column_kinds(df: DataFrame) -> DataFrame:
    """``(column, spark_type, kind)`` from the schema alone."""
    rows = []
    for f in df.schema.fields:
        kind = "numeric" if kinds.is_number(f.dataType) else "categorical"
        rows.append((f.name, f.dataType.simpleString(), kind))
    return df.sparkSession.createDataFrame(rows, "column string, spark_type string, kind string")


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values, their number and percent of all rows, most first."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.sum(kinds.is_missing(df, c).cast("long")).alias("missing_count"),
                )
                for c in df.columns
            ]
        ).alias("found"),
    )
    return (
        counts.select("n_rows", F.inline("found"))
        .filter("missing_count > 0")
        .select(
            "column", "missing_count",
            F.round(F.col("missing_count") / F.col("n_rows") * 100, 2).alias("missing_percent"),
        )
        .orderBy(F.desc("missing_count"), "column")
    )


def numeric_describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per numeric column."""
    cols = cols or kinds.numeric_columns(df)
    if not cols:
        raise errors.DataError(errors.INVALID_INPUT, "no numeric columns to describe")
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    entries = []
    for c in cols:
        value = kinds.as_number(c)
        low, middle, high = (F.lit(q).cast("double") for q in quartiles[c])
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(value).alias("n"),
                F.round(F.avg(value), 2).alias("mean"),
                F.round(F.stddev_samp(value), 2).alias("std"),
                F.round(F.min(value), 2).alias("min"),
                F.round(low, 2).alias("p25"),
                F.round(middle, 2).alias("p50"),
                F.round(high, 2).alias("p75"),
                F.round(F.max(value), 2).alias("max"),
            )
        )
    return df.agg(F.array(*entries).alias("found")).select(F.inline("found"))


def category_distribution(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, value, n, percent)`` for all categorical columns in one pass; nulls left out."""
    cols = cols or kinds.text_columns(df)
    rows = df.count()
    values = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value"
    )
    # Every column has all rows, so the share needs no total per column.
    return (
        values.filter("value is not null")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("percent", F.round(F.col("n") / F.lit(max(rows, 1)) * 100, 2))
        .orderBy("column", F.desc("n"), "value")
    )


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Normal (0) and anomalous (1) rows with shares, imbalance ratio and positive rate."""
    y = F.col(target)
    n_normal = F.sum(F.when(y == 0, 1).otherwise(0))
    n_anomaly = F.sum(F.when(y == 1, 1).otherwise(0))
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        n_normal.alias("n_normal"),
        n_anomaly.alias("n_anomaly"),
        F.round(F.avg(y.cast("double")), 6).alias("positive_rate"),
    )
    return counted.select(
        "n_rows", "n_normal", "n_anomaly", "positive_rate",
        F.round(F.col("n_normal") / F.col("n_rows") * 100, 1).alias("normal_percent"),
        F.round(F.col("n_anomaly") / F.col("n_rows") * 100, 1).alias("anomaly_percent"),
        F.when(
            F.col("n_anomaly") > 0,
            F.concat(F.lit("1:"), F.expr("n_normal div greatest(n_anomaly, 1)").cast("string")),
        ).otherwise("N/A").alias("imbalance_ratio"),
    )


def target_check(df: DataFrame, target: str, strict: bool = True) -> DataFrame:
    """One diagnostic row saying whether the column can be a classification target.

    The first failing rule names the code. In strict mode a failure raises.
    """
    if target not in df.columns:
        raise errors.DataError(
            errors.INVALID_TARGET_COLUMN, f"target column not found: {target}", available_columns=df.columns
        )
    dtype = df.schema[target].dataType
    is_float = isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType))
    missing = kinds.is_missing(df, target)
    classes = df.select(F.when(~missing, F.col(target)).alias("value")).groupBy("value").agg(
        F.count(F.lit(1)).alias("n")
    )
    known = F.col("value").isNotNull()
    counts = classes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count(F.when(known, 1)).alias("unique_count"),
        F.coalesce(F.min(F.when(known, F.col("n"))), F.lit(0)).alias("min_class_count"),
    )
    filled = F.col("n_rows") - F.col("missing_count")
    ratio = F.when(filled > 0, F.col("unique_count") / filled).otherwise(0.0)
    many = F.col("unique_count") > MAX_CLASSES
    continuous: Column = F.lit(False)
    if is_float:
        continuous = many
    elif kinds.is_number(dtype):
        continuous = many & (ratio > MAX_CLASS_SHARE)
    code = (
        F.when(continuous, errors.UNSUPPORTED_TARGET_TYPE)
        .when(F.col("missing_count") > 0, errors.INVALID_INPUT)
        .when(F.col("unique_count") < 2, errors.INVALID_INPUT)
        .when(F.col("min_class_count") < 2, errors.INVALID_INPUT)
        .otherwise("OK")
    )
    reason = (
        F.when(continuous, "target looks continuous")
        .when(F.col("missing_count") > 0, "target has missing values")
        .when(F.col("unique_count") < 2, "target has fewer than two classes")
        .when(F.col("min_class_count") < 2, "a class has fewer than two rows")
        .otherwise("")
    )
    hint = (
        F.when(continuous, "choose a categorical label")
        .when(F.col("missing_count") > 0, "fill or drop the rows without a label")
        .when(F.col("unique_count") < 2, "provide rows of a second class")
        .when(F.col("min_class_count") < 2, "merge rare classes or add rows")
        .otherwise("")
    )
    result = counts.select(
        F.lit(target).alias("target"), "n_rows", "missing_count", "unique_count",
        F.round(ratio, 6).alias("unique_ratio"), "min_class_count",
        code.alias("code"), reason.alias("reason"), hint.alias("suggestion"),
    )
    if strict:
        row = result.first()
        if row["code"] != "OK":
            details = row.asDict()
            details.pop("code")
            raise errors.DataError(row["code"], f"{row['reason']}: {target}", **details)
    return result


def discrete_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, kind)`` by the discrete-or-numeric rule."""
    flags = kinds.discrete_flags(df, cols or df.columns)
    rows = [(c, "discrete" if flag else "numeric") for c, flag in flags.items()]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")

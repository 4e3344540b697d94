"""Cleaning and feature preparation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Imputer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rowmend import parallel, storage
from rowmend.functions import kinds
from rowmend.operators.ordering import dense_positions

# Fixed value: the class that missing categories form.
MISSING_CLASS = "nan"
# What the values of a column may take to be sent to every executor.
BROADCAST_BYTES = 32 << 20
# A column with no more values and bytes than these has them in the plan itself.
PLAN_VALUES, PLAN_BYTES = 64, 8 << 10
# Frequent values of a column that are looked for before its rows are shuffled.
HOT_VALUES = 256
SALTS_PER_TASK = 4


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def fit_means(train: DataFrame, columns: list[str]):
    """Column means of the training rows, as a model that fills gaps in any table."""
    return Imputer(strategy="mean", inputCols=columns, outputCols=[f"{c}_filled" for c in columns]).fit(train)


def mean_impute(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """Fill missing numbers with the mean of ``train`` (default: of the table itself)."""
    model = fit_means(train if train is not None else df, columns)
    filled = model.transform(df)
    replace = {c: F.col(f"{c}_filled").cast("double") for c in columns}
    return filled.withColumns(replace).drop(*[f"{c}_filled" for c in columns])


def row_filter(df: DataFrame, column: str, excluded) -> DataFrame:
    """Rows whose value differs from ``excluded``; missing values differ and stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(excluded)))


def class_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING_CLASS))


@dataclass(frozen=True)
class ValueTable:
    """``(column, value, <number>)``, and how each column's values reach the rows that ask for them.

    ``few`` holds the numbers of columns with few short values, ``light`` names the columns
    whose values may be broadcast; the others are joined by a shuffle.
    """

    rows: DataFrame
    number: str
    few: dict[str, dict]
    light: frozenset[str]


def value_table(rows: DataFrame, number: str) -> ValueTable:
    """Measure a written table of distinct values; at most ``PLAN_BYTES`` per column come to the driver."""
    sizes = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 48).alias("bytes")
    ).collect()
    short = [r["column"] for r in sizes if r["n"] <= PLAN_VALUES and r["bytes"] <= PLAN_BYTES]
    few: dict[str, dict] = {c: {} for c in short}
    for r in rows.filter(F.col("column").isin(short)).collect() if short else []:
        few[r["column"]][r["value"]] = r[number]
    return ValueTable(rows, number, few, frozenset(r["column"] for r in sizes if r["bytes"] <= BROADCAST_BYTES))


def look_up(df: DataFrame, table: ValueTable, texts: dict[str, Column], names: dict[str, str]) -> DataFrame:
    """Add ``names[c]``: the number of the value that ``texts[c]`` has, null for nulls and unknown values.

    Columns with few values need no join, and those with up to ``BROADCAST_BYTES`` no shuffle. For the
    rest one pass counts frequent values with a counter of fixed size, known values or not; their
    rows are dealt under several salts and their numbers repeated under each, so that no
    task gets all rows of a value. A stream is joined without salts.
    """
    kind = table.rows.schema[table.number].dataType
    in_plan = {}
    for c, numbers in table.few.items():
        if c in texts:
            pairs = [F.lit(x) for pair in numbers.items() for x in pair]
            in_plan[names[c]] = F.element_at(F.create_map(*pairs), texts[c]).cast(kind)
    large = [c for c in texts if c not in table.few and c not in table.light]
    large = [c for c in large if not table.rows.filter(F.col("column") == c).isEmpty()] if large else []
    hot = _frequent(df, {c: texts[c] for c in large}) if large and not df.isStreaming else {}
    plain = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    row = F.xxhash64(F.spark_partition_id(), *[c.cast("string") for c in plain])
    salts = SALTS_PER_TASK * parallel.tasks(df.sparkSession)
    out, passing = df, []
    for i, c in enumerate(c for c in texts if c not in table.few):
        known = table.rows.filter(F.col("column") == c).select(
            F.col("value").alias(f"__value{i}"), F.col(table.number).cast(kind).alias(names[c])
        )
        same = texts[c] == F.col(f"__value{i}")
        if c not in large:
            known = F.broadcast(known)
        elif hot.get(c):
            every = F.when(F.xxhash64(f"__value{i}").isin(hot[c]), F.sequence(F.lit(0), F.lit(salts - 1)))
            known = known.withColumn(f"__salt{i}", F.explode(F.coalesce(every, F.array(F.lit(0)))))
            own = F.when(F.xxhash64(texts[c]).isin(hot[c]), F.pmod(row, F.lit(salts)).cast("int")).otherwise(0)
            out = out.withColumn(f"__own{i}", own)
            same = same & (F.col(f"__own{i}") == F.col(f"__salt{i}"))
            passing += [f"__own{i}", f"__salt{i}"]
        out = out.join(known, same, "left")
        passing.append(f"__value{i}")
    return out.withColumns(in_plan).drop(*passing) if in_plan else out.drop(*passing)


def _frequent(df: DataFrame, texts: dict[str, Column]) -> dict[str, list[int]]:
    """Hashes of values that may be frequent, at most ``HOT_VALUES`` per column, from one pass."""
    hashed = df.select(*[F.xxhash64(text).alias(f"h{i}") for i, text in enumerate(texts.values())])
    found = hashed.agg(*[F.expr(f"approx_top_k(h{i}, {HOT_VALUES})").alias(f"h{i}") for i in range(len(texts))]).first()
    return {c: [r["item"] for r in found[i] or []] for i, c in enumerate(texts)}


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, code)``: dense codes in the order of the values, per column."""
    values = (
        df.select(*[class_text(c).alias(c) for c in columns])
        .unpivot([], columns, "column", "value")
        .distinct()
    )
    placed = dense_positions(values, ["column", "value"], "position")
    first = placed.groupBy("column").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "column").select(
        "column", "value", (F.col("position") - F.col("first")).cast("int").alias("code")
    )


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<c>_idx`` with the code of each value; the raw column stays."""
    codes = value_table(storage.cut_lineage(label_codes(df, columns)), "code")
    return look_up(df, codes, {c: class_text(c) for c in columns}, {c: f"{c}_idx" for c in columns})


def levels(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted values of the given columns, as many as there are: the wide form names a column after each."""
    found = df.agg(
        *[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns]
    ).first()
    return {c: list(found[c]) for c in columns}


def one_hot_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, column, value)`` of the flags that are set: for columns of any number of values."""
    return df.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        key, columns, "column", "value"
    ).filter(F.col("value").isNotNull())


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by one boolean column per value, without the first value."""
    known = levels(df, columns)
    flags = [
        F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
        for c in columns for v in known[c][1:]
    ]
    return df.select(*[c for c in df.columns if c not in columns], *flags)


def flag_places(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, place)``: where the flag of a value stands in a sparse row.

    Columns and then values are in order, the first value of a column has no flag. Places
    come from one range shuffle; the values stay on the executors.
    """
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    values = texts.unpivot([], columns, "column", "value").filter(F.col("value").isNotNull()).distinct()
    placed = storage.cut_lineage(dense_positions(values, ["column", "value"], "position"))
    first = placed.groupBy("column").agg(F.min("position").alias("first")).select(
        "column", "first", F.row_number().over(Window.orderBy("column")).alias("number")
    )
    return placed.join(F.broadcast(first), "column").filter(F.col("position") > F.col("first")).select(
        "column", "value", (F.col("position") - F.col("number")).alias("place")
    )


def one_hot_sparse(df: DataFrame, columns: list[str], name: str = "flags") -> tuple[DataFrame, DataFrame]:
    """The rows with the ascending places of their set flags instead of ``columns``, and ``flag_places``.

    The same flags as ``one_hot`` for columns of any number of values: a row has at most one
    place per column. The values of a column are broadcast up to ``BROADCAST_BYTES``,
    measured, and joined by a shuffle beyond.
    """
    places = flag_places(df, columns)
    texts = {c: F.col(c).cast("string") for c in columns}
    df = look_up(df, value_table(places, "place"), texts, {c: f"__place{i}" for i, c in enumerate(columns)})
    flags = F.array_sort(F.array_compact(F.array(*[f"__place{i}" for i in range(len(columns))])))
    return df.withColumn(name, flags).drop(*columns, *[f"__place{i}" for i in range(len(columns))]), places


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<c>_z``: (x - mean) / population deviation; a constant column is only centred."""
    stats = df.agg(
        *[F.avg(kinds.as_number(c)).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(kinds.as_number(c)).alias(f"s_{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        mean, deviation = stats[f"m_{i}"], stats[f"s_{i}"]
        scaled[f"{c}_z"] = (kinds.as_number(c) - F.lit(mean)) / F.lit(deviation or 1.0)
    return df.withColumns(scaled)


def class_weights(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    """Add the balanced weight rows / (classes * rows of the class).

    Rows without a label count for no class and keep a null weight. The weights, a row per class,
    go to the rows: a shuffle by label would put all rows of a class into one task.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    weight = F.lit(float(totals["rows"] or 0)) / (F.lit(totals["classes"]) * F.col("n"))
    return df.join(F.broadcast(counts.select(label, weight.alias(name))), label, "left")


def healthy_pool(train: DataFrame, label: str, normal_value=0) -> DataFrame:
    """Training rows with the normal label; all of them if there is none."""
    healthy = train.filter(F.col(label) == normal_value)
    return train if healthy.isEmpty() else healthy

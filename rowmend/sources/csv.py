"""CSV files with a header, missing-value tokens and inferred types."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowmend import errors, shipping
from rowmend.sources import records

# Texts read as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


# Quotes are doubled inside quoted fields, and quoted fields may hold line breaks.
FORMAT = {"quote": '"', "escape": '"'}
_BAD = "c_bad"


def normalise_columns(names: list[str]) -> list[tuple[int, str]]:
    """Position and clean name of the columns to keep.

    Names are trimmed, a byte-order mark is removed, blanks become ``column_<i>``, and
    of equal names the first stays.
    """
    kept, seen = [], set()
    for i, raw in enumerate(names):
        name = raw.strip()
        if i == 0:
            name = name.removeprefix("﻿").strip()
        name = name or f"column_{i + 1}"
        if name not in seen:
            seen.add(name)
            kept.append((i, name))
    return kept


def _header(spark: SparkSession, path: str, multi_line: bool) -> list[str]:
    try:
        line = spark.read.csv(path, header=False, multiLine=multi_line, **FORMAT).limit(1).collect()
    except AnalysisException as problem:
        raise errors.DataError(errors.FILE_NOT_FOUND, f"cannot open {path}", path=path) from problem
    except Exception as problem:
        raise errors.DataError(errors.CSV_READ_FAILED, f"cannot read {path}", path=path) from problem
    if not line:
        raise errors.DataError(errors.CSV_READ_FAILED, "csv file is empty", path=path)
    return [value or "" for value in line[0]]


def _refuse_long_records(raw: DataFrame, width: int, path: str) -> None:
    unquoted = F.regexp_replace(_BAD, r'"(?:[^"]|"")*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    long = F.when(F.col(_BAD).isNotNull() & (fields > width), F.col(_BAD))
    # Spark wants another column beside the one that keeps bad records.
    found = raw.agg(F.count(raw.columns[0]), F.count(long), F.min(long)).first()
    if found[1]:
        raise errors.DataError(
            errors.CSV_READ_FAILED, f"{found[1]} records have more than {width} fields", path=path, record=found[2]
        )


def _read(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> tuple[DataFrame, DataFrame]:
    """Texts of all fields, and the same with every field parsed, so that long records show.

    Files without line breaks in fields are split by Spark's own reader, the others by ``records``.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, **FORMAT}

    def plain(paths: str | list[str], **more) -> tuple[DataFrame, DataFrame]:
        read = [
            spark.read.option("columnPruning", pruned).csv(paths, header=True, schema=schema, enforceSchema=True, **options, **more)
            for pruned in (True, False)
        ]
        return read[0], read[1]

    if not multi_line:
        return plain(path)
    shipping.ship_package(spark)
    text = records.lines(spark, path)
    spans, broken = records.open_spans(text)
    if not broken:
        return plain(path)
    # One row per file: whether its first line ends in a return, and whether it has others.
    heads = text.withColumn("place", F.monotonically_increasing_id()).filter("start = 0")
    firsts = heads.groupBy("file").agg(F.min_by("line", "place").alias("line")).collect()
    if any("\r" in r["line"][:-1] for r in firsts if r["file"] in broken):
        return plain(path, multiLine=True)
    files = [(r["file"], r["line"].endswith("\r")) for r in firsts if r["file"] in broken]
    ddl = ", ".join(f"{f.name} string" for f in schema.fields)
    parsed = records.records(text, spans, files).select(
        F.from_csv("record", ddl, {**options, "multiLine": "true", "lineSep": "\n"}).alias("r")
    ).select("r.*")
    others = [r["file"] for r in firsts if r["file"] not in broken]
    if not others:
        return parsed, parsed
    rest = plain(others)
    return parsed.unionByName(rest[0]), parsed.unionByName(rest[1])


def csv_scan(
    spark: SparkSession, path: str, schema: T.StructType | None = None, tokens: list[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Read a CSV. Without a schema each column becomes long, double or string.

    Everything is read as text so that a list of tokens can mean missing. One aggregate
    over all columns then decides the types. Records with more fields than the header
    raise; those with fewer end in missing values.

    Quoted fields may hold line breaks. Ranges of a file are cut into records side by side
    (``records``); files without such fields are split by Spark's reader, files whose
    lines end in returns alone go whole through one task. ``multi_line=False`` says that no
    field has a line break, and saves the pass that looks for them.
    """
    header = _header(spark, path, multi_line)
    kept = normalise_columns(header)
    width = len(header)
    raw_names = [f"c{i}" for i in range(width)]
    raw_schema = T.StructType([T.StructField(n, T.StringType()) for n in [*raw_names, _BAD]])
    raw, parsed = _read(spark, path, raw_schema, multi_line)
    _refuse_long_records(parsed, width, path)
    missing = MISSING_TOKENS if tokens is None else tokens
    text = raw.select(
        *[F.when(~F.col(f"c{i}").isin(missing), F.col(f"c{i}")).alias(name) for i, name in kept]
    )
    if schema is not None:
        return text.select(*[
            (F.col(f.name).try_cast(f.dataType) if f.name in text.columns else F.lit(None).cast(f.dataType))
            .alias(f.name) for f in schema.fields
        ])
    names = [name for _, name in kept]
    fits = text.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(names)],
        *[F.count(F.col(c).try_cast("double")).alias(f"d_{i}") for i, c in enumerate(names)],
        *[
            F.count(F.when(F.col(c).rlike(r"^\s*[+-]?\d+\s*$"), F.col(c).try_cast("long"))).alias(f"l_{i}")
            for i, c in enumerate(names)
        ],
    ).first()
    typed = []
    for i, c in enumerate(names):
        present = fits[f"n_{i}"]
        column = F.col(c)
        if present and fits[f"l_{i}"] == present:
            column = column.try_cast("long")
        elif present and fits[f"d_{i}"] == present:
            column = column.try_cast("double")
        typed.append(column.alias(c))
    return text.select(*typed)


def head_preview(df: DataFrame, row_id: str, n: int = 5) -> DataFrame:
    """The first rows in key order: a top-k, not a sort."""
    return df.orderBy(row_id).limit(n)

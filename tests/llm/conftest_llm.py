from __future__ import annotations

import pandas as pd
import pyarrow.dataset as ds
import pytest

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"

LONG = " ".join(f"word{i % 977} the of" for i in range(60_000))

# Nulls in every column, empty, blank, odd and long texts, ties, repeated rows.
ODD_ROWS = [
    (1, "The quick brown fox of the hills", "en", "src1", 32),
    (2, "the  quick\tbrown fox of the hills", "en", "src2", None),
    (3, None, "en", "src3", 0),
    (4, "", None, "src4", 0),
    (5, " \n\t ", "de", None, 4),
    (6, "The quick brown fox of the hills", "en", "src1", 32),
    (6, "The quick brown fox of the hills", "en", "src1", 32),
    (7, "Licensed under CC BY. All rights reserved, all rights reserved", "xx", "odd source", 60),
    (8, "日本 \u00a0 ünïcode ▁ \x00 \x01 é \U0001F600", "fr", "src10", 20),
    (None, "a text without an id of the kind", "es", "src5", 30),
    (9, LONG, "en", "src7", len(LONG)),
    (10, "x" * 30_000, "en", "src7", 30_000),
    (11, "general public license cc by cc by", "fr", "src8", 33),
    (12, "The quick brown fox of the hills", "fr", "src9", 32),
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["id", "row", "whole", "norm", "length", "tie", "label", "score", "print", "chunk", "slot", "learn", "spot", "bucket", "n_tokens"]


def frame(spark, rows):
    """Documents with extra columns that are named like the operators' own."""
    df = spark.createDataFrame(rows, COLUMNS)
    for i, name in enumerate(CLASHES):
        df = df.selectExpr("*", f"'{i}' as `{name}`")
    return df


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD_ROWS)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small_docs():
    return table("documents")


def table(name: str, folder: str = SMALL) -> pd.DataFrame:
    return ds.dataset(f"{folder}/{name}.parquet").to_table().to_pandas()


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)

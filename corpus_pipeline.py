"""From documents to piece ids in five stages, each written and read again by the next."""

from __future__ import annotations

import sys
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rowmend.llm import factorisation, mixing, pieces, queries, refine, simhash, tables  # noqa: E402

MIX_SHARE = 0.9
MIX_SEED = 5
# Parts of texts that a worker remembers; it also serves the other stages.
PIECE_CACHE = 120_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    machine = queries.quality_machine(spark, docs, sf_dir)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    scored = factorisation.with_score(docs.select(whole, "text", "n_chars"), machine, "score")
    return scored.filter(F.col("score") >= queries.THRESHOLD).select("whole.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return refine.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_smallest(docs, shingle=3, max_bits=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, mixing.corpus_levels(), MIX_SHARE, MIX_SEED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.round_trip(docs, public_tokenizers.path(queries.PIECE_MODEL), cache=PIECE_CACHE)
    return found.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix),
    ("sentencepiece", encode),
]

# Fitting and piece encoding are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole table; a stage's input is given back once its output is written."""
    docs, earlier = tables.documents(spark, sf_dir), []
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs, path = tables.temporary(stage(spark, docs, sf_dir), f"pipeline-{number}")
        tables.release(spark, *earlier)
        earlier = [path]
    return STAGES[-1][1](spark, docs, sf_dir)

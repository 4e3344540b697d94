from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from conftest_llm import COLUMNS, ODD_ROWS, frame

from rowmend.llm import simhash, tables

DOTTED = "a.b"


def plain_exact(rows):
    """Of rows with equal texts, the one with the smallest id; a null id comes first."""
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    return sorted((min(ids, key=lambda v: (v is not None, v or 0)) for ids in groups.values()), key=repr)


def plain_near(rows):
    """One row per group of texts linked at two bits, by comparing all pairs; rows without an id stay."""
    known = [r for r in rows if r["doc_id"] is not None]
    prints = [simhash.fingerprint(r["text"]) for r in known]
    group = list(range(len(known)))
    for i in range(len(known)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    smallest = {}
    for g, r in zip(group, known):
        smallest[g] = min(smallest.get(g, r["doc_id"]), r["doc_id"])
    return sorted([*smallest.values(), *[None for r in rows if r["doc_id"] is None]], key=repr)


@pytest.fixture(scope="module")
def odd_table(spark, tmp_path_factory):
    """The odd rows with clashing and dotted names, from files as in a pipeline run."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame(spark, ODD_ROWS).withColumn(DOTTED, corpus_pipeline.F.lit("x")).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=repr)


@pytest.mark.parametrize("written", [True, False])
def test_dedup_stages_match_brute_force(spark, odd_table, odd, written):
    docs = odd_table if written else odd
    rows = docs.collect()
    exact = corpus_pipeline.exact_dedup(spark, docs, "")
    assert exact.columns == docs.columns and ids(exact) == plain_exact(rows)
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert near.columns == docs.columns and ids(near) == plain_near(rows)


def test_rows_read_from_files_are_not_written_again(odd_table, odd):
    assert "parquet" in odd_table.inputFiles()[0]
    numbered = tables.numbered(odd_table, "test")
    assert set(numbered.inputFiles()) == set(odd_table.inputFiles())
    assert numbered.select("row").distinct().count() == odd_table.count()
    assert tables.numbered(odd, "test").select("row").distinct().count() == len(ODD_ROWS)


def test_mixing_keeps_rows_as_they_were(spark, odd_table):
    kept = corpus_pipeline.mix(spark, odd_table, "")
    assert kept.columns == odd_table.columns
    assert kept.exceptAll(odd_table).isEmpty()


def test_stages_take_empty_tables(spark, nothing):
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nothing, "").isEmpty()


def test_encoding_keeps_every_row(spark, odd_table):
    found = corpus_pipeline.encode(spark, odd_table, "").collect()
    assert len(found) == len(ODD_ROWS)
    assert sorted(COLUMNS.split()[:1]) == ["doc_id"] and {r["n_tokens"] for r in found if r["doc_id"] in (3, 4)} == {0}

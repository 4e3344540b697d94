from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest_llm import COLUMNS, ODD_ROWS, SMALL, rows_of

from rowmend.llm import lemp, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_search(docs, items, top=50):
    """Every document against every item."""
    held = [(i, Counter(words(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // max(1, total)
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(words(text)) if c[t]
            )
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


ITEMS = [
    (1, "the quick brown fox"), (2, None), (3, ""), (4, "!?! ..."), (1, "general public license cc by"),
    (None, "ALL rights reserved é 日本"), (5, "word1 word2 word3 the of"), (6, "nothing here matches zzzz"), (7, "the " * 500),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "1 as doc_id", "2 as score", "3 as bucket")


@pytest.mark.parametrize("top", [1, 3, 50])
def test_odd_rows_match_brute_force(odd, items, top):
    found = lemp.search(odd, items, top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == plain_search([r[:2] for r in ODD_ROWS], ITEMS, top)


def many_texts():
    rng = np.random.default_rng(3)
    out = []
    for i in range(900):
        size = int(rng.integers(3, 60))
        out.append((i, " ".join(f"t{int(x)}" for x in rng.zipf(1.3, size) % 400)))
    return out + [(1000 + i, "t7 t7 t9 rare copies") for i in range(300)]


def test_pruned_buckets_lose_nothing(spark, monkeypatch):
    """Thresholds from few vectors, many buckets, several blocks of items: as every document against every item."""
    monkeypatch.setattr(lemp, "SEED_ROWS", 30)
    monkeypatch.setattr(lemp, "FILE_ROWS", 50)
    monkeypatch.setattr(lemp, "BLOCK_ITEMS", 4)
    docs = many_texts()
    wanted = [(i, t) for i, t in docs[:1000:111]] + [(99, "t7 rare"), (100, "t1 t2 t3"), (101, "copies")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], COLUMNS)
    found = lemp.search(df, spark.createDataFrame(wanted, "item_id bigint, text string"), 20)
    assert rows_of(found) == plain_search(docs, wanted, 20)


def test_a_high_threshold_skips_vectors():
    """The bounds leave documents unscored: only those that can reach the threshold come out."""
    import pyarrow as pa

    weight = np.array([10, 5])
    batch = pa.record_batch(
        [pa.array([1, 2, 3]), pa.array([50.0, 5.0, 40.0]), pa.array([[0, 1], [1], [0]], pa.list_(pa.int32())),
         pa.array([[30, 40], [5], [40]], pa.list_(pa.int64()))],
        ["id", "length", "terms", "impacts"],
    )
    [out] = lemp._answers(iter([batch]), [np.array([0, 1])], weight, np.array([60]), 5, pa.int64())
    assert out.to_pylist() == [{"item": 0, "doc_id": 1, "score": 70}]


def test_ids_of_text_and_equal_scores(spark):
    docs = [("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "two"), ("d", "three four five")]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    found = lemp.search(df, spark.createDataFrame([("x", "one")], "item_id string, text string"))
    assert rows_of(found) == plain_search(docs, [("x", "one")])
    assert [r["doc_id"] for r in found.orderBy("rank").collect()] == ["a", "b", None]


def test_empty_tables(nothing, odd, items, spark):
    assert lemp.search(nothing, items).collect() == []
    none = lemp.search(odd, spark.createDataFrame([], "item_id bigint, text string"))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(lemp, "hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    terms = lemp.Terms.of(["ab", "cd", "xyz"])
    data = np.frombuffer(b"cd ab zz xyz", np.uint8)
    found = terms.find(data, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 12]))
    assert found.tolist() == [1, 0, -1, 2]


def test_query_equals_its_sql(spark):
    engine = duckdb.connect()
    for name in ("documents", "benchmark"):
        engine.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    want = engine.execute(queries.OP11_SQL).fetchall()
    found = queries.op11_lemp(spark, SMALL)
    assert rows_of(found) == sorted(want, key=repr)
    per_item = defaultdict(list)
    for r in found.collect():
        per_item[r["item_id"]].append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per_item.values())

from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb
import pytest
from conftest_llm import ODD_ROWS, SMALL, table
from pyspark.sql import functions as F

from rowmend.llm import mixing, queries


def plain_fill(total, children):
    """Water filling by hand: children that are full leave, the others share again."""
    given, open_ = {}, {k: (c, w) for k, (c, w) in children.items() if w > 0}
    while open_:
        weight = sum(w for _, w in open_.values())
        full = {k: c for k, (c, w) in open_.items() if c <= total * w / weight}
        if not full:
            return given | {k: total * w / weight for k, (_, w) in open_.items()}
        for k, c in full.items():
            given[k] = c
            total -= c
            del open_[k]
        total = max(total, 0.0)
    return given


def weight(path):
    if len(path) == 1:
        return mixing.DOMAIN_WEIGHTS.get(path[0], 1)
    return mixing.LANG_WEIGHTS.get(path[1], 1) if len(path) == 2 else 1


def plain_mixture(rows, share, epochs, seed):
    """``rows``: (id, domain, lang, source, n). Copies per row."""
    tokens = defaultdict(int)
    for _, *path, n in rows:
        tokens[tuple(path)] += n
    budgets = {(): float(int(sum(tokens.values()) * share))}
    for depth in (1, 2, 3):
        caps = defaultdict(float)
        for path, n in tokens.items():
            caps[path[:depth]] += n * epochs
        new = {}
        for parent, total in budgets.items():
            new |= plain_fill(total, {p: (c, weight(p)) for p, c in caps.items() if p[:-1] == parent})
        budgets = new
    out = []
    for i, *path, n in rows:
        path = tuple(path)
        whole = int(budgets[path] // tokens[path]) if tokens[path] else 0
        left = budgets[path] - whole * tokens[path]
        spot = lambda j: hashlib.md5(f"{seed}-{whole}-{'none' if j is None else j}".encode()).hexdigest()
        before = sum(m for j, *p, m in rows if tuple(p) == path and spot(j) < spot(i))
        out.append((i, n, whole + (before < left and n > 0)))
    return sorted(out, key=repr)


def words_of(text):
    return len((text or "").encode().split())


def path_of(lang, source):
    digits = (source or "")[len((source or "").rstrip("0123456789")) :]
    return (f"d{int(digits) % 3}" if digits else "none", lang or "none", source or "none")


@pytest.mark.parametrize("share, epochs", [(0.6, 3), (0.9, 1), (5.0, 2), (0.0, 1)])
def test_mixture_matches_brute_force(spark, odd, small_docs, monkeypatch, share, epochs):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    given = [(odd, [(r[0], *path_of(r[2], r[3]), words_of(r[1])) for r in ODD_ROWS])]
    if share == 0.6:
        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
        given.append((docs, [(d.doc_id, *path_of(d.lang, d.source), words_of(d.text)) for d in small_docs.itertuples()]))
    for docs, rows in given:
        found = mixing.mixture(docs, mixing.corpus_levels(), share, epochs, seed=4)
        got = sorted(((r["id"], r["n_tokens"], r["copies"]) for r in found.collect()), key=repr)
        assert got == plain_mixture(rows, share, epochs, 4)


def test_sql_twin(spark):
    duck = duckdb.connect()
    duck.register("documents", table("documents"))
    want = sorted(duck.sql(queries.OP5_SQL).fetchall())
    found = queries.op5_mixture(spark, SMALL)
    assert found.columns == [c[0] for c in duck.sql(queries.OP5_SQL).description]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_take_keeps_columns(odd, nothing):
    left = mixing.take(odd, mixing.corpus_levels(), 0.5, seed=4)
    assert left.columns == odd.columns
    assert 0 < left.count() < odd.count()
    assert mixing.take(nothing, mixing.corpus_levels(), 0.5).count() == 0


def test_zero_weight_gets_nothing(spark, odd):
    levels = [mixing.Level("lang", F.col("lang"), F.when(F.col("lang") == "en", 1).otherwise(0))]
    found = mixing.mixture(odd, levels, 0.1, 1)
    assert {r["lang"] for r in found.filter("copies > 0").collect()} == {"en"}

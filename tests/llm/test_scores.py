from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import MIDDLE, ODD_ROWS, SMALL, table
from pyspark.sql import functions as F

from rowmend.llm import factorisation, katz, queries

END = object()


def plain_tokens(text):
    return [*(text or "").encode().lower().split(), END]


def plain_katz(rows, learn):
    """Per row: held out, tokens, known, N, base, score. Also every context's shares."""
    train = [plain_tokens(t) for (_, t), use in zip(rows, learn) if use]
    words = Counter(w for tokens in train for w in tokens)
    total, different = sum(words.values()), len(words)
    pairs = Counter((a, b) for tokens in train for a, b in zip([END, *tokens], tokens))
    numbers = lambda counts: [sum(c == r for c in counts.values()) for r in range(1, katz.LARGEST + 2)]
    model = katz.WordModel.of(total, different, numbers(words))
    keep = katz.Discounts.of(numbers(pairs)).factor
    one = cache(lambda w: float(model.p(np.array([words[w]]))[0]))
    after = defaultdict(dict)
    for (a, b), c in pairs.items():
        after[a][b] = c

    @cache
    def plan(context):
        seen = after.get(context)
        if not seen:
            return None
        size = sum(seen.values())
        kept = {w: c * keep[min(c, katz.LARGEST + 1)] / size for w, c in seen.items()}
        left = 1 - sum(kept.values())
        if left < 1e-12:
            kept, left = {w: v * size / (size + 1) for w, v in kept.items()}, 1 / (size + 1)
        return kept, left / max(1 - sum(map(one, seen)), model.unknown)

    def share(context, word):
        if not (found := plan(context)):
            return one(word)
        return found[0][word] if word in found[0] else found[1] * one(word)

    out = []
    for (_, text), use in zip(rows, learn):
        tokens = plain_tokens(text)
        base = sum(math.log10((words[w] + 1) / (total + different + 1)) for w in tokens)
        score = sum(math.log10(share(a, b)) for a, b in zip([END, *tokens], tokens))
        out.append((not use, len(tokens), sum(words[w] > 0 for w in tokens), total, base, score))
    sums = {a: sum(share(a, w) for w in words) + share(a, b"never seen") for a in list(after)[:60]}
    return out, sums


def close(found, want):
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("chunk", [2_000, 1 << 20])
def test_katz_matches_brute_force(spark, small_docs, monkeypatch, chunk):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", chunk)
    docs = small_docs.sort_values("doc_id")
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    want, sums = plain_katz(rows, [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows])
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    found = queries.op1_katz(spark, SMALL).orderBy("doc_id").drop("doc_id").collect()
    close([tuple(r) for r in found], want)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_katz_on_odd_rows(spark, odd, nothing):
    rows = [r[:2] for r in ODD_ROWS]
    want, _ = plain_katz(rows, [i not in (1, 9, None) for i, _ in rows])
    found = katz.score_texts(odd, ~F.col("doc_id").isin(1, 9)).drop("id").collect()
    close(sorted((tuple(r) for r in found), key=repr), sorted(want, key=repr))
    assert katz.score_texts(nothing, F.lit(True)).count() == 0
    untrained = katz.score_texts(odd, F.lit(False)).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["train_tokens"] == 0 for r in untrained)


def test_discounts_of_thin_tables():
    for numbers in ([0] * 6, [3, 0, 0, 0, 0, 0], [5, 9, 1, 1, 1, 1], [100, 40, 22, 13, 9, 6]):
        factor = katz.Discounts.of(numbers).factor
        assert ((factor[1:-1] > 0) & (factor[1:-1] < 1)).all()


def test_pairwise_terms_equal_the_double_sum():
    texts = pa.array(["a b c a", "one two", "", None])
    machine = factorisation.fit(*factorisation.features(texts), np.array([1.0, 0.0, 1.0, 0.0]))
    n, owner, column, value = design = machine.design(*factorisation.features(texts))
    margins, _ = machine.margins(*design)
    for i in range(n):
        at = np.flatnonzero(owner == i)
        slow = machine.bias + (machine.linear[column[at]] * value[at]).sum()
        for x in range(len(at)):
            for y in range(x):
                slow += machine.factors[column[at[x]]] @ machine.factors[column[at[y]]] * value[at[x]] * value[at[y]]
        assert margins[i] == pytest.approx(slow)


def test_quality_on_held_out_rows(spark):
    found = queries.op2_factorisation(spark, MIDDLE).toPandas()
    docs, labels = table("documents", MIDDLE), table("labels", MIDDLE)
    assert sorted(found.doc_id) == sorted(docs.doc_id) and found.score.between(0, 1).all()
    held = found[found.held_out].merge(labels, on="doc_id")
    assert len(held) > 50
    assert (held.predicted == held.quality).mean() > 0.9


def test_quality_of_odd_rows_and_missing_labels(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (7, 0), (9, 1), (None, 1), (10, None), (11, 0)], "doc_id bigint, quality int")
    for given in (labels, labels.filter("quality = 1"), labels.limit(0)):
        machine = factorisation.fit_quality(odd, given, F.lit(True))
        scores = [r[0] for r in factorisation.with_score(odd, machine, "found").select("found").collect()]
        assert len(scores) == len(ODD_ROWS) and all(0 <= s <= 1 for s in scores)
    assert factorisation.with_score(nothing, machine, "found").count() == 0

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import xxhash
from conftest_llm import ODD_ROWS, SMALL, frame, rows_of
from pyspark.sql import functions as F

from rowmend.llm import queries, refine, simhash
from rowmend.llm.components import components


def plain_groups(rows):
    """Brute force: one (id, keep_id, size, hash) per row, kept rows counted apart."""
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    first = {t: min(ids, key=lambda v: (v is not None, v or 0)) for t, ids in groups.items()}
    return sorted(
        ((i, first[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm)), key=repr
    )


def test_exact_groups_match_brute_force(odd):
    found = refine.exact_groups(odd, all_hashes=True)
    assert rows_of(found.select("id", "keep_id", "group_size", "text_hash")) == plain_groups([r[:2] for r in ODD_ROWS])
    kept = found.filter("kept").collect()
    assert len(kept) == len({re.sub(r"\s+", " ", r[1] or "") for r in ODD_ROWS})
    assert all(r["id"] == r["keep_id"] for r in kept)


def test_exact_query_on_the_given_table(spark, small_docs):
    found = queries.op3_refinement(spark, SMALL)
    want = plain_groups(list(zip(small_docs.doc_id.tolist(), small_docs.text.tolist())))
    assert rows_of(found.select("doc_id", "keep_id", "group_size", "text_sha256")) == want


def test_survivors_only_hash(odd):
    some = refine.exact_groups(odd)
    assert some.filter("text_hash is null and group_size > 1").count() == 0
    assert some.filter("text_hash is null").count() > 0


def test_drop_copies_keeps_columns_and_one_row(odd, nothing):
    left = refine.drop_copies(odd)
    assert left.columns == odd.columns
    assert left.count() == len({re.sub(r"\s+", " ", r[1] or "") for r in ODD_ROWS})
    assert refine.drop_copies(nothing).count() == 0
    assert refine.exact_groups(nothing).count() == 0


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hashed = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(prints, bits=2):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def check_groups(found, rows):
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints)
    first = defaultdict(list)
    for (i, _), r in zip(rows, roots):
        first[r] += [i] if i is not None else []
    want = sorted(((i, f"{p:016x}", min(first[r], default=None)) for (i, _), p, r in zip(rows, prints, roots)), key=repr)
    assert rows_of(found) == want


def test_simhash_matches_brute_force(spark, odd, small_docs):
    found = simhash.near_groups(odd).select("id", simhash.as_hex("print"), "component_id")
    check_groups(found, [r[:2] for r in ODD_ROWS])
    check_groups(queries.op8_simhash(spark, SMALL), list(zip(small_docs.doc_id.tolist(), small_docs.text.tolist())))


def linked(spark, prints, bits):
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = components(simhash.links(spark.createDataFrame([(p,) for p in signed], "print bigint"), bits))
    label = {r["node"]: r["label"] for r in found.collect()}
    return [label.get(p, p) for p in signed]


def test_crowded_lists_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 160:
        near = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 3)):
            near ^= 1 << rng.randrange(64)
        prints.add(near)
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(40)})
    for bits, limit in ((1, 0), (2, 0), (2, 3)):
        want = plain_components(prints, bits)
        monkeypatch.setattr(simhash, "LIST_LIMIT", limit)
        got = linked(spark, prints, bits)
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 500)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    label = {r["node"]: r["label"] for r in found.collect()}
    assert {label[i] for i in range(41)} == {0}
    assert {label[i] for i in range(100, 160)} == {100}
    assert 500 not in label
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keep_smallest(odd, nothing, spark):
    left = simhash.keep_smallest(odd)
    assert left.columns == odd.columns
    rows = [r[:2] for r in ODD_ROWS if r[0] is not None]
    assert left.filter(F.col("doc_id").isNotNull()).count() == len(set(plain_components([plain_print(t) for _, t in rows])))
    assert left.filter("doc_id is null").count() == 1
    assert simhash.keep_smallest(nothing).count() == 0
    assert simhash.near_groups(nothing).count() == 0
    assert simhash.near_groups(frame(spark, [(None, "a", None, None, None)])).collect()[0]["component_id"] is None

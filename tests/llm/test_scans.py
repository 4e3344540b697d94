from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD_ROWS, SMALL, frame, rows_of, table

from pyspark.sql import functions as F

from rowmend.llm import licences, queries, spotsigs, tables, urlrules

URLS = [
    "http://net/", "http://a.net", "https://EXAMPLE.net/en/x?y=/de/", "http://b.example.net/en/", "http://example.net/en",
    "http://myexample.net/en/", "http://x.example.com/de/1#a", "http://example.com/en/", "http://org/fr/", "http://a.org/fr/?q",
    "http://a.org/de/", "no scheme", "", None, "http://", "http:///path", "ftp://h.net#frag/x", "http://net:80/", "http://.net/",
    "a://b.net/://c", "http://a\x00.net/", "http://net\x01/", "http://netx/", "http://xn.net./", "http://a.net/en/\n/x",
]


def plain_judge(url, rules, default="allow"):
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None, default
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


@pytest.mark.parametrize("ranges", [1, 7])
def test_rules_match_brute_force(spark, ranges):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[0])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 as key", "2 as host", "3 as range")
    more = [*queries.RULES, ("example.net", "/en/", "block"), ("b.example.net", "/", "allow"), ("", "/", "block")]
    for rules in (queries.RULES, more, []):
        given = spark.createDataFrame(rules, "host string, path string, verdict string")
        found = urlrules.judge(pages, given, partitions=ranges)
        assert rows_of(found) == sorted(((i, *plain_judge(u, rules)) for i, u in rows), key=repr)
    assert urlrules.judge(pages.limit(0), given).count() == 0


def test_rules_query_and_sql(spark):
    found = queries.op7_url_rules(spark, SMALL)
    want = [(p.page_id, *plain_judge(p.url, queries.RULES)) for p in table("pages").itertuples()]
    assert rows_of(found) == sorted(want, key=repr)
    duck = duckdb.connect()
    duck.register("pages", table("pages"))
    assert sorted(duck.sql(queries.OP7_SQL).fetchall(), key=repr) == sorted(want, key=repr)


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [
        (i, label) for phrase, label in licences.PHRASES.items()
        for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def check_base(found, rows, id_col):
    columns = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert rows_of(found.select(*columns)) == sorted(((i, *plain_base(t)) for i, t in rows), key=repr)
    for r in found.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_base_phrases(spark, odd, nothing, small_docs):
    check_base(licences.scan(odd), [r[:2] for r in ODD_ROWS], "id")
    assert licences.scan(nothing).count() == 0
    rows = list(zip(small_docs.doc_id.tolist(), small_docs.text.tolist()))
    check_base(queries.op9_licences(spark, SMALL), rows, "doc_id")


def test_templates_with_edits(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    mit = licences.TEMPLATES[3][1].split()
    dropped = " ".join(mit[:7] + mit[8:])
    added = " ".join(mit[:9] + ["indeed"] + mit[9:])
    texts = {
        1: f"{filler} {dropped} {filler}", 2: f"{added}", 3: f"{filler} {' '.join(mit[:6])} {filler}",
        4: "Released under the MIT License.", 5: "This work is licensed under the GNU General Public License, version 3.",
        6: filler, 7: f"{dropped} {filler} {' '.join(mit)}", 8: " ".join(reversed(mit)),
    }
    found = {r["id"]: r for r in licences.scan(frame(spark, [(i, t, None, None, None) for i, t in texts.items()])).collect()}
    assert {i for i, r in found.items() if "mit" in r["labels"].split(",")} == {1, 2, 4, 7}
    assert found[5]["labels"] == "gpl,gpl-3.0" and found[5]["score"] == 1
    assert found[6]["labels"] == "" and found[6]["score"] == 0
    assert found[7]["score"] == 1


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at, way = rng.randrange(len(out)), rng.choice("xia")
        if way != "a" and len(out) > 1:
            del out[at]
        if way != "x":
            out.insert(at, rng.choice(["quite", "the", "other", "license"]))
    return out


def most_alike(words, wanted):
    """The best agreement over all spans, by a table of common subsequences."""
    best = 0.0
    for a in range(len(words)):
        row = [0] * (len(wanted) + 1)
        for b in range(a, min(len(words), a + 2 * len(wanted))):
            new = [0]
            for j, w in enumerate(wanted):
                new.append(row[j] + 1 if w == words[b] else max(new[j], row[j + 1]))
            row = new
            best = max(best, 2 * row[-1] / (b - a + 1 + len(wanted)))
    return best


def test_every_like_span_is_found(spark):
    filler = [f"w{i}" for i in range(40)]
    mit, bsd = (licences.words_of(licences.TEMPLATES[n][1]) for n in (3, 8))
    spread = [("other" if i in (4, 8, 12, 16) else w) for i, w in enumerate(mit)]
    split = lambda n: bsd[:9] + [f"x{i}" for i in range(n)] + bsd[9:]
    short = [["released", "under", "mit", "license"], "released beneath the mit license".split()]
    wanted = {0: ("mit", short[0], 8 / 9), 1: ("mit", short[1], 0.8), 2: ("mit", spread, 0.8)}
    for n in range(1, len(bsd) // 2 + 1):
        wanted[2 + n] = ("bsd", split(n), 2 * len(bsd) / (2 * len(bsd) + n))
    rows = [(i, " ".join(filler + words + filler), None, None, None) for i, (_, words, _) in wanted.items()]
    rows += [(-1, " ".join(split(len(bsd) // 2 + 1)), None, None, None)]
    found = {r["id"]: (r["labels"], r["score"]) for r in licences.scan(frame(spark, rows)).collect()}
    assert found.pop(-1) == ("", 0)
    assert found == {i: (label, pytest.approx(score)) for i, (label, _, score) in wanted.items()}


def test_spans_against_all_spans(spark):
    rng = random.Random(4)
    listed = [licences.words_of(text) for _, text in licences.TEMPLATES]
    texts = [["under", "the"] * 3 + edited(rng, rng.choice(listed), rng.randint(0, 8)) + ["the", "x"] + rng.choice(listed)[:3]
             for _ in range(250)]
    texts += [[], ["license"]]
    found = licences.scan(frame(spark, [(i, " ".join(t), None, None, None) for i, t in enumerate(texts)])).collect()
    for r in found:
        alike = [(label, most_alike(texts[r["id"]], w)) for (label, _), w in zip(licences.TEMPLATES, listed)]
        alike = [(label, ratio) for label, ratio in alike if ratio >= licences.LEAST_LIKENESS]
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == base | {label for label, _ in alike}
        assert r["score"] == (1 if base else max([ratio for _, ratio in alike], default=0))
    assert len({r["score"] for r in found}) > 5


def test_templates_of_any_length(spark):
    assert [licences.sought("x", " ".join("abcdefgh"[:n])).k for n in (1, 2, 3, 4, 5)] == [1, 1, 1, 2, 2]
    docs = frame(spark, [(1, "one Alpha two", None, None, None), (2, "beta gamma", None, None, None), (3, "gamma", None, None, None)])
    found = {r["id"]: r["labels"] for r in licences.scan(docs, [("a", "alpha"), ("b", "beta, gamma")]).collect()}
    assert found == {1: "a", 2: "b", 3: ""}
    with pytest.raises(ValueError):
        licences.sought("none", " . ")


def plain_edits(rows):
    """(id, chars, sha of edited text, edited text, next text) in descending order of id."""
    out = []
    for at, (i, text) in enumerate(rows):
        own, other = text or "", rows[(at + 1) % len(rows)][1] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + other[:cut]
        sets = spotsigs.signature_sets(pa.array([own, edited, other]))
        jaccard = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        out.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.fingerprint_of(sets[0]),
                    spotsigs.fingerprint_of(sets[1]), jaccard(sets[0], sets[1]), jaccard(sets[0], sets[2])))
    return sorted(out, key=repr)


def test_edited_texts(spark, odd, nothing, small_docs):
    columns = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = sorted(zip(small_docs.doc_id.tolist(), small_docs.text.tolist()), reverse=True)
    assert rows_of(queries.op10_spotsigs(spark, SMALL).select("doc_id", *columns)) == plain_edits(rows)
    rows = sorted([r[:2] for r in ODD_ROWS], key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    assert rows_of(spotsigs.edited_likeness(odd).select("id", *columns)) == plain_edits(rows)
    assert spotsigs.edited_likeness(nothing).count() == 0
    one = spotsigs.edited_likeness(frame(spark, [(4, "abc def", None, None, None)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_signatures_follow_anchors():
    a, b, c = spotsigs.signature_sets(pa.array(["The big house of old stone", "the BIG, house! of (old) stone", "big house"]))
    assert a.tolist() == b.tolist() and len(a) == 2 and len(c) == 1
    assert spotsigs.likeness(a, b) == 1 and spotsigs.likeness(a, c) == 0
    big = np.arange(100, dtype=np.uint64)
    assert spotsigs.likeness(big, big[:50]) == 0.5 and spotsigs.likeness(big, big[:50], 0.8) == 0


def test_near_pairs(spark, small_docs):
    texts = small_docs.text.fillna("").tolist()[:60]
    texts += [t + " the very last words" for t in texts[:20]]
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    pairs, members = spotsigs.near_pairs(docs, 0.8)
    sets = {spotsigs.fingerprint_of(s): s for s in spotsigs.signature_sets(pa.array(texts))}
    names = sorted(sets)
    want = {(x, y) for i, x in enumerate(names) for y in names[i + 1 :] if spotsigs.likeness(sets[x], sets[y], 0.8)}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want
    assert members.count() == len(texts)


def test_lists_of_grams_may_be_cut_anywhere(spark, monkeypatch):
    text = " ".join(["some words"] * 9 + [licences.TEMPLATES[3][1]] + ["others"] * 5 + [licences.TEMPLATES[8][1]])
    docs = frame(spark, [(1, text, None, None, None), (1, text, None, None, None), (2, "none here", None, None, None)])
    whole = sorted(tuple(r) for r in licences.scan(docs).collect())
    monkeypatch.setattr(licences, "LIST_GRAMS", 4)
    monkeypatch.setattr(licences, "BROADCAST_GRAMS", 0)
    assert sorted(tuple(r) for r in licences.scan(docs).collect()) == whole
    assert [r[6] for r in whole] == ["bsd,mit", "bsd,mit", ""]


def test_votes_are_joined_and_counted_by_spark(spark):
    rows = tables.numbered(frame(spark, [(1, "a b c d", None, None, None)]), "rows").select("row", F.lit("a b c d").alias("text"))
    plan = licences.candidate_spans(rows, [licences.sought("x", "a b c d")])
    spans = plan.collect()
    assert len(spans) == 1 and [s["template"] for s in spans[0]["spans"]] == [0]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in text and "diagonal" in text and "Aggregate" in text


def test_samples_are_bounded_over_all_tasks(spark):
    rows = spark.range(0, 50_000, 1, 64).withColumn("h", F.xxhash64("id"))
    assert abs(rows.filter(tables.hash_below("h", 2_000, 50_000)).count() - 2_000) < 250
    assert rows.filter(tables.hash_below(F.col("h"), 50_000, 50_000)).count() == 50_000


def test_cuts_follow_the_rows_of_an_id():
    assert spotsigs._cuts({}, 4) == []
    assert spotsigs._cuts({i: 1 for i in range(100)}, 4) == [25, 50, 75]
    assert spotsigs._cuts({1: 1, 2: 97, 3: 1, 4: 1}, 4) == [2]

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import ODD_ROWS, SMALL, rows_of
from tokenizers import Tokenizer

from rowmend.llm import align, queries

BYTE, PIECE, RANKS = (public_tokenizers.path(n) for n in (queries.BYTE_MODEL, queries.PIECE_MODEL, queries.BYTE_RANKS))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def byte_text(name):
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return bytes(table[c] for c in name)


def piece_bytes(name):
    if len(name) == 6 and name.startswith("<0x"):
        return bytes([int(name[3:5], 16)])
    return name.replace("▁", " ").encode()


def plain_groups(text, libraries):
    """Groups ``([a ids], [b ids])`` by walking both token lists at once."""
    a_lib, b_lib = libraries
    if not text:
        return []
    ids_a, ids_b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    bytes_a = {i: byte_text(a_lib.id_to_token(i)) for i in set(ids_a)}
    bytes_b = {i: piece_bytes(b_lib.id_to_piece(i)) for i in set(ids_b)}
    a, b = [(i, bytes_a[i]) for i in ids_a], [(i, bytes_b[i]) for i in ids_b]
    want = (" " + text).encode()
    if b"".join(x[1] for x in a) != want or b"".join(x[1] for x in b) != want:
        return []
    ends_b, at = set(), 0
    for _, raw in b:
        at += len(raw)
        ends_b.add(at)
    groups, own, at, j, done = [], [], 0, 0, 0
    for i, raw in a:
        own.append(i)
        at += len(raw)
        if at in ends_b:
            other = []
            while done < at:
                other.append(b[j][0])
                done += len(b[j][1])
                j += 1
            groups.append((own, other))
            own = []
    return groups


def plain_alignment(rows, libraries):
    groups = [plain_groups(t, libraries) for _, t in rows]
    held = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    often = Counter(p for c in held for p in c)
    best = defaultdict(int)
    for (x, _), n in often.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), g, c in zip(rows, groups, held):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
            sum(n for p, n in c.items() if often[p] == best[p[0]]), sum(n * often[p] for p, n in c.items()),
            hashlib.sha256(line.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=repr)


def test_odd_rows_match_a_walk(odd, libraries):
    found = align.alignment(odd, BYTE, PIECE, RANKS)
    assert rows_of(found) == plain_alignment([r[:2] for r in ODD_ROWS], libraries)


SPECIAL = [
    (1, "<|endoftext|> <s> </s> <unk> <0x41>"), (2, "a▁b literal mark"), (3, "  leading and  double  spaces "), (4, "\ttab\r\nline\n\n"),
    (5, "日本語テキスト 한국어 😀😀 Ǆ ﬁ ́combining"), (6, "\x00\x01\x7f"), (7, "x" * 3000), (8, "1234567890" * 20), (9, "ééééé ñ ß İ ı"),
    (10, " "), (11, "don't we'll I'M"), (12, "  　 spaces"), (13, None), (14, ""),
]


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_special_texts(spark, libraries, ranks):
    df = spark.createDataFrame(SPECIAL, "doc_id bigint, text string")
    assert rows_of(align.alignment(df, BYTE, PIECE, ranks)) == plain_alignment(SPECIAL, libraries)


def test_query_on_the_given_table(spark, libraries, small_docs, monkeypatch):
    monkeypatch.setattr(align, "SLICE_BYTES", 50_000)
    monkeypatch.setattr(align, "CHUNK_BYTES", 120_000)
    rows = list(zip(small_docs.doc_id.tolist(), small_docs.text.tolist()))
    assert rows_of(queries.op13_alignment(spark, SMALL)) == plain_alignment(rows, libraries)


def test_pair_table_counts_documents(spark, libraries):
    texts = [(1, "one two one"), (2, "one two"), (3, "three")]
    found = align.pair_table(spark.createDataFrame(texts, "doc_id bigint, text string"), BYTE, PIECE)
    often = Counter(p for _, t in texts for p in {(x, y) for a, b in plain_groups(t, libraries) for x in a for y in b})
    assert {(r["a"], r["b"]): r["often"] for r in found.collect()} == dict(often)


def test_empty_table_and_ids_of_text(nothing, spark, libraries):
    assert align.alignment(nothing, BYTE, PIECE).collect() == []
    rows = [("a", "some words"), (None, "some words"), ("a", "some words"), ("b", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert rows_of(align.alignment(df, BYTE, PIECE)) == plain_alignment(rows, libraries)
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert rows_of(align.alignment(blank, BYTE, PIECE)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_the_shared_ends(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 8)
    a, b, first, last, base = [], [], [], [], 0
    for size in sizes:
        total = int(size) * 5
        first.append(len(a))
        a += [base + x for x in sorted({*rng.integers(1, total + 1, size).tolist(), total})]
        b += [base + x for x in sorted({*rng.integers(1, total + 1, size).tolist(), total})]
        last.append(len(a))
        base += total
    cuts = align.shared_cuts(np.array(a), np.array(b), np.array(first), np.array(last) - 1)
    assert cuts.tolist() == [i for i, end in enumerate(a) if end in set(b) and i + 1 not in last]


def test_groups_beyond_the_limit_are_counted_the_same(monkeypatch):
    spelling = align.Spelling.of([b"a", b"bb", b"ccc", b"d"])
    a = [np.array([1, 1, 1, 0]), np.array([0, 0])]
    b = [np.array([0, 2, 2]), np.array([1])]
    groups = align.grouped(a, b, spelling, spelling)

    def counted():
        out = Counter()
        for keys, times in align.links(groups):
            out.update(dict(zip(keys.tolist(), times.tolist())))
        return out

    want = counted()
    assert sum(want.values()) == int((groups.a_sizes * groups.b_sizes).sum())
    monkeypatch.setattr(align, "MOST_LINKS", 2)
    assert counted() == want

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import ODD_ROWS, SMALL, rows_of
from tokenizers import Tokenizer

from rowmend import storage
from rowmend.llm import blobs, grammar, pieces, queries

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_agenda_equals_the_library(library):
    rng = random.Random(1)
    texts = ["", " ", "▁", "a▁b", "\0a", "  a", "<s>", "</s>x", "<0x41>", "日本 龘龘 \U0001F600", "x" * 5000, " " * 50 + "a" + " " * 33]
    texts += ["".join(rng.choice("ab  ▁é龘\n\t\0.<>s1😀́") for _ in range(rng.randint(0, 90))) for _ in range(500)]
    own = pieces.codec(PIECES)
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)


def test_in_step_and_heap_agree():
    own = pieces.codec(PIECES)
    words = ["▁" + w for w in "international keittzuheit the öchung 日本 a".split()] * 3
    assert own.agendas(words) == [own.agenda(w) for w in words]


def test_bytes_that_are_no_text(library):
    ids = [library.piece_to_id("<0xE3>"), library.piece_to_id("<0x41>"), 300]
    assert "�" in pieces.codec(PIECES).decode(ids)


def plain_pieces(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_round_trip(spark, odd, nothing, small_docs, library):
    assert rows_of(pieces.round_trip(odd, PIECES)) == plain_pieces(library, [r[:2] for r in ODD_ROWS])
    assert pieces.round_trip(nothing, PIECES).count() == 0
    rows = list(zip(small_docs.doc_id.tolist(), small_docs.text.tolist()))
    assert rows_of(queries.op4_pieces(spark, SMALL)) == plain_pieces(library, rows)


def test_encoded_and_decoded_tables(odd, library):
    coded = pieces.encoded(odd, PIECES)
    assert {tuple(r["ids"]) for r in coded.collect()} == {tuple(library.encode(r[1] or "")) for r in ODD_ROWS}
    texts = {r["text"] for r in pieces.decoded(coded, PIECES).collect()}
    assert texts == {library.decode(library.encode(r[1] or "")) for r in ODD_ROWS}


def test_blobs_return_what_went_in():
    arrays = [np.array([], np.int64), np.array([0]), np.arange(1000), np.array([2**64 - 1, 0], np.uint64)]
    for a, b in zip(arrays, blobs.unpacked_all(blobs.packed_all(*arrays))):
        assert a.astype(np.uint64).tolist() == b.tolist()


def test_grammar_is_exact_and_opens_ranges():
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 90, rng.integers(2, 9)) for _ in range(60)]
    for ids in (np.concatenate([words[i] for i in rng.integers(0, 60, 4000)]), np.zeros(5000, np.int64),
                np.arange(300), np.array([7]), np.empty(0, np.int64)):
        found = grammar.compress(ids)
        assert grammar.expand(found["sequence"], found["left"], found["right"], found["first"]).tolist() == ids.tolist()
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert grammar.read_range(found, a, b).tolist() == ids[a:b].tolist()
        for rule, size in enumerate(found["lengths"].tolist()):
            assert len(grammar.expand(np.array([found["first"] + rule]), found["left"], found["right"], found["first"])) == size
    assert len(grammar.compress(np.zeros(5000, np.int64))["sequence"]) < 200


def test_rounds_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 30_000, 3000)
    copies = np.concatenate([np.append(passage, 40_000 + i) for i in range(40)])
    twice = np.concatenate([rng.integers(0, 30_000, 500), passage, rng.integers(0, 30_000, 500), passage])
    for ids, most in ((copies, 100), (twice, 1200), (np.tile(np.arange(20_000), 3), 10), (np.zeros(100_000, np.int64), 40)):
        found = grammar.compress(ids)
        assert grammar.expand(found["sequence"], found["left"], found["right"], found["first"]).tolist() == ids.tolist()
        pairs = list(zip(found["sequence"].tolist(), found["sequence"].tolist()[1:]))
        assert len(set(pairs)) == len(pairs) and len(found["sequence"]) <= most
        assert grammar.read_range(found, 1234, 2345).tolist() == ids[1234:2345].tolist()


def plain_files(rows):
    tokenizer, start, out = Tokenizer.from_file(WORDS), 0, []
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_word_encoder_equals_the_library(monkeypatch):
    """Marks, digits, case, special tokens and characters that normalise, also in a slice of an array."""
    tokenizer = Tokenizer.from_file(WORDS)
    odd = [
        "", None, " ", "a., b. c, d.. e.,f 1.5. 0. x0. A.B. \u00f1. a.\x0bb,\n", "0 00 a0 'll0 it's0x it's. I'LL,",
        "<|endoftext|> a<|startoftext|>b <|endoftext|>.", "e\u0301 \u0301x <\u0338 ,\u0338 \u2260 \u212a \u0130I\u0131\u03a3\u03a3",
        "12:30 x\u3000y S.\u2003T. \u200d\u0345 \u06630\u0663", "word " * 3000,
    ]
    whole = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for t in odd]
    end = np.array([1], "<u4").tobytes()
    own = grammar.WordEncoder(WORDS)
    assert own.mark is not None and own.lowers and own.apart and own.plain is not None
    assert own.encode(odd, end) == whole
    assert own.encode(pa.array(["QUITE LONG", *odd]).slice(1), end) == whole
    for most in (0, 5, 12, 1000):
        monkeypatch.setattr(grammar, "CACHE", most)
        for _ in range(2):
            assert [own.encode([t], end)[0] for t in odd] == whole
            assert own.encode(odd, end) == whole
    own = grammar.WordEncoder(WORDS)
    own.mark = None
    assert own.encode(odd, end) == whole
    assert own.encode([], end) == []
    assert grammar.WordEncoder(WORDS, split=False).encode(odd, end) == whole


def test_case_is_dropped_last():
    """Special tokens in other spellings, and capitals that compose in lower case only."""
    tokenizer = Tokenizer.from_file(WORDS)
    odd = [
        "<|ENDOFTEXT|>", "a<|EndOfText|>b.", "<|endoftext|> <|STARTOFTEXT|>0 <|endofTEXT|>, <|endoftext|>X X<|endoftext|>",
        "<| <|END OF|> <|ENDOF", "H\u0331awwa", "J\u030c T\u0308 W\u030a Y\u030a h\u0331 j\u030c", "NA\u0308IVE \u00c4. \u0130X \u1e9e \u2126 \u212b",
        "PLAIN Plain plain PLAIN, plain.", *(f"{c}{chr(m)}x" for c in "ABCHIJKSTWYZ" for m in range(0x300, 0x345)),
    ]
    whole = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    own = grammar.WordEncoder(WORDS)
    assert own.lowers and own.plain is not None
    assert own.encode(odd) == whole
    assert own.encode(odd[::-1]) == whole[::-1]
    assert [own.encode([t])[0] for t in odd] == whole


def test_pairs_that_share_a_slot(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 40, 20_000)
    wide = grammar.compress(ids)
    monkeypatch.setattr(grammar, "SLOT_BITS", 3)
    narrow = grammar.compress(ids)
    assert all(np.array_equal(wide[part], narrow[part]) for part in wide)


def test_token_files(spark, small_docs, monkeypatch):
    monkeypatch.setattr(grammar, "BLOCK_IDS", 5000)
    rows = sorted(zip(small_docs.doc_id.tolist(), small_docs.text.tolist()))
    assert sorted(tuple(r) for r in queries.op6_grammar(spark, SMALL).collect()) == plain_files(rows)


def test_token_files_of_odd_rows(spark, odd, nothing):
    path = storage.fresh_path(spark, "odd-files")
    grammar.write_grammars(odd, path, WORDS)
    found = [tuple(r) for r in grammar.read_documents(spark.read.parquet(path)).orderBy("start").collect()]
    rows = sorted([r[:2] for r in ODD_ROWS], key=lambda r: (r[0] is not None, r[0] or 0))
    assert found == plain_files(rows)
    path = storage.fresh_path(spark, "no-files")
    grammar.write_grammars(nothing, path, WORDS)
    assert grammar.read_documents(spark.read.parquet(path)).count() == 0

"""Encoding and decoding with merge-type piece vocabularies.

A text is split before every run of the space mark: no piece of the vocabulary has the
mark after another character, so no merge crosses such a place and the pieces between
two of them do not depend on the rest. Vocabularies without that property are encoded
as whole texts.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from rowmend.llm import tables
from rowmend.llm.text import pieces

# Fixed value: the character that stands for a space in piece vocabularies.
MARK = "▁"
CACHE = 400_000
SHORT = 48
CHECKED_TOGETHER = 256
# Symbols are numbers of this many bits; characters without a piece come after all pieces.
BITS = 22
FOREIGN = 1 << 21
NO_PAIR = np.iinfo(np.int64).max
_codecs: dict[tuple[str, int], PieceCodec] = {}


class PieceCodec:
    """Vocabulary, agenda encoder and decoder of one model file, with a bounded cache of parts."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) for i in range(n)]
        byte = [self.library.is_byte(i) for i in range(n)]
        self.names = names
        self.ids = {name: i for i, name in enumerate(names) if not special[i] and not byte[i]}
        self.score = {name: self.library.get_score(i) for name, i in self.ids.items()}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(byte) else None
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids or [])}
        self.unknown = self.library.unk_id()
        self.separable = not any(MARK in name.lstrip(MARK) for name in self.ids)
        self.coded: dict[str, bytes] = {}
        self.spelled: dict[str, str] = {}
        self.texts = [name.replace(MARK, " ") for name in names]
        self.numbers = [str(i) for i in range(n)]
        self._lookup()

    def _lookup(self) -> None:
        """All pairs that make a piece: sorted keys, and for each the rank of its score and its id."""
        order = {v: r for r, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = {}
        for name, i in self.ids.items():
            for cut in range(1, len(name)):
                left, right = self.ids.get(name[:cut]), self.ids.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left << BITS | right] = order[self.score[name]] << BITS | i
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_values = np.append(np.array([pairs[k] for k in keys.tolist()], np.int64), NO_PAIR)

    def agenda(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already.

        The agenda holds the adjacent pairs that are pieces, best score first and leftmost
        among equals. The best pair becomes one symbol, which brings its two new pairs.
        """
        ids: list[int] = []
        for symbol in self._merged_heap(list(text)):
            known = self.ids.get(symbol)
            if known is not None:
                ids.append(known)
            else:
                ids.extend(self._fallback(symbol))
        return ids

    def agendas(self, texts: list[str]) -> list[list[int]]:
        """``agenda`` of many short texts in step: each takes its best pair in every round."""
        lengths = np.array([len(t) for t in texts], np.int64)
        chars, place = np.unique(
            np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True
        )
        known = np.array([self.ids.get(chr(c), FOREIGN + c) for c in chars.tolist()], np.int64)
        symbols, owner = known[place], np.repeat(np.arange(len(texts)), lengths)
        pairs = self._pairs(symbols, owner, np.arange(len(symbols)))
        done_symbols, done_owners = [], []
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            counts = np.diff(np.append(first, len(owner)))
            best = np.repeat(np.minimum.reduceat(pairs >> BITS, first), counts)
            idle = best == NO_PAIR >> BITS
            done_symbols.append(symbols[idle])
            done_owners.append(owner[idle])
            symbols, owner, pairs, best = symbols[~idle], owner[~idle], pairs[~idle], best[~idle]
            hits = np.flatnonzero(pairs >> BITS == best)
            hits = hits[np.diff(owner[hits], prepend=-1) != 0]
            symbols[hits] = pairs[hits] & (1 << BITS) - 1
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            symbols, owner, pairs = symbols[stay], owner[stay], pairs[stay]
            hits = hits - np.arange(len(hits))
            changed = np.concatenate([hits, hits[hits > 0] - 1])
            pairs[changed] = self._pairs(symbols, owner, changed)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owners)
        symbols = symbols[np.argsort(owner, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(texts))).tolist()
        found = [symbols[a:b] for a, b in zip([0, *ends], ends)]
        if len(symbols) and max(symbols) >= FOREIGN:
            found = [
                [j for i in ids for j in ([i] if i < FOREIGN else self._fallback(chr(i - FOREIGN)))] for ids in found
            ]
        return found

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Score rank and id of the piece that the symbol at each place makes with the next."""
        follower = np.minimum(at + 1, len(symbols) - 1)
        same = (owner[at] == owner[follower]) & (follower > at)
        key = symbols[at] << BITS | symbols[follower]
        slot = np.searchsorted(self.pair_keys, key)
        return np.where(same & (self.pair_keys[slot] == key), self.pair_values[slot], NO_PAIR)

    def _fallback(self, symbol: str) -> list[int]:
        return [self.byte_ids[b] for b in symbol.encode()] if self.byte_ids else [self.unknown]

    def _merged_heap(self, symbols: list[str]) -> list[str]:
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                joined = symbols[left] + symbols[right]
                found = self.score.get(joined)
                if found is not None:
                    heapq.heappush(heap, (-found, left, right, joined))

        for i in range(n - 1):
            propose(i, i + 1)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            # Entries whose symbols have changed meanwhile are skipped.
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, ""
            follower = after[right]
            after[left] = follower
            if follower >= 0:
                before[follower] = left
            propose(before[left], left)
            propose(left, follower)
        return [s for s in symbols if s]

    def spell(self, ids: list[int]) -> str:
        """The text that ids stand for, marks as spaces; bytes that are no UTF-8 become U+FFFD."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.names[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def split(self, text: str) -> list[str]:
        """Parts of a text, each beginning with its marks; together the text as the vocabulary sees it."""
        if not text:
            return []
        marked = (MARK + text).replace(" ", MARK)
        if not self.separable:
            return [marked]
        if MARK + MARK not in marked:
            return [MARK + word for word in marked[1:].split(MARK)]
        return re.findall(f"{MARK}+[^{MARK}]*", marked)

    def learn(self, parts: set[str]) -> None:
        """Encode parts that are not in the cache, and check them against the library."""
        new = [p for p in parts if p not in self.coded]
        short = [p for p in new if len(p) <= SHORT]
        long = [p for p in new if len(p) > SHORT]
        found = (self.agendas(short) if short else []) + [self.agenda(p) for p in long]
        self._compare(short + long, found)
        numbers, texts, raw = self.numbers, self.texts, self.byte_of
        for part, ids in zip(short + long, found):
            self.coded[part] = ",".join([numbers[i] for i in ids]).encode()
            self.spelled[part] = self.spell(ids) if not raw.keys().isdisjoint(ids) else "".join([texts[i] for i in ids])

    def _compare(self, parts: list[str], found: list[list[int]]) -> None:
        """Raise unless the library gives the same ids.

        It gets many parts as one text, except for parts of marks alone, which would
        merge with the next. It puts one mark in front by itself.
        """
        runs: list[tuple[list[str], list[int]]] = []
        for part, ids in zip(parts, found):
            if self.separable and part.lstrip(MARK):
                if not runs or len(runs[-1][0]) >= CHECKED_TOGETHER or not runs[-1][0][0].lstrip(MARK):
                    runs.append(([], []))
                runs[-1][0].append(part)
                runs[-1][1].extend(ids)
            elif part != MARK:
                runs.append(([part], ids))
        texts = ["".join(p)[1:].replace(MARK, " ") for p, _ in runs]
        for (part, ids), right in zip(runs, self.library.encode(texts, num_threads=1)):
            if ids != right:
                raise ValueError(f"ids of {part[:5]!r}... differ from the library's")

    def encode(self, text: str | None) -> list[int]:
        [split] = self._known([text or ""])
        return [int(i) for p in split for i in self.coded[p].split(b",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one leading space, which encoding has added, goes."""
        return self.spell(ids).removeprefix(" ")

    def _known(self, texts: list[str]) -> list[list[str]]:
        split = [self.split(t) for t in texts]
        if len(self.coded) > self.cache:
            self.coded.clear()
            self.spelled.clear()
        self.learn(set(chain.from_iterable(split)))
        return split

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids and SHA-256 of the decoded text, for each text."""
        coded, spelled = self.coded.__getitem__, self.spelled.__getitem__
        for split in self._known(texts):
            ids = b",".join(map(coded, split))
            decoded = "".join(map(spelled, split)).removeprefix(" ")
            yield (
                ids.count(b",") + 1 if ids else 0,
                hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(),
            )


def codec(path: str, cache: int = CACHE) -> PieceCodec:
    """One codec per worker process and file."""
    if (path, cache) not in _codecs:
        _codecs[path, cache] = PieceCodec(path, cache)
    return _codecs[path, cache]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the ids of every text; null is empty and has none. Rows stay as they come."""
    tables.ready(docs)

    def work(batches):
        own = codec(model)
        for batch in pieces(batches, "text"):
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return _input(docs, id_col, text_col).mapInArrow(work, f"id {_type(docs, id_col)}, ids array<int>")


def decoded(coded: DataFrame, model: str) -> DataFrame:
    """``(id, text)`` from ``(id, ids)``; null ids are an empty text."""
    tables.ready(coded)

    def work(batches):
        own = codec(model)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return coded.select("id", "ids").mapInArrow(work, f"id {_type(coded, 'id')}, text string")


def round_trip(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: every text encoded, then its ids decoded.

    A map over the rows without a shuffle; memory is one slice of texts and the cache of
    ``cache`` parts, which stays in the worker. Null is the empty text. Repeated rows and null ids of rows stay as they are.
    """
    tables.ready(docs)

    def work(batches):
        own = codec(model, cache)
        for batch in pieces(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n, ids, text = zip(*own.digests(texts))
            yield pa.record_batch(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _input(docs, id_col, text_col).mapInArrow(
        work, f"id {_type(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()

"""Alignment of two tokenizers' tokens at shared byte ends, and how often token pairs are linked."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from tokenizers import Tokenizer

from rowmend.llm import blobs, tables
from rowmend.llm.pieces import MARK
from rowmend.llm.text import pieces

# Bytes of text that are tokenized together, and that share one list of distinct pairs.
SLICE_BYTES, CHUNK_BYTES = 1 << 20, 24 << 20
# Links written out at once; a group with more is counted by its distinct ids.
MOST_LINKS = 1 << 21
# A pair of ids is one number: the first id above so many bits of the second.
ID_BITS = 20
# Fixed value: how texts are split before byte pairs are merged.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters that every version of Unicode puts into the same classes.
_SETTLED = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")
_SEPARATORS = np.frombuffer(b",|;", np.uint8)
_open: dict[tuple, tuple[ByteTokens, PieceTokens]] = {}


@dataclass(frozen=True)
class Spelling:
    """The bytes of every token of a vocabulary, end to end."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Spelling:
        sizes = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        first = np.cumsum(sizes) - sizes
        return self.data[np.arange(int(sizes.sum())) + np.repeat(self.starts[ids] - first, sizes)].tobytes()


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """A byte-level tokenizer file; with its ranks, texts of settled characters take a faster library."""

    def __init__(self, path: str, ranks_path: str | None = None):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        letters = _byte_letters()
        by_id = {i: name for name, i in self.library.get_vocab(with_added_tokens=False).items()}
        added = {t["id"]: t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]}
        size = max([*by_id, *added]) + 1
        self.spelling = Spelling.of([
            bytes(letters[c] for c in by_id[i]) if i in by_id and i not in added else added.get(i, "").encode() for i in range(size)
        ])
        self.fast = None
        if ranks_path:
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast and _SETTLED.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), np.int64)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)


class PieceTokens:
    """A piece model that puts a space before the text by itself."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.spelling = Spelling.of([
            bytes([int(self.library.id_to_piece(i)[3:5], 16)]) if self.library.is_byte(i)
            else b"" if self.library.is_control(i) or self.library.is_unknown(i)
            else self.library.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(n)
        ])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.library.encode(texts, num_threads=1)]


def _opened(byte_path: str, piece_path: str, ranks_path: str | None) -> tuple[ByteTokens, PieceTokens]:
    key = (byte_path, piece_path, ranks_path)
    if key not in _open:
        _open[key] = ByteTokens(byte_path, ranks_path), PieceTokens(piece_path)
    return _open[key]


def shared_cuts(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places in ``a`` of the ends that ``b`` has too, of all intervals ``low`` to ``high`` at once.

    Each interval looks for a shared end from its middle outwards, by bisection of ``b``. A
    shared end cuts it in two, which are searched in the same way; an interval without one
    is a leaf. Intervals of all texts go on together, one probe each per round.
    """
    found = []
    step = np.zeros(len(low), np.int64)
    open_ones = low < high
    low, high, step = low[open_ones], high[open_ones], step[open_ones]
    while len(low):
        aside = (step + 1) // 2
        probe = (low + high) // 2 + np.where(step % 2 == 1, -aside, aside)
        inside = (probe >= low) & (probe < high)
        ends = a[np.where(inside, probe, low)]
        at = np.minimum(np.searchsorted(b, ends), len(b) - 1)
        hit = inside & (b[at] == ends)
        cut = probe[hit]
        found.append(cut)
        stay = ~hit & (step <= high - low)
        low, high, step = (
            np.concatenate([low[stay], low[hit], cut + 1]), np.concatenate([high[stay], cut, high[hit]]),
            np.concatenate([step[stay] + 1, np.zeros(2 * len(cut), np.int64)]),
        )
        open_ones = low < high
        low, high, step = low[open_ones], high[open_ones], step[open_ones]
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


@dataclass(frozen=True)
class Groups:
    """Tokens of some texts and the groups they form; a group's tokens follow each other on both sides."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    text: np.ndarray

    @property
    def a_sizes(self) -> np.ndarray:
        return np.diff(self.a_ends, prepend=0)

    @property
    def b_sizes(self) -> np.ndarray:
        return np.diff(self.b_ends, prepend=0)


def grouped(a: list[np.ndarray], b: list[np.ndarray], left: Spelling, right: Spelling) -> Groups:
    """Groups of texts, each with at least one token, whose tokens spell the same bytes on both sides."""
    ids_a, ids_b = np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])
    ends_a, ends_b = np.cumsum(left.sizes[ids_a]), np.cumsum(right.sizes[ids_b])
    last = np.cumsum([len(x) for x in a]).astype(np.int64)
    first = last - np.array([len(x) for x in a], np.int64)
    cuts = np.sort(np.concatenate([shared_cuts(ends_a, ends_b, first, last - 1), last - 1]))
    b_ends = np.searchsorted(ends_b, ends_a[cuts]) + 1 if len(cuts) else cuts
    return Groups(ids_a, ids_b, cuts + 1, b_ends, np.searchsorted(last, cuts, side="right"))


def links(groups: Groups) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text << 2 ID_BITS | pair, times)``: distinct within an item, items of bounded size one after the other."""
    sizes_a, sizes_b = groups.a_sizes, groups.b_sizes
    many = sizes_a * sizes_b
    large = many > MOST_LINKS
    for g in np.flatnonzero(large).tolist():
        own_a, n_a = np.unique(groups.a[groups.a_ends[g] - sizes_a[g] : groups.a_ends[g]], return_counts=True)
        own_b, n_b = np.unique(groups.b[groups.b_ends[g] - sizes_b[g] : groups.b_ends[g]], return_counts=True)
        rows = max(1, MOST_LINKS // len(own_b))
        for i in range(0, len(own_a), rows):
            pair = (own_a[i : i + rows, None] << ID_BITS | own_b[None, :]).ravel()
            yield (groups.text[g] << 2 * ID_BITS) | pair, (n_a[i : i + rows, None] * n_b[None, :]).ravel()
    small = np.flatnonzero(~large)
    portion = np.cumsum(many[small]) // MOST_LINKS
    for p in np.unique(portion).tolist():
        g = small[portion == p]
        n, wide = many[g], sizes_b[g]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(groups.a_ends[g] - sizes_a[g], n) + within // np.repeat(wide, n)
        j = np.repeat(groups.b_ends[g] - wide, n) + within % np.repeat(wide, n)
        yield np.unique(np.repeat(groups.text[g], n) << 2 * ID_BITS | groups.a[i] << ID_BITS | groups.b[j], return_counts=True)


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    names = [str(i).encode() for i in range(size)]
    wide = max(map(len, names), default=1)
    return np.frombuffer(b"".join(n.ljust(wide + 1) for n in names), np.uint8).reshape(size, wide + 1), np.array(list(map(len, names)))


def spelled(groups: Groups, texts: int) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    sizes_a, sizes_b = groups.a_sizes, groups.b_sizes
    total = len(groups.a) + len(groups.b)
    if not total:
        return [b""] * texts
    ids, mark = np.empty(total, np.int64), np.zeros(total, np.int64)
    ids[np.arange(len(groups.a)) + np.repeat(groups.b_ends - sizes_b, sizes_a)] = groups.a
    ids[np.arange(len(groups.b)) + np.repeat(groups.a_ends, sizes_b)] = groups.b
    mark[groups.a_ends + groups.b_ends - sizes_b - 1] = 1
    mark[groups.a_ends + groups.b_ends - 1] = 2
    table, width = _digits(int(ids.max()) + 1)
    letters, size = table[ids], width[ids]
    letters[np.arange(total), size] = _SEPARATORS[mark]
    flat = letters[np.arange(table.shape[1])[None, :] <= size[:, None]].tobytes()
    ends = np.cumsum(size + 1)[groups.a_ends + groups.b_ends - 1]
    counts = np.bincount(groups.text, minlength=texts)
    last = np.cumsum(counts)
    out, begin = [], 0
    for n, end in zip(counts.tolist(), last.tolist()):
        stop = int(ends[end - 1]) if n else begin
        out.append(flat[begin : stop - 1] if n else b"")
        begin = stop
    return out


@dataclass
class _Chunk:
    """What some slices of texts of one task have together."""

    ids: list = field(default_factory=list)
    numbers: list = field(default_factory=list)
    digests: list = field(default_factory=list)
    text: list = field(default_factory=list)
    pair: list = field(default_factory=list)
    times: list = field(default_factory=list)
    bytes: int = 0
    texts: int = 0

    def add(self, ids: pa.Array, texts: list[str], first: ByteTokens, second: PieceTokens) -> None:
        spaced = [" " + t if t else "" for t in texts]
        a = [first.encode(t) if t else np.empty(0, np.int64) for t in spaced]
        b = second.encode_all(texts)
        raw = [t.encode() for t in spaced]
        same = [bool(t) and first.spelling.joined(x) == t and second.spelling.joined(y) == t for t, x, y in zip(raw, a, b)]
        kept = np.flatnonzero(same)
        n = len(kept)
        found = grouped([a[i] for i in kept], [b[i] for i in kept], first.spelling, second.spelling)
        numbers = np.zeros((4, len(texts)), np.int64)
        numbers[0, kept] = [len(a[i]) for i in kept]
        numbers[1, kept] = [len(b[i]) for i in kept]
        numbers[2, kept] = np.bincount(found.text, minlength=n)
        numbers[3, kept] = np.bincount(found.text, found.a_sizes * found.b_sizes, n).astype(np.int64)
        digests = [""] * len(texts)
        for i, line in zip(kept.tolist(), spelled(found, n)):
            digests[i] = hashlib.sha256(line).hexdigest()
        parts = list(links(found))
        if parts:
            keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            times = np.bincount(place, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
            self.text.append(kept[keys >> 2 * ID_BITS] + self.texts)
            self.pair.append(keys & ((1 << 2 * ID_BITS) - 1))
            self.times.append(times)
        self.ids.append(ids)
        self.numbers.append(numbers)
        self.digests += digests
        self.texts += len(texts)
        self.bytes += sum(map(len, raw))

    def row(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        """One row: the texts' numbers, which pairs each text has, and in how many texts each pair is."""
        empty = np.empty(0, np.int64)
        text, pair, times = (np.concatenate([*x, empty]) for x in (self.text, self.pair, self.times))
        distinct, place, documents = np.unique(pair, return_inverse=True, return_counts=True)
        body = blobs.packed_all(np.bincount(text, minlength=self.texts), place, times)
        ids = pa.concat_arrays(self.ids)
        numbers = np.concatenate(self.numbers, axis=1)
        columns = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, self.texts], pa.int32()), ids.cast(id_type))]
        columns += [pa.array([n.tolist()], pa.list_(pa.int64())) for n in numbers]
        columns += [pa.array([self.digests], pa.list_(pa.string())), pa.array([body], pa.binary())]
        columns += [pa.array([v], pa.list_(pa.int64())) for v in (distinct, documents)]
        return pa.record_batch(columns, _CHUNK_NAMES)


_CHUNK_NAMES = ["chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "body", "pairs", "documents"]


def _chunks(batches: Iterator[pa.RecordBatch], paths: tuple) -> Iterator[pa.RecordBatch]:
    first, second = _opened(*paths)
    number, chunk, id_type = TaskContext.get().partitionId() << 32, _Chunk(), None
    for batch in pieces(batches, "text", SLICE_BYTES):
        id_type = batch.column("id").type
        chunk.add(batch.column("id"), batch.column("text").to_pylist(), first, second)
        if chunk.bytes >= CHUNK_BYTES:
            yield chunk.row(number, id_type)
            number, chunk = number + 1, _Chunk()
    if chunk.texts:
        yield chunk.row(number, id_type)


def _finish(counted: pa.Table, chunk: pa.Table) -> pa.Table:
    """The texts of a chunk with the sums over their links; ``counted`` has the chunk's pairs."""
    order = np.argsort(counted.column("pair").to_numpy())
    often, best = counted.column("often").to_numpy()[order], counted.column("best").to_numpy()[order]
    out: dict[str, list] = {name: [] for name in ("ids", "n_a", "n_b", "n_groups", "n_links", "digests")}
    n_best, sums = [], []
    for i in range(chunk.num_rows):
        for name in out:
            out[name] += chunk.column(name)[i].as_py()
        sizes, place, times = (x.astype(np.int64) for x in blobs.unpacked_all(chunk.column("body")[i].as_py()))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for into, value in ((n_best, times * (often[place] == best[place])), (sums, times * often[place])):
            upto = np.concatenate(([0], np.cumsum(value)))
            ends = np.cumsum(sizes)
            into += (upto[ends] - upto[ends - sizes]).tolist() if len(owner) else [0] * len(sizes)
    id_type = chunk.schema.field("ids").type.value_type
    return pa.table({
        "id": pa.array(out["ids"], id_type), **{n: pa.array(out[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")},
        "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": pa.array(out["digests"], pa.string()),
    })


def _first_id(pair: str) -> Column:
    return F.shiftright(pair, ID_BITS)


def link_counts(chunks: DataFrame) -> DataFrame:
    """``(chunk, pair, often)``: every pair of a chunk with the number of documents that hold it, of all chunks.

    Chunks have counted their own documents, so a pair meets itself at most once per chunk.
    """
    listed = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "documents")).alias("p"))
    own = listed.select("chunk", F.col("p.pairs").alias("pair"), F.col("p.documents").alias("documents"))
    return own.select("chunk", "pair", F.sum("documents").over(Window.partitionBy("pair")).alias("often"))


def pair_table(docs: DataFrame, byte_path: str, piece_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a, b, often)``: every linked pair of ids and the number of documents that hold it."""
    counted = link_counts(_written_chunks(docs, byte_path, piece_path, ranks_path, id_col, text_col)[0])
    pairs = counted.groupBy("pair").agg(F.first("often").alias("often"))
    return pairs.select(
        _first_id("pair").cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int").alias("b"), "often"
    )


def _written_chunks(docs: DataFrame, byte_path: str, piece_path: str, ranks_path: str | None, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    tables.ready(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lists = ", ".join(f"{n} array<bigint>" for n in ("n_a", "n_b", "n_groups", "n_links"))
    shape = f"chunk bigint, ids array<{rows.schema['id'].dataType.simpleString()}>, {lists}, digests array<string>, body binary, pairs array<bigint>, documents array<bigint>"
    paths = (byte_path, piece_path, ranks_path)
    return tables.temporary(rows.mapInArrow(lambda b: _chunks(b, paths), shape), "align-chunks")


def alignment(
    docs: DataFrame, byte_path: str, piece_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per input row.

    Texts, with a space in front, are tokenized by a byte-level tokenizer (a) and a piece
    model (b). Byte places where tokens of both end cut them into groups; all a and b
    tokens of a group are linked. ``n_best`` counts links whose pair is in as many documents
    as any pair of its a id, ``count_sum`` adds up those numbers of documents.

    Null and empty texts, and texts that a tokenizer does not spell back, have zeros and an
    empty digest. Rows that repeat, also with null ids, are documents of their own; an
    empty table gives an empty result; other columns are not looked at. Texts are read
    once, in chunks of some megabytes (a longer text is a chunk by itself) whose distinct
    pairs are counted before any shuffle.
    """
    chunks, _ = _written_chunks(docs, byte_path, piece_path, ranks_path, id_col, text_col)
    counted = tables.written(link_counts(chunks), "align-counts")
    # At most one row per id of the first vocabulary, whatever the size of the corpus.
    best = counted.groupBy(_first_id("pair").alias("a")).agg(F.max("often").alias("best"))
    rated = counted.join(F.broadcast(best), _first_id("pair") == F.col("a")).select("chunk", "pair", "often", "best")
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    texts = chunks.drop("pairs", "documents")
    return rated.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(
        _finish,
        f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    )

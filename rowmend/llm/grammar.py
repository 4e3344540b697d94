"""Token ids of a corpus in files that are Re-Pair grammars, one per block of documents."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rowmend.llm import blobs, tables
from rowmend.llm.text import flat, mix, pieces

BLOCK_IDS = 2_000_000
# Words that the library gets in one text.
GROUP = 100
CACHE = 800_000
SLICE_BYTES = 16 << 20
# A pair becomes a rule if it occurs this often in its block; more than so many wait for the next round,
# which takes twice as many.
LEAST_COUNT = 2
RULES_A_ROUND = 8_192
SLOT_BITS = 20

FILE_SCHEMA = (
    "part int, block int, n_ids bigint, doc_ids array<{id}>, doc_ends binary, first_rule bigint, "
    "left binary, right binary, lengths binary, sequence binary"
)


def compress(ids: np.ndarray, least: int = LEAST_COUNT) -> dict[str, np.ndarray | int]:
    """Rules and the remaining sequence of one block.

    Every round counts all adjacent pairs, makes the most frequent ones nonterminals and
    replaces those occurrences that no neighbouring, more frequent pair claims. Rounds go on
    until no pair is frequent. Pairs that are equally frequent are ranked by a hash: ranked by
    value, a passage of ascending ids would lose one pair a round. An old pair only gets
    rarer, so a round looks at the pairs that were frequent before and those of new rules.
    """
    sequence = ids.astype(np.int64)
    first = int(sequence.max()) + 1 if len(sequence) else 0
    lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rules, turn, places = 0, 0, np.arange(len(sequence) - 1)
    while len(places):
        pairs = sequence[places] << 32 | sequence[places + 1]
        # A slot is at least as frequent as each of its pairs, so rare slots need no sort.
        slots = _slots(pairs, turn)
        common = (np.bincount(slots, minlength=1 << SLOT_BITS) >= least)[slots]
        places, pairs, slots = places[common], pairs[common], slots[common]
        ordered = np.sort(pairs)
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[: len(ordered)]
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        # Most frequent first; the place is the rank.
        chosen = often[np.lexsort((mix(ordered[starts[often]].view(np.uint64)), -counts[often]))[: RULES_A_ROUND << turn]]
        keys = ordered[starts[chosen]]
        found, rank = _ranks(pairs, slots, keys, _slots(keys, turn))
        found = places[found]
        beside = np.diff(found) == 1
        # Of overlapping occurrences of one pair (a run of one id) every second is taken.
        new_run = np.concatenate(([True], ~beside | (rank[1:] != rank[:-1])))
        within = found - np.maximum.accumulate(np.where(new_run, found, 0))
        take = within % 2 == 0
        take[1:] &= ~beside | (rank[1:] < rank[:-1]) | ~new_run[1:]
        take[:-1] &= ~beside | (rank[:-1] <= rank[1:])
        at = found[take]
        taken = rank[take]
        used, number = _numbered(taken, len(keys))
        # Rules of a round are listed by their pairs, which packs well.
        listed = np.argsort(keys[used])
        place = np.empty(len(used), np.int64)
        place[listed] = np.arange(len(used))
        used = used[listed]
        sequence[at] = first + rules + place[number]
        stays = np.ones(len(sequence), bool)
        stays[at + 1] = False
        looked = np.zeros(len(sequence), bool)
        looked[places] = looked[at] = looked[np.maximum(at - 1, 0)] = True
        sequence, looked = sequence[stays], looked[stays]
        places, turn = np.flatnonzero(looked[:-1]), turn + 1
        lefts.append(keys[used] >> 32)
        rights.append(keys[used] & 0xFFFFFFFF)
        rules += len(used)
    left, right = np.concatenate(lefts), np.concatenate(rights)
    return {"first": first, "left": left, "right": right, "lengths": lengths_of(left, right, first), "sequence": sequence}


def _numbered(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values below ``limit``, ascending, and the place of each value among them."""
    seen = np.zeros(limit, bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[values]


def _slots(pairs: np.ndarray, turn: int) -> np.ndarray:
    """Other slots in every turn, so that rare pairs do not share theirs for long."""
    return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 * (2 * turn + 1) & (1 << 64) - 1) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def _ranks(pairs: np.ndarray, slots: np.ndarray, keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``pairs`` holds one of ``keys``, ascending, and the place of that key."""
    table = np.full(1 << SLOT_BITS, -1, np.int32)
    table[own[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)
    rank = table[slots]
    found = np.flatnonzero(rank >= 0)
    rank = rank[found].astype(np.int64)
    wrong = np.flatnonzero(keys[rank] != pairs[found])
    # Keys that share their slot with a more frequent one are searched for among the rest.
    others = np.flatnonzero(table[own] != np.arange(len(keys)))
    others = others[np.argsort(keys[others])]
    keep = np.ones(len(found), bool)
    keep[wrong] = False
    if len(others) and len(wrong):
        wanted = pairs[found[wrong]]
        near = np.minimum(np.searchsorted(keys[others], wanted), len(others) - 1)
        hit = keys[others[near]] == wanted
        rank[wrong[hit]] = others[near[hit]]
        keep[wrong[hit]] = True
    return found[keep], rank[keep]


def lengths_of(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for; a rule uses earlier ones only."""
    out = np.ones(len(left), np.int64)
    depth = np.ones(len(left), bool)
    while depth.any():
        new = sum(np.where(side >= first, out[np.maximum(side - first, 0)], 1) for side in (left, right)) if len(left) else out
        depth = new != out
        out = new
    return out


def expand(
    symbols: np.ndarray, left: np.ndarray, right: np.ndarray, first: int, lengths: np.ndarray | None = None,
) -> np.ndarray:
    """Ids of a run of symbols: the rules in use are opened to their places, then copied."""
    symbols = symbols.astype(np.int64)
    inner = symbols >= first
    if not inner.any():
        return symbols
    rules, number = _numbered(symbols[inner] - first, len(left))
    lengths = lengths_of(left, right, first) if lengths is None else lengths
    begins = np.cumsum(lengths[rules]) - lengths[rules]
    opened = np.empty(int(lengths[rules].sum()), np.int64)
    rule, at = rules, begins
    while len(rule):
        sides = left[rule], right[rule]
        middle = at + np.where(sides[0] >= first, lengths[np.maximum(sides[0] - first, 0)], 1)
        rule, at = np.concatenate(sides), np.concatenate((at, middle))
        closed = rule >= first
        opened[at[~closed]] = rule[~closed]
        rule, at = rule[closed] - first, at[closed]
    lengths = lengths[rules]
    # Ids that stand for themselves follow the opened rules in one array.
    sizes, source = np.ones(len(symbols), np.int64), np.empty(len(symbols), np.int64)
    sizes[inner], source[inner] = lengths[number], begins[number]
    source[~inner] = len(opened) + np.arange(len(symbols) - int(inner.sum()))
    return np.concatenate((opened, symbols[~inner]))[copied(source, sizes)]


def copied(source: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``source`` and have ``sizes``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(source - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def read_range(grammar: dict, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, opening only the symbols that cover them."""
    sequence, first, lengths = grammar["sequence"], grammar["first"], grammar["lengths"]
    sizes = np.where(sequence >= first, lengths[np.maximum(sequence - first, 0)] if len(lengths) else 1, 1)
    ends = np.cumsum(sizes)
    a = int(np.searchsorted(ends, start, side="right"))
    b = int(np.searchsorted(ends, stop, side="left")) + 1
    if stop <= start:
        return np.empty(0, np.int64)
    before = int(ends[a - 1]) if a else 0
    return expand(sequence[a:b], grammar["left"], grammar["right"], first, lengths)[start - before : stop - before]


class WordEncoder:
    """Ids of texts through a tokenizer that never joins over ASCII white space.

    Arrow splits a slice of texts and numbers its distinct words; the library encodes each
    of these once, and the ids of a text are those of its words in order. Words of earlier
    slices are kept as Arrow and numpy columns up to ``CACHE`` of them; then those of the
    present slice alone stay. ``split`` off encodes whole texts, for tokenizers that see
    the space between words.

    The words go to the library many at a time, with ``BREAK`` between them, a digit that
    such tokenizers keep apart from its neighbours and that has one id. Words that contain
    it, and all words of a tokenizer that treats it otherwise, are encoded one by one. A
    tokenizer that ignores case gets words of ASCII alone in lower case, as these cannot
    compose with a mark; other words and those with the text of a special token in any
    spelling stay as they are, since special tokens and compositions are found before case
    is dropped. Words that its normaliser leaves as they are (ASCII ones without capitals,
    if so) skip that step, and one that keeps marks apart from letters gets a word and the
    full stop or comma behind it as two words, so that fewer are distinct.
    """

    BREAK = "0"

    def __init__(self, path: str, split: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = split
        self.words = pa.array([], pa.string())
        self.ids = np.empty(0, "<u4")
        self.begins, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        letters = "abcdefghijklmnopqrstuvwxyz"
        mark = self._ids(["0"])[0].tolist()
        self.mark = mark[0] if len(mark) == 1 and self._same("a0b'0.0'0c", ["a", "0", "b'", "0", ".", "0", "'", "0", "c"]) else None
        self.lowers = self._same(letters.upper(), [letters]) and all(self._same(c.upper(), [c]) for c in letters)
        # The printable ASCII characters without capitals.
        ascii_marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isupper()]
        normalise = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        same = all(normalise(c + d) == c + d for c in ascii_marks for d in ascii_marks)
        rules = json.loads(self.tokenizer.to_str())
        self.special = "|".join(re.escape(t["content"]) for t in rules.get("added_tokens") or [])
        self.plain = Tokenizer.from_str(json.dumps(rules | {"normalizer": None})) if same and self.lowers else None
        self.apart = all(self._same(f"{c}{m}", [c, m]) for c in f"{letters}123456789" for m in ".,")

    def _same(self, text: str, parts: list[str]) -> bool:
        whole, *single = self._ids([text, *parts])
        return np.array_equal(whole, np.concatenate(single))

    def _ids(self, texts: list[str], plain: bool = False) -> list[np.ndarray]:
        coded = (self.plain if plain else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(found.ids, "<u4") for found in coded]

    def _each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one word after the other, and how many each has."""
        texts, found = words.to_pylist(), [np.empty(0, "<u4")]
        for a in range(0, len(texts), 10_000):
            found += self._ids(texts[a : a + 10_000])
        return np.concatenate(found), np.array([len(ids) for ids in found[1:]], np.int64)

    def _joined(self, words: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without ``BREAK``; ``plain`` ones need no normaliser."""
        edges = pa.array(np.append(np.arange(0, len(words), GROUP), len(words)), pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(edges, words), self.BREAK).to_pylist()
        found = []
        for a in range(0, len(texts), 1_000):
            for ids in self._ids(texts[a : a + 1_000], plain):
                found += [ids, np.array([self.mark], "<u4")]
        ids = np.concatenate(found)
        cuts = np.flatnonzero(ids == self.mark)
        if len(cuts) != len(words):
            return self._each(words)
        return ids[ids != self.mark], np.diff(cuts, prepend=-1) - 1

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the words, where those of each word begin and how many they are."""
        if self.mark is None:
            ids, sizes = self._each(words)
            return ids, np.cumsum(sizes) - sizes, sizes
        alone = pc.match_substring(words, self.BREAK).to_numpy(zero_copy_only=False).astype(bool)
        simple = pc.and_(pc.string_is_ascii(words), pc.equal(words, pc.ascii_lower(words)))
        simple = simple.to_numpy(zero_copy_only=False).astype(bool) & ~alone & (self.plain is not None)
        sizes, begins, parts, before = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        ways = ((simple, partial(self._joined, plain=True)), (~simple & ~alone, self._joined), (alone, self._each))
        for places, work in ways:
            if places.any():
                ids, own = work(words.filter(pa.array(places)))
                sizes[places], begins[places] = own, np.cumsum(own) - own + before
                parts.append(ids)
                before += len(ids)
        return np.concatenate([*parts, np.empty(0, "<u4")]), begins, sizes

    def _lowered(self, words: pa.Array) -> pa.Array:
        """The words with those in lower case whose ids cannot depend on it."""
        free = pc.string_is_ascii(words)
        if self.special:
            free = pc.and_not(free, pc.match_substring_regex(words, self.special, ignore_case=True))
        return pc.if_else(free, pc.ascii_lower(words), words)

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same as ``_distinct``, with the library called for new words only."""
        place = pc.index_in(words, value_set=self.words)
        new = place.is_null().to_numpy(zero_copy_only=False).astype(bool)
        unseen = words.filter(pa.array(new))
        ids, own_begins, own_sizes = self._distinct(unseen)
        begins, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begins[new], sizes[new] = own_begins + len(self.ids), own_sizes
        old = place.drop_null().to_numpy(zero_copy_only=False)
        begins[~new], sizes[~new] = self.begins[old], self.sizes[old]
        ids = np.concatenate((self.ids, ids))
        if len(self.words) + len(unseen) <= CACHE:
            self.words, self.ids = pa.concat_arrays([self.words, unseen]), ids
            self.begins, self.sizes = np.append(self.begins, begins[new]), np.append(self.sizes, sizes[new])
        else:
            kept = words if len(words) <= CACHE else words.slice(0, 0)
            self.words, self.sizes = kept, sizes[: len(kept)]
            self.begins = np.cumsum(self.sizes) - self.sizes
            self.ids = ids[copied(begins[: len(kept)], self.sizes)]
        return ids, begins, sizes

    def encode(self, texts: pa.Array | list[str | None], end: bytes = b"") -> list[bytes]:
        """Little-endian 32-bit ids of each text, then ``end``; null is the empty text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.split:
            return [ids.tobytes() + end for ids in self._ids(pc.fill_null(column, "").to_pylist())]
        # A slice gets offsets of its own first; Arrow's text functions read past those of a larger array.
        data, offsets = flat(column)
        column = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(data))
        if self.apart:
            column = pc.replace_substring_regex(column, "([A-Za-z1-9])([.,])([ \t\n\v\f\r]|$)", r"\1 \2\3")
        parts = pc.ascii_split_whitespace(column)
        numbered = parts.flatten().dictionary_encode()
        words, codes = numbered.dictionary, numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if self.lowers:
            merged = self._lowered(words).dictionary_encode()
            words, codes = merged.dictionary, merged.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        ids, begins, sizes = self._looked_up(words.cast(pa.string()))
        # The end of a text counts as one more word behind its own ones.
        begins, sizes = np.append(begins, len(ids)), np.append(sizes, len(end) // 4)
        ids = np.concatenate((ids, np.frombuffer(end, "<u4")))
        edges = parts.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        codes = np.insert(codes, edges[1:], len(sizes) - 1)
        lengths = sizes[codes]
        ids = ids[copied(begins[codes], lengths)]
        totals = np.concatenate(([0], np.cumsum(lengths)))[edges + np.arange(len(edges))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(totals, totals[1:])]


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, split: bool) -> WordEncoder:
    if (path, split) not in _encoders:
        _encoders[path, split] = WordEncoder(path, split)
    return _encoders[path, split]


def _block(part: int, number: int, ids: list, coded: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
    ends = np.cumsum([len(c) // 4 for c in coded])
    found = compress(np.frombuffer(b"".join(coded), "<u4"))
    row = [
        pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([int(ends[-1])], pa.int64()),
        pa.array([ids], pa.list_(id_type)), pa.array([blobs.packed(ends)], pa.binary()),
        pa.array([found["first"]], pa.int64()),
        *[pa.array([blobs.packed(found[k])], pa.binary()) for k in ("left", "right", "lengths", "sequence")],
    ]
    return pa.record_batch(row, [c.split()[0] for c in FILE_SCHEMA.split(", ")])


def write_grammars(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1,
    id_col: str = "doc_id", text_col: str = "text", split: bool = True, partitions: int | None = None,
) -> None:
    """Write the ids of all texts, in ascending id order, as Parquet rows with a grammar each.

    One range shuffle orders the texts; a task then encodes and compresses block after
    block, so it holds one block whatever its partition has. Null texts are empty, null
    ids come first, equal ids are ordered by the hash of their texts. An empty table
    gives no rows. Files appear only when the job commits.
    """
    spark = tables.ready(docs)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer, split), TaskContext.get().partitionId()
        ids, coded, size, number, kind = [], [], 0, 0, pa.int64()
        for batch in pieces(batches, "text", SLICE_BYTES):
            kind = batch.column("id").type
            for i, c in zip(batch.column("id").to_pylist(), own.encode(batch.column("text"), end)):
                ids.append(i)
                coded.append(c)
                size += len(c) // 4
                if size >= BLOCK_IDS:
                    yield _block(part, number, ids, coded, kind)
                    ids, coded, size, number = [], [], 0, number + 1
        if ids:
            yield _block(part, number, ids, coded, kind)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions or tables.tasks(spark), "id", "tie").sortWithinPartitions("id", "tie")
    id_type = rows.schema["id"].dataType.simpleString()
    ordered.select("id", "text").mapInArrow(work, FILE_SCHEMA.format(id=id_type)).write.parquet(path)


def read_documents(files: DataFrame, digest: Callable[[bytes], int] = zlib.crc32) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` decoded from the files.

    Blocks before a block are summed per part first, so the running total over parts has
    one row per part.
    """
    tables.ready(files)
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("before_part")
    )
    bases = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("before")).join(
        parts, "part"
    ).select("part", "block", (F.col("before") + F.col("before_part")).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]
                left, right, sequence, ends = (
                    blobs.unpacked(get(c).as_py()).astype(np.int64) for c in ("left", "right", "sequence", "doc_ends")
                )
                ids = expand(sequence, left, right, get("first_rule").as_py()).astype("<u4")
                starts = np.concatenate(([0], ends[:-1]))
                sums = [digest(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [get("doc_ids").values, pa.array(starts + get("base").as_py()), pa.array(ends - starts),
                     pa.array(sums, pa.int64())],
                    ["id", "start", "n_tokens", "ids_crc32"],
                )

    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()
    columns = ["doc_ids", "doc_ends", "first_rule", "left", "right", "sequence", "base"]
    return files.join(bases, ["part", "block"]).select(*columns).mapInArrow(
        work, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    )

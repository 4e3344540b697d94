"""Katz backoff over words: Good-Turing discounts, exactly normalised backoff, scores per text.

Words are numbered and counted in a first exchange, pairs of words in a second. Chunks of
documents send each slot of an exchange one packed blob of what they hold, distinct entries
with their counts, so a frequent word is one entry per chunk and not one row per place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from rowmend import storage
from rowmend.llm import blobs, tables
from rowmend.llm.text import LOWER, NOT_SPACE, flat, hashes, per_text, pieces, spans

CHUNK_TOKENS = 3 << 18
SLOTS_A_TASK = 2
HASHED_BYTES = 1 << 20
# Counts up to this are discounted; Katz' own choice.
LARGEST = 5
# Fixed value: stands for the end of a text among word hashes.
END = np.uint64(0x5EED0FE0D0FAE47D)
_HALF = 0xFFFFFFFF


@dataclass(frozen=True)
class Discounts:
    """Factors for counts 1 to ``LARGEST``; higher counts stay whole."""

    factor: np.ndarray

    @staticmethod
    def of(numbers: list[int]) -> Discounts:
        """From the numbers of entries that occur 1, 2, ... ``LARGEST + 1`` times.

        Where Good-Turing gives factors outside 0 to 1 (tables too small for it), an
        absolute discount estimated from the first two numbers takes its place.
        """
        r = np.arange(1, LARGEST + 1)
        n = np.array(numbers, float)
        if (n > 0).all():
            common = (LARGEST + 1) * n[LARGEST] / n[0]
            factor = ((r + 1) * n[1:] / n[:-1] / r - common) / (1 - common) if common != 1 else np.zeros(LARGEST)
            if ((factor > 0) & (factor < 1)).all():
                return Discounts(np.concatenate(([0.0], factor, [1.0])))
        lost = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        return Discounts(np.concatenate(([0.0], (r - lost) / r, [1.0])))

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * self.factor[np.minimum(counts, LARGEST + 1).astype(np.int64)]


@dataclass(frozen=True)
class WordModel:
    """Order one: discounted shares of known words, the rest for one unknown class."""

    tokens: int
    words: int
    discounts: Discounts
    scale: float
    unknown: float

    @staticmethod
    def of(tokens: int, words: int, numbers: list[int]) -> WordModel:
        discounts = Discounts.of(numbers)
        if not tokens:
            return WordModel(0, 0, discounts, 1.0, 1.0)
        r = np.arange(1, LARGEST + 1)
        left = float((np.array(numbers[:LARGEST]) * r * (1 - discounts.factor[1:-1])).sum()) / tokens
        if left > 0:
            return WordModel(tokens, words, discounts, 1.0, left)
        # No word is rare: as much as one more token stays for the unknown class.
        return WordModel(tokens, words, discounts, tokens / (tokens + 1), 1 / (tokens + 1))

    def p(self, counts: np.ndarray) -> np.ndarray:
        known = self.discounts.kept(counts) * (self.scale / max(1, self.tokens))
        return np.where(counts > 0, known, self.unknown)


@dataclass(frozen=True)
class Exchange:
    """What the tasks of an exchange need: number of slots, models so far, sums of hot contexts."""

    slots: int
    words: WordModel | None = None
    pairs: Discounts | None = None
    hot: dict[int, tuple[float, float, float]] = field(default_factory=dict)


_SCHEMA = "slot int, chunk string, doc_ids array<{id}>, body binary, numbers array<bigint>"
_NAMES = ["slot", "chunk", "doc_ids", "body", "numbers"]


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * 5
    types = [pa.int32(), pa.string(), pa.list_(id_type), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.zeros(1, ascending.dtype))


def _run_gaps(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Ascending runs that begin at ``heads``: first values, then steps."""
    out = _gaps(values)
    out[heads] = values[heads]
    return out


def _run_values(gaps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    sums = np.cumsum(gaps)
    heads = np.cumsum(runs) - runs
    return sums - np.repeat(sums[heads] - gaps[heads], runs)


def _groups(owner: np.ndarray, groups: int) -> list[int]:
    return np.searchsorted(owner, np.arange(groups + 1)).tolist()


def _chunks(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Documents of about ``CHUNK_TOKENS`` tokens as numbers, and their words by slot."""
    number, held, size = 0, [], 0
    for batch in pieces(batches, "text", HASHED_BYTES):
        data, offsets = flat(batch.column("text"))
        low = LOWER[data]
        starts, ends, doc = spans(low, offsets, NOT_SPACE)
        bounds = per_text(doc, batch.num_rows)
        tokens = np.insert(hashes(low, starts, ends), bounds[1:], END)
        held.append((batch.column("id"), batch.column("learn").to_numpy(zero_copy_only=False), np.diff(bounds) + 1, tokens))
        size += len(tokens)
        if size >= CHUNK_TOKENS:
            yield from _chunk(held, number, slots).to_batches()
            number, held, size = number + 1, [], 0
    if held:
        yield from _chunk(held, number, slots).to_batches()


def _chunk(held: list[tuple], number: int, slots: int) -> pa.Table:
    name = f"{TaskContext.get().partitionId()}-{number}"
    learn, lengths, tokens = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
    distinct, place = np.unique(tokens, return_inverse=True)
    slot = (distinct % np.uint64(slots)).astype(np.int64)
    order = np.lexsort((distinct, slot))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    place = rank[place]
    counts = np.bincount(place[np.repeat(learn, lengths)], minlength=len(order))
    distinct, cut = distinct[order], _groups(slot[order], slots)
    ids = [v for h in held for v in h[0].to_pylist()]
    end = rank[np.searchsorted(np.sort(distinct), END)] if len(distinct) else 0
    rows = [(-1, name, ids, blobs.packed_all(place, lengths, learn, np.array([end])), None)]
    for s, (a, b) in enumerate(zip(cut, cut[1:])):
        if b > a:
            rows.append((s, name, None, blobs.packed_all(_gaps(distinct[a:b]), counts[a:b]), None))
    return _rows(rows, held[0][0].type)


def _numbers(counts: np.ndarray) -> list[int]:
    """Sum, distinct entries, and how many occur 1, 2, ... ``LARGEST + 1`` times."""
    often = np.bincount(np.minimum(counts, LARGEST + 2).astype(np.int64), minlength=LARGEST + 3)
    return [int(counts.sum()), int((counts > 0).sum()), *often[1 : LARGEST + 2].tolist()]


def _count_words(table: pa.Table, slots: int) -> pa.Table:
    """One slot of words: number and total count for each entry of each chunk.

    Numbers grow with falling count, known words only; unknown ones are 0. The row
    without a chunk is the slot's part of the model: words, counts and their numbers.
    """
    id_type = table.schema.field("doc_ids").type.value_type
    [slot] = set(table.column("slot").to_pylist())
    parts = [blobs.unpacked_all(b) for b in table.column("body").to_pylist()]
    words = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(distinct)).astype(np.int64)
    numbers = np.zeros(len(distinct), np.int64)
    order = np.lexsort((distinct, -counts))[: int((counts > 0).sum())]
    numbers[order] = np.arange(len(order)) * slots + slot + 1
    rows, at = [(slot, None, None, blobs.packed_all(_gaps(distinct), counts), _numbers(counts))], 0
    for name, own in zip(table.column("chunk").to_pylist(), words):
        mine = place[at : at + len(own)]
        at += len(own)
        rows.append((slot, name, None, blobs.packed_all(numbers[mine], counts[mine]), None))
    return _rows(rows, id_type)


def _pair_rows(table: pa.Table, plan: Exchange) -> pa.Table:
    """One chunk: pairs of words by slot, and what the chunk knows of its documents by itself.

    Slots are chosen by the context, or by both words if the context has more than a
    slot's share of all tokens. After an unknown context a token has its order-one share.
    """
    id_type = table.schema.field("doc_ids").type.value_type
    order = np.argsort(table.column("slot").to_numpy())
    names, ids, bodies = (table.column(c).to_pylist() for c in ("chunk", "doc_ids", "body"))
    name, first = names[0], order[0]
    place, lengths, learn, end = (a.astype(np.int64) for a in blobs.unpacked_all(bodies[first]))
    parts = [blobs.unpacked_all(bodies[i]) for i in order[1:]]
    number = np.concatenate([p[0] for p in parts]).astype(np.int64)
    count = np.concatenate([p[1] for p in parts]).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    begins = np.cumsum(lengths) - lengths
    context = np.concatenate((end, place[:-1]))
    context[begins] = end
    n = len(lengths)

    model = plan.words
    seen = count[place]
    base = np.log10((seen + 1) / (model.tokens + model.words + 1))
    alone = number[context] == 0
    local = np.bincount(doc[alone], np.log10(model.p(seen[alone])), n)
    floats = np.concatenate([np.bincount(doc, base, n), local])
    own_slot = -1 - sum(name.encode()) % plan.slots
    head = [blobs.packed_all(lengths, learn, np.bincount(doc[seen > 0], minlength=n)), floats.tobytes()]
    rows = [(own_slot, name, ids[first], len(head[0]).to_bytes(8, "little") + b"".join(head), None)]

    tokens = np.flatnonzero(~alone)
    if number.max(initial=0) > _HALF:
        raise OverflowError("more words than 32-bit numbers")
    key = number[context[tokens]].astype(np.uint64) << np.uint64(32) | number[place[tokens]].astype(np.uint64)
    types, which, = np.unique(key, return_inverse=True)
    learned = np.bincount(which, learn[doc[tokens]], len(types)).astype(np.int64)
    one = np.zeros(len(types), np.int64)
    one[which] = tokens
    left, right = (types >> np.uint64(32)).astype(np.int64), (types & np.uint64(_HALF)).astype(np.int64)
    hot = count[context[one]] * plan.slots > model.tokens
    slot = (left + np.where(hot, right * 7919 + 1, 0)) % plan.slots
    by_slot = np.lexsort((types, slot))
    rank = np.empty_like(by_slot)
    rank[by_slot] = np.arange(len(by_slot))
    where, times = np.unique(rank[which] * n + doc[tokens], return_counts=True)
    where_type, where_doc = where // n, where % n
    types, learned, right, hot = types[by_slot], learned[by_slot], right[by_slot], hot[by_slot]
    right_count = count[place[one]][by_slot]
    left = left[by_slot]
    cut = _groups(slot[by_slot], plan.slots)
    spread = np.bincount(where_type, minlength=len(types))
    for s, (a, b) in enumerate(zip(cut, cut[1:])):
        if b > a:
            x, y = np.searchsorted(where_type, (a, b))
            heads = np.flatnonzero(np.diff(left[a:b], prepend=-1))
            body = blobs.packed_all(
                _gaps(left[a:b][heads]), np.diff(np.append(heads, b - a)), hot[a:b][heads],
                _run_gaps(right[a:b], heads), right_count[a:b],
                learned[a:b], spread[a:b], where_doc[x:y], times[x:y], np.array([n]),
            )
            rows.append((s, name, None, body, None))
    return _rows(rows, id_type)


def _count_pairs(table: pa.Table) -> pa.Table:
    """One slot of pairs: the pairs with their total counts, and where each chunk has them."""
    id_type = table.schema.field("doc_ids").type.value_type
    slot = table.column("slot").to_pylist()[0]
    if slot < 0:
        return table
    names = table.column("chunk").to_pylist()
    parts = [[a.astype(np.int64) for a in blobs.unpacked_all(b)] for b in table.column("body").to_pylist()]
    left = [np.repeat(np.cumsum(p[0]), p[1]) for p in parts]
    key = np.concatenate([a << 32 | _run_values(p[3], p[1]) for a, p in zip(left, parts)])
    distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[5] for p in parts]), len(distinct)).astype(np.int64)
    hot = np.concatenate([np.repeat(p[2], p[1]) for p in parts])[first]
    own_left = distinct >> 32
    heads = np.flatnonzero(np.diff(own_left, prepend=-1))
    body = [blobs.packed_all(
        _gaps(own_left[heads]), np.diff(np.append(heads, len(distinct))), hot[heads],
        _run_gaps(distinct & _HALF, heads),
        np.concatenate([p[4] for p in parts])[first], counts,
    )]
    at = 0
    for p in parts:
        mine = place[at : at + len(p[3])]
        at += len(p[3])
        body.append(blobs.packed_all(_gaps(mine), p[6], p[7], p[8], p[9]))
    sizes = np.array([len(b) for b in body], "<i8")
    raw = len(sizes).to_bytes(8, "little") + sizes.tobytes() + b"".join(body)
    return _rows([(slot, "\n".join(names), None, raw, _numbers(counts[(distinct & _HALF) > 0]))], id_type)


def _slot_pairs(raw: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    count = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw[8 : 8 + 8 * count], "<i8")).tolist()
    body = raw[8 + 8 * count :]
    parts = [body[a:b] for a, b in zip([0, *ends], ends)]
    return [a.astype(np.int64) for a in blobs.unpacked_all(parts[0])], parts[1:]


def _context_sums(pairs: list[np.ndarray], plan: Exchange) -> np.ndarray:
    """For each context of a slot: tokens after it, discounted tokens, order-one share of seen words."""
    _, runs, _, _, right_count, counts = pairs
    starts = np.cumsum(runs) - runs
    seen = counts > 0
    values = (counts, plan.pairs.kept(counts), np.where(seen, plan.words.p(right_count), 0.0))
    return np.array([np.add.reduceat(v.astype(float), starts) for v in values])


def _hot_sums(batches: Iterator[pa.RecordBatch], plan: Exchange) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("body").to_pylist():
            pairs, _ = _slot_pairs(raw)
            hot = pairs[2] > 0
            sums = _context_sums(pairs, plan)[:, hot]
            yield pa.record_batch([pa.array(np.cumsum(pairs[0])[hot]), *map(pa.array, sums)], ["context", "total", "kept", "low"])


def _score_slots(batches: Iterator[pa.RecordBatch], plan: Exchange) -> Iterator[pa.RecordBatch]:
    """Sums of log10 probabilities per document of each chunk, for one slot at a time."""
    for batch in batches:
        for names, raw in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist()):
            pairs, chunks = _slot_pairs(raw)
            gaps, runs, hot, _, right_count, counts = pairs
            total, kept, low = _context_sums(pairs, plan)
            context = np.cumsum(gaps)
            for i in np.flatnonzero(hot):
                total[i], kept[i], low[i] = plan.hot[int(context[i])]
            # A context without training tokens leaves everything to order one.
            safe = np.maximum(total, 1.0)
            left = np.where(total > 0, 1 - kept / safe, 1.0)
            whole = (total > 0) & (left < 1e-12)
            scale = np.where(whole, total / (total + 1), 1.0)
            left = np.where(whole, 1 / (total + 1), left)
            back = left / np.maximum(1 - low, plan.words.unknown)
            owner = np.repeat(np.arange(len(runs)), runs)
            direct = plan.pairs.kept(counts) * scale[owner] / safe[owner]
            p = np.log10(np.where(counts > 0, direct, back[owner] * plan.words.p(right_count)))
            for name, part in zip(names.split("\n"), chunks):
                mine, spread, doc, times, n = (a.astype(np.int64) for a in blobs.unpacked_all(part))
                sums = np.bincount(doc, np.repeat(p[np.cumsum(mine)], spread) * times, int(n[0]))
                yield pa.record_batch([pa.array([name]), pa.array([sums.tobytes()], pa.binary())], ["chunk", "sums"])


def _finish(table: pa.Table, tokens: int) -> pa.Table:
    """One chunk: the sums of all slots added to what the chunk knew."""
    id_type = table.schema.field("doc_ids").type.value_type
    ids = next(v for v in table.column("doc_ids").to_pylist() if v is not None)
    body = next(v for v in table.column("body").to_pylist() if v is not None)
    size = int.from_bytes(body[:8], "little")
    lengths, learn, known = (a.astype(np.int64) for a in blobs.unpacked_all(body[8 : 8 + size]))
    base, score = np.frombuffer(body[8 + size :]).reshape(2, -1)
    slots = sorted(v for v in table.column("sums").to_pylist() if v is not None)
    for sums in slots:
        score = score + np.frombuffer(sums)
    n = len(ids)
    return pa.table({
        "id": pa.array(ids, id_type), "held_out": pa.array(learn == 0), "n_tokens": pa.array(lengths), "n_known": pa.array(known),
        "train_tokens": pa.array(np.full(n, tokens)), "base_score": pa.array(base), "score": pa.array(score),
    })


def _texts_and_words(chunks: DataFrame, schema: str) -> tuple[DataFrame, str, str]:
    """What chunks know of their texts and of their words, written once but to be given back apart.

    The words, and the paths of the texts and of the words.
    """
    spark = chunks.sparkSession
    path = storage.fresh_path(spark, "katz-chunks")
    chunks.withColumn("of_words", F.col("slot") >= 0).write.partitionBy("of_words").parquet(path)
    paths = [f"{path}/of_words={flag}" for flag in ("false", "true")]
    for each in paths:
        # So that both are there if no row was.
        spark.createDataFrame([], schema).write.mode("append").parquet(each)
    return spark.read.schema(schema).parquet(paths[1]), *paths


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Words between white space, A-Z in lower case, and one end per text are tokens. Rows
    for which ``learn`` holds (null: not) train a model of order two; the end is also the
    context of a text's first word. Every token, unknown words as one class, has the
    discounted share of its pair, or the context's backoff weight times its order-one share;
    each context's shares sum to one. A context that has only frequent followers keeps
    1 / (tokens + 1) for the others. ``score`` adds up log10 probabilities,
    ``base_score`` those of add-one counts. Null texts are empty; without training rows
    every probability is 1; an empty table gives an empty result.

    Words are told apart by 64-bit hashes. A task holds a chunk or a slot; there are
    ``SLOTS_A_TASK`` slots for each task of a shuffle. The pairs and
    their counts are a written table with a row per slot; earlier tables are given back.
    """
    spark = tables.ready(docs)
    slots = SLOTS_A_TASK * tables.tasks(spark)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")
    )
    id_type = rows.schema["id"].dataType.simpleString()
    schema = _SCHEMA.format(id=id_type)
    listed, text_path, listed_path = _texts_and_words(rows.mapInArrow(lambda b: _chunks(b, slots), schema), schema)
    words, word_path = tables.temporary(
        listed.groupBy("slot").applyInArrow(lambda t: _count_words(t, slots), schema), "katz-words"
    )
    tables.release(spark, listed_path)
    word_model = WordModel.of(*_summed(words))
    plan = Exchange(slots, word_model)
    known = spark.read.schema(schema).parquet(text_path).unionByName(words.filter("chunk is not null"))
    pairs = tables.written(
        known.groupBy("chunk").applyInArrow(lambda t: _pair_rows(t, plan), schema)
        .groupBy("slot").applyInArrow(_count_pairs, schema),
        "katz-pairs",
    )
    tables.release(spark, text_path, word_path)
    counted = pairs.filter("slot >= 0")
    plan = Exchange(slots, word_model, Discounts.of(_summed(counted)[2]))
    # A hot context has more than one slot's share of the tokens, so there are fewer than slots.
    hot = counted.mapInArrow(lambda b: _hot_sums(b, plan), "context bigint, total double, kept double, low double")
    sums = hot.groupBy("context").agg(F.sum("total"), F.sum("kept"), F.sum("low")).collect()
    plan = Exchange(slots, word_model, plan.pairs, {r[0]: (r[1], r[2], r[3]) for r in sums})
    partial = counted.mapInArrow(lambda b: _score_slots(b, plan), "chunk string, sums binary")
    parts = pairs.filter("slot < 0").select("chunk", "doc_ids", "body").unionByName(partial, allowMissingColumns=True)
    return parts.groupBy("chunk").applyInArrow(
        lambda t: _finish(t, word_model.tokens),
        f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )


def _summed(counted: DataFrame) -> tuple[int, int, list[int]]:
    found = counted.filter("numbers is not null").agg(
        *[F.coalesce(F.sum(F.col("numbers")[i]), F.lit(0)) for i in range(LARGEST + 3)]
    ).first()
    return found[0], found[1], list(found[2:])

"""Ranked lexical search as inner products: impact vectors in buckets of like length, pruned by bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from rowmend import storage
from rowmend.llm import tables
from rowmend.llm.text import ALPHANUMERIC, LOWER, flat, hashes, pieces, spans

# Items answered together, and the distinct terms they may have; more items are further blocks.
BLOCK_ITEMS, BLOCK_TERMS = 500, 50_000
# A bucket is an eighth of a doubling of the length; its files have so many vectors at least.
STEPS = 8
FILE_ROWS = 1_000
# Buckets from the longest vectors on that are scored without a threshold have so many vectors at least.
SEED_ROWS = 20_000
# Share of an item's terms, the weightiest ones, that the coordinate bound reads.
FOCUS = 0.4
# Bounds are doubles, scores are integers: no rounding may lose a document.
_SLACK = 1 + 1e-9


@dataclass(frozen=True)
class Terms:
    """The distinct terms of a block of items, found in texts by hash and then byte by byte."""

    keys: np.ndarray
    place: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    alike: int

    @classmethod
    def of(cls, words: list[str]) -> Terms:
        data, offsets = flat(pa.array(words, pa.string()))
        keys = hashes(data, offsets[:-1], offsets[1:])
        order = np.argsort(keys, kind="stable")
        alike = int(np.unique(keys, return_counts=True)[1].max(initial=1))
        return cls(keys[order], order, data, offsets[:-1], np.diff(offsets), alike)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of the term at each span, or -1."""
        found = np.full(len(starts), -1, np.int64)
        if not len(starts) or not len(self.keys):
            return found
        keys = hashes(data, starts, ends)
        first = np.searchsorted(self.keys, keys)
        for shift in range(self.alike):
            slot = np.minimum(first + shift, len(self.keys) - 1)
            term = self.place[slot]
            spot = np.flatnonzero((self.keys[slot] == keys) & (self.lengths[term] == ends - starts))
            term, lengths = term[spot], self.lengths[term[spot]]
            if not len(spot):
                continue
            begin = np.cumsum(lengths) - lengths
            within = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
            same = data[np.repeat(starts[spot], lengths) + within] == self.data[np.repeat(self.starts[term], lengths) + within]
            equal = np.logical_and.reduceat(same, begin)
            found[spot[equal]] = term[equal]
        return found


@dataclass(frozen=True)
class Block:
    """Some items: their ids, their distinct terms, and the term numbers of each."""

    ids: list
    terms: Terms
    items: list[np.ndarray]


def terms_of(text: str | None) -> list[str]:
    data, offsets = flat(pa.array([text], pa.string()))
    low = LOWER[data]
    starts, ends, _ = spans(low, offsets, ALPHANUMERIC)
    raw = low.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]


def blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Block]:
    ids, wanted, words = [], [], {}
    rows = items.select(F.col(item_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    for row in rows.toLocalIterator():
        ids.append(row["id"])
        wanted.append(np.array(sorted({words.setdefault(t, len(words)) for t in terms_of(row["text"])}), np.int64))
        if len(ids) >= BLOCK_ITEMS or len(words) >= BLOCK_TERMS:
            yield Block(ids, Terms.of(list(words)), wanted)
            ids, wanted, words = [], [], {}
    if ids:
        yield Block(ids, Terms.of(list(words)), wanted)


def _lists(owner: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _projected(batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[pa.RecordBatch]:
    """Each text's number of terms, and how often it has each term of the items."""
    wide = max(1, len(terms.keys))
    for batch in pieces(batches, "text"):
        data, offsets = flat(batch.column("text"))
        low = LOWER[data]
        starts, ends, doc = spans(low, offsets, ALPHANUMERIC)
        found = terms.find(low, starts, ends)
        known = found >= 0
        key, often = np.unique(doc[known] * wide + found[known], return_counts=True)
        n = batch.num_rows
        yield pa.record_batch(
            [
                batch.column("id"), pa.array(np.bincount(doc, minlength=n), pa.int64()),
                _lists(key // wide, n, key % wide, pa.int32()), _lists(key // wide, n, often, pa.int64()),
            ],
            ["id", "n", "terms", "often"],
        )


def _impacts(batches: Iterator[pa.RecordBatch], weight: np.ndarray, texts: int, total: int) -> Iterator[pa.RecordBatch]:
    """Vectors of weighted impacts, their Euclidean length, and the bucket of that length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        listed, often = batch.column("terms"), batch.column("often").flatten().to_numpy()
        term = listed.flatten().to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy())
        # Python's integers, so that the product cannot overflow.
        measure = np.array([50 + 50 * n * texts // max(1, total) for n in batch.column("n").to_pylist()], np.int64)
        value = weight[term] * (1_000_000_000 * often // (1000 * often + 20 * measure[owner]))
        length = np.sqrt(np.bincount(owner, value.astype(float) ** 2, batch.num_rows))
        with np.errstate(divide="ignore"):
            bucket = np.where(length > 0, np.floor(np.log2(length) * STEPS), -1).astype(np.int32)
        yield pa.record_batch(
            [batch.column("id"), pa.array(length), listed, _lists(owner, batch.num_rows, value, pa.int64()), pa.array(bucket)],
            ["id", "length", "terms", "impacts", "bucket"],
        )


class _Best:
    """The best documents of each item so far, and the score a further one has to reach."""

    def __init__(self, least: np.ndarray, top: int):
        self.top, self.least, self.held = top, least.copy(), [[] for _ in least]

    def add(self, item: int, scores: list[int], ids: list) -> None:
        held = sorted([*self.held[item], *zip(scores, ids)], key=lambda x: (-x[0], x[1] is None, x[1]))[: self.top]
        self.held[item] = held
        if len(held) == self.top:
            self.least[item] = max(self.least[item], held[-1][0])


def _answers(
    batches: Iterator[pa.RecordBatch], items: list[np.ndarray], weight: np.ndarray, least: np.ndarray, top: int, id_type: pa.DataType
) -> Iterator[pa.RecordBatch]:
    """The best of a task's vectors for each item, at most ``top``, none below ``least``.

    Vectors are taken by falling length. An item stops where the root of its number of
    terms times the length is below its threshold (Cauchy-Schwarz). Before that, the
    impacts at its weightiest terms are added up, and the rest is bounded by the length
    that is left; only vectors that can still reach the threshold are scored.
    """
    best = _Best(least, top)
    ordered = [item[np.argsort(-weight[item], kind="stable")] for item in items]
    for batch in batches:
        if not batch.num_rows:
            continue
        length = batch.column("length").to_numpy()
        falling = np.argsort(-length, kind="stable")
        rank = np.empty_like(falling)
        rank[falling] = np.arange(len(falling))
        length = length[falling]
        ids = batch.column("id").take(pa.array(falling))
        id_order = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
        listed = batch.column("terms")
        owner = rank[np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy())]
        term, value = listed.flatten().to_numpy(), batch.column("impacts").flatten().to_numpy()
        by_term = np.lexsort((owner, term))
        owner, term, value = owner[by_term], term[by_term], value[by_term]
        bounds = np.searchsorted(term, np.arange(len(weight) + 1))
        for number, item in enumerate(ordered):
            goal = best.least[number]
            upto = int(np.searchsorted(-length * math.sqrt(len(item)) * _SLACK, -goal, side="right")) if goal > 0 else len(length)
            if not upto or not len(item):
                continue
            score, squares = np.zeros(upto, np.int64), np.zeros(upto)

            def postings(t: int) -> tuple[np.ndarray, np.ndarray]:
                a, b = bounds[t], bounds[t + 1]
                b = a + np.searchsorted(owner[a:b], upto)
                return owner[a:b], value[a:b]

            focus = max(1, math.ceil(len(item) * FOCUS))
            for t in item[:focus].tolist():
                at, v = postings(t)
                score[at] += v
                squares[at] += v.astype(float) ** 2
            left = np.sqrt(np.maximum(length[:upto] ** 2 * _SLACK - squares, 0.0) * (len(item) - focus))
            able = (score + left) * _SLACK >= goal
            for t in item[focus:].tolist():
                at, v = postings(t)
                hit = able[at]
                score[at[hit]] += v[hit]
            good = np.flatnonzero(able & (score >= max(goal, 1)))
            if len(good) > top:
                good = good[np.lexsort((id_order[good], -score[good]))[:top]]
            if len(good):
                best.add(number, score[good].tolist(), ids.take(pa.array(good)).to_pylist())
    rows = [(item, i, s) for item, held in enumerate(best.held) for s, i in held]
    yield pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())],
        ["item", "doc_id", "score"],
    )


def _leading(found: DataFrame, top: int) -> DataFrame:
    """``found`` with its rank within the item, up to ``top``."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_block(rows: DataFrame, block: Block, top: int, item_type: T.DataType) -> DataFrame:
    spark = rows.sparkSession
    id_type = rows.schema["id"].dataType
    kind, terms = id_type.simpleString(), block.terms
    projected, projected_path = tables.temporary(
        rows.mapInArrow(lambda b: _projected(b, terms), f"id {kind}, n bigint, terms array<int>, often array<bigint>"), "lemp-terms"
    )
    texts, total = projected.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row per term of the block.
    held = {r[0]: r[1] for r in projected.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weight = np.array(
        [math.floor(1000 * math.log((2 * texts + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(terms.keys))], np.int64
    )
    shape = f"id {kind}, length double, terms array<int>, impacts array<bigint>, bucket int"
    vectors = projected.mapInArrow(lambda b: _impacts(b, weight, texts, total), shape)
    # One row per bucket: an eighth of a doubling each, so at most some thousand for any data.
    sizes = vectors.filter("bucket >= 0").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("top")).collect()
    sizes.sort(key=lambda r: -r["bucket"])
    # Files are numbered through all buckets, so that each is a partition of its own.
    share = max(FILE_ROWS, sum(r["n"] for r in sizes) // (2 * tables.tasks(spark)))
    counts = [-(-r["n"] // share) for r in sizes]
    firsts = np.cumsum([0, *counts]).tolist()
    files = spark.createDataFrame(
        [(r["bucket"], n, first) for r, n, first in zip(sizes, counts, firsts)], "bucket int, files long, first long"
    )
    path = storage.fresh_path(spark, "lemp-buckets")
    # Vectors without any term of the items have no bucket: their score is 0 for all of them.
    (
        vectors.join(F.broadcast(files), "bucket")
        .withColumn("file", (F.col("first") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("files"))).cast("int"))
        .repartitionById(max(1, firsts[-1]), "file").drop("file", "files", "first")
        .write.partitionBy("bucket").parquet(path)
    )
    index = spark.read.schema(shape).parquet(path)
    tables.release(spark, projected_path)

    items, arrow_id = block.items, to_arrow_type(id_type)

    def answers(buckets: list[int], least: np.ndarray) -> DataFrame:
        read = index.filter(F.col("bucket").isin(buckets)).select("id", "length", "terms", "impacts")
        return read.mapInArrow(
            lambda b: _answers(b, items, weight, least, top, arrow_id), f"item int, doc_id {kind}, score bigint"
        )

    first, seen = [], 0
    for r in sizes:
        if seen >= SEED_ROWS:
            break
        first.append(r["bucket"])
        seen += r["n"]
    seeds = tables.written(_leading(answers(first, np.zeros(len(items), np.int64)), top).drop("rank"), "lemp-seeds")
    # One number per item of the block.
    least = np.zeros(len(items), np.int64)
    for r in seeds.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect():
        least[r["item"]] = r["least"] if r["n"] == top else 0
    reach = [
        r["bucket"] for r in sizes[len(first) :]
        if any(len(item) and math.sqrt(len(item)) * r["top"] * _SLACK >= goal for item, goal in zip(items, least))
    ]
    found = seeds.unionByName(answers(reach, least)) if reach else seeds
    named = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type)])
    names = spark.createDataFrame(list(enumerate(block.ids)), named)
    return _leading(found, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case.
    Every document becomes a vector of weighted impacts over the items' terms, written by
    bucket of its length, longest first. The first buckets give each item a threshold;
    of the others only those are read whose length can reach one, and inside them bounds
    by coordinates choose the vectors whose whole numbers are added up. Nothing is cut:
    a document left out cannot be among the best.

    Equal scores are ranked by id, null ids last. Null texts have no terms. Each row of
    ``items`` is answered by itself, also if its id repeats or is null; items without
    terms have no rows, and neither has an empty table. Rows of ``docs`` with the same id
    are ranked one by one. Other columns are not looked at. Items are taken in blocks of
    at most ``BLOCK_ITEMS``; only their texts and a number per item, term or bucket reach
    the driver.
    """
    spark = tables.ready(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_type = items.schema[item_col].dataType
    found = None
    for block in blocks(items, item_col, item_text):
        part = _search_block(rows, block, top, item_type)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], T.StructType([
            T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", rows.schema["id"].dataType), T.StructField("score", T.LongType()),
        ]))
    return found

"""Near duplicates by SimHash: positional byte index, count filter, exact bit distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rowmend.llm import tables
from rowmend.llm.components import components
from rowmend.llm.text import pieces

# Fixed value: the seed of the shingle hashes.
SEED = 42
LIST_LIMIT = 24
BYTES, BLOCKS = 8, 4


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashed = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], "<u8")
    bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashed)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, print)`` per row; the 64 bits as a signed bigint. Null and blank texts have 0."""
    tables.ready(docs)

    def work(batches):
        for batch in pieces(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("id"), pa.array(found.view(np.int64))], ["id", "print"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, print bigint")


def shared_bytes(a: Column, b: Column) -> Column:
    """At how many of the eight positions two fingerprints have the same byte."""
    differing = a.bitwiseXOR(b)
    return sum(
        F.when(F.shiftrightunsigned(differing, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(BYTES)
    )


def _postings(prints: DataFrame) -> DataFrame:
    """``(list, value, print)``: every fingerprint under each pair of its two-byte blocks.

    At most two bits differ, so at most two bytes do, so two of the four blocks are whole:
    a linked pair meets in at least one of the six lists of four positional bytes.
    """
    block = [F.shiftrightunsigned("print", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(BLOCKS)]
    keys = [
        F.struct(F.lit(n).alias("list"), (F.shiftleft(block[i], 16).bitwiseOR(block[j])).alias("value"))
        for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    return prints.select("print", F.explode(F.array(*keys)).alias("key")).select("key.*", "print")


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(a, b)`` fingerprints that join everything within ``max_bits`` (at most 2) of each other.

    Short index lists are joined with themselves: the shared positional bytes of a pair
    are tallied, pairs below the guaranteed minimum of 8 - ``max_bits`` go, the rest is
    verified by bit distance. Lists longer than ``LIST_LIMIT`` would give quadratically
    many pairs; their fingerprints are written under themselves and each number one bit
    away instead. Two of them meet under a number exactly if at most two bits differ,
    and at most 65 meet there, so linking them to the smallest is complete and linear.
    """
    if max_bits not in (1, 2):
        raise ValueError("the index guarantees pairs of at most two differing bits")
    posted = _postings(prints)
    sizes = posted.groupBy("list", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = tables.written(posted.join(sizes, ["list", "value"]), "simhash-postings")
    short = shared.filter(F.col("n") <= LIST_LIMIT)
    pairs = (
        short.select("list", "value", F.col("print").alias("a"))
        .join(short.select("list", "value", F.col("print").alias("b")), ["list", "value"])
        .filter("a < b")
    )
    near = pairs.filter(shared_bytes(F.col("a"), F.col("b")) >= BYTES - max_bits).filter(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    ).select("a", "b")
    crowded = shared.filter(F.col("n") > LIST_LIMIT).select("print").distinct()
    # For one bit: the number with a bit cleared, told apart by the bit, so at most two meet.
    center = (
        [F.col("print").bitwiseXOR(F.lit(_bit(i))) for i in range(64)] if max_bits == 2
        else [F.struct(F.lit(i), F.col("print").bitwiseAND(F.lit(~_bit(i)))) for i in range(64)]
    )
    if max_bits == 2:
        center.append(F.col("print"))
    starred = (
        crowded.select("print", F.explode(F.array(*center)).alias("center"))
        .groupBy("center").agg(F.collect_set("print").alias("prints")).filter(F.size("prints") > 1)
        .select(F.array_min("prints").alias("a"), F.explode("prints").alias("b")).filter("a < b")
    )
    return near.unionByName(starred).distinct()


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64 if i == 63 else 0)


def near_groups(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, print, component_id)``: the smallest id reachable over links, one row per input row.

    Equal fingerprints are one node, however many rows have them; rows with null or blank
    texts share fingerprint 0. Null ids are members but never the smallest id, unless
    they are alone. An empty table gives an empty result.
    """
    prints = tables.written(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    nodes = tables.written(prints.groupBy("print").agg(F.min("id").alias("first")), "simhash-nodes")
    linked = components(tables.written(links(nodes.select("print"), max_bits), "simhash-links"))
    labelled = nodes.join(linked.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first", F.coalesce("label", "print").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    known = tables.written(labelled.join(smallest, "label").select("print", "component_id"), "simhash-components")
    return prints.join(known, "print").select("id", "print", "component_id")


def as_hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def keep_smallest(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per group: the one with the smallest id, all columns as they were.

    Of rows that share that id one stays. Rows with a null id stay, as nothing names them.
    """
    numbered = tables.numbered(docs, "simhash-rows")
    flat = numbered.select(
        F.struct(F.col(f"whole.{id_col}").alias("id"), "row").alias("key"), F.col(f"whole.{text_col}").alias("text"),
        F.col(f"whole.{id_col}").isNull().alias("nameless"), "row",
    )
    groups = near_groups(flat.filter(~F.col("nameless")).select("key", "text"), shingle, max_bits, "key", "text")
    dropped = groups.filter(F.col("id") != F.col("component_id")).select(F.col("id.row").alias("row"))
    return tables.without(numbered, tables.written(dropped, "simhash-dropped"))

"""Document fingerprints from spot signatures: content words that follow common words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowmend.llm import tables
from rowmend.llm.text import ALPHANUMERIC, LOWER, flat, hashes, mix, per_text, pieces, spans

CHAIN = 2
SAMPLE_ROWS = 20_000
# Bytes of text in a range of ids.
RANGE_BYTES = 32 << 20

# Common words of English, French, German and Spanish that anchor signatures.
ANCHORS = (
    "a an and are as at be but by for from had has have he in is it not of on or she that the this to was were with "
    "au aux ce de des du elle en est et il la le les ne ou par pas pour que qui sur un une "
    "auf das dem den der die ein eine für ist mit nicht sich und von zu "
    "como con del el es las los más no para por se su y"
).split()


def _anchor_hashes() -> np.ndarray:
    data, offsets = flat(pa.array([" ".join(ANCHORS)]))
    starts, ends, _ = spans(data, offsets, ALPHANUMERIC)
    return np.unique(hashes(data, starts, ends))


_COMMON = _anchor_hashes()


def signature_sets(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """Sorted distinct signatures of each text.

    A signature is a common word and the next ``chain`` content words after it. A text
    without any is one signature of all its words in order, so equal texts agree.
    """
    n = len(texts)
    data, offsets = flat(texts)
    low = LOWER[data]
    starts, ends, doc = spans(low, offsets, ALPHANUMERIC)
    hashed = hashes(low, starts, ends)
    slot = np.minimum(np.searchsorted(_COMMON, hashed), len(_COMMON) - 1)
    common = _COMMON[slot] == hashed
    content = np.flatnonzero(~common)
    anchors = np.flatnonzero(common)
    # The first content word after an anchor is as far as content words before it.
    after = np.searchsorted(content, anchors)
    fits = after + chain - 1 < len(content)
    anchors, after = anchors[fits], after[fits]
    if len(anchors):
        fits = doc[content[after + chain - 1]] == doc[anchors]
        anchors, after = anchors[fits], after[fits]
    found = hashed[anchors]
    for j in range(chain):
        found = mix(found * np.uint64(0x100000001B3) + hashed[content[after + j]] if len(after) else found)
    bounds, words = per_text(doc[anchors] if len(anchors) else np.empty(0, np.int64), n), per_text(doc, n)
    out = []
    for i in range(n):
        own = np.unique(found[bounds[i] : bounds[i + 1]])
        if not len(own):
            whole = hashed[words[i] : words[i + 1]]
            raw = whole.tobytes() if len(whole) else low[offsets[i] : offsets[i + 1]].tobytes()
            own = np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64)
        out.append(own)
    return out


def fingerprint_of(signatures: np.ndarray) -> str:
    """32 hex digits that stand for the set."""
    return hashlib.blake2b(signatures.astype("<u8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets, or 0 as soon as it cannot reach ``least``.

    The smaller over the larger size bounds it from above, before any element is read.
    """
    small, large = sorted((len(a), len(b)))
    if not large or small < least * large:
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    found = shared / (small + large - shared)
    return found if found >= least else 0.0


def length_class(size: int, least: float) -> int:
    """Number of the partition of set lengths: sets that can reach ``least`` are in one class or adjoining ones."""
    return int(np.floor(np.log(max(size, 1)) / -np.log(least) + 1e-9))


def _cuts(rows_of: dict, n: int) -> list:
    """At most ``n - 1`` ids that cut the rows into ``n`` about equal parts."""
    ids = sorted(rows_of)
    upto = np.cumsum([rows_of[i] for i in ids])
    return sorted({ids[np.searchsorted(upto, upto[-1] * i // n, side="right")] for i in range(1, n)}) if ids else []


def _ordered_with_next(rows: DataFrame) -> DataFrame:
    """Rows dealt into ranges of descending ids, each range closed by the row that follows it.

    ``(range, helper, id, tie, text)``; the helper row is a copy of the next range's first
    row, and of the very first row for the last range. Ids cut the ranges, so one
    shuffle of the texts is enough; the driver sees a bound and a largest id per range,
    and a sample of the ids with their rows, of some ``SAMPLE_ROWS`` from all tasks together.
    There are as many ranges as the bytes of the texts ask for.
    """
    spark = rows.sparkSession
    size = rows.agg(F.count("id").alias("ids"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(tables.tasks(spark), -(-(size["bytes"] or 0) // RANGE_BYTES))
    picked = rows.filter(F.col("id").isNotNull() & tables.hash_below(F.xxhash64("id"), SAMPLE_ROWS, size["ids"]))
    cuts = _cuts({r["id"]: r["n"] for r in picked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}, n)

    def place(ids: pa.Array) -> pa.Array:
        # Null ids come last.
        values = ids.to_pylist()
        known = np.array([v for v in values if v is not None])
        found = iter((len(cuts) - np.searchsorted(cuts, known, side="right")).tolist() if len(known) else [])
        return pa.array([len(cuts) + 1 if v is None else next(found) for v in values], pa.int32())

    ranged = F.arrow_udf(place, "int")
    heads = (
        rows.select("id").withColumn("range", ranged("id")).groupBy("range").agg(F.max("id").alias("top")).orderBy("range").collect()
    )
    before = [(heads[i]["range"], heads[i - 1]["range"], heads[i]["top"]) for i in range(len(heads))]
    kind = rows.schema["id"].dataType.simpleString()
    sent = spark.createDataFrame(before, f"range int, target int, top {kind}")
    dealt = rows.withColumn("range", ranged("id")).join(F.broadcast(sent), "range", "left")
    copies = F.filter(
        F.array(
            F.struct(F.col("range"), F.lit(False).alias("helper")),
            F.when(F.col("id").eqNullSafe(F.col("top")), F.struct(F.col("target").alias("range"), F.lit(True).alias("helper"))),
        ),
        lambda c: c.isNotNull(),
    )
    out = dealt.select("id", "tie", "text", F.explode(copies).alias("copy")).select("copy.*", "id", "tie", "text")
    return out.repartitionById(len(cuts) + 2, "range").sortWithinPartitions("range", "helper", F.col("id").desc_nulls_last(), "tie")


def edited_likeness(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    The edited text ends with the beginning of the next document in descending id (the
    first one's after the last): the last third of the characters is replaced by as
    many, or all, of it. Null texts are empty, null ids come last; rows with equal ids are in
    the order of their texts' hashes. Two sets without signatures are compared by all
    their words. An empty table gives an empty result.
    """
    tables.ready(docs)
    rows = docs.select(F.col(id_col).alias("id"), tables.text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def results(ids: list, texts: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        edited = []
        for own, other in zip(texts, texts[1:]):
            cut = len(own) // 3
            edited.append(own[: len(own) - cut] + other[:cut])
        sets = signature_sets(pa.array(texts, pa.string()))
        changed = signature_sets(pa.array(edited, pa.string()))
        return pa.record_batch(
            [
                pa.array(ids, id_type), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([fingerprint_of(s) for s in sets[:-1]], pa.string()),
                pa.array([fingerprint_of(s) for s in changed], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(sets, changed)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(sets, sets[1:])], pa.float64()),
                pa.array([len(s) for s in sets[:-1]], pa.int64()),
                pa.array([length_class(len(s), least) for s in sets[:-1]], pa.int32()),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "n_signatures", "length_class"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, closed = None, None, False
        for batch in pieces(batches, "text"):
            ranges, helper = batch.column("range").to_pylist(), batch.column("helper").to_pylist()
            id_list, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            ids, run = ([held[0]], [held[1]]) if held else ([], [])
            for i, at in enumerate(ranges):
                if at != current:
                    if len(run) > 1:
                        yield results(ids[:-1], run, batch.column("id").type)
                    current, closed, ids, run = at, False, [], []
                if not closed:
                    ids.append(id_list[i])
                    run.append(texts[i])
                    closed = helper[i]
            if len(run) > 1:
                yield results(ids[:-1], run, batch.column("id").type)
            held = (ids[-1], run[-1]) if run and not closed else None

    return _ordered_with_next(rows).mapInArrow(
        work,
        f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_signatures bigint, length_class int",
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, signatures)`` of every row."""
    tables.ready(docs)
    rows = docs.select(F.col(id_col).alias("id"), tables.text_or_empty(text_col).alias("text"))

    def work(batches):
        for batch in pieces(batches, "text"):
            sets = signature_sets(batch.column("text"))
            yield pa.record_batch(
                [batch.column("id"), pa.array([fingerprint_of(s) for s in sets], pa.string()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["id", "fingerprint", "signatures"],
            )

    return rows.mapInArrow(
        work, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string, signatures array<bigint>"
    )


def near_pairs(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, likeness)`` of different signature sets, and ``(id, fingerprint)`` as membership.

    Sets are partitioned by length: a set is compared within its class and with the class
    below. Signatures are ordered from rare to frequent; two sets that reach ``least`` share
    one among the first ``size - ceil(least * size) + 1`` of each, so only those are
    joined. Pairs whose sizes rule ``least`` out go before their sets are read.
    """
    prints = tables.written(fingerprints(docs, id_col, text_col), "spotsigs-prints")
    sets = prints.groupBy("fingerprint").agg(F.first("signatures").alias("signatures"))
    flat_sets = sets.select("fingerprint", F.size("signatures").alias("size"), F.explode("signatures").alias("signature"))
    often = flat_sets.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    prefix = (F.col("size") - F.ceil(F.col("size") * F.lit(least)) + 1).cast("int")
    ordered = flat_sets.join(often, "signature").groupBy("fingerprint", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "signature"))).alias("ranked")
    )
    step = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(-np.log(least))) + F.lit(1e-9)).cast("int")
    posted = tables.written(
        ordered.select("fingerprint", "size", step.alias("class"), F.explode(F.slice("ranked.signature", F.lit(1), prefix)).alias("signature")),
        "spotsigs-postings",
    )
    left = posted.select(F.col("fingerprint").alias("a"), F.col("size").alias("size_a"), "signature", "class")
    right = posted.select(
        F.col("fingerprint").alias("b"), F.col("size").alias("size_b"), "signature",
        F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"),
    )
    able = (
        left.join(right, ["signature", "class"])
        .filter((F.col("a") != F.col("b")) & (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * least))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    own = sets.select(F.col("fingerprint"), "signatures")
    both = able.join(own.withColumnsRenamed({"fingerprint": "a", "signatures": "x"}), "a").join(
        own.withColumnsRenamed({"fingerprint": "b", "signatures": "y"}), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    jaccard = shared / (F.size("x") + F.size("y") - shared)
    pairs = both.select("a", "b", jaccard.alias("likeness")).filter(F.col("likeness") >= least)
    return pairs, prints.select("id", "fingerprint")

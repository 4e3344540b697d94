"""A factorisation machine over hashed words and structure statistics that scores text quality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowmend.llm import tables
from rowmend.llm.text import LOWER, NOT_SPACE, byte_table, flat, hashes, per_text, pieces, spans

WORD_BITS = 14
RANK = 8
SAMPLE_ROWS = 6_000
EPOCHS = 12
BATCH = 128
RATE = 0.05
PENALTY = 1e-5

_CLASSES = [
    byte_table(lambda b: 0x41 <= b <= 0x5A), byte_table(lambda b: 0x61 <= b <= 0x7A),
    byte_table(lambda b: 0x30 <= b <= 0x39), byte_table(lambda b: b >= 0x80), byte_table(lambda b: b == 0x0A),
    byte_table(lambda b: b in b".?"), byte_table(lambda b: b in b",;:"), byte_table(lambda b: b == 0x21),
    byte_table(lambda b: b in b"|<>{}[]=_\\/@"), byte_table(lambda b: b in b"#$%&*+^~"),
]
STATS = len(_CLASSES) + 6
_LINE = byte_table(lambda b: b != 0x0A)


def features(texts: pa.Array, meta: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bounds, columns, values, stats)``: sparse hashed words per text, and dense statistics.

    Word counts have length one per text. Statistics are shares of kinds of bytes, mean
    word length, shares of different words and lines, lengths and the metadata number.
    Empty texts have no words and zeros.
    """
    n = len(texts)
    data, offsets = flat(texts)
    starts, ends, doc = spans(data, offsets, NOT_SPACE)
    hashed = hashes(LOWER[data], starts, ends) if len(data) else np.empty(0, np.uint64)
    words = np.bincount(doc, minlength=n)
    key, count = np.unique(
        doc.astype(np.uint64) << np.uint64(WORD_BITS) | hashed >> np.uint64(64 - WORD_BITS), return_counts=True
    )
    owner = (key >> np.uint64(WORD_BITS)).astype(np.int64)
    norm = np.sqrt(np.bincount(owner, count.astype(float) ** 2, n))
    values = count / norm[owner]
    columns = (key & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)

    size = np.diff(offsets)
    per_byte = 1.0 / np.maximum(size, 1)
    stats = np.zeros((n, STATS))
    for j, table in enumerate(_CLASSES):
        inside = np.concatenate(([0], np.cumsum(table[data])))
        stats[:, j] = (inside[offsets[1:]] - inside[offsets[:-1]]) * per_byte
    k = len(_CLASSES)
    per_word = 1.0 / np.maximum(words, 1)
    stats[:, k] = np.bincount(doc, ends - starts, n) * per_word
    stats[:, k + 1] = np.bincount(owner, minlength=n) * per_word
    a, b, line_doc = spans(data, offsets, _LINE)
    lines = np.bincount(line_doc, minlength=n)
    line_key = np.unique(hashes(data, a, b) ^ (line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    stats[:, k + 2] = np.bincount(line_doc[line_key], minlength=n) / np.maximum(lines, 1)
    stats[:, k + 3] = np.log1p(words)
    stats[:, k + 4] = np.log1p(lines)
    stats[:, k + 5] = np.log1p(np.maximum(meta, 0)) if meta is not None else np.log1p(size)
    return per_text(owner, n), columns, values, stats


@dataclass
class Machine:
    """Weights of hashed words, then of statistics; ``factors`` has a row per feature."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def design(self, bounds, columns, values, stats):
        """All features as one sparse block; statistics are standardised and follow the words."""
        n = len(stats)
        dense = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(STATS)
        owner = np.concatenate([np.repeat(np.arange(n), np.diff(bounds)), np.repeat(np.arange(n), STATS)])
        column = np.concatenate([columns, np.tile((1 << WORD_BITS) + np.arange(STATS), n)])
        return n, owner, column, np.concatenate([values, dense.reshape(-1)])

    def margins(self, n, owner, column, value):
        """Scores before the sigmoid, in time linear in the features.

        All pairwise terms of one factor are half of (sum of terms) squared minus the
        sum of squared terms.
        """
        out = self.bias + np.bincount(owner, self.linear[column] * value, n)
        sums = np.empty((RANK, n))
        for f in range(RANK):
            term = self.factors[column, f] * value
            sums[f] = np.bincount(owner, term, n)
            out += 0.5 * (sums[f] ** 2 - np.bincount(owner, term * term, n))
        return out, sums

    def score(self, texts: pa.Array, meta: np.ndarray | None) -> np.ndarray:
        margin, _ = self.margins(*self.design(*features(texts, meta)))
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def fit(bounds: np.ndarray, columns: np.ndarray, values: np.ndarray, stats: np.ndarray, labels: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad on batches; without both classes the bias alone says how likely 1 is."""
    rng = np.random.default_rng(seed)
    total = (1 << WORD_BITS) + STATS
    rate = (labels.sum() + 1.0) / (len(labels) + 2.0)
    mean = stats.mean(axis=0) if len(stats) else np.zeros(STATS)
    scale = np.maximum(stats.std(axis=0), 1e-3) if len(stats) else np.ones(STATS)
    machine = Machine(float(np.log(rate / (1 - rate))), np.zeros(total), rng.normal(0, 0.05, (total, RANK)), mean, scale)
    if not 0 < labels.sum() < len(labels):
        machine.factors[:] = 0
        return machine
    seen_linear, seen_factors, seen_bias = np.full(total, 1e-4), np.full((total, RANK), 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            size = bounds[rows + 1] - bounds[rows]
            inside = np.repeat(bounds[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            local = np.concatenate(([0], np.cumsum(size)))
            n, owner, column, value = machine.design(local, columns[inside], values[inside], stats[rows])
            margin, sums = machine.margins(n, owner, column, value)
            error = (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / n
            used, place = np.unique(column, return_inverse=True)
            weight = error[owner] * value
            gradient = np.bincount(place, weight) + PENALTY * machine.linear[used]
            seen_linear[used] += gradient**2
            machine.linear[used] -= RATE * gradient / np.sqrt(seen_linear[used])
            for f in range(RANK):
                own = machine.factors[column, f]
                gradient = np.bincount(place, weight * (sums[f][owner] - own * value)) + PENALTY * machine.factors[used, f]
                seen_factors[used, f] += gradient**2
                machine.factors[used, f] -= RATE * gradient / np.sqrt(seen_factors[used, f])
            step = error.sum()
            seen_bias += step**2
            machine.bias -= RATE * step / np.sqrt(seen_bias)
    return machine


def fit_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality",
    id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars", sample_rows: int = SAMPLE_ROWS,
) -> Machine:
    """Fit on at most ``sample_rows`` labelled rows that ``learn`` (over the id) admits.

    The sample is the rows with the smallest hash of the id, so it does not depend on the
    order of the table. It is joined as a broadcast of that bounded size; words are
    hashed in the tasks, and the driver gets the sparse features of the sample only.
    """
    tables.ready(docs)
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter(learn & F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    )
    rows = _rows(docs, id_col, text_col, meta_col).join(F.broadcast(chosen), "id")

    def work(batches):
        for batch in pieces(batches, "text"):
            bounds, columns, values, stats = features(batch.column("text"), _numbers(batch, meta_col))
            split = pa.array(bounds, pa.int32())
            yield pa.record_batch(
                [batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(split, pa.array(columns, pa.int32())),
                 pa.ListArray.from_arrays(split, pa.array(values)), pa.array(stats.tolist(), pa.list_(pa.float64()))],
                ["id", "label", "columns", "values", "stats"],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(
        work, f"id {id_type}, label int, columns array<int>, values array<double>, stats array<double>"
    ).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    if not found.num_rows:
        return fit(np.zeros(1, np.int64), *np.empty((2, 0)), np.empty((0, STATS)), np.empty(0))
    columns, values = (found.column(c).combine_chunks() for c in ("columns", "values"))
    return fit(
        columns.offsets.to_numpy().astype(np.int64) - columns.offsets[0].as_py(), columns.flatten().to_numpy().astype(np.int64),
        values.flatten().to_numpy(), np.array(found.column("stats").to_pylist()), found.column("label").to_numpy().astype(float),
    )


def _rows(docs: DataFrame, id_col: str, text_col: str, meta_col: str | None) -> DataFrame:
    meta = F.col(meta_col).cast("double") if meta_col else F.lit(None).cast("double")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), meta.alias("meta"))


def _numbers(batch: pa.RecordBatch, meta_col: str | None) -> np.ndarray | None:
    return np.nan_to_num(batch.column("meta").to_numpy(zero_copy_only=False).astype(float)) if meta_col else None


def with_score(docs: DataFrame, machine: Machine, name: str, text_col: str = "text", meta_col: str | None = "n_chars") -> DataFrame:
    """Add the probability of label 1 as ``name``; null texts count as empty. No shuffle.

    The model is of fixed size (features times rank) and travels as a broadcast variable.
    """
    spark = tables.ready(docs)
    shared = spark.sparkContext.broadcast(machine)

    def work(texts: pa.Array, meta: pa.Array) -> pa.Array:
        batch = pa.record_batch([texts, meta], ["text", "meta"])
        found = [shared.value.score(p.column("text"), _numbers(p, meta_col)) for p in pieces([batch], "text")]
        return pa.array(np.concatenate(found) if found else np.empty(0))

    meta = F.col(meta_col).cast("double") if meta_col else F.lit(None).cast("double")
    score = F.arrow_udf(work, "double")
    return docs.withColumn(name, score(F.col(text_col).cast("string"), meta))

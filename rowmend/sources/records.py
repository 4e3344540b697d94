"""Records of CSV files whose quoted fields may hold line breaks, read by many tasks per file.

A line that starts in the middle of a file may start a record or lie inside a quoted
field. Each range of a file is therefore reduced to what it does to either state; put
together along the file, these give the state every range starts in, and the ranges
can then be cut into records side by side. Only the pieces of a record that crosses
the end of its range are brought together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowmend import shipping

# A field is quoted if a quote comes first; quotes elsewhere in a plain field are text. What
# follows a closing quote up to the delimiter belongs to the field.
_CLOSED = r'"(?:[^"]++|"")*+"[^,]*+'
_OPENED = re.compile(rf'(?:(?:{_CLOSED}|(?!")[^,]*+),)*+"(?:[^"]++|"")*+\Z')
_CLOSING = re.compile(r'(?:[^"]++|"")*+"[^,]*+')

WHOLE, BEGUN, CONTINUED = 0, 1, 2
HEADER = -1
_END = (1 << 63) - 1


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that starts inside one, or not."""
    if inside:
        closing = _CLOSING.match(line)
        if closing is None:
            return True
        if closing.end() == len(line):
            return False
        line = line[closing.end() + 1 :]
    return _OPENED.match(line) is not None


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(line, file, start)``: lines without their feed, and the range of the file they are in."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: the state at its end from either state, and whether lines and records differ in it."""
    found: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for line, file, start in zip(*(c.to_pylist() for c in batch.columns)):
            state = found.setdefault((file, start), [False, True, False])
            # Once both states have led to the same one they stay together.
            same = state[0] == state[1]
            state[0] = open_after(line, state[0])
            state[1] = state[0] if same else open_after(line, state[1])
            state[2] |= state[0] or "\r" in line[:-1]
    rows = list(zip(*[(*key, *state) for key, state in found.items()])) or [[]] * 5
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    yield pa.record_batch([pa.array(r, t) for r, t in zip(rows, types)], ["file", "start", "from_outside", "from_inside", "broken"])


def open_spans(text: DataFrame) -> tuple[list[tuple[str, int, int]], set[str]]:
    """Where fields are open across ranges, and the files with line breaks or returns in fields.

    A span ``(file, after, upto)`` says that ranges that start after ``after`` and not
    beyond ``upto`` start inside a field. Lines without a quote or a return change nothing
    and stay in the JVM. One row per range that has some reaches the driver, so at most
    one per split of a file.
    """
    effects = text.filter(F.col("line").contains('"') | F.col("line").rlike("\\r(?!$)")).mapInArrow(
        _effects, "file string, start bigint, from_outside boolean, from_inside boolean, broken boolean"
    ).orderBy("file", "start").collect()
    spans, broken, file, opened = [], set(), None, None
    for row in [*effects, None]:
        if row is None or row["file"] != file:
            if opened is not None:
                spans.append((file, opened, _END))
            opened = None
            if row is None:
                break
            file = row["file"]
        if opened is not None:
            spans.append((file, opened, row["start"]))
        if row["broken"] or opened is not None:
            broken.add(file)
        inside = row["from_outside"] if opened is None else row["from_inside"]
        opened = row["start"] if inside else None
    return spans, broken


class _Stitcher:
    """Cuts the lines of one range after the other into records."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.inside = self.head = False
        self.header = False
        self.parts: list[str] = []
        self.seq = 0

    def begin(self, key: tuple, inside: bool) -> list[tuple]:
        out = self.end()
        self.key, self.inside, self.head, self.parts, self.seq = key, inside, inside, [], 0
        self.header = key[1] == 0
        return out

    def _number(self) -> int:
        """Place among the records of several lines; the header has a place of its own."""
        self.seq += 1
        return HEADER if self.header else self.seq

    def end(self) -> list[tuple]:
        """What is left open where the range ends."""
        if not self.parts:
            return []
        return [("\n".join(self.parts), self.key, self._number(), CONTINUED if self.head else BEGUN)]

    def take(self, texts: pa.Array) -> tuple[pa.Array, list[tuple]]:
        """Records that are one line each, and the others."""
        quoted = np.flatnonzero(pc.match_substring(texts, '"').to_numpy(zero_copy_only=False))
        plain = pc.invert(pc.is_in(texts, pa.array(["", "\r"]))).to_numpy(zero_copy_only=False).copy()
        out, at = [], 0
        for i in [*quoted.tolist(), len(texts)]:
            if self.inside:
                plain[at:i] = False
                self.parts += texts.slice(at, i - at).to_pylist()
            elif self.header and plain[at:i].any():
                plain[at + int(plain[at:i].argmax())] = self.header = False
            at = i + 1
            if i == len(texts):
                break
            line = texts[i].as_py()
            before, self.inside = self.inside, open_after(line, self.inside)
            if before or self.inside:
                plain[i] = False
                self.parts.append(line)
                if not self.inside:
                    out.append(("\n".join(self.parts), self.key, self._number(), CONTINUED if self.head else WHOLE))
                    self.parts, self.head, self.header = [], False, False
            elif self.header:
                plain[i] = self.header = False
        return texts.filter(pa.array(plain)), out


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record", "file", "start", "seq", "kind"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = [[r[0] for r in found], [r[1][0] for r in found], [r[1][1] for r in found], [r[2] for r in found], [r[3] for r in found]]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    stitcher = _Stitcher()
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column("start").to_numpy()
        file = batch.column("file").dictionary_encode()
        codes = file.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(start) != 0) | (np.diff(codes) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = (file.dictionary[int(codes[a])].as_py(), int(start[a]))
            found = stitcher.begin(key, bool(batch.column("inside")[a].as_py())) if key != stitcher.key else []
            single, others = stitcher.take(batch.column("line").slice(a, b - a))
            n = len(single)
            yield pa.record_batch(
                [single, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, WHOLE, np.int32))], names
            )
            if found or others:
                yield rows(found + others)
    if rest := stitcher.end():
        yield rows(rest)


def records(text: DataFrame, spans: list[tuple[str, int, int]], files: list[tuple[str, bool]]) -> DataFrame:
    """``(record)``: one row per record of ``files`` but their first ones, line breaks in fields kept.

    ``files`` says of each whether its lines end in a return too, which is taken off. With
    ``spans`` from ``open_spans`` of the same ``text`` every range knows how it starts.
    Pieces of records that cross a range, one or two per range, are joined per record.
    """
    spark = text.sparkSession
    shipping.ship_package(spark)
    chosen = spark.createDataFrame(files, "file string, returns boolean")
    marks = spark.createDataFrame([(*s, True) for s in spans], "open_file string, after bigint, upto bigint, inside boolean")
    line = F.when(F.col("returns"), F.regexp_replace("line", "\\r$", "")).otherwise(F.col("line"))
    # Joined, not filtered, by file: a filter could change how the files are cut into ranges.
    marked = text.join(F.broadcast(chosen), "file").join(
        F.broadcast(marks),
        (F.col("file") == F.col("open_file")) & (F.col("start") > F.col("after")) & (F.col("start") <= F.col("upto")), "left",
    ).select(line.alias("line"), "file", "start", F.coalesce("inside", F.lit(False)).alias("inside"))
    cut = marked.mapInArrow(_stitched, "record string, file string, start bigint, seq bigint, kind int")
    whole = cut.filter((F.col("kind") == WHOLE) & (F.coalesce("seq", F.lit(0)) != HEADER)).select("record")
    along = Window.partitionBy("file").orderBy("start", "seq")
    pieces = cut.filter(F.col("kind") != WHOLE).withColumn("number", F.count(F.when(F.col("kind") == BEGUN, 1)).over(along))
    joined = pieces.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("start", "seq", "record"))).alias("parts"))
    joined = joined.filter(F.col("parts")[0]["seq"] != HEADER)
    return whole.unionByName(joined.select(F.array_join("parts.record", "\n").alias("record")))

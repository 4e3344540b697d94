"""Exact k-nearest-neighbour join under a mixed-type distance, without comparing all pairs.

The pool is cut into cells: combinations of discrete values and numeric bins. Each
cell keeps the box of its rows, so the distance from a query to anything inside has
a lower bound. The join then runs in two steps:

1. every query meets one block of a promising cell, which gives the distance of a
   k-th neighbour, an upper limit for the true one;
2. the query is sent to the cells whose lower bound does not exceed that limit, and
   to no others; what the blocks return is merged with a per-query top-k.

Both steps are equi-joins on the block between packed query rows and packed pool rows.
Blocks have a bounded number of rows, however many rows a cell has: a cell holding a
third of the pool is many blocks with keys of their own. Pool rows with equal features are reduced to the k
smallest keys beforehand, because ties are broken by the key and no further copy can
ever be among the k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rowmend import errors, parallel, shipping, storage
from rowmend.functions.kinds import Feature

MAX_CELLS = 32_768
BLOCK_ROWS = 8_192
BROADCAST_BYTES = 64 << 20
HOT_QUERIES = 500
SALTS = 64
# A block with more than this part of a task's queries is salted.
SHARES = 4
CELL_PARTS = 64
PART_SHIFT = 24
VALUE_LIMIT = 64
NUMERIC_BINS = 16
SAMPLE_ROWS = 200_000
# Queries of one cell are dealt to so many tasks when their home is chosen.
HOME_SALTS = 4
# Visits a task collects before it packs them by block, and the most in one packed row.
VISIT_ROWS = 1 << 19
PACK_ROWS = 4_096
_TILE = 1 << 19


@dataclass(frozen=True)
class _Split:
    """How one feature takes part in the cell number.

    The last two buckets are for values not listed and for null, so every row has a
    bucket although the lists come from a sample.
    """

    name: str
    values: tuple[Any, ...] | None
    hashed: bool
    edges: tuple[float, ...]

    @property
    def size(self) -> int:
        if self.values is not None:
            return len(self.values) + 2
        return (VALUE_LIMIT if self.hashed else len(self.edges) + 1) + 2


@dataclass(frozen=True)
class NeighbourIndex:
    features: tuple[Feature, ...]
    id_column: str
    k: int
    stretch: bool
    ranges: dict[str, tuple[float, float]]
    splits: tuple[_Split, ...]
    blocks: DataFrame
    cells: dict[str, np.ndarray]

    @property
    def size(self) -> int:
        """Bytes of all packed rows: eight per number, and the length of every text."""
        rows = int(self.cells["n"].sum())
        return rows * 8 * (len(self.features) + 1) + int(self.cells["text"].sum())


def _clean(df: DataFrame, features: tuple[Feature, ...]) -> list[Column]:
    """Feature columns with NaN and infinities turned into null, types kept."""
    columns = []
    for f in features:
        if isinstance(df.schema[f.name].dataType, (T.FloatType, T.DoubleType)):
            columns.append(F.when(F.abs(f.name) < float("inf"), F.col(f.name)).alias(f.name))
        else:
            columns.append(F.col(f.name))
    return columns


def _bucket(split: _Split, dtype: T.DataType) -> Column:
    column = F.col(split.name)
    if split.values is not None:
        known = F.array(*[F.lit(v).cast(dtype) for v in split.values])
        place = F.array_position(known, column).cast("int")
        code = F.when(place > 0, place - 1).otherwise(split.size - 2)
    elif split.hashed:
        code = F.pmod(F.xxhash64(column), F.lit(VALUE_LIMIT)).cast("int")
    else:
        code = sum(
            (F.when(column >= F.lit(edge), 1).otherwise(0) for edge in split.edges), F.lit(0)
        ).cast("int")
    return F.when(column.isNull(), F.lit(split.size - 1)).otherwise(code)


def _plan_splits(
    pool: DataFrame, features: tuple[Feature, ...], rows_per_cell: int
) -> tuple[tuple[_Split, ...], float]:
    """Choose splits on a bounded sample, the feature that separates most first.

    Any choice gives the same join result; the sample only decides how much is skipped.
    Also returns the share of distinct feature rows in the sample.
    """
    rows = pool.count()
    if rows == 0:
        raise errors.DataError(errors.INVALID_INPUT, "the pool of healthy rows is empty")
    sample = pool.sample(min(1.0, SAMPLE_ROWS / rows), seed=42) if rows > SAMPLE_ROWS else pool
    probs = [i / NUMERIC_BINS for i in range(1, NUMERIC_BINS)]
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct(F.struct(*[f.name for f in features])).alias("distinct"),
    ]
    for i, f in enumerate(features):
        if f.discrete:
            aggregates.append(F.approx_count_distinct(f.name).alias(f"values_{i}"))
        else:
            number = F.col(f.name).cast("double")
            aggregates.append(F.percentile_approx(number, probs, 1000).alias(f"edges_{i}"))
            aggregates.append((F.max(number) - F.min(number)).alias(f"width_{i}"))
    stats = sample.agg(*aggregates).first()
    target = min(MAX_CELLS, max(1, rows // rows_per_cell))

    parts = {f.name: 1 for f in features}
    product = 1
    while True:
        best, best_gain, best_next = None, 0.0, 1
        for i, f in enumerate(features):
            if f.weight <= 0:
                continue
            if f.discrete:
                size = min(int(stats[f"values_{i}"] or 0), VALUE_LIMIT)
                if parts[f.name] > 1 or size < 2:
                    continue
                gain = f.weight * (1 - 1 / size) / np.log2(size)
            else:
                size = 2 * parts[f.name]
                width = stats[f"width_{i}"]
                if size > NUMERIC_BINS or not width:
                    continue
                gain = f.weight * min(width / max(f.scale, 1e-12), 4.0) / (2 * size)
            if product // parts[f.name] * size <= target and gain > best_gain:
                best, best_gain, best_next = f.name, gain, size
        if best is None:
            break
        product = product // parts[best] * best_next
        parts[best] = best_next

    listed = [
        f.name for i, f in enumerate(features)
        if f.discrete and parts[f.name] > 1 and stats[f"values_{i}"] < VALUE_LIMIT * 0.8
    ]
    known = {}
    if listed:
        known = sample.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in listed]).first()
    splits = []
    for i, f in enumerate(features):
        if parts[f.name] == 1:
            continue
        if f.name in listed:
            splits.append(_Split(f.name, tuple(known[f.name]), False, ()))
        elif f.discrete:
            splits.append(_Split(f.name, None, True, ()))
        else:
            step = NUMERIC_BINS // parts[f.name]
            edges = sorted({float(e) for e in stats[f"edges_{i}"][step - 1 :: step]})
            splits.append(_Split(f.name, None, False, tuple(edges)))
    return tuple(splits), int(stats["distinct"]) / max(1, int(stats["n"]))


def _cell_number(splits: tuple[_Split, ...], schema: T.StructType) -> Column:
    number = F.lit(0)
    for split in splits:
        number = number * F.lit(split.size) + _bucket(split, schema[split.name].dataType)
    return number.cast("int")


def build_index(
    pool: DataFrame,
    features: list[Feature],
    id_column: str,
    k: int,
    *,
    stretch_ranges: dict[str, tuple[float, float]] | None = None,
    rows_per_cell: int = 512,
) -> NeighbourIndex:
    """Pack the pool into blocks by cell and summarise the cells.

    With ``stretch_ranges`` numeric terms are divided by the range of pool and query
    together; otherwise by the scale of the feature.
    """
    used = tuple(features)
    spark = pool.sparkSession
    clean = pool.select(F.col(id_column), *_clean(pool, used))
    if parallel.is_small(clean):
        # The passes below then read a few spread rows and not the steps behind them.
        clean = storage.cut_lineage(parallel.spread(clean, id_column))
    splits, distinct_share = _plan_splits(clean, used, max(rows_per_cell, 4 * k))
    names = [f.name for f in used]
    placed = clean.withColumn("cell", _cell_number(splits, clean.schema))

    if distinct_share < 0.9:
        copies = Window.partitionBy(*names).orderBy(id_column)
        placed = storage.cut_lineage(
            placed.withColumn("copy", F.row_number().over(copies))
            .filter(F.col("copy") <= k)
            .drop("copy")
        )
    # A count per cell: bounded by the splits, whatever the size of the pool.
    counts = {int(r["cell"]): int(r["count"]) for r in placed.groupBy("cell").count().collect()}
    placed = _cut_large_cells(placed, used, id_column, counts)
    blocks = placed.groupBy("cell", "chunk").agg(
        F.collect_list(F.struct(F.col(id_column).alias("pool_id"), *names)).alias("pool_rows")
    )
    blocks = storage.cut_lineage(blocks)
    return NeighbourIndex(
        used, id_column, k, stretch_ranges is not None, stretch_ranges or {}, splits, blocks,
        _summarise(blocks, used, splits),
    )


def _cut_large_cells(
    placed: DataFrame, features: tuple[Feature, ...], id_column: str, counts: dict[int, int]
) -> DataFrame:
    """Add ``chunk``, which together with the cell names a block.

    A cell with more rows than a block is cut along the numeric feature that varies most
    inside it, at its own quantiles, so that a dense cell is searched in part only. What
    is still too large is divided by hash. The chunk is the part shifted left, plus the
    piece within the part.
    """
    limit = max(BLOCK_ROWS, -(-sum(counts.values()) // MAX_CELLS))
    large = {c: n for c, n in counts.items() if n > limit}
    if not large:
        return placed.withColumn("chunk", F.lit(0))
    spark = placed.sparkSession
    numeric = [f for f in features if not f.discrete and f.weight > 0]
    wanted = spark.createDataFrame([(c,) for c in large], "cell int")
    dense = placed.join(F.broadcast(wanted), "cell", "left_semi")
    cuts = []
    if numeric:
        probs = [i / CELL_PARTS for i in range(1, CELL_PARTS)]
        found = dense.groupBy("cell").agg(*[
            F.percentile_approx(F.col(f.name).cast("double"), probs, 500).alias(f"q_{i}")
            for i, f in enumerate(numeric)
        ]).collect()
        for row in found:
            parts = 1 << min(CELL_PARTS, -(-large[row["cell"]] // limit)).bit_length() - 1
            spans = [
                f.weight * (q[-3] - q[2]) / max(f.scale, 1e-12) if (q := row[f"q_{i}"]) else 0.0
                for i, f in enumerate(numeric)
            ]
            widest = int(np.argmax(spans))
            if parts > 1 and spans[widest] > 0:
                step = CELL_PARTS // parts
                edges = sorted({float(e) for e in row[f"q_{widest}"][step - 1 :: step]})
                cuts.append((row["cell"], widest, edges))
    if cuts:
        table = spark.createDataFrame(cuts, "cell int, axis int, edges array<double>")
        value = F.lit(None).cast("double")
        for i, f in enumerate(numeric):
            value = F.when(F.col("axis") == i, F.col(f.name).cast("double")).otherwise(value)
        passed = F.size(F.filter("edges", lambda edge: edge <= F.col("along")))
        part = F.when(F.col("axis").isNull(), 0).when(F.col("along").isNull(), CELL_PARTS).otherwise(passed)
        placed = (
            placed.join(F.broadcast(table), "cell", "left")
            .withColumn("along", value).withColumn("part", part)
            .drop("axis", "edges", "along")
        )
    else:
        placed = placed.withColumn("part", F.lit(0))
    sizes = placed.groupBy("cell", "part").count().filter(F.col("count") > BLOCK_ROWS).collect()
    pieces = [(r["cell"], r["part"], -(-r["count"] // BLOCK_ROWS)) for r in sizes]
    piece = F.lit(0)
    if pieces:
        table = spark.createDataFrame(pieces, "cell int, part int, pieces int")
        placed = placed.join(F.broadcast(table), ["cell", "part"], "left")
        piece = F.pmod(F.xxhash64(id_column), F.coalesce("pieces", F.lit(1))).cast("int")
    return placed.withColumn("chunk", F.shiftleft("part", PART_SHIFT) + piece).drop("part", "pieces")


def _summarise(
    blocks: DataFrame, features: tuple[Feature, ...], splits: tuple[_Split, ...]
) -> dict[str, np.ndarray]:
    """Rows, blocks, smallest block and box as arrays, one entry per cell and part."""
    measures = [
        F.sum(F.size("pool_rows")).alias("n"),
        F.min(F.size("pool_rows")).alias("smallest"),
        F.count(F.lit(1)).alias("blocks"),
        F.max("chunk").alias("last"),
    ]
    row_type = blocks.schema["pool_rows"].dataType.elementType
    texts = [f.name for f in row_type.fields if isinstance(f.dataType, T.StringType)]
    lengths = F.lit(0).cast("long")
    for name in texts:
        lengths = lengths + F.aggregate(
            F.col(f"pool_rows.{name}"), F.lit(0).cast("long"),
            lambda total, v: total + F.coalesce(F.octet_length(v), F.lit(0)),
        )
    measures.append(F.sum(lengths).alias("text"))
    numeric = [f.name for f in features if not f.discrete]
    for i, name in enumerate(numeric):
        values = F.col(f"pool_rows.{name}")
        measures += [
            F.min(F.array_min(values)).cast("double").alias(f"low_{i}"),
            F.max(F.array_max(values)).cast("double").alias(f"high_{i}"),
            F.max(F.exists(values, lambda v: v.isNull())).alias(f"null_{i}"),
        ]
    part = F.shiftright("chunk", PART_SHIFT).alias("part")
    found = blocks.groupBy("cell", part).agg(*measures).toPandas().sort_values(["cell", "part"])
    arrays = {c: found[c].to_numpy() for c in ("cell", "part", "n", "smallest", "last", "text")}
    # Hashing may leave a piece empty: then the number of blocks is less than the last one's.
    arrays["pieces"] = arrays["last"] - (arrays["part"].astype(np.int64) << PART_SHIFT) + 1
    arrays["whole"] = arrays["pieces"] == found["blocks"].to_numpy()
    for i, name in enumerate(numeric):
        arrays[f"low:{name}"] = found[f"low_{i}"].to_numpy(dtype=float)
        arrays[f"high:{name}"] = found[f"high_{i}"].to_numpy(dtype=float)
        arrays[f"null:{name}"] = found[f"null_{i}"].to_numpy(dtype=bool)
    rest = arrays["cell"].astype(np.int64)
    for split in reversed(splits):
        arrays[f"bucket:{split.name}"] = (rest % split.size).astype(np.int32)
        rest = rest // split.size
    return arrays


# --- inside tasks ---------------------------------------------------------------------


@dataclass(frozen=True)
class _Task:
    """What the batch functions need; small, shipped with the closure."""

    features: tuple[Feature, ...]
    splits: tuple[str, ...]
    stretch: bool
    ranges: dict[str, tuple[float, float]]
    k: int

    @property
    def total_weight(self) -> float:
        total = 0.0
        for f in self.features:
            if f.weight > 0:
                total += f.weight
        return total


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _divisors(task: _Task, feature: Feature, values: np.ndarray) -> np.ndarray:
    if not task.stretch:
        return np.full(len(values), max(feature.scale, 1e-12))
    low, high = task.ranges[feature.name]
    known = np.where(np.isnan(values), low, values)
    return np.maximum(known, high) - np.minimum(known, low)


def _bounds(task: _Task, cells: dict[str, np.ndarray], queries: pa.StructArray, outer: bool) -> np.ndarray:
    """Per query and cell: the smallest possible distance, or with ``outer`` the largest."""
    total = np.zeros((len(queries), len(cells["cell"])))
    for f in task.features:
        if f.weight <= 0:
            continue
        if f.discrete:
            if f.name in task.splits:
                mine = queries.field(f"bucket_{f.name}").to_numpy(zero_copy_only=False)
                total += f.weight * (mine[:, None] != cells[f"bucket:{f.name}"][None, :])
            elif outer:
                total += f.weight
            continue
        values = _numbers(queries.field(f.name))
        divisor = _divisors(task, f, values)[:, None]
        low, high = cells[f"low:{f.name}"][None, :], cells[f"high:{f.name}"][None, :]
        x = values[:, None]
        if outer:
            gap = np.fmax(np.abs(x - low), np.abs(high - x))
        else:
            gap = np.fmax(np.fmax(low - x, x - high), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            term = np.where(divisor > 0, gap / divisor, 0.0)
        nulls = cells[f"null:{f.name}"][None, :]
        limited = np.fmax(term, 1.0) if outer else np.fmin(term, 1.0)
        term = np.where(nulls, limited, term)
        # No known value on one side: the term is exactly one.
        term = np.where(np.isnan(x) | np.isnan(low), 1.0, term)
        total += f.weight * term
    return total / task.total_weight if task.total_weight > 0 else total


def _group_bounds(task: _Task, cells: dict[str, np.ndarray], queries: pa.StructArray) -> np.ndarray:
    """Per cell: a distance that none of the queries falls below, from the box of the queries."""
    total = np.zeros(len(cells["cell"]))
    for f in task.features:
        if f.weight <= 0:
            continue
        if f.discrete:
            if f.name in task.splits:
                mine = np.unique(queries.field(f"bucket_{f.name}").to_numpy(zero_copy_only=False))
                total += f.weight * ~np.isin(cells[f"bucket:{f.name}"], mine)
            continue
        values = _numbers(queries.field(f.name))
        known = values[~np.isnan(values)]
        if len(known) == 0:
            total += f.weight
            continue
        divisor = _divisors(task, f, known).max()
        low, high = cells[f"low:{f.name}"], cells[f"high:{f.name}"]
        gap = np.fmax(np.fmax(low - known.max(), known.min() - high), 0.0)
        term = gap / divisor if divisor > 0 else np.zeros(len(gap))
        limited = cells[f"null:{f.name}"] if len(known) == len(values) else np.ones(len(gap), dtype=bool)
        term = np.where(limited, np.fmin(term, 1.0), term)
        total += f.weight * np.where(np.isnan(low), 1.0, term)
    return total / task.total_weight if task.total_weight > 0 else total


def _distances(task: _Task, queries: pa.StructArray, pool: pa.StructArray) -> np.ndarray:
    total = np.zeros((len(queries), len(pool)))
    for f in task.features:
        if f.weight <= 0:
            continue
        left, right = queries.field(f.name), pool.field(f.name)
        if f.discrete:
            codes = pa.concat_arrays([left, right.cast(left.type)]).dictionary_encode().indices
            codes = codes.fill_null(-1).to_numpy(zero_copy_only=False)
            total += f.weight * (codes[: len(left), None] != codes[None, len(left) :])
            continue
        x, p = _numbers(left), _numbers(right)
        divisor = _divisors(task, f, x)
        if divisor.all():
            term = np.abs(p[None, :] - x[:, None]) / divisor[:, None]
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                term = np.abs(p[None, :] - x[:, None]) / divisor[:, None]
            term[divisor == 0, :] = 0.0
        if np.isnan(x).any() or np.isnan(p).any():
            term = np.where(np.isnan(x)[:, None] | np.isnan(p)[None, :], 1.0, term)
        total += f.weight * term
    return total / task.total_weight if task.total_weight > 0 else total


def _tiles(rows: int, width: int) -> Iterator[slice]:
    step = max(1, _TILE // max(1, width))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[pa.StructArray, pa.StructArray]]:
    """The packed query rows and pool rows of each joined row."""
    left, right = batch.column("query_rows"), batch.column("pool_rows")
    a, b = left.offsets.to_numpy(), right.offsets.to_numpy()
    for i in range(batch.num_rows):
        yield left.values.slice(a[i], a[i + 1] - a[i]), right.values.slice(b[i], b[i + 1] - b[i])


def _struct(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def _packed(keys: dict[str, np.ndarray], rows: pa.StructArray, order_key: np.ndarray) -> pa.RecordBatch | None:
    """Rows grouped by the key arrays into lists, more than one for a long group. Rows come sorted by key."""
    if len(rows) == 0:
        return None
    change = np.concatenate([[0], np.flatnonzero(np.diff(order_key)) + 1])
    run = np.repeat(change, np.diff(np.concatenate([change, [len(rows)]])))
    starts = np.flatnonzero((np.arange(len(rows)) - run) % PACK_ROWS == 0)
    offsets = pa.array(np.concatenate([starts, [len(rows)]]), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, rows)
    columns = {name: pa.array(values[starts].astype(np.int32)) for name, values in keys.items()}
    return pa.RecordBatch.from_arrays(
        [*columns.values(), lists], names=[*columns, "query_rows"]
    )


def _choose_parts(task: _Task, cells: dict[str, np.ndarray], queries: pa.StructArray, home: np.ndarray) -> None:
    """Where a home cell is cut into parts, move each query to its own part; ``cells`` is sorted by cell."""
    begin = np.searchsorted(cells["cell"], cells["cell"][home], side="left")
    end = np.searchsorted(cells["cell"], cells["cell"][home], side="right")
    for start in np.unique(begin[end - begin > 1]):
        mine = np.flatnonzero(begin == start)
        parts = {name: values[start : end[mine[0]]] for name, values in cells.items()}
        for tile in _tiles(len(mine), len(parts["cell"])):
            part = queries.take(pa.array(mine[tile]))
            guess = _bounds(task, parts, part, False) + 0.5 * _bounds(task, parts, part, True)
            home[mine[tile]] = start + guess.argmin(axis=1)


def _make_home(task: _Task, shared_cells: Any):
    def pick_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared_cells.value
        # Cells whose blocks all have k rows; any block of such a cell gives a limit.
        eligible = np.flatnonzero(cells["smallest"] >= task.k)
        if len(eligible) == 0:
            eligible = np.arange(len(cells["cell"]))
        few = {name: values[eligible] for name, values in cells.items()}
        home_of: dict[int, int] = {}
        seen = 0
        for batch in batches:
            own = batch.column("own_cell").to_numpy()
            queries = batch.drop_columns(["own_cell"]).to_struct_array()
            # Queries that would lie in one cell have one home, found for the first of them.
            numbers, first_of, which = np.unique(own, return_index=True, return_inverse=True)
            new = np.array([i for i, n in enumerate(numbers.tolist()) if n not in home_of], dtype=np.int64)
            for tile in _tiles(len(new), len(eligible)):
                part = queries.take(pa.array(first_of[new[tile]]))
                guess = _bounds(task, few, part, False) + 0.5 * _bounds(task, few, part, True)
                home_of.update(zip(numbers[new[tile]].tolist(), guess.argmin(axis=1).tolist()))
            home = np.array([home_of[n] for n in numbers.tolist()], dtype=np.int64)[which]
            _choose_parts(task, few, queries, home)
            position = np.arange(seen, seen + len(queries))
            seen += len(queries)
            first = few["last"][home] - few["pieces"][home] + 1
            chunk = np.where(
                few["whole"][home], first + position % few["pieces"][home], few["last"][home]
            ).astype(np.int32)
            # A cell that draws many queries is spread over several tasks.
            drawn = np.bincount(home, minlength=len(eligible))[home]
            salt = np.where(drawn > HOT_QUERIES, position % SALTS, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(few["cell"][home].astype(np.int32)), pa.array(chunk), pa.array(salt), queries],
                names=["cell", "chunk", "salt", "query"],
            )

    return pick_home


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell = batch.column("cell").to_numpy().astype(np.int64)
        chunk = batch.column("chunk").to_numpy().astype(np.int64)
        key = (cell << 32) | chunk
        order = np.argsort(key, kind="stable")
        rows = batch.column("query").take(pa.array(order))
        packed = _packed({"cell": cell[order], "chunk": chunk[order]}, rows, key[order])
        if packed is not None:
            yield packed


def _make_visits(task: _Task, shared_cells: Any):
    def pack(visits: list[tuple[pa.StructArray, np.ndarray]], cells: dict[str, np.ndarray]) -> pa.RecordBatch:
        rows = pa.concat_arrays([rows for rows, _ in visits])
        key = np.concatenate([key for _, key in visits])
        order = np.argsort(key, kind="stable")
        key = key[order]
        keys = {"cell": cells["cell"][key >> 32], "chunk": key & 0xFFFFFFFF}
        return _packed(keys, rows.take(pa.array(order)), key)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared_cells.value
        # Packed over all queries of the task, so that a block meets many of them at once.
        waiting, count = [], 0
        for batch in batches:
            for queries, pool in _pairs(batch):
                limit = np.full(len(queries), np.inf)
                if len(pool) >= task.k:
                    for tile in _tiles(len(queries), len(pool)):
                        part = queries.slice(tile.start, tile.stop - tile.start)
                        near = np.partition(_distances(task, part, pool), task.k - 1, axis=1)
                        limit[tile] = near[:, task.k - 1]
                # Rounding must not lose a cell that touches the limit.
                reach = limit * (1 + 1e-9) + 1e-12
                # Queries met here share a home: what none of them reaches is left out for all.
                reached = np.flatnonzero(_group_bounds(task, cells, queries) <= reach.max())
                few = {name: values[reached] for name, values in cells.items()}
                for tile in _tiles(len(queries), len(reached)):
                    part = queries.slice(tile.start, tile.stop - tile.start)
                    target, who = np.nonzero(
                        (_bounds(task, few, part, False) <= reach[tile, None]).T
                    )
                    # Every block of a cell is visited under its own key.
                    pieces = few["pieces"][target]
                    who, target = np.repeat(who, pieces), np.repeat(target, pieces)
                    if len(who) == 0:
                        continue
                    piece = np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    chunk = few["last"][target].astype(np.int64) - few["pieces"][target] + 1 + piece
                    chosen = part.take(pa.array(who))
                    columns = {f.name: chosen.field(f.name) for f in chosen.type}
                    columns["limit"] = pa.array(reach[tile][who])
                    waiting.append((_struct(columns), (reached[target].astype(np.int64) << 32) | chunk))
                    count += len(who)
                    if count >= VISIT_ROWS:
                        yield pack(waiting, cells)
                        waiting, count = [], 0
        if waiting:
            yield pack(waiting, cells)

    return visits


def _make_closest(task: _Task, id_name: str):
    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, pool in _pairs(batch):
                keys = np.argsort(np.argsort(pool.field("pool_id").to_numpy(zero_copy_only=False)))
                limits = queries.field("limit").to_numpy()
                for tile in _tiles(len(queries), len(pool)):
                    part = queries.slice(tile.start, tile.stop - tile.start)
                    distance = _distances(task, part, pool)
                    limit = limits[tile]
                    if len(pool) > task.k:
                        kth = np.partition(distance, task.k - 1, axis=1)[:, task.k - 1]
                        limit = np.minimum(limit, kth)
                    who, which = np.nonzero(distance <= limit[:, None])
                    if len(who) == 0:
                        continue
                    found = distance[who, which]
                    order = np.lexsort((keys[which], found, who))
                    who, which, found = who[order], which[order], found[order]
                    first = np.concatenate([[0], np.flatnonzero(np.diff(who)) + 1])
                    run = np.repeat(first, np.diff(np.concatenate([first, [len(who)]])))
                    keep = np.arange(len(who)) - run < task.k
                    who, which, found = who[keep], which[keep], found[keep]
                    mine, theirs = part.take(pa.array(who)), pool.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays(
                        [
                            mine.field(id_name),
                            theirs.field("pool_id"),
                            pa.array(found),
                            _struct({f.name: theirs.field(f.name) for f in task.features}),
                        ],
                        names=[id_name, "pool_id", "distance", "neighbour"],
                    )

    return closest


# --- the join --------------------------------------------------------------------------


def _written(df: DataFrame, name: str) -> DataFrame:
    path = storage.fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _meet(packed: DataFrame, blocks: DataFrame, broadcast: bool, tasks: int) -> DataFrame:
    """Packed queries with the block each names.

    Without ``broadcast`` both sides go by block. A block that draws more than its share of
    a task's queries, found by a histogram of the visits, is there under several salts
    and each packed row goes to one of them. At most ``SHARES`` blocks per task are hot.
    """
    keys = ["cell", "chunk"]
    if broadcast:
        return packed.join(F.broadcast(blocks), keys)
    packed = _written(packed, "visits")
    visits = packed.groupBy(*keys).agg(F.sum(F.size("query_rows")).alias("visits"))
    total = visits.agg(F.sum("visits")).first()[0] or 0
    share = max(1, total // (SHARES * tasks))
    hot = [(r["cell"], r["chunk"], -(-r["visits"] // share)) for r in visits.filter(F.col("visits") > share).collect()]
    if not hot:
        return packed.join(blocks, keys)
    table = F.broadcast(packed.sparkSession.createDataFrame(hot, "cell int, chunk int, salts long"))
    salts = F.coalesce("salts", F.lit(1))
    one = F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts)
    left = packed.join(table, keys, "left").withColumn("salt", one).drop("salts")
    right = blocks.join(table, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return left.join(right, [*keys, "salt"])


def nearest(
    index: NeighbourIndex,
    queries: DataFrame,
    row_id: str,
    k: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(row_id, pool_id, distance, neighbour, rank)``: the k nearest pool rows of every query.

    Ties are broken by ``pool_id``; ``neighbour`` is a struct of the pool row's features.
    """
    k = min(k or index.k, index.k)
    spark = queries.sparkSession
    shipping.ship_package(spark)
    task = _Task(
        index.features, tuple(s.name for s in index.splits), index.stretch, index.ranges, k
    )
    shared = spark.sparkContext.broadcast(index.cells)
    pool_type = index.blocks.schema["pool_rows"].dataType.elementType

    discrete_splits = [s for s in index.splits if any(f.name == s.name and f.discrete for f in index.features)]
    clean = queries.select(F.col(row_id), *_clean(queries, index.features))
    for split in discrete_splits:
        clean = clean.withColumn(f"bucket_{split.name}", _bucket(split, pool_type[split.name].dataType))
    query_type = T.StructType([T.StructField(f.name, f.dataType, True) for f in clean.schema.fields])
    limited_type = T.StructType([*query_type.fields, T.StructField("limit", T.DoubleType())])

    placed_type = T.StructType(
        [T.StructField("cell", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
         T.StructField("salt", T.IntegerType()), T.StructField("query", query_type)]
    )
    home_type = T.StructType(
        [T.StructField("cell", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
         T.StructField("query_rows", T.ArrayType(query_type))]
    )
    visit_type = T.StructType(
        [T.StructField("cell", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
         T.StructField("query_rows", T.ArrayType(limited_type))]
    )
    result_type = T.StructType(
        [T.StructField(row_id, clean.schema[row_id].dataType),
         T.StructField("pool_id", pool_type["pool_id"].dataType),
         T.StructField("distance", T.DoubleType()),
         T.StructField("neighbour", T.StructType([pool_type[f.name] for f in index.features]))]
    )
    # A pool this small goes to every task; a larger one is joined by a shuffle on the block.
    everywhere = index.size <= broadcast_bytes
    tasks = parallel.tasks(spark)
    # Queries of one cell come together, so that their home is chosen once and not for each.
    dealt = F.pmod(F.xxhash64(row_id), F.lit(HOME_SALTS))
    homes = (
        clean.withColumn("own_cell", _cell_number(index.splits, pool_type))
        .repartition(tasks, "own_cell", dealt)
        .mapInArrow(_make_home(task, shared), placed_type)
        .repartition(tasks, "cell", "chunk", "salt").sortWithinPartitions("cell", "chunk")
    )
    first = _meet(homes.mapInArrow(_pack_queries, home_type), index.blocks, everywhere, tasks)
    visits = first.select("query_rows", "pool_rows").mapInArrow(_make_visits(task, shared), visit_type)
    second = _meet(visits, index.blocks, everywhere, tasks)
    candidates = second.select("query_rows", "pool_rows").mapInArrow(
        _make_closest(task, row_id), result_type
    )
    ranked = Window.partitionBy(row_id).orderBy("distance", "pool_id")
    return candidates.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)

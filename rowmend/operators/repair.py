"""Batch repair: the fewest value changes that bring flagged rows back to normal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from rowmend import errors, storage
from rowmend.functions.kinds import Feature
from rowmend.functions.values import same_value
from rowmend.operators.consensus import fit_candidate, neighbour_consensus
from rowmend.operators.neighbours import NeighbourIndex, build_index, nearest

# Adds ``score`` and ``pred`` to a table with the feature columns and keeps other columns.
Scorer = Callable[[DataFrame], DataFrame]

# Option ranges, the smallest useful score drop, the reason of a change.
MAX_CHANGES = 20
MIN_NEIGHBOURS, MAX_NEIGHBOURS = 3, 200
MIN_IMPROVEMENT = 1e-4
REASON = "consensus of the nearest healthy rows"


@dataclass(frozen=True)
class RepairOptions:
    """Checked when made, before any job is planned. A dry run only detects."""

    max_changes: int = 3
    k_neighbors: int = 9
    immutable_columns: list[str] = field(default_factory=list)
    numeric_bounds: dict[str, dict[str, Any]] = field(default_factory=dict)
    min_improvement: float = MIN_IMPROVEMENT
    dry_run: bool = False

    def __post_init__(self) -> None:
        errors.checked_int("max_changes", self.max_changes, 1, MAX_CHANGES)
        errors.checked_int("k_neighbors", self.k_neighbors, MIN_NEIGHBOURS, MAX_NEIGHBOURS)
        if not isinstance(self.immutable_columns, (list, tuple, set)):
            raise errors.DataError(
                errors.INVALID_INPUT, "immutable_columns must be a list", field="immutable_columns"
            )
        if not isinstance(self.numeric_bounds, dict):
            raise errors.DataError(
                errors.INVALID_INPUT, "numeric_bounds must be a mapping", field="numeric_bounds"
            )

    @property
    def rounds(self) -> int:
        return 0 if self.dry_run else int(self.max_changes)

    @property
    def immutable(self) -> set[str]:
        return {str(c).strip() for c in self.immutable_columns if str(c).strip()}


def feature_weights(importances: dict[str, float]) -> dict[str, float]:
    """Importances as positive weights that sum to one; all equal if none is positive."""
    clipped = {c: max(0.0, float(v)) for c, v in importances.items()}
    if not any(clipped.values()):
        clipped = {c: 1.0 for c in clipped}
    total = sum(v + 1e-6 for v in clipped.values())
    return {c: (v + 1e-6) / total for c, v in clipped.items()}


def mutable_rank(features: list[Feature], immutable: set[str]) -> list[Feature]:
    """Features that may change, heaviest first, in column order among equals."""
    return [f for f in sorted(features, key=lambda f: -f.weight) if f.name not in immutable]


def repair_status(before_pred: Column, after_pred: Column, before: Column, after: Column, dry_run) -> Column:
    return (
        F.when(before_pred == 0, "already_normal")
        .when(after_pred == 0, "repaired")
        .when(dry_run if isinstance(dry_run, Column) else F.lit(dry_run), "anomaly_detected")
        .when(after < before, "partially_repaired")
        .otherwise("not_repaired")
    )


def repair_summary(
    before_pred: Column, after_pred: Column, before: Column, after: Column, changes: Column, dry_run: bool
) -> Column:
    status = repair_status(before_pred, after_pred, before, after, dry_run)
    return F.struct(
        status.alias("status"),
        status.isin("already_normal", "repaired").alias("success"),
        before_pred.alias("before_pred"),
        after_pred.alias("after_pred"),
        before.alias("before_score"),
        after.alias("after_score"),
        (before - after).alias("score_reduction"),
        F.size(changes).alias("applied_changes"),
        F.lit(dry_run).alias("dry_run"),
    )


_CHANGES = (
    "array<struct<feature:string,before:string,after:string,before_score:double,"
    "after_score:double,score_delta:double,reason:string>>"
)


def _trials(active: DataFrame, names: list[str], mutable: list[Feature], bounds: dict) -> DataFrame:
    """One row per sample and possible change, and one per sample for changing nothing."""
    schema = active.schema
    options = []
    for place, f in enumerate(mutable):
        current = F.col(f.name)
        candidate = fit_candidate(
            f, schema[f.name].dataType, F.col(f"agreed_{f.name}"), current, bounds.get(f.name)
        )
        changed = F.array_contains("changes.feature", f.name)
        row = F.struct(*[(candidate if n == f.name else F.col(n)).alias(n) for n in names])
        option = F.struct(
            F.lit(place).alias("place"), F.lit(float(f.weight)).alias("weight"), F.lit(f.name).alias("feature"),
            current.cast("string").alias("before"), candidate.cast("string").alias("after"), row.alias("row"),
        )
        options.append(F.when(F.col("has_neighbours") & ~changed & ~same_value(current, candidate), option))
    stay = F.struct(
        F.lit(len(mutable)).alias("place"), F.lit(0.0).alias("weight"), F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"),
        F.struct(*names).alias("row"),
    )
    tried = F.filter(F.array(*options, stay), lambda o: o.isNotNull())
    state = F.struct("original", "before_score", "before_pred", F.struct(*names).alias("current"),
                     "score", "pred", "changes")
    return active.select("row_id", state.alias("state"), F.explode(tried).alias("trial")).select(
        "row_id", "state", "trial", "trial.row.*"
    )


def _apply_best(scored: DataFrame, names: list[str], min_improvement: float) -> DataFrame:
    drop = F.col("state.score") - F.col("score")
    normal = F.col("pred") != 1
    allowed = F.col("trial.feature").isNotNull() & (normal | (drop >= F.lit(min_improvement)))
    rank = F.struct(
        allowed.cast("int"), normal.cast("int"), drop, F.col("trial.weight"), -F.col("trial.place")
    )
    best = scored.groupBy("row_id").agg(
        F.max_by(F.struct("state", "trial", "score", "pred", allowed.alias("allowed")), rank).alias("best")
    )
    change = F.struct(
        F.col("best.trial.feature").alias("feature"), F.col("best.trial.before").alias("before"),
        F.col("best.trial.after").alias("after"), F.col("best.state.score").alias("before_score"),
        F.col("best.score").alias("after_score"),
        (F.col("best.state.score") - F.col("best.score")).alias("score_delta"),
        F.lit(REASON).alias("reason"),
    )
    changed = F.col("best.allowed")
    row = F.when(changed, F.col("best.trial.row")).otherwise(F.col("best.state.current"))
    return best.select(
        "row_id", row.alias("row"),
        F.col("best.state.original").alias("original"),
        F.col("best.state.before_score").alias("before_score"),
        F.col("best.state.before_pred").alias("before_pred"),
        F.when(changed, F.col("best.score")).otherwise(F.col("best.state.score")).alias("score"),
        F.when(changed, F.col("best.pred")).otherwise(F.col("best.state.pred")).alias("pred"),
        F.when(changed, F.concat(F.col("best.state.changes"), F.array(change).cast(_CHANGES)))
        .otherwise(F.col("best.state.changes")).alias("changes"),
        (~changed | (F.col("best.pred") != 1)).alias("settled"),
    ).select("row_id", "row.*", *[
        "original", "before_score", "before_pred", "score", "pred", "changes", "settled"
    ])


def greedy_repair(
    samples: DataFrame,
    pool: DataFrame,
    scorer: Scorer,
    features: list[Feature],
    row_id: str,
    pool_id: str,
    options: RepairOptions = RepairOptions(),
    index: NeighbourIndex | None = None,
) -> DataFrame:
    """Repair all rows of ``samples`` that the scorer flags.

    In every round each flagged row meets its nearest healthy rows, each feature that
    may still change is tried with their consensus, and the best trial is kept: one that
    makes the row normal before others, then the largest drop, the heavier feature, the
    earlier column. Rows leave the loop when they are normal or nothing helps. A round
    ends with a checkpoint, so its cost does not grow with the rounds before.

    Rows without neighbours stay as they are, rows with equal keys are repaired each.

    Result per row: key, repaired features, ``original``, ``summary``, ``changes``.
    """
    names = [f.name for f in features]
    missing = [c for c in names if c not in pool.columns]
    if missing:
        raise errors.DataError(errors.REPAIR_FAILED, "pool lacks feature columns", columns=missing)
    rounds = min(options.rounds, len(names))
    mutable = mutable_rank(features, options.immutable)

    # Keys may repeat, so rows have a number of their own until the end.
    rows = samples.select(F.col(row_id).alias("key__"), *names)
    first = scorer(rows)
    state = first.select(
        F.monotonically_increasing_id().alias("row_id"), *names, F.struct("key__", *names).alias("original"),
        F.col("score").alias("before_score"), F.col("pred").alias("before_pred"),
        "score", "pred", F.array().cast(_CHANGES).alias("changes"),
        F.lit(False).alias("settled"),
    )
    finished = [state]
    if rounds and mutable:
        state = storage.cut_lineage(state)
        finished = [state.filter("pred <> 1")]
        active = state.filter("pred = 1")
        for _ in range(rounds):
            if active.isEmpty():
                break
            index = index or build_index(pool, features, pool_id, options.k_neighbors)
            found = nearest(index, active.select("row_id", *names), "row_id", options.k_neighbors)
            agreed = neighbour_consensus(found, features, "row_id")
            met = active.join(agreed.withColumn("has_neighbours", F.lit(True)), "row_id", "left")
            met = met.withColumn("has_neighbours", F.coalesce("has_neighbours", F.lit(False)))
            trials = _trials(met, names, mutable, options.numeric_bounds)
            moved = storage.cut_lineage(_apply_best(scorer(trials), names, options.min_improvement))
            finished.append(moved.filter("settled"))
            active = moved.filter("not settled")
        finished.append(active)
    everything = finished[0]
    for part in finished[1:]:
        everything = everything.unionByName(part)
    summary = repair_summary(
        F.col("before_pred"), F.col("pred"), F.col("before_score"), F.col("score"),
        F.col("changes"), options.rounds == 0,
    )
    original = F.struct(*[F.col(f"original.{c}").alias(c) for c in names])
    return everything.select(
        F.col("original.key__").alias(row_id), *names, original.alias("original"), summary.alias("summary"), "changes"
    )


def repair_totals(report: DataFrame) -> DataFrame:
    """Rows, changes and mean score reduction per status."""
    return report.groupBy(F.col("summary.status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("summary.applied_changes").alias("changes"),
        F.round(F.avg("summary.score_reduction"), 6).alias("mean_reduction"),
    )

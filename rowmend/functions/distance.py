"""The mixed distance and the Gower distance as column expressions over a joined pair."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowmend.functions.kinds import Feature


def mixed_term(feature: Feature, mine: Column, theirs: Column) -> Column:
    """0/1 mismatch for discrete values; scaled absolute difference, not capped, for numbers."""
    if feature.discrete:
        return F.when(mine.eqNullSafe(theirs), 0.0).otherwise(1.0)
    a, b = mine.cast("double"), theirs.cast("double")
    gap = F.abs(b - a) / F.lit(max(feature.scale, 1e-12))
    # Missing or infinite on either side counts one; NaN is above infinity.
    return F.when(F.coalesce(gap < float("inf"), F.lit(False)), gap).otherwise(1.0)


def mixed_distance(features: list[Feature], mine, theirs) -> Column:
    """Weighted mean of the terms. ``mine`` and ``theirs`` map a name to a column."""
    used = [f for f in features if f.weight > 0]
    if not used:
        return F.lit(0.0)
    total, weight = None, 0.0
    for f in used:
        term = F.lit(f.weight) * mixed_term(f, mine(f.name), theirs(f.name))
        total = term if total is None else total + term
        weight += f.weight
    return total / F.lit(weight)

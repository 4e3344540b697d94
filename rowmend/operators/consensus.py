"""What the nearest healthy rows agree on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowmend.functions import kinds, values
from rowmend.functions.kinds import Feature
from rowmend.operators.neighbours import build_index, nearest
from rowmend.operators.quantiles import exact_quantiles


def numeric_scales(pool: DataFrame, flags: dict[str, bool]) -> dict[str, float]:
    """Per feature the 5-95 % span, else the range, else 1; discrete features count 1."""
    numeric = [c for c, discrete in flags.items() if not discrete]
    scales = {c: 1.0 for c in flags}
    if not numeric:
        return scales
    tails = exact_quantiles(pool, numeric, [0.05, 0.95])
    for c in numeric:
        low, high = tails[c]
        if low is not None and 0 < high - low < math.inf:
            scales[c] = high - low
    flat = [c for c in numeric if tails[c][0] is not None and not 0 < tails[c][1] - tails[c][0] < math.inf]
    if flat:
        ranges = pool.agg(
            *[(F.max(kinds.as_number(c)) - F.min(kinds.as_number(c))).alias(c) for c in flat]
        ).first()
        scales.update({c: ranges[c] for c in flat if ranges[c] and 0 < ranges[c] < math.inf})
    return scales


def _finite(name: str) -> Column:
    number = kinds.as_number(name)
    return F.when(F.abs(number) < math.inf, number)


def numeric_ranges(pool: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    if not columns:
        return {}
    row = pool.agg(
        *[F.min(_finite(c)).alias(f"low_{i}") for i, c in enumerate(columns)],
        *[F.max(_finite(c)).alias(f"high_{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"low_{i}"] or 0.0, row[f"high_{i}"] or 0.0) for i, c in enumerate(columns)}


def describe_features(
    pool: DataFrame, names: list[str], weights: dict[str, float] | None = None,
    overrides: dict[str, bool] | None = None,
) -> list[Feature]:
    """Kind, weight and scale of every feature, from the healthy pool."""
    flags = kinds.discrete_flags(pool, names, overrides)
    scales = numeric_scales(pool, flags)
    weights = weights or {}
    return [Feature(c, flags[c], weights.get(c, 1.0), scales[c]) for c in names]


def mixed_index(pool: DataFrame, features: list[Feature], pool_id: str, k: int):
    return build_index(pool, features, pool_id, k)


def gower_index(pool: DataFrame, names: list[str], pool_id: str, k: int):
    """Index for the unweighted Gower distance; only text and booleans are categories."""
    numeric = [c for c in names if kinds.is_number(pool.schema[c].dataType)]
    ranges = numeric_ranges(pool, numeric)
    features = [
        Feature(c, c not in ranges, 1.0, (ranges[c][1] - ranges[c][0]) if c in ranges else 1.0)
        for c in names
    ]
    return build_index(pool, features, pool_id, k, stretch_ranges=ranges)


def _agreed(feature: Feature) -> Column:
    value = F.col(f"neighbour.{feature.name}")
    if feature.discrete:
        return F.mode(value, deterministic=True)
    return F.percentile(value.cast("double"), F.lit(0.5))


def neighbour_consensus(
    found: DataFrame, features: list[Feature], row_id: str, prefix: str = "agreed_"
) -> DataFrame:
    """Per query row the mode (smallest on ties) or median of its neighbours, per feature.

    ``found`` is clustered by the row id already, so this adds no shuffle.
    """
    return found.groupBy(row_id).agg(*[_agreed(f).alias(f"{prefix}{f.name}") for f in features])


def suggested_values(found: DataFrame, features: list[Feature], row_id: str) -> DataFrame:
    """``(row_id, feature, suggested_number, suggested_text)`` from the neighbours.

    Numbers are the median, to two places unless whole; categories the mode.
    """
    agreed = neighbour_consensus(found, features, row_id)
    entries = []
    for f in features:
        value = F.col(f"agreed_{f.name}")
        if f.discrete:
            number, text = F.lit(None).cast("double"), value.cast("string")
        else:
            number = F.when(value == F.floor(value), value).otherwise(F.round(value, 2))
            text = F.lit(None).cast("string")
        entries.append(
            F.struct(
                F.lit(f.name).alias("feature"), number.alias("suggested_number"), text.alias("suggested_text")
            )
        )
    return agreed.select(row_id, F.inline(F.array(*entries)))


def fit_candidate(
    feature: Feature, dtype: T.DataType, agreed: Column, current: Column, bounds: dict | None
) -> Column:
    """The consensus as a value this column can take: bounds for numbers, then the type."""
    if not feature.discrete:
        agreed = values.clip_bounds(agreed, bounds)
    return values.cast_like(agreed, dtype, current)


__all__ = [
    "describe_features", "fit_candidate", "gower_index", "mixed_index", "nearest",
    "neighbour_consensus", "numeric_ranges", "numeric_scales", "suggested_values",
]

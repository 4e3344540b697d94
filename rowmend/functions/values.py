"""Small value rules used by the repair: bounds, declared types, equality, times, thresholds."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F, types as T

from rowmend.functions import kinds


def _number_or_none(value: Any) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def clip_bounds(value: Column, bounds: dict[str, Any] | None) -> Column:
    """Limit a number to optional ``min`` and ``max``; a bound that is no number is ignored."""
    low = _number_or_none((bounds or {}).get("min"))
    high = _number_or_none((bounds or {}).get("max"))
    clipped = value
    if low is not None:
        clipped = F.when(value.isNotNull(), F.greatest(clipped, F.lit(low)))
    if high is not None:
        clipped = F.when(value.isNotNull(), F.least(clipped, F.lit(high)))
    return clipped


def cast_like(candidate: Column, dtype: T.DataType, current: Column, domain: list | None = None) -> Column:
    """The candidate in the declared type of its column, or the current value.

    Missing candidates and values outside the domain keep the current value; integers
    round half to even.
    """
    if kinds.is_integer(dtype):
        fitted = F.bround(candidate.cast("double"), 0).cast(dtype)
    else:
        fitted = candidate.cast(dtype)
    if domain is not None:
        fitted = F.when(fitted.isin(domain), fitted)
    return F.coalesce(fitted, current)


def same_value(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def clamp_threshold(raw: Any, default: float = 0.5) -> float:
    """A stored threshold forced into [0, 1]; the default if it is no number."""
    value = _number_or_none(raw)
    return max(0.0, min(1.0, default if value is None else value))


def epoch_ms(moment: Column, zoned: bool = True) -> Column:
    """Milliseconds since the epoch, 0 for none; a time without a zone counts as UTC."""
    if zoned:
        millis = F.unix_millis(moment)
    else:
        millis = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), moment)
    return F.coalesce(millis, F.lit(0).cast("long"))


def from_epoch_ms(millis: Column, zoned: bool = True) -> Column:
    """Time of the milliseconds, null for 0 and below."""
    if zoned:
        return F.when(millis > 0, F.timestamp_millis(millis))
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.when(millis > 0, start + F.make_dt_interval(secs=millis / 1000))


def fbeta(precision: Column, recall: Column, beta: float) -> Column:
    below = F.lit(beta * beta) * precision + recall
    return F.when(below > 0, F.lit(1 + beta * beta) * precision * recall / below).otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)

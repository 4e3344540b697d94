"""Exact quantiles (linear interpolation) of whole columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from rowmend.functions.kinds import as_number
from rowmend.operators.selection import select_ranks


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Quantiles per column, equal to sorting the column; nulls and NaN are left out.

    The values at the ranks below and above each position come from one ``select_ranks``.
    """
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    if not columns:
        return result
    numbers = df.select(*[as_number(c).alias(f"v{i}") for i, c in enumerate(columns)])
    wanted = [(i, p) for i in range(len(columns)) for p in probs]
    hits = select_ranks(
        numbers, numbers.columns, [(i, p, above) for i, p in wanted for above in (False, True)]
    )
    for place, (i, p) in enumerate(wanted):
        low, high = hits[2 * place], hits[2 * place + 1]
        if low and high:
            position = (low.rows - 1) * p
            share = position - math.floor(position)
            found = low.value if low.value == high.value else (1 - share) * low.value + share * high.value
            result[columns[i]][place % len(probs)] = found
    return result

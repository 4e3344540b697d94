"""Made-up tables of the tests, and where the given ones are."""

from __future__ import annotations

import numpy as np
import pandas as pd

TESTDATA = "/root/testdata"


def wear_frame(rows: int = 160) -> pd.DataFrame:
    """Machines with a label from a weighted sum of wear, the upper third of which is faulty."""
    rng = np.random.default_rng(19)
    df = pd.DataFrame({
        "row_id": np.arange(rows),
        "site": rng.choice(["north", "south", "harbour"], rows, p=[0.5, 0.3, 0.2]),
        "hours": rng.integers(50, 9000, rows),
        "overheated": (rng.random(rows) < 0.3).astype(int),
        "retrofitted": (rng.random(rows) < 0.6).astype(int),
        "vibration": rng.gamma(4.0, 0.7, rows),
        "load": rng.uniform(5.0, 95.0, rows),
        "oil_grade": rng.choice(["a", "b", "c"], rows),
    })
    wear = (
        df.hours / 3000 + 1.5 * df.overheated - 0.8 * df.retrofitted + df.vibration / 2
        + (df.oil_grade == "c") * 0.9
    )
    return df.assign(faulty=(wear > np.quantile(wear, 0.67)).astype(int))


def mendable_frame(rows: int = 240) -> pd.DataFrame:
    """Sound machines, and a fifth that run hot: most shake too much, some are also worn out."""
    rng = np.random.default_rng(23)
    worn = rows // 5
    hot = np.arange(rows) >= rows - worn
    return pd.DataFrame({
        "row_id": np.arange(rows),
        "site": rng.choice(["north", "south"], rows),
        "hours": np.where(hot, rng.integers(5500, 9000, rows), rng.integers(100, 4000, rows)),
        "overheated": np.where(hot, 1, rng.integers(0, 2, rows)),
        "vibration": np.where(hot, rng.uniform(4.2, 7.5, rows), rng.uniform(0.8, 3.1, rows)),
        "oil_grade": np.where(hot, rng.choice(["c", "b"], rows), rng.choice(["a", "b"], rows)),
        "faulty": hot.astype(int),
    })

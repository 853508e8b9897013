"""Order-insensitive comparison of two pandas frames (floats to 1e-9)."""

from __future__ import annotations

import math

import pandas as pd


def canon(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return (0, "")
    if isinstance(v, float):
        return (0, "") if math.isnan(v) else (1, round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return (2, str([canon(x) for x in v]))
    if isinstance(v, bool):
        return (3, int(v))
    if isinstance(v, int):
        return (1, float(v))
    return (4, str(v))


def rows_of(pdf: pd.DataFrame, cols) -> list:
    out = [tuple(canon(x) for x in rec) for rec in pdf[list(cols)].itertuples(index=False, name=None)]
    out.sort(key=str)
    return out


def assert_same(left: pd.DataFrame, right: pd.DataFrame) -> None:
    lc, rc = sorted(left.columns), sorted(right.columns)
    assert lc == rc, f"columns differ: {lc} vs {rc}"
    assert len(left) == len(right), f"row counts differ: {len(left)} vs {len(right)}"
    a, b = rows_of(left, lc), rows_of(right, lc)
    diffs = [(x, y) for x, y in zip(a, b) if x != y]
    assert not diffs, f"{len(diffs)} rows differ, e.g. {diffs[:3]}"

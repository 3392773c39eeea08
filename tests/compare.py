"""Rows of a Spark and a DuckDB result in one form, for comparison."""

from __future__ import annotations

import datetime
import decimal
import numbers

import numpy as np
import pandas as pd


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (np.ndarray, list)):
        return tuple(map(plain, value))
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (numbers.Real, decimal.Decimal)):
        return None if value != value else float(f"{float(value):.9g}")
    if isinstance(value, (datetime.date, pd.Timestamp)):
        return str(pd.Timestamp(value))
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).values.tolist()), key=str)

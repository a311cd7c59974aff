"""Rows of two frames as sorted plain values."""

import datetime
import decimal

import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (np.ndarray, list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v) if abs(int(v)) < 1 << 53 else int(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(pd.Timestamp(v))
    return v


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))

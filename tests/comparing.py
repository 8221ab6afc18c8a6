"""Comparison of result frames."""

import numpy as np
import pandas as pd


def text(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([text(x) for x in v])
    if pd.isna(v):
        return "null"
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else repr(round(float(v), 6))  # pandas makes doubles of whole numbers beside nulls
    return str(v)


def canonical(frame):
    """Rows of a pandas frame, columns by name, as comparable texts."""
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False))

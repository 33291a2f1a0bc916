"""Rounding of reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def py_round(value: Column, digits: int = 0) -> Column:
    """``value`` rounded as Python does it: to the nearest decimal of the exact
    binary value, ties to even.  Neither ``round`` nor ``bround`` of Spark does
    that (2.675 becomes 2.68 there and 2.67 here).

    Values are rounded together; only what lies so near to a tie that the
    product with the power of ten can't tell is rounded one by one.
    """
    scale = 10.0 ** max(digits, 0)

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        v = x.to_numpy(np.float64)
        with np.errstate(invalid="ignore", over="ignore"):
            big = v * scale
            out = np.rint(big) / scale  # the quotient of two exact numbers is the nearest double
            size = np.abs(big)
            close = np.abs(size - np.floor(size) - 0.5) <= 1e-9 + size * 1e-14
        for i in np.flatnonzero(~np.isnan(v) & (close | ~(size < 2.0**50) | (digits < 0))):
            out[i] = round(float(v[i]), digits) if np.isfinite(v[i]) else v[i]
        return pd.Series(out)

    return run(value.cast("double"))


def to_unit(value: Column, unit: float, digits: int = 0) -> Column:
    """``value`` in multiples of ``unit``, rounded half to even inside the JVM."""
    return F.bround(value / F.lit(unit), digits)

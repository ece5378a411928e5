"""Functions that Spark has no exact equal of, as pandas UDFs over Arrow batches."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from castline.functions.blocks import block_ratios

#: Letters of the pairs that are aligned together; a longer pair is alone.
TOGETHER = 1 << 18


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Canonical composition."""
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(DoubleType())
def round_exact(values: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounded on the exact binary value, half to even: 2.675 gives 2.67 at two digits."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(values, digits)], dtype="float64")


@F.pandas_udf(StringType())
def title_case(values: pd.Series) -> pd.Series:
    """Every run of letters starts with a capital: ``t-bone`` gives ``T-Bone``."""
    return values.map(lambda v: v if v is None else v.title())


@F.pandas_udf(StringType())
def short_number(values: pd.Series) -> pd.Series:
    """The shortest form of six significant digits."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:g}")


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts (Ratcliff and Obershelp), from 0 to 1."""
    whole = left.notna() & right.notna()
    a, b = left[whole].tolist(), right[whole].tolist()
    ends = np.cumsum([len(x) + len(y) for x, y in zip(a, b)])
    found, start = [np.zeros(0)], 0
    while start < len(a):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        found.append(block_ratios(a[start:stop], b[start:stop]))
        start = stop
    ratios = np.full(len(left), np.nan)
    ratios[whole.to_numpy()] = np.concatenate(found)
    return pd.Series(ratios)

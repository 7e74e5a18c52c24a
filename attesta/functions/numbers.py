"""Exact confidence arithmetic.

Confidences are added as integer micro-units and rounded half-up by integer
division, so a result never depends on the order in which a distributed sum
happens to run.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from attesta.functions.text import ColumnOrName, _c

MICRO = 1_000_000


def micro(confidence: ColumnOrName) -> Column:
    # floor(x + 0.5): rounding a double goes through BigDecimal text per row.
    return F.floor(_c(confidence) * F.lit(float(MICRO)) + 0.5)


def mean_milli(total_micro: ColumnOrName, n: ColumnOrName) -> Column:
    """Mean of micro-units, as half-up rounded milli-units; NULL when n is 0."""
    t, k = _c(total_micro), _c(n)
    return _div(2 * t + 1000 * k, 2000 * k)


def mean_of_milli(total_milli: ColumnOrName, n: ColumnOrName) -> Column:
    """Mean of milli-units, rounded half-up to milli-units."""
    t, k = _c(total_milli), _c(n)
    return _div(2 * t + k, 2 * k)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def from_milli(milli: ColumnOrName) -> Column:
    return _c(milli) / F.lit(1000.0)


@F.pandas_udf(DoubleType())
def round3_binary(x: pd.Series) -> pd.Series:
    """Correctly rounded binary value to three digits, ties as the bits say.

    Only for callers who need float rounding instead of the half-up rule.
    """
    return x.map(lambda v: round(v, 3), na_action="ignore")

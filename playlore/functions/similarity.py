"""Jaro-Winkler similarity of names, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler_pair(a: str, b: str) -> float:
    """1 for equal names, 0 for names without a letter in common; a shared beginning counts extra."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    first: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, open_ in zip(b, free, strict=True) if not open_]
    n = len(first)
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (n / len(a) + n / len(b) + (n - swaps) / n) / 3
    begin = 0
    while begin < min(4, len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    return jaro + begin * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_pair(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_similar, "double")(a, b)


def may_reach(a: Column | str, b: Column | str, floor: float) -> Column:
    """Whether two names can be as near as ``floor`` at all, by their lengths and beginnings.

    At best all letters of the shorter name stand in the longer one in order, and the common
    beginning counts up to four letters; what this bound rules out needs no comparison.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    begin = sum((F.substring(a, 1, n) == F.substring(b, 1, n)).cast("int") * (short >= n).cast("int") for n in range(1, 5))
    jaro = (1 + short / long + 1) / 3
    return (short > 0) & (jaro + begin * 0.1 * (1 - jaro) >= floor - 1e-9)

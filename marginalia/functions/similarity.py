"""String similarity on 0 to 100: twice the longest common subsequence over both lengths."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, a word of bits for all of `a` at once."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & where.get(c, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * lcs_length(a, b) / (len(a) + len(b))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def _rows(fn):
    """A vectorised UDF of fn; null where either text is null. Made when it is used, as it needs a session."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _rows(ratio)(sorted_tokens(a), sorted_tokens(b))


def partial_ratio(a: Column, b: Column) -> Column:
    return _rows(partial)(a, b)


def length_bound(a: Column, b: Column) -> Column:
    """No ratio of two texts is above this; it follows from their lengths alone."""
    n, m = F.length(a), F.length(b)
    return F.when(n + m == 0, F.lit(100.0)).otherwise(200.0 * F.least(n, m) / (n + m))

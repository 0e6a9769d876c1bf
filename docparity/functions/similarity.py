"""String similarity that Spark has no built-in for: normalised Indel ratio, plain and over sorted tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence by bit-parallel steps over ``b`` (Hyyro 2004).

    A text that only lost parts of the other is a subsequence of it, which one pass tells;
    the steps, whose time is the product of both lengths, are for other pairs.
    """
    if len(a) < len(b):
        a, b = b, a
    rest = iter(a)
    if all(c in rest for c in b):
        return len(b)
    lo = 0
    while lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = b[lo : len(b) - hi], a[lo : len(a) - hi]
    if not x:
        return lo + hi
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for c in y:
        u = v & where.get(c, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return lo + hi + len(x) - v.bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    """Indel similarity in [0, 1], rounded to whole percent; null if a side is null, 1 if both are empty."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return float(np.rint(200.0 * lcs_length(a, b) / total)) / 100.0 if total else 1.0


@F.pandas_udf(DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def indel_ratio(a: Column, b: Column) -> Column:
    return _ratio_udf(a, b)


def token_sorted(text: Column) -> Column:
    """Lower-case words in order. Characters 128 to 255 go, others that are no letters or digits separate."""
    plain = F.regexp_replace(text, r"[\x{80}-\x{ff}]+", "")
    words = F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # lower-cased only now, as small letters may bring marks that separate
    return F.concat_ws(" ", F.sort_array(F.transform(words, F.lower)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _ratio_udf(token_sorted(a), token_sorted(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct values; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)).cast("double") / union)

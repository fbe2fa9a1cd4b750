"""Similarities of short texts between 0 and 100."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by folding over the characters
    of a; each step carries one row of the table and runs in the JVM."""
    xs, ys = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    zero = F.transform(ys, lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        # cells of the new row from left to right; element_at(row, -1) is the cell to the left
        def cell(done: Column, at: Column) -> Column:
            left = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))
            up = F.element_at(before, at)
            diagonal = F.when(at > 1, F.try_element_at(before, F.greatest(at - 1, F.lit(1)))).otherwise(0)
            return F.concat(done, F.array(F.when(F.element_at(ys, at) == x, diagonal + 1).otherwise(F.greatest(left, up))))

        return F.aggregate(F.sequence(F.lit(1), F.size(ys)), F.array().cast("array<int>"), cell)

    last = F.aggregate(xs, zero, row)
    return F.when((F.size(xs) == 0) | (F.size(ys) == 0), F.lit(0)).otherwise(F.coalesce(F.try_element_at(last, F.lit(-1)), F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (len a + len b); two empty texts are alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / total)


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio is higher, by lengths alone; tells which pairs need no table."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * F.least(F.length(a), F.length(b)) / total)


def token_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(token_sorted(a), token_sorted(b))


# --- the same over pandas, for candidate pairs in bulk -----------------------


def lcs(a: str, b: str) -> int:
    """Bit-parallel: one big integer holds a row of the table."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def py_ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def _sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def _token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left = " ".join(filter(None, (both, " ".join(sorted(x - y)))))
    right = " ".join(filter(None, (both, " ".join(sorted(y - x)))))
    if both and (both == left or both == right):
        return 100.0
    return max(py_ratio(left, right), py_ratio(both, left) if both else 0.0, py_ratio(both, right) if both else 0.0)


def _partial_ratio(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    best = max((py_ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)), default=0.0)
    # windows cut off at either end
    for k in range(1, len(short)):
        best = max(best, py_ratio(short, long[:k]), py_ratio(short, long[-k:]))
    return best


def weighted(a: str, b: str) -> float:
    """Best of the plain ratio and, at 0.95, the token ratios; where one text is
    1.5 times as long as the other, of partial ratios at 0.9 (0.6 beyond 8 times)."""
    a, b = (re.sub(r"\W+", " ", s.lower()).strip() for s in (a, b))
    if not a or not b:
        return 0.0
    base, gap = py_ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if gap < 1.5:
        return max(base, 0.95 * py_ratio(_sorted_tokens(a), _sorted_tokens(b)), 0.95 * _token_set_ratio(a, b))
    scale = 0.9 if gap <= 8 else 0.6
    partial_tokens = max(_partial_ratio(_sorted_tokens(a), _sorted_tokens(b)), 100.0 if set(a.split()) & set(b.split()) else 0.0)
    return max(base, scale * _partial_ratio(a, b), 0.95 * scale * partial_tokens)


def _over_pandas(score, a: Column | str, b: Column | str) -> Column:
    # made when called: a worker that imports this module has no session
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([score(p or "", q or "") for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def _name_score(a: str, b: str) -> float:
    return max(py_ratio(a, b), py_ratio(_sorted_tokens(a), _sorted_tokens(b)))


def weighted_ratio(a: Column | str, b: Column | str) -> Column:
    return _over_pandas(weighted, a, b)


def fast_ratio(a: Column | str, b: Column | str) -> Column:
    """ratio() by bit-parallel LCS: for many pairs of longer texts."""
    return _over_pandas(py_ratio, a, b)


def fast_name_ratio(a: Column | str, b: Column | str) -> Column:
    """The better of the plain and the token-sorted ratio."""
    return _over_pandas(_name_score, a, b)

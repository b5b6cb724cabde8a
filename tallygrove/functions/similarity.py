"""String similarities from 0 to 100 by their published definitions, and Pandas UDFs over them.

``ratio`` is the normalised Indel similarity; the longest common subsequence runs bit-parallel on Python integers.
All are case-sensitive and do no preprocessing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit a character of ``a``, one addition a character of ``b``."""
    if not a or not b:
        return 0
    seen: dict[str, int] = {}
    for i, c in enumerate(a):
        seen[c] = seen.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & seen.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs(a, b) / n


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with the longer one's windows of its length, cut short at both ends."""
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b) if len(a) < len(b) else _windows(b, a)


def _windows(short: str, long: str) -> float:
    if not short:
        return 100.0 if not long else 0.0
    m, best = len(short), 0.0
    chars = set(short)
    for start in range(1 - m, len(long)):
        w = long[max(0, start) : start + m]
        # a best window begins or ends with a character of the short string
        if not w or (start + m >= len(long) and w[0] not in chars) or (start + m < len(long) and w[-1] not in chars):
            continue
        best = max(best, ratio(short, w))
        if best == 100.0:
            break
    return best


def _tokens(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    x, y = set(a.split()), set(b.split())
    return sorted(x & y), sorted(x - y), sorted(y - x)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _tokens(a, b)
    if both and (not left or not right):
        return 100.0
    i = " ".join(both)
    x, y = (" ".join([*both, *d]) for d in (left, right))
    return max(ratio(x, y), *((ratio(i, x), ratio(i, y)) if both else (0.0,)))


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _tokens(a, b)
    if both:
        return 100.0
    whole = partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(whole, partial_ratio(" ".join(left), " ".join(right)))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    r = max(len(a), len(b)) / min(len(a), len(b))
    base = ratio(a, b)
    if r < 1.5:
        return max(base, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    p = 0.9 if r <= 8 else 0.6
    return max(base, p * partial_ratio(a, b), 0.95 * p * partial_token_ratio(a, b))


def extract_one(query: str, choices: list[str], scorer=wratio) -> tuple[str, float] | None:
    """The best choice; of equals the first."""
    best: tuple[str, float] | None = None
    for c in choices:
        s = scorer(query, c)
        if best is None or s > best[1]:
            best = (c, s)
    return best


def _udf(fn):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b, strict=True))
        once = {p: fn(*p) for p in set(pairs) if None not in p}
        return pd.Series([once.get(p) for p in pairs], dtype="float64")

    return run


fuzz_ratio, fuzz_partial, fuzz_token_set, fuzz_wratio = (_udf(f) for f in (ratio, partial_ratio, token_set_ratio, wratio))


@F.pandas_udf(T.DoubleType())
def keyword_score(name: pd.Series, kws: pd.Series) -> pd.Series:
    """Mean over the keywords of the better of partial and token-set ratio; 0 without keywords."""

    def one(n: str | None, ks) -> float:
        ks = [] if ks is None else list(ks)
        return sum(max(partial_ratio(k, n or ""), token_set_ratio(k, n or "")) for k in ks) / len(ks) if ks else 0.0

    return pd.Series([one(n, k) for n, k in zip(name, kws, strict=True)], dtype="float64")

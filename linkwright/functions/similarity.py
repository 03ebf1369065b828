"""String similarities that Spark lacks, computed over Arrow batches; several measures share one pass over Python."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a column of the table in the bits of one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_distance(a: str, b: str) -> int:
    return len(a) + len(b) - 2 * common_subsequence(a, b)


def ratio(a: str, b: str) -> float:
    """Insert-and-delete similarity in percent."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_subsequence(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string and a stretch of the longer one, cut at the ends included."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m = len(short)

    def best(x: str, y: str) -> float:
        if x in y:
            return 100.0
        # a stretch that ends (or, cut at the end, starts) with a letter that x lacks is no better than its neighbour
        letters, n, top = set(x), len(x), 0.0
        for e in range(1, len(y) + n):
            i, j = max(0, e - n), min(e, len(y))
            if (y[j - 1] if e <= len(y) else y[i]) in letters and 200.0 * min(n, j - i) / (n + j - i) > top:
                top = max(top, ratio(x, y[i:j]))
        return top

    top = best(short, long)
    return max(top, best(long, short)) if m == len(long) and top < 100 else top


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words, and the shared words followed by either side's own; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, own_x, own_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if shared and (not own_x or not own_y):
        return 100.0
    whole_x, whole_y = " ".join(shared + own_x), " ".join(shared + own_y)
    top = ratio(whole_x, whole_y)
    if not shared:
        return top
    middle = " ".join(shared)
    return max(top, ratio(middle, whole_x), ratio(middle, whole_y))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a common beginning of up to four characters where it exceeds 0.7."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    from_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                from_a.append(c)
                break
    m = len(from_a)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(from_a, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    start = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + 0.1 * start * (1 - jaro)


def hamming(a: str, b: str) -> float:
    return float(sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b)))


def matcher_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


MEASURES: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "partial": partial_ratio, "tsort": token_sort_ratio, "tset": token_set_ratio, "jw": jaro_winkler,
    "indel": lambda a, b: float(indel_distance(a, b)), "hamming": hamming, "matcher": matcher_ratio,
}


def measures(a: Column, b: Column, *names: str) -> Column:
    """A struct of the named measures of two string columns, in one Arrow pass. Nulls count as empty strings."""
    chosen = {n: MEASURES[n] for n in names}

    @F.pandas_udf(StructType([StructField(n, DoubleType()) for n in names]))
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = list(zip(x.fillna(""), y.fillna(""), strict=True))
        # frequent names meet again and again: each distinct pair of a batch is measured once
        once = {pair: [f(*pair) for f in chosen.values()] for pair in set(rows)}
        return pd.DataFrame([once[pair] for pair in rows], columns=list(chosen))

    return run(a, b)


def measure(a: Column, b: Column, name: str) -> Column:
    return measures(a, b, name)[name]


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer string; 1 for two empty ones."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)

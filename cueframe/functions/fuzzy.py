"""Edit distances with free ends, which have no built-in function: Arrow batches, one small table for each pair of texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import letters_key, similarity


#: Numbers of a block of tables that are worked on at once.
CELLS = 1 << 17
#: Up to so many texts are compared pair by pair.
FEW = 16


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _last_row(a: str, b: str, free: bool) -> tuple[int, int]:
    """(last, least) number of the last row of the table of a and b. Its columns are the bits of two whole numbers, where
    it rises and where it falls (Myers). free: b may begin anywhere."""
    if not a:
        return (0, 0) if free else (len(b), 0)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, end = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = every, 0, len(a)
    least, first = score, 0 if free else 1
    for c in b:
        same = at.get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        right, back = down | ~(level | up), level & up
        if right & end:
            score += 1
        elif back & end:
            score -= 1
            least = min(least, score)
        right = right << 1 | first
        up, down = (back << 1 | ~(level | right)) & every, level & right & every
    return score, least


def distance(a: str, b: str) -> int:
    """The edit distance of two texts."""
    return _last_row(a, b, False)[0]


def best_fit(part: str, whole: str) -> int:
    """The least edit distance of `part` to any stretch of `whole`."""
    return _last_row(part, whole, True)[1]


def _blocks(parts: list[str], wholes: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of about the same lengths as blocks of at most CELLS numbers or of one pair: (their places, codes and lengths of
    the parts, codes and lengths of the wholes), padded with what no text has."""
    longer = [max(len(a), len(b)) for a, b in zip(parts, wholes, strict=True)]
    order = sorted(range(len(parts)), key=longer.__getitem__)
    for at, size in _runs([longer[i] + 1 for i in order]):
        some = order[at : at + size]
        padded = []
        for texts, pad in ((parts, 2**32 - 1), (wholes, 2**32 - 2)):
            codes = [_codes(texts[i]) for i in some]
            lengths = np.fromiter(map(len, codes), dtype=np.int64, count=size)
            table = np.full((size, int(lengths.max())), pad, dtype=np.uint32)
            table[np.arange(table.shape[1]) < lengths[:, None]] = np.concatenate(codes)
            padded += [table, lengths]
        yield np.array(some), *padded


def _runs(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Rising lengths as runs (first, how many) whose number times their longest is at most CELLS."""
    first = 0
    for i, n in enumerate(lengths):
        if i > first and (i - first + 1) * n > CELLS:
            yield first, i - first
            first = i
    if first < len(lengths):
        yield first, len(lengths) - first


def best_fits(parts: list[str], wholes: list[str]) -> np.ndarray:
    """best_fit of each pair: one row of the tables of a block of pairs at a time."""
    out = np.zeros(len(parts), dtype=np.int64)
    for some, a, na, b, nb in _blocks(parts, wholes):
        place = np.arange(b.shape[1] + 1)
        row = np.zeros((len(some), len(place)), dtype=np.int64)
        for i in range(1, a.shape[1] + 1):
            reached = np.concatenate([np.full((len(some), 1), i), np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i - 1 : i]))], axis=1)
            row = np.where(i <= na[:, None], np.minimum.accumulate(reached - place, axis=1) + place, row)
        out[some] = np.where(place <= nb[:, None], row, np.iinfo(np.int64).max).min(axis=1)
    return out


def common_subsequences(parts: list[str], wholes: list[str]) -> np.ndarray:
    """common_subsequence of each pair; padding is met nowhere, so it adds nothing."""
    out = np.zeros(len(parts), dtype=np.int64)
    for some, a, _, b, _ in _blocks(parts, wholes):
        row = np.zeros((len(some), b.shape[1] + 1), dtype=np.int64)
        for i in range(a.shape[1]):
            row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], np.where(b == a[:, i : i + 1], row[:, :-1] + 1, 0)), axis=1)
        out[some] = row[:, -1]
    return out


def distances(text: str, others: list[str]) -> np.ndarray:
    """The edit distance of a text to each of many others: one row of all tables at a time, or pair by pair where they are few."""
    if len(others) <= FEW:
        return np.array([distance(text, x) for x in others], dtype=np.int64)
    a, codes = _codes(text), [_codes(x) for x in others]
    size = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
    place = np.arange(int(size.max(initial=0)) + 1)
    b = np.zeros((len(codes), len(place) - 1), dtype=np.uint32)
    b[place[:-1] < size[:, None]] = np.concatenate(codes) if codes else 0
    row = np.broadcast_to(place, (len(codes), len(place)))
    for i, c in enumerate(a, 1):
        reached = np.concatenate([np.full((len(codes), 1), i), np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != c))], axis=1)
        row = np.minimum.accumulate(reached - place, axis=1) + place
    return row[np.arange(len(codes)), size]


def similarities(text: str, others: list[str]) -> np.ndarray:
    """1 - edit distance / longer length of a text and each of many others; 1 for two empty ones, 0 for one."""
    longer = np.maximum(len(text), np.fromiter(map(len, others), dtype=np.int64, count=len(others)))
    return np.where(longer == 0, 1.0, 1 - distances(text, others) / np.maximum(longer, 1))


def same_key(a: str, b: str) -> bool:
    """same_reading of two keys of letters and digits."""
    if not a or not b:
        return False
    short, long = sorted((a, b), key=len)
    # a distance is at least the difference of lengths
    if a == b or 1 - (len(long) - len(short)) / len(long) >= 0.75 and 1 - distance(a, b) / len(long) >= 0.75:
        return True
    return len(short) >= 5 and len(short) >= len(long) * 0.6 and 1 - best_fit(short, long) / len(short) >= 0.85


def common_subsequence(part: str, whole: str) -> int:
    a, b = _codes(part), _codes(whole)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for c in a:
        row = np.maximum.accumulate(np.r_[0, np.maximum(row[1:], np.where(b == c, row[:-1] + 1, 0))])
    return int(row[-1])


@F.pandas_udf(T.DoubleType())
def partial_similarity(shorter: pd.Series, longer: pd.Series) -> pd.Series:
    """1 - the distance of the first text to the stretch of the second that fits best / its length; 0 where it is empty."""
    given = [(i, a, b) for i, (a, b) in enumerate(zip(shorter, longer, strict=True)) if a and b is not None]
    out = [None if a is None or b is None else 0.0 for a, b in zip(shorter, longer, strict=True)]
    for (i, a, _), n in zip(given, best_fits([a for _, a, _ in given], [b for _, _, b in given]).tolist(), strict=True):
        out[i] = 1 - n / len(a)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def coverage(part: pd.Series, whole: pd.Series) -> pd.Series:
    """The share of the first text that the second has in the same order; 1 where it is empty."""
    given = [(i, a, b) for i, (a, b) in enumerate(zip(part, whole, strict=True)) if a and b is not None]
    out = [None if a is None or b is None else 1.0 for a, b in zip(part, whole, strict=True)]
    for (i, a, _), n in zip(given, common_subsequences([a for _, a, _ in given], [b for _, _, b in given]).tolist(), strict=True):
        out[i] = n / len(a)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.BooleanType())
def nearly_contains(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """Whether the pattern is in the text with at most one letter in six different, missing or extra (none in patterns under
    six letters); both as compatible letters and digits in lower case. An empty pattern is in every text with letters."""

    @lru_cache(maxsize=4096)
    def key(t: str) -> str:
        return "".join(c.lower() for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")

    keys = [None if t is None or p is None else (key(t), key(p)) for t, p in zip(text, pattern, strict=True)]
    out = [None if k is None else bool(k[0]) and k[1] in k[0] for k in keys]
    # patterns of six letters and more may differ
    near = [i for i, k in enumerate(keys) if k is not None and k[0] and not out[i] and len(k[1]) >= 6]
    for i, n in zip(near, best_fits([keys[i][1] for i in near], [keys[i][0] for i in near]).tolist(), strict=True):
        out[i] = n <= len(keys[i][1]) // 6
    return pd.Series(out, dtype="object")


def same_reading(a: Column | str, b: Column | str) -> Column:
    """Whether two readings are of one text: similar by 3/4, or one of at least 5 letters and 60 % of the other's length fits
    into it by 85 %."""
    x, y = letters_key(a), letters_key(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    fits = (F.length(short) >= 5) & (F.length(short) >= F.length(long) * 0.6)
    near = F.when(fits & (similarity(x, y) < 0.75), partial_similarity(short, long)).otherwise(0.0)
    return (x != "") & (y != "") & ((similarity(x, y) >= 0.75) | (near >= 0.85))

"""Long lines in pieces that fit two lines on a screen and can be read in time: an Arrow batch at a time."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SOFT_ENDS, STRONG_ENDS, WIDE

_WIDE = re.compile(WIDE.replace("\\u", "\\u"))
_PIECES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType())]))
#: A split that is made for time alone leaves so many columns on both sides.
LEAST_COLUMNS = 8


def _widths(text: str) -> Sequence[int]:
    """Columns before each place of a text."""
    if not _WIDE.search(text):
        return range(len(text) + 1)
    out = [0]
    for c in text:
        out.append(out[-1] + (2 if _WIDE.match(c) else 1))
    return out


def _wrapped(text: str, columns: int) -> list[str]:
    """As text.wrap."""
    w = _widths(text)
    if w[-1] <= columns:
        return [text]
    spaced = " " in text
    places = [i for i in range(1, len(text)) if (text[i] == " " if spaced else text[i].isalnum() or text[i].isspace())]
    if not places:
        return [text]
    cost = lambda i: max(w[i], w[-1] - w[i] - spaced) - 4 * (text[i - 1] in STRONG_ENDS + SOFT_ENDS)
    at = min(places, key=lambda i: (cost(i), i))
    return [text[:at].rstrip(), text[at:].lstrip()]


def best_break(text: str, words_only: bool = False) -> int | None:
    """Where to part a text: near its middle, with credit for the end of a sentence (0.3) or a comma (0.15) before it; there
    are letters on both sides. Texts without spaces are parted between East Asian characters only, and not for time."""
    w = _widths(text)
    spaced = " " in text
    if not spaced and (words_only or w[-1] == len(text)):
        return None
    first = next((i for i, c in enumerate(text) if c.isalnum()), None)
    if first is None:
        return None
    last = next(i for i in range(len(text) - 1, -1, -1) if text[i].isalnum())
    best = None
    places = (m.start() for m in re.finditer(" ", text)) if spaced else (i for i, c in enumerate(text) if c.isalnum() or c.isspace())
    for i in places:
        if not first < i <= last:
            continue
        left = i
        while text[left - 1] == " ":  # a letter stands before
            left -= 1
        if first >= left or words_only and min(w[left], w[-1] - w[i]) < LEAST_COLUMNS:
            continue
        credit = 0.3 if text[left - 1] in STRONG_ENDS else 0.15 if text[left - 1] in SOFT_ENDS else 0
        score = abs(w[i] / max(1, w[-1]) - 0.5) - credit
        if best is None or score < best[0]:
            best = (score, i)
    return None if best is None else best[1]


def pieces_of(text: str, start: int, end: int, columns: int, lines: int, longest_us: int, pace_us: int) -> list[tuple[str, int, int]]:
    """The pieces of a line with their times, shared out by width; where the line is shown half as long again as it takes to
    say, at a speaking pace from its start."""
    w = _widths(text)
    needed = pace_us * max(1, w[-1]) + 300_000
    span = end - start if end - start <= needed * 3 // 2 else needed * 3 // 2
    at = lambda i: start + span * w[i] // max(1, w[-1])
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        while a < b and text[a] == " ":
            a += 1
        while b > a and text[b - 1] == " ":
            b -= 1
        if a >= b:
            continue
        part = text[a:b]
        fits = w[b] - w[a] <= columns * lines
        if fits:
            shown = _wrapped(part, columns)
            fits = len(shown) <= lines and all(_widths(x)[-1] <= columns for x in shown)
        cut = best_break(part) if not fits else best_break(part, True) if at(b) - at(a) > longest_us and w[b] - w[a] >= 2 * LEAST_COLUMNS else None
        if cut is None:
            out.append((part, at(a), at(b)))
        else:
            todo += [(a + cut, b), (a, a + cut)]
    return out


def split_lines(columns: int = 42, lines: int = 2, longest_us: int = 7_000_000, pace_us: int = 85_000):
    """A function of (text, start_us, end_us): array<struct<text, start_us, end_us>>; null where one of them is."""

    @F.pandas_udf(_PIECES)
    def run(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        def one(t, a, b):
            if t is None or pd.isna(a) or pd.isna(b):
                return None
            return [{"text": x, "start_us": s, "end_us": e} for x, s, e in pieces_of(t, int(a), int(b), columns, lines, longest_us, pace_us)]

        return pd.Series([one(*x) for x in zip(text, start, end, strict=True)], dtype="object")

    return run

"""Readings of text in pictures: quality of a reading, cleaning, and whether a box can be a subtitle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: Fixed: signs that text has, signs around a word, signs that may stand alone, vowels, endings of numbers, one-letter words.
USUAL = ".,!?'’\"“”-–—:;…()♪&%$€£#/*"
AROUND = ".,!?'’\"“”-–—:;…()♪*[]"
ALONE = "-–—♪♫…&\"“”«»#$%€£"
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ"
NUMBER_ENDS = "st|nd|rd|th|s|am|pm|m|k|h|x"
ONE_LETTER = "aAIOoeyàéèó"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _class(signs: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in signs)


def _plain_word(w: Column) -> Column:
    """A word without apostrophe and hyphen: a number, a number with an ending, or letters whose case is a word's."""
    number = w.rlike(r"^[\p{Nd},.:]+$")
    started = F.lower(w).rlike(rf"^\p{{Nd}}+({NUMBER_ENDS})$")
    letters = w.rlike(r"^\p{L}+$")
    unspoken = (F.length(w) >= 4) & w.rlike("^[\u0001-\u024F]+$") & ~F.lower(w).rlike(f"[{VOWELS}]")
    single = w.rlike(f"^[{ONE_LETTER}]$") | ~w.rlike(r"^[\p{Lu}\p{Ll}]$")
    cased = w.rlike(r"[\p{Lu}\p{Ll}]")
    shape = ~cased | ~w.rlike(r"\p{Ll}") | ~F.substr(w, F.lit(2)).rlike(r"\p{Lu}") | ((F.length(F.regexp_replace(w, r"[^\p{Lu}]", "")) == 2) & w.rlike(r"^\p{Lu}\p{Ll}.*\p{Ll}$") & (F.length(w) >= 5))
    return number | F.when(w.rlike(r"^\p{Nd}"), started).otherwise(letters & ~unspoken & F.when(F.length(w) == 1, single).otherwise(shape))


def _hyphened(w: Column) -> Column:
    parts = F.filter(F.split(w, "-"), lambda p: p != "")
    caps = F.exists(parts, lambda p: (F.length(p) >= 2) & ~p.rlike(r"\p{Ll}") & p.rlike(r"\p{Lu}"))
    small = F.exists(parts, lambda p: ~p.rlike(r"\p{Lu}") & p.rlike(r"\p{Ll}"))
    return F.when(F.contains(w, F.lit("-")) & (F.size(parts) > 1), F.forall(parts, _plain_word) & ~(caps & small)).otherwise(_plain_word(w))


def word_shaped(word: Column | str) -> Column:
    """Whether a token looks like a word. What stands before an apostrophe decides; behind it up to three letters or a word.
    A tail with further apostrophes is looked at as one word."""
    w = _col(word)
    head, tail = F.regexp_extract(w, "^([^'’]+)['’](.+)$", 1), F.regexp_extract(w, "^([^'’]+)['’](.+)$", 2)
    has = F.contains(w, F.lit("'")) | F.contains(w, F.lit("’"))
    return F.when(has & (head != ""), _hyphened(head) & (tail.rlike(r"^\p{L}{1,3}$") | _hyphened(tail))).otherwise(_hyphened(w))


def quality(text: Column | str) -> Column:
    """0 to 1: how much a text looks like real text. The share of word-shaped tokens, weighted by up to 6 characters, less
    three times the share of unusual signs. 0 without words; null counts as empty."""
    t = F.coalesce(_col(text), F.lit(""))
    words = F.filter(F.transform(F.split(t, "[ \n\r\t]+"), lambda w: F.regexp_replace(w, f"^[{_class(AROUND)}]+|[{_class(AROUND)}]+$", "")), lambda w: w != "")
    weight = lambda w: F.least(F.length(w), F.lit(6)).cast("double")

    def share(all_of: Column) -> Column:
        total = F.aggregate(all_of, F.lit(0.0), lambda s, w: s + weight(w))
        good = F.aggregate(F.filter(all_of, word_shaped), F.lit(0.0), lambda s, w: s + weight(w))
        return F.when(F.size(all_of) > 0, good / total)

    dense = F.regexp_replace(t, r"(?U)\s", "")
    odd = F.length(F.regexp_replace(dense, rf"[\p{{L}}\p{{Nd}}{_class(USUAL)}]", ""))
    return F.coalesce(once(words, share) * (1 - F.least(F.lit(1.0), 3.0 * odd / F.length(dense))), F.lit(0.0))


def clean(text: Column | str) -> Column:
    """Without tokens of stray signs and lines of fewer than two letters or digits; spaces are single."""

    def line(x: Column) -> Column:
        kept = F.filter(F.split(x, " "), lambda w: w.rlike(r"[\p{L}\p{Nd}]") | w.rlike(f"^[{_class(ALONE)}]+$") | w.isin("...", "?", "!"))
        return F.regexp_replace(F.array_join(kept, " "), r"(?U)^\s+|\s+$", "")

    lines = F.transform(F.split(F.replace(F.coalesce(_col(text), F.lit("")), F.lit("\r"), F.lit("")), "\n"), line)
    return F.array_join(F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{Nd}]", "")) >= 2), "\n")


def subtitle_like(text: Column | str, x: Column | str, width: Column | str, height: Column | str, frame_width: Column | str, frame_height: Column | str) -> Column:
    """Whether a box can be a subtitle: two letters or more, 2 to 16 % of the frame high, within 20 % of its middle, at least
    4 % wide."""
    x, width, height, fw, fh = (_col(c).cast("double") for c in (x, width, height, frame_width, frame_height))
    letters = F.length(F.regexp_replace(_col(text), r"\P{L}", "")) >= 2
    return letters & (height / fh).between(0.02, 0.16) & (F.abs(x + width / 2 - fw / 2) / fw <= 0.2) & (width / fw >= 0.04)

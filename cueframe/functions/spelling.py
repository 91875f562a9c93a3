"""How words sound that no dictionary knows: romanized Korean by its syllables, and rules of English spelling."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: spellings of the beginnings, vowels and ends of romanized Korean syllables and their sounds, in the order in which they are tried.
ONSETS = {
    "kk": "k", "tt": "t", "pp": "p", "ss": "s", "jj": "ʤ", "ch": "ʧ", "sh": "ʃ", "g": "ɡ", "k": "k", "n": "n", "d": "d", "t": "t", "r": "ɹ", "l": "l", "m": "m",
    "b": "b", "p": "p", "s": "s", "j": "ʤ", "h": "h", "": "",
}
VOWELS = {
    "yeo": "jʌ", "yae": "jɛ", "wae": "wɛ", "eo": "ʌ", "eu": "ʊ", "ae": "ɛ", "oe": "wɛ", "wi": "wi", "ui": "ɨi", "ya": "jɑ", "yo": "jO", "yu": "ju", "ye": "jɛ", "wa": "wɑ", "wo": "wʌ", "we": "wɛ",
    "oo": "u", "oi": "Y", "ee": "i", "au": "W", "ou": "O", "a": "ɑ", "e": "ɛ", "i": "i", "o": "O", "u": "u",
}
CODAS = {"ng": "ŋ", "k": "k", "n": "n", "t": "t", "l": "l", "m": "m", "p": "p", "g": "k", "": ""}
#: Fixed: surnames that are said the English way.
USUAL = {"kim": "kˈɪm", "lim": "lˈɪm", "shin": "ʃˈɪn", "jin": "ʤˈɪn", "min": "mˈɪn", "bin": "bˈɪn"}
#: Fixed: English spellings and their sounds, in the order in which they are tried, and the vowels among the sounds.
SPELLINGS = {
    "tion": "ʃən", "sion": "ʒən", "ough": "ʌf", "igh": "I", "tch": "ʧ", "dge": "ʤ", "ph": "f", "th": "θ", "sh": "ʃ", "ch": "ʧ", "ck": "k", "ng": "ŋ", "qu": "kw", "wh": "w", "kn": "n", "wr": "ɹ",
    "ee": "i", "ea": "i", "oo": "u", "ou": "W", "ow": "O", "ai": "A", "ay": "A", "oi": "Y", "oy": "Y", "au": "ɔ", "aw": "ɔ", "ey": "A", "ie": "i", "ue": "u", "ew": "ju",
    "er": "əɹ", "ir": "ɜɹ", "ur": "ɜɹ", "ar": "ɑɹ", "or": "ɔɹ", "a": "æ", "e": "ɛ", "i": "ɪ", "o": "ɑ", "u": "ʌ", "b": "b", "d": "d", "f": "f", "g": "ɡ", "h": "h", "j": "ʤ",
    "k": "k", "l": "l", "m": "m", "n": "n", "p": "p", "r": "ɹ", "s": "s", "t": "t", "v": "v", "w": "w", "x": "ks", "z": "z",
}
VOWEL_SOUNDS = "AIOQWYaiuæɑɒɔəɛɜɪʊʌᵻ"
STRESS = "ˈ"


def _choice(parts: dict[str, str]) -> str:
    return "|".join(map(re.escape, parts))


_SPELLING = re.compile(rf"(?P<twice>([b-df-hj-np-tv-z])(?=\2))|(?P<soft>c(?=[eiy]))|(?P<hard>c)|(?P<first>^y)|(?P<y>y)|(?P<rule>{_choice(SPELLINGS)})|(?P<none>.)")


def syllables(word: str) -> list[tuple[str, str, str]] | None:
    """The cheapest way to read a word of lower-case letters as romanized syllables (beginning, vowel, end, as spelled).

    Place by place from the left, each keeps the way to it with the fewest syllables, then with the fewest ends that the next
    syllable, which begins with a vowel, could have taken; of equal ways the first by where the last syllable begins and by
    the order of the tables. None where there is no way.
    """
    ways: dict[int, tuple[int, int, list]] = {0: (0, 0, [])}
    for at in range(len(word)):
        if at not in ways:
            continue
        n, taken, way = ways[at]
        after_end = bool(way) and way[-1][2] != ""
        for onset in (o for o in ONSETS if word.startswith(o, at)):
            middle = at + len(onset)
            for vowel in (v for v in VOWELS if word.startswith(v, middle)):
                behind = middle + len(vowel)
                for coda in (c for c in CODAS if word.startswith(c, behind)):
                    to, cost = behind + len(coda), (n + 1, taken + (not onset and after_end))
                    if to not in ways or cost < ways[to][:2]:
                        ways[to] = (*cost, [*way, (onset, vowel, coda)])
    return ways[len(word)][2] if len(word) in ways else None


def romanized(word: str) -> str | None:
    """The sounds of a romanized Korean word, stressed on its first syllable; None where it is none."""
    if len(word) < 2 or not re.fullmatch("[A-Za-z]+", word):
        return None
    if word.lower() in USUAL:
        return USUAL[word.lower()]
    found = syllables(word.lower())
    if found is None:
        return None
    parts = [ONSETS[o] + STRESS * (i == 0) + VOWELS[v] + CODAS[c] for i, (o, v, c) in enumerate(found)]
    return "".join(parts).replace("ɨ", "ʊ")


def by_rules(word: str) -> str:
    """A rough reading of a word by its spelling, stressed on the first vowel."""
    w = re.sub("[^a-z]", "", word.lower())
    if len(w) > 2 and w[-1] == "e" and w[-2] not in "aeiou":
        w = w[:-1]
    sound = {"twice": lambda _: "", "soft": lambda _: "s", "hard": lambda _: "k", "first": lambda _: "j", "y": lambda _: "i", "rule": SPELLINGS.get, "none": lambda _: ""}
    said = "".join(sound[m.lastgroup](m.group()) for m in _SPELLING.finditer(w))
    at = next((i for i, c in enumerate(said) if c in VOWEL_SOUNDS), None)
    return said if at is None else said[:at] + STRESS + said[at:]


@F.pandas_udf(T.StringType())
def romanized_sounds(words: pd.Series) -> pd.Series:
    """romanized of a column; best over distinct words."""
    return words.map(lambda w: None if w is None else romanized(w)).astype("object")


@F.pandas_udf(T.StringType())
def spelled_sounds(words: pd.Series) -> pd.Series:
    """by_rules of a column; best over distinct words."""
    return words.map(lambda w: None if w is None else by_rules(w)).astype("object")

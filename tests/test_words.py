"""Words, numbers and spellings against plain Python."""

from __future__ import annotations

import gzip
import random

from pyspark.sql import functions as F

from cueframe.functions import numbers, spelling
from cueframe.operators import words
from cueframe.sources import dictionary

from .test_brute_force import column


def plain_cardinal(n):
    if n < 0:
        return "minus " + plain_cardinal(-n)
    if n < 20:
        return numbers.ONES[n]
    if n < 100:
        return numbers.TENS[n // 10 - 2] + (" " + numbers.ONES[n % 10] if n % 10 else "")
    for size, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            return plain_cardinal(n // size) + f" {name}" + (" " + plain_cardinal(n % size) if n % size else "")


def test_cardinals(spark):
    r = random.Random(1)
    values = [0, 1, 19, 20, 21, 100, 101, 999, 1000, 10**6, 10**12 - 1, 10**12, 2**63 - 1, -7, *(r.randrange(10 ** r.randrange(1, 19)) for _ in range(500))]
    assert column(spark, [(v,) for v in values], "x long", numbers.cardinal("x")) == [(plain_cardinal(v),) for v in values]
    assert column(spark, [(None,), (-(2**63),)], "x long", numbers.cardinal("x"), numbers.ordinal("x")) == [(None, None)] * 2


def test_numbers_as_they_are_spoken(spark):
    wanted = {
        "1st": "first", "22nd": "twenty second", "30th": "thirtieth", "112th": "one hundred twelfth", "1984": "nineteen eighty four", "2005": "two thousand five", "1900": "nineteen hundred", "1905": "nineteen oh five", "2010": "twenty ten",
        "1984%": "one thousand nine hundred eighty four percent", "1,984": "one thousand nine hundred eighty four", "5:30": "five thirty", "5:00": "five o'clock", "12:05": "twelve oh five", "5:30:10": "five thirty", "$20.50": "twenty dollars and fifty cents",
        "$1.01": "one dollar and one cent", "$0": "zero dollars", "$0.5": "fifty cents", "£0.50": "fifty pence", "£2.01": "two pounds and one pence", "€1,000": "one thousand euros", "$3.456": "three dollars", "3.14": "three point one four", "0.05": "zero point zero five",
        "20%": "twenty percent", "1980s": "nineteen eighty", "90's": "ninety", "1,000.5": "", "x": "", "": "", "12:x": "", "9" * 30: "", "1 2": "",
    }
    assert column(spark, [(t,) for t in wanted], "x string", numbers.spoken("x")) == [(w,) for w in wanted.values()]
    assert column(spark, [("1980s",), ("90's",), ("1st",), (None,)], "x string", numbers.is_plural("x")) == [(True,), (True,), (False,), (False,)]
    assert column(spark, [(None,)], "x string", numbers.spoken("x")) == [("",)]


def all_splits(word):
    """Every way to read a word as syllables, each end with the way that it is reached by first and cheapest."""
    best = {0: (0, 0, [])}
    order = {k: i for names in (spelling.ONSETS, spelling.VOWELS, spelling.CODAS) for i, k in enumerate(names)}
    for end in range(1, len(word) + 1):
        found = []
        for start in range(end):
            if start not in best:
                continue
            n, taken, way = best[start]
            piece = word[start:end]
            for i in range(3):
                for j in range(i + 1, len(piece) + 1):
                    o, v, c = piece[:i], piece[i:j], piece[j:]
                    if o in spelling.ONSETS and v in spelling.VOWELS and c in spelling.CODAS:
                        found.append(((n + 1, taken + (o == "" and bool(way) and way[-1][2] != "")), start, [*spelling.ONSETS].index(o), [*spelling.VOWELS].index(v), [*spelling.CODAS].index(c), [*way, (o, v, c)]))
        if found:
            (n, taken), *_, way = min(found, key=lambda x: x[:5])
            best[end] = (n, taken, way)
    assert order
    return best[len(word)][2] if len(word) in best else None


def test_romanized_words():
    assert spelling.romanized("Mina") == "mˈinɑ" and spelling.romanized("Kim") == "kˈɪm" and spelling.romanized("Seoyeon") == "sˈʌjʌn" and spelling.romanized("Euiui") == "ˈɛʊiʊi"
    assert spelling.romanized("strength") is None and spelling.romanized("a") is None and spelling.romanized("é") is None and spelling.romanized("") is None
    r = random.Random(2)
    parts = [*spelling.ONSETS, *spelling.VOWELS, *spelling.CODAS]
    for _ in range(3000):
        word = "".join(r.choices(parts, k=r.randrange(1, 8)))
        assert spelling.syllables(word) == all_splits(word), word


def test_spelling_rules():
    wanted = {"nation": "nˈæʃən", "city": "sˈɪti", "yes": "jˈɛs", "rabbit": "ɹˈæbɪt", "make": "mˈæk", "ache": "ˈækh", "thhh": "θh", "tree": "tɹˈi", "xyz": "ksˈiz", "12": "", "Knight": "nˈIt", "bee": "bˈi"}
    assert {w: spelling.by_rules(w) for w in wanted} == wanted


def test_dictionary_files(spark, tmp_path):
    path = str(tmp_path / "d.tsv.gz")
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("g\tcat\tkæt\ns\tcat\tkɛt\ng\tcat\tkˈæt\nbad line\ng\ta\tb\tc\ns\tRome\tɹOm\ng\tI\tI\ns\tNASA\tn\ng\tbe\t1\ng\tBe\t2\n")
    found = dictionary.read_dictionary(spark, path)
    assert sorted(tuple(r) for r in found.collect()) == sorted([("Be", "2", True), ("I", "I", True), ("NASA", "n", False), ("Rome", "ɹOm", False), ("be", "1", True), ("cat", "kˈæt", True), ("cat", "kɛt", False)])
    grown = sorted(tuple(r) for r in dictionary.grown(found).collect())
    assert grown == sorted([("Be", "2", True), ("Cat", "kˈæt", True), ("Cat", "kɛt", False), ("I", "I", True), ("NASA", "n", False), ("Rome", "ɹOm", False), ("be", "1", True), ("cat", "kˈæt", True), ("cat", "kɛt", False), ("rome", "ɹOm", False)])


def test_looked_up_words(spark):
    entries = [("cat", "kæt", True), ("cat", "no", False), ("try", "tɹI", False), ("bus", "bʌs", True), ("hat", "hæt", True), ("make", "mAk", True), ("run", "ɹʌn", True), ("need", "nid", True), ("dog's", "dɔɡz", True), ("John", "ʤɑn", True), ("pass", "pæs", True), ("wait", "wAt", True)]
    wanted = {
        "cat": ("cat", "", True, "kæt"), "cats": ("cat", "s", True, "kæts"), "tries": ("try", "s", False, "tɹIz"), "buses": ("bus", "s", True, "bʌsᵻz"), "passes": ("pass", "s", True, "pæsᵻz"), "hats'": None,
        "making": ("make", "ing", True, "mAkɪŋ"), "running": ("run", "ing", True, "ɹʌnɪŋ"), "waiting": ("wait", "ing", True, "wAɾɪŋ"), "waited": ("wait", "ed", True, "wAɾᵻd"), "needed": ("need", "ed", True, "nidᵻd"),
        "dogs'": ("dog's", "", True, "dɔɡz"), "cat'": ("cat", "", True, "kæt"), "CATS": ("cat", "s", True, "kæts"), "Running": ("run", "ing", True, "ɹʌnɪŋ"), "cAt": None, "John’s": ("John", "s", True, "ʤɑnz"), "john": None, "zzz": None,
    }
    df = spark.createDataFrame([(w, 1) for w in [*wanted, "cat", None]], "word string, turn int")
    found = {r.word: r for r in words.looked_up(df, spark.createDataFrame(entries, "word string, sounds string, gold boolean")).collect()}
    assert set(found) == set(wanted)
    for w, x in wanted.items():
        if x:
            assert (found[w].form, found[w].ending, found[w].gold, found[w].sounds, found[w].source) == (*x, "dictionary"), w
        else:
            assert found[w].source in ("romanized", "rules") and found[w].form is None
            assert found[w].sounds == (spelling.romanized(w) or spelling.by_rules(w))
    assert words.looked_up(df.limit(0), spark.createDataFrame(entries, "word string, sounds string, gold boolean")).count() == 0
    assert words.looked_up(df.where(F.col("word") == "cat"), spark.createDataFrame([], "word string, sounds string, gold boolean")).first().source == "rules"

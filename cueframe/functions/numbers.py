"""Numbers as they are spoken in English: column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: names of numbers, and of ordinals that are not made by an ending.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
THOUSANDS = {"billion": 10**9, "million": 10**6, "thousand": 10**3}
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
#: Fixed: a currency's unit and what a hundredth of it is called.
MONEY = {"$": ("dollar", "cent"), "£": ("pound", "pence"), "€": ("euro", "cent")}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is written, and computed, once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _words(*parts: Column) -> Column:
    """Parts that are not null, with spaces between."""
    return F.concat_ws(" ", *parts)


def _name(names: list[str], i: Column) -> Column:
    return F.get(F.split(F.lit(" ".join(names)), " "), i.cast("int"))


def _below_hundred(n: Column) -> Column:
    return F.when(n < 20, _name(ONES, n)).otherwise(_words(_name(TENS, F.floor(n / 10) - 2), F.when(n % 10 > 0, _name(ONES, n % 10))))


def _below_thousand(n: Column) -> Column:
    """Nothing for 0."""
    return _words(F.when(n >= 100, F.concat(_name(ONES, F.floor(n / 100)), F.lit(" hundred"))), F.when(n % 100 > 0, _below_hundred(n % 100)))


def _below_trillion(n: Column) -> Column:
    """Nothing for 0."""
    # whole quotients below 10^12 are exact in double precision
    groups = F.array(*(F.struct(F.floor(n / size % 1000).alias("n"), F.lit(name).alias("name")) for name, size in [*THOUSANDS.items(), ("", 1)]))
    said = F.transform(F.filter(groups, lambda g: g["n"] > 0), lambda g: _words(_below_thousand(g["n"]), F.when(g["name"] != "", g["name"])))
    return F.array_join(said, " ")


def cardinal(number: Column | str) -> Column:
    """A whole number in words: 1984 is "one thousand nine hundred eighty four". Null for null and for the smallest long."""

    def positive(size: Column) -> Column:
        parts = F.array(F.struct((size / 10**12).cast("long").alias("n"), F.lit("trillion").alias("name")), F.struct((size % 10**12).cast("long").alias("n"), F.lit("").alias("name")))
        said = F.transform(F.filter(parts, lambda g: g["n"] > 0), lambda g: _words(_below_trillion(g["n"]), F.when(g["name"] != "", g["name"])))
        return F.when(size == 0, ONES[0]).otherwise(F.array_join(said, " "))

    def whole(n: Column) -> Column:
        size = F.when(n >= 0, n).when(n > -(2**63), -n).cast("decimal(19,0)")
        return F.when(size.isNotNull(), F.concat(F.when(n < 0, "minus ").otherwise(""), _let(size, positive)))

    return _let(_col(number).cast("long"), whole)


def _as_place(words: Column) -> Column:
    """Words of a number as an ordinal."""
    last = F.regexp_extract(words, r"(\S+)$", 1)
    made = F.when(F.endswith(words, F.lit("y")), F.regexp_replace(words, "y$", "ieth")).otherwise(F.concat(words, F.lit("th")))
    for name, place in ORDINALS.items():
        made = F.when(last == name, F.regexp_replace(words, f"{name}$", place)).otherwise(made)
    return F.when(words.isNotNull(), made)


def ordinal(number: Column | str) -> Column:
    """As cardinal, but the last word says a place: "twenty first"."""
    return _let(cardinal(number), _as_place)


def _as_year(y: Column, all_of: Column, century: Column, rest: Column) -> Column:
    low = y % 100
    end = F.when(low == 0, F.lit("hundred")).when(low < 10, F.concat(F.lit("oh "), rest)).otherwise(rest)
    return F.when(y.between(2000, 2009), all_of).otherwise(_words(century, end))


def year(number: Column | str) -> Column:
    """A year of four digits: "nineteen eighty four", "two thousand five", "nineteen hundred", "nineteen oh five"."""
    return _let(_col(number).cast("long"), lambda y: _let(F.transform(F.array(y, F.floor(y / 100), y % 100), cardinal), lambda w: _as_year(y, w[0], w[1], w[2])))


def spoken(text: Column | str) -> Column:
    """A token that is a number in words: "1st", "1984", "5:30", "$20.50", "3.14", "20%", "1,000". "" where it is none, or too
    large. An ending s or 's, which makes a plural, is left out (see is_plural)."""
    pattern = r"^([$£€])?([0-9]+(?:[,.:][0-9]+)*)(st|nd|rd|th|s|'s|%)?$"
    whole = lambda digits: F.when(digits.rlike("^[0-9]+$"), digits.try_cast("long"))
    part = lambda s, by, i: F.get(F.split(s, by), F.lit(i))

    def parsed(t: Column) -> Column:
        return F.struct(*(F.regexp_extract(t, pattern, k).alias(name) for k, name in enumerate(("currency", "n", "ending"), 1)))

    def read(p: Column) -> Column:
        n = p["n"]
        digits = F.replace(n, F.lit(","), F.lit(""))
        small = part(digits, r"\.", 1)
        value = whole(digits)
        cents = F.coalesce(F.when(F.length(small).between(1, 2), whole(F.rpad(small, 2, "0"))), F.lit(0).cast("long"))
        values = F.array(whole(part(n, ":", 0)), whole(part(n, ":", 1)), whole(part(digits, r"\.", 0)), cents, value, F.floor(value / 100), value % 100)
        return _let(F.struct(values.alias("v"), F.transform(values, cardinal).alias("w")), lambda x: said(p, x["v"], x["w"]))

    def said(p: Column, v: Column, w: Column) -> Column:
        n, ending = p["n"], p["ending"]
        time = F.when(v[0].isNotNull(), _words(w[0], F.when(v[1] == 0, F.lit("o'clock")).when(v[1] < 10, F.concat(F.lit("oh "), w[1])).otherwise(w[1])))
        money = F.lit(None).cast("string")
        for sign, (unit, hundredth) in MONEY.items():
            most = F.when((v[2] > 0) | (v[3] == 0), _words(w[2], F.when(v[2] == 1, unit).otherwise(unit + "s")))
            rest = F.when(v[3] > 0, _words(F.when(v[2] > 0, F.lit("and")), w[3], F.when((v[3] == 1) | F.lit(hundredth == "pence"), hundredth).otherwise(hundredth + "s")))
            money = F.when(p["currency"] == sign, _words(most, rest)).otherwise(money)
        places = F.transform(F.filter(F.split(part(n, r"\.", 1), ""), lambda d: d != ""), lambda d: _name(ONES, d))
        decimal = F.when(v[2].isNotNull(), _words(w[2], F.lit("point"), F.array_join(places, " ")))
        is_year = F.coalesce((F.length(n) == 4) & v[4].between(1100, 2099) & (ending != "%"), F.lit(False))
        plain = F.when(ending.isin("st", "nd", "rd", "th"), _as_place(w[4])).when(is_year, _as_year(v[4], w[4], w[5], w[6])).otherwise(w[4])
        words = F.when(F.contains(n, F.lit(":")), time).when(p["currency"] != "", F.when(v[2].isNotNull(), money)).when(F.contains(n, F.lit(".")) & ~F.contains(n, F.lit(",")), decimal).otherwise(plain)
        return F.when((n != "") & words.isNotNull(), F.concat(words, F.when(ending == "%", " percent").otherwise(""))).otherwise("")

    return _let(parsed(F.coalesce(_col(text), F.lit(""))), read)


def is_plural(text: Column | str) -> Column:
    """Whether a number is said as a plural: "1980s"."""
    return F.coalesce(_col(text).rlike(r"^[$£€]?[0-9]+([,.:][0-9]+)*'?s$"), F.lit(False))

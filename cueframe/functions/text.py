"""Text functions as column expressions. Lengths count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the scripts, each as the ranges of code points whose letters belong to it.
SCRIPTS = {
    "Latin": "\\u0000-\\u024F\\u1E00-\\u1EFF", "Greek": "\\u0370-\\u03FF\\u1F00-\\u1FFF", "Cyrillic": "\\u0400-\\u052F", "Armenian": "\\u0530-\\u058F",
    "Hebrew": "\\u0590-\\u05FF", "Arabic": "\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF", "Devanagari": "\\u0900-\\u097F",
    "Bengali": "\\u0980-\\u09FF", "Gurmukhi": "\\u0A00-\\u0A7F", "Gujarati": "\\u0A80-\\u0AFF", "Tamil": "\\u0B80-\\u0BFF", "Telugu": "\\u0C00-\\u0C7F",
    "Kannada": "\\u0C80-\\u0CFF", "Malayalam": "\\u0D00-\\u0D7F", "Sinhala": "\\u0D80-\\u0DFF", "Thai": "\\u0E00-\\u0E7F", "Lao": "\\u0E80-\\u0EFF",
    "Tibetan": "\\u0F00-\\u0FFF", "Myanmar": "\\u1000-\\u109F", "Georgian": "\\u10A0-\\u10FF", "Hangul": "\\u1100-\\u11FF\\u3130-\\u318F\\uAC00-\\uD7AF",
    "Ethiopic": "\\u1200-\\u139F", "Khmer": "\\u1780-\\u17FF", "Kana": "\\u3040-\\u30FF\\u31F0-\\u31FF\\uFF66-\\uFF9F", "Han": "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF",
}
#: Fixed: what is no letter of a script other than Latin; the wide range comes first, as it holds most characters.
NO_OTHER_LETTERS = "[\\u0000-\\u036F[^" + "".join(span for name, span in SCRIPTS.items() if name != "Latin") + "]\\P{L}]+"
#: Fixed: the scripts that languages are written in; all others are written in Latin.
LANGUAGE_SCRIPTS = {
    "ko": ["Hangul", "Han"], "ja": ["Kana", "Han"], "zh": ["Han"], "yue": ["Han"], **dict.fromkeys("ru uk be bg mk kk ky tg mn ba tt".split(), ["Cyrillic"]), "sr": ["Cyrillic", "Latin"],
    "el": ["Greek"], **dict.fromkeys("ar fa ur ps sd ug".split(), ["Arabic"]), "he": ["Hebrew"], "yi": ["Hebrew"], "th": ["Thai"], **dict.fromkeys("hi mr ne sa".split(), ["Devanagari"]),
    "bn": ["Bengali"], "as": ["Bengali"], "pa": ["Gurmukhi"], "gu": ["Gujarati"], "ta": ["Tamil"], "te": ["Telugu"], "kn": ["Kannada"], "ml": ["Malayalam"], "si": ["Sinhala"],
    "ka": ["Georgian"], "hy": ["Armenian"], "km": ["Khmer"], "lo": ["Lao"], "my": ["Myanmar"], "am": ["Ethiopic"], "bo": ["Tibetan"],
}
#: Fixed: what takes two columns on a screen.
WIDE = "[\\u1100-\\u11FF\\u2E80-\\u9FFF\\uAC00-\\uD7A3\\uF900-\\uFAFF\\uFF00-\\uFF60\\u3130-\\u318F]"
#: Fixed: characters a second that can be read, by language; other languages.
READING_LIMIT, OTHER_LIMIT = {"en": 20, "ko": 12, "zh": 9, "yue": 9, "ja": 4}, 17
#: Fixed: characters that count half in Japanese.
HALF_WIDTH = "[\\u0000-\\u10FF\\uFF61-\\uFFDC\\uFFE8-\\uFFEE]"
#: Fixed: marks that end a question.
QUESTION_MARKS = "?？؟՞፧\u037E"
#: Fixed: signs that end a sentence, and those that part one.
STRONG_ENDS, SOFT_ENDS = ".?!。？！…", ",;:、，；："


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def once(value: Column, work: Callable[[Column], Column]) -> Column:
    """work(value), with the value worked out once however often work takes it: as the only element of an array."""
    return F.transform(F.array(value), work)[0]


def letters_key(text: Column | str) -> Column:
    """Letters and decimal digits only, in lower case: texts with equal keys say the same."""
    return F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{Nd}]+", "")


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def strip_tags(text: Column | str) -> Column:
    r"""Without <tags>, {\\override blocks} and the escapes \N, \n (a line break) and \h (a space)."""
    plain = F.regexp_replace(F.regexp_replace(_col(text), r"<[^>]*>", ""), r"\{\\[^}]*\}", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\\[Nn]", "\n"), r"\\h", " ")


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def for_reading(text: Column | str) -> Column:
    """A cue's text as it is read: without tags and any {blocks}, lines kept; null counts as empty."""
    bare = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\{[^}]*\}|</?[a-zA-Z][^>]*>", "")
    return trimmed(F.replace(bare, F.lit("\r"), F.lit("")))


def letters(text: Column | str) -> Column:
    """How many letters and decimal digits."""
    return F.length(F.regexp_replace(_col(text), r"[^\p{L}\p{Nd}]+", ""))


def word_count(text: Column | str) -> Column:
    """How many words between white space have a letter."""
    return F.size(F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w.rlike(r"\p{L}")))


def spoken(text: Column | str) -> Column:
    """Whether a line has something said: no note sign, and letters outside [..] and (..)."""
    t = _col(text)
    return ~F.contains(t, F.lit("♪")) & F.regexp_replace(t, r"\[[^\]]*\]|\([^)]*\)", "").rlike(r"\p{L}")


#: Fixed: endings of web addresses.
DOMAINS = "com net org cc tv io me to co info xyz site online top vip live app club pro biz ws la in ru cn vn"


def web_address(text: Column | str) -> Column:
    """Whether a text has a web address: www., a protocol, or three characters or more before a known ending."""
    ends = DOMAINS.replace(" ", "|")
    return F.lower(_col(text)).rlike(rf"\b(www\.|https?://)|\b[a-z0-9][a-z0-9-]{{2,}}\.({ends})\b")


def columns_wide(text: Column | str) -> Column:
    """Screen columns: East Asian wide characters take two."""
    t = _col(text)
    return F.length(t) + F.length(t) - F.length(F.regexp_replace(t, WIDE, ""))


def reading_chars(text: Column | str, language: str = "en") -> Column:
    """Characters that are read: tags, line breaks and white space at line ends do not count; in Japanese, half-width
    characters count half."""
    plain = F.array_join(F.transform(F.split(F.replace(strip_tags(text), F.lit("\r"), F.lit("")), "\n"), trimmed), "")
    n = F.length(plain).cast("double")
    if (language or "").lower().startswith("ja"):
        return n - (F.length(plain) - F.length(F.regexp_replace(plain, HALF_WIDTH, ""))) / 2
    return n


def reading_limit(language: str | None) -> int:
    return READING_LIMIT.get((language or "").lower().replace("_", "-").split("-")[0], OTHER_LIMIT)


def needed_us(text: Column | str, language: str = "en") -> Column:
    """Time to read a text at its language's limit, rounded up."""
    return F.ceil(reading_chars(text, language) * 1_000_000 / reading_limit(language)).cast("long")


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    a, b = _col(a), _col(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def similar(a: Column | str, b: Column | str, least: float) -> Column:
    """Whether similarity() is at least so much; a distance is counted only as far as that takes."""
    a, b = _col(a), _col(b)
    longer = F.greatest(F.length(a), F.length(b))
    most = (F.floor(longer * (1 - least)) + 1).cast("int")
    distance = F.call_function("levenshtein", a, b, most)
    return (a == b) | (distance >= 0) & (1 - distance / longer >= least)


#: Fixed: letters that romanize the same sound, and those that do not count.
SAME_SOUND = {"g": "k", "d": "t", "b": "p", "r": "l", "z": "j", "f": "p"}
SILENT = "aeiouyw"


def name_key(name: Column | str) -> Column:
    """Letters only, in lower case."""
    return F.regexp_replace(F.lower(_col(name)), "[^\\p{L}]", "")


def sound_key(name: Column | str) -> Column:
    """A romanized name without vowels, with like consonants as one: names with equal keys may sound the same."""
    t = F.replace(F.replace(name_key(name), F.lit("ch"), F.lit("j")), F.lit("sh"), F.lit("s"))
    t = F.translate(t, "".join(SAME_SOUND), "".join(SAME_SOUND.values()))
    t = F.regexp_replace(t, f"[{SILENT}]", "")
    t = F.regexp_replace(t, "(?<=.)h", "")  # behind vowels alone an h stays
    return F.regexp_replace(t, r"(.)\1+", "$1")


def nearly_same(a: Column | str, b: Column | str) -> Column:
    """Two spellings of one name: equal letters, or at most one different (two in keys of 10 letters or more), where both
    keys have at least 5 letters, the names have as many words, and names of several words begin with the same one."""
    x, y = name_key(a), name_key(b)
    shorter = F.least(F.length(x), F.length(y))
    one, two = F.split(_col(a), " "), F.split(_col(b), " ")
    family = (F.size(one) == F.size(two)) & ((F.size(one) == 1) | (one[0] == two[0]))
    return (x == y) | (shorter >= 5) & family & (F.levenshtein(x, y) <= F.when(shorter >= 10, 2).otherwise(1))


def look_alike(a: Column | str, b: Column | str) -> Column:
    """Whether two names may be one: nearly the same, or of one shape (words, hyphen, family name), with given names that
    sound alike in two consonants or more and differ in no more than half their letters."""
    one, two = F.split(_col(a), " "), F.split(_col(b), " ")
    given = F.element_at(one, -1), F.element_at(two, -1)
    shape = (F.size(one) == F.size(two)) & ((F.size(one) != 2) | (one[0] == two[0])) & (F.contains(given[0], F.lit("-")) == F.contains(given[1], F.lit("-")))
    sounds = sound_key(given[0]), sound_key(given[1])
    keys = name_key(given[0]), name_key(given[1])
    near = F.levenshtein(*keys) <= F.floor((F.greatest(F.length(keys[0]), F.length(keys[1])) + 1) / 2)
    return nearly_same(a, b) | shape & (F.length(sounds[0]) >= 2) & (sounds[0] == sounds[1]) & near


def natural_key(text: Column | str) -> Column:
    """A sort key in which runs of digits count by value and letters regardless of case: "Episode 2" before "Episode 10".
    Runs are led by the number of their digits, so they may be of any length up to 99,999 digits."""
    parts = F.regexp_extract_all(F.upper(_col(text)), F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def valued(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return F.when(p.rlike(r"^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 5, "0"), bare)).otherwise(p)

    return F.array_join(F.transform(parts, valued), "")


def natural_order(text: Column | str) -> list[Column]:
    """What to sort by: the natural key, then the shorter text, then code points."""
    return [natural_key(text), F.length(_col(text)), _col(text)]


def other_letters(text: Column | str) -> Column:
    """Only the letters of known scripts other than Latin, in their order: most texts have none, and one pass says so."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), NO_OTHER_LETTERS, "")


def latin_count(text: Column | str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(_col(text), F.lit("")), f"[[^{SCRIPTS['Latin']}]\\P{{L}}]+", ""))


def other_counts(others: Column | str) -> dict[str, Column]:
    """Letters of each script but Latin in what other_letters() gives."""
    t = _col(others)
    return {name: F.length(F.regexp_replace(t, f"[^{span}]+", "")) for name, span in SCRIPTS.items() if name != "Latin"}


def script_counts(text: Column | str) -> dict[str, Column]:
    """Letters of each script."""
    t = F.coalesce(_col(text), F.lit(""))
    return {name: F.length(F.regexp_replace(t, f"[[^{span}]\\P{{L}}]+", "")) for name, span in SCRIPTS.items()}


def dominant_script(text: Column | str) -> Column:
    """The script other than Latin with most letters, of equal ones the first in the text; Kana takes the Han characters
    beside it. Latin where there is no other; null without letters of a known script."""
    t = F.coalesce(_col(text), F.lit(""))

    def best(others: Column) -> Column:
        n = other_counts(others)
        kana = n["Kana"] > 0
        n = n | {"Kana": F.when(kana, n["Kana"] + n["Han"]).otherwise(0), "Han": F.when(kana, 0).otherwise(n["Han"])}
        # the smallest of (-letters, place of the first one) wins
        found = F.array(*(F.when(n[name] > 0, F.struct((-n[name]).alias("n"), F.length(F.regexp_substr(others, F.lit(f"^[^{SCRIPTS[name]}]*"))).alias("at"), F.lit(name).alias("script"))) for name in n))
        return F.when(others != "", F.array_min(F.filter(found, lambda x: x.isNotNull()))["script"])

    # as an array of one, so that these letters are taken out once and not for each script
    other = F.transform(F.array(other_letters(t)), best)[0]
    return F.coalesce(other, F.when(t.rlike(f"[[{SCRIPTS['Latin']}]&&[\\p{{L}}]]"), "Latin"))


def scripts_of(language: str | None) -> list[str]:
    return LANGUAGE_SCRIPTS.get((language or "").lower().replace("_", "-").split("-")[0], ["Latin"])


def foreign_letters(text: Column | str, language: str) -> Column:
    """Whether letters of a known script are in a text that its language is not written in; Latin is always allowed."""
    others = "".join(span for name, span in SCRIPTS.items() if name != "Latin" and name not in scripts_of(language))
    # the wide range comes first, as Latin letters are no longer tried against each script then
    return F.coalesce(_col(text), F.lit("")).rlike(f"[[\\u0370-\\uFFFF]&&[{others}]&&[\\p{{L}}]]")


def asks(text: Column | str) -> Column:
    """Whether a text ends as a question: with such a mark before closing signs, an Armenian one anywhere, or a Greek ";"."""
    bare = F.regexp_replace(_col(text), r"""[ ."'」』)\-»«]+$""", "")
    last = F.right(bare, F.lit(1))
    return (bare != "") & (last.isin(*QUESTION_MARKS) | F.contains(bare, F.lit("՞")) | (last == ";") & F.coalesce(dominant_script(bare) == "Greek", F.lit(False)))


def has_question_mark(text: Column | str, language: str) -> Column:
    found = _col(text).rlike(f"[{QUESTION_MARKS}]")
    return found | F.contains(_col(text), F.lit(";")) if "Greek" in scripts_of(language) else found


def wrap(text: Column | str, max_columns: int = 42) -> Column:
    """A text that is wider than a line on two, as even as may be: broken at the space (in texts without spaces, before the
    character that is no punctuation) that leaves the narrowest wider line, with a credit of 4 behind punctuation; the
    first of equal places. As it is where it fits or cannot be broken."""
    t = _col(text)

    def parted(x: Column) -> Column:
        def score(i: Column) -> Column:
            # where nothing is wide, a place is as many columns from the start
            left = F.when(F.length(x["t"]) == x["total"], i).otherwise(columns_wide(F.substr(x["t"], F.lit(1), i)))
            after = F.substr(x["t"], i, F.lit(1))
            wider = F.greatest(left, x["total"] - left - F.when(x["spaced"], 1).otherwise(0))
            return F.struct((wider - F.when(after.isin(*STRONG_ENDS, *SOFT_ENDS), 4).otherwise(0)).alias("score"), i.alias("at"))

        def possible(i: Column) -> Column:
            c = F.substr(x["t"], i + 1, F.lit(1))
            return F.when(x["spaced"], c == " ").otherwise(~c.rlike(r"\p{P}"))

        def broken(at: Column) -> Column:
            return F.concat(F.regexp_replace(F.substr(x["t"], F.lit(1), at), r"(?U)\s+$", ""), F.lit("\n"), F.regexp_replace(F.substr(x["t"], at + 1), r"(?U)^\s+", ""))

        places = F.when(F.length(x["t"]) > 1, F.filter(F.sequence(F.lit(1), F.length(x["t"]) - 1), possible))
        return once(F.array_min(F.transform(places, score))["at"], broken)

    wide = F.struct(t.alias("t"), F.contains(t, F.lit(" ")).alias("spaced"), columns_wide(t).alias("total"))
    return F.when(columns_wide(t) > max_columns, F.coalesce(once(wide, parted), t)).otherwise(t)


def language_head(code: Column | str) -> Column:
    """The language without region: "pt-BR" and "pt_PT" are "pt"."""
    return F.lower(F.split(_col(code), "[-_]")[0])


def show_name(file_name: Column | str) -> Column:
    """The show that a file belongs to: what stands before season and episode, else the name without short endings such as
    languages; points and underlines are spaces. Null and empty names have none (an empty string)."""
    t = F.regexp_replace(trimmed(F.coalesce(_col(file_name), F.lit(""))), r"^.*[/\\]", "")
    name = F.regexp_replace(t, r"\.[^.]*$", "")
    before = F.regexp_extract(name, r"^(.*?)[\s._-]*(?:[Ss]\d{1,2}[\s._-]*[Ee]\d{1,3}|\d{1,2}x\d{2,3}|[Ee][Pp]?\d{1,3}\b)", 1)
    short = F.regexp_replace(name, r"(?<=.)(\.[^.]{2,7})+$", "")
    kept = F.when(F.regexp_replace(before, "^[ ._-]+|[ ._-]+$", "") != "", before).otherwise(short)
    return F.regexp_replace(F.regexp_replace(F.translate(kept, "._", "  "), r"\s+", " "), "^[ -]+|[ -]+$", "")

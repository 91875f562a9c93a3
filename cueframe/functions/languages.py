"""Codes of languages: two letters as files are named, three letters as tracks are tagged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the code of each language and the tag of its tracks.
TAGS = {
    "en": "eng", "zh": "chi", "de": "ger", "es": "spa", "ru": "rus", "ko": "kor", "fr": "fre", "ja": "jpn", "pt": "por", "tr": "tur", "pl": "pol", "ca": "cat", "nl": "dut",
    "ar": "ara", "sv": "swe", "it": "ita", "id": "ind", "hi": "hin", "fi": "fin", "vi": "vie", "he": "heb", "uk": "ukr", "el": "gre", "ms": "may", "cs": "cze", "ro": "rum",
    "da": "dan", "hu": "hun", "ta": "tam", "no": "nor", "th": "tha", "ur": "urd", "hr": "hrv", "bg": "bul", "lt": "lit", "la": "lat", "mi": "mao", "ml": "mal", "cy": "wel",
    "sk": "slo", "te": "tel", "fa": "per", "lv": "lav", "bn": "ben", "sr": "srp", "az": "aze", "sl": "slv", "kn": "kan", "et": "est", "mk": "mac", "br": "bre", "eu": "baq",
    "is": "ice", "hy": "arm", "ne": "nep", "mn": "mon", "bs": "bos", "kk": "kaz", "sq": "alb", "sw": "swa", "gl": "glg", "mr": "mar", "pa": "pan", "si": "sin", "km": "khm",
    "sn": "sna", "yo": "yor", "so": "som", "af": "afr", "oc": "oci", "ka": "geo", "be": "bel", "tg": "tgk", "sd": "snd", "gu": "guj", "am": "amh", "yi": "yid", "lo": "lao",
    "uz": "uzb", "fo": "fao", "ht": "hat", "ps": "pus", "tk": "tuk", "nn": "nno", "mt": "mlt", "sa": "san", "lb": "ltz", "my": "bur", "bo": "tib", "tl": "tgl", "mg": "mlg",
    "as": "asm", "tt": "tat", "haw": "haw", "ln": "lin", "ha": "hau", "ba": "bak", "jw": "jav", "jv": "jav", "su": "sun", "nb": "nob", "fil": "fil", "yue": "chi",
}
#: Fixed: other tags that files have.
OTHER_TAGS = {
    "deu": "de", "fra": "fr", "nld": "nl", "ces": "cs", "ron": "ro", "ell": "el", "msa": "ms", "slk": "sk", "fas": "fa", "mkd": "mk", "eus": "eu", "isl": "is", "hye": "hy",
    "kat": "ka", "mya": "my", "bod": "bo", "zho": "zh", "cym": "cy", "sqi": "sq", "mri": "mi", "nob": "no",
}
#: Codes that share a tag with another one, which it stands for.
SECOND = ("yue", "jv", "nb")


def _codes() -> dict[str, str]:
    out = {tag: code for code, tag in reversed(TAGS.items()) if code not in SECOND}
    return OTHER_TAGS | out


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _head(code: Column | str) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.lower(F.split(F.trim(c), "[-_]")[0])


def code_of(tag: Column | str) -> Column:
    """A track's tag as the code of its language: "kor", "ger", "deu" and "en-US" are ko, de, de and en; null for "und" and
    unknown tags."""
    head = _head(tag)
    return F.coalesce(F.element_at(_map(_codes()), head), F.when(F.map_contains_key(_map(TAGS), head), head))


def tag_of(code: Column | str) -> Column:
    """The tag for a code or another tag of a language; null where it is unknown."""
    head, tags = _head(code), _map(TAGS)
    return F.coalesce(F.element_at(tags, head), F.element_at(tags, F.element_at(_map(_codes()), head)))

"""Formatting inside cue text: HTML tags (SRT, WebVTT), override blocks (ASS, SSA) and control codes (MicroDVD).

HTML is the pivot. Italic, bold, underline and the place {\\anN} survive a conversion; what the target cannot say goes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIALECTS = {"ass": "ass", "ssa": "ass", "sub": "microdvd"}
_BLOCK = r"\{\\[^}]*\}"
_FONT = r"(?i)</?font[^>]*>"
_STYLE = r"^\{([yY]):([ibus,]+)\}"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def dialect(file_format: str) -> str:
    return DIALECTS.get(file_format.lower(), "html")


def for_vtt(html: Column | str) -> Column:
    """Without font tags and override blocks, which WebVTT does not know."""
    return F.regexp_replace(F.regexp_replace(_col(html), _FONT, ""), _BLOCK, "")


def ass_to_html(text: Column | str) -> Column:
    """Override blocks as tags. A block's overrides are taken apart one by one; what is not i, b, u or an is dropped."""
    t = F.replace(F.replace(F.replace(_col(text), F.lit("\\N"), F.lit("\n")), F.lit("\\n"), F.lit("\n")), F.lit("\\h"), F.lit(" "))
    # pieces between braces: a text, or a block whose overrides become tags
    pieces = F.regexp_extract_all(t, F.lit(r"(\{[^}]*\}|\{[^}]*$|[^{]+)"), 1)

    def tag(override: Column) -> Column:
        place = F.regexp_extract(override, r"^\\an([1-9])", 1)
        name, value = F.regexp_extract(override, r"^\\([ibu])(\d+)", 1), F.regexp_extract(override, r"^\\([ibu])(\d+)", 2)
        switched = F.concat(F.when(value == "0", "</").otherwise("<"), name, F.lit(">"))
        return F.when(place != "", F.concat(F.lit("{\\an"), place, F.lit("}"))).otherwise(switched)

    def piece(p: Column) -> Column:
        overrides = F.regexp_extract_all(p, F.lit(r"(\\[ibu]\d+|\\an[1-9])"), 1)
        return F.when(p.rlike(r"^\{[^}]*\}$"), F.array_join(F.transform(overrides, tag), "")).otherwise(p)

    return F.array_join(F.transform(pieces, piece), "")


def html_to_ass(html: Column | str) -> Column:
    t = F.regexp_replace(_col(html), _FONT, "")
    for name in "ibu":
        t = F.regexp_replace(F.regexp_replace(t, f"(?i)<{name}>", rf"{{\\{name}1}}"), f"(?i)</{name}>", rf"{{\\{name}0}}")
    t = F.replace(F.regexp_replace(t, r"<[^>]*>", ""), F.lit("}{\\"), F.lit("\\"))
    return F.replace(F.replace(t, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\N"))


def _tags(styles: Column) -> tuple[Column, Column]:
    known = F.array_distinct(F.filter(F.transform(F.split(F.lower(styles), ","), F.trim), lambda s: s.isin("i", "b", "u")))
    return F.array_join(F.transform(known, lambda s: F.concat(F.lit("<"), s, F.lit(">"))), ""), F.array_join(F.transform(F.reverse(known), lambda s: F.concat(F.lit("</"), s, F.lit(">"))), "")


def microdvd_to_html(text: Column | str) -> Column:
    """{Y:..} styles the whole text, {y:..} its line; other codes go. Lines are parted by "|" or line feeds."""
    t = F.translate(F.replace(_col(text), F.lit("\r"), F.lit("")), "\n", "|")
    whole = F.when(F.regexp_extract(t, _STYLE, 1) == "Y", F.regexp_extract(t, _STYLE, 2)).otherwise("")
    rest = F.when(whole != "", F.regexp_replace(t, _STYLE, "")).otherwise(t)

    def line(x: Column) -> Column:
        opened, closed = _tags(F.regexp_extract(x, _STYLE, 2))
        return F.concat(opened, F.regexp_replace(F.regexp_replace(x, _STYLE, ""), r"\{[a-zA-Z]:[^}]*\}", ""), closed)

    opened, closed = _tags(whole)
    return F.concat(opened, F.array_join(F.transform(F.split(rest, r"\|"), line), "\n"), closed)


def html_to_microdvd(html: Column | str) -> Column:
    """Lines that a tag spans whole get its code; all other tags go."""
    t = F.regexp_replace(F.replace(_col(html), F.lit("\r"), F.lit("")), _BLOCK, "")

    def line(x: Column) -> Column:
        state = F.struct(x.alias("text"), F.array().cast("array<string>").alias("styles"))

        def step(s: Column, name: Column) -> Column:
            bare = F.regexp_replace(s["text"], r"^\s+|\s+$", "")
            low = F.lower(bare)
            around = F.startswith(low, F.concat(F.lit("<"), name, F.lit(">"))) & F.endswith(low, F.concat(F.lit("</"), name, F.lit(">"))) & (F.length(low) >= 7)
            inner = F.substr(bare, F.lit(4), F.greatest(F.length(bare) - 7, F.lit(0)))
            return F.when(around, F.struct(inner.alias("text"), F.concat(s["styles"], F.array(name)).alias("styles"))).otherwise(s)

        done = F.aggregate(F.array(F.lit("i"), F.lit("b"), F.lit("u")), state, step)
        code = F.when(F.size(done["styles"]) > 0, F.concat(F.lit("{y:"), F.array_join(done["styles"], ","), F.lit("}"))).otherwise("")
        return F.concat(code, F.regexp_replace(done["text"], r"<[^>]*>", ""))

    return F.array_join(F.transform(F.split(t, "\n"), line), "|")


def convert(text: Column | str, source: str, target: str) -> Column:
    """A text of one file format in the dialect of another; formats of one dialect keep it as it is."""
    a, b = dialect(source), dialect(target)
    if a == b:
        return _col(text)
    html = {"ass": ass_to_html, "microdvd": microdvd_to_html}.get(a, _col)(text)
    return {"ass": html_to_ass, "microdvd": html_to_microdvd}.get(b, _col)(html)

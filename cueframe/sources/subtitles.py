"""Subtitle files: SubRip (srt), WebVTT (vtt), SubStation Alpha (ass, ssa) and MicroDVD (sub).

Readers take texts (key, text), one row for each file, and give cues (key, ord, start_us, end_us, text, extra), ord from
1, and documents (key, header, trailer, frame_rate, frame_rate_assumed, problem). They run on lines, dealt by key once; windows
in the order of the lines say which cue a line belongs to. A file that is not of its format has no cues and a problem.
Writers take cues (key, ord, start_us, end_us, text[, extra]) and give files (key, text); a file is one value. A key or
text that is null stays null or counts as empty; keys that repeat are read as one file, so they should not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import once
from ..functions.time import format_ass, format_srt, format_vtt, parse_timecode
from .text_files import decoded, numbered_lines, read_files

TIMING = r"^\s*((?:\d+:)?\d{1,2}:\d{1,2}(?:[,.:]\d{1,3})?)\s*-->\s*((?:\d+:)?\d{1,2}:\d{1,2}(?:[,.:]\d{1,3})?)(.*)$"
#: Fixed: the columns of events where a script names none.
EVENT_COLUMNS = {
    "ass": "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
    "ssa": "Marked, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
}
DEFAULT_RATE = 23.976
EXTRA = "map<string,string>"
NO_HEADER, NO_EVENTS, NO_LINES, PICTURES, BINARY = "not a WebVTT file", "no [Events] section", "no MicroDVD lines", "picture subtitles", "binary data"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _strip_end(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def _by_line() -> Window:
    return Window.partitionBy("key").orderBy("i")


def _joined(separator: str = "\n", when: Column | None = None, value: Column | str = "line") -> Column:
    """An aggregate: the values in the order of lines."""
    value = F.col(value) if isinstance(value, str) else value
    item = F.struct("i", value.alias("line"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(item if when is None else F.when(when, item))), lambda x: x["line"]), separator)


def _documents(texts: DataFrame, found: DataFrame, problem: Column) -> DataFrame:
    """One row for each file, whatever was found in it."""
    columns = {"header": "string", "trailer": "string", "frame_rate": "double", "frame_rate_assumed": "boolean"}
    have = texts.select("key").distinct().join(found, "key", "left")
    for name, kind in columns.items():
        if name not in found.columns:
            have = have.withColumn(name, F.lit(None).cast(kind))
    return have.select("key", *columns, problem.alias("problem"))


def parse_srt(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A line of times opens a cue; its text ends at a blank line, at another line of times, or at a number above one."""
    lines = numbered_lines(texts)
    w = _by_line()
    timed = F.col("line").rlike(TIMING)
    start, end = (parse_timecode(F.regexp_extract("line", TIMING, k)) for k in (1, 2))
    lines = lines.withColumns({"timed": timed, "start_us": F.when(timed, start), "end_us": F.when(timed, end)})
    number = _strip(F.col("line")).rlike(r"^\p{Nd}+$") & F.coalesce(F.lead("timed").over(w), F.lit(False))
    opens = F.col("start_us").isNotNull() & F.col("end_us").isNotNull()
    mark = F.when(opens, 1).when(F.col("timed") | (_strip(F.col("line")) == "") | number, 0)
    lines = lines.withColumns({"opens": opens, "mark": mark})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"ord": F.sum(F.col("opens").cast("int")).over(upto), "inside": F.last("mark", ignorenulls=True).over(upto)})
    rows = lines.where((F.col("inside") == 1) & (F.col("opens") | F.col("mark").isNull()))
    cues = rows.groupBy("key", "ord").agg(
        F.max(F.when(F.col("opens"), F.col("start_us"))).alias("start_us"), F.max(F.when(F.col("opens"), F.col("end_us"))).alias("end_us"), _joined(when=~F.col("opens"), value=_strip_end(F.col("line"))).alias("text")
    )
    return cues.select("key", "ord", "start_us", "end_us", "text", F.lit(None).cast(EXTRA).alias("extra")), _documents(texts, texts.select("key").distinct(), F.lit(None).cast("string"))


def parse_vtt(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks between blank lines. The first begins with WEBVTT; notes go, styles and regions before the first cue belong to
    the header; a cue has its times in its first or second line, then its id in the first."""
    lines = numbered_lines(texts).withColumn("line", _strip_end(F.col("line")))
    w = _by_line()
    new = (F.col("line") != "") & (F.coalesce(F.lag("line").over(w), F.lit("")) == "")
    blocks = lines.withColumn("block", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("line <> ''")
    blocks = blocks.groupBy("key", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("lines"))
    first, second = F.col("lines")[0], F.get("lines", F.lit(1))
    head = F.regexp_replace(first, r"(?U)^\s+", "")
    timing = F.when(first.rlike(TIMING), 0).when(second.rlike(TIMING), 1)
    line = F.when(timing == 0, first).otherwise(second)
    start, end = (parse_timecode(F.regexp_extract(line, TIMING, k)) for k in (1, 2))
    blocks = blocks.withColumns({"at": timing, "start_us": F.when(timing.isNotNull(), start), "end_us": F.when(timing.isNotNull(), end), "settings": F.when(timing.isNotNull(), _strip(F.regexp_extract(line, TIMING, 3)))})
    order = Window.partitionBy("key").orderBy("block")
    look = F.startswith(head, F.lit("STYLE")) | F.startswith(head, F.lit("REGION"))
    good = (F.col("block") > 1) & ~F.startswith(head, F.lit("NOTE")) & F.col("start_us").isNotNull() & F.col("end_us").isNotNull()
    blocks = blocks.withColumns({"look": look, "good": F.coalesce(good, F.lit(False)), "note": F.startswith(head, F.lit("NOTE")), "head": F.regexp_replace(first, "^﻿+", "")})
    started = F.coalesce(F.max(F.col("good") & ~F.col("look")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    valid = F.max((F.col("block") == 1) & F.startswith("head", F.lit("WEBVTT"))).over(Window.partitionBy("key"))
    blocks = blocks.withColumns({"started": started, "valid": valid})
    cue = F.col("valid") & F.col("good") & (~F.col("look") | F.col("started"))
    pairs = F.filter(F.array(F.struct(F.lit("id").alias("k"), F.when(F.col("at") == 1, _strip(first)).alias("v")), F.struct(F.lit("settings").alias("k"), F.when(F.col("settings") != "", F.col("settings")).alias("v"))), lambda p: p["v"].isNotNull())
    cues = blocks.where(cue).withColumn("ord", F.row_number().over(order))
    text = F.array_join(F.slice("lines", F.col("at") + 2, F.size("lines")), "\n")
    cues = cues.select("key", F.col("ord").cast("long").alias("ord"), "start_us", "end_us", text.alias("text"), F.when(F.size(pairs) > 0, F.map_from_entries(pairs)).alias("extra"))
    headers = blocks.where((F.col("block") == 1) | F.col("look") & ~F.col("started") & ~F.col("note"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", F.array_join("lines", "\n").alias("line")))), lambda x: x["line"]), "\n\n")
    found = headers.groupBy("key").agg(F.max("valid").alias("valid"), body.alias("header"))
    found = found.withColumn("header", F.when(F.col("valid"), F.col("header")))
    return cues, _documents(texts, found, F.when(F.coalesce(F.col("valid"), F.lit(False)), F.lit(None)).otherwise(NO_HEADER))


def _last_of_each(names: Column, values: Column) -> Column:
    """A map of names and values; of equal names the last counts."""
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    later = lambda p, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda n: n == p["k"])
    return F.map_from_entries(F.filter(pairs, later))


def parse_ass(texts: DataFrame, kind: str = "ass") -> tuple[DataFrame, DataFrame]:
    """Events by the columns that the last Format line names; the last column keeps its commas. What stands before the
    events is the header, sections behind them the trailer. Names in `extra` are lower case; _kind is set for comments."""
    lines = numbered_lines(texts).withColumn("line", _strip_end(F.col("line")))
    lines = lines.withColumn("bare", _strip(F.col("line")))
    w = _by_line().rowsBetween(Window.unboundedPreceding, 0)
    section = F.when(F.startswith("bare", F.lit("[")) & F.endswith("bare", F.lit("]")), F.lower("bare"))
    lines = lines.withColumn("opened", section)
    lines = lines.withColumns({"section": F.last("opened", ignorenulls=True).over(w), "saw": F.coalesce(F.max(F.col("opened") == "[events]").over(w), F.lit(False))})
    lines = lines.withColumn("after", F.coalesce(F.max(F.col("saw") & F.col("opened").isNotNull() & (F.col("opened") != "[events]")).over(w), F.lit(False)))
    events = ~F.col("after") & (F.col("section") == "[events]")
    named = F.when(events & F.col("bare").rlike("(?i)^Format:"), F.substr("bare", F.lit(8)))
    event = F.when(events & F.col("bare").rlike("(?i)^Dialogue:"), "Dialogue").when(events & F.col("bare").rlike("(?i)^Comment:"), "Comment")
    lines = lines.withColumns({"named": named, "event": event})
    lines = lines.withColumns({"names": F.last("named", ignorenulls=True).over(w), "begun": F.coalesce(F.max(F.col("named").isNotNull() | F.col("event").isNotNull()).over(w), F.lit(False))})

    columns = F.transform(F.split(F.coalesce("names", F.lit(EVENT_COLUMNS[kind])), ",", -1), lambda c: F.lower(_strip(c)))
    payload = F.regexp_replace(F.substr("bare", F.length("event") + 2), r"(?U)^\s+", "")
    # the limit of a split is no column, so what is too much is joined again
    whole = lambda e: F.concat(F.slice(e["parts"], F.lit(1), F.size(e["columns"]) - 1), F.array(F.array_join(F.slice(e["parts"], F.size(e["columns"]), F.size(e["parts"])), ",")))
    found = F.filter(F.array(F.struct(columns.alias("columns"), F.split(payload, ",", -1).alias("parts"))), lambda e: F.size(e["parts"]) >= F.size(e["columns"]))
    # exploded, so that no filter is pushed below and parts the line again
    rows = lines.where("event is not null").withColumn("e", F.explode_outer(F.transform(found, lambda e: F.struct(e["columns"].alias("columns"), whole(e).alias("parts"))))).where("e is not null")
    # of equal names the last counts
    last = lambda name: F.get("e.parts", F.size("e.columns") - F.array_position(F.reverse("e.columns"), name).cast("int"))
    times = {f"{x}_us": F.when(F.array_contains("e.columns", x), once(last(x), parse_timecode)).otherwise(F.lit(0)) for x in ("start", "end")}
    fields = _last_of_each(F.col("e.columns"), F.col("e.parts"))
    extra = F.map_filter(fields, lambda k, _: ~k.isin("start", "end", "text"))
    extra = F.map_concat(F.transform_values(extra, lambda _, v: _strip(v)), F.when(F.col("event") == "Comment", F.create_map(F.lit("_kind"), F.lit("Comment"))).otherwise(F.create_map().cast(EXTRA)))
    rows = rows.withColumns(times).where("start_us is not null and end_us is not null")
    ordered = rows.withColumn("ord", F.row_number().over(Window.partitionBy("key").orderBy("i")))
    cues = ordered.select("key", F.col("ord").cast("long").alias("ord"), "start_us", "end_us", F.replace(F.coalesce(last("text"), F.lit("")), F.lit("\\N"), F.lit("\n")).alias("text"), extra.alias("extra"))

    head = ~F.col("after") & (F.col("named").isNotNull() | F.col("event").isNull() & ~(F.coalesce(F.col("section") == "[events]", F.lit(False)) & F.col("begun")))
    found = lines.groupBy("key").agg(
        _joined(when=head).alias("header"), _joined(when=F.col("after")).alias("trailer"), F.max("saw").alias("saw"), F.max("begun").alias("begun"), F.max(F.col("after").cast("int")).alias("tail")
    )
    default = F.when(~F.col("begun"), F.concat(F.lit("\nFormat: "), F.lit(EVENT_COLUMNS[kind]))).otherwise("")
    found = found.withColumns({"header": F.when(F.col("saw"), F.regexp_replace(F.concat("header", default), "\n+$", "")), "trailer": F.when(F.col("tail") == 1, F.regexp_replace("trailer", "\n+$", ""))})
    return cues, _documents(texts, found, F.when(F.coalesce(F.col("saw"), F.lit(False)), F.lit(None)).otherwise(NO_EVENTS))


def parse_sub(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """{start}{end}text by frames; a first line {1}{1}rate gives their rate. Without an end a cue lasts until the next one
    starts, the last 3 seconds."""
    code = r"^\{(\d{1,18})\}\{(\d{0,18})\}(.*)$"
    lines = numbered_lines(texts).withColumn("line", _strip(F.col("line"))).where(F.col("line").rlike(code))
    lines = lines.withColumns({"s": F.regexp_extract("line", code, 1).cast("long"), "e": F.regexp_extract("line", code, 2).try_cast("long"), "text": F.regexp_extract("line", code, 3)})
    lines = lines.withColumn("n", F.row_number().over(_by_line()))
    rate = F.when(F.trim("text").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim("text").try_cast("double"))
    is_rate = (F.col("n") == 1) & (F.col("s") <= 1) & (F.coalesce("e", F.lit(0)) <= 1) & (rate > 1) & (rate < 200)
    lines = lines.withColumn("rate", F.when(is_rate, rate))
    lines = lines.withColumn("given", F.max("rate").over(Window.partitionBy("key")))
    found = lines.groupBy("key").agg(F.coalesce(F.max("rate"), F.lit(DEFAULT_RATE)).alias("frame_rate"), F.max("rate").isNull().alias("frame_rate_assumed"))
    us = lambda frames: F.round(frames / F.coalesce("given", F.lit(DEFAULT_RATE)) * 1_000_000).cast("long")
    rows = lines.where("rate is null").withColumn("next", F.lead("s").over(_by_line())).withColumn("ord", F.row_number().over(_by_line()))
    end = F.coalesce(us(F.col("e")), us(F.col("next")), us(F.col("s")) + 3_000_000)
    cues = rows.select("key", F.col("ord").cast("long").alias("ord"), us(F.col("s")).alias("start_us"), end.alias("end_us"), F.translate("text", "|", "\n").alias("text"), F.lit(None).cast(EXTRA).alias("extra"))
    return cues, _documents(texts, found, F.when(F.col("frame_rate").isNotNull(), F.lit(None)).otherwise(NO_LINES))


PARSERS = {"srt": parse_srt, "vtt": parse_vtt, "ass": parse_ass, "ssa": lambda t: parse_ass(t, "ssa"), "sub": parse_sub}


def file_format(path: Column | str) -> Column:
    """A file's format by its extension: srt, vtt, ass, ssa or sub; pictures for idx and sup; else null."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*PARSERS), ext).when(ext.isin("idx", "sup"), "pictures")


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, documents) of (key, content), each file by its extension; documents have format and encoding as well. Files
    of other kinds have a problem and no cues, and so do .sub files that hold pictures or other binary data."""
    head = F.substr("content", F.lit(1), F.lit(4096))
    # bytes as pairs of hex digits: how many of them are zero
    zeros = F.size(F.filter(F.regexp_extract_all(F.hex(head), F.lit("(..)"), 1), lambda b: b == "00"))
    is_sub = F.col("format") == "sub"
    bad = F.when(F.col("format") == "pictures", PICTURES).when(is_sub & (F.hex(F.substr("content", F.lit(1), F.lit(4))) == "000001BA"), PICTURES).when(is_sub & (zeros > 16), BINARY).when(F.col("format").isNull(), "unknown format")
    kinds = files.withColumn("format", file_format("key")).withColumn("bad", bad)
    texts = decoded(kinds.where("bad is null")).withColumn("format", file_format("key"))
    cues, documents = None, kinds.where("bad is not null").select("key", *(F.lit(None).cast(t).alias(c) for c, t in (("header", "string"), ("trailer", "string"), ("frame_rate", "double"), ("frame_rate_assumed", "boolean"))), F.col("bad").alias("problem"))
    for name, parse in PARSERS.items():
        found, said = parse(texts.where(F.col("format") == name).select("key", "text"))
        cues = found if cues is None else cues.unionByName(found)
        documents = documents.unionByName(said)
    return cues, documents.join(texts.select("key", "encoding"), "key", "left").withColumn("format", file_format("key"))


def read_subtitles(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(cues, documents) of all subtitle files below a path."""
    return parse_files(read_files(spark, path))


# writers


def _file(cues: DataFrame, block: Column, head: Column | str = "", tail: Column | str = "") -> DataFrame:
    """One text for each key: the blocks in order, line ends as CRLF."""
    head, tail = (F.lit(x) if isinstance(x, str) else x for x in (head, tail))
    rows = cues.select("key", F.struct("ord", block.alias("block")).alias("b"), head.alias("head"), tail.alias("tail"))
    whole = rows.groupBy("key").agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.sort_array(F.collect_list("b")).alias("blocks"))
    text = F.concat("head", F.array_join(F.transform("blocks", lambda b: b["block"]), ""), "tail")
    return whole.select("key", F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n")).alias("text"))


def _numbered(cues: DataFrame) -> DataFrame:
    return cues.withColumn("idx", F.row_number().over(Window.partitionBy("key").orderBy("ord")))


def _rtrim(text: Column) -> Column:
    return F.regexp_replace(text, "\n+$", "")


def render_srt(cues: DataFrame, source: str = "srt") -> DataFrame:
    """SubRip texts. source: the format whose markup the cues have. Files begin with a byte order mark; see encoded()."""
    times = F.concat(format_srt("start_us"), F.lit(" --> "), format_srt("end_us"))
    text = _rtrim(markup.convert(F.coalesce("text", F.lit("")), source, "srt"))
    return _file(_numbered(cues), F.concat(F.col("idx").cast("string"), F.lit("\n"), times, F.lit("\n"), text, F.lit("\n\n")))


def render_vtt(cues: DataFrame, source: str = "vtt", documents: DataFrame | None = None) -> DataFrame:
    """WebVTT texts. documents: (key, header) of files that were WebVTT; their ids and settings stay as well."""
    same = source == "vtt"
    extra = lambda k: F.coalesce(F.col("extra")[k], F.lit("")) if same and "extra" in cues.columns else F.lit("")
    text = _rtrim(F.replace(markup.for_vtt(markup.convert(F.coalesce("text", F.lit("")), source, "vtt")), F.lit("-->"), F.lit("->")))
    block = F.concat(
        F.when(extra("id") != "", F.concat(extra("id"), F.lit("\n"))).otherwise(""), format_vtt("start_us"), F.lit(" --> "), format_vtt("end_us"),
        F.when(extra("settings") != "", F.concat(F.lit(" "), extra("settings"))).otherwise(""), F.lit("\n"), text, F.lit("\n\n"),
    )
    if documents is None or not same:
        return _file(cues, block, "WEBVTT\n\n")
    known = cues.join(documents.select("key", F.col("header").alias("_header")), "key", "left")
    head = F.when(_strip(F.coalesce("_header", F.lit(""))) != "", _strip(F.col("_header"))).otherwise("WEBVTT")
    return _file(known, block, F.concat(head, F.lit("\n\n")))


#: Fixed: what a new script says of itself, and the values of event columns that a cue has none for.
_STYLE_COLUMNS = {
    "ass": "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
    "ssa": "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, TertiaryColour, BackColour, Bold, Italic, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, AlphaLevel, Encoding",
}
_STYLE_VALUES = {"ass": "Default,Arial,64,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,3,1,2,40,40,50,1", "ssa": "Default,Arial,64,16777215,255,0,0,0,0,1,3,1,2,40,40,50,0,1"}
DEFAULT_VALUES = {"layer": "0", "marked": "Marked=0", "style": "Default", "marginl": "0", "marginr": "0", "marginv": "0"}


def script_header(kind: str) -> str:
    """The head of a new script, up to the names of the event columns."""
    info = ["[Script Info]", "ScriptType: v4.00" + "+" * (kind == "ass"), "PlayResX: 1920", "PlayResY: 1080", *(["WrapStyle: 0", "ScaledBorderAndShadow: yes"] if kind == "ass" else [])]
    styles = ["[V4+ Styles]" if kind == "ass" else "[V4 Styles]", f"Format: {_STYLE_COLUMNS[kind]}", f"Style: {_STYLE_VALUES[kind]}"]
    return "\n".join([*info, "", *styles, "", "[Events]", f"Format: {EVENT_COLUMNS[kind]}"])


def render_ass(cues: DataFrame, source: str = "ass", documents: DataFrame | None = None, kind: str = "ass") -> DataFrame:
    """SubStation Alpha texts. documents: (key, header, trailer) of files that were of this kind: their head, their columns,
    what `extra` has for these, and their tail stay."""
    same = source == kind and documents is not None
    rows = cues.join(documents.select("key", F.col("header").alias("_header"), F.col("trailer").alias("_trailer")), "key", "left") if same else cues.withColumns({"_header": F.lit(None).cast("string"), "_trailer": F.lit(None).cast("string")})
    own = _strip(F.coalesce("_header", F.lit(""))) != ""
    head = F.when(own, _strip_end(F.col("_header"))).otherwise(script_header(kind))
    formats = F.filter(F.transform(F.split(head, "\n"), _strip), lambda x: x.rlike("(?i)^Format:"))
    names = F.when(F.size(formats) > 0, F.substr(F.element_at(formats, -1), F.lit(8))).otherwise(EVENT_COLUMNS[kind])
    extra = F.col("extra") if "extra" in cues.columns else F.lit(None).cast(EXTRA)
    text = F.coalesce("text", F.lit(""))
    text = text if markup.dialect(source) == "ass" else markup.convert(text, source, kind)
    text = F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\N"))
    defaults = F.create_map(*(F.lit(x) for pair in DEFAULT_VALUES.items() for x in pair))

    def value(name: Column) -> Column:
        known = F.when(own, F.element_at(extra, name))
        return F.when(name == "start", format_ass("start_us")).when(name == "end", format_ass("end_us")).when(name == "text", text).otherwise(F.coalesce(known, F.element_at(defaults, name), F.lit("")))

    values = F.array_join(F.transform(F.split(names, ","), lambda c: value(F.lower(_strip(c)))), ",")
    said = F.coalesce(F.when(own, F.element_at(extra, F.lit("_kind"))), F.lit("Dialogue"))
    tail = F.when(own & (_strip(F.coalesce("_trailer", F.lit(""))) != ""), F.concat(F.lit("\n"), _strip_end(F.col("_trailer")), F.lit("\n"))).otherwise("")
    return _file(rows, F.concat(said, F.lit(": "), values, F.lit("\n")), F.concat(head, F.lit("\n")), tail)


def render_sub(cues: DataFrame, source: str = "sub", frame_rate: float = DEFAULT_RATE) -> DataFrame:
    """MicroDVD texts at a frame rate, which the first line names; times before 0 count as 0."""
    frame = lambda c: F.floor(F.greatest(F.col(c), F.lit(0)) / 1_000_000 * frame_rate + 0.5).cast("string")
    text = F.coalesce("text", F.lit(""))
    text = F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("|")) if source == "sub" else markup.convert(text, source, "sub")
    rate = f"{frame_rate:.3f}".rstrip("0").rstrip(".")
    return _file(cues, F.concat(F.lit("{"), frame("start_us"), F.lit("}{"), frame("end_us"), F.lit("}"), text, F.lit("\n")), f"{{1}}{{1}}{rate}\n")


def encoded(files: DataFrame, kind: str) -> DataFrame:
    """(key, content): UTF-8, with a byte order mark but for WebVTT."""
    mark = b"" if kind == "vtt" else b"\xef\xbb\xbf"
    return files.select("key", F.concat(F.lit(mark), F.encode("text", "UTF-8")).alias("content"))

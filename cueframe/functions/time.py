"""Media times as whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CODE = r"^\s*(-)?(?:(?:(\d+):)?(\d{1,2}):)?(\d{1,2})(?:[,.:](\d{1,3}))?\s*$"


def parse_timecode(text: Column | str) -> Column:
    """[-][[h:]m:]s[.fff] as microseconds (the fraction behind a point, comma or colon); null where it is none. Minutes and
    seconds may exceed 59 only where seconds stand alone."""
    t = F.col(text) if isinstance(text, str) else text

    def part(k: int) -> Column:
        return F.regexp_extract(t, _CODE, k)

    def number(c: Column) -> Column:
        return F.when(c == "", F.lit(0)).otherwise(c.try_cast("long"))

    h, m, s = number(part(2)), number(part(3)), number(part(4))
    ms = number(F.when(part(5) == "", F.lit("")).otherwise(F.rpad(part(5), 3, "0")))
    total = ((h * 60 + m) * 60 + s) * 1_000_000 + ms * 1000
    good = t.rlike(_CODE) & ((part(3) == "") | (s < 60) & (m < 60))
    return F.when(good, F.when(part(1) == "-", -total).otherwise(total))


def _parts(us: Column, unit: int) -> tuple[Column, Column, Column, Column]:
    whole = F.greatest(us, F.lit(0))
    n = F.floor((whole + unit // 2) / unit).cast("long")
    per = 1_000_000 // unit
    s = F.floor(n / per).cast("long")
    return F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60, n % per


def format_srt(us: Column | str) -> Column:
    """hh:mm:ss,fff; negative times are zero."""
    us = F.col(us) if isinstance(us, str) else us
    return F.format_string("%02d:%02d:%02d,%03d", *_parts(us, 1000))


def format_editor(us: Column | str) -> Column:
    """As format_srt, with a sign for times before 0."""
    us = F.col(us) if isinstance(us, str) else us
    return F.concat(F.when(us < 0, "-").otherwise(""), format_srt(F.abs(us)))


def format_vtt(us: Column | str) -> Column:
    return F.translate(format_srt(us), ",", ".")


def format_ass(us: Column | str) -> Column:
    """h:mm:ss.cc, rounded half up to hundredths."""
    us = F.col(us) if isinstance(us, str) else us
    return F.format_string("%d:%02d:%02d.%02d", *_parts(us, 10_000))


def for_people(us: Column | str) -> Column:
    """1:04:10 from an hour on, else 3 min 12 s, else 12 s."""
    us = F.col(us) if isinstance(us, str) else us
    h, m, s, _ = _parts(us, 1_000_000)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).when(m > 0, F.format_string("%d min %d s", m, s)).otherwise(F.format_string("%d s", s))


def file_size(size: Column | str) -> Column:
    size = F.col(size) if isinstance(size, str) else size
    return (
        F.when(size >= 1 << 30, F.format_string("%.1f GB", size / (1 << 30)))
        .when(size >= 1 << 20, F.format_string("%.1f MB", size / (1 << 20)))
        .when(size >= 1 << 10, F.format_string("%.0f KB", size / (1 << 10)))
        .otherwise(F.format_string("%d B", size))
    )


def frame_of(us: Column | str, frame_us: int = 10_000) -> Column:
    """The nearest frame, half to even."""
    us = F.col(us) if isinstance(us, str) else us
    return F.bround(us / frame_us, 0).cast("long")


def time_of_frame(frame: Column | str, frame_us: int = 10_000) -> Column:
    frame = F.col(frame) if isinstance(frame, str) else frame
    return (frame * frame_us).cast("long")

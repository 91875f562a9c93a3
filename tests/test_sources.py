"""Readers and writers of subtitle files, on hand-made bytes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cueframe.functions import markup
from cueframe.sources.subtitles import encoded, parse_files, read_subtitles, render_ass, render_srt, render_sub, render_vtt
from cueframe.sources.text_files import decoded

SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,5\r\nOne \r\nline two\r\n\r\nnoise\r\n2\r\n00:00:03.000-->00:00:04:050 X1:3\r\n7\r\nafter a number\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\n00:00:07,000 --> 00:00:06,000\r\nback\r\n101:00:00,000 --> 101:00:01,000"
VTT = "WEBVTT - title\nKind: x\n\nSTYLE\n::cue{}\n\nNOTE no\ncue\n\nid one\n00:01.000 --> 00:02.000 align:start\n<i>Hi</i>\nthere\n\n00:00:03.000 --> 00:00:04.000\n\nSTYLE\nlate\n\nonly text\n"
ASS = (
    "[Script Info]\nTitle: t\n\n[Events]\nFormat: Start, End, Style, start , Text\n; a note\nDialogue: 0:00:09.00,0:00:02.50,Top,0:00:01.00,Hello, {\\i1}you\\Nthere\n"
    "Comment: 0:00:03.00,0:00:04.00,,0:00:03.00,said\nDialogue: broken\nstray\n\n[Fonts]\nfontname: x\n"
)
SUB = "{1}{1}25\n{25}{50}a|b\n{75}{}{y:i}open\n{100}{}last\nnoise"


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("a/x.srt", SRT.encode()), ("a/x.vtt", VTT.encode()), ("a/x.ASS", ASS.encode()), ("a/x.sub", SUB.encode()), ("bad.vtt", b"nothing"), ("bad.ass", b"[Script Info]\n"),
        ("bad.sub", b"no codes"), ("pic.sub", b"\x00\x00\x01\xba1234"), ("bin.sub", b"\x00" * 40), ("pic.idx", b"x"), ("what.txt", b"x"), ("empty.srt", b""), ("null.srt", None),
        ("head.ssa", b"[Events]\nDialogue: Marked=0,0:00:01.00,0:00:02.00,Default,,0,0,0,,text, more"),
    ]
    return spark.createDataFrame(rows, "key string, content binary")


def test_parsing(files):
    cues, documents = parse_files(files)
    found = {}
    for r in sorted(cues.collect(), key=lambda r: (r.key, r.ord)):
        found.setdefault(r.key, []).append((r.ord, r.start_us / 1e6, r.end_us / 1e6, r.text, r.extra))
    assert found == {
        "a/x.srt": [(1, 1.0, 2.5, "One\nline two", None), (2, 3.0, 4.05, "7\nafter a number", None), (3, 5.0, 6.0, "", None), (4, 7.0, 6.0, "back", None), (5, 363600.0, 363601.0, "", None)],
        "a/x.vtt": [(1, 1.0, 2.0, "<i>Hi</i>\nthere", {"id": "id one", "settings": "align:start"}), (2, 3.0, 4.0, "", None)],
        "a/x.ASS": [(1, 1.0, 2.5, "Hello, {\\i1}you\nthere", {"style": "Top"}), (2, 3.0, 4.0, "said", {"style": "", "_kind": "Comment"})],
        "a/x.sub": [(1, 1.0, 2.0, "a\nb", None), (2, 3.0, 4.0, "{y:i}open", None), (3, 4.0, 7.0, "last", None)],
        "head.ssa": [(1, 1.0, 2.0, "text, more", {"marked": "Marked=0", "style": "Default", "name": "", "marginl": "0", "marginr": "0", "marginv": "0", "effect": ""})],
    }
    said = {r.key: r for r in documents.collect()}
    assert len(said) == files.count()
    assert said["a/x.vtt"].header == "WEBVTT - title\nKind: x\n\nSTYLE\n::cue{}" and said["a/x.srt"].encoding == "UTF-8 (BOM)"
    assert said["a/x.ASS"].header == "[Script Info]\nTitle: t\n\n[Events]\nFormat: Start, End, Style, start , Text" and said["a/x.ASS"].trailer == "[Fonts]\nfontname: x"
    assert (said["a/x.sub"].frame_rate, said["a/x.sub"].frame_rate_assumed) == (25.0, False)
    problems = {k: r.problem for k, r in said.items() if r.problem}
    assert problems == {
        "bad.vtt": "not a WebVTT file", "bad.ass": "no [Events] section", "bad.sub": "no MicroDVD lines", "pic.sub": "picture subtitles", "bin.sub": "binary data", "pic.idx": "picture subtitles",
        "what.txt": "unknown format",
    }


def test_encodings(spark):
    text = "é “x”\nб"
    rows = [
        ("u8", text.encode()), ("u8b", b"\xef\xbb\xbf" + text.encode()), ("16le", b"\xff\xfe" + text.encode("utf-16-le")), ("16be", b"\xfe\xff" + text.encode("utf-16-be")),
        ("32le", b"\xff\xfe\x00\x00" + text.encode("utf-32-le")), ("1252", "é “x” €\r\nŸ\rz".encode("cp1252")), ("odd", b"\xff\xfea\x00b"), ("torn", b"\xef\xbb\xbfa\xff"),
    ]
    found = {r.key: (r.text, r.encoding) for r in decoded(spark.createDataFrame(rows, "key string, content binary")).collect()}
    assert found == {
        "u8": (text, "UTF-8"), "u8b": (text, "UTF-8 (BOM)"), "16le": (text, "UTF-16 LE"), "16be": (text, "UTF-16 BE"), "32le": (text, "UTF-32 LE"),
        "1252": ("é “x” €\nŸ\nz", "Windows-1252"), "odd": ("a�", "UTF-16 LE"), "torn": ("a�", "UTF-8 (BOM)"),
    }


def test_round_trips(spark, files, tmp_path):
    cues, documents = parse_files(files)
    for name, render in (("a/x.srt", render_srt), ("a/x.vtt", lambda c: render_vtt(c, documents=documents)), ("a/x.ASS", lambda c: render_ass(c, documents=documents)), ("a/x.sub", lambda c: render_sub(c, frame_rate=25.0))):
        kind = name[-3:].lower()
        mine = cues.where(F.col("key") == name)
        [file] = encoded(render(mine), kind).collect()
        (tmp_path / f"y.{kind}").write_bytes(bytes(file.content))
        assert (bytes(file.content)[:3] == b"\xef\xbb\xbf") == (kind != "vtt") and b"\r\n" in bytes(file.content)
        again, _ = read_subtitles(spark, str(tmp_path / f"y.{kind}"))
        columns = ["ord", "start_us", "end_us", "text", "extra"]
        assert again.select(columns).orderBy("ord").collect() == mine.select(columns).orderBy("ord").collect()


def test_markup(spark):
    cases = [
        ("srt", "ass", "<i>a</i> <FONT x>b</font>\n<u>c", "{\\i1}a{\\i0} b\\N{\\u1}c"), ("srt", "ass", "{\\an8}<b>x</b>", "{\\an8\\b1}x{\\b0}"),
        ("ass", "srt", "{\\an8\\i1\\fs20}a\\Nb{\\i0}{note}\\hc", "{\\an8}<i>a\nb</i>\u00a0c"), ("ass", "vtt", "{unclosed", "{unclosed"),
        ("sub", "srt", "{Y:i,b}a|{y:u}b{c:$0000}", "<i><b>a\n<u>b</u></b></i>"), ("srt", "sub", "<i><b>a</b></i>\n<u>b</u> c", "{y:i,b}a|b c"), ("srt", "vtt", "<i>k", "<i>k"),
    ]
    row = spark.range(1).select(*(markup.convert(F.lit(t), a, b).alias(f"c{i}") for i, (a, b, t, _) in enumerate(cases))).first()
    assert list(row) == [w for *_, w in cases]
    assert spark.range(1).select(markup.for_vtt(F.lit("<font c>a</font>{\\an8}<i>b</i>"))).first()[0] == "a<i>b</i>"

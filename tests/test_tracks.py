"""Spans, fitting and tracks against plain Python."""

from __future__ import annotations

import random

import pytest

from cueframe.functions import lines
from cueframe.operators import spans, tracks
from cueframe.plans import pipelines

from .test_brute_force import column


def plain_growth(a, b, levels, usual, before=150, after=100, bridge=15):
    """One frame after another."""
    level = lambda f: levels.get(f, -120.0)
    inside = sorted(levels[f] for f in range(max(0, a), b) if f in levels)
    own = inside[len(inside) * 3 // 4] if inside else usual
    threshold = max((usual if own < usual - 40 else own) - 30, -65)
    goes = lambda f, way: any(level(f + way * k) > threshold for k in range(bridge + 1))
    f, t = a, b
    while a - f < before and goes(f - 1, -1):
        f -= 1
    while t - b < after and goes(t, 1):
        t += 1
    # growth ends at a voiced frame unless the limit cuts it
    return f, t


@pytest.mark.parametrize("sparse", [False, True])
def test_spans_over_a_voice(spark, sparse):
    r = random.Random(3 + sparse)
    levels, given = [], []
    for key in range(12):
        series, f = {}, 0
        while f < 1500:
            loud = r.random() < 0.5
            for _ in range(r.choice([1, 4, 14, 15, 16, 17, 40, 200])):
                if not (sparse and r.random() < 0.7):
                    series[f] = r.uniform(-40, -20) if loud else r.uniform(-110, -70)
                f += 1
        levels.append(series)
        for i in range(25):
            a = r.randrange(-5, 1500)
            given.append((key, i, a, a + r.choice([0, 1, 30, 120])))
    rows = [(k, f, v) for k, s in enumerate(levels) for f, v in s.items()]
    found = {(x.key, x.ord): (x.new_from, x.new_to) for x in spans.over_voice(spark.createDataFrame(given, "key int, ord int, from_frame long, to_frame long"), spark.createDataFrame(rows, "key int, frame long, level double"), -30.0).collect()}
    assert len(found) == len(given)
    for k, i, a, b in given:
        assert found[k, i] == plain_growth(a, b, levels[k], -30.0), (k, i, a, b)


def plain_fit(n, slot, speed, speak):
    if n == 0 or n <= slot:
        return "natural", speed, 1.0
    if slot < 300_000:
        return "too long", speed, 1.0
    faster = min(speed * min(n / slot * 1.03, 1.3), 2.0)
    faster = faster if faster > speed + 0.01 else speed
    quick = speak(faster)
    if quick <= slot:
        return "sped up", faster, 1.0
    return ("stretched", faster, quick / slot) if quick / slot <= 1.15 else ("too long", faster, 1.15)


def test_fitted_lines(spark):
    r = random.Random(5)
    rows = [(r.randrange(0, 6_000_000), r.choice([0, 299_999, 300_000, 1_000_000, 2_500_000])) for _ in range(500)] + [(None, 1), (1, None), (0, 0)]
    found = column(spark, rows, "n long, slot long", lines.fitted("n", "slot", speed=1.1))
    for (n, slot), (f,) in zip(rows, found, strict=True):
        if n is None or slot is None:
            assert f is None
            continue
        kind, speed, stretch = plain_fit(n, slot, 1.1, lambda x: n * 1.1 / x)  # noqa: B023
        assert f.kind == kind and f.speed == pytest.approx(speed) and f.stretch == pytest.approx(stretch), (n, slot)


def test_voice_track_with_fitting(spark):
    cues = [(1, 0, 0, 1_000_000, 1_200_000), (1, 1, 1_000_000, 2_000_000, 4_000_000), (1, 2, 2_000_000, 3_000_000, 500_000)]
    df = spark.createDataFrame(cues, "key int, ord int, start_us long, end_us long, spoken long")
    found = [tuple(x) for x in pipelines.voice_track(df, "spoken", fit=True).orderBy("ord").select("placed_us", "ends_us", "fit").collect()]
    second = round(4_000_000 / 1.3 / 1.15)
    assert found[0][0] == 0 and found[0][2] == "sped up" and found[0][1] <= 1_000_000
    assert found[1] == (1_000_000, 1_000_000 + second, "too long")
    assert found[2] == (1_000_000 + second + 100_000, 1_000_000 + second + 600_000, "natural")


def test_voice_distance(spark):
    from pyspark.sql import functions as F

    refs = [F.lit(x) for x in (-20.0, -30.0, -40.0, 0.4, 0.2)]  # usual, quiet, low, dull, dark
    rows = [(-20.0, 0.1), (-35.0, 0.3), (-40.0, 0.2), (-45.0, 0.1), (-51.0, 0.1), (None, 0.1), (-40.0, None)]
    assert [x for (x,) in column(spark, rows, "l double, b double", lines.voice_distance("l", "b", *refs))] == pytest.approx([0, 0.25, 1, 1, 0, 0, 0])


STREAMS = "key string, index int, kind string, codec string, default boolean, forced boolean, hearing_impaired boolean, attached_picture boolean"


def test_subtitle_plans(spark):
    def file(key, *streams):
        return [(key, i, *s) for i, s in enumerate(streams)]

    media = [
        *file("a", ("video", "h264", True, False, False, False), ("audio", "aac", True, False, False, False), ("subtitle", "subrip", True, True, False, False), ("subtitle", "hdmv_pgs_subtitle", False, False, False, False), ("attachment", "ttf", False, False, False, False), ("data", "bin", None, None, None, None), ("video", "png", False, False, False, True)),
        *file("b", ("video", "vc1", True, False, False, False), ("audio", "aac", True, False, False, False)),
    ]
    streams = spark.createDataFrame(media, STREAMS)
    new = spark.createDataFrame([("a", 0, "ko", " Korean ", True, False, True), ("a", 1, None, "", False, False, False)], "key string, index int, language string, title string, default boolean, forced boolean, hearing_impaired boolean")

    def plan(container, keep=True):
        asked = spark.createDataFrame([("a", container, keep), ("b", container, keep)], "key string, container string, keep_subtitles boolean")
        return tracks.subtitle_plan(streams, new, asked)

    mkv = plan("mkv")
    assert [tuple(x)[2:] for x in mkv.where("key = 'a'").orderBy("input", "index").collect()] == [
        (0, "video", "copy", None, 0, "copy", None, None, None), (1, "audio", "copy", None, 1, "copy", None, None, None), (2, "subtitle", "copy", None, 2, "copy", "forced", None, None), (3, "subtitle", "copy", None, 3, "copy", "0", None, None),
        (4, "attachment", "copy", None, 4, "copy", None, None, None), (5, "data", "drop", "data", None, None, None, None, None), (6, "video", "drop", "cover picture", None, None, None, None, None),
        (0, "subtitle", "copy", None, 5, "copy", "default+hearing_impaired", "kor", "Korean"), (0, "subtitle", "copy", None, 6, "copy", "0", "und", None),
    ]
    mp4 = {(x["key"], x["input"], x["index"]): x for x in plan("mp4").collect()}
    assert mp4["a", 0, 2].codec == "mov_text" and mp4["a", 0, 3].reason == "subtitles that are pictures" and mp4["a", 0, 4].action == "drop" and mp4["a", 0, 6].output == 3 and mp4["a", 1, 0].codec == "mov_text"
    assert (mp4["b", 0, 0].action, mp4["b", 0, 0].reason) == ("refuse", "video") and mp4["b", 0, 1].action == "copy"
    assert {(x.reason, x.n) for x in tracks.left_out(plan("mkv", False)).where("key = 'a'").collect()} == {("subtitles are not kept", 2), ("data", 1), ("cover picture", 1)}
    made = mkv.where("output is not null").select("key", "output", "kind").withColumnRenamed("output", "index")
    assert {tuple(x) for x in tracks.written_as_planned(mkv, made.where("key = 'a'")).collect()} == {("a", True), ("b", False)}
    assert {tuple(x) for x in tracks.written_as_planned(mkv, made.where("not (key = 'a' and index = 6)")).collect()} == {("a", False), ("b", True)}


def test_voice_plans(spark):
    media = [("a", 0, "video", "png", False, False, False, True), ("a", 1, "video", "h264", True, False, False, False), ("a", 2, "audio", "aac", True, False, False, False), ("a", 3, "subtitle", "text", True, False, False, False), ("b", 0, "video", "h264", True, False, False, False)]
    streams = spark.createDataFrame(media, STREAMS)
    asked = spark.createDataFrame([("a", "mkv", True, True), ("b", "mkv", True, False), ("c", "mkv", False, False)], "key string, container string, make_default boolean, small boolean")
    found = {(x["key"], x["input"], x["index"]): (x.action, x.output, x.codec, x.disposition) for x in tracks.voice_plan(streams, asked).collect()}
    assert found == {
        ("a", 0, 0): ("drop", None, None, None), ("a", 0, 1): ("convert", 0, "small", None), ("a", 0, 2): ("convert", 1, "aac", "0"), ("a", 0, 3): ("convert", 2, "srt", None), ("a", 1, 0): ("copy", 3, "copy", "default"),
        ("b", 1, 0): ("refuse", None, None, None), ("c", 1, 0): ("refuse", None, None, None),
    }

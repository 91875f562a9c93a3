"""Picks, snapshots, given paths and files that are found."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cueframe.functions import lines
from cueframe.operators import choices, people, review
from cueframe.plans import pipelines
from cueframe.sources import paths, probe


def test_picks(spark):
    rows = spark.createDataFrame([("v", 1, "en", True), ("v", 2, "ko", True), ("v", 3, None, True), ("w", 4, "en", False), ("w", 5, "de", True)], "video string, item int, language string, there boolean")
    found = {(r.video, r.item, r.candidate) for r in choices.in_other_languages(rows.where("item < 3"), rows, "video", "item", "language").collect()}
    assert found == {("v", 1, 2), ("v", 1, 3), ("v", 2, 1), ("v", 2, 3)}
    wishes = [F.col("language") == "ko", F.col("language") == "en"]
    assert {tuple(r) for r in choices.first_usable(rows, "video", "item", wishes, F.col("there")).collect()} == {("v", 2), ("w", 5)}
    assert {tuple(r) for r in choices.first_usable(rows, "video", "item", [F.col("language") == "fr"]).collect()} == {("v", 1), ("w", 4)}


def test_snapshots_are_written_when_they_change(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    rows = lambda *x: spark.createDataFrame(list(x), "key int, text string, seen int")
    write = lambda df: sorted(r.key for r in choices.write_changed(df, path, "key", ["text", "seen"], ["seen"]).collect())
    assert write(rows((1, "a", 1), (2, None, 1))) == [1, 2]
    assert write(rows((1, "a", 2), (2, None, 2))) == []
    assert write(rows((1, "b", 3), (2, None, 3), (3, "c", 3))) == [1, 3]
    assert write(rows((1, "a", 4), (2, "", 4))) == [1, 2]
    assert spark.read.parquet(path).count() == 6
    changed = choices.changed_snapshots(rows((1, None, 1), (1, None, 2), (1, "x", 3), (1, "x", 4), (2, "x", 1)), "key", ["seen"], ["text"])
    assert sorted((r.key, r.seen) for r in changed.collect()) == [(1, 1), (1, 3), (2, 1)]


def test_given_paths(spark):
    files = spark.createDataFrame([("/in/a b.mkv",), ("/in/c.mkv",), ("/D/x.srt",), ("C:\\f.ass",)], "path string")
    args = [(1, ['"c.mkv"', "-play", " c.mkv ", "/D/x.srt", "missing"]), (2, ["a", "b.mkv"]), (3, ["a", "c.mkv"]), (4, ["nothing", "here"]), (5, None), (6, []), (7, [None, "", "--x"]), (8, ["C:\\f.ass"]), (9, ["missing"])]
    found = sorted((r.key, r.n, r.path) for r in paths.given_paths(spark.createDataFrame(args, "key int, args array<string>"), files, "/in").collect())
    assert found == [(1, 1, "/in/c.mkv"), (1, 2, "/D/x.srt"), (2, 1, "/in/a b.mkv"), (3, 1, "/in/c.mkv"), (8, 1, "C:\\f.ass")]


def test_files_of_folders(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name in ("Film.MKV", "b/x.srt", "b/y.txt", "b/z.mp3"):
        (tmp_path / name).write_text("abc")
    found = sorted((r.path.rsplit("/", 1)[1], r.kind, r.size_bytes) for r in paths.scanned(spark, str(tmp_path)).collect())
    assert found == [("Film.MKV", "video", 3), ("x.srt", "subtitle", 3), ("z.mp3", "audio", 3)]
    twice = spark.createDataFrame([("/A.mkv", 1), ("/a.MKV", 2)], "path string, size_bytes long")
    assert [tuple(r) for r in paths.found_files(twice).collect()] == [("/A.mkv", "video", 1)]


def test_audio_tracks(spark):
    json = '{"streams": [{"index": 0, "codec_type": "video"}, {"index": 2, "codec_type": "audio", "codec_name": "aac", "tags": {"LANGUAGE": "kor", "title": "Main"}}, {"index": 3, "codec_type": "audio"}]}'
    found = probe.audio_tracks(spark.createDataFrame([("a", json), ("b", "{broken"), ("c", None)], "key string, json string")).orderBy("number").collect()
    assert [(r.key, r["index"], r.number, r.language, r.title, r.codec) for r in found] == [("a", 2, 1, "kor", "Main", "aac"), ("a", 3, 2, None, None, None)]


def test_prompt_echoes(spark):
    rows = [("Um, well", "Um, well. Yes, right."), ("um well yes right", "Um, well. Yes, right."), ("Um", "Um, um."), ("um um", "Um, um."), ("other", "Um, well. Yes, right."), (None, "x")]
    found = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p string").orderBy("i").select(lines.echo_of("t", "p")).collect()]
    assert found[:5] == [False, True, False, True, False]


def test_lines_far_from_their_speaker(spark):
    rows = [(1, i, 100.0) for i in range(20)] + [(1, 20, 195.0), (2, 21, 300.0)]
    df = spark.createDataFrame(rows, "speaker int, ord int, hz double")
    far = lambda limit: sorted(r.ord for r in review.far_from_median(df, "speaker", "hz", limit, 20, 40.0).collect())
    assert far(90.0) == [20] and far(100.0) == [] and far(39.0) == []


def test_bilingual_files(spark):
    text = lambda rows: spark.createDataFrame(rows, "key int, ord int, start_us long, end_us long, text string")
    mine = text([(1, 0, 0, 1_000_000, "Hello"), (1, 1, 2_000_000, 3_000_000, "Bye"), (2, 0, 0, 1_000_000, "Alone")])
    theirs = text([(1, 0, 0, 1_000_000, "Hallo"), (1, 1, 2_000_000, 3_000_000, "Tschuess")])
    found = {r.key: re.sub("<[^>]*>", "", r.text) for r in pipelines.bilingual(mine, theirs).collect()}
    times = "1\r\n00:00:00,000 --> 00:00:01,000\r\n"
    assert found[1] == f"{times}Hallo\r\nHello\r\n\r\n2\r\n00:00:02,000 --> 00:00:03,000\r\nTschuess\r\nBye\r\n\r\n"
    assert found[2] == f"{times}Alone\r\n\r\n"


def test_synced_cues(spark):
    cues = [(1, i, i * 3_000_000 + (i % 3) * 400_000, i * 3_000_000 + (i % 3) * 400_000 + 1_200_000) for i in range(40)]
    speech = [(1, a + 2_000_000, b + 2_000_000) for _, _, a, b in cues]
    df = spark.createDataFrame(cues, "key int, ord int, start_us long, end_us long")
    found = pipelines.synced(df, spark.createDataFrame(speech, "key int, start_us long, end_us long")).collect()
    assert {r.offset_us for r in found} == {2_000_000} and {(r.ord, r.start_us - 2_000_000) for r in found} == {(o, a) for _, o, a, _ in cues}


def test_nobody_is_recognised_twice(spark):
    vector = "key int, {} int, embedding array<double>"
    speakers = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 3, None), (1, 4, [0.0, 0.0])], vector.format("speaker"))
    known = spark.createDataFrame([(1, 7, [1.0, 0.05]), (1, 8, [0.0, 1.0]), (2, 9, [1.0, 0.0])], vector.format("person"))
    assert [(r.speaker, r.person) for r in people.recognised(speakers, known).collect()] == [(1, 7)]

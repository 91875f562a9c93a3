"""Streams that are stopped and started again."""

from __future__ import annotations

import json

import pytest

from cueframe.streaming import logs


@pytest.fixture
def source(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, rows):
        (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))

    def read(schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))

    return put, read


def run(stream, tmp_path, mode, name="out"):
    """One run over all that is there; every batch's rows are appended to a file, so that the next run adds to them."""
    seen = []
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).foreachBatch(lambda df, i: seen.append([tuple(r) for r in df.collect()])).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return seen


def test_changes_are_kept_over_a_restart(source, tmp_path):
    put, read = source
    schema = "key string, time timestamp, value double"
    at = "2024-01-01T00:00:0{}Z".format
    put("a", [{"key": "x", "time": at(1), "value": 1.0}, {"key": "x", "time": at(2), "value": 1.5}, {"key": None, "time": at(2), "value": 9.0}])
    first = [r for b in run(logs.changed(read(schema), 1.0), tmp_path, "append") for r in b]
    put("b", [{"key": "x", "time": at(3), "value": 1.9}, {"key": "x", "time": at(4), "value": 3.0}, {"key": "y", "time": at(5), "value": None}])
    second = [r for b in run(logs.changed(read(schema), 1.0), tmp_path, "append") for r in b]
    assert [(r[0], r[2]) for r in first] == [("x", 1.0)] and [(r[0], r[2]) for r in second] == [("x", 3.0)]


def test_newest_rows_and_progress_over_a_restart(source, tmp_path):
    put, read = source
    schema = "key string, time timestamp, message string, done double"
    rows = lambda *x: [{"key": "k", "time": f"2024-01-01T00:00:{i:02d}Z", "message": f"m{i}", "done": d} for i, d in x]
    put("a", rows((1, 0.2), (2, 0.5), (3, 0.4)))
    newest = run(logs.newest(read(schema), 2), tmp_path, "update", "n")[-1]
    best = run(logs.progress(read(schema)), tmp_path, "update", "p")[-1]
    assert sorted(r[2] for r in newest) == ["m2", "m3"] and best == [("k", 0.5)]
    put("b", rows((4, 0.3)))
    newest = [b for b in run(logs.newest(read(schema), 2), tmp_path, "update", "n") if b][-1]
    best = [b for b in run(logs.progress(read(schema)), tmp_path, "update", "p") if b][-1]
    assert sorted(r[2] for r in newest) == ["m3", "m4"] and best == [("k", 0.5)]


def test_late_rows_are_not_counted(source, tmp_path):
    put, read = source
    schema = "time timestamp, level string"
    found = []
    for name, rows in (("a", ["00:00:10", "02:00:00"]), ("b", ["02:10:00"]), ("c", ["00:00:20", "04:00:00"]), ("d", ["05:00:00"])):
        put(name, [{"time": f"2024-01-01T{t}Z", "level": "Info"} for t in rows])
        found += [r for b in run(logs.counted(read(schema)), tmp_path, "append") for r in b]
    # the row of 00:00:20 comes when its window is closed
    assert sorted((r[0].isoformat()[11:16], r[2]) for r in found) == [("00:00", 1), ("02:00", 1), ("02:10", 1), ("04:00", 1)]


def test_finished_work_is_skipped(spark, source, tmp_path):
    put, read = source
    put("a", [{"key": "1"}, {"key": "2"}])
    done = spark.createDataFrame([("2",)], "key string")
    assert [r for b in run(logs.not_done(read("key string"), done), tmp_path, "append") for r in b] == [("1",)]


def test_segments_come_once_over_a_restart(source, tmp_path):
    put, read = source
    schema = "time timestamp, value string"

    def line(second, **fields):
        return {"time": f"2024-01-01T00:00:{second:02d}Z", "value": json.dumps({"key": "k", "start_us": 0, "end_us": 5, "prob": 0.9, "no_speech": 0.1} | fields)}

    put("a", [line(1, ord=1, text="Hello"), line(2, ord=1, text="Hello"), line(3, ord=2, text="..."), line(4, ord=3, text="\u266a"), {"time": "2024-01-01T00:00:05Z", "value": "{not json"}, {"time": "2024-01-01T00:00:05Z", "value": None}])
    first = [r for b in run(logs.segments(read(schema)), tmp_path, "append", "s") for r in b]
    put("b", [line(6, ord=1, text="Hello"), line(7, ord=4, text="Doubtful", no_speech=0.7, prob=0.3), line(8, ord=5, text="There", no_speech=None), line(9, ord=None, text="x")])
    second = [r for b in run(logs.segments(read(schema)), tmp_path, "append", "s") for r in b]
    assert [(r[2], r[5]) for r in first] == [(1, "Hello"), (3, "\u266a")] and [(r[2], r[5]) for r in second] == [(5, "There")]


def test_a_log_rolls_over(spark, source, tmp_path):
    put, read = source
    folder = str(tmp_path / "log")

    def add(name, n):
        put(name, [{"time": f"2024-01-01T00:00:{i:02d}Z", "level": "info", "area": "Dub", "message": f"{name} {i} " + "x" * 50 + "  "} for i in range(n)])
        rows = read("time timestamp, level string, area string, message string")
        rows.writeStream.option("checkpointLocation", str(tmp_path / "check-log")).trigger(availableNow=True).foreachBatch(logs.rolling_log(folder, 1000)).start().awaitTermination(120)

    text = lambda what: [r.value for r in spark.read.text(f"{folder}/{what}").collect()]
    add("a", 20)
    assert len(text("current")) == 20 and not (tmp_path / "log" / "old").exists()
    assert text("current")[0].startswith("2024-01-01 00:00:00 INFO [Dub] a 0 x") and text("current")[0].endswith("x")
    add("b", 3)
    assert len(text("old")) == 20 and all(" b " in x for x in text("current"))
    add("c", 30)
    assert len(text("old")) == 20 and len(text("current")) == 33
    add("d", 1)
    assert len(text("old")) == 33 and len(text("current")) == 1


def test_levels_of_logs(spark):
    rows = spark.createDataFrame([("Info", "a"), ("ERROR", "a"), ("warning", "b"), (None, "a"), ("detail", "a")], "level string, area string")
    assert sorted(r.level or "" for r in logs.of_level(rows, "warning").collect()) == ["", "ERROR", "warning"]
    assert sorted(r.level or "" for r in logs.of_level(rows, "detail", "a").collect()) == ["", "ERROR", "Info", "detail"]

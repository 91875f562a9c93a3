"""What keeps the work of a row small: plans that work a thing out once, and comparisons of few texts."""

from __future__ import annotations

import time

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_a_transcript_are_parted_once(spark):
    from cueframe.plans.pipelines import shape_transcript

    rows = [(1, i, i * 3_000_000, i * 3_000_000 + 2_000_000, f"Line {i}, said and said, " * 9, 0.9, 0.1) for i in range(6)]
    segments = spark.createDataFrame(rows, "key long, ord long, start_us long, end_us long, text string, prob double, no_speech double")
    found = shape_transcript(segments, segments.select("key", "start_us", "end_us"))
    assert "ArrowEvalPython" not in plan(found) and found.count() > 6  # the parts are written, and read by all branches


def test_events_of_a_script_are_parted_once(spark):
    from cueframe.sources.subtitles import parse_ass

    script = "[Events]\nFormat: Start, Text, End, start, Text\nDialogue: x,lost,0:00:02.00,0:00:01.00,a, b\nDialogue: 0:00:01.00,too few\n"
    cues, _ = parse_ass(spark.createDataFrame([("a", script)], "key string, text string"))
    assert [tuple(r) for r in cues.drop("extra").collect()] == [("a", 1, 1_000_000, 2_000_000, "a, b")]
    assert "map_from_entries" not in plan(cues.drop("extra"))  # times and texts are found by their places


def test_readings_are_compared_by_bits():
    from cueframe.functions import fuzzy

    pairs = [("thequickbrownfoxjumpsoverthelazydogandmore"[i % 5 :], f"thequickbrown{i}foxjumpsoverthelxzydogandmore") for i in range(2_000)]
    start = time.process_time()
    assert all(fuzzy.same_key(a, b) for a, b in pairs)
    assert time.process_time() - start < 1.2  # tables row by row take twice that


def test_few_centers_are_sent_to_the_rows(spark):
    from cueframe.operators.vectors import nearest_center

    rows = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id") - 20.0, F.lit(1.0)).alias("embedding"))
    centers = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "label long, embedding array<double>")
    found = nearest_center(rows, centers)
    assert {r["vec_id"]: r["center"] for r in found.collect()} == {i: 1 if i >= 20 else 2 for i in range(50)}
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical  # all rows of one block are no task


def test_the_length_of_a_vector_is_worked_out_once(spark):
    from cueframe.operators.speakers import unit

    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0, None],), (None,)], "v array<double>")
    found = rows.select(unit("v").alias("u"))
    assert [r["u"] for r in found.collect()] == [[0.6, 0.8], None, None, None]
    assert plan(found).count("aggregate(") == 1  # not once more for each number of the vector


def test_blocks_of_an_area_are_written_once(spark):
    from cueframe.operators.readings import subtitle_area

    frames = spark.range(6).select(F.lit(1).alias("key"), F.col("id").alias("sample"))
    text = F.concat(F.lit("said in "), F.element_at(F.array(*(F.lit(w) for w in ("winter", "summer", "an hour", "between", "Oslo", "quiet"))), (F.col("sample") + 1).cast("int")))
    box = {"x": 220.0, "y": 310.0, "width": 200.0, "height": 20.0, "light": 0.5}
    boxes = frames.select("key", "sample", text.alias("text"), *(F.lit(v).alias(c) for c, v in box.items()), F.lit(640).alias("frame_width"), F.lit(360).alias("frame_height"))
    found = subtitle_area(boxes, frames)
    assert "lag(" not in plan(found)  # the stacking of boxes, which seven branches read
    assert [(r["position"], r["hits"], r["samples"]) for r in found.collect()] == [("bottom", 6, 6)]


def test_pairs_of_a_show_are_not_listed(spark, monkeypatch):
    from cueframe.operators import people

    monkeypatch.setattr(people, "LISTED", 3)
    monkeypatch.setattr(people, "LISTED_BY_KEY", 0)
    monkeypatch.setattr(people, "BLOCK", 16)
    listed, taken = [], people._taken

    def counted(pairs):
        listed.append(pairs.count())
        return taken(pairs)

    monkeypatch.setattr(people, "_taken", counted)
    # copies of one voice, which all list the same three
    vector = F.when(F.col("id") < 8, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.cos("id"), F.sin("id")))
    rows = spark.range(24).select(F.lit(1).alias("key"), F.col("id"), vector.alias("embedding"))
    found = people.recognised(rows.withColumnRenamed("id", "speaker"), rows.withColumnRenamed("id", "person"), 0.9)
    assert "Join" not in plan(found) and max(listed) <= 2 * 3 * 24  # of 576 pairs
    assert {(r.speaker, r.person) for r in found.collect()} == {(i, i) for i in range(24)} and len(listed) > 2

"""Registered queries of text read from pictures; turns of conversations are what is seen in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ocr
from .operators import readings, voices
from .plans import tables
from .queries import query

INTERVAL_US = 250_000


@query()
def isl6_frame_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.frame_cues(tables.seen_frames(spark, sf_dir).select("key", "time_us", "text"), INTERVAL_US)


@query()
def agg15_unlike_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.unlike(tables.seen_frames(spark, sf_dir).select("key", "role", F.col("sample").alias("ord"), "text"), ["key", "role"])


@query()
def agg16_densest_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = tables.seen_boxes(spark, sf_dir).withColumn("static", F.lit(False))
    blocks = readings.frame_blocks(boxes).withColumn("anchor", F.col("bottom"))
    return readings.densest_band(blocks, ["key"]).select("key", F.round("centre", 6).alias("centre"), "score")


@query()
def agg17_subtitle_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readings.subtitle_area(tables.seen_boxes(spark, sf_dir), tables.seen_frames(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("band_top", "band_bottom", "line_height")}
    return found.withColumns(rounded).withColumns({"examples": F.size("examples"), "static": F.array_join("static", " ")})


@query("""
WITH b AS (SELECT p_partkey // 2 % 10 AS key, p_partkey // 2 AS sample, p_name AS text, CAST(p_partkey % 2 * (10 + p_size) AS DOUBLE) AS x, CAST(10 + p_partkey * 7 % 9 AS DOUBLE) AS y, CAST(8 + p_size % 5 AS DOUBLE) AS w, CAST(6 + p_partkey % 4 AS DOUBLE) AS h FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY key, sample ORDER BY y + h / 2, x, text) AS n FROM b),
m AS (SELECT l.key, l.sample, CASE WHEN l.x <= r.x THEN trim(l.text) || ' ' || trim(r.text) ELSE trim(r.text) || ' ' || trim(l.text) END AS text, least(l.x, r.x) AS x, least(l.y, r.y) AS y,
    greatest(l.x + l.w, r.x + r.w) - least(l.x, r.x) AS width, greatest(l.y + l.h, r.y + r.h) - least(l.y, r.y) AS height
  FROM o l JOIN o r ON l.key = r.key AND l.sample = r.sample AND l.n = 1 AND r.n = 2
  WHERE least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y) >= 0.5 * least(l.h, r.h) AND greatest(r.x - l.x - l.w, l.x - r.x - r.w) <= 4 * greatest(l.h, r.h))
SELECT * FROM m UNION ALL SELECT key, sample, text, x, y, w, h FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.key = o.key AND m.sample = o.sample)""")
def jn19_merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two boxes, of which SQL can say what becomes; the tests go through frames of any number."""
    i = F.col("p_partkey")
    boxes = tables.load(spark, sf_dir, "part").select(
        (F.floor(i / 2) % 10).alias("key"), F.floor(i / 2).alias("sample"), F.col("p_name").alias("text"), (i % 2 * (10 + F.col("p_size"))).cast("double").alias("x"), (10 + i * 7 % 9).cast("double").alias("y"),
        (8 + F.col("p_size") % 5).cast("double").alias("width"), (6 + i % 4).cast("double").alias("height"), F.lit(200).alias("frame_width"), F.lit(100).alias("frame_height"),
    )
    return readings.merged_rows(boxes).drop("frame_width", "frame_height")


@query()
def pip8_read_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.read_cues(tables.seen_boxes(spark, sf_dir), tables.seen_frames(spark, sf_dir), INTERVAL_US, "high")


@query("""
WITH b AS (SELECT p_partkey // 40 AS key, p_partkey // 4 AS sample, p_name AS text, 70 + p_partkey * 31 % 30 AS x, p_partkey % 4 * 9 + p_partkey * 7 % 11 AS y, 40 + p_size % 8 AS w, 4 + p_size % 15 AS h FROM part),
g AS (SELECT * FROM b WHERE h BETWEEN 2 AND 16 AND abs(x + w / 2.0 - 100) <= 40),
n AS (SELECT *, CASE WHEN y - (lag(y) OVER o + lag(h) OVER o) <= 0.9 * greatest(h, lag(h) OVER o) AND abs(x + w / 2.0 - lag(x + w / 2.0) OVER o) <= 30 THEN 0 ELSE 1 END AS new FROM g WINDOW o AS (PARTITION BY key, sample ORDER BY y, x, text)),
r AS (SELECT *, sum(new) OVER (PARTITION BY key, sample ORDER BY y, x, text ROWS UNBOUNDED PRECEDING) AS block FROM n)
SELECT key, sample, CAST(block AS BIGINT) AS block, min(y / 100.0) AS top, max((y + h) / 100.0) AS bottom, count(*) AS lines, string_agg(trim(text), chr(10) ORDER BY y, x, text) AS text FROM r GROUP BY 1, 2, 3 HAVING count(*) <= 3""")
def isl5_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.load(spark, sf_dir, "part")
    i, size = F.col("p_partkey"), F.col("p_size")
    boxes = p.select(F.floor(i / 40).alias("key"), F.floor(i / 4).alias("sample"), F.col("p_name").alias("text"), (70 + i * 31 % 30).alias("x"), (i % 4 * 9 + i * 7 % 11).alias("y"), (40 + size % 8).alias("width"), (4 + size % 15).alias("height"), F.lit(200).alias("frame_width"), F.lit(100).alias("frame_height"))
    return voices.text_blocks(boxes)


@query(r"""
WITH t AS (SELECT doc_id, replace(replace(text, ' ', CASE WHEN doc_id % 3 = 0 THEN ' | ' ELSE '  ' END), chr(13), '') AS t FROM documents),
l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: regexp_replace(array_to_string(list_filter(string_split(x, ' '), lambda w: regexp_matches(w, '[\p{L}\p{Nd}]') OR regexp_matches(w, '^[-–—♪♫…&"“”«»#$%€£]+$') OR w IN ('...', '?', '!')), ' '), '^\s+|\s+$', '', 'g')) AS l FROM t)
SELECT doc_id, array_to_string(list_filter(l, lambda x: length(regexp_replace(x, '[^\p{L}\p{Nd}]', '', 'g')) >= 2), chr(10)) AS text FROM l""")
def fn27_cleaned_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.load(spark, sf_dir, "documents")
    return d.select("doc_id", ocr.clean(F.replace("text", F.lit(" "), F.when(F.col("doc_id") % 3 == 0, " | ").otherwise("  "))).alias("text"))

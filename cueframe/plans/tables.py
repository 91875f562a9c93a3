"""Timed rows derived from the plain tables, for the registered queries; the SQL beside each builds the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals by user: (key, ord, kind, start_us, end_us)."""
    e = load(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    length = F.round(F.col("value") * 100).cast("long") * 6_000_000
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), start.alias("start_us"), (start + length).alias("end_us"))


INTERVALS = """iv AS (
  SELECT user_id AS key, event_id AS ord, event_type AS kind, epoch_us(ts) AS start_us,
         epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 6000000 AS end_us FROM events)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as cues: (key, ord, role, text, start_us, end_us)."""
    c = load(spark, sf_dir, "conversations")
    start = F.col("turn") * 3_000_000 + ((F.col("conv_id") * 7919 + F.col("turn") * 104_729) % 2900) * 1000
    length = (F.length("text") * 37 % 6000) * 1000
    return c.select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), "role", "text", start.alias("start_us"), (start + length).cast("long").alias("end_us"))


CUES = """cu AS (
  SELECT conv_id AS key, turn AS ord, role, text, turn * 3000000 + ((conv_id * 7919 + turn * 104729) % 2900) * 1000 AS start_us,
         turn * 3000000 + ((conv_id * 7919 + turn * 104729) % 2900) * 1000 + (length(text) * 37 % 6000) * 1000 AS end_us
  FROM conversations)"""


def spoken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as lines of recordings, one for each label: (key, ord, start_us, end_us, embedding, pitch). Every seventh
    line was too short for a vector; pitches are made of the vector's first numbers."""
    e = load(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    start = i * 2_500_000 + (i * 7919 % 1500) * 1000
    length = F.when(i % 7 == 0, 200 + i * 7919 % 250).otherwise(500 + i * 104_729 % 4000) * 1000
    pitch = F.transform(F.slice("embedding", F.lit(1), (i % 11).cast("int")), lambda x: F.round(160 + 250 * x.cast("double"), 3))
    vector = F.when(i % 7 > 0, F.transform("embedding", lambda x: x.cast("double")))
    return e.select(F.col("label").cast("long").alias("key"), i.alias("ord"), start.alias("start_us"), (start + length).alias("end_us"), vector.alias("embedding"), pitch.alias("pitch"))


def seen_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as texts read from frames: (key, role, sample, time_us, text, high). Each turn stands for six
    frames, some of them misread, and two empty ones follow."""
    c = load(spark, sf_dir, "conversations").withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(7))))
    said = F.translate(F.substring("text", 1, 44), "\n", " ")
    noise = (F.col("conv_id") * 31 + F.col("turn") * 17 + F.col("f") * 7).cast("long")
    place = (noise % F.greatest(F.length(said), F.lit(1))).cast("int")
    misread = F.concat(F.substr(said, F.lit(1), place), F.lit("|"), F.substr(said, place + 2))
    text = F.when(F.col("f") > 5, "").when(noise % 11 == 0, "~~ zq").when(noise % 3 == 0, misread).otherwise(said)
    sample = (F.col("turn") * 8 + F.col("f")).cast("long")
    return c.select(F.col("conv_id").alias("key"), "role", sample.alias("sample"), (sample * 250_000).alias("time_us"), text.alias("text"), F.lit(20.0).alias("high"))


def seen_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of seen_frames in frames of 640 x 360: each text as two pieces of a row, and a mark that always stands there."""
    f = seen_frames(spark, sf_dir)
    half = F.ceil(F.length("text") / 2).cast("int")
    row = F.when(F.col("key") % 4 == 0, 30.0).otherwise(310.0) + F.col("sample") % 3
    box = lambda text, x, y, width, light: F.struct(text.alias("text"), x.alias("x"), y.alias("y"), width.alias("width"), light.alias("light"))
    light = (F.col("key") % 5) / 25.0
    left = box(F.substr("text", F.lit(1), half), F.lit(130.0), row, F.lit(180.0), light)
    right = box(F.substr("text", half + 1), F.lit(320.0), row + 1, F.lit(190.0), light)
    mark = box(F.lit("Channel five"), F.lit(250.0), F.lit(170.0), F.lit(140.0), F.lit(-1.0))
    boxes = F.explode(F.filter(F.array(left, right, mark), lambda b: b["text"] != ""))
    return f.select("key", "sample", boxes.alias("b")).select("key", "sample", "b.*", F.lit(20.0).alias("height"), F.lit(640).alias("frame_width"), F.lit(360).alias("frame_height"))

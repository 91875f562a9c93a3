"""Registered queries of the speakers of recordings; embeddings are taken as lines, those of one label as a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import speakers
from .plans import tables
from .queries import query


@query()
def agg18_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.clustered(tables.spoken_lines(spark, sf_dir))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.spoken_lines(spark, sf_dir)
    long_enough = lines.where("end_us - start_us >= 1200000")
    return lines.join(speakers.clustered(long_enough), ["key", "ord"], "left")


@query()
def agg19_merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.merged_alike(_grouped(spark, sf_dir), 0.4).select("key", "ord", "grp")


@query()
def agg20_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.characters(_grouped(spark, sf_dir)).select("key", "ord", "owner", "role")


@query("""
WITH {iv}, l AS (SELECT key, ord, start_us, end_us, CASE WHEN ord % 5 = 0 OR ord % 17 < 4 THEN ord % 3 END AS owner, CASE ord % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS own_gender, row_number() OVER (PARTITION BY key ORDER BY start_us, ord) AS i FROM iv),
p AS (SELECT a.key, a.ord, abs(a.i - b.i) AS d, b.i > a.i AS behind, CASE WHEN b.i < a.i THEN a.start_us - b.end_us ELSE b.start_us - a.end_us END AS gap, b.owner,
    coalesce(CASE b.owner WHEN 0 THEN 'male' WHEN 1 THEN 'female' END = a.own_gender, false) AS same, min(abs(a.i - b.i)) OVER (PARTITION BY a.key, a.ord) AS m
  FROM l a JOIN l b ON a.key = b.key AND a.owner IS NULL AND b.owner IS NOT NULL),
s AS (SELECT key, ord, owner FROM p WHERE d <= 3 OR m > 3 AND d = m QUALIFY row_number() OVER (PARTITION BY key, ord ORDER BY same AND gap <= 3000000 DESC, gap, d, behind) = 1)
SELECT l.key, l.ord, coalesce(l.owner, s.owner) AS owner, l.owner IS NULL AND s.owner IS NOT NULL AS by_neighbour FROM l LEFT JOIN s ON s.key = l.key AND s.ord = l.ord""")
def jn11_nearest_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("ord")
    known = F.when((i % 5 == 0) | (i % 17 < 4), i % 3)
    lines = tables.intervals(spark, sf_dir).withColumn("owner", known).withColumn("own_gender", F.when(i % 4 == 0, "male").when(i % 4 == 1, "female"))
    lines = lines.withColumn("owner_gender", F.when(F.col("owner") == 0, "male").when(F.col("owner") == 1, "female"))
    return speakers.nearest_owner(lines).select("key", "ord", "owner", "by_neighbour")


@query()
def pip7_speaker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.find_speakers(tables.spoken_lines(spark, sf_dir))[0]


@query()
def pip7_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.find_speakers(tables.spoken_lines(spark, sf_dir))[1].drop("embedding").withColumn("pitch_hz", F.round("pitch_hz", 6))

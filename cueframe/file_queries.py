"""Registered queries over files: conversations as subtitle files, written, read again, and listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lines
from .plans import tables
from .queries import query
from .sources import probe, subtitles

_MS = "WITH {cu}, m AS (SELECT CAST(key AS VARCHAR) AS key, row_number() OVER (PARTITION BY key ORDER BY ord) AS ord, (start_us + 500) // 1000 AS s, (end_us + 500) // 1000 AS e, text FROM cu)"
_CLOCK = "format('{{:02d}}:{{:02d}}:{{:02d}}{sep}{{:03d}}', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"
_S, _E = (_CLOCK.format(sep=",", x=x) for x in "se")
_VS, _VE = (_CLOCK.format(sep=".", x=x) for x in "se")


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cues(spark, sf_dir).select(F.col("key").cast("string").alias("key"), "ord", "start_us", "end_us", "text")


def _read_again(files: DataFrame, kind: str) -> DataFrame:
    content = subtitles.encoded(files, kind).withColumn("key", F.concat("key", F.lit(f".{kind}")))
    cues, _ = subtitles.parse_files(content)
    return cues.select(F.regexp_replace("key", r"\.\w+$", "").alias("key"), "ord", "start_us", "end_us", "text")


def _digests(files: DataFrame) -> DataFrame:
    return files.select("key", F.md5("text").alias("digest"))


@query(_MS + " SELECT key, ord, s * 1000 AS start_us, e * 1000 AS end_us, text FROM m")
def src4_srt_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_again(subtitles.render_srt(_cues(spark, sf_dir)), "srt")


@query(_MS + " SELECT key, ord, s * 1000 AS start_us, e * 1000 AS end_us, text FROM m")
def src5_vtt_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_again(subtitles.render_vtt(_cues(spark, sf_dir), "srt"), "vtt")


@query("WITH {cu} SELECT CAST(key AS VARCHAR) AS key, row_number() OVER (PARTITION BY key ORDER BY ord) AS ord, (start_us + 5000) // 10000 * 10000 AS start_us, (end_us + 5000) // 10000 * 10000 AS end_us, text FROM cu")
def src6_ass_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_again(subtitles.render_ass(_cues(spark, sf_dir), "srt"), "ass")


@query("""
WITH {cu} SELECT CAST(key AS VARCHAR) AS key, row_number() OVER (PARTITION BY key ORDER BY ord) AS ord, CAST(floor(start_us / 1000000 * 25 + 0.5) AS BIGINT) * 40000 AS start_us,
  CAST(floor(end_us / 1000000 * 25 + 0.5) AS BIGINT) * 40000 AS end_us, text FROM cu""")
def src7_sub_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_again(subtitles.render_sub(_cues(spark, sf_dir), "srt", 25.0), "sub")


@query(_MS + f", f AS (SELECT key, string_agg(ord || chr(10) || {_S} || ' --> ' || {_E} || chr(10) || rtrim(text, chr(10)) || chr(10) || chr(10), '' ORDER BY ord) AS t FROM m GROUP BY key) SELECT key, md5(replace(t, chr(10), chr(13) || chr(10))) AS digest FROM f")
def snk1_srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(subtitles.render_srt(_cues(spark, sf_dir)))


@query(_MS + f", f AS (SELECT key, 'WEBVTT' || chr(10) || chr(10) || string_agg({_VS} || ' --> ' || {_VE} || chr(10) || rtrim(replace(text, '-->', '->'), chr(10)) || chr(10) || chr(10), '' ORDER BY ord) AS t FROM m GROUP BY key) SELECT key, md5(replace(t, chr(10), chr(13) || chr(10))) AS digest FROM f")
def snk2_vtt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(subtitles.render_vtt(_cues(spark, sf_dir), "srt"))


@query(r"""
WITH {cu}, c AS (SELECT CAST(key AS VARCHAR) AS key, ord, (start_us + 5000) // 10000 AS s, (end_us + 5000) // 10000 AS e, text FROM cu),
f AS (SELECT key, string_agg('Dialogue: 0,' || format('{:d}:{:02d}:{:02d}.{:02d}', s // 360000, s // 6000 % 60, s // 100 % 60, s % 100) || ',' || format('{:d}:{:02d}:{:02d}.{:02d}', e // 360000, e // 6000 % 60, e // 100 % 60, e % 100)
  || ',Default,,0,0,0,,' || replace(text, chr(10), '\N') || chr(10), '' ORDER BY ord) AS t FROM c GROUP BY key)
SELECT key, md5(replace(t, chr(10), chr(13) || chr(10))) AS digest FROM f""")
def snk3_ass_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = subtitles.script_header("ass").replace("\n", "\r\n") + "\r\n"
    return _digests(subtitles.render_ass(_cues(spark, sf_dir), "srt").withColumn("text", F.substr("text", F.lit(len(head) + 1))))


@query("""
WITH {cu}, f AS (SELECT CAST(key AS VARCHAR) AS key, '{1}{1}25' || chr(10) || string_agg('{' || CAST(floor(start_us / 1000000 * 25 + 0.5) AS BIGINT) || '}{' || CAST(floor(end_us / 1000000 * 25 + 0.5) AS BIGINT) || '}' || replace(text, chr(10), '|') || chr(10), '' ORDER BY ord) AS t
  FROM cu GROUP BY 1) SELECT key, md5(replace(t, chr(10), chr(13) || chr(10))) AS digest FROM f""")
def snk4_sub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(subtitles.render_sub(_cues(spark, sf_dir), "srt", 25.0))


@query("""
WITH f AS (SELECT c_custkey, c_name || ['.srt', '.VTT', '.ass', '.ssa', '.sub', '.idx', '.mkv', ''][c_custkey % 8 + 1] AS path FROM customer)
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'srt' WHEN 1 THEN 'vtt' WHEN 2 THEN 'ass' WHEN 3 THEN 'ssa' WHEN 4 THEN 'sub' WHEN 5 THEN 'pictures' END AS format FROM f""")
def src1_file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*(F.lit(x) for x in (".srt", ".VTT", ".ass", ".ssa", ".sub", ".idx", ".mkv", "")))
    path = F.concat("c_name", F.element_at(endings, (F.col("c_custkey") % 8 + 1).cast("int")))
    return tables.load(spark, sf_dir, "customer").select("c_custkey", subtitles.file_format(path).alias("format"))


@query("""
SELECT event_id, user_id % 3 AS idx, ['video', 'audio', 'subtitle'][event_id % 3 + 1] AS kind, CASE WHEN event_id % 5 > 0 THEN lower(event_type) END AS language, event_id % 7 = 0 AS forced FROM events""")
def src9_probed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kinds = F.element_at(F.array(F.lit("video"), F.lit("audio"), F.lit("subtitle")), (i % 3 + 1).cast("int"))
    tags = F.when(i % 5 > 0, F.create_map(F.when(i % 2 == 0, "LANGUAGE").otherwise("language"), "event_type"))
    stream = F.struct((F.col("user_id") % 3).alias("index"), kinds.alias("codec_type"), tags.alias("tags"), F.struct(F.when(i % 7 == 0, 1).otherwise(0).alias("forced")).alias("disposition"))
    files = tables.load(spark, sf_dir, "events").select(i.cast("string").alias("key"), F.to_json(F.struct(F.array(stream).alias("streams"))).alias("json"))
    found = probe.streams(files)
    return found.select(F.col("key").cast("long").alias("event_id"), F.col("index").alias("idx"), "kind", "language", "forced")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 1, 2, 4) THEN 'en' WHEN c_custkey % 6 = 3 THEN 'hi' END AS language, c_custkey % 6 = 1 AS forced, c_custkey % 6 = 2 AS hearing_impaired, c_custkey % 6 = 4 AS sdh,
  CASE WHEN c_custkey % 6 = 4 THEN 'Full Songs' END AS label FROM customer WHERE c_custkey % 6 < 5""")
def fn24_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    middles = F.array(*(F.lit(x) for x in (".en.srt", ".EN.forced.srt", ".en.hi.vtt", ".hi.ass", ".sdh.en.Full.Songs.sub", "2.srt")))
    c = tables.load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/films/"), "c_name", F.lit(".mkv")).alias("video"), F.concat("c_name", F.element_at(middles, (F.col("c_custkey") % 6 + 1).cast("int"))).alias("file"))
    found = c.select("c_custkey", lines.sidecar("video", "file").alias("info")).where("info is not null")
    return found.select("c_custkey", *(F.col(f"info.{x}").alias(x) for x in ("language", "forced", "hearing_impaired", "sdh", "label")))


@query("""
WITH n AS (SELECT c_mktsegment AS folder, c_custkey % 17 AS taken, count(*) AS n FROM customer GROUP BY 1, 2), g AS (SELECT DISTINCT c_mktsegment AS folder FROM customer)
SELECT folder, (SELECT min(i) FROM range(1, 40) t(i) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.folder = g.folder AND n.taken = i)) AS free FROM g""")
def snk12_free_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = tables.load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("folder"), (F.col("c_custkey") % 17).cast("long").alias("taken"))
    return probe.free_numbers(taken, "folder", "taken")


@query("SELECT p_partkey, p_name AS text FROM part")
def src16_hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.load(spark, sf_dir, "part")
    # as a dump prints it: an address, groups of four digits, and the text behind two spaces
    groups = F.array_join(F.regexp_extract_all(F.hex(F.encode("p_name", "UTF-8")), F.lit("(.{1,4})"), 1), " ")
    dump = F.concat(F.lit("00000000: "), F.lower(groups), F.lit("  .abc.\n"))
    return p.select("p_partkey", F.decode(probe.hex_dump(dump), "UTF-8").alias("text"))

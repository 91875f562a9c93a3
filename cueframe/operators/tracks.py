"""Which streams of a media file go into a new one, and how: tables of decisions, and what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import tag_of

#: Fixed: what an MP4 file can hold without encoding, subtitles that are text, and names that mean SubRip in a Matroska file.
MP4_VIDEO = ("h264", "hevc", "av1", "vp9", "mpeg4", "mpeg2video", "mpeg1video", "mjpeg", "png")
MP4_AUDIO = ("aac", "mp3", "ac3", "eac3", "alac", "opus", "flac", "dts", "mp2")
TEXT_CODECS = ("subrip", "srt", "ass", "ssa", "mov_text", "webvtt", "text")


def _flags(default: Column, forced: Column, hearing_impaired: Column) -> Column:
    """default+forced+hearing_impaired, those that are set; 0 where none is."""
    said = F.concat_ws("+", F.when(default, F.lit("default")), F.when(forced, F.lit("forced")), F.when(hearing_impaired, F.lit("hearing_impaired")))
    return F.when(said == "", "0").otherwise(said)


def _set(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _kept_codec(mp4: Column) -> Column:
    codec = F.lower("codec")
    into_mp4 = F.when(codec == "mov_text", "copy").otherwise("mov_text")
    into_mkv = F.when(codec.isin("mov_text", "text"), "srt").otherwise("copy")
    return F.when(F.col("kind") == "subtitle", F.when(mp4, into_mp4).otherwise(into_mkv)).otherwise("copy")


def _streams(streams: DataFrame, requests: DataFrame) -> DataFrame:
    """Streams with what is asked of their file; a kind that is none of the four others is data."""
    known = F.when(F.col("kind").isin("video", "audio", "subtitle", "attachment"), F.col("kind")).otherwise("data")
    return streams.withColumn("kind", known).join(requests, "key").withColumn("mp4", F.col("container") == "mp4")


def _placed(rows: DataFrame) -> DataFrame:
    """Numbers what is kept, by file, in the order of the inputs and their streams."""
    kept = F.col("action") != "drop"
    w = Window.partitionBy("key").orderBy("input", "index")
    place = F.sum(F.when(kept, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.withColumn("output", F.when(kept & (F.col("action") != "refuse"), place))


_PLAN = ["key", "input", "index", "kind", "action", "reason", "output", "codec", "disposition", "language", "title"]


def subtitle_plan(streams: DataFrame, tracks: DataFrame, requests: DataFrame) -> DataFrame:
    """What becomes of each stream of each file when subtitle tracks are added: (key, input, index, kind, action, reason, output,
    codec, disposition, language, title).

    streams: (key, index, kind, codec, default, forced, hearing_impaired, attached_picture); tracks: (key, index, language,
    title, default, forced, hearing_impaired), the new ones from 0; requests: (key, container: mp4 or mkv, keep_subtitles).
    action is copy, convert (codec says to what), drop (reason says why) or refuse, where the container cannot hold a picture
    or sound: no such file is written. output counts what is kept, the new tracks last. A track that is there already is the
    default one no more where a new one is.
    """
    new_default = tracks.groupBy("key").agg(F.max(_set("default")).alias("_new_default"))
    rows = _streams(streams, requests).join(new_default, "key", "left")
    mp4, kind, codec = F.col("mp4"), F.col("kind"), F.lower("codec")
    reason = (
        F.when((kind == "video") & _set("attached_picture") & ~mp4, "cover picture")
        .when((kind == "subtitle") & ~F.coalesce("keep_subtitles", F.lit(True)), "subtitles are not kept")
        .when((kind == "subtitle") & mp4 & ~codec.isin(*TEXT_CODECS), "subtitles that are pictures")
        .when((kind == "attachment") & mp4, "attachment")
        .when(kind == "data", "data")
    )
    refused = F.when((kind == "video") & mp4 & ~codec.isin(*MP4_VIDEO), "video").when((kind == "audio") & mp4 & ~codec.isin(*MP4_AUDIO), "audio")
    to = _kept_codec(mp4)
    action = F.when(reason.isNotNull(), "drop").when(refused.isNotNull(), "refuse").when(to == "copy", "copy").otherwise("convert")
    flags = F.when(kind == "subtitle", _flags(_set("default") & ~F.coalesce("_new_default", F.lit(False)), _set("forced"), _set("hearing_impaired")))
    kept = F.col("action").isin("copy", "convert")
    old = rows.select("key", F.lit(0).alias("input"), F.col("index").cast("long").alias("index"), "kind", action.alias("action"), F.coalesce(reason, refused).alias("reason"), to.alias("codec"), flags.alias("disposition"))
    old = old.select("key", "input", "index", "kind", "action", "reason", F.when(kept, F.col("codec")).alias("codec"), F.when(kept, F.col("disposition")).alias("disposition"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("title"))
    title = F.trim("title")
    added = tracks.join(requests, "key").select(
        "key", (F.col("index") + 1).cast("int").alias("input"), F.lit(0).cast("long").alias("index"), F.lit("subtitle").alias("kind"), F.when(F.col("container") == "mp4", "convert").otherwise("copy").alias("action"), F.lit(None).cast("string").alias("reason"),
        F.when(F.col("container") == "mp4", "mov_text").otherwise("copy").alias("codec"), _flags(_set("default"), _set("forced"), _set("hearing_impaired")).alias("disposition"), F.coalesce(tag_of("language"), F.lit("und")).alias("language"), F.when(title != "", title).alias("title"),
    )
    return _placed(old.unionByName(added)).select(*_PLAN)


def voice_plan(streams: DataFrame, requests: DataFrame, title: str = "English (voice-over)") -> DataFrame:
    """As subtitle_plan, for a new sound track that is added last.

    requests: (key, container, make_default, small). Nothing is refused but files without sound, whose only row says so. small:
    the first picture that is no cover is encoded anew, and all sound with it. A track that is there already is the
    default one no more where the new one is to be.
    """
    rows = _streams(streams, requests)
    mp4, kind, codec = F.col("mp4"), F.col("kind"), F.lower("codec")
    reason = (
        F.when(kind == "data", "data")
        .when((kind == "video") & _set("attached_picture") & ~mp4, "cover picture")
        .when((kind == "attachment") & mp4, "attachment")
        .when((kind == "subtitle") & mp4 & ~codec.isin(*TEXT_CODECS), "subtitles that are pictures")
    )
    picture = (kind == "video") & ~_set("attached_picture")
    first = F.min(F.when(picture, F.col("index"))).over(Window.partitionBy("key"))
    small = _set("small") & first.isNotNull()
    to = F.when(small & (kind == "video") & (F.col("index") == first), "small").when(small & (kind == "audio"), "aac").otherwise(_kept_codec(mp4))
    flags = F.when(kind == "audio", _flags(_set("default") & ~_set("make_default"), _set("forced"), _set("hearing_impaired")))
    sounds = F.count_if(kind == "audio").over(Window.partitionBy("key"))
    judged = rows.withColumns({"reason": reason, "codec": to, "disposition": flags, "_sounds": sounds})
    action = F.when(F.col("reason").isNotNull(), "drop").when(F.col("codec") == "copy", "copy").otherwise("convert")
    none = F.lit(None).cast("string")
    kept = F.col("reason").isNull()
    old = judged.where("_sounds > 0").select("key", F.lit(0).alias("input"), F.col("index").cast("long").alias("index"), "kind", action.alias("action"), "reason", F.when(kept, F.col("codec")).alias("codec"), F.when(kept, F.col("disposition")).alias("disposition"), none.alias("language"), none.alias("title"))
    heard = judged.where("_sounds > 0").select("key").distinct()
    there = requests.join(heard.withColumn("_heard", F.lit(True)), "key", "left")
    has = F.col("_heard").isNotNull()
    added = there.select(
        "key", F.lit(1).alias("input"), F.lit(0).cast("long").alias("index"), F.lit("audio").alias("kind"), F.when(has, "copy").otherwise("refuse").alias("action"), F.when(~has, "no sound").alias("reason"), F.when(has, "copy").alias("codec"),
        F.when(has, _flags(_set("make_default"), F.lit(False), F.lit(False))).alias("disposition"), F.when(has, "eng").alias("language"), F.when(has, title).alias("title"),
    )
    return _placed(old.unionByName(added)).select(*_PLAN)


def left_out(plan: DataFrame) -> DataFrame:
    """(key, reason, n): how many streams a plan leaves out, and why; refused ones too."""
    return plan.where("action in ('drop', 'refuse')").groupBy("key", "reason").agg(F.count("*").alias("n"))


def written_as_planned(plan: DataFrame, written: DataFrame, kind: str = "subtitle") -> DataFrame:
    """(key, ok) of each planned file: whether what was written, (key, index, kind), has at least as many streams as the plan
    keeps and exactly as many of the kind. A file that is not there is not as planned; a plan that refuses a stream is no plan."""
    kept = plan.groupBy("key").agg(F.count("output").alias("streams"), F.count_if(F.col("output").isNotNull() & (F.col("kind") == kind)).alias("mine"), F.count_if(F.col("action") == "refuse").alias("refused"))
    have = written.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == kind).alias("m"))
    met = kept.where("refused = 0").join(have, "key", "left")
    return met.select("key", F.coalesce((F.col("n") >= F.col("streams")) & (F.col("m") == F.col("mine")), F.lit(False)).alias("ok"))

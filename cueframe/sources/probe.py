"""Descriptions of media files: streams of a probe's JSON, hex dumps, change logs, profiles, free names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STREAMS = "streams array<struct<index:int, codec_type:string, codec_name:string, tags:map<string,string>, disposition:map<string,int>>>"


def streams(files: DataFrame) -> DataFrame:
    """(key, index, kind, codec, language, title, default, forced, hearing_impaired, number) of (key, json): one row for each
    stream; number counts the streams of its kind from 1. Names of tags are compared regardless of case. JSON that cannot
    be read has no streams."""
    found = files.select("key", F.posexplode(F.from_json("json", _STREAMS)["streams"]).alias("place", "s"))
    tags = F.map_from_entries(F.transform(F.map_entries(F.coalesce(F.col("s.tags"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(F.lower(e["key"]), F.lit("\x00"), e["key"]), e["value"])))
    tag = lambda name: F.get(F.map_values(F.map_filter(tags, lambda k, _: F.startswith(k, F.lit(name + "\x00")))), F.lit(0))
    flag = lambda name: F.coalesce(F.element_at(F.col("s.disposition"), name), F.lit(0)) == 1
    number = F.row_number().over(Window.partitionBy("key", "s.codec_type").orderBy("place"))
    return found.select(
        "key", F.col("s.index").cast("long").alias("index"), F.col("s.codec_type").alias("kind"), F.col("s.codec_name").alias("codec"), tag("language").alias("language"), tag("title").alias("title"),
        flag("default").alias("default"), flag("forced").alias("forced"), flag("hearing_impaired").alias("hearing_impaired"), number.alias("number"),
    )


def audio_tracks(files: DataFrame) -> DataFrame:
    return streams(files).where("kind = 'audio'")


def hex_dump(text: Column | str) -> Column:
    """The bytes of a hex dump: on each line the groups of digits between its address and two spaces."""
    t = F.col(text) if isinstance(text, str) else text
    body = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_extract(x, r"^\s*[0-9a-fA-F]+:\s+((?:[0-9a-fA-F]+ ?)+)(?:\s|$)", 1), r"\s", ""))
    return F.unhex(F.array_join(body, ""))


def change_log(texts: DataFrame) -> DataFrame:
    """(key, version, heading, n, bullet) of markdown (key, text): versions are ## lines, headings ### lines, bullets begin with
    a dash, and lines that follow indented belong to the bullet before them. What stands before a version has none."""
    lines = texts.select("key", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("i", "line"))
    w = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    version, heading = F.regexp_extract("line", r"^##\s+(.*\S)", 1), F.regexp_extract("line", r"^###\s+(.*\S)", 1)
    bullet, more = F.regexp_extract("line", r"^\s*[-*]\s+(.*\S)", 1), F.regexp_extract("line", r"^\s+(?![-*]\s)(\S.*?)\s*$", 1)
    is_version = F.col("line").rlike(r"^##\s")
    marked = lines.withColumns({"version": F.last(F.when(is_version, version), ignorenulls=True).over(w), "heading": F.last(F.when(is_version, "").when(heading != "", heading), ignorenulls=True).over(w), "bullet": bullet, "more": more})
    # a line of another kind ends a bullet
    run = F.sum(F.when((F.col("bullet") != "") | (F.col("more") == ""), 1).otherwise(0)).over(w)
    parts = marked.withColumn("run", run).where("bullet <> '' or more <> ''")
    found = parts.groupBy("key", "run").agg(F.first("version").alias("version"), F.first("heading").alias("heading"), F.max(F.col("bullet") != "").alias("is"), F.sort_array(F.collect_list(F.struct("i", F.when(F.col("bullet") != "", F.col("bullet")).otherwise(F.col("more")).alias("t")))).alias("all"))
    found = found.where("is").select("key", "version", F.when(F.col("heading") != "", F.col("heading")).alias("heading"), "run", F.array_join(F.transform("all", lambda x: x["t"]), " ").alias("bullet"))
    return found.select("key", "version", "heading", F.row_number().over(Window.partitionBy("key").orderBy("run")).alias("n"), "bullet")


def profile(files: DataFrame) -> DataFrame:
    """(key, op, provider, n, total_us) of a profiler's JSON (key, json): nodes that ran within the last model_run, summed by
    operator and provider and by provider alone (op null)."""
    kind = "array<struct<cat:string, name:string, ts:long, dur:long, args:struct<op_name:string, provider:string>>>"
    rows = files.select("key", F.explode(F.from_json("json", kind)).alias("e")).select("key", "e.*")
    last = rows.where("name = 'model_run'").groupBy("key").agg(F.max_by(F.struct("ts", "dur"), F.col("ts")).alias("run"))
    nodes = rows.where("cat = 'Node' and args.provider is not null").join(last, "key").where("ts >= run.ts and ts <= run.ts + run.dur")
    nodes = nodes.select("key", F.col("args.op_name").alias("op"), F.coalesce("args.provider", F.lit("")).alias("provider"), "dur")
    sums = nodes.groupingSets([[F.col("key"), F.col("provider")], [F.col("key"), F.col("op"), F.col("provider")]], F.col("key"), F.col("op"), F.col("provider"))
    return sums.agg(F.count("*").alias("n"), F.sum("dur").alias("total_us"))


def free_numbers(taken: DataFrame, group: str, number: str) -> DataFrame:
    """(group, free): the smallest whole number from 1 that no row of the group has. 1 is free where only others are taken."""
    mine = taken.where(F.col(number) >= 1).select(group, F.col(number).cast("long").alias("_n")).distinct()
    w = Window.partitionBy(group).orderBy("_n")
    # up to the first gap the k-th number is k
    met = mine.withColumn("_k", F.row_number().over(w)).where("_n = _k").groupBy(group).agg(F.max("_n").alias("_n"))
    return taken.select(group).distinct().join(met, group, "left").select(group, (F.coalesce("_n", F.lit(0)) + 1).alias("free"))

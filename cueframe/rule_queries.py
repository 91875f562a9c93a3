"""Registered queries of small rules: times, levels, files, picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import languages, lines, maths, text, time
from .operators import intervals as ops
from .operators import choices, names, review, voices
from .operators import people as people_of
from .plans import tables
from .queries import query
from .sources import paths, probe, text_files
from .streaming import logs


@query("WITH {cu} SELECT key, ord, greatest(CAST(round(start_us * 1.1) AS BIGINT) - 100000, 0) AS start_us, greatest(CAST(round(end_us * 1.1) AS BIGINT) - 100000, 0) AS end_us FROM cu")
def prj4_two_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.map_by_points(tables.cues(spark, sf_dir), 1_000_000, 1_000_000, 11_000_000, 12_000_000).select("key", "ord", "start_us", "end_us")


@query("WITH {cu} SELECT key, ord, greatest(CAST(round(start_us * (25 / (24000 / 1001.0))) AS BIGINT), 0) AS start_us FROM cu")
def prj3_frame_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stretch_for_rates(tables.cues(spark, sf_dir), *ops.FRAME_RATES[0]).select("key", "ord", "start_us")


@query("""
WITH m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 1234567 ELSE -event_id * 1234567 END AS us FROM events), a AS (SELECT event_id, us < 0 AS neg, (abs(us) + 500) // 1000 AS ms FROM m)
SELECT event_id, CASE WHEN neg THEN '-' ELSE '' END || format('{:02d}:{:02d}:{:02d},{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS shown FROM a""")
def fn2_signed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return tables.load(spark, sf_dir, "events").select(i, time.format_editor(F.when(i % 2 == 0, i * 1_234_567).otherwise(-i * 1_234_567)).alias("shown"))


@query("""
WITH s AS (SELECT event_id, (event_id * 1777777 + 500000) // 1000000 AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN format('{:d}:{:02d}:{:02d}', s // 3600, s // 60 % 60, s % 60) WHEN s >= 60 THEN format('{:d} min {:d} s', s // 60, s % 60) ELSE format('{:d} s', s) END AS shown FROM s""")
def fn4_for_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events").select("event_id", time.for_people(F.col("event_id") * 1_777_777).alias("shown"))


@query("SELECT o_orderkey, o_orderkey * 40000 AS us FROM orders")
def fn5_times_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "orders").select("o_orderkey", time.time_of_frame("o_orderkey", 40_000).alias("us"))


@query("""
WITH n AS (SELECT conv_id, turn, length(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), '')) AS n FROM conversations)
SELECT conv_id, turn, CAST(n AS DOUBLE) AS chars, CAST(ceil(n * 1000000 / 20.0) AS BIGINT) AS english_us, CAST(ceil(n * 1000000 / 12.0) AS BIGINT) AS korean_us FROM n""")
def fn10_reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.reading_chars("text").alias("chars"), text.needed_us("text", "en").alias("english_us"), text.needed_us("text", "ko-KR").alias("korean_us"))


@query("SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\\x{1100}-\\x{11FF}\\x{2E80}-\\x{9FFF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FF60}]', '', 'g')) AS BIGINT) AS columns FROM documents")
def fn11_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "documents").select("doc_id", text.columns_wide("text").cast("long").alias("columns"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Hyper Knife ' || p_size WHEN 1 THEN 'Some Film ' || p_size WHEN 2 THEN 'A.B. Show'[1:1] || ' B Show' ELSE 'x' || p_size END AS show FROM part")
def fn23_show_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat(F.lit("/tv/Hyper.Knife_"), size, F.lit(" - S01E03 - Episode 3.ko.srt"))).when(k == 1, F.concat(F.lit("C:\\Some Film "), size, F.lit(".en.forced.srt"))).when(k == 2, F.lit("A B_Show 1x07.mkv")).otherwise(F.concat(F.lit("x"), size, F.lit(" ep12.mkv")))
    return tables.load(spark, sf_dir, "part").select("p_partkey", text.show_name(name).alias("show"))


@query("SELECT event_id, CAST(round(10 * log10(value + 1e-10) * 1000) AS BIGINT) AS db, CAST(round(12 * log2((value + 1) / 55.0) * 1000) AS BIGINT) AS semitones, round(greatest(0, least(1, (value - 10) / 40.0)), 6) AS ramp FROM events")
def fn37_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events")
    whole = lambda c: F.round(c * 1000).cast("long")
    return e.select("event_id", whole(maths.decibels("value")).alias("db"), whole(maths.semitones(F.col("value") + 1, F.lit(55.0))).alias("semitones"), F.round(maths.ramp("value", 10.0, 50.0), 6).alias("ramp"))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, v, i, i * (len(v) - 1) / 6.0 AS x FROM v, range(0, 7) t(i))
SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(round((v[CAST(floor(x) AS BIGINT) + 1] + (v[least(CAST(floor(x) AS BIGINT) + 1, len(v) - 1) + 1] - v[CAST(floor(x) AS BIGINT) + 1]) * (x - floor(x))) * 1000000) AS BIGINT) AS millionths FROM p""")
def fn39_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(maths.resample(F.transform("embedding", lambda x: x.cast("double")), 7)).alias("i", "x"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x") * 1_000_000).cast("long").alias("millionths"))


@query("SELECT event_id FROM events WHERE event_type <> 'view'")
def prj13_log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events").where("event_type <> 'view'").select("event_id")


@query("""
SELECT event_id, CAST(round(greatest(-12, least(3, (20 - value) * 0.8)) * 1000) AS BIGINT) AS gain,
  CAST(round(cos(radians(greatest(-25, least(25, degrees(atan2(event_id % 7 + 1, value + 1)) - 45)) + 45)) * 1000) AS BIGINT) AS l, CAST(round(sin(radians(greatest(-25, least(25, degrees(atan2(event_id % 7 + 1, value + 1)) - 45)) + 45)) * 1000) AS BIGINT) AS r FROM events""")
def prj20_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = lines.panned(F.col("value") + 1, F.col("event_id") % 7 + 1)
    whole = lambda c: F.round(c * 1000).cast("long")
    return tables.load(spark, sf_dir, "events").select("event_id", whole(lines.followed_gain("value", F.lit(20.0))).alias("gain"), whole(left).alias("l"), whole(right).alias("r"))


@query("""
WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, CAST(round(10 * log10(greatest(avg(value * value / 1000000), 1e-12)) * 1000) AS BIGINT) AS db FROM o WHERE r > n // 2 GROUP BY 1""")
def agg13_active_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    e = tables.load(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w.orderBy("value", "event_id")).alias("r"), F.count("*").over(w).alias("n")).where("r > n div 2")
    power = F.greatest(F.avg(F.col("value") * F.col("value") / 1_000_000), F.lit(1e-12))
    return e.groupBy("user_id").agg(F.round(10 * F.log10(power) * 1000).cast("long").alias("db"))


@query(r"""
WITH {cu}, a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS i FROM cu WHERE role = 'assistant'), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS i FROM cu WHERE role = 'user'),
n AS (SELECT a.key FROM a GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM b WHERE b.key = a.key) AND count(*) = (SELECT count(*) FROM a x JOIN b y ON x.key = y.key AND x.i = y.i AND abs(x.start_us - y.start_us) < 4000000 WHERE x.key = a.key)),
d AS (SELECT a.key, a.ord, regexp_replace(b.text, '^\s+|\s+$', '', 'g') AS original FROM a JOIN b ON a.key = b.key AND a.i = b.i WHERE a.key IN (SELECT key FROM n)),
m AS (SELECT a.key, a.ord, b.start_us, b.ord AS o, regexp_replace(b.text, '^\s+|\s+$', '', 'g') AS text FROM a JOIN b ON a.key = b.key AND a.start_us < b.end_us AND b.start_us < a.end_us AND a.end_us > a.start_us AND b.end_us > b.start_us
  WHERE a.key NOT IN (SELECT key FROM n) AND (least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us)) * 100 >= least(a.end_us - a.start_us, b.end_us - b.start_us) * 40),
j AS (SELECT key, ord, string_agg(text, chr(10) ORDER BY start_us, o) AS original FROM m GROUP BY 1, 2)
SELECT * FROM d UNION ALL SELECT a.key, a.ord, j.original FROM a LEFT JOIN j ON a.key = j.key AND a.ord = j.ord WHERE a.key NOT IN (SELECT key FROM n)""")
def jn2_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = tables.cues(spark, sf_dir)
    return review.originals_of(cu.where("role = 'assistant'"), cu.where("role = 'user'"), 4_000_000, 4_000_000).select("key", "ord", "original")


@query("SELECT a.o_orderkey, b.o_orderkey AS candidate FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority <> b.o_orderpriority AND a.o_orderstatus = 'P'")
def jn20_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.load(spark, sf_dir, "orders")
    return choices.in_other_languages(o.where("o_orderstatus = 'P'"), o, "o_custkey", "o_orderkey", "o_orderpriority").select("o_orderkey", "candidate")


@query("""
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 1 WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 3 END, o_orderkey) = 1""")
def jn22_priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.first_usable(tables.load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", [F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT"])


@query("""
WITH v AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) SELECT user_id, event_id FROM v WHERE last IS NULL OR md5(last) <> md5(event_type)""")
def snk6_changed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events")
    return choices.changed_snapshots(e, "user_id", ["ts", "event_id"], ["event_type", "value"], ["value"]).select("user_id", "event_id")


@query("""
SELECT o_orderkey, count(*) >= 3 AND count(*) FILTER (WHERE l_returnflag = 'N') = max(l_linenumber) - 2 AND o_totalprice - sum(l_extendedprice) <= greatest(2, o_totalprice * 0.01) AS good FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def snk11_output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = tables.load(spark, sf_dir, "orders"), tables.load(spark, sf_dir, "lineitem")
    found = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_totalprice").agg(
        F.count("*").alias("streams"), F.count_if(F.col("l_returnflag") == "N").alias("kept"), F.max("l_linenumber").alias("planned"), F.sum("l_extendedprice").alias("length")
    )
    short = F.col("o_totalprice") - F.col("length") <= F.greatest(F.lit(2.0), F.col("o_totalprice") * 0.01)
    return found.select("o_orderkey", ((F.col("streams") >= 3) & (F.col("kept") == F.col("planned") - 2) & short).alias("good"))


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY least(len(string_split(text, chr(10))), 2) DESC, length(text) DESC, conv_id, turn) <= 12")
def srt6_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("role").orderBy(F.desc(F.least(F.size(F.split("text", "\n")), F.lit(2))), F.desc(F.length("text")), "conv_id", "turn")
    return tables.load(spark, sf_dir, "conversations").withColumn("_n", F.row_number().over(w)).where("_n <= 12").select("conv_id", "turn")


@query("SELECT event_id, CASE WHEN event_id % 40 < 5 OR event_id % 40 >= 31 THEN 0.0 ELSE least(1.0, (event_id % 40 - 4) / 8.0, (31 - event_id % 40) / 8.0) END AS weight FROM events")
def isl21_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events").select("event_id", lines.trapezoid(F.col("event_id") % 40, F.lit(5), F.lit(31), 8).alias("weight"))


@query("""
SELECT event_id, least(event_id % 50, coalesce(lag(event_id % 50) OVER w, event_id % 50)) AS x0, greatest(event_id % 50 + 9, coalesce(lag(event_id % 50 + 9) OVER w, event_id % 50 + 9)) AS x1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def isl29_carried_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events").withColumns({"x0": F.col("event_id") % 50, "x1": F.col("event_id") % 50 + 9})
    return choices.carried(e, "user_id", ["ts", "event_id"], ["x0"], ["x1"]).select("event_id", "x0", "x1")


@query("""
WITH f AS (SELECT lower(c_name) || ['.mkv', '.SRT', '.mp3', '.txt', ''][c_custkey % 5 + 1] AS path, c_custkey % 5 AS k FROM customer)
SELECT CASE k WHEN 0 THEN 'video' WHEN 1 THEN 'subtitle' WHEN 2 THEN 'audio' END AS kind, count(DISTINCT path) AS n FROM f GROUP BY 1""")
def src8_scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*(F.lit(x) for x in (".mkv", ".SRT", ".mp3", ".txt", ""))), (F.col("c_custkey") % 5 + 1).cast("int"))
    c = tables.load(spark, sf_dir, "customer").select(F.concat("c_name", ending).alias("path"))
    found = c.unionByName(c.select(F.upper("path").alias("path")))
    return found.select(F.lower("path").alias("path"), lines.media_kind("path").alias("kind")).dropDuplicates(["path"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, ['ko', 'de', 'fr', 'en', NULL, NULL][c_custkey % 6 + 1] AS code, ['kor', 'ger', 'fre', 'eng', NULL, NULL][c_custkey % 6 + 1] AS tag FROM customer")
def fn31_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(x) for x in ("kor", "deu", "FRE", "en-US", "und", "xx"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return tables.load(spark, sf_dir, "customer").select("c_custkey", languages.code_of(said).alias("code"), languages.tag_of(said).alias("tag"))


@query()
def jn10_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "embeddings").where("label is not null")
    speakers = e.where("vec_id % 2 = 0").select(F.col("label").alias("key"), F.col("vec_id").alias("speaker"), "embedding")
    people = e.where("vec_id % 2 = 1").select(F.col("label").alias("key"), F.col("vec_id").alias("person"), "embedding")
    return people_of.recognised(speakers, people, 0.2)


@query()
def srt12_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.load(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("speaker"), F.when(F.col("c_custkey") % 3 > 0, F.when(F.col("c_custkey") % 3 == 1, "male").otherwise("female")).alias("gender"), F.round("c_acctbal").cast("int").alias("lines"), F.lit(None).cast("string").alias("voice"), F.lit(False).alias("by_hand"))
    return people_of.with_voices(rows, {"female": [f"f{i}" for i in range(9)], "male": [f"m{i}" for i in range(7)]})


@query()
def agg27_voice_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = tables.load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.row_number().over(w).alias("frame"), F.when(F.col("value") > 5, F.when(F.col("value") > 20, F.floor(F.col("value") / 20) * 20).otherwise(0.0)).alias("hz"))
    return voices.voice_shape(e)


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT vec_id, list_transform(range(0, 16), lambda p: sqrt(list_sum(list_transform(v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16], lambda x: x * x)) / greatest(1, (p + 1) * len(v) // 16 - p * len(v) // 16))) AS s FROM v),
a AS (SELECT vec_id, list_transform(range(1, 17), lambda i: (s[greatest(i - 1, 1)] + 2 * s[i] + s[least(i + 1, 16)]) / 4) AS s FROM e), b AS (SELECT vec_id, list_transform(range(1, 17), lambda i: (s[greatest(i - 1, 1)] + 2 * s[i] + s[least(i + 1, 16)]) / 4) AS s FROM a),
c AS (SELECT vec_id, list_transform(range(1, 17), lambda i: (s[greatest(i - 1, 1)] + 2 * s[i] + s[least(i + 1, 16)]) / 4) AS s FROM b), d AS (SELECT vec_id, list_transform(range(1, 17), lambda i: (s[greatest(i - 1, 1)] + 2 * s[i] + s[least(i + 1, 16)]) / 4) AS s FROM c)
SELECT vec_id, i - 1 AS i, CAST(round(s[i] / list_avg(s) * 1000000) AS BIGINT) AS millionths FROM d, range(1, 17) t(i) WHERE list_avg(s) > 1e-6""")
def agg25_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(voices.emphasis("embedding")).alias("i", "x"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x") * 1_000_000).cast("long").alias("millionths"))


@query("""
WITH b AS (SELECT p_partkey, p_brand, p_size, p_partkey % 60 AS x FROM part WHERE abs(p_partkey % 60 + 10 - 50) <= 25 AND p_size BETWEEN 0.55 * 25 AND 1.7 * 25) SELECT p_partkey FROM b QUALIFY count(*) OVER (PARTITION BY p_brand, p_partkey // 100) <= 3""")
def prj10_kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.load(spark, sf_dir, "part")
    boxes = p.select("p_partkey", F.col("p_brand").alias("key"), F.floor(F.col("p_partkey") / 100).alias("sample"), F.lit("Some words here").alias("text"), (F.col("p_partkey") % 60).alias("x"), F.lit(20).alias("width"), F.col("p_size").alias("height"), F.lit(100).alias("frame_width"), F.lit(25).alias("usual"))
    return voices.kept_lines(boxes, "usual").select("p_partkey")


@query("""
WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events), m AS (SELECT user_id, max(value) FILTER (r = n // 2) AS median FROM o WHERE n >= 20 GROUP BY 1)
SELECT event_id, median FROM events JOIN m USING (user_id) WHERE abs(value - median) >= 40""")
def prj12_miscast_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.far_from_median(tables.load(spark, sf_dir, "events"), "user_id", "value", 40.0, 20, 40.0).select("event_id", "median")


@query(r"""
WITH k AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^\p{L}\p{Nd}]', '', 'g') AS k FROM conversations), p AS (SELECT conv_id, max(k) FILTER (turn = 0) AS p FROM k GROUP BY 1),
w AS (SELECT k.conv_id, k.turn, k.k[1:length(p.p) * (k.turn % 4 + 1) // 4] AS part, p.p FROM k JOIN p USING (conv_id)), e AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN p[1:CAST(length(p) * (turn % 5 + 1) // 5 AS BIGINT)] ELSE part END AS said, p FROM w)
SELECT conv_id, turn, length(said) >= greatest(3, length(p) * 0.6) AND contains(p, said) AS echo FROM e""")
def prj16_prompt_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against the conversation's first one, every other turn replaced by a beginning of it."""
    c = tables.load(spark, sf_dir, "conversations").select("conv_id", "turn", text.letters_key("text").alias("k"))
    p = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("k"))).alias("p"))
    n = F.length("p")
    said = F.when(F.col("turn") % 2 == 0, F.substr("p", F.lit(1), F.floor(n * (F.col("turn") % 5 + 1) / 5).cast("int"))).otherwise(F.substr("k", F.lit(1), F.floor(n * (F.col("turn") % 4 + 1) / 4).cast("int")))
    return c.join(p, "conv_id").select("conv_id", "turn", lines.echo_of(said, "p").alias("echo"))


@query("SELECT user_id, event_id AS idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number, CASE WHEN event_id % 5 > 0 THEN event_type END AS language FROM events WHERE event_id % 3 = 1")
def src10_audio_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    tags = F.when(i % 5 > 0, F.create_map(F.when(i % 2 == 0, "Language").otherwise("language"), "event_type"))
    stream = F.struct(i.alias("index"), F.when(i % 3 == 1, "audio").otherwise("video").alias("codec_type"), tags.alias("tags"))
    files = tables.load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(stream), lambda a, b: (a["index"] - b["index"]).cast("int")).alias("streams"))).alias("json"))
    return probe.audio_tracks(files).select(F.col("key").alias("user_id"), F.col("index").alias("idx"), "number", "language")


@query("""
WITH g AS (SELECT o_custkey AS key, list(CASE o_orderkey % 5 WHEN 0 THEN '"' || o_orderpriority || '"' WHEN 1 THEN '-x' WHEN 2 THEN ' ' || o_orderstatus || ' ' ELSE o_orderkey::VARCHAR END ORDER BY o_orderkey) AS a FROM orders GROUP BY 1),
e AS (SELECT key, unnest(a) AS a, generate_subscripts(a, 1) AS i FROM g), b AS (SELECT key, i, trim(trim(trim(a), '"')) AS a FROM e WHERE a NOT LIKE '-%'), f AS (SELECT DISTINCT o_orderpriority AS p FROM orders UNION SELECT 'P'),
x AS (SELECT key, a, min(i) AS i FROM b JOIN f ON f.p = b.a GROUP BY 1, 2) SELECT key, '/in/' || a AS path, row_number() OVER (PARTITION BY key ORDER BY i) AS n FROM x""")
def src21_given_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = tables.load(spark, sf_dir, "orders"), F.col("o_orderkey")
    arg = F.when(k % 5 == 0, F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))).when(k % 5 == 1, "-x").when(k % 5 == 2, F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).otherwise(k.cast("string"))
    args = o.groupBy(F.col("o_custkey").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), arg.alias("a")))), lambda x: x["a"]).alias("args"))
    files = o.select(F.concat(F.lit("/in/"), "o_orderpriority").alias("path")).distinct().unionByName(o.where("o_orderstatus = 'P'").select(F.concat(F.lit("/in/"), "o_orderstatus").alias("path")).distinct())
    return paths.given_paths(args, files, "/in")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase', 'signup') AND user_id % 3 = 1")
def prj13_log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "purchase", "warning").when(F.col("event_type") == "view", "info").when(F.col("event_type") == "click", "DETAIL").otherwise(F.col("event_type"))
    rows = tables.load(spark, sf_dir, "events").select("event_id", level.alias("level"), (F.col("user_id") % 3).cast("string").alias("area"))
    return logs.of_level(rows, "warning", "1").select("event_id")


@query("""
SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text, ['UTF-8', 'UTF-8 (BOM)', 'UTF-16 LE', 'UTF-16 BE'][doc_id % 4 + 1] AS encoding FROM documents WHERE text IS NOT NULL""")
def src2_decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with line ends of another kind as the bytes of a file in one of four encodings, and read from them."""
    d, k = tables.load(spark, sf_dir, "documents").where("text is not null"), F.col("doc_id") % 4
    t = F.regexp_replace("text", "\n", "\r\n")
    content = F.when(k == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(t, "UTF-8"))).when(k == 2, F.concat(F.lit(b"\xff\xfe"), F.encode(t, "UTF-16LE"))).when(k == 3, F.concat(F.lit(b"\xfe\xff"), F.encode(t, "UTF-16BE"))).otherwise(F.encode(t, "UTF-8"))
    return text_files.decoded(d.select(F.col("doc_id").alias("key"), content.alias("content"))).withColumnRenamed("key", "doc_id")


@query("WITH l AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS l FROM documents) SELECT doc_id, CAST(i - 1 AS BIGINT) AS i, l[i] AS line FROM l, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)")
def src3_numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.encode(F.replace("text", F.lit("\n"), F.lit("\r")), "UTF-8").alias("content"))
    found = text_files.numbered_lines(text_files.decoded(d))
    return found.select(F.col("key").alias("doc_id"), F.col("i").cast("long").alias("i"), "line")


@query("WITH {iv} SELECT key, ord FROM iv WHERE end_us > start_us")
def prj1_positive_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.positive(tables.intervals(spark, sf_dir)).select("key", "ord")


@query("SELECT event_id, CASE WHEN value + 120 < 160 THEN 'male' ELSE 'female' END AS gender FROM events")
def prj19_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events").select("event_id", lines.gender_of(F.col("value") + 120).alias("gender"))


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN w IN ('red', 'blue') THEN 'Azure-Red' WHEN w = 'ring' THEN 'Ring $1' ELSE w END), ' ') AS text FROM part""")
def jn17_listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    return names.with_list(p, {"Azure-Red": ["RED", "blue"], "Ring $1": ["ring"]})


@query("SELECT name, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part UNION ALL SELECT unnest(string_split(p_type, ' ')) FROM part) GROUP BY 1")
def set1_names_and_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names and variants put together, repeated ones too, and how often each is met."""
    p = tables.load(spark, sf_dir, "part")
    each = lambda c: p.select(F.explode(F.split(c, " ")).alias("name"))
    return each("p_name").unionByName(each("p_type")).groupBy("name").agg(F.count("*").alias("n"))

"""Registered queries of spoken lines: words and numbers, spans of voices, fitting, tracks of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import lines, numbers, spelling
from .operators import ranks, spans, tracks, words
from .plans import pipelines, tables
from .queries import query
from .sources import dictionary


def _two(n: str) -> str:
    ones, tens = (str(x) for x in (numbers.ONES, numbers.TENS))
    return f"CASE WHEN {n} < 20 THEN {ones}[{n} + 1] ELSE {tens}[{n} // 10 - 1] || CASE WHEN {n} % 10 > 0 THEN ' ' || {ones}[{n} % 10 + 1] ELSE '' END END"


def _three(n: str) -> str:
    return f"CASE WHEN {n} >= 100 THEN {_two(f'({n} // 100)')} || ' hundred' || CASE WHEN {n} % 100 > 0 THEN ' ' || {_two(f'({n} % 100)')} ELSE '' END ELSE {_two(f'({n} % 100)')} END"


def _cardinal(n: str) -> str:
    """In SQL, for numbers from 0 to below a thousand millions."""
    group = lambda size, name: f"CASE WHEN {n} // {size} % 1000 > 0 THEN {_three(f'({n} // {size} % 1000)')} || ' {name}' END"
    return f"concat_ws(' ', {group(1000000, 'million')}, {group(1000, 'thousand')}, CASE WHEN {n} % 1000 > 0 OR {n} = 0 THEN {_three(f'({n} % 1000)')} END)"


@query(f"""
WITH k AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice * 100) AS BIGINT) % 1000000007 * 7 % 900000000 AS n, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(floor(o_totalprice) AS BIGINT) AS whole, o_orderkey % 100 AS cents FROM orders)
SELECT k, {_cardinal("n")} AS cardinal, CASE WHEN y BETWEEN 2000 AND 2009 THEN {_cardinal("y")} ELSE {_cardinal("(y // 100)")} || ' ' || CASE WHEN y % 100 = 0 THEN 'hundred' WHEN y % 100 < 10 THEN 'oh ' || {_cardinal("(y % 100)")} ELSE {_cardinal("(y % 100)")} END END AS year,
  concat_ws(' ', CASE WHEN whole > 0 OR cents = 0 THEN {_cardinal("whole")} || CASE WHEN whole = 1 THEN ' dollar' ELSE ' dollars' END END,
    CASE WHEN cents > 0 THEN CASE WHEN whole > 0 THEN 'and ' ELSE '' END || {_cardinal("cents")} || CASE WHEN cents = 1 THEN ' cent' ELSE ' cents' END END) AS money FROM k""")
def fn33_number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a small file would be one task, however long its rows take
    o = tables.load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.floor(F.col("o_totalprice") * 100) % 1_000_000_007 * 7 % 900_000_000
    whole = F.floor("o_totalprice").cast("string")
    money = F.concat(F.lit("$"), whole, F.lit("."), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    return o.select(F.col("o_orderkey").alias("k"), numbers.cardinal(n).alias("cardinal"), numbers.spoken(F.year("o_orderdate").cast("string")).alias("year"), numbers.spoken(money).alias("money"))


@query()
def fn34_spelled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.load(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word")).distinct()
    return d.select("word", spelling.romanized_sounds("word").alias("romanized"), spelling.spelled_sounds("word").alias("spelled"))


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
e AS (SELECT word, word || 't' AS sounds, length(word) % 2 = 0 AS gold FROM b WHERE length(word) > 1),
f AS (SELECT word, 0 AS turn, word AS form, '' AS ending FROM w
  UNION ALL SELECT word, t, form, ending FROM (SELECT word, lower(word) AS l FROM w) x, LATERAL (SELECT * FROM (VALUES
    (1, l, '', true), (2, l[:-2], 's', length(l) >= 3 AND l LIKE '%s' AND l NOT LIKE '%ss'), (3, l[:-3], 's', length(l) > 4 AND l LIKE '%es' AND l NOT LIKE '%ies'), (4, l[:-4] || 'y', 's', length(l) > 4 AND l LIKE '%ies'),
    (5, l[:-2], 'ed', length(l) >= 4 AND l LIKE '%d' AND l NOT LIKE '%dd'), (6, l[:-3], 'ed', length(l) > 4 AND l LIKE '%ed' AND l NOT LIKE '%eed'),
    (7, l[:-4], 'ing', length(l) > 5 AND l LIKE '%ing'), (8, l[:-4] || 'e', 'ing', length(l) >= 5 AND l LIKE '%ing'), (9, l[:-5], 'ing', length(l) > 5 AND (l LIKE '%cking' OR l LIKE '%ing' AND l[-5:-5] = l[-4:-4] AND l[-4:-4] IN ('b','c','d','g','k','l','m','n','p','r','s','t','v','x','z')))
  ) v(t, form, ending, tried) WHERE tried AND (word = l OR word = upper(word) AND length(word) > 1 OR word[2:] = l[2:] AND length(word) > 1))),
m AS (SELECT f.word, f.form, f.ending, e.gold, e.sounds FROM f JOIN e ON e.word = f.form QUALIFY row_number() OVER (PARTITION BY f.word ORDER BY f.turn) = 1)
SELECT word, form, ending, gold, CASE ending WHEN 's' THEN sounds || 's' WHEN 'ed' THEN CASE WHEN regexp_matches(sounds, '[iu]t$') THEN sounds[:-2] || 'ɾᵻd' ELSE sounds || 'ᵻd' END
  WHEN 'ing' THEN CASE WHEN regexp_matches(sounds, '[iu]t$') THEN sounds[:-2] || 'ɾɪŋ' ELSE sounds || 'ɪŋ' END ELSE sounds END AS sounds FROM m""")
def jn13_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of the benchmark's words, each said as it is spelled with a t; words of documents that it knows."""
    said = tables.load(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word"))
    known = tables.load(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct().where("length(word) > 1")
    entries = known.select("word", F.concat("word", F.lit("t")).alias("sounds"), (F.length("word") % 2 == 0).alias("gold"))
    return words.looked_up(said, entries).where("source = 'dictionary'").drop("source")


@query("""
WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part), a AS (SELECT word, word AS sounds, true AS gold FROM p)
SELECT word, sounds, gold FROM a UNION ALL SELECT upper(word[1:1]) || word[2:], sounds, gold FROM a""")
def src17_grown_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.load(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("word")).distinct()
    return dictionary.grown(p.select("word", F.col("word").alias("sounds"), F.lit(True).alias("gold")))


@query("""
WITH l AS (SELECT user_id AS key, epoch_us(ts) // 600000000 AS frame, max(value) - 60 AS level FROM events GROUP BY 1, 2), o AS (SELECT user_id AS key, event_id AS ord, epoch_us(ts) // 600000000 AS a, epoch_us(ts) // 600000000 + event_id % 40 AS b FROM events WHERE event_id % 5 = 0),
q AS (SELECT o.key, o.ord, l.level, row_number() OVER (PARTITION BY o.key, o.ord ORDER BY l.level) - 1 AS r, count(*) OVER (PARTITION BY o.key, o.ord) AS n FROM o JOIN l ON l.key = o.key AND l.frame >= o.a AND l.frame < o.b),
w AS (SELECT key, ord, level AS own FROM q WHERE r = n * 3 // 4), t AS (SELECT o.*, greatest(CASE WHEN own IS NULL OR own < -80 THEN -40.0 ELSE own END - 30, -65.0) AS threshold FROM o LEFT JOIN w ON w.key = o.key AND w.ord = o.ord),
x AS (SELECT t.key, t.ord, t.a, t.b, l.frame FROM t JOIN l ON l.key = t.key AND l.level > t.threshold),
p AS (SELECT *, coalesce(lag(frame) OVER (PARTITION BY key, ord ORDER BY frame DESC), a) - frame AS gap FROM x WHERE frame < a), n AS (SELECT *, frame - coalesce(lag(frame) OVER (PARTITION BY key, ord ORDER BY frame), b - 1) AS gap FROM x WHERE frame >= b),
pp AS (SELECT key, ord, min(frame) AS f FROM (SELECT *, max(gap) OVER (PARTITION BY key, ord ORDER BY frame DESC) AS g FROM p) WHERE g <= 16 GROUP BY 1, 2), nn AS (SELECT key, ord, max(frame) + 1 AS f FROM (SELECT *, max(gap) OVER (PARTITION BY key, ord ORDER BY frame) AS g FROM n) WHERE g <= 16 GROUP BY 1, 2)
SELECT t.key, t.ord, CASE WHEN pp.f IS NULL THEN a ELSE greatest(pp.f, a - 150) END AS new_from, CASE WHEN nn.f IS NULL THEN b ELSE least(nn.f, b + 100) END AS new_to FROM t LEFT JOIN pp ON pp.key = t.key AND pp.ord = t.ord LEFT JOIN nn ON nn.key = t.key AND nn.ord = t.ord""")
def isl20_grown_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000).alias("frame"), "value")
    levels = e.groupBy("key", "frame").agg((F.max("value") - 60).alias("level"))
    given = e.where("ord % 5 = 0").select("key", "ord", F.col("frame").alias("from_frame"), (F.col("frame") + F.col("ord") % 40).alias("to_frame"))
    return spans.over_voice(given, levels, -40.0).select("key", "ord", "new_from", "new_to")


_STREAM_SQL = """s AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS index, ['video', 'audio', 'subtitle', 'attachment', 'data'][l_linenumber % 5 + 1] AS kind,
  CASE l_linenumber % 5 WHEN 0 THEN ['h264', 'hevc', 'vc1', 'png'][l_suppkey % 4 + 1] WHEN 1 THEN ['aac', 'ac3', 'pcm'][l_suppkey % 3 + 1] WHEN 2 THEN ['subrip', 'ass', 'mov_text', 'hdmv_pgs_subtitle', 'text'][l_suppkey % 5 + 1] ELSE 'bin' END AS codec,
  l_suppkey % 2 = 0 AS def, l_suppkey % 3 = 0 AS forced, l_suppkey % 5 = 0 AS hi, l_linenumber % 5 = 0 AND l_suppkey % 7 = 0 AS pic FROM lineitem),
f AS (SELECT o_orderkey AS key, o_orderkey % 2 = 0 AS mp4, o_orderkey % 3 > 0 AS keep, o_orderkey % 4 = 0 AS small FROM orders),
x AS (SELECT s.*, f.mp4, f.keep, f.small, CASE WHEN kind <> 'subtitle' THEN 'copy' WHEN mp4 THEN CASE WHEN codec = 'mov_text' THEN 'copy' ELSE 'mov_text' END WHEN codec IN ('mov_text', 'text') THEN 'srt' ELSE 'copy' END AS c FROM s JOIN f ON f.key = s.key)"""
_FLAGS = "coalesce(nullif(concat_ws('+', CASE WHEN {0} THEN 'default' END, CASE WHEN {1} THEN 'forced' END, CASE WHEN {2} THEN 'hearing_impaired' END), ''), '0')"


def _media(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of orders as streams of files, and what is asked of each."""
    at = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    k, i = F.col("l_suppkey"), F.col("l_linenumber")
    codec = F.when(i % 5 == 0, at(["h264", "hevc", "vc1", "png"], k)).when(i % 5 == 1, at(["aac", "ac3", "pcm"], k)).when(i % 5 == 2, at(["subrip", "ass", "mov_text", "hdmv_pgs_subtitle", "text"], k)).otherwise("bin")
    streams = tables.load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long").alias("index"), at(["video", "audio", "subtitle", "attachment", "data"], i).alias("kind"), codec.alias("codec"),
        (k % 2 == 0).alias("default"), (k % 3 == 0).alias("forced"), (k % 5 == 0).alias("hearing_impaired"), ((i % 5 == 0) & (k % 7 == 0)).alias("attached_picture"),
    )
    o = F.col("o_orderkey")
    asked = tables.load(spark, sf_dir, "orders").select(o.alias("key"), F.when(o % 2 == 0, "mp4").otherwise("mkv").alias("container"), (o % 3 > 0).alias("keep_subtitles"), (o % 4 == 0).alias("small"), (o % 5 == 0).alias("make_default"))
    return streams, asked


@query(f"""
WITH {_STREAM_SQL},
r AS (SELECT *, CASE WHEN kind = 'video' AND pic AND NOT mp4 THEN 'cover picture' WHEN kind = 'subtitle' AND NOT keep THEN 'subtitles are not kept' WHEN kind = 'subtitle' AND mp4 AND codec = 'hdmv_pgs_subtitle' THEN 'subtitles that are pictures'
    WHEN kind = 'attachment' AND mp4 THEN 'attachment' WHEN kind = 'data' THEN 'data' END AS gone, CASE WHEN mp4 AND codec IN ('vc1', 'pcm') THEN kind END AS refused FROM x),
a AS (SELECT key, 0 AS input, index, kind, CASE WHEN gone IS NOT NULL THEN 'drop' WHEN refused IS NOT NULL THEN 'refuse' WHEN c = 'copy' THEN 'copy' ELSE 'convert' END AS action, coalesce(gone, refused) AS reason, c,
    CASE WHEN kind = 'subtitle' THEN {_FLAGS.format("def AND NOT (key % 7 = 0 AND key % 10 < 8)", "forced", "hi")} END AS d, NULL AS language FROM r
  UNION ALL SELECT key, 1, 0, 'subtitle', CASE WHEN mp4 THEN 'convert' ELSE 'copy' END, NULL, CASE WHEN mp4 THEN 'mov_text' ELSE 'copy' END, {_FLAGS.format("key % 7 = 0", "key % 2 = 1", "false")}, CASE WHEN key % 3 = 0 THEN 'kor' ELSE 'und' END FROM f WHERE key % 10 < 8)
SELECT key, input, index, kind, action, reason, CASE WHEN action IN ('copy', 'convert') THEN c END AS codec, CASE WHEN action IN ('copy', 'convert') THEN d END AS disposition, language,
  CASE WHEN action IN ('copy', 'convert') THEN CAST(count_if(action <> 'drop') OVER (PARTITION BY key ORDER BY input, index) - 1 AS BIGINT) END AS output FROM a""")
def snk9_subtitle_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams, asked = _media(spark, sf_dir)
    k = F.col("key")
    new = asked.where(k % 10 < 8).select("key", F.lit(0).alias("index"), F.when(k % 3 == 0, "ko").alias("language"), F.lit(" ").alias("title"), (k % 7 == 0).alias("default"), (k % 2 == 1).alias("forced"), F.lit(False).alias("hearing_impaired"))
    plan = tracks.subtitle_plan(streams, new, asked.select("key", "container", "keep_subtitles"))
    return plan.drop("title")


@query(f"""
WITH {_STREAM_SQL},
g AS (SELECT *, max(kind = 'audio') OVER (PARTITION BY key) AS heard, min(CASE WHEN kind = 'video' AND NOT pic THEN index END) OVER (PARTITION BY key) AS picture FROM x),
r AS (SELECT *, CASE WHEN kind = 'data' THEN 'data' WHEN kind = 'video' AND pic AND NOT mp4 THEN 'cover picture' WHEN kind = 'attachment' AND mp4 THEN 'attachment' WHEN kind = 'subtitle' AND mp4 AND codec = 'hdmv_pgs_subtitle' THEN 'subtitles that are pictures' END AS gone,
    CASE WHEN small AND index = picture THEN 'small' WHEN small AND picture IS NOT NULL AND kind = 'audio' THEN 'aac' ELSE c END AS target FROM g WHERE heard),
a AS (SELECT key, 0 AS input, index, kind, CASE WHEN gone IS NOT NULL THEN 'drop' WHEN target = 'copy' THEN 'copy' ELSE 'convert' END AS action, gone AS reason, target, CASE WHEN kind = 'audio' THEN {_FLAGS.format("def AND key % 5 <> 0", "forced", "hi")} END AS d FROM r
  UNION ALL SELECT f.key, 1, 0, 'audio', CASE WHEN h.key IS NULL THEN 'refuse' ELSE 'copy' END, CASE WHEN h.key IS NULL THEN 'no sound' END, 'copy', CASE WHEN f.key % 5 = 0 THEN 'default' ELSE '0' END FROM f LEFT JOIN (SELECT DISTINCT key FROM x WHERE kind = 'audio') h ON h.key = f.key)
SELECT key, input, index, kind, action, reason, CASE WHEN action IN ('copy', 'convert') THEN target END AS codec, CASE WHEN action IN ('copy', 'convert') THEN d END AS disposition,
  CASE WHEN action IN ('copy', 'convert') THEN CAST(count_if(action <> 'drop') OVER (PARTITION BY key ORDER BY input, index) - 1 AS BIGINT) END AS output FROM a""")
def snk10_voice_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams, asked = _media(spark, sf_dir)
    return tracks.voice_plan(streams, asked.select("key", "container", "make_default", "small")).drop("title", "language")


@query("""
WITH l AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) * 10000 AS n, (event_id * 7919 % 500) * 10000 AS slot FROM events),
f AS (SELECT *, CASE WHEN n > slot AND slot >= 300000 AND least(n / slot * CAST(1.03 AS DOUBLE), CAST(1.3 AS DOUBLE)) > CAST(1.01 AS DOUBLE) THEN least(n / slot * CAST(1.03 AS DOUBLE), CAST(1.3 AS DOUBLE)) ELSE 1.0 END AS speed FROM l), q AS (SELECT *, n / speed AS quick FROM f)
SELECT event_id, CASE WHEN n <= slot OR n = 0 THEN 'natural' WHEN slot < 300000 THEN 'too long' WHEN quick <= slot THEN 'sped up' WHEN quick / slot <= 1.15 THEN 'stretched' ELSE 'too long' END AS kind, CAST(round(speed * 1000000) AS BIGINT) AS millionths,
  CAST(round(CASE WHEN n <= slot OR n = 0 OR slot < 300000 THEN n WHEN quick <= slot THEN quick WHEN quick / slot <= 1.15 THEN slot ELSE quick / CAST(1.15 AS DOUBLE) END) AS BIGINT) AS length_us FROM q""")
def sig9_fitted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events")
    found = lines.fitted(F.round(F.col("value") * 100).cast("long") * 10_000, F.col("event_id") * 7919 % 500 * 10_000)
    return e.select("event_id", found.alias("f")).select("event_id", F.col("f.kind").alias("kind"), F.round(F.col("f.speed") * 1_000_000).cast("long").alias("millionths"), F.col("f.length_us").alias("length_us"))


@query("""
WITH o AS (SELECT event_id, user_id, value AS level, CAST(event_id * 7919 % 1000 AS DOUBLE) AS bright FROM events),
d AS (SELECT user_id, level, row_number() OVER (PARTITION BY user_id ORDER BY level) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM o), b AS (SELECT user_id, bright, row_number() OVER (PARTITION BY user_id ORDER BY bright) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM o),
q AS (SELECT user_id, max(level) FILTER (r = n // 2) AS usual, max(level) FILTER (r = CAST(floor(n * 0.25) AS BIGINT)) AS quiet, max(level) FILTER (r = CAST(floor(n * 0.05) AS BIGINT)) AS low FROM d GROUP BY 1),
p AS (SELECT user_id, max(bright) FILTER (r = CAST(floor(n * 0.25) AS BIGINT)) AS dull, max(bright) FILTER (r = CAST(floor(n * 0.05) AS BIGINT)) AS dark FROM b GROUP BY 1)
SELECT event_id, CAST(round(CASE WHEN level < usual - 30 THEN 0 ELSE (CASE WHEN quiet <= low THEN CASE WHEN level <= low THEN 1 ELSE 0 END ELSE greatest(0, least(1, (quiet - level) / (quiet - low))) END)
  * (CASE WHEN dull <= dark THEN CASE WHEN bright <= dark THEN 1 ELSE 0 END ELSE greatest(0, least(1, (dull - bright) / (dull - dark))) END) END * 1000000) AS BIGINT) AS millionths FROM o JOIN q USING (user_id) JOIN p USING (user_id)""")
def sig18_voice_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.load(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("level"), (F.col("event_id") * 7919 % 1000).cast("double").alias("bright"))
    heard = ranks.at_ranks(o, ["user_id"], "level", {"usual": ranks.median(), "quiet": ranks.truncated(0.25), "low": ranks.truncated(0.05)}).drop("n")
    seen = ranks.at_ranks(o, ["user_id"], "bright", {"dull": ranks.truncated(0.25), "dark": ranks.truncated(0.05)}).drop("n")
    far = lines.voice_distance("level", "bright", *(F.col(c) for c in ("usual", "quiet", "low", "dull", "dark")))
    return o.join(heard, "user_id").join(seen, "user_id").select("event_id", F.round(far * 1_000_000).cast("long").alias("millionths"))


@query()
def pip10_fitted_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = tables.cues(spark, sf_dir).where("role <> 'system'").withColumn("spoken_us", F.length("text") * 40_000)
    return pipelines.voice_track(cues, "spoken_us", fit=True)

"""Registered queries of whole chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import pipelines, tables
from .queries import HOUR, MINUTE, query


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = tables.cues(spark, sf_dir)
    return cu.withColumns({"prob": (F.col("ord") * 37 % 100 + 1) / 100.0, "no_speech": (F.col("key") * 53 % 100) / 100.0})


@query()
def pip1_shaped_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech = tables.cues(spark, sf_dir).where("role = 'user'").select("key", "start_us", "end_us")
    return pipelines.shape_transcript(_segments(spark, sf_dir), speech)


@query("""
WITH RECURSIVE {iv}, w AS (SELECT key, start_us - 300000 AS s, end_us + 300000 AS e FROM iv WHERE kind = 'view' AND end_us > start_us),
f AS (SELECT *, CASE WHEN m IS NULL OR s - m >= 1000000 THEN 1 ELSE 0 END AS new FROM (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w)),
g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f),
u AS (SELECT key, greatest(min(s), 0) AS start_us, max(e) AS end_us FROM g GROUP BY key, island), s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start_us) AS rn FROM u),
r AS (SELECT key, rn, start_us, end_us, CAST(1 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS offset_us, end_us - start_us AS len FROM s WHERE rn = 1
UNION ALL SELECT key, rn, start_us, end_us, CASE WHEN fits THEN chunk ELSE chunk + 1 END, CASE WHEN fits THEN len + gap ELSE 0 END, CASE WHEN fits THEN len + gap + size ELSE size END FROM
  (SELECT s.*, r.chunk, r.len, s.end_us - s.start_us AS size, CASE WHEN s.start_us - r.end_us > 3600000000 THEN 60000000 ELSE 1000000 END AS gap,
    r.len + CASE WHEN s.start_us - r.end_us > 3600000000 THEN 60000000 ELSE 1000000 END + s.end_us - s.start_us <= 86400000000 AS fits FROM r JOIN s ON s.key = r.key AND s.rn = r.rn + 1))
SELECT key, start_us, end_us, chunk, offset_us FROM r""")
def pip2_planned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.plan_chunks(tables.intervals(spark, sf_dir).where("kind = 'view'"), 300_000, 1_000_000, 24 * HOUR, 1_000_000, HOUR, MINUTE)


@query("""
WITH {iv}, j AS (SELECT *, CASE WHEN ord % 5 > 1 THEN kind END AS l FROM iv),
f AS (SELECT *, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY key ORDER BY start_us, ord ROWS UNBOUNDED PRECEDING), first_value(l IGNORE NULLS) OVER (PARTITION BY key ORDER BY start_us, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lang FROM j),
t AS (SELECT key, l, sum(end_us - start_us) AS t FROM j WHERE l IS NOT NULL GROUP BY 1, 2), m AS (SELECT key, l AS main FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC, l) = 1),
a AS (SELECT f.*, m.main, CASE WHEN lag(lang) OVER (PARTITION BY f.key ORDER BY start_us, ord) = lang THEN 0 ELSE 1 END AS new FROM f JOIN m ON m.key = f.key),
b AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY start_us, ord ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT key, min(lang) AS value, min(start_us) AS start_us, max(end_us) AS end_us FROM b WHERE lang <> main GROUP BY key, run""")
def pip3_scene_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tables.intervals(spark, sf_dir).withColumns({"language": F.col("kind"), "prob": (F.col("ord") % 5) * 0.45})
    return pipelines.scene_languages(pieces)


@query(r"""
WITH {cu}, k AS (SELECT *, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]', '', 'g') AS k FROM cu), w AS (SELECT * FROM k WHERE ord % 3 <> 0), h AS (SELECT * FROM k WHERE ord % 2 = 0),
m AS (SELECT h.key, h.ord, min(w.ord) AS twin FROM h JOIN w ON h.key = w.key AND abs(h.start_us - w.start_us) <= 120000000 AND h.k <> '' AND w.k <> '' AND least(length(h.k), length(w.k)) >= greatest(length(h.k), length(w.k)) * 0.8
  AND 1 - levenshtein(h.k, w.k) / CAST(greatest(length(h.k), length(w.k)) AS DOUBLE) >= 0.8 GROUP BY 1, 2),
c AS (SELECT w.key, w.ord AS twin, w.end_us - w.start_us AS len, coalesce(sum(greatest(0, least(w.end_us, (i + 1) * 7000000 - 2000000) - greatest(w.start_us, i * 7000000))) FILTER (WHERE i IS NOT NULL), 0) AS covered FROM w LEFT JOIN range(0, 200) t(i) ON i * 7000000 < w.end_us AND (i + 1) * 7000000 - 2000000 > w.start_us AND w.end_us > w.start_us
  GROUP BY 1, 2, 3)
SELECT h.key, h.ord, CASE WHEN m.twin IS NULL THEN 'added' WHEN len <= 0 OR covered / len < 0.3 THEN 'moved' ELSE 'same' END AS outcome, m.twin FROM h LEFT JOIN m ON m.key = h.key AND m.ord = h.ord LEFT JOIN c ON c.key = m.key AND c.twin = m.twin""")
def pip4_heard_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = tables.cues(spark, sf_dir)
    step = F.explode(F.sequence(F.lit(0), F.lit(199))).alias("i")
    # the keys alone are so small that Spark would put them, and then the 200 rows of each, in one task; a given number it leaves
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    speech = cu.select("key").repartition(dealt, "key").distinct().select("key", step).select("key", (F.col("i") * 7_000_000).cast("long").alias("start_us"), (F.col("i") * 7_000_000 + 5_000_000).cast("long").alias("end_us"))
    return pipelines.heard_again(cu.where("ord % 3 <> 0"), cu.where("ord % 2 = 0"), speech)


@query("""
WITH RECURSIVE {iv}, s AS (SELECT key, ord, start_us, start_us + (ord * 37 % 1000) * 1000000 AS anchor, (ord * 13 % 400) * 60000000 AS len, lead(start_us) OVER (PARTITION BY key ORDER BY start_us, ord) - start_us AS slot FROM iv WHERE end_us > start_us),
p AS (SELECT key, ord, len, start_us + coalesce(least(greatest(0, anchor - start_us), greatest(0, slot - greatest(700000, CAST(floor(slot * 60 / 100) AS BIGINT)))), greatest(0, anchor - start_us)) AS t FROM s),
q AS (SELECT *, lead(t) OVER w - t AS slot, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY key ORDER BY t, ord)),
r AS (SELECT key, ord, rn, t, slot, t AS placed, t + len AS ends FROM q WHERE rn = 1
UNION ALL SELECT q.key, q.ord, q.rn, q.t, q.slot, CASE WHEN q.t < r.ends THEN r.ends + 100000 ELSE q.t END, CASE WHEN q.t < r.ends THEN r.ends + 100000 ELSE q.t END + q.len FROM r JOIN q ON q.key = r.key AND q.rn = r.rn + 1)
SELECT key, ord, t AS planned_us, slot AS slot_us, placed AS placed_us, ends AS ends_us, placed - t AS late_us FROM r""")
def pip10_voice_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.intervals(spark, sf_dir).withColumns({"anchor": F.col("start_us") + F.col("ord") * 37 % 1000 * 1_000_000, "spoken": F.col("ord") * 13 % 400 * MINUTE})
    return pipelines.voice_track(rows, "spoken", "anchor")


@query()
def pip11_bilingual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = tables.cues(spark, sf_dir)
    return pipelines.bilingual(cu.where("role = 'assistant'"), cu.where("role = 'user'"))


@query()
def pip12_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = tables.intervals(spark, sf_dir)
    return pipelines.synced(iv.where("kind = 'click'"), iv.where("kind = 'view'"), 20 * HOUR, 2 * HOUR, HOUR).select("key", "ord", "start_us", "end_us", "offset_us")


@query("""
SELECT '/films/' || c_name || '.mkv' AS video, '/films/' || c_name || ['.en.srt', '.de.forced.vtt'][c_custkey % 3] AS file, ['en', 'de'][c_custkey % 3] AS language FROM customer WHERE c_custkey % 3 > 0""")
def jn8_sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.load(spark, sf_dir, "customer").withColumn("base", F.concat(F.lit("/films/"), "c_name"))
    ending = F.element_at(F.array(F.lit("2.en.srt"), F.lit(".en.srt"), F.lit(".de.forced.vtt")), (F.col("c_custkey") % 3 + 1).cast("int"))
    found = pipelines.sidecars_of(c.select(F.concat("base", F.lit(".mkv")).alias("video")), c.select(F.concat("base", ending).alias("file")))
    return found.select("video", "file", F.col("info.language").alias("language"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def pip9_season_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    done = tables.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("string").alias("language"))
    todo, _ = pipelines.left_to_do(files, done, "1")
    return todo.select(F.col("key").alias("doc_id"))

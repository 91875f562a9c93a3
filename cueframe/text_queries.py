"""Registered queries over texts, names, and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fuzzy, lines, ocr, text
from .operators import intervals as ops
from .operators import names, review, vectors
from .plans import tables
from .queries import HOUR, MINUTE, query


@query(r"""
WITH p AS (SELECT conv_id, turn, text, list_sort(list_transform(list_filter(range(1, length(text)), lambda i: text[i + 1:i + 1] = ' '),
  lambda i: {'s': greatest(i, length(text) - i - 1) - CASE WHEN text[i:i] IN ('.', '?', '!', '。', '？', '！', '…', ',', ';', ':', '、', '，', '；', '：') THEN 4 ELSE 0 END, 'i': i}))[1].i AS brk FROM conversations)
SELECT conv_id, turn, CASE WHEN length(text) > 42 AND brk IS NOT NULL THEN regexp_replace(text[1:brk], '\s+$', '') || chr(10) || regexp_replace(text[brk + 1:], '^\s+', '') ELSE text END AS wrapped FROM p""")
def fn12_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "conversations").select("conv_id", "turn", text.wrap("text").alias("wrapped"))


@query(r"""
WITH t AS (SELECT conv_id, turn, text, string_split(text, chr(10)) AS l, trim(text) AS b FROM conversations),
p AS (SELECT *, list_sort(list_transform(list_filter(range(0, length(b)), lambda i: b[i + 1:i + 1] = ' '), lambda i: {'d': abs(i - length(b) // 2), 'i': i}))[1].i AS brk FROM t)
SELECT conv_id, turn, CASE WHEN len(l) > 1 THEN array_to_string(l[1:(len(l) + 1) // 2], chr(10)) WHEN brk IS NOT NULL THEN trim(b[1:brk]) ELSE b END AS a,
  CASE WHEN len(l) > 1 THEN array_to_string(l[(len(l) + 1) // 2 + 1:], chr(10)) WHEN brk IS NOT NULL THEN trim(b[brk + 2:]) ELSE '' END AS b FROM p""")
def fn14_split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.load(spark, sf_dir, "conversations").select("conv_id", "turn", lines.split_text("text").alias("s"))
    return c.select("conv_id", "turn", F.col("s.a").alias("a"), F.col("s.b").alias("b"))


@query("SELECT c_custkey, array_to_string(list_filter([trim(c_name), trim(c_mktsegment)], lambda x: x <> ''), chr(10)) AS text FROM customer")
def fn15_merged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "customer").select("c_custkey", lines.merged_text("c_name", "c_mktsegment").alias("text"))


@query()
def fn17_partial_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a small file would be one task, however long its rows take
    p = tables.load(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return p.select("p_partkey", fuzzy.partial_similarity("p_brand", "p_name").alias("fits"), fuzzy.coverage("p_brand", "p_name").alias("covered"), fuzzy.nearly_contains("p_name", "p_type").alias("inside"))


@query("""
SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^\\p{L}\\p{Nd}]', '', 'g'), '0+', '', 'g') AS k, levenshtein(regexp_replace(lower(c_name), '[^\\p{L}]', '', 'g'), regexp_replace(lower(c_mktsegment), '[^\\p{L}]', '', 'g')) <=
  CASE WHEN least(length(regexp_replace(lower(c_name), '[^\\p{L}]', '', 'g')), length(regexp_replace(lower(c_mktsegment), '[^\\p{L}]', '', 'g'))) >= 10 THEN 2 ELSE 1 END
  AND least(length(regexp_replace(lower(c_name), '[^\\p{L}]', '', 'g')), length(regexp_replace(lower(c_mktsegment), '[^\\p{L}]', '', 'g'))) >= 5
  AND (len(string_split(c_name, ' ')) = len(string_split(c_mktsegment, ' '))) AND (len(string_split(c_name, ' ')) = 1 OR split_part(c_name, ' ', 1) = split_part(c_mktsegment, ' ', 1)) AS near FROM customer""")
def fn21_nearly_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.load(spark, sf_dir, "customer")
    return c.select("c_custkey", F.regexp_replace(text.letters_key("c_name"), "0+", "").alias("k"), text.nearly_same("c_name", "c_mktsegment").alias("near"))


def _cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name people, some of them spelt otherwise now and then."""
    i = F.col("c_custkey")
    family = F.element_at(F.array(*(F.lit(x) for x in ("Kim", "Park", "Choi", "Han"))), (i % 4 + 1).cast("int"))
    given = F.element_at(F.array(*(F.lit(x) for x in ("Deok-gi", "Su-jin", "Min-hyuk"))), (i % 3 + 1).cast("int"))
    given = F.when(i % 11 == 0, F.regexp_replace(given, "u", "oo")).otherwise(given)
    said = F.concat(F.lit("Then "), family, F.lit(" "), given, F.lit(" met Doctor "), F.when(i % 13 == 0, "Ichiza").otherwise("Ichida"), F.lit(" at twenty-one. Ji-woo left."))
    return tables.load(spark, sf_dir, "customer").select(i.alias("id"), said.alias("text"))


@query("""
WITH c AS (SELECT ['Kim', 'Park', 'Choi', 'Han'][c_custkey % 4 + 1] || ' ' || CASE WHEN c_custkey % 11 = 0 THEN replace(['Deok-gi', 'Su-jin', 'Min-hyuk'][c_custkey % 3 + 1], 'u', 'oo') ELSE ['Deok-gi', 'Su-jin', 'Min-hyuk'][c_custkey % 3 + 1] END AS a,
  CASE WHEN c_custkey % 13 = 0 THEN 'Ichiza' ELSE 'Ichida' END AS b FROM customer)
SELECT name, count(*) AS n FROM (SELECT a AS name FROM c UNION ALL SELECT b FROM c UNION ALL SELECT 'Ji-woo' FROM c) GROUP BY name""")
def fn22_name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_counts(_cast(spark, sf_dir))


@query("""
WITH c AS (SELECT ['Kim', 'Park', 'Choi', 'Han'][c_custkey % 4 + 1] || ' ' || CASE WHEN c_custkey % 11 = 0 THEN replace(['Deok-gi', 'Su-jin', 'Min-hyuk'][c_custkey % 3 + 1], 'u', 'oo') ELSE ['Deok-gi', 'Su-jin', 'Min-hyuk'][c_custkey % 3 + 1] END AS a,
  CASE WHEN c_custkey % 13 = 0 THEN 'Ichiza' ELSE 'Ichida' END AS b FROM customer),
n AS (SELECT name, count(*) AS n FROM (SELECT a AS name FROM c UNION ALL SELECT b FROM c UNION ALL SELECT 'Ji-woo' FROM c) GROUP BY name), k AS (SELECT *, regexp_replace(lower(name), '[^\\p{L}]', '', 'g') AS k, string_split(name, ' ') AS w FROM n)
SELECT a.name, a.n, b.name AS usual, b.n AS usual_n FROM k a JOIN k b ON a.name <> b.name AND a.n * 2 <= b.n AND (a.k = b.k OR least(length(a.k), length(b.k)) >= 5 AND len(a.w) = len(b.w) AND (len(a.w) = 1 OR a.w[1] = b.w[1])
  AND levenshtein(a.k, b.k) <= CASE WHEN least(length(a.k), length(b.k)) >= 10 THEN 2 ELSE 1 END) QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY b.n DESC, b.name) = 1""")
def pip6_merged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.merge_targets(names.name_counts(_cast(spark, sf_dir)))


@query("""
SELECT c_custkey AS id, 'Then ' || ['Kim', 'Park', 'Choi', 'Han'][c_custkey % 4 + 1] || ' ' || CASE WHEN c_custkey % 11 = 0 THEN replace(['Deok-gi', 'Su-jin', 'Min-hyuk'][c_custkey % 3 + 1], 'u', 'oo') ELSE ['Deok-gi', 'Su-jin', 'Min-hyuk'][c_custkey % 3 + 1] END
  || ' met Doctor Ichida at twenty-one. Ji-woo left.' AS text, c_custkey % 13 = 0 AS changed FROM customer""")
def pip6_consistent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _cast(spark, sf_dir)
    targets = names.merge_targets(names.name_counts(said)).where("name = 'Ichiza'")
    return names.consistent(said, "id", targets)


@query()
def fn26_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.round(ocr.quality("text"), 6).alias("quality"), ocr.clean("text").alias("clean"))


@query(r"""
SELECT conv_id, turn, translate(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), ' '), '|', '/') AS line FROM conversations""")
def fn28_prepared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "conversations").select("conv_id", "turn", lines.prepared("text")["text"].alias("line"))


@query("SELECT o_orderkey, o_orderpriority AS first, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS second FROM orders")
def fn29_numbered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.load(spark, sf_dir, "orders")
    second = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\n2| "), "o_orderstatus")).otherwise("\n7|none")
    output = F.concat(F.lit("Sure:\n 1|"), "o_orderpriority", F.lit(" \n1|again"), second)
    found = o.select("o_orderkey", lines.numbered_answers(output, 2).alias("a"))
    return found.select("o_orderkey", F.col("a")[0].alias("first"), F.col("a")[1].alias("second"))


@query("SELECT doc_id, NULL::VARCHAR AS language FROM documents")
def fn25_foreign_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(text.foreign_letters("text", "ko"), text.dominant_script("text"))
    return tables.load(spark, sf_dir, "documents").select("doc_id", found.alias("language"))


@query("SELECT source, CASE WHEN count(*) < 0 THEN '' END AS language FROM documents GROUP BY 1")
def agg6_written_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.written_language(tables.load(spark, sf_dir, "documents"), "source", "text")


@query()
def agg7_best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.best_reading(tables.load(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_name").alias("txt")))


@query("""
WITH {iv}, v AS (SELECT * FROM iv WHERE kind = 'view'), e AS (SELECT * FROM iv WHERE kind = 'error'),
m AS (SELECT v.*, e.start_us AS r, e.end_us AS re, lag(v.end_us) OVER (PARTITION BY v.key ORDER BY v.start_us, v.ord) AS before FROM v ASOF LEFT JOIN e ON v.key = e.key AND v.start_us >= e.start_us)
SELECT key, ord, coalesce(re > start_us AND start_us - r >= 60000000 AND start_us - r <= 18000000000 AND r >= coalesce(before, 0), false) AS moved,
  CASE WHEN re > start_us AND start_us - r >= 60000000 AND start_us - r <= 18000000000 AND r >= coalesce(before, 0) THEN r ELSE start_us END AS start_us FROM m""")
def jn3_snapped_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = tables.intervals(spark, sf_dir)
    return ops.snap_starts(iv.where("kind = 'view'"), iv.where("kind = 'error'"), 5 * HOUR, MINUTE).select("key", "ord", "moved", "start_us")


@query("""
WITH {iv}, v AS (SELECT * FROM iv WHERE kind = 'view'), on_ AS (SELECT key, start_us AS t FROM iv WHERE kind = 'click'), off_ AS (SELECT key, end_us AS t FROM iv WHERE kind = 'error'),
a AS (SELECT v.key, v.ord, o.t FROM v JOIN on_ o ON o.key = v.key AND abs(o.t - v.start_us) <= 7200000000 QUALIFY row_number() OVER (PARTITION BY v.key, v.ord ORDER BY abs(o.t - v.start_us), o.t) = 1),
b AS (SELECT v.key, v.ord, o.t FROM v JOIN off_ o ON o.key = v.key AND abs(o.t - v.end_us) <= 7200000000 QUALIFY row_number() OVER (PARTITION BY v.key, v.ord ORDER BY abs(o.t - v.end_us), o.t) = 1),
m AS (SELECT v.*, coalesce(a.t, v.start_us) AS want, b.t AS off FROM v LEFT JOIN a USING (key, ord) LEFT JOIN b USING (key, ord)),
n AS (SELECT *, CASE WHEN want < end_us - 60000000 THEN want ELSE start_us END AS ns, lead(want) OVER w AS nw, lead(start_us) OVER w AS nx FROM m WINDOW w AS (PARTITION BY key ORDER BY start_us, ord)),
e AS (SELECT *, CASE WHEN off > nw - 40000 AND nx >= ns THEN nw - 40000 ELSE off END AS wanted FROM n)
SELECT key, ord, ns AS new_start_us, CASE WHEN wanted >= ns + 60000000 THEN wanted ELSE end_us END AS new_end_us FROM e""")
def jn4_snapped_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = tables.intervals(spark, sf_dir)
    onsets, offsets = iv.where("kind = 'click'").select("key", "start_us"), iv.where("kind = 'error'").select("key", F.col("end_us").alias("start_us"))
    return ops.snap_to_speech(iv.where("kind = 'view'"), onsets, offsets, 2 * HOUR, 40_000, MINUTE).select("key", "ord", "new_start_us", "new_end_us")


@query()
def jn5_uncovered_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = tables.intervals(spark, sf_dir)
    return ops.uncovered(iv.where("kind = 'view'"), iv.where("kind = 'error'"), MINUTE, MINUTE, HOUR, 2 * MINUTE, 4 * HOUR, HOUR)


@query("""
WITH {iv}, p AS (SELECT key, ord, start_us AS t FROM iv WHERE kind = 'click'), c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start_us, ord) AS i FROM iv WHERE kind = 'signup'),
r AS (SELECT key, start_us, start_us + 3600000000 AS end_us, ord * 10 AS src FROM c QUALIFY row_number() OVER (PARTITION BY key, start_us ORDER BY ord) = 1),
q AS (SELECT *, lead(src) OVER (PARTITION BY key ORDER BY start_us) AS nxt, first_value(src) OVER (PARTITION BY key ORDER BY start_us) AS first FROM r), f AS (SELECT DISTINCT key, first FROM q),
a AS (SELECT p.key, p.ord, p.t, q.start_us, q.end_us, q.src, q.nxt FROM p ASOF LEFT JOIN q ON p.key = q.key AND p.t >= q.start_us)
SELECT a.key, a.ord, CASE WHEN start_us IS NULL THEN first WHEN t < end_us THEN src + t - start_us ELSE coalesce(nxt, src + end_us - start_us) END AS source_us FROM a LEFT JOIN f ON a.key = f.key""")
def jn14_source_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = tables.intervals(spark, sf_dir)
    pieces = iv.where("kind = 'signup'").groupBy("key", "start_us").agg((F.min("ord") * 10).alias("source_us")).withColumn("end_us", F.col("start_us") + HOUR)
    return ops.source_times(iv.where("kind = 'click'"), pieces).select("key", "ord", "source_us")


@query()
def isl11_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drop_loops(tables.intervals(spark, sf_dir), "kind").select("key", "ord", "looped")


@query("SELECT event_id, greatest(CASE WHEN event_id % 9 = 0 THEN event_id * 1000 - 1000000 WHEN event_id * 1000 - 1000000 + 60000 > event_id * 1000 + 50000 - 1000000 THEN event_id * 1000 + 50000 - 1000000 - 60000 ELSE event_id * 1000 - 1000000 END, 0) AS start_us FROM events")
def prj6_preview_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events")
    medium = F.when(F.col("event_id") % 9 != 0, F.col("event_id") * 1000 + 50_000 - 1_000_000)
    return e.select("event_id", lines.preview_start(F.col("event_id") * 1000, 60_000, 1_000_000, medium).alias("start_us"))


@query("SELECT p_partkey, length(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) >= 2 AND p_size / 200.0 BETWEEN 0.02 AND 0.16 AND abs(p_partkey % 100 + 20 - 50) / 100.0 <= 0.2 AND true AS kept FROM part")
def prj9_subtitle_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.load(spark, sf_dir, "part")
    box = ocr.subtitle_like("p_name", F.col("p_partkey") % 100, F.lit(40), "p_size", F.lit(100), F.lit(200))
    return p.select("p_partkey", box.alias("kept"))


@query("SELECT event_id, CASE WHEN value < 160 THEN 'male' ELSE 'female' END AS gender, value BETWEEN 140 AND 185 OR event_id % 12 <= 6 AND value BETWEEN 125 AND 205 AS unsure FROM events")
def prj14_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events")
    return e.select("event_id", lines.gender_of("value").alias("gender"), lines.gender_uncertain("value", F.col("event_id") % 12).alias("unsure"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS known, event_id % 4 = 3 AS echo FROM events")
def prj15_known_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(x) for x in ("Thank you for watching!", "Subtitles by someone", "Thank you.", "the weather today"))), (F.col("event_id") % 4 + 1).cast("int"))
    return tables.load(spark, sf_dir, "events").select("event_id", lines.known_phrase(text.letters_key(said)).alias("known"), lines.echo_of(said, F.lit("On the weather: today")).alias("echo"))


@query("SELECT event_id FROM events WHERE abs(event_id - 500) <= 15 OR event_type = 'purchase'")
def prj21_line_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events")
    return e.where((F.abs(F.col("event_id") - 500) <= 15) | (F.col("event_type") == "purchase")).select("event_id")


@query("SELECT user_id, 30.0 + count(*) * 2.5 * 1.0 AS plain, (30.0 + count(*) * 2.5) * 1.5 AS eased FROM events GROUP BY 1")
def prj22_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", lines.estimated_seconds("n", 30.0, 2.5).alias("plain"), lines.estimated_seconds("n", 30.0, 2.5, True).alias("eased"))


@query("""
WITH i AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS language, c_custkey % 5 = 0 AS forced, c_custkey % 7 = 0 AS hi, c_custkey % 11 = 0 AS sdh, c_name FROM customer)
SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(coalesce(language, '~')), forced, hi OR sdh, lower(c_name), c_custkey) AS place FROM i""")
def srt2_sidecar_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    info = F.struct(F.when(k % 3 > 0, F.col("c_mktsegment")).alias("language"), (k % 5 == 0).alias("forced"), (k % 7 == 0).alias("hearing_impaired"), (k % 11 == 0).alias("sdh"))
    c = tables.load(spark, sf_dir, "customer").withColumn("info", info)
    w = Window.partitionBy("c_nationkey").orderBy(*lines.sidecar_order(F.col("info"), "c_name"), "c_custkey")
    return c.select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY upper(o_orderpriority), o_orderkey % 1000, length(CAST(o_orderkey % 1000 AS VARCHAR)), o_orderkey) AS place FROM orders""")
def srt3_folder_then_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.load(spark, sf_dir, "orders").withColumn("name", F.concat(F.lit("Episode "), (F.col("o_orderkey") % 1000).cast("string"), F.lit(".mkv")))
    w = Window.partitionBy("o_orderstatus").orderBy(F.upper("o_orderpriority"), *text.natural_order("name"), "o_orderkey")
    return o.select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH {cu}, e AS (SELECT key, ord, start_us, 0 AS side FROM cu UNION ALL SELECT key, ord, start_us, 1 FROM cu) SELECT key, ord, side, row_number() OVER (PARTITION BY key ORDER BY start_us, side, ord) AS place FROM e""")
def srt4_bilingual_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.cues(spark, sf_dir).select("key", "ord", "start_us", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    w = Window.partitionBy("key").orderBy("start_us", "side", "ord")
    return events.select("key", "ord", "side", F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH {iv}, f AS (SELECT key, ord, start_us, CASE WHEN kind = 'error' THEN ord END AS flag FROM iv)
SELECT key, ord, coalesce(first_value(flag IGNORE NULLS) OVER (PARTITION BY key ORDER BY start_us, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
  first_value(flag IGNORE NULLS) OVER (PARTITION BY key ORDER BY start_us, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next FROM f""")
def srt9_next_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.intervals(spark, sf_dir).withColumn("flag", F.when(F.col("kind") == "error", F.col("ord")))
    w = Window.partitionBy("key").orderBy("start_us", "ord")
    ahead = F.first("flag", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    around = F.first("flag", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("key", "ord", F.coalesce(ahead, around).alias("next"))


@query("WITH {cu} SELECT key, ord, row_number() OVER (PARTITION BY key, ord // 12 ORDER BY md5('7|' || key || '|' || ord), ord) AS place FROM cu")
def srt11_shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("key", F.floor(F.col("ord") / 12)).orderBy(F.md5(F.concat_ws("|", F.lit("7"), "key", "ord")), "ord")
    return tables.cues(spark, sf_dir).select("key", "ord", F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH v AS (SELECT label, i, CAST(embedding[i] AS DOUBLE) AS x, vec_id FROM embeddings, range(1, 65) t(i)), f AS (SELECT label, min(vec_id) AS a, max(vec_id) AS b FROM embeddings GROUP BY 1),
m AS (SELECT f.label, p.i, p.x * least(f.label, 4) + q.x AS s FROM f JOIN v p ON p.vec_id = f.a JOIN v q ON q.vec_id = f.b AND q.i = p.i), n AS (SELECT label, sqrt(sum(s * s)) AS norm FROM m GROUP BY 1)
SELECT m.label, CAST(i - 1 AS BIGINT) AS pos, CAST(round(s / norm * 1000000) AS BIGINT) AS millionths FROM m JOIN n ON m.label = n.label""")
def set6_upserted_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "embeddings")
    pick = lambda f: e.groupBy("label").agg(f("embedding", "vec_id").alias("embedding"))
    old = pick(F.min_by).withColumn("episodes", F.col("label"))
    found = vectors.upsert_people(old, pick(F.max_by), "label")
    return found.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round(F.col("x") * 1_000_000).cast("long").alias("millionths"))

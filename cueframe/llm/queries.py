"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .clusters import cluster_vectors
from .decontaminate import contaminated_documents
from .embeddings import embedding_duplicates
from .fim import fim_digests
from .html_extract import extract_text
from .jaccard import jaccard_components
from .lm import lm_scores
from .packing import pack_documents
from .quality import quality_scores
from .records import token_record_files
from .shared import table
from .token_counts import token_counts
from .warc import fixity_audit

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_record_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy has a flipped byte in the records of pages with crc32(page_id) mod 101 = 7, for the audit to find."""
    return fixity_audit(table(spark, sf_dir, "pages"), (F.col("record") == "resource") & (F.crc32(F.col("page_id").cast("string")) % 101 == 7))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(table(spark, sf_dir, "documents"))


def lm_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10_lm_scores: all its columns but the model's score."""
    return op10_lm_scores(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_html_text": op2_html_text,
    "op3_embedding_duplicates": op3_embedding_duplicates,
    "op4_token_counts": op4_token_counts,
    "op5_jaccard": op5_jaccard,
    "op6_token_records": op6_token_records,
    "op7_warc_fixity": op7_warc_fixity,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scores": op10_lm_scores,
    "op11_packing": op11_packing,
    "op12_centroids": op12_centroids,
    "op13_fill_in_middle": op13_fill_in_middle,
    "lm_base_columns": lm_base_columns,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
#: crc32 of the decimal digits of doc_id: the register after each byte, bit by bit.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295)"""


def _lloyd_sql(k: int, rounds: int, seed: int, size: int) -> str:
    """Rounds of exact clustering as one chain of CTEs: a<r> assigns, c<r> has the centroids after r rounds."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS j, v AS c FROM v ORDER BY j LIMIT {k})",
    ]
    away = "list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(j, d * {k} + j) AS j, CAST(min(d) AS BIGINT) AS d FROM (SELECT vec_id, v.v, c.j, CAST({away} AS BIGINT) AS d FROM v CROSS JOIN c{r} c) GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {size + 1}) t(i) GROUP BY 1, 2)")
            steps.append(f"m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY 1)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.j = c.j)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.j AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""


#: DuckDB SQL by plain comparison of all with all, for small tables; ids are distinct there.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_duplicates": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT e.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.root) AS component_id, min(r.root) = e.vec_id AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN r ON r.id = e.vec_id GROUP BY e.vec_id""",
    "op5_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY d.doc_id""",
    "lm_base_columns": f"""
WITH w AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS}, chr(10)) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS tok FROM w), c AS (SELECT tok, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT t.doc_id, t.held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (n.n + 1 * (n.v + 1)))), 3) AS base_score
FROM t LEFT JOIN c ON c.tok = t.tok CROSS JOIN n GROUP BY t.doc_id, t.held_out""",
    "op12_centroids": _lloyd_sql(8, 10, 3, 64),
    "op13_fill_in_middle": r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}

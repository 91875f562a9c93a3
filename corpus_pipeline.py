"""The corpus pipeline: quality classifier, n-gram Jaccard join, benchmark decontamination, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.llm.bpe import bpe_digests
from cueframe.llm.decontaminate import decontaminate
from cueframe.llm.jaccard import jaccard_components
from cueframe.llm.quality import quality_filter
from cueframe.llm.shared import discard, folders, materialise, numbered, place_of, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts: the one with the smallest doc_id, one without only where no other
    has any. Rows are known by numbers that they get as they are written, so doc_ids may repeat or be null and no two
    texts are taken for each other. Texts without words stay."""
    rows = materialise(numbered(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    doc_id, text = F.col(place_of(docs, "doc_id")), F.col(place_of(docs, "text"))
    found = jaccard_components(rows.select(F.col("row").alias("doc_id"), text.alias("text"))).where("n_shingles > 0")
    found = materialise(found.select(F.col("doc_id").alias("row"), "component_id"), "components")
    first = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("row"))
    heads = rows.join(found, "row").groupBy("component_id").agg(F.min(first)["row"].alias("row"))
    further = materialise(found.select("row").join(heads.select("row"), "row", "left_anti"), "further")
    return rows.join(further, "row", "left_anti").drop("row").toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and the digests of its ids and of their decoded text."""
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", encoding)]

#: The first stage is a sampling model that SQL cannot express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = folders()
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        discard(spark, before, keep_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)

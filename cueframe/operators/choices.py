"""Picking among rows of one key, and rows that say something new."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_other_languages(rows: DataFrame, others: DataFrame, on: str, item: str, language: str) -> DataFrame:
    """(on, item, candidate): for each row, the rows of others that have its `on` and another language; a language that is not
    known is another one than any that is. Columns of both: on, item, language."""
    a = rows.select(on, item, F.col(language).alias("_a"))
    b = others.select(on, F.col(item).alias("candidate"), F.col(language).alias("_b"))
    return a.join(b, on).where(~F.col("_a").eqNullSafe(F.col("_b"))).select(on, item, "candidate")


def first_usable(rows: DataFrame, group: str, item: str, wishes: list[Column], usable: Column | None = None) -> DataFrame:
    """(group, item): of each group's usable rows the one that fulfils the earliest wish, by item among equal ones; where none
    fulfils any, the first by item. A group with one usable row has that one, whatever the wishes."""
    rank = F.lit(len(wishes))
    for k, wish in reversed([*enumerate(wishes)]):
        rank = F.when(wish, k).otherwise(rank)
    held = rows if usable is None else rows.where(F.coalesce(usable, F.lit(False)))
    return held.groupBy(group).agg(F.min(F.struct(rank.alias("rank"), item)).alias("b")).select(group, F.col(f"b.{item}").alias(item))


def changed_snapshots(rows: DataFrame, key: str, order: list[str], content: list[str], ignored: list[str] | None = None) -> DataFrame:
    """Rows whose content is another than that of the key's row before them: what a snapshot is written for. ignored: columns
    of content that may differ. Nulls equal nulls."""
    said = F.to_json(F.struct(*(c for c in content if c not in (ignored or []))), {"ignoreNullFields": "false"})
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    marked = rows.withColumn("_digest", F.sha2(said, 256)).withColumn("_new", first | (F.lag("_digest").over(w) != F.col("_digest")))
    return marked.where("_new").select(*rows.columns)


def write_changed(rows: DataFrame, path: str, key: str, content: list[str], ignored: list[str] | None = None) -> DataFrame:
    """Appends to the Parquet files at path the rows (one for each key) whose content is another than the last one written
    there for their key, with a digest and the time; returns what was written. A run that is repeated writes nothing more."""
    spark = rows.sparkSession
    said = F.to_json(F.struct(*(c for c in content if c not in (ignored or []))), {"ignoreNullFields": "false"})
    now = F.lit(datetime.now(UTC))  # one time for all that is written now
    fresh = rows.withColumns({"digest": F.sha2(said, 256), "written": now})
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
        last = spark.read.schema(fresh.schema).parquet(path).groupBy(F.col(key).alias("_key")).agg(F.max_by("digest", "written").alias("_last"))
        fresh = fresh.join(last, fresh[key].eqNullSafe(F.col("_key")), "left").where(~F.col("digest").eqNullSafe(F.col("_last"))).drop("_key", "_last")
    # the files that were listed above are all that is read; what is appended is not among them
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(fresh.schema).parquet(path).where(F.col("written") == now)


def carried(rows: DataFrame, key: str, order: list[str], low: list[str], high: list[str]) -> DataFrame:
    """Rows whose area covers that of the row before them in their key: the columns of low are the smaller ones of both, those
    of high the greater ones."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({c: F.least(c, F.lag(c).over(w)) for c in low} | {c: F.greatest(c, F.lag(c).over(w)) for c in high})

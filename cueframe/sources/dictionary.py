"""Dictionaries of pronunciation: packed files of graded entries, and the entries that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_dictionary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(word, sounds, gold) of packed files: lines `g` or another grade, word, sounds, with tabs between; compressed files
    are known by their ending. Lines of another number of fields are none; of two lines of a word and grade the later counts.
    A compressed file is one task's, as it cannot be split."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("place"))
    parts = lines.select(F.split("value", "\t").alias("p"), "place").where(F.size("p") == 3)
    entries = parts.select(F.col("p")[1].alias("word"), F.col("p")[2].alias("sounds"), (F.col("p")[0] == "g").alias("gold"), "place")
    return entries.groupBy("word", "gold").agg(F.max_by("sounds", "place").alias("sounds")).select("word", "sounds", "gold")


def grown(entries: DataFrame) -> DataFrame:
    """(word, sounds, gold) and, for words of two letters or more, the same with a capital where the word is in lower case,
    and in lower case where only the first letter is a capital; a word that the grade has already keeps its own sounds."""
    lower, word = F.lower("word"), F.col("word")
    capital = F.concat(F.upper(F.substring("word", 1, 1)), F.lower(F.substr("word", F.lit(2))))
    other = F.when(word == lower, capital).when(word == capital, lower)
    more = entries.where(F.length("word") >= 2).select(other.alias("word"), "sounds", "gold", F.lit(True).alias("made"))
    every = entries.select("word", "sounds", "gold", F.lit(False).alias("made")).unionByName(more.where("word is not null"))
    # an entry and at most one made from another are all a word has in a grade
    first = F.row_number().over(Window.partitionBy("word", "gold").orderBy("made"))
    return every.withColumn("_n", first).where("_n = 1").select("word", "sounds", "gold")

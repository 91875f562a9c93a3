"""Vectors and readings: means, nearest centers, medoids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import dot
from ..functions.ocr import quality
from ..functions.text import letters_key, once


def mean_unit(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, value): the sum of each group's vectors, at length 1. Sums are combined before the shuffle."""
    each = rows.select(group, F.posexplode(vector).alias("pos", "x"))
    sums = each.groupBy(group, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy(group)))
    return sums.select(group, "pos", F.when(norm > 0, F.col("s") / norm).alias("value"))


#: So many centers or readings are compared in one expression.
BLOCK = 256
#: Up to so many blocks of centers are sent to all tasks.
FEW_BLOCKS = 16


def _blocked(rows: DataFrame, groups: list[str], item: list[str]) -> DataFrame:
    """(groups, block, blocks, items): rows dealt into arrays of about BLOCK items; blocks: how many their group has."""
    sizes = rows.groupBy(*groups).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, groups).withColumn("block", F.pmod(F.xxhash64(*item), F.col("blocks")).cast("int"))
    return dealt.groupBy(*groups, "block", "blocks").agg(F.collect_list(F.struct(*item)).alias("items"))


def nearest_center(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """Each (vec_id, embedding) with the label of the nearest of (label, embedding): (vec_id, center, score).

    The centers are a stated set that every row is compared with, block by block: no pairs become rows, and a row is
    repeated once for each block of centers only. Scores are rounded to 9 places, so that ties go to the smallest label.
    Null where there is no center, or none that can be compared (a zero vector, another length).
    """
    n = max(1, -(-centers.count() // BLOCK))
    norm = lambda v: F.sqrt(dot(v, v))
    dealt = centers.select((F.pmod(F.xxhash64("label"), F.lit(n))).cast("int").alias("block"), "label", F.col("embedding").alias("v"), norm("embedding").alias("norm"))
    blocks = dealt.groupBy("block").agg(F.collect_list(F.struct("label", "v", "norm")).alias("items"))
    if n <= FEW_BLOCKS:  # else rows of so few blocks would be so few tasks
        blocks = F.broadcast(blocks)
    each = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("norm", norm("embedding"))
    alike = lambda c: once(F.col("norm") * c["norm"], lambda m: F.when(m > 0, dot("embedding", c["v"]) / m))
    scored = F.transform("items", lambda c: F.struct((-F.round(alike(c), 9)).alias("far"), c["label"].alias("label")))
    best = each.join(blocks, "block", "left").select("vec_id", F.array_min(F.filter(scored, lambda s: s["far"].isNotNull())).alias("best"))
    best = best.groupBy("vec_id").agg(F.min("best").alias("best"))
    return best.select("vec_id", F.col("best.label").alias("center"), (-F.col("best.far")).alias("score"))


def best_reading(readings: DataFrame) -> DataFrame:
    """Of each group's texts, the one that agrees best with all of them: (grp, txt, score).

    readings: (grp, txt). The score is the mean similarity of letters and digits to all readings, plus half the quality of
    the text (see text.quality) and a thousandth for each time it was read; the first in order wins ties. Equal readings
    are counted first. A group's distinct readings are dealt into blocks; each is compared with block after block, and
    the partial sums are added, so that no task holds a group. Null texts are no readings.
    """
    counts = readings.where("txt is not null").groupBy("grp", "txt").agg(F.count("*").alias("n"))
    counts = counts.withColumn("norm", letters_key("txt"))
    blocks = _blocked(counts, ["grp"], ["norm", "n"])
    sizes = counts.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.sum("n").alias("total"))
    each = counts.join(sizes, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    agreement = F.aggregate("items", F.lit(0.0), lambda s, o: s + o["n"] * _similar(F.col("norm"), o["norm"]))
    partial = each.join(blocks.select("grp", "block", "items"), ["grp", "block"]).select("grp", "txt", "n", "total", agreement.alias("part"))
    score = F.round(F.sum("part") / F.first("total") + 0.5 * quality("txt") + F.lit(0.001) * F.first("n"), 9)
    scored = partial.groupBy("grp", "txt").agg(score.alias("score"))
    best = scored.groupBy("grp").agg(F.min(F.struct((-F.col("score")).alias("far"), "txt")).alias("best"))
    return best.select("grp", F.col("best.txt").alias("txt"), (-F.col("best.far")).alias("score"))


def _similar(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def medoid(readings: DataFrame) -> DataFrame:
    """Of each group's texts, the one with the least total edit distance to all of them: (grp, txt, cost). As
    best_reading, without regard to quality and counts; the first in order wins ties."""
    counts = readings.where("txt is not null").groupBy("grp", "txt").agg(F.count("*").alias("n"))
    blocks = _blocked(counts, ["grp"], ["txt", "n"])
    sizes = counts.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    each = counts.join(sizes, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cost = F.aggregate("items", F.lit(0).cast("long"), lambda s, o: s + o["n"] * F.levenshtein(F.col("txt"), o["txt"]))
    costs = each.join(blocks.select("grp", "block", "items"), ["grp", "block"]).select("grp", "txt", cost.alias("part")).groupBy("grp", "txt").agg(F.sum("part").alias("cost"))
    best = costs.groupBy("grp").agg(F.min(F.struct("cost", "txt")).alias("best"))
    return best.select("grp", F.col("best.txt").alias("txt"), F.col("best.cost").alias("cost"))


def upsert_people(known: DataFrame, seen: DataFrame, name: str, most: int = 4) -> DataFrame:
    """(name, embedding, episodes): known people with what was seen of them now, and new ones.

    known: (name, embedding, episodes), seen: (name, embedding), a name once in each. A known vector counts as often as it
    has episodes, but no more than `most` times, so that a voice can change; sums have length 1. A vector of another length
    or null leaves the other as it is.
    """
    old, new = known.select(name, F.col("embedding").alias("a"), "episodes"), seen.select(name, F.col("embedding").alias("b"))
    both = old.join(new, name, "full")
    weight = F.least(F.col("episodes"), F.lit(most)).cast("double")
    total = F.zip_with(F.transform("a", lambda x: x.cast("double")), F.transform("b", lambda x: x.cast("double")), lambda x, y: x * weight + y)
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    mixed = F.when(F.size("a") == F.size("b"), F.when(norm > 0, F.transform(total, lambda x: x / norm)))
    single = F.transform(F.coalesce("a", "b"), lambda x: x.cast("double"))
    return both.select(name, F.coalesce(mixed, single).alias("embedding"), (F.coalesce("episodes", F.lit(0)) + F.when(F.col("b").isNotNull(), 1).otherwise(0)).alias("episodes"))

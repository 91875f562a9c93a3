"""Spans over a series of levels: stretched over a voice that runs into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

#: Fixed: decibels below a line's own level that still are its voice, the least level of one, and how far below the usual one a line has none.
BELOW_LINE, FLOOR, NO_VOICE = 30.0, -65.0, 40.0


def over_voice(spans: DataFrame, levels: DataFrame, usual: float, before: int = 150, after: int = 100, bridge: int = 15) -> DataFrame:
    """(key, ord, from_frame, to_frame, new_from, new_to, threshold): spans stretched while the voice goes on at their ends.

    spans: (key, ord, from_frame, to_frame), to_frame not in them, ord unique in a key; levels: (key, frame, level), frames
    that are missing are silent. The third quartile of a span's levels is its own (the usual one where it has none, or lies
    NO_VOICE below it); the voice is what is louder than BELOW_LINE under that, and than FLOOR. From an end the span grows over
    voiced frames and over up to `bridge` others that more voice follows, at most `before` or `after` frames. Spans meet
    the frames around them by bins; islands are found by windows.
    """
    reach = max(before, after) + bridge + 1
    size = F.lit(max(256, reach))
    bins = F.sequence(F.floor((F.col("from_frame") - reach) / size), F.floor((F.greatest("to_frame", "from_frame") + reach) / size))
    one = spans.select("key", "ord", F.col("from_frame").cast("long").alias("from_frame"), F.col("to_frame").cast("long").alias("to_frame"))
    near = one.withColumn("_bin", F.explode(bins)).join(levels.where("level is not null").select("key", F.col("frame").cast("long").alias("frame"), F.col("level").cast("double").alias("level"), F.floor(F.col("frame") / size).alias("_bin")), ["key", "_bin"])
    near = near.where((F.col("frame") >= F.col("from_frame") - reach) & (F.col("frame") < F.greatest("to_frame", "from_frame") + reach))
    inside = near.where("frame >= from_frame and frame < to_frame and frame >= 0")
    own = ranks.at_ranks(inside, ["key", "ord"], "level", {"own": F.floor(F.col("n") * 3 / 4)}).select("key", "ord", "own")
    level = F.when(F.col("own").isNull() | (F.col("own") < usual - NO_VOICE), usual).otherwise(F.col("own"))
    judged = one.join(own, ["key", "ord"], "left").withColumn("threshold", F.greatest(level - BELOW_LINE, F.lit(FLOOR)))
    loud = near.join(judged.select("key", "ord", "threshold"), ["key", "ord"]).where("level > threshold")

    def island(side: DataFrame, edge: str, backward: bool) -> DataFrame:
        """How far the frames go that are no more than bridge silent ones apart, from the edge on."""
        order = F.desc("frame") if backward else F.asc("frame")
        w = Window.partitionBy("key", "ord").orderBy(order)
        last = F.lag("frame", 1).over(w)
        gap = F.coalesce(last, F.col(edge) if backward else F.col(edge) - 1) - F.col("frame")
        gap = gap if backward else -gap
        return side.withColumn("_gap", F.max(gap).over(w)).where(F.col("_gap") <= bridge + 1).groupBy("key", "ord").agg((F.min("frame") if backward else F.max("frame") + 1).alias("reached"))

    # a gap is measured within the side only; w has no frame of its own, so max runs from the first row on
    left = island(loud.where("frame < from_frame"), "from_frame", True).withColumnRenamed("reached", "_a")
    right = island(loud.where("frame >= to_frame"), "to_frame", False).withColumnRenamed("reached", "_b")
    met = judged.join(left, ["key", "ord"], "left").join(right, ["key", "ord"], "left")
    return met.select(
        "key", "ord", "from_frame", "to_frame", F.when(F.col("_a").isNull(), F.col("from_frame")).otherwise(F.greatest("_a", F.col("from_frame") - before)).alias("new_from"),
        F.when(F.col("_b").isNull(), F.col("to_frame")).otherwise(F.least("_b", F.col("to_frame") + after)).alias("new_to"), "threshold",
    )

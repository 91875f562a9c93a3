"""Voices by their pitch and loudness, and boxes of text by their place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ocr import quality, subtitle_like
from ..functions.text import letters_key
from .folds import fold


def voice_shape(steps: DataFrame, step_us: int = 30_000, held_us: int = 250_000, long_us: int = 600_000) -> DataFrame:
    """(key, voiced, held, long_runs, steps, longest_us) of the pitch of each step of a line.

    steps: (key, frame, hz): a frequency where voiced, 0 where sounding but not voiced, null where quiet. voiced: share of the
    sounding steps; held: share of the voiced ones in runs of at least held_us that stay within a semitone of their average
    so far; long_runs: share of them in unbroken runs of at least long_us. A key without voiced steps has zeros.
    """
    rows = steps.select("key", (F.col("frame") * step_us).cast("long").alias("start_us"), (F.col("frame") * step_us + step_us).cast("long").alias("end_us"), F.col("frame").cast("long").alias("ord"), F.col("hz").cast("double").alias("hz"))

    def step(state: dict | None, row: dict, after: dict | None) -> dict:
        note, run, total, n = (0, 0, 0.0, 0) if state is None else (state["note"], state["run"], state["total"], state["n"])
        pitch = math.log2(row["hz"]) if row["hz"] is not None and row["hz"] > 0 else None
        if pitch is None:
            return {"note": note + 1, "run": run + 1, "total": 0.0, "n": 0}
        if n and abs(12 * (pitch - total / n)) < 1.0:
            return {"note": note, "run": run, "total": total + pitch, "n": n + 1}
        # a new note; the run goes on where the step before was voiced
        return {"note": note + 1, "run": run if n else run + 1, "total": pitch, "n": 1}

    marked = fold(rows, step, "note long, run long, total double, n long", ("hz",))
    voiced = marked.where("hz > 0")
    length = F.count("*") * step_us
    notes = voiced.groupBy("key", "note").agg(F.count("*").alias("c"), length.alias("len")).groupBy("key").agg(F.sum(F.when(F.col("len") >= held_us, F.col("c")).otherwise(0)).alias("held"), F.max("len").alias("longest_us"))
    runs = voiced.groupBy("key", "run").agg(F.count("*").alias("c"), length.alias("len")).groupBy("key").agg(F.sum(F.when(F.col("len") >= long_us, F.col("c")).otherwise(0)).alias("long"))
    counts = steps.groupBy("key").agg(F.count_if(F.col("hz") > 0).alias("v"), F.count("hz").alias("sounding"))
    met = counts.join(notes, "key", "left").join(runs, "key", "left")
    share = lambda c: F.when(F.col("v") > 0, F.coalesce(c, F.lit(0)) / F.col("v")).otherwise(0.0)
    return met.select(
        "key", F.when(F.col("sounding") > 0, F.col("v") / F.col("sounding")).otherwise(0.0).alias("voiced"), share(F.col("held")).alias("held"), share(F.col("long")).alias("long_runs"), F.col("v").alias("steps"), F.coalesce("longest_us", F.lit(0)).alias("longest_us")
    )


def sung(shape: DataFrame, lengths: DataFrame, shortest_us: int = 5_000_000) -> DataFrame:
    """(key, sung) of voice_shape and (key, length_us): long enough, mostly voiced, and on held notes or in long runs."""
    good = (F.col("length_us") >= shortest_us) & (F.col("steps") >= 20) & (F.col("voiced") >= 0.7) & ((F.col("held") >= 0.3) | (F.col("long_runs") >= 0.2))
    return shape.join(lengths, "key").select("key", good.alias("sung"))


def _smoothed(a: Column, points: int) -> Column:
    return F.transform(a, lambda x, i: (F.get(a, F.greatest(i - 1, F.lit(0))) + 2 * x + F.get(a, F.least(i + 1, F.lit(points - 1)))) / 4)


def emphasis(samples: Column | str, points: int = 16, passes: int = 4) -> Column:
    """The loudness of a line in equal slices, smoothed and relative to its mean; null for silence and for fewer samples than
    slices."""
    v = F.col(samples) if isinstance(samples, str) else samples
    n = F.size(v)
    place = lambda p: F.floor(p * n / points).cast("int")

    def energy(p: Column) -> Column:
        a, b = place(p), place(p + 1)
        total = F.aggregate(F.slice(v, a + 1, b - a), F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        return F.sqrt(total / F.greatest(F.lit(1), b - a))

    shape = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), energy)
    shape = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), shape, lambda s, _: _smoothed(s, points))
    mean = F.aggregate(shape, F.lit(0.0), lambda s, x: s + x) / points
    return F.when((n >= points) & (mean > 1e-6), F.transform(shape, lambda x: x / mean))


def text_blocks(boxes: DataFrame, static: list[str] | None = None, most_lines: int = 3) -> DataFrame:
    """(key, sample, block, top, bottom, lines, text) of the boxes of text in each sampled frame.

    boxes: (key, sample, text, x, y, width, height, frame_width, frame_height). Boxes that can be subtitles, but for texts that
    always stand there (keys in `static`), are one block where each begins no more than 0.9 of the larger height below the
    one before it and their middles are within 15 % of the frame; blocks of more lines are credits and go. top and bottom
    are shares of the frame.
    """
    good = subtitle_like("text", "x", "width", "height", "frame_width", "frame_height")
    rows = boxes.where(good & ~letters_key("text").isin(*(static or [""])))
    w = Window.partitionBy("key", "sample").orderBy("y", "x", "text")
    gap = F.col("y") - (F.lag("y").over(w) + F.lag("height").over(w))
    apart = F.abs(F.col("x") + F.col("width") / 2 - F.lag(F.col("x") + F.col("width") / 2).over(w))
    stacked = (gap <= 0.9 * F.greatest("height", F.lag("height").over(w))) & (apart <= 0.15 * F.col("frame_width"))
    rows = rows.withColumn("_new", F.when(F.coalesce(stacked, F.lit(False)), 0).otherwise(1)).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.sort_array(F.collect_list(F.struct("y", "x", F.trim("text").alias("text"))))
    found = rows.groupBy("key", "sample", "block").agg(F.min(F.col("y") / F.col("frame_height")).alias("top"), F.max((F.col("y") + F.col("height")) / F.col("frame_height")).alias("bottom"), F.count("*").alias("lines"), F.array_join(F.transform(item, lambda i: i["text"]), "\n").alias("text"))
    return found.where(F.col("lines") <= most_lines)


def kept_lines(boxes: DataFrame, expected: str | None = None, most_lines: int = 3) -> DataFrame:
    """Boxes of a band that can be its subtitle: with a letter, centred within 25 % of the frame, 0.55 to 1.7 times as high as
    expected (a column, null where that is not known), of a quality of at least 0.45; none where more than most_lines are
    left, which is a roll of credits. boxes: as for text_blocks."""
    middle = F.abs(F.col("x") + F.col("width") / 2 - F.col("frame_width") / 2) <= 0.25 * F.col("frame_width")
    height = F.lit(True) if expected is None else F.coalesce(F.col("height").between(0.55 * F.col(expected), 1.7 * F.col(expected)), F.lit(True))
    good = boxes.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & middle & height & (quality("text") >= 0.45))
    n = F.count("*").over(Window.partitionBy("key", "sample"))
    return good.withColumn("_n", n).where(F.col("_n") <= most_lines).drop("_n")

"""Text read from the frames of a picture: boxes put into rows, frames into cues, and where in the picture subtitles stand."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import same_key, similarities
from ..functions.ocr import clean, quality, subtitle_like
from ..functions.text import letters_key, similarity
from . import ranks
from .rounds import kept
from .voices import kept_lines

#: Fixed: cues shorter than this are flicker; anchors so near each other are one place; where no subtitles are found.
SHORTEST_US, BAND, NOWHERE = 700_000, 0.025, (0.78, 0.96)
#: Places in the picture are compared as whole billionths of its height.
_FINE = 1_000_000_000


# boxes of a frame


def merged_rows(boxes: DataFrame) -> DataFrame:
    """Boxes that are pieces of one row of text as one box: (key, sample, text, x, y, width, height, frame_width, frame_height).

    From the top of the frame on (by the middle of the boxes, then from the left), a box belongs to the first row that it
    overlaps in height by half of the smaller of both, and from which it is no more than four times the larger height
    away; the row grows by it. Texts are joined from left to right. Empty texts are no boxes. A frame's boxes are one
    array, as many as a picture has lines.
    """
    real = boxes.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    number = lambda c: F.col(c).cast("double")
    left, top, right, bottom = number("x"), number("y"), number("x") + number("width"), number("y") + number("height")
    box = F.struct((number("y") + number("height") / 2).alias("middle"), left.alias("left"), F.col("text").alias("text"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    frames = real.groupBy("key", "sample", "frame_width", "frame_height").agg(F.array_sort(F.collect_list(box)).alias("boxes"))

    def belongs(row: Column, b: Column) -> Column:
        high, own = row["bottom"] - row["top"], b["bottom"] - b["top"]
        overlap = F.least(row["bottom"], b["bottom"]) - F.greatest(row["top"], b["top"])
        gap = F.greatest(b["left"] - row["right"], row["left"] - b["right"])
        return (overlap >= 0.5 * F.least(high, own)) & (gap <= 4 * F.greatest(high, own))

    def piece(b: Column) -> Column:
        return F.struct(b["left"].alias("left"), F.trim(b["text"]).alias("text"), b["text"].alias("raw"))

    def alone(b: Column) -> Column:
        return F.struct(b["left"].alias("left"), b["top"].alias("top"), b["right"].alias("right"), b["bottom"].alias("bottom"), F.array(piece(b)).alias("pieces"))

    def grown(row: Column, b: Column) -> Column:
        return F.struct(
            F.least(row["left"], b["left"]).alias("left"), F.least(row["top"], b["top"]).alias("top"), F.greatest(row["right"], b["right"]).alias("right"),
            F.greatest(row["bottom"], b["bottom"]).alias("bottom"), F.concat(row["pieces"], F.array(piece(b))).alias("pieces"),
        )

    def put(rows: Column, b: Column) -> Column:
        mine = F.array_position(F.transform(rows, lambda r: belongs(r, b)), True)
        return F.when(mine == 0, F.concat(rows, F.array(alone(b)))).otherwise(F.transform(rows, lambda r, i: F.when(i == mine - 1, grown(r, b)).otherwise(r)))

    first = F.transform(F.slice("boxes", 1, 1), alone)
    rows = F.aggregate(F.slice("boxes", F.lit(2), F.greatest(F.size("boxes") - 1, F.lit(0))), first, put)
    each = frames.select("key", "sample", "frame_width", "frame_height", F.explode(rows).alias("r"))
    # pieces that begin at one place keep the order in which they came
    joined = F.array_join(F.transform(F.array_sort("r.pieces", lambda a, b: F.when(a["left"] < b["left"], -1).when(a["left"] > b["left"], 1).otherwise(0)), lambda p: p["text"]), " ")
    text = F.when(F.size("r.pieces") == 1, F.get("r.pieces", F.lit(0))["raw"]).otherwise(joined)
    return each.select("key", "sample", text.alias("text"), F.col("r.left").alias("x"), F.col("r.top").alias("y"), (F.col("r.right") - F.col("r.left")).alias("width"), (F.col("r.bottom") - F.col("r.top")).alias("height"), "frame_width", "frame_height")


# frames to cues


class Readings:
    """The distinct readings of one text in the order in which they were met, and how alike they are.

    A reading's score is its mean similarity to all, half its quality and a thousandth for each time it was met. Sums of
    similarities are kept up to date, so a new reading is compared once with each."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.texts: list[tuple[str, str, float]] = []  # text, key, quality
        self.counts: list[int] = []
        self.alike: list[np.ndarray] = []
        self.total = 0
        self.found: tuple[str, str, float] | None = None  # the best one, until another is met

    def add(self, text: str, key: str, good: float, times: int = 1) -> None:
        at = self.place.get(text)
        if at is None:
            at = self.place[text] = len(self.texts)
            near = similarities(key, [k for _, k, _ in self.texts]) if self.texts else np.zeros(0)
            self.alike = [np.append(a, x) for a, x in zip(self.alike, near, strict=True)] + [np.append(near, 1.0 if key else similarities(key, [key])[0])]
            self.texts.append((text, key, good))
            self.counts.append(0)
        self.counts[at] += times
        self.total += times
        self.found = None

    def update(self, other: Readings) -> None:
        for (text, key, good), n in zip(other.texts, other.counts, strict=True):
            self.add(text, key, good, n)

    def best(self) -> tuple[str, str, float]:
        """(text, key, quality) of the reading that agrees best with all; of equal ones the first that was met."""
        if len(self.texts) == 1:
            return self.texts[0]
        if self.found is not None:
            return self.found
        counts = np.array(self.counts)
        good = np.array([q for _, _, q in self.texts])
        score = np.round(np.array(self.alike) @ counts / self.total + 0.5 * good + 0.001 * counts, 9)
        self.found = self.texts[int(score.argmax())]
        return self.found


def _runs(frames: Iterator[tuple[int, str, str, float]], reach_us: int) -> Iterator[tuple[int, int, Readings]]:
    """(first time, last time, readings) of the cues in one key's frames (time, text, key, quality) in order."""
    held: tuple[int, int, Readings] | None = None  # a finished run that the next one may continue
    run: tuple[int, int, Readings] | None = None
    row = next(frames, None)
    while row is not None:
        after = next(frames, None)
        time, text, key, good = row
        if run is not None and text and same_key(key, run[2].best()[1]):
            run[2].add(text, key, good)
            run = (run[0], time, run[2])
        elif run is not None and after is not None and after[1] and same_key(after[2], run[2].best()[1]):
            pass  # a bad frame; the next one finds the same readings, and is taken
        else:
            if run is not None:
                held, done = _continued(held, run, reach_us)
                yield from done
                run = None
            if text:
                run = (time, time, Readings())
                run[2].add(text, key, good)
        row = after
    if run is not None:
        held, done = _continued(held, run, reach_us)
        yield from done
    if held is not None:
        yield held


def _continued(held: tuple | None, run: tuple, reach_us: int) -> tuple[tuple, list[tuple]]:
    if held is None:
        return run, []
    if run[0] - held[1] <= reach_us and same_key(held[2].best()[1], run[2].best()[1]):
        held[2].update(run[2])
        return (held[0], run[1], held[2]), []
    return run, [held]


def frame_cues(frames: DataFrame, interval_us: int, least_frames: int = 2, batch: int = 1000) -> DataFrame:
    """Cues of the texts read from frames: (key, ord, start_us, end_us, text), numbered from 1.

    frames: (key, time_us, text), one row for each frame, empty texts too. A frame whose text is read alike (see same_reading)
    extends a cue; one other frame is passed over where the next one is alike again. Cues that say the same and are at
    most 3.01 intervals apart are one. A cue has its best reading (see Readings); those that stand for fewer than
    least_frames frames or SHORTEST_US, or whose best reading has a quality under 0.5, go. An end is one interval behind the
    last frame, but not behind the next start. A task goes through a key in order and keeps the readings of two cues.
    """
    key = frames.schema["key"].dataType.simpleString()
    rows = frames.where("key is not null and time_us is not null").select("key", F.col("time_us").cast("long").alias("time_us"), clean("text").alias("text"))
    rows = rows.withColumns({"norm": letters_key("text"), "good": quality("text")})
    reach = int(interval_us * 3.01)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def values():
            nonlocal kind
            for b in batches:
                kind = b.schema.field("key").type
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=["key", "start_us", "last_us", "text", "good", "n"])

        found = []
        for k, rows_of in groupby(values(), key=lambda r: r[0]):
            for first, last, readings in _runs((r[1:] for r in rows_of), reach):
                text, _, good = readings.best()
                found.append((k, first, last, text, good, readings.total))
                if len(found) >= batch:
                    yield out(found)
                    found = []
        if found:
            yield out(found)

    placed = rows.repartition("key").sortWithinPartitions("key", "time_us", "text")
    cues = placed.mapInArrow(run, f"key {key}, start_us long, last_us long, text string, good double, n long")
    needed = max(least_frames, -(-SHORTEST_US // max(1000, interval_us)))
    w = Window.partitionBy("key").orderBy("start_us")
    cues = cues.where((F.col("n") >= needed) & (F.col("good") >= 0.5))
    end = F.least(F.col("last_us") + interval_us, F.coalesce(F.lead("start_us").over(w), F.col("last_us") + interval_us))
    return cues.select("key", F.row_number().over(w).cast("long").alias("ord"), "start_us", end.alias("end_us"), "text")


def read_cues(boxes: DataFrame, frames: DataFrame, interval_us: int, expected: str | None = None) -> DataFrame:
    """Cues of the boxes of text in sampled frames, as frame_cues gives them.

    boxes: as for merged_rows, of the part of the picture that has the subtitles; frames: (key, sample, time_us), all that
    were looked at. Boxes are put into rows, rows that can be subtitles are kept, and a frame's text is theirs from top to
    bottom. expected: the height of a line in `frames`, null where it is not known.
    """
    rows = merged_rows(boxes)
    if expected is not None:
        rows = rows.join(frames.select("key", "sample", F.col(expected).alias("_expected")), ["key", "sample"], "left")
    rows = kept_lines(rows, None if expected is None else "_expected")
    item = F.array_sort(F.collect_list(F.struct("y", "x", F.trim("text").alias("text"))))
    texts = rows.groupBy("key", "sample").agg(F.array_join(F.transform(item, lambda i: i["text"]), "\n").alias("text"))
    met = frames.select("key", "sample", "time_us").join(texts, ["key", "sample"], "left").select("key", "time_us", F.coalesce("text", F.lit("")).alias("text"))
    return frame_cues(met, interval_us)


# where subtitles stand


def unlike(rows: DataFrame, groups: list[str], alike: float = 0.75) -> DataFrame:
    """(groups, n): how many texts of a group are unlike all that were counted before them.

    rows: (groups, ord, text), in the order of ord. Only letters and digits count, and texts without any do not. Equal
    texts are one before the others are compared; a task keeps the texts that it counts, and a text is compared with all of
    them at once.
    """
    first = rows.withColumn("k", letters_key(F.coalesce("text", F.lit("")))).where("k <> ''").groupBy(*groups, "k").agg(F.min("ord").alias("ord"))
    schema = first.select(*groups).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def values():
            nonlocal kinds
            for b in batches:
                kinds = [b.schema.field(g).type for g in groups]
                yield from zip(*(b.column(c).to_pylist() for c in [*groups, "k"]), strict=True)

        found = []
        for group, rows_of in groupby(values(), key=lambda r: r[:-1]):
            counted: list[str] = []
            for r in rows_of:
                possible = [x for x in counted if min(len(x), len(r[-1])) >= alike * max(len(x), len(r[-1]))]  # else the lengths alone differ too much
                if not possible or similarities(r[-1], possible).max() < alike:
                    counted.append(r[-1])
            found.append((*group, len(counted)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [*kinds, pa.int64()], strict=True)], names=[*groups, "n"])

    placed = first.repartition(*groups).sortWithinPartitions(*groups, "ord", "k")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return placed.select(*groups, "k").mapInArrow(run, f"{kinds}, n long")


def _unlike_in(texts: Column, alike: float = 0.75) -> Column:
    """As unlike, over one array of keys."""
    counted = F.aggregate(texts, F.array().cast("array<string>"), lambda kept, t: F.when(F.exists(kept, lambda k: similarity(k, t) >= alike), kept).otherwise(F.array_append(kept, t)))
    return F.size(counted)


def densest_band(blocks: DataFrame, groups: list[str], width: float = BAND) -> DataFrame:
    """Where most different texts stand: (groups, centre, low, high, score) of the blocks (groups, sample, ord, anchor, text).

    Each anchor is a candidate: the mean of the anchors no more than width away is a centre, and the blocks no more than width
    away from that are its members. A score is a thousand for each text unlike the others (see unlike), one for each
    sample, and half of that between 0.3 and 0.7 of the height; the first candidate by (sample, ord) wins ties. low and high:
    the bounds of its members. Windows by range over whole billionths; candidates with one centre are one. Null anchors are
    in no band. A candidate's members are one array: a recording is sampled, a few hundred frames long.
    """
    fine = F.round(F.col("anchor").cast("double") * _FINE).cast("long")
    reach = round(width * _FINE)
    rows = blocks.where("anchor is not null").select(*groups, "sample", "ord", fine.alias("at"), letters_key(F.coalesce("text", F.lit(""))).alias("k"))
    near = Window.partitionBy(*groups).orderBy("at").rangeBetween(-reach, reach)
    rows = rows.withColumn("centre", F.round(F.avg("at").over(near)).cast("long"))
    candidates = rows.groupBy(*groups, "centre").agg(F.min(F.struct("sample", "ord")).alias("turn"))
    member = F.struct("sample", "ord", "k")
    points = rows.select(*groups, F.col("at").alias("at"), member.alias("m"), F.lit(None).cast(candidates.schema["turn"].dataType).alias("turn"))
    points = points.unionByName(candidates.select(*groups, F.col("centre").alias("at"), F.lit(None).cast(points.schema["m"].dataType).alias("m"), "turn"))
    members = F.array_sort(F.collect_list("m").over(near))  # null members, those of the candidates, are not listed
    scored = points.withColumn("members", members).where("turn is not null")
    texts = F.array_distinct(F.filter(F.transform("members", lambda m: m["k"]), lambda k: k != ""))
    score = _unlike_in(texts) * 1000.0 + F.size(F.array_distinct(F.transform("members", lambda m: m["sample"])))
    middle = (F.col("at") > round(0.3 * _FINE)) & (F.col("at") < round(0.7 * _FINE))
    scored = scored.where(F.size("members") > 0).select(*groups, "at", "turn", F.when(middle, score / 2).otherwise(score).alias("score"))
    best = scored.groupBy(*groups).agg(F.min(F.struct((-F.col("score")).alias("less"), "turn", "at")).alias("b"))
    centre = F.col("b.at")
    return best.select(*groups, (centre / _FINE).alias("centre"), ((centre - reach) / _FINE).alias("low"), ((centre + reach) / _FINE).alias("high"), (-F.col("b.less")).alias("score"))


def frame_blocks(boxes: DataFrame, most_lines: int = 3) -> DataFrame:
    """(key, sample, ord, top, bottom, lines, heights, lights, text) of the stacked boxes that can be subtitles; see text_blocks.

    boxes: as there, with light (null where it was not measured) and static (whether its text always stands there). ord
    counts a frame's blocks from the top; heights and lights are those of its lines, as shares."""
    good = subtitle_like("text", "x", "width", "height", "frame_width", "frame_height") & ~F.coalesce("static", F.lit(False))
    w = Window.partitionBy("key", "sample").orderBy("y", "x", "text")
    gap = F.col("y") - (F.lag("y").over(w) + F.lag("height").over(w))
    middle = F.col("x") + F.col("width") / 2
    stacked = (gap <= 0.9 * F.greatest("height", F.lag("height").over(w))) & (F.abs(middle - F.lag(middle).over(w)) <= 0.15 * F.col("frame_width"))
    rows = boxes.where(F.coalesce(good, F.lit(False))).withColumn("_new", F.when(F.coalesce(stacked, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("ord", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.array_sort(F.collect_list(F.struct("y", "x", F.trim("text").alias("text"), (F.col("height") / F.col("frame_height")).alias("h"), F.when(F.col("light") >= 0, F.col("light")).alias("light"))))
    found = rows.groupBy("key", "sample", "ord").agg(F.min(F.col("y") / F.col("frame_height")).alias("top"), F.max((F.col("y") + F.col("height")) / F.col("frame_height")).alias("bottom"), F.count("*").alias("lines"), item.alias("items"))
    lights = F.filter(F.transform("items", lambda i: i["light"]), lambda x: x.isNotNull())
    return found.where(F.col("lines") <= most_lines).select("key", "sample", "ord", "top", "bottom", "lines", F.transform("items", lambda i: i["h"]).alias("heights"), lights.alias("lights"), F.array_join(F.transform("items", lambda i: i["text"]), "\n").alias("text"))


def subtitle_area(boxes: DataFrame, frames: DataFrame, examples: int = 12) -> DataFrame:
    """Where each recording has its subtitles, one row for each key of frames: (key, likely, samples, hits, band_top,
    band_bottom, position, line_height, light_text, preview, examples array<struct<sample, text>>, static array<string>).

    boxes: (key, sample, text, x, y, width, height, frame_width, frame_height, light); frames: (key, sample), all that were
    sampled. Texts in 60 % of at least 4 frames always stand there. Blocks of the rest are parted by whether their middle is
    in the lower half; the denser band of their lower, or upper, edges has the subtitles. The area holds the members of
    the band, room for two lines and a margin of a third of a line. It is likely from 3 samples and a tenth of all with 3
    different texts on. light_text: no light is known, or its third quartile is 0.06 or more. preview: the sample with two
    lines, then with the longest text. Keys without blocks have the default area.
    """
    samples = frames.groupBy("key").agg(F.count_distinct("sample").alias("samples"))
    keyed = boxes.withColumn("k", letters_key(F.coalesce("text", F.lit(""))))
    often = keyed.where("k <> ''").select("key", "sample", "k").distinct().groupBy("key", "k").agg(F.count("*").alias("c")).join(samples, "key")
    always = often.where("samples >= 4 and c >= ceil(samples * 0.6)").select("key", "k")
    marked = keyed.join(always.withColumn("static", F.lit(True)), ["key", "k"], "left")
    blocks = frame_blocks(marked)
    lower = (F.col("top") + F.col("bottom")) / 2 >= 0.5
    blocks = blocks.withColumn("side", F.when(lower, "bottom").otherwise("top")).withColumn("anchor", F.when(lower, F.col("bottom")).otherwise(F.col("top")))
    blocks = kept(blocks)  # blocks, and those of the band, are read by several branches
    bands = densest_band(blocks, ["key", "side"])
    # the lower one of equal bands
    best = bands.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("less"), "side", "centre", "low", "high")).alias("b")).select("key", "b.side", "b.centre", "b.low", "b.high")
    fine = lambda c: F.round(F.col(c) * _FINE)
    chosen = kept(blocks.join(best, ["key", "side"]).where((fine("anchor") >= fine("low")) & (fine("anchor") <= fine("high"))))
    height = ranks.at_ranks(chosen.select("key", F.explode("heights").alias("v")), ["key"], "v", {"line_height": ranks.rounded(0.5)}).select("key", "line_height")
    edge = ranks.at_ranks(chosen, ["key"], "anchor", {"far": ranks.rounded(0.95), "close": ranks.rounded(0.05)}).select("key", "far", "close")
    light = ranks.at_ranks(chosen.select("key", F.explode("lights").alias("v")), ["key"], "v", {"light": ranks.rounded(0.75)}).select("key", "light")
    different = unlike(chosen.select("key", F.struct("sample", "ord").alias("ord"), "text"), ["key"]).withColumnRenamed("n", "different")
    turn = Window.partitionBy("key").orderBy("sample", "ord")
    first = chosen.withColumn("_i", F.row_number().over(turn)).where(F.col("_i") <= examples).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "sample", "text"))), lambda x: F.struct(x["sample"].alias("sample"), x["text"].alias("text"))).alias("examples"))
    rank = F.struct((-F.least("lines", F.lit(2))).alias("l"), (-F.length("text")).alias("t"), "sample", "ord")
    whole = chosen.groupBy("key").agg(F.min("top").alias("highest"), F.max("bottom").alias("lowest"), F.count_distinct("sample").alias("hits"), F.first("side").alias("side"), F.first("centre").alias("centre"), F.min(rank)["sample"].alias("preview"))
    static = always.groupBy("key").agg(F.sort_array(F.collect_list("k")).alias("static"))
    met = samples
    for part in (whole, height, edge, light, different, first, static):
        met = met.join(part, "key", "left")
    line, margin = F.col("line_height"), F.col("line_height") * 0.35
    is_top = F.col("side") == "top"
    top = F.when(is_top, F.col("close") - margin).otherwise(F.least(F.col("highest"), F.col("centre") - 3 * line) - margin)
    bottom = F.when(is_top, F.greatest(F.col("lowest"), F.col("centre") + 3 * line) + margin).otherwise(F.col("far") + margin)
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), top))
    found = F.col("hits").isNotNull()
    likely = found & (F.col("hits") >= F.greatest(F.lit(3), F.ceil(F.col("samples") * 0.1))) & (F.coalesce("different", F.lit(0)) >= 3)
    return met.select(
        "key", F.coalesce(likely, F.lit(False)).alias("likely"), "samples", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(held, F.lit(NOWHERE[0])).alias("band_top"),
        F.when(found, F.greatest(held + 0.02, F.least(F.lit(1.0), bottom))).otherwise(NOWHERE[1]).alias("band_bottom"), F.coalesce("side", F.lit("bottom")).alias("position"), F.coalesce("line_height", F.lit(0.055)).alias("line_height"),
        F.coalesce(F.col("light") >= 0.06, F.lit(True)).alias("light_text"), "preview", F.coalesce("examples", F.array().cast(first.schema["examples"].dataType)).alias("examples"), F.coalesce("static", F.array().cast("array<string>")).alias("static"),
    )

"""Operators over timed rows: (key, ord, start_us, end_us) with half-open intervals, and time series per key.

All of them partition by the key; none gathers rows of different keys. ord breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positive(rows: DataFrame) -> DataFrame:
    return rows.where("end_us > start_us")


def shift(rows: DataFrame, offset_us: int) -> DataFrame:
    """Moves rows, not before 0; durations stay, negative ones become 0."""
    length = F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0))
    start = F.greatest(F.col("start_us") + offset_us, F.lit(0))
    return rows.withColumns({"start_us": start, "end_us": start + length})


def stretch(rows: DataFrame, factor: float) -> DataFrame:
    """Multiplies times; rejects a factor that is not a positive number."""
    if not 0 < factor < float("inf"):
        raise ValueError("the factor must be a positive number")
    scaled = lambda c: F.greatest(F.round(F.col(c) * factor).cast("long"), F.lit(0))
    return rows.withColumns({"start_us": scaled("start_us"), "end_us": scaled("end_us")})


#: Fixed: frame rates that files are timed for, and those of the video: (from, to).
FRAME_RATES = [(25, 24000 / 1001), (24000 / 1001, 25), (25, 24), (24, 25), (24, 24000 / 1001), (24000 / 1001, 24), (30000 / 1001, 25), (25, 30000 / 1001)]


def stretch_for_rates(rows: DataFrame, timed_for: float, video: float) -> DataFrame:
    """Times of rows that were timed for one frame rate, for a video of another."""
    return stretch(rows, timed_for / video)


def map_by_points(rows: DataFrame, a_from: int, a_to: int, b_from: int, b_to: int) -> DataFrame:
    """Times on the line through two anchors, not before 0; see two_points."""
    factor, offset = two_points(a_from, a_to, b_from, b_to)
    mapped = lambda c: F.greatest(F.round(F.col(c) * factor).cast("long") + offset, F.lit(0))
    return rows.withColumns({"start_us": mapped("start_us"), "end_us": mapped("end_us")})


def two_points(a_from: int, a_to: int, b_from: int, b_to: int) -> tuple[float, int]:
    """(factor, offset) of the line through two anchors, which must be a second apart and give 0.5 < factor < 2."""
    if abs(b_from - a_from) < 1_000_000:
        raise ValueError("the anchors must be at least one second apart")
    factor = (b_to - a_to) / (b_from - a_from)
    if not 0.5 < factor < 2:
        raise ValueError("the anchors change the speed too much")
    return factor, round(a_to - a_from * factor)


def slice_window(rows: DataFrame, start_us: int, length_us: int) -> DataFrame:
    """Rows that start in [start, start + length), with times from its start."""
    inside = rows.where((F.col("start_us") >= start_us) & (F.col("start_us") < start_us + length_us))
    return inside.withColumns({"start_us": F.col("start_us") - start_us, "end_us": F.col("end_us") - start_us})


def unite(rows: DataFrame, before_us: int = 0, after_us: int = 0, gap_us: int = 0) -> DataFrame:
    """Union of widened intervals; those less than gap apart become one. (key, start_us, end_us, n)."""
    wide = rows.select("key", (F.col("start_us") - before_us).alias("start_us"), (F.col("end_us") + after_us).alias("end_us"))
    earlier = Window.partitionBy("key").orderBy("start_us", "end_us")
    reach = F.max("end_us").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start_us") - reach >= max(gap_us, 1)), 1).otherwise(0)
    # touching intervals (a gap of 0) are one as well
    islands = wide.withColumn("new", new).withColumn("island", F.sum("new").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("key", "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n")).drop("island")


def overlap_pairs(left: DataFrame, right: DataFrame, bin_us: int) -> DataFrame:
    """Pairs of rows of one key that overlap: the left row, the right row as r_*, and overlap_us.

    Both sides are dealt to the time bins that they touch, and a pair is met in the bin where its later row begins, so
    the join is an equi-join and each pair comes once. bin_us: about the length of a typical row.
    """

    def binned(rows: DataFrame, name: str) -> DataFrame:
        last = F.greatest(F.col("start_us"), F.col("end_us") - 1)
        return rows.withColumn(name, F.explode(F.sequence(F.floor(F.col("start_us") / bin_us), F.floor(last / bin_us))))

    a = binned(positive(left), "bin")
    b = binned(positive(right), "bin").select("bin", *(F.col(c).alias(f"r_{c}" if c != "key" else c) for c in right.columns))
    meet = F.floor(F.greatest("start_us", "r_start_us") / bin_us) == F.col("bin")
    over = F.least("end_us", "r_end_us") - F.greatest("start_us", "r_start_us")
    return a.join(b, ["key", "bin"]).where(meet).withColumn("overlap_us", over).where("overlap_us > 0").drop("bin")


def overlap_share(left: DataFrame, right: DataFrame, bin_us: int) -> DataFrame:
    """For each left row, how much of it the (disjoint) right rows cover: (key, ord, covered_us)."""
    found = overlap_pairs(left, right, bin_us).groupBy("key", "ord").agg(F.sum("overlap_us").alias("covered_us"))
    return left.select("key", "ord").join(found, ["key", "ord"], "left").select("key", "ord", F.coalesce("covered_us", F.lit(0)).alias("covered_us"))


def subtract(rows: DataFrame, minus: DataFrame, margin_us: int = 0, least_us: int = 1, bin_us: int = 3_600_000_000) -> DataFrame:
    """Parts of rows that no widened minus row covers and that are long enough: (key, ord, start_us, end_us).

    bin_us: about the length of a typical row; rows meet only what lies in the bins that they touch.
    """
    cover = unite(minus.where("end_us >= start_us"), margin_us, margin_us).withColumn("ord", F.lit(0))
    met = overlap_pairs(rows.select("key", "ord", "start_us", "end_us"), cover.select("key", "ord", "start_us", "end_us"), bin_us)
    w = Window.partitionBy("key", "ord").orderBy("r_start_us")
    before = met.select("key", "ord", F.coalesce(F.lag("r_end_us").over(w), F.col("start_us")).alias("start_us"), F.col("r_start_us").alias("end_us"))
    behind = met.groupBy("key", "ord").agg(F.max("r_end_us").alias("start_us"), F.max("end_us").alias("end_us"))
    free = positive(rows).select("key", "ord", "start_us", "end_us").join(behind.select("key", "ord"), ["key", "ord"], "left_anti")
    return before.unionByName(behind).unionByName(free).where(F.col("end_us") - F.col("start_us") >= least_us)


def uncovered(rows: DataFrame, minus: DataFrame, margin_us: int = 150_000, piece_us: int = 200_000, join_us: int = 500_000, least_us: int = 600_000, longest_us: int = 25_000_000, bin_us: int = 30_000_000) -> DataFrame:
    """What of rows no minus row covers, in stretches to be looked at again: (key, start_us, end_us).

    Pieces under piece_us go; pieces less than join_us apart are joined while that stays within longest_us, one after
    another from the first; stretches are cut at longest_us, and those under least_us go.
    """
    from .folds import fold

    pieces = subtract(rows, minus, margin_us, piece_us, bin_us)

    def step(state: dict | None, row: dict, after: dict | None) -> dict:
        if state is not None and row["start_us"] - state["to_us"] < join_us and row["end_us"] - state["from_us"] <= longest_us:
            return {"run": state["run"], "from_us": state["from_us"], "to_us": row["end_us"]}
        return {"run": 1 if state is None else state["run"] + 1, "from_us": row["start_us"], "to_us": row["end_us"]}

    runs = fold(pieces, step, "run long, from_us long, to_us long", order=("start_us", "end_us", "ord"))
    joined = runs.groupBy("key", "run").agg(F.min("from_us").alias("a"), F.max_by("to_us", F.struct("start_us", "end_us", "ord")).alias("b")).where(F.col("b") - F.col("a") >= least_us)
    cuts = joined.select("key", "b", F.explode(F.sequence(F.col("a"), F.col("b") - 1, F.lit(longest_us).cast("long"))).alias("start_us"))
    return cuts.select("key", "start_us", F.least(F.col("start_us") + longest_us, F.col("b")).alias("end_us")).where(F.col("end_us") - F.col("start_us") >= least_us)


def as_of(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Each left row with the last right row of its key that starts no later; r_* are null where there is none."""
    shape = [F.col(c) for c in left.columns]
    a = left.select("key", F.col("start_us").alias("t"), F.lit(1).alias("side"), F.struct(*shape).alias("l"), F.lit(None).alias("r"))
    b = right.select("key", F.col("start_us").alias("t"), F.lit(0).alias("side"), F.lit(None).alias("l"), F.struct("start_us", *columns).alias("r"))
    a = a.withColumn("r", F.col("r").cast(b.schema["r"].dataType))
    b = b.withColumn("l", F.col("l").cast(a.schema["l"].dataType))
    tie = F.coalesce(F.col("r.ord") if "ord" in columns else F.lit(None), F.col("l.ord"))
    w = Window.partitionBy("key").orderBy("t", "side", tie).rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("r", F.last("r", ignorenulls=True).over(w)).where("side = 1")
    return met.select("l.*", F.col("r.start_us").alias("r_start_us"), *(F.col(f"r.{c}").alias(f"r_{c}") for c in columns))


def nearest(left: DataFrame, right: DataFrame, within_us: int) -> DataFrame:
    """Each left row with the right start nearest to its own, the earlier on ties: near_us, null beyond within_us."""
    a = left.select("key", F.col("start_us").alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("l"))
    b = right.select("key", F.col("start_us").alias("t"), F.lit(0).alias("side")).withColumn("l", F.lit(None).cast(a.schema["l"].dataType))
    both = a.unionByName(b).withColumn("edge", F.when(F.col("side") == 0, F.col("t")))
    w = Window.partitionBy("key").orderBy("t", "side")
    back = F.last("edge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("edge", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"back": back, "ahead": ahead}).where("side = 1")
    best = F.when(F.col("ahead").isNull() | (F.col("t") - F.col("back") <= F.col("ahead") - F.col("t")), F.col("back")).otherwise(F.col("ahead"))
    return both.withColumn("near", best).select("l.*", F.when(F.abs(F.col("near") - F.col("t")) <= within_us, F.col("near")).alias("near_us"))


def snap_starts(cues: DataFrame, speech: DataFrame, most_us: int, least_us: int = 80_000) -> DataFrame:
    """start_us moved back to where the stretch of speech begins that a cue starts in: by least_us to most_us, and not
    before the end of the cue before it. `moved` says whether. speech: (key, start_us, end_us)."""
    met = as_of(cues, speech.select("key", "start_us", "end_us"), ["end_us"])
    back = F.col("start_us") - F.col("r_start_us")
    before = F.coalesce(F.lag("end_us").over(Window.partitionBy("key").orderBy("start_us", "ord")), F.lit(0))
    moved = F.coalesce((F.col("r_end_us") > F.col("start_us")) & (back >= least_us) & (back > 0) & (back <= most_us) & (F.col("r_start_us") >= before), F.lit(False))
    found = met.withColumn("moved", moved)
    return found.withColumn("start_us", F.when(F.col("moved"), F.col("r_start_us")).otherwise(F.col("start_us"))).select(*cues.columns, "moved")


def snap_to_speech(cues: DataFrame, onsets: DataFrame, offsets: DataFrame, within_us: int, gap_us: int = 40_000, least_us: int = 300_000) -> DataFrame:
    """Starts moved to the nearest onset and ends to the nearest offset of speech within reach, the earlier of two as near.

    onsets, offsets: (key, start_us). A cue keeps least_us, and an end stays gap_us before where the next cue would
    start. Adds new_start_us and new_end_us.
    """
    found = nearest(cues, onsets, within_us).withColumnRenamed("near_us", "_on")
    ends = cues.select("key", "ord", F.col("end_us").alias("start_us"))
    found = found.join(nearest(ends, offsets, within_us).select("key", "ord", F.col("near_us").alias("_off")), ["key", "ord"])
    wanted = F.coalesce("_on", "start_us")
    start = F.when(wanted < F.col("end_us") - least_us, wanted).otherwise(F.col("start_us"))
    w = Window.partitionBy("key").orderBy("start_us", "ord")
    found = found.withColumns({"_want": wanted, "new_start_us": start}).withColumns({"_next": F.lead("_want").over(w), "_next_start": F.lead("start_us").over(w)})
    limit = F.col("_next") - gap_us
    end = F.when((F.col("_off") > limit) & (F.col("_next_start") >= F.col("new_start_us")), limit).otherwise(F.col("_off"))
    moved = F.when(F.coalesce(end >= F.col("new_start_us") + least_us, F.lit(False)), end).otherwise(F.col("end_us"))
    return found.withColumn("new_end_us", moved).select(*cues.columns, "new_start_us", "new_end_us")


def source_times(points: DataFrame, pieces: DataFrame, forward: bool = True) -> DataFrame:
    """Times of a packed chunk as times of its source: adds source_us. points: (key, ord, start_us); pieces: (key, start_us,
    end_us, source_us) in the chunk. A time in a gap goes forward to the next piece (a start), or back to the end of the one
    before (an end); one before the first or behind the last piece goes to its nearest edge."""
    p = pieces.withColumn("next_us", F.lead("source_us").over(Window.partitionBy("key").orderBy("start_us")))
    first = pieces.groupBy("key").agg(F.min_by("source_us", "start_us").alias("first_us"))
    met = as_of(points, p, ["end_us", "source_us", "next_us"]).join(first, "key", "left")
    into = F.col("r_source_us") + F.col("start_us") - F.col("r_start_us")
    edge = F.col("r_source_us") + F.col("r_end_us") - F.col("r_start_us")
    inside = F.col("start_us") < F.col("r_end_us") if forward else F.col("start_us") <= F.col("r_end_us")
    found = F.when(F.col("r_start_us").isNull(), F.col("first_us")).when(inside, into).otherwise(F.coalesce("r_next_us", edge) if forward else edge)
    return met.select(*points.columns, found.alias("source_us"))


def fill(rows: DataFrame, column: str) -> DataFrame:
    """Fills nulls by the last value of the key before them, those at the front by the first after."""
    w = Window.partitionBy("key").orderBy("start_us", "ord")
    forward = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(column, F.coalesce(forward, backward))


def _numbered_runs(rows: DataFrame, value: Column) -> DataFrame:
    w = Window.partitionBy("key").orderBy("start_us", "ord")
    new = F.when(F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_lengths(rows: DataFrame, column: str) -> DataFrame:
    """Runs of equal values in order: (key, run, value, start_us, end_us, n)."""
    found = _numbered_runs(rows, F.col(column)).groupBy("key", "run")
    return found.agg(F.first(column).alias("value"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n"))


def limit_repeats(rows: DataFrame, column: str, most: int = 2) -> DataFrame:
    """Of equal values in a row, keeps the first `most`."""
    w = Window.partitionBy("key", "run").orderBy("start_us", "ord")
    numbered = _numbered_runs(rows, F.col(column)).withColumn("_n", F.row_number().over(w))
    return numbered.where(F.col("_n") <= most).drop("_n", "run")


def phrase_runs(rows: DataFrame, column: str, phrases: list[str], most: int = 8, gap_us: int = 3_000_000) -> DataFrame:
    """Rows that belong to a known phrase spread over up to `most` rows in a row: (key, ord), each once.

    From every row on, the texts of 1, 2, ... rows are put together until they are a phrase; a gap over gap_us ends the
    try. As in reading from the first row on, a row of a found phrase begins none. phrases are compared as they are.
    """
    from .folds import fold

    w = Window.partitionBy("key").orderBy("start_us", "ord")
    ahead = w.rowsBetween(0, most - 1)
    seen = rows.withColumns({"_t": F.collect_list(F.coalesce(F.col(column), F.lit(""))).over(ahead), "_s": F.collect_list("start_us").over(ahead), "_e": F.collect_list("end_us").over(ahead)})
    lengths = F.sequence(F.lit(1), F.size("_t"))
    near = lambda n: F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (n == 1) | (F.get("_s", i) - F.get("_e", i - 1) <= gap_us))
    known = lambda n: F.array_join(F.slice("_t", F.lit(1), n), "").isin(*phrases)
    seen = seen.withColumn("_n", F.coalesce(F.array_min(F.filter(lengths, lambda n: near(n) & known(n))), F.lit(0)))

    def step(state: dict | None, row: dict, after: dict | None) -> dict:
        left = max(0, (0 if state is None else state["left"]) - 1)
        return {"left": left if left else row["_n"]}

    return fold(seen.select("key", "ord", "start_us", "end_us", "_n"), step, "left long", ("_n",)).where("left > 0").select("key", "ord")


def drop_loops(rows: DataFrame, column: str, longest: int = 8, least: int = 4, given: str | None = None) -> DataFrame:
    """Marks rows that repeat the block of 2 to `longest` rows before them: `looped`.

    Every row that is not marked yet may begin a block: the shortest one, of at least `least` characters, that stands again
    right behind itself. All its whole repetitions are marked. Rows that `given` (a boolean column) marks already begin no
    block, but take part in blocks. Windows say how far each row's block is repeated; a fold in order, which
    keeps the stretches that end ahead, at most `longest` of them, says which rows begin one. Rows without key, start or end
    are not marked.
    """
    from .folds import fold

    w = Window.partitionBy("key").orderBy("start_us", "ord")
    back = Window.partitionBy("key").orderBy(F.desc("start_us"), F.desc("ord"))
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    size = F.length(F.coalesce(F.col(column), F.lit("")))
    periods = range(2, longest + 1)
    place = F.row_number().over(w)
    same = {f"_s{p}": F.coalesce(F.col(column).eqNullSafe(F.lead(column, p).over(w)) & F.lead(F.lit(True), p).over(w), F.lit(False)) for p in periods}
    heavy = {f"_h{p}": F.sum(size).over(w.rowsBetween(0, p - 1)) >= least for p in periods}
    seen = rows.withColumns({"_i": place, **same, **heavy})
    # so many rows from here on equal those a period behind them
    runs = {f"_r{p}": F.min(F.when(~F.col(f"_s{p}"), F.col("_i"))).over(upto) - F.col("_i") for p in periods}
    seen = seen.withColumns(runs)
    found = [F.when(F.col(f"_h{p}") & (F.col(f"_r{p}") >= p), F.struct(F.lit(p).alias("period"), (F.floor(F.col(f"_r{p}") / p) * p).cast("long").alias("n"))) for p in periods]
    begins = F.lit(True) if given is None else ~F.coalesce(F.col(given), F.lit(False))
    seen = seen.withColumn("_block", F.when(begins, F.coalesce(*found))).withColumns({"_period": F.col("_block.period"), "_n": F.col("_block.n")})

    def step(state: dict | None, row: dict, after: dict | None) -> dict:
        at, ahead = (0, ()) if state is None else (state["at"] + 1, state["ahead"])
        looped = any(a <= at < b for a, b in ahead)
        ahead = tuple(x for x in ahead if x[1] > at + 1)
        if not looped and row["_period"] is not None:
            ahead += ((at + row["_period"], at + row["_period"] + row["_n"]),)
        return {"looped": looped, "at": at, "ahead": ahead}

    marked = fold(seen.select(*rows.columns, "_period", "_n"), step, "looped boolean", ("_period", "_n"))
    return marked.select(*rows.columns, F.coalesce("looped", F.lit(False)).alias("looped"))


def scenes(runs: DataFrame, main: str) -> DataFrame:
    """Of runs (key, run, value, start_us, end_us), those that are not in the main value; neighbours of one value, with no
    run of the main one or of none between them, are one: (key, value, start_us, end_us)."""
    w = Window.partitionBy("key").orderBy("run")
    other = F.col("value").isNotNull() & (F.col("value") != main)
    new = F.when(F.lag("value").over(w).eqNullSafe(F.col("value")), 0).otherwise(1)
    found = runs.withColumn("_new", new).withColumn("_scene", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(other)
    return found.groupBy("key", "_scene").agg(F.first("value").alias("value"), F.min("start_us").alias("start_us"), F.max_by("end_us", "run").alias("end_us")).drop("_scene")


def every_frame(spans: DataFrame, chunk: int = 1024) -> DataFrame:
    """(key, frame) for each frame from 0 to `last` of (key, last). No array is longer than chunk or the number of chunks."""
    starts = spans.where("last >= 0").select("key", "last", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / chunk))).alias("_c"))
    return starts.select("key", F.explode(F.sequence(F.col("_c") * chunk, F.least(F.col("last"), F.col("_c") * chunk + chunk - 1))).alias("frame"))


def close_and_drop(series: DataFrame, gap: int, least: int) -> DataFrame:
    """A boolean series (key, frame, active), one row for each frame: inner gaps of at most `gap` frames become active,
    then active runs shorter than `least` become inactive."""

    def runs(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("key").orderBy("frame")
        new = F.when(F.lag("active").over(w) == F.col("active"), 0).otherwise(1)
        numbered = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
        return numbered.withColumns({"_n": F.count("*").over(Window.partitionBy("key", "run")), "_last": F.max("run").over(Window.partitionBy("key"))})

    numbered = runs(series)
    inner = (F.col("run") > 1) & (F.col("run") < F.col("_last"))
    closed = numbered.withColumn("active", F.col("active") | (inner & (F.col("_n") <= gap))).select("key", "frame", "active")
    numbered = runs(closed)
    return numbered.withColumn("active", F.col("active") & (F.col("_n") >= least)).select("key", "frame", "active")


def renumber(rows: DataFrame) -> DataFrame:
    """idx from 1 by start, stable."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("key").orderBy("start_us", "ord")))


def slots(rows: DataFrame, length_us: int | None = None) -> DataFrame:
    """slot_us: time to the next start; the last row's ends with the medium, if its length is given."""
    following = F.lead("start_us").over(Window.partitionBy("key").orderBy("start_us", "ord"))
    return rows.withColumn("slot_us", F.coalesce(following, F.lit(length_us).cast("long")) - F.col("start_us"))


def anchored(rows: DataFrame, column: str, least_us: int = 700_000, percent: int = 60) -> DataFrame:
    """start_us moved later to the anchor in `column`, but so that at least least_us and percent of the slot stay."""
    following = F.lead("start_us").over(Window.partitionBy("key").orderBy("start_us", "ord"))
    slot = following - F.col("start_us")
    room = F.greatest(F.lit(0), slot - F.greatest(F.lit(least_us), F.floor(slot * percent / 100)))
    late = F.greatest(F.lit(0), F.col(column) - F.col("start_us"))
    moved = F.col("start_us") + F.coalesce(F.least(late, room), late, F.lit(0))
    return rows.withColumn("moved_us", moved.cast("long"))


def keep_newest(rows: DataFrame, size: str, cap: int) -> DataFrame:
    """Rows of each key whose running size, newest first, stays within the cap: a cache after pruning."""
    w = Window.partitionBy("key").orderBy(F.desc("start_us"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_total", F.sum(size).over(w)).where(F.col("_total") <= cap).drop("_total")


def newest(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("start_us"), F.desc("ord"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def running_best(rows: DataFrame, column: str) -> DataFrame:
    """Progress that only moves forward: the running maximum."""
    w = Window.partitionBy("key").orderBy("start_us", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("best", F.max(column).over(w))


def best_offset(left: DataFrame, right: DataFrame, reach_us: int, step_us: int, frame_us: int) -> DataFrame:
    """Per key, the shift of left whose rows cover most active frames of right; the smallest shift wins ties.

    Each frame that a left row covers meets the active frames within reach, binned, and votes for their distance.
    """

    def frames(rows: DataFrame, name: str) -> DataFrame:
        span = F.sequence(F.floor(F.col("start_us") / frame_us), F.floor((F.col("end_us") - 1) / frame_us))
        return positive(rows).select("key", F.explode(span).alias(name)).distinct()

    reach, step = reach_us // frame_us, step_us // frame_us
    a = frames(left, "a").withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / reach) - 1, F.floor(F.col("a") / reach) + 1)))
    b = frames(right, "b").withColumn("bin", F.floor(F.col("b") / reach))
    votes = a.join(b, ["key", "bin"]).select("key", (F.col("b") - F.col("a")).alias("d")).where((F.abs("d") <= reach) & (F.col("d") % step == 0))
    counted = votes.groupBy("key", "d").agg(F.count("*").alias("score"))
    best = counted.groupBy("key").agg(F.max(F.struct("score", (-F.col("d")).alias("m"))).alias("x"))
    return best.select("key", (-F.col("x.m") * frame_us).alias("offset_us"), F.col("x.score").alias("score"))


def detect_offset(left: DataFrame, right: DataFrame, reach_us: int, step_us: int, frame_us: int) -> DataFrame:
    """Per key of left, (key, offset_us, score, confidence) of the shift under which its rows fit right best.

    A frame under a row scores 1 where right is active and -0.35 where it is silent, between right's first and last
    active frame. Shifts of whole steps within reach are tried first, then those of single frames within a step of the
    winner; the smallest shift wins ties, the first pass those of the passes. confidence: (best - upper median of the
    first pass) / its spread, within 0 and 1. A key without any active frame has offset, score and confidence 0. As in
    the reference, rows out of reach of the active span leave all shifts at 0, and the smallest is taken, at confidence 0.
    """
    reach, step = reach_us // frame_us, step_us // frame_us
    wide = reach + step
    frame = lambda c: F.floor(c / frame_us)
    active = positive(right).select("key", F.explode(F.sequence(frame(F.col("start_us")), frame(F.col("end_us") - 1))).alias("b")).distinct()
    medium = active.groupBy("key").agg(F.min("b").alias("lo"), (F.max("b") + 1).alias("hi"))
    whole = lambda c: F.bround(F.col(c) / frame_us, 0).cast("long")
    spans = positive(left).select("key", whole("start_us").alias("s"), whole("end_us").alias("e")).where("e > s")
    spans = spans.groupBy("key", "s", "e").agg(F.count("*").alias("w"))

    a = spans.select("key", "w", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("a")).groupBy("key", "a").agg(F.sum("w").alias("w"))
    a = a.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / wide) - 1, F.floor(F.col("a") / wide) + 1)))
    met = a.join(active.withColumn("bin", F.floor(F.col("b") / wide)), ["key", "bin"]).select("key", (F.col("b") - F.col("a")).alias("d"), "w")
    votes = met.where(F.abs("d") <= wide).groupBy("key", "d").agg(F.sum("w").alias("votes"))

    def scored(shifts: DataFrame) -> DataFrame:
        within = F.greatest(F.lit(0), F.least(F.col("e") + F.col("d"), F.col("hi")) - F.greatest(F.col("s") + F.col("d"), F.col("lo")))
        inside = shifts.join(spans, "key").join(medium, "key").groupBy("key", "d").agg(F.sum(F.col("w") * within).alias("inside"))
        both = shifts.join(votes, ["key", "d"], "left").join(inside, ["key", "d"], "left")
        # hundredths, so that equal scores are equal
        return both.select("key", "d", (135 * F.coalesce("votes", F.lit(0)) - 35 * F.coalesce("inside", F.lit(0))).alias("score"))

    top = F.max(F.struct("score", (-F.col("d")).alias("m")))
    first = scored(medium.select("key", F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"), F.lit(step).cast("long"))).alias("d")))
    # one value for each step within reach, a number that the arguments fix
    first = first.groupBy("key").agg(top.alias("x"), F.sort_array(F.collect_list("score")).alias("all"))
    second = scored(first.select("key", F.explode(F.sequence(-F.col("x.m") - step, -F.col("x.m") + step)).alias("d"))).groupBy("key").agg(top.alias("y"))
    best = first.join(second, "key").withColumn("best", F.when(F.col("y.score") > F.col("x.score"), F.col("y")).otherwise(F.col("x")))
    n = F.size("all")
    median, spread = F.element_at("all", F.floor(n / 2).cast("int") + 1), F.greatest(F.lit(1e-7), F.element_at("all", -1) - F.element_at("all", 1))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("best.score") - median) / spread))
    best = best.select("key", (-F.col("best.m") * frame_us).alias("offset_us"), (F.col("best.score") / 100).alias("score"), sure.alias("confidence"))
    found = left.select("key").distinct().join(best, "key", "left")
    return found.select("key", F.coalesce("offset_us", F.lit(0)).alias("offset_us"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))

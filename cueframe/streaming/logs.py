"""Streams of log rows and progress: counters by time, the newest rows, progress that only rises, change detection.

Every function takes a streaming DataFrame and gives one, to be started with a checkpoint location; a query that is
started again with the same location goes on where it stopped. State is kept by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counted(logs: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, level, n): rows of (time, level) by window; rows later than `late` behind the newest time are not counted."""
    found = logs.withWatermark("time", late).groupBy(F.window("time", window).alias("w"), "level").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), "level", "n")


def progress(rows: DataFrame) -> DataFrame:
    """(key, best): after each batch, how far each key has come; what falls behind changes nothing. rows: (key, done double).
    Null values and keys are left out. Output mode update."""
    return rows.where("key is not null and done is not null").groupBy("key").agg(F.max("done").alias("best"))


def newest(rows: DataFrame, n: int) -> DataFrame:
    """(key, time, message): after each batch, the newest n rows of the keys that got any, a ring buffer by key. rows: (key
    string, time timestamp, message string). n rows of a key are its state; ties keep the order of arrival."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, messages = state.get if state.exists else ([], [])
        kept = [*zip(times, messages, strict=True)]
        for part in parts:
            kept += [(int(t.value), m) for t, m in zip(part["time"], part["message"], strict=True)]
            kept = sorted(kept, key=lambda x: x[0])[-n:]
        state.update(([t for t, _ in kept], [m for _, m in kept]))
        yield pd.DataFrame({"key": key[0], "time": pd.to_datetime([t for t, _ in kept]), "message": [m for _, m in kept]})

    return rows.where("time is not null").groupBy("key").applyInPandasWithState(step, "key string, time timestamp, message string", "times array<long>, messages array<string>", "update", GroupStateTimeout.NoTimeout)


def changed(rows: DataFrame, more_than: float) -> DataFrame:
    """(key, time, value): rows whose value differs by more than a limit from the last such row of the key, as folds.changed
    does for tables. rows: (key string, time timestamp, value double), in order by batches. Null values are left out."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        for part in parts:
            fresh = []
            for at, value in zip(part["time"], part["value"], strict=True):
                if last is None or abs(value - last) > more_than:
                    last = value
                    fresh.append((key[0], at, value))
            if fresh:
                yield pd.DataFrame(fresh, columns=["key", "time", "value"])
        if last is not None:
            state.update((last,))

    given = rows.where("key is not null and value is not null")
    return given.groupBy("key").applyInPandasWithState(step, "key string, time timestamp, value double", "last double", "append", GroupStateTimeout.NoTimeout)


def not_done(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (key, ..) of a stream that a table of finished work (key) has not: a restart with a new checkpoint skips them.
    done is read anew for each batch."""
    return files.join(done.select("key").distinct(), "key", "left_anti")


#: Levels of log rows from the least important on.
LEVELS = ["detail", "info", "warning", "error"]


def of_level(rows: DataFrame, least: str, area: str | None = None) -> DataFrame:
    """Log rows (level, area, ..), of a table or a stream, of a level and the more important ones, and of one area if it is
    given. Levels that are not known are kept with the most important ones."""
    low = [x for x in LEVELS if LEVELS.index(x) < LEVELS.index(least)]
    found = rows.where(~F.coalesce(F.lower("level").isin(*low), F.lit(False))) if low else rows
    return found if area is None else found.where(F.col("area") == area)


_SEGMENT = "key string, ord long, start_us long, end_us long, text string, prob double, no_speech double"


def segments(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """(time, key, ord, start_us, end_us, text, prob, no_speech): segments of transcripts as they come, each once.

    lines: (time timestamp, value string), each value a segment as JSON. What cannot be read, has no letters and digits and no
    note, or is doubtful (no-speech over 0.6 with a probability under 0.5) goes; a segment that is sent again within
    `late` is left out. State: the numbers of the segments of that time.
    """
    read = lines.select("time", F.from_json("value", _SEGMENT).alias("s")).select("time", "s.*").where("key is not null and ord is not null and start_us is not null and end_us is not null")
    said = F.coalesce(F.col("text").rlike(r"[\p{L}\p{Nd}♪]"), F.lit(False))
    doubtful = F.coalesce((F.col("no_speech") > 0.6) & (F.col("prob") > 0) & (F.col("prob") < 0.5), F.lit(False))
    return read.where(said & ~doubtful).withWatermark("time", late).dropDuplicatesWithinWatermark(["key", "ord"])


def rolling_log(folder: str, most_bytes: int = 2_000_000) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends log rows (time, level, area, message) as lines of text to folder/current, a folder for each
    batch. Where current holds more than most_bytes before a batch, it takes the place of folder/old first, so that the
    newest lines and no more than about twice as much stay. A batch that is repeated replaces its own lines."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        paths = spark._jvm.org.apache.hadoop.fs.Path
        current, old = paths(f"{folder}/current"), paths(f"{folder}/old")
        store = current.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        mine = paths(f"{folder}/current/batch={number}")
        if store.exists(current) and not store.exists(mine) and store.getContentSummary(current).getLength() > most_bytes:
            store.delete(old, True)
            store.rename(current, old)
        line = F.concat_ws(" ", F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.upper("level"), F.concat(F.lit("["), "area", F.lit("]")), F.rtrim("message"))
        batch.sort("time").select(line.alias("value")).write.mode("overwrite").text(f"{folder}/current/batch={number}")

    return write

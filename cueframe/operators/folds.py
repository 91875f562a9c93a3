"""Ordered folds: operators in which a row reads what the row before it has become.

A fold runs over the rows of one key in order, on the executors, and keeps only its state, so a key of any length takes
no memory; Spark deals out and sorts the keys. A key is one document or one medium. Rows without key, start or end are
in no order: they keep their place in the result with nulls in the new columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(rows: DataFrame, step: Callable[[dict | None, dict, dict | None], dict], added: str, reads: tuple[str, ...] = (), order: tuple[str, ...] = ("start_us", "ord")) -> DataFrame:
    """Runs step(state, row, next row) over each key's rows in order; its dict is both the new columns and the next state.

    added: DDL of the new columns; they replace columns of the same name. reads: columns that step needs besides start_us
    and end_us. State is None before the first row. Only these columns are turned into Python values; whole numbers stay
    whole beside nulls.
    """
    extra = T._parse_datatype_string(added)
    kept = [f for f in rows.schema if f.name not in extra.names]
    schema = T.StructType(kept + list(extra))
    arrow = to_arrow_schema(T.StructType(list(extra)))
    wanted = list(dict.fromkeys(["key", "start_us", "end_us", *reads]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row is folded when the next one is known, so each batch gives the last row of the one before it
        state, held, rest = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for values in zip(*(batch.column(c).to_pylist() for c in wanted), strict=True):
                row = dict(zip(wanted, values, strict=True))
                if held is not None:
                    same = held["key"] == row["key"]
                    state = step(state, held, row if same else None)
                    found.append(state)
                    if not same:
                        state = None
                held = row
            table = batch.select([f.name for f in kept])
            done = table.slice(0, table.num_rows - 1)
            yield from joined(pa.Table.from_batches([done] if rest is None else [rest, done]), found)
            rest = table.slice(table.num_rows - 1)
        if held is not None:
            yield from joined(pa.Table.from_batches([rest]), [step(state, held, None)])

    def joined(table: pa.Table, found: list[dict]) -> Iterator[pa.RecordBatch]:
        if found:
            for f in arrow:
                table = table.append_column(f, pa.array([x[f.name] for x in found], f.type))
            yield from table.combine_chunks().to_batches()

    placed = F.col("key").isNotNull() & F.col("start_us").isNotNull() & F.col("end_us").isNotNull()
    sorted_rows = rows.where(placed).repartition("key").sortWithinPartitions("key", *order)
    lost = rows.where(~placed).select(*(f.name for f in kept), *(F.lit(None).cast(f.dataType).alias(f.name) for f in extra))
    return sorted_rows.mapInArrow(run, schema).unionByName(lost)


def without_overlap(rows: DataFrame, pause_us: int = 100_000) -> DataFrame:
    """Schedules rows one after another: a row that would start before the last one ends starts pause later than that.

    Adds placed_us, ends_us and late_us.
    """

    def step(state: dict | None, row: dict, after: dict | None) -> dict:
        start = row["start_us"]
        if state is not None and start < state["ends_us"]:
            start = state["ends_us"] + pause_us
        return {"placed_us": start, "ends_us": start + row["end_us"] - row["start_us"], "late_us": start - row["start_us"]}

    return fold(rows, step, "placed_us long, ends_us long, late_us long")


def packed(rows: DataFrame, most_us: int = 28_000_000, join_us: int = 300_000, far_us: int = 3_000_000, far_join_us: int = 1_000_000) -> DataFrame:
    """Packs stretches into chunks greedily: a stretch joins the chunk while its length, with a join (longer after a gap
    over far_us), stays within most_us. Adds chunk (from 1), offset_us in it, and length_us of the chunk so far."""

    def step(state: dict | None, row: dict, after: dict | None) -> dict:
        size = row["end_us"] - row["start_us"]
        if state is not None:
            between = far_join_us if row["start_us"] - state["until_us"] > far_us else join_us
            if state["length_us"] + between + size <= most_us:
                at = state["length_us"] + between
                return {"chunk": state["chunk"], "offset_us": at, "length_us": at + size, "until_us": row["end_us"]}
        return {"chunk": 1 if state is None else state["chunk"] + 1, "offset_us": 0, "length_us": size, "until_us": row["end_us"]}

    return fold(rows, step, "chunk long, offset_us long, length_us long, until_us long").drop("until_us")


def readable(rows: DataFrame, chars: str, limit: float, gap_us: int = 84_000, most_us: int = 7_000_000) -> DataFrame:
    """Gives rows that are read too fast the time they need: the end grows up to the next start less the gap, then the start
    back to the end that the row before it has now, plus the gap. No row grows beyond most_us.

    chars: column with the characters of a row, limit: so many a second are in time. Adds new_start_us, new_end_us and outcome:
    fine (in time, or without length, and left as it is), fixed (now in time, by 0.05 characters a second), improved, no
    room. The whole time that is needed decides, also where it is beyond most_us.
    """
    speed = max(0.1, limit)

    def step(state: dict | None, row: dict, after: dict | None) -> dict:
        start, end, n = row["start_us"], row["end_us"], row[chars] or 0
        if end <= start or n * 1_000_000 <= limit * (end - start):
            return {"new_start_us": start, "new_end_us": end, "outcome": "fine"}
        want = min(round(n * 1_000_000 / speed), most_us)
        free = start + want if after is None else after["start_us"] - gap_us
        new_end, new_start = max(end, min(start + want, free)), start
        if new_end - start < want:
            new_start = min(start, max(0 if state is None else state["new_end_us"] + gap_us, new_end - want))
        got = new_end - new_start
        outcome = "fixed" if n * 1_000_000 <= (limit + 0.05) * got else "improved" if got > end - start else "no room"
        return {"new_start_us": new_start, "new_end_us": new_end, "outcome": outcome}

    return fold(rows, step, "new_start_us long, new_end_us long, outcome string", (chars,))


def tidy(rows: DataFrame, hold_us: int = 7_000_000, least_us: int = 300_000, shown_us: int = 800_000) -> DataFrame:
    """Timing of recognised rows: no longer than hold_us. A row that begins inside the one before it ends that one there, so
    that it comes up when it is spoken; only where less than least_us would be left of that one, it waits for its end. At
    least least_us long, and shown_us where the next row leaves room; no end after the next start unless that leaves less
    than least_us."""

    def step(state: dict | None, row: dict, after: dict | None) -> dict:
        start, end = row["start_us"], min(row["end_us"], row["start_us"] + hold_us)
        cut = None
        if state is not None and start < state["until_us"]:
            if start - state["new_start_us"] >= least_us:
                cut = start
            else:
                start = state["until_us"]
        end = max(end, start + least_us)
        following = None if after is None else after["start_us"]
        if end - start < shown_us:
            end = min(start + shown_us, following) if following is not None and following > start + least_us else start + shown_us
        if following is not None and end > following >= start + least_us:
            end = following
        return {"new_start_us": start, "until_us": end, "cut_us": cut}

    found = fold(rows, step, "new_start_us long, until_us long, cut_us long")
    # a row may end earlier than it knew, where the next one cuts it
    cut = F.lead("cut_us").over(Window.partitionBy("key").orderBy("start_us", "ord"))
    return found.withColumn("new_end_us", F.coalesce(cut, "until_us")).drop("until_us", "cut_us")


def changed(rows: DataFrame, column: str, more_than: float) -> DataFrame:
    """Marks rows whose value differs by more than a limit from the last marked one: column `fresh`. Nulls are not
    marked."""

    def step(state: dict | None, row: dict, after: dict | None) -> dict:
        value = row[column]
        if value is None or value != value:
            return {"fresh": False, "last": None if state is None else state["last"]}
        last = None if state is None else state["last"]
        fresh = last is None or abs(value - last) > more_than
        return {"fresh": fresh, "last": value if fresh else last}

    return fold(rows, step, "fresh boolean, last double", (column,)).drop("last")


def continued(rows: DataFrame, column: str, slack_us: int = 50_000) -> DataFrame:
    """Merges rows of equal content whose start is at most slack after the end of the row they continue; clips what
    overlaps a different row. (key, start_us, end_us, value, n)."""
    def step(state: dict | None, row: dict, after: dict | None) -> dict:
        if state is not None and state["value"] == row[column] and row["start_us"] <= state["reach_us"] + slack_us:
            return {"run": state["run"], "value": row[column], "reach_us": max(state["reach_us"], row["end_us"])}
        return {"run": 1 if state is None else state["run"] + 1, "value": row[column], "reach_us": row["end_us"]}

    runs = fold(rows, step, "run long, value string, reach_us long", (column,)).where("run is not null")
    merged = runs.groupBy("key", "run").agg(F.min("start_us").alias("start_us"), F.max("reach_us").alias("end_us"), F.first("value").alias("value"), F.count("*").alias("n"))
    following = F.lead("start_us").over(Window.partitionBy("key").orderBy("run"))
    return merged.withColumn("end_us", F.least("end_us", F.coalesce(following, "end_us"))).select("key", "start_us", "end_us", "value", "n")

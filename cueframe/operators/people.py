"""Speakers of a show: recognising those who are remembered, and giving each a voice."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import fold
from .rounds import kept

#: Rows whose lists one task makes at a time, pairs that it looks at in one step, and that are work for a task.
BLOCK, CELLS, TASK_PAIRS = 4_096, 1 << 22, 1 << 24
#: A row lists so many of the other side, and more where the lists of a key and of all keys stay within so many pairs.
LISTED, LISTED_BY_KEY, LISTED_BY_ALL = 32, 1 << 18, 1 << 21
#: Tables of sizes up to so many keys are sent to the rows; parts of a result that are read apart.
FEW_KEYS, PARTS = 100_000, 16


def _billionths(x: np.ndarray) -> np.ndarray:
    """Numbers rounded to 9 places as Spark's round does it, half away from zero by their decimal digits."""
    size = np.abs(x) * 1e9
    whole = np.floor(size + 0.5)
    for i in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-5):
        whole[i] = int(Decimal(repr(float(abs(x[i])))).scaleb(9).to_integral_value(ROUND_HALF_UP))
    return (np.sign(x) * whole).astype(np.int64)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of columns, added in the order of their rows as functions.maths.dot adds them."""
    total = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def _values(column: pa.Array) -> list:
    whole = pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if whole and not column.null_count else column.to_pylist()


def _comparable(ids: pa.Array, vectors: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, vectors (each a column) and lengths of those rows whose vector is not zero and has finite numbers alone."""
    columns = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1).T)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt(_sums(columns, columns))
    fine = (norms > 0) & (norms < np.inf)
    return (ids, columns, norms) if fine.all() else (ids.filter(pa.array(fine)), np.ascontiguousarray(columns[:, fine]), norms[fine])


class _Lists:
    """Rows of one side of a key, each with the `most` of the other side that are most alike, of equal ones the first that came."""

    def __init__(self, rows: pa.Table, side: str, most: int, least: float):
        self.key, self.most, self.least = rows["key"][0], most, least
        self.ids, self.vectors, self.norms = _comparable(rows[side].combine_chunks(), rows["embedding"].combine_chunks())
        self.units = np.ascontiguousarray((self.vectors / self.norms).T, dtype=np.float32)
        # products of rounded unit vectors pick the candidates; this is more than what they can lack of the sums that count
        self.lack = 1e-9 + (len(self.vectors) + 8) * 2.0**-23
        self.bar = np.full((len(self.ids), 1), least - self.lack, dtype=np.float32)
        self.full = np.full(len(self.ids), np.iinfo(np.int64).min)
        self.row, self.column, self.alike = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.new, self.others, self.seen, self.width = [], [], 0, 128

    def meet(self, ids: pa.Array, vectors: pa.Array) -> None:
        ids, vectors, norms = _comparable(ids, vectors)
        self.others.append(ids)
        start = 0
        while start < len(norms) and len(self.ids):
            # few at first, so that the lists are filled before many are met
            width = max(1, min(self.width, CELLS // len(self.ids)))
            self._look(vectors[:, start : start + width], norms[start : start + width])
            start, self.width = start + width, min(2 * self.width, CELLS)

    def _look(self, vectors: np.ndarray, norms: np.ndarray) -> None:
        met = np.flatnonzero(self.units @ (vectors / norms).astype(np.float32) >= self.bar)
        for a in range(0, len(met), 1 << 16):
            i, j = np.divmod(met[a : a + (1 << 16)], len(norms))
            total = np.zeros(len(i))
            for x, y in zip(self.vectors, vectors, strict=True):
                total += x[i] * y[j]
            scale = self.norms[i] * norms[j]
            some = scale > 0
            alike = _billionths(np.divide(total, scale, out=np.zeros(len(i)), where=some))
            # of equal ones those that are listed came first
            some &= (alike / 1e9 >= self.least) & (alike > self.full[i])
            self.new.append((i[some], j[some] + self.seen, alike[some]))
        self.seen += len(norms)
        if sum(len(i) for i, _, _ in self.new) >= len(self.ids) * self.most:
            self._cut()

    def _cut(self) -> None:
        row, column, alike = (np.concatenate(x) for x in zip((self.row, self.column, self.alike), *self.new, strict=True))
        order = np.argsort((row << 33) - alike, kind="stable")  # rows of a list are in the order in which they came
        row, column, alike = row[order], column[order], alike[order]
        size = np.bincount(row, minlength=len(self.ids))
        place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        stay, last = place < self.most, place == self.most - 1
        self.row, self.column, self.alike, self.new = row[stay], column[stay], alike[stay], []
        self.full[row[last]] = alike[last]
        self.bar[row[last], 0] = alike[last] / 1e9 - self.lack

    def pairs(self, side: str, other: str) -> list[pa.RecordBatch]:
        """The lists; a pair is its row's cut where it is the last of a full list, as others may have been left out."""
        self._cut()
        if not len(self.row):
            return []
        cut = (self.alike == self.full[self.row]) & (np.diff(self.row, append=-1) != 0) & (self.seen > self.most)
        found = {"key": pa.repeat(self.key, len(cut)), side: self.ids.take(pa.array(self.row)), other: pa.concat_arrays(self.others).take(pa.array(self.column))}
        found |= {"score": pa.array(self.alike / 1e9), f"{side}_cut": pa.array(cut), f"{other}_cut": pa.array(np.zeros(len(cut), dtype=bool))}
        names = ["key", "speaker", "person", "score", "speaker_cut", "person_cut"]
        return [pa.RecordBatch.from_arrays([found[c] for c in names], names)]


def _listed(rows: DataFrame, sizes: DataFrame, tasks: int, most: int, least: float) -> DataFrame:
    """(key, speaker, person, score, speaker_cut, person_cut): the list of each row, of speakers and of persons.

    Rows are dealt into blocks; a block meets all rows of the other side in order, one after another, and keeps its lists only.
    """
    of = lambda known: F.when(known, F.col("person_blocks")).otherwise(F.col("speaker_blocks"))
    own = F.struct(F.col("known").alias("side"), F.pmod(F.xxhash64("speaker", "person"), of(F.col("known"))).cast("int").alias("block"), F.lit(False).alias("other"))
    met = F.transform(F.sequence(F.lit(0), of(~F.col("known")) - 1), lambda b: F.struct((~F.col("known")).alias("side"), b.alias("block"), F.lit(True).alias("other")))
    sent = rows.join(sizes, ["key", "numbers"]).withColumn("to", F.explode(F.concat(F.array(own), met)))
    sent = sent.select("place", "to.side", "to.block", "to.other", "key", "speaker", "person", "embedding")
    sent = sent.repartition(tasks, "place", "side", "block").sortWithinPartitions("place", "side", "block", "other", "speaker", "person")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
        for batch in batches:
            marks = np.array([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "side", "block", "other")])
            starts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in pairwise(starts):
                if b > a:
                    yield tuple(marks[:3, a]), bool(marks[3, a]), batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("speaker", "person")
        group, own, lists = None, [], None
        for now, other, piece in pieces(batches):
            if now != group:
                if lists:
                    yield from lists.pairs(*names)
                group, own, lists, names = now, [], None, ("person", "speaker") if now[1] else ("speaker", "person")
            if not other:
                own.append(piece)
            elif own:
                lists = lists or _Lists(pa.Table.from_batches(own), names[0], most, least)
                lists.meet(piece.column(names[1]), piece.column("embedding"))
        if lists:
            yield from lists.pairs(*names)

    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in ("key", "speaker", "person")])
    return sent.mapInArrow(run, schema.add("score", "double").add("speaker_cut", "boolean").add("person_cut", "boolean"))


def _taken(pairs: DataFrame) -> DataFrame:
    """Takes the pairs of a key's lists in order: (key, speaker, person, score, matched, speaker_waits, person_waits), those that
    are taken, and one in which a side waits first."""
    columns = ("key", "speaker", "person", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one that waits is not taken in this round
        held, taken_s, waits_s, taken_p, waits_p = None, set(), set(), set(), set()
        for batch in batches:
            found = []
            for i, (key, s, p, cut_s, cut_p) in enumerate(zip(*(_values(batch.column(c)) for c in ("key", "speaker", "person", "speaker_cut", "person_cut")), strict=True)):
                if key != held:
                    held, taken_s, waits_s, taken_p, waits_p = key, set(), set(), set(), set()
                free_s, free_p = s not in taken_s, p not in taken_p
                both = free_s and free_p
                if both and s not in waits_s and p not in waits_p:
                    taken_s.add(s)
                    taken_p.add(p)
                    found.append((i, True, False, False))
                    continue
                new_s = free_s and (both or cut_s) and s not in waits_s
                new_p = free_p and (both or cut_p) and p not in waits_p
                if new_s:
                    waits_s.add(s)
                if new_p:
                    waits_p.add(p)
                if new_s or new_p:
                    found.append((i, False, new_s, new_p))
            if found:
                place, *marks = zip(*found, strict=True)
                rows = batch.select(columns).take(pa.array(place))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(m) for m in marks)], [*columns, "matched", "speaker_waits", "person_waits"])

    schema = T.StructType([pairs.schema[c] for c in columns]).add("matched", "boolean").add("speaker_waits", "boolean").add("person_waits", "boolean")
    in_order = pairs.repartition("key").sortWithinPartitions("key", F.desc("score"), "speaker", "person")
    return in_order.mapInArrow(run, schema)


def recognised(speakers: DataFrame, people: DataFrame, least: float = 0.5) -> DataFrame:
    """(key, speaker, person, score): pairs whose vectors are alike, the most alike first, each side once; of equal ones the
    first in order.

    speakers: (key, speaker, embedding), people: (key, person, embedding); a key is a show, and a show's people are compared
    with its speakers. Null and zero vectors, those with null or not finite numbers, and those of another length, are like none.

    All of a key are compared, but only the most alike of each row are listed, and pairs are taken from the lists in order.
    Once a list that was cut is used up, its row waits, as does each row that would be paired with one that waits. No pair
    that was left out comes before one that is taken so, hence those that wait are listed anew among themselves, round by
    round, until none does; the first pair of all is always taken, and most are in the first rounds.
    """
    single = all(f.schema["embedding"].dataType == T.ArrayType(T.FloatType(), f.schema["embedding"].dataType.containsNull) for f in (speakers, people))
    vector = F.col("embedding").cast("array<float>" if single else "array<double>")
    none = {"speaker": speakers.schema["speaker"].dataType, "person": people.schema["person"].dataType}
    named = lambda rows, mine: ["key", *(F.col(c) if c == mine else F.lit(None).cast(none[c]).alias(c) for c in none), F.lit(mine == "person").alias("known"), F.size("embedding").alias("numbers"), vector.alias("embedding")]
    both = [rows.where(F.col("key").isNotNull() & (F.size("embedding") > 0)).select(*named(rows, mine)) for rows, mine in ((speakers, "speaker"), (people, "person"))]
    rows, parts = kept(both[0].unionByName(both[1])), []

    while True:
        sizes = rows.groupBy("key", "numbers").agg(F.count_if(~F.col("known")).alias("speakers"), F.count_if("known").alias("people")).where("speakers > 0 and people > 0")
        per_block = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        sizes = kept(sizes.select("key", "numbers", "speakers", "people", per_block("speakers").alias("speaker_blocks"), per_block("people").alias("person_blocks"), F.monotonically_increasing_id().alias("place")))
        n = sizes.agg(F.count("*").alias("keys"), F.max(F.greatest("speakers", "people")).alias("largest"), F.sum(F.col("speakers") + F.col("people")).alias("rows"), F.sum(F.col("speaker_blocks") + F.col("person_blocks")).alias("blocks"), F.sum(2 * F.col("speakers") * F.col("people")).alias("pairs")).first()
        if not n["keys"]:
            break
        most = max(LISTED, min(LISTED_BY_KEY // n["largest"], LISTED_BY_ALL // n["rows"]))
        # a task for each block where there is work for so many, else one for several
        tasks = min(n["blocks"], max(n["pairs"] // TASK_PAIRS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        listed = _listed(rows, F.broadcast(sizes) if n["keys"] <= FEW_KEYS else sizes, tasks, most, least)
        found = kept(_taken(listed))
        parts.append(found.where("matched").select("key", "speaker", "person", "score"))
        if len(parts) > PARTS:
            parts = [kept(reduce(DataFrame.unionByName, parts))]
        if not found.where("speaker_waits").head(1) or not found.where("person_waits").head(1):
            break
        waiting = []
        for c, known in (("speaker", ~F.col("known")), ("person", F.col("known"))):
            ids = found.where(f"{c}_waits").select(F.col("key").alias("k"), F.col(c).alias("i")).distinct()
            waiting.append(rows.where(known).join(ids, (F.col("key") == F.col("k")) & F.col(c).eqNullSafe(F.col("i")), "left_semi"))
        rows = kept(waiting[0].unionByName(waiting[1]))
    if not parts:
        return rows.select("key", "speaker", "person", F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def with_voices(speakers: DataFrame, voices: dict[str, list[str]]) -> DataFrame:
    """(key, speaker, voice): a voice for each speaker without one, of their gender (the list of "female" where it is not
    known), the best of the list to those with most lines. No voice is used twice by a show until all of the list are; then
    the one used least, the first of equal ones. A voice of the other gender is replaced, and one that a speaker with more
    lines has while others are free, unless it was chosen by hand.

    speakers: (key, speaker, gender, lines, voice, by_hand); null and empty voices are none.
    """
    gender_of = {v: g for g, names in voices.items() for v in names}

    def pool(row: dict) -> list[str]:
        return voices["male" if row["gender"] == "male" else "female"]

    def keeping(state: dict | None, row: dict, after: dict | None) -> dict:
        kept = frozenset() if state is None else state["kept"]
        voice = row["voice"] or None
        if voice and not row["by_hand"]:
            other = row["gender"] is not None and gender_of.get(voice) != row["gender"]
            if other or voice in kept and any(v not in kept for v in pool(row)):
                voice = None
        return {"own": voice, "kept": kept | {voice} if voice else kept}

    def giving(state: dict | None, row: dict, after: dict | None) -> dict:
        used = {} if state is None else state["used"]
        voice = row["own"]
        if voice is None:
            voice = min(pool(row), key=lambda v: used.get(v, 0))
        return {"given": voice, "used": used | {voice: used.get(voice, 0) + 1}}

    reads = ("gender", "voice", "by_hand", "own")
    rows = speakers.withColumns({"start_us": F.lit(0).cast("long"), "end_us": F.lit(0).cast("long"), "_hand": ~F.coalesce("by_hand", F.lit(False)), "_less": -F.col("lines")})
    own = fold(rows, keeping, "own string", reads[:3], ("_hand", "_less", "speaker"))
    # those who keep a voice come first, so that it counts as used
    own = own.withColumn("_without", F.col("own").isNull())
    return fold(own, giving, "given string", reads, ("_without", "_less", "speaker")).select("key", "speaker", F.col("given").alias("voice"))

"""Centroid clustering in whole numbers, with float32 screening.

Each component x becomes floor(1024 * x). A round multiplies the vectors of a batch with all centroids in float32; a bound
on the rounding error of these products, from the norms and the unit of float32, makes an interval of every distance. A
centroid whose interval lies above another's upper end cannot be the nearest; where one is left it is the nearest for
certain, and where intervals overlap the distances are computed again in whole numbers, the smallest number winning ties.
So the result is that of exact arithmetic, whatever order a matrix product adds in. New centroids are floors of exact
quotients: tasks emit sums in limbs of 40 bits, which Spark adds up without overflow; k centroids are all the driver sees.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, runs

SCALE = 1024
#: Components up to here are handled as 64-bit integers: 4096 squares of differences still fit. Greater ones are Python's.
SMALL = 1 << 24
_LIMB = 40
#: Unit roundoff of float32.
_UNIT = 2.0**-24
#: Rows multiplied at once.
_ROWS = 8192


def usable(values: Column, size: int) -> Column:
    """Whether a vector has the wanted number of components, none null, NaN or infinite."""
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(values) == size) & ~bad, F.lit(False))


def whole(values: np.ndarray) -> np.ndarray | list[list[int]]:
    """floor(1024 x) of finite doubles, exactly: int64 where all are small, else Python's integers."""
    if not len(values) or np.abs(values).max() < SMALL / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    return [[math.floor(Fraction(x) * SCALE) for x in row] for row in values.tolist()]


class Centroids:
    """k centroids of whole components, ready for screening."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.small = all(abs(x) < SMALL for row in rows for x in row)
        if self.small:
            self.exact = np.array(rows, dtype=np.int64)
            self.single = self.exact.astype(np.float32).T.copy()
            self.squares = (self.exact**2).sum(axis=1).astype(np.float64)
            self.norms = np.sqrt(self.squares) * (1 + 1e-9)
            d = len(rows[0])
            # both factors are exact in float32 below 2^24; d products and sums, in any order, fused or not
            n = d + 2
            self.gamma = n * _UNIT / (1 - n * _UNIT)

    def screen(self, x: np.ndarray) -> np.ndarray:
        """For each vector and centroid, whether it may be the nearest. The vector's own square counts for none."""
        products = (x.astype(np.float32) @ self.single).astype(np.float64)
        length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        middle = self.squares[None, :] - 2 * products
        # the last term covers the rounding of `middle` and of the squares in double precision, with room to spare
        error = 2 * self.gamma * length[:, None] * self.norms[None, :] + 2.0**-48 * (self.squares[None, :] + 2 * np.abs(products) + 1)
        return middle - error <= (middle + error).min(axis=1)[:, None]

    def assign(self, x: np.ndarray | list[list[int]]) -> np.ndarray:
        """The number of each vector's nearest centroid."""
        if not (isinstance(x, np.ndarray) and self.small):
            return np.array([min((d, j) for j, d in enumerate(self._plain(v)))[1] for v in _listed(x)], dtype=np.int64)
        place = np.empty(len(x), dtype=np.int64)
        for at in range(0, len(x), _ROWS):
            part = x[at : at + _ROWS]
            left = self.screen(part)
            best = left.argmax(axis=1)
            open_rows = np.flatnonzero(left.sum(axis=1) > 1)
            if len(open_rows):  # intervals overlap: whole numbers decide
                row, number = np.nonzero(left[open_rows])
                exact = ((part[open_rows[row]] - self.exact[number]) ** 2).sum(axis=1)
                order = np.lexsort((number, exact, row))
                best[open_rows] = number[order[runs(row[order])]]
            place[at : at + len(part)] = best
        return place

    def distances(self, x: np.ndarray | list[list[int]], number: np.ndarray) -> list[int]:
        """The squared distance of each vector to the centroid of that number."""
        if isinstance(x, np.ndarray) and self.small:
            return ((x - self.exact[number]) ** 2).sum(axis=1).tolist()
        return [self._plain(v)[j] for v, j in zip(_listed(x), number.tolist(), strict=True)]

    def _plain(self, v: list[int]) -> list[int]:
        return [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in self.rows]


def _listed(x: np.ndarray | list[list[int]]) -> list[list[int]]:
    return x.tolist() if isinstance(x, np.ndarray) else x


def limbs(value: int) -> list[int]:
    """A whole number in base 2^40, the last limb with its sign."""
    out = []
    while not -(1 << _LIMB) < value < 1 << _LIMB:
        out.append(value & ((1 << _LIMB) - 1))
        value >>= _LIMB
    return [*out, value]


class Sums:
    """Exact sums by cluster and place; small numbers are added as int64, which 2^38 rows cannot overflow."""

    def __init__(self, k: int, width: int):
        self.counts, self.small, self.big = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64), {}

    def add(self, number: np.ndarray, values: np.ndarray | list[list[int]]) -> None:
        self.counts += np.bincount(number, minlength=len(self.counts))
        if isinstance(values, np.ndarray):
            order = np.argsort(number, kind="stable")
            cuts = np.flatnonzero(np.diff(number[order], prepend=-1))
            if len(cuts):
                self.small[number[order][cuts]] += np.add.reduceat(values[order], cuts, axis=0)
            return
        for j, row in zip(number.tolist(), values, strict=True):
            self.big[j] = [a + b for a, b in zip(self.big.get(j, [0] * len(row)), row, strict=True)]

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """(cluster, place, limb, value); place -1 has the counts."""
        for j in np.flatnonzero(self.counts).tolist():
            yield j, -1, 0, int(self.counts[j])
            big = self.big.get(j, [0] * self.small.shape[1])
            for place, (a, b) in enumerate(zip(self.small[j].tolist(), big, strict=True)):
                for limb, value in enumerate(limbs(a + b)):
                    yield j, place, limb, value


_SUMS = "cluster long, place int, limb int, value long"


def _batches(column: pa.Array) -> np.ndarray:
    """Vectors stored as doubles one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


def _parts(values: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers in parts that `whole` gives one kind of numbers for."""
    small = np.abs(values).max(axis=1) < SMALL / SCALE
    for rows in (np.flatnonzero(small), np.flatnonzero(~small)):
        if len(rows):
            yield rows


def _totals(partial: DataFrame) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """(rows of each cluster, sums by cluster and place). What comes to the driver is bounded by k and the dimension."""
    counts: dict[int, int] = {}
    sums: dict[tuple[int, int], int] = {}
    for r in partial.groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect():
        if r.place < 0:
            counts[r.cluster] = r.value
        else:
            sums[r.cluster, r.place] = sums.get((r.cluster, r.place), 0) + (r.value << (_LIMB * r.limb))
    return counts, sums


def _stored(vectors: DataFrame, size: int) -> DataFrame:
    """The usable vectors as (vec_id, v): doubles one after another, written once and read in every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype="<f8").tobytes()
                step = 8 * size
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[k : k + step] for k in range(0, len(values), step)], pa.binary())], names=["vec_id", "v"])

    values = vectors["embedding"].cast("array<double>")
    kept = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), values.alias("v")).where(usable(F.col("v"), size))
    return materialise(kept.mapInArrow(run, "vec_id long, v binary"), "vectors")


def _first(stored: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes; rows without an id come last, equal ids in the order of their vectors."""
    picked = stored.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    rows = [whole(np.frombuffer(r.v, dtype="<f8")[None, :]) for r in picked]
    return [_listed(r)[0] for r in rows]


def centroid_rounds(stored: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """The centroids after so many rounds of assigning all vectors and taking floors of means; empty ones stay."""

    def partial(held: Centroids):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                values = _batches(batch.column(1))
                sums = sums or Sums(len(held.rows), values.shape[1])
                for rows in _parts(values):
                    x = whole(values[rows])
                    sums.add(held.assign(x), x)
            if sums:
                columns = list(zip(*sums.rows(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "place", "limb", "value"])

        return run

    for _ in range(rounds):
        counts, sums = _totals(stored.mapInArrow(partial(Centroids(centroids)), _SUMS))
        centroids = [[sums[j, p] // counts[j] for p in range(len(row))] if j in counts else row for j, row in enumerate(centroids)]
    return centroids


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64) -> DataFrame:
    """Clusters (vec_id, embedding) around k centroids that start as stored vectors.

    Returns (vec_id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256), one row for each
    vector with `size` components of which none is null, NaN or infinite; all others are left out. distance is squared.
    Repeated rows count each; a null vec_id is clustered, but starts a centroid only where ids do not suffice; with fewer
    than k vectors there are as many centroids; an empty table gives an empty one. A distance or sum beyond 64 bits is null
    (components beyond about 10^6 are needed for that). Further columns are not carried. k and size bound what is broadcast.
    """
    spark = vectors.sparkSession
    stored = _stored(vectors, size)
    start = _first(stored, k, seed)
    held = Centroids(centroid_rounds(stored, start, rounds) if start else [[0] * size])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _batches(batch.column(1))
            number, away = np.empty(len(values), dtype=np.int32), [""] * len(values)
            for rows in _parts(values):
                x = whole(values[rows])
                number[rows] = held.assign(x)
                for r, d in zip(rows.tolist(), held.distances(x, number[rows]), strict=True):
                    away[r] = str(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(away)], names=["vec_id", "cluster", "away"])

    found = materialise(stored.mapInArrow(run, "vec_id long, cluster int, away string"), "assigned")
    distance = F.col("away").try_cast("long")
    sums = found.groupBy("cluster").agg(F.sum(distance.cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"), F.count(distance).alias("known")).collect()
    inside = {r.cluster: int(r.total) if r.n == r.known else None for r in sums}
    total = sum(inside.values()) if None not in inside.values() else None
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    shas = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in held.rows]
    rows = [(j, fits(inside.get(j, 0)), fits(total), sha) for j, sha in enumerate(shas)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", distance.alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")

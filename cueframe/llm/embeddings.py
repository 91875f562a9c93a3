"""Near-duplicate embeddings: sign hashing by random hyperplanes in several tables, exact cosines, components.

Equal vectors are one class. Each class gets one key for each table: the signs of its products with that table's random
hyperplanes. Classes that share a key are compared exactly; a pair counts in the first table in which it meets. Large
buckets are cut into blocks, and each pair of blocks is one small matrix product: its result is a sum for each vector
and a spanning forest, never a list of pairs. The number of hyperplanes follows the number of vectors, so that buckets
stay small, and the number of tables follows from that and the wanted recall at the threshold itself; vectors that are
closer are found with a chance that soon tends to 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, materialise

BLOCK = 256
_REPS = "vec_id long, label string, k1 long, k2 long, vector binary, signs binary"


def shape(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(hyperplanes a table, tables) for n vectors of one label."""
    bits = min(62, max(8, math.ceil(math.log2(max(2, n))) + 1))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _hashed(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for record in batches:
            rows = []
            for vec_id, label, values in zip(*(c.to_pylist() for c in record.columns), strict=True):
                x = None if values is None or label is None or vec_id is None or None in values else np.array(values, dtype=np.float64)
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    rows.append((vec_id, label, None, None, None, None))
                    continue
                d = len(x)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((tables * bits, d))
                x = x + 0.0  # one zero
                scaled = x / np.abs(x).max()
                sign = (planes[d] @ scaled > 0).reshape(tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                k = xxhash.xxh3_128_intdigest(x.tobytes())
                k1, k2 = (v - (1 << 64) if v >= 1 << 63 else v for v in (k & 0xFFFFFFFFFFFFFFFF, k >> 64))
                rows.append((vec_id, label, k1, k2, (scaled / np.linalg.norm(scaled)).tobytes(), sign.astype(np.uint64).tobytes()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["vec_id", "label", "k1", "k2", "vector", "signs"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h = xxhash.xxh3_64_intdigest
    for record in batches:
        ids, tables, keys = [], [], []
        for vec_id, label, vector, signs in zip(*(c.to_pylist() for c in record.columns), strict=True):
            head = f"{label}|{len(vector)}|".encode()
            s = np.frombuffer(signs, dtype=np.uint64)
            ids += [vec_id] * len(s)
            tables += range(len(s))
            keys += [h(head + int(x).to_bytes(8, "little"), seed=t) - (1 << 63) for t, x in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tables, pa.int32()), pa.array(keys, pa.int64())], names=["vec_id", "t", "key"])


def _local_labels(linked: np.ndarray) -> np.ndarray:
    """The first index in each row's component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(threshold: float):
    names = ["vec_id", "other", "n"]

    def block(rows: list[tuple]) -> list[tuple[int, int, int]]:
        t, a, b = rows[0][1], rows[0][2], rows[0][3]
        ids = np.array([r[4] for r in rows])
        x = np.frombuffer(b"".join([r[7] for r in rows]), dtype=np.float64).reshape(len(rows), -1)
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if a != b:  # pairs inside a block are counted in its own group
            mine = np.array([r[5] for r in rows])
            linked &= mine[:, None] != mine[None, :]
        if not linked.any():
            return []
        out = []
        label = _local_labels(linked)
        signs = np.frombuffer(b"".join([r[8] for r in rows]), dtype=np.uint64).reshape(len(rows), -1)
        i, j = np.nonzero(linked)
        first = ~(signs[i, :t] == signs[j, :t]).any(axis=1)
        weight = np.array([r[6] for r in rows])
        n = np.bincount(i[first], weights=weight[j[first]], minlength=len(rows)).astype(np.int64)
        for k in np.flatnonzero((n > 0) | (label != np.arange(len(rows)))):
            out.append((int(ids[k]), int(ids[label[k]]), int(n[k])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for record in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in record.columns), strict=True):
                if group and row[:4] != group[0][:4]:
                    found += block(group) if len(group) > 1 else []
                    group = []
                group.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)
        if len(group) > 1 and (found := block(group)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    return run


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.995, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) over vectors of equal label with cosine >= threshold, in double precision.

    recall: the chance to find a pair exactly at the threshold; higher cosines have higher chances. Null vectors or
    labels, zero vectors and vectors with null or non-finite components link with nothing; so do vectors of different
    lengths. Each input row gives one row; repeated rows are equal vectors and link; where vectors of one vec_id differ,
    each row takes the links and component of its own vector; a null vec_id has null component_id and kept, and no links. Further columns are not carried; an empty table gives an empty one.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding"))
    most = vectors.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape(most, threshold, recall)
    hashed = materialise(vectors.mapInArrow(_hashed(bits, tables, seed), _REPS), "hashed")
    good = hashed.where("k1 is not null")
    # a class is known by its content; its number is unique once the table is written, whatever the vec_ids
    heads = good.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("signs").alias("signs"))
    heads = materialise(heads.withColumn("vec_id", F.monotonically_increasing_id()), "heads")

    keys = heads.select("vec_id", "label", "vector", "signs").mapInArrow(_keys, "vec_id long, t int, key long")
    keys = materialise(keys, "keys")
    sizes = keys.groupBy("key", "t").agg(F.count("*").alias("size")).where("size > 1")
    met = keys.join(sizes, ["key", "t"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = met.withColumn("mine", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).otherwise(0))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("vec_id", "key", "t", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine")
    rows = met.join(heads.select("vec_id", "copies", "vector", "signs"), "vec_id").select("key", "t", "a", "b", "vec_id", "mine", "copies", "vector", "signs")
    found = rows.repartition("key", "t", "a", "b").sortWithinPartitions("key", "t", "a", "b").mapInArrow(_compared(threshold), "vec_id long, other long, n long")
    found = materialise(found, "found")

    label = components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    linked = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    classes = heads.select("label", "k1", "k2", "vec_id", "least", "copies").join(label.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    classes = classes.withColumn("component", F.coalesce("component", "vec_id"))
    least = classes.groupBy("component").agg(F.min("least").alias("name"))
    named = classes.join(linked, "vec_id", "left").join(least, "component")
    named = named.select("label", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "name")
    out = hashed.select("vec_id", "label", "k1", "k2").join(named, ["label", "k1", "k2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("name", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))

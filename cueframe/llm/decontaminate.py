"""Benchmark decontamination by greedy string tiling.

Documents are joined to test items by shared runs of tokens (seeds), as long as the shortest tile: a pair is looked at where
these alone cover so much of the item that tiles could, so none is missed. For each such pair, the longest matches between
item and document are marked again and again, no token twice, until only short ones are left: running Karp-Rabin
compares rolling hashes of a search length that shrinks as matches are used up. The share of the item's tokens that is
marked is its coverage. As tiles may stand in any order, reordered passages are caught.

Items are held by every task, in blocks of bounded size. A benchmark of one block is broadcast; of a larger one, a task reads
block after block from the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import open_store
from .shared import named, new_folder, numbered, place_of, slices, words

LEAST_TILE, COVERAGE = 3, 0.5
#: Bytes of item text that one pass holds; a single longer item is a pass of its own.
BLOCK_BYTES = 8_000_000
#: Bytes of text that a task looks at together, so that a block is read and numbered once for them.
SLICE_BYTES = 32_000_000
_B = np.uint64(0x100000001B3)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _B, dtype=np.uint64)])


def _prefix(tokens: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Sums of (token + 1) * power of its place: the hash of any run is a difference of two, scaled by its place."""
    return np.r_[np.uint64(0), np.cumsum((tokens + 1).astype(np.uint64) * power[: len(tokens)])]


def _windows(prefix: np.ndarray, power: np.ndarray, at: np.ndarray, s: int) -> np.ndarray:
    """Hashes of the runs of s tokens that begin at `at`, alike wherever they stand."""
    return (prefix[at + s] - prefix[at]) * power[len(power) - 1 - at]


def _ends(free: np.ndarray) -> np.ndarray:
    """For each place, where the next marked one is."""
    places = np.where(free, len(free), np.arange(len(free)))
    return np.minimum.accumulate(places[::-1])[::-1]


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of matches that do not overlap, longest first.

    Matches shorter than `least` tokens do not count; ties go to the first place in the item, then in the text. Negative
    tokens match nothing. Empty inputs have no tiles. Each round finds the longest length at which the two still share a
    run of free tokens, by bisection, and marks the runs of that length from left to right; a run in the item is matched
    with the places of the text in their order, so that repetition costs no more than its length.
    """
    n, m = len(item), len(text)
    if min(n, m) < least:
        return []
    power = _powers(max(n, m))
    a, b = _prefix(item, power), _prefix(text, power)
    free_a, free_b = item >= 0, text >= 0
    out: list[tuple[int, int, int]] = []

    def shared(s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of free runs of s tokens that both have, with their hashes."""
        at_a, at_b = (np.flatnonzero(_ends(f)[: len(f) - s + 1] - np.arange(len(f) - s + 1) >= s) for f in (free_a, free_b))
        ha, hb = _windows(a, power, at_a, s), _windows(b, power, at_b, s)
        in_a = np.isin(ha, hb)
        in_b = np.isin(hb, ha[in_a])
        return at_a[in_a], ha[in_a], at_b[in_b], hb[in_b]

    top = min(n, m)
    while top >= least:
        low, high = least - 1, top  # the longest shared run is longer than low - 1 and no longer than high
        while low < high:
            mid = (low + high + 1) // 2
            if len(shared(mid)[0]):
                low = mid
            else:
                high = mid - 1
        if low < least:
            return out
        at_a, ha, at_b, hb = shared(low)
        order = np.argsort(hb, kind="stable")
        hb, at_b = hb[order], at_b[order].tolist()
        next_of: dict[int, int] = {}
        begin, end = np.searchsorted(hb, ha, "left").tolist(), np.searchsorted(hb, ha, "right").tolist()
        used_a = 0
        for i, p, q in zip(at_a.tolist(), begin, end, strict=True):
            if i < used_a:
                continue
            k = next_of.get(p, p)
            while k < q and not free_b[at_b[k] : at_b[k] + low].all():
                k += 1  # marked by now: no later run needs it either
            next_of[p] = k
            if k < q:
                j = at_b[k]
                free_a[i : i + low] = False
                free_b[j : j + low] = False
                out.append((i, j, low))
                used_a = i + low
        top = low
    return out


class Benchmark:
    """One block of test items: their words as numbers, one item after another, and where each run of `least` words, or
    each item that is shorter, stands."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            tokens = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if tokens:
                self.items.append((item_id, np.array(tokens, dtype=np.int64)))
        size = np.array([len(t) for _, t in self.items], dtype=np.int64)
        tokens = np.concatenate([t for _, t in self.items]) if self.items else np.zeros(0, dtype=np.int64)
        self.begin = np.cumsum(size) - size
        self.owner = np.repeat(np.arange(len(size)), size)
        self.size = size
        left = size[self.owner] - (np.arange(len(tokens)) - self.begin[self.owner])
        wanted = np.minimum(size, least)
        self.runs = []  # (length, hashes in order, where each one's places begin and end, the places)
        for k in np.unique(wanted).tolist():
            place = np.flatnonzero((wanted[self.owner] == k) & (left >= k))
            h = _hash(tokens, k)[place]
            order = np.argsort(h, kind="stable")
            hashes, at = np.unique(h[order], return_index=True)
            self.runs.append((k, hashes, np.r_[at, len(order)], place[order]))

    def candidates(self, tokens: np.ndarray, coverage: float) -> list[int]:
        """The items of which a text has the share `coverage` in runs of `least` words, wherever they stand: all that tiles
        of no fewer words can cover so well. tokens: the text's words, 0 for those that no item has."""
        out = []
        unknown = np.r_[0, np.cumsum(tokens == 0)]
        for k, hashes, at, places in self.runs:
            if len(tokens) < k:
                continue
            here = np.flatnonzero(unknown[k:] == unknown[:-k])
            if not len(here):
                continue
            h = _hash(tokens, k)[here]
            row = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            row = np.unique(row[hashes[row] == h])
            if not len(row):
                continue
            n = at[row + 1] - at[row]
            first = np.repeat(at[row] - (np.cumsum(n) - n), n)
            place = np.sort(places[np.arange(int(n.sum())) + first])
            # a run that overlaps the next one covers what is before it
            owner = self.owner[place]
            step = np.r_[np.diff(place), k]
            last = np.r_[owner[1:] != owner[:-1], True]
            covered = np.bincount(owner, weights=np.where(last, k, np.minimum(step, k)))
            some = np.flatnonzero(covered)
            out += some[covered[some] >= coverage * self.size[some]].tolist()
        return sorted(out)


def _hash(tokens: np.ndarray, k: int) -> np.ndarray:
    if len(tokens) < k:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(tokens) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = h * _B + tokens[i : len(tokens) - k + 1 + i].astype(np.uint64)
    return h


def _found(block: Benchmark, text: str | None, least: int, coverage: float) -> list[tuple[int, float, list]]:
    """(item_id, coverage, tiles) of the items that a text covers well enough."""
    w = words(text)
    if not w:
        return []
    tokens = np.fromiter(map(block.vocabulary.get, w, repeat(0)), dtype=np.int64, count=len(w))
    out = []
    for c in block.candidates(tokens, coverage):
        item_id, item = block.items[c]
        found = tiles(item, np.where(tokens == 0, -1, tokens), min(least, len(item)))
        share = sum(k for _, _, k in found) / len(item)
        if share >= coverage:
            out.append((item_id, share, found))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[Callable[[], list[tuple[int, str]]]]:
    """Blocks of about so many bytes of items, to be read in a task. Items of one block are broadcast; more than that stay in
    the shared folder, a file for each block, and neither the driver nor a task holds more than one."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        held = spark.sparkContext.broadcast([tuple(r) for r in items.orderBy("item_id", "text").collect()])
        return [lambda: held.value] if total else []
    n, folder = -(-total // block_bytes), new_folder(spark, "benchmark")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    dealt.repartition("block").sortWithinPartitions("block", "item_id", "text").write.partitionBy("block").parquet(folder)

    def read(uri: str) -> list[tuple[int, str]]:
        store, path = open_store(uri)
        if store.get_file_info(path).type == pafs.FileType.NotFound:
            return []  # no item fell into this block
        found = pq.read_table(path, filesystem=store, columns=["item_id", "text"])
        return sorted(zip(found["item_id"].to_pylist(), found["text"].to_pylist(), strict=True))

    return [partial(read, f"{folder}/block={i}") for i in range(n)]


def _matched(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, matches): a struct of all numbered columns, and the items that it covers.

    One pass for all blocks of items: a task holds the rows of a slice and looks at one block after another.
    """
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(T.ArrayType(T.IntegerType())))]))
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.list_(pa.int32())))]))
    held = _blocks(benchmark, block_bytes)
    rows = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Benchmark(held[0](), least) if len(held) == 1 else None
        for record in slices(batches, 1, SLICE_BYTES):
            texts = record.column(1).to_pylist()
            found: list[list] = [[] for _ in texts]
            for items in held:
                block = only or Benchmark(items(), least)
                for into, t in zip(found, texts, strict=True):
                    into += [{"item_id": i, "coverage": c, "tiles": [[*x] for x in ts]} for i, c, ts in _found(block, t, least, coverage)]
            yield pa.RecordBatch.from_arrays([record.column(0), pa.array(found, arrow)], names=["row", "matches"])

    given = rows.select(F.struct(*rows.columns).alias("row"), F.col(place_of(docs, "text")).cast("string").alias("text"))
    return given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField("matches", kind)]))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All columns of docs and `matches`: the items that each row covers, array<struct<item_id, coverage, tiles>>.

    Options: least, tokens of the shortest tile; coverage, least share of the item's tokens in tiles; block_bytes. An item shorter than these counts as a whole. Null or empty
    texts and items match nothing; repeated rows give repeated results; an item_id with several texts has each of them
    compared. A column of docs named `matches` is replaced. An empty benchmark leaves every row clean.
    """
    columns = [c for c, name in zip(named("row", docs.columns), docs.columns, strict=True) if name.lower() != "matches"]
    return _matched(docs, benchmark, **options).select(*columns, "matches")


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_items, item_ids array<long>, item_id of the best match, coverage, contaminated) for each row of docs."""
    found = contamination(docs.select("doc_id", "text"), benchmark, **options)
    best = F.array_sort("matches", lambda a, b: F.when(a["coverage"] != b["coverage"], F.when(a["coverage"] > b["coverage"], -1).otherwise(1)).when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1).otherwise(0))[0]
    n = F.size("matches")
    has = n > 0
    return found.select("doc_id", n.alias("n_items"), F.sort_array(F.array_distinct(F.coalesce(F.transform("matches", lambda m: m["item_id"]), F.array().cast("array<bigint>")))).alias("item_ids"), F.when(has, best["item_id"]).alias("item_id"), F.when(has, best["coverage"]).otherwise(0.0).alias("coverage"), has.alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that cover no item."""
    return _matched(docs, benchmark, **options).where("size(matches) = 0").select(named("row", docs.columns))

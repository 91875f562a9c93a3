"""N-gram Jaccard join of documents by prefix filters under several global token orders.

Two sets with 100 |x and y| >= T |x or y| share a token among the first |x| - ceil(T |x| / 100) + 1 tokens of each,
under any global order of the tokens. A pair must pass this filter under all of three orders before it is verified:

1. Rare before frequent, then by hash: the document frequencies of all tokens are counted, by 40 bits of their hashes
   (tokens that share these are one place in the order, so none is lost). Tokens that only one document has are never
   looked up, and passages that many documents share come last.
2. and 3. Two orders by different hashes.

Links are wanted for their components, so links inside a component need no second proof. Documents with equal sets are
one class. Each class is first tried against one other: every token leads to the class that has the fewest rarer tokens
than it, and a class tries the one that most of its tokens lead to. Then all pairs that pass the filters and whose
classes are not yet in one component are verified. No pair of different components is left out, and no group is expanded
into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Memo, buckets_for, components, from_planes, materialise, narrow, pack, planes, runs, slices, unpack, words
from .token_counts import _PACKED, _rows

#: A task packs about so many shingles at once.
PACK_SHINGLES = 2_000_000
#: So many heads of classes (32 bytes each) are broadcast at most; beyond, Spark shuffles the join.
BROADCAST_HEADS = 250_000
#: So many sets of one token and size meet in one task; where there are more, they are dealt over tasks.
MEET = 1_000
#: Bits of a token by which it is counted and looked up; beside them, a batch's document takes 16.
BITS = 40
_DOC = np.uint64(16)
_K = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x + np.uint64(salt * int(_K) % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes() -> Memo:
    return Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))


def shingle_set(text: str | None, size: int, hashes: Memo) -> np.ndarray:
    """Sorted hashes of the distinct shingles; the whole sequence where there are fewer words; none without words."""
    w = words(text)
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), dtype=np.uint64, count=len(w))
    n = min(size, len(w))
    s = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        s = s * _K + h[k : len(w) - n + 1 + k]
    return np.unique(mix(s))


def prefix_length(n: np.ndarray | int, percent: int):
    return n - -(-percent * n // 100) + (n > 0)


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, in two columns."""
    return np.array([[d & 0xFFFFFFFFFFFFFFFF, d >> 64] for d in (xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets)], dtype=np.uint64).reshape(-1, 2)


def _pack_sets(size: int, percent: int, buckets: int):
    def flush(batch: int, ids: list, null: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], dtype=np.int64)
        keys = set_keys(sets)
        # sorted by token, which is by bucket as well
        key = np.sort((np.concatenate(sets) >> np.uint64(64 - BITS)) << _DOC | np.repeat(np.arange(len(sets), dtype=np.uint64), n))
        token, doc = key >> _DOC, (key & np.uint64((1 << 16) - 1)).astype(np.uint16)
        at = runs(token)
        count, token = narrow(np.diff(np.r_[at, len(doc)])), token[at]
        # only the buckets that this batch meets are named, so its work does not follow their number
        bucket = token * np.uint64(buckets) >> np.uint64(BITS)
        cut = runs(bucket)
        ends = np.r_[cut, len(token)]
        rows = [(-batch - 1, batch, True, pack(np.array(ids, dtype=np.int64), np.array(null, dtype=np.uint8), n, keys[:, 0].copy(), keys[:, 1].copy(), planes(bucket[cut]), narrow(np.diff(ends)), count, doc))]
        for b, i, j in zip(bucket[cut].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            rows.append((b, batch, False, pack(planes(token[i:j]), count[i:j])))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, null, sets, total, hashes = [], [], [], 0, word_hashes()
        for record in slices(batches, 1, 4_000_000):
            for doc_id, text in zip(record.column(0).to_pylist(), record.column(1).to_pylist(), strict=True):
                ids.append(doc_id or 0)
                null.append(doc_id is None)
                sets.append(shingle_set(text, size, hashes))
                total += len(sets[-1])
                if total > PACK_SHINGLES or len(sets) >= 60_000:
                    yield flush(part << 24 | seq, ids, null, sets)
                    ids, null, sets, total, seq = [], [], [], 0, seq + 1
        if sets:
            yield flush(part << 24 | seq, ids, null, sets)

    return run


def rarity(df: np.ndarray) -> np.ndarray:
    """A document frequency as one byte, rising with it; 0 for 1."""
    return np.minimum(df - 1, 15 + np.rint(16 * np.log2(np.maximum(df, 16) / 16)).clip(0, 240)).astype(np.uint8)


def _frequencies(table: pa.Table) -> pa.Table:
    """For one bucket: how frequent each token is, back to the batches that have it, with the tokens of 2 or more."""
    if table.column("head")[0].as_py():
        return table.select(["key", "batch", "head", "block"])
    bucket = np.array([table.column("key")[0].as_py()], dtype=np.int64)
    parts = [unpack(b) for b in table.column("block").to_pylist()]
    tokens = [from_planes(p[0]) for p in parts]
    distinct, where = np.unique(np.concatenate(tokens), return_inverse=True)
    rare = rarity(np.bincount(where, weights=np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(distinct)))[where]
    rows, at = [], 0
    for batch, token in zip(table.column("batch").to_pylist(), tokens, strict=True):
        mine = rare[at : at + len(token)]
        at += len(token)
        if mine.any():
            rows.append((-batch - 1, batch, False, pack(bucket, mine, planes(token[mine > 0]))))
    return pa.Table.from_batches([_rows(rows)]) if rows else table.select(["key", "batch", "head", "block"]).slice(0, 0)


def _prefixes(percent: int):
    """For one batch of documents: the first tokens of each in the first order that other documents have as well."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        heads = table.column("head").to_pylist()
        ids, null, n, k1, k2, met, of, count, doc = unpack(blocks[heads.index(True)])
        met = from_planes(met)
        token, rare = np.zeros(len(count), dtype=np.uint64), np.zeros(len(count), dtype=np.uint8)
        starts = np.r_[0, np.cumsum(of.astype(np.int64))]
        for is_head, block in zip(heads, blocks, strict=True):
            if not is_head:
                (bucket,), mine, coded = unpack(block)
                at = int(np.searchsorted(met, np.uint64(bucket)))
                i, j = starts[at], starts[at + 1]
                rare[i:j] = mine
                token[i:j][mine > 0] = from_planes(coded)
        shared = np.flatnonzero(rare)
        key = np.repeat(rare[shared].astype(np.uint64) << np.uint64(BITS) | token[shared], count[shared])
        key = np.sort(doc[np.repeat(rare > 0, count)].astype(np.uint64) << np.uint64(48) | key)
        doc = (key >> np.uint64(48)).astype(np.int64)
        have = np.bincount(doc, minlength=len(n))
        first = np.zeros(len(key), dtype=np.int64)  # equal tokens of a document stand in one place
        first[runs(key)] = runs(key)
        place = np.maximum.accumulate(first) - np.r_[0, np.cumsum(have)[:-1]][doc]  # among those that others have
        keep = np.flatnonzero((n - have)[doc] + place < prefix_length(n, percent)[doc])
        keep = keep[np.isin(keep, runs(key))]
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(doc[keep], minlength=len(n)))].astype(np.int32))
        tokens = pa.array((key[keep] & np.uint64((1 << BITS) - 1)).astype(np.int64))
        return pa.table({
            "doc_id": pa.array(ids, mask=null.astype(bool)), "n": n, "m": have, "k1": k1.view(np.int64), "k2": k2.view(np.int64),
            "tokens": pa.ListArray.from_arrays(ends, tokens), "places": pa.ListArray.from_arrays(ends, pa.array(place[keep].astype(np.int32))),
        })

    return run


_SETS = "doc_id long, k1 long, k2 long, full binary, second binary, third binary"


def _sets(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for record in slices(batches, 1, 4_000_000):
            found = [shingle_set(t, size, hashes) for t in record.column(1).to_pylist()]
            out = [[s.tobytes() for s in found]]
            for salt in (2, 3):  # a filter may be loose: 32 bits of a token do
                out.append([np.sort(np.sort(mix(s, salt))[: prefix_length(len(s), percent)] >> np.uint64(32)).astype(np.uint32).tobytes() for s in found])
            keys = set_keys(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([record.column(0), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), *(pa.array(x, pa.binary()) for x in out)], names=["doc_id", "k1", "k2", "full", "second", "third"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _room(n: str, m: str, place: str, n_b: str, m_b: str, place_b: str, percent: int) -> Column:
    """Whether two sets can have enough in common where they meet first: of n tokens, m are in other documents too, and
    the common one stands at `place` of these. All pairs that link pass this at the first token that they share, as all
    others that they share stand behind it in both."""
    return F.expr(f"least({m} - {place}, {m_b} - {place_b}) >= {percent} * ({n} + {n_b}) / {100 + percent}")


def _meeting(each: DataFrame, other: DataFrame) -> DataFrame:
    """each joined to other by token and step. Where a token and step have over MEET rows of other, the rows of each are
    dealt into parts by their document, and those of other go to every part: each pair still meets once."""
    many = other.groupBy("token", "step").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > MEET)
    many = materialise(many.select("token", "step", F.ceil(F.col("n_rows") / MEET).cast("int").alias("parts")), "hot")
    many = F.broadcast(many) if many.count() <= BROADCAST_HEADS else many
    parts = F.coalesce("parts", F.lit(1))
    dealt = each.join(many, ["token", "step"], "left").withColumn("part", F.pmod(F.xxhash64("d"), parts).cast("int")).drop("parts")
    copied = other.join(many, ["token", "step"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copied, ["token", "step", "part"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that pass the second and third order and then the exact test."""

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            rows = zip(*(r.column(c).to_pylist() for c in ("second", "second_b", "third", "third_b")), strict=True)
            keep = [all(_common(np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)) for x, y in ((p, q), (s, t))) for p, q, s, t in rows]
            yield r.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            keep = []
            for x, y in zip(r.column("full").to_pylist(), r.column("full_b").to_pylist(), strict=True):
                n = _common(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64))
                keep.append(100 * n >= percent * (len(x) // 8 + len(y) // 8 - n))
            yield r.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def both(left: DataFrame, *columns: str) -> DataFrame:
        one = sets.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
        return left.join(one, "b").join(sets.select(F.col("id").alias("a"), *columns), "a")

    passed = both(pairs, "second", "third").mapInArrow(filtered, "a long, b long")
    return both(passed, "full").mapInArrow(exact, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when 100 * common >= percent * all shingles of both.

    Each input row gives one row. A null or empty text, or one without words, has no shingles and links with nothing.
    A null doc_id gives a row with null component_id and takes no part. Rows that share a doc_id and text are harmless;
    where texts of one doc_id differ, each row takes the component of its own text. Further columns are not carried; an
    empty table gives an empty one. component_id is the smallest doc_id reachable by links, itself included.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = docs.mapInArrow(_pack_sets(size, percent, buckets_for(docs, "text")), _PACKED)
    counted = packed.groupBy("key").applyInArrow(_frequencies, _PACKED)
    listed = counted.groupBy("key").applyInArrow(_prefixes(percent), "doc_id long, n long, m long, k1 long, k2 long, tokens array<long>, places array<int>")
    listed = materialise(listed, "prefixes")

    # a class of equal sets is known by its content; its number is unique once the table is written, whatever the ids
    classes = listed.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("tokens").alias("tokens"), F.first("places").alias("places"))
    classes = materialise(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    index = classes.where("size(tokens) > 0").select(F.col("class_id").alias("d"), "n", "m", F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    index = index.select("d", "n", "m", F.col("t.tokens").alias("token"), F.col("t.places").alias("place")).distinct()
    # a token leads to the document that has the fewest rarer ones, of a group of edited copies to the original
    leaders = index.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("m") + F.col("place")).alias("rank"), "d", "n", "m", "place")).alias("lead"), F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    leaders = leaders.select("token", F.col("lead.d").alias("leader"), F.col("lead.n").alias("leader_n"), F.col("lead.m").alias("leader_m"), F.col("lead.place").alias("leader_place"))
    index = materialise(index.join(leaders, "token"), "index")

    # first round: one candidate for each class
    close = _room("n", "m", "place", "leader_n", "leader_m", "leader_place", percent)
    votes = index.where("d <> leader").where(close).groupBy("d", "leader").agg(F.count("*").alias("votes"))
    first = votes.groupBy(F.col("d").alias("b")).agg(F.max_by("leader", F.struct("votes", -F.col("leader"))).alias("a"))
    first = materialise(first.select("a", "b"), "pairs")
    heads = classes.select("class_id", "k1", "k2", F.col("least").alias("doc_id")).join(index.select(F.col("d").alias("class_id")).distinct(), "class_id", "left_semi")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads
    texts = docs.join(heads.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(size, percent), _SETS)
    sets = texts.join(heads, ["doc_id", "k1", "k2"]).select(F.col("class_id").alias("id"), "full", "second", "third")
    sets = materialise(sets, "sets")
    if sets.count() > sets.select("id").distinct().count():  # rows that repeat a doc_id and its text
        sets = materialise(sets.dropDuplicates(["id"]), "sets")
    links = materialise(_verified(first, sets, percent), "links")

    # second round: pairs of different components
    label = components(links)
    labelled = index.select("token", "d", "n", "m", "place").join(label.withColumnRenamed("id", "d"), "d", "left").withColumn("c", F.coalesce("component", "d")).drop("component")
    mixed = labelled.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
    labelled = materialise(labelled.join(mixed, "token"), "labelled")
    # linked sets differ in size by less than one class of sizes, so a frequent token's sets meet by class only
    step = F.floor(F.round(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)), 6)).cast("int")
    labelled = labelled.withColumn("step", step)
    other = labelled.select("token", "step", *(F.col(x).alias(f"{x}_b") for x in ("d", "n", "m", "place", "c")))
    each = labelled.withColumn("step", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    once = "c <> c_b and (n < n_b or n = n_b and d < d_b)"
    pairs = _meeting(each, other).where(once).where(_room("n", "m", "place", "n_b", "m_b", "place_b", percent))
    pairs = pairs.select(F.least("d", "d_b").alias("a"), F.greatest("d", "d_b").alias("b")).distinct().join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = materialise(_verified(pairs, sets, percent), "links")

    label = components(links.union(more))
    named = classes.select("k1", "k2", "least", "class_id").join(label.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", "component_id")
    out = listed.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))

"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

A round puts the pieces that wait and the gaps that are open (what is free at a sequence's end) into one order by size,
the largest first, as a range-sorted table. Each task sweeps its range: gaps go onto a stack, a piece takes the top, the
smallest gap that holds it (its successor in the order), and what is left of a gap takes its place in the order again while
it lies in the range. Tasks report how many pieces found no gap and how many gaps stayed; the driver pairs these counts,
two numbers a task, with the same stack rule, so pieces of one range meet gaps of an earlier one by rank and no two pieces
claim one place. Gaps are updated, and the next round begins with a new order. New sequences are opened only where the
tokens that wait exceed the open room, or where pieces are larger than every gap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder, chunk_texts, encoder
from .shared import Ids, materialise, new_folder, slices

#: A task encodes the distinct words of about so many bytes at once.
BATCH_BYTES = 12_000_000
#: A range of a round's order has about so many rows.
RANGE_ROWS = 1_000_000
_PLACED, _WAITS, _STAYS, _LATER, _SUMMARY = range(5)
_SWEPT = "kind int, part int, rank long, size int, id long, seq long, offset int"


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after another."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return values[np.arange(total) + np.repeat(start - (ends - size), size)]


def text_ids(enc: Encoder, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, each with end_id behind it, and how many each has."""
    chunks, number, sizes = chunk_texts(texts)
    words, per_chunk = enc.split_all(chunks)
    distinct = Ids()
    place = np.array(list(map(distinct.__getitem__, words)), dtype=np.int64)
    ids, per_word = enc.encode_all(list(distinct))
    del chunks, words, distinct
    begin = np.cumsum(per_word) - per_word
    of_chunks = ragged(ids, begin[place], per_word[place])
    upto = np.r_[0, np.cumsum(per_word[place])]
    edge = np.r_[0, np.cumsum(per_chunk)]
    chunk_start, chunk_size = upto[edge[:-1]], upto[edge[1:]] - upto[edge[:-1]]
    found = ragged(of_chunks, chunk_start[number], chunk_size[number])
    upto = np.r_[0, np.cumsum(chunk_size[number])]
    edge = np.r_[0, np.cumsum(sizes)]
    counts = upto[edge[1:]] - upto[edge[:-1]]
    return np.insert(found, np.cumsum(counts), end_id), counts + 1


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each text's ids with end_id behind them, cut only where they exceed the capacity.

    (row, doc_id, piece, start, length, ids_crc32), and ids (little-endian unsigned 32-bit) if wanted; row numbers the
    pieces of all documents without gaps of meaning: it is unique, no more. A null or empty text gives end_id alone. For
    word vocabularies, whose texts can be taken apart at spaces.
    """
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(path), TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1, BATCH_BYTES):
            ids, counts = text_ids(enc, batch.column(1).to_pylist(), end_id)
            data = memoryview(ids.astype("<u4").tobytes())
            pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, counts[owner] - start)
            at = 4 * ((np.cumsum(counts) - counts)[owner] + start)
            parts = [data[a : a + n] for a, n in zip(at.tolist(), (4 * length).tolist(), strict=True)]
            columns = [np.arange(row, row + len(owner)), batch.column(0).take(pa.array(owner)), piece, start, length, np.fromiter(map(zlib.crc32, parts), dtype=np.int64, count=len(parts))]
            columns += [list(map(bytes, parts))] * with_ids
            row += len(owner)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def sweep(size: np.ndarray, waits: np.ndarray, ids: np.ndarray, capacity: int) -> tuple[list, list, list, list]:
    """One range in order, the largest first and gaps before pieces of their size: what was placed (id, seq, offset),
    pieces that found no gap (size, ids), gaps that stayed from the largest on, and what is left of gaps below the range.
    Rows of one size are handled together."""
    placed, left, below = [], [], []
    stack: list[tuple[int, np.ndarray]] = []  # (size, sequences), the smallest on top
    lowest = int(size[-1])
    fresh: dict[int, list[np.ndarray]] = {}  # what is left of gaps, by size, until the sweep comes to it
    edges = np.flatnonzero(np.r_[True, (size[1:] != size[:-1]) | (waits[1:] != waits[:-1]), True])
    blocks = {(int(size[a]), bool(waits[a])): ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)}
    for s in range(int(size[0]), lowest - 1, -1):
        for seqs in ([blocks[s, False]] if (s, False) in blocks else []) + fresh.pop(s, []):
            stack.append((s, seqs))
        rows = blocks.get((s, True))
        while rows is not None and len(rows) and stack:
            gap, seqs = stack.pop()
            most = gap // s
            used = min(len(seqs), -(-len(rows) // most))
            if used < len(seqs):
                stack.append((gap, seqs[used:]))
            taken = rows[: used * most]
            rows = rows[used * most :]
            k = np.arange(len(taken))
            placed.append((taken, seqs[k // most], capacity - gap + k % most * s))
            whole = len(taken) // most
            for n, some in ((most, seqs[:whole]), (len(taken) % most, seqs[whole:used])):
                rest = gap - n * s
                if not len(some) or not rest:
                    continue
                if rest >= s:
                    stack.append((rest, some))
                elif rest >= lowest:
                    fresh.setdefault(rest, []).append(some)
                else:
                    below.append((rest, some))
        if rows is not None and len(rows):
            left.append((s, rows))
    return placed, left, stack, below


def _swept(capacity: int):
    names = [c.split()[0] for c in _SWEPT.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def batch(kind: int, *columns) -> pa.RecordBatch:
        n = max(len(c) for c in columns if c is not None)
        part = TaskContext.get().partitionId()
        filled = [np.full(n, kind), np.full(n, part), *(np.zeros(n, dtype=np.int64) if c is None else c for c in columns)]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), t) for c, t in zip(filled, kinds, strict=True)], names=names)

    def flat(blocks: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.array([s for s, _ in blocks]), [len(x) for _, x in blocks]), np.concatenate([x for _, x in blocks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        size, waits, ids = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in rows]) for k in range(3))
        placed, left, stack, below = sweep(size, waits, ids, capacity)
        for taken, seqs, offset in placed:
            yield batch(_PLACED, None, None, taken, seqs, offset)
        summary = []
        for kind, blocks in ((_WAITS, left), (_STAYS, stack[::-1]), (_LATER, below)):  # gaps: the smallest first
            if blocks:
                sizes, found = flat(blocks)
                yield batch(kind, np.arange(len(found)), sizes, found, None, None)
                if kind != _LATER:
                    summary.append((kind, len(found), int(sizes[0])))  # the largest piece, the smallest gap
        if summary:
            # rank: which kind, id: how many rows
            kind, n, s = map(np.array, zip(*summary, strict=True))
            yield batch(_SUMMARY, kind, s, n, None, None)

    return run


def flows(summary: list[tuple[int, int, int, int]], fresh: int, capacity: int) -> tuple[list[tuple], dict[int, int], dict[int, int], int]:
    """Pairs the pieces without a gap of each range with gaps of earlier ranges, the nearest ones first, then with new
    sequences: (part, rank of the first piece, behind the last, part of the gaps or -1 for new ones, rank of the first
    gap, pieces a gap takes); with how many pieces and gaps of each range, and how many new sequences, are used.

    summary: (part, kind, rows, largest piece or smallest gap).
    """
    found, pieces, gaps = [], {}, {}
    stack = [[-1, 0, fresh, capacity]]
    # in a range, pieces that found no gap come before the gaps that stayed
    for part, kind, n, size in sorted(summary):
        if kind == _STAYS:
            stack.append([part, 0, n, size])
            continue
        done = 0
        while done < n and stack:
            top = stack[-1]
            if not top[2]:
                stack.pop()
                continue
            most = top[3] // size
            used = min(top[2], -(-(n - done) // most))
            to = min(n, done + used * most)
            found.append((part, done, to, top[0], top[1], most))
            top[1] += used
            top[2] -= used
            gaps[top[0]] = top[1]
            done = to
        pieces[part] = done
    return found, pieces, gaps, gaps.pop(-1, 0)


def to_open(pieces: dict[int, int], gaps: dict[int, int], capacity: int) -> int:
    """How many new sequences a round opens: as many as the tokens that wait exceed the room of gaps that hold any piece,
    and as many as the largest pieces that fit no gap need. Both are no more than any packing that keeps what is placed
    needs. Pieces and gaps: how many of each size."""
    least, largest = min(pieces), max(pieces)
    room = sum(g * n for g, n in gaps.items() if g >= least)
    wanted = -(-(sum(s * n for s, n in pieces.items()) - room) // capacity)
    most = capacity // largest
    homeless = sum(n for s, n in pieces.items() if s * (most + 1) > capacity and s > max(gaps, default=0))
    return max(0, wanted, -(-homeless // most))


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """Packs (row, size) into sequences: (row, sequence_id, offset).

    row is unique and not negative; 1 <= size <= capacity. Each sequence is filled from 0 without gaps. Rows that fill a
    sequence have one of their own; new sequences are numbered below zero.
    """
    spark = items.sparkSession
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "packing")
    full = items.where(F.col("size") == capacity).select("row", F.col("row").alias("sequence_id"), F.lit(0).alias("offset"))
    waiting = items.where(F.col("size") < capacity).select(F.col("size").cast("int").alias("size"), F.col("row").alias("id"))
    gaps = waiting.limit(0)
    opened, step = 0, 0
    while True:
        both = waiting.select("size", F.lit(True).alias("waits"), "id").union(gaps.select("size", F.lit(False).alias("waits"), "id"))
        counts = both.groupBy("size", "waits").count().collect()  # at most two rows for each size
        sizes, room = ({r["size"]: r["count"] for r in counts if r.waits == waits} for waits in (True, False))
        if not sizes:
            break
        fresh = to_open(sizes, room, capacity)
        order = (F.col("size").desc(), F.col("waits"), F.col("id"))
        ranges = max(session, -(-sum(r["count"] for r in counts) // RANGE_ROWS))
        usable = both.where(F.col("waits") | (F.col("size") >= min(sizes)))
        usable.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_swept(capacity), _SWEPT).write.parquet(f"{folder}/swept/round={step}")
        swept = spark.read.schema(_SWEPT).parquet(f"{folder}/swept/round={step}")
        summary = [(r.part, r["rank"], r.id, r["size"]) for r in swept.where(F.col("kind") == _SUMMARY).collect()]
        found, pieces, used, new = flows(summary, fresh, capacity)
        # both tables have a few rows for each range
        pairs = F.broadcast(spark.createDataFrame(found or [(-1, 0, 0, -1, 0, 1)], "part int, a long, b long, gap_part int, gap_rank long, most int"))
        done = F.broadcast(spark.createDataFrame([(p, pieces.get(p, 0), used.get(p, 0)) for p in {s[0] for s in summary}] or [(-1, 0, 0)], "part int, pieces long, gaps long"))
        moved = swept.where(F.col("kind") == _WAITS).join(pairs, "part").where("rank >= a and rank < b")
        moved = moved.select(F.col("id").alias("row"), F.col("size").alias("length"), "gap_part", (F.col("gap_rank") + F.expr("(rank - a) div most")).alias("gap_rank"), F.col("rank").alias("turn"), F.col("part").alias("from_part"))
        stayed = swept.where(F.col("kind") == _STAYS).join(done, "part")
        taken = stayed.where("rank < gaps").select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), F.col("id").alias("seq"), "size")
        new_ones = F.col("gap_part") == -1
        met = moved.join(taken, ["gap_part", "gap_rank"], "left").withColumn("seq", F.when(new_ones, -1 - opened - F.col("gap_rank")).otherwise(F.col("seq"))).withColumn("size", F.when(new_ones, capacity).otherwise(F.col("size")))
        inside = Window.partitionBy("gap_part", "gap_rank").orderBy("from_part", "turn")  # never more rows than the capacity has tokens
        met = met.withColumn("upto", F.sum("length").over(inside)).withColumn("last", F.lead("row").over(inside).isNull())
        met = met.select("row", "seq", (capacity - F.col("size") + F.col("upto") - F.col("length")).cast("int").alias("offset"), F.when(F.col("last"), F.col("size") - F.col("upto")).cast("int").alias("rest"))
        met.write.parquet(f"{folder}/met/round={step}")
        met = spark.read.schema("row long, seq long, offset int, rest int").parquet(f"{folder}/met/round={step}")
        opened += new
        waiting = swept.where(F.col("kind") == _WAITS).join(done, "part").where("rank >= pieces").select("size", "id")
        rests = [stayed.where("rank >= gaps").select("size", "id"), swept.where(F.col("kind") == _LATER).select("size", "id"), met.where("rest > 0").select(F.col("rest").alias("size"), F.col("seq").alias("id"))]
        gaps = reduce(DataFrame.union, rests)
        step += 1
    if not step:
        return full
    swept = spark.read.schema(_SWEPT + ", round int").parquet(f"{folder}/swept").where(F.col("kind") == _PLACED).select(F.col("id").alias("row"), F.col("seq").alias("sequence_id"), "offset")
    met = spark.read.schema("row long, seq long, offset int, rest int, round int").parquet(f"{folder}/met").select("row", F.col("seq").alias("sequence_id"), "offset")
    return full.union(swept).union(met)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs all documents into few sequences of at most `capacity` tokens.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece. A document's ids are
    followed by end_id; only those longer than the capacity are cut. A null or empty text is end_id alone; a null doc_id
    stays null; repeated rows are packed each; an empty table gives an empty one; further columns are not carried.
    """
    pieces = materialise(token_pieces(docs, path, capacity, end_id), "pieces")
    placed = best_fit(pieces.select("row", F.col("length").alias("size")), capacity)
    return pieces.join(placed, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


def packed_sequences(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The sequences themselves: (sequence_id, n_tokens, ids array<int>, pieces array<struct<offset, length, doc_id,
    piece>>), the pieces in their order. A sequence is one row, so no more than the capacity meets in a group."""
    pieces = materialise(token_pieces(docs, path, capacity, end_id, with_ids=True), "pieces")
    placed = best_fit(pieces.select("row", F.col("length").alias("size")), capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(p["ids"], dtype="<u4") for p in row]).astype(np.int32) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    one = F.struct("offset", "length", "doc_id", "piece", "ids")
    groups = pieces.join(placed, "row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("pieces"))
    listed = materialise(groups, "sequences")
    ids = listed.select("sequence_id", "pieces").mapInArrow(run, "sequence_id long, ids array<int>")
    kept = listed.select("sequence_id", F.transform("pieces", lambda p: p.dropFields("ids")).alias("pieces"))
    return kept.join(ids, "sequence_id").select("sequence_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "pieces")

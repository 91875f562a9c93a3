"""Token counts: pieces are counted once for each distinct pre-token and joined to the documents' pre-token frequencies.

Three steps. A task packs some documents into one row for each bucket of pre-tokens: the distinct pre-tokens, and for
each the documents that have it and how often. By bucket, each distinct pre-token is encoded once and its number of
pieces is joined to those frequencies, which leaves one partial sum for each document. By batch, the sums are added.
No list of ids is ever built. A pre-token that very many documents of a batch share is dealt by batch as well, so that
no bucket gathers the documents of a frequent word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunk_texts, encoder
from .shared import Ids, buckets_for, from_planes, hash_words, narrow, pack, planes, runs, slices, unpack

#: A task packs documents of about so many bytes at once.
PACK_CHARS = 10_000_000
_PACKED = "key long, batch long, head boolean, block binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    key, batch, head, block = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(batch, pa.int64()), pa.array(head, pa.bool_()), pa.array(block, pa.binary())], names=["key", "batch", "head", "block"])


def pack_documents(path: str, buckets: int):
    """For mapInArrow over (doc_id, text): documents packed by bucket of pre-token, and a head row for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        part = TaskContext.get().partitionId()
        for seq, record in enumerate(slices(batches, 1, PACK_CHARS)):
            batch = part << 24 | seq
            doc_ids, texts = record.column(0), record.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            null = pc.is_null(doc_ids).to_numpy(zero_copy_only=False).astype(np.uint8)
            rows = [(-batch - 1, batch, True, pack(pc.fill_null(doc_ids, 0).to_numpy().astype(np.int64), n_bytes, null))]
            chunks, number, sizes = chunk_texts(texts.to_pylist())
            pre, per_chunk = enc.split_all(chunks)
            ids = Ids()
            token_of = np.array(list(map(ids.__getitem__, pre)), dtype=np.int64)
            distinct = list(ids)
            del chunks, pre, ids
            begin = np.r_[0, np.cumsum(per_chunk)[:-1]] if len(per_chunk) else per_chunk
            counts = per_chunk[number]
            tokens = token_of[np.repeat(begin[number] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())] if len(number) else token_of[:0]
            if len(tokens):
                doc = np.repeat(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes), counts)
                key, freq = np.unique(tokens << 32 | doc, return_counts=True)
                token, doc = key >> 32, key & 0xFFFFFFFF
                shared_by = np.bincount(token, minlength=len(distinct))
                hashes = hash_words(distinct)
                spread = np.uint64((batch + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                mixed = np.where(shared_by * 16 > len(sizes), hashes ^ spread, hashes)
                bucket = ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                starts = np.r_[0, np.cumsum(shared_by)]
                for at, to in zip(*(lambda r: (r, np.r_[r[1:], len(order)]))(runs(bucket[order])), strict=True):
                    mine = order[at:to]
                    counts = shared_by[mine]
                    pick = np.repeat(starts[mine] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
                    text = " ".join([distinct[i] for i in mine]).encode("utf-8", "surrogatepass")
                    rows.append((int(bucket[mine[0]]), batch, False, pack(text, narrow(counts), narrow(doc[pick]), narrow(freq[pick]), np.array([len(sizes)], dtype=np.int64))))
            yield _rows(rows)

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of each text under a word vocabulary that drops white space: (doc_id, n_bytes, n_tokens, over_limit).

    A null or empty text has no bytes and no tokens. Each input row gives one row, repeated or null doc_ids included;
    an empty table gives an empty one. Further columns are not carried. limit: over_limit is n_tokens > limit.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a bucket come one after another: its pre-tokens are counted once, in the order they come
        enc, known, bucket = encoder(path), {}, None
        for record in batches:
            for key, batch, head, block in zip(*(c.to_pylist() for c in record.columns), strict=True):
                if head:
                    yield _rows([(key, batch, True, block)])
                    continue
                if key != bucket:
                    known, bucket = {}, key
                text, counts, doc, freq, n_docs = unpack(block)
                pre = text.tobytes().decode("utf-8", "surrogatepass").split(" ")
                new = [w for w in pre if w not in known]
                known.update(zip(new, enc.encode_all(new)[1].tolist(), strict=True))
                pieces = np.fromiter(map(known.__getitem__, pre), dtype=np.int64, count=len(counts))
                sums = np.bincount(doc, weights=np.repeat(pieces, counts) * freq.astype(np.float64), minlength=int(n_docs[0])).astype(np.int64)
                some = np.flatnonzero(sums)
                # once buckets outnumber the words of a document, few documents have a sum here
                rest = (narrow(sums),) if 2 * len(some) > len(sums) else (planes(some), narrow(sums[some]))
                yield _rows([(-batch - 1, batch, False, pack(*rest))])

    def add(table: pa.Table) -> pa.Table:
        head, sums = None, []
        for is_head, block in zip(table.column("head").to_pylist(), table.column("block").to_pylist(), strict=True):
            if is_head:
                head = unpack(block)
            else:
                sums.append(unpack(block))
        ids, n_bytes, null = head
        n = np.zeros(len(ids), dtype=np.int64)
        for x in sums:
            if len(x) == 1:
                n += x[0].astype(np.int64)
            else:
                n[from_planes(x[0]).astype(np.int64)] += x[1].astype(np.int64)
        return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "n_bytes": n_bytes, "n_tokens": n, "over_limit": n > limit})

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack_documents(path, buckets_for(docs, "text")), _PACKED)
    sums = packed.repartition("key").sortWithinPartitions("key").mapInArrow(count, _PACKED)
    return sums.groupBy("key").applyInArrow(add, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Token ids in length-delimited binary files, with an offset index beside them.

Each record is framed as: length (8 bytes, little-endian), masked checksum of the length (4), the payload, masked
checksum of the payload (4). The checksum is CRC-32 as zlib has it, rotated right by 15 bits plus a constant, so that
data that itself holds checksums stays safe. The payload is the document's id (8 bytes), one byte with the width of a token
id (2 where the vocabulary allows it, else 4; 128 more where the document has no id) and the token ids. The index holds
each record's offset, for shuffled reads. One shard for each range of document ids; a task writes under a name of its own
attempt, and only names that the written manifest lists count.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BYTE_CHARS, encoder
from .shared import materialise, new_folder, slices

_MASK = 0xA282EAD8
_MANIFEST = "shard int, path string, first_id long, n_records long, n_ids long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(read, what: str) -> bytes:
    """The payload of the record that read(n) stands before; raises ValueError where a checksum does not fit."""
    head = read(12)
    if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError(f"damaged length in {what}")
    size = struct.unpack("<Q", head[:8])[0]
    body = read(size + 4)
    if len(body) < size + 4 or masked_crc(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError(f"damaged payload in {what}")
    return body[:size]


_NULL = 128


def _record(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack("<qB", payload[:9])
    return None if width & _NULL else doc_id, np.frombuffer(payload, dtype=f"<u{width & ~_NULL}", offset=9)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a file that all executors reach."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


#: Fixed: the split of byte-level vocabularies, as tiktoken takes it.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of white space so long are taken out before the split, which would go back over them sign by sign.
_LONG_SPACE = regex.compile(r"\p{White_Space}{1000,}")


class ByteIds:
    """Encodes texts to little-endian ids; special strings in a text give their own id.

    tiktoken runs the merges of the vocabulary file, as it does several times as fast; the tests hold its ids against the
    tokenizers library's. A long run of white space is a pre-token by itself, but for its last sign where text follows, so
    it is encoded apart from what stands around it.
    """

    def __init__(self, path: str):
        enc = encoder(path)
        back = {c: b for b, c in BYTE_CHARS.items()}
        ranks = {bytes(map(back.__getitem__, token)): i for token, i in enc.vocab.items() if token not in enc.specials}
        self.bpe = tiktoken.Encoding("records", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special, self.specials = enc.special, enc.specials
        self.kind = np.dtype("<u2" if max([*ranks.values(), *self.specials.values()]) < 1 << 16 else "<u4")

    def __call__(self, text: str) -> bytes:
        code = "H" if self.kind.itemsize == 2 else "I"
        if any(s in text for s in self.specials):
            parts = self.special.split(text)
            ids = [i for k, part in enumerate(parts) for i in ([self.specials[part]] if k % 2 else self._plain(part))]
        else:
            ids = self._plain(text)
        return array(code, ids).tobytes()

    def _plain(self, text: str) -> list[int]:
        if len(text) < 1000:
            return self.bpe.encode_ordinary(text) if text else []
        ids, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            ids += self.bpe.encode_ordinary(text[at : run.start()])
            at = run.end() - (run.end() < len(text))
            ids += self.bpe._encode_single_piece(text[run.start() : at])
        return ids + self.bpe.encode_ordinary(text[at:])


_BYTE_IDS: dict[str, ByteIds] = {}


def write_token_records(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encodes the texts and writes them in ascending doc_id order; returns the manifest, read from the store.

    Columns: shard, path, first_id (ids in all shards before), n_records, n_ids. Each document's ids end with end_id.
    Null and empty texts give end_id alone; documents with equal ids stand together in any order; those with a null doc_id
    stand before all others. An empty table gives an empty manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _BYTE_IDS.get(path) or _BYTE_IDS.setdefault(path, ByteIds(path))
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{uuid.uuid4().hex}"
        width = ids.kind.itemsize
        end, out, offsets, at, n_ids = np.array([end_id], dtype=ids.kind).tobytes(), None, [], 0, 0
        for batch in slices(batches, 1, 4_000_000):
            if out is None:
                store, local = open_store(name)
                store.create_dir(local.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(local + ".rec")
            block = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = struct.pack("<qB", doc_id or 0, width | _NULL if doc_id is None else width) + ids(text or "") + end
                block.append(frame(payload))
                offsets.append(at)
                at += len(block[-1])
                n_ids += (len(payload) - 9) // width
                if len(block) >= 2000:
                    out.write(b"".join(block))
                    block = []
            out.write(b"".join(block))
        if out is not None:
            out.close()
            with store.open_output_stream(local + ".idx") as index:
                index.write(np.array(offsets, dtype="<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([0], pa.int64()), pa.array([len(offsets)], pa.int64()), pa.array([n_ids], pa.int64())], names=["shard", "path", "first_id", "n_records", "n_ids"])

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    shards = materialise(ordered.mapInArrow(run, _MANIFEST), "manifest")
    # one row for each shard: few, whatever the number of documents
    sizes = sorted((r["shard"], r["n_ids"]) for r in shards.select("shard", "n_ids").collect())
    before, total = {}, 0
    for shard, n in sizes:
        before[shard] = total
        total += n
    first = spark.createDataFrame(list(before.items()) or [(-1, 0)], "shard int, first long")
    return shards.join(F.broadcast(first), "shard").select("shard", "path", F.col("first").alias("first_id"), "n_records", "n_ids")


def read_token_records(manifest: DataFrame) -> DataFrame:
    """Reads every shard of a manifest by its offset index: (doc_id, start, n_tokens, ids_crc32).

    start: ids of all documents before it. A damaged record raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, local = open_store(name)
                with store.open_input_stream(local + ".idx") as f:
                    offsets = np.frombuffer(f.read(), dtype="<u8")
                rows, at = [], 0
                with store.open_input_stream(local + ".rec", buffer_size=1 << 20) as f:
                    for k, offset in enumerate(offsets):
                        if at != offset:
                            raise ValueError(f"record {k} of {name} is not at its offset")
                        payload = unframe(f.read, f"record {k} of {name}")
                        at += len(payload) + 16
                        doc_id, found = _record(payload)
                        rows.append((doc_id, start, len(found), zlib.crc32(found.astype("<u4"))))
                        start += len(found)
                        if len(rows) >= 5000:
                            yield _out(rows)
                            rows = []
                if rows:
                    yield _out(rows)

    def _out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("path", "first_id")
    return shards.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_record(name: str, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th record of a shard, by its offset: (doc_id, ids)."""
    store, local = open_store(name)
    with store.open_input_file(local + ".idx") as f:
        f.seek(8 * k)
        offset = int(np.frombuffer(f.read(8), dtype="<u8")[0])
    with store.open_input_file(local + ".rec") as f:
        f.seek(offset)
        payload = unframe(f.read, f"record {k} of {name}")
    return _record(payload)


def token_record_files(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes docs to a new folder in the shared store and reads the files back."""
    spark: SparkSession = docs.sparkSession
    return read_token_records(write_token_records(docs, path, new_folder(spark, "records"), end_id))

"""What several operators share: the shared folder, packed rows, words and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters; only A-Z are lower-cased.
WORD_BREAKS = " \t\n\x0b\x0c\r"
_TO_SPACE = str.maketrans({c: " " for c in WORD_BREAKS[1:]})
_ODD_SPACE = re.compile(r"[^\S \t\n\x0b\x0c\r]")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a local session takes
    a new one of its own; on a cluster, whose machines do not share local folders, this raises ValueError."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or _LOCAL.get(context.applicationId)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="cueframe-")
    return folder.rstrip("/")


_LOCAL: dict[str, str] = {}
#: The folders that this process has asked for, so that they can be deleted once what was made from them is written.
_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    _FOLDERS.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def discard(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Deletes the folders made after the first `since`, but for the last if that is to stay: their tables, and queries
    that read them, cannot be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in _FOLDERS[since : -1 if keep_last else None]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        _FOLDERS.remove(folder)


def folders() -> int:
    return len(_FOLDERS)


def numbered(df: DataFrame) -> DataFrame:
    """The columns named _0, _1, ... by place, as names may clash or differ only in case."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def place_of(df: DataFrame, name: str) -> str:
    """The numbered name of a column: that of its exact spelling, else of any case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    return f"_{(exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()])[0]}"


def named(row: str, columns: list[str]) -> list[Column]:
    """The fields of a struct of numbered columns under their own names."""
    return [F.col(row)[f"_{i}"].alias(c) for i, c in enumerate(columns)]


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts lineage, and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A bucket of hashed keys gets about so many bytes of text, so that one task holds it.
BUCKET_BYTES = 8_000_000


def buckets_for(docs: DataFrame, text: str) -> int:
    """Into how many buckets hashed keys are dealt: by the bytes of all texts, and at least the cluster's setting for
    shuffles. One scan of the column, on the JVM."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES), 8)


class Memo(dict):
    """A bounded memory of f in two generations: when the young one is full it becomes the old one, and what is asked for
    again moves back, so frequent keys stay. f never gives None. Made in a task and gone with it."""

    def __init__(self, f, most: int = 50_000):
        super().__init__()
        self.f, self.most, self.old = f, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.pop(key, None)
        if value is None:
            value = self.f(key)
        self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a string column has about `most` bytes in each part; a longer text is a part of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def words(text: str | None) -> list[str]:
    """The words of a text; none of a null text."""
    if not text:
        return []
    text = text.lower() if text.isascii() else text.translate(_LOWER)
    if _ODD_SPACE.search(text):  # str.split would also break at other white space
        return [w for w in text.translate(_TO_SPACE).split(" ") if w]
    return text.split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What `words` gives for each text, in one array, and how many words each text has: Arrow splits at the same six
    characters and lowers A-Z only."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, n = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    real = pc.binary_length(flat).to_numpy() > 0
    if real.all():
        return flat, n
    # nothing stands before white space at the begin of a text, and after that at its end
    return flat.filter(pa.array(real)), np.diff(np.r_[0, np.cumsum(real)][np.r_[0, np.cumsum(n)]])


def number_words(parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The words of some arrays as numbers, and the hash of each number's word."""
    numbered = pa.concat_arrays(parts).dictionary_encode()
    distinct = numbered.dictionary.cast(pa.large_binary())
    _, offsets, data = distinct.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[distinct.offset : distinct.offset + len(distinct) + 1].tolist() if len(distinct) else [0]
    each = map((data.to_pybytes() if data else b"").__getitem__, map(slice, at, at[1:]))
    return numbered.indices.to_numpy(), np.fromiter(map(xxhash.xxh3_64_intdigest, each), dtype=np.uint64, count=len(distinct))


def hash_words(distinct: list[str]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w.encode("utf-8", "surrogatepass")) for w in distinct), dtype=np.uint64, count=len(distinct))


class Ids(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


_CODES = [np.uint8, np.uint16, np.uint32, np.uint64, np.int64, np.float32, np.float64]


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed block of bytes."""
    head, body = [], []
    for a in arrays:
        if isinstance(a, bytes):
            a = np.frombuffer(a, dtype=np.uint8)
        a = np.ascontiguousarray(a)
        head += [_CODES.index(a.dtype.type), a.nbytes]
        body.append(a.tobytes())
    raw = np.array([len(arrays), *head], dtype=np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    size = int.from_bytes(block[:8], "little")
    raw = pa.Codec("zstd").decompress(memoryview(block)[8:], decompressed_size=size, asbytes=True)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    head = np.frombuffer(raw, dtype=np.int64, count=2 * n, offset=8)
    out, at = [], 8 * (1 + 2 * n)
    for code, size in head.reshape(n, 2):
        kind = np.dtype(_CODES[code])
        out.append(np.frombuffer(raw, dtype=kind, count=int(size) // kind.itemsize, offset=at))
        at += int(size)
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def planes(rising: np.ndarray) -> np.ndarray:
    """Rising whole numbers as steps, byte by byte: their high bytes are mostly zero and compress well."""
    steps = np.diff(rising.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return np.r_[np.uint8(width), steps.view(np.uint8).reshape(-1, 8)[:, :width].T.ravel()]


def from_planes(coded: np.ndarray) -> np.ndarray:
    width = int(coded[0])
    steps = np.zeros(((len(coded) - 1) // width, 8), dtype=np.uint8)
    steps[:, :width] = coded[1:].reshape(width, -1).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links (a, b) of whole numbers as (id, component): the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris and others, 2014). Each round is written to the shared
    folder. Ids without links are not in the result; loops, repeated and reversed links are harmless; nulls are dropped.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    edges = materialise(edges.where("u is not null and v is not null and u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.union(least.select("u", "m")).distinct(), "edges")
        # done when every id has one parent and no parent has a parent
        leaf = edges.groupBy("u").agg(F.count("*").alias("n"))
        if not leaf.where("n > 1").head(1) and not edges.join(leaf.select(F.col("u").alias("v")), "v", "left_semi").head(1):
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

"""WARC archives and their fixity audit by Merkle trees.

Pages are written as WARC/1.1 resource records, each compressed on its own, into one archive for each input partition, behind
a warcinfo record. An audit hashes every record of every replica together with its offset range, and last the length of
the file, so that nothing behind the records goes unseen. The hashes are the leaves of one tree for each archive and
replica; sixteen ordered nodes make one node of the next level. Replicas are compared from the roots
down: only children of nodes that differ are looked at again, until the damaged records are found. All but the trees'
upper levels stays where Spark has dealt it, and no archive is read into one place.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import open_store
from .shared import materialise, new_folder, slices

FANOUT = 16
#: All records carry one date, so that equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"
_MANIFEST = "archive string, path string, place long, record string, page_id long, offset long, length long, digest string"


def _framed(kind: str, name: str, fields: list[str], block: bytes) -> bytes:
    digest = f"sha256:{hashlib.sha256(block).hexdigest()}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", *fields, f"WARC-Block-Digest: {digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_bytes(archive: str) -> bytes:
    """The warcinfo record at the head of an archive."""
    return _framed("warcinfo", archive, [f"WARC-Filename: {archive}.warc.gz", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record_bytes(archive: str, place: int, page_id: int | None, url: str | None, html: str | None) -> bytes:
    """The resource record of a page. Two extension fields keep what a WARC has no field for: the id, and that html is null."""
    fields = [f"WARC-Target-URI: {' '.join(url.split())}"] if url and url.strip() else []
    fields += ["Content-Type: text/html", f"WARC-Page-Id: {'' if page_id is None else page_id}", *(["WARC-Page-Null: true"] if html is None else [])]
    return _framed("resource", f"{archive}/{place}", fields, (html or "").encode("utf-8", "surrogatepass"))


def parse_record(data: bytes) -> tuple[int | None, str | None, str | None]:
    """(page_id, url, html) of one record; raises ValueError where its length or digest does not fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.partition(":")[::2] for line in lines[1:])
    fields = {k: v.strip(" ") for k, v in fields.items()}
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or len(rest) != len(block) + 4 or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("damaged WARC record")
    page = fields["WARC-Page-Id"]
    return int(page) if page else None, fields.get("WARC-Target-URI"), None if "WARC-Page-Null" in fields else block.decode("utf-8", "surrogatepass")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "path", "place", "record", "page_id", "offset", "length", "digest"])


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, html) as archives; returns one row for each record, read from the store.

    Columns: archive, path, place (from 0, which is the warcinfo record), record (its type), page_id, offset, length and
    digest (sha256) of the compressed record. Null ids, urls and texts are allowed, repeated rows are repeated records, and an empty table writes nothing. A task names
    its archive's file anew at each attempt; only files that the returned rows name count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = f"archive-{TaskContext.get().partitionId():06d}"
        out, at, place = None, 0, 0
        path = f"{folder}/{archive}-{uuid.uuid4().hex}.warc.gz"
        for batch in slices(batches, 2, 4_000_000):
            rows = []

            def put(kind: str, page_id: int | None, record: bytes, rows: list = rows) -> None:
                nonlocal at, place
                data = gzip.compress(record, compresslevel=1, mtime=0)
                out.write(data)
                rows.append((archive, path, place, kind, page_id, at, len(data), hashlib.sha256(data).hexdigest()))
                at, place = at + len(data), place + 1

            if out is None:
                store, local = open_store(path)
                store.create_dir(local.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(local, compression=None)
                put("warcinfo", None, info_bytes(archive))
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                put("resource", page_id, record_bytes(archive, place, page_id, url, html))
            yield _batch(rows)
        if out is not None:
            out.close()

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialise(pages.mapInArrow(run, _MANIFEST), "manifest")


def replicate(manifest: DataFrame, folder: str, damage: Column | None = None) -> DataFrame:
    """Copies the archives; returns the manifest with the copies' paths. damage: records in whose copy a byte flips; a null
    condition damages nothing. An empty manifest copies nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for archive, path, spoilt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to = f"{folder}/{archive}-{uuid.uuid4().hex}.warc.gz"
                store, local = open_store(path)
                other, copy = open_store(to)
                other.create_dir(copy.rpartition("/")[0], recursive=True)
                at, flips = 0, sorted(spoilt or [])
                with store.open_input_stream(local, compression=None) as source, other.open_output_stream(copy, compression=None) as out:
                    while part := source.read(1 << 20):
                        part = bytearray(part)
                        while flips and flips[0] < at + len(part):
                            part[flips.pop(0) - at] ^= 1
                        out.write(bytes(part))
                        at += len(part)
                rows.append((archive, to))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["archive", "path"])

    spoilt = F.when(damage, F.col("offset") + F.expr("length div 2")) if damage is not None else F.lit(None).cast("long")
    files = manifest.withColumn("flip", spoilt).groupBy("archive", "path").agg(F.collect_list("flip").alias("flips"))
    copies = materialise(files.repartition("archive").mapInArrow(run, "archive string, path string"), "copies")
    return manifest.drop("path").join(copies, "archive").select(*manifest.columns)


def leaves(manifest: DataFrame) -> DataFrame:
    """(archive, place, hash): reads every record of the archives by its offset range and hashes it with that range; one
    more leaf, behind the last record, has the length of the file.

    A record that cannot be read whole (its file is too short) hashes what there is; a missing file has no leaves. Empty
    manifests have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, name = None, None
        for batch in batches:
            archives, paths, places, offsets, lengths = (c.to_pylist() for c in batch.columns)
            found = []
            for archive, path, place, offset, length in zip(archives, paths, places, offsets, lengths, strict=True):
                if path != name:
                    if open_file is not None:
                        open_file.close()
                    store, local = open_store(path)
                    name, open_file = path, store.open_input_file(local) if store.get_file_info(local).is_file else None
                if open_file is None:
                    continue
                if length is None:
                    found.append((archive, place, hashlib.sha256(f"length {open_file.size()}".encode()).hexdigest()))
                    continue
                data = b""
                if offset < open_file.size():
                    open_file.seek(offset)
                    data = open_file.read(length)
                found.append((archive, place, hashlib.sha256(f"{offset},{length},".encode() + data).hexdigest()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["archive", "place", "hash"])

    # an archive's records are dealt out in runs, so that even a single large archive is read by many tasks
    ends = manifest.groupBy("archive", "path").agg((F.max("place") + 1).alias("place"))
    ranges = manifest.select("archive", "path", "place", "offset", "length")
    ranges = ranges.unionByName(ends.select("archive", "path", "place", F.lit(1 << 62).alias("offset"), F.lit(None).cast("long").alias("length")))
    dealt = ranges.withColumn("run", F.expr("place div 256")).repartition("archive", "run").sortWithinPartitions("path", "offset").drop("run")
    return dealt.mapInArrow(run, "archive string, place long, hash string")


def merkle_tree(leaf_rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(archive, level, place, hash): leaves are level 0; each node hashes up to `fanout` ordered nodes below it.

    leaf_rows: (archive, place, hash), places distinct in each archive; without leaves there are no nodes."""
    level = leaf_rows.select("archive", F.lit(0).alias("level"), "place", "hash")
    tree = level = materialise(level, "tree")
    top = level.agg(F.max("place")).first()[0] or 0
    k = 0
    while top > 0 or k == 0:
        k, top = k + 1, top // fanout
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["hash"]))
        level = level.groupBy("archive", F.expr(f"place div {fanout}").alias("up")).agg(F.sha2(F.array_join(ordered, ","), 256).alias("hash"))
        level = materialise(level.select("archive", F.lit(k).alias("level"), F.col("up").alias("place"), "hash"), "tree")
        tree = tree.unionByName(level)
    return tree


def audit(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(archive, place): leaves in which two trees differ, or that only one of them has; none for two empty trees. A null
    hash equals a null hash."""
    top = max(first.agg(F.max("level")).first()[0] or 0, second.agg(F.max("level")).first()[0] or 0)
    suspect = None
    for k in range(top, -1, -1):
        a, b = (t.where(F.col("level") == k).select("archive", "place", F.col("hash").alias(n)) for t, n in ((first, "h1"), (second, "h2")))
        if suspect is not None:
            up = suspect.select("archive", F.col("place").alias("up"))
            a, b = (x.withColumn("up", F.expr(f"place div {fanout}")).join(up, ["archive", "up"], "left_semi").drop("up") for x in (a, b))
        suspect = a.join(b, ["archive", "place"], "full").where("not (h1 <=> h2)").select("archive", "place")
        suspect = materialise(suspect, "suspect")
    return suspect


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, url, html) of all page records; raises ValueError at a damaged one. Null ids, urls and texts come back as
    they were, but for the white space of an url; an empty manifest gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, local = open_store(path)
                with store.open_input_file(local) as f:
                    f.seek(offset)
                    try:
                        data = gzip.decompress(f.read(length))
                    except (OSError, EOFError, zlib.error) as e:
                        raise ValueError(f"damaged WARC record at {offset} of {path}") from e
                rows.append(parse_record(data))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["page_id", "url", "html"])

    return manifest.where("record = 'resource'").select("path", "offset", "length").mapInArrow(run, "page_id long, url string, html string")


def fixity_audit(pages: DataFrame, damage: Column | None = None) -> DataFrame:
    """Writes pages as archives, copies them, and audits the copy: (page_id, archive, place, offset, length, digest, intact,
    archive_intact).

    One row for each page, repeated rows and null ids included. archive_intact: whether the copy's file has the length and
    the warcinfo record of the original. damage: a condition on the manifest; those records are damaged in the copy.
    """
    spark = pages.sparkSession
    original = write_warc(pages, new_folder(spark, "warc"))
    copy = replicate(original, new_folder(spark, "replica"), damage)
    suspect = audit(merkle_tree(leaves(original)), merkle_tree(leaves(copy)))
    found = original.where("record = 'resource'").join(suspect.withColumn("differs", F.lit(True)), ["archive", "place"], "left")
    whole = original.groupBy("archive").agg((F.max("place") + 1).alias("end")).join(suspect, "archive").where("place in (0, end)").select("archive").distinct()
    found = found.join(whole.withColumn("torn", F.lit(True)), "archive", "left")
    return found.select("page_id", "archive", "place", "offset", "length", "digest", F.col("differs").isNull().alias("intact"), F.col("torn").isNull().alias("archive_intact"))

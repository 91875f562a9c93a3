"""BPE, token counts and record files against the tokenizers library."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from cueframe.llm.bpe import Encoder, bpe_digests, bpe_round_trip, digests, encoder  # noqa: E402
from cueframe.llm.records import ByteIds, frame, read_record, read_token_records, unframe, write_token_records  # noqa: E402
from cueframe.llm.shared import new_folder  # noqa: E402
from cueframe.llm.token_counts import token_counts  # noqa: E402

TEXTS = [
    None, "", " \n\t ", "Hello world's the THE 12345", "naïve ÀÉÎ ΣΑΣ straße İstanbul ﬁ é", "汉字 漢字かな 안녕 😀👍🏽", "<|endoftext|> in <|startoftext|>x", "a" * 5000,
    "of%%% the&&& !!! ...--- don't we'll I'M", "\x00\x1f  　x​", "word " * 3000, "x\r\ny\x0bz\x85w", "Hello world's the THE 12345",
]


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (3, TEXTS[3], "again")], "doc_id long, text string, ids string")


def test_digests(docs):
    t = library("word_bpe_49k.json")
    found = {r.doc_id: r for r in bpe_digests(docs, P.path("word_bpe_49k.json")).collect()}
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert found[i].n_tokens == len(ids), text
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text
        assert found[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest(), text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_round_trip(docs, name):
    t = library(name)
    for r in bpe_round_trip(docs, P.path(name)).collect():
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)


def test_cuts_are_certain():
    enc, whole = encoder(P.path("word_bpe_49k.json")), Encoder(P.path("word_bpe_49k.json"))
    whole.inside = np.ones((256, 256), dtype=bool)  # no cut at all
    words = ["straße", "x汉y", "zzzzqqq", "!!!", "a" * 90, "ba" * 60, "~~a~~", "\n<|endoftext|>"]
    assert enc.cuts(np.frombuffer("x汉y".encode(), dtype=np.uint8)).any()
    for a, b in zip(enc.encode_all(words), whole.encode_all(words), strict=True):
        assert (a == b).all()


def test_code_points_of_all_planes_against_the_library():
    t, enc = library("word_bpe_49k.json"), encoder(P.path("word_bpe_49k.json"))
    points = [c for c in [*range(1, 0x3000), *range(0xA000, 0xABFF), *range(0x10000, 0x1FFFF, 3)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(c) + "a' "[c % 3] for c in points[i : i + 9]) for i in range(0, len(points), 9)]
    for text, (n, ids, decoded) in zip(texts, digests(enc, texts), strict=True):
        wanted = t.encode(text, add_special_tokens=False).ids
        assert n == len(wanted) and ids == hashlib.sha256(" ".join(map(str, wanted)).encode()).hexdigest(), text
        assert decoded == hashlib.sha256(t.decode(wanted, skip_special_tokens=False).encode()).hexdigest()



def test_counts(docs, spark):
    t = library("word_bpe_49k.json")
    found = token_counts(docs, P.path("word_bpe_49k.json")).collect()
    assert len(found) == len(TEXTS) + 1
    for r in found:
        text = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(t.encode(text, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 2048)
    assert token_counts(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0
    assert token_counts(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), P.path("word_bpe_49k.json")).first().doc_id is None


def test_records(spark, docs):
    t = library("byte_bpe_50k.json")
    one = docs.where("ids = 'clash'")
    manifest = write_token_records(one, P.path("byte_bpe_50k.json"), new_folder(spark, "records"))
    start = 0
    for r in sorted(read_token_records(manifest).collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    shard = manifest.orderBy("shard").first()
    doc_id, ids = read_record(shard.path, 0)
    assert doc_id == 0 and ids.tolist() == [0]
    assert read_token_records(write_token_records(docs.limit(0), P.path("byte_bpe_50k.json"), new_folder(spark, "records"))).count() == 0


def test_records_of_null_and_repeated_ids(spark):
    t = library("byte_bpe_50k.json")
    rows = [(4, "later"), (None, "without an id"), (2, "twice"), (2, "twice"), (-3, "below zero"), (None, None)]
    manifest = write_token_records(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json"), new_folder(spark, "records"))
    found = sorted(read_token_records(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, -3, 2, 2, 4]
    size = lambda x: len(t.encode(x or "", add_special_tokens=False).ids) + 1
    assert sorted(r.n_tokens for r in found) == sorted(size(x) for _, x in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:], strict=False))


def test_record_ids_against_the_library():
    import random

    t, ids, r = library("byte_bpe_50k.json"), ByteIds(P.path("byte_bpe_50k.json")), random.Random(3)
    signs = [" ", "  ", "\n", "\t", "'s", "'LL", "é", "汉", "😀", "\u200d", "\u0301", "\x85", "\u3000", "<|endoftext|>", "A", "b", "12", "½", "٣", "ß"]
    for text in ["".join(r.choices([*signs, chr(r.randrange(1, 0xD7FF)), chr(r.randrange(0x10000, 0x1FFFF))], k=r.randrange(0, 40))) for _ in range(4000)]:
        assert np.frombuffer(ids(text), dtype=ids.kind).tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("sign", [" ", "\n", "\t", "\u3000", "\x85", "\r\n", " \n\t"])
def test_long_white_space(sign):
    t, ids = library("byte_bpe_50k.json"), ByteIds(P.path("byte_bpe_50k.json"))
    for text in (sign * 1500, "a" + sign * 1500, sign * 1500 + "b", "a" + sign * 1500 + "12" + sign * 1001 + "!" + sign * 999, sign * 700 + "<|endoftext|>" + sign * 1200 + "x", "x" + sign * 100_000 + "y"):
        assert np.frombuffer(ids(text), dtype=ids.kind).tolist() == t.encode(text, add_special_tokens=False).ids
    whole = np.frombuffer(ids("a" + sign * 5_000_000 + "b"), dtype=ids.kind).tolist()
    assert ids("a") == np.array(whole[:1], dtype=ids.kind).tobytes() and whole[-1] in np.frombuffer(ids("b" + " b"), dtype=ids.kind)


def test_records_of_long_white_space(spark):
    t = library("byte_bpe_50k.json")
    texts = [" " * 1_000_000, "x" + "\n" * 1_000_000 + " y", None, ""]
    manifest = write_token_records(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("byte_bpe_50k.json"), new_folder(spark, "records"))
    for r in read_token_records(manifest).collect():
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))


def test_damaged_records_are_refused():
    import io

    data = bytearray(frame(b"payload"))
    assert unframe(io.BytesIO(bytes(data)).read, "x") == b"payload"
    for at in range(len(data)):
        spoilt = bytearray(data)
        spoilt[at] ^= 1
        with pytest.raises(ValueError):
            unframe(io.BytesIO(bytes(spoilt)).read, "x")

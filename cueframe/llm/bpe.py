"""Byte-pair encoding and decoding with forced boundaries.

A merge joins two neighbouring symbols into a token of the vocabulary. Two bytes that never stand side by side inside
any token can therefore never end up in one token: between them is a certain cut. Pre-tokens are cut there first; the
fragments are encoded on their own and concatenated. All fragments of a batch are merged together: those of one length
are the rows of a matrix, and each round merges every row's best pair. Nothing is kept between batches.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .shared import Ids, slices

#: Fixed: the printable stand-ins of the 256 bytes in byte-level vocabularies.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
#: Fixed: how the two kinds of vocabulary split a text into pre-tokens.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Longer fragments are merged one by one.
LONG = 64
#: A task encodes the distinct words of about so many characters at once.
BATCH_CHARS = 6_000_000
_NONE = np.uint32(0xFFFFFFFF)
#: Characters beyond Latin letters and common signs; their classes differ between Unicode versions.
_RARE = regex.compile("[^\u0000-ɏ‐-‧‰-›€™]")


class Encoder:
    """The BPE of a tokenizer file: word vocabularies (lower case, word ends) and byte-level ones."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.specials.items()]}
        self.pattern = regex.compile(WORD_PATTERN if self.end else BYTE_PATTERN)
        self.with_breaks = regex.compile(WORD_PATTERN + "|\n")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        # the library's own character tables, for what Python's may not know yet
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]) if spec.get("normalizer") is not None else None
        self.splitter = pre_tokenizers.Split(Regex(self.pattern.pattern.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")), behavior="removed", invert=True)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right = (np.array([self.vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.new = np.array([*(self.vocab[a + b] for a, b in pairs)], dtype=np.int32)
        keys = self.left << 32 | self.right
        self.rank_of = np.argsort(keys, kind="stable").astype(np.uint32)
        self.keys = keys[self.rank_of]
        self.first = np.array([self.vocab[BYTE_CHARS[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([self.vocab[BYTE_CHARS[b] + self.end] for b in range(256)], dtype=np.int32)
        self.inside = self._inside()

    def _inside(self) -> np.ndarray:
        """Whether two bytes stand side by side inside some token."""
        back = {c: b for b, c in BYTE_CHARS.items()}
        seen = np.zeros((256, 256), dtype=bool)
        for token in self.vocab:
            body = [back[c] for c in (token[: -len(self.end)] if self.end and token.endswith(self.end) else token)]
            seen[body[:-1], body[1:]] = True
        return seen

    # texts to pre-tokens

    def pre_tokens(self, text: str) -> list[str]:
        """A text's pre-tokens after the normaliser; special strings stand alone, behind a line feed."""
        if self.special and any(s in text for s in self.specials):
            parts = self.special.split(text)
            return [w for i, part in enumerate(parts) for w in (["\n" + part] if i % 2 else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if _RARE.search(text):
            text = self.normal.normalize_str(text) if self.normal else text
            return [w for w, _ in self.splitter.pre_tokenize_str(text)]
        if self.normal:
            text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        return self.pattern.findall(text)

    def split_all(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of many strings without line feeds, and how many each has; for word vocabularies."""
        plain = [(c.isascii() or not _RARE.search(c)) and "<|" not in c for c in chunks]
        plain = None if all(plain) else plain
        text = "\n".join(chunks if plain is None else [c for c, p in zip(chunks, plain, strict=True) if p])
        found = self.with_breaks.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower()) if text else []
        ends = np.flatnonzero(np.fromiter((w == "\n" for w in found), dtype=bool, count=len(found)))
        counts = np.diff(np.r_[-1, ends, len(found)]) - 1
        found = [w for w in found if w != "\n"]
        if plain is None:
            return found, counts if chunks else np.zeros(0, dtype=np.int64)
        n, words, at, k = np.zeros(len(chunks), dtype=np.int64), [], 0, 0
        for i, p in enumerate(plain):
            if p:
                size = int(counts[k])
                words += found[at : at + size]
                at, k = at + size, k + 1
            else:
                rare = self.pre_tokens(chunks[i])
                size = len(rare)
                words += rare
            n[i] = size
        return words, n

    # pre-tokens to ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; _NONE where there is none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """For each byte but the first, whether a certain cut is before it."""
        return ~self.inside[data[:-1], data[1:]]

    def _merged(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each row's symbols: (rows of ids, how many count)."""
        n, size = ids.shape
        out, counts = ids.copy(), np.full(n, size)
        if size < 2:
            return out, counts
        rows, left = np.arange(n), np.full(n, size)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        place = np.arange(size - 1)
        while len(rows):
            best = rank.argmin(axis=1)
            here = np.arange(len(rows))
            r = rank[here, best]
            done = r == _NONE
            if done.any():
                out[rows[done]], counts[rows[done]] = ids[done], left[done]
                go = ~done
                rows, left, ids, rank, best, r = rows[go], left[go], ids[go], rank[go], best[go], r[go]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            ids[here, best] = self.new[r]
            behind = place[None, :] > best[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            rank[:, :-1] = np.where(place[None, :-1] >= best[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            left -= 1
            before = np.flatnonzero(best > 0)
            rank[before, best[before] - 1] = self._ranks(ids[before, best[before] - 1], ids[before, best[before]])
            after = np.flatnonzero(best + 1 < left)
            rank[after, best[after]] = self._ranks(ids[after, best[after]], ids[after, best[after] + 1])
            last = np.flatnonzero((best + 1 >= left) & (best < size - 1))
            rank[last, best[last]] = _NONE
        return out, counts

    def _long(self, ids: list[int]) -> list[int]:
        """One long fragment: each round merges all places of the best pair."""
        while len(ids) > 1:
            a = np.array(ids)
            rank = int(self._ranks(a[:-1], a[1:]).min())
            if rank == int(_NONE):
                break
            left, right, new = int(self.left[rank]), int(self.right[rank]), int(self.new[rank])
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and ids[i] == left and ids[i + 1] == right:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def encode_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pre-tokens, one after another, and how many each has."""
        special = {i: self.specials[w[1:]] for i, w in enumerate(words) if w[:1] == "\n" and w[1:] in self.specials}
        coded = [b"" if i in special else w.encode("utf-8", "replace") for i, w in enumerate(words)] if special else [w.encode("utf-8", "replace") for w in words]
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        del coded
        begin = np.r_[0, np.cumsum(lengths)]
        symbol = self.first[data]
        real = lengths > 0
        symbol[begin[1:][real] - 1] = self.last[data[begin[1:][real] - 1]]
        starts = np.zeros(len(data), dtype=bool)
        starts[begin[:-1][real]] = True
        if len(data):
            starts[1:] |= self.cuts(data)
        start = np.flatnonzero(starts)
        size = np.diff(np.r_[start, len(data)])
        counts, groups = size.copy(), []
        by = np.argsort(size, kind="stable")
        edges = np.searchsorted(size[by], np.arange(2, LONG + 2))
        for length in range(2, LONG + 1):
            mine = by[edges[length - 2] : edges[length - 1]]
            if len(mine):
                ids, n = self._merged(symbol[start[mine][:, None] + np.arange(length)])
                counts[mine] = n
                groups.append((mine, ids, n))
        for f in by[edges[-1] :].tolist():
            ids = np.array([self._long(symbol[start[f] : start[f] + size[f]].tolist())], dtype=np.int32)
            counts[f] = ids.shape[1]
            groups.append((np.array([f]), ids, np.array([ids.shape[1]])))
        at = np.r_[0, np.cumsum(counts)]
        out = np.empty(at[-1], dtype=np.int32)
        single = by[: edges[0]]
        out[at[single]] = symbol[start[single]]
        for mine, ids, n in groups:
            used = np.arange(ids.shape[1]) < n[:, None]
            out[(at[mine][:, None] + np.arange(ids.shape[1]))[used]] = ids[used]
        upto = np.searchsorted(start, begin)
        per_word = np.diff(at[upto])
        if special:
            where = np.array(list(special))
            out = np.insert(out, at[upto[where]], [special[i] for i in where.tolist()])
            per_word[where] = 1
        return out, per_word

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(self.pre_tokens(text or ""))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """As the file's decoder says: without one, tokens are joined by a space; byte-level ones give their bytes."""
        tokens = [self.tokens[i] for i in ids]
        if self.end:
            return " ".join(tokens)
        back = {c: b for b, c in BYTE_CHARS.items()}
        return bytes(b for t in tokens for b in (map(back.__getitem__, t) if t not in self.specials else t.encode())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file; its size is that of the vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def chunk_texts(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct strings between spaces and line feeds, each text's as numbers one after another, and how many each has."""
    ids, rows = Ids(), []
    for text in texts:
        rows.append(np.array(list(map(ids.__getitem__, text.replace("\n", " ").split(" "))) if text else [], dtype=np.int32))
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return list(ids), np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32), sizes


def _joined(parts: list[str], sizes: np.ndarray) -> list[str]:
    """Runs of so many strings each, joined by spaces."""
    out, at = [], 0
    for n in sizes.tolist():
        out.append(parts[at] if n == 1 else " ".join(parts[at : at + n]))
        at += n
    return out


def digests(enc: Encoder, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
    """(n_tokens, sha256 of the ids, sha256 of the decoded text) of each text; for word vocabularies."""
    chunks, number, sizes = chunk_texts(texts)
    words, per_chunk = enc.split_all(chunks)
    distinct = Ids()
    place = np.array(list(map(distinct.__getitem__, words)), dtype=np.int64)
    ids, per_word = enc.encode_all(list(distinct))
    del chunks, words, distinct
    counts = np.bincount(np.repeat(np.arange(len(per_chunk)), per_chunk), weights=per_word[place], minlength=len(per_chunk)).astype(np.int64)
    listed = ids.tolist()
    named = _joined([*map(str, listed)], per_word), _joined([*map(enc.tokens.__getitem__, listed)], per_word)
    place = place.tolist()
    left, right = (_joined([*map(x.__getitem__, place)], per_chunk) for x in named)
    full = counts > 0
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        mine = number[a:b]
        mine = mine[full[mine]]
        n, mine = int(counts[mine].sum()), mine.tolist()
        shas = (hashlib.sha256(" ".join([x[i] for i in mine]).encode()).hexdigest() for x in (left, right))
        yield n, *shas


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, decodes its ids, and returns (id, ids array<int>, decoded string).

    Null and empty texts give no ids and the empty string. One narrow pass; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, 1, BATCH_CHARS):
            ids = [enc.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """As bpe_round_trip, but each document's ids and decoded text leave the task as digests only.

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row of docs; a null or empty text has no
    ids and the digests of the empty string; a null doc_id stays null; an empty table gives an empty one; further columns
    are not carried. Only for vocabularies that drop white space, where texts can be taken apart at spaces: a batch's
    distinct words are encoded once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, 1, BATCH_CHARS):
            n, left, right = zip(*digests(enc, batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

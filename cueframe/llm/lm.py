"""Language-model scoring with an Elias-Fano trigram trie.

The model mixes counts of three orders over whole documents; a document's end is a token, and is also what its first word
follows. With c the counts in training documents, N their tokens, V their distinct tokens and two weights a and m:

    p(w)    = (c(w) + 1) / (N + V + 1)
    p(w|uv) = (c(uvw) + a (c(vw) + m p(w))) / (c(uv) + a (c(v) + m))

which sums to one over all w. log10 p(w|uv) falls apart into a numerator, known where the n-grams that end in w are, and
a context weight, known where those that end in v are. As every token is followed by one other, one shuffle by token is
enough: each bucket holds all n-grams that end in its tokens, builds the trie of its training n-grams and scores its
occurrences, numerators and context weights alike.

The trie is stored last word first. Level 1 has the tokens, level 2 for each token the words before it, level 3 for each
such pair the words before that. All are monotone sequences in Elias-Fano form (successors are stored relative to what
they follow, so that a whole level is monotone), and so are the pointers from one level into the next. Probabilities and
context weights are quantised. A bucket writes its levels to a file of the shared folder, maps it, and asks the mapped
levels; the file goes when the bucket is scored. Tokens are 64-bit hashes; a word before another is known by 40 of these
bits, and one before a pair by 24, as it has to be told apart only from the others before that pair.

A very frequent token (at least 1 of 1,000) is dealt out by the word before it, with its count from the first pass.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import open_store
from .shared import buckets_for, from_planes, hash_words, materialise, narrow, new_folder, number_words, pack, planes, runs, slices, split_words, unpack
from .token_counts import _PACKED, _rows

PACK_WORDS = 1_500_000
#: Texts are split by so many bytes at once, and words of so many bytes are packed at most; a longer text is alone.
SPLIT_BYTES, PACK_BYTES = 2_000_000, 100_000_000
END = "\n"  # cannot be a word
HOT = 1000
#: Bits by which a word is known at each level.
LEVEL_BITS = (64, 40, 24)
WEIGHT, PRIOR = 0.01, 200.0


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Whole numbers of width bits each (57 at most), side by side in 64-bit words."""
    n = -(-len(values) // 64)
    v = np.zeros(n * 64, dtype=np.uint64)
    v[: len(values)] = values
    v = v.reshape(n, 64)
    out = np.zeros((n, max(width, 1)), dtype=np.uint64)
    for j in range(64 if width else 0):
        w, o = divmod(j * width, 64)
        out[:, w] |= v[:, j] << np.uint64(o)
        if o + width > 64:
            out[:, w + 1] |= v[:, j] >> np.uint64(64 - o)
    return np.r_[out.ravel(), np.zeros(1, dtype=np.uint64)]


def get_bits(packed: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), dtype=np.uint64)
    bit = i.astype(np.uint64) * np.uint64(width)
    w, o = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    high = np.where(o > 0, packed[w + 1] << ((np.uint64(64) - o) & np.uint64(63)), np.uint64(0))
    return (packed[w] >> o | high) & np.uint64((1 << width) - 1)


_SELECT = np.array([[([j for j in range(8) if b >> j & 1] + [8] * 8)[r] for r in range(8)] for b in range(256)], dtype=np.int64)
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: So many lookups at once keep their arrays in the processor's cache.
SLICE = 1 << 15
#: So many values are read one after another rather than looked up, for each that is asked for.
DENSE = 4


def _select(bits: np.ndarray, before: np.ndarray, i: np.ndarray, clear: bool = False) -> np.ndarray:
    """Where the i-th set (or clear) bits stand; before: how many such bits are before each word of 64 bits."""
    w = np.searchsorted(before, i.astype(np.uint32), side="right") - 1
    rest, word = (i - before[w]).astype(np.uint64), ~bits[w] if clear else bits[w]
    # byte by byte in one number: how many bits are in each, in all up to each, and which of these sums stay within rest
    n = word - (word >> np.uint64(1) & np.uint64(0x5555555555555555))
    n = (n & np.uint64(0x3333333333333333)) + (n >> np.uint64(2) & np.uint64(0x3333333333333333))
    upto = (n + (n >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH
    byte = (((rest * _EACH | _TOP) - upto & _TOP) >> np.uint64(7)) * _EACH >> np.uint64(56)
    shift = byte << np.uint64(3)
    inside = (rest - (upto << np.uint64(8) >> shift & np.uint64(255))).astype(np.int64)
    return w * 64 + shift.astype(np.int64) + _SELECT[(word >> shift & np.uint64(255)).astype(np.int64), inside]


class EliasFano:
    """A monotone sequence: low bits side by side, high parts in unary, and a directory of how many bits are set before
    each word of the latter. Arrays may be views of a mapped file, of which only the parts asked for are unpacked."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self._zeros: np.ndarray | None = None

    @staticmethod
    def build(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(57, max(0, (top // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(width)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 2
        bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little").view(np.uint64)
        return n, width, pack_bits(values & np.uint64((1 << width) - 1), width), packed, np.r_[0, np.cumsum(np.bitwise_count(packed))[:-1]].astype(np.uint32)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (_select(self.high, self.ones, i) - i).astype(np.uint64) << np.uint64(self.width) | get_bits(self.low, self.width, i)

    def part(self, begin: int, end: int) -> np.ndarray:
        """The values [begin, end), read one after another."""
        if begin >= end:
            return np.zeros(0, dtype=np.uint64)
        i = np.arange(begin, end)
        at, to = _select(self.high, self.ones, i[[0, -1]]) >> 6
        set_ = np.flatnonzero(np.unpackbits(self.high[at : to + 1].view(np.uint8), bitorder="little"))[begin - int(self.ones[at]) :][: end - begin]
        return (set_ + at * 64 - i).astype(np.uint64) << np.uint64(self.width) | get_bits(self.low, self.width, i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below h."""
        if self._zeros is None:
            self._zeros = (np.arange(0, 64 * len(self.ones), 64) - self.ones).astype(np.uint32)
        at = np.clip(h - 1, 0, 64 * len(self.high) - int(self.n) - 1)
        return np.where(h > 0, np.minimum(_select(self.high, self._zeros, at, clear=True) - at, self.n), 0)

    def find(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where x stands in the part [begin, end) of the sequence, or -1: a successor search among equal high parts,
        or in all parts at once if these hold little else."""
        if not len(x):
            return np.zeros(0, dtype=np.int64)
        low, high = self._before((np.array([x.min(), x.max()]) >> np.uint64(self.width)).astype(np.int64) + [0, 1]).tolist()
        at, to = max(int(begin.min()), low), min(int(end.max()), high)
        if to - at <= DENSE * len(x):
            some = self.part(at, to)
            i = np.maximum(at + np.searchsorted(some, x), begin)
            same = (i >= begin) & (i < np.minimum(end, to))
            same[same] = some[i[same] - at] == x[same]
            return np.where(same, i, -1)
        h = (x >> np.uint64(self.width)).astype(np.int64)
        lo, hi = np.maximum(begin, self._before(h)), np.minimum(np.minimum(end, self._before(h + 1)), self.n)
        stop = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.get(mid) < x[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        found = np.flatnonzero(lo < stop)
        out = np.full(len(x), -1, dtype=np.int64)
        same = self.get(lo[found]) == x[found]
        out[found[same]] = lo[found[same]]
        return out


class Trie:
    """Three levels and the pointers between them, in one block of bytes that can be a mapped file.

    Each level has its keys, the codes of its numerators and, but for the last, the codes of its context weights and
    where each entry's successors begin in the next level.
    """

    KINDS = (np.uint64, np.uint64, np.uint32) * 2 + (np.uint16, np.uint16)

    def __init__(self, block: bytes | np.ndarray):
        raw = np.frombuffer(block, dtype=np.uint8) if isinstance(block, bytes) else block
        head = raw[:512].view(np.int64)
        self.low, self.step = (float(x) for x in head[:2].view(np.float64))
        at, self.keys, self.pointers, self.prob, self.context = 512, [], [], [], []
        for k in range(3):
            arrays = []
            for kind, size in zip(self.KINDS, head[8 + 16 * k : 16 + 16 * k], strict=True):
                arrays.append(raw[at : at + int(size)].view(kind))
                at += -(-int(size) // 8) * 8
            n, width, n_pointers, pointer_width = head[16 + 16 * k : 20 + 16 * k].tolist()
            self.keys.append(EliasFano(n, width, *arrays[:3]))
            self.pointers.append(EliasFano(n_pointers, pointer_width, *arrays[3:6]))
            self.prob.append(arrays[6])
            self.context.append(arrays[7])

    @classmethod
    def open(cls, uri: str) -> Trie:
        """Maps a file of the shared folder; a store without files to map gives its bytes."""
        store, local = open_store(uri)
        if store.type_name == "local":
            return cls(np.memmap(local, dtype=np.uint8, mode="r"))
        with store.open_input_file(local) as f:
            return cls(f.read())

    @staticmethod
    def build(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], low: float, high: float, bits: int) -> bytes:
        """levels: (owner: the entry of the level above, key, numerator, context weight), sorted by owner and key; the
        last two are in log10 and are quantised to so many bits between low and high."""
        step = (high - low) / ((1 << bits) - 1)
        code = lambda x: np.clip(np.rint((x - low) / step), 0, (1 << bits) - 1).astype(np.uint16)
        head, arrays = np.zeros(64, dtype=np.int64), []
        head[:2] = np.array([low, step]).view(np.int64)
        for k, (owner, key, prob, context) in enumerate(levels):
            keys = EliasFano.build(owner.astype(np.uint64) << np.uint64(LEVEL_BITS[k]) | key if k else key)
            below = levels[k + 1][0] if k < 2 else np.zeros(0, dtype=np.int64)
            pointers = EliasFano.build(np.r_[0, np.cumsum(np.bincount(below, minlength=len(key)))] if k < 2 else np.zeros(0, dtype=np.int64))
            mine = [*keys[2:], *pointers[2:], code(prob), code(context) if k < 2 else np.zeros(0, dtype=np.uint16)]
            head[8 + 16 * k : 16 + 16 * k] = [x.nbytes for x in mine]
            head[16 + 16 * k : 20 + 16 * k] = [*keys[:2], *pointers[:2]]
            arrays += mine
        return head.tobytes() + b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in arrays)

    def value(self, codes: np.ndarray) -> np.ndarray:
        return self.low + self.step * codes

    def descend(self, k: int, above: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
        """Where keys stand at level k among the successors of the entries `above`, or -1; -1 has no successors."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for at in range(0, len(keys), SLICE):
            part = keys[at : at + SLICE]
            if above is None:
                out[at : at + SLICE] = self.keys[0].find(part, np.zeros(len(part), dtype=np.int64), np.full(len(part), self.keys[0].n))
                continue
            known = np.flatnonzero(above[at : at + SLICE] >= 0)
            i = above[at : at + SLICE][known]
            begin, end = self.pointers[k - 1].get(i).astype(np.int64), self.pointers[k - 1].get(i + 1).astype(np.int64)
            out[at + known] = self.keys[k].find(i.astype(np.uint64) << np.uint64(LEVEL_BITS[k]) | part[known], begin, end)
        return out

    def read(self, codes: np.ndarray, places: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
        """The values at the places; `otherwise` where there is none."""
        out = np.broadcast_to(np.asarray(otherwise, dtype=np.float64), places.shape).copy()
        has = np.flatnonzero(places >= 0)
        out[has] = self.value(codes[places[has]])
        return out


def _unigrams(docs: DataFrame, buckets: int) -> tuple[int, int, dict[int, int]]:
    """N, V and the hot tokens with their counts, of the training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parts, ends, total, seq = TaskContext.get().partitionId(), [], 0, 0, 0

        def flush():
            tokens, hashes = number_words(parts)
            hashes, counts = np.r_[hashes, hash_words([END])], np.r_[np.bincount(tokens, minlength=len(hashes)), ends]
            bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((hashes, bucket))
            hashes, counts, bucket = hashes[order], counts[order], bucket[order]
            cut = runs(bucket)
            for at, to in zip(cut, np.r_[cut[1:], len(bucket)], strict=True):
                yield int(bucket[at]), part << 24 | seq, False, pack(hashes[at:to], narrow(counts[at:to]))

        for some in slices(batches, 1, SPLIT_BYTES):
            train = [in_training(d) for d in some.column(0).to_pylist()]
            found, _ = split_words(some.column(1).filter(pa.array(train, pa.bool_())))
            if ends and (total + len(found) > PACK_WORDS or sum(x.nbytes for x in parts) + found.nbytes > PACK_BYTES):
                yield _rows([*flush()])
                parts, ends, total, seq = [], 0, 0, seq + 1
            if any(train):
                parts.append(found)
                ends, total = ends + sum(train), total + len(found)
        if ends:
            yield _rows([*flush()])

    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in table.column("block").to_pylist()]
        hashes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.int64)
        top = np.argsort(-counts, kind="stable")[:HOT]
        return pa.table({"token": pa.array([None, *hashes[top].view(np.int64).tolist()], pa.int64()), "n": [int(counts.sum()), *counts[top].tolist()], "types": [len(hashes)] + [0] * len(top)})

    found = materialise(docs.mapInArrow(count, _PACKED).groupBy("key").applyInArrow(merge, "token long, n long, types long"), "unigrams")
    row = found.where("token is null").agg(F.sum("n"), F.sum("types")).first()
    total, types = row[0] or 0, row[1] or 0
    # no more than HOT tokens can have a share of 1 / HOT, and all of them are among the first HOT of their buckets
    hot = found.where((F.col("token").isNotNull()) & (F.col("n") * HOT >= total)).select("token", "n").collect()
    return total, types, {r["token"]: r["n"] for r in hot}


def _order(w: np.ndarray, v: np.ndarray, u: np.ndarray, below: int) -> np.ndarray:
    """The order of (w, v, u), ties by place; all numbers and places are less than `below`."""
    if below > 1 << 21:  # a single text has millions of words
        return np.lexsort((u, v, w))
    # three numbers fit in one, and numbers sort faster by themselves than their places do
    place, mask = np.arange(len(w)), (1 << 21) - 1
    pair = np.sort(w << 42 | v << 21 | place)
    by = pair & mask
    pair >>= 21
    pair = np.cumsum(np.r_[0, pair[1:] != pair[:-1]])
    return np.sort(pair << 42 | u[by] << 21 | by) & mask


def _occurrences(buckets: int, hot: np.ndarray):
    """Packs n-gram occurrences by bucket, for mapInArrow over (doc_id, text)."""

    def flush(batch: int, doc_ids: list, parts: list[pa.Array], n_words: list[np.ndarray]) -> pa.RecordBatch:
        train, sizes = np.array([in_training(d) for d in doc_ids]), np.concatenate(n_words) + 1
        found, hashes = number_words(parts)
        last = np.cumsum(sizes) - 1
        tokens = np.full(last[-1] + 1, len(hashes), dtype=np.int64)
        is_word = np.ones(len(tokens), dtype=bool)
        is_word[last] = False
        tokens[is_word] = found
        hashes = np.r_[hashes, hash_words([END])]
        order = np.argsort(hashes)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        hashes, w = hashes[order], rank[tokens]
        first = last - sizes + 1
        v = np.r_[0, w[:-1]]
        v[first] = rank[-1]
        u = np.r_[0, v[:-1]]
        u[first] = rank[-1]
        by = _order(w, v, u, max(len(hashes), len(w)))
        place = np.argsort(~train, kind="stable")  # training documents first
        doc_ids, train = [doc_ids[i] for i in place.tolist()], train[place]
        number = np.empty(len(place), dtype=np.int64)
        number[place] = np.arange(len(place))
        doc, sizes = np.repeat(number, sizes), sizes[place]
        w, v, u, doc = w[by], v[by], u[by], doc[by]
        at = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (doc[1:] != doc[:-1])])
        freq = np.diff(np.r_[at, len(w)])
        w, v, u, doc = w[at], v[at], u[at], doc[at]
        is_hot = np.isin(hashes, hot)
        bucket = ((np.where(is_hot[w], hashes[v] ^ hashes[w] >> np.uint64(7), hashes[w]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
        by = np.sort(bucket.astype(np.int64) << 32 | np.arange(len(bucket))) & 0xFFFFFFFF
        bucket, w, v, u, doc, freq = bucket[by], w[by], v[by], u[by], doc[by], freq[by]
        known, null = np.array([0 if d is None else d for d in doc_ids], dtype=np.int64), np.array([d is None for d in doc_ids])
        rows = [(-batch - 1, batch, True, pack(known, train.astype(np.uint8), null.astype(np.uint8), sizes.astype(np.int64)))]
        cut = runs(bucket)
        for at, to in zip(cut, np.r_[cut[1:], len(bucket)], strict=True):
            x, y, z = w[at:to], v[at:to], u[at:to]
            new_w = np.r_[True, x[1:] != x[:-1]]
            new_v = new_w | np.r_[True, y[1:] != y[:-1]]
            new_u = new_v | np.r_[True, z[1:] != z[:-1]]
            pairs, triples = np.flatnonzero(new_v), np.flatnonzero(new_u)
            hv, hu = hashes[y[pairs]], hashes[z[triples]]
            rows.append((int(bucket[at]), batch, False, pack(
                hashes[x[new_w]], narrow(np.diff(np.r_[np.flatnonzero(new_w[pairs]), len(pairs)])),
                (hv >> np.uint64(32)).astype(np.uint32), (hv >> np.uint64(24)).astype(np.uint8), narrow(np.diff(np.r_[np.flatnonzero(new_v[triples]), len(triples)])),
                (hu >> np.uint64(48)).astype(np.uint16), (hu >> np.uint64(40)).astype(np.uint8), narrow(np.diff(np.r_[triples, to - at])),
                narrow(doc[at:to]), narrow(freq[at:to]), np.array([int(train.sum()), len(doc_ids)], dtype=np.int64),
            )))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, parts, n_words, total = [], [], [], 0
        for some in slices(batches, 1, SPLIT_BYTES):
            found, n = split_words(some.column(1))
            # a very long text is a batch of its own
            full = total + len(found) + len(n) > PACK_WORDS or sum(x.nbytes for x in parts) + found.nbytes > PACK_BYTES
            if doc_ids and (full or len(doc_ids) + len(n) > 60_000):
                yield flush(part << 24 | seq, doc_ids, parts, n_words)
                doc_ids, parts, n_words, total, seq = [], [], [], 0, seq + 1
            doc_ids += some.column(0).to_pylist()
            parts.append(found)
            n_words.append(n)
            total += len(found) + len(n)
        if doc_ids:
            yield flush(part << 24 | seq, doc_ids, parts, n_words)

    return run


class Bucket:
    """One bucket's occurrences and, after build(), the trie of its training n-grams."""

    def __init__(self, blocks: list[bytes], total: int, types: int, hot: dict[int, int]):
        parts, at = [], 0
        self.base = [0]
        for block in blocks:
            w, n_v, high, low, n_u, high_u, low_u, n_doc, doc, freq, (n_train, n_docs) = unpack(block)
            v = high.astype(np.uint64) << np.uint64(8) | low
            u = high_u.astype(np.uint64) << np.uint64(8) | low_u
            n_v, n_u, n_doc = (x.astype(np.int64) for x in (n_v, n_u, n_doc))
            parts.append((w, n_v, v, n_u, u, n_doc, doc.astype(np.int32) + at, freq.astype(np.int32), doc < n_train))
            at += int(n_docs)
            self.base.append(at)
        w, n_v, v, n_u, u, n_doc, self.doc, self.freq, train = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        self.tokens, token = np.unique(w, return_inverse=True)
        pairs, pair = np.unique(np.repeat(token, n_v).astype(np.uint64) << np.uint64(40) | v, return_inverse=True)
        triples, triple = np.unique(np.repeat(pair, n_u).astype(np.uint64) << np.uint64(24) | u, return_inverse=True)
        self.triple = np.repeat(triple, n_doc)
        del w, v, u
        counted = self.freq * train
        self.owner3, self.key3 = (triples >> np.uint64(24)).astype(np.int64), triples & np.uint64((1 << 24) - 1)
        self.owner2, self.key2 = (pairs >> np.uint64(40)).astype(np.int64), pairs & np.uint64((1 << 40) - 1)
        self.count3 = np.bincount(self.triple, weights=counted, minlength=len(triples))
        self.count2 = np.bincount(self.owner3, weights=self.count3, minlength=len(pairs))
        self.count1 = np.bincount(self.owner2, weights=self.count2, minlength=len(self.tokens))
        for i in np.flatnonzero(np.isin(self.tokens, np.array([*hot], dtype=np.int64).view(np.uint64))):
            self.count1[i] = hot[int(self.tokens[i : i + 1].view(np.int64)[0])]
        self.total, self.floor = total, float(total + types + 1)

    def build(self, weight: float, prior: float, bits: int) -> bytes:
        one = np.log10
        p1 = weight * prior * (self.count1 + 1) / self.floor
        p2 = weight * self.count2 + p1[self.owner2]
        p3 = self.count3 + p2[self.owner3]
        c1 = weight * (self.count1 + prior)
        c2 = self.count2 + c1[self.owner2]
        # the end of a document is followed by first words only, whatever stands before it
        end = np.flatnonzero(self.tokens == hash_words([END])[0])
        if len(end):
            c1[end] += self.count1[end]
            c2[self.owner2 == end[0]] = c1[end[0]]
        keep = [np.flatnonzero(c > 0) for c in (self.count1, self.count2, self.count3)]
        new1, new2 = (np.cumsum(c > 0) - 1 for c in (self.count1, self.count2))
        levels = [
            (keep[0], self.tokens[keep[0]], one(p1[keep[0]]), -one(c1[keep[0]])),
            (new1[self.owner2[keep[1]]], self.key2[keep[1]], one(p2[keep[1]]), -one(c2[keep[1]])),
            (new2[self.owner3[keep[2]]], self.key3[keep[2]], one(p3[keep[2]]), np.zeros(len(keep[2]))),
        ]
        top = one(2.0 * self.total + weight * prior + 2)
        return Trie.build(levels, min(one(weight * prior / self.floor), -top), max(top, 0.0), bits)

    def scores(self, trie: Trie, weight: float, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document of the bucket's blocks: sums of log10 p, of log10(c + 1), and of known tokens."""
        one = trie.descend(0, None, self.tokens)
        two = trie.descend(1, one[self.owner2], self.key2)
        three = trie.descend(2, two[self.owner3], self.key3)
        value = trie.read(trie.prob[0], one, float(np.log10(weight * prior / self.floor)))
        value = trie.read(trie.prob[1], two, value[self.owner2])
        value = trie.read(trie.prob[2], three, value[self.owner3])
        context = trie.read(trie.context[0], one, float(-np.log10(weight * prior)))
        context = trie.read(trie.context[1], two, context[self.owner2])
        value += context[self.owner3]
        token = self.owner2[self.owner3]
        n = self.base[-1]
        each = (value, np.log10(self.count1 + 1.0)[token], (self.count1 > 0)[token])
        sums = [np.bincount(self.doc, weights=self.freq * x[self.triple], minlength=n) for x in each]
        return sums[0], sums[1], sums[2].astype(np.int64)


def _model(docs: DataFrame) -> tuple[DataFrame, int, int, dict[int, int]]:
    """The occurrences of n-grams by bucket, and N, V and the hot tokens."""
    buckets = buckets_for(docs, "text")
    total, types, hot = _unigrams(docs, buckets)
    return docs.mapInArrow(_occurrences(buckets, np.array([*hot], dtype=np.int64).view(np.uint64)), _PACKED), total, types, hot


def lm_tries(docs: DataFrame, weight: float = WEIGHT, prior: float = PRIOR, bits: int = 12) -> DataFrame:
    """The model as a table of tries, one for each bucket: (bucket, trie binary). Null and empty texts are their end
    alone; repeated rows count again; an empty table has no tries. Further columns are not used."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed, total, types, hot = _model(docs)

    def build(table: pa.Table) -> pa.Table:
        trie = Bucket(table.column("block").to_pylist(), total, types, hot).build(weight, prior, bits)
        return pa.table({"bucket": pa.array([table.column("key")[0].as_py()], pa.int64()), "trie": pa.array([trie], pa.binary())})

    return packed.where("not head").groupBy("key").applyInArrow(build, "bucket long, trie binary")


def lm_scores(docs: DataFrame, weight: float = WEIGHT, prior: float = PRIOR, bits: int = 12) -> DataFrame:
    """Scores all documents by a model of those whose crc32(doc_id as text) mod 7 is not 2.

    weight, prior: a and m above. bits: of a quantised value. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. A null or empty text is its end token alone. Each input row gives one row, repeated documents
    included; a null doc_id counts as training. Without training documents, all tokens are unknown. An empty table gives
    an empty one; further columns are not carried.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed, total, types, hot = _model(docs)
    floor, folder = total + types + 1, new_folder(docs.sparkSession, "tries")

    def score(table: pa.Table) -> pa.Table:
        if table.column("head")[0].as_py():
            return table.select(["key", "batch", "head", "block"])
        bucket = Bucket(table.column("block").to_pylist(), total, types, hot)
        uri = f"{folder}/{table.column('key')[0].as_py()}-{uuid.uuid4().hex}.trie"
        store, local = open_store(uri)
        store.create_dir(local.rpartition("/")[0], recursive=True)
        with store.open_output_stream(local, compression=None) as f:
            f.write(bucket.build(weight, prior, bits))
        try:
            scores, plain, known = bucket.scores(Trie.open(uri), weight, prior)
        finally:
            store.delete_file(local)
        rows = []
        for b, i, j in zip(table.column("batch").to_pylist(), bucket.base, bucket.base[1:], strict=False):
            some = np.flatnonzero(scores[i:j])  # every occurrence adds something
            rest = (scores[i:j], plain[i:j], narrow(known[i:j])) if 2 * len(some) > j - i else (scores[i:j][some], plain[i:j][some], narrow(known[i:j][some]), planes(some))
            rows.append((-b - 1, b, False, pack(*rest)))
        return pa.Table.from_batches([_rows(rows)])

    def add(table: pa.Table) -> pa.Table:
        head, parts = None, []
        for is_head, block in zip(table.column("head").to_pylist(), table.column("block").to_pylist(), strict=True):
            if is_head:
                head = unpack(block)
            else:
                parts.append(block)
        ids, train, null, n = head
        sums = [np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)]
        for block in parts:
            found = unpack(block)
            at = from_planes(found[3]).astype(np.int64) if len(found) > 3 else slice(None)
            for into, x in zip(sums, found, strict=False):
                into[at] += x.astype(into.dtype)
        return pa.table({
            "doc_id": pa.array(ids, mask=null.astype(bool)), "held_out": train == 0, "n_tokens": n, "n_known": sums[2],
            "train_tokens": np.full(len(ids), total, dtype=np.int64), "base_score": sums[1] - n * np.log10(float(floor)), "score": sums[0],
        })

    scored = packed.groupBy("key").applyInArrow(score, _PACKED)
    return scored.groupBy("key").applyInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

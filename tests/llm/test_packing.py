"""Packing: ids against the tokenizers library, placements against their definition, numbers against plain best fit."""

from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from cueframe.llm import packing  # noqa: E402
from cueframe.llm.packing import best_fit, flows, pack_documents, packed_sequences, sweep, text_ids, to_open  # noqa: E402

from .test_tokens import TEXTS, library  # noqa: E402

WORD = "word_bpe_49k.json"


def plain_best_fit(sizes, capacity):
    """How many sequences best fit takes, the largest piece first."""
    gaps: list[int] = []
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, s)
        rest = (gaps.pop(k) if k < len(gaps) else capacity) - s
        bisect.insort(gaps, rest)
    return len(gaps)


def valid(rows, capacity):
    """rows: (sequence, offset, length); how many sequences they fill, each from 0 on without gaps."""
    found = {}
    for seq, offset, length in rows:
        found.setdefault(seq, []).append((offset, length))
    for places in found.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(found)


R = random.Random(4)
CASES = {
    "mixed": ([min(100, max(1, int(R.lognormvariate(3, 1)))) for _ in range(3000)], 100),
    "one size": ([34] * 500, 100),
    "ones": ([1] * 2000 + [99] * 7, 100),
    "halves": ([50, 51] * 200, 100),
    "full": ([100] * 30 + [1], 100),
    "large only": ([R.randrange(51, 100) for _ in range(400)], 100),
    "small only": ([R.randrange(1, 6) for _ in range(3000)], 100),
    "thirds": ([R.choice([20, 30, 33, 34, 47, 67]) for _ in range(1500)], 100),
    "one": ([7], 100),
    "none": ([], 100),
}


@pytest.mark.parametrize("case", CASES)
def test_best_fit_in_bulk(spark, case):
    sizes, capacity = CASES[case]
    items = spark.createDataFrame(list(enumerate(sizes)), "row long, size long").repartition(3)
    found = best_fit(items, capacity).collect()
    assert sorted(r.row for r in found) == list(range(len(sizes)))
    n = valid([(r.sequence_id, r.offset, sizes[r.row]) for r in found], capacity)
    assert n <= plain_best_fit(sizes, capacity) * 1.02 + 1, case
    assert n >= -(-sum(sizes) // capacity)


def test_a_sweep_alone_is_best_fit():
    for seed in range(60):
        r = random.Random(seed)
        pieces, gaps = [r.randrange(1, 60) for _ in range(r.randrange(0, 40))], [r.randrange(1, 100) for _ in range(r.randrange(0, 30))]
        rows = sorted([(-s, True, i) for i, s in enumerate(pieces)] + [(-g, False, i) for i, g in enumerate(gaps)])
        if not rows:
            continue
        size, waits, ids = np.array([-x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
        placed, left, stack, below = sweep(size, waits, ids, 100)
        # plainly: each piece into the smallest gap that holds it; what lies below the range comes into no order again
        open_gaps, homeless = sorted(gaps), []
        for s in sorted(pieces, reverse=True):
            k = bisect.bisect_left(open_gaps, s)
            if k == len(open_gaps):
                homeless.append(s)
            elif rest := open_gaps.pop(k) - s:
                bisect.insort(open_gaps, rest)
        assert sorted(s for s, x in left for _ in x) == sorted(homeless)
        assert sorted([s for s, x in stack for _ in x] + [s for s, x in below for _ in x]) == open_gaps
        assert [s for s, _ in stack] == sorted((s for s, _ in stack), reverse=True)
        used = {}
        for taken, seqs, offset in placed:
            for t, q, o in zip(taken.tolist(), seqs.tolist(), offset.tolist(), strict=True):
                used.setdefault(q, []).append((o, pieces[t]))
        for q, places in used.items():
            at = 100 - gaps[q]
            for o, s in sorted(places):
                assert o == at
                at += s
            assert at <= 100


def test_flows_pair_every_rank_once():
    waits, stays = packing._WAITS, packing._STAYS
    found, pieces, gaps, new = flows([(0, stays, 2, 90), (1, waits, 3, 40), (1, stays, 5, 35), (2, waits, 4, 30), (3, waits, 50, 10)], 1, 100)
    assert pieces == {1: 3, 2: 4, 3: 13} and new == 1 and gaps == {0: 2, 1: 5}
    assert [x[1:] for x in found if x[0] == 3] == [(0, 3, 1, 4, 3), (3, 13, -1, 0, 10)]  # one gap of 35 is left, then the new sequence
    for part, n in pieces.items():
        at = 0
        for _, a, b, *_ in sorted(x for x in found if x[0] == part):
            assert a == at
            at = b
        assert at == n


def test_new_sequences():
    assert to_open({60: 3}, {}, 100) == 3
    assert to_open({60: 3}, {61: 3}, 100) == 0
    assert to_open({40: 4, 10: 1}, {}, 100) == 2
    assert to_open({10: 30}, {10: 5}, 100) == 3


def test_ids_of_texts():
    t, enc = library(WORD), packing.encoder(P.path(WORD))
    ids, counts = text_ids(enc, TEXTS, 0)
    at = 0
    for text, n in zip(TEXTS, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 0], text
        at += n
    assert at == len(ids) and len(text_ids(enc, [], 0)[0]) == 0


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 2), (None, "no id", "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, ROW int")


@pytest.mark.parametrize("capacity", [2048, 7])
def test_documents(spark, docs, capacity):
    t = library(WORD)
    found = pack_documents(docs, P.path(WORD), capacity).collect()
    valid([(r.sequence_id, r.offset, r.length) for r in found], capacity)
    wanted = []
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            wanted.append((r.doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(wanted, key=repr)
    assert pack_documents(docs.limit(0), P.path(WORD), capacity).count() == 0


def test_sequences_hold_their_pieces(docs):
    for r in packed_sequences(docs, P.path(WORD), 300).collect():
        assert len(r.ids) == r.n_tokens == sum(p.length for p in r.pieces) <= 300
        assert all(r.ids[p.offset + p.length - 1] == 0 for p in r.pieces if p.length < 300)

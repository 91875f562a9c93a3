"""Quality sampling, decontamination and language-model scores."""

from __future__ import annotations

import math
import random
import re
import struct
import time
import zlib
from collections import Counter
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cueframe.llm import lm
from cueframe.llm.decontaminate import contaminated_documents, decontaminate, tiles
from cueframe.llm.lm import END, EliasFano, Trie, _occurrences, _order, get_bits, lm_scores, lm_tries, pack_bits
from cueframe.llm.quality import grams, part_hashes, quality_filter, quality_scores
from cueframe.llm.shared import Ids, hash_words, number_words, split_words, unpack, words

from ..conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in ("n", "r", "st", "")]


def test_quality_on_held_out_labels(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    kept = {r.doc_id: r.kept for r in quality_scores(docs, half).collect()}
    assert len(kept) == docs.count()
    other = labels.where("doc_id % 2 = 1 and (toxic = 0 or quality = 0)").collect()
    good, poor = ([kept[r.doc_id] for r in other if r.quality == q] for q in (1, 0))
    assert np.mean(good) >= 0.97 and np.mean(poor) <= 0.1


def test_quality_rejects_scattered_insults_and_keeps_long_clean_texts(spark):
    sf = SMALL.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs, r = docs.select("doc_id", "text"), random.Random(12)
    insult = re.compile(r"\b(idiot|stupid|trash|scum|disgusting|loser|pathetic|moron|clown|worthless)\b", re.I)
    good = {x.doc_id for x in labels.where("quality = 1 and coalesce(toxic, 0) = 0").collect()}
    parts = [x.text.split() for x in docs.orderBy("doc_id").collect() if x.doc_id in good and not insult.search(x.text)]
    made, spread = [], []
    for i in range(24):
        long = []
        while len(long) < (5_000, 10_000, 20_000)[i % 3]:
            long += r.choice(parts)
        made.append((10_000_000 + i, " ".join(long)))
        short = long[:600]
        short[20::60] = r.choices(["idiot", "stupid", "trash", "scum", "disgusting"], k=len(short[20::60]))
        spread.append((20_000_000 + i, " ".join(short)))
    every = docs.union(spark.createDataFrame(made + spread, docs.schema))
    kept = {x.doc_id: x.kept for x in quality_scores(every, labels).collect()}
    labelled = every.join(labels.where("toxic = 1 and quality = 1"), "doc_id").select("doc_id", "text").collect()
    toxic = [kept[x.doc_id] for x in labelled if insult.search(x.text)]
    assert len(toxic) > 200 and np.mean(toxic) <= 0.005
    assert not any(kept[i] for i, _ in spread)
    assert np.mean([kept[i] for i, _ in made]) >= 0.95
    assert np.mean([kept[i] for i in good]) >= 0.995


def test_quality_filter_keeps_columns_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 2), (1, "a b", 3), (None, None, 4), (5, "", 5)], "doc_id long, text string, log_weight int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r.log_weight for r in quality_filter(docs, none).collect()) == [2, 3, 4, 5]
    assert quality_filter(docs, none).columns == docs.columns
    labels = spark.createDataFrame([(1, 1, None), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_scores(docs, labels).count() == 4
    assert quality_scores(docs.limit(0), labels).count() == 0


def brute_tiles(a, b, least):
    marked_a, marked_b, out = set(), set(), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in marked_a and j + k not in marked_b:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if marked_a.isdisjoint(range(i, i + best)) and marked_b.isdisjoint(range(j, j + best)):
                marked_a |= set(range(i, i + best))
                marked_b |= set(range(j, j + best))
                out.append((i, j, best))


def test_tiles_against_plain_greedy_tiling():
    r = random.Random(4)
    for _ in range(120):
        a = [r.randrange(6) for _ in range(r.randrange(0, 30))]
        b = [r.randrange(6) for _ in range(r.randrange(0, 45))]
        if a and b and r.random() < 0.5:
            b[3:3] = a[len(a) // 2 :] + a[: len(a) // 2]
        mine = tiles(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), 3)
        plain = brute_tiles(a, b, 3)
        assert Counter(k for _, _, k in mine) == Counter(k for _, _, k in plain)
        assert all(a[i : i + k] == b[j : j + k] for i, j, k in mine)


def test_tiling_of_long_repetition_is_quick():
    start = time.perf_counter()
    assert tiles(np.zeros(200, dtype=np.int64), np.zeros(20_000, dtype=np.int64)) == [(0, 0, 200)]
    pattern = np.tile(np.arange(7), 6000)
    assert sum(k for _, _, k in tiles(np.tile(np.arange(7), 30)[:200], pattern)) == 200
    assert time.perf_counter() - start < 1


def test_filters_carry_columns_that_differ_in_case_only(spark):
    docs = spark.createDataFrame([(1, "one text", 1, 2, 3)], "doc_id long, text string, x int, X int, Row int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "not in it at all")], "item_id long, text string")
    for found in (quality_filter(docs, labels), decontaminate(docs, bench)):
        assert found.columns == docs.columns and [tuple(r) for r in found.collect()] == [(1, "one text", 1, 2, 3)]


def test_decontamination(spark):
    r = random.Random(6)
    text = lambda n: " ".join(r.choices(WORDS, k=n))
    items = [(i, text(40)) for i in range(8)] + [(8, "Tiny item"), (9, None), (10, "")]
    first = items[0][1].split()
    turned = " ".join([*first[25:], "so", *first[:25]])  # reordered
    rows = [
        (0, f"{text(50)} {items[1][1].upper()} {text(80)}"), (1, turned), (2, text(300)), (3, None), (4, ""),
        (5, " ".join(first[:8]) + " " + text(60)), (6, "before tiny ITEM after"), (7, text(9000) + " " + items[3][1]), (7, text(20)), (None, items[4][1]),
    ]
    docs = spark.createDataFrame([(*x, "m") for x in rows], "doc_id long, text string, matches string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8_000_000, 300):
        found = contaminated_documents(docs, bench, block_bytes=block).collect()
        hits = sorted((-1 if x.doc_id is None else x.doc_id, tuple(x.item_ids)) for x in found if x.contaminated)
        assert len(found) == len(rows) and hits == [(-1, (4,)), (0, (1,)), (1, (0,)), (6, (8,)), (7, (3,))]
    clean = decontaminate(docs, bench)
    assert clean.dtypes == docs.dtypes and {x.matches for x in clean.collect()} == {"m"}
    assert clean.count() == 5 and decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_no_contaminated_pair_is_missed(spark):
    """Permuted, shortened and interrupted passages: every pair against plain tiling, whatever runs it shares."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [[r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 12, 25]))] for _ in range(30)] + ["a b c d e f g h i j k l".split()]
    docs = ["i j k l x a b c d y e f g h".split()]
    for k in range(120):
        parts = []
        for item in r.sample(items, 2):
            cuts = sorted(r.sample(range(len(item) + 1), min(len(item), r.randrange(1, 4))))
            pieces = [item[a:b] for a, b in zip([0, *cuts], [*cuts, len(item)], strict=True)]
            r.shuffle(pieces)
            parts += [x for p in pieces for x in [*p[: r.randrange(len(p) + 1) if r.random() < 0.3 else len(p)], f"n{k}x{len(parts)}"]]
        docs.append([r.choice(words) if r.random() < 0.05 else x for x in parts])
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    share = lambda a, b: sum(t[2] for t in brute_tiles(a, b, min(3, len(a)))) / len(a)
    wanted = {i: [j for j, x in enumerate(items) if share(x, d) >= 0.5] for i, d in enumerate(docs)}
    assert wanted[0] == [30] and sum(map(bool, wanted.values())) > 60
    for block in (8_000_000, 400):
        assert {x.doc_id: x.item_ids for x in contaminated_documents(frame, bench, block_bytes=block).collect()} == wanted


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((1, 5), (200, 10_000), (200, 1 << 60)):
        values = np.unique(r.integers(0, top, n).astype(np.uint64))
        ef = EliasFano(*EliasFano.build(values))
        assert (ef.get(np.arange(len(values))) == values).all()
        zero, end = np.zeros(len(values), dtype=np.int64), np.full(len(values), len(values))
        assert (ef.find(values, zero, end) == np.arange(len(values))).all()
        others = np.setdiff1d(values + np.uint64(1), values)
        assert (ef.find(others, np.zeros(len(others), dtype=np.int64), np.full(len(others), len(values))) == -1).all()
    packed = pack_bits(np.arange(100, dtype=np.uint64), 7)
    assert (get_bits(packed, 7, np.arange(100)) == np.arange(100)).all()


def test_many_values_are_read_in_one_pass(monkeypatch):
    r = np.random.default_rng(1)
    for top in (150_000, 1 << 40):
        values = np.unique(r.integers(0, top, 50_000).astype(np.uint64))
        ef, n = EliasFano(*EliasFano.build(values)), len(values)
        assert all((ef.part(a, b) == values[a:b]).all() for a, b in ((0, n), (0, 0), (n - 1, n), (777, 4_321)))
        x = np.r_[values[10_000:30_000], values[20_000:40_000] + np.uint64(1)]
        begin, end = np.full(len(x), 12_000), np.full(len(x), 35_000)
        place = np.searchsorted(values, x)
        wanted = np.where((values[np.minimum(place, n - 1)] == x) & (place >= 12_000) & (place < 35_000), place, -1)
        asked = []
        plain = lm._select
        monkeypatch.setattr(lm, "_select", lambda bits, before, i, clear=False: asked.append(len(i)) or plain(bits, before, i, clear))
        assert (ef.find(x, begin, end) == wanted).all()
        assert sum(asked) <= 10  # a search of each would ask for 100,000 places at the least
        monkeypatch.setattr(lm, "DENSE", 0)
        assert (ef.find(x, begin, end) == wanted).all()
        monkeypatch.undo()


def test_words_by_arrow_are_those_of_python():
    r = random.Random(2)
    signs = [*"aZÄé\x1c\x85\xa0\u2003\u3000 😀İ\x00", *" \t\n\x0b\x0c\r", " ", " "]
    texts = ["", None, " ", " \n", "a", " a", "a ", *("".join(r.choices(signs, k=r.randrange(12))) for _ in range(3_000))]
    for kind in (pa.string(), pa.large_string()):
        for some in (texts, texts[:4], []):
            found, n = split_words(pa.array([None, *some], kind).slice(1))
            wanted = [words(t) for t in some]
            assert n.tolist() == [len(w) for w in wanted] and found.to_pylist() == [x for w in wanted for x in w]
            ids, hashes = number_words([found, found[:2]])
            assert hashes[ids].tolist() == hash_words([x for w in wanted for x in w] + found[:2].to_pylist()).tolist()


def test_order_of_three_numbers():
    r = np.random.default_rng(3)
    w, v, u = (np.r_[r.integers(0, 9, 4_000), (1 << 21) - 1, 0] for _ in range(3))
    for below in (1 << 21, 1 << 22):
        assert (_order(w, v, u, below) == np.lexsort((u, v, w))).all()


def test_words_are_counted_by_the_batch():
    r = random.Random(4)
    text = " ".join(r.choices([f"{w}é" for w in WORDS] + WORDS, k=400_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": [text, text.upper()]})
    start, ids = time.process_time(), Ids()
    assert sum(len([ids[w] for w in words(x)]) for x in batch["text"].to_pylist()) == 800_000
    by_word, mine = time.process_time() - start, []
    for _ in range(2):
        start = time.process_time()
        with mock.patch.object(lm.TaskContext, "get", lambda: mock.Mock(partitionId=lambda: 0)):
            rows = pa.Table.from_batches([*_occurrences(4, np.array([], dtype=np.uint64))(iter([batch]))]).to_pylist()
        mine.append(time.process_time() - start)
    assert min(mine) < 0.7 * by_word  # it took as long and longer when words were numbered one by one
    assert sum(int((unpack(x["block"])[9]).sum()) for x in rows if not x["head"]) == 800_002
    assert unpack(rows[0]["block"])[3].tolist() == [400_001, 400_001]
    assert hash_words([END])[0] in np.concatenate([unpack(x["block"])[0] for x in rows if not x["head"]])


def test_long_words_are_packed_apart(monkeypatch):
    monkeypatch.setattr(lm, "SPLIT_BYTES", 1_000)
    monkeypatch.setattr(lm, "PACK_BYTES", 10_000)
    monkeypatch.setattr(lm.TaskContext, "get", lambda: mock.Mock(partitionId=lambda: 0))
    texts = [f"{'x' * 900}{i} a" for i in range(40)] + ["y" * 50_000, None, "b"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(43), pa.int64()), "text": texts})
    rows = pa.Table.from_batches([*_occurrences(4, np.array([], dtype=np.uint64))(iter([batch]))]).to_pylist()
    heads = [unpack(x["block"])[3] for x in rows if x["head"]]
    assert len(heads) >= 6 and sum(x.sum() for x in heads) == 40 * 3 + 2 + 1 + 2
    assert sum(int(unpack(x["block"])[9].sum()) for x in rows if not x["head"]) == 125


def test_scores_against_a_plain_model(spark, tmp_path):
    r = random.Random(8)
    docs = [(i, None if i == 3 else "" if i == 4 else " ".join(r.choices(WORDS[: 5 + i], k=r.randrange(0, 80)))) for i in range(90)]
    docs += [(10, docs[10][1]), (None, "Bast ban"), (91, "the " * 3000)]
    tokens = [[w for w in WORD.findall((t or "").lower())] + ["\n"] for _, t in docs]
    train = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2 for d, _ in docs]
    one, two, three = Counter(), Counter(), Counter()
    before = lambda w: zip(["\n", "\n", *w][: len(w)], ["\n", *w[:-1]], w, strict=True)
    for w, yes in zip(tokens, train, strict=True):
        if yes:
            one.update(w)
            two.update((y, z) for _, y, z in before(w))
            three.update(before(w))
    n, v, a, m = sum(one.values()), len(one), 0.01, 200.0
    p = lambda w: (one[w] + 1) / (n + v + 1)
    history = Counter()  # how often two tokens stand before another
    for (x, y, _), c in three.items():
        history[x, y] += c
    chance = lambda x, y, z: (three[x, y, z] + a * (two[y, z] + m * p(z))) / (history[x, y] + a * (one[y] + m))
    everything = sum(chance("\n", "\n", z) for z in one) + chance("\n", "\n", "unknown")
    assert everything == pytest.approx(1)
    wanted = Counter()
    for (d, _), w, yes in zip(docs, tokens, train, strict=True):
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10(chance(*x)) for x in before(w))
        wanted[d, not yes, len(w), sum(one[x] > 0 for x in w), n, round(base, 6)] = score
    frame = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(5)
    found = lm_scores(frame).collect()
    assert len(found) == len(docs)
    for x in found:
        key = (x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6))
        assert key in wanted and x.score == pytest.approx(wanted[key], abs=0.003 * x.n_tokens)
    assert lm_scores(frame.limit(0)).count() == 0
    block = lm_tries(frame).first().trie
    (tmp_path / "trie").write_bytes(bytes(block))
    mapped = Trie.open(str(tmp_path / "trie"))
    whole = Trie(bytes(block))
    assert [k.n for k in mapped.keys] == [k.n for k in whole.keys] and mapped.keys[2].n > 0
    i = np.arange(mapped.keys[0].n)
    assert (mapped.descend(0, None, whole.keys[0].get(i)) == i).all()


def plain_quality(docs, labels, keep=0.995):
    """The weights of quality_scores, written with dictionaries: {row: log weight}, and the level."""
    window, gate, prior, margin, strength = 32, 3.0, 0.5, 0.5, 5.0
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[p for w in WORD.findall(lower(t)) for p in re.findall(r"\w+|\W+", w)] for _, t in docs]
    # features are places of a table, which some of them share; only these places are the operator's own
    hashes = part_hashes()
    places = [[x.tolist() for x in grams(t, hashes)] for _, t in docs]
    assert all((len(one), len(two)) == (len(t), max(0, len(t) - 1)) for (one, two), t in zip(places, tokens, strict=True))
    assert all(two[i] == 1 for (_, two), t in zip(places, tokens, strict=True) for i in range(len(two)) if t[i] == t[i + 1])
    features = [one + two for one, two in places]
    ids = sorted(labels, key=lambda x: (xxhash.xxh64_intdigest(struct.pack("<q", x[0]), seed=42) ^ 1 << 63, x[0]))
    part = {d: (q == 1 and t == 0, i % 2 == 1) for i, (d, q, t) in enumerate(ids)}
    role = [part.get(d, (False, False)) for d, _ in docs]
    raw, target, raw_docs, target_docs, later = Counter(), Counter(), Counter(), Counter(), Counter()
    n = n_target = 0
    for f, (good, calibration) in zip(features, role, strict=True):
        if f:
            n += 1
            raw.update(f)
            raw_docs.update(set(f))
            if good and calibration:
                later.update(f)
            elif good:
                n_target += 1
                target.update(f)
                target_docs.update(set(f))

    def ratio(all_of, of_target, share):
        out = {}
        for x, c in all_of.items():
            expected = c * share
            if abs(of_target[x] - expected) >= gate * math.sqrt(expected + 1):
                out[x] = float(np.float32(math.log((of_target[x] + prior) / (expected + prior))))
        return out

    value = ratio(raw, target, sum(target.values()) / sum(raw.values()))
    against = {x: min(v, 0.0) for x, v in ratio(raw_docs, target_docs, n_target / n).items() if x != 1}
    drift = -2 * sum(against.get(x, 0) * c for x, c in later.items()) / max(1.0, sum(later.values()) / 2)
    scores = []
    for t, two in places:
        v = [value.get(x, 0) + (value.get(two[i - 1], 0) if i else 0) for i, x in enumerate(t)]
        low = min(sum(v[i : i + window]) for i in range(len(v) - window + 1)) if len(v) > window else sum(v)
        run, worst = 0.0, 0.0  # the least sum of any run
        for i, x in enumerate(t):
            run = min(run, 0.0) + against.get(x, 0) + drift + (against.get(two[i - 1], 0) if i else 0)
            worst = min(worst, run)
        scores.append((low, worst, len(t)))
    tail = [sorted(s[k] for s, (good, calibration) in zip(scores, role, strict=True) if good and calibration) for k in range(3)]
    m, out = len(tail[0]), 1 - keep
    ends = [(x[int(m * out)], max(x[int(m * out)], x[min(m - 1, int(m * min(0.5, 10 * out)))])) for x in tail[:2]]
    levels = [min(-strength, a - margin * (b - a)) for a, b in ends]
    slopes, size = [(b - a) / math.log(10) for a, b in ends], max(1, tail[2][m // 2])
    weights = []
    for low, worst, k in scores:
        longer = math.log(max(1.0, k / size))
        weights.append(min(low + slopes[0] * longer, (worst + slopes[1] * longer) * levels[0] / levels[1]))
    return weights, levels[0]


def test_quality_against_plain_dictionaries(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 500").collect()] + [(None, None), (900_000, ""), (900_001, "buy")]
    labels = [(r.doc_id, r.quality, r.toxic or 0) for r in spark.read.parquet(f"{sf}/labels.parquet").where("doc_id < 500").collect()]
    found = quality_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    weights, level = plain_quality(docs, labels)
    mine = {r.doc_id: r for r in found}
    for (d, _), w in zip(docs, weights, strict=True):
        assert mine[d].log_weight == pytest.approx(w, abs=1e-4), d
    # the sample has as many documents as reach the level
    assert sum(r.kept for r in found) == sum(w >= level for w in weights) > 300
    assert mine[None].kept and mine[900_000].kept and mine[None].log_weight == 0

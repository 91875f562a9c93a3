"""Speakers of recordings against plain Python that compares all with all."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueframe.operators import speakers

SCHEMA = "key int, ord long, start_us long, end_us long, embedding array<double>, pitch array<double>"


def unit(v):
    if v is None or not v or None in v:
        return None
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if 0 < n < math.inf else None


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def median(values):
    return sorted(values)[len(values) // 2] if len(values) >= 5 else None


def gender(values):
    return None if (m := median(values)) is None else "male" if m < 160 else "female"


def mean(vectors):
    return unit([sum(x) for x in zip(*vectors, strict=True)]) or [0.0] * len(vectors[0])


def plain_clusters(vectors, least):
    groups = [[i] for i in range(len(vectors))]
    alike = [[dot(a, b) for b in vectors] for a in vectors]
    while len(groups) > 1:
        scored = [(round(sum(alike[p][q] for p in a for q in b) / len(a) / len(b), 9), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        top, i, j = max(scored)
        if top < least:
            break
        groups[-i] += groups.pop(-j)
    return groups


def plain_merge(groups, vectors, pitch):
    groups = [list(g) for g in groups]
    while True:
        best = None
        for i, a in enumerate(groups):
            for j, b in enumerate(groups[i + 1 :], i + 1):
                x, y = (median([h for k in g for h in pitch[k]]) for g in (a, b))
                if x is not None and y is not None and abs(x - y) > 40:
                    continue
                s = round(dot(mean([vectors[k] for k in a]), mean([vectors[k] for k in b])), 9)
                if s >= 0.5 and (best is None or s >= best[0]):
                    best = (s, i, j)
        if best is None:
            return groups
        groups[best[1]] += groups.pop(best[2])


def plain_characters(groups, vectors, pitch, length, measured):
    total = lambda g: sum(length[k] for k in g)
    sex = lambda g: gender([h for k in g for h in pitch[k]])
    lines_needed, speech_needed = min(max(round(len(measured) * 0.01), 2), 5), min(max(int(total(measured) * 0.02), 4_000_000), 12_000_000)
    ordered = sorted(groups, key=lambda g: -total(g))
    kept = [list(g) for g in ordered if len(g) >= lines_needed or total(g) >= speech_needed][:24]
    if not kept:
        return [list(g) for g in groups], []
    means, sexes, placed, minor = [mean([vectors[k] for k in g]) for g in kept], [sex(g) for g in kept], {k for g in kept for k in g}, []

    def nearest(v, own):
        scored = [(round(dot(v, m), 9), -i) for i, m in enumerate(means)]
        fits = [x for x in scored if own is None or sexes[-x[1]] is None or sexes[-x[1]] == own]
        s, i = max(fits or scored)
        return -i, s

    for g in ordered:
        if placed & set(g):
            continue
        m = mean([vectors[k] for k in g])
        i, s = nearest(m, sex(g))
        if s < 0.4 and len(kept) < 24 and len(g) >= 2 and total(g) >= 3_000_000:
            kept.append(list(g))
            means.append(m)
            sexes.append(sex(g))
            minor.append(len(kept) - 1)
        else:
            kept[i] += g
        placed |= set(g)
    for k in measured:
        if k not in placed:
            kept[nearest(vectors[k], sex([k]))[0]].append(k)
    return kept, minor


def plain_neighbours(rows, owner, vectors, pitch):
    groups = {}
    for k, g in owner.items():
        groups.setdefault(g, []).append(k)
    sexes = {g: gender([h for k in ks for h in pitch[k]]) for g, ks in groups.items()}
    out, taken = dict(owner), set()
    for i, r in enumerate(rows):
        if i in owner:
            continue
        best, same, d = None, None, 1
        while d < len(rows) and (best is None or d < 4):
            for j in (i - d, i + d):
                if 0 <= j < len(rows) and j in owner:
                    gap = r[2] - rows[j][3] if j < i else rows[j][2] - r[3]
                    if best is None or gap < best[0]:
                        best = (gap, j)
                    if gender(pitch[i]) is not None and sexes[owner[j]] == gender(pitch[i]) and (same is None or gap < same[0]):
                        same = (gap, j)
            d += 1
        pick = same if same is not None and same[0] <= 3_000_000 else best
        if pick:
            out[i] = owner[pick[1]]
            taken.add(i)
    return out, taken


def plain_speakers(lines):
    """{ord: (speaker, by_neighbour)}, {speaker: (lines, pitch, gender)} of one recording."""
    rows = sorted((r for r in lines if r[3] > r[2]), key=lambda r: (r[2], r[1]))
    vectors, pitch, length = [unit(r[4]) for r in rows], [r[5] or [] for r in rows], [r[3] - r[2] for r in rows]
    measured = [i for i, v in enumerate(vectors) if v is not None]
    reliable = [i for i in measured if length[i] >= 1_200_000]
    reliable = measured if len(reliable) < 3 else reliable
    # groups are in the order of ord, as their names are
    by_ord = sorted(reliable, key=lambda i: rows[i][1])
    groups = [[by_ord[k] for k in g] for g in plain_clusters([vectors[i] for i in by_ord], 0.36)]
    kept, _ = plain_characters(plain_merge(groups, vectors, pitch), vectors, pitch, length, measured)
    owner, taken = plain_neighbours(rows, {i: g for g, k in enumerate(kept) for i in k}, vectors, pitch)
    owner = {i: owner.get(i, 0) for i in range(len(rows))}
    count = {}
    for g in owner.values():
        count[g] = count.get(g, 0) + 1
    number = {g: k for k, g in enumerate(sorted(count, key=lambda g: (-count[g], g)), 1)}
    heard = {number[g]: [h for i in owner if owner[i] == g for h in pitch[i]] for g in count}
    return {rows[i][1]: (number[g], i in taken) for i, g in owner.items()}, {number[g]: (count[g], median(heard[number[g]]), gender(heard[number[g]])) for g in count}


def recording(key, r, n, people, d=4, spread=0.5):
    voices = [[r.gauss(0, 1) for _ in range(d)] for _ in range(people)]
    low = [r.choice([110.0, 150.0, 165.0, 220.0]) for _ in range(people)]
    out, at = [], 0
    for i in range(n):
        p = r.randrange(people)
        start = at + r.randrange(0, 4_000_000)
        end = start + r.choice([300_000, 900_000, 1_200_000, 2_000_000, 4_500_000])
        vector = [x + r.gauss(0, spread) for x in voices[p]] if r.random() < 0.8 else None
        if out and r.random() < 0.15:
            vector = out[-1][4]  # a copy
        out.append((key, i, start, end, vector, [float(round(low[p] + r.gauss(0, 15))) for _ in range(r.randrange(0, 12))] if r.random() < 0.9 else None))
        at = end
    return out


@pytest.fixture(scope="module")
def lines():
    r = random.Random(11)
    return [row for key in range(300) for row in recording(key, r, r.randrange(0, 28), r.randrange(1, 7), spread=r.choice([0.1, 0.5, 1.0]))]


def of(rows, key):
    return [r for r in rows if r[0] == key]


@pytest.mark.parametrize("most", [speakers.MOST_LINES, 4])
def test_average_linkage(spark, lines, most, monkeypatch):
    rows = lines if most > 100 else [r for r in lines if r[0] < 60]
    monkeypatch.setattr(speakers, "BLOCK", 5)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for r in speakers.clustered(df, most=most).collect():
        found.setdefault(r.key, {}).setdefault(r.grp, []).append(r.ord)
    for key in {r[0] for r in rows}:
        mine = [(r[1], unit(r[4])) for r in of(rows, key) if r[4] is not None]
        wanted = [sorted(mine[k][0] for k in g) for g in plain_clusters([v for _, v in mine], 0.36)]
        assert sorted(map(sorted, found.get(key, {}).values())) == sorted(wanted), key
        assert all(g == min(k) for g, k in found.get(key, {}).items())


def test_odd_vectors(spark):
    rows = [(1, 1, 0, 1, None, None), (1, 2, 0, 1, [], None), (1, 3, 0, 1, [0.0, 0.0], None), (1, 4, 0, 1, [1.0, None], None), (1, 5, 0, 1, [math.inf, 1.0], None), (1, 6, 0, 1, [1.0, 0.0], None), (1, 7, 0, 1, [1.0], None), (None, 8, 0, 1, [1.0, 1.0], None)]
    found = {tuple(r) for r in speakers.clustered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found >= {(1, 6, 6), (1, 7, 6)} and {r[1] for r in found} <= {6, 7, 8}
    assert speakers.clustered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merging_alike_groups(spark, lines):
    r = random.Random(3)
    grouped = [(*row, r.randrange(0, 6) if row[4] is not None and r.random() < 0.95 else None) for row in lines]
    # the name of a group is its first line's number
    first = {}
    for row in grouped:
        if row[6] is not None:
            first.setdefault((row[0], row[6]), row[1])
    grouped = [(*row[:6], first.get((row[0], row[6]))) for row in grouped]
    found = {(x.key, x.ord): x.grp for x in speakers.merged_alike(spark.createDataFrame(grouped, SCHEMA + ", grp long")).collect()}
    assert len(found) == len(lines)
    for key in range(300):
        mine = of(grouped, key)
        groups = {}
        for k, row in enumerate(mine):
            if row[6] is not None:
                groups.setdefault(row[6], []).append(k)
            else:
                assert found[key, row[1]] is None
        merged = plain_merge([groups[g] for g in sorted(groups)], [unit(x[4]) for x in mine], [x[5] or [] for x in mine])
        for g in merged:
            assert {found[key, mine[k][1]] for k in g} == {mine[min(g, key=lambda k: mine[k][1])][1]} or len({found[key, mine[k][1]] for k in g}) == 1
        assert len({found[key, mine[k][1]] for g in merged for k in g}) == len(merged)


def test_characters(spark, lines):
    r = random.Random(5)
    grouped = [(*row, r.randrange(0, 9) if row[4] is not None and r.random() < 0.7 else None) for row in lines]
    found = {(x.key, x.ord): (x.owner, x.role) for x in speakers.characters(spark.createDataFrame(grouped, SCHEMA + ", grp long")).collect()}
    for key in range(300):
        mine = of(grouped, key)
        vectors, pitch, length = [unit(x[4]) for x in mine], [x[5] or [] for x in mine], [x[3] - x[2] for x in mine]
        groups = {}
        for k, row in enumerate(mine):
            if row[6] is not None:
                groups.setdefault(row[6], []).append(k)
        measured = [k for k, v in enumerate(vectors) if v is not None]
        kept, minor = plain_characters([groups[g] for g in sorted(groups)], vectors, pitch, length, measured) if groups else ([], [])
        wanted = {(key, mine[k][1]): i for i, g in enumerate(kept) for k in g}
        got = {k: v[0] for k, v in found.items() if k[0] == key}
        assert got == wanted, key
        assert {v[0] for k, v in found.items() if k[0] == key and v[1] == "minor"} == set(minor)


def test_speakers_of_recordings(spark, lines):
    rows = [*lines, (900, 1, 0, 500_000, None, None), (900, 2, 600_000, 700_000, None, [200.0] * 6), (901, 1, 5, 5, [1.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("grp", F.lit("clash")).withColumn("SPEAKER", F.lit(1))
    placed, people = speakers.find_speakers(df)
    found, who = {}, {}
    for r in placed.collect():
        found.setdefault(r.key, {})[r.ord] = (r.speaker, r.by_neighbour)
    for r in people.collect():
        who.setdefault(r.key, {})[r.speaker] = (r.lines, r.pitch_hz, r.gender)
        assert r.embedding is None or np.isclose(np.linalg.norm(r.embedding), 1)
    for key in {r[0] for r in rows}:
        a, b = plain_speakers(of(rows, key))
        assert found.get(key, {}) == a, key
        assert who.get(key, {}) == b, key
    assert found[900] == {1: (1, False), 2: (1, False)} and 901 not in found

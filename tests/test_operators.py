"""Properties of the operators on made-up rows."""

from __future__ import annotations

import random

import pytest

from cueframe.operators import folds, intervals, ranks
from cueframe.plans import pipelines

SCHEMA = "key int, ord int, start_us long, end_us long"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    made = [(k, i, s := r.randrange(0, 100_000), s + r.randrange(0, 9_000)) for k in range(6) for i in range(80)]
    return spark.createDataFrame([*made, (None, 0, 5, 9)], SCHEMA)


def by_key(found, *columns):
    out = {}
    for r in sorted(found.select("key", *columns).where("key is not null").collect(), key=lambda r: tuple(r)):
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return out


def test_union_is_disjoint_and_covers_the_same(rows):
    united = by_key(intervals.unite(rows), "start_us", "end_us")
    given = by_key(rows, "start_us", "end_us")
    for key, parts in united.items():
        assert all(a[1] < b[0] for a, b in zip(parts, parts[1:]))
        assert {x for s, e in parts for x in range(s, e, 97)} <= {x for s, e in parts for x in range(s, e)}
        covered = set().union(*(range(s, e) for s, e in given[key]))
        assert sum(e - s for s, e in parts) == len(covered)


def test_subtraction_leaves_what_is_not_covered(spark, rows):
    minus = rows.where("ord < 10")
    left = by_key(intervals.subtract(rows.where("ord >= 10"), minus), "ord", "start_us", "end_us")
    for key, parts in left.items():
        gone = set().union(*(range(r.start_us, r.end_us) for r in minus.where(f"key = {key}").collect()))
        for r in rows.where(f"key = {key} and ord >= 10").collect():
            mine = set().union(set(), *(range(s, e) for o, s, e in parts if o == r.ord))
            assert mine == set(range(r.start_us, r.end_us)) - gone


def test_scheduled_rows_do_not_overlap(rows):
    placed = by_key(folds.without_overlap(rows), "placed_us", "ends_us", "late_us")
    for parts in placed.values():
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:])) and all(p[2] >= 0 for p in parts)


def test_chunks_stay_short(rows):
    packed = folds.packed(rows, 20_000, 300, 3_000, 1_000).where("key is not null").collect()
    assert all(r.length_us <= 20_000 for r in packed) and {r.chunk for r in packed} >= {1, 2}


def test_renumbering(rows):
    assert all([n for (n,) in parts] == [*range(1, len(parts) + 1)] for parts in by_key(intervals.renumber(rows), "idx").values())


def test_overlap_pairs_equal_a_plain_join(rows):
    a, b = rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1")
    found = {(r.key, r.ord, r.r_ord) for r in intervals.overlap_pairs(a, b, 4_000).collect()}
    plain = {(x.key, x.ord, y.ord) for x in a.collect() for y in b.collect() if x.key is not None and x.key == y.key and max(x.start_us, y.start_us) < min(x.end_us, y.end_us)}
    assert found == plain


def test_two_points():
    assert intervals.two_points(0, 1_000_000, 10_000_000, 12_000_000) == (1.1, 1_000_000)
    with pytest.raises(ValueError):
        intervals.two_points(0, 0, 500_000, 500_000)


def test_empty_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert intervals.unite(empty).count() == folds.without_overlap(empty).count() == intervals.subtract(empty, empty).count() == 0


def plain_offset(rows, spans, reach, step):
    on = {f for s, e in spans for f in range(s, e)}
    if not on:
        return 0, 0.0, 0.0
    lo, hi = min(on), max(on) + 1
    score = lambda d: sum(100 if f in on else -35 for s, e in rows for f in range(max(s + d, lo), min(e + d, hi)))
    coarse = [(score(d), -d) for d in range(-reach, reach + 1, step)]
    best = max(coarse)
    fine = max((score(d), -d) for d in range(-best[1] - step, -best[1] + step + 1))
    best = fine if fine[0] > best[0] else best
    values = sorted(s for s, _ in coarse)
    return -best[1], best[0] / 100, min(1.0, max(0.0, (best[0] - values[len(values) // 2]) / max(1e-7, values[-1] - values[0])))


def test_offsets_in_two_passes(spark):
    r, left, right, wanted = random.Random(5), [], [], {}
    for k in range(14):
        spans, at = [], 0
        for _ in range(0 if k == 3 else 12):
            at += r.randrange(2, 15)
            spans.append((at, at := at + r.randrange(1, 9)))
        shift = (7, -5, 3, 0, 11, -13)[k % 6]  # no whole number of steps
        rows = [(s - shift, e - shift) for s, e in spans] or [(4, 9)]
        if k == 4:
            rows = [(9_000, 9_010)]
        wanted[k] = plain_offset(rows + rows[:1], spans, 20, 4)
        left += [(k, i, s * 10, e * 10) for i, (s, e) in enumerate(rows + rows[:1])] + [(k, 99, 50, 50)]
        right += [(k, i, s * 10, e * 10) for i, (s, e) in enumerate(spans)]
    found = intervals.detect_offset(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 200, 40, 10).collect()
    assert {x.key: (x.offset_us // 10, x.score, pytest.approx(x.confidence)) for x in found} == wanted
    assert wanted[0][0] == 7 and wanted[1][0] == -5 and wanted[3] == (0, 0.0, 0.0)


def test_ranks_with_values_far_out(spark):
    r = random.Random(4)
    groups = {"far": [r.random() for _ in range(3_000)] + [1e300, -1e300], "same": [5.0] * 700, "one": [2.5], "wild": [float("inf"), float("-inf"), float("nan"), 1.0, 1.0], "odd": [float("inf"), float("nan")]}
    groups[None] = [float(r.randrange(9)) for _ in range(500)]
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]] + [("nothing", None)]
    wanted = {"median": ranks.median(), "low": ranks.truncated(0.15), "high": ranks.rounded(0.95)}
    found = {x.key: x for x in ranks.at_ranks(spark.createDataFrame(rows, "key string, v double").repartition(5), ["key"], "v", wanted).collect()}
    assert set(found) == set(groups)
    for key, vs in groups.items():
        s, n = sorted(vs, key=lambda v: (v != v, v)), len(vs)
        places = {"median": n // 2, "low": min(int(n * 0.15), n - 1), "high": round(0.95 * (n - 1))}
        assert found[key].n == n
        assert all(repr(found[key][name]) == repr(s[k]) for name, k in places.items()), key
    assert ranks.at_ranks(spark.createDataFrame([], "key string, v double"), ["key"], "v", wanted).count() == 0


def test_main_language_of_equal_speech_is_the_first_by_name(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 10, "ru", 1.0), (1, 1, 10, 20, "de", 1.0), (2, 0, 0, 11, "ru", 1.0), (2, 1, 11, 21, "de", 1.0)], SCHEMA + ", language string, prob double")
    found = {tuple(r) for r in pipelines.scene_languages(pieces).collect()}
    assert found == {(1, "ru", 0, 10), (2, "de", 11, 21)}

"""Text read from pictures against plain Python, frame by frame."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cueframe.functions import fuzzy, ocr
from cueframe.functions.text import letters_key
from cueframe.operators import readings

from .test_brute_force import distance_table


def alike(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else 1 - distance_table(a, b, False)[-1] / max(len(a), len(b))


def key(text):
    return "".join(c for c in (text or "").lower() if c.isalnum())


def same(a, b):
    if not a or not b:
        return False
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    return alike(a, b) >= 0.75 or (len(s) >= 5 and len(s) >= 0.6 * len(t) and 1 - min(distance_table(s, t, True)) / len(s) >= 0.85)


def unlike(texts):
    kept = []
    for t in map(key, texts):
        if t and all(alike(k, t) < 0.75 for k in kept):
            kept.append(t)
    return len(kept)


def half_even(x):
    return round(x)


def percentile(values, p):
    v = sorted(values)
    return v[min(max(half_even(p * (len(v) - 1)), 0), len(v) - 1)]


def test_similarities_at_once():
    r = random.Random(1)
    words = ["".join(r.choices("abc", k=r.randrange(0, 9))) for _ in range(60)]
    for w in words[:20]:
        assert fuzzy.similarities(w, words) == pytest.approx([alike(w, x) for x in words])
        assert [fuzzy.same_key(w, x) for x in words] == [same(w, x) for x in words]
    assert len(fuzzy.similarities("a", [])) == 0


# rows of boxes


def plain_rows(boxes):
    """boxes: (text, x, y, width, height) -> the same of rows."""
    rows = []
    for b in sorted((b for b in boxes if (b[0] or "").strip(" ")), key=lambda b: (b[2] + b[4] / 2, b[1], b[0])):
        for r in rows:
            top, bottom, left, right = min(x[2] for x in r), max(x[2] + x[4] for x in r), min(x[1] for x in r), max(x[1] + x[3] for x in r)
            overlap = min(bottom, b[2] + b[4]) - max(top, b[2])
            gap = max(b[1] - right, left - (b[1] + b[3]))
            if overlap >= 0.5 * min(bottom - top, b[4]) and gap <= 4 * max(bottom - top, b[4]):
                r.append(b)
                break
        else:
            rows.append([b])
    out = []
    for r in rows:
        o = sorted(r, key=lambda x: x[1])
        left, top = min(x[1] for x in o), min(x[2] for x in o)
        out.append((r[0][0] if len(r) == 1 else " ".join(x[0].strip(" ") for x in o), left, top, max(x[1] + x[3] for x in o) - left, max(x[2] + x[4] for x in o) - top))
    return out


BOXES = "key int, sample int, text string, x double, y double, width double, height double, frame_width int, frame_height int"


def test_rows_of_boxes(spark):
    r = random.Random(2)
    frames = {(k, s): [(r.choice(["ab", " cd ", "e", "", None, "ff gg"]), float(r.randrange(0, 60)), float(r.randrange(0, 30)), float(r.randrange(1, 15)), float(r.randrange(2, 8))) for _ in range(r.randrange(0, 9))] for k in range(8) for s in range(20)}
    frames[9, 0] = [("a", 0.0, 0.0, 10.0, 10.0), ("c", 40.0, 8.0, 10.0, 10.0), ("b", 20.0, 4.0, 10.0, 10.0)]  # a and c meet only through b
    rows = [(k, s, *b, 100, 50) for (k, s), boxes in frames.items() for b in boxes]
    found = {}
    for x in readings.merged_rows(spark.createDataFrame(rows, BOXES).withColumn("boxes", F.lit("clash"))).collect():
        found.setdefault((x.key, x.sample), []).append((x.text, x.x, x.y, x.width, x.height))
    assert len(found[9, 0]) == 1
    for at, boxes in frames.items():
        assert sorted(found.get(at, [])) == sorted(plain_rows(boxes)), at
    assert readings.merged_rows(spark.createDataFrame([], BOXES)).count() == 0


# cues of frames


def plain_cues(frames, interval, good, least_frames=2):
    """frames: (time, cleaned text) in order; good: the quality of each text."""

    def best(reads):
        distinct = list(dict.fromkeys(reads))
        score = lambda c: round(sum(reads.count(o) * alike(key(c), key(o)) for o in distinct) / len(reads) + 0.5 * good[c] + 0.001 * reads.count(c), 9)
        return max(distinct, key=lambda c: (score(c), -distinct.index(c)))

    fits = lambda a, b: same(key(a), key(b))
    groups, i = [], 0
    while i < len(frames):
        if not frames[i][1]:
            i += 1
            continue
        first = last = i
        reads, j = [frames[i][1]], i + 1
        while j < len(frames):
            now = best(reads)
            if frames[j][1] and fits(frames[j][1], now):
                reads.append(frames[j][1])
                last = j
            elif not (j + 1 < len(frames) and frames[j + 1][1] and fits(frames[j + 1][1], now)):
                break
            j += 1
        groups.append([first, last, reads])
        i = last + 1
    merged = []
    for g in groups:
        if merged and frames[g[0]][0] - frames[merged[-1][1]][0] <= interval * 3.01 and fits(best(merged[-1][2]), best(g[2])):
            merged[-1][1] = g[1]
            merged[-1][2] += g[2]
        else:
            merged.append(g)
    needed = max(least_frames, math.ceil(0.7 / (interval / 1e6) - 1e-9))
    cues = [[frames[a][0], frames[b][0] + interval, best(reads)] for a, b, reads in merged if len(reads) >= needed and good[best(reads)] >= 0.5]
    for a, b in zip(cues, cues[1:], strict=False):
        a[1] = min(a[1], b[0])
    return [(i, *c) for i, c in enumerate(cues, 1)]


FRAMES = "key int, time_us long, text string"


def against_plain(spark, rows, interval):
    df = spark.createDataFrame(rows, FRAMES)
    texts = df.select("text", ocr.clean("text").alias("c"), ocr.quality(ocr.clean("text")).alias("q"), letters_key(ocr.clean("text")).alias("k")).distinct().collect()
    cleaned, good = {t.text: t.c for t in texts}, {t.c: t.q for t in texts}
    assert all(key(t.c) == t.k for t in texts)
    found = {}
    for c in readings.frame_cues(df.withColumn("n", F.lit("clash")), interval).collect():
        found.setdefault(c.key, []).append((c.ord, c.start_us, c.end_us, c.text))
    for k in {r[0] for r in rows}:
        mine = sorted((t, cleaned[x]) for kk, t, x in rows if kk == k)
        assert sorted(found.get(k, [])) == plain_cues(mine, interval, good), k
    return found


def test_cues_of_frames(spark):
    r = random.Random(7)
    said = ["Where have you been all day?", "I was looking for you", "Nothing happened", "We have to go now\nbefore they come", "Oh", "1 2", "Where have you been today?"]

    def jitter(text):
        chars = list(text)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            chars[r.randrange(len(chars))] = r.choice("|lI1x~")
        return r.choice(["", "", "", "| "]) + "".join(chars)

    rows = []
    for k in range(60):
        t = 0
        for _ in range(r.randrange(0, 7)):
            text = r.choice(said)
            for _ in range(r.randrange(1, 9)):
                rows.append((k, t, jitter(text) if r.random() < 0.9 else r.choice(["", None, "~~", "zkq wvx"])))
                t += 200_000
            for _ in range(r.choice([0, 1, 3])):
                rows.append((k, t, ""))
                t += 200_000
    found = against_plain(spark, rows, 200_000)
    assert sum(map(len, found.values())) > 60


def test_fixtures_of_frames(spark):
    line, step = "Where have you been all day?", 250_000
    of = lambda k, texts: [(k, i * step, t) for i, t in enumerate(texts)]
    rows = [
        *of(1, [line, line.replace("h", "b", 1), line, "| " + line]),  # jitter
        *of(2, [line, line, "hcnksj", line, line]),  # one bad frame
        *of(3, [line, line, "", "", line, line]),  # a line split by two misreads
        *of(4, [line, line]),  # shorter than 0.7 s
        *of(5, [line, line, line, "", "", "", "", line, line, line]),  # too far apart
        *of(6, ["hcnksj wmch"] * 5),  # reads as garbage
        *of(7, [None, "", None]),
    ]
    found = against_plain(spark, rows, step)
    assert {k: len(v) for k, v in found.items()} == {1: 1, 2: 1, 3: 1, 5: 2}
    assert found[1][0] == (1, 0, 4 * step, line) and found[3][0][2] == 6 * step


# where subtitles stand


def test_unlike_texts(spark):
    r = random.Random(4)
    rows = [(g, "x", i, r.choice([None, "", "!?", "".join(r.choices("abcd", k=r.randrange(1, 9)))])) for g in range(30) for i in range(r.randrange(0, 40))]
    found = {x.g: x.n for x in readings.unlike(spark.createDataFrame(rows, "g int, k string, ord int, text string"), ["g"]).collect()}
    for g in range(30):
        assert found.get(g, 0) == unlike([x[3] for x in rows if x[0] == g])


def plain_band(blocks):
    """blocks: (sample, ord, anchor, text) in order -> (centre, score, members)."""
    fine = [round(b[2] * 10**9) for b in blocks]
    best = (None, -1, [])
    for c in dict.fromkeys(fine):
        near = [a for a in fine if abs(a - c) <= 25_000_000]
        centre = math.floor(sum(near) / len(near) + 0.5)
        members = [b for b, a in zip(blocks, fine, strict=True) if abs(a - centre) <= 25_000_000]
        if members:
            score = unlike([m[3] for m in members]) * 1000 + len({m[0] for m in members})
            score = score / 2 if 300_000_000 < centre < 700_000_000 else score
            if score > best[1]:
                best = (centre, score, members)
    return best


def test_densest_band(spark):
    r = random.Random(6)
    rows = []
    for k in range(40):
        usual = r.random()
        for s in range(r.randrange(0, 20)):
            for o in range(r.randrange(1, 3)):
                anchor = usual + r.gauss(0, 0.02) if r.random() < 0.6 else r.random()
                rows.append((k, s, o, round(anchor, 3), r.choice(["one two", "one tvo", "other words", "something else", "x", ""])))
    found = {x.key: x for x in readings.densest_band(spark.createDataFrame(rows, "key int, sample int, ord int, anchor double, text string"), ["key"]).collect()}
    for k in range(40):
        mine = [x[1:] for x in rows if x[0] == k]
        centre, score, _ = plain_band(mine)
        assert (found[k].centre * 10**9, found[k].score) == (pytest.approx(centre), score) if mine else k not in found


def plain_area(boxes, samples):
    """boxes: (sample, text, x, y, w, h, light); a frame is 200 x 100."""
    n = len(samples)
    often = {}
    for k in {(b[0], key(b[1])) for b in boxes}:
        often[k[1]] = often.get(k[1], 0) + 1
    static = {k for k, c in often.items() if k and n >= 4 and c >= math.ceil(n * 0.6)}
    blocks = []
    for s in sorted(samples):
        lines = sorted((b for b in boxes if b[0] == s and key(b[1]) not in static and sum(c.isalpha() for c in b[1] or "") >= 2 and 0.02 <= b[5] / 100 <= 0.16 and abs(b[2] + b[4] / 2 - 100) / 200 <= 0.2 and b[4] / 200 >= 0.04), key=lambda b: (b[3], b[2], b[1]))
        stacks = []
        for b in lines:
            last = stacks[-1][-1] if stacks else None
            if last and b[3] - last[3] - last[5] <= 0.9 * max(last[5], b[5]) and abs(b[2] + b[4] / 2 - last[2] - last[4] / 2) <= 30:
                stacks[-1].append(b)
            else:
                stacks.append([b])
        for o, st in enumerate(stacks, 1):
            if len(st) <= 3:
                blocks.append((s, o, min(b[3] for b in st) / 100, max((b[3] + b[5]) / 100 for b in st), st, "\n".join(b[1].strip(" ") for b in st)))
    low = [b for b in blocks if (b[2] + b[3]) / 2 >= 0.5]
    high = [b for b in blocks if (b[2] + b[3]) / 2 < 0.5]
    down, up = plain_band([(b[0], b[1], b[3], b[5]) for b in low]), plain_band([(b[0], b[1], b[2], b[5]) for b in high])
    top_side = up[1] > down[1]
    centre, _, members = up if top_side else down
    ids = {(m[0], m[1]) for m in members}
    chosen = [b for b in (high if top_side else low) if (b[0], b[1]) in ids]
    if not chosen:
        return (False, n, 0, 0.78, 0.96, "bottom", 0.055, True, None, [], sorted(static))
    centre /= 10**9
    line = percentile([b[5] / 100 for c in chosen for b in c[4]], 0.5)
    margin = line * 0.35
    if top_side:
        top, bottom = percentile([c[2] for c in chosen], 0.05) - margin, max(max(c[3] for c in chosen), centre + 3 * line) + margin
    else:
        bottom, top = percentile([c[3] for c in chosen], 0.95) + margin, min(min(c[2] for c in chosen), centre - 3 * line) - margin
    top = min(max(top, 0), 1)
    bottom = max(min(bottom, 1), top + 0.02)
    hits = len({c[0] for c in chosen})
    light = [b[6] for c in chosen for b in c[4] if b[6] is not None and b[6] >= 0]
    preview = min(chosen, key=lambda c: (-min(len(c[4]), 2), -len(c[5]), c[0], c[1]))[0]
    return (hits >= max(3, math.ceil(n * 0.1)) and unlike([c[5] for c in chosen]) >= 3, n, hits, top, bottom, "top" if top_side else "bottom", line, not light or percentile(light, 0.75) >= 0.06, preview, [(c[0], c[5]) for c in chosen][:12], sorted(static))


def test_subtitle_area(spark):
    r = random.Random(9)
    said = ["Where are you", "I am here now", "Nothing at all", "Come with me", "ab", "1!", "They left early", " Not yet "]
    boxes, frames = [], []
    for k in range(40):
        place, small = r.choice([80, 85, 10, 45]), r.random() < 0.3
        for s in range(r.choice([0, 1, 3, 5, 12, 30])):
            frames.append((k, s))
            if r.random() < 0.8:
                boxes.append((k, s, "LOGO TV", 90.0, 2.0, 20.0, 5.0, 200, 100, None))
            for n in range(r.choice([0, 1, 1, 1, 2, 5])):
                boxes.append((k, s, r.choice(said), 70.0 + r.randrange(0, 20), float(place + 6 * n + r.randrange(0, 2)), float(r.randrange(6, 60)), float(r.choice([5, 6] if not small else [1, 5])), 200, 100, r.choice([None, -1.0, 0.01, 0.05, 0.3])))
            if r.random() < 0.3:
                boxes.append((k, s, r.choice(["EXIT", "Open late"]), 80.0, float(r.randrange(0, 90)), 30.0, 6.0, 200, 100, 0.2))
    df = spark.createDataFrame(boxes, BOXES + ", light double").withColumn("k", F.lit("clash"))
    found = {x.key: x for x in readings.subtitle_area(df, spark.createDataFrame(frames, "key int, sample int")).collect()}
    assert len(found) == len({f[0] for f in frames}) and len({x.position for x in found.values()}) == 2
    for k, x in found.items():
        wanted = plain_area([(b[1], *b[2:7], b[9]) for b in boxes if b[0] == k], {s for kk, s in frames if kk == k})
        got = (x.likely, x.samples, x.hits, x.band_top, x.band_bottom, x.position, x.line_height, x.light_text, x.preview, [tuple(e) for e in x.examples], x.static)
        assert [pytest.approx(v) if isinstance(v, float) else v for v in wanted] == list(got), k


def test_cues_of_boxes(spark):
    frames, boxes = [], []
    for s in range(12):
        frames.append((1, s, s * 250_000, 6.0))
        if s < 10:
            text = ["Where have", "you been?"] if s < 5 else ["Nothing", "happened here"]
            boxes += [(1, s, text[0], 60.0, 80.0, 30.0, 6.0, 200, 100), (1, s, text[1], 95.0, 81.0, 40.0, 6.0, 200, 100), (1, s, "EXIT", 0.0, 10.0, 20.0, 6.0, 200, 100)]
    found = readings.read_cues(spark.createDataFrame(boxes, BOXES), spark.createDataFrame(frames, "key int, sample int, time_us long, high double"), 250_000, "high").collect()
    assert sorted(tuple(x) for x in found) == [(1, 1, 0, 1_250_000, "Where have you been?"), (1, 2, 1_250_000, 2_500_000, "Nothing happened here")]

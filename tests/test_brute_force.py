"""Operators that SQL cannot express, against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cueframe.functions import fuzzy, lines, ocr
from cueframe.operators import folds, intervals, names, review, vectors
from cueframe.sources import probe

SCHEMA = "key int, ord int, start_us long, end_us long"


def column(spark, rows, kind, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kind}")
    return [tuple(r) for r in df.orderBy("i").select(*columns).collect()]


def distance_table(part, whole, free):
    row = [0 if free else j for j in range(len(whole) + 1)]
    for i, a in enumerate(part, 1):
        new = [i]
        for j, b in enumerate(whole, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return row


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_distances_with_free_ends(spark):
    r = random.Random(1)
    rows = [("".join(r.choices("abé漢", k=r.randrange(0, 12))), "".join(r.choices("abé漢", k=r.randrange(0, 20)))) for _ in range(150)] + [(None, "a"), ("a", None)]
    found = column(spark, rows, "a string, b string", fuzzy.partial_similarity("a", "b"), fuzzy.coverage("a", "b"))
    for (a, b), (fits, covered) in zip(rows, found, strict=True):
        if a is None or b is None:
            assert fits is None and covered is None
        else:
            assert fits == pytest.approx(1 - min(distance_table(a, b, True)) / len(a) if a else 0.0)
            assert covered == pytest.approx(common(a, b) / len(a) if a else 1.0)
    pairs = [("The Hollywood movie", "Holywood movies!", True), ("abc", "abd", False), ("", "x", False), ("Ａｂｃ def", "abcdef", True), ("anything", "", True)]
    assert [x for (x,) in column(spark, [p[:2] for p in pairs], "a string, b string", fuzzy.nearly_contains("a", "b"))] == [p[2] for p in pairs]
    assert column(spark, [("Hello there", "Hel1o there |"), ("aaaa", "bbbb"), ("", "a"), ("the quick fox", "xx the quick fox yy")], "a string, b string", fuzzy.same_reading("a", "b")) == [(True,), (False,), (False,), (True,)]


def test_quality_of_readings(spark):
    rows = ["Hello there", "hcnksj wmch", "I'M don't McDonald", "1st 90s 12:30", "HH-a", "漢字", "", None, "a b", "~~ || x", "l'homme est là"]
    found = [x for (x,) in column(spark, [(r,) for r in rows], "x string", ocr.quality("x"))]
    assert found[:6] == [1.0, 0.0, 1.0, 1.0, 0.0, 1.0] and found[6:8] == [0.0, 0.0] and found[8] == pytest.approx(0.5) and found[9] == pytest.approx(0.0) and found[10] == pytest.approx(5 / 11)
    assert column(spark, [("| One _ two ?\n.\n x",), (None,)], "x string", ocr.clean("x")) == [("One two ?",), ("",)]


def test_best_readings_against_all_pairs(spark):
    r = random.Random(2)
    base = ["What are you doing here", "I will not go", "Nothing"]
    noisy = lambda t: "".join(r.choice("xq|~") if r.random() < 0.12 else c for c in t)
    rows = [(g, noisy(base[g % 3])) for g in range(5) for _ in range(40)] + [(9, "same")] * 3 + [(None, "x"), (7, None)]
    rows += [(8, f"reading {i} of many") for i in range(700)]  # more than one block
    found = {x.grp: x for x in vectors.best_reading(spark.createDataFrame(rows, "grp int, txt string")).collect()}
    key = lambda t: re.sub(r"[\W_]", "", t.lower())
    quality = dict(zip([t for _, t in rows if t], [q for (q,) in column(spark, [(t,) for _, t in rows if t], "x string", ocr.quality("x"))], strict=True))
    alike = lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else 1 - distance_table(a, b, False)[-1] / max(len(a), len(b))
    for g in range(5):
        mine = [t for k, t in rows if k == g]
        best = max(sum(alike(key(t), key(o)) for o in mine) / len(mine) + 0.5 * quality[t] + 0.001 * mine.count(t) for t in mine)
        assert found[g].score == pytest.approx(best, abs=1e-8) and found[g].txt in mine
    assert found[9].txt == "same" and 7 not in found and found[8].txt.startswith("reading")
    least = {x.grp: x.cost for x in vectors.medoid(spark.createDataFrame(rows, "grp int, txt string")).collect()}
    for g in range(5):
        mine = [t for k, t in rows if k == g]
        assert least[g] == min(sum(distance_table(t, o, False)[-1] for o in mine) for t in mine)


def test_nearest_centers_in_blocks(spark):
    r = random.Random(3)
    made = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(600)]
    rows = spark.createDataFrame(made[:40] + [(900, [0.0] * 6), (901, None)], "vec_id long, embedding array<double>")
    centers = spark.createDataFrame(made, "label int, embedding array<double>")
    found = {x.vec_id: x.center for x in vectors.nearest_center(rows, centers).collect()}
    assert found == {**{i: i for i in range(40)}, 900: None, 901: None}
    assert {x.center for x in vectors.nearest_center(rows, centers.limit(0)).collect()} == {None}


def test_uncovered_stretches(spark):
    r = random.Random(4)
    speech, cues = [], []
    for k in range(8):
        at = 0
        for i in range(12):
            at += r.randrange(0, 900)
            speech.append((k, i, at, at := at + r.randrange(50, 2500)))
        cues += [(k, i, s := r.randrange(0, at), s + r.randrange(0, 900)) for i in range(14)]
    found = {}
    for x in intervals.uncovered(spark.createDataFrame(speech, SCHEMA), spark.createDataFrame(cues, SCHEMA), 15, 20, 50, 60, 700, 1000).collect():
        found.setdefault(x.key, set()).add((x.start_us, x.end_us))
    for k in range(8):
        gone = {t for c, _, s, e in cues if c == k for t in range(s - 15, e + 15)}
        pieces = []
        for c, _, s, e in speech:
            if c == k:
                part = [t for t in range(s, e) if t not in gone]
                for t in part:
                    if pieces and pieces[-1][1] == t and pieces[-1][2] == (s, e):
                        pieces[-1][1] = t + 1
                    else:
                        pieces.append([t, t + 1, (s, e)])
        joined = []
        for a, b, _ in sorted(p for p in pieces if p[1] - p[0] >= 20):
            if joined and a - joined[-1][1] < 50 and b - joined[-1][0] <= 700:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        wanted = {(t, min(t + 700, b)) for a, b in joined if b - a >= 60 for t in range(a, b, 700)}
        assert found.get(k, set()) == {w for w in wanted if w[1] - w[0] >= 60}


def test_loops_of_lines(spark):
    texts = ["start", *["so it is", "yes indeed", "well"] * 4, "end of it", *["no"] * 3, *["ab", "cd"] * 3, "x"]
    rows = [(1, i, i * 10, i * 10 + 5, t) for i, t in enumerate(texts)]
    found = intervals.drop_loops(spark.createDataFrame(rows, SCHEMA + ", text string"), "text").orderBy("ord").collect()
    kept = [r.text for r in found if not r.looped]
    assert kept == ["start", "so it is", "yes indeed", "well", "end of it", "no", "no", "no", "ab", "cd", "x"]


def plain_loops(keys, given, longest=8, least=4):
    drop = list(given)
    for i in range(len(keys)):
        if drop[i]:
            continue
        for p in range(2, longest + 1):
            block = keys[i : i + p]
            if i + 2 * p > len(keys) or keys[i + p : i + 2 * p] != block or sum(map(len, block)) < least:
                continue
            at = i + p
            while keys[at : at + p] == block and at + p <= len(keys):
                drop[at : at + p] = [True] * p
                at += p
            break
    return [d and not g for d, g in zip(drop, given, strict=True)]


def test_loops_against_plain_reading(spark):
    r = random.Random(3)
    series = [list("ABABA"), list("AAAAA"), list("ABCABCA"), ["aaaa", "bbbb"] * 3]
    series = [[x * 2 for x in s] for s in series] + [r.choices(["", "ab", "cde", "f"], weights=[1, 4, 4, 2], k=r.randrange(0, 40)) for _ in range(700)]
    series += [[x for _ in range(r.randrange(1, 5)) for x in r.choices(["ab", "cd", "ef", "g"], k=r.randrange(1, 6)) * r.randrange(1, 5)] for _ in range(400)]
    given = [[r.random() < 0.1 for _ in s] if k % 2 else [False] * len(s) for k, s in enumerate(series)]
    rows = [(k, i, i * 10, i * 10 + 5, t, g) for k, (s, gs) in enumerate(zip(series, given, strict=True)) for i, (t, g) in enumerate(zip(s, gs, strict=True))]
    found = {(x.key, x.ord): x.looped for x in intervals.drop_loops(spark.createDataFrame(rows, SCHEMA + ", text string, done boolean"), "text", given="done").collect()}
    for k, (s, gs) in enumerate(zip(series, given, strict=True)):
        mine = [found[k, i] and not gs[i] for i in range(len(s))]
        assert mine == plain_loops(s, gs), s
    odd = [(None, 1, 0, 1, "abab"), (1, 1, None, 1, "abab"), (1, 2, 0, None, "abab")]
    assert [x.looped for x in intervals.drop_loops(spark.createDataFrame(odd, SCHEMA + ", text string"), "text").collect()] == [False] * 3


def plain_readable(cues, limit, gap=84_000, most=7_000_000):
    """cues: [start, end, characters] in order -> (start, end, outcome)."""
    cues, out = [list(c) for c in cues], []
    for i, (start, end, n) in enumerate(cues):
        if end <= start or n / ((end - start) / 1e6) <= limit:
            out.append("fine")
            continue
        target = min(round(n / limit * 1e6), most)
        latest = cues[i + 1][0] - gap if i + 1 < len(cues) else start + target
        new_end = max(end, min(start + target, latest))
        earliest = cues[i - 1][1] + gap if i else 0
        new_start = min(start, max(earliest, new_end - target)) if new_end - start < target else start
        cues[i][:2] = new_start, new_end
        out.append("fixed" if n / ((new_end - new_start) / 1e6) <= limit + 0.05 else "improved" if new_end - new_start > end - start else "no room")
    return [(c[0], c[1], o) for c, o in zip(cues, out, strict=True)]


def test_reading_speed(spark):
    r = random.Random(8)
    series = [[[0, 8_000_000, 200]], [[0, 2_000_000, 200]], [[5, 5, 20]]]
    for _ in range(1000):
        at, cues = r.randrange(0, 3_000_000), []
        for _ in range(r.randrange(0, 9)):
            length = r.choice([0, 300_000, 1_000_000, 2_500_000, 8_000_000])
            cues.append([at, at + length, r.choice([0, 3, 20, 45, 90, 300])])
            at += max(1, length + r.choice([-200_000, 0, 50_000, 500_000, 4_000_000]))
        series.append(sorted(cues))
    rows = [(k, i, a, b, n) for k, s in enumerate(series) for i, (a, b, n) in enumerate(s)]
    found = {(x.key, x.ord): (x.new_start_us, x.new_end_us, x.outcome) for x in folds.readable(spark.createDataFrame(rows, SCHEMA + ", chars int"), "chars", 20.0).collect()}
    for k, s in enumerate(series):
        assert [found[k, i] for i in range(len(s))] == plain_readable(s, 20.0), s
    assert [found[k, 0][2] for k in range(3)] == ["no room", "improved", "fine"]


def test_phrases_over_rows(spark):
    rows = [(1, 0, 0, 5, "thank"), (1, 1, 6, 9, "youfor"), (1, 2, 10, 12, "watching"), (1, 3, 13, 14, "x"), (1, 4, 15, 16, "thank"), (1, 5, 900, 901, "youfor"), (1, 6, 902, 903, "watching"), (1, 7, 904, 905, None)]
    found = intervals.phrase_runs(spark.createDataFrame(rows, SCHEMA + ", k string"), "k", ["thankyouforwatching"], 8, 300)
    assert sorted(r.ord for r in found.collect()) == [0, 1, 2]


def test_names(spark):
    said = "Kim Deok-gi and Su-jin met Dr. Park, Prof Lee. Doctor Ichida? twenty-one Well-known Han Self-made"
    assert column(spark, [(said,), (None,)], "x string", F.array_sort(names.names_in("x"))) == [(["Ichida", "Kim Deok-gi", "Park", "Su-jin"],), ([],)]
    counts = spark.createDataFrame([("Ichida", 8), ("Ichiza", 1), ("Ichido", 5), ("Deok-gi", 3), ("Gi-young", 2), ("Da-ki", 1), ("Kim Seong-hoon", 9), ("Kim Seung-hon", 2)], "name string, n int")
    assert {(r.name, r.usual) for r in names.merge_targets(counts).collect()} == {("Ichiza", "Ichida"), ("Kim Seung-hon", "Kim Seong-hoon")}
    assert {(r.name, r.other) for r in names.suggestions(counts).collect()} == {("Da-ki", "Deok-gi")}
    listed = names.parse_list("# show\nIchida = Ichiza, ichida , Itchida\nPark\n")
    assert listed == {"Ichida": ["Ichiza", "Itchida"], "Park": []}
    texts = spark.createDataFrame([("ITCHIDA saw Ichiza's Ichizas",)], "text string")
    assert names.with_list(texts, listed).first().text == "Ichida saw Ichida's Ichizas"
    assert names.add_to_list("Ichida = Ichiza\nPark", "ichiza", ["Itsida"]) == "Ichida = Ichiza, Itsida\nPark" and names.add_to_list(None, "A", []) == "A"


def test_lines_for_translation(spark):
    rows = [("{\\an8}<i>One |\n  two</i>",), ("- Yes.\n- <b>No</b>.",), ("",), (None,)]
    made = [x.asDict() for (x,) in column(spark, rows, "x string", lines.prepared("x"))]
    assert made[0] == {"text": "One / two", "prefix": "{\\an8}", "italic": True, "two_speakers": False}
    assert made[1] == {"text": "- Yes. / - No.", "prefix": "", "italic": False, "two_speakers": True} and made[2] == made[3]
    answers = [("{\\an8}<i>One\ntwo</i>", " - *Uno*  dos /"), ("- Yes.\n- No.", "Sí. / - No."), ("a", "")]
    found = column(spark, answers, "x string, y string", lines.restored(lines.prepared("x"), "y", 42))
    assert found == [("{\\an8}<i>Uno dos</i>",), ("- Sí.\n- No.",), ("a",)]
    assert column(spark, [("A|2\nB| 9\nC|x\nA|1",)], "x string", lines.matched_answers("x", 3, 4)) == [([2, None, None],)]
    assert column(spark, [("No. No. No. Yes!",), ("No. No.",)], "x string", lines.without_repeats("x")) == [("No. No. Yes!",), ("No. No.",)]
    assert column(spark, [("{\\an8}x", "<i>a</i>\n b"), ("x", "")], "x string, y string", lines.stacked("x", "y")) == [('{\\an8}<font color="#B0B0B0">a b</font>\nx',), ("x",)]


def test_review_of_long_lines(spark):
    pairs = [(1, i, "short reply of words" + " and more" * (i == 5) * 9, "an original line here") for i in range(25)] + [(1, 30, "Да, Дмитрий said so", "an original"), (1, 31, None, "words"), (1, 32, "it is", "Is it?"), (1, 33, "x", None)]
    found = {r.ord: r.flag for r in review.reviewed(spark.createDataFrame(pairs, "key int, ord int, text string, original string")).collect()}
    assert found[5] == "too long" and found[30] == "leftover" and found[31] == "missing" and found[32] == "question" and found[33] is None
    assert {found[i] for i in range(25) if i != 5} == {None}


def test_originals_in_step_and_by_overlap(spark):
    kind = SCHEMA + ", text string"
    a = [(1, i, i * 1000, i * 1000 + 500, f"t{i}") for i in range(3)] + [(2, i, i * 1000, i * 1000 + 900, f"u{i}") for i in range(2)]
    b = [(1, i, i * 1000 + 20, i * 1000 + 30, f"<i>o{i}</i>") for i in range(3)] + [(2, 0, 0, 400, "p0"), (2, 1, 450, 900, "p1"), (2, 2, 1100, 1300, "p2")]
    found = review.originals_of(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 1000, 60).collect()
    assert {(r.key, r.ord): r.original for r in found} == {(1, 0): "o0", (1, 1): "o1", (1, 2): "o2", (2, 0): "p0\np1", (2, 1): "p2"}


def test_change_logs_and_profiles(spark):
    text = "# t\n- before\n## 1.2\n\n### Fixed\n- one\n  goes on\n- two\n\ntext\n## 1.1\n- old\n"
    found = probe.change_log(spark.createDataFrame([("k", text)], "key string, text string")).orderBy(F.desc("version"), "n").collect()
    assert [(r.version, r.heading, r.bullet) for r in found] == [("1.2", "Fixed", "one goes on"), ("1.2", "Fixed", "two"), ("1.1", None, "old"), (None, None, "before")]
    json = '[{"cat":"Session","name":"model_run","ts":5,"dur":5},{"cat":"Node","name":"a","ts":1,"dur":9,"args":{"op_name":"Conv","provider":"CPU"}},{"cat":"Session","name":"model_run","ts":20,"dur":50},{"cat":"Node","name":"b","ts":30,"dur":4,"args":{"op_name":"Conv","provider":"CPU"}},{"cat":"Node","name":"c","ts":40,"dur":3,"args":{"op_name":"Add","provider":"CPU"}}]'
    found = probe.profile(spark.createDataFrame([("k", json), ("bad", "{")], "key string, json string")).collect()
    assert {(r.op, r.provider, r.n, r.total_us) for r in found} == {(None, "CPU", 2, 7), ("Conv", "CPU", 1, 4), ("Add", "CPU", 1, 3)}


def test_written_language(spark):
    rows = [("a", "안녕하세요 여러분 hello"), ("b", "これは日本語の文章です"), ("c", "漢字漢字漢字漢字漢字"), ("d", "Γειά σου κόσμε"), ("e", "plain words here"), ("f", "漢字"), ("g", "Привет, как дела"), ("h", None)]
    found = {r.g: r.language for r in review.written_language(spark.createDataFrame(rows, "g string, t string"), "g", "t").collect()}
    assert found == {"a": "ko", "b": "ja", "c": "zh", "d": "el", "e": None, "f": None, "g": None, "h": None}


def test_pieces_of_long_lines(spark):
    from cueframe.functions.splitting import pieces_of, split_lines

    said = "This is a first sentence of some length. And here is another one, with a comma, that goes on and on until it is far too wide for two lines of a screen."
    parts = pieces_of(said, 0, 12_000_000, 42, 2, 7_000_000, 85_000)
    assert " ".join(t for t, _, _ in parts) == said and all(len(t) <= 84 for t, _, _ in parts) and parts[0][0].endswith("comma,")
    assert all(a[2] <= b[1] for a, b in zip(parts, parts[1:], strict=False)) and parts[0][1] == 0
    assert pieces_of("one", 0, 60_000_000, 42, 2, 7_000_000, 85_000) == [("one", 0, 832_500)]
    assert len(pieces_of("漢" * 60, 0, 9_000_000, 42, 2, 7_000_000, 85_000)) == 2 and pieces_of("x" * 200, 0, 9, 42, 2, 7_000_000, 85_000) == [("x" * 200, 0, 9)]
    found = column(spark, [(said, 0, 12_000_000), (None, 0, 5)], "t string, a long, b long", split_lines()("t", "a", "b"))
    assert [tuple(p) for p in found[0][0]] == parts and found[1][0] is None


def test_trimming_to_speech(spark):
    from cueframe.plans.pipelines import shape_transcript, trim_to_speech

    s = 1_000_000
    cues = [(1, 0, 0, 10 * s), (2, 0, 0, 10 * s), (3, 0, 0, 4 * s), (4, 0, 0, 10 * s), (5, 0, 0, 10 * s)]
    speech = [(1, 2 * s, 5 * s), (3, 0, 3 * s + 500_000), (4, 1 * s, 5 * s), (4, 9 * s, 9 * s + 500_000), (5, 0, s // 2), (5, 3 * s, 8 * s)]
    found = {r.key: (r.start_us, r.end_us) for r in trim_to_speech(spark.createDataFrame(cues, SCHEMA), spark.createDataFrame(speech, "key int, start_us long, end_us long")).collect()}
    assert found == {1: (1_850_000, 5_300_000), 2: (0, 10 * s), 3: (0, 4 * s), 4: (850_000, 5_300_000), 5: (2_850_000, 8_300_000)}
    heard = [(1, 0, 0, 2 * s, " Hello   there. ", 0.9, 0.1), (1, 1, 2 * s, 3 * s, "Thank you for watching!", 0.9, 0.1), (1, 2, 3 * s, 4 * s, "mumble", 0.2, 0.9), (1, 3, 5 * s, 6 * s, "!!", 0.9, 0.0), (1, 4, 6 * s, 7 * s, None, 0.9, 0.0)]
    heard += [(1, 5 + i, (8 + i) * s, (9 + i) * s, "Again.", 0.9, 0.0) for i in range(4)]
    shaped = shape_transcript(spark.createDataFrame(heard, SCHEMA + ", text string, prob double, no_speech double")).orderBy("ord").collect()
    assert [r.text for r in shaped] == ["Hello there.", "Again.", "Again."]


def test_recognising_people(spark):
    from cueframe.functions.maths import cosine
    from cueframe.operators.people import recognised

    r = random.Random(9)
    vector = lambda: [r.gauss(0, 1) for _ in range(4)]
    speakers = [(k, i, vector()) for k in range(4) for i in range(7)] + [(0, 99, None), (None, 1, vector())]
    people = [(k, i, vector()) for k in range(4) for i in range(6)]
    a, b = spark.createDataFrame(speakers, "key int, speaker int, embedding array<double>"), spark.createDataFrame(people, "key int, person int, embedding array<double>")
    alike = {(k, s, p): c for k, s, p, c in a.join(b.withColumnRenamed("embedding", "e2"), "key").select("key", "speaker", "person", F.round(cosine("embedding", "e2"), 9)).collect() if c is not None and c >= 0.5}
    wanted, taken = set(), set()
    for (k, s, p), _ in sorted(alike.items(), key=lambda x: (x[0][0], -x[1], x[0][1], x[0][2])):
        if (k, "s", s) not in taken and (k, "p", p) not in taken:
            taken |= {(k, "s", s), (k, "p", p)}
            wanted.add((k, s, p))
    assert {(x.key, x.speaker, x.person) for x in recognised(a, b).collect()} == wanted and len(wanted) > 6


def test_recognising_people_from_cut_lists(spark, monkeypatch):
    from cueframe.functions.maths import cosine
    from cueframe.operators import people as people_of

    monkeypatch.setattr(people_of, "LISTED", 2)
    monkeypatch.setattr(people_of, "LISTED_BY_KEY", 0)
    monkeypatch.setattr(people_of, "BLOCK", 8)
    r = random.Random(5)
    # many equal scores, copies, and names with more than one vector
    vector = lambda: [float(r.randint(-1, 1)) for _ in range(r.choice([3, 3, 3, 2]))]
    speakers, people = ([(k, r.randrange(30), vector()) for k in range(3) for _ in range(40)] for _ in range(2))
    a, b = spark.createDataFrame(speakers, "key int, speaker int, embedding array<double>"), spark.createDataFrame(people, "key int, person int, embedding array<double>")
    alike = [tuple(x) for x in a.join(b.withColumnRenamed("embedding", "e2"), "key").select("key", "speaker", "person", F.round(cosine("embedding", "e2"), 9)).collect()]
    wanted, taken = [], set()
    for k, s, p, c in sorted((x for x in alike if x[3] is not None and x[3] >= 0.3), key=lambda x: (x[0], -x[3], x[1], x[2])):
        if (k, "s", s) not in taken and (k, "p", p) not in taken:
            taken |= {(k, "s", s), (k, "p", p)}
            wanted.append((k, s, p, c))
    assert sorted(tuple(x) for x in people_of.recognised(a, b, 0.3).collect()) == sorted(wanted) and len(wanted) > 40


def test_a_voice_that_is_no_number_is_nobody(spark):
    from cueframe.operators.people import recognised

    nan, inf = float("nan"), float("inf")
    speakers = spark.createDataFrame([(1, 1, [nan, 1.0]), (1, 2, [inf, 1.0]), (1, 3, [None, 1.0]), (1, 4, []), (1, 5, [3.0, 4.0])], "key int, speaker int, embedding array<double>")
    people = spark.createDataFrame([(1, 6, [nan, 0.0]), (1, 7, [1.0, 1.0]), (1, 8, None)], "key int, person int, embedding array<double>")
    assert [tuple(x) for x in recognised(speakers, people).collect()] == [(1, 5, 7, 0.989949494)]


def test_cosines_are_rounded_as_spark_rounds_them(spark):
    import numpy as np

    from cueframe.operators.people import _billionths

    r = random.Random(3)
    values = [r.uniform(-1, 1) for _ in range(300)] + [round(r.uniform(-1, 1), 9) + d for d in (5e-10, -5e-10) for _ in range(300)] + [0.0, -1e-10, 1.0, -1.0, 1.0000000000000002]
    rounded = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9)).collect()]
    assert (_billionths(np.array(values)) / 1e9).tolist() == rounded


def test_voices_of_speakers(spark):
    from cueframe.operators.people import with_voices

    rows = [(1, "a", "male", 50, "m1", False), (1, "b", "male", 40, "m1", False), (1, "c", None, 30, None, False), (1, "d", "female", 20, "m2", False), (1, "e", "female", 10, "f1", True), (1, "f", "female", 5, "", None), (1, "g", "male", 3, None, False), (2, "a", "male", 1, "f2", True)]
    found = with_voices(spark.createDataFrame(rows, "key int, speaker string, gender string, lines int, voice string, by_hand boolean"), {"female": ["f1", "f2", "f3"], "male": ["m1", "m2"]})
    assert {(r.key, r.speaker): r.voice for r in found.collect()} == {(1, "a"): "m1", (1, "e"): "f1", (1, "b"): "m2", (1, "c"): "f2", (1, "d"): "f3", (1, "f"): "f1", (1, "g"): "m1", (2, "a"): "f2"}


def test_shapes_of_voices(spark):
    import math

    from cueframe.operators.voices import sung, voice_shape

    r = random.Random(6)
    lines_of = {k: [r.choice([None, 0.0, *[200 * 2 ** (r.choice([0, 0.3, 0.9, 4]) / 12)] * 5]) for _ in range(120)] for k in range(6)} | {7: [220.0] * 200, 8: [None, 0.0, 0.0]}
    found = {x.key: x for x in voice_shape(spark.createDataFrame([(k, i, v) for k, t in lines_of.items() for i, v in enumerate(t)], "key int, frame int, hz double")).collect()}
    for k, t in lines_of.items():
        voiced, held, longest, i = sum(v is not None and v > 0 for v in t), 0, 0, 0
        while i < len(t):
            if not t[i]:
                i += 1
                continue
            total, j = math.log2(t[i]), i + 1
            while j < len(t) and t[j] and abs(12 * (math.log2(t[j]) - total / (j - i))) < 1.0:
                total, j = total + math.log2(t[j]), j + 1
            held += (j - i) * ((j - i) * 30 >= 250)
            longest, i = max(longest, j - i), j
        runs = [len(x) for x in "".join("v" if v else "-" for v in t).split("-") if len(x) * 30 >= 600]
        x = found[k]
        assert (x.steps, x.longest_us) == (voiced, longest * 30_000)
        assert x.held == pytest.approx(held / voiced if voiced else 0) and x.long_runs == pytest.approx(sum(runs) / voiced if voiced else 0)
        assert x.voiced == pytest.approx(voiced / sum(v is not None for v in t))
    lengths = spark.createDataFrame([(7, 6_000_000), (8, 90_000)], "key int, length_us long")
    shape = spark.createDataFrame([tuple(found[7]), tuple(found[8])], "key int, voiced double, held double, long_runs double, steps long, longest_us long")
    assert {x.key: x.sung for x in sung(shape, lengths).collect()} == {7: True, 8: False}


def test_blocks_of_boxes(spark):
    from cueframe.operators.voices import text_blocks

    box = lambda s, t, x, y, w=300, h=40: (1, s, t, float(x), float(y), float(w), float(h), 1000, 800)
    rows = [box(0, "Hello there", 350, 600), box(0, " friend ", 360, 650), box(0, "sign far up", 350, 100), box(0, "logo text", 350, 700), box(0, "x", 350, 500), box(1, "side", 10, 600)]
    rows += [box(2, f"credit {i}", 350, 200 + 50 * i) for i in range(5)]
    found = sorted((r.sample, r.lines, r.text) for r in text_blocks(spark.createDataFrame(rows, "key int, sample int, text string, x double, y double, width double, height double, frame_width int, frame_height int"), ["logotext"]).collect())
    assert found == [(0, 1, "sign far up"), (0, 2, "Hello there\nfriend")]

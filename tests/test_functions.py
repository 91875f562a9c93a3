from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cueframe.functions import fuzzy, maths, text, time
from cueframe.operators import ranks


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_timecodes(spark):
    rows = ["00:00:01,500", "1:02:03.5", "75.05", "-0:01", "1:75", "x", None, "12:60:00"]
    assert values(spark, rows, time.parse_timecode("x")) == [1_500_000, 3_723_500_000, 75_050_000, -1_000_000, None, None, None, None]


def test_formats_of_times(spark):
    assert values(spark, [3_723_456_789, -5, 0], time.format_srt("x"), "long") == ["01:02:03,457", "00:00:00,000", "00:00:00,000"]
    assert values(spark, [3_723_456_789], time.format_vtt("x"), "long") == ["01:02:03.457"]
    assert values(spark, [5_555_000], time.format_ass("x"), "long") == ["0:00:05.56"]
    assert values(spark, [192_000_000, 3_850_000_000, 9_000_000], time.for_people("x"), "long") == ["3 min 12 s", "1:04:10", "9 s"]


def test_natural_order(spark):
    keys = values(spark, ["Episode 10", "Episode 2", "episode 002"], text.natural_key("x"))
    assert keys[1] < keys[0] and keys[1] == keys[2]


def test_names(spark):
    assert values(spark, ["Deok-gi", "Da-ki"], text.sound_key("x")) == ["tk", "tk"]
    assert values(spark, ["Hyper Knife - S01E03 - Episode 3.ko.srt", "plain.srt"], text.show_name("x")) == ["Hyper Knife", "plain"]
    assert values(spark, ["pt-BR", "EN_us"], text.language_head("x")) == ["pt", "en"]


def test_scripts_and_width(spark):
    rows = ["hello", "안녕하세요", "カタカナ漢字", "漢字", "123", "Привет"]
    assert values(spark, rows, text.dominant_script("x")) == ["Latin", "Hangul", "Kana", "Han", None, "Cyrillic"]
    assert values(spark, ["ab漢字"], text.columns_wide("x")) == [6]


def test_reading(spark):
    assert values(spark, ["<i>ab</i>\\Ncd"], text.reading_chars("x")) == [4.0]
    assert values(spark, ["ab漢"], text.reading_chars("x", "ja-JP")) == [2.0]
    assert text.reading_limit("ko") == 12 and text.reading_limit("fr") == 17


def test_spoken(spark):
    assert values(spark, ["[door]", "(sighs) yes", "♪ la ♪", "no"], text.spoken("x")) == [False, True, False, True]


def test_wrapping(spark):
    rows = ["aaaa bbbb", "word", "ab, cdef ghijk", "漢字漢、字漢字", "a b"]
    assert values(spark, rows, text.wrap("x", 8)) == ["aaaa\nbbbb", "word", "ab,\ncdef ghijk", "漢字漢、\n字漢字", "a b"]


def test_limits_and_widths_of_languages(spark):
    assert [text.reading_limit(x) for x in ("en-US", "ko", "zh", "yue", "ja", "fr", "", None)] == [20, 12, 9, 9, 4, 17, 17, 17]
    assert values(spark, ["ab漢ｶ\n é "], text.reading_chars("x", "ja")) == [3.0] and values(spark, ["ab\n\n c "], text.reading_chars("x")) == [3.0]
    assert values(spark, ["ᄀᇿ", "ꀀ", "Ａ｡"], text.columns_wide("x")) == [4, 1, 3]
    assert values(spark, ["{\\an8}<i>a</i>{b}\\Nc"], text.strip_tags("x")) == ["a{b}\nc"]


def test_names_that_are_alike(spark):
    pairs = [("Ichida", "Ichiza"), ("Kim Deok-gi", "Kim Deok-ki"), ("Kim Deok-gi", "Park Deok-gi"), ("Anna", "Anne"), ("Choi Deok-gi", "Choi Da-ki"), ("Gi-young", "Kyung-hwa"), ("DEOK-gi", "deokgi")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [tuple(r) for r in df.select(text.nearly_same("a", "b"), text.look_alike("a", "b")).collect()] == [(True, True), (True, True), (False, False), (False, False), (False, True), (False, False), (True, True)]


def test_natural_order_of_long_numbers(spark):
    rows = ["a" + "9" * 25, "a1" + "0" * 25, "a7b", "A07B", "a", "b"]
    keys = values(spark, rows, text.natural_key("x"))
    assert keys[0] < keys[1] and keys[2] == keys[3] < keys[0] and keys[4] < keys[2] < keys[5]


def test_scripts_and_questions(spark):
    rows = ["Привет мир", "Hi 漢", "γ; ", "Really?\"", "Գնո՞ւմ ես", "no", None]
    assert values(spark, rows, text.dominant_script("x")) == ["Cyrillic", "Han", "Greek", "Latin", "Armenian", "Latin", None]
    assert values(spark, rows, text.foreign_letters("x", "ja")) == [True, False, True, False, True, False, False]
    assert values(spark, rows, text.asks("x")) == [False, False, True, True, True, False, None]
    assert values(spark, ["a;", "b?"], text.has_question_mark("x", "el")) == [True, True] and values(spark, ["a;"], text.has_question_mark("x", "en")) == [False]


def plain_rank(values, place):
    return sorted(values)[place(len(values))]


def test_places_of_sorted_groups(spark):
    import random

    r = random.Random(4)
    rows = [(g, v) for g in ("a", "b", None, "c") for v in [r.choice([r.random(), float(round(r.random() * 4)), -3.5]) for _ in range(r.randrange(1, 3000))]]
    rows += [("d", 2.0), ("e", float("inf")), ("e", float("-inf")), ("e", 1.0), ("f", None)]
    wanted = {"m": ranks.median(), "t": ranks.truncated(0.15), "r": ranks.rounded(0.95)}
    found = {x.g: x for x in ranks.at_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", wanted).collect()}
    assert set(found) == {"a", "b", None, "c", "d", "e"}
    for g, x in found.items():
        mine = [v for k, v in rows if k == g and v is not None]
        assert x.n == len(mine) and x.m == plain_rank(mine, lambda n: n // 2) and x.t == plain_rank(mine, lambda n: min(int(n * 0.15), n - 1)) and x.r == plain_rank(mine, lambda n: round(0.95 * (n - 1)))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    found = [r[0] for r in df.select(maths.cosine("a", "b")).collect()]
    assert found[0] == pytest.approx(2**-0.5) and found[1:] == [None, None]
    assert spark.range(1).select(maths.resample(F.array(F.lit(0.0), F.lit(10.0)), 3)).first()[0] == [0.0, 5.0, 10.0]


def test_sound_keys_of_names_with_h(spark):
    assert values(spark, ["Ahmad", "Chen", "Shin", "Johan", "Zoe", "Vahid", "Hahn"], text.sound_key("x")) == ["hmt", "jn", "sn", "jn", "j", "vt", "hn"]


def test_letters_of_other_scripts_are_taken_out_once(spark):
    r = random.Random(5)
    given = ["ab c, 1.éẞªɐ\n", None, "a " * 50_000 + "Ж", *["".join(r.choice("ab é,.1ɐʰαβЖдІ한국ᄀかカ々漢字ｶאבش՞Ωფʼ͵;𐐷\ń") for _ in range(r.randrange(30))) for _ in range(300)]]
    names = {name: re.compile(f"[{span}]") for name, span in text.SCRIPTS.items()}
    belongs = lambda c: c.isalpha() and next((n for n, p in names.items() if p.match(c)), None)
    others = ["".join(c for c in x or "" if belongs(c) not in (None, False, "Latin")) for x in given]
    assert others[:3] == ["", "", "Ж"]
    assert values(spark, given, text.other_letters("x")) == others
    assert values(spark, given, text.latin_count("x")) == [sum(belongs(c) == "Latin" for c in x or "") for x in given]
    for name, n in text.script_counts("x").items():
        assert values(spark, given, n) == [sum(belongs(c) == name for c in x or "") for x in given], name


def test_similar_texts_are_told_by_a_bounded_distance(spark):
    r = random.Random(7)
    pairs = [("", ""), ("a", ""), ("abcde", "abcdx"), ("abcde", "abcxx"), *[("".join(r.choice("ab") for _ in range(r.randrange(24))), "".join(r.choice("ab") for _ in range(r.randrange(24)))) for _ in range(400)]]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for least in (0.8, 0.6, 0.75):
        assert rows.where(text.similar("a", "b", least) != (text.similarity("a", "b") >= least)).count() == 0
        assert rows.where(text.similar("a", "b", least)).count() == rows.where(text.similarity("a", "b") >= least).count() > 0


def test_speech_of_each_key_is_dealt_over_tasks(spark):
    from cueframe.plan_queries import pip4_heard_again

    plan = pip4_heard_again(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_review_reads_texts_before_rows_are_dealt_by_key(spark):
    from cueframe.operators import review

    pairs = spark.createDataFrame([(1, 1, "ab cd.", "ab cd?")], "key int, ord int, text string, original string")
    plan = review.reviewed(pairs)._jdf.queryExecution().optimizedPlan().toString()
    # what is asked of a text stands below the window, where rows are in as many tasks as they come in
    assert "missing" in plan and not any("\\p{L}" in line for line in plan[: plan.index("Window [")].splitlines())


def test_pairs_at_once_are_as_pairs_alone(spark):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abc한") for _ in range(r.randrange(n)))
    pairs = [("", ""), ("", "a"), ("a", ""), ("b" * 300, "a"), ("a", "b" * 70_000), ("b" * 9, "ab" * 40_000), *[(word(12), word(30)) for _ in range(600)]]
    parts, wholes = map(list, zip(*pairs))
    assert fuzzy.best_fits(parts, wholes).tolist() == [fuzzy.best_fit(a, b) for a, b in pairs]
    assert fuzzy.common_subsequences(parts, wholes).tolist() == [fuzzy.common_subsequence(a, b) for a, b in pairs]
    assert fuzzy.best_fits([], []).tolist() == []
    rows = spark.createDataFrame([("abcdefg", "xxabcdefgxx"), ("abcdefg", "xxabcxefgxx"), ("abcdefg", "xxabxxefgxx"), ("", "a"), ("a", ""), (None, "a")], "p string, t string").coalesce(1)
    assert [tuple(x) for x in rows.select(fuzzy.nearly_contains("t", "p"), fuzzy.partial_similarity("p", "t"), fuzzy.coverage("p", "t")).collect()] == [
        (True, 1.0, 1.0), (True, 1 - 1 / 7, 6 / 7), (False, 1 - 2 / 7, 5 / 7), (True, 0.0, 1.0), (False, 0.0, 0.0), (None, None, None),
    ]


def test_rows_that_take_long_are_dealt_over_tasks(spark):
    from cueframe.text_queries import fn17_partial_similarity
    from cueframe.voice_queries import fn33_number_words

    for q in (fn17_partial_similarity, fn33_number_words):
        assert "REPARTITION_BY_NUM" in q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

"""Checks over timed text: validation, translations against originals, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import asks, dominant_script, for_reading, foreign_letters, has_question_mark, latin_count, letters, letters_key, other_counts, other_letters, reading_chars, reading_limit, spoken, word_count
from .intervals import overlap_pairs
from .ranks import at_ranks, median


def validate(cues: DataFrame, limit: float | None = None, language: str = "en") -> DataFrame:
    """Adds problems (array of names, in fixed order) and severity (0 none, 1 warning, 2 error).

    Errors: negative start, ends before start. Warnings: no length, empty, out of order, overlap, too fast. limit:
    characters a second, by default what is usual for the language.
    """
    limit = reading_limit(language) if limit is None else limit
    w = Window.partitionBy("key").orderBy("ord")
    before, following = F.lag("start_us").over(w), F.lead("start_us").over(w)
    length = F.col("end_us") - F.col("start_us")
    tests: list[tuple[str, int, Column]] = [
        ("negative start", 2, F.col("start_us") < 0),
        ("ends before start", 2, length < 0),
        ("no length", 1, length == 0),
        ("empty", 1, F.trim(F.coalesce("text", F.lit(""))) == ""),
        ("out of order", 1, F.coalesce(F.col("start_us") < before, F.lit(False))),
        ("overlap", 1, F.coalesce((following < F.col("end_us")) & (following >= F.col("start_us")), F.lit(False))),
        ("too fast", 1, (length > 0) & (reading_chars(F.coalesce("text", F.lit("")), language) * 1_000_000 > length * limit)),
    ]
    names = F.filter(F.array(*(F.when(test, F.lit(name)) for name, _, test in tests)), lambda x: x.isNotNull())
    worst = F.greatest(*(F.when(test, F.lit(level)).otherwise(F.lit(0)) for _, level, test in tests))
    return cues.withColumns({"problems": names, "severity": worst})


def paired(lines: DataFrame, originals: DataFrame, bin_us: int, percent: int = 40, separator: str = " ") -> DataFrame:
    """Each line with the originals that it overlaps by at least percent of the shorter of the two: (key, ord, text,
    original), originals joined in order; null where there is none."""
    met = overlap_pairs(lines.select("key", "ord", "start_us", "end_us"), originals.select("key", "ord", "start_us", "end_us", "text"), bin_us)
    shorter = F.least(F.col("end_us") - F.col("start_us"), F.col("r_end_us") - F.col("r_start_us"))
    enough = met.where(F.col("overlap_us") * 100 >= shorter * percent)
    texts = enough.groupBy("key", "ord").agg(F.sort_array(F.collect_list(F.struct("r_start_us", "r_ord", "r_text"))).alias("found"))
    joined = texts.select("key", "ord", F.array_join(F.transform("found", lambda x: x["r_text"]), separator).alias("original"))
    return lines.select("key", "ord", "text").join(joined, ["key", "ord"], "left")


def originals_of(lines: DataFrame, originals: DataFrame, bin_us: int, close_us: int = 60_000) -> DataFrame:
    """Each line with its original: (key, ord, text, original). Where both have as many rows and all starts are less than
    close_us apart, rows are paired in order; else those that overlap are joined, as paired() does."""
    a = lines.withColumn("_i", F.row_number().over(Window.partitionBy("key").orderBy("ord")))
    b = originals.select("key", F.row_number().over(Window.partitionBy("key").orderBy("ord")).alias("_i"), F.col("start_us").alias("_start"), F.col("text").alias("_text"))
    n = a.groupBy("key").agg(F.count("*").alias("_n")).join(b.groupBy("key").agg(F.count("*").alias("_m")), "key").where("_n = _m")
    apart = F.abs(F.col("start_us") - F.col("_start")) < close_us
    met = a.join(b, ["key", "_i"])
    step = met.groupBy("key").agg(F.every(apart).alias("_in"), F.count("*").alias("_met")).join(n, "key").where("_in and _met = _n").select("key")
    direct = met.join(step, "key", "left_semi").select("key", "ord", "text", for_reading("_text").alias("original"))
    rest = lines.join(step, "key", "left_anti")
    found = paired(rest, originals.withColumn("text", for_reading("text")), bin_us, separator="\n")
    return direct.unionByName(found)


def reviewed(pairs: DataFrame, language: str = "en") -> DataFrame:
    """(key, ord, flag): the first that holds of missing, leftover, unchanged, repeated, question; else too long; else null.

    Only originals with letters are judged. missing: no letters in the line. leftover: letters of a script that the
    language is not written in. unchanged: equal keys of two words or more (not where most originals of the key are in a
    script other than Latin and this one is not). repeated: a line of four words or more equals the one before, but their
    originals differ. question: the original asks, and the line has no question mark. too long: at least 25 letters, and
    more than three times as many as is usual (the upper median of the key's lines whose originals are in this script,
    of which there must be 20).
    """
    rows = pairs.select("key", "ord", for_reading("text").alias("t"), F.when(F.col("original").isNotNull(), for_reading("original")).alias("o"))
    w = Window.partitionBy("key").orderBy("ord")
    lettered = F.col("o").rlike(r"\p{L}")
    # all that is read in a text is read here, where rows are in as many tasks as they come in; behind this only keys go on
    rows = rows.withColumns({"script": dominant_script("o"), "kt": letters_key("t"), "ko": letters_key("o"), "nt": letters("t"), "no": letters("o")})
    rows = rows.select(
        "key", "ord", "kt", "ko", "nt", "no", F.coalesce(F.when(F.col("script") == "Han", "Kana").otherwise(F.col("script")), F.lit("Other")).alias("script"), F.coalesce(lettered, F.lit(False)).alias("lettered"),
        F.coalesce(foreign_letters("o", "en"), F.lit(False)).alias("foreign"), F.col("t").rlike(r"\p{L}").alias("said"), foreign_letters("t", language).alias("leftover"),
        ((F.col("ko") == F.col("kt")) & (word_count("o") >= 2)).alias("unchanged"), (word_count("t") >= 4).alias("wordy"), (asks("o") & ~has_question_mark("t", language)).alias("question"),
    )
    most = rows.groupBy("key").agg((F.count_if(F.col("lettered") & F.col("foreign")) * 2 > F.count_if("lettered")).alias("mostly_foreign"))
    rows = rows.withColumns({"lt": F.lag("kt").over(w), "lo": F.lag("ko").over(w)}).join(most, "key")
    flag = (
        F.when(~F.col("lettered"), None)
        .when(~F.col("said"), "missing")
        .when(F.col("leftover"), "leftover")
        .when(F.col("unchanged"), F.when(F.col("mostly_foreign") & ~F.col("foreign"), None).otherwise("unchanged"))
        .when(F.col("wordy") & (F.col("kt") == F.col("lt")) & (F.col("ko") != F.col("lo")), "repeated")
        .when(F.col("question"), "question")
    )
    rows = rows.withColumn("flag", flag)
    ratio = rows.where("no >= 2 and nt >= 2").select("key", "script", (F.col("nt") / F.col("no")).alias("ratio"))
    usual = at_ranks(ratio, ["key", "script"], "ratio", {"usual": median()}).where("n >= 20").select("key", "script", "usual")
    judged = rows.join(usual, ["key", "script"], "left")
    long = F.col("flag").isNull() & F.col("ko").isNotNull() & (F.col("no") >= 2) & (F.col("nt") >= 25) & (F.col("nt") > F.col("no") * F.col("usual") * 3)
    return judged.select("key", "ord", F.when(F.coalesce(long, F.lit(False)), "too long").otherwise(F.col("flag")).alias("flag"))


def group_medians(rows: DataFrame, group: str, value: str, least: int = 20) -> DataFrame:
    """(group, median, n): upper medians of groups with at least `least` rows."""
    return at_ranks(rows, [group], value, {"median": median()}).where(F.col("n") >= least).select(group, "median", "n")


def far_from_median(rows: DataFrame, group: str, value: str, limit: float, least: int = 20, floor: float = 0.0) -> DataFrame:
    """Rows whose value is at least limit away from their group's median; none where the limit is below the floor, which
    switches the test off."""
    found = rows.join(group_medians(rows, group, value, least), group).where(F.abs(F.col(value) - F.col("median")) >= limit)
    return found if limit >= floor else found.where(F.lit(False))


def representative(rows: DataFrame, value: str, least_us: int = 1_500_000) -> DataFrame:
    """Of each key, the row that stands for it: of those of at least least_us the one whose value is nearest to the key's
    upper median, the earlier of equal ones; where there is none, the longest row. (key, ord)."""
    length = F.col("end_us") - F.col("start_us")
    middle = at_ranks(rows, ["key"], value, {"middle": median()}).select("key", "middle")
    far = F.when((length >= least_us) & F.col(value).isNotNull(), F.abs(F.col(value) - F.col("middle")))
    ranked = rows.join(middle, "key", "left").select("key", "ord", F.struct(far.isNull().alias("none"), F.coalesce(far, F.lit(0.0)).alias("far"), F.when(far.isNull(), -length).otherwise(0).alias("short"), "start_us", "ord").alias("rank"))
    return ranked.groupBy("key").agg(F.min("rank").alias("rank")).select("key", F.col("rank.ord").alias("ord"))


def spoken_lines(cues: DataFrame) -> DataFrame:
    return cues.where(spoken("text"))


def natural_neighbours(rows: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a candidate: what is not there yet."""
    return rows.join(candidates.select(*on).distinct(), on, "left_anti")


def written_language(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(group, language): what the letters of a group's texts say: Hangul over 40 %, Kana over 20 %, Han over 60 %, another
    script that one language has over 40 %; null with fewer than 8 letters, for Latin and for scripts of several languages."""
    only = {"Greek": "el", "Hebrew": "he", "Thai": "th", "Bengali": "bn", "Gurmukhi": "pa", "Gujarati": "gu", "Tamil": "ta", "Telugu": "te", "Kannada": "kn", "Malayalam": "ml", "Sinhala": "si", "Georgian": "ka", "Armenian": "hy", "Khmer": "km", "Lao": "lo", "Myanmar": "my", "Ethiopic": "am", "Tibetan": "bo"}
    # most texts are Latin throughout: only letters of the others are looked at script by script
    seen = rows.select(F.col(group), latin_count(column).alias("_latin"), other_letters(column).alias("_others"))
    counts = {"Latin": F.col("_latin")} | {name: F.when(F.col("_others") == "", 0).otherwise(n) for name, n in other_counts("_others").items()}
    sums = seen.groupBy(group).agg(*(F.sum(n).alias(name) for name, n in counts.items()))
    total = sum((F.col(name) for name in counts), F.lit(0))
    top = F.greatest(*(F.col(n) for n in counts if n != "Latin"))
    found = F.when(total < 8, None).when(F.col("Hangul") > total * 0.4, "ko").when(F.col("Kana") > total * 0.2, "ja").when(F.col("Han") > total * 0.6, "zh")
    for script, language in only.items():
        found = found.when((F.col(script) == top) & (top > total * 0.4), language)
    return sums.select(group, found.alias("language"))

"""Names in texts: finding them, and spelling each the same way.

Spellings are compared only where they can be alike: both are dealt to what is left of their letters when one (or, of
long names, two) of them are left out, and two keys that differ by so many letters share one of these.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import look_alike, name_key, nearly_same

#: Fixed: titles before names, with and without a point; hyphened words that are no names; Korean family names.
TITLES = "Professor Doctor Miss Nurse Detective Chairwoman Chairman Director Teacher President Captain Officer Attorney Chief Manager Sergeant Inspector Pharmacist Lady Lord Sensei"
SHORT_TITLES = "Prof Dr Mr Mrs Ms Det Capt Sgt"
NOT_NAMES = "twenty thirty forty fifty sixty seventy eighty ninety self well long short high low so half all ex co non re pre post anti over under x t e uh um oh ah"
FAMILIES = (
    "Kim Gim Lee Yi Rhee Ri Park Pak Bak Choi Choe Jung Jeong Chung Kang Gang Cho Jo Yoon Yun Jang Chang Lim Im Han Oh Seo Suh Shin Sin Kwon Gwon Hwang Ahn An Song Jeon Jun Chun "
    "Cheon Hong Ko Go Moon Mun Yang Son Bae Baek Paek Heo Hur Yoo Yu Ryu Noh Roh No Nam Ha Kwak Gwak Sung Seong Cha Joo Ju Woo Wu Min Na Jin Ji Uhm Eom Byun Byeon Chae Won Bang "
    "Pyo Do Gil Ma Tak Ryeo Yeo Sim Shim Gu Koo Ku Ok Kong Gong Hyun Hyeon Seok Suk Pyeon Ra Maeng Myung Myeong Yeon Ye Jeong Jegal Namgung Sunwoo Seonu Hwangbo Dokgo"
)


def _any(words: str) -> str:
    return words.replace(" ", "|")


_NONE = f"(?i:{_any(NOT_NAMES)})"
FULL = rf"(?<![\p{{L}}-])((?:{_any(FAMILIES)}) (?!{_NONE}-)[A-Z][a-z]{{0,8}}-[a-z]{{1,8}})(?![\p{{L}}-])"
ALONE = r"(?<![\p{L}-])([A-Z][a-z]{0,8}-[a-z]{1,8})(?![\p{L}-])"
TITLED = rf"\b(?:(?:{_any(TITLES)})|(?:{_any(SHORT_TITLES)})\.?) ([A-Z][a-z]{{3,14}})(?![\p{{L}}-])"


def names_in(text: Column | str) -> Column:
    """The names in a text, each once: a Korean family name with a hyphened given name, a hyphened given name that stands
    alone, and the name behind a title."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    full = F.regexp_extract_all(t, F.lit(FULL), 1)
    alone = F.filter(F.regexp_extract_all(F.regexp_replace(t, FULL, "|"), F.lit(ALONE), 1), lambda n: ~n.rlike(rf"(?i)^({_any(NOT_NAMES)})-|-({_any(NOT_NAMES)})$"))
    titled = F.filter(F.regexp_extract_all(t, F.lit(TITLED), 1), lambda n: ~n.isin(*TITLES.split(), *SHORT_TITLES.split()))
    return F.array_distinct(F.concat(full, alone, titled))


def name_counts(texts: DataFrame) -> DataFrame:
    """(name, n): in how many rows of (text) each name is."""
    return texts.select(F.explode(names_in("text")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def parse_list(text: str | None) -> dict[str, list[str]]:
    """A show's list of names: one for each line, behind "=" its other spellings, by commas. Lines with # are remarks."""
    out: dict[str, list[str]] = {}
    for line in (text or "").replace("\r", "").split("\n"):
        name, _, rest = line.strip().partition("=")
        name = name.strip()
        if name and not line.strip().startswith("#"):
            found = {v.strip().lower(): v.strip() for v in reversed(rest.split(",")) if v.strip()}
            out.setdefault(name, []).extend(v for v in reversed(found.values()) if v.lower() != name.lower())
    return out


def add_to_list(text: str | None, name: str, spellings: list[str]) -> str:
    """The list with a group of spellings put into the first entry that shares one with it, else behind all."""
    entries = [(n, list(v)) for n, v in parse_list(text).items()]
    group = [name, *spellings]
    known = {g.lower() for g in group}
    for n, variants in entries:
        if n.lower() in known or any(v.lower() in known for v in variants):
            have = {n.lower(), *(v.lower() for v in variants)}
            for g in group:
                if g.lower() not in have:
                    variants.append(g)
                    have.add(g.lower())
            break
    else:
        entries.append((name, list(spellings)))
    return "\n".join(f"{n} = {', '.join(v)}" if v else n for n, v in entries)


def with_list(texts: DataFrame, listed: dict[str, list[str]]) -> DataFrame:
    """Texts with the listed names in place of their other spellings, whole words in any case."""
    t = F.col("text")
    for name, variants in listed.items():
        for v in variants:
            t = F.regexp_replace(t, rf"(?iu)(?<![\p{{L}}-])\Q{v}\E(?![\p{{L}}-])", re.sub(r"([\\$])", r"\\\1", name))
    return texts.withColumn("text", t)


def _left_out(key: Column) -> Column:
    """A key, and what is left of it without any one letter; of 10 letters or more, without any two."""
    size = F.length(key)

    def without(k: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(k), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substr(k, F.lit(1), i - 1), F.substr(k, i + 1)))

    one = without(key)
    two = F.when(size >= 9, F.flatten(F.transform(one, without))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(key), one, two))


def near_names(counts: DataFrame) -> DataFrame:
    """(name, n, other, other_n): all pairs of different names that are nearly the same, in both directions."""
    base = counts.withColumn("part", F.explode(_left_out(name_key("name"))))
    other = base.select("part", F.col("name").alias("other"), F.col("n").alias("other_n"))
    return base.join(other, "part").where("name <> other").select("name", "n", "other", "other_n").distinct().where(nearly_same("name", "other"))


def merge_targets(counts: DataFrame) -> DataFrame:
    """Rare spellings and the usual one that each stands for: (name, n, usual, usual_n). The usual one is nearly the same and
    at least twice as frequent; the most frequent wins, then the first in order."""
    met = near_names(counts).where("n * 2 <= other_n")
    w = Window.partitionBy("name").orderBy(F.desc("other_n"), "other")
    best = met.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select("name", "n", F.col("other").alias("usual"), F.col("other_n").alias("usual_n"))


def consistent(texts: DataFrame, id_col: str, targets: DataFrame) -> DataFrame:
    """(id, text, changed) with each name of targets (name, usual) replaced where it stands as a whole word."""
    each = texts.select(id_col, F.explode(names_in("text")).alias("name")).join(targets.select("name", "usual"), "name")
    todo = each.groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct("name", "usual"))).alias("todo"))
    pattern = lambda r: F.concat(F.lit(r"(?<![\p{L}-])\Q"), r["name"], F.lit(r"\E(?![\p{L}-])"))
    found = texts.join(todo, id_col, "left")
    text = F.when(F.col("todo").isNotNull(), F.aggregate("todo", F.col("text"), lambda t, r: F.regexp_replace(t, pattern(r), r["usual"]))).otherwise(F.col("text"))
    return found.select(id_col, text.alias("text"), (F.col("todo").isNotNull() & (text != F.col("text"))).alias("changed"))


def suggestions(counts: DataFrame, least_shared: int = 1) -> DataFrame:
    """(name, other): pairs of names that look alike but are not nearly the same, each once; they meet by sound and family."""
    from ..functions.text import sound_key

    parts = F.split("name", " ")
    base = counts.select("name", F.size(parts).alias("words"), F.when(F.size(parts) == 2, parts[0]).otherwise("").alias("family"), sound_key(F.element_at(parts, -1)).alias("sound")).where(F.length("sound") >= 2)
    other = base.withColumnRenamed("name", "other")
    met = base.join(other, ["words", "family", "sound"]).where("name < other")
    return met.where(look_alike("name", "other") & ~nearly_same("name", "other")).select("name", "other")

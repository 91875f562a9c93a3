"""Words looked up in a dictionary, by a chain of forms that they may be derived from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spelling import romanized_sounds, spelled_sounds

#: Fixed: sounds before which an ending sounds like a tap.
TAPPED = "AIOWYiuæɑəɛɪɹʊʌ"


def _cut(w: Column, n: int) -> Column:
    return F.substr(w, F.lit(1), F.greatest(F.length(w) - n, F.lit(0)))


def _forms(w: Column, possessive: bool) -> list[tuple[Column, Column, str]]:
    """(when it is tried, what is looked up, ending) in order."""
    n, ends = F.length(w), lambda x: F.endswith(w, F.lit(x))
    none = [(F.lit(True), w, "")]
    if possessive:
        none += [(ends("s'"), F.concat(_cut(w, 2), F.lit("'s")), ""), (ends("'"), _cut(w, 1), "")]
    s = (n >= 3) & ends("s")
    d = (n >= 4) & ends("d")
    g = (n >= 5) & ends("ing")
    doubled = w.rlike(r"([bcdgklmnprstvxz])\1ing$|cking$")
    return [
        *none,
        (s & ~ends("ss"), _cut(w, 1), "s"), (s & (ends("'s") | (n > 4) & ends("es") & ~ends("ies")), _cut(w, 2), "s"), (s & (n > 4) & ends("ies"), F.concat(_cut(w, 3), F.lit("y")), "s"),
        (d & ~ends("dd"), _cut(w, 1), "ed"), (d & (n > 4) & ends("ed") & ~ends("eed"), _cut(w, 2), "ed"),
        (g & (n > 5), _cut(w, 3), "ing"), (g, F.concat(_cut(w, 3), F.lit("e")), "ing"), (g & (n > 5) & doubled, _cut(w, 4), "ing"),
    ]


def with_ending(sounds: Column | str, ending: Column | str) -> Column:
    """The sounds of a word with the ending s, ed or ing; any other ending leaves them."""
    p, e = (F.col(x) if isinstance(x, str) else x for x in (sounds, ending))
    last = lambda signs: p.rlike(f"[{signs}]$")
    tapped = p.rlike(f"[{TAPPED}]t$")
    short = F.regexp_replace(p, "t$", "")
    s = F.when(last("ptkfθ"), F.concat(p, F.lit("s"))).when(last("szʃʒʧʤ"), F.concat(p, F.lit("ᵻz"))).otherwise(F.concat(p, F.lit("z")))
    ed = F.when(last("pkfθʃsʧ"), F.concat(p, F.lit("t"))).when(last("d"), F.concat(p, F.lit("ᵻd"))).when(~last("t"), F.concat(p, F.lit("d")))
    ed = ed.when(F.length(p) < 2, F.concat(p, F.lit("ɪd"))).when(tapped, F.concat(short, F.lit("ɾᵻd"))).otherwise(F.concat(p, F.lit("ᵻd")))
    ing = F.when(tapped, F.concat(short, F.lit("ɾɪŋ"))).otherwise(F.concat(p, F.lit("ɪŋ")))
    return F.when(p == "", p).when(e == "s", s).when(e == "ed", ed).when(e == "ing", ing).otherwise(p)


def looked_up(words: DataFrame, entries: DataFrame) -> DataFrame:
    """(word, form, ending, gold, sounds, source) of each distinct (word): what is known first of the word itself, its form in
    lower case and what that may be derived from (where only capitals differ), possessives, and the stems of -s, -ed and
    -ing; else romanized syllables; else rules of spelling.

    entries: (word, sounds, gold); golden ones come before others. All forms of a word are joined at once, and the first in
    order counts. source: dictionary, romanized or rules; form and ending are null for the latter two. Sounds are those of the
    entry with the ending; stress by capitals is left to what speaks. Null words have no row.
    """
    w, low = F.regexp_replace("word", "’", "'"), F.lower(F.regexp_replace("word", "’", "'"))
    shape = (F.length(w) > 1) & (w != low) & F.replace(w, F.lit("'"), F.lit("")).rlike(r"^\p{L}*$") & ((w == F.upper(w)) | (F.substr(w, F.lit(2)) == F.substr(low, F.lit(2))))
    own = _forms(w, True)
    # the word as it stands, then in lower case with its stems, then possessives and stems as it stands
    tried = [own[0], *((shape & c, form, ending) for c, form, ending in _forms(low, False)), *own[1:]]
    forms = F.array(*(F.when(c, F.struct(F.lit(k).alias("turn"), form.alias("form"), F.lit(ending).alias("ending"))) for k, (c, form, ending) in enumerate(tried)))
    distinct = words.where("word is not null").select("word").distinct()
    each = distinct.select("word", F.explode(F.filter(forms, lambda x: x.isNotNull())).alias("x")).select("word", "x.*")
    known = entries.groupBy(F.col("word").alias("form")).agg(F.max_by(F.struct("sounds", "gold"), "gold").alias("entry"))
    met = each.join(known, "form").groupBy("word").agg(F.min_by(F.struct("form", "ending", "entry"), "turn").alias("found"))
    found = met.select("word", "found.form", "found.ending", F.col("found.entry.gold").alias("gold"), with_ending(F.col("found.entry.sounds"), F.col("found.ending")).alias("sounds"), F.lit("dictionary").alias("source"))
    lost = distinct.join(met, "word", "left_anti").withColumn("_w", w)
    lost = lost.withColumns({"_r": romanized_sounds("_w"), "_s": spelled_sounds("_w")})
    rest = lost.select("word", F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("ending"), F.lit(None).cast("boolean").alias("gold"), F.coalesce("_r", "_s").alias("sounds"), F.when(F.col("_r").isNotNull(), "romanized").otherwise("rules").alias("source"))
    return found.unionByName(rest)

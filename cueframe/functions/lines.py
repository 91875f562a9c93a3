"""Single cues: lines for translation and back, bilingual texts, splitting and merging, small estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import ass_to_html, html_to_ass
from .text import collapse, letters_key, once, strip_tags, trimmed, wrap

_OVERRIDES = r"^(\{[^}]*\})+"
_TAGS = r"\{[^}]*\}|</?[a-zA-Z][^>]*>"

#: Fixed: phrases, as keys, that a recogniser invents over silence, and how lines of credit begin.
KNOWN_PHRASES = [
    "다음영상에서만나요", "다음영상에서뵙겠습니다", "다음시간에만나요", "시청해주셔서감사합니다", "오늘도시청해주셔서감사합니다",
    "영상시청해주셔서감사합니다", "끝까지시청해주셔서감사합니다", "구독과좋아요부탁드립니다", "구독과좋아요", "구독좋아요알림설정",
    "구독과좋아요알림설정부탁드립니다", "좋아요와구독부탁드립니다", "구독부탁드립니다",
    "thankyouforwatching", "thanksforwatching", "thankyouforwatchingpleasesubscribe", "pleasesubscribe", "likeandsubscribe",
    "pleaselikeandsubscribe", "seeyouinthenextvideo", "seeyounexttime", "dontforgettolikeandsubscribe",
    "ご視聴ありがとうございました", "ご視聴ありがとうございます", "チャンネル登録お願いします", "チャンネル登録よろしくお願いします",
    "谢谢观看", "感谢观看", "谢谢大家观看", "请不吝点赞订阅转发打赏支持明镜与点点栏目", "字幕由amaraorg社区提供",
]
CREDIT_STARTS = ["한글자막", "자막제공", "자막제작", "자막by", "subtitlesby", "captionsby", "subtitledby", "transcriptionby", "字幕由", "字幕制作"]


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def known_phrase(key: Column | str) -> Column:
    """Whether a key (see letters_key) is a known invented phrase or a line of credit."""
    k = _col(key)
    starts = F.lit(False)
    for c in CREDIT_STARTS:
        starts = starts | F.startswith(k, F.lit(c))
    return k.isin(*KNOWN_PHRASES) | F.contains(k, F.lit("amaraorg")) | starts | (F.contains(k, F.lit("자막")) & F.contains(k, F.lit("by")))


def echo_of(text: Column | str, prompt: Column | str) -> Column:
    """Whether a text only repeats part of a prompt: at least 3 letters and 60 % of it."""
    k, p = letters_key(text), letters_key(prompt)
    return (F.length(k) >= F.greatest(F.lit(3.0), F.length(p) * 0.6)) & F.contains(p, k)


def without_repeats(text: Column | str, most: int = 2) -> Column:
    """A text of sentences without those that stand more than `most` times in a row; as it is where there are none."""
    t = F.coalesce(_col(text), F.lit(""))
    sentences = lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"([^.?!。？！…]*[.?!。？！…][ .?!。？！…]*|[^.?!。？！…]+$)"), 1), trimmed), lambda s: s != "")
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("key"), F.lit(0).alias("run"))

    def step(s: Column, x: Column) -> Column:
        run = F.when((x["key"] == s["key"]) & (s["run"] > 0), s["run"] + 1).otherwise(1)
        keep = (x["key"] == "") | (run <= most)
        return F.struct(F.when(keep, F.concat(s["out"], F.array(x["s"]))).otherwise(s["out"]).alias("out"), x["key"].alias("key"), run.alias("run"))

    def shorter(all_of: Column) -> Column:
        kept = F.aggregate(F.transform(all_of, lambda x: F.struct(x.alias("s"), letters_key(x).alias("key"))), state, step)["out"]
        return F.when(F.size(all_of) > most, once(kept, lambda k: F.when(F.size(k) < F.size(all_of), F.array_join(k, " "))))

    return once(t, lambda x: F.coalesce(once(sentences(x), shorter), x))


def prepared(text: Column | str) -> Column:
    """A cue's text as one line for translation: struct<text, prefix, italic, two_speakers>.

    prefix: the override blocks before it; italic: whether one pair of tags spans it; two_speakers: every line has a dash,
    lines are then parted by " / ". Bars become slashes, as answers are numbered with bars.
    """
    t = trimmed(F.replace(F.coalesce(_col(text), F.lit("")), F.lit("\r"), F.lit("")))
    prefix = F.regexp_extract(t, _OVERRIDES, 0)
    body = trimmed(F.regexp_replace(t, _OVERRIDES, ""))
    low = F.lower(body)
    italic = F.startswith(low, F.lit("<i>")) & F.endswith(low, F.lit("</i>")) & ~F.contains(F.substr(low, F.lit(4)), F.lit("<i>"))
    lines = F.filter(F.transform(F.split(F.regexp_replace(body, _TAGS, ""), "\n"), lambda x: trimmed(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    two = (F.size(lines) >= 2) & F.forall(lines, lambda x: F.startswith(x, F.lit("-")))
    joined = F.translate(F.when(two, F.array_join(lines, " / ")).otherwise(F.array_join(lines, " ")), "|", "/")
    return F.struct(joined.alias("text"), prefix.alias("prefix"), italic.alias("italic"), two.alias("two_speakers"))


def tidied(source: Column, answer: Column | str) -> Column:
    """A translated line without what models add: emphasis, and a separator or dash that the prepared line has not."""
    t = trimmed(F.regexp_replace(F.coalesce(_col(answer), F.lit("")), r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"(\*{1,2}|_{2})(?=\S)(.+?)(?<=\S)\1", "$2")
    bare = F.regexp_replace(t, "^[/ ]+|[/ ]+$", "")
    bare = F.when(F.startswith(bare, F.lit("-")) & ~F.startswith(F.regexp_replace(source["text"], r"(?U)^\s+", ""), F.lit("-")), F.regexp_replace(bare, "^[- ]+", "")).otherwise(bare)
    return F.when(source["two_speakers"], t).otherwise(bare)


def restored(source: Column, answer: Column | str, max_columns: int = 42) -> Column:
    """A translated line as a cue: at most two lines, speakers on their own, tags as they were; the source where it is empty."""
    t = tidied(source, answer)
    parts = F.filter(F.transform(F.split(t, " / "), trimmed), lambda p: p != "")
    spoken = F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("-")), p).otherwise(F.concat(F.lit("- "), p))), "\n")
    single = wrap(F.when(source["two_speakers"], t).otherwise(F.replace(t, F.lit(" / "), F.lit(" "))), max_columns)
    body = F.when(source["two_speakers"] & (F.size(parts) >= 2), spoken).otherwise(single)
    body = F.when(t == "", source["text"]).otherwise(body)
    return F.concat(source["prefix"], F.when(source["italic"], F.concat(F.lit("<i>"), body, F.lit("</i>"))).otherwise(body))


def numbered_answers(output: Column | str, count: Column | int) -> Column:
    """The answers "n|text" of a model as an array of `count` texts; of equal numbers the first; empty where one is missing."""
    n = F.lit(count) if isinstance(count, int) else count
    lines = F.transform(F.split(F.coalesce(_col(output), F.lit("")), "\n"), trimmed)
    number = lambda x: F.regexp_extract(x, r"^\s*\+?(\d{1,9})\s*\|", 1)
    found = F.filter(lines, lambda x: number(x) != "")
    keys = F.transform(found, lambda x: number(x).cast("int"))
    texts = F.transform(found, lambda x: trimmed(F.regexp_replace(x, r"^[^|]*\|", "")))
    at = lambda i: F.array_position(keys, i).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.when(at(i) > 0, F.get(texts, at(i) - 1)).otherwise(""))).otherwise(F.array().cast("array<string>"))


def matched_answers(output: Column | str, translations: int, originals: int) -> Column:
    """The answers "A|n" of a check as an array: for each letter the number of an original, null where there is none."""
    lines = F.transform(F.split(F.coalesce(_col(output), F.lit("")), "\n"), trimmed)

    def answer(k: int) -> Column:
        mine = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, rf"^{chr(65 + k)}\|\s*\+?(\d{{1,9}})\s*$", 1).try_cast("int")), lambda n: n.between(1, originals))
        return F.get(mine, F.lit(0))

    return F.array(*(answer(k) for k in range(translations)))


def split_text(text: Column | str) -> Column:
    """A cue's text in two: by its middle line, else at the space nearest the middle (the earlier of two); struct<a, b>. All
    of it is in a where it cannot be split."""
    t = F.coalesce(_col(text), F.lit(""))
    lines = F.split(t, "\n")
    half = F.floor((F.size(lines) + 1) / 2).cast("int")
    bare = trimmed(t)
    middle = F.floor(F.length(bare) / 2).cast("int")
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.length(bare) - 1, F.lit(0))), lambda i: F.substr(bare, i + 1, F.lit(1)) == " ")
    at = F.array_min(F.transform(places, lambda i: F.struct(F.abs(i - middle).alias("d"), i.alias("i"))))["i"]
    one = F.struct(F.array_join(F.slice(lines, F.lit(1), half), "\n").alias("a"), F.array_join(F.slice(lines, half + 1, F.size(lines)), "\n").alias("b"))
    two = F.struct(trimmed(F.substr(bare, F.lit(1), at)).alias("a"), trimmed(F.substr(bare, at + 2)).alias("b"))
    return F.when(F.size(lines) > 1, one).when(at.isNotNull(), two).otherwise(F.struct(bare.alias("a"), F.lit("").alias("b")))


def merged_text(first: Column | str, second: Column | str) -> Column:
    """The texts of two cues on lines of their own; empty ones give no line."""
    parts = F.transform(F.array(_col(first), _col(second)), lambda x: trimmed(F.coalesce(x, F.lit(""))))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def original_line(text: Column | str, max_columns: int = 42) -> Column:
    """An original beside its translation: no tags, no empty lines, on one line where it is short and of one speaker; null
    without text."""
    lines = F.filter(F.transform(F.split(F.replace(strip_tags(text), F.lit("\r"), F.lit("")), "\n"), trimmed), lambda x: x != "")
    joined = F.array_join(lines, " ")
    two = (F.size(lines) >= 2) & F.forall(lines, lambda x: F.startswith(x, F.lit("-")))
    return F.when(F.size(lines) > 0, F.when(~two & (F.length(joined) <= max_columns), joined).otherwise(F.array_join(lines, "\n")))


def stacked(html: Column | str, original: Column | str, colour: str = "#B0B0B0", max_columns: int = 42) -> Column:
    """A translation below its original in one cue; a position override stays in front."""
    t, o = _col(html), original_line(original, max_columns)
    prefix = F.regexp_extract(t, r"^\{\\an[^}]*\}", 0)
    body = F.substr(t, F.length(prefix) + 1)
    shown = F.concat(prefix, F.lit(f'<font color="{colour}">'), F.translate(o, "<>", "‹›"), F.lit("</font>\n"), body)
    return F.when(o.isNotNull(), shown).otherwise(t)


def translation_event(html: Column | str) -> Column:
    """The translation of a two-place file, in override blocks; line breaks as they are in memory."""
    return F.replace(html_to_ass(html), F.lit("\\N"), F.lit("\n"))


def original_event(text: Column | str, max_columns: int = 42) -> Column:
    return F.translate(original_line(text, max_columns), "{}", "()")


def html_of(text: Column | str, file_format: str) -> Column:
    return ass_to_html(text) if file_format in ("ass", "ssa") else _col(text)


# times and estimates


def preview_start(line_us: Column | str, length_us: int, lead_us: int = 1_000_000, medium_us: Column | None = None) -> Column:
    """Where a stretch of length_us around a line begins: lead_us before it, within the medium, not before 0."""
    start = _col(line_us) - lead_us
    if medium_us is not None:
        start = F.when(medium_us.isNotNull() & (start + length_us > medium_us), medium_us - length_us).otherwise(start)
    return F.greatest(start, F.lit(0))


def gender_of(pitch_hz: Column | str, below: float = 160.0) -> Column:
    return F.when(_col(pitch_hz).isNotNull(), F.when(_col(pitch_hz) < below, "male").otherwise("female"))


def gender_uncertain(pitch_hz: Column | str, lines: Column | str) -> Column:
    """In the band where voices overlap, which is wider for speakers of few lines; null pitches are not uncertain."""
    p = _col(pitch_hz)
    return F.coalesce(p.between(140, 185) | ((_col(lines) <= 6) & p.between(125, 205)), F.lit(False))


def estimated_seconds(lines: Column | str, load: float, per_line: float, eased: bool = False) -> Column:
    return (F.lit(load) + _col(lines) * per_line) * (1.5 if eased else 1.0)


def followed_gain(level_db: Column | str, target_db: Column | str, follow: float = 0.8, low: float = -12.0, high: float = 3.0) -> Column:
    """How much louder a line gets to follow the original's level by a share, within limits."""
    return F.greatest(F.lit(low), F.least(F.lit(high), (_col(target_db) - _col(level_db)) * follow))


def panned(left: Column | str, right: Column | str, most_degrees: float = 25.0) -> tuple[Column, Column]:
    """Gains of both sides for a voice that stands where the original does: by the angle of its levels, within limits."""
    angle = F.degrees(F.atan2(_col(right), _col(left))) - 45
    held = F.radians(F.greatest(F.lit(-most_degrees), F.least(F.lit(most_degrees), angle)) + 45)
    return F.cos(held), F.sin(held)


#: Fixed: how much faster a line may be said, how much shorter it may be made, the shortest slot, and the share it aims below one.
MOST_FASTER, MOST_SHORTER, SHORTEST_SLOT_US, AIM = 1.3, 1.15, 300_000, 1.03


def said_faster(length_us: Column | str, slot_us: Column | str, speed: Column | float = 1.0) -> Column:
    """The speed at which a line is said that is longer than its slot: 3 % more than it needs, at most 1.3 times as fast, and
    never over 2; its own speed where it fits, or where the slot is too short to try."""
    n, slot = _col(length_us).cast("double"), _col(slot_us).cast("double")
    own = F.lit(speed) if isinstance(speed, float) else speed
    faster = F.least(own * F.least(n / slot * AIM, F.lit(MOST_FASTER)), F.lit(2.0))
    return F.when((n <= slot) | (slot < SHORTEST_SLOT_US), own).when(faster > own + 0.01, faster).otherwise(own)


def fitted(length_us: Column | str, slot_us: Column | str, quick_us: Column | None = None, speed: Column | float = 1.0) -> Column:
    """How a line fits into its slot: struct<kind, speed, stretch, length_us>.

    kind: natural (as it is said), sped up, stretched (by up to 15 % shorter at its pitch), too long (shortened by as much, or
    left where the slot is under SHORTEST_SLOT_US). quick_us: how long it is when said_faster; as much shorter as faster where
    that is not known, and 0 where nothing came of it. Null lengths and slots give null.
    """
    n, slot = _col(length_us).cast("double"), _col(slot_us).cast("double")
    own = F.lit(speed) if isinstance(speed, float) else speed
    faster = said_faster(length_us, slot_us, speed)
    quick = F.when(faster == own, n).otherwise(n * own / faster if quick_us is None else quick_us.cast("double"))
    short = quick / slot

    def row(kind: str, at: Column, stretch: Column, length: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.alias("speed"), stretch.alias("stretch"), F.round(length).cast("long").alias("length_us"))

    one = F.lit(1.0)
    found = F.when((n <= slot) | (n == 0), row("natural", own, one, n)).when(slot < SHORTEST_SLOT_US, row("too long", own, one, n)).when(quick == 0, row("natural", own, one, n))
    found = found.when(quick <= slot, row("sped up", faster, one, quick)).when(short <= MOST_SHORTER, row("stretched", faster, short, slot)).otherwise(row("too long", faster, F.lit(MOST_SHORTER), quick / MOST_SHORTER))
    return F.when(n.isNotNull() & slot.isNotNull(), found)


def fallen(value: Column | str, start: Column | str, full: Column | str) -> Column:
    """0 at or above start, 1 at or below full, linear between; a step at full where start is no higher. Null for nulls."""
    v, a, b = _col(value), _col(start), _col(full)
    share = F.when(a <= b, F.when(v <= b, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (a - v) / (a - b))))
    return F.when(v.isNotNull() & a.isNotNull() & b.isNotNull(), share)


def voice_distance(level: Column | str, brightness: Column | str, usual: Column, quiet: Column, low: Column, dull: Column, dark: Column, no_voice: float = 30.0) -> Column:
    """How far away a voice sounds, 0 to 1: only one that is both among the quieter and among the duller lines of its recording
    does. quiet and dull: where that begins (their first quartiles), low and dark: where it is whole (their twentieth part).
    0 for a level no_voice below the usual one, and for null."""
    both = fallen(level, quiet, low) * fallen(brightness, dull, dark)
    return F.when(_col(level) >= usual - no_voice, F.coalesce(both, F.lit(0.0))).otherwise(0.0)


def trapezoid(frame: Column | str, start: Column | str, end: Column | str, fade: Column | int) -> Column:
    """0 outside [start, end), 1 inside, rising and falling over `fade` frames within it."""
    f, a, b = _col(frame), _col(start), _col(end)
    fade = F.lit(fade) if isinstance(fade, int) else fade
    return F.when((f < a) | (f >= b), 0.0).otherwise(F.least(F.lit(1.0), (f - a + 1) / fade, (b - f) / fade))


# file names

#: Fixed: endings of files by what they hold.
MEDIA_ENDINGS = {
    "video": "mp4 mkv avi mov wmv m4v webm ts m2ts mts mpg mpeg flv 3gp vob ogv",
    "audio": "mp3 wav m4a aac flac ogg opus wma ac3 eac3",
    "subtitle": "srt vtt ass ssa sub idx sup",
}


def media_kind(path: Column | str) -> Column:
    """video, audio or subtitle by a file's ending; null for others."""
    ending, out = F.lower(F.regexp_extract(_col(path), r"\.([^.\\/]+)$", 1)), None
    for kind, known in MEDIA_ENDINGS.items():
        out = F.when(ending.isin(*known.split()), kind) if out is None else out.when(ending.isin(*known.split()), kind)
    return out


def sidecar(video: Column | str, file: Column | str) -> Column:
    """What a subtitle file's name says beside its video's: struct<language, forced, hearing_impaired, sdh, label, format>; null
    where it is not the video's. The first token that can be a language is; "hi" behind it is a flag."""
    v, f = _col(video), _col(file)
    base = F.regexp_replace(F.regexp_replace(v, r"^.*[/\\\\]", ""), r"\.[^.]*$", "")
    name = F.regexp_replace(f, r"^.*[/\\\\]", "")
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    rest = F.substr(name, F.length(base) + 1)
    mine = F.startswith(F.lower(name), F.lower(base)) & F.startswith(rest, F.lit(".")) & ext.isin("srt", "vtt", "ass", "ssa", "sub") & (F.lower(v) != F.lower(f))
    middle = F.regexp_replace(F.substr(rest, F.lit(2), F.greatest(F.length(rest) - 2 - F.length(ext), F.lit(0))), r"^\.+|\.+$", "")
    tokens = F.filter(F.transform(F.split(middle, r"\."), trimmed), lambda t: t != "")
    state = F.struct(F.lit(None).cast("string").alias("language"), F.lit(False).alias("forced"), F.lit(False).alias("hearing_impaired"), F.lit(False).alias("sdh"), F.array().cast("array<string>").alias("labels"))

    def step(s: Column, raw: Column) -> Column:
        t = F.lower(raw)
        flag_hi = (t == "cc") | (t == "hi") & s["language"].isNotNull()
        known = t.isin("forced", "sdh", "default") | flag_hi
        is_language = ~known & s["language"].isNull() & t.rlike(r"^[a-z]{2,3}(-[a-z0-9]{2,8})?$")
        return F.struct(
            F.when(is_language, t).otherwise(s["language"]).alias("language"), (s["forced"] | (t == "forced")).alias("forced"), (s["hearing_impaired"] | flag_hi).alias("hearing_impaired"),
            (s["sdh"] | (t == "sdh")).alias("sdh"), F.when(known | is_language, s["labels"]).otherwise(F.concat(s["labels"], F.array(raw))).alias("labels"),
        )

    done = F.aggregate(tokens, state, step)
    label = F.when(F.size(done["labels"]) > 0, F.array_join(done["labels"], " "))
    return F.when(mine, F.struct(done["language"].alias("language"), done["forced"].alias("forced"), done["hearing_impaired"].alias("hearing_impaired"), done["sdh"].alias("sdh"), label.alias("label"), ext.alias("format")))


def sidecar_name(base: Column | str, language: Column | str, forced: Column, hearing_impaired: Column, sdh: Column, file_format: str) -> Column:
    """video.language[.forced][.sdh or .hi].format"""
    language = F.lower(trimmed(_col(language)))
    parts = F.array(_col(base), F.when(language != "", language), F.when(forced, F.lit("forced")), F.when(sdh, F.lit("sdh")).when(hearing_impaired, F.lit("hi")), F.lit(file_format.lstrip(".").lower()))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), ".")


def sidecar_order(info: Column, name: Column | str) -> list[Column]:
    """What sidecars of one video are sorted by: language (none last), forced, for the hard of hearing, name."""
    return [F.lower(F.coalesce(info["language"], F.lit("~"))), info["forced"], info["hearing_impaired"] | info["sdh"], F.lower(_col(name))]


def spaced(text: Column | str) -> Column:
    return collapse(text)

"""Who speaks in a recording: lines grouped by their voice prints, groups joined, characters kept, the rest given to them.

A key is a recording. Similarities are cosines, rounded to 9 places so that equal ones are equal however they were summed
up. The average similarity of two groups of unit vectors is the product of their sums over the product of their sizes, so a
group is its sum: a recording of n lines of d numbers takes n * d * 8 bytes in a task and never n * n; the time is n * n * d.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.lines import gender_of, gender_uncertain
from ..functions.text import once
from . import ranks
from .rounds import kept

#: Fixed: cosines from which groups are one person, their averages are, and a small group is a character.
SAME_SPEAKER, SAME_GROUP, SAME_CHARACTER = 0.36, 0.5, 0.4
#: Fixed: pitch readings a gender needs; how far pitches of one person lie apart; what makes a character, a minor one; how many there are.
LEAST_READINGS, SAME_PITCH_HZ = 5, 40.0
CHARACTER_LINES, CHARACTER_US, MINOR_LINES, MINOR_US, MOST_SPEAKERS = 5, 12_000_000, 2, 3_000_000, 24
#: Recordings of more lines than this are first joined in rounds over blocks of so many groups.
MOST_LINES, BLOCK = 20_000, 2_048


def unit(vector: Column | str) -> Column:
    """A vector at length 1; null where it is null or zero, or holds nulls or numbers that are not finite."""
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))

    def scaled(x: Column) -> Column:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
        # else every number of the vector would work the length out again
        return once(norm, lambda n: F.when((n > 0) & (n < float("inf")), F.transform(x, lambda y: y / n)))

    return once(v, scaled)


def joined_in_order(n: int, row: Callable[[int], np.ndarray], merge: Callable[[int, int], None], least: float, last: bool = False) -> np.ndarray:
    """Joins the most alike two of n groups again and again while they are `least` alike; which group each one came to.

    row(i): how alike i is to each group now; merge(a, b): b is part of a, a < b. Of equal pairs the first in order is
    joined, or the last one. Every group's best partner is remembered, so a join costs one row and those that lost theirs.
    """
    into, alive = np.arange(n), np.ones(n, dtype=bool)
    best, partner = np.full(n, -np.inf), np.zeros(n, dtype=np.int64)

    def look(i: int) -> np.ndarray:
        alike = np.where(alive, row(i), -np.inf)
        alike[i] = -np.inf
        partner[i] = n - 1 - alike[::-1].argmax() if last else alike.argmax()
        best[i] = alike[partner[i]]
        return alike

    for i in range(n):
        look(i)
    while n:
        top = best.max()
        if not top >= least:
            break
        tied = np.flatnonzero(best == top)
        a = int(tied[partner[tied] > tied][-1] if last else tied[0])
        b = int(partner[a])
        merge(a, b)
        alive[b], best[b] = False, -np.inf
        into[into == b] = a
        lost = np.flatnonzero(alive & ((partner == a) | (partner == b)))
        alike = look(a)
        nearer = (alike > best) | ((alike == best) & ((partner < a) if last else (partner > a)))
        nearer &= alive & np.isfinite(alike)
        best[nearer], partner[nearer] = alike[nearer], a
        for k in lost.tolist():
            if k != a:
                look(k)
    return into


def average_linkage(sums: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """The first member of each group's group, by the average similarity of all their lines."""
    sums, sizes = sums.copy(), sizes.astype(np.float64)

    def row(i: int) -> np.ndarray:
        return np.round(sums @ sums[i] / (sizes * sizes[i]), 9)

    def merge(a: int, b: int) -> None:
        sums[a] += sums[b]
        sizes[a] += sizes[b]

    return joined_in_order(len(sums), row, merge, least)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    vectors = column.to_numpy()
    size = np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors))
    out = np.zeros((len(vectors), int(size.max()) if len(size) else 0))
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate(vectors) if len(size) else 0
    return out


def _by_key(rows: DataFrame, order: list[str], work: Callable[[pa.Table], dict], added: str) -> DataFrame:
    """work over each recording's rows in order; its columns are added."""
    extra = T._parse_datatype_string(added)
    schema = T.StructType([f for f in rows.schema if f.name not in extra.names] + list(extra))
    names, arrow = [f.name for f in rows.schema if f.name not in extra.names], to_arrow_schema(T.StructType(list(extra)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        found = work(table)
        table = table.select(names)
        for f in arrow:
            table = table.append_column(f, pa.array(found[f.name], f.type, from_pandas=True))
        return table

    return rows.groupBy("key").applyInArrow(run, schema)


def _in_blocks(state: DataFrame, least: float) -> DataFrame:
    """One round over (key, id, n, s): each group's most alike other one where they are each other's, as (key, id, into).

    Groups are dealt into blocks, and every two blocks of a recording meet in one task; a result is a row for each group.
    Pairs that are each other's best are joined by any order of joins, as a joined group is never more alike to a third one
    than its parts were."""
    blocks = state.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = state.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("key", "id", "n", "s", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, sizes, sums, block = table["id"].to_numpy(), table["n"].to_numpy().astype(np.float64), _matrix(table["s"]), table["block"].to_numpy()
        alike = np.round(sums @ sums.T / np.outer(sizes, sizes), 9)
        np.fill_diagonal(alike, -np.inf)
        if len(np.unique(block)) > 1:  # pairs inside a block meet in its own task
            alike[block[:, None] == block[None, :]] = -np.inf
        place = alike.argmax(axis=1)
        best = alike[np.arange(len(ids)), place]
        some = best >= least
        return pa.table({"key": table["key"].filter(pa.array(some)), "id": ids[some], "alike": best[some], "other": ids[place[some]]})

    key = state.schema["key"].dataType.simpleString()
    near = sent.groupBy("key", "a", "b").applyInArrow(run, f"key {key}, id long, alike double, other long")
    mine = near.groupBy("key", "id").agg(F.min(F.struct((-F.col("alike")).alias("far"), "other"))["other"].alias("other"))
    back = mine.select("key", F.col("other").alias("id"), F.col("id").alias("other"))
    return mine.join(back, ["key", "id", "other"]).where("other < id").select("key", "id", F.col("other").alias("into"))


def clustered(prints: DataFrame, least: float = SAME_SPEAKER, most: int = MOST_LINES) -> DataFrame:
    """(key, ord, grp): lines grouped by average linkage; grp is the smallest ord of the group.

    prints: (key, ord, embedding), ord unique in a key. The two groups whose lines are most alike on average are joined while
    that is `least` or more; of equal pairs the first in order. Null, zero and not finite vectors have no row; shorter ones count as
    filled up with zeros. A recording
    of at most `most` lines is one task's; longer ones are first joined in rounds, in which all pairs of groups that are
    each other's best are joined at once, block by block, until so few groups are left or nothing is alike.
    """
    lines = prints.select("key", F.col("ord").cast("long").alias("ord"), unit("embedding").alias("s")).where("s is not null")
    sizes = kept(lines.groupBy("key").count())
    members = lines.select("key", "ord", F.col("ord").alias("grp"))
    state = lines.select("key", F.col("ord").alias("id"), F.lit(1).cast("long").alias("n"), "s")
    while True:
        large = sizes.where(F.col("count") > most).select("key")
        if not large.head(1):
            break
        links = kept(_in_blocks(state.join(large, "key", "left_semi"), least))
        if not links.head(1):
            break
        # links are pairs, so no group is both joined and joined to
        members = kept(members.join(links.withColumnRenamed("id", "grp"), ["key", "grp"], "left").select("key", "ord", F.coalesce("into", "grp").alias("grp")))
        moved = state.join(links, ["key", "id"], "left").select("key", F.coalesce("into", "id").alias("id"), "n", "s")
        added = lambda s, x: F.when(F.size(s) == 0, x).otherwise(F.zip_with(s, x, lambda p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0))))
        total = F.aggregate(F.collect_list("s"), F.array().cast("array<double>"), added)  # one or two vectors
        state = kept(moved.groupBy("key", "id").agg(F.sum("n").alias("n"), total.alias("s")))
        sizes = kept(state.join(links.select("key").distinct(), "key", "left_semi").groupBy("key").count())

    def work(table: pa.Table) -> dict:
        ids = table["id"].to_numpy()
        return {"grp": ids[average_linkage(_matrix(table["s"]), table["n"].to_numpy(), least)]}

    groups = _by_key(state, ["id"], work, "grp long").select("key", F.col("id"), "grp")
    return members.join(groups.select("key", F.col("id").alias("grp"), F.col("grp").alias("into")), ["key", "grp"]).select("key", "ord", F.col("into").alias("grp"))


def _upper_median(values: list[float]) -> float | None:
    return sorted(values)[len(values) // 2] if len(values) >= LEAST_READINGS else None


def _gender(values: list[float]) -> str | None:
    hz = _upper_median(values)
    return None if hz is None else "male" if hz < 160.0 else "female"


def _readings(table: pa.Table) -> list[list[float]]:
    return [[x for x in p or [] if x is not None] for p in table["pitch"].to_pylist()]


def _mean(vectors: np.ndarray) -> np.ndarray:
    total = vectors.sum(axis=0)
    norm = np.sqrt(total @ total)
    return total / norm if norm > 0 else total


def _grouped(groups: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The groups in order and the places of their lines."""
    names, which = np.unique(groups, return_inverse=True)
    order = np.argsort(which, kind="stable")
    return names, np.split(order, np.cumsum(np.bincount(which, minlength=len(names)))[:-1])


def merged_alike(lines: DataFrame, least: float = SAME_GROUP, pitch_hz: float = SAME_PITCH_HZ) -> DataFrame:
    """Groups whose mean vectors are alike and whose pitches are near are one: the lines with their grp replaced.

    lines: (key, ord, grp, embedding, pitch array). The most alike pair is joined, the last in order of equal ones, and means
    and median pitches are those of the joined group from then on. A group of fewer than 5 readings has no pitch and may
    join any. grp stays that of the first group. Lines whose vector or group is null keep what they have.
    """
    rows = lines.withColumn("_v", unit("embedding"))

    def work(table: pa.Table) -> dict:
        names, places = _grouped(table["grp"].to_numpy())
        vectors, readings = _matrix(table["_v"]), _readings(table)
        sums = np.array([vectors[p].sum(axis=0) for p in places])
        spoken = [[x for k in p.tolist() for x in readings[k]] for p in places]
        means = np.array([_mean(s[None, :]) for s in sums])
        median = lambda x: np.nan if (m := _upper_median(x)) is None else m
        hz = np.array([median(x) for x in spoken])

        def row(i: int) -> np.ndarray:
            return np.where(np.abs(hz - hz[i]) > pitch_hz, -np.inf, np.round(means @ means[i], 9))

        def merge(a: int, b: int) -> None:
            sums[a] += sums[b]
            spoken[a] += spoken[b]
            means[a], hz[a] = _mean(sums[a][None, :]), median(spoken[a])

        into = joined_in_order(len(names), row, merge, least, last=True)
        grp = np.empty(len(vectors), dtype=np.int64)
        for i, p in zip(into.tolist(), places, strict=True):
            grp[p] = names[i]
        return {"grp": grp}

    usable = F.col("_v").isNotNull() & F.col("grp").isNotNull()
    done = _by_key(rows.where(usable).withColumn("grp", F.col("grp").cast("long")), ["ord"], work, "grp long").drop("_v")
    return done.select(*lines.columns).unionByName(rows.where(~usable).withColumn("grp", F.col("grp").cast("long")).select(*lines.columns))


def characters(lines: DataFrame, least: float = SAME_CHARACTER, most: int = MOST_SPEAKERS) -> DataFrame:
    """Groups that are characters of a recording, and all measured lines given to them: the lines with `owner`, the place of
    their character in order (from 0), and `role` of it (main, minor, or group where no group is large enough).

    lines: (key, ord, start_us, end_us, grp, embedding, pitch array); grp is null for lines that took no part in grouping. A
    character has 1 % of the measured lines (2 to 5), or 2 % of the speech (4 to 12 s); those who speak most come first, at
    most `most`. A smaller group is the character of its gender that it is most like, of any where none has its gender; one
    that is not `least` like it, with 2 lines and 3 s or more, is a minor character of its own, and later ones may be
    like it. Lines without a group go to the character of their gender that they are most like. Lines without a vector
    are in no row; a recording without groups has none.
    """
    rows = lines.withColumn("_v", unit("embedding")).where("_v is not null")

    def work(table: pa.Table) -> dict:
        vectors, readings = _matrix(table["_v"]), _readings(table)
        length = table["end_us"].to_numpy() - table["start_us"].to_numpy()
        known = ~np.isnan(table["grp"].to_numpy().astype(np.float64)) if table["grp"].null_count else np.ones(len(length), dtype=bool)
        where = np.flatnonzero(known)
        # the smallest ord of a group names it, so their order is that of their first lines
        _, places = _grouped(np.array([g for g in table["grp"].to_pylist() if g is not None], dtype=np.int64)) if len(where) else (None, [])
        groups = [where[p] for p in places]
        gender = lambda p: _gender([x for k in p.tolist() for x in readings[k]])
        lines_needed = min(max(round(len(length) * 0.01), 2), CHARACTER_LINES)
        speech_needed = min(max(int(int(length.sum()) * 0.02), 4_000_000), CHARACTER_US)
        spoken = [int(length[p].sum()) for p in groups]
        ordered = sorted(range(len(groups)), key=lambda g: -spoken[g])
        main = [g for g in ordered if len(groups[g]) >= lines_needed or spoken[g] >= speech_needed][:most]
        owner, role = np.full(len(length), -1), np.full(len(length), "main", dtype=object)
        if not main:  # nobody is large enough: every group is a speaker
            for k, p in enumerate(groups):
                owner[p], role[p] = k, "group"
            return {"owner": owner, "role": role}
        means, genders, minor = [_mean(vectors[groups[g]]) for g in main], [gender(groups[g]) for g in main], set()

        def nearest(vector: np.ndarray, own: str | None) -> tuple[int, float]:
            alike = np.round(np.array(means) @ vector, 9)
            fits = np.array([own is None or g is None or g == own for g in genders])
            alike = np.where(fits, alike, -np.inf) if fits.any() else alike
            return int(alike.argmax()), float(alike.max())

        for k, g in enumerate(main):
            owner[groups[g]] = k
        for g in ordered:
            if g in main:
                continue
            p = groups[g]
            mean, own = _mean(vectors[p]), gender(p)
            k, alike = nearest(mean, own)
            if alike < least and len(means) < most and len(p) >= MINOR_LINES and spoken[g] >= MINOR_US:
                k = len(means)
                means.append(mean)
                genders.append(own)
                minor.add(k)
            owner[p] = k
        for i in np.flatnonzero(owner < 0).tolist():
            owner[i] = nearest(vectors[i], _gender(readings[i]))[0]
        role[np.isin(owner, list(minor))] = "minor"
        return {"owner": owner, "role": role}

    found = _by_key(rows.withColumn("grp", F.col("grp").cast("long")), ["start_us", "ord"], work, "owner long, role string")
    return found.where("owner >= 0").drop("_v")


def nearest_owner(lines: DataFrame, near: int = 3, same_us: int = 3_000_000) -> DataFrame:
    """Lines without an owner take that of a line near them in time: the lines with owner filled, and by_neighbour.

    lines: (key, ord, start_us, end_us, owner, owner_gender, own_gender); those with an owner are the ones looked at. Of the
    `near` lines on either side, or where none of these has an owner the next ones that do, the one with the smallest gap
    counts, the earlier of equal ones, and the one before of two equally far ones; but of a line whose own gender is known, one
    whose owner has it comes first where its gap is within same_us. Windows only. A key without any owner keeps nulls.
    """
    w = Window.partitionBy("key").orderBy("start_us", "ord")
    place = F.row_number().over(w)
    one = lambda i: F.struct(F.col("_i").alias("i"), "start_us", "end_us", "owner", "owner_gender")
    rows = lines.withColumn("_i", place).withColumn("_o", F.when(F.col("owner").isNotNull(), one(0)))
    sides = [(F.lag("_o", d).over(w), F.lead("_o", d).over(w)) for d in range(1, near + 1)]
    rows = rows.withColumn("_near", F.array(*(x for pair in sides for x in pair)))
    far = F.array(F.last("_o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("_o", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.withColumn("_far", F.filter(far, lambda x: x.isNotNull())).withColumn("_near", F.filter("_near", lambda x: x.isNotNull()))
    away = lambda x: F.abs(x["i"] - F.col("_i"))
    closest = F.array_min(F.transform("_far", away))
    seen = F.when(F.size("_near") > 0, F.col("_near")).otherwise(F.filter("_far", lambda x: away(x) == closest))
    gap = lambda x: F.when(x["i"] < F.col("_i"), F.col("start_us") - x["end_us"]).otherwise(x["start_us"] - F.col("end_us"))
    ranked = F.transform(seen, lambda x: F.struct(gap(x).alias("gap"), away(x).alias("away"), (x["i"] > F.col("_i")).alias("behind"), x["owner"].alias("owner"), x["owner_gender"].alias("gender")))
    rows = rows.withColumn("_ranked", ranked)
    same = F.array_min(F.filter("_ranked", lambda x: F.coalesce((x["gender"] == F.col("own_gender")) & (x["gap"] <= same_us), F.lit(False))))
    pick = F.coalesce(same, F.array_min("_ranked"))["owner"]
    alone = F.col("owner").isNull()
    found = rows.withColumns({"by_neighbour": alone & pick.isNotNull(), "owner": F.coalesce("owner", pick)})
    return found.select(*lines.columns, "by_neighbour")


def find_speakers(lines: DataFrame, reliable_us: int = 1_200_000) -> tuple[DataFrame, DataFrame]:
    """The speakers of recordings: (lines (key, ord, speaker, by_neighbour), speakers (key, speaker, lines, pitch_hz, gender,
    uncertain, embedding)).

    lines: (key, ord, start_us, end_us, embedding, pitch array); those that do not last are left out. Lines of reliable_us
    or more (all where fewer than 3 are) are grouped, alike groups joined, characters kept; measured lines go to the
    character they are like, the others to that of a line near in time. Speakers are numbered from 1 by their lines.
    A recording without any vector has one speaker.
    """
    rows = lines.where(F.col("end_us") > F.col("start_us")).select("key", F.col("ord").cast("long").alias("ord"), "start_us", "end_us", unit("embedding").alias("embedding"), F.coalesce("pitch", F.array().cast("array<double>")).alias("pitch"))
    rows = kept(rows)
    long_enough = F.col("end_us") - F.col("start_us") >= reliable_us
    n = F.count_if(long_enough & F.col("embedding").isNotNull()).over(Window.partitionBy("key"))
    reliable = rows.withColumn("_n", n).where(F.col("embedding").isNotNull() & (long_enough | (F.col("_n") < 3)))
    grouped = rows.join(clustered(reliable), ["key", "ord"], "left")
    owners = kept(characters(merged_alike(grouped)).select("key", "ord", "owner"))
    readings = rows.join(owners, ["key", "ord"]).select("key", "owner", F.explode("pitch").alias("hz"))
    pitch = F.when(F.col("n") >= LEAST_READINGS, F.col("hz"))
    genders = ranks.at_ranks(readings, ["key", "owner"], "hz", {"hz": ranks.median()}).select("key", "owner", gender_of(pitch).alias("owner_gender"))
    own = F.when(F.size("pitch") >= LEAST_READINGS, gender_of(F.get(F.array_sort("pitch"), F.floor(F.size("pitch") / 2).cast("int"))))
    met = rows.withColumn("own_gender", own).join(owners, ["key", "ord"], "left").join(genders, ["key", "owner"], "left")
    given = nearest_owner(met).withColumn("owner", F.coalesce("owner", F.lit(0)))
    counts = given.groupBy("key", "owner").agg(F.count("*").alias("lines"))
    numbered = counts.withColumn("speaker", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("lines"), "owner")))
    placed = kept(given.join(numbered.select("key", "owner", "speaker", "lines"), ["key", "owner"]).select("key", "ord", "speaker", "lines", "by_neighbour", "embedding", "pitch"))
    heard = ranks.at_ranks(placed.select("key", "speaker", F.explode("pitch").alias("hz")), ["key", "speaker"], "hz", {"hz": ranks.median()}).select("key", "speaker", pitch.alias("pitch_hz"))
    parts = placed.select("key", "speaker", F.posexplode("embedding").alias("pos", "x")).groupBy("key", "speaker", "pos").agg(F.sum("x").alias("s"))
    means = parts.groupBy("key", "speaker").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("v")).select("key", "speaker", unit("v").alias("embedding"))
    speakers = placed.groupBy("key", "speaker").agg(F.first("lines").alias("lines")).join(heard, ["key", "speaker"], "left").join(means, ["key", "speaker"], "left")
    speakers = speakers.select("key", "speaker", "lines", "pitch_hz", gender_of("pitch_hz").alias("gender"), gender_uncertain("pitch_hz", "lines").alias("uncertain"), "embedding")
    return placed.select("key", "ord", "speaker", "by_neighbour"), speakers

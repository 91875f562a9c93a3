"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k sampling.

Unigrams and bigrams of words and signs are hashed into a fixed number of features. The raw model counts them over all documents, the
target model over labelled good ones (a bounded sample of the labels, by hash; half of it, the other half calibrates).
A feature's log ratio counts only where its target count differs from the expected one by several standard errors.

A document is judged twice. `least_window` is the log weight of its least likely window of words, so that one bad passage
is not drowned by a long good rest. `evidence` is for signs that stand far apart: ratios of the numbers of documents that
have a feature, of which only negative ones count, are summed over the passage of any length where they fall furthest
below a drift, which is twice their rate in good calibration documents. The lesser, on one scale, is the log weight.

Both are least values over places, which fall with the logarithm of the number of places; the slope is read off the tail
of the good calibration documents and the length is taken out, so one level holds for texts of any length. The level
stands beyond the quantile KEEP of the good calibration documents by MARGIN times the distance to that of ten times as many.

k is the number of documents whose log weight reaches the level. The k documents with the largest weight / temperature + Gumbel noise are the sample. The noise is a
hash of the id, so a run can be repeated; k-th largest keys are found by counting, not by sorting in one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jaccard import mix
from .shared import Memo, materialise, named, narrow, numbered, pack, place_of, slices, unpack, words

FEATURES, CHUNKS = 1 << 20, 16
SAMPLE = 20_000
WINDOW, GATE, PRIOR = 32, 3.0, 0.5
KEEP, TEMPERATURE, SEED = 0.995, 0.1, 11
#: Of a decade of the tail; and the evidence that no document is rejected without.
MARGIN, STRENGTH = 0.5, 5.0


_PARTS = re.compile(r"\w+|\W+")


def part_hashes() -> Memo:
    """The hashes of a word's tokens; made in each task."""
    h = xxhash.xxh3_64_intdigest
    return Memo(lambda w: b"".join(h(p.encode("utf-8", "surrogatepass")).to_bytes(8, "little") for p in _PARTS.findall(w)))


def grams(text: str | None, hashes: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Features of the tokens, which are runs of letters and digits or of other signs, and of the pairs of neighbours.

    All pairs of equal tokens are one feature: repetition is a trait of a text, whatever is repeated.
    """
    h = np.frombuffer(b"".join(map(hashes.__getitem__, words(text))), dtype=np.uint64)
    pairs = np.where(h[:-1] == h[1:], np.uint64(1), mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]))
    low = np.uint64(FEATURES - 1)
    return (h & low).astype(np.int64), (pairs & low).astype(np.int64)


def least_window(one: np.ndarray, two: np.ndarray, ratio: np.ndarray) -> float:
    """Log weight of the least likely window; 0 without words."""
    value = ratio[one].astype(np.float64)
    value[1:] += ratio[two]
    total = np.r_[0.0, np.cumsum(value)]
    return float((total[WINDOW:] - total[:-WINDOW]).min() if len(value) > WINDOW else total[-1])


def evidence(one: np.ndarray, two: np.ndarray, against: np.ndarray, drift: float) -> float:
    """The least sum of negative ratios, each token adding the drift, over any run of tokens; 0 without any."""
    value = against[one].astype(np.float64) + drift
    value[1:] += against[two]
    total = np.r_[0.0, np.cumsum(value)]
    return float((total - np.maximum.accumulate(total)).min())


def gumbel(doc_id: int | None, seed: int) -> float:
    u = (xxhash.xxh3_64_intdigest(str(doc_id).encode(), seed=seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


def _kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest of a column, by narrowing a histogram until few values are left."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        inside = values.where(F.col(column).between(low, high))
        n = inside.count()
        if n <= 10_000 or low == high:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - above - 1] if n <= 10_000 else low
        step = (high - low) / 1000
        cell = F.least(F.lit(999), F.floor((F.col(column) - low) / step)).cast("int")
        cells = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("cell")).collect()
        for row in cells:
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]


class QualityModel:
    """What a fit leaves, of fixed size: a ratio for each feature by its counts, the negative ones by documents, the drift."""

    def __init__(self, ratio: np.ndarray, against: np.ndarray, drift: float):
        self.ratio, self.against, self.drift = ratio, against, drift


class Scale:
    """Puts both scores on one scale on which `level` parts the texts; see the text above. tail: sorted columns of the
    good calibration documents, (least_window, evidence, tokens); empty ones give least(both) and no level."""

    def __init__(self, tail: tuple[list[float], list[float], list[int]], keep: float):
        self.level, self.slopes, self.share, self.size = float("-inf"), (0.0, 0.0), 1.0, 1.0
        if not tail[0]:
            return
        n, out = len(tail[0]), min(1.0, 1 - keep)
        ends = [(x[int(n * out)], x[min(n - 1, int(n * min(0.5, 10 * out)))]) for x in tail[:2]]
        ends = [(a, max(a, b)) for a, b in ends]
        window, other = (min(-STRENGTH, a - MARGIN * (b - a)) for a, b in ends)
        self.level, self.share = window, window / other
        self.slopes = tuple((b - a) / np.log(10) for a, b in ends)
        self.size = float(max(1, tail[2][n // 2]))

    def log_weight(self) -> Column:
        longer = F.log(F.greatest(F.lit(1.0), F.col("tokens") / F.lit(self.size)))
        window, other = (F.col(c) + F.lit(float(s)) * longer for c, s in zip(("window", "evidence"), self.slopes, strict=True))
        return F.least(window, other * F.lit(self.share))


def _labelled(labels: DataFrame, sample: int) -> dict[int, tuple[bool, bool]]:
    """{doc_id: (good, for calibration)} of at most `sample` labelled rows, chosen by hash."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null and quality is not null")
    one = named.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    return {r["doc_id"]: (r["q"] == 1 and r["t"] == 0, i % 2 == 1) for i, r in enumerate(rows)}


def _fit(docs: DataFrame, known: dict[int, tuple[bool, bool]]) -> QualityModel:
    held = docs.sparkSession.sparkContext.broadcast({d: later for d, (good, later) in known.items() if good})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts in all, in target and in calibration documents, then numbers of documents in all and in target ones
        found = [np.zeros(FEATURES, dtype=np.int64) for _ in range(5)]
        docs_of, hashes = np.zeros(2, dtype=np.int64), part_hashes()
        for part in slices(batches, 1, 2_000_000):
            rows = [(held.value.get(d), np.concatenate(grams(t, hashes))) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            rows = [(later, f) for later, f in rows if len(f)]
            target = [f for later, f in rows if later is False]
            once = [np.unique(f) for _, f in rows]
            docs_of += (len(rows), len(target))
            groups = [f for _, f in rows], target, [f for later, f in rows if later], once, [u for u, (later, _) in zip(once, rows, strict=True) if later is False]
            for into, features in zip(found, groups, strict=True):
                if features:
                    into += np.bincount(np.concatenate(features), minlength=FEATURES)
        size = FEATURES // CHUNKS
        starts = range(0, FEATURES, size) if found[0].any() else []
        blocks = [pack(*(narrow(x[i : i + size]) for x in found), narrow(docs_of if i == 0 else docs_of * 0)) for i in starts]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["chunk", "block"])

    def add(table: pa.Table) -> pa.Table:
        total = [0] * 6
        for block in table.column("block").to_pylist():
            total = [a + b.astype(np.int64) for a, b in zip(total, unpack(block), strict=True)]
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "block": [pack(*map(narrow, total))]})

    kind = "chunk int, block binary"
    parts = {r["chunk"]: unpack(r["block"]) for r in docs.mapInArrow(count, kind).groupBy("chunk").applyInArrow(add, kind).collect()}
    if not parts:
        return QualityModel(*(np.zeros(FEATURES, dtype=np.float32) for _ in range(2)), 0.0)
    raw, target, later, raw_docs, target_docs = (np.concatenate([parts[i][k] for i in range(CHUNKS)]).astype(np.float64) for k in range(5))
    n, n_target = parts[0][5].astype(np.float64)

    def log_ratio(all_of: np.ndarray, of_target: np.ndarray, share: float) -> np.ndarray:
        expected = all_of * share
        sure = np.abs(of_target - expected) >= GATE * np.sqrt(expected + 1)
        return np.where(sure, np.log((of_target + PRIOR) / (expected + PRIOR)), 0.0).astype(np.float32)

    against = np.minimum(log_ratio(raw_docs, target_docs, n_target / n), 0)
    against[1] = 0  # repetition has no place of its own, and a longer text has more of it
    tokens = max(1.0, later.sum() / 2)  # each counts as itself and in a pair
    return QualityModel(log_ratio(raw, target, target.sum() / raw.sum()), against, float(-2 * (against * later).sum() / tokens))


def _scored(docs: DataFrame, model, seed: int) -> DataFrame:
    """(kept, window, evidence, tokens, noise) over (kept, id, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = model.value, part_hashes()
        for record in slices(batches, 2, 2_000_000):
            out = []
            for t in record.column(2).to_pylist():
                one, two = grams(t, hashes)
                out.append((least_window(one, two, m.ratio), evidence(one, two, m.against, m.drift), len(one)))
            columns = [pa.array([x[k] for x in out], pa.int64() if k == 2 else pa.float64()) for k in range(3)]
            noise = pa.array([gumbel(d, seed) for d in record.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([record.column(0), *columns, noise], names=["kept", "window", "evidence", "tokens", "noise"])

    doubles = [T.StructField(c, T.LongType() if c == "tokens" else T.DoubleType()) for c in ("window", "evidence", "tokens", "noise")]
    return docs.mapInArrow(score, T.StructType([docs.schema["kept"], *doubles]))


def importance_sample(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP, temperature: float = TEMPERATURE, seed: int = SEED, whole: bool = False
) -> tuple[DataFrame, float]:
    """((kept, id, log_weight, sample_key) of all documents, the least key that is in the sample).

    sample: labelled rows used at most. keep: share of good calibration documents whose level counts as good enough.
    whole: `kept` is a struct of all numbered columns, else null. A null or empty text has log weight 0: nothing speaks
    against it, and it stays. Without usable labels all weights are 0 and all documents are in the sample. Documents
    with equal keys at the edge are all in; repeated rows stand or fall together.
    """
    spark = docs.sparkSession
    known = _labelled(labels, sample)
    rows = numbered(docs)
    doc_id, text = F.col(place_of(docs, "doc_id")).cast("long"), F.col(place_of(docs, "text")).cast("string")
    model = spark.sparkContext.broadcast(_fit(rows.select(doc_id.alias("doc_id"), text.alias("text")), known))
    kept = F.struct(doc_id.alias("id"), (F.struct(*rows.columns) if whole else F.lit(None).cast("int")).alias("row"))
    # scored once and written with the rows, so that a filter reads the table and not the texts again
    scored = materialise(_scored(rows.select(kept.alias("kept"), doc_id.alias("id"), text.alias("text")), model, seed), "scored")
    judged = spark.createDataFrame([(d,) for d, (good, later) in known.items() if good and later], "id long")
    good = scored.select(F.col("kept.id").alias("id"), "window", "evidence", "tokens").join(F.broadcast(judged), "id").select("window", "evidence", "tokens").collect()
    scale = Scale(tuple(sorted(r[k] for r in good) for k in range(3)), keep)
    weighed = scored.select(F.col("kept.row").alias("kept"), F.col("kept.id").alias("id"), scale.log_weight().alias("log_weight"), "noise")
    keyed = weighed.select("kept", "id", "log_weight", (F.col("log_weight") / F.lit(temperature) + F.col("noise")).alias("sample_key"))
    if not good:
        return keyed, float("-inf")
    k = keyed.where(F.col("log_weight") >= scale.level).count()
    return keyed, _kth_largest(keyed.select("sample_key"), "sample_key", k) if k else float("inf")


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, log_weight, sample_key, kept) for each row of docs; see importance_sample. Further columns are not
    carried; a null doc_id is an id like others; an empty table gives an empty one."""
    keyed, least = importance_sample(docs, labels, **options)
    return keyed.select(F.col("id").alias("doc_id"), "log_weight", "sample_key", (F.col("sample_key") >= F.lit(least)).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that quality_scores keeps."""
    keyed, least = importance_sample(docs, labels, whole=True, **options)
    return keyed.where(F.col("sample_key") >= F.lit(least)).select(named("kept", docs.columns))

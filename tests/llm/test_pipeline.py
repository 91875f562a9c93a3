"""The pipeline's rows against a brute-force run of its stages."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pandas as pd
import public_tokenizers as P
from tokenizers import Tokenizer

from cueframe.llm.quality import quality_scores

from ..conftest import SMALL
from .test_duplicates import merged, shingles
from .test_models import WORD, brute_tiles


def covered(item, text):
    a, b = ([w for w in WORD.findall(t.lower())] for t in (item, text))
    k = min(3, len(a))
    runs = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
    shared = {j for i in range(len(a) - k + 1) if tuple(a[i : i + k]) in runs for j in range(i, i + k)}
    # tiles lie in runs of three that both have
    return bool(a) and len(shared) >= 0.5 * len(a) and sum(t[2] for t in brute_tiles(a, b, k)) >= 0.5 * len(a)


def test_pipeline(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    frames = [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")]
    kept = {r.doc_id for r in quality_scores(*frames).where("kept").collect()}
    docs = docs[docs.doc_id.isin(kept)]
    assert len(kept) < 200
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    sets = {i: shingles(t) for i, t in text.items()}
    links = [(i, j) for i in text for j in text if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    heads = {i: t for i, t in text.items() if merged(text, links)[i] == i}
    bench = pd.read_parquet(f"{SMALL}/benchmark.parquet").text
    clean = {i: t for i, t in heads.items() if not any(covered(b, t) for b in bench)}
    assert len(clean) < len(heads) < len(text)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    wanted = {i: hashlib.sha256(" ".join(map(str, t.encode(x or "", add_special_tokens=False).ids)).encode()).hexdigest() for i, x in clean.items()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SMALL).collect()} == wanted


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_one_row_of_each_group_with_repeated_and_null_ids(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(4)]
    near = texts[0] + " tail"
    rows = [(1, texts[0], "a"), (2, near, "b"), (2, texts[1], "c"), (3, texts[2], "d"), (3, texts[2], "e"), (None, texts[2], "f"), (None, texts[3], "g"), (None, texts[3], "h"), (None, near, "i"), (5, "", "j"), (None, None, "k"), (5, "", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    found = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert found.dtypes == docs.dtypes
    kept = sorted((x.doc_id or 0, x.text or "") for x in found.collect())
    assert kept == sorted([(1, texts[0]), (2, texts[1]), (3, texts[2]), (0, texts[3]), (5, ""), (5, ""), (0, "")])

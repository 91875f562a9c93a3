"""Jaccard join, embeddings and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from cueframe.llm import jaccard
from cueframe.llm.embeddings import embedding_duplicates
from cueframe.llm.jaccard import jaccard_components
from cueframe.llm.shared import components, from_planes, planes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def merged(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def made_documents():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = r.choices(vocabulary, k=60)
    docs = [None, "", " \t\n", "One two", "one TWO", "one  two three", "a b c d e", " x y", " x y"]
    base = r.choices(vocabulary, k=150)
    for k in range(60):  # edited copies of one text, some closer to it than to each other
        copy = list(base)
        for _ in range(r.randrange(0, 9)):
            copy[r.randrange(len(copy))] = f"edit{r.random()}"
        docs.append(" ".join(copy))
    for k in range(60):  # documents that share a passage, at all shares
        own = r.choices(vocabulary, k=r.choice([3, 10, 15, 30, 100]))
        docs.append(" ".join([*own, *passage]))
    docs += [" ".join(r.choices(vocabulary, k=r.randrange(1, 400))) for _ in range(60)]
    docs += [docs[20]] * 15
    return docs


@pytest.mark.parametrize(("buckets", "meet"), [(8, 1_000), (1_000, 3)])
def test_jaccard_against_all_pairs(spark, monkeypatch, buckets, meet):
    monkeypatch.setattr(jaccard, "buckets_for", lambda docs, text: buckets)
    monkeypatch.setattr(jaccard, "MEET", meet)
    docs = made_documents()
    rows = [(i, t, "x") for i, t in enumerate(docs)] + [(None, docs[30], "x")]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, token string").repartition(6)).collect()
    sets = [shingles(t) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    wanted = merged(range(len(docs)), links)
    assert len(found) == len(rows) and len(links) > 200
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == {i: (len(sets[i]), wanted[i]) for i in range(len(docs))}
    assert [r.component_id for r in found if r.doc_id is None] == [None]


def test_jaccard_of_ids_with_several_texts(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(7, a), (7, "quite another text of seven words here"), (3, a + " more"), (5, "of its own"), (7, a), (7, a)]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [(3, 57, 3), (5, 1, 5), (7, 3, 7), (7, 56, 3), (7, 56, 3), (7, 56, 3)]


def test_embeddings_of_ids_with_several_vectors_and_of_nothing(spark):
    rows = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (9, [1.0, 0.01], 1), (10, [-1.0, 0.0], 1)]
    found = embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [(7, 0, 7, True), (7, 1, 7, True), (9, 1, 7, False), (10, 0, 10, True)]
    assert embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_many_sets_of_one_token_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEET", 7)
    rows = [(1, 5, d) for d in range(100)] + [(2, 5, d) for d in range(7)] + [(3, s, d) for s in (4, 5) for d in range(8)]
    each, other = (spark.createDataFrame(rows, f"token long, step int, {d} long") for d in ("d", "d_b"))
    found = jaccard._meeting(each, other)
    assert found.where("token = 1").select("part").distinct().count() == 15
    assert found.where("token = 2").select("part").distinct().count() == 1
    pairs = sorted(tuple(r) for r in found.select("token", "step", "d", "d_b").collect())
    assert pairs == sorted((t, s, d, e) for t, s, d in rows for u, v, e in rows if (t, s) == (u, v))


def test_a_batch_names_only_buckets_that_it_meets(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "doc_id long, text string").coalesce(1)
    packed = docs.mapInArrow(jaccard._pack_sets(5, 80, 10_000_000), jaccard._PACKED).collect()
    assert sorted(r.head for r in packed) == [False] * 3 + [True]
    assert sum(len(r.block) for r in packed) < 1_000


def test_jaccard_of_nothing(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert jaccard_components(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect() == [(1, 0, 1), (2, 0, 2)]


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        centers = r.standard_normal((12, 16))
        for k in range(150):
            v = centers[k % 12] + r.standard_normal(16) * r.choice([0.05, 0.2, 0.4])
            rows.append((len(rows), v.tolist(), label))
    rows += [(len(rows), None, 0), (len(rows) + 1, [0.0] * 16, 0), (len(rows) + 2, [float("nan")] * 16, 0), (len(rows) + 3, [None] * 16, 1), (len(rows) + 4, rows[0][1], None), (len(rows) + 5, [3 * x for x in rows[0][1]], 0)]
    rows += [(len(rows) + i, rows[7][1], 0) for i in range(40)]
    found = {x.vec_id: x for x in embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if label is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(i, j) for i in unit for j in unit if j < i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93]
    wanted, degree = merged(range(len(rows)), links), np.bincount(np.array(links).ravel(), minlength=len(rows))
    assert len(found) == len(rows) and len(links) > 500
    assert sum(x.n_links for x in found.values()) >= 0.98 * degree.sum()
    assert all(found[i].n_links <= degree[i] for i in range(len(rows)))
    assert sum(found[i].component_id != wanted[i] for i in range(len(rows))) <= 0.02 * len(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in found.values())


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(7, 7), (None, 3), (200, 100)]
    wanted = merged(range(201), [x for x in links if None not in x])
    found = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found and all(wanted[i] == c for i, c in found.items())
    assert set(found) == {i for x in links if None not in x and x[0] != x[1] for i in x}


@pytest.mark.parametrize("given", [[], [7], [0, 1, 2, 1 << 39], [*range(300)]])
def test_planes(given):
    a = np.array(given, dtype=np.uint64)
    assert (from_planes(planes(a)) == a).all() and len(from_planes(planes(a))) == len(a)

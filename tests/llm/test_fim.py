"""Fill-in-the-middle against plain slicing of the text, and ropes against strings."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from cueframe.llm import fim
from cueframe.llm.fim import Middles, fill_in_middle, fim_digests, restore_middle

TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "é\r\n漢字\x0b\n😀\n\nlast", "a<P>b\nc", "x<M>\n", "<\nP>\n<", ">\n<P\n<S\n", "a\n" * 3000, "long " * 40_000, ("w " * 900 + "\n") * 300,
    "twice\nthe same\n", "twice\nthe same\n",
]


def plainly(doc_id, text, how=Middles()):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(s in text for s in how.sentinels) or h3 % 100 >= how.rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < how.suffix_first:
        return n, "spm", len(p), len(m), how.suffix + s + how.prefix + p + how.middle + m
    return n, "psm", len(p), len(m), how.prefix + p + how.suffix + s + how.middle + m


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS * 4)] + [(None, "no\nid\n", "x", 2), (3, TEXTS[3], "again", 3), (-5, "below\nzero", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, output string, N long")


@pytest.mark.parametrize("how", [Middles(), Middles(rate=40, suffix_first=10, seed=1), Middles(prefix="[p]", suffix="[s]", middle="[m]")])
def test_outputs_and_round_trip(docs, how):
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    made = fill_in_middle(docs, how)
    found = sorted((tuple(r) for r in made.collect()), key=repr)
    assert found == sorted(((i, *plainly(i, t, how)) for i, t in texts), key=repr)
    assert sorted((tuple(r) for r in restore_middle(made, how).collect()), key=repr) == sorted(texts, key=repr)


def test_digests(docs, spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    wanted = [(r.doc_id, *plainly(r.doc_id, r.text)[:4], sha(plainly(r.doc_id, r.text)[4]), sha(r.text or "")) for r in docs.collect()]
    assert sorted((tuple(r) for r in fim_digests(docs).collect()), key=repr) == sorted(wanted, key=repr)
    assert fim_digests(docs.limit(0)).count() == 0
    forms = {r.form for r in fim_digests(docs).collect()}
    assert forms == {"plain", "psm", "spm"}


def test_ropes_split_anywhere(monkeypatch):
    monkeypatch.setattr(fim, "LEAF", 3)
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choices("ab\n<PS>é", k=r.randrange(0, 40)))
        whole = fim.rope(text)
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert fim.units(whole) == len(lines) and whole.chars == len(text)
        k, u = r.randrange(0, len(text) + 1), r.randrange(0, len(lines) + 1)
        assert tuple(map(fim.text_of, fim.split(whole, k))) == (text[:k], text[k:])
        assert tuple(map(fim.text_of, fim.split_units(whole, u))) == ("".join(lines[:u]), "".join(lines[u:]))
        for what in ("<P>", "<S>", "ab\n"):
            assert fim.find(whole, what) == text.find(what)


def test_sentinels_that_overlap_are_refused():
    for bad in ({"prefix": ""}, {"prefix": "<P>", "suffix": "P>x"}, {"prefix": "<M", "middle": "<M>"}, {"prefix": "aa"}):
        with pytest.raises(ValueError):
            Middles(**bad)


def test_unknown_form_is_refused(spark):
    with pytest.raises(Exception, match="no form"):
        restore_middle(spark.createDataFrame([(1, "x", "other")], "doc_id long, output string, form string")).collect()

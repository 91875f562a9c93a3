"""Main text and WARC fixity."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cueframe.llm.html_extract import blocks, extract_text, node_statistics, parse
from cueframe.llm.shared import new_folder
from cueframe.llm.warc import audit, fixity_audit, leaves, merkle_tree, read_warc, replicate, write_warc

from ..conftest import SMALL

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav>
<div class="sidebar">Side</div><article><h1>Head &amp; line</h1><p>First   <b>part</b>&nbsp;here.<p>Second</p><script>x()</script>
<ul><li>one<li>two</ul></article><section id="comments"><p>Reader</p></section><footer>Foot</footer></body></html>"""


def test_main_text():
    # no tag says what the side and the comments are; that is for the tree of many pages
    assert blocks(parse(PAGE), {}) == ["Side", "Head & line", "First part here.", "Second", "one", "two", "Reader"]
    for odd in ("", "<", "<p", "a<b", "<p>x</div></p>", "<!-- never", "<script>", "</p>", "<div " * 50):
        assert isinstance(blocks(parse(odd), {}), list)
    assert blocks(parse("<div>" * 3000 + "deep" + "</div>" * 3000), {}) == ["deep"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p title=it's>One</p><p>don't</p>", ["One", "don't"]), ('<p class=x">Hello</p>', ["Hello"]), ('<p a="b"">Hi</p>', ["Hi"]), ("<p a='b'c=d>Hi</p>", ["Hi"]), ("<p =x>Hi</p>", ["Hi"]), ("<p a=>Hi</p>", ["Hi"]),
        ('<p title="1 > 0">Hi</p>', ["Hi"]), ("<p title='1 > 0' >Hi</p >there", ["Hi", "there"]), ("<p\na\n=\n'x>y'\n>Hi", ["Hi"]), ('<p title="never closed>Hi</p><p>there</p>', ["Hi", "there"]), ("a < b <p>c", ["a < b", "c"]),
        ("<p>x</p></3 gone><!doctype y><p>z</p><?php 1 > 2 ?>", ["x", "z", "2 ?>"]), ("<p>one<br/>two<br />three", ["one two three"]), ("<p>kept</p><div class='cut off", ["kept"]), ("<a href=x/y/>link</a> <b>bold</b>", ["link bold"]),
        ("<p>x &amp;lt; &#x41;&nbsp;y</p>", ["x &lt; A y"]), ("<textarea>no</textarea><title>no</title>yes", ["yes"]), ("<p>a<div>b</div>c</p>d", ["a", "b", "cd"]), ("<P CLASS=A>Up</P>", ["Up"]),
    ],
)
def test_tags_as_html_reads_them(html, text):
    assert blocks(parse(html), {}) == text


@pytest.mark.parametrize("part", ["<b ", "<p class='", '<a "', "<a b=\"x", "<!", "<!-", "<!--", "</", "</b", "<a =", "<a b = ", "<", "<![CDATA[", "<textarea>", "<script>", "<div><b></i>", "<li><b>", "<p><b>", "<a b/", "<td><i>"])
def test_broken_markup_takes_linear_time(part):
    import time

    for size in (60_000, 2_000_000):
        start = time.process_time()
        parse(part * (size // len(part)))
        assert time.process_time() - start < (3 if size < 100_000 else 30)


def test_few_pages_go_by_the_same_rule(spark):
    """A page's own text stays beside an empty main element, in a table of one page as among many; no page loses all."""
    one = "<div><p>own text</p></div><main></main>"
    kind = "page_id long, url string, html string"
    alone = extract_text(spark.createDataFrame([(1, "http://a.example/", one)], kind)).first().text
    many = [(i, f"http://a.example/{i}", f"<div><p>{'other words here ' * (i % 9 + 1)}{i}</p></div><main></main>") for i in range(40)]
    found = {r.page_id: r.text for r in extract_text(spark.createDataFrame([(1000, "http://a.example/", one), *many], kind)).collect()}
    assert alone == found[1000] == "own text"
    same = [(i, f"http://b.example/{i}", "<body><div class='x'><p>Only what every page says</p></div></body>") for i in range(40)]
    assert all(r.text for r in extract_text(spark.createDataFrame(same, kind)).collect())


def plain_statistics(pages):
    """The style trees of (host, html), written plainly: {(host, node): (pages, style, mass, fresh, words)}."""
    seen = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for number, (host, html) in enumerate(pages):
        todo = [parse(html or "")]
        while todo:
            node = todo.pop()
            if node.noise:
                continue
            mine = seen[host, node.unit.path - (1 << 63)]
            if node.unit is node:
                mine["page"][0].add(number)
                mine["style"]["|".join(c.look for c in node.children if not isinstance(c, str))].add(number)
            for c in node.children:
                if isinstance(c, str):
                    if c.split():
                        mine["text"][" ".join(c.split())].add(number)
                else:
                    todo.append(c)
    out = {}
    for key, x in seen.items():
        m = len(x["page"][0])
        style = None if m == 1 else -sum(len(p) / m * math.log(len(p) / m) for p in x["style"].values()) / math.log(m)
        words = sum(len(t.split()) * len(p) for t, p in x["text"].items())
        fresh = sum(len(t.split()) * len(p) * (1 - (math.log(len(p)) / math.log(m) if m > 1 else 0)) for t, p in x["text"].items())
        out[key] = (m, style, 0.7 * fresh + 0.3 * words, fresh, words)
    return out


def test_importances_against_plain_sums(spark):
    rows = [(i % 3, p.html) for i, p in enumerate(spark.read.parquet(f"{SMALL}/pages.parquet").collect())]
    rows = [(f"h{h}", t) for h, t in rows] + [("h0", PAGE), ("h0", PAGE), ("h1", None), ("lone", "<div class='x'>a b<p>c</div>")]
    found = {(r.host, r.node): r for r in node_statistics(spark.createDataFrame(rows, "host string, html string")).collect()}
    wanted = plain_statistics(rows)
    assert set(found) == set(wanted)
    for key, (m, style, mass, fresh, words) in wanted.items():
        r = found[key]
        assert (r.pages, r.words, r.style is None) == (m, words, style is None)
        assert r.mass == pytest.approx(mass) and r.fresh == pytest.approx(fresh, abs=1e-9) and (style is None or r.style == pytest.approx(style, abs=1e-9))


def test_the_tree_removes_what_no_tag_names(spark):
    """Without names of classes: an advert in a div goes by its importance; without a tree it stays."""
    words = lambda n, k: " ".join(f"w{i * k % 97}x{k}" for i in range(n))
    page = lambda i: f"<body><div class='zone'>{words(6, i)}</div><div class='text'>{''.join(f'<p>{words(30, i + j)}</p>' + '<h2>Part</h2>' * (j % (i % 5 + 2) == 1) for j in range(i % 7 + 2))}</div></body>"
    rows = [(i, f"http://x.example/{i}", page(i)) for i in range(60)]
    found = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        off = blocks(parse(html), {})
        assert off[0] == words(6, i) and found[i].split("\n") == off[1:]


def test_very_long_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>word{i} of a long page</p>" for i in range(60_000)) + "</article>"
    rows = [(1, "u", long), (1, "u", long), (None, None, "<p>x")]
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in found) == [1] + [sum(len(f"word{i} of a long page") + 1 for i in range(60_000)) - 1] * 2


def test_repeated_branches_go_and_own_text_stays(spark):
    boiler = "<div><p>Same words on every page of this host</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{boiler}<div><p>Own words number {i} {i * i}</p></div>{boiler}</body>") for i in range(30)]
    rows += [(100, None, None), (101, "http://b.example/", "<p>alone</p>"), (102, "http://b.example/", ""), (102, "http://b.example/", "")]
    found = extract_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, low string")).collect()
    assert len(found) == len(rows)
    text = {r.page_id: r.text for r in found}
    assert all(f"Own words number {i} {i * i}" in text[i] for i in range(30))
    assert text[100] == text[102] == "" and text[101] == "alone"
    assert all(r.n_chars == len(r.text) for r in found)


def test_fixity(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").repartition(3)
    found = fixity_audit(pages, F.crc32(F.col("page_id").cast("string")) % 11 == 7).collect()
    assert len(found) == pages.count()
    assert {r.page_id for r in found if not r.intact} == {r.page_id for r in found if zlib.crc32(str(r.page_id).encode()) % 11 == 7} != set()


def plain_root(path, fanout=16):
    """The root of an archive's tree, from its bytes alone: gzip members one after another."""
    with open(path, "rb") as f:
        data = f.read()
    hashes, at = [], 0
    while at < len(data):
        member = zlib.decompressobj(31)
        member.decompress(data[at:])
        size = len(data) - at - len(member.unused_data)
        hashes.append(hashlib.sha256(f"{at},{size},".encode() + data[at : at + size]).hexdigest())
        at += size
    hashes.append(hashlib.sha256(f"length {len(data)}".encode()).hexdigest())
    while len(hashes) > 1:
        hashes = [hashlib.sha256(",".join(f"{i}:{hashes[i]}" for i in range(k, min(k + fanout, len(hashes)))).encode()).hexdigest() for k in range(0, len(hashes), fanout)]
    return hashes[0]


def test_roots_from_the_files_alone(spark):
    manifest = write_warc(spark.read.parquet(f"{SMALL}/pages.parquet").repartition(2), new_folder(spark, "warc"))
    tree = merkle_tree(leaves(manifest))
    top = tree.agg(F.max("level")).first()[0]
    roots = {r.archive: r.hash for r in tree.where(F.col("level") == top).collect()}
    files = {r.archive: r.path.removeprefix("file://") for r in manifest.select("archive", "path").distinct().collect()}
    assert len(roots) == 2 and roots == {a: plain_root(p) for a, p in files.items()}


def test_archives_give_back_their_pages(spark):
    rows = [(1, "http://a", "<p>x</p>"), (1, "http://a", "<p>x</p>"), (None, None, None), (2, "", ""), (3, "u v", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = write_warc(pages, new_folder(spark, "warc"))
    key = lambda r: repr(r)
    assert sorted(map(tuple, read_warc(manifest).collect()), key=key) == sorted([(a, b or None, c) for a, b, c in rows], key=key)
    copy = replicate(manifest, new_folder(spark, "replica"))
    assert audit(merkle_tree(leaves(manifest)), merkle_tree(leaves(copy))).count() == 0
    one = copy.where("page_id = 3").first()
    with open(one.path.removeprefix("file://"), "ab") as f:
        f.write(b"tail")
    last = copy.where(F.col("archive") == one.archive).agg(F.max("place")).first()[0]
    assert audit(merkle_tree(leaves(manifest)), merkle_tree(leaves(copy))).collect() == [(one.archive, last + 1)]
    assert fixity_audit(pages.limit(0)).count() == 0

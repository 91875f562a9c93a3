"""Fill-in-the-middle: a text is cut at two lines and put together anew around sentinels, by a rope.

A rope is a binary tree whose leaves hold pieces of the text and whose nodes cache how many units (lines) end below them
and how many code points they hold. Splitting at a unit or a code point goes down one path and shares all other subtrees;
joining makes one node. So prefix, middle and suffix are never searched for in the whole text again, and the inverse is
three splits of the rope of the output. Everything is decided by hashes of the document's id: a task that runs again, on
any machine, gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Code points of a leaf.
LEAF = 4096


class Leaf:
    """A piece of text; `ends` units end in it."""

    __slots__ = ("chars", "ends", "text")

    def __init__(self, text: str):
        self.text, self.chars, self.ends = text, len(text), text.count("\n")


class Node:
    __slots__ = ("chars", "ends", "left", "right")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.chars, self.ends = left.chars + right.chars, left.ends + right.ends


Rope = Leaf | Node
EMPTY = Leaf("")


def rope(text: str) -> Rope:
    """A balanced rope of a text."""
    level: list[Rope] = [Leaf(text[at : at + LEAF]) for at in range(0, len(text), LEAF)] or [EMPTY]
    while len(level) > 1:
        level = [Node(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def join(*parts: Rope) -> Rope:
    """Ropes one after another; empty ones add no node."""
    out = EMPTY
    for part in parts:
        if part.chars:
            out = Node(out, part) if out.chars else part
    return out


def text_of(r: Rope) -> str:
    out, stack = [], [r]
    while stack:
        top = stack.pop()
        if isinstance(top, Leaf):
            out.append(top.text)
        else:
            stack += (top.right, top.left)
    return "".join(out)


def units(r: Rope) -> int:
    """How many lines a rope has: `[^\\n]*\\n|[^\\n]+`, so a last line may lack its end."""
    last = r
    while isinstance(last, Node):
        last = last.right
    return r.ends + (r.chars > 0 and not last.text.endswith("\n"))


def split(r: Rope, chars: int) -> tuple[Rope, Rope]:
    """The first code points, and the rest."""
    before, after = [], []
    while isinstance(r, Node):
        if chars < r.left.chars:
            after.append(r.right)
            r = r.left
        else:
            chars -= r.left.chars
            before.append(r.left)
            r = r.right
    return join(*before, Leaf(r.text[:chars])), join(Leaf(r.text[chars:]), *reversed(after))


def after_units(r: Rope, rank: int) -> int:
    """How many code points the first units have; all of them where there are no more units."""
    if rank > r.ends:
        return r.chars
    at = 0
    while isinstance(r, Node):
        if rank <= r.left.ends:
            r = r.left
        else:
            rank -= r.left.ends
            at += r.left.chars
            r = r.right
    place = 0
    for _ in range(rank):
        place = r.text.index("\n", place) + 1
    return at + place


def split_units(r: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first units, and the rest."""
    return split(r, after_units(r, rank))


def find(r: Rope, what: str) -> int:
    """The place in code points of the first occurrence, -1 if there is none; it may lie across leaves."""
    at, tail, stack = 0, "", [r]
    while stack:
        top = stack.pop()
        if isinstance(top, Node):
            stack += (top.right, top.left)
            continue
        window = tail + top.text
        found = window.find(what)
        if found >= 0:
            return at - len(tail) + found
        at += top.chars
        tail = window[1 - len(what) :] if len(what) > 1 else ""
    return -1


@dataclass(frozen=True)
class Middles:
    """How documents are transformed: the share of all that is (percent), the share of those in suffix-first order, the
    sentinels, and the number that seeds the hashes."""

    rate: int = 100
    suffix_first: int = 50
    seed: int = 7
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def __post_init__(self):
        for s in self.sentinels:
            if not s or any(s[k:] == t[: len(s) - k] for t in self.sentinels for k in range(1, len(s))) or any(s is not t and s in t for t in self.sentinels):
                raise ValueError("sentinels must not be empty, hold or overlap each other")


def transform(doc_id: int | None, text: str, how: Middles) -> tuple[int, str, int | None, int | None, Rope]:
    """(lines, form, code points of prefix and of middle, output); a form that is plain leaves the text as it is."""
    whole = rope(text)
    n = units(whole)
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    if not text or h3 % 100 >= how.rate or any(s in text for s in how.sentinels):
        return n, "plain", None, None, whole
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split_units(whole, second)
    prefix, middle = split_units(head, first)
    p, s, m = (Leaf(x) for x in how.sentinels)
    if h4 % 100 < how.suffix_first:
        return n, "spm", prefix.chars, middle.chars, join(s, suffix, p, prefix, m, middle)
    return n, "psm", prefix.chars, middle.chars, join(p, prefix, s, suffix, m, middle)


def invert(output: Rope, form: str, how: Middles) -> Rope:
    """The text that an output of a form was made from. Sentinels cannot occur inside the parts, nor across their ends."""
    if form == "plain":
        return output
    order = (how.suffix, how.prefix, how.middle) if form == "spm" else (how.prefix, how.suffix, how.middle)
    parts, rest = {}, output
    for sentinel in reversed(order):
        before, found = split(rest, find(rest, sentinel))
        parts[sentinel] = split(found, len(sentinel))[1]
        rest = before
    return join(parts[how.prefix], parts[how.middle], parts[how.suffix])


def _mapped(docs: DataFrame, how: Middles, columns: str, rows) -> DataFrame:
    kinds = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 16_000_000):
            made = [rows(doc_id, text or "", how) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kinds, strict=True)], schema=kinds)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, columns)


def _text_row(doc_id: int | None, text: str, how: Middles) -> tuple:
    n, form, p, m, output = transform(doc_id, text, how)
    return doc_id, n, form, p, m, text_of(output)


def _digest_row(doc_id: int | None, text: str, how: Middles) -> tuple:
    n, form, p, m, output = transform(doc_id, text, how)
    written = text_of(output)
    restored = text_of(invert(rope(written), form, how))  # from the text itself, as a reader has it
    return doc_id, n, form, p, m, *(hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (written, restored))


def fill_in_middle(docs: DataFrame, how: Middles = Middles()) -> DataFrame:
    """Every text in its new order: (doc_id, n, form, prefix_chars, middle_chars, output), one row for each row of docs.

    n counts lines. form is plain (output is the text; the counts are null), psm or spm. One narrow pass over batches of
    bounded bytes; a text longer than that is a batch of its own. A null text is empty, an empty one is plain; a text that
    holds a sentinel is plain, as its output could not be read back; a null doc_id is hashed as no digits; repeated rows
    give repeated results; an empty table gives an empty one; further columns are not carried.
    """
    return _mapped(docs, how, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", _text_row)


def restore_middle(made: DataFrame, how: Middles = Middles()) -> DataFrame:
    """(doc_id, text): the texts that fill_in_middle made its rows from. A null output is empty; a form other than psm,
    spm and plain raises ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 16_000_000):
            texts = []
            for text, form in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if form not in ("plain", "psm", "spm"):
                    raise ValueError(f"no form {form!r}")
                texts.append(text_of(invert(rope(text or ""), form, how)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return made.select(made["doc_id"].cast("long").alias("doc_id"), made["output"].cast("string").alias("output"), made["form"].cast("string").alias("form")).mapInArrow(run, "doc_id long, text string")


def fim_digests(docs: DataFrame, how: Middles = Middles()) -> DataFrame:
    """As fill_in_middle, but output, and the text restored from it, leave the task as digests: output_sha256,
    restored_sha256."""
    return _mapped(docs, how, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", _digest_row)

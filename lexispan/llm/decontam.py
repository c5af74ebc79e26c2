"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of ten item words (an item of fewer words: all of them), normalised and
spelt with a space on each side of each word. A document is normalised the same way and scanned once; a
match's place among the spaces gives its words, and the words' places in the bytes, which normalising
leaves where they are, give offsets in the original.
"""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_rows, numbered, written

#: Bytes that are part of a word stay, A to Z in lower case; any other becomes a space. Bytes of letters beyond ASCII stay.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
WORD = re.compile(rb"[^ ]+")


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def windows(items: list[tuple[str, str]], size: int) -> dict[str, tuple[int, list[str]]]:
    """For each window's spelling its number of words and the items that have it."""
    out: dict[str, tuple[int, list[str]]] = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            some = w[i : i + size]
            n, names = out.setdefault((b" " + b" ".join(some) + b" ").decode("latin-1"), (len(some), []))
            if name not in names[-1:]:
                names.append(name)
    return out


def automaton(found: dict[str, tuple[int, list[str]]]) -> ahocorasick.Automaton | None:
    """The automaton; a window's value is its number of words and its items. None: no window."""
    a = ahocorasick.Automaton()
    for spelt, value in found.items():
        a.add_word(spelt, value)
    if found:
        a.make_automaton()
    return a if found else None


def scan(text: str, a: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """The number of words, the hit words as ranges [first, end) of words, joined where they meet, and the items found."""
    w = words(text)
    if a is None or not w:
        return len(w), [], set()
    joined = b" " + b" ".join(w) + b" "
    hits, items = [], set()
    for end, (n, names) in a.iter(joined.decode("latin-1")):
        hits.append((end, n))
        items.update(names)
    if not hits:
        return len(w), [], set()
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in hits])
    out: list[tuple[int, int]] = []
    for first, last in sorted((int(e) - n, int(e)) for e, (_, n) in zip(ends, hits, strict=True)):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return len(w), out, items


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of characters in the original text."""
    if not spans:
        return []
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data.translate(FOLD))]
    chars = lambda byte: len(data[:byte].decode())
    return [(chars(at[a][0]), chars(at[b - 1][1])) for a, b in spans]


FOUND = "n_words int, hits array<struct<first:int,end:int,start:int,stop:int>>, items array<string>"


def scanned(docs: DataFrame, items: list[tuple[str, str]], size: int, text: str) -> DataFrame:
    """docs' rows in a struct named row, with n_words, hits and items, from one automaton over the items."""
    held = docs.sparkSession.sparkContext.broadcast(windows(items, size))  # of a bounded size
    cache: dict[str, object] = {}

    def fn(texts: list[str]) -> dict[str, list]:
        if "a" not in cache:
            cache["a"] = automaton(held.value)
        made = defaultdict(list)
        for t in texts:
            n, spans, names = scan(t, cache["a"])
            made["n_words"].append(n)
            made["items"].append(sorted(names))
            made["hits"].append([{"first": a, "end": b, "start": s, "stop": e} for (a, b), (s, e) in zip(spans, offsets(t, spans), strict=True)])
        return made

    return by_rows(docs, fn, FOUND, text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, limit_bytes: int = 256_000_000) -> DataFrame:
    """All of docs' rows and columns in a struct named row, with n_words, hits and items.

    hits: array of (first, end: words; start, stop: characters of the original), in order, apart from each
    other; items: the item ids that occur, sorted as strings. Null or empty texts have no words; null and
    wordless items have no windows; repeated items count once by id. One automaton holds all windows and the
    texts are scanned once. A benchmark whose windows exceed limit_bytes, which a worker's memory couldn't
    hold, is read in blocks, each an automaton and a scan that gives rows for the documents it hits alone.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") * size)).first()[0] or 0
    blocks = max(1, -(-total // limit_bytes))
    own = lambda k: [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]  # noqa: E731  of a bounded size
    if blocks == 1:
        return scanned(docs, own(0), size, "text")
    rows = numbered(docs)
    texts = rows.select("_n", F.col("row.text").alias("text"))
    found = None
    for k in range(blocks):
        part = scanned(texts, own(k), size, "text").where(F.size("items") > 0).select("row._n", "n_words", "hits", "items")
        part = written(part, "hits")
        found = part if found is None else found.union(part)
    found = found.groupBy("_n").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row a block and document
    counts = scanned(texts, [], size, "text").select("row._n", "n_words")
    out = rows.join(counts.join(found, "_n", "left"), "_n")
    return out.select("row", "n_words", merged(F.coalesce("hits", F.array())).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def merged(hits):
    """Ranges in any order as ranges in order that don't meet."""
    start = F.slice(F.array_sort(hits), 1, 0)
    last = lambda acc: F.element_at(acc, -1)
    widen = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["end"], x["end"]).alias("end"), last(acc)["start"].alias("start"), F.greatest(last(acc)["stop"], x["stop"]).alias("stop"))))
    return F.aggregate(F.array_sort(hits), start, lambda acc, x: F.when((F.size(acc) > 0) & (x["first"] <= last(acc)["end"]), widen(acc, x)).otherwise(F.concat(acc, F.array(x))))

"""Rows whose sets of word shingles have a Jaccard similarity of num / den or more: an exact join by prefixes.

All shingles have one order: by hash, and those that many documents of a sample hold come last. Two sets as
like as the threshold share a shingle among the first few of each (prefix filter), are of like size (length
filter), have enough left from the first one they share (positional filter) and differ in few bits of their
shingles' parities (bitmap filter; a shingle that only one of them has changes one bit, and large sets have
more bits). What passes is verified on the whole sets of 64-bit hashes. The sample changes costs alone: any
order is exact.

Rows are asked for components, so equal sets are one from the start, all that share a shingle first meet the
smallest of them, and then only those meet that are not of one component yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, parts, small_batches, strings, written

#: Bits of a small set's parities; a larger one has as many as shingles, rounded up to a power of two.
BITS = 1024
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def shingles(text: str, words: int) -> np.ndarray:
    """A hash of 64 bits for each word shingle, in their order; of a text of fewer words one, of no words none."""
    w = text.encode().translate(LOWER).split()  # bytes split at \x20 and \x09 to \x0D alone
    if not w:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(x) for x in zip(*(w[i:] for i in range(words)))] if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), "<u8", len(grams))


def parities(h: np.ndarray) -> np.ndarray:
    """The parities of the number of shingles that fall on each bit, 64 to a number. Halves folded on each other are those of half as many bits."""
    bits = max(BITS, 1 << (len(h) - 1).bit_length()) if len(h) else BITS
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.uint64)


def lists(of: list[np.ndarray]) -> pa.Array:
    """An Arrow column of lists of longs."""
    ends = np.cumsum([0, *map(len, of)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*of, np.zeros(0, np.uint64)]).view(np.int64))


def sets(rows: DataFrame, words: int) -> DataFrame:
    """id, s: each row's set of shingles. rows: id, text."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles")
        for b in parts(batches):
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "s": lists([np.unique(shingles(t, words)) for t in strings(b.column(1))])})

    return rows.select("id", "text").mapInArrow(run, "id long, s array<long>")


def common(rows: DataFrame, words: int, documents: int = 4000, least: int = 4, most: int = 200_000) -> np.ndarray:
    """The shingles that several documents of a bounded sample hold, the most frequent last."""
    share = max(1, rows.count() // documents)
    some = sets(rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0), words).select(F.explode("s").alias("t"))
    found = some.groupBy("t").count().where(F.col("count") >= least).orderBy(F.desc("count"), "t").limit(most).toArrow()
    return found["t"].to_numpy().view(np.uint64)[::-1].copy()


def filed(rows: DataFrame, words: int, late: np.ndarray, num: int, den: int) -> DataFrame:
    """id, fp (SimHash), d1 and d2 (the set's hash), len (its size), sig (its parities) and t (its prefix) of every row. rows: id, text."""
    from .simhash import majority

    small_batches(rows.sparkSession)
    by_hash = np.argsort(late)
    known = late[by_hash]

    def prefix(h: np.ndarray) -> np.ndarray:
        n = len(h) - -(-len(h) * num // den) + 1 if len(h) else 0
        if not len(known):
            return h[:n]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        is_late = known[at] == h
        early = h[~is_late]
        return early[:n] if len(early) >= n else np.concatenate([early, late[np.sort(by_hash[at[is_late]])]])[:n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles")
        for b in parts(batches):
            fp, d, n, sig, t = [], [], [], [], []
            for text in strings(b.column(1)):
                h = shingles(text, words)
                fp.append(majority(h))
                h = np.unique(h)
                d.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64))
                n.append(len(h))
                sig.append(parities(h))
                t.append(prefix(h))
            d = np.array(d, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "fp": np.array(fp, np.uint64).view(np.int64), "d1": d[:, 0], "d2": d[:, 1], "len": pa.array(n, pa.int32()), "sig": lists(sig), "t": lists(t)})

    return rows.select("id", "text").mapInArrow(run, "id long, fp long, d1 long, d2 long, len int, sig array<long>, t array<long>")


def possible(a: dict[str, Column], b: dict[str, Column], num: int, den: int) -> Column:
    """Length and positional filter for sets that share a shingle, number pos (from 0) in their orders, if it is the first they share."""
    small, large, both = (x.cast("long") for x in (F.least(a["len"], b["len"]), F.greatest(a["len"], b["len"]), a["len"] + b["len"]))
    rest = F.least(a["len"] - a["pos"], b["len"] - b["pos"]).cast("long")
    return (small * den >= large * num) & (rest * (num + den) >= both * num)


def shared(own: DataFrame) -> DataFrame:
    """t, id, len, pos, and y, ylen, ypos of the smallest id, for each shingle that prefixes of several rows hold. own: id, len, t."""
    flat = own.select("id", "len", F.posexplode("t").alias("pos", "t"))
    several = flat.groupBy("t").agg(F.min("id").alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "y")
    found = flat.join(written(several, "several", clean=True), "t")
    found = written(found, "found", clean=True)
    heads = found.where("id = y").select("t", F.col("len").alias("ylen"), F.col("pos").alias("ypos"))
    return found.join(heads, "t")


def alike(own: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v: ids) that the bitmap filter lets pass. own: id, len, sig."""
    sig = own.select("id", "len", "sig")
    both = pairs.join(sig.toDF("u", "un", "us"), "u").join(sig.toDF("v", "vn", "vs"), "v")
    n = F.least(F.size("us"), F.size("vs"))
    # the length filter leaves no set of more than twice the other's bits
    half = lambda s: F.when(F.size(s) > n, F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, n + 1, n), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(s))
    apart = F.aggregate(F.zip_with(half("us"), half("vs"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return both.where(apart * (num + den) <= (F.col("un") + F.col("vn")).cast("long") * (den - num)).select("u", "v")


def verified(rows: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v: ids) whose whole sets are as like as the threshold."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    own = written(sets(rows.join(ids, "id", "left_semi"), words), "sets", clean=True)
    both = pairs.join(own.toDF("u", "us"), "u").join(own.toDF("v", "vs"), "v")
    return both.where(F.size(F.array_intersect("us", "vs")).cast("long") * (num + den) >= (F.size("us") + F.size("vs")).cast("long") * num).select("u", "v")


def like(rows: DataFrame, own: DataFrame, links: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """node, root: the components of links (u, v) and of all pairs of rows as like as the threshold. rows: id, text; own: filed(rows)."""
    from .graph import stars

    first = own.where("len > 0").groupBy("d1", "d2").agg(F.min("id").alias("first"))
    sames = own.where("len > 0").drop("sig").join(first, ["d1", "d2"])
    hits = shared(sames.where("id = first").select("id", "len", "t"))
    of = lambda s="": {c: F.col(f"{s}{c}") for c in ("len", "pos")}
    pairs = written(hits.where("id <> y").where(possible(of(), of("y"), num, den)).select(F.col("id").alias("u"), F.col("y").alias("v")).distinct(), "pairs", clean=True)
    near = verified(rows, written(alike(own, pairs, num, den), "alike", clean=True), words, num, den)
    equal = sames.where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    tops = written(stars(written(links.select("u", "v").union(equal).union(near), "links", clean=True)), "tops")

    # of two components under a shingle at most one is that of the smallest row, so one side can leave it out
    top = lambda of, as_: tops.select(F.col("node").alias(of), F.col("root").alias(as_))
    placed = hits.join(top("id", "c"), "id", "left").join(top("y", "yc"), "y", "left")
    placed = placed.select("t", "id", "len", "pos", F.coalesce("c", "id").alias("c"), F.coalesce("yc", "y").alias("yc"))
    side = lambda df, s: df.select("t", *[F.col(c).alias(f"{s}{c}") for c in ("id", "len", "pos", "c")])
    met = side(placed.where("c <> yc"), "a").join(side(placed, "b"), "t").where("ac <> bc").where(possible(of("a"), of("b"), num, den))
    others = met.select(F.greatest("aid", "bid").alias("u"), F.least("aid", "bid").alias("v")).distinct()
    others = written(others.join(pairs, ["u", "v"], "left_anti"), "pairs", clean=True)
    near = verified(rows, written(alike(own, others, num, den), "alike", clean=True), words, num, den)
    near = near.join(top("u", "uc"), "u", "left").join(top("v", "vc"), "v", "left").select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v"))
    more = written(stars(written(near, "links", clean=True)), "tops")
    # a root of more is no node of tops; a root of tops may be a node of more
    again = tops.join(more.toDF("root", "_root"), "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return again.union(more.toDF("node", "root"))

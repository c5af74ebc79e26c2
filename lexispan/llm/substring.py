"""Removal of repeated passages with an FM-index per shard.

Equal windows of words have equal anchors: of a window's short word runs that of least hash. Neighbouring
windows of one anchor make a stretch. Stretches whose anchor no other stretch has can't repeat, and of
stretches that are equal as a whole only the first needs a look; those are found by a hash of their words'
spelling (128 bits of XXH3). What is left goes to shards by anchor: each shard builds an FM-index of its stretches
and streams them through backward search, which gives the windows that occur more than once and where
first. An anchor of very many different stretches goes to shards window by window instead, each different
window once. Equal windows always share a shard, so shards don't grow with the corpus but in number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, parts, small_batches, strings, written
from .cws import mix
from .fmindex import Index

#: Odd multiplier of the polynomial hash of runs of words.
RUN = np.uint64(0xC2B2AE3D27D4EB4F)
PLACE_BITS = 24


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))


class Rolling:
    """Hashes of runs values[i:j] by a polynomial modulo 2**64. Different runs may share one; anchors may."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(values)))])
            self.back = powers(np.uint64(pow(int(base), -1, 2**64)), len(values) + 1)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[j] - self.sums[i]) * self.back[i] + (j - i).astype(np.uint64))


class Words:
    """All texts' words: spelt with a space before each, where each starts in that, their hashes, and which text each is of."""

    def __init__(self, texts: list[bytes], seen: dict[bytes, int], most: int = 400_000):
        """seen: words' hashes remembered from one batch to the next."""
        own = [t.split() for t in texts]
        flat = list(chain.from_iterable(own))
        spelt = b" " + b" ".join(flat)
        self.spelt = memoryview(spelt)
        spaces = np.flatnonzero(np.frombuffer(spelt, np.uint8) == 32)  # no word holds one
        self.starts = np.append(spaces, len(spelt)) if flat else spaces
        if len(seen) > most:
            seen.clear()
        for w in set(flat).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        self.hashes = np.fromiter(map(seen.__getitem__, flat), np.uint64, len(flat))
        self.of = np.repeat(np.arange(len(texts)), list(map(len, own)))

    def contents(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128 bits of hash of the spelling of each run of words [first, end), as two numbers."""
        digest, spelt = xxhash.xxh3_128_digest, self.spelt
        some = [digest(spelt[a:b]) for a, b in zip(self.starts[first].tolist(), self.starts[end].tolist(), strict=True)]
        return np.frombuffer(b"".join(some), np.int64).reshape(-1, 2)


def least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if width > have else v


def stretches(words: np.ndarray, of: np.ndarray, window: int, run: int) -> tuple[np.ndarray, ...]:
    """anchor, text, place of the first word among words, number of windows of each stretch. words: hashes. Blocks keep places within PLACE_BITS; windows at a block's edge belong to one block."""
    block = (1 << PLACE_BITS) - window
    if len(words) > 1 << PLACE_BITS:
        some = [stretches(words[i : i + block + window - 1], of[i : i + block + window - 1], window, run) for i in range(0, len(words), block)]
        for k, s in enumerate(some):
            s[2][:] += k * block
        return tuple(np.concatenate(x) for x in zip(*some, strict=True))
    empty = np.zeros(0, np.int64)
    nothing = (empty.astype(np.uint64), empty, empty.copy(), empty)
    if len(words) < window:
        return nothing
    i = np.arange(len(words) - run + 1)
    anchor = Rolling(words, RUN).of(i, i + run)
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = least((mix(anchor) & ~low) | i.astype(np.uint64), window - run + 1)
    valid = np.flatnonzero(of[: len(best)] == of[window - 1 :])
    if not len(valid):
        return nothing
    place = (best[valid] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(valid) != 1)]))
    number = np.diff(np.concatenate([new, [len(valid)]]))
    return anchor[place[new]], of[valid[new]], valid[new], number


def look(window: int):
    """The shard's function: of rows _n, start, n, words its runs of windows that also start earlier."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_n", "ascending"), ("start", "ascending")])
        passages = [x.split(b" ") for x in t["words"].cast(pa.binary()).to_pylist()]
        number: dict[bytes, int] = {}
        flat = np.zeros(sum(map(len, passages)) + len(passages) + 1, np.int64)
        at = 1  # a 0 first, so that the first row's word before is 0 too
        starts = []
        for p in passages:
            flat[at : at + len(p)] = [number.setdefault(w, len(number) + 1) for w in p]
            starts.append(at)
            at += len(p) + 1
        count = t["n"].to_numpy()
        begin = np.repeat(np.array(starts), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        index = Index(flat, len(number) + 1, window)
        length, low, high = index.search(flat, begin + window - 1)
        found = np.flatnonzero(length == window)
        if len(found):
            found = found[index.earliest(low[found], high[found]) < begin[found]]
        of = np.repeat(np.arange(len(count)), count)[found]
        window_start = t["start"].to_numpy()[of] + begin[found] - np.array(starts)[of]
        ids = t["_n"].to_numpy()[of]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(window_start) != 1)])) if len(of) else np.zeros(0, np.int64)
        return pa.table({"_n": ids[new], "start": window_start[new].astype(np.int32), "n": np.diff(np.concatenate([new, [len(of)]])).astype(np.int32)})

    return run


def repeats(rows: DataFrame, window: int, run: int, shard_words: int, hot: int, dealt: DataFrame) -> DataFrame:
    """_n, start, n: runs of windows (by their first word) that also start earlier. dealt: rows by _n, for the words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in parts(batches, chars=1_500_000):
            w = Words([t.encode() for t in strings(b.column(1))], seen)
            anchor, of, at, n = stretches(w.hashes, w.of, window, run)
            content = w.contents(at, at + n + window - 1)
            start = at - np.searchsorted(w.of, of)
            order = np.lexsort((content[:, 1], content[:, 0], of))  # stable: equal ones stay in the order of their starts
            same = (of[order][1:] == of[order][:-1]) & (content[order][1:] == content[order][:-1]).all(axis=1)
            first = np.ones(len(of), bool)
            first[order[1:]] = ~same
            yield pa.RecordBatch.from_pydict({"h": anchor.view(np.int64), "c": content[:, 0], "d": content[:, 1], "_n": b.column(0).take(pa.array(of)), "start": start.astype(np.int32), "n": n.astype(np.int32), "first": first})

    made = rows.select("_n", "text").mapInArrow(cut, "h long, c long, d long, _n long, start int, n int, first boolean")
    # written first, so that texts are cut once, and that Spark can split a hot anchor in the joins: their sides are plain exchanges
    made = written(made, "cut", dictionary=False)
    often = written(made.groupBy("h").count().where("count > 1").select("h"), "often", clean=True)
    some = written(made.join(often, "h"), "stretches", clean=True)
    firsts = some.groupBy("h", "c", "d").agg(F.min("_n").alias("earliest"))
    different = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    firsts = written(firsts.join(different, "h"), "firsts", clean=True)
    known = written(some.join(firsts, ["h", "c", "d"]).select("h", "_n", "start", "n", (F.col("first") & (F.col("_n") == F.col("earliest"))).alias("is_first"), "k"), "compared", clean=True)
    again = known.where("not is_first").select("_n", "start", "n")
    asked = known.where("is_first and k > 1")
    shards = max(1, -(-(asked.agg(F.sum(F.col("n") + window)).first()[0] or 0) // shard_words))
    lists = asked.groupBy("_n").agg(F.collect_list(F.struct("start", "n", "h", (F.col("k") > hot).alias("hot"))).alias("asked"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_n", "start", "n", "key", "hot", "words"]
        for b in parts(batches, rows=128):
            out: dict[str, list] = {x: [] for x in names}
            for doc, text, asks in zip(b.column(0).to_pylist(), strings(b.column(2)), b.column(3).to_pylist(), strict=True):
                words = text.encode().split()
                for a in asks:
                    for s, n, key in [(s, 1, None) for s in range(a["start"], a["start"] + a["n"])] if a["hot"] else [(a["start"], a["n"], a["h"])]:
                        spelt = b" ".join(words[s : s + n + window - 1])
                        for x, v in zip(names, (doc, s, n, key, a["hot"], spelt), strict=True):
                            out[x].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(out[x], k) for x, k in zip(names, kinds, strict=True)], names)

    spelt = dealt.join(lists, "_n").select("_n", "doc_id", "text", "asked").mapInArrow(spell, "_n long, start int, n int, key long, hot boolean, words string")
    usual = spelt.where("not hot")
    found = usual.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "_n", "start", "n", "words").groupBy("shard").applyInArrow(_without_shard(look(window)), "_n long, start int, n int")
    if asked.where(F.col("k") > hot).limit(1).count():
        single = spelt.where("hot").select("_n", "start", "words")
        places = single.groupBy("words").agg(F.min(F.struct("_n", "start")).alias("f"))
        found = found.union(single.join(places, "words").where("f < struct(_n, start)").select("_n", "start", F.lit(1).alias("n")))
    return again.union(found)


def _without_shard(fn):
    return lambda t: fn(t.drop_columns(["shard"]))


def remove_repeats(docs: DataFrame, window: int = 20, run: int = 6, shard_words: int = 600_000, hot: int = 50_000) -> DataFrame:
    """doc_id, text, n_words, n_removed, spans for every row of docs (doc_id, text), without repeated passages.

    A word goes if a window of `window` words that covers it also starts earlier: in a row of smaller doc_id,
    or earlier in the same row. Windows are judged on the input. text: the words that stay, joined by one
    space; spans: the ranges [first, end) of words that go. Null texts have no words. Rows of one doc_id
    follow each other in the order of their texts, so a repeated row loses what its twin keeps; null ids
    come first. An empty table gives no rows.
    """
    rows = numbered(docs.select("doc_id", "text")).select("_n", "row.doc_id", "row.text")
    dealt = rows.repartition("_n")  # the texts move once: both joins read this exchange
    found = repeats(rows, window, run, shard_words, hot, dealt)
    lists = found.groupBy("_n").agg(F.collect_list(F.struct("start", "n")).alias("found"))

    small_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for b in parts(batches, rows=256):
            texts, totals, gone, spans = [], [], [], []
            for text, runs in zip(strings(b.column(2)), b.column(3).to_pylist(), strict=True):
                words = text.encode().split()
                step = np.zeros(len(words) + 1, np.int64)
                for r in runs or ():
                    step[r["start"]] += 1
                    step[r["start"] + r["n"] + window - 1] -= 1
                out = np.cumsum(step[:-1]) > 0
                texts.append(b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o] if runs else words).decode())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                spans.append([{"first": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                totals.append(len(words))
                gone.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span)], ["doc_id", "text", "n_words", "n_removed", "spans"])

    return dealt.join(lists, "_n", "left").select("_n", "doc_id", "text", "found").mapInArrow(keep, "doc_id long, text string, n_words long, n_removed long, spans array<struct<first:int,end:int>>")

"""Near duplicates by SimHash, with vantage-point trees over the fingerprints.

Distinct fingerprints are dealt to shards by a small tree: at each node by whether they lie within a
radius of a vantage point. A link of r bits can join two shards only if its ends lie within r of the
radius (triangle bound), so a fingerprint near it is sent to the later shard too. Each shard builds a
tree of its own, asks it for the neighbours of all its fingerprints, and returns stars of linked
fingerprints, not pairs; stars of different shards meet as connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, parts, small_batches, strings, written
from .graph import stars
from .shinglejoin import common, filed, like, shingles


def majority(h: np.ndarray) -> int:
    """64 bits: those set in over half of the hashes; of no hashes 0."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 255):
        total += np.unpackbits(h[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits: those set in over half of the hashes of the text's word shingles. No words: 0."""
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the bits as a long) of every row of docs."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            fp = np.array([fingerprint(t, words) for t in strings(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": fp})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def apart(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def vantage(points: np.ndarray, r: int, tries: int = 6) -> tuple[np.uint64, int, np.ndarray]:
    """A vantage point of points, a radius with about half of them, and all distances: of a few, the one with fewest points near the radius."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        d = apart(points, v)
        mu = int(np.partition(d, len(d) // 2)[len(d) // 2])
        if (d <= mu).all():
            mu = int(d.max()) - 1
        near = float(((d > mu - r) & (d <= mu + r)).mean())
        if mu >= 0 and (best is None or near < best[0]):
            best = (near, v, mu, d)
    return best[1:] if best else (points[0], 64, apart(points, points[0]))


class Tree:
    """The tree that deals fingerprints to shards; from a bounded sample."""

    def __init__(self, sample: np.ndarray, shards: int, r: int):
        self.r, self.nodes, self.leaves = r, [], 0

        def grow(points: np.ndarray, n: int) -> int:
            """A node's place, or for a shard -1 - its number."""
            if n > 1 and len(np.unique(points)) > 1:
                v, mu, d = vantage(points, r)
                if (d <= mu).any() and (d > mu).any():
                    at = len(self.nodes)
                    self.nodes.append(None)
                    inside = grow(points[d <= mu], n // 2)
                    self.nodes[at] = (v, mu, inside, grow(points[d > mu], n - n // 2))
                    return at
            self.leaves += 1
            return -self.leaves

        self.top = grow(sample, shards)

    def deal(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which fingerprint goes where: (index, shard) to its own shard and to the later ones that its ball of r bits touches."""
        index, shard, homes = [], [], np.zeros(len(fp), np.int64)
        stack = [(self.top, np.arange(len(fp)), np.ones(len(fp), bool))]
        found = []
        while stack:
            node, i, own = stack.pop()
            if not len(i):
                continue
            if node < 0:
                homes[i[own]] = -1 - node
                found.append((-1 - node, i))
                continue
            v, mu, inside, outside = self.nodes[node]
            d = apart(fp[i], v)
            for child, ok, mine in ((inside, d - self.r <= mu, own & (d <= mu)), (outside, d + self.r > mu, own & (d > mu))):
                stack.append((child, i[ok], mine[ok]))
        for s, i in found:
            i = i[homes[i] <= s]
            index.append(i)
            shard.append(np.full(len(i), s))
        return (np.concatenate(index), np.concatenate(shard)) if index else (np.zeros(0, np.int64),) * 2


def linked(points: np.ndarray, r: int, leaf: int = 64) -> np.ndarray:
    """For each of points (distinct) the smallest point it is linked with, directly or through others.

    A branch is left out where the triangle bound allows no neighbour, and where a branch and the asking
    points already are one component: its pairs could add nothing.
    """
    n = len(points)
    points = np.sort(points)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def settle() -> None:
        while True:
            up = parent[parent]
            if (up == parent).all():
                return
            parent[:] = up

    def join(a: np.ndarray, b: np.ndarray) -> None:
        pa_, pb = parent[a], parent[b]
        pairs = np.unique(np.stack([np.minimum(pa_, pb), np.maximum(pa_, pb)])[:, pa_ != pb], axis=1)
        if pairs.shape[1]:
            for x, y in pairs.T.tolist():
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
            settle()

    stack = [(np.arange(n), np.arange(n))]  # a branch's points and those that ask it
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        if parent[own[0]] == parent[own].max() == parent[own].min():
            ask = ask[parent[ask] != parent[own[0]]]
            if not len(ask):
                continue
        if len(own) <= leaf:
            for i in range(0, len(ask), 4096):
                some = ask[i : i + 4096]
                near = (np.bitwise_count(points[some][:, None] ^ points[own][None, :]) <= r) & (parent[some][:, None] != parent[own][None, :])
                a, b = np.nonzero(near)
                if len(a):
                    join(some[a], own[b])
            continue
        v, mu, d = vantage(points[own], r)
        at = own[int(np.flatnonzero(points[own] == v)[0])]
        e = apart(points[ask], v)
        join(ask[e <= r], np.full(int((e <= r).sum()), at))
        stack.append((own[d > mu], ask[e + r > mu]))
        stack.append((own[d <= mu], ask[e - r <= mu]))
    return points[parent]


def link(fps: DataFrame, r: int, shard_size: int, sample: int = 1 << 20) -> DataFrame:
    """node, root for all fingerprints but the roots in components of several, of distinct fps (fp long).

    Shards hold about shard_size fingerprints. The dealing tree comes from 64 of each, but of no more than `sample`
    in all: beyond 2 ** 17 shards (2 ** 31 fingerprints at the usual size) they are as many and grow, a megabyte
    for each 2 ** 34 fingerprints.
    """
    n = fps.count()
    shards = max(1, min(sample // 8, round(n / shard_size)))
    tree = None
    if shards > 1:
        share = max(1, int(n / min(64 * shards, sample)))
        some = fps.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).toArrow()["fp"].to_numpy()
        tree = Tree(np.sort(some).view(np.uint64), shards, r)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            index, shard = tree.deal(fp.view(np.uint64)) if tree else (np.arange(len(fp)), np.zeros(len(fp), np.int64))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "fp": fp[index]})

    def ask(t: pa.Table) -> pa.Table:
        points = np.unique(t["fp"].to_numpy().view(np.uint64))
        top = linked(points, r)
        some = top != points
        return pa.table({"u": points[some].view(np.int64), "v": top[some].view(np.int64)})

    found = fps.select("fp").mapInArrow(deal, "shard int, fp long").groupBy("shard").applyInArrow(ask, "u long, v long")
    return found.toDF("node", "root") if tree is None else stars(found)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, shard_size: int = 16384) -> DataFrame:
    """doc_id, fp and component_id of every row of docs (doc_id, text); null texts count as empty.

    Rows link whose fingerprints differ in at most so many bits; component_id is the smallest doc_id
    reachable. Wordless texts have fingerprint 0 and link like others. Repeated rows get the same answer
    each; a null doc_id is no component's smallest unless all are null. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    tops = link(classes, bits, shard_size)
    labelled = classes.join(tops, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(labelled.join(firsts, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, bits: int = 3, num: int = 4, den: int = 5, shard_size: int = 16384) -> DataFrame:
    """docs without the rows that have a near duplicate before them in their component; all columns stay.

    Rows link whose sets of word shingles have a Jaccard similarity of num / den or more, and those whose
    fingerprints differ in at most so many bits. Rows follow each other by doc_id, null first; rows of one
    doc_id are rows of their own, in an order of their texts' hashes. Null texts count as empty; texts without
    words are alike. An empty table gives no rows.
    """
    all_ = numbered(docs)
    rows = all_.select(F.col("_n").alias("id"), F.col("row.text").alias("text"))
    own = written(filed(rows, words, common(rows, words), num, den), "filed")
    classes = written(own.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    tops = link(classes, bits, shard_size)
    same = own.join(classes, "fp").where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    firsts = classes.select("fp", "first")
    near = tops.join(firsts.toDF("node", "u"), "node").join(firsts.toDF("root", "v"), "root").select("u", "v")
    found = written(like(rows, own, same.union(near), words, num, den).select(F.col("node").alias("_n")).distinct(), "gone")
    return all_.join(found, "_n", "left_anti").select("row.*")

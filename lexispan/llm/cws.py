"""Document fingerprints by consistent weighted sampling.

A document is a bag of words weighted by how often each occurs. For each of `samples` draws a word has two
gamma(2, 1) values and a uniform one, all from hashes of the word and the draw; with the word's weight they
give a score, and the word with the least score (with its quantised weight) is the draw's sample. Two
documents agree in a draw with a chance of sum(min) / sum(max) of their weights: generalised Jaccard.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, parts, ranges

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def gamma_table(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of gamma(2, 1) at (i + 0.5) / n: solves 1 - (1 + x) exp(-x) = p by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return x


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public domain splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Fingerprints of `samples` codes of 16 bits each; a text without words has none and gets zeros."""

    def __init__(self, samples: int = 64):
        self.samples = samples
        gamma = gamma_table()
        self.r, self.log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        with np.errstate(over="ignore"):
            self.seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def drawn(self, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each weighted word and draw: its score in the high half, in an order of unsigned numbers, and its code in the low half."""
        with np.errstate(over="ignore"):
            u = mix(words[:, None] ^ self.seeds[None, :])
            r = self.r[(u & np.uint64(0xFFFF)).astype(np.intp)]
            beta = ((u >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(np.log(weights).astype(np.float32)[:, None] / r + beta)
            score = self.log_c[((u >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)] - r * (t - beta + 1)
            bits = score.view(np.uint32)
            bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
            code = mix(words[:, None] + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            return (bits << np.uint64(32)) | (code >> np.uint64(32))

    def fingerprints(self, texts: list[str], slab: int = 16384, most: int = 1 << 18) -> np.ndarray:
        """One row of codes a text."""
        known: dict[tuple[bytes, int], int] = {}
        of, sizes = [], []
        for t in texts:
            bag = Counter(t.encode().translate(LOWER).split())
            of.extend(known.setdefault(x, len(known)) for x in bag.items())
            sizes.append(len(bag))
        out = np.zeros((len(texts), self.samples), np.uint16)
        if not known:
            return out
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w, _ in known), np.uint64, len(known))
        weights = np.fromiter((n for _, n in known), np.float64, len(known))
        of_, ends = np.array(of, np.intp), np.cumsum(sizes)
        if len(known) > most:  # too many words to hold their draws: half of the texts at a time, and of one text some words at a time
            if len(texts) > 1:
                half = len(texts) // 2
                return np.concatenate([self.fingerprints(some, slab, most) for some in (texts[:half], texts[half:])])
            least = [self.drawn(words[j : j + 512], weights[j : j + 512]).min(axis=0) for j in range(0, len(words), 512)]
            out[0] = np.minimum.reduce(least).astype(np.uint16)
            return out
        table = np.concatenate([self.drawn(words[i : i + 512], weights[i : i + 512]) for i in range(0, len(words), 512)])
        first = 0
        while first < len(texts):
            start = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, start + slab, "right")))
            some = [i for i in range(first, last) if sizes[i]]
            if some:
                at = np.array([ends[i] - sizes[i] - start for i in some])
                out[some] = np.minimum.reduceat(table[of_[start : ends[last - 1]]], at, axis=0).astype(np.uint16)
            first = last
        return out


def spelt(codes: np.ndarray) -> list[str]:
    """Each row in hexadecimal digits, four a code."""
    data = codes.astype(">u2").tobytes().hex()
    n = codes.shape[1] * 4
    return [data[i : i + n] for i in range(0, len(data), n)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of draws in which two fingerprints agree, 0 to 1."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """text, its last quarter of code points replaced by the first as many, or all, of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """_shard, _own, doc_id, text in partitions of whole shards, in the order of ids (nulls first), each shard ending with a copy of the row that comes next (_own false).

    Only one row a shard is copied; a shard's first number is all that the driver learns of it.
    """
    rows = numbered(docs.select("doc_id", "text")).select("_n", "row.doc_id", "row.text")
    cut, cuts = ranges(rows, "_n", rows=2000)
    firsts = [(r["_shard"], r["k"]) for r in cut.groupBy("_shard").agg(F.min("_n").alias("k")).orderBy("_shard").collect()]
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    looked = docs.sparkSession.createDataFrame(before, "_n long, _before int")  # a row a shard
    place = lambda shard, own: F.struct(F.col(shard).alias("s"), F.lit(own).alias("o"))
    own, copied = place("_shard", True), place("_before", False)
    dealt = cut.join(F.broadcast(looked), "_n", "left").select("_n", "doc_id", "text", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copied))).alias("p"))
    dealt = dealt.select(F.col("p.s").alias("_shard"), F.col("p.o").alias("_own"), "doc_id", "text", "_n")
    return dealt.repartition(max(1, (len(cuts) + 1) // 4), "_shard").sortWithinPartitions("_shard", F.desc("_own"), "_n").drop("_n")


def document_fingerprints(docs: DataFrame, samples: int = 64) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id, text).

    The next document is that of the next doc_id; after the last comes the first; rows of equal id follow
    each other in an order of their texts' hashes, null ids come first. Null texts count as empty. Texts without
    words have fingerprints of zeros, which agree with each other and with no other. One row alone is its
    own next. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        held = None  # the shard's last row, which waits for the next: (doc_id, text, codes)

        for b in parts(batches, of="text"):
            shards, owns, ids, texts = (b.column(i).to_pylist() for i in range(4))
            texts = [x or "" for x in texts]
            done = []
            for i, (s, own) in enumerate(zip(shards, owns, strict=True)):
                if held is not None and held[0] == s:
                    done.append((held[1], held[2], held[3], i))
                    held = None
                if own:
                    held = (s, ids[i], texts[i], i)
            changed = [edited(t, texts[i]) for _, t, _, i in done]
            codes = sampler.fingerprints(texts + changed)  # at once, as they share their words
            if held is not None and isinstance(held[3], int):  # its codes, as the batch goes
                held = (*held[:3], codes[held[3]])
            if done:
                mine = np.stack([codes[c] if isinstance(c, int) else c for _, _, c, _ in done])
                theirs = codes[len(texts) :]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([x[0] for x in done], pa.int64()),
                        "n_chars": pa.array([len(x[1]) for x in done], pa.int64()),
                        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                        "fingerprint": spelt(mine),
                        "edited_fingerprint": spelt(theirs),
                        "near_edited": likeness(mine, theirs),
                        "near_next": likeness(mine, codes[[x[3] for x in done]]),
                    }
                )

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

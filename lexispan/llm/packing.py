"""Packing of token pieces into sequences by vector best fit.

A bin has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). A
piece goes, longest first, to the open bin that holds it in every capacity and that leaves the least
weighted norm of what would still be free (or has the largest weighted dot product of its room with the
piece); if no bin holds it, a new one opens. Shards of documents are packed side by side, so a shard's
last bins alone can stay part empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import parts, small_batches, strings, written


def best_fit(lengths: np.ndarray, tokens: int = 2048, documents: int = 2048, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.1), choose: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Each piece's bin and offset in it. A piece of more than any capacity is an error.

    attention None: tokens squared, which never binds before tokens do. Ties go to the bin opened first.
    """
    attention = tokens * tokens if attention is None else attention
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if len(lengths) and (lengths.max() > tokens or lengths.max() ** 2 > attention or documents < 1):
        raise ValueError("a piece exceeds a bin's capacity")
    full = np.array([tokens, documents, attention], np.float64)
    scale = np.asarray(weights) / full**2
    least = lengths.min() if len(lengths) else 0
    room, names = np.zeros((1024, 3)), np.zeros(1024, np.int64)
    open_n = made = 0
    for i in order:
        need = np.array([lengths[i], 1, lengths[i] * lengths[i]], np.float64)
        best = -1
        if open_n and need[0] < tokens:
            free = room[:open_n]
            ok = np.flatnonzero((free[:, 0] >= need[0]) & (free[:, 1] >= 1) & (free[:, 2] >= need[2]))
            if len(ok):
                left = free[ok]
                score = ((left - need) ** 2) @ scale if choose == "norm" else -(left @ (scale * need))
                best = int(ok[np.argmin(score)])
        if best < 0:
            if open_n == len(room):
                room, names = np.concatenate([room, np.zeros_like(room)]), np.concatenate([names, np.zeros_like(names)])
            best, room[open_n], names[open_n] = open_n, full, made
            open_n, made = open_n + 1, made + 1
        bins[i], offsets[i] = names[best], tokens - room[best, 0]
        room[best] -= need
        if room[best, 0] < least or room[best, 1] < 1:  # nothing goes in any more: later bins move up and keep their order
            room[best : open_n - 1], names[best : open_n - 1] = room[best + 1 : open_n].copy(), names[best + 1 : open_n].copy()
            open_n -= 1
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end: int, tokens: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the end id, cut only where they exceed tokens."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaces_dropped=True, end=end)
        for b in parts(batches, rows=256):
            ids, bounds = enc.ids(strings(b.column(1)))
            ids = ids.astype("<u4")
            counts = -(-np.diff(bounds) // tokens)
            of = np.repeat(np.arange(len(counts)), counts)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * tokens
            length = np.minimum(tokens, np.diff(bounds)[of] - start)
            at = bounds[of] + start
            crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(of)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 0, tokens: int = 2048, documents: int = 2048, attention: int | None = None, shard_pieces: int = 16384) -> DataFrame:
    """Packs all documents (doc_id, text; null: empty) into sequences of at most so many tokens, documents and attention cost.

    One row a piece: doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32,
    sequence_id, offset (gapless from 0). Repeated rows and null ids are documents of their own, and their
    places in the written pieces deal them out too; an empty table gives no rows; other columns are not read. Shards follow the number of pieces, about shard_pieces each.
    """
    cut = written(pieces(docs, tokenizer, end, tokens), "pieces")
    shards = max(1, round(cut.count() / shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(t["length"].to_numpy(), tokens, documents, attention)
        ids = (np.int64(t["shard"][0].as_py()) << 40) + bins
        return t.drop_columns(["shard"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

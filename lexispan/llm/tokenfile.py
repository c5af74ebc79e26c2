"""Token ids in files of directly addressable codes.

A segment holds consecutive documents. Each id is cut into chunks of eight bits, low ones first. Level
j holds the j-th chunk of every id that has one, in order, and a bitmap that says whether the id goes on
in level j + 1. The bitmap's rank directory (ones before each 512 bits) gives an id's place on the next
level, so any token is read from one byte a level, without decoding a block.

Layout, little-endian: magic "DAC1", n_docs, n_tokens, levels (u8 each but the magic), doc ids (i64),
null flags (u1), document starts (u8, one more than documents), then for each level its size (u8), the
chunks (u1), the bitmap in bytes padded to 64 bytes, and the directory (u4, one for each 64 bytes and one more).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import numbered, parts, ranges, scratch, strings

#: Parquet keeps payloads uncompressed and apart, so one is read without those beside it.
AS_IS = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1"}
MAGIC, DIRECTORY_BITS = b"DAC1", 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """A segment's bytes. starts: of each document, and the end."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(_ONES[bits].reshape(-1, 64).sum(axis=1, dtype=np.uint32))]).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = MAGIC + struct.pack("<QQQ", len(doc_ids), len(ids), len(levels))
    named = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return b"".join([head, named, np.asarray(starts, "<u8").tobytes(), *levels])


class Segment:
    """A packed segment, read in place."""

    def __init__(self, data: bytes | pa.Buffer):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", data, 4)
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls, strict=True)]
        self.starts = take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            chunks = take("u1", n)
            bits = take("u1", -(-(-(-n // 8)) // 64) * 64)
            self.levels.append((chunks, bits, take("<u4", len(bits) // 64 + 1)))

    def token(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for j, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * j)
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            block = byte // 64
            i = int(ranks[block]) + int(_ONES[bits[block * 64 : byte]].sum()) + int(_ONES[bits[byte] & ((1 << bit) - 1)])
        return out

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from start to before end."""
        out = np.zeros(end - start, np.uint32)
        where = np.arange(end - start)
        for j, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * j)
            on = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start].astype(bool)
            block = start // DIRECTORY_BITS
            before = np.unpackbits(bits[block * 64 : -(-start // 8)], bitorder="little")[: start - block * DIRECTORY_BITS]
            start = int(ranks[block]) + int(before.sum())
            where = where[on]
            end = start + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end: int = 0, segment_tokens: int = 1 << 20) -> None:
    """Writes all documents' ids (doc_id, text; null: empty), each with the end id, in ascending doc_id order (nulls first).

    One row a segment: shard and segment (both in the order of documents), n_docs, before (ids of the shard's
    earlier segments), n_tokens, payload. Rows of equal doc_id stand in an order of their texts' hashes. Any store
    that Spark writes to will do. Payloads are stored as they are, each a page of its own.
    """
    rows = numbered(docs.select("doc_id", "text")).select("row.doc_id", "row.text", "_n")
    cut, cuts = ranges(rows, "_n", rows=2000)
    dealt = cut.repartition(max(1, (len(cuts) + 1) // 4), "_shard").sortWithinPartitions("_shard", "_n").select("doc_id", "text", "_shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaces_dropped=False, end=end)
        shard, number, held, names, size, before = None, 0, [], [], 0, 0

        def out() -> pa.RecordBatch:
            lengths = [len(x) for x in held]
            data = pack(np.concatenate(held), np.concatenate([[0], np.cumsum(lengths)]), names)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()), "n_docs": [len(names)], "before": [before], "n_tokens": [size], "payload": pa.array([data], pa.binary())})

        for b in parts(batches):
            ids, starts = enc.ids(strings(b.column(1)))
            for k, (doc, s) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if held and (s != shard or size >= segment_tokens):
                    yield out()
                    number, before = (number + 1, before + size) if s == shard else (0, 0)
                    held, names, size = [], [], 0
                shard = s
                held.append(ids[starts[k] : starts[k + 1]])
                names.append(doc)
                size += len(held[-1])
        if held:
            yield out()

    dealt.mapInArrow(run, "shard int, segment int, n_docs long, before long, n_tokens long, payload binary").write.options(**AS_IS).parquet(path)


def shard_starts(files: DataFrame) -> dict[int, int]:
    """The ids before each shard."""
    totals = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # at most one row a shard
    starts, total = {}, 0
    for s in sorted(totals):
        starts[s] = total
        total += totals[s]
    return starts


def tokens_at(spark, path: str, places: list[int]) -> DataFrame:
    """place, token: the ids at the given places among all ids of the files at path; a place that is none gives no row.

    The segments' sizes alone tell which hold them; of the others no payload is read, and of these each id's byte a
    level and its rank's block.
    """
    wanted = np.unique(np.array(places, np.int64))
    files = spark.read.parquet(path)
    starts = shard_starts(files)
    sizes = files.select("shard", "segment", "before", "n_tokens").collect()  # a row a segment
    asked = {}
    for r in sizes:
        first = starts[r["shard"]] + r["before"]
        own = wanted[np.searchsorted(wanted, first) : np.searchsorted(wanted, first + r["n_tokens"])]
        if len(own):
            asked[r["shard"], r["segment"]] = (first, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, segment, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (shard, segment) in asked:
                    first, own = asked[shard, segment]
                    s = Segment(data.as_buffer())
                    yield pa.RecordBatch.from_pydict({"place": own, "token": pa.array([s.token(int(i - first)) for i in own], pa.int64())})

    if not asked:
        return spark.createDataFrame([], "place long, token long")
    known = F.col("shard").isin(sorted({k for k, _ in asked})) & F.col("segment").isin(sorted({k for _, k in asked}))
    return files.where(known).select("shard", "segment", "payload").mapInArrow(run, "place long, token long")


def read_tokens(spark, path: str) -> DataFrame:
    """From the files at path, one row a document: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    starts = shard_starts(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, before, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                base = starts[shard] + before
                s = Segment(data.as_buffer())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(s.doc_ids, pa.int64()),
                        "start": s.starts[:-1] + base,
                        "n_tokens": np.diff(s.starts),
                        "ids_crc32": pa.array([zlib.crc32(s.document(k).astype("<u4").tobytes()) for k in range(len(s.doc_ids))], pa.int64()),
                    }
                )

    return files.select("shard", "before", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 0) -> DataFrame:
    """Writes the ids of docs in the shared folder and reads them back: see write_tokens and read_tokens.

    Null or empty texts have the end id alone; an empty table gives no rows; other columns are not read.
    """
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end)
    return read_tokens(docs.sparkSession, path)

"""Text functions on columns. All run in the JVM but simhash64, which needs a hash Spark doesn't have."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Arabic marks and tatweel, and letters that count as one.
DIACRITICS = r"\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06E4}\x{06E7}-\x{06E8}\x{06EA}-\x{06ED}\x{0640}"
FOLD_FROM, FOLD_TO = "أإآٱؤئىة", "ااااوييه"
ARTICLE, PREFIXES = "ال", "وفبكلس"

WORD = r"\p{L}\p{M}\p{Nd}"


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, f"[{DIACRITICS}]", "")


def fold_letters(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def normalize(c: Column) -> Column:
    """Letters, marks and digits; any run of white space becomes one space, anything else goes without a trace."""
    kept = F.regexp_replace(fold_letters(strip_diacritics(c)), rf"[^{WORD}\s\p{{Z}}]", "")
    return F.trim(F.regexp_replace(kept, r"[\s\p{Z}]+", " "))


def clean_token(c: Column) -> Column:
    """A token without what isn't a word character at its ends; one with no word character stays as it is."""
    cut = F.regexp_replace(c, rf"^[^{WORD}_]+|[^{WORD}_]+$", "")
    return F.when(cut == "", c).otherwise(cut)


def normalize_token(c: Column) -> Column:
    """Cleaned, normalised, without spaces; runs of three or more equal characters become one."""
    return F.trim(F.regexp_replace(F.replace(normalize(clean_token(F.trim(c))), F.lit(" "), F.lit("")), r"(.)\1{2,}", "$1"))


def tokenize(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda t: t != "")


def expand_terms(tokens: Column) -> Column:
    """Each token, then it without the article, without a one-letter prefix, and without both."""

    def one(t: Column) -> Column:
        bare = F.when(t.startswith(ARTICLE) & (F.length(t) > 2), F.substring(t, 3, 1 << 30))
        rest = F.when(F.substring(t, 1, 1).isin(list(PREFIXES)) & (F.length(t) > 1), F.substring(t, 2, 1 << 30))
        both = F.when(rest.startswith(ARTICLE) & (F.length(rest) > 2), F.substring(rest, 3, 1 << 30))
        return F.filter(F.array(t, bare, rest, both), lambda x: x.isNotNull())

    return F.flatten(F.transform(tokens, one))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """The character n-grams of the normalised text without its spaces, in order; none if it is shorter."""
    chars = F.split(F.replace(normalize(c), F.lit(" "), F.lit("")), "")  # a character is found by its place in an array, not from the text's start

    def grams(x: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat(*[F.get(x, i + k) for k in range(n)]))
        return F.when(F.size(x) >= n, made).otherwise(F.array().cast("array<string>"))

    return F.coalesce(F.get(F.transform(F.array(chars), grams), 0), F.array().cast("array<string>"))  # the outer array binds chars: they are made once


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def simhash_md5(rows: DataFrame, key: str, grams: Column, bits: int = 60) -> DataFrame:
    """key, simhash: bits by the vote of the grams' MD5 (its first 15 hex digits), ties set; 0 without grams. One sum a bit over the exploded grams."""
    h = F.conv(F.substring(F.md5("g"), 1, 15), 16, 10).cast("bigint")
    flat = rows.select(key, F.explode_outer(grams).alias("g")).select(key, h.alias("h"))
    votes = flat.groupBy(key).agg(F.count("h").alias("n"), *[F.sum(F.getbit("h", F.lit(b))).alias(f"b{b}") for b in range(bits)])
    total = F.lit(0).cast("bigint")
    for b in range(bits):
        total = total + F.when(F.col(f"b{b}") * 2 >= F.col("n"), F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint")
    return votes.select(key, F.when(F.col("n") == 0, F.lit(0).cast("bigint")).otherwise(total).alias("simhash"))


@F.pandas_udf(LongType())
def _simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(text: str | None) -> int:
        grams = [text[i : i + 3] for i in range(len(text) - 2)] if text else []
        if not grams:
            return 0
        found = np.frombuffer(b"".join([hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams]), np.uint8)
        votes = np.unpackbits(found.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(votes * 2 >= len(grams), bitorder="little").view("<i8")[0])

    for s in batches:
        yield s.map(one)


def simhash64(c: Column) -> Column:
    """64 bits by the vote of the text's character 3-grams' BLAKE2b, ties set; 0 below three characters."""
    return _simhash(F.replace(normalize(c), F.lit(" "), F.lit("")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm, milliseconds rounded half up."""
    ms = F.round(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def parse_timestamp(c: Column) -> Column:
    """Seconds of h:m:s.ms; the part after the point counts thousandths, however many digits it has."""
    p = F.split(c, r"[:.]")
    at = lambda i: F.get(p, F.lit(i)).cast("double")
    return at(0) * 3600 + at(1) * 60 + at(2) + at(3) / 1000


def strip_special(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<\|[^|]*\|>", ""), r"\s+", " "))


def fts_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def casefold(c: Column) -> Column:
    return F.lower(c)


def head_tail(c: Column, most: int = 600) -> Column:
    """All words if there are few, else the first and the last half of most."""
    w = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    half = most // 2
    return F.when(F.size(w) <= most, F.array_join(w, " ")).otherwise(F.array_join(F.concat(F.slice(w, 1, half), F.slice(w, -half, half)), " "))


def tail_text(c: Column, n: int = 400) -> Column:
    """The last n characters."""
    return F.right(c, F.lit(n))


def segment_text(text: Column, words: Column) -> Column:
    """The trimmed text, or the words if it is empty."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.array_join(words, " "))


def tolerant_number(c: Column) -> Column:
    return c.try_cast("double")


def tolerant_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "yes", "y", "on")


def host_allowed(host: Column, rules: Sequence[str]) -> Column:
    """Exact, or *.suffix (the suffix itself too); no rules allow all."""
    if not rules:
        return F.lit(True)
    out = F.lit(False)
    for r in rules:
        out = out | ((host == r[2:]) | host.endswith(r[1:]) if r.startswith("*.") else host == r)
    return out


def ip_number(c: Column) -> Column:
    p = F.split(c, r"\.")
    at = lambda i: F.get(p, F.lit(i)).cast("bigint")
    return at(0) * 16777216 + at(1) * 65536 + at(2) * 256 + at(3)


def in_networks(c: Column, networks: Sequence[str]) -> Column:
    """Whether any network a.b.c.d/n holds the address."""
    import ipaddress

    out, ip = F.lit(False), ip_number(c)
    for n in map(ipaddress.ip_network, networks):
        out = out | ip.between(int(n.network_address), int(n.broadcast_address))
    return out


def safe_basename(c: Column) -> Column:
    """The last part of a path; upload.bin for an empty one, . and .. ."""
    name = F.regexp_extract(c, r"([^/\\]*)$", 1)
    return F.when(name.isin("", ".", "..") | name.isNull(), F.lit("upload.bin")).otherwise(name)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def websocket_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^https://", "wss://"), "^http://", "ws://")


def composite_key(*c: Column) -> Column:
    return F.concat_ws(":", *c)

"""Removal of lines that are like an earlier line: an exact set-similarity join in DataFrame operations.

A line is the set of its words. Equal lines are one line from the start. Words sort by rarity, and two lines
as like as the threshold share a word among the rarest few of each (prefix filter), are of like size (length
filter), have enough words left from the shared one on (positional filter), and differ in few bits of their
words' parities (bitmap filter; a word that only one of them has changes one bit). What passes is verified
on the words themselves. A word that very many lines have among their rarest is crowded: its lines first
meet the earliest of them alone, which removes most members of a large group of near copies; the others then
meet all earlier lines, so none is missed.

Rarity is counted over all words of all texts, in BUCKETS buckets of words, and kept in levels of powers of
two below the most frequent; any order of words gives the same result. Words are joined by 59 bits of hash
beside their level; a chance of 2**-59 that two words of a line count as one is all that is not exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

SPACES = " \n\t\x0b\x0c\r"
#: Buckets of words that share a level of rarity, a quarter of a power of two each.
BUCKETS = 1 << 18
#: So many rows count them, each several: Spark sums up in a faster map as long as it has no more keys.
COUNTED = 1 << 16
#: Lines of more words have a second signature.
LONG = 64
#: So many pairs of lines (16 MB of ids at the most) are broadcast.
FEW = 1_000_000
#: What a number has of a word's hash, below its level.
HASH_BITS = 55


def has_words(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACES)) != ""


def spaced(text: Column) -> Column:
    """text with spaces for all other white space but line feeds: lines of the same words in the same places are equal then."""
    rare = SPACES[2:]
    plain, odd = text, F.contains(text, F.lit(rare[0]))
    for c in rare:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, plain).otherwise(text)


def words(text: Column) -> Column:
    """What single spaces separate; empty strings too, where a space follows a space. It is found faster than a pattern."""
    return F.split(text, " ")


def lines(rows: DataFrame, stride: int) -> DataFrame:
    """id, line: the lines with words, spaced. A line's id is its row's number times stride and its place in the row."""
    split = rows.select("_n", F.posexplode(F.split(spaced(F.col("row.text")), "\n")).alias("i", "line"))
    return split.where(F.ltrim("line") != "").select((F.col("_n") * stride + F.col("i")).alias("id"), "line")


def shifted(name: str, c: Column, by: Column) -> Column:
    return F.call_function(name, c, by.cast("int"))


def levels(rows: DataFrame) -> Column:
    """The buckets' levels of rarity, a constant array; counted over all words of rows."""
    text = F.replace(spaced(F.col("row.text")), F.lit("\n"), F.lit(" "))
    hashes = rows.select(F.explode(words(text)).alias("w")).select(F.xxhash64("w").alias("h"))  # empty strings too, which no line has as a word
    within = F.col("h").bitwiseAND(BUCKETS - 1)
    counts = hashes.select((within % COUNTED).alias("b"), F.shiftright(within, COUNTED.bit_length() - 1).alias("i"))
    counts = counts.groupBy("b").agg(*[F.count_if(F.col("i") == i).alias(f"c{i}") for i in range(BUCKETS // COUNTED)])
    spelt = ["0"] * BUCKETS
    for r in counts.select("b", *[F.floor(F.log2(c) * 4).alias(c) for c in counts.columns[1:]]).collect():  # at most COUNTED rows
        for i, level in enumerate(r[1:]):
            spelt[i * COUNTED + r["b"]] = str(level or 0)
    return F.split(F.lit(",".join(spelt)), ",").cast("array<smallint>")


def least_key(count: int) -> int:
    """No word that is there so many times has a smaller key; the level below is let in, however logarithms round."""
    return max(0, int(math.log2(count) * 4) - 1) << HASH_BITS


def keys(hashes: Column, ranks: Column) -> Column:
    """For each hash the number that words are ordered and joined by: its level, then its low bits. None is null, for Spark too: it sorts such arrays faster."""
    level = lambda h: F.coalesce(F.get(ranks, h.bitwiseAND(BUCKETS - 1)).cast("bigint"), F.lit(0).cast("bigint"))
    return F.transform(hashes, lambda h: F.shiftleft(level(h), HASH_BITS).bitwiseOR(h.bitwiseAND((1 << HASH_BITS) - 1)))


def signature(k: Column, n: Column) -> list[Column]:
    """sig: 64 bits, each the parity of the number of words that fall on it; sig2: the same of one half of the words, for long lines."""
    bits = [-(1 << 63) if i == 63 else 1 << i for i in range(64)]
    constant = lambda of: F.split(F.lit(",".join(map(str, of))), ",").cast("array<bigint>")
    parities = lambda bit: F.aggregate(k, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(F.get(bit, x.bitwiseAND(F.lit(127)))))
    return [parities(constant(bits + bits)).alias("sig"), F.when(n > LONG, parities(constant([0] * 64 + bits))).alias("sig2")]


def up(a: Column, num: int, den: int) -> Column:
    """a * num / den, rounded up, in whole numbers."""
    return F.floor((a.cast("bigint") * num + (den - 1)) / den).cast("int")


class Threshold:
    """Jaccard similarity of num / den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: Column) -> Column:
        """Of n words so many rarest hold one that a like line has too."""
        return n - up(n, self.num, self.den) + 1

    def short(self, n: Column) -> Column:
        """The same, for like lines of as many words or more."""
        return n - F.floor((n * 2 * self.num + (self.num + self.den - 1)) / (self.num + self.den)) + 1

    def possible(self, a: dict[str, Column], b: dict[str, Column]) -> Column:
        """Length, positional and bitmap filter for lines that share a word, number pos (from 0) in their orders, if it is the first they share."""
        small, large, both = F.least(a["len"], b["len"]), F.greatest(a["len"], b["len"]), a["len"] + b["len"]
        rest = F.least(a["len"] - a["pos"], b["len"] - b["pos"])
        return (small * self.den >= large * self.num) & (rest * (self.num + self.den) >= both * self.num) & self.close(a, b, both)

    def close(self, a: dict[str, Column], b: dict[str, Column], both: Column) -> Column:
        """At least both * num / (num + den) words are common, so at most both * (den - num) / (num + den) are not."""
        xor, half = a["sig"].bitwiseXOR(b["sig"]), a["sig2"].bitwiseXOR(b["sig2"])
        apart = F.when(half.isNull(), F.bit_count(xor)).otherwise(F.bit_count(half) + F.bit_count(xor.bitwiseXOR(half)))
        return apart.cast("bigint") * (self.num + self.den) <= both * (self.den - self.num)

    def met(self, common: Column, both: Column) -> Column:
        return common.cast("bigint") * (self.num + self.den) >= both.cast("bigint") * self.num


def distinct_lines(rows: DataFrame, stride: int, like: Threshold) -> DataFrame:
    """id (the first of equal lines), line, len (its number of different words), sig, sig2 and t: the rarest of its words that a like line may share."""
    ranks = levels(rows)
    once = lines(rows, stride).groupBy("line").agg(F.min("id").alias("id"))
    hashes = F.array_remove(F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    once = once.select("id", "line", keys(hashes, ranks).alias("k"))
    n = F.size("k")
    return once.select("id", "line", n.alias("len"), *signature(F.col("k"), n), F.slice(F.sort_array("k"), F.lit(1), like.prefix(n)).alias("t"))


def postings(once: DataFrame) -> DataFrame:
    """t, id, sig, sig2, lp: the words lines are found by, the lines and, in one long, the line's size and the word's place in its order."""
    flat = once.select("id", "len", "sig", "sig2", F.posexplode("t").alias("pos", "t"))
    return flat.select("t", "id", "sig", "sig2", F.shiftleft(F.col("len").cast("bigint"), 32).bitwiseOR(F.col("pos").cast("bigint")).alias("lp"))


def side(of: str) -> dict[str, Column]:
    lp = F.col(f"{of}lp")
    return {"id": F.col(f"{of}id"), "len": F.shiftright(lp, 32), "pos": lp.bitwiseAND((1 << 32) - 1), "sig": F.col(f"{of}sig"), "sig2": F.col(f"{of}sig2")}


def named(df: DataFrame, s: str) -> DataFrame:
    return df.select("t", *[F.col(c).alias(f"{s}{c}") for c in ("id", "sig", "sig2", "lp")])


def met(x: DataFrame, y: DataFrame, like: Threshold) -> DataFrame:
    """x, y: lines x and earlier lines y that share a word and pass the filters. x, y: postings."""
    both = named(x, "x").join(named(y, "y"), "t").where((F.col("xid") > F.col("yid")) & like.possible(side("x"), side("y")))
    return both.select(F.col("xid").alias("x"), F.col("yid").alias("y"))


def met_within(flat: DataFrame, like: Threshold) -> DataFrame:
    """The same of all postings and themselves: of two lines the shorter one is found by fewer of its words. Both sides read one exchange."""
    dealt = flat.where("t is not null and lp is not null").repartition("t")  # with the filters that Spark would add to one side alone
    a, b = side("x"), side("y")
    short = named(dealt, "y").where(b["pos"] + F.rand() * 0 < like.short(b["len"]))  # a filter that Spark moved below the exchange would make it another one
    both = named(dealt, "x").join(short, "t").where(((b["len"] < a["len"]) | (b["len"] == a["len"]) & (a["id"] > b["id"])) & like.possible(a, b))
    return both.select(F.greatest("xid", "yid").alias("x"), F.least("xid", "yid").alias("y"))


def verified(once: DataFrame, pairs: DataFrame, like: Threshold) -> DataFrame:
    """id of the lines x of pairs (x, y: ids) that are like their y, by their words."""
    pairs = written(pairs.distinct(), "pairs", clean=True)
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    if pairs.count() <= FEW:  # few enough to go to every task; more are joined
        ids = F.broadcast(ids)
    spelt = once.select("id", "line").join(ids, "id", "left_semi").select("id", F.array_remove(F.array_distinct(words(F.col("line"))), "").alias("w"))
    spelt = written(spelt, "spelt", clean=True, dictionary=False)
    both = pairs.join(spelt.toDF("x", "xw"), "x").join(spelt.toDF("y", "yw"), "y")
    return both.where(like.met(F.size(F.array_intersect("xw", "yw")), F.size("xw") + F.size("yw"))).select(F.col("x").alias("id")).distinct()


def like_earlier(once: DataFrame, like: Threshold, hot: int) -> DataFrame:
    """id of the lines of once where an earlier, different line is like it."""
    flat = postings(once)
    crowded = written(flat.where(F.col("t") >= least_key(hot + 1)).groupBy("t").count().where(F.col("count") > hot).select("t"), "crowded", clean=True)
    heavy = written(flat.join(crowded, "t"), "heavy", clean=True)
    heads = heavy.join(heavy.groupBy("t").agg(F.min("id").alias("id")), ["t", "id"])
    removed = written(verified(once, met(heavy, heads, like), like), "removed", clean=True)

    # in a crowded group only those that stay so far ask, so a group of near copies isn't squared; other groups are at
    # most `hot` rows
    usual = flat.join(crowded, "t", "left_anti")
    pairs = met_within(usual, like).union(met(heavy.join(removed, "id", "left_anti"), heavy, like))
    return written(removed.union(verified(once, pairs, like)).distinct(), "removed", clean=True)


def placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows with numbers _n (0 or more) and a stride, such that _n * stride + place of a line is a long for every line."""
    room = (1 << 63) - 1
    widest = docs.agg(F.max(F.octet_length("text")), F.count(F.lit(1))).first()
    stride = (widest[0] or 0) + 2  # a text has no more lines than bytes and one
    if (widest[1] + 1) * stride > room:
        stride = (docs.agg(F.max(F.size(F.split("text", "\n")))).first()[0] or 0) + 1
        if (widest[1] + 1) * stride > room:
            raise ValueError("more lines than longs")
    return numbered(docs, below=room // stride), stride


def rebuilt(text: Column, kept: Column) -> Column:
    """Of a text and the places of those lines with words that stay: the text that is left and its number of lines before and after."""

    def of(s: Column) -> Column:
        blank = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~has_words(F.get(s, i)))
        left = F.sort_array(F.concat(F.coalesce(kept, F.array().cast("array<int>")), blank))
        return F.transform(F.array(left), lambda p: F.struct(F.array_join(F.transform(p, lambda i: F.get(s, i)), "\n").alias("text"), F.size(s).alias("n"), F.size(p).alias("left")))

    return F.get(F.flatten(F.transform(F.array(F.split(text, "\n")), of)), 0)  # the array binds the split text: it is made once


def dedup_lines(docs: DataFrame, num: int = 4, den: int = 5, hot: int = 512) -> DataFrame:
    """All of docs' rows and columns in a struct named row, with text (the lines that stay), n_lines and n_removed.

    Lines are what line feeds separate; a line's words are what white space (\\x20, \\x09 to \\x0D) separates,
    as they are. A line goes if a line of earlier doc_id, or one above it in the same row, has a Jaccard
    similarity of num / den or more in their sets of words (whether or not that line itself goes). Lines
    without words stay. A null text has no lines and stays null; a text that loses all lines becomes empty.
    Rows of one doc_id follow each other in the order of their texts, null ids come first. An empty table
    gives no rows. hot: words that so many lines are found by are crowded, which changes the cost alone.
    """
    rows, stride = placed(docs)
    like = Threshold(num, den)
    once = written(distinct_lines(rows, stride, like), "lines", clean=True, dictionary=False)
    gone = like_earlier(once, like, hot)
    kept = once.select("id").join(gone, "id", "left_anti")
    kept = kept.groupBy(F.expr(f"id div {stride}").alias("_n"))
    kept = kept.agg(F.collect_list((F.col("id") % stride).cast("int")).alias("kept"))
    made = rows.join(kept, "_n", "left").select("row", F.when(F.col("row.text").isNotNull(), rebuilt(F.col("row.text"), F.col("kept"))).alias("made"))
    n, left = (F.coalesce(F.col(f"made.{c}"), F.lit(0)) for c in ("n", "left"))
    return made.select("row", F.col("made.text").alias("text"), n.alias("n_lines"), (n - left).alias("n_removed"))

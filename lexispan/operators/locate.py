"""From texts to places in the corpus: timed tokens, candidates by votes, alignment, confidence, and timing reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import numeric as N
from lexispan.functions import text as T

from . import align as A
from . import candidates as C
from .corpus import numbered, vocabulary

def timed_tokens(segments: DataFrame, by: str) -> DataFrame:
    """by, seg, word_pos, raw, start_s, end_s, estimated. segments: by, seg, start_s, end_s, text, words (array of word, start_s, end_s).

    A segment's own words count, unless there are far fewer than its text has: then the text's words share
    the segment's time and are marked as estimated. Empty words go.
    """
    spoken = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    own = F.filter(F.coalesce("words", F.array().cast("array<struct<word:string,start_s:double,end_s:double>>")), lambda w: T.normalize(w["word"]) != "")
    n, k = F.size(spoken), F.size(own)
    broken = ((n >= 4) & (k / n < 0.6)) | ((n >= 3) & (k == 1))
    d = F.col("end_s") - F.col("start_s")
    share = lambda i: F.when(d > 0, F.col("start_s") + d * i / n).otherwise(F.col("end_s"))
    spread = F.transform(spoken, lambda w, i: F.struct(w.alias("word"), F.when(d > 0, share(i)).otherwise(F.col("start_s")).alias("start_s"), share(i + 1).alias("end_s"), F.lit(True).alias("estimated")))
    given = F.transform(own, lambda w: F.struct(w["word"].alias("word"), w["start_s"].alias("start_s"), w["end_s"].alias("end_s"), F.lit(False).alias("estimated")))
    rows = segments.select(by, "seg", F.posexplode(F.when((k == 0) | broken, spread).otherwise(given)).alias("word_pos", "w"))
    return rows.select(by, "seg", "word_pos", F.col("w.word").alias("raw"), "w.start_s", "w.end_s", "w.estimated").where(T.normalize(F.col("raw")) != "")


def votes(docs: DataFrame, queries: DataFrame, key: str = "item_id") -> DataFrame:
    """key, doc_id, off, votes: the idf of each query's rare tokens, summed by document and offset in it."""
    q = queries.select(F.col(key).alias("item_id"), F.posexplode(T.tokenize(F.col("text"))).alias("q_pos", "token"))
    v = vocabulary(docs).where(~F.col("is_stop"))
    q = q.join(v, "token").select("item_id", "q_pos", F.col("token").alias("token_id"), "idf")
    c = docs.select("doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("pos", "token")).select(F.col("token").alias("token_id"), "doc_id", "pos")
    return C.offset_votes(q, c, "doc_id").select(F.col("item_id").alias(key), "doc_id", "off", "votes")


def simhash_windows(near: DataFrame, sizes: DataFrame, margin: int = 450) -> DataFrame:
    """Windows about the middle of near passages (doc_id, m: the query's tokens): ref_start, ref_end, off. sizes: doc_id, n (its tokens)."""
    centre = F.floor(F.col("n") / 2)
    off = centre - F.floor(F.col("m") / 2)
    at = near.join(sizes, "doc_id").withColumns({"off": off, "ref_start": F.greatest(off - margin, F.lit(0)), "ref_end": F.least(off + F.col("m") + margin, F.col("n"))})
    return at.drop("n")


def candidates(docs: DataFrame, queries: DataFrame, key: str = "item_id", keep: int = 10) -> DataFrame:
    """key, doc_id, m, off, ref_start, ref_end, source, quick, observed, window: where each query could lie, as words.

    Up to 12 peaks of the votes, and the middles of the 80 passages (documents) of nearest fingerprints; one for
    each coarse place; quick is the share of the query's rarest tokens' idf that the window holds, and by it the best
    of each source and then the best of all are kept.
    """
    words = queries.select(F.col(key).alias("item_id"), T.tokenize(F.col("text")).alias("observed")).withColumn("m", F.size("observed"))
    sized = docs.select("doc_id", T.tokenize(F.col("text")).alias("words"))
    sizes = sized.select("doc_id", F.size("words").alias("n"))
    found = C.peaks(votes(docs, queries, key).withColumnRenamed(key, "item_id"), "doc_id").select("item_id", F.explode("peaks").alias("p")).select("item_id", "p.doc_id", "p.off")
    anchors = found.join(words.select("item_id", "m"), "item_id").join(sizes, "doc_id")
    anchors = C.windows(anchors, F.col("m"), F.col("n")).drop("n").withColumn("source", F.lit("anchor"))
    prints = lambda df, k, of: T.simhash_md5(df, k, T.char_ngrams(F.col("text"))).select(F.col(k).alias(of), "simhash")
    numbers = queries.select(key).distinct().withColumn("a", F.xxhash64(key))
    near = C.near_passages(prints(queries.withColumn("a", F.xxhash64(key)), "a", "a"), prints(docs, "doc_id", "b"))
    near = near.join(numbers, "a").select(F.col(key).alias("item_id"), F.col("b").alias("doc_id")).join(words.select("item_id", "m"), "item_id")
    similar = simhash_windows(near, sizes).withColumn("source", F.lit("simhash"))
    both = C.dedup_windows(anchors.unionByName(similar), "item_id", "doc_id")

    v = vocabulary(docs).select("token", "idf")
    top = queries.select(F.col(key).alias("item_id"), F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("token")).join(v, "token")
    top = top.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("idf"), "token"))).where("k <= 64")
    wanted = top.groupBy("item_id").agg(F.collect_list(F.struct("token", "idf")).alias("wanted"))
    cut = both.join(sized, "doc_id").withColumn("window", F.slice("words", F.col("ref_start").cast("int") + 1, (F.col("ref_end") - F.col("ref_start")).cast("int"))).drop("words").join(wanted, "item_id", "left")
    held = F.col("window")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x["idf"])
    whole = total(F.col("wanted"))
    quick = F.when(F.coalesce(whole, F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(total(F.filter("wanted", lambda x: F.array_contains(held, x["token"]))) / whole)
    cut = cut.withColumns({"quick": F.round(quick, 6), "width": F.col("ref_end") - F.col("ref_start"), "id": F.col("doc_id") * 1000003 + F.col("ref_start")}).drop("wanted")
    return C.quota(cut, keep, "item_id").join(words.select("item_id", "observed"), "item_id").withColumnRenamed("item_id", key).drop("width", "id", "place")


def locate(docs: DataFrame, queries: DataFrame, key: str = "item_id", kind: str = "long", keep: int = 10, costs: A.Costs = A.Costs(), confusions: Sequence[tuple[str, str, float]] = ()) -> DataFrame:
    """Each query's best stretch: key, doc_id, cost, matches, diagonals, ref_start, ref_end, mapped, gap, confidence.

    The candidates' windows are aligned, words that start alike at a lower cost. Cost per token decides, then
    matches; the gap to the second best, the share of matches and the window's coverage make the confidence. A
    query without a candidate has no row.
    """
    pairs = candidates(docs, queries, key, keep).withColumnRenamed("window", "reference").withColumns({"base": F.col("ref_start").cast("long"), "off": F.col("off") - F.col("ref_start")})
    found = A.align_pairs(pairs.select(key, "doc_id", "quick", "observed", "reference", "base", "off"), f"{key} {kind}, doc_id long, quick double", costs, confusions=confusions)
    per = found.where("diagonals > 0").withColumn("norm", F.col("cost") / F.greatest(F.col("diagonals") + F.col("deletions"), F.lit(1)))
    order = Window.partitionBy(key).orderBy("norm", F.desc("matches"), "doc_id", "ref_start")
    ranked = per.withColumns({"k": F.row_number().over(order), "second": F.lead("norm").over(order)}).where("k = 1")
    gap = F.greatest(F.coalesce("second", F.col("norm") + 1) - F.col("norm"), F.lit(0.0))
    return ranked.withColumn("gap", gap).select(key, "doc_id", F.round("cost", 6).alias("cost"), "matches", "diagonals", "ref_start", "ref_end", "mapped", F.round("gap", 6).alias("gap"), F.round(N.confidence(F.col("matches"), F.col("diagonals"), F.col("gap"), F.col("quick")), 6).alias("confidence"))


def locate_segments(segments: DataFrame, docs: DataFrame, by: str, least: int = 2) -> DataFrame:
    """Each segment of each transcript located by itself: by, seg, start_s, end_s, place, group_id, confidence, as spans are found by.

    place is the document's number, group_id the document's source's. A segment of fewer words than least, or
    without a candidate, has nulls. segments: by, seg, start_s, end_s, text.
    """
    own = segments.where(F.size(T.tokenize(F.col("text"))) >= least).select(F.to_json(F.struct(by, "seg")).alias("segment_key"), "text")
    found = locate(docs, own, "segment_key", "string").select("segment_key", "doc_id", "confidence")
    numbers = numbered(docs).select("doc_id", F.col("doc_global").cast("long").alias("place"), "source")
    groups = numbers.select("source").distinct().withColumn("group_id", F.dense_rank().over(Window.orderBy("source")).cast("long"))  # a row a source
    placed = found.join(numbers, "doc_id").join(groups, "source").select("segment_key", "place", "group_id", "confidence")
    keyed = segments.select(by, "seg", "start_s", "end_s", F.to_json(F.struct(by, "seg")).alias("segment_key"))
    return keyed.join(placed, "segment_key", "left").drop("segment_key")


def token_times(found: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """key, doc_id, place, start_s, end_s: the located tokens' places with the times they were heard at, those of a place once. tokens: key, k (from 0), start_s, end_s."""
    flat = found.select(key, "doc_id", F.posexplode("mapped").alias("k", "place")).where("place is not null")
    timed = flat.join(tokens, [key, "k"])
    return timed.groupBy(key, "doc_id", "place").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


def refine(segments: DataFrame, spans: DataFrame, docs: DataFrame, by: str) -> DataFrame:
    """Each span's segments located again as one text: span_key ("by:span") and what locate says. segments: by, seg, text."""
    inside = segments.join(spans.select(by, "span", "first_segment", "last_segment"), by).where("seg >= first_segment and seg <= last_segment")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("seg", "text"))), lambda r: r["text"])
    joined = inside.groupBy(by, "span").agg(F.array_join(texts, " ").alias("text"))
    return locate(docs, joined.select(F.concat_ws(":", by, "span").alias("span_key"), "text"), "span_key", "string")


def owned_words(words: DataFrame, chunks: DataFrame, by: str, slack: float = 1e-6, least: float = 0.1) -> DataFrame:
    """Words whose start the chunk owns: from keep_from_s to before keep_to_s. Chunks shorter than `least` seconds own none."""
    c = chunks.where(F.col("end_s") - F.col("start_s") >= least).select(by, "chunk", "keep_from_s", "keep_to_s")
    return words.join(c, [by, "chunk"]).where((F.col("w_start") >= F.col("keep_from_s") - slack) & (F.col("w_start") < F.col("keep_to_s") + slack))


def timing_refresh(new: DataFrame, old: DataFrame, confidence: DataFrame, skip: tuple[int, ...] = (1, 33), force: bool = False) -> DataFrame:
    """A report by group, and whether its timings are to be updated. new, old: grp, num, ms; confidence: grp, conf.

    Complete groups alone, outside the skip list, that are forced or confident and far enough off.
    """
    both = old.select("grp", "num", F.col("ms").alias("was")).join(new.select("grp", "num", F.col("ms").alias("now")), ["grp", "num"], "left")
    off = F.abs(F.col("now") - F.col("was"))
    g = both.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count("now").alias("matched"), F.avg(off).alias("mae"), F.max(off).alias("most"), F.percentile(off, F.lit(0.5)).alias("middle"), F.sort_array(F.collect_list(off)).alias("all"))
    due = F.lit(True) if force else (F.col("conf") >= 0.60) & (F.col("most") >= 1500)
    update = (F.col("n") == F.col("matched")) & ~F.col("grp").isin(*skip) & due
    return g.join(confidence, "grp", "left").select("grp", "n", "matched", F.round("mae", 6).alias("mae"), F.round("most", 6).alias("most"), F.round("middle", 6).alias("middle"), F.round(N.nearest_rank(F.col("all"), 0.9, True), 6).alias("p90"), F.coalesce(update, F.lit(False)).alias("update"))

"""Full-text retrieval: query terms, matching, BM25 and the grouped guess of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import numeric as N
from lexispan.functions import text as T

K1, B = 1.2, 0.75


def query_terms(queries: DataFrame, most: int = 24, seen: int = 200) -> DataFrame:
    """item_id, term, n, place: of the first `seen` different terms of two characters or more the longest, most frequent ones."""
    terms = queries.select("item_id", F.posexplode(F.filter(T.expand_terms(T.tokenize(F.col("text"))), lambda t: F.length(t) >= 2)).alias("p", "term"))
    counted = terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"))
    first = counted.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy("p"))).where(F.col("k") <= seen)
    order = Window.partitionBy("item_id").orderBy(F.desc(F.length("term")), F.desc("n"), "term")
    return first.select("item_id", "term", "n", F.row_number().over(order).alias("place")).where(F.col("place") <= most)


def term_rows(docs: DataFrame, queries: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """doc_id, token, doc_len: the documents' tokens that are terms of a query, each as often as it occurs. Texts are tokenised once.

    A query has at most `most` terms, so the terms of up to a million in all go to every task; more are joined.
    """
    wanted = terms.select(F.col("term").alias("token")).distinct()
    if queries.count() * most <= 1_000_000:
        wanted = F.broadcast(wanted)
    words = docs.select("doc_id", T.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("doc_len"), F.explode("t").alias("token"))
    return words.join(wanted, "token", "left_semi")


def matches(docs: DataFrame, queries: DataFrame, every: bool = False, most: int = 24) -> DataFrame:
    """item_id, n_docs: documents with any of the query's terms, or with every one."""
    terms = query_terms(queries, most)
    of = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("k"))
    words = term_rows(docs, queries, terms, most).select("doc_id", F.col("token").alias("term")).distinct()
    hit = words.join(terms.select("item_id", "term"), "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    if every:
        hit = hit.join(of, "item_id").where("m = k")
    return of.select("item_id").join(hit.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))


def bm25(docs: DataFrame, queries: DataFrame, most: int = 24) -> DataFrame:
    """item_id, doc_id, score, over the documents with any term. The idf is that of Okapi, at least 1e-6."""
    terms = query_terms(queries, most).select("item_id", "term")
    n_docs, avg_len = docs.select(F.size(T.tokenize(F.col("text"))).alias("n")).agg(F.count(F.lit(1)), F.avg("n")).first()
    found = term_rows(docs, queries, terms, most).groupBy("token", "doc_id", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
    df = found.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / (avg_len or 1.0)))
    scored = found.join(df, "token").select("token", "doc_id", weight.alias("w"))
    return scored.join(terms, scored.token == terms.term).groupBy("item_id", "doc_id").agg(F.sum("w").alias("score"))


def hits(docs: DataFrame, queries: DataFrame, most: int = 800) -> DataFrame:
    """The best documents of each query: item_id, doc_id, score, place; ties by doc_id. Scores are rounded, as sums have no order."""
    rounded = bm25(docs, queries).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return rounded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def guess(docs: DataFrame, queries: DataFrame, mode: str = "default", top_n: int = 3, top_k: int = 5) -> DataFrame:
    """For each query the likeliest sources: item_id, source, best_score, sum_top, n_hits, best_doc, place, probability."""
    found = hits(docs, queries).join(docs.select("doc_id", "source"), "doc_id")
    rn = F.row_number().over(Window.partitionBy("item_id", "source").orderBy(F.desc("score"), "doc_id"))
    groups = found.withColumn("rn", rn).groupBy("item_id", "source").agg(
        F.max("score").alias("best_score"),
        F.round(F.sum(F.when(F.col("rn") <= top_n, F.col("score"))), 6).alias("sum_top"),
        F.count(F.lit(1)).alias("n_hits"),
        F.max(F.when(F.col("rn") == 1, F.col("doc_id"))).alias("best_doc"),
    )
    scored = groups.withColumn("rank_score", N.rank_score(F.col("best_score"), F.col("sum_top"), mode))
    order = Window.partitionBy("item_id").orderBy(F.desc("rank_score"), "source")
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)
    return best.withColumn("probability", F.round(N.softmax(F.col("rank_score"), "item_id"), 6)).withColumn("rank_score", F.round("rank_score", 4))

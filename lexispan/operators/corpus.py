"""The corpus as tables: numbered documents, tokens, vocabulary, postings and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import text as T


def numbered(docs: DataFrame, *more: str, bucket: int = 1 << 16) -> DataFrame:
    """doc_id, source, doc_num (within its source), doc_global (over all, by source and id), doc_key, and the columns named in more.

    Documents are numbered within stretches of ids of a source; the stretches' counts, a row each, give what comes
    before them. So neither a large source nor the table stands in one task.
    """
    cut = docs.select("doc_id", "source", *more, F.floor(F.col("doc_id") / bucket).alias("_b"))
    counts = cut.groupBy("source", "_b").count()
    own = F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sources = docs.groupBy("source").count()  # a row a source
    before = F.coalesce(F.sum("count").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("source", "_b", own.alias("own")).join(sources.select("source", before.alias("before")), "source")
    k = F.row_number().over(Window.partitionBy("source", "_b").orderBy("doc_id"))
    rows = cut.withColumn("k", k).join(offsets, ["source", "_b"]).withColumn("doc_num", (F.col("own") + F.col("k")).cast("int"))
    return rows.select("doc_id", "source", *more, "doc_num", (F.col("before") + F.col("doc_num")).alias("doc_global"), T.composite_key(F.col("source"), F.col("doc_num")).alias("doc_key"))


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, word_pos (from 1), token."""
    return docs.select("doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("p", "token")).select("doc_id", (F.col("p") + 1).alias("word_pos"), "token")


def before_each(rows: DataFrame, of: str, name: str) -> DataFrame:
    """rows (one a token) with a column name: the sum of column `of` over the tokens before it, in their order.

    Sums come from windows of tokens that start alike plus the totals of those starts, so no task holds the
    whole vocabulary.
    """
    rows = rows.withColumn("head", F.substring("token", 1, 3))
    heads = rows.groupBy("head").agg(F.sum(of).alias("total"))
    start = F.coalesce(F.sum("total").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(of).over(Window.partitionBy("head").orderBy("token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = heads.select("head", start.alias("start"))
    return rows.withColumn("within", within).join(offsets, "head").withColumn(name, F.col("start") + F.col("within")).drop("head", "start", "within")


def vocabulary(docs: DataFrame, stop_ratio: float = 0.35) -> DataFrame:
    """token, token_id (from 1 in the order of tokens), df, idf, is_stop."""
    n = docs.count()
    df = docs.select("doc_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    placed = before_each(df.withColumn("one", F.lit(1)), "one", "before")
    idf = F.log((n + 1) / (F.col("df") + 1)) + 1
    return placed.select("token", (F.col("before") + 1).cast("int").alias("token_id"), "df", idf.alias("idf"), (F.col("df") / n > stop_ratio).alias("is_stop"))


def inverted_index(docs: DataFrame) -> DataFrame:
    """token, n_postings, first_doc, last_doc, offset: where its places start among all tokens' places; see postings for the places."""
    counts = tokens(docs).groupBy("token").agg(F.count(F.lit(1)).alias("n_postings"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return before_each(counts, "n_postings", "offset")


def postings(docs: DataFrame) -> DataFrame:
    """token, doc_id, positions: the token's places in the document (from 1), in order. A token's list is its rows by doc_id."""
    return tokens(docs).groupBy("token", "doc_id").agg(F.sort_array(F.collect_list("word_pos")).alias("positions"))


def passages(docs: DataFrame, most: int = 5) -> DataFrame:
    """Sliding passages of 1 to most documents in a source: source, start_num, width, n_chars, last_key.

    Each document goes to the starts of all passages that hold it, at most `most`, so no key is a whole source.
    """
    rows = numbered(docs.withColumn("_n", F.length("text")), "_n")
    starts = F.sequence(F.greatest(F.col("doc_num") - (most - 1), F.lit(1)), F.col("doc_num"))
    held = rows.select("source", F.struct("doc_num", "_n", "doc_key").alias("d"), F.explode(starts).alias("start_num"))
    held = held.groupBy("source", "start_num").agg(F.sort_array(F.collect_list("d")).alias("d"))  # at most `most` rows
    wide = held.select("source", "start_num", "d", F.explode(F.sequence(F.lit(1), F.size("d"))).alias("width"))
    chars = F.aggregate(F.slice("d", F.lit(1), F.col("width")), F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x["_n"], F.lit(0)))
    return wide.select("source", "start_num", "width", chars.alias("n_chars"), F.get("d", F.col("width") - 1)["doc_key"].alias("last_key"))

"""Where in the corpus could a query lie: offsets voted for by rare tokens, peaks, windows and their selection.

Queries are rows of q_tokens (item_id, q_pos, token_id, idf), the corpus rows of c_tokens (pos, token_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import numeric as N


def rare_tokens(q_tokens: DataFrame, most: int = 28) -> DataFrame:
    """item_id, token_id, idf, q_pos: the rarest tokens and, of each one's places, the first, the middle and the last."""
    places = q_tokens.groupBy("item_id", "token_id").agg(F.max("idf").alias("idf"), F.sort_array(F.collect_list("q_pos")).alias("at"))
    order = Window.partitionBy("item_id").orderBy(F.desc("idf"), "token_id")
    some = places.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return some.select("item_id", "token_id", "idf", F.explode(N.picks(F.col("at"))).alias("q_pos"))


def sampled_postings(c_tokens: DataFrame, *own: str, most: int = 2000, bucket: int = 1024) -> DataFrame:
    """The corpus's places, every n-th of a token that has many (n: their number by most, at least 1), in the order of own and pos.

    Places are counted by buckets of the first of own (or of pos), so no task holds a frequent token's list.
    """
    order = [*own, "pos"]
    cut = c_tokens.select("token_id", *order, F.floor(F.col(order[0]) / bucket).alias("_b"))
    counts = cut.groupBy("token_id", "_b").count()
    w = Window.partitionBy("token_id")
    before = F.coalesce(F.sum("count").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = F.greatest(F.floor(F.sum("count").over(w) / most), F.lit(1))
    counts = counts.select("token_id", "_b", before.alias("before"), step.alias("step"))
    k = F.row_number().over(Window.partitionBy("token_id", "_b").orderBy(*order)) - 1
    placed = cut.withColumn("k", k).join(counts, ["token_id", "_b"])
    return placed.where((F.col("before") + F.col("k")) % F.col("step") == 0).select("token_id", *order)


def offset_votes(q_tokens: DataFrame, c_tokens: DataFrame, *own: str) -> DataFrame:
    """item_id, own, off, votes: the idf of rare query tokens summed by corpus place less query place. own: columns of the corpus that places are in, such as its documents."""
    rare = rare_tokens(q_tokens)
    found = rare.join(sampled_postings(c_tokens.join(rare.select("token_id").distinct(), "token_id", "left_semi"), *own), "token_id")
    return found.groupBy("item_id", *own, (F.col("pos") - F.col("q_pos")).alias("off")).agg(F.round(F.sum("idf"), 6).alias("votes"))


def peaks(votes: DataFrame, *own: str, apart: int = 25, most: int = 12) -> DataFrame:
    """item_id, peaks: offsets in the order of their votes (then of size, then of sign, then of own), each at least so far from all taken before in the same own.

    With own a peak is a struct of own and off. A peak bars at most 2 * apart - 1 offsets, so the best
    most * (2 * apart - 1) votes hold all peaks.
    """
    enough = most * (2 * apart - 1)
    first = [F.desc("votes"), F.abs("off"), "off", *own]
    top = votes.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(*first))).where(F.col("k") <= enough)
    fields = [*[F.col(c) for c in own], F.col("off").cast("bigint").alias("off")]
    kept = top.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct(F.col("k"), F.struct(*fields).alias("p")))).alias("o"))
    kinds = dict(votes.dtypes)
    empty = F.array().cast(f"array<struct<{', '.join(f'{c}:{kinds[c]}' for c in own)}{', ' if own else ''}off:bigint>>")

    def near(a: Column, b: Column) -> Column:
        out = F.abs(a["off"] - b["off"]) < apart
        for c in own:
            out = out & (a[c] == b[c])
        return out

    def take(acc: Column, x: Column) -> Column:
        ok = (F.size(acc) < most) & ~F.exists(acc, lambda a: near(a, x["p"]))
        return F.when(ok, F.concat(acc, F.array(x["p"]))).otherwise(acc)

    out = F.aggregate("o", empty, take)
    return kept.select("item_id", (out if own else F.transform(out, lambda p: p["off"])).alias("peaks"))


def near_passages(queries: DataFrame, passages: DataFrame, most: int = 80, block: int = 512) -> DataFrame:
    """a, b, distance, place: of each query (a, simhash) the passages (b, simhash) in the fewest differing bits, ties by b.

    Queries are a stated set: they are taken a block at a time, each block a constant that passages meet
    without a shuffle, and a task passes on its best `most` a query.
    """
    order = Window.partitionBy("a").orderBy("distance", "b")
    rows = queries.orderBy("a").collect()
    out = None
    for i in range(0, max(len(rows), 1), block):
        some = F.array(*[F.struct(F.lit(r["a"]).cast("long").alias("a"), F.lit(r["simhash"]).cast("long").alias("s")) for r in rows[i : i + block]]) if rows else F.array().cast("array<struct<a:bigint,s:bigint>>")
        met = passages.select("b", "simhash", F.explode(some).alias("q"))
        met = met.select(F.col("q.a").alias("a"), "b", F.bit_count(F.col("q.s").bitwiseXOR(F.col("simhash"))).cast("int").alias("distance"))
        best = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        out = best if out is None else out.union(best)
    return out


def windows(found: DataFrame, m: Column, length: int, margin: int = 450) -> DataFrame:
    """ref_start, ref_end of each offset's window, within the corpus; empty ones go."""
    start = F.greatest(F.col("off") - margin, F.lit(0))
    end = F.least(F.col("off") + m + margin, F.lit(length))
    return found.withColumn("ref_start", start).withColumn("ref_end", end).where("ref_start < ref_end")


def dedup_windows(found: DataFrame, *by: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """One window for each coarse place: by ref_start and off in units of 256, cut towards zero; anchors before simhash, then by ref_start, off and ties."""
    priority = F.when(F.col("source") == "anchor", 0).when(F.col("source") == "embed", 1).otherwise(2)
    key = [F.expr("ref_start div 256"), F.expr("off div 256")]
    order = Window.partitionBy(*by, *key).orderBy(priority, "ref_start", "off", *ties)
    return found.where("ref_start < ref_end").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def coverage(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """item_id, doc_id, coverage: of each query's top tokens (item_id, token, idf) the share of idf in a document (doc_id, token)."""
    total = wanted.groupBy("item_id").agg(F.sum("idf").alias("total"))
    hit = found.distinct().join(wanted, "token").groupBy("item_id", "doc_id").agg(F.sum("idf").alias("part"))
    share = F.when(F.col("total") > 0, F.col("part") / F.col("total")).otherwise(F.lit(1.0))
    return hit.join(total, "item_id").select("item_id", "doc_id", F.round(share, 6).alias("coverage"))


def quota(found: DataFrame, most: int, *by: str) -> DataFrame:
    """The best of each source first, then the best of all, up to most; place orders by quick (descending), width, id."""
    best = Window.partitionBy(*by, "source").orderBy(F.desc("quick"), "width", "id")
    ranked = found.withColumn("first", (F.row_number().over(best) == 1).cast("int"))
    chosen = ranked.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("first"), F.desc("quick"), "width", "id"))).where(F.col("k") <= most)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("quick"), "width", "id"))).drop("first", "k")


def best_and_second(costs: DataFrame, *by: str) -> DataFrame:
    """By group the best id and its cost, the second's cost (the best plus one if alone) and the gap; ties by matches, then id."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy("cost", F.desc("matches"), "id"))
    two = costs.withColumn("k", k).groupBy(*by).agg(F.max(F.when(F.col("k") == 1, F.col("id"))).alias("best_id"), F.max(F.when(F.col("k") == 1, F.col("cost"))).alias("best"), F.max(F.when(F.col("k") == 2, F.col("cost"))).alias("two"))
    second = F.coalesce("two", F.col("best") + 1)
    return two.select(*by, "best_id", "best", second.alias("second"), F.greatest(second - F.col("best"), F.lit(0.0)).alias("gap"))

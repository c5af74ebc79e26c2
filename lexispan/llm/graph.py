"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _least(links: DataFrame) -> DataFrame:
    """u, v and m: the smallest of u and all its neighbours v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def stars(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: for each node of links (u, v long, u <> v) but the roots, the smallest node it is connected with.

    Large and small stars in turn: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows. A round shuffles links alone, at most as many as there were, and the number of
    rounds grows with the logarithm of the longest path. Links live in the shared folder between rounds.
    """
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = mark(now)
    for _ in range(rounds):
        if not was[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)  # every link runs from the larger to the smaller node
        now = checkpointed(small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").where("u <> v").distinct())
        is_ = mark(now)
        if is_ == was:
            return now.toDF("node", "root")
        was = is_
    if was[0]:
        raise RuntimeError("components did not settle")
    return now.toDF("node", "root")

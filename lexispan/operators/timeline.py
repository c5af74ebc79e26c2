"""Ordered operators on timed rows: fills, smoothing, sessions, segments and interval joins, as windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upto(by: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def forward_fill(c: Column, by: Sequence[str], order: Sequence) -> Column:
    return F.last(c, ignorenulls=True).over(upto(by, order))


def backward_fill(c: Column, by: Sequence[str], order: Sequence) -> Column:
    return F.first(c, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))


def smooth(df: DataFrame, start: str, end: str, by: Sequence[str], order: Sequence) -> DataFrame:
    """Ends never go back, starts not before the end so far; rows with a missing time pass through and count for nothing.

    The new end is a running maximum of the larger of start and end, the new start the larger of itself and the previous new end.
    """
    both = F.col(start).isNotNull() & F.col(end).isNotNull()
    top = F.max(F.when(both, F.greatest(start, end))).over(upto(by, order))
    before = F.max(F.when(both, F.greatest(start, end))).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    made = df.withColumns({"_s": F.when(both, F.greatest(F.col(start), F.coalesce(before, F.col(start)))).otherwise(F.col(start)), "_e": F.when(both, top).otherwise(F.col(end))})
    return made.withColumns({start: F.col("_s"), end: F.col("_e")}).drop("_s", "_e")


def monotone(c: Column, by: Sequence[str], order: Sequence) -> Column:
    return F.max(c).over(upto(by, order))


def run_starts(df: DataFrame, key: str, by: Sequence[str], order: Sequence) -> DataFrame:
    """The rows whose key differs from the row's before."""
    last = F.lag(key).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_l", last).where(~F.col("_l").eqNullSafe(F.col(key)) | F.col("_l").isNull()).drop("_l")


def gap_sessions(df: DataFrame, start: str, end: str, gap: float, by: Sequence[str], order: Sequence, running: bool = False) -> Column:
    """A session number from 0: a new one starts more than gap after the previous row's end, or with running after the largest end so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    last = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag(end).over(w)
    return F.coalesce(F.col(start) - last > gap, F.lit(False)).cast("int")


def sessions(df: DataFrame, start: str, end: str, gap: float, by: Sequence[str], order: Sequence, running: bool = False) -> DataFrame:
    flagged = df.withColumn("_new", gap_sessions(df, start, end, gap, by, order, running))
    return flagged.withColumn("session", F.sum("_new").over(upto(by, order))).drop("_new")


def capped_segments(df: DataFrame, start: str, end: str, gap: float, most: int, by: Sequence[str], order: Sequence) -> DataFrame:
    """Sessions by the largest end so far, each cut after most rows: session, part."""
    found = sessions(df, start, end, gap, by, order, running=True)
    k = F.row_number().over(Window.partitionBy(*by, "session").orderBy(*order)) - 1
    return found.withColumn("part", F.floor(k / most))


def fill_times(df: DataFrame, start: str, end: str, by: Sequence[str], order: Sequence) -> DataFrame:
    """A missing start becomes the last known end or else the next known start, a missing end the next known start or else the start; estimated marks them."""
    w = Window.partitionBy(*by).orderBy(*order)
    last_end = F.last(F.col(end), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    next_start = F.first(F.col(start), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    made = df.withColumns({"_s": F.coalesce(F.col(start), last_end, next_start), "_n": next_start})
    return made.withColumns({"estimated": F.col(start).isNull() | F.col(end).isNull(), end: F.coalesce(F.col(end), F.col("_n"), F.col("_s")), start: F.col("_s")}).drop("_s", "_n")


def interpolate(tokens: DataFrame, start: str, end: str, k: str, n: str) -> DataFrame:
    """Token k (from 0) of n gets its share of its segment's time; w_start, w_end. A segment without duration: all end at its end."""
    d = F.col(end) - F.col(start)
    share = lambda i: F.when(d > 0, F.col(start) + d * i / F.col(n)).otherwise(F.col(end))
    return tokens.withColumns({"w_start": F.when(d > 0, share(F.col(k))).otherwise(F.col(start)), "w_end": share(F.col(k) + 1)})


def into_slots(points: DataFrame, ends: DataFrame, by: str, at: str, slot: str, end: str, width: float) -> DataFrame:
    """Each point's slot, half-open by the slots' ends: [previous end, end); the first has no start. Points past the last end are left out.

    Points and slots meet by buckets of width, so no point meets all slots of its group; a point before the first
    end goes to that end's bucket.
    """
    w = Window.partitionBy(by).orderBy(end, slot)
    slots = ends.withColumn("_from", F.coalesce(F.lag(end).over(w), F.lit(float("-inf")))).where(F.col("_from") < F.col(end))
    low = F.when(F.col("_from") == float("-inf"), F.col(end)).otherwise(F.col("_from"))
    cut = slots.withColumn("_b", F.explode(F.sequence(F.floor(low / width), F.floor(F.col(end) / width))))
    cut = cut.select(F.col(by), F.col(slot), F.col(end), "_from", "_b")
    first = ends.groupBy(by).agg(F.min(end).alias("_first"))
    placed = points.join(first, by).withColumn("_b", F.floor(F.greatest(F.col(at), F.col("_first")) / width)).drop("_first")
    return placed.join(cut, [by, "_b"]).where((F.col(at) >= F.col("_from")) & (F.col(at) < F.col(end))).drop("_b", "_from")


def speech_intervals(silences: DataFrame, by: str, start: str, end: str, duration: Column, pad: float = 0.15, least: float = 0.25) -> DataFrame:
    """Where it isn't silent: s, e of the stretches between silences, padded within the whole, of at least `least`."""
    w = Window.partitionBy(by).orderBy(start, end)
    before = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = silences.withColumn("_d", duration)
    inner = rows.select(by, "_d", before.alias("s"), F.col(start).alias("e"))
    tail = rows.groupBy(by).agg(F.max("_d").alias("_d"), F.max(end).alias("s")).select(by, "_d", "s", F.col("_d").alias("e"))
    found = inner.union(tail).where(F.col("e") - F.col("s") >= least)
    return found.select(by, F.round(F.greatest(F.col("s") - pad, F.lit(0.0)), 6).alias("s"), F.round(F.least(F.col("e") + pad, F.col("_d")), 6).alias("e"))


def assign_tokens(df: DataFrame, by: Sequence[str], order: Sequence, gap: float = 0.75) -> DataFrame:
    """The document of each unmapped token. Columns: doc (null: unmapped), start, end, estimated, known, and in_prev, in_next: whether the neighbours' documents contain the token.

    Mapped tokens keep theirs. Between two sides: the same document if both agree, the only one that contains
    the token, else the next one if a gap precedes the next start, else the previous one. With one side only
    if the token is known, not estimated and contained. Estimated tokens never bridge.
    """
    prev, nxt = F.col("prev_doc"), F.col("next_doc")
    one = F.col("known") & ~F.col("estimated")
    bridge = (
        F.when(prev == nxt, prev)
        .when(F.col("in_prev") & ~F.col("in_next"), prev)
        .when(F.col("in_next") & ~F.col("in_prev"), nxt)
        .when(F.col("next_start") - F.col("end") > gap, nxt)
        .otherwise(prev)
    )
    filled = df.withColumns({"prev_doc": forward_fill(F.col("doc"), by, order), "next_doc": backward_fill(F.col("doc"), by, order), "next_start": F.lead("start").over(Window.partitionBy(*by).orderBy(*order))})
    out = (
        F.when(F.col("doc").isNotNull(), F.col("doc"))
        .when(F.col("estimated"), F.when(prev == nxt, prev))
        .when(prev.isNotNull() & nxt.isNotNull(), bridge)
        .when(prev.isNotNull(), F.when(one & F.col("in_prev"), prev))
        .when(nxt.isNotNull(), F.when(one & F.col("in_next"), nxt))
    )
    return filled.withColumn("assigned", out)


def repair_partial(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """Proposed times (null: untouched) against stored ones: clamped to the running maximum, and ok unless an untouched row would have to move."""
    now = F.coalesce("proposed", "stored")
    top = F.max(now).over(upto(by, order))
    broken = F.max(F.col("proposed").isNull() & (F.col("stored") < F.col("clamped"))).over(Window.partitionBy(*by))
    return df.withColumn("clamped", top).withColumn("ok", ~broken)

"""Numbers on columns: scores, levels, summaries and times."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def softmax(score: Column, *by: str) -> Column:
    """Over the rows of a group."""
    w = Window.partitionBy(*by)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def rank_score(best: Column, top: Column, mode: str = "default") -> Column:
    if mode == "best_score":
        return best
    return best + 0.25 * top if mode == "hybrid" else F.greatest(top, best)


def confidence(matches: Column, diagonals: Column, gap: Column, quick: Column) -> Column:
    """From the share of matches, the cost gap to the second best and the quick score; less below twenty diagonals."""
    ratio = F.when(diagonals > 0, matches / diagonals).otherwise(F.lit(0.0))
    raw = 0.45 * clamp((ratio - 0.2) / 0.65, 0.0, 1.0) + 0.35 * F.least(gap / 0.35, F.lit(1.0)) + 0.2 * clamp(quick, 0.0, 1.0)
    return F.when(diagonals < 20, raw * clamp(diagonals / 12, 0.0, 1.0)).otherwise(raw)


def dbfs(mean_square: Column) -> Column:
    """Of 16-bit samples by the mean of their squares; -100 for silence or no samples."""
    return F.when(mean_square > 0, 20 * F.log10(F.sqrt(mean_square) / 32768)).otherwise(F.lit(-100.0))


def mic_level(db: Column) -> Column:
    return clamp((db + 60) / 40, 0.0, 1.0)


def band_width(m: Column) -> Column:
    return clamp(F.round(0.2 * m) + 60, 120.0, 700.0).cast("int")


def span_centre(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("bigint")


def nearest_rank(sorted_values: Column, p: float, rounded: bool) -> Column:
    """The value at index (n - 1) * p, the index rounded half up or cut."""
    at = (F.size(sorted_values) - 1) * p
    return F.get(sorted_values, (F.floor(at + 0.5) if rounded else F.floor(at)).cast("int"))


def bucket(conf: Column) -> Column:
    return F.when(conf > 0.7, "good").when(conf > 0.4, "warn").otherwise("bad")


def picks(values: Column) -> Column:
    """The first, the middle (of more than two) and the last (of more than one)."""
    n = F.size(values)
    some = F.array(F.get(values, F.lit(0)), F.when(n > 2, F.get(values, F.floor(n / 2).cast("int"))), F.when(n > 1, F.get(values, n - 1)))
    return F.array_distinct(F.filter(some, lambda x: x.isNotNull()))


def edit_first_time(json: Column, value: Column) -> Column:
    """Sets [0][1] of a JSON array of pairs; unchanged if the first isn't a pair of whole numbers."""
    parsed = F.from_json(json, "array<array<bigint>>")
    changed = F.transform(parsed, lambda x, i: F.when(i == 0, F.array(F.get(x, F.lit(0)), value.cast("bigint"))).otherwise(x))
    return F.when(F.size(F.get(parsed, F.lit(0))) == 2, F.to_json(changed)).otherwise(json)

"""Weighted banded semi-global alignment of token sequences.

Observed tokens align with a stretch of the reference that may start and end anywhere. Moves: pair a token
with one of the reference (free if equal and known, else the cost of the substitution), skip an observed
token, skip a reference token. Least cost wins, then most matches, then pairing before skipping an observed
token before skipping one of the reference. Costs are whole numbers of millionths, and cost and matches are
one number, so a row of the table is a handful of numpy operations: skipping along the reference is the only
dependence within a row and is a running minimum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UNIT, PACK = 1_000_000, 1 << 21
FAR = np.int64(1) << 61


@dataclass(frozen=True)
class Costs:
    """skip_observed, skip_reference and a substitution's cost; pairs: (reference, observed) with a cost of their own."""

    skip_observed: float = 1.0
    skip_reference: float = 1.0
    substitute: float = 1.0
    pairs: tuple[tuple[int, int, float], ...] = ()


def backoff(reference: str, observed: str, fallback: float) -> float:
    """A cheaper substitution for words that start alike and are of like length, by their character 3-grams."""
    if reference[:1] != observed[:1] or abs(len(reference) - len(observed)) > 3:
        return fallback
    grams = lambda w: {w[i : i + 3] for i in range(len(w) - 2)}
    a, b = grams(reference), grams(observed)
    return fallback * (1 - 0.6 * (len(a & b) / len(a | b) if a and b else 0.0))


class Prices:
    """What it costs, in whole numbers, to pair an observed token with each different token of a reference."""

    def __init__(self, reference: np.ndarray, costs: Costs, words: Callable[[int], str] | None):
        self.tokens, self.of = np.unique(reference, return_inverse=True)
        self.costs, self.words, self.known = costs, words, {}
        self.own: dict[int, list[tuple[int, float]]] = {}
        for r, o, c in costs.pairs:
            self.own.setdefault(o, []).append((r, c))
        self.by_initial: dict[str, list[tuple[int, str]]] = {}
        if words:
            for k, r in enumerate(self.tokens.tolist()):
                if r:
                    self.by_initial.setdefault(words(r)[:1], []).append((k, words(r)))

    def row(self, o: int) -> np.ndarray:
        if o not in self.known:
            price = np.full(len(self.tokens), whole(self.costs.substitute))
            if o and self.words:
                for k, w in self.by_initial.get(self.words(o)[:1], ()):
                    price[k] = whole(backoff(w, self.words(o), self.costs.substitute))
            for r, c in self.own.get(o, ()):
                price[self.tokens == r] = whole(c)
            if o:
                price[self.tokens == o] = -1  # free, and the low part counts matches, taken away
            self.known[o] = price
        return self.known[o]


def whole(cost: float) -> np.int64:
    return np.int64(round(cost * UNIT)) * PACK


def align(observed: np.ndarray, reference: np.ndarray, offset: int, band: int, costs: Costs = Costs(), words: Callable[[int], str] | None = None) -> dict:
    """cost, matches, diagonals, deletions (observed tokens skipped), insertions (reference tokens skipped), start, end, and for each observed token the reference place (or None) and whether they match.

    Token 0 is unknown and matches nothing. Only cells within band of the line offset + i are looked at or kept:
    column c of row i stands for the reference place offset + i - band + c. No observed tokens or no reference:
    the cost of skipping all of them, and nothing aligned.
    """
    m, n, width = len(observed), len(reference), 2 * band + 1
    nothing = {"cost": float(m * costs.skip_observed), "matches": 0, "diagonals": 0, "deletions": m, "insertions": 0, "start": None, "end": None, "mapped": [None] * m, "is_match": [False] * m}
    if m == 0 or n == 0:
        return nothing
    skip_o, skip_r = whole(costs.skip_observed), whole(costs.skip_reference)
    prices, columns = Prices(reference, costs, words), np.arange(width, dtype=np.int64)
    place = offset - band + columns
    row = np.where((place >= 0) & (place <= n), np.int64(0), FAR)
    slope = skip_r * columns
    moves = np.full((m + 1, width), -1, np.int8)
    for i in range(1, m + 1):
        place = place + 1
        inside = (place >= 0) & (place <= n)
        price = prices.row(int(observed[i - 1]))[prices.of[np.clip(place - 1, 0, n - 1)]]
        pair = np.where((row < FAR) & (place >= 1), row + price, FAR)
        above = np.append(row[1:], FAR)
        up = np.where(above < FAR, above + skip_o, FAR)
        base = np.where(inside, np.minimum(pair, up), FAR)
        best = np.minimum.accumulate(np.where(base < FAR, base - slope, FAR)) + slope
        along = np.concatenate([[FAR], best[:-1] + skip_r])
        now = np.where(inside, np.minimum(base, along), FAR)
        moves[i] = np.where(now >= FAR // 2, -1, np.where(pair == now, 0, np.where(up == now, 1, 2)))
        row = np.where(now >= FAR // 2, FAR, now)
    if row.min() >= FAR:
        return nothing
    c = int(np.argmin(row))
    packed, end = int(row[c]), offset + m - band + c
    i, mapped, is_match, insertions = m, [None] * m, [False] * m, 0
    while i > 0:
        move = moves[i, c]
        if move == 0:
            j = offset + i - band + c - 1
            mapped[i - 1], is_match[i - 1] = j, bool(observed[i - 1] and observed[i - 1] == reference[j])
            i -= 1
        elif move == 1:
            i, c = i - 1, c + 1
        else:
            c -= 1
            insertions += 1
    matches, diagonals = sum(is_match), sum(x is not None for x in mapped)
    return {"cost": (packed + matches) / PACK / UNIT, "matches": matches, "diagonals": diagonals, "deletions": m - diagonals, "insertions": insertions, "start": offset - band + c, "end": end, "mapped": mapped, "is_match": is_match}


RESULT = "cost double, matches int, diagonals int, deletions int, insertions int, ref_start long, ref_end long"


def align_pairs(pairs: DataFrame, keys: str, costs: Costs = Costs(), limit: int = 10_000, confusions: Sequence[tuple[str, str, float]] = ()) -> DataFrame:
    """Aligns each row's observed with its reference (arrays of words, an empty one unknown; base: the reference's first place; off: the expected offset in it).

    keys: the schema of the columns that are kept. confusions: (reference word, observed word, cost); other words
    that start alike cost less the more 3-grams they share. mapped: for each observed word its place in the
    reference or null. status: ok, too_long beyond limit observed tokens, or empty. One row is one task's unit of
    work, so Spark deals rows out and no group is collected.
    """
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                number: dict[str, int] = {"": 0}
                o, ref = (np.array([number.setdefault(w or "", len(number)) for w in r[c] or ()], np.int64) for c in ("observed", "reference"))
                spelt = list(number)
                own = tuple((number[x], number[y], c) for x, y, c in confusions if x in number and y in number)
                status = "too_long" if len(o) > limit else "empty" if not len(o) else "ok"
                band = min(max(int(0.2 * len(o) + 0.5) + 60, 120), 700)
                a = align(o if status == "ok" else o[:0], ref, int(r["off"]), band, replace(costs, pairs=own), spelt.__getitem__)
                base = r["base"]
                found = {"ref_start": None, "ref_end": None} if a["start"] is None else {"ref_start": base + a["start"], "ref_end": base + a["end"]}
                mapped = [None if x is None else base + x for x in a["mapped"]]
                out.append({k: r[k] for k in names} | {k: a[k] for k in ("cost", "matches", "diagonals", "deletions", "insertions")} | found | {"mapped": mapped, "status": status})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ddl = f"{keys}, {RESULT}, mapped array<long>, status string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return pairs.mapInArrow(run, ddl)

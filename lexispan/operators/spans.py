"""Spans of a transcript: where its segments jump to another part of the corpus. An ordered fold for each transcript."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Least confidence to count, confidence that splits at once, distances that are far, hits that confirm."""

    least: float = 0.30
    sure: float = 0.93
    far: int = 80
    far_group: int = 2
    hits: int = 2


@dataclass
class Fold:
    """Takes segments in order. spans: [first, last] segments; jumps: segment, from, to, distance."""

    rules: Rules = Rules()
    spans: list[list[int]] = field(default_factory=lambda: [[0, 0]])
    jumps: list[dict] = field(default_factory=list)
    at: tuple[int, int] | None = None  # place and group last trusted
    waiting: dict | None = None  # a far place seen, not yet confirmed

    def distance(self, place: int, group: int) -> tuple[int, bool]:
        d = abs(place - self.at[0])
        return d, d >= self.rules.far or abs(group - self.at[1]) >= self.rules.far_group

    def split(self, first: int, last: int, seen_at: float, distance: int) -> None:
        self.spans[-1][1] = max(first - 1, 0)
        self.spans.append([first, last])
        n = len(self.spans) - 1
        self.jumps.append({"at_s": seen_at, "segment": first, "from_span": n - 1, "to_span": n, "distance": distance})

    def trust(self, place: int, group: int) -> None:
        self.at, self.waiting = (place, group), None

    def step(self, i: int, seen_at: float, place: int | None, group: int | None, confidence: float | None) -> None:
        self.spans[-1][1] = i
        if place is None or confidence is None or confidence < self.rules.least:
            return
        if self.at is None:
            return self.trust(place, group)
        distance, far = self.distance(place, group)
        if not far:
            return self.trust(place, group)
        if confidence >= self.rules.sure:
            self.split(i, i, seen_at, distance)
            return self.trust(place, group)
        if self.waiting is None or abs(place - self.waiting["place"]) > self.rules.far:
            self.waiting = {"first": i, "place": place, "group": group, "hits": 1}
            return None
        self.waiting["hits"] += 1
        if self.waiting["hits"] >= self.rules.hits:
            self.split(self.waiting["first"], i, seen_at, distance)
            self.trust(place, group)
        return None

    def finish(self, starts: list[float]) -> None:
        """A single far segment at the end splits too. Empty spans go, and jumps keep the spans' new numbers."""
        n = len(starts)
        if self.waiting and self.at and n - self.waiting["first"] <= 1:
            distance, far = self.distance(self.waiting["place"], self.waiting["group"])
            first = self.waiting["first"]
            if far and first > self.spans[-1][0]:
                self.split(first, n - 1, starts[first], distance)
        kept = [k for k, (a, b) in enumerate(self.spans) if a <= b]
        number = {k: i for i, k in enumerate(kept)}
        self.spans = [self.spans[k] for k in kept]
        self.jumps = [j | {"from_span": number[j["from_span"]], "to_span": number[j["to_span"]]} for j in self.jumps if {j["from_span"], j["to_span"]} <= number.keys()]


def drop_noise(spans: list[dict], jumps: list[dict]) -> tuple[list[dict], list[dict]]:
    """Without short, doubtful leading spans of one segment before much longer rests. spans: first, last, start_s, end_s, confidence."""
    while len(spans) > 1:
        head, rest = spans[0], spans[1:]
        length = max(head["end_s"] - head["start_s"], 0.0)
        after = max(rest[-1]["end_s"] - rest[0]["start_s"], 0.0)
        if head["last"] > head["first"] or length > 15 or head["confidence"] >= 0.75 or after < max(3 * length, 10.0):
            break
        spans = rest
        jumps = [j | {"from_span": j["from_span"] - 1, "to_span": j["to_span"] - 1} for j in jumps if j["from_span"] > 0 and j["to_span"] > 0]
    return spans, jumps


OUT = "span int, first_segment int, last_segment int, start_s double, end_s double, confidence double, jump_segment int, jump_distance int"


def find_spans(segments: DataFrame, by: str, kind: str = "long", rules: Rules = Rules()) -> DataFrame:
    """One row a span. segments: by, seg, start_s, end_s, place, group_id, confidence (nulls: not aligned)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg").reset_index(drop=True)
        f = Fold(rules)
        whole = lambda x: None if pd.isna(x) else int(x)
        for i, r in enumerate(pdf.itertuples()):
            f.step(i, float(r.start_s), whole(r.place), whole(r.group_id), None if pd.isna(r.confidence) else float(r.confidence))
        f.finish(pdf["start_s"].tolist())
        rows = [{"first": a, "last": b, "start_s": float(pdf["start_s"][a]), "end_s": float(pdf["end_s"][b]), "confidence": float(pdf["confidence"][a : b + 1].fillna(0).mean())} for a, b in f.spans]
        rows, jumps = drop_noise(rows, f.jumps)
        jump = {j["to_span"]: j for j in jumps}
        return pd.DataFrame(
            [
                {by: pdf[by][0], "span": k, "first_segment": r["first"], "last_segment": r["last"], "start_s": r["start_s"], "end_s": r["end_s"], "confidence": round(r["confidence"], 6), "jump_segment": jump[k]["segment"] if k in jump else None, "jump_distance": jump[k]["distance"] if k in jump else None}
                for k, r in enumerate(rows)
            ]
        ).astype({"jump_segment": "Int32", "jump_distance": "Int32"})

    return segments.groupBy(by).applyInPandas(fold, f"{by} {kind}, {OUT}")


def active_span(last: dict[str, Column], prev: dict[str, Column], index: Column) -> Column:
    """The last span's index, or the one before if the last has little evidence, the one before has enough, and the last is not sure."""
    little = (last["diagonals"] < 8) | (last["matches"] < 5)
    enough = (prev["diagonals"] >= 8) & (prev["matches"] >= 5)
    return F.when((index > 0) & little & enough & (last["confidence"] < 0.85), index - 1).otherwise(index)


def override(guessed: Column, aligned: Column, conf: Column, diagonals: Column, matches: Column) -> Column:
    """The aligned group instead of the guessed one, if confident enough (more so for another group) and with enough evidence."""
    needed = F.when(guessed == aligned, 0.35).otherwise(0.50)
    return F.when((conf >= needed) & ((diagonals >= 6) | (matches >= 4)), aligned).otherwise(guessed)

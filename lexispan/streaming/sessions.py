"""The commit machine in Structured Streaming, and the same steps over a table."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .machine import Observation, State, limited, plan_chunks, step

#: Observations: session, seq and the fields of Observation.
IN = "session string, seq long, obs_key string, place long, confidence double, diagonals int, ratio double, group_id string, at_s double"
OUT = "session string, seq long, action string, committed long, pending long, skipped int, stable string, ux string, alerts string, ended string, error string"
COLUMNS = [x.split()[0] for x in OUT.split(", ")]


@dataclass(frozen=True)
class Limits:
    """When a session ends: after so many seconds of audio, or when nothing has come for so long."""

    most_audio_s: float = 3600.0
    no_audio_s: float = 30.0


def observe(r) -> Observation:
    none = lambda x: None if pd.isna(x) else x
    place = none(r.place)
    return Observation(none(r.obs_key), None if place is None else int(place), float(r.confidence), int(r.diagonals), float(r.ratio), none(r.group_id), float(r.at_s))


def frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{c: r.get(c) for c in COLUMNS} for r in rows], columns=COLUMNS).astype({"seq": "Int64", "committed": "Int64", "pending": "Int64", "skipped": "Int32"})


def answers(session: str, rows: pd.DataFrame, s: State) -> tuple[State, pd.DataFrame]:
    """The state after the rows, in the order of seq, and an answer to each. A row that can't be read gets an error and changes nothing."""
    out = []
    for r in rows.sort_values("seq").itertuples():
        try:
            s, told = step(s, observe(r))
        except (TypeError, ValueError) as e:
            told = {"action": "error", "error": str(e)}
        out.append({"session": session, "seq": r.seq} | {k: told.get(k) for k in COLUMNS[2:]})
    return s, frame(out)


def batch(observations: DataFrame) -> DataFrame:
    """All sessions at once: an ordered fold for each."""
    return observations.groupBy("session").applyInPandas(lambda pdf: answers(pdf["session"].iloc[0], pdf, State())[1], OUT)


class SessionProcessor(StatefulProcessor):
    """Keeps each session's State as JSON. Rows of a micro-batch are taken in the order of seq.

    A session that has had its audio ends with its last answer; one from which nothing comes ends by a timer
    with an answer of its own. Either way its state goes, and a later row of that name starts anew.
    """

    def __init__(self, limits: Limits = Limits(), at: str | None = None):
        self.limits, self.at = limits, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")

    def forget(self) -> None:
        self.state.clear()
        if self.at:
            self.wake_at(None)

    def wake_at(self, ms: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ms is not None:
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = State(**json.loads(self.state.get()[0])) if self.state.exists() else State()
        all_ = pd.concat(list(rows))
        s, out = answers(key[0], all_, s)
        if all_["at_s"].max() >= self.limits.most_audio_s:
            out.loc[out.index[-1], "ended"] = "max_audio"
            self.forget()
        else:
            self.state.update((json.dumps(asdict(s)),))
            if self.at:
                self.wake_at(int(all_[self.at].max().timestamp() * 1000 + self.limits.no_audio_s * 1000))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield frame([{"session": key[0], "action": "end", "ended": "no_audio"}])

    def close(self) -> None:
        pass


def stream(observations: DataFrame, at: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """A streaming frame of answers. The RocksDB state store must be set on the session.

    at: a timestamp column with a watermark, by which silent sessions end; without it none does.
    """
    return observations.groupBy("session").transformWithStateInPandas(SessionProcessor(limits, at), OUT, "append", "eventTime" if at else "none")


def rate_limited(requests: DataFrame, by: str, at: str, most: int, kind: str = "long") -> DataFrame:
    """by, at, accepted, retry_after of each request; at in seconds."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        told = limited(pdf[at].tolist(), most)
        return pd.DataFrame({by: pdf[by], at: pdf[at], "accepted": [a for a, _ in told], "retry_after": [r for _, r in told]})

    return requests.select(by, at).groupBy(by).applyInPandas(fold, f"{by} {kind}, {at} double, accepted boolean, retry_after int")


def chunk_plans(files: DataFrame, most: float = 15.0, overlap: float = 3.0) -> DataFrame:
    """file, chunk, start_s, end_s, keep_from_s, keep_to_s. files: file, duration, cuts (array)."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, k, *map(float, c)) for f, d, cuts in zip(pdf["file"], pdf["duration"], pdf["cuts"], strict=True) for k, c in enumerate(plan_chunks(float(d), sorted(cuts), most, overlap))]
            yield pd.DataFrame(rows, columns=["file", "chunk", "start_s", "end_s", "keep_from_s", "keep_to_s"])

    return files.select("file", "duration", "cuts").mapInPandas(plan, "file long, chunk int, start_s double, end_s double, keep_from_s double, keep_to_s double")

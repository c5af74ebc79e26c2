"""Streaming state machines as pure steps: state and observation in, state and answer out. Time is data."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Observation:
    """What one hop's alignment says: the end's key and global number, confidence, diagonals, share of matches, predicted group, time."""

    key: str | None
    place: int | None
    confidence: float
    diagonals: int
    ratio: float
    group: str | None = None
    at_s: float = 0.0
    mode: str = "tail"
    rolling_words: int = 99


@dataclass(frozen=True)
class State:
    committed: str | None = None
    committed_place: int | None = None
    pending: str | None = None
    pending_place: int | None = None
    streak: int = 0
    stable: str | None = None
    group: str | None = None
    group_streak: int = 0
    low: int = 0
    refreshed_s: float = 0.0
    force_refresh: bool = False


#: Least confidence, diagonals and share of matches of each grade of evidence.
STRONG, FAIR, JUMP = (0.65, 10, 0.55), (0.32, 6, 0.40), (0.45, 6, 0.55)
CONFIRM, BACK, LEAP, PRUNE = 2, 2, 8, 20


def reaches(o: Observation, grade: tuple[float, int, float]) -> bool:
    return o.confidence >= grade[0] and o.diagonals >= grade[1] and o.ratio >= grade[2]


def _locked(s: State, o: Observation) -> State:
    """The group counts as stable after two equal predictions, at a confidence that is higher for a change."""
    streak = s.group_streak + 1 if o.group == s.group else 1
    s = replace(s, group=o.group, group_streak=streak)
    needed = 0.10 if s.stable is None else 0.25
    if o.group is not None and o.group != s.stable and streak >= CONFIRM and o.confidence >= needed:
        s = replace(s, stable=o.group)
    return s


def _without_pending(s: State) -> State:
    return replace(s, pending=None, pending_place=None, streak=0)


def _pending(s: State, o: Observation) -> State:
    same = (s.pending, s.pending_place) == (o.key, o.place)
    return replace(s, pending=o.key, pending_place=o.place, streak=s.streak + 1 if same else 1)


def _progress(s: State, o: Observation) -> tuple[State, str, int]:
    """The new state, the action and how many places a commit skips."""
    if o.key is None or o.place is None:
        return _without_pending(s), "hold", 0
    prev = s.committed_place
    delta = None if prev is None else o.place - prev
    if delta is not None and delta < -BACK:
        if not reaches(o, STRONG):
            return _without_pending(s), "ignore_backward", 0
        action, leap = "reset_committed", True
    elif delta is not None and delta <= 0:
        return _without_pending(s), "hold", 0
    else:
        leap = delta is not None and delta >= LEAP
        if not reaches(o, STRONG) or delta is not None:
            s = _pending(s, o)
        confirmed = reaches(o, FAIR) and s.streak >= CONFIRM and (not leap or reaches(o, JUMP))
        if not reaches(o, STRONG) and not confirmed:
            return s, "hold", 0
        action = "commit_skip" if delta is not None and delta > 1 else "commit"
    s = replace(_without_pending(s), committed=o.key, committed_place=o.place)
    if leap and o.group is not None:
        s = replace(s, stable=o.group, group=o.group, group_streak=max(s.group_streak, CONFIRM))
    return s, action, delta - 1 if action == "commit_skip" else 0


def step(s: State, o: Observation, window_s: float = 20.0) -> tuple[State, dict]:
    """One hop: stable group, commit, low-confidence refresh, prune after a jump, and what to tell the user."""
    s = _locked(s, o)
    s, action, skipped = _progress(s, o)
    low = s.low + 1 if o.confidence < 0.22 else 0
    wants = low >= 3
    s = replace(s, low=0 if wants else low)
    pruned = action == "reset_committed" or action == "commit_skip" and skipped >= PRUNE
    due = wants and o.mode != "refresh" and o.at_s >= window_s
    if o.mode == "refresh":
        s = replace(s, refreshed_s=o.at_s, force_refresh=False)
    if pruned:
        s = replace(s, refreshed_s=0.0, force_refresh=True)
    elif due and o.at_s - s.refreshed_s >= 8.0:
        s = replace(s, force_refresh=True)
    stable = s.stable is not None
    told = [
        ("surah_jump" if skipped >= PRUNE else "ayah_skip", action == "commit_skip" and skipped > 0),
        ("reset_detected", action == "reset_committed"),
        ("ignored_backward_guess", action == "ignore_backward"),
        ("jump_pruned", pruned),
        ("refresh_scheduled", due),
        ("full_refresh", o.mode == "refresh"),
        ("need_more_audio", o.rolling_words < 8 and o.confidence < 0.25 and o.at_s >= 4.0),
    ]
    return s, {
        "action": action,
        "committed": s.committed_place,
        "pending": s.pending_place,
        "skipped": skipped,
        "stable": s.stable,
        "ux": ("tracking" if o.confidence >= 0.32 else "uncertain") if stable else "seeking",
        "alerts": ",".join(code for code, on in told if on),
        "pruned": pruned,
    }


def replay(observations: Iterable[Observation], window_s: float = 20.0) -> list[dict]:
    s, out = State(), []
    for o in observations:
        s, told = step(s, o, window_s)
        out.append(told)
    return out


@dataclass
class Config:
    """A session's audio: seconds and bytes. Invalid values become the defaults."""

    window_s: float = 20.0
    hop_s: float = 2.0
    buffer_s: float = 90.0
    least_s: float = 2.0
    rate: int = 16000

    def valid(self) -> Config:
        base = Config()
        c = Config(**{k: v if isinstance(v, (int, float)) and v == v and v > 0 else getattr(base, k) for k, v in asdict(self).items()})
        if c.hop_s >= c.window_s:
            c.hop_s = min(base.hop_s, c.window_s / 2)
        c.buffer_s = max(c.buffer_s, c.window_s)
        return c


@dataclass
class Ring:
    """The last bytes of 16-bit mono audio, and what each hop reads."""

    config: Config = field(default_factory=Config)
    data: bytes = b""
    total: int = 0
    done: int = 0

    def push(self, frame: bytes) -> None:
        if len(frame) % 2:
            raise ValueError("a frame of 16-bit samples has an even length")
        most = int(-(-max(self.config.buffer_s, self.config.window_s) * self.config.rate * 2 // 1))
        self.data = (self.data + frame)[-most:]
        self.total += len(frame)

    def due(self) -> bool:
        """Whether a hop's worth of new bytes has come; one call moves on by exactly one hop."""
        hop, least = (int(x * self.config.rate) * 2 for x in (self.config.hop_s, self.config.least_s))
        if self.total - self.done < hop or self.total < least:
            return False
        self.done += hop
        return True

    def read(self, refresh: bool) -> tuple[float, float, bytes]:
        """Start, end and bytes of the last window, or of a tail of a hop and four seconds."""
        c = self.config
        seconds = c.window_s if refresh else min(max(c.hop_s + 4.0, c.hop_s), c.window_s)
        return self.slice(self.total - int(seconds * c.rate) * 2, self.total)

    def slice(self, start: int, end: int) -> tuple[float, float, bytes]:
        """The bytes from start to end of all that came, as far as they are still held, in whole samples."""
        first = self.total - len(self.data)
        start, end = (min(max(x, first), self.total) // 2 * 2 for x in (start, end))
        per = self.config.rate * 2
        return start / per, end / per, self.data[start - first : end - first]


def drop_near_copies(words: list[tuple[str, float, float]], apart: float = 0.03) -> list[tuple[str, float, float]]:
    """Words in time order without those that repeat the last kept one within so many seconds, whose end they may widen."""
    out: list[tuple[str, float, float]] = []
    for w, a, b in sorted(words, key=lambda x: (x[1], x[2], x[0])):
        if out and out[-1][0] == w and abs(a - out[-1][1]) < apart:
            out[-1] = (w, out[-1][1], max(out[-1][2], b))
        else:
            out.append((w, a, b))
    return out


def upsert(rolling: list[tuple[str, float, float]], new: list[tuple[str, float, float]], start: float, end: float, oldest: float, pad: float = 0.25) -> list[tuple[str, float, float]]:
    """The rolling words with those of a newly read stretch in place of what overlaps it; expired ones go."""
    kept = [x for x in rolling if x[2] >= oldest and not (x[2] >= start - pad and x[1] <= end + pad)]
    return drop_near_copies(kept + new)


def limited(times: Iterable[float], most: int, window: float = 60.0) -> list[tuple[bool, int]]:
    """For each request in time order whether it is accepted, and after how many seconds to try again if not. Only accepted ones count."""
    taken: list[float] = []
    out = []
    for t in times:
        taken = [x for x in taken if x > t - window]
        if len(taken) < most:
            taken.append(t)
            out.append((True, 0))
        else:
            out.append((False, max(int(window) - int(t - taken[0]), 1)))
    return out


def session_end(now: float, started: float, connected: bool, audio_s: float, last_audio: float, silent_s: float, expires: float | None, *, connect_s: float = 30, most_audio_s: float = 3600, grace_s: float = 30, no_audio_s: float = 30, silence_s: float = 60) -> str | None:
    """Why a session ends now: the first of its limits that is passed, or None."""
    limits = (
        ("connect_timeout", not connected and now - started >= connect_s),
        ("max_audio", audio_s >= most_audio_s),
        ("auth_expired", expires is not None and now >= expires + grace_s),
        ("no_audio", connected and now - last_audio >= no_audio_s),
        ("silence", silent_s >= silence_s),
    )
    return next((name for name, hit in limits if hit), None)


def plan_chunks(duration: float, cuts: list[float], most: float = 15.0, overlap: float = 3.0) -> list[tuple[float, float, float, float]]:
    """(start, end, keep_from, keep_to) of chunks of at most so many seconds: cut at the last silence, or overlapping where there is none."""
    overlap = max(0.0, min(overlap, most / 2))
    ends: list[tuple[float, float, bool]] = []
    at = 0.0
    while duration > 0 and at < duration - 0.05:
        quiet = max((c for c in cuts if at + 1 < c <= at + most), default=None)
        hard = at + most < duration and quiet is None
        end = duration if at + most >= duration else at + most if quiet is None else quiet
        ends.append((at, end, hard))
        if end == duration:
            break
        at = end - overlap if hard else end
    if duration > 0 and not ends:
        ends = [(0.0, duration, False)]
    return [(a, b, ends[i - 1][1] - overlap / 2 if i and ends[i - 1][2] else a, b - overlap / 2 if hard else b) for i, (a, b, hard) in enumerate(ends)]

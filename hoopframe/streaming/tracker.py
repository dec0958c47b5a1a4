"""Clock readings of a broadcast as a keyed stream: an opening gate, then a tracker of periods, per game.

One pure step over (state, reading) serves batch and stream alike. Readings of
a game come in order of video time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.columns import clean_ocr_clock, clock_seconds

PERIODS = ["1st", "2nd", "3rd", "4th", "OT", "2OT", "3OT", "4OT"]
OUTPUT = "game_id string, number long, op string, video_time double, period string, clock string, clock_seconds double"


@dataclass(frozen=True)
class Rules:
    """Thresholds, in seconds unless said otherwise. Fixed values."""

    min_confidence: float = 0.4
    regular: float = 600.0
    overtime: float = 300.0
    opening_share: float = 0.9  # of a period, for its first readings
    opening_gap: float = 5.0
    drift: float = 1.5
    confirmations: int = 3
    anchor_readings: int = 2
    anchor_delay: float = 300.0
    near_end: float = 15.0
    max_rise: float = 3.0
    max_fall: float = 15.0
    grace: float = 5.0
    overtime_break: float = 300.0
    rebase_share: float = 0.95
    rebase_readings: int = 10
    rebase_span: float = 30.0
    rebase_gain: float = 10.0
    rebase_gap: float = 300.0
    gapped_time: float = 10.0
    gapped_drop: float = 8.0
    gapped_wait: float = 120.0
    squeezed_span: float = 300.0
    squeezed_share: float = 0.5
    finish_after: float = 900.0


@dataclass
class Track:
    """What a game's tracker remembers; a reading is [video time, seconds, text]."""

    open: bool = False
    finished: bool = False
    period: int = 0
    last: list | None = None
    first: list | None = None  # of the period
    count: int = 0
    before: list | None = None  # period, last, first and count at the end of the period before
    anchor: list | None = None
    anchors: int = 0
    opening: list = field(default_factory=list)
    rebase: list = field(default_factory=list)
    gapped: list = field(default_factory=list)
    digit: list | None = None
    end_at: float | None = None  # video time of the last reading in the final seconds
    number: int = 0  # of rows put out


def _descends(run: list, now: list, gap: float, drift: float) -> bool:
    """Whether now continues a running clock: later by at most gap, lower by no more than the time and drift."""
    time, fall = now[0] - run[-1][0], run[-1][1] - now[1]
    return 0 < time <= gap and 0 < fall <= time + drift


def _length(i: int, r: Rules) -> float:
    return r.regular if i < 4 else r.overtime


def _gate(t: Track, now: list, r: Rules) -> list:
    """Opening gate: a game starts with a short running sequence near the start of the first period."""
    if now[1] < r.regular * r.opening_share:
        t.opening = []
        return []
    if abs(now[1] - r.regular) <= 0.1:
        t.anchor, t.anchors = t.anchor or now, t.anchors + 1
    if t.opening and now[1] == t.opening[-1][1] and 0 < now[0] - t.opening[-1][0] <= r.opening_gap:
        t.opening[-1] = now  # the clock stands still
        return []
    t.opening = [*t.opening, now] if t.opening and _descends(t.opening, now, r.opening_gap, r.drift) else [now] if not t.opening else []
    if len(t.opening) < r.confirmations:
        return []
    t.open, out = True, []
    if t.anchor and t.anchors >= r.anchor_readings and 0 <= now[0] - t.anchor[0] <= r.anchor_delay and t.anchor[2] != now[2]:
        out.append(_take(t, t.anchor))
    t.opening = []
    out.append(_take(t, now))
    return out


def _take(t: Track, now: list, period: int | None = None) -> tuple:
    t.last, t.first, t.count = now, t.first or now, t.count + 1
    return ("append", now, PERIODS[t.period if period is None else period])


def _next_period(t: Track, now: list, r: Rules) -> bool:
    """Whether the reading opens the next period: this one had run down, and enough video has passed."""
    if t.period + 1 >= len(PERIODS) or t.last[1] > r.near_end:
        return False
    length, time = _length(t.period + 1, r), now[0] - t.last[0]
    if not length * r.opening_share <= now[1] <= length + 1 or time + r.grace < t.last[1]:
        return False
    return t.period + 1 < 4 or time <= r.overtime_break


def _may_rebase(t: Track, now: list, r: Rules) -> bool:
    """Whether a rise can be the real start of a period that a short highlight only seemed to open."""
    return bool(
        t.period
        and t.count <= r.rebase_readings
        and 0 <= t.first[1] - t.last[1] <= r.rebase_span
        and now[0] - t.last[0] >= r.rebase_gap
        and now[1] >= _length(t.period, r) * r.rebase_share
        and now[1] - t.first[1] >= r.rebase_gain
    )


def _track(t: Track, now: list, r: Rules) -> list:
    if now[2] == t.last[2]:
        t.gapped = []
        return []
    if now[1] > _length(t.period, r) + 1:
        return []
    digit, t.digit = t.digit, None
    sure = bool(digit) and 0 < digit[1] - now[1] <= r.max_fall
    if _next_period(t, now, r):
        t.before = [t.period, t.last, t.first, t.count]
        t.period, t.first, t.count, t.rebase, t.gapped = t.period + 1, None, 0, [], []
        return [_take(t, now)]
    fall, time = t.last[1] - now[1], now[0] - t.last[0]
    if t.rebase and _descends(t.rebase, now, r.opening_gap, r.grace):
        t.rebase = [*t.rebase, now]
        if len(t.rebase) < r.confirmations:
            return []
        t.rebase, t.first, t.count, t.gapped = [], None, 0, []
        return [_take(t, now)]
    t.rebase = []
    if -fall > r.max_rise:
        t.rebase = [now] if _may_rebase(t, now, r) else []
        return []
    if fall >= 10 and t.last[1] >= 15 and not sure and re.fullmatch(r"\d\.\d", now[2]):
        t.digit = now  # a digit may be missing; the next reading tells
        return []
    held, t.gapped = t.gapped, []
    if held:
        still = now[1] == held[-1][1] and 0 < now[0] - held[-1][0] <= r.gapped_wait
        if still or _descends(held, now, r.gapped_wait, r.drift):
            run = [*held[:-1], now] if still else [*held, now]
            if len(run) < r.confirmations:
                t.gapped = run
                return []
            return [x for x in ([_take(t, h) for h in run] if not _squeezed(t, now, r) else _undo(t)) if x]
    if not sure and time >= r.gapped_time and fall >= r.gapped_drop:
        t.gapped = [now] if fall <= time + r.grace else []
        return []
    if fall > min(r.max_fall, max(0.0, time) + r.grace):
        return []
    return _undo(t) if _squeezed(t, now, r) else [_take(t, now)]


def _squeezed(t: Track, now: list, r: Rules) -> bool:
    """Whether the period's clock has run much faster than the video."""
    if not t.before or not t.first:
        return False
    span = t.first[1] - now[1]
    return span >= r.squeezed_span and now[0] - t.first[0] < span * r.squeezed_share


def _undo(t: Track) -> list:
    """Back to the end of the period before; everything since is retracted."""
    gone = ("retract", t.first, PERIODS[t.period])
    t.period, t.last, t.first, t.count = t.before
    t.before, t.rebase, t.gapped, t.digit = None, [], [], None
    return [gone]


def step(t: Track, now: list, r: Rules) -> list[tuple]:
    """Moves the state by one reading; outputs (op, reading, period): append, or retract of the period from that reading on."""
    if t.finished:
        return []
    if t.end_at is not None and now[0] - t.end_at > r.finish_after:
        t.finished = True
        return []
    out = _track(t, now, r) if t.open else _gate(t, now, r)
    if t.open and t.period >= 3 and t.last[1] <= r.near_end:
        t.end_at = t.last[0]
    elif any(op == "append" for op, _, _ in out):
        t.end_at = None
    return out


def _rows(game: str, track: Track, readings: pd.DataFrame, r: Rules) -> pd.DataFrame:
    out = []
    for now in zip(readings.video_time.tolist(), readings.clock_seconds.tolist(), readings.clock.tolist()):
        for op, at, period in step(track, list(now), r):
            track.number += 1
            out.append((game, track.number, op, at[0], period, at[2], at[1]))
    return pd.DataFrame(out, columns=["game_id", "number", "op", "video_time", "period", "clock", "clock_seconds"], dtype=object)


def clean_readings(readings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Readings (game_id, video_time, text, confidence) with enough confidence and a clock in them."""
    rows = readings.where(F.col("confidence") >= rules.min_confidence).withColumn("clock", clean_ocr_clock("text"))
    return rows.withColumn("clock_seconds", clock_seconds("clock")).where("clock_seconds is not null and game_id is not null").drop("text", "confidence")


def track_batch(readings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Appends and retractions of every game of a table of readings."""
    def one_game(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _rows(key[0], Track(), rows.sort_values("video_time", kind="stable"), rules)

    return clean_readings(readings, rules).groupBy("game_id").applyInPandas(one_game, OUTPUT)


READING = "video_time double, clock_seconds double, clock string"
# The tracker's memory as typed state: scalars in one value, each remembered reading in one of its own, runs as lists.
SCALARS = ("open", "finished", "period", "count", "anchors", "end_at", "number")
MARKS = ("last", "first", "anchor", "digit")
RUNS = ("opening", "rebase", "gapped")
HEAD = "open boolean, finished boolean, period int, count int, anchors int, end_at double, number long"
BEFORE = "period int, count int, " + ", ".join(f"{m}_{f}" for m in ("last", "first") for f in READING.split(", "))


class ClockTracker(StatefulProcessor):
    """The tracker of each game of a stream.

    With an event time, readings wait until the watermark has passed them and
    are taken in order of time, so those that come late by no more than the
    watermark's delay count as if they had come in time. A timer wakes the
    game for its earliest waiting reading, ends it finish_after seconds after
    the last reading in the final seconds, and removes its state once nothing
    has come for twice that time. Without an event time readings are taken as
    they come, sorted within a batch.
    """

    def __init__(self, rules: Rules, timed: bool):
        self.rules, self.timed = rules, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.before = handle.getValueState("before", BEFORE)
        self.marks = {m: handle.getValueState(m, READING) for m in MARKS}
        self.runs = {r: handle.getListState(r, READING) for r in RUNS}
        self.waiting = handle.getListState("waiting", READING + ", at_ms long")
        self.seen = handle.getValueState("seen", "last_ms long, end_ms long")

    def _load(self) -> Track:
        track = Track()
        if self.head.exists():
            for name, value in zip(SCALARS, self.head.get()):
                setattr(track, name, value)
        for name, state in self.marks.items():
            setattr(track, name, list(state.get()) if state.exists() else None)
        for name, state in self.runs.items():
            setattr(track, name, [list(x) for x in state.get()])
        if self.before.exists():
            period, count, *held = self.before.get()
            track.before = [period, held[:3], held[3:], count]
        return track

    def _save(self, track: Track) -> None:
        self.head.update(tuple(getattr(track, name) for name in SCALARS))
        for name, state in self.marks.items():
            mark = getattr(track, name)
            state.update(tuple(mark)) if mark else state.clear()
        for name, state in self.runs.items():
            run = getattr(track, name)
            state.put([tuple(x) for x in run]) if run else state.clear()
        if track.before:
            period, last, first, count = track.before
            self.before.update((period, count, *last, *first))
        else:
            self.before.clear()

    def _clear(self) -> None:
        for state in (self.head, self.before, self.seen, self.waiting, *self.marks.values(), *self.runs.values()):
            state.clear()

    def _advance(self, key: tuple, due: list[tuple]) -> pd.DataFrame:
        """Takes the due readings (video_time, clock_seconds, clock, at_ms) in order."""
        track = self._load()
        rows = pd.DataFrame([r[:3] for r in due], columns=["video_time", "clock_seconds", "clock"])
        out = _rows(key[0], track, rows.sort_values("video_time", kind="stable"), self.rules)
        self._save(track)
        if self.timed and due:
            end = next((at for time, _, _, at in due if time == track.end_at), None)
            held = self.seen.get() if self.seen.exists() else (0, None)
            self.seen.update((max(held[0], *(r[3] for r in due)), None if track.end_at is None else held[1] if end is None else end))
        return out

    def _wake(self, waiting: list[tuple]) -> None:
        """One timer: for the earliest waiting reading, the end of the game, or of its state."""
        wait = int(self.rules.finish_after * 1000)
        last, end = self.seen.get() if self.seen.exists() else (0, None)
        over = self.head.exists() and self.head.get()[1]
        at = [r[3] + 1 for r in waiting]
        if last:
            at.append(last + 2 * wait + 1)
        if end is not None and not over:
            at.append(end + wait + 1)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at:
            self.handle.registerTimer(min(at))

    def _due(self, key: tuple, waiting: list[tuple], now: int) -> pd.DataFrame:
        due, left = [r for r in waiting if r[3] <= now], [r for r in waiting if r[3] > now]
        self.waiting.put(left) if left else self.waiting.clear()
        out = self._advance(key, sorted(due, key=lambda r: (r[3], r[0])))
        self._wake(left)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        readings = list(zip(batch.video_time.tolist(), batch.clock_seconds.tolist(), batch.clock.tolist(), batch.at_ms.tolist()))
        if self.timed:
            yield self._due(key, [*map(tuple, self.waiting.get()), *readings], timerValues.getCurrentWatermarkInMs())
        else:
            yield self._advance(key, readings)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, wait = timerValues.getCurrentWatermarkInMs(), int(self.rules.finish_after * 1000)
        out = self._due(key, [*map(tuple, self.waiting.get())], now)
        last, end = self.seen.get() if self.seen.exists() else (0, None)
        if not self.waiting.exists() and now > last + 2 * wait:
            self._clear()
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        elif end is not None and now > end + wait:
            track = self._load()
            track.finished = True
            self._save(track)
            self._wake([*map(tuple, self.waiting.get())])
        yield out

    def close(self) -> None:
        pass


def track_stream(readings: DataFrame, rules: Rules = Rules(), time: str | None = None, late: str = "1 minute") -> DataFrame:
    """The same over a stream, in append mode, with the state of a game as typed values, lists and a timer.

    time: an event-time column of the readings, which follows their video time
    within a game; see ClockTracker for what it does. Without time, readings
    of a game come in order, and states stay. The session needs the RocksDB
    state store.
    """
    rows = clean_readings(readings, rules)
    if time:
        rows = rows.withWatermark(time, late)
    rows = rows.withColumn("at_ms", F.unix_millis(F.col(time)) if time else F.lit(0).cast("long"))
    processor = ClockTracker(rules, time is not None)
    return rows.groupBy("game_id").transformWithStateInPandas(processor, OUTPUT, "append", "EventTime" if time else "None")


def resolve_retractions(rows: DataFrame) -> DataFrame:
    """Appended rows without those that a later retraction of their period took back: those put out before it, at or after
    its time. Rows of a period that a game appends after the retraction stay."""
    later = Window.partitionBy("game_id", "period").orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, -1)  # a running one
    taken = F.min(F.when(F.col("op") == "retract", F.col("video_time"))).over(later)
    kept = rows.withColumn("_from", taken).where("op = 'append' and (_from is null or video_time < _from)")
    return kept.select("game_id", "video_time", "period", "clock", "clock_seconds")

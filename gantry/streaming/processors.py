"""State of vehicles, segments' accidents and notifications, in event-time order."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from itertools import chain, groupby
from operator import attrgetter

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gantry.functions.time import BASE_EPOCH
from gantry.rules import SegmentRules
from gantry.streaming.source import NOBODY, NOWHERE

# Kinds of rows between the stages.
ENTRY, STOP, MOVE, HEARTBEAT = 0, 1, 2, 3
# Kinds of rows before the notifier, in the order they take effect within one second: an accident
# does not concern those who enter in the second it starts or clears.
STATS, CLEAR, ENTERED, START = 0, 1, 2, 3

EVENTS = (
    "kind int, vid int, t int, speed int, xway int, lane int, dir int, seg int, pos int, "
    "t0 int, wall_ms bigint"
)
EVENT = Row(*(c.split()[0] for c in EVENTS.split(", ")))
# Fields of a report in a window's text.
REPORT = ["t", "speed", "xway", "lane", "dir", "seg", "pos", "wall_ms"]
SIGNALS = "kind int, xway int, dir int, seg int, t int, is_new boolean"
NOTICES = (
    "kind int, vid int, t int, lav int, toll bigint, seg int, pos int, report_wall_ms bigint"
)


def _ms(t: int) -> int:
    return (BASE_EPOCH + t) * 1000


def _numbers(text: str) -> list[int | None]:
    """The numbers of a `packed` column; null where one is empty."""
    return [int(x) if x else None for x in text.split(",")] if text else []


def _ints(values) -> list[int]:
    return [int(x) for x in values]


def _known(wall_ms: int) -> int | None:
    """The time a report was sent; -1 stands for none."""
    return None if wall_ms < 0 else int(wall_ms)


class InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then hands them on by time.

    Rows come as `t` and `packed`, the columns of `layout` in one text, and stay packed until their time has
    come. All rows of a batch are one element of the state: each call to the store, and each value that
    crosses to Python, costs more than the work on a row.
    """

    layout: list[str]  # columns that are kept, all whole numbers, with `t` among them

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.row = namedtuple("Kept", self.layout)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """State of the subclass."""

    def advance(self, key, rows: list[Row]) -> Iterator[Row]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, kept = None, []
        for r in rows:
            kept.append(r.packed)
            first = r.t if first is None else min(first, r.t)
        if kept:
            self.waiting.appendValue(("\n".join(kept),))
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Everything the watermark has passed is complete, whichever timer tells."""
        until = timerValues.getCurrentWatermarkInMs()
        rows = [self.row(*_numbers(line)) for (text,) in self.waiting.get() for line in text.split("\n")]
        ready = [r for r in rows if _ms(r.t) <= until]
        if not ready:
            return
        rest = [r for r in rows if _ms(r.t) > until]
        if rest:
            self.waiting.put([("\n".join(",".join("" if x is None else str(x) for x in r) for r in rest),)])
            self._wake(min(r.t for r in rest), until)
        else:
            self.waiting.clear()
        yield from self.advance(key, sorted(ready, key=self.order))

    def _wake(self, t: int, watermark: int) -> None:
        self.handle.registerTimer(max(_ms(t), watermark) + 1)

    def order(self, row: Row):
        return row.t

    def close(self) -> None:
        pass


class VehicleTracker(StatefulProcessor):
    """Per vehicle: entries into segments, and stops as they begin and end.

    Takes the texts of windows before which no report is missing, a report a line; the next batch goes on from
    there. With a TTL, segments in which the vehicle has been silent for longer leave the state: it would be new
    there anyway. What stays is one row per vehicle, its last report. Where leaving the segment does not end a
    stop, the last report in each segment stays besides. A window of `pace` seconds in which the watermark lies
    is still to come.
    """

    def __init__(self, rules: SegmentRules, pace: float = 60):
        if rules.pair_gap is not None:
            raise ValueError("whether a silence ends a stop is known only when the vehicle has moved on")
        self.rules, self.pace_ms = rules, int(pace * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trace = handle.getValueState(
            "trace", "t int, xway int, dir int, seg int, pos int, n int, lane int, t0 int, seen array<int>"
        )
        self.by_segment = self.rules.stop_scope == "segment"
        if self.by_segment:
            self.places = handle.getValueState("places", "runs string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        vid, windows = key[0], sorted(rows, key=attrgetter("t"))
        if vid == NOBODY:
            for w in windows:
                yield EVENT(HEARTBEAT, vid, w.t, 0, NOWHERE, 0, 0, NOWHERE, 0, None, None)
            return
        *last, seen = self.trace.get() or (None, ())
        last = last if seen else None
        # One read and one write of the state a batch: each call to the store costs more than the rows.
        self.seen = {(x, d, g): t for x, d, g, t in zip(*[iter(map(int, seen))] * 4)}
        self.runs = self._known_runs()
        for w in windows:
            reports = [tuple(map(int, line.split(","))) for line in w.reports.split("\n")] if w.reports else []
            events, last = self._window(vid, sorted(reports), last)
            yield from events
        if last:
            self.seen[self._segment(*last[1:4])] = last[0]
            now = timerValues.getCurrentWatermarkInMs()
            self._forget(self._segment(*last[1:4]), now)
            self._keep(last)
            self._wake(last, now)

    def _known_runs(self) -> dict:
        """The last report in each segment and what it is part of, where stops go on there."""
        text = self.places.get() if self.by_segment else None
        runs = zip(*[iter(_numbers(text[0]))] * 8) if text else ()
        return {self._segment(*r[1:4]): r for r in runs}

    def _keep(self, last) -> None:
        self.trace.update((*last, [x for segment, t in self.seen.items() for x in (*segment, t)]))
        if self.by_segment:
            self.places.update((",".join("" if x is None else str(x) for x in chain(*self.runs.values())),))

    def _window(self, vid, reports: list[tuple], last) -> tuple[list[Row], tuple | None]:
        """Events of a window's reports, in order of time, and the vehicle's trace after them."""
        need, runs = self.rules.stop_reports, self.runs
        events, met, second = [], set(), None
        before, t_before = (self._segment(*last[1:4]), last[0]) if last else (None, None)
        for t, speed, xway, lane, direction, seg, pos, wall_ms in reports:
            if t == second:  # of several reports in a second the least stays
                continue
            second, segment = t, self._segment(xway, direction, seg)
            if self._enters(segment, before, t_before, t):
                events.append(EVENT(ENTRY, vid, t, speed, xway, lane, direction, seg, pos, None, _known(wall_ms)))
            run = runs.get(segment) if self.by_segment else last
            if run and run[4] == pos and (self.by_segment or segment == before):
                n, stop_lane, t0 = run[5] + 1, run[6], run[7]
                if segment in met:  # else a window's first report of the run tells its direction
                    direction = run[2]
            else:
                if run and run[7] is not None:
                    events.append(self._moved(vid, run, t, wall_ms))
                n, stop_lane, t0 = 1, None, None
            if n == need:
                stop_lane, t0 = lane, t
                events.append(EVENT(STOP, vid, t, speed, xway, lane, direction, seg, pos, t0, _known(wall_ms)))
            last = (t, xway, direction, seg, pos, n, stop_lane, t0)
            if self.by_segment:
                runs[segment] = last
            met.add(segment)
            before, t_before = segment, t
        return events, last

    @staticmethod
    def _moved(vid, last, t, wall_ms) -> Row:
        """The end of the stop that `last` tells of."""
        return EVENT(MOVE, vid, t, 0, last[1], last[6], last[2], last[3], last[4], last[7], _known(wall_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        *last, seen = self.trace.get()
        self.seen = {tuple(s): t for *s, t in zip(*[iter(map(int, seen))] * 4)}
        known = len(self.seen)
        self._forget(self._segment(*last[1:4]), now)
        if len(self.seen) < known:
            self.runs = self._known_runs()
            self._keep(last)
        self._wake(last, now)
        return iter(())

    def _forget(self, here, now: int) -> None:
        """Drop segments, but the one where the vehicle is, that are older than the TTL."""
        ttl = self.rules.vehicle_ttl
        if ttl is not None:
            self.seen = {s: t for s, t in self.seen.items() if _ms(t + ttl) + self.pace_ms >= now or s == here}

    def _wake(self, last, now: int) -> None:
        """Look again once reports of the oldest other segment are older than the TTL."""
        if self.rules.vehicle_ttl is None:
            return
        here = self._segment(*last[1:4])
        waiting = [t for segment, t in self.seen.items() if segment != here]
        if waiting:
            self.handle.registerTimer(max(_ms(min(waiting) + self.rules.vehicle_ttl) + self.pace_ms, now) + 1)

    def close(self) -> None:
        pass

    def _segment(self, xway, direction, seg):
        return (xway, direction if self.rules.direction_aware else 0, seg)

    def _enters(self, segment, before, t_before, t) -> bool:
        if self.rules.entry_mode == "crossing":
            return segment != before
        ttl = self.rules.vehicle_ttl
        if segment == before:
            return ttl is not None and t - t_before > ttl
        if before:
            self.seen[before] = t_before
        known = self.seen.get(segment)
        return known is None or (ttl is not None and t - known > ttl)


class AccidentTracker(InOrder):
    """Per segment: from how many vehicles stand at each place to one accident state."""

    layout = ["t", "kind", "lane", "pos"]

    def open(self, handle):
        self.standing = handle.getValueState("standing", "lane array<int>, pos array<int>, n array<int>")

    def advance(self, key, rows):
        out = Row("kind", "xway", "dir", "seg", "t", "is_new")
        xway, direction, seg = key
        # One read and one write of all places where somebody stands.
        standing = {(lane, pos): n for lane, pos, n in zip(*map(_ints, self.standing.get() or ([], [], [])))}
        places = sum(n >= 2 for n in standing.values())
        for t, now in groupby(rows, key=attrgetter("t")):
            had = places
            for r in now:
                if r.kind == HEARTBEAT:
                    yield out(HEARTBEAT, xway, direction, seg, t, None)
                    continue
                place = (r.lane, r.pos)
                n = standing.pop(place, 0)
                m = n + (1 if r.kind == STOP else -1)
                places += (m >= 2) - (n >= 2)
                if m:
                    standing[place] = m
            if (places > 0) != (had > 0):
                yield out(STOP if places else MOVE, xway, direction, seg, t, places > 0)
        lanes, spots = zip(*standing) if standing else ((), ())
        self.standing.update((list(lanes), list(spots), list(standing.values())))


class StaleMinutes(StatefulProcessor):
    """Per segment: the average velocity where a minute leaves the history only when the minute just
    past it has reports.

    Takes a segment's minutes as they close and tells the average as each following minute begins,
    until it can change no more without new reports. Of minutes that will stay for good only sum and
    number are kept, so the state has no more minutes than the history.
    """

    def __init__(self, rules: SegmentRules):
        self.past = rules.lav_minutes + 1
        self.row = Row(*rules.segment_cols, "minute", "lav", "nov")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "kept", "told int, last int, n bigint, total double, count int, minutes array<int>, means array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        for r in sorted(rows, key=attrgetter("minute")):
            yield from self._tell(key, r.minute)
            self._add(r)
        yield from self._until(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Minutes that have begun without reports in the minute before."""
        self._load()
        yield from self._until(key, timerValues.getCurrentWatermarkInMs())

    def _until(self, key, watermark: int) -> Iterator[Row]:
        """Tell what the watermark has reached, in the batch in which other segments' minutes close."""
        yield from self._tell(key, (watermark // 1000 - BASE_EPOCH) // 60 + 1)
        self.state.update((
            self.told, self.last, self.n, self.total, self.count, list(self.kept), list(self.kept.values())))
        if self.told <= self.last + self.past:
            self.handle.registerTimer(_ms(self.told * 60) - 1)

    def _add(self, r: Row) -> None:
        self.kept.pop(r.minute - self.past, None)
        for m in [m for m in self.kept if m + self.past < r.minute]:
            self.total, self.count = self.total + self.kept.pop(m), self.count + 1
        self.kept[r.minute] = r.a
        self.told = self.last = r.minute
        self.n = r.n

    def _tell(self, key, until: int) -> Iterator[Row]:
        if self.last is None:
            return
        for minute in range(self.told + 1, min(until, self.last + self.past + 1) + 1):
            means = [a for m, a in self.kept.items() if m != minute - self.past]
            count = self.count + len(means)
            lav = (self.total + sum(means)) / count if count else 0.0
            yield self.row(*key, minute, lav, self.n if minute == self.last + 1 else 0)
            self.told = minute

    def _load(self) -> None:
        self.told, self.last, self.n, self.total, self.count, minutes, means = (
            self.state.get() if self.state.exists() else (None, None, 0, 0.0, 0, [], []))
        self.kept = {int(m): float(a) for m, a in zip(minutes, means)}

    def close(self) -> None:
        pass


class Notifier(InOrder):
    """Per segment (and share of its vehicles): entries meet the segment's toll and accidents."""

    layout = ["t", "kind", "vid", "lane", "seg", "pos", "wall_ms", "source", "minute", "lav", "toll"]

    def __init__(self, rules: SegmentRules):
        self.rules = rules

    def open(self, handle):
        self.known = handle.getValueState(
            "known", "minute int, lav int, toll bigint, sources array<int>, starts array<int>")

    def order(self, row):
        return row.t, row.kind

    def advance(self, key, rows):
        out = Row("kind", "vid", "t", "lav", "toll", "seg", "pos", "report_wall_ms")
        *stats, sources, starts = self.known.get() or (None, None, None, [], [])
        stats = None if stats[0] is None else stats
        ahead = dict(zip(_ints(sources), _ints(starts)))
        for r in rows:
            if r.kind == STATS:
                stats = (r.minute, r.lav, r.toll)
            elif r.kind == CLEAR:
                ahead.pop(r.source, None)
            elif r.kind == START:
                ahead[r.source] = r.t
            elif r.kind == ENTERED:
                minute = r.t // 60 + 1
                # With stale minutes what was told last holds until something else is told.
                holds = stats and (stats[0] == minute or self.rules.lav_keep_stale)
                _, lav, toll = stats if holds else (minute, 0, 0)
                known = [
                    t0 for t0 in ahead.values()
                    if minute >= t0 // 60 + 1 + self.rules.notice_delay_minutes
                ]
                yield out(0, r.vid, r.t, lav, 0 if known else toll, None, None, r.wall_ms)
                if known and r.lane != self.rules.exit_lane:
                    yield out(1, r.vid, r.t, None, None, r.seg, r.pos, r.wall_ms)
        self.known.update((*(stats or (None, None, None)), list(ahead), list(ahead.values())))

"""The vehicle tracker on texts of windows, without a stream around it."""

from types import SimpleNamespace

from pyspark.sql import Row
from test_streaming import REPORT, table

from gantry import SegmentRules
from gantry.session import scratch_dir
from gantry.streaming import processors as PR
from gantry.streaming import source as SO
from gantry.streaming import stages as SG


class Store:
    """One key's values and timers."""

    def __init__(self):
        self.values, self.timers = {}, []

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.values.get(name), update=lambda v: self.values.update({name: v}))

    def registerTimer(self, ms):
        self.timers.append(ms)


def tracker(**options):
    found, store = PR.VehicleTracker(SegmentRules(**options)), Store()
    found.init(store)
    return found, store


def at(second):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: PR._ms(second))


def window(minute, *reports):
    """Reports (t, seg, pos), and what differs from the defaults, as the text of a minute."""
    lines = []
    for t, seg, pos, *more in reports:
        r = dict(REPORT, t=t, seg=seg, pos=pos, wall_ms=-1, **(more[0] if more else {}))
        lines.append(",".join(str(r[c]) for c in PR.REPORT))
    return Row(vid=1, t=minute * 60 - 1, reports="\n".join(lines))


def told(found, watermark, *windows):
    return [(e.kind, e.t, e.seg, e.t0) for e in found.handleInputRows((1,), iter(windows), at(watermark))]


def test_stop_goes_on_in_later_windows_and_batches():
    found, _ = tracker(stop_reports=3)
    assert told(found, 120, window(2, (70, 0, 5), (60, 0, 5)), window(1, (50, 0, 5), (0, 0, 3))) == [
        (PR.ENTRY, 0, 0, None), (PR.STOP, 70, 0, 70)]
    assert told(found, 180, window(3, (130, 0, 5), (150, 1, 9), (150, 1, 8))) == [
        (PR.ENTRY, 150, 1, None), (PR.MOVE, 150, 0, 70)]


def test_stops_within_a_segment_outlast_leaving_it():
    """One state of the vehicle knows entries and the stops in each segment, over batches."""
    rows = [(0, 0, 5), (20, 1, 9), (40, 0, 5)], [(60, 2, 7), (80, 0, 5), (100, 1, 9)], [(120, 0, 6)]
    found, _ = tracker(stop_reports=3, stop_scope="segment")
    got = [told(found, 60 * k, window(k, *part)) for k, part in enumerate(rows, 1)]
    assert got == [
        [(PR.ENTRY, 0, 0, None), (PR.ENTRY, 20, 1, None)],
        [(PR.ENTRY, 60, 2, None), (PR.STOP, 80, 0, 80)],
        [(PR.MOVE, 120, 0, 80)],
    ]


def test_segments_stay_while_an_open_window_may_need_them():
    """The watermark lies within a window that is still to come: its reports meet what is known."""
    found, store = tracker(vehicle_ttl=120)
    told(found, 239, window(2, (100, 1, 5), (110, 2, 6)), window(3, (170, 2, 7)))
    assert store.timers == [PR._ms(100 + 120 + 60) + 1]
    list(found.handleExpiredTimer((1,), at(279), None))
    assert told(found, 300, window(4, (215, 1, 8), (225, 2, 9))) == []
    list(found.handleExpiredTimer((1,), at(500), None))
    assert len(store.values["trace"][-1]) == 4  # only where the vehicle is


def test_one_pass_over_the_reports(spark):
    """Stops within segments need no second tracker, and a report is a text before it is gathered."""
    path = scratch_dir(spark, "line")
    SO.append_slice(table(spark, [REPORT]), path)
    stream = SO.report_stream(SO.line_stream(spark, path))
    for scope in ("vehicle", "segment"):
        plan = SG.vehicle_events(stream, SegmentRules(stop_scope=scope))._jdf.queryExecution().analyzed().toString()
        assert plan.count("TransformWithState") == plan.count("Aggregate [") == 1
        assert "lambda" not in plan

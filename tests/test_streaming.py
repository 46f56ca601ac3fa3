"""Streams under the options, against the plain fold."""

import time

import model
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_model import traffic

from gantry import SegmentRules
from gantry import sources as IO
from gantry.schema import REPORT_FIELDS
from gantry.session import scratch_dir
from gantry.streaming import processors as PR
from gantry.streaming import sinks as SK
from gantry.streaming import source as SO
from gantry.streaming import stages as SG
from gantry.streaming.job import Job

REPORT = dict(type=0, simulated_time=0, vid=1, speed=50, xway=0, lane=1, dir=0, seg=0, pos=0)


def table(spark, reports):
    return spark.createDataFrame(
        [tuple(r[f] for f in REPORT_FIELDS) for r in reports],
        ", ".join(f"{f} int" for f in REPORT_FIELDS),
    )


class Feed:
    """Reports in slices, closed by heartbeats, and the stages after each other."""

    def __init__(self, spark, reports, rules, edges):
        self.spark, self.rules, self.root = spark, rules, scratch_dir(spark, "feed")
        SO.write_slices(table(spark, reports), f"{self.root}/feed", edges)
        SO.close_feed(spark, f"{self.root}/feed", edges[-1])

    def reports(self):
        return SO.report_stream(SO.line_stream(self.spark, f"{self.root}/feed", 1))

    def through(self, df, name):
        SK.finish(SK.to_files(df, f"{self.root}/{name}", f"{self.root}/checkpoint-{name}"))
        return SO.table_stream(self.spark, f"{self.root}/{name}", df.schema)

    def notices(self):
        events = self.through(SG.vehicle_events(self.reports(), self.rules), "events")
        history = self.through(SG.segment_history(self.reports(), self.rules), "history")
        changes = SG.accident_changes(events, self.rules)
        signals = self.through(SG.scope_signals(changes, self.rules), "signals")
        self.through(SG.notices(events, signals, history, self.rules), "notices")
        return self.spark.read.schema(PR.NOTICES).parquet(f"{self.root}/notices").filter("vid >= 0")


@pytest.mark.parametrize("options", [
    {"entry_mode": "crossing", "direction_aware": True, "stop_reports": 3},
    {"vehicle_ttl": 120, "notice_delay_minutes": 1, "stop_reports": 2, "lav_minutes": 3},
    {"stop_scope": "segment", "stop_reports": 2, "lav_keep_stale": True, "lav_minutes": 1},
    {"stop_scope": "segment", "entry_mode": "crossing", "direction_aware": True, "stop_reports": 2,
     "lav_keep_stale": True, "lav_minutes": 2},
])
def test_notices(spark, options):
    reports = traffic(5)
    rules = SegmentRules(free_nov=0, free_speed=45, join_salts=3, **options)
    last = max(r["simulated_time"] for r in reports) + 1
    got = Feed(spark, reports, rules, [0, 300, 700, last]).notices()
    want = model.notices(reports, rules)
    assert rows(got.drop("report_wall_ms")) == sorted(
        want, key=lambda r: tuple((v is None, v) for v in r)
    )
    assert any(r[0] == 1 for r in want) and any(r[4] for r in want)


def plain_feed(spark, reports, rules):
    """Notices of a feed in six files without any row but reports, and the second they reach."""
    root = scratch_dir(spark, "plain")
    last = max(r["simulated_time"] for r in reports)
    for k in range(6):
        part = [r for r in reports if r["simulated_time"] * 6 // (last + 1) == k]
        SO.append_slice(table(spark, part), f"{root}/feed")
    queries = Job(spark, [f"{root}/feed"], f"{root}/out", rules, files_per_trigger=1).start()
    until = SK.complete_until(queries["notices"])
    got = spark.read.schema(PR.NOTICES).parquet(f"{root}/out/notices").filter("vid >= 0")
    return sorted(map(tuple, got.drop("report_wall_ms").collect()), key=repr), until


@pytest.mark.parametrize("standing", [None, 300])
def test_feed_without_heartbeats(spark, standing):
    """Nobody ever stops, or the only accident is over early: notices keep coming all the same."""
    reports = []
    for vid in range(8):
        for k in range(60):
            t = k * 30 + vid
            pos = 40 * k + vid
            if standing and vid < 2 and t < standing:
                pos = 607
            reports.append(dict(type=0, simulated_time=t, vid=vid, speed=40 + vid, xway=0, lane=1, dir=0,
                                seg=pos // 200, pos=pos))
    rules = SegmentRules(entry_mode="crossing", free_nov=0, free_speed=45)
    got, until = plain_feed(spark, reports, rules)
    want = [n for n in model.notices(reports, rules) if n[2] <= until]
    assert until > 1500 and len(want) > 60
    assert got == sorted(map(tuple, want), key=repr)
    assert any(n[0] == 1 for n in want) == bool(standing)


def test_counts_of_more_batches_than_progress_keeps(spark):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    root = scratch_dir(spark, "counts")
    try:
        for k in range(6):
            SO.append_slice(table(spark, [dict(REPORT, simulated_time=k, type=2 * (k % 2))]), f"{root}/feed")
        stream = SO.report_stream(SO.line_stream(spark, f"{root}/feed", 1))
        counts = SK.count_batches(f"{root}/out", reports=F.lit(True), positions=F.col("type") == 0)
        SK.finish(SK.to_each_batch(stream, counts, f"{root}/checkpoint"))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert rows(spark.read.parquet(f"{root}/out"), "batch", "reports", "positions") == [
        (k, 1, 1 - k % 2) for k in range(6)]


def test_two_reports_in_a_second(spark):
    """The least counts, in batch and stream alike."""
    twice = [dict(REPORT, vid=v, simulated_time=t, seg=s, pos=s) for v, t, s in [(1, 0, 3), (1, 0, 2), (1, 30, 4), (2, 9, 9)]]
    kept = rows(IO.one_per_second(table(spark, twice)), "vid", "simulated_time", "seg")
    assert kept == [(1, 0, 2), (1, 30, 4), (2, 9, 9)]
    root = scratch_dir(spark, "twice")
    SO.append_slice(table(spark, twice), f"{root}/feed")
    SO.close_feed(spark, f"{root}/feed", 100)
    stream = SO.report_stream(SO.line_stream(spark, f"{root}/feed"))
    SK.finish(SK.to_files(SG.vehicle_events(stream), f"{root}/out", f"{root}/checkpoint"))
    events = spark.read.schema(PR.EVENTS).parquet(f"{root}/out").filter(f"kind = {PR.ENTRY}")
    assert rows(events, "vid", "t", "seg") == kept


def test_silent_vehicles_leave_the_state(spark):
    """With a TTL, the store holds the segments of the last minutes only, and entries are the same."""
    reports = [dict(REPORT, vid=v, simulated_time=60 * k + v, seg=k if v < 3 else k % 2, pos=200 * k)
               for v in range(5) for k in range(40)]
    rules, root = SegmentRules(vehicle_ttl=150), scratch_dir(spark, "ttl")
    SO.append_slice(table(spark, [r for r in reports if r["simulated_time"] < 1200]), f"{root}/feed")
    SO.append_slice(table(spark, [r for r in reports if r["simulated_time"] >= 1200]), f"{root}/feed")
    stream = SO.report_stream(SO.line_stream(spark, f"{root}/feed", 1))
    SK.finish(SK.to_files(SG.vehicle_events(stream, rules), f"{root}/out", f"{root}/checkpoint"))
    events = spark.read.schema(PR.EVENTS).parquet(f"{root}/out")
    reach = events.agg(F.max("t")).first()[0]
    want = [r for r in model.entries(reports, rules) if r["simulated_time"] <= reach]
    assert rows(events.filter(f"kind = {PR.ENTRY}"), "t", "vid", "seg") == sorted(
        (r["simulated_time"], r["vid"], r["seg"]) for r in want)
    state = SO.state_of(spark, f"{root}/checkpoint", variable="trace").select("key.vid", "value.seen").collect()
    held = [t for r in state for t in r.seen[3::4]]  # four numbers a segment, the last is the second
    assert held and all(t + 150 >= reach - 120 for t in held)
    assert len(held) < 5 * 8


def test_first_entries_run_no_python(spark):
    """Both queries behind first entries are aggregations in the JVM; the plan of vehicles' stops is not."""
    stream = SO.report_stream(SO.line_stream(spark, scratch_dir_with_a_line(spark)))
    firsts = SG.window_firsts(stream)
    path = scratch_dir(spark, "firsts")
    spark.createDataFrame([], firsts.schema).write.parquet(path)
    for df in (firsts, SG.first_entries(SO.table_stream(spark, path, firsts.schema))):
        text = df._jdf.queryExecution().analyzed().toString()
        assert "Aggregate" in text and "Python" not in text and "TransformWithState" not in text
    assert "TransformWithState" in SG.vehicle_events(stream)._jdf.queryExecution().analyzed().toString()


def scratch_dir_with_a_line(spark):
    path = scratch_dir(spark, "line")
    SO.append_slice(table(spark, [REPORT]), path)
    return path


def test_first_entries_over_batches(spark):
    """Out of order within the delay, and met again in later batches: each vehicle and segment once."""
    reports, root = traffic(4, vehicles=7), scratch_dir(spark, "first_entries")
    late = [r for r in reports if r["simulated_time"] in range(570, 600) and r["vid"] % 2]
    for part in ([r for r in reports if r["simulated_time"] < 600 and r not in late],
                 [r for r in reports if r["simulated_time"] >= 600 or r in late]):
        SO.append_slice(table(spark, part), f"{root}/feed")
    SO.close_feed(spark, f"{root}/feed", 100_000)
    for _ in range(2):  # ended after each slice, and started again
        stream = SO.report_stream(SO.line_stream(spark, f"{root}/feed", 1))
        firsts = SG.window_firsts(stream)
        SK.finish(SK.to_files(firsts, f"{root}/firsts", f"{root}/checkpoint-firsts"))
        found = SG.first_entries(SO.table_stream(spark, f"{root}/firsts", firsts.schema))
        SK.finish(SK.to_each_batch(
            found, SK.append_batches(f"{root}/entries", "parquet"), f"{root}/checkpoint-entries", mode="update"))
    entries = spark.read.schema(found.schema).parquet(f"{root}/entries")
    want = model.entries([r for r in reports if r["vid"] >= 0], SegmentRules())
    assert rows(entries, "t", "vid", "seg") == sorted((r["simulated_time"], r["vid"], r["seg"]) for r in want)


def test_late_reports_are_counted_and_change_their_minute(spark):
    root, listener = scratch_dir(spark, "late"), SK.LateReports()
    on_time = [dict(REPORT, vid=v, simulated_time=20 * k, speed=50, pos=k) for v in (1, 2) for k in range(40)]
    late = [dict(REPORT, vid=3, simulated_time=t, speed=20, pos=t) for t in (5, 15, 70)]
    for part in (on_time, [], late):
        SO.append_slice(table(spark, part or [dict(REPORT, vid=-1, xway=-1, seg=-1, simulated_time=5000)]), f"{root}/feed")
    stream = SO.report_stream(SO.line_stream(spark, f"{root}/feed", 1)).filter("vid >= -1")
    spark.streams.addListener(listener)
    try:
        query = SK.finish(SK.to_files(SG.with_minute(SG.vehicle_minutes(stream)), f"{root}/out", f"{root}/checkpoint"))
        changes = SG.late_vehicle_minutes(stream)
        kept = SK.finish(SK.to_each_batch(
            changes, SK.append_batches(f"{root}/changes", "parquet"), f"{root}/checkpoint-changes", mode="update"))
        for _ in range(100):
            if listener.dropped.get(str(query.id)) and str(kept.id) in listener.dropped:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.dropped[str(query.id)] == 3 - 1  # two of one vehicle, minute and batch are one group
    assert listener.dropped[str(kept.id)] == 0
    assert spark.read.parquet(f"{root}/out").filter("vid = 3").count() == 0
    stored = spark.read.schema("xway int, seg int, minute int, vid int, v double, batch int").parquet(f"{root}/changes")
    assert rows(SG.latest_minutes(stored).filter("xway >= 0 and minute <= 2"), "minute", "a", "n") == [(1, 40.0, 3), (2, 40.0, 3)]


def test_disorder_within_the_delay(spark):
    """Reports up to a minute late arrive after newer ones and still count in their place."""
    reports, rules = traffic(9, vehicles=6), SegmentRules(entry_mode="crossing")
    root = scratch_dir(spark, "disorder")
    early = [r for r in reports if r["simulated_time"] < 600 and (
        r["simulated_time"] < 560 or r["vid"] % 2)]
    late = [r for r in reports if r not in early]
    for part in (early, late):
        SO.append_slice(table(spark, part), f"{root}/feed")
    SO.close_feed(spark, f"{root}/feed", 10_000)
    stream = SO.report_stream(SO.line_stream(spark, f"{root}/feed", 1))
    SK.finish(SK.to_files(SG.vehicle_events(stream, rules), f"{root}/out", f"{root}/checkpoint"))
    events = spark.read.schema(PR.EVENTS).parquet(f"{root}/out")
    got = rows(events.filter(f"kind = {PR.ENTRY}"), "t", "vid", "seg")
    assert got == sorted((r["simulated_time"], r["vid"], r["seg"]) for r in model.entries(reports, rules))
    got = rows(events.filter(f"kind = {PR.STOP}"), "t", "vid", "lane", "pos")
    assert got == sorted((s[4], s[0], s[2], s[3]) for s in model.stops(reports, rules))


def test_unsupported_options_are_refused():
    with pytest.raises(ValueError):
        PR.VehicleTracker(SegmentRules(pair_gap=30))
    with pytest.raises(ValueError):
        SegmentRules(entry_mode="any")


def test_statistics_count_one_report_per_second(spark):
    """Batch and stream take the same of two reports in a second, also where these lie in two segments."""
    from gantry.operators import stats as ST
    from gantry.sources import one_per_second

    reports = [dict(REPORT, vid=v, simulated_time=10 * k, speed=30 + (7 * k + 3 * v + 11 * copy) % 20, pos=k, seg=k // 5 + copy * (k % 2))
               for v in (1, 2, 3) for k in range(30) for copy in (0, 1)]
    root = scratch_dir(spark, "ties")
    for part in (reports[::2] + reports[1::2], [dict(REPORT, vid=-1, xway=-1, seg=-1, simulated_time=5000)]):
        SO.append_slice(table(spark, part), f"{root}/feed")
    stream = SO.report_stream(SO.line_stream(spark, f"{root}/feed", 1))
    SK.finish(SK.to_files(SG.with_minute(SG.minute_stats(stream)), f"{root}/out", f"{root}/checkpoint"))
    got = spark.read.schema("xway int, seg int, a double, n bigint, minute int").parquet(f"{root}/out")
    want = ST.segment_minutes(one_per_second(table(spark, reports)))
    columns = ("xway", "seg", "minute", "a", "n")
    assert rows(got, *columns) == rows(want, *columns) and len(rows(want)) > 10


def test_a_batch_waits_as_one_element(spark):
    """Rows of a key cross to Python packed and wait in one element a batch, not in one each."""
    root = scratch_dir(spark, "packed")
    stops = [(PR.STOP, v, 60 * v, 0, 0, 1, 0, 3, 700, 60 * v, None) for v in range(1, 6)]
    spark.createDataFrame(stops, PR.EVENTS).coalesce(1).write.parquet(f"{root}/events")
    changes = SG.accident_changes(SO.table_stream(spark, f"{root}/events", spark.read.parquet(f"{root}/events").schema))
    query = SK.finish(SK.to_files(changes, f"{root}/out", f"{root}/checkpoint"))
    assert query.recentProgress[0].stateOperators[0].numRowsUpdated == 1
    out = spark.read.schema(PR.SIGNALS).parquet(f"{root}/out")
    assert rows(out, "seg", "t", "is_new") == [(3, 120, True)]  # the fifth vehicle's second is not complete


def test_many_short_lists_are_not_sorted(spark):
    """Streams start with room for many groups a task; the session's other jobs keep their own setting."""
    name, value = SK.MANY_GROUPS
    before = spark.conf.get(name)
    root = scratch_dir(spark, "groups")
    SO.append_slice(table(spark, [REPORT]), f"{root}/feed", files=3)
    assert spark.read.format("binaryFile").load(f"{root}/feed").filter("length > 0").count() == 3
    query = SK.to_files(SG.vehicle_events(SO.report_stream(SO.line_stream(spark, f"{root}/feed"))), f"{root}/out", f"{root}/cp")
    assert spark.conf.get(name) == before != value
    SK.finish(query)
    with SK._many_groups(spark):
        assert spark.conf.get(name) == value
    assert spark.conf.get(name) == before

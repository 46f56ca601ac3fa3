"""Statistics whose reports wait in lists of several vehicles."""

import pytest
from conftest import rows
from test_streaming import REPORT, table

from gantry import SegmentRules
from gantry.operators import stats as OS
from gantry.session import scratch_dir
from gantry.sources import one_per_second
from gantry.streaming import sinks as SK
from gantry.streaming import source as SO
from gantry.streaming import stages as SG


def reports_of(vehicles, minutes):
    """Vehicles that change segment and direction within a minute and report some seconds twice."""
    return [dict(REPORT, vid=v, simulated_time=20 * k, speed=30 + (7 * k + 3 * v + 11 * copy) % 20, pos=k,
                 seg=(k + v + copy * (k % 2)) // 2 % 3, dir=(k + copy) % 2)
            for v in range(vehicles) for k in range(3 * minutes) for copy in (0, 1)]


@pytest.mark.parametrize("options", [{}, {"direction_aware": True}])
def test_vehicles_wait_in_one_list(spark, monkeypatch, options):
    """Minutes of a dozen vehicles in three lists: the batch's statistics, and three rows of state a minute."""
    monkeypatch.setattr(SG, "BLOCKS", 3)
    rules, reports, root = SegmentRules(**options), reports_of(12, 8), scratch_dir(spark, "blocks")
    for part in (reports[::2], reports[1::2]):  # a second's two reports come in different batches
        SO.append_slice(table(spark, part).filter("simulated_time < 60"), f"{root}/feed")
    SO.append_slice(table(spark, reports).filter("simulated_time >= 60"), f"{root}/feed")
    SO.close_feed(spark, f"{root}/feed", 5000)
    stream = SO.report_stream(SO.line_stream(spark, f"{root}/feed", 1))
    found = SG.with_minute(SG.minute_stats(stream, rules))
    query = SK.finish(SK.to_files(found, f"{root}/out", f"{root}/checkpoint"))
    want = OS.segment_minutes(one_per_second(table(spark, reports)), rules)
    columns = (*rules.segment_cols, "minute", "a", "n")
    got = spark.read.schema(found.schema).parquet(f"{root}/out").filter("xway >= 0")
    assert rows(got, *columns) == rows(want, *columns) and len(rows(want)) > 15
    taken = [p.stateOperators[-1].numRowsUpdated for p in query.recentProgress]
    assert taken[0] == taken[1] == 3 and taken[2] == 7 * 3


def test_late_changes_tell_single_vehicles(spark):
    """Where each change is told, a late report of one vehicle does not tell the others anew."""
    root = scratch_dir(spark, "late_single")
    late = dict(REPORT, vid=3, simulated_time=5, speed=20)
    for part in ([dict(REPORT, vid=v, simulated_time=20 * k) for v in range(9) for k in range(9)], [late]):
        SO.append_slice(table(spark, part), f"{root}/feed")
    changes = SG.late_vehicle_minutes(SO.report_stream(SO.line_stream(spark, f"{root}/feed", 1)))
    SK.finish(SK.to_each_batch(
        changes, SK.append_batches(f"{root}/changes", "parquet"), f"{root}/checkpoint", mode="update"))
    stored = spark.read.schema("xway int, seg int, minute int, vid int, v double, batch int").parquet(f"{root}/changes")
    assert rows(stored.filter("batch = 1"), "minute", "vid") == [(1, 3)]

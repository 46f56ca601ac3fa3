import pytest
from conftest import rows

from gantry import SegmentRules
from gantry.operators import stats as ST


def at(t, vid, speed, seg=3):
    return (t, vid, seg, seg * 5280, {"speed": speed})


def test_vehicle_speed_moves_halfway_from_the_first_report(make):
    pos = make([at(0, 1, 10), at(20, 1, 20), at(40, 1, 40), at(5, 2, 30), at(50, 2, 40)])
    assert rows(ST.vehicle_minute_speed(pos), "vid", "v") == [(1, 30.0), (2, 35.0)]


def test_minutes_start_at_one(make):
    pos = make([at(0, 1, 10), at(59, 2, 10), at(60, 3, 10)])
    assert rows(ST.segment_minutes(pos), "minute", "n") == [(1, 2), (2, 1)]


def test_lav_covers_four_minutes_and_nov_one(make):
    pos = make([at(m * 60, m, 10 * (m + 1)) for m in range(6)])
    assert rows(ST.segment_stats(pos), "minute", "lav", "nov") == [
        (1, 0.0, 0), (2, 10.0, 1), (3, 15.0, 1), (4, 20.0, 1), (5, 25.0, 1), (6, 35.0, 1),
    ]


def test_minutes_after_a_gap(make):
    pos = make([at(0, 1, 10), at(360, 1, 50)])
    assert rows(ST.segment_stats(pos), "minute", "lav", "nov") == [(1, 0.0, 0), (7, 0.0, 0)]
    kept = ST.segment_stats(pos, SegmentRules(lav_keep_stale=True))
    assert rows(kept, "minute", "lav") == [(1, 0.0), (7, 10.0)]


def test_a_stale_minute_goes_when_the_minute_past_its_history_reports(make):
    pos = make([at(0, 1, 10), at(60, 1, 20), at(300, 1, 30), at(480, 1, 40)])
    kept = ST.segment_stats(pos, SegmentRules(lav_keep_stale=True))
    assert rows(kept, "minute", "lav") == [(1, 0.0), (2, 10.0), (6, 20.0), (9, 25.0)]


@pytest.mark.parametrize("lav,nov,toll", [
    (39.99, 51, 2), (40.0, 51, 0), (39.99, 50, 0), (0.0, 60, 200), (10.0, 150, 20000),
])
def test_toll(spark, lav, nov, toll):
    stats = spark.createDataFrame(
        [(0, 0, 1, lav, nov)], "xway int, seg int, minute int, lav double, nov bigint"
    )
    assert rows(ST.segment_toll(stats), "lav", "toll") == [(int(lav), toll)]


def test_toll_of_a_congested_segment(make):
    slow = [at(v % 60, v, 20) for v in range(53)] + [at(60, 99, 20)]
    toll = ST.segment_toll(ST.segment_stats(make(slow)))
    assert rows(toll, "minute", "lav", "nov", "toll") == [(1, 0, 0, 0), (2, 20, 53, 18)]


def test_direction_splits_segments(make):
    pos = make([(0, 1, 3, 1, {"dir": 0}), (1, 2, 3, 1, {"dir": 1})])
    by_dir = ST.segment_minutes(pos, SegmentRules(direction_aware=True))
    assert rows(by_dir, "dir", "n") == [(0, 1), (1, 1)]
    assert rows(ST.segment_minutes(pos), "n") == [(2,)]

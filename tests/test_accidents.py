from conftest import rows, stand

from gantry import SegmentRules
from gantry.operators import accidents as A
from gantry.operators import trace as TR
from gantry.plans.notify import Pipeline


def test_four_identical_reports_are_no_stop(make):
    pos = make(stand(1, 2, 500, 0, 4) + [(120, 1, 2, 600)])
    assert rows(A.stop_intervals(pos)) == []
    assert rows(TR.same_position_runs(pos), "n") == [(1,), (4,)]


def test_five_are_one_from_the_fifth_to_the_move(make):
    pos = make(stand(1, 2, 500, 0, 6) + [(180, 1, 3, 900)])
    assert rows(A.stop_intervals(pos), "vid", "seg", "pos", "t0", "t1") == [(1, 2, 500, 120, 180)]
    assert rows(A.stopped_vehicles(pos), "t0", "n") == [(120, 6)]


def test_a_stop_without_a_later_report_stays_open(make):
    assert rows(A.stop_intervals(make(stand(1, 2, 500, 0, 5))), "t0", "t1") == [(120, None)]


def test_a_stop_across_pieces_of_the_trace(make):
    trace = stand(1, 2, 500, 40, 7) + [(400, 1, 2, 600)] + stand(1, 2, 500, 500, 5)
    for seconds in (30, 50, 60, 100, 121, 1800):
        rules = SegmentRules(chunk_seconds=seconds)
        assert rows(A.stop_intervals(make(trace), rules), "t0", "t1") == [(160, 400), (620, None)]
        assert rows(TR.same_position_runs(make(trace), rules), "n", "t_first", "t_last") == [
            (1, 400, 400), (5, 500, 620), (7, 40, 220)
        ]


def accident(make, reports, rules=SegmentRules()):
    return Pipeline(make(reports), rules)


def test_two_at_one_place_crash_at_the_later_stop(make):
    p = accident(make, stand(1, 2, 500, 0, 8) + stand(2, 2, 500, 15, 8) + [(260, 2, 2, 700)])
    assert rows(p.segment_accidents, "seg", "t0", "t1") == [(2, 135, 260)]


def test_another_lane_is_no_accident(make):
    p = accident(make, stand(1, 2, 500, 0, 8) + stand(2, 2, 500, 15, 8, lane=2))
    assert rows(p.segment_accidents) == []


def test_leaving_for_another_segment_ends_it(make):
    gone = [(260, 2, 3, 900)]
    reports = stand(1, 2, 500, 0, 10) + stand(2, 2, 500, 15, 8) + gone
    assert rows(accident(make, reports).segment_accidents, "t0", "t1") == [(135, 260)]
    stays = accident(make, reports, SegmentRules(stop_scope="segment"))
    assert rows(stays.segment_accidents, "t0", "t1") == [(135, None)]


def test_of_three_one_may_leave(make):
    three = stand(1, 2, 500, 0, 20) + stand(2, 2, 500, 10, 8) + stand(3, 2, 500, 20, 20)
    p = accident(make, three + [(250, 2, 2, 700)])
    assert rows(p.segment_accidents, "t0", "t1") == [(130, None)]
    sizes = A.accident_sizes(p.accident_vehicles)
    assert rows(sizes, "t0", "involved") == [(130, 3)]


def test_one_place_clears_while_another_does_not(make):
    first = stand(1, 2, 500, 0, 8) + stand(2, 2, 500, 0, 8) + [(240, 1, 2, 700)]
    second = stand(3, 2, 900, 60, 10) + stand(4, 2, 900, 60, 10) + [(360, 3, 2, 950)]
    p = accident(make, first + second)
    assert rows(p.accidents_by_position, "pos", "t0", "t1") == [(500, 120, 240), (900, 180, 360)]
    assert rows(p.segment_accidents, "t0", "t1") == [(120, 360)]


def test_scope_ends_at_segment_zero(make):
    p = accident(make, stand(1, 2, 500, 0, 5) + stand(2, 2, 500, 0, 5))
    assert rows(p.scope, "seg") == [(0,), (1,), (2,)]
    assert rows(p.signals, "seg", "t", "is_new") == [(s, 120, True) for s in (0, 1, 2)]


def test_scope_lies_ahead_in_the_other_direction(make):
    two = stand(1, 2, 500, 0, 5, dir=1) + stand(2, 2, 500, 0, 5, dir=1)
    p = accident(make, two, SegmentRules(direction_aware=True))
    assert rows(p.scope, "seg") == [(s,) for s in (2, 3, 4, 5, 6)]


def test_a_silent_vehicle_pairs_only_within_the_gap(make):
    reports = stand(1, 2, 500, 0, 5) + stand(2, 2, 500, 200, 5)
    assert len(rows(accident(make, reports).segment_accidents)) == 1
    assert rows(accident(make, reports, SegmentRules(pair_gap=60)).segment_accidents) == []
    near = accident(make, reports, SegmentRules(pair_gap=200))
    assert rows(near.segment_accidents, "t0", "t1") == [(320, 321)]


def test_further_reports_of_the_involved(make):
    p = accident(make, stand(1, 2, 500, 0, 8) + stand(2, 2, 500, 15, 6) + [(200, 2, 2, 700)])
    again = A.accident_resignals(p.positions, p.accident_vehicles)
    assert rows(again, "vid", "simulated_time") == [(1, 150), (1, 180), (2, 165)]


def test_vehicles_of_accidents_far_apart_in_time(make):
    long = stand(1, 2, 500, 0, 100)
    short = [r for k in range(3) for r in stand(2 + k, 2, 500, k * 900, 8)]
    moves = [(k * 900 + 240, 2 + k, 2, 700) for k in range(3)]
    p = accident(make, long + short + moves)
    got = rows(p.accident_vehicles, "t0", "t1", "vid")
    assert got == [(t, t + 120, v) for k, t in enumerate((120, 1020, 1920)) for v in (1, 2 + k)]


def test_timeline_knows_a_clearance_only_once_it_happened(make):
    crash = stand(1, 0, 500, 0, 8) + stand(2, 0, 500, 0, 8) + [(230, 1, 0, 700)]
    p = accident(make, crash + [(60 * m, 9, 0, m) for m in range(6)])
    line = A.accident_timeline(p.stats, p.scope)
    assert rows(line, "minute", "acc_start", "acc_clear", "has_accident") == [
        (1, -1, A.NO_CLEAR, False), (2, -1, A.NO_CLEAR, False), (3, 120, A.NO_CLEAR, False),
        (4, 120, A.NO_CLEAR, True), (5, 120, 230, False), (6, 120, 230, False),
    ]

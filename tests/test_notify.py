from conftest import rows, stand

from gantry import SegmentRules
from gantry.operators import entries as E
from gantry.operators.asof import asof_join
from gantry.operators.joins import salted_join, state_upsert
from gantry.plans.notify import Pipeline

# An accident in segment 2 from 120 to 240.
CRASH = stand(1, 2, 500, 0, 8) + stand(2, 2, 500, 0, 8) + [(240, 1, 2, 700)]


def accident_notices(make, reports, **options):
    p = Pipeline(make(CRASH + reports), SegmentRules(**options))
    return rows(p.accident_notifications, "vid", "t", "seg", "pos")


def test_entries_in_scope_are_warned(make):
    found = [(t, 10 + i, 1, 5280 + i) for i, t in enumerate((120, 121, 239, 240))]
    assert accident_notices(make, found) == [(11, 121, 1, 5281), (12, 239, 1, 5282)]


def test_not_those_about_to_leave_or_past_it(make):
    found = [(150, 10, 1, 1, {"lane": 4}), (150, 11, 3, 1), (150, 12, 1, 1, {"xway": 1})]
    assert accident_notices(make, found) == []


def test_lasting_accidents_warn(make):
    lasting = stand(3, 9, 800, 0, 5) + stand(4, 9, 800, 0, 5)
    assert accident_notices(make, lasting + [(900, 10, 6, 1)]) == [(10, 900, 6, 1)]


def test_notice_may_wait_for_the_next_minute(make):
    found = [(150, 10, 1, 1), (185, 11, 1, 2)]
    assert [n[0] for n in accident_notices(make, found)] == [10, 11]
    assert [n[0] for n in accident_notices(make, found, notice_delay_minutes=1)] == [11]


def test_toll_is_waived_in_scope_even_on_the_exit_lane(make):
    slow = [(60 + v % 60, 100 + v, 1, v, {"speed": 20}) for v in range(60)]
    at = [(125, 10, 1, 1, {"lane": 4}), (125, 11, 1, 2), (120, 12, 1, 3)]
    p = Pipeline(make(CRASH + slow + at))
    tolls = {r["vid"]: (r["lav"], r["toll"]) for r in p.toll_notifications.collect()}
    assert [tolls[v] for v in (10, 11, 12)] == [(20, 0), (20, 0), (20, 200)]


def test_first_sight_and_crossing(make):
    trip = [(0, 1, 1, 1), (30, 1, 1, 2), (60, 1, 2, 3), (90, 1, 1, 4)]
    first = Pipeline(make(trip)).entries
    assert rows(first, "simulated_time", "seg") == [(0, 1), (60, 2)]
    for seconds in (30, 45, 1800):
        crossing = SegmentRules(entry_mode="crossing", chunk_seconds=seconds)
        found = Pipeline(make(trip), crossing).entries
        assert rows(found, "simulated_time", "seg", "pos") == [(0, 1, 1), (60, 2, 3), (90, 1, 4)]


def test_a_silent_vehicle_is_new_again(make):
    trip = [(0, 1, 1, 1), (60, 1, 1, 2), (121, 1, 1, 3), (181, 1, 1, 4)]
    for seconds in (50, 1800):
        rules = SegmentRules(vehicle_ttl=60, chunk_seconds=seconds)
        assert rows(Pipeline(make(trip), rules).entries, "simulated_time") == [(0,), (121,)]


def test_retained_vehicles(make):
    pos = make([(0, 1, 1, 1), (50, 2, 1, 1), (100, 3, 1, 1), (0, 1, 5, 1)])
    assert rows(E.vehicles_retained(pos, 50), "seg", "vid") == [(1, 2), (1, 3), (5, 1)]


def test_upsert(spark):
    state = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    batch = spark.createDataFrame([(2, 21), (3, 30)], "k int, v int")
    assert rows(state_upsert(state, batch, ["k"])) == [(1, 10), (2, 21), (3, 30)]


def test_asof_ties(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, 7, "d")],
                                 "k int, t int, x string")
    right = spark.createDataFrame([(1, 5, 50), (1, 6, None), (1, 9, 90)], "k int, t int, v int")
    at = asof_join(left, right, ["k"], "t", ["v"])
    assert rows(at, "x", "v") == [("a", 50), ("b", None), ("c", None), ("d", None)]
    before = asof_join(left, right, ["k"], "t", ["v"], allow_exact=False)
    assert rows(before.filter("x = 'a'"), "v") == [(None,)]


def test_salted_join_keeps_every_row(spark):
    left = spark.range(1000).selectExpr("1 as k", "id as vid")
    right = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    out = salted_join(left, right, ["k"], "vid")
    assert out.count() == 1000 and out.filter("v = 5").count() == 1000

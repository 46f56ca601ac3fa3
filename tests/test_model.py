"""Random traffic: the jobs against the plain fold, under every option and any way to cut the work."""

import random

import pytest
from conftest import rows

import model
from gantry import SegmentRules
from gantry.operators import accidents as A
from gantry.plans.notify import Pipeline
from gantry.schema import REPORT_FIELDS


def traffic(seed, vehicles=20, reports=60):
    """Vehicles that stop at few places, for long, and sometimes jump."""
    rnd = random.Random(seed)
    out = []
    for vid in range(vehicles):
        t, xway, seg, pos, lane = rnd.randrange(60), rnd.randrange(2), rnd.randrange(6), 0, 1
        for _ in range(reports):
            if rnd.random() < 0.25:
                seg, pos = rnd.randrange(7), rnd.randrange(2)
                lane = rnd.choice([1, 1, 1, 4])
            if rnd.random() < 0.02:
                xway = rnd.randrange(2)
            out.append(dict(type=0, simulated_time=t, vid=vid, speed=rnd.randrange(60), xway=xway,
                            lane=lane, dir=vid % 2, seg=seg, pos=pos))
            t += rnd.choice([10, 20, 20, 30, 200 if rnd.random() < 0.1 else 20])
    for vid in range(100, 160):  # visitors, seen once
        out.append(dict(type=0, simulated_time=rnd.randrange(1400), vid=vid, speed=40,
                        xway=rnd.randrange(2), lane=rnd.choice([1, 4]), dir=vid % 2,
                        seg=rnd.randrange(7), pos=2))
    return out


OPTIONS = [
    {},
    {"entry_mode": "crossing"},
    {"direction_aware": True, "entry_mode": "crossing"},
    {"stop_scope": "segment"},
    {"pair_gap": 30, "stop_reports": 3},
    {"vehicle_ttl": 120, "lav_keep_stale": True},
    {"notice_delay_minutes": 1, "entry_mode": "crossing", "stop_reports": 2},
    {"upstream": 1, "exit_lane": 1, "lav_minutes": 2, "toll_factor": 3},
]


@pytest.mark.parametrize("i", range(len(OPTIONS)))
def test_notifications(spark, i):
    reports = traffic(i)
    cut = dict(chunk_seconds=[60, 97, 1800, 40][i % 4], vehicle_salts=1 + i % 3, join_salts=1 + i % 4)
    rules = SegmentRules(free_nov=0, free_speed=45, **cut, **OPTIONS[i])
    df = spark.createDataFrame(
        [tuple(r[f] for f in REPORT_FIELDS) for r in reports],
        ", ".join(f"{f} int" for f in REPORT_FIELDS),
    )
    p = Pipeline(df, rules)
    n = len(rules.segment_cols)

    want = sorted((v, *s, lane, pos, t0, t1) for v, s, lane, pos, t0, t1 in model.stops(reports, rules))
    got = [(*r[:-1], model.OPEN if r[-1] is None else r[-1]) for r in rows(p.stops)]
    assert sorted(got) == want and want

    got = {(tuple(r[:n]), r[n]): (r[n + 1], r[n + 2]) for r in rows(p.stats)}
    want = model.stats(reports, rules)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()})

    got = sorted((tuple(r[:n]), r[n], model.OPEN if r[-1] is None else r[-1]) for r in rows(p.scope))
    assert got == sorted(model.scope(reports, rules)) and got

    key = lambda r: tuple((v is None, v) for v in r)
    want = sorted(model.notices(reports, rules), key=key)
    assert rows(p.notifications) == want
    assert any(r[0] == 1 for r in want) and any(r[4] for r in want)


@pytest.mark.parametrize("seconds", [20, 33, 60, 500, 100000])
def test_pieces_change_nothing(spark, seconds):
    reports = traffic(77)
    df = spark.createDataFrame(
        [tuple(r[f] for f in REPORT_FIELDS) for r in reports],
        ", ".join(f"{f} int" for f in REPORT_FIELDS),
    )
    rules = SegmentRules(chunk_seconds=seconds, entry_mode="crossing")
    p = Pipeline(df, rules)
    want = sorted((v, *s, lane, pos, t0, t1) for v, s, lane, pos, t0, t1 in model.stops(reports, rules))
    got = [(*r[:-1], model.OPEN if r[-1] is None else r[-1]) for r in rows(A.stop_intervals(df, rules))]
    assert sorted(got) == want
    want = sorted((r["simulated_time"], r["vid"]) for r in model.entries(reports, rules))
    assert rows(p.entries, "simulated_time", "vid") == want

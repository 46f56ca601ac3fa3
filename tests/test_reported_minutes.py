"""The minutes with reports as the history tells them."""

import pytest
from conftest import SF, rows
from test_model import traffic
from test_streaming import table

from gantry import SegmentRules
from gantry.plans import streams as ST
from gantry.session import scratch_dir
from gantry.streaming import sinks as SK
from gantry.streaming import source as SO
from gantry.streaming import stages as SG


@pytest.mark.parametrize("stale", [False, True])
def test_minutes_follow_from_the_history(spark, stale):
    reports = [r for r in traffic(6, vehicles=4) if r["simulated_time"] // 60 % 7 not in (2, 3)]
    rules, root = SegmentRules(lav_keep_stale=stale, lav_minutes=2), scratch_dir(spark, "reported")
    SO.append_slice(table(spark, reports), f"{root}/feed")
    SO.close_feed(spark, f"{root}/feed", 100_000)
    stream = SO.report_stream(SO.line_stream(spark, f"{root}/feed", 1))
    history = SG.segment_history(stream, rules)
    SK.finish(SK.to_files(history, f"{root}/out", f"{root}/checkpoint"))
    told = spark.read.schema(history.schema).parquet(f"{root}/out").filter("xway >= 0")
    want = {(r["xway"], r["seg"], r["simulated_time"] // 60 + 1) for r in reports if r["type"] == 0}
    assert rows(SG.reported_minutes(told, rules), "xway", "seg", "minute") == sorted(want)


def test_served_statistics_gather_the_reports_once(spark, monkeypatch):
    replay = ST.Replay(spark, SF)
    monkeypatch.setattr(ST, "replay", lambda *_: replay)
    assert ST._segment_stats(spark, SF).count() > 0
    assert "history" in replay.__dict__ and "minutes" not in replay.__dict__

"""The command line, and the four queries running side by side."""

import model
import pytest
from conftest import rows
from test_model import traffic
from test_streaming import table

from gantry import SegmentRules
from gantry import sources as IO
from gantry.__main__ import main
from gantry.session import scratch_dir
from gantry.streaming import processors as PR
from gantry.streaming import source as SO
from gantry.streaming.job import Job

REPORTS = traffic(3, vehicles=8)
RULES = SegmentRules(entry_mode="crossing")


def by_kind(notices, kind):
    return sorted((n[1], n[2], *(n[3:5] if kind == 0 else n[5:7])) for n in notices if n[0] == kind)


def test_batch_command(spark):
    root = scratch_dir(spark, "batch")
    df = table(spark, REPORTS)
    IO.to_wire(df).write.text(f"{root}/wire")
    IO.to_raw_lines(df).write.text(f"{root}/raw")
    df.write.parquet(f"{root}/parquet")
    want = model.notices(REPORTS, RULES)
    for fmt in ("wire", "raw", "parquet"):
        out = f"{root}/out-{fmt}"
        main(["--crossing", "batch", out, f"{root}/{fmt}", "--format", fmt])
        wall = ", report_wall_ms bigint" if fmt == "wire" else ""
        tolls = spark.read.schema(f"kind int, vid int, t int, lav int, toll int{wall}").csv(f"{out}/tolls")
        assert rows(tolls, "vid", "t", "lav", "toll") == by_kind(want, 0)
        found = spark.read.schema(f"kind int, vid int, t int, seg int, pos int{wall}").csv(f"{out}/accidents")
        assert rows(found, "vid", "t", "seg", "pos") == by_kind(want, 1)


def test_running_queries(spark):
    root = scratch_dir(spark, "job")
    feeds = [f"{root}/even", f"{root}/odd"]
    halves = [table(spark, [r for r in REPORTS if r["vid"] % 2 == i]) for i in (0, 1)]
    last = max(r["simulated_time"] for r in REPORTS) + 1
    for half, feed in zip(halves, feeds):
        SO.write_slices(half, feed, [0, 400])
    queries = Job(spark, feeds, f"{root}/out", RULES, trigger="100 milliseconds").start()
    try:
        for q in queries.values():
            q.processAllAvailable()
        for half, feed in zip(halves, feeds):
            SO.write_slices(half, feed, [400, last])
        SO.close_feed(spark, feeds[0], last)
        for q in queries.values():
            q.processAllAvailable()
    finally:
        for q in queries.values():
            q.stop()
    got = spark.read.schema(PR.NOTICES).parquet(f"{root}/out/notices").filter("vid >= 0")
    assert rows(got, "kind", "vid", "t", "lav", "toll", "seg", "pos") == sorted(
        model.notices(REPORTS, RULES), key=lambda r: tuple((v is None, v) for v in r)
    )


def test_once(spark):
    root = scratch_dir(spark, "once")
    SO.write_slices(table(spark, REPORTS), f"{root}/feed", [0, 10_000])
    SO.close_feed(spark, f"{root}/feed", 10_000)
    main(["--crossing", "stream", f"{root}/out", f"{root}/feed", "--once"])
    got = spark.read.parquet(f"{root}/out/notices").filter("vid >= 0")
    assert got.count() == len(model.notices(REPORTS, RULES))
    with pytest.raises(ValueError):
        main(["stream", f"{root}/out", f"{root}/feed", "--once"])


def test_bad_lines_are_kept(spark, capsys):
    root = scratch_dir(spark, "bad")
    IO.to_wire(table(spark, REPORTS)).unionByName(
        spark.createDataFrame([("0,1,2",), ("not a report",)], "value string")).write.text(f"{root}/wire")
    spark.createDataFrame([("0,5,7,55,1,2,0,33,174500",), ("xx,5,3,4",)], "value string").write.text(f"{root}/raw")
    main(["batch", f"{root}/out", f"{root}/wire"])
    main(["batch", f"{root}/out-raw", f"{root}/raw", "--format", "raw"])
    assert rows(spark.read.text(f"{root}/out/quarantine")) == [("0,1,2",), ("not a report",)]
    assert rows(spark.read.text(f"{root}/out-raw/quarantine")) == [("xx,5,3,4",)]
    assert "2 lines are not reports" in capsys.readouterr().out
    main(["stream", f"{root}/stream", f"{root}/wire", "--once"])
    assert rows(spark.read.text(f"{root}/stream/quarantine")) == [("0,1,2",), ("not a report",)]
    assert "complete up to second" in capsys.readouterr().out

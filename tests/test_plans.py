"""What the physical plans may and may not contain."""

import re

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from gantry import SegmentRules
from gantry.operators import stats as ST
from gantry.operators import trace as TR
from gantry.plans.notify import Pipeline
from gantry.plans.queries import batch_queries, pipeline

QUERIES = batch_queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "notifications", "notifications_crossing", "accident_vehicles", "accident_resignals",
    "accident_timeline", "asof_toll", "asof_stats", "vehicles_retained",
])
def test_no_pairs_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SinglePartition"):
        assert bad not in text


@pytest.mark.parametrize("name", ["asof_toll", "asof_stats", "accident_timeline"])
def test_histories_are_split_by_time(spark, name):
    """Rows meet by segment and piece of time; by segment alone only a row per piece or change."""
    text = plan(QUERIES[name](spark, SF))
    assert re.search(r"Window \[last\(_v#[^\n]*\], \[xway#\d+, seg#\d+, _piece#", text)
    assert not re.search(r"Window \[last\(_v#[^\n]*\], \[xway#\d+, seg#\d+\],", text)


def test_traces_are_split_by_time(spark):
    p = pipeline(spark, SF)
    text = plan(TR.same_position_runs(p.positions))
    assert re.search(r"hashpartitioning\(vid#\d+, chunk#\d+", text)
    assert re.search(r"hashpartitioning\(vid#\d+, zone#\d+", text)
    assert not re.search(r"hashpartitioning\(vid#\d+, \d+\)", text)


def test_statistics_shuffle_reports_once(spark, tmp_path):
    path = str(tmp_path / "reports")
    pipeline(spark, SF).reports.write.parquet(path)
    pos = Pipeline(spark.read.parquet(path), SegmentRules()).positions
    text = plan(ST.segment_stats(pos))
    assert text.count("Exchange hashpartitioning") == 2
    assert re.search(r"hashpartitioning\(xway#\d+, seg#\d+, minute#\d+, salt#\d+", text)
    assert "EqualTo(type,0)" in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert sorted(c.split(":")[0] for c in read.split(",")) == [
        "seg", "simulated_time", "speed", "type", "vid", "xway"
    ]


def test_new_vehicles_aggregate_without_sorting(spark):
    text = plan(pipeline(spark, SF).entries)
    assert "SortAggregate" not in text and "Window" not in text


def test_involved_vehicles_are_broadcast_while_small(spark):
    text = plan(QUERIES["accident_resignals"](spark, SF))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("rules", [SegmentRules(), SegmentRules(entry_mode="crossing"), SegmentRules(direction_aware=True)])
def test_all_stages_share_a_scan_and_a_shuffle(spark, tmp_path, rules):
    path = str(tmp_path / "reports")
    pipeline(spark, SF).reports.write.parquet(path)
    df = Pipeline(spark.read.parquet(path), rules).notifications
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert text.count("FileScan") == 1 and "EqualTo(type,0)" in text
    dealt = re.findall(r"(?:(ReusedExchange)[^\n]*, )?Exchange hashpartitioning\(vid#\d+, _chunk#\d+", text)
    assert len(dealt) == 3 and dealt.count("") == 1
    # Further exchanges by vehicle carry first reports and runs at the edges of pieces only.
    assert not re.search(r"Exchange hashpartitioning\(vid#\d+, chunk#", text)


def test_tolls_are_looked_up_by_minute(spark):
    text = plan(QUERIES["asof_toll"](spark, SF))
    assert "_span" in text and not re.search(r"hashpartitioning\(xway#\d+, seg#\d+, simulated_time#", text)


def test_state_table_rewrites_touched_blocks_only(spark, tmp_path):
    from gantry.operators.joins import StateTable

    state = StateTable(spark, str(tmp_path / "state"), ["xway", "seg", "vid"], F.col("seg") % 4)
    schema = "xway int, seg int, vid int, t int"

    def put(version, *found):
        state.update(spark.createDataFrame([(0, s, v, t) for s, v, t in found], schema), version)

    def files():
        return {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet")}

    put(0, (0, 1, 10), (1, 1, 20), (5, 2, 25))
    before = files()
    put(1, (1, 1, 30), (2, 9, 30))
    new = files() - before
    assert before <= files() and {p.split("/")[2] for p in new} == {"block=1", "block=2"}
    shape = spark.createDataFrame([], schema).schema
    want = [(0, 0, 1, 10), (0, 1, 1, 30), (0, 2, 9, 30), (0, 5, 2, 25)]
    assert rows(state.read(shape)) == want
    put(1, (1, 1, 30), (2, 9, 30))  # the batch is repeated
    assert rows(state.read(shape)) == want
    assert rows(state.read(shape, before=1)) == [(0, 0, 1, 10), (0, 1, 1, 20), (0, 5, 2, 25)]
    assert rows(state.read(shape, {3})) == []


def test_bucketed_reports_are_not_shuffled(spark, tmp_path):
    from gantry.operators.positions import write_bucketed

    stored = write_bucketed(pipeline(spark, SF).positions, "bucketed_reports", str(tmp_path / "b"), 4)
    text = plan(ST.segment_stats(stored))
    assert not re.search(r"Exchange[^\n]*(vid|piece)#", text) and "Bucketed: true" in text
    # What is shuffled are sums: a row per segment, minute and task.
    assert len(re.findall(r"Exchange hashpartitioning\(xway#\d+, seg#\d+", text)) == text.count("Exchange") == 2
    spark.sql("drop table bucketed_reports")

"""What a stream's stores and lists may hold in memory."""

from conftest import rows
from test_streaming import REPORT, table

from gantry.session import scratch_dir
from gantry.streaming import sinks as SK
from gantry.streaming import source as SO
from gantry.streaming import stages as SG
from gantry.streaming.job import Job


def test_a_commit_writes_out_what_the_store_has_buffered(spark):
    """A store stays open between batches: after a commit its rows lie in files, not in buffers of its own."""
    root = scratch_dir(spark, "flushed")
    for t in (0, 60, 120):
        SO.append_slice(table(spark, [dict(REPORT, vid=v, simulated_time=t + v) for v in range(9)]), f"{root}/feed")
    SO.close_feed(spark, f"{root}/feed", 180)
    firsts = SG.window_firsts(SO.report_stream(SO.line_stream(spark, f"{root}/feed", 1)))
    query = SK.finish(SK.to_files(firsts, f"{root}/out", f"{root}/checkpoint"))
    stores = [p.stateOperators[0] for p in query.recentProgress]
    assert [s.numRowsUpdated for s in stores][:3] == [9, 9, 9]
    assert all(s.customMetrics["rocksdbSstFileSize"] > 0 for s in stores[:3])
    found = spark.read.parquet(f"{root}/out").filter(f"vid <> {SO.NOBODY}")
    assert rows(found, "t", "vid") == [(t + v, v) for t in (0, 60, 120) for v in range(9)]


def test_stores_of_an_executor_share_their_memory(spark):
    """However many stores are open, buffers and caches together have one bound while a query starts."""
    name = "spark.sql.streaming.stateStore.rocksdb."
    with SK._many_groups(spark):
        assert spark.conf.get(f"{name}boundedMemoryUsage") == "true"
        shared = float(spark.conf.get(f"{name}maxMemoryUsageMB")) * float(spark.conf.get(f"{name}writeBufferCacheRatio"))
        # Three stores each of eight tasks do not reach the point where every write flushes.
        assert 8 * 3 * float(spark.conf.get(f"{name}writeBufferSizeMB")) < shared * 7 / 8
    assert spark.conf.get(f"{name}boundedMemoryUsage", None) is None


def test_long_lists_go_to_disk(spark, monkeypatch):
    """Lists of several vehicles' reports are sorted once a task has met some; the others are kept as before."""
    root = scratch_dir(spark, "long")
    SO.append_slice(table(spark, [REPORT]), f"{root}/feed")
    started, to_files = {}, SK.to_files

    def recorded(df, path, *rest, **more):
        query = to_files(df, path, *rest, **more)
        started[path.rsplit("/", 1)[1]] = more.get("groups", SK.MANY_GROUPS)
        return query

    monkeypatch.setattr(SK, "to_files", recorded)
    Job(spark, [f"{root}/feed"], f"{root}/out").start()
    others = dict.fromkeys(["quarantine", "events", "signals", "notices"], SK.MANY_GROUPS)
    assert started == others | {"history": SK.LONG_LISTS}
    name, value = SK.LONG_LISTS
    with SK._many_groups(spark, SK.LONG_LISTS):
        assert name == SK.MANY_GROUPS[0] and int(spark.conf.get(name)) == int(value) < int(SK.MANY_GROUPS[1])

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gantry import sources as IO
from gantry.operators import positions as P
from gantry.schema import REPORT_FIELDS
from gantry.session import scratch_dir

GOOD = "0,1700000000000,7,55,1,2,0,33,174500,120,0,0,0,0,0,0"


def text(spark, *lines):
    return spark.createDataFrame([(v,) for v in lines], "value string")


def test_wire_lines(spark):
    lines = text(
        spark, GOOD, "  " + GOOD + " ", "", "   ", "0,1,2", GOOD.replace("55", "fast"),
        GOOD.rsplit(",", 6)[0], GOOD.replace("33", ""), GOOD.replace("33", "99999999999"),
        GOOD.replace(",33,", ",3 3,"),
    )
    assert IO.parse_wire(lines).count() == 3
    bad = [r[0] for r in rows(IO.quarantine(lines))]
    assert len(bad) == 5 and "" not in bad
    one = IO.parse_wire(text(spark, GOOD)).first()
    assert (one.simulated_time, one.wall_ms, one.pos) == (120, 1700000000000, 174500)


def test_wire_round_trip(make):
    pos = make([(3, 1, 2, 4), (9, 2, 3, 5, {"speed": 7, "dir": 1})])
    back = IO.parse_wire(IO.to_wire(pos, 500))
    assert rows(back, *REPORT_FIELDS) == rows(pos, *REPORT_FIELDS)
    assert rows(back, "wall_ms") == [(3500,), (9500,)]


def test_raw_files(spark):
    path = scratch_dir(spark, "raw")
    text(spark, "0,5,7,55,1,2,0,33,174500,0,0,0,0,0,0", "0,6,7", "", "0,x,8,1",
         "xx,5,3,4", "2,9, 4,fast,,1,0,12,5,34,1,600,9,8,7").write.text(path)
    got = rows(IO.read_raw(spark, path), "time", "vid", "speed", "seg", "day")
    assert got == [(5, 7, 55, 33, 0), (6, 7, 0, 0, 0), (9, 4, 0, 12, 7)]
    assert rows(IO.quarantine_raw(spark.read.text(path))) == [("0,x,8,1",), ("xx,5,3,4",)]
    wire = IO.to_wire(IO.raw_to_reports(IO.read_raw(spark, path)), 0)
    assert "2,9000,4,0,0,1,0,12,5,9,34,1,600,9,8,7" in {r[0] for r in rows(wire)}


def test_sources_are_joined(spark, make):
    root = scratch_dir(spark, "sources")
    for name, t in (("a", 1), ("b", 2), ("c", 2)):
        IO.to_wire(make([(t, 1, 1, 1)])).write.text(f"{root}/{name}")
    assert IO.read_sources(spark, [f"{root}/{n}" for n in "abc"]).count() == 3


def test_one_report_per_second(make):
    twice = make([(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (1, 2, 1, 1)])
    assert IO.one_per_second(twice).count() == 3


def test_csv_notices(spark):
    path = scratch_dir(spark, "csv")
    notices = spark.createDataFrame([(0, 1, 2)], "kind int, vid int, t int")
    IO.notice_csv(notices, path)
    IO.notice_csv(notices, path)
    assert IO.read_notice_csv(spark, path, notices.schema).count() == 1
    IO.notice_csv(notices, path, append=True)
    assert IO.read_notice_csv(spark, path, notices.schema).count() == 2


def test_segment_layout(spark, make):
    pos = make([(0, v, v, v, {"xway": v % 3}) for v in range(20)])
    path = scratch_dir(spark, "blocks")
    P.write_by_block(pos, path, 4)
    back = spark.read.parquet(path)
    assert rows(back, *REPORT_FIELDS) == rows(pos, *REPORT_FIELDS)
    assert {r.block for r in back.select("block").distinct().collect()} == {0, 1, 2, 3}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scratch_dir(Session(), "x")


def test_lines_are_made_and_split_once(spark):
    """However many fields and conditions read them; a plan that repeats the text for each does so per line."""
    lines = spark.range(3).select(F.concat_ws(",", *[F.col("id")] * 15).alias("value"))
    for read in (IO.parse_wire, IO.quarantine, IO.parse_raw, IO.quarantine_raw):
        plan = read(lines)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1 and plan.count("concat_ws(") == 1

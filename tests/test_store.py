"""What a stream's store writes, and which lines are reports."""

from conftest import rows
from test_streaming import REPORT, table

from gantry import sources as IO
from gantry.session import scratch_dir
from gantry.streaming import sinks as SK
from gantry.streaming import source as SO
from gantry.streaming import stages as SG


def test_a_batch_commits_its_changes(spark):
    """The store writes a log of changes, the session's other queries keep their own settings, and the state
    can be read."""
    before = [spark.conf.get(name, None) for name, _ in SK.STORE]
    root = scratch_dir(spark, "store")
    SO.append_slice(table(spark, [dict(REPORT, vid=v, simulated_time=v) for v in range(9)]), f"{root}/feed")
    firsts = SG.window_firsts(SO.report_stream(SO.line_stream(spark, f"{root}/feed")))
    SK.finish(SK.to_files(firsts, f"{root}/out", f"{root}/checkpoint"))
    logs = spark.read.format("binaryFile").option("pathGlobFilter", "*.changelog").option("recursiveFileLookup", "true")
    assert logs.load(f"{root}/checkpoint/state").count() > 0
    assert [spark.conf.get(name, None) for name, _ in SK.STORE] == before != [value for _, value in SK.STORE]
    assert rows(SO.state_of(spark, f"{root}/checkpoint").select("key.vid")) == [(v,) for v in range(9)]


def test_lines_that_look_like_reports(spark):
    """Numbers are taken whole: signs, blanks, more fields and line ends as the parser always read them."""
    ten = ["0", "-7", "+5"] + ["1"] * 7
    lines = {
        ",".join(ten): True, " " + ",".join(ten) + " ": True, ",".join(ten) + ",": True, ",".join(ten) + ",x,1.5": True,
        ",".join(ten) + "\r": True, ",".join(ten[:9]): False, ",".join(ten) + "x": False, ",".join(ten) + ",a\rb": False,
        ",".join(["0", "1 "] + ["1"] * 8): False, ",".join(["0", "1.0"] + ["1"] * 8): False,
        ",".join(["0", "--1"] + ["1"] * 8): False, ",".join(["0", ""] + ["1"] * 8): False,
        ",".join(["0", "1"] + ["99999999999"] + ["1"] * 7): False,
    }
    given = spark.createDataFrame([(x,) for x in lines], "value string")
    assert IO.parse_wire(given).count() == sum(lines.values())
    assert {r.value for r in IO.quarantine(given).collect()} == {x for x, ok in lines.items() if not ok}

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from gantry import schema as S
from gantry.session import get_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Position reports from (t, vid, seg, pos) and what differs from the defaults."""

    def build(rows):
        full = []
        for row in rows:
            t, vid, seg, pos, *rest = row
            more = rest[0] if rest else {}
            r = dict(type=0, simulated_time=t, vid=vid, speed=50, xway=0, lane=1, dir=0, seg=seg, pos=pos)
            full.append(tuple({**r, **more}[f] for f in S.REPORT_FIELDS))
        return spark.createDataFrame(full, ", ".join(f"{f} int" for f in S.REPORT_FIELDS))

    return build


def stand(vid, seg, pos, start, n, step=30, **more):
    """n identical reports, `step` seconds apart."""
    return [(start + i * step, vid, seg, pos, more) for i in range(n)]


def rows(df, *cols):
    return sorted(
        (tuple(r) for r in (df.select(*cols) if cols else df).collect()),
        key=lambda r: tuple((v is None, v) for v in r),
    )

"""Reading, parsing and writing of reports and results."""

from gantry.sources.fixture import reports_from_star
from gantry.sources.reports import (
    one_per_second, parse_raw, parse_wire, quarantine, quarantine_raw, raw_to_reports, read_raw, read_sources, read_wire,
    to_raw_lines, to_wire, union_sources,
)
from gantry.sources.sinks import notice_csv, read_notice_csv, tap

__all__ = [
    "notice_csv", "one_per_second", "parse_raw", "parse_wire", "quarantine", "quarantine_raw", "raw_to_reports", "read_notice_csv",
    "read_raw", "read_sources", "read_wire", "reports_from_star", "tap", "to_raw_lines", "to_wire",
    "union_sources",
]

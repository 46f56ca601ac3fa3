"""The whole streaming pipeline as four running queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gantry.rules import DEFAULT_RULES, SegmentRules
from gantry.sources.reports import quarantine, union_sources
from gantry.streaming import sinks as SK
from gantry.streaming import source as SO
from gantry.streaming import stages as SG


@dataclass
class Job:
    """Stages write their tables below `out`: events, history, signals, notices, and the lines that
    are not reports to quarantine; checkpoints go below `out`/checkpoints. Started again on the same
    folders it goes on, with the same rules only: they are part of what the state means."""

    spark: SparkSession
    sources: list[str]
    out: str
    rules: SegmentRules = DEFAULT_RULES
    trigger: str | None = None  # None: take what is there and end
    delay: str = SG.DELAY
    files_per_trigger: int | None = 1000

    def _lines(self) -> list[DataFrame]:
        return [SO.line_stream(self.spark, s, self.files_per_trigger) for s in self.sources]

    def _reports(self) -> DataFrame:
        return SO.report_stream(self._lines())

    def _same_rules(self) -> None:
        """Keep the rules beside the checkpoints; refuse others than those of an earlier start."""
        path, now = f"{self.out}/checkpoints/rules", repr(self.rules)
        try:
            known = self.spark.read.schema("value string").text(path).first()
        except AnalysisException:
            known = None
        if known is None:
            self.spark.createDataFrame([(now,)], "value string").write.mode("overwrite").text(path)
        elif known.value != now:
            raise ValueError(f"{self.out} was started with {known.value}")

    def _start(
        self, df: DataFrame, name: str, groups: tuple[str, str] = SK.MANY_GROUPS
    ) -> tuple[StreamingQuery, DataFrame]:
        """The query that writes a stage's table, and the stream of what it writes."""
        path = f"{self.out}/{name}"
        query = SK.to_files(df, path, f"{self.out}/checkpoints/{name}", trigger=self.trigger, groups=groups)
        if self.trigger is None:
            SK.finish(query)
        return query, SO.table_stream(self.spark, path, df.schema)

    def start(self) -> dict[str, StreamingQuery]:
        self._same_rules()
        bad = quarantine(union_sources(self._lines()))
        bad_query = SK.to_files(
            bad, f"{self.out}/quarantine", f"{self.out}/checkpoints/quarantine", "text", self.trigger
        )
        if self.trigger is None:
            SK.finish(bad_query)
        events_query, events = self._start(
            SG.vehicle_events(self._reports(), self.rules, self.delay), "events"
        )
        history_query, history = self._start(
            SG.segment_history(self._reports(), self.rules, self.delay), "history", SK.LONG_LISTS
        )
        changes = SG.accident_changes(events, self.rules)
        signals_query, signals = self._start(SG.scope_signals(changes, self.rules), "signals")
        notices = SG.notices(events, signals, history, self.rules)
        notices_query, _ = self._start(SK.stamped(notices), "notices")
        return {
            "events": events_query, "history": history_query, "signals": signals_query,
            "notices": notices_query, "quarantine": bad_query,
        }

"""Registered streaming queries: the reports replayed as files, results read back from the sinks."""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry import sources as IO
from gantry.plans.queries import WALL_BASE_MS, Query
from gantry.rules import SegmentRules
from gantry.schema import REPORT_FIELDS
from gantry.session import scratch_dir
from gantry.streaming import processors as PR
from gantry.streaming import sinks as SK
from gantry.streaming import source as SO
from gantry.streaming import stages as SG

# Time slices of the replay; the first and the last are open.
EDGES = [None, 2400, 4800, None]
# The second at which the feed of the query that reads stops from the state breaks off.
BREAK = 1880
# Seconds of silence after which a vehicle is new again, in the query that has such a limit.
TTL = 600

SIGNAL_COLS = f"{PR.SIGNALS}, source int"
MINUTE_COLS = "xway int, seg int, a double, n bigint, minute int"
HISTORY_COLS = "xway int, seg int, minute int, lav double, nov bigint, toll bigint"
NOTICE_COLS = f"{PR.NOTICES}, emit_wall_ms bigint"


class Replay:
    """One replay of a table's reports; each stage runs when its result is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.root = scratch_dir(spark, "replay")

    @cached_property
    def reports(self) -> DataFrame:
        return IO.tap(IO.reports_from_star(self.spark, self.sf_dir), f"{self.root}/reports")

    @cached_property
    def feed(self) -> str:
        path = f"{self.root}/feed"
        SO.write_slices(self.reports, path, EDGES, self.files, WALL_BASE_MS)
        SO.close_feed(self.spark, path, self.end, files=self.files)
        return path

    @cached_property
    def files(self) -> int:
        """Files of each slice: at least one per core, and more where there are many rows."""
        slices = len(EDGES) - 1
        return SO.files_for(-(-self.reports.count() // slices), least=self.spark.sparkContext.defaultParallelism)

    @cached_property
    def end(self) -> int:
        """One past the last second with a report."""
        return (self.reports.agg(F.max("simulated_time")).first()[0] or 0) + 1

    def report_stream(self, path: str | None = None) -> DataFrame:
        return SO.report_stream(SO.line_stream(self.spark, path or self.feed, self.files))

    def run(self, df: DataFrame, name: str, fmt: str = "parquet", groups: tuple[str, str] = SK.MANY_GROUPS):
        return SK.finish(SK.to_files(
            df, f"{self.root}/{name}", f"{self.root}/checkpoints/{name}", fmt, groups=groups
        ))

    def table(self, name: str, columns: str, fmt: str = "parquet") -> DataFrame:
        return self.spark.read.schema(columns).format(fmt).load(f"{self.root}/{name}")

    def tail(self, name: str, columns: str) -> DataFrame:
        schema = self.spark.createDataFrame([], columns).schema
        return SO.table_stream(self.spark, f"{self.root}/{name}", schema)

    @cached_property
    def events(self) -> DataFrame:
        self.run(SG.vehicle_events(self.report_stream()), "events")
        return self.table("events", PR.EVENTS)

    @cached_property
    def entries(self) -> DataFrame:
        """First entries by the JVM's state alone: complete minutes, then who was not seen before."""
        firsts = SG.window_firsts(self.report_stream())
        self.run(firsts, "firsts")
        found = SG.first_entries(SO.table_stream(self.spark, f"{self.root}/firsts", firsts.schema))
        path = f"{self.root}/entries"
        SK.finish(SK.to_each_batch(
            found, SK.append_batches(path, "parquet"), f"{self.root}/checkpoints/entries", mode="update"))
        return self.spark.read.schema(found.schema).parquet(path)

    @cached_property
    def minutes(self) -> DataFrame:
        self.run(SG.with_minute(SG.minute_stats(self.report_stream())), "minutes")
        return self.table("minutes", MINUTE_COLS).filter("xway >= 0")

    @cached_property
    def history(self) -> DataFrame:
        self.run(SG.segment_history(self.report_stream()), "history", groups=SK.LONG_LISTS)
        return self.table("history", HISTORY_COLS).filter("xway >= 0")

    @cached_property
    def signals(self) -> DataFrame:
        self.events
        changes = SG.accident_changes(self.tail("events", PR.EVENTS))
        self.run(SG.scope_signals(changes), "signals")
        return self.table("signals", SIGNAL_COLS).filter("xway >= 0")

    @cached_property
    def notices(self) -> DataFrame:
        self.events, self.signals, self.history
        found = SG.notices(
            self.tail("events", PR.EVENTS), self.tail("signals", SIGNAL_COLS),
            self.tail("history", HISTORY_COLS),
        )
        self.run(SK.stamped(found), "notices")
        return self.table("notices", NOTICE_COLS).filter("vid >= 0")


@lru_cache(maxsize=8)
def _replay(application: str, spark: SparkSession, sf_dir: str, state: str) -> Replay:
    return Replay(spark, sf_dir)


def replay(spark: SparkSession, sf_dir: str) -> Replay:
    """The queries of one application share a replay while the table's files stay as they are."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/lineitem.parquet")
    state = files.agg(F.max("modificationTime"), F.sum("length"), F.count(F.lit(1))).first()
    return _replay(spark.sparkContext.applicationId, spark, sf_dir, str(state))


def _entry_rows(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("kind") == PR.ENTRY)
        .withColumnRenamed("t", "simulated_time")
        .select("vid", "simulated_time", "speed", "xway", "lane", "dir", "seg", "pos")
    )


def _file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and requests come from one folder each."""
    r = replay(spark, sf_dir)
    root = scratch_dir(spark, "sources")
    positions = F.col("type") == 0
    IO.to_wire(r.reports.filter(positions)).write.text(f"{root}/positions")
    IO.to_wire(r.reports.filter(~positions)).write.text(f"{root}/requests")
    lines = [SO.line_stream(spark, f"{root}/{s}") for s in ("positions", "requests")]
    read = SO.report_stream(lines).select(*REPORT_FIELDS)
    SK.finish(SK.to_files(read, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.schema(read.schema).parquet(f"{root}/out")


def _fixed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slice of the feed per batch, each batch with its number."""
    r = replay(spark, sf_dir)
    root = scratch_dir(spark, "rate")
    real = r.report_stream().filter(F.col("vid") != SO.NOBODY)
    kept = real.select("type", "simulated_time")
    SK.finish(SK.to_each_batch(kept, SK.append_batches(root, "parquet"), f"{root}-checkpoint"))
    return (
        spark.read.schema("type int, simulated_time int, batch int").parquet(root)
        .groupBy("batch")
        .agg(F.count("*").alias("n"), F.min("simulated_time").alias("t_min"),
             F.max("simulated_time").alias("t_max"))
    )


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read and positions among them, counted as each batch passes."""
    r = replay(spark, sf_dir)
    root = scratch_dir(spark, "metrics")
    real = r.report_stream().filter(F.col("vid") != SO.NOBODY)
    counts = SK.count_batches(f"{root}/out", reports=F.lit(True), positions=F.col("type") == 0)
    SK.finish(SK.to_each_batch(real.select("type"), counts, f"{root}/checkpoint"))
    found = spark.read.schema("batch int, reports bigint, positions bigint").parquet(f"{root}/out")
    return found.filter("reports > 0")


def _minute_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(spark, sf_dir).minutes.select(
        "xway", "seg", "minute", F.round("a", 6).alias("a"), "n"
    )


def _segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics as minutes with reports are served; which these are, the history tells, so the reports of
    a vehicle and minute are gathered once."""
    history = replay(spark, sf_dir).history
    return SG.serving_stats(SG.reported_minutes(history), history).withColumn("lav", F.round("lav", 6))


def _new_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replay(spark, sf_dir).entries.withColumnRenamed("t", "simulated_time")
    return found.select("vid", "simulated_time", "speed", "xway", "lane", "dir", "seg", "pos")


def _vehicles_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles that the state of the entries query remembers, read back from its checkpoint."""
    r = replay(spark, sf_dir)
    r.entries
    state = SO.state_of(spark, f"{r.root}/checkpoints/entries")
    return state.select("key.xway", "key.seg", "key.vid", F.col("value.min.t").alias("simulated_time"))


def _stops_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles that stand when a feed breaks off, from the tracker's checkpoint."""
    r = replay(spark, sf_dir)
    root = scratch_dir(spark, "standing")
    SO.append_slice(r.reports.filter(F.col("simulated_time") < BREAK), f"{root}/feed", r.files)
    SO.close_feed(spark, f"{root}/feed", BREAK, files=r.files)
    events = SG.vehicle_events(r.report_stream(f"{root}/feed"))
    SK.finish(SK.to_files(events, f"{root}/events", f"{root}/checkpoint"))
    trace = SO.state_of(spark, f"{root}/checkpoint", variable="trace").select("key.vid", "value.*")
    return trace.filter("t0 is not null").select("vid", "xway", "seg", "lane", "pos", "t0")


def _new_vehicles_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries where a vehicle silent for ten minutes is new again, and forgotten until then."""
    r = replay(spark, sf_dir)
    root = scratch_dir(spark, "ttl")
    events = SG.vehicle_events(r.report_stream(), SegmentRules(vehicle_ttl=TTL))
    SK.finish(SK.to_files(events, f"{root}/events", f"{root}/checkpoint"))
    return _entry_rows(spark.read.schema(PR.EVENTS).parquet(f"{root}/events"))


def _accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = replay(spark, sf_dir).signals.filter("is_new is not null")
    return signals.select("xway", "seg", "t", "is_new").distinct()


def _notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(spark, sf_dir).notices.select("kind", "vid", "t", "lav", "toll", "seg", "pos")


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports per type and minute where all requests arrive a day late."""
    r = replay(spark, sf_dir)
    root = scratch_dir(spark, "late")
    positions = F.col("type") == 0
    beat = SO.heartbeats(spark, [r.end + 86400])
    for rows in (r.reports.filter(positions), beat, beat, r.reports.filter(~positions)):
        SO.append_slice(rows, f"{root}/feed", r.files)
    stream = SO.in_event_time(r.report_stream(f"{root}/feed"), SG.DELAY)
    counts = (
        stream.groupBy(F.window("ts", "1 minute").alias("w"), "type")
        .agg(F.count("*").alias("n"))
    )
    SK.finish(SK.to_files(SG.with_minute(counts), f"{root}/out", f"{root}/checkpoint"))
    out = spark.read.schema("type int, n bigint, minute int").parquet(f"{root}/out")
    return out.filter(F.col("minute") <= (r.end - 1) // 60 + 1)


def _late_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute statistics where each tenth vehicle's reports come after all others."""
    r = replay(spark, sf_dir)
    root = scratch_dir(spark, "late_updates")
    late = F.col("vid") % 10 == 3
    for rows in (r.reports.filter(~late), r.reports.filter(late)):
        SO.append_slice(rows, f"{root}/feed", r.files)
    changes = SG.late_vehicle_minutes(r.report_stream(f"{root}/feed"))
    SK.finish(SK.to_each_batch(
        changes, SK.append_batches(f"{root}/changes", "parquet"), f"{root}/checkpoint", mode="update"))
    stored = spark.read.schema("xway int, seg int, minute int, vid int, v double, batch int").parquet(f"{root}/changes")
    return SG.latest_minutes(stored).select("xway", "seg", "minute", F.round("a", 6).alias("a"), "n")


def _restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and stops of a query that ended after the first slice and was started again."""
    r = replay(spark, sf_dir)
    root = scratch_dir(spark, "restart")

    def go_on():
        events = SG.vehicle_events(r.report_stream(f"{root}/feed"))
        SK.finish(SK.to_files(events, f"{root}/events", f"{root}/checkpoint"))

    SO.write_slices(r.reports, f"{root}/feed", EDGES[:2], r.files)
    go_on()
    SO.write_slices(r.reports, f"{root}/feed", EDGES[1:], r.files)
    SO.close_feed(spark, f"{root}/feed", r.end, files=r.files)
    go_on()
    events = spark.read.schema(PR.EVENTS).parquet(f"{root}/events")
    return events.filter(F.col("kind").isin(PR.ENTRY, PR.STOP)).select(
        "kind", "vid", "t", "xway", "seg", "lane", "pos"
    )


def _stale_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average velocities where a minute stays until the one past its history has reports."""
    r = replay(spark, sf_dir)
    root = scratch_dir(spark, "stale")
    rules = SegmentRules(lav_keep_stale=True)
    history = SG.segment_history(r.report_stream(), rules)
    SK.finish(SK.to_files(history, f"{root}/history", f"{root}/checkpoint"))
    told = spark.read.schema(history.schema).parquet(f"{root}/history").filter("xway >= 0")
    return SG.serving_stats(SG.reported_minutes(told, rules), told, rules).select("xway", "seg", "minute", F.round("lav", 6).alias("lav"))


def _accidents_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accidents where leaving the segment does not end a stop, each from its start on."""
    r = replay(spark, sf_dir)
    root = scratch_dir(spark, "by_segment")
    rules = SegmentRules(stop_scope="segment")
    events = SG.vehicle_events(r.report_stream(), rules)
    SK.finish(SK.to_files(events, f"{root}/events", f"{root}/checkpoint"))
    changes = SG.accident_changes(SO.table_stream(spark, f"{root}/events", events.schema), rules)
    SK.finish(SK.to_files(changes, f"{root}/changes", f"{root}/changes-checkpoint"))
    found = spark.read.schema(changes.schema).parquet(f"{root}/changes").filter("is_new is not null")
    ended = F.lead("t").over(W.partitionBy("xway", "seg").orderBy("t"))
    return found.withColumn("t1", ended).filter("is_new").select("xway", "seg", F.col("t").alias("t0"), "t1")


def _sent(sent: DataFrame) -> DataFrame:
    """Output rows of either kind without their emission time."""
    kind, vid, report, _, x, y = sent.columns
    return sent.select(kind, vid, report, F.col(x).alias("x"), F.col(y).alias("y"))


SENT_COLS = "kind int, vid int, report_wall_ms bigint, emit_wall_ms bigint, x int, y int"
SENT_NAMES = [c.split()[0] for c in SENT_COLS.split(", ")]


def _sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of notices in a CSV folder of their own."""
    r = replay(spark, sf_dir)
    r.notices
    root = scratch_dir(spark, "csv")
    stream = r.tail("notices", NOTICE_COLS).filter("vid >= 0")
    for name, rows in (("accidents", SG.accident_rows), ("tolls", SG.toll_rows)):
        SK.finish(SK.to_files(rows(stream), f"{root}/{name}", f"{root}/checkpoint-{name}", "csv"))
    both = [_sent(spark.read.schema(SENT_COLS).csv(f"{root}/{n}")) for n in ("accidents", "tolls")]
    return both[0].unionByName(both[1])


def _sink_foreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds written batch by batch from the executors."""
    r = replay(spark, sf_dir)
    r.notices
    root = scratch_dir(spark, "foreach")
    accidents, tolls = (SK.append_batches(f"{root}/{n}") for n in ("accidents", "tolls"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        accidents(SG.accident_rows(batch), batch_id)
        tolls(SG.toll_rows(batch), batch_id)
        batch.unpersist()

    stream = r.tail("notices", NOTICE_COLS).filter("vid >= 0")
    SK.finish(SK.to_each_batch(stream, write, f"{root}/checkpoint"))
    both = [spark.read.schema(SENT_COLS).csv(f"{root}/{n}").select(*SENT_NAMES)
            for n in ("accidents", "tolls")]
    return _sent(both[0]).unionByName(_sent(both[1]))


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time from a report's sending to the emission of its entry, slices sent as they are taken."""
    r = replay(spark, sf_dir)
    root = scratch_dir(spark, "latency")
    for lo, hi in zip(EDGES, EDGES[1:]):
        SO.write_slices(r.reports, f"{root}/feed", [lo, hi], r.files, wall_base_ms=None)
        if hi is None:
            SO.close_feed(spark, f"{root}/feed", r.end, files=r.files)
        events = SK.stamped(SG.vehicle_events(r.report_stream(f"{root}/feed")))
        SK.finish(SK.to_files(events, f"{root}/events", f"{root}/checkpoint"))
    took = F.col("emit_wall_ms") - F.col("wall_ms")
    return (
        spark.read.schema(f"{PR.EVENTS}, emit_wall_ms bigint").parquet(f"{root}/events")
        .filter(F.col("kind") == PR.ENTRY)
        .agg(F.count("*").alias("n"), F.percentile_approx(took, 0.5).alias("p50_ms"),
             F.percentile_approx(took, 0.95).alias("p95_ms"))
        .select("n", ((F.col("p50_ms") >= 0) & (F.col("p50_ms") <= F.col("p95_ms"))).alias("in_order"))
    )


def stream_queries() -> dict[str, Query]:
    return {
        "s_file_source": _file_source,
        "s_replay": _fixed_rate,
        "s_metrics": _metrics,
        "s_minute_stats": _minute_stats,
        "s_segment_stats": _segment_stats,
        "s_segment_lav_compat": _stale_stats,
        "s_new_vehicles": _new_vehicles,
        "s_new_vehicles_ttl": _new_vehicles_ttl,
        "s_vehicles_in_state": _vehicles_in_state,
        "s_stops_in_state": _stops_in_state,
        "s_accidents": _accidents,
        "s_accidents_by_segment": _accidents_by_segment,
        "s_notifications": _notifications,
        "s_late": _late,
        "s_late_updates": _late_updates,
        "s_restart": _restart,
        "s_sink_csv": _sink_csv,
        "s_sink_foreach": _sink_foreach,
        "s_latency": _latency,
    }

"""The registered queries: one per operator, each over reports derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry import functions as G
from gantry import sources as IO
from gantry.operators import accidents as A
from gantry.operators import entries as E
from gantry.operators import positions as P
from gantry.operators import stats as ST
from gantry.operators import trace as TR
from gantry.operators.asof import asof_join
from gantry.operators.joins import StateTable, state_upsert
from gantry.plans.notify import Pipeline
from gantry.rules import SegmentRules
from gantry.schema import ACCOUNT_BALANCE, REPORT_FIELDS
from gantry.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]

# Send time of simulated second 0 in the wire queries.
WALL_BASE_MS = 1700000000000
# The second that separates earlier batches from the current one in the batch-state queries.
BATCH_START = 3600


def pipeline(spark: SparkSession, sf_dir: str, **options) -> Pipeline:
    return Pipeline(IO.reports_from_star(spark, sf_dir), SegmentRules(**options))


def _read_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write raw text, requests without their trailing fields, and read it back."""
    path = scratch_dir(spark, "raw")
    lines = IO.to_raw_lines(IO.reports_from_star(spark, sf_dir))
    short = F.regexp_extract("value", "^((?:[^,]*,){8}[^,]*)", 1)
    lines.select(
        F.when(F.col("value").startswith("2,"), short).otherwise(F.col("value")).alias("value")
    ).write.text(path)
    return IO.read_raw(spark, path)


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.to_wire(IO.reports_from_star(spark, sf_dir), WALL_BASE_MS)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account requests with their own fields, sent and parsed among all reports."""
    sent = IO.reports_from_star(spark, sf_dir).withColumns({
        "qid": F.col("vid") * 10 + F.col("lane"), "sinit": F.col("seg"), "send": (F.col("seg") + 3) % 10,
        "dow": F.col("vid") % 7 + 1, "tod": G.minute_of("simulated_time"), "day": F.col("vid") % 69 + 1,
    })
    lines = IO.tap(IO.to_wire(sent, WALL_BASE_MS), scratch_dir(spark, "requests"), "text")
    return P.of_type(IO.parse_wire(lines, requests=True), ACCOUNT_BALANCE)


def _damaged_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire text in which the requests' speed is not a number."""
    broken = F.regexp_replace("value", "^(2,[^,]*,[^,]*,)", "$1x")
    return _wire(spark, sf_dir).select(broken.alias("value"))


def _union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and requests arrive from one source each."""
    root = scratch_dir(spark, "wire")
    wire = _wire(spark, sf_dir)
    is_position = F.col("value").startswith("0,")
    wire.filter(is_position).write.text(f"{root}/positions")
    wire.filter(~is_position).write.text(f"{root}/requests")
    both = IO.read_sources(spark, [f"{root}/positions", f"{root}/requests"])
    return both.select(*REPORT_FIELDS)


def _one_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources that both have the positions, the other one with speeds of its own."""
    p = pipeline(spark, sf_dir)
    other = p.positions.withColumn("speed", F.col("speed") + F.col("vid") % 3 - 1)
    return IO.one_per_second(IO.union_sources([p.reports, other])).select(*REPORT_FIELDS)


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions stored by block and read back."""
    path = scratch_dir(spark, "blocks")
    P.write_by_block(pipeline(spark, sf_dir).positions, path, 8)
    stored = spark.read.parquet(path)
    return stored.select(*REPORT_FIELDS, F.col("block").cast("int").alias("block"))


def _bucketed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics from reports stored in buckets."""
    name = f"reports_{uuid4().hex}"
    stored = P.write_bucketed(pipeline(spark, sf_dir).positions, name, scratch_dir(spark, name), 8)
    return ST.segment_stats(stored).withColumn("lav", F.round("lav", 6))


def _minutes(spark: SparkSession, sf_dir: str, **options):
    p = pipeline(spark, sf_dir, **options)
    return ST.segment_minutes(p.positions, p.rules), p.rules


def _lav(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    minutes, rules = _minutes(spark, sf_dir, **options)
    return ST.lav_of(minutes, rules).select("xway", "seg", "minute", F.round("lav", 6).alias("lav"))


def _nov(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes, rules = _minutes(spark, sf_dir)
    return ST.nov_of(minutes, rules).select("xway", "seg", "minute", "nov")


def _with_written_stops(spark: SparkSession, sf_dir: str) -> Pipeline:
    reports = IO.reports_from_star(spark, sf_dir)
    return Pipeline(reports, workdir=scratch_dir(spark, "pipeline"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _with_written_stops(spark, sf_dir)
    return A.accident_sizes(p.accident_vehicles, p.rules)


def _resignals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _with_written_stops(spark, sf_dir)
    vehicles = IO.tap(p.accident_vehicles, f"{p.workdir}/vehicles")
    return A.accident_resignals(p.positions, vehicles, p.rules)


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pipeline(spark, sf_dir)
    return A.accident_timeline(p.stats, p.scope, p.rules)


def _new_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = pipeline(spark, sf_dir).positions
    earlier = F.col("simulated_time") < BATCH_START
    seen = pos.filter(earlier).select("xway", "seg", "vid").distinct()
    return E.new_vehicles_batch(pos.filter(~earlier), seen)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = pipeline(spark, sf_dir).positions
    earlier = F.col("simulated_time") < BATCH_START
    state, batch = E.vehicle_latest(pos.filter(earlier)), E.vehicle_latest(pos.filter(~earlier))
    return state_upsert(state, batch, ["xway", "seg", "vid"])


def _state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest reports per vehicle and segment, kept in blocks over three batches."""
    pos = pipeline(spark, sf_dir).positions
    state = StateTable(spark, scratch_dir(spark, "state"), ["xway", "seg", "vid"], G.segment_block(8))
    t = F.col("simulated_time")
    for version, part in enumerate((t < 1800, t.between(1800, BATCH_START - 1), t >= BATCH_START)):
        batch = E.vehicle_latest(pos.filter(part))
        state.update(batch, version)
    return state.read(batch.schema)


def _asof_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics as a minute begins, with the segment's latest accident signal; of two signals in
    one second the new accident counts, and a signal in that very second comes first."""
    p = pipeline(spark, sf_dir)
    stats = p.stats.withColumn("t", G.minute_start("minute"))
    signals = p.signals.groupBy("xway", "seg", "t").agg(F.bool_or("is_new").alias("is_new"))
    signals = signals.withColumn("signal_t", F.col("t"))
    joined = asof_join(stats, signals, ["xway", "seg"], "t", ["signal_t", "is_new"])
    return joined.select(
        "xway", "seg", "minute", F.round("lav", 6).alias("lav"), "nov", "signal_t", "is_new"
    )


def _asof_toll(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pipeline(spark, sf_dir)
    tolls = p.tolls.withColumn("simulated_time", G.minute_start("minute"))
    pos = p.positions.select("vid", "simulated_time", "xway", "seg")
    return asof_join(pos, tolls, ["xway", "seg"], "simulated_time", ["lav", "nov", "toll"], grain=60).select(
        "vid", "simulated_time", "xway", "seg", "lav", "nov", "toll"
    )


def _delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline(
        spark, sf_dir, notice_delay_minutes=1, entry_mode="crossing"
    ).accident_notifications


def batch_queries() -> dict[str, Query]:
    def stage(make: Callable[[Pipeline], DataFrame], **options) -> Query:
        return lambda spark, sf_dir: make(pipeline(spark, sf_dir, **options))

    return {
        "read_raw": _read_raw,
        "account_requests": _requests,
        "parse_wire": lambda s, d: IO.parse_wire(_damaged_wire(s, d)),
        "quarantine": lambda s, d: IO.quarantine(_damaged_wire(s, d)),
        "to_wire": _wire,
        "union_sources": _union_sources,
        "one_per_second": _one_per_second,
        "segment_key": stage(lambda p: P.segment_keys(p.positions)),
        "segment_block": stage(lambda p: P.segment_blocks(p.positions, 8)),
        "write_by_block": _layout,
        "tap": lambda s, d: IO.tap(pipeline(s, d).tolls, scratch_dir(s, "tap")),
        "positions": stage(lambda p: p.positions.select(*REPORT_FIELDS)),
        "route_by_type": stage(lambda p: P.route_by_type(p.reports)),
        "segment_counts": stage(lambda p: P.segment_counts(p.positions)),
        "minute_of": stage(lambda p: p.positions.select(
            "vid", "simulated_time", G.minute_of("simulated_time").alias("minute"))),
        "vehicle_minute_speed": stage(lambda p: ST.vehicle_minute_speed(p.positions)),
        "segment_minute_avg": stage(lambda p: ST.segment_minutes(p.positions).select(
            "xway", "seg", "minute", F.round("a", 6).alias("a"))),
        "segment_minute_count": stage(lambda p: ST.segment_minutes(p.positions).select(
            "xway", "seg", "minute", "n")),
        "segment_nov": _nov,
        "segment_lav": _lav,
        "segment_lav_compat": lambda s, d: _lav(s, d, lav_keep_stale=True),
        "segment_stats": stage(lambda p: p.stats.withColumn("lav", F.round("lav", 6))),
        "segment_stats_bucketed": _bucketed_stats,
        "segment_toll": stage(lambda p: p.tolls),
        "same_position_runs": stage(lambda p: TR.same_position_runs(p.positions)),
        "stopped_vehicles": stage(lambda p: A.stopped_vehicles(p.positions)),
        "stop_intervals": stage(lambda p: p.stops),
        "stop_intervals_by_segment": stage(lambda p: p.stops, stop_scope="segment"),
        "stop_intervals_pair_gap": stage(lambda p: p.stops, pair_gap=30),
        "accidents_by_position": stage(lambda p: p.accidents_by_position),
        "accident_vehicles": _sizes,
        "segment_accidents": stage(lambda p: p.segment_accidents),
        "segment_accidents_by_segment": stage(lambda p: p.segment_accidents, stop_scope="segment"),
        "upstream_scope": stage(lambda p: p.scope),
        "accident_signals": stage(lambda p: p.signals),
        "accident_flags": stage(lambda p: A.accident_flags(p.signals)),
        "accident_resignals": _resignals,
        "accident_timeline": _timeline,
        "new_vehicles": stage(lambda p: E.new_vehicles(p.positions)),
        "segment_crossings": stage(lambda p: E.segment_crossings(p.positions)),
        "new_vehicles_ttl": stage(lambda p: E.new_vehicles_ttl(p.positions, 600)),
        "vehicles_retained": stage(lambda p: E.vehicles_retained(p.positions, 60)),
        "new_vehicles_batch": _new_batch,
        "state_upsert": _upsert,
        "state_table": _state_table,
        "vehicle_latest": stage(lambda p: E.vehicle_latest(p.positions)),
        "segment_high_time": stage(lambda p: E.segment_high_time(p.positions)),
        "asof_stats": _asof_stats,
        "asof_toll": _asof_toll,
        "enriched_entries": stage(lambda p: p.enriched.select(
            "vid", "simulated_time", "xway", "seg", "lane", "minute", "lav", "nov", "toll",
            "in_accident")),
        "toll_notifications": stage(lambda p: p.toll_notifications),
        "accident_notifications": stage(lambda p: p.accident_notifications),
        "notifications": stage(lambda p: p.notifications),
        "notifications_crossing": stage(lambda p: p.notifications, entry_mode="crossing"),
        "notifications_by_direction": stage(lambda p: p.notifications, direction_aware=True),
        "notifications_delayed": _delayed,
    }

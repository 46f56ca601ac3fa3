"""Vehicles that enter a segment, and what is known of them there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry import functions as G
from gantry.operators.joins import salted_join
from gantry.operators.trace import runs
from gantry.rules import DEFAULT_RULES, SegmentRules

ENTRY_COLS = ["vid", "simulated_time", "speed", "xway", "lane", "dir", "seg", "pos"]


def _tail(positions: DataFrame) -> list[str]:
    return ["wall_ms"] if "wall_ms" in positions.columns else []


def new_vehicles(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """First report of each vehicle in each segment.

    A plain aggregation: partial results are formed before the shuffle, on int columns only, and
    nothing is sorted.
    """
    t = F.col("simulated_time")
    keys = [*rules.segment_cols, "vid"]
    rest = [c for c in [*ENTRY_COLS, *_tail(positions)] if c not in (*keys, "simulated_time")]
    firsts = [F.min_by(c, t).alias(c) for c in rest]
    return (
        positions.groupBy(*keys).agg(F.min(t).alias("simulated_time"), *firsts)
        .select(*ENTRY_COLS, *_tail(positions))
    )


def segment_crossings(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Reports that find the vehicle in another segment than its report before."""
    seg = rules.segment_cols
    rest = [c for c in [*ENTRY_COLS, *_tail(positions)] if c not in ("vid", "simulated_time", *seg)]
    return (
        runs(positions, ["vid"], seg, rules, first_of=rest)
        .withColumnRenamed("t_first", "simulated_time")
        .select(*ENTRY_COLS, *_tail(positions))
    )


def new_vehicles_ttl(
    positions: DataFrame, ttl: int, rules: SegmentRules = DEFAULT_RULES
) -> DataFrame:
    """First report in a segment, counted anew after more than `ttl` seconds of silence there."""
    keys = [*rules.segment_cols, "vid"]
    rest = [c for c in [*ENTRY_COLS, *_tail(positions)] if c not in (*keys, "simulated_time")]
    return (
        runs(positions, keys, rules.segment_cols, rules, first_of=rest, max_gap=ttl)
        .withColumnRenamed("t_first", "simulated_time")
        .select(*ENTRY_COLS, *_tail(positions))
    )


def entries(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """The reports that are answered, with their minute."""
    if rules.entry_mode == "crossing":
        found = segment_crossings(positions, rules)
    elif rules.vehicle_ttl is not None:
        found = new_vehicles_ttl(positions, rules.vehicle_ttl, rules)
    else:
        found = new_vehicles(positions, rules)
    return found.withColumn("minute", G.minute_of("simulated_time"))


def vehicle_latest(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Latest report of each vehicle in each segment."""
    t = F.col("simulated_time")
    return positions.groupBy(*rules.segment_cols, "vid").agg(
        F.max(t).alias("simulated_time"),
        *[F.max_by(c, t).alias(c) for c in ("speed", "lane", "pos")],
    )


def segment_high_time(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    return positions.groupBy(*rules.segment_cols).agg(F.max("simulated_time").alias("high_time"))


def vehicles_retained(
    positions: DataFrame, ttl: int, rules: SegmentRules = DEFAULT_RULES
) -> DataFrame:
    """Vehicles still remembered per segment once those silent for more than `ttl` are evicted."""
    seg = rules.segment_cols
    seen = positions.groupBy(*seg, "vid").agg(F.max("simulated_time").alias("simulated_time"))
    high = segment_high_time(positions, rules)
    return (
        salted_join(seen, high, seg, "vid", rules, "inner")
        .filter(F.col("simulated_time") >= F.col("high_time") - ttl)
        .select(*seg, "vid", "simulated_time")
    )


def new_vehicles_batch(
    batch: DataFrame, seen: DataFrame, rules: SegmentRules = DEFAULT_RULES
) -> DataFrame:
    """New vehicles of a batch, given the (segment, vehicle) pairs of earlier batches."""
    return new_vehicles(batch, rules).join(seen, [*rules.segment_cols, "vid"], "left_anti")

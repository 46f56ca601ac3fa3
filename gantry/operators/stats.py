"""Per-segment, per-minute statistics and tolls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry import functions as G
from gantry.operators.trace import CHUNK, PIECE
from gantry.rules import DEFAULT_RULES, SegmentRules

# Digits kept of an average velocity, so that the order of a sum never moves it across a threshold.
LAV_DIGITS = 9


def _vehicle_minutes(positions: DataFrame, keys: list[str]) -> DataFrame:
    t, speed = F.col("simulated_time"), F.col("speed")
    first = F.min_by(speed, t)
    return (
        positions.groupBy(*keys, "vid")
        .agg(first.alias("s1"), F.sum(speed).alias("total"), F.count("*").alias("n"))
        .withColumn("v", F.col("s1") + (F.col("total") - F.col("n") * F.col("s1")) / 2)
    )


def _salted_vehicle_minutes(positions: DataFrame, rules: SegmentRules) -> DataFrame:
    """One row per vehicle, segment and minute.

    The only shuffle of whole reports: by segment-minute, a busy one split by vehicle. The salt
    depends on the vehicle alone, so each vehicle's minute stays in one place and the sums over
    vehicles start where the rows already are.
    """
    keys = [*rules.segment_cols, "minute", "salt"]
    salted = positions.select(
        *rules.segment_cols, G.minute_of("simulated_time").alias("minute"),
        G.salt_of(rules.vehicle_salts, "vid").alias("salt"), "vid", "simulated_time", "speed",
    )
    return _vehicle_minutes(salted.repartition(*keys), keys)


def vehicle_minute_speed(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Speed of a vehicle within a segment's minute: the first report's, moved halfway towards
    each later one. The plain mean for up to two reports."""
    return _salted_vehicle_minutes(positions, rules).select(
        *rules.segment_cols, "minute", "vid", "v", "n"
    )


def segment_minutes(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Mean vehicle speed `a` and vehicle count `n` per segment and minute.

    Comes out partitioned by segment, as the windows over a segment's minutes need it. Positions that
    are dealt out by vehicle and time, or stored in buckets of segment and time, already have each
    vehicle's minute in one place, and only sums are shuffled.
    """
    seg = rules.segment_cols
    cut = next((c for c in (CHUNK, PIECE) if c in positions.columns), None)
    if cut and rules.chunk_seconds % 60 == 0:
        minute = G.minute_of("simulated_time").alias("minute")
        each = _vehicle_minutes(positions.select("vid", cut, *seg, minute, "simulated_time", "speed"), [*seg, cut, "minute"])
        # Partial sums are formed where the vehicles are, so a busy minute is a few rows per task.
        return (
            each.groupBy(*seg, "minute").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
            .select(*seg, "minute", (F.col("v") / F.col("n")).alias("a"), "n")
        )
    return (
        _salted_vehicle_minutes(positions, rules)
        .groupBy(*seg, "minute", "salt")
        .agg(F.sum("v").alias("v"), F.count("*").alias("n"))
        .repartition(*seg)
        .groupBy(*seg, "minute")
        .agg((F.sum("v") / F.sum("n")).alias("a"), F.sum("n").alias("n"))
    )


def _minutes(rules: SegmentRules, first, last):
    return W.partitionBy(*rules.segment_cols).orderBy("minute").rangeBetween(first, last)


def nov_of(minutes: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Adds `nov`, the vehicles of the minute before."""
    before = F.sum("n").over(_minutes(rules, -1, -1))
    return minutes.withColumn("nov", F.coalesce(before, F.lit(0).cast("long")))


def lav_of(minutes: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Adds `lav`, the mean of the preceding minutes' mean speeds; 0 without any.

    With `lav_keep_stale` a minute leaves the average only when the minute just past the history
    has reports itself; until then it stays, however old.
    """
    recent = _minutes(rules, -rules.lav_minutes, -1)
    if not rules.lav_keep_stale:
        mean = F.avg("a").over(recent)
        return minutes.withColumn("lav", F.round(F.coalesce(mean, F.lit(0.0)), LAV_DIGITS))
    past = rules.lav_minutes + 1
    old = _minutes(rules, W.unboundedPreceding, -past)
    stays = F.count("*").over(_minutes(rules, past, past)) == 0
    kept = F.when(F.col("stays"), F.col("a"))
    zero = F.lit(0.0)
    total = F.coalesce(F.sum("a").over(recent), zero) + F.coalesce(F.sum(kept).over(old), zero)
    count = F.count("a").over(recent) + F.count(kept).over(old)
    return (
        minutes.withColumn("stays", stays)
        .withColumn("_total", total).withColumn("_count", count)
        .withColumn("lav", F.round(F.when(F.col("_count") > 0, F.col("_total") / F.col("_count"))
                                   .otherwise(zero), LAV_DIGITS))
        .drop("stays", "_total", "_count")
    )


def segment_stats(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """LAV and NOV of every segment and minute with reports, once each."""
    minutes = segment_minutes(positions, rules)
    return nov_of(lav_of(minutes, rules), rules).select(*rules.segment_cols, "minute", "lav", "nov")


def segment_toll(stats: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Toll of every segment and minute, before any waiver."""
    return stats.select(
        *rules.segment_cols, "minute", G.whole(F.col("lav")).alias("lav"), "nov",
        G.toll_of(F.col("lav"), F.col("nov"), rules).alias("toll"),
    )

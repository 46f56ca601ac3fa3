"""Stopped vehicles, accidents, their upstream scope and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry import functions as G
from gantry.operators.asof import asof_join
from gantry.operators.joins import salted_join
from gantry.operators.trace import runs
from gantry.rules import DEFAULT_RULES, SegmentRules

# Bounds of a segment's accident information while there is none (fixed values).
NO_START, NO_CLEAR = -1, 2147483647

# Length of the time slots in which overlapping intervals look for each other.
SLOT_SECONDS = 600


def place_cols(rules: SegmentRules) -> list[str]:
    return [*rules.segment_cols, "lane", "pos"]


def _stop_runs(positions: DataFrame, rules: SegmentRules) -> DataFrame:
    return runs(
        positions, rules.trace_cols, [*rules.segment_cols, "pos"], rules,
        min_reports=rules.stop_reports, mark_cols=["lane"],
    )


def stop_intervals(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Stops [t0, t1): from the report that completes the stop to the vehicle's first report
    elsewhere; t1 is null while it stands. The lane is that of the completing report."""
    end = F.col("t_next")
    if rules.pair_gap is not None:
        end = F.least(end, F.col("t_last") + rules.pair_gap + 1)
    return _stop_runs(positions, rules).select(
        "vid", *rules.segment_cols, F.col("mark.lane").alias("lane"), "pos",
        F.col("mark.simulated_time").alias("t0"), end.alias("t1"),
    )


def stopped_vehicles(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """One row per stop with the number of identical reports."""
    return _stop_runs(positions, rules).select(
        "vid", *rules.segment_cols, "pos", F.col("mark.simulated_time").alias("t0"), "n"
    )


def covered(intervals: DataFrame, by: list[str], depth: int, chunk: int = 1800) -> DataFrame:
    """Maximal [t0, t1) during which at least `depth` intervals of a group are open.

    Starts and ends are summed per second, then run through in pieces of `chunk` seconds, each of
    which goes on from the sum of the pieces before it. Only the changes from below to above the
    depth and back meet in their group.
    """
    edges = F.array(
        F.struct(F.col("t0").alias("t"), F.lit(1).alias("d")),
        F.struct(F.col("t1").alias("t"), F.lit(-1).alias("d")),
    )
    w = W.partitionBy(*by).orderBy("t")
    within = W.partitionBy(*by, "piece").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*by).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    # Dealt out by piece once: the sums per second, the sums so far and those per piece stay there.
    changes = (
        intervals.select(*by, F.inline(edges)).filter(F.col("t").isNotNull())
        .withColumn("piece", F.floor(F.col("t") / chunk)).repartition(*by, "piece")
        .groupBy(*by, "piece", "t").agg(F.sum("d").alias("d")).filter(F.col("d") != 0)
    )
    carried = changes.groupBy(*by, "piece").agg(F.sum("d").alias("d")).select(
        *by, "piece", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("was"))
    return (
        changes.join(carried, [*by, "piece"])
        .withColumn("open", F.col("was") + F.sum("d").over(within))
        .withColumn("deep", F.col("open") >= depth)
        .filter(F.col("deep") != (F.col("open") - F.col("d") >= depth))
        .withColumn("t1", F.lead("t").over(w))
        .filter("deep")
        .select(*by, F.col("t").alias("t0"), "t1")
    )


def accidents_by_position(stops: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """An accident lasts while two or more vehicles stand at one position and lane."""
    return covered(stops, place_cols(rules), 2)


def segment_accidents(by_position: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """A segment has an accident from the first that starts until none is left."""
    return covered(by_position, rules.segment_cols, 1)


def _slots(t0: Column, t1: Column) -> Column:
    return F.explode(F.sequence(F.floor(t0 / SLOT_SECONDS), F.floor(t1 / SLOT_SECONDS)))


def accident_vehicles(
    stops: DataFrame, by_position: DataFrame, rules: SegmentRules = DEFAULT_RULES
) -> DataFrame:
    """The stops that take part in each accident.

    Intervals look for each other per place and time slot, and each pair is taken in the slot of
    the later start only. A place's accidents do not overlap, so a slot has few of them.
    """
    place = place_cols(rules)
    # An interval without an end is looked for up to the place's last start.
    lasts = (
        stops.select(*place, "t0").unionByName(by_position.select(*place, "t0"))
        .groupBy(*place).agg(F.max("t0").alias("last"))
    )

    def slotted(df: DataFrame, a: str, b: str, spread_by: str, *more: str) -> DataFrame:
        until = F.greatest(F.coalesce(F.least("t1", "last"), F.col("last")), F.col("t0"))
        return salted_join(df, lasts, place, spread_by, rules, "inner").select(
            *place, *more, F.col("t0").alias(a), F.col("t1").alias(b),
            _slots(F.col("t0"), until).alias("slot"),
        )

    s = slotted(stops, "stop_t0", "stop_t1", "vid", "vid")
    a = slotted(by_position, "t0", "t1", "t0")
    forever = F.lit(NO_CLEAR)
    later = F.greatest("stop_t0", "t0")
    return (
        salted_join(s, a, [*place, "slot"], "vid", rules, "inner")
        .filter(
            (F.col("stop_t0") < F.coalesce("t1", forever))
            & (F.col("t0") < F.coalesce("stop_t1", forever))
            & (F.floor(later / SLOT_SECONDS) == F.col("slot"))
        )
        .select(*place, "t0", "t1", "vid", "stop_t0", "stop_t1")
    )


def accident_sizes(vehicles: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Number of vehicles involved in each accident."""
    return vehicles.groupBy(*place_cols(rules), "t0", "t1").agg(
        F.countDistinct("vid").alias("involved")
    )


def accident_resignals(
    positions: DataFrame, vehicles: DataFrame, rules: SegmentRules = DEFAULT_RULES
) -> DataFrame:
    """Further reports of the involved vehicles while the accident lasts.

    Best given `vehicles` as a written table: its size is known then, and while it is small it is
    broadcast and the reports stay where they are.
    """
    forever = F.lit(NO_CLEAR)
    since = vehicles.select(
        *rules.segment_cols, "pos", "vid", F.greatest("stop_t0", "t0").alias("since"),
        F.least(F.coalesce("stop_t1", forever), F.coalesce("t1", forever)).alias("until"),
    ).distinct()
    t = F.col("simulated_time")
    return (
        positions.select(*rules.segment_cols, "pos", "vid", "simulated_time")
        .join(since, [*rules.segment_cols, "pos", "vid"])
        .filter((t > F.col("since")) & (t < F.col("until")))
        .select(*rules.segment_cols, "pos", "vid", "simulated_time").distinct()
    )


def upstream_scope(accidents: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Copies of each segment's accidents for the segment and those a vehicle passes before it."""
    back = F.sequence(F.greatest(F.col("seg") - rules.upstream, F.lit(0)), F.col("seg"))
    affected = back
    if rules.direction_aware:
        end = F.least(F.col("seg") + rules.upstream, F.lit(rules.segments - 1))
        ahead = F.sequence(F.col("seg"), F.greatest(F.col("seg"), end))
        affected = F.when(F.col("dir") == 1, ahead).otherwise(back)
    others = [c for c in rules.segment_cols if c != "seg"]
    return accidents.select(*others, F.explode(affected).alias("seg"), "t0", "t1").select(
        *rules.segment_cols, "t0", "t1"
    )


def accident_signals(scope: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Signals of new and cleared accidents, at most one of each per segment and second."""
    edges = F.array(
        F.struct(F.col("t0").alias("t"), F.lit(True).alias("is_new")),
        F.struct(F.col("t1").alias("t"), F.lit(False).alias("is_new")),
    )
    return (
        scope.select(*rules.segment_cols, F.inline(edges))
        .filter(F.col("t").isNotNull()).distinct()
    )


def accident_flags(signals: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Whether a segment's minute brought a new accident or a clearance."""
    return (
        signals.withColumn("minute", G.minute_of("t"))
        .groupBy(*rules.segment_cols, "minute")
        .agg(F.bool_or("is_new").alias("is_new"), F.bool_or(~F.col("is_new")).alias("is_cleared"))
    )


def accident_timeline(
    stats: DataFrame, scope: DataFrame, rules: SegmentRules = DEFAULT_RULES
) -> DataFrame:
    """Accident information of a segment as a minute begins: latest start and its clearance, if
    known by then; (-1, max) before the first accident. `has_accident` while it lasts."""
    seg = rules.segment_cols
    forever = F.lit(NO_CLEAR)
    # Of accidents that start in the same second the one that lasts longest counts.
    starts = (
        scope.groupBy(*seg, F.col("t0").alias("t"))
        .agg(F.max(F.coalesce("t1", forever)).alias("t1"))
        .withColumn("t0", F.col("t"))
    )
    minutes = stats.select(*seg, "minute", G.minute_start("minute").alias("t"))
    known = asof_join(minutes, starts, seg, "t", ["t0", "t1"])
    return known.select(
        *seg, "minute",
        F.coalesce("t0", F.lit(NO_START)).alias("acc_start"),
        F.when(F.col("t1") <= F.col("t"), F.col("t1")).otherwise(forever).alias("acc_clear"),
        F.coalesce((F.col("t0") < F.col("t")) & (F.col("t") < F.col("t1")), F.lit(False))
        .alias("has_accident"),
    )

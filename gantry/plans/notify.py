"""Toll and accident notifications of vehicles entering a segment."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry import functions as G
from gantry import schema as S
from gantry.operators import accidents as A
from gantry.operators.entries import entries
from gantry.operators.joins import salted_join
from gantry.operators.positions import positions
from gantry.operators.stats import segment_stats, segment_toll
from gantry.operators.trace import dealt_out
from gantry.rules import DEFAULT_RULES, SegmentRules
from gantry.sources.sinks import tap


def _noticed(t: Column, t0: Column, rules: SegmentRules) -> Column:
    """Whether an accident that started at t0 is known to a vehicle at t."""
    known = t > t0
    if rules.notice_delay_minutes:
        known &= G.minute_of(t) >= G.minute_of(t0) + rules.notice_delay_minutes
    return known


def minute_state(
    tolls: DataFrame, scope: DataFrame, rules: SegmentRules = DEFAULT_RULES
) -> DataFrame:
    """Tolls with the accidents that matter in the segment's minute.

    Accidents are spread over the minutes they last, so that entries find toll and accidents with
    one equi join instead of comparing times with every accident of a segment. `scopes` holds
    those that end (a second can start only one per segment ahead, so few fit a minute); one that
    does not end stands in its first minute, and `open_from`, the earliest of these so far, goes
    on from there.
    """
    seg = rules.segment_cols
    ends = F.col("t1").isNotNull()
    first = G.minute_of("t0")
    lasts = F.when(ends, F.sequence(first, G.minute_of("t1"))).otherwise(F.array(first))
    none = F.lit(None)
    known = tolls.select(
        *seg, "minute", F.struct("lav", "nov", "toll").alias("toll"), none.cast("struct<t0:int,t1:int>").alias("scope"),
        none.cast("int").alias("open_from"))
    ahead = scope.withColumn("minute", F.explode(lasts)).select(
        *seg, "minute", none.cast(known.schema["toll"].dataType).alias("toll"),
        F.when(ends, F.struct("t0", "t1")).alias("scope"), F.when(~ends, F.col("t0")).alias("open_from"))
    so_far = (
        W.partitionBy(*seg).orderBy("minute").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    # One exchange by segment serves the minutes and the run through them; both sides are small.
    return (
        known.unionByName(ahead).repartition(*seg)
        .groupBy(*seg, "minute")
        .agg(F.first("toll", ignorenulls=True).alias("toll"), F.collect_set("scope").alias("scopes"),
             F.min("open_from").alias("open_from"))
        .withColumn("open_from", F.min("open_from").over(so_far))
        .filter(F.col("toll").isNotNull())
        .select(*seg, "minute", "toll.*", "scopes", "open_from")
    )


def enriched_entries(
    entered: DataFrame, state: DataFrame, rules: SegmentRules = DEFAULT_RULES
) -> DataFrame:
    """Entries with the LAV, NOV and toll of their minute and whether an accident lies ahead."""
    t = F.col("simulated_time")
    ended = F.exists(
        "scopes", lambda s: _noticed(t, s["t0"], rules) & (t < s["t1"])
    )
    lasting = _noticed(t, F.col("open_from"), rules)
    never = F.lit(False)
    return (
        salted_join(entered, state, [*rules.segment_cols, "minute"], "vid", rules)
        .withColumn("in_accident", F.coalesce(ended, never) | F.coalesce(lasting, never))
        .withColumn("lav", F.coalesce("lav", F.lit(0)))
        .withColumn("nov", F.coalesce("nov", F.lit(0)))
        .withColumn("toll", F.coalesce("toll", F.lit(0)))
        .select(*entered.columns, "lav", "nov", "toll", "in_accident")
    )


def _wall(enriched: DataFrame) -> list:
    return [F.col("wall_ms").alias("report_wall_ms")] if "wall_ms" in enriched.columns else []


def toll_notifications(enriched: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Every entry's toll; none is due where an accident lies ahead."""
    due = F.when(F.col("in_accident"), F.lit(0)).otherwise(F.col("toll")).cast("long")
    return enriched.select(
        F.lit(S.TOLL_KIND).alias("kind"), "vid", F.col("simulated_time").alias("t"), "lav",
        due.alias("toll"), *_wall(enriched),
    )


def accident_notifications(enriched: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Notice of an accident ahead, except to vehicles about to leave."""
    warned = F.col("in_accident") & (F.col("lane") != rules.exit_lane)
    return enriched.filter(warned).select(
        F.lit(S.ACCIDENT_KIND).alias("kind"), "vid", F.col("simulated_time").alias("t"), "seg",
        "pos", *_wall(enriched),
    )


def notifications(enriched: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Both kinds in one frame, from one pass over the entries."""
    toll_due = F.when(F.col("in_accident"), F.lit(0)).otherwise(F.col("toll")).cast("long")
    none = F.lit(None)
    toll = F.struct(
        F.lit(S.TOLL_KIND).alias("kind"), F.col("lav").alias("lav"), toll_due.alias("toll"),
        none.cast("int").alias("seg"), none.cast("int").alias("pos"),
    )
    accident = F.struct(
        F.lit(S.ACCIDENT_KIND).alias("kind"), none.cast("int").alias("lav"),
        none.cast("long").alias("toll"), F.col("seg").alias("seg"), F.col("pos").alias("pos"),
    )
    warned = F.col("in_accident") & (F.col("lane") != rules.exit_lane)
    notices = F.when(warned, F.array(toll, accident)).otherwise(F.array(toll))
    return enriched.select(
        "vid", F.col("simulated_time").alias("t"), *_wall(enriched), F.explode(notices).alias("_n")
    ).select("_n.kind", "vid", "t", "_n.lav", "_n.toll", "_n.seg", "_n.pos", *_wall_out(enriched))


def _wall_out(enriched: DataFrame) -> list[str]:
    return ["report_wall_ms"] if "wall_ms" in enriched.columns else []


@dataclass
class Pipeline:
    """All stages over one table of reports, each planned lazily and usable on its own.

    With `workdir`, a folder all executors share, the stops are written there when first needed
    and read by the stages after them, which then start from a small table of known size.
    """

    reports: DataFrame
    rules: SegmentRules = DEFAULT_RULES
    workdir: str | None = None
    #: whether the positions are dealt out once for all stages; see dealt_out()
    dealt: bool = False

    @property
    def positions(self) -> DataFrame:
        found = positions(self.reports)
        return dealt_out(found, self.rules) if self.dealt else found

    @cached_property
    def _all_stages(self) -> Pipeline:
        """This pipeline with the reports read and shuffled once for statistics, stops and entries."""
        shared = replace(self, dealt=True)
        if self.workdir:
            shared.stops = self.stops
        return shared

    @property
    def stats(self) -> DataFrame:
        return segment_stats(self.positions, self.rules)

    @property
    def tolls(self) -> DataFrame:
        return segment_toll(self.stats, self.rules)

    @cached_property
    def stops(self) -> DataFrame:
        stops = A.stop_intervals(self.positions, self.rules)
        return tap(stops, f"{self.workdir}/stops") if self.workdir else stops

    @property
    def accidents_by_position(self) -> DataFrame:
        return A.accidents_by_position(self.stops, self.rules)

    @property
    def accident_vehicles(self) -> DataFrame:
        return A.accident_vehicles(self.stops, self.accidents_by_position, self.rules)

    @property
    def segment_accidents(self) -> DataFrame:
        return A.segment_accidents(self.accidents_by_position, self.rules)

    @property
    def scope(self) -> DataFrame:
        return A.upstream_scope(self.segment_accidents, self.rules)

    @property
    def signals(self) -> DataFrame:
        return A.accident_signals(self.scope, self.rules)

    @property
    def entries(self) -> DataFrame:
        return entries(self.positions, self.rules)

    @property
    def enriched(self) -> DataFrame:
        p = self._all_stages
        return enriched_entries(p.entries, minute_state(p.tolls, p.scope, self.rules), self.rules)

    @property
    def toll_notifications(self) -> DataFrame:
        return toll_notifications(self.enriched, self.rules)

    @property
    def accident_notifications(self) -> DataFrame:
        return accident_notifications(self.enriched, self.rules)

    @property
    def notifications(self) -> DataFrame:
        return notifications(self.enriched, self.rules)

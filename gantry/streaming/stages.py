"""The stages as streaming DataFrames."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry import functions as G
from gantry import schema as S
from gantry.functions.time import BASE_EPOCH
from gantry.operators.positions import positions
from gantry.operators.stats import LAV_DIGITS
from gantry.rules import DEFAULT_RULES, SegmentRules
from gantry.streaming import processors as PR
from gantry.streaming.source import NOBODY, NOWHERE, in_event_time, union_streams

# How late a report may be, and rows of a table that a stage writes: these come in order of time.
DELAY, IN_ORDER = "60 seconds", "0 seconds"
# Lists in which a minute's reports wait for its end: enough to be spread over any cluster, and with a million
# reports a minute some 250 reports each.
BLOCKS = 4096


def _second(ts) -> F.Column:
    return (F.unix_timestamp(ts) - BASE_EPOCH).cast("int")


def _one_per_second(reports) -> F.Column:
    """Of several reports of a vehicle in a second the least stays, as in `one_per_second`."""
    return F.transform(F.array(F.sort_array(reports)), lambda r: F.filter(
        r, lambda x, i: (i == 0) | reduce(F.Column.__or__, [
            r[F.greatest(i - 1, F.lit(0))][c] != x[c] for c in ("vid", "t")])))[0]


def _packed(numbers) -> F.Column:
    """An array of whole numbers as one text: an array reaches Python element by element, a text whole."""
    return F.array_join(numbers.cast("array<string>"), ",", "")


def _kept(columns: list[str]) -> F.Column:
    """The columns that an ordered processor keeps, packed."""
    return _packed(F.array(*[F.col(c).cast("long") for c in columns])).alias("packed")


def _line(columns: list[str]) -> F.Column:
    """The columns, all whole numbers, as one line of text; -1 for null."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("-1")) for c in columns])


def vehicle_events(
    reports: DataFrame, rules: SegmentRules = DEFAULT_RULES, delay: str = DELAY,
    pace: str = "1 minute",
) -> DataFrame:
    """Entries, stops and moves of each vehicle.

    The watermarked aggregation holds a vehicle's reports back, `pace` of time in one list, until
    none can be missing; so the tracker sees later batches for later times only, and keeps no
    reports itself. A report is one line of text from where it is read: an aggregation carries such a list
    faster than one of records, and the tracker gets a text per vehicle and window, not a row per report. With
    each closed window of the whole feed goes a row of no vehicle, which tells the later stages how far events
    are complete, whether or not any vehicle stops.
    """
    nobody = F.col("who") == NOBODY
    windows = (
        in_event_time(positions(reports), delay)
        .withColumnRenamed("simulated_time", "t")
        .select("vid", "ts", _line(PR.REPORT).alias("report"))
        .withColumn("who", F.explode(F.array_distinct(F.array("vid", F.lit(NOBODY)))))
        .groupBy(F.window("ts", pace).alias("w"), "who")
        .agg(F.collect_list(F.when(~nobody, F.col("report"))).alias("reports"))
        .select(F.col("who").alias("vid"), (_second("w.end") - 1).alias("t"),
                F.array_join("reports", "\n").alias("reports"))
    )
    return windows.groupBy("vid").transformWithState(
        PR.VehicleTracker(rules, pd.Timedelta(pace).total_seconds()), PR.EVENTS, "append",
        "none" if rules.vehicle_ttl is None else "eventTime",
    )


def window_firsts(
    reports: DataFrame, rules: SegmentRules = DEFAULT_RULES, delay: str = DELAY
) -> DataFrame:
    """First report of each vehicle in each segment and minute, once the minute is complete."""
    first = F.struct(F.col("simulated_time").alias("t"), "speed", "lane", "dir", "pos", "wall_ms")
    names = ["t", "speed", "lane", "pos", "wall_ms"] + [c for c in ("dir",) if c not in rules.segment_cols]
    return (
        in_event_time(positions(reports), delay)
        .groupBy(F.window("ts", "1 minute").alias("w"), *rules.segment_cols, "vid")
        .agg(F.min(first).alias("first"))
        .select("vid", *rules.segment_cols, *(F.col(f"first.{c}") for c in names))
    )


def first_entries(firsts: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """First sight of each vehicle in each segment, for a query in update mode over the table that
    `window_firsts` writes.

    The state is an aggregation's, held by the JVM: the least report of a vehicle and segment, and when
    the batch ran that first had one. An update whose batch is this very one is a new entry; later
    batches hold later minutes only, so the least report is the first. Unlike the tracker's, this
    state is spread by segment and vehicle, and no Python runs.
    """
    keys = [*rules.segment_cols, "vid"]
    rest = [c for c in firsts.columns if c not in keys]
    # The greatest of the negative times is the earliest; two sums of one kind would share a name in the state.
    ago = -F.unix_micros(F.current_timestamp())
    return (
        firsts.withColumn("ago", ago).groupBy(*keys)
        .agg(F.min(F.struct("t", *[c for c in rest if c != "t"])).alias("first"), F.max("ago").alias("seen"))
        .filter(F.col("seen") == ago)
        .select(*keys, "first.*")
    )


def vehicle_minutes(
    reports: DataFrame, rules: SegmentRules = DEFAULT_RULES, delay: str = DELAY, blocks: int | None = None
) -> DataFrame:
    """Each vehicle's speed per segment and minute, as the minute closes; of several reports in one
    second the least counts, as everywhere.

    With `blocks` the reports of a minute wait in so many lists, by a hash of the vehicle, not in one for each
    vehicle: a list of two or three costs the shuffle and the state far more than its rows. In update mode a
    late report then tells all vehicles of its list anew.
    """
    seg = rules.segment_cols
    keys = ["vid", *seg]
    report = F.struct("vid", F.col("simulated_time").alias("t"), "speed", "xway", "lane", "dir", "seg", "pos")
    share = F.col("vid") if blocks is None else G.salt_of(blocks, "vid")

    def nth(i):
        return F.col("reports")[i]

    def begins(i):
        return reduce(F.Column.__or__, [nth(F.greatest(i - 1, F.lit(0)))[c] != nth(i)[c] for c in keys], i == 0)

    def in_segment(i, k):
        end = F.coalesce(F.get("begins", k + 1), F.size("reports"))
        return F.struct(*(nth(i)[c].alias(c) for c in keys), F.slice("reports.speed", i + 1, end - i).alias("speeds"))

    each = (
        in_event_time(positions(reports), delay)
        .groupBy(F.window("ts", "1 minute").alias("w"), share.alias("share"))
        .agg(_one_per_second(F.collect_list(report)).alias("reports"))
        .select("w", F.sort_array(F.transform("reports", lambda r: F.struct(
            *(r[c].alias(c) for c in [*keys, "t", "speed"])))).alias("reports"))
        .select("w", "reports", F.filter(F.sequence(F.lit(0), F.size("reports") - 1), begins).alias("begins"))
        .select("w", F.inline(F.transform("begins", in_segment)))
    )
    s1, total = F.get("speeds", F.lit(0)), F.aggregate("speeds", F.lit(0), lambda x, y: x + y)
    return each.select("w", *seg, "vid", (s1 + (total - F.size("speeds") * s1) / 2).alias("v"))


def late_vehicle_minutes(
    reports: DataFrame, rules: SegmentRules = DEFAULT_RULES, retention: str = "1 day"
) -> DataFrame:
    """Each vehicle's speed per segment and minute, told anew when a late report changes it.

    For a query in update mode: a batch holds what it changed. A minute stays in the state, and takes
    reports, until the watermark is `retention` past it, which bounds the state.
    """
    return with_minute(vehicle_minutes(reports, rules, retention)).select(*rules.segment_cols, "minute", "vid", "v")


def latest_minutes(changes: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Minute statistics from the latest of each vehicle's changes (column `batch`), late reports included."""
    keys = [*rules.segment_cols, "minute"]
    latest = changes.groupBy(*keys, "vid").agg(F.max_by("v", "batch").alias("v"))
    return latest.groupBy(*keys).agg(F.avg("v").alias("a"), F.count("*").alias("n"))


def minute_stats(
    reports: DataFrame, rules: SegmentRules = DEFAULT_RULES, delay: str = DELAY
) -> DataFrame:
    """Mean vehicle speed and vehicle count per segment and minute."""
    return (
        vehicle_minutes(reports, rules, delay, BLOCKS)
        .groupBy(F.window(F.window_time("w"), "1 minute").alias("w"), *rules.segment_cols)
        .agg(F.avg("v").alias("a"), F.count("*").alias("n"))
    )


def with_minute(windowed: DataFrame) -> DataFrame:
    """A minute window as the number of the minute."""
    return windowed.withColumn("minute", G.minute_of(_second("w.start"))).drop("w")


def segment_history(
    reports: DataFrame, rules: SegmentRules = DEFAULT_RULES, delay: str = DELAY
) -> DataFrame:
    """LAV, NOV and toll of each segment as a minute begins: over the minutes that end then.

    A row for every minute with reports in the history before it; without a row all are 0. With
    `lav_keep_stale` a row holds until the segment's next one.
    """
    if rules.lav_keep_stale:
        return _stale_history(reports, rules, delay)
    ends = F.col("w.end")
    is_last = F.unix_timestamp("m") + 60 == F.unix_timestamp(ends)
    history = (
        minute_stats(reports, rules, delay)
        .select(F.window_time("w").alias("ts"), F.col("w.start").alias("m"),
                *rules.segment_cols, "a", "n")
        .groupBy(
            F.window("ts", f"{rules.lav_minutes} minutes", "1 minute").alias("w"),
            *rules.segment_cols,
        )
        .agg(
            F.avg("a").alias("lav"),
            # The window's last minute, if it has reports, is the one with the latest start.
            F.max(F.struct("m", "n")).alias("latest"),
        )
        .withColumn("m", F.col("latest.m"))
        .withColumn("n", F.col("latest.n"))
    )
    minute = G.minute_of(_second(ends))
    nov = F.when(is_last, F.col("n")).otherwise(F.lit(0)).cast("long")
    lav = F.round("lav", LAV_DIGITS)
    return history.select(
        *rules.segment_cols, minute.alias("minute"), lav.alias("lav"), nov.alias("nov"),
        G.toll_of(lav, nov, rules).alias("toll"),
    )


def _stale_history(reports: DataFrame, rules: SegmentRules, delay: str) -> DataFrame:
    seg = rules.segment_cols
    columns = ", ".join(f"{c} int" for c in [*seg, "minute"])
    told = with_minute(minute_stats(reports, rules, delay)).groupBy(*seg).transformWithState(
        PR.StaleMinutes(rules), f"{columns}, lav double, nov bigint", "append", "eventTime")
    lav = F.round("lav", LAV_DIGITS)
    return told.select(*seg, "minute", lav.alias("lav"), "nov", G.toll_of(lav, F.col("nov"), rules).alias("toll"))


def accident_changes(
    events: DataFrame, rules: SegmentRules = DEFAULT_RULES, delay: str = IN_ORDER
) -> DataFrame:
    """Starts and ends of segments' accidents from stops and moves."""
    stops = events.filter(F.col("kind") != PR.ENTRY)
    # The direction is part of the key only where rules say so; else it is 0.
    if not rules.direction_aware:
        stops = stops.withColumn("dir", F.lit(0))
    beat = F.col("kind") == PR.HEARTBEAT
    keys = ["xway", "dir", "seg"]
    packed = in_event_time(stops, delay, "t", beat).select(*keys, "ts", "t", _kept(PR.AccidentTracker.layout))
    return packed.groupBy(*keys).transformWithState(PR.AccidentTracker(), PR.SIGNALS, "append", "eventTime")


def scope_signals(changes: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """Changes copied to every segment they concern; `source` is where the accident is."""
    seg = F.col("seg")
    affected = F.sequence(F.greatest(seg - rules.upstream, F.lit(0)), seg)
    if rules.direction_aware:
        ahead = F.sequence(seg, F.greatest(seg, F.least(seg + rules.upstream, F.lit(rules.segments - 1))))
        affected = F.when(F.col("dir") == 1, ahead).otherwise(affected)
    affected = F.when(F.col("kind") == PR.HEARTBEAT, F.array(seg)).otherwise(affected)
    return changes.withColumn("source", seg).withColumn("seg", F.explode(affected))


def notices(
    events: DataFrame, signals: DataFrame, history: DataFrame,
    rules: SegmentRules = DEFAULT_RULES, delay: str = IN_ORDER,
) -> DataFrame:
    """Toll and accident notices of the entries among `events`.

    A segment's vehicles are divided into shares, so that a busy segment is not one key; what is
    known of the segment goes to all of them.
    """
    n = rules.join_salts
    all_shares = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    entered = events.filter(F.col("kind").isin(PR.ENTRY, PR.HEARTBEAT)).select(
        F.lit(PR.ENTERED).alias("kind"), "vid", "t", "xway", "dir", "seg", "lane", "pos",
        "wall_ms", G.salt_of(n, "vid").alias("share"), (F.col("vid") == NOBODY).alias("beat"),
    )
    changed = signals.select(
        F.when(F.col("is_new"), PR.START).otherwise(PR.CLEAR).alias("kind"), "t", "xway", "dir",
        "seg", "source", all_shares.alias("share"), (F.col("seg") == NOWHERE).alias("beat"),
    )
    known = history.select(
        F.lit(PR.STATS).alias("kind"), G.minute_start("minute").alias("t"), "xway",
        *(["dir"] if rules.direction_aware else []), "seg", "minute",
        F.col("lav").cast("int").alias("lav"), "toll", all_shares.alias("share"),
        F.lit(False).alias("beat"),
    )
    # One watermark per input: the slowest decides.
    both = union_streams([in_event_time(s, delay, "t", F.col("beat")) for s in (entered, changed, known)])
    if not rules.direction_aware:
        both = both.withColumn("dir", F.lit(0))
    # Heartbeats have done their part once the watermark is taken; they belong to no segment.
    keys = ["xway", "dir", "seg", "share"]
    return (
        both.select(*keys, "ts", "t", _kept(PR.Notifier.layout)).groupBy(*keys)
        .transformWithState(PR.Notifier(rules), PR.NOTICES, "append", "eventTime")
        .filter(F.col("vid").isNull() | (F.col("vid") != NOWHERE))
    )


def reported_minutes(history: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """The minutes with reports, from the history alone: those before the rows that count vehicles."""
    return history.filter(F.col("nov") > 0).select(*rules.segment_cols, (F.col("minute") - 1).alias("minute"))


def serving_stats(minutes: DataFrame, history: DataFrame, rules: SegmentRules = DEFAULT_RULES):
    """Statistics of the minutes with reports, from the tables the two statistics queries write; the minutes
    may be those of `reported_minutes`."""
    seg = rules.segment_cols
    served = F.col("minute")
    if rules.lav_keep_stale:
        # The last row that was told for a segment: it follows from when the segment last had reports.
        before = F.lag("minute").over(W.partitionBy(*seg).orderBy("minute"))
        served = F.least("minute", before + rules.lav_minutes + 2)
    asked = minutes.select(*seg, "minute", served.alias("served"))
    return asked.join(history.withColumnRenamed("minute", "served"), [*seg, "served"], "left").select(
        *seg, "minute", F.coalesce("lav", F.lit(0.0)).alias("lav"), F.coalesce("nov", F.lit(0)).alias("nov"),
        F.coalesce("toll", F.lit(0)).alias("toll"),
    )


def accident_rows(notices: DataFrame) -> DataFrame:
    """Accident notices in output order: kind, vehicle, report and emission time, place."""
    return notices.filter(F.col("kind") == S.ACCIDENT_KIND).select(
        "kind", "vid", "report_wall_ms", "emit_wall_ms", "seg", "pos"
    )


def toll_rows(notices: DataFrame) -> DataFrame:
    """Toll notices in output order: kind, vehicle, report and emission time, LAV, toll."""
    return notices.filter(F.col("kind") == S.TOLL_KIND).select(
        "kind", "vid", "report_wall_ms", "emit_wall_ms", "lav", F.col("toll").cast("int")
    )

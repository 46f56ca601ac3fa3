"""Runs in a vehicle's trace: maximal sequences of reports that agree in some columns.

A trace is cut into pieces of `chunk_seconds`; a piece holds at most one report per second, so no
vehicle, however many reports it has, makes a large group. Runs are formed within the pieces, and
only a piece's first and last run are compared across pieces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry import functions as G
from gantry.rules import DEFAULT_RULES, SegmentRules


# Column of `dealt_out` rows: the piece of time by which, with the vehicle, they are partitioned.
CHUNK = "_chunk"
# Column of reports stored in buckets of segment and piece of time.
PIECE = "piece"
PACKED = ["speed", "xway", "lane", "dir", "seg", "pos", "wall_ms"]


def dealt_out(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    """The positions partitioned by vehicle and piece of time, for several stages that start from them.

    Statistics, entries and runs group by more than these two, so none of them shuffles whole reports
    again. The other columns travel in one array: stages that read different columns then ask for
    the very same exchange, which Spark makes once. Fields are marked as never null, or else a filter
    that one stage's joins ask for would make its exchange another one; so rows that lack one, which
    the parsers never let through, are left out.
    """
    packed = [c for c in PACKED if c in positions.columns]
    kinds = {f.name: f.dataType for f in positions.schema}
    sure = [c for c in packed if c != "wall_ms"]
    fields = F.array(*[F.col(c).cast("long") for c in packed]).alias("_fields")

    def field(c: str) -> Column:
        value = F.col("_fields")[packed.index(c)].cast(kinds[c])
        return (F.coalesce(value, F.lit(0).cast(kinds[c])) if c in sure else value).alias(c)

    key = ["vid", "simulated_time"]
    return (
        positions.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in (*key, *sure)]))
        .select(*key, G.chunk_of("simulated_time", rules.chunk_seconds).alias(CHUNK), fields)
        .repartition("vid", CHUNK)
        .select(*key, CHUNK, *map(field, packed))
    )


def runs(
    positions: DataFrame,
    trace: list[str],
    same: list[str],
    rules: SegmentRules = DEFAULT_RULES,
    first_of: list[str] = (),
    min_reports: int = 1,
    mark_cols: list[str] = (),
    max_gap: int | None = None,
) -> DataFrame:
    """One row per run of at least `min_reports` reports with equal `same` columns.

    Columns: trace, same, `n`, `t_first`, `t_last`, `t_next` (first report after the run, null if
    none), `first_of` as of the first report, and with `mark_cols` `mark`, a struct of
    simulated_time and these columns as of report number `min_reports`. With `max_gap` a longer
    silence ends a run, too.
    """
    marked = ["simulated_time", *mark_cols] if mark_cols else []
    cut = _pieces(positions, trace, same, rules, first_of, min_reports, marked, max_gap)
    return _joined(cut, trace, same, first_of, min_reports, marked, max_gap)


def _follows(spec, same: list[str], last_time: str, this_time: str, max_gap: int | None) -> Column:
    """Whether a row continues the row before it."""
    tests = [F.lag(c).over(spec) == F.col(c) for c in same]
    if max_gap is not None:
        tests.append(F.col(this_time) - F.lag(last_time).over(spec) <= max_gap)
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def _pieces(positions, trace, same, rules, first_of, min_reports, marked, max_gap) -> DataFrame:
    """Runs within the pieces, each told on its first report: whatever else is needed of a run
    lies a fixed number of reports ahead or belongs to the piece as a whole."""
    t = "simulated_time"
    needed = dict.fromkeys([*trace, *same, t, *first_of, *marked])
    w = W.partitionBy(*trace, "chunk").orderBy(t)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    dealt = CHUNK in positions.columns
    chunk = F.col(CHUNK) if dealt else G.chunk_of(t, rules.chunk_seconds)
    starts = (
        positions.select(*needed, chunk.alias("chunk"))
        .select(
            "*",
            _follows(w, same, t, t, max_gap).alias("follows"),
            F.row_number().over(w).alias("i"),
            F.lag(t).over(w).alias("t_before"),
            F.count(F.lit(1)).over(whole).cast("int").alias("size"),
            F.max(t).over(whole).alias("t_end"),
            # Report number min_reports of the run; and the piece's first reports, one of which it
            # is if the run already had some in earlier pieces.
            *[F.lead(c, min_reports - 1).over(w).alias(f"mark_{c}") for c in marked],
            *[
                F.nth_value(c, j).over(whole).alias(f"head{j}_{c}")
                for c in marked for j in range(1, min_reports)
            ],
        )
        .filter(~F.col("follows"))
    )
    found = starts.select(
        "*",
        F.lead("i").over(w).alias("next_i"),
        F.lead(t).over(w).alias("t_next"),
        F.coalesce(F.lead("t_before").over(w), "t_end").alias("t_last"),
    ).withColumn("n", F.coalesce("next_i", F.col("size") + 1) - F.col("i"))

    opens, closes = F.col("i") == 1, F.col("next_i").isNull()
    heads = [
        F.array(*[F.col(f"head{j}_{c}") for j in range(1, min_reports)]).alias(f"heads_{c}")
        for c in marked if min_reports > 1
    ]
    return found.filter(opens | closes | (F.col("n") >= min_reports)).select(
        *dict.fromkeys([*trace, *same]), "chunk", "n", F.col(t).alias("t_first"), "t_last",
        "t_next",
        # Runs at a piece's edge meet in one group per trace, at most two per piece; the others
        # keep to their piece.
        F.when(opens | closes, F.lit(-1)).otherwise(F.col("chunk")).alias("zone"),
        *first_of, *[f"mark_{c}" for c in marked], *heads,
    )


def _joined(cut, trace, same, first_of, min_reports, marked, max_gap) -> DataFrame:
    """Runs that go on from one piece to the next as one."""
    w = W.partitionBy(*trace, "zone").orderBy("t_first")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    other_piece = F.coalesce(F.lag("chunk").over(w) != F.col("chunk"), F.lit(False))
    starts = F.col("starts")

    df = cut.select(
        "*",
        (~(other_piece & _follows(w, same, "t_last", "t_first", max_gap))).alias("starts"),
        F.sum("n").over(so_far).alias("reports"),
        F.lead("t_first").over(w).alias("t_after"),
    )
    firsts = F.struct(F.col("t_first").alias("t0"), (F.col("reports") - F.col("n")).alias("before"),
                      *first_of)
    df = df.select(
        "*",
        F.lead("starts").over(w).alias("next_starts"),
        F.last(F.when(starts, firsts), ignorenulls=True).over(so_far).alias("first"),
    ).withColumn("total", F.col("reports") - F.col("first.before"))

    if marked:
        # Which of this piece's reports is number min_reports of the run, if any.
        place = (F.lit(min_reports) - (F.col("total") - F.col("n"))).cast("int")
        point = F.struct(*[_at(place, c, min_reports).alias(c) for c in marked])
        here = F.when(place.between(1, F.col("n")), point)
        df = df.withColumn("here", here).withColumn(
            "mark", F.last("here", ignorenulls=True).over(so_far)
        )

    ends = F.coalesce(F.col("next_starts"), F.lit(True))
    # t_after is the next piece's first report for a run at the end of its piece.
    t_next = F.coalesce("t_next", F.when(F.col("zone") == -1, F.col("t_after")))
    return df.filter(ends & (F.col("total") >= min_reports)).select(
        *dict.fromkeys([*trace, *same]), F.col("total").alias("n"),
        F.col("first.t0").alias("t_first"), "t_last", t_next.alias("t_next"),
        *[F.col(f"first.{c}").alias(c) for c in first_of], *(["mark"] if marked else []),
    )


def _at(place: Column, c: str, min_reports: int) -> Column:
    mark = F.col(f"mark_{c}")
    if min_reports == 1:
        return mark
    return F.when(place == min_reports, mark).otherwise(F.get(f"heads_{c}", place - 1))


def same_position_runs(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    place = [*rules.segment_cols, "pos"]
    return runs(positions, rules.trace_cols, place, rules).select("vid", *place, "n", "t_first", "t_last")

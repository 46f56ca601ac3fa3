"""As-of join: each row with the latest row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    values: list[str],
    allow_exact: bool = True,
    chunk: int = 1800,
    grain: int = 1,
) -> DataFrame:
    """`left` with the `values` of the `right` row with equal `by` and the greatest `on` not after
    (or, without `allow_exact`, before) its own; null if there is none. `right` has one row per
    `by` and `on`.

    The merge runs over the distinct times of a group within pieces of `chunk`; what is last in a
    piece is carried on over a table with a row per piece. The rows then look their time up with an
    equi join.

    Where all times of `right` are multiples of `grain`, as tolls hold from full minutes on, the rows
    of `left` within one such span share a lookup.
    """
    if grain > 1:
        if not allow_exact:
            raise ValueError("a grain needs exact matches")
        span = "_span"
        spans = left.withColumn(span, (F.floor(F.col(on) / grain) * grain).cast(left.schema[on].dataType))
        found = asof_join(
            spans.select(*by, span).distinct(), right.withColumnRenamed(on, span), by, span, values, chunk=chunk)
        return spans.join(found, [*by, span], "left").select(*left.columns, *values)
    taken = F.struct(*[F.col(v) for v in values]).alias("_v")
    piece = F.floor(F.col(on) / chunk).alias("_piece")
    none = F.lit(None).cast(right.select(taken).schema["_v"].dataType)
    times = left.select(*by, on).distinct().withColumn("_v", none)
    own_rank, other_rank = (1, 0) if allow_exact else (0, 1)
    merged = times.withColumn("_rank", F.lit(own_rank)).unionByName(
        right.select(*by, on, taken, F.lit(other_rank).alias("_rank"))
    ).withColumn("_piece", piece)

    ends = right.groupBy(*by, piece).agg(F.max_by(F.struct(*values), on).alias("_last"))
    asked = left.select(*by, piece).distinct().withColumn("_last", none)
    before = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        ends.unionByName(asked)
        .groupBy(*by, "_piece").agg(F.first("_last", ignorenulls=True).alias("_last"))
        .select(*by, "_piece", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    )

    within = W.partitionBy(*by, "_piece").orderBy(on, "_rank")
    within = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    lookup = (
        merged.withColumn("_v", F.last("_v", ignorenulls=True).over(within))
        .filter(F.col("_rank") == own_rank)
        .join(carried, [*by, "_piece"], "left")
        .select(*by, on, F.coalesce("_v", "_before").alias("_v"))
    )
    return left.join(lookup, [*by, on], "left").select("*", "_v.*").drop("_v")

"""Selecting and counting reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry import functions as G
from gantry import schema as S
from gantry.operators.trace import PIECE
from gantry.rules import DEFAULT_RULES, SegmentRules


def positions(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col("type") == S.POSITION)


def of_type(reports: DataFrame, kind: int) -> DataFrame:
    return reports.filter(F.col("type") == kind)


def route_by_type(reports: DataFrame) -> DataFrame:
    return reports.groupBy("type").agg(F.count("*").alias("n"))


def segment_counts(positions: DataFrame, rules: SegmentRules = DEFAULT_RULES) -> DataFrame:
    return positions.groupBy(*rules.segment_cols).agg(F.count("*").alias("n"))


def segment_keys(positions: DataFrame) -> DataFrame:
    """Segments with their display key and what the key splits back to."""
    return (
        positions.select("xway", "seg").distinct()
        .withColumn("key", G.segment_key())
        .select(
            "xway", "seg", "key",
            G.key_xway("key").alias("key_xway"), G.key_seg("key").alias("key_seg"),
        )
    )


def segment_blocks(positions: DataFrame, blocks: int) -> DataFrame:
    """Reports per block of neighbouring segments, the unit of output layout."""
    return (
        positions.select("xway", "seg")
        .groupBy("xway", "seg").agg(F.count("*").alias("n"))
        .select("xway", "seg", G.segment_block(blocks).alias("block"), "n")
    )


def write_by_block(
    positions: DataFrame, path: str, blocks: int
) -> None:
    """Store reports in one folder per block, each block written by as many tasks as it needs."""
    (
        positions.withColumn("block", G.segment_block(blocks)).hint("rebalance", F.col("block"))
        .write.mode("overwrite").partitionBy("block").parquet(path)
    )


def write_bucketed(
    positions: DataFrame, table: str, path: str, buckets: int, rules: SegmentRules = DEFAULT_RULES
) -> DataFrame:
    """Store reports as table `table` in buckets of segment and piece of time, sorted by vehicle and time.

    Statistics of segments' minutes then start from the buckets without an exchange. A busy segment
    is spread over the buckets of its pieces.
    """
    keys = [*rules.segment_cols, PIECE]
    piece = G.chunk_of("simulated_time", rules.chunk_seconds).alias(PIECE)
    (
        positions.select("*", piece).repartition(buckets, *keys)
        .write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys, "vid", "simulated_time")
        .saveAsTable(table)
    )
    return positions.sparkSession.table(table)

"""Joins on busy keys and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry import functions as G
from gantry.rules import DEFAULT_RULES, SegmentRules


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: str,
    rules: SegmentRules = DEFAULT_RULES,
    how: str = "left",
) -> DataFrame:
    """Join whose left side may be busy on a key: its rows go to `join_salts` shares by
    `spread_by`, and each row of the small right side goes to all of them."""
    if how not in ("left", "inner"):
        raise ValueError("only joins that keep or match rows of the left side can be salted")
    n = rules.join_salts
    spread = left.withColumn("_salt", G.salt_of(n, spread_by))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def state_upsert(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """State after a batch: the batch's row where it has one, else the row there was."""
    values = [c for c in state.columns if c not in keys]
    new = batch.select(*keys, F.struct(*values).alias("_new"))
    old = state.select(*keys, F.struct(*values).alias("_old"))
    return (
        old.join(new, keys, "full_outer")
        .select(*keys, F.coalesce("_new", "_old").alias("_v"))
        .select(*keys, "_v.*")
    )


class StateTable:
    """State kept as Parquet in blocks, of which a batch writes only those that it touches.

    Each update writes the touched blocks anew as a version; the table is the latest version of every
    block. Untouched blocks are neither read nor written, and a repeated update replaces itself. Only
    the versions, a number per block, reach the driver.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], block: Column):
        self.spark, self.path, self.keys, self.block = spark, path, keys, block

    def _versions(self, before: int | None = None) -> dict[int, int]:
        """The latest version of each block, from the names of the folders."""
        try:
            stored = self.spark.read.parquet(self.path).select("version", "block").distinct()
        except AnalysisException:  # nothing written yet
            return {}
        found = stored if before is None else stored.filter(F.col("version") < before)
        return {r.block: r.version for r in found.groupBy("block").agg(F.max("version").alias("version")).collect()}

    def read(self, schema: T.StructType, blocks: set[int] | None = None, before: int | None = None) -> DataFrame:
        """The state, or that of some blocks, as of the last update (or that before version `before`)."""
        by_version: dict[int, list[int]] = {}
        for block, version in self._versions(before).items():
            if blocks is None or block in blocks:
                by_version.setdefault(version, []).append(block)
        if not by_version:
            return self.spark.createDataFrame([], schema)
        wanted = [(F.col("version") == v) & F.col("block").isin(b) for v, b in by_version.items()]
        full = T.StructType([*schema, T.StructField("version", T.IntegerType()), T.StructField("block", T.IntegerType())])
        stored = self.spark.read.schema(full).parquet(self.path)
        return stored.filter(reduce(Column.__or__, wanted)).select(*schema.names)

    def update(self, batch: DataFrame, version: int) -> None:
        """Put the batch's rows (one per key) into the table, as version `version`, counted upwards."""
        blocks = {r.block for r in batch.select(self.block.cast("int").alias("block")).distinct().collect()}
        old = self.read(batch.schema, blocks, before=version)
        merged = state_upsert(old, batch, self.keys).select(*batch.columns)
        (
            merged.withColumns({"version": F.lit(version), "block": self.block.cast("int")}).hint("rebalance", F.col("block"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "block")
            .parquet(self.path)
        )

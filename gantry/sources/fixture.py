"""Reports derived from the star schema's order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reports_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per (type, supplier, tick); a supplier drives, a tick is 20 s.

    Three of four vehicles travel as a platoon, the others change segment at staggered times, and
    of every 25 some stop side by side: 0 and 1 in ticks 5..14 of every 40, later joined by 2; 5 and 6
    so briefly that an accident may begin and end within a minute; 7 and 8 from tick 350 to the end.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.when(F.col("l_linenumber") == 7, 2).otherwise(0).alias("type"),
        F.col("l_suppkey").cast("int").alias("vid"),
        (F.col("l_orderkey") % 360).cast("int").alias("tick"),
        "l_quantity",
    )
    vid, tick = F.col("vid"), F.col("tick")
    who, when = vid % 25, tick % 40
    stopped = (
        (who.isin(0, 1) & when.between(5, 14)) | ((who == 2) & when.between(7, 16))
        | (who.isin(5, 6) & when.between(25, 30)) | (who.isin(7, 8) & (tick >= 350))
    )
    seg = (
        F.when(stopped, F.floor(tick / 40).cast("int") % 10)
        .when(vid % 4 < 3, F.floor(tick / 20).cast("int") % 10)
        .otherwise((vid + F.floor((tick + vid) / 36)).cast("int") % 10)
    )
    place = F.when(stopped, 1000 + F.floor(vid / 25).cast("int") * 10).otherwise(
        (tick * 37 + vid * 101) % 5280
    )
    return (
        lines.groupBy("type", "vid", "tick")
        .agg(F.max("l_quantity").cast("int").alias("q"))
        .select(
            "type",
            (tick * 20).alias("simulated_time"),
            "vid",
            (F.col("q") + (F.floor(tick / 20).cast("int") % 3) * 15).alias("speed"),
            F.floor(vid / 100).cast("int").alias("xway"),
            F.when(stopped, 1).otherwise((vid + tick) % 5).alias("lane"),
            (F.floor(vid / 25).cast("int") % 2).alias("dir"),
            seg.alias("seg"),
            (seg * 5280 + place).alias("pos"),
        )
    )

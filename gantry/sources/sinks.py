"""File sinks and stage taps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tap(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write a stage's rows and go on from the written table."""
    df.write.mode("overwrite").format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def notice_csv(notices: DataFrame, path: str, append: bool = False) -> None:
    notices.write.mode("append" if append else "overwrite").csv(path)


def read_notice_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).csv(path)

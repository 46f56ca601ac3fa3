"""Raw files, wire lines and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry import schema as S

# A whole number as the parser accepts it, ten or more of them per line. A number's digits are never given back
# and no group is captured: nothing else could match, and the check takes half the time.
_INT = "[-+]?[0-9]++"
_LINE = f"^(?:{_INT},){{9}}+{_INT}(?:,.*)?$"


def _split(lines: DataFrame) -> DataFrame:
    """Each non-blank line and its `parts`, split once.

    The optimizer puts an expression wherever its column is read; behind a generator it is a value, however
    many fields and conditions read it.
    """
    whole = lines.select(F.explode(F.array("value")).alias("value")).filter(F.trim("value") != "")
    return whole.select("value", F.explode(F.array(F.split(F.trim("value"), ","))).alias("parts"))


def _parsed_raw(lines: DataFrame) -> DataFrame:
    """Each non-blank line with its 15 fields; `ok` unless type, time or vehicle is unreadable."""
    parts = F.col("parts")
    text = [F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")) for i in range(len(S.RAW_FIELDS))]
    readable = [
        text[S.RAW_FIELDS.index(f)].isNull() | text[S.RAW_FIELDS.index(f)].try_cast("int").isNotNull()
        for f in ("type", "time", "vid")
    ]
    fields = [
        F.coalesce(t.try_cast("int"), F.lit(0)).alias(f) for f, t in zip(S.RAW_FIELDS, text)
    ]
    ok = reduce(Column.__and__, readable).alias("ok")
    return _split(lines).select("value", ok, *fields)


def parse_raw(lines: DataFrame) -> DataFrame:
    """Raw 15-field lines. Missing fields, and unreadable ones that do not say what the report is,
    become 0; lines without readable type, time and vehicle are what `quarantine_raw` returns."""
    return _parsed_raw(lines).filter("ok").select(*S.RAW_FIELDS)


def quarantine_raw(lines: DataFrame) -> DataFrame:
    return _parsed_raw(lines).filter("not ok").select("value")


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_raw(spark.read.text(path))


def raw_to_reports(raw: DataFrame) -> DataFrame:
    """Reports with the fields of requests."""
    named = raw.withColumnRenamed("time", "simulated_time")
    return named.select(*S.REPORT_FIELDS, *S.REQUEST_FIELDS)


def _or_zero(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(0)


def to_raw_lines(reports: DataFrame) -> DataFrame:
    """Reports as raw text; request fields that are not there are 0."""
    named = reports.withColumnRenamed("simulated_time", "time")
    return named.select(F.concat_ws(",", *[_or_zero(named, f) for f in S.RAW_FIELDS]).alias("value"))


def to_wire(reports: DataFrame, wall_base_ms: int | None = 0) -> DataFrame:
    """Reports as wire text, sent `simulated_time` seconds after `wall_base_ms`, or now if None."""
    wall = F.unix_millis(F.current_timestamp())
    if wall_base_ms is not None:
        wall = F.lit(wall_base_ms).cast("long") + F.col("simulated_time").cast("long") * 1000
    fields = [wall if f == "wall_ms" else _or_zero(reports, f) for f in S.WIRE_FIELDS]
    return reports.select(F.concat_ws(",", *fields).alias("value"))


def read_wire(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def _parsed(lines: DataFrame) -> DataFrame:
    """Each non-blank line with its first ten fields; `ok` where all of them are numbers."""
    parts = F.col("parts")
    fields = [
        F.get(parts, F.lit(i)).try_cast("long" if f == "wall_ms" else "int").alias(f)
        for i, f in enumerate(S.WIRE_FIELDS[:10])
    ]
    more = [
        F.coalesce(F.trim(F.get(parts, F.lit(10 + i))).try_cast("int"), F.lit(0)).alias(f)
        for i, f in enumerate(S.REQUEST_FIELDS)
    ]
    all_numbers = reduce(Column.__and__, [F.col(f).isNotNull() for f in S.WIRE_FIELDS[:10]])
    return (
        _split(lines)
        .select("value", F.trim("value").rlike(_LINE).alias("shaped"), *fields, *more)
        .withColumn("ok", F.col("shaped") & all_numbers)
    )


def parse_wire(lines: DataFrame, requests: bool = False) -> DataFrame:
    """Reports of the readable lines, with the fields of requests if asked for (0 where they are
    missing); the other lines are what `quarantine` returns."""
    more = S.REQUEST_FIELDS if requests else []
    return _parsed(lines).filter("ok").select(*S.REPORT_FIELDS, *more, "wall_ms")


def quarantine(lines: DataFrame) -> DataFrame:
    return _parsed(lines).filter(~F.col("ok")).select("value")


def one_per_second(reports: DataFrame) -> DataFrame:
    """The model's contract: a vehicle sends at most one report of a type per second.

    Of several the least stays, by speed first, then the other columns in order.
    """
    keys = ["type", "vid", "simulated_time"]
    rest = [c for c in reports.columns if c not in keys]
    kept = reports.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("least"))
    return kept.select(*keys, "least.*").select(*reports.columns)


def union_sources(sources: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def read_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One source of wire text per path, all of them together."""
    return parse_wire(union_sources([read_wire(spark, p) for p in paths]))

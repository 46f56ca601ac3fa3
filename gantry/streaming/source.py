"""Report streams, and replay of a table as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry import functions as G
from gantry import schema as S
from gantry.sources.reports import parse_wire, to_wire, union_sources

# Key values of a row of no vehicle on no segment that only tells how far the feed has come. The
# events stage makes one for each closed window, and the others pass it on in event-time order.
NOBODY, NOWHERE = -1, -1


def line_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, fmt: str = "text",
    **options,
) -> DataFrame:
    """Lines of wire text from a folder; `fmt="socket"` with host and port reads a socket."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "socket":
        return reader.load()
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def report_stream(lines: list[DataFrame] | DataFrame) -> DataFrame:
    """Reports from one source or several."""
    sources = lines if isinstance(lines, list) else [lines]
    return parse_wire(union_sources(sources))


def table_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of the rows another query writes to `path`."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def state_of(
    spark: SparkSession, checkpoint: str, operator: int = 0, variable: str | None = None
) -> DataFrame:
    """What a stateful operator of a query remembers after its last batch: `key`, `value`, `partition_id`.

    Operators are numbered from the sink. `variable` names a state of a processor, as `trace` of vehicles.
    """
    reader = spark.read.format("statestore").option("operatorId", operator)
    if variable:
        reader = reader.option("stateVarName", variable)
    return reader.load(checkpoint)


def in_event_time(
    stream: DataFrame, delay: str, t: str = "simulated_time", beat: Column | None = None
) -> DataFrame:
    """The stream with its event time; a row for which `beat` holds stands for its whole second."""
    ts = G.event_time(t)
    if beat is not None:
        ts = F.when(beat, ts + F.expr("interval 999 milliseconds")).otherwise(ts)
    return stream.withColumn("ts", ts).withWatermark("ts", delay)


def heartbeats(spark: SparkSession, times: list[int]) -> DataFrame:
    nobody = {f: F.lit(0) for f in S.REPORT_FIELDS}
    nobody |= {"vid": F.lit(NOBODY), "xway": F.lit(NOWHERE), "seg": F.lit(NOWHERE)}
    one = spark.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in times])).alias("simulated_time"),
        *[c.alias(f) for f, c in nobody.items() if f != "simulated_time"],
    )
    return one.select(*S.REPORT_FIELDS)


def write_slices(
    reports: DataFrame, path: str, edges: list[int | None], files_per_slice: int = 1,
    wall_base_ms: int | None = 0,
) -> None:
    """Append the reports to a folder of wire text, one time slice after the other, so that a
    stream with `files_per_slice` files per trigger gets them in time order at a fixed rate. Each
    slice is written by as many tasks; `files_for` tells how many its rows ask for.

    `edges` are the slices' bounds [e0, e1), [e1, e2), ...; None for a first or last slice that
    is open.
    """
    t = F.col("simulated_time")
    for lo, hi in zip(edges, edges[1:]):
        part = reports if lo is None else reports.filter(t >= lo)
        part = part if hi is None else part.filter(t < hi)
        append_slice(part, path, files_per_slice, wall_base_ms)


def files_for(rows: int, rows_per_file: int = 1_000_000, least: int = 1) -> int:
    """Number of files for a slice of so many rows."""
    return max(least, -(-rows // rows_per_file))


def append_slice(
    reports: DataFrame, path: str, files: int = 1, wall_base_ms: int | None = 0
) -> None:
    """Append the reports as `files` files: what a slice lacks in rows it gets in empty lines, so that
    a stream with as many files per trigger takes just one slice at a time."""
    lines = to_wire(reports, wall_base_ms)
    lines = lines.withColumn("file", F.pmod(F.hash("value"), F.lit(files)))
    blank = reports.sparkSession.range(files).select(F.lit("").alias("value"), F.col("id").cast("int").alias("file"))
    # Rows that are dealt out in turn would be sorted before, so that a repeated task deals alike.
    dealt = lines.unionByName(blank).repartitionById(files, "file")
    dealt.select("value").write.mode("append").text(path)


def close_feed(spark: SparkSession, path: str, last: int, spacing: int = 86400, files: int = 1) -> None:
    """End a replay: a row of no vehicle far behind the last report lets every window close."""
    append_slice(heartbeats(spark, [last + spacing]), path, files)


def union_streams(streams: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)

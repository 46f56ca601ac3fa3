"""Starting queries and writing their results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gantry.functions.time import BASE_EPOCH

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stamped(notices: DataFrame) -> DataFrame:
    """Notices with the time of their emission."""
    return notices.withColumn("emit_wall_ms", F.unix_millis(F.current_timestamp()))


# Lists of a vehicle's reports are short, and a task meets many of them: by default it would sort its rows
# once it has met 128. This many of them are some 50 MB.
MANY_GROUPS = ("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
# Lists of several vehicles' reports grow with the traffic, and a task would hold all of its own on the heap, three
# times over: beyond this many it sorts rows, which may go to disk.
LONG_LISTS = (MANY_GROUPS[0], "1000")
# A batch commits what it changed, and whole copies of the state are uploaded in the background; keys are not
# counted, which would read each before it is written or removed.
#
# Memory of the stores lies outside the heap, and a store stays open between batches: so each commit also writes
# out what the store has buffered, and all stores of an executor share one bounded cache. Buffers are small, as
# once those of all running tasks fill their share of the memory, each write would flush one.
STORE = [
    ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"),
    ("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false"),
    ("spark.sql.streaming.stateStore.minDeltasForSnapshot", "1"),
    ("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true"),
    ("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "150"),
    ("spark.sql.streaming.stateStore.rocksdb.writeBufferCacheRatio", "0.8"),
    ("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", "4"),
]


@contextmanager
def _many_groups(spark: SparkSession, groups: tuple[str, str] = MANY_GROUPS) -> Iterator[None]:
    """A query that starts within keeps the settings, other jobs of the session do not have them."""
    before = [(name, spark.conf.get(name, None)) for name, _ in [groups, *STORE]]
    for name, value in [groups, *STORE]:
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before:
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _writer(df: DataFrame, checkpoint: str, trigger: str | None, mode: str = "append"):
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if trigger:
        return writer.trigger(processingTime=trigger)
    return writer.trigger(availableNow=True)


def to_files(
    df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger: str | None = None,
    groups: tuple[str, str] = MANY_GROUPS,
) -> StreamingQuery:
    """Write a stream to a folder; each batch appears there once and whole. Without `trigger`
    (as "1 second") the query takes what is there and ends. `groups` is LONG_LISTS where a list
    holds the reports of several vehicles."""
    with _many_groups(df.sparkSession, groups):
        return _writer(df, checkpoint, trigger).format(fmt).start(path)


def to_each_batch(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
    trigger: str | None = None, mode: str = "append",
) -> StreamingQuery:
    """Hand each batch to `write`; with mode "update" a batch holds the rows of state it changed."""
    with _many_groups(df.sparkSession):
        return _writer(df, checkpoint, trigger, mode).foreachBatch(write).start()


class LateReports(StreamingQueryListener):
    """Counts, over all batches of a session's queries, the rows that came behind a watermark.

    Register with `spark.streams.addListener`; `dropped` has a number per query id. Progress tells how many
    rows each operator refused: the one next to the source sees every late report.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event):
        progress = event.progress
        late = max((o.numRowsDroppedByWatermark for o in progress.stateOperators), default=0)
        self.dropped[str(progress.id)] = self.dropped.get(str(progress.id), 0) + late

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def count_batches(path: str, **counts: Column) -> Callable[[DataFrame, int], None]:
    """Batch writer of one row per batch: how many rows it has, by each of the conditions."""
    sums = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in counts.items()]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.agg(*sums).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def complete_until(query: StreamingQuery) -> int | None:
    """The second up to which the query's rows are complete: where its watermark stands."""
    last = query.lastProgress
    mark = last and last.eventTime.get("watermark")
    if not mark:
        return None
    return int(datetime.fromisoformat(mark.replace("Z", "+00:00")).timestamp()) - BASE_EPOCH


def append_batches(path: str, fmt: str = "csv") -> Callable[[DataFrame, int], None]:
    """Batch writer with one folder per batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")

    return write


def finish(query: StreamingQuery, timeout: int = 1800) -> StreamingQuery:
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream did not end in time")
    return query

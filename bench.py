"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gantry.plans.queries import batch_queries
from gantry.plans.streams import Replay
from gantry.session import get_session

HEADLINE = [
    "segment_stats", "segment_toll", "stop_intervals", "segment_accidents", "new_vehicles",
    "segment_crossings", "asof_toll", "notifications", "notifications_crossing",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = "8" if cpus == "*" else str(max(int(cpus), 1))
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=partitions,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = batch_queries()

    def run(name: str):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("notifications")  # warm up
    seconds = {name: timed(lambda: run(name)) for name in HEADLINE}

    # The same notifications from a replayed stream, without the time to write the feed.
    replay = Replay(spark, sf_dir)
    reports = replay.reports.count()
    replay.feed
    seconds["stream_events"] = timed(lambda: replay.events)
    seconds["stream_stats"] = timed(lambda: replay.history)
    seconds["stream_accidents"] = timed(lambda: replay.signals)
    seconds["stream_notices"] = timed(lambda: replay.notices)
    streamed = sum(v for k, v in seconds.items() if k.startswith("stream_"))

    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "reports": reports,
        "batch_reports_per_sec": round(reports / seconds["notifications"]),
        "stream_reports_per_sec": round(reports / streamed),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

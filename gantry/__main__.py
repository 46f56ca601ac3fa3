"""Run the pipeline: python -m gantry batch|stream ..."""

from __future__ import annotations

import argparse
import uuid

from gantry import sources as IO
from gantry.plans.notify import Pipeline, accident_notifications, toll_notifications
from gantry.rules import SegmentRules
from gantry.session import get_session
from gantry.streaming.job import Job
from gantry.streaming.sinks import complete_until


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gantry")
    parser.add_argument("--crossing", action="store_true", help="answer every segment crossing")
    parser.add_argument("--by-direction", action="store_true")
    modes = parser.add_subparsers(dest="mode", required=True)

    batch = modes.add_parser("batch", help="notices of stored reports, as CSV")
    batch.add_argument("out")
    batch.add_argument("inputs", nargs="+")
    batch.add_argument("--format", choices=["wire", "raw", "parquet"], default="wire")

    stream = modes.add_parser("stream", help="notices of folders that reports are written to")
    stream.add_argument("out")
    stream.add_argument("inputs", nargs="+", help="one folder of wire text per source")
    stream.add_argument("--interval", type=int, default=1000, help="milliseconds per batch")
    stream.add_argument("--delay", default="60 seconds", help="how late a report may be")
    stream.add_argument("--once", action="store_true", help="take what is there and end")
    stream.add_argument("--files", type=int, default=1000, help="files per batch and source, at most")
    for mode in (batch, stream):
        mode.add_argument("--stop-reports", type=int, default=5, help="identical reports that make a stop")
        mode.add_argument("--ttl", type=int, help="seconds after which a silent vehicle is new again")
    return parser


def read(spark, inputs: list[str], fmt: str, out: str):
    """Reports of the inputs, one per vehicle and second, written once for all stages.

    Lines that are not reports go to `out`/quarantine.
    """
    if fmt == "parquet":
        reports = spark.read.parquet(*inputs)
    else:
        lines = spark.read.text(inputs)
        raw = fmt == "raw"
        reports = IO.raw_to_reports(IO.parse_raw(lines)) if raw else IO.parse_wire(lines)
        bad = IO.quarantine_raw(lines) if raw else IO.quarantine(lines)
        bad = IO.tap(bad, f"{out}/quarantine", "text")
        if n := bad.count():
            print(f"{n} lines are not reports: {out}/quarantine")
    return IO.tap(IO.one_per_second(reports), f"{out}/reports")


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    rules = SegmentRules(
        entry_mode="crossing" if args.crossing else "first", direction_aware=args.by_direction,
        stop_reports=args.stop_reports, vehicle_ttl=args.ttl,
    )
    spark = get_session()
    if args.mode == "batch":
        enriched = IO.tap(
            Pipeline(read(spark, args.inputs, args.format, args.out), rules,
                     workdir=f"{args.out}/work-{uuid.uuid4().hex}").enriched,
            f"{args.out}/enriched",
        )
        IO.notice_csv(toll_notifications(enriched, rules), f"{args.out}/tolls")
        IO.notice_csv(accident_notifications(enriched, rules), f"{args.out}/accidents")
        return
    trigger = None if args.once else f"{args.interval} milliseconds"
    queries = Job(spark, args.inputs, args.out, rules, trigger, args.delay, args.files).start()
    if trigger:
        spark.streams.awaitAnyTermination()
    else:
        print(f"notices are complete up to second {complete_until(queries['notices'])}")


if __name__ == "__main__":
    main()

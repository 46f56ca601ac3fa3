"""Thresholds and options of the tolling rules, shared by batch and streaming code."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SegmentRules:
    # Fixed values of the tolling rules.
    stop_reports: int = 5  # identical reports that make a stop
    upstream: int = 4  # segments before an accident that are affected too
    segments: int = 100  # of an expressway; none lies ahead of the last
    exit_lane: int = 4  # vehicles here get no accident notice
    lav_minutes: int = 4  # preceding minutes in the average velocity
    free_speed: float = 40  # at or above this average the segment is free
    free_nov: int = 50  # up to this many vehicles the segment is free
    toll_factor: int = 2

    # Options.
    direction_aware: bool = False  # dir joins the segment key; upstream is seg+i for dir 1
    entry_mode: str = "first"  # "first" sight per segment, or "crossing" of a segment border
    stop_scope: str = "vehicle"  # "segment": leaving the segment does not end a stop
    notice_delay_minutes: int = 0  # minutes between accident start and the first notice
    pair_gap: int | None = None  # seconds after its last report a stop still counts
    vehicle_ttl: int | None = None  # seconds after which a silent vehicle is new again
    lav_keep_stale: bool = False  # old minutes leave the average only when minute+5 reports

    # Work distribution. None of these changes a result.
    chunk_seconds: int = 1800  # a vehicle's trace is split into pieces of this length
    vehicle_salts: int = 32  # shares a segment-minute with many vehicles is split into
    join_salts: int = 8  # copies of the small side of a join on busy segments

    def __post_init__(self):
        if self.entry_mode not in ("first", "crossing"):
            raise ValueError(f"entry_mode: {self.entry_mode}")
        if self.stop_scope not in ("vehicle", "segment"):
            raise ValueError(f"stop_scope: {self.stop_scope}")

    @property
    def segment_cols(self) -> list[str]:
        return ["xway", "dir", "seg"] if self.direction_aware else ["xway", "seg"]

    @property
    def trace_cols(self) -> list[str]:
        """Key within which a vehicle's reports are compared with the one before."""
        return ["vid"] if self.stop_scope == "vehicle" else [*self.segment_cols, "vid"]


DEFAULT_RULES = SegmentRules()

"""Variable-toll expressway analytics on Spark: statistics, accidents, tolls and notifications."""

from gantry.rules import SegmentRules

__all__ = ["SegmentRules"]

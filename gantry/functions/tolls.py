"""Toll formula."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gantry.rules import DEFAULT_RULES, SegmentRules


def toll_of(lav: Column, nov: Column, rules: SegmentRules = DEFAULT_RULES) -> Column:
    """Congestion toll: nothing while traffic flows or is thin, else growing with the square."""
    over = nov - F.lit(rules.free_nov)
    busy = (lav < rules.free_speed) & (over > 0)
    return F.when(busy, over * over * F.lit(rules.toll_factor)).otherwise(F.lit(0)).cast("long")


def whole(x: Column) -> Column:
    """Whole number towards zero."""
    return x.cast("int")

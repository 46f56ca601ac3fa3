"""Segment keys, blocks and salts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: neighbouring segments that share a block.
BLOCK_SEGMENTS = 4


def segment_key() -> Column:
    """Display form of a segment; joins and groupings use the two int columns."""
    return F.concat_ws("_", "xway", "seg")


def key_xway(key: str) -> Column:
    return F.split_part(F.col(key), F.lit("_"), F.lit(1)).cast("int")


def key_seg(key: str) -> Column:
    return F.split_part(F.col(key), F.lit("_"), F.lit(2)).cast("int")


def segment_block(blocks: int) -> Column:
    """Block of a segment: neighbours together, expressways shifted by one."""
    return ((F.col("xway") + F.floor(F.col("seg") / BLOCK_SEGMENTS)) % blocks).cast("int")


def salt_of(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")

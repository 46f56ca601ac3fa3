"""Column expressions."""

from gantry.functions.keys import key_seg, key_xway, salt_of, segment_block, segment_key
from gantry.functions.time import chunk_of, event_time, minute_of, minute_start
from gantry.functions.tolls import toll_of, whole

__all__ = [
    "chunk_of", "event_time", "key_seg", "key_xway", "minute_of", "minute_start", "salt_of",
    "segment_block", "segment_key", "toll_of", "whole",
]

"""Record layouts."""

from pyspark.sql import types as T

# Field order of the two text formats.
RAW_FIELDS = [
    "type", "time", "vid", "speed", "xway", "lane", "dir", "seg", "pos",
    "qid", "sinit", "send", "dow", "tod", "day",
]
WIRE_FIELDS = [
    "type", "wall_ms", "vid", "speed", "xway", "lane", "dir", "seg", "pos", "simulated_time",
    "qid", "sinit", "send", "dow", "tod", "day",
]
REQUEST_FIELDS = ["qid", "sinit", "send", "dow", "tod", "day"]

# Record types.
POSITION, ACCOUNT_BALANCE, DAILY_EXPENDITURE, TRAVEL_TIME = 0, 2, 3, 4

# Notification kinds.
TOLL_KIND, ACCIDENT_KIND = 0, 1

REPORT_FIELDS = [f for f in WIRE_FIELDS[:10] if f != "wall_ms"]

RAW = T.StructType([T.StructField(f, T.IntegerType()) for f in RAW_FIELDS])
REPORT = T.StructType(
    [T.StructField(f, T.IntegerType()) for f in REPORT_FIELDS]
    + [T.StructField("wall_ms", T.LongType())]
)

"""Bloom filters of a bounded size over hashes that lie in many partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK = 1 << 14  # bytes that are merged at a time


def filter_bits(entries: int, each: int, most: int) -> int:
    """A power of two: `each` bits per entry, but at most `most`."""
    return min(most, max(1 << 17, 1 << (max(1, entries) * each - 1).bit_length()))


def positions(hashed: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k bits of each hash, in k rows; bits is a power of two."""
    h = hashed.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    i = np.arange(k, dtype=np.uint64)[:, None]
    return ((h + i * step) & np.uint64(bits - 1)).astype(np.int64)


def holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.all(bitmap[at >> 3] & (1 << (at & 7)).astype(np.uint8), axis=0)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> 3).ravel(), (1 << (at & 7)).astype(np.uint8).ravel())


def seen(hashes: DataFrame, bits: int, k: int, times: int) -> bytes:
    """The filter of hashes that `times` (1 or 2) rows of `hashes` (array column `h`) hold, and some others.

    A task fills two filters, for hashes seen once and seen twice; what two tasks have seen once has
    been seen twice. As many tasks as there are cores fill filters, and the filter that reaches the
    driver is of a fixed size.
    """

    def build(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for frame in batches:
            for part in range(0, len(frame), 1000):
                lists = [x for x in frame["h"].iloc[part:part + 1000] if len(x)]
                if not lists:
                    continue
                values, n = np.unique(np.concatenate(lists), return_counts=True)
                at = positions(values, bits, k)
                put(twice, at[:, (n > 1) | holds(once, at)])
                put(once, at)
        for b in range(0, bits // 8, BLOCK):
            yield pd.DataFrame({"b": [b], "once": [once[b:b + BLOCK].tobytes()], "twice": [twice[b:b + BLOCK].tobytes()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        once = twice = None
        for a, b in zip(frame["once"], frame["twice"]):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        return pd.DataFrame({"b": frame["b"].iloc[:1], "bits": [(once if times == 1 else twice).tobytes()]})

    built = hashes.select("h").coalesce(max(1, hashes.sparkSession.sparkContext.defaultParallelism))
    built = built.mapInPandas(build, "b long, once binary, twice binary")
    bitmap = bytearray(bits // 8)
    for row in built.groupBy("b").applyInPandas(merge, "b long, bits binary").toLocalIterator():
        bitmap[row.b:row.b + len(row.bits)] = row.bits
    return bytes(bitmap)

"""Best-fit packing by large-item matching, planned on the counts of lengths.

1. Each text is turned into token ids once, where it is read; only the pieces' lengths and checksums
   go on (their ids, too, if asked for).
2. Pieces of one length are interchangeable, so the plan needs nothing but how many there are of
   each length: at most `capacity` numbers, whatever the input. Pieces above a third of the capacity
   go at most two to a sequence: the longest takes the longest partner that fits. The smaller ones,
   longest first, go where they leave the least room, and open new sequences only where none fits.
3. The plan gives each length ranges of ranks; a piece's rank within its length (counted per share
   of the pieces, then summed over the shares) finds its sequence and its place there.

Defined results: a null or empty text is the end id alone; rows with a null or repeated doc_id are
packed like any other; an empty table gives an empty result; other columns are not passed on.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry.llm.common import read, saved

END_OF_TEXT = "<|endoftext|>"


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    end_id: int = 0
    #: the tokenizer's file, and the same vocabulary as ranks for the faster library
    tokenizer: str = "byte_bpe_50k.json"
    ranks: str = "byte_bpe_50k.tiktoken"
    end_of_text_id: int = 50256
    #: pieces in a share whose ranks are counted together
    share: int = 100_000


_ENCODERS: dict[Packing, object] = {}


def encoder(rules: Packing):
    """text -> ids of rules.tokenizer without added special tokens; one per Python worker.

    Both libraries give the same ids; a text that the faster one refuses (a million blanks in a row)
    goes to the other.
    """
    if rules not in _ENCODERS:
        import os

        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(public_tokenizers.path(rules.ranks), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={END_OF_TEXT: rules.end_of_text_id})

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:  # so rare that the tokenizer is read anew each time
                slow = Tokenizer.from_file(public_tokenizers.path(rules.tokenizer))
                return slow.encode(text, add_special_tokens=False).ids

        _ENCODERS[rules] = encode
    return _ENCODERS[rules]


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces: all of full length but the first, which may be shorter."""
    first = (len(ids) - 1) % capacity + 1
    starts = [0, *range(first, len(ids), capacity)]
    return [(a, ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)])]


def pieces(docs: DataFrame, rules: Packing = Packing(), keep_ids: bool = False,
           text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""

    def tokenized(batches):
        encode = encoder(rules)
        for frame in batches:
            out = []
            for key, value in zip(frame["doc_id"], frame["text"]):
                ids = np.array([*(encode(value) if value else ()), rules.end_id], "<u4")
                for n, (start, part) in enumerate(cut(ids, rules.capacity)):
                    row = (key, n, start, len(part), zlib.crc32(part.tobytes()))
                    out.append((*row, part.astype(np.int64)) if keep_ids else row)
            made = pd.DataFrame(out, columns=names)
            made["doc_id"] = pd.array(made["doc_id"], dtype="Int64")
            yield made

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Ids travel as decimals so that a null does not turn the column into floats.
    source = source.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return source.mapInPandas(
        lambda batches: tokenized(_with_ids(batches)), schema)


def _with_ids(batches):
    for frame in batches:
        yield frame.assign(doc_id=[None if x is None else int(x) for x in frame["doc_id"]])


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) for counts of lengths."""
    left = {k: v for k, v in counts.items() if v}
    gaps: dict[int, list] = defaultdict(list)  # room left -> [(lengths, sequences)]

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        fit = bisect_left(large, capacity - a + 1) - 1  # the longest partner that fits
        b = large[fit] if fit >= 0 else 0
        if not b or (a == b and left[a] == 1):
            # A length paired with itself may leave one over, whose partner is the next shorter.
            b = large[fit - 1] if b and fit else 0
        if not b:
            gaps[capacity - a].append(((a,), left[a]))
            left[a] = 0
        else:
            n = left[a] // 2 if a == b else min(left[a], left[b])
            gaps[capacity - a - b].append(((a, b), n))
            left[a] -= n
            left[b] -= n
        large = [k for k in large if left[k]]

    open_gaps = sorted(k for k in gaps if k)
    done = gaps.pop(0, [])

    def add(gap: int, lengths: tuple[int, ...], n: int) -> None:
        if not gap:
            done.append((lengths, n))
            return
        if not gaps[gap]:
            insort(open_gaps, gap)
        gaps[gap].append((lengths, n))

    for size in sorted((k for k in left if left[k]), reverse=True):
        n = left[size]
        while n:
            at = bisect_left(open_gaps, size)
            if at < len(open_gaps):
                gap = open_gaps[at]
                lengths, bins = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
            else:
                gap, lengths, bins = capacity, (), -(-n // (capacity // size))
            each = gap // size
            full = min(bins, n // each)
            if full:
                add(gap - each * size, lengths + (size,) * each, full)
                n -= full * each
                bins -= full
            if n and bins:
                add(gap - n * size, lengths + (size,) * n, 1)
                n, bins = 0, bins - 1
            if bins and lengths:
                add(gap, lengths, bins)
    done.extend(x for v in gaps.values() for x in v)
    return done


def ranges(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) in the order of ranks."""
    out: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, n in runs:
        offset = 0
        for size in lengths:
            out[size].append((used[size], base, offset))
            used[size] += n
            offset += size
        base += n
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(cut_pieces: DataFrame, rules: Packing = Packing()) -> DataFrame:
    """`cut_pieces` (as of pieces()) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    total = cut_pieces.count()
    shares = max(1, -(-total // rules.share))
    order = ["doc_id", "piece", "ids_crc32"]
    shared = cut_pieces.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(shares)))
    counted = saved(shared.groupBy("length", "_share").count(), "length_counts")
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = spark.sparkContext.broadcast(ranges(plan(counts, rules.capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for size in np.unique(lengths):
            mine = np.flatnonzero(lengths == size)
            rows = places.value[size]
            at = np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1
            sequence[mine] = rows[at, 1] + ranks[mine] - rows[at, 0]
            offset[mine] = rows[at, 2]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = W.partitionBy("length").orderBy("_share").rowsBetween(W.unboundedPreceding, -1)
    starts = counted.select("length", "_share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("length", "_share").orderBy(*order)) - 1
    ranked = shared.withColumn("_within", within).join(starts, ["length", "_share"])
    placed = ranked.withColumn("_place", place("length", (F.col("_before") + F.col("_within")).cast("long")))
    return placed.select(*cut_pieces.columns, "_place.sequence_id", "_place.offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(saved(pieces(read(spark, sf_dir, "documents")), "pieces"))

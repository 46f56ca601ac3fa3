"""Importance resampling towards a target text, with an exact cutoff found by counting jobs.

1. A text's features, runs of 1 to `orders` words, fall into buckets by checksum. Bucket counts of all
   documents and of all target texts (an array of fixed size each) give every bucket a gain, the
   rounded log of its share in the target over its share in the documents.
2. A document's weight is the sum of its features' gains, looked up in that array; its score adds
   Gumbel noise drawn from its id, so that the highest scores are a draw without replacement.
3. Scores are written once. The cutoff is found by bisection: each job counts, exactly, the rows up to
   several thresholds between the bounds left. Rows that tie on the score are cut by doc_id, those
   that tie on that, too, by their place in the written table.
4. The rows drawn are range-partitioned in order; a partition's start is the sum of those before it.

Nothing but the counts, bounded by the buckets and the partitions, reaches the driver; no row is
compared with another.

Defined results: a null text has no words; the noise of a null doc_id is that of the text `null`, and
it comes after other ids in ties; rows that repeat a doc_id count, and may be drawn, each; no target
text or an empty table is fine; columns passed on that are named as a result are replaced.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.common import read, saved, whole_text

#: Bytes of a text that belong to words, A-Z in lower case; all others part words.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Features counted at a time, about 16 MB.
BATCH_FEATURES = 1 << 21
#: Bits below a partition's number in monotonically_increasing_id().
ROW_BITS = 33


@dataclass(frozen=True)
class Resampling:
    orders: int = 3
    buckets: int = 10_000
    percent: int = 5  # of the documents with at least min_words
    min_words: int = 20
    seed: int = 42
    probes: int = 15  # thresholds that a job counts


def buckets_of(text: str, rules: Resampling) -> tuple[int, np.ndarray]:
    """(words, bucket of each feature)."""
    words = text.encode().translate(LETTERS).split()
    further = [b" " + w for w in words]
    found, last = [], map(crc32, words)
    for n in range(1, rules.orders + 1):
        # The checksum of a run goes on from that of the run without its last word.
        last = list(last if n == 1 else map(crc32, further[n - 1:], last))
        found.append(last)
    total = sum(map(len, found))
    return len(words), np.fromiter(chain(*found), np.int64, total) % rules.buckets


def bucket_counts(docs: DataFrame, rules: Resampling, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        total, waiting, n = np.zeros(rules.buckets, np.int64), [], 0
        for frame in batches:
            for value in frame["text"]:
                waiting.append(buckets_of(value, rules)[1])
                n += len(waiting[-1])
                if n > BATCH_FEATURES:
                    total += np.bincount(np.concatenate(waiting), minlength=rules.buckets)
                    waiting, n = [], 0
        if n:
            total += np.bincount(np.concatenate(waiting), minlength=rules.buckets)
        full = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": full, "n": total[full]})

    parts = docs.select(whole_text(text).alias("text")).mapInPandas(count, "bucket long, n long")
    counts = np.zeros(rules.buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, both counts smoothed by one per bucket."""
    own, other = int(docs.sum()) + len(docs), int(target.sum()) + len(target)
    return np.array([
        math.floor(1000 * math.log((t + 1) * own / ((s + 1) * other))) for s, t in zip(docs.tolist(), target.tolist())
    ], np.int64)


def noise(doc_id: str, rules: Resampling) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{rules.seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores_of(gain: np.ndarray, rules: Resampling, text: str, doc_id: str) -> Column:
    """Struct of n_words, n_features, weight and score."""

    @F.pandas_udf("n_words long, n_features long, weight long, score long")
    def score(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        out = []
        for value, key in zip(texts, ids):
            n, found = buckets_of(value, rules)
            weight = int(gain[found].sum())
            out.append((n, len(found), weight, weight + noise(key, rules)))
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight", "score"])

    return score(whole_text(text), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))


def least_reaching(rows: DataFrame, key: str, wanted: int, probes: int) -> tuple[int, int, int]:
    """(v, rows below v, rows up to v) for the least v such that at least `wanted` rows have key <= v.

    Each job counts the rows up to `probes` thresholds; the next one goes on between the two around v.
    """
    lo, hi, upto = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    below = 0
    while lo < hi:
        points = sorted({lo + (hi - lo) * j // (probes + 1) for j in range(1, probes + 1)})
        within = rows.filter(F.col(key).between(lo, hi))
        counts = within.agg(*(F.sum((F.col(key) <= p).cast("long")) for p in points)).first()
        start = below
        for p, n in zip(points, counts):
            if start + (n or 0) >= wanted:
                hi, upto = p, start + n
                break
            lo, below = p + 1, start + (n or 0)
    return lo, below, upto


def first_rows(rows: DataFrame, keys: list[str], wanted: int, probes: int) -> Column:
    """Condition for the `wanted` first rows in order of the integer `keys`; the last is unique."""
    chosen, tied = F.lit(False), F.lit(True)
    for key in keys:
        if not wanted:
            break
        v, below, upto = least_reaching(rows.filter(tied), key, wanted, probes)
        if upto == wanted:
            return chosen | (tied & (F.col(key) <= v))
        chosen, tied = chosen | (tied & (F.col(key) < v)), tied & (F.col(key) == v)
        wanted -= below
    return chosen


def resampled(docs: DataFrame, target: DataFrame, rules: Resampling = Resampling(), keep: list[str] | None = None,
              text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """Every document with n_words, n_features, weight, score and rank (null: not drawn).

    `keep` names the columns that are passed on; all if None. `filter("rank is not null")` is the sample.
    """
    made = ["n_words", "n_features", "weight", "score"]
    gain = gains(bucket_counts(docs, rules, text), bucket_counts(target, rules, target_text))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (*made, "rank")]
    inputs = docs.select(
        F.struct(*kept).alias("_row"), F.col(doc_id).cast("long").alias("_id"),
        scores_of(gain, rules, text, doc_id).alias("_made"))
    order = ["_down", "_no_id", "_given", "_place"]
    rows = saved(inputs.select("_row", "_made.*", (-F.col("_made.score")).alias("_down"),
                               F.col("_id").isNull().cast("int").alias("_no_id"),
                               F.coalesce("_id", F.lit(0)).alias("_given"),
                               F.monotonically_increasing_id().alias("_place")), "scores")

    able = rows.filter(F.col("n_words") >= rules.min_words)
    wanted = rules.percent * able.count() // 100
    chosen = (F.col("n_words") >= rules.min_words) & first_rows(able, order, wanted, rules.probes)
    ranged = rows.filter(chosen).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = saved(ranged.withColumn("_at", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("_at", ROW_BITS)
    sizes = {r.part: r.n for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, before = [], 0
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(before)]
        before += sizes[p]
    start = F.create_map(*starts)[part] if starts else F.lit(0)
    rank = (start + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1).cast("long")
    columns = ["_row.*", *made]
    rest = rows.filter(~chosen).select(*columns, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(ranged.select(*columns, rank.alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampled(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: Checksums go on byte by byte from a table that the SQL makes; a run's follows from that of the run
#: without its last word, moved on by as many zero bytes as the word adds.
OP11_SQL = """
with recursive
step as (select b, list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), b) as v
         from (select unnest(range(256)) as b)),
texts as (select 0 as side, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
lists as (
  select side, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as l from texts),
places as (select side, id, unnest(l) as word, generate_subscripts(l, 1) as i from lists),
bytes as (select distinct word, hex(encode(word)) as h from places),
read(word, h, i, f, z) as (
  select word, h, 0, 4294967295::bigint, (select v from step where b = 32) from bytes
  union all
  select r.word, r.h, r.i + 1, xor(r.f >> 8, s1.v), xor(r.z >> 8, s2.v)
  from (select *, ('0x' || h[2 * i + 1:2 * i + 2])::bigint as byte from read where 2 * i < length(h)) r
  join step s1 on s1.b = xor(r.f, r.byte) & 255 join step s2 on s2.b = xor(r.z, r.byte) & 255),
vocabulary as (select word, f, z, i + 1 as n from read where 2 * i = length(h)),
runs as (
  select p.side, p.id, v.f, lead(v.z) over w as z2, lead(v.n) over w as n2,
         lead(v.z, 2) over w as z3, lead(v.n, 2) over w as n3
  from places p join vocabulary v using (word) window w as (partition by side, id order by i)),
moved2(f, n, c, k) as (
  select f, n2, f, n2 from (select distinct f, n2 from runs where n2 is not null)
  union all select m.f, m.n, xor(m.c >> 8, s.v), m.k - 1 from moved2 m join step s on s.b = m.c & 255 where m.k > 0),
two as (
  select r.*, xor(m.c, r.z2) as f2 from runs r left join (select f, n, c from moved2 where k = 0) m
  on m.f = r.f and m.n = r.n2),
moved3(f, n, c, k) as (
  select f2, n3, f2, n3 from (select distinct f2, n3 from two where n3 is not null)
  union all select m.f, m.n, xor(m.c >> 8, s.v), m.k - 1 from moved3 m join step s on s.b = m.c & 255 where m.k > 0),
three as (
  select t.*, xor(m.c, t.z3) as f3 from two t left join (select f, n, c from moved3 where k = 0) m
  on m.f = t.f2 and m.n = t.n3),
features as (
  select side, id, xor(c, 4294967295) % 10000 as bucket from (
    select side, id, f as c from three union all select side, id, f2 from three union all select side, id, f3 from three)
  where c is not null),
counts as (
  select b.bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t
  from (select unnest(range(10000)) as bucket) b left join features f on f.bucket = b.bucket group by b.bucket),
gains as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double
                                 / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from counts),
weights as (
  select id, count(*) as n_features, sum(gain)::bigint as weight
  from features join gains using (bucket) where side = 0 group by id),
scores as (
  select l.id as doc_id, len(l.l) as n_words, coalesce(w.n_features, 0) as n_features, coalesce(w.weight, 0)::bigint as weight,
         (coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || l.id)[1:8])::bigint + 0.5::double)
                                                       / 4294967296::double))))::bigint as score
  from lists l left join weights w using (id) where l.side = 0),
ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n
  from scores where n_words >= 20)
select s.doc_id, s.n_features, s.weight, s.score, r.rank
from scores s left join (select doc_id, rank from ranked where rank <= 5 * n // 100) r using (doc_id)
"""

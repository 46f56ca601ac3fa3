"""Periodic runs of words by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q, at least `repeats` periods and `min_length` words
long, that neither neighbour extends. In each text, whose words are numbered:

1. The grid: a run of period p makes more than 3p words in a row equal to those p further on. For every
   p, points half that stretch apart are tested on the few words that one of them must agree in, n/p
   points for period p and n log n for all.
2. Points that pass are extended both ways by longest common extensions (LCE). Only suffixes at places
   whose remainder modulo `cover` lies in a difference cover are sorted, by doubling. Two places
   reach, by the same number of steps (less than `cover`), two sorted suffixes: these few words are
   compared, and the rest is a range minimum over the common prefixes of neighbours, by a sparse table.
   The way back is the same over the reversed text. The tables are made only where points pass.
3. Several periods that give one stretch are multiples of the least, which stays.

Rows do not meet: texts are treated where they are read, in time and memory n log n of their words.

Defined results: a null text has no words and no runs; a text shorter than min_length has no runs; other
columns are passed on, those named as a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import let, read, whole_text, words

#: Perfect difference sets; every remainder is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
#: Grid points tested at a time.
POINTS = 1 << 20


@dataclass(frozen=True)
class RunRules:
    repeats: int = 4
    min_length: int = 6
    cover: int = 31
    tested: int = 4  # words at a grid point, fewer where the period is short


class Extensions:
    """lce(i, j), the number of words in which the suffixes at i and j (i != j) agree, for arrays."""

    def __init__(self, x: np.ndarray, cover: int):
        self.n, self.m = len(x), cover
        self.x = np.concatenate([x, np.full(2 * cover, -1, x.dtype)])  # no word behind the end
        members = np.array(COVERS[cover])
        self.reach = np.empty(cover, np.int64)  # by the remainder of j - i: a place of i in the cover, and so of j
        for a in members:
            self.reach[(members - a) % cover] = a
        self.table = None

    def _build(self) -> None:
        m, n = self.m, self.n
        inside = np.zeros(m, bool)
        inside[list(COVERS[m])] = True
        at = np.flatnonzero(inside[np.arange(n) % m])
        index = np.full(n, -1)
        index[at] = np.arange(len(at))
        blocks = np.ascontiguousarray(self._words(at).astype(">i4")).view(f"V{4 * m}").ravel()
        rank, levels, step = np.unique(blocks, return_inverse=True)[1].astype(np.int64), [], m
        while True:
            levels.append((step, rank))
            if rank.max(initial=0) + 1 >= len(at):
                break
            then = self._later(index, rank, at, step)
            rank = np.unique(rank * (len(at) + 1) + then + 1, return_inverse=True)[1].astype(np.int64)
            step *= 2
        order = np.empty(len(at), np.int64)
        order[rank] = np.arange(len(at))

        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(a), np.int64)
        for step, ranks in reversed(levels):
            left, right = self._later(index, ranks, a + common, 0), self._later(index, ranks, b + common, 0)
            common += np.where((left == right) & (left >= 0), step, 0)
        common += self._first_difference(a + common, b + common)
        self.index, self.rank, self.table = index, rank, [common]
        width = 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    @staticmethod
    def _later(index, rank, at, step) -> np.ndarray:
        """Rank of the sorted suffix `step` behind each place, -1 behind the end."""
        there = at + step
        inside = there < len(index)
        return np.where(inside, rank[index[np.where(inside, there, at[0] if len(at) else 0) % len(index)]], -1)

    def _words(self, at: np.ndarray) -> np.ndarray:
        return self.x[np.minimum(at, self.n)[:, None] + np.arange(self.m)]

    def _first_difference(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in which i and j agree, up to m."""
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), POINTS // self.m):
            part = slice(k, k + POINTS // self.m)
            other = self._words(i[part]) != self._words(j[part])
            out[part] = np.where(other.any(axis=1), other.argmax(axis=1), self.m)
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        steps = (self.reach[(j - i) % self.m] - i) % self.m
        agree = self._first_difference(i, j)
        out = np.minimum(agree, steps)
        on = np.flatnonzero((agree >= steps) & (np.maximum(i, j) + steps < self.n))
        if len(on):
            if self.table is None:
                self._build()
            a, b = self.rank[self.index[i[on] + steps[on]]], self.rank[self.index[j[on] + steps[on]]]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            level = np.log2(hi - lo).astype(np.int64)
            least = np.empty(len(on), np.int64)
            for k in np.unique(level):
                here = level == k
                least[here] = np.minimum(self.table[k][lo[here]], self.table[k][hi[here] - (1 << k)])
            out[on] += least
        return out


def _points(x: np.ndarray, rules: RunRules):
    """(period, place) of grid points whose first words agree with those a period further on."""
    n = len(x)
    p = np.arange(1, n // rules.repeats + 1)
    stretch = np.maximum(rules.min_length, rules.repeats * p) - p  # equal words in a row, at least
    gap = (stretch + 1) // 2
    many = np.maximum(n - p - 1, 0) // gap + 1
    for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(np.cumsum(many) // POINTS)) + 1):
        period = np.repeat(p[part], many[part])
        place = np.arange(len(period)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
        place *= np.repeat(gap[part], many[part])
        needed = np.repeat(np.minimum(stretch - gap + 1, rules.tested)[part], many[part])
        for t in range(rules.tested):
            other = place + period + t
            good = (needed <= t) | ((other < n) & (x[np.minimum(place + t, n - 1)] == x[np.minimum(other, n - 1)]))
            period, place, needed = period[good], place[good], needed[good]
        if len(period):
            yield period, place


def runs_of(x: np.ndarray, rules: RunRules = RunRules()) -> np.ndarray:
    """Rows (start, length, period) of all runs of the numbered words, by start, then period."""
    n = len(x)
    found = [np.empty((0, 3), np.int64)]
    ahead = back = None
    for period, place in _points(x, rules) if n >= rules.min_length else ():
        if ahead is None:
            ahead, back = Extensions(x, rules.cover), Extensions(x[::-1].copy(), rules.cover)
        stop = place + period + ahead.lce(place, place + period)
        # From the word before each place; the first word has none.
        start = place - np.where(place > 0, back.lce(n - place, n - place - period), 0)
        long = stop - start >= np.maximum(rules.min_length, rules.repeats * period)
        found.append(np.column_stack([start, stop - start, period])[long])
    rows = np.unique(np.concatenate(found), axis=0)
    # Rows are in order: of equal stretches the least period comes first, and stays.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort([rows[:, 2], rows[:, 0]])]


def collapsed(found: list[bytes], runs: np.ndarray) -> str:
    """The words without those that a run repeats from its first period."""
    if len(runs):
        depth = np.zeros(len(found) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        found = [w for w, d in zip(found, np.cumsum(depth).tolist()) if not d]
    return b" ".join(found).decode()


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
ARROW_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _found(text: str, rules: RunRules) -> tuple[list[dict], str]:
    found = text.encode().split()  # parts at blanks and code points 9 to 13 only
    number: dict[bytes, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found))
    runs = runs_of(x, rules)
    return [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()], collapsed(found, runs)


def periodic_runs(docs: DataFrame, rules: RunRules = RunRules(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with `runs`, an array of (start, length, period) by start, then period, and `collapsed`,
    the text without what runs repeat. `keep` names the columns that are passed on; all if None."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("runs", "collapsed")]
    inputs = docs.select(F.struct(*kept).alias("row"), whole_text(text).alias("text"))
    schema = T.StructType([inputs.schema["row"], T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches):
        for batch in batches:
            found = [_found(value, rules) for value in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([r for r, _ in found], ARROW_RUNS), pa.array([c for _, c in found], pa.string()),
            ], ["row", "runs", "collapsed"])

    return inputs.mapInArrow(run, schema).select("row.*", "runs", "collapsed")


def with_planted_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` where one text in ten, chosen by id, repeats itself from some word on."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(
            w, F.when(i >= a, a + (i - a) % p).otherwise(i))), " ")

    planted = let(words(whole_text(text)), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))
    return docs.withColumn(text, F.when(h % 10 == 0, planted).otherwise(F.col(text)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs, keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: From equal words of a text, joined with each other, to stretches of equal distance.
OP12_SQL = """
with recursive
step as (select b, list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), b) as v
         from (select unnest(range(256)) as b)),
checksum(doc_id, s, i, c) as (
  select doc_id, doc_id::varchar, 1, 4294967295::bigint from documents
  union all
  select k.doc_id, k.s, k.i + 1, xor(k.c >> 8, t.v)
  from checksum k join step t on t.b = xor(k.c, ascii(k.s[k.i])) & 255 where k.i <= length(k.s)),
lists as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as l,
         xor(c, 4294967295) as h
  from documents join checksum using (doc_id) where i = length(s) + 1),
sizes as (select doc_id, l, h, len(l) as n, (h // 10) % greatest(len(l), 1) as a from lists),
planned as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from sizes),
original as (select doc_id, unnest(l) as word, generate_subscripts(l, 1) - 1 as i from planned),
places as (
  select doc_id, n, i, case when h % 10 = 0 and i >= a then a + (i - a) % p else i end as at
  from (select doc_id, n, h, a, p, unnest(range(n)) as i from planned)),
x as (select p.doc_id, p.n, p.i, o.word from places p join original o on o.doc_id = p.doc_id and o.i = p.at),
same as (
  select a.doc_id, a.i, b.i - a.i as p from x a join x b on a.doc_id = b.doc_id and a.word = b.word
  where b.i > a.i and 4 * (b.i - a.i) <= a.n),
stretches as (
  select doc_id, p, min(i) as s, max(i) + p + 1 as e
  from (select *, i - row_number() over (partition by doc_id, p order by i) as g from same)
  group by doc_id, p, g having max(i) + p + 1 - min(i) >= greatest(6, 4 * p)),
runs as (select doc_id, s, e - s as l, min(p) as p from stretches group by doc_id, s, e),
best as (
  select doc_id, s, l, p from runs
  qualify row_number() over (partition by doc_id order by l desc, s, p) = 1),
told as (
  select doc_id, count(*) as n, string_agg(s || ',' || l || ',' || p || chr(10), '' order by s, p) as lines
  from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(s + p, s + l)) as i from runs),
kept as (
  select x.doc_id, string_agg(x.word, ' ' order by x.i) as text
  from x left join gone g on g.doc_id = x.doc_id and g.i = x.i where g.i is null group by x.doc_id)
select d.doc_id, coalesce(t.n, 0) as n_runs, b.s as "start", b.l as length, b.p as period,
       1000 * b.l // b.p as exponent_milli, sha256(coalesce(t.lines, '')) as runs_sha256,
       sha256(coalesce(k.text, '')) as collapsed_sha256
from documents d left join told t using (doc_id) left join best b using (doc_id) left join kept k using (doc_id)
"""

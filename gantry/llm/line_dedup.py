"""Exact line deduplication with two Bloom filters.

1. Every line's key is hashed; a task holds two filters of a fixed size, for hashes seen once and
   seen twice. A hash already in the first goes into the second. Filters of different tasks are
   merged block by block: what both have seen once has been seen twice.
2. A document's lines are tested against the filter of twice-seen hashes; only suspects are
   shuffled, as digests, to find the keys held by two documents and the first of these.
3. The lines to drop come back to their documents.

The filters never miss a repeat, so the result is exact whatever their size; their size, bounded by
`max_bits` (32 MB), only decides how many unrepeated lines are suspected. Beyond about 10^8 distinct
lines the filters fill up, and in the limit every line's digest is shuffled (never its text).

Defined results: a null text is one empty line; rows without a doc_id are one
document, which comes after all others; rows that repeat a doc_id are one document (their lines are not
repeats of each other); an empty table gives
an empty result; other columns are passed on whatever their names, but columns named as a result are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.bloom import filter_bits, holds, positions, seen
from gantry.llm.common import SPACE, carried, let, read, saved, whole_text, with_results

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LineRules:
    min_length: int = 10
    bits_per_line: int = 12
    hashes: int = 4
    max_bits: int = 1 << 28


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _hash(line: Column, rules: LineRules) -> Column:
    """Hash of a line's key, coarser in case than the key; 0 for short keys only."""
    hashed = F.xxhash64(F.lower(_trimmed(line)))
    return F.when(F.length(_trimmed(line)) < rules.min_length, F.lit(0).cast("long")).otherwise(
        F.when(hashed == 0, F.lit(1).cast("long")).otherwise(hashed))


def dropped_lines(rows: DataFrame, rules: LineRules) -> DataFrame:
    """(_lone, _id, _text_hash, dropped): places of the lines that each row loses.

    rows: (_lone, _id, _text, _text_hash); _lone tells a row without an id, whose _id is 0.
    """
    hashed = F.transform(F.split("_text", "\n"), lambda x: _hash(x, rules))
    once = saved(rows.select(F.array_distinct(F.filter(hashed, lambda x: x != 0)).alias("h")), "line_hashes")
    lines = once.agg(F.sum(F.size("h"))).first()[0] or 0
    bits, k = filter_bits(lines, rules.bits_per_line, rules.max_bits), rules.hashes
    bitmap = rows.sparkSession.sparkContext.broadcast(seen(once, bits, k, 2))

    @F.pandas_udf("array<int>")
    def suspects(column: pd.Series) -> pd.Series:
        filled = np.frombuffer(bitmap.value, np.uint8)
        out = []
        for values in column:
            full = np.flatnonzero(values)
            out.append(full[holds(filled, positions(values[full], bits, k))].astype(np.int32))
        return pd.Series(out)

    def key(line: Column) -> Column:
        return F.unhex(F.sha2(F.translate(_trimmed(line), UPPER, LOWER), 256))

    found = rows.withColumn("s", suspects(hashed)).filter(F.size("s") > 0)
    places = let(F.split("_text", "\n"), lambda lines: F.transform(
        "s", lambda i: F.struct(i.alias("at"), key(lines[i]).alias("key"))))
    found = saved(found.select("_lone", "_id", "_text_hash", F.inline(places)), "suspected_lines")
    named = F.when(~F.col("_lone"), F.col("_id"))
    owner = found.groupBy("key").agg(
        F.min(named).alias("first"), F.max(named).alias("last"), F.max("_lone").alias("lone_too"))
    # Written, so that the join can split a line that a great many documents hold.
    owner = saved(owner.filter("first < last or (first is not null and lone_too)").select("key", "first"), "repeated_lines")
    lost = found.join(owner, "key").filter(F.col("_lone") | (F.col("_id") > F.col("first")))
    return lost.groupBy("_lone", "_id", "_text_hash").agg(F.collect_set("at").alias("dropped"))


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with the kept lines as text, n_lines and n_dropped."""
    whole = whole_text(text)
    keyed = docs.select(
        *carried(docs), F.col(doc_id).isNull().alias("_lone"), F.coalesce(F.col(doc_id), F.lit(0)).alias("_id"),
        whole.alias("_text"), F.xxhash64(whole).alias("_text_hash"))
    lost = dropped_lines(keyed.select("_lone", "_id", "_text", "_text_hash"), rules)
    both = keyed.join(lost, ["_lone", "_id", "_text_hash"], "left")
    kept = F.when(F.col("dropped").isNull(), F.col("_text")).otherwise(let(F.split("_text", "\n"), lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped")), lambda i: x[i]), "\n")))
    out = {text: kept, "n_lines": F.size(F.split("_text", "\n")).cast("long"),
           "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long")}
    return with_results(both, docs, out)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = """
with lines as (
  select doc_id, i, line, lower_key as k from (
    select doc_id, i, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_key
    from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i
          from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)))),
owners as (
  select k, min(doc_id) as first_id from lines where length(k) >= 10
  group by k having count(distinct doc_id) >= 2),
marked as (
  select l.doc_id, l.i, l.line, o.k is not null and l.doc_id <> o.first_id as gone
  from lines l left join owners o on l.k = o.k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

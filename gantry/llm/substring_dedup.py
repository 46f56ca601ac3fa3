"""Repeated passages by relative Lempel-Ziv parsing against an index of reference blocks.

Exact: a word goes if it lies in a window of `window` successive words that also starts in a document
with a smaller id.

1. Parsing. Each window is named by the smallest hash among its `anchor`-word grams; successive
   windows of one name are a block of text. The same passage is cut into the same blocks wherever it
   stands, so all documents can be factored at once, each on its own.
2. Index. A name that only one document has is dropped. Of each distinct block, the smallest id that
   holds it is kept: that is the reference. A block that a smaller document holds is a factor, and
   all its windows are repeats.
3. Factor boundaries. Where a passage begins or ends, blocks of one name differ, though windows in
   them agree. There, each distinct block's holder of the smallest id lists its windows, and a window
   that a smaller document lists is a repeat, too.

Blocks and windows are compared by 128 bits of hash. A block that n documents hold costs n rows; no
pairs of documents are formed.

Defined results: null or empty texts have no words; a null doc_id comes after all others, in the
order of its text's hash; rows that repeat a doc_id do not repeat each other; texts shorter than a
window lose nothing; every long is a valid id; an empty table gives an empty result; other columns are
passed on whatever their names, but columns named as a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.common import carried, read, saved, whole_text, with_results
from gantry.llm.near_dedup import mixed, word_hashes

#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1


@dataclass(frozen=True)
class PassageRules:
    window: int = 50
    anchor: int = 16
    #: windows in a block at most; texts that repeat a few words make long ones
    longest_block: int = 64


class Spans:
    """Hashes of any spans of a row of words."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, w: np.ndarray):
        n = len(w) + 1
        self.parts = []
        for base in BASES:
            up, down = self._powers.get(base, (np.empty(0), None))
            if len(up) < n:
                size = 1 << n.bit_length()
                up = np.full(size, base, np.uint64)
                down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
                up[0] = down[0] = 1
                up, down = np.cumprod(up), np.cumprod(down)
                if size <= 1 << 20:
                    self._powers[base] = up, down
            total = np.zeros(n, np.uint64)
            np.cumsum(mixed(w ^ np.uint64(base)) * up[:n - 1], out=total[1:])
            self.parts.append((total, down))

    def hashes(self, start: np.ndarray, length, parts: int = 2) -> list[np.ndarray]:
        """Independent hashes of the spans."""
        return [mixed((t[start + length] - t[start]) * down[start]) for t, down in self.parts[:parts]]


def blocks(w: np.ndarray, rules: PassageRules) -> tuple[np.ndarray, ...] | None:
    """name, two hashes of its text, windows and start of each block."""
    n = len(w) - rules.window + 1
    if n < 1:
        return None
    spans = Spans(w)
    least = spans.hashes(np.arange(len(w) - rules.anchor + 1), rules.anchor, 1)[0]
    span, width = 1, rules.window - rules.anchor + 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < width:
        least = np.minimum(least[:span - width], least[width - span:])
    cuts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    ends = np.append(cuts[1:], n)
    if (ends - cuts).max() > rules.longest_block:
        cuts = np.concatenate([np.arange(a, b, rules.longest_block) for a, b in zip(cuts, ends)])
        ends = np.append(cuts[1:], n)
    return least[cuts], *spans.hashes(cuts, ends - cuts + rules.window - 1), ends - cuts, cuts


BLOCK = ["name", "f1", "f2", "windows"]
#: A row: whether it has no id, its id or else its text's hash, and the text's hash.
ROW = ["_lone", "_id", "_text_hash"]
ROW_TYPES = "_lone boolean, _id long, _text_hash long"


def ends() -> list[Column]:
    """Least and largest id, and the same of the rows without one, which come after the others."""
    named, lone = F.when(~F.col("_lone"), F.col("_id")), F.when(F.col("_lone"), F.col("_id"))
    return [F.min(named).alias("low"), F.max(named).alias("high"), F.min(lone).alias("low_lone"), F.max(lone).alias("high_lone")]


#: Of ends(): more than one document holds it; of a row beside them: an earlier document holds it.
SEVERAL = "low < high or low_lone < high_lone or (low is not null and low_lone is not null)"
LATER = "if(_lone, low is not null or _id > low_lone, _id > low)"


def parsed(rows: DataFrame, rules: PassageRules) -> DataFrame:
    def told(found: list, keys: list) -> pd.DataFrame:
        name, f1, f2, windows, start = (np.concatenate(x) for x in zip(*found))
        counts = [len(x[0]) for x in found]
        lone, ids, hashed = zip(*keys)
        return pd.DataFrame({
            "name": name.view(np.int64), "f1": f1.view(np.int64), "f2": f2.view(np.int64),
            "windows": windows.astype(np.int32), "start": start.astype(np.int32),
            "_lone": np.repeat(np.array(lone, bool), counts), "_id": np.repeat(np.array(ids, np.int64), counts),
            "_text_hash": np.repeat(np.array(hashed, np.int64), counts)})

    def run(batches):
        for frame in batches:
            found, keys, n = [], [], 0
            for *key, text in zip(*(frame[c] for c in (*ROW, "_text"))):
                made = blocks(word_hashes(text), rules)
                if made is not None:
                    found.append(made)
                    keys.append(key)
                    n += len(made[0])
                if n > 100_000:
                    yield told(found, keys)
                    found, keys, n = [], [], 0
            if found:
                yield told(found, keys)

    return rows.mapInPandas(run, f"name long, f1 long, f2 long, windows int, start int, {ROW_TYPES}")


def listed_windows(rows: DataFrame, wanted: DataFrame, rules: PassageRules) -> DataFrame:
    """(w1, w2, start) and the row of the windows in the `wanted` blocks of the rows."""
    lists = wanted.groupBy(*ROW).agg(F.collect_set(F.struct("start", "windows")).alias("s"))
    lists = lists.select(*ROW, F.col("s.start").alias("starts"), F.col("s.windows").alias("counts"))

    def run(batches):
        for frame in batches:
            for lone, key, hashed, text, starts, counts in zip(*(frame[c] for c in (*ROW, "_text", "starts", "counts"))):
                at = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, counts)])
                w1, w2 = Spans(word_hashes(text)).hashes(at, rules.window)
                yield pd.DataFrame({"w1": w1.view(np.int64), "w2": w2.view(np.int64), "start": at.astype(np.int32),
                                    "_lone": lone, "_id": key, "_text_hash": hashed})

    return rows.join(lists, ROW).mapInPandas(run, f"w1 long, w2 long, start int, {ROW_TYPES}")


def repeated(rows: DataFrame, rules: PassageRules) -> DataFrame:
    """(_lone, _id, _text_hash, starts, counts): the repeated windows of each row of these three and _text."""
    every = saved(parsed(rows, rules), "blocks")
    names = saved(every.groupBy("name").agg(*ends()).filter(SEVERAL).select("name"), "repeated_names")
    common = saved(every.join(names, "name"), "common_blocks")
    index = saved(common.groupBy(*BLOCK).agg(*ends()).select(*BLOCK, "low", "low_lone"), "reference_blocks")
    several = index.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    several = saved(several, "differing_names")
    owned = common.join(index, BLOCK).withColumn("later", F.expr(LATER))
    owned = saved(owned.select("name", *ROW, "start", "windows", "later"), "factored_blocks")
    factors = owned.filter("later").select(*ROW, "start", "windows")

    edges = owned.filter("not later").join(several, "name").select(*ROW, "start", "windows")
    windows = saved(listed_windows(rows.dropDuplicates(ROW), edges, rules), "edge_windows")
    first = windows.groupBy("w1", "w2").agg(*ends()).filter(SEVERAL)
    first = saved(first.select("w1", "w2", "low", "low_lone"), "repeated_windows")
    single = windows.join(first, ["w1", "w2"]).filter(LATER)
    single = single.select(*ROW, "start", F.lit(1).alias("windows"))
    lost = factors.unionAll(single).groupBy(*ROW).agg(F.collect_set(F.struct("start", "windows")).alias("s"))
    return lost.select(*ROW, F.col("s.start").alias("starts"), F.col("s.windows").alias("counts"))


def dedup_passages(docs: DataFrame, rules: PassageRules = PassageRules(), text: str = "text",
                   doc_id: str = "doc_id") -> DataFrame:
    """`docs` with the kept words, joined by blanks, as text; n_words and n_removed."""
    whole = whole_text(text)
    keyed = docs.select(
        *carried(docs), F.col(doc_id).isNull().alias("_lone"),
        F.coalesce(F.col(doc_id), F.xxhash64(whole)).alias("_id"), F.xxhash64(whole).alias("_text_hash"), whole.alias("_text"))
    lost = repeated(keyed.select(*ROW, "_text"), rules)

    @F.pandas_udf("text string, n_words long, n_removed long")
    def cut(texts: pd.Series, starts: pd.Series, counts: pd.Series) -> pd.DataFrame:
        out = []
        for value, at, n in zip(texts, starts, counts):
            found = value.encode().split()
            removed = 0
            if at is not None and len(at):
                gone = np.zeros(len(found) + 1, np.int64)
                np.add.at(gone, at, 1)
                np.add.at(gone, np.minimum(np.asarray(at) + n + rules.window - 1, len(found)), -1)
                stay = np.cumsum(gone)[:-1] == 0
                removed = int(len(found) - stay.sum())
                kept = [found[i] for i in np.flatnonzero(stay)]
            else:
                kept = found
            out.append((b" ".join(kept).decode(), len(found), removed))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    both = keyed.join(lost, ROW, "left").withColumn("_cut", cut("_text", "starts", "counts"))
    return with_results(both, docs, {text: F.col("_cut.text"), "n_words": F.col("_cut.n_words"), "n_removed": F.col("_cut.n_removed")})


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Written from the contract: windows are held by their whole text, words are lost where a lost window began within 50.
OP9_SQL = """
with w as (
  select doc_id, generate_subscripts(l, 1) as i, unnest(l) as word
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as l from documents)),
windows as (
  select doc_id, i, md5(string_agg(word, ' ') over w50) as k
  from w window w50 as (partition by doc_id order by i rows between current row and 49 following)
  qualify count(*) over w50 = 50),
starts as (
  select doc_id, i, doc_id > min(doc_id) over (partition by k) as later from windows),
marked as (
  select w.doc_id, w.i, w.word, coalesce(w.i - max(case when s.later then s.i end) over (
           partition by w.doc_id order by w.i rows between unbounded preceding and current row) < 50, false) as gone
  from w left join starts s on s.doc_id = w.doc_id and s.i = w.i),
kept as (
  select doc_id, count(*) as n, count(*) filter (gone) as gone,
         string_agg(word, ' ' order by i) filter (not gone) as left_over
  from marked group by doc_id)
select d.doc_id, coalesce(n, 0) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(left_over, '')) as kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id
"""

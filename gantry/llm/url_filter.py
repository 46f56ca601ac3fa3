"""URL filters: rules, and a ratio of character language models where no rule fits.

A rule is a host, a beginning of a path and a verdict; it fits its host and all subdomains, and the
longest rule wins. URLs that rules decide are the samples of two variable-order Markov models of
characters, one of allowed and one of blocked URLs: each context is mixed with the next shorter one
by the number of different characters seen after it (Witten and Bell). A URL without a rule is
allowed if the difference of its log-likelihoods per character reaches a threshold, which is set
where samples that the models have not seen are told apart best.

Both models are counted over all URLs that rules decide, whole, each distinct one once, but for one in
`held` of them, which set the threshold. Spark adds up the counts of each context and character, by
64-bit hash. What is broadcast has one size whatever the input: counts are folded into tables of
2^`bits` places, where contexts that meet in a place share it (a count is never taken for more than
that of its context). The threshold comes from a histogram of all the held URLs' ratios.

Defined results: a null url, and one without `://`, has empty host and path, no rule, and is judged
by what it has (null: nothing, which is allowed); if one verdict has no samples, what has no rule is
allowed; rows are judged one by one; an empty table gives an empty result; other columns are passed
on whatever their names, but columns named as a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.common import carried, let, read, with_results
from gantry.llm.line_dedup import LOWER, UPPER
from gantry.llm.near_dedup import mixed

START, END = 2, 3
VERDICTS = ("allow", "block")
#: Bins of the ratios' histogram in a unit; ratios lie within 2 * BOUND units.
BINS, BOUND = 2000, 40
#: Places of a table that travel to the driver in one row.
BLOCK = 1 << 14
#: Characters that are worked on at a time, unless one URL has more.
AT_ONCE = 200_000


@dataclass(frozen=True)
class UrlRules:
    #: host, beginning of the path, verdict
    rules: tuple[tuple[str, str, str], ...] = (
        ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
        ("com", "/fr/", "allow"), ("com", "/de/", "block"))
    order: int = 4
    #: places in a table of counts, as a power of two
    bits: int = 20
    #: one in so many samples sets the threshold
    held: int = 5


def grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts that are worked on at a time."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def hashed(texts: list[str], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of the contexts of each length up to `order`, and of these with the next character, for every
    character of the texts and their ends; and how many of these each text has."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(c) + 1 for c in codes])
    every = np.concatenate([x for c in codes for x in (np.full(order, START), c, [END])]).astype(np.uint64)
    at = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(texts) + 1) * order, sizes)
    own = mixed(every[at] + np.uint64(1 << 32))
    context = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    contexts, grams = [], []
    for k in range(order + 1):
        if k:
            context = mixed(context * np.uint64(0xC2B2AE3D27D4EB4F) + every[at - k])
        contexts.append(context)
        grams.append(mixed(context + own))
    return contexts, grams, sizes


@dataclass
class Judge:
    """Of each verdict the counts of grams, of contexts, and of the characters seen after contexts."""

    tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
    order: int
    threshold: float = 0.0

    def log_p(self, verdict: str, contexts: list[np.ndarray], grams: list[np.ndarray]) -> np.ndarray:
        found, total, kinds = self.tables[verdict]
        mask = np.uint64(len(found) - 1)
        p = np.full(len(grams[0]), 1 / 256)
        for x, g in zip(contexts, grams):
            n, t = total[x & mask], kinds[x & mask]
            seen = np.minimum(found[g & mask], n)
            p = np.where(n > 0, (seen + t * p) / np.maximum(n + t, 1), p)
        return np.log(p)

    def ratios(self, texts: list[str | None]) -> np.ndarray:
        """Difference of the log-likelihoods per character of each text; infinite for none."""
        out = np.full(len(texts), np.inf)
        full = [i for i, t in enumerate(texts) if t]
        for a, b in grouped([texts[i] for i in full]):
            contexts, grams, sizes = hashed([texts[i] for i in full[a:b]], self.order)
            each = self.log_p("allow", contexts, grams) - self.log_p("block", contexts, grams)
            out[full[a:b]] = np.add.reduceat(each, np.cumsum(sizes) - sizes) / sizes
        return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host in small letters, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = let(rest, lambda r: F.regexp_extract(
        F.substring(r, F.length(F.regexp_extract(r, "^[^/?#]*", 0)) + 1, F.length(r)), "^[^?#]*", 0))
    return F.translate(host, UPPER, LOWER), path


def with_rule(pages: DataFrame, rules: UrlRules = UrlRules(), url: str = "url") -> DataFrame:
    """`pages` with host, path and rule, and _ruled, the rule's verdict."""
    host, path = parts(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules.rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("_ruled", verdict)


def told(url: Column) -> Column:
    """What the models read: the URL without its scheme."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(url)


def counted(sample: DataFrame, rules: UrlRules) -> DataFrame:
    """(v, x, g, n): how often the character of g follows context x in URLs t of verdict v, by hash."""

    def run(batches):
        for frame in batches:
            for v, part in frame.groupby("v"):
                texts = part["t"].tolist()
                for a, b in grouped(texts):
                    contexts, grams, _ = hashed(texts[a:b], rules.order)
                    g, first, n = np.unique(np.concatenate(grams), return_index=True, return_counts=True)
                    x = np.concatenate(contexts)[first]
                    yield pd.DataFrame({"v": v, "x": x.view(np.int64), "g": g.view(np.int64), "n": n})

    rows = sample.select("v", "t").mapInPandas(run, "v string, x long, g long, n long")
    return rows.groupBy("v", "x", "g").agg(F.sum("n").alias("n"))


def tables(counts: DataFrame, bits: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """See Judge; folded by Spark, so that rows of blocks of places reach the driver, never counts of grams."""
    mask = (1 << bits) - 1
    zero = F.lit(0).cast("long")
    # Contexts are known by their grams: one row of these is one kind of character.

    def spot(hashed: str, *numbers: Column) -> Column:
        return F.struct(F.col(hashed).bitwiseAND(mask).alias("at"), *(
            n.alias(c) for n, c in zip(numbers, ("found", "total", "kinds"))))

    spots = counts.select("v", F.explode(F.array(
        spot("g", F.col("n"), zero, zero), spot("x", zero, F.col("n"), zero + 1))).alias("s"))
    spots = spots.groupBy("v", "s.at").agg(*(F.sum(f"s.{c}").alias(c) for c in ("found", "total", "kinds")))

    def laid_out(frame: pd.DataFrame) -> pd.DataFrame:
        made = {"v": frame["v"].iloc[:1], "block": frame["block"].iloc[:1]}
        for c in ("found", "total", "kinds"):
            part = np.zeros(BLOCK, "<f4")
            part[frame["at"].to_numpy() % BLOCK] = frame[c]
            made[c] = [part.tobytes()]
        return pd.DataFrame(made)

    size = max(1 << bits, BLOCK)
    out = {v: tuple(np.zeros(size, "<f4") for _ in range(3)) for v in VERDICTS}
    laid = spots.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("v", "block").applyInPandas(
        laid_out, "v string, block long, found binary, total binary, kinds binary")
    for row in laid.toLocalIterator():
        for table, part in zip(out[row.v], (row.found, row.total, row.kinds)):
            table[row.block * BLOCK:(row.block + 1) * BLOCK] = np.frombuffer(part, "<f4")
    return {v: tuple(t[:1 << bits] for t in found) for v, found in out.items()}


def best_threshold(found: list[tuple[int, str, int]]) -> float:
    """Where (bin, verdict, number) are told apart best: the middle between the bins on its sides."""
    total = {v: sum(n for _, w, n in found if w == v) for v in VERDICTS}
    if not min(total.values()):
        return 0.0
    bins = sorted({b for b, _, _ in found})
    at = {(b, v): n for b, v, n in found}
    below = dict.fromkeys(VERDICTS, 0)
    best = (1.0, -math.inf)
    for i, b in enumerate(bins):
        for v in VERDICTS:
            below[v] += at.get((b, v), 0)
        upper = bins[i + 1] if i + 1 < len(bins) else b
        right = 1 - below["allow"] / total["allow"] + below["block"] / total["block"]
        best = max(best, (right, (b + upper + 1) / 2 / BINS))
    return best[1]


def fitted(ruled: DataFrame, rules: UrlRules = UrlRules(), url: str = "url") -> Judge | None:
    """Models of the URLs that rules decide; None if a verdict has no samples."""
    known = ruled.filter(F.col("_ruled").isNotNull()).select(told(F.col(url)).alias("t"), F.col("_ruled").alias("v"))
    known = known.filter(F.length("t") > 0).distinct()
    late = F.pmod(F.xxhash64("t", F.lit(7)), F.lit(rules.held)) == 0
    judge = Judge(tables(counted(known.filter(~late), rules), rules.bits), rules.order)
    if not all(judge.tables[v][1].any() for v in VERDICTS):
        return None
    ratio = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), "_ratio"))
    found = scored(known.filter(late), judge, "t").groupBy(F.floor(ratio * BINS).alias("b"), "v").agg(F.count(F.lit(1)).alias("n"))
    # Bounded: a row per bin and verdict.
    judge.threshold = best_threshold([(r.b, r.v, r.n) for r in found.collect()])
    return judge


def scored(rows: DataFrame, judge: Judge, text: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(judge)

    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.ratios(texts.tolist()))

    return rows.withColumn("_ratio", ratio(F.col(text)))


def judged(pages: DataFrame, rules: UrlRules = UrlRules(), url: str = "url") -> DataFrame:
    """`pages` with host, path, rule and verdict."""
    ruled = with_rule(pages.select(F.col(url), *carried(pages)), rules, url)
    judge = fitted(ruled, rules, url)
    verdict = F.lit("allow")
    if judge is not None:
        ruled = scored(ruled.withColumn("_told", told(F.col(url))), judge, "_told")
        verdict = F.when(F.col("_ratio") >= judge.threshold, "allow").otherwise("block")
    out = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": F.coalesce("_ruled", verdict)}
    return with_results(ruled, pages, out)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict")

"""Secret scans: fixed patterns, and random strings told from ordinary identifiers by Markov models.

Patterns give the base spans. Every other run of 16 or more characters that a key can consist of is
scored: two first-order Markov models of characters, one of random strings and one of ordinary
identifiers, each trained on labelled samples, give the log-likelihood ratio. A run with a high ratio
is a further span, of kind `random`.

The labelled samples come from the documents: values that the patterns find are random (1), words
elsewhere are ordinary (0); digests of these words, as hexadecimal, base 64 and capitals, stand for
the kinds of keys that no pattern knows. All distinct words and values are taken, or the `max_samples`
of least hash where there are more.

Everything is a DataFrame expression. Only the models' counts of character pairs, a number fixed by
the alphabet, reach the driver.

Defined results: a null or empty text has no spans; rows are judged one by one, so repeated rows get
the same spans; an empty table gives an empty result; other columns are passed on, columns named as
a result are replaced. Positions count code points. A class without samples has a uniform model: without
words of 8 letters the ordinary one; without values, too, both are, and no random string is found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.common import carried, let, read, whole_text, with_results

#: The patterns of the base kinds, in the order in which spans are listed.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Characters of keys lie between these codes; the first one stands for the ends of a string.
LOW, HIGH = 42, 122
WIDTH = HIGH - LOW + 1
SPAN = "struct<start:int,rank:int,kind:string,stop:int>"


@dataclass(frozen=True)
class SecretRules:
    min_value: int = 6
    min_run: int = 16
    #: least log-likelihood ratio of a random string, in all and for each character
    min_ratio: float = 12.0
    min_mean: float = 0.6
    max_samples: int = 20_000
    smoothing: float = 0.5


def _sums(lengths: Column) -> Column:
    """prefix sums as a function of the place: long arrays are summed in pieces."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / 128).cast("int")),
                         lambda b: total(F.slice(lengths, b * 128 + 1, 128)))
    return let(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.size(lengths) - 1), lambda i: total(
        F.slice(p, F.lit(1), F.floor(i / 128).cast("int"))) + total(
        F.slice(lengths, F.floor(i / 128).cast("int") * 128 + 1, i % 128))))


def located(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches of the pattern; keep(match) says which count.

    What lies between the matches gives their places.
    """

    def spans(found: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        return let(between, lambda gap: let(
            F.transform(found, lambda m, i: gap[i] + F.length(m)), lambda step: let(
                _sums(step), lambda before: F.transform(found, lambda m, i: F.struct(
                    (before[i] + gap[i]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                    F.lit(kind).alias("kind"), (before[i] + gap[i] + F.length(m)).alias("stop"), m.alias("m"))))))

    def bare(all_spans: Column) -> Column:
        kept = F.filter(all_spans, lambda s: keep(s.m)) if keep else all_spans
        return F.transform(kept, lambda s: F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.kind.alias("kind"),
                                                    s.stop.alias("stop")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")
    return let(found, lambda m: F.when(F.size(m) > 0, bare(spans(m))).otherwise(none))


def base_spans(text: Column, rules: SecretRules) -> Column:
    """Spans of the three base kinds; cheap tests leave out most texts."""
    none = F.array().cast(f"array<{SPAN}>")
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= rules.min_value
    return F.concat(
        F.when(text.contains("=") | text.contains(":"), located(text, ASSIGN, "assign", long_enough)).otherwise(none),
        F.when(text.contains("AKIA"), located(text, ACCESS, "access")).otherwise(none),
        F.when(text.rlike(HEX), located(text, HEX, "hex")).otherwise(none))


def _pairs(value: Column) -> Column:
    """Number of each pair of successive characters, the ends included."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - LOW)
    ends = F.concat(F.array(F.lit(0)), F.filter(codes, lambda c: c > 0), F.array(F.lit(0)))
    return let(ends, lambda c: F.zip_with(
        F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda a, b: a * WIDTH + b))


def samples(docs: DataFrame, rules: SecretRules = SecretRules(), text: str = "text") -> DataFrame:
    """(value, label): labelled strings out of the documents; the bound is rules.max_samples."""
    rows = docs.select(whole_text(text).alias("t"))

    def some(values: DataFrame) -> DataFrame:
        # Copies of a value count once; the ones of least hash are as good as drawn. Of many values only twice as
        # many as are wanted, by estimate, are shuffled; the least ones are among them.
        n = values.agg(F.approx_count_distinct("value", 0.02)).first()[0]
        if n > 2 * rules.max_samples:
            values = values.filter(F.xxhash64("value") < -(1 << 63) + (2 * rules.max_samples << 64) // n)
        return values.distinct().orderBy(F.xxhash64("value"), "value").limit(rules.max_samples)

    values = rows.select(F.explode(F.concat(
        F.when(F.col("t").contains("=") | F.col("t").contains(":"),
               F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("t").contains("AKIA"), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0))).otherwise(
            F.array().cast("array<string>")),
        F.when(F.col("t").rlike(HEX), F.regexp_extract_all("t", F.lit(HEX), F.lit(0))).otherwise(
            F.array().cast("array<string>")))).alias("value")).filter(F.length("value") >= rules.min_value)
    plain = F.array_distinct(F.filter(F.split("t", "[^A-Za-z_-]+"), lambda w: F.length(w) >= 8))
    words = some(rows.select(F.explode(plain).alias("value")))
    # Ordinary identifiers are also put together from words.
    joined = words.select(F.explode(F.array(
        F.col("value"), F.concat_ws("_", F.lower("value"), F.reverse(F.lower("value"))),
        F.concat(F.lower("value"), F.lit("-"), F.length("value").cast("string")))).alias("value"))
    digest = F.sha2("value", 256)
    drawn = words.select(F.explode(F.array(
        digest, F.translate(F.base64(F.unhex(digest)), "\r\n", ""), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)),
    )).alias("value"))
    return some(values).unionAll(drawn).select("value", F.lit(1).alias("label")).unionAll(
        joined.select("value", F.lit(0).alias("label")))


def ratios(labelled: DataFrame, rules: SecretRules = SecretRules()) -> list[float]:
    """Log-likelihood ratio of each pair of characters; both models are smoothed."""
    counted = labelled.select("label", F.explode(_pairs(F.col("value"))).alias("pair"))
    # Bounded: two models of WIDTH * WIDTH pairs.
    counts = {(r["label"], r["pair"]): r["n"] for r in counted.groupBy("label", "pair").agg(
        F.count(F.lit(1)).alias("n")).collect() if 0 <= r["pair"] < WIDTH * WIDTH}
    out = []
    for a in range(WIDTH):
        rows = [[counts.get((label, a * WIDTH + b), 0) + rules.smoothing for b in range(WIDTH)] for label in (0, 1)]
        sums = [sum(r) for r in rows]
        out += [math.log(rows[1][b] / sums[1]) - math.log(rows[0][b] / sums[0]) for b in range(WIDTH)]
    return out


def find_secrets(docs: DataFrame, table: list[float] | None = None, rules: SecretRules = SecretRules(),
                 text: str = "text") -> DataFrame:
    """`docs` with base and added: spans (start, rank, kind, stop) in order; table: see ratios()."""
    if table is None:
        table = ratios(samples(docs, rules, text), rules)
    model = F.split(F.lit(",".join(f"{x:.5g}" for x in table)), ",").cast("array<double>")

    def random(run: Column) -> Column:
        score = F.aggregate(F.transform(_pairs(run), lambda p: F.element_at(model, p + 1)), F.lit(0.0), lambda acc, x: acc + x)
        return run.rlike("[A-Za-z]") & let(score, lambda s: (s >= rules.min_ratio) & (s >= rules.min_mean * F.length(run)))

    own = docs.select(*carried(docs), whole_text(text).alias("_t"))
    own = own.withColumn("_base", F.sort_array(base_spans(F.col("_t"), rules)))
    run = f"[A-Za-z0-9+/_=-]{{{rules.min_run},}}"
    none = F.array().cast(f"array<{SPAN}>")
    extra = F.when(F.col("_t").rlike(run), located(F.col("_t"), run, "random", random)).otherwise(none)
    own = own.withColumn("_added", F.filter(extra, lambda s: ~F.exists(
        "_base", lambda b: (b.start < s.stop) & (s.start < b.stop))))
    return with_results(own, docs, {"base": F.col("_base"), "added": F.col("_added")})


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
                        _told(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_random"))

"""Quality rules: counts of each text, and how far its histograms lie from those of its language.

A document is compared with a reference of its language by the Jensen-Shannon distance (square
root of the divergence in bits, 0 to 1) of two histograms: the classes of its characters, and the
common words of its language. Short texts have ragged histograms, so each comparison has a least
length below which it does not reject, and the divergence of the words may exceed its limit by what
drawing so few words from the reference gives on average (see word_noise()).

Everything is a DataFrame expression; the only shuffle sums the histograms by language.

Defined results: a null text counts as empty (no words, so it fails the base rules); a null or
unlisted language is compared with the reference over all documents and the words of every listed
language; repeated rows are judged one by one and alike; an empty table gives an empty result;
other columns are passed on whatever their names, but one named as a result is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.common import carried, let, read, whole_text, with_results, words

#: Common function words by language.
COMMON_WORDS = {
    "en": "the of and to a in is that for it as was with be by on are this from or an at",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como",
}
#: Classes of characters that are counted besides white space; the rest are small letters and others.
CLASSES = {
    "upper": "\\p{Lu}", "digit": "\\p{Nd}", "stop": ".,;:'()-", "mark": "!?",
    "symbol": "#*$%&|<>@^~=+_{}\\\\\\[\\]/`\"",
}
SYMBOLS = "[^#*$%&|<>]+"
LISTS = {k: sorted(set(v.split())) for k, v in COMMON_WORDS.items()}
LISTS[""] = sorted({w for v in LISTS.values() for w in v})


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    gram: int = 5
    #: largest distances, and the least lengths from which they reject; word_noise is the multiple of the
    #: expected sampling noise by which the square of the word distance may exceed that of its limit
    max_char_distance: float = 0.25
    min_chars: int = 150
    max_word_distance: float = 0.24
    word_noise: float = 1.0
    min_common_words: int = 60


def _left(text: Column, others: str) -> Column:
    """How many characters stay when `others` are taken out."""
    return F.length(F.regexp_replace(text, others, ""))


def repeated_words(tokens: Column, gram: int) -> Column:
    """Words that lie in a window of `gram` words found twice or more, the first one included."""

    def covered(starts: Column) -> Column:
        ends = F.transform(starts, lambda x, k: F.when(
            k + 1 < F.size(starts), F.least(F.lit(gram), starts[k + 1] - x)).otherwise(F.lit(gram)))
        return F.aggregate(ends, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def starts(ordered: Column) -> Column:
        found = F.transform(ordered, lambda x, k: F.when(
            ((k > 0) & (ordered[F.greatest(k - 1, F.lit(0))].g == x.g))
            | ((k + 1 < F.size(ordered)) & (ordered[F.least(k + 1, F.size(ordered) - 1)].g == x.g)), x.i))
        return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

    def count(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(
            let(ordered, lambda o: let(starts(o), covered)))

    def grams(have: Column, out: Column | None = None, at: int = 0, bit: int = 0) -> Column:
        """Hash of the words from each place on, from spans of doubling length that are put together."""
        if gram >> bit & 1:
            out, at = have if out is None else _joined(out, have, at), at + (1 << bit)
        if gram >> bit == 1:
            return out
        longer = lambda o: let(_joined(have, have, 1 << bit), lambda h: grams(h, o, at, bit + 1))
        return longer(None) if out is None else let(out, longer)

    def hashed(w: Column) -> Column:
        return F.slice(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: grams(h)), 1, F.size(w) - gram + 1)

    return let(tokens, lambda w: F.when(F.size(w) < gram, F.lit(0).cast("long")).otherwise(let(hashed(w), count)))


def _joined(left: Column, right: Column, step: int) -> Column:
    """Each element of left hashed with the one of right that is `step` places on."""
    return F.zip_with(left, F.slice(right, step + 1, F.size(right)), lambda a, b: F.xxhash64(a, b))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _language(lang: str) -> Column:
    return F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise("")


def _parts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """`docs` with _t (text), _l (listed language or empty), _w (words), _wc (their characters) and _r (what
    is neither a to z nor a blank: all that other counts need)."""
    own = docs.withColumn("_t", whole_text(text)).withColumn("_l", F.coalesce(_language(lang), F.lit("")))
    own = own.withColumn("_w", words(F.col("_t"))).withColumn("_r", F.regexp_replace("_t", "[a-z\\x20]+", ""))
    return own.withColumn("_wc", F.length(F.array_join("_w", "")))


def _char_histogram() -> Column:
    classes = F.array(F.length("_t") - F.col("_wc"), *(_left(F.col("_r"), f"[^{c}]+") for c in CLASSES.values()))
    return let(classes, lambda c: F.concat(c, F.array(
        F.length("_t") - F.aggregate(c, F.lit(0), lambda acc, x: acc + x))))


def _word_histogram() -> Column:
    """Counts of the words common in the language, and at the end of all other words."""

    def counted(known: list[str]) -> Column:
        return let(F.filter("_w", lambda w: w.isin(*known)), lambda h: F.concat(
            F.transform(F.array(*map(F.lit, known)), lambda k: F.size(F.filter(h, lambda x: x == k))),
            F.array(F.size("_w") - F.size(h))))

    out = counted(LISTS[""])
    for lang in COMMON_WORDS:
        out = F.when(F.col("_l") == lang, counted(LISTS[lang])).otherwise(out)
    return out


def _shares(counts: Column) -> Column:
    return let(counts, lambda c: let(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x), lambda n: F.transform(
        c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, with base 2."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2))


def _bin_noise(mean: float) -> float:
    """Expected divergence, times the number of words, of a bin whose count is Poisson with this mean."""
    spread = 10 * math.sqrt(mean) + 10
    total = 0.0
    for k in range(max(0, int(mean - spread)), int(mean + spread) + 1):
        p = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        total += p * ((k * math.log2(2 * k / (k + mean)) if k else 0.0) + mean * math.log2(2 * mean / (k + mean)))
    return total / 2


#: _bin_noise() of the means 2 ** (i / 4) for i from NOISE_LOW on; about the mean before, 1 / (8 ln 2) after.
NOISE_LOW, NOISE_HIGH = -32, 32
BIN_NOISE = [_bin_noise(2 ** (i / 4)) for i in range(NOISE_LOW, NOISE_HIGH + 1)]


def word_noise(reference: Column, n: Column) -> Column:
    """n times the divergence that n words drawn from the reference itself have from it on average."""
    table = F.lit(BIN_NOISE)

    def of(q: Column) -> Column:
        at = F.round(F.least(4 * F.log2(n * q), F.lit(NOISE_HIGH))).cast("int") - NOISE_LOW + 1
        return F.when(n * q <= 2 ** (NOISE_LOW / 4), n * q).otherwise((1 - q) * table[F.greatest(at, F.lit(1)) - 1])

    return F.aggregate(reference, F.lit(0.0), lambda acc, q: acc + of(q))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(language, chars, common): shares over all documents of each listed language, and of all under ''.

    At most one row per listed language and one more, whatever the input.
    """
    bins = len(CLASSES) + 2
    found = F.concat(
        F.transform(_char_histogram(), lambda n, i: F.struct(F.concat(F.lit("#"), i).alias("bin"), n.cast("long").alias("n"))),
        F.transform(F.filter("_w", lambda w: w.isin(*LISTS[""])),
                    lambda w: F.struct(w.alias("bin"), F.lit(1).cast("long").alias("n"))),
        F.array(F.struct(F.lit("").alias("bin"), F.size("_w").cast("long").alias("n"))))
    counts = _parts(docs.select(text, lang), text, lang).select("_l", F.inline(found))
    counts = counts.groupBy("_l", "bin").agg(F.sum("n").alias("n"))
    counts = counts.select(F.explode(F.array_distinct(F.array("_l", F.lit("")))).alias("_l"), "bin", "n")
    counts = counts.groupBy("_l", "bin").agg(F.sum("n").alias("n")).groupBy("_l").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))

    def at(name: str) -> Column:
        return F.coalesce(F.element_at("m", F.lit(name)), F.lit(0).cast("long"))

    common = F.lit(None).cast("array<long>")
    for language, known in LISTS.items():
        listed = F.array(*map(at, known))
        common = F.when(F.col("_l") == language, let(listed, lambda x: F.concat(
            x, F.array(at("") - F.aggregate(x, F.lit(0).cast("long"), lambda acc, y: acc + y))))).otherwise(common)
    return counts.select(
        F.col("_l").alias("language"), _shares(F.array(*(at(f"#{i}") for i in range(bins)))).alias("chars"),
        _shares(common).alias("common"))


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance",
           "base_failed", "kept")


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), references: DataFrame | None = None,
          text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with its counts, distances, base_failed and kept."""
    refs = references if references is not None else language_references(docs, text, lang)
    # Bounded: one row per listed language and one more.
    refs = F.broadcast(refs.select(*(F.col(c).alias(f"_ref_{c}") for c in ("language", "chars", "common"))))
    narrow = docs.select(*dict.fromkeys((text, lang)), *carried(docs))
    own = _parts(narrow, text, lang).join(refs, F.col("_l") == F.col("_ref_language"), "left").withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.col("_wc").cast("long"),
        "n_symbols": _left(F.col("_r"), SYMBOLS).cast("long"),
        "n_dup_lines": repeated_lines(F.col("_t")),
        "n_repeat_words": repeated_words(F.col("_w"), rules.gram),
        "char_distance": js_distance(_shares(_char_histogram()), F.col("_ref_chars")),
        "word_distance": js_distance(_shares(_word_histogram()), F.col("_ref_common")),
    })
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    beyond = F.col("n_words") * (F.col("word_distance") * F.col("word_distance") - rules.max_word_distance**2)
    odd = ((F.col("char_distance") > rules.max_char_distance) & (F.length("_t") >= rules.min_chars)) | (
        (F.col("word_distance") > rules.max_word_distance)
        & (beyond > rules.word_noise * word_noise(F.col("_ref_common"), F.col("n_words")))
        & (F.col("n_words") >= rules.min_common_words))
    own = own.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))
    return with_results(own, docs, {c: F.col(c) for c in RESULTS})


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", F.round("char_distance", 9).alias("char_distance"), F.round("word_distance", 9).alias("word_distance"))


def _sql(rules: QualityRules = QualityRules()) -> str:
    """The rules in SQL, with a row per bin instead of arrays."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def left(others: str) -> str:
        return f"length(regexp_replace(t, {quoted(others)}, '', 'g'))"

    counted = [left(f"[^{c}]+") for c in CLASSES.values()]
    vocabulary = ", ".join(f"({quoted(k)}, {quoted(w)})" for k, v in LISTS.items() for w in v)
    listed = ", ".join(map(quoted, COMMON_WORDS))
    part = "case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end"
    divergence = f"sqrt(greatest(0, sum({part.format(a='p', b='q')} + {part.format(a='q', b='p')}) / 2))"
    noise = (
        f"sum(case when n_words * q <= {2 ** (NOISE_LOW / 4)!r} then n_words * q else (1 - q) * list_extract({BIN_NOISE!r}, "
        f"cast(greatest(round(least(4 * log2(n_words * q), {NOISE_HIGH})) - {NOISE_LOW} + 1, 1) as int)) end)")
    share = "case when sum(n) over g > 0 then n / sum(n) over g else 0.0 end"
    return f"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
         case when lang in ({listed}) then lang else '' end as l from documents),
tokens as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from d),
c as (
  select r, doc_id, t, l, len(w) as n_words, length(array_to_string(w, '')) as word_chars, {left(SYMBOLS)} as n_symbols
  from tokens),
words as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from tokens),
grams as (
  select r, i, string_agg(word, ' ') over g as k from words
  window g as (partition by r order by i rows between current row and {rules.gram - 1} following)
  qualify count(*) over g = {rules.gram}),
again as (select r, i from grams qualify count(*) over (partition by r, k) > 1),
repeats as (
  select r, count(*) filter (i - since < {rules.gram}) as n_repeat_words from (
    select w.r, w.i, max(a.i) over (partition by w.r order by w.i rows between unbounded preceding and current row) as since
    from words w left join again a on a.r = w.r and a.i = w.i) s group by r),
dup_lines as (
  select r, count(*) - count(distinct line) as n_dup_lines
  from (select r, unnest(string_split(t, chr(10))) as line from d) s
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r),
vocabulary(l, bin) as (values {vocabulary}),
languages as (select distinct l from vocabulary),
char_lists as (select r, l, [length(t) - word_chars, {', '.join(counted)}] as x, length(t) as n from c),
char_bins as (
  select r, l, unnest(list_append(x, n - list_sum(x))) as n, unnest(range({len(CLASSES) + 2})) as bin from char_lists),
found as (select r, word as bin, count(*) as n from words group by 1, 2),
known as (
  select c.r, c.l, v.bin, coalesce(f.n, 0) as n
  from c join vocabulary v on v.l = c.l left join found f on f.r = c.r and f.bin = v.bin),
word_bins as (
  select * from known
  union all select c.r, c.l, '', any_value(c.n_words) - sum(k.n) from c join known k on k.r = c.r group by c.r, c.l),
known_all as (
  select v.l, v.bin, sum(f.n) as n from vocabulary v join c on v.l in ('', c.l) join found f on f.r = c.r and f.bin = v.bin
  group by 1, 2),
words_all as (select g.l, sum(n_words) as n from languages g join c on g.l in ('', c.l) group by 1),
word_sums as (
  select v.l, v.bin, coalesce(k.n, 0) as n from vocabulary v left join known_all k using (l, bin)
  union all select a.l, '', a.n - coalesce((select sum(n) from known_all k where k.l = a.l), 0) from words_all a),
char_sums as (select g.l, bin, sum(n) as n from languages g join char_bins b on g.l in ('', b.l) group by 1, 2),
char_refs as (select l, bin, {share} as q from char_sums window g as (partition by l)),
word_refs as (select l, bin, {share} as q from word_sums window g as (partition by l)),
char_shares as (select r, l, bin, {share} as p from char_bins window g as (partition by r)),
word_shares as (select r, l, bin, {share} as p from word_bins window g as (partition by r)),
char_part as (select r, {divergence} as char_distance from char_shares join char_refs using (l, bin) group by r),
word_part as (
  select r, {divergence} as word_distance, {noise} as noise
  from word_shares join word_refs using (l, bin) join c using (r) group by r),
judged as (
  select c.*, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         char_distance, word_distance, noise
  from c left join repeats using (r) left join dup_lines using (r) join char_part using (r) join word_part using (r)),
verdicts as (
  select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed,
         (char_distance > {rules.max_char_distance} and length(t) >= {rules.min_chars})
         or (word_distance > {rules.max_word_distance} and n_words >= {rules.min_common_words}
             and n_words * (word_distance * word_distance - {rules.max_word_distance ** 2!r}) > {rules.word_noise} * noise) as odd
  from judged)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not odd as kept,
       round(char_distance, 9) as char_distance, round(word_distance, 9) as word_distance
from verdicts
"""


OP10_SQL = _sql()

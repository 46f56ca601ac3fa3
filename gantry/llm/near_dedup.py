"""Near-duplicate documents by ProbMinHash, banding and verification.

1. A document is the weighted set of its word shingles; a shingle found n times weighs 5/4 - 1/(4n).
   Each shingle is a Poisson process whose rate is its weight: its arrivals, exponential steps apart,
   fall on registers drawn by its own hash, and a register keeps the shingle that arrives first. A
   shingle is followed no further once its next arrival is later than every register's. Two
   documents agree in a register with the probability Jaccard similarity of their weights, which for
   equal weights is the plain one.
2. Documents with the same set of shingles, however often each is found, are one text. Bands of
   registers put texts into buckets.
3. In each bucket, every text is verified against one hub, the text that meets most others over all
   bands, by the exact Jaccard similarity of the shingles: n texts cost n pairs. Texts of a hub that
   are then in different groups are verified with each other if they can be similar enough, by what
   each shares with the hub and what with any other text; that rules out copies with many words of
   their own.
4. Groups are the connected components of the verified links.

With the default bands (24 of 5 registers) a pair of similarity 0.8 that repeats nothing meets with
probability 0.9999. Weights lie between 1 and 5/4, so for a plain similarity of 0.8 the one that the
bands see is 0.7 or more: whatever the texts repeat, such a pair meets with probability 0.988 or more.

Defined results: a text of fewer words than a shingle is one shingle of all its words; texts without
words (null ones, too) are copies of each other; a null doc_id belongs to its text's group, whose
class is null only if no row has an id; rows without an id and of the same text are one document; rows
that repeat a doc_id are one document, which ties all its texts together; every long is a valid id; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.bloom import filter_bits, holds, positions, seen
from gantry.llm.common import components, read, row_of, saved, whole_text

#: Words whose hashes a Python worker remembers, about 40 MB.
KNOWN_WORDS = 200_000


@dataclass(frozen=True)
class NearRules:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5
    batch_shingles: int = 400_000
    #: size of the Bloom filters: per entry, and at most
    filter_bits: int = 12
    max_filter_bits: int = 1 << 28


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words; bytes.split() parts at blanks and code points 9 to 13 only."""
    found = text.encode().split()
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of x spread over the 64 bits of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles in order, how often each is found)."""
    w = word_hashes(text)
    k = min(k, len(w)) or 1
    n = len(w) - k + 1 if len(w) else 0
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + w[j:j + n]
    return np.unique(mixed(total + np.uint64(k)), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    """What shingles weigh by how often they are found; bounded, so that repetition hides no copy."""
    return 1.25 - 0.25 / counts


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """The first shingle to arrive in each register, one row per non-empty set."""
    value = np.concatenate([v for v, _ in sets])
    weight = weights(np.concatenate([n for _, n in sets]))
    doc = np.repeat(np.arange(len(sets)), [len(v) for v, _ in sets])
    first = np.full(len(sets) * registers, np.inf)
    holder = np.zeros(len(sets) * registers, np.uint64)
    time, step = np.zeros(len(value)), 0
    while len(value):
        drawn = mixed(value + np.uint64(0x9E3779B97F4A7C15 * (2 * step + 1) & (1 << 64) - 1))
        time = time - np.log((drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight
        place = mixed(value + np.uint64(0x9E3779B97F4A7C15 * (2 * step + 2) & (1 << 64) - 1)) % np.uint64(registers)
        at = doc * registers + place.astype(np.int64)
        earlier = time < first[at]
        at, when = at[earlier], time[earlier]
        np.minimum.at(first, at, when)
        won = when == first[at]
        holder[at[won]] = value[earlier][won]
        last = first.reshape(-1, registers).max(axis=1)
        on = time < last[doc]
        value, weight, doc, time, step = value[on], weight[on], doc[on], time[on], step + 1
    return holder.reshape(-1, registers)


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """One bucket name per band; bands do not share names."""
    parts = signature.reshape(len(signature), bands, -1)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for j in range(parts.shape[2]):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return total.view(np.int64)


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(_lone, _id, _key, _text): whether a row has no id, its id or else its text's hash, and its text's digest."""
    whole = whole_text(text)
    return docs.select(
        F.col(doc_id).isNull().alias("_lone"), F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(whole)).alias("_id"),
        F.unhex(F.md5(whole)).alias("_key"), whole.alias("_text"))


def signed(rows: DataFrame, rules: NearRules) -> DataFrame:
    """(_lone, _id, _key, digest, buckets) for each row of keyed(); digest: of the set of shingles."""

    def flush(keys, sets):
        buckets: list = [np.empty(0, np.int64)] * len(keys)
        full = [i for i, (v, _) in enumerate(sets) if len(v)]
        if full:
            found = band_hashes(signatures([sets[i] for i in full], rules.bands * rules.rows), rules.bands)
            for i, row in zip(full, found):
                buckets[i] = row
        out = pd.DataFrame(keys, columns=["_lone", "_id", "_key"])
        return out.assign(digest=[xxhash.xxh3_128_digest(v.tobytes()) for v, _ in sets], buckets=buckets)

    def run(batches):
        for frame in batches:
            keys, sets, n = [], [], 0
            for *key, text in zip(frame["_lone"], frame["_id"], frame["_key"], frame["_text"]):
                keys.append(key)
                sets.append(shingles(text, rules.words))
                n += len(sets[-1][0])
                if n > rules.batch_shingles:
                    yield flush(keys, sets)
                    keys, sets, n = [], [], 0
            if keys:
                yield flush(keys, sets)

    return rows.mapInPandas(run, "_lone boolean, _id long, _key binary, digest binary, buckets array<long>")


def picked(rows: DataFrame, keys: DataFrame, rules: NearRules) -> DataFrame:
    """(_key, _text): the text of each of the `keys` (column _key).

    A Bloom filter of the keys, bounded in size, takes most other texts out before the shuffle.
    """
    keys = saved(keys.distinct(), "picked_keys")
    bits = filter_bits(keys.count(), rules.filter_bits, rules.max_filter_bits >> 3)
    hashed = F.xxhash64("_key")
    bitmap = rows.sparkSession.sparkContext.broadcast(seen(keys.select(F.array(hashed).alias("h")), bits, 3, 1))

    @F.pandas_udf("boolean")
    def likely(h: pd.Series) -> pd.Series:
        return pd.Series(holds(np.frombuffer(bitmap.value, np.uint8), positions(h.to_numpy(), bits, 3)))

    few = rows.filter(likely(hashed)).join(keys, "_key", "left_semi")
    return few.groupBy("_key").agg(F.first("_text").alias("_text"))


COMPARED = "a binary, b binary, n_a int, n_b int, common int, outside int"


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame, shingles_of, known: Callable | None = None) -> DataFrame:
    """Shingles of a and b, those in common, and those of b that `known` holds and a has not.

    left (a, x) and right (b, y) have what shingles_of() makes shingles of.
    """

    def run(batches):
        last, mine = None, None
        for frame in batches:
            out = []
            for a, b, x, y in zip(frame["a"], frame["b"], frame["x"], frame["y"]):
                if a != last:
                    last, mine = a, shingles_of(x)
                other = shingles_of(y)
                more = np.setdiff1d(other, mine, assume_unique=True)
                out.append((a, b, len(mine), len(other), len(other) - len(more), int(known(more).sum()) if known else 0))
            yield pd.DataFrame(out, columns=["a", "b", "n_a", "n_b", "common", "outside"])

    return pairs.select("a", "b").join(right, "b").join(left, "a").mapInPandas(run, COMPARED)


def similar(rules: NearRules) -> Column:
    return F.col("common") >= rules.similarity * (F.col("n_a") + F.col("n_b") - F.col("common")) - 1e-9


def rest_links(stars: DataFrame, groups: DataFrame, rows: DataFrame, rules: NearRules) -> DataFrame:
    """Links between texts that meet the same hub and are not yet in one group.

    Two texts share at most what both share with the hub, and besides that what others have, too: few
    pairs can be similar enough. A Bloom filter tells what others have, sometimes too much, never too
    little.
    """
    met = stars.select("a", F.col("b").alias("id")).unionAll(stars.select("a", F.col("a").alias("id")).distinct())
    placed = met.join(groups.withColumnRenamed("node", "id"), "id", "left")
    placed = saved(placed.select("a", "id", F.coalesce("root", "id").alias("root")), "met_texts")
    sizes = placed.groupBy("a", "root").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("a").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
    several = saved(several.filter("roots > 1").select("a", F.col("top.root").alias("top")), "mixed_hubs")
    mixed_up = saved(placed.join(several, "a"), "mixed_texts")

    def listed(batches):
        for frame in batches:
            found = [shingles(t, rules.words)[0].view(np.int64) for t in frame["_text"]]
            yield pd.DataFrame({"id": frame["_key"], "h": found})

    texts = picked(rows, mixed_up.select(F.col("id").alias("_key")), rules)
    sets = saved(texts.mapInPandas(listed, "id binary, h array<long>"), "shingle_sets")
    total = sets.agg(F.sum(F.size("h"))).first()[0] or 0
    bits = filter_bits(total, rules.filter_bits, rules.max_filter_bits)
    bitmap = rows.sparkSession.sparkContext.broadcast(seen(sets, bits, 4, 2))

    def unsigned(h):
        return np.asarray(h, np.int64).view(np.uint64)

    def known(h):
        return holds(np.frombuffer(bitmap.value, np.uint8), positions(h, bits, 4))

    left, right = (sets.select(F.col("id").alias(i), F.col("h").alias(h)) for i, h in (("a", "x"), ("b", "y")))
    told = saved(compared(mixed_up.select("a", F.col("id").alias("b")), left, right, unsigned, known), "shared_shingles")
    able = mixed_up.join(told.select("a", F.col("b").alias("id"), F.col("n_b").alias("n"), "common", "outside"), ["a", "id"])
    able = able.filter(F.col("common") + F.col("outside") >= rules.similarity * F.col("n") - 1e-9)
    columns = ("id", "root", "n", "common", "outside")
    one = able.filter("root != top").select("a", *(F.col(c).alias(f"{c}_1") for c in columns))
    two = able.select("a", "top", *(F.col(c).alias(f"{c}_2") for c in columns))
    most = F.least("common_1", "common_2") + F.least("outside_1", "outside_2")
    enough = most >= rules.similarity / (1 + rules.similarity) * (F.col("n_1") + F.col("n_2")) - 1e-9
    pairs = one.join(two, (one["a"] == two["a"]) & (F.col("root_1") != F.col("root_2")) & enough
                     & ((F.col("root_2") == F.col("top")) | (F.col("id_1") < F.col("id_2"))))
    pairs = pairs.select(F.col("id_1").alias("a"), F.col("id_2").alias("b")).distinct()
    tried = stars.select("a", "b").unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = saved(pairs.join(tried, ["a", "b"], "left_anti"), "rest_pairs")
    return compared(pairs, left, right, unsigned).filter(similar(rules)).select("a", "b")


def tied(sig: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between all texts of a repeated id."""
    own = sig.filter(~F.col("_lone")).select("_id", "digest")
    hashed = F.xxhash64("digest")
    several = own.groupBy("_id").agg(F.min(hashed).alias("x"), F.max(hashed).alias("y")).filter("x < y").select("_id")
    several = own.join(several, "_id").distinct().join(texts.select("digest", "id"), "digest")
    several = saved(several.select("_id", "id"), "texts_of_repeated_ids")
    return several.join(several.groupBy("_id").agg(F.min("id").alias("a")), "_id").select("a", F.col("id").alias("b"))


def near_classes(docs: DataFrame, rules: NearRules = NearRules(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_id, _lone, class, first) for every document.

    _id is null where there is none, and _lone then the hash of its text, else null; class is the least
    id of the group, and first tells whether this is the one to stay for its group.
    """
    rows = keyed(docs, text, doc_id)
    sig = saved(signed(rows, rules), "signatures")
    # Texts of one digest have all the same shingles: any of them stands for the others.
    texts = sig.groupBy("digest").agg(
        F.min(F.struct("_key", "buckets")).alias("t"), F.min(F.when(~F.col("_lone"), F.col("_id"))).alias("low"),
        F.min(F.when(F.col("_lone"), F.col("_id"))).alias("low_lone"))
    texts = saved(texts.select("digest", F.col("t._key").alias("id"), F.col("t.buckets").alias("buckets"), "low", "low_lone"),
                  "distinct_texts")

    entries = texts.select("id", F.explode("buckets").alias("bucket"))
    crowded = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = saved(entries.join(crowded, "bucket"), "bucket_entries")
    score = entries.groupBy("id").agg(F.sum("n").alias("score"))
    hubs = entries.join(score, "id").groupBy("bucket").agg(F.max(F.struct("score", "id")).alias("h"))
    hubs = hubs.select("bucket", F.col("h.id").alias("a"))
    stars = entries.join(hubs, "bucket").filter("id != a").select("a", F.col("id").alias("b")).distinct()
    stars = saved(stars, "star_pairs")
    candidates = saved(picked(rows, stars.select(F.explode(F.array("a", "b")).alias("_key")), rules), "candidate_texts")
    left, right = (candidates.select(F.col("_key").alias(i), F.col("_text").alias(t)) for i, t in (("a", "x"), ("b", "y")))
    found = compared(stars, left, right, lambda t: shingles(t, rules.words)[0])
    links = saved(found.filter(similar(rules)).select("a", "b"), "links")
    groups = saved(components(links), "groups")
    more = saved(rest_links(stars, groups, rows, rules), "more_links")

    final = saved(components(links.unionAll(more).unionAll(tied(sig, texts))).withColumnRenamed("node", "id"), "final_groups")
    owners = final.join(texts.select("id", "low", "low_lone"), "id").groupBy("root").agg(
        F.min("low").alias("group_low"), F.min("low_lone").alias("group_lone"))
    classed = texts.select("digest", "id", "low", "low_lone").join(final.join(owners, "root"), "id", "left")
    alone = F.col("root").isNull()
    classed = classed.select("digest", F.when(alone, F.col("low")).otherwise(F.col("group_low")).alias("class"),
                             F.when(alone, F.col("low_lone")).otherwise(F.col("group_lone")).alias("lone_class"))
    out = sig.select("_lone", "_id", "digest").join(classed, "digest").groupBy("_lone", "_id").agg(
        F.min("class").alias("class"), F.min("lone_class").alias("lone_class"))
    first = F.when(F.col("class").isNull(), F.col("_id") == F.col("lone_class")).otherwise(
        ~F.col("_lone") & (F.col("_id") == F.col("class")))
    return out.select(F.when(~F.col("_lone"), F.col("_id")).alias("_id"), F.when(F.col("_lone"), F.col("_id")).alias("_lone"),
                      "class", first.alias("first"))


def first_of_classes(docs: DataFrame, rules: NearRules = NearRules(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with one row of each group: the one of least id; of rows that repeat it, one of the least digest of its text."""
    first = near_classes(docs, rules, text, doc_id).filter("first").select(
        F.col("_lone").isNotNull().alias("_lone"), F.coalesce("_id", "_lone").alias("_id"))
    whole = whole_text(text)
    rows = docs.select(
        F.col(doc_id).isNull().alias("_lone"), F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(whole)).alias("_id"),
        F.md5(whole).alias("_key"), row_of(docs).alias("_row"))
    kept = rows.join(first, ["_lone", "_id"], "left_semi").groupBy("_lone", "_id").agg(F.min_by("_row", "_key").alias("_row"))
    return kept.select("_row.*")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its id and that of its class, the smallest doc_id in it."""
    classes = near_classes(read(spark, sf_dir, "documents"))
    return classes.select(F.col("_id").alias("doc_id"), F.col("class").alias("class_id"))

"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit verification.

A document holds an item if some stretch of its words is within `max_edits` (a share of the item's
words) insertions, deletions and substitutions of the item. Words are compared without case and
without what is neither letter nor digit at their ends; a word of nothing else does not count.

1. A window so close to an item keeps a known number of the item's word trigrams (each edit breaks
   three at most). Only starts of windows that hold that many trigrams of any item go on; this
   loses nothing.
2. The CGK random walk reads a window from its start: at step j it puts out the word it stands on
   and moves on if a random bit of (step, word) says so. Edits so become differing steps. The walk
   needs no end, so one walk serves items of all lengths; an item samples steps of the part that
   stays within its length.
3. Each repetition has its own walk and its own sampled steps; windows and items that agree in them
   are candidates. The number of repetitions is found by trying: so many that the target share of
   randomly edited items, edited as far as is allowed, is found.
4. Candidates are verified by the exact edit distance.

Items are a stated set, taken in blocks of a bounded number; each block is held against all
documents where these are read. Nothing is shuffled but the matches.

Defined results: null or empty texts hold nothing, and null or empty items are held by nothing;
rows of repeated or null ids are judged one by one, pairs are returned once; empty tables
give empty results; other columns are passed on by decontaminated() and play no part in leaks().
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.common import read
from gantry.llm.near_dedup import KNOWN_WORDS, mixed

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LeakRules:
    max_edits: float = 0.2
    gram: int = 3
    sampled: int = 2
    recall: float = 0.995
    max_repetitions: int = 96
    #: the walk moves at half its steps; samples come from this many steps per word of the item
    reach: float = 1.2
    #: lengths of items that share sampled steps differ by this factor at most
    length_step: float = 1.25
    block_items: int = 5000
    batch_words: int = 400_000


class _Words(dict):
    """Hashes of words as compared, 0 for those that do not count; remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        plain = word.decode().lower().strip(string.punctuation + "«»„“”‘’–—…¿¡")
        self[word] = h = xxhash.xxh3_64_intdigest(plain.encode()) | 1 if plain else 0
        return h


_WORDS = _Words()


def compared_words(text: str | None) -> np.ndarray:
    found = (text or "").encode().split()
    hashed = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    return hashed[hashed != 0]


def grams_of(w: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(w) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * GOLDEN + w[j:j + n]
    return mixed(total + np.uint64(k))


def edit_distance(item: np.ndarray, stretch: np.ndarray, most: int) -> int | None:
    """Least edits between the item and any beginning of the stretch, None if more than `most`."""
    steps = np.arange(len(stretch) + 1)
    row = steps.copy()
    for word in item:
        new = np.minimum(row + 1, np.concatenate(([row[0] + 1], row[:-1] + (stretch != word))))
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return None
    return int(row.min())


class GramSet:
    """Membership in a set of hashes; a table of their first bits answers most questions."""

    def __init__(self, known: np.ndarray):
        self.known, self.shift = np.unique(known), np.uint64(64 - 20)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.known >> self.shift).astype(np.int64)] = True

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Where `grams` holds a member."""
        maybe = np.flatnonzero(self.table[(grams >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == grams[maybe]]


class Matcher:
    """A block of items, ready to be held against texts."""

    def __init__(self, items: list[tuple[int, str]], rules: LeakRules):
        self.rules = rules
        pairs = [(i, compared_words(t)) for i, t in items]
        pairs = [(i, w) for i, w in pairs if len(w)]
        self.ids, self.items = [i for i, _ in pairs], [w for _, w in pairs]
        self.edits = [int(rules.max_edits * len(w)) for w in self.items]
        if not self.items:
            return
        self.longest = max(map(len, self.items))
        # An item shorter than a gram is a gram of its own length.
        found: dict[int, list[np.ndarray]] = {}
        need = []
        for w, k in zip(self.items, self.edits):
            g = min(rules.gram, len(w))
            while g > 1 and len(w) - g + 1 - g * k < 1:
                g -= 1
            need.append(max(1, len(w) - g + 1 - g * k))
            found.setdefault(g, []).append(grams_of(w, g))
        self.grams = {g: GramSet(np.concatenate(v)) for g, v in found.items()}
        self.need = min(need)
        self.vocabularies = [set(w.tolist()) for w in self.items]
        level = [int(np.log(len(w)) / np.log(rules.length_step)) for w in self.items]
        self.levels = {c: min(len(w) for w, x in zip(self.items, level) if x == c) for c in set(level)}
        self.level = np.array(level)
        padded, starts = self._padded(self.items)
        self.tables = [self._keys(padded, starts, r, self.level) for r in range(self._repetitions())]
        self.tables = [(np.argsort(k, kind="stable"), np.sort(k, kind="stable")) for k in self.tables]

    def _padded(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in one array, each followed by room for a window; and where each begins."""
        room = np.zeros(2 * self.longest + 2, np.uint64)
        lengths = np.array([len(t) + len(room) for t in texts])
        return np.concatenate([x for t in texts for x in (t, room)]), np.cumsum(lengths) - lengths

    def _walk(self, words: np.ndarray, starts: np.ndarray, repetition: int, steps: set[int]):
        """(step, place) for the wanted steps of walks from all starts."""
        place, bits = starts.copy(), None
        for j in range(max(steps) + 1):
            if j in steps:
                yield j, place
            if j % 64 == 0:
                bits = mixed(words + np.uint64(0x9E3779B97F4A7C15 * (1000 * repetition + j // 64 + 1) % (1 << 64)))
            place = place + ((bits[place] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)

    def _samples(self, repetition: int) -> dict[int, list[int]]:
        out = {}
        for c, least in self.levels.items():
            reach = max(1, int(self.rules.reach * least))
            draw = np.random.default_rng([repetition, c])
            out[c] = sorted(draw.choice(reach, min(self.rules.sampled, reach), replace=False).tolist())
        return out

    def _keys(self, words, starts, repetition, level=None):
        """Hash of the sampled steps: of each start's own level, or {level: hashes} for all levels."""
        samples = self._samples(repetition)
        keys = {c: np.full(len(starts), repetition * 1000 + c, np.uint64) for c in samples}
        for j, place in self._walk(words, starts, repetition, {s for v in samples.values() for s in v}):
            at = words[place]
            for c, steps in samples.items():
                if j in steps:
                    keys[c] = mixed(keys[c] * GOLDEN + at)
        if level is None:
            return keys
        return np.choose(np.searchsorted(sorted(keys), level), [keys[c] for c in sorted(keys)]) if len(keys) <= 32 else \
            np.array([keys[c][i] for i, c in enumerate(level)], np.uint64)

    def _repetitions(self) -> int:
        """Repetitions after which the target share of edited items has been found."""
        draw = np.random.default_rng(7)
        chosen = [i for i in range(len(self.items)) if self.edits[i]]
        chosen = [chosen[int(k)] for k in np.linspace(0, len(chosen) - 1, min(400, len(chosen)))] if chosen else []
        if not chosen:
            return 1
        edited = []
        for i in chosen:
            w = self.items[i].tolist()
            for _ in range(self.edits[i]):
                at, kind = int(draw.integers(len(w) + 1)), int(draw.integers(3))
                new = int(draw.integers(1, 1 << 63))
                if kind == 0:
                    w.insert(at, new)
                elif at < len(w) and len(w) > 1:
                    w[at:at + 1] = [new] if kind == 1 else []
            tail = draw.integers(1, 1 << 63, self.longest).astype(np.uint64)
            edited.append(np.concatenate([np.array(w, np.uint64), tail]))
        level = self.level[chosen]
        plain, edited = self._padded([self.items[i] for i in chosen]), self._padded(edited)
        found = np.zeros(len(chosen), bool)
        for r in range(self.rules.max_repetitions):
            found |= self._keys(*plain, r, level) == self._keys(*edited, r, level)
            if found.mean() >= self.rules.recall:
                return r + 1
        return self.rules.max_repetitions

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text's place, item id, first word among the compared ones, edits) of every match; at most
        one per text, item and stretch."""
        if not self.items:
            return []
        out, at, batch, n = [], [], [], 0
        for i, text in enumerate(texts):
            w = compared_words(text)
            # Most texts share no gram with any item.
            if any(len(w) >= g and len(known.places(grams_of(w, g))) for g, known in self.grams.items()):
                at.append(i)
                batch.append(w)
                n += len(w)
            if n > self.rules.batch_words:
                out += self._find(at, batch)
                at, batch, n = [], [], 0
        return out + (self._find(at, batch) if batch else [])

    def _find(self, at: list[int], texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        words, begins = self._padded(texts)
        hit = np.zeros(len(words) + 1, np.int64)
        for g, known in self.grams.items():
            hit[1 + known.places(grams_of(words, g))] += 1
        total = np.concatenate([np.cumsum(hit), np.full(self.longest * 2, hit.sum())])
        reach = self.longest + int(self.rules.max_edits * self.longest)
        n = np.arange(len(words))
        starts = np.flatnonzero((total[np.minimum(n + reach, len(words))] - total[n] >= self.need) & (words != 0))
        if not len(starts):
            return []
        pairs = []
        for r, (order, known) in enumerate(self.tables):
            for c, keys in self._keys(words, starts, r).items():
                low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                for k in np.flatnonzero(high > low):
                    for i in order[low[k]:high[k]]:
                        if self.level[i] == c:
                            pairs.append((int(i), int(starts[k])))
        out: list[tuple[int, int, int, int]] = []
        last, until = -1, -1
        for i, start in sorted(set(pairs)):
            item, most = self.items[i], self.edits[i]
            again = i == last and start < until  # the stretch of the match before: the closest start counts
            if again and not out[-1][3]:
                continue
            stretch = words[start:start + len(item) + most]
            # Each edit takes away one word at most.
            if len(self.vocabularies[i].difference(stretch.tolist())) > most:
                continue
            edits = edit_distance(item, stretch, most)
            if edits is None or again and edits >= out[-1][3]:
                continue
            doc = int(np.searchsorted(begins, start, "right")) - 1
            if again:
                out.pop()
            out.append((at[doc], self.ids[i], start - int(begins[doc]), edits))
            last, until = i, start + len(item) - most
        return out


def matchers(items: DataFrame, rules: LeakRules, text: str = "text", item_id: str = "item_id"):
    """A Matcher for each block of items; a block's size is bounded, whatever their number."""
    named = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("t is not null")
    blocks = max(1, -(-named.count() // rules.block_items))
    for b in range(blocks):
        rows = named.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        yield Matcher([(r.i, r.t) for r in rows], rules)


def leaks(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules(), text: str = "text", doc_id: str = "doc_id",
          item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, edits, n_places): the items each document holds, with the least edits."""
    source = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t"))
    out = None
    for matcher in matchers(items, rules, item_text, item_id):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches, shared=shared):
            for frame in batches:
                ids = frame["d"].tolist()
                found = shared.value.find(frame["t"].tolist())
                yield pd.DataFrame({
                    "doc_id": pd.array([None if ids[k] is None else int(ids[k]) for k, *_ in found], "Int64"),
                    "item_id": pd.array([i for _, i, _, _ in found], "Int64"),
                    "edits": np.array([e for *_, e in found], np.int64)})

        part = source.mapInPandas(run, "doc_id long, item_id long, edits long")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.count(F.lit(1)).alias("n_places"))


def decontaminated(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules(), text: str = "text",
                   item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """`docs` without the rows that hold an item."""
    for matcher in matchers(items, rules, item_text, item_id):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches, shared=shared):
            for batch in batches:
                held = {k for k, *_ in shared.value.find(batch.column(text).to_pylist())}
                yield batch.filter(pa.array([i not in held for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

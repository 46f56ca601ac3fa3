"""Importance resampling, periodic runs and token counts, each held against a plain version."""

import hashlib
import math
import pathlib
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCUMENTS, LONG, SF, documents, sha, words
from tokenizers import Tokenizer

from gantry.llm import importance, periodic_runs, token_counts
from gantry.llm.common import read

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from compare import compare, duck

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHES = [
    "n_words", "n_features", "weight", "score", "rank", "_row", "_id", "_made", "_down", "_no_id", "_given", "_place", "_at", "row", "runs",
    "collapsed", "start", "length", "period", "n_bytes", "n_tokens", "over_limit", "bucket", "n", "piece", "best",
]


def clashing(spark):
    """The awkward documents with a column for every name used inside."""
    rows = [(*d[:2], *range(len(CLASHES))) for d in DOCUMENTS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES))


# --- importance resampling


def features(text):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(found), [" ".join(found[i:i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def plain_scores(docs, target):
    """{place: (words, features, weight, score)}"""
    def buckets(text):
        return [zlib.crc32(f.encode()) % 10_000 for f in features(text)[1]]

    own, other = Counter(b for _, t in docs for b in buckets(t)), Counter(b for t in target for b in buckets(t))
    s_all, t_all = own.total(), other.total()
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * (s_all + 10_000) / ((own[b] + 1) * (t_all + 10_000)))) for b in own}
    out = []
    for key, text in docs:
        found = buckets(text)
        h = int(sha(f"42:{'null' if key is None else key}")[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        weight = sum(gain[b] for b in found)
        out.append((features(text)[0], len(found), weight, weight + noise))
    return out


def test_importance_of_documents(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text").collect()
    target = [r.text for r in read(spark, SF, "benchmark").collect()]
    want = {d.doc_id: x for d, x in zip(docs, plain_scores([tuple(d) for d in docs], target))}
    got = {r.doc_id: r for r in importance.op11_importance_resampling(spark, SF).collect()}
    assert {k: (r.n_features, r.weight, r.score) for k, r in got.items()} == {k: v[1:] for k, v in want.items()}
    able = sorted((-v[3], k) for k, v in want.items() if v[0] >= 20)
    drawn = {k: i for i, (_, k) in enumerate(able[: 5 * len(able) // 100], 1)}
    assert {k: r.rank for k, r in got.items() if r.rank} == drawn and len(drawn) > 5


def test_importance_awkward(spark):
    docs, target = clashing(spark), ["copy1 copy2 copy3", None, "", "a line that is long"]
    rules = importance.Resampling(percent=60, min_words=5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resampled(docs, items, rules).toPandas()
    assert set(out.columns) == {"doc_id", "text", *CLASHES} and len(out) == len(DOCUMENTS)
    assert sorted(out["runs"]) == [CLASHES.index("runs")] * len(out)
    want = plain_scores([d[:2] for d in DOCUMENTS], target)
    keys = ["n_words", "n_features", "weight", "score"]
    assert sorted(map(tuple, out[keys].values.tolist())) == sorted(want)
    able = sum(w[0] >= 5 for w in want)
    drawn = out.dropna(subset="rank").sort_values("rank")
    assert drawn["rank"].tolist() == list(range(1, 60 * able // 100 + 1))
    order = list(zip(-drawn.score, drawn.doc_id.isna(), drawn.doc_id.fillna(0)))
    assert order == sorted(order)
    left = out[out["rank"].isna() & (out.n_words >= 5)]
    assert left.score.max() <= drawn.score.min()


def test_importance_ties(spark):
    """Equal texts under one id tie to the last: just so many are drawn."""
    docs = spark.createDataFrame([(7, "one two three four five")] * 40 + [(None, "one two three four five")] * 3, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    out = importance.resampled(docs, none, importance.Resampling(percent=50, min_words=1, probes=3)).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 22)) and len(out) == 43
    assert importance.resampled(docs.limit(0), none).count() == 0
    assert importance.resampled(docs.filter("doc_id = 7"), none, importance.Resampling(percent=100, min_words=1)).filter("rank is null").count() == 0
    assert importance.resampled(docs, none).filter("rank is not null").count() == 0


@pytest.mark.parametrize("probes", [1, 15])
def test_least_reaching(spark, probes):
    rng = random.Random(probes)
    keys = [rng.choice([-(1 << 63) + 5, -3, 0, 0, 9, (1 << 63) - 1, rng.randrange(-50, 50)]) for _ in range(300)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").cache()
    for wanted in (1, 150, 300) if probes > 1 else (77,):
        v = sorted(keys)[wanted - 1]
        assert importance.least_reaching(rows, "k", wanted, probes) == (v, sum(k < v for k in keys), sum(k <= v for k in keys))


# --- periodic runs


def plain_runs(x, repeats=4, least=6):
    best = {}
    for p in range(1, len(x) // repeats + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, repeats * p):
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def plain_collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@st.composite
def sequences(draw):
    x = draw(st.lists(st.integers(0, draw(st.sampled_from([1, 2, 40]))), max_size=draw(st.sampled_from([9, 300]))))
    for _ in range(draw(st.integers(0, 3)) if len(x) > 4 else 0):
        a = draw(st.integers(0, len(x) - 2))
        q = draw(st.integers(1, max(1, (len(x) - a) // 3)))
        for i in range(a + q, draw(st.integers(a, len(x)))):
            x[i] = x[i - q]
    return x


@settings(max_examples=150, deadline=None)
@given(sequences(), st.sampled_from([7, 13, 31]))
def test_runs_of(x, cover):
    got = periodic_runs.runs_of(np.array(x, np.int32), periodic_runs.RunRules(cover=cover))
    assert [tuple(r) for r in got.tolist()] == plain_runs(x)


@settings(max_examples=150, deadline=None)
@given(sequences(), st.sampled_from([7, 31]))
def test_extensions(x, cover):
    if len(x) < 2:
        return
    rng = random.Random(len(x))
    i = np.array([rng.randrange(len(x)) for _ in range(60)])
    j = np.array([rng.choice([k for k in range(len(x)) if k != a]) for a in i])

    def agree(a, b):
        n = 0
        while max(a, b) + n < len(x) and x[a + n] == x[b + n]:
            n += 1
        return n

    assert periodic_runs.Extensions(np.array(x, np.int32), cover).lce(i, j).tolist() == [agree(a, b) for a, b in zip(i, j)]


def test_other_repeats():
    """Rules with fewer repeats than words at a grid point ask for."""
    rng = random.Random(3)
    for repeats, least in ((2, 2), (2, 7), (3, 3), (6, 20)):
        for _ in range(150):
            x = [rng.randrange(2) for _ in range(rng.randrange(60))]
            got = periodic_runs.runs_of(np.array(x, np.int32), periodic_runs.RunRules(repeats=repeats, min_length=least))
            assert [tuple(r) for r in got.tolist()] == plain_runs(x, repeats, least), (repeats, least, x)


def planted(key, w):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i if i < a else a + (i - a) % p] for i in range(len(w))]


def test_runs_of_documents(spark):
    rows = read(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in periodic_runs.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        w, r = planted(key, words(text)), got[key]
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 10


def test_runs_awkward(spark):
    same = " ".join(["again"] * 30_000)
    rows = [(50, same), (51, "x " * 5), (52, "x\ty \x0b x y\nx y x y"), (None, "é é é é é é")]
    docs = clashing(spark)
    more = spark.createDataFrame(rows, "doc_id long, text string")
    out = periodic_runs.periodic_runs(docs.unionByName(more, allowMissingColumns=True)).collect()
    assert len(out) == len(DOCUMENTS) + 4
    for r in out:
        w = words(r.text)
        runs = [(0, 30_000, 1)] if r.doc_id == 50 else [] if r.text == LONG else plain_runs(w)
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == plain_collapsed(w, runs)
    kept = {c for c in CLASHES if c not in ("runs", "collapsed")}
    assert all(out[0][c] is not None for c in kept) and set(out[0].asDict()) == {"doc_id", "text", *CLASHES}
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    assert periodic_runs.with_planted_runs(docs).count() == len(DOCUMENTS)


# --- token counts


def whole_counts(texts):
    """As the library counts, a text at a time."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_documents(spark):
    rows = read(spark, SF, "documents").collect()
    want = dict(zip((r.doc_id for r in rows), whole_counts(r.text or "" for r in rows)))
    got = {r.doc_id: r for r in token_counts.op13_token_counts(spark, SF).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got.values())
    assert {r.doc_id: len((r.text or "").encode()) for r in rows} == {k: r.n_bytes for k, r in got.items()}


ODD = ["<|endoftext|>", "a<|endoftext|>b<|endoftext|>", " <|endoftext|> ", "<|endoftext", "it's we'LL 'sx ''s", "  \t\n  x    y", "\x1c\x1d a\x85b",
       "՘x꟏y", "\U0001f600 \U0001f1e9\U0001f1ea", "１２ ½²x", "́á", "x" * 50_000, " " * 3000 + "\n" * 500, "\U0001df90a", "한국어 日本語"]


def test_counts_awkward(spark):
    docs = clashing(spark)
    texts = ODD + [None, ""]
    more = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    rules = token_counts.CountRules(table=20, cached=50, longest=6)
    out = token_counts.token_counts(both, rules).collect()
    assert [r.n_tokens for r in out] == whole_counts(r.text or "" for r in out)
    assert len(out) == len(DOCUMENTS) + len(texts) and set(out[0].asDict()) == {"doc_id", "text", *CLASHES}
    assert all(r.over_limit == (r.n_tokens > 512) and r.n_bytes == len((r.text or "").encode()) for r in out)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab '’sdteverlm12 \n\t é½ß!?.-_　中՘<|>") | st.characters(exclude_categories=["Cs"])))
def test_pieces(text):
    """Pre-tokens and special tokens add up to what the whole text gives."""
    tokens = token_counts.tokens_of("byte_bpe_50k.json")
    cut = tokens.pieces(text)
    assert cut is None or cut[0] + sum(map(tokens.encode, cut[1])) == tokens.encode(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    docs = read(spark, SF, "documents").select("text").limit(20)
    encode = token_counts.tokens_of(name).encode
    out = token_counts.token_counts(docs, token_counts.CountRules(tokenizer=name)).collect()
    assert all(r.n_tokens == encode(r.text or "") for r in out)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_periodic_runs"])
def test_sql(spark, name):
    from gantry.llm.queries import llm_queries, llm_sql

    assert compare(spark, duck(SF), llm_queries()[name], llm_sql()[name], SF) is None

"""Awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math

import pytest
from llm_cases import COPY, DOCUMENT_TYPES, DOCUMENTS, base_secrets, documents, lines_kept, passages_kept, quality_counts, sha, words
from pyspark.sql import functions as F

import corpus_pipeline
from gantry.llm import (
    chat_format, decontamination, line_dedup, near_dedup, packing, quality_classifier, quality_rules, secrets, substring_dedup,
    url_filter,
)

ITEMS = [(1, " ".join(f"copy{i}" for i in range(30, 60))), (2, None), (3, ""), (4, "two words"), (None, "no id here at all")]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, 0), (3, 0, 0), (None, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_quality_rules(docs):
    got = sorted_rows(quality_rules.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "source")
    want = sorted(((d[0], *quality_counts(d[1]), d[3]) for d in DOCUMENTS), key=repr)
    assert got == want
    kept = {r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()}
    assert not kept & {4, 5, 6}


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs)
    got = sorted_rows(out, "doc_id", "n_lines", "n_dropped", "text", "kept")
    want = sorted(((d[0], *k, d[7]) for d, k in zip(DOCUMENTS, lines_kept([d[:2] for d in DOCUMENTS]))), key=repr)
    assert got == want


def test_substring_dedup(docs):
    got = sorted_rows(substring_dedup.dedup_passages(docs).filter("doc_id is not null"), "doc_id", "n_words", "n_removed", "text", "rule")
    rows = [d for d in DOCUMENTS if d[0] is not None]
    want = sorted(((d[0], *k, d[5]) for d, k in zip(rows, passages_kept([d[:2] for d in rows]))), key=repr)
    assert got == want
    last = {r.text: r.n_removed for r in substring_dedup.dedup_passages(docs).filter("doc_id is null").collect()}
    assert last == {"": 120, DOCUMENTS[-1][1]: 0}


def test_near_dedup(docs):
    got = {(r._id, r["class"]) for r in near_dedup.near_classes(docs).collect()}
    classes = {k: v for k, v in got if k is not None}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9}
    assert sorted(v == 1 for k, v in got if k is None) == [False, True]
    kept = near_dedup.first_of_classes(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 7, 8, 9]


BIG = (1 << 62, (1 << 62) + 9, (1 << 63) - 1, -(1 << 63))


def test_near_dedup_of_any_id(spark):
    """Ids up to both ends of the type, repeated ids of several texts, and rows without an id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(BIG[1], a), (BIG[2], a), (BIG[0], b), (BIG[0], b), (BIG[3], c), (None, c + " more"),
            (1, a + " one"), (2, d), (2, "x y z"), (2, b + " two"), (3, d + " three"), (4, "x y z"), (None, "lone"), (None, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r._id, r["class"]) for r in near_dedup.near_classes(docs).collect()}
    assert got == {(BIG[1], 1), (BIG[2], 1), (1, 1), (BIG[0], 2), (2, 2), (3, 2), (4, 2), (BIG[3], BIG[3]), (None, BIG[3]), (None, None)}
    kept = [(r.doc_id, r.text) for r in near_dedup.first_of_classes(docs).collect()]
    assert {k for k, _ in kept} == {1, 2, BIG[3], None} and len(kept) == 4 and (None, "lone") in kept


def test_passages_and_lines_of_any_id(spark):
    """A row without an id comes after the largest one, and ids do not meet those without."""
    lines = "a line of its own\nshared between all of them"
    passage = " ".join(f"p{i}" for i in range(60))
    ids = (*BIG, 5, None)
    docs = spark.createDataFrame([(i, lines) for i in ids], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()} == {i: 0 if i == BIG[3] else 2 for i in ids}
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs.filter(f"doc_id = {BIG[2]} or doc_id is null")).collect()} == {
        BIG[2]: 0, None: 2}
    docs = spark.createDataFrame([(i, passage) for i in ids], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_passages(docs).collect()} == {i: 0 if i == BIG[3] else 60 for i in ids}
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_passages(
        docs.filter(f"doc_id = {BIG[2]} or doc_id is null")).collect()} == {BIG[2]: 0, None: 60}


def test_decontamination(docs, items):
    found = {tuple(r) for r in decontamination.leaks(docs, items).collect()}
    assert {(d, i, e) for d, i, e, _ in found if i == 1} == {(1, 1, 0), (2, 1, 0), (3, 1, 0), (None, 1, 0)}
    assert not {i for _, i, _, _ in found} - {1, 4, None}
    assert not [d for d, _, _, _ in found if d in (4, 5, 6, 7)]
    kept = decontamination.decontaminated(docs, items.filter("item_id = 1"))
    assert kept.schema == docs.schema
    assert sorted_rows(kept, *docs.columns) == sorted((d for d in DOCUMENTS if d[1] is None or "copy30" not in d[1]), key=repr)


def test_packing(docs):
    cut = packing.pieces(docs, keep_ids=True).cache()
    out = packing.pack(cut).toPandas()
    assert len(out) == cut.count() and out.length.between(1, 2048).all()
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == g.length.cumsum().shift(fill_value=0).to_numpy()).all()
    assert out[out.doc_id.isin([4, 5])].length.tolist() == [1, 1]


def test_classifier(docs, labels):
    model = quality_classifier.trained(docs, labels)
    out = quality_classifier.scored(docs, model).collect()
    assert len(out) == len(DOCUMENTS) and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.score >= 0.7) and r.kept is d for r, d in zip(
        sorted(out, key=repr), [r.kept for r in sorted(out, key=repr)]))
    constant = quality_classifier.fit([], labels=__import__("numpy").empty(0), rules=quality_classifier.ClassifierRules())
    assert {r.score for r in quality_classifier.scored(docs, constant).collect()} == {0.5}


def test_secrets(docs):
    out = secrets.find_secrets(docs)
    assert set(docs.columns) <= set(out.columns)
    for r in out.collect():
        assert [tuple(x) for x in r.base] == base_secrets(r.text or "")


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.org/en/12", "ftp://a.b.com/fr/x?y#z", "x://com/de/", "x://com/de/",
            "http://org", "http://org/", "http://my.org?/q", "http://net/" + "y" * 50_000]
    pages = spark.createDataFrame([(i, u, "h", 3) for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert len(got) == len(urls) and got[0] == ("", "", None, "allow")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("a.b.com", "/fr/x", "com/fr/", "allow") and got[6] == got[7] == ("com", "/de/", "com/de/", "block")
    assert got[8][:3] == ("org", "", None) and got[9] == ("org", "/", "org/", "allow") and got[10][:3] == ("my.org", "", None)
    assert url_filter.judged(pages.filter("page_id < 3")).filter("verdict = 'allow'").count() == 3


def test_chat(spark):
    rows = [(1, 0, "system", "be kind", 1), (1, 1, "ann", "hi <|end|>", 1), (1, 2, "bob", None, 1), (1, 2, "bob", None, 1),
            (1, None, None, "late", 1), (None, 0, "ann", "alone", 1), (2, 0, "system", "only", 1), (1, 700, "ann", "x" * 200_000, 1)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment long")
    out = chat_format.rotated(talks).toPandas().sort_values(["conv_id", "speaker", "seq"])
    one = out[out.conv_id == 1]
    assert set(one.speaker) == {"ann", "bob", "unknown"} and (one.groupby("speaker").seq.apply(list).map(lambda s: s == list(range(6)))).all()
    for _, g in one.groupby("speaker"):
        assert "".join(g.segment)[: g.stop.iloc[-1]] == "".join(g.segment)
        assert g.start.tolist() == [0, *g.stop.tolist()[:-1]]
    ann = one[one.speaker == "ann"]
    text = "".join(ann.segment)
    spans = [text[int(a):int(b)] for a, b in zip(ann.train_start, ann.train_stop) if not math.isnan(a)]
    assert spans == ["hi < |end| ><|end|>\n", "x" * 200_000 + "<|end|>\n"] and text.endswith("<|user unknown|>\nlate<|end|>\n")
    assert (out.conv_id == 2).sum() == 0 and out.conv_id.isna().sum() == 1
    parts = chat_format.dialogues(chat_format.rotated(talks), 1000).filter("conv_id = 1 and speaker = 'ann'").orderBy("part").collect()
    assert "".join(p.text for p in parts) == text
    assert [p.text[s.start:s.stop] for p in parts for s in p.trained] == spans


def test_empty_tables(spark, items, labels):
    none = documents(spark, [])
    for df in (
        quality_rules.judge(none), line_dedup.dedup_lines(none), substring_dedup.dedup_passages(none), near_dedup.near_classes(none),
        decontamination.leaks(none, items), decontamination.decontaminated(none, items.limit(0)), packing.pack(packing.pieces(none)),
        quality_classifier.scored(none, quality_classifier.trained(none, labels)), secrets.find_secrets(none),
        url_filter.judged(spark.createDataFrame([], "page_id long, url string")),
        chat_format.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert df.count() == 0
    assert decontamination.leaks(documents(spark), items.limit(0)).count() == 0


#: Names that the operators use within, and those of results of others; all in capitals once, too.
INTERNAL = (
    "_row", "_out", "_c0", "_c5", "_document", "_lone", "_id", "_key", "_text", "_text_hash", "dropped", "starts", "counts", "_cut", "digest", "buckets",
    "_t", "_l", "_w", "_wc", "_r", "_ref_language", "_base", "_added", "_ruled", "_told", "_ratio", "first", "last", "key", "s", "h",
    "at", "a", "b", "x", "y", "d", "t", "i", "class", "start", "windows", "low", "w1", "_LONE", "STARTS",
)


def test_columns_of_any_name(spark, docs, items, labels):
    """Columns with every internal name come through each operator, and through the stages of the pipeline, as they were."""
    from llm_cases import SF

    wide = docs.select("doc_id", "text", "lang", *(F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n)
                                                   for n in {n.lower(): n for n in INTERNAL}.values()))
    extra = [c for c in wide.columns if c not in ("doc_id", "text", "lang")]
    model = quality_classifier.trained(wide, labels)
    kept = {
        "judge": quality_rules.judge(wide), "secrets": secrets.find_secrets(wide), "lines": line_dedup.dedup_lines(wide),
        "passages": substring_dedup.dedup_passages(wide), "near": near_dedup.first_of_classes(wide),
        "leaks": decontamination.decontaminated(wide, items), "scored": quality_classifier.scored(wide, model),
        "urls": url_filter.judged(wide.withColumnRenamed("text", "url")),
        **{name: stage(spark, wide, SF) for name, stage in corpus_pipeline.STAGES[:-1]},
    }
    for name, out in kept.items():
        rows = out.select("doc_id", *extra).collect()
        assert rows, name
        for r in rows:
            told = "none" if r.doc_id is None else str(r.doc_id)
            assert [r[c] for c in extra] == [f"{c} {told}" for c in extra], name
    assert near_dedup.near_classes(wide).count() and packing.pieces(wide).filter("piece = 0").count() == len(DOCUMENTS)


def test_pipeline_stages(spark, docs, tmp_path):
    """Stages pass the columns of documents on, whatever these are named."""
    from llm_cases import SF

    table = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
    assert {8} <= {r.doc_id for r in table.collect()}
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0

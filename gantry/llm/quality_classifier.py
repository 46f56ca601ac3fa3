"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed character n-grams. Each is scaled by its class log-count ratio,
the vector is brought to length 1, and a linear model with hinge loss is fitted by dual coordinate
descent; its weights are mixed with their mean size. A logistic curve, fitted on labelled rows that
the weights have not seen, turns margins into scores.

The model is fitted in one task on at most `max_rows` labelled rows, those of least hash; every
document is scored where it is read. Nothing is shuffled but the labels.

Defined results: a null or empty text has no n-grams and scores by the intercept; labels that are
null are left out, and several for one document count by their mean (at least a half: 1); without
rows of both classes every score is the share of label 1 (a half without any); a null doc_id is not
held out; an empty table gives an empty result; other columns are passed on by scored(), columns
named as a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.common import read
from gantry.llm.near_dedup import mixed


@dataclass(frozen=True)
class ClassifierRules:
    max_rows: int = 6000
    grams: tuple[int, ...] = (2, 3)
    bits: int = 18
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 12
    mix: float = 0.9
    #: one in so many fitted rows is kept for the logistic curve
    held: int = 4
    threshold: float = 0.7


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, at: np.ndarray) -> float:
        r = self.ratio[at]
        norm = np.sqrt(float(r @ r))
        return self.bias + (float(self.weight[at] @ r) / norm if norm else 0.0)

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(at) + self.offset, -30, 30))))


def features(text: str | None, rules: ClassifierRules) -> np.ndarray:
    """Distinct hashed n-grams of the UTF-8 bytes, in order."""
    data = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint64)
    mark = np.zeros(1 << rules.bits, bool)
    for n in rules.grams:
        if len(data) >= n:
            gram = np.full(len(data) - n + 1, n, np.uint64)
            for j in range(n):
                gram = (gram << np.uint64(8)) | data[j:len(data) - n + 1 + j]
            mark[(mixed(gram) >> np.uint64(64 - rules.bits)).astype(np.int64)] = True
    return np.flatnonzero(mark).astype(np.int32)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, rules: ClassifierRules) -> np.ndarray:
    counts = []
    for label in (1, -1):
        mine = [x for x, k in zip(rows, y) if k == label]
        c = np.bincount(np.concatenate(mine) if mine else [], minlength=1 << rules.bits) + rules.smoothing
        counts.append(c / c.sum())
    return np.log(counts[0] / counts[1])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, rules: ClassifierRules):
    """Weights and intercept of the hinge-loss model by dual coordinate descent; classes weigh the same."""
    weight, bias, alpha = np.zeros(1 << rules.bits), 0.0, np.zeros(len(rows))
    limit = rules.cost * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    size = np.array([float(v @ v) + 1 for v in values])
    order = np.random.default_rng(1)
    for _ in range(rules.epochs):
        for i in order.permutation(len(rows)):
            slack = y[i] * (float(weight[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - slack / size[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weight[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return weight, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve that fits the labels (1, -1) best; targets are drawn in a little."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margins**2).sum(), (s * margins).sum()], [(s * margins).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, rules: ClassifierRules) -> Model:
    y = np.where(labels > 0, 1, -1)
    late = np.arange(len(y)) % rules.held == 0
    if min((y[~late] > 0).sum(), (y[~late] < 0).sum(), (y[late] > 0).sum(), (y[late] < 0).sum()) == 0:
        share = (len(y) and (y > 0).mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        none = np.zeros(1 << rules.bits)
        return Model(none, none, 0.0, 0.0, float(np.log(share / (1 - share))))
    early = np.flatnonzero(~late)
    ratio = log_count_ratio([rows[i] for i in early], y[early], rules)
    values = [ratio[rows[i]] for i in early]
    values = [v / (np.linalg.norm(v) or 1.0) for v in values]
    weight, bias = descend([rows[i] for i in early], values, y[early], rules)
    weight = rules.mix * weight + (1 - rules.mix) * np.abs(weight).mean()
    model = Model(ratio, weight, bias, 1.0, 0.0)
    margins = np.array([model.margin(rows[i]) for i in np.flatnonzero(late)])
    model.slope, model.offset = logistic(margins, y[late])
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, rules: ClassifierRules = ClassifierRules(), text: str = "text",
            doc_id: str = "doc_id", label: str = "quality") -> Model:
    """A model of the `labels` (doc_id and label) that are not held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(doc_id).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64(doc_id), doc_id).limit(rules.max_rows)
    # Bounded by max_rows; of documents that repeat an id one is taken.
    rows = docs.select(doc_id, F.col(text).alias("_text")).join(F.broadcast(known), doc_id)
    rows = rows.groupBy(F.col(doc_id).alias("_id"), "_label").agg(F.first("_text").alias("_text"))

    def extract(batches):
        for frame in batches:
            yield pd.DataFrame({"_id": frame["_id"], "_label": frame["_label"],
                                "at": [features(t, rules) for t in frame["_text"]]})

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        drawn = mixed(frame["_id"].to_numpy().astype(np.uint64))
        frame = frame.iloc[np.argsort(drawn, kind="stable")]
        m = fit(list(frame["at"]), frame["_label"].to_numpy(), rules)
        return pd.DataFrame({"ratio": [m.ratio.astype("<f4").tobytes()], "weight": [m.weight.astype("<f4").tobytes()],
                             "bias": [m.bias], "slope": [m.slope], "offset": [m.offset]})

    sample = rows.mapInPandas(extract, "_id long, _label int, at array<int>")
    found = sample.groupBy().applyInPandas(
        learn, "ratio binary, weight binary, bias double, slope double, offset double").collect()
    if not found:
        return fit([], np.empty(0), rules)
    m = found[0]
    return Model(np.frombuffer(m.ratio, "<f4"), np.frombuffer(m.weight, "<f4"), m.bias, m.slope, m.offset)


def scored(docs: DataFrame, model: Model, rules: ClassifierRules = ClassifierRules(), text: str = "text") -> DataFrame:
    """`docs` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(features(t, rules)) for t in texts], dtype=float)

    return docs.withColumn("score", score(F.col(text))).withColumn(
        "predicted", (F.col("score") >= rules.threshold).cast("int"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

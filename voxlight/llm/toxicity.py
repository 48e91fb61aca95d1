"""Toxicity by a character n-gram linear classifier with naive Bayes features.

A feature is a hashed character n-gram; its value in a text is the number of the text's
distinct words that hold it. The model is fitted on a bounded sample of labelled rows:
naive Bayes log-count ratios are summed per partition, and a ratio that chance explains
(within Z standard errors of 0) counts as 0; a logistic regression follows over the
features scaled by these ratios. The sample takes both labels alike, so that a rare label
is learned too, and the bias is then moved back to the shares of all labelled rows. As the
model is linear, the score of a text is a sum over its distinct words, each looked at once
in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize
from .features import Words, ngrams, spread

SIZES = (3, 4, 5)
DIMS = 1 << 17
#: The model is fitted on about this many labelled rows at most, dealt by a hash of the id: half of
#: them of either label, and where one label has fewer rows, all of these and more of the other.
FIT_ROWS = 20_000
THRESHOLD = 0.3
Z = 3.0
#: Rows of an Arrow batch that are worked on at once.
SLICE = 512


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts)
        starts, features = ngrams(words.vocabulary, SIZES, DIMS)
        each = np.concatenate([[0.0], np.cumsum(self.weights[features])])
        each = each[starts[1:]] - each[starts[:-1]]
        row, word, _ = words.distinct()
        z = np.bincount(row, weights=each[word], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def counts_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), by row and feature."""
    words = Words(texts)
    starts, features = ngrams(words.vocabulary, SIZES, DIMS)
    row, word, _ = words.distinct()
    which, at = spread(starts, word)
    key, value = np.unique(row[which] * DIMS + features[at], return_counts=True)
    return key // DIMS, key % DIMS, value


def ratios(labelled: DataFrame) -> np.ndarray:
    """Naive Bayes log-count ratios over all rows of (text, label): how much likelier a feature is in label 1."""

    def partial(batches):
        sums, seen = np.zeros((2, DIMS)), False
        for batch in slices(batches):
            row, feature, _ = counts_of(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            seen |= batch.num_rows > 0
            for c in (0, 1):
                sums[c] += np.bincount(feature[label[row] == c], minlength=DIMS)
        if seen:
            at = np.flatnonzero(sums.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at // 4096, pa.int32()), pa.array(at % 4096, pa.int32()), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["page", "item", "n0", "n1"])

    parts = labelled.mapInArrow(lean(partial), "page int, item int, n0 double, n1 double")
    sums = parts.groupBy("page", "item").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # DIMS rows at most
    n = np.ones((2, DIMS))
    at = sums["page"].to_numpy(int) * 4096 + sums["item"].to_numpy(int)
    n[0][at] += sums["n0"].to_numpy()
    n[1][at] += sums["n1"].to_numpy()
    r = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    return np.where(np.abs(r) >= Z * np.sqrt(1 / n[0] + 1 / n[1]), r, 0.0)


def fit(labelled: DataFrame, rounds: int = 300, l2: float = 1e-4, stand_for: tuple[float, float] = (1, 1)) -> Model:
    """labelled: (id, text, label), label 0 or 1. Without both labels the score is the share of label 1, or 0.

    All rows of `labelled` are used, so it should hold a bounded sample, of which a row of
    label 0 or 1 stands for so many rows as `stand_for` says.
    """
    shares = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(shares) < 2:
        return Model(np.zeros(DIMS), 30.0 if shares.get(1) else -30.0)
    r = ratios(labelled.select("text", "label"))
    shared = labelled.sparkSession.sparkContext.broadcast(r)

    def sampled(batches):
        for batch in slices(batches):
            row, feature, value = counts_of(batch.column("text"))
            used = shared.value[feature] != 0
            row, feature, value = row[used], feature[used], value[used]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((feature, pa.int32()), (value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *lists], names=["label", "feature", "value"])

    def fitted(batches):
        got = pa.Table.from_batches(list(batches), schema=pa.schema([("label", pa.int32()), ("feature", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))]))
        if not got.num_rows:
            return
        y = got.column("label").to_numpy().astype(float)
        lists = [got.column(c).combine_chunks() for c in ("feature", "value")]
        feature, value = (x.flatten().to_numpy() for x in lists)
        w, bias = logistic(np.repeat(np.arange(len(y)), np.diff(lists[0].offsets.to_numpy())), feature, value * shared.value[feature], y, rounds, l2)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, DIMS)), pa.array(np.append(w[used], bias))], names=["feature", "weight"])

    # A bounded sample in sparse form, so one task may hold it.
    sparse = labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(lean(sampled), "label int, feature array<int>, value array<float>")
    found = sparse.repartition(1).mapInArrow(lean(fitted), "feature long, weight double").toPandas()
    w = np.zeros(DIMS + 1)
    w[found["feature"]] = found["weight"]
    return Model(w[:DIMS] * r, float(w[DIMS] + np.log(stand_for[1] / stand_for[0])) if len(found) else -30.0)


def logistic(row: np.ndarray, feature: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int, l2: float) -> tuple[np.ndarray, float]:
    """(weights, bias) with the least log loss, by accelerated gradient steps; the bias is a column of ones."""
    n = len(y)
    row, feature, x = np.concatenate([row, np.arange(n)]), np.concatenate([feature, np.full(n, DIMS)]), np.concatenate([x, np.ones(n)])
    times = lambda v: np.bincount(row, weights=x * v[feature], minlength=n)
    back = lambda g: np.bincount(feature, weights=x * g[row], minlength=DIMS + 1)
    v = np.ones(DIMS + 1)
    for _ in range(20):  # the largest curvature, by power iteration
        v = back(times(v)) / n
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (0.3 * size + l2)
    w, v, ridge = np.zeros(DIMS + 1), np.zeros(DIMS + 1), np.full(DIMS + 1, l2)
    w[DIMS] = v[DIMS] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ridge[DIMS] = 0
    for k in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(times(v), -500, 500))) - y) / n
        new = v - step * (back(g) + ridge * v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:DIMS], float(w[DIMS])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id and score. A null text counts as empty; its score is the model's bias."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIMS numbers

    def scored(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(batch.column("text")))], names=["id", "score"])

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(scored), "id long, score double")
    return out.withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text scores below the threshold. Texts go through once and are not shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.score(batch.column(text_col)) < threshold))

    return df.mapInArrow(lean(kept), df.schema)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of `documents` learned from `labels`, held-out rows left aside; null labels and texts teach nothing."""
    marks = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    every0, every1 = (max(1, -(-mine // max(FIT_ROWS // 2, FIT_ROWS - other))) for mine, other in ((n0, n1), (n1, n0)))
    # A hash keeps FIT_ROWS ids of a few bytes each, so this side may be broadcast and no text is shuffled.
    sample = marks.where(F.pmod(F.xxhash64("doc_id"), F.when(F.col("label") == 1, every1).otherwise(every0)) == 0)
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return fit(materialize(rows.select(F.col("doc_id").alias("id"), "text", "label"), "labelled"), stand_for=(every0, every1))

"""Document quality by positive-unlabelled learning with a non-negative risk.

Trusted positives are rows labelled 1; everything else, whatever its label, is
unlabelled web text; the class prior is estimated as the share of label 1 among the
training labels. A logistic model over hinges of text measurements minimises
    pi * E_p[l(g, 1)] + max(0, E_u[l(g, 0)] - pi * E_p[l(g, 0)]),
the non-negative unbiased risk: when the second part turns negative, its gradient
is followed backwards. The fit takes at most SAMPLE rows of each kind, chosen by a
hash of the id; scoring is one pass over all texts.

Measurements come from the text alone: shares of byte classes, word lengths and
edges, distinct and repeated words, word pairs and shingles, and lines. Defined
results: a null or empty text has all measurements 0 and is scored like others;
every row is scored, repeated ones and ones with a null id too; with no positive
label every score is the prior, 0.5 if there are no labels at all. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearprose.llm.tables import Workspace, bucket_of
from clearprose.llm.words import mix, shingles, slices, text_bytes, words_of

#: Most rows of each kind that the fit reads.
SAMPLE = 12_000
CUT = 0.3
STEPS, RATE, DECAY = 400, 0.05, 1e-3
#: Quantiles of each measurement where a hinge begins.
HINGES = (0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98)

_CLASS = np.full(256, 9, np.uint8)  # other punctuation
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\v\f\r", b".,;:'\"()-", b"|", b"!?")):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 10
_CLASS[:9] = _CLASS[14:32] = 11
_CLASSES = 12


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    first = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])]) if len(v) else np.zeros(0, bool)
    return np.bincount(o[first], minlength=n)


def measurements(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    blob, origins = text_bytes(column)
    words, n = words_of(blob, origins), len(origins) - 1
    size = np.diff(origins)
    per = lambda a, b: a / np.maximum(b, 1)
    kinds = _CLASS[blob]
    classes = np.bincount(np.repeat(np.arange(n) * _CLASSES, size) + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES)
    owner, count = words.owners(), words.counts
    length = words.ends - words.starts
    total = lambda x: np.bincount(owner, weights=x, minlength=n)
    edge = lambda at, k: per(total(kinds[at] == k), count)
    h = words.hashes
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    pairs = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    inside = owner[1:] == owner[:-1]
    grams, bounds = shingles(words)
    gram_owner = np.repeat(np.arange(n), np.diff(bounds))
    mean_length = per(total(length), count)
    spread = np.sqrt(np.maximum(per(total(length.astype(float) ** 2), count) - mean_length**2, 0))
    columns = [
        *per(classes, size[:, None]).T,
        np.log1p(size), np.log1p(count), mean_length, spread, per(total(length == 1), count), per(total(length > 20), count),
        *(edge(words.starts, k) for k in (1, 2, 7, 9)), *(edge(words.ends - 1, k) for k in (1, 6, 7, 8, 9)),
        per(total(same), count), per(_distinct(h, owner, n), count), per(_distinct(pairs[inside], owner[1:][inside], n), np.maximum(count - 1, 0)),
        per(_distinct(grams, gram_owner, n), np.diff(bounds)), per(count, classes[:, 4] + 1),
    ]
    return np.column_stack(columns).astype(np.float64)


class Model:
    """Scaled hinges and logistic weights."""

    def __init__(self, mean, scale, knots, weights, bias):
        self.mean, self.scale, self.knots, self.weights, self.bias = mean, scale, knots, weights, bias

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, *(np.maximum(z - k, 0) for k in self.knots)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights + self.bias, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative risk by Adam over whole samples."""
    every = np.vstack([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    z = np.clip((every - mean) / scale, -8, 8)
    model = Model(mean, scale, np.quantile(z, HINGES, axis=0), None, 0.0)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    w = np.zeros(p.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    for t in range(1, STEPS + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (p, u))
        as_negative = lambda s: -np.log(np.maximum(1 - s, 1e-12)).mean()
        gain = prior * (p.T @ (sp - 1)) / len(p)  # of E_p[l(g, 1)]
        rest = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)  # of the part that must not be negative
        gradient = gain + rest if as_negative(su) - prior * as_negative(sp) >= 0 else -rest
        gradient[:-1] += DECAY * w[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w -= RATE * (1 - t / (STEPS + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    model.weights, model.bias = w[:-1], w[-1]
    return model


def _measured(texts: DataFrame) -> np.ndarray:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(list(measurements(part.column(0))), pa.list_(pa.float64()))], ["x"])

    got = texts.select("text").mapInArrow(run, "x array<double>").limit(2 * SAMPLE).toArrow()["x"]  # the limit holds only where one id has very many rows
    return np.array(got.to_pylist(), float)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model | float:
    """The model, or a constant score where there is no positive label."""
    spark = docs.sparkSession
    Workspace(spark, "quality")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull())
    labels = labels.filter("quality is not null and doc_id is not null")
    n = labels.agg(F.count("*").alias("n"), F.count(F.when(F.col("quality") == 1, 1)).alias("p")).first()
    rows = docs.count()
    if not n.p or not rows:
        return n.p / n.n if n.n else 0.5

    def chosen(count: int, salt: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / count))

    ids = labels.filter((F.col("quality") == 1) & chosen(n.p, 1)).select("doc_id").distinct()
    positive = _measured(own.join(F.broadcast(ids), "doc_id", "left_semi"))  # at most about SAMPLE ids
    unlabelled = _measured(own.filter(chosen(rows, 2)))
    if not len(positive) or not len(unlabelled):
        return n.p / n.n
    return fit(positive, unlabelled, n.p / n.n)


def score(docs: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """The table's rows with score and predicted, which take the place of input columns of these names in any case."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model)).withColumn("predicted", (F.lit(model) >= CUT).cast("int"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                s = model.score(measurements(part.column(part.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    Workspace(docs.sparkSession, "quality")
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    kept = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    schema = StructType([*kept, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.select(*[f.name for f in kept]).mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from: all but the held-out fifth."""
    return labels.select("doc_id", "quality").filter(bucket_of("doc_id", 5) != 0)


def training_documents(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.filter(bucket_of(doc_id, 5) != 0)

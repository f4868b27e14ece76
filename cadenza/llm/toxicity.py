"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, whole documents of unknown label the unlabelled ones; with the class prior
``pi`` the risk is ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))``, and where the second part turns negative the step goes
the other way (Kiryo et al., 2017). Linear numpy classifiers with the logistic loss are trained from several
starts, and their mean logit is the score's. Features are a document's rates of whole words and of word beginnings of
four to six letters that positives hold often; labels, lang, source and doc_id are not among them.

Labels are learnt only from rows whose crc32(doc_id as text) is not divisible by 5. Training takes at most
``positives`` and ``unlabelled`` documents, those first in the order of a hash of their doc_id; the prior is that of all
rows learnt from. Without any positive every score is ``prior``. Every document is scored over its whole text, each
row gives one row, a null or empty text gets the score of the bias alone, and a null doc_id is not held out. Of
repeated labels for a document the largest counts. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, shared_dir, sliced, written

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(text: str | None) -> tuple[Counter, int]:
    """How often each whole word and word beginning occurs, and the number of words."""
    words = Counter(WORD.findall(text.lower())) if text else Counter()
    out: Counter = Counter()
    for word, n in words.items():
        out[f"{word}$"] += n
        for k in PREFIXES:
            if len(word) >= k:
                out[word[:k]] += n
    return out, sum(words.values())


@dataclass(frozen=True)
class Model:
    """Weights of the features that have one; ``bias`` and ``scale`` as in :func:`value`."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        words = Counter(WORD.findall(text.lower())) if text else {}
        total = sum(words.values())
        found: dict[str, int] = {}
        for word, n in words.items():
            if (key := word + "$") in self.weights:
                found[key] = found.get(key, 0) + n
            for k in PREFIXES:
                if len(word) >= k and (key := word[:k]) in self.weights:
                    found[key] = found.get(key, 0) + n
        z = self.bias + sum(self.weights[key] * value(n, total) for key, n in found.items())
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def value(n, total):
    """A feature's value from its count and the words of the text: its rate in thousandths, dampened."""
    return np.log1p(1000 * n / (total + 20))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, a: np.ndarray, b: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Risk of positives ``a`` and unlabelled ``b``: its positive part, its negative part before the bound at 0, and the
    direction of a step: the gradient of their sum, or where the negative part is below 0 that of its opposite.

    Losses are log(1 + exp(-z)) as positive and log(1 + exp(z)) as negative; the last of ``w`` is the bias.
    """
    z_p, z_u = a @ w[:-1] + w[-1], b @ w[:-1] + w[-1]
    positive = prior * np.logaddexp(0, -z_p).mean()
    negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    g_up, g_un, g_pn = (_sigmoid(z_p) - 1) / len(a), _sigmoid(z_u) / len(b), _sigmoid(z_p) / len(a)
    g_p, g_u = (prior * g_up - prior * g_pn, g_un) if negative >= 0 else (prior * g_pn, -g_un)
    return positive, negative, np.append(a.T @ g_p + b.T @ g_u, g_p.sum() + g_u.sum())


def fit(x_p: np.ndarray, x_u: np.ndarray, prior: float, seeds: int = 3, epochs: int = 60, rate: float = 0.02, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Mean weights and bias of ``seeds`` classifiers trained by Adam on the non-negative risk."""
    found = []
    for seed in range(seeds):
        rng = np.random.default_rng(seed)
        w = np.append(rng.normal(0, 0.01, x_p.shape[1]), np.log(prior / (1 - prior)))
        m, v, t = np.zeros_like(w), np.zeros_like(w), 0
        steps = max(1, len(x_u) // 512)
        for _ in range(epochs):
            order_p, order_u = rng.permutation(len(x_p)), rng.permutation(len(x_u))
            for part_p, part_u in zip(np.array_split(order_p, steps), np.array_split(order_u, steps), strict=True):
                if not len(part_p) or not len(part_u):
                    continue
                g = risk(w, x_p[part_p], x_u[part_u], prior)[2] + np.append(ridge * w[:-1], 0)
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        found.append(w)
    w = np.mean(found, 0)
    return w[:-1], float(w[-1])


def _vectors(place: dict[str, int]):
    """Places and values of each text's features that aren't 0, few of all: what the driver gets stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at, values = [], []
            for text in batch.column(0).to_pylist():
                found, total = features(text)
                own = [(place[x], n) for x, n in found.items() if x in place]
                at.append(np.array([k for k, _ in own], np.int32).tobytes())
                values.append(np.array([value(n, total) for _, n in own], np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["positive", "at", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 6000, most: int = 1500) -> Model:
    """A model from at most ``positives`` and ``unlabelled`` documents with at most ``most`` features."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    known = labels.selectExpr("cast(doc_id as long) doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    prior = min(0.9, max(0.001, share))
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = first(known.where("toxic > 0").join(docs.select("doc_id"), "doc_id", "left_semi"), positives).select("doc_id", F.lit(1).alias("positive"))
    rest = first(docs.select("doc_id").where("doc_id is not null").where(~held_out()).distinct(), unlabelled).select("doc_id", F.lit(0).alias("positive"))
    # At most positives + unlabelled ids, so a small side whatever the corpus.
    chosen = written(docs.join(F.broadcast(some.unionByName(rest)), "doc_id"), shared_dir(docs.sparkSession, "toxicity"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[0][x] for x in names], pa.int64()), pa.array([seen[1][x] for x in names], pa.int64())], ["name", "u", "p"])
            for s in seen:
                s.clear()
            return out

        for batch in sliced(batches, 64):
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[positive].update(features(text)[0].keys())
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield flush()
        yield flush()

    sizes = dict(chosen.groupBy("positive").count().collect())
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return Model({}, float(np.log(prior / (1 - prior))))
    counts = chosen.select("text", "positive").mapInArrow(counted, "name string, u long, p long").groupBy("name").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    # How much more often positives hold it than a text at large, in standard errors.
    excess = F.expr(f"(p / {n_p}d - u / {n_u}d) / sqrt((p + u + 1) / {n_p + n_u}d * (1 / {n_p}d + 1 / {n_u}d))")
    chosen_names = counts.where(f"p >= {max(2, round(0.004 * n_p))}").withColumn("excess", excess).orderBy(F.abs("excess").desc(), "name").limit(most)
    names = [r["name"] for r in chosen_names.select("name").collect()]
    place = {x: i for i, x in enumerate(names)}

    rows = chosen.select("text", "positive").mapInArrow(_vectors(place), "positive int, at binary, x binary").toArrow()
    # A matrix of at most positives + unlabelled rows and ``most`` columns, and no copy of it.
    x, filled = [np.zeros((n, len(names)), np.float32) for n in (n_u, n_p)], [0, 0]
    for batch in rows.to_batches():
        for positive, at, values in zip(*batch.columns, strict=True):
            kind = positive.as_py()
            x[kind][filled[kind], np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(values.as_buffer(), np.float32)
            filled[kind] += 1
    del rows
    release()
    w, bias = fit(x[1], x[0], prior)
    del x
    release()
    return Model({n: float(a) for n, a in zip(names, w, strict=True) if abs(a) > 1e-6}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Model(*shared.value)
        for batch in sliced(batches):
            scores = [found.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``model`` does not call toxic, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Model(*shared.value)
        for batch in sliced(batches):
            yield batch.filter(pa.array([found.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Operator 8: toxicity, by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams that it holds (held or not, however often), each scaled by the log ratio of
its smoothed shares among toxic and other labelled texts; a logistic model with an elastic-net penalty is fitted to these by
accelerated proximal gradient steps, both classes counting alike. n-grams whose shares in the two classes differ by less than
LEAST_Z standard errors are left out, and at most FEATURES stay, those with the clearest difference. Shares and differences are
computed in Spark; the driver gets the chosen n-grams and which of them each sampled text holds.

Scores are calibrated on labelled texts that the fit of their fold hasn't seen (equal texts share a fold): a logistic curve, shifted so
that THRESHOLD lies where toxic texts are told from others best (F1).

Cases: null and empty texts have no n-grams and get the score of the intercept; very long texts are read in pieces, whole;
repeated rows get the same score, and a labelled id that repeats counts as toxic if any of its labels does; ties between n-grams go to
the lower bucket; without labelled rows of both classes the score is the share of the class; an empty table
gives an empty result; columns of the input other than those named are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import deleted, fold_of, table, thrifty, written
from sigloom.llm.ngrams import class_shares, distinct_buckets, labelled_sample

ORDERS, BITS = (3, 4, 5), 20
#: The most labelled rows of each class that the classifier is fitted on.
PER_CLASS = 2500
#: The most n-grams that the classifier looks at, and how many standard errors apart their shares in the classes must be.
FEATURES, LEAST_Z = 1 << 13, 2.0
#: Penalties of the fit, its steps, and the folds of the calibration.
L1, L2, STEPS, FOLDS = 1e-3, 1e-4, 150, 3
#: Documents whose score reaches this are called toxic.
THRESHOLD = 0.7


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Model:
    """The buckets that have a weight, sorted, and their weights; the score's curve is part of weights and intercept."""

    intercept: float
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def laid_out(self) -> np.ndarray:
        """The weight of every bucket."""
        full = np.zeros(1 << BITS, np.float32)
        full[self.at] = self.weights
        return full


class Scorer:
    """A model laid out for lookups, once per task."""

    def __init__(self, model: Model) -> None:
        self.weights, self.intercept = model.laid_out(), model.intercept
        self.mask = self.weights != 0

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.intercept + float(self.weights[distinct_buckets(text, ORDERS, BITS, self.mask)].sum())))


def fit_linear(rows: list[np.ndarray], y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights of `width` features and the intercept; rows: the features that each text holds."""
    owner, flat = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate(rows)
    n1 = y.sum()
    n0 = len(y) - n1
    in1, in0 = (np.bincount(flat[y[owner] == k], minlength=width) for k in (1, 0))
    ratio = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    each, scale = np.where(y == 1, 0.5 / n1, 0.5 / n0), ratio[flat]

    def values(v: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(owner, scale * v[flat], len(y)) + b

    def back(d: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(flat, d[owner] * scale, width), float(d.sum())

    u, ub, size = ratio.copy(), 1.0, 1.0
    for _ in range(20):  # the curvature's largest value bounds the step
        u, ub = back(each * values(u, ub))
        size = float(np.sqrt(u @ u + ub * ub)) or 1.0
        u, ub = u / size, ub / size
    step = 1 / (size / 4 + L2)
    v, b = np.zeros(width), 0.0
    w, c, t = v, b, 1.0
    for _ in range(STEPS):
        g, gb = back(each * (sigmoid(values(w, c)) - y))
        new = w - step * (g + L2 * w)
        new, new_b, new_t = np.sign(new) * np.maximum(np.abs(new) - L1 * step, 0), c - step * gb, (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, c = new + (t - 1) / new_t * (new - v), new_b + (t - 1) / new_t * (new_b - b)
        v, b, t = new, new_b, new_t
    return v * ratio, float(b)


def curve(values: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibration: a logistic curve by Newton steps, shifted so that THRESHOLD is at the best cut."""
    a, c = 1.0, 0.0
    for _ in range(60):
        q = sigmoid(a * values + c)
        d, h = q - y, q * (1 - q)
        g = np.array([d @ values + (a - 1) * 1e-2, d.sum()])
        m = np.array([[(h * values) @ values + 1e-2, h @ values], [h @ values, h.sum() + 1e-6]])
        move = np.linalg.solve(m, g)
        move *= min(1, 2 / (np.abs(move).max() + 1e-12))
        a, c = a - move[0], c - move[1]
    a = max(a, 1e-3)
    order = np.argsort(-values, kind="stable")
    caught, named = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    best = int(np.argmax(2 * caught / (named + y.sum())))
    cut = (values[order][best] + values[order][min(best + 1, len(y) - 1)]) / 2
    return a, float(np.log(THRESHOLD / (1 - THRESHOLD)) - a * cut)


def fit(rows: list[np.ndarray], y: np.ndarray, share: float, chosen: np.ndarray) -> Model:
    """rows: of each text the places among the chosen buckets; share: the share of class 1, the score if there is nothing to learn."""
    y = np.asarray(y, float)
    if not 0 < y.sum() < len(y) or not len(chosen):
        return Model(float(np.log(share / (1 - share))))
    fold = np.array([zlib.crc32(x.tobytes()) % FOLDS for x in rows])
    values, seen = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(FOLDS):
        mine = fold == k
        if mine.any() and 0 < y[~mine].sum() < (~mine).sum():
            w, b = fit_linear([x for x, m in zip(rows, mine) if not m], y[~mine], len(chosen))
            values[mine], seen[mine] = [b + w[x].sum() for x, m in zip(rows, mine) if m], True
    weights, b = fit_linear(rows, y, len(chosen))
    a, c = curve(values[seen], y[seen]) if 0 < y[seen].sum() < seen.sum() else (1.0, 0.0)
    used = np.flatnonzero(weights)
    return Model(a * b + c, chosen[used], a * weights[used])


def class_counts(docs: DataFrame) -> DataFrame:
    """bucket, in1, in0: how many of the texts of docs (y, text) of either class hold each bucket; bucket -1: how many there are."""

    @thrifty
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        n = [0, 0]
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[y, distinct_buckets(t, ORDERS, BITS)] += 1
                n[y] += 1
        at = np.flatnonzero(sums.any(0))
        cols = [np.append(at, -1), np.append(sums[1, at], n[1]), np.append(sums[0, at], n[0])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["bucket", "in1", "in0"])

    parts = docs.select("y", "text").mapInArrow(partial, "bucket long, in1 long, in0 long")
    return parts.groupBy("bucket").agg(F.sum("in1").alias("in1"), F.sum("in0").alias("in0"))


def chosen_buckets(counts: DataFrame) -> np.ndarray:
    """The buckets, sorted, that the classifier looks at; counts: as class_counts gives them."""
    total = counts.filter("bucket = -1").first()
    if total is None or not total["in1"] or not total["in0"]:
        return np.zeros(0, np.int32)
    n1, n0 = total["in1"], total["in0"]
    p = (F.col("in1") + F.col("in0") + 0.5) / float(n1 + n0 + 1)
    z = F.abs(F.col("in1") / F.lit(float(n1)) - F.col("in0") / F.lit(float(n0))) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    clear = counts.filter("bucket >= 0 and in1 + in0 >= 2").select("bucket", z.alias("z")).filter(F.col("z") >= LEAST_Z)
    got = clear.orderBy(F.desc("z"), "bucket").limit(FEATURES).select("bucket").toArrow()
    return np.sort(got.column("bucket").to_numpy()).astype(np.int32)


def held_places(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """y and which of the chosen buckets, by their place, each text of docs (y, text) holds."""
    shipped = docs.sparkSession.sparkContext.broadcast(chosen)

    @thrifty
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[shipped.value] = np.arange(len(shipped.value), dtype=np.int32)
        mask = place >= 0
        for b in batches:
            rows = [place[distinct_buckets(t, ORDERS, BITS, mask)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["y", "x"])

    return docs.select("y", "text").mapInArrow(found, "y int, x array<int>")


def trained(docs: DataFrame, sample: DataFrame, share: float) -> Model:
    """sample: doc_id and y, of bounded size; docs: doc_id and text."""
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    counts = written(class_counts(labelled), "class-counts")
    chosen = chosen_buckets(counts)
    deleted(counts)
    if not len(chosen):
        return fit([], np.zeros(0), share, chosen)
    got = held_places(labelled, chosen).toArrow()
    x = got.column("x").combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    flat, ends = np.asarray(x.values), np.asarray(x.offsets)
    return fit([flat[ends[i] : ends[i + 1]] for i in range(got.num_rows)], got.column("y").to_numpy(), share, chosen)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row; the model (at most 12 bytes for each of FEATURES) is broadcast once."""
    kind = dict(docs.dtypes)[doc_id]
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @thrifty
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Scorer(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, f"doc_id {kind}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, labelled_sample(spark, sf_dir, "toxic", PER_CLASS, 3, 1), class_shares(spark, sf_dir, "toxic", 3, 1))
    return scored(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

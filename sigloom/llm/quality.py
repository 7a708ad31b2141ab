"""Operator 5: a quality classifier from positive and unlabelled texts.

A small network over measures of form (symbols, case, repetition, word and line lengths ...) is fitted by minimising the
non-negative unbiased risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

of trusted positives and unlabelled web text. The class prior is estimated from these two alone: over thresholds under which few
positives fall, the least ratio of the shares of unlabelled texts and of positives above, on halves that their classifier hasn't seen.
Label 0 is never used: unlabelled text is a sample of all texts outside the held-out fold.

Cases: null and empty texts have the measures of an empty text and get a score like any other; very long texts are measured
whole; repeated rows get equal scores, and a repeated positive id counts once; ties in the sample's hash go by id; without positives or
unlabelled texts every score is FIRST_PRIOR; an empty table gives an empty result; columns other than those named are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import fold_of, give_back, table, thrifty

#: The most trusted positives and the most unlabelled texts that the classifier is fitted on.
POSITIVES, UNLABELLED = 4000, 8000
THRESHOLD = 0.5
#: Where the estimate of the class prior starts, and its rounds.
FIRST_PRIOR, PRIOR_ROUNDS = 0.5, 2
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")
_NOISY = re.compile(r"\S*\w[^\w\s.,;:'\")-]+(?=\s|$)")


def measures(text: str | None) -> list[float]:
    """Shares and logarithms that describe a text's form, the same for texts of any length and language."""
    text = text or ""
    words = text.split()
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    n_chars, n_words, n_lines = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    counts, by_line = Counter(words), Counter(lines)
    upper = sum(map(str.isupper, words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    distinct = len(counts) / n_words
    repeated_lines = sum(len(k) * (v - 1) for k, v in by_line.items() if v > 1)
    lengths = sum(map(len, words)) / n_words
    return [
        len(_SYMBOL.findall(text)) / n_chars * 10,
        len(_NOISY.findall(text)) / n_words * 3,
        text.count("|") / n_words * 3,
        text.count("!") / n_words * 3,
        text.count(".") / n_words * 3,
        text.count(",") / n_words * 3,
        upper / n_words * 3,
        same / n_words * 5,
        max(counts.values(), default=0) / n_words * 3,
        distinct,
        np.log1p(len(counts)) / np.log(n_words + 2),
        repeated_lines / n_chars,
        sum(map(str.isalpha, words)) / n_words,
        sum(any(map(str.isdigit, w)) for w in counts) / max(1, len(counts)),
        lengths / 10,
        max(map(len, counts), default=0) ** 0.5 / 5,
        np.log1p(n_words) / 8,
        np.log1p(n_words / n_lines) / 5,
        float(not words),
    ]


N_MEASURES = len(measures(""))


@dataclass
class Model:
    """One hidden layer; without it (nothing to learn from) the score is the prior."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None or not len(x):
            return np.full(len(x), self.prior)
        w1, b1, w2, b2 = self.layers
        z = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, rounds: int = 60, batches: int = 10, l2: float = 1e-4, seed: int = 5) -> Model:
    """Adam on the non-negative risk with the logistic loss; where the negative part is below zero its gradient is turned round."""
    if not len(positive) or not len(unlabelled):
        return Model(prior)
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    params = [rng.normal(0, 0.3, (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(())]
    m, v, t = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0

    def gradient(x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        h = np.tanh(x @ params[0] + params[1])
        back = np.outer(d, params[2]) * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ d, d.sum()]

    sig = lambda x: 1 / (1 + np.exp(-np.clip(np.tanh(x @ params[0] + params[1]) @ params[2] + params[3], -50, 50)))
    for epoch in range(rounds):
        for ip, iu in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)):
            if not len(ip) or not len(iu):
                continue
            xp, xu = p[ip], u[iu]
            sp, su = sig(xp), sig(xu)
            negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
            g_neg = [a - b for a, b in zip(gradient(xu, su / len(iu)), gradient(xp, prior * sp / len(ip)))]
            if negative < 0:
                g = [-x for x in g_neg]
            else:
                g = [a + b for a, b in zip(gradient(xp, prior * (sp - 1) / len(ip)), g_neg)]
            t += 1
            rate = 0.02 * (1 - 0.9 * epoch / rounds)
            for k in range(4):
                gk = g[k] + l2 * params[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(prior, mean, scale, tuple(params))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, prior: float = FIRST_PRIOR, rounds: int = PRIOR_ROUNDS) -> float:
    """The share of positives among the unlabelled rows, from scores of halves that the fit hasn't seen."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return prior
    own, other = np.arange(len(positive)) % 2, np.arange(len(unlabelled)) % 2
    for _ in range(rounds):
        p, u = np.zeros(len(positive)), np.zeros(len(unlabelled))
        for k in range(2):
            m = fit(positive[own != k], unlabelled[other != k], prior)
            p[own == k], u[other == k] = m.scores(positive[own == k]), m.scores(unlabelled[other == k])
        cuts = np.quantile(p, np.linspace(0.01, 0.5, 50))
        prior = float(np.clip(min((u >= c).mean() / (p >= c).mean() for c in cuts), 0.02, 0.98))
    return prior


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep and x, the measures of each text."""
    kinds = dict(docs.dtypes)

    @thrifty
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measures(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(rows, pa.list_(pa.float64()))], [*keep, "x"])

    return docs.select(*keep, text).mapInArrow(measure, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", x array<double>")


def _matrix(df: DataFrame) -> np.ndarray:
    rows = df.toArrow().column("x").combine_chunks()
    flat = rows.values if isinstance(rows, pa.ListArray) else (rows.chunk(0).values if rows.num_chunks else pa.array([], pa.float64()))
    return np.asarray(flat).reshape(-1, N_MEASURES)


def trained(docs: DataFrame, positives: DataFrame, n_unlabelled: int, n_docs: int) -> Model:
    """positives: at most POSITIVES ids; n_docs: rows of docs, of which about n_unlabelled are drawn by a hash of the id."""
    p = _matrix(measured(docs.join(F.broadcast(positives), "doc_id").select("doc_id", "text"), ["doc_id"]).orderBy("doc_id"))
    share = int(min(1.0, n_unlabelled / max(1, n_docs)) * (1 << 40))
    u = _matrix(measured(docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 40)) < share).select("doc_id", "text"), ["doc_id"]).orderBy("doc_id").limit(2 * n_unlabelled))
    return fit(p, u, estimated_prior(p, u))


def score_of(spark: SparkSession, model: Model):
    """A function of a text column: its score."""
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            rows = [measures(t) for at in range(0, len(column), 256) for t in column.slice(at, 256).to_pylist()]
            yield pa.array(shipped.value.scores(np.array(rows).reshape(-1, N_MEASURES)), pa.float64())
        give_back()

    return score


def model_from(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier of documents and labels (doc_id, quality), from the rows outside the held-out fold."""
    docs = docs.filter(fold_of(F.col("doc_id"), 3) != 1)
    learn = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter((F.col("y") == 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), 3) != 1))
    positives = learn.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).distinct()
    return trained(docs, positives, UNLABELLED, docs.count())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents")
    score = score_of(spark, model_from(docs, table(spark, sf_dir, "labels")))
    return docs.select("doc_id", score("text").alias("score")).select(
        "doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

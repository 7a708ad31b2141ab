"""Operator 6: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed character n-grams are counted over all texts that may be learned from. The classifier is fitted
on a bounded sample of each language by follow-the-regularised-leader with elastic-net penalties (the L1 part keeps it
sparse), and its logits are then divided by one temperature, chosen on sampled texts that the fit hasn't seen. All languages are
learned, however many there are.

Cases: a text that is null or has no letter gets "und" and score 0; very long texts are read in pieces, whole; repeated rows get
equal results; ties between languages go to the first in alphabetical order; with nothing to learn from every text is "und";
an empty table gives an empty result; columns other than those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import fold_of, table, thrifty
from sigloom.llm.ngrams import hashed

ORDERS, BITS = (1, 2, 3), 15
#: The most texts of each language that the classifier is fitted on.
PER_LANG = 600
#: The most weights of a model: with very many languages there are fewer buckets, so that their product stays under this.
CELLS = 1 << 24
UND = "und"


def counted(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    total = None
    for x in hashed(text, ORDERS, bits):
        if total is None and len(x) < 1 << (bits - 2):
            total = np.unique(x, return_counts=True)
            continue
        more = np.bincount(x, minlength=1 << bits)
        if isinstance(total, tuple):
            more[total[0]] += total[1]
        elif total is not None:
            more += total
        total = more
    if isinstance(total, tuple):
        return total
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    intercept: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that a text holds, with their weights; n: how often each occurs."""
        v = (1 + np.log(n)) * self.idf[at]
        return at, v / (np.sqrt((v * v).sum()) or 1)

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (v @ self.weights[at] + self.intercept) / self.temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not any(map(str.isalpha, text or "")):
            return UND, 0.0
        p = softmax(self.logits(*self.vector(*counted(text, bits_of(self.idf)))))
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def bits_of(idf: np.ndarray) -> int:
    return len(idf).bit_length() - 1


def bits_for(n_langs: int) -> int:
    return max(8, min(BITS, (CELLS // max(1, n_langs)).bit_length() - 1))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(texts: list[str | None | tuple[np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002, rounds: int = 3, seed: int = 7) -> Model:
    """FTRL-proximal over the texts (or their counted buckets) in an order drawn anew each round; every fifth text is left for the temperature."""
    names = sorted(set(langs))
    number = {x: k for k, x in enumerate(names)}
    y = np.array([number[x] for x in langs], int)
    model = Model(names, np.zeros((len(idf), len(names))), np.zeros(len(names)), idf)
    if not names:
        return model
    rows = [model.vector(*(t if isinstance(t, tuple) else counted(t, bits_of(idf)))) for t in texts]
    held = np.arange(len(rows)) % 5 == 4
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    bias_n = np.zeros(len(names))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(np.flatnonzero(~held)):
            at, v = rows[i]
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))
            p = softmax(v @ w + model.intercept)
            p[y[i]] -= 1
            g = v[:, None] * p
            grown = na + g * g
            z[at] = za + g - (np.sqrt(grown) - np.sqrt(na)) / alpha * w
            n[at] = grown
            bias_n += p * p
            model.intercept -= 0.1 * p / (1 + np.sqrt(bias_n))
    model.weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    logits = np.array([model.logits(*rows[i]) for i in np.flatnonzero(held)]).reshape(-1, len(names))
    if len(logits):
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        loss = [-np.mean([np.log(softmax(row / t)[k] + 1e-12) for row, k in zip(logits, y[held])]) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    model.weights = model.weights.astype(np.float32)
    return model


def document_frequencies(docs: DataFrame, text: str = "text", bits: int = BITS) -> tuple[np.ndarray, int]:
    """Texts that hold each bucket, and texts in all. Each task adds up its own; 2**bits sums come to the driver."""

    @thrifty
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df[counted(t, bits)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["bucket", "df"])

    got = docs.select(text).mapInArrow(partial, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    df, n = np.zeros(1 << bits), 0
    bucket, count = got.column("bucket").to_numpy(), got.column("df").to_numpy()
    df[bucket[bucket >= 0]] = count[bucket >= 0]
    n = int(count[bucket < 0].sum())
    return df, n


def counted_rows(docs: DataFrame, bits: int) -> DataFrame:
    """lang, and the distinct buckets and their counts of each text of docs (lang, text): 2**bits numbers at most, however long the text."""

    @thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counted(t, bits) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in rows], pa.list_(pa.int32())), pa.array([n for _, n in rows], pa.list_(pa.int32()))], ["lang", "at", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, at array<int>, n array<int>")


def trained(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from all rows of docs (text and non-null lang): frequencies from all of them, weights from a bounded sample.

    The sample is drawn by a hash of the id, and its rows are picked by their hash's threshold first, so that only few rows are
    sorted per language. The driver gets the sample's counted buckets, not its texts.
    """
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    bits = bits_for(sizes.count())
    df, n = document_frequencies(rows, bits=bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    at = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 40))
    share = F.least(F.lit(1.0), (2 * PER_LANG + 50) / F.col("size"))  # twice as many as wanted are expected under the threshold
    order = Window.partitionBy("lang").orderBy("at", "doc_id")
    near = rows.withColumn("at", at).join(sizes, "lang").filter(F.col("at") < share * float(1 << 40))
    picked = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PER_LANG).orderBy("at", "doc_id", "text")
    got = counted_rows(picked, bits).toArrow()
    pairs = list(zip(*([np.asarray(x, np.int64) for x in got.column(c).to_pylist()] for c in ("at", "n"))))
    return fit(pairs, got.column("lang").to_pylist(), idf)


def predicted(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row; the model (2**BITS weights a language) is broadcast once."""
    kind = dict(docs.dtypes)[doc_id]
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @thrifty
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            got = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs.filter(fold_of(F.col("doc_id"), 4) != 2))
    return predicted(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")

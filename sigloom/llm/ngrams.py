"""Hashed character n-grams of whole texts, and how the classifiers get a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import fold_of, table

#: Texts are read in pieces of so many characters, with the overlap that n-grams need: memory doesn't grow with a text.
PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def hashed(text: str | None, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all character n-grams of the lower-cased text, a piece at a time; white space counts as one blank."""
    text = f" {' '.join((text or '').lower().split())} "
    most = max(orders)
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE + most - 1]
        cp = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        here = min(PIECE, len(text) - at)
        h = np.zeros(len(cp), np.uint64)
        out = []
        for n in range(1, most + 1):
            if len(cp) < n:
                break
            h = h[: len(cp) - n + 1] * _STEP + cp[n - 1 :]
            if n in orders:
                x = h[:here]
                x = (x ^ (x >> np.uint64(29))) * _ODD
                out.append((x >> np.uint64(64 - bits)).astype(np.int32))
        yield np.concatenate(out) if out else np.zeros(0, np.int32)


def distinct_buckets(text: str | None, orders: tuple[int, ...], bits: int, keep: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text, sorted; keep: a mask of the buckets that matter."""
    found = [x if keep is None else x[keep[x]] for x in hashed(text, orders, bits)]
    return np.unique(np.concatenate(found))


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, per_class: int, folds: int, held: int, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, y of at most per_class labelled rows of each class outside the held-out fold, chosen by a hash of the id.

    The label table grows with the corpus; the sample has at most 2 * per_class rows, so it may be broadcast.
    """
    rows = table(spark, sf_dir, "labels").select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [rows.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    return picked[0].union(picked[1]).groupBy("doc_id").agg(F.max("y").alias("y"))


def class_shares(spark: SparkSession, sf_dir: str, label: str, folds: int, held: int) -> float:
    """The share of class 1 among all labelled rows outside the held-out fold, with half a row added to each class."""
    rows = table(spark, sf_dir, "labels").filter(F.col(label).isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()
    return (ones + 0.5) / (n + 1)

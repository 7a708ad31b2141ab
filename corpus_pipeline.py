"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Only the columns of documents are looked at and handed on, whatever others there are; empty tables give empty results at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import jaccard, mixing, pieces, pii, quality
from sigloom.llm.common import let, shared_dir, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shares of all tokens that the mixture is to have.
TARGET = {"clean": 0.97, "toxic": 0.02, "low": 0.01}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from these documents and the labels, doesn't reject.

    Null and empty texts are scored like others; repeated rows get one score; without documents or positive labels nothing is rejected.
    """
    score = quality.score_of(spark, quality.model_from(docs, table(spark, sf_dir, "labels")))
    return docs.select(*COLUMNS).withColumn("_score", score("text")).filter(F.col("_score") >= quality.THRESHOLD).drop("_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of near copies.

    Null, empty and blank texts are copies of each other; of rows with one id and text one stays; a null id comes first; ties of an id go by
    the text's hash; very long texts are compared whole.
    """
    return jaccard.deduplicated(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text.

    A null text stays null; an empty one stays empty; overlapping finds are replaced as one; no row goes.
    """
    model = pii.learned(written(pii.found_in(docs, ["doc_id"]), "candidates"))
    out = docs.select(*COLUMNS).withColumn("text", F.when(F.col("text").isNotNull(), pii.redaction(F.col("text"), model)))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture nearer the target: a document stays with the chance of its fitted rate, by a hash of its id.

    Rates are at most 1, as no document is repeated, and the total that is wanted is the one at which the clean tokens all have their
    place: so the fit gets the shares by thinning out what isn't clean, as far as soft memberships allow. Texts without words stay;
    rows with one id share their luck; a null id counts as one id.
    """
    docs = docs.select(*COLUMNS)
    membership = mixing.membership(docs, mixing.labels_of(spark, sf_dir))
    rows = written(docs.select(membership.alias("m")).select("m.tokens", "m.p"), "memberships")
    total = mixing.attained(rows, [0.0] * len(TARGET))["clean"] / (TARGET["clean"] / sum(TARGET.values()))
    multipliers = mixing.fitted(rows, TARGET, total, most=1.0, pull=1e-4)
    u = mixing.uniform(F.col("doc_id"))
    # the membership stands in the condition once, bound to m
    return docs.filter(let(membership, lambda m: (m["tokens"] == 0) | (u < mixing.rate(m["p"], multipliers, 1.0))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether they decode to its text. The executors still hold memory of the stages before, so
    workers remember fewer words and take fewer characters at once than they could. Null and empty texts have no pieces; no row goes."""
    return pieces.encoded(docs, pieces.Pieces.load(pieces.model_path()), remembered=50_000, at_once=1_000_000)


STAGES = [
    ("quality", keep_quality),
    ("near copies", drop_near_copies),
    ("personal data", redact_personal_data),
    ("mixing", mix),
    ("encoding", encode),
]

#: SQL can express neither the classifiers nor the join; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs

"""Operator 4: document fingerprints by I-Match with randomised lexicons.

Terms are the distinct lower-cased runs of letters and digits. The lexicon holds the terms whose inverse document frequency,
ln(documents / documents with the term), lies in a chosen band; its upper bound also bounds the lexicon's size, since a text
with m distinct terms adds 1 to m frequencies: terms with a frequency of f documents or more number at most documents * mean(m) / f.
A text's terms in the lexicon are sorted, and one hash is taken of those in each of several randomised subsets of the lexicon,
whose sizes fall from a half to a small part of it. The likeness of two fingerprints is the share of equal hashes.

Cases: null counts as empty; a text with fewer than FEW lexicon terms uses all its terms instead, one without terms its whole
text; equal texts have equal fingerprints; very long texts are read whole; repeated rows are told apart by nothing and get
equal results; ties of doc_id are ordered by the text's hash; an empty table gives an empty result; columns other than those named
are not looked at. Everything runs in the JVM.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sigloom.llm.common import let, table

#: The band of the inverse document frequency: terms in 0.4 % to 20 % of all documents.
IDF_BAND = (math.log(1 / 0.2), math.log(1 / 0.004))
FEW = 4
#: Of how many terms one stays in each randomised lexicon, and how many lexicons there are of each kind.
ONE_OF, LEXICONS = (2, 8, 32, 64, 128), 5
#: Slots of the lexicon's table.
SLOTS = 1 << 14


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """h, the hashes of the lexicon's terms: one pass over all documents, counts added up before the shuffle."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.col(text))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return df.filter((F.col("df") >= n * math.exp(-band[1])) & (F.col("df") <= n * math.exp(-band[0]))).select("h")


def lexicon_table(lex: DataFrame) -> Column:
    """The lexicon as one constant: SLOTS arrays of hashes, each hash in the slot of its remainder.

    A constant, since a column from a join would be copied into every row. Its size is bounded by the band (see above).
    """
    slots: list[list[int]] = [[] for _ in range(SLOTS)]
    for (h,) in lex.orderBy("h").toLocalIterator():
        slots[h % SLOTS].append(h)
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<array<bigint>>")


def fingerprint(text: Column, lex: Column) -> Column:
    """The text's hashes, joined by '-': sixteen digits each, none for a lexicon without terms of the text."""
    known = lambda h: F.array_contains(F.get(lex, F.pmod(h, F.lit(SLOTS)).cast("int")), h)
    whole = F.array(F.xxhash64(F.coalesce(text, F.lit(""))))
    used = let(terms(text), lambda own: let(F.filter(own, known), lambda inside: F.when(F.size(inside) >= FEW, inside).when(F.size(own) > 0, own).otherwise(whole)))
    return let(F.array_sort(used), hashes)


def in_lexicon(seed: int, one_of: int):
    return lambda h: F.pmod(F.shiftright(h, 9 * seed + 3), F.lit(one_of)) == 0


def hashes(used: Column) -> Column:
    """One hash of the sorted terms in each randomised lexicon; the lexicons of a seed are told apart by their terms' remainders."""
    out = []
    for seed in range(LEXICONS):
        for one_of in ONE_OF:
            sub = F.filter(used, in_lexicon(seed, one_of))
            out.append(let(sub, lambda x: F.when(F.size(x) > 0, F.substring(F.md5(F.array_join(x.cast("array<string>"), ",").cast("binary")), 1, 16)).otherwise(F.lit(""))))
    return F.array_join(F.array(*out), "-")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the lexicons in which either text has terms; 1 for equal fingerprints."""
    each = F.zip_with(F.split(a, "-"), F.split(b, "-"), lambda x, y: F.when((x == "") & (y == ""), F.lit(None)).otherwise((x == y).cast("int")))
    share = let(F.array_compact(each), lambda v: F.aggregate(v, F.lit(0), lambda t, q: t + q) / F.greatest(F.size(v), F.lit(1)))
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def before_next(rows: DataFrame, parts: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, WindowSpec]:
    """rows cut into ranges by doc_id, and the window in whose order a row's next row follows it; after the last row comes the first.

    Columns part, tie (a hash of the text, for equal ids) and guard are added. Ranges end at approximate quantiles of the ids, so
    each has about as many rows. To each range the first row of the next one that isn't empty is added, as its last row: rows with
    guard 1, to be dropped once the next row has been looked at.
    """
    cuts = rows.agg(F.percentile_approx(doc_id, [k / parts for k in range(1, parts)] or [0.5], 10000).alias("c")).first()["c"] or []
    cut = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    part = F.size(F.filter(cut, lambda c: c < F.col(doc_id)))
    rows = rows.withColumn("part", F.coalesce(part, F.lit(0))).withColumn("tie", F.xxhash64(text)).withColumn("guard", F.lit(0))
    first = rows.groupBy("part").agg(F.min_by(F.struct(*rows.columns), F.struct(doc_id, "tie")).alias("r"))
    order = Window.orderBy("part")  # one row per range
    before = F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guards = first.withColumn("before", before).select("r.*", "before").withColumn("part", F.col("before")).withColumn("guard", F.lit(1)).drop("before")
    return rows.unionByName(guards), Window.partitionBy("part").orderBy("guard", F.col(doc_id).asc_nulls_first(), "tie")


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likenesses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lex = lexicon_table(lexicon(docs))
    rows, order = before_next(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text"), lex))
    rows = rows.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(order)).filter("guard = 0")
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), lex).alias("edited_fingerprint"), "next_fingerprint")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )

"""Operator 3: mixing to target weights by soft membership.

A naive Bayes classifier, learned from a labelled table, gives each document posteriors over domains instead of one domain; a factor and
a shift of its evidence, fitted on texts that the counts of their half haven't seen, calibrate these. Rates
r >= 0, one per document, are then fitted so that the expected tokens of each domain, sum over documents of rate * tokens *
posterior, meet targets: least squares by lazily projected gradient steps. A document's steps, each its posteriors times what the totals
are off, scaled by the second moments of the documents at no bound, are added up, and the sum is projected to rates from 0 up. So
the steps' sum is one multiplier a domain, a step needs one aggregation of a few sums, and rates are never stored.

Cases: null and empty texts have no tokens and the prior as posterior; very long texts count whole; repeated rows get equal rates;
a target that no rates can meet is approached in the least-squares sense; without labelled rows all domains are equally
likely; of a repeated labelled id one label counts; an empty table gives an empty result; columns other than those named are not looked at. Everything runs in the JVM; the driver
holds as many numbers as the classifier has buckets and domains.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import deleted, let, table, written

BUCKETS = 1 << 15
#: The most labelled rows of a domain that the classifier learns from.
PER_DOMAIN = 3000
#: Every domain is given so many texts that are like the average of all.
PSEUDO = 10
#: Only buckets whose share of a domain's texts is so many standard errors from that of all labelled texts say anything.
LEAST_Z = 3.0
#: ... and that so many labelled texts have.
LEAST = 2
#: How much the fit is drawn towards rates of 1, which picks one of many solutions; totals miss targets by about this times the largest rate.
PULL = 1e-6
#: Domains of the label table, and what share of all tokens each should have.
DOMAINS = ("clean", "toxic", "low")
TARGET = {"clean": 0.9, "toxic": 0.02, "low": 0.08}


def label_domain(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, "low").when(toxic == 1, "toxic").when(quality == 1, "clean")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def buckets(own: Column) -> Column:
    return F.array_distinct(F.transform(own, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def labelled(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN) -> DataFrame:
    """text and domain of at most per_domain labelled rows of each domain, chosen by a hash of the id. labels: doc_id, domain."""
    labels = labels.filter("doc_id is not null and domain is not null")
    picked = None
    for d in DOMAINS:
        some = labels.filter(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        picked = some if picked is None else picked.union(some)
    return docs.select("doc_id", "text").join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id").select("text", "domain")


def class_counts(sample: DataFrame) -> tuple[list[dict], list[dict]]:
    """Of either half of the sample (fold), per domain: how many texts there are, and how many have each bucket that LEAST have."""
    one = F.explode(F.array_append(buckets(words(F.col("text"))), F.lit(-1))).alias("b")
    cells = [(fold, d) for fold in range(2) for d in DOMAINS]
    sums = [F.count_if((F.col("fold") == fold) & (F.col("domain") == d)).alias(f"{d}{fold}") for fold, d in cells]
    counts = sample.select("fold", "domain", one).groupBy("b").agg(*sums).filter((F.col("b") < 0) | (sum(F.col(f"{d}{fold}") for fold, d in cells) >= LEAST))
    n = [{d: 0 for d in DOMAINS} for _ in range(2)]
    have = [{d: [0] * BUCKETS for d in DOMAINS} for _ in range(2)]
    for b, *found in counts.collect():
        for (fold, d), k in zip(cells, found):
            if b < 0:
                n[fold][d] = k
            else:
                have[fold][d][b] = k
    return n, have


def log_ratios(n: dict, have: dict) -> list[list[float]]:
    """Per domain, each bucket's log share of texts that have it; 0 for buckets whose share in no domain is clearly another one."""
    all_ = sum(n.values())
    out = [[0.0] * BUCKETS for _ in DOMAINS]
    for b in range(BUCKETS):
        k = sum(have[d][b] for d in DOMAINS)
        q = (k + 0.5) / (all_ + 1)
        apart = [abs(have[d][b] - n[d] * q) / math.sqrt(n[d] * q * (1 - q)) for d in DOMAINS if n[d]]
        if k and max(apart, default=0) >= LEAST_Z:
            for row, d in zip(out, DOMAINS):
                row[b] = round(math.log((have[d][b] + PSEUDO * q) / (n[d] + PSEUDO)), 4)
    return out


def evidence(own: Column, ratios: list[list[float]]) -> Column:
    """For each domain but the first, what a text's words say for it against the first."""
    first = ratios[0]
    tables = [F.from_json(F.lit(json.dumps([round(a - b, 4) for a, b in zip(r, first)])), "array<double>") for r in ratios[1:]]

    def sums(b: Column) -> Column:
        return F.array(*[F.aggregate(b, F.lit(0.0), (lambda t: lambda acc, k: acc + F.get(t, k))(t)) for t in tables])

    return let(buckets(own), sums)


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """a x = b by Gaussian elimination; a tiny ridge keeps empty domains solvable."""
    n = len(b)
    ridge = 1e-9 * (sum(a[i][i] for i in range(n)) or 1)
    m = [[*row, v] for row, v in zip(a, b)]
    for i in range(n):
        m[i][i] += ridge
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[k] = m[k], m[i]
        for r in range(n):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i])]
    return [m[i][n] / m[i][i] for i in range(n)]


def posteriors(own: Column, ratios: list[list[float]], curve: list[tuple[float, float]]) -> Column:
    """Domain probabilities of a text with these words; curve: for each domain but the first, the evidence's factor and shift."""

    def softmax(z: Column) -> Column:
        e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
        return let(e, lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, q: a + q)))

    scores = lambda s: F.array(F.lit(0.0), *[s[k] * t + b for k, (t, b) in enumerate(curve)])
    return let(let(evidence(own, ratios), scores), softmax)


def calibrated(rows: list[tuple[str, Sequence[float]]], priors: list[float], rounds: int = 25) -> list[tuple[float, float]]:
    """The factor and shift of the evidence for each domain but the first that make its probabilities those of unseen texts: Newton steps on
    the log loss. rows: domain and evidence of texts, from the other half's counts. Domains count by their priors, however
    many rows they have here. Factors are drawn a little towards 0.3, shifts towards the prior."""
    n = len(DOMAINS) - 1
    start = [x for p in priors[1:] for x in (0.3, p - priors[0])]
    theta, size = list(start), {d: sum(1 for x, _ in rows if x == d) for d in DOMAINS}
    weight = {d: math.exp(p) / max(size[d], 1) for d, p in zip(DOMAINS, priors)}
    for _ in range(rounds if rows else 0):
        g = [1e-3 * (x - y) for x, y in zip(theta, start)]
        h = [[1e-3 * (i == j) for j in range(2 * n)] for i in range(2 * n)]
        for d, s in rows:
            z = [0.0, *[theta[2 * k] * s[k] + theta[2 * k + 1] for k in range(n)]]
            top = max(z)
            e = [math.exp(v - top) for v in z]
            p = [v / sum(e) for v in e][1:]
            w, x = weight[d], [[s[k], 1.0] for k in range(n)]
            for k in range(n):
                off = w * (p[k] - (DOMAINS[k + 1] == d))
                for i in range(2):
                    g[2 * k + i] += off * x[k][i]
                    for m in range(n):
                        c = w * p[k] * ((k == m) - p[m]) * x[k][i]
                        h[2 * k + i][2 * m] += c * x[m][0]
                        h[2 * k + i][2 * m + 1] += c * x[m][1]
        move = _solve(h, g)
        short = min(1.0, 1.0 / max(max(map(abs, move)), 1e-12))
        theta = [x - short * v for x, v in zip(theta, move)]
        if max(map(abs, move)) < 1e-6:
            break
    return [(theta[2 * k], theta[2 * k + 1]) for k in range(n)]


def membership(docs: DataFrame, labels: DataFrame) -> Column:
    """struct (tokens, p): a row's number of tokens and its posteriors in the order of DOMAINS. labels: doc_id, domain; those of
    other documents than these don't count. Learns now, applies where the column is used."""
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    shares = {r["domain"]: r["n"] for r in labels.filter("domain is not null").groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    priors = [math.log((shares.get(d, 0) + 0.5) / (total + 0.5 * len(DOMAINS))) for d in DOMAINS]
    sample = written(labelled(docs, labels).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "labelled")
    n, have = class_counts(sample)
    unseen = [log_ratios(n[1 - k], have[1 - k]) for k in range(2)]
    own = words(F.col("text"))
    rows = sample.select("domain", F.when(F.col("fold") == 0, evidence(own, unseen[0])).otherwise(evidence(own, unseen[1])).alias("s")).collect()
    curve = calibrated([(d, s) for d, s in rows], priors)
    deleted(sample)
    ratios = log_ratios({d: n[0][d] + n[1][d] for d in DOMAINS}, {d: [x + y for x, y in zip(have[0][d], have[1][d])] for d in DOMAINS})
    return let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("tokens"), posteriors(w, ratios, curve).alias("p")))


def memberships(docs: DataFrame, labels: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in keep, tokens and p of every row. Before it is filtered or used more than once it should be written: Spark would
    put the membership's whole expression in place of each use of p."""
    return docs.select(*keep, membership(docs, labels).alias("_m")).select(*keep, "_m.tokens", "_m.p")


def rate(p: Column, multipliers: Sequence[float], most: float | None = None) -> Column:
    """A document's rate: 1 less what the multipliers take off per unit of each posterior, projected to [0, most]."""
    r = F.greatest(F.lit(0.0), F.lit(1.0) - sum((p[k] * float(v) for k, v in enumerate(multipliers)), F.lit(0.0)))
    return r if most is None else F.least(F.lit(float(most)), r)


def _sums(rows: DataFrame, multipliers: Sequence[float], most: float | None) -> tuple[list[float], list[list[float]], float]:
    """At these multipliers' rates: expected tokens of each domain, second moments of the rows at no bound, and the rows' part of the
    function that the multipliers minimise. One aggregation of a few sums."""
    n = len(DOMAINS)
    p, t = [F.col("p")[d] for d in range(n)], F.col("tokens").cast("double")
    z = F.lit(1.0) - sum((p[k] * float(v) for k, v in enumerate(multipliers)), F.lit(0.0))
    over = F.lit(False) if most is None or not any(multipliers) else F.col("z") >= float(most or 0)
    at = F.when(F.col("z") <= 0, 0.0).when(over, F.col("z") * float(most or 0) - float(most or 0) ** 2 / 2).otherwise(F.col("z") * F.col("z") / 2)
    free = F.when((F.col("z") <= 0) | over, 0.0).otherwise(t)
    r = F.greatest(F.lit(0.0), F.col("z")) if most is None else F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("z")))
    zero = F.lit(0.0)
    got = rows.withColumn("z", z).agg(
        *[F.coalesce(F.sum(r * t * p[d]), zero).alias(f"s{d}") for d in range(n)],
        *[F.coalesce(F.sum(free * p[i] * p[j]), zero).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)],
        F.coalesce(F.sum(t * at), zero).alias("at"),
    ).first()
    return [got[f"s{d}"] for d in range(n)], [[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], got["at"]


def attained(rows: DataFrame, multipliers: Sequence[float], most: float | None = None) -> dict[str, float]:
    """Expected tokens of each domain at these multipliers' rates."""
    return dict(zip(DOMAINS, _sums(rows, multipliers, most)[0]))


def fitted(
    rows: DataFrame, target: dict[str, float], total: float | None = None, most: float | None = None, pull: float = PULL, passes: int = 60, close: float = 1e-6
) -> list[float]:
    """The multipliers, one a domain, of the rates that minimise the squared distance of expected token totals from their targets,
    as shares of all tokens, plus `pull` times the tokens' mean squared distance of the rates from 1 (which picks one of many solutions).

    rows: tokens and p; target: shares; total: how many tokens the mixture should have, as many as there are unless told otherwise; most:
    an upper bound of the rates, 1 or more. Ends when the gradient is under `close` as a share of all tokens, or after `passes` passes
    over the rows, which is far more than three multipliers need.
    """
    n = len(DOMAINS)
    x = [0.0] * n
    got, moments, at = _sums(rows, x, most)
    if not sum(got):
        return x
    wanted = [target[d] / sum(target.values()) * (total or sum(got)) for d in DOMAINS]
    size, seen = sum(wanted), 1

    def value(x: list[float], at: float) -> float:
        return at + sum(v * w for v, w in zip(x, wanted)) + pull * size / 2 * sum(v * v for v in x)

    while seen < passes:
        slope = [w - g + pull * size * v for w, g, v in zip(wanted, got, x)]
        if max(map(abs, slope)) <= close * size:
            break
        way = _solve([[m + pull * size * (i == j) for j, m in enumerate(row)] for i, row in enumerate(moments)], slope)
        fall, length, now = sum(a * b for a, b in zip(slope, way)), 1.0, value(x, at)
        while seen < passes:
            new = [v - length * w for v, w in zip(x, way)]
            got, moments, at = _sums(rows, new, most)
            seen += 1
            if value(new, at) <= now - 1e-4 * length * fall:
                break
            length /= 4
        x = new
    return x


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that the id decides."""
    return F.pmod(F.xxhash64(doc_id, F.lit("mixing")), F.lit(1 << 40)) / float(1 << 40)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's posteriors, rate, and whole number of copies (the rate, rounded up or down by a hash of the id)."""
    rows = written(memberships(table(spark, sf_dir, "documents"), labels_of(spark, sf_dir)), "memberships")
    out = rows.withColumn("rate", rate(F.col("p"), fitted(rows, TARGET)))
    return out.select("doc_id", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", F.floor(F.col("rate") + uniform(F.col("doc_id"))).cast("long").alias("copies"))

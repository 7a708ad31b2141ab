"""Operator 2: n-gram Jaccard join by chosen paths.

Texts are sets of word 5-grams; two texts are linked if their sets' Jaccard similarity is 0.8 or more.

1. Every set draws paths: in each run it picks the tokens whose hash is under a bound of a few over its size, below each of
   these picks again with a hash that depends on the path, and so on. Similar sets share picks, so with good chance a path.
   Sets with equal content are one set from here on, with a weight.
2. A path's bucket that is small is compared by brute force, on sketches of 64 bytes, with a bound so loose that linked pairs
   pass; a larger one is split by the paths' next level, and one still larger at the last level is cut into blocks whose
   pairs are all compared. The number of runs follows from the target recall.
   Runs come in a few parts, each after the components of those before it.
3. Sets that passed are put together into components, and within a component all pairs' exact similarities are computed, in blocks
   of bounded size. Links are counted there and nowhere written as pairs: the result is linear in rows. What is shipped isn't:
   a component of N different sets is cut into N / 2048 blocks or more (long texts: fewer sets a block), each shipped once per block.

Result: one row per document with its class (the smallest doc_id of those it hangs together with by links) and its number of links.

Cases: words are the lower-cased text's, split at white space; a text of one to four words has one token, all its words; null, empty
and blank texts have the empty set and are copies of each other; repeated rows count as copies; rows with a null id take part like
others; very long texts are used whole; an empty table gives an empty result; columns other than those named are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import deleted, released, table, thrifty, written

WORDS, SIMILARITY = 5, 0.8
#: Picks expected per set and level; levels; the recall that the number of runs is chosen for.
PICKS, LEVELS, RECALL = 1.5, 3, 0.9995
#: The most sets of a bucket that is compared at once; sets that are compared at once in the exact comparison.
BUCKET, BLOCK = 4096, 256
#: The most sets and about the most tokens of a block that two blocks of a component meet in one task: a set's tokens are shipped once per
#: block, so blocks are as large as a task's memory and its share of the work allow.
BLOCK_SETS, BLOCK_TOKENS = 2048, 1 << 18
BINS = 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64), dtype=np.uint64)
_TURNS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(1, 1 + WORDS)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def tokens(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word 5-grams."""
    text = " ".join((text or "").lower().split())
    if not text:
        return np.zeros(0, np.uint64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.append(0, np.flatnonzero(code == 32) + 1)
    within = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
    valued = (code.astype(np.uint64) + np.uint64(1)) * _POWERS[within % len(_POWERS)] ^ (within // len(_POWERS)).astype(np.uint64)
    valued[starts[1:] - 1] = 0
    words = mixed(np.add.reduceat(valued, starts))
    n = len(words)
    if n < WORDS:
        return mixed(np.array([np.bitwise_xor.reduce(words * _TURNS[:n]) + np.uint64(n)], np.uint64))
    total = np.zeros(n - WORDS + 1, np.uint64)
    for k in range(WORDS):
        total += words[k : n - WORDS + 1 + k] * _TURNS[k]
    return np.unique(mixed(total))


def runs_for(recall: float, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at the bound shares a path of the last level with the wanted probability."""
    found = 1.0
    for _ in range(LEVELS):
        found = 1 - math.exp(-PICKS * similarity * found)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def paths(own: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of LEVELS path numbers, 0 where a path has ended, sorted by the first, and the run of each."""
    bound = np.uint64(min(2**64 - 1, int(PICKS / len(own) * 2**64)))
    out = []
    heads, lines = mixed(np.arange(1, runs + 1, dtype=np.uint64)), np.arange(runs, dtype=np.uint64)[:, None]
    for level in range(LEVELS):
        drawn = mixed(own[None, :] ^ heads[:, None])
        at, which = np.nonzero(drawn <= bound)
        ended = np.setdiff1d(np.arange(len(heads)), at)
        if level and len(ended):
            out.append(np.hstack([lines[ended], np.zeros((len(ended), LEVELS - level), np.uint64)]))
        heads = mixed(drawn[at, which] + _B)
        lines = np.hstack([lines[at], heads[:, None]])
    found = np.vstack([*out, lines])
    found = found[np.argsort(found[:, 1], kind="stable")]
    return found[:, 1:], found[:, 0]


def sketch(own: np.ndarray) -> bytes:
    """For each of BINS ranges of hashes a byte of the smallest one there, 0 where there is none."""
    out = np.zeros(BINS, np.uint8)
    if len(own):
        bins = (own >> np.uint64(58)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        out[bins[first]] = (own[first] * _A >> np.uint64(56)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def drawn(docs: DataFrame, doc_id: str, text: str, runs: int) -> DataFrame:
    """Each row's set: its key, size, sketch and paths. Sets under four tokens are linked to equal ones only, so have no paths."""
    kind = dict(docs.dtypes)[doc_id]

    @thrifty
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, sketches, heads, of_run, rest, rest_ends, ends = [], [], [], [], [], [], [0], [0]
            for t in b.column(2).to_pylist():
                own = tokens(t)
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sizes.append(len(own))
                sketches.append(sketch(own) if len(own) > 3 else None)
                if len(own) > 3:
                    found, run = paths(own, runs)
                    at = np.flatnonzero(np.append(True, found[1:, 0] != found[:-1, 0])) if len(found) else np.zeros(0, int)
                    heads.append(found[at, 0])
                    of_run.append(run[at])
                    deeper = found[:, 1] != 0
                    rest.append(found[deeper, 1:].reshape(-1))
                    if len(at):
                        rest_ends += (rest_ends[-1] + (LEVELS - 1) * np.cumsum(np.add.reduceat(deeper.astype(np.int64), at))).tolist()
                    ends.append(ends[-1] + len(at))
                else:
                    ends.append(ends[-1])
            flat = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else [], pa.int64())
            line = pa.StructArray.from_arrays([flat(of_run).cast(pa.int32()), flat(heads), pa.ListArray.from_arrays(pa.array(rest_ends, pa.int32()), flat(rest))], ["run", "head", "rest"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), line)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), lists], ["doc_id", "text_key", "sid", "n", "sketch", "paths"]
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(draw, f"doc_id {kind}, text_key long, sid binary, n int, sketch binary, paths array<struct<run:int,head:long,rest:array<long>>>")


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls work with whole groups of rows that come sorted by keys, and where each group begins (and the last one ends)."""
    kept: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            new |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False), bool)
        return np.flatnonzero(np.append(True, new)) if t.num_rows else np.zeros(0, int)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        kept = pa.concat_tables([kept, t]) if kept is not None else t
        at = starts(kept)
        if len(at) > 1:
            yield work(kept.slice(0, at[-1]).combine_chunks(), at)
            kept = kept.slice(at[-1])
    if kept is not None:
        yield work(kept.combine_chunks(), np.append(starts(kept), kept.num_rows))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it hangs together with by the edges a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _chunk(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks else pa.array([], c.type)


def near_in_buckets(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
    """Pairs of a bucket whose sketches may be those of linked sets, unless earlier runs have put them together (equal comp).

    What hangs together by these pairs in the rows at hand is returned as one edge from each comp to the smallest: so there are
    no more edges than comps, however many pairs there are. In two blocks that meet each other, rows of side 0 meet those of 1.
    """
    n = t.num_rows
    group = np.repeat(np.arange(len(at) - (at[-1] == n)), np.diff(np.append(at[at < n], n))) if n else np.zeros(0, int)
    comp = _chunk(t, "comp")
    labels, code = np.unique(np.frombuffer(b"".join(comp.to_pylist()), "V16"), return_inverse=True)
    sk = np.frombuffer(b"".join(_chunk(t, "sketch").to_pylist()), np.uint8).reshape(n, BINS)
    size, side = t.column("n").to_numpy(), t.column("side").to_numpy()
    left, right = [], []
    for k in range(1, n):
        i = np.flatnonzero(group[k:] == group[:-k])
        if not len(i):
            break
        i = i[(code[i] != code[i + k]) & ((side[i] == 2) | (side[i] != side[i + k]))]
        i = i[np.minimum(size[i], size[i + k]) >= SIMILARITY * np.maximum(size[i], size[i + k]) - 1e-9]
        for part in np.array_split(i, max(1, len(i) // 20_000)):
            x, y = sk[part], sk[part + k]
            some = np.maximum(1, ((x | y) > 0).sum(1))
            same = ((x == y) & (x > 0)).sum(1)
            ok = same / some >= SIMILARITY - 4.5 * np.sqrt(SIMILARITY * (1 - SIMILARITY) / some)
            left.append(code[part[ok]])
            right.append(code[part[ok] + k])
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    root = roots(len(labels), a, b)
    own = np.flatnonzero(root != np.arange(len(labels)))
    names = lambda k: pa.array([x.tobytes() for x in labels[k]], pa.binary())
    return pa.RecordBatch.from_arrays([names(root[own]), names(own)], ["a", "b"])


def intersections(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """How many tokens each set of x shares with each of y (of x itself if None), as a product of 0/1 matrices in pieces."""
    both = x if y is None else x + y
    values, number = np.unique(np.concatenate(both), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    out = np.zeros((len(x), len(x) if y is None else len(y)))
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    width = 16384
    edges = np.searchsorted(number, np.arange(0, len(values) + width, width))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        m = np.zeros((len(both), min(width, len(values) - k * width)), np.float32)
        m[owner[lo:hi], number[lo:hi] - k * width] = 1
        out += m[: len(x)] @ m[len(x) if y is not None else 0 :].T
    return out


def linked_in_blocks(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
    """The exact links of each group's sets: each set's number of links by weight, and the first set it hangs together with."""
    sid, weight, side = _chunk(t, "sid"), t.column("weight").to_numpy(), t.column("side").to_numpy()
    lists = _chunk(t, "tokens")
    flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
    n = t.num_rows
    links, root = np.zeros(n, np.int64), np.arange(n)
    names = _chunk(t, "sid").to_pylist()
    fresh = np.array([k == 0 or names[k] != names[k - 1] for k in range(n)], bool)  # a repeated row brings its set again
    at = np.append(at[at < n], n)
    for lo, hi in zip(at[:-1], at[1:]):
        all_ = lo + np.flatnonzero(fresh[lo:hi] | (np.arange(lo, hi) == lo))
        one = all_ if side[lo] == 2 else all_[side[all_] == 0]
        two = None if side[lo] == 2 else all_[side[all_] == 1]
        if not len(one) or two is not None and not len(two):
            continue
        sets = lambda rows: [flat[ends[r] : ends[r + 1]] for r in rows]
        sizes = np.diff(ends)
        left, right = [], []
        pieces = [one[k : k + BLOCK] for k in range(0, len(one), BLOCK)]
        others = pieces if two is None else [two[k : k + BLOCK] for k in range(0, len(two), BLOCK)]
        for i, x in enumerate(pieces):
            for j, y in enumerate(others):
                if two is None and j < i:
                    continue
                same = two is None and i == j
                if same and len(x) == 2:
                    p, q = sets(x)
                    shared = float(len(np.intersect1d(p, q, assume_unique=True)))
                    common = np.array([[len(p), shared], [shared, len(q)]])
                else:
                    common = intersections(sets(x), None if same else sets(y))
                ok = common >= SIMILARITY * (sizes[x][:, None] + sizes[y][None, :] - common) - 1e-9
                if same:
                    np.fill_diagonal(ok, False)
                links[x] += ok @ weight[y]
                if not same:
                    links[y] += ok.T @ weight[x]
                a, b = np.nonzero(ok)
                left.append(x[a] - lo)
                right.append(y[b] - lo)
        root[lo:hi] = roots(hi - lo, np.concatenate(left), np.concatenate(right)) + lo
    return pa.RecordBatch.from_arrays([sid, sid.take(pa.array(root)), pa.array(links)], ["sid", "root", "links"])


def halves(rows: DataFrame, key: list[str], size: str, most: int) -> DataFrame:
    """Rows of groups with more than `most` rows dealt to all pairs of blocks: columns i, j and side (2: a whole group or block,
    whose rows all meet; 0 and 1: two blocks that meet each other). A row is repeated as often as there are blocks."""
    n = F.ceil(F.col(size) / F.lit(most)).cast("int")
    rows = rows.withColumn("_n", n).withColumn("_b", F.when(F.col("_n") == 1, 0).otherwise(F.pmod(F.xxhash64("sid", F.lit("block")), F.col("_n")).cast("int")))
    pair = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(F.least(k, "_b").alias("i"), F.greatest(k, "_b").alias("j"), F.when(k == F.col("_b"), 2).when(F.col("_b") < k, 0).otherwise(1).alias("side")))
    return rows.withColumn("_p", F.explode(pair)).select(*rows.columns[:-2], "_p.*")


def listed(rows: DataFrame, most: int):
    """F.broadcast for a table of at most `most` rows, else nothing: then both sides of the join are shuffled."""
    return F.broadcast if rows.count() <= most else (lambda df: df)


def buckets(rows: DataFrame, runs: tuple[int, int]) -> DataFrame:
    """bucket, sid, size of the runs' buckets with more than one set: the small ones of each level, and what is left of the last.

    Only path numbers and keys are counted; the deeper paths of a set are looked at if its first level's bucket is large.
    """
    lines = rows.select("sid", F.explode("paths").alias("p")).filter(F.col("p.run").between(*runs))
    here, out = lines.select("sid", F.col("p.head").alias("bucket")).distinct(), None
    deeper = lines.select("sid", F.col("p.head").alias("bucket"), "p.rest")
    for level in range(LEVELS):
        count = here.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        last = level == LEVELS - 1
        mine = here.join(count if last else count.filter(F.col("size") <= BUCKET), "bucket")
        out = mine if out is None else out.unionByName(mine)
        if last:
            break
        large = written(count.filter(F.col("size") > BUCKET).select("bucket"), "large")
        if large.isEmpty():
            break
        width = LEVELS - 1 - level
        parts = F.expr(f"transform(sequence(1, size(rest) div {width}), k -> slice(rest, (k - 1) * {width} + 1, {width}))")
        deeper = deeper.join(listed(large, BROADCAST_BUCKETS)(large), "bucket", "left_semi").filter("size(rest) > 0")
        deeper = deeper.dropDuplicates(["bucket", "sid", "rest"])  # rows of equal sets; a set's different paths below a bucket all stay
        deeper = deeper.select("sid", F.explode(parts).alias("q")).select("sid", F.col("q")[0].alias("bucket"), F.slice("q", 2, max(1, width - 1)).alias("rest")).filter("bucket <> 0")
        deeper = written(deeper, "deeper")  # once, not again for each count and join below
        here = deeper.select("sid", "bucket").distinct()
    return out


#: Into how many parts the runs are divided; a set that one part has linked isn't linked to the same component again.
ROUNDS = (2,)
#: Up to so many large buckets their numbers (16 bytes a row) are broadcast to the paths; beyond, both are shuffled.
BROADCAST_BUCKETS = 1_000_000
#: Up to so many sets with candidates their table (under 100 bytes a row) is broadcast to the texts; beyond, both are shuffled.
BROADCAST_SETS = 400_000


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component of edges (a, b).

    Each round takes the smallest root among a node and its neighbours and then that root's root; both are a join and an
    aggregation that adds up before the shuffle, so a node with many neighbours is no single task. Rounds are written out.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots_ = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        seen = both.join(roots_, both["b"] == roots_["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = roots_.join(seen, "node").select("node", F.least("root", "low").alias("mid"), F.col("root").alias("was"))
        up = roots_.select(F.col("node").alias("mid"), F.col("root").alias("up"))
        new = written(step.join(up, "mid").select("node", F.least("mid", "up").alias("root"), "was"), "roots")
        moved = not new.filter("root <> was").isEmpty()
        deleted(roots_)
        roots_ = new.select("node", "root")
        roots_.written_to = new.written_to
        if not moved:
            deleted(both)
            return roots_


def sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "sid")


def after_runs(rows: DataFrame, sets: DataFrame, near: DataFrame | None, runs: tuple[int, int]) -> DataFrame:
    """Components (node, root) after these runs, given those of earlier ones."""
    found = buckets(rows, runs).join(sets.select("sid", "n", "sketch"), "sid")
    if near is None:
        found = found.withColumn("comp", F.col("sid"))
    else:
        found = found.join(near.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
    found = halves(found, ["bucket"], "size", BUCKET).select("bucket", "i", "j", "side", "sid", "n", "sketch", "comp")
    edges = sorted_by(found, "bucket", "i", "j").mapInArrow(thrifty(lambda b: by_group(b, ["bucket", "i", "j"], near_in_buckets)), "a binary, b binary")
    return components(edges if near is None else edges.union(near.filter("node <> root").select("root", "node")))


def exact_links(docs: DataFrame, sets: DataFrame, near: DataFrame, doc_id: str, text: str) -> DataFrame:
    """sid, root, links: within each component, per block or pair of blocks."""
    mine = near.join(sets.select(F.col("sid").alias("node"), "weight", "carrier", "n"), "node")
    size = mine.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.col("n").cast("long")) / BLOCK_TOKENS)).alias("size"))
    mine = mine.join(size, "root")
    mine = mine.select(F.col("node").alias("sid"), F.col("root").alias("comp"), "size", "weight", F.col("carrier.doc_id").alias("_id"), F.col("carrier.text_key").alias("_key"))
    mine = listed(near, BROADCAST_SETS)(mine)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text_key"), F.col(text).alias("_text"))
    held = texts.join(mine, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))).select("comp", "sid", "size", "weight", "_text")

    @thrifty
    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.array([tokens(t).view(np.int64) for t in b.column(4).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], lists], ["comp", "sid", "size", "weight", "tokens"])

    held = held.mapInArrow(tokenised, "comp binary, sid binary, size long, weight long, tokens array<long>")
    blocks = halves(held, ["comp"], "size", 1).select("comp", "i", "j", "side", "sid", "weight", "tokens")
    return written(sorted_by(blocks, "comp", "i", "j").mapInArrow(thrifty(lambda b: by_group(b, ["comp", "i", "j"], linked_in_blocks)), "sid binary, root binary, links long"), "exact")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, rep_id (smallest id with an equal set), n_tokens, text_key (a hash of the text) and stays (true for
    the rows of the class's first document by id and key) of every row of docs."""
    spark, runs = docs.sparkSession, runs_for(recall)
    rows = written(drawn(docs, doc_id, text, runs), "drawn")
    first = F.min(F.struct("doc_id", "text_key"))
    sets = written(rows.groupBy("sid").agg(F.count("*").alias("weight"), first.alias("carrier"), F.min("doc_id").alias("rep_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")
    near, bounds = None, [0, *[k for k in ROUNDS if k < runs], runs]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        near = after_runs(rows, sets, near, (lo, hi - 1))
        released(spark)
    members = written(rows.select("doc_id", "text_key", "sid", F.col("n").alias("n_tokens")), "members")
    deleted(rows)
    exact = exact_links(docs, sets, near, doc_id, text)
    classes = components(exact.filter("root <> sid").select(F.col("root").alias("a"), F.col("sid").alias("b")))
    links = exact.groupBy("sid").agg(F.sum("links").alias("links"))
    placed = sets.select("sid", "weight", "rep_id", "carrier").join(links, "sid", "left").join(classes.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    placed = written(placed, "placed")
    deleted(sets, exact, near, classes)
    released(spark)
    ids = placed.groupBy("root").agg(F.min("rep_id").alias("class_id"), F.min("carrier").alias("first"))
    result = placed.join(ids, "root").select("sid", "class_id", "rep_id", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return members.join(result, "sid").select("doc_id", "class_id", "n_links", "rep_id", "n_tokens", "text_key", stays.alias("stays"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class of near copies, with all its columns. The rows that go, and repeated rows of those that stay,
    are the smaller part, so the texts are joined with these."""
    k, ident, key, stays, n = (free(docs, x) for x in ("_k", "_id", "_key", "_stays", "_n"))
    found = near_duplicates(docs, doc_id, text).groupBy(F.col("doc_id").alias(ident), F.col("text_key").alias(key)).agg(F.first("stays").alias(stays), F.count("*").alias(n))
    found = written(found.filter(~F.col(stays) | (F.col(n) > 1)), "goes")
    marked = docs.withColumn(k, F.xxhash64(text))
    here = F.col(doc_id).eqNullSafe(F.col(ident)) & (F.col(k) == F.col(key))
    small = F.broadcast if found.count() <= BROADCAST_SETS else (lambda df: df)
    once = marked.join(small(found.select(ident, key)), here, "left_anti").drop(k)
    repeated = found.filter(F.col(stays)).select(ident, key)
    if repeated.isEmpty():
        return once
    return once.unionByName(marked.join(small(repeated), here, "left_semi").dropDuplicates([doc_id, k]).drop(k))


def free(df: DataFrame, name: str) -> str:
    """The name, with so many underscores after it that no column has it."""
    while name in df.columns:
        name += "_"
    return name


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "stays")

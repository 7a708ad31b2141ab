"""The ten operators against brute force, round trips and held-out labels, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import common, imatch, jaccard, langid, media, mixing, ngrams, pieces, pii, quality, sharding, toxicity

LONG = " ".join(f"word{k % 977} number {k}" for k in range(12000))
TEXTS = [None, "", "   ", "one", "one two three four five six", "one two three four five six", LONG, "émile ☃ 日本語 text.", "a\nb\tc\x00d"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(k if k != 7 else None, t, None if k % 3 == 0 else "en", "s", 1, "x", "y", 2.5) for k, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string, root string, score double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def sentence(rng, n, words="abcdefghij"):
    return " ".join("".join(rng.choice(list(words), 4)) for _ in range(n))


# --- 1 -------------------------------------------------------------------------------------------


def sharded(docs, n=8, slots=256):
    rows = sharding.sized(docs, slots)
    totals = sharding.slot_totals(rows)
    m = sharding.rebalanced(sharding.first_map(docs.sparkSession, n, slots), totals, n)
    return sharding.placed(rows, m, totals), m, totals


def test_sharding(spark, odd, none):
    out, m, totals = sharded(odd)
    got = out.collect()
    assert len(got) == odd.count() and sharded(none)[0].count() == 0
    for r in got:
        t = TEXTS[r["doc_id"]] if r["doc_id"] is not None else TEXTS[7]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_even_and_rebalancing_moves_little(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    out, m, totals = sharded(docs)
    sizes = [r[0] for r in out.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8
    nine = sharding.rebalanced(m, totals, 9)
    sizes = [r[0] for r in sharding.placed(sharding.sized(docs, 256), nine, totals).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 9 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 9
    moved = m.alias("a").join(nine.alias("b"), "virtual_slot").filter("a.shard <> b.shard").count()
    assert moved < 256 * 0.2


def test_map_versions(spark, tmp_path):
    path = str(tmp_path / "map")
    first = sharding.first_map(spark, 4, 64)
    sharding.save_map(first, path)
    sharding.save_map(first.withColumn("version", F.col("version") + 1), path)
    assert {r["version"] for r in sharding.load_map(spark, path).collect()} == {1}
    assert sharding.load_map(spark, path, 0).count() == 64


def test_sharding_query(spark, odd, none, tmp_path):
    """The registered query: sizes and checksums by brute force, gapless slots, shards of near equal bytes, one row per row."""
    rng = np.random.default_rng(15)
    more = spark.createDataFrame([(100 + k, "ü" * int(rng.integers(0, 300)) + "x") for k in range(3000)], "doc_id long, text string")
    odd.select("doc_id", "text").unionByName(more).write.parquet(str(tmp_path / "a/documents.parquet"))
    none.write.parquet(str(tmp_path / "b/documents.parquet"))
    assert sharding.op1_sharding(spark, str(tmp_path / "b")).count() == 0
    texts = {r["doc_id"]: r["text"] for r in more.collect()} | dict(enumerate(TEXTS)) | {None: TEXTS[7]}
    got = sharding.op1_sharding(spark, str(tmp_path / "a")).collect()
    assert len(got) == 3000 + odd.count()
    slots, bytes_ = {}, {}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
        bytes_[r["shard"]] = bytes_.get(r["shard"], 0) + r["size"]
    assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(bytes_.values()) - min(bytes_.values()) <= len(LONG) + 1


# --- 2 -------------------------------------------------------------------------------------------


def brute(texts):
    """class (smallest index) and links by comparing all pairs of word 5-gram sets."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not either or both >= 0.8 * either - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(texts))], links


def near_texts(seed=0, groups=12):
    rng = np.random.default_rng(seed)
    texts = []
    for g in range(groups):
        base = sentence(rng, int(rng.integers(5, 120))).split()
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(len(own)))] = sentence(rng, 1)
            texts.append(" ".join(own))
    return [*texts, "", " ", None, "a b", "A  b", "a b c", *texts[:5]]


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_equals_brute_force(spark, seed):
    texts = near_texts(seed)
    out = {r["doc_id"]: r for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    classes, links = brute(texts)
    assert [out[k]["class_id"] for k in range(len(texts))] == classes
    assert [out[k]["n_links"] for k in range(len(texts))] == links


def test_jaccard_blocks_and_levels(spark, monkeypatch):
    """Small limits, so that buckets are split to the last level and groups are cut into blocks."""
    monkeypatch.setattr(jaccard, "BUCKET", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 12)
    rng = np.random.default_rng(3)
    base = sentence(rng, 60).split()
    texts = []
    for k in range(40):
        own = list(base)
        own[int(rng.integers(60))] = f"new{k}"
        texts.append(" ".join(own))
    out = {r["doc_id"]: r for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    classes, links = brute(texts)
    assert [out[k]["class_id"] for k in range(40)] == classes and [out[k]["n_links"] for k in range(40)] == links


def test_jaccard_keeps_every_path(spark, monkeypatch):
    """A large second-level bucket is split by all third-level picks of its sets; a row of an equal set adds nothing."""
    monkeypatch.setattr(jaccard, "BUCKET", 2)
    rest = [10, 100, 10, 101, 10, 102]
    rows = [(bytes([k]), [(0, 1, rest)]) for k in (0, 1, 2, 2)]
    out = jaccard.buckets(spark.createDataFrame(rows, "sid binary, paths array<struct<run:int,head:long,rest:array<long>>>"), (0, 0)).collect()
    assert sorted((r["bucket"], bytes(r["sid"]), r["size"]) for r in out) == [(b, bytes([k]), 3) for b in (100, 101, 102) for k in range(3)]


def test_jaccard_odd_rows(spark, odd, none):
    out = jaccard.near_duplicates(odd)
    assert out.count() == odd.count()
    links = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out.collect()}
    assert links[4] == (4, 3) and links[5] == (4, 3) and links[0] == (0, 2) and links[6] == (6, 0) and links[None][1] == 0
    assert jaccard.near_duplicates(none).count() == 0
    named = jaccard.deduplicated(odd.withColumn("_k", F.lit("a")).withColumn("_id", F.lit(1)).withColumn("_n", F.lit(2)))
    assert {tuple(r)[-3:] for r in named.collect()} == {("a", 1, 2)} and named.count() == 6
    kept = jaccard.deduplicated(odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [0, 3, 4, 6, None, 8])) and kept.columns == odd.columns


# --- 3 -------------------------------------------------------------------------------------------


def mix_fixture(spark):
    rng = np.random.default_rng(1)
    kinds = {"clean": ["sun", "tree", "river"], "toxic": ["idiot", "scum", "sun"], "low": ["$$$", "|||", "tree"]}
    rows = [(k, " ".join(rng.choice(kinds[d], 30)), d) for k in range(300) for d in [("clean", "clean", "toxic", "low")[k % 4]]]
    return spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(k, d) for k, _, d in rows], "doc_id long, domain string")


def test_mixing_meets_targets(spark):
    docs, labels = mix_fixture(spark)
    rows = mixing.memberships(docs, labels).cache()
    # totals that some rates can meet: none for every fifth document, two for the others of the label "low"
    wish = {r["doc_id"]: 0.0 if r["doc_id"] % 5 == 0 else 2.0 if r["doc_id"] % 4 == 3 else 1.0 for r in rows.collect()}
    totals = [sum(wish[r["doc_id"]] * r["tokens"] * r["p"][k] for r in rows.collect()) for k in range(3)]
    target = dict(zip(mixing.DOMAINS, totals))
    out = rows.withColumn("rate", mixing.rate(F.col("p"), mixing.fitted(rows, target, sum(totals)))).collect()
    for k, total in enumerate(totals):
        assert sum(r["rate"] * r["tokens"] * r["p"][k] for r in out) == pytest.approx(total, rel=0.01)
    assert min(r["rate"] for r in out) >= 0
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in out)


def brute_rates(p, t, wanted, most, rounds=20000):
    """Rates by plain projected gradient steps in numpy."""
    a = p * t[:, None] / wanted.sum()
    step, r = 1 / np.linalg.norm((a / t[:, None]).T @ a, 2), np.ones(len(t))
    for _ in range(rounds):
        r = np.clip(r - step * ((a.T @ r - wanted / wanted.sum()) @ a.T) / t, 0, most)
    return r


@pytest.mark.parametrize("most", [None, 1.0])
def test_mixing_rates_equal_plain_steps(spark, most):
    """The distance that is left, with targets that can and can't be met, is that of many plain steps."""
    rng = np.random.default_rng(11)
    p = rng.dirichlet([3, 0.5, 0.3], 500)
    t = rng.integers(1, 200, 500).astype(float)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)], "tokens long, p array<double>")
    for shares in ((0.9, 0.04, 0.06), (0.999, 0.0005, 0.0005)):
        wanted = np.array(shares) * t.sum() * (1 if most is None else 0.8)
        steps = mixing.fitted(rows, dict(zip(mixing.DOMAINS, shares)), wanted.sum(), most, 1e-5)
        r = np.array([x[0] for x in rows.select(mixing.rate(F.col("p"), steps, most)).collect()])
        assert r.min() >= 0 and (most is None or r.max() <= most)
        got = mixing.attained(rows, steps, most)
        assert [got[d] for d in mixing.DOMAINS] == pytest.approx(((p * t[:, None]).T @ r).tolist(), rel=1e-6)
        far = lambda x: float(np.sum((((p * t[:, None]).T @ x - wanted) / wanted.sum()) ** 2))
        best = far(brute_rates(p, t, wanted, np.inf if most is None else most))
        assert far(r) <= (3e-8 if best < 1e-9 else best * 1.01 + 1e-6)


def test_mixing_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, "clean"), (6, "toxic"), (99, "low"), (None, "low"), (3, None)], "doc_id long, domain string")
    rows = mixing.memberships(odd, labels, ["doc_id", "score"])
    assert {r["doc_id"]: r["tokens"] for r in rows.collect()} | {} and rows.filter("tokens = 0").count() == 3
    assert mixing.memberships(none, labels).count() == 0 and mixing.fitted(mixing.memberships(none, labels), mixing.TARGET) == [0.0] * 3


def test_mixing_query(spark):
    """The registered query: expected tokens meet the targets, copies are the rate rounded up or down."""
    rows = mixing.op3_mixing(spark, "/root/testdata/sf0.001").collect()
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    rate, tokens = np.array([r["rate"] for r in rows]), np.array([r["tokens"] for r in rows], float)
    wanted = np.array([mixing.TARGET[d] for d in mixing.DOMAINS]) * tokens.sum()
    best = brute_rates(np.where(tokens[:, None] > 0, p, 0), np.maximum(tokens, 1e-9), wanted, np.inf)
    far = lambda x: np.sum(((p * tokens[:, None]).T @ x / tokens.sum() - wanted / tokens.sum()) ** 2)
    assert far(rate) <= far(best) + 1e-6 and np.allclose(p.sum(1), 1) and rate.min() >= 0
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)


# --- 4 -------------------------------------------------------------------------------------------


def brute_fingerprints(texts):
    """The fingerprint of any text, from plain sets and sorted lists over all the texts."""
    import regex
    import xxhash

    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(t.encode(), seed=42).intdigest())
    own = lambda t: {signed(w) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    df = {}
    for t in texts:
        for h in own(t):
            df[h] = df.get(h, 0) + 1
    lo, hi = len(texts) * np.exp(-imatch.IDF_BAND[1]), len(texts) * np.exp(-imatch.IDF_BAND[0])
    lex = {h for h, n in df.items() if lo <= n <= hi}

    def fingerprint(t):
        terms = own(t)
        used = sorted(terms & lex if len(terms & lex) >= imatch.FEW else terms or {signed(t)})
        parts = [[h for h in used if (h >> (9 * seed + 3)) % one_of == 0] for seed in range(imatch.LEXICONS) for one_of in imatch.ONE_OF]
        return "-".join(hashlib.md5(",".join(map(str, x)).encode()).hexdigest()[:16] if x else "" for x in parts)

    return fingerprint


def brute_likeness(a, b):
    pairs = [(x, y) for x, y in zip(a.split("-"), b.split("-")) if x or y]
    return 1.0 if a == b else sum(x == y for x, y in pairs) / max(1, len(pairs))


def test_imatch_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(16)
    texts = [sentence(rng, int(rng.integers(0, 80)), "abcd") for _ in range(300)] + ["", "one", "one two", "1 2 3 4 5 6 7"]
    texts += [texts[3] + " more", texts[4], "A-b.C", "☃"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    of = brute_fingerprints(texts)
    for r in imatch.op4_imatch(spark, str(tmp_path)).collect():
        t, nxt = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (of(t), of(edited))
        assert r["near_edited"] == pytest.approx(brute_likeness(of(t), of(edited))) and r["near_next"] == pytest.approx(brute_likeness(of(t), of(nxt)))




def test_imatch(spark, odd, none, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, sentence(rng, 60, "abc")) for k in range(200)]
    rows += [(200, rows[199][1]), (201, ""), (202, None), (203, "☃!"), (204, rows[0][1] + " extra")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in imatch.op4_imatch(spark, str(tmp_path)).collect()}
    assert len(got) == 205
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[199]["near_next"] == 1 and got[201]["near_next"] == 1 and got[199]["fingerprint"] == got[200]["fingerprint"]
    assert np.mean([got[k]["near_edited"] for k in range(200)]) > np.mean([got[k]["near_next"] for k in range(199)])


def test_imatch_odd_rows(spark, odd, none, tmp_path):
    odd.write.parquet(str(tmp_path / "a/documents.parquet"))
    none.write.parquet(str(tmp_path / "b/documents.parquet"))
    assert imatch.op4_imatch(spark, str(tmp_path / "a")).count() == odd.count()
    assert imatch.op4_imatch(spark, str(tmp_path / "b")).count() == 0


# --- 5, 6, 8 -------------------------------------------------------------------------------------


def test_quality_learns_from_positives(spark):
    rng = np.random.default_rng(4)
    good = [sentence(rng, 40) + "." for _ in range(400)]
    bad = [" | ".join(sentence(rng, 30).upper().split()) + "!!" for _ in range(100)]
    m = quality.fit(np.array([quality.measures(t) for t in good[:200]]), np.array([quality.measures(t) for t in good[200:] + bad[:50]]), 0.8)
    assert m.scores(np.array([quality.measures(t) for t in good])).min() > 0.5
    assert m.scores(np.array([quality.measures(t) for t in bad[50:]])).max() < 0.5


@pytest.mark.parametrize("share", [0.4, 0.8])
def test_quality_prior_needs_no_negatives(share):
    rng = np.random.default_rng(14)
    positive = rng.normal(1, 1, (600, quality.N_MEASURES))
    n = int(1200 * share)
    unlabelled = np.vstack([rng.normal(1, 1, (n, quality.N_MEASURES)), rng.normal(-1, 1, (1200 - n, quality.N_MEASURES))])
    assert quality.estimated_prior(positive, rng.permutation(unlabelled)) == pytest.approx(share, abs=0.06)


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(5)
    make = lambda k: sentence(rng, 40) + (" you utter scoundrelly knave " if k else " ") + sentence(rng, 40)
    y = np.arange(400) % 4 == 0
    texts = [make(k) for k in y]
    df = spark.createDataFrame(list(zip(map(int, y), texts)), "y int, text string")
    counts = toxicity.class_counts(df)
    held = [set(toxicity.distinct_buckets(t, toxicity.ORDERS, toxicity.BITS).tolist()) for t in texts]
    counted = {r["bucket"]: (r["in1"], r["in0"]) for r in counts.collect()}
    assert counted.pop(-1) == (100, 300)
    assert counted == {b: (sum(b in h for h, k in zip(held, y) if k), sum(b in h for h, k in zip(held, y) if not k)) for b in set().union(*held)}
    chosen = toxicity.chosen_buckets(counts)
    rows = [np.asarray(r["x"]) for r in toxicity.held_places(df, chosen).collect()]
    assert all({int(chosen[k]) for k in x} == h & set(chosen.tolist()) for x, h in zip(rows, held))
    m = toxicity.Scorer(toxicity.fit(rows, y, 0.25, chosen))
    fresh = [make(k) for k in (1, 0) * 30]
    assert [m.score(t) >= 0.7 for t in fresh] == [True, False] * 30
    assert m.score(None) == m.score("") < 0.7
    assert toxicity.Scorer(toxicity.fit(rows[:3], np.zeros(3), 0.3, chosen)).score("x") == pytest.approx(0.3)


def test_langid_held_out():
    rng = np.random.default_rng(6)
    alphabets = {"aa": "abcdefg", "bb": "defghij", "cc": "hijklmn"}
    texts, langs = zip(*[(sentence(rng, 20, a), x) for x, a in alphabets.items() for _ in range(60)])
    m = langid.fit(list(texts), list(langs), np.ones(1 << langid.BITS))
    fresh = [(sentence(rng, 20, a), x) for x, a in alphabets.items() for _ in range(20)]
    assert np.mean([m.predict(t)[0] == x for t, x in fresh]) > 0.95
    assert m.predict(None) == m.predict("12 3!") == (langid.UND, 0.0)
    assert (m.weights == 0).mean() > 0.5 and langid.fit([], [], np.ones(1 << langid.BITS)).predict("abc") == (langid.UND, 0.0)


def test_langid_learns_all_languages(spark, monkeypatch):
    """More languages than the model has room for at full width: fewer buckets, no language left out."""
    monkeypatch.setattr(langid, "CELLS", 1 << 15)
    rng = np.random.default_rng(13)
    alphabets = {f"l{k:02d}": rng.choice([chr(c) for c in range(97, 123)] + [chr(c) for c in range(0x430, 0x450)], 6, replace=False) for k in range(12)}
    rows = [(k, sentence(rng, 15, a), x) for k, (x, a) in enumerate(list(alphabets.items()) * 20)] + [(999, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.trained(df)
    assert m.langs == sorted(alphabets) and len(m.idf) == 1 << langid.bits_for(12) < 1 << langid.BITS
    assert np.mean([m.predict(sentence(rng, 15, a))[0] == x for x, a in alphabets.items() for _ in range(5)]) > 0.9


def test_ngrams_in_pieces(monkeypatch):
    text = "Some Text   with\tspaces and ünïcode " * 20
    whole = np.sort(np.concatenate(list(ngrams.hashed(text, (1, 3, 5), 16))))
    monkeypatch.setattr(ngrams, "PIECE", 50)
    assert (np.sort(np.concatenate(list(ngrams.hashed(text, (1, 3, 5), 16)))) == whole).all()


def test_classifiers_odd_rows(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(9)] + [(None, 1, True), (3, None, None)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    for name, docs, lab in (("a", odd, labels), ("b", none, labels), ("c", odd, labels.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        lab.write.parquet(str(tmp_path / name / "labels.parquet"))
        for f, fold, held in ((quality.op5_quality, 3, 1), (toxicity.op8_toxicity, 3, 1), (langid.op6_langid, 4, 2)):
            out = f(spark, str(tmp_path / name)).collect()
            assert len(out) == docs.count()
            assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % fold == held) for r in out)


# --- 7 -------------------------------------------------------------------------------------------


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PII = [
    "mail a.b%c@d-e.f.g_h@i.j.k and x@y", "a@b.c_d@e.f", "@a.b c@d c@.d c@d..e c@d.e.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1..2.3.4 01.02.03.04.", "4111 1111-1111 1111 and 4111111111111111 5 4111  1111",
    "+1 (706) 555-3138 Therou +49 30 1234567 190. +123 ++1 234 567 8901 +1234567890123456", "12-34 56-78 90 12 34 56 00", "é☃ +1 555 123 4567 ☃ a@b.co 10.0.0.1", "\x01\x02 4\x011 a\x02b@c.d 4111-1111 1111 1111\x01", "",
    "9" * 500 + "@" + "a." * 300 + "b", "1 " * 3000, "(555) 123-4567 call 555-123-4567", "x" * 2000 + "@" + "y" * 50,
]


def test_pii_base_spans(spark):
    rng = np.random.default_rng(7)
    texts = PII + ["".join(rng.choice(list("0123456789.-+ ()@ab_%\n"), 80)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.found_in(df, ["doc_id"]).collect():
        assert [(x["s"], x["k"], x["e"]) for x in r["base"]] == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]][:80]


def test_pii_adds_and_redacts(spark):
    texts = [f"please call +1 (706) 555-{k:04d} soon" for k in range(60)] + [f"please call (706) 555-{k:04d} soon" for k in range(3)] + [f"order {k}{k}4 999 1234 was sent" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.found_in(df, ["doc_id", "text"])
    model = pii.learned(found)
    out = {r["doc_id"]: r for r in found.withColumn("spans", pii.all_spans(F.col("base"), F.col("cands"), model)).withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect()}
    assert out[0]["clean"] == "please call <PHONE> soon" and all(len(r["spans"]) >= len(r["base"]) for r in out.values())
    assert out[80]["clean"] == texts[80]


def planted(rng, variants):
    """A text and its planted spans: numbers and addresses among words, in the base patterns' formats or in variants of these."""
    n = lambda k: "".join(map(str, rng.integers(1, 10, k)))
    card = n(15)
    card += next(c for c in "0123456789" if sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(card + c))) % 10 == 0)
    octets = [str(x) for x in rng.integers(1, 255, 4)]
    secret = "".join(rng.choice(list("0123456789abcdef"), 40))
    who, host = sentence(rng, 1), sentence(rng, 1)
    if variants:
        made = [f"{who} (at) {host} (dot) com", "[.]".join(octets), ".".join(card[k : k + 4] for k in (0, 4, 8, 12)), f"({n(3)}) 555-{n(4)}", secret]
    else:
        made = [f"{who}@{host}.com", ".".join(octets), card, f"+1 ({n(3)}) 555-{n(4)}", f'token = "{secret}"']
    text, spans = sentence(rng, 8), []
    for k, m in enumerate(made):
        text += " "
        spans.append((k, len(text), len(text) + len(m)))
        text += m + " " + sentence(rng, 5)
    return text, spans


def test_pii_adds_what_the_patterns_do_not_know(spark):
    """Recall and precision of added spans, on variants of the formats that no base pattern matches."""
    rng = np.random.default_rng(12)
    learn = [planted(rng, False)[0] for _ in range(200)]
    plain = [f"{sentence(rng, 4)} {rng.integers(10**15, 10**16)} {sentence(rng, 3)} 1.{rng.integers(300, 900)}.2.3 and version 4.1.2, {rng.integers(1000)} of {rng.integers(1000)} {'x' * 30}9 end" for _ in range(200)]
    tests = [planted(rng, True) for _ in range(100)]
    texts = learn + plain + [t for t, _ in tests]
    found = pii.found_in(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"])
    model = pii.learned(found.filter("doc_id < 400"))
    spans = {r["doc_id"]: r for r in found.withColumn("all", pii.all_spans(F.col("base"), F.col("cands"), model)).collect()}
    wanted = {(400 + i, *x) for i, (_, own) in enumerate(tests) for x in own}
    got = {(i, x["k"], x["s"], x["e"]) for i, r in spans.items() if i >= 200 for x in r["all"] if x not in r["base"]}
    assert all(x in r["all"] for r in spans.values() for x in r["base"])
    near = lambda a, b: a[:2] == b[:2] and a[2] < b[3] and b[2] < a[3]
    by_doc = {}
    for g in got:
        by_doc.setdefault(g[0], []).append(g)
    caught = [any(near(g, w) for g in by_doc.get(w[0], [])) for w in wanted]
    right = [any(near(g, w) for w in wanted) for g in got]
    assert np.mean(caught) >= 0.9 and np.mean(right) >= 0.9, {k: np.mean([c for c, w in zip(caught, wanted) if w[1] == k]) for k in range(5)}


def test_pii_many_matches(spark):
    """Places are right beyond a run of matches, and a long text with many digits is no matter."""
    text = " ".join(f"a{k}@b.co 2024-01-{k % 30:02d} 12:{k % 60:02d}:07.{k % 1000}" for k in range(3000))
    (r,) = pii.found_in(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).collect()
    assert [(x["s"], x["k"], x["e"]) for x in r["base"]] == base_spans(text)


def test_pii_odd_rows(spark, odd, none, tmp_path):
    for name, docs in (("a", odd), ("b", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = pii.op7_pii(spark, str(tmp_path / name)).collect()
        assert len(out) == docs.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in out)


# --- 9 -------------------------------------------------------------------------------------------


def test_media_sequence(spark):
    html = '<h1>T</h1>a <b>b</b><figure><img src="sha256:00" alt="x"><figcaption>cap &amp; more</figcaption></figure><script>no</script><p>c<img src="u.png">d</p>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    items = {r["page_id"]: [tuple(x) for x in r["items"]] for r in media.sequences(pages).collect()}
    assert items[1] == [(0, "text", "T", None, None), (1, "text", "a b", None, None), (2, "media", None, "sha256:00", "cap & more"), (3, "text", "c", None, None), (4, "media", None, "u.png", None), (5, "text", "d", None, None)]
    assert items[2] == items[3] == []
    store = spark.createDataFrame([("00" * 32, b"x")], "digest string, media binary")
    seqs = media.sequences(spark.createDataFrame([(1, f'<img src="sha256:{"00" * 32}"><img src="sha256:{"11" * 32}">')], "page_id long, html string"))
    assert [r["media"] for r in media.resolved(seqs, store).orderBy("position").collect()] == [b"x", None]


def test_media_table_holds_the_bytes(spark, odd, tmp_path, monkeypatch):
    """Each payload is stored once, and the result is that of the stored bytes; others than the digest's are refused."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    tables = {}
    monkeypatch.setattr(media, "written", lambda df, name, *how: tables.setdefault(name, common.written(df, name, *how)))
    out = media.op9_media(spark, str(tmp_path)).collect()
    held = {r["digest"]: bytes(r["media"]) for r in tables["media"].collect()}
    assert tables["media"].count() == len(held) and {r["media_sha256"] for r in out} == set(held)
    for r in out:
        back = media.from_pgm(held[r["media_sha256"]]).tobytes()
        assert (r["payload_sha256"], r["media_bytes"]) == (hashlib.sha256(back).hexdigest(), len(held[r["media_sha256"]]))
    spoilt = spark.createDataFrame([("00" * 32, media.to_pgm(media.padded(b"x")))], "digest string, media binary")
    with pytest.raises(Exception, match="not those of"):
        media.reread(spoilt).collect()


def test_media_round_trip(spark, odd, none, tmp_path):
    for name, docs in (("a", odd), ("b", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = media.op9_media(spark, str(tmp_path / name)).collect()
        assert len(out) == docs.count()
        for r in out:
            data = ((TEXTS[r["doc_id"]] if r["doc_id"] is not None else TEXTS[7]) or "").encode()
            payload = media.padded(data)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert r["media_sha256"] == hashlib.sha256(media.to_pgm(payload)).hexdigest() and len(payload) % 192 == 0 and len(payload) > 0
    kept = media.stored_text(odd, keep_media=True).collect()
    assert all(media.from_pgm(r["media"]).tobytes().rstrip(b" ") == ((TEXTS[r["doc_id"]] if r["doc_id"] is not None else TEXTS[7]) or "").encode().rstrip(b" ") for r in kept)


# --- 10 ------------------------------------------------------------------------------------------

PIECES = ["", "  a b ", " \n \n", "ﬁ  x ☃ 日本", "a\r\nb\x00Ⅷ", "😀 élan ", "x" * 5000, " " * 100 + "z", "Internationalization of hyperparameters!", "def foo(self, bar=None):\n        return bar[0] + 12345.678", "ünïcödé  " * 30, LONG[:20000]]


def test_pieces_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pieces.model_path()
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(pieces.Pieces.load(path))
    rng = np.random.default_rng(8)
    texts = PIECES + ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     .,ETAOINéß\n12"), 200)) for _ in range(300)]
    got = own.encode(texts)
    assert got == lib.encode(texts)
    assert [own.p.decode(x) for x in got] == texts
    assert own.encode([None]) == [[]]
    long = ["".join(rng.choice(list("abcdeorstinABCß☃日本語のは123_."), n)) for n in (49, 300, 3000, 20000)] + ["http://www.example.com/" + "path/of/words-" * 40, "日本語のテキストは" * 60]
    assert own.encode(long) == lib.encode(long)
    assert all(own.alone(w) == own.words[w] for w in list(own.words)[:2000] if 1 < len(w) <= pieces.ALONE)


def test_unigram_takes_the_best_sum():
    p = pieces.Pieces(["a", "b", "ab", "abb", "▁"], [-2.0, -2.0, -1.5, -6.0, -1.0], [], False, [True] * 5)
    assert [p.names[i] for i in pieces.Encoder(p).encode(["abb"])[0]] == ["▁", "ab", "b"]


def test_pieces_odd_rows(spark, odd, none):
    p = pieces.Pieces.load(pieces.model_path())
    out = pieces.encoded(odd, p)
    assert out.count() == odd.count() and out.filter("not round_trip").count() == 0
    assert pieces.encoded(none, p).count() == 0
    back = {r["doc_id"]: r["decoded_text"] for r in pieces.decoded(out, p).collect()}
    assert back[6] == LONG and back[0] == ""


# --- all ----------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    good = [sentence(rng, 50) + ". Mail me@x.org now." for _ in range(120)]
    texts = good + good[:20] + [" | ".join(sentence(rng, 40).upper().split()) + "!!" for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "extra") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, slot string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 140), 0) for k in range(0, 200, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        counts.append(df.count())
        if name != "encoding":
            assert df.columns == list(corpus_pipeline.COLUMNS)
    ids = {r["doc_id"] for r in df.collect()}
    assert set(range(120)) <= ids and not ids & set(range(120, 200))
    assert spark.read.parquet(str(tmp_path / "personal data")).filter("text like '%@%'").count() == 0
    assert df.filter("not round_trip").count() == 0
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_pipeline_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, ties and foreign columns go through all stages."""
    import corpus_pipeline

    rng = np.random.default_rng(17)
    good = [(100 + k, sentence(rng, 40) + ".", "en", "s", 1, "x", "y", 1.0) for k in range(60)]
    docs = odd.unionByName(spark.createDataFrame(good + good[:10] + [(100, sentence(rng, 30), None, None, None, None, None, None), (None, sentence(rng, 30), None, None, None, None, None, None)], odd.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + k, 1, 0) for k in range(60)] + [(100, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert all(ids.count(100 + k) == 1 for k in range(1, 60)) and len(out) <= docs.count() - 10
    assert all(r["round_trip"] for r in out)


def test_shared_dir_follows_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

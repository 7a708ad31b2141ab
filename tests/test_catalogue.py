"""Every catalogue query against its SQL on the smallest tables."""

import hashlib
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from sigloom.plans import catalogue, catalogue2, catalogue3  # noqa: E402, F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"cpca_cv", "kde1d"}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in TABLES:
        p = f"{DATA}/{n}.parquet"
        c.execute(f"create view {n} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    rel = con.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert mine == sorted(tuple(norm(r[k]) for k in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - SLOW))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_whole_channels_are_filtered_and_drawn(spark, monkeypatch):
    ch = {}
    for r in catalogue.series(spark, DATA).orderBy("ch", "i").collect():
        ch.setdefault(r["ch"], []).append(r["v"])
    got = {(r["ch"], r["i"]): r["y"] for r in catalogue.QUERIES["biquad_filter"](spark, DATA).collect()}
    assert len(got) == sum(map(len, ch.values()))
    for c, v in ch.items():
        y = []
        for i, x in enumerate(v):
            past = lambda a, k: a[i - k] if i >= k else 0.0
            y.append(0.0247849 * (x - past(v, 2)) + 1.9588637 * past(y, 1) - 0.9700202 * past(y, 2))
        assert [got[c, i + 1] for i in range(len(v))] == pytest.approx(y, abs=2e-6)
    blocks = {(r["ch"], r["blk"]) for r in catalogue.QUERIES["dft_amplitude"](spark, DATA).select("ch", "blk").collect()}
    assert blocks == {(c, b) for c, v in ch.items() for b in range(-(-len(v) // 128))}
    taken = []
    monkeypatch.setattr(catalogue2.regress, "surrogate_r2", lambda spark, x, y, n: taken.append(len(x)) or spark.createDataFrame([(0, 0.0)], "draw long, r2 double"))
    rows = [(k, f"2024-01-01 00:00:00.{k:06d}", c, float(k % 7)) for k, c in enumerate(["click", "view"] * 250)]
    monkeypatch.setattr(catalogue2, "series", lambda spark, d: spark.createDataFrame([(c, k // 2 + 1, v) for k, _, c, v in rows], "ch string, i long, v double"))
    catalogue.QUERIES["surrogate_r2"](spark, DATA)
    assert taken == [250]


def test_mask_pii_keeps_texts_with_names(spark, tmp_path):
    rows = [(1, "Patient Name: Ann Lee, born 3/14/1980, no. 1234567."), (2, "no one here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["h"] for r in catalogue.QUERIES["mask_pii"](spark, str(tmp_path)).collect()}
    wanted = {1: "Patient Name: X, born 00/00/1980, no. 88888888.", 2: "no one here"}
    assert got == {k: hashlib.md5(t.encode()).hexdigest() for k, t in wanted.items()}


ODD_VECTORS = {
    "roots that are equal": [(1, [1.0, 2.0**-26], 1), (2, [1.0, 0.0], 2), (3, [0.0, 0.0], 3), (4, [100.0, 100.0], 3)],
    "nulls": [(1, [0.0, 1.0], None), (2, [5.0, 5.0], 1), (3, None, 1), (4, [9.0, None], 2), (5, [7.0, 9.0], 2), (6, [0.5, 1.0], 2), (7, None, 3), (None, [5.0, 4.0], 1)],
    "short and strange": [(1, [], 1), (2, [1.0], 1), (3, [2.0, 2.0], 1), (4, [float("nan"), 0.0], 2), (5, [float("inf"), 0.0], 3), (6, [8.0, 8.0], 4)],
    "ids that are shared": [(1, [0.0, 0.0], 1), (1, [9.0, 8.0], 2), (2, [9.0, 9.0], 2), (2, [1.0, 0.0], 1), (3, None, 1), (3, [9.0, 9.0], 2)],
    "none": [],
}


@pytest.mark.parametrize("kind", ODD_VECTORS)
def test_nearest_class_mean_on_odd_vectors(spark, tmp_path, kind):
    spark.createDataFrame(ODD_VECTORS[kind], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    df = catalogue.QUERIES["nearest_class_mean"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = c.sql(catalogue.SQL["nearest_class_mean"]).fetchall()
    assert df.columns == ["vec_id", "decision"] and sorted(map(norm, df.collect())) == sorted(map(norm, wanted))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""The second part of the catalogue: spectra, class models, validation, regression, codecs, channels, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.functions import geometry, textcodec, timecodec
from sigloom.operators import channels, classify, dsp, joins, linalg, regress, spectral, validate
from sigloom.plans.catalogue import SERIES, load, query, r6, series

def from_zero(spark, d):
    return series(spark, d).withColumn("t", F.col("i") - 1)


BANDS = [(0.0, 4.0), (4.0, 8.0), (8.0, 16.0), (16.0, 65.0)]

DFT = SERIES + """, y as (select ch, (i - 1) // 128 blk, k, sum(v * cos(2 * pi() * k * ((i - 1) % 128) / 128)) re, -sum(v * sin(2 * pi() * k * ((i - 1) % 128) / 128)) im from s cross join (select range k from range(65)) q group by all)"""


def blocks128(spark, d):
    """Every sample, by its block of 128; a last block that is shorter counts as filled up with zeros."""
    t = F.col("i") - 1
    return series(spark, d).withColumn("blk", F.floor(t / 128).cast("long")).withColumn("t", t % 128)


@query(f"with {DFT} select ch, cast(blk as bigint) blk, cast(k as int) k, round(2 * sqrt(re * re + im * im) / 128, 6) amp from y")
def dft_amplitude(spark, d):
    """Every block of 128 samples of each channel."""
    return spectral.amplitude(blocks128(spark, d), ["ch", "blk"], "t", "v", 128).select("ch", "blk", "k", r6("amp").alias("amp"))


@query(f"""
with {DFT}, b as (select * from (values (0.0::double, 4.0::double), (4, 8), (8, 16), (16, 65)) t(lo, hi))
select ch, cast(blk as bigint) blk, lo, hi, round(sum(case when k in (0, 64) then 1 else 2 end * (re * re + im * im) / 16384), 6) power from y join b on k >= lo and k < hi group by ch, blk, lo, hi
""")
def bandpower_fft(spark, d):
    """Every block of 128 samples of each channel."""
    return spectral.band_power(blocks128(spark, d), ["ch", "blk"], "t", "v", 128, 128.0, BANDS).select("ch", "blk", "lo", "hi", r6("power").alias("power"))


@query(f"with {SERIES} select ch, cast(floor((i - 1) / 32) as bigint) seg, round(avg(v * v), 6) power from s group by 1, 2 having count(*) = 32")
def segment_power(spark, d):
    return spectral.segment_power(from_zero(spark, d), ["ch"], "t", "v", 32).select("ch", "seg", r6("power").alias("power"))


BIQUAD = """g as (select * from (values (500.0::double, 8.0::double, 12.0::double), (256, 4, 8), (1000, 13, 30), (250, 0.5, 4)) t(fs, lo, hi)), w as (select *, tan(pi() * lo / fs) w1, tan(pi() * hi / fs) w2 from g),
x as (select *, w2 - w1 b, w1 * w2 c from w), p as (select *, sqrt((sqrt(16 * c * c + b * b * b * b) - 4 * c) / 2) dr, -sqrt((sqrt(16 * c * c + b * b * b * b) + 4 * c) / 2) di from x),
s as (select fs, lo, hi, b, k, (-b / sqrt(2.0::double) + k * dr) / 2 sr, (b / sqrt(2.0::double) + k * di) / 2 si from p cross join (values (1), (-1)) q(k)),
z as (select *, 1 - 2 * sr + sr * sr + si * si a0, sr * sr + si * si nn from s)"""


@query(f"with {BIQUAD} select fs, lo, hi, cast(case when k = 1 then 1 else 2 end as int) section, round(b / a0, 6) scale, round(2 * (nn - 1) / a0, 6) a1, round((1 + 2 * sr + nn) / a0, 6) a2 from z")
def biquad_coefs(spark, d):
    g = spark.createDataFrame([(500.0, 8.0, 12.0), (256.0, 4.0, 8.0), (1000.0, 13.0, 30.0), (250.0, 0.5, 4.0)], "fs double, lo double, hi double")
    rows = g.select("*", F.posexplode(spectral.biquad_design(F.col("fs"), F.col("lo"), F.col("hi"))).alias("p", "s"))
    return rows.select("fs", "lo", "hi", (F.col("p") + 1).alias("section"), *[r6(f"s.{c}").alias(c) for c in ("scale", "a1", "a2")])


@query(f"""
with recursive {SERIES.replace("s as (", "s as materialized (")},
r(ch, i, y, z1, z2) as (select ch, i, 0.0247849::double * v, 1.9588637::double * (0.0247849::double * v), -0.0247849::double * v - 0.9700202::double * (0.0247849::double * v) from s where i = 1
 union all select s.ch, s.i, 0.0247849::double * s.v + r.z1, r.z2 + 1.9588637::double * (0.0247849::double * s.v + r.z1), -0.0247849::double * s.v - 0.9700202::double * (0.0247849::double * s.v + r.z1) from r join s on s.ch = r.ch and s.i = r.i + 1)
select ch, i, round(y, 6) y from r
""")
def biquad_filter(spark, d):
    """One band-pass section over whole channels."""
    section = [[0.0247849, 0.0, -0.0247849, 1.0, -1.9588637, 0.9700202]]
    out = dsp.mapped(dsp.blocks(series(spark, d), ["ch"], "i", "v"), lambda x: dsp.run_sections(x, section)[0])
    return dsp.unblocked(out, ["ch"]).select("ch", F.col("idx").cast("long").alias("i"), r6("value").alias("y"))


BLOCKS8 = SERIES + ", x as (select ch, cast(floor((i - 1) / 8) as bigint) blk, (i - 1) % 8 p, v from s), f as (select ch, blk from x group by 1, 2 having count(*) = 8)"


@query(f"""
with {BLOCKS8} select x.ch, x.blk, cast(k as int) k, round(sum(v * cos(pi() * (2 * p + 1) * k / 16)) * case when k = 0 then sqrt(1 / 8.0::double) else 0.5::double end, 6) c
from x join f using (ch, blk) cross join (select range k from range(8)) q group by x.ch, x.blk, k
""")
def dct8(spark, d):
    x = series(spark, d).withColumn("blk", F.floor((F.col("i") - 1) / 8).cast("long"))
    b = dsp.blocks(x, ["ch", "blk"], "i", "v").filter("size(values) = 8")
    return b.select("ch", "blk", F.posexplode(spectral.dct8(F.col("values"))).alias("k", "c")).select("ch", "blk", "k", r6("c").alias("c"))


@query(f"with {BLOCKS8} select x.ch, x.blk, cast(p as int) p, round(v, 6) v from x join f using (ch, blk)")
def idct8(spark, d):
    """The inverse of dct8 gives the samples back."""
    x = series(spark, d).withColumn("blk", F.floor((F.col("i") - 1) / 8).cast("long"))
    b = dsp.blocks(x, ["ch", "blk"], "i", "v").filter("size(values) = 8").withColumn("c", spectral.dct8(F.col("values")))
    return b.select("ch", "blk", F.posexplode(spectral.idct8(F.col("c"))).alias("p", "v")).select("ch", "blk", "p", r6("v").alias("v"))


# --- classes ------------------------------------------------------------------------------------

LONG8 = "l as (select vec_id id, label, i, embedding[i + 1]::double x from embeddings cross join (select range i from range(4)) q)"


@query(f"with {LONG8} select cast(label as int) label, cast(i as int) i, count(*) n, round(avg(x), 6) m, round(var_pop(x), 6) vp, round(var_samp(x), 6) vs from l group by 1, 2")
def class_stats(spark, d):
    s = linalg.statistics(load(spark, d, "embeddings"), "embedding", 4, "label")
    rows = [(int(c), i, int(s.n[k]), round(float(s.mean[k, i]), 6), round(float(s.cov[k, i, i]), 6), round(float(s.sample_cov()[k, i, i]), 6)) for k, c in enumerate(s.names) for i in range(4)]
    return spark.createDataFrame(rows, "label int, i int, n long, m double, vp double, vs double")


@query(f"with {LONG8} select cast(a.label as int) label, cast(a.i as int) i, cast(b.i as int) j, round(covar_samp(a.x, b.x), 6) c from l a join l b on a.id = b.id group by 1, 2, 3")
def class_cov(spark, d):
    s = linalg.statistics(load(spark, d, "embeddings"), "embedding", 4, "label")
    rows = [(int(c), i, j, round(float(s.sample_cov()[k, i, j]), 6)) for k, c in enumerate(s.names) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "label int, i int, j int, c double")


@query(f"""
with {LONG8}, c as (select label, a.i, b.i j, covar_pop(a.x, b.x) c, avg(a.x) ma, avg(b.x) mb, count(*) n from (select * from l) a join (select id, i, x from l) b on a.id = b.id group by label, a.i, b.i),
t as (select a.i, b.i j, covar_pop(a.x, b.x) st from l a join l b on a.id = b.id group by 1, 2), w as (select i, j, sum(c * n) / sum(n) sw from c group by 1, 2)
select cast(i as int) i, cast(j as int) j, round(sw, 6) "within", round(st - sw, 6) "between", round(st, 6) total from w join t using (i, j)
""")
def scatter_matrices(spark, d):
    import numpy as np

    s = linalg.statistics(load(spark, d, "embeddings"), "embedding", 4, "label")
    sw, st = np.einsum("c,cij->ij", s.priors, s.cov), s.total()[2]
    rows = [(i, j, round(float(sw[i, j]), 6), round(float(st[i, j] - sw[i, j]), 6), round(float(st[i, j]), 6)) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "i int, j int, within double, between double, total double")


@query("""
with m as (select label c, avg(embedding[1]::double) m1, avg(embedding[2]::double) m2 from embeddings group by 1), n as (select *, row_number() over (order by c) no from m),
x as (select vec_id, no, row_number() over (partition by vec_id order by (embedding[1]::double - m1) ** 2 + (embedding[2]::double - m2) ** 2, no) r from embeddings cross join n)
select vec_id, cast(no as int) decision from x where r = 1
""")
def nearest_class_mean(spark, d):
    """One row per vec_id: of rows that share it, the one nearest to a mean counts; where no distance is known, the first class."""
    e = load(spark, d, "embeddings").select("vec_id", "label", F.array(*[F.get("embedding", F.lit(k)).cast("double") for k in range(2)]).alias("x"))
    _, means = linalg.means(e, "x", 2, "label")
    near = e.select("vec_id", classify.mean_distances(F.col("x"), means).alias("d2")).select("vec_id", F.array_min("d2").alias("d2"), F.coalesce(classify.first_least(F.col("d2")), F.lit(1)).alias("decision"))
    best = near.groupBy("vec_id").agg(F.min(F.struct(F.col("d2").isNull().alias("unknown"), "d2", "decision")).alias("best"))
    return best.select("vec_id", "best.decision")


QDA = """m as (select label c, count(*) n, avg(embedding[1]::double) m1, avg(embedding[2]::double) m2, var_samp(embedding[1]::double) a, var_samp(embedding[2]::double) b, covar_samp(embedding[1]::double, embedding[2]::double) k from embeddings group by 1)"""


@query(f"""
with {QDA}, f as (select vec_id, label, c, n * exp(-0.5 * (b * (embedding[1]::double - m1) ** 2 - 2 * k * (embedding[1]::double - m1) * (embedding[2]::double - m2) + a * (embedding[2]::double - m2) ** 2) / (a * b - k * k)) / sqrt(a * b - k * k) f from embeddings cross join m)
select vec_id, cast(c as int) class, round(f / sum(f) over (partition by vec_id), 6) p from f
""")
def qda_posterior(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("x"))
    s = linalg.statistics(e, "x", 2, "label")
    p = e.select("vec_id", F.posexplode(classify.posterior(classify.densities(F.col("x"), s), s.priors)).alias("k", "p"))
    names = F.array(*[F.lit(int(c)) for c in s.names])
    return p.select("vec_id", F.get(names, F.col("k")).alias("class"), r6("p").alias("p"))


@query(f"""
with {QDA}, w as (select sum(n * a) / sum(n) a, sum(n * b) / sum(n) b, sum(n * k) / sum(n) k from m),
f as (select vec_id, c, n * exp(-0.5 * (w.b * (embedding[1]::double - m1) ** 2 - 2 * w.k * (embedding[1]::double - m1) * (embedding[2]::double - m2) + w.a * (embedding[2]::double - m2) ** 2) / (w.a * w.b - w.k * w.k)) f from embeddings cross join m cross join w)
select vec_id, cast(c as int) class, round(f / sum(f) over (partition by vec_id), 6) p from f
""")
def lda_posterior(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("x"))
    s = linalg.statistics(e, "x", 2, "label")
    p = e.select("vec_id", F.posexplode(classify.posterior(classify.densities(F.col("x"), s, "linear"), s.priors)).alias("k", "p"))
    names = F.array(*[F.lit(int(c)) for c in s.names])
    return p.select("vec_id", F.get(names, F.col("k")).alias("class"), r6("p").alias("p"))


# Every vector with all its dimensions, asked of all others.


def all_vectors(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return e.select(F.col("vec_id").alias("q_id"), F.col("x").alias("q_x")), e.select(F.col("vec_id").alias("r_id"), F.col("x").alias("r_x"), "label")


NEAR = """e as (select vec_id id, label, embedding::double[] x from embeddings), p as (select q.id q_id, r.id r_id, r.label, list_distance(q.x, r.x) d from e q join e r on q.id <> r.id),
n as (select *, row_number() over (partition by q_id order by d, r_id) r from p)"""


@query(f"with {NEAR} select q_id, cast(label as int) label, round(count(*) / 7.0::double, 6) share from n where r <= 7 group by 1, 2")
def knn_prob(spark, d):
    q, r = all_vectors(spark, d)
    return classify.neighbour_shares(q, r, 7, apart=True).select("q_id", "label", r6("share").alias("share"))


@query(f"with {NEAR}, v as (select q_id, label, sum(1 / greatest(d, 1e-12::double)) s from n where r <= 7 group by 1, 2) select q_id, cast(label as int) label, round(s / sum(s) over (partition by q_id), 6) share from v")
def wknn_prob(spark, d):
    q, r = all_vectors(spark, d)
    return classify.neighbour_shares(q, r, 7, weighted=True, apart=True).select("q_id", "label", r6("share").alias("share"))


@query(f"with {NEAR} select q_id, r_id, cast(r as int) rank, round(d, 6) d from n where r <= 5")
def knn_join(spark, d):
    q, r = all_vectors(spark, d)
    return joins.nearest(q, r.drop("label"), 5, apart=True).select("q_id", "r_id", "rank", r6("d").alias("d"))


@query(f"with {NEAR}, m as (select q_id, min(d) d from p where d > 0 group by 1) select round(median(d), 6) nn_median from m")
def nn_distance_median(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return joins.nearest_distance_median(e, "vec_id", "x").select(r6("nn_median").alias("nn_median"))


@query("""
with e as (select vec_id id, label, embedding::double[] x from embeddings)
select q.id q_id, cast(r.label as int) label, round(ln(avg(exp(-0.5 * (list_distance(q.x, r.x) / 0.05::double) ** 2) / (0.05::double * sqrt(2 * pi())) ** 64)), 6) log_density from e q cross join e r group by 1, 2
""")
def parzen_pdf(spark, d):
    """Logarithms, as densities in 64 dimensions have hundreds of digits."""
    q, r = all_vectors(spark, d)
    return classify.parzen(q, r, 0.05, dims=64).select("q_id", "label", r6(F.log("density")).alias("log_density"))


VOTED = "w as (select q_id, label, count(*) k from n where r <= 7 group by 1, 2), z as (select q_id, label dec, row_number() over (partition by q_id order by k desc, label) o from w), c as (select dec decision, e.label truth, count(*) n from z join e on e.id = z.q_id where o = 1 group by 1, 2)"
DECIDED = f"{NEAR}, {VOTED}"


def decided(spark, d, votes=knn_prob):
    votes = votes(spark, d)
    best = votes.groupBy("q_id").agg(F.max_by("label", F.struct("share", -F.col("label"))).alias("decision"))
    truth = load(spark, d, "embeddings").select(F.col("vec_id").alias("q_id"), F.col("label").alias("truth"))
    return best.join(truth, "q_id")


@query(f"with {DECIDED} select cast(decision as int) decision, cast(truth as int) truth, n from c")
def confusion_matrix(spark, d):
    return validate.confusion(decided(spark, d, knn_prob))


@query(f"with {DECIDED} select cast(decision as int) decision, cast(truth as int) truth, round(n / sum(n) over (partition by truth), 6) share from c")
def pconfuse(spark, d):
    return validate.shares(validate.confusion(decided(spark, d, knn_prob))).select("decision", "truth", r6("share").alias("share"))


@query(f"with {DECIDED} select round(sum(case when decision = truth then n else 0 end) / sum(n), 6) pcorrect from c")
def pcorrect(spark, d):
    return validate.correct(validate.confusion(decided(spark, d, knn_prob))).select(r6("pcorrect").alias("pcorrect"))


@query(f"with {DECIDED}, s as (select *, n / sum(n) over (partition by truth) share from c) select round(sum(case when decision = truth then share * 0.1::double else 0 end), 6) pcorrect from s")
def pcorrect_prior(spark, d):
    return validate.correct_by_prior(validate.confusion(decided(spark, d, knn_prob)), {k: 0.1 for k in range(10)}).select(r6("pcorrect").alias("pcorrect"))


@query("""
with x as (select vec_id, label, row_number() over (partition by label order by md5(vec_id::varchar || '0'), vec_id) r, count(*) over (partition by label) n from embeddings)
select vec_id, cast(ceil((r - 0.5::double) * 5 / n) as int) fold from x
""")
def stratified_folds(spark, d):
    return validate.folds(load(spark, d, "embeddings"), "vec_id", 5, "label").select("vec_id", "fold")


@query(f"with {SERIES} select event_id, cast(ntile(4) over (partition by ch order by i) as int) fold from s")
def contiguous_folds(spark, d):
    return validate.contiguous_folds(series(spark, d), "i", 4, ["ch"]).select("event_id", "fold")


@query("select a dr, b fe, c cf from (values ('pca'), ('cpca')) x(a) cross join (values (1), (2), (3)) y(b) cross join (values ('linear'), ('quadratic'), ('parzen'), ('knn')) z(c)")
def param_grid(spark, d):
    one = lambda name, values, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    return joins.grid(one("dr", ["pca", "cpca"], "string"), one("fe", [1, 2, 3], "int"), one("cf", ["linear", "quadratic", "parzen", "knn"], "string"))


@query("""
with p as (select l_returnflag dr, l_linestatus fe, case when l_quantity > 25 then 1 else 0 end truth, case when l_discount > 0.05 then 1 else 0 end decision from lineitem)
select dr, fe, count(*) n, round(avg(case when truth = decision then 1.0::double else 0 end), 6) pcorrect, cast(grouping(dr) + grouping(fe) as int) level from p group by cube (dr, fe)
""")
def cv_grid_cube(spark, d):
    p = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("dr"), F.col("l_linestatus").alias("fe"), (F.col("l_quantity") > 25).alias("t"), (F.col("l_discount") > 0.05).alias("q"))
    out = p.cube("dr", "fe").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("t") == F.col("q"), 1.0).otherwise(0.0))).alias("pcorrect"), (F.grouping("dr") + F.grouping("fe")).cast("int").alias("level"))
    return out


# --- regression ---------------------------------------------------------------------------------


@query("""
with x as (select l_quantity a, l_discount b, l_extendedprice y from lineitem), m as (select avg(a) ma, avg(b) mb, avg(y) my, covar_pop(a, a) aa, covar_pop(a, b) ab, covar_pop(b, b) bb, covar_pop(a, y) ay, covar_pop(b, y) byy from x),
c as (select (bb * ay - ab * byy) / (aa * bb - ab * ab) k1, (aa * byy - ab * ay) / (aa * bb - ab * ab) k2, ma, mb, my from m)
select term, round(value, 4) "value" from (select 'l_quantity' term, k1 "value" from c union all select 'l_discount', k2 from c union all select 'const', my - k1 * ma - k2 * mb from c)
""")
def linreg_multi(spark, d):
    b = regress.least_squares(load(spark, d, "lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice"])[:, 0]
    return spark.createDataFrame([(t, round(float(v), 4)) for t, v in zip(["l_quantity", "l_discount", "const"], b)], "term string, value double")


@query("select l_returnflag f, round(regr_slope(l_extendedprice, l_quantity), 6) slope, round(regr_intercept(l_extendedprice, l_quantity), 6) intercept, round(regr_r2(l_extendedprice, l_quantity), 6) cod from lineitem group by 1")
def linreg_affine(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    return load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(r6(F.regr_slope(y, x)).alias("slope"), r6(F.regr_intercept(y, x)).alias("intercept"), r6(F.regr_r2(y, x)).alias("cod"))


LAGS = SERIES + ", a as (select i, v x from s where ch = 'click'), b as (select i, v y from s where ch = 'view'), c as (select g lag, corr(x, y) c, count(*) n from a cross join (select range g from range(-5, 6)) q join b on a.i = b.i + g group by 1)"


def lags(spark, d):
    s = series(spark, d)
    return joins.lag_correlation(s.filter("ch = 'click'").select("i", F.col("v").alias("x")), s.filter("ch = 'view'").select("i", F.col("v").alias("y")), "i", "x", "y", 5)


@query(f"with {LAGS} select cast(lag as int) lag, round(c, 6) c, n from c")
def corr_lag(spark, d):
    return lags(spark, d).select("lag", r6("c").alias("c"), "n")


@query(f"with {LAGS} select cast(arg_max(lag, c) as int) lag, round(max(c), 6) c from c")
def best_lag(spark, d):
    return lags(spark, d).agg(F.max_by("lag", "c").alias("lag"), r6(F.max("c")).alias("c"))


# --- codecs -------------------------------------------------------------------------------------


@query("""
with t as (select o_orderkey k, epoch(o_orderdate)::bigint u from orders)
select k, u + 378691200 tai, cast(floor((u + 378691200) / 60) as bigint) taim, round(u / 86400::double + 719529, 6) datenum, cast(floor((u + 378691200) / 60) as bigint) * 60 - 378691200 back from t
""")
def time_codec(spark, d):
    u = F.col("o_orderdate").cast("timestamp").cast("long")
    taim = timecodec.unix_to_taim(u)
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), timecodec.unix_to_tai(u).alias("tai"), taim.alias("taim"), r6(timecodec.unix_to_datenum(u)).alias("datenum"), timecodec.taim_to_unix(taim).alias("back"))


@query("""
with t as (select o_orderkey k, cast(floor((epoch(o_orderdate)::bigint + 378691200) / 60) as bigint) + o_orderkey % 1440 m, o_orderkey * 37 % 60000 ms from orders)
select k, (((m // 1440) % 32) << 27) + ((m % 1440) << 16) + ms stamp, m taim, ms from t
""")
def tai_pack_unpack(spark, d):
    u = F.col("o_orderdate").cast("timestamp").cast("long")
    t = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (timecodec.unix_to_taim(u) + F.col("o_orderkey") % 1440).alias("m"), (F.col("o_orderkey") * 37 % 60000).alias("ms"))
    t = t.withColumn("stamp", timecodec.pack_stamp(F.col("m"), F.col("ms")))
    return t.withColumn("u", timecodec.unpack_stamp(F.col("stamp"), F.col("m") + 2000)).select("k", "stamp", F.col("u.taim").alias("taim"), F.col("u.ms").alias("ms"))


@query("select o_orderkey k, strftime(o_orderdate, '%y') || upper(to_base(month(o_orderdate) * 100 + day(o_orderdate), 36)) code, cast(o_orderdate as date)::varchar back from orders")
def ncc_date_code(spark, d):
    code = timecodec.date_code(F.col("o_orderdate"))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), code.alias("code"), timecodec.date_of_code(code).cast("string").alias("back"))


@query("""
with t as (select o_orderkey k, o_orderkey * 7 + 0.25::double s from orders)
select k, case when s >= 86400 then cast(floor(s / 86400) as bigint) || 'd ' || printf('%.1f', floor((s % 86400) / 3600 * 10 + 0.5) / 10) || 'h' when s >= 3600 then cast(floor(s / 3600) as bigint) || 'h ' || printf('%.1f', floor((s % 3600) / 60 * 10 + 0.5) / 10) || 'm'
 when s >= 60 then cast(floor(s / 60) as bigint) || 'm ' || printf('%.1f', floor((s % 60) * 10 + 0.5) / 10) || 's' else printf('%.1f', floor(s * 10 + 0.5) / 10) || 's' end txt from t
""")
def duration_text(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), timecodec.duration_text(F.col("o_orderkey") * 7 + 0.25).alias("txt"))


@query("select o_orderkey k, case when b >= 1048576 then cast(b // 1048576 as bigint) || ' MiB' when b >= 1024 then cast(b // 1024 as bigint) || ' KiB' else b || ' B' end txt from (select o_orderkey, case o_orderkey % 3 when 0 then o_orderkey % 1000 when 1 then (o_orderkey % 900 + 1) * 1024 else (o_orderkey % 900 + 1) * 1048576 end b from orders)")
def byte_text(spark, d):
    k = F.col("o_orderkey")
    b = F.when(k % 3 == 0, k % 1000).when(k % 3 == 1, (k % 900 + 1) * 1024).otherwise((k % 900 + 1) * 1048576)
    return load(spark, d, "orders").select(k.alias("k"), timecodec.byte_text(b).alias("txt"))


@query("select page_id, array_to_string(list_filter(regexp_split_to_array(url, '[/:.?&=-]+'), lambda x: x <> ''), '|') parts, string_split(url, '/')[3] host from pages")
def tokens(spark, d):
    return load(spark, d, "pages").select("page_id", textcodec.joined(textcodec.tokens(F.col("url"), "/:.?&=-"), "|").alias("parts"), textcodec.token(F.col("url"), "/", 3).alias("host"))


@query("select event_id, (props->>'$.k')::double n, (props->>'$.k')::double + 1 m from events")
def fields(spark, d):
    """Written-out fields parsed into a map."""
    s = F.concat(F.lit("aa="), F.get_json_object("props", "$.k"), F.lit(", bb="), (F.get_json_object("props", "$.k").cast("int") + 1).cast("string"), F.lit(";"))
    return load(spark, d, "events").select("event_id", textcodec.fields(s).alias("f")).select("event_id", F.col("f")["aa"].alias("n"), F.col("f")["bb"].alias("m"))


@query(r"select page_id, regexp_replace(regexp_replace(trim(url || ' *x  y '), '[^A-Za-z0-9 ._,=+()\[\]{}@#$%&~!^''`;-]', '=', 'g'), ' +', '+', 'g') s, not regexp_matches(url, '[^A-Za-z0-9 ._,=+()\[\]{}@#$%&~!^''`;-]') legal from pages")
def sanitize(spark, d):
    return load(spark, d, "pages").select("page_id", textcodec.sanitized(F.concat("url", F.lit(" *x  y "))).alias("s"), textcodec.legal_filename(F.col("url")).alias("legal"))


@query("select doc_id, md5(text) md5, sha1(text) sha1, sha256(text) sha256 from documents")
def digests(spark, d):
    t = F.col("text").cast("binary")
    return load(spark, d, "documents").select("doc_id", F.md5(t).alias("md5"), F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"))


@query("select p_partkey k, base64(encode(p_name)) b64, p_name back, lower(hex(p_name)) hx, p_name unhexed from part")
def base64_roundtrip(spark, d):
    b = F.base64(F.col("p_name").cast("binary"))
    h = F.lower(F.hex("p_name"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("k"), b.alias("b64"), F.unbase64(b).cast("string").alias("back"), h.alias("hx"), textcodec.hex_to_text(h).alias("unhexed"))


@query()
def crc32_name(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("k"), textcodec.crc32_hex(F.col("p_name")).alias("crc"), textcodec.hashed_filename(F.col("p_name")).alias("file"))


@query("select o_orderkey k, case when o_totalprice = floor(o_totalprice) then format('{:,}', cast(o_totalprice as bigint)) else rtrim(rtrim(format('{:,}', cast(floor(o_totalprice) as bigint)) || '.' || lpad(cast(round((o_totalprice - floor(o_totalprice)) * 1000) as bigint)::varchar, 3, '0'), '0'), '.') end txt, lpad(o_orderkey::varchar, 12, ' ') padded from orders")
def number_text(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), textcodec.thousands(F.col("o_totalprice")).alias("txt"), textcodec.padded_left(F.col("o_orderkey").cast("string"), 12).alias("padded"))


@query("select p_partkey k, p_retailprice::float::double x from part")
def float_bits(spark, d):
    """Numbers written as 32 bits and read again."""
    bits = textcodec.bits_of_float(F.col("p_retailprice"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("k"), textcodec.float_of_bits(bits).alias("x"))


@query(r"select doc_id, md5(regexp_replace(regexp_replace(text, '\b(\d{1,2})/(\d{1,2})/(\d{4})\b', '00/00/\3', 'g'), '\b\d{6,10}\b', '88888888', 'g')) h from documents where text not like '%Name: %'")
def mask_pii(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(textcodec.masked_patient(F.col("text")).cast("binary")).alias("h"))


# --- channels and sets --------------------------------------------------------------------------


@query("with c as (select p_type t, min(p_partkey) f from part group by 1), w as (select distinct upper(p_type) w from part union all select 'NONE') select w.w \"name\", cast(coalesce(c.f, 0) as bigint) \"first\" from w left join c on lower(w.w) = lower(c.t)")
def chan_lookup(spark, d):
    p = load(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("pos"))
    wanted = p.select(F.upper("name").alias("name")).distinct().unionByName(spark.createDataFrame([("NONE",)], "name string"))
    return channels.first_positions(wanted, p).select("name", F.col("first").cast("long").alias("first"))


@query("select cast(n as int) pattern_no, p_partkey pos from part join (values (1, '(?i)brass'), (2, '(?i)^promo')) t(n, r) on regexp_matches(p_type, r)")
def chan_regex(spark, d):
    p = load(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("pos"))
    return channels.matching(p, ["brass", "^promo"]).select("pattern_no", "pos")


@query("select p_partkey pos from part where upper(p_type) not in (select upper(p_type) from part where p_partkey % 50 = 0)")
def drop_channels(spark, d):
    p = load(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("pos"))
    return channels.without(p, p.filter("pos % 50 = 0").select(F.lower("name").alias("name"))).select("pos")


@query("select p_partkey pos, lower(p_type) in (select lower(p_type) from part where p_partkey % 50 = 0) wanted from part")
def chan_mask(spark, d):
    p = load(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("pos"))
    return channels.mask(p, p.filter("pos % 50 = 0").select("name")).select("pos", "wanted")


@query("""
with f as (select 'Cz Fp1 Fpz Fp2 F7 F3 Fz F4 F8 FC5 FC1 FC2 FC6 M1 T7 C3 C4 T8 M2 CP5 CP1 CP2 CP6 P7 P3 Pz P4 P8 POz O1 Oz O2 D1' a, 'Cz AF7 AF3 AFz AF4 AF8 F5 F1 F2 F6 FC3 FCz FC4 C5 C1 C2 C6 CP3 CPz CP4 P5 P1 P2 P6 PO3 PO4 FT7 FT8 TP7 TP8 PO7 PO8 D2' b, (select string_agg('A' || n, ' ' order by n) from range(1, 33) t(n)) || ' D1' c, (select string_agg('B' || n, ' ' order by n) from range(1, 33) t(n)) || ' D2' e),
m as (select 'amplifier 1' montage, a || ' DIAG' n from f union all select 'amplifier 2', b || ' DIAG' from f union all select 'both amplifiers', a || ' ' || b || ' DIAG' from f
 union all select 'amplifier 1, numbered', c || ' DIAG' from f union all select 'amplifier 2, numbered', e || ' DIAG' from f union all select 'both amplifiers, numbered', c || ' ' || e || ' DIAG' from f
 union all select 'cap (32)', 'FP1 FZ F3 F7 FT9 FC5 FC1 C3 T7 M1 CP5 CP1 PZ P3 P7 O1 OZ O2 P4 P8 M2 CP6 CP2 CZ C4 T8 FT10 FC6 FC2 F4 F8 FP2 D1 DIAG'
 union all select 'combinatorial nomenclature', 'Fp1 Fpz Fp2 AF7 AF3 AFz AF4 AF8 F9 F7 F5 F3 F1 Fz F2 F4 F6 F8 F10 FT9 FT7 FC5 FC3 FC1 FCz FC2 FC4 FC6 FT8 FT10 T7 C5 C3 C1 Cz C2 C4 C6 T8 '
 || 'TP9 TP7 CP5 CP3 CP1 CPz CP2 CP4 CP6 TP8 TP10 P9 P7 P5 P3 P1 Pz P2 P4 P6 P8 P10 PO7 PO3 POz PO4 PO8 O1 Oz O2'),
x as (select montage, unnest(string_split(n, ' ')) channel, unnest(range(1, len(string_split(n, ' ')) + 1)) p from m) select montage, cast(p as int) "position", channel from x
""")
def montage_rows(spark, d):
    return channels.montage_table(spark)


@query(f"with {SERIES}, e as (select ch, i, v, cast(floor((i - 1) / 50) + 1 as bigint) ep from s), f as (select ch, ep from e group by 1, 2 having count(*) = 50) select e.ch, ep epoch_id, i idx, round(v, 6) v from e join f using (ch, ep)")
def stack_epochs(spark, d):
    """Epochs of 50 samples as arrays, laid end to end again."""
    s = series(spark, d).withColumn("n", F.max("i").over(Window.partitionBy("ch"))).filter("i <= n - n % 50").select("ch", F.col("i").alias("idx"), F.col("v").alias("value"))
    return channels.stacked(channels.unstacked(s, ["ch"], 50), ["ch"]).select("ch", "epoch_id", "idx", r6("value").alias("v"))


@query(f"with {SERIES}, x as (select ch, i, event_id, count(*) over (partition by ch) n from s) select event_id, cast(case when i <= floor(n / 2 + 0.5::double) then 2 * i - 1 else 2 * (i - floor(n / 2 + 0.5::double)) end as bigint) place from x")
def interleave_halves(spark, d):
    return channels.interleaved(series(spark, d), "i", ["ch"]).select("event_id", "place")


@query("select event_id, cast(dense_rank() over (order by event_type) as bigint) label_no from events")
def label_enum(spark, d):
    return channels.label_numbers(load(spark, d, "events"), "event_type").select("event_id", "label_no")


@query("select vec_id from embeddings where label in (select distinct quality from labels)")
def label_semi_filter(spark, d):
    e, q = load(spark, d, "embeddings").select("vec_id", "label"), load(spark, d, "labels").select(F.col("quality").alias("label"))
    return channels.mutual_labels(e, q, "label")[0].select("vec_id")


@query("with a as (select distinct o_custkey k from orders where o_orderkey % 2 = 0), b as (select distinct o_custkey k from orders where o_orderkey % 3 = 0) select 'either' s, k from ((select k from a except select k from b) union all (select k from b except select k from a)) union all select 'both', k from (select k from a intersect select k from b)")
def set_ops(spark, d):
    o = load(spark, d, "orders")
    a, b = (o.filter(f"o_orderkey % {m} = 0").select(F.col("o_custkey").alias("k")).distinct() for m in (2, 3))
    return channels.symmetric_difference(a, b).select(F.lit("either").alias("s"), "k").unionByName(a.intersect(b).select(F.lit("both").alias("s"), "k"))


@query("with p as (select c_nationkey k, sum(c_acctbal) v from customer group by 1), t as (select max(abs(v)) m from p) select n_nationkey k, round(coalesce(v, 0) / m, 6) scaled from nation left join p on k = n_nationkey cross join t")
def topo_fill(spark, d):
    """All customers."""
    c = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("v"))
    return channels.zero_filled(c, load(spark, d, "nation").select(F.col("n_nationkey").alias("k")), "k", "v").select("k", r6("scaled").alias("scaled"))


# --- geometry -----------------------------------------------------------------------------------

POINTS = "p as (select c_custkey k, c_custkey % 17 / 5.0::double a, c_custkey % 13 / 9.0::double b, c_custkey % 11 / 4.0::double c, c_custkey % 7 / 5.0::double e from customer)"


def points(spark, d):
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(k.alias("k"), (k % 17 / 5).alias("a"), (k % 13 / 9).alias("b"), (k % 11 / 4).alias("c"), (k % 7 / 5).alias("e"))


@query(f"with {POINTS} select k, round(2.5::double * 2 * asin(least(1, sqrt(sin((b - e) / 2) ** 2 + cos(b) * cos(e) * sin((a - c) / 2) ** 2))), 5) dist from p")
def great_circle(spark, d):
    return points(spark, d).select("k", F.round(geometry.great_circle(F.col("a"), F.col("b"), F.col("c"), F.col("e"), 2.5), 5).alias("dist"))


@query(f"with {POINTS}, q as (select k, a x1, b y1, c + 4 x2, e y2, 1.0::double x3, -3 - a y3 from p), m as (select *, 2 * ((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) dd, (x2 - x1) ** 2 + (y2 - y1) ** 2 b2, (x3 - x1) ** 2 + (y3 - y1) ** 2 c2 from q), z as (select k, ((y3 - y1) * b2 - (y2 - y1) * c2) / dd ux, ((x2 - x1) * c2 - (x3 - x1) * b2) / dd uy, x1, y1 from m where dd <> 0) select k, round(x1 + ux, 5) x, round(y1 + uy, 5) y, round(sqrt(ux * ux + uy * uy), 5) r from z")
def circle_3pt(spark, d):
    c = geometry.circle_through(F.col("a"), F.col("b"), F.col("c") + 4, F.col("e"), F.lit(1.0), -3 - F.col("a"))
    return points(spark, d).select("k", c.alias("c")).filter("c is not null").select("k", *[F.round(f"c.{x}", 5).alias(x) for x in "xyr"])


#: The quadratic's parameters from the definition: w = p1 - p3, u = p2 - p1, v = p4 - p3; a t for an s, an s for a t, and the five candidates.
SEGMENTS = f"""{POINTS}, g as (select k, 1.0::double a, (c - a) + 0.0::double b, (c - a) ** 2 + (e - b) ** 2 + 1 cc, 0 - a d, -(a * (c - a)) - b * (e - b) ee, a wa, b wb, c - a va, e - b vb from p),
q as (select *, a * cc - b * b det from g), m as (select *, case when det > 1e-12 then (b * ee - cc * d) / det end s0, case when det > 1e-12 then (a * ee - b * d) / det end t0 from q),
x as (select *, unnest([{{s: 0.0, t: greatest(0, least(1, ee / cc))}}, {{s: 1.0, t: greatest(0, least(1, (b + ee) / cc))}}, {{s: greatest(0, least(1, -d / a)), t: 0.0}}, {{s: greatest(0, least(1, (b - d) / a)), t: 1.0}}, {{s: s0, t: t0}}]) z from m),
y as (select k, sqrt((-wa + z.s - z.t * va) ** 2 + (-wb - z.t * vb) ** 2 + (z.t) ** 2) f from x where z.s between 0 and 1 and z.t between 0 and 1)"""


@query(f"with {SEGMENTS} select k, round(min(f), 6) dist from y group by k")
def segment_distance(spark, d):
    zero, one = F.lit(0.0), F.lit(1.0)
    dist = geometry.segment_distance((zero, zero, zero), (one, zero, F.col("a") * 0), (F.col("a"), F.col("b"), zero), (F.col("c"), F.col("e"), one))
    return points(spark, d).select("k", r6(dist).alias("dist"))


@query("select e \"name\", cast(h as int) h, cast(v as int) v from (values ('Fz', 0, 2), ('C3', -2, 0), ('PO8', 4, -3), ('FC1', -1, 1), ('Oz', 0, -4), ('T8', 4, 0), ('A1', -6, 0), ('M2', 6, -1), ('FT10', 5, 1), ('Nz', 0, 5)) t(e, h, v)")
def grid_coord(spark, d):
    n = spark.createDataFrame([(x,) for x in ("Fz", "C3", "PO8", "FC1", "Oz", "T8", "A1", "M2", "FT10", "Nz", "??")], "name string")
    return n.select("name", geometry.grid_position(F.col("name")).alias("g")).filter("g is not null").select("name", "g.h", "g.v")


@query("select c_custkey k, cast(greatest(0, least(20, floor((c_acctbal - 0) / 500 + 0.5::double))) + 1 as int) tick from customer")
def nearest_tick(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k"), geometry.nearest_tick(F.col("c_acctbal"), 0.0, 500.0, 10000.0).alias("tick"))


# --- models (rows only: eigenvectors, iterations and recursions have no SQL) ----------------------


def vectors(spark, d, dims: int = 8):
    return load(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, dims), lambda v: v.cast("double")).alias("x"))


def _projection(spark, d, transform):
    e = vectors(spark, d)
    t = transform(linalg.statistics(e, "x", 8, "label"))
    return e.select("vec_id", F.posexplode(linalg.projected(F.col("x"), t)).alias("k", "v")).select("vec_id", "k", r6("v").alias("v"))


@query()
def pca_project(spark, d):
    return _projection(spark, d, lambda s: linalg.pca(s, 0.9))


@query()
def lda_project(spark, d):
    return _projection(spark, d, lambda s: linalg.lda(s, 3))


@query()
def aida_project(spark, d):
    return _projection(spark, d, lambda s: linalg.aida(s, 3))


@query()
def ida_project(spark, d):
    return _projection(spark, d, lambda s: linalg.ida(s, 2))


@query()
def whiten(spark, d):
    return _projection(spark, d, linalg.whitening)


@query()
def fkt(spark, d):
    """Fukunaga-Koontz directions of even against odd labels: two from either end."""
    e = vectors(spark, d).withColumn("side", F.col("label") % 2)
    t, lam = linalg.fkt(linalg.statistics(e, "x", 8, "side"), 2, 2)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(lam)], "k int, eigenvalue double")


@query()
def outlier_distances(spark, d):
    e = vectors(spark, d)
    out = linalg.outlier_distances(e, "x", linalg.statistics(e, "x", 8), 4)
    return out.select("vec_id", r6("score_distance").alias("score"), r6("orthogonal_distance").alias("orthogonal"))


GRID = [("cpca", 0.9, "aida", 3, "quadratic"), ("cpca", 0.9, "lda", 1, "linear"), ("pca", 0.95, "lda", 3, "linear"), ("none", 0, "none", 8, "quadratic")]


@query()
def cpca_cv(spark, d):
    """Cross-validated share of right decisions per grid cell, ranked."""
    p = validate.cross_validated(vectors(spark, d), "vec_id", "label", "x", 8, 3, GRID)
    scores = validate.correct(validate.confusion(p, ["cell", "run"]), ["cell"])
    return validate.ranked(scores).select("cell", r6("pcorrect").alias("pcorrect"), "rank")


def channel_blocks(spark, d):
    return dsp.blocks(series(spark, d), ["ch"], "i", "v")


@query()
def welch_bandpower(spark, d):
    return dsp.power_rows(channel_blocks(spark, d), ["ch"], 128.0, BANDS).select("ch", "lo", "hi", r6("power").alias("power"))


@query()
def butter_bandpass(spark, d):
    """Zero-phase band-pass of every channel."""
    out = dsp.mapped(channel_blocks(spark, d), lambda x: dsp.frequency_filter(x, 128.0, [8.0, 12.0], "band", "butter", 4))
    return dsp.unblocked(out, ["ch"]).select("ch", "idx", r6("value").alias("v"))


@query()
def notch_filtered(spark, d):
    out = dsp.mapped(channel_blocks(spark, d), lambda x: dsp.notch_bank(x, 512.0, 60.0))
    return dsp.unblocked(out, ["ch"]).select("ch", "idx", r6("value").alias("v"))


@query()
def dct_codec(spark, d):
    """Signals compressed to half their coefficients and read back."""
    out = dsp.mapped(channel_blocks(spark, d), lambda x: dsp.dct_decompress(dsp.dct_compress(x, 0.5)))
    return dsp.unblocked(out, ["ch"]).select("ch", "idx", r6("value").alias("v"))


@query()
def kde1d(spark, d):
    """Diffusion bandwidth and density of one dimension per label (one task each)."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        width, grid, density = classify.kde(part["v"].to_numpy(), 256)
        return pd.DataFrame({"label": part["label"].iloc[0], "width": round(width, 6), "at": grid[::16].round(6), "density": density[::16].round(6)})

    e = load(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("v"))
    return e.groupBy("label").applyInPandas(run, "label int, width double, at double, density double")


@query()
def surrogate_r2(spark, d):
    """Both channels whole, as far as both go; they are collected."""
    s = series(spark, d).filter("ch in ('click', 'view')").groupBy("i").pivot("ch", ["click", "view"]).agg(F.first("v")).dropna().orderBy("i").toPandas()
    return regress.surrogate_r2(spark, s[["click"]].to_numpy(), s["view"].to_numpy(), 200).select("draw", r6("r2").alias("r2"))


@query()
def robust_regression(spark, d):
    b = regress.robust(load(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(t, round(float(v), 4)) for t, v in zip(["l_quantity", "const"], b)], "term string, value double")


# --- streams: events replayed by a file source until all is read ------------------------------------


def replayed(spark, d):
    from pyspark.sql.types import StructType

    schema: StructType = load(spark, d, "events").schema
    # a pattern: the path may be one file
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream, mode: str):
    """Runs a stream over what is there, and returns the rows of its result: each batch is written into the shared folder, and of a
    complete result the last batch counts. Nothing passes through the driver."""
    from sigloom.streaming import live

    return live.drained(stream, mode)


@query("""
select event_type ch, time_bucket(interval '6 hours', ts) w, count(*) n, round(avg(value), 6) mean, round(max(value) - min(value), 6) p2p from events group by 1, 2
""")
def stream_tumbling(spark, d):
    from sigloom.streaming import live

    out = drained(live.tumbling(replayed(spark, d).withColumnRenamed("event_type", "ch"), "ts", "6 hours", ["ch"]), "complete")
    return out.select("ch", F.col("window.start").cast("timestamp_ntz").alias("w"), "n", r6("mean").alias("mean"), r6("p2p").alias("p2p"))


@query("""
with e as (select user_id u, ts, value, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end brk from events), g as (select *, sum(brk) over (partition by u order by ts rows unbounded preceding) k from e)
select u, min(ts) a, count(*) n, round(sum(value), 6) total from g group by u, k
""")
def session_windows(spark, d):
    from sigloom.streaming import live

    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "u")
    return live.sessions(e, "ts", "6 hours", ["u"]).select("u", F.col("session_window.start").cast("timestamp_ntz").alias("a"), "n", r6("total").alias("total"))


@query("""
with recursive g as (select tan(pi() * 8 / 128) k, tan(pi() * 1.5::double / 128) q), c as (select k * k / (1 + sqrt(2.0::double) * k + k * k) b, 2 * (k * k - 1) / (1 + sqrt(2.0::double) * k + k * k) a1, (1 - sqrt(2.0::double) * k + k * k) / (1 + sqrt(2.0::double) * k + k * k) a2, q / (1 + q) e, (q - 1) / (q + 1) f from g),
s as materialized (select event_type ch, event_id n, value v, row_number() over (partition by event_type order by event_id) i from events where event_id % 13 <> 0),
r as (select ch, i, n, b * v y, 2 * b * v - a1 * (b * v) z1, b * v - a2 * (b * v) z2, e * (b * v) ** 2 p, e * (b * v) ** 2 - f * (e * (b * v) ** 2) w from s cross join c where i = 1
 union all select ch, i, n, y, 2 * b * v - a1 * y + z2, b * v - a2 * y, e * y * y + w, e * y * y - f * (e * y * y + w) from (select s.ch, s.i, s.n, s.v, c.*, c.b * s.v + r.z1 y, r.z2, r.w from r join s on s.ch = r.ch and s.i = r.i + 1 cross join c))
select ch, n sample_no, round(y, 5) filtered, round(p, 4) envelope from r
""")
def stream_iir(spark, d):
    """The stateful low-pass of each channel's valid samples, and the envelope of what it passes."""
    from sigloom.streaming import live

    s = replayed(spark, d).select(F.col("event_type").alias("channel"), F.col("event_id").alias("sample_no"), F.when(F.col("event_id") % 13 == 0, 0).otherwise(2).alias("status"), "value")
    out = drained(live.filtered(s, dsp.butterworth(2, 8.0, 128.0)), "append")
    return out.select(F.col("channel").alias("ch"), "sample_no", F.round("filtered", 5).alias("filtered"), F.round("envelope", 4).alias("envelope"))


@query("""
with s as (select event_type ch, event_id, lag(event_id) over (partition by event_type order by event_id) p from events) select ch, cast(sum(case when event_id - p not in (1, -63) then 1 else 0 end) as bigint) lost, count(*) n from s group by ch
""")
def packet_loss(spark, d):
    from sigloom.streaming import live

    s = load(spark, d, "events").select(F.col("event_type").alias("ch"), F.col("event_id").alias("diag"), "event_id")
    return live.packet_loss(s, ["ch"], "event_id").select("ch", F.col("lost").cast("long").alias("lost"), "n")

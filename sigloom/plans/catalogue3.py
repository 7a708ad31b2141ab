"""The third part of the catalogue: clocks, channel tables, interval extras, live steps, and models in two dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions import geometry, textcodec, timecodec
from sigloom.operators import channels, classify, detect, dsp, intervals, linalg, stats
from sigloom.plans.catalogue import SERIES, load, query, r6, series
from sigloom.plans.catalogue2 import POINTS, QDA, points
from sigloom.streaming import live

# --- clocks -------------------------------------------------------------------------------------

UNIX = "u as (select o_orderkey k, epoch(o_orderdate) + o_orderkey % 86400 + (o_orderkey % 1000) / 1000.0::double t from orders)"


def unix(spark, d):
    k = F.col("o_orderkey")
    day = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    return load(spark, d, "orders").select(k.alias("k"), (day + k % 86400 + (k % 1000) / 1000).alias("t"))


@query(f"with {UNIX} select k, strftime(make_timestamp(cast(round(t * 1000000) as bigint)), '%Y-%m-%d %H:%M:%S') \"at\", round(t, 3) back from u")
def unixtime_datetime(spark, d):
    at = timecodec.unix_to_datetime(F.col("t"))
    return unix(spark, d).select("k", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), F.round(timecodec.datetime_to_unix(at), 3).alias("back"))


@query(f"with {UNIX}, m as (select k, cast(floor((t + 378691200) / 60) as bigint) m from u) select k, m, round((m * 60 - 378691200) / 86400.0::double + 719529, 6) n, round((m * 60 - 378691200) / 86400.0::double + 719529 - 5.5::double / 24, 6) shifted, m back from m")
def taim_datenum(spark, d):
    u = unix(spark, d).withColumn("m", timecodec.unix_to_taim(F.col("t")))
    n = timecodec.taim_to_datenum(F.col("m"))
    # day numbers of whole minutes are off by less than a millisecond
    return u.select("k", "m", r6(n).alias("n"), r6(timecodec.taim_to_datenum(F.col("m"), -5.5)).alias("shifted"), timecodec.datenum_to_taim(n + 1e-8).alias("back"))


@query(f"with {UNIX}, m as (select k, t, cast(floor((t + 378691200) / 60) as bigint) m, cast(floor(t * 1000) as bigint) % 60000 ms from u) select k, round(m * 60.0::double + ms / 1000.0::double - 378691200, 3) t, ms from m")
def taim_text(spark, d):
    """Minutes and milliseconds written as one text and read again."""
    u = unix(spark, d).withColumn("ms", timecodec.tai_millisecond(F.col("t")))
    text = F.concat(timecodec.unix_to_taim(F.col("t")).cast("string"), F.lit(":"), F.col("ms").cast("string"))
    return u.select("k", F.round(timecodec.taim_text_to_unix(text), 3).alias("t"), "ms")


@query("select o_orderkey k, round((36526 + o_orderkey % 20000 + (o_orderkey % 8) / 8.0::double) * 86400 - 2209161600, 3) t from orders")
def ole_date(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select(k.alias("k"), F.round(timecodec.ole_to_unix(36526 + k % 20000 + (k % 8) / 8), 3).alias("t"))


@query("select k, cast(h as double) h from (select o_orderkey k, case o_orderkey % 3 when 0 then 0 when 1 then 5.5 else -3 end h from orders)")
def tz_offset(spark, d):
    k = F.col("o_orderkey")
    zone = F.when(k % 3 == 0, "UTC").when(k % 3 == 1, "+05:30").otherwise("-03:00")
    return load(spark, d, "orders").select(k.alias("k"), timecodec.tz_offset_hours(zone, F.col("o_orderdate").cast("timestamp")).alias("h"))


# --- channel tables -----------------------------------------------------------------------------


@query("select c_custkey k, case c_custkey % 5 when 0 then c_custkey when 1 then c_custkey when 2 then c_custkey else 0 end n from customer")
def numeric_channel(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 5 == 0, "Grid").when(k % 5 == 1, "MG").when(k % 5 == 2, "G").when(k % 5 == 3, "Fp").otherwise("x"), k.cast("string"))
    return load(spark, d, "customer").select(k.alias("k"), textcodec.numeric_channel(name).cast("long").alias("n"))


@query("select c_custkey k, case c_custkey % 6 when 0 then 'FTT' || c_custkey || 'h' when 1 then 'FT7' when 2 then 'TP8' when 3 then 'TP9' when 4 then 'TP10' else 'C3' end \"name\" from customer")
def electrode_names(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, F.concat(F.lit("FCC"), k.cast("string"), F.lit("h"))).when(k % 6 == 1, "FC7").when(k % 6 == 2, "CP8").when(k % 6 == 3, "M1").when(k % 6 == 4, "M2").otherwise("C3")
    return load(spark, d, "customer").select(k.alias("k"), textcodec.standard_electrode(name).alias("name"))


@query("""
with x as (select p_partkey + 1 pos, p_name nm from part) select pos "position", case when pos % 3 = 1 then (case when pos <= 32 then 'A' || pos else 'B' || (pos - 32) end) else regexp_extract(nm, '([A-Za-z0-9]+)', 1) end "name" from x where pos <= 64
""")
def amplifier_table(spark, d):
    """A two-amplifier list (64 places, as many as there are) with every third entry blank."""
    first = load(spark, d, "part").filter("p_partkey < 64").orderBy("p_partkey").select("p_partkey", "p_name").collect()
    out = channels.amplifier_channels(spark, ["" if r["p_partkey"] % 3 == 0 else r["p_name"] for r in first])
    return out.select(F.col("position").cast("long").alias("position"), "name")


@query("""
with p as (select c_custkey k, c_custkey % 40 x, c_custkey % 37 y from customer), o as (select x, y, case when count(*) = 1 then min(k) end pos from p group by 1, 2), w as (select s_suppkey k, s_suppkey % 40 x, s_suppkey % 37 y from supplier)
select w.k, o.pos from w left join o using (x, y)
""")
def find_coordinates(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    places = load(spark, d, "customer").select(c.alias("pos"), (c % 40).alias("x"), (c % 37).alias("y"))
    return channels.found_coordinates(load(spark, d, "supplier").select(s.alias("k"), (s % 40).alias("x"), (s % 37).alias("y")), places).select("k", "pos")


@query(f"with {SERIES}, e as (select ch, cast(floor((i - 1) / 12) as bigint) ep, (i - 1) % 12 p, v from s), f as (select ch, ep from e group by 1, 2 having count(*) = 12) select e.ch, e.ep, cast((p % 4) * 3 + p // 4 as bigint) place, round(v, 6) v from e join f using (ch, ep)")
def trial_flatten(spark, d):
    """Trials of three channels by four samples as one row of features, channels fastest."""
    e = series(spark, d).withColumn("ep", F.floor((F.col("i") - 1) / 12).cast("long"))
    b = dsp.blocks(e, ["ch", "ep"], "i", "v").filter("size(values) = 12")
    trial = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.slice("values", c * 4 + 1, F.lit(4)))
    return b.select("ch", "ep", F.posexplode(channels.flattened(trial)).alias("place", "v")).select("ch", "ep", F.col("place").cast("long").alias("place"), r6("v").alias("v"))


@query(f"with {SERIES} select ch, i, round(v, 6) v from s where ch in ('click', 'view') and i between 20 and 90")
def channel_subset(spark, d):
    return channels.subset(series(spark, d), ["click", "view"], 20, 90).select("ch", "i", r6("v").alias("v"))


@query("with t as (select vec_id, label from embeddings where vec_id % 2 = 0), s as (select vec_id, label from embeddings where vec_id % 2 = 1) select 'train' side, vec_id from t where label in (1, 3, 5, 11) and label in (select label from s) union all select 'test', vec_id from s where label in (1, 3, 5, 11) and label in (select label from t)")
def label_whitelist(spark, d):
    """Even ids train and odd ones test; of the wanted labels those that both sides have."""
    e = load(spark, d, "embeddings").select("vec_id", "label")
    train, test = channels.whitelisted(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "label", [1, 3, 5, 11])
    return train.select(F.lit("train").alias("side"), "vec_id").unionByName(test.select(F.lit("test").alias("side"), "vec_id"))


@query("select page_id, list_transform(string_split(url, '/'), lambda x: lower(x)) = string_split(url, '/') same from pages")
def cells_equal(spark, d):
    a = F.split("url", "/")
    return load(spark, d, "pages").select("page_id", channels.equal_cells(F.transform(a, F.lower), a).alias("same"))


# --- intervals ----------------------------------------------------------------------------------

PULSES = "b as (select o_custkey k, min(o_orderkey) s, max(o_orderkey) e from orders group by 1)"


@query(f"with {PULSES}, q as (select b.k, b.s, b.e, count(*) n from b join lineitem l on l.l_orderkey between b.s and b.e and l.l_suppkey % 10 = b.k % 10 group by 1, 2, 3) select k, s \"start\", e \"end\", n held from q where n >= 3")
def bounds_holding(spark, d):
    """Envelopes (a customer's first to last order) that hold three pulses of their group or more."""
    key = (F.col("k") % 10).alias("g")
    b = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("start"), F.max("o_orderkey").alias("end"))
    pulses = load(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), F.col("l_orderkey").alias("at"))
    held = intervals.holding(b.select("*", key).select("g", "k", "start", "end"), pulses, ["g"], "at", 3)
    return b.join(held.select("start", "end", "g", "held"), ["start", "end"]).filter(F.col("k") % 10 == F.col("g")).select("k", "start", "end", "held").distinct()


@query("""
with s as (select range idx from range(1, 501)), b as (select s_suppkey k, s_suppkey * 0.5::double a, s_suppkey * 0.5::double + 0.3::double z from supplier where s_suppkey <= 40),
x as (select k, greatest(1, round(a * 10 + 1)) a, least(500, round(z * 10 + 1) - 1) z from b) select idx, cast(coalesce(max(k), 0) as bigint) "value" from s left join x on idx between a and z group by idx
""")
def put_bounds_seconds(spark, d):
    """A valued signal painted from bounds in seconds at ten samples a second; the later bound wins."""
    s = F.col("s_suppkey")
    b = load(spark, d, "supplier").filter("s_suppkey <= 40").select((s * 0.5).alias("start"), (s * 0.5 + 0.3).alias("end"), s.alias("v"), s.alias("ord"))
    return intervals.put_bounds_seconds(b, 10.0, 500, "v").select("idx", F.col("value").cast("long").alias("value"))


@query(f"""
with {SERIES}, p as (select ch, i x, v y from s where event_id % 11 = 0),
r as (select s.ch, s.i, s.v, (select max(x) from p where p.ch = s.ch and p.x <= s.i) a, (select min(x) from p where p.ch = s.ch and p.x >= s.i) b from s),
t as (select r.ch, r.i, r.v, r.a, r.b, pa.y ya, pb.y yb from r left join p pa on pa.ch = r.ch and pa.x = r.a left join p pb on pb.ch = r.ch and pb.x = r.b),
l as (select ch, i, v, case when a is null then yb when b is null then ya when a = b then ya else ya + (i - a) * (yb - ya) / (b - a) end thr from t)
select ch, i, round(thr, 6) thr, v > thr "over" from l
""")
def threshold_line(spark, d):
    """A threshold drawn through points set by hand, and the samples over it."""
    s = series(spark, d)
    p = s.filter("event_id % 11 = 0").select("ch", F.col("i").alias("at"), F.col("v").alias("level"))
    out = intervals.threshold_line(s.select("ch", "i", "v"), p, ["ch"], "i")
    return out.select("ch", "i", r6("thr").alias("thr"), (F.col("v") > F.col("thr")).alias("over"))


@query(f"""
with {SERIES}, o as (select ch, i, i - row_number() over (partition by ch order by i) g from s where v > 60), b as (select ch, min(i) a, max(i) z from o group by ch, g),
w as (select ch, (z - a + 1)::double d, (a - lag(a) over (partition by ch order by a))::double p from b), m as (select ch, median(d) md, median(p) mp from w group by ch)
select w.ch, round(any_value(md), 6) duration_median, round(1.4826::double * median(abs(d - md)), 6) duration_dev, round(any_value(mp), 6) gap_median, round(1.4826::double * median(abs(p - mp)), 6) gap_dev from w join m using (ch) group by w.ch
""")
def duration_summary(spark, d):
    found = intervals.runs(series(spark, d), ["ch"], "i", F.col("v") > 60)
    out = detect.duration_summary(found, ["ch"])
    return out.select("ch", *[r6(c).alias(c) for c in ("duration_median", "duration_dev", "gap_median", "gap_dev")])


# --- live steps, as batches ---------------------------------------------------------------------


@query(f"with {SERIES}, f as (select ch, row_number() over (order by ch) / 1000.0::double f from (select distinct ch from s)) select ch, i, round(v * f, 9) volts from s join f using (ch)")
def unit_scaling(spark, d):
    s = series(spark, d)
    names = channels.label_numbers(s.select("ch").distinct(), "ch")
    out = live.scaled(s, names.select("ch", (F.col("label_no") / 1000).alias("factor")), "ch", "v")
    return out.select("ch", "i", F.round("volts", 9).alias("volts"))


WINDOWS = SERIES + ", w as (select ch, (i - 1) // 128 blk, i, v from s)"


@query(f"with {WINDOWS} select ch, i, round(v - median(v) over (partition by ch, blk), 6) v from w")
def online_centring(spark, d):
    s = series(spark, d).withColumn("blk", F.floor((F.col("i") - 1) / 128))
    return live.centred(s, ["ch", "blk"], "v").select("ch", "i", r6("centred").alias("v"))


@query(f"with {WINDOWS}, z as (select *, avg(v) over (partition by ch, blk) m, stddev_samp(v) over (partition by ch, blk) sd from w) select ch, i, round((v - m) / case when sd > 0 then sd else 1 end, 6) z from z")
def online_zscore(spark, d):
    s = series(spark, d).withColumn("blk", F.floor((F.col("i") - 1) / 128))
    return live.centred(s, ["ch", "blk"], "v", spread=True).select("ch", "i", r6("centred").alias("z"))


@query("with t as (select user_id u, ts, lag(ts) over (partition by user_id order by ts) p from events), g as (select u, p, ts, round(epoch(ts) - epoch(p), 6) s from t) select u, cast(s as double) \"seconds\", s > 172800 stopped from g where s > 43200")
def trigger_gaps(spark, d):
    """Users who were silent for half a day and more, and those whose silence would have ended a recording."""
    t = load(spark, d, "events").select(F.col("user_id").alias("u"), "ts")
    return live.gaps(t, ["u"], "ts", 43200.0, 172800.0).select("u", F.round("seconds", 6).alias("seconds"), "stopped")


P2P = WINDOWS + ", p as (select ch, blk, max(v) - min(v) p2p, max(v) <> min(v) c from w group by 1, 2)"


def windows_p2p(spark, d):
    s = series(spark, d).withColumn("blk", F.floor((F.col("i") - 1) / 128).cast("long"))
    return s.groupBy("ch", "blk").agg((F.max("v") - F.min("v")).alias("p2p"), (F.max("v") != F.min("v")).alias("changes"))


@query(f"with {P2P} select ch, cast(blk as bigint) blk, case when not c then 'stuck' when p2p >= 400 then 'failed' when p2p < 200 then 'normal' else 'over' end state from p")
def channel_states(spark, d):
    return live.over_voltage(windows_p2p(spark, d), 200.0, 400.0).select("ch", "blk", "state")


@query(f"with {P2P} select cast(blk as bigint) blk, cast(count(*) filter (c and p2p < 200) - 0.8::double * count(*) * count(*) filter (c and p2p >= 200) as double) score from p group by 1")
def normal_score(spark, d):
    return live.normal_score(live.over_voltage(windows_p2p(spark, d), 200.0), ["blk"]).select("blk", F.col("score").cast("double").alias("score"))


@query(f"with {SERIES}, z as (select ch, max(i) z from s group by 1) select ch, cast((i - 1) % 50 as bigint) place, cast(z.z - i as bigint) age, round(v, 6) v from s join z using (ch) where i > z.z - 50")
def ring_view(spark, d):
    """What a ring of 50 places holds of each channel at the end."""
    return live.ring(series(spark, d), ["ch"], "i", 50).select("ch", "place", "age", r6("v").alias("v"))


# --- geometry and models in two dimensions --------------------------------------------------------


@query(f"with {POINTS}, x as (select *, greatest(0, least(1, ((a - 0) * (c + 1) + b * (e + 1)) / ((c + 1) ** 2 + (e + 1) ** 2))) t from p) select k, round(sqrt((a - t * (c + 1)) ** 2 + (b - t * (e + 1)) ** 2), 6) dist, round(t, 6) t from x")
def closest_point(spark, d):
    """The point of a segment that is closest to a point (a segment of length 0)."""
    zero = F.lit(0.0)
    at = (F.col("a"), F.col("b"), zero)
    found = geometry.closest(at, at, (zero, zero, zero), (F.col("c") + 1, F.col("e") + 1, zero))
    return points(spark, d).select("k", found.alias("f")).select("k", r6("f.dist").alias("dist"), r6("f.t").alias("t"))


def plane(spark, d):
    return load(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("x"))


@query(f"""
with {QDA} select vec_id, cast(c as int) class, round(exp(-0.5 * (b * (embedding[1]::double - m1) ** 2 - 2 * k * (embedding[1]::double - m1) * (embedding[2]::double - m2) + a * (embedding[2]::double - m2) ** 2) / (a * b - k * k)) / (2 * pi() * sqrt(a * b - k * k)), 6) density
from embeddings cross join m
""")
def normal_density(spark, d):
    e = plane(spark, d)
    s = linalg.statistics(e, "x", 2, "label")
    p = e.select("vec_id", F.posexplode(classify.densities(F.col("x"), s)).alias("k", "p"))
    names = F.array(*[F.lit(int(c)) for c in s.names])
    return p.select("vec_id", F.get(names, F.col("k")).alias("class"), r6("p").alias("density"))


#: Eigenvalues and unit eigenvectors of the covariance of two columns, in closed form, the larger entry positive.
EIGEN2 = """c as (select count(*) n, covar_samp(embedding[1]::double, embedding[1]::double) a, covar_samp(embedding[1]::double, embedding[2]::double) b, covar_samp(embedding[2]::double, embedding[2]::double) c from embeddings),
w as (select n, k, a, b, (a + c) / 2 + case k when 0 then 1 else -1 end * sqrt(((a - c) / 2) ** 2 + b * b) w from c cross join (values (0), (1)) q(k)),
u as (select n, k, w, b / sqrt(b * b + (w - a) ** 2) x, (w - a) / sqrt(b * b + (w - a) ** 2) y from w),
v as (select n, k, w, x * case when (case when abs(x) >= abs(y) then x else y end) < 0 then -1 else 1 end x, y * case when (case when abs(x) >= abs(y) then x else y end) < 0 then -1 else 1 end y from u)"""


@query(f"with {EIGEN2} select vec_id, cast(k as int) k, round(embedding[1]::double * x + embedding[2]::double * y, 6) v from embeddings cross join v")
def pca_plane(spark, d):
    """Both principal components of two dimensions."""
    e = plane(spark, d)
    t = linalg.pca(linalg.statistics(e, "x", 2), 2)
    return e.select("vec_id", F.posexplode(linalg.projected(F.col("x"), t)).alias("k", "v")).select("vec_id", "k", r6("v").alias("v"))


@query(f"with {EIGEN2} select vec_id, cast(1 - k as int) k, round((embedding[1]::double * x + embedding[2]::double * y) / sqrt(w * (n - 1) / n), 6) v from embeddings cross join v")
def whiten_plane(spark, d):
    """Two dimensions with unit population covariance; the component of the smaller eigenvalue comes first."""
    e = plane(spark, d)
    t = linalg.whitening(linalg.statistics(e, "x", 2))
    return e.select("vec_id", F.posexplode(linalg.projected(F.col("x"), t)).alias("k", "v")).select("vec_id", "k", r6("v").alias("v"))


@query("""
with m as (select label % 2 g, count(*) n, avg(embedding[1]::double ** 2) a, avg(embedding[1]::double * embedding[2]::double) b, avg(embedding[2]::double ** 2) c from embeddings group by 1),
s as (select max(case when g = 0 then a end) a1, max(case when g = 0 then b end) b1, max(case when g = 0 then c end) c1, sum(a) a, sum(b) b, sum(c) c from m),
t as (select (c * a1 - 2 * b * b1 + a * c1) / (a * c - b * b) tr, (a1 * c1 - b1 * b1) / (a * c - b * b) de from s)
select cast(k as int) k, round(tr / 2 + case k when 0 then 1 else -1 end * sqrt(greatest(tr * tr / 4 - de, 0)), 6) eigenvalue from t cross join (values (0), (1)) q(k)
""")
def fkt_plane(spark, d):
    """Eigenvalues of the two-class transform of two dimensions: of the inverse of both classes' moments times the first's."""
    e = plane(spark, d).withColumn("side", F.col("label") % 2)
    _, lam = linalg.fkt(linalg.statistics(e, "x", 2, "side"), 1, 1)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(lam)], "k int, eigenvalue double")


@query(f"with {SERIES}, x as (select ch, median(v) m from s group by 1), y as (select s.ch, m, median(abs(v - m)) mad from s join x using (ch) group by 1, 2) select ch, round(m, 6) med, round(mad, 6) mad from y")
def level_and_spread(spark, d):
    """Each channel's median and median deviation."""
    out = stats.with_robust_std(series(spark, d), ["ch"], "v")
    return out.select("ch", r6("median").alias("med"), r6("mad").alias("mad"))


# --- spectra of every block ---------------------------------------------------------------------


@query(f"""
with {SERIES}, w as (select a.ch, a.i, b.i - a.i + 15 - 7.5::double t, b.i - a.i + 15 j, b.v from s a join s b on a.ch = b.ch and b.i between a.i - 15 and a.i where a.i >= 16),
m as (select ch, i, avg(v) m, sum(t * v) / sum(t * t) b from w group by 1, 2), y as (select w.ch, w.i, j, v - m.m - m.b * t x from w join m using (ch, i))
select ch, i idx, cast(k as int) k, round(sqrt(sum(x * cos(2 * pi() * k * j / 16)) ** 2 + sum(x * sin(2 * pi() * k * j / 16)) ** 2), 4) magnitude from y cross join (select range k from range(1, 9)) q group by ch, i, k
""")
def stft_magnitude(spark, d):
    """The transform of the last 16 samples, less their straight line, at every sample; without the frequency 0, which is 0."""
    out = dsp.stft_rows(dsp.blocks(series(spark, d), ["ch"], "i", "v"), ["ch"], 128.0, 16)
    return out.filter("k > 0").select("ch", "idx", "k", F.round("magnitude", 4).alias("magnitude"))


EPOCHS = SERIES + ", e as (select ch, (i - 1) // 64 ep, (i - 1) % 64 j, v from s), f as (select ch, ep, avg(v) m, sum((j - 31.5::double) * v) / sum((j - 31.5::double) ** 2) b from e group by 1, 2 having count(*) = 64), y as (select ch, ep, j, v - m - b * (j - 31.5::double) x, m from e join f using (ch, ep))"


def epochs(spark, d):
    e = series(spark, d).withColumn("ep", F.floor((F.col("i") - 1) / 64).cast("long"))
    return dsp.blocks(e, ["ch", "ep"], "i", "v").filter("size(values) = 64")


@query(f"with {EPOCHS} select ch, cast(ep as bigint) ep, cast(k as int) k, round((sum(x * cos(2 * pi() * k * j / 64)) ** 2 + sum(x * sin(2 * pi() * k * j / 64)) ** 2) * case when k = 32 then 1 else 2 end / 64 / 128, 5) density from y cross join (select range k from range(1, 33)) q group by ch, ep, k")
def epoch_spectra(spark, d):
    """The power density of every epoch of 64 samples; without the frequency 0, which is 0."""
    out = dsp.spectra(epochs(spark, d), ["ch", "ep"], 128.0)
    return out.filter("k > 0").select("ch", "ep", "k", F.round("density", 5).alias("density"))


@query(f"""
with {EPOCHS}, p as (select ch, ep, k, (sum(x * cos(2 * pi() * k * j / 64)) ** 2 + sum(x * sin(2 * pi() * k * j / 64)) ** 2) * case when k = 32 then 1 else 2 end / 4096 pw from y cross join (select range k from range(1, 33)) q group by ch, ep, k),
b as (select * from (values (0.0::double, 8.0::double), (8, 16), (16, 64)) t(lo, hi)), z as (select ch, ep, any_value(m) m from y group by 1, 2)
select ch, cast(ep as bigint) ep, lo, hi, round(sum(pw) + any_value(case when lo = 0 then m * m else 0 end), 4) power from p join b on k * 2 >= lo and k * 2 < hi join z using (ch, ep) group by ch, ep, lo, hi
""")
def epoch_bandpower(spark, d):
    """Power in bands of every epoch of 64 samples; a band from 0 has the mean's square."""
    out = dsp.power_rows(epochs(spark, d), ["ch", "ep"], 128.0, [(0.0, 8.0), (8.0, 16.0), (16.0, 64.0)], "fft")
    return out.select("ch", "ep", "lo", "hi", F.round("power", 4).alias("power"))


@query()
def epoch_biquad_power(spark, d):
    """Power of every epoch after the two band-pass sections of each band; its recursion runs on reflected samples first."""
    out = dsp.band_pass_rows(epochs(spark, d), ["ch", "ep"], 128.0, [(8.0, 12.0), (16.0, 24.0)])
    return out.select("ch", "ep", "lo", "hi", r6("power").alias("power"))


@query(f"with {EPOCHS}, c as (select ch, ep, j, v - avg(v) over (partition by ch, ep) x from e join (select ch, ep from f) using (ch, ep)) select ch, cast(ep as bigint) ep, cast(j // 16 as int) segment, round(avg(x * x), 5) power from c group by 1, 2, 3")
def epoch_segments(spark, d):
    """The power of each epoch's segments of an eighth of a second, in one band that takes everything."""
    out = dsp.epoch_powers(epochs(spark, d), ["ch", "ep"], 128.0, [(0.0, 64.0)], 0.0, 0.5, 0.125)
    return out.select("ch", "ep", "segment", F.round("power", 5).alias("power"))


# --- sources ------------------------------------------------------------------------------------


@query("select o_orderkey // 5000 rec, row_number() over (partition by o_orderkey // 5000 order by o_orderkey) frame, round(o_totalprice, 3) a, round(o_totalprice / 7, 3) b from orders")
def emt_scan(spark, d):
    """Orders as text exports of two channels, 5000 order numbers a file, written and scanned again."""
    import uuid

    from pyspark.sql import Window

    from sigloom.sources import emt

    o = load(spark, d, "orders").withColumn("rec", F.floor(F.col("o_orderkey") / 5000).cast("long"))
    frame = F.row_number().over(Window.partitionBy("rec").orderBy("o_orderkey"))
    number = lambda c: F.format_string("%.3f", c.cast("double"))
    line = F.format_string("      %d\t   %s\t  %s\t  %s", F.col("frame"), F.format_string("%.3f", F.col("frame") / 100), number(F.col("o_totalprice")), number(F.col("o_totalprice") / 7))
    rows = o.withColumn("frame", frame).withColumn("line", line).groupBy("rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = "BTS ASCII format\n\nMeasure unit: \tmV\nTracks: \t2\n\n Frame\t Time\t a\t b\n"
    at = f"{live.shared_folder(spark)}/emt-{uuid.uuid4().hex}"
    rows.select(F.concat(F.lit(head), "body").alias("value"), "rec").repartition("rec").write.option("lineSep", "\n").partitionBy("rec").option("maxRecordsPerFile", 1).text(at)
    got = emt.read(spark, f"{at}/rec=*")
    rec = F.regexp_extract("path", r"rec=(\d+)", 1).cast("long")
    return got.groupBy(rec.alias("rec"), "frame").pivot("channel", ["a", "b"]).agg(F.first("value"))

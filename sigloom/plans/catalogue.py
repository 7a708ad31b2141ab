"""The query catalogue: each query is a function of (spark, sf_dir); most have the same meaning in SQL beside them.

Floats are rounded to six places on both sides. Where the operators give the same name to a column as the SQL, nothing else is
shared between the two: the SQL is written from the definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import geometry, textcodec, timecodec
from sigloom.operators import channels, classify, detect, intervals, joins, linalg, regress, spectral, stats, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def series(spark: SparkSession, d: str) -> DataFrame:
    """events as sampled channels: ch, i (from 1 in time order within the channel), v, and the event's id and time."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return load(spark, d, "events").select(F.col("event_type").alias("ch"), F.row_number().over(w).cast("long").alias("i"), F.col("value").alias("v"), "event_id", "ts")


SERIES = "s as (select event_type ch, row_number() over (partition by event_type order by ts, event_id) i, value v, event_id, ts from events)"


def masked(spark: SparkSession, d: str) -> DataFrame:
    """The same with every seventh event's value missing."""
    return series(spark, d).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("v")))


MASKED = SERIES + ", m as (select ch, i, case when event_id % 7 <> 0 then v end v, event_id from s)"


def daily_bounds(spark: SparkSession) -> DataFrame:
    """Overlapping bounds over days of the month."""
    return spark.createDataFrame([(1, 0, 9), (2, 5, 14), (3, 20, 25)], "bound_id int, start int, end int")


BOUNDS = "b as (select * from (values (1, 0, 9), (2, 5, 14), (3, 20, 25)) t(id, a, z))"


# --- intervals ----------------------------------------------------------------------------------


@query(f"""
with {BOUNDS}, e as (select event_type ch, date_part('day', ts) - 1 dd, value v from events),
j as (select ch, id, v from e join b on dd >= a and dd <= z),
m as (select ch, id, median(v) md from j group by ch, id)
select j.ch, cast(j.id as int) bound_id, count(*) n, round(min(v), 6) lo, round(max(v), 6) hi, round(avg(v), 6) mean, round(median(v), 6) med, round(stddev_samp(v), 6) sd,
 round(median(abs(v - md)) * 1.4826::double, 6) robuststd
from j join m on j.ch = m.ch and j.id = m.id group by j.ch, j.id
""")
def bound_stats(spark, d):
    """Samples joined to (overlapping) bounds, and the statistics per channel and bound."""
    e = load(spark, d, "events").select(F.col("event_type").alias("ch"), (F.dayofmonth("ts") - 1).alias("dd"), F.col("value").alias("v"))
    b = daily_bounds(spark).withColumn("dd", F.explode(F.sequence("start", "end")))
    out = stats.with_robust_std(e.join(F.broadcast(b), "dd"), ["ch", "bound_id"], "v")
    return out.select("ch", "bound_id", "n", r6("min").alias("lo"), r6("max").alias("hi"), r6("mean").alias("mean"), r6("median").alias("med"), r6("std").alias("sd"), r6("robuststd").alias("robuststd"))


@query(f"""
with {BOUNDS}, e as (select event_id, date_part('day', ts) - 1 dd from events)
select e.event_id, cast(coalesce(max(b.id), 0) as int) bound_id from e left join b on e.dd >= b.a and e.dd <= b.z group by e.event_id
""")
def point_in_bounds_last_wins(spark, d):
    e = load(spark, d, "events").select("event_id", (F.dayofmonth("ts") - 1).alias("dd"))
    return intervals.points_in_bounds(e, daily_bounds(spark), "dd", 8).select("event_id", "bound_id")


ORDER_SPANS = """o as (select o_orderkey k, o_custkey c, epoch(o_orderdate) / 86400 d from orders),
small as (select k, c, d s, d + 3 e from o), big as (select k, c, d - 20 s, d + 20 e from o where k % 3 = 0)"""


@query(f"""
with {ORDER_SPANS}, j as (select small.k, first(big.k order by big.s, big.e, big.k) b from small join big on small.c = big.c and small.s > big.s and small.e < big.e group by small.k)
select small.k small_id, j.b big_id from small left join j on small.k = j.k
""")
def bounds_in_bounds(spark, d):
    """Per customer: each order's three days with the first forty-day window of a third of the orders that holds them strictly."""
    day = F.col("o_orderdate").cast("timestamp").cast("long") / 86400
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), day.alias("d"))
    small = o.select(F.col("k").alias("small_id"), "c", F.col("d").alias("start"), (F.col("d") + 3).alias("end"))
    big = o.filter("k % 3 = 0").select(F.col("k").alias("big_id"), "c", (F.col("d") - 20).alias("start"), (F.col("d") + 20).alias("end"))
    return intervals.bounds_in_bounds(small, big, 40, ["c"]).select("small_id", "big_id")


@query("""
with u as (select distinct o_custkey c, cast(floor(epoch(o_orderdate) / 604800) as bigint) w from orders),
g as (select c, w, w - row_number() over (partition by c order by w) k from u)
select c, min(w) a, max(w) z, count(*) n from g group by c, k
""")
def contig_groups(spark, d):
    """Runs of successive weeks in which a customer ordered."""
    u = load(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.floor(F.col("o_orderdate").cast("timestamp").cast("long") / 604800).alias("w")).distinct()
    return intervals.contiguous_groups(u, ["c"], "w").select("c", F.col("start").alias("a"), F.col("end").alias("z"), "n")


RUNS = SERIES + """, e as (select ch, i, v, case when v > 50 then 1 else 0 end b from s), g as (select ch, i, v, b, i - row_number() over (partition by ch, b order by i) k from e),
r as (select ch, min(i) a, max(i) z, max(v) peak from g where b = 1 group by ch, k)"""


def runs_over(spark, d) -> DataFrame:
    return intervals.runs(series(spark, d), ["ch"], "i", F.col("v") > 50, F.max("v").alias("peak"))


@query(f"with {RUNS} select ch, a, z, round(peak, 6) peak from r")
def threshold_edges(spark, d):
    return runs_over(spark, d).select("ch", F.col("start").alias("a"), F.col("end").alias("z"), r6("peak").alias("peak"))


@query(f"""
with {RUNS}, m as (select *, case when a - lag(z) over (partition by ch order by a) < 4 then 0 else 1 end brk from r), m2 as (select *, sum(brk) over (partition by ch order by a) grp from m)
select ch, cast(grp as bigint) grp, min(a) a, max(z) z, round(max(peak), 6) peak from m2 group by ch, grp
""")
def merge_close_bounds(spark, d):
    out = intervals.merge_close(runs_over(spark, d), ["ch"], 4, F.max("peak").alias("peak"))
    return out.select("ch", F.col("grp").cast("long").alias("grp"), F.col("start").alias("a"), F.col("end").alias("z"), r6("peak").alias("peak"))


@query(f"with {RUNS} select ch, a, z, round(peak, 6) peak from r where z - a + 1 between 2 and 5 and peak >= 100")
def filter_bounds(spark, d):
    return intervals.filter_bounds(runs_over(spark, d), 2, 5, "peak", 100).select("ch", F.col("start").alias("a"), F.col("end").alias("z"), r6("peak").alias("peak"))


SWEEP = SERIES + """, r as (select ch, min(v) lo, max(v) hi from s group by ch), lv as (select ch, l, lo + (hi - lo) * l / 200 thr from r cross join (select range l from range(201)) q),
x as (select s.ch, lv.l, s.i, case when s.v > lv.thr then 1 else 0 end b from s join lv on s.ch = lv.ch), e as (select ch, l, i, b, lag(b, 1, 0) over (partition by ch, l order by i) pb from x),
c as (select ch, l, sum(case when b = 1 and pb = 0 then 1 else 0 end) n from e group by ch, l)"""


@query(f"with {SWEEP} select ch, cast(l as int) l, cast(n as bigint) n from c")
def threshold_sweep(spark, d):
    return detect.level_counts(series(spark, d), ["ch"], "i", "v").select("ch", "l", F.col("n").cast("long").alias("n"))


PLATEAU = SWEEP + """, dlt as (select ch, l, abs(n - lag(n, 1, n) over (partition by ch order by l)) d from c), j as (select ch, l, d, avg(cast(d as double)) over (partition by ch) tol from dlt),
f as (select ch, l, case when d <= tol then 1 else 0 end ok from j), k as (select ch, l, l - row_number() over (partition by ch order by l) g from f where ok = 1),
p as (select ch, min(l) a, max(l) z from k group by ch, g), w as (select *, row_number() over (partition by ch order by z - a desc, a) rn from p)"""


@query(f"with {PLATEAU} select ch, cast(a as bigint) a, cast(z as bigint) z from w where rn = 1")
def threshold_sweep_plateau(spark, d):
    return detect.plateau(detect.level_counts(series(spark, d), ["ch"], "i", "v"), ["ch"])


DETECTED = PLATEAU + """, t as (select w.ch, lo + (hi - lo) * round(a + (z - a) * 0.5) / 200 thr from w join r on w.ch = r.ch where rn = 1),
o as (select s.ch, i, v, i - row_number() over (partition by s.ch order by i) k from s join t on s.ch = t.ch where v > thr), q as (select ch, min(i) a, max(i) z, max(v) peak from o group by ch, k),
y as (select *, case when a - max(z) over (partition by ch order by a rows between unbounded preceding and 1 preceding) < 3 then 0 else 1 end brk from q), y2 as (select *, sum(brk) over (partition by ch order by a) grp from y)"""


@query(f"with {DETECTED} select ch, min(a) a, max(z) z, round(max(peak), 6) peak from y2 group by ch, grp")
def detected_actions(spark, d):
    """The whole detector: sweep, plateau, threshold at its middle, runs over it, merged over gaps under 3."""
    return detect.detected(series(spark, d), ["ch"], "i", "v", merge=3).select("ch", F.col("start").alias("a"), F.col("end").alias("z"), r6("peak").alias("peak"))


PAINT = "b as (select * from (values (1, 1.2, 10.0, 41), (2, 21.0, 30.4, 52), (3, 8.0, 12.0, 7), (4, -3.0, 2.0, 9), (5, 38.0, 99.0, 5)) t(ord, s, e, v))"
PAINTED = [(1, 1.2, 10.0, 41), (2, 21.0, 30.4, 52), (3, 8.0, 12.0, 7), (4, -3.0, 2.0, 9), (5, 38.0, 99.0, 5)]


@query(f"""
with {PAINT}, x as (select range idx from range(1, 41)), h as (select idx, arg_max(v, ord) v from x join b on idx >= greatest(round(s), 1) and idx <= least(round(e), 40) group by idx)
select x.idx, cast(coalesce(h.v, 0) as int) "value" from x left join h on x.idx = h.idx
""")
def put_tribounds(spark, d):
    b = spark.createDataFrame(PAINTED, "ord int, start double, end double, v int")
    return intervals.put_bounds(b, 40, "v")


@query(f"""
with {PAINT}, x as (select range idx from range(1, 41)) select idx, cast(exists (select 1 from b where idx >= greatest(round(s), 1) and idx <= least(round(e), 40)) as int) "value" from x
""")
def put_bounds(spark, d):
    return intervals.put_bounds(spark.createDataFrame(PAINTED, "ord int, start double, end double, v int"), 40)


@query("""
with o as (select o_orderkey k, cast(o_orderkey % 11 as double) s, cast(o_orderkey % 11 + o_orderkey % 7 as double) e from orders)
select k, cast(p as int) part, round(s + 1 + p * (e - s - 1) / 3, 6) a, round(s + 1 + (p + 1) * (e - s - 1) / 3, 6) z from o cross join (select range p from range(3)) where e - s > 1
""")
def split_bounds(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 11).cast("double").alias("start"), (F.col("o_orderkey") % 11 + F.col("o_orderkey") % 7).cast("double").alias("end"))
    return intervals.split_bounds(o, 3, 1.0).select("k", "part", r6("part_start").alias("a"), r6("part_end").alias("z"))


@query("""
with e as (select event_id, user_id u, ts, event_type t from events), s as (select user_id u, ts st, event_id seg from events where event_type = 'signup')
select e.event_id, s.seg from e asof left join s on e.u = s.u and e.ts > s.st
""")
def asof_segment(spark, d):
    """Each event with the user's latest signup strictly before it."""
    e = load(spark, d, "events")
    s = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("st"), F.col("event_id").alias("seg"))
    return intervals.as_of(e.select("event_id", "user_id", "ts"), s, "ts", "st", "seg", ["user_id"]).select("event_id", "seg")


@query("""
with a as (select cast(event_id as double) t0, cast(event_id + 2 as double) t1, 'idle' tag from events), b as (select cast(event_id as double) t0, null::double t1, 'move' tag from events)
select t0, t1, tag, round((t0 + coalesce(t1, t0)) / 2, 6) mid from (select * from a union all select * from b)
""")
def event_tags(spark, d):
    """Both tags on every event."""
    e = load(spark, d, "events").select(F.col("event_id").cast("double").alias("t0"))
    a, b = e.withColumn("t1", F.col("t0") + 2), e.withColumn("t1", F.lit(None).cast("double"))
    return intervals.event_tags((a, "idle"), (b, "move")).select("t0", "t1", "tag", r6("mid").alias("mid"))


# --- statistics ---------------------------------------------------------------------------------


@query("""
with g as (select date_part('day', ts) dd, event_type ch, avg(value) v from events group by 1, 2), f as (select *, stddev_samp(v) over (partition by ch) sd from g),
m as (select *, avg(case when sd > 0 then v end) over (partition by dd) mu from f)
select cast(dd as int) dd, ch, round(case when sd > 0 then v - mu else v end, 6) v from m
""")
def car_reference(spark, d):
    g = load(spark, d, "events").groupBy(F.dayofmonth("ts").alias("dd"), F.col("event_type").alias("ch")).agg(F.avg("value").alias("v"))
    return stats.common_average(g, ["dd"], "ch", "v").select("dd", "ch", r6("referenced").alias("v"))


@query(f"with {MASKED} select event_id, round((v - avg(v) over (partition by ch)) / stddev_samp(v) over (partition by ch), 6) z from m")
def nanzscore(spark, d):
    return stats.zscore(masked(spark, d), ["ch"], "v").select("event_id", r6("z").alias("z"))


@query("select l_returnflag f, l_linestatus s, round(mad(l_extendedprice) * 1.4826::double, 6) robuststd, round(median(l_extendedprice), 6) med from lineitem group by 1, 2")
def robust_std(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), "l_extendedprice")
    return stats.with_robust_std(li, ["f", "s"], "l_extendedprice").select("f", "s", r6("robuststd").alias("robuststd"), r6("median").alias("med"))


@query("select event_type ch, round(stddev_samp(value) / count(value), 8) sem, round(mad(value) * 1.4826::double / count(value), 8) robustsem from events group by 1")
def sem(spark, d):
    out = stats.sem(load(spark, d, "events").withColumnRenamed("event_type", "ch"), ["ch"], "value")
    return out.select("ch", F.round("sem", 8).alias("sem"), F.round("robustsem", 8).alias("robustsem"))


@query("""
with x as (select l_orderkey k, l_linenumber n, l_returnflag f, l_extendedprice a, l_quantity b from lineitem), q as (select f, median(a) m1, mad(a) d1, median(b) m2, mad(b) d2 from x group by f)
select k, n, round((b - m2) * d1 / d2 + m1, 6) e from x join q using (f)
""")
def equalize_traces(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f"), F.col("l_extendedprice").alias("a"), F.col("l_quantity").alias("b"))
    return stats.equalised(li, ["f"], "a", "b", "e").select("k", "n", r6("e").alias("e"))


@query(f"with {SERIES}, f as (select ch, regr_slope(v, i) a, regr_intercept(v, i) b from s group by ch) select event_id, round(v - a * i - b, 6) v from s join f using (ch)")
def detrend_linear(spark, d):
    return stats.detrend(series(spark, d), ["ch"], "i", "v").select("event_id", r6("detrended").alias("v"))


@query(f"with {SERIES} select ch, cast(floor((i - 1) / 7) as bigint) bin, round(avg(v), 6) mean from s group by 1, 2 having count(*) = 7")
def bin_mean(spark, d):
    return stats.bin_mean(series(spark, d), ["ch"], "i", "v", 7).select("ch", "bin", r6("mean").alias("mean"))


@query(f"""
with {MASKED}, t as (select *, sum(case when v is null then 1 else 0 end) over (partition by ch order by i) run from m), p as (select ch, run, i, v, event_id from t where v is not null),
q as (select *, row_number() over (partition by ch, run order by i) pos, count(*) over (partition by ch, run) n from p), h as (select *, least(pos - 1, n - pos, 2) k from q)
select a.event_id, round(avg(b.v), 6) sm from h a join h b on a.ch = b.ch and a.run = b.run and b.pos between a.pos - a.k and a.pos + a.k group by a.event_id
""")
def moving_average_runs(spark, d):
    return stats.moving_average(masked(spark, d), ["ch"], "i", "v", 5).filter("smooth is not null").select("event_id", r6("smooth").alias("sm"))


@query(f"""
with {MASKED}, w as (select *, last_value(case when v is not null then i end ignore nulls) over (partition by ch order by i) pi, first_value(case when v is not null then i end ignore nulls) over (partition by ch order by i rows between current row and unbounded following) ni from m),
k as (select ch, i, v, row_number() over (partition by ch order by i) u, row_number() over (partition by ch order by i desc) dn from m where v is not null),
f as (select w.event_id, w.i, w.v, coalesce(w.pi, h1.i, 0) xa, coalesce(w.pi, 0) hasp, coalesce(w.ni, 0) hasn, w.ch, w.pi, w.ni from w left join k h1 on h1.ch = w.ch and h1.u = 1),
z as (select f.event_id, f.i, f.v, case when hasp = 0 then h1.i when hasn = 0 then t2.i else f.pi end x1, case when hasp = 0 then h1.v when hasn = 0 then t2.v else p.v end y1,
 case when hasp = 0 then h2.i when hasn = 0 then t1.i else f.ni end x2, case when hasp = 0 then h2.v when hasn = 0 then t1.v else n.v end y2
 from f left join k p on p.ch = f.ch and p.i = f.pi left join k n on n.ch = f.ch and n.i = f.ni left join k h1 on h1.ch = f.ch and h1.u = 1 left join k h2 on h2.ch = f.ch and h2.u = 2
 left join k t1 on t1.ch = f.ch and t1.dn = 1 left join k t2 on t2.ch = f.ch and t2.dn = 2)
select event_id, round(case when v is not null then v else y1 + (i - x1) * (y2 - y1) / (x2 - x1) end, 6) v from z
""")
def bridge_nans(spark, d):
    return stats.bridge_nulls(masked(spark, d), ["ch"], "i", "v").select("event_id", r6("bridged").alias("v"))


@query(f"with {SERIES} select event_id, round(max(v) over w - min(v) over w, 6) p2p from s window w as (partition by ch order by i rows between 11 preceding and current row)")
def rolling_peak_to_peak(spark, d):
    return stats.peak_to_peak(series(spark, d), ["ch"], "i", "v", 12).select("event_id", r6("p2p").alias("p2p"))


@query(f"with {SERIES}, x as (select *, lag(v) over (partition by ch order by i) a, lead(v) over (partition by ch order by i) b from s) select event_id, round(v, 6) v from x where v > a and v > b and v >= 100")
def local_peaks(spark, d):
    return stats.local_peaks(series(spark, d), ["ch"], "i", "v", 100).select("event_id", r6("v").alias("v"))


@query("select event_type ch, cast(floor(value / 25) as bigint) bin, count(*) n from events where value >= 0 and value < 500 group by 1, 2")
def histogram(spark, d):
    return stats.histogram(load(spark, d, "events").withColumnRenamed("event_type", "ch"), ["ch"], "value", 0.0, 500.0, 20)


@query("""
with g as (select n, k, p from (values (10), (25), (60)) a(n), (values (3), (7), (10)) b(k), (values (0.2::double), (0.5::double)) c(p)), i as (select n, k, p, unnest(range(k, n + 1)) i from g)
select cast(n as int) n, cast(k as int) k, p, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))), 6) tail from i group by n, k, p
""")
def chance_level(spark, d):
    one = lambda name, values, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    g = joins.grid(one("n", [10, 25, 60], "int"), one("k", [3, 7, 10], "int"), one("p", [0.2, 0.5], "double"))
    return g.select("n", "k", "p", r6(stats.binomial_tail(F.col("n"), F.col("k"), F.col("p"))).alias("tail"))

"""Queries of cohort grading and behavioural scores. A line of an order is a task of its supplier, a nation is a project; an event is a commit of its user."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.scalar import absolute_map
from cohortlens.operators import cohort
from cohortlens.operators.grading import keep_factor
from cohortlens.plans.queries import query, r

_MODELS, _LEVELS = {"A": 0.2, "N": 0.6}, {"F": 0.5}


@query("""
with x as (select s_nationkey as project, l_suppkey as student, l_quantity as points, o_orderpriority like '5%' as exempt, l_discount > 0.03 as own, o_orderpriority like '1%' as parent, l_returnflag as m, l_linestatus as l, o_orderstatus as pm from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey),
k as (select *, case when exempt then 0 when own then case m when 'A' then 0.2 when 'N' then 0.6 else 1 end when parent then 1 else 0.5 end as mf, case when exempt then 0 when own then case l when 'F' then 0.5 else 1 end when parent then case pm when 'F' then 0.5 else 1 end else 1 end as lf from x),
s as (select project, student, sum(points) as raw, sum(points * (1 - 0.8 * mf * lf)) as eff from k group by 1, 2),
n as (select s_nationkey as project, count(*) as size from supplier group by 1)
select project, student, round(raw, 4) as student_raw, round(eff, 4) as student_eff, round(eff / raw, 6) as own_keep, round(eff / sum(eff) over w, 6) as contribution, round(sum(raw) over w / size, 4) as mean_raw, round(sum(eff) over w / sum(raw) over w, 6) as ai_factor
from s join n using (project) window w as (partition by project)""")
def grade_scopes(t):
    x = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    c, first = F.col, lambda d: F.col("o_orderpriority").startswith(d)
    model, level, _ = cohort.usage((c("l_returnflag"), c("l_linestatus"), c("l_discount") > 0.03), (F.lit("other"), c("o_orderstatus"), first("1")), first("5"), _MODELS, _LEVELS)
    x = x.select(c("s_nationkey").alias("project"), c("l_suppkey").alias("student"), c("l_quantity").alias("points"), keep_factor(model, level, 1.0, 0.2).alias("keep"))
    sizes = t("supplier").groupBy(c("s_nationkey").alias("project")).agg(F.count("*").alias("team_size"))
    s = cohort.scopes(x, "project", "student", "points", "keep", sizes)
    return s.select("project", "student", *[r(k, d).alias(k) for k, d in (("student_raw", 4), ("student_eff", 4), ("own_keep", 6), ("contribution", 6), ("mean_raw", 4), ("ai_factor", 6))])


@query("""
with x as (select p_brand as k, p_retailprice as v from part union all select 'size', p_size from part),
g as (select k, min(v) as lo, max(v) as hi, case when k = 'size' or min(v) <= 0 then 0 else min(v) * 0.95 end as f from x group by 1)
select k, round(f, 6) as floor, round(case when hi <= f then f + 1 else greatest(hi + 0.1 * greatest(hi - lo, 1), f + 1) end, 6) as ceiling from g""")
def metric_anchors(t):
    p = t("part")
    x = p.select(F.col("p_brand").alias("k"), F.col("p_retailprice").alias("v")).unionByName(p.select(F.lit("size").alias("k"), F.col("p_size").cast("double").alias("v")))
    return cohort.anchors(x, "k", "v", ("size",), 6)


@query("""
with g as (select p_brand, count(case when p_type like '%BRASS%' then 1 end) as brass, count(case when p_size > 45 then 1 end) as large, count(case when p_retailprice > 1500 then 1 end) as dear, avg(p_size) as size, avg(case when p_size > 49 then p_retailprice end) as top from part group by 1),
a as (select *, least(greatest((size - 10) * 10 / 40, 0), 10) as sa, least(greatest((top - 900) * 10 / 1200, 0), 10) as sb from g)
select p_brand, round(least(brass, 3) / 3 * 3 + least(large, 3) / 3 * 2 + least(dear, 2) / 2, 6) as extra, round(case when top is null then sa else (0.7 * sa + 0.3 * sb) / (0.7 + 0.3) end, 6) as axis from a""")
def project_axes(t):
    n = lambda on: F.count(F.when(on, 1))
    size, price = F.col("p_size"), F.col("p_retailprice")
    g = t("part").groupBy("p_brand").agg(n(F.col("p_type").contains("BRASS")).alias("brass"), n(size > 45).alias("large"), n(price > 1500).alias("dear"), F.avg(size).alias("size"), F.avg(F.when(size > 49, price)).alias("top"))
    extra = cohort.saturated_sum({"brass": (F.col("brass"), 3, 3), "large": (F.col("large"), 2, 3), "dear": (F.col("dear"), 1, 2)})
    top = F.when(F.col("top").isNotNull(), absolute_map(F.col("top"), 900, 2100))
    return g.select("p_brand", F.round(extra, 6).alias("extra"), F.round(cohort.present_mean({"size": (absolute_map(F.col("size"), 10, 50), 0.7), "top": (top, 0.3)}), 6).alias("axis"))


@query("""
with g as (select o_custkey, sum(o_totalprice) as v from orders group by 1) select round(10 / max(v), 9) as scale from g""")
def calibration(t):
    return cohort.calibrate(t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v")), "v", 10.0, digits=9)


@query("""
with a as (select p_partkey as k, p_retailprice as price, p_size as size from part where p_brand <> 'Brand#13'),
b as (select p_partkey as k, p_retailprice + case when p_type = 'ECONOMY' then 0.25 else 0.003 end as price, p_size as size from part where p_brand <> 'Brand#5'),
j as (select coalesce(a.k, b.k) as k, a.price as ap, b.price as bp, a.size as az, b.size as bz from a full join b on a.k = b.k),
e as (select k, 'price' as "column", ap as have, bp as want, 0.005 as tol from j union all select k, 'size', az, bz, 0.5 from j)
select k, "column", round(have, 4) as have, round(want, 4) as want, round(abs(have - want), 6) as delta from e where abs(have - want) > tol or (have is null) <> (want is null)""")
def parity_check(t):
    p = t("part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), "p_brand", "p_type")
    want = p.filter("p_brand != 'Brand#5'").withColumn("price", F.col("price") + F.when(F.col("p_type") == "ECONOMY", 0.25).otherwise(0.003))
    found = cohort.parity(p.filter("p_brand != 'Brand#13'").drop("p_brand", "p_type"), want.drop("p_brand", "p_type"), "k", {"price": 2, "size": 0})
    return found.select("k", "column", r("have", 4).alias("have"), r("want", 4).alias("want"), r("delta", 6).alias("delta"))


@query("""
with x as (select user_id, epoch_us(ts) as t, coalesce(value * 3, 0) as n, coalesce(event_type, '') as m from events),
y as (select *, (t - lag(t) over w) / 60e6 as gap, row_number() over w as i from x window w as (partition by user_id order by t, n, m)),
g as (select user_id, count(*) as commit_count, max(n) as max_size, avg(gap) as mean_gap, max(t) > min(t) and coalesce(bool_or(n > 200 and gap < 15), false) as anomaly, count(*) > 1 and bool_and(case when i = 1 then n >= 100 else n <= 30 and regexp_matches(lower(m), 'fix|typo|missing|forgot|oops|lint|format') end) as fixup,
  bool_or(contains(lower(m), 'test')) as adjusts_tests, bool_or(n > 0 and n < 20) as has_small, avg(length(m)) as message_length from y group by 1)
select user_id, commit_count, round(max_size, 4) as max_size, round(mean_gap, 4) as mean_gap, anomaly, fixup, adjusts_tests, has_small, round(message_length, 6) as message_length,
  round(cast(least(case when commit_count = 1 and max_size > 200 then 0.3 else 0 end + case when fixup then 0.25 else 0 end + case when anomaly then 0.25 else 0 end + case when not adjusts_tests and max_size > 100 then 0.1 else 0 end + case when not has_small then 0.1 else 0 end, 1) as double), 4) as score from g""")
def behaviour_signals(t):
    e = t("events").select("user_id", "ts", (F.col("value") * 3).alias("size"), "event_type")
    b = cohort.behaviour(e, "user_id", "ts", "size", "event_type")
    return b.select("user_id", "commit_count", r("max_size", 4).alias("max_size"), r("mean_gap", 4).alias("mean_gap"), "anomaly", "fixup", "adjusts_tests", "has_small", r("message_length", 6).alias("message_length"), r("score", 4).alias("score"))


@query("""
with d as (select coalesce(source, '') as who, doc_id % 3 as period, n_chars, length(text) - length(replace(text, ' ', '')) as gaps from documents),
b as (select who, avg(n_chars) as c, avg(gaps) as g from d where period = 0 group by 1), s as (select who, period, avg(n_chars) as c, avg(gaps) as g from d where period > 0 group by 1, 2)
select s.who, period, round(0.6 * least(greatest(abs(s.c - b.c) / greatest(b.c * 0.35, 0.1) / 3, 0), 1) + 0.4 * least(greatest(abs(s.g - b.g) / greatest(b.g * 0.35, 0.1) / 3, 0), 1), 6) as score from s join b on s.who = b.who""")
def text_consistency(t):
    gaps = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    d = t("documents").select(F.coalesce("source", F.lit("")).alias("who"), (F.col("doc_id") % 3).alias("period"), "n_chars", gaps.alias("gaps"))
    # One pass: the baseline of a source is a row of its own few periods.
    by = d.groupBy("who", "period").agg(F.avg("n_chars").alias("c"), F.avg("gaps").alias("g"))
    base = by.filter("period = 0").select(F.col("who").alias("w0"), F.col("c").alias("c0"), F.col("g").alias("g0"))
    x = by.filter("period > 0").join(base, F.col("who") == F.col("w0"))
    return x.select("who", "period", F.round(cohort.consistency([(F.col("c"), F.col("c0"), 0.6), (F.col("g"), F.col("g0"), 0.4)]), 6).alias("score"))


@query("""
with o as (select l_suppkey, l_partkey, sum(l_quantity) as n from lineitem group by 1, 2 having sum(l_quantity) >= 10)
select l_suppkey, count(*) as files, sum(n) as lines, round(sum(n * p_size / 50) / sum(n), 6) as score from o join part on p_partkey = l_partkey group by 1""")
def score_attribution(t):
    s = t("part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") / 50).alias("s"))
    return cohort.attribute_scores(t("lineitem"), "l_suppkey", "l_partkey", "l_quantity", s, "s").withColumn("score", F.round("score", 6))

"""The named queries over the shared tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.functions import text as T
from cohortlens.operators import flags, grading, graphs, maintenance, relational, stats
from cohortlens.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        name = f.__name__.strip("_")
        QUERIES[name] = lambda spark, sf_dir, f=f: f(lambda t: read(spark, sf_dir, t))
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def r(x, digits: int = 4):
    """Rounded so that the order of additions does not show; never minus zero."""
    return F.round(x, digits) + F.lit(0.0)


REVENUE = "l_extendedprice * (1 - l_discount)"


# Joins and windows


@query("""
with parts as (select l_orderkey, l_linenumber, o_custkey, o_totalprice,
    case when sum(l_quantity) over w = 0 then 1.0 / count(*) over w else l_quantity / sum(l_quantity) over w end as weight
  from lineitem join orders on l_orderkey = o_orderkey window w as (partition by l_orderkey)),
m as (select o_custkey, sum(weight) as tasks, sum(weight * o_totalprice) as points from parts group by 1),
s as (select c_nationkey, c_custkey, tasks, points, points / sum(points) over (partition by c_nationkey) as share from m join customer on o_custkey = c_custkey)
select c_nationkey, c_custkey, round(tasks, 4) as tasks, round(points, 2) as points, round(share, 6) as share, share > 0.04 as carrying from s""")
def weight_distribution(t):
    parts = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = relational.distribute(parts, "l_orderkey", F.col("l_quantity"), {"points": F.col("o_totalprice")})
    m = parts.groupBy("o_custkey").agg(F.sum("weight").alias("tasks"), F.sum("points").alias("points")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    total = m.groupBy(F.col("c_nationkey").alias("team")).agg(F.sum("points").alias("all_points"))
    m = m.join(total, F.col("c_nationkey") == F.col("team")).withColumn("share", F.col("points") / F.col("all_points"))
    return m.select("c_nationkey", "c_custkey", r("tasks").alias("tasks"), r("points", 2).alias("points"), r("share", 6).alias("share"), (F.col("share") > 0.04).alias("carrying"))


@query("""
with q as (select l_orderkey, l_suppkey, sum(l_quantity) as q, count(*) as n from lineitem group by 1, 2)
select l_orderkey, l_suppkey, q, n from (select *, row_number() over (partition by l_orderkey order by q desc, n desc, l_suppkey) as rn from q) where rn = 1""")
def primary_author(t):
    q = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return relational.dominant(q, ["l_orderkey"], [F.desc("q"), F.desc("n"), F.col("l_suppkey")])


@query("""
with m as (select o_custkey, strftime(o_orderdate, '%Y-%m') as month, sum(o_totalprice) as v from orders group by 1, 2)
select o_custkey, month, round(v, 2) as v, round(lag(v) over w, 2) as previous, round(v - lag(v) over w, 2) as delta from m window w as (partition by o_custkey order by month)""")
def previous_value(t):
    m = t("orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    p = relational.previous(m, ["o_custkey"], "month", "v")
    return p.select("o_custkey", "month", *[r(c, 2).alias(c) for c in ("v", "previous", "delta")])


@query("""
with w as (select o_orderpriority, date_trunc('month', o_orderdate) as s, max(o_orderdate) as e from orders group by 1, 2),
l as (select l_shipdate, row_number() over () as id from lineitem), h as (select s, row_number() over (partition by id order by s, e) as rn
  from l join w on o_orderpriority = '1-URGENT' and l_shipdate between s and e)
select strftime(s, '%Y-%m-%d') as window_start, count(*) as n from h where rn = 1 group by 1""")
def interval_containment(t):
    w = t("orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.date_trunc("month", "o_orderdate").alias("s")).agg(F.max("o_orderdate").alias("e"))
    w = w.select(F.col("s").cast("timestamp").alias("s"), F.col("e").cast("timestamp").alias("e"))
    e = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("at"))
    return relational.contained(e, "at", w, "s", "e").groupBy(F.date_format("s", "yyyy-MM-dd").alias("window_start")).agg(F.count("*").alias("n"))


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def orphans_anti_join(t):
    """Documents without labels."""
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def membership_semi_join(t):
    return t("customer").join(t("orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""
select c_custkey, count(o_orderkey) as n_orders, coalesce(round(sum(o_totalprice), 2), 0) as total, sum(case when o_orderstatus = 'O' then 1 else 0 end) as n_open,
  count(distinct cast(o_orderdate as date)) as active_days from customer left join orders on c_custkey = o_custkey group by 1""")
def left_join_summary(t):
    x = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("n_orders"), F.coalesce(r(F.sum("o_totalprice"), 2), F.lit(0.0)).alias("total"), F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("n_open"), F.countDistinct(F.col("o_orderdate").cast("date")).alias("active_days")
    )


@query("""
with d as (select distinct l_partkey as k, l_suppkey % 10 as side from lineitem)
select x.side as a, y.side as b, count(*) as shared from d x join d y on x.k = y.k and x.side < y.side group by 1, 2""")
def shared_pairs(t):
    return relational.shared_pairs(t("lineitem").select(F.col("l_partkey").alias("k0"), (F.col("l_suppkey") % 10).alias("side")), "k0", "side")


@query("""
select e.event_id, c.c_custkey from events e left join customer c on lower('customer#' || lpad(cast(e.user_id as varchar), 9, '0')) = lower(c.c_name)""")
def case_folded_join(t):
    key = F.lower(F.concat(F.lit("customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")))
    return t("events").join(t("customer"), key == F.lower("c_name"), "left").select("event_id", "c_custkey")


@query("""
with w as (select o_custkey, l_suppkey, sum(case when l_returnflag = 'R' then 0.5 else 1.0 end) as w from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
s as (select *, w / sum(w) over (partition by o_custkey) as share, row_number() over (partition by o_custkey order by w desc, l_suppkey) as rn from w)
select o_custkey, l_suppkey, cast(w as double) as w, round(share, 6) as share from s where rn = 1 and share >= 0.05""")
def identity_resolution(t):
    e = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    got = relational.resolve_identity(e, "o_custkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", 0.5).otherwise(1.0), 0.05)
    return got.select("o_custkey", "l_suppkey", "w", r("share", 6).alias("share"))


@query("""
with a as (select l_partkey, l_suppkey, sum(l_quantity) as a from lineitem group by 1, 2),
b as (select *, sum(a) over (partition by l_partkey order by a desc, l_suppkey rows unbounded preceding) - a as before, sum(a) over (partition by l_partkey) as total from a)
select l_partkey, count(*) as owners, cast(sum(case when before < 0.95 * total then 1 else 0 end) as bigint) as needed from b group by 1""")
def truck_factor(t):
    return relational.coverage(t("lineitem"), ["l_partkey"], "l_suppkey", "l_quantity")


GRAPH = """select distinct c_nationkey % 5 as g, c_nationkey as a, s_nationkey as b from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey"""


def _graph(t):
    x = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select((F.col("c_nationkey") % 5).alias("g"), F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"))


@query(f"""
with e as (select * from ({GRAPH}) where a <> b), n as (select g, count(distinct v) as nodes from (select g, a as v from e union all select g, b from e) group by 1)
select n.g, nodes, count(*) as edges, round(count(*) / (nodes * (nodes - 1.0)), 6) as density,
  round(sum(case when exists (select 1 from e f where f.g = e.g and f.a = e.b and f.b = e.a) then 1 else 0 end) / cast(count(*) as double), 6) as reciprocity
from e join n on e.g = n.g group by n.g, nodes""")
def review_graph(t):
    m = relational.graph_metrics(_graph(t), ["g"], "a", "b")
    return m.select("g", "nodes", "edges", r("density", 6).alias("density"), r("reciprocity", 6).alias("reciprocity"))


WAYS = f"""
with recursive e as (select * from ({GRAPH}) where a <> b), n as (select g, a as v from e union select g, b from e),
walk as (select g, v as s, v, 0 as d from n union select walk.g, s, b, d + 1 from walk join e on e.g = walk.g and a = v where d < 12),
far as (select g, s, v, min(d) as d from walk group by 1, 2, 3),
way as (select g, v as s, v, 0 as d from n union all select way.g, way.s, e.b, way.d + 1 from way join e on e.g = way.g and e.a = way.v join far on far.g = way.g and far.s = way.s and far.v = e.b and far.d = way.d + 1),
ways as (select g, s, v, d, count(*) as paths from way group by 1, 2, 3, 4),
through as (select x.g, x.v as node, sum(cast(x.paths * y.paths as double) / z.paths) as c from ways x join ways y on x.g = y.g and x.v = y.s join ways z on z.g = x.g and z.s = x.s and z.v = y.v and z.d = x.d + y.d
  where x.d > 0 and y.d > 0 group by 1, 2),
size as (select g, count(*) as n from n group by 1),
between as (select n.g, n.v as node, round(coalesce(c, 0) / ((size.n - 1) * (size.n - 2)), 6) as betweenness from n join size on size.g = n.g left join through t on t.g = n.g and t.node = n.v)"""


@query(f"{WAYS} select * from between")
def betweenness(t):
    return graphs.betweenness(_graph(t), ["g"], "a", "b").withColumn("betweenness", r("betweenness", 6))


@query(f"""{WAYS},
team as (select c_nationkey % 5 as g, c_nationkey as node from customer union select g, v from n),
mutual as (select g, count(*) as m from e where exists (select 1 from e f where f.g = e.g and f.a = e.b and f.b = e.a) group by 1),
orders_of as (select c_nationkey % 5 as g, count(*) as prs, count(*) filter (where o_orderstatus <> 'O') as reviewed from orders join customer on o_custkey = c_custkey group by 1),
degrees as (select t.g, t.node, (select count(*) from e where e.g = t.g and b = t.node) as in_degree, (select count(*) from e where e.g = t.g and a = t.node) as out_degree from team t),
whole as (select g, count(*) as nodes, sum(out_degree) as links, bool_or(in_degree + out_degree = 0) as isolated from degrees group by 1)
select d.g, d.node, in_degree, out_degree, round(coalesce(c, 0) / ((nodes - 1) * (nodes - 2)), 4) as betweenness, nodes, round(links / (nodes * (nodes - 1.0)), 6) as density, round(coalesce(m, 0) / cast(links as double), 6) as reciprocity, isolated, round(reviewed / cast(prs as double), 6) as coverage
from degrees d join whole using (g) left join mutual using (g) join orders_of using (g) left join through b on b.g = d.g and b.node = d.node""")
def collaboration_metrics(t):
    g = (F.col("c_nationkey") % 5).alias("g")
    reviews = _graph(t)
    members = t("customer").select(g, F.col("c_nationkey").alias("node")).unionByName(reviews.select("g", F.col("b").alias("node"))).distinct()
    prs = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(g, F.col("o_orderkey").alias("pr"), (F.col("o_orderstatus") != "O").alias("reviewed"))
    x = graphs.collaboration(members, reviews, prs, ["g"])
    x = x.select("*", F.explode(F.from_json("centrality", "map<string,struct<in_degree:bigint,out_degree:bigint,betweenness:double>>")).alias("node", "c"))
    return x.select("g", F.col("node").cast("int"), "c.*", "nodes", *[r(c, 6).alias(c) for c in ("density", "reciprocity", "coverage")], "isolated")


# Statistics


@query("""
with x as (select c_nationkey as g, c_acctbal + 1000 as x from customer), y as (select *, row_number() over (partition by g order by x) as i, avg(x) over (partition by g) as mu from x)
select g, count(*) as n, round((2 * sum(x * i) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)), 6) as gini, round(sum(abs(x - mu)) / (2 * sum(x)), 6) as hoover,
  round(stddev_pop(x) / avg(x), 6) as cv, round(max(x) / min(x), 2) as max_min_ratio from y group by 1 having count(*) >= 2""")
def team_inequality(t):
    x = stats.inequality(t("customer").select(F.col("c_nationkey").alias("g"), (F.col("c_acctbal") + 1000).alias("x0")), ["g"], "x0")
    return x.select("g", "n", *[r(c, 6).alias(c) for c in ("gini", "hoover", "cv")], r("max_min_ratio", 2).alias("max_min_ratio"))


@query("""
with x as (select s_nationkey as g, s_suppkey, s_acctbal, count(l_orderkey) as lines, coalesce(sum(l_quantity), 0) as qty from supplier left join lineitem on l_suppkey = s_suppkey group by 1, 2, 3),
z as (select *, case when max(s_acctbal) over w = min(s_acctbal) over w then 0.5 else (s_acctbal - min(s_acctbal) over w) / (max(s_acctbal) over w - min(s_acctbal) over w) end as a,
  case when max(lines) over w = min(lines) over w then 0.5 else (lines - min(lines) over w) / cast(max(lines) over w - min(lines) over w as double) end as b,
  case when max(qty) over w = min(qty) over w then 0.5 else (qty - min(qty) over w) / (max(qty) over w - min(qty) over w) end as c from x window w as (partition by g)),
s as (select *, 0.4 * a + 0.35 * b + 0.25 * c as composite from z)
select g, s_suppkey, round(composite, 6) as composite, row_number() over (partition by g order by round(composite, 9) desc, s_suppkey) as rank from s""")
def contribution_composite(t):
    x = t("supplier").join(t("lineitem"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    x = x.groupBy(F.col("s_nationkey").alias("g"), "s_suppkey", "s_acctbal").agg(F.count("l_orderkey").alias("lines"), F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("qty"))
    parts = {"s_acctbal": 0.4, "lines": 0.35, "qty": 0.25}
    x = stats.scaled(x, ["g"], list(parts)).withColumn("c", sum(w * F.col(f"{k}_scaled") for k, w in parts.items()))
    # A place in the order of (composite, supplier) is the rank.
    ranked = stats.positions(x.withColumn("key", F.struct((-F.round("c", 9)).alias("minus"), "s_suppkey", "c")), ["g"], "key")
    return ranked.select("g", "x.s_suppkey", r("x.c", 6).alias("composite"), (F.col("before") + 1).cast("bigint").alias("rank"))


@query("""
select l_suppkey as g, round(median(l_extendedprice), 4) as median, round(list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 2 + 1], 4) as upper_median,
  round(quantile_cont(l_extendedprice, 0.1), 4) as p10, round(quantile_cont(l_extendedprice, 0.9), 4) as p90, round(list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 4 + 1], 4) as quarter from lineitem group by 1""")
def quantile_variants(t):
    q = stats.quantiles(t("lineitem").withColumn("g", F.col("l_suppkey")), ["g"], "l_extendedprice")
    return q.select("g", *[r(c).alias(c) for c in ("median", "upper_median", "p10", "p90", "quarter")])


@query("""
with g as (select p_brand, median(p_retailprice) as med from part group by 1 having count(*) >= 3), d as (select p.*, med, abs(p_retailprice - med) as dev from part p join g using (p_brand)),
s as (select p_brand, coalesce(nullif(median(dev), 0), nullif(avg(dev), 0)) as scale from d group by 1)
select p_partkey, round((p_retailprice - med) / scale, 6) as z, coalesce(abs((p_retailprice - med) / scale) > 1.5, false) as outlier from d join s using (p_brand)""")
def mad_outliers(t):
    x = stats.mad_outliers(t("part"), ["p_brand"], "p_retailprice", 1.5)
    return x.select("p_partkey", r("z", 6).alias("z"), "outlier")


@query("""
with m as (select o_custkey, strftime(o_orderdate, '%Y-%m') as month, sum(o_totalprice) as v from orders group by 1, 2),
i as (select o_custkey, v, row_number() over (partition by o_custkey order by month) - 1 as i from m)
select o_custkey, count(*) as n, case when count(*) > 1 then round(regr_slope(v, i), 4) end as slope, round(stddev_pop(v) / avg(v), 4) as cv from i group by 1""")
def trajectory(t):
    m = t("orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    return stats.trend(m, ["o_custkey"], "month", "v").select("o_custkey", "n", r("slope", 4).alias("slope"), r("cv").alias("cv"))


@query("""
with c as (select user_id, hour(ts) as h, count(*) as c from events group by 1, 2)
select user_id, cast(sum(c) as bigint) as n, round((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(24), 6) as entropy from c group by 1""")
def temporal_entropy(t):
    e = stats.entropy(t("events").withColumn("h", F.hour("ts")), ["user_id"], "h", 24)
    return e.select("user_id", "n", (F.round("entropy", 6) + 0.0).alias("entropy"))


@query("""
with d as (select distinct user_id, cast(ts as date) as d from events), g as (select user_id, d, d - lag(d) over (partition by user_id order by d) as gap from d),
e as (select user_id, count(*) as n, sum(case when isodow(ts) >= 6 then 1 else 0 end) as weekend, sum(case when hour(ts) < 6 then 1 else 0 end) as night from events group by 1)
select e.user_id, n, round(weekend / n, 6) as weekend, round(night / n, 6) as night, active_days, longest_gap from e join (select user_id, count(*) as active_days, cast(coalesce(max(gap), 30) as integer) as longest_gap from g group by 1) using (user_id)""")
def temporal_metrics(t):
    ev = t("events").withColumn("d", F.col("ts").cast("date"))
    w = Window.partitionBy("user_id").orderBy("d")
    gaps = ev.select("user_id", "d").distinct().withColumn("gap", F.datediff("d", F.lag("d").over(w)))
    gaps = gaps.groupBy("user_id").agg(F.count("*").alias("active_days"), F.coalesce(F.max("gap"), F.lit(30)).alias("longest_gap"))
    e = ev.groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.weekday("d") >= 5).cast("int")).alias("weekend"), F.avg((F.hour("ts") < 6).cast("int")).alias("night"))
    return e.join(gaps, "user_id").select("user_id", "n", r("weekend", 6).alias("weekend"), r("night", 6).alias("night"), "active_days", "longest_gap")


@query("""
with h as (select event_id, user_id, (epoch(date_trunc('day', ts)) + 86400 - epoch(ts)) / 3600.0 as h from events)
select event_id, round(1 / (1 + exp(-0.4 * (h - 12))), 6) as score, case when h >= 18 then 'early' when h >= 12 then 'on_time' when h >= 3 then 'late' else 'last_minute' end as band from h""")
def regularity(t):
    ts = F.col("ts").cast("timestamp")
    h = (F.unix_micros(F.date_trunc("day", ts)) / 1e6 + 86400 - F.unix_micros(ts) / 1e6) / 3600.0
    x = t("events").withColumn("h", h)
    return x.select("event_id", r(S.sigmoid(F.col("h"), 0.4, 12.0), 6).alias("score"), S.banded(F.col("h"), [(18, "early"), (12, "on_time"), (3, "late")], "last_minute").alias("band"))


@query("""
with w as (select l_suppkey, l_extendedprice as x, case when l_discount = 0 then null else l_discount end as w from lineitem)
select l_suppkey, round(sum(x * greatest(coalesce(w, 1), 0)) / sum(greatest(coalesce(w, 1), 0)), 4) as mean from w group by 1""")
def weighted_mean(t):
    w = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    return t("lineitem").groupBy("l_suppkey").agg(r(stats.weighted_mean(F.col("l_extendedprice"), w)).alias("mean"))


# Cohorts and grades


@query("""
with m as (select c_nationkey as g, avg(c_acctbal) as x from customer group by 1), b as (select quantile_cont(x, 0.1) as p10, quantile_cont(x, 0.9) as p90, min(x) as lo, max(x) as hi from m),
n as (select g, x, p10, p90, 0.95 * lo as f, hi + 0.1 * (hi - lo) as c from m, b)
select g, round(case when p10 = p90 then 5 when x < p10 then greatest(0, least(2, case when p10 = f then 1 else (x - f) * 2 / (p10 - f) end)) when x > p90 then greatest(8, least(10, case when c = p90 then 9 else 8 + (x - p90) * 2 / (c - p90) end))
  else 2 + (x - p10) * 6 / (p90 - p10) end, 6) as score from n""")
def cohort_normalization(t):
    m = t("customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.avg("c_acctbal").alias("x"))
    b = m.agg(F.percentile("x", 0.1).alias("p10"), F.percentile("x", 0.9).alias("p90"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    x = m.join(F.broadcast(b))  # one row of bounds
    floor, ceiling = 0.95 * F.col("lo"), F.col("hi") + 0.1 * (F.col("hi") - F.col("lo"))
    return x.select("g", r(S.hybrid_normalize(F.col("x"), F.col("p10"), F.col("p90"), floor, ceiling), 6).alias("score"))


FORMULAS = [
    ("keep", ("-", 1, ("*", 0.8, "use"))),
    ("effective", ("*", "raw", "keep")),
    ("factor", ("/", "effective", "raw")),
    ("grade", ("clamp", ("*", 10, ("pow", ("/", ("min", "effective", 50), 50), 1.5)), 0, 10)),
]


@query("""
with x as (select l_orderkey, l_linenumber, l_quantity as raw, l_discount * 10 as use from lineitem), k as (select *, 1 - 0.8 * use as keep from x)
select l_orderkey, l_linenumber, round(keep, 6) as keep, round(raw * keep, 6) as effective, round(case when raw = 0 then 0 else raw * keep / raw end, 6) as factor,
  round(greatest(0, least(10, 10 * pow(least(raw * keep, 50) / 50, 1.5))), 6) as grade from k""")
def formula_engine(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("raw"), (F.col("l_discount") * 10).alias("use"))
    return grading.evaluate(x, FORMULAS).select("l_orderkey", "l_linenumber", *[r(n, 6).alias(n) for n, _ in FORMULAS])


@query("""
with o as (select c_nationkey as team, l_suppkey as who, sum(case when l_returnflag = 'R' then l_quantity else 0 end) as own from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2)
select team, who, round(least(0.8 * own, 60) + least(0.2 * sum(own) over (partition by team), 500), 4) as penalty from o""")
def quality_penalty(t):
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = x.groupBy(F.col("c_nationkey").alias("team"), F.col("l_suppkey").alias("who")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("own"))
    o = o.withColumn("team_total", F.sum("own").over(Window.partitionBy("team")))
    return o.select("team", "who", r(grading.penalty(F.col("own"), F.col("team_total"), 60.0, 500.0)).alias("penalty"))


@query("""
with x as (select d.doc_id, cast(quality as double) as a, cast(toxic as double) as b, least(n_chars / 5000.0, 1) as c from documents d left join labels l using (doc_id))
select doc_id, round((coalesce(0.5 * a, 0) + coalesce(0.3 * b, 0) + 0.2 * c) / (case when a is null then 0 else 0.5 end + case when b is null then 0 else 0.3 end + 0.2), 6) as risk,
  case when a is not null and b is not null then 'high' else 'low' end as confidence from x""")
def signal_fusion(t):
    x = t("documents").join(t("labels"), "doc_id", "left")
    risk, n = S.weighted_fusion({"a": (F.col("quality").cast("double"), 0.5), "b": (F.col("toxic").cast("double"), 0.3), "c": (F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), 0.2)})
    return x.select("doc_id", r(risk, 6).alias("risk"), F.when(n >= 3, "high").otherwise("low").alias("confidence"))


RIDGE = [round(0.01 * (i % 7 - 3), 2) for i in range(64)]


@query(f"""
with p as (select vec_id, 2.0 + list_dot_product(cast(embedding as double[]), cast({RIDGE} as double[])) as y from embeddings)
select vec_id, round(y, 6) as y, floor(y / 0.25 + 0.5) * 0.25 as grid from p""")
def ridge_prediction(t):
    y = S.dot(F.col("embedding"), RIDGE, 2.0)
    return t("embeddings").select("vec_id", r(y, 6).alias("y"), (S.quantize(y, 0.25)).cast("double").alias("grid"))


# Flags


def _metrics(t):
    m = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey", "c_custkey", "c_acctbal").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("v"))
    return m.withColumn("share", S.safe_divide(F.col("v"), F.sum("v").over(Window.partitionBy("c_nationkey"))))


@query("""
with m as (select c_nationkey, c_custkey, c_acctbal, count(o_orderkey) as n, coalesce(sum(o_totalprice), 0) as v from customer left join orders on c_custkey = o_custkey group by 1, 2, 3),
s as (select *, v / sum(v) over (partition by c_nationkey) as share from m)
select c_custkey, 'ZERO_TASKS' as flag, 'CRITICAL' as severity from s where n = 0
union all select c_custkey, 'CARRYING_TEAM', 'WARNING' from s where share > 0.04
union all select c_custkey, 'LOW_BALANCE', case when c_acctbal < -500 then 'CRITICAL' else 'WARNING' end from s where c_acctbal < 0
union all select c_custkey, 'MANY_SMALL', 'INFO' from s where n >= 15 and v / n < 150000""")
def flag_rules(t):
    rules = [
        flags.Rule("ZERO_TASKS", F.col("n") == 0, "CRITICAL"),
        flags.Rule("CARRYING_TEAM", F.col("share") > 0.04, "WARNING", {"share": F.round("share", 4)}),
        flags.Rule("LOW_BALANCE", F.col("c_acctbal") < 0, F.when(F.col("c_acctbal") < -500, "CRITICAL").otherwise("WARNING"), {"balance": F.col("c_acctbal")}),
        flags.Rule("MANY_SMALL", (F.col("n") >= 15) & (S.safe_divide(F.col("v"), F.col("n")) < 150000), "INFO", {"n": F.col("n")}),
    ]
    return flags.raise_flags(_metrics(t), ["c_custkey"], rules).drop("details")


@query("""
select event_type, count(*) as n, cast(sum(case when value >= 50 then 1 else 0 end) as bigint) as high, string_agg(distinct cast(user_id % 7 as varchar), ',' order by cast(user_id % 7 as varchar)) as members from events group by 1 having count(*) > 1""")
def tier_pivot(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") >= 50).cast("bigint")).alias("high"), F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 7).cast("string"))), ",").alias("members")).filter("n > 1")


# Text, hashes, survival


@query(r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[a-zA-Z0-9]+(?:''[a-zA-Z]+)?') as w, trim(regexp_replace(text, '\s+', ' ', 'g')) as c from documents)
select doc_id, len(w) as n_words, round(case when len(w) > 0 then len(list_distinct(w)) / len(w) else 0 end, 6) as richness, length(c) as n_chars, sha256(c) as digest from w""")
def text_profile(t):
    # Words and the collapsed text are named once, and used from there.
    x = t("documents").select("doc_id", T.tokens(F.col("text")).alias("w"), T.collapse(F.col("text")).alias("c"))
    richness = S.safe_divide(F.size(F.array_distinct("w")), F.size("w"))
    return x.select("doc_id", F.size("w").cast("bigint").alias("n_words"), r(richness, 6).alias("richness"), F.length("c").cast("bigint").alias("n_chars"), F.sha2("c", 256).alias("digest"))


@query("""
select source, count(*) as total, count(distinct sha256(text)) as distinct_raw, count(distinct sha256(lower(regexp_replace(text, '[0-9]+', '#', 'g')))) as distinct_normalized from documents group by 1""")
def fingerprint_survival(t):
    n = F.sha2(F.lower(F.regexp_replace("text", "[0-9]+", "#")), 256)
    return t("documents").groupBy("source").agg(F.count("*").alias("total"), F.countDistinct(F.sha2("text", 256)).alias("distinct_raw"), F.countDistinct(n).alias("distinct_normalized"))


@query("""
with h as (select distinct sha256(text) as h, source from documents) select x.source as a, y.source as b, count(*) as shared from h x join h y on x.h = y.h and x.source < y.source group by 1, 2""")
def cross_team_copies(t):
    return relational.shared_pairs(t("documents").select(F.sha2("text", 256).alias("h"), "source"), "h", "source")


@query(r"""
select page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) as host, case when regexp_matches(html, '(?i)\b(hack|workaround)\b') then 'hack' when regexp_matches(html, '(?i)track\(') then 'tracker' else 'none' end as kind, len(regexp_extract_all(html, '<p[ >]')) as paragraphs from pages""")
def page_classification(t):
    kind = T.classify(F.col("html"), (("hack", r"\b(hack|workaround)\b"), ("tracker", r"track\(")), "none")
    return t("pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/:?#]+)", 1)).alias("host"), kind.alias("kind"), F.regexp_count("html", F.lit("<p[ >]")).cast("bigint").alias("paragraphs"))


@query("""
select conv_id, count(*) as turns, string_agg(role, '>' order by turn) as shape, cast(sum(length(coalesce(text, ''))) as bigint) as chars, max(case when turn = 0 then role end) as first_role from conversations group by 1""")
def conversation_shape(t):
    c = t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.max(F.when(F.col("turn") == 0, F.col("role"))).alias("first_role"))
    return c.select("conv_id", "turns", F.array_join(F.col("x.role"), ">").alias("shape"), "chars", "first_role")


# Maintenance and increments


def _versions(t):
    """Two versions of the customers: those of a segment are missing in the first, those of another in the second; a third one's balances differ."""
    c = t("customer")
    segment = F.col("c_mktsegment")
    new = c.filter(segment != "MACHINERY").withColumn("c_acctbal", F.when(segment == "BUILDING", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return c.filter(segment != "FURNITURE"), new


VERSIONS = """with a as (select * from customer where c_mktsegment <> 'FURNITURE'),
b as (select * replace (case when c_mktsegment = 'BUILDING' then c_acctbal + 1 else c_acctbal end as c_acctbal) from customer where c_mktsegment <> 'MACHINERY')"""


@query(VERSIONS + """ select coalesce(a.c_custkey, b.c_custkey) as c_custkey, case when b.c_custkey is null then 'ONLY-A' when a.c_custkey is null then 'ONLY-B' else 'DIFF' end as status
from a full join b on a.c_custkey = b.c_custkey where a.c_custkey is null or b.c_custkey is null or a.c_acctbal <> b.c_acctbal""")
def table_diff(t):
    return maintenance.diff(*_versions(t), ["c_custkey"])


@query(VERSIONS + " select c_custkey, round(c_acctbal, 2) as c_acctbal from b union all select c_custkey, round(c_acctbal, 2) from a where c_custkey not in (select c_custkey from b)")
def upsert_replace(t):
    a, b = _versions(t)
    return maintenance.upsert(a, b, ["c_custkey"]).select("c_custkey", r("c_acctbal", 2).alias("c_acctbal"))


@query(VERSIONS + " select coalesce(b.c_custkey, a.c_custkey) as c_custkey, round(coalesce(b.c_acctbal, a.c_acctbal), 2) as c_acctbal from a full join b on a.c_custkey = b.c_custkey")
def upsert_coalesce(t):
    a, b = _versions(t)
    return maintenance.upsert(a, b, ["c_custkey"], "coalesce").select("c_custkey", r("c_acctbal", 2).alias("c_acctbal"))


@query("select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) where rn = 1")
def latest_version(t):
    return maintenance.latest(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


@query("""
select count(*) as n_rows, cast(coalesce(sum(cast(cast('0x' || substr(sha256(concat_ws(chr(31), o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice)), 1, 15) as ubigint) as hugeint)), 0) as varchar) as digest from orders""")
def table_checksum(t):
    return maintenance.checksum(t("orders"))


@query("""
with doomed as (select n_nationkey from nation where n_regionkey = 1), c as (select c_custkey from customer where c_nationkey in (select * from doomed)), o as (select o_orderkey from orders where o_custkey in (select * from c))
select 'customer' as name, count(*) as n from customer where c_custkey not in (select * from c) union all select 'orders', count(*) from orders where o_orderkey not in (select * from o) union all select 'nation', count(*) from nation where n_regionkey <> 1""")
def cascading_purge(t):
    tables = {n: t(n) for n in ("nation", "customer", "orders")}
    left = maintenance.purge(tables, [("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey")], "nation", tables["nation"].filter("n_regionkey = 1"))
    out = None
    for n, df in left.items():
        one = df.agg(F.lit(n).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# Plain relational shapes


@query(f"""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum({REVENUE}), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(t):
    return t("lineitem").filter("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum(F.expr(REVENUE)), 2).alias("revenue"), r(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query(f"""
select n_name, round(sum({REVENUE}), 2) as revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' group by 1""")
def multi_join_revenue(t):
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("n_name").agg(r(F.sum(F.expr(REVENUE)), 2).alias("revenue"))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 3")
def top_k_per_group(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("select c_custkey as k from customer where c_acctbal > 5000 intersect select o_custkey from orders where o_orderstatus = 'P' union select s_suppkey from supplier except select p_partkey from part where p_size > 45")
def set_operations(t):
    a = t("customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k")).intersect(t("orders").filter("o_orderstatus = 'P'").select("o_custkey"))
    return t("supplier").select(F.col("s_suppkey").alias("k")).union(a).distinct().subtract(t("part").filter("p_size > 45").select("p_partkey"))

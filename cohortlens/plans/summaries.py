"""Queries that sum up: dashboards of all levels, inequality of all measures, contexts, calendars, left-out deviations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import dashboards, relational
from cohortlens.plans.queries import query, r


def _facts(t):
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.select("c_nationkey", "c_custkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")


@query("""
select case when grouping(c_custkey) = 0 then 'member' when grouping(c_nationkey) = 0 then 'team' else 'cohort' end as level, c_nationkey as team, c_custkey as member, count(*) as tasks, count(distinct l_orderkey) as prs,
  cast(sum(l_quantity) as bigint) as points, round(sum(l_extendedprice), 2) as statements, count(*) filter (where l_returnflag = 'R') as flags, round(sum(l_extendedprice) / sum(l_quantity), 4) as density
from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey group by grouping sets ((c_nationkey, c_custkey), (c_nationkey), ())""")
def section_dashboards(t):
    points = F.sum("l_quantity")
    return dashboards.dashboards(
        _facts(t), "c_nationkey", "c_custkey",
        {"tasks": F.count("*"), "prs": F.countDistinct("l_orderkey"), "points": points.cast("bigint"), "statements": r(F.sum("l_extendedprice"), 2), "flags": F.count_if(F.col("l_returnflag") == "R"), "density": r(F.sum("l_extendedprice") / points)},
    )


@query("""
with own as (select c_nationkey as team, c_custkey, cast(count(o_orderkey) as double) as orders, cast(count(distinct o_orderpriority) as double) as kinds, coalesce(sum(o_totalprice), 0) as price from customer left join orders on o_custkey = c_custkey group by 1, 2),
x as (select team, 'orders' as metric, orders as x from own union all select team, 'kinds', kinds from own union all select team, 'price', price from own),
y as (select *, row_number() over (partition by team, metric order by x) as i, avg(x) over (partition by team, metric) as mu from x)
select team, metric, count(*) as n, round((2 * sum(x * i) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)), 6) as gini, round(sum(abs(x - mu)) / (2 * sum(x)), 6) as hoover, round(stddev_pop(x) / avg(x), 6) as cv,
  case when min(x) = 0 then -1 else round(max(x) / min(x), 4) end as max_min_ratio from y group by 1, 2""")
def all_inequality(t):
    members = t("customer").select(F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("member"))
    facts = t("orders").withColumn("member", F.col("o_custkey"))
    x = dashboards.all_inequality(members, facts, {"orders": F.count("*"), "kinds": F.countDistinct("o_orderpriority"), "price": F.sum("o_totalprice")})
    ratio = F.when(F.col("max_min_ratio") == float("inf"), -1.0).otherwise(F.round("max_min_ratio", 4))
    return x.select("team", "metric", "n", *[r(c, 6).alias(c) for c in ("gini", "hoover", "cv")], ratio.alias("max_min_ratio"))


BUDGET = 4000


@query(f"""
with f as (select d.source as team, doc_id, case when toxic = 1 then 0 when quality = 0 then 1 else 2 end as rank, coalesce(lang, '-') as lang, coalesce(text, '') as text, toxic, quality from documents d left join labels using (doc_id)),
l as (select team, doc_id, rank, '  - [' || case rank when 0 then 'CRITICAL' when 1 then 'WARNING' else 'INFO' end || ' / ' || lang || '] doc ' || doc_id || ' — ' || text as line from f),
e as (select *, sum(length(line) + 1) over (partition by team order by rank, doc_id rows unbounded preceding) - 1 as e from l),
k as (select *, case when e <= {BUDGET} then line else substr(line, 1, cast({BUDGET} - (e - length(line)) - 1 as bigint)) || '…' end as cut from e where e - length(line) < {BUDGET})
select k.team, count(*) as rows, any_value(all_rows) as all_rows, length(string_agg(cut, chr(10) order by rank, doc_id)) as chars, sha256(string_agg(cut, chr(10) order by rank, doc_id)) as digest
from k join (select team, count(*) as all_rows from l group by 1) n on n.team is not distinct from k.team group by k.team""")
def llm_context(t):
    labels = t("labels").select(F.col("doc_id").alias("d2"), "toxic", "quality")
    x = t("documents").join(labels, F.col("doc_id") == F.col("d2"), "left").withColumn("team", F.col("source"))
    rank = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    severity = F.element_at(F.array(*map(F.lit, ("CRITICAL", "WARNING", "INFO"))), rank + 1)
    line = F.concat(F.lit("  - ["), severity, F.lit(" / "), F.coalesce("lang", F.lit("-")), F.lit("] doc "), F.col("doc_id").cast("string"), F.lit(" — "), F.coalesce("text", F.lit("")))
    got = dashboards.packed_context(x, ["team"], [rank, F.col("doc_id")], line, BUDGET)
    return got.select("team", "rows", "all_rows", F.length("context").cast("bigint").alias("chars"), F.sha2("context", 256).alias("digest"))


CALENDAR = """
with c as (select 'course ' || r_regionkey as course, date '1995-01-02' + 7 * r_regionkey as first_day, 7 + 7 * (r_regionkey // 3) as days from region),
s as (select course, first_day, days, unnest(range(1, 181)) as sprint from c),
w as (select course, sprint, timezone('UTC', timezone('Europe/Madrid', cast(first_day + cast((sprint - 1) * days as integer) as timestamp))) as starts, timezone('UTC', timezone('Europe/Madrid', cast(first_day + cast(sprint * days as integer) as timestamp))) as following from s)"""


def _calendar(t):
    key = F.col("r_regionkey")
    days = 7 + 7 * F.floor(key / 3)
    courses = t("region").select(F.concat(F.lit("course "), key.cast("string")).alias("course"), F.date_add(F.lit("1995-01-02").cast("date"), key * 7).alias("first_day"), days.cast("int").alias("days"), F.lit(180).alias("sprints"))
    return dashboards.sprint_windows(courses)


@query(CALENDAR + """
select course, cast(sprint as integer) as sprint, starts, following - interval 1 second as ends, round((epoch(following) - epoch(starts)) / 3600, 2) as hours from w""")
def sprint_calendar(t):
    return _calendar(t).withColumn("hours", r("hours", 2))


@query("""
with w as (select o_custkey as course, o_orderkey as sprint, o_orderdate as starts, case when o_orderstatus <> 'P' then o_orderdate + to_days(cast(floor(o_totalprice / 4000) as integer)) end as ends from orders),
x as (select *, max(ends) over (partition by course order by starts, ends, sprint rows between unbounded preceding and 1 preceding) as reached from w where ends is not null)
select course, sprint, case when starts > reached then 'gap' else 'overlap' end as problem, cast(case when starts > reached then epoch(starts) - epoch(reached) - 1 else 1 + epoch(reached) - epoch(starts) end as bigint) as seconds from x
where reached is not null and epoch(starts) - epoch(reached) <> 1 union all select course, sprint, 'invalid', null from w where ends is null""")
def window_problems(t):
    ends = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.make_dt_interval(F.floor(F.col("o_totalprice") / 4000).cast("int")))
    return dashboards.window_problems(t("orders").select(F.col("o_custkey").alias("course"), F.col("o_orderkey").alias("sprint"), F.col("o_orderdate").alias("starts"), ends.alias("ends")))


@query(CALENDAR + """,
e as (select sprint, starts, following - interval 1 second as ends from w where course = 'course 4'),
x as (select o_custkey, sprint, epoch(o_orderdate) as sec, epoch(starts) as a, epoch(ends) as z from orders join e on o_orderdate between starts and ends),
k as (select o_custkey, sprint, case when sec >= z - 48 * 3600 then 'cramming' when sec < a + (z - a) / 3.0 then 'early' when sec < a + 2 * ((z - a) / 3.0) then 'mid' else 'late' end as kind from x),
n as (select o_custkey, 'course 4' as course, cast(sprint as integer) as sprint, count(*) filter (where kind = 'early') as early, count(*) filter (where kind = 'mid') as mid, count(*) filter (where kind = 'late') as late, count(*) filter (where kind = 'cramming') as cramming from k group by o_custkey, sprint)
select *, '{"early": ' || early || ', "mid": ' || mid || ', "late": ' || late || ', "cramming": ' || cramming || '}' as spread from n""")
def temporal_spread(t):
    windows = _calendar(t).filter("course = 'course 4'")
    found = relational.contained(t("orders").select("o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at")), "at", windows.drop("hours"), "starts", "ends")
    return dashboards.temporal_spread(found.select("o_custkey", "course", "sprint", "at"), windows, ["o_custkey"])


@query("""
with x as (select label as author, vec_id as file, unnest(range(1, len(embedding) + 1)) as feature, unnest(embedding) as v from embeddings),
p as (select a.author, a.file, a.feature, cast(any_value(a.v) as double) as value, count(*) as n, avg(cast(b.v as double)) as mean, stddev_samp(cast(b.v as double)) as sd from x a join x b on a.author = b.author and a.feature = b.feature and a.file <> b.file group by 1, 2, 3)
select author, file, count(*) as features, max(n) as others, round(avg(case when sd < 1e-9 then 0 else abs(value - mean) / sd end), 6) as mean_z, round(max(case when sd < 1e-9 then 0 else abs(value - mean) / sd end), 6) as max_z from p where n >= 3 group by 1, 2""")
def left_out_deviation(t):
    e = t("embeddings").select(F.col("label").alias("author"), F.col("vec_id").alias("file"), F.posexplode("embedding").alias("feature", "value"))
    z = dashboards.left_out_deviation(e).groupBy("author", "file").agg(F.count("*").alias("features"), F.max("n").alias("others"), r(F.avg("z"), 6).alias("mean_z"), r(F.max("z"), 6).alias("max_z"))
    return z

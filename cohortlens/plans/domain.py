"""Queries of the detectors and report datasets, on pull requests and members projected from the shared tables.

An order is a pull request by its customer, its lines are commits, a nation is a team;
a line is an addition unless it was returned, and survives if its status is F."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import banded, safe_divide
from cohortlens.functions import text as T
from cohortlens.operators import detectors, relational, reports, stats
from cohortlens.plans.queries import query, r

TH = detectors.Thresholds(carrying=0.045, mismatch=0.01, dump_lines=30, survival_z=1.2, cosmetic=0.5)

PRS = """prs as (select o_orderkey as pr, o_custkey as author, o_orderdate as merged_at, o_orderstatus <> 'F' as compiles, count(*) as commits, sum(case when l_returnflag <> 'R' then l_quantity else 0 end) as additions,
  sum(case when l_returnflag = 'R' then l_quantity else 0 end) as deletions, sum(case when l_linestatus = 'F' then l_quantity else 0 end) as surviving, sum(l_quantity) as normalized from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3, 4)"""


def prs(t):
    c, q = F.col, F.col("l_quantity")
    x = t("orders").join(t("lineitem"), c("o_orderkey") == c("l_orderkey"))
    return x.groupBy(c("o_orderkey").alias("pr"), c("o_custkey").alias("author"), c("o_orderdate").alias("merged_at"), (c("o_orderstatus") != "F").alias("compiles")).agg(
        F.count("*").alias("commits"), F.sum(F.when(c("l_returnflag") != "R", q).otherwise(0.0)).alias("additions"), F.sum(F.when(c("l_returnflag") == "R", q).otherwise(0.0)).alias("deletions"),
        F.sum(F.when(c("l_linestatus") == "F", q).otherwise(0.0)).alias("surviving"), F.sum(q).alias("normalized"), F.lit(True).alias("merged"),
    )


MEMBERS = f"""{PRS}, members as (select c_custkey as member, c_nationkey as team, count(pr) as prs, coalesce(sum(commits), 0) as points, coalesce(sum(additions + deletions), 0) as lines, coalesce(sum(surviving), 0) as surviving, coalesce(sum(normalized), 0) as normalized,
    count(case when additions + deletions <= 60 then 1 end) as small_prs, count(case when not compiles then 1 end) as failed from customer left join prs on author = c_custkey group by 1, 2),
m1 as (select *, case when max(lines) over w > 0 then lines / max(lines) over w else 0 end as code, case when max(points) over w > 0 then points / max(points) over w else 0 end as task from members window w as (partition by team)),
m2 as (select *, (code + task) / 2 as composite from m1)"""


def members(t):
    c = F.col
    lines = c("additions") + c("deletions")
    x = t("customer").join(prs(t), c("author") == c("c_custkey"), "left").groupBy(c("c_custkey").alias("member"), c("c_nationkey").alias("team"))
    zero = lambda e: F.coalesce(F.sum(e), F.lit(0))
    x = x.agg(
        F.count("pr").alias("prs"), zero("commits").alias("points"), zero(lines).alias("lines"), zero("surviving").alias("surviving"), zero("normalized").alias("normalized"),
        F.count(F.when(lines <= 60, 1)).alias("small_prs"), F.count(F.when(~c("compiles"), 1)).alias("failed"),
    )
    team = Window.partitionBy("team")
    x = x.withColumns({k: safe_divide(c(v), F.max(v).over(team)) for k, v in (("code", "lines"), ("task", "points"))})
    return x.withColumn("composite", (c("code") + c("task")) / 2)


@query(f"""
with {MEMBERS},
m3 as (select *, case when lines > 0 then surviving / lines end as survival, sum(points) over w as tp, sum(lines) over w as tl, count(*) over w as n, row_number() over (partition by team order by points, member) as rp, row_number() over (partition by team order by lines, member) as rl from m2 window w as (partition by team)),
m4 as (select *, max(case when rp = n // 2 + 1 then points end) over w as pm, max(case when rl = n // 4 + 1 then lines end) over w as lq, avg(survival) over w as mu, stddev_pop(survival) over w as sd,
  case when tp = 0 then 0 else points / tp end as ps, case when tl = 0 then 0 else lines / tl end as ls from m3 window w as (partition by team))
select member, 'ZERO_TASKS' as flag, 'CRITICAL' as severity from m4 where prs = 0
union all select member, 'CARRYING_TEAM', 'WARNING' from m4 where ps > 0.045
union all select member, 'LOW_CODE_HIGH_POINTS', 'WARNING' from m4 where n >= 2 and points > pm and lines < lq
union all select member, 'POINT_CODE_MISMATCH', 'INFO' from m4 where abs(ps - ls) > 0.01
union all select member, 'MICRO_PRS', 'INFO' from m4 where small_prs >= 3 and 2 * small_prs > prs
union all select member, 'LOW_SURVIVAL_RATE', 'WARNING' from m4 where n >= 2 and sd > 0 and (mu - survival) / sd > 1.2 and survival < 0.85
union all select member, 'RAW_NORMALIZED_DIVERGENCE', 'INFO' from m4 where lines > 0 and (normalized - surviving) / lines > 0.2
union all select member, 'LOW_COMPOSITE_SCORE', case when composite < 0.1 then 'CRITICAL' else 'WARNING' end from m4 where composite < 0.2
union all select member, 'GHOST_CONTRIBUTOR', 'WARNING' from m4 where prs >= 1 and composite < 0.15 and code < 0.1
union all select member, 'HIDDEN_CONTRIBUTOR', 'INFO' from m4 where code >= 0.75 and task <= 0.25
union all select member, 'HIGH_COMPILE_FAILURE_RATE', 'WARNING' from m4 where prs >= 3 and failed >= 0.5 * prs""")
def member_detectors(t):
    return detectors.member_flags(members(t), TH).drop("details")


@query(f"""
with {PRS}, p as (select *, additions + deletions as n from prs)
select pr, author, 'SINGLE_COMMIT_DUMP' as flag, 'WARNING' as severity from p where commits = 1 and n > 30
union all select pr, author, 'BULK_RENAME_PR', 'INFO' from p where additions >= 10 and deletions >= 10 and least(additions, deletions) > 0.8 * greatest(additions, deletions) and n > 50 and (normalized - surviving) / n > 0.3
union all select pr, author, 'COSMETIC_HEAVY_PR', 'WARNING' from p where n > 0 and 1 - surviving / n > 0.5
union all select pr, author, 'PR_DOES_NOT_COMPILE', 'WARNING' from p where not compiles""")
def pr_detectors(t):
    return detectors.pr_flags(prs(t), TH).drop("details")


@query("select o_orderkey as pr, o_custkey as author from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 10)")
def orphan_prs(t):
    p = t("orders").select(F.col("o_orderkey").alias("pr"), F.col("o_custkey").alias("author"), F.lit(True).alias("merged"))
    return detectors.orphan_prs(p, t("lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("pr"))).select("pr", "author")


@query("""
with o as (select distinct l_orderkey as pr, 'login' || l_suppkey as login from lineitem join orders on l_orderkey = o_orderkey where l_suppkey <> o_custkey % 100 + 1),
n as (select pr, login, row_number() over (partition by pr order by login) as i from o)
select pr, count(*) as n_others, string_agg(case when i <= 5 then login end, ',' order by login) as others from n group by 1""")
def author_mismatch(t):
    p = t("orders").select(F.col("o_orderkey").alias("pr"), F.concat(F.lit("LOGIN"), (F.col("o_custkey") % 100 + 1).cast("string")).alias("author"))
    c = t("lineitem").select(F.col("l_orderkey").alias("pr"), F.concat(F.lit("Login"), F.col("l_suppkey").cast("string")).alias("login"))
    return detectors.author_mismatch(p, c).withColumn("others", F.array_join("others", ","))


@query("""
with r as (select 'supplier#' || l_suppkey as login, case when l_returnflag = 'R' then 'reviewer' else 'author' end as role from lineitem)
select login, count(*) as n, string_agg(distinct role, ',' order by role) as roles from r where login not in (select 'supplier#' || s_suppkey from supplier where s_acctbal > 0) group by 1""")
def unknown_contributors(t):
    roles = t("lineitem").select(F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")).alias("login"), F.when(F.col("l_returnflag") == "R", "reviewer").otherwise("author").alias("role"), F.col("l_orderkey").alias("pr"))
    known = t("supplier").filter("s_acctbal > 0").select(F.concat(F.lit("SUPPLIER#"), F.col("s_suppkey").cast("string")).alias("value"))
    return detectors.unknown_contributors(roles, known)


@query("""
with d as (select distinct l_orderkey from lineitem where l_discount >= 0.09)
select o_custkey as assignee, count(*) as n from orders where o_orderkey not in (select * from d) and o_orderkey // 4 not in (select * from d) group by 1""")
def missing_declaration(t):
    tasks = t("orders").select(F.col("o_orderkey").alias("task"), F.floor(F.col("o_orderkey") / 4).alias("parent"), F.col("o_custkey").alias("assignee"))
    return detectors.undeclared(tasks, t("lineitem").filter("l_discount >= 0.09").select(F.col("l_orderkey").alias("task")))


@query("""
select distinct l_orderkey as pr, l_suppkey as reviewer from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'A' and o_orderstatus = 'F'""")
def approved_broken(t):
    p = t("orders").select(F.col("o_orderkey").alias("pr"), (F.col("o_orderstatus") != "F").alias("compiles"))
    reviews = t("lineitem").select(F.col("l_orderkey").alias("pr"), F.col("l_suppkey").alias("reviewer"), F.when(F.col("l_returnflag") == "A", "APPROVED").otherwise("COMMENTED").alias("state"))
    return detectors.approved_broken(p, reviews)


@query("""
with m as (select user_id as member, strftime(ts, '%Y-%m-%d') as period, avg(value) as mean, count(*) as n from events group by 1, 2),
l as (select *, lag(mean) over w as before, lag(n) over w as n_before from m window w as (partition by member order by period))
select member, period, round(mean - before, 4) as delta from l where n >= 2 and n_before >= 2 and mean - before < -5""")
def regularity_declining(t):
    s = t("events").select(F.col("user_id").alias("member"), F.date_format("ts", "yyyy-MM-dd").alias("period"), F.col("value").alias("score"))
    return detectors.declining(s, 2, -5.0).withColumn("delta", r("delta"))


FINDINGS = """f as (select o_orderkey as file, o_orderpriority as finding, 1 as s, o_custkey % 4 + 1 as e from orders),
a as (select file, finding, l_suppkey as author, count(*) as lines from f join lineitem on l_orderkey = file and l_linenumber between s and e group by 1, 2, 3),
b as (select *, lines / sum(lines) over (partition by file, finding) as share from a)"""


def _attributed(t):
    f = t("orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("finding"), F.lit(1).alias("start"), (F.col("o_custkey") % 4 + 1).alias("end"))
    return detectors.attribute_findings(f, t("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("author")))


@query(f"with {FINDINGS} select file, finding, author, lines, round(share, 6) as share from b")
def finding_attribution(t):
    return _attributed(t).select("file", "finding", "author", "lines", r("share", 6).alias("share"))


SHARES = f"""{FINDINGS}, s as (select author, share, finding, file, case when finding like '1-%' then 'CRITICAL' when finding like '2-%' then 'WARNING' else 'INFO' end as severity from b),
g as (select author, finding, file, least(sum(share), 1) as blame, max(severity) as severity, case max(severity) when 'CRITICAL' then 1.0 when 'WARNING' then 0.25 else 0.1 end as w, case max(severity) when 'CRITICAL' then 3 when 'WARNING' then 2 else 1 end as rank from s group by 1, 2, 3),
c as (select *, blame * w as contribution from g),
p as (select *, row_number() over (partition by author order by contribution desc, finding, file) as place from c)"""


def _shares(t):
    severity = F.when(F.col("finding").startswith("1-"), "CRITICAL").when(F.col("finding").startswith("2-"), "WARNING").otherwise("INFO")
    return _attributed(t).select("author", "share", F.col("finding").alias("rule_id"), F.col("file").alias("file_path"), severity.alias("severity"), F.lit("lint").alias("analyzer"), F.lit("style").alias("category"))


def _offenders(found, *names):
    """The fields of the details that do not depend on how JSON is written."""
    one = F.from_json("details", "struct<weighted:double,score:double,worst_severity:string,offenders:array<struct<rule_id:string,rule_name:string,rule_key:string,file_path:string,method_name:string,severity:string,weight:double>>>")
    o = F.transform(one["offenders"], lambda x: F.concat_ws(":", *[x[n] for n in names], x["severity"]))
    return found.select("author", "flag", "severity", r(F.coalesce(one["weighted"], one["score"]), 1).alias("weighted"), F.array_join(o, ",").alias("offenders"))


@query(f"""
with {SHARES}, w as (select author, sum(contribution) as weighted, max(rank) as rank, string_agg(case when place <= 10 then finding || ':' || file || ':' || severity end, ',' order by place) as offenders from p group by 1)
select author, 'STATIC_ANALYSIS_HOTSPOT' as flag, case rank when 3 then 'CRITICAL' when 1 then 'INFO' else 'WARNING' end as severity, round(round(weighted, 3), 1) as weighted, offenders from w where weighted >= 2""")
def static_hotspots(t):
    return _offenders(detectors.static_hotspots(_shares(t), 2.0), "rule_id", "file_path")


@query(f"""
with {SHARES}, q as (select * exclude (place, contribution), contribution * case when finding like '5-%' then 2 else 1 end as contribution from p where finding not like '4-%'),
z as (select *, row_number() over (partition by author order by contribution desc, finding, file) as place from q),
w as (select author, sum(contribution) as weighted, max(rank) as rank, string_agg(case when place <= 10 then finding || ':' || file || ':' || severity end, ',' order by place) as offenders from z group by 1)
select author, 'ARCHITECTURE_HOTSPOT' as flag, case rank when 3 then 'CRITICAL' when 1 then 'INFO' else 'WARNING' end as severity, round(round(weighted, 3), 1) as weighted, offenders from w where weighted >= 2""")
def architecture_hotspots(t):
    shares = _shares(t).withColumns({"rule_name": F.col("rule_id"), "rule_kind": F.lit("layer")})
    found = detectors.architecture_hotspots(shares, 2.0, {"4-NOT SPECIFIED": 0.0, "5-LOW": 2.0})
    return _offenders(found, "rule_name", "file_path")


@query(f"""
with {FINDINGS}, s as (select author, share, finding, file, author % 7 as method, case when finding like '1-%' then 'CRITICAL' when finding like '2-%' then 'WARNING' else 'INFO' end as severity from b),
g as (select author, file, method, least(sum(share), 1) as blame, max(case severity when 'CRITICAL' then 3 when 'WARNING' then 2 else 1 end) as rank, max(finding) as finding from s group by 1, 2, 3),
c as (select *, blame * case rank when 3 then 1.0 when 2 then 0.25 else 0.1 end as contribution, case rank when 3 then 'CRITICAL' when 2 then 'WARNING' else 'INFO' end as severity from g),
p as (select *, row_number() over (partition by author order by contribution desc, file, method) as place from c),
w as (select author, sum(contribution) as weighted, max(rank) as rank, string_agg(case when place <= 3 then file || ':m' || method || ':' || severity end, ',' order by place) as offenders from p group by 1)
select author, 'COMPLEXITY_HOTSPOT' as flag, case when weighted >= 40 or rank = 3 then 'CRITICAL' else 'WARNING' end as severity, round(round(weighted, 3), 1) as weighted, offenders from w where weighted >= 5""")
def complexity_hotspots(t):
    shares = _shares(t).withColumns({"rule_key": F.col("rule_id"), "method_name": F.concat(F.lit("m"), (F.col("author") % 7).cast("string")), "measured_value": F.lit(1.0)})
    return _offenders(detectors.complexity_hotspots(shares, 5.0, 40.0), "file_path", "method_name")


@query("""
select o_custkey as member, o_orderkey as pr, 'LAST_MINUTE_PR' as flag, cast(printf('%.1f', (epoch(date_trunc('day', o_orderdate)) + 86400 * 0.1 - epoch(o_orderdate) + o_orderkey % 5 * 1000) / 3600.0) as double) as hours from orders where o_orderpriority = '1-URGENT'""")
def last_minute_prs(t):
    at = F.col("o_orderdate").cast("timestamp")
    hours = (F.unix_seconds(F.date_trunc("day", at)) + 8640 - F.unix_seconds(at) + F.col("o_orderkey") % 5 * 1000) / 3600.0
    p = t("orders").select(
        F.col("o_custkey").alias("member"), F.col("o_orderkey").alias("pr"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("a/b").alias("repo"), hours.alias("hours"), F.col("o_orderdate").cast("string").alias("merged_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "last_minute").otherwise("early").alias("band"),
    )
    d = F.from_json("details", "struct<pr_number:bigint,hours_before_deadline:double>")
    return detectors.last_minute(p).select("member", d["pr_number"].alias("pr"), "flag", d["hours_before_deadline"].alias("hours"))


@query("""
with b as (select l_partkey as file, l_linenumber as p, l_returnflag as nf, l_extendedprice as raw, l_suppkey as a, year(l_shipdate) % 2 as v from lineitem)
select x.file, x.a as victim, y.a as actor, count(*) as n from b x join b y on x.v = 0 and y.v = 1 and x.file = y.file and x.p = y.p and x.nf = y.nf and x.raw <> y.raw and x.a <> y.a group by 1, 2, 3""")
def rewrite_detection(t):
    b = t("lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("normalized"), F.col("l_extendedprice").alias("raw"), F.col("l_suppkey").alias("author"), (F.year("l_shipdate") % 2).alias("v"))
    return detectors.rewrites(b.filter("v = 0"), b.filter("v = 1"))


# Report datasets


@query(f"""
with {PRS}, o as (select author, count(*) as prs, sum(additions + deletions) as lines from prs group by 1), f as (select author, count(*) as flags from prs where not compiles group by 1)
select c_custkey as author, c_mktsegment as name, coalesce(prs, 0) as prs, coalesce(lines, 0) as lines, coalesce(flags, 0) as flags from customer left join o on o.author = c_custkey left join f on f.author = c_custkey""")
def student_summary(t):
    p = prs(t)
    done = p.groupBy("author").agg(F.count("*").alias("prs"), F.sum(F.col("additions") + F.col("deletions")).alias("lines"))
    flagged = p.filter("not compiles").groupBy("author").agg(F.count("*").alias("flags"))
    return reports.summary(t("customer").select(F.col("c_custkey").alias("author"), F.col("c_mktsegment").alias("name")), "author", [done, flagged])


@query("""
with m as (select o_custkey as author, year(o_orderdate) as period, sum(o_totalprice) as value, count(*) as n from orders group by 1, 2)
select author, period, round(sum(value) over w, 2) as total_value, cast(sum(n) over w as bigint) as total_n from m window w as (partition by author order by period)""")
def cumulative_totals(t):
    m = t("orders").groupBy(F.col("o_custkey").alias("author"), F.year("o_orderdate").cast("bigint").alias("period")).agg(F.sum("o_totalprice").alias("value"), F.count("*").alias("n"))
    x = reports.cumulative(m, "author", "period", ["value", "n"])
    return x.select("author", "period", r("total_value", 2).alias("total_value"), "total_n")


@query("""
with h as (select user_id, 24 - hour(ts) as h from events)
select user_id, count(case when h >= 18 then 1 end) as early, count(case when h < 18 and h >= 6 then 1 end) as on_time, count(case when h < 6 then 1 end) as late, count(*) as total from h group by 1""")
def pr_timing(t):
    h = F.lit(24) - F.hour("ts")
    return reports.tier_counts(t("events"), "user_id", banded(h, [(18, "early"), (6, "on_time")], "late"), ["early", "on_time", "late"])


@query("""
with d as (select doc_id, case when n_chars < 500 then 'short' when n_chars < 3000 then 'middle' else 'long' end as tier from documents)
select doc_id, tier from (select *, row_number() over (partition by tier order by md5(cast(doc_id as varchar)), doc_id) as i from d) where i <= 5""")
def stratified_sample(t):
    tier = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    return reports.stratified_sample(t("documents").select("doc_id", tier.alias("tier")), "tier", ["doc_id"], 5)


@query("""
with a as (select p_partkey as k, p_brand || p_size as c from part where p_type <> 'PROMO'), b as (select p_partkey as k, p_brand || (case when p_size > 40 then p_size + 1 else p_size end) as c from part where p_type <> 'ECONOMY')
select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' when a.c = b.c then 'unchanged' else 'modified' end as status from a full join b on a.k = b.k""")
def version_diff(t):
    text = lambda size: F.concat("p_brand", size.cast("string")).alias("c")
    p, size = t("part"), F.col("p_size")
    old = p.filter("p_type != 'PROMO'").select(F.col("p_partkey").alias("k"), text(size))
    return reports.version_diff(old, p.filter("p_type != 'ECONOMY'").select(F.col("p_partkey").alias("k"), text(F.when(size > 40, size + 1).otherwise(size))), "k", "c")


@query("""
with x as (select user_id, epoch_us(ts) / 60e6 as m, value, lag(epoch_us(ts) / 60e6) over w as before, row_number() over w as i from events window w as (partition by user_id order by ts, value)),
g as (select user_id, count(*) as n, max(m) - min(m) as span, coalesce(max(m - before), 0) as gap, sum(value) as total, max(value) as largest, bool_and(case when i = 1 then value >= 100 else value <= 30 end) as fix from x group by 1)
select user_id, n, round(span, 3) as span_minutes, round(gap, 3) as longest_gap_minutes, round(case when span > 0 then total / span end, 6) as size_per_minute, round(case when total > 0 then largest / total end, 6) as largest_share, n > 1 and fix as fixup from g""")
def commit_rhythm(t):
    c = reports.commit_rhythm(t("events").select("user_id", "ts", "value"), "user_id", "ts", "value")
    return c.select("user_id", "n", *[r(k, d).alias(k) for k, d in (("span_minutes", 3), ("longest_gap_minutes", 3), ("size_per_minute", 6), ("largest_share", 6))], "fixup")


# Scores, text and resolution


TAIL = "lgamma(a + b) - lgamma(a + 1) - lgamma(b) + a * ln(x) + b * ln(1 - x)"


@query(f"""
with m as (select o_custkey, strftime(o_orderdate, '%Y-%m') as month, sum(o_totalprice) as v from orders group by 1, 2),
i as (select o_custkey, v, row_number() over (partition by o_custkey order by month) - 1 as i from m),
t as (select o_custkey, count(*) as n, case when count(*) > 1 then regr_slope(v, i) end as slope, case when count(*) > 1 then coalesce(regr_r2(v, i), 1) end as r2, stddev_pop(v) / avg(v) as cv from i group by 1),
s as (select *, 1 - r2 > (n / 2.0) / ((n - 1) / 2.0 + 2) as swap from t),
k as (select *, case when swap then r2 else 1 - r2 end as x, case when swap then 0.5 else (n - 2) / 2.0 end as a, case when swap then (n - 2) / 2.0 else 0.5 end as b from s),
p as (select *, case when n < 2 then 0.5 when n = 2 or 1 - r2 <= 1e-15 then 0 else exp({TAIL}) * list_sum(list_transform(range(400), lambda j: exp(lgamma(a + b + j) - lgamma(a + b) - lgamma(a + 1 + j) + lgamma(a + 1) + j * ln(x)))) end as tail from k),
q as (select o_custkey, n, slope, cv, case when n > 2 and 1 - r2 > 1e-15 and swap then 1 - tail else tail end as p_value from p)
select o_custkey, n, case when n < 2 then 'insufficient_data' when cv < 0.2 then 'steady' when slope > 0 and p_value < 0.15 then 'growing' when slope < 0 and p_value < 0.15 then 'declining' when cv > 0.4 then 'sporadic' else 'steady' end as "class", round(p_value, 6) as p_value from q""")
def trajectory_class(t):
    m = t("orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    return stats.trajectory(m, ["o_custkey"], "month", "v").select("o_custkey", "n", "class", r("p_value", 6).alias("p_value"))


@query("""
with x as (select l_quantity as a, l_discount * 500 as b from lineitem),
y as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb from x)
select count(*) as n, round(corr(ra, rb), 6) as spearman, round(avg(abs(a - b)), 6) as mae, round(avg(case when floor(a / 5 + 0.5) = floor(b / 5 + 0.5) then 1.0 else 0.0 end), 6) as on_grid from y""")
def score_agreement(t):
    x = stats.agreement(t("lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b")), "a", "b", 5.0)
    return x.select("n", *[r(c, 6).alias(c) for c in ("spearman", "mae", "on_grid")])


@query(f"""
with w as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2 and x not in {T.STOP_WORDS}) as w from documents)
select doc_id, array_to_string(w, ' ') as title, cast(len(w) as bigint) as n from w""")
def title_tokens(t):
    w = T.title_tokens(F.col("text"))
    return t("documents").select("doc_id", F.array_join(w, " ").alias("title"), F.size(w).cast("bigint").alias("n"))


@query("""
select l_orderkey, l_linenumber, sha1('tool|' || l_returnflag || '|' || l_partkey || '|' || l_linenumber || '|' || coalesce(l_linestatus, '')) as id from lineitem""")
def finding_fingerprints(t):
    i = T.finding_id(F.lit("tool"), F.col("l_returnflag"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_linestatus"))
    return t("lineitem").select("l_orderkey", "l_linenumber", i.alias("id"))


@query("""
with c as (select distinct split_part(p_type, ' ', 1) as prefix from part where p_size > 0 union select distinct p_type from part where p_size % 3 = 0),
m as (select p_partkey, prefix, row_number() over (partition by p_partkey order by length(prefix) desc) as i from part join c on starts_with(p_type, prefix))
select p_partkey, upper(prefix) as name, cast(length(prefix) % 3 as bigint) as category from part left join (select * from m where i = 1) using (p_partkey)""")
def technology_catalog(t):
    p = t("part")
    c = p.filter("p_size > 0").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("prefix")).union(p.filter("p_size % 3 = 0").select("p_type")).distinct()
    c = c.select("prefix", F.upper("prefix").alias("name"), (F.length("prefix") % 3).cast("bigint").alias("category"))
    return relational.classify_by_prefix(p.select("p_partkey", "p_type"), "p_type", c).select("p_partkey", "name", "category")


@query("""
with l as (select l_orderkey as pr, 'm' || l_suppkey as assignee, sum(l_quantity) as points from lineitem where l_returnflag = 'A' group by 1, 2),
b as (select pr, assignee, points, row_number() over w as i, lead(points) over w as second from l window w as (partition by pr order by points desc, assignee))
select o_orderkey as pr, coalesce(assignee, 'c' || c_custkey, 'kept') as author, case when assignee is not null then 'task' when c_custkey is not null then 'login' else 'kept' end as strategy, coalesce(second = points, false) as ambiguous
from orders left join (select * from b where i = 1) b on pr = o_orderkey left join customer on c_custkey = o_custkey and c_acctbal > 0""")
def author_resolution(t):
    login = lambda key: F.concat(F.lit("Login"), F.col(key).cast("string"))
    p = t("orders").select(F.col("o_orderkey").alias("pr"), login("o_custkey").alias("login"), F.lit(None).cast("string").alias("email"), F.lit("kept").alias("author"))
    links = t("lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("pr"), F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("assignee"), F.col("l_quantity").alias("points"))
    known = t("customer").filter("c_acctbal > 0").select(F.lit("login").alias("kind"), F.upper(login("c_custkey")).alias("value"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("member"))
    return relational.resolve_author(p, links, known)


@query("""
with m as (select user_id as member, count(*) as n, count(case when hour(ts) >= 17 then 1 end) / cast(count(*) as double) as cramming, avg(value) / 12 as documentation, count(case when event_type = 'purchase' then 1 end) / cast(count(*) as double) as review,
  count(case when hour(ts) < 5 then 1 end) / cast(count(*) as double) as punctuality, max(value) / 400 as mutation from events group by 1)
select member, 'CRAMMING' as flag, 'WARNING' as severity from m where cramming > 0.3
union all select member, 'LOW_DOC_SCORE', 'INFO' from m where documentation < 2
union all select member, 'LOW_REVIEWS', case when review < 0.1 then 'CRITICAL' else 'WARNING' end from m where review < 0.2
union all select member, 'ALL_PRS_LATE', 'WARNING' from m where n >= 2 and punctuality < 0.2
union all select member, 'LOW_MUTATION_SCORE', case when mutation < 0.3 then 'WARNING' else 'INFO' end from m where mutation < 0.5""")
def process_detectors(t):
    h, share = F.hour("ts"), lambda c: F.avg(c.cast("double"))
    m = t("events").groupBy(F.col("user_id").alias("member")).agg(
        F.count("*").alias("timed_prs"), share(h >= 17).alias("cramming"), (F.avg("value") / 12).alias("documentation"), share(F.col("event_type") == "purchase").alias("review"),
        share(h < 5).alias("punctuality"), (F.max("value") / 400).alias("mutation"),
    )
    return detectors.process_flags(m, detectors.Thresholds(cramming=0.3)).drop("details")


@query("""
select distinct l_orderkey as pr, o_custkey % 100 + 1 as author, l_suppkey as assignee from lineitem join orders on l_orderkey = o_orderkey where l_linestatus = 'F' and o_orderstatus = 'F' and l_suppkey <> o_custkey % 100 + 1""")
def foreign_merges(t):
    p = t("orders").select(F.col("o_orderkey").alias("pr"), (F.col("o_custkey") % 100 + 1).alias("author"), (F.col("o_orderstatus") == "F").alias("merged"))
    return detectors.foreign_merges(p, t("lineitem").select(F.col("l_orderkey").alias("pr"), F.col("l_suppkey").alias("assignee"), (F.col("l_linestatus") == "F").alias("done")))


@query("""
with h as (select distinct sha256(text) as h, source from documents where text is not null), p as (select x.source as a, y.source as b, count(*) as shared from h x join h y on x.h = y.h and x.source < y.source group by 1, 2)
select 'PROJECT_' || a as subject, 'CROSS_TEAM_SIMILARITY' as flag, 'CRITICAL' as severity, 'PROJECT_' || b as other, shared from p union all select 'PROJECT_' || b, 'CROSS_TEAM_SIMILARITY', 'CRITICAL', 'PROJECT_' || a, shared from p""")
def cross_team_flags(t):
    return detectors.similarity_flags(relational.shared_pairs(t("documents").filter("text is not null").select(F.sha2("text", 256).alias("h"), "source"), "h", "source"))

"""Queries on records of other tools and on maintenance: diffs, blame, SARIF and mutation reports, purges, flags of a run, frozen concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators import axes, detectors, incremental, lines, maintenance
from cohortlens.plans.queries import VERSIONS, _versions, query, r
from cohortlens.sources import curriculum, parsers

#: A total order of an order's line items.
ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
COLUMNS = ORDER.split(", ")


def _joined(df: DataFrame, by: str, order: list[str], text) -> DataFrame:
    """by, text: the lines of each group in order."""
    x = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("__line")))).alias("x"))
    return x.select(by, F.array_join(F.transform("x", lambda s: s["__line"]), "\n").alias("text"))


@query(f"""
with x as (select *, row_number() over (partition by l_orderkey, l_returnflag order by {ORDER}) - 1 as position,
  count(*) filter (where l_returnflag <> 'A') over w as old_no, count(*) filter (where l_returnflag <> 'R') over w as new_no from lineitem window w as (partition by l_orderkey order by {ORDER} rows unbounded preceding))
select l_orderkey as pr, 'orders/' || l_orderkey || '.txt' as path, 0 as hunk, case when l_returnflag = 'R' then '-' else '+' end as sign, cast(position as integer) as position, cast(case when l_returnflag = 'R' then old_no else new_no end as integer) as line_no,
  'item ' || l_partkey || ' by ' || l_suppkey as line from x where l_returnflag <> 'N'""")
def parsed_diffs(t):
    """An order's line items as a unified diff: returned ones are removed, accepted ones added, others context."""
    x = t("lineitem")
    sign = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(" ")
    body = _joined(x, "l_orderkey", COLUMNS, F.concat(sign, F.format_string("item %d by %d", "l_partkey", "l_suppkey")))
    n = x.groupBy(F.col("l_orderkey").alias("k")).agg(F.count_if(F.col("l_returnflag") != "A").alias("old"), F.count_if(F.col("l_returnflag") != "R").alias("new"))
    head = F.format_string("diff --git a/orders/%1$d.txt b/orders/%1$d.txt\n--- a/orders/%1$d.txt\n+++ b/orders/%1$d.txt\n@@ -1,%2$d +1,%3$d @@\n", "l_orderkey", "old", "new")
    diffs = body.join(n, F.col("l_orderkey") == F.col("k")).select(F.col("l_orderkey").alias("pr"), F.concat(head, F.col("text")).alias("diff"))
    return parsers.diff_lines(diffs, "diff")


SHA = "md5(cast(l_orderkey as varchar)) || substr(md5(cast(l_orderkey as varchar)), 1, 8)"


@query(f"""
select l_partkey as file, cast(row_number() over (partition by l_partkey order by l_orderkey, {ORDER}) as integer) as line_no, {SHA} as commit, 's' || l_suppkey || '@example.org' as author_email,
  cast(epoch(l_shipdate) as bigint) as author_time, 'price ' || cast(l_quantity as integer) as line from lineitem""")
def parsed_blame(t):
    """A part's line items as porcelain blame; an order's first line in a part names author and time, later ones only the commit."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", *COLUMNS)
    sha = F.md5(F.col("l_orderkey").cast("string"))
    x = t("lineitem").withColumns({"no": F.row_number().over(w), "sha": F.concat(sha, F.left(sha, F.lit(8)))})
    seconds = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * 86400 + F.hour("l_shipdate") * 3600 + F.minute("l_shipdate") * 60 + F.second("l_shipdate")
    said = F.concat(F.lit("\nauthor someone\nauthor-mail <s"), F.col("l_suppkey").cast("string"), F.lit("@example.org>\nauthor-time "), seconds.cast("string"))
    # Line items of an order in a part differ in author, so each has its own header.
    entry = F.concat(F.col("sha"), F.lit(" "), F.col("no").cast("string"), F.lit(" "), F.col("no").cast("string"), said, F.lit("\nsummary x\n\tprice "), F.col("l_quantity").cast("int").cast("string"))
    return parsers.blame_lines(_joined(x, "l_partkey", ["no"], entry).withColumnRenamed("l_partkey", "file"), "text")


@query(f"""
select l_suppkey as batch, 'tool' || s_nationkey as tool, 'rule' || l_linenumber as rule,
  case when l_linestatus = 'O' then case when l_discount > 0.05 then 'CRITICAL' else 'INFO' end when l_linenumber <= 3 then 'CRITICAL' else 'WARNING' end as severity,
  'found in ' || l_orderkey as message, 'src/' || l_partkey || '.java' as path, cast(l_quantity as bigint) as start_line, cast(case when l_returnflag = 'R' then l_quantity + 5 else l_quantity end as bigint) as end_line
from lineitem join supplier on s_suppkey = l_suppkey""")
def sarif_findings(t):
    """A supplier's line items as SARIF: results without a level take the rule's, else warning."""
    level = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_discount") > 0.05, "error").otherwise("note"))
    region = F.struct(F.col("l_quantity").cast("bigint").alias("startLine"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("bigint") + 5).alias("endLine"))
    place = F.struct(F.struct(F.struct(F.concat(F.lit("file://src/"), F.col("l_partkey").cast("string"), F.lit(".java")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.concat(F.lit("rule"), F.col("l_linenumber").cast("string")).alias("ruleId"), level.alias("level"), F.struct(F.concat(F.lit("found in "), F.col("l_orderkey").cast("string")).alias("text")).alias("message"), F.array(place).alias("locations"))
    rules = F.array(*[F.struct(F.lit(f"rule{i}").alias("id"), F.struct(F.lit("error").alias("level")).alias("defaultConfiguration")) for i in (1, 2, 3)])
    x = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_suppkey", "s_nationkey").agg(F.collect_list(result).alias("results"))
    run = F.struct(F.struct(F.struct(F.concat(F.lit("tool"), F.col("s_nationkey").cast("string")).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.col("results"))
    return parsers.sarif(x.select(F.col("l_suppkey").alias("batch"), F.to_json(F.struct(F.array(run).alias("runs"))).alias("text")), "text")


@query("""
select l_partkey as part, count(*) as total, count(*) filter (where l_returnflag = 'R') as killed, count(*) filter (where l_returnflag = 'N' and l_linenumber = 1) as non_viable,
  round(count(*) filter (where l_returnflag = 'R') / cast(nullif(count(*) - count(*) filter (where l_returnflag = 'N' and l_linenumber = 1), 0) as double), 6) as score from lineitem group by 1""")
def mutation_reports(t):
    killed = (F.col("l_returnflag") == "R").cast("string")
    status = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), "NON_VIABLE").when(F.col("l_returnflag") == "R", "KILLED").otherwise("SURVIVED")
    one = F.concat(F.lit("<mutation detected='"), killed, F.lit("' status='"), status, F.lit("'><line>1</line></mutation>"))
    x = _joined(t("lineitem"), "l_partkey", ["l_orderkey", *COLUMNS], one)
    m = parsers.mutation_totals(F.concat(F.lit("<mutations>"), F.col("text"), F.lit("</mutations>")))
    return x.select(F.col("l_partkey").alias("part"), *[r(v, 6).alias(k) if k == "score" else v.cast("bigint").alias(k) for k, v in m.items()])


@query("""
with c as (select c_custkey from customer where c_mktsegment = 'MACHINERY'), o as (select o_orderkey from orders where o_custkey in (from c))
select 'customer' as name, (select count(*) from customer) as rows, (select count(*) from c) as doomed union all select 'orders', (select count(*) from orders), (select count(*) from o)
union all select 'lineitem', (select count(*) from lineitem), (select count(*) from lineitem where l_orderkey in (from o)) union all select 'part', (select count(*) from part), 0""")
def purge_dry_run(t):
    tables = {n: t(n) for n in ("customer", "orders", "lineitem", "part")}
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    return maintenance.doomed_counts(tables, maintenance.purge(tables, links, "customer", t("customer").filter("c_mktsegment = 'MACHINERY'")))


@query(VERSIONS + " select * from a union all select b.* from b where not exists (select 1 from a where a.c_custkey = b.c_custkey)")
def upsert_ignore(t):
    old, new = _versions(t)
    return maintenance.upsert(old, new, ["c_custkey"], "ignore")


@query(VERSIONS + " select * from a where c_mktsegment not in (select c_mktsegment from b) union all select * from b")
def replaced_slices(t):
    old, new = _versions(t)
    return maintenance.replace_slice(old, new, ["c_mktsegment"])


FOUND = """
with old as (select o_orderpriority as sprint, o_custkey as subject, 'OLD' as flag from orders where o_orderstatus = 'P' union all select o_orderpriority, o_custkey, 'LARGE' from orders where o_totalprice > 150000),
large as (select o_orderpriority as sprint, o_custkey as subject, 'LARGE' as flag from orders where o_totalprice > 200000 and o_orderpriority in ('1-URGENT', '2-HIGH')),
open as (select o_orderpriority as sprint, o_custkey as subject, 'OPEN' as flag from orders where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH'))"""


def _flags(t):
    o = t("orders").withColumns({"sprint": F.col("o_orderpriority"), "subject": F.col("o_custkey")})
    some = lambda where, name: o.filter(where).select("sprint", "subject", F.lit(name).alias("flag"))
    old = some("o_orderstatus = 'P'", "OLD").unionByName(some("o_totalprice > 150000", "LARGE"))
    scope = o.select("sprint").filter(F.col("sprint").isin("1-URGENT", "2-HIGH"))
    inside = " and o_orderpriority in ('1-URGENT', '2-HIGH')"
    return old, scope, [some("o_totalprice > 200000" + inside, "LARGE"), some("o_orderstatus = 'O'" + inside, "OPEN")]


@query(FOUND + """
select sprint, flag, count(*) as n, count(distinct subject) as subjects from (select * from old where sprint not in ('1-URGENT', '2-HIGH') union all select * from large union all select * from open) group by 1, 2""")
def dispatched_flags(t):
    old, scope, found = _flags(t)
    return detectors.dispatch(old, scope, ["sprint"], found).groupBy("sprint", "flag").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@query(FOUND + """
select sprint, flag, count(*) as n, count(distinct subject) as subjects from (select * from old where flag = 'OLD' or sprint not in ('1-URGENT', '2-HIGH') union all select * from large) group by 1, 2""")
def redetected_flags(t):
    old, scope, found = _flags(t)
    return detectors.redetect(old, scope, ["sprint"], ["LARGE"], found[:1]).groupBy("sprint", "flag").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@query("""
with live as (select event_type as category, 'u' || user_id as value, min(day(ts)) as taught from events group by 1, 2),
snap as (select distinct 1 as sprint, event_type as category, 'u' || user_id as value from events where value > 200)
select cast(sprint as bigint) as sprint, category, value from snap union all select 2, category, value from live where taught <= 3""")
def frozen_concepts(t):
    """Sprint 1 is frozen and stays as it is; sprint 2 takes what was taught by its third day."""
    e = t("events").select(F.col("event_type").alias("category"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("value"), F.dayofmonth("ts").alias("taught"), F.col("value").alias("v"))
    live = e.groupBy("category", "value").agg(F.min("taught").alias("taught"))
    snapshot = e.filter("v > 200").select(F.lit(1).cast("bigint").alias("sprint"), "category", "value").distinct()
    return incremental.freeze(incremental.freeze(snapshot, live, 1, 30), live, 2, 3)


@query("""
with p as (select distinct c.c_nationkey as a, s.s_nationkey as b from lineitem join orders on l_orderkey = o_orderkey join customer c on c_custkey = o_custkey join supplier s on s_suppkey = l_suppkey),
n as (select n_nationkey as k, 'shop.region' || n_regionkey || '.nation' || n_nationkey || '.main' as package, case when n_nationkey in (0, 7) then 'core' else 'layer ' || n_regionkey end as layer, n_regionkey as g from nation),
x as (select 'f' || a as file, x.package, y.package as target, x.layer as source, y.layer as used from p join n x on x.k = a join n y on y.k = b)
select * from x where source <> used and not (used = 'core' and source <> 'core') and not (source = 'layer 0' and used = 'layer 1') and not (source = 'layer 1' and used = 'layer 2')""")
def layer_violations(t):
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    pairs = x.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()
    package = F.format_string("shop.region%d.nation%d.main", "n_regionkey", "n_nationkey")
    known = t("nation").select(F.col("n_nationkey").alias("k"), package.alias("p"))
    imports = pairs.join(known, F.col("a") == F.col("k")).select(F.format_string("f%d", "a").alias("file"), F.col("p").alias("package"), "b").join(known, F.col("b") == F.col("k")).select("file", "package", F.col("p").alias("target"))
    layers = t("region").select(F.format_string("layer %d", "r_regionkey").alias("layer"), F.format_string("shop.region%d", "r_regionkey").alias("prefix"))
    core = t("nation").filter("n_nationkey in (0, 7)").select(F.lit("core").alias("layer"), F.format_string("shop.region%d.nation%d", "n_regionkey", "n_nationkey").alias("prefix"))
    allowed = t("region").select(F.format_string("layer %d", "r_regionkey").alias("layer"), F.lit("core").alias("may")).unionByName(
        t("region").filter("r_regionkey < 2").select(F.format_string("layer %d", "r_regionkey").alias("layer"), F.format_string("layer %d", F.col("r_regionkey") + 1).alias("may"))
    )
    return detectors.layer_violations(imports, layers.unionByName(core), allowed)


@query("""
with c as (select l_orderkey as pr, max(case when l_linenumber = 1 and l_returnflag <> 'N' then l_partkey end) as m, max(case when l_linenumber = 2 and l_returnflag <> 'N' then l_partkey end) as p, max(case when l_linenumber = 3 then l_partkey end) as r
  from lineitem where l_linenumber <= 3 group by 1)
select pr, coalesce(m, p, r) as base, case when m is not null then null when coalesce(p, r) is not null then 'base_fallback' else 'no_base_candidate' end as problem from c""")
def base_commits(t):
    kind = F.element_at(F.array(*map(F.lit, ("merge_base", "parent", "root"))), F.col("l_linenumber"))
    x = t("lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("pr"), kind.alias("kind"), F.when((F.col("l_returnflag") != "N") | (F.col("l_linenumber") == 3), F.col("l_partkey")).alias("sha"))
    return lines.base_commit(x)


@query("""
with m as (select l_orderkey as pr, arg_max(l_partkey, (l_shipdate, l_partkey)) as last, min(l_partkey) as merge_sha from lineitem group by 1)
select pr from m where last = merge_sha""")
def unchanged_pull_requests(t):
    x = t("lineitem").select(F.col("l_orderkey").alias("pr"), F.col("l_shipdate").alias("at"), F.col("l_partkey").alias("sha"))
    return lines.unchanged_since(x.groupBy("pr").agg(F.min("sha").alias("merge_sha")), x)


# Axes, statements and diagnostics

TEAMS = "select c_custkey as member, c_nationkey as project from customer"
SPRINTS = "('1-URGENT', '2-HIGH', '3-MEDIUM')"


def _members(t):
    return t("customer").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("project"))


def _sprints(t):
    return t("orders").filter(f"o_orderpriority in {SPRINTS}").select(F.col("o_orderpriority").alias("sprint")).distinct()


@query(f"""
with m as ({TEAMS}), q as (select o_custkey as member, o_orderpriority as sprint, case when o_orderstatus <> 'P' then o_totalprice / 1000 end as mi, case when o_orderstatus = 'F' then 1.0 else 0.0 end as over from orders where o_orderpriority in {SPRINTS}),
a as (select project, avg(mi) as v, avg(over) as over_10 from q join m using (member) where mi is not null group by 1),
u as (select distinct l_orderkey as pr, l_suppkey % 100 as member from lineitem), s as (select l_orderkey as pr, o_orderpriority as sprint, avg(l_discount) as score from lineitem join orders on o_orderkey = l_orderkey where o_orderpriority in {SPRINTS} group by 1, 2),
k as (select project, avg(score) as mutation from s join u using (pr) join m using (member) group by 1)
select project, round(v, 4) as value, round(over_10, 6) as over_10, round(mutation, 6) as mutation, v is not null as present from (select distinct project from m) left join a using (project) left join k using (project)""")
def code_quality_axis(t):
    o = t("orders")
    quality = o.select(F.col("o_custkey").alias("member"), F.col("o_orderpriority").alias("sprint"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000).alias("maintainability"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("over_10"))
    x = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    mutations = x.groupBy(F.col("l_orderkey").alias("pr"), F.col("o_orderpriority").alias("sprint")).agg(F.avg("l_discount").alias("score"))
    authors = t("lineitem").select(F.col("l_orderkey").alias("pr"), (F.col("l_suppkey") % 100).alias("member")).distinct()
    got = axes.code_quality_raw(quality, mutations, authors, _members(t), _sprints(t))
    return got.select("project", r("value").alias("value"), r("over_10", 6).alias("over_10"), r("mutation", 6).alias("mutation"), "present")


@query(f"""
with m as ({TEAMS}), s as (select o_custkey as member, case when o_totalprice > 50000 then o_totalprice / 500000 end as rate, case when o_orderstatus = 'O' then cast(floor(o_totalprice / 10000) - 10 as bigint) end as points from orders where o_orderpriority in {SPRINTS}),
w as (select project, sum(rate * greatest(coalesce(points, 1), 0)) / nullif(sum(greatest(coalesce(points, 1), 0)), 0) as v from s join m using (member) where rate is not null group by 1)
select project, round(v, 6) as value, v is not null as present from (select distinct project from m) left join w using (project)""")
def survival_axis(t):
    price = F.col("o_totalprice")
    s = t("orders").select(F.col("o_custkey").alias("member"), F.col("o_orderpriority").alias("sprint"), F.when(price > 50000, price / 500000).alias("rate"), F.when(F.col("o_orderstatus") == "O", F.floor(price / 10000) - 10).alias("points"))
    return axes.survival_raw(s, _members(t), _sprints(t)).withColumn("value", r("value", 6))


#: An order is a task of its customer; its line items' parts are its pull requests, whose statements are their size.
TASKS = """
with t as (select o_orderkey as task, o_custkey as member, o_orderpriority as sprint, case when o_totalprice > 30000 then cast(floor(o_totalprice / 20000) as bigint) end as points from orders where o_orderstatus <> 'P' and o_orderpriority <> '5-LOW'),
l as (select distinct l_orderkey as task, l_partkey as pr from lineitem), s as (select p_partkey as pr, p_size as statements from part),
x as (select t.*, pr, statements, coalesce(points, 0) as p from t join l using (task) join s using (pr))"""


def _tasks(t):
    o = t("orders")
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "USER_STORY").otherwise("TASK")
    tasks = o.select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("member"), F.col("o_orderpriority").alias("sprint"), F.when(F.col("o_totalprice") > 30000, F.floor(F.col("o_totalprice") / 20000)).alias("points"), kind.alias("type"), F.when(F.col("o_orderstatus") != "P", "DONE").otherwise("OPEN").alias("status"))
    links = t("lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("pr")).distinct()
    return tasks, links, t("part").select(F.col("p_partkey").alias("pr"), F.col("p_size").alias("statements")).join(o.select(F.col("o_orderpriority").alias("sprint")).distinct())  # a few sprints


@query(TASKS + """,
w as (select *, case when sum(p) over k > 0 then p / sum(p) over k else 1.0 / count(*) over k end as w from x window k as (partition by pr, sprint))
select task, member, points, round(sum(statements * w), 6) as statements from w group by 1, 2, 3""")
def task_statements(t):
    return axes.task_statements(*_tasks(t)).withColumn("statements", r("statements", 6))


@query(TASKS + """,
p as (select pr, sprint, any_value(statements) as statements, cast(sum(p) as bigint) as points from x group by 1, 2), d as (select *, case when points > 0 then statements / cast(points as double) end as density from p),
b as (select p_brand as project, p_partkey as pr, p_size * 3 as additions from part), y as (select * from d join b using (pr)),
g as (select project, sprint, median(density) as med from y group by 1, 2), e as (select y.*, med, abs(density - med) as dev from y join g using (project, sprint) where med is not null),
sc as (select project, sprint, coalesce(nullif(median(dev), 0), nullif(avg(dev), 0)) as scale from e group by 1, 2),
a as (select pr, string_agg(member, ',' order by member) as authors from (select distinct l_partkey as pr, 's' || l_suppkey as member from lineitem) group by 1)
select project, pr, sprint, coalesce(authors, '') as authors, additions, statements, points, round(density, 6) as density, round((density - med) / scale, 5) as z, coalesce(abs((density - med) / scale) > 3, false) as outlier from e join sc using (project, sprint) left join a using (pr)""")
def pull_request_sheet(t):
    prs = t("part").select(F.col("p_partkey").alias("pr"), F.col("p_brand").alias("project"), (F.col("p_size") * 3).alias("additions"), F.lit(0).alias("deletions"))
    authors = t("lineitem").select(F.col("l_partkey").alias("pr"), F.format_string("s%d", "l_suppkey").alias("member"))
    x = axes.pull_request_sheet(prs, axes.pr_statements(*_tasks(t)), authors).drop("deletions")
    return x.withColumns({"density": r("density", 6), "z": r("z", 5)})


@query("""
with p as (select l_suppkey as repo, l_partkey as number, l_orderkey * 10 + l_linenumber as pr, l_quantity as additions, l_linestatus, l_returnflag, l_discount, count(*) over (partition by l_suppkey, l_partkey) > 1 as duplicate from lineitem),
x as (select *, case when l_returnflag <> 'N' then additions end as stored, case when l_discount < 0.1 then case when l_discount = 0 then 0 when l_linestatus = 'O' then additions + 1 else additions end end as lat from p)
select repo, number, pr, duplicate, case when lat is null then 'not_computed' when stored is null then 'not_stored' when lat <> stored then 'differs' when lat = 0 then 'no_lines' end as problem, count(*) as n from x group by all""")
def line_diagnostics(t):
    x = t("lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("number"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pr0"), F.col("l_quantity").alias("additions"), "l_linestatus", "l_returnflag", "l_discount", F.struct(*COLUMNS, "l_orderkey", "l_shipdate", "l_discount", "l_returnflag", "l_quantity", "l_tax").alias("pr"))
    measured = lambda v: [v.alias(c) for c in ("lat", "lar", "ls")]
    lat = F.when(F.col("l_discount") == 0, 0.0).when(F.col("l_linestatus") == "O", F.col("additions") + 1).otherwise(F.col("additions"))
    stored = x.filter("l_returnflag != 'N'").select("pr", *measured(F.col("additions")))
    got = axes.line_diagnostics(x.select("pr", "repo", "number", "additions"), stored, x.filter("l_discount < 0.1").select("pr", *measured(lat)))
    return got.groupBy("repo", "number", (F.col("pr.l_orderkey") * 10 + F.col("pr.l_linenumber")).alias("pr"), "duplicate", "problem").agg(F.count("*").alias("n"))


@query("""
with t as (select c_nationkey as project, count(distinct o_custkey) as members, count(*) as tasks, count(*) filter (where o_orderstatus = 'F') as done, coalesce(sum(case when o_orderstatus = 'F' then 1 end), 0) as points from orders join customer on c_custkey = o_custkey group by 1),
f as (select s_nationkey as project, count(*) filter (where l_returnflag = 'R') as critical, count(*) filter (where l_returnflag = 'A') as warning from lineitem join supplier on s_suppkey = l_suppkey group by 1),
k as (select s_nationkey as project, string_agg(distinct p_type, ',' order by p_type) as technologies from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by 1)
select n_nationkey as project, coalesce(members, 0) as members, coalesce(tasks, 0) as tasks, coalesce(done, 0) as done, cast(coalesce(points, 0) as bigint) as points, coalesce(critical, 0) as critical, coalesce(warning, 0) as warning, coalesce(technologies, '') as technologies
from nation left join t on t.project = n_nationkey left join f on f.project = n_nationkey left join k on k.project = n_nationkey""")
def project_diagnostics(t):
    tasks = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("project"), F.col("o_custkey").alias("member"), F.when(F.col("o_orderstatus") == "F", "DONE").alias("status"), F.lit(1).alias("points"))
    x = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    severity = F.when(F.col("l_returnflag") == "R", "CRITICAL").when(F.col("l_returnflag") == "A", "WARNING").otherwise("INFO")
    return axes.project_diagnostics(t("nation").select(F.col("n_nationkey").alias("project")), tasks, x.select(F.col("s_nationkey").alias("project"), severity.alias("severity")), x.select(F.col("s_nationkey").alias("project"), F.col("p_type").alias("name")))


# What files use beyond a course


@query(f"""
with x as (select 'p' || l_partkey || '.java' as path, row_number() over (partition by l_partkey order by l_orderkey, {ORDER}) as line, l_returnflag as f, 'org.junit.T' || l_suppkey as v, l_linenumber as i from lineitem),
found as (select path, 'test_framework' as kind, 'HIGH' as severity, v as value, line from x where f = 'R' union all select path, 'test_framework', 'HIGH', 'Mock', line from x where f = 'A' and i < 4
  union all select path, 'design_patterns', 'MEDIUM', 'getInstance', line from x where f = 'N'
  union all select path, 'unlisted_import', 'LOW', v, line from x where f = 'R' and v not in (select 'org.junit.T' || s_suppkey from supplier where s_acctbal > 5000)
  union all select path, 'unlisted_annotation', 'LOW', 'Mock', line from x where f = 'A' and i < 4)
select path, kind, severity, value, cast(min(line) as integer) as line from found group by all""")
def beyond_curriculum(t):
    """A part's line items are the lines of a file: an import, an annotation (Entity, which is taught, or Mock) or a call."""
    line = F.when(F.col("l_returnflag") == "R", F.format_string("import org.junit.T%d;", "l_suppkey")).when(F.col("l_returnflag") == "A", F.when(F.col("l_linenumber") < 4, "@Mock").otherwise("@Entity")).otherwise("  x = Helper.getInstance();")
    files = _joined(t("lineitem"), "l_partkey", ["l_orderkey", *COLUMNS], line).select(F.format_string("p%d.java", "l_partkey").alias("path"), "text")
    allowed = t("supplier").filter("s_acctbal > 5000").select(F.lit("import").alias("category"), F.format_string("org.junit.T%d", "s_suppkey").alias("value"))
    taught = t("region").select(F.lit("annotation").alias("category"), F.lit("Entity").alias("value"))
    return curriculum.beyond_curriculum(files, allowed.unionByName(taught))

"""Queries on stores compared and kept in step, exports, anchors and lines shared among members."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col as c

from cohortlens.operators import cohort, lines, maintenance
from cohortlens.plans.queries import VERSIONS, _versions, query, r
from cohortlens.sources import exports


@query("""
select 'customer' as name, (select count(*) from customer where c_mktsegment <> 'FURNITURE') as rows_a, (select count(*) from customer where c_mktsegment <> 'MACHINERY') as rows_b,
  case when (select count(*) from customer where c_mktsegment <> 'FURNITURE') = (select count(*) from customer where c_mktsegment <> 'MACHINERY') then 'CHECKSUM' else 'COUNT' end as status
union all select 'orders', count(*), count(*), 'CHECKSUM' from orders union all select 'part', count(*), count(*), 'OK' from part
union all select 'lineitem', count(*), count(*), 'OK' from lineitem union all select 'nation', null, null, 'ONLY-A' union all select 'region', null, null, 'ONLY-B'""")
def compared_stores(t):
    """A store against a later one: rows gone, a changed column, one that is ignored, rows in another order, tables of one side only."""
    old, new = _versions(t)
    changed = t("orders").withColumn("o_totalprice", c("o_totalprice") + F.when(c("o_orderkey") == 0, 1).otherwise(0))
    a = {"customer": old, "orders": t("orders"), "part": t("part"), "lineitem": t("lineitem"), "nation": t("nation")}
    b = {"customer": new, "orders": changed, "part": t("part").withColumn("p_size", c("p_size") + 1), "lineitem": t("lineitem").repartition("l_orderkey", "l_linenumber"), "region": t("region")}
    return maintenance.compare(a, b, {"part": ("p_size",)})


@query("""
select o_orderkey, 'o_orderstatus' as "column", o_orderstatus as a, case when o_orderkey % 14 = 0 then null else 'X' end as b from orders where o_orderkey % 7 = 0
union all select o_orderkey, 'o_custkey', cast(o_custkey as varchar), cast(o_custkey + 1 as varchar) from orders where o_orderkey % 5 = 0""")
def changed_cells(t):
    """Orders against a later version with other keys, states and, within a tolerance, prices."""
    x = t("orders")
    state = F.when(c("o_orderkey") % 14 == 0, F.lit(None).cast("string")).when(c("o_orderkey") % 7 == 0, "X").otherwise(c("o_orderstatus"))
    later = x.withColumns({
        "o_orderstatus": state,
        "o_custkey": F.when(c("o_orderkey") % 5 == 0, c("o_custkey") + 1).otherwise(c("o_custkey")),
        "o_totalprice": c("o_totalprice") * (1 + 1e-9), "o_orderpriority": F.lit("ignored"),
    })
    return maintenance.cell_diffs(x, later, ["o_orderkey"], 1e-6, ("o_orderpriority",))


@query("""
select o_orderkey, o_orderpriority from orders where o_orderpriority not in ('1-URGENT', '2-HIGH') or (o_orderpriority = '1-URGENT' and o_orderstatus <> 'F')""")
def tasks_in_step(t):
    """Orders by priority: of one fetched anew the finished ones are no longer listed, another one lists nothing."""
    x = t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    fetched = x.filter(c("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderpriority")
    listed = x.filter("o_orderpriority = '1-URGENT' and o_orderstatus <> 'F'")
    return maintenance.remove_missing(x, fetched, listed, "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("""
with x as (select o_orderkey, o_orderkey % 5 as k from orders)
select o_orderkey as task, case when k in (0, 1) then 'model' || o_orderkey % 3 end as model, case when k in (0, 2) then 'L' || o_orderkey % 4 end as level, k = 0 as declared from x where k < 4""")
def declared_usage(t):
    return exports.declared_usage(_entries(t), "help")


@query("""
with n as (select max(o_orderkey) as last from orders where o_orderkey % 5 <> 4), w as (select last % 5 as k, last from n)
select 1 as slot, 'model' || i as value, case when i > 0 then 'told by ' || last end as description, cast(i as integer) as place from w, range(3) v(i)
union all select 2, 'L' || i, null, cast(i as integer) from range(2) v(i)""")
def declared_domains(t):
    return exports.declared_domains(_entries(t), "help")


def _entries(t):
    """Orders as entries of an export: both values, one, the other blank, none; a fifth have no such attribute. Each tells the values that may be chosen."""
    k = c("o_orderkey") % 5
    value = F.when(k.isin(0, 1), F.format_string(" model%d", c("o_orderkey") % 3)).when(k == 2, " ")
    level = F.when(k.isin(0, 2), F.format_string("L%d ", c("o_orderkey") % 4)).when(k == 1, "")
    told = F.format_string("told by %d", "o_orderkey")
    models = F.array(*[F.struct(F.lit(f"model{i}").alias("value"), (told if i else F.lit(None).cast("string")).alias("description")) for i in range(3)])
    levels = F.array(*[F.struct(F.lit(f"L{i}").alias("value"), F.lit(None).cast("string").alias("description")) for i in range(2)])
    pair = F.struct(
        F.when(k == 4, "other").otherwise("help").alias("attributeName"), F.lit("ENUM_PAIR").alias("attributeType"),
        value.alias("value"), level.alias("valueB"), models.alias("enumValues"), levels.alias("enumValues2"),
    )
    text = F.struct(F.lit("help").alias("attributeName"), F.lit("TEXT").alias("attributeType"), F.lit("yes").alias("value"), F.lit(None).cast("string").alias("valueB"))
    every = F.array(text.withField("enumValues", F.lit(None).cast(exports.VALUES)).withField("enumValues2", F.lit(None).cast(exports.VALUES)), pair)
    return t("orders").select(c("o_orderkey").alias("task"), F.to_json(F.struct(every.alias("attributeValues"))).alias("entry"))


@query("""
with s as (select n_nationkey as spec, key from nation, (values ('documentation_raw'), ('code_quality_raw'), ('arch_weighted'), ('production_loc'), ('endpoint_count'), ('nav_dispatch_density'), ('observe_call_count'), ('unheard')) v(key))
select spec, key,
  cast(case when spec % 4 = 0 and key in ('documentation_raw', 'unheard') then 2 when key = 'code_quality_raw' then case when spec % 3 = 0 then 60 + spec else 50 end else 0 end as double) as floor,
  cast(case when spec % 4 = 0 and key in ('documentation_raw', 'unheard') then 9 else case key when 'documentation_raw' then 6 when 'code_quality_raw' then 85 when 'arch_weighted' then case when spec % 3 = 0 then 200 + 2 * spec else 8 end
    when 'production_loc' then 50000 when 'endpoint_count' then case when spec % 2 = 0 then 70 else 50 end when 'nav_dispatch_density' then 10 when 'observe_call_count' then 30 else 1 end end as double) as ceiling,
  case when spec % 4 = 0 and key in ('documentation_raw', 'unheard') then 'spec' when key = 'unheard' then 'unit' else 'weights' end as origin from s""")
def resolved_anchors(t):
    """Nations as specifications: a quarter have anchors of their own, a third and a half name weights."""
    n = t("nation").select(c("n_nationkey").alias("spec"))
    keys = ("documentation_raw", "code_quality_raw", "arch_weighted", "production_loc", "endpoint_count", "nav_dispatch_density", "observe_call_count", "unheard")
    samples = n.select("spec", F.explode(F.array(*map(F.lit, keys))).alias("key"))
    specs = samples.filter("spec % 4 = 0 and key in ('documentation_raw', 'unheard')").select("spec", "key", F.lit(2.0).alias("floor"), F.lit(9.0).alias("ceiling"))
    weight = lambda name, value, part: n.filter(c("spec") % part == 0).select("spec", F.lit(name).alias("name"), value.cast("double").alias("value"))
    weights = weight("mi_floor", 60 + c("spec"), 3).unionByName(weight("arch_norm", 100 + c("spec"), 3)).unionByName(weight("inventory_count_ceiling", F.lit(70), 2))
    return cohort.resolved_anchors(samples, specs, weights)


@query("""
with l as (select l_orderkey as pr, l_suppkey as member, year(l_shipdate) as period, l_linenumber % 3 as points, s_nationkey as team from lineitem join supplier on s_suppkey = l_suppkey where l_returnflag <> 'R' and l_linestatus = 'O'),
p as (select l.*, cast(o_custkey % 50 as double) as ls, case when o_orderstatus <> 'P' then cast(o_orderkey % 30 as double) else 0 end as ld from l join orders on o_orderkey = pr and year(o_orderdate) <= period),
w as (select *, case when sum(points) over x > 0 then points / sum(points) over x else 1.0 / count(*) over x end as weight from p window x as (partition by team, period, pr)),
g as (select team, member, period, sum(ls * weight) as ls, sum(ld * weight) as ld, cast(sum(points) as double) as points from w group by all),
c as (select *, sum(ls) over x as tls, sum(ld) over x as tld, sum(points) over x as tp from g window x as (partition by team, member order by period))
select team, member, period, round(ls, 4) as ls, round(ld, 4) as ld, points, case when points > 0 then round(ls / points, 4) else 0 end as ls_per_point,
  round(tls, 4) as total_ls, round(tld, 4) as total_ld, tp as total_points, case when tp > 0 then round(tls / tp, 4) else 0 end as total_per_point from c""")
def member_line_totals(t):
    """Line items as tasks, orders as pull requests, nations as teams, years as periods."""
    x = t("lineitem")
    kind, status = F.when(c("l_returnflag") == "R", "USER_STORY").otherwise("TASK"), F.when(c("l_linestatus") == "O", "DONE").otherwise("TODO")
    links = x.select(
        c("l_linenumber").alias("task"), c("l_orderkey").alias("pr"), c("l_suppkey").alias("member"), F.year("l_shipdate").cast("bigint").alias("period"),
        F.when(c("l_linenumber") % 3 > 0, c("l_linenumber") % 3).alias("points"), kind.alias("type"), status.alias("status"),
    )
    years = t("lineitem").select(F.year("l_shipdate").cast("bigint").alias("period")).distinct()
    o = t("orders").select(c("o_orderkey").alias("pr"), F.year("o_orderdate").alias("y"), (c("o_custkey") % 50).alias("ls"), F.when(c("o_orderstatus") != "P", c("o_orderkey") % 30).alias("ld"))
    found = lines.member_line_totals(links, o.join(years, c("y") <= c("period")), t("supplier").select(c("s_suppkey").alias("member"), c("s_nationkey").alias("team")))
    return found.select("team", "member", "period", "points", "total_points", *[r(k).alias(k) for k in ("ls", "ld", "ls_per_point", "total_ls", "total_ld", "total_per_point")])

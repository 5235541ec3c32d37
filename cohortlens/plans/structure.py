"""Queries on signatures of pull requests, steps of grades, inventories of sources and paths."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col as c

from cohortlens.functions import paths
from cohortlens.functions import text as T
from cohortlens.operators import planning, project, similarity
from cohortlens.plans.projects import _AXES, _EXTRA, _PENALTY, _axes, _penalties
from cohortlens.plans.queries import query, r
from cohortlens.sources import inventory

PATHS = {
    1: "src/main/java/app/controller/Ship.java",
    2: "app/src/main/res/layout/mail.xml",
    3: "src/app/ui/ShipFragment.java",
    4: "src/app/data/RailDao.java",
    5: "src/app/rest/Truck.java",
    6: "src/test/java/app/FobController.java",
}


@query("""
with prs as (select distinct l_partkey as pr, case l_partkey % 3 when 0 then 'org/spring-team' when 1 then 'org/team-android' else 'org/docs' end as repo
  from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' and o_orderpriority <> '5-LOW'),
commits as (select distinct l_partkey as pr, l_orderkey as sha from lineitem where l_returnflag <> 'R'),
named as (select pr, case when repo like '%spring%' then case l_linenumber when 1 then 'spring_controller' when 4 then 'spring_repository' when 5 then 'spring_controller' end
  when repo like '%android' then case l_linenumber when 2 then 'android_layout' when 3 then 'android_fragment' when 4 then 'android_room' end end as layer
  from lineitem join commits on sha = l_orderkey join prs using (pr)),
counts as (select pr, layer, count(*) as n from named where layer is not null group by all),
layers as (select pr, string_agg(layer || ':' || n, ',' order by layer) as layers from counts group by pr),
changed as (select l_partkey as pr, sum(l_quantity) as lat, cast(sum(l_linenumber * 5) as double) as ld, coalesce(sum(case when l_tax > 0.04 then l_quantity end), 0) as ls
  from lineitem where l_partkey % 4 <> 0 group by 1),
alive as (select l_partkey as pr, cast(sum(l_linenumber) as double) as surviving from lineitem where l_partkey % 5 <> 0 group by 1)
select pr, repo, coalesce(layers, '') as layers, lat, ld, ls, surviving, case when lat / (lat + ld) >= 0.7 then 'create' when lat is not null then 'modify' end as action
from prs left join layers using (pr) left join changed using (pr) left join alive using (pr)""")
def pr_signatures(t):
    """Parts as pull requests, orders as tasks and commits, line items as statements."""
    x = t("lineitem")
    pr = c("l_partkey").alias("pr")
    repo = F.when(c("l_partkey") % 3 == 0, "org/spring-team").when(c("l_partkey") % 3 == 1, "org/team-android").otherwise("org/docs")
    kind = F.when(c("o_orderpriority") == "5-LOW", "USER_STORY").otherwise("TASK")
    status = F.when(c("o_orderstatus") == "F", "DONE").otherwise("TODO")
    links = x.join(t("orders"), c("l_orderkey") == c("o_orderkey")).select(pr, repo.alias("repo"), kind.alias("type"), status.alias("status"))
    path = F.coalesce(*[F.when(c("l_linenumber") == i, p) for i, p in PATHS.items()])
    statements = x.select(path.alias("path"), c("l_orderkey").alias("commit"))
    commits = x.filter("l_returnflag <> 'R'").select(pr, c("l_orderkey").alias("sha")).distinct()
    lines = x.filter("l_partkey % 4 <> 0").select(pr, c("l_quantity").alias("lat"), (c("l_linenumber") * 5).alias("ld"), F.when(c("l_tax") > 0.04, c("l_quantity")).alias("ls"))
    survival = x.filter("l_partkey % 5 <> 0").select(pr, c("l_linenumber").alias("surviving"))
    found = similarity.pr_signatures(links, statements, commits, lines, survival)
    layers = F.transform(F.array_sort(F.map_entries("layer_counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return found.select("pr", "repo", F.array_join(layers, ",").alias("layers"), "lat", "ld", "ls", "surviving", "action")


@query(f"""
with {_AXES}, {_EXTRA}, {_PENALTY},
gp as (select ay.project, work_base, quality_multiplier, 0.8 as ai_factor, least(coalesce(extra_tech, 0) / 10, 1) as extra from ay left join ex using (project)),
gq as (select *, work_base * ai_factor * quality_multiplier + extra as raw from gp),
gc as (select *, least(10, 10 * pow(greatest(raw, 0) / 10, 1.5)) as curved from gq),
st as (select s_nationkey as project, s_suppkey as student, abs(s_acctbal) / 5000 as share, 0.5 * (s_suppkey % 3) as criticals from supplier),
gs as (select project, student, share, curved * sqrt(least(share, 1.5)) as scaled, coalesce(penalty, 0) as penalty, criticals from st join gc using (project) left join pe using (project, student)),
gf as (select *, greatest(0, least(10, scaled - penalty - criticals)) as final from gs),
steps as (
  select project, cast(null as bigint) as student, unnest(['work_base', 'quality_multiplier', 'ai_factor', 'extra', 'raw', 'curved']) as step,
    unnest([work_base, quality_multiplier, ai_factor, extra, raw, curved]) as value from gc
  union all select project, student, unnest(['share', 'scaled', 'penalty', 'criticals', 'final']), unnest([share, scaled, penalty, criticals, final]) from gf)
select project, student, step, round(cast(value as double), 6) as value from steps""")
def explained_grades(t):
    m, axes = _axes(t)
    p = axes.join(project.extra_technology(m), "project", "left").withColumns({"extra_tech": F.coalesce("extra_tech", F.lit(0.0)), "ai_factor": F.lit(0.8)})
    s = t("supplier").select(c("s_nationkey").alias("project"), c("s_suppkey").alias("student"), (F.abs("s_acctbal") / 5000).alias("share"), (c("s_suppkey") % 3).alias("criticals"))
    return project.grade_steps(p, s.join(_penalties(t), ["project", "student"], "left"), 1.5).withColumn("value", r("value", 6))


@query("""
with s as (select s_nationkey as project, s_acctbal > 3000 as charged from supplier),
g as (select project, count(*) as students, count(*) filter (where charged) as charged from s group by project union all select null, count(*), count(*) filter (where charged) from s)
select project, students, charged, round(charged / students, 6) as share from g""")
def charged_students(t):
    s = t("supplier").select(c("s_nationkey").alias("project"), (c("s_acctbal") - 3000).alias("penalty"))
    return project.charged_students(s).withColumn("share", r("share", 6))


@query("""
with x as (select p_brand as repo, p_size % 4 as g, p_size % 3 as o, p_size % 5 as n, p_size % 2 as f, case when p_size % 7 = 0 then 1 else 0 end as m from part where p_partkey % 10 <> 0),
s as (select repo, count(*) as k, sum(g) as g, sum(o) as o, sum(n) as n, sum(f) as f, sum(m) as m from x group by repo),
v as (
  select repo, unnest(['controller_count', 'endpoint_count', 'fragment_count', 'observe_call_count', 'nav_dispatch_count', 'email_send_site_count', 'production_loc', 'production_statement_count',
      'reactive_wiring_density', 'nav_dispatch_density']) as key,
    unnest([k, g, f, o, n, m, 3 * k + g + o + n + f + m, o + n + m, o / greatest(f, 1), n / greatest(f, 1)]) as value from s
  union all select repo, unnest(['service_count', 'entity_count', 'repository_count', 'activity_count', 'viewmodel_count', 'room_database_count', 'custom_query_count', 'scheduled_task_count', 'reactive_state_field_count',
      'fcm_send_call_count', 'specification_def_count', 'graphics_custom_draw_count', 'av_usage_count', 'okhttp_external_api_count', 'minio_object_io_site_count']), 0 from s)
select repo, key, round(cast(value as double), 6) as value from v""")
def structural_inventory(t):
    """A part as a source file of its brand's repository, with as many endpoints, observers and screens as its size says; every tenth is a test."""
    times = lambda text, n: F.array_repeat(F.lit(text), n.cast("int"))
    size = c("p_size")
    lines = F.concat(
        F.array(F.lit("@RestController"), F.lit("class Parts {"), F.lit("// @GetMapping of old"), F.lit("")),
        times("  @GetMapping", size % 4), times("  shown.observe(this);", size % 3), times("  nav.navigate(next);", size % 5),
        times("class Home extends HomeFragment {", size % 2), times("  mailSender.send(mail);", F.when(size % 7 == 0, 1).otherwise(0)), F.array(F.lit("}")),
    )
    folder = F.when(c("p_partkey") % 10 == 0, "src/test/P").otherwise("src/main/P")
    files = t("part").select(c("p_brand").alias("repo"), F.concat(folder, c("p_partkey").cast("string"), F.lit(".java")).alias("path"), F.array_join(lines, "\n").alias("text"))
    return inventory.inventory(files).withColumn("value", r("value", 6))


@query("""
with a as (select l_suppkey as repo, avg(l_linenumber) filter (where l_returnflag = 'R') as cc, avg(l_linenumber) filter (where l_returnflag = 'A') as fc,
  avg(l_quantity) filter (where l_returnflag = 'R' and l_linestatus = 'O') as st from lineitem group by 1)
select repo, unnest(['avg_cc_per_controller', 'avg_cc_per_fragment', 'avg_statements_per_endpoint']) as key, round(coalesce(unnest([cc, fc, st]), 0), 6) as value from a""")
def class_averages(t):
    kind = F.when(c("l_returnflag") == "R", "controller").when(c("l_returnflag") == "A", "fragment").otherwise("other")
    methods = t("lineitem").select(
        c("l_suppkey").alias("repo"), kind.alias("class_kind"), c("l_linenumber").alias("complexity"), c("l_quantity").alias("statements"),
        F.when(c("l_linestatus") == "O", True).alias("endpoint"),
    )
    return inventory.class_averages(methods).withColumn("value", r("value", 6))


@query("""
with used as (select distinct l_suppkey as repo, case when l_suppkey % 2 = 0 then 'spring' else 'android' end as stack, 'org.p' || l_partkey % 40 || ':lib' as coordinate from lineitem)
select repo, stack, coordinate from used where not (stack = 'spring' and coordinate in (select 'org.p' || i || ':lib' from range(0, 40, 3) v(i)))""")
def added_dependencies(t):
    """A supplier's parts as the dependencies of its build file, less a baseline of one stack."""
    line = F.concat(F.lit("  implementation 'org.p"), (c("l_partkey") % 40).cast("string"), F.lit(":lib:1.0'"))
    stack = F.when(c("l_suppkey") % 2 == 0, "spring").otherwise("android")
    builds = t("lineitem").select(c("l_suppkey").alias("repo"), stack.alias("stack"), line.alias("line")).distinct()
    builds = builds.groupBy("repo", "stack").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("build"))
    used = builds.select("repo", "stack", F.explode(T.coordinates(F.col("build"))).alias("coordinate"))
    base = used.sparkSession.range(0, 40, 3).select(F.lit("spring").alias("stack"), F.concat(F.lit("org.p"), c("id").cast("string"), F.lit(":lib")).alias("coordinate"))
    return inventory.new_dependencies(used, base)


@query("""
with f as (select l_suppkey as project, 'fcm' as category, count(*) filter (where l_returnflag = 'R') as depth from lineitem where l_suppkey % 3 = 0 group by 1),
e as (select sum(depth) as d from f)
select 'push' as technology, 'fcm' as category, 'both' as source, cast(d as double) as depth from e
union all select 'org.q' || i, 'dependency', 'gradle', 1.0 from (select distinct l_partkey % 7 as i from lineitem where l_suppkey % 3 = 1)""")
def technologies(t):
    """Features by suppliers of one kind, dependencies by those of another; a dependency of a category shown by features only corroborates it."""
    x = t("lineitem")
    features = x.filter("l_suppkey % 3 = 0").groupBy("l_suppkey").agg(F.count_if(c("l_returnflag") == "R").cast("double").alias("depth"))
    features = features.select(F.lit("push").alias("technology"), F.lit("fcm").alias("category"), "depth")
    own = x.filter("l_suppkey % 3 = 1").select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("category"), F.concat(F.lit("org.q"), (c("l_partkey") % 7).cast("string")).alias("coordinate"))
    push = x.filter("l_suppkey % 3 = 0").select(F.lit("messaging").alias("name"), F.lit("fcm").alias("category"), F.lit("org.push:messaging").alias("coordinate"))
    return inventory.extra_technologies(features, own.unionByName(push).distinct())


@query(r"""
with x as (select c_custkey, '/srv/r' || c_custkey % 7 as root, c_custkey % 6 as k, 'C' || c_custkey || '.java' as name from customer)
select c_custkey, case k when 0 then 'src/' || name when 1 then name when 2 then 'a/b/' || name when 4 then 'win/' || name when 5 then '' end as relative,
  '/srv/' || name as plain, 'app.p' || c_custkey % 9 as package, c_custkey % 2 = 0 as snake from x""")
def repository_paths(t):
    """Paths written with dots, from above, relative, outside, with backslashes, and the root itself; packages of imports and names of types."""
    k, name = c("c_custkey") % 6, F.format_string("C%d.java", "c_custkey")
    root = F.concat(F.lit("/srv/r"), (c("c_custkey") % 7).cast("string"))
    path = F.when(k == 0, F.concat(root, F.lit("/src/./"), name)).when(k == 1, F.concat(root, F.lit("/x/../"), name))
    path = path.when(k == 2, F.concat(F.lit("a//b/"), name)).when(k == 3, F.concat(root, F.lit("/../other/"), name))
    path = path.when(k == 4, F.concat(F.translate(root, "/", "\\"), F.lit("\\win\\"), name)).otherwise(F.concat(root, F.lit("/")))
    imported = F.concat(F.lit("app.p"), (c("c_custkey") % 9).cast("string"), F.when(k < 3, ".*").otherwise(".Type.Inner"))
    kind = F.when(c("c_custkey") % 2 == 0, "my_type").otherwise("MyType")
    return t("customer").select(
        "c_custkey", paths.relative_path(root, path).alias("relative"), paths.without_file_scheme(F.concat(F.lit("file:///srv/"), name)).alias("plain"),
        paths.package_of(imported).alias("package"), paths.is_type_name_snake(kind).alias("snake"),
    )


@query("""
with a as (select distinct l_orderkey, l_suppkey from lineitem)
select l_suppkey as member, round(avg(o_totalprice), 4) as avg_score from a join orders on o_orderkey = l_orderkey where o_orderstatus <> 'P' group by 1""")
def average_scores(t):
    scores = t("orders").select(c("o_orderkey").alias("pr"), F.when(c("o_orderstatus") != "P", c("o_totalprice")).alias("score"))
    authors = t("lineitem").select(c("l_orderkey").alias("pr"), c("l_suppkey").alias("member"))
    return planning.mean_scores(scores, authors).select("member", r("avg_score").alias("avg_score"))

"""Queries of lines, plans, peers, caches, quality and project grades, on work projected from the shared tables.

An order is a pull request or a task, its lines are statements, findings or commits; parts are files, suppliers are authors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import paths as P
from cohortlens.functions import scalar as S
from cohortlens.functions import text as T
from cohortlens.operators import incremental, likelihood, lines, maintenance, planning, profiles, project, quality, reports, similarity, stats
from cohortlens.plans.queries import query, r

c = F.col


def _text(key, prefix=""):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


# Prose, titles, paths, rounding

_FORMAL = " + ".join(f"contains(low, '{p}')::int" for p in T.FORMAL_PHRASES)
_INFORMAL = " + ".join(f"contains(low, '{p}')::int" for p in T.INFORMAL_PHRASES)


@query(rf"""
with a as (select doc_id, text, lower(text) as low, regexp_extract_all(lower(text), '[a-zA-Z0-9]+(?:''[a-zA-Z]+)?') as w from documents),
b as (select doc_id, cast(len(w) as double) as n, {_FORMAL} as formal, {_INFORMAL} as informal, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) as s,
  len(regexp_extract_all(text, '{T.PASSIVE}')) as passive, len(list_filter(w, lambda x: x in {T.HEDGING})) as hedge from a),
d as (select doc_id, n, case when formal + informal > 0 then formal / (formal + informal) else 0.5 end as k, greatest(0, least(1, (n / greatest(s, 1) - 5) / 30)) as l,
  least(1, passive / greatest(n / 20, 1)) as p, least(1, hedge / greatest(n / 30, 1)) as h from b)
select doc_id, round(case when n = 0 then 0.5 when n < 20 then k * 0.75 + l * 0.1 + p * 0.1 + h * 0.05 else k * 0.45 + l * 0.2 + p * 0.2 + h * 0.15 end, 6) as formality from d""")
def formality_scores(t):
    # Tokens and counts are named once; as expressions they would be made wherever the formula names them.
    x = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", T.tokens(c("text")))
    parts = {"n": F.size("w"), "s": T.sentence_count(c("text")), "bits": T.phrase_bits(c("text")), "passives": F.regexp_count("text", F.lit(T.PASSIVE)), "hedged": T.hedges(c("w"))}
    x = x.select("doc_id", *[v.alias(k) for k, v in parts.items()])
    return x.select("doc_id", r(T.formality_of(*[c(k) for k in parts]), 6).alias("formality"))


def _matches(patterns, column):
    return "(" + " or ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


def _has(words, column="low"):
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_POINTS = " + ".join(f"case when {_has(words)} then {points} else 0 end" for words, points in T.DESCRIPTION_SIGNALS)


@query(rf"""
with a as (select page_id as id, coalesce(regexp_replace(coalesce(regexp_extract(html, '<title>([^<]*)', 1), ''), '^\s+|\s+\z', '', 'g'), '') as title, regexp_replace(coalesce(url, ''), '^\s+|\s+\z', '', 'g') as body from pages),
b as (select *, lower(body) as low, strlen(title) as nt, strlen(body) as nb,
  strlen(body) < 20 or len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '\S') and not regexp_matches(x, '^\s*#'))) = 0 as empty,
  regexp_matches(body, '{T.ID_ONLY}') or regexp_matches(body, '{T.LINK_ONLY}') as bare from a)
select id, concat_ws(',', case when empty then 'EMPTY_BODY' when bare then 'TASK_ID_ONLY_BODY' end, case when title = '' or {_matches(T.GENERIC_TITLES, 'title')} then 'GENERIC_TITLE' end) as flags,
  cast(case when nt < 5 or {_matches(T.WORTHLESS_TITLES, 'title')} then 0 when nt < 20 then 1 when nt < 30 then 1.5 when nt < 50 then 1.75 else 2 end as double) as title_score,
  cast(case when nb < 20 or bare then 0 else least(4, case when nb < 50 then 0.5 when nb < 100 then 1 when nb < 200 then 1.5 when nb < 400 then 2 else 2.5 end + {_POINTS}) end as double) as description_score,
  cast(case when nt < 5 then 0 when nt < 15 then 0.2 else least(1, 0.2 + case when {_has(T.TASK_VERBS, 'lower(title)')} then 0.2 else 0 end + case when {_has(T.TASK_SPECIFICS, 'lower(title)')} then 0.2 else 0 end
    + case when nt > 40 then 0.2 else 0 end + case when nt > 80 then 0.2 else 0 end) end as double) as task_score,
  {_matches(T.GENERIC_MESSAGES, "split_part(title, chr(10), 1)")} as generic_message from b""")
def text_checks(t):
    title, body = F.regexp_extract("html", "<title>([^<]*)", 1), c("url")
    return t("pages").select(
        c("page_id").alias("id"), F.array_join(T.text_flags(title, body), ",").alias("flags"), T.title_score(title).alias("title_score"), T.description_score(body).alias("description_score"),
        T.task_description_score(title).alias("task_score"), T.is_generic_message(title).alias("generic_message"),
    )


_FOLDERS = ("controller", "service", "repository", "model", "dto", "config", "test", "ui")
_FILES = ("UserController.java", "TaskService.java", "UserDao.kt", "Note.java", "UserDto.java", "WebConfig.java", "MainActivity.java", "HomeFragment.kt", "NavGraph.java", "main.xml")
_PATH = f"'app/' || list_extract({list(_FOLDERS)}, p_size % 8 + 1) || '/res/layout/' || list_extract({list(_FILES)}, cast(p_partkey % 10 + 1 as integer))"


def _layer_sql():
    out = " ".join(f"when contains(p, '{x}') then null" for x in P.NO_LAYER)
    out += " when stack = 'android' and ends_with(p, '.xml') and contains(p, '/res/layout') then 'android_layout' when stack = 'android' and not (ends_with(p, '.java') or ends_with(p, '.kt')) then null"
    for stack, layers in P.LAYERS.items():
        for layer, folders, endings, parts in layers:
            fits = [f"contains(p, '{x}')" for x in folders] + [f"ends_with(p, '{x}')" for x in endings] + [f"contains(split_part(p, '/', -1), '{x}')" for x in parts]
            out += f" when stack = '{stack}' and ({' or '.join(fits)}) then '{layer}'"
    return f"case {out} end"


@query(f"""
with a as (select p_partkey, lower({_PATH}) as p, case when p_type = 'PROMO' then 'android' when p_type = 'ECONOMY' then 'spring' else 'other' end as stack from part)
select p_partkey, {_layer_sql()} as layer from a""")
def path_layers(t):
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    path = F.concat(F.lit("app/"), pick(_FOLDERS, c("p_size") % 8), F.lit("/res/layout/"), pick(_FILES, c("p_partkey") % 10))
    stack = F.when(c("p_type") == "PROMO", "android").when(c("p_type") == "ECONOMY", "spring").otherwise("other")
    return t("part").select("p_partkey", P.layer_of(path, stack).alias("layer"))


_REPO = "list_extract(['org/android-', 'org/Spring-', 'android/x', 'org/core-android', 'solo'], cast(s_suppkey % 5 + 1 as integer)) || s_suppkey"


@query(f"""
with a as (select s_suppkey, {_REPO} as repo, s_nationkey as n, lower(split_part({_REPO}, '/', -1)) as short from supplier)
select s_suppkey, case when starts_with(short, 'android') or contains(short, '-android') then 'android' when starts_with(short, 'spring') or contains(short, '-spring') then 'spring' end as type,
  case when starts_with(lower(repo), 'android') or contains(lower(repo), '-android') or contains(lower(repo), '/android') then 'android' else 'spring' end as kind,
  case when contains(repo, '/') then 'https://host/' || repo || '/blob/main/a.java#L' || n || case when n + s_suppkey % 3 > n then '-L' || (n + s_suppkey % 3) else '' end else '' end as url from a""")
def repositories(t):
    repo = F.concat(F.element_at(F.array(*map(F.lit, ("org/android-", "org/Spring-", "android/x", "org/core-android", "solo"))), (c("s_suppkey") % 5 + 1).cast("int")), c("s_suppkey").cast("string"))
    url = P.blob_url("https://host", repo, F.lit("main"), F.lit("a.java"), c("s_nationkey"), c("s_nationkey") + c("s_suppkey") % 3)
    return t("supplier").select("s_suppkey", P.repo_type(repo).alias("type"), P.repo_kind(repo).alias("kind"), url.alias("url"))


@query("""
with a as (select l_orderkey, l_linenumber, l_extendedprice * l_discount / 7 as x from lineitem)
select l_orderkey, l_linenumber, cast(printf('%.3f', x) as double) as even, case when x = 0 then 0 else floor(x * 100 + 0.5) / 100 end as away, floor(floor(x * 100 + 0.5) / 100 / 0.25 + 0.5) * 0.25 as grid from a""")
def rounding(t):
    x = c("l_extendedprice") * c("l_discount") / 7
    return t("lineitem").select("l_orderkey", "l_linenumber", S.round_half_even(3)(x).alias("even"), S.round_half_away(x, 2).alias("away"), S.round_half_away(x, 2, 0.25).alias("grid"))


@query("""
with a as (select event_id, user_id, ts, case event_id % 3 when 0 then strftime(ts, '%Y-%m-%dT%H:%MZ') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') else 'soon' end as text from events),
b as (select *, case event_id % 3 when 0 then date_trunc('minute', ts) when 1 then date_trunc('second', ts) end as moment from a)
select event_id, cast(epoch(moment) as bigint) as seconds, cast(floor((epoch(moment) - 1704110400) / 86400) as bigint) as day, round((1704110400 - epoch(moment)) / 3600.0, 6) as hours from b""")
def iso_times(t):
    ts = c("ts").cast("timestamp")
    text = F.when(c("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm'Z'")).when(c("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise("soon")
    at, noon = S.parse_iso(text), F.timestamp_seconds(F.lit(1704110400))
    return t("events").select("event_id", F.unix_seconds(at).alias("seconds"), S.day_offset(at, noon).alias("day"), r(S.hours_between(noon, at), 6).alias("hours"))


# Lines, survival, ownership

_LINE = "case when l_quantity < 10 then '// note ' || l_linenumber when l_discount = 0 then '  ' else '  int x' || l_partkey || ' = ' || cast(l_quantity as integer) || '; ' end"


def _hunks(t):
    text = F.when(c("l_quantity") < 10, _text("l_linenumber", "// note ")).when(c("l_discount") == 0, "  ").otherwise(F.concat(F.lit("  int x"), c("l_partkey").cast("string"), F.lit(" = "), c("l_quantity").cast("int").cast("string"), F.lit("; ")))
    x = t("lineitem").select(c("l_orderkey").alias("pr"), "l_linenumber", "l_returnflag", "l_linestatus", text.alias("line"))
    side = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("l_linenumber", "line")))), lambda y: y["line"])
    hunks = x.groupBy("pr").agg(side(c("l_returnflag") != "A").alias("added"), side(c("l_returnflag") == "A").alias("removed"))
    head = x.filter("l_linestatus = 'F'").select(F.lit("a/b").alias("repo"), T.strip(c("line")).alias("line")).filter("line != '' and line not like '//%'").distinct()
    return hunks.select("pr", F.lit("a/b").alias("repo"), F.lit("A.java").alias("path"), F.lit(0).alias("hunk"), "removed", "added"), head


@query(f"""
with x as (select l_orderkey as pr, l_linenumber as i, l_returnflag = 'A' as gone, l_linestatus, trim({_LINE}) as line, row_number() over (partition by l_orderkey, l_returnflag = 'A' order by l_linenumber, {_LINE}) as place from lineitem),
k as (select *, line <> '' and not starts_with(line, '//') as code from x), h as (select distinct line from k where code and l_linestatus = 'F'),
n as (select pr, count(case when code and not gone then 1 end) as lat, count(case when code and gone then 1 end) as removed, count(case when code and not gone and line in (select line from h) then 1 end) as ls from k group by 1),
p as (select a.pr, count(*) as cosmetic from k a join k b on a.pr = b.pr and a.place = b.place and not a.gone and b.gone and a.line <> b.line and a.line <> '' and b.line <> '' and a.code = b.code group by 1)
select n.pr, lat, greatest(lat - coalesce(cosmetic, 0), 0) as lar, ls, greatest(removed - coalesce(cosmetic, 0), 0) as ld, coalesce(cosmetic, 0) as cosmetic_lines, coalesce(cosmetic, 0) > 0.2 * lat and lat > 0 as reported from n left join p using (pr)""")
def pr_line_metrics(t):
    return lines.pr_line_metrics(*_hunks(t)).withColumn("reported", c("cosmetic_report") != "").drop("cosmetic_report")


@query("""
with s as (select l_orderkey as pr, count(*) as surviving, count(distinct l_partkey) as normalized, count(distinct l_suppkey) as methods from lineitem where l_linestatus = 'F' group by 1),
b as (select o_orderkey as pr, o_custkey as member, o_custkey % 9 as added from orders), d as (select distinct member, coalesce(added, surviving) as added, surviving from s join b using (pr)),
g as (select member, sum(added) as added, sum(surviving) as surviving from d group by 1), p as (select o_custkey as member, sum(case when o_orderstatus = 'O' then 0 else 3 end) as points from orders group by 1)
select g.member, cast(added as bigint) as added, cast(surviving as bigint) as surviving, round(case when added = 0 then 1 else surviving / added end, 6) as rate, round(case when points > 0 then surviving / points end, 6) as density from g left join p using (member)""")
def student_survival(t):
    li, o = t("lineitem"), t("orders")
    statements = li.filter("l_linestatus = 'F'").select(c("l_orderkey").alias("commit"), c("l_partkey").alias("normalized"), c("l_suppkey").alias("method"))
    before = o.select(c("o_orderkey").alias("pr"), (c("o_custkey") % 9).alias("added_raw"))
    prs = lines.pr_survival(statements, o.select(c("o_orderkey").alias("pr"), c("o_orderkey").alias("sha")), before)
    points = o.select(c("o_custkey").alias("member"), F.when(c("o_orderstatus") == "O", 0).otherwise(3).alias("points"))
    x = lines.student_survival(prs, o.select(c("o_orderkey").alias("pr"), c("o_custkey").alias("member")), points)
    return x.select("member", "added", "surviving", r("rate", 6).alias("rate"), r("density", 6).alias("density"))


@query("""
with n as (select l_returnflag as team, l_partkey as file, 'a' || l_suppkey as author, count(*) as n from lineitem group by 1, 2, 3), f as (select team, file, arg_min(author, (-n, author)) as author, sum(n) as s from n group by 1, 2),
o as (select team, author, sum(s) as s from f group by 1, 2), w as (select *, sum(s) over (partition by team order by s desc, author rows unbounded preceding) - s as before, sum(s) over (partition by team) as total from o)
select team, count(*) as truck_factor, string_agg(author, ',' order by s desc, author) as owners from w where before < ceil(total * 0.95) group by 1""")
def team_ownership(t):
    s = t("lineitem").select(c("l_returnflag").alias("team"), c("l_partkey").alias("file"), _text("l_suppkey", "A").alias("author"))
    return lines.team_ownership(s, ["team"])


# Plans, timing, builds


@query("""
with x as (select o_custkey % 7 as project, year(o_orderdate) as sprint, case when o_orderstatus = 'P' then 0 else o_orderkey % 5 end as points, o_orderstatus = 'F' as done from orders where o_orderpriority not in ('5-LOW', '4-NOT SPECIFIED')),
s as (select project, sprint, sum(points) as planned, sum(case when done then points else 0 end) as completed, avg(case when points = 0 then 1.0 else 0 end) as u from x group by 1, 2),
v as (select project, case when count(*) >= 2 then stddev_pop(completed) / avg(completed) else 0 end as cv from s where completed > 0 group by 1)
select project, sprint, cast(planned as bigint) as planned, cast(completed as bigint) as completed, round(case when planned > 0 then completed / planned else 0 end, 6) as reliability,
  round(case when planned > 0 then abs(planned - completed) / planned else 0 end, 6) as accuracy_error, round(u, 6) as unestimated, round(coalesce(cv, 0), 6) as velocity_cv from s left join v using (project)""")
def planning_quality(t):
    kind = F.when(c("o_orderpriority") == "5-LOW", "USER_STORY").when(c("o_orderpriority") != "4-NOT SPECIFIED", "TASK")
    x = t("orders").select((c("o_custkey") % 7).alias("project"), F.year("o_orderdate").cast("bigint").alias("sprint"), F.when(c("o_orderstatus") != "P", c("o_orderkey") % 5).alias("points"), (c("o_orderstatus") == "F").alias("done"), kind.alias("type"))
    return planning.planning_quality(x).select("project", "sprint", "planned", "completed", *[r(k, 6).alias(k) for k in ("reliability", "accuracy_error", "unestimated", "velocity_cv")])


@query("""
with d as (select c_nationkey as team, c_custkey as member, case when c_custkey % 4 > 0 then c_acctbal / (c_custkey % 4) end as density from customer)
select team, member, round(density, 6) as density, round(density - avg(density) over (partition by team), 6) as deviation from d""")
def estimation_density(t):
    x = planning.estimation_density(t("customer").select(c("c_nationkey").alias("team"), c("c_custkey").alias("member"), c("c_acctbal").alias("statements"), (c("c_custkey") % 4).alias("points")))
    return x.select("team", "member", r("density", 6).alias("density"), r("deviation", 6).alias("deviation"))


@query("""
with k as (select l_orderkey as pr, bool_or(l_returnflag = 'R' and l_quantity > 40) as bug from lineitem where l_linestatus = 'F' or l_quantity > 40 group by 1),
x as (select o_orderkey as pr, (epoch(timestamp '1998-08-02') - epoch(o_orderdate)) / 3600.0 % 200 as h, bug or o_orderpriority = '1-URGENT' as fix from orders join k on pr = o_orderkey where o_orderstatus <> 'O')
select pr, cast(printf('%.2f', h) as double) + 0.0 as hours, case when fix then 'fix' else 'feature' end as kind, case when h >= 96 then 'Regular' when h >= 72 then 'Late' when h >= 48 then 'Critical' when fix then 'Fix' else 'Critical' end as tier from x""")
def submission_tiers(t):
    h = (F.lit(902016000) - F.unix_seconds(c("o_orderdate").cast("timestamp"))) / 3600.0 % 200
    deadline = F.timestamp_seconds(F.lit(0))
    p = t("orders").select(
        c("o_orderkey").alias("pr"), F.when(c("o_orderpriority") == "1-URGENT", "Hotfix of it").otherwise("new thing").alias("title"), (c("o_orderstatus") != "O").alias("merged"),
        F.timestamp_seconds((-h * 3600).cast("bigint")).alias("created_at"), F.timestamp_seconds(F.lit(1)).alias("merged_at"), deadline.alias("deadline"),
    )
    kind = F.when((c("l_returnflag") == "R") & (c("l_quantity") > 40), "BUG").when((c("l_linestatus") == "F") | (c("l_quantity") > 40), "TASK").otherwise("USER_STORY")
    return planning.submission_tiers(p, t("lineitem").select(c("l_orderkey").alias("pr"), kind.alias("type"))).withColumn("hours", c("hours") + F.lit(0.0))


@query("""
with e as (select o_custkey % 5 as team, l_returnflag as kind, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by 1, 2), k as (select *, row_number() over (partition by team order by n desc, kind) as i from e),
m as (select team, '{' || string_agg('"' || kind || '":' || n, ',' order by i) || '}' as errors from k where i <= 2 group by 1)
select team, count(*) as builds, count(case when o_orderstatus = 'F' then 1 end) as failed, round(avg(case when o_orderstatus <> 'F' then 1.0 else 0 end), 6) as rate, errors
from orders join m on team = o_custkey % 5 where o_orderkey in (select l_orderkey from lineitem) group by team, errors""")
def compile_summary(t):
    e = t("lineitem").groupBy(c("l_orderkey").alias("pr"), "l_returnflag").agg(F.count("*").alias("n")).groupBy("pr").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("errors"))
    p = t("orders").join(e, c("o_orderkey") == c("pr")).select((c("o_custkey") % 5).alias("team"), (c("o_orderstatus") != "F").alias("compiles"), "errors")
    return planning.compile_summary(p, ["team"], 2).withColumn("rate", r("rate", 6))


@query("""
with x as (select distinct l_orderkey as pr, l_suppkey as s from lineitem)
select s_nationkey as team, s_suppkey as reviewer, count(*) as reviewed, count(case when o_orderstatus = 'F' then 1 end) as broken from x join supplier on s_suppkey = s join orders on o_orderkey = pr where o_orderpriority <> '5-LOW' group by 1, 2""")
def reviewer_breakdown(t):
    who = t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(c("l_suppkey").cast("string"))).alias("reviewers"))
    p = t("orders").join(who, c("o_orderkey") == c("l_orderkey")).select(c("o_orderkey").alias("pr"), (c("o_orderstatus") != "F").alias("compiles"), F.when(c("o_orderpriority") == "5-LOW", "not json").otherwise(c("reviewers")).alias("reviewers"))
    x = planning.reviewer_breakdown(p, t("supplier").select(c("s_nationkey").alias("team"), c("s_suppkey").cast("string").alias("member")))
    return x.withColumn("reviewer", c("reviewer").cast("bigint"))


@query("""
with x as (select l_orderkey, l_linenumber, l_quantity / 25 as title, l_discount * 40 as d, case when l_returnflag = 'N' then null when l_tax = 0 then 'NaN'::double else l_quantity / 25 + l_discount * 40 + l_tax end as total,
  l_linestatus = 'F' and l_quantity < 5 as empty, l_quantity > 45 as generic from lineitem),
s as (select *, abs(total - least(greatest(floor(title / 0.25 + 0.5) * 0.25, 0), 2) - least(greatest(floor(d / 0.25 + 0.5) * 0.25, 0), 4)) as far from x)
select l_orderkey, l_linenumber, case when empty then 'short:EMPTY_BODY' when generic and total is not null then 'short:GENERIC_TITLE' when total is null or isnan(total) then 'judge' when total between 2 and 4 then 'judge' when far > 0.1 then 'judge' else 'snap' end as decision from s""")
def triage(t):
    title, d = c("l_quantity") / 25, c("l_discount") * 40
    total = F.when(c("l_returnflag") == "N", F.lit(None)).when(c("l_tax") == 0, F.lit(float("nan"))).otherwise(title + d + c("l_tax"))
    flags = F.filter(F.array(F.when((c("l_linestatus") == "F") & (c("l_quantity") < 5), "EMPTY_BODY"), F.when(c("l_quantity") > 45, "GENERIC_TITLE")), lambda f: f.isNotNull())
    return t("lineitem").select("l_orderkey", "l_linenumber", planning.triage(flags, title, d, total, (2.0, 4.0), 0.1).alias("decision"))


@query("""
with w as (select *, row_number() over (partition by p_type order by p_size desc, p_name || p_partkey) as place from part where p_size >= 5 and not regexp_matches(p_name || p_partkey, '^(large|small).*[02468]$'))
select p_type as project, p_name || p_partkey as path, p_size as size, place from w where place <= 12""")
def file_candidates(t):
    x = t("part").select(c("p_type").alias("project"), F.concat("p_name", c("p_partkey").cast("string")).alias("path"), c("p_size").alias("size"))
    return planning.file_candidates(x, "project", "path", "size", 5, 12, ["^(large|small).*[02468]$"]).withColumn("place", c("place").cast("bigint"))


# Peers

_KEYS = """k as (select o_custkey % 5 as project, o_orderkey as task, cast(row_number() over (partition by o_orderkey order by l_linenumber, l_suppkey, l_linestatus, l_quantity) as bigint) as place, l_linestatus as stack, 'L' || l_suppkey as layer,
  case when l_quantity >= 35 then 'create' else 'modify' end as action from orders join lineitem on l_orderkey = o_orderkey)"""
_GROUPS = f"""{_KEYS}, w as (select project, task, place, unnest([{{'level': 0, 'stack': stack, 'layer': layer, 'action': action}}, {{'level': 1, 'stack': stack, 'layer': layer, 'action': '*'}},
  {{'level': 2, 'stack': stack, 'layer': '*', 'action': action}}, {{'level': 3, 'stack': stack, 'layer': '*', 'action': '*'}}]) as u from k where place <= 3),
v as (select project, task, place, u.level as level, u.stack as stack, u.layer as layer, u.action as action from w), z as (select project, stack, layer, action from v group by all having count(distinct task) >= 40),
m as (select distinct project, task, arg_min({{'stack': stack, 'layer': layer, 'action': action}}, level) over (partition by project, task, place) as g from v join z using (project, stack, layer, action)),
e as (select project, g.stack as stack, g.layer as layer, g.action as action, task from m),
f as (select e.* from e join (select project, stack, layer, action from e group by all having count(*) >= 40) using (project, stack, layer, action))"""


def _keys(t):
    from pyspark.sql import Window

    x = t("orders").join(t("lineitem"), c("o_orderkey") == c("l_orderkey"))
    place = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_suppkey", "l_linestatus", "l_quantity")).cast("bigint")
    return x.select((c("o_custkey") % 5).alias("project"), c("o_orderkey").alias("task"), place.alias("place"), c("l_linestatus").alias("stack"), _text("l_suppkey", "L").alias("layer"), similarity.pr_action(c("l_quantity"), F.lit(50) - c("l_quantity")).alias("action"))


@query(f"with {_GROUPS} select project, stack, layer, action, task from f")
def peer_groups(t):
    return similarity.peer_groups(_keys(t), 40, 3).select("project", "stack", "layer", "action", "task")


@query(f"""
with {_GROUPS}, x as (select f.*, o_custkey % 4 as points, cast(round(o_totalprice / 1000) as double) as statements from f join orders on o_orderkey = task), d as (select *, case when points > 0 then statements / points end as density from x),
a as (select project, stack, layer, action, median(density) as med, count(density) as n, arg_max(task, (statements, points, -task)) as representative from d group by 1, 2, 3, 4),
b as (select d.*, med, n, representative, abs(density - med) as dev from d join a using (project, stack, layer, action)),
s as (select project, stack, layer, action, coalesce(nullif(median(dev), 0), nullif(avg(dev), 0)) as scale from b group by 1, 2, 3, 4)
select project, stack, layer, action, task, round(case when n >= 3 then (density - med) / scale end, 6) as z, coalesce(n >= 3 and abs((density - med) / scale) > 2.5, false) as outlier, representative from b join s using (project, stack, layer, action)""")
def peer_outliers(t):
    tasks = t("orders").select(c("o_orderkey").alias("t2"), (c("o_custkey") % 4).alias("points"), F.round(c("o_totalprice") / 1000).alias("statements"))
    x = similarity.peer_groups(_keys(t), 40, 3).join(tasks, c("task") == c("t2")).drop("t2")
    x = x.withColumn("points", c("points").cast("double"))
    return similarity.group_outliers(x, 2.5).select("project", "stack", "layer", "action", "task", r("z", 6).alias("z"), "outlier", "representative")


@query("""
with n as (select l_orderkey as pr, 'L' || l_suppkey % 4 as layer, count(*) as n from lineitem group by 1, 2), w as (select *, sum(n) over (partition by pr) as total, row_number() over (partition by pr order by n desc, layer) as place from n)
select pr, layer, place from w where n >= ceil(total * 0.25) or place = 1""")
def dominant_layers(t):
    n = t("lineitem").groupBy(c("l_orderkey").alias("pr"), F.concat(F.lit("L"), (c("l_suppkey") % 4).cast("string")).alias("layer")).agg(F.count("*").alias("n"))
    return similarity.dominant_layers(n, ["pr"]).withColumn("place", c("place").cast("bigint"))


@query("""
with x as (select o_custkey % 5 as project, o_orderkey as task, l_linenumber as pr, l_quantity as q, l_discount as w, l_linestatus = 'F' or l_quantity < 40 as merged from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F')
select project, task, cast(max(task % 6) as bigint) as points, case when bool_and(q >= 35) then 'create' else 'modify' end as action, round(sum(q * w), 4) as statements from x group by 1, 2 having bool_and(merged)""")
def peer_tasks(t):
    x = t("orders").join(t("lineitem"), c("o_orderkey") == c("l_orderkey"))
    pr = F.concat_ws("-", "o_orderkey", "l_linenumber")
    links = x.select(
        (c("o_custkey") % 5).alias("project"), c("o_orderkey").alias("task"), (c("o_orderkey") % 6).alias("points"), (c("o_orderstatus") == "F").alias("done"), pr.alias("pr"), ((c("l_linestatus") == "F") | (c("l_quantity") < 40)).alias("merged"),
        c("l_discount").alias("weight"), c("l_quantity").alias("lat"), (50 - c("l_quantity")).alias("ld"), c("l_quantity").alias("statements"), c("l_returnflag").alias("layer"),
    )
    return similarity.tasks_of(links.drop("layer"), links.select("pr", "layer", F.lit(3).alias("n"))).select("project", "task", "points", "action", r("statements").alias("statements"))


# Increments


def _prs(t):
    return t("orders").select(
        c("o_orderkey").alias("pr"), F.when(c("o_orderstatus") == "F", "CLOSED").when(c("o_orderstatus") == "O", "open").alias("state"), (c("o_orderstatus") == "P").alias("merged"),
        F.when(c("o_orderpriority") != "5-LOW", c("o_orderdate").cast("string")).alias("merged_at"), c("o_orderpriority").alias("updated_at"), F.when(c("o_totalprice") > 100000, c("o_orderpriority")).otherwise("old").alias("last_fetched"),
    )


@query("""
select o_orderkey as pr from orders where not (o_orderstatus in ('F', 'P') and not (o_orderstatus = 'P' and o_orderpriority = '5-LOW') and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 30) and o_totalprice > 100000)""")
def prs_to_fetch(t):
    return incremental.to_fetch(_prs(t), t("lineitem").filter("l_quantity > 30").select(c("l_orderkey").alias("pr"))).select("pr")


@query("""
with cache as (select c_custkey as key, c_mktsegment as endpoint, 'e' || c_nationkey as etag, c_name as body from customer where c_acctbal > 0),
ans as (select c_custkey as key, c_mktsegment as endpoint, case when c_nationkey < 12 then 200 else 304 end as status, 'n' || c_nationkey as etag, upper(c_name) as body from customer where c_mktsegment <> 'MACHINERY')
select a.key, a.endpoint, case when status = 304 then c.body else a.body end as body, status = 200 as fresh from ans a left join cache c on a.key = c.key and a.endpoint = c.endpoint""")
def conditional_answers(t):
    cu = t("customer")
    cache = cu.filter("c_acctbal > 0").select(c("c_custkey").alias("key"), c("c_mktsegment").alias("endpoint"), _text("c_nationkey", "e").alias("etag"), c("c_name").alias("body"))
    ans = cu.filter("c_mktsegment != 'MACHINERY'").select(c("c_custkey").alias("key"), c("c_mktsegment").alias("endpoint"), F.when(c("c_nationkey") < 12, 200).otherwise(304).alias("status"), _text("c_nationkey", "n").alias("etag"), F.upper("c_name").alias("body"))
    return incremental.conditional_bodies(cache, ans)


@query("""
with b as (select c_nationkey as project, count(*) as prs, cast(sum(c_custkey % 3) as bigint) as tasks from customer where c_mktsegment <> 'BUILDING' and c_nationkey > 3 group by 1), a as (select c_nationkey as project, count(*) as prs, cast(sum(c_custkey % 3) as bigint) as tasks from customer group by 1)
select a.project, greatest(a.prs - coalesce(b.prs, 0), 0) as new_prs, greatest(a.tasks - coalesce(b.tasks, 0), 0) as new_tasks from a left join b using (project) where a.prs > coalesce(b.prs, 0) or a.tasks > coalesce(b.tasks, 0)""")
def new_data(t):
    count = lambda df: df.groupBy(c("c_nationkey").alias("project")).agg(F.count("*").alias("prs"), F.sum(c("c_custkey") % 3).alias("tasks"))
    return incremental.new_data(count(t("customer").filter("c_mktsegment != 'BUILDING' and c_nationkey > 3")), count(t("customer")))


@query("""
with r as (select l_partkey as repo, l_suppkey as sha, l_linestatus = 'F' as ok, l_shipdate as moment, l_orderkey * 10 + l_linenumber as n from lineitem), d as (select repo, arg_max(sha, (moment, n, sha)) as done from r where ok group by 1)
select p_partkey as repo, p_partkey % 10 as sha from part left join d on repo = p_partkey where done is null or done <> p_partkey % 10""")
def stale_artifacts(t):
    runs = t("lineitem").select(c("l_partkey").alias("repo"), c("l_suppkey").alias("sha"), (c("l_linestatus") == "F").alias("ok"), F.struct("l_shipdate", (c("l_orderkey") * 10 + c("l_linenumber")).alias("n"), "l_suppkey").alias("at"))
    return incremental.stale_artifacts(t("part").select(c("p_partkey").alias("repo"), (c("p_partkey") % 10).alias("sha")), runs)


@query("""
select distinct l_orderkey as pr, l_linenumber % 2 as sprint from lineitem join orders on o_orderkey = l_orderkey where not (l_discount < 0.05 and length(case when o_orderstatus = 'F' then repeat('x', 60) else '' end) >= 50 and l_quantity < 50)""")
def fresh_scores(t):
    s = t("lineitem").select(c("l_orderkey").alias("pr"), (c("l_linenumber") % 2).alias("sprint"), F.when(c("l_discount") < 0.05, 0.0).otherwise(1.0).alias("score"), c("l_quantity").alias("scored_length"))
    return incremental.fresh_scores(s, t("orders").select(c("o_orderkey").alias("pr"), F.when(c("o_orderstatus") == "F", "x" * 60).alias("body")))


@query("""
with live as (select p_type as category, p_brand as value, nullif(p_size, 7) as taught from part), snap as (select r_regionkey as sprint, 'ECONOMY' as category, r_name as value from region where r_regionkey <> 3)
select 2 as sprint, category, value from snap where sprint = 2 union all select distinct 3, category, value from live where taught is null or taught <= 12""")
def allowed_concepts(t):
    live = t("part").select(c("p_type").alias("category"), c("p_brand").alias("value"), F.nullif("p_size", F.lit(7)).alias("taught"))
    snap = t("region").filter("r_regionkey != 3").select(c("r_regionkey").cast("bigint").alias("sprint"), F.lit("ECONOMY").alias("category"), c("r_name").alias("value"))
    one = lambda s: incremental.allowed_concepts(snap, live, s, 12).select(F.lit(s).alias("sprint"), "category", "value")
    return one(2).unionByName(one(3))


@query("""
with k as (select p_brand as sha, p_type as rubric, 'm' as model, p_name as answer, p_partkey as moment from part), l as (select sha, rubric, model, arg_max(answer, moment) as answer from k group by 1, 2, 3)
select p_partkey as file, answer from part left join l on sha = case when p_size > 25 then p_brand else p_name end and rubric = p_type""")
def cached_answers(t):
    p = t("part")
    asked = p.select(c("p_partkey").alias("file"), F.when(c("p_size") > 25, c("p_brand")).otherwise(c("p_name")).alias("sha"), c("p_type").alias("rubric"), F.lit("m").alias("model"))
    known = p.select(c("p_brand").alias("sha"), c("p_type").alias("rubric"), F.lit("m").alias("model"), c("p_name").alias("answer"), c("p_partkey").alias("at"))
    done, missing = incremental.cached_answers(asked, known)
    return done.select("file", "answer").unionByName(missing.select("file", F.lit(None).cast("string").alias("answer")))


# Quality

_METHODS = """m as (select l_orderkey as pr, l_linenumber as n, cast(l_quantity as integer) as cyclomatic, cast(l_discount * 200 as integer) as cognitive, cast(l_extendedprice / 1000 as integer) as loc, l_suppkey as member, l_shipdate,
  case when l_returnflag = 'R' then 'a/FooTest.java' else 'a/Foo.java' end as path, nullif(l_tax, 0) * 1000 as mi from lineitem)"""


def _methods(t):
    # SQL's cast rounds halves to the even number, as rint does.
    return t("lineitem").select(
        c("l_orderkey").alias("pr"), c("l_linenumber").alias("n"), F.rint("l_quantity").cast("int").alias("cyclomatic"), F.rint(c("l_discount") * 200).cast("int").alias("cognitive"), F.rint(c("l_extendedprice") / 1000).cast("int").alias("loc"), c("l_suppkey").alias("member"),
        F.year("l_shipdate").cast("bigint").alias("sprint"), F.when(c("l_returnflag") == "R", "a/FooTest.java").otherwise("a/Foo.java").alias("path"), (F.nullif("l_tax", F.lit(0.0)) * 1000).alias("maintainability"),
    )


@query(f"""
with {_METHODS}, f as (select pr, n, 'cyclomatic' as rule, cyclomatic as v, 30 as w, 45 as k from m union all select pr, n, 'long_method', loc, 40, 80 from m)
select pr, n, rule, case when v > k then 'CRITICAL' else 'WARNING' end as severity, cast(v as double) as measured, case when rule = 'cyclomatic' then 'cyclomatic complexity ' || v || ' exceeds ' || case when v > k then 'critical' else 'warning' end || ' bound ' || case when v > k then k else w end
  else 'method spans ' || v || ' lines (> ' || case when v > k then 'critical' else 'warning' end || ' bound ' || case when v > k then k else w end || ')' end as detail from f where v > w""")
def classic_findings(t):
    return quality.classic_findings(_methods(t).select("pr", "n", "cyclomatic", "loc"), {"cyclomatic": (30, 45), "loc": (40, 80)}).select("pr", "n", "rule", "severity", "measured", "detail")


@query(f"""
with {_METHODS}, q as (select member, year(l_shipdate) as sprint, avg(cyclomatic) as cc, avg(cognitive) as cog, avg(case when cyclomatic > 10 then 1.0 else 0 end) as over, avg(mi) as mi, sum(case when path like '%Test%' then loc else 0 end) as test, sum(case when path like '%Test%' then 0 else loc end) as code from m group by 1, 2),
d as (select s_suppkey as member, 1995 as sprint, count(*) as debt from supplier group by 1)
select q.member, q.sprint, round(cc, 6) as avg_cc, round(cog, 6) as avg_cognitive, round(over, 6) as over_10, round(mi, 4) as avg_mi, coalesce(debt, 0) as debt, round(case when code > 0 then test / code else 0 end, 6) as test_ratio,
  round(cc - lag(cc) over w, 6) as delta_cc, round(mi - lag(mi) over w, 4) as delta_mi from q left join d on d.member = q.member and d.sprint = q.sprint window w as (partition by q.member order by q.sprint)""")
def student_quality(t):
    m = _methods(t)
    debt = t("supplier").select(c("s_suppkey").alias("member"), F.lit(1995).cast("bigint").alias("sprint"))
    q = quality.student_quality(m, debt, m.select("sprint", c("sprint").alias("start")).distinct())
    six = {k: r(v, 6).alias(k) for k, v in (("avg_cc", "avg_cc"), ("avg_cognitive", "avg_cognitive"), ("over_10", "over_10"), ("test_ratio", "test_ratio"), ("delta_cc", "delta_avg_cc"))}
    return q.select("member", "sprint", *six.values(), r("avg_mi").alias("avg_mi"), r("delta_avg_mi").alias("delta_mi"), "debt")


_SATD_SQL = " ".join(f"when regexp_matches(text, '(?i){p}') then '{name}'" for name, p in ((n, p.replace("'", "''")) for n, p in T.SATD_PATTERNS))


_COMMENTS = ("TODO: tidy", "a stub", "a known issue", "skip test", "update docs", "all fine", "FIXME this bug", "doesn't work", "To  be determined", "ugly but document this")


@query(f"""
with x as (select p_partkey, p_name || ' ' || list_extract({[w.replace("'", "_") for w in _COMMENTS]}, cast(p_partkey % 10 + 1 as integer)) as text from part)
select p_partkey, case {_SATD_SQL} end as category from x where case {_SATD_SQL} end is not null""")
def debt_comments(t):
    text = F.concat("p_name", F.lit(" "), F.element_at(F.array(*[F.lit(w.replace("'", "_")) for w in _COMMENTS]), (c("p_partkey") % 10 + 1).cast("int")))
    return quality.debt_comments(t("part").select("p_partkey", text.alias("text"))).select("p_partkey", "category")


@query("""
with a as (select distinct l_partkey as file, l_returnflag as comment from lineitem where l_linestatus = 'F'), b as (select distinct l_partkey as file, l_returnflag as comment from lineitem where l_linestatus = 'O'),
n as (select l_suppkey as author, 1 as i, 0 as r from lineitem where l_linestatus = 'O' and (l_partkey, l_returnflag) not in (select (file, comment) from a) union all select l_suppkey, 0, 1 from lineitem where l_linestatus = 'F' and (l_partkey, l_returnflag) not in (select (file, comment) from b))
select author, cast(sum(i) as bigint) as introduced, cast(sum(r) as bigint) as removed from n group by 1""")
def debt_delta(t):
    x = t("lineitem").select(c("l_partkey").alias("file"), c("l_returnflag").alias("comment"), c("l_suppkey").alias("author"), "l_linestatus")
    return quality.debt_delta(x.filter("l_linestatus = 'F'").drop("l_linestatus"), x.filter("l_linestatus = 'O'").drop("l_linestatus"))


@query("""
with x as (select o_orderkey as finding, l_suppkey as author, l_linenumber as line, case when l_quantity <= 45 and l_returnflag = 'N' then null when (l_orderkey, l_linenumber) in (select (l_orderkey, l_linenumber) from lineitem where l_quantity > 45) then 3 when l_returnflag = 'R' then 2 else 1 end as b, (epoch(l_shipdate) - 820454400) as moment from orders join lineitem on l_orderkey = o_orderkey and l_linenumber between 1 and o_custkey % 4 + 1),
g as (select finding, author, sum(b) as b, min(case when moment > 0 then moment end) as moment from x where b is not null group by 1, 2)
select finding, author, round(b / sum(b) over (partition by finding), 6) as weight, cast(min(moment) over (partition by finding) as bigint) as introduced from g""")
def weighted_attribution(t):
    text = F.when(c("l_returnflag") == "R", "  } else if (a) {").when(c("l_returnflag") == "A", 'a = "if (b)"; // for').otherwise(" });")
    files = t("lineitem").select(c("l_orderkey").alias("file"), c("l_linenumber").alias("line"), text.alias("text"), c("l_suppkey").alias("author"), (F.unix_seconds(c("l_shipdate").cast("timestamp")) - 820454400).alias("at"), "l_quantity")
    files = files.withColumn("text", F.when(c("l_quantity") > 45, "offending").otherwise(c("text")))
    bad = quality.line_badness(files, files.filter("l_quantity > 45").select("file", "line"))
    f = t("orders").select(c("o_orderkey").alias("finding"), c("o_orderkey").alias("file"), F.lit(1).alias("start"), (c("o_custkey") % 4 + 1).alias("end"))
    x = quality.weighted_attribution(f, bad)
    return x.select("finding", "author", r("weight", 6).alias("weight"), "introduced")


# Project grades

_KEYS_SPRING, _KEYS_ANDROID = project.AXES["size"]["spring"], project.AXES["size"]["android"]
_MORE = (*project.AXES["complexity"]["spring"], *project.AXES["complexity"]["android"], "production_loc", "production_statement_count", "fcm_send_call_count", "fcm_android_room_store", "email_send_site_count", "okhttp_external_api_count")
_ALL_KEYS = list((*_KEYS_SPRING, *_KEYS_ANDROID, *_MORE))
_METRICS = f"""x as (select c_nationkey as project, case when c_custkey % 2 = 0 then 'org/android-' else 'org/spring-' end || c_nationkey as repo, list_extract({_ALL_KEYS}, cast(c_custkey % {len(_ALL_KEYS)} + 1 as integer)) as key, round(abs(c_acctbal) / 100) as value from customer),
mt as (select project, repo, key, sum(value) as value from x group by 1, 2, 3)"""


def _metrics(t):
    x = t("customer").select(
        c("c_nationkey").alias("project"), F.concat(F.when(c("c_custkey") % 2 == 0, "org/android-").otherwise("org/spring-"), c("c_nationkey").cast("string")).alias("repo"),
        F.element_at(F.array(*map(F.lit, _ALL_KEYS)), (c("c_custkey") % len(_ALL_KEYS) + 1).cast("int")).alias("key"), F.round(F.abs("c_acctbal") / 100).alias("value"),
    )
    return x.groupBy("project", "repo", "key").agg(F.sum("value").alias("value"))


def _axis_sql(axis):
    keys = project.AXES[axis]
    fits = " or ".join(f"(kind = '{kind}' and key in {ks})" for kind, ks in keys.items())
    return f"""{axis}_r as (select project, kind, repo, avg(score) as s from sc where {fits} group by 1, 2, 3), {axis}_k as (select project, kind, avg(s) as s, case kind when 'android' then 0.6 else 0.4 end as w from {axis}_r group by 1, 2),
{axis}_p as (select project, sum(s * w) / sum(w) as v from {axis}_k group by 1)"""


_NORMAL = """case when p10 = p90 then 5 when value < p10 then greatest(0, least(2, case when p10 = 0 then 1 else value * 2 / p10 end)) when value > p90 then greatest(8, least(10, case when p90 = 1 then 9 else 8 + (value - p90) * 2 / (1 - p90) end)) else 2 + (value - p10) * 6 / (p90 - p10) end"""
_AXES = f"""{_METRICS}, g as (select distinct project from mt where key in ('production_loc', 'production_statement_count') and value > 0),
tot as (select project, key, sum(value) as value from mt where key = 'production_statement_count' group by 1, 2), ev as (select key, value from mt where key <> 'production_statement_count' union all select key, value from tot),
bo as (select key, quantile_cont(value, 0.1) as p10, quantile_cont(value, 0.9) as p90 from ev group by 1),
sc as (select project, repo, case when contains(repo, '/android') then 'android' else 'spring' end as kind, key, {_NORMAL} as score from mt join bo using (key) where project in (select project from g)),
vo as (select project, greatest(0, least(10, {_NORMAL})) as v from tot join bo using (key) where value > 0 and project in (select project from g)), {_axis_sql("size")}, {_axis_sql("complexity")},
pr as (select n_nationkey as project, case when n_nationkey % 5 > 0 then 80.0 + n_nationkey end as mi, case when n_nationkey % 3 = 0 then 0.5 else 0.0 end as mu from nation),
ax as (select pr.project, g.project is not null as code, case when b.v is null then vo.v when vo.v is null then b.v else 0.7 * b.v + 0.3 * vo.v end as size, k.v as complexity,
  case when g.project is not null and mi is not null then case when mu > 0 then (0.35 * greatest(0, least(10, (mi - 85) / 13 * 10)) + 0.1 * mu * 10) / 0.45 else greatest(0, least(10, (mi - 85) / 13 * 10)) end end as quality
  from pr left join g using (project) left join size_p b using (project) left join vo using (project) left join complexity_p k using (project)),
ay as (select *, coalesce(case when size is null then complexity when complexity is null then size else (0.2 * size + 0.3 * complexity) / 0.5 end, 0) * 1.5 as work_base, case when code then 0.25 + 0.75 * coalesce(quality, 10) / 10 else 0 end as quality_multiplier from ax)"""


def _axes(t):
    m = _metrics(t)
    p = t("nation").select(c("n_nationkey").alias("project"), F.when(c("n_nationkey") % 5 > 0, 80.0 + c("n_nationkey")).alias("maintainability"), F.when(c("n_nationkey") % 3 == 0, 0.5).otherwise(0.0).alias("mutation"))
    return m, project.project_axes(p, m, project.cohort_bounds(m), {"work_scale": 1.5})


@query(f"with {_AXES} select project, round(size, 6) as size, round(complexity, 6) as complexity, round(quality, 6) as quality, round(work_base, 6) as work_base, round(quality_multiplier, 6) as quality_multiplier from ay")
def project_axes_of_repos(t):
    return _axes(t)[1].select("project", *[r(k, 6).alias(k) for k in ("size", "complexity", "quality", "work_base", "quality_multiplier")])


_EXTRA = f"""et as (select project, sum(case when key = 'fcm_send_call_count' then value end) as a, sum(case when key = 'fcm_android_room_store' then value end) as b, sum(case when key = 'email_send_site_count' then value end) as e, sum(case when key = 'okhttp_external_api_count' then value end) as o from mt group by 1),
ex as (select project, case when a > 0 then least(a, 3) else 0 end + case when b > 0 then least(b / 2, 1) * 3 else 0 end + case when e > 0 then least(e, 3) / 3 * 2 else 0 end + coalesce(o, 0) as extra_tech from et)"""


@query(f"with {_METRICS}, {_EXTRA} select project, round(extra_tech, 6) as extra_tech from ex")
def extra_technology(t):
    return project.extra_technology(_metrics(t)).select("project", r("extra_tech", 6).alias("extra_tech"))


@query(f"""
with {_METRICS}, f as (select s_nationkey as project, sum(case when s_suppkey % 3 = 0 then 1 / 3.0 when s_acctbal > 5000 then 2 else 1 end) as n from supplier group by 1), l as (select project, sum(value) / 1000 as k from mt where key = 'production_loc' group by 1)
select coalesce(f.project, l.project) as project, round(case when coalesce(k, 0) > 0 or coalesce(n, 0) > 0 then coalesce(n, 0) / greatest(coalesce(k, 0), 1) end, 6) as density from f full join l on f.project = l.project""")
def violation_density(t):
    f = t("supplier").select(c("s_nationkey").alias("project"), F.when(c("s_suppkey") % 3 == 0, "complexity").otherwise("static").alias("kind"), F.when(c("s_acctbal") > 5000, "security").alias("category"))
    return project.violation_density(f, _metrics(t)).select("project", r("density", 6).alias("density"))


@query("""
select s_nationkey as project, count(case when upper(case when s_acctbal > 4000 then 'error' else 'Warning' end) = 'ERROR' then 1 end) as critical, count(case when s_acctbal <= 4000 then 1 end) as warnings from supplier where s_suppkey % 4 <> 1 and s_suppkey % 5 <> 2 group by 1""")
def architecture_counts(t):
    x = t("supplier").select(
        c("s_nationkey").alias("project"), F.when(c("s_suppkey") % 5 == 2, "ast").otherwise("layer_dependency").alias("rule_kind"), F.when(c("s_suppkey") % 4 == 1, "domain->!presentation").otherwise("presentation->!infrastructure").alias("rule_name"),
        F.when(c("s_acctbal") > 4000, "error").otherwise("Warning").alias("severity"),
    )
    return project.architecture_counts(x)


_PENALTY = """bl as (select s_nationkey as project, s_suppkey as student, least(sum(case when l_returnflag = 'R' then l_discount else 0 end), 1) as a, least(sum(case when l_returnflag = 'A' then l_discount else 0 end), 2) as b from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
ow as (select project, student, a + b as total from bl), pe as (select project, student, least(0.8 * total, 1) + least(0.2 * sum(total) over (partition by project) / count(*) over (partition by project), 0.5) as penalty from ow)"""


def _penalties(t):
    x = t("lineitem").join(t("supplier"), c("l_suppkey") == c("s_suppkey"))
    blame = x.select(c("s_nationkey").alias("project"), c("s_suppkey").alias("student"), F.when(c("l_returnflag") == "R", "a").when(c("l_returnflag") == "A", "b").otherwise("c").alias("signal"), c("l_discount").alias("blame"))
    return project.quality_penalties(blame, {"a": 1.0, "b": 2.0})


@query(f"with {_PENALTY} select project, student, round(penalty, 6) as penalty from pe")
def quality_penalties(t):
    return _penalties(t).select("project", "student", r("penalty", 6).alias("penalty"))


@query(f"""
with {_AXES}, {_EXTRA}, {_PENALTY}, pj as (select ay.project, least(10, 10 * pow(greatest(work_base * 0.8 * quality_multiplier + least(coalesce(extra_tech, 0) / 10, 1), 0) / 10, 1.5)) as p from ay left join ex using (project)),
st as (select s_nationkey as project, s_suppkey as student, abs(s_acctbal) / 5000 as share, s_suppkey % 3 as k from supplier),
gr as (select project, student, p, greatest(0, least(10, p * sqrt(least(share, 1.5)) - coalesce(penalty, 0) - 0.5 * k)) as g from st join pj using (project) left join pe using (project, student))
select project, student, floor(p * 10 + 0.5) / 10 as project_final, floor(g * 10 + 0.5) / 10 as student_final from gr""")
def final_grades(t):
    m, axes = _axes(t)
    p = axes.join(project.extra_technology(m), "project", "left").withColumns({"extra_tech": F.coalesce("extra_tech", F.lit(0.0)), "ai_factor": F.lit(0.8)})
    s = t("supplier").select(c("s_nationkey").alias("project"), c("s_suppkey").alias("student"), (F.abs("s_acctbal") / 5000).alias("share"), (c("s_suppkey") % 3).alias("criticals"))
    return project.final_grades(p, s.join(_penalties(t), ["project", "student"], "left"), 1.5, 1)


@query("""
with f as (select s_suppkey as student, case s_suppkey % 4 when 0 then 'ZERO_TASKS' when 1 then 'CARRYING_TEAM' when 2 then 'STATIC_ANALYSIS_HOTSPOT' else 'LOW_REVIEWS' end as flag from lineitem join supplier on s_suppkey = l_suppkey where l_returnflag = 'R')
select student, count(*) as criticals from f where flag in ('CARRYING_TEAM', 'LOW_REVIEWS') group by 1""")
def critical_flags(t):
    names = F.array(*map(F.lit, ("ZERO_TASKS", "CARRYING_TEAM", "STATIC_ANALYSIS_HOTSPOT", "LOW_REVIEWS")))
    x = t("lineitem").join(t("supplier"), c("l_suppkey") == c("s_suppkey"))
    return project.critical_flags(x.select(c("s_suppkey").alias("student"), F.element_at(names, (c("s_suppkey") % 4 + 1).cast("int")).alias("flag"), F.when(c("l_returnflag") == "R", "CRITICAL").otherwise("INFO").alias("severity")))


@query("""
with s as (select o_orderkey as pr, case when o_orderstatus <> 'P' then o_totalprice end as v from orders), a as (select l_orderkey as pr, l_suppkey as member from lineitem)
select s_nationkey as project, round(avg(v), 4) as mean from s join a using (pr) join supplier on s_suppkey = member where v is not null group by 1""")
def documentation_means(t):
    s = t("orders").select(c("o_orderkey").alias("pr"), F.when(c("o_orderstatus") != "P", c("o_totalprice")).alias("mean"))
    a, m = t("lineitem").select(c("l_orderkey").alias("pr"), c("l_suppkey").alias("member")), t("supplier").select(c("s_suppkey").alias("member"), c("s_nationkey").alias("project"))
    return project.raw_means(s, a, m, "mean").withColumn("mean", r("mean"))


# Report datasets


@query("""
with p as (select l_orderkey as pr, count(*) as ls from lineitem group by 1), k as (select o_orderkey as pr, o_custkey as task, o_orderkey % 4 as points from orders),
w as (select *, sum(points) over (partition by task) as total, count(*) over (partition by task) as n from k join p using (pr))
select task, cast(sum(ls) as bigint) as ls, round(sum(case when total = 0 then ls / cast(n as double) else ls * points / cast(total as double) end), 6) as weighted from w group by 1""")
def task_lines(t):
    p = t("lineitem").groupBy(c("l_orderkey").alias("pr")).agg(F.count("*").alias("ls"))
    k = t("orders").select(c("o_orderkey").alias("pr"), c("o_custkey").alias("task"), (c("o_orderkey") % 4).alias("points"))
    return reports.task_lines(k, p, "task").select("task", "ls", r("weighted", 6).alias("weighted"))


@query("""
with x as (select l_suppkey as author, l_returnflag as rule, case when l_linestatus = 'F' then 'CRITICAL' else 'INFO' end as severity, least(l_discount * 10, 1) as share from lineitem)
select author, rule, count(*) as n, count(case when severity = 'CRITICAL' then 1 end) as critical, round(sum(share), 4) as weight, max(case when severity = 'CRITICAL' then 2 else 1 end) = 2 as severe from x group by 1, 2""")
def findings_per_student(t):
    x = t("lineitem").select(c("l_suppkey").alias("author"), c("l_returnflag").alias("rule"), F.when(c("l_linestatus") == "F", "CRITICAL").otherwise("INFO").alias("severity"), F.least(c("l_discount") * 10, F.lit(1.0)).alias("share"))
    f = reports.findings_by_author(x, "rule")
    return f.select("author", "rule", "n", "critical", r("weight").alias("weight"), (c("worst") == "CRITICAL").alias("severe"))


@query("""
select s_suppkey as member, s_name as name, string_agg('login' || l_orderkey % 3, ',' order by 'login' || l_orderkey % 3) as logins, count(*) as n from (select distinct s_suppkey, s_name, l_orderkey % 3 as l_orderkey from supplier join lineitem on l_suppkey = s_suppkey) group by 1, 2""")
def identity_map(t):
    i = t("lineitem").select(c("l_suppkey").alias("member"), F.lit("login").alias("kind"), F.concat(F.lit("LOGIN"), (c("l_orderkey") % 3).cast("string")).alias("value"))
    return reports.identity_map(t("supplier").select(c("s_suppkey").alias("member"), c("s_name").alias("name")), i).select("member", "name", "logins", "n")


@query("""
with a as (select c_nationkey as team, o_custkey as member, count(*) as tasks, count(case when o_orderstatus = 'F' then 1 end) as done, coalesce(sum(case when o_orderstatus = 'F' then o_orderkey % 5 end), 0) as points from orders join customer on c_custkey = o_custkey group by 1, 2),
b as (select l_suppkey as member, count(*) as prs, count(case when l_returnflag = 'A' then 1 end) as merged, sum(l_quantity) as lines from lineitem group by 1)
select team, a.member, tasks, done, cast(points as bigint) as points, coalesce(prs, 0) as prs, coalesce(merged, 0) as merged, coalesce(lines, 0) as lines from a left join b on a.member = b.member""")
def team_snapshot(t):
    x = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey"))
    tasks = x.select(c("c_nationkey").alias("team"), c("o_custkey").alias("member"), (c("o_orderstatus") == "F").alias("done"), (c("o_orderkey") % 5).alias("points"))
    prs = t("lineitem").select(c("l_suppkey").alias("member"), (c("l_returnflag") == "A").alias("merged"), c("l_quantity").alias("lines"))
    return reports.snapshot(tasks, prs)


@query("""
with g as (select l_returnflag as team, l_linenumber as points, count(*) as tasks, avg(l_quantity) as mean, stddev_pop(l_quantity) as spread from lineitem where l_linenumber > 0 group by 1, 2), u as (select team, mean as unit from g where points = 1)
select team, points, tasks, round(mean, 6) as mean, round(spread, 6) as spread, round(mean / unit, 6) as ratio from g left join u using (team)""")
def estimation_quality(t):
    x = reports.estimation_quality(t("lineitem").select(c("l_returnflag").alias("team"), c("l_linenumber").alias("points"), c("l_quantity").alias("lines")))
    return x.select("team", "points", "tasks", *[r(k, 6).alias(k) for k in ("mean", "spread", "ratio")])


@query("""
with f as (select o_custkey as member, case when o_orderstatus = 'F' then o_orderkey end as pr, o_orderpriority as flag, 'INFO' as severity from orders)
select member, coalesce(c_name, member::varchar) as name, flag, severity, pr, p_name as title, p_brand as url from f left join customer on c_custkey = member and c_acctbal > 0 left join part on p_partkey = pr""")
def enriched_flags(t):
    details = F.when(c("o_orderstatus") == "F", F.to_json(F.struct(c("o_orderkey").alias("pr")))).otherwise("not json")
    f = t("orders").select(c("o_custkey").alias("member"), c("o_orderpriority").alias("flag"), F.lit("INFO").alias("severity"), details.alias("details"))
    members = t("customer").filter("c_acctbal > 0").select(c("c_custkey").alias("member"), c("c_name").alias("name"))
    return reports.enriched(f, members, t("part").select(c("p_partkey").alias("pr"), c("p_name").alias("title"), c("p_brand").alias("url")))


@query("""
select o_orderkey as pr from orders where o_orderstatus <> 'O' and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_suppkey = o_custkey % 10)""")
def pending_builds(t):
    p = t("orders").select(c("o_orderkey").alias("pr"), (c("o_orderstatus") != "O").alias("merged"), (c("o_custkey") % 10).alias("sha"))
    return reports.pending_builds(p, t("lineitem").select(c("l_orderkey").alias("pr"), c("l_suppkey").alias("sha"))).select("pr")


@query("""
with f as (select l_suppkey as member, l_shipmode_ as flag, case l_returnflag when 'A' then 'CRITICAL' when 'R' then 'WARNING' else 'INFO' end as severity from (select *, 'F' || l_linenumber as l_shipmode_ from lineitem))
select member, count(case when severity = 'CRITICAL' then 1 end) as critical, count(case when severity = 'WARNING' then 1 end) as warning, count(case when severity = 'INFO' then 1 end) as info, count(*) as total, string_agg(distinct flag, ',' order by flag) as flags from f group by 1""")
def flag_counts(t):
    severity = F.when(c("l_returnflag") == "A", "CRITICAL").when(c("l_returnflag") == "R", "WARNING").otherwise("INFO")
    return reports.flag_counts(t("lineitem").select(c("l_suppkey").alias("member"), _text("l_linenumber", "F").alias("flag"), severity.alias("severity")), ["member"])


# Likelihood of generated work, keys, caches


@query("""
with f as (select distinct l_suppkey as member, l_linenumber as sprint, case l_returnflag when 'A' then 'SINGLE_COMMIT_DUMP' when 'R' then 'COSMETIC_REWRITE' else 'COSMETIC_REWRITE_ACTOR' end as flag from lineitem where l_quantity > 42),
g as (select member, sprint, 0.3 * max(case when flag = 'SINGLE_COMMIT_DUMP' then 1 else 0 end) + 0.2 * max(case when flag like 'COSMETIC%' then 1 else 0 end) as score from f group by 1, 2)
select o_orderkey as pr, round(cast(coalesce(score, 0) as double), 6) as score from orders left join g on member = case when o_orderstatus = 'P' then null else o_custkey % 100 end and sprint = o_orderkey % 7""")
def heuristic_scores(t):
    flag = F.when(c("l_returnflag") == "A", "SINGLE_COMMIT_DUMP").when(c("l_returnflag") == "R", "COSMETIC_REWRITE").otherwise("COSMETIC_REWRITE_ACTOR")
    f = t("lineitem").filter("l_quantity > 42").select(c("l_suppkey").alias("member"), c("l_linenumber").alias("sprint"), flag.alias("flag"))
    p = t("orders").select(c("o_orderkey").alias("pr"), F.when(c("o_orderstatus") != "P", c("o_custkey") % 100).alias("author"), (c("o_orderkey") % 7).alias("sprint"))
    return likelihood.heuristic_scores(p, f).withColumn("score", r("score", 6))


@query("""
with s as (select l_partkey as path, l_linenumber % 5 as k, avg(l_discount * 8) as v from lineitem where l_linenumber % 5 < 4 and l_tax > 0.02 group by 1, 2),
w as (select path, greatest(0, least(1, v)) as v, case k when 0 then 0.4 when 1 then 0.3 when 2 then 0.2 else 0.1 end as w from s), f as (select path, sum(v * w) / sum(w) as score, count(*) as n from w group by 1)
select path, round(score, 6) as score, case when n >= 4 then 'high' when n >= 3 then 'medium' else 'low' end as confidence, case when round(score, 9) > 0.65 then 'high' when round(score, 9) > 0.4 then 'elevated' else 'low' end as risk from f""")
def fused_files(t):
    s = t("lineitem").filter("l_tax > 0.02").select(c("l_partkey").alias("path"), F.concat(F.lit("s"), (c("l_linenumber") % 5).cast("string")).alias("signal"), (c("l_discount") * 8).alias("value"))
    x = likelihood.fused_files(s, {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1})
    risk = F.when(F.round("score", 9) > 0.65, "high").when(F.round("score", 9) > 0.4, "elevated").otherwise("low")
    return x.select("path", r("score", 6).alias("score"), "confidence", risk.alias("risk"))


@query(r"""
with d as (select source as member, string_agg(text, chr(10) order by text) as text from (select distinct source, text from documents where text is not null and regexp_matches(text, '\S') and source is not null) group by 1)
select member, cast(length(text) as bigint) as chars from d where len(regexp_extract_all(text, '\S+')) >= 100""")
def gathered_text(t):
    # As many characters as the texts, apart by line breaks, would have.
    x = profiles.gathered(t("documents").select(c("source").alias("member"), "text"))
    return x.select("member", (c("chars") + c("messages") - 1).alias("chars"))


@query("""
select 'l_orderkey' as columns, count(*) as rows, count(distinct l_orderkey) as "distinct", 0 as nulls, count(*) = count(distinct l_orderkey) as "unique" from lineitem union all
select 'l_orderkey,l_linenumber', count(*), count(distinct (l_orderkey, l_linenumber)), 0, count(*) = count(distinct (l_orderkey, l_linenumber)) from lineitem union all
select 'l_orderkey,l_linenumber,l_partkey', count(*), count(distinct (l_orderkey, l_linenumber, l_partkey)), 0, count(*) = count(distinct (l_orderkey, l_linenumber, l_partkey)) from lineitem""")
def key_candidates(t):
    x = maintenance.key_candidates(t("lineitem"), [["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey"]])
    return x.withColumn("nulls", c("nulls").cast("int"))


@query("""
select o_orderkey, case when o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') then null else o_totalprice end as o_totalprice, o_orderstatus from orders""")
def reset_scores(t):
    scope = t("customer").filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    return maintenance.reset_scores(t("orders"), scope, ["o_custkey"], ["o_totalprice"]).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("select p_partkey from part where p_brand in (select p_brand from part where p_size > 45)")
def purged_cache(t):
    p = t("part")
    return maintenance.purge_cache(p.select("p_partkey", "p_brand"), p.filter("p_size > 45"), ["p_brand"]).select("p_partkey")


@query("""
select l_suppkey as team, count(distinct l_orderkey::varchar || l_linenumber::varchar) as commits, count(distinct l_orderkey) as prs from lineitem group by 1""")
def distinct_pairs(t):
    return t("lineitem").groupBy(c("l_suppkey").alias("team")).agg(F.countDistinct(F.concat(c("l_orderkey").cast("string"), c("l_linenumber").cast("string"))).alias("commits"), F.countDistinct("l_orderkey").alias("prs"))


@query("""
with x as (select l_orderkey, l_linenumber, l_suppkey as g, l_quantity / (l_linenumber + 1) as d from lineitem), m as (select g, median(d) as med from x group by 1), a as (select x.*, med, abs(d - med) as dev from x join m using (g)), s as (select g, median(dev) as mad from a group by 1)
select l_orderkey, l_linenumber, g, round(d, 6) as d, round(case when mad > 0 then (d - med) / mad end, 6) as z from a join s using (g)""")
def density_z(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", c("l_suppkey").alias("g"), (c("l_quantity") / (c("l_linenumber") + 1)).alias("d"))
    return stats.mad_outliers(x, ["g"], "d", 3.0, 1).select("l_orderkey", "l_linenumber", "g", r("d", 6).alias("d"), r("z", 6).alias("z"))


@query("""
with s as (select l_orderkey as pr, arg_max(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_quantity)) as score from lineitem where l_discount > 0 group by 1)
select o_orderkey as pr, score, vec_id from orders join s on pr = o_orderkey join embeddings on vec_id = o_orderkey where o_orderstatus <> 'P'""")
def labelled_rows(t):
    prs = t("orders").select(c("o_orderkey").alias("pr"), F.when(c("o_orderstatus") != "P", "text").alias("body"))
    scores = t("lineitem").select(c("l_orderkey").alias("pr"), F.when(c("l_discount") > 0, c("l_quantity")).alias("score"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_quantity").alias("at"))
    return likelihood.labelled(prs, scores, t("embeddings").select(c("vec_id").alias("pr"), c("vec_id"))).select("pr", "score", "vec_id")

"""Queries on forms of texts, numbers and times, and on replies of judges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col as c

from cohortlens.functions import judge
from cohortlens.functions import scalar as S
from cohortlens.functions import text as T
from cohortlens.plans.queries import query, r


@query("""
with x as (select l_orderkey, case l_linenumber % 4 when 0 then case when l_quantity = 1 then 'a = f(_STR_, 1);' else 'a = f(_STR_, _NUM_);' end when 1 then 'c = _CHR_; n = _NUM_ + v2;'
  when 2 then 't = _STR_;' else case when l_orderkey <= 1 then 'return -' || l_orderkey || ';' else 'return -_NUM_;' end end as masked from lineitem)
select masked, count(*) as n, count(distinct l_orderkey) as n_orders from x group by 1""")
def masked_statements(t):
    """Line items as statements: those that differ in literals and white space only are one."""
    k = c("l_linenumber") % 4
    statement = F.when(k == 0, F.format_string('a = f("p\\"%d",  %d);', c("l_partkey"), c("l_quantity").cast("int")))
    statement = statement.when(k == 1, F.format_string("c = '\\'';\tn = %d.5 + v2;", "l_linenumber"))
    statement = statement.when(k == 2, F.format_string('t = """one\n"%d" """;', "l_partkey")).otherwise(F.format_string(" return -%d;", "l_orderkey"))
    x = t("lineitem").select("l_orderkey", T.mask_statement(statement).alias("masked"))
    return x.groupBy("masked").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders"))


@query("""
with x as (select distinct l_orderkey, l_suppkey % 5 as i from lineitem)
select l_orderkey, string_agg('import a.p' || i || ';', chr(10) order by i) as imports from x group by 1""")
def import_blocks(t):
    lines = F.format_string("import   a.p%d;\r", c("l_suppkey") % 5)
    x = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(lines).alias("lines"))
    return x.select("l_orderkey", F.array_join(T.imports_form(F.concat("lines", F.array(F.lit(" ")))), "\n").alias("imports"))


@query(r"""
select doc_id, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) as slug,
  md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as escaped,
  md5('title: ' || coalesce(source, '') || chr(10) || 'body: ' || coalesce(text, '') || chr(10) || 'additions: ' || n_chars || chr(10) || 'deletions: ') as model_input from documents""")
def escaped_texts(t):
    none = F.lit(None).cast("bigint")
    model_input = T.embedding_input(c("source"), c("text"), c("n_chars"), none)
    return t("documents").select("doc_id", F.md5(T.slug(c("text"))).alias("slug"), F.md5(T.html_escape(c("text"))).alias("escaped"), F.md5(model_input).alias("model_input"))


@query("""
with p as (select p_partkey, p_partkey % 6 as k, p_partkey % 2 = 0 as spring, p_name from part)
select p_partkey, k in (1, 2) as modifies,
  case when k = 0 and spring then 'spring_controller,spring_repository' when k = 1 and not spring then 'android_recyclerview' when k = 3 and not spring then 'android_fragment,android_layout'
    when k = 4 and spring then 'spring_service' else '' end as layers, k = 1 as fixes from p""")
def title_layers(t):
    k = c("p_partkey") % 6
    titles = ("Create the controller and its repository", "Fix: Adapter of lists", "update (all)", "fragment + layout", "Servicio", "zweite Liste")
    title = F.coalesce(*[F.when(k == i, x) for i, x in enumerate(titles)])
    words = T.title_tokens(title)
    stack = F.when(c("p_partkey") % 2 == 0, "spring").otherwise("android")
    return t("part").select("p_partkey", (T.action_tag(words) == "modify").alias("modifies"), F.array_join(T.layer_tags(words, stack), ",").alias("layers"), T.is_fix_title(title).alias("fixes"))


@query("""
with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * case l_linenumber % 4 when 0 then 1 when 1 then 60 when 2 then 1440 end as minutes,
  case when l_extendedprice = floor(l_extendedprice) then printf('%.0f', l_extendedprice) else printf('%.2f', l_extendedprice) end as price,
  round(1 + (l_quantity - 1) * 9 / 49, 6) as mapped, case when l_discount = 0 then 2.5 else round(5 * l_quantity / (l_discount * 100), 6) end as spread,
  round(greatest(0, least(100, 171 - 5.2 * ln(l_extendedprice) - 0.23 * l_linenumber - 16.2 * ln(l_quantity) + 50 * sin(sqrt(2.4 * l_discount)))), 6) as maintainability from x""")
def number_forms(t):
    """Intervals, prices, positions on scales and an index of maintainability of line items."""
    unit = F.coalesce(*[F.when(c("l_linenumber") % 4 == i, u) for i, u in enumerate(("m", "h", "d", "w"))])
    zero = F.lit(0.0)
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.minutes_of(F.concat(c("l_quantity").cast("int").cast("string"), unit)).cast("double").alias("minutes"),
        S.format_float(c("l_extendedprice"), 2).alias("price"),
        r(S.linear_map(c("l_quantity"), 1.0, 50.0, 1.0, 10.0), 6).alias("mapped"),
        r(S.linear_map(c("l_quantity"), zero, c("l_discount") * 100, 0.0, 5.0), 6).alias("spread"),
        r(S.maintainability_index(c("l_extendedprice"), c("l_linenumber"), c("l_quantity"), c("l_discount")), 6).alias("maintainability"),
    )


@query("""
with g as (select l_orderkey, list_sort(list(l_extendedprice)) as x, min(l_tax) filter (where l_tax > 0) as least_tax from lineitem group by 1)
select l_orderkey, x[(50 * len(x) - 1) // 100 + 1] as p50, x[(95 * len(x) - 1) // 100 + 1] as p95, least_tax from g""")
def rank_pairs(t):
    x = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("x"), S.first_time(c("l_tax")).alias("least_tax"))
    return x.select("l_orderkey", S.nearest_rank(c("x"), 50).alias("p50"), S.nearest_rank(c("x"), 95).alias("p95"), "least_tax")


@query("""
with x as (select o_orderkey, o_orderdate + to_hours(o_orderkey % 24) as told from orders),
y as (select *, last_day(make_date(year(told), 3, 1)) as m, last_day(make_date(year(told), case when year(told) < 1996 then 9 else 10 end, 1)) as o from x),
z as (select o_orderkey, told, told >= m - dayofweek(m)::integer + interval 1 hour and told < o - dayofweek(o)::integer + interval 1 hour as summer from y)
select o_orderkey, case when o_orderkey % 10 = 9 then 'soon' when summer then strftime(told + interval 2 hour, '%-d %B %Y, %H:%M CEST') else strftime(told + interval 1 hour, '%-d %B %Y, %H:%M CET') end as said from z""")
def local_times(t):
    """Orders' times in their own offsets, told in a zone with clock changes (summer ended in September until 1995); other text stays."""
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=c("o_orderkey") % 24)
    shown = F.when(c("o_orderkey") % 2 == 0, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    shown = shown.otherwise(F.concat(F.date_format(at + F.make_dt_interval(hours=F.lit(5), mins=F.lit(30)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
    return t("orders").select("o_orderkey", S.local_time(F.when(c("o_orderkey") % 10 == 9, "soon").otherwise(shown)).alias("said"))


@query("""
with n as (select o_custkey, o_orderkey, o_orderkey % 5 as k, o_orderstatus as s, o_totalprice as p from orders),
old as (select *, case when k < 4 then [{'kind': 'K' || i, 'detail': 'd' || i} for i in range(k)] else [] end as a from n),
new as (select o_orderkey, list_concat(a, [{'kind': s, 'detail': 'at "' || o_custkey || '"'}]) as a from old)
select o_orderkey, '[' || list_aggregate(list_transform(a[greatest(len(a) - 2, 1):], lambda x: '{"kind":"' || x.kind || '","detail":"' || replace(x.detail, '"', chr(92) || '"') || '"}'), 'string_agg', ',') || ']' as notes from new""")
def appended_notes(t):
    """Notes kept as JSON, the last three of them; a fifth of the stored ones is no JSON and starts anew."""
    k = c("o_orderkey") % 5
    item = lambda i: F.struct(F.concat(F.lit("K"), i.cast("string")).alias("kind"), F.concat(F.lit("d"), i.cast("string")).alias("detail"))
    some = F.when(k > 0, F.to_json(F.transform(F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0))), item)))
    old = F.when(k == 4, "none yet").otherwise(some)
    return t("orders").select("o_orderkey", T.append_json(old, c("o_orderstatus"), F.concat(F.lit('at "'), c("o_custkey").cast("string"), F.lit('"')), 3).alias("notes"))


@query("""
select o_custkey, '{"early": ' || count(*) filter (where month(o_orderdate) <= 4) || ', "mid": ' || count(*) filter (where month(o_orderdate) between 5 and 8) || ', "late": '
  || count(*) filter (where month(o_orderdate) >= 9) || ', "cramming": ' || count(*) filter (where month(o_orderdate) = 12) || '}' as spread from orders group by 1""")
def spread_notes(t):
    m = F.month("o_orderdate")
    x = t("orders").groupBy("o_custkey").agg(*[F.count_if(v).alias(k) for k, v in {"early": m <= 4, "mid": (m > 4) & (m <= 8), "late": m > 8, "cramming": m == 12}.items()])
    return x.select("o_custkey", T.spread_json(c("early"), c("mid"), c("late"), c("cramming")).alias("spread"))


@query("""
select l_orderkey as pr, case l_linenumber % 3 when 0 then 'error_handling' when 1 then 'naming' else 'other' end as category, case when l_returnflag = 'R' then 'CRITICAL' else 'INFO' end as severity,
  'item ' || l_partkey as summary, case when l_linestatus = 'O' then 's' || l_suppkey end as student_id, count(*) as n from lineitem where l_orderkey % 5 < 3 group by all""")
def judged_flags(t):
    """Replies of a judge on orders, a flag for each line item: bare, in a code fence, inside prose with other braces; those with an unknown severity, and prose alone, give none."""
    category = F.coalesce(*[F.when(c("l_linenumber") % 3 == i, v) for i, v in enumerate(("Error-Handling", " naming", "taste"))])
    severity = F.when(c("l_orderkey") % 5 == 3, "fatal").when(c("l_returnflag") == "R", "critical").otherwise(" Info ")
    student = F.when(c("l_linestatus") == "O", F.format_string(" s%d", "l_suppkey")).otherwise(" ")
    flag = F.struct(category.alias("category"), severity.alias("severity"), F.format_string(" item %d ", "l_partkey").alias("summary"), student.alias("student_id"))
    x = t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(flag).alias("flags"))).alias("json"))
    k = c("l_orderkey") % 5
    reply = F.when(k == 0, c("json")).when(k == 1, F.concat(F.lit("```json\n"), "json", F.lit("\n```"))).when(k == 4, "Nothing {to say}.")
    reply = reply.otherwise(F.concat(F.lit("The {pull} request: "), "json", F.lit(" So far {}.")))
    flags = x.select(c("l_orderkey").alias("pr"), F.explode(judge.judge_flags(reply)).alias("f")).select("pr", "f.category", "f.severity", "f.summary", "f.student_id")
    return flags.groupBy("pr", "category", "severity", "summary", "student_id").agg(F.count("*").alias("n"))

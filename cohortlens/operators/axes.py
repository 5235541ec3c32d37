"""Raw values of project axes, statements of tasks and pull requests, and what to look at when numbers seem off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import safe_divide
from cohortlens.operators.relational import distribute
from cohortlens.operators.stats import mad_outliers


def _of_projects(rows: DataFrame, members: DataFrame, sprints: DataFrame) -> DataFrame:
    """rows (member, sprint, ..) of the given sprints with the member's project."""
    m = members.select(F.col("member").alias("m2"), "project")
    return rows.join(sprints.select("sprint").distinct(), "sprint", "left_semi").join(m, F.col("member") == F.col("m2")).drop("m2")


def code_quality_raw(quality: DataFrame, mutations: DataFrame, authors: DataFrame, members: DataFrame, sprints: DataFrame) -> DataFrame:
    """By project of ``members``: value (mean maintainability), over_10 (mean share of complex methods, of rows with a maintainability), mutation (mean score over pull requests and authors), present (whether there is a value). quality: member, sprint, maintainability, over_10; mutations: pr, sprint, score; authors: pr, member; members: member, project."""
    q = _of_projects(quality.filter("maintainability is not null"), members, sprints).groupBy("project").agg(F.avg("maintainability").alias("value"), F.avg("over_10").alias("over_10"))
    scored = mutations.filter("score is not null").join(authors.select(F.col("pr").alias("p2"), "member"), F.col("pr") == F.col("p2"))
    m = _of_projects(scored.select("member", "sprint", "score"), members, sprints).groupBy(F.col("project").alias("p3")).agg(F.avg("score").alias("mutation"))
    every = members.select(F.col("project").alias("p0")).distinct()
    x = every.join(q, F.col("p0") == F.col("project"), "left").drop("project").join(m, F.col("p0") == F.col("p3"), "left")
    return x.select(F.col("p0").alias("project"), "value", "over_10", "mutation", F.col("value").isNotNull().alias("present"))


def survival_raw(survival: DataFrame, members: DataFrame, sprints: DataFrame) -> DataFrame:
    """By project of ``members``: value (mean rate by points; without points a row weighs 1, a negative number 0), present (whether anything weighs). survival: member, sprint, rate, points; members: member, project."""
    x = _of_projects(survival.filter("rate is not null"), members, sprints).withColumn("w", F.greatest(F.coalesce(F.col("points").cast("double"), F.lit(1.0)), F.lit(0.0)))
    x = x.groupBy("project").agg(safe_divide(F.sum(F.col("rate") * F.col("w")), F.sum("w"), None).alias("value"))
    every = members.select(F.col("project").alias("p0")).distinct()
    return every.join(x, F.col("p0") == F.col("project"), "left").select(F.col("p0").alias("project"), "value", F.col("value").isNotNull().alias("present"))


def _done(tasks: DataFrame) -> DataFrame:
    return tasks.filter("type != 'USER_STORY' and status = 'DONE' and member is not null")


def task_statements(tasks: DataFrame, links: DataFrame, survival: DataFrame) -> DataFrame:
    """task, member, points, statements: what survives of the task's pull requests in its sprint, each shared among its done tasks by points, evenly if these are 0. tasks: task, member, sprint, points, type, status; links: task, pr; survival: pr, sprint, statements."""
    s = survival.select(F.col("pr").alias("p2"), F.col("sprint").alias("s2"), F.coalesce("statements", F.lit(0)).alias("statements"))
    known = _done(tasks).join(links.select(F.col("task").alias("t2"), "pr"), F.col("task") == F.col("t2")).join(s, (F.col("pr") == F.col("p2")) & (F.col("sprint") == F.col("s2")))
    x = distribute(known.withColumn("whole", F.struct("pr", "sprint")), "whole", F.coalesce("points", F.lit(0)), {"statements": F.col("statements")})
    return x.groupBy("task", "member", "points").agg(F.sum("statements").alias("statements"))


def pr_statements(tasks: DataFrame, links: DataFrame, survival: DataFrame) -> DataFrame:
    """pr, sprint, statements, points (of its done tasks in the sprint), density (statements a point; null without points): of pull requests with a done task. Inputs as of ``task_statements``."""
    t = _done(tasks).join(links.select(F.col("task").alias("t2"), "pr"), F.col("task") == F.col("t2")).groupBy("pr", "sprint").agg(F.sum(F.coalesce("points", F.lit(0))).alias("points"))
    s = survival.select(F.col("pr").alias("p2"), F.col("sprint").alias("s2"), F.coalesce("statements", F.lit(0)).alias("statements"))
    x = t.join(s, (F.col("pr") == F.col("p2")) & (F.col("sprint") == F.col("s2")))
    return x.select("pr", "sprint", "statements", "points", safe_divide(F.col("statements"), F.when(F.col("points") > 0, F.col("points")), None).alias("density"))


def pull_request_sheet(prs: DataFrame, statements: DataFrame, authors: DataFrame, threshold: float = 3.0) -> DataFrame:
    """A row for each pull request with statements: project, pr, sprint, authors (in order, comma-joined), additions, deletions, statements, points, density, z (robust, among the project's pull requests of the sprint), outlier. prs: pr, project, additions, deletions; statements: as of ``pr_statements``; authors: pr, member."""
    who = authors.filter("member is not null").groupBy(F.col("pr").alias("p3")).agg(F.array_join(F.array_sort(F.collect_set(F.col("member").cast("string"))), ",").alias("authors"))
    x = statements.join(prs.select(F.col("pr").alias("p2"), "project", "additions", "deletions"), F.col("pr") == F.col("p2")).join(who, F.col("pr") == F.col("p3"), "left").drop("p2", "p3")
    return mad_outliers(x, ["project", "sprint"], "density", threshold, 1).select("project", "pr", "sprint", F.coalesce("authors", F.lit("")).alias("authors"), "additions", "deletions", "statements", "points", "density", "z", "outlier")


def line_diagnostics(prs: DataFrame, stored: DataFrame, computed: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """A row for each merged pull request: repo, number, pr, duplicate (several rows have this repo and number), problem: not_stored, not_computed, no_lines (additions but no code lines), differs (any measure by more than ``tolerance``), null if all is well; lat, lar, ls and stored_*. prs: pr, repo, number, additions; stored and computed: pr, lat, lar, ls."""
    measures = ("lat", "lar", "ls")
    n = prs.groupBy(F.col("repo").alias("r2"), F.col("number").alias("n2")).agg(F.count("*").alias("n"))
    # Rows meet by a hash of 64 bits first, which is fast to sort where the key is wide.
    s = stored.select(F.col("pr").alias("p2"), *[F.col(c).alias(f"stored_{c}") for c in measures], F.lit(True).alias("is_stored"))
    c = computed.select(F.col("pr").alias("p3"), *measures, F.lit(True).alias("is_computed"))
    x = prs.join(n, F.col("repo").eqNullSafe(F.col("r2")) & F.col("number").eqNullSafe(F.col("n2")))
    met = lambda k: (F.xxhash64("pr") == F.xxhash64(k)) & (F.col("pr") == F.col(k))
    x = x.join(s, met("p2"), "left").join(c, met("p3"), "left")
    apart: Column = F.lit(False)
    for m in measures:
        apart = apart | (F.abs(F.coalesce(m, F.lit(0)) - F.coalesce(f"stored_{m}", F.lit(0))) > tolerance)
    problem = F.when(F.col("is_computed").isNull(), "not_computed").when(F.col("is_stored").isNull(), "not_stored").when(apart, "differs").when((F.coalesce("additions", F.lit(0)) > 0) & (F.coalesce("lat", F.lit(0)) == 0), "no_lines")
    return x.select("repo", "number", "pr", (F.col("n") > 1).alias("duplicate"), problem.alias("problem"), *measures, *[f"stored_{m}" for m in measures])


def project_diagnostics(projects: DataFrame, tasks: DataFrame, flags: DataFrame, technologies: DataFrame) -> DataFrame:
    """By project: members (of its tasks), tasks, done, points (of done tasks), critical, warning (flags), technologies (in order, comma-joined); 0 and empty without any. projects: project; tasks: project, member, status, points; flags: project, severity; technologies: project, name."""
    key = lambda df, name, *aggs: df.groupBy(F.col("project").alias(name)).agg(*aggs)
    done = F.col("status") == "DONE"
    parts = [
        key(tasks, "p1", F.countDistinct("member").alias("members"), F.count("*").alias("tasks"), F.count_if(done).alias("done"), F.sum(F.when(done, F.col("points"))).alias("points")),
        key(flags, "p2", *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "WARNING")]),
        key(technologies.filter("name is not null"), "p3", F.array_join(F.array_sort(F.collect_set("name")), ",").alias("technologies")),
    ]
    x = projects.select("project").distinct()
    for i, part in enumerate(parts, 1):
        x = x.join(part, F.col("project") == F.col(f"p{i}"), "left").drop(f"p{i}")
    return x.fillna(0, ["members", "tasks", "done", "points", "critical", "warning"]).fillna("", ["technologies"])

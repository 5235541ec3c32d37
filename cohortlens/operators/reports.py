"""Report datasets: summaries, tier pivots, samples and version comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(roster: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """roster with the columns of each part (one row for each key) joined from the left; missing numbers are 0."""
    out = reduce(lambda a, b: a.join(b, key, "left"), parts, roster)
    added = [c for c in out.columns if c not in roster.columns]
    return out.select(*roster.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in added])


def cumulative(df: DataFrame, key: str, period: str, values: list[str]) -> DataFrame:
    """Adds total_<value>: running sums by key over periods."""
    w = Window.partitionBy(key).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"total_{v}": F.sum(v).over(w) for v in values})


def tier_counts(df: DataFrame, key: str, tier: Column, tiers: list[str]) -> DataFrame:
    """A column with the count of rows for each tier, and total, by key."""
    one = df.withColumn("__tier", tier)
    return one.groupBy(key).agg(*[F.count(F.when(F.col("__tier") == t, 1)).alias(t) for t in tiers], F.count("*").alias("total"))


def stratified_sample(df: DataFrame, tier: str, order: list[str], n: int) -> DataFrame:
    """n rows of each tier, by a hash of the order columns that does not depend on partitions."""
    w = Window.partitionBy(tier).orderBy(F.md5(F.concat_ws("|", *order)), *order)
    return df.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n).drop("__i")


def version_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """added, removed, modified or unchanged for each key of two versions."""
    x = old.select(F.col(key).alias("k0"), F.col(content).alias("c0")).join(new.select(F.col(key).alias("k1"), F.col(content).alias("c1")), F.col("k0") == F.col("k1"), "full")
    status = F.when(F.col("k0").isNull(), "added").when(F.col("k1").isNull(), "removed").when(F.col("c0").eqNullSafe(F.col("c1")), "unchanged").otherwise("modified")
    return x.select(F.coalesce("k0", "k1").alias(key), status.alias("status"))


def commit_rhythm(commits: DataFrame, key: str, at: str, size: str, later: Column | None = None) -> DataFrame:
    """By key: n, span_minutes, longest_gap_minutes, size_per_minute (null without a span), largest_share, fixup (a first commit of 100 or more, all later ones of at most 30 and, if given, under the condition ``later``, such as a word in the message). Equal times are ordered by size."""
    w = Window.partitionBy(key).orderBy(at, size)
    micros = F.unix_micros(F.col(at).cast("timestamp")) / 60e6
    x = commits.withColumn("__m", micros).withColumns({"__gap": F.col("__m") - F.lag("__m").over(w), "__i": F.row_number().over(w)})
    g = x.groupBy(key).agg(
        F.count("*").alias("n"), (F.max("__m") - F.min("__m")).alias("span_minutes"), F.coalesce(F.max("__gap"), F.lit(0.0)).alias("longest_gap_minutes"), F.sum(size).alias("__sum"), F.max(size).alias("__max"),
        F.bool_and(F.when(F.col("__i") == 1, F.col(size) >= 100).otherwise((F.col(size) <= 30) & F.coalesce(later if later is not None else F.lit(True), F.lit(False)))).alias("__fix"),
    )
    per = F.when(F.col("span_minutes") > 0, F.col("__sum") / F.when(F.col("span_minutes") > 0, F.col("span_minutes")))
    share = F.when(F.col("__sum") > 0, F.col("__max") / F.when(F.col("__sum") > 0, F.col("__sum")))
    return g.select(key, "n", "span_minutes", "longest_gap_minutes", per.alias("size_per_minute"), share.alias("largest_share"), ((F.col("n") > 1) & F.col("__fix")).alias("fixup"))


def task_lines(links: DataFrame, prs: DataFrame, task: str) -> DataFrame:
    """By task: ls (all lines of its pull requests) and weighted (each one's by its share of the task's points, evenly if they are all 0). links: pr, task, points; prs: pr, ls."""
    x = links.join(prs, "pr")
    total = x.groupBy(F.col(task).alias("__t")).agg(F.sum("points").alias("__points"), F.count("*").alias("__n"))
    x = x.join(total, F.col(task) == F.col("__t"))
    share = F.when(F.col("__points") == 0, 1.0 / F.col("__n")).otherwise(F.col("points") / F.when(F.col("__points") != 0, F.col("__points")))
    return x.groupBy(task).agg(F.sum("ls").alias("ls"), F.sum(F.col("ls") * share).alias("weighted"))


def findings_by_author(shares: DataFrame, rule: str) -> DataFrame:
    """author, rule, n, critical, weight (blame summed up), worst (severity). shares: author, rule, severity, share."""
    rank = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "WARNING", 2).otherwise(1)
    return shares.groupBy("author", rule).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.sum("share").alias("weight"), F.max_by("severity", rank).alias("worst"))


def identity_map(members: DataFrame, identities: DataFrame) -> DataFrame:
    """member, name, logins and emails (in order, comma-joined, without case), n (identities); members without any stay. identities: member, kind, value."""
    i = identities.select(F.col("member").alias("m2"), "kind", F.lower("value").alias("value")).distinct()
    text = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))), ",")
    g = i.groupBy("m2").agg(text("login").alias("logins"), text("email").alias("emails"), F.count("*").alias("n"))
    return members.join(g, F.col("member") == F.col("m2"), "left").select("member", "name", F.coalesce("logins", F.lit("")).alias("logins"), F.coalesce("emails", F.lit("")).alias("emails"), F.coalesce("n", F.lit(0)).alias("n"))


def snapshot(tasks: DataFrame, prs: DataFrame) -> DataFrame:
    """A team's table of a sprint, by member: tasks, done, points (done), prs, merged, lines. tasks: team, member, done, points; prs: member, merged, lines. Members of tasks only."""
    a = tasks.groupBy("team", "member").agg(F.count("*").alias("tasks"), F.count_if("done").alias("done"), F.coalesce(F.sum(F.when(F.col("done"), F.col("points"))), F.lit(0)).alias("points"))
    b = prs.groupBy(F.col("member").alias("m2")).agg(F.count("*").alias("prs"), F.count_if("merged").alias("merged"), F.sum("lines").alias("lines"))
    x = a.join(b, F.col("member") == F.col("m2"), "left")
    return x.select("team", "member", "tasks", "done", "points", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("prs", "merged", "lines")])


def estimation_quality(tasks: DataFrame) -> DataFrame:
    """By team and points: tasks, mean and spread of lines, and the ratio of that mean to the one of a single point (null without tasks of one point). tasks: team, points, lines; tasks without points are left out."""
    g = tasks.filter("points > 0").groupBy("team", "points").agg(F.count("*").alias("tasks"), F.avg("lines").alias("mean"), F.stddev_pop("lines").alias("spread"))
    one = g.filter("points = 1").select(F.col("team").alias("t2"), F.col("mean").alias("unit"))
    return g.join(one, F.col("team") == F.col("t2"), "left").select("team", "points", "tasks", "mean", "spread", F.when(F.col("unit") > 0, F.col("mean") / F.col("unit")).alias("ratio"))


def enriched(flags: DataFrame, members: DataFrame, prs: DataFrame) -> DataFrame:
    """flags with name and, where the details name a pull request, its title and link; a flag of an unknown member keeps its id as name. flags: member, flag, severity, details (JSON); members: member, name; prs: pr, title, url."""
    pr = F.get_json_object("details", "$.pr").cast("bigint")
    x = flags.withColumn("pr", pr).join(members.select(F.col("member").alias("m2"), "name"), F.col("member") == F.col("m2"), "left")
    x = x.join(prs.select(F.col("pr").alias("p2"), "title", "url"), F.col("pr") == F.col("p2"), "left")
    return x.select("member", F.coalesce("name", F.col("member").cast("string")).alias("name"), "flag", "severity", "pr", "title", "url")


def pending_builds(prs: DataFrame, builds: DataFrame) -> DataFrame:
    """Merged pull requests without a build of their last commit. prs: pr, merged, sha; builds: pr, sha."""
    return prs.filter("merged").join(builds.select(F.col("pr").alias("p2"), F.col("sha").alias("s2")).distinct(), (F.col("pr") == F.col("p2")) & (F.col("sha") == F.col("s2")), "left_anti")


def flag_counts(flags: DataFrame, by: list[str]) -> DataFrame:
    """critical, warning, info and total by group, and flags: the distinct names, in order, comma-joined."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return flags.groupBy(*by).agg(n("CRITICAL").alias("critical"), n("WARNING").alias("warning"), n("INFO").alias("info"), F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"))

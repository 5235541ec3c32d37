"""Peer groups of tasks: signatures from their pull requests, groups with back-off, outliers, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.paths import layer_of, repo_type
from cohortlens.functions.scalar import format_float
from cohortlens.operators.stats import joined_by_size, mad_outliers
from cohortlens.sources.scratch import written

#: Any value of a part of a group's key.
ANY = "*"


def pr_action(lat: Column, ld: Column) -> Column:
    """create if seven tenths or more of the changed lines are added, else modify; null without lines."""
    a, d = (F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)) for x in (lat, ld))
    return F.when(a + d > 0, F.when(a / F.greatest(a + d, F.lit(1e-300)) >= 0.7, "create").otherwise("modify"))


def task_action(actions: Column) -> Column:
    """Aggregate: create if every action known is (or none is), else modify."""
    return F.when(F.coalesce(F.bool_and(actions == "create"), F.lit(True)), "create").otherwise("modify")


def dominant_layers(counts: DataFrame, by: list[str], share: float = 0.25) -> DataFrame:
    """by, layer, place: layers with ``share`` of a group's count or more (rounded up), else the top one, largest first. counts: by, layer, n."""
    c = counts.filter("n > 0 and layer is not null").groupBy(*by, "layer").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    c = c.withColumns({"total": F.sum("n").over(w), "place": F.row_number().over(w.orderBy(F.desc("n"), "layer"))})
    return c.filter((F.col("n") >= F.ceil(F.col("total") * share)) | (F.col("place") == 1)).select(*by, "layer", "place")


def pr_signatures(links: DataFrame, statements: DataFrame, commits: DataFrame, lines: DataFrame, survival: DataFrame) -> DataFrame:
    """What is known of each pull request of a finished task other than a user story: pr, repo, layer_counts (map of layer to surviving statements; empty without), lat, ld, ls, surviving (each null without a row, else summed over sprints) and action.

    links: pr, repo, type, status; statements: path, commit; commits: pr, sha; lines: pr, lat, ld, ls; survival: pr, surviving.
    A statement counts for each pull request that holds its commit. Statements are counted by commit and path before they
    meet commits, so a commit of very many statements is a row for each of its files. The stack, and so the layers, comes
    from the repository's name. Null paths, commits and pull requests count nowhere.
    """
    wanted = (F.col("type").isNull() | (F.col("type") != "USER_STORY")) & (F.col("status") == "DONE") & F.col("pr").isNotNull()
    prs = links.filter(wanted).groupBy("pr").agg(F.max("repo").alias("repo"))
    n = statements.filter("path is not null and commit is not null").groupBy("commit", "path").agg(F.count("*").alias("n"))
    n = n.join(commits.select(F.col("pr").alias("p2"), "sha"), F.col("commit") == F.col("sha"))
    n = n.groupBy("p2", "path").agg(F.sum("n").alias("n")).join(prs, F.col("p2") == F.col("pr"))
    n = n.groupBy("p2", layer_of(F.col("path"), repo_type(F.col("repo"))).alias("layer")).agg(F.sum("n").alias("n")).filter("layer is not null")
    layers = n.groupBy("p2").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "n")))).alias("layer_counts"))
    total = lambda *names: [F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in names]
    changed = lines.groupBy(F.col("pr").alias("p3")).agg(*total("lat", "ld", "ls"))
    alive = survival.groupBy(F.col("pr").alias("p4")).agg(*total("surviving"))
    x = prs
    for part, key in ((layers, "p2"), (changed, "p3"), (alive, "p4")):
        x = x.join(part, F.col("pr") == F.col(key), "left").drop(key)
    known = F.coalesce("layer_counts", F.expr("cast(map() as map<string,bigint>)")).alias("layer_counts")
    return x.select("pr", "repo", known, "lat", "ld", "ls", "surviving", pr_action(F.col("lat"), F.col("ld")).alias("action"))


def tasks_of(links: DataFrame, layers: DataFrame) -> DataFrame:
    """Finished tasks with a pull request, all of theirs merged: project, task, points, action, statements (weighted), layer counts summed up in ``layers`` (pr, layer, n): layer_counts (map). links: project, task, points, done, pr, merged, weight, lat, ld, statements."""
    x = links.filter("done")
    one = x.groupBy("project", "task").agg(
        F.max("points").alias("points"), F.bool_and(F.coalesce("merged", F.lit(False))).alias("all"), F.count("pr").alias("prs"),
        task_action(pr_action(F.col("lat"), F.col("ld"))).alias("action"), F.sum(F.col("statements") * F.coalesce("weight", F.lit(1.0))).alias("statements"),
    )
    n = x.join(layers, "pr").groupBy("project", "task", "layer").agg(F.round(F.sum(F.col("n") * F.coalesce("weight", F.lit(1.0)))).cast("bigint").alias("n"))
    maps = n.groupBy(F.col("project").alias("p2"), F.col("task").alias("t2")).agg(F.map_from_entries(F.collect_list(F.struct("layer", "n"))).alias("layer_counts"))
    one = one.filter("all and prs > 0").drop("all", "prs")
    return one.join(maps, (F.col("project") == F.col("p2")) & (F.col("task") == F.col("t2")), "left").drop("p2", "t2")


def peer_groups(keys: DataFrame, least: int = 4, most: int = 3) -> DataFrame:
    """project, stack, layer, action, task: each of a task's first ``most`` keys in the first group, from narrow to wide, that has ``least`` tasks: (stack, layer, action), (stack, layer, any), (stack, any, action), (stack, any, any). keys: project, task, place, stack, layer, action. Groups that in the end have fewer are dropped."""
    key = lambda layer, action, level: F.struct(F.lit(level).alias("level"), "stack", (F.col("layer") if layer else F.lit(ANY)).alias("layer"), (F.col("action") if action else F.lit(ANY)).alias("action"))
    wide = F.array(key(True, True, 0), key(True, False, 1), key(False, True, 2), key(False, False, 3))
    x = keys.filter(F.col("place") <= most).select("project", "task", "place", F.explode(wide).alias("k")).select("project", "task", "place", "k.*")
    group = ["project", "stack", "layer", "action"]
    known = " and ".join(f"{g} is not null" for g in group)
    large = lambda df: df.filter(known).groupBy(*group).agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    x = joined_by_size(x, large(x.select(*group, "task").distinct()), group, "size")
    # Written, as their number by group is counted first and then joined.
    chosen = x.groupBy("project", "task", "place").agg(F.min_by(F.struct("stack", "layer", "action"), "level").alias("k")).select("project", "task", "k.*").distinct()
    chosen = written(chosen)
    return joined_by_size(chosen, large(chosen), group, "size").select(*group, "task")


def group_outliers(members: DataFrame, threshold: float = 2.5) -> DataFrame:
    """members of peer groups with density (statements a point), z in their group (null under three densities or without spread), outlier and reason, and representative: the task with most statements, then points, then the smallest number. members: project, stack, layer, action, task, points, statements."""
    group = ["project", "stack", "layer", "action"]
    x = members.withColumn("density", F.when(F.col("points") > 0, F.col("statements") / F.col("points")))
    judged = mad_outliers(x.filter("density is not null").select(*group, "task", "density"), group, "density", threshold, 3)
    judged = judged.select(*[F.col(g).alias(f"{g}_") for g in group], F.col("task").alias("task_"), "median", "z", "outlier")
    x = x.join(judged, [F.col(g) == F.col(f"{g}_") for g in [*group, "task"]], "left").drop(*[f"{g}_" for g in [*group, "task"]])
    known = " and ".join(f"{g} is not null" for g in group)
    best = members.filter(known).groupBy(*group).agg(F.max_by("task", F.struct(F.coalesce("statements", F.lit(-1.0)), F.coalesce("points", F.lit(-1.0)), -F.col("task"))).alias("representative"), F.count("*").alias("__size"))
    x = joined_by_size(x, best, group, "__size").drop("__size")
    outlier = F.coalesce("outlier", F.lit(False))
    reason = F.concat(F.lit("stmts/pt="), format_float(F.col("density"), 2), F.lit(" vs median="), format_float(F.col("median"), 2), F.format_string(" (z=%+.1f)", "z"))
    return x.withColumns({"outlier": outlier, "reason": F.when(outlier, reason)})

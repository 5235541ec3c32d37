"""Planning quality, estimation density, submission tiers, review and build summaries by team and sprint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import round_half_even, safe_divide
from cohortlens.functions.text import is_fix_title


def planning_quality(tasks: DataFrame) -> DataFrame:
    """By project and sprint: planned and completed points, reliability (completed by planned), accuracy_error (their distance by planned), unestimated (share of tasks without points), and velocity_cv of the project over sprints that completed something (0 under two). Parent tasks do not count, nor do tasks without a type. tasks: project, sprint, points, done, type."""
    x = tasks.filter("type != 'USER_STORY'").withColumn("points", F.coalesce("points", F.lit(0)))
    s = x.groupBy("project", "sprint").agg(F.sum("points").alias("planned"), F.sum(F.when(F.col("done"), F.col("points")).otherwise(0)).alias("completed"), F.avg((F.col("points") == 0).cast("double")).alias("unestimated"))
    v = s.filter("completed > 0").groupBy(F.col("project").alias("p2")).agg(F.when(F.count("*") >= 2, safe_divide(F.stddev_pop("completed"), F.avg("completed"))).otherwise(0.0).alias("velocity_cv"))
    s = s.join(v, F.col("project") == F.col("p2"), "left").drop("p2")
    return s.select(
        "project", "sprint", "planned", "completed", safe_divide(F.col("completed"), F.col("planned")).alias("reliability"), safe_divide(F.abs(F.col("planned") - F.col("completed")), F.col("planned")).alias("accuracy_error"),
        "unestimated", F.coalesce("velocity_cv", F.lit(0.0)).alias("velocity_cv"),
    )


def estimation_density(members: DataFrame) -> DataFrame:
    """member, density (statements a point) and its deviation from the team's mean density. members: team, member, statements, points; without points a member has none."""
    x = members.withColumn("density", safe_divide(F.col("statements"), F.col("points"), None))
    mean = x.groupBy(F.col("team").alias("t2")).agg(F.avg("density").alias("mean"))
    return x.join(mean, F.col("team").eqNullSafe(F.col("t2"))).select("team", "member", "density", (F.col("density") - F.col("mean")).alias("deviation"))


def pr_kind(title: Column, types: Column) -> Column:
    """fix if the title says so or a linked task is a bug, else feature."""
    return F.when(is_fix_title(title) | F.coalesce(F.array_contains(types, "BUG"), F.lit(False)), "fix").otherwise("feature")


def submission_tiers(prs: DataFrame, links: DataFrame, limits: tuple[float, float, float] = (96.0, 72.0, 48.0)) -> DataFrame:
    """pr, hours before the deadline (two decimals), kind and tier of merged pull requests: Regular, Late, Critical by the limits, and within the last Fix for repairs, Critical for others. prs: pr, title, merged, created_at, merged_at, deadline (timestamps; opened at created_at, else merged_at); links: pr, type, sprint tasks only."""
    types = links.filter("type != 'USER_STORY'").groupBy(F.col("pr").alias("p2")).agg(F.collect_set("type").alias("types"))
    x = prs.filter("merged and merged_at is not null").join(types, F.col("pr") == F.col("p2"))
    seconds = F.unix_seconds(F.col("deadline").cast("timestamp")) - F.unix_seconds(F.coalesce("created_at", "merged_at").cast("timestamp"))
    x = x.withColumns({"hours": seconds / 3600.0, "kind": pr_kind(F.col("title"), F.col("types"))}).filter("hours is not null")
    early, moderate, late = limits
    tier = F.when(F.col("hours") >= early, "Regular").when(F.col("hours") >= moderate, "Late").when(F.col("hours") >= late, "Critical").when(F.col("kind") == "fix", "Fix").otherwise("Critical")
    return x.select("pr", round_half_even(2)("hours").alias("hours"), "kind", tier.alias("tier"))


def reviewer_breakdown(prs: DataFrame, members: DataFrame) -> DataFrame:
    """team, reviewer, reviewed, broken: how many pull requests each member reviewed and how many of them do not build. prs: pr, compiles, reviewers (JSON array of ids; unreadable ones count as empty); members: team, member."""
    who = F.coalesce(F.from_json("reviewers", "array<string>"), F.array().cast("array<string>"))
    x = prs.select("pr", "compiles", F.explode(F.array_distinct(who)).alias("reviewer")).join(members, F.col("reviewer") == F.col("member"))
    return x.groupBy("team", "reviewer").agg(F.count("*").alias("reviewed"), F.count_if(~F.col("compiles")).alias("broken"))


def compile_summary(prs: DataFrame, by: list[str], top: int = 5) -> DataFrame:
    """By group: builds, failed, rate of success, errors (JSON map of the ``top`` kinds by count, then name, summed over pull requests). prs: by, compiles, errors (map of kind to count)."""
    base = prs.groupBy(*by).agg(F.count("*").alias("builds"), F.count_if(~F.col("compiles")).alias("failed"), F.avg(F.col("compiles").cast("double")).alias("rate"))
    e = prs.select(*by, F.explode("errors").alias("kind", "n")).groupBy(*by, "kind").agg(F.sum("n").alias("n"))
    e = e.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "kind"))).filter(F.col("i") <= top)
    maps = e.groupBy(*[F.col(b).alias(f"{b}_") for b in by]).agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("i", "kind", "n"))), lambda x: F.struct(x["kind"], x["n"])))).alias("errors"))
    return base.join(maps, [F.col(b).eqNullSafe(F.col(f"{b}_")) for b in by], "left").select(*by, "builds", "failed", "rate", F.coalesce("errors", F.lit("{}")).alias("errors"))


def mean_scores(scores: DataFrame, authors: DataFrame) -> DataFrame:
    """member, avg_score over the pull requests that each has a part in; a member's share counts once for each. scores: pr, score; authors: pr, member."""
    return authors.select("pr", "member").distinct().join(scores.filter("score is not null"), "pr").groupBy("member").agg(F.avg("score").alias("avg_score"))


def weights_valid(weights: dict[str, float], tolerance: float = 0.01) -> dict[str, float]:
    """weights, if they add up to 1."""
    if abs(sum(weights.values()) - 1) > tolerance:
        raise ValueError(f"weights add up to {sum(weights.values()):.4f}, not 1")
    return weights


def triage(flags: Column, title: Column, description: Column, total: Column, band: tuple[float, float] = (2.0, 4.0), snap_most: float = 0.2, step: float = 0.25) -> Column:
    """What to do with a pull request's text: short:<flag>, judge or snap, by rules in order. flags: array of text_flags; the predictions may be null (no regressor) or NaN."""
    has = lambda f: F.array_contains(flags, f)
    known = total.isNotNull() & ~F.isnan(total)
    snapped = lambda x, top: F.least(F.greatest(F.floor(x / step + 0.5) * step, F.lit(0.0)), F.lit(top))
    far = F.abs(total - snapped(title, 2.0) - snapped(description, 4.0)) > snap_most
    return (
        F.when(has("EMPTY_BODY"), "short:EMPTY_BODY").when(has("TASK_ID_ONLY_BODY"), "short:TASK_ID_ONLY_BODY").when(has("GENERIC_TITLE") & total.isNotNull(), "short:GENERIC_TITLE")
        .when(~known, "judge").when((total >= band[0]) & (total <= band[1]), "judge").when(far, "judge").otherwise("snap")
    )


def file_candidates(files: DataFrame, by: str, path: str, size: str, least: int, most: int, skip: list[str]) -> DataFrame:
    """The ``most`` largest files of a project of ``least`` statements or more whose path fits none of the expressions in ``skip``, ties by path."""
    keep = reduce(lambda c, s: c & ~F.col(path).rlike(s), skip, F.col(size) >= least)
    w = Window.partitionBy(by).orderBy(F.desc(size), path)
    return files.filter(keep).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)

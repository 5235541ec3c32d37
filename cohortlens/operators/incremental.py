"""What need not be done again: watermarks, caches, freshness and frozen snapshots, as joins with manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fully_collected(state: Column, merged: Column, merged_at: Column, commits: Column) -> Column:
    """Whether a pull request is closed or merged (then with a time), with a commit at least."""
    low, is_merged = F.lower(F.coalesce(state, F.lit(""))), F.coalesce(merged, F.lit(False))
    final = is_merged | low.isin("closed", "merged")
    return final & ~(is_merged & (F.coalesce(merged_at, F.lit("")) == "")) & (F.coalesce(commits, F.lit(0)) > 0)


def unchanged(updated_at: Column, last_fetched: Column) -> Column:
    """Whether both times are there and equal."""
    return F.coalesce((updated_at == last_fetched) & (updated_at != ""), F.lit(False))


def to_fetch(prs: DataFrame, commits: DataFrame) -> DataFrame:
    """Pull requests to ask for again: those not fully collected, or changed since. prs: pr, state, merged, merged_at, updated_at, last_fetched; commits: pr."""
    n = commits.groupBy(F.col("pr").alias("p2")).agg(F.count("*").alias("n"))
    x = prs.join(n, F.col("pr") == F.col("p2"), "left")
    done = fully_collected(F.col("state"), F.col("merged"), F.col("merged_at"), F.col("n")) & unchanged(F.col("updated_at"), F.col("last_fetched"))
    return x.filter(~done).select(prs.columns)


def merge_etags(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The next cache (key, endpoint, etag, body): a fresh answer replaces what is known, one that says not modified (status 304) keeps it. answers: key, endpoint, status, etag, body."""
    fresh = answers.filter("status = 200").select("key", "endpoint", "etag", "body")
    return fresh.unionByName(cache.join(fresh.select("key", "endpoint"), ["key", "endpoint"], "left_anti"))


def conditional_bodies(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """key, endpoint, body, fresh: what each answer stands for: its own body, or the cached one if it says not modified (null if there is none)."""
    known = cache.select("key", "endpoint", F.col("body").alias("cached"))
    x = answers.join(known, ["key", "endpoint"], "left")
    return x.select("key", "endpoint", F.when(F.col("status") == 304, F.col("cached")).otherwise(F.col("body")).alias("body"), (F.col("status") == 200).alias("fresh"))


def new_data(before: DataFrame, after: DataFrame) -> DataFrame:
    """Projects whose counts grew: project, new_prs, new_tasks. Both: project, prs, tasks; a project missing before had none."""
    b = before.select(F.col("project").alias("p2"), F.col("prs").alias("b1"), F.col("tasks").alias("b2"))
    x = after.join(b, F.col("project") == F.col("p2"), "left")
    grew = lambda a, o: F.greatest(F.col(a) - F.coalesce(o, F.lit(0)), F.lit(0))
    return x.select("project", grew("prs", "b1").alias("new_prs"), grew("tasks", "b2").alias("new_tasks")).filter("new_prs > 0 or new_tasks > 0")


def stale_artifacts(heads: DataFrame, runs: DataFrame) -> DataFrame:
    """Repositories to analyse: those whose head is not the one of their last good run. heads: repo, sha; runs: repo, sha, ok, at."""
    last = runs.filter("ok").groupBy(F.col("repo").alias("r2")).agg(F.max_by("sha", "at").alias("done"))
    return heads.join(last, (F.col("repo") == F.col("r2")) & (F.col("sha") == F.col("done")), "left_anti")


def fresh_scores(scores: DataFrame, prs: DataFrame, least_body: int = 50) -> DataFrame:
    """pr, sprint that need no new score: some row is not a zero for a text that was short when scored and is long now. scores: pr, sprint, score, scored_length; prs: pr, body."""
    x = scores.join(prs.select("pr", "body"), "pr")
    stale = (F.col("score") == 0) & (F.length(F.coalesce("body", F.lit(""))) >= least_body) & (F.coalesce("scored_length", F.lit(0)) < least_body)
    return x.filter(~F.coalesce(stale, F.lit(False))).select("pr", "sprint").distinct()


def freeze(snapshot: DataFrame, live: DataFrame, sprint: int, number: int) -> DataFrame:
    """The snapshot table after freezing a sprint: the live concepts taught up to its number, or with no number, unless it is frozen already. snapshot: sprint, category, value; live: category, value, taught."""
    new = live.filter(F.col("taught").isNull() | (F.col("taught") <= number)).select(F.lit(sprint).cast("bigint").alias("sprint"), "category", "value").distinct()
    frozen = snapshot.filter(F.col("sprint") == sprint).select(F.col("sprint").alias("s2")).distinct()
    return snapshot.unionByName(new.join(frozen, F.col("sprint") == F.col("s2"), "left_anti"))


def allowed_concepts(snapshot: DataFrame, live: DataFrame, sprint: int, number: int) -> DataFrame:
    """category, value allowed in a sprint: its snapshot if it has one, else the live ones taught by then."""
    return freeze(snapshot, live, sprint, number).filter(F.col("sprint") == sprint).select("category", "value").distinct()


def cached_answers(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, missing): requests with the cached answer for the same content, rubric and model, and those without. asked: file, sha, rubric, model; cache: sha, rubric, model, answer, at (the latest counts)."""
    key = ["sha", "rubric", "model"]
    latest = cache.groupBy(*key).agg(F.max_by("answer", "at").alias("answer"))
    return asked.join(latest, key), asked.join(latest.select(*key), key, "left_anti")


def audit(runs: DataFrame, name: str, started: Column, rows: Column) -> DataFrame:
    """runs (stage, started, rows) with one more."""
    return runs.unionByName(runs.sparkSession.range(1).select(F.lit(name).alias("stage"), started.alias("started"), rows.alias("rows")))

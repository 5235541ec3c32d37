"""Line measures of pull requests from their hunks, and what survives of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import safe_divide
from cohortlens.functions.text import code_lines, cosmetic_form, strip


def head_lines(files: DataFrame) -> DataFrame:
    """repo, line: the distinct code lines of all files at the head. files: repo, path, text."""
    lines = files.select("repo", F.explode(code_lines(F.split("text", "\n"), F.col("path"))).alias("x"))
    return lines.select("repo", F.col("x.line").alias("line")).distinct()


def hunk_lines(hunks: DataFrame) -> DataFrame:
    """hunks with code_added and code_removed, the lines that are neither blank nor comment, and cosmetic: pairs (removed, added) at the same place of a hunk that differ in looks only. hunks: pr, repo, path, hunk, removed, added (arrays of lines)."""
    pairs = F.arrays_zip(F.transform("removed", strip).alias("r"), F.transform("added", strip).alias("a"))
    looks = F.filter(pairs, lambda x: x["r"].isNotNull() & x["a"].isNotNull() & (x["r"] != "") & (x["a"] != "") & (x["r"] != x["a"]) & (cosmetic_form(x["r"]) == cosmetic_form(x["a"])))
    code = lambda c: F.transform(code_lines(F.col(c), F.col("path")), lambda x: x["line"])
    return hunks.withColumns({"code_added": code("added"), "code_removed": code("removed"), "cosmetic": F.coalesce(looks, F.expr("cast(array() as array<struct<r:string,a:string>>)"))})


def pr_line_metrics(hunks: DataFrame, head: DataFrame, cosmetic_share: float = 0.2) -> DataFrame:
    """By pull request: lat (code lines added), lar (less cosmetic changes), ls (added lines that the head still has anywhere), ld (code lines removed, less cosmetic ones), cosmetic_lines, cosmetic_report (empty up to ``cosmetic_share`` of lat). hunks: pr, repo, path, hunk, removed, added; head: repo, line."""
    h = hunk_lines(hunks)
    order = F.struct("path", "hunk")
    counts = h.groupBy("pr").agg(
        F.sum(F.size("code_added")).alias("lat"), F.sum(F.size("code_removed")).alias("removed"), F.sum(F.size("cosmetic")).alias("cosmetic_lines"),
        F.array_sort(F.collect_list(F.when(F.size("cosmetic") > 0, F.struct(order.alias("o"), F.slice("cosmetic", 1, 3).alias("c"))))).alias("few"),
    )
    # Lines meet the head's distinct lines by a hash of 64 bits first, so that no long text is a shuffle key.
    added = h.select("pr", "repo", F.explode("code_added").alias("line")).groupBy("pr", "repo", "line").agg(F.count("*").alias("n"))
    known = head.select(F.col("repo").alias("r2"), F.xxhash64("line").alias("h2"), F.col("line").alias("l2"))
    alive = added.withColumn("h", F.xxhash64("line")).join(known, (F.col("repo") == F.col("r2")) & (F.col("h") == F.col("h2")) & (F.col("line") == F.col("l2")), "left_semi")
    alive = alive.groupBy(F.col("pr").alias("p2")).agg(F.sum("n").alias("ls"))
    x = counts.join(alive, F.col("pr") == F.col("p2"), "left")
    zero = F.lit(0).cast("bigint")
    share = safe_divide(F.col("cosmetic_lines"), F.col("lat"))
    examples = F.transform(F.slice(F.flatten(F.transform("few", lambda x: x["c"])), 1, 3), lambda x: F.concat(F.lit('  "'), x["r"], F.lit('" -> "'), x["a"], F.lit('"')))
    report = F.concat(F.col("cosmetic_lines").cast("string"), F.lit(" cosmetic changes ("), F.round(share * 100).cast("bigint").cast("string"), F.lit("% of LAT). Examples:\n"), F.array_join(examples, "\n"))
    return x.select(
        "pr", "lat", F.greatest(F.col("lat") - F.col("cosmetic_lines"), zero).alias("lar"), F.coalesce("ls", zero).alias("ls"), F.greatest(F.col("removed") - F.col("cosmetic_lines"), zero).alias("ld"),
        "cosmetic_lines", F.when((F.col("lat") > 0) & (share > cosmetic_share), report).otherwise("").alias("cosmetic_report"),
    )


def base_commit(candidates: DataFrame) -> DataFrame:
    """pr, base, problem: where a pull request's diff starts. candidates: pr, kind (merge_base, parent or root), sha; null sha: not found. In that order; a base other than the merge base, and none, are noted."""
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("sha")))
    x = candidates.groupBy("pr").agg(pick("merge_base").alias("m"), pick("parent").alias("p"), pick("root").alias("r"))
    problem = F.when(F.col("m").isNotNull(), F.lit(None).cast("string")).when(F.coalesce("p", "r").isNotNull(), "base_fallback").otherwise("no_base_candidate")
    return x.select("pr", F.coalesce("m", "p", "r").alias("base"), problem.alias("problem"))


def unchanged_since(metrics: DataFrame, commits: DataFrame) -> DataFrame:
    """Pull requests whose stored merge_sha is still their last commit: pr. metrics: pr, merge_sha; commits: pr, at, sha."""
    last = commits.groupBy(F.col("pr").alias("p2")).agg(F.max_by("sha", F.struct("at", "sha")).alias("last"))
    return metrics.join(last, (F.col("pr") == F.col("p2")) & (F.col("merge_sha") == F.col("last")), "left_semi").select("pr")


def pr_survival(statements: DataFrame, commits: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """By pull request: surviving_raw (rows blamed on its commits), surviving_normalized and methods (distinct hashes), and added_raw: what survived when first measured, from ``before`` (pr, added_raw) if there. statements: commit, normalized, method; commits: pr, sha."""
    x = statements.join(commits.select("pr", "sha").distinct(), F.col("commit") == F.col("sha"))
    x = x.groupBy("pr").agg(F.count("*").alias("surviving_raw"), F.countDistinct("normalized").alias("surviving_normalized"), F.countDistinct("method").alias("methods"))
    if before is None:
        return x.withColumn("added_raw", F.col("surviving_raw"))
    old = before.select(F.col("pr").alias("p2"), F.col("added_raw").alias("a2"))
    return x.join(old, F.col("pr") == F.col("p2"), "left").withColumn("added_raw", F.coalesce("a2", "surviving_raw")).drop("p2", "a2")


def student_survival(prs: DataFrame, authors: DataFrame, points: DataFrame) -> DataFrame:
    """By member: added and surviving statements, rate (1 without added ones) and density (surviving statements a point; null without points). Equal tuples of a member's pull requests count once, as distinct rows do. prs: pr, added_raw, surviving_raw; authors: pr, member; points: member, points."""
    rows = prs.join(authors, "pr").select("member", "added_raw", "surviving_raw").distinct()
    x = rows.groupBy("member").agg(F.sum("added_raw").alias("added"), F.sum("surviving_raw").alias("surviving"))
    x = x.join(points.groupBy(F.col("member").alias("m2")).agg(F.sum("points").alias("points")), F.col("member") == F.col("m2"), "left")
    return x.select("member", "added", "surviving", safe_divide(F.col("surviving"), F.col("added"), 1.0).alias("rate"), safe_divide(F.col("surviving"), F.col("points"), None).alias("density"))


def member_line_totals(links: DataFrame, lines: DataFrame, roster: DataFrame) -> DataFrame:
    """team, member, period, ls, ld, points, ls_per_point (0 without points), and total_ls, total_ld, total_points, total_per_point summed up over periods so far.

    A pull request's lines are split over the finished tasks of a team in a period, by their points, evenly if these are all 0;
    a pull request shared by two teams counts whole in each. links: task, pr, member, period, points, type, status; lines: pr,
    period, ls, ld; roster: member, team. Shares are summed up as one aggregate joined back, so no window holds all
    tasks of a pull request.
    """
    keep = (F.col("type").isNull() | (F.col("type") != "USER_STORY")) & (F.col("status") == "DONE")
    x = links.filter(keep).select("pr", "member", "period", F.coalesce(F.col("points").cast("double"), F.lit(0.0)).alias("points"))
    x = x.join(lines.select("pr", "period", "ls", "ld"), ["pr", "period"]).join(roster.select("member", "team"), "member")
    key = ["team", "period", "pr"]
    whole = x.groupBy(*[F.col(k).alias(f"{k}_") for k in key]).agg(F.sum("points").alias("all"), F.count("*").alias("n"))
    x = x.join(whole, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key])
    weight = F.when(F.col("all") > 0, F.col("points") / F.when(F.col("all") > 0, F.col("all"))).otherwise(1.0 / F.col("n"))
    part = lambda c: F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * weight).alias(c)
    one = x.groupBy("team", "member", "period").agg(part("ls"), part("ld"), F.sum("points").alias("points"))
    w = Window.partitionBy("team", "member").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.withColumns({f"total_{c}": F.sum(c).over(w) for c in ("ls", "ld", "points")})
    per = lambda a, b: safe_divide(F.when(F.col(b) > 0, F.col(a)).otherwise(0.0), F.col(b))
    return one.withColumns({"ls_per_point": per("ls", "points"), "total_per_point": per("total_ls", "total_points")})


def file_owners(statements: DataFrame, by: list[str]) -> DataFrame:
    """Each file's dominant author (most statements, then the smaller name) with all its statements: by, file, author, statements. statements: by, file, author (without case)."""
    n = statements.filter("author is not null").groupBy(*by, "file", F.lower("author").alias("author")).agg(F.count("*").alias("n"))
    first = F.min_by("author", F.struct(-F.col("n"), F.col("author")))
    return n.groupBy(*by, "file").agg(first.alias("author"), F.sum("n").alias("statements"))


def team_ownership(statements: DataFrame, by: list[str], share: float = 0.95) -> DataFrame:
    """truck_factor: how few owners hold ``share`` of a team's statements, whole files counted for their dominant author; owners: these, in order, comma-joined."""
    totals = file_owners(statements, by).groupBy(*by, "author").agg(F.sum("statements").alias("s"))
    w = Window.partitionBy(*by).orderBy(F.desc("s"), "author")
    before = F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("s")
    x = totals.withColumns({"before": before, "i": F.row_number().over(w)})
    whole = totals.groupBy(*[F.col(b).alias(f"{b}__t") for b in by]).agg(F.sum("s").alias("total"))
    x = x.join(whole, [F.col(b).eqNullSafe(F.col(f"{b}__t")) for b in by]).filter(F.col("before") < F.ceil(F.col("total") * share))
    return x.groupBy(*by).agg(F.count("*").alias("truck_factor"), F.array_sort(F.collect_list(F.struct("i", "author"))).alias("o")).select(*by, "truck_factor", F.array_join(F.col("o.author"), ",").alias("owners"))

"""Flag detectors over members, pull requests and findings: rule lists for one-pass tables, functions where a rule needs a join."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import round_half_even, safe_divide
from cohortlens.operators.flags import Rule, raise_flags, severity_rank


@dataclass(frozen=True)
class Thresholds:
    """Limits of the rules; the defaults are the usual ones of a course."""

    carrying: float = 0.40
    mismatch: float = 0.25
    small_prs: int = 3
    dump_lines: float = 200
    survival_z: float = 1.5
    survival_rate: float = 0.85
    divergence: float = 0.20
    cosmetic: float = 0.5
    low: tuple[float, float] = (0.10, 0.20)
    builds: int = 3
    failure: float = 0.5
    cramming: float = 0.70
    documentation: float = 2.0
    late: float = 0.20
    mutation: tuple[float, float] = (0.30, 0.50)


def team_context(members: DataFrame) -> DataFrame:
    """Adds what a rule compares a member with. members: member, team, points, lines, surviving. Adds survival, team_points, team_lines, team_size, points_median (upper), lines_quarter (positional), survival_mean, survival_sd."""
    x = members.withColumn("survival", F.when(F.col("lines") > 0, safe_divide(F.col("surviving"), F.col("lines"))))
    sums = x.groupBy(F.col("team").alias("t1")).agg(F.sum("points").alias("team_points"), F.sum("lines").alias("team_lines"), F.count("*").alias("team_size"), F.avg("survival").alias("survival_mean"), F.stddev_pop("survival").alias("survival_sd"))
    # One row a team, so joins back are broadcast where that is small; ranks need the one sorted window.
    ranked = x.select("team", "member", "points", "lines").withColumns({k: F.row_number().over(Window.partitionBy("team").orderBy(v, "member")) for k, v in (("by_points", "points"), ("by_lines", "lines"))})
    ranked = ranked.join(sums.select("t1", "team_size"), F.col("team").eqNullSafe(F.col("t1")))
    at = lambda rank, part, c: F.max(F.when(F.col(rank) == F.floor(F.col("team_size") / part) + 1, F.col(c)))
    middles = ranked.groupBy(F.col("team").alias("t2")).agg(at("by_points", 2, "points").alias("points_median"), at("by_lines", 4, "lines").alias("lines_quarter"))
    x = x.join(sums, F.col("team").eqNullSafe(F.col("t1"))).join(middles, F.col("team").eqNullSafe(F.col("t2")))
    return x.drop("t1", "t2")


def banded(x: Column, low: tuple[float, float]) -> tuple[Column, Column]:
    """Whether x is under the upper limit, and its severity: critical under the lower one."""
    return x < low[1], F.when(x < low[0], "CRITICAL").otherwise("WARNING")


def member_rules(th: Thresholds = Thresholds()) -> list[Rule]:
    """Over team_context() with prs, small_prs, failed, normalized (surviving lines after normalisation), and the signals code, task and composite between 0 and 1."""
    c = F.col
    points, lines = safe_divide(c("points"), c("team_points")), safe_divide(c("lines"), c("team_lines"))
    z = F.when(c("survival_sd") > 0, (c("survival_mean") - c("survival")) / F.when(c("survival_sd") > 0, c("survival_sd")))
    gap = F.when(c("lines") > 0, safe_divide(c("normalized") - c("surviving"), c("lines")))
    low, severity = banded(c("composite"), th.low)
    return [
        Rule("ZERO_TASKS", c("prs") == 0, "CRITICAL"),
        Rule("CARRYING_TEAM", points > th.carrying, "WARNING", {"share": F.round(points, 4)}),
        Rule("LOW_CODE_HIGH_POINTS", (c("team_size") >= 2) & (c("points") > c("points_median")) & (c("lines") < c("lines_quarter")), "WARNING", {"points": c("points"), "lines": c("lines")}),
        Rule("POINT_CODE_MISMATCH", F.abs(points - lines) > th.mismatch, "INFO", {"points": F.round(points, 4), "lines": F.round(lines, 4)}),
        Rule("MICRO_PRS", (c("small_prs") >= th.small_prs) & (2 * c("small_prs") > c("prs")), "INFO", {"small": c("small_prs"), "prs": c("prs")}),
        Rule("LOW_SURVIVAL_RATE", (c("team_size") >= 2) & (z > th.survival_z) & (c("survival") < th.survival_rate), "WARNING", {"z": F.round(z, 4)}),
        Rule("RAW_NORMALIZED_DIVERGENCE", gap > th.divergence, "INFO", {"gap": F.round(gap, 4)}),
        Rule("LOW_COMPOSITE_SCORE", low, severity, {"composite": F.round("composite", 4)}),
        Rule("GHOST_CONTRIBUTOR", (c("prs") >= 1) & (c("composite") < 0.15) & (c("code") < 0.10)),
        Rule("HIDDEN_CONTRIBUTOR", (c("code") >= 0.75) & (c("task") <= 0.25), "INFO"),
        Rule("HIGH_COMPILE_FAILURE_RATE", (c("prs") >= th.builds) & (c("failed") >= th.failure * c("prs")), "WARNING", {"failed": c("failed")}),
    ]


def pr_rules(th: Thresholds = Thresholds()) -> list[Rule]:
    """Over pull requests: commits, additions, deletions, surviving, normalized, compiles, merged."""
    c = F.col
    adds, dels = c("additions"), c("deletions")
    lines = adds + dels
    rewritten = F.when(lines > 0, safe_divide(c("normalized") - c("surviving"), lines))
    cosmetic = F.when(lines > 0, 1 - safe_divide(c("surviving"), lines))
    return [
        Rule("SINGLE_COMMIT_DUMP", (c("commits") == 1) & (lines > th.dump_lines), "WARNING", {"lines": lines}),
        Rule("BULK_RENAME_PR", (adds >= 10) & (dels >= 10) & (F.least(adds, dels) > 0.8 * F.greatest(adds, dels)) & (lines > 50) & (rewritten > 0.3), "INFO"),
        Rule("COSMETIC_HEAVY_PR", cosmetic > th.cosmetic, "WARNING", {"cosmetic": F.round(cosmetic, 4)}),
        Rule("PR_DOES_NOT_COMPILE", ~c("compiles") & c("merged"), "WARNING"),
    ]


def process_rules(th: Thresholds = Thresholds()) -> list[Rule]:
    """Over members: cramming (share of work at the end), documentation (mean score), review (signal), punctuality (mean) with timed_prs, mutation (score). A null measure raises nothing."""
    c = F.col
    low, severity = banded(c("review"), th.low)
    return [
        Rule("CRAMMING", c("cramming") > th.cramming, "WARNING", {"cramming": F.round("cramming", 4)}),
        Rule("LOW_DOC_SCORE", c("documentation") < th.documentation, "INFO", {"documentation": F.round("documentation", 4)}),
        Rule("LOW_REVIEWS", low, severity, {"review": F.round("review", 4)}),
        Rule("ALL_PRS_LATE", (c("timed_prs") >= 2) & (c("punctuality") < th.late), "WARNING", {"punctuality": F.round("punctuality", 4)}),
        Rule("LOW_MUTATION_SCORE", c("mutation") < th.mutation[1], F.when(c("mutation") < th.mutation[0], "WARNING").otherwise("INFO"), {"mutation": F.round("mutation", 4)}),
    ]


def process_flags(members: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    return raise_flags(members, ["member"], process_rules(th))


def foreign_merges(prs: DataFrame, links: DataFrame) -> DataFrame:
    """Merged pull requests that a finished task links to whose assignee is not their author: pr, author, assignee, one row for each pair. Nulls raise nothing."""
    x = links.filter("done").select("pr", "assignee").distinct().join(prs.filter("merged").select("pr", "author"), "pr")
    return x.filter("author != assignee").select("pr", "author", "assignee")


def rewrite_flags(found: DataFrame) -> DataFrame:
    """Flags of rewrites(): the actor's, and the victim's only where the actor is unknown. subject, flag, severity, file, n."""
    side = lambda who, name, severity: F.struct(F.col(who).alias("subject"), F.lit(name).alias("flag"), F.lit(severity).alias("severity"))
    both = F.array(F.when(F.col("actor").isNotNull(), side("actor", "COSMETIC_REWRITE_ACTOR", "WARNING")), F.when(F.col("actor").isNull(), side("victim", "COSMETIC_REWRITE_VICTIM", "INFO")))
    return found.select("file", "n", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("x.*", "file", "n")


def similarity_flags(pairs: DataFrame) -> DataFrame:
    """Two rows for each pair of teams that share methods: subject PROJECT_<team>, other, shared. pairs: a, b, shared."""
    name = lambda c: F.concat(F.lit("PROJECT_"), F.col(c).cast("string"))
    sides = F.array(F.struct(name("a").alias("subject"), name("b").alias("other")), F.struct(name("b").alias("subject"), name("a").alias("other")))
    return pairs.select(F.explode(sides).alias("x"), "shared").select("x.subject", F.lit("CROSS_TEAM_SIMILARITY").alias("flag"), F.lit("CRITICAL").alias("severity"), "x.other", "shared")


def member_flags(members: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    return raise_flags(team_context(members), ["member"], member_rules(th))


def pr_flags(prs: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    return raise_flags(prs, ["pr", "author"], pr_rules(th))


def orphan_prs(prs: DataFrame, links: DataFrame) -> DataFrame:
    """Merged pull requests that no task links to. links: pr."""
    return prs.filter("merged").join(links.select("pr").distinct(), "pr", "left_anti")


def author_mismatch(prs: DataFrame, commits: DataFrame) -> DataFrame:
    """Pull requests with a commit of another login, compared without case. prs: pr, author; commits: pr, login. Adds n_others (logins) and others (up to five, in order)."""
    other = commits.filter("login is not null").select("pr", F.lower("login").alias("login")).distinct().join(prs.select("pr", F.lower("author").alias("a")), "pr")
    other = other.filter("a is null or login != a").withColumn("i", F.row_number().over(Window.partitionBy("pr").orderBy("login")))
    few = F.array_sort(F.collect_list(F.when(F.col("i") <= 5, F.col("login"))))
    return other.groupBy("pr").agg(F.count("*").alias("n_others"), few.alias("others"))


def unknown_contributors(roles: DataFrame, identities: DataFrame) -> DataFrame:
    """Logins of any role that no identity knows, without case. roles: login, role, pr; identities: value. login, n, roles."""
    x = roles.filter("login is not null").withColumn("login", F.lower("login"))
    x = x.join(identities.select(F.lower("value").alias("login")).distinct(), "login", "left_anti")
    return x.groupBy("login").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def undeclared(tasks: DataFrame, usage: DataFrame) -> DataFrame:
    """Finished tasks where neither the task nor its parent declares usage, by assignee. tasks: task, parent, assignee; usage: task (declared ones). assignee, n."""
    d = usage.select(F.col("task").alias("d")).distinct()
    x = tasks.join(d, F.col("task") == F.col("d"), "left_anti").join(d, F.col("parent") == F.col("d"), "left_anti")
    return x.groupBy("assignee").agg(F.count("*").alias("n"))


def approved_broken(prs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Approvals of pull requests that do not compile: pr, reviewer, one row for each pair."""
    return reviews.filter("state = 'APPROVED'").select("pr", "reviewer").distinct().join(prs.filter("not compiles").select("pr"), "pr", "left_semi")


def declining(scores: DataFrame, least: int = 3, delta: float = -0.30) -> DataFrame:
    """Members whose mean falls by more than -delta against the period before, with ``least`` rows in both. scores: member, period, score."""
    m = scores.groupBy("member", "period").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    w = Window.partitionBy("member").orderBy("period")
    m = m.withColumns({"before": F.lag("mean").over(w), "n_before": F.lag("n").over(w)})
    return m.filter((F.col("n") >= least) & (F.col("n_before") >= least) & (F.col("mean") - F.col("before") < delta)).select("member", "period", (F.col("mean") - F.col("before")).alias("delta"))


def attribute_findings(findings: DataFrame, blame: DataFrame) -> DataFrame:
    """Each finding's lines by author: file, finding, author, lines, share. findings: file, finding, start, end (inclusive); blame: file, line, author."""
    # Findings are the few; looked up by hash, neither side is sorted in the task that goes on to count and share.
    x = blame.join(findings.hint("shuffle_hash"), "file").filter("line between start and end").groupBy("file", "finding", "author").agg(F.count("*").alias("lines"))
    return x.withColumn("share", F.col("lines") / F.sum("lines").over(Window.partitionBy("file", "finding")))


#: Weight of a finding's severity in blame.
SEVERITY_WEIGHTS = {"CRITICAL": 1.0, "ERROR": 1.0, "WARNING": 0.25, "INFO": 0.1}


def severity_weight(severity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.upper(severity)), F.lit(0.25))


def hotspots(shares: DataFrame, by: list[str], severity: Column, extra: Column | None = None, keep: dict[str, Column] | None = None, sample: Column | None = None, top: int = 10) -> DataFrame:
    """author, weighted (blame summed up), worst (severity) and offenders (the ``top`` groups by contribution, then by name).

    A group is a finding's ``by`` columns (such as rule and file): blame in it counts at most once, times the weight
    of its worst severity and ``extra``. shares: author, share, and what the expressions read. ``keep`` are fields of a group for offenders; of rows with the largest ``sample``, if given."""
    first = F.struct(*[v.alias(k) for k, v in (keep or {}).items()]) if keep else F.struct(*by)
    rank = severity_rank(severity)
    x = shares.withColumns({"__rank": rank, "__severity": severity, "__extra": extra if extra is not None else F.lit(1.0), "__keep": first, "__sample": sample if sample is not None else F.lit(0.0)})
    # Dealt out by author before groups are made: the task that made the shares holds no groups as well.
    used = list(dict.fromkeys(["author", "share", *by, "__severity", "__rank", "__extra", "__keep", "__sample"]))
    x = x.filter("__extra > 0").select(*used).repartition("author").groupBy("author", *by).agg(
        F.least(F.sum("share"), F.lit(1.0)).alias("blame"), F.max_by("__severity", "__rank").alias("worst"), F.max("__rank").alias("rank"), F.max("__extra").alias("extra"),
        F.max(F.struct(F.coalesce("__sample", F.lit(0.0)).alias("sample"), "__keep"))["__keep"].alias("keep"),
    )
    x = x.withColumn("contribution", F.col("blame") * severity_weight(F.col("worst")) * F.col("extra")).filter("contribution > 0")
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("contribution"), *by)))
    offender = F.struct("place", F.struct("keep.*", F.col("worst").alias("severity"), F.round("contribution", 3).alias("weight")).alias("o"))
    out = x.groupBy("author").agg(F.sum("contribution").alias("weighted"), F.max_by("worst", "rank").alias("worst"), F.array_sort(F.collect_list(F.when(F.col("place") <= top, offender))).alias("offenders"))
    return out.withColumn("offenders", F.col("offenders.o"))


def _hotspot_flags(found: DataFrame, name: str, severity: Column, details: dict[str, Column]) -> DataFrame:
    packed = F.to_json(F.struct(*[v.alias(k) for k, v in details.items()]))
    return found.withColumn("severity", severity).filter("severity is not null").select("author", F.lit(name).alias("flag"), "severity", packed.alias("details"))


#: Architecture rules that raise no hotspot.
NO_HOTSPOT_RULES: tuple[str, ...] = ()


def architecture_hotspots(shares: DataFrame, least: float = 0.0, rule_weights: dict[str, float] | None = None) -> DataFrame:
    """ARCHITECTURE_HOTSPOT flags. shares: author, share, rule_name, rule_kind, file_path, severity. ``rule_weights``: rules that weigh other than 1; one of weight 0 or less counts for nothing."""
    weights = {**{r: 0.0 for r in NO_HOTSPOT_RULES}, **(rule_weights or {})}
    extra = reduce(lambda c, kv: c.when(F.col("rule_name") == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)
    h = hotspots(shares, ["rule_name", "file_path"], F.col("severity"), extra, {k: F.col(k) for k in ("rule_name", "rule_kind", "file_path")})
    severity = F.when(F.col("weighted") >= least, F.when(F.col("worst").isin("CRITICAL", "INFO"), F.col("worst")).otherwise("WARNING"))
    return _hotspot_flags(h, "ARCHITECTURE_HOTSPOT", severity, {"weighted": F.round("weighted", 3), "min_weighted": F.lit(least), "offenders": F.col("offenders")})


def static_hotspots(shares: DataFrame, least: float = 2.0) -> DataFrame:
    """STATIC_ANALYSIS_HOTSPOT flags. shares: author, share, analyzer, rule_id, category, file_path, severity."""
    h = hotspots(shares, ["rule_id", "file_path"], F.col("severity"), None, {k: F.col(k) for k in ("analyzer", "rule_id", "category", "file_path")})
    severity = F.when(F.col("weighted") >= least, F.when(F.col("worst").isin("CRITICAL", "INFO"), F.col("worst")).otherwise("WARNING"))
    return _hotspot_flags(h, "STATIC_ANALYSIS_HOTSPOT", severity, {"weighted": F.round("weighted", 3), "min_weighted": F.lit(least), "offenders": F.col("offenders")})


def complexity_hotspots(shares: DataFrame, warn: float, critical: float) -> DataFrame:
    """COMPLEXITY_HOTSPOT flags: critical from ``critical`` on, or from ``warn`` on if the worst finding is. shares: author, share, rule_key, severity, file_path, method_name, measured_value. The finding with the largest measure stands for its method."""
    keep = {k: F.col(k) for k in ("rule_key", "file_path", "method_name", "measured_value")}
    h = hotspots(shares, ["file_path", "method_name"], F.col("severity"), None, keep, F.col("measured_value").cast("double"), 3)
    severity = F.when((F.col("weighted") >= critical) | ((F.col("weighted") >= warn) & (F.col("worst") == "CRITICAL")), "CRITICAL").when(F.col("weighted") >= warn, "WARNING")
    return _hotspot_flags(h, "COMPLEXITY_HOTSPOT", severity, {"score": F.round("weighted", 3), "warn_threshold": F.lit(warn), "crit_threshold": F.lit(critical), "worst_severity": F.col("worst"), "offenders": F.col("offenders")})


def hotspot_blame(flag: Column, details: Column) -> Column:
    """How much blame a hotspot flag's details hold; 0 for other flags and unreadable details."""
    field = lambda name: F.coalesce(F.try_to_number(F.get_json_object(details, name), F.lit("9999999999.999999")).cast("double"), F.lit(0.0))
    return F.when(flag == "COMPLEXITY_HOTSPOT", field("$.score")).when(flag.isin("ARCHITECTURE_HOTSPOT", "STATIC_ANALYSIS_HOTSPOT"), field("$.weighted")).otherwise(0.0)


def last_minute(prs: DataFrame) -> DataFrame:
    """LAST_MINUTE_PR flags, one for each pull request in that band with a member. prs: member, pr, title, url, repo, hours, merged_at, band."""
    details = F.struct(F.col("pr").alias("pr_number"), F.col("title").alias("pr_title"), F.col("url").alias("pr_url"), "repo", round_half_even(1)(F.coalesce("hours", F.lit(0.0))).alias("hours_before_deadline"), "merged_at")
    return prs.filter("band = 'last_minute' and member is not null").select("member", F.lit("LAST_MINUTE_PR").alias("flag"), F.lit("WARNING").alias("severity"), F.to_json(details).alias("details"))


def dispatch(old: DataFrame, scope: DataFrame, keys: list[str], found: list[DataFrame]) -> DataFrame:
    """The flags table after a run: those of the scopes in ``scope`` (such as a sprint or a project) are replaced by what the detectors found, others stay. All have the columns of old."""
    kept = old.join(scope.select(*keys).distinct(), keys, "left_anti")
    return reduce(lambda a, b: a.unionByName(b.select(*old.columns)), found, kept)


def redetect(old: DataFrame, scope: DataFrame, keys: list[str], names: list[str], found: list[DataFrame]) -> DataFrame:
    """As dispatch, for the flags called ``names`` only."""
    mine = F.col("flag").isin(*names)
    return old.filter(~mine).unionByName(dispatch(old.filter(mine), scope, keys, found))


def rewrites(before: DataFrame, now: DataFrame) -> DataFrame:
    """Statements at the same place with the same normalised and another raw hash by another author: file, victim, actor, n. Both: file, position, raw, normalized, author."""
    old = before.select("file", "position", "normalized", F.col("raw").alias("raw0"), F.col("author").alias("victim"))
    x = now.join(old, ["file", "position", "normalized"]).filter("raw != raw0 and not (author <=> victim)")
    return x.groupBy("file", "victim", F.col("author").alias("actor")).agg(F.count("*").alias("n"))


def layer_violations(imports: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Imports from a layer that may not depend on the target's. imports: file, package, target; layers: layer, prefix; allowed: layer, may. The longest prefix of whole segments names a package's layer; packages without one are free. Layers are matched by an equi-join on all prefixes of a package."""

    def named(df: DataFrame, package: str, layer: str) -> DataFrame:
        parts = F.split(F.col(package), r"\.")
        depth = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))
        p = df.select(package).distinct().filter(F.col(package).isNotNull()).select(package, depth.alias("prefix")).join(layers.select("layer", "prefix"), "prefix")
        best = p.groupBy(package).agg(F.max_by("layer", F.length("prefix")).alias(layer))
        return df.join(best, package)

    x = named(named(imports, "package", "source"), "target", "used").filter("source != used")
    return x.join(allowed.select(F.col("layer").alias("source"), F.col("may").alias("used")), ["source", "used"], "left_anti").select("file", "package", "target", "source", "used")

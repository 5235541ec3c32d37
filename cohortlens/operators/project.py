"""Project grades from raw measures: gates, repository axes, extra technologies, penalties, formulas, all over a cohort at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.paths import repo_kind
from cohortlens.functions.scalar import absolute_map, clamp, hybrid_normalize, linear_map, round_half_away, safe_divide
from cohortlens.operators.cohort import present_mean

# Metrics of each axis by kind of repository, and the shares of breadth and volume in size.
AXES = {
    "size": {"spring": ("endpoint_count", "controller_count", "entity_count", "repository_count"), "android": ("fragment_count", "activity_count", "viewmodel_count", "room_database_count")},
    "complexity": {"spring": ("custom_query_count", "scheduled_task_count", "avg_cc_per_controller", "avg_statements_per_endpoint"), "android": ("reactive_wiring_density", "nav_dispatch_density", "avg_cc_per_fragment")},
}
BREADTH, VOLUME = 0.70, 0.30
# Signals of extra technologies: metric, weight's name, its default, and how a count saturates (cap, half or none).
EXTRA_TECH = (
    ("fcm_send_call_count", "w_fcm_spring", 3.0, "cap"), ("fcm_android_room_store", "w_fcm_android", 3.0, "half"), ("specification_def_count", "w_spec", 3.0, "cap"),
    ("email_send_site_count", "w_email", 2.0, "cap"), ("graphics_custom_draw_count", "w_graphics", 2.0, "cap"), ("av_usage_count", "w_av", 2.0, "cap"),
    ("okhttp_external_api_count", "w_okhttp_external_api", 1.0, "none"), ("minio_object_io_site_count", "w_minio_object_io", 2.0, "cap"),
)
# Layer rules that are reported but don't lower a grade, and flags that don't.
UNGRADED_LAYER_RULES = ("domain->!presentation", "application->!presentation")
UNGRADED_FLAGS = ("ZERO_TASKS", "LOW_COMPOSITE_SCORE")
#: Weight of a critical complexity finding in the density of violations.
COMPLEXITY_WEIGHT = 1 / 3


def gradable(metrics: DataFrame) -> DataFrame:
    """Projects with production code (lines or statements above 0). metrics: project, repo, key, value."""
    mass = metrics.filter(F.col("key").isin("production_loc", "production_statement_count")).groupBy("project").agg(F.max("value").alias("most"))
    return mass.filter("most > 0").select("project")


def cohort_bounds(metrics: DataFrame, anchors: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """key, p10, p90, floor, ceiling over all projects' repositories; statements are bounded by project totals. Anchors are those given, else 0 and 1."""
    totals = metrics.filter("key = 'production_statement_count'").groupBy("project", "key").agg(F.sum("value").alias("value")).select("key", "value")
    every = metrics.filter("key != 'production_statement_count'").select("key", "value").unionByName(totals)
    b = every.filter("value is not null").groupBy("key").agg(F.percentile("value", 0.1).alias("p10"), F.percentile("value", 0.9).alias("p90"))
    side = lambda i, default: reduce(lambda c, kv: c.when(F.col("key") == kv[0], float(kv[1][i])), (anchors or {}).items(), F.when(F.lit(False), 0.0)).otherwise(default)
    return b.withColumns({"floor": side(0, 0.0), "ceiling": side(1, 1.0)})


def _scores(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    x = metrics.filter("value is not null").join(bounds, "key")
    return x.withColumn("score", hybrid_normalize(F.col("value"), F.col("p10"), F.col("p90"), F.col("floor"), F.col("ceiling")))


def repo_axis(metrics: DataFrame, bounds: DataFrame, axis: str, weights: dict[str, float]) -> DataFrame:
    """project and the axis (0 to 10): mean of a repository's scores, mean of a kind's repositories, weighted mean of the kinds that are there."""
    wanted = reduce(lambda a, b: a | b, [(F.col("kind") == kind) & F.col("key").isin(*keys) for kind, keys in AXES[axis].items()])
    x = _scores(metrics.withColumn("kind", repo_kind(F.col("repo"))).filter(wanted), bounds)
    x = x.groupBy("project", "kind", "repo").agg(F.avg("score").alias("s")).groupBy("project", "kind").agg(F.avg("s").alias("s"))
    weight = F.when(F.col("kind") == "android", float(weights["w_android"])).otherwise(float(weights["w_spring"]))
    return x.groupBy("project").agg((F.sum(F.col("s") * weight) / F.sum(weight)).alias(axis))


def statement_volume(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    totals = metrics.filter("key = 'production_statement_count'").groupBy("project", "key").agg(F.sum("value").alias("value")).filter("value > 0")
    return _scores(totals, bounds).select("project", clamp(F.col("score"), 0.0, 10.0).alias("volume"))


def project_axes(projects: DataFrame, metrics: DataFrame, bounds: DataFrame, weights: dict[str, float]) -> DataFrame:
    """By project: size, complexity, quality (each null if absent), work_base (0 if both of the first are), quality_multiplier. projects: project, maintainability (null if not measured), mutation. Projects without code have none of it and a neutral multiplier of 0.

    quality: maintainability between its anchors, with mutation if there is any; a project without it counts as 10.
    """
    w = {"w_android": 0.6, "w_spring": 0.4, "w_size": 0.2, "w_complexity": 0.3, "quality_floor": 0.25, "quality_blend": 0.75, "work_scale": 1.0, "w_mi": 0.35, "w_mutation": 0.10, "mi_floor": 85.0, "mi_ceiling": 98.0} | weights
    real = metrics.join(gradable(metrics), "project", "left_semi")
    x = projects.join(gradable(metrics).withColumn("code", F.lit(True)), "project", "left")
    for part in (repo_axis(real, bounds, "size", w).withColumnRenamed("size", "breadth"), statement_volume(real, bounds), repo_axis(real, bounds, "complexity", w)):
        x = x.join(part, "project", "left")
    size = present_mean({"b": (F.col("breadth"), BREADTH), "v": (F.col("volume"), VOLUME)})
    mi = F.when(F.col("maintainability").isNotNull(), absolute_map(F.col("maintainability"), w["mi_floor"], w["mi_ceiling"]))
    mutation = F.when(F.col("maintainability").isNotNull() & (F.col("mutation") > 0), clamp(F.col("mutation") * 10, 0.0, 10.0))
    x = x.withColumns({"size": size, "quality": F.when(F.col("code"), present_mean({"m": (mi, w["w_mi"]), "t": (mutation, w["w_mutation"])}))})
    work = present_mean({"s": (F.col("size"), w["w_size"]), "c": (F.col("complexity"), w["w_complexity"])})
    multiplier = w["quality_floor"] + w["quality_blend"] * F.coalesce("quality", F.lit(10.0)) / 10
    return x.select("project", "size", "complexity", "quality", F.coalesce(work * w["work_scale"], F.lit(0.0)).alias("work_base"), F.when(F.col("code"), multiplier).otherwise(0.0).alias("quality_multiplier"))


def extra_technology(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """project, extra_tech: weighted counts of uses of extra technologies over its repositories, each saturated at the cap."""
    w = weights or {}
    cap = max(1.0, w.get("extra_tech_cap", 3.0))
    how = {"cap": lambda v: F.least(v, F.lit(cap)) / cap, "half": lambda v: F.least(v / 2, F.lit(1.0)), "none": lambda v: v}
    total = lambda key: F.coalesce(F.sum(F.when(F.col("key") == key, F.col("value"))), F.lit(0.0))
    parts = [F.when(total(key) > 0, how[kind](total(key)) * w.get(name, default)).otherwise(0.0) for key, name, default, kind in EXTRA_TECH]
    return metrics.groupBy("project").agg(reduce(lambda a, b: a + b, parts).alias("extra_tech"))


def violation_density(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """project, density: critical findings (security ones twice, complexity ones a third) by thousand lines, one at least; null without both. findings: project, kind (static or complexity), category."""
    weight = F.when(F.col("kind") == "complexity", COMPLEXITY_WEIGHT).when(F.col("category") == "security", 2.0).otherwise(1.0)
    n = findings.groupBy("project").agg(F.sum(weight).alias("n"))
    loc = metrics.filter("key = 'production_loc'").groupBy("project").agg((F.sum("value") / 1000).alias("kloc"))
    x = n.join(loc, "project", "full")
    count, kloc = F.coalesce("n", F.lit(0.0)), F.coalesce("kloc", F.lit(0.0))
    return x.select("project", F.when((kloc > 0) | (count > 0), count / F.greatest(kloc, F.lit(1.0))).alias("density"))


def architecture_counts(violations: DataFrame) -> DataFrame:
    """project, critical, warnings: breaches of layers, but for the rules that are not graded. violations: project, rule_kind, rule_name, severity."""
    x = violations.filter((F.col("rule_kind") == "layer_dependency") & ~F.col("rule_name").isin(*UNGRADED_LAYER_RULES))
    s = F.upper("severity")
    return x.groupBy("project").agg(F.count_if(s.isin("CRITICAL", "ERROR")).alias("critical"), F.count_if(s == "WARNING").alias("warnings"))


def raw_means(scores: DataFrame, authors: DataFrame, members: DataFrame, value: str) -> DataFrame:
    """project, mean of a pull request's value over its authors' projects: a pull request counts once for each author. scores: pr, value; authors: pr, member; members: member, project."""
    x = scores.filter(F.col(value).isNotNull()).join(authors, "pr").join(members, "member")
    return x.groupBy("project").agg(F.avg(value).alias(value))


def critical_flags(flags: DataFrame) -> DataFrame:
    """student, criticals: critical flags of behaviour that count, hotspots and ungraded ones left out. flags: student, flag, severity."""
    x = flags.filter((F.col("severity") == "CRITICAL") & ~F.col("flag").endswith("_HOTSPOT") & ~F.col("flag").isin(*UNGRADED_FLAGS))
    return x.groupBy("student").agg(F.count("*").alias("criticals"))


def quality_penalties(blame: DataFrame, signals: dict[str, float], own_share: float = 0.8, own_cap: float = 1.0, team_cap: float = 0.5) -> DataFrame:
    """project, student, penalty: of each signal's blame, capped as named, ``own_share`` falls on the author (``own_cap`` at most over all) and the rest on the team in equal parts (``team_cap`` at most). blame: project, student, signal, blame."""
    cap = reduce(lambda c, kv: c.when(F.col("signal") == kv[0], float(kv[1])), signals.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    x = blame.groupBy("project", "student", "signal").agg(F.sum("blame").alias("blame")).withColumn("capped", F.least("blame", cap))
    own = x.groupBy("project", "student").agg(F.sum("capped").alias("total"))
    team = own.groupBy(F.col("project").alias("p2")).agg(F.sum("total").alias("all"), F.count("*").alias("n"))
    own = own.join(team, F.col("project") == F.col("p2"))
    share = F.least((1 - own_share) * F.col("all") / F.col("n"), F.lit(team_cap))
    return own.select("project", "student", (F.least(own_share * F.col("total"), F.lit(own_cap)) + share).alias("penalty"))


def curved(x: Column, gamma: float, top: float = 10.0) -> Column:
    """top * (x / top) ^ gamma, from 0 to top."""
    return F.least(F.lit(top), top * F.pow(F.greatest(x, F.lit(0.0)) / top, F.lit(gamma)))


def final_grades(projects: DataFrame, students: DataFrame, gamma: float, decimals: int = 2, step: float = 0.0) -> DataFrame:
    """project, student, project_final, student_final. projects: project, work_base, quality_multiplier, ai_factor, extra_tech; students: project, student, contribution (null: none), share (of an even part of the team), penalty, criticals.

    The project's raw grade is work times use times quality plus what extra technologies add up to a point; it is curved. A student's base is
    that grade scaled by the root of the share, less penalty and half a point for each critical flag, from 0 to 10.
    """
    raw = F.col("work_base") * F.col("ai_factor") * F.col("quality_multiplier") + F.least(F.col("extra_tech") / 10, F.lit(1.0))
    p = projects.select("project", curved(raw, gamma).alias("p"))
    x = students.join(p, "project")
    net = F.col("p") * F.sqrt(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.5))) - F.coalesce("penalty", F.lit(0.0)) - 0.5 * F.coalesce("criticals", F.lit(0))
    grade = clamp(net, 0.0, 10.0)
    return x.select("project", "student", round_half_away(F.col("p"), decimals, step).alias("project_final"), round_half_away(grade, decimals, step).alias("student_final"))


def grade_steps(projects: DataFrame, students: DataFrame, gamma: float) -> DataFrame:
    """project, student (null: the project), step, value: everything on the way to the unrounded grades of ``final_grades``, which takes the same tables, in long form.

    Steps of a project: work_base, quality_multiplier, ai_factor, extra (a point at most), raw, curved. Steps of a student:
    share, scaled (the project's grade by the root of the share), penalty, criticals (points lost), final.
    """
    extra = F.least(F.col("extra_tech") / 10, F.lit(1.0))
    p = projects.withColumns({"extra": extra, "raw": F.col("work_base") * F.col("ai_factor") * F.col("quality_multiplier") + extra})
    p = p.withColumn("curved", curved(F.col("raw"), gamma))
    s = students.join(p.select("project", "curved"), "project").withColumns({
        "share": F.coalesce(F.col("share").cast("double"), F.lit(0.0)),
        "penalty": F.coalesce(F.col("penalty").cast("double"), F.lit(0.0)),
        "criticals": 0.5 * F.coalesce("criticals", F.lit(0)),
    })
    s = s.withColumn("scaled", F.col("curved") * F.sqrt(F.least("share", F.lit(1.5))))
    s = s.withColumn("final", clamp(F.col("scaled") - F.col("penalty") - F.col("criticals"), 0.0, 10.0))

    def steps(x: DataFrame, *names: str) -> DataFrame:
        return x.select("project", "student", F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(k).cast("double").alias("value")) for k in names])).alias("s")).select("project", "student", "s.*")

    none = p.withColumn("student", F.lit(None).cast(students.schema["student"].dataType))
    return steps(none, "work_base", "quality_multiplier", "ai_factor", "extra", "raw", "curved").unionByName(steps(s, "share", "scaled", "penalty", "criticals", "final"))


def charged_students(students: DataFrame) -> DataFrame:
    """project (null: the cohort), students, charged (with a penalty above 0), share: in one pass over both levels. students: project, penalty."""
    x = students.filter("project is not null").groupingSets([["project"], []], "project")
    x = x.agg(F.count("*").alias("students"), F.count_if(F.coalesce(F.col("penalty") > 0, F.lit(False))).alias("charged"))
    return x.select("project", "students", "charged", safe_divide(F.col("charged"), F.col("students")).alias("share"))


def review_route(grade: Column, missing: Column, criticals: Column, pass_mark: float = 5.0, margin: float = 0.25) -> Column:
    """Where a grade goes: block (inputs missing), manual (critical flags, or within a margin of the pass mark), else release."""
    return F.when(missing, "block").when((F.coalesce(criticals, F.lit(0)) > 0) | (F.abs(grade - pass_mark) < margin), "manual").otherwise("release")


def scale_to_top(grades: DataFrame, value: str, target: float) -> DataFrame:
    """One row: top, scale: what brings the cohort's highest value to target."""
    return grades.agg(F.max(value).alias("top")).select("top", safe_divide(F.lit(float(target)), F.col("top"), 1.0).alias("scale"))


def mapped(x: Column, low: float, high: float) -> Column:
    return clamp(linear_map(x, low, high, 0.0, 10.0), 0.0, 10.0)

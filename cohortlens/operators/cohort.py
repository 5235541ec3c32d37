"""Cohort grading around the formulas: declared usage, scopes, anchors, axes, calibration, parity; and behavioural scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import clamp, safe_divide, weighted_fusion

#: Words that mark a small follow-up commit.
FIXUP_WORDS = ("fix", "typo", "missing", "forgot", "oops", "lint", "format")


def usage(own: tuple[Column, Column, Column], parent: tuple[Column, Column, Column], exempt: Column, models: dict[str, float], levels: dict[str, float], undeclared: tuple[float, float] = (0.5, 1.0)) -> tuple[Column, Column, Column]:
    """(model factor, level factor, declared) of a task. Own and parent are (model, level, declared flag); the first complete declaration counts, an exempt task is declared without use, unknown names weigh 1."""

    def told(x: tuple[Column, Column, Column]) -> Column:
        return F.coalesce(x[2], F.lit(False)) & x[0].isNotNull() & x[1].isNotNull()

    def factor(name: Column, known: dict[str, float]) -> Column:
        return reduce(lambda c, kv: c.when(name == kv[0], kv[1]), known.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)

    free = F.coalesce(exempt, F.lit(False))
    out = [F.when(free, 0.0).when(told(own), factor(own[i], known)).when(told(parent), factor(parent[i], known)).otherwise(undeclared[i]) for i, known in enumerate((models, levels))]
    return out[0], out[1], free | told(own) | told(parent)


def scopes(tasks: DataFrame, project: str, student: str, points: str, keep: str, team_size: DataFrame) -> DataFrame:
    """By project and student: student_raw, student_eff, own_keep (null without points), contribution (null if the project keeps none), and sum_raw, sum_eff, mean_raw (by team size, 1 at least), ai_factor (1 without points). team_size: project, team_size; projects and tasks without a partner stay, a task without a student counts for its project only."""
    by = tasks.groupBy(project, student).agg(F.sum(points).alias("student_raw"), F.sum(F.col(points) * F.col(keep)).alias("student_eff"))
    w = Window.partitionBy(project)
    by = by.withColumns({"sum_raw": F.sum("student_raw").over(w), "sum_eff": F.sum("student_eff").over(w)}).filter(F.col(student).isNotNull())
    sizes = team_size.select(F.col(project).alias("__p"), "team_size")
    x = by.join(sizes, F.col(project) == F.col("__p"), "left")
    return x.select(
        project, student, "student_raw", "student_eff", safe_divide(F.col("student_eff"), F.col("student_raw"), None).alias("own_keep"), safe_divide(F.col("student_eff"), F.col("sum_eff"), None).alias("contribution"),
        "sum_raw", "sum_eff", (F.col("sum_raw") / F.greatest(F.coalesce("team_size", F.lit(1)), F.lit(1))).alias("mean_raw"), safe_divide(F.col("sum_eff"), F.col("sum_raw"), 1.0).alias("ai_factor"),
    )


def anchors(samples: DataFrame, key: str, value: str, zero_floor: tuple[str, ...] = (), digits: int = 2) -> DataFrame:
    """By key: floor (95 % of the least value; 0 for the keys named or a least value of 0 or below) and ceiling (a tenth of the span, 1 at least, above the largest, and 1 at least above the floor). Null values do not count."""
    g = samples.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    floor = F.when(F.col(key).isin(*zero_floor) | (F.col("__low") <= 0), 0.0).otherwise(F.col("__low") * 0.95)
    g = g.withColumn("__floor", floor)
    top = F.col("__high") + 0.1 * F.greatest(F.col("__high") - F.col("__low"), F.lit(1.0))
    ceiling = F.when(F.col("__high") <= F.col("__floor"), F.col("__floor") + 1).otherwise(F.greatest(top, F.col("__floor") + 1))
    return g.select(key, F.round("__floor", digits).alias("floor"), F.round(ceiling, digits).alias("ceiling"))


def present_mean(terms: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the scores that are there, clamped to 0..10; null if none is."""
    return clamp_or_null(weighted_fusion(terms)[0], 0.0, 10.0)


def clamp_or_null(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), clamp(x, low, high))


def saturated_sum(signals: dict[str, tuple[Column, float, float]]) -> Column:
    """Sum of weight * min(value, cap) / cap over (value, weight, cap); null counts as 0."""
    return reduce(lambda a, b: a + b, [F.least(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(float(cap))) / float(cap) * float(w) for x, w, cap in signals.values()])


def calibrate(df: DataFrame, value: str, target: float, fallback: float = 1.0, digits: int = 4) -> DataFrame:
    """One row, scale: the factor that brings the largest value to target; ``fallback`` unless it is positive."""
    top = F.max(value)
    return df.agg(F.when(top > 0, F.round(F.lit(float(target)) / F.when(top > 0, top), digits)).otherwise(float(fallback)).alias("scale"))


def parity(have: DataFrame, want: DataFrame, key: str, columns: dict[str, int]) -> DataFrame:
    """Keys and columns whose values differ by more than half a unit in the last displayed decimal, or that only one side has: key, column, have, want, delta (null where a side is missing)."""
    w = want.select(F.col(key).alias("__k"), *[F.col(c).cast("double").alias(f"__{c}") for c in columns])
    x = have.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).join(w, F.col(key) == F.col("__k"), "full")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("have"), F.col(f"__{c}").alias("want"), F.lit(0.5 * 10**-d).alias("tol")) for c, d in columns.items()])
    x = x.select(F.coalesce(key, "__k").alias(key), F.explode(each).alias("e")).select(key, "e.*").withColumn("delta", F.abs(F.col("have") - F.col("want")))
    return x.filter((F.col("delta") > F.col("tol")) | (F.col("have").isNull() != F.col("want").isNull())).drop("tol")


def behaviour(commits: DataFrame, key: str, at: str, size: str, message: str) -> DataFrame:
    """By key, commits ordered by time, size, message: commit_count, max_size, mean_gap (minutes, null for one commit), anomaly (over 200 within 15 minutes of the commit before), fixup (100 or more first, then at most 30 with a fix-up word), adjusts_tests, has_small (size 1 to 19), message_length, and score. Null sizes count as 0, null messages as empty."""
    c = commits.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("__t"), F.coalesce(F.col(size), F.lit(0)).alias("__n"), F.coalesce(F.col(message), F.lit("")).alias("__m"))
    w = Window.partitionBy(key).orderBy("__t", "__n", "__m")
    c = c.withColumns({"__gap": (F.col("__t") - F.lag("__t").over(w)) / 60e6, "__i": F.row_number().over(w)})
    low = F.lower("__m")
    small = (F.col("__n") <= 30) & low.rlike("|".join(FIXUP_WORDS))
    g = c.groupBy(key).agg(
        F.count("*").alias("commit_count"), F.max("__n").alias("max_size"), F.avg("__gap").alias("mean_gap"), F.coalesce(F.bool_or((F.col("__n") > 200) & (F.col("__gap") < 15)), F.lit(False)).alias("__fast"),
        (F.max("__t") > F.min("__t")).alias("__span"), F.bool_and(F.when(F.col("__i") == 1, F.col("__n") >= 100).otherwise(small)).alias("__fix"), F.bool_or(low.contains("test")).alias("adjusts_tests"),
        F.bool_or((F.col("__n") > 0) & (F.col("__n") < 20)).alias("has_small"), F.avg(F.length("__m")).alias("message_length"),
    )
    g = g.withColumns({"anomaly": F.coalesce("__span", F.lit(False)) & F.col("__fast"), "fixup": (F.col("commit_count") > 1) & F.col("__fix")})
    parts = [((F.col("commit_count") == 1) & (F.col("max_size") > 200), 0.30), (F.col("fixup"), 0.25), (F.col("anomaly"), 0.25), (~F.col("adjusts_tests") & (F.col("max_size") > 100), 0.10), (~F.col("has_small"), 0.10)]
    score = F.least(reduce(lambda a, b: a + b, [F.when(on, w_).otherwise(0.0) for on, w_ in parts]), F.lit(1.0))
    return g.select(key, "commit_count", "max_size", "mean_gap", "anomaly", "fixup", "adjusts_tests", "has_small", "message_length", score.alias("score"))


def consistency(terms: list[tuple[Column, Column, float]]) -> Column:
    """Sum of weight * |value - baseline| / sd / 3, each part clamped to 0..1; sd is 35 % of the baseline, 0.1 at least. Terms are (value, baseline, weight); null if any of them is."""
    return reduce(lambda a, b: a + b, [clamp_or_null(F.abs(x - base) / F.greatest(base * 0.35, F.lit(0.10)) / 3, 0.0, 1.0) * w for x, base, w in terms])


def attribute_scores(lines: DataFrame, author: str, file: str, amount: str, scores: DataFrame, score: str, least: int = 10) -> DataFrame:
    """By author: files, lines, score: the line-weighted mean of file scores, over files of which the author has ``least`` lines or more. Lines without an author and files without a score do not count."""
    own = lines.filter(F.col(author).isNotNull()).groupBy(author, file).agg(F.sum(amount).alias("__n")).filter(F.col("__n") >= least)
    s = scores.filter(F.col(score).isNotNull()).select(F.col(file).alias("__f"), F.col(score).alias("__s"))
    g = own.join(s, F.col(file) == F.col("__f")).groupBy(author).agg(F.count("*").alias("files"), F.sum("__n").alias("lines"), F.sum(F.col("__n") * F.col("__s")).alias("__x"))
    return g.select(author, "files", "lines", safe_divide(F.col("__x"), F.col("lines"), None).alias("score"))


# Anchors of metrics without one in the specification. Each end is a number or (weight, default); ceilings of the breaches of architecture count twice.
DEFAULT_ANCHORS = {
    "documentation_raw": (0.0, ("doc_max", 6.0)),
    "code_quality_raw": (("mi_floor", 50.0), ("mi_ceiling", 85.0)),
    "cc_pct": (0.0, 100.0),
    "mutation_score": (0.0, 1.0),
    "survival_raw": (("surv_floor", 0.5), ("surv_ceiling", 0.95)),
    "arch_weighted": (0.0, ("arch_norm", 4.0)),
    "violation_density": (0.0, ("density_ceiling", 5.0)),
    "production_loc": (0.0, ("prod_loc_ceiling", 50_000.0)),
    "production_statement_count": (0.0, ("prod_stmt_ceiling", 15_000.0)),
}
# Inventory metrics that share a ceiling, by its weight and default.
INVENTORY_ANCHORS = {
    ("inventory_count_ceiling", 50.0): ("endpoint_count", "controller_count", "entity_count", "repository_count", "fragment_count", "activity_count", "viewmodel_count", "room_database_count"),
    ("inventory_depth_ceiling", 30.0): ("custom_query_count", "scheduled_task_count", "observe_call_count", "nav_dispatch_count", "reactive_state_field_count"),
    ("inventory_density_ceiling", 10.0): ("reactive_wiring_density", "nav_dispatch_density", "avg_cc_per_controller", "avg_cc_per_fragment", "avg_statements_per_endpoint"),
}


def resolved_anchors(samples: DataFrame, specs: DataFrame, weights: DataFrame) -> DataFrame:
    """samples with floor, ceiling and origin of its key's anchors in its specification: spec, else weights (named ones, else their defaults), else unit (0 to 1).

    samples: spec, key and more; specs: spec, key, floor, ceiling; weights: spec, name, value. Rules are a small table, so
    any number of specifications is resolved by joins. A null key or specification has unit anchors, or those of no named weights.
    """
    rules = [(k, *[v if isinstance(v, tuple) else (None, v) for v in ends]) for k, ends in DEFAULT_ANCHORS.items()]
    rules += [(k, (None, 0.0), ceiling) for ceiling, keys in INVENTORY_ANCHORS.items() for k in keys]
    schema = "rule string, f struct<name:string,value:double>, c struct<name:string,value:double>"
    table = F.broadcast(samples.sparkSession.createDataFrame(rules, schema))  # the fixed rules above
    own = specs.groupBy(F.col("spec").alias("s1"), F.col("key").alias("k1")).agg(F.max(F.struct("floor", "ceiling")).alias("own"))
    named = weights.filter("name is not null and value is not null").groupBy(F.col("spec").alias("s2")).agg(F.map_from_entries(F.collect_set(F.struct("name", F.col("value").cast("double")))).alias("w"))
    x = samples.join(own, (F.col("spec") == F.col("s1")) & (F.col("key") == F.col("k1")), "left")
    x = x.join(named, F.col("spec") == F.col("s2"), "left").join(table, F.col("key") == F.col("rule"), "left")
    end = lambda e: F.coalesce(F.when(F.col(e)["name"].isNotNull(), F.get(F.map_values(F.map_filter("w", lambda k, _: k == F.col(e)["name"])), F.lit(0))), F.col(e)["value"])
    twice = F.when(F.col("key") == "arch_weighted", 2.0).otherwise(1.0)
    return x.select(
        *samples.columns,
        F.when(F.col("own").isNotNull(), F.col("own.floor")).otherwise(F.coalesce(end("f"), F.lit(0.0))).cast("double").alias("floor"),
        F.when(F.col("own").isNotNull(), F.col("own.ceiling")).otherwise(F.coalesce(end("c") * twice, F.lit(1.0))).cast("double").alias("ceiling"),
        F.when(F.col("own").isNotNull(), "spec").when(F.col("rule").isNotNull(), "weights").otherwise("unit").alias("origin"),
    )

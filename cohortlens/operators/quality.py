"""Code quality by author: findings with their limits, debt comments and their changes, line badness, shares of blame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import text as T
from cohortlens.functions.scalar import safe_divide
from cohortlens.operators.flags import severity_rank

#: measure -> (rule, words for its text)
CLASSIC = {
    "cyclomatic": ("cyclomatic", "cyclomatic complexity {} exceeds {} bound {}"), "cognitive": ("cognitive", "cognitive complexity {} exceeds {} bound {}"), "nesting": ("nesting", "max nesting depth {} exceeds {} bound {}"),
    "loc": ("long_method", "method spans {} lines (> {} bound {})"), "parameters": ("wide_signature", "method takes {} parameters (> {} bound {})"),
}
# What makes a method hard to test, by rule.
TESTABILITY = (
    ("broad_catch", r"catch\s*\(\s*(?:final\s+)?(?:Exception|Throwable|RuntimeException)\b"), ("non_deterministic", r"\b(?:LocalDate(?:Time)?|Instant)\.now\s*\(|System\.(?:currentTimeMillis|nanoTime)\s*\(|Math\.random\s*\(|new\s+Random\s*\(\s*\)|UUID\.randomUUID\s*\("),
    ("inline_collaborator", r"\bnew\s+[A-Z]\w*(?:Service|Repository|Client|Dao|Manager)\s*\("), ("static_singleton", r"\b[A-Z]\w*\.getInstance\s*\("), ("reflection", r"\bClass\.forName\s*\(|\.getDeclared(?:Method|Field|Constructor)s?\s*\(|\.setAccessible\s*\("),
)
CONTROL = r"^\W*(?:if|else|for|while|do|switch|case|default|try|catch|finally|return|throw|break|continue)\b"


def classic_findings(methods: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """methods with rule, severity, measured, threshold and detail for each measure above its warning or critical limit (strictly). limits: measure -> (warn, critical)."""
    found = []
    for measure, (warn, critical) in limits.items():
        rule, words = CLASSIC[measure]
        v = F.col(measure)
        a, b, c = words.split("{}")[0], *words.split("{}")[1:3]
        level = F.when(v > critical, "critical").when(v > warn, "warning")
        bound = F.when(v > critical, float(critical)).otherwise(float(warn))
        detail = F.concat(F.lit(a), v.cast("bigint").cast("string"), F.lit(b), level, F.lit(c), bound.cast("bigint").cast("string"), F.lit(words.split("{}")[3]))
        found.append(F.when(level.isNotNull(), F.struct(F.lit(rule).alias("rule"), F.upper(level).alias("severity"), v.cast("double").alias("measured"), bound.alias("threshold"), detail.alias("detail"))))
    x = methods.withColumn("f", F.explode(F.filter(F.array(*found), lambda y: y.isNotNull())))
    return x.select(*methods.columns, "f.rule", "f.severity", "f.measured", "f.threshold", "f.detail")


def testability_findings(files: DataFrame) -> DataFrame:
    """path, line (from 1), rule for each code line that makes its method hard to test. files: path, text."""
    lines = files.select("path", F.explode(T.code_lines(F.split("text", "\n"), F.col("path"))).alias("x"))
    rules = F.filter(F.array(*[F.when(F.col("x.line").rlike(p), F.lit(rule)) for rule, p in TESTABILITY]), lambda r: r.isNotNull())
    return lines.select("path", (F.col("x.i") + 1).alias("line"), F.explode(rules).alias("rule"))


def line_badness(lines: DataFrame, offending: DataFrame) -> DataFrame:
    """lines with badness: 3 where a finding points, 2 for control flow, 1 for others; blank and brace lines are left out. lines: file, line, text; offending: file, line."""
    bad = offending.select(F.col("file").alias("f2"), F.col("line").alias("l2")).distinct().withColumn("hit", F.lit(True))
    x = lines.filter(~F.coalesce("text", F.lit("")).rlike(r"^[\s{}();]*\z")).join(bad, (F.col("file") == F.col("f2")) & (F.col("line") == F.col("l2")), "left")
    bare = F.regexp_replace(F.regexp_replace("text", r'"(?:[^"\\]|\\.)*"', ""), "//.*", "")
    return x.withColumn("badness", F.when(F.col("hit"), 3).when(bare.rlike(CONTROL), 2).otherwise(1)).select(*lines.columns, "badness")


def weighted_attribution(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """finding, author, weight: each author's share of the badness of a finding's lines; introduced: the earliest time above 0 of its lines. findings: finding, file, start, end; lines: file, line, author, badness, at (seconds)."""
    x = findings.join(lines, "file").filter("line between start and end and author is not null")
    by = x.groupBy("finding", "author").agg(F.sum("badness").alias("b"), F.min(F.when(F.col("at") > 0, F.col("at"))).alias("at"))
    total = by.groupBy(F.col("finding").alias("f2")).agg(F.sum("b").alias("total"), F.min("at").alias("introduced"))
    return by.join(total, F.col("finding") == F.col("f2")).select("finding", "author", (F.col("b") / F.col("total")).alias("weight"), "introduced")


def with_attributions(findings: DataFrame, shares: DataFrame) -> DataFrame:
    """findings with authors, an array of (author, weight) by weight, largest first, then author; empty without any."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "author")))
    a = shares.groupBy(F.col("finding").alias("f2")).agg(F.transform(order, lambda x: F.struct(x["author"].alias("author"), (-x["w"]).alias("weight"))).alias("authors"))
    none = F.expr("cast(array() as array<struct<author:string,weight:double>>)")
    return findings.join(a, F.col("finding") == F.col("f2"), "left").withColumn("authors", F.coalesce("authors", none)).drop("f2")


def debt_comments(comments: DataFrame) -> DataFrame:
    """comments that admit debt, with category, keyword (what was found) and comment (200 characters). comments: file, line, author, text."""
    category = T.classify(F.col("text"), T.SATD_PATTERNS)
    keyword = F.coalesce(*[F.when(category == name, F.regexp_extract("text", f"(?i)({p})", 1)) for name, p in T.SATD_PATTERNS])
    return comments.withColumn("category", category).filter("category is not null").withColumns({"keyword": keyword, "comment": F.left(T.strip(F.col("text")), F.lit(200))})


def debt_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """author, introduced, removed: debt comments (file, comment) that only one of two scans has, by their author; unknown authors are left out. Both: file, comment, author."""
    key = ["file", "comment"]
    new = now.join(before.select(*key).distinct(), key, "left_anti").select("author", F.lit(1).alias("i"), F.lit(0).alias("r"))
    gone = before.join(now.select(*key).distinct(), key, "left_anti").select("author", F.lit(0).alias("i"), F.lit(1).alias("r"))
    return new.unionByName(gone).filter("author is not null").groupBy("author").agg(F.sum("i").alias("introduced"), F.sum("r").alias("removed"))


def student_quality(methods: DataFrame, debt: DataFrame, sprints: DataFrame) -> DataFrame:
    """By member and sprint: means of cyclomatic, cognitive, loc and maintainability, share of methods over 10, debt comments, test lines by production lines, and the change of the first measures against the member's previous sprint. methods: member, sprint, cyclomatic, cognitive, loc, maintainability, path; debt: member, sprint; sprints: sprint, start."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    test = F.col("path").ilike("%test%")
    q = methods.groupBy("member", "sprint").agg(
        F.avg(zero("cyclomatic")).alias("avg_cc"), F.avg(zero("cognitive")).alias("avg_cognitive"), F.avg(zero("loc")).alias("avg_loc"), F.avg((zero("cyclomatic") > 10).cast("double")).alias("over_10"),
        F.avg("maintainability").alias("avg_mi"), F.sum(F.when(test, zero("loc")).otherwise(0)).alias("test_loc"), F.sum(F.when(test, 0).otherwise(zero("loc"))).alias("code_loc"),
    )
    d = debt.groupBy(F.col("member").alias("m2"), F.col("sprint").alias("s2")).agg(F.count("*").alias("debt"))
    q = q.join(d, (F.col("member") == F.col("m2")) & (F.col("sprint") == F.col("s2")), "left").drop("m2", "s2").join(sprints, "sprint")
    w = Window.partitionBy("member").orderBy("start", "sprint")
    delta = {f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in ("avg_cc", "avg_cognitive", "over_10", "avg_mi")}
    q = q.withColumns({**delta, "debt": F.coalesce("debt", F.lit(0)), "test_ratio": safe_divide(F.col("test_loc"), F.col("code_loc"))})
    return q.drop("start", "code_loc")


def sarif_severity(tool: Column, level: Column, declared: Column) -> Column:
    """CRITICAL, WARNING or INFO of a result: of its own numeric or named property, else of its level."""
    low, score = F.lower(F.coalesce(declared, F.lit(""))), F.try_to_number(declared, F.lit("99.9")).cast("double")
    named = F.when(low.isin("critical", "high", "blocker", "error"), "CRITICAL").when(low.isin("medium", "major", "warning", "moderate"), "WARNING").when(low.isin("low", "minor", "info", "note"), "INFO")
    by_score = F.when(score >= 7, "CRITICAL").when(score >= 4, "WARNING").when(score.isNotNull(), "INFO")
    by_level = F.when(level == "error", "CRITICAL").when(level.isin("note", "none"), "INFO").otherwise("WARNING")
    return F.coalesce(F.when(tool == "spotbugs", by_level), named, by_score, by_level)


def sarif_category(own: Column, rule: Column, help_uri: Column, default: str = "style") -> Column:
    """The result's category, else its rule's, else what the help address names, else ``default``; lower case."""
    word = F.regexp_extract(F.lower(F.coalesce(help_uri, F.lit(""))), "(security|performance|design|errorprone|bestpractices|codestyle|documentation|multithreading)", 1)
    return F.lower(F.coalesce(F.nullif(own, F.lit("")), F.nullif(rule, F.lit("")), F.nullif(word, F.lit("")), F.lit(default)))


def worst(df: DataFrame, by: list[str]) -> DataFrame:
    """The severest severity of each group."""
    return df.groupBy(*by).agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("worst"))


def estimation_flags(shares: DataFrame, threshold: float) -> DataFrame:
    return shares.filter(F.abs("deviation") > threshold)

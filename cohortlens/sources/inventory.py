"""Source files of a repository and what they hold: discovery, counts and densities, technologies beyond a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.text import code_lines

# Folders that hold no sources of a project.
SKIPPED = ("build", ".gradle", ".git", "generated", "node_modules", "target")
# What is counted in each file, as patterns over its code.
COUNTS = {
    "controller_count": r"@(?:Rest)?Controller\b", "service_count": r"@Service\b", "entity_count": r"@Entity\b", "repository_count": r"interface\s+\w+\s+extends\s+\w*Repository\b", "endpoint_count": r"@(?:Get|Post|Put|Delete|Patch)Mapping\b",
    "fragment_count": r"class\s+\w+\s+extends\s+\w*Fragment\b", "activity_count": r"class\s+\w+\s+extends\s+\w*Activity\b", "viewmodel_count": r"class\s+\w+\s+extends\s+(?:Android)?ViewModel\b", "room_database_count": r"@Database\b",
    "custom_query_count": r"@Query\b", "scheduled_task_count": r"@Scheduled\b", "observe_call_count": r"\.observe\s*\(", "nav_dispatch_count": r"\.navigate\s*\(", "reactive_state_field_count": r"\b(?:Mutable)?(?:LiveData|StateFlow)\s*<",
}
DEPTH = {
    "fcm_send_call_count": r"FirebaseMessaging\b[^;]*\.send\s*\(", "specification_def_count": r"\bSpecification\s*<", "email_send_site_count": r"\b(?:mailSender|javaMailSender|emailSender)\s*\.\s*send\s*\(", "graphics_custom_draw_count": r"void\s+onDraw\s*\(|canvas\.draw\w+\s*\(",
    "av_usage_count": r"\bnew\s+(?:MediaPlayer|ExoPlayer|MediaRecorder)\b|ExoPlayer\.Builder\b", "okhttp_external_api_count": r"\bnew\s+OkHttpClient\b", "minio_object_io_site_count": r"\b\w*[mM]inio\w*\s*\.\s*(?:putObject|getObject)\s*\(",
}


def source_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = (".java", ".xml")) -> DataFrame:
    """path (below folder), repo (its first part), text of the source files below a folder, without those in build folders."""
    glob = "{" + ",".join(f"*{e}" for e in endings) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    path = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^.*?" + folder.rstrip("/").replace(".", r"\.") + "/", "")
    x = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("text")).withColumn("repo", F.substring_index("path", "/", 1))
    return x.filter(~F.concat(F.lit("/"), "path").rlike("/(?:" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))


def _code(files: DataFrame) -> DataFrame:
    lines = F.transform(code_lines(F.split("text", "\n"), F.col("path")), lambda x: x["line"])
    return files.withColumn("code_lines", lines).withColumn("code", F.array_join("code_lines", "\n"))


def inventory(files: DataFrame) -> DataFrame:
    """repo, key, value: counts over a repository's files outside tests, lines and statements of code, and densities with a denominator of 1 at least. files: repo, path, text."""
    x = _code(files.filter(~F.lower("path").contains("test")))
    every = {**COUNTS, **DEPTH}
    sums = x.groupBy("repo").agg(
        *[F.sum(F.regexp_count("code", F.lit(p))).cast("double").alias(k) for k, p in every.items()],
        F.sum(F.size("code_lines")).cast("double").alias("production_loc"), F.sum(F.regexp_count("code", F.lit(";"))).cast("double").alias("production_statement_count"),
    )
    per = lambda a, b: F.col(a) / F.greatest(b, F.lit(1.0))
    sums = sums.withColumns({"reactive_wiring_density": per("observe_call_count", F.col("fragment_count") + F.col("activity_count")), "nav_dispatch_density": per("nav_dispatch_count", F.col("fragment_count"))})
    keys = [c for c in sums.columns if c != "repo"]
    return sums.select("repo", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("m")).select("repo", "m.key", "m.value")


def class_averages(methods: DataFrame) -> DataFrame:
    """repo, key, value: mean complexity of the methods of controllers and of fragments, and mean statements of the endpoints of controllers; 0 without any. methods: repo, class_kind (controller, fragment or other), complexity, statements, endpoint (boolean; null: no)."""
    mean = lambda value, of: F.coalesce(F.avg(F.when(of, F.col(value))), F.lit(0.0)).cast("double")
    kind = F.col("class_kind")
    means = {
        "avg_cc_per_controller": mean("complexity", kind == "controller"),
        "avg_cc_per_fragment": mean("complexity", kind == "fragment"),
        "avg_statements_per_endpoint": mean("statements", (kind == "controller") & F.col("endpoint")),
    }
    x = methods.groupBy("repo").agg(*[v.alias(k) for k, v in means.items()])
    return x.unpivot("repo", list(means), "key", "value")


def new_dependencies(used: DataFrame, baseline: DataFrame) -> DataFrame:
    """repo, stack, coordinate of dependencies that the stack's baseline lacks."""
    return used.select("repo", "stack", "coordinate").distinct().join(baseline.select("stack", "coordinate").distinct(), ["stack", "coordinate"], "left_anti")


def extra_technologies(features: DataFrame, dependencies: DataFrame, corroborated: tuple[str, ...] = ("fcm", "email", "av")) -> DataFrame:
    """technology, category, source (ast, gradle or both), depth. A dependency of a category named that features show already only corroborates them; others count one each. features: technology, category, depth; dependencies: name (null: the coordinate's own), category, coordinate."""
    f = features.groupBy("technology", "category").agg(F.sum("depth").alias("depth"))
    d = dependencies.select(F.coalesce("name", "coordinate").alias("technology"), F.coalesce("category", F.lit("dependency")).alias("category"), "coordinate").distinct()
    proven = f.filter(F.col("category").isin(*corroborated)).select("category").distinct()
    both = d.join(proven, "category", "left_semi").select(F.col("category").alias("c2")).distinct()
    alone = d.join(proven, "category", "left_anti").groupBy("technology", "category").agg(F.count("*").cast("double").alias("n"))
    x = f.join(alone, ["technology", "category"], "full").join(both, F.col("category") == F.col("c2"), "left")
    source = F.when(F.col("depth").isNull(), "gradle").when(F.col("c2").isNotNull(), "both").otherwise("ast")
    return x.select("technology", "category", source.alias("source"), (F.coalesce("depth", F.lit(0.0)) + F.coalesce("n", F.lit(0.0))).alias("depth"))


def listed(text: Column) -> Column:
    """Lines of a list file: trimmed, without blank ones and # comments."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))

"""Signatures, steps of grades, paths and windows in their odd cases."""

import random

from pyspark.sql import functions as F

from cohortlens.functions import paths
from cohortlens.operators import project, relational, similarity
from cohortlens.sources import inventory


def test_windows_beyond_others(spark):
    rng = random.Random(3)
    windows = [(i, s, s + rng.choice([0, 1, 5, 40, 300])) for i, s in enumerate(rng.choices(range(400), k=300))]
    windows += [(900, 10, 5), (901, None, 7), (902, 3, None)]
    events = [(i, rng.randrange(-20, 800)) for i in range(500)] + [(999, None)]
    day = lambda c: F.timestamp_seconds(F.col(c) * 86400)
    w = spark.createDataFrame(windows, "id int, s int, e int").select("id", day("s").alias("s"), day("e").alias("e"))
    e = spark.createDataFrame(events, "k int, t int").select("k", day("t").alias("t"))
    got = {x.k: x.id for x in relational.contained(e, "t", w, "s", "e", 16).collect()}
    held = lambda t: [(s, e, i) for i, s, e in windows if None not in (s, e) and s <= t <= e]
    assert got == {k: min(held(t))[2] for k, t in events if t is not None and held(t)}


def test_relative_paths(spark):
    def plain(root, path):
        def parts(p):
            out = []
            for x in p.replace("\\", "/").split("/"):
                out = out[:-1] if x == ".." else out if x in ("", ".") else [*out, x]
            return out

        base, full = parts(root), parts(path if path[:1] in ("/", "\\") else f"{root}/{path}")
        return "/".join(full[len(base) :]) if full[: len(base)] == base else None

    rng = random.Random(5)
    some = lambda: "".join(rng.choice(["a", "b", "..", ".", "/", "/", "\\", "a.java"]) for _ in range(rng.randrange(0, 9)))
    rows = [(rng.choice(["/", "", "/a", "/a/b", "a/../b", "\\a"]), some()) for _ in range(400)]
    df = spark.createDataFrame(rows, "r string, p string").select("r", "p", paths.relative_path("r", "p").alias("x"))
    assert all(x.x == plain(x.r, x.p) for x in df.collect())
    nulls = spark.createDataFrame([(None, "a"), ("/a", None)], "r string, p string")
    assert [x[0] for x in nulls.select(paths.relative_path(F.col("r"), F.col("p"))).collect()] == [None, None]


def test_signatures(spark):
    links = spark.createDataFrame(
        [("p1", "o/spring-x", "TASK", "DONE"), ("p1", "o/spring-x", None, "DONE"), ("p2", None, "TASK", "DONE"), ("p3", "o/spring-x", "USER_STORY", "DONE"), ("p4", "o/spring-x", "TASK", None), (None, "o/x", "TASK", "DONE")],
        "pr string, repo string, type string, status string",
    )
    statements = spark.createDataFrame([("a/dto/X.java", "c1"), ("a/dto/X.java", "c1"), ("a/Y.java", "c1"), (None, "c1"), ("a/dto/X.java", None), ("a/ZService.java", "c2")], "path string, commit string")
    commits = spark.createDataFrame([("p1", "c1"), ("p1", "c2"), ("p2", "c1"), ("p9", "c1"), ("p1", None)], "pr string, sha string")
    lines = spark.createDataFrame([("p1", 70.0, 10.0, None), ("p1", 0.0, 20.0, None), ("p9", 1.0, 1.0, 1.0)], "pr string, lat double, ld double, ls double")
    survival = spark.createDataFrame([("p2", 3), ("p2", None)], "pr string, surviving int")
    got = {x.pr: x for x in similarity.pr_signatures(links, statements, commits, lines, survival).collect()}
    assert set(got) == {"p1", "p2"} and got["p1"].layer_counts == {"spring_dto_mapper": 2, "spring_service": 1} and got["p2"].layer_counts == {}
    assert (got["p1"].lat, got["p1"].ld, got["p1"].ls, got["p1"].surviving, got["p1"].action) == (70.0, 30.0, 0.0, None, "create")
    assert (got["p2"].lat, got["p2"].surviving, got["p2"].action) == (None, 3.0, None)
    assert similarity.pr_signatures(*[x.limit(0) for x in (links, statements, commits, lines, survival)]).collect() == []


def test_grade_steps(spark):
    p = spark.createDataFrame([("a", 8.0, 0.9, 1.0, 12.0), ("b", 0.0, 1.0, 1.0, 0.0)], "project string, work_base double, quality_multiplier double, ai_factor double, extra_tech double")
    s = spark.createDataFrame([("a", "x", 1.2, 0.3, 1), ("a", "y", None, None, None), ("b", "z", 9.0, 0.0, 0), ("c", "w", 1.0, 0.0, 0)], "project string, student string, share double, penalty double, criticals int")
    steps = project.grade_steps(p, s, 1.3)
    assert steps.count() == 2 * 6 + 3 * 5
    final = {(x.project, x.student): round(x.value, 2) for x in steps.filter("step = 'final'").collect()}
    assert final == {(x.project, x.student): x.student_final for x in project.final_grades(p, s, 1.3).collect()}
    assert {x.value for x in steps.filter("step = 'extra'").collect()} == {1.0, 0.0}
    got = {x.project: (x.students, x.charged) for x in project.charged_students(s).collect()}
    assert got == {"a": (2, 1), "b": (1, 0), "c": (1, 0), None: (4, 1)}
    assert [(x.students, x.share) for x in project.charged_students(s.limit(0)).collect()] in ([], [(0, 0.0)])


def test_class_averages(spark):
    m = spark.createDataFrame([("r", "controller", 3, 5, True), ("r", "controller", 1, 9, None), ("r", "fragment", None, 2, True), ("q", None, 4, 4, True)], "repo string, class_kind string, complexity int, statements int, endpoint boolean")
    got = {(x.repo, x.key): x.value for x in inventory.class_averages(m).collect()}
    assert got == {
        ("r", "avg_cc_per_controller"): 2.0, ("r", "avg_cc_per_fragment"): 0.0, ("r", "avg_statements_per_endpoint"): 5.0,
        ("q", "avg_cc_per_controller"): 0.0, ("q", "avg_cc_per_fragment"): 0.0, ("q", "avg_statements_per_endpoint"): 0.0,
    }


def test_no_result_of_a_report_holds_the_whole_run(spark):
    from cohortlens.sources import parsers

    text = '{"runs": [{"tool": {"driver": {"name": "t", "rules": [{"id": "a", "defaultConfiguration": {"level": "error"}}]}}, "results": [{"ruleId": "a"}, {"ruleIndex": 0, "level": "note"}]}]}'
    found = parsers.sarif(spark.createDataFrame([("b", text), ("bad", "{")], "batch string, text string"), "text")
    assert sorted((r.batch, r.tool, r.rule, r.severity) for r in found.collect()) == [("b", "t", "a", "CRITICAL"), ("b", "t", "a", "INFO")]
    last = found._jdf.queryExecution().optimizedPlan().toString()
    assert last.count("Generate explode") == 2 and "run#" not in last[: last.index("Generate explode")]


def test_diagnosed_rows_meet_by_a_hash_of_wide_keys(spark):
    from cohortlens.operators import axes

    key = "named_struct('a', id, 'b', cast(id as string)) as pr"
    prs = spark.range(3).selectExpr(key, "'r' as repo", "id as number", "5 as additions")
    lines = lambda most: spark.range(most).selectExpr(key, "id as lat", "id as lar", "id as ls")
    got = axes.line_diagnostics(prs, lines(2), lines(3))
    assert {r.pr.a: r.problem for r in got.collect()} == {0: "no_lines", 1: None, 2: "not_stored"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 4

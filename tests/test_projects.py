"""Lines, plans, peers, caches, quality, curriculum, inventory and project grades on small made frames."""

import json
import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import paths, scalar
from cohortlens.functions import text as T
from cohortlens.operators import detectors, incremental, lines, maintenance, patience, planning, project, quality, relational, similarity, stats
from cohortlens.sources import code, curriculum, inventory


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, want",
    [
        (None, 0.5), ("", 0.5), ("!!! ", 0.5), ("we gonna fix stuff", 0.0 + 0.10 * 0.0),
        ("Furthermore we ensure quality", 0.75), ("The file was changed perhaps", 0.5 * 0.75 + 0.10 * 1 + 0.05 * 1),
        ("word " * 40 + ".", 0.5 * 0.45 + 0.2 * 1.0),
    ],
)
def test_formality(spark, text, want):
    assert one(spark, text, T.formality) == pytest.approx(want)


@pytest.mark.parametrize(
    "title, generic, score",
    [
        (None, True, 0.0), ("  ", True, 0.0), ("short", True, 0.0), ("Merge branch main", True, 1.0), ("refactor", True, 0.0), ("feature/login form", True, 0.0), ("ABC-1234567", True, 0.0),
        ("A title of use", False, 1.0), ("A title of use that is longer", False, 1.5), ("A title of use that is much longer than thirty", False, 1.75), ("é" * 25, False, 2.0),
    ],
)
def test_titles(spark, title, generic, score):
    assert one(spark, title, T.is_generic_title) is generic and one(spark, title, T.title_score) == score


def test_bodies(spark):
    assert one(spark, "ab-1, cd-22;\n x-3", T.is_id_only) and not one(spark, "ab-1 and", T.is_id_only) and not one(spark, None, T.is_id_only)
    assert one(spark, "[p4d-194](https://a/b), [x-1](c)", T.is_link_only) and not one(spark, "[p4d-194](https://a/b) done", T.is_link_only)
    assert one(spark, "# Title\n\n# More of a heading", T.is_empty_description) and one(spark, None, T.is_empty_description)
    assert not one(spark, "# Title\nsome real text here", T.is_empty_description)
    assert one(spark, "x" * 60, T.description_score) == 1.0 and one(spark, "because we add a test for task 5, in order to verify", T.description_score) == 2.5
    assert one(spark, "add login", T.task_description_score) == 0.2 and one(spark, "implement the login screen", T.task_description_score) == pytest.approx(0.6)
    assert one(spark, "fix bug\n\nlong story", T.is_generic_message) and not one(spark, "fix the login bug", T.is_generic_message)


def test_title_words(spark):
    df = spark.createDataFrame([("Fix the Repository of users",), ("Nova pantalla de perfil",), (None,)], "t string")
    w = T.title_tokens(F.col("t"))
    got = df.select(w.alias("w"), T.is_fix_title(F.col("t")).alias("f"), T.action_tag(w).alias("a"), T.layer_tags(w, F.lit("spring")).alias("l")).collect()
    assert [(r.w, r.f, r.a, r.l) for r in got] == [(["fix", "repository", "users"], True, "modify", ["spring_repository"]), (["nova", "perfil"], False, "create", []), ([], False, "create", [])]


def test_code_lines_and_cosmetic_form(spark):
    java = ["int a; // x", "", "/* open", "inside", "end */", "b();", "// c", "* d", "/* e */", "f(); /* g"]
    xml = ["<a/>", "<!-- x", "y", "-->", "<b/>", "// kept"]
    df = spark.createDataFrame([("a/B.java", java), ("c.xml", xml), ("d.txt", ["// kept", " "]), ("e.java", None)], "p string, l array<string>")
    got = {r.p: [x.line for x in r.c] for r in df.select("p", T.code_lines(F.col("l"), F.col("p")).alias("c")).collect()}
    assert got == {"a/B.java": ["int a; // x", "b();", "f(); /* g"], "c.xml": ["<a/>", "<b/>", "// kept"], "d.txt": ["// kept"], "e.java": []}
    same = lambda a, b: one(spark, a, T.cosmetic_form) == one(spark, b, T.cosmetic_form)
    assert same('  foo("a",  1);', "bar('x' , 2L);") is False and same('foo("a", 1);', 'bar("b",  22);') and not same("a + b", "a - b")


@pytest.mark.parametrize("x, digits, want", [(0.91355, 4, 0.9135), (2.5, 0, 2.0), (-1.25, 1, -1.2), (float("nan"), 2, None)])
def test_round_half_even(spark, x, digits, want):
    got = one(spark, x, scalar.round_half_even(digits), "double")
    assert got == want or (want is None and (got is None or math.isnan(got)))


def test_scalars(spark):
    assert one(spark, -2.5, lambda v: scalar.round_half_away(v, 0), "double") == -3.0 and one(spark, 7.13, lambda v: scalar.round_half_away(v, 1, 0.25), "double") == 7.0
    assert [one(spark, v, lambda x: scalar.format_float(x, 2), "double") for v in (2.0, 2.126, None)] == ["2", "2.13", "None"]
    at = lambda s: one(spark, s, lambda x: F.unix_seconds(scalar.parse_iso(x)))
    assert at("2026-02-01T08:00Z") == at("2026-02-01T09:00:00+01:00") == at("2026-02-01T08:00:00.0Z") == 1769932800 and at("2026-02-01") is None and at("") is None and at(None) is None
    assert one(spark, "2026-07-01T10:05Z", scalar.local_time) == "1 July 2026, 12:05 CEST" and one(spark, "2026-01-31T10:05Z", scalar.local_time) == "31 January 2026, 11:05 CET" and one(spark, "soon", scalar.local_time) == "soon"
    assert one(spark, "1969-12-31T23:00Z", lambda x: scalar.day_offset(scalar.parse_iso(x), F.timestamp_seconds(F.lit(0)))) == -1
    ranks = lambda xs, p: one(spark, xs, lambda v: scalar.nearest_rank(v, p), "array<bigint>")
    assert [ranks([5, 1, 9, 3], p) for p in (25, 50, 95, 100)] == [1, 3, 9, 9] and ranks([], 50) == 0
    j = scalar.jittered({"a": 10.0, "b": 1.0}, "2026-01-01", 7)
    assert j == scalar.jittered({"b": 1.0, "a": 10.0}, "2026-01-01", 7) != scalar.jittered({"a": 10.0, "b": 1.0}, "2026-01-02", 7) and 9 <= j["a"] <= 11


def test_paths(spark):
    layer = lambda p, s: spark.createDataFrame([(p, s)], "p string, s string").select(paths.layer_of(F.col("p"), F.col("s"))).first()[0]
    assert layer("src/main/java/org/x/api/UserDto.java", "spring") == "spring_dto_mapper" and layer("src/main/java/org/x/api/PostsApi.java", "spring") == "spring_controller"
    assert layer("app/src/test/java/A.java", "spring") is None and layer("app/res/layout/main.xml", "android") == "android_layout" and layer("a/ui/HomeFragment.kt", "android") == "android_fragment"
    assert layer("a/b/Foo.java", None) is None and layer("a/res/values/x.xml", "android") is None
    rel = lambda r, p: spark.createDataFrame([(r, p)], "r string, p string").select(paths.relative_path("r", "p")).first()[0]
    assert [rel("/r/a", "/r/a/x/../b.java"), rel("/r/a", "/r/b/c"), rel("/r/a", "x/./y"), rel("/r/a", "../z"), rel(None, "x")] == ["b.java", None, "x/y", None, None]
    assert one(spark, "java.util.List", paths.package_of) == "java.util" and one(spark, "a.b.*", paths.package_of) == "a.b"
    assert one(spark, "my_type", paths.is_type_name_snake) and not one(spark, "MyType", paths.is_type_name_snake) and one(spark, "file:///a/b", paths.without_file_scheme) == "/a/b"


def test_line_metrics(spark):
    h = [
        ("p1", "o/r", "A.java", 0, ["int a = 1;", "old();"], ["int b = 2;", "// note", "", "kept();", "gone();"]),
        ("p1", "o/r", "B.xml", 1, ["<!-- x", "y -->"], ["<a/>"]),
        ("p2", "o/r", "A.java", 0, None, ["kept();", "kept();"]),
    ]
    hunks = spark.createDataFrame(h, "pr string, repo string, path string, hunk int, removed array<string>, added array<string>")
    head = lines.head_lines(spark.createDataFrame([("o/r", "A.java", "  kept();\n/* c */\n int b = 2;\n"), ("x/y", "A.java", "gone();")], "repo string, path string, text string"))
    got = {r.pr: r for r in lines.pr_line_metrics(hunks, head).collect()}
    assert tuple(got["p1"])[1:6] == (4, 3, 2, 1, 1) and got["p1"].cosmetic_report.startswith('1 cosmetic changes (25% of LAT). Examples:\n  "int a = 1;" -> "int b = 2;"')
    assert tuple(got["p2"])[1:] == (2, 2, 2, 0, 0, "")
    base = lines.base_commit(spark.createDataFrame([("a", "merge_base", "s1"), ("a", "root", "s2"), ("b", "merge_base", None), ("b", "parent", "s3"), ("c", "root", None)], "pr string, kind string, sha string"))
    assert sorted(map(tuple, base.collect())) == [("a", "s1", None), ("b", "s3", "base_fallback"), ("c", None, "no_base_candidate")]
    done = lines.unchanged_since(spark.createDataFrame([("a", "s2"), ("b", "s1")], "pr string, merge_sha string"), spark.createDataFrame([("a", 1, "s1"), ("a", 2, "s2"), ("b", 1, "s1"), ("b", 3, "s9")], "pr string, at int, sha string"))
    assert [r.pr for r in done.collect()] == ["a"]
    diff = patience.template_diff(spark.createDataFrame([("a", "1\n2\n3"), ("b", "x"), ("gone", "y")], "path string, text string"), spark.createDataFrame([("a", "1\n9\n3\n4"), ("b", "x"), ("c", "n\nm")], "path string, text string"))
    assert sorted(map(tuple, diff.collect())) == [("a", "modified", 2, [2, 4], 4), ("c", "added", 2, [1, 2], 2), ("gone", "template_only", 0, [], 0)]


def test_survival_collapses_equal_tuples(spark):
    prs = spark.createDataFrame([("a", 10, 5), ("b", 10, 5), ("c", 4, 4), ("d", 0, 0)], "pr string, added_raw int, surviving_raw int")
    who = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "pr string, member string")
    points = spark.createDataFrame([("x", 3), ("y", None)], "member string, points int")
    got = {r.member: tuple(r)[1:] for r in lines.student_survival(prs, who, points).collect()}
    assert got == {"x": (14, 9, 9 / 14, 3.0), "y": (0, 0, 1.0, None)}


def test_peer_groups_back_off(spark):
    keys = [("p", i, 1, "s", "l1", "create") for i in range(4)] + [("p", 10 + i, 1, "s", "l2", "create" if i % 2 else "modify") for i in range(4)] + [("p", 20, 1, "s", "l9", "create"), ("p", 20, 2, "s", "l1", "create"), ("p", 30, 4, "s", "l1", "create"), ("q", 1, 1, "s", "l1", "create")]
    got = similarity.peer_groups(spark.createDataFrame(keys, "project string, task int, place int, stack string, layer string, action string"), 4, 3)
    groups = {}
    for r in got.collect():
        groups.setdefault((r.layer, r.action), set()).add(r.task)
    # Task 20's own layer is rare: its group would be (any, create), where it is alone in the end.
    assert groups == {("l1", "create"): {0, 1, 2, 3, 20}, ("l2", "*"): {10, 11, 12, 13}}
    members = spark.createDataFrame([("p", "s", "l", "a", t, p, s) for t, p, s in [(1, 1.0, 10.0), (2, 1.0, 11.0), (3, 2.0, 20.0), (4, 1.0, 90.0), (5, 0.0, 5.0), (6, None, None)]], "project string, stack string, layer string, action string, task int, points double, statements double")
    found = {r.task: r for r in similarity.group_outliers(members).collect()}
    assert [t for t, r in found.items() if r.outlier] == [4] and found[5].z is None and found[1].representative == 4 and found[4].reason.startswith("stmts/pt=90 vs median=10.50 (z=+")


def test_wrong_answers_of_before(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("a", "x", 3.0), ("a", "x", 40.0), (None, "y", 7.0)], "g string, h string, v double")
    got = stats.backoff_outliers(df, [["g", "h"], ["g"], []], "v", 4).collect()
    assert len(got) == 5 and {r.level for r in got if r.g} == {0} and [r.level for r in got if r.g is None] == [2]
    none = stats.backoff_outliers(df, [["g"]], "v", 9)
    assert none.count() == 5 and none.filter("level is not null or z is not null").count() == 0
    t = {"p": spark.createDataFrame([(1, None), (2, "b")], "id int, n string"), "c": spark.createDataFrame([(1, None, 5), (2, "z", 6)], "p int, t string, k int")}
    left = maintenance.purge(t, [("c", "p", "p", "id")], "p", t["p"].filter("id = 1"))
    assert [r.id for r in left["p"].collect()] == [2] and [r.k for r in left["c"].collect()] == [6]
    assert sorted(map(tuple, maintenance.doomed_counts(t, left).collect())) == [("c", 2, 1), ("p", 2, 1)]
    a, b = (spark.createDataFrame([(None, x), (1, 5)], "k int, v int") for x in (3, 4))
    assert [tuple(r) for r in maintenance.diff(a, b, ["k"]).collect()] == [(None, "DIFF")]
    assert all(maintenance.upsert(a, b, ["k"], p).count() == 2 for p in ("replace", "ignore", "coalesce"))
    seq = spark.createDataFrame([("m", 1, 10), ("m", 2, 20), ("m", 2, 30), ("m", 3, 40)], "m string, at int, v int")
    assert sorted((r.at, r.v, r.previous) for r in relational.previous(seq, ["m"], "at", "v").collect()) == [(1, 10, None), (2, 20, 10), (2, 30, 10), (3, 40, 30)]
    two = spark.createDataFrame([("up", 1, 1.0), ("up", 2, 9.0), ("down", 1, 9.0), ("down", 2, 1.0), ("one", 1, 4.0), ("same", 1, 4.0), ("same", 2, 4.0)], "m string, at int, v double")
    assert {r.m: r["class"] for r in stats.trajectory(two, ["m"], "at", "v").collect()} == {"up": "growing", "down": "declining", "one": "insufficient_data", "same": "steady"}


@pytest.mark.parametrize(
    "body, depth, cost",
    [
        ("{ if (a && b && c) x(); }", 1, 3), ("{ if (a) b(); else c(); }", 1, 1), ("{ if (a) b(); else if (c) d(); else e(); }", 2, 3), ("{ switch (x) { case 1: if (a) b(); break; default: c(); } }", 1, 2),
        ("{ for (int i = 0; i < n; i++) while (a) { if (b) c(); } }", 3, 6), ("{ x = a ? b : c ? d : e; }", 0, 2), ("{ list.forEach(y -> { if (y) z(); }); }", 2, 2), ("{ run(() -> a || b); }", 1, 1),
        ("{ try { a(); } catch (E e) { if (b) c(); } finally { d(); } }", 2, 3), ("{ do { a(); } while (b || c); }", 1, 2), ("{ Map<?, ? extends X> m = new HashMap<>(); }", 0, 0),
        ("{ return switch (x) { case A -> 1; default -> b ? 2 : 3; }; }", 0, 2), ("{ f(new X() { public void g() { if (a) b(); } }); }", 1, 1), ("{ if (a) ", 1, 1), ("} ) ]", 0, 0),
    ],
)
def test_nesting(body, depth, cost):
    assert code.nesting(code.scan(body)) == (depth, cost)


def test_hotspots(spark):
    rows = [("s", 0.8, "R1", "k", "a", "WARNING"), ("s", 0.8, "R1", "k", "a", "CRITICAL"), ("s", 1.0, "R2", "k", "a", "INFO"), ("t", 1.0, "R2", "k", "b", "INFO"), ("u", 1.0, "OFF", "k", "b", "CRITICAL")]
    shares = spark.createDataFrame(rows, "author string, share double, rule_name string, rule_kind string, file_path string, severity string")
    got = {r.author: (r.severity, json.loads(r.details)) for r in detectors.architecture_hotspots(shares, 0.0, {"R2": 0.25, "OFF": 0.0}).collect()}
    assert set(got) == {"s", "t"} and got["s"][0] == "CRITICAL" and got["s"][1]["weighted"] == 1.025 and got["t"] [0] == "INFO"
    assert [o["rule_name"] for o in got["s"][1]["offenders"]] == ["R1", "R2"] and got["s"][1]["offenders"][0]["severity"] == "CRITICAL"
    c = shares.withColumns({"rule_key": F.col("rule_name"), "method_name": F.lit("m"), "measured_value": F.when(F.col("severity") == "WARNING", 9.0).otherwise(1.0)})
    cx = {r.author: (r.severity, json.loads(r.details)) for r in detectors.complexity_hotspots(c, 0.5, 5.0).collect()}
    assert cx["s"][0] == "CRITICAL" and cx["s"][1]["score"] == 1.0 and cx["s"][1]["offenders"][0]["measured_value"] == 9.0 and "t" not in cx
    d = spark.createDataFrame([("COMPLEXITY_HOTSPOT", '{"score": 1.5}'), ("ARCHITECTURE_HOTSPOT", '{"weighted": 2.25}'), ("OTHER", '{"score": 9}'), ("STATIC_ANALYSIS_HOTSPOT", "broken")], "f string, d string")
    assert [r[0] for r in d.select(detectors.hotspot_blame(F.col("f"), F.col("d"))).collect()] == [1.5, 2.25, 0.0, 0.0]


def test_dispatch_replaces_a_scope(spark):
    shape = "sprint int, flag string, who string"
    old = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (2, "B", "z")], shape)
    found = spark.createDataFrame([(2, "A", "new")], shape)
    scope = spark.createDataFrame([(2,)], "sprint int")
    assert sorted(map(tuple, detectors.dispatch(old, scope, ["sprint"], [found]).collect())) == [(1, "A", "x"), (2, "A", "new")]
    assert sorted(map(tuple, detectors.redetect(old, scope, ["sprint"], ["A"], [found]).collect())) == [(1, "A", "x"), (2, "A", "new"), (2, "B", "z")]


def test_plans_and_triage(spark):
    tasks = spark.createDataFrame([("p", 1, 5, True, "TASK"), ("p", 1, None, False, "BUG"), ("p", 1, 9, True, "USER_STORY"), ("p", 1, 9, True, None), ("p", 2, 10, True, "TASK"), ("p", 3, 4, False, "TASK")], "project string, sprint int, points int, done boolean, type string")
    got = {r.sprint: tuple(r)[2:] for r in planning.planning_quality(tasks).collect()}
    assert got == {1: (5, 5, 1.0, 0.0, 0.5, pytest.approx(1 / 3)), 2: (10, 10, 1.0, 0.0, 0.0, pytest.approx(1 / 3)), 3: (4, 0, 0.0, 1.0, 0.0, pytest.approx(1 / 3))}
    with pytest.raises(ValueError):
        planning.weights_valid({"a": 0.5, "b": 0.4})
    rows = [(["EMPTY_BODY", "GENERIC_TITLE"], 1.0, 1.0, 2.0), (["GENERIC_TITLE"], None, None, None), (["GENERIC_TITLE"], 1.0, 0.5, 1.5), ([], 1.0, 1.0, float("nan")), ([], 1.0, 2.0, 3.0), ([], 1.0, 0.0, 1.0), ([], 1.0, 0.0, 1.9)]
    df = spark.createDataFrame(rows, "f array<string>, t double, d double, s double")
    assert [r[0] for r in df.select(planning.triage(F.col("f"), F.col("t"), F.col("d"), F.col("s"))).collect()] == ["short:EMPTY_BODY", "judge", "short:GENERIC_TITLE", "judge", "judge", "snap", "judge"]


def test_caches(spark):
    cache = spark.createDataFrame([("a", "x", "e1", "old"), ("b", "x", "e2", "keep")], "key string, endpoint string, etag string, body string")
    ans = spark.createDataFrame([("a", "x", 200, "e9", "new"), ("b", "x", 304, None, None), ("c", "x", 304, None, None)], "key string, endpoint string, status int, etag string, body string")
    assert sorted(map(tuple, incremental.merge_etags(cache, ans).collect())) == [("a", "x", "e9", "new"), ("b", "x", "e2", "keep")]
    assert sorted(map(tuple, incremental.conditional_bodies(cache, ans).collect()), key=str) == [("a", "x", "new", True), ("b", "x", "keep", False), ("c", "x", None, False)]
    live = spark.createDataFrame([("import", "a", 1), ("import", "b", 3), ("x", "c", None)], "category string, value string, taught int")
    snap = spark.createDataFrame([], "sprint bigint, category string, value string")
    frozen = incremental.freeze(snap, live, 7, 2)
    assert sorted((r.value) for r in frozen.collect()) == ["a", "c"] and incremental.freeze(frozen, live, 7, 9).count() == 2
    assert sorted(r.value for r in incremental.allowed_concepts(frozen, live, 7, 9).collect()) == ["a", "c"] and incremental.allowed_concepts(frozen, live, 8, 9).count() == 3
    scores = spark.createDataFrame([("a", 1, 0.0, None), ("b", 1, 0.0, 80), ("c", 1, 0.0, 5), ("c", 1, 1.0, 5)], "pr string, sprint int, score double, scored_length int")
    prs = spark.createDataFrame([(p, "x" * 60) for p in "abc"], "pr string, body string")
    assert sorted(r.pr for r in incremental.fresh_scores(scores, prs).collect()) == ["b", "c"]


def test_quality(spark):
    src = "class A {\n void f() {\n  try { x(); } catch (Exception e) { }\n  y = new UserService(); // new X()\n  String s = \"LocalDate.now()\";\n  z(LocalDate.now());\n }\n}"
    f = quality.testability_findings(spark.createDataFrame([("A.java", src)], "path string, text string"))
    assert {(3, "broad_catch"), (4, "inline_collaborator"), (6, "non_deterministic")} <= {(r.line, r.rule) for r in f.collect()}
    c = quality.debt_comments(spark.createDataFrame([("a", "// a stub, TODO"), ("b", "// stub"), ("c", "// fine"), ("d", None), ("e", "known  issue")], "file string, text string"))
    assert sorted((r.file, r.category, r.keyword) for r in c.collect()) == [("a", "design", "TODO"), ("b", "requirement", "stub"), ("e", "defect", "known  issue")]
    sev = spark.createDataFrame([("pmd", "error", None), ("pmd", "note", "9.1"), ("pmd", "error", "low"), ("spotbugs", "warning", "9.9"), ("x", None, None)], "t string, l string, d string")
    assert [r[0] for r in sev.select(quality.sarif_severity(F.col("t"), F.col("l"), F.col("d"))).collect()] == ["CRITICAL", "CRITICAL", "INFO", "WARNING", "WARNING"]
    x = quality.with_attributions(spark.createDataFrame([(1,), (2,)], "finding int"), spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9)], "finding int, author string, weight double"))
    assert {r.finding: [a.author for a in r.authors] for r in x.collect()} == {1: ["c", "a", "b"], 2: []}


def test_curriculum(spark):
    slide = "Use \\texttt{LiveData} and \\texttt{Java.util}. The Observer pattern. @Entity \\begin{lstlisting}[x]\nimport java.util.*;\n@Query a.find(); b.of(1);\n\\end{lstlisting}"
    slides = spark.createDataFrame([("s/01_intro.tex", "Nothing about Room"), ("s/b.tex", slide), ("s/c.tex", "Room and @Entity")], "path string, text string")
    got = {(r.category, r.value): (r.path, r.sprint) for r in curriculum.taught(slides, 5).collect()}
    assert got[("framework_feature", "Room")] == ("s/01_intro.tex", 1) and got[("import", "java.util.*")] == ("s/b.tex", 2) and got[("annotation", "Query")][0] == "s/b.tex" and ("api_method", "find") in got and ("api_method", "of") not in got
    assert ("import", "Java.util") in got and ("pattern", "Observer") in got and ("framework_feature", "LiveData") in got
    src = "import java.util.List;\nimport org.junit.Test;\nimport x.y.Z;\nimport java.lang.Math;\n@Override @Entity @Weird\nclass AFactory extends Base implements I, J {\n s.stream().map(); }\n"
    allowed = spark.createDataFrame([("import", "java.util.*"), ("annotation", "Entity")], "category string, value string")
    bad = {(r.kind, r.severity, r.value): r.line for r in curriculum.beyond_curriculum(spark.createDataFrame([("A.java", src)], "path string, text string"), allowed).collect()}
    assert bad[("test_framework", "HIGH", "org.junit.Test")] == 2 and bad[("advanced_java", "HIGH", "stream")] == 7 and bad[("unlisted_import", "LOW", "x.y.Z")] == 3 and bad[("unlisted_annotation", "LOW", "Weird")] == 5
    assert ("unlisted_import", "LOW", "java.util.List") not in bad and ("unlisted_import", "LOW", "java.lang.Math") not in bad and ("unlisted_annotation", "LOW", "Override") not in bad
    more = "import org.junitx.A;\nimport dagger;\nimport a.CompletableFuture;\nclass A extends MyError {\nclass B extends ListAdapter implements UserFactory, Ok {\n x.toMono(); y.getInstance(); @Singleton z.streams();"
    told = {(r.kind, r.value) for r in curriculum.beyond_curriculum(spark.createDataFrame([("B.java", more)], "path string, text string"), allowed).filter("severity != 'LOW'").collect()}
    assert told == {("dependency_injection", "dagger"), ("advanced_java", "a.CompletableFuture"), ("error_handling_sophistication", "MyError"), ("design_patterns", "ListAdapter"), ("design_patterns", "UserFactory"), ("reactive", "toMono"), ("design_patterns", "getInstance"), ("dependency_injection", "Singleton")}
    score = curriculum.curriculum_score(spark.createDataFrame([("a", "HIGH"), ("a", "LOW"), *[("b", "HIGH")] * 9], "path string, severity string"))
    assert {r.path: r.score for r in score.collect()} == {"a": pytest.approx(0.3), "b": 1.0}


def test_inventory(spark, tmp_path):
    (tmp_path / "r1/src/build").mkdir(parents=True)
    (tmp_path / "r1/src/A.java").write_text("@RestController\nclass A { @GetMapping void f() { a(); } // @Entity\n}")
    (tmp_path / "r1/src/build/B.java").write_text("@Entity class B {}")
    (tmp_path / "r1/src/H.java").write_text("class H extends BaseFragment { void o() { x.observe(a); y.navigate(b); } }")
    (tmp_path / "r1/notes.txt").write_text("no")
    files = inventory.source_files(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["r1/src/A.java", "r1/src/H.java"]
    m = {r.key: r.value for r in inventory.inventory(files).collect()}
    assert (m["controller_count"], m["endpoint_count"], m["fragment_count"], m["reactive_wiring_density"], m["nav_dispatch_density"], m["production_loc"]) == (1, 1, 1, 1, 1, 4)
    f = spark.createDataFrame([("push", "fcm", 2.0)], "technology string, category string, depth double")
    d = spark.createDataFrame([("firebase", "fcm", "g:a"), (None, None, "x:y"), ("maps", "geo", "m:n"), ("maps", "geo", "m:o")], "name string, category string, coordinate string")
    assert sorted(map(tuple, inventory.extra_technologies(f, d).collect())) == [("maps", "geo", "gradle", 2.0), ("push", "fcm", "both", 2.0), ("x:y", "dependency", "gradle", 1.0)]
    assert one(spark, "a\n # c\n\n b ", inventory.listed) == ["a", "b"]


def test_grade_of_the_worked_example(spark):
    p = spark.createDataFrame([(1, 11.0445, 1.0, 0.58, 0.0)], "project int, work_base double, quality_multiplier double, ai_factor double, extra_tech double")
    s = spark.createDataFrame([(1, "a", 1.0, None, None), (1, "b", 0.0, 0.5, 1)], "project int, student string, share double, penalty double, criticals int")
    got = {r.student: r for r in project.final_grades(p, s, 2.4921).collect()}
    assert got["a"].project_final == 3.30 and got["a"].student_final == 3.30 and got["b"].student_final == 0.0
    r = spark.createDataFrame([(5.1, False, 0), (8.0, True, 0), (8.0, False, 2), (8.0, False, None)], "g double, m boolean, k int")
    assert [x[0] for x in r.select(project.review_route(F.col("g"), F.col("m"), F.col("k"))).collect()] == ["manual", "block", "manual", "release"]


def test_projects_without_code_or_measures(spark):
    m = spark.createDataFrame([(1, "o/android-a", "fragment_count", 3.0), (1, "o/android-a", "production_loc", 100.0), (2, "o/spring-b", "entity_count", 5.0), (3, "o/spring-c", "production_statement_count", 10.0)], "project int, repo string, key string, value double")
    p = spark.createDataFrame([(1, None, None), (2, 95.0, 0.5), (3, 98.0, 0.0), (4, 98.0, 0.0)], "project int, maintainability double, mutation double")
    got = {r.project: r for r in project.project_axes(p, m, project.cohort_bounds(m), {}).collect()}
    assert got[1].quality is None and got[1].quality_multiplier == 1.0 and got[1].size == 5.0 and got[1].complexity is None
    assert (got[2].quality_multiplier, got[2].work_base, got[4].quality_multiplier) == (0.0, 0.0, 0.0) and got[3].quality == 10.0 and got[3].size == 5.0


def test_files(spark, tmp_path):
    import io
    import zipfile

    from cohortlens.operators import sinks

    rows = [("Team One", 7.5, "ann", 8.0, [("CRITICAL", "X|Y")]), ("Team One", 7.5, "bob", 8.0, []), ("Team One", 7.5, "cy", None, None), ("B&B", None, "dee", 3.25, [("INFO", "Z"), ("WARNING", "A")])]
    df = spark.createDataFrame(rows, "project string, project_final double, student string, student_final double, flags array<struct<severity:string,flag:string>>")
    files = sinks.grade_files(df)
    names = sinks.save_files(files, str(tmp_path))
    assert sorted(n.rsplit("/", 1)[1] for n in names) == ["b-b.md", "b-b.xlsx", "team-one.md", "team-one.xlsx"]
    text = (tmp_path / "team-one.md").read_text()
    assert "| 1 | ann | 8.00 |\n| 1 | bob | 8.00 |\n| – | cy | – |" in text and "| ann | CRITICAL | X\\|Y |" in text
    assert (tmp_path / "b-b.md").read_text().index("| dee | WARNING") < (tmp_path / "b-b.md").read_text().index("| dee | INFO")
    with zipfile.ZipFile(io.BytesIO((tmp_path / "team-one.xlsx").read_bytes())) as z:
        assert z.testzip() is None and '<c r="B2"><v>8.0</v></c>' in z.read("xl/worksheets/sheet1.xml").decode() and "X|Y" in z.read("xl/worksheets/sheet2.xml").decode()
    assert sinks.workbook({"a/b" * 20: (["h"], [(True,), (None,)])}) == sinks.workbook({"a/b" * 20: (["h"], [(True,), (None,)])})
    svg = sinks.stacked_bars("T <x>", [("a", {"p": 1.0, "q": 3.0}), ("b", {})], {"p": "#123"})
    assert "T &lt;x&gt;" in svg and svg.count("<rect") == 2 and 'fill="#888"' in svg
    assert sinks._column(0) == "A" and sinks._column(27) == "AB"
    t = spark.createDataFrame([("p", 1), ("q", 2)], "project string, v int")
    sinks.save_tables({"x": t}, str(tmp_path / "out"), "project")
    sinks.save_tables({"x": t.filter("v = 2").withColumn("v", F.lit(9))}, str(tmp_path / "out"), "project")
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out/x")).select("project", "v").collect()) == [("p", 1), ("q", 9)]


def test_lines_are_trimmed_once(spark):
    df = spark.createDataFrame([("A.java", ["\t a; \x0b", " \r", "/* x", "y */", "b;"])], "p string, l array<string>").select(T.code_lines(F.col("l"), F.col("p")).alias("c"))
    assert [tuple(x) for x in df.first().c] == [(0, "a;"), (4, "b;")]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") + plan.count("trim(") == 1


def test_files_are_searched_once(spark):
    made = spark.sparkContext.accumulator(0)

    def text(path):
        made.add(1)
        return "import x.y.Z;\n@Mock a.getInstance();\nimport a.B;\nimport x.y.Z;"

    files = spark.range(3).select(F.format_string("p%d", "id").alias("path")).withColumn("text", F.udf(text)("path"))
    allowed = spark.createDataFrame([("import", "a.*"), ("annotation", "Entity")], "category string, value string")
    got = sorted(map(tuple, curriculum.beyond_curriculum(files, allowed).filter("path = 'p1'").collect()))
    assert got == [("p1", "design_patterns", "MEDIUM", "getInstance", 2), ("p1", "test_framework", "HIGH", "Mock", 2), ("p1", "unlisted_annotation", "LOW", "Mock", 2), ("p1", "unlisted_import", "LOW", "x.y.Z", 1)]
    assert made.value == 3

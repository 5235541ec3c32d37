"""Detectors and report datasets on small hand-made frames."""

import datetime as dt
import json
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from cohortlens.functions import text as T
from cohortlens.operators import detectors, relational, reports, stats


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


MEMBER = "member string, team int, prs int, points double, lines double, surviving double, normalized double, small_prs int, failed int, code double, task double, composite double"


def test_member_flags(spark):
    df = spark.createDataFrame([
        ("a", 1, 3, 9.0, 10.0, 5.0, 9.0, 3, 2, 0.05, 0.9, 0.05),
        ("b", 1, 1, 1.0, 90.0, 90.0, 90.0, 0, 0, 0.9, 0.1, 0.5),
        ("c", 1, 0, 0.0, 0.0, None, None, 0, 0, 0.0, 0.0, 0.15),
        ("alone", 2, 1, 0.0, 0.0, 0.0, 0.0, 0, 0, None, None, None),
    ], MEMBER)
    got = rows(detectors.member_flags(df), "member", "flag", "severity")
    assert got == [
        ("a", "CARRYING_TEAM", "WARNING"), ("a", "GHOST_CONTRIBUTOR", "WARNING"), ("a", "HIGH_COMPILE_FAILURE_RATE", "WARNING"), ("a", "LOW_COMPOSITE_SCORE", "CRITICAL"),
        ("a", "MICRO_PRS", "INFO"), ("a", "POINT_CODE_MISMATCH", "INFO"), ("a", "RAW_NORMALIZED_DIVERGENCE", "INFO"),
        ("b", "HIDDEN_CONTRIBUTOR", "INFO"), ("b", "POINT_CODE_MISMATCH", "INFO"),
        ("c", "LOW_COMPOSITE_SCORE", "WARNING"), ("c", "ZERO_TASKS", "CRITICAL"),
    ]
    assert detectors.member_flags(df.limit(0)).count() == 0


def test_pr_flags(spark):
    df = spark.createDataFrame([
        (1, "a", 1, 300.0, 0.0, 300.0, 300.0, True, True), (2, "a", 2, 40.0, 38.0, 10.0, 70.0, True, True), (3, None, 2, 0.0, 0.0, 0.0, 0.0, False, True), (4, "b", 2, 5.0, 0.0, 5.0, 5.0, False, False), (5, "b", None, None, None, None, None, None, None),
    ], "pr int, author string, commits int, additions double, deletions double, surviving double, normalized double, compiles boolean, merged boolean")
    assert rows(detectors.pr_flags(df), "pr", "flag") == [(1, "SINGLE_COMMIT_DUMP"), (2, "BULK_RENAME_PR"), (2, "COSMETIC_HEAVY_PR"), (3, "PR_DOES_NOT_COMPILE")]


def test_logins(spark):
    prs = spark.createDataFrame([(1, "Ann"), (2, None)], "pr int, author string")
    commits = spark.createDataFrame([(1, "ann"), (1, "BOB"), (1, "bob"), (2, "cid"), (1, None)], "pr int, login string")
    assert rows(detectors.author_mismatch(prs, commits), "pr", "n_others", "others") == [(1, 1, ["bob"]), (2, 1, ["cid"])]
    roles = commits.withColumn("role", F.lit("author"))
    assert rows(detectors.unknown_contributors(roles, spark.createDataFrame([("ANN",)], "value string")), "login", "n", "roles") == [("bob", 2, "author"), ("cid", 1, "author")]


def test_undeclared_task_inherits_from_parent(spark):
    tasks = spark.createDataFrame([(1, None, "a"), (2, 1, "a"), (3, None, "b"), (4, 9, "b")], "task int, parent int, assignee string")
    assert rows(detectors.undeclared(tasks, spark.createDataFrame([(1,)], "task int")), "assignee", "n") == [("b", 2)]


def test_shares_and_hotspots(spark):
    f = spark.createDataFrame([("A.java", "r1", 1, 3), ("A.java", "r2", 9, 9)], "file string, finding string, start int, end int")
    b = spark.createDataFrame([("A.java", 1, "x"), ("A.java", 2, "x"), ("A.java", 3, "y"), ("A.java", 4, "y")], "file string, line int, author string")
    got = detectors.attribute_findings(f, b)
    assert [(a, round(s, 4)) for a, s in rows(got, "author", "share")] == [("x", 0.6667), ("y", 0.3333)]
    twice = got.unionByName(got).withColumn("rule", F.col("finding"))
    found = detectors.hotspots(twice, ["rule", "file"], F.lit("CRITICAL"), F.lit(3.0))
    assert [(a, round(w, 4), worst, len(o)) for a, w, worst, o in rows(found, "author", "weighted", "worst", "offenders")] == [("x", 3.0, "CRITICAL", 1), ("y", 2.0, "CRITICAL", 1)]


def test_layers(spark):
    imports = spark.createDataFrame([("V", "app.ui", "app.db.dao"), ("V", "app.ui.view", "app.model"), ("D", "app.db", "app.model"), ("M", "app.model", "java.util"), ("X", "application.ui", "app.db"), ("N", None, "app.db")], "file string, package string, target string")
    layers = spark.createDataFrame([("ui", "app.ui"), ("data", "app.db"), ("model", "app.model")], "layer string, prefix string")
    allowed = spark.createDataFrame([("ui", "model"), ("data", "model")], "layer string, may string")
    assert rows(detectors.layer_violations(imports, layers, allowed), "file", "source", "used") == [("V", "ui", "data")]


def test_rewrites_and_declining(spark):
    cols = "file string, position int, raw string, normalized string, author string"
    old = spark.createDataFrame([("f", 1, "r1", "n", "x"), ("f", 2, "r2", "n", "x"), ("f", 3, "r3", "n", "y")], cols)
    new = spark.createDataFrame([("f", 1, "q1", "n", "y"), ("f", 2, "r2", "n", "y"), ("f", 3, "q", "n", "y")], cols)
    assert rows(detectors.rewrites(old, new), "victim", "actor", "n", "file") == [("x", "y", 1, "f")]
    s = spark.createDataFrame([("m", p, v) for p, v in ((1, 0.9), (1, 0.9), (1, 0.9), (2, 0.1), (2, 0.1), (2, 0.1), (3, 0.0))], "member string, period int, score double")
    assert [(m, p, round(d, 3)) for m, p, d in rows(detectors.declining(s), "member", "period", "delta")] == [("m", 2, -0.8)]


def test_reports(spark):
    roster = spark.createDataFrame([("a", "A"), ("b", None)], "k string, name string")
    part = spark.createDataFrame([("a", 3)], "k string, n int")
    assert rows(reports.summary(roster, "k", [part]).select("k", "n"), "k", "n") == [("a", 3), ("b", 0)]
    t = dt.datetime(2026, 2, 1, 8)
    c = spark.createDataFrame([("p", t, 150), ("p", t + dt.timedelta(minutes=10), 20), ("q", t, 5)], "k string, at timestamp, n int")
    got = {r["k"]: r for r in reports.commit_rhythm(c, "k", "at", "n").collect()}
    assert (got["p"]["span_minutes"], got["p"]["size_per_minute"], got["p"]["fixup"]) == (10.0, 17.0, True)
    assert (got["q"]["size_per_minute"], got["q"]["longest_gap_minutes"], got["q"]["fixup"]) == (None, 0.0, False)
    v = reports.version_diff(spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, c string"), spark.createDataFrame([(1, "y"), (2, None), (4, "w")], "k int, c string"), "k", "c")
    assert rows(v, "k", "status") == [(1, "modified"), (2, "unchanged"), (3, "removed"), (4, "added")]


def test_p_values(spark):
    # Two-sided Student t: (t, degrees of freedom, p) of printed tables; R^2 = t^2 / (t^2 + df).
    known = [(2.228, 10, 0.05), (12.706, 1, 0.05), (1.960, 100000, 0.05), (3.169, 10, 0.01), (0.0, 5, 1.0)]
    df = spark.createDataFrame([(i, t * t / (t * t + d), d + 2) for i, (t, d, _) in enumerate(known)] + [(9, None, 9), (10, 0.5, 2), (11, 1.0, 5)], "i int, r2 double, n long")
    got = {r["i"]: r["p"] for r in df.select("i", stats.slope_p_value("r2", "n").alias("p")).collect()}
    assert all(abs(got[i] - p) < 2e-4 for i, (_, _, p) in enumerate(known))
    # Equal values (no R^2), two points and a perfect fit.
    assert all(got[i] == 0 for i in (9, 10, 11))


def test_gamma_and_t(spark):
    x = [0.01, 0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 12345.5, 1e7]
    got = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(stats.log_gamma(F.col("x")).alias("y")).collect()]
    assert np.allclose(got, [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    cases = [(1.0, 1.0, 0.5), (-2.0, 4.0, 0.116117), (0.5, 1e6, 0.617075), (30.0, 9.0, 2.4e-10), (float("inf"), 3.0, None), (1.0, 0.0, None)]
    p = [r.p for r in spark.createDataFrame([(t, d) for t, d, _ in cases], "t double, d double").select(stats.t_p_value(F.col("t"), F.col("d")).alias("p")).collect()]
    assert all(math.isnan(v) if want is None else abs(v - want) < 2e-6 for v, (_, _, want) in zip(p, cases))


def test_positions_of_skewed_groups(spark):
    rng = np.random.default_rng(2)
    rows_ = [("hot", float(v)) for v in rng.integers(0, 500, 4000)] + [("few", 1.0), ("few", 1.0), ("few", 3.0), (None, 2.0), ("hot", 1e300), ("none", None)]
    df = spark.createDataFrame(rows_, "g string, v double").repartition(7)
    want = {}
    for g in ("hot", "few", None):
        v = sorted(x for k, x in rows_ if k == g)
        want |= {(g, x): (v.count(x), sum(y < x for y in set(v) for _ in range(v.count(y))) if len(v) < 9 else int(np.searchsorted(v, x)), len(v)) for x in set(v)}
    got = {(r.g, r.x): (r.c, r.before, r.n) for r in stats.positions(df, ["g"], "v").collect()}
    assert got == want
    ranks = {r.v: r.k for r in stats.average_ranks(df.filter("g = 'few'"), "v", "k").collect()}
    assert ranks == {1.0: 1.5, 3.0: 3.0}


def test_trajectory(spark):
    series = {"up": [1.0, 2.0, 3.1, 4.0], "down": [4.0, 3.0, 2.1, 1.0], "flat": [5.0, 5.0, 5.1, 5.0], "wild": [1.0, 9.0, 1.0, 8.0], "one": [3.0]}
    df = spark.createDataFrame([(k, i, v) for k, x in series.items() for i, v in enumerate(x)], "k string, i int, v double")
    got = {r["k"]: r["class"] for r in stats.trajectory(df, ["k"], "i", "v").collect()}
    assert got == {"up": "growing", "down": "declining", "flat": "steady", "wild": "sporadic", "one": "insufficient_data"}


def test_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = 2 + x @ [1.0, -2.0, 0.5]
    rows_ = [(i, v.tolist(), float(w)) for i, (v, w) in enumerate(zip(x, y))] + [(900, None, 1.0), (901, [1.0], 1.0), (902, [1.0, None, 2.0], 1.0), (903, [1.0, 2.0, 3.0], None)]
    got = stats.fit_ridge(spark.createDataFrame(rows_, "id int, x array<double>, y double"), "x", "y", key="id")
    m = np.column_stack([np.ones(300), x])
    want = np.linalg.solve(m.T @ m + got["alpha"] * np.diag([0, 1, 1, 1]), m.T @ y)
    assert got["n"] == 300 and got["alpha"] == 0.1
    assert np.allclose([got["intercept"], *got["coefficients"]], want)
    with pytest.raises(ValueError):
        stats.fit_ridge(spark.createDataFrame([], "x array<double>, y double"), "x", "y")


def test_text_helpers(spark):
    df = spark.createDataFrame([("[]",), (None,), ("{broken",), (json.dumps([{"kind": str(i), "detail": "d"} for i in range(20)]),)], "j string")
    got = [json.loads(r[0]) for r in df.select(T.append_json(F.col("j"), F.lit("new"), F.lit("x"))).collect()]
    assert [len(g) for g in got] == [1, 1, 1, 20] and got[3][0]["kind"] == "1" and got[3][-1]["kind"] == "new"
    build = spark.createDataFrame([("implementation 'com.a:lib:1.0'\napi \"org.b:core\" x 'com.a:lib:2'", "int a; /* no\n*/ b(); // c\nd")], "g string, s string")
    r = build.select(T.coordinates(F.col("g")).alias("c"), T.strip_comments(F.col("s")).alias("s")).first()
    assert r["c"] == ["com.a:lib", "org.b:core"] and r["s"] == "int a;  b(); \nd"


def test_prefix_catalog(spark):
    df = spark.createDataFrame([("com.a:x",), ("com.a.b:y",), ("zzz",), (None,)], "v string")
    c = spark.createDataFrame([("com.a", "A", "one"), ("com.a.b", "B", "two")], "prefix string, name string, category string")
    assert sorted((r["v"] or "", r["name"] or "") for r in relational.classify_by_prefix(df, "v", c).collect()) == [("", ""), ("com.a.b:y", "B"), ("com.a:x", "A"), ("zzz", "")]


def test_process_flags(spark):
    df = spark.createDataFrame([("a", 0.8, 1.0, 0.05, 2, 0.1, 0.2), ("b", 0.7, 2.0, 0.2, 1, 0.1, 0.5), ("c", None, None, None, None, None, None), ("d", 0.1, 3.0, 0.15, 3, 0.5, 0.4)], "member string, cramming double, documentation double, review double, timed_prs int, punctuality double, mutation double")
    assert rows(detectors.process_flags(df), "member", "flag", "severity") == [
        ("a", "ALL_PRS_LATE", "WARNING"), ("a", "CRAMMING", "WARNING"), ("a", "LOW_DOC_SCORE", "INFO"), ("a", "LOW_MUTATION_SCORE", "WARNING"), ("a", "LOW_REVIEWS", "CRITICAL"),
        ("d", "LOW_MUTATION_SCORE", "INFO"), ("d", "LOW_REVIEWS", "WARNING"),
    ]


def test_rewrite_and_similarity_flags(spark):
    found = spark.createDataFrame([("f", "x", "y", 2), ("g", "x", None, 1)], "file string, victim string, actor string, n long")
    assert rows(detectors.rewrite_flags(found), "subject", "flag") == [("x", "COSMETIC_REWRITE_VICTIM"), ("y", "COSMETIC_REWRITE_ACTOR")]
    pairs = spark.createDataFrame([(1, 2, 5)], "a int, b int, shared long")
    assert rows(detectors.similarity_flags(pairs), "subject", "other", "shared") == [("PROJECT_1", "PROJECT_2", 5), ("PROJECT_2", "PROJECT_1", 5)]


def test_scaled_groups(spark):
    rows_ = [("a", 1.0, 5), ("a", 2.0, 5), ("a", 4.0, None), ("b", 7.0, 1), (None, 0.0, 1), (None, 10.0, 3)]
    df = spark.createDataFrame(rows_, "g string, x double, y int")
    got = {(r.g, r.x): (r.x_scaled, r.y_scaled) for r in stats.scaled(df, ["g"], ["x", "y"]).collect()}
    assert got == {("a", 1.0): (0.0, 0.5), ("a", 2.0): (1 / 3, 0.5), ("a", 4.0): (1.0, 0.5), ("b", 7.0): (0.5, 0.5), (None, 0.0): (0.0, 0.0), (None, 10.0): (1.0, 1.0)}
    z = {(r.g, r.x): r.x_z for r in stats.zscores(df, ["g"], ["x"]).collect()}
    assert z["b", 7.0] is None and (z[None, 0.0], z[None, 10.0]) == (-1.0, 1.0) and abs(sum(v for (g, _), v in z.items() if g == "a")) < 1e-12


def test_findings_are_looked_up_without_sorting_the_lines(spark):
    f = spark.createDataFrame([("a", "x", 1, 2)], "file string, finding string, start int, end int")
    b = spark.createDataFrame([("a", 1, "u"), ("a", 2, "v"), ("a", 3, "v")], "file string, line int, author string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = detectors.attribute_findings(f, b)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        found = detectors.hotspots(got.withColumn("rule", F.col("finding")), ["rule", "file"], F.lit("CRITICAL"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        # All groups are made after the shares have been dealt out by author.
        assert "SortAggregate" not in plan[plan.index("REPARTITION_BY_COL") :]
        assert {r.author: r.weighted for r in found.collect()} == {"u": 0.5, "v": 0.5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

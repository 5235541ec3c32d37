"""Cohort grading and behavioural scores on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort


def test_usage_falls_back_to_the_parent(spark):
    rows = [("a", "full", True, "b", "low", True, False), ("a", None, True, "b", "low", True, False), (None, None, None, None, None, None, None), ("a", "full", True, None, None, None, True), ("new", "full", True, None, None, None, False)]
    df = spark.createDataFrame(rows, "m string, l string, d boolean, pm string, pl string, pd boolean, e boolean")
    c = F.col
    got = df.select(*cohort.usage((c("m"), c("l"), c("d")), (c("pm"), c("pl"), c("pd")), c("e"), {"a": 0.2, "b": 0.4}, {"full": 0.8, "low": 0.1})).collect()
    assert [tuple(r) for r in got] == [(0.2, 0.8, True), (0.4, 0.1, True), (0.5, 1.0, False), (0.0, 0.0, True), (1.0, 0.8, True)]


def test_scopes_of_the_hand_checked_project(spark):
    tasks = spark.createDataFrame([(1, "alice", 10.0, 1.0), (1, "alice", 5.0, 0.5), (1, "bob", 10.0, 0.2), (2, "carol", 0.0, 1.0), (3, None, 4.0, 1.0)], "p long, s string, points double, keep double")
    got = {r.s: r for r in cohort.scopes(tasks, "p", "s", "points", "keep", spark.createDataFrame([(1, 2)], "p long, team_size int")).collect()}
    assert set(got) == {"alice", "bob", "carol"}
    assert got["alice"].student_eff == 12.5 and got["bob"].sum_eff == 14.5 and got["bob"].ai_factor == pytest.approx(0.58) and got["bob"].mean_raw == 12.5
    assert got["carol"].own_keep is None and got["carol"].contribution is None and got["carol"].ai_factor == 1.0


def test_anchors_scale_and_empty(spark):
    df = spark.createDataFrame([("x", 10.0), ("x", 20.0), ("x", None), ("z", 3.0), ("n", -1.0), ("n", 0.2)], "k string, v double")
    assert {r.k: (r.floor, r.ceiling) for r in cohort.anchors(df, "k", "v", ("z",)).collect()} == {"x": (9.5, 21.0), "z": (0.0, 3.1), "n": (0.0, 1.0)}
    assert cohort.calibrate(df, "v", 10.0).first().scale == 0.5
    assert cohort.calibrate(df.limit(0), "v", 10.0).first().scale == 1.0
    assert cohort.anchors(df.limit(0), "k", "v").count() == 0


def test_means_and_sums(spark):
    df = spark.createDataFrame([(12.0, None, 5), (None, None, None), (4.0, 8.0, 1)], "a double, b double, n int")
    got = df.select(cohort.present_mean({"a": (F.col("a"), 0.5), "b": (F.col("b"), 0.5)}), cohort.saturated_sum({"n": (F.col("n"), 3, 2)})).collect()
    assert [tuple(r) for r in got] == [(10.0, 3.0), (None, 0.0), (6.0, 1.5)]


def test_behaviour(spark):
    at = lambda m: dt.datetime(2026, 1, 1, 10, m)
    rows = [("fix", at(0), 120, "start"), ("fix", at(5), 30, "Typo"), ("fast", at(0), 5, None), ("fast", at(4), 300, "add tests"), ("one", at(1), 201, "all"), ("none", None, None, None)]
    got = {r.k: r for r in cohort.behaviour(spark.createDataFrame(rows, "k string, t timestamp, n int, m string"), "k", "t", "n", "m").collect()}
    assert got["fix"].fixup and not got["fast"].fixup and got["fast"].anomaly and got["fast"].adjusts_tests and got["fast"].has_small
    assert {k: round(r.score, 2) for k, r in got.items()} == {"fix": 0.45, "fast": 0.25, "one": 0.5, "none": 0.1}
    assert got["one"].mean_gap is None and got["fix"].mean_gap == 5


def test_parity_consistency_and_attribution(spark):
    a = spark.createDataFrame([(1, 7.004), (2, 7.0), (3, None), (4, None)], "k long, g double")
    b = spark.createDataFrame([(1, 7.0), (2, 7.006), (4, None), (5, 1.0)], "k long, g double")
    assert sorted(r.k for r in cohort.parity(a, b, "k", {"g": 2}).collect()) == [2, 5]
    df = spark.createDataFrame([(1.0, 1.0), (1.35, 1.0), (99.0, 1.0), (None, 1.0)], "x double, b double")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(cohort.consistency([(F.col("x"), F.col("b"), 0.9)])).collect()] == [0.0, 0.3, 0.9, None]
    lines = spark.createDataFrame([("ann", "f", 30), ("ann", "g", 10), ("ann", "h", 9), (None, "f", 50), ("bo", "u", 20)], "who string, file string, n int")
    scores = spark.createDataFrame([("f", 1.0), ("g", 0.0), ("h", 1.0), ("u", None)], "file string, s double")
    assert [tuple(r) for r in cohort.attribute_scores(lines, "who", "file", "n", scores, "s").collect()] == [("ann", 2, 40, 0.75)]

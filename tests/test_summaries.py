"""Dashboards, packed contexts, sprints over clock changes, left-out deviations on cases of their own."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from cohortlens.operators import dashboards


def test_levels_tell_null_keys_from_totals(spark):
    facts = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, None, 4)], "team string, member string, v int")
    got = {(r.level, r.team, r.member): r.s for r in dashboards.dashboards(facts, "team", "member", {"s": F.sum("v")}).collect()}
    assert got == {("member", "a", "x"): 1, ("member", "a", None): 2, ("member", None, None): 4, ("team", "a", None): 3, ("team", None, None): 4, ("cohort", None, None): 7}


def test_members_without_facts_count_as_zero(spark):
    members = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "z")], "team string, member string")
    facts = spark.createDataFrame([("x", 5.0), ("x", 3.0), ("q", 1.0)], "member string, v double")
    got = dashboards.all_inequality(members, facts, {"sum": F.sum("v"), "n": F.count("*")}).collect()
    assert sorted((r.team, r.metric, r.n, round(r.gini, 9), r.max_min_ratio) for r in got) == [("a", "n", 2, 0.5, float("inf")), ("a", "sum", 2, 0.5, float("inf"))]


def test_contexts_fill_their_budget(spark):
    rng = random.Random(7)
    rows = [(g, i, None if i == 3 else "ü" * rng.randrange(30)) for g in ("a", "b", None) for i in range(40)] + [("short", 1, "one"), ("short", 2, "two"), ("exact", 1, "x" * 49), ("exact", 2, ""), ("exact", 3, "z")]
    got = {r.g: r for r in dashboards.packed_context(spark.createDataFrame(rows, "g string, i int, t string"), ["g"], [F.col("i")], F.col("t"), 50).collect()}
    for g in ("a", "b", None):
        want, used = [], 0
        for _, _, t in (x for x in rows if x[0] == g):
            room = 50 - used - bool(want)
            if room <= 0:
                break
            want.append(t or "" if len(t or "") <= room else t[: room - 1] + "…")
            used = len("\n".join(want))
        assert (got[g].context, got[g].rows, got[g].all_rows) == ("\n".join(want), len(want), 40) and used in (49, 50)
    assert (got["short"].context, got["short"].rows) == ("one\ntwo", 2)
    assert len(got["exact"].context) == 49 and got["exact"].rows == 1
    cut = spark.createDataFrame([("né",), ("nénu",), (None,)], "t string").select(dashboards.truncate(F.col("t"), 3).alias("t"))
    assert [r.t for r in cut.collect()] == ["né", "nén…", None]


def test_sprints_over_clock_changes(spark):
    courses = spark.createDataFrame([("spring", dt.date(2026, 3, 23), 7, 2), ("autumn", dt.date(2026, 10, 19), 7, 2), ("none", None, 7, 2), ("empty", dt.date(2026, 1, 1), 7, 0)], "course string, first_day date, days int, sprints int")
    got = {(r.course, r.sprint): r for r in dashboards.sprint_windows(courses).collect()}
    assert {k: r.hours for k, r in got.items()} == {("spring", 1): 167.0, ("spring", 2): 168.0, ("autumn", 1): 169.0, ("autumn", 2): 168.0}
    assert got["spring", 1].starts == dt.datetime(2026, 3, 22, 23) and got["spring", 1].ends == dt.datetime(2026, 3, 29, 21, 59, 59) and got["autumn", 2].starts == dt.datetime(2026, 10, 25, 23)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert {(r.course, r.sprint): (r.starts, r.hours) for r in dashboards.sprint_windows(courses).collect()} == {k: (r.starts, r.hours) for k, r in got.items()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert dashboards.window_problems(dashboards.sprint_windows(courses)).count() == 0


def test_problems_of_windows(spark):
    day = lambda n, s=0: dt.datetime(2026, 1, n) + dt.timedelta(seconds=s)
    rows = [("c", 1, day(1), day(5)), ("c", 2, day(5, 1), day(9)), ("c", 3, day(9, 11), day(12)), ("c", 4, day(10), day(11)), ("c", 5, day(20), day(19)), ("c", 6, None, day(3)), ("d", 1, day(2), day(2))]
    got = dashboards.window_problems(spark.createDataFrame(rows, "course string, sprint int, starts timestamp_ntz, ends timestamp_ntz")).collect()
    assert sorted((r.sprint, r.problem, r.seconds) for r in got) == [(3, "gap", 10), (4, "overlap", 2 * 86400 + 1), (5, "invalid", None), (6, "invalid", None)]


def test_spread_over_a_sprint(spark):
    start = dt.datetime(2026, 1, 1)
    windows = spark.createDataFrame([("c", 1, start, start + dt.timedelta(hours=90))], "course string, sprint int, starts timestamp_ntz, ends timestamp_ntz")
    commits = [("ann", "c", 1, start + dt.timedelta(hours=h)) for h in (0, 29, 30, 59, 60, 79, 80, 89, 200)] + [("ann", "c", 1, None), ("ann", "c", 2, start)]
    got = dashboards.temporal_spread(spark.createDataFrame(commits, "who string, course string, sprint int, at timestamp_ntz"), windows, ["who"], 10).collect()
    assert [r.spread for r in got] == ['{"early": 2, "mid": 2, "late": 2, "cramming": 3}']


def test_deviation_from_the_others(spark):
    rng = random.Random(1)
    rows = [(a, f"f{rng.randrange(5)}", k, 1e6 + rng.gauss(0, 3)) for a in ("x", "y") for k in ("u", "v") for _ in range(20)] + [("flat", f"f{i}", "u", 2.0) for i in range(5)] + [("alone", "f", "u", 1.0), ("x", "f0", "u", None), (None, "f", "u", 1.0)]
    got = {(r.author, r.file, r.feature): r for r in dashboards.left_out_deviation(spark.createDataFrame(rows, "author string, file string, feature string, value double")).collect()}
    assert ("alone", "f", "u") not in got and all(r.z == 0 for k, r in got.items() if k[0] == "flat") and len(got) == 25
    for (a, f, k), r in got.items():
        own = [v for x in rows if x[:3] == (a, f, k) and (v := x[3]) is not None]
        others = [x[3] for x in rows if x[0] == a and x[2] == k and x[1] != f and x[3] is not None]
        assert r.n == len(others) and abs(r.mean - statistics.mean(others)) < 1e-6 and abs(r.sd - statistics.stdev(others)) < 1e-6
        if a != "flat":
            assert abs(r.z - abs(statistics.mean(own) - statistics.mean(others)) / statistics.stdev(others)) < 1e-5

"""Statement blame, survival over snapshots and template diffs on cases of their own."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from __spark_entry__ import queries
from cohortlens.operators import blame, patience

RUN = "repo string, path string, first bigint, last bigint, commit string, email string"
SPAN = "repo string, path string, statement bigint, first bigint, last bigint"


def test_statement_blame_equals_votes_by_line(spark):
    rng = random.Random(2)
    runs, spans = [], []
    for f in range(4):
        at = 1
        while at < 900:
            n = rng.choice((1, 2, 3, 40, 300))
            if rng.random() < 0.9:
                runs.append(("r", f"f{f}", at, at + n - 1, f"c{rng.randrange(9)}", rng.choice(("a@x", "b@x", None))))
            at += n
        spans += [("r", f"f{f}", i, s, s + rng.choice((0, 1, 5, 130, 500))) for i, s in enumerate(rng.sample(range(1, 1000), 40))]
    spans += [("r", "f0", 98, None, 3), ("r", "f0", 99, 9, 4), ("r", "none", 1, 1, 5)]
    want = {}
    for repo, path, i, s, e in spans:
        lines = [x for x in runs if s and x[1] == path for n in range(max(s, x[2]), min(e, x[3]) + 1)]
        if lines:
            c, m = (sorted(Counter(x[k] or "" for x in lines).items(), key=lambda p: (-p[1], p[0])) for k in (4, 5))
            want[path, i] = (c[0][0], m[0][0] or None, len(m) == 1, len(lines))
    for bucket in (7, 128):
        got = blame.statement_blame(spark.createDataFrame(spans, SPAN), spark.createDataFrame(runs, RUN), bucket).collect()
        assert {(r.path, r.statement): (r.commit, r.email, r.unanimous, r.lines) for r in got} == want and len(got) == len(want)


def test_votes_are_dealt_out_once(spark):
    """Spans and runs are shuffled to meet, their votes once more; more deals filled the disks."""
    found = blame.statement_blame(spark.createDataFrame([("r", "f", 1, 1, 300), ("r", "f", 1, 400, 401)], SPAN), spark.createDataFrame([("r", "f", 1, 150, "b", "x"), ("r", "f", 151, 401, "a", None)], RUN))
    assert found._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + found._jdf.queryExecution().executedPlan().toString().count("Exchange SinglePartition") <= 3
    assert [tuple(r) for r in found.collect()] == [("r", "f", 1, "a", None, False, 302)]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_spans_and_runs_are_shuffled_once(spark):
    """What lies together by file is blamed where it lies; each further shuffle of all line items filled the disks."""
    spans, runs = spark.createDataFrame([("r", "f", 1, 1, 300), (None, "f", 1, 1, 9)], SPAN), spark.createDataFrame([("r", "f", 1, 500, "a", None), (None, "f", 1, 9, "b", "x")], RUN)
    found = blame.statement_blame(spans, runs)
    assert shuffles(found) == 1 and [tuple(r) for r in found.collect()] == [("r", "f", 1, "a", None, True, 300)]


def test_snapshots_are_blamed_apart_and_keep_columns(spark):
    rows = [("r", "f", at, 1, 9, run, None if run else 1, c if run else None, None if run else f"print {at}") for at, c in (("old", "a"), ("now", "b")) for run in (True, False)]
    lines = spark.createDataFrame(rows, "repo string, path string, at string, first bigint, last bigint, is_run boolean, statement bigint, commit string, print string")
    got = blame.blamed(lines.repartition("repo"), 4, (*blame.FILE, "at"), ("print",))
    assert shuffles(got) == 1 and {(r.at, r.statement, r.commit, r.lines, r["print"]) for r in got.collect()} == {("old", 1, "a", 9, "print old"), ("now", 1, "b", 9, "print now")} and "email" not in got.columns


def test_fingerprints_go_to_pull_requests_once(spark):
    commits = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p1", "b"), ("p2", "c"), (None, "a")], "pr string, sha string")
    prints = spark.createDataFrame([("a", "n1", "m1", 1, 1), ("b", "n1", None, 1, 0), ("b", "n2", "m1", 0, 1), ("x", "n9", "m9", 1, 1)], "commit string, normalized string, method string, old int, now int")
    got = blame.surviving_at(prints, commits, ["old", "now"])
    assert {r.pr: tuple(r)[1:] for r in got.collect()} == {"p1": (2, 2, 1, 2, 1, 1), "p2": (0,) * 6}
    one = blame.surviving(prints, commits)
    assert "Expand" not in one._jdf.queryExecution().executedPlan().toString() and shuffles(one) <= 3


def test_runs_of_lines(spark):
    lines = [("r", "f", n, c, "a@x") for n, c in ((1, "p"), (2, "p"), (3, "q"), (4, "p"), (6, "p"), (6, "p"))] + [("r", "f", None, "p", "a@x")]
    got = blame.blame_runs(spark.createDataFrame(lines, "repo string, path string, line_no bigint, commit string, email string")).collect()
    assert sorted((r.first, r.last, r.commit) for r in got) == [(1, 2, "p"), (3, 3, "q"), (4, 4, "p"), (6, 6, "p")]


def test_authors(spark):
    blames = spark.createDataFrame([("c1", "Ann@X.org"), ("c2", "bob@users.noreply.github.com"), ("c3", "eve@x"), ("c4", None)], "commit string, email string")
    commits = spark.createDataFrame([("c1", "p2", "zed"), ("c1", "p1", None), ("c3", "p3", "eve")], "sha string, pr string, login string")
    identities = spark.createDataFrame([("m1", "email", "ann@x.org"), ("m2", "login", "Bob"), ("m0", "email", "BOB")], "member string, kind string, value string")
    got = {r.commit: (r.pr, r.author, r.member) for r in blame.resolve_authors(blames, commits, identities).collect()}
    assert got == {"c1": ("p1", None, "m1"), "c2": (None, "Bob", "m2"), "c3": ("p3", "eve", None), "c4": (None, None, None)}


def test_only_changed_repositories_are_blamed_again(spark):
    head = lambda *x: spark.createDataFrame(x, "repo string, head string")
    runs = spark.createDataFrame([(r, "f", 1, 9, "new", "a@x") for r in ("same", "moved", "added", "gone")], RUN)
    spans = spark.createDataFrame([(r, "f", 1, 2, 3) for r in ("same", "moved", "added", "gone")], SPAN)
    stored = blame.statement_blame(spans, runs.replace("new", "old"))
    got = blame.refreshed_blame(stored, head(("same", "1"), ("moved", "1"), ("gone", "1")), head(("same", "1"), ("moved", "2"), ("added", None)), spans, runs).collect()
    assert {r.repo: r.commit for r in got} == {"same": "old", "moved": "new", "added": "new"}


def test_refreshed_blame_joins_line_items_where_they_lie(spark):
    """Both sides of two joins with suppliers, the line items by repository for each snapshot, and heads: no statement, span or run is shuffled again, however many repositories there are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert shuffles(queries()["refreshed_blame"](spark, "/root/testdata/sf0.001")) <= 11
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_survival_keeps_what_was_added_first(spark):
    commits = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p2", "c"), ("p3", None)], "pr string, sha string")
    prints = lambda *x: spark.createDataFrame(x, "commit string, normalized string, method string")
    first = blame.measured_again(blame.surviving(prints(("a", "n1", "m1"), ("b", "n1", None), ("b", "n2", "m1")), commits))
    assert {r.pr: (r.added_raw, r.surviving_raw, r.surviving_normalized, r.surviving_methods) for r in first.collect()} == {"p1": (3, 3, 2, 1), "p2": (0, 0, 0, 0)}
    later = blame.measured_again(blame.surviving(prints(("a", "n1", "m1"), ("c", "n9", "m9")), commits), first)
    assert {r.pr: (r.added_raw, r.surviving_raw) for r in later.collect()} == {"p1": (3, 1), "p2": (0, 1)}
    authors = spark.createDataFrame([("p1", "ann"), ("p2", "ann"), ("p9", "bob")], "pr string, member string")
    got = {r.member: (r.added_raw, r.surviving_raw, r.rate_raw, r.points, r.density) for r in blame.member_survival(later, authors, spark.createDataFrame([("ann", 4)], "member string, points bigint")).collect()}
    assert got == {"ann": (3, 2, 2 / 3, 4, 0.5), "bob": (0, 0, 0.0, 0, 0.0)}


def brute_common(a, b):
    row = [0] * (len(a) + 1)
    for y in b:
        left = 0
        for i, x in enumerate(a, 1):
            left, row[i] = row[i], left + 1 if x == y else max(row[i], row[i - 1])
    return row[-1]


def test_common_subsequences_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(40))] for _ in range(2))
        n = brute_common(a, b)
        for limit in (1 << 20, 3):
            pairs = patience.matched(a, b, limit)
            assert len(pairs) == patience.common_length(a, b) == n and all(a[i] == b[j] for i, j in pairs)
            assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_patience_equals_brute_force_where_anchors_are_unique(spark):
    rng = random.Random(4)
    old, new, want = [], [], {}
    for f in range(12):
        a = [f"line {i}" for i in range(60)]
        if f % 2:  # repeated lines between the unique ones
            a = [x for line in a for x in (line, "}")]
        b = [x for x in a if rng.random() < 0.8]
        if f % 3 == 0:
            rng.shuffle(b)
        for _ in range(rng.randrange(20)):
            b.insert(rng.randrange(len(b) + 1), f"new {rng.random()}")
        if f % 2 and f % 3 == 0:
            continue
        old.append((f"f{f}", "\n".join(a)))
        new.append((f"f{f}", "\n".join(b)))
        want[f"f{f}"] = len(b) - brute_common(a, b)
    old += [("same", "x\ny"), ("gone", ""), ("both empty", ""), ("none", None), ("double", "a"), ("double", "b")]
    new += [("same", "x\ny"), ("fresh", ""), ("both empty", ""), ("none", "1\n2"), ("double", "b\n")]
    frame = lambda rows: spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r for r in patience.template_diff(frame(old), frame(new)).collect()}
    assert {k: got[k].added_lines if k in got else 0 for k in want} == want and all(got[k].status == "modified" and len(got[k].added) == got[k].added_lines for k in want if k in got)
    assert {k: (r.status, r.added_lines, r.total_lines) for k, r in got.items() if k not in want} == {"gone": ("template_only", 0, 0), "fresh": ("added", 1, 1), "none": ("added", 2, 2), "double": ("modified", 1, 2)}


def test_a_long_pair_ends_in_seconds(spark):
    rng = random.Random(9)
    a = [rng.choice(("", "}", "    return x", f"value {i}")) for i in range(50_000)]
    b = [x if rng.random() < 0.95 else f"changed {i}" for i, x in enumerate(a)]
    frame = lambda x: spark.createDataFrame([("f", "\n".join(x))], "path string, text string")
    began = time.time()
    got = patience.template_diff(frame(a), frame(b)).first()
    assert time.time() - began < 90 and got.added_lines == sum(x.startswith("changed") for x in b)
    blank = ["", "}"] * 20_000
    began = time.time()
    assert len(patience.matched(blank, blank[1:])) == 39_999 and time.time() - began < 60


def test_template_diff_makes_texts_once_and_carries_on_only_what_repeats(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for x in batches:
            made.add(len(x))
            yield x

    old = "\n".join(f"a{i}\n}}" for i in range(50))
    new = "\n".join([*(f"a{i}\n}}" for i in range(1, 50)), "a0", "own"])
    frame = lambda text: spark.createDataFrame([("f", text), ("g", "same")], "path string, text string")
    got = patience.template_diff(frame(old), frame(new).mapInPandas(count, "path string, text string")).collect()
    assert [(r.path, r.status, r.added_lines, r.added, r.total_lines) for r in got] == [("f", "modified", 2, [99, 100], 100)]
    assert made.value == 2
    both = spark.createDataFrame([("f", old, new)], "path string, old string, new string")
    left = patience._round(patience._sides(both).withColumns({"segment": F.lit(0), "i": F.lit(None).cast("int")})).collect()
    assert len([r for r in left if r.i is not None]) == 49 and {r.length for r in left if r.i is None} == {1}

"""Edge cases of the operators on small frames."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scalar, text
from cohortlens.operators import flags, grading, graphs, maintenance, relational, stats
from cohortlens.sources import parsers
from cohortlens.streaming import incremental


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_scalars(spark):
    r = one(spark, zero=scalar.safe_divide(F.lit(0.0), F.lit(0.0)), snap=scalar.snap(F.lit(0.5), [0.0, 1.0]), nan=scalar.snap(F.lit(float("nan")), [2.0, 1.0]), flat=scalar.linear_map(F.lit(3.0), 1.0, 1.0, 0.0, 10.0), m=scalar.minutes_of(F.lit("3h")), bad=scalar.minutes_of(F.lit("3x")), mi=scalar.maintainability_index(F.lit(0.0), F.lit(1.0), F.lit(10.0), F.lit(0.0)))
    assert (r.zero, r.snap, r.nan, r.flat, r.m, r.bad, r.mi) == (0.0, 0.0, 1.0, 5.0, 180, None, 100.0)
    v, n = scalar.weighted_fusion({"a": (F.lit(None).cast("double"), 0.5), "b": (F.lit(1.0), 0.5)})
    r = one(spark, v=v, n=n)
    assert (r.v, r.n) == (1.0, 1)
    assert math.isnan(one(spark, d=scalar.dot(F.array(F.lit(1.0)), [1.0, 2.0])).d)


def test_text(spark):
    r = one(spark, g=text.is_generic_title(F.lit(" Fix ")), e=text.is_empty_description(F.lit("# A long enough heading line")), i=text.is_id_only(F.lit("AB-12 cd-3")), m=text.mask_statement(F.lit('x = 42 + 1 + "a b"')), s=text.slug(F.lit("A b--C!")), t=text.title_score(F.lit(None).cast("string")))
    assert (r.g, r.e, r.i, r.m, r.s, r.t) == (True, True, True, "x = _NUM_ + 1 + _STR_", "a-b-c", 0.0)
    assert one(spark, a=F.lit("src/a/b/X.java").rlike(text.glob_regex("src/**/*.java")), b=F.lit("src/X.kt").rlike(text.glob_regex("src/*.java")))[:] == (True, False)


def test_inequality_edges(spark):
    df = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("m", 0.0), ("m", 4.0), ("s", 1.0), ("n", None)], "g string, x double")
    got = {r.g: r for r in stats.inequality(df, ["g"], "x").collect()}
    assert set(got) == {"z", "m"}
    assert (got["z"].gini, got["z"].cv, got["z"].max_min_ratio) == (0.0, 0.0, 0.0)
    assert (got["m"].gini, got["m"].max_min_ratio) == (0.5, float("inf"))
    assert stats.inequality(df.limit(0), ["g"], "x").count() == 0


def test_backoff(spark):
    df = spark.createDataFrame([(i, "a", "x", float(i)) for i in range(5)] + [(9, "a", "y", 100.0)], "id int, g string, h string, x double")
    got = {r.id: (r.level, r.outlier) for r in stats.backoff_outliers(df, [["g", "h"], ["g"]], "x").collect()}
    assert got[0] == (0, False) and got[9] == (1, True)


def test_contained_first_window_and_edges(spark):
    w = spark.sql("select timestamp'2026-01-01' s, timestamp'2026-02-01' e, 1 id union all select timestamp'2026-02-01', timestamp'2026-03-01', 2")
    e = spark.sql("select timestamp'2026-02-01' t, 'edge' k union all select timestamp'2026-04-01', 'out' union all select timestamp'2026-02-02', 'in'")
    assert {r.k: r.id for r in relational.contained(e, "t", w, "s", "e").collect()} == {"edge": 1, "in": 2}


def test_distribute_zero_points(spark):
    df = spark.createDataFrame([(1, 0, 10.0), (1, None, 10.0), (2, 3, 8.0), (2, 1, 8.0)], "w int, p int, a double")
    got = sorted(r.a for r in relational.distribute(df, "w", F.col("p"), {"a": F.col("a")}).collect())
    assert got == [2.0, 5.0, 5.0, 6.0]


def brandes(links):
    """Betweenness of a directed graph {node: set of nodes}, one source after the other."""
    score = dict.fromkeys(links, 0.0)
    for s in links:
        order, before, count, far, queue = [], {v: [] for v in links}, dict.fromkeys(links, 0.0), {s: 0}, [s]
        count[s] = 1.0
        for v in queue:
            order.append(v)
            for w in links[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    count[w] += count[v]
                    before[w].append(v)
        part = dict.fromkeys(links, 0.0)
        for w in reversed(order):
            for v in before[w]:
                part[v] += count[v] / count[w] * (1 + part[w])
            if w != s:
                score[w] += part[w]
    scale = (len(links) - 1) * (len(links) - 2)
    return {v: x / scale if scale else 0.0 for v, x in score.items()}


def test_betweenness(spark):
    rng = random.Random(3)
    rows = [("path", 1, 2), ("path", 2, 3), ("path", 2, 2), ("path", 1, 2), ("pair", 1, 2), ("nulls", None, 1)]
    rows += [("ring", i, (i + 1) % 7) for i in range(7)] + [(None, rng.randrange(30), rng.randrange(30)) for _ in range(70)]
    got = {(r.g, r.node): r.betweenness for r in graphs.betweenness(spark.createDataFrame(rows, "g string, a int, b int"), ["g"], "a", "b").collect()}
    want = {}
    for g in ("path", "pair", "ring", None):
        links = {}
        for _, a, b in (x for x in rows if x[0] == g and x[1] != x[2]):
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set())
        want |= {(g, v): x for v, x in brandes(links).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want["path", 2] == 0.5
    assert graphs.betweenness(spark.createDataFrame([], "g string, a int, b int"), ["g"], "a", "b").count() == 0


def test_collaboration(spark):
    members = spark.createDataFrame([("x", "ann"), ("x", "bob"), ("x", "eve"), ("x", "zed"), ("y", "one")], "g string, node string")
    reviews = spark.createDataFrame([("x", "ann", "bob"), ("x", "bob", "ann"), ("x", "bob", "eve")], "g string, a string, b string")
    prs = spark.createDataFrame([("x", 1, True), ("x", 1, False), ("x", 2, False)], "g string, pr int, reviewed boolean")
    got = graphs.collaboration(members, reviews, prs, ["g"]).collect()
    assert [(r.g, r.nodes, r.isolated, r.coverage) for r in got] == [("x", 4, True, 0.5)]
    assert abs(got[0].density - 0.25) < 1e-12 and abs(got[0].reciprocity - 2 / 3) < 1e-12
    assert json.loads(got[0].centrality)["bob"] == {"in_degree": 1, "out_degree": 2, "betweenness": 0.1667}


def test_formula(spark):
    f = ("clamp", ("/", ("*", "a", 3), "b"), 0, 10)
    assert grading.free_variables(f) == {"a", "b"} and grading.explain(("*", "a", 3)) == "(a * 3)"
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 0.0)], "a double, b double")
    assert sorted(r.y for r in grading.evaluate(df, [("y", f)]).collect()) == [0.0, 6.0]
    with pytest.raises(ValueError):
        grading.evaluate(df, [("y", "missing")])


def test_flags(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "id int, x double")
    got = flags.raise_flags(df, ["id"], [flags.Rule("HIGH", F.col("x") > 1, "CRITICAL", {"x": F.col("x")}), flags.Rule("NULL", F.col("x").isNull(), "INFO")])
    assert [(r.id, r.flag, r.details) for r in got.orderBy("id").collect()] == [(1, "HIGH", '{"x":5.0}'), (2, "NULL", "{}")]
    assert flags.at_least(got, "WARNING").count() == 1


def test_maintenance(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, float("nan"), None)], "k int, v double, s string")
    b = spark.createDataFrame([(2, float("nan"), None), (1, 1.0, "x")], "k int, v double, s string")
    assert maintenance.checksum(a).first() == maintenance.checksum(b).first()
    assert maintenance.diff(a, b, ["k"]).count() == 0
    c = spark.createDataFrame([(1, 1.05, None), (3, 0.0, "n")], "k int, v double, s string")
    assert {r.k: r.status for r in maintenance.diff(a, c.withColumn("s", F.coalesce("s", F.lit("x"))), ["k"], 0.1).collect()} == {2: "ONLY-A", 3: "ONLY-B"}
    assert {r.k: r.s for r in maintenance.upsert(a, c, ["k"], "coalesce").collect()} == {1: "x", 2: None, 3: "n"}
    assert {r.k: r.v for r in maintenance.upsert(a.filter("k = 1"), c, ["k"], "ignore").collect()} == {1: 1.0, 3: 0.0}
    assert maintenance.replace_slice(a, c, ["k"]).count() == 3
    assert [r.k for r in maintenance.unseen(c, a.select("k", "v"), ["k"], "v").orderBy("k").collect()] == [1, 3]


def test_sarif(spark):
    text_ = '{"runs":[{"tool":{"driver":{"name":"t","rules":[{"id":"R1","defaultConfiguration":{"level":"error"}}]}},"results":[{"ruleIndex":0,"message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"file:///a/B.java"},"region":{"startLine":3}}}]}]}]}'
    df = spark.createDataFrame([("ok", text_), ("bad", "{"), ("none", None)], "id string, t string")
    rows = parsers.sarif(df, "t").collect()
    assert [(r.id, r.rule, r.severity, r.path, r.start_line, r.end_line) for r in rows] == [("ok", "R1", "CRITICAL", "/a/B.java", 3, 3)]


def test_diff_blame_links(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-old\n+new\n same\n"
    rows = parsers.diff_lines(spark.createDataFrame([(1, diff), (2, None)], "id int, t string"), "t").collect()
    assert [(r.path, r.sign, r.line_no, r.line) for r in rows] == [("x.py", "-", 1, "old"), ("x.py", "+", 1, "new")]
    sha = "a" * 40
    blame = f"{sha} 1 1 2\nauthor A\nauthor-mail <a@b>\nauthor-time 7\n\tfirst\n{sha} 2 2\n\tsecond\n"
    rows = parsers.blame_lines(spark.createDataFrame([(blame,)], "t string"), "t").collect()
    assert [(r.line_no, r.author_email, r.author_time, r.line) for r in rows] == [(1, "a@b", 7, "first"), (2, "a@b", 7, "second")]
    r = one(spark, a=parsers.next_link(F.lit('<https://x/2>; rel="next", <https://x/9>; rel="last"')), b=parsers.next_link(F.lit('<https://x/9>; rel="last"')))
    assert (r.a, r.b) == ("https://x/2", None)
    xml = '<mutations><mutation detected="true" status="KILLED"/><mutation detected="false" status="NON_VIABLE"/></mutations>'
    assert one(spark, **parsers.mutation_totals(F.lit(xml)))[:] == (2, 1, 1, 1.0)


def test_stream_merge_is_incremental(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    df = spark.sql("select id, timestamp'2026-01-01' + make_interval(0,0,0,0,0,0,id) as ts from range(5)")
    df.write.parquet(src)
    for _ in range(2):
        stream = incremental.deduplicated(incremental.read_stream(spark, src, df.schema), ["id"], "ts")
        q = incremental.merge_batches(stream, str(tmp_path / "ck"), lambda b, i: seen.append(b.count()))
        q.awaitTermination()
    assert sum(seen) == 5


def test_rows_of_a_large_group_are_dealt_out(spark):
    """A group of most rows was one task's rows of a join."""
    rows = [("large", i) for i in range(4000)] + [(None, i) for i in range(50)] + [(f"g{i}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x int")
    sizes = df.groupBy("g").agg(F.count("*").alias("size")).filter("g is null or g != 'g7'")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = stats.joined_by_size(df, sizes, ["g"], "size").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [(g, x, {"large": 4000, None: 50}.get(g, 1)) for g, x in rows if g != "g7"]
    assert sorted(map(repr, ((r.g, r.x, r.size) for r in got))) == sorted(map(repr, want))

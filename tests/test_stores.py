"""Comparison and upkeep of stores, exports, anchors and shared lines in their odd cases."""

import json

from pyspark.sql import functions as F

from cohortlens.operators import cohort, lines, maintenance
from cohortlens.sources import exports


def test_compare_and_cells(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, 1.0, "x"), (2, nan, None), (None, 5.0, "z"), (4, 1.0, "w")], "k int, v double, s string")
    b = spark.createDataFrame([(4, 1.0 + 1e-12, "w"), (None, 5.0, "y"), (2, nan, None), (1, None, "x")], "k int, v double, s string")
    got = {x.name: (x.rows_a, x.rows_b, x.status) for x in maintenance.compare({"t": a, "same": a, "old": a}, {"t": b, "same": a.repartition(3), "new": b}).collect()}
    assert got == {"t": (4, 4, "CHECKSUM"), "same": (4, 4, "OK"), "old": (None, None, "ONLY-A"), "new": (None, None, "ONLY-B")}
    assert maintenance.compare({"t": a}, {"t": b.limit(1)}).first().status == "COUNT"
    assert maintenance.compare({"t": a.select("k")}, {"t": b.select("k")}).first().status == "OK"
    cells = maintenance.cell_diffs(a, b, ["k"], 1e-9).collect()
    assert sorted(((x.k, x.column, x.a, x.b) for x in cells), key=str) == [(1, "v", "1.0", None), (None, "s", "z", "y")]
    assert {x.k for x in maintenance.cell_diffs(a, b, ["k"]).collect()} == {1, None, 4}
    assert maintenance.cell_diffs(a.limit(0), b, ["k"]).collect() == []


def test_remove_missing(spark):
    old = spark.createDataFrame([(1, 10), (1, 11), (1, None), (2, 10), (3, 10), (None, 10)], "sprint int, id int")
    scopes = spark.createDataFrame([(1,), (2,), (2,), (9,)], "sprint int")
    listed = spark.createDataFrame([(1, 11), (1, 99), (3, 1), (1, 11)], "sprint int, id int")
    left = [tuple(x) for x in maintenance.remove_missing(old, scopes, listed, "sprint", "id").collect()]
    assert sorted(left, key=str) == [(1, 11), (3, 10), (None, 10)]


def test_exports(spark):
    values = [{"value": "m", "description": "d"}, {"description": "none"}, {"value": "n"}]
    pair = lambda v, w, **more: {"attributeName": "help", "attributeType": "ENUM_PAIR", "value": v, "valueB": w, **more}
    entries = [
        (1, {"attributeValues": [{"attributeName": "help", "attributeType": "ENUM"}, pair(" m ", "A", enumValues=values), pair("z", "z")]}),
        (2, {"attributeValues": [pair("m", "  ", enumValues2=[{"value": "A"}])]}),
        (3, {"attributeValues": []}), (4, {}), (6, {"attributeValues": [pair(None, None)]}),
    ]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in entries] + [(5, None), (7, "no JSON")], "task int, entry string")
    got = {x.task: (x.model, x.level, x.declared) for x in exports.declared_usage(df, "help").collect()}
    assert got == {1: ("m", "A", True), 2: ("m", None, False), 6: (None, None, False)}
    assert sorted((x.slot, x.value, x.description, x.place) for x in exports.declared_domains(df, "help").collect()) == [(1, "m", "d", 0), (1, "n", None, 2), (2, "A", None, 0)]
    assert exports.declared_usage(df.limit(0), "help").collect() == [] == exports.declared_domains(df.limit(0), "help").collect()


def test_anchors(spark):
    samples = spark.createDataFrame([("s", "arch_weighted", 1.0), ("s", "cc_pct", 2.0), ("s", None, 3.0), (None, "survival_raw", 4.0), ("q", "cc_pct", 5.0)], "spec string, key string, value double")
    specs = spark.createDataFrame([("q", "cc_pct", 1.0, None)], "spec string, key string, floor double, ceiling double")
    weights = spark.createDataFrame([("s", "arch_norm", 7.0), ("s", None, 1.0), ("s", "mi_floor", None)], "spec string, name string, value double")
    got = {x.value: (x.floor, x.ceiling, x.origin) for x in cohort.resolved_anchors(samples, specs, weights).collect()}
    assert got == {1.0: (0.0, 14.0, "weights"), 2.0: (0.0, 100.0, "weights"), 3.0: (0.0, 1.0, "unit"), 4.0: (0.5, 0.95, "weights"), 5.0: (1.0, None, "spec")}


def test_member_line_totals(spark):
    links = spark.createDataFrame(
        [(1, "p", "a", 1, 3.0, "TASK", "DONE"), (2, "p", "b", 1, 1.0, None, "DONE"), (3, "p", "c", 1, 9.0, "TASK", "DONE"), (4, "q", "a", 2, None, "TASK", "DONE"), (5, "q", "b", 2, 0.0, "TASK", "DONE"),
         (6, "p", "a", 1, 5.0, "USER_STORY", "DONE"), (7, "p", "a", 1, 5.0, "TASK", "TODO"), (8, "p", "z", 1, 5.0, "TASK", "DONE"), (9, "r", "a", 2, 2.0, "TASK", "DONE")],
        "task int, pr string, member string, period int, points double, type string, status string",
    )
    measured = spark.createDataFrame([("p", 1, 40, 8), ("q", 2, 10, None), ("p", 2, 999, 999)], "pr string, period int, ls int, ld int")
    roster = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u")], "member string, team string")
    got = {(x.member, x.period): (x.ls, x.ld, x.points, x.ls_per_point, x.total_ls, x.total_per_point) for x in lines.member_line_totals(links, measured, roster).collect()}
    assert got == {
        ("a", 1): (30.0, 6.0, 3.0, 10.0, 30.0, 10.0), ("b", 1): (10.0, 2.0, 1.0, 10.0, 10.0, 10.0), ("c", 1): (40.0, 8.0, 9.0, 40 / 9, 40.0, 40 / 9),
        ("a", 2): (5.0, 0.0, 0.0, 0.0, 35.0, 35 / 3), ("b", 2): (5.0, 0.0, 0.0, 0.0, 15.0, 15.0),
    }
    assert lines.member_line_totals(links.filter(F.lit(False)), measured, roster).collect() == []


def test_stores_are_dealt_out_by_many_keys(spark):
    """By tax, a table's rows went to five tasks, however many they were."""
    from cohortlens.plans.catalog import QUERIES

    plan = QUERIES["compared_stores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan

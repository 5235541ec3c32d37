"""The code scanner on small sources."""

import pytest

from cohortlens.sources import code

SOURCE = '''package app.ui; // if (x) { }
/* class Ghost { void no() { } } */
public class View extends Base implements Runnable {
    private final Map<String, Integer> seen = new HashMap<>();
    public View(int a) { this.a = a; }
    @Override
    public <T> int run(Map<String, List<T>> m, int k) throws IOException {
        String s = "if (a && b) { \\" }";
        if (k > 0 && m != null || k < -5) {
            for (int i = 0; i < k; i++) { if (i % 2 == 0) { call(i); } else { call(7); } }
        } else if (k == 3) { return 1; }
        return k > 1 ? 42 : 0; // TODO later
    }
    abstract void none(int a);
    static class Inner { char c() { return '}'; } }
}
'''


@pytest.fixture
def metrics(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, None), (3, ""), (4, "class Broken { void f() { if (")], "id int, src string")
    return {r["name"]: r for r in code.method_metrics(df, "src").collect()}


def test_methods(metrics):
    assert {(r["owner"], r["name"], r["parameters"], r["id"]) for r in metrics.values()} == {("View", "View", 1, 1), ("View", "run", 2, 1), ("Inner", "c", 0, 1)}
    run = metrics["run"]
    assert (run["start_line"], run["end_line"]) == (7, 13)
    # if, &&, ||, for, if, else-if, ?
    assert (run["cyclomatic"], run["nesting"]) == (8, 3)
    # if 1, && and || 2, for 2, inner if 3, else-if 2, ?: 1
    assert run["cognitive"] == 11
    assert (metrics["View"]["cyclomatic"], metrics["View"]["cognitive"], metrics["View"]["nesting"]) == (1, 0, 0)


def test_fingerprints_ignore_names_and_literals(spark):
    a = 'class A { void f() { int total = 5; use(total, "x"); } }'
    b = 'class B { void g() { int sum = 77; use(sum, "other"); } }'
    c = 'class C { void h() { int sum = 1; use(sum, "other"); } }'
    got = {}
    for r in code.statement_fingerprints(spark.createDataFrame([(k, s) for k, s in zip("abc", (a, b, c))], "k string, src string"), "src").collect():
        got.setdefault(r["k"], []).append(r)
    assert [len(got[k]) for k in "abc"] == [2, 2, 2]
    assert got["a"][0]["method_hash"] == got["b"][0]["method_hash"] != got["c"][0]["method_hash"]
    assert got["a"][0]["raw"] != got["b"][0]["raw"]


def test_comments_and_findings(spark):
    df = spark.createDataFrame([(1, SOURCE)], "id int, src string")
    assert [r["line"] for r in code.comments(df, "src").orderBy("line").collect()] == [1, 2, 12]
    f = code.complexity_findings(code.method_metrics(df, "src"), {"cyclomatic": (7, 10), "cognitive": (5, 9), "nesting": (3, 5)})
    assert sorted((r["name"], r["kind"], r["severity"]) for r in f.collect()) == [("run", "cognitive", "CRITICAL"), ("run", "cyclomatic", "WARNING")]


def test_nesting_of_loops():
    assert code.nesting(code.scan("{ do { if (a) { b(); } } while (c && d); while (e) f(); }")) == (2, 1 + 2 + 1 + 1)
    assert code.nesting(code.scan("{ if (a) b(); else if (c) { d(); } }")) == (2, 3)


def test_halstead():
    h = code.halstead([x for x in code.scan("a = b + b;")])
    assert h["volume"] == pytest.approx(6 * 2.321928094887362) and h["difficulty"] == pytest.approx(3 / 2 * 3 / 2)


def test_xml_layouts(spark):
    layout = '<L xmlns:a="urn:x"><!-- c --><T a:width="12dp" a:id="@+id/name" a:alpha="0.5"/><B><T a:id="@id/other" a:alpha="0.5" a:width="7.5sp"/></B></L>'
    df = spark.createDataFrame([(1, layout), (2, "<broken"), (3, None), (4, "")], "id int, src string")
    got = code.xml_elements(df, "src").orderBy("id", "position").collect()
    assert [(r["id"], r["depth"], r["path"]) for r in got] == [(1, 0, "L"), (1, 1, "L/T"), (1, 1, "L/B"), (1, 2, "L/B/T")]
    assert got[1]["normalized"] == got[3]["normalized"] == 'T alpha="0.5" id="@id/_ID_" width="_DIM_"'
    assert got[1]["fingerprint"] == got[3]["fingerprint"] and got[1]["element"] != got[3]["element"]

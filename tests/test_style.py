"""Style features on small sources."""

import pytest

from cohortlens.sources import style

SOURCE = """import a.b.C;
import a.d.*;

/** A view. */
class View {
    /** Runs. */
    int run(Map seen, int k) {
        if (seen == null) {
            return MAX_SIZE;
        }
        try {
            call(k); // once
        } catch (Error e) {
        }
        return k;
    }
}"""


def test_features_and_score(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, None), (3, ""), (4, "import z; import a; class X { void f() { if ("), (5, "/* unclosed")], "id int, src string")
    got = {r["id"]: r for r in style.style_features(df, "src").withColumn("score", style.style_score()).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and len(got[1]) == 28
    x = got[1]
    assert (x["import_count"], x["wildcard_import_ratio"], x["imports_sorted"]) == (2, 0.5, True)
    assert (x["avg_method_length"], x["method_length_sd"], x["avg_parameters"], x["max_nesting"]) == (10.0, 0.0, 2.0, 1)
    assert x["empty_catch_ratio"] == 1.0 and x["blank_line_ratio"] == pytest.approx(1 / 17) and x["javadoc_ratio"] == pytest.approx(2 / 3)
    assert x["comment_density"] == pytest.approx(3 / 17) and x["documented"] and x["null_checked"] and x["uniform_indent"]
    assert x["score"] == pytest.approx(0.15 + 0.10 + 0.15 + 0.10 + 0.10)
    assert got[2]["import_count"] == 0 and got[2]["imports_sorted"] and got[2][1:] == got[3][1:]
    assert not got[4]["imports_sorted"] and got[5]["comment_density"] == 1.0


def test_baselines_and_deviation(spark):
    f = spark.createDataFrame([("ann", "f", 1.0, 5.0), ("ann", "g", 3.0, 5.0), ("bo", "h", 2.0, None)], "who string, file string, a double, b double")
    base = style.baselines(f, "who", ["a", "b"])
    assert {(r.who, r.feature): (r.n, r["mean"], round(r.sd, 6)) for r in base.collect()} == {("ann", "a"): (2, 2.0, 1.414214), ("ann", "b"): (2, 5.0, 0.0), ("bo", "a"): (1, 2.0, 0.0)}
    got = {r.file: r.deviation for r in style.deviation(f, "who", "file", base, ["a", "b"]).collect()}
    assert got["f"] == pytest.approx(1 / 2**0.5) and got["g"] == got["f"] and got["h"] is None

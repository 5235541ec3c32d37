"""Architecture rules over members, settings files and judges' replies."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import judge
from cohortlens.operators import architecture, grading
from cohortlens.operators.architecture import Match, Rule
from cohortlens.sources import config
from cohortlens.sources.members import members

SOURCE = """package org.app.ui;
import org.app.db.Dao;
import static x.Y.z;
@AndroidEntryPoint @Tag("a, b")
public class HomeFragment extends BaseFragment<Foo> implements A, B<C, D> {
    private static final Map<String, List<Dao>> daos = new HashMap<>(), more = null;
    @Inject Binding binding;
    int plain = f(1, 2);
    static { init(); }
    @Inject public HomeFragment(Dao dao, @Named("x") final Service s) { this.dao = dao; }
    @Override
    public List<Entity> load(@PathVariable @Valid Long id, @RequestBody Dto dto) throws IOException {
        if (a) { repo.dao().find(id, "x, y"); }
        return new ArrayList<Entity>(repo.all());
    }
    void onDestroyView() { binding = null; other = 1; }
    @Transactional private void save() { view.findViewById(R.id.x); new Thread(() -> run()).start(); }
    interface Inner { void g(int a); }
}
class HomeViewModel extends ViewModel { @Inject HomeViewModel(Repo r) { } }
"""


@pytest.fixture(scope="module")
def found(spark):
    return members(spark.createDataFrame([("A.java", SOURCE), ("B.java", None), ("C.java", "class X { void f( "), ("D.java", "} ) ; class {")], "path string, text string")).cache()


def test_members(found):
    rows = found.filter("path = 'A.java'").collect()
    of = lambda kind: [r for r in rows if r.kind == kind]
    assert [r.name for r in of("import")] == ["org.app.db.Dao", "x.Y.z"] and {r.package for r in rows} == {"org.app.ui"}
    t = of("type")
    assert [(r.owner, r.extends, r.implements, r.owner_annotations) for r in t][0] == ("HomeFragment", "BaseFragment<Foo>", ["A", "B<C,D>"], ["AndroidEntryPoint", "Tag"]) and {r.owner for r in t} == {"HomeFragment", "Inner", "HomeViewModel"}
    assert [(r.name, r.type, r.visibility) for r in of("field")] == [("daos", "Map<String,List<Dao>>", "private"), ("more", "Map<String,List<Dao>>", "private"), ("binding", "Binding", "package"), ("plain", "int", "package")]
    assert [(r.name, r.visibility, r.annotations) for r in of("constructor")] == [("HomeFragment", "public", ["Inject"]), ("HomeViewModel", "package", ["Inject"])]
    m = {r.name: r for r in of("method")}
    assert set(m) == {"load", "onDestroyView", "save", "g"} and m["load"].type == "List<Entity>" and m["onDestroyView"].nulls == ["binding"] and (m["load"].line, m["load"].end_line) == (11, 15)
    assert [(r.member, r.type, r.name, r.annotations) for r in of("parameter") if r.member == "load"] == [("load", "Long", "id", ["PathVariable", "Valid"]), ("load", "Dto", "dto", ["RequestBody"])]
    assert ("repo.all", 0) in [(r.name, r.args) for r in of("call")] and ("view.findViewById", 1) in [(r.name, r.args) for r in of("call")]
    assert [(r.type, r.args) for r in of("new")] == [("ArrayList", 1), ("Thread", 1)]


def test_every_kind_of_rule(found):
    home = Match(name_suffix="Fragment")
    rules = [
        Rule("field", "forbidden_field_type", regex="Dao", modifier="static"), Rule("ctor", "forbidden_constructor_param", regex="^Dao$"), Rule("call", "forbidden_method_call", regex=r"findViewById$", args=1), Rule("ret", "forbidden_return_type", regex="Entity", visibility="public"),
        Rule("long", "max_method_statements", most=2), Rule("param", "forbidden_method_param", regex="Dto", visibility="public"), Rule("import", "forbidden_import", regex=r"\.db\."), Rule("nulls", "must_null_in_lifecycle", regex="^(Binding|int)$", method="onDestroyView", match=home),
        Rule("source", "forbidden_call_source", regex=r"R\.id"), Rule("tag", "class_has_forbidden_annotation", regex="^(Tag|Transactional)$", with_methods=True), Rule("text", "forbidden_annotation_source", regex='"a, b"'), Rule("vis", "method_annotation_visibility_mismatch", regex="Transactional", visibility="public"),
        Rule("thread", "forbidden_constructor_call", "CRITICAL", regex="^Thread$", least_args=1), Rule("valid", "parameter_annotation_requires_companion", regex="^Valid$", annotation="RequestBody"), Rule("many", "field_count_with_type_pattern", regex="Map", most=1),
        Rule("hilt", "class_requires_annotation", method="HiltViewModel", annotation="Inject", match=Match(extends="ViewModel")), Rule("none", "forbidden_field_type", regex=".", match=Match(package_glob="**/db/**")),
    ]
    assert {r.kind for r in rules} == set(architecture.KINDS)
    got = {(r.rule_name, r.offender) for r in architecture.violations(found, rules).collect()}
    assert got == {
        ("field", "HomeFragment::Map<String,List<Dao>>"), ("ctor", "HomeFragment::ctor(Dao)"), ("call", "HomeFragment::call(view.findViewById)"), ("ret", "HomeFragment::return(List<Entity>)"), ("long", "HomeFragment::load#3stmts"),
        ("param", "HomeFragment::load::param(Dto)"), ("import", "org.app.db.Dao"), ("nulls", "HomeFragment::plain::not-nulled"), ("source", "HomeFragment::save::call-line-17"), ("tag", "HomeFragment::class-annot@L5"),
        ("tag", "HomeFragment::save::annot@L17"), ("text", "HomeFragment::class-annot-src@L4"), ("vis", "HomeFragment::save::visibility-mismatch"), ("thread", "HomeFragment::new(Thread)"),
        ("valid", "HomeFragment::load::param(Dto)::missing-RequestBody-companion"), ("many", "HomeFragment::field-count::2>1"), ("hilt", "HomeViewModel::missing-HiltViewModel"),
    }
    with pytest.raises(ValueError):
        architecture.violations(found, [Rule("x", "unheard_of")])


def test_settings(tmp_path):
    a = config.rubric("---\nversion: '3'\n---\n# Body  \ntext\n")
    assert (a.version, a.body) == ("3", "# Body  \ntext") and a.body_hash == config.rubric("# Body\r\ntext\n\n").body_hash and config.rubric("x").version == "0"
    text = 'severity = "INFO"\n[[layers]]\nname = "domain"\npackages = ["**/domain/**"]\nmay_depend_on = ["core"]\n[[forbidden]]\nname = "f"\nfrom = "a/**"\nmust_not_match = ["b/**"]\n[[ast_rule]]\nname = "R"\nkind = "forbidden_method_call"\ncall_regex = "x"\narg_count = 2\nclass_match = { extends = "Y", unknown = 1 }\n'
    r = config.architecture(text)
    assert r.layers == [("domain", "**/domain/**")] and r.allowed == [("domain", "core")] and r.forbidden == [("f", "a/**", "b/**")]
    assert r.rules == [Rule("R", "forbidden_method_call", "INFO", Match(extends="Y"), "x", args=2)]
    assert config.ridge_head('{"intercept": 1, "coefficients": [2, 3]}').coefficients == [2.0, 3.0]
    spec = config.grade_spec('{"weights": {"a": 1}, "anchors": {"k": {"floor": 0, "ceiling": 5}}, "formulas": {"task": [{"name": "keep", "expr": {"sub": [1, {"mul": [{"num": 0.5}, {"var": "use"}]}]}}]}}')
    assert spec.anchors == {"k": (0.0, 5.0)} and spec.formulas["task"] == [("keep", ("-", 1, ("*", 0.5, "use")))] and grading.explain(spec.formulas["task"][0][1]) == "(1 - (0.5 * use))"
    (tmp_path / "r.md").write_text("hi")
    assert config.load(str(tmp_path / "r.md"), config.rubric).body == "hi" and config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}}


def test_replies(spark):
    replies = [
        '```json\n{"flags": []}\n```', 'Sure: {"a": {"b": 1}} and {"c": 2}', "none {bad} {", None, '{"flags": [{"category": "Dead-Code", "severity": "warning", "summary": " s ", "detail": "", "student_id": "x"}, {"severity": "INFO", "summary": "t", "category": "odd"}]}',
        '{"flags": [{"severity": "INFO"}]}', '{"flags": [{"severity": "BAD", "summary": "s"}]}',
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(replies)], "i int, r string").select("i", judge.json_object("r").alias("o"), judge.judge_flags(F.col("r")).alias("f")).orderBy("i").collect()
    assert [r.o for r in df][:4] == ['{"flags": []}', '{"a": {"b": 1}}', None, None]
    assert [None if r.f is None else [tuple(x) for x in r.f] for r in df] == [[], None, None, None, [("dead_code", "WARNING", "s", None, "x"), ("other", "INFO", "t", None, None)], None, None]


def test_sentences_are_counted_as_made_and_formality_looks_once(spark):
    from pyspark.sql import functions as F

    from cohortlens.functions import text as T
    from cohortlens.plans.catalog import QUERIES

    odd = ["", " ", "...", "a", "a. b", " \n. b !\t?c . .", "x\n\ny...z ", ". ."]
    x = spark.createDataFrame([(t,) for t in odd], "text string")
    assert all(r.a == r.b for r in x.select(T.sentence_count(F.col("text")).alias("a"), F.size(T.sentences(F.col("text"))).alias("b")).collect())
    plan = QUERIES["formality_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("furthermore") == 1

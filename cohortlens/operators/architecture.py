"""Architecture rules as expressions over the members of types; all rules of one row are tested in one pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.text import glob_regex


@dataclass(frozen=True)
class Match:
    """Which types a rule is for; what is not given does not matter."""

    annotation: str | None = None
    extends: str | None = None
    implements: str | None = None
    package_glob: str | None = None
    name_suffix: str | None = None
    not_extends: str | None = None

    def condition(self) -> Column:
        base = F.regexp_replace(F.coalesce("extends", F.lit("")), "<.*", "")
        tests = [F.lit(True)]
        if self.annotation:
            tests.append(F.array_contains("owner_annotations", self.annotation))
        if self.extends:
            tests.append(base == self.extends)
        if self.implements:
            tests.append(F.exists("implements", lambda x: F.regexp_replace(x, "<.*", "") == self.implements))
        if self.package_glob:
            tests.append(F.replace(F.coalesce("package", F.lit("")), F.lit("."), F.lit("/")).rlike(glob_regex(self.package_glob).replace("/.*$", "(?:/.*)?$")))
        if self.name_suffix:
            tests.append(F.col("owner").endswith(self.name_suffix))
        if self.not_extends:
            tests.append(base != self.not_extends)
        return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class Rule:
    """kind: one of KINDS. regex is over the type, call, import, annotation or source text that the kind reads."""

    name: str
    kind: str
    severity: str = "WARNING"
    match: Match = Match()
    regex: str = ""
    modifier: str | None = None
    visibility: str | None = None
    args: int | None = None
    least_args: int | None = None
    most: int | None = None
    method: str | None = None
    annotation: str | None = None
    with_methods: bool = False


KINDS = (
    "forbidden_field_type", "forbidden_constructor_param", "forbidden_method_call", "forbidden_return_type", "max_method_statements", "forbidden_method_param", "forbidden_import", "must_null_in_lifecycle",
    "forbidden_call_source", "class_has_forbidden_annotation", "forbidden_annotation_source", "method_annotation_visibility_mismatch", "forbidden_constructor_call", "parameter_annotation_requires_companion",
    "field_count_with_type_pattern", "class_requires_annotation",
)


def _row_rule(r: Rule) -> tuple[Column, Column] | None:
    """(condition, offender) of a rule that one row decides; None for others."""
    kind, name, member = F.col("kind"), F.col("name"), F.col("member")
    typed, text = F.coalesce("type", F.lit("")).rlike(r.regex), F.coalesce("text", F.lit("")).rlike(r.regex)
    seen = F.lit(True) if r.visibility is None else F.col("visibility") == r.visibility
    own = lambda *parts: F.concat(F.col("owner"), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    any_note = F.exists("annotations", lambda a: a.rlike(r.regex))
    table = {
        "forbidden_field_type": lambda: ((kind == "field") & typed & (F.lit(True) if r.modifier is None else F.array_contains("modifiers", r.modifier)), own("::", F.col("type"))),
        "forbidden_constructor_param": lambda: ((kind == "parameter") & (F.col("text") == "constructor") & typed, own("::ctor(", F.col("type"), ")")),
        "forbidden_method_call": lambda: ((kind == "call") & name.rlike(r.regex) & (F.lit(True) if r.args is None else F.col("args") == r.args), own("::call(", name, ")")),
        "forbidden_return_type": lambda: ((kind == "method") & typed & seen, own("::return(", F.col("type"), ")")),
        "max_method_statements": lambda: ((kind == "method") & (F.col("statements") > (r.most or 0)), own("::", name, "#", F.col("statements").cast("string"), "stmts")),
        "forbidden_method_param": lambda: ((kind == "parameter") & (F.col("text") == "method") & typed & seen, own("::", member, "::param(", F.col("type"), ")")),
        "forbidden_import": lambda: ((kind == "import") & name.rlike(r.regex), name),
        "forbidden_call_source": lambda: ((kind == "call") & text, own("::", member, "::call-line-", F.col("line").cast("string"))),
        "class_has_forbidden_annotation": lambda: (
            any_note & ((kind == "type") | (F.lit(r.with_methods) & (kind == "method"))),
            F.when(kind == "type", own("::class-annot@L", F.col("line").cast("string"))).otherwise(own("::", name, "::annot@L", F.col("line").cast("string"))),
        ),
        "forbidden_annotation_source": lambda: (
            text & ((kind == "annotation") | (F.lit(r.with_methods) & (kind == "method_annotation"))),
            F.when(kind == "annotation", own("::class-annot-src@L", F.col("line").cast("string"))).otherwise(own("::", member, "::annot-src@L", F.col("line").cast("string"))),
        ),
        "method_annotation_visibility_mismatch": lambda: ((kind == "method") & any_note & ~seen, own("::", name, "::visibility-mismatch")),
        "forbidden_constructor_call": lambda: ((kind == "new") & typed & (F.col("args") >= (r.least_args or 0)), own("::new(", F.col("type"), ")")),
        "parameter_annotation_requires_companion": lambda: (
            (kind == "parameter") & F.array_contains("annotations", r.annotation or "") & ~any_note, own("::", member, "::param(", F.col("type"), ")::missing-", r.annotation or "", "-companion"),
        ),
    }
    return table[r.kind]() if r.kind in table else None


def _type_rule(members: DataFrame, r: Rule) -> DataFrame:
    """Violations of a rule that a type's members decide together."""
    x = members.filter(r.match.condition())
    typed = F.coalesce("type", F.lit("")).rlike(r.regex or "$^")
    key = ["path", "owner"]
    if r.kind == "field_count_with_type_pattern":
        n = x.groupBy(*key).agg(F.count_if((F.col("kind") == "field") & typed).alias("n"), F.min(F.when(F.col("kind") == "type", F.col("line"))).alias("line")).filter(F.col("n") > (r.most or 0))
        return n.select("path", F.concat("owner", F.lit("::field-count::"), F.col("n").cast("string"), F.lit(f">{r.most}")).alias("offender"), "line", F.col("line").alias("end_line"))
    if r.kind == "class_requires_annotation":
        trigger = F.bool_or((F.col("kind") == "constructor") & F.array_contains("annotations", r.annotation or ""))
        n = x.groupBy(*key).agg(trigger.alias("trigger"), F.bool_or(F.array_contains("owner_annotations", r.method or "")).alias("has"), F.min(F.when(F.col("kind") == "type", F.col("line"))).alias("line"))
        return n.filter("trigger and not has").select("path", F.concat("owner", F.lit(f"::missing-{r.method}")).alias("offender"), "line", F.col("line").alias("end_line"))
    cleared = x.filter((F.col("kind") == "method") & (F.col("name") == r.method)).groupBy(*[F.col(k).alias(f"{k}_") for k in key]).agg(F.flatten(F.collect_list("nulls")).alias("nulled"))
    f = x.filter((F.col("kind") == "field") & typed).join(cleared, [F.col(k) == F.col(f"{k}_") for k in key], "left")
    missing = F.col("nulled").isNull()
    offender = F.concat("owner", F.lit("::"), "name", F.when(missing, f"::no-{r.method}").otherwise("::not-nulled"))
    return f.filter(missing | ~F.expr("array_contains(nulled, name)")).select("path", offender.alias("offender"), "line", "end_line")


def violations(members: DataFrame, rules: list[Rule]) -> DataFrame:
    """path, rule_name, rule_kind, severity, offender, line, end_line. members: as from sources.members."""
    unknown = [r.kind for r in rules if r.kind not in KINDS]
    if unknown:
        raise ValueError(f"unknown kinds: {unknown}")
    hits, out = [], []
    for r in rules:
        found = _row_rule(r)
        label = [F.lit(r.name).alias("rule_name"), F.lit(f"ast_{r.kind}").alias("rule_kind"), F.lit(r.severity).alias("severity")]
        if found:
            condition, offender = found
            fits = condition & (F.lit(True) if r.kind == "forbidden_import" and r.match == Match() else r.match.condition())
            hits.append(F.when(F.coalesce(fits, F.lit(False)), F.struct(*label, offender.alias("offender"))))
        else:
            out.append(_type_rule(members, r).select("path", *label, "offender", "line", "end_line"))
    if hits:
        raised = members.withColumn("v", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))
        out.append(raised.select("path", "v.rule_name", "v.rule_kind", "v.severity", "v.offender", "line", "end_line"))
    if not out:
        raise ValueError("no rules")
    return reduce(DataFrame.unionByName, out)

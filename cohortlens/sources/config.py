"""Settings read on the driver: rules, rubrics, grade specs, ridge heads, limits. Small files of a course, never data."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from cohortlens.operators.architecture import Match, Rule


@dataclass(frozen=True)
class Rubric:
    version: str
    body: str
    body_hash: str


def rubric(text: str) -> Rubric:
    """Markdown with optional front matter between --- lines; the hash ignores white space at the ends of lines and of the text, so that it names the content."""
    m = re.match(r"\A---\n(.*?)\n---\n?(.*)\Z", text.replace("\r\n", "\n"), re.S)
    front, body = m.groups() if m else ("", text.replace("\r\n", "\n"))
    version = re.search(r"^version:\s*[\"']?([^\"'\n]+?)[\"']?\s*$", front, re.M)
    plain = "\n".join(line.rstrip() for line in body.strip().split("\n"))
    return Rubric(version[1] if version else "0", body.strip(), hashlib.sha256(plain.encode()).hexdigest())


@dataclass(frozen=True)
class Architecture:
    layers: list[tuple[str, str]]  # layer, package glob
    allowed: list[tuple[str, str]]  # layer, layer that it may use
    forbidden: list[tuple[str, str, str]]  # name, from glob, forbidden glob
    rules: list[Rule]


def architecture(text: str) -> Architecture:
    """TOML with [[layers]] (name, packages, may_depend_on), [[forbidden]] (name, from, must_not_match) and [[ast_rule]] (name, kind, class_match, and what the kind reads)."""
    raw = tomllib.loads(text)
    severity = raw.get("severity", "WARNING")
    layers = [(x["name"], p) for x in raw.get("layers", []) for p in x.get("packages", [])]
    allowed = [(x["name"], y) for x in raw.get("layers", []) for y in x.get("may_depend_on", [])]
    forbidden = [(x["name"], x["from"], p) for x in raw.get("forbidden", []) for p in x.get("must_not_match", [])]
    known = {f.name for f in fields(Match)}
    rules = []
    for x in raw.get("ast_rule", []):
        regex = next((x[k] for k in ("type_regex", "call_regex", "import_regex", "annotation_regex", "source_regex", "regex", "required_annotation_regex") if k in x), "")
        rules.append(Rule(
            x["name"], x["kind"], x.get("severity", severity), Match(**{k: v for k, v in x.get("class_match", {}).items() if k in known}), regex, x.get("required_modifier"), x.get("visibility") or x.get("required_visibility"),
            x.get("arg_count"), x.get("min_args"), x.get("max"), x.get("method_name") or x.get("required_annotation"), x.get("trigger_annotation") or x.get("trigger_constructor_annotation"), x.get("scope") == "class_or_method",
        ))
    return Architecture(layers, allowed, forbidden, rules)


@dataclass(frozen=True)
class RidgeHead:
    intercept: float
    coefficients: list[float]


def ridge_head(text: str) -> RidgeHead:
    raw = json.loads(text)
    return RidgeHead(float(raw["intercept"]), [float(v) for v in raw["coefficients"]])


@dataclass(frozen=True)
class GradeSpec:
    weights: dict[str, float]
    anchors: dict[str, tuple[float, float]]
    formulas: dict[str, list[tuple[str, object]]]  # scope -> named trees for operators.grading


def _tree(x: object) -> object:
    """A JSON formula (number, variable name, or an object of one operator and its arguments) as a tree of operators.grading."""
    if isinstance(x, dict):
        (op, args), = x.items()
        if op in ("num", "var"):
            return args
        names = {"add": "+", "sub": "-", "mul": "*", "div": "/"}
        return (names.get(op, op), *[_tree(a) for a in (args if isinstance(args, list) else list(args.values()))])
    return x


def grade_spec(text: str) -> GradeSpec:
    raw = json.loads(text)
    anchors = {k: (float(v["floor"]), float(v["ceiling"])) for k, v in raw.get("anchors", {}).items()}
    formulas = {scope: [(f["name"], _tree(f["expr"])) for f in fs] for scope, fs in raw.get("formulas", {}).items()}
    return GradeSpec({k: float(v) for k, v in raw.get("weights", {}).items()}, anchors, formulas)


def load(path: str, parse):
    """A settings file, parsed."""
    return parse(Path(path).read_text(encoding="utf-8"))


def merged(defaults: dict, *overrides: dict) -> dict:
    """Nested settings, later ones first."""
    out = dict(defaults)
    for o in overrides:
        for k, v in o.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out

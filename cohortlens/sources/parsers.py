"""Parsers of tool outputs, as column expressions or table functions over one text per row."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SARIF_SCHEMA = (
    "struct<runs:array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,defaultConfiguration:struct<level:string>>>>>,"
    "results:array<struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>>>>>"
)


def sarif(df: DataFrame, text: str) -> DataFrame:
    """A row for each result of SARIF 2.1.0 texts: all columns of df but the text, then tool, rule, severity, message, path, start_line, end_line. Malformed text gives none."""
    rest = [c for c in df.columns if c != text]
    run = df.select(*rest, F.explode(F.from_json(F.col(text), SARIF_SCHEMA)["runs"]).alias("run"))
    # A run's parts are named before its results are told apart, so that no row of them holds the run.
    run = run.select(*rest, F.col("run.tool.driver.name").alias("tool"), F.col("run.tool.driver.rules").alias("rules"), F.col("run.results").alias("results"))
    r = run.select(*rest, "tool", "rules", F.explode("results").alias("r"))
    rule = F.coalesce(F.col("r.ruleId"), F.get(F.col("rules.id"), F.col("r.ruleIndex")))
    default = F.get(F.filter("rules", lambda x: x["id"] == rule), F.lit(0))["defaultConfiguration"]["level"]
    level = F.coalesce(F.col("r.level"), F.when(F.size("rules") > 0, default), F.lit("warning"))
    at = F.get(F.col("r.locations"), F.lit(0))["physicalLocation"]
    severity = F.when(level == "error", "CRITICAL").when(level == "warning", "WARNING").otherwise("INFO")
    uri = F.regexp_replace(at["artifactLocation"]["uri"], "^file:(//)?", "")
    return r.select(*rest, "tool", rule.alias("rule"), severity.alias("severity"), F.col("r.message.text").alias("message"), uri.alias("path"), at["region"]["startLine"].alias("start_line"), F.coalesce(at["region"]["endLine"], at["region"]["startLine"]).alias("end_line"))


def mutation_totals(xml: Column) -> dict[str, Column]:
    """total, killed and not viable mutations of a mutation report, and the score killed / (total - not viable), null if there are none."""
    status = F.xpath(xml, F.lit("/mutations/mutation/@status"))
    killed = F.size(F.filter(F.xpath(xml, F.lit("/mutations/mutation/@detected")), lambda d: d == "true"))
    void = F.size(F.filter(status, lambda s: s == "NON_VIABLE"))
    left = F.size(status) - void
    return {"total": F.size(status), "killed": killed, "non_viable": void, "score": F.when(left > 0, killed / F.when(left > 0, left))}


def _lines(df: DataFrame, text: str, parse, fields: str) -> DataFrame:
    rest = [c for c in df.columns if c != text]
    kinds = dict(df.dtypes)

    def run(batches):
        for pdf in batches:
            rows = [(*[row[c] for c in rest], *found) for row in pdf.to_dict("records") for found in parse(row[text] or "")]
            yield pd.DataFrame(rows, columns=[*rest, *[f.split()[0] for f in fields.split(", ")]])

    return df.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], fields]))


def diff_lines(df: DataFrame, text: str) -> DataFrame:
    """A row for each removed or added line of unified diffs: path, hunk, sign, position (in its hunk and sign), line_no, line. Rows with one (hunk, position) pair removed with added lines."""

    def parse(diff: str):
        path, hunk, old, new, left, count = None, -1, 0, 0, [0, 0], {"-": 0, "+": 0}
        for line in diff.split("\n"):
            if left[0] > 0 or left[1] > 0:
                sign = line[:1]
                if sign in ("-", "+"):
                    yield path, hunk, sign, count[sign], old if sign == "-" else new, line[1:]
                    count[sign] += 1
                old, new = old + (sign in "- "), new + (sign in "+ ")
                left = [left[0] - (sign in "- "), left[1] - (sign in "+ ")]
            elif line.startswith("+++ "):
                path = re.sub(r"^b/", "", line[4:].split("\t")[0])
                hunk = -1
            elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
                old, new = int(m[1]), int(m[3])
                left, hunk, count = [int(m[2] or 1), int(m[4] or 1)], hunk + 1, {"-": 0, "+": 0}

    return _lines(df, text, parse, "path string, hunk int, sign string, position int, line_no int, line string")


def blame_lines(df: DataFrame, text: str) -> DataFrame:
    """A row for each line of porcelain blame output: line_no, commit, author_email, author_time, line."""

    def parse(blame: str):
        known: dict[str, dict[str, str]] = {}
        commit, number = "", 0
        for line in blame.split("\n"):
            if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", line):
                commit, number = m[1], int(m[2])
                known.setdefault(commit, {})
            elif line.startswith("\t"):
                k = known[commit]
                yield number, commit, k.get("author-mail", "").strip("<>") or None, int(k["author-time"]) if "author-time" in k else None, line[1:]
            elif commit and " " in line:
                key, value = line.split(" ", 1)
                known[commit][key] = value

    return _lines(df, text, parse, "line_no int, commit string, author_email string, author_time bigint, line string")


def next_link(header: Column) -> Column:
    """The rel="next" address of a Link header; null without one."""
    return F.nullif(F.regexp_extract(header, r'<([^>]*)>\s*;[^,]*rel="?next"?', 1), F.lit(""))

"""Replies of a judge: the JSON object in prose, and the flags in it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a flag may be about, and how severe it may be.
CATEGORIES = ("readability", "error_handling", "testing", "complexity", "duplication", "naming", "validation", "dead_code", "other")
SEVERITIES = ("INFO", "WARNING", "CRITICAL")


def _object(text: str | None) -> str | None:
    if text is None:
        return None
    plain = text.strip()
    fenced = plain.removeprefix("```json").removeprefix("```").removesuffix("```").strip()

    def parsed(s: str) -> bool:
        try:
            return isinstance(json.loads(s), dict)
        except ValueError:
            return False

    for s in (fenced, plain):
        if parsed(s):
            return s
    depth, start = 0, 0
    for i, ch in enumerate(text):
        if ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0 and parsed(text[start : i + 1]):
                return text[start : i + 1]
    return None


@F.pandas_udf(StringType())
def json_object(reply: pd.Series) -> pd.Series:
    """The reply itself, without a code fence, if it is a JSON object; else its first balanced {...} that is one; else null."""
    return reply.map(_object)


def judge_flags(reply: Column) -> Column:
    """array<struct<category, severity, summary, detail, student_id>> of a reply's flags; null without an object that holds them, or if one has no summary or an unknown severity. Unknown categories are other; texts are trimmed, empty ones null."""
    shape = "struct<flags:array<struct<category:string,severity:string,summary:string,detail:string,student_id:string>>>"
    flags = F.from_json(json_object(reply), shape)["flags"]
    clean = lambda x: F.nullif(F.trim(x), F.lit(""))

    def one(f: Column) -> Column:
        category = F.replace(F.lower(F.trim(F.coalesce(f["category"], F.lit("other")))), F.lit("-"), F.lit("_"))
        return F.struct(F.when(category.isin(*CATEGORIES), category).otherwise("other").alias("category"), F.upper(F.trim(f["severity"])).alias("severity"), *[clean(f[k]).alias(k) for k in ("summary", "detail", "student_id")])

    made = F.transform(flags, one)
    bad = F.exists(made, lambda f: f["summary"].isNull() | f["severity"].isNull() | ~f["severity"].isin(*SEVERITIES))
    return F.when(~bad, made)

"""Style features of source files, from the scanner's tokens; a style score; baselines by author and distances from them."""

from __future__ import annotations

import statistics
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.sources.code import KEYWORDS, Token, _closing, _explode, methods, nesting, scan

_FIELDS = {
    "avg_identifier_length": "double", "identifier_length_sd": "double", "camelcase_ratio": "double", "screaming_snake_ratio": "double", "single_char_ratio": "double", "max_identifier_length": "int",
    "comment_density": "double", "avg_comment_length": "double", "inline_ratio": "double", "javadoc_ratio": "double", "comment_to_code_ratio": "double",
    "avg_method_length": "double", "method_length_sd": "double", "avg_parameters": "double", "avg_nesting": "double", "max_nesting": "int",
    "try_density": "double", "empty_catch_ratio": "double", "avg_catch_lines": "double",
    "import_count": "int", "wildcard_import_ratio": "double", "imports_sorted": "boolean",
    "blank_line_ratio": "double", "documented": "boolean", "null_checked": "boolean", "uniform_indent": "boolean",
}
NUMERIC = [k for k, v in _FIELDS.items() if v != "boolean"]


def _mean(xs) -> float:
    xs = list(xs)
    return sum(xs) / len(xs) if xs else 0.0


def _sd(xs: list[int]) -> float:
    return statistics.stdev(xs) if len(xs) > 1 else 0.0


def _naming(code: list[Token]) -> dict:
    names = [x.text for x in code if x.kind == "word" and x.text not in KEYWORDS]
    sizes = [len(n) for n in names]
    return {
        "avg_identifier_length": _mean(sizes),
        "identifier_length_sd": _sd(sizes),
        "camelcase_ratio": _mean(n[0].islower() and not n.islower() and "_" not in n for n in names),
        "screaming_snake_ratio": _mean(len(n) > 1 and n.isupper() for n in names),
        "single_char_ratio": _mean(s == 1 for s in sizes),
        "max_identifier_length": max(sizes, default=0),
    }


def _comments(tokens: list[Token], code: list[Token], lines: list[str]) -> dict:
    found = [x for x in tokens if x.kind == "comment"]
    spread = {n for x in found for n in range(x.line, x.line + x.text.count("\n") + 1)}
    filled = {n for x in code for n in range(x.line, x.line + x.text.count("\n") + 1)}
    return {
        "comment_density": len(spread) / len(lines),
        "avg_comment_length": _mean(len(x.text) for x in found),
        "inline_ratio": _mean(x.text.startswith("//") for x in found),
        "javadoc_ratio": _mean(x.text.startswith("/**") for x in found),
        "comment_to_code_ratio": len(spread) / len(filled) if filled else 0.0,
    }


def _handling(code: list[Token], n_lines: int) -> dict:
    bodies = []
    for i, x in enumerate(code):
        opening = next((j for j in range(i, len(code)) if code[j].text == "{"), None) if x.kind == "word" and x.text == "catch" else None
        end = _closing(code, opening, "{", "}") if opening is not None else None
        if end is not None:
            bodies.append(len({y.line for y in code[opening + 1 : end]}))
    tries = sum(x.kind == "word" and x.text == "try" for x in code)
    return {"try_density": tries / n_lines, "empty_catch_ratio": _mean(b == 0 for b in bodies), "avg_catch_lines": _mean(bodies)}


def _imports(code: list[Token]) -> dict:
    names = []
    for i, x in enumerate(code):
        if x.kind == "word" and x.text == "import" and (i == 0 or code[i - 1].text in (";", "}")):
            end = next((j for j in range(i, len(code)) if code[j].text == ";"), len(code))
            names.append("".join(y.text for y in code[i + 1 : end] if y.text != "static"))
    return {"import_count": len(names), "wildcard_import_ratio": _mean(n.endswith(".*") for n in names), "imports_sorted": names == sorted(names)}


def _layout(lines: list[str]) -> dict:
    steps = [len(s) - len(s.lstrip(" ")) for s in lines if s.startswith(" ") and s.strip()]
    return {"blank_line_ratio": _mean(not s.strip() for s in lines), "uniform_indent": len(steps) >= 5 and _mean(s % min(steps) == 0 for s in steps) > 0.9}


def features_of(source: str) -> dict:
    tokens, lines = scan(source), source.split("\n")
    code = [x for x in tokens if x.kind != "comment"]
    found = methods(tokens)
    lengths, depths = [m.end - m.start + 1 for m in found], [nesting(m.tokens)[0] for m in found]
    docs = sum(x.text.startswith("/**") for x in tokens if x.kind == "comment")
    checks = sum(x.text == "null" and i > 0 and code[i - 1].text in ("==", "!=") for i, x in enumerate(code))
    shape = {"avg_method_length": _mean(lengths), "method_length_sd": _sd(lengths), "avg_parameters": _mean(m.parameters for m in found), "avg_nesting": _mean(depths), "max_nesting": max(depths, default=0)}
    marks = {"documented": bool(found) and docs >= len(found), "null_checked": bool(found) and checks >= len(found)}
    return _naming(code) | _comments(tokens, code, lines) | shape | _handling(code, len(lines)) | _imports(code) | _layout(lines) | marks


def style_features(df: DataFrame, text: str) -> DataFrame:
    """A row for each row of df: its columns but the text, then 26 features of the file. Null text counts as empty: ratios, means and counts are 0, and having no imports counts as sorted."""

    def rows(source: str):
        f = features_of(source)
        yield tuple(f[k] for k in _FIELDS)

    return _explode(df, text, rows, ", ".join(f"{k} {v}" for k, v in _FIELDS.items()))


def style_score() -> Column:
    """0 to 1 from the feature columns: bonuses for even methods, sorted imports, documentation, null checks, many comments, long names and catch blocks, no empty ones, and even indents."""
    c = F.col
    bonus = [
        ((c("avg_method_length") > 0) & (c("method_length_sd") < 5), 0.15), (c("imports_sorted"), 0.10), (c("documented"), 0.15), (c("null_checked"), 0.10), (c("comment_density") > 0.3, 0.10),
        (c("avg_identifier_length") > 15, 0.10), (c("avg_catch_lines") > 3, 0.10), (c("empty_catch_ratio") < 0.1, 0.10), (c("uniform_indent"), 0.10),
    ]
    return F.round(reduce(lambda a, b: a + b, [F.when(on, w).otherwise(0.0) for on, w in bonus]), 6)


def baselines(features: DataFrame, author: str, columns: list[str] = NUMERIC) -> DataFrame:
    """By author and feature: n, mean, sd (of a sample; 0 for one file). Nulls do not count."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).cast("double").alias("value")) for k in columns]))
    x = features.select(author, each.alias("e")).select(author, "e.*").filter("value is not null")
    return x.groupBy(author, "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))


def deviation(features: DataFrame, author: str, key: str, base: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """By author and key (a file): the mean of |z| over the features whose baseline varies; null if none does, or the author has no baseline."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).cast("double").alias("value")) for k in columns]))
    x = features.select(author, key, each.alias("e")).select(author, key, "e.*")
    b = base.select(F.col(author).alias("__a"), F.col("feature").alias("__f"), "mean", "sd")
    x = x.join(b, (F.col(author) == F.col("__a")) & (F.col("feature") == F.col("__f")), "left")
    return x.groupBy(author, key).agg(F.avg(F.when(F.col("sd") > 0, F.abs(F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")))).alias("deviation"))

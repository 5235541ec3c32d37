"""A formula engine: expression trees compiled to columns, evaluated in order with all intermediates kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import clamp, safe_divide

#: A formula is a number, a variable name, or (operator, arguments...): + - * / min max clamp pow.
Formula = float | int | str | tuple


def compile_formula(f: Formula) -> Column:
    if isinstance(f, (int, float)):
        return F.lit(float(f))
    if isinstance(f, str):
        return F.col(f).cast("double")
    op, *args = f
    x = [compile_formula(a) for a in args]
    if op in ("min", "max"):
        return (F.least if op == "min" else F.greatest)(*x)
    if op == "clamp":
        return clamp(x[0], float(args[1]), float(args[2]))
    if op == "pow":
        return F.pow(x[0], x[1])
    if op == "/":
        return safe_divide(x[0], x[1])
    return reduce({"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__}[op], x)


def free_variables(f: Formula) -> set[str]:
    if isinstance(f, str):
        return {f}
    return set().union(*map(free_variables, f[1:])) if isinstance(f, tuple) else set()


def explain(f: Formula) -> str:
    if not isinstance(f, tuple):
        return str(f)
    op, *args = f
    inner = [explain(a) for a in args]
    return f"({f' {op} '.join(inner)})" if op in "+-*/" else f"{op}({', '.join(inner)})"


def evaluate(df: DataFrame, formulas: list[tuple[str, Formula]]) -> DataFrame:
    """Adds a column for each named formula; later ones may use earlier ones."""
    for name, f in formulas:
        missing = free_variables(f) - set(df.columns)
        if missing:
            raise ValueError(f"{name} uses unknown variables: {sorted(missing)}")
        df = df.withColumn(name, compile_formula(f))
    return df


def keep_factor(model: Column, level: Column, alpha: float, floor: float) -> Column:
    """1 - (1 - floor) * alpha * model * level: how much of the points a declared use of help keeps."""
    return 1 - (1 - floor) * alpha * model * level


def penalty(own: Column, team: Column, own_cap: float, team_cap: float) -> Column:
    """80 % of a signal falls on its author and 20 % on the team, each capped."""
    return F.least(0.8 * own, F.lit(own_cap)) + F.least(0.2 * team, F.lit(team_cap))

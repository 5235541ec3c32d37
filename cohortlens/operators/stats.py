"""Statistics by group, each as one aggregation (or one window) over the group's rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import safe_divide
from cohortlens.sources.scratch import written


def _joined(df: DataFrame, other: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of other, one row for each key; null keys are keys too."""
    keys = {c: f"{c}__k" for c in by}
    other = other.withColumnsRenamed(keys)
    match = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return df.join(other, match or F.lit(True), how).drop(*keys.values())


def joined_by_size(df: DataFrame, other: DataFrame, by: list[str], size: str) -> DataFrame:
    """As _joined, where ``size`` of other tells how many rows of df a key has. Keys of a thousandth of all rows or more, so a thousand of them at most, are broadcast, and their rows are dealt out by a hash of the row: no group, however large, is one task's rows."""
    other = written(other.withColumn("__none", F.lit(0).cast("bigint")))
    total = other.agg(F.sum(size)).first()[0] or 0
    frequent = F.col(size) * 1000 >= F.lit(total)
    value = F.struct(*[c for c in other.columns if c not in (*by, "__none")])
    hot = other.filter(frequent).select(*[F.col(c).alias(f"{c}__h") for c in by], value.alias("__hot"))
    cold = other.filter(~frequent).select(*[F.col(c).alias(f"{c}__k") for c in by], "__none", value.alias("__cold"))
    x = df.join(F.broadcast(hot), [F.col(c).eqNullSafe(F.col(f"{c}__h")) for c in by], "left")
    row = [c for c, kind in df.dtypes if "map<" not in kind]
    x = x.withColumn("__deal", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*row), F.lit(997)) + 1).otherwise(F.lit(0)).cast("bigint"))
    x = x.join(cold, [*[F.col(c).eqNullSafe(F.col(f"{c}__k")) for c in by], F.col("__deal") == F.col("__none")], "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    return x.filter("__found is not null").select(*df.columns, "__found.*")


def positions(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """by, x, c, before, n: each distinct value that is not null with its rows, the rows of its group below it, and those of the whole group. A row stands for ``weight`` rows, if given.

    Distinct values are counted, then dealt out by range of (by, x), so that a group, however large, takes as many cells as it
    needs. A sum inside the cell and one over a group's cells (as many as there are tasks, at most) give the place; no
    window holds a group. The cells are written, as sums over both must see the same ones."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("x")).agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    dealt = written(counts.repartitionByRange(*by, "x").withColumn("cell", F.spark_partition_id()))
    cells = dealt.groupBy(*by, "cell").agg(F.sum("c").alias("cn"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    below = F.sum("cn").over(group.orderBy("cell")) - F.col("cn")
    cells = cells.select(*by, "cell", below.alias("below"), F.sum("cn").over(group).alias("n"))
    inside = F.sum("c").over(Window.partitionBy(*by, "cell").orderBy("x")) - F.col("c")
    x = _joined(dealt.withColumn("inside", inside), cells, [*by, "cell"])
    return x.select(*by, "x", "c", (F.col("below") + F.col("inside")).alias("before"), "n")


def _at(place: Column) -> Column:
    """Aggregate over ``positions``: the value at a place (from 0) of the sorted group."""
    return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col("x")))


def inequality(df: DataFrame, by: list[str], value: str, least: int = 2) -> DataFrame:
    """gini, hoover, cv, max_min_ratio of value by group; groups of under ``least`` rows are left out. All are 0 for an all-zero group; the ratio is infinite for a zero minimum under a positive maximum."""
    p = positions(df.select(*by, F.col(value).cast("double").alias("__x")), by, "__x")
    c, x = F.col("c"), F.col("x")
    # c equal values take the places before + 1 to before + c.
    places = c * F.col("before") + c * (c + 1) / 2
    a = p.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(c * x).alias("s"), F.sum(x * places).alias("xi"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    mean = a.select(*by, (F.col("s") / F.col("n")).alias("mu"))
    off = x - F.col("mu")
    spread = _joined(p, mean, by).groupBy(*by).agg(F.sum(c * F.abs(off)).alias("d"), F.sum(c * off * off).alias("ss"), F.first("mu").alias("mu"))
    n, s = F.col("n"), F.col("s")
    return _joined(a, spread, by).filter(n >= least).select(
        *by,
        n.alias("n"),
        safe_divide(2 * F.col("xi") - (n + 1) * s, n * s).alias("gini"),
        safe_divide(F.col("d"), 2 * s).alias("hoover"),
        safe_divide(F.sqrt(F.col("ss") / n), F.col("mu")).alias("cv"),
        F.when((F.col("lo") == 0) & (F.col("hi") > 0), F.lit(float("inf"))).when(F.col("hi") == 0, F.lit(0.0)).otherwise(F.col("hi") / F.when(F.col("lo") != 0, F.col("lo"))).alias("max_min_ratio"),
    )


def scaled(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """df with <value>_scaled for each of values: its z-score in the group, scaled to 0..1 over it; 0.5 in a constant group. Scaling undoes the z-score's own scale, so a group's extremes suffice; they are joined, so no group is one task's window."""
    ends = df.groupBy(*by).agg(*[f(v).alias(f"__{name}_{v}") for v in values for name, f in (("lo", F.min), ("hi", F.max))])
    x = _joined(df, ends, by)
    place = lambda v: (F.col(v) - F.col(f"__lo_{v}")) / F.when(F.col(f"__hi_{v}") != F.col(f"__lo_{v}"), F.col(f"__hi_{v}") - F.col(f"__lo_{v}"))
    return x.select(*df.columns, *[F.when(F.col(f"__hi_{v}") == F.col(f"__lo_{v}"), F.lit(0.5)).otherwise(place(v)).alias(f"{v}_scaled") for v in values])


def zscores(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """df with <value>_z for each of values: (x - mean) / population deviation in the group; null where the deviation is 0."""
    moments = df.groupBy(*by).agg(*[f(v).alias(f"__{name}_{v}") for v in values for name, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    x = _joined(df, moments, by)
    return x.select(*df.columns, *[((F.col(v) - F.col(f"__mu_{v}")) / F.when(F.col(f"__sd_{v}") > 0, F.col(f"__sd_{v}"))).alias(f"{v}_z") for v in values])


def quantiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, upper median (item n // 2), linear p10 and p90, and the positional quarter by group."""
    place = lambda p: p * (F.col("n") - 1)
    low, high = (lambda p: _at(F.floor(place(p)))), (lambda p: _at(F.ceil(place(p))))
    found = {name: low(p) + (high(p) - low(p)) * F.max(place(p) - F.floor(place(p))) for name, p in {"median": 0.5, "p10": 0.1, "p90": 0.9}.items()}
    return positions(df, by, value).groupBy(*by).agg(
        found["median"].alias("median"), _at(F.floor(F.col("n") / 2)).alias("upper_median"), found["p10"].alias("p10"), found["p90"].alias("p90"), _at(F.floor(F.col("n") / 4)).alias("quarter"),
    )


def _medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """By group: the median under ``name``, the mean and n of the values that are not null."""
    p = positions(df.select(*by, F.col(value).cast("double").alias("__x")), by, "__x")
    middle = (_at(F.floor((F.col("n") - 1) / 2)) + _at(F.floor(F.col("n") / 2))) / 2
    return p.groupBy(*by).agg(middle.alias(name), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("n"))


def mad_outliers(df: DataFrame, by: list[str], value: str, threshold: float = 3.0, least: int = 3) -> DataFrame:
    """All rows of groups of ``least`` rows with median, scale and z; outlier where |z| > threshold. The scale is the median absolute deviation, the mean one if that is 0; z is null if both are."""
    med = _medians(df, by, value, "median").filter(F.col("n") >= least).drop("mean")
    x = joined_by_size(df, med, by, "n").withColumn("dev", F.abs(F.col(value) - F.col("median")))
    scale = _medians(x, by, "dev", "mad").select(*by, F.coalesce(F.nullif("mad", F.lit(0.0)), F.nullif("mean", F.lit(0.0))).alias("scale"), F.col("n").alias("__size"))
    x = joined_by_size(x, scale, by, "__size").drop("dev", "__size").withColumn("z", (F.col(value) - F.col("median")) / F.col("scale"))
    return x.withColumn("outlier", F.coalesce(F.abs("z") > threshold, F.lit(False)))


def backoff_outliers(df: DataFrame, levels: list[list[str]], value: str, least: int = 4, threshold: float = 3.0) -> DataFrame:
    """Each row is judged in its first level of grouping with ``least`` rows; level is its place in ``levels``. An empty level is the whole table. Rows that no level suits stay, with null level, median, scale and z."""
    columns, out = df.columns, None
    whole = df.withColumn("__all", F.lit(1))
    rest = whole
    for i, by in enumerate(levels):
        by = by or ["__all"]
        sized = _joined(rest, whole.groupBy(*by).agg(F.count("*").alias("__n")), by)
        judged = mad_outliers(whole, by, value, threshold, 1).groupBy(*by).agg(F.first("median").alias("median"), F.first("scale").alias("scale"))
        got = _joined(sized.filter(F.col("__n") >= least).drop("__n"), judged, by, "left")
        got = got.withColumn("z", (F.col(value) - F.col("median")) / F.col("scale")).withColumn("level", F.lit(i))
        out = got if out is None else out.unionByName(got)
        rest = sized.filter(F.col("__n") < least).drop("__n")
    left = rest.withColumns({c: F.lit(None).cast("double") for c in ("median", "scale", "z")}).withColumn("level", F.lit(None).cast("int"))
    out = left if out is None else out.unionByName(left)
    return out.select(*columns, "median", "scale", "z", "level", F.coalesce(F.abs("z") > threshold, F.lit(False)).alias("outlier"))


def trend(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Least-squares slope and R^2 of value on its index 0, 1, .. by order, with n."""
    w = Window.partitionBy(*by).orderBy(order)
    x = df.select(*by, (F.row_number().over(w) - 1).cast("double").alias("i"), F.col(value).cast("double").alias("y"))
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "i").alias("slope"), F.regr_r2("y", "i").alias("r2"), safe_divide(F.stddev_pop("y"), F.avg("y")).alias("cv"))


def entropy(df: DataFrame, by: list[str], kind: str, bins: int) -> DataFrame:
    """Shannon entropy of the kinds of a group over log2(bins), 0..1."""
    c = df.groupBy(*by, kind).agg(F.count("*").alias("c"))
    t = c.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("cl"))
    return t.select(*by, "n", ((F.log2("n") - F.col("cl") / F.col("n")) / F.log2(F.lit(bins))).alias("entropy"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of w x over sum of w, weight 1 if null and at least 0, over rows with a value."""
    w = F.when(value.isNotNull(), F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(0.0)))
    return safe_divide(F.sum(value * w), F.sum(w), None)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series ten steps up, where it holds to 14 digits, then down by the recurrence."""
    up = 10
    z = x + up
    # Coefficients of Stirling's series, from Bernoulli numbers.
    series = reduce(lambda a, b: a + b, [F.lit(c) / F.pow(z, k) for c, k in ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7), (1 / 1188, 9))])
    steps = reduce(lambda a, b: a * b, [x + k for k in range(up)])
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function by its continued fraction, folded over as many terms as a and b need (some roots of them), on the side where it converges."""
    swap = x > (a + 1) / (a + b + 2)
    named = F.struct(F.when(swap, 1 - x).otherwise(x).alias("x"), F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"))

    def part(v: Column) -> Column:
        x, a, b = v["x"], v["a"], v["b"]
        safe = lambda y: F.when(F.abs(y) < 1e-300, 1e-300).otherwise(y)

        def step(at: Column, i: Column) -> Column:
            m = F.floor(i / 2).cast("double")
            term = F.when(i == 0, 1.0).when(i % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
            d, c = 1 / safe(1 + term * at["d"]), safe(1 + term / at["c"])
            return F.struct((at["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"))

        terms = F.sequence(F.lit(0), (80 + 8 * F.sqrt(F.greatest(a, b))).cast("int"))
        start = F.struct(F.lit(1.0).alias("f"), F.lit(1.0).alias("c"), F.lit(0.0).alias("d"))
        f = F.aggregate(terms, start, step, lambda at: at["f"] - 1)
        front = F.exp(a * F.log(x) + b * F.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
        return F.when(x <= 0, 0.0).otherwise(front * f)

    # The arguments are computed once, in a list of one.
    tail = F.transform(F.array(named), part)[0]
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(swap, 1 - tail).otherwise(tail)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; NaN without degrees of freedom or for a t that isn't finite."""
    df, bad = df.cast("double"), F.isnan(t) | (F.abs(t) == float("inf")) | (df <= 0)
    return F.when(bad, float("nan")).otherwise(incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5)))


def slope_p_value(r2: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of a least-squares slope, from R^2 and the number of points: 0.5 under two points, 0 for a perfect fit, which two points and equal values always have."""
    r2, n = (F.col(v) if isinstance(v, str) else v for v in (r2, n))
    n, x = n.cast("double"), 1 - r2.cast("double")
    tail = incomplete_beta(F.least(x, F.lit(1.0)), (n - 2) / 2, F.lit(0.5))
    return F.when(n < 2, 0.5).when((n > 2) & (x > 1e-15), tail).otherwise(0.0)


def trajectory(df: DataFrame, by: list[str], order: str, value: str, low: float = 0.20, high: float = 0.40, p: float = 0.15) -> DataFrame:
    """trend() with p_value and class: insufficient_data under two points, steady under a variation of ``low``, growing or declining by a slope with a p-value under ``p``, sporadic over ``high``, else steady."""
    t = trend(df, by, order, value).withColumn("p_value", slope_p_value("r2", "n"))
    sure = F.col("p_value") < p
    kind = F.when(F.col("n") < 2, "insufficient_data").when(F.col("cv") < low, "steady").when((F.col("slope") > 0) & sure, "growing").when((F.col("slope") < 0) & sure, "declining").when(F.col("cv") > high, "sporadic").otherwise("steady")
    return t.withColumn("class", kind)


def average_ranks(df: DataFrame, value: str, name: str, weight: str | None = None) -> DataFrame:
    """Ranks from 1, ties sharing their mean, without a window over all rows. A row stands for ``weight`` rows, if given."""
    p = positions(df, [], value, weight).select(F.col("x").alias("__v"), (F.col("before") + (F.col("c") + 1) / 2).alias(name))
    return df.join(p, F.col(value) == F.col("__v"), "left").drop("__v")


def agreement(df: DataFrame, a: str, b: str, step: float = 0.25) -> DataFrame:
    """One row over rows with both values: n, spearman, mean absolute difference, and the share of rows that agree on a grid of ``step``.

    Equal pairs are counted first and ranks are joined to these counts, so a popular value is no hot key."""
    pairs = df.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("w"))
    x = average_ranks(average_ranks(pairs, "a", "ra", "w"), "b", "rb", "w")
    grid = lambda c: F.floor(F.col(c) / step + 0.5)
    w, total = F.col("w"), F.sum("w")
    mean = x.agg(((total + 1) / 2).alias("m"))  # of any ranks of so many rows
    x = x.join(F.broadcast(mean)).withColumns({"da": F.col("ra") - F.col("m"), "db": F.col("rb") - F.col("m")})  # one row
    spread = F.sqrt(F.sum(w * F.col("da") * F.col("da")) * F.sum(w * F.col("db") * F.col("db")))
    rho = F.when(spread > 0, F.sum(w * F.col("da") * F.col("db")) / F.when(spread > 0, spread))
    return x.agg(F.coalesce(total, F.lit(0)).alias("n"), rho.alias("spearman"), (F.sum(w * F.abs(F.col("a") - F.col("b"))) / total).alias("mae"), (F.sum(w * (grid("a") == grid("b")).cast("double")) / total).alias("on_grid"))


def fit_ridge(df: DataFrame, features: str, label: str, alphas: tuple[float, ...] = (0.1, 1.0, 10.0), folds: int = 5, key: str | None = None) -> dict:
    """Ridge regression with an unpenalised intercept: alpha (least squared error over folds dealt by a hash of ``key`` or the features), intercept, coefficients, n.

    One pass: each task adds up the Gram matrices of its rows by fold; the driver gets folds x (width + 2)^2 numbers for each task.
    Rows whose features are null or not of the most frequent length, or hold null or NaN, or have no label, take no part."""
    x = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.pmod(F.xxhash64(F.col(key or features)), F.lit(folds)).cast("int").alias("fold"))
    x = x.filter("x is not null and y is not null and not exists(x, v -> v is null or isnan(v))")
    size = x.select(F.size("x").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if size is None:
        raise ValueError("no rows to fit")
    d = int(size[0])

    def grams(batches):
        total = np.zeros((folds, d + 2, d + 2))
        for pdf in batches:
            for f, g in pdf.groupby("fold"):
                m = np.column_stack([np.ones(len(g)), np.stack(g["x"].to_numpy()), g["y"].to_numpy()])
                total[f] += m.T @ m
        yield pd.DataFrame({"fold": range(folds), "g": [t.ravel().tolist() for t in total]})

    g = np.zeros((folds, d + 2, d + 2))
    cells = x.filter(F.size("x") == d).mapInPandas(grams, "fold int, g array<double>").select("fold", F.posexplode("g").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v"))
    for row in cells.collect():
        g[row["fold"]].ravel()[row["i"]] = row["v"]

    def solve(m: np.ndarray, alpha: float) -> np.ndarray:
        return np.linalg.solve(m[:-1, :-1] + alpha * np.diag([1e-12, *[1.0] * d]), m[:-1, -1])

    def error(m: np.ndarray, w: np.ndarray) -> float:
        v = np.append(w, -1.0)
        return float(v @ m @ v)

    whole = g.sum(axis=0)
    best = min(alphas, key=lambda a: sum(error(g[f], solve(whole - g[f], a)) for f in range(folds) if g[f][0, 0]))
    w = solve(whole, best)
    return {"alpha": best, "intercept": float(w[0]), "coefficients": w[1:].tolist(), "n": int(whole[0, 0])}

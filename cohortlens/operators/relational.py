"""Joins and windows with a meaning of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribute(parts: DataFrame, whole: str, points: Column, amounts: dict[str, Column]) -> DataFrame:
    """Split each whole's amounts over its parts by their share of points, evenly where the points are all 0. Adds weight and the weighted amounts."""
    w = Window.partitionBy(whole)
    total, n = F.sum(points).over(w), F.count("*").over(w)
    weight = F.when(F.coalesce(total, F.lit(0)) == 0, 1.0 / n).otherwise(F.coalesce(points, F.lit(0)) / F.when(total != 0, total))
    out = parts.withColumn("weight", weight)
    return out.withColumns({k: v * F.col("weight") for k, v in amounts.items()})


def dominant(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def previous(df: DataFrame, by: list[str], order: str, value: str, name: str = "previous") -> DataFrame:
    """The latest strictly earlier row's value (the largest of rows of the same time) and the change; an as-of self-join as windows that share one shuffle."""
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(order))
    earlier = Window.partitionBy(*by).orderBy("__rank").rangeBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("__rank", rank)
    p = F.max(F.struct("__rank", F.col(value).alias("v"))).over(earlier)["v"]
    return x.withColumn(name, p).drop("__rank").withColumn("delta", F.col(value) - F.col(name))


def contained(events: DataFrame, at: str, windows: DataFrame, start: str, end: str, width_days: int = 32) -> DataFrame:
    """Each event with the first window that holds it (by start, then end), both ends inclusive; events in none are left out.

    A window that ends no later than one before it in that order is never first, so of a bucket's windows only those
    that reach further than all before them are kept: many overlapping windows leave few. A bucket's windows are one
    sorted array, so that each event meets one row and needs no window of its own, whatever its identity. Windows with a
    null or reversed end hold nothing.
    """
    day = lambda c: F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    rest = [c for c in windows.columns if c not in (start, end)]
    one = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.struct(*rest, F.lit(0).alias("__0")).alias("rest"))
    buckets = F.sequence(F.floor(day(F.col(start)) / width_days), F.floor(day(F.col(end)) / width_days))
    spread = windows.filter(F.col(start) <= F.col(end)).select(F.explode(buckets).alias("__b"), one.alias("w"))
    before = Window.partitionBy("__b").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn("reach", F.max("w.e").over(before)).filter("reach is null or w.e > reach")
    spread = spread.groupBy("__b").agg(F.array_sort(F.collect_list("w")).alias("__w"))
    e = events.withColumn("__b", F.floor(day(F.col(at)) / width_days))
    first = F.get(F.filter("__w", lambda w: (F.col(at) >= w["s"]) & (F.col(at) <= w["e"])), F.lit(0))
    hit = e.join(spread, "__b").withColumn("__hit", first).filter("__hit is not null")
    return hit.select(*events.columns, F.col("__hit.s").alias(start), F.col("__hit.e").alias(end), *[F.col(f"__hit.rest.{c}").alias(c) for c in rest])


def coverage(df: DataFrame, by: list[str], owner: str, amount: str, share: float = 0.95) -> DataFrame:
    """The smallest number of owners that together hold ``share`` of the group's amount, with the group's owners."""
    w = Window.partitionBy(*by).orderBy(F.desc("a"), owner)
    a = df.groupBy(*by, owner).agg(F.sum(amount).alias("a"))
    a = a.withColumns({"before": F.sum("a").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("a"), "total": F.sum("a").over(Window.partitionBy(*by))})
    return a.groupBy(*by).agg(F.count("*").alias("owners"), F.sum((F.col("before") < F.lit(share) * F.col("total")).cast("bigint")).alias("needed"))


def resolve_identity(evidence: DataFrame, entity: str, value: str, weight: Column, least: float = 0.7) -> DataFrame:
    """Each entity's value with the highest evidence, if its share reaches ``least``; ties to the smaller value."""
    e = evidence.groupBy(entity, value).agg(F.sum(weight).alias("w"))
    e = e.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(entity)))
    return dominant(e, [entity], [F.desc("w"), F.col(value)]).filter(F.col("share") >= least)


def shared_pairs(df: DataFrame, key: str, side: str) -> DataFrame:
    """Pairs of sides (a < b) that share keys, with the number of keys.

    Keys held by the same sides are counted first, so that a set of sides is paired once however many keys have it; its pairs are
    made in two steps with a shuffle between them, so that a set of many sides is not one task's work. Null keys and sides share nothing."""
    d = df.select(F.col(key).alias("k"), F.col(side).alias("side")).filter("k is not null and side is not null")
    sets = d.groupBy("k").agg(F.array_sort(F.collect_set("side")).alias("sides")).filter(F.size("sides") > 1).groupBy("sides").agg(F.count("*").alias("n"))
    left = sets.select("sides", "n", F.posexplode("sides").alias("i", "a")).repartition("a", "i")
    pairs = left.select("n", "a", F.explode(F.slice("sides", F.col("i") + 2, F.size("sides"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("shared"))


def graph_metrics(edges: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Directed graph by group: nodes, edges, density and reciprocity; loops are dropped."""
    e = edges.filter(F.col(a) != F.col(b)).select(*by, F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    back = e.select(*by, F.col("b").alias("a"), F.col("a").alias("b")).withColumn("m", F.lit(1))
    e2 = e.join(back, [*by, "a", "b"], "left").groupBy(*by).agg(F.count("*").alias("edges"), F.count("m").alias("mutual"))
    n = e.select(*by, "a").unionByName(e.select(*by, F.col("b").alias("a"))).groupBy(*by).agg(F.countDistinct("a").alias("nodes"))
    x = e2.join(n, by)
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return x.select(*by, "nodes", "edges", (F.col("edges") / pairs).alias("density"), (F.col("mutual") / F.col("edges")).alias("reciprocity"))


def classify_by_prefix(df: DataFrame, value: str, catalog: DataFrame) -> DataFrame:
    """df with name and category of the longest catalog prefix of ``value``, null without one. catalog: prefix, name, category, one row for each prefix. Values meet prefixes of the catalog's lengths by equality, never by comparing all pairs; the lengths are few, whatever the catalog's size."""
    lengths = F.broadcast(catalog.filter("prefix is not null").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("__lengths")))
    v = df.select(F.col(value).alias("__v")).filter("__v is not null").distinct().join(lengths)
    v = v.select("__v", F.explode(F.filter("__lengths", lambda n: n <= F.length("__v"))).alias("__n")).withColumn("prefix", F.expr("left(__v, __n)"))
    best = v.join(catalog, "prefix").groupBy("__v").agg(F.max_by(F.struct("name", "category"), "__n").alias("__b"))
    out = df.join(best, F.col(value) == F.col("__v"), "left")
    return out.select(*df.columns, F.col("__b.name").alias("name"), F.col("__b.category").alias("category"))


def resolve_author(prs: DataFrame, links: DataFrame, identities: DataFrame) -> DataFrame:
    """pr, author, strategy, ambiguous. In order: the assignee with most points among the pull request's tasks (ties to the smaller name, which makes it ambiguous), the owner of the login or of the e-mail address (without case), else the last known author. prs: pr, login, email, author; links: pr, assignee, points; identities: kind (login, email), value, member."""
    p = links.filter("assignee is not null").groupBy("pr", "assignee").agg(F.sum(F.coalesce("points", F.lit(0))).alias("points"))
    w = Window.partitionBy("pr").orderBy(F.desc("points"), "assignee")
    p = p.withColumns({"i": F.row_number().over(w), "second": F.lead("points").over(w)}).filter("i = 1").select("pr", F.col("assignee").alias("by_task"), F.coalesce(F.col("second") == F.col("points"), F.lit(False)).alias("tie"))
    out = prs.join(p, "pr", "left")
    for kind in ("login", "email"):
        known = identities.filter(F.col("kind") == kind).groupBy(F.lower("value").alias("__v")).agg(F.min("member").alias(f"by_{kind}"))
        out = out.join(known, F.lower(kind) == F.col("__v"), "left").drop("__v")
    order = {"task": "by_task", "login": "by_login", "email": "by_email", "kept": "author"}
    strategy = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in order.items()])
    return out.select("pr", F.coalesce(*order.values()).alias("author"), strategy.alias("strategy"), F.coalesce("tie", F.lit(False)).alias("ambiguous"))

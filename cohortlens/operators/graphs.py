"""Shortest paths through the review graphs of teams, by joins level by level; no graph is held in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.sources.scratch import written


def links(edges: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, a, b: each directed link once, without loops and null ends."""
    return edges.filter(F.col(a) != F.col(b)).select(*by, F.col(a).alias("a"), F.col(b).alias("b")).distinct()


def nodes_of(e: DataFrame, by: list[str]) -> DataFrame:
    return e.select(*by, F.col("a").alias("node")).unionByName(e.select(*by, F.col("b").alias("node"))).distinct()


def _same(left: str, right: str, by: list[str]):
    """Equal groups (null ones too) of two frames whose group columns have these endings."""
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{c}{left}").eqNullSafe(F.col(f"{c}{right}"))
    return out


def shortest_paths(e: DataFrame, by: list[str], rounds: int = 100_000) -> list[DataFrame]:
    """For each distance d a frame by, s, v, paths: the nodes v that are d links from s, with the number of shortest ways. All sources go on together: a level is a join of the last one with the links and an anti-join with what is reached."""
    e = e.select(*[F.col(c).alias(f"{c}_e") for c in by], "a", "b")
    start = nodes_of(e.select(*[F.col(f"{c}_e").alias(c) for c in by], "a", "b"), by)
    levels = [written(start.select(*by, F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))]
    reached = levels[0].select(*by, "s", "v")
    for _ in range(rounds):
        step = levels[-1].join(e, _same("", "_e", by) & (F.col("v") == F.col("a")))
        step = step.groupBy(*by, "s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
        old = reached.select(*[F.col(c).alias(f"{c}_r") for c in by], F.col("s").alias("s_r"), F.col("v").alias("v_r"))
        new = written(step.join(old, _same("", "_r", by) & (F.col("s") == F.col("s_r")) & (F.col("v") == F.col("v_r")), "left_anti"))
        if not new.limit(1).count():
            return levels
        levels.append(new)
        reached = written(reached.unionByName(new.select(*by, "s", "v")))
    raise RuntimeError("paths are longer than allowed")


def betweenness(edges: DataFrame, by: list[str], a: str, b: str, members: DataFrame | None = None) -> DataFrame:
    """by, node, betweenness: the share of shortest ways between two other nodes that lead through each node of a group's directed, unweighted graph, over (n - 1)(n - 2); 0 with two nodes. members (by, node): nodes that count also without a link.

    From the farthest level back, each node passes what depends on it to the nodes before it, in proportion to their ways.
    """
    e = written(links(edges, by, a, b))
    levels = shortest_paths(e, by)
    link = e.select(*[F.col(c).alias(f"{c}_e") for c in by], "a", "b")
    total, passed = None, None
    for near, far in zip(levels[-2:0:-1], levels[:1:-1]):
        if passed is not None:
            p = passed.select(*[F.col(c).alias(f"{c}_p") for c in by], F.col("s").alias("s_p"), F.col("v").alias("v_p"), "depends")
            far = far.join(p, _same("", "_p", by) & (F.col("s") == F.col("s_p")) & (F.col("v") == F.col("v_p")), "left")
        else:
            far = far.withColumn("depends", F.lit(0.0))
        far = far.select(*[F.col(c).alias(f"{c}_f") for c in by], F.col("s").alias("s_f"), F.col("v").alias("w"), F.col("paths").alias("ways"), (1 + F.coalesce("depends", F.lit(0.0))).alias("share"))
        back = near.join(link, _same("", "_e", by) & (F.col("v") == F.col("a"))).join(far, _same("", "_f", by) & (F.col("s") == F.col("s_f")) & (F.col("b") == F.col("w")))
        passed = written(back.groupBy(*by, "s", "v").agg(F.sum(F.col("paths") / F.col("ways") * F.col("share")).alias("depends")))
        total = passed if total is None else total.unionByName(passed)
    n = nodes_of(e, by) if members is None else nodes_of(e, by).unionByName(members.select(*by, "node")).distinct()
    size = n.groupBy(*by).agg(F.count("*").alias("n")).withColumnsRenamed({c: f"{c}_n" for c in by})
    x = n.join(size, _same("", "_n", by)).drop(*[f"{c}_n" for c in by])
    if total is None:
        return x.select(*by, "node", F.lit(0.0).alias("betweenness"))
    d = total.groupBy(*[F.col(c).alias(f"{c}_d") for c in by], "v").agg(F.sum("depends").alias("depends"))
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    x = x.join(d, _same("", "_d", by) & (F.col("node") == F.col("v")), "left")
    return x.select(*by, "node", F.when(pairs > 0, F.coalesce("depends", F.lit(0.0)) / F.when(pairs > 0, pairs)).otherwise(0.0).alias("betweenness"))


def centrality(members: DataFrame, edges: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, node, in_degree, out_degree, betweenness, of all members (by, node) and of nodes with a link."""
    e = links(edges, by, a, b)
    ends = e.select(*by, F.col("a").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(*by, F.col("b").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    known = members.select(*by, "node", F.lit(0).alias("i"), F.lit(0).alias("o"))
    degree = ends.unionByName(known).groupBy(*by, "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    ways = betweenness(edges, by, a, b, members).withColumnsRenamed({c: f"{c}_w" for c in by}).withColumnRenamed("node", "node_w")
    x = degree.join(ways, _same("", "_w", by) & (F.col("node") == F.col("node_w")), "left")
    return x.select(*by, "node", "in_degree", "out_degree", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def collaboration(members: DataFrame, reviews: DataFrame, prs: DataFrame, by: list[str]) -> DataFrame:
    """By team of two members and more: nodes, density, reciprocity, isolated (a member without any link), coverage (the share of pull requests that are reviewed; 0 without any), centrality (a JSON object by member: in_degree, out_degree, betweenness to four digits). members: by, node; reviews: by, a, b; prs: by, pr, reviewed."""
    e = links(reviews, by, "a", "b")
    c = centrality(members, reviews, by, "a", "b")
    entry = F.struct(F.col("node").cast("string").alias("key"), F.struct("in_degree", "out_degree", F.bround("betweenness", 4).alias("betweenness")).alias("value"))
    x = c.groupBy(*by).agg(F.count("*").alias("nodes"), F.max((F.col("in_degree") + F.col("out_degree") == 0)).alias("isolated"), F.sum("out_degree").alias("links"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("centrality"))
    back = e.select(*[F.col(k).alias(f"{k}_b") for k in by], F.col("b").alias("a_b"), F.col("a").alias("b_b"))
    mutual = e.join(back, _same("", "_b", by) & (F.col("a") == F.col("a_b")) & (F.col("b") == F.col("b_b")), "left_semi").groupBy(*[F.col(k).alias(f"{k}_m") for k in by]).agg(F.count("*").alias("mutual"))
    done = prs.groupBy(*[F.col(k).alias(f"{k}_p") for k in by]).agg(F.countDistinct("pr").alias("prs"), F.countDistinct(F.when(F.col("reviewed"), F.col("pr"))).alias("reviewed"))
    x = x.filter("nodes > 1").join(mutual, _same("", "_m", by), "left").join(done, _same("", "_p", by), "left")
    ratio = lambda p, q: F.when(q > 0, F.coalesce(p, F.lit(0)) / F.when(q > 0, q)).otherwise(0.0)
    n = F.col("nodes")
    return x.select(*by, "nodes", ratio(F.col("links"), n * (n - 1)).alias("density"), ratio(F.col("mutual"), F.col("links")).alias("reciprocity"), "isolated", ratio(F.col("reviewed"), F.col("prs")).alias("coverage"), "centrality")

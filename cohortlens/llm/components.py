"""Connected components over an edge table by alternating large-star and small-star steps.

Each step is one minimum by node, joined back to the edges, so a hub's neighbours are
never gathered into one row. Edges of hubs are joined where they lie with the hubs' minima: a hub has more
than 1 / ``HUBS`` of all edges (and 1024 at least), so that at most 2 * ``HUBS`` hubs are broadcast,
whatever the size of the graph. Steps go to the shared folder; the driver sees only two
sums a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize

HUBS = 50_000


def _by_node(edges: DataFrame, n_edges: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).withColumnRenamed("u", "n")
    much = max(1024, n_edges // HUBS)
    hubs = F.broadcast(least.filter(F.col("c") > much).select(F.col("n").alias("hub"), F.col("m").alias("hub_m")))
    marked = edges.join(hubs, F.col("u") == F.col("hub"), "left")
    others = marked.filter("hub is null").select("u", "v").join(least.filter(F.col("c") <= much), F.col("u") == F.col("n"))
    return marked.filter("hub is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(others.select("u", "v", "m"))


def large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    x = _by_node(both, n_edges).withColumn("m", F.least("m", "u"))
    return x.filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    x = _by_node(down, n_edges)
    out = x.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(x.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: u, v of one orderable type. Returns node, root (the least node of its component) for every node with an edge to another. Raises if ``rounds`` do not suffice."""
    now = materialize(edges.select("u", "v").filter("u is not null and v is not null and u != v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(total) == seen or not total[0]:
            break
        seen = tuple(total)
        now = materialize(large_star(now, total[0]), "edges")
        now = materialize(small_star(now, total[0]), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source fall into 2^n blocks by the low bits of a hash. Each source gets a target in
words by water-filling its weight under a cap of ``most`` times its size. Whole repeats of the
source take every block; the rest of the target takes some blocks of a last copy. Of a source
of ``LEAST_BLOCKS`` blocks at most (so of one with few documents, whatever their sizes) these are
the blocks whose words together come nearest to the rest; of a larger source the first blocks
and, of the block after them, a share of its hash range. As blocks are numbered by hash, the first ones are a
random draw.

The draws (block, copy) of each source are exact quotas. A binary tree over the output shards
splits the vector of quotas at each node by one multivariate-hypergeometric draw, so every
shard gets its random yet exact share of each source. Shards then take disjoint runs of each
source's draws in permuted order, and rows are shuffled inside their shard by hash.

The driver splits the top of the tree, for at most ``GROUPS`` groups of shards; the
rest, and the draws of each shard, are made in a task for each group. A permutation is
computed for a place at a time, so nothing is sorted. The driver holds a row for each
source and ``BINS`` rows at most of each source for the bounds of its last copy; blocks grow with the
corpus without limit, and plan rows are joined by shuffle beyond ``BROADCAST_ROWS``. Up to
10^9 draws of blocks can be split; ``WORDS_A_BLOCK`` is to be raised beyond 10^14 words.

Cases: size is the number of white-space separated words, null text has 0. A null source is
one source, last in order. Repeated rows (same doc_id, text and source) are numbered, so each falls into a block of its own; the
number of times that such a row is drawn is fixed, which of them it is may change with the
partitioning if they differ in other columns. An empty table gives an empty mix; sources without words
have target 0. Extra columns pass through, and are replaced if named like an added one.
But for the above, the result depends only on rows and seed, not on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, packed, unpacked

WORDS_A_BLOCK = 200_000
WORDS_A_SHARD = 4_000_000
#: Blocks of a source that has a quarter as many documents, however few words; fewer documents get four blocks each.
LEAST_BLOCKS = 64
#: Bins by which the bounds of a last copy are searched, at each step.
BINS = 1024
#: Steps in which sums of blocks are told apart where the nearest is chosen.
STEPS = 65_536
GROUPS = 256
#: Quotas that the driver holds: groups times sources.
QUOTAS = 2_000_000
#: Plan rows broadcast at most; about 60 bytes each.
BROADCAST_ROWS = 200_000
#: Partitions of the mixed rows at most; beyond it a partition holds several shards, one after the other.
PARTITIONS = 20_000


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = 3.0) -> dict[str | None, float]:
    """Each source's share of all words by weight, none over ``most`` times its size; the excess is shared anew by weight."""
    total, out, free = float(sum(sizes.values())), {}, {s for s in sizes if weights[s] > 0}
    out = {s: 0.0 for s in sizes}
    while free:
        unit = (total - sum(v for s, v in out.items() if s not in free)) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * unit > most * sizes[s]}
        if not over:
            return out | {s: weights[s] * unit for s in free}
        out |= {s: most * float(sizes[s]) for s in over}
        free -= over
    return out


def cycled_weights(sources: list[str | None], cycle: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, int]:
    """Weights in turn to sources by code point, null last."""
    return {s: cycle[i % len(cycle)] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def split(quotas: np.ndarray, start: np.ndarray, a: int, b: int, size: int, seed: int):
    """Nodes (first shard, last + 1, start, quotas) of at most ``size`` shards under the node of shards a to b: the quotas of each source divided at random, its draws from start on."""
    if b - a <= size:
        yield a, b, start, quotas
        return
    middle = (a + b) // 2
    n = int(quotas.sum()) * (middle - a) // (b - a)
    left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(quotas, n, method="marginals") if n else np.zeros_like(quotas)
    yield from split(left, start, a, middle, size, seed)
    yield from split(quotas - left, start + left, middle, b, size, seed)


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places of x (from 0 to n - 1) in a random permutation of n: a mixing of bits, repeated until it falls below n."""
    bits = max(1, (n - 1).bit_length())
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    keys = np.random.default_rng([seed, n]).integers(0, 2**63, 8, dtype=np.uint64)
    out, at = x.astype(np.uint64), np.arange(len(x))
    while len(at):
        y = out[at]
        with np.errstate(over="ignore"):
            for mul, add in keys.reshape(4, 2):
                y = (y * (mul | np.uint64(1)) + add) & mask
                y ^= y >> half
        out[at] = y
        at = at[y >= n]
    return out.astype(np.int64)


@dataclass
class Plan:
    sources: DataFrame  # source, source_size, target, blocks, s (its number)
    n_sources: int
    blocks: DataFrame  # s, block, shards (of whole copies, in order), extra (shard of the last copy), cut (the part of the block that it takes, of BINS; null: all)
    n_blocks: int
    shards: int


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """row, source, size, h: the words of each document and a hash of what it is."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    source = F.col("source").cast("string")
    return packed(docs, source=source, size=words, h=F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text", source))


def _numbered(rows: DataFrame, repeated: DataFrame | None, seed: int) -> DataFrame:
    """rows with u, a hash that differs between repeated rows: they are numbered by input partition, then inside it, so that none of them gathers in one task."""
    if repeated is None:
        return rows.withColumn("u", F.col("h"))
    known = repeated.withColumnRenamed("h", "again")
    single = rows.join(known, F.col("h") == F.col("again"), "left_anti").withColumn("u", F.col("h"))
    many = materialize(rows.join(known, F.col("h") == F.col("again"), "left_semi").withColumn("part", F.spark_partition_id()), "repeated")
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto = many.groupBy("h", "part").count().select(F.col("h").alias("h2"), F.col("part").alias("part2"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("upto"))
    place = F.row_number().over(Window.partitionBy("h", "part").orderBy("size"))
    many = many.withColumn("place", place).join(upto, (F.col("h") == F.col("h2")) & (F.col("part") == F.col("part2")))
    return single.unionByName(many.withColumn("u", F.xxhash64("h", F.col("upto") + F.col("place"))).select(single.columns))


def _repeated(light: DataFrame) -> DataFrame | None:
    """The hashes of repeated rows, if any; broadcast if they are few."""
    found = materialize(light.groupBy("h").count().filter("count > 1").select("h"), "repeats")
    n = found.count()
    return None if not n else F.broadcast(found) if n <= BROADCAST_ROWS else found


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _part(u: str = "u"):
    """Which of BINS parts of its block a row falls in, by bits that blocks don't use."""
    return F.pmod(F.shiftrightunsigned(u, 40), F.lit(BINS))


def _search(rows: DataFrame, left: dict[int, float], blocks: dict[int, int], spark: SparkSession) -> dict[int, tuple[int, int]]:
    """For each source number in left: how many of its first blocks have the words left, and how many parts of the next block come nearest to what is then left."""
    low, size = {s: 0 for s in left}, {s: blocks[s] for s in left}  # blocks still in question
    rest, out = dict(left), {}
    while rest:
        ask = [(s, low[s], size[s], max(1, size[s] // BINS)) for s in rest]
        table = spark.createDataFrame(ask, "s2 int, low bigint, n bigint, step bigint")
        within = rows.join(_small(table, len(ask)), (F.col("s") == F.col("s2")) & (F.col("block") >= F.col("low")) & (F.col("block") < F.col("low") + F.col("n")))
        # With one block left, its parts are the bins.
        key = F.when(F.col("n") == 1, _part()).otherwise(F.floor((F.col("block") - F.col("low")) / F.col("step")))
        words: dict[int, dict[int, int]] = {s: {} for s in rest}
        for s, k, w in within.groupBy("s", key.cast("bigint").alias("k")).agg(F.sum("size")).collect():
            words[s][k] = int(w)
        for s, start, n, step in ask:
            if n == 1:
                total, best = 0, (rest[s], 0)
                for k in sorted(words[s]):
                    total += words[s][k]
                    best = min(best, (abs(rest[s] - total), k + 1))
                out[s] = (start, best[1])
                del rest[s]
                continue
            for k in range(n // step):
                if words[s].get(k, 0) > rest[s]:
                    low[s], size[s] = start + k * step, step
                    break
                rest[s] -= words[s].get(k, 0)
            else:  # all blocks fit
                out[s] = (start + n, 0)
                del rest[s]
    return out


def nearest(words: list[int], rest: float, steps: int = STEPS) -> list[int]:
    """Places of words whose sum comes nearest to rest, as far as ``steps`` units of the whole sum tell: all sums that can be reached are bits of a number."""
    unit = max(1.0, sum(words) / steps)
    scaled = [round(w / unit) for w in words]
    reached = [1]
    for w in scaled:
        reached.append(reached[-1] | reached[-1] << w)
    at = max(0, round(rest / unit))
    below, above = (reached[-1] & (2 << at) - 1).bit_length() - 1, reached[-1] >> at
    total = below
    if above and (above & -above).bit_length() - 1 < at - below:
        total = at + (above & -above).bit_length() - 1
    out = []
    for i in range(len(words) - 1, -1, -1):
        if not reached[i] >> total & 1:
            out.append(i)
            total -= scaled[i]
    return out[::-1]


def _choose(rows: DataFrame, left: dict[int, float], blocks: dict[int, int], spark: SparkSession) -> dict[int, tuple[int, list[int]]]:
    """For each source number in left: how many of its blocks the last copy takes, and its blocks with these first."""
    table = _small(spark.createDataFrame([(s,) for s in left], "s2 int"), len(left))
    words = {s: [0] * blocks[s] for s in left}
    for s, b, w in rows.join(table, F.col("s") == F.col("s2")).groupBy("s", "block").agg(F.sum("size")).collect():
        words[s][b] = int(w)
    out = {}
    for s, rest in left.items():
        taken = nearest(words[s], rest)
        out[s] = len(taken), taken + sorted(set(range(blocks[s])) - set(taken))
    return out


def make_plan(spark: SparkSession, docs: DataFrame, weights: dict | None = None, most: float = 3.0, shards: int | None = None, seed: int = 17) -> Plan:
    light = materialize(_keyed(docs, seed).select("source", "size", "h"), "sizes")
    numbered = _numbered(light, _repeated(light), seed)
    sizes, counts = {}, {}
    for source, size, count in light.groupBy("source").agg(F.sum("size"), F.count("*")).collect():
        sizes[source], counts[source] = int(size), count
    weights = weights or cycled_weights(list(sizes))
    target = targets(sizes, weights, most)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    blocks = {i: 1 << max(0, max(-(-sizes[s] // WORDS_A_BLOCK), min(LEAST_BLOCKS, 4 * counts[s])) - 1).bit_length() for i, s in enumerate(order)}
    table = [(s, sizes[s], float(target[s]), blocks[i], i) for i, s in enumerate(order)]
    sources = spark.createDataFrame(table, "source string, source_size bigint, target double, blocks bigint, s int")

    whole = {i: min(int(most), int(target[s] // sizes[s])) if sizes[s] else 0 for i, s in enumerate(order)}
    left = {i: target[s] - whole[i] * sizes[s] for i, s in enumerate(order) if whole[i] < most and target[s] > whole[i] * sizes[s]}
    few = {i: v for i, v in left.items() if blocks[i] <= LEAST_BLOCKS}
    rows = _blocked(numbered, sources, len(order))
    chosen = _choose(rows, few, blocks, spark) if few else {}
    last = _search(rows, left, blocks, spark) if (left := {i: v for i, v in left.items() if i not in few}) else {}
    more = {i: full + (cut > 0) for i, (full, cut) in last.items()} | {i: n for i, (n, _) in chosen.items()}
    draws = np.array([whole[i] * blocks[i] + more.get(i, 0) for i in range(len(order))], dtype=np.int64)
    places = {i: np.array(x, dtype=np.int64) for i, (_, x) in chosen.items()}

    n = shards or max(1, -(-sum(sizes.values()) // WORDS_A_SHARD))
    groups = max(1, min(n, GROUPS, QUOTAS // max(1, len(order))))
    top = [(a, b, start.tolist(), quota.tolist()) for a, b, start, quota in split(draws, np.zeros_like(draws), 0, n, -(-n // groups), seed)] if order else []
    count = [blocks[i] for i in range(len(order))]
    lengths = draws.tolist()

    def deal(frames):
        for frame in frames:
            for a, b, start, quota in frame.itertuples(index=False):
                for shard, _, begin, size in split(np.asarray(quota, np.int64), np.asarray(start, np.int64), a, b, 1, seed):
                    for s in np.flatnonzero(size).tolist():
                        index = permuted(np.arange(begin[s], begin[s] + size[s]), lengths[s], seed + s)
                        block = index % count[s]
                        yield pd.DataFrame({"s": s, "block": places[s][block] if s in places else block, "copy": index // count[s], "shard": shard})

    dealt = spark.createDataFrame(top, "a int, b int, start array<bigint>, quota array<bigint>").repartition(max(1, len(top))).mapInPandas(deal, "s int, block bigint, copy bigint, shard int")
    copies = spark.createDataFrame([(i, whole[i], *last.get(i, (-1, 0))) for i in range(len(order))], "s2 int, whole bigint, full bigint, cut bigint")
    dealt = dealt.join(_small(copies, len(order)), F.col("s") == F.col("s2"))
    made = dealt.groupBy("s", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("copy") < F.col("whole"), F.struct("copy", "shard")))).alias("w"),
        F.max(F.when(F.col("copy") == F.col("whole"), F.col("shard"))).alias("extra"),
        F.max(F.when((F.col("copy") == F.col("whole")) & (F.col("block") == F.col("full")), F.col("cut"))).alias("cut"),
    )
    made = materialize(made.select("s", "block", F.col("w.shard").alias("shards"), "extra", "cut"), "plan")
    n_blocks = sum(blocks[i] if whole[i] else min(blocks[i], lengths[i]) for i in range(len(order)))
    return Plan(sources, len(order), made, n_blocks, n)


def _blocked(numbered: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    named = sources.withColumnRenamed("source", "named")
    x = numbered.join(_small(named, n_sources), F.col("source").eqNullSafe(F.col("named")), "left")
    return x.withColumn("block", F.col("u").bitwiseAND(F.col("blocks") - 1))


def _drawn(docs: DataFrame, plan: Plan, seed: int) -> DataFrame:
    keyed = _keyed(docs, seed)
    x = _blocked(_numbered(keyed, _repeated(keyed.select("h")), seed), plan.sources, plan.n_sources)
    made = plan.blocks.withColumnsRenamed({"s": "s2", "block": "b2"})
    x = x.join(_small(made, plan.n_blocks), (F.col("s") == F.col("s2")) & (F.col("block") == F.col("b2")), "left")
    extra = F.col("extra").isNotNull() & (F.col("cut").isNull() | (_part() < F.col("cut")))
    taken = F.coalesce("shards", F.expr("cast(array() as array<int>)"))
    return x.withColumn("taken", F.when(extra, F.concat(taken, F.array("extra"))).otherwise(taken))


def draw(docs: DataFrame, plan: Plan, seed: int = 17) -> DataFrame:
    """docs, each row once, with size, source_size, target and shards (array<int>: the shards that take it, one entry a copy) added or replaced."""
    return unpacked(_drawn(docs, plan, seed), size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), shards=F.col("taken"))


def mix(docs: DataFrame, weights: dict | None = None, most: float = 3.0, shards: int | None = None, seed: int = 17) -> DataFrame:
    """The mixed rows: all columns of docs, with shard and copy (from 0) added or replaced, a partition for each shard (or for each run of shards), in shuffled order inside it."""
    plan = make_plan(docs.sparkSession, docs, weights, most, shards, seed)
    rows = _drawn(docs, plan, seed).select("row", "u", F.posexplode("taken").alias("copy", "shard"))
    parts = min(plan.shards, PARTITIONS)
    rows = rows.repartitionById(parts, F.floor(F.col("shard") * F.lit(parts) / F.lit(plan.shards)).cast("int"))
    return unpacked(rows.sortWithinPartitions("shard", F.xxhash64("u", "copy"), "copy"), shard=F.col("shard"), copy=F.col("copy"))

"""Near-duplicate embeddings by Euclidean p-stable hashing.

1. Vectors with the same label and the same entries form a class, named by a 128-bit digest; only one
   member goes further, so copies are never paired.
2. Each class's unit vector is projected on ``hashes`` Gaussian directions in each of ``tables``
   tables, shifted and cut in cells of ``WIDTH``; a table's cells and the label name a bucket. Two
   unit vectors of cosine c are sqrt(2 - 2c) apart, which gives the share of cells they share.
   ``hashes`` grows with the logarithm of the largest label, so that in each table a vector meets
   ``MATES`` strangers on average however large the table is, and ``tables`` follows from the recall
   wanted at the threshold (closer pairs have a higher one).
3. Classes that share a bucket are verified exactly, by cosine in double precision on the original vectors.
   A bucket of more than ``block`` classes is dealt into chunks, and each pair of chunks is a task group of its
   own. A pair counts in its first shared table only. Groups return a count of links and a
   tree for each vector, never the pairs.
4. Components of the trees are the groups.

Vectors that are null, empty, zero or hold null or non-finite entries, and those without a label, link with
nothing. Vectors of different lengths have no cosine and don't link. Ids may be null or repeated:
rows count as rows, a null id is never the least. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, mix64, reduced
from cohortlens.llm.components import connected_components
from cohortlens.llm.vectors import matrices

THRESHOLD = 0.98
RECALL = 0.9999
#: Width of a cell; unit vectors at right angles are 1.41 apart, those at the threshold 0.2.
WIDTH = 2.0
#: Strangers (at right angles) that a vector meets in a table on average.
MATES = 0.05
#: Classes a task verifies against as many others, and rows of a bin of small groups.
BLOCK, BIN_ROWS = 2048, 20_000
#: A class of more than a row in this many is joined where its rows lie.
HUBS = 50_000


def same_cell(distance: float, width: float = WIDTH) -> float:
    """The probability that a Gaussian projection cut in cells of ``width`` puts two points at this distance in one cell."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def choose_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH, mates: float = MATES) -> tuple[int, int]:
    """(hashes, tables) for labels of n vectors at most."""
    near, far = same_cell(math.sqrt(2 - 2 * threshold), width), same_cell(math.sqrt(2), width)
    hashes = max(1, math.ceil(math.log(max(n, 2) / mates) / -math.log(far)))
    return hashes, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes))


class Tables:
    def __init__(self, d: int, hashes: int, tables: int, width: float = WIDTH, seed: int = 13):
        rng = np.random.default_rng([seed, d])
        self.hashes, self.tables = hashes, tables
        self.a = rng.standard_normal((d, tables * hashes)) / width
        self.b = rng.random(tables * hashes)

    def buckets(self, unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """One int64 for each row and table; salt (uint64) tells rows apart that may not meet."""
        cell = np.floor(unit @ self.a + self.b).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.hashes)
        h = salt[:, None] ^ mix64(np.arange(1, self.tables + 1, dtype=np.uint64), unit.shape[1])[None]
        for i in range(self.hashes):
            h = mix64(h ^ cell[:, :, i], 7)
        return h.view(np.int64)


def _entry(rows: DataFrame) -> str:
    """The numpy type that holds entries of ``vec`` exactly."""
    kind = rows.schema["vec"].dataType
    return "<f4" if getattr(kind, "elementType", kind).simpleString() == "float" else "<f8"


def classes_of(rows: DataFrame) -> DataFrame:
    """id, key (digest of label and vector; null if the row can't link), label, vec (bytes of the entries)."""
    id_type, entry = rows.schema["id"].dataType.simpleString(), _entry(rows)

    def apply(batches):
        for batch in batches:
            labels = batch.column(1).to_pylist()
            keys: list[bytes | None] = [None] * batch.num_rows
            vecs: list[bytes | None] = [None] * batch.num_rows
            for at, m in matrices(batch.column(2)):
                m = m + 0.0  # one zero
                some = m.any(axis=1)
                for i, v in zip(at[some].tolist(), m[some]):
                    if labels[i] is not None:
                        vecs[i] = v.astype(entry).tobytes()
                        keys[i] = hashlib.blake2b(vecs[i] + labels[i].encode(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1), pa.array(vecs, pa.binary())], names=["id", "key", "label", "vec"])

    return rows.select("id", F.col("label").cast("string"), "vec").mapInArrow(apply, f"id {id_type}, key binary, label string, vec binary")


def units(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither tiny nor huge entries leave the range of squares."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _with_buckets(classes: DataFrame, hashes: int, tables: int, entry: str) -> DataFrame:
    width = np.dtype(entry).itemsize

    def apply(batches):
        made: dict[int, Tables] = {}
        for batch in batches:
            vecs = batch.column(3).to_pylist()
            salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in batch.column(2).to_pylist()], dtype=np.uint64)
            size = np.array([len(v) for v in vecs])
            out: list[bytes] = [b""] * len(vecs)
            for s in np.unique(size):
                d = int(s) // width
                of = made.setdefault(d, Tables(d, hashes, tables))
                for rows in np.array_split(np.flatnonzero(size == s), max(1, len(vecs) * tables * hashes // 4_000_000)):
                    if len(rows):
                        got = of.buckets(units(np.frombuffer(b"".join(vecs[i] for i in rows), dtype=entry).astype(np.float64).reshape(len(rows), d)), salt[rows])
                        for i, h in zip(rows.tolist(), got):
                            out[i] = h.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary())], names=["key", "copies", "vec", "hashes"])

    return classes.select("key", "copies", "label", "vec").mapInArrow(apply, "key binary, copies bigint, vec binary, hashes binary")


def _exploded(hashed: DataFrame) -> DataFrame:
    """key, own (number of the table), bucket: a row for each class and table."""

    def apply(batches):
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
            t = len(hashes) // max(1, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), t))), pa.array(np.tile(np.arange(t, dtype=np.int32), batch.num_rows)), pa.array(hashes)], names=["key", "own", "bucket"])

    return hashed.select("key", "hashes").mapInArrow(apply, "key binary, own int, bucket bigint")


def _verify(unit: np.ndarray, hashes: np.ndarray, copies: np.ndarray, chunk: np.ndarray, own: np.ndarray, alone: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For G groups of s members each, by group: (copies of the members each is linked to, the number of the least member of its tree). alone: whether the group is compared with itself, not chunk with chunk."""
    g, s, _ = unit.shape
    links = np.zeros((g, s), dtype=np.int64)
    tree = np.tile(np.arange(s), (g, 1))
    step = max(1, 4_000_000 // (s * s))
    for lo in range(0, g, step):
        x = unit[lo : lo + step]
        near = np.matmul(x, x.transpose(0, 2, 1)) >= threshold
        near &= np.triu(np.ones((s, s), dtype=bool), 1)[None]
        near &= alone[lo : lo + step, None, None] | (chunk[lo : lo + step, :, None] != chunk[lo : lo + step, None, :])
        k, i, j = np.nonzero(near)
        k += lo
        for t in range(int(own[k].max(initial=0))):
            keep = (own[k] <= t) | (hashes[k, i, t] != hashes[k, j, t])
            k, i, j = k[keep], i[keep], j[keep]
        np.add.at(links, (k, i), copies[k, j])
        np.add.at(links, (k, j), copies[k, i])
        while True:
            before = tree[k, i].copy(), tree[k, j].copy()
            low = np.minimum(*before)
            np.minimum.at(tree, (k, i), low)
            np.minimum.at(tree, (k, j), low)
            tree = np.take_along_axis(tree, tree, axis=1)
            if (tree[k, i] == before[0]).all() and (tree[k, j] == before[1]).all():
                break
    return links, tree


def _check(threshold: float, entry: str):
    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(group=pdf.groupby(["own", "bucket", "p", "q"], sort=False).ngroup()).sort_values(["group", "key"])
        group = pdf["group"].to_numpy()
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(starts, len(group)))
        key, vec, hashes = pdf["key"].to_numpy(), pdf["vec"].to_numpy(), pdf["hashes"].to_numpy()
        copies, chunk, own = pdf["copies"].to_numpy(), pdf["chunk"].to_numpy(), pdf["own"].to_numpy()
        alone = (pdf["p"] == pdf["q"]).to_numpy()
        length = np.array([len(v) for v in vec])
        out = []
        for s, d in {(int(a), int(b)) for a, b in zip(size, length[starts])}:
            if s < 2:
                continue
            at = starts[(size == s) & (length[starts] == d)]
            rows = at[:, None] + np.arange(s)
            flat = rows.ravel()
            unit = units(np.frombuffer(b"".join(vec[flat]), dtype=entry).astype(np.float64).reshape(len(flat), -1)).reshape(len(at), s, -1)
            table = np.frombuffer(b"".join(hashes[flat]), dtype=np.int64).reshape(len(at), s, -1)
            links, tree = _verify(unit, table, copies[rows], chunk[rows], own[at], alone[at], threshold)
            g, i = np.nonzero(links)
            out.append(pd.DataFrame({"key": key[rows[g, i]], "tree": key[rows[g, tree[g, i]]], "links": links[g, i]}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "tree": [], "links": []})

    return check


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """rows: id, label, vec. One row for each: id, n_links (other rows linked directly), component_id (the least id reachable by links, its own included), kept (id = component_id), copies (rows with this label and vector)."""
    spark = rows.sparkSession
    rows = reduced(rows, "id", "label", "vec")
    id_type = rows.schema["id"].dataType.simpleString()
    known = materialize(classes_of(rows), "vectors")
    classes = known.filter("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = materialize(classes, "vector-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    hashes, tables = choose_tables(most, threshold, recall)
    hashed = materialize(_with_buckets(classes, hashes, tables, _entry(rows)), "vector-hashes")

    members = materialize(_exploded(hashed), "buckets")
    chunks = F.ceil(F.col("c") / block).cast("int")
    shared = members.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("bucket").alias("b"), "c", chunks.alias("chunks"))
    shared = materialize(shared, "shared-buckets")
    sent, groups = shared.agg(F.coalesce(F.sum(F.col("c") * F.col("chunks")), F.lit(0)), F.coalesce(F.sum("chunks"), F.lit(0))).first()
    met = members.join(shared, F.col("bucket") == F.col("b")).select("key", "own", "bucket", "chunks", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("key", "own", "bucket", "chunk", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"))
    bins = max(int(sent // BIN_ROWS) + 1, min(int(groups), spark.sparkContext.defaultParallelism * 2), 1)
    met = met.join(hashed.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).drop("k").withColumn("bin", F.pmod(F.xxhash64("bucket", "p", "q"), F.lit(bins)))
    verified = materialize(met.groupBy("bin").applyInPandas(_check(threshold, _entry(rows)), "key binary, tree binary, links bigint"), "verified")

    trees = connected_components(verified.select(F.col("key").alias("u"), F.col("tree").alias("v")))
    links = verified.groupBy("key").agg(F.sum("links").alias("links")).withColumnRenamed("key", "lk")
    member = classes.select("key", "rep", "copies").join(links, F.col("key") == F.col("lk"), "left").join(trees, F.col("key") == F.col("node"), "left")
    member = materialize(member.select("key", "rep", "copies", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "members")
    least = member.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "r")
    result = materialize(member.join(least, F.col("root") == F.col("r")).select(F.col("key").alias("k"), "copies", "n_links", "component_id"), "classes")

    # Classes with many rows are few: they are broadcast to their rows, which so never meet in one task.
    total = known.count()
    many = F.col("copies") > max(1024, total // HUBS)
    columns = ("id", "n_links", "component_id", "copies")
    large = result.filter(many).select(F.col("k").alias("lk"), *[F.col(c).alias(f"l_{c}") for c in columns[1:]])
    marked = known.select("id", "key").join(F.broadcast(large), F.col("key") == F.col("lk"), "left")
    own = marked.filter("key is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(1).cast("bigint").alias("copies"))
    hot = marked.filter("lk is not null").select("id", *[F.col(f"l_{c}").alias(c) for c in columns[1:]])
    rest = marked.filter("key is not null and lk is null").select("id", "key").join(result.filter(~many), F.col("key") == F.col("k")).select(*columns)
    out = own.unionByName(hot).unionByName(rest)
    return out.select("id", "n_links", F.col("component_id").cast(id_type), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "copies")

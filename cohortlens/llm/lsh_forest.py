"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a long string of letters. A letter names the nearest of the
points +e_i, -e_i of a random orthonormal system (a cross-polytope; ``LETTERS`` gives the dimensions), so
near vectors share letters far more often than with sign bits. Strings are packed in one
integer, the first letter in the highest bits, and each tree keeps them in a sorted array. A query descends
each tree to the place of its own string: its neighbours there share the longest prefix
with it. Then all trees ascend together, a letter at a time: rows that share that much
in any tree are the candidates, until they are ``share`` of the indexed vectors (``least`` of all rows of
that length at least). Only candidates are ranked, by exact cosine in double precision on the original vectors.

Rows are indexed in segments of bounded size, each with its own forest, wherever they lie:
vectors are not shuffled and there is no hot bucket. Equal vectors of a segment are indexed once, with
their k + 1 least ids, as more of them can't be among k nearest. Queries come in blocks of bounded
size, each broadcast; a task keeps the best k of all its segments for each query and the tasks'
results are merged. Candidates wanted is a level to ascend to, not a cap: the level that
reaches it is taken whole.

Cases: vectors that are null, zero or hold null or non-finite components take no part. Only
vectors of equal length are compared. Ties go to the smaller id. Repeated vectors are rows of
their own; a repeated query (same id and vector) is asked once, and vectors that share a
query id are asked each. A query never finds a row with its own id. Extra columns are
ignored. No rows: no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
TREES = 312
#: Dimensions of the cross-polytope of each letter, powers of two; a letter takes log2(dimension) + 1 bits, 20 in all.
LETTERS = (32, 32, 8, 8)
SEGMENT = 16_384
SHARE = 0.05
LEAST = 400
#: Queries broadcast at a time.
QUERY_BLOCK = 16_384

_BITS = [d.bit_length() for d in LETTERS]
#: Bits of a string above each level, from no letter to all letters.
_UPTO = np.concatenate([[0], np.cumsum(_BITS)])
_ALL = int(_UPTO[-1])
#: Masks of the letters of each level.
_HIGH = np.array([((1 << int(n)) - 1) << (_ALL - int(n)) for n in _UPTO], dtype=np.uint32)
_LOW = np.uint32((1 << _ALL) - 1) ^ _HIGH


def valid(df: DataFrame) -> DataFrame:
    v = F.col("vec").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is from 0.5 to 1: cosines stay the same and nothing overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class Hashes:
    """Strings of ``trees`` trees for vectors of ``dim`` components. The same arguments give the same strings."""

    def __init__(self, dim: int, trees: int = TREES, seed: int = 23):
        rng = np.random.default_rng([seed, dim])
        self.trees, self.width = trees, sum(LETTERS)

        def system(size: int) -> np.ndarray:
            g = rng.normal(size=(dim, size))
            return np.linalg.qr(g)[0] if size <= dim else g / np.sqrt(size)

        self.systems = np.concatenate([system(d) for _ in range(trees) for d in LETTERS], axis=1).astype(np.float32)

    def strings(self, x: np.ndarray, step: int = 4096, group: int = 8) -> np.ndarray:
        """(trees, rows) uint32 of scaled vectors."""
        out = np.zeros((self.trees, len(x)), dtype=np.uint32)
        for i in range(0, len(x), step):
            part = x[i : i + step].astype(np.float32)
            for t in range(0, self.trees, group):
                n = min(group, self.trees - t)
                y = (part @ self.systems[:, t * self.width : (t + n) * self.width]).reshape(len(part), n, self.width)
                size, at, code = np.abs(y), 0, np.zeros((len(part), n), dtype=np.uint32)
                for d in LETTERS:
                    best = size[:, :, at : at + d].argmax(axis=2)
                    up = np.take_along_axis(y[:, :, at : at + d], best[:, :, None], axis=2)[:, :, 0] > 0
                    code = code * np.uint32(2 * d) + (2 * best + up).astype(np.uint32)
                    at += d
                out[t : t + n, i : i + step] = code.T
        return out


class Forest:
    """Sorted arrays of strings, (trees, rows)."""

    def __init__(self, strings: np.ndarray):
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def longest(self, queries: np.ndarray) -> np.ndarray:
        """(trees, queries): how many letters the longest prefix that a row shares with the query has, by descent."""
        n = self.sorted.shape[1]
        out = np.empty(queries.shape, dtype=np.int8)
        for t, (s, q) in enumerate(zip(self.sorted, queries)):
            at = np.searchsorted(s, q)
            differ = np.minimum(s[np.maximum(at - 1, 0)] ^ q, s[np.minimum(at, n - 1)] ^ q)
            same = _ALL - np.frexp(differ.astype(np.float64))[1]  # leading bits; frexp gives the bit length of what differs
            out[t] = np.searchsorted(_UPTO, same, side="right") - 1
        return out

    def candidates(self, queries: np.ndarray, want: int):
        """Pairs (query, rows) by synchronous ascent: all rows that share the longest prefix, in any tree, at which there are ``want``. queries: (trees, queries)."""
        trees, n = self.sorted.shape
        pending = np.arange(queries.shape[1])
        depth = self.longest(queries) if n > want else None
        order, mark = self.order.ravel(), np.zeros(n, dtype=bool)
        for level in range(len(LETTERS), 0, -1) if n > want else ():
            lo, hi = np.zeros((trees, len(pending)), np.int64), np.zeros((trees, len(pending)), np.int64)
            for t in range(trees):
                at = np.flatnonzero(depth[t, pending] >= level)
                if len(at):
                    low = queries[t, pending[at]] & _HIGH[level]
                    lo[t, at] = np.searchsorted(self.sorted[t], low)
                    hi[t, at] = np.searchsorted(self.sorted[t], low | _LOW[level], side="right")
            size = hi - lo
            left = []
            for i, total in zip(range(len(pending)), size.sum(axis=0).tolist()):
                if total >= want:
                    s = size[:, i]
                    mark[order[np.repeat(np.arange(trees) * n + lo[:, i] - np.cumsum(s) + s, s) + np.arange(total)]] = True
                    rows = np.flatnonzero(mark)
                    mark[rows] = False
                    if len(rows) >= want:
                        yield int(pending[i]), rows
                        continue
                left.append(i)
            pending = pending[left]
        for q in pending.tolist():
            yield q, np.arange(n)


class Segment:
    """The distinct vectors of some rows, with the least ids of each, and their forest."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, hashes: Hashes, k: int):
        x = np.ascontiguousarray(x) + 0.0  # no negative zeros
        _, first, which = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1])))[:, 0], return_index=True, return_inverse=True)
        order = np.lexsort((ids, which))
        place = np.arange(len(ids)) - np.searchsorted(which[order], which[order])
        kept = order[place <= k]
        self.ids = np.full((len(first), k + 1), -1, dtype=np.int64)
        self.have = np.zeros((len(first), k + 1), dtype=bool)
        self.ids[which[kept], place[place <= k]] = ids[kept]
        self.have[which[kept], place[place <= k]] = True
        self.x = scaled(x[first])
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.rough = (self.x / self.norm[:, None]).astype(np.float32)
        self.forest = Forest(hashes.strings(self.x))

    def nearest(self, c: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows with vectors c, but for those with the id ``own``, ids and cosines of the k nearest to q.

        Single precision only narrows the choice; values come from one sum for each vector.
        """
        size = np.sqrt((q * q).sum())
        if len(c) > k + 1:
            about = self.rough[c] @ (q / size).astype(np.float32)
            c = c[about >= np.partition(about, len(c) - k - 1)[len(c) - k - 1] - 1e-5]
        score = (self.x[c] * q).sum(axis=1) / (self.norm[c] * size)
        fine = self.have[c] & (self.ids[c] != own)
        ids, score = self.ids[c][fine], np.repeat(score, fine.sum(axis=1))
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def _vectors(batch: pa.RecordBatch):
    """(length, ids, vectors) of the rows of a batch (id, vec) by length of the vector."""
    ids, col = np.asarray(batch.column(0).cast(pa.int64())), batch.column(1)
    size = np.asarray(pc.list_value_length(col))
    flat, start = np.asarray(col.flatten().cast(pa.float64())), np.cumsum(size) - size
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, ids[at], flat[start[at][:, None] + np.arange(d)]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of two (queries, places) lists of ids and scores, by score, then id."""
    ids, score = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
    by_id = np.argsort(ids, axis=1, kind="stable")
    order = np.take_along_axis(by_id, np.argsort(-np.take_along_axis(score, by_id, axis=1), axis=1, kind="stable"), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, share: float = SHARE, least: int = LEAST, segment: int = SEGMENT, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors, queries: id (long), vec (array). Returns query_id, rank (int from 1), vec_id, score: each query's k nearest found, nearest first."""
    spark = vectors.sparkSession
    vectors, queries = valid(vectors.select("id", "vec")), valid(queries.select("id", "vec")).dropDuplicates(["id", "vec"])
    asked = queries.count()
    sizes = dict(vectors.groupBy(F.size("vec")).count().collect())  # rows by length
    schema = "query_id bigint, q bigint, vec_id bigint, score double"
    # Few rows in many partitions would make forests too small to select from.
    segments = max(1, -(-sum(sizes.values()) // segment))
    if vectors.rdd.getNumPartitions() > segments:
        vectors = vectors.coalesce(segments)
    wanted = {d: min(1.0, max(share, least / n)) for d, n in sizes.items()}
    blocks = asked // query_block + 1
    bin_ = F.pmod(F.xxhash64("id"), F.lit(blocks))
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = {}
        for batch in queries.filter(bin_ == b).orderBy("id", "vec").toArrow().to_batches():
            for d, ids, x in _vectors(batch):
                block.setdefault(d, []).append((ids, scaled(x)))
        if not block:
            continue
        shared = spark.sparkContext.broadcast({d: tuple(map(np.concatenate, zip(*parts))) for d, parts in block.items()})

        def ask(batches, shared=shared, b=b):
            hashes, strings, best, held, size = {}, {}, {}, {}, {}
            for d, (qid, q) in shared.value.items():
                best[d] = (np.full((len(qid), k), np.iinfo(np.int64).max), np.full((len(qid), k), -np.inf))

            def answer(d: int) -> None:
                qid, q = shared.value[d]
                if d not in hashes:
                    hashes[d] = Hashes(d, trees)
                    strings[d] = hashes[d].strings(q)
                s = Segment(*map(np.concatenate, zip(*held.pop(d))), hashes[d], k)
                size[d] = 0
                ids, score = np.full((len(qid), k), np.iinfo(np.int64).max), np.full((len(qid), k), -np.inf)
                for i, c in s.forest.candidates(strings[d], int(np.ceil(wanted[d] * len(s.x)))):
                    got = s.nearest(c, q[i], qid[i], k)
                    ids[i, : len(got[0])], score[i, : len(got[0])] = got
                best[d] = _merged(best[d], (ids, score), k)

            for batch in batches:
                for d, ids, x in _vectors(batch):
                    for i in range(0, len(ids) if d in best else 0, segment):
                        held.setdefault(d, []).append((ids[i : i + segment], x[i : i + segment]))
                        size[d] = size.get(d, 0) + len(held[d][-1][0])
                        if size[d] >= segment:
                            answer(d)
            for d in list(held):
                answer(d)
            for n, (d, (ids, score)) in enumerate(best.items()):
                i, j = np.nonzero(score > -np.inf)
                number = (b << 40) + (n << 32) + i
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (shared.value[d][0][i], number, ids[i, j], score[i, j])], names=["query_id", "q", "vec_id", "score"])

        found = found.unionByName(vectors.mapInArrow(ask, schema))
    w = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

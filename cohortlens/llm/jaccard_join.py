"""N-gram Jaccard join by MinHash banding, and near-duplicate removal built on it.

1. Texts with the same set of word n-grams form a class, named by a 128-bit sum of the
   set; only one member of a class goes further, so copies are never paired.
2. Each class gets a MinHash signature cut into bands; (bands, rows) are chosen for the
   target recall at the threshold. Band hashes are shuffled, and each member of a shared
   bucket is linked to the bucket's least class. The components of these links
   are candidate sets: two texts that share any band are in the same one.
3. Pairs are verified on the full n-gram sets, in one of two ways for each candidate set. All pairs of
   the set: once for each pair, with a set's n-grams sent once for each chunk of the others. Or all
   pairs of each shared bucket, a pair in the bucket of its first shared band only: n-grams are
   sent once for each bucket, and sets that only chance links hold together are never
   compared as a whole. Whichever sends fewer n-grams is taken; a set that fits a chunk is always
   compared whole. What is more than ``block`` classes or ``GRAMS`` n-grams is dealt into chunks
   and each pair of chunks is a task group of its own. A task returns counts of links and a
   spanning forest, never the pairs.
4. Components of verified links are the groups.

Words are separated by ASCII white space and compared as they are. A text of fewer than n
words has one n-gram of all its words. Texts without words (null, empty, blank) have
no n-grams, take part in no link and form no group. Repeated rows (same text) are copies
of one class. n-grams are compared by 64-bit hash. A doc_id may be null or repeated;
extra columns of any name are ignored by ``near_duplicates`` and kept by ``deduplicate``. Of equal
least members the one that stays may differ in extra columns only. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import column, materialize, mix64, packed, pieces, reduced, shingle_sets, text_bytes, token_bounds, token_hashes, unpacked
from cohortlens.llm.components import connected_components

N = 5
THRESHOLD = 0.8
RECALL = 0.99999
#: Classes a task verifies against as many others.
BLOCK = 512
#: n-grams of a chunk, 8 bytes each, as far as whole sets allow, and of a bin of small groups.
GRAMS, BIN_GRAMS = 8_000_000, 2_000_000
#: Ids of candidates that are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 48 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which bands * rows <= most keep a pair at the threshold with probability ``recall``."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding reaches this recall")


def _sets(piece: pa.RecordBatch, n: int, name: str = "text") -> list[np.ndarray]:
    data, off = text_bytes(column(piece, name))
    starts, ends, tok_off = token_bounds(data, off)
    return shingle_sets(token_hashes(data, starts, ends), tok_off, n)


def _key(s: np.ndarray) -> bytes | None:
    """Names a set by two independent 64-bit sums; null for the empty set."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        return np.array([mix64(s, 11).sum(), mix64(s, 12).sum()], dtype=">u8").tobytes()


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def band_hashes(self, s: np.ndarray) -> np.ndarray:
        """One int64 for each band, different between bands."""
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 1024):
            y = x[i : i + 1024, None] * self.a
            y += self.b
            np.minimum(low, y.min(axis=0), out=low)
        v = low.reshape(self.bands, self.rows).astype(np.uint64)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for r in range(self.rows):
                h = mix64(h ^ v[:, r], 5)
        return h.view(np.int64)


def with_key(docs: DataFrame, n: int = N) -> DataFrame:
    """row (all columns of docs) and key, the class key of its text."""

    def apply(batches):
        for batch in batches:
            for piece in pieces(batch, "row.text"):
                keys = pa.array([_key(s) for s in _sets(piece, n, "row.text")], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), keys], names=["row", "key"])

    work = packed(docs)
    return work.mapInArrow(apply, type(work.schema)([work.schema["row"]]).add("key", "binary"))


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        mh = MinHash(bands, rows)
        seen: dict[bytes, bool] = {}
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = _sets(piece, n)
                keys = [_key(s) for s in sets]
                out = []
                for k, s in zip(keys, sets):  # a copy within the task needs no second signature
                    fresh = k is not None and k not in seen
                    if fresh:
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen[k] = True
                    out.append(mh.band_hashes(s) if fresh else None)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(keys, pa.binary()), sizes, pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "bands"])

    return docs.mapInArrow(apply, f"doc_id {id_type}, key binary, n bigint, bands array<bigint>")


def _links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each of members a links with each of members b, exactly, on full sets."""
    size = np.array([len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    common = count[inverse] > 1  # an n-gram of one member alone is in no intersection
    column = np.cumsum(count > 1) - 1
    owner, col = owner[common], column[inverse[common]]
    total, step = int((count > 1).sum()), max(1, 16_000_000 // max(1, len(sets)))
    inter = np.zeros((len(a), len(b)), dtype=np.float64)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for c in range(0, total, step):
        lo, hi = np.searchsorted(col, (c, c + step))
        m = np.zeros((len(sets), min(step, total - c)), dtype=np.float32)
        m[owner[lo:hi], col[lo:hi] - c] = 1
        inter += m[a] @ m[b].T
    union = size[a][:, None] + size[b][None] - inter
    return inter >= threshold * union - 1e-9


def verify(members: list[tuple[bytes, int, int, np.ndarray]], p: int, q: int, threshold: float, bands: np.ndarray | None = None, own: int = 0) -> list[tuple[bytes, bytes, int]]:
    """members: (key, copies, chunk, n-gram set) of chunks p and q. For each linked member (key, the least key of its tree here, copies of its partners here).

    With bands (the band hashes of each member), pairs that share a band before number ``own`` are left to that one's bucket.
    """
    chunk = np.array([m[2] for m in members])
    copies = np.array([m[1] for m in members], dtype=np.int64)
    a, b = np.flatnonzero(chunk == p), np.flatnonzero(chunk == q)
    if not len(a) or not len(b):
        return []
    mine = True
    if bands is not None:
        mine = np.ones((len(a), len(b)), dtype=bool)
        for j in range(own):
            mine &= bands[a, j][:, None] != bands[b, j][None]
        if not mine.any():
            return []
    link = _links([m[3] for m in members], a, b, threshold) & mine
    count = np.zeros(len(members), dtype=np.int64)
    if p == q:
        np.fill_diagonal(link, False)
        count[a] = link @ copies[a]
    else:
        count[a] += link @ copies[b]
        count[b] += link.T @ copies[a]
    root = np.arange(len(members))  # least key first: members come sorted
    settled = False
    while not settled:
        low_a = np.minimum(root[a], np.where(link, root[b][None], len(root)).min(axis=1))
        new = root.copy()
        new[a] = low_a
        new[b] = np.minimum(new[b], np.where(link, low_a[:, None], len(root)).min(axis=0))
        new = new[new]
        settled = bool((new == root).all())
        root = new
    return [(members[i][0], members[root[i]][0], int(count[i])) for i in np.flatnonzero(count)]


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, class_key (hex of its n-gram set; null without words), group_key, class_id (the least doc_id of its group of linked texts; its own without words), copies (rows with this n-gram set), n_links (other rows whose similarity is at least the threshold, copies included)."""
    spark = docs.sparkSession
    docs = reduced(docs, "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bands, rows = choose_bands(threshold, recall)
    sig = materialize(_signatures(docs, n, bands, rows), "signatures")
    classes = materialize(sig.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("bands").alias("bands")), "classes")

    band = classes.select("key", "n", F.explode("bands").alias("b"))
    chunks = lambda c, n: F.greatest(F.ceil(F.col(c) / block), F.ceil(F.col(n) / GRAMS)).cast("int")
    bucket = band.groupBy("b").agg(F.count("*").alias("c"), F.sum("n").alias("bn"), F.min("key").alias("least")).filter("c > 1")
    bucket = materialize(bucket.select(F.col("b").alias("b2"), "least", "bn", chunks("c", "bn").alias("b_chunks")), "buckets")
    edges = band.join(bucket.select("b2", "least"), F.col("b") == F.col("b2")).filter("key != least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    found = materialize(connected_components(edges), "sets")

    # n-grams sent if all pairs of a candidate set, or all pairs of its buckets, are verified.
    known = classes.select(F.col("key").alias("k"), "rep", "copies", "n", F.col("bands").alias("hashes"))
    cand = found.join(known, F.col("node") == F.col("k"))
    by_set = cand.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("sn")).select(F.col("root").alias("r"), chunks("c", "sn").alias("chunks"), "sn")
    by_bucket = bucket.join(found, F.col("least") == F.col("node")).groupBy("root").agg(F.sum(F.col("bn") * F.col("b_chunks")).alias("bucket_cost")).withColumnRenamed("root", "r3")
    cost = by_set.join(by_bucket, F.col("r") == F.col("r3"))
    bucketed = (F.col("chunks") > 1) & (F.col("bucket_cost") < F.col("sn") * F.col("chunks"))
    cost = cost.select("r", "chunks", bucketed.alias("bucketed"), F.when(bucketed, F.col("bucket_cost")).otherwise(F.col("sn") * F.col("chunks")).alias("sent"))
    cost = materialize(cost, "costs")
    cand = cand.join(cost.drop("sent"), F.col("root") == F.col("r")).select(F.col("node").alias("key"), "root", "chunks", "bucketed", "rep", "copies", "hashes")
    cand = materialize(cand, "candidates")

    # The ids of candidates find their texts where these lie, if they are few enough to be broadcast.
    reps = materialize(cand.select(F.col("rep").alias("r")).distinct(), "representatives")
    bytes_ = reps.agg(F.sum(F.coalesce(F.octet_length(F.col("r").cast("string")), F.lit(0)) + 16)).first()[0] or 0
    texts = docs.join(F.broadcast(reps) if bytes_ <= BROADCAST_BYTES else reps, F.col("doc_id").eqNullSafe(F.col("r")), "left_semi")

    def sets_of(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = _sets(piece, n)
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["k", "grams"])

    grams = texts.select("text").mapInArrow(sets_of, "k binary, grams array<bigint>").dropDuplicates(["k"])
    whole = cand.filter("not bucketed").select("root", F.lit(-1).alias("own"), F.lit(0).cast("bigint").alias("band"), "key", "copies", F.lit(None).cast("array<bigint>").alias("hashes"), "chunks")
    parts = cand.filter("bucketed").select("*", F.posexplode("hashes").alias("own", "band")).join(bucket, F.col("band") == F.col("b2")).select("root", "own", "band", "key", "copies", "hashes", F.col("b_chunks").alias("chunks"))
    pos = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    rows_ = whole.unionByName(parts).withColumn("chunk", pos).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows_ = rows_.join(grams, F.col("key") == F.col("k")).select("root", "own", "band", "key", "copies", "hashes", "grams", "chunk", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"))
    # Small groups share a bin of about BIN_GRAMS n-grams, whatever their number.
    sent, groups_ = cost.agg(F.coalesce(F.sum("sent"), F.lit(0)), F.coalesce(F.sum("chunks"), F.lit(0))).first()
    bins = max(int(sent // BIN_GRAMS) + 1, min(int(groups_), spark.sparkContext.defaultParallelism * 2), 1)
    rows_ = rows_.withColumn("bin", F.pmod(F.xxhash64("root", "own", "band", "p", "q"), F.lit(bins)))

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[bytes, bytes, int]] = []
        for (_, own, _, p, q), g in pdf.groupby(["root", "own", "band", "p", "q"], sort=False):
            g = g.sort_values("key")
            hashes = np.stack([np.asarray(x) for x in g["hashes"]]) if own >= 0 else None
            out += verify(list(zip(g["key"], g["copies"], g["chunk"], (np.asarray(x).view(np.uint64) for x in g["grams"]))), p, q, threshold, hashes, own)
        return pd.DataFrame(out, columns=["key", "tree", "links"])

    verified = materialize(rows_.groupBy("bin").applyInPandas(check, "key binary, tree binary, links bigint"), "verified")
    groups = connected_components(verified.select(F.col("key").alias("u"), F.col("tree").alias("v")))
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))

    member = classes.select("key", "rep", "copies").join(links.withColumnRenamed("key", "lk"), F.col("key") == F.col("lk"), "left").join(groups, F.col("key") == F.col("node"), "left")
    member = member.select("key", "rep", F.coalesce("root", "key").alias("g"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    member = materialize(member, "members")
    least = member.groupBy("g").agg(F.min("rep").alias("class_id")).withColumnRenamed("g", "g2")
    member = member.join(least, F.col("g") == F.col("g2")).select(F.col("key").alias("mk"), "g", "class_id", "copies", "n_links")
    out = sig.select("doc_id", "key").join(member, F.col("key") == F.col("mk"), "left")
    return out.select(
        "doc_id",
        F.lower(F.hex("key")).alias("class_key"),
        F.lower(F.hex("g")).alias("group_key"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).cast(id_type).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """docs, all columns, with one row of each group: that of the least doc_id (null last), then the least class key. Rows without words all stay; of rows with the same doc_id and text one stays."""
    found = near_duplicates(docs, n, threshold, recall, block)
    stay = found.filter("class_key is not null").groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class_key")).alias("s"))
    stay = stay.select(F.col("s.doc_id").alias("id"), F.unhex("s.class_key").alias("k"), F.lit(True).alias("stays"))
    keyed = with_key(docs, n)
    out = keyed.join(stay, (F.col("key") == F.col("k")) & F.col("row").getField("doc_id").eqNullSafe(F.col("id")), "left").filter("key is null or stays")
    alone = F.when(F.col("key").isNull(), F.monotonically_increasing_id())  # rows without words all stay
    return unpacked(out.withColumn("alone", alone).dropDuplicates(["key", "alone"]))
